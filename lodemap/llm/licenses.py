"""Licence scans by canonical digest: whole texts, and whole lines of texts, joined to known licence digests.

Only DataFrame functions. A canonical text has no copyright lines, case, punctuation or spelling variants, and
single blanks; its sha256 is the join key, so a match is one of the entire text and never of a part.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.llm.common import table

# Spellings that licence matching treats as equal.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("cancelled", "canceled"),
    ("catalogue", "catalog"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Licence texts and the notices that stand for a licence.
KNOWN = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "Released under the Mozilla Public License 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]

#: Title lines of the short texts.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSD-2-Clause": ["BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The 2-Clause BSD License", "The BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "The 3-Clause BSD License", "The BSD 3-Clause License", "New BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}
#: Where the terms of the long texts begin; what stands before are titles and, in the GNU licences, the owner.
TERMS = {"Apache-2.0": "TERMS AND CONDITIONS FOR USE", "MPL-1.1": "1. Definitions", "MPL-2.0": "1. Definitions", "CC0-1.0": "CREATIVE COMMONS CORPORATION"}
#: Addresses of the Free Software Foundation in copies of its older licences.
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
ADDRESS = re.compile(r"51 Franklin St(?:reet)?,\s+Fifth\s+Floor,\s+Boston,\s+MA\s+02110-1301,?\s+USA")
#: Lines that only name an owner: they differ between copies of one licence.
COPYRIGHT_LINE = r"(?m)^[\t ]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: What stands between words, line ends apart.
WORD_GAP = r"[^\p{L}\p{N}\n]+"
#: Known digests are broadcast up to this many rows; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Lines are told apart by shape before their digest where known texts have so many shapes at most.
MOST_SHAPES = 1_000


def worded(text: Column) -> Column:
    """Lines of words in lower case with single blanks, without copyright lines; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), WORD_GAP, " ")


def spelled(line: Column) -> Column:
    """Words joined by single blanks, each in one spelling; `line` is of `worded`."""
    spelling = F.create_map(*[F.lit(x) for pair in SPELLINGS for x in pair])
    words = F.transform(F.split(F.btrim(line, F.lit(" \n")), "[ \n]+"), lambda w: F.when(w.isin([v for v, _ in SPELLINGS]), F.element_at(spelling, w)).otherwise(w))
    return F.array_join(words, " ")


def _shape(line: Column) -> Column:
    """What equal texts share in any spelling: the number of words and the first two letters. It spares digests of lines."""
    line = F.trim(line)
    return F.concat_ws(":", F.length(line) - F.length(F.replace(line, F.lit(" "))), F.left(line, F.lit(2)))


def whole_texts() -> list[tuple[str, str]]:
    """KNOWN and the whole texts of the folder `license_texts`, with and without titles, appendices and list numbers."""
    read = lambda name: files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    short = [(name, text) for name, text in KNOWN[:4]]
    three = read("BSD-3-Clause").split("\n", 1)[1].strip()
    two = re.sub(r"(?s)3\. Neither.*?permission\.\s+", "", three)
    university = three.replace("copyright holder nor the names of its\n   contributors", "<organization> nor the\n   names of its contributors")
    for name, text in (("BSD-3-Clause", three), ("BSD-3-Clause", university), ("BSD-2-Clause", two)):
        unwrapped = "\n\n".join(" ".join(x.split()) for x in text.split("\n\n"))
        for form in (text, unwrapped):
            short += [(name, form), (name, re.sub(r"(?m)^\d\. ", "* ", form))]
    unlicense = read("Unlicense").strip()
    for form in (unlicense, unlicense[: unlicense.rindex("For more")].strip()):
        short += [("Unlicense", form), ("Unlicense", form.replace("https:", "http:"))]
    out = KNOWN + short + [(name, f"{title}\n\n{text}") for name, text in short for title in TITLES[name]]

    for name in "Apache-2.0 CC0-1.0 MPL-1.1 MPL-2.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0".split():
        text = read(name).strip()
        ends = [text]
        if (end := text.find("END OF TERMS AND CONDITIONS")) >= 0:
            ends += [text[:end], text[: end + len("END OF TERMS AND CONDITIONS")]]
        elif (end := text.find("Exhibit A - ")) >= 0:
            ends.append(text[:end])
        for form in ends:
            forms = [form]
            if name in TERMS:
                forms.append(form[form.index(TERMS[name]) :])
                if name == "CC0-1.0":
                    forms += [form[form.index("CC0 1.0 Universal") :], "CC0 1.0 Universal\n\n" + form[form.index("Statement of Purpose") :], form[form.index("Statement of Purpose") :]]
            else:  # without the two lines of the title, which are not lines of an owner
                forms.append(form.split("\n", 2)[2])
            for x in forms:
                out += [(name, x)] + [(name, ADDRESS.sub(a, x)) for a in ADDRESSES if ADDRESS.search(x)]
    return out


def known_digests(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, license, shape) of licence texts (`whole_texts`, if None); one row for a digest, the smallest name for equal texts."""
    texts = whole_texts() if texts is None else texts
    rows = spark.createDataFrame(texts, "license string, text string").select("license", F.translate(worded(F.col("text")), "\n", " ").alias("words"))
    rows = rows.select("license", F.regexp_replace("words", " +", " ").alias("words"))
    rows = rows.groupBy(F.sha2(spelled(F.col("words")), 256).alias("digest")).agg(F.min("license").alias("license"), F.min(_shape(F.col("words"))).alias("shape"))
    return spark.createDataFrame(rows.collect(), rows.schema)  # small, and asked for more than once


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each row of `docs` (doc_id, text): its digest, the licence that its whole text is, and its licence lines.

    `license` is null unless the whole text is a known one. `license_lines` counts the lines whose whole is a
    known text; `line_licenses` joins their names by commas, null for none. A null text has a null digest and no
    lines; an empty text matches nothing. Rows repeated in `docs` are repeated in the result. Other columns are
    ignored. Only lines that match move, so a hot document or source costs no skew.
    """
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    small = F.broadcast if few else lambda df: df
    shapes = [r["shape"] for r in known.select("shape").distinct().limit(MOST_SHAPES + 1).collect()]
    # One pass over the texts: each row with the digests of its lines, or of those that have the shape of a known text.
    nothing = F.lit("")  # joins on keys that cannot be null compute each key once
    rows = docs.select("doc_id", worded(F.col("text")).alias("words"))
    parts = F.transform(F.split("words", "\n"), F.trim)
    if len(shapes) <= MOST_SHAPES:
        parts = F.filter(parts, lambda line: _shape(line).isin(shapes))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.sha2(spelled(F.col("words")), 256), nothing).alias("key"), F.transform(parts, lambda line: F.sha2(spelled(line), 256)).alias("parts"))
    lines = rows.select("row", "doc_id", "key", F.explode_outer("parts").alias("part")).withColumn("part", F.coalesce("part", nothing))
    named = lines.join(small(known.select(F.coalesce("digest", nothing).alias("part"), F.col("license").alias("line_license"))), "part", "left")
    found = named.groupBy("row", "doc_id", "key").agg(
        F.count("line_license").alias("license_lines"), F.array_join(F.array_sort(F.collect_set("line_license")), ",").alias("names"))
    whole = small(known.select(F.coalesce("digest", nothing).alias("key"), "license"))
    return found.join(whole, "key", "left").select(
        "doc_id", F.nullif("key", nothing).alias("digest"), "license", "license_lines", F.nullif("names", nothing).alias("line_licenses"))


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """The licence scan of all documents against the known licences."""
    return scan(table(spark, sf_dir, "documents"), known_digests(spark))


def oracle_sql() -> str:
    """The same scan in DuckDB SQL."""

    def canon(x: str) -> str:
        words = f"regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT_LINE}', '', 'g'), '{WORD_GAP}', ' ', 'g')"
        cases = " ".join(f"WHEN '{v}' THEN '{s}'" for v, s in SPELLINGS)
        return f"array_to_string(list_transform(regexp_split_to_array(trim({words}, ' ' || chr(10)), '[ \\n]+'), lambda w : CASE w {cases} ELSE w END), ' ')"

    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    return f"""
WITH known AS (SELECT sha256({canon('text')}) AS digest, min(license) AS license FROM (VALUES {values}) v(license, text) GROUP BY 1),
rows AS (SELECT doc_id, text, sha256({canon('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, digest AS of, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM rows),
hits AS (SELECT doc_id, of, count(*) AS license_lines, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses
         FROM (SELECT doc_id, of, sha256({canon('part')}) AS digest FROM lines) l JOIN known USING (digest) GROUP BY doc_id, of)
SELECT r.doc_id, r.digest, k.license, CAST(coalesce(h.license_lines, 0) AS BIGINT) AS license_lines, h.line_licenses
FROM rows r LEFT JOIN known k ON r.digest = k.digest LEFT JOIN hits h ON r.doc_id IS NOT DISTINCT FROM h.doc_id AND r.digest = h.of
"""
