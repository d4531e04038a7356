"""Kinds of secrets that a text holds; never the secret itself.

Keys and tokens of public formats are known by their form. A value that is assigned to a name is a secret by three
things: the last part of the name says so, the value is long and varied enough, and it is no stand-in. Each assignment
of a text is judged on its own, so a stand-in hides no secret beside it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public formats of keys and tokens.
FORMATS = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("forge_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})"),
    ("cloud_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("bearer", r"(?i)\bbearer\s+[A-Za-z0-9._~+/-]{20,}"),
]
KINDS = [*[k for k, _ in FORMATS], "assigned"]

#: A name, a sign of assignment and a quoted value without blanks. A word is tried once, from its first letter, and given
#: back never, so the time is linear in the text however long a word is.
ASSIGNMENT = r"(?<![A-Za-z0-9_.-])[0-9_.-]*+([A-Za-z][A-Za-z0-9_.-]*+)[\x22\x27]?\s*+(?:=>|:=|=|:)\s*+[\x22\x27]([^\x22\x27\s]++)[\x22\x27]"
#: Last parts of names, in lower case, whose value is kept from others.
NAMES = r"(?:pass|passwd|password|passphrase|pwd|secret|credential|credentials|token|apikey|(?:api|access|private|signing|client|secret)[_.-]?key)$"
#: A secret has so many characters at least, and so many different ones.
LEAST, VARIED = 10, 6
#: Values that only stand in for one: references to a setting, marks to be filled in, words that say so.
STAND_IN = r"^(?:[$%#]?\{.*\}|<.*>|\[.*\]|%.*%|\$\w+)$|example|sample|dummy|placeholder|change[_-]?(?:me|it)|your[_-]|fill[_-]?in|redacted"


def assigned(text: Column) -> Column:
    """The names of those assignments of a text whose value is a secret, in order."""
    group = lambda k: F.regexp_extract_all(text, F.lit(ASSIGNMENT), F.lit(k))
    matches = F.arrays_zip(F.transform(group(1), F.lower).alias("name"), group(2).alias("value"))
    varied = lambda v: F.size(F.array_distinct(F.split(v, ""))) >= VARIED
    secret = lambda m: m["name"].rlike(NAMES) & (F.length(m["value"]) >= LEAST) & varied(m["value"]) & ~F.lower(m["value"]).rlike(STAND_IN)
    return F.transform(F.filter(matches, secret), lambda m: m["name"])


def found(text: Column, kind: str) -> Column:
    """Whether a text has a secret of a kind (of KINDS); null for a null text."""
    return F.size(assigned(text)) > 0 if kind == "assigned" else text.rlike(dict(FORMATS)[kind])
