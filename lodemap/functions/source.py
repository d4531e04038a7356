"""The text of one source file: comments, blocks, declarations and expressions. Small helpers that tasks run on one file at a time."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import islice

C_LIKE = ("js", "jsx", "ts", "tsx", "go", "java", "prisma", "gradle", "mod")
_STRING = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_COMMENTS = {
    "c": re.compile(r'(?s)"""(?:\\.|[^\\])*?"""|' + _STRING + r"|`(?:\\.|[^`\\])*`|(/\*.*?(?:\*/|\Z)|//[^\n]*)"),
    "py": re.compile(r'(?s)((?:"""|\'\'\')(?:\\.|[^\\])*?(?:"""|\'\'\'|\Z)|#[^\n]*)|' + _STRING),
    "sql": re.compile(r"(?s)'[^']*'|(--[^\n]*|/\*.*?(?:\*/|\Z))"),
    "xml": re.compile(r"(?s)(<!--.*?(?:-->|\Z))"),
    "#": re.compile(r"(?m)" + _STRING + r"|((?:^|(?<=[ \t]))#[^\n]*)"),
}
#: A text without these has no comment.
_MARKS = {"c": ("/*", "//"), "py": ("#", '"""', "'''"), "sql": ("--", "/*"), "xml": ("<!--",), "#": ("#",)}
#: What decides on blocks: strings are skipped, as nothing in them counts.
_BRACE = re.compile(r"(?s)" + _STRING + r"|`(?:\\.|[^`\\])*`|([{}()\[\]])")
_IF = re.compile(r"\bif\s*\(")
_TOKEN = re.compile(r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|\bif\s*\(|\belse\b|[{};\n]""")


def mask_comments(source: str, suffix: str = "java") -> str:
    """`source` with comments (and docstrings of Python) blanked out: same length, same line ends; strings and characters stay."""
    language = "c" if suffix in C_LIKE else suffix if suffix in _COMMENTS else "#"
    if not any(mark in source for mark in _MARKS[language]):
        return source
    rule = _COMMENTS[language]
    blank = lambda m: re.sub(r"[^\r\n]", " ", m[0]) if m[1] is not None else m[0]
    return rule.sub(blank, source)


def guards(masked: str) -> list[str | None]:
    """For each line of a source without comments, the conditions of the `if` and `else` blocks that it stands in, outermost first.

    A condition may go over several lines. The branch of an `else` is NOT (condition).
    """
    if not _IF.search(masked):
        return [None] * (masked.count("\n") + 1)
    found: list[str | None] = []
    blocks: list[str | None] = []  # one entry for each open brace
    waiting, closed, i, line_guard = None, None, 0, None
    while hit := _TOKEN.search(masked, i):
        i, text = hit.end(), hit.group()
        if text == "\n":
            found.append(line_guard or _joined(blocks, waiting))
            line_guard = None
        elif text == "{":
            blocks.append(waiting)
            waiting = closed = None
        elif text == "}":
            line_guard = line_guard or _joined(blocks, None)
            closed = blocks.pop() if blocks else None
        elif text == ";":
            line_guard = line_guard or _joined(blocks, waiting)
            closed, waiting = waiting, None
        elif text == "else":
            waiting = f"NOT ({closed})" if closed else None
        elif text.startswith("if"):
            end = closing(masked, i - 1)
            own = " ".join(masked[i:end].split())
            before = _joined(blocks, None)
            found.extend([before] * masked.count("\n", i, end))
            waiting = f"{waiting} and {own}" if waiting and waiting.startswith("NOT (") else own
            i = end + 1
    found.append(line_guard or _joined(blocks, waiting))
    return found


def _joined(blocks: list, last: str | None) -> str | None:
    known = [b for b in blocks if b]
    if last:
        known.append(last)
    return " and ".join(known) if known else None


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        if m[1] is not None:
            depth += 1 if m[1] in "{([" else -1
            if depth <= 0:
                return m.start()
    return len(text)


class Brackets:
    """The brackets of one text, paired once, so that none is looked for again from each that opens before it."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def pairs(self) -> dict[int, int]:
        pairs, opened = {}, []
        for m in _BRACE.finditer(self.text):
            if (c := m[1]) is not None:
                if c in "{([":
                    opened.append(m.start())
                elif opened:
                    pairs[opened.pop()] = m.start()
        return pairs | dict.fromkeys(opened, len(self.text))

    def closing(self, at: int) -> int:
        """`closing` of the text; a bracket within what reads as a string, or none, is looked at on its own."""
        end = self.pairs.get(at)
        return closing(self.text, at) if end is None else end


@cache
def _marked(marks: str) -> re.Pattern:
    """Strings, and as a group brackets and the characters `marks`."""
    return re.compile(r"(?s)" + _STRING + r"|`(?:\\.|[^`\\])*`|([{}()\[\]" + re.escape(marks) + "])")


def split_top(text: str, marks: str) -> list[str]:
    """`text` cut at the characters `marks` that stand in no bracket and no string, blanks taken off."""
    out, depth, last = [], 0, 0
    for m in _marked(marks).finditer(text):
        if (c := m[1]) is None:
            continue
        if c in marks and depth == 0:
            out.append(text[last : m.start()].strip())
            last = m.end()
        elif c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
    return [*out, text[last:].strip()]


def statement(text: str, at: int, ends: str) -> str:
    """What stands from `at` to the first of the characters `ends` outside brackets and strings, or to a bracket that closes more than was opened."""
    depth = 0
    for m in _marked(ends).finditer(text[at : at + 4_000]):
        if (c := m[1]) is None:
            continue
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return text[at : at + m.start()]
        elif depth == 0:
            return text[at : at + m.start()]
    return text[at : at + 4_000]


@dataclass(slots=True)
class Scope:
    """A class or function: where it stands, and to where it goes."""

    kind: str
    name: str
    at: int
    end: int
    detail: str | None = None
    owner: str | None = None
    member: str | None = None
    inherits: str | None = None
    parent: Scope | None = None


_CLASS = {
    "java": re.compile(r"\b(?:class|interface|record|enum)\s+(\w+)"),
    "js": re.compile(r"\bclass\s+(\w+)"),
    "go": re.compile(r"(?m)^[ \t]*type[ \t]+(\w+)[ \t]+(?:struct|interface)\b"),
}
_FUNCTION = {
    "java": re.compile(
        r"(?m)(?:^|(?<=[{};]))[ \t]*+(?:@\w++(?:\([^()]*\))?\s++)*(?:(?:public|protected|private|static|final|synchronized|default|abstract)\s++)*(?:<[^<>()]*>\s++)?"
        r"(?!return\b|new\b|else\b|throw\b|case\b|package\b|import\b)(?:[\w.]++(?:<[^(){};=]*>)?(?:\[\])*\s++(?!if\b|for\b|while\b|switch\b|catch\b|new\b)(\w++)|([A-Z]\w*+))\s*+\("),
    "js": re.compile(r"\bfunction\s+(\w+)\s*\(|\bconst\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?=\()"),
    "go": re.compile(r"(?m)^[ \t]*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("),
}
_PYTHON = re.compile(r"(?m)^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*(\(?)")


def types(parameters: str) -> str:
    """The types of a Java parameter list, as an overload's id has them."""
    if not parameters or parameters.isspace():
        return ""
    plain = re.sub(r"@\w+(?:\s*\([^)]*\))?|\bfinal\s", "", parameters)
    while (fewer := re.sub(r"<[^<>]*>", "", plain)) != plain:
        plain = fewer
    return ",".join(m[1] for p in plain.split(",") if (m := re.match(r"\s*([\w.\[\]]+)", p)))


_STOPS = {stops: re.compile("[{" + stops + "]") for stops in (";", "\n", "\n;")}
_HEAD_ENDS = re.compile(r"\)\s*(?:throws\s+[\w.,\s]+)?[{;]")
_ARROW = re.compile(r"\)\s*(?::[^=\n]+)?=>\s*(\{?)")
_EXTENDS = re.compile(r"\bextends\s+([\w.]+)")
_INDENT = re.compile(r"(?m)^([ \t]*)[^\s)\]}#]")


def _braced(text: str, at: int, stops: str, closing: Callable[[int], int]) -> int:
    """The end of the block that opens after `at`, or of the statement if one of `stops` comes first."""
    m = _STOPS[stops].search(text, at)
    return len(text) if m is None else closing(m.start()) if m[0] == "{" else m.start()


def scopes(text: str, suffix: str, closing: Callable[[int], int]) -> list[Scope]:
    """Classes and functions of a text without comments, in order, each with its member name: that of its owner before it. `closing` finds the bracket that closes one."""
    found: list[Scope] = []
    if suffix == "py":
        heads = list(_PYTHON.finditer(text))
        for m in heads:
            indent = len(m[1].expandtabs(8))
            end = len(text)
            for line in _INDENT.finditer(text, text.find("\n", m.end()) + 1 or len(text)):
                if len(line[1].expandtabs(8)) <= indent:
                    end = line.start()
                    break
            inherits = text[m.end() : closing(m.end() - 1)] if m[4] else None
            found.append(Scope("class" if m[2] == "class" else "function", m[3], m.start(2), end, inherits if m[2] == "def" else None, inherits=inherits if m[2] == "class" else None))
    else:
        group = "js" if suffix in ("js", "jsx", "ts", "tsx") else suffix
        if group not in _CLASS:
            return []
        for m in _CLASS[group].finditer(text):
            head = text[m.end() : m.end() + 1_000].split("{", 1)[0]
            extends = _EXTENDS.search(head) if group == "java" else None
            found.append(Scope("class", m[1], m.start(1), _braced(text, m.end(), ";" if group == "java" else "\n", closing), inherits=extends[1] if extends else None, detail=head))
        names = {s.name for s in found}
        for m in _FUNCTION[group].finditer(text):
            name, opened = m[1] or m[2], m.end() - 1 if m[1] or group == "java" else m.end()
            after = closing(opened)
            if group == "java":
                if m[2] and m[2] not in names or not _HEAD_ENDS.match(text[after : after + 300]):
                    continue
                end = _braced(text, after, ";", closing)
            elif group == "js" and m[2]:
                if not (arrow := _ARROW.match(text[after : after + 300])):
                    continue
                end = closing(after + arrow.end() - 1) if arrow[1] else after + arrow.end() + len(statement(text, after + arrow.end(), ";\n"))
            else:
                end = _braced(text, after, "\n" if group == "go" else "\n;", closing)
            found.append(Scope("function", name, m.start(1) if m[1] else m.start(2), end, text[opened + 1 : after]))
    found.sort(key=lambda s: (s.at, -s.end))
    open_: list[Scope] = []
    for s in found:
        while open_ and open_[-1].end <= s.at:
            open_.pop()
        s.parent = open_[-1] if open_ else None
        owners = [o for o in open_ if suffix == "py" or o.kind == "class"]
        if suffix == "py":
            s.owner = ".".join(o.name for o in owners) or None
        elif suffix == "java":
            s.owner = owners[-1].name if owners else None
        s.member = s.name if s.kind == "class" and suffix == "java" else ".".join(filter(None, [s.owner, s.name]))
        if s.kind == "function" and suffix == "java":
            s.member += f"({types(s.detail or '')})"
        open_.append(s)
    return found


class Places:
    """Lines, and the scopes around a place, of one text."""

    def __init__(self, text: str, found: list[Scope]):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.scopes, self.at = found, [s.at for s in found]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def around(self, at: int, kind: str) -> Scope | None:
        """The innermost scope of a kind at a place."""
        i = bisect_right(self.at, at)
        s = self.scopes[i - 1] if i else None
        while s is not None and not (s.kind == kind and s.end > at):
            s = s.parent
        return s

    def after(self, at: int, kind: str | None = None) -> Scope | None:
        """The next scope that begins after a place."""
        return next((s for s in islice(self.scopes, bisect_right(self.at, at), None) if kind is None or s.kind == kind), None)


# ---- expressions -------------------------------------------------------------------------------------------------------

_PLAIN = re.compile(r"\.(?:toString|build|toUriString|toUri|getValue|trim|encode|buildAndExpand)\(\)\s*$")


def terms(text: str, suffix: str, depth: int = 0) -> list[tuple[str, str]]:
    """An expression as the pieces that its value has one after another: (kind, text).

    kinds: `text` as it is; `name`, what a name or call stands for; `template`, an expression within a text; `key`, the setting
    that names a service, and `keyname`, a name that stands for one; `inner`, a name that is a later value of a format;
    `param`, a value that is not known. A name is its text without `this.`, a call ends in `()`.
    """
    text = text.strip()
    while text.endswith(")") and (m := _PLAIN.search(text)):
        text = text[: m.start()].strip()
    if depth > 8 or not text or len(text) > 4_000:
        return [("param", "")]
    if text.isidentifier():
        return [("name", text)]
    if text[0] in "\"'" and text[-1] == text[0] and len(text) > 1 and text.count(text[0]) == 2 and "\\" not in text and "\n" not in text:
        return [("text", text[1:-1])]
    parts = split_top(text, "+") if "+" in text else [text]
    if len(parts) > 1:
        return [t for p in parts for t in terms(p, suffix, depth + 1)]
    if text[0] == "(" and closing(text, 0) == len(text) - 1:
        return terms(text[1:-1], suffix, depth + 1)
    if m := re.fullmatch(r"(?s)([fFrRbBuU]{0,2})([\"'`])(.*)\2", text):
        if "f" not in m[1].lower() and m[2] != "`":
            return [("text", m[3])]
        # What stands in the braces of a template is an expression; extraction looks for its name.
        pieces = re.split(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}" if m[2] == "`" else r"\{([^{}]*)\}", m[3])
        return [("template" if i % 2 else "text", x) for i, x in enumerate(pieces) if i % 2 or x] or [("text", "")]
    if re.fullmatch(r"-?\d+(?:\.\d+)?", text):
        return [("text", text)]
    if m := re.match(r"(String\.format|fmt\.Sprintf)\(", text):
        args = split_top(text[m.end() : closing(text, m.end() - 1)], ",")
        form = terms(args[0], suffix, depth + 1)
        if len(form) != 1 or form[0][0] != "text":
            return [("param", "")]
        out: list[tuple[str, str]] = []
        for i, piece in enumerate(re.split(r"%[-+\d.]*[a-zA-Z]", form[0][1])):
            if i:
                own = terms(args[i], suffix, depth + 1) if i < len(args) else [("param", "")]
                # Only what stands first can name a service; later values are parameters.
                out += own if not out else [t if t[0] in ("text", "param") else ("inner", t[1]) for t in own]
            if piece:
                out.append(("text", piece))
        return out
    if m := re.search(r"\bgetConfig(?:Value)?\(", text):
        key = text[m.end() : closing(text, m.end() - 1)].strip()
        if q := re.fullmatch(r"[\"']([^\"']*)[\"']", key):
            return [("key", q[1])]
        if q := re.fullmatch(r"(?:this\.)?(\w+)", key):
            return [("keyname", q[1])]
        return [("key", key.rsplit(".", 1)[-1])] if re.fullmatch(r"[A-Z]\w*(?:\.\w+)*", key) else [("param", "")]
    if m := re.match(r"UriComponentsBuilder\s*\.\s*from\w+\(", text):
        end = closing(text, m.end() - 1)
        return terms(text[m.end() : end], suffix, depth + 1) + _paths(text[end + 1 :], suffix, depth)
    if m := re.match(r"((?:this\.)?\w+)\s*(?=\.\s*path\()", text):
        return terms(m[1], suffix, depth + 1) + _paths(text[m.end() :], suffix, depth)
    if m := re.fullmatch(r"(?:this\.|\w+\.)?(\w+)\(\s*\)", text):
        return [("name", m[1] + "()")]
    if m := re.fullmatch(r"(?:this\.)?(\w+(?:\.\w+)*)", text):
        return [("name", m[1])]
    return [("param", "")]


def _paths(text: str, suffix: str, depth: int) -> list[tuple[str, str]]:
    """The pieces that `.path(...)` calls add one after another."""
    return [t for m in re.finditer(r"\.\s*path\(", text) for t in terms(text[m.end() : closing(text, m.end() - 1)], suffix, depth + 1)]
