"""Facts of source files by rules: what a file declares, asks for and answers, one row each.

Tasks look at one file at a time: comments are masked, classes and functions found with the blocks they span, and the
rules of the file's language, regular expressions and calls with arguments, are applied to the whole text. A statement
may go over several lines, and a line may have any number of facts. No shuffle is needed for the facts. Values that
are not written where they are used stay open, as terms; operators.values finds them by joins.
"""

from __future__ import annotations

import ast
import gc
import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, cached_property, partial
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions import identity, source, urls
from lodemap.functions.source import Places, mask_comments  # noqa: F401
from lodemap.operators.traverse import shared
from lodemap.sources.session import worker_path


@dataclass(frozen=True)
class Rule:
    """`fields` maps method, name, url, detail and argument to the number of a group, or to a fixed text.

    word: a text that every match holds, so files without it are not searched.
    """

    kind: str
    suffixes: str
    pattern: str
    fields: dict
    word: str | None = None


_QUOTED = r"[\x22\x27`]([^\x22\x27`\n]*)[\x22\x27`]"
_JS = "js|jsx|ts|tsx"

# What a text of a language declares or does.
RULES = [
    Rule("import", "py", r"^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", {"name": 1}, word="import"),
    Rule("import", "py", r"^[ \t]*import[ \t]+([\w., \t]+)", {"name": 1}, word="import"),
    Rule("route", "py", r"^[ \t]*@(?:router|app|api|blueprint|bp)\.(get|post|put|patch|delete)\(\s*" + _QUOTED, {"method": 1, "url": 2}, word="@"),
    Rule("system", "py", r"\b(?:psycopg2?|asyncpg)\b", {"name": "postgresql", "detail": "database"}),
    Rule("system", "py", r"\bRedis\.from_url\(", {"name": "redis", "detail": "datastore"}, word="Redis.from_url("),
    Rule("system", "py", r"\.(?:rpush|lpush|lpop|rpop|blpop)\(", {"name": "redis", "detail": "messaging"}),
    Rule("import", _JS, r"^[ \t]*import\b[^;\x22\x27`]*?from\s+" + _QUOTED, {"name": 1}, word="import"),
    Rule("import", _JS, r"^[ \t]*import\s+" + _QUOTED, {"name": 1}, word="import"),
    Rule("handler", _JS, r"^[ \t]*export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE)\b", {"method": 1}, word="export"),
    Rule("import", "go", r"^[ \t]*(?:import\s+)?(?:(\w+)[ \t]+)?\x22([\w./-]+)\x22[ \t]*$", {"name": 2, "argument": 1}, word="\""),
    Rule("module", "mod", r"^[ \t]*module[ \t]+(\S+)", {"name": 1}),
    Rule("import", "java", r"^[ \t]*import\s+(?:static\s+)?([\w.]+)\s*;", {"name": 1}, word="import"),
    Rule("package", "java", r"^[ \t]*package\s+([\w.]+)\s*;", {"name": 1}, word="package"),
    Rule("field", "java", r"(?:^|(?<=[{};]))[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:private|protected|public|final|static)\s+)*([A-Z]\w*)(?:<[^;=]*>)?\s+(\w+)\s*(?:=|;)", {"name": 2, "detail": 1}),
    Rule("delegate", "java", r"\bclass\s+(\w+)\b[^{]*\bimplements\b[^{]*\bJavaDelegate\b", {"name": 1}, word="JavaDelegate"),
    Rule("resource", "java", r"@JsonApiResource\s*\(\s*(?:type\s*=\s*)?" + _QUOTED, {"name": 1}, word="@JsonApiResource"),
    Rule("action", "java", r"\b(\w+)\.add(Click|Selection)Listener\(", {"method": 2, "name": 1}, word="Listener("),
    Rule("system", "java", r"\bopsForValue\(\)", {"name": "redis", "detail": "datastore"}, word="opsForValue()"),
    Rule("system", "java", r"\b(?:redisTemplate|stringRedisTemplate)\.convertAndSend\(", {"name": "redis", "detail": "pubsub"}, word=".convertAndSend("),
    Rule("prefix", "properties", r"^[ \t]*(crnk|katharsis)\.pathPrefix\s*[=:]\s*(\S*)", {"name": 1, "url": 2}),
    Rule("system", "properties", r"^spring\.datasource\.url\s*=\s*jdbc:(\w+):", {"name": 1, "detail": "database"}),
    Rule("system", "properties", r"^spring\.cache\.type\s*=\s*(redis)", {"name": 1, "detail": "cache"}),
    Rule("system", "properties", r"^spring\.data\.(redis)\.", {"name": 1, "detail": "datastore"}),
    Rule("system", "prisma", r"^[ \t]*provider\s*=\s*\x22(postgresql|mysql|sqlite|mongodb)\x22", {"name": 1, "detail": "database"}),
    Rule("system", "sql", r"(?i)create\s+extension\s+.*\b(?:pg_trgm|postgis|pgcrypto|citext)\b", {"name": "postgresql", "detail": "database"}),
    Rule("system", "properties", r"(?i)^[ \t]*[\w.-]*(whatsapp|stripe|twilio|sendgrid|paypal)[\w.-]*\s*[=:]", {"name": 1}),
    Rule("system", "properties", r"(?i)^[ \t]*[\w.-]*provider\s*[=:]\s*(whatsapp|stripe|twilio|sendgrid|paypal)\b", {"name": 1}),
    Rule("system", "yml|yaml|gradle|xml", r"\bjdbc:(\w+):", {"name": 1, "detail": "database"}),
    Rule("system", "yml|yaml", r"^[ \t]*image:\s*[\x22']?(?:[\w./-]*/)?(postgres|mysql|mariadb|redis|mongo|rabbitmq|kafka)\b", {"name": 1, "detail": "container"}),
    Rule("system", "txt|toml", r"^[ \t]*[\x22']?(psycopg2?|asyncpg|redis|pymongo|kafka-python|pika|stripe|twilio)\b", {"name": 1, "detail": "dependency"}),
    Rule("system", "gradle", r"[\x22'](?:[\w.-]+:)(postgresql|jedis|mysql-connector-j|kafka-clients|amqp-client)\b", {"name": 1, "detail": "dependency"}),
    Rule("system", "xml", r"<artifactId>\s*(postgresql|jedis|mysql-connector-j|kafka-clients|amqp-client)\s*</artifactId>", {"name": 1, "detail": "dependency"}),
    Rule("system", "mod", r"^[ \t]*(?:require\s+)?github\.com/(?:redis|go-redis|jackc|lib)/(redis|go-redis|pgx|pq)\b", {"name": 1, "detail": "dependency"}),
    Rule("system", "json", r"^[ \t]*\x22(pg|mysql2?|redis|ioredis|mongodb|kafkajs|amqplib|stripe|twilio)\x22\s*:\s*\x22", {"name": 1, "detail": "dependency"}),
    Rule("mail", "properties", r"^[ \t]*spring\.mail\.(host|port)\s*[=:]\s*([\w.-]+)", {"method": 1, "name": 2}),
    Rule("host", "py|go|java|properties|" + _JS, r"(https?://[^\s\x22\x27`<>\\]+)", {"url": 1}, word="://"),
]
FIELDS = ("method", "name", "url", "detail", "argument")
_BY_SUFFIX: dict[str, list] = {}
for _rule in RULES:
    for _suffix in _rule.suffixes.split("|"):
        _BY_SUFFIX.setdefault(_suffix, []).append((_rule, re.compile(_rule.pattern, re.M)))

_VERBS = "get|post|put|patch|delete"
# Calls whose arguments are read, by language. Words and blanks are possessive: what follows cannot stand in them.
_CALLS = {
    "java": re.compile(
        r"\.\s*+(getForObject|getForEntity|postForObject|postForEntity|patchForObject|exchange|delete|send|convertAndSend|startProcess(?:InstanceByKey(?:AndTenantId)?)?)\s*\("
        rf"|\.({_VERBS})\(\)\s*\.uri\(|\bBindingBuilder\s*\.\s*(bind)\("),
    "js": re.compile(rf"\b(fetch)\(|\b(\w++)\.({_VERBS})(?:<[^()]*>)?\(|\bconst\s+(\w+)\s*(?::[^=\n]+)?=\s*axios\.create\("),
    "go": re.compile(r"\bhttp\.(NewRequest|NewRequestWithContext|Get|Post|Head)\(|\b(\w++)\.(GET|POST|PUT|PATCH|DELETE)\(|\b(\w++)\s*+:?=\s*+(\w++)\.Group\(|(?:\b(\w++)\.)?\b([A-Za-z]\w*+)\("),
    "py": re.compile(rf"\b(?:httpx|requests|client|session)\.({_VERBS})\("),
}
#: Kinds that calls are read for.
_OF_CALLS = ("request", "perhaps", "binding", "publish", "start", "client", "route", "group", "mount")
#: Go's requests alone, where nothing else is asked for: no other call begins within one.
_GO_REQUESTS = re.compile(r"\bhttp\.(NewRequest|NewRequestWithContext|Get|Post|Head)\(")
_ANNOTATION = re.compile(r"@(\w+)\b[ \t]*(\()?")
_MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE", "RequestMapping": None}
_LISTENERS = {"KafkaListener": ("topics", "kafka"), "RabbitListener": ("queues", "rabbitmq"), "JmsListener": ("destination", "jms")}
_CALL = re.compile(r"\b([a-z]\w*)\.([a-z]\w*)\(")
_PLACEHOLDER = re.compile(r"\$\{[^:}]+:([^}]*)\}")
_STRINGS = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`")
_NAMED = re.compile(r"\w+(?:\(\))?")
_STATIC = re.compile(r"(?:\w+\.)*([A-Z]\w*)\.(\w+(?:\(\))?)")
_TYPED = re.compile(r"[\w>\]]\s+$")
_INDENTED = re.compile(r"(?m)^[ \t]+(?=\S)")
_EFFECT = re.compile(r"\b(\w+\.(?:set|select|deselect|clear|add|remove)\w*\([^;{}]*\))\s*;")
_DEFINED = {
    # Blanks, of which masked comments are long runs, belong to one part each (possessive), so that a line is looked at once and not once for each cut.
    "java": re.compile(r"(?:^|(?<=[{};)]))[ \t]*+(?:@\w+(?:\([^)]*\))?\s*+)*((?:(?:private|protected|public|final|static)\s++)*)(?:[\w.<>\[\],?](?:[\w.<>\[\],? ]*[\w.<>\[\],?])?\s++|(?<=[ \t])\s++)?(?:this\.)?(\w++)\s*+=(?!=)\s*", re.M),
    "js": re.compile(r"(?:^|(?<=[{};]))[ \t]*(?:export\s+)?()(?:const|let|var)\s+(\w+)\s*(?::[^=\n]+)?=\s*", re.M),
    "go": re.compile(r"(?:^|(?<=[{};]))[ \t]*()(?:const\s+|var\s+)?(\w+)(?:\s+string)?\s*:?=(?!=)\s*", re.M),
    "py": re.compile(r"^[ \t]*()(\w+)\s*=(?!=)\s*", re.M),
}
_IS_STATIC = re.compile(r"\bstatic\b")
_RETURN = re.compile(r"\breturn\b[ \t]*")
_ENDS = {"java": ";", "js": ";\n", "go": ";\n", "py": "\n"}
TERM = "struct<kind:string,text:string,at:int>"
_TEXTS = ["repo", "path", "suffix", "scope", "kind", *FIELDS, "member", "handler", "function", "condition", "listener", "key"]
SCHEMA = ", ".join([*[f"{c} string" for c in _TEXTS], "line int", "n int", "at int", "effects array<string>", f"terms array<{TERM}>", f"other array<{TERM}>", *[f"{c} array<array<struct<kind:string,text:string>>>" for c in ("known", "other_known")]])
_TERMS = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("at", pa.int32())]))
_VALUES = pa.list_(pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())])))
_ARROW = pa.schema([*[(c, pa.string()) for c in _TEXTS], *[(c, pa.int32()) for c in ("line", "n", "at")], ("effects", pa.list_(pa.string())), ("terms", _TERMS), ("other", _TERMS), ("known", _VALUES), ("other_known", _VALUES)])
#: Facts that a task hands over at once; those of one file are never more than its text makes.
MOST_ROWS = 4_096
#: Names that one use has replaced in its task; a use with more is followed by joins.
MOST_STEPS = 256
_REFERENCES = ("ref", "inner", "keyref")
#: A reference to a field or to what a function returns is not bound to a place in the text.
ANYWHERE = 1 << 30


class _File:
    """The facts of one file; with `kinds`, of these kinds alone, and no rule of others is tried."""

    def __init__(self, path: str, suffix: str, content: str, kinds: frozenset[str] | None = None):
        self.path, self.suffix, self.content, self.kinds = path, suffix, content, kinds
        self.lang = "js" if suffix in _JS.split("|") else suffix
        self.text = mask_comments(content.replace("\r\n", "\n"), suffix)
        self.closing = source.Brackets(self.text).closing
        self.places = Places(self.text, source.scopes(self.text, suffix, self.closing))
        self.guards = source.guards(self.text) if suffix == "java" else None
        self.facts: list[dict] = []
        self.keys: dict[str, tuple] = {}  # what a key names, and from which of its definitions on
        self.injected: dict[str, list[tuple]] = {}
        self.meant: dict[str, list[tuple]] = {}

    def asked(self, *kinds: str) -> bool:
        return self.kinds is None or not self.kinds.isdisjoint(kinds)

    def add(self, at: int, kind: str, expression: str | None = None, other: str | None = None, **fields) -> None:
        if not self.asked(kind):
            return
        inside = self.places.around(at, "function")
        fact = {"at": at, "line": self.places.line(at), "kind": kind, "function": inside.member if inside else None, **{k: v or None for k, v in fields.items()}}
        if self.guards is not None:
            fact["condition"] = self.guards[fact["line"] - 1] if fact["line"] <= len(self.guards) else None
        for name, written in (("terms", expression), ("other", other)):
            if written is not None:
                fact[name] = self.bound(source.terms(written, self.suffix), at)
        self.facts.append(fact)

    # -- names ----------------------------------------------------------------------------------------------------------

    @cached_property
    def definitions(self) -> dict:
        """Assignments by (function, name), fields by (owner, name), and what functions return by (owner, name())."""
        found: dict[tuple, list] = {}
        if self.lang not in _DEFINED:
            return found
        for m in _DEFINED[self.lang].finditer(self.text):
            at = m.start(2)
            inside, owner = self.places.around(at, "function"), self.places.around(at, "class")
            owner = owner.name if owner and self.lang == "java" else ""
            if inside is not None and "this." not in m[0] and not (self.lang == "java" and (owner, m[2]) in found and not _TYPED.search(m[0][: m.start(2) - m.start()])):
                found.setdefault((inside.member, m[2]), []).append((at, m.end(), self._nested(inside, at)))
            else:
                found.setdefault((owner, m[2]), []).append((at, m.end(), False))
        for m in _RETURN.finditer(self.text):
            inside = self.places.around(m.start(), "function")
            if inside is not None:
                owner = self.places.around(m.start(), "class")
                found.setdefault((owner.name if owner and self.lang == "java" else "", inside.name + "()"), []).append((m.start(), m.end(), False))
        return found

    def _nested(self, inside, at: int) -> bool:
        """Whether a place lies in a block within the function, so that it may be passed by."""
        if self.lang == "py":
            indent = lambda i: i - (self.text.rfind("\n", 0, i) + 1)
            first = _INDENTED.search(self.text, self.text.find("\n", inside.at) + 1)
            return first is not None and indent(at) > len(first[0])
        text = _STRINGS.sub("", self.text[inside.at : at])
        return text.count("{") - text.count("}") > 1

    def bound(self, terms: list[tuple[str, str]], at: int) -> list[dict]:
        """Terms with their names bound to keys of definitions; texts that stand side by side are one."""
        out: list[dict] = []
        for kind, text in terms:
            term = self._bound(kind, text, at)
            if out and term["kind"] == out[-1]["kind"] == "text":
                out[-1]["text"] += term["text"]
            else:
                out.append(term)
        return out

    def _bound(self, kind: str, text: str, at: int) -> dict:
        term = lambda kind, text, at=0: {"kind": kind, "text": text, "at": at}
        if kind in ("text", "param", "key"):
            return term(kind, _PLACEHOLDER.sub(r"\1", text) if kind == "text" and self.lang == "java" else text)
        if kind == "template":
            name = text.removeprefix("this.").strip()
            known = self._bound("name", name, at) if _NAMED.fullmatch(name) else term("param", "")
            return known if known["kind"] == "ref" else term("text", "${" + text + "}" if self.lang == "js" else "{param}")
        ref = "keyref" if kind == "keyname" else "inner" if kind == "inner" else "ref"
        inside, owner = self.places.around(at, "function"), self.places.around(at, "class")
        local = (inside.member, text) if inside else None
        if local in self.definitions:
            before = [d for d in self.definitions[local] if d[0] < at]
            if before:
                sure = max((i for i, d in enumerate(before) if not d[2]), default=-1)
                key = f"{self.path}::{local[0]}#{text}@{sure}"
                self.keys[key] = (local, sure)
                return term(ref, key, at)
        if inside and text in (inside.detail or "") and "." not in text and not text.endswith("()") and re.search(rf"\b{re.escape(text)}\b", inside.detail):
            return term("param", "")
        while True:
            mine = (owner.name if owner and self.lang == "java" else "", text)
            if mine in self.definitions:
                key = f"{self.path}::{mine[0]}#{text}"
                self.keys[key] = (mine, None)
                return term(ref, key, ANYWHERE)
            if owner is None or self.lang != "java":
                break
            owner = owner.parent if owner.parent and owner.parent.kind == "class" else None
        if self.lang == "java" and (m := _STATIC.fullmatch(text)):
            mine = (m[1], m[2])
            if mine in self.definitions:
                key = f"{self.path}::{mine[0]}#{m[2]}"
                self.keys[key] = (mine, None)
                return term(ref, key, ANYWHERE)
            return term(ref, f"class:{m[1]}#{m[2]}", ANYWHERE)
        return term("inner" if kind == "inner" else "open", text if kind != "keyname" else "")

    def meanings(self, key: str) -> list[tuple]:
        """(at, line, terms) of the definitions of a key."""
        if (found := self.meant.get(key)) is None:
            found = self.meant[key] = []
            if key in self.keys:
                name, sure = self.keys[key]
                places = self.definitions[name]
                if sure is not None:  # the last definition that cannot be passed by, and those after it that can
                    places = [*places[max(sure, 0) : sure + 1], *_until_sure(places[sure + 1 :])]
                for at, start, _ in places:
                    written = source.statement(self.text, start, _ENDS[self.lang])
                    found.append((at, self.places.line(at), self.bound(source.terms(written, self.suffix), at)))
        return found

    def values(self, terms: list[dict]) -> list[list[dict]] | None:
        """Every value of terms by the definitions of this file, as values.expand has them; None where others' are needed or the replacements are many."""
        todo, found, steps = [[(t["kind"], t["text"], t["at"], ()) for t in terms]], {}, 0
        while todo:
            row = todo.pop()
            i = next((i for i, t in enumerate(row) if t[0] in _REFERENCES and "#" in t[1]), None)
            if i is None:
                found[tuple((kind, text) for kind, text, _, _ in row)] = None
                continue
            kind, key, at, via = row[i]
            steps += 1
            if steps > MOST_STEPS or key not in self.keys and key not in self.injected:
                return None
            known = [] if key in via else [m for place, _, m in (*self.meanings(key), *self.injected.get(key, ())) if place < at]
            for meaning in known:
                if kind == "keyref" and len(meaning) == 1 and meaning[0]["kind"] == "text":
                    new = [("key", meaning[0]["text"], 0, ())]
                else:
                    new = [("inner" if kind == "inner" and m["kind"] in ("ref", "open") else m["kind"], m["text"], m["at"], (*via, key)) for m in meaning]
                todo.append([*row[:i], *new, *row[i + 1 :]])
            if not known:
                todo.append([*row[:i], ("key" if kind == "keyref" else "param", "", 0, ()), *row[i + 1 :]])
        return [[{"kind": kind, "text": text} for kind, text in row] for row in found]

    def define(self) -> None:
        """Values by the definitions of this file; the definitions that all other uses need, and those that they need in turn; constants of Java classes may be needed elsewhere."""
        if self.lang == "java" and self.asked("constant") and "static" in self.text:
            for (owner, name), places in self.definitions.items():
                if owner in self.classes and not name.endswith("()") and len(places) == 1 and _IS_STATIC.search(self.text[max(0, places[0][0] - 60) : places[0][0]].rsplit(";", 1)[-1]):
                    terms = source.terms(source.statement(self.text, places[0][1], ";"), self.suffix)
                    self.facts.append({"at": places[0][0], "line": self.places.line(places[0][0]), "kind": "constant", "key": f"class:{owner}#{name}", "terms": self.bound(terms, places[0][0])})
        if not self.asked("define"):
            return
        needed: list[str] = []
        keys = lambda terms: [t["text"] for t in terms if t["kind"] in _REFERENCES]
        for fact in self.facts:
            for written, values in (("terms", "known"), ("other", "other_known")):
                terms = fact.get(written)
                if terms is None or fact["kind"] == "define" or written == "terms" and len(terms) == 1 and terms[0]["kind"] == "text":
                    continue
                if fact["kind"] == "constant" or (known := self.values(terms)) is None:
                    needed += keys(terms)
                else:
                    fact[values] = known
        done: set[str] = set()
        while needed:
            if (key := needed.pop()) not in done:
                done.add(key)
                for at, line, terms in self.meanings(key):
                    self.facts.append({"at": at, "line": line, "kind": "define", "key": key, "terms": terms})
                    needed += keys(terms)

    @property
    def classes(self) -> set[str]:
        return {s.name for s in self.places.scopes if s.kind == "class"}

    # -- rules ----------------------------------------------------------------------------------------------------------

    def scan(self) -> list[dict]:
        if self.suffix == "py" and (wrong := _broken(self.content)) is not None:
            return [{"at": 0, "line": wrong[0], "kind": "error", "name": wrong[1]}] if self.asked("error") else []
        for s in self.places.scopes if self.asked("class", "function", "extends") else []:
            self.add(s.at, s.kind, name=s.name, detail=s.detail if s.kind == "function" and self.suffix in ("java", "go") else None, member=s.member)
            if s.inherits and self.suffix == "java":
                self.add(s.at, "extends", name=s.name, argument=s.inherits.rsplit(".", 1)[-1], detail=s.inherits)
        for rule, pattern in _rules(self.suffix, self.kinds):
            if rule.word is not None and rule.word not in self.text:
                continue
            for m in pattern.finditer(self.text):
                value = {f: m[at] if isinstance(at, int) else at for f, at in rule.fields.items()}
                at = m.start(next((v for v in rule.fields.values() if isinstance(v, int) and m[v] is not None), 0))
                self._rule(rule, at, value)
        if self.lang in _CALLS and self.asked(*_OF_CALLS):
            calls = _CALLS[self.lang] if self.lang != "go" or self.asked("route", "group", "mount") else _GO_REQUESTS
            for m in calls.finditer(self.text):
                getattr(self, f"_{self.lang}")(m)
        if self.suffix == "java":
            if "@" in self.text and self.asked("controller", "route", "request", "consume", "page", "define"):
                self._annotations()
            for m in _CALL.finditer(self.text) if self.asked("call") else []:
                self.add(m.start(), "call", argument=m[1], name=m[2])
        if self.lang == "js" and self.asked("imported", "exported", "handler", "rewrite"):
            self._modules()
        self.define()
        self.facts.sort(key=lambda f: f["at"])
        return self.facts

    def _rule(self, rule: Rule, at: int, value: dict) -> None:
        if rule.kind == "import" and self.suffix == "py" and "," in value["name"] + ",":
            for name in value["name"].split(","):
                if name.strip():
                    self.add(at, "import", name=name.split()[0])
            return
        if rule.kind == "import" and self.suffix == "go":
            if self.places.around(at, "function") is None:
                self.add(at, "import", **value)
            return
        if "method" in value:
            value["method"] = value["method"].upper()
        if rule.kind == "system" and self.suffix != "java":
            value["name"] = value["name"].lower()
        if rule.kind == "route":
            nearest = self.places.after(at, "function")
            value["handler"] = nearest.member if nearest else None
        if rule.kind == "action":
            end, outer = self.closing(self.text.index("(", at)), self.guards[self.places.line(at) - 1]
            value["effects"] = [self._effect(m, outer) for m in _EFFECT.finditer(self.text, self.text.index("(", at), end)]
        self.add(at, rule.kind, **value)

    def _effect(self, m: re.Match, outer: str | None) -> str:
        """An effect with the conditions that it has within its listener."""
        condition, did = self.guards[self.places.line(m.start()) - 1], " ".join(m[1].split())
        condition = condition.removeprefix(outer).removeprefix(" and ") if condition and outer else condition
        return f"if {condition}: {did}" if condition else did

    def _arguments(self, m: re.Match) -> list[str]:
        return source.split_top(self.text[m.end() : self.closing(m.end() - 1)], ",")

    def _receiver(self, dot: int) -> str:
        """The name before a call's dot, also as a call of its own without arguments."""
        while dot and self.text[dot - 1].isspace():
            dot -= 1
        end = dot = dot - 2 if self.text.endswith("()", 0, dot) else dot
        while dot and (self.text[dot - 1].isalnum() or self.text[dot - 1] == "_"):
            dot -= 1
        return self.text[dot:end]

    def _java(self, m: re.Match) -> None:
        name = m[1]
        kind = "binding" if m[3] else "publish" if name in ("send", "convertAndSend") else "start" if name and name.startswith("start") else "request"
        if not self.asked(kind):
            return
        args, at = self._arguments(m), m.start(1) if name else m.start()
        if m[2]:
            self.add(at, "request", args[0], method=m[2].upper())
        elif m[3]:
            if rest := re.compile(r"(?s)\)[^;]*?\.with\(").match(self.text, self.closing(m.end() - 1)):
                key = self.text[rest.end() : self.closing(rest.end() - 1)]
                self.add(at, "binding", key, re.sub(r"\(\)$", "", args[0]))
        elif name == "exchange":
            if len(args) > 1 and (verb := re.search(r"HttpMethod\.(\w+)", args[1])):
                self.add(at, "request", args[0], method=verb[1])
        elif name == "delete":
            if self._receiver(m.start()) in ("restTemplate", "rest", "client"):
                self.add(at, "request", args[0], method="DELETE")
        elif name == "send":
            if broker := {"kafkaTemplate": "kafka", "streamBridge": "stream"}.get(self._receiver(m.start())):
                self.add(at, "publish", args[0], detail=broker)
        elif name == "convertAndSend":
            broker = {"rabbitTemplate": "rabbitmq", "jmsTemplate": "jms", "redisTemplate": "redis", "stringRedisTemplate": "redis"}.get(self._receiver(m.start()))
            if broker:
                self.add(at, "publish", args[1] if broker == "rabbitmq" and len(args) > 2 else args[0], detail=broker)
        elif name.startswith("startProcess"):
            self.add(at, "start", args[0])
        else:
            self.add(at, "request", args[0], method=re.match("get|post|patch", name)[0].upper())

    def _js(self, m: re.Match) -> None:
        if not self.asked(*("request",) if m[1] else ("client",) if m[4] else ("route", "request", "perhaps")):
            return
        args = self._arguments(m)
        if m[1]:
            verb = re.search(r"\bmethod\s*:\s*[\x22\x27`](\w+)", ",".join(args[1:]))
            self.add(m.start(), "request", args[0], method=verb[1].upper() if verb else "GET")
        elif m[4]:
            if base := re.search(r"\bbaseURL\s*:\s*" + _QUOTED, args[0]):
                self.add(m.start(4), "client", name=m[4], url=base[1])
        elif m[2] in ("router", "app"):
            if route := re.fullmatch(_QUOTED, args[0]):
                self.add(m.start(), "route", method=m[3].upper(), url=route[1], name=args[-1] if len(args) > 1 and re.fullmatch(r"\w+", args[-1]) else None)
        elif args[0][:1] in ("'", '"', "`"):
            self.add(m.start(), "request" if m[2] in ("axios", "api", "client", "http") else "perhaps", args[0], argument=m[2], method=m[3].upper())

    def _go(self, m: re.Match) -> None:
        if not self.asked("request" if m[1] else "route" if m[2] else "group" if m[4] else "mount"):
            return
        args = self._arguments(m)
        if m[1]:
            if m[1].startswith("New"):
                args = args[1:] if m[1].endswith("Context") else args
                verb = re.fullmatch(r"(?:\x22(\w+)\x22|http\.Method(\w+))", args[0]) if args else None
                if verb and len(args) > 1:
                    self.add(m.start(), "request", args[1], method=(verb[1] or verb[2]).upper())
            else:
                self.add(m.start(), "request", args[0], method=m[1].upper())
        elif m[2]:
            if route := re.fullmatch(_QUOTED, args[0]):
                handler = re.search(r"(\w+)$", args[-1]) if len(args) > 1 else None
                self.add(m.start(2), "route", method=m[3], url=route[1], argument=m[2], name=handler[1] if handler else None)
        elif m[4]:
            if path := re.fullmatch(_QUOTED, args[0]):
                self.add(m.start(4), "group", name=m[4], argument=m[5], url=path[1])
        elif m[7] not in ("func", "if", "for", "switch", "return") and self.places.around(m.start(), "function") is not None and args[0]:
            for i, arg in enumerate(args):
                if re.fullmatch(r"[a-z]\w*", arg):
                    self.add(m.start(), "mount", name=m[7], detail=m[6], argument=arg, method=str(i))

    def _py(self, m: re.Match) -> None:
        self.add(m.start(), "request", self._arguments(m)[0], method=m[1].upper())

    def _annotations(self) -> None:
        found = []
        for m in _ANNOTATION.finditer(self.text):
            end = self.closing(m.end() - 1) if m[2] else m.end()
            inner = self.text[m.end() : end] if m[2] else ""
            found.append((m.start(), m[1], inner, self.places.after(m.start())))
        bases, clients, rests = {}, {}, set()
        for _, name, inner, target in found:
            if target is not None and target.kind == "class":
                if name == "RequestMapping":
                    bases[target.at] = self._texts(inner, ("value", "path")) or [""]
                elif name == "FeignClient":
                    clients[target.at] = (self._texts(inner, ("name", "value")) or [""])[0]
                elif name in ("RestController", "Controller"):
                    rests.add(target.at)
        for s in self.places.scopes:
            if s.kind == "class" and (s.at in rests or s.at in bases) and s.at not in clients:
                for base in bases.get(s.at, [""]):
                    self.add(s.at, "controller", name=s.name, url=_slashed(base))
        for at, name, inner, target in found:
            if name in _MAPPINGS and target is not None and target.kind == "function":
                owner = self.places.around(target.at, "class")
                verbs = [_MAPPINGS[name]] if _MAPPINGS[name] else re.findall(r"RequestMethod\.(\w+)", inner) or ["ANY"]
                own = owner.at if owner else -1
                for base in bases.get(own, [""]):
                    for path in self._texts(inner, ("value", "path")) or [""]:
                        for verb in verbs:
                            url = _slashed(f"{base.rstrip('/')}/{path.lstrip('/')}" if path else base)
                            kind = {"kind": "request"} if own in clients else {"kind": "route", "handler": target.member}
                            self.add(at, method=verb, url=url, **kind)
            elif name in _LISTENERS and target is not None:
                key, broker = _LISTENERS[name]
                written = self._attribute(inner, key)
                for one in source.split_top(written.strip().strip("{}"), ",") if written else []:
                    self.add(at, "consume", one, detail=broker, listener=target.member)
            elif name == "Value":
                default, target = re.search(r"\x22\$\{[^:}\x22]+:([^}\x22]*)\}\x22", inner), re.compile(r"\)?\s*(?:(?:private|protected|public|final|static)\s+)*[\w.<>]+\s+(\w+)\s*[;,)=]").match(self.text, self.closing(self.text.find("(", at)))
                owner = self.places.around(at, "class")
                if default and target:
                    key = f"{self.path}::{owner.name if owner else ''}#{target[1]}"
                    terms = [{"kind": "text", "text": default[1], "at": 0}]
                    self.facts.append({"at": at, "line": self.places.line(at), "kind": "define", "key": key, "terms": terms})
                    self.injected.setdefault(key, []).append((at, 0, terms))
                    for fact in self.facts:  # a use that came before its definition was known
                        for term in [*fact.get("terms", []), *fact.get("other", [])]:
                            if term["kind"] == "open" and term["text"] == target[1] and self.places.around(fact["at"], "class") is owner:
                                term.update(kind="ref", text=key, at=ANYWHERE)
            elif name in ("Route", "SpringView"):
                written = self._attribute(inner, "name" if name == "SpringView" else "value")
                if written:
                    self.add(at, "page", written)

    def _attribute(self, inner: str, key: str) -> str:
        """The text of an annotation's attribute, or of its only value."""
        for part in source.split_top(inner, ","):
            if m := re.match(r"(\w+)\s*=(?!=)\s*", part):
                if m[1] == key:
                    return part[m.end() :]
            elif part:
                return part
        return ""

    def _texts(self, inner: str, keys: tuple) -> list[str]:
        """The quoted texts of an attribute, placeholders by their defaults."""
        for key in keys:
            if written := self._attribute(inner, key):
                return [_PLACEHOLDER.sub(r"\1", x) for x in re.findall(r"\x22([^\x22\n]*)\x22", written)]
        return []

    def _modules(self) -> None:
        """Names that a module takes from others (imported) and gives to others (exported), handlers given by one name, and rewrites."""
        module = r"\s*from\s*" + _QUOTED
        names = lambda text: [(a, b or a) for a, b in re.findall(r"([\w$]+)(?:\s+as\s+([\w$]+))?", text)]
        for m in re.finditer(r"(?m)^[ \t]*import\s+(?:type\s+)?(?:([\w$]+)\s*,?\s*)?(?:\{([^}]*)\})?" + module, self.text):
            for given, local in [*([("default", m[1])] if m[1] else []), *names(m[2] or "")]:
                self.add(m.start(), "imported", name=local, argument=given, detail=m[3])
        for m in re.finditer(r"(?m)^[ \t]*export\s*\{([^}]*)\}(?:" + module + ")?", self.text):
            for local, given in names(m[1]):
                self.add(m.start(), "exported", name=given, argument=local, detail=m[2])
        for m in re.finditer(r"(?m)^[ \t]*export\s+(?:(default)\s+(?:async\s+)?(?:function\s+)?|(?:const|let|var|function|async\s+function|class)\s+)([\w$]+)", self.text):
            self.add(m.start(), "exported", name=m[1] or m[2], argument=m[2])
        for m in re.finditer(r"(?m)^[ \t]*export\s+const\s*\{([^}]*)\}\s*=", self.text):
            for _, given in names(m[1]):
                if given in ("GET", "POST", "PUT", "PATCH", "DELETE"):
                    self.add(m.start(), "handler", method=given, detail="given")
        for m in re.finditer(r"\bsource\s*:\s*" + _QUOTED + r"\s*,\s*destination\s*:\s*" + _QUOTED, self.text):
            name = re.match(r"\$\{(?:process\.env\.)?(\w+)\}", m[2])
            known = re.search(rf"\b{name[1]}\s*=\s*process\.env\.(\w+)", self.text) if name else None
            self.add(m.start(), "rewrite", url=m[1], detail=known[1] if known else name[1] if name else re.sub(r"^https?://([^/]*).*$", r"\1", m[2]))


@cache
def _rules(suffix: str, kinds: frozenset[str] | None) -> list[tuple]:
    return [(rule, pattern) for rule, pattern in _BY_SUFFIX.get(suffix, []) if kinds is None or rule.kind in kinds]


def _broken(content: str) -> tuple[int, str] | None:
    """Line and kind of what makes a Python text no program, or None."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(content)
    except SyntaxError as error:
        return max(1, error.lineno or 1), type(error).__name__
    except (ValueError, RecursionError, MemoryError) as error:
        return 1, type(error).__name__
    return None


def _until_sure(places: list) -> Iterator[tuple]:
    """Definitions up to the next that is not passed by."""
    for p in places:
        if not p[2]:
            return
        yield p


def _slashed(path: str) -> str:
    return path if path.startswith("/") else "/" + path


def _scan(batches: Iterator[pa.RecordBatch], kinds: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[dict] = []
        for file in batch.to_pylist():
            content = file.pop("content")
            rows += [{**file, "n": n, **fact} for n, fact in enumerate(_facts(file, content, kinds))]
            if len(rows) >= MOST_ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _facts(file: dict, content: str, kinds: frozenset[str] | None) -> list[dict]:
    """The facts of one file. What is made for it holds no cycles, so no search for them interrupts it."""
    gc.disable()
    try:
        return _File(file["path"], file["suffix"], content, kinds).scan()
    finally:
        gc.enable()


def facts(files: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """Facts of files (repo, path, content): repo, path, file_id, line, kind, method, name, url, path_form, system, detail, scope, member, handler, function, argument, condition, listener, and n, suffix, at, key, effects, terms, other, known, other_known.

    line counts from 1, n tells the facts of a file apart, in its order, at is the place in its text. path_form is the normal form of url; url has no
    user names, passwords or query; system is its host and port. scope tells tests from what runs. member is the name of a
    class or function within its file: that of its owner before it, and the types of its parameters after it in Java.
    handler is the member that a route's annotation or decorator stands before. function is the member whose block a
    place stands in, argument a name, condition what a Java line depends on, listener the method that a consumer's
    annotation stands before. A Spring route has its class's base path before its own, one row for each path and method (ANY
    where none is named); in a Feign client it is a request. terms are what an expression is made of, where its value is
    not one text (`resolved` finds it); known and other_known are all values of terms and other, where the definitions of the own file
    say them; key names what a definition defines. A Python text that is no program has one fact, of kind error; `errors` lists them. Null
    contents have no facts. With `kinds` the other kinds are neither looked for nor returned, and n counts the rest; definitions
    are of kinds define and constant.
    """
    worker_path(files.sparkSession)
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    test = F.col("path").rlike(r"(?:^|/)(?:tests?|__tests__)/|(?:^|/)test_[^/]*$|_test\.go$|\.(?:test|spec)\.[jt]sx?$|Test\.java$")
    rows = files.where(F.col("content").isNotNull()).select("repo", "path", suffix.alias("suffix"), F.when(test, "test").otherwise("runtime").alias("scope"), "content")
    found = rows.mapInArrow(partial(_scan, kinds=None if kinds is None else frozenset(kinds)), SCHEMA)
    # An expression that is one text is that text; others stay open.
    one = F.when((F.size("terms") == 1) & (F.get("terms", F.lit(0))["kind"] == "text"), F.get("terms", F.lit(0))["text"])
    asked = F.col("kind").isin("request", "perhaps")
    return _addressed(found.withColumns({
        "url": F.when(asked, F.coalesce("url", one)).when((F.col("suffix") == "go") & F.col("kind").isin("route", "group"), F.coalesce("url", F.lit(""))).otherwise(F.col("url")),
        "name": F.when(F.col("kind").isin("publish", "consume", "binding", "start", "page"), F.coalesce("name", one)).otherwise(F.col("name")),
        "handler": F.when((F.col("kind") == "route") & ~F.col("suffix").isin("py", "java"), F.col("name")).otherwise(F.col("handler"))}))


def _addressed(rows: DataFrame, system=None) -> DataFrame:
    """Facts with file_id, safe url, path_form and system."""
    host = F.coalesce(urls.system(F.col("url")), F.lit(""))
    return rows.select(
        "repo", "path", identity.file_id(F.col("repo"), F.col("path")).alias("file_id"), "line", "kind", "method", "name", urls.sanitize_url(F.col("url")).alias("url"), urls.normalize_url(F.col("url")).alias("path_form"),
        (host if system is None else F.when(host == "", F.coalesce(system, F.lit(""))).otherwise(host)).alias("system"), "detail", "scope", "member", "handler", "function", "argument", "condition", "listener", "n", "suffix", "at", "key", "effects", "terms", "other", "known", "other_known")


def resolved(facts: DataFrame) -> DataFrame:
    """`facts` with open values found: URLs, channels, process keys and pages by what their names stand for, Gin routes by the groups that they are mounted under, Axios calls by their client, rewritten paths by their system.

    A use whose name may stand for several texts has a row for each; one whose value is not known keeps null. Facts that
    only serve this (definitions, imported names, mounts) are left as they are.
    """
    from lodemap.operators import clients, mounts, values

    rows = values.filled(facts)
    rows = mounts.mounted(rows)
    return clients.configured(rows)


def errors(facts: DataFrame) -> DataFrame:
    """(repo, path, line, error) of files that could not be read as programs, in order of repository and path."""
    return facts.where("kind = 'error'").select("repo", "path", "line", F.col("name").alias("error")).orderBy("repo", "path")


def app_routes(files: DataFrame, handlers: DataFrame) -> DataFrame:
    """(repo, path, method, route_path, path_form) of handlers exported by route files of an app folder."""
    inner = F.regexp_extract("path", r"(?:^|/)app/(api(?:/.*)?)/route\.[jt]s$", 1)
    return handlers.where((F.col("kind") == "handler") & (inner != "")).select(
        "repo", "path", "method", F.concat(F.lit("/"), inner).alias("route_path"), urls.normalize_url(F.concat(F.lit("/"), inner)).alias("path_form"))


_STEPS = "array<struct<step:string,delegate:string,called:string>>"
_FLOWS = "array<struct<flow:string,source:string,target:string,condition:string,is_default:boolean>>"
_STEP = re.compile(r"startEvent|endEvent|callActivity|.*Task.*|.*Gateway.*")


def _process(content: str) -> dict:
    """The id of a process's text, its steps and its flows; those before the place where it is broken, if it is."""
    process, steps, flows, delegates, called, defaults = None, [], [], {}, {}, set()
    opened: list[tuple[str, dict]] = []

    def start(tag: str, given: dict) -> None:
        nonlocal process
        name, own = tag.rsplit(":", 1)[-1], given.get("id")
        opened.append((name, {}))
        if name == "process":
            process = own if process is None else process
        if "default" in given:
            defaults.add(given["default"])
        if own is not None:
            if (delegate := next((v for k, v in given.items() if k.rsplit(":", 1)[-1] == "delegateExpression"), None)) is not None:
                delegates.setdefault(own, delegate)
            if "calledElement" in given:
                called.setdefault(own, given["calledElement"])
            if _STEP.fullmatch(name):
                steps.append(own)
        if name == "sequenceFlow":
            flows.append({"flow": own, "source": given.get("sourceRef"), "target": given.get("targetRef")})
            opened[-1] = (name, flows[-1])

    def text(data: str) -> None:
        if len(opened) > 1 and opened[-1][0] == "conditionExpression" and opened[-2][0] == "sequenceFlow":
            flow = opened[-2][1]
            flow["condition"] = flow.get("condition", "") + data

    parser = expat.ParserCreate()
    parser.buffer_text, parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = True, start, text, lambda _: opened.pop()
    try:
        parser.Parse(content, True)
    except expat.ExpatError:
        pass
    for flow in flows:
        flow["is_default"] = None if flow["flow"] is None else flow["flow"] in defaults
    return {"process": process, "steps": [{"step": s, "delegate": delegates.get(s), "called": called.get(s)} for s in steps], "flows": flows}


_PROCESSES = pa.schema([*[(c, pa.string()) for c in ("repo", "path", "process")], ("steps", pa.list_(pa.struct([(c, pa.string()) for c in ("step", "delegate", "called")]))),
                        ("flows", pa.list_(pa.struct([*[(c, pa.string()) for c in ("flow", "source", "target", "condition")], ("is_default", pa.bool_())])))])


def _processes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([{**row, **_process(row.pop("content"))} for row in batch.to_pylist()], schema=_PROCESSES)


def workflow(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps and flows of BPMN files, in document order.

    Steps (repo, path, process, ordinal, step, delegate, called), flows (repo, path, process, flow, source, target,
    condition, is_default). A file may have several processes; ordinals count within one. A process is read once, whatever
    is asked of it, and written to the shared folder; of one that is broken XML what stands before the break is kept.
    """
    body = F.regexp_extract_all("content", F.lit(r"(?s)(<(?:\w+:)?process\b.*?</(?:\w+:)?process>)"), 1)
    models = files.where(F.col("path").rlike(r"\.bpmn(?:20\.xml)?$")).select("repo", "path", F.explode(body).alias("content"))
    worker_path(files.sparkSession)
    read = shared(models.mapInArrow(_processes, f"repo string, path string, process string, steps {_STEPS}, flows {_FLOWS}"))
    steps = read.select("repo", "path", "process", F.posexplode("steps").alias("ordinal", "s"))
    steps = steps.select("repo", "path", "process", "ordinal", "s.step", F.regexp_replace("s.delegate", r"^[$#]\{|\}$", "").alias("delegate"), "s.called")
    flows = read.select("repo", "path", "process", F.explode("flows").alias("f")).select("repo", "path", "process", "f.flow", "f.source", "f.target", F.trim("f.condition").alias("condition"), "f.is_default")
    return steps, flows
