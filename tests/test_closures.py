"""Closures, incremental links, typed paths and search, by brute force on small inputs."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodemap.operators import clients, closure, incremental, paths, postings
from lodemap.sources import tables


def test_roots_of_chains_forks_and_cycles(spark):
    links = {f"n{i}": f"n{i - 1}" for i in range(1, 40)} | {"a": "b", "b": "c", "c": "a", "into": "a", "fork1": "n7", "fork2": "n7", "self": "self", "alone": None}
    df = spark.createDataFrame([*links.items(), *links.items(), (None, "n1")], "node string, next string")
    want = {f"n{i}": ("n0", i) for i in range(40)} | {x: (None, None) for x in ("a", "b", "c", "into", "self")} | {"fork1": ("n0", 8), "fork2": ("n0", 8), "alone": ("alone", 0)}
    assert {r.node: (r.root, r.depth) for r in closure.roots(df).collect()} == want
    assert closure.roots(df.limit(0)).count() == 0


def test_composed_labels_end_at_cycles(spark):
    edges = [("a", "b", "/1"), ("a", "b", "/2"), ("b", "c", "/3"), ("c", "b", "/x"), ("c", "d", None), ("d", "a", "/y"), (None, "b", "/z")]
    got = {tuple(r) for r in closure.composed(spark.createDataFrame([("a", ""), ("a", None)], "node string, label string"), spark.createDataFrame(edges + edges, "src string, dst string, label string")).collect()}
    assert got == {("a", ""), ("b", "/1"), ("b", "/2"), ("c", "/1/3"), ("c", "/2/3"), ("d", "/1/3"), ("d", "/2/3")}


def test_longest_prefix_of_whole_parts(spark):
    rules = [("r", "/a", 2, "a"), ("r", "/a/b", 3, "late"), ("r", "/a/b/", 1, "first"), ("r", "", 9, "all"), ("s", "/a", 1, "s"), ("r", None, 1, "null")]
    asked = [(1, "r", "/a/b"), (2, "r", "/a/bc"), (3, "r", "/x"), (4, "s", "/ab"), (5, "s", "/a/?q=/b"), (6, "r", None), (7, "q", "/a")]
    got = {r.id: (r.prefix, r.target) for r in clients.longest_prefix(spark.createDataFrame(asked, "id int, repo string, path string"), spark.createDataFrame(rules, "repo string, prefix string, place int, target string")).collect()}
    assert got == {1: ("/a/b", "first"), 2: ("/a", "a"), 3: ("", "all"), 5: ("/a", "s")}


def frames(spark, declared, referred):
    return spark.createDataFrame(sorted(declared), "file string, repo string, key string, id string"), spark.createDataFrame(sorted(referred), "file string, repo string, key string, src string")


def stored(links):
    return {(r.file, r.repo, r.key, r.src, r.target, r.managed_by) for r in links.links().collect()}


def test_changes_equal_a_full_build_and_leave_other_parts(spark, tmp_path):
    rng = random.Random(4)
    row = lambda kind, f: (f"f{f}", rng.choice("rs"), f"k{rng.randrange(12)}", f"{kind}{rng.randrange(1000)}")
    declared, referred = {row("d", rng.randrange(20)) for _ in range(25)}, {row("u", rng.randrange(20)) for _ in range(60)}
    manual = ("f3", "r", "k1", "u1", "somewhere", "user")
    links = incremental.Links(spark, str(tmp_path / "links"), parts=32)
    links.build(*frames(spark, declared, referred), spark.createDataFrame([manual], "file string, repo string, key string, src string, target string, managed_by string"))
    for n in range(3):
        gone = {f"f{rng.randrange(24)}" for _ in range(2)}
        new_d, new_u = {row("n", int(f[1:])) for f in gone if n}, {row("v", int(f[1:])) for f in gone}
        declared, referred = ({x for x in old if x[0] not in gone} | new for old, new in ((declared, new_d), (referred, new_u)))
        before = {p: p.stat().st_mtime_ns for p in Path(tmp_path / "links" / "links").glob("part=*/*.parquet")}
        fresh = frames(spark, new_d or {("x", "x", "x", "x")}, new_u)
        parts = links.apply(spark.createDataFrame([(g,) for g in gone], "file string"), fresh[0].where("file <> 'x'"), fresh[1])
        full = incremental.Links(spark, str(tmp_path / f"full{n}"), parts=32)
        full.build(*frames(spark, declared, referred))
        assert stored(links) == stored(full) | {manual}
        kept = {p for p in before if int(p.parent.name.split("=")[1]) not in parts["links"]}
        assert kept and all(p.exists() and p.stat().st_mtime_ns == before[p] for p in kept)
    empty = frames(spark, {("x", "x", "x", "x")}, {("x", "x", "x", "x")})
    assert links.apply(spark.createDataFrame([], "file string"), empty[0].limit(0), empty[1].limit(0)) == {"keys": [], "links": []}


def test_a_new_scan_of_one_repository_prunes_its_files_only(spark, tmp_path):
    declared, referred = {("a", "r", "k", "1"), ("b", "s", "j", "2")}, {("a", "r", "j", "x"), ("b", "s", "k", "y"), ("c", "r", "j", "z")}
    links = incremental.Links(spark, str(tmp_path / "links"), parts=4)
    links.build(*frames(spark, declared, referred))
    assert {(s[3], s[4]) for s in stored(links)} == {("x", "2"), ("y", "1"), ("z", "2")}
    links.replace_repository("r", *frames(spark, {("a", "r", "k", "new")}, {("a", "r", "j", "x")}))
    assert {(s[3], s[4]) for s in stored(links)} == {("x", "2"), ("y", "new")}


def test_a_diff_of_sources_equals_a_full_scan(spark, tmp_path):
    from lodemap.plans.build import import_links, sync

    code = lambda package, name, *wanted: f"package {package};\n" + "".join(f"import {w};\n" for w in wanted) + f"public class {name} {{}}\n"
    before = {"A.java": code("p", "A"), "B.java": code("p", "B", "p.A", "q.C"), "C.java": code("q", "C", "p.B"), "D.java": code("q", "D", "p.A", "p.E")}
    after = {"A.java": code("p", "E"), "moved/B.java": before["B.java"], "D.java": before["D.java"], "D2.java": before["D.java"], "F.java": code("p", "F", "q.D")}
    frame = lambda files: spark.createDataFrame([("r", p, x) for p, x in files.items()] + [("s", "X.java", code("z", "X", "p.A", "p.B"))], "repo string, path string, content string")
    links = import_links(frame(before), str(tmp_path / "links"), parts=8)
    diff = [("M", "A.java", None), ("R", "moved/B.java", "B.java"), ("D", "C.java", None), ("C", "D2.java", "D.java"), ("A", "F.java", None), ("M", "notes.md", None)]
    got = sync(links, spark.createDataFrame(diff, "status string, path string, old_path string"), frame(after), "r")
    assert {r.action: r.files for r in got.collect()} == {"read": 4, "drop": 2, "skip": 1}
    full = import_links(frame(after), str(tmp_path / "full"), parts=8)
    assert stored(links) == stored(full) and len(stored(full)) == 3
    assert not sync(links, spark.createDataFrame(diff[-1:], "status string, path string, old_path string"), frame(after), "r").where("action <> 'skip'").count()


def test_routes_and_requests_of_a_diff_equal_a_full_scan(spark, tmp_path):
    """A client in its own module gets another base path, routes come, go and move; a second repository declares the same paths."""
    from lodemap.plans.build import route_links, sync_routes

    client = lambda base: f'import axios from "axios";\nexport const api = axios.create({{ baseURL: "{base}" }});\n'
    page = 'import { api } from "./client";\nexport const load = () => api.get("/users");\nexport const own = () => fetch("/own");\n'
    route = lambda *paths: "from fastapi import FastAPI\napp = FastAPI()\n" + "".join(f'@app.get("{p}")\ndef r{i}(): pass\n' for i, p in enumerate(paths))
    other = [("s", "main.py", route("/v1/users", "/v2/users", "/own")), ("s", "use.ts", 'export const x = () => fetch("/v2/users");\n')]
    before = {"client.ts": client("/v1"), "page.ts": page, "a.py": route("/v1/users", "/gone"), "b.py": route("/own")}
    after = {"client.ts": client("/v2"), "page.ts": page, "moved/b.py": route("/own"), "c.py": route("/v2/users")}
    frame = lambda files: spark.createDataFrame([("r", p, x) for p, x in files.items()] + other, "repo string, path string, content string")
    ends = lambda links: {(r.src.split("::")[0], r.target) for r in links.links().collect()}
    links = route_links(frame(before), str(tmp_path / "links"), parts=2)
    first = {(a.split(":", 1)[-1], b) for a, b in ends(links)}
    assert first == {("page.ts", "r:GET:/v1/users"), ("page.ts", "s:GET:/v1/users"), ("page.ts", "r:GET:/own"), ("page.ts", "s:GET:/own"), ("use.ts", "s:GET:/v2/users")}
    diff = [("M", "client.ts", None), ("D", "a.py", None), ("R", "moved/b.py", "b.py"), ("A", "c.py", None), ("M", "notes.md", None)]
    got = sync_routes(links, spark.createDataFrame(diff, "status string, path string, old_path string"), frame(after), "r")
    assert {r.action: r.files for r in got.collect()} == {"read": 3, "drop": 2, "skip": 1}
    assert stored(links) == stored(route_links(frame(after), str(tmp_path / "full"), parts=2))
    assert {b for a, b in ends(links) if "page.ts" in a} == {f"{r}:GET:{p}" for r in "rs" for p in ("/v2/users", "/own")}


def test_changes_are_classified(spark):
    rows = [("M", "src/a.py", None), ("A", "b.go", None), ("D", "c.ts", None), ("R", "e.java", "d.java"), ("C", "g.java", "f.java"), ("M", "README.md", None), ("M", "vendor/x.go", None), ("D", "h.py", None), ("A", "h.py", None), ("M", None, None)]
    got = incremental.classified(spark.createDataFrame(rows, "status string, path string, old_path string"))
    assert {tuple(r) for r in got.collect()} == {("src/a.py", "read"), ("b.go", "read"), ("c.ts", "drop"), ("e.java", "read"), ("d.java", "drop"), ("g.java", "read"), ("README.md", "skip"), ("vendor/x.go", "skip"), ("vendor/x.go", "drop"), ("h.py", "read")}
    assert {r.action: r.files for r in incremental.outcome(got).collect()} == {"read": 5, "drop": 3, "skip": 2}


def test_typed_paths_of_a_process(spark):
    edges = [("p", "p1", "HAS_STEP"), ("p", "p2", "HAS_STEP"), ("p1", "p2", "NEXT"), ("p2", "p1", "NEXT"), ("p2", "C", "INVOKES"), ("p2", "q", "CALLS"), ("q", "q1", "HAS_STEP"), ("q1", "p", "CALLS"), ("p1", "D", "USES"), (None, "x", "NEXT"), ("p", "p1", "HAS_STEP")]
    df = spark.createDataFrame(edges, "src string, dst string, type string")
    got = {(r.node, r.state): (r.distance, r.path) for r in paths.written_out(paths.typed_paths(df, spark.createDataFrame([("p",), ("p",), (None,)], "node string"), paths.PROCESS, 9)).collect()}
    assert got == {("p", 0): (0, ""), ("p1", 1): (1, "HAS_STEP>p1"), ("p2", 1): (1, "HAS_STEP>p2"), ("C", 2): (2, "HAS_STEP>p2 INVOKES>C"), ("q", 0): (2, "HAS_STEP>p2 CALLS>q"), ("q1", 1): (3, "HAS_STEP>p2 CALLS>q HAS_STEP>q1")}
    back = {r.node for r in paths.typed_paths(df, spark.createDataFrame([("C",)], "node string"), [(0, "INVOKES", False, 1), (1, "HAS_STEP", False, 2)], 3).where("state = 2").collect()}
    assert back == {"p"}


def test_search_reads_the_parts_of_its_trigrams(spark, tmp_path):
    rng = random.Random(2)
    texts = {f"i{i}": "".join(rng.choice("abÄ") for _ in range(rng.randrange(9))) for i in range(300)} | {"null": None, "empty": ""}
    found = postings.Postings(spark, str(tmp_path / "p"), parts=8)
    found.build(spark.createDataFrame(list(texts.items()), "id string, text string"))
    terms = ["aba", "bÄab", "a", "ÄÄ", "zzz", "ABa", None]
    got = {tuple(r) for r in found.search(spark.createDataFrame([(x,) for x in terms], "term string")).collect()}
    assert got == {(x, i) for x in terms if x for i, text in texts.items() if text is not None and x.lower() in text.lower()}
