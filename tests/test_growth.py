"""Steps whose cost must grow no faster than their input."""

import time

from pyspark.sql import functions as F

from lodemap.operators import closure, controllers, decisions, extract, incremental, mounts, relations, resolve, traverse, values
from lodemap.plans import catalog, code  # noqa: F401  the catalogue comes first
from lodemap.sources import tables


def test_long_runs_of_blanks_are_looked_at_once():
    text = "class A {\n  void go() {\n    /*" + "x" * 3_000 + "*/\n    String url = a  /*" + "x" * 3_000 + "*/ + b;\n    go(url);\n  }\n}\n"
    began = time.perf_counter()
    file = extract._File("A.java", "java", text)
    assert [name for name in file.definitions] == [("A.go()", "url")]
    assert time.perf_counter() - began < 2


def test_definitions_are_found_in_all_their_forms():
    text = "class A {\n  @Value(\"a\") private static final Map<String, int[]> m = x;\n  int a = 1; final int b = 2;\n  A(int p) { this.p = p;\n    \t\n    q = 3; if (a == b) { c = 4; }\n  }\n}\n"
    found = extract._File("A.java", "java", text).definitions
    assert sorted(found) == sorted([("A", "m"), ("A", "a"), ("A", "b"), ("A", "p"), ("A.A(int)", "q"), ("A.A(int)", "c")])


def test_kinds_are_those_of_all_facts(spark):
    files = None
    for path, text in [(p.replace("<k>", "1"), c.replace("<k>", "1").replace("‹", "<").replace("›", ">")) for p, c in [*code.ROUTES, *code.REQUESTS]]:
        one = spark.createDataFrame([("r", path, text)], "repo string, path string, content string")
        files = one if files is None else files.unionByName(one)
    every = extract.facts(files).drop("n").cache()
    for kinds in (mounts.KINDS, controllers.KINDS, [*values.URLS, *values.DEFINITIONS], ["action", "page"], ["call", "field"], ["host", "system", "error"], ["imported", "exported"]):
        got = extract.facts(files, kinds).drop("n")
        want = every.where(F.col("kind").isin(*kinds))
        if "define" not in kinds:
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        else:  # definitions that only facts of other kinds need are left out
            assert got.exceptAll(want).isEmpty() and want.where("kind <> 'define'").exceptAll(got).isEmpty()


def test_documents_of_processes_are_read_once(spark, data):
    files = code._models(spark, data)
    plan = relations.workflow(extract.facts(files, ["class", "package"]), *extract.workflow(files))._jdf.queryExecution().optimizedPlan().toString()
    assert "='startEvent'" not in plan


def test_one_answer_where_the_smallest_candidate_is_the_largest(spark):
    names = spark.createDataFrame([("k", "a", "1"), ("k", "a", "1"), ("k", "b", "2"), ("k", "b", "3"), ("m", "b", "4"), ("z", "a", None), ("z", "b", "5")], "key string, repo string, id string")
    asked = spark.createDataFrame([("s1", "a", "k"), ("s2", "b", "k"), ("s3", "c", "k"), ("s4", "c", "m"), ("s5", "a", "z"), ("s6", "b", "z"), ("s7", "a", None)], "src string, repo string, key string")
    found = {r.src: r.target for r in relations.unique_target(asked, names).collect()}
    assert found == {"s1": "1", "s2": None, "s3": None, "s4": "4", "s5": None, "s6": "5", "s7": None}


def test_composed_carries_no_passed_nodes_without_a_cycle(spark, monkeypatch):
    rounds, keep = [], closure.shared
    monkeypatch.setattr(closure, "shared", lambda df: rounds.append(keep(df)) or rounds[-1])
    edges = [(f"n{i // 2}", f"n{i}", f"/{i}") for i in range(2, 64)] + [("n1", "n2", ""), ("n1", "n3", "/2")]
    found = closure.composed(spark.createDataFrame([("n1", "")], "node string, label string"), spark.createDataFrame(edges, "src string, dst string, label string"))
    assert found.where("node = 'n5'").count() == 2 and found.where("node = 'n7'").count() == 2 and found.count() == 63 + 62
    carried = [r for r in rounds if "passed" in r.columns]
    assert carried and all(r.where("size(passed) > 0").isEmpty() for r in carried)


def test_composed_ends_on_cycles_and_returns_what_is_wanted(spark):
    edges = [("a", "b", "1"), ("b", "c", "2"), ("c", "b", "3"), ("c", "d", "4"), ("d", "a", "5"), ("d", "e", "6"), ("e", "f", "7")]
    starts, links = spark.createDataFrame([("a", "")], "node string, label string"), spark.createDataFrame(edges, "src string, dst string, label string")
    every = {tuple(r) for r in closure.composed(starts, links).collect()}
    assert every == {("a", ""), ("b", "1"), ("c", "12"), ("d", "124"), ("e", "1246"), ("f", "12467")}
    wanted = spark.createDataFrame([("c",), ("f",), ("x",), ("f",)], "node string")
    assert {tuple(r) for r in closure.composed(starts, links, wanted).collect()} == {("c", "12"), ("f", "12467")}


def test_unique_candidates_are_not_told_apart(spark, data, monkeypatch):
    pairs = spark.createDataFrame([("s", "1", "a", "b"), ("s", "1", "a", "c"), ("t", "1", "a", "a"), ("t", "2", "a", "b"), ("u", "1", "a", "a"), ("u", "2", "a", "a"), ("v", "1", "a", "b"), ("v", "2", "a", "b"), ("w", None, "a", "a"), ("x", "3", None, "a")], "src string, cand string, src_repo string, cand_repo string")
    found = resolve.unique_candidate(pairs)
    assert "Expand" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.src: r.target for r in found.collect()} == {"s": "1", "t": "1", "u": None, "v": None, "w": None, "x": "3"}
    monkeypatch.setattr(traverse, "TASK_ROWS", 500)
    lines = tables.read(spark, data, "lineitem").count()
    assert f"{-(-lines // 500)}" in tables.supplier_pairs(spark, data)._jdf.queryExecution().optimizedPlan().toString()


def test_chains_are_joined_in_parts_by_their_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(1, 60)] + [(100, 101), (101, 100)], "id long, supersedes long")
    want = sorted(tuple(r) for r in decisions.chains(rows).collect())
    monkeypatch.setattr(traverse, "TASK_ROWS", 5)
    found = decisions.chains(rows)
    assert "RepartitionByExpression [id" in found._jdf.queryExecution().optimizedPlan().toString() and "], 13" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == want
    assert (9, 0, 9, True) in want and (100, None, None, False) in want


def test_values_by_definitions_of_the_own_file_are_not_moved(spark):
    java = 'class K {\n  static final String A = "/a";\n  static final String B = A + "/b";\n}\nclass U {\n  String base = "/u";\n  void go(String id) {\n    String x = base;\n    if (id.isEmpty()) { x = base + "/e"; }\n    rest.getForObject(x + "/" + id, T.class);\n  }\n}\n'
    own = spark.createDataFrame([("r", "K.java", java)], "repo string, path string, content string")
    facts = extract.facts(own, [*values.URLS, *values.DEFINITIONS]).cache()
    found = values.filled(facts)
    assert sorted(r.path_form for r in found.where("kind = 'request'").collect()) == ["/u/e/{param}", "/u/{param}"]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and facts.where("kind = 'define' and key like '%#x%'").isEmpty()
    other = own.unionByName(spark.createDataFrame([("r", "V.java", 'class V {\n  String z = K.B;\n  void go() { rest.delete(z); rest.delete(K.A); }\n}\n')], own.schema))
    found = values.filled(extract.facts(other, [*values.URLS, *values.DEFINITIONS]))
    assert sorted(r.path_form for r in found.where("kind = 'request' and path = 'V.java'").collect()) == ["/a", "/a/b"]


def test_a_value_of_many_replacements_is_followed_by_joins():
    text = "class A {\n  void go() {\n" + "".join(f'    String v{i} = "a";\n    if (x) {{ v{i} = "b"; }}\n' for i in range(9)) + "    rest.delete(" + " + ".join(f"v{i}" for i in range(9)) + ");\n  }\n}\n"
    found = extract._File("A.java", "java", text, frozenset([*values.URLS, *values.DEFINITIONS])).scan()
    assert [f.get("known") for f in found if f["kind"] == "request"] == [None] and sum(f["kind"] == "define" for f in found) == 18


def test_links_move_a_reference_once_and_cut_their_parts(spark, tmp_path):
    links = incremental.Links(spark, str(tmp_path), parts=2)
    referred = spark.createDataFrame([(f"f{i}", "a", f"K{i % 7}", f"s{i}") for i in range(400)] + [("n", "a", "K1", None), ("n", None, "K1", "s")], "file string, repo string, key string, src string")
    declared = spark.createDataFrame([("d1", "a", "K1", "c1"), ("d2", "b", "K2", "c2"), ("d3", "a", "K3", "c3"), ("d4", "a", "K3", "c4")], "file string, repo string, key string, id string")
    links.build(declared, referred)
    found = links.links()
    assert {(r.key, r.target) for r in found.collect()} == {("K1", "c1"), ("K2", "c2")}
    assert found.count() == sum(i % 7 in (1, 2) for i in range(400))
    asked = links._read("referred", incremental.REFERRED)
    plan = links._found(links._read("declared", incremental.DECLARED), asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3  # references once, declarations for each repository and for all
