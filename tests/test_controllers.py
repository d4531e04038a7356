"""Routes that are not declared: inherited ones and JSON:API resources; records that users keep."""

from lodemap.operators import controllers, decisions, extract, services
from lodemap.plans.build import build

CONTROLLERS = {
    "shop/A.java": "package shop;\n@RestController\n@RequestMapping(\"${top:api}/a\")\nclass A\n    extends Middle<X, Long> {}\n",
    "shop/Middle.java": "package shop;\nabstract class Middle<T, I> extends base.Lower<T> {}\n",
    "base/Lower.java": "package base;\nimport org.lib.ReadOnlyJpaRestController;\npublic class Lower<T> extends ReadOnlyJpaRestController<T, Long> {}\n",
    "shop/B.java": "package shop;\nimport base.Middle;\n@RestController\n@RequestMapping({\"/b\", \"/old/b\"})\nclass B extends Middle {}\n",
    "base/Middle.java": "package base;\npublic class Middle extends com.lib.FlowController<T> {}\n",
    "shop/C.java": "package shop;\n@RestController\n@RequestMapping(\"/c\")\nclass C {\n  // extends FlowController<T>\n}\n",
    "shop/D.java": "package shop;\n@RestController\n@RequestMapping(\"/d\")\nclass D extends E {}\nclass E extends D {}\n",
    "shop/F.java": "package shop;\n@RestController\nclass F extends FilterJpaRestController<T> {}\n",
}


def facts(spark, files, repo="r"):
    return extract.facts(spark.createDataFrame([(repo, p, x) for p, x in files.items()], "repo string, path string, content string"))


def test_controllers_inherit_over_steps_packages_and_imports(spark):
    got = {(r.name, r.method, r.path_form) for r in controllers.inherited_routes(facts(spark, CONTROLLERS)).collect()}
    flow = [("GET", ""), ("GET", "/{param}"), ("POST", ""), ("POST", "/submit"), ("POST", "/update")]
    crud = [("GET", "/"), ("POST", "/"), *[(m, "/{param}") for m in ("GET", "PUT", "PATCH", "DELETE")]]
    assert got == {("A", "GET", "/api/a"), ("A", "GET", "/api/a/{param}"), *[("B", m, top + x) for m, x in flow for top in ("/b", "/old/b")], *[("F", m, p) for m, p in crud]}


def test_resources_need_a_prefix(spark):
    resource = {"Question.java": 'import x.JsonApiResource;\n@JsonApiResource(type = "questions")\npublic class Question {}\n// @JsonApiResource(type = "no")\n'}
    assert controllers.resource_routes(facts(spark, resource)).count() == 0
    rows = facts(spark, resource | {"app.properties": "crnk.pathPrefix=/japi/\n", "b.properties": "# katharsis.pathPrefix=/no\n"})
    want = {(m, "/japi/questions" + x) for m, x in (("GET", ""), ("POST", ""), ("GET", "/{param}"), ("PATCH", "/{param}"), ("DELETE", "/{param}"))}
    assert {(r.method, r.path_form) for r in controllers.resource_routes(rows).collect()} == want
    outside = spark.createDataFrame([("r", "v2"), ("s", "/no")], "repo string, url string")
    assert {(r.method, r.path_form) for r in controllers.resource_routes(facts(spark, resource), outside).collect()} == {(m, p.replace("/japi", "/v2")) for m, p in want}
    nodes, _ = build(spark.createDataFrame([("r", p, x) for p, x in (resource | {"app.properties": "crnk.pathPrefix=/japi\n"}).items()], "repo string, path string, content string"))
    assert "r:DELETE:/japi/questions/{param}" in {r.id for r in nodes.where("label = 'BackendRoute'").collect()}


def test_broken_files_are_rows_in_path_order(spark):
    rows = facts(spark, {"b.py": "def x(:\n", "a.py": "x = 1\n  y = 2\n", "c.py": "def fine(): pass\n", "d.py": "\x00", "e.py": ""})
    assert [(r.path, r.line, r.error) for r in extract.errors(rows).collect()] == [("a.py", 2, "IndentationError"), ("b.py", 1, "SyntaxError"), ("d.py", 1, "SyntaxError")]
    assert {r.member for r in rows.where("kind = 'function'").collect()} == {"fine"}


def test_services_take_the_last_change_and_keep_no_secrets(spark):
    schema = "repo string, key string, base_url string, path_prefix string, target_repo string"
    stored = spark.createDataFrame([("r", "a", "https://a", "", None), ("r", "b", "https://b/x", "/x", "t")], schema)
    changes = spark.createDataFrame([(1, "r", "a", "https://me:pw@h/api/?k=1", "t"), (2, "r", "b", "x", None), (3, "r", "b", None, None), (4, "r", None, "https://no", None), (5, "s", "a", "https://s/", None)], "n int, repo string, key string, base_url string, target_repo string")
    assert {tuple(r) for r in services.configured(stored, changes).collect()} == {("r", "a", "https://h/api/", "/api", "t"), ("s", "a", "https://s/", "", None)}
    assert services.configured(stored, changes.limit(0)).count() == 2


def test_decisions_of_all_shapes(spark):
    rows = [(1, "one", None), (2, "two", 1), (3, "three", 1), (4, "four", 9), (5, "five", 6), (6, "six", 5), (None, "null", 1)]
    df = spark.createDataFrame(rows, "id int, title string, supersedes int")
    assert {(r.id, r.root, r.depth, r.active) for r in decisions.chains(df).collect()} == {(1, 1, 0, False), (2, 1, 1, True), (3, 1, 1, True), (4, 9, 1, True), (5, None, None, False), (6, None, None, False)}
    files = spark.createDataFrame([(2, "b"), (2, "a"), (2, "b"), (4, None)], "id int, path string")
    assert {(r.id, r.superseded, tuple(r.files)) for r in decisions.context(df.where("id is not null"), files).collect()} == {(2, "one", ("a", "b")), (3, "one", ()), (4, None, ())}
    stored = services.recorded(df.limit(0), df.where("id < 3"))
    assert {(r.id, r.status) for r in services.recorded(stored, df.where("id >= 3")).collect()} == {(1, "SUPERSEDED"), (2, "ACTIVE"), (3, "ACTIVE"), (4, "ACTIVE"), (5, "SUPERSEDED"), (6, "SUPERSEDED")}


def test_hooks_of_all_shapes(spark):
    bodies = ['{"message": "m", "user_prompt": "u"}', '{"prompt": null, "message": "m", "file_path": "f"}', "", None, "7", '{"file_paths": ["a", "b"], "session_id": "s"}', '{"file_paths": 3}']
    got = {r.id: (r.prompt, r.session, None if r.paths is None else tuple(r.paths), r.error) for r in services.hook_events(spark.createDataFrame(list(enumerate(bodies)), "id int, body string")).collect()}
    assert got == {0: ("u", None, (), None), 1: ("m", None, ("f",), None), 2: (None, None, None, "no object"), 3: (None, None, None, "no object"), 4: (None, None, None, "no object"), 5: (None, "s", ("a", "b"), None), 6: (None, None, (), None)}


def test_names_are_guarded(spark):
    names = spark.createDataFrame([("shop",), ("../shop",), ("",), (None,), ("other",), ("/shop",)], "name string")
    got = {r.name: r.state for r in services.registered(names, names.where("name = 'shop'")).collect()}
    assert got == {"shop": "ok", "../shop": "invalid", "": "invalid", None: "invalid", "other": "not available", "/shop": "invalid"}


def test_catch_all_and_counts(spark):
    from lodemap.operators import stitch

    one = spark.createDataFrame([(1, "a"), (2, "a")], "request_id int, route_id string")
    assert stitch.stitched(one, one.limit(1), one.limit(0)).first().stitched == 3
