import pytest
from pyspark.sql import functions as F

from lodemap.functions import identity, urls
from lodemap.operators import coverage, extract, sync
from lodemap.plans.build import build
from lodemap.sources import repository

PY = '''import requests
class Cart:
    def total(self): return 0
    def send(self, key):
        return requests.post(f"/shop/carts/{key}/orders")
class Stock:
    def total(self): return 1
@app.put('/shop/items/{item}')
def change_item(item):
    def inner(): pass
# requests.get("/shop/commented")
'''
TS = '''import http from "axios";
export const Basket = () => { fetch(`/shop/items/${key}`); };
axios.put("/shop/items?page=3", {});
axios.put(`/shop/items/${key}`, {});
app.delete('/shop/items/:item', dropItem);
function dropItem() {}
'''
JAVA = '''/* restTemplate.getForObject("http://a.example/x") */
import a.b.C;
@RestController
@RequestMapping("/depot/v2")
public class Depot {
  @GetMapping("/boxes/{id}")
  public Box one(String id, final int n) { return rest.getForObject("http://localhost:1025/jobs/1", Box.class); }
  @PostMapping
  public Box add(@RequestBody List<Box> all) {
    if (all == null) { return null; }
  }
  public Box add(Box b) { return b; }
  // kafkaTemplate.send("no")
  void go() { kafkaTemplate.send("jobs", x); }
}
class Plain {
  @DeleteMapping("/loose/{id}")
  void drop(long id) { }
}
'''
BPMN = '''<definitions xmlns:f="urn:f"><process id="p"><startEvent id="s"/><serviceTask id="t" f:delegateExpression="${worker}"/>
<exclusiveGateway id="g" default="f3"/><endEvent id="e"/><sequenceFlow id="f1" sourceRef="s" targetRef="t"/>
<sequenceFlow id="f2" sourceRef="g" targetRef="e"><conditionExpression>${ok}</conditionExpression></sequenceFlow><sequenceFlow id="f3" sourceRef="g" targetRef="t"/></process></definitions>'''


@pytest.fixture(scope="module")
def files(spark):
    rows = [("back", "api.py", PY), ("back", "tests/test_api.py", PY), ("ui", "src/pages/users.tsx", TS), ("back", "Job.java", JAVA), ("back", "p.bpmn", BPMN), ("ui", "src/app/api/docs/[id]/route.ts", "export async function GET() {}"), ("ui", "empty.py", ""), ("ui", "none.py", None)]
    return spark.createDataFrame(rows, "repo string, path string, content string").cache()


def test_facts(files):
    got = {(r.path, r.kind, r.method, r.path_form, r.name) for r in extract.facts(files).where("scope = 'runtime' and kind <> 'host'").collect()}
    assert ("api.py", "route", "PUT", "/shop/items/{param}", None) in got
    assert ("api.py", "request", "POST", "/shop/carts/{param}/orders", None) in got
    assert ("src/pages/users.tsx", "request", "PUT", "/shop/items", None) in got
    assert ("src/pages/users.tsx", "route", "DELETE", "/shop/items/{param}", "dropItem") in got
    assert ("Job.java", "publish", None, None, "jobs") in got
    assert not any("commented" in str(x) or x[4] == "no" for x in got)


def test_members_are_told_apart_by_owner_and_overload(files):
    got = {(r.path, r.member) for r in extract.facts(files).where("kind = 'function' and scope = 'runtime'").collect()}
    assert {m for p, m in got if p == "api.py"} == {"Cart.total", "Cart.send", "Stock.total", "change_item", "change_item.inner"}
    assert {m for p, m in got if p == "Job.java"} == {"Depot.one(String,int)", "Depot.add(List)", "Depot.add(Box)", "Depot.go()", "Plain.drop(long)"}


def test_spring_routes_have_their_class_before_them(files):
    got = {(r.method, r.path_form, r.handler) for r in extract.facts(files).where("kind = 'route' and path = 'Job.java'").collect()}
    assert got == {("GET", "/depot/v2/boxes/{param}", "Depot.one(String,int)"), ("POST", "/depot/v2", "Depot.add(List)"), ("DELETE", "/loose/{param}", "Plain.drop(long)")}


def test_routes_are_linked_to_their_handlers(files):
    _, edges = build(files)
    got = {(r.src, r.dst) for r in edges.where("type = 'HANDLED_BY'").collect()}
    assert ("back:PUT:/shop/items/{param}", "back:api.py::change_item") in got and ("back:POST:/depot/v2", "back:Job.java::Depot.add(List)") in got
    assert ("ui:DELETE:/shop/items/{param}", "ui:src/pages/users.tsx::dropItem") in got and ("ui:GET:/api/docs/{param}", "ui:src/app/api/docs/[id]/route.ts::GET") in got


def test_hosts_keep_ports_and_comments_yield_none(files):
    got = {r.system for r in extract.facts(files).where("kind = 'host'").collect()}
    assert got == {"localhost:1025"}


def test_build_suggests_and_resolves_nothing(files):
    nodes, edges = build(files)
    links = edges.where("type = 'TARGETS_ROUTE'")
    assert {r.trust_status for r in links.collect()} == {"SUGGESTED"}
    requests = nodes.where("label = 'APIEndpoint'").select("id", "repo")
    rows = coverage.overview(requests, links.select(F.col("src").alias("request_id"), "trust_status")).collect()
    assert sum(r.candidates for r in rows) > 0 and all(r.resolved == 0 and r.coverage == 0 for r in rows)
    assert nodes.groupBy("id", "label").count().where("count > 1").isEmpty()


def test_workflow(files):
    steps, flows = extract.workflow(files)
    assert [(r.step, r.delegate) for r in steps.orderBy("ordinal").collect()] == [("s", None), ("t", "worker"), ("g", None), ("e", None)]
    got = {r.flow: (r.condition, r.is_default) for r in flows.collect()}
    assert got == {"f1": (None, False), "f2": ("${ok}", False), "f3": (None, True)}


def test_app_routes(files):
    got = [(r.method, r.route_path, r.path_form) for r in extract.app_routes(files, extract.facts(files)).collect()]
    assert got == [("GET", "/api/docs/[id]", "/api/docs/{param}")]


def test_mask_keeps_length_lines_and_strings():
    source = 'a = "// no"; // yes\n/* b\n c */ d = \'"\'; e'
    masked = extract.mask_comments(source)
    assert len(masked) == len(source) and masked.count("\n") == 2 and '"// no"' in masked and "yes" not in masked and "b" not in masked


def test_urls(spark):
    cases = [("https://h/api/v1/users/${id}/", "/api/v1/users/{param}"), ("/api/admin/[[...path]]", "/api/admin/{param}"), ("/http://x.test/api/users?q=1", "/api/users"), ("/api/users/:id", "/api/users/{param}"), ("/api/documents${query}", "/api/documents")]
    df = spark.createDataFrame(cases, "u string, want string")
    assert all(r.got == r.want for r in df.select("want", urls.normalize_url(F.col("u")).alias("got")).collect())
    safe = spark.createDataFrame([("https://me:pw@h.test:81/a/?k=secret",)], "u string").select(urls.sanitize_url(F.col("u")).alias("s"), urls.system(F.col("u")).alias("h"), urls.service_path_prefix(F.col("u")).alias("p")).first()
    assert (safe.s, safe.h, safe.p) == ("https://h.test:81/a/", "h.test:81", "/a")
    assert spark.createDataFrame([("UserService",)], "n string").select(identity.alias(F.col("n"))).first()[0] == "userService"


def test_diff(spark):
    lines = spark.createDataFrame([("M\ta.py",), ("D\tb.py",), ("R100\tc.py\td.py",), ("C75\te.py\tf.py",)], "line string")
    assert [tuple(r) for r in sync.changes_of_diff(lines).collect()] == [("M", "a.py", None), ("D", "b.py", None), ("R", "d.py", "c.py"), ("C", "f.py", "e.py")]


def test_scan(spark, tmp_path):
    for p, text in (("src/a.py", PY), ("node_modules/x.py", PY), ("old/b.py", PY), ("README.md", "x")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    got = repository.scan(spark, str(tmp_path), "r", excluded=["old"]).collect()
    assert [r.path for r in got] == ["src/a.py"] and got[0].content == PY


def test_workers():
    assert repository.workers(None) == 4 and repository.workers("2") == 2
    for bad in ("0", "-1", "x", ""):
        with pytest.raises(ValueError, match="positive integer"):
            repository.workers(bad)


def test_secrets_are_judged_one_by_one(spark):
    from lodemap.functions import secrets

    cases = [
        ("password = 'example-9a8b7c6d'\napi_key = 'q8Zr42LmP0xT'", ["api_key"]),  # a stand-in hides no secret beside it
        ("password: '${DB_PASSWORD_FROM_ENV}'", []),
        ("clientSecret = '<your secret here>'", []),
        ("db.passwd => 'tr0ub4dor&3x'", ["db.passwd"]),
        ('"access_token": "aaaaaaaaaaaaaaaa"', []),  # not varied
        ("token = 'short1'", []),
        ("title = 'q8Zr42LmP0xT'", []),  # no secret's name
        ("", []),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    got = {r.i: r.names for r in rows.select("i", secrets.assigned(F.col("text")).alias("names")).collect()}
    assert [got[i] for i in range(len(cases))] == [names for _, names in cases]
    kinds = [("-----BEGIN RSA PRIVATE KEY-----", "private_key"), ("github_pat_" + "A1b2" * 8, "forge_token"), ("ghp_" + "a1B2" * 6, "forge_token"), ("AKIA" + "Z9" * 8, "cloud_key"), ("Authorization: Bearer " + "x1Y" * 8, "bearer")]
    for text, kind in kinds:
        found = spark.range(1).select(*[secrets.found(F.lit(text), k).alias(k) for k in secrets.KINDS]).first()
        assert [k for k in secrets.KINDS if found[k]] == [kind]


def test_catch_all_prefixes_of_all_kinds(spark):
    from lodemap.operators import stitch

    requests = spark.createDataFrame([(1, "r", "GET", "/api/auth/a/b"), (2, "r", "GET", "/api/other"), (3, "r", "GET", "/filesx/y"), (4, "r", "POST", "/api/auth/a"), (5, "r", "GET", None), (6, "r", "GET", "none")], "request_id long, repo string, method string, path string")
    routes = spark.createDataFrame([("a", "r", "GET", "/api/auth/[...rest]"), ("b", "r", "GET", "/api/[[...all]]"), ("c", "r", "GET", "/files[...x]"), ("d", "s", "GET", "/api/[...x]"), ("e", "r", "GET", "/plain")], "route_id string, repo string, method string, route_path string")
    assert {(r.request_id, r.route_id) for r in stitch.catch_all(requests, routes).collect()} == {(1, "a"), (1, "b"), (2, "b"), (3, "c")}


def test_reach_of_cycles_nulls_and_both_directions(spark, monkeypatch):
    from lodemap.operators import traverse

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", None), (None, "d"), ("a", "b")], "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",), (None,)], "node string")
    for most in (100_000, 0):
        monkeypatch.setattr(traverse, "BROADCAST_NODES", most)
        assert {tuple(r) for r in traverse.reach(edges, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
        assert {r.node for r in traverse.two_hops(edges, seeds).collect()} == {"a", "b", "c", "x"}
