"""Queries on source files that are made of the given tables' rows, a file for each row, so their number grows with the tables.

The SQL builds the same results from the columns, without reading any source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.operators import clients, controllers, decisions, extract, incremental, mounts, paths, postings, relations, systems, trust, values
from lodemap.operators.traverse import shared, shared_path
from lodemap.plans.catalog import query
from lodemap.sources import tables as t


def _text(form: str) -> str:
    """A SQL expression of a text in which <x> stands for the expression x."""
    # A dollar sign and a brace side by side would be a variable of Spark's.
    parts = form.replace("'", "''").replace("\n", "\\n").replace("<", "', cast(").replace(">", " as string), '").replace("${", "$', '{")
    return f"concat('{parts}')"


def _files(df: DataFrame, repo: str, path: str, content: str) -> DataFrame:
    """Files of rows: repo, path and content are texts with <expressions>; ‹ and › stand for < and >."""
    expression = _text(content).replace("‹", "<").replace("›", ">")
    df = df.repartition(df.sparkSession.sparkContext.defaultParallelism)  # a small table is one split, its files are many tasks' work
    return df.selectExpr(f"{_text(repo)} AS repo", f"{_text(path)} AS path", f"{expression} AS content")


def _by(df: DataFrame, key: str, forms: list[tuple[str, str]], repo: str) -> DataFrame:
    """A file for each row, in the language that the rest of its key says."""
    parts = [_files(df.where(f"{key} % {len(forms)} = {i}"), repo, path, content) for i, (path, content) in enumerate(forms)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ROUTES = [
    ("g<k>/m.go", 'package p\nfunc Mount(r *gin.RouterGroup) {\n  a := r.Group("/g<s>")\n  b := a.Group("/sub", auth("x"))\n  b.GET("/:id", get<k>)\n  a.POST("", add<k>)\n}\n'),
    ("r<k>.js", '// router.get("/no", no)\nrouter.put(\n  "/parts/<k>/:id", handle<k>); router.get("/size/<s>", list);\nfunction handle<k>() {}\n'),
    ("C<k>.java", '@RestController\n@RequestMapping("/size/<s>")\npublic class C<k> {\n  @GetMapping({"/a", "/b/{id}"})\n  public String get(long id) { return null; }\n  @RequestMapping(value = "/c", method = RequestMethod.POST)\n  void add() {}\n}\n'),
    ("a<k>.py", '"""\n@app.get("/no")\ndef no(): pass\n"""\n@app.delete("/parts/<k>/{id}")\nasync def drop_<k>(id): pass\n'),
]


@query("""WITH p AS (SELECT p_partkey AS k, p_size AS s, 'r'||(p_partkey % 7) AS repo FROM part)
SELECT repo, 'g'||k||'/m.go' AS path, 'GET' AS method, '/g'||s||'/sub/{param}' AS path_form, 'get'||k AS handler FROM p WHERE k % 4 = 0 UNION ALL SELECT repo, 'g'||k||'/m.go', 'POST', '/g'||s, 'add'||k FROM p WHERE k % 4 = 0
UNION ALL SELECT repo, 'r'||k||'.js', 'PUT', '/parts/'||k||'/{param}', 'handle'||k FROM p WHERE k % 4 = 1 UNION ALL SELECT repo, 'r'||k||'.js', 'GET', '/size/'||s, 'list' FROM p WHERE k % 4 = 1
UNION ALL SELECT repo, 'C'||k||'.java', 'GET', '/size/'||s||x, 'C'||k||'.get(long)' FROM p, (VALUES ('/a'), ('/b/{param}')) t(x) WHERE k % 4 = 2 UNION ALL SELECT repo, 'C'||k||'.java', 'POST', '/size/'||s||'/c', 'C'||k||'.add()' FROM p WHERE k % 4 = 2
UNION ALL SELECT repo, 'a'||k||'.py', 'DELETE', '/parts/'||k||'/{param}', 'drop_'||k FROM p WHERE k % 4 = 3""")
def extracted_routes(spark, d: str) -> DataFrame:
    rows = t.read(spark, d, "part").selectExpr("p_partkey AS k", "p_size AS s")
    found = mounts.mounted(shared(extract.facts(_by(rows, "k", ROUTES, "r<k % 7>"), mounts.KINDS)))
    return found.where("kind = 'route'").select("repo", "path", "method", "path_form", "handler")


REQUESTS = [
    ("l<k>.ts", 'const load = () =› { fetch("/orders/<k>?page=1", { method: "POST" }); fetch(`/customers/<c>/${id}`); };\n'),
    ("S<k>.java", 'class S<k> {\n  String base;\n  void a(String id) {\n    String url = base + "/orders/<k>/" + id;\n    rest.getForObject(\n      url, String.class);\n  }\n  void b() {\n    String url = "http://me:pw@h<c>.example:81/list"; rest.delete(url);\n    values.put("x", "y");\n  }\n}\n'),
    ("c<k>/c.go", 'package p\nfunc base() string {\n  if on { return "https://a<c>.example" }\n  return "https://b.example/v1"\n}\nfunc send() {\n  url := base() + "/o/<k>"\n  http.NewRequestWithContext(ctx, http.MethodPut, url, nil)\n}\n'),
    ("p<k>.py", 'BASE = "/v<c % 3>"\ndef load(key):\n    return requests.get(\n        f"{BASE}/orders/<k>")\n'),
]


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, 'r'||(o_orderkey % 5) AS repo FROM orders)
SELECT repo, 'l'||k||'.ts' AS path, 'POST' AS method, '/orders/'||k AS path_form, '' AS system, 'load' AS function FROM o WHERE k % 4 = 0 UNION ALL SELECT repo, 'l'||k||'.ts', 'GET', '/customers/'||c||'/{param}', '', 'load' FROM o WHERE k % 4 = 0
UNION ALL SELECT repo, 'S'||k||'.java', 'GET', '/orders/'||k||'/{param}', '', 'S'||k||'.a(String)' FROM o WHERE k % 4 = 1 UNION ALL SELECT repo, 'S'||k||'.java', 'DELETE', '/list', 'h'||c||'.example:81', 'S'||k||'.b()' FROM o WHERE k % 4 = 1
UNION ALL SELECT repo, 'c'||k||'/c.go', 'PUT', '/o/'||k, 'a'||c||'.example', 'send' FROM o WHERE k % 4 = 2 UNION ALL SELECT repo, 'c'||k||'/c.go', 'PUT', '/v1/o/'||k, 'b.example', 'send' FROM o WHERE k % 4 = 2
UNION ALL SELECT repo, 'p'||k||'.py', 'GET', '/v'||(c % 3)||'/orders/'||k, '', 'load' FROM o WHERE k % 4 = 3""")
def extracted_requests(spark, d: str) -> DataFrame:
    rows = t.read(spark, d, "orders").selectExpr("o_orderkey AS k", "o_custkey AS c")
    found = values.filled(shared(extract.facts(_by(rows, "k", REQUESTS, "r<k % 5>"), [*values.URLS, *values.DEFINITIONS])))
    return found.where("kind = 'request'").select("repo", "path", "method", "path_form", "system", "function")


_TYPES = """WITH s AS (SELECT s_suppkey AS s, 'r'||(s_suppkey % 3) AS repo FROM supplier UNION ALL SELECT s_suppkey, 'q' FROM supplier WHERE s_suppkey % 10 = 3),
c AS (SELECT repo||':S'||s||'.java::S'||s AS id, repo, s FROM s), u AS (SELECT p_partkey AS k, 'r'||(p_partkey % 3) AS repo, p_partkey * 7 % 150 + 1 AS x FROM part),
m AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.s = x AND c.repo = u.repo) AS near, (SELECT min(id) FROM c WHERE c.s = x AND c.repo = u.repo) AS own, (SELECT count(*) FROM c WHERE c.s = x) AS n, (SELECT min(id) FROM c WHERE c.s = x) AS one FROM u),
r AS (SELECT *, CASE WHEN near = 1 THEN own WHEN near = 0 AND n = 1 THEN one END AS target FROM m)"""


def _typed(spark, d: str) -> DataFrame:
    """Classes of suppliers, some in two repositories, and classes of parts that import and call them."""
    supplier, part = t.read(spark, d, "supplier").selectExpr("s_suppkey AS s"), t.read(spark, d, "part").selectExpr("p_partkey AS k", "p_partkey * 7 % 150 + 1 AS x")
    there = "package d<s % 5>;\npublic class S<s> {\n  public void run(long n) {}\n}\n"
    here = 'package u;\nimport d<x % 5>.S<x>;\nclass U<k> {\n  void go(S<x> s, long n) {\n    if (n › <k> &&\n        ready("}")) {\n      s.run(n);\n    }\n  }\n}\n'
    files = _files(supplier, "r<s % 3>", "S<s>.java", there).unionByName(_files(supplier.where("s % 10 = 3"), "q", "S<s>.java", there)).unionByName(_files(part, "r<k % 3>", "U<k>.java", here))
    return shared(extract.facts(files))


@query(_TYPES + " SELECT repo||':U'||k||'.java' AS src, target AS dst, repo FROM r WHERE target IS NOT NULL")
def resolved_imports(spark, d: str) -> DataFrame:
    return relations.imports(_typed(spark, d))


@query(_TYPES + """ SELECT repo||':U'||k||'.java::U'||k||'.go(S'||x||',long)' AS function_id, 'd'||(x % 5)||'.S'||x AS target_type, 'run' AS target_method, 'n > '||k||' && ready("}")' AS condition, target||'.run(long)' AS target FROM r""")
def resolved_calls(spark, d: str) -> DataFrame:
    return relations.calls(_typed(spark, d)).select("function_id", "target_type", "target_method", "condition", "target")


@query("""WITH p AS (SELECT c_custkey AS k, 'r'||(c_nationkey % 5) AS repo, 't'||(c_custkey % 40) AS name FROM customer), c AS (SELECT s_suppkey AS k, 'w'||(s_suppkey % 3) AS repo, 't'||(s_suppkey % 45) AS name FROM supplier),
u AS (SELECT DISTINCT repo, name FROM (SELECT repo, name FROM p UNION ALL SELECT repo, name FROM c)), f AS (SELECT name, min(repo) AS first FROM u GROUP BY 1)
SELECT repo||':P'||k||'.java::P'||k||'.send()' AS src, repo||':channel:kafka:'||name AS dst, 'PUBLISHES_TO' AS type FROM p UNION ALL SELECT repo||':channel:kafka:'||name, repo||':W'||k||'.java::W'||k||'.on(String)', 'CONSUMED_BY' FROM c
UNION ALL SELECT DISTINCT repo||':channel:rabbitmq:key'||(k % 6), repo||':channel:rabbitmq:queue', 'ROUTES_TO' FROM c UNION ALL SELECT first||':channel:kafka:'||name, repo||':channel:kafka:'||name, 'SAME_CHANNEL' FROM u JOIN f USING (name) WHERE repo <> first
UNION ALL SELECT f.repo||':channel:rabbitmq:'||x.name, x.repo||':channel:rabbitmq:'||x.name, 'SAME_CHANNEL' FROM (SELECT DISTINCT repo, 'key'||(k % 6) AS name FROM c UNION SELECT DISTINCT repo, 'queue' FROM c) x
JOIN (SELECT name, min(repo) AS repo FROM (SELECT repo, 'key'||(k % 6) AS name FROM c UNION SELECT repo, 'queue' FROM c) GROUP BY 1) f ON x.name = f.name AND x.repo <> f.repo""")
def message_channels(spark, d: str) -> DataFrame:
    customer, supplier = t.read(spark, d, "customer").selectExpr("c_custkey AS k", "c_nationkey AS n"), t.read(spark, d, "supplier").selectExpr("s_suppkey AS k")
    out = 'class P<k> {\n  static final String TOPIC = "t<k % 40>";\n  void send() {\n    kafkaTemplate.send(topic(), 1);\n  }\n  String topic() { return TOPIC; }\n}\n'
    into = 'class W<k> {\n  @Value("${w.topic:t<k % 45>}")\n  private String topic;\n  String queue = "queue";\n  @KafkaListener(topics = "t<k % 45>")\n  public void on(String x) {}\n  Binding bound() { return BindingBuilder.bind(queue).to(exchange).with("key<k % 6>"); }\n}\n'
    files = _files(customer, "r<n % 5>", "P<k>.java", out).unionByName(_files(supplier, "w<k % 3>", "W<k>.java", into))
    return relations.channels(shared(values.filled(shared(extract.facts(files, ["publish", "consume", "binding", *values.DEFINITIONS]))))).select("src", "dst", "type")


def _models(spark, d: str) -> DataFrame:
    """Processes of suppliers with delegates and called processes, and classes of parts that start them."""
    supplier, part = t.read(spark, d, "supplier").selectExpr("s_suppkey AS s"), t.read(spark, d, "part").selectExpr("p_partkey AS k")
    model = '‹definitions xmlns:f="urn:f"›‹process id="flow<s>"›‹startEvent id="a"/›‹serviceTask id="b" f:delegateExpression="${worker<s>}"/›‹callActivity id="c" calledElement="flow<s + 1>"/›‹sequenceFlow id="x" sourceRef="a" targetRef="b"/›‹/process›‹/definitions›'
    worker = "class Worker<s> implements JavaDelegate {}\n"
    starter = 'class Start<k> {\n  static final String KEY = "flow<k % 30>";\n  void go() {\n    /* runtime.startProcessInstanceByKey("no"); */\n    runtime.startProcessInstanceByKey(key());\n  }\n  String key() { return KEY; }\n}\n'
    return _files(supplier, "m<s % 2>", "f<s>.bpmn", model).unionByName(_files(supplier.where("s % 3 > 0"), "m<s % 2>", "Worker<s>.java", worker)).unionByName(_files(part, "m<k % 4>", "Start<k>.java", starter))


@query("""WITH s AS (SELECT s_suppkey AS s, 'm'||(s_suppkey % 2) AS repo, 'm'||(s_suppkey % 2)||':f'||s_suppkey||'.bpmn::process:flow'||s_suppkey AS id FROM supplier)
SELECT id AS src, id||'::step:'||x AS dst, 'HAS_STEP' AS type FROM s, (VALUES ('a'), ('b'), ('c')) t(x) UNION ALL SELECT id||'::step:a', id||'::step:b', 'NEXT' FROM s
UNION ALL SELECT id||'::step:b', repo||':Worker'||s||'.java::Worker'||s, 'INVOKES' FROM s WHERE s % 3 > 0 UNION ALL SELECT a.id||'::step:c', b.id, 'CALLS' FROM s a JOIN s b ON b.s = a.s + 1""")
def workflow_links(spark, d: str) -> DataFrame:
    files = _models(spark, d)
    return relations.workflow(shared(extract.facts(files, ["class", "package"]).select("repo", "path", "file_id", "kind", "name", "member")), *extract.workflow(files)).select("src", "dst", "type")


@query("""SELECT 'm'||(p_partkey % 4)||':Start'||p_partkey||'.java::process-start:flow'||(p_partkey % 30)||':5' AS id, 'flow'||(p_partkey % 30) AS process_key,
'm'||(s_suppkey % 2)||':f'||s_suppkey||'.bpmn::process:flow'||s_suppkey AS target FROM part LEFT JOIN supplier ON s_suppkey = p_partkey % 30""")
def workflow_starts(spark, d: str) -> DataFrame:
    files = _models(spark, d)
    facts = values.filled(shared(extract.facts(files, ["start", *values.DEFINITIONS])))
    return relations.starts(facts, extract.workflow(files)[0]).select("id", "process_key", "target")


@query("""WITH p AS (SELECT p_partkey AS k, 'v'||(p_partkey % 3)||':V'||p_partkey||'.java' AS file FROM part)
SELECT file||'::action:list:selection:6' AS id, CASE WHEN k % 2 = 0 THEN file END AS page_id, file||'::V'||k||'.wire()' AS function_id, 'if e.n() > '||k||': drop.setEnabled(true); if NOT (e.n() > '||k||'): drop.setEnabled(false)' AS effects FROM p""")
def ui_actions(spark, d: str) -> DataFrame:
    rows = t.read(spark, d, "part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 2 = 0 THEN '@SpringView(name = V' || p_partkey || '.NAME)' ELSE '@Component' END AS mark")
    view = '<mark>\nclass V<k> {\n  static final String NAME = "v<k>";\n  void wire() {\n    // drop.addClickListener(e);\n    list.addSelectionListener(e -› {\n      if (e.n() › <k>) {\n        drop.setEnabled(true);\n      } else {\n        drop.setEnabled(false);\n      }\n    });\n  }\n}\n'
    facts = shared(extract.facts(_files(rows, "v<k % 3>", "V<k>.java", view), ["action", "page"]).select("repo", "file_id", "kind", "method", "name", "function", "condition", "line", "effects"))
    return relations.actions(facts).select("id", "page_id", "function_id", F.array_join("effects", "; ").alias("effects"))


@query("""WITH s AS (SELECT s_suppkey AS s, 'n'||s_nationkey AS repo, 'n'||s_nationkey||':s'||s_suppkey||'.properties' AS file, CASE s_suppkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'mariadb' END AS db FROM supplier),
e AS (SELECT repo, 'database' AS kind, db AS technology, 'database' AS role, db AS name, file, 1 AS line FROM s UNION ALL SELECT repo, 'email', 'smtp', 'email', 'mail.example:'||(s % 4), file, 2 FROM s UNION ALL SELECT repo, 'http', 'http', 'service', 'h'||(s % 6)||'.example:90', file, 4 FROM s)
SELECT repo, kind, technology, role, name, count(*) AS files, count(*) AS evidence, (min_by(file, file))||':'||min(line) AS first FROM e GROUP BY 1, 2, 3, 4, 5""")
def system_boundary(spark, d: str) -> DataFrame:
    rows = t.read(spark, d, "supplier").selectExpr("s_suppkey AS s", "s_nationkey AS n", "CASE s_suppkey % 3 WHEN 0 THEN 'mysql' WHEN 1 THEN 'postgresql' ELSE 'mariadb' END AS db")
    settings = "spring.datasource.url=jdbc:<db>://me:pw@db:1/x\nspring.mail.host=mail.example\nspring.mail.port=<s % 4>\nshop.url=http://me:pw@h<s % 6>.example:90/api?key=1\n# old.url=http://gone.example\n"
    return systems.boundary(shared(extract.facts(_files(rows, "n<n>", "s<s>.properties", settings)))).select("repo", "kind", "technology", "role", "name", "files", "evidence", "first")


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part WHERE p_partkey > 0), e AS (SELECT k // 2 AS up, k, '/n'||(k // 2) AS step FROM p WHERE k >= 2 UNION ALL SELECT k // 2, k, '/again'||(k // 2) FROM p WHERE k >= 2 AND k % 10 = 0),
r AS (SELECT 1 AS k, '' AS label UNION ALL SELECT e.k, label||step FROM r JOIN e ON e.up = r.k) SELECT DISTINCT 'h'||k||'/h.go' AS path, label||'/n'||k||'/{param}' AS path_form FROM r JOIN p USING (k)""")
def mounted_routes(spark, d: str) -> DataFrame:
    """A package for each part; it mounts those of twice its number and one more, some of them twice."""
    rows = t.read(spark, d, "part").where("p_partkey > 0").selectExpr("p_partkey AS k", "2 * p_partkey AS l", "2 * p_partkey + 1 AS m", "CASE WHEN p_partkey % 5 = 0 THEN concat('  b := g.Group(\"/again', p_partkey, '\")\n  l.Mount(b)\n') ELSE '' END AS more")
    source = 'package h<k>\nimport (\n  l "x.example/m/h<l>"\n  "x.example/m/h<m>"\n)\nfunc Mount(g *gin.RouterGroup) {\n  a := g.Group("/n<k>")\n  a.GET("/:id", get)\n  l.Mount(a)\n  h<m>.Mount(a)\n<more>}\n'
    module = _files(rows.where("k = 1"), "r", "go.mod", "module x.example/m\n")
    found = mounts.mounted(shared(extract.facts(_files(rows, "r", "h<k>/h.go", source).unionByName(module), mounts.KINDS)))
    return found.where("kind = 'route'").select("path", "path_form").distinct()


@query("""WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, 'r'||(o_custkey % 3) AS repo FROM orders)
SELECT id, CASE WHEN id % 11 = 0 THEN '/c'||c||'/o'||id WHEN c % 4 > 0 THEN '/c'||c ELSE '' END AS prefix, CASE WHEN id % 11 = 0 THEN 'order' WHEN c % 8 = 1 THEN 'first' WHEN c % 4 > 0 THEN 'customer' ELSE 'all' END AS target
FROM o WHERE id % 11 = 0 OR c % 4 > 0 OR repo = 'r0'""")
def rewritten_requests(spark, d: str) -> DataFrame:
    """Orders as requests below their customers; rules of customers, of some orders, and one for all of a repository."""
    orders = t.read(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('r', o_custkey % 3) AS repo", "concat('/c', o_custkey, '/o', o_orderkey, '/x?y=1') AS path", "o_custkey AS c")
    customer = t.read(spark, d, "customer").selectExpr("c_custkey AS c", "concat('r', c_custkey % 3) AS repo")
    rules = (
        customer.where("c % 4 > 0").selectExpr("repo", "concat('/c', c) AS prefix", "5 AS place", "'customer' AS target")
        .unionByName(customer.where("c % 8 = 1").selectExpr("repo", "concat('/c', c, '/') AS prefix", "4 AS place", "'first' AS target"))
        .unionByName(orders.where("id % 11 = 0").selectExpr("repo", "concat('/c', c, '/o', id) AS prefix", "1 AS place", "'order' AS target"))
        .unionByName(customer.where("c % 3 = 0").selectExpr("repo", "'/' AS prefix", "9 AS place", "'all' AS target"))
    )
    return clients.longest_prefix(orders.select("id", "repo", "path"), rules)


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey // 25 AS run, (SELECT count(*) FROM part b WHERE b.p_partkey // 25 = a.p_partkey // 25 AND b.p_partkey <= a.p_partkey) = a.p_partkey % 25 + CASE WHEN a.p_partkey < 25 THEN 0 ELSE 1 END AS whole FROM part a WHERE p_partkey >= 25),
b(base, method, rest) AS (VALUES (0, 'GET', ''), (0, 'GET', '/{param}'), (1, 'GET', ''), (1, 'GET', '/{param}'), (1, 'POST', ''), (1, 'PUT', '/{param}'), (1, 'PATCH', '/{param}'), (1, 'DELETE', '/{param}'), (2, 'GET', ''), (2, 'GET', '/{param}'), (2, 'POST', ''), (2, 'POST', '/submit'), (2, 'POST', '/update'))
SELECT 'C'||k AS name, method, '/c/'||k||rest AS path_form FROM p JOIN b ON base = run % 3 WHERE whole AND run % 7 <> 5 AND k % 4 = 1""")
def inherited_routes(spark, d: str) -> DataFrame:
    """A class for each part that extends the one before it, in runs of 25 that end in a base controller or, some of them, in their own last."""
    base = "CASE WHEN p_partkey % 25 > 0 THEN concat(CASE WHEN p_partkey % 2 = 0 THEN 'x.y.' ELSE '' END, 'C', p_partkey - 1) WHEN p_partkey div 25 % 7 = 5 THEN concat('C', p_partkey + 24) WHEN p_partkey div 25 % 3 = 0 THEN 'com.lib.ReadOnlyJpaRestController' WHEN p_partkey div 25 % 3 = 1 THEN 'FilteredJpaRestController' ELSE 'FlowController' END"
    rows = t.read(spark, d, "part").where("p_partkey >= 25").selectExpr("p_partkey AS k", f"{base} AS base", "CASE WHEN p_partkey % 4 = 1 THEN concat('@RestController\n@RequestMapping(\"/c/', p_partkey, '\")\n') ELSE '' END AS marks")
    source = "package x.y;\n<marks>public class C<k>\n    extends <base>‹Item, Long› {\n  // extends FlowController\n}\n"
    return controllers.inherited_routes(shared(extract.facts(_files(rows, "r", "x/C<k>.java", source), controllers.KINDS).select("repo", "path", "suffix", "kind", "name", "url", "argument", "detail"))).select("name", "method", "path_form")


@query("""WITH s AS (SELECT s_suppkey AS s FROM supplier) SELECT 'p'||p_partkey AS page, 'GET' AS method, '/v'||(p_partkey % 50 - p_partkey % 50 % 8)||'/rows/'||p_partkey AS path_form, 'h'||(p_partkey % 50 - p_partkey % 50 % 8)||'.example' AS system
FROM part WHERE (SELECT count(*) FROM s WHERE s BETWEEN p_partkey % 50 - p_partkey % 50 % 8 AND p_partkey % 50) = p_partkey % 50 % 8 + 1""")
def imported_clients(spark, d: str) -> DataFrame:
    """Modules of suppliers: each eighth makes a client, the others pass on that of the module before them under a name of their own; pages of parts use it by an alias."""
    supplier = t.read(spark, d, "supplier").selectExpr("s_suppkey AS s", "CASE WHEN s_suppkey % 8 = 0 THEN concat('export const c', s_suppkey, ' = axios.create({\n  baseURL: \"https://h', s_suppkey, '.example/v', s_suppkey, '\",\n});\n') ELSE concat('export { c', s_suppkey - 1, ' as c', s_suppkey, ' } from \"./m', s_suppkey - 1, '\";\n') END AS body")
    part = t.read(spark, d, "part").selectExpr("p_partkey AS k", "p_partkey % 50 AS x")
    page = 'import { c<x> as rows<k> } from "@/lib/m<x>";\nexport const load = () =› rows<k>.get‹Row[]›(\n  "/rows/<k>");\n'
    files = _files(supplier, "r", "web/src/lib/m<s>.ts", "<body>").unionByName(_files(part, "r", "web/src/pages/p<k>.tsx", page))
    found = clients.configured(shared(extract.facts(files))).where("kind = 'request'")
    return found.select(F.regexp_extract("path", r"(p\d+)\.tsx$", 1).alias("page"), "method", "path_form", "system")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 20 AS x FROM part),
d AS (SELECT 'd'||k AS file, 'r'||(k % 5) AS repo, 'K'||(k % 1500) AS key, 'c'||k AS id FROM p WHERE x NOT IN (0, 1, 2) UNION ALL SELECT 'd'||k, 'r'||(k % 5), 'K'||((k + 7) % 1500), 'c'||k||'new' FROM p WHERE x = 1
UNION ALL SELECT 'moved'||k, 'r'||(k % 5), 'K'||(k % 1500), 'moved'||k FROM p WHERE x = 2 UNION ALL SELECT 'copy'||k, 'r'||(k % 5), 'K'||(k % 1500), 'copy'||k FROM p WHERE x = 3),
f AS (SELECT 'u'||l_orderkey AS file, 'r'||(l_suppkey % 6) AS repo, 'K'||(l_partkey % 1600) AS key, 'u'||l_orderkey||'-'||l_linenumber AS src FROM lineitem WHERE l_orderkey % 10 <> 4),
n AS (SELECT key, count(DISTINCT id) AS n, min(id) AS one FROM d GROUP BY 1), o AS (SELECT key, repo, count(DISTINCT id) AS n, min(id) AS one FROM d GROUP BY 1, 2)
SELECT f.file, f.repo, f.key, src, CASE WHEN o.n = 1 THEN o.one WHEN o.n IS NULL AND n.n = 1 THEN n.one END AS target FROM f LEFT JOIN n ON f.key = n.key LEFT JOIN o ON f.key = o.key AND f.repo = o.repo WHERE CASE WHEN o.n = 1 THEN o.one WHEN o.n IS NULL AND n.n = 1 THEN n.one END IS NOT NULL GROUP BY ALL""")
def incremental_sync(spark, d: str) -> DataFrame:
    """Links of lines to parts, built in full, then changed: parts are deleted, modified, renamed and copied, and some orders are gone. The SQL builds the end in full."""
    part = t.read(spark, d, "part").selectExpr("p_partkey AS k", "p_partkey % 20 AS x", "concat('r', p_partkey % 5) AS repo", "concat('K', p_partkey % 1500) AS key")
    line = t.read(spark, d, "lineitem").selectExpr("concat('u', l_orderkey) AS file", "concat('r', l_suppkey % 6) AS repo", "concat('K', l_partkey % 1600) AS key", "concat('u', l_orderkey, '-', l_linenumber) AS src", "l_orderkey % 10 = 4 AS gone")
    links = incremental.Links(spark, shared_path(spark, "links"), parts=16)
    links.build(part.selectExpr("concat('d', k) AS file", "repo", "key", "concat('c', k) AS id"), line.drop("gone"))
    changes = (
        part.where("x = 0").selectExpr("'D' AS status", "concat('d', k, '.java') AS path", "CAST(NULL AS STRING) AS old_path")
        .unionByName(part.where("x = 1").selectExpr("'M' AS status", "concat('d', k, '.java') AS path", "CAST(NULL AS STRING) AS old_path"))
        .unionByName(part.where("x = 2").selectExpr("'R' AS status", "concat('moved', k, '.java') AS path", "concat('d', k, '.java') AS old_path"))
        .unionByName(part.where("x = 3").selectExpr("'C' AS status", "concat('copy', k, '.java') AS path", "concat('d', k, '.java') AS old_path"))
        .unionByName(line.where("gone").selectExpr("'D' AS status", "concat(file, '.java') AS path", "CAST(NULL AS STRING) AS old_path"))
    )
    acts = shared(incremental.classified(changes).withColumn("file", F.regexp_replace("path", r"\.java$", "")))
    now = part.where("x = 1").selectExpr("concat('d', k) AS file", "repo", "concat('K', (k + 7) % 1500) AS key", "concat('c', k, 'new') AS id").unionByName(part.where("x = 2").selectExpr("concat('moved', k) AS file", "repo", "key", "concat('moved', k) AS id")).unionByName(part.where("x = 3").selectExpr("concat('copy', k) AS file", "repo", "key", "concat('copy', k) AS id"))
    read = acts.where("action = 'read'").select("file")
    links.apply(acts.where("action in ('read', 'drop')").select("file"), now.join(read, "file", "left_semi"), line.drop("gone").limit(0))
    return links.links().select("file", "repo", "key", "src", "target")


def _orders_in_line(spark, d: str) -> DataFrame:
    """Every order supersedes the one before it of its customer; the first of some customers supersedes their last, a circle."""
    by = Window.partitionBy("c").orderBy("id")
    orders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("title"))
    return orders.withColumn("supersedes", F.coalesce(F.lag("id").over(by), F.when(F.col("c") % 7 == 0, F.max("id").over(Window.partitionBy("c")))))


@query("""WITH o AS (SELECT o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS depth, min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last, o_custkey % 7 = 0 AS cycle FROM orders)
SELECT id, CASE WHEN NOT cycle THEN root END AS root, CASE WHEN NOT cycle THEN depth END AS depth, id = last AND NOT cycle AS active FROM o""")
def superseded_orders(spark, d: str) -> DataFrame:
    return decisions.chains(_orders_in_line(spark, d).select("id", "supersedes"))


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS title, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS superseded, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last FROM orders WHERE o_custkey % 7 <> 0),
f AS (SELECT l_orderkey AS id, string_agg(path, ' ' ORDER BY path) AS files FROM (SELECT DISTINCT l_orderkey, 'f'||l_partkey AS path FROM lineitem) GROUP BY 1)
SELECT id, title, superseded, coalesce(files, '') AS files FROM o LEFT JOIN f USING (id) WHERE id = last""")
def decision_context(spark, d: str) -> DataFrame:
    files = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"))
    return decisions.context(_orders_in_line(spark, d).select("id", "title", "supersedes"), files).withColumn("files", F.array_join("files", " "))


_PATHS = """e AS (SELECT 'F:'||o_custkey AS src, 'Q:'||o_orderkey AS dst, 'MAKES_REQUEST' AS type FROM orders UNION ALL SELECT 'Q:'||l_orderkey, 'P:'||l_partkey, 'TARGETS_ROUTE' FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT 'P:'||l_partkey, 'S:'||l_suppkey, 'USES_SYSTEM' FROM lineitem),
u AS (SELECT DISTINCT * FROM e), s AS (SELECT 'F:'||c_custkey AS seed FROM customer WHERE c_custkey % 100 = 1),
a AS (SELECT seed, dst AS node, 1 AS state, type||'>'||dst AS path FROM s JOIN u ON src = seed WHERE type = 'MAKES_REQUEST'),
b AS (SELECT seed, dst AS node, 2 AS state, path||' '||type||'>'||dst AS path FROM a JOIN u ON src = node WHERE type = 'TARGETS_ROUTE'), c AS (SELECT seed, dst AS node, 4 AS state, path||' '||type||'>'||dst AS path FROM b JOIN u ON src = node WHERE type = 'USES_SYSTEM')"""


@query(f"""WITH {_PATHS} SELECT seed, node, state, state - state // 4 AS distance, min(path) AS path FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY 1, 2, 3
UNION ALL SELECT seed, seed, 0, 0, '' FROM s""")
def page_inspection(spark, d: str) -> DataFrame:
    """From every hundredth customer's page by its requests to routes and their systems, each by its first shortest path."""
    edges = trust.traversable(t.edges(spark, d))
    seeds = t.read(spark, d, "customer").where("c_custkey % 100 = 1").select(F.concat(F.lit("F:"), F.col("c_custkey").cast("string")).alias("node"))
    return paths.written_out(paths.typed_paths(edges, seeds, paths.INSPECTION, 4))


@query("""WITH t(term) AS (VALUES ('PART 1'), ('42'), ('omer#0000'), ('7'), ('nothing like it'), ('00001')), x AS (SELECT 'P:'||p_partkey AS id, p_name AS text FROM part UNION ALL SELECT 'S:'||s_suppkey, s_name FROM supplier UNION ALL SELECT 'C:'||c_custkey, c_name FROM customer)
SELECT term, id FROM t JOIN x ON contains(lower(text), lower(term))""")
def search_all_text(spark, d: str) -> DataFrame:
    names = (("part", "P", "p_partkey", "p_name"), ("supplier", "S", "s_suppkey", "s_name"), ("customer", "C", "c_custkey", "c_name"))
    texts = [t.read(spark, d, table).selectExpr(f"concat('{letter}:', {key}) AS id", f"{name} AS text") for table, letter, key, name in names]
    found = postings.Postings(spark, shared_path(spark, "postings"), parts=16)
    found.build(texts[0].unionByName(texts[1]).unionByName(texts[2]))
    return found.search(spark.createDataFrame([(x,) for x in ("PART 1", "42", "omer#0000", "7", "nothing like it", "00001")], "term string"))
