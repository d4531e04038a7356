"""Queries on what users and runs record: services, decisions, hooks, totals and warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodemap.operators import coverage, extract, relations, services, stitch
from lodemap.operators.traverse import reach, shared
from lodemap.operators.trust import traversable
from lodemap.plans import build
from lodemap.plans.catalog import query
from lodemap.plans.code import _by, _files
from lodemap.sources import tables as t


@query("""WITH s AS (SELECT 'r'||c_nationkey AS repo, 'k'||(c_custkey % 200) AS key, c_custkey AS n FROM customer), l AS (SELECT repo, key, max(n) AS n FROM s GROUP BY 1, 2)
SELECT repo, key, 'https://h'||n||'.example:8'||(n % 10)||'/v'||(n % 3) AS base_url, '/v'||(n % 3) AS path_prefix, CASE WHEN n % 2 = 0 THEN 'r'||(n % 7) END AS target_repo FROM l WHERE n % 5 <> 0
UNION ALL SELECT 'r'||s_nationkey, 'kept'||s_suppkey, 'https://s', '', NULL FROM supplier""")
def configured_services(spark, d: str) -> DataFrame:
    """Customers as changes, in order; a fifth of them clears its key. Suppliers are services that no change names."""
    changes = t.read(spark, d, "customer").selectExpr("c_custkey AS n", "concat('r', c_nationkey) AS repo", "concat('k', c_custkey % 200) AS key", "CASE WHEN c_custkey % 5 <> 0 THEN concat('https://me:pw@h', c_custkey, '.example:8', c_custkey % 10, '/v', c_custkey % 3, '?key=1') END AS base_url", "CASE WHEN c_custkey % 2 = 0 THEN concat('r', c_custkey % 7) END AS target_repo")
    stored = t.read(spark, d, "supplier").selectExpr("concat('r', s_nationkey) AS repo", "concat('kept', s_suppkey) AS key", "'https://s' AS base_url", "'' AS path_prefix", "CAST(NULL AS STRING) AS target_repo")
    more = t.read(spark, d, "customer").selectExpr("concat('r', c_nationkey) AS repo", "concat('k', c_custkey % 200) AS key", "'https://old' AS base_url", "'' AS path_prefix", "CAST(NULL AS STRING) AS target_repo").distinct()
    return services.configured(stored.unionByName(more), changes)


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 = 0 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS supersedes FROM orders)
SELECT id, title, supersedes, CASE WHEN id IN (SELECT supersedes FROM o WHERE supersedes IS NOT NULL) THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS status FROM o""")
def recorded_decisions(spark, d: str) -> DataFrame:
    orders = t.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("title"))
    rows = orders.withColumn("supersedes", F.when(F.col("id") % 3 == 0, F.lag("id").over(Window.partitionBy("c").orderBy("id")))).drop("c")
    stored = rows.where("id % 3 > 0").unionByName(rows.where("id % 9 = 0").withColumn("title", F.lit("old")))
    return services.recorded(stored, rows.where("id % 3 = 0"))


@query("""SELECT conv_id * 1000 + turn AS id, CASE WHEN turn % 4 < 3 THEN text END AS prompt, CASE WHEN turn % 4 < 3 THEN 's'||conv_id END AS session, CASE WHEN turn % 4 = 0 THEN 'a b' WHEN turn % 4 = 1 THEN 'f'||turn WHEN turn % 4 = 2 THEN '' END AS paths,
CASE WHEN turn % 4 = 3 THEN 'no object' END AS error FROM conversations""")
def hook_payloads(spark, d: str) -> DataFrame:
    """Turns of conversations as payloads of several shapes; a fourth of them is cut in the middle or a list."""
    rows = t.read(spark, d, "conversations")
    body = (
        F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.col("text").alias("prompt"), F.lit("other").alias("message"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"), F.array(F.lit("a"), F.lit("b")).alias("file_paths"))))
        .when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.col("text").alias("user_prompt"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), F.concat(F.lit("f"), F.col("turn").cast("string")).alias("file_path"))))
        .when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.col("text").alias("message"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session"))))
        .when(F.col("turn") % 8 == 3, F.lit('{"prompt": "cut')).otherwise(F.lit("[1, 2]")))
    return services.hook_events(rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), body.alias("body"))).withColumn("paths", F.array_join("paths", " "))


@query("""SELECT n_name AS name, 'ok' AS state FROM nation UNION ALL SELECT 'x/'||n_name, 'invalid' FROM nation UNION ALL SELECT '../'||n_name, 'invalid' FROM nation UNION ALL SELECT n_name||'X', 'not available' FROM nation""")
def registered_names(spark, d: str) -> DataFrame:
    names = t.read(spark, d, "nation").select(F.col("n_name").alias("name"))
    given = names.unionByName(names.select(F.concat(F.lit("x/"), "name").alias("name"))).unionByName(names.select(F.concat(F.lit("../"), "name").alias("name"))).unionByName(names.select(F.concat("name", F.lit("X")).alias("name")))
    return services.registered(given, names)


SCANNED = [
    ("a<k>.py", "class A<k>:\n    def one(self):\n        return 1\nasync def two():\n    pass\n"),
    ("b<k>.py", "def broken<k>(:\n    pass\n"),
    ("C<k>.java", "class C<k> {\n  void a() {}\n  C<k>() { if (x) { y(); } }\n}\n"),
]


def _scanned(spark, d: str) -> DataFrame:
    part = t.read(spark, d, "part").selectExpr("p_partkey AS k")
    return _by(part, "k", SCANNED, "r<k % 4>").unionByName(_files(part.where("k % 50 = 0"), "r<k % 4>", "n<k>.go", "x").withColumn("content", F.lit(None).cast("string")))


@query("""WITH p AS (SELECT 'r'||(p_partkey % 4) AS repo, p_partkey AS k FROM part)
SELECT repo, count(*) FILTER (k % 3 <> 1) AS files, CAST(sum(CASE k % 3 WHEN 0 THEN 6 WHEN 1 THEN 3 ELSE 5 END) AS BIGINT) AS lines, CAST(sum(CASE k % 3 WHEN 1 THEN 0 ELSE 3 END) AS BIGINT) AS symbols, count(*) FILTER (k % 3 = 1) + count(*) FILTER (k % 50 = 0) AS skipped FROM p GROUP BY 1""")
def scan_totals(spark, d: str) -> DataFrame:
    return build.totals(_scanned(spark, d))


@query("""SELECT 'r'||(p_partkey % 4) AS repo, 'b'||p_partkey||'.py' AS path, 1 AS line, 'SyntaxError' AS error FROM part WHERE p_partkey % 3 = 1""")
def scan_errors(spark, d: str) -> DataFrame:
    return extract.errors(shared(extract.facts(_scanned(spark, d))))


@query("""SELECT 'x'||s_suppkey AS file, array_to_string(list_sort(['Big'||s_suppkey, 'big'||s_suppkey, 'shop.p'||(s_suppkey % 3)||'.Big'||s_suppkey]), ' ') AS identifiers FROM supplier""")
def sorted_identifiers(spark, d: str) -> DataFrame:
    rows = t.read(spark, d, "supplier").selectExpr("s_suppkey AS s")
    files = _files(rows, "r", "x<s>.java", "package shop.p<s % 3>;\npublic class Big<s> {}\n")
    return relations.identifiers(shared(extract.facts(files))).select(F.regexp_extract("file", r":(x\d+)\.java$", 1).alias("file"), F.array_join("identifiers", " ").alias("identifiers"))


@query("""WITH s AS (SELECT 'g'||(p_partkey % 40) AS repo, 'key'||(p_partkey % 60) AS process_key, p_partkey % 40 % 3 = 0 AND p_partkey % 60 % 2 = 0 AS found FROM part),
g AS (SELECT repo, bool_or(found) AS linked FROM s GROUP BY 1) SELECT repo, string_agg(DISTINCT process_key, ', ' ORDER BY process_key) AS keys FROM s JOIN g USING (repo) WHERE NOT linked GROUP BY 1""")
def start_warnings(spark, d: str) -> DataFrame:
    """Repositories none of whose starts leads to a process."""
    starts = t.read(spark, d, "part").selectExpr("concat('g', p_partkey % 40) AS repo", "concat('key', p_partkey % 60) AS process_key", "CASE WHEN p_partkey % 40 % 3 = 0 AND p_partkey % 60 % 2 = 0 THEN 'p' END AS target")
    return coverage.start_warning(starts)


@query("""SELECT CAST((SELECT count(*) FROM orders o JOIN part p ON o.o_orderkey % 500 = p.p_partkey) + (SELECT count(*) FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % 500 + 100 WHERE o.o_custkey % 4 = 0 AND p.p_partkey % 2 = o.o_custkey % 2) AS BIGINT) AS stitched""")
def stitch_count(spark, d: str) -> DataFrame:
    """Orders as requests, parts as routes: those of the same path, and those of a path below a configured prefix."""
    orders, part = t.read(spark, d, "orders"), t.read(spark, d, "part")
    asked = orders.selectExpr("o_orderkey AS request_id", "'GET' AS method", "concat('/', o_orderkey % 500) AS path")
    routes = part.selectExpr("p_partkey AS route_id", "'GET' AS method", "concat('/', p_partkey) AS path")
    some = orders.where("o_custkey % 4 = 0").selectExpr("o_orderkey AS request_id", "'r' AS repo", "concat('s', o_custkey % 2) AS system", "'GET' AS method", "concat('/', o_orderkey % 500 + 100) AS path")
    below = part.selectExpr("p_partkey AS route_id", "concat('t', p_partkey % 2) AS repo", "'GET' AS method", "concat('/in/', p_partkey) AS path")
    mappings = t.read(spark, d, "region").where("r_regionkey < 2").selectExpr("'r' AS repo", "concat('s', r_regionkey) AS system", "'/in' AS path_prefix", "concat('t', r_regionkey) AS target_repo")
    return stitch.stitched(stitch.exact(asked, routes), stitch.configured_prefix(some, mappings, below))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT 'R:'||c_nationkey AS src, 'F:'||c_custkey AS dst, 'CONTAINS' AS type, NULL AS condition FROM customer UNION ALL SELECT 'F:'||o_custkey, 'Q:'||o_orderkey, 'MAKES_REQUEST', CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END FROM orders)),
r AS (SELECT 'R:3' AS node, 0 AS n UNION ALL SELECT dst, n + 1 FROM r JOIN e ON src = node WHERE n < 2), l AS (SELECT * FROM e WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r))
SELECT (SELECT count(DISTINCT node) FROM r) AS nodes, count(*) AS links, count(condition) AS alternatives FROM l""")
def trace_totals(spark, d: str) -> DataFrame:
    customer, orders = t.read(spark, d, "customer"), t.read(spark, d, "orders")
    edges = customer.selectExpr("concat('R:', c_nationkey) AS src", "concat('F:', c_custkey) AS dst", "'CONTAINS' AS type", "CAST(NULL AS STRING) AS trust_status", "CAST(NULL AS STRING) AS condition").unionByName(
        orders.selectExpr("concat('F:', o_custkey) AS src", "concat('Q:', o_orderkey) AS dst", "'MAKES_REQUEST' AS type", "CAST(NULL AS STRING) AS trust_status", "CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS condition"))
    seed = t.read(spark, d, "nation").where("n_nationkey = 3").select(F.concat(F.lit("R:"), F.col("n_nationkey").cast("string")).alias("node"))
    edges = shared(traversable(edges))
    return coverage.trace_stats(edges, reach(edges, seed, 2))
