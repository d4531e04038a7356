"""The query catalogue: each operator over the driver's tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.functions import secrets, urls
from lodemap.operators import coverage, decisions, resolve, search, stitch, sync, systems, traverse, trust
from lodemap.sources import tables as t

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Register a function of (spark, sf_dir) under its name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _normal(x: str) -> str:
    for pattern, to in urls.NORMAL_FORM:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return x


_HOST = f"regexp_extract(url, '{urls.AUTHORITY}', 1)"
_TRUST = "CASE l_returnflag WHEN 'A' THEN 'VALIDATED' WHEN 'N' THEN 'SUGGESTED' WHEN 'R' THEN 'REJECTED' END"
_EDGES = f"""(SELECT 'R:'||c_nationkey AS src, 'F:'||c_custkey AS dst, 'CONTAINS' AS type, NULL::VARCHAR AS trust_status FROM customer
UNION ALL SELECT 'F:'||o_custkey, 'Q:'||o_orderkey, 'MAKES_REQUEST', NULL FROM orders
UNION ALL SELECT 'Q:'||l_orderkey, 'P:'||l_partkey, 'TARGETS_ROUTE', {_TRUST} FROM lineitem
UNION ALL SELECT 'P:'||l_partkey, 'S:'||l_suppkey, 'USES_SYSTEM', NULL FROM lineitem)"""
_NODES = """(SELECT 'R:'||n_nationkey AS id, 'Repository' AS label, n_name AS name, n_name AS repo FROM nation
UNION ALL SELECT 'F:'||c_custkey, 'CodeFile', 'file-'||c_custkey, n_name FROM customer JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT 'Q:'||o_orderkey, 'APIEndpoint', 'request-'||o_orderkey, n_name FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey
UNION ALL SELECT 'P:'||p_partkey, 'BackendRoute', p_name, NULL FROM part
UNION ALL SELECT 'S:'||s_suppkey, 'ExternalSystem', s_name, NULL FROM supplier)"""


@query("""WITH v AS (SELECT l_orderkey, max(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) ok FROM lineitem GROUP BY l_orderkey)
SELECT n_name AS repo, count(*) AS requests, count(v.l_orderkey) AS candidates, CAST(coalesce(sum(ok),0) AS BIGINT) AS resolved,
count(*) - CAST(coalesce(sum(ok),0) AS BIGINT) AS unresolved, round(CAST(100.0 AS DOUBLE)*coalesce(sum(ok),0)/count(*),1) AS coverage
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN v ON o_orderkey=v.l_orderkey GROUP BY n_name""")
def coverage_by_repo(spark, d: str) -> DataFrame:
    return coverage.overview(t.requests(spark, d), t.candidates(spark, d))


@query(f"""SELECT n_name AS repo, {_TRUST} AS trust_status, count(*) AS links FROM lineitem JOIN orders ON l_orderkey=o_orderkey
JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey GROUP BY 1, 2""")
def trust_status_counts(spark, d: str) -> DataFrame:
    return trust.status_counts(t.requests(spark, d), t.candidates(spark, d))


@query(f"""SELECT o_orderkey AS id, n_name AS repo, count(l_orderkey) AS candidates, count(*) FILTER (l_returnflag='N') AS suggested, count(*) FILTER (l_returnflag='R') AS rejected
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN lineitem ON l_orderkey=o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey=o_orderkey AND x.l_returnflag='A') GROUP BY 1, 2 ORDER BY 1 LIMIT {coverage.MOST_UNRESOLVED}""")
def unresolved_requests(spark, d: str) -> DataFrame:
    return coverage.unresolved(t.requests(spark, d), t.candidates(spark, d))


@query(f"SELECT page_id, {_normal('url')} AS path FROM pages")
def normalize_page_urls(spark, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("path"))


@query(r"SELECT page_id, regexp_replace(regexp_replace(url, '://[^/@?#]*@', '://', 'g'), '[?#].*$', '', 'g') AS url FROM pages")
def sanitize_urls(spark, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", urls.sanitize_url(F.col("url")).alias("url"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', '', 'g'), '{urls.LEADING_AUTHORITY}', '', 'g'), '/+$', '', 'g') AS prefix FROM pages")
def service_prefix(spark, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", urls.service_path_prefix(F.col("url")).alias("prefix"))


@query(f"SELECT {_HOST} AS system, count(*) AS uses FROM pages WHERE {_HOST} <> '' GROUP BY 1")
def system_hosts(spark, d: str) -> DataFrame:
    return systems.hosts(t.read(spark, d, "pages"))


@query(f"SELECT page_id, link, count(*) AS uses FROM (SELECT page_id, unnest(regexp_extract_all(html, '{systems.LINK}', 1)) AS link FROM pages) GROUP BY 1, 2")
def extract_links(spark, d: str) -> DataFrame:
    return systems.links(t.read(spark, d, "pages"))


def _page_paths(spark, d: str) -> DataFrame:
    return t.read(spark, d, "pages").select("page_id", urls.system(F.col("url")).alias("repo"), urls.normalize_url(F.col("url")).alias("path"), F.lit("GET").alias("method"))


_PAGES = f"(SELECT page_id, {_HOST} AS repo, {_normal('url')} AS path FROM pages)"


@query(f"""WITH links AS (SELECT DISTINCT page_id, {_normal('link')} AS path FROM (SELECT page_id, unnest(regexp_extract_all(html, '{systems.LINK}', 1)) AS link FROM pages)),
routes AS (SELECT 'R:'||n_nationkey AS route_id, '/'||lower(w) AS path FROM nation, (SELECT DISTINCT trim(path, '/') AS w FROM links) WHERE hash(w) IS NOT NULL AND n_nationkey = length(w) % 25)
SELECT page_id AS request_id, route_id, 'SUGGESTED' AS trust_status, 'exact' AS resolution FROM links JOIN routes USING (path) GROUP BY ALL""")
def stitch_exact(spark, d: str) -> DataFrame:
    """Links of pages with routes that the repositories have for them, in lower case."""
    found = systems.links(t.read(spark, d, "pages")).select(F.col("page_id").alias("request_id"), F.lit("GET").alias("method"), urls.normalize_url(F.col("link")).alias("path")).distinct()
    word = found.select(F.expr("trim(BOTH '/' FROM path)").alias("w")).distinct()
    routes = word.select(F.concat(F.lit("R:"), (F.length("w") % 25).cast("string")).alias("route_id"), F.lit("GET").alias("method"), F.concat(F.lit("/"), F.lower("w")).alias("path"))
    return stitch.exact(found, routes)


@query(f"""WITH p AS {_PAGES}, routes AS (SELECT DISTINCT repo||':'||regexp_extract(path, '^/[^/]*', 0) AS route_id, repo, regexp_extract(path, '^/[^/]*', 0)||'/' AS prefix FROM p)
SELECT DISTINCT page_id AS request_id, route_id, 'SUGGESTED' AS trust_status, 'catch-all' AS resolution FROM p JOIN routes ON p.repo = routes.repo AND starts_with(p.path, routes.prefix)""")
def stitch_catchall(spark, d: str) -> DataFrame:
    """Pages below the first part of a path of their own host."""
    pages = _page_paths(spark, d)
    first = F.regexp_extract("path", "^/[^/]*", 0)
    routes = pages.select(F.concat("repo", F.lit(":"), first).alias("route_id"), "repo", "method", F.concat(first, F.lit("/[...rest]")).alias("route_path")).distinct()
    return stitch.catch_all(pages.withColumnRenamed("page_id", "request_id"), routes)


@query(f"""WITH p AS {_PAGES}, mappings(system, path_prefix, target_repo) AS (VALUES ('0', '/en', NULL), ('1', '/fr', NULL), ('2', '/de', '1'))
SELECT DISTINCT e.page_id AS request_id, r.page_id AS route_id, 'SUGGESTED' AS trust_status, 'configured-prefix' AS resolution
FROM p e JOIN mappings m ON CAST(e.page_id % 4 AS VARCHAR) = m.system
JOIN p r ON r.path = m.path_prefix || regexp_replace(e.path, '^/[^/]*', '', 'g') AND (m.target_repo IS NULL OR m.target_repo = CAST(r.page_id % 2 AS VARCHAR))""")
def stitch_configured_prefix(spark, d: str) -> DataFrame:
    """Pages whose path below its first part stands under a configured prefix elsewhere."""
    pages = _page_paths(spark, d)
    asked = pages.select(F.col("page_id").alias("request_id"), F.lit("r").alias("repo"), (F.col("page_id") % 4).cast("string").alias("system"), "method", F.regexp_replace("path", "^/[^/]*", "").alias("path"))
    mappings = spark.createDataFrame([("r", "0", "/en", None), ("r", "1", "/fr", None), ("r", "2", "/de", "1")], "repo string, system string, path_prefix string, target_repo string")
    routes = pages.select(F.col("page_id").alias("route_id"), (F.col("page_id") % 2).cast("string").alias("repo"), "method", "path")
    return stitch.configured_prefix(asked, mappings, routes)


_PAIRS = """pairs AS (SELECT o_orderkey src, s_suppkey cand, c_nationkey src_repo, s_nationkey cand_repo FROM orders JOIN customer ON o_custkey=c_custkey JOIN lineitem ON l_orderkey=o_orderkey JOIN supplier ON l_suppkey=s_suppkey),
g AS (SELECT src, count(DISTINCT CASE WHEN cand_repo=src_repo THEN cand END) lc, min(CASE WHEN cand_repo=src_repo THEN cand END) lm, count(DISTINCT cand) ac, min(cand) am FROM pairs GROUP BY src)"""


@query(f"WITH {_PAIRS} SELECT src, CASE WHEN lc=1 THEN lm WHEN lc>1 THEN NULL WHEN ac=1 THEN am END AS target FROM g")
def unique_candidate_supplier(spark, d: str) -> DataFrame:
    return resolve.unique_candidate(t.supplier_pairs(spark, d))


@query(f"WITH {_PAIRS} SELECT src, CASE WHEN lc>0 THEN lc ELSE ac END AS candidates FROM g WHERE CASE WHEN lc>0 THEN lc ELSE ac END > 1")
def ambiguous_candidates(spark, d: str) -> DataFrame:
    return resolve.ambiguous(t.supplier_pairs(spark, d))


@query("SELECT DISTINCT o_custkey AS src, l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey=o_orderkey")
def composed_links(spark, d: str) -> DataFrame:
    orders = t.read(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    line = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return resolve.compose(orders, line)


@query("""WITH u AS (SELECT DISTINCT n_name AS repo, o_orderpriority AS channel FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)
SELECT a.repo AS repo_a, b.repo AS repo_b, count(*) AS channels FROM u a JOIN u b USING (channel) WHERE a.repo < b.repo GROUP BY 1, 2""")
def same_channel(spark, d: str) -> DataFrame:
    orders = t.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("channel")).distinct()
    return resolve.same_channel(orders.join(t.files(spark, d), "id"))


@query("""WITH r AS (SELECT DISTINCT conv_id AS line, turn AS step FROM conversations), x AS (SELECT line, step, step - row_number() OVER (PARTITION BY line ORDER BY step) AS run FROM r)
SELECT line, step, min(step) OVER (PARTITION BY line, run) AS root, step - min(step) OVER (PARTITION BY line, run) AS depth FROM x""")
def lineage_chain(spark, d: str) -> DataFrame:
    return decisions.lineage(t.read(spark, d, "conversations").select(F.col("conv_id").alias("line"), F.col("turn").alias("step")))


@query("""SELECT line, step, author, superseded FROM (SELECT conv_id AS line, turn AS step, role AS author, count(*) OVER (PARTITION BY conv_id) - 1 AS superseded,
row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS n FROM conversations) WHERE n = 1""")
def active_decisions(spark, d: str) -> DataFrame:
    return decisions.active(t.read(spark, d, "conversations").select(F.col("conv_id").alias("line"), F.col("turn").alias("step"), F.col("role").alias("author")))


@query(f"""WITH e AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM {_EDGES} UNION ALL SELECT dst, src FROM {_EDGES})),
h AS (SELECT 'F:1' AS node, 0 AS distance UNION ALL SELECT dst, 1 FROM e WHERE src='F:1' UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON a.dst=b.src WHERE a.src='F:1')
SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM h GROUP BY node""")
def two_hop_neighbourhood(spark, d: str) -> DataFrame:
    return traverse.two_hops(t.edges(spark, d), spark.createDataFrame([("F:1",)], "node string"))


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {_EDGES} WHERE type <> 'TARGETS_ROUTE' OR trust_status = 'VALIDATED'),
r AS (SELECT 'R:1' AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON node = src WHERE distance < 4)
SELECT node, CAST(min(distance) AS INTEGER) AS distance FROM r GROUP BY node""")
def bfs_reachability(spark, d: str) -> DataFrame:
    return traverse.reach(trust.traversable(t.edges(spark, d)), spark.createDataFrame([("R:1",)], "node string"), depth=4)


@query(f"""WITH e AS {_EDGES}, n AS (SELECT id FROM {_NODES} WHERE repo = 'CHINA' OR label IN ('BackendRoute', 'ExternalSystem'))
SELECT type, trust_status, count(*) AS links FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1, 2""")
def induced_subgraph(spark, d: str) -> DataFrame:
    nodes = t.nodes(spark, d).where((F.col("repo") == "CHINA") | F.col("label").isin("BackendRoute", "ExternalSystem")).select(F.col("id").alias("node"))
    return traverse.induced(t.edges(spark, d), nodes).groupBy("type", "trust_status").agg(F.count("*").alias("links"))


@query(f"""WITH e AS {_EDGES} SELECT DISTINCT node, direction, type, other FROM (SELECT src AS node, 'out' AS direction, type, dst AS other FROM e UNION ALL SELECT dst, 'in', type, src FROM e) WHERE node IN ('P:1', 'S:1')""")
def node_neighbours(spark, d: str) -> DataFrame:
    return traverse.neighbours(t.edges(spark, d), spark.createDataFrame([("P:1",), ("S:1",)], "node string"))


@query(f"SELECT label, count(*) AS nodes FROM {_NODES} GROUP BY 1")
def label_counts(spark, d: str) -> DataFrame:
    return t.nodes(spark, d).groupBy("label").agg(F.count("*").alias("nodes"))


@query(f"SELECT type, count(*) AS links FROM {_EDGES} GROUP BY 1")
def relationship_counts(spark, d: str) -> DataFrame:
    return t.edges(spark, d).groupBy("type").agg(F.count("*").alias("links"))


@query(f"SELECT coalesce(repo, '') AS repo, count(*) AS nodes FROM {_NODES} GROUP BY 1")
def repo_nodes(spark, d: str) -> DataFrame:
    return t.nodes(spark, d).groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count("*").alias("nodes"))


@query("SELECT n_name AS repo, count(c_custkey) AS files FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def list_repositories(spark, d: str) -> DataFrame:
    counted = t.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("files"))
    nation = t.read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("repo"))
    return nation.join(counted, "n_nationkey", "left").select("repo", F.coalesce("files", F.lit(0).cast("long")).alias("files"))


@query(f"SELECT * FROM {_NODES} WHERE contains(lower(name), '42') ORDER BY name, id LIMIT 50")
def search_topk(spark, d: str) -> DataFrame:
    return search.search(t.nodes(spark, d), "42")


@query(f"""SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {_EDGES} WHERE type <> 'TARGETS_ROUTE' OR trust_status = 'VALIDATED'
UNION ALL SELECT dst FROM {_EDGES} WHERE type <> 'TARGETS_ROUTE' OR trust_status = 'VALIDATED') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def hotspots(spark, d: str) -> DataFrame:
    return traverse.hotspots(trust.traversable(t.edges(spark, d)))


@query(f"""WITH lanes(label, lane) AS (VALUES ('APIEndpoint', 'HTTP'), ('BackendRoute', 'Backend'), ('ExternalSystem', 'External'))
SELECT coalesce(lane, 'Other') AS lane, count(*) AS nodes FROM {_NODES} LEFT JOIN lanes USING (label) GROUP BY 1""")
def lane_counts(spark, d: str) -> DataFrame:
    lanes = spark.createDataFrame([("APIEndpoint", "HTTP"), ("BackendRoute", "Backend"), ("ExternalSystem", "External")], "label string, lane string")
    return traverse.lanes(t.nodes(spark, d).select(F.col("id").alias("node"), "label"), lanes)


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def prune_missing(spark, d: str) -> DataFrame:
    """Customers without an urgent order that is filled; not all have one."""
    present = t.read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return sync.missing(t.read(spark, d, "customer").select(F.col("c_custkey").alias("id")), present)


@query("""SELECT c_custkey AS id, c_nationkey AS owner FROM customer WHERE c_custkey % 5 NOT IN (0, 1) UNION ALL SELECT c_custkey, c_nationkey + 100 FROM customer WHERE c_custkey % 5 = 0""")
def sync_merge(spark, d: str) -> DataFrame:
    """A fifth of the stored rows changes, another is deleted."""
    stored = t.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("owner"))
    return sync.merge(stored, stored.where("id % 5 = 0").withColumn("owner", F.col("owner") + 100), stored.where("id % 5 = 1"))


@query("SELECT DISTINCT l_orderkey AS file_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def referencing_files(spark, d: str) -> DataFrame:
    references = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_partkey").alias("identifier"))
    return sync.referencing(references, t.read(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("identifier")))


# The SQL has its own patterns, for an engine without look-behind.
_ASSIGNED = r"""len(list_filter(list_zip(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_.-]*)["'']?\s*(?:=>|:=|=|:)\s*["'']([^"''\s]+)["'']', 1), regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_.-]*)["'']?\s*(?:=>|:=|=|:)\s*["'']([^"''\s]+)["'']', 2)),
lambda m : regexp_matches(lower(m[1]), '(pass|passwd|password|passphrase|pwd|secret|credential|credentials|token|apikey|(api|access|private|signing|client|secret)[_.-]?key)$') AND length(m[2]) >= 10 AND len(list_distinct(string_split(m[2], ''))) >= 6
AND NOT regexp_matches(lower(m[2]), '^([$%#]?\{.*\}|<.*>|\[.*\]|%.*%|\$\w+)$|example|sample|dummy|placeholder|change[_-]?(me|it)|your[_-]|fill[_-]?in|redacted'))) > 0"""
_HIT = {
    "private_key": "regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----')", "forge_token": r"regexp_matches(text, '\b(gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})')",
    "cloud_key": r"regexp_matches(text, '\bAKIA[0-9A-Z]{16}\b')", "bearer": r"regexp_matches(text, '(?i)\bbearer\s+[A-Za-z0-9._~+/-]{20,}')", "assigned": _ASSIGNED}


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind FROM documents WHERE {hit}" for k, hit in _HIT.items()))
def secret_audit(spark, d: str) -> DataFrame:
    docs = t.read(spark, d, "documents").select("doc_id", "text")
    kinds = F.array(*[F.when(secrets.found(F.col("text"), k), F.lit(k)) for k in secrets.KINDS])
    return docs.select("doc_id", F.explode(F.array_compact(kinds)).alias("kind"))


@query("SELECT user_id AS session_id, count(*) AS events, count(DISTINCT event_type) AS kinds, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1")
def session_events(spark, d: str) -> DataFrame:
    return t.read(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(
        F.count("*").alias("events"), F.count_distinct("event_type").alias("kinds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT doc_id, CAST(length(substr(text, 1, 100000)) AS BIGINT) AS kept, length(text) > 100000 AS cut FROM documents")
def payload_truncate(spark, d: str) -> DataFrame:
    return t.read(spark, d, "documents").select("doc_id", F.length(F.substring("text", 1, 100_000)).cast("long").alias("kept"), (F.length("text") > 100_000).alias("cut"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def event_props_json(spark, d: str) -> DataFrame:
    return t.read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


# Rules of evidence in plain texts.
RULES = [
    ("database", "postgresql", r"(?i)\b(?:postgres|psycopg|pg_trgm)\b"),
    ("cache", "redis", r"(?i)\bredis\b"),
    ("license", "license", r"(?i)\blicensed under\b"),
    ("contact", "email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z.]{2,}\b"),
    ("http", "url", r"https?://[A-Za-z0-9.-]+"),
]


@query(" UNION ALL ".join(f"SELECT doc_id AS id, '{k}' AS kind, '{tech}' AS technology FROM documents WHERE regexp_matches(text, '{p}')" for k, tech, p in RULES))
def rule_table_roles(spark, d: str) -> DataFrame:
    return systems.roles(t.read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), RULES)


@query("""SELECT key, id, score FROM (SELECT o_custkey AS key, o_orderkey AS id, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1""")
def seed_best_match(spark, d: str) -> DataFrame:
    return search.best_match(t.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score")))


@query(f"""SELECT o_orderkey AS id, n_name AS repo, l_suppkey AS candidate_route, s_nationkey AS candidate_repo, {_TRUST} AS candidate_trust
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey LEFT JOIN (lineitem JOIN supplier ON l_suppkey=s_suppkey) ON l_orderkey=o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey=o_orderkey AND x.l_returnflag='A') GROUP BY ALL""")
def unresolved_evidence(spark, d: str) -> DataFrame:
    found = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_suppkey").alias("route"), t.trust(F.col("l_returnflag")).alias("trust_status"))
    routes = t.read(spark, d, "supplier").select(F.col("s_suppkey").alias("route"), F.col("s_nationkey").alias("repo"))
    return coverage.evidence(t.requests(spark, d), found, routes)


@query("""WITH r AS (SELECT o_orderkey AS id, n_name AS repo, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='A') AS ok
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey), c AS (SELECT repo, count(*) FILTER (NOT ok) AS unresolved, count(*) AS requests FROM r GROUP BY 1),
f AS (SELECT repo, string_agg('request-'||id, '; ' ORDER BY id) AS first FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY id) AS n FROM r WHERE NOT ok) WHERE n <= 3 GROUP BY 1)
SELECT repo, unresolved, requests, unresolved||' of '||requests||' API requests do not have a validated backend route: '||first||CASE WHEN unresolved > 3 THEN '; +'||(unresolved - 3)||' more.' ELSE '.' END AS message FROM c JOIN f USING (repo)""")
def request_warnings(spark, d: str) -> DataFrame:
    asked = t.requests(spark, d).withColumn("label", F.concat(F.lit("request-"), F.col("id").cast("string")))
    return coverage.request_warning(asked, t.candidates(spark, d))


def _seed(spark, d: str) -> DataFrame:
    return t.read(spark, d, "nation").where("n_nationkey = 7").select(F.concat(F.lit("R:"), F.col("n_nationkey").cast("string")).alias("node"))


_NEAR = f"""e AS {_EDGES}, ok AS (SELECT * FROM e WHERE type <> 'TARGETS_ROUTE' OR trust_status = 'VALIDATED'), d1 AS (SELECT DISTINCT dst AS node FROM ok WHERE src = 'R:7'),
d2 AS (SELECT DISTINCT dst AS node FROM ok JOIN d1 ON src = node), d3 AS (SELECT DISTINCT dst AS node FROM ok JOIN d2 ON src = node),
reached AS (SELECT 'R:7' AS node, 0 AS distance UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2 UNION ALL SELECT node, 3 FROM d3)"""


@query(f"""WITH {_NEAR}, near AS (SELECT DISTINCT distance, src, dst, type FROM ok JOIN reached a ON src = a.node WHERE dst IN (SELECT node FROM reached))
SELECT *, (SELECT count(*) FROM near) AS total, (SELECT count(*) FROM near) > 1200 AS truncated FROM near ORDER BY distance, src, dst, type LIMIT 1200""")
def trace_limited(spark, d: str) -> DataFrame:
    edges = trust.traversable(t.edges(spark, d))
    return traverse.trace(edges, traverse.reach(edges, _seed(spark, d), 3), 1200)


@query(f"""WITH {_NEAR} SELECT dst AS system, min(distance) + 1 AS distance, count(DISTINCT src) AS uses FROM e JOIN reached ON src = node WHERE type = 'USES_SYSTEM' GROUP BY 1""")
def entry_point_systems(spark, d: str) -> DataFrame:
    edges = trust.traversable(t.edges(spark, d))
    return traverse.reached_systems(edges, traverse.reach(edges, _seed(spark, d), 3))


from lodemap.plans import code, records  # noqa: E402,F401  register their queries
