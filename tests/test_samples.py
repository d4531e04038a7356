"""A small sample of sources, whose expected rows are written by hand as SQL."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import DataFrame

from lodemap.operators import extract, relations, systems
from lodemap.operators.traverse import shared
from oracle import same

QUERIES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


VIEW = '''package ui.desk;
import depot.core.Stock;
@Route("boxes")
public class BoxView {
  private static final String FLOW = "refill";
  @Value("${desk.channel:box.moved}")
  private String moved;
  private Stock stock;
  String flowKey() {
    return FLOW;
  }
  void refill(FlowService flows, long n) {
    if (stock.low(n) &&
        n > 0) {
      flows.startProcess(flowKey(), n);
    } else {
      kafkaTemplate.send(moved, n);
    }
  }
  void watch() {
    String url = base + "/boxes/" + id;
    rest.getForObject(url, Box.class);
    rest.exchange("/boxes", HttpMethod.POST, null, Box.class);
    list.addSelectionListener(this);
  }
}
'''
STOCK = '''package depot.core;
public class Stock {
  boolean low(long n) {
    return false;
  }
  @KafkaListener(topics = "box.moved")
  public void onMoved(String box) {
  }
  Binding bound() {
    return BindingBuilder.bind(queue).to(exchange).with("box.key");
  }
  String queue = "box.queue";
}
@FeignClient("crates")
@RequestMapping("/crates")
interface Crates {
  @GetMapping("/{id}")
  Crate one(long id);
}
public class RefillWorker implements JavaDelegate {
  public void execute() {
  }
}
'''
MODEL = '''<definitions xmlns:f="urn:f"><process id="refill"><startEvent id="a"/><serviceTask id="b" f:delegateExpression="${refillWorker}"/>
<callActivity id="c" calledElement="count"/><sequenceFlow id="x" sourceRef="a" targetRef="b"/><sequenceFlow id="y" sourceRef="b" targetRef="c"/></process>
<process id="count"><startEvent id="a"/></process></definitions>'''
GO = '''package main
func mount(r *gin.Engine) {
\tv1 := r.Group("/v1")
\tbins := v1.Group("/bins", auth)
\tbins.GET("", h.List)
\tbins.PUT("/:id", h.Put)
\tr.GET("/live", h.Live)
}
'''
TS = '''const bins = axios.create({ baseURL: "https://bins.example:81/v1" });
export function load() {
  bins.get("/bins");
}
'''
SETTINGS = """spring.datasource.url=jdbc:mysql://me:pw@db:3306/x
spring.cache.type=redis
spring.mail.host=mail.example
spring.mail.port=2525
shop.provider=stripe
crates.url=http://me:pw@crates.example:90/api?key=1
"""
FILES = [("ui", "BoxView.java", VIEW), ("depot", "Stock.java", STOCK), ("depot", "refill.bpmn", MODEL), ("depot", "main.go", GO), ("web", "bins.ts", TS), ("depot", "app.properties", SETTINGS), ("depot", "gone.py", None), ("depot", "empty.py", "")]


_WRITTEN: dict[str, DataFrame] = {}


def files(spark) -> DataFrame:
    return spark.createDataFrame(FILES, "repo string, path string, content string")


def _facts(spark) -> DataFrame:
    """The resolved facts, written once for the session: every query reads them from there."""
    key = spark.sparkContext.applicationId
    if key not in _WRITTEN:
        _WRITTEN[key] = shared(extract.resolved(shared(extract.facts(files(spark)))))
    return _WRITTEN[key]


@query("""SELECT * FROM (VALUES ('depot', 'main.go', 'GET', '/v1/bins', 'List'), ('depot', 'main.go', 'PUT', '/v1/bins/{param}', 'Put'), ('depot', 'main.go', 'GET', '/live', 'Live')) t(repo, path, method, path_form, handler)""")
def extracted_routes(spark, d: str) -> DataFrame:
    return _facts(spark).where("kind = 'route'").select("repo", "path", "method", "path_form", "handler")


@query("""SELECT * FROM (VALUES ('ui', 'GET', '/boxes/{param}', '', 'BoxView.watch()'), ('ui', 'POST', '/boxes', '', 'BoxView.watch()'), ('depot', 'GET', '/crates/{param}', '', NULL),
('web', 'GET', '/v1/bins', 'bins.example:81', 'load')) t(repo, method, path_form, system, owner)""")
def extracted_requests(spark, d: str) -> DataFrame:
    found = _facts(spark).where("kind = 'request'")
    return found.selectExpr("repo", "method", "path_form", "system", "CASE WHEN repo <> 'depot' THEN function END AS owner")


@query("""SELECT * FROM (VALUES ('ui:BoxView.java::BoxView.refill(FlowService,long)', 'depot.core.Stock', 'low', NULL, 'depot:Stock.java::Stock.low(long)'),
('ui:BoxView.java::BoxView.refill(FlowService,long)', 'FlowService', 'startProcess', 'stock.low(n) && n > 0', NULL)) t(function_id, target_type, target_method, condition, target)""")
def resolved_calls(spark, d: str) -> DataFrame:
    return relations.calls(_facts(spark)).select("function_id", "target_type", "target_method", "condition", "target")


@query("""SELECT * FROM (VALUES ('ui:BoxView.java', 'depot:Stock.java::Stock', 'ui')) t(src, dst, repo)""")
def resolved_imports(spark, d: str) -> DataFrame:
    return relations.imports(_facts(spark))


@query("""SELECT * FROM (VALUES ('ui:BoxView.java::BoxView.refill(FlowService,long)', 'ui:channel:kafka:box.moved', 'PUBLISHES_TO'), ('depot:channel:kafka:box.moved', 'depot:Stock.java::Stock.onMoved(String)', 'CONSUMED_BY'),
('depot:channel:rabbitmq:box.key', 'depot:channel:rabbitmq:box.queue', 'ROUTES_TO'), ('depot:channel:kafka:box.moved', 'ui:channel:kafka:box.moved', 'SAME_CHANNEL')) t(src, dst, type)""")
def message_channels(spark, d: str) -> DataFrame:
    return relations.channels(_facts(spark)).select("src", "dst", "type")


@query("""SELECT * FROM (VALUES ('refill', 'refill::step:a', 'HAS_STEP'), ('refill', 'refill::step:b', 'HAS_STEP'), ('refill', 'refill::step:c', 'HAS_STEP'), ('count', 'count::step:a', 'HAS_STEP'),
('refill::step:a', 'refill::step:b', 'NEXT'), ('refill::step:b', 'refill::step:c', 'NEXT'), ('refill::step:b', 'depot:Stock.java::RefillWorker', 'INVOKES'), ('refill::step:c', 'count', 'CALLS')) t(src, dst, type)""")
def workflow_links(spark, d: str) -> DataFrame:
    found = relations.workflow(_facts(spark), *extract.workflow(files(spark)))
    return found.selectExpr("replace(src, 'depot:refill.bpmn::process:', '') AS src", "replace(dst, 'depot:refill.bpmn::process:', '') AS dst", "type")


@query("""SELECT * FROM (VALUES ('ui:BoxView.java::process-start:refill:15', 'refill', 'depot:refill.bpmn::process:refill')) t(id, process_key, target)""")
def workflow_starts(spark, d: str) -> DataFrame:
    return relations.starts(_facts(spark), extract.workflow(files(spark))[0]).select("id", "process_key", "target")


@query("""SELECT * FROM (VALUES ('ui:BoxView.java::action:list:selection:24', 'ui:BoxView.java', 'ui:BoxView.java::BoxView.watch()')) t(id, page_id, function_id)""")
def ui_actions(spark, d: str) -> DataFrame:
    return relations.actions(_facts(spark)).select("id", "page_id", "function_id")


@query("""SELECT * FROM (VALUES ('depot', 'database', 'mysql', 'database', 'mysql', 'depot:app.properties:1'), ('depot', 'cache', 'redis', 'cache', 'redis', 'depot:app.properties:2'), ('depot', 'email', 'smtp', 'email', 'mail.example:2525', 'depot:app.properties:3'),
('depot', 'payment', 'stripe', 'payment-gateway', 'stripe', 'depot:app.properties:5'), ('depot', 'http', 'http', 'service', 'crates.example:90', 'depot:app.properties:6'), ('web', 'http', 'http', 'service', 'bins.example:81', 'web:bins.ts:1')) t(repo, kind, technology, role, name, first)""")
def system_boundary(spark, d: str) -> DataFrame:
    return systems.boundary(_facts(spark)).select("repo", "kind", "technology", "role", "name", "first")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sample(spark, data, name):
    f, sql = QUERIES[name]
    assert same(f(spark, data), duckdb.connect(), sql)
