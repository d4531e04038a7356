"""Steps whose cost must grow no faster than their input: what is read or moved once."""

from pyspark.sql import functions as F

from lodemap.operators import controllers, extract, relations
from lodemap.plans import catalog, code  # noqa: F401  the catalogue comes first

BPMN = """<x:definitions xmlns:x="urn:x"><x:process id="p&amp;q"><x:subProcess><x:userTask id="a" f:delegateExpression="#{one}"/></x:subProcess><x:callActivity id="b" calledElement="other"/>
<x:callActivity calledElement="no"/><x:inclusiveGateway id="g" default="f2"/><x:sequenceFlow sourceRef="a" targetRef="b"/><x:sequenceFlow id="f1" sourceRef="b" targetRef="g"><x:documentation>d</x:documentation>
<x:conditionExpression> <![CDATA[${n < 1}]]> </x:conditionExpression></x:sequenceFlow><x:sequenceFlow id="f2" sourceRef="g"/></x:process><process id="second"><endEvent id="z"/></process></x:definitions>"""


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_process_is_parsed_once_for_its_steps_and_flows(spark):
    files = spark.createDataFrame([("r", "m.bpmn", BPMN), ("r", "broken.bpmn20.xml", '<process id="w"><startEvent id="s"/><a></process>'), ("r", "none.bpmn", None), ("r", "x.java", BPMN)], "repo string, path string, content string")
    steps, flows = extract.workflow(files)
    assert "xpath" not in _plan(steps) + _plan(flows) and "MapInArrow" not in _plan(steps) + _plan(flows)
    got = [tuple(r) for r in steps.orderBy("path", "process", "ordinal").select("path", "process", "ordinal", "step", "delegate", "called").collect()]
    assert got == [("broken.bpmn20.xml", "w", 0, "s", None, None), ("m.bpmn", "p&q", 0, "a", "one", None), ("m.bpmn", "p&q", 1, "b", None, "other"), ("m.bpmn", "p&q", 2, "g", None, None), ("m.bpmn", "second", 0, "z", None, None)]
    got = sorted(map(str, (tuple(r) for r in flows.select("flow", "source", "target", "condition", "is_default").collect())))
    assert got == ["('f1', 'b', 'g', '${n < 1}', False)", "('f2', 'g', None, None, True)", "(None, 'a', 'b', None, None)"]


def test_actions_and_pages_of_a_file_meet_without_a_join(spark):
    view = '@SpringView("v")\nclass V {\n  void a() {\n    x.addClickListener(e -> { d.setEnabled(true); }); y.addClickListener(e -> { d.setEnabled(false); });\n  }\n}\n'
    files = spark.createDataFrame([("r", "V.java", view), ("r", "W.java", view.split("\n", 1)[1])], "repo string, path string, content string")
    found = relations.actions(extract.facts(files, ["action", "page"]))
    assert "Join" not in _plan(found)
    assert sorted((r.id, r.page_id, r.effects) for r in found.where("page_id is not null").collect()) == [("r:V.java::action:x:click:4", "r:V.java", ["d.setEnabled(true)"]), ("r:V.java::action:y:click:4", "r:V.java", ["d.setEnabled(false)"])]
    assert found.where("page_id is null").count() == 2


def test_superclasses_put_the_facts_of_a_file_together_once(spark):
    rows = [("A.java", "package p;\nimport lib.Base;\nimport lib2.Base;\nclass A extends Base {}\nclass B extends A {}\nclass C {}\n"), ("D.java", "package p;\nclass D extends A {}\nclass E extends q.A {}\nclass F extends Gone {}\n"), ("G.java", "class G extends FlowController {}\n")]
    facts = extract.facts(spark.createDataFrame([("r", *r) for r in rows], "repo string, path string, content string"), controllers.KINDS)
    found = controllers.superclasses(facts)
    assert _plan(found).count("Join ") == 1
    got = {r.name: (r.node, r.next) for r in found.select("name", F.replace("node", F.lit("\x1f"), F.lit("|")).alias("node"), F.replace("next", F.lit("\x1f"), F.lit("|")).alias("next")).collect()}
    assert got == {"A": ("r|p.A", "r|lib.Base"), "B": ("r|p.B", "r|p.A"), "C": ("r|p.C", None), "D": ("r|p.D", "r|p.A"), "E": ("r|p.E", "r|q.A"), "F": ("r|p.F", "r|Gone"), "G": ("r|G", "base 2")}
