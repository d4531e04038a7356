"""Facts of sources by statements and functions, and the values behind names."""

import pytest

from lodemap.functions import source
from lodemap.operators import extract

JAVA = '''package shop.web;
import org.springframework.web.client.RestTemplate;
@RestController
@RequestMapping("${shop.base:store}/carts")
public class CartController {
    static final String KEY = "PRICE_API";
    static final String FLOW = "check_out";
    String host;
    CartController() { this.host = settings.getConfig(this.KEY).getValue(); }
    @RequestMapping(path = {"/p", "/q/{id}"}, method = RequestMethod.PUT)
    public void change(String id) {
        String url = host + "/prices/" + id;
        rest.exchange(
            url,
            HttpMethod.GET, null, String.class);
    }
    @GetMapping(value = "/all")
    public List<Cart> all() {
        String url = root() + "/lists"; client.getForObject(url, String.class); client.delete(url + "/old");
        return null;
    }
    String root() {
        if (far) { return "https://far.example:81/v2"; }
        return "https://near.example/v1";
    }
    void build(String id) {
        UriComponentsBuilder b = UriComponentsBuilder.fromHttpUrl(root()).path("/drop/" + id);
        rest.delete(b.build().toString());
        map.put("x", "y");
    }
    void twice(boolean on) {
        String url = "/first";
        url = "/second";
        if (on) { url = "/third"; }
        rest.getForEntity(url, String.class);
        flows.startProcess(Flows.MAIN);
        flows.startProcess(key(), 1);
    }
    String key() { return FLOW; }
    String loop() { return loop() + "/x"; }
    void round() { rest.getForObject(loop(), String.class); rest.getForObject(Paths.KNOWN + "/k", X.class); }
}
'''
OTHER = '''package shop.names;
public class Flows { public static final String MAIN = "main_flow"; }
class Paths { static final String KNOWN = "/known"; }
'''
GO = '''package pay
func (c *client) target() string {
    if c.test { return "https://test.example/pay" }
    return "https://live.example/pay"
}
func (c *client) send(ctx context.Context, order string) {
    http.NewRequestWithContext(ctx, http.MethodPost, c.target(), nil)
    url := c.conf.Base + "/orders/" + orderID
    http.NewRequest("GET", url, nil)
    check := fmt.Sprintf("%scheck/%s", c.conf.Base, orderID)
    http.NewRequest(http.MethodPut, check, nil)
    http.Get("https://plain.example/x")
}
'''
PY = '''import os, sys as system
from a.b import c
"""
@app.get("/in/string")
def hidden(): pass
"""
BASE = "https://api.example/v1"
def load(key):
    url = BASE + "/items/"
    httpx.get(
        url + key, timeout=3)
    return requests.post(f"{BASE}/n/{key}")
@app.get("/real")
async def real():
    """Calls requests.get("/not/this")"""
'''
TS = '''import { shopApi as api2, other } from "@/lib/clients";
const load = () => { fetch("/a", { method: "POST" }); fetch("/b"); axios.get("/c"); axios.put(`${TOP}/d/${id}`); };
const TOP = "/top";
export const go = () => api2.get<Row[]>("/rows");
export const gone = () => unknown.get("/nothing");
'''


def found(spark, rows):
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    return extract.resolved(extract.facts(files))


def requests(df):
    return {(r.method, r.path_form, r.system, r.function) for r in df.where("kind = 'request'").collect()}


def test_java_values_through_locals_fields_returns_and_builders(spark):
    df = found(spark, [("r", "web/CartController.java", JAVA), ("r", "names/Flows.java", OTHER)])
    cart = "CartController."
    assert requests(df) == {
        ("GET", "/prices/{param}", "PRICE_API", cart + "change(String)"),
        ("GET", "/v2/lists", "far.example:81", cart + "all()"), ("GET", "/v1/lists", "near.example", cart + "all()"),
        ("DELETE", "/v2/lists/old", "far.example:81", cart + "all()"), ("DELETE", "/v1/lists/old", "near.example", cart + "all()"),
        ("DELETE", "/v2/drop/{param}", "far.example:81", cart + "build(String)"), ("DELETE", "/v1/drop/{param}", "near.example", cart + "build(String)"),
        ("GET", "/second", "", cart + "twice(boolean)"), ("GET", "/third", "", cart + "twice(boolean)"),
        ("GET", "/x", "", cart + "round()"), ("GET", "/known/k", "", cart + "round()")}
    routes = {(r.method, r.path_form, r.handler) for r in df.where("kind = 'route'").collect()}
    assert routes == {("PUT", "/store/carts/p", cart + "change(String)"), ("PUT", "/store/carts/q/{param}", cart + "change(String)"), ("GET", "/store/carts/all", cart + "all()")}
    assert {r.name for r in df.where("kind = 'start'").collect()} == {"main_flow", "check_out"}


def test_go_requests_by_constants_variables_helpers_and_formats(spark):
    df = found(spark, [("r", "pay/client.go", GO)])
    assert {(r.method, r.url, r.system) for r in df.where("kind = 'request'").collect()} == {
        ("POST", "https://test.example/pay", "test.example"), ("POST", "https://live.example/pay", "live.example"),
        ("GET", "${c.conf.Base}/orders/${orderID}", "c.conf.Base"), ("PUT", "${c.conf.Base}check/{param}", "c.conf.Base"), ("GET", "https://plain.example/x", "plain.example")}


def test_python_docstrings_imports_and_calls_over_lines(spark):
    df = found(spark, [("r", "api.py", PY)])
    assert requests(df) == {("GET", "/v1/items/{param}", "api.example", "load"), ("POST", "/v1/n/{param}", "api.example", "load")}
    assert {r.path_form for r in df.where("kind = 'route'").collect()} == {"/real"}
    assert {r.member for r in df.where("kind = 'function'").collect()} == {"load", "real"}
    assert {r.name for r in df.where("kind = 'import'").collect()} == {"os", "sys", "a.b"}


def test_script_methods_several_calls_of_a_line_and_clients_of_other_modules(spark):
    clients = 'import axios from "axios";\nexport const inner = axios.create({\n  baseURL: "https://shop.example/v1",\n});\nexport { inner as shopApi };\n'
    index = 'export { shopApi } from "./http";\n'
    df = found(spark, [("r", "web/src/page.ts", TS), ("r", "web/src/lib/http.ts", clients), ("r", "web/src/lib/clients/index.ts", index.replace("./http", "../http"))])
    assert requests(df) == {("POST", "/a", "", "load"), ("GET", "/b", "", "load"), ("GET", "/c", "", "load"), ("PUT", "/top/d/{param}", "", "load"), ("GET", "/v1/rows", "shop.example", "go")}


def test_rewrites_name_the_system_of_the_longest_prefix(spark):
    config = 'const shop = process.env.SHOP_URL ?? "x";\nexport default { async rewrites() { return [\n{ source: "/api/:path*", destination: `${process.env.API_URL}/:path*` },\n{ source: "/api/shop/:path*", destination: `${shop}/:path*` },\n{ source: "/old", destination: "https://old.example/x" }]; } };\n'
    page = 'fetch("/api/shop/a?x=1"); fetch("/api/shopping"); fetch("/other"); fetch("/old"); fetch("/older");\n'
    df = found(spark, [("r", "next.config.ts", config), ("r", "src/a.ts", page), ("s", "src/a.ts", page)])
    assert {(r.repo, r.path_form, r.system) for r in df.where("kind = 'request'").collect()} == {
        ("r", "/api/shop/a", "SHOP_URL"), ("r", "/api/shopping", "API_URL"), ("r", "/other", ""), ("r", "/old", "old.example"), ("r", "/older", ""),
        *[("s", p, "") for p in ("/api/shop/a", "/api/shopping", "/other", "/old", "/older")]}


def test_groups_across_functions_and_packages(spark):
    main = 'package main\nimport pay "x.example/shop/internal/pay"\nfunc main() {\n  a := r.Group("/v1")\n  b := r.Group("/v2", auth())\n  pay.Mount(a)\n  pay.Mount(b)\n  r.GET("/live", live)\n}\n'
    pay = 'package pay\nfunc Mount(g *gin.RouterGroup) {\n  p := g.Group("/pay")\n  p.GET("/:id", one)\n  hooks(p)\n  round(p)\n}\nfunc round(g *gin.RouterGroup) { g.PUT("/round", x); again(g) }\nfunc again(g *gin.RouterGroup) { round(g) }\n'
    hooks = 'package pay\nfunc hooks(g *gin.RouterGroup) {\n  h := g.Group("/hooks")\n  h.POST("", hook)\n}\nfunc alone(g *gin.RouterGroup) { g.DELETE("/alone", x) }\n'
    rows = [("r", "go.mod", "module x.example/shop\n"), ("r", "cmd/main.go", main), ("r", "internal/pay/pay.go", pay), ("r", "internal/pay/hooks.go", hooks), ("s", "internal/pay/hooks.go", hooks)]
    routes = {(r.repo, r.method, r.path_form) for r in found(spark, rows).where("kind = 'route'").collect()}
    assert routes == {("r", "GET", "/live"), *[("r", *x) for v in ("/v1", "/v2") for x in (("GET", f"{v}/pay/{{param}}"), ("POST", f"{v}/pay/hooks"), ("PUT", f"{v}/pay/round"))], ("r", "DELETE", "/alone"), ("s", "POST", "/hooks"), ("s", "DELETE", "/alone")}


def test_effects_of_actions_with_their_conditions(spark):
    view = "@SpringView(name = BoxView.NAME)\nclass BoxView {\n  static final String NAME = \"boxes\";\n  void wire() {\n    if (open) {\n      list.addSelectionListener(e -> {\n        if (e.one()) {\n drop.setEnabled(true);\n } else {\n drop.setEnabled(false);\n }\n        title.setValue(\"x\");\n      });\n    }\n  }\n  void after() { drop.setVisible(true); }\n}\n"
    df = found(spark, [("r", "BoxView.java", view)]).cache()
    (action,) = df.where("kind = 'action'").collect()
    assert action.effects == ["if e.one(): drop.setEnabled(true)", "if NOT (e.one()): drop.setEnabled(false)", 'title.setValue("x")']
    assert action.function == "BoxView.wire()" and [r.name for r in df.where("kind = 'page'").collect()] == ["/boxes"]


@pytest.mark.parametrize("text", ["", "{", "}", '"', "if (", "class A {", "@", "@GetMapping(", 'x = "', "func (", "a" * 20_000, "(" * 5_000, "/* ", "'''", "`"])
def test_broken_texts_are_no_error(text):
    for suffix in ("java", "ts", "go", "py", "properties", "sql", "xml"):
        assert isinstance(extract._File("p", suffix, text).scan(), list)
        assert len(source.mask_comments(text, suffix)) == len(text)
