"""Extractors, framework rules and derived edges on small sources."""

import pytest

from codeloom.operators import channels
from codeloom.sources import frameworks, languages

SOURCES = {
    'a.rs':"use std::fs;\nstruct P { x: i32 }\ntrait Draw { fn draw(&self); }\nimpl Draw for P {\n  fn draw(&self) { if self.x > 0 { helper(1, 2) } // not(this)\n  }\n}\nfn helper(a: i32, b: i32) -> i32 { a + b }\n",
    'a.go':'package main\nimport "fmt"\ntype S struct { a int }\ntype I interface { Run() }\nfunc (s *S) Run() { fmt.Println("x(y)") }\nfunc main() { s := S{}; s.Run() }\n',
    'A.java':"import java.util.List;\npublic class A extends B implements C {\n  public int run(int x, String y) {\n    for (;;) { if (x > 0 && y != null) { go(x); } }\n  }\n  private void go(int x) { }\n}\n",
    'a.ts':"import { x } from './x';\ninterface Q {}\nexport class K extends L {\n  async load(a: string): Promise<void> { await fetchIt(a); }\n}\nconst go = (a) => { run(a) };\nfunction run(z) { return z ? 1 : 2 }\n",
    'a.py':"import os\nfrom a.b import c\nclass X(Y):\n    def f(self, a):\n        if a:\n            return g(a)\n\ndef g(a):\n    return '''h(1)'''\n",
    'a.rb':"require 'set'\nclass W < Base\n  def perform(x)\n    if x\n      helper(x)\n    end\n  end\nend\ndef helper(x)\n  x\nend\n",
    'a.lua':"local m = require('mod')\nfunction m.go(a)\n  if a then run(a) end\nend\nlocal function run(b)\n return b end\n",
    'a.cs':"using System;\nnamespace N {\n public class A : B {\n  public async Task<int> Run(int x) { return Go(x); }\n  int Go(int x) { return x; }\n }\n}\n",
    'a.cpp':"#include <v.h>\nclass D : public B {\n public:\n  void f() { g(); }\n};\nint g(int a) { return a; }\n",
    'a.kt':"import x.y\nclass A : B() {\n fun f(a: Int) { g(a) }\n}\nfun g(a: Int) = 1\n",
    'a.swift':"import UIKit\nclass A: B {\n func f() { g() }\n}\nfunc g() {}\n",
    'a.php':"<?php\nuse A\\B;\nclass C extends D { public function f($x) { return g($x); } }\nfunction g($x) { return 1; }\n",
    'a.vb':"Imports System\nPublic Class A\n Inherits B\n Public Sub F(x As Integer)\n  G(x)\n End Sub\n Function G(x)\n End Function\nEnd Class\n",
    'a.erl':"-module(m).\n-behaviour(gen_server).\ninit(A) -> go(A).\ngo(X) -> X.\n",
    'a.vue':"<template><my-child @click=\"go\"/></template>\n<script>\nimport a from 'a'\nexport default {\n methods: {\n  go(x) { run(x) }\n }\n}\nfunction run(y) {}\n</script>\n",
    'm.xml':'<mapper namespace="a.b.UserMapper">\n<select id="find" resultType="User">select</select>\n</mapper>',
    'f.dfm':"object Form1: TForm1\n  OnClick = DoClick\nend\n",
    'a.tf':'resource "aws_x" "y" {\n  a = var.region\n}\nmodule "m" { source = "./m" }\nvariable "region" {}\n',
    'a.sol':"import './b.sol';\ncontract T is Base {\n function f(uint a) public { g(a); }\n function g(uint a) internal {}\n}\n",
    'a.cbl':"       PROGRAM-ID. MAINP.\n       MAIN-PARA.\n           PERFORM SUB-PARA.\n           CALL 'OTHER'.\n       SUB-PARA.\n           STOP RUN.\n",
    'a.dart':"import 'x.dart';\nclass A extends B {\n void f(int x) { g(x); }\n}\nvoid g(int x) { }\n",
    'a.pas':"uses SysUtils;\ntype\n  TA = class(TB)\n  end;\nprocedure TA.Go(x: Integer);\nbegin\n  Run(x);\nend;\n",
    'a.sh':"source lib.sh\ngo() {\n  run x\n}\nrun() { echo; }\n",'a.r':"library(x)\nf <- function(a) { g(a) }\ng <- function(b) { b }\n",'a.nix':"{ f = x: import ./b.nix; }\n",'a.m':"#import <X.h>\n@implementation A\n- (void)go { [self run]; }\n- (void)run { }\n@end\n",
    'a.scala':"import a.b\nobject O extends P {\n def f(x: Int): Int = { g(x) }\n def g(x: Int): Int = { x }\n}\n",'a.move':"module M {\n use std::x;\n fun f() { g() }\n fun g() {}\n}\n",'a.vy':"import x\ndef f(a: uint256):\n    self.g(a)\n\ndef g(a: uint256):\n    pass\n",
    'a.ets':"struct A {\n build() { this.go() }\n go() { }\n}\n",'a.cls':"public class A extends B { public static void f(Integer x) { g(x); } static void g(Integer y) { } }\n",'a.ida':"int sub_10(int a1) {\n  return sub_20(a1);\n}\ndword_401000 = 5;\n",
}
#: For each source: functions, types and other declarations, and some of the edges.
WANTED = {
    "a.rs": ({"Draw::draw", "P::draw", "helper"}, {"P", "Draw"}, {("Extends", "P", "Draw"), ("Calls", "P::draw", "helper"), ("Imports", "a.rs", "std::fs")}),
    "a.go": ({"S::Run", "main"}, {"S", "I", "main"}, {("Calls", "main", "Run"), ("Imports", "a.go", "fmt")}),
    "A.java": ({"A::run", "A::go"}, {"A"}, {("Extends", "A", "B"), ("Extends", "A", "C"), ("Calls", "A::run", "go"), ("Imports", "A.java", "java.util.List")}),
    "a.ts": ({"K::load", "go", "run"}, {"Q", "K"}, {("Extends", "K", "L"), ("Calls", "K::load", "fetchIt"), ("Calls", "go", "run"), ("Imports", "a.ts", "./x")}),
    "a.py": ({"X::f", "g"}, {"X"}, {("Extends", "X", "Y"), ("Calls", "X::f", "g"), ("Imports", "a.py", "os")}),
    "a.rb": ({"W::perform", "helper"}, {"W"}, {("Extends", "W", "Base"), ("Calls", "W::perform", "helper"), ("Imports", "a.rb", "set")}),
    "a.lua": ({"go", "run"}, set(), {("Calls", "go", "run"), ("Imports", "a.lua", "mod")}),
    "a.cs": ({"N::A::Run", "N::A::Go"}, {"N", "N::A"}, {("Extends", "N::A", "B"), ("Calls", "N::A::Run", "Go")}),
    "a.cpp": ({"D::f", "g"}, {"D"}, {("Extends", "D", "B"), ("Calls", "D::f", "g"), ("Imports", "a.cpp", "v.h")}),
    "a.kt": ({"A::f", "g"}, {"A"}, {("Extends", "A", "B"), ("Calls", "A::f", "g")}),
    "a.swift": ({"A::f", "g"}, {"A"}, {("Extends", "A", "B"), ("Calls", "A::f", "g"), ("Imports", "a.swift", "UIKit")}),
    "a.php": ({"C::f", "g"}, {"C"}, {("Extends", "C", "D"), ("Calls", "C::f", "g")}),
    "a.vb": ({"A::F", "A::G"}, {"A"}, {("Extends", "A", "B"), ("Calls", "A::F", "G"), ("Imports", "a.vb", "System")}),
    "a.erl": ({"m::init", "m::go"}, {"m"}, {("Calls", "m::init", "go"), ("Imports", "a.erl", "gen_server")}),
    "a.vue": ({"a::go", "a::run"}, {"a"}, {("Calls", "a::go", "run"), ("References", "a", "my-child"), ("Calls", "a", "go")}),
    "m.xml": ({"UserMapper::find"}, {"UserMapper"}, {("TypeOf", "UserMapper", "User")}),
    "f.dfm": (set(), {"f", "f::Form1"}, {("Calls", "f", "DoClick")}),
    "a.tf": (set(), {"y", "m", "region"}, {("Calls", "y", "region"), ("Imports", "a.tf", "./m")}),
    "a.sol": ({"T::f", "T::g"}, {"T"}, {("Extends", "T", "Base"), ("Calls", "T::f", "g")}),
    "a.cbl": ({"MAINP::MAIN-PARA", "MAINP::SUB-PARA"}, {"MAINP"}, {("Calls", "MAINP::MAIN-PARA", "SUB-PARA")}),
    "a.dart": ({"A::f", "g"}, {"A"}, {("Extends", "A", "B"), ("Calls", "A::f", "g")}),
    "a.pas": ({"Go"}, {"TA"}, {("Extends", "TA", "TB"), ("Calls", "Go", "Run")}),
    "a.sh": ({"go", "run"}, set(), {("Calls", "go", "run"), ("Imports", "a.sh", "lib.sh")}),
    "a.r": ({"f", "g"}, set(), {("Calls", "f", "g")}),
    "a.m": ({"A::go", "A::run"}, {"A"}, {("Calls", "A::go", "run"), ("Imports", "a.m", "X.h")}),
    "a.scala": ({"O::f", "O::g"}, {"O"}, {("Extends", "O", "P"), ("Calls", "O::f", "g")}),
    "a.move": ({"M::f", "M::g"}, {"M"}, {("Calls", "M::f", "g")}),
    "a.vy": ({"f", "g"}, set(), {("Calls", "f", "g")}),
    "a.ets": ({"A::build", "A::go"}, {"A"}, {("Calls", "A::build", "go")}),
    "a.cls": ({"A::f", "A::g"}, {"A"}, {("Extends", "A", "B"), ("Calls", "A::f", "g")}),
    "a.ida": ({"sub_10"}, {"dword_401000"}, {("Calls", "sub_10", "sub_20")}),
}


def test_extractors(spark):
    files = spark.createDataFrame([*SOURCES.items(), ("a.unknown", "x"), ("b.go", None)], "path string, content string")
    rows = languages.extract(files).collect()
    for path, (functions, others, edges) in WANTED.items():
        own = [r for r in rows if r.path == path]
        assert {r.qualified_name for r in own if r.tag == "node" and r.kind == "Function"} == functions, path
        assert {r.qualified_name for r in own if r.tag == "node" and r.kind != "Function"} == others, path
        assert edges <= {(r.kind, r.owner, r.target) for r in own if r.tag == "edge"}, path
    assert not [r for r in rows if r.path in ("a.unknown", "b.go")]
    run = next(r for r in rows if r.path == "A.java" and r.name == "run" and r.tag == "node")
    assert (run.line, run.end_line, run.cyclomatic, run.nesting, run.parameters) == (3, 5, 4, 2, 2)  # for, if and &&


def test_comments_and_strings_hold_no_calls(spark):
    text = "fn a() { // b()\n /* c( */ d(\"e()\"); }\n"
    rows = languages.scan("x.rs", text, languages.LANGUAGES["rust"])
    assert [r[9] for r in rows if r[2] == "edge" and r[3] == "Calls"] == ["d"]


ROUTES = {
    "app.py": ("@app.route('/u', methods=['POST'])\ndef make():\n    pass\n@api.get('/v')\nasync def read():\n    pass\n", {("flask", "POST", "/u", "make"), ("fastapi", "GET", "/v", "read")}),
    "urls.py": ("urlpatterns = [path('a/<int:x>', views.show), path('b', V.as_view())]", {("django", "ANY", "a/<int:x>", "show"), ("django", "ANY", "b", "V")}),
    "s.js": ("app.get('/x', auth, ctl.list);\nrouter.post(\"/y\", create)", {("express", "GET", "/x", "list"), ("express", "POST", "/y", "create")}),
    "r.go": ('r.GET("/p", mw, h.Show)\nhttp.HandleFunc("/q", serve)', {("go", "GET", "/p", "Show"), ("go", "HANDLEFUNC", "/q", "serve")}),
    "C.java": ('@GetMapping("/o/{id}")\npublic Order one(long id) {}', {("spring", "GET", "/o/{id}", "one")}),
    "web.php": ("Route::get('/l', [UserController::class, 'index']);", {("laravel", "GET", "/l", "index")}),
    "n.ts": ("@Get('n')\n async find(x: string) {}", {("nestjs", "GET", "n", "find")}),
    "conf.routes": ("GET  /pl/:id  controllers.Items.show(id: Long)", {("play", "GET", "/pl/:id", "show")}),
    "routes.rb": ("get '/ra', to: 'users#index'", {("rails", "GET", "/ra", "index")}),
    "m.rs": ('#[get("/ru")]\nasync fn hello() {}\nRouter::new().route("/ax", post(save))', {("rust", "GET", "/ru", "hello"), ("rust", "POST", "/ax", "save")}),
    "W.cs": ('[HttpGet("c")]\npublic async Task<int> Get(int x) {}\napp.MapPost("/d", Handler.Run);', {("aspnet", "GET", "c", "Get"), ("aspnet", "POST", "/d", "Run")}),
    "v.swift": ('app.get("sw", use: ctl.index)', {("vapor", "GET", "sw", "index")}),
    "x.tsx": ('<Route path="/re" element={<Home />} />', {("react", "GET", "/re", "Home")}),
    "src/pages/blog/index.astro": ("", {("astro", "GET", "/blog", None)}),
    "src/routes/a/+page.svelte": ("", {("svelte", "GET", "/a", None)}),
    "d.routing.yml": ("d.x:\n  path: '/dr'\n  defaults:\n    _controller: '\\\\D\\\\C::show'\n", {("drupal", "ANY", "/dr", "show")}),
}
CLAIMS = {
    "E.swift": ('Name("Cam")\nAsyncFunction("shoot") {}\nstruct V: View {}\n@objc func go() {}', {("expo_modules", "module", "Cam"), ("expo_modules", "bridge", "shoot"), ("swiftui", "component", "V"), ("swift_objc", "bridge", "go")}),
    "R.m": ("RCT_EXPORT_MODULE(Cal)\nRCT_EXPORT_METHOD(add:(int)x)", {("react_native", "module", "Cal"), ("react_native", "bridge", "add")}),
    "Cargo.toml": ('name = "one"\ntwo = { path = "../two" }', {("cargo_workspace", "module", "one"), ("cargo_workspace", "reference", "two")}),
    "P.cbl": ("EXEC CICS LINK PROGRAM('SUB1') END-EXEC", {("cics", "reference", "SUB1")}),
    "t.tf": ("x = module.net.id", {("terraform", "reference", "module")}),
    "A.cls": ("@AuraEnabled\npublic static String load(String x) {}", {("salesforce", "bridge", "load")}),
}


def test_framework_rules(spark):
    files = spark.createDataFrame([(p, t) for p, (t, _) in [*ROUTES.items(), *CLAIMS.items()]], "path string, content string")
    rows = frameworks.claims(files).collect()
    for path, (_, want) in ROUTES.items():
        assert want <= {(r.framework, r.verb, r.route, r.name) for r in rows if r.path == path and r.kind == "route"}, path
    for path, (_, want) in CLAIMS.items():
        assert want <= {(r.framework, r.kind, r.name) for r in rows if r.path == path}, path


def test_routes_reach_their_handlers(spark):
    files = spark.createDataFrame([("app.py", ROUTES["app.py"][0]), ("z.py", "def make():\n    pass\n")], "path string, content string")
    names = languages.symbols(languages.extract(files))
    got = {(r.src, r.framework, r.file_path) for r in frameworks.route_edges(frameworks.claims(files), names).join(names, names.id == frameworks.F.col("dst")).collect()}
    assert got == {("route:POST /u", "flask", "app.py"), ("route:GET /v", "fastapi", "app.py")}


PASSES = {
    "event_emitter": ({"e.js": "function fire() { bus.emit('go', 1); }\nfunction on1() { }\nfunction wire() { bus.on('go', on1); }\n"}, {("fire", "on1")}),
    "celery_dispatch": ({"t.py": "@shared_task\ndef send(x):\n    pass\n", "v.py": "def view():\n    send.delay(1)\n"}, {("view", "send")}),
    "sidekiq_dispatch": ({"w.rb": "class Mail\n  def perform(x)\n  end\nend\n", "c.rb": "class Ctl\n  def go\n    Mail.perform_async(1)\n  end\nend\n"}, {("Ctl::go", "Mail::perform")}),
    "spring_event": ({"S.java": "class P {\n  void a() { bus.publishEvent(new Paid(1)); }\n}\nclass L {\n  @EventListener\n  public void on(Paid e) { }\n}\n"}, {("P::a", "L::on")}),
    "mediatr_dispatch": ({"M.cs": "class C {\n  void Go() { m.Send(new Ask()); }\n}\nclass H : IRequestHandler<Ask, int> {\n  int Handle(Ask a) { return 1; }\n}\n"}, {("C::Go", "H::Handle")}),
    "laravel_event": ({"l.php": "<?php\nclass A { function f() { event(new Paid(1)); } }\nclass L { public function handle(Paid $e) { } }\n"}, {("A::f", "L::handle")}),
    "c_fn_pointer_dispatch": ({"p.c": "int run(int a) { return a; }\nstruct ops o = { .go = run };\nint main(int n) { return o->go(1); }\n"}, {("main", "run")}),
    "redux_thunk": ({"r.js": "const load = (x) => (dispatch) => { };\nfunction view() { dispatch(load(1)); }\n"}, {("view", "load")}),
    "vuex_dispatch": ({"s.js": "const actions = {\n  fetch({ commit }) { }\n};\nfunction use() { store.dispatch('ns/fetch'); }\n"}, {("use", "fetch")}),
    "react_render": ({"c.jsx": "class C {\n  click() { this.setState({}); }\n  render() { return 1; }\n}\n"}, {("C::click", "C::render")}),
    "flutter_build": ({"f.dart": "class S {\n  void tap(int x) { setState(() {}); }\n  Widget build(int c) { return 1; }\n}\n"}, {("S::tap", "S::build")}),
    "interface_override": ({"I.java": "interface I {\n  default void f(int x) { }\n}\nclass K implements I {\n  public void f(int x) { }\n}\n"}, {("I::f", "K::f")}),
    "go_implements": ({"g.go": "type I interface {\n  Run()\n}\ntype E interface {\n}\ntype S struct {\n}\nfunc (s *S) Run() { }\n"}, {("S", "I")}),
    "go_cross_file_method_contains": ({"p/a.go": "type S struct {\n}\n", "p/b.go": "func (s *S) Run() { }\n", "q/b.go": "func (s *S) Not() { }\n"}, {("S", "S::Run")}),
    "go_grpc_stub_impl": ({"x.go": "type UnimplementedAServer struct {\n}\nfunc (u UnimplementedAServer) Get() { }\ntype Srv struct {\n}\nfunc (s *Srv) Get() { }\nfunc (s *Srv) Put() { }\n"}, {("UnimplementedAServer::Get", "Srv::Get")}),
    "kotlin_expect_actual": ({"a.kt": "expect fun now(): Int\n", "b.kt": "actual fun now(): Int = 1\n"}, {("now", "now")}),
    "sveltekit_load": ({"src/r/+page.svelte": "", "src/r/+page.ts": ""}, {("src/r/+page.svelte", "src/r/+page.ts")}),
    "pascal_form": ({"u/Main.dfm": "object F: TF\nend\n", "u/main.pas": "procedure X;\nbegin\nend;\n"}, {("u/Main.dfm", "u/main.pas")}),
}


@pytest.fixture(scope="module")
def derived(spark):
    files = spark.createDataFrame([(f"{via}/{p}", t) for via, (fs, _) in PASSES.items() for p, t in fs.items()], "path string, content string")
    rows = languages.extract(files)
    names = languages.symbols(rows)
    supers = rows.where("kind = 'Extends'").selectExpr("owner", "target as name")
    edges = channels.derived_edges(files, names, supers).collect()
    known = {r.id: (r.qualified_name, r.file_path) for r in names.collect()}
    return edges, known


@pytest.mark.parametrize("via", PASSES)
def test_derived_edges(derived, via):
    edges, known = derived
    name = lambda x: known[x][0] if x in known else x.removeprefix(f"{via}/")
    within = lambda x: known.get(x, ("", x))[1].startswith(f"{via}/")
    got = {(name(e.src), name(e.dst)) for e in edges if e.via == via and within(e.src)}
    assert got == PASSES[via][1]


def test_a_crowded_key_is_no_channel(spark):
    text = "".join(f"function s{i}() {{ b.emit('x'); }}\nfunction t{i}() {{ }}\nb.on('x', t{i});\n" for i in range(7))
    files = spark.createDataFrame([("a.js", text)], "path string, content string")
    names = languages.symbols(languages.extract(files))
    assert channels.channel_edges(files, names).where("via = 'event_emitter'").count() == 0
