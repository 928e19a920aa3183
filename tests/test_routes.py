"""Routes by place: group variables, scopes, bound middleware, dispatching controllers, included URL lists."""

import random

import pytest

from auditloom.functions.blocks import Blocks
from auditloom.operators import routes


def found(path, content, scopes=False):
    return {(m, p, h) for m, p, h, *_ in routes.routes_of(path, content, scopes)}


def test_group_variables_stand_for_their_last_assignment():
    go = 'v := r.Group("/a")\nv.GET("/one", one)\nv = r.Group("/b")\nv.GET("/two", two)\nw := v.Group("/c")\nv = v.Group("/d")\nv.GET("/three", three)\nw.GET("/four", four)\n'
    assert found("m.go", go) == {("GET", "/a/one", "one"), ("GET", "/b/two", "two"), ("GET", "/b/d/three", "three"), ("GET", "/b/c/four", "four")}
    # One that is only assigned later counts from there; a group of itself ends.
    assert found("m.go", 'x.GET("/q", q)\nx := r.Group("/late")\n') == {("GET", "/late/q", "q")}
    assert found("m.go", 'x := x.Group("/self")\nx.GET("/q", q)\n') == {("GET", "/self/q", "q")}


@pytest.mark.parametrize("seed", range(5))
def test_group_variables_against_running_the_lines(seed):
    rng, now, lines, want = random.Random(seed), {}, [], set()
    for k in range(60):
        name = rng.choice("abc")
        if rng.random() < 0.5 or name not in now:
            of = rng.choice(["r", *now])
            now[name] = now.get(of, "") + f"/{k}"
            lines.append(f'{name} := {of}.Group("/{k}")')
        else:
            lines.append(f'{name}.POST("/p{k}", h{k})')
            want.add(("POST", f"{now[name]}/p{k}", f"h{k}"))
    assert found("m.go", "\n".join(lines)) == want


def test_blocks_leave_out_strings_and_comments():
    b = Blocks("a(1, ')', \"}\") { // {\n  b[ /* ] */ 2 ] `(`\n}\nopen {")
    assert [(x.kind, x.header, x.up) for x in b.all] == [("(", "a", None), ("{", "a(1, ')', \"}\")", None), ("[", "b", 1), ("{", "open", None)]
    assert b.inside(b.all[0]) == "1, ')', \"}\"" and b.all[3].end == len(b.text)
    ruby = Blocks("draw do\n  if x\n    get 1\n  end\n  # do\n  scope 'do' do\n    y\n  end\nend\nz", ruby=True)
    assert [(x.kind, x.header) for x in ruby.all] == [("do", "draw"), ("word", ""), ("do", "scope 'do'")]
    assert [x.header for x in ruby.around(ruby.text.index("y"))] == ["draw", "scope 'do'"] and ruby.around(ruby.text.index("z")) == []


@pytest.mark.parametrize("seed", range(4))
def test_scopes_of_generated_nestings(seed):
    rng, want, n = random.Random(seed), set(), iter(range(1000))

    def body(prefix, depth):
        out = []
        for _ in range(rng.randrange(1, 4)):
            k = next(n)
            kind = rng.choice(["get", "namespace", "scope", "resources", "if"] if depth < 5 else ["get"])
            if kind == "get":
                out.append(f"get '/g{k}', to: 'c#a{k}'")
                want.add(("GET", f"{prefix}/g{k}", f"c#a{k}"))
            elif kind == "if":
                out += [f"if x{k} # end", *body(prefix, depth + 1), "end"]
            elif kind == "resources":
                want.update((v, f"{prefix}/r{k}s{more}", action) for v, more, action in routes.CRUD)
                out += [f"resources :r{k}s do", *body(f"{prefix}/r{k}s/:r{k}_id", depth + 1), "end"]
            else:
                out += [f"namespace :n{k} do" if kind == "namespace" else f"scope '/n{k}' do", *body(f"{prefix}/n{k}", depth + 1), "end"]
        return out

    text = "\n".join(["Rails.application.routes.draw do", *body("", 0), "end"])
    assert found("config/routes.rb", text, True) == want
    plain = {p.count("/") for _, p, h in found("config/routes.rb", text) if h.startswith("c#")}
    assert plain <= {1}


def test_scopes_of_functions():
    assert found("m.go", 'r.Route("/api", func(r chi.Router) {\n r.Get("/x", h)\n r.Route("/in", func(q chi.Router) { q.HandleFunc("/y", k) })\n})\n', True) == {("GET", "/api/x", "h"), ("ANY", "/api/in/y", "k")}
    php = "Route::prefix('admin')->middleware('a')->group(function () {\n  Route::get('/o', 'C@i');\n});\nRoute::get('/p', 'C@p');\n"
    assert {p for _, p, _ in found("web.php", php, True)} == {"/admin/o", "/p"}


def test_bound_middleware():
    ts = """configure(c) {
  consumer.apply(Log, Auth(')')).exclude({ path: 'cats/x', method: RequestMethod.GET }, 'health/*').forRoutes({ path: 'cats/x', method: RequestMethod.GET }, { path: 'dogs', method: RequestMethod.POST, handler: add }, CatsController, 'health/live', ['/z/q']);
  consumer.apply(x).exclude('*').forRoutes('a/b', DogsController)
  consumer.apply(x).forRoutes('*', { controller: Birds, handler: fly })
  other.apply(x).forRoutes('no/no')
  // a call without an end: consumer.apply(x
}"""
    assert found("a.module.ts", ts) == {("POST", "/dogs", "add"), ("ANY", "/CatsController", "CatsController"), ("ANY", "/z/q", "Unknown"), ("ANY", "/*", "Unknown"), ("ANY", "/Birds", "fly")}


def test_dispatching_controllers():
    php = "class action { public function display(){ $action = $this->ev->url(3); if(!method_exists($this,$action)) {} $this->$action(); } function free(){} public function index(){} private function Add(){} public function __construct(){} public function add(){} }"
    assert found("x/app/exam/controller/basic.app.php", php) == {("ANY", "/index.php?exam-app-basic", "exam/basic.app::index"), ("ANY", "/index.php?exam-app-basic-Add", "exam/basic.app::Add")}
    assert found("app/exam/controller/basic.app.php", php.replace("method_exists", "exists")) == set() and found("app/basic.php", php) == set()


def test_annotated_methods_without_a_path_of_their_own():
    java = '@Path("/u")\npublic class U {\n @GET\n @Produces("x")\n @Path("/{id}")\n public User one(Long id) {}\n @POST\n public Response add(User u) {}\n @DELETE\n @Path("/{id}")\n public List<Map<String, User>> del() {}\n}'
    assert found("U.java", java) == {("GET", "/u/{id}", "one"), ("POST", "/u", "add"), ("DELETE", "/u/{id}", "del")}


def test_included_url_lists(spark):
    files = [
        ("p", "site/urls.py", "from shop import urls as shop_urls\nfrom blog.urls import urlpatterns as more\nimport wiki.urls\nfrom extra import urls\nurlpatterns = [path('shop/', include((shop_urls, 'shop'))), path('news/', include(('news.urls', 'news'))), re_path(r'^old/', include('old.urls'))]\nurlpatterns += urls\n"),
        *[("p", f"{x}/urls.py", f"urlpatterns = [path('{x}-page', views.{x})]\n") for x in ("shop", "news", "old", "extra")],
    ]
    df = spark.createDataFrame([(p, i, path, c, len(c)) for i, (p, path, c) in enumerate(files)], "project string, ordinal int, path string, content string, size long")
    assert {(r["path"], r["prefix"]) for r in routes.mounted_prefixes(df).collect()} == {("shop/urls.py", "/shop"), ("news/urls.py", "/news"), ("old/urls.py", "/old")}
    assert {(r["src"], r["dst"], r["prefix"]) for r in routes.mount_edges(df).collect()} >= {("site/urls.py", "extra/urls.py", "")}
