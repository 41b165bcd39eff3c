"""Operators on small hand-made inputs, mirroring what a code-graph tool must get right."""

import json
import random
import re

from pyspark.sql import functions as F

from skein.functions import scalars as sc
from skein.operators import aggregates, concepts, connectors, extract, graph, maintain, navigation, search
from skein.operators.graphmodel import CodeGraph
from skein.sources import scip, walker
from skein.streaming import watch


def tables(spark, tmp_path, **given):
    """A folder of tables with defaults for those not given."""
    schemas = {
        "files": "id long, project string, path string, hash string, language string, last_indexed long",
        "source_files": "file_id long, path string, content string",
        "symbols": "id long, file_id long, name string, qualified_name string, kind string, line int, col int, end_line int, end_col int, scope_path string, signature string, doc_comment string, visibility string",
        "runtime_symbols": "id long, name string, qualified_name string, kind string, signature string",
        "edges": "source_id long, target_id long, kind string, source_line int, confidence double",
        "code_chunks": "id long, file_id long, symbol_id long, content_hash string, content string, start_line int, end_line int",
    }
    for name, schema in schemas.items():
        spark.createDataFrame(given.get(name, []), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return CodeGraph(spark, str(tmp_path))


def sym(i, file, name, qn, kind="method", line=1, end=9, scope=None):
    return (i, file, name, qn, kind, line, 0, end, 0, scope, f"def {name}()", None, "public")


def chain(spark, tmp_path):
    """D calls C calls B calls A, and a circle from A back to D."""
    files = [(1, "p", "p/a.cs", "h", "csharp", 0), (2, "p", "p/b.ts", "h", "typescript", 0)]
    symbols = [sym(k, 1 + k % 2, n, f"NS.{n}", line=10 * k, end=10 * k + 8) for k, n in enumerate("ABCD")]
    edges = [(1, 0, "calls", 1, 1.0), (2, 1, "calls", 2, 1.0), (2, 1, "calls", 2, 0.4), (3, 2, "calls", None, 1.0), (0, 3, "type_ref", 4, 0.5), (3, 0, "http_call", 31, 0.9)]
    return tables(spark, tmp_path, files=files, symbols=symbols, edges=edges)


def test_blast_radius_and_circles(spark, tmp_path):
    g = chain(spark, tmp_path)
    rows = lambda d: {(r.name, r.depth) for r in graph.blast_radius(g, 0, d).collect()}
    assert rows(1) == {("B", 1), ("D", 1)}
    assert {("C", 2), ("A", 2)} <= rows(2) and ("A", 4) in rows(4)


def test_traces_visit_each_symbol_once_in_order(spark, tmp_path):
    g = chain(spark, tmp_path)
    t = sorted(graph.trace_trees(g, spark.createDataFrame([(3,)], "id long"), 5).collect(), key=lambda r: r.ordinal)
    assert [r.node_id for r in t] == [3, 2, 1, 0] and [r.depth for r in t] == [0, 1, 2, 3]
    assert graph.trace_trees(g, spark.createDataFrame([(99,)], "id long"), 2).collect()[0].node_id == 99


def test_traces_go_into_members_and_over_flows(spark, tmp_path):
    files = [(1, "p", "p/a.ts", "h", "typescript", 0), (2, "p", "p/b.cs", "h", "csharp", 0)]
    symbols = [sym(1, 1, "K", "N.K", "class"), sym(2, 1, "send", "N.K.send", line=2, scope="N.K"), sym(3, 1, "idle", "N.K.idle", line=3, scope="N.K"), sym(4, 2, "Get", "S.Get"), sym(5, 2, "Db", "S.Db")]
    g = tables(spark, tmp_path, files=files, symbols=symbols, edges=[(2, 4, "http_call", 2, 0.9), (4, 5, "calls", 1, 1.0), (1, 3, "type_ref", 9, 1.0)])
    walk = lambda i: [(r.node_id, r.kind, r.depth) for r in sorted(graph.trace_trees(g, spark.createDataFrame([(i,)], "id long"), 4).collect(), key=lambda r: r.ordinal)]
    assert walk(1) == [(1, "root", 0), (2, "member", 1), (4, "http_call", 2), (5, "calls", 3)]  # idle is visited, but silent
    assert walk(4) == [(4, "root", 0), (5, "calls", 1), (2, "http_call", 1)]
    assert {r.root_id for r in graph.entry_traces(g, 5, 4).collect()} == {1}  # 4 stands in the trace of 1
    assert {r.root_id for r in graph.entry_traces(g, 5, 1).collect()} == {1, 4}


def test_context_caps_each_direction(spark, tmp_path):
    symbols = [sym(100, 1, "drain", "N.drain")] + [sym(i, 1, f"m{i}", f"N.m{i}") for i in range(1, 26)] + [sym(200, 1, "late", "N.late")]
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.cs", "h", "csharp", 0)], symbols=symbols, edges=[(i, 100, "calls", i, 1.0) for i in range(1, 26)] + [(100, 200, "calls", 1, 1.0)])
    got = {r.qualified_name for r in concepts.smart_context(g, "drain", budget=100000).collect()}
    assert "N.late" in got and len(got) == 22  # the seed, 20 that come in, 1 that goes out


def test_flows_cross_files(spark, tmp_path):
    g = chain(spark, tmp_path)
    got = {(r.depth, r.path) for r in graph.trace_flow(g, 2, 2).collect()}
    assert got == {(0, "p/b.ts"), (1, "p/a.cs")}
    assert {(r.depth, r.path) for r in graph.trace_flow(g, 1, 2, reverse=True).collect()} == {(0, "p/a.cs"), (1, "p/b.ts")}
    assert graph.trace_flow(g, 2, 2, line=99).count() == 0
    assert [(r.source_path, r.targets) for r in graph.cross_language(g, "typescript", "csharp").collect()] == [("p/b.ts", 1)]


def test_navigation(spark, tmp_path):
    g = chain(spark, tmp_path)
    assert [r.confidence for r in navigation.definition(g, "NS.B").collect()] == [1.0]
    assert [(r.qualified_name, r.confidence) for r in navigation.definition(g, "Other.B").collect()] == [("NS.B", 0.7)]
    assert navigation.definition(g, "nothing").count() == 0
    assert {r.source for r in navigation.references(g, "A").collect()} == {"NS.B", "NS.D"}
    assert {r.target for r in navigation.outgoing_calls(g, "NS.D").collect()} == {"NS.C"}
    assert {r.category for r in navigation.diagnostics(g, spark.createDataFrame([(1, "X", "calls", 3)], "file_id long, target_name string, kind string, line int")).collect()} == {"unresolved", "low_confidence"}
    inside = navigation.enclosing(spark.createDataFrame([(2, 35)], "file_id long, line int"), g.symbols.unionByName(g.symbols.filter("id = 3").withColumn("id", F.lit(50).cast("long")).withColumn("line", F.lit(33)).withColumn("end_line", F.lit(36))))
    assert inside.collect()[0].symbol_id == 50
    info = {r.name: (r.incoming, r.outgoing) for r in navigation.symbol_info(g).collect()}
    assert info["A"] == (2, 1) and info["C"] == (1, 1)


def test_edges_merge_by_key_but_not_by_missing_line(spark, tmp_path):
    g = chain(spark, tmp_path)
    assert g.edges.count() == 5
    assert g.edges.filter("source_id = 2").collect()[0].confidence == 1.0


def test_scalars(spark):
    row = spark.range(1).select(
        sc.normal_route(F.lit("/api/Users/{id}")).alias("route"),
        sc.routes_match(F.lit("users/{*}"), F.lit("users/7")).alias("fits"),
        sc.routes_match(F.lit("users"), F.lit("users/7")).alias("short"),
        sc.url_pattern(F.lit("/a/${x}?q=1")).alias("url"),
        sc.interpolation_pattern(F.lit("a//{id}/b")).alias("hole"),
        *[sc.plural(F.lit(w)).alias(w) for w in ("Category", "Box", "Day", "Order")],
        sc.clip_bytes(F.lit("aéb"), 2).alias("clip"),
        sc.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        sc.module_fits(F.lit("src/app/user.ts"), F.lit("./app/user")).alias("module"),
    ).first()
    assert row["route"] == "users/{*}" and row["fits"] and not row["short"] and row["url"] == "/a/{param}" and row["hole"] == "a/{*}/b"
    assert [row[w] for w in ("Category", "Box", "Day", "Order")] == ["Categories", "Boxes", "Days", "Orders"]
    assert row["clip"] == "a…" and row["zero"] == 0.0 and row["module"]
    assert sc.match_words('ab abc "qq') == ["abc", '""qq']
    fits = lambda glob, path: re.search(sc.glob_regex(glob), path) is not None
    assert fits("src/**/*.py", "src/a.py") and fits("src/**/*.py", "src/x/y/a.py") and not fits("src/*.py", "src/x/a.py")
    assert fits("*.py", "x/a.py") and not fits("*.py", "x/a.pyc") and re.fullmatch(sc.escape("a.b(*)"), "a.b(*)")


def test_search(spark, tmp_path):
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.py", "h", "python", 0)], source_files=[(1, "p/a.py", "x = 1\r\nélan = foo(2)\nFOO = 3")], symbols=[sym(1, 1, "CatalogService", "app.CatalogService", "class"), sym(2, 1, "catalog_item", "app.catalog_item")])
    assert [(r.line, r.start, r.end) for r in search.grep(g, "foo(").collect()] == [(2, 8, 12)]
    assert {r.line for r in search.grep(g, "foo", ignore_case=True, whole_word=True).collect()} == {2, 3}
    assert search.grep(g, "foo", languages=["go"]).count() == 0
    assert [r.id for r in search.search_symbols(g, "CatalogService").collect()] == [1]
    assert [r.id for r in search.search_symbols(g, "talog_it").collect()] == [2]  # by LIKE
    assert search.search_content(g, "élan zz").count() == 1
    best = [r.qualified_name for r in search.fuzzy(g.symbols.select("id", "qualified_name"), "qualified_name", "CatSer").collect()]
    assert best == ["app.CatalogService"]
    assert search.fuzzy_score("abc", "xaxbxc")[1] == [1, 3, 5] and search.fuzzy_score("abc", "acb") is None
    assert search.fuzzy_score("cat", "cat")[0] > search.fuzzy_score("cat", "c_a_t")[0]
    a, b = (spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)]))
    assert [(r.id, r.score) for r in search.fuse(a, b, 3).collect()][0] == (2, round(1 / 62 + 1 / 61, 9))


def test_concepts_and_budget(spark, tmp_path):
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.py", "h", "python", 0)], symbols=[sym(1, 1, "x", "A.B.x"), sym(2, 1, "y", "a.b.y"), sym(3, 1, "z", "A.z")])
    c = concepts.discover(g)
    assert {r.name for r in c.collect()} == {"A.B", "a.b"}
    assert {(r.name, r.symbol_id) for r in concepts.assign(g, c).collect()} == {(n, i) for n in ("A.B", "a.b") for i in (1, 2)}
    assert concepts.discover(g, c.select("name")).count() == 0
    items = spark.createDataFrame([(1, 300), (2, 100), (3, 50)], "id long, tokens int")
    assert [r.id for r in concepts.budgeted(items, ["id"], 100).collect()] == [1]
    assert [r.id for r in concepts.budgeted(items, ["id"], 410).collect()] == [1, 2]


def test_connectors():
    f = lambda lang, text, path="a": {(k, a, b) for k, _, a, b, _ in connectors.facts_of(lang, path, text)}
    assert ("route", "GET", "/api/users/{id}") in f("csharp", '[Route("api/[controller]")]\npublic class UsersController {\n[HttpGet("{id}")]')
    assert ("route", "POST", "/pets/new") in f("java", '@RequestMapping("/pets")\nclass P {\n@PostMapping("/new")')
    assert ("route", "GET", "/cats") in f("typescript", "@Controller('cats')\nexport class CatsController {\n  @Get()")
    assert ("route", "GET", "/api/items") in f("python", 'router = APIRouter(prefix="/api")\n@router.get("/items")')
    assert ("route", "GET", "/v1/x") in f("go", 'v := r.Group("/v1")\nv.GET("/x", h)')
    rails = f("ruby", "namespace :admin do\n  resources :posts, only: [:index, :show]\nend\nget '/ping'")
    assert {("route", "GET", "/admin/posts"), ("route", "GET", "/admin/posts/{id}"), ("route", "GET", "/ping")} <= rails
    assert ("route", "GET", "/v2/users") in f("php", "Route::prefix('v2')->group(function () {\nRoute::get('users', x);\n});")
    assert ("call", "POST", "/api/x") in f("typescript", "fetch('/api/x', { method: 'POST' })")
    assert ("produce", "orders", "kafka") in f("java", 'kafkaTemplate.send("orders", x)') and ("consume", "orders", "kafka") in f("java", '@KafkaListener(topics = "orders")')
    assert ("inject", "IRepo", "Repo") in f("csharp", "services.AddScoped<IRepo, Repo>();")
    assert ("tauri_command", "greet", None) in f("rust", "#[tauri::command]\nfn greet() {}") and f("rust", "fn other() {}") == set()
    assert ("field", "user", "query") in f("graphql", "type Query {\n  user(id: ID): User\n}\ntype User {\n  name: String\n}") and len(f("graphql", "type User {\n  name: String\n}")) == 0
    assert ("ipc_main", "open", None) in f("javascript", "ipcMain.handle('open', f)")
    assert {("ipc_main", "a", None), ("ipc_main", "b", None)} <= f("javascript", "ipcMain.handle('a', f);ipcMain.on('b', g)")  # every hit of a line
    assert ("route", "GET", "/v1/items") in f("python", "r = APIRouter()\napp.include_router(r, tags=['x'], prefix='/v1')\n@r.get('/items')")
    assert ("client_call", "PUT", "api/x/{id}") in f("csharp", 'const string ApiUrl = "api";\nawait _c.PutAsync($"{ApiUrl}/x/{id}", b);')
    long = [n for k, n, *_ in connectors.facts_of("typescript", "a.ts", "x\n" * 5000 + "fetch('/z')") if k == "call"]
    assert long == [5001]


def test_route_matching(spark):
    calls = spark.createDataFrame([(1, "get", "/api/users/7?x=1"), (2, "get", "/api/users"), (3, "post", "/api/users/7"), (4, "get", "/api/users/${id}")], "call_id long, method string, url string")
    routes = spark.createDataFrame([(10, "GET", "/users/{id}"), (11, "GET", "users"), (12, "GET", "{a}/{b}"), (13, "GET", "/users/8"), (14, "GET", "/teams/{id}")], "route_id long, method string, template string")
    assert {(r.call_id, r.route_id, r.confidence) for r in connectors.match_routes(calls, routes).collect()} == {(1, 10, 0.8), (1, 12, 0.8), (2, 11, 1.0), (4, 10, 1.0), (4, 12, 0.8), (4, 13, 0.8)}


def test_extraction():
    py = extract.extract("python", "import os\nclass Dog(Animal):\n    def __init__(self):\n        pass\n    def bark(self):\n        return make(1)\n\ndef free():\n    x = '''\nclass No:\n'''\n")
    assert [(s.name, s.line) for s in py if s.kind == "import"] == [("os", 0)]
    py = [s for s in py if s.kind != "import"]
    assert [(s.qualified_name, s.kind, s.line) for s in py] == [("Dog", "class", 1), ("Dog.__init__", "constructor", 2), ("Dog.bark", "method", 4), ("free", "function", 7)]
    assert ("Animal", "inherits", 1) in py[0].refs and ("make", "calls", 5) in py[2].refs and py[2].end_line == 5
    cs = extract.extract("csharp", "namespace N;\npublic class A : B\n{\n    public int Count { get; set; }\n    public int Go(int x)\n    {\n        return new Thing();\n    }\n}\n")
    assert {(s.qualified_name, s.kind) for s in cs} >= {("N.A", "class"), ("N.A.Count", "property"), ("N.A.Go", "method")}
    go = extract.extract("go", "package p\ntype S struct {\n\tN int\n}\nfunc (s *S) Run() {\n\tcall(1)\n}\n")
    assert [(s.qualified_name, s.kind) for s in go] == [("p.S", "struct"), ("p.S.N", "field"), ("p.S.Run", "method")]
    ts = extract.extract("typescript", "export class U {\n  constructor(a: number) {\n  }\n  get(id: string): User {\n  }\n}\nexport const f = (a) => 1;\n")
    assert {(s.name, s.kind) for s in ts} == {("U", "class"), ("constructor", "constructor"), ("get", "method"), ("f", "function")}
    for language, text, name in (("php", "class K {\n  public function run() {\n  }\n}", "K.run"), ("kotlin", "class K {\n  fun run() {\n  }\n}", "K.run"), ("swift", "struct K {\n  func run() {\n  }\n}", "K.run"), ("scala", "object K {\n  def run = 1\n}", "K.run"), ("elixir", "defmodule K do\n  def run do\n  end\nend", "K.run"), ("bash", "run() {\n  ls\n}", "run"), ("dart", "class K {\n  void run() {\n  }\n}", "K.run"), ("cpp", "class K {\n};\nint run() {\n}\n", "run"), ("ruby", "class K\n  def run\n  end\nend", "K.run"), ("rust", "struct K;\nimpl K {\n    pub fn run(&self) {\n    }\n}", "K.run"), ("java", "package q;\nclass K {\n  void run() {\n  }\n}", "q.K.run")):
        assert name in {s.qualified_name for s in extract.extract(language, text)}, language
    assert extract.imports_of("python", "from a.b import c, d\nimport e.f") == [("c", "a.b", 0), ("d", "a.b", 0), ("f", "e.f", 1)]
    assert extract.imports_of("typescript", "import { U } from './u'") == [("U", "./u", 0)]
    assert extract.extract("json", '{"class": 1}') == [] and [(s.name, s.kind) for s in extract.extract("cobol", "class K\nfunction f")] == [("K", "class"), ("f", "function")]


def test_members_and_whole_signatures():
    got = lambda language, text: {(s.qualified_name, s.kind) for s in extract.extract(language, text)}
    assert {("q.K.size", "field"), ("q.K.NAMES", "field"), ("q.E.ONE", "enum_member"), ("q.E.TWO", "enum_member"), ("q", "namespace")} <= got("java", "package q;\nclass K {\n  private int size;\n  static final List<String> NAMES = of(1);\n}\nenum E {\n  ONE,\n  TWO(2);\n}\n")
    assert {("K.name", "property"), ("K.x", "property"), ("limit", "variable")} <= got("python", "limit = 3\nclass K:\n    x: int\n    @property\n    def name(self):\n        return 1\n")
    assert {("U.id", "property"), ("U.at", "property"), ("C.Red", "enum_member"), ("size", "variable")} <= got("typescript", "const size = 4;\ninterface U {\n  id: string;\n  at?: Date\n}\nenum C {\n  Red = 1,\n}\n")
    assert {("K.total", "property")} <= got("kotlin", "class K {\n  val total = 1\n}") and {("K.total", "property")} <= got("swift", "struct K {\n  var total: Int\n}")
    assert {("A.B", "enum_member"), ("MAX", "variable")} <= got("rust", "enum A {\n    B(u8),\n}\nconst MAX: u8 = 1;\n")
    assert {("K.a", "property")} <= got("ruby", "class K\n  attr_reader :a\nend\n")
    assert got("java", "class K {\n  void run() {\n    doIt(1);\n  }\n}") == {("K", "class"), ("K.run", "method")}  # a call is no declaration
    long = "def f(" + ", ".join(f"argument{i}" for i in range(200)) + "):\n    pass\n"
    assert extract.extract("python", long)[0].signature.endswith("argument199)")
    assert [(x, m) for x, m, _ in extract.imports_of("rust", "use a::b::{C, D};\nuse x::Y;")] == [("C", "a.b"), ("D", "a.b"), ("Y", "x")]
    assert extract.imports_of("csharp", "using A.B;\n")[0][:2] == ("A.B", "A.B") and extract.imports_of("java", "import a.b.C;")[0][:2] == ("C", "a.b")


def test_chunks_are_split_at_blank_lines_and_between_characters():
    assert extract.split_chunk("short\n\ntext", 5) == [(5, 7, "short\n\ntext")]
    parts = extract.split_chunk("a" * 2000 + "\n\n" + "b" * 100, 10)
    assert [(a, b, len(t)) for a, b, t in parts] == [(10, 10, 2000), (12, 12, 100)]
    hard = extract.split_chunk("é" * 3000, 0)
    assert [len(t) for _, _, t in hard] == [1024, 1024, 952] and "".join(t for _, _, t in hard) == "é" * 3000
    assert extract.split_chunk(" " * 5000, 3) == [(3, 3, " " * 5000)]


def test_chunks_cover_a_file(spark, tmp_path):
    text = "import a\n\ndef f():\n  x\n\nrest\n"
    g = tables(spark, tmp_path, symbols=[sym(5, 1, "f", "f", line=2, end=3)], source_files=[(1, "a", text), (2, "b", "only\ngap")])
    got = {(r.file_id, r.symbol_id, r.start_line, r.end_line, r.content) for r in extract.chunk_files(g.symbols, g.read("source_files")).collect()}
    assert got == {(1, 5, 2, 3, "def f():\n  x"), (1, None, 0, 1, "import a\n"), (1, None, 4, 6, "\nrest\n"), (2, None, 0, 1, "only\ngap")}


def test_covering_finds_all_spans_and_no_others(spark):
    rnd = random.Random(8)
    spans = [(rnd.randrange(2), i, a, a + rnd.choice([0, 1, 3, 4, 15, 16, 63, 200, 5000])) for i in range(150) for a in [rnd.randrange(3000)]] + [(0, 900, None, 4), (0, 901, 9, 3)]
    points = sorted({(rnd.randrange(2), rnd.randrange(6000)) for _ in range(300)})
    got = navigation.covering(spark.createDataFrame(points, "file_id long, line int"), spark.createDataFrame(spans, "file_id long, id long, first int, last int"))
    rows = [(r.file_id, r.line, r.id) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(f, p, i) for f, p in points for g, i, a, b in spans if f == g and a is not None and a <= p <= b}


def test_maintenance(spark, tmp_path):
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert {(r.path, r.change) for r in maintain.detect_changes(known, now).collect()} == {("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert {(r.path, r.hash) for r in maintain.upsert(known, now, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")}
    old = spark.createDataFrame([(1, "h"), (1, "h"), (1, "k")], "file_id long, content_hash string")
    new = spark.createDataFrame([(1, "h"), (1, "m")], "file_id long, content_hash string")
    assert {(r.content_hash, r.keep, r.insert, r["delete"]) for r in maintain.dedup_chunks(old, new).collect()} == {("h", 1, 0, 1), ("k", 0, 0, 1), ("m", 0, 1, 0)}
    g = chain(spark, tmp_path)
    left = maintain.delete_cascade(g, spark.createDataFrame([(2,)], "file_id long"))
    assert left["symbols"].count() == 2 and left["edges"].count() == 0
    up = maintain.persist_edges(g.edges, spark.createDataFrame([(2, 1, "calls", 2), (7, 8, "calls", 1)], "source_id long, target_id long, kind string, source_line int"))
    assert {(r.source_id, r.confidence) for r in up.filter("source_id in (2, 7)").collect()} == {(2, 1.0), (7, 1.0)}
    assert aggregates.baseline_check(spark.createDataFrame([("p", "files", 90)], "project string, metric string, value long"), spark.createDataFrame([("p", "files", 100)], "project string, metric string, value long")).collect()[0].status == "regressed"


def test_languages_walks_and_ignores(spark, tmp_path):
    for p, text in (("src/a.py", "x"), ("src/B.cs", "y"), ("node_modules/n.js", "z"), (".git/c.py", "z"), ("gen/g.py", "q"), ("README", "r")):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    got = {(r.path, r.language, r.content) for r in walker.walk(spark, str(tmp_path), ["gen/", "# note", "!keep"]).collect()}
    assert got == {("src/a.py", "python", "x"), ("src/B.cs", "csharp", "y")}
    (tmp_path / ".gitignore").write_text("gen/\n*.cs\n")
    (tmp_path / "src/.gitignore").write_text("!B.cs\n/a.py\n")
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/C.cs").write_text("n")
    assert {r.path for r in walker.walk(spark, str(tmp_path)).collect()} == {"src/B.cs"}  # the nearest ignore file decides
    (tmp_path / "base.json").write_text(json.dumps([{"project": "p", "files": 3, "symbols": 4}]))
    assert {(r.metric, r.value) for r in walker.baseline(spark, str(tmp_path / "base.json")).collect()} == {("files", 3), ("symbols", 4)}
    prof = walker.profile(spark.createDataFrame([("p", "p/package.json"), ("p", "p/tests/a_test.go"), ("p", "p/main.go")], "project string, path string"))
    assert {(r.aspect, r.value) for r in prof.collect()} >= {("manager", "npm"), ("tests", "tests"), ("entry", "main.go"), ("language", "go")}


def _field(n, payload):
    if isinstance(payload, int):
        return bytes([n << 3, payload])
    return bytes([n << 3 | 2, len(payload)]) + payload


def test_scip_import(spark, tmp_path):
    occ = lambda line, symbol, roles: _field(2, _field(1, bytes([line, 0, 5])) + _field(2, symbol) + _field(3, roles))
    index = _field(2, _field(1, b"p/a.cs") + occ(10, b"s m p v NS/B#", 1)) + _field(2, _field(1, b"p/b.ts") + occ(21, b"s m p v NS/B#", 0) + occ(22, b"local 1", 0))
    (tmp_path / "i").mkdir()
    (tmp_path / "i/index.scip").write_bytes(index)
    o = scip.read_scip(spark, str(tmp_path / "i"))
    assert {(r.path, r.line, r.definition) for r in o.collect()} == {("p/a.cs", 10, True), ("p/b.ts", 21, False)}
    files = [(1, "p", "p/a.cs", "h", "csharp", 0), (2, "p", "p/b.ts", "h", "typescript", 0)]
    g = tables(spark, tmp_path / "t", files=files, symbols=[sym(1, 1, "B", "NS.B", line=10, end=18), sym(2, 2, "C", "NS.C", line=20, end=28)])
    e = maintain.import_occurrences(g, o, navigation.enclosing).collect()
    assert [(r.source_id, r.target_id, r.kind, r.confidence) for r in e] == [(2, 1, "scip_ref", 1.0)]


def test_watch_keeps_the_last_change(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    rows = [("a.py", "created", 1), ("a.py", "deleted", 2), ("b.ts", "modified", 3), ("notes.zzz", "created", 4)]
    (src / "1.json").write_text("\n".join(json.dumps({"path": p, "change": c, "seq": s, "at": "2026-01-01T00:00:00"}) for p, c, s in rows))
    got = []
    q = watch.watch(watch.change_stream(spark, str(src)), lambda df, n: got.extend((r.path, r.change) for r in df.collect()), str(tmp_path / "ck"), until_idle=True)
    q.awaitTermination(60)
    assert sorted(got) == [("a.py", "deleted"), ("b.ts", "modified")]


def test_the_watch_loop_keeps_the_graph(spark, tmp_path):
    tables(spark, tmp_path / "0", files=[(1, "p", "p/a.py", "h", "python", 0)], symbols=[sym(10, 1, "old", "old", "function", 0, 1)], source_files=[(1, "p/a.py", "def old():\n    pass\n")])
    src, at = tmp_path / "events", [0]
    src.mkdir()
    rows = [("p/a.py", "modified", 1), ("p/b.py", "created", 2)]
    (src / "1.json").write_text("\n".join(json.dumps({"path": p, "change": c, "seq": s, "at": "2026-01-01T00:00:00"}) for p, c, s in rows))
    now = {"p/a.py": "def fresh():\n    made()\n", "p/b.py": "def made():\n    pass\n"}

    def publish(out, batch):
        for name in ("files", "symbols", "edges"):
            out[name].write.parquet(f"{tmp_path}/{batch + 1}/{name}.parquet")
        spark.read.parquet(f"{tmp_path}/0/runtime_symbols.parquet").write.parquet(f"{tmp_path}/{batch + 1}/runtime_symbols.parquet")
        at[0] = batch + 1

    texts = lambda changes: changes.sparkSession.createDataFrame(sorted(now.items()), "path string, content string")
    q = watch.watch(watch.change_stream(spark, str(src)), watch.reindexing(spark, lambda: f"{tmp_path}/{at[0]}", texts, publish), str(tmp_path / "ck"), until_idle=True)
    q.awaitTermination(180)
    g = CodeGraph(spark, f"{tmp_path}/{at[0]}")
    names = {r.id: r.name for r in g.symbols.collect()}
    assert set(names.values()) == {"fresh", "made"} and [(names[r.source_id], names[r.target_id]) for r in g.edges.collect()] == [("fresh", "made")]


def test_bursts_are_session_windows(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    at = ["2026-01-01T00:00:00", "2026-01-01T00:00:00.050", "2026-01-01T00:00:09", "2026-01-02T00:00:00"]
    for k, t in enumerate(at):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"path": "a.py", "change": "modified", "seq": k, "at": t}) for _ in range(2)))
    events = spark.readStream.schema(watch.EVENTS).option("maxFilesPerTrigger", 4).json(str(src))
    q = watch.bursts(events).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.events for r in spark.table("bursts").collect()) == [1, 2]


def test_reindex_touches_what_changes_reach(spark, tmp_path):
    from skein.operators.reindex import reindex

    files = [(1, "p", "p/a.py", "h", "python", 0), (2, "p", "p/b.py", "h", "python", 0), (3, "p", "p/c.py", "h", "python", 0), (4, "p", "p/d.py", "h", "python", 0)]
    symbols = [sym(10, 1, "keep", "keep", "function", 0, 1), sym(11, 1, "drop", "drop", "function", 3, 4), sym(20, 2, "user", "user", "function", 0, 9), sym(30, 3, "gone", "gone", "function", 0, 1), sym(40, 4, "late", "late", "function", 0, 3)]
    edges = [(20, 10, "calls", 1, 0.9), (20, 11, "calls", 2, 0.9), (20, 30, "calls", 3, 0.9), (10, 20, "calls", 1, 0.9), (40, 20, "calls", 2, 0.9)]
    g = tables(spark, tmp_path, files=files, symbols=symbols, edges=edges)
    changes = spark.createDataFrame([("p/a.py", "modified"), ("p/c.py", "deleted"), ("p/new.py", "created")], "path string, change string")
    present = spark.createDataFrame([("p/a.py", "def keep():\n    user(1)\n"), ("p/new.py", "def fresh():\n    keep(2)\n"), ("p/b.py", "x")], "path string, content string")
    open_ = spark.createDataFrame([(40, 4, "fresh", "calls", 1), (40, 4, "never", "calls", 2)], "source_id long, file_id long, target_name string, kind string, line int")
    out = reindex(g, changes, present, open_)
    names = {r.name: r.id for r in out["symbols"].collect()}
    assert set(names) == {"keep", "user", "late", "fresh"}
    e = {(r.source_id, r.target_id, r.kind) for r in out["edges"].collect()}
    assert e == {(20, names["keep"], "calls"), (names["keep"], 20, "calls"), (names["fresh"], names["keep"], "calls"), (40, 20, "calls"), (40, names["fresh"], "calls")}
    assert {(r.source_id, r.target_name) for r in out["unresolved"].collect()} == {(20, "drop"), (20, "gone"), (40, "never")}
    why = {r.file_id: r.why for r in out["touched"].collect()}
    assert why[1] == "changed" and why[2] == "dependent" and why[4] == "waiting" and len(why) == 4
    assert {r.path for r in out["files"].collect()} == {"p/a.py", "p/b.py", "p/d.py", "p/new.py"}
    again = {r.name: r.id for r in reindex(g, changes, present, open_)["symbols"].collect()}
    assert again == names


def test_mappings_stereotypes_and_handlers(spark, tmp_path):
    cs = "class Ctx {\n  DbSet<Order> Orders { get; }\n}\n[HttpGet(\"x\")]\npublic int Get()\n"
    java = "@Service\npublic class Pay {\n}\n"
    files = [(1, "p", "p/a.cs", "h", "csharp", 0), (2, "p", "p/b.java", "h", "java", 0)]
    symbols = [sym(1, 1, "Order", "Order", "class", 50), sym(2, 2, "Pay", "Pay", "class", 1), sym(3, 1, "Get", "Get", "method", 4)]
    g = tables(spark, tmp_path, files=files, symbols=symbols, source_files=[(1, "p/a.cs", cs), (2, "p/b.java", java)])
    facts = connectors.scan(g)
    assert [(r.symbol_id, r.table_name) for r in connectors.db_mappings(facts, g.symbols, g.files).collect()] == [(1, "Orders")]
    assert [(r.name, r.symbol_id) for r in connectors.stereotype_concepts(facts, g.symbols).collect()] == [("spring-service", 2)]
    assert [(r.http_method, r.symbol_id) for r in connectors.routes_with_handlers(facts, g.symbols).collect()] == [("GET", 3)]
    pairs = spark.createDataFrame([("p", 1, "produce", 3, "t", "kafka", None), ("p", 2, "consume", 4, "t", "kafka", None), ("p", 2, "consume", 5, "t", "nats", None), ("q", 3, "consume", 6, "t", "kafka", None)], "project string, file_id long, kind string, line int, a string, b string, c string")
    assert [(r.source_file_id, r.target_line, r.edge_type, r.confidence) for r in connectors.flow_facts(pairs).collect()] == [(1, 4, "message_queue", 0.85)]


def test_resolution_ladder_takes_the_first_step(spark, tmp_path):
    from skein.operators.resolve import ladder, namespaces, resolve

    files = [(1, "p", "p/main.py", "h", "python", 0), (2, "p", "p/util/io.py", "h", "python", 0)]
    symbols = [sym(9, 1, "app", "app", "namespace", 0), sym(1, 1, "run", "app.run", scope="app"), sym(2, 2, "read", "util.io.read"), sym(3, 2, "Box", "util.io.Box", "class"), sym(4, 2, "read", "other.read"), sym(5, 1, "near", "app.near", scope="app"), sym(6, 1, "Thing", "a.Thing", "function"), sym(7, 1, "Thing", "b.Thing", "class")]
    symbols += [sym(20, 2, "deep", "util.io.Box.deep"), sym(21, 1, "deep", "zz.deep"), sym(22, 1, "sole", "zz.sole"), sym(23, 1, "twin", "zz.twin"), sym(24, 1, "twin", "yy.twin")]
    edges = [(1, 2, "imports", 0, 1.0)]
    g = tables(spark, tmp_path, files=files, symbols=symbols, edges=edges)
    refs = spark.createDataFrame([(1, n, k, 1) for n, k in (("read", "calls"), ("Box", "instantiates"), ("util.io.Box", "type_ref"), ("near", "calls"), ("Thing", "instantiates"), ("Nope", "calls"))], "source_id long, target_name string, kind string, file_id long")
    got = {r.target_name: (r.step, r.target_id) for r in resolve(g, refs).collect()}
    assert got == {"read": (1, 2), "Box": (2, 3), "util.io.Box": (3, 3), "near": (4, 5), "Thing": (6, 7)}
    imports = spark.createDataFrame([(1, "sole", "lib/none", 1), (1, "twin", "lib/none", 2), (1, "x", "util.io", 3)], "file_id long, imported_name string, module_path string, line int")
    refs = spark.createDataFrame([(1, n, "calls", 1) for n in ("sole", "twin", "deep")], "source_id long, target_name string, kind string, file_id long")
    got = {r.target_name: (r.step, r.target_id, r.confidence) for r in ladder(refs, g.every_symbol, g.files, imports, namespaces(g.symbols)).collect()}
    assert got == {"sole": (1, 22, 0.95), "twin": (6, 23, 0.50), "deep": (5, 20, 0.80)}  # the only one of its name; none; below the module


def test_smart_context_stays_within_budget(spark, tmp_path):
    g = chain(spark, tmp_path)
    rows = concepts.smart_context(g, "def", budget=250, depth=1).collect()
    assert rows and rows[-1].total <= 250 and len({r.qualified_name for r in rows}) == len(rows)
    assert concepts.smart_context(g, "def", budget=1, depth=1).count() == 1


def test_vector_bytes(spark):
    df = spark.createDataFrame([([1.0, -2.5],), (None,)], "embedding array<float>")
    assert [r[0] for r in search.unpack_vectors(search.pack_vectors(df)).collect()] == [[1.0, -2.5], None]
    assert search.unpack_vectors(spark.createDataFrame([(bytearray(b"abc"),)], "embedding binary")).first()[0] == []


def test_queries_can_name_phrases_columns_and_prefixes(spark, tmp_path):
    assert search.parse_query('name:go "two words" pre* --') == [("name", ("go",), False), ("", ("two", "words"), False), ("", ("pre",), True)]
    symbols = [sym(1, 1, "walk", "a.walk")[:11] + ("walks every open ledger", "public"), sym(2, 1, "open", "a.open")[:11] + ("every ledger is open", "public")]
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.cs", "h", "csharp", 0)], symbols=symbols)
    ids = lambda q: {r.id for r in search.search_symbols(g, q).collect()}
    assert ids("every ledger") == {1, 2} and ids('"every ledger"') == {2} and ids("name:open") == {2} and ids("ledg*") == {1, 2} and ids('"open ledg"') == set()


def test_indexes_find_what_scans_find(spark, tmp_path):
    texts = ["the ledger and the meter", "a ledger of ledgers", "nothing here", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", search.words("text").alias("words"))
    index = search.postings(docs.filter(F.size("words") > 0))
    for terms in (["ledger"], ["the", "ledger"], ["absent"]):
        assert sorted(map(tuple, search.bm25_index(index, terms).collect())) == sorted(map(tuple, search.bm25(docs.filter(F.size("words") > 0), terms).collect()))
    grams = search.grams(spark.createDataFrame(list(enumerate(texts)), "id long, text string"))
    assert {r.id for r in search.holding(grams, "Ledgers").collect()} == {1}
    fresh = search.grams(spark.createDataFrame([(2, "ledgers too")], "id long, text string"))
    again = search.renew(grams, spark.createDataFrame([(2,)], "id long"), fresh)
    assert {r.id for r in search.holding(again, "ledgers").collect()} == {1, 2} and again.filter("id = 2 and gram = 'not'").count() == 0


def test_history_and_vectors(spark):
    h = search.history(spark.createDataFrame([("a", "text", 1, False), ("a", "text", 3, False), ("b", "text", 2, True)], "query string, query_type string, at int, saved boolean"))
    assert {r.query for r in search.saved_history(search.toggle_saved(h, "a", "text")).collect()} == {"a", "b"}
    assert search.saved_history(search.toggle_saved(h, "b", "text")).count() == 0
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "vec_id long, embedding array<float>")
    up = search.upsert_vectors(v, spark.createDataFrame([(2, [9.0]), (3, [3.0])], "vec_id long, embedding array<float>"))
    assert {(r.vec_id, r.embedding[0]) for r in up.collect()} == {(1, 1.0), (2, 9.0), (3, 3.0)}
    left = search.drop_vectors(up, spark.createDataFrame([(2, 7)], "id long, file_id long"), spark.createDataFrame([(7,)], "file_id long"))
    assert {r.vec_id for r in left.collect()} == {1, 3}


def test_provenance_and_answers(spark, tmp_path):
    g = chain(spark, tmp_path)
    none = spark.createDataFrame([], "source_id long, target_id long, kind string, source_line int, source string")
    low = g.edges.filter("confidence < 0.8")
    assert [(r.source_id, r.target_id) for r in maintain.unconfirmed(g.edges, none, 9).collect()] == [(0, 3)]
    assert maintain.unconfirmed(g.edges, maintain.record_provenance(none, low, "lsp"), 9).count() == 0
    answers = spark.createDataFrame([(0, 4, 3), (1, 1, 2)], "source_id long, source_line int, target_id long")
    sure = {(r.source_id, r.target_id): r.confidence for r in maintain.confirm(g.edges, low, answers).collect()}
    assert sure[0, 3] == 1.0
    lost = spark.createDataFrame([(1, 1, "X", "calls", None), (1, 1, "Y", "calls", 2)], "source_id long, file_id long, target_name string, kind string, line int")
    hit, rest = maintain.settle(lost, spark.createDataFrame([(1, "X", None, 9)], "source_id long, target_name string, line int, target_id long"))
    assert [(r.target_id, r.source_line) for r in hit.collect()] == [(9, None)] and [r.target_name for r in rest.collect()] == ["Y"]


def test_browsing(spark, tmp_path):
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.cs", "h", "csharp", 0), (2, "p", "p/x/b.ts", "h", "typescript", 0), (3, "p", "p/x/y/c.ts", "h", "typescript", 0)], source_files=[(1, "p/a.cs", "one\r\ntwo Call()")])
    assert {tuple(r) for r in navigation.browse(g, "p").collect()} == {("a.cs", False, 1), ("x", True, 2)}
    assert [tuple(r) for r in navigation.file_content(g, "p/a.cs").orderBy("line").collect()] == [(1, "one"), (2, "two Call()")]
    refs = spark.createDataFrame([(1, 1, "N.Call"), (1, 0, "Call"), (1, 99, "Call")], "file_id long, line int, target_name string")
    assert [(r.line, r.target_name) for r in navigation.on_its_line(g, refs).collect()] == [(1, "N.Call")]
    far = navigation.covering(spark.createDataFrame([(1, 2_000_000_000)], "file_id long, line int"), spark.createDataFrame([(1, 5, 0, 2_147_483_646)], "file_id long, id long, first int, last int"))
    assert far.count() == 1  # whatever the length of a span


def test_completion_by_letters(spark, tmp_path):
    g = tables(spark, tmp_path, files=[(1, "p", "p/a.cs", "h", "csharp", 0)], symbols=[sym(1, 1, "getUser", "N.getUser", scope="N"), sym(2, 1, "gatherUsers", "N.gatherUsers", scope="N"), sym(3, 1, "other", "N.other", scope="N")])
    assert {r.name for r in navigation.completion(g, 1, "N", "gU").collect()} == {"getUser"} - {"getUser"}
    assert [r.name for r in navigation.completion(g, 1, "N", "gu", fuzzy=True).collect()][0] == "getUser"
    assert {r.name for r in navigation.completion(g, 1, "N", "gu", fuzzy=True).collect()} == {"getUser", "gatherUsers"}


def test_document_paths():
    assert scip.document_path(".github/a.py") == ".github/a.py" and scip.document_path("./x/a.py") == "x/a.py"
    assert scip.document_path("file:///home/u/p/src\\a.cs", ("/elsewhere", "file:///home/u/p")) == "src/a.cs"
    assert scip.document_path("/abs/a.py") == "abs/a.py"


def test_texts_in_buckets_meet_their_files_without_a_shuffle(spark, tmp_path):
    from skein.sources.tables import bucketed

    files = bucketed(spark.createDataFrame([(i, "p", f"p/{i}.py", "h", "python", 0) for i in range(9)], "id long, project string, path string, hash string, language string, last_indexed long"), "id", "files_in_buckets", str(tmp_path / "f"), 3)
    texts = bucketed(spark.createDataFrame([(i, f"p/{i}.py", f"def f{i}():\n    pass\n") for i in range(9)], "file_id long, path string, content string"), "file_id", "texts_in_buckets", str(tmp_path / "t"), 3)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        found = extract.extract_symbols(files, texts)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE files_in_buckets")
        spark.sql("DROP TABLE texts_in_buckets")


def test_an_index_of_texts(spark):
    from skein.operators.indexing import build_index

    rows = [("p/a.py", "from p.b import helper\n\ndef run():\n    helper(1)\n    lost()\n"), ("p/b.py", "def helper(x):\n    return x\n"), ("p/node_modules/c.py", "def no(): pass\n"), ("p/notes.zzz", "x"), (None, "x"), ("p/empty.py", None)]
    out = build_index(spark.createDataFrame(rows, "path string, content string"))
    assert {r.path for r in out["files"].collect()} == {"p/a.py", "p/b.py", "p/empty.py"}
    names = {r.id: r.name for r in out["symbols"].collect()}
    assert [(names[r.source_id], names[r.target_id], r.kind, r.source_line, r.confidence) for r in out["edges"].collect()] == [("run", "helper", "calls", 3, 0.95)]
    assert [r.target_name for r in out["unresolved"].collect()] == ["lost"]
    assert {tuple(r)[1:] for r in out["imports"].collect()} == {("helper", "p.b", 0)}


def test_percentiles_are_exact_for_a_hot_key(spark):
    rnd = random.Random(6)
    rows = [("hot", float(rnd.randrange(50))) for _ in range(900)] + [("cold", 1.0), ("cold", 2.0), (None, 3.0), ("none", None)]
    got = {r.k: r for r in aggregates.percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", partitions=7).collect()}
    for k in ("hot", "cold", None):
        v = sorted(x for a, x in rows if a == k)
        assert (got[k].n, got[k].max) == (len(v), v[-1])
        assert [got[k][p] for p in ("p50", "p95", "p99")] == [v[int(q * (len(v) - 1))] for q in (0.5, 0.95, 0.99)]
    assert len(got) == 3
