"""Framework detectors: routes, calls, queues, injections and stereotypes found in source texts.

One pass reads every text that can hold a fact (a word filter in the JVM tells which) and
yields *facts* (kind, line, and up to three values), every hit of every rule; prefixes
that classes, groups, routers and scopes lend to routes are carried along inside a text.
What facts mean together (a call meets a route, a producer a consumer, a service its
implementation) are joins of facts, always within one project.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.batches import map_columns
from skein.functions.scalars import interpolation_pattern, normal_route, plural, routes_match, url_pattern
from skein.operators.graphmodel import CodeGraph

VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
_V = "|".join(VERBS)
_Q = r"[\"'`]([^\"'`\n]*)[\"'`]"
_WEB = ("typescript", "javascript", "tsx", "jsx")
_QUEUES = (*_WEB, "java", "python", "go", "csharp", "ruby")

#: (languages, kind, pattern, group of each value); a value that is a text is itself.
RULES: list[tuple[tuple[str, ...], str, re.Pattern, tuple]] = [
    (langs, kind, re.compile(pattern, re.M), take)
    for langs, kind, pattern, take in (
        (_WEB, "call", rf"(?i:\b(?:axios|http|httpClient|\$http|api|client|\$)\.({_V}))\s*(?:<[^>\n]*>)?\s*\(\s*{_Q}", (1, 2)),
        (_WEB, "call", rf"\bfetch\s*\(\s*{_Q}(?:\s*,\s*\{{[^}}]*method\s*:\s*[\"'](\w+)[\"'])?", (2, 1)),
        (("python",), "call", rf"\b(?:requests|httpx|session|client)\.({_V})\s*\(\s*f?{_Q}", (1, 2)),
        (("go",), "call", rf"\bhttp\.(Get|Post|Head|PostForm)\s*\(\s*{_Q}", (1, 2)),
        (("java",), "call", rf"\brestTemplate\.(get|post|put|delete)\w*\s*\(\s*{_Q}", (1, 2)),
        (("ruby",), "call", rf"\b(?:HTTParty|Faraday|RestClient|Net::HTTP)\.({_V})\s*\(?\s*(?:URI\()?{_Q}", (1, 2)),
        (("csharp",), "client_call", r"\b(Get|Post|Put|Delete|Patch)\w*Async(?:<[^>\n]*>)?\s*\(\s*\$?\"([^\"\n]*)\"", (1, 2)),
        (("csharp",), "client_uri", r"\b(?:CombineUri|new\s+Uri)\s*\([^,\n]+,\s*\$?\"([^\"\n]+)\"", (1,)),
        (("csharp",), "route", r"(?P<o>\w+)\.Map(Get|Post|Put|Delete|Patch)\s*\(\s*\"([^\"\n]*)\"", (2, 3)),
        (("python",), "route", rf"@(?P<o>\w+)\.({_V})\s*\(\s*{_Q}", (2, 3)),
        (("python",), "route", rf"@(?P<o>\w+)\.route\s*\(\s*{_Q}", ("get", 2)),
        (("python",), "route", rf"^\s*(?:path|re_path|url)\s*\(\s*r?{_Q}", ("get", 1)),
        (("python",), "handler", rf"^\s*(?:path|re_path|url)\s*\(\s*r?[\"'][^\"'\n]*[\"']\s*,\s*(?:\w+\.)*(\w+)", (1,)),
        (("go",), "route", rf"(?P<o>\w+)\.(GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch)\s*\(\s*{_Q}\s*,", (2, 3)),
        (("go",), "route", rf"(?P<o>\w+)\.(?:HandleFunc|Handle)\s*\(\s*{_Q}", ("get", 2)),
        (("csharp",), "inject", r"\.Add(?:Scoped|Transient|Singleton)\s*<\s*([\w.]+)\s*,\s*([\w.]+)\s*>", (1, 2)),
        (("csharp",), "event_class", r"\b(?:class|record)\s+(\w+)[^{\n]*:\s*[^{\n]*\bIntegrationEvent\b", (1,)),
        (("csharp",), "event_handler", r"\bIIntegrationEventHandler\s*<\s*(\w+)\s*>", (1,)),
        (("csharp",), "db_set", r"\bDbSet\s*<\s*(\w+)\s*>\s+(\w+)", (1, 2)),
        (("typescript",), "injectable", r"@Injectable\s*\([^@]{0,400}?\bclass\s+(\w+)", (1,)),
        (("java",), "stereotype", r"@(Service|Repository|Component|Controller|RestController|Configuration)\b", (1,)),
        (_QUEUES, "produce", rf"(?i:\b(kafka\w*|producer|rabbit\w*|channel|nats|nc|sqs\w*)\.(?:send|publish|produce|sendToQueue|basicPublish|sendMessage|send_message|convertAndSend))\w*\s*\(\s*(?:\{{\s*topic\s*:\s*)?{_Q}", (2, 1)),
        (_QUEUES, "consume", rf"(?i:\b(kafka\w*|consumer|rabbit\w*|channel|nats|nc|sqs\w*)\.(?:subscribe|consume|basicConsume|receiveMessage|receive_message))\w*\s*\(\s*(?:\{{\s*topic\s*:\s*)?{_Q}", (2, 1)),
        (("java",), "consume", rf"@(Kafka|Rabbit|Sqs)Listener\s*\(\s*(?:topics|queues)?\s*=?\s*\{{?\s*{_Q}", (2, 1)),
        (("rust",), "tauri_command", r"#\[(?:tauri::)?command[^\]]*\]\s*(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", (1,)),
        (_WEB, "tauri_invoke", rf"\binvoke\s*(?:<[^>\n]*>)?\s*\(\s*{_Q}", (1,)),
        ((*_WEB, "rust"), "emit", rf"\b(?:emit|emit_all)\s*\(\s*{_Q}", (1,)),
        ((*_WEB, "rust"), "listen", rf"\b(?:listen|once)\s*(?:<[^>\n]*>)?\s*\(\s*{_Q}", (1,)),
        (_WEB, "ipc_main", rf"\bipcMain\.(?:handle|on|once)\s*\(\s*{_Q}", (1,)),
        (_WEB, "ipc_renderer", rf"\bipcRenderer\.(?:invoke|send|sendSync)\s*\(\s*{_Q}", (1,)),
        (_WEB, "store", r"\b(?:const|let)\s+(use\w*Store)\s*=\s*create\b", (1,)),
        (("python",), "model", r"^class\s+(\w+)\s*\([^)\n]*\bmodels\.Model\b", (1,)),
        (("python",), "view", r"^class\s+(\w+)\s*\([^)\n]*View(?:Set)?\b", (1, "class")),
        (("python",), "view", r"^\s*(?:async\s+)?def\s+((?!test_)\w+)\s*\(\s*request\b", (1, "function")),
    )
]
#: Words of which a text of the language must hold one to be read; others hold no fact.
HINTS = {
    "csharp": r"Async|CombineUri|new\s+Uri|\.Map(?:Get|Post|Put|Delete|Patch|Group)|\.Add(?:Scoped|Transient|Singleton)|IntegrationEvent|DbSet|\[Http|(?i:kafka|rabbit|nats|sqs|channel|producer|consumer|nc\.)",
    "python": r"requests\.|httpx\.|session\.|client\.|@\w+\.|path\s*\(|url\s*\(|models\.Model|View|request\b|(?i:kafka|rabbit|nats|sqs|channel|producer|consumer|nc\.)",
    "java": r"restTemplate|@(?:Service|Repository|Component|Controller|RestController|Configuration|Kafka|Rabbit|Sqs)|Mapping|(?i:kafka|rabbit|nats|sqs|channel|producer|consumer|nc\.)",
    "go": r"http\.|\.(?:GET|POST|PUT|DELETE|PATCH|Get|Post|Put|Delete|Patch|Handle|HandleFunc|Group)\s*\(|(?i:kafka|rabbit|nats|sqs|channel|producer|consumer|nc\.)",
    "ruby": r"HTTParty|Faraday|RestClient|Net::HTTP|resources?\s+:|namespace\s|scope\s|root\s|\b(?:get|post|put|patch|delete)\s+[\"']|(?i:kafka|rabbit|nats|sqs|channel|producer|consumer|nc\.)",
    "rust": r"command|emit|listen|once",
    "php": r"Route::",
    "protobuf": r"\brpc\s",
    "graphql": r"\btype\s+(?:Query|Mutation|Subscription)",
}
_CLASS_ROUTE = {"csharp": rf"\[Route\(\s*\"([^\"\n]*)\"", "java": rf"@RequestMapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?{_Q}", "typescript": r"@Controller\s*\(\s*(?:[\"'`]([^\"'`\n]*)[\"'`])?"}
_VERB_ROUTE = {
    "csharp": r"\[Http(Get|Post|Put|Delete|Patch)(?:\(\s*\"([^\"\n]*)\")?",
    "java": r"@(Get|Post|Put|Delete|Patch)Mapping\b\s*(?:\(\s*(?:value\s*=\s*|path\s*=\s*)?[\"']([^\"'\n]*)[\"'])?",
    "typescript": r"@(Get|Post|Put|Delete|Patch)\s*\(\s*(?:[\"'`]([^\"'`\n]*)[\"'`])?\s*\)",
}
_CONTROLLERS = {k: re.compile(rf"(?P<route>{_CLASS_ROUTE[k]})|(?P<verb>{_VERB_ROUTE[k]})|\b(?:class|record)\s+(?P<class>\w+)") for k in _CLASS_ROUTE}
_GROUPS = {
    "go": re.compile(rf"(?P<v>\w+)\s*:?=\s*(?P<of>\w+)\.(?:Group|PathPrefix)\(\s*{_Q}"),
    "csharp": re.compile(r"(?P<v>\w+)\s*=\s*(?P<of>\w+)\.MapGroup\(\s*\"([^\"\n]*)\""),
}
_ROUTER = re.compile(r"(\w+)\s*=\s*(?:APIRouter|Blueprint)\s*\(|\.(?:include_router|register_blueprint)\s*\(\s*(?:\w+\.)?(\w+)")
_PREFIX = re.compile(r"\b(?:prefix|url_prefix)\s*=\s*[\"']([^\"']*)")
_PARAM = re.compile(r"\b(?:private|public|protected)\s+(?:readonly\s+)?\w+\s*:\s*([A-Z]\w*)")
_CLASS_OR_MAKER = re.compile(r"\bclass\s+(\w+)|\bconstructor\s*\(")
_API_CONST = re.compile(r"\b(?:const|static\s+readonly)\s+string\s+(\w*(?:Api|Url|Base|Endpoint)\w*)\s*=\s*\"([^\"\n]+)\"")
_SERVICE = re.compile(r"^\s*service\s+(?P<s>\w+)|^\s*rpc\s+(?P<r>\w+)\s*\(", re.M)
_NEARBY = re.compile(r"(?i)\b(get|post|put|delete|patch)(?:\w*async\b|\s*[(<])")


def _join(*parts: str | None) -> str:
    return "/" + "/".join(p.strip("/") for p in parts if p and p.strip("/"))


def _arguments(text: str, at: int) -> str:
    """What stands in the brackets that open at or behind a position."""
    start = text.find("(", at)
    if start < 0:
        return ""
    depth = 0
    for m in re.compile(r"[()]").finditer(text, start):
        depth += 1 if m[0] == "(" else -1
        if not depth:
            return text[start + 1 : m.start()]
    return text[start + 1 :]


def _prefixes(language: str, text: str) -> dict[str, str]:
    """The prefix that each router or group variable of a text lends to its routes."""
    out: dict[str, str] = {}
    if language in _GROUPS:
        for m in _GROUPS[language].finditer(text):
            out[m["v"]] = _join(out.get(m["of"]), m[3])
    if language == "python":
        mounts: dict[str, str] = {}
        for m in _ROUTER.finditer(text):
            p = _PREFIX.search(_arguments(text, m.start()))
            if m[1]:
                out[m[1]] = p[1] if p else ""
            elif p:
                mounts[m[2]] = p[1]
        out |= {v: _join(p, out.get(v)) for v, p in mounts.items()}
    return out


def facts_of(language: str, path: str, content: str) -> list[tuple[str, int, str | None, str | None, str | None]]:
    """(kind, line from 1, a, b, c) of one text, in order of kind and place. Routes are (method, template, framework)."""
    if language in ("ruby", "php", "graphql"):
        out = _by_lines(language, content)
    else:
        out = []
    breaks = [m.start() for m in re.finditer("\n", content)]
    # a match may begin with the line break before what it is about
    line_of = lambda m: bisect_right(breaks, m.start() + len(m[0]) - len(m[0].lstrip()) - 1) + 1
    groups = _prefixes(language, content)
    consts = dict(_API_CONST.findall(content)) if language == "csharp" else {}
    for langs, kind, pattern, take in RULES:
        if language not in langs:
            continue
        for m in pattern.finditer(content):
            n = line_of(m)
            vals = [m[g] if isinstance(g, int) else g for g in take]
            if kind == "call":
                vals = [(vals[0] or "get").upper(), vals[1]]
            elif kind == "client_call":
                vals = [vals[0].upper(), _inlined(vals[1], consts)]
            elif kind == "client_uri":
                kind_, vals = "client_call", [_method_near(content, breaks, n), _inlined(vals[0], consts)]
                out.append((kind_, n, *vals, None))
                continue
            elif kind == "route":
                owner = m.groupdict().get("o")
                vals = [vals[0].upper(), _join(groups.get(owner), vals[1]), "django" if not owner and language == "python" else language]
            elif kind in ("produce", "consume"):
                word = re.match(r"(?i)kafka|rabbit|nats|nc|sqs|channel|producer|consumer", vals[1])[0].lower()
                vals[1] = {"nc": "nats", "channel": "rabbit", "producer": "kafka", "consumer": "kafka"}.get(word, word)
            out.append((kind, n, *(vals + [None] * (3 - len(vals)))))
    if language in _CONTROLLERS:
        _controllers(language, content, line_of, out)
    if language == "typescript":
        _injected(content, breaks, out)
    if language == "protobuf":
        service = None
        for m in _SERVICE.finditer(content):
            if m["s"]:
                service = m["s"]
            elif service:
                out.append(("rpc", line_of(m), service, m["r"], None))
    if re.search(r"\.stories\.[jt]sx?$", path):
        out.append(("story", 1, path.rsplit("/", 1)[-1].split(".")[0], None, None))
    return out


def _inlined(url: str, consts: dict[str, str]) -> str:
    """A URL with the text's own constants in place of their names."""
    return re.sub(r"\{(\w+)\}", lambda m: consts.get(m[1], m[0]), url)


def _method_near(content: str, breaks: list[int], line: int) -> str:
    """The method of the first client call within three lines around, GET without one."""
    lo, hi = max(0, line - 4), line + 2
    m = _NEARBY.search(content, breaks[lo - 1] + 1 if lo else 0, breaks[hi] if hi < len(breaks) else len(content))
    return m[1].upper() if m else "GET"


def _controllers(language: str, content: str, line_of, out: list) -> None:
    """Routes that annotations of methods name, below what the annotation of their class names."""
    prefix, pending = "", None
    for m in _CONTROLLERS[language].finditer(content):
        vals = [x for x in m.groups()]
        if m["route"] is not None:
            pending = vals[1] or ""
        elif m["verb"] is not None:
            out.append(("route", line_of(m), vals[3].upper(), _join(prefix, vals[4]), language))
        else:
            name = re.sub(r"(?i)controller$", "", m["class"])
            prefix, pending = (pending or "").replace("[controller]", name.lower()), None


def _injected(content: str, breaks: list[int], out: list) -> None:
    """Types that the constructor of a class asks for."""
    inside = None
    for m in _CLASS_OR_MAKER.finditer(content):
        if m[1]:
            inside = m[1]
            continue
        args = _arguments(content, m.start())
        start = content.find("(", m.start()) + 1
        for p in _PARAM.finditer(args):
            out.append(("inject_param", bisect_right(breaks, start + p.start() - 1) + 1, p[1], inside, None))


def _by_lines(language: str, content: str) -> list[tuple]:
    """Facts of languages whose scopes are followed line by line."""
    out: list[tuple] = []
    stack: list[tuple[int, str]] = []
    depth = 0
    for n, line in enumerate(content.split("\n"), 1):
        if language == "ruby":
            _rails(line, n, stack, out)
        elif language == "php":
            _laravel(line, n, stack, out)
        else:
            # fields stand directly inside the block of an operation type
            m = re.match(r"\s*(?:extend\s+)?type\s+(Query|Mutation|Subscription)\b", line)
            if m and not depth:
                depth = 1
                stack.append((n, m[1].lower()))
                continue
            if not depth:
                continue
            depth += line.count("{") - line.count("}")
            f = re.match(r"\s*(?!__)(\w+)\s*(?:\([^)]*\))?\s*:", line)
            if f and depth == 1:
                out.append(("field", n, f[1], stack[-1][1], None))
    return out


def _rails(line: str, n: int, stack: list, out: list) -> None:
    body = line.strip()
    at = len(line) - len(line.lstrip())
    if body == "end":
        while stack and stack[-1][0] >= at:
            stack.pop()
        return
    base = "".join(p for _, p in stack)
    m = re.match(r"(?:namespace|scope)\s+[:\"']([\w/-]+)", body)
    if m and body.endswith("do"):
        stack.append((at, "/" + m[1].strip("/")))
        return
    m = re.match(r"resources?\s+:(\w+)(.*)", body)
    if m:
        only = re.search(r"only:\s*(?:\[([^\]]*)\]|:(\w+))", m[2])
        names = re.findall(r"\w+", only[1] or only[2]) if only else ["index", "new", "create", "show", "edit", "update", "destroy"]
        shapes = {"index": ("GET", ""), "new": ("GET", "/new"), "create": ("POST", ""), "show": ("GET", "/{id}"), "edit": ("GET", "/{id}/edit"), "update": ("PATCH", "/{id}"), "destroy": ("DELETE", "/{id}")}
        for a in names:
            if a in shapes:
                out.append(("route", n, shapes[a][0], f"{base}/{m[1]}{shapes[a][1]}", "rails"))
        if body.endswith("do"):
            stack.append((at, f"/{m[1]}/{{id}}"))
        return
    m = re.match(rf"({_V})\s+[\"']([^\"']*)[\"']", body)
    if m:
        out.append(("route", n, m[1].upper(), _join(base, re.sub(r":(\w+)", r"{\1}", m[2])), "rails"))
    m = re.match(r"root\s+(?:to:\s*)?[\"']", body)
    if m:
        out.append(("route", n, "GET", base or "/", "rails"))


def _laravel(line: str, n: int, stack: list, out: list) -> None:
    body = line.strip()
    if body.startswith("});") or body == "});":
        if stack:
            stack.pop()
        return
    base = "".join(p for _, p in stack)
    m = re.search(r"Route::.*?prefix\(\s*'([^']*)'\s*\).*group\(", body)
    if m:
        stack.append((n, "/" + m[1].strip("/")))
        return
    if re.search(r"Route::.*group\(", body):
        stack.append((n, ""))
        return
    m = re.search(rf"Route::({_V})\(\s*'([^']*)'", body)
    if m:
        out.append(("route", n, m[1].upper(), _join(base, m[2]), "laravel"))
    m = re.search(r"Route::match\(\s*\[([^\]]*)\]\s*,\s*'([^']*)'", body)
    if m:
        for v in re.findall(r"\w+", m[1]):
            out.append(("route", n, v.upper(), _join(base, m[2]), "laravel"))
    m = re.search(r"Route::(apiResource|resource)\(\s*'([^']*)'", body)
    if m:
        one = [("GET", ""), ("POST", ""), ("GET", "/{id}"), ("PUT", "/{id}"), ("DELETE", "/{id}")]
        for v, tail in one + ([("GET", "/create"), ("GET", "/{id}/edit")] if m[1] == "resource" else []):
            out.append(("route", n, v, _join(base, m[2]) + tail, "laravel"))


def _scan(cols):
    out: dict[str, list] = {k: [] for k in ("project", "file_id", "language", "kind", "line", "a", "b", "c")}
    for j, i, language, path, content in zip(*(cols[k] for k in ("project", "file_id", "language", "path", "content"))):
        for row in facts_of(language or "", path or "", content or ""):
            for k, v in zip(out, (j, i, language, *row)):
                out[k].append(v)
    return out


def scan_texts(files: DataFrame, sources: DataFrame) -> DataFrame:
    """project, file_id, language, kind, line, a, b, c of all facts in all texts."""
    f = files.select(F.col("id").alias("file_id"), "project", "language", "path")
    read = f.join(sources.select("file_id", "content"), "file_id")
    hint = reduce(lambda c, kv: c.when(F.col("language") == kv[0], F.col("content").rlike(kv[1])), HINTS.items(), F.when(F.lit(False), F.lit(True)))
    read = read.filter(F.coalesce(hint.otherwise(F.col("language").isin(*_WEB)), F.lit(False)))
    return map_columns(read, _scan, "project string, file_id long, language string, kind string, line int, a string, b string, c string")


def scan(g: CodeGraph) -> DataFrame:
    """The facts of a graph's texts."""
    return scan_texts(g.files, g.read("source_files"))


def routes(facts: DataFrame) -> DataFrame:
    """project, file_id, line, http_method, route_template, resolved_route, framework."""
    r = facts.filter("kind = 'route'").select("project", "file_id", "line", F.col("a").alias("http_method"), F.col("b").alias("route_template"), F.col("c").alias("framework")).distinct()
    return r.withColumn("resolved_route", F.col("route_template"))


def match_routes(calls: DataFrame, routes_: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Calls (call_id, method, url) and routes (route_id, method, template) that fit: call_id, route_id, confidence (1.0 exact, 0.8 by wildcard); only such as agree in the columns of ``within``.

    A route with wildcards is filed under its literal segments and where they stand. A call
    asks once for each such pattern of places that routes of its length have, so that
    calls and routes meet by equality and only where they fit. Calls with holes of their
    own are few and are compared with the routes of their method and length."""
    own = within or []
    c = calls.select(*own, "call_id", F.upper("method").alias("method"), F.split(normal_route(url_pattern("url")), "/").alias("cs")).withColumn("n", F.size("cs"))
    r = routes_.select(*own, "route_id", F.upper("method").alias("method"), F.split(normal_route("template"), "/").alias("rs")).withColumn("n", F.size("rs"))
    exact = c.withColumnRenamed("cs", "rs").join(r, [*own, "method", "rs"]).select("call_id", "route_id", F.lit(1.0).alias("confidence"))
    places = F.expr("filter(transform(rs, (x, i) -> IF(x = '{*}', -1, i)), i -> i >= 0)")
    wild = r.filter(F.array_contains("rs", "{*}")).withColumn("places", places).withColumn("key", F.filter("rs", lambda x: x != "{*}"))
    patterns = wild.select(*own, "method", "n", "places").distinct()
    whole, holed = c.filter(~F.array_contains("cs", "{*}")), c.filter(F.array_contains("cs", "{*}"))
    asked = whole.join(patterns, [*own, "method", "n"]).withColumn("key", F.expr("transform(places, i -> cs[i])"))
    loose = asked.join(wild.select(*own, "route_id", "method", "n", "places", "key"), [*own, "method", "n", "places", "key"]).select("call_id", "route_id", F.lit(0.8).alias("confidence"))
    text = lambda x: F.array_join(x, "/")
    odd = holed.join(r, [*own, "method", "n"]).filter(routes_match(text("cs"), text("rs")) & (F.col("cs") != F.col("rs"))).select("call_id", "route_id", F.lit(0.8).alias("confidence"))
    return exact.unionByName(loose).unionByName(odd)


FLOW = ("project", "source_file_id", "source_line", "target_file_id", "target_line", "edge_type", "confidence", "url_pattern")


def _flow(df: DataFrame, edge_type: str, confidence, pattern: str) -> DataFrame:
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    return df.select("project", "source_file_id", "source_line", "target_file_id", "target_line", F.lit(edge_type).alias("edge_type"), sure.cast("double").alias("confidence"), F.col(pattern).alias("url_pattern"))


def pair_facts(facts: DataFrame, left: str, right: str, edge_type: str, confidence: float, keys: tuple[str, ...] = ("a",)) -> DataFrame:
    """Flow edges between facts of a project that agree: a producer and a consumer, an invocation and a command."""
    a = facts.filter(F.col("kind") == left).select("project", *keys, F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"))
    b = facts.filter(F.col("kind") == right).select("project", *keys, F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"))
    return _flow(a.join(b, ["project", *keys]), edge_type, confidence, "a")


PAIRS = (("produce", "consume", "message_queue", 0.85, ("a", "b")), ("tauri_invoke", "tauri_command", "tauri_ipc", 0.95, ("a",)), ("emit", "listen", "tauri_event", 0.90, ("a",)), ("ipc_renderer", "ipc_main", "electron_ipc", 0.90, ("a",)), ("event_class", "event_handler", "event_handler", 0.90, ("a",)), ("inject_param", "injectable", "di_binding", 0.85, ("a",)))


def http_flows(facts: DataFrame) -> DataFrame:
    """http_call edges from calls to the routes of their project that fit; .NET clients count as a little less sure."""
    r = routes(facts).select("project", F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"), F.col("http_method").alias("method"), F.col("resolved_route").alias("template"))
    r = r.withColumn("route_id", F.xxhash64("target_file_id", "target_line", "method", "template"))
    c = facts.filter(F.col("kind").isin("call", "client_call")).select("project", F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"), F.col("a").alias("method"), F.when(F.col("kind") == "call", F.col("b")).otherwise(interpolation_pattern("b")).alias("url"), (F.col("kind") == "client_call").alias("dotnet"))
    c = c.withColumn("call_id", F.xxhash64("source_file_id", "source_line", "method", "url", "dotnet"))
    met = match_routes(c, r, ["project"]).groupBy("call_id", "route_id").agg(F.max("confidence").alias("sure"))
    both = met.join(c.dropDuplicates(["call_id"]), "call_id").join(r.drop("project", "method"), "route_id")
    return _flow(both, "http_call", F.when(~F.col("dotnet"), F.col("sure")).when(F.col("sure") == 1.0, 0.90).otherwise(0.75), "url")


def grpc_flows(facts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """grpc_call edges from remote procedures to the methods of their name in the file of the C# class that is named like the service, or like it and Base."""
    f = files.filter("language = 'csharp'").select(F.col("id").alias("target_file_id"), "project")
    s = symbols.select(F.col("file_id").alias("target_file_id"), "name", "kind", "id", (F.col("line") + 1).alias("target_line")).join(f, "target_file_id")
    rpc = facts.filter("kind = 'rpc'").select("project", F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"), F.col("a").alias("service"), F.col("b").alias("name"))
    names = rpc.select("project", "service").distinct().select("project", "service", F.explode(F.array("service", F.concat("service", F.lit("Base")))).alias("name"))
    homes = names.join(s.filter("kind = 'class'"), ["project", "name"]).groupBy("project", "service").agg(F.min(F.struct("id", "target_file_id")).alias("x")).select("project", "service", F.col("x.target_file_id").alias("target_file_id"))
    methods = s.filter("kind = 'method'").groupBy("target_file_id", "name").agg(F.min(F.struct("id", "target_line")).alias("m")).select("target_file_id", "name", F.col("m.target_line").alias("target_line"))
    return _flow(rpc.join(homes, ["project", "service"]).join(methods, ["target_file_id", "name"]), "grpc_call", 0.90, "name")


def graphql_flows(facts: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """graphql_resolver edges from the fields of operations to functions and methods of their name (the first ten of a name in a project)."""
    asked = facts.filter("kind = 'field'").select("project", F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"), F.col("a").alias("name"))
    f = files.select(F.col("id").alias("target_file_id"), "project")
    s = symbols.filter(F.col("kind").isin("function", "method")).select("id", F.col("file_id").alias("target_file_id"), "name", (F.col("line") + 1).alias("target_line"))
    s = s.join(f, "target_file_id").join(asked.select("project", "name").distinct(), ["project", "name"], "left_semi")
    first = s.withColumn("k", F.row_number().over(Window.partitionBy("project", "name").orderBy("id"))).filter(F.col("k") <= most)
    return _flow(asked.join(first, ["project", "name"]), "graphql_resolver", 0.80, "name")


def spring_flows(facts: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """di_binding edges from the interfaces that classes with a stereotype implement to these classes."""
    beans = stereotype_concepts(facts.filter("kind = 'stereotype'"), symbols.filter("kind = 'class'")).select(F.col("symbol_id").alias("source_id")).distinct()
    at = symbols.select("id", "file_id", "name", (F.col("line") + 1).alias("line"))
    e = edges.filter("kind = 'implements'").select("source_id", "target_id").distinct().join(beans, "source_id", "left_semi")
    impl = at.select(F.col("id").alias("source_id"), F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"), F.col("name").alias("impl"))
    face = at.select(F.col("id").alias("target_id"), F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"))
    homes = facts.select("project", F.col("file_id").alias("target_file_id")).distinct()
    return _flow(e.join(impl, "source_id").join(face, "target_id").join(homes, "target_file_id"), "di_binding", 0.85, "impl")


def django_flows(facts: DataFrame) -> DataFrame:
    """django_model and django_view edges: each leads from its declaration to itself."""
    d = facts.filter(F.col("kind").isin("model", "view")).select("project", F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"), F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"), "kind", "a", "b").distinct()
    sure = F.when(F.col("kind") == "model", 0.95).when(F.col("b") == "class", 0.90).otherwise(0.85)
    return d.select("project", "source_file_id", "source_line", "target_file_id", "target_line", F.concat(F.lit("django_"), "kind").alias("edge_type"), sure.alias("confidence"), F.col("a").alias("url_pattern"))


def flow_facts(facts: DataFrame) -> DataFrame:
    """All flow edges that facts make by meeting each other."""
    return reduce(DataFrame.unionByName, [*(pair_facts(facts, *p) for p in PAIRS), http_flows(facts), django_flows(facts)])


def all_flows(facts: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """All flow edges of the connectors: those of facts alone, and those that need symbols and edges."""
    bound = di_bindings(facts, symbols, files)
    at = symbols.select("id", "file_id", "name", (F.col("line") + 1).alias("line"))
    i = at.select(F.col("id").alias("target_id"), F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"))
    c = at.select(F.col("id").alias("source_id"), F.col("file_id").alias("target_file_id"), F.col("line").alias("target_line"), F.col("name").alias("impl"))
    dotnet = _flow(bound.join(i, "target_id").join(c, "source_id"), "di_binding", 0.90, "impl")
    return reduce(DataFrame.unionByName, [flow_facts(facts), grpc_flows(facts, symbols, files), graphql_flows(facts, symbols, files), spring_flows(facts, symbols, edges), dotnet])


def di_bindings(facts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Registered interface and implementation as symbols of the project: project, source_id (implementation), target_id (interface), kind implements, confidence 0.9. Of several symbols of a name the first counts."""
    s = symbols.filter(F.col("kind").isin("class", "struct", "interface")).select("id", "name", "file_id").join(files.select(F.col("id").alias("file_id"), "project"), "file_id")
    s = s.groupBy("project", "name").agg(F.min("id").alias("id"))
    i = facts.filter("kind = 'inject'").select("project", F.element_at(F.split("a", r"\."), -1).alias("interface"), F.element_at(F.split("b", r"\."), -1).alias("impl")).distinct()
    both = i.join(s.select("project", F.col("id").alias("target_id"), F.col("name").alias("interface")), ["project", "interface"]).join(s.select("project", F.col("id").alias("source_id"), F.col("name").alias("impl")), ["project", "impl"])
    return both.select("project", "source_id", "target_id", F.lit("implements").alias("kind"), F.lit(0.9).alias("confidence"))


def db_mappings(facts: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """project, symbol_id, entity_type, table_name, source: entity sets and models with their tables, named or by the plural of the type."""
    sets = facts.filter(F.col("kind").isin("db_set", "model")).select("project", F.col("a").alias("entity_type"), F.coalesce("b", plural("a")).alias("table_name"), F.when(F.col("b").isNull(), "convention").otherwise("attribute").alias("source")).distinct()
    s = symbols.filter(F.col("kind").isin("class", "struct")).join(files.select(F.col("id").alias("file_id"), "project"), "file_id")
    first = s.groupBy("project", F.col("name").alias("entity_type")).agg(F.min("id").alias("symbol_id"))
    return sets.join(first, ["project", "entity_type"]).select("project", "symbol_id", "entity_type", "table_name", "source")


def _below(marks: DataFrame, lines: int = 3) -> DataFrame:
    """Each mark once for each of the lines from its own on, so that it meets what is declared there by equality."""
    return marks.withColumn("line", F.explode(F.expr(f"sequence(at, at + {lines})")))


def stereotype_concepts(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """name, symbol_id: symbols under the stereotype, store or story that marks them (what is declared first within three lines of the mark)."""
    marks = facts.filter(F.col("kind").isin("stereotype", "store", "story", "injectable")).select("file_id", F.when(F.col("kind") == "stereotype", F.concat(F.lit("spring-"), F.lower("a"))).otherwise(F.concat("kind", F.lit("s"))).alias("name"), F.col("line").alias("at")).distinct()
    s = symbols.groupBy("file_id", (F.col("line") + 1).alias("line")).agg(F.min("id").alias("symbol_id"))
    near = _below(marks).join(s, ["file_id", "line"])
    return near.groupBy("name", "file_id", "at").agg(F.min(F.struct("line", "symbol_id")).alias("x")).select("name", F.col("x.symbol_id").alias("symbol_id")).distinct()


def routes_with_handlers(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Routes with their handlers: the function that the route names, else the one declared within three lines below it, if any: http_method, route_template, file_id, line, symbol_id."""
    r = routes(facts).select("project", "file_id", "http_method", "route_template", F.col("line").alias("at"))
    s = symbols.filter(F.col("kind").isin("method", "function", "test")).groupBy("file_id", (F.col("line") + 1).alias("line")).agg(F.min("id").alias("symbol_id"))
    key = ["file_id", "at", "http_method", "route_template"]
    near = _below(r).join(s, ["file_id", "line"]).groupBy(*key).agg(F.min(F.struct("line", "symbol_id")).alias("x"))
    said = facts.filter("kind = 'handler'").select("project", "file_id", F.col("line").alias("at"), F.col("a").alias("name"))
    home = facts.select("project", "file_id").distinct()
    views = symbols.filter(F.col("kind").isin("function", "method", "class")).join(home, "file_id").groupBy("project", "name").agg(F.min("id").alias("named"))
    named = said.join(views, ["project", "name"]).groupBy("file_id", "at").agg(F.min("named").alias("named"))
    best = r.join(near, key, "left").join(named, ["file_id", "at"], "left")
    return best.select("http_method", "route_template", "file_id", F.col("at").alias("line"), F.coalesce("named", "x.symbol_id").alias("symbol_id"))
