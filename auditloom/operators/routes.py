"""Web routes of source files, by a table of patterns, and what else files tell: tech stack, directories, middleware.

A pattern names its groups: path, and where there are such, verb (or verbs, a list),
handler. Patterns run over Arrow batches of files; everything after is plain Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.blocks import Block, Blocks
from ..functions.paths import auth_kind, file_role, join_routes
from ..functions.text import contains_any, text_or_empty
from .rule_hits import top

MAX_FILE = 500_000
_VERBS = "get|post|put|delete|patch|head|options"
_Q = r"""["'`](?P<path>[^"'`\n]*)["'`]"""
#: The next function's name, within what usually lies between a decorator and it.
_NEXT_PY = r"(?=(?:[^\n]*\n){1,6}?\s*(?:async\s+)?def\s+(?P<handler>\w+))?"
_NEXT_C = r"(?=[\s\S]{0,300}?\b(?P<handler>\w+)\s*\([^;{}]*\)\s*(?:throws\s+[\w.,\s]+)?(?:=>|\{|async))?"


@dataclass(frozen=True)
class RoutePattern:
    kind: str
    extensions: tuple[str, ...]
    pattern: str
    verb: str = ""
    needs: str = ""
    local: str = ""  # pattern of a prefix that holds for the file, with group path
    crud: bool = False


_JS, _PY, _PHP = (".js", ".ts", ".mjs", ".cjs", ".jsx", ".tsx"), (".py",), (".php",)
PATTERNS = (
    RoutePattern("flask", _PY, rf"@\w+\.route\(\s*{_Q}(?P<verbs>[^)]*methods\s*=\s*[\[(][^\])]*[\])])?[^)]*\){_NEXT_PY}", "GET", "", r"""Blueprint\([^)]*url_prefix\s*=\s*["'](?P<path>[^"']*)["']"""),
    RoutePattern("flask_rule", _PY, rf"\.add_url_rule\(\s*{_Q}(?:[^)]*view_func\s*=\s*(?P<handler>[\w.]+))?(?P<verbs>[^)]*methods\s*=\s*[\[(][^\])]*[\])])?", "GET"),
    RoutePattern("fastapi", _PY, rf"@\w+\.(?P<verb>{_VERBS})\(\s*{_Q}[^\n]*{_NEXT_PY}", "", "", r"""APIRouter\([^)]*prefix\s*=\s*["'](?P<path>[^"']*)["']"""),
    RoutePattern("fastapi_many", _PY, rf"@\w+\.api_route\(\s*{_Q}(?P<verbs>[^)]*methods\s*=\s*[\[(][^\])]*[\])])?[^)]*\){_NEXT_PY}", "ANY", "", r"""APIRouter\([^)]*prefix\s*=\s*["'](?P<path>[^"']*)["']"""),
    RoutePattern("websocket", _PY, rf"@\w+\.websocket\(\s*{_Q}[^\n]*{_NEXT_PY}", "WS", "", r"""APIRouter\([^)]*prefix\s*=\s*["'](?P<path>[^"']*)["']"""),
    RoutePattern("aiohttp", _PY, rf"\.add_(?P<verb>{_VERBS})\(\s*{_Q}\s*,\s*(?P<handler>[\w.]+)"),
    RoutePattern("tornado", _PY, rf"\(\s*r?{_Q}\s*,\s*(?P<handler>\w+Handler)\b", "ANY", "tornado"),
    RoutePattern("django", _PY, rf"\b(?:re_)?path\(\s*r?{_Q}\s*,\s*(?P<handler>(?!include\b)[\w.]+)", "ANY", "urlpatterns"),
    RoutePattern("drf_action", _PY, rf"@action\((?=[^)]*url_path\s*=\s*{_Q})?(?P<verbs>[^)]*)\){_NEXT_PY}", "ANY", "@action"),
    RoutePattern("spring", (".java", ".kt"), rf"@(?P<verb>Get|Post|Put|Delete|Patch)Mapping(?:\(\s*(?:(?:value|path)\s*=\s*)?\{{?\s*{_Q}[^)]*\)|\(\s*\)|(?=\s)){_NEXT_C}", "", "", r"""@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*["'](?P<path>[^"']*)["'][^)]*\)(?=[\s\S]{0,200}?\bclass\b)"""),
    RoutePattern("spring_mapping", (".java", ".kt"), rf"@RequestMapping\((?=[^)]*?{_Q})(?=[^)]*method\s*=\s*\{{?\s*(?:RequestMethod\.)?(?P<verb>[A-Z]+))?[^)]*\)(?![^{{;]{{0,200}}?\bclass\b){_NEXT_C}", "ANY", "", r"""@RequestMapping\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*["'](?P<path>[^"']*)["'][^)]*\)(?=[^{;]{0,200}?\bclass\b)"""),
    RoutePattern("jaxrs", (".java", ".kt"), rf"@(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\b(?:\s*@(?!Path\b)\w+(?:\([^)]*\))?)*\s*(?:@Path\(\s*{_Q}\s*\)\s*)?(?:@\w+(?:\([^)]*\))?\s*)*(?:public|private|protected)\s+[\w<>,.?\[\] ]+?\s(?P<handler>\w+)\s*\(", "", "", r"""@Path\(\s*["'](?P<path>[^"']*)["']\s*\)(?=[\s\S]{0,120}?\bclass\b)"""),
    RoutePattern("dotnet", (".cs",), rf"\[Http(?P<verb>Get|Post|Put|Delete|Patch)(?:\(\s*{_Q}[^)]*\))?\]{_NEXT_C}", "", "", r"""\[Route\(\s*["'](?P<path>[^"']*)["']\s*\)\](?=[\s\S]{0,200}?\bclass\b)"""),
    RoutePattern("dotnet_map", (".cs",), rf"\.Map(?P<verb>Get|Post|Put|Delete|Patch)\(\s*{_Q}(?:\s*,\s*(?P<handler>[\w.]+))?"),
    RoutePattern("go_router", (".go",), rf"\b(?P<group>\w+)\.(?P<verb>GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE|Any|All|Get|Post|Put|Delete|Patch|Head|Options|Connect|Trace)\(\s*{_Q}(?:[^)\n]*?,)?\s*,?\s*(?P<handler>[\w.]+)?\s*\)"),
    RoutePattern("go_http", (".go",), rf"\b(?P<group>\w+)\.Handle(?:Func)?\(\s*{_Q}\s*,\s*(?P<handler>[\w.]+)", "ANY"),
    RoutePattern("rails", (".rb",), rf"^\s*(?P<verb>{_VERBS})\s+{_Q}(?:\s*(?:,\s*to:|=>)\s*[\"'](?P<handler>[^\"']+)[\"'])?"),
    RoutePattern("rails_resources", (".rb",), r"^\s*resources\s+:(?P<path>\w+)", "CRUD", "", "", True),
    RoutePattern("rust_attribute", (".rs",), rf"#\[(?P<verb>{_VERBS})\(\s*{_Q}[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(?P<handler>\w+)"),
    RoutePattern("axum", (".rs",), rf"\.route\(\s*{_Q}\s*,\s*(?:\w+::)*(?P<verb>{_VERBS})\(\s*(?P<handler>[\w:]+)"),
    RoutePattern("laravel", _PHP, rf"Route::(?P<verb>{_VERBS}|any)\(\s*{_Q}\s*,\s*(?:\[?\s*(?P<handler>[\w\\:@'\", ]+))?"),
    RoutePattern("laravel_resource", _PHP, rf"Route::(?:apiR|r)esource\(\s*{_Q}", "CRUD", "", "", True),
    RoutePattern("symfony", _PHP, rf"#\[Route\(\s*{_Q}(?P<verbs>[^\]]*methods:\s*\[[^\]]*\])?[^\]]*\]{_NEXT_C}", "ANY"),
    RoutePattern("express", _JS, rf"\b(?P<group>app|router|\w*[rR]outer|server)\.(?P<verb>{_VERBS}|all)\(\s*{_Q}(?:[^)\n]*?,)?\s*,?\s*(?P<handler>[\w.]+)?"),
    RoutePattern("nestjs", _JS, rf"@(?P<verb>Get|Post|Put|Delete|Patch|All)\(\s*(?:{_Q})?\s*\){_NEXT_C}", "", "", r"""@Controller\(\s*(?:\{[^}]*path\s*:\s*)?["'`](?P<path>[^"'`]*)["'`]"""),
)
#: What a resource stands for: verb, path after the resource's, action.
CRUD = (("GET", "", "index"), ("POST", "", "create"), ("GET", "/:id", "show"), ("PUT", "/:id", "update"), ("DELETE", "/:id", "destroy"))
_COMPILED = tuple((p, re.compile(p.pattern, re.M), re.compile(p.local) if p.local else None) for p in PATTERNS)
_GROUPS = re.compile(r"""(?P<name>\w+)\s*:?=\s*(?P<of>\w+)\.Group\(\s*["`](?P<path>[^"`]*)["`]""")
_MOUNTS = re.compile(r"""\.use\(\s*["'`](?P<path>[^"'`]*)["'`]\s*,\s*(?P<name>\w+)\s*\)""")
_PARAMS = re.compile(r"[:{<]\s*(?:\w+:)?(\w+)\s*[}>]?")


class GroupPrefixes:
    """Prefixes of group variables inside a file, each by the last assignment before the place that asks; one that is only assigned later counts from there."""

    def __init__(self, content: str):
        self.made: dict[str, list[tuple[int, str, str]]] = {}
        for m in _GROUPS.finditer(content):
            self.made.setdefault(m["name"], []).append((m.start(), m["of"], m["path"]))
        self.mounts: dict[str, str] = {}
        for m in _MOUNTS.finditer(content):
            self.mounts.setdefault(m["name"], m["path"])

    def at(self, name: str, place: int) -> str | None:
        """The prefix that a name stands for at a place; null if it is no group."""
        path, seen = "", set()
        while name in self.made:
            made = self.made[name]
            k = max(bisect_left(made, (place,)) - 1, 0)
            if (name, k) in seen:  # a cycle stops where it closes
                break
            seen.add((name, k))
            place, name, own = made[k]
            path = own.rstrip("/") + "/" + path.lstrip("/")
        return path.rstrip("/") if seen else self.mounts.get(name)


def _commented(content: str, at: int) -> bool:
    head = content[content.rfind("\n", 0, at) + 1 : at].lstrip()
    return head.startswith(("//", "# ", "*", "--", "<!--")) or content.count('"""', 0, at) % 2 == 1


#: How handlers read what a request brings, by the ending of their file: calls with the name in quotes, and Go's bindings.
_READS = {
    ".py": re.compile(r"""(?i)\breq(?:uest)?\.(?:GET|POST|query_params|args|form|data|json|files|headers|cookies|query|params|body)(?:\.get\(\s*|\s*\[\s*)["']([^"']+)["']"""),
    ".go": re.compile(r"""\.\s*(?:Query|DefaultQuery|GetQuery|PostForm|GetPostForm|DefaultPostForm|Param|Header)\(\s*"([^"]+)\""""),
}
_BINDS = re.compile(r"(?:Should)?Bind(JSON|Json|Query)\([^)&]*&\w+\.(\w+)")
_PY_DEF, _GO_DEF = re.compile(r"^([ \t]*)(?:async[ \t]+)?def[ \t]+(\w+)[ \t]*\([^)]*\)[^:\n]*:", re.M), re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\([^)]*\)[^{\n]*\{", re.M)


def handler_params(path: str, content: str) -> dict[str, list[str]]:
    """Names that each function of a file reads from requests, in order. A Python body ends at the next line that is indented no further than its def, a Go body at the next closing brace at a line's start."""
    found: dict[str, list[str]] = {}
    if path.endswith(".py"):
        for m in _PY_DEF.finditer(content):
            end = re.compile(rf"^(?=[ \t]{{0,{len(m[1])}}}[^\s#])", re.M).search(content, m.end())
            body = content[m.end() : end.start() if end else len(content)]
            found.setdefault(m[2], list(dict.fromkeys(_READS[".py"].findall(body))))
    elif path.endswith(".go"):
        for m in _GO_DEF.finditer(content):
            end = content.find("\n}", m.end())
            body = content[m.end() : end if end >= 0 else len(content)]
            bound = [("query" if kind == "Query" else "body") + ":*" + name for kind, name in _BINDS.findall(body)]
            found.setdefault(m[1], list(dict.fromkeys(_READS[".go"].findall(body) + bound)))
    return found


#: What opens a scope of routes, by the kind of its routes: in the header of a block around them, the group being the prefix.
_SCOPES = {
    "rails": re.compile(r"""^\s*(?:namespace\s+[:"'](?P<a>\w+)|scope\s+(?:path:\s*)?["'](?P<b>[^"']*)["']|scope\s+:(?P<c>\w+)|resources\s+:(?P<many>\w+))"""),
    "go": re.compile(r"""\.(?:Route|Group)\(\s*["`](?P<a>[^"`]*)["`]\s*,\s*func\b[^{]*$"""),
    "laravel": re.compile(r"""(?:Route::|->)prefix\(\s*["'](?P<a>[^"']*)["']\s*\)(?:->\w+\([^)]*\))*->group\(\s*(?:static\s+)?function\b[^{]*$"""),
}


def _scope(blocks: Blocks, kind: str, at: int) -> str:
    """The prefix that the blocks around a place give its route; what is nested in a resource has its id before it."""
    opening = _SCOPES.get("go" if kind.startswith("go_") else kind.split("_")[0])
    parts = []
    for b in blocks.around(at) if opening else ():
        m = opening.search(b.header) if b.kind in ("do", "{") else None
        if m:
            g = {k: v for k, v in m.groupdict().items() if v}
            parts.append(f"{g['many']}/:{g['many'].removesuffix('s')}_id" if "many" in g else next(iter(g.values()), ""))
    return "/".join(x.strip("/") for x in parts if x.strip("/"))


_BOUND = re.compile(r"\bconsumer\s*\.\s*apply\s*$", re.I)
_CHAINED = re.compile(r"\s*\.\s*(exclude|forRoutes)\s*(?=\()", re.I)
_QUOTED, _CONTROLLER = re.compile(r"""["']([^"']+)["']"""), re.compile(r"\b([A-Z][A-Za-z0-9_]*Controller)\b")
_OF_TARGET = {
    "path": re.compile(r"""\bpath\s*:\s*["']([^"']*)["']""", re.I), "method": re.compile(r"\bmethod\s*:\s*RequestMethod\.([A-Za-z_]\w*)", re.I),
    "controller": re.compile(r"\b(?:controller|name)\s*:\s*([A-Za-z_]\w*)", re.I), "handler": re.compile(r"\bhandler\s*:\s*([A-Za-z_]\w*)", re.I),
}
#: Paths that stand for all.
_ALL_PATHS = ("*", "(.*)", "**")


def _targets(blocks: Blocks, args: Block) -> list[tuple[str, str, str, str]]:
    """(method, path, controller, handler) of the arguments of a call: objects, controllers by name, and quoted paths that hold a slash or stand for all, within objects as well."""
    text, out = blocks.inside(args), []
    for b in blocks.outermost(args, "{"):
        got = {k: m[1] if (m := p.search(blocks.inside(b))) else "" for k, p in _OF_TARGET.items()}
        if got["controller"] or _OF_TARGET["path"].search(blocks.inside(b)):
            out.append(((got["method"] or "ANY").upper(), got["path"], got["controller"], got["handler"]))
    out += [("ANY", "", name, "") for name in _CONTROLLER.findall(text)]
    out += [("ANY", path, "", "") for path in _QUOTED.findall(text) if path in _ALL_PATHS[:2] or "/" in path]
    return list(dict.fromkeys(out))


def _left_out(target: tuple, excluded: list[tuple]) -> bool:
    method, path, controller, _ = target
    path = path.strip("/")
    for their_method, their_path, their_controller, _ in excluded:
        their_path = their_path.strip("/")
        by_path = their_path and (their_path in _ALL_PATHS or path == their_path or their_path.endswith("*") and path.startswith(their_path[:-1]))
        if their_method in ("ANY", method) and (by_path or their_controller and controller == their_controller):
            return True
    return False


def bound_routes(content: str) -> Iterator[tuple[str, str, str, int]]:
    """(method, path, handler, offset) of what middleware is bound to: consumer.apply(...).exclude(...).forRoutes(...), without what is excluded; a controller stands for its own path."""
    blocks = Blocks(content)
    for b in blocks.all:
        if b.kind != "(" or not _BOUND.search(content[max(0, b.start - 80) : b.start]):
            continue
        excluded, end = [], b.end
        while m := _CHAINED.match(content, end):
            args = blocks.all[blocks.at[m.end()]]
            if m[1].lower() == "exclude":
                excluded += [*_targets(blocks, args), *(("ANY", path, "", "") for path in _QUOTED.findall(blocks.inside(args)))]
            else:
                for target in _targets(blocks, args):
                    if not _left_out(target, excluded):
                        method, path, controller, handler = target
                        yield method, path or controller, handler or controller or "Unknown", b.start
                break
            end = args.end


_PHP_CONTROLLER = re.compile(r"(?:^|/)app/([^/]+)/controller/([^/.]+)\.([^./]+)\.php$", re.I)
_PHP_DISPATCH = tuple(re.compile(p) for p in (r"\$action\s*=\s*\$this->\w+->url\s*\(\s*3\s*\)", r"method_exists\s*\(\s*\$this\s*,\s*\$action\s*\)", r"\$this->\s*\$action\s*\("))
_PHP_METHOD = re.compile(r"\b(?:public|protected|private)\s+function\s+([A-Za-z_]\w*)\s*\(")


def dispatched_routes(path: str, content: str) -> Iterator[tuple[str, str]]:
    """(path, handler) of a PHP controller that calls its methods by a part of the URL: its default first, then the others, but for display and magic ones."""
    named = _PHP_CONTROLLER.search(path.replace("\\", "/"))
    if not named or not all(p.search(content) for p in _PHP_DISPATCH):
        return
    first = {name.lower(): name for name in reversed(_PHP_METHOD.findall(content))}
    actions = [first[low] for low in dict.fromkeys(n.lower() for n in _PHP_METHOD.findall(content)) if low != "display" and not low.startswith("__")]
    module, controller, surface = named.groups()
    for k, action in enumerate(["index" if any(a.lower() == "index" for a in actions) else actions[0], *(a for a in actions if a.lower() != "index")] if actions else []):
        yield f"/index.php?{module}-{surface}-{controller}" + (f"-{action}" if k else ""), f"{module}/{controller}.{surface}::{action}"


def routes_of(path: str, content: str, scopes: bool = False) -> Iterator[tuple]:
    """(method, path, handler, params, line, kind) of a file, in order of pattern and place; with ``scopes``, behind the prefixes of the blocks they stand in."""
    low = path.lower()
    groups, reads = GroupPrefixes(content), handler_params(low, content)
    blocks = Blocks(content, low.endswith(".rb")) if scopes and low.endswith((".rb", ".go", ".php")) else None
    for p, pattern, local in _COMPILED:
        if not low.endswith(p.extensions) or (p.needs and p.needs not in content):
            continue
        found = local.search(content) if local else None
        base = found["path"] if found else ""
        for m in pattern.finditer(content):
            if _commented(content, m.start()):
                continue
            g = m.groupdict()
            own = g.get("path") or ""
            if p.kind == "drf_action" and re.search(r"detail\s*=\s*True", g.get("verbs") or ""):
                own = "{pk}/" + own
            where = groups.at(g.get("group") or "", m.start())
            where = base if where is None else where
            around = _scope(blocks, p.kind, m.start("path") if m.start("path") >= 0 else m.start()) if blocks else ""
            full = "/" + "/".join(x for x in (around, where.strip("/"), own.strip("/")) if x)
            handler = (g.get("handler") or "Unknown").strip(" '\"")
            verbs = [v.upper() for v in re.findall(rf"""["'](\w+)["']""", g.get("verbs") or "") if v.lower() in _VERBS.split("|")] or [(g.get("verb") or p.verb or "ANY").upper().replace("ALL", "ANY")]
            line = content.count("\n", 0, m.start()) + 1
            for verb, more, action in CRUD if p.crud else [(v, "", handler) for v in verbs]:
                whole = full + more
                yield verb, whole.rstrip("/") or "/", action, list(dict.fromkeys(_PARAMS.findall(whole) + reads.get(action.split(".")[-1], []))), line, p.kind


    if low.endswith((".ts", ".js")) and "forroutes" in content.lower():
        for verb, own, handler, at in bound_routes(content):
            whole = "/" + own.strip("/")
            yield verb, whole, handler, _PARAMS.findall(whole), content.count("\n", 0, at) + 1, "nestjs_bound"
    if low.endswith(".php"):
        for whole, handler in dispatched_routes(path, content):
            yield "ANY", whole, handler, _PARAMS.findall(whole), 1, "php_dispatch"
    script = re.fullmatch(r"api/([^/]+)\.php", low)
    if script and "class app" in content and "$app->run()" in content:  # a script that is its own entry
        yield "ANY", f"/{path}", f"{path[4:-4]}::run", [], 1, "php_script"


def extract_routes(files: DataFrame, prefixes: DataFrame | None = None, scopes: bool = False) -> DataFrame:
    """Routes of files (project, ordinal, path, content, size): project, method, path, handler, file_path, auth, params, line_start, source_kind, ordinal.

    Files over 500 KB are left out. ``prefixes`` (project, path, prefix) come before a
    file's own; with ``scopes``, those of blocks that a route stands in (Rails namespaces,
    Go and Laravel groups with a function) as well. Of equal (method, path, handler,
    file_path) the first counts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (p, c) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                for row in routes_of(p or "", c or "", scopes):
                    at.append(i)
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            keep = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("project", "ordinal", "path", "auth")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True))], names=["project", "ordinal", "file_path", "auth", "method", "route", "handler", "params", "line_start", "source_kind"])

    usable = files.filter(F.coalesce(F.col("size") <= MAX_FILE, F.lit(True))).select("project", F.col("ordinal").cast("long").alias("ordinal"), "path", "content", auth_kind("content").alias("auth"))
    kind = files.schema["project"].dataType.simpleString()
    out = usable.mapInArrow(run, f"project {kind}, ordinal long, file_path string, auth string, method string, route string, handler string, params array<string>, line_start int, source_kind string")
    if prefixes is not None:
        out = out.join(prefixes.withColumnRenamed("path", "file_path"), ["project", "file_path"], "left")
        out = out.withColumn("route", join_routes(F.coalesce("prefix", F.lit("")), "route")).drop("prefix")
    out = out.withColumn("path", join_routes(F.lit(""), "route")).drop("route")
    first = Window.partitionBy("project", "method", "path", "handler", "file_path").orderBy("ordinal", "line_start", "source_kind")
    return out.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def python_handlers(files: DataFrame) -> DataFrame:
    """Functions of Python files: project, ordinal, path, name, params, auth (of the file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, params = [], [], []
            for i, (p, c) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                for name, found in handler_params(p, c or "").items():
                    at.append(i)
                    names.append(name)
                    params.append(found)
            keep = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("project", "ordinal", "path", "auth")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(names, pa.string()), pa.array(params, pa.list_(pa.string()))], names=["project", "ordinal", "path", "auth", "name", "params"])

    py = files.filter(F.col("path").endswith(".py")).select("project", F.col("ordinal").cast("long").alias("ordinal"), "path", "content", auth_kind("content").alias("auth"))
    return py.mapInArrow(run, f"project {files.schema['project'].dataType.simpleString()}, ordinal long, path string, auth string, name string, params array<string>")


def module_names(files: DataFrame) -> DataFrame:
    """What Python files call modules: project, path, alias ('*' for whole imports), want (the module's path without ending), place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, c in enumerate(batch.column("content").to_pylist()):
                for k, m in enumerate(_PY_ANY_IMPORT.finditer(c or "")):
                    module = (m["module"] or m["plain"]).strip(".").replace(".", "/")
                    names = [(m["plain_as"] or m["plain"].split(".")[-1], module)] if m["plain"] else [("*", module)] if m["names"].strip() == "*" else []
                    for part in [] if names else m["names"].split(","):
                        name, _, alias = part.strip().partition(" as ")
                        names.append((alias.strip() or name.strip(), f"{module}/{name.strip()}".strip("/")))
                    for alias, want in names:
                        at.append(i)
                        rows.append((alias, want, k))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            keep = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("project", "path")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.int32())], names=["project", "path", "alias", "want", "place"])

    py = files.filter(F.col("path").endswith(".py")).select("project", "path", "content")
    return py.mapInArrow(run, f"project {files.schema['project'].dataType.simpleString()}, path string, alias string, want string, place int")


_PY_ANY_IMPORT = re.compile(r"^[ \t]*(?:from[ \t]+(?P<module>[\w.]+)[ \t]+import[ \t]+(?P<names>\*|[\w, \t]+)|import[ \t]+(?P<plain>[\w.]+)(?:[ \t]+as[ \t]+(?P<plain_as>\w+))?)", re.M)


def _module_files(files: DataFrame) -> DataFrame:
    """Python files under each ending of their module path: project, want, target."""
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "")
    parts = F.split(stem, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    each = files.filter(F.col("path").endswith(".py")).select("project", F.col("path").alias("target"), F.explode(ends).alias("want"))
    return each.groupBy("project", "want").agg(F.min("target").alias("target"))


def enrich_handlers(routes: DataFrame, files: DataFrame) -> DataFrame:
    """Routes of Python files whose handler another file defines get handler_file_path, its parameters, and its auth where their own is none or unknown.

    ``views.login`` is looked for in what the file calls ``views``, a bare name in modules
    imported whole, the first that defines it. Only files listed no later than the route's own count.
    """
    made = python_handlers(files)
    name = F.element_at(F.split(F.replace("handler", F.lit(".as_view"), F.lit("")), r"\."), -1)
    base = F.when(F.contains("handler", F.lit(".")), F.element_at(F.split("handler", r"\."), 1)).otherwise("*")
    asked = routes.filter(F.col("file_path").endswith(".py") & ~F.col("handler").isin("", "Unknown")).select("project", "ordinal", "file_path", "handler", name.alias("name"), base.alias("alias")).distinct()
    own = made.select("project", F.col("path").alias("file_path"), "name")
    away = asked.join(own, ["project", "file_path", "name"], "left_anti")
    aimed = away.join(module_names(files).withColumnRenamed("path", "file_path"), ["project", "file_path", "alias"]).join(_module_files(files), ["project", "want"])
    defined = made.select("project", F.col("path").alias("target"), "name", F.col("ordinal").alias("made_at"), F.col("params").alias("more"), F.col("auth").alias("their_auth"))
    met = aimed.join(defined, ["project", "target", "name"]).filter("made_at <= ordinal")
    first = met.groupBy("project", "file_path", "handler").agg(F.min(F.struct("place", "target", "more", "their_auth")).alias("_h"))
    out = routes.join(first, ["project", "file_path", "handler"], "left")
    open_ = F.lower(F.col("auth")).isin("none", "unknown", "")
    return out.select(
        *[F.col(c) for c in routes.columns if c not in ("auth", "params")], F.when(F.col("_h").isNotNull() & open_, F.col("_h.their_auth")).otherwise(F.col("auth")).alias("auth"),
        F.array_distinct(F.concat("params", F.coalesce("_h.more", F.array().cast("array<string>")))).alias("params"), F.col("_h.target").alias("handler_file_path"),
    )


_NEST_MODULE = re.compile(r"@Module\(\s*(?P<args>[\s\S]{0,2500}?)\)\s*(?:export\s+)?class\s+(?P<name>\w+)", re.I)
_NEST_TOKEN = re.compile(r"""\bpath\s*:\s*["'](?P<path>[^"']*)["']|\bmodule\s*:\s*(?P<module>\w+)|(?P<open>\{)|(?P<close>\})""")
_CLASS = re.compile(r"(?:export\s+)?class\s+([A-Za-z_]\w*)")
_GIN_RECEIVER, _GIN_CALL = re.compile(r"func\s+\((\w+)\s+\*?(\w+)\)\s+API\s*\(\s*\w+\s+\*gin\.RouterGroup\s*\)"), re.compile(r"api\.(\w+)\.API\((\w+)\)")


def all_prefixes(files: DataFrame) -> DataFrame:
    """Prefixes (project, path, prefix) by mounts and by modules, the shortest of each file."""
    both = mounted_prefixes(files).unionByName(module_prefixes(files))
    return both.groupBy("project", "path").agg(F.min(F.struct(F.length("prefix").alias("n"), "prefix"))["prefix"].alias("prefix"))


def nest_tree(text: str) -> Iterator[tuple[str, str]]:
    """(module, prefix) of a route tree: objects with path, module and children; a child's prefix begins with its parents'."""
    depth: list[list[str]] = []
    for m in _NEST_TOKEN.finditer(text):
        if m["open"]:
            depth.append(["", ""])
        elif m["close"] and depth:
            own, module = depth.pop()
            if module:
                yield module, "/".join(x.strip("/") for x in (*(d[0] for d in depth), own) if x.strip("/"))
        elif depth and m["path"] is not None:
            depth[-1][0] = m["path"]
        elif depth and m["module"]:
            depth[-1][1] = m["module"]


def module_facts(path: str, content: str) -> Iterator[tuple[str, str, str]]:
    """(kind, key, value) of a file that tells where its routes are mounted: classes it has, controllers and prefixes of NestJS modules, Gin receivers and the groups they are called with."""
    key = lambda x: re.sub(r"[^a-z0-9]+", "", x.lower())
    if path.endswith((".ts", ".tsx", ".js")):
        for name in _CLASS.findall(content):
            yield "class", name, ""
        m = _NEST_MODULE.search(content)
        if m:
            listed = re.search(r"controllers\s*:\s*\[([^\]]*)\]", m["args"])
            for name in re.findall(r"[A-Za-z_]\w*", listed[1]) if listed else []:
                yield "controller", m["name"], name
            for call in re.finditer(r"RouterModule\.register\s*\(", m["args"], re.I):
                for module, prefix in nest_tree(m["args"][call.end() :]):
                    yield "module_prefix", module, "/" + prefix
    elif path.endswith(".go"):
        for var, kind in _GIN_RECEIVER.findall(content):
            for name in dict.fromkeys((key(var), key(kind))):
                yield "receiver", name, ""
        groups = GroupPrefixes(content)
        for m in _GIN_CALL.finditer(content):
            prefix = groups.at(m[2], m.start())
            if prefix:
                yield "gin_prefix", key(m[1]), "/" + prefix.strip("/")


def module_prefixes(files: DataFrame) -> DataFrame:
    """Prefixes (project, path, prefix) of controllers of NestJS modules and of Gin receivers, the shortest of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (p, c) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                for row in module_facts(p or "", c or ""):
                    at.append(i)
                    rows.append(row)
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            keep = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("project", "path")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(list(c), pa.string()) for c in cols)], names=["project", "path", "kind", "key", "value"])

    from .graph import checkpointed

    told = files.filter(F.col("path").rlike(r"\.(?:tsx?|js|go)$")).select("project", "path", "content").mapInArrow(run, f"project {files.schema['project'].dataType.simpleString()}, path string, kind string, key string, value string")
    facts = checkpointed(told)  # five kinds are taken of them; the files are parsed once
    of = lambda kind: facts.filter(F.col("kind") == kind)
    shortest = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct(F.length("prefix").alias("n"), "prefix"))["prefix"].alias("prefix"))
    # Only a key's shortest prefix can count, so many files of one key never meet in pairs.
    given = lambda kind: shortest(of(kind).select("project", "key", F.col("value").alias("prefix")).filter(~F.col("prefix").isin("", "/")), "project", "key")
    classes = of("class").groupBy("project", F.col("key").alias("controller")).agg(F.min("path").alias("path"))
    listed = of("controller").select("project", "key", F.col("value").alias("controller")).join(given("module_prefix"), ["project", "key"])
    nest = shortest(listed, "project", "controller").join(classes, ["project", "controller"])
    gin = of("receiver").select("project", "key", "path").join(given("gin_prefix"), ["project", "key"])
    return shortest(nest.select("project", "path", "prefix").unionByName(gin.select("project", "path", "prefix")), "project", "path")


#: Tech stack: category, name, file name ('' for any manifest), what it holds.
STACK = (
    ("framework", "flask", "requirements.txt", "flask"), ("framework", "django", "requirements.txt", "django"), ("framework", "fastapi", "requirements.txt", "fastapi"), ("framework", "express", "package.json", '"express"'),
    ("framework", "nestjs", "package.json", "@nestjs/core"), ("framework", "react", "package.json", '"react"'), ("framework", "vue", "package.json", '"vue"'), ("framework", "spring", "pom.xml", "spring-boot"),
    ("framework", "gin", "go.mod", "gin-gonic/gin"), ("framework", "rails", "Gemfile", "rails"), ("framework", "laravel", "composer.json", "laravel/framework"), ("framework", "actix", "Cargo.toml", "actix-web"),
    ("database", "postgresql", "", "psycopg"), ("database", "mysql", "", "mysql"), ("database", "mongodb", "", "mongo"), ("database", "redis", "", "redis"), ("auth", "jwt", "", "jwt"), ("auth", "oauth", "", "oauth"),
)
MANIFESTS = ("requirements.txt", "pyproject.toml", "package.json", "pom.xml", "build.gradle", "go.mod", "Gemfile", "composer.json", "Cargo.toml")


def tech_stack(files: DataFrame) -> DataFrame:
    """Per project and category the names that its manifests tell; languages by extension, where there are more than three files of it."""
    name = F.element_at(F.split("path", "/"), -1)
    manifests = files.filter(name.isin(*MANIFESTS)).select("project", name.alias("name"), F.lower(text_or_empty("content")).alias("low"))
    hits = F.array_compact(F.array(*[F.when((F.col("name") == f if f else F.lit(True)) & F.col("low").contains(w), F.struct(F.lit(c).alias("category"), F.lit(n).alias("value"))) for c, n, f, w in STACK]))
    told = manifests.select("project", F.explode_outer(hits).alias("h")).filter("h IS NOT NULL").select("project", "h.category", "h.value")
    langs = files.groupBy("project", F.lower("extension").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 3) & (F.col("value") != "")).select("project", F.lit("extension").alias("category"), "value")
    return told.unionByName(langs).groupBy("project", "category").agg(F.array_sort(F.collect_set("value")).alias("values"))


#: Directory roles and the names that tell them, in order of precedence.
DIRECTORY_ROLES = {
    "controller": ("controller", "controllers", "handler", "handlers", "endpoint", "endpoints", "api", "apis"),
    "service": ("service", "services", "logic", "business", "usecase", "usecases", "interactor", "interactors"), "model": ("model", "models", "entity", "entities", "domain"),
    "middleware": ("middleware", "middlewares", "interceptor", "interceptors", "guard", "guards", "filter", "filters"), "config": ("config", "configuration", "settings", "conf"),
    "route": ("route", "routes", "router", "routers", "urls"), "auth": ("auth", "authentication", "security", "permission", "permissions"),
    "dao": ("dao", "repository", "repositories", "mapper", "mappers", "dal", "persistence"), "view": ("view", "views", "template", "templates", "page", "pages", "component", "components"),
    "util": ("util", "utils", "helper", "helpers", "common", "shared", "lib", "libs"), "test": ("test", "tests", "spec", "specs", "__tests__", "testing"), "migrate": ("migration", "migrations", "migrate", "db"),
}
#: Layouts of projects and the roles that make them.
LAYOUTS = {"mvc": ("controller", "model", "view"), "layered": ("controller", "service", "dao"), "clean": ("entity", "usecase", "interactor"), "django_mvt": ("view", "model", "template")}


def directory_roles(files: DataFrame) -> DataFrame:
    """Directories of every depth with the role of their name (null without one) and how many files are in them directly."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("directory"), (i == F.size(parts) - 1).alias("direct")))
    each = files.filter(F.contains("path", F.lit("/"))).select("project", F.explode(above).alias("d"))
    last = F.lower(F.element_at(F.split("directory", "/"), -1))
    role = F.coalesce(*[F.when(last.isin(*names), k) for k, names in DIRECTORY_ROLES.items()])
    return each.groupBy("project", "d.directory").agg(F.count_if("d.direct").alias("n_files")).withColumn("role", role)


def project_layouts(roles: DataFrame) -> DataFrame:
    """Per project the layout that its directories' roles make up most of, half at least, the first of equals; 'unknown' for none. Adds the roles found."""
    found = roles.groupBy("project").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    each = F.array(*[F.struct(F.size(F.array_intersect("roles", F.array(*map(F.lit, want)))).alias("n"), F.lit(-i).alias("order"), F.lit(len(want)).alias("of"), F.lit(name).alias("layout")) for i, (name, want) in enumerate(LAYOUTS.items())])
    best = F.array_max(F.filter(each, lambda x: (x["n"] > 0) & (2 * x["n"] >= x["of"])))
    return found.select("project", "roles", F.coalesce(best["layout"], F.lit("unknown")).alias("layout"))


_MIDDLEWARE = r"(?:app\.use|add_middleware|before_request|UseMiddleware<|\.addInterceptor|r\.Use)\s*[(<]?\s*([\w.]+)"
_DECORATOR = r"@(login_required|requires_auth|permission_required|roles_required|jwt_required|PreAuthorize|Authorize|UseGuards|csrf_exempt|admin_required)\b"


def middleware(files: DataFrame, most: int = 30) -> DataFrame:
    """Per project, registered middleware and guarding decorators with how often they occur, the most frequent first."""
    found = F.concat(
        F.transform(F.regexp_extract_all("content", F.lit(_MIDDLEWARE), F.lit(1)), lambda x: F.struct(F.lit("middleware").alias("kind"), x.alias("name"))),
        F.transform(F.regexp_extract_all("content", F.lit(_DECORATOR), F.lit(1)), lambda x: F.struct(F.lit("decorator").alias("kind"), x.alias("name"))),
    )
    few = files.filter(contains_any("content", ("app.use", "add_middleware", "before_request", "UseMiddleware", "addInterceptor", "r.Use", "@")))
    each = few.select("project", F.explode_outer(found).alias("f")).filter("f IS NOT NULL")
    return top(each.groupBy("project", "f.kind", "f.name").agg(F.count(F.lit(1)).alias("n")), ["project", "kind"], [F.desc("n"), F.col("name")], most)


_GUARDED = _DECORATOR + r"""[\s\S]{0,200}?\.(?:route|get|post|put|delete|patch)\(\s*["']([^"'\n]*)"""


def guarded_routes(files: DataFrame) -> DataFrame:
    """Guarding decorators with the path of the next route within 200 characters: project, path, decorator, route."""
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(_GUARDED), F.lit(1)).alias("decorator"), F.regexp_extract_all("content", F.lit(_GUARDED), F.lit(2)).alias("route"))
    each = files.filter(F.contains("content", F.lit("@"))).select("project", "path", F.explode_outer(pairs).alias("g")).filter("g IS NOT NULL")
    return each.select("project", "path", "g.decorator", "g.route")


#: Reasons why a file matters, by a pattern of its content.
CRITICAL = {
    "auth_logic": r"(?i)\b(?:jwt|password_hash|bcrypt|session\[|authenticate)\b", "crypto": r"(?i)\b(?:aes|rsa|hmac|md5|sha1)\b", "sql_access": r"(?i)\b(?:execute|cursor|rawquery)\s*\(", "command_execution": r"(?i)\b(?:os\.system|subprocess|exec|popen)\b",
    "file_access": r"(?i)\b(?:upload|readfile|fopen|multipart)\b", "secrets": r"(?i)(?:api_key|secret_key|private_key)", "deserialization": r"(?i)(?:pickle\.loads|yaml\.load\(|unserialize\()",
}
_ENTRIES = ("main.py", "app.py", "server.js", "index.js", "main.go", "manage.py", "index.php", "Program.cs", "main.rs")


def critical_files(files: DataFrame, hubs: DataFrame) -> DataFrame:
    """Files with reasons to look at them and a priority: one a reason, five more if one concerns auth. ``hubs``: project, dst, hub_score."""
    near = files.join(hubs.select("project", F.col("dst").alias("path"), "hub_score"), ["project", "path"], "left")
    role = file_role("path", F.lower(F.substring(text_or_empty("content"), 1, 4000)))
    reasons = F.array_compact(F.array(F.when(role.isin("auth", "middleware", "config"), F.concat(F.lit("role:"), role)), *[F.when(text_or_empty("content").rlike(p), F.lit(k)) for k, p in CRITICAL.items()], F.when(F.col("hub_score") >= 3, F.lit("hub")), F.when(F.element_at(F.split("path", "/"), -1).isin(*_ENTRIES), F.lit("entry_point"))))
    out = near.select("project", "path", reasons.alias("reasons")).filter(F.size("reasons") > 0)
    return out.withColumn("priority", F.size("reasons") + F.when(F.exists("reasons", lambda r: r.contains("auth")), 5).otherwise(0))


_PY_IMPORT, _JS_IMPORT = r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", r"""(?:from\s+|require\(\s*|import\s+)["'](\.{1,2}/[^"']+)["']"""


_PY_NAMES = re.compile(r"^\s*from\s+([\w.]+)\s+import\s+([\w, ]+?)(?:\s+as\s+(\w+))?\s*$|^\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?\s*$", re.M)
_PY_MOUNT = re.compile(r"""\.(?:register_blueprint|include_router)\(\s*([\w.]+)(?:[^)]*?(?:url_prefix|prefix)\s*=\s*["']([^"']*)["'])?""")
_DJANGO_MOUNT = re.compile(r"""\b(?:re_)?path\(\s*r?["']\^?([^"']*)["']\s*,\s*include\(\s*\(?\s*(?:["']([\w.]+)["']|([A-Za-z_][\w.]*))""")
_DJANGO_LISTS = re.compile(r"\burlpatterns\s*\+?=\s*([A-Za-z_]\w*(?:\s*\+\s*[A-Za-z_]\w*)*)")
_JS_NAMES = re.compile(r"""(?:const|let|var)\s+(\w+)\s*=\s*require\(\s*["'](\.[^"']+)["']\s*\)|import\s+(\w+)\s+from\s+["'](\.[^"']+)["']""")
_JS_MOUNT = re.compile(r"""\.use\(\s*["'`]([^"'`]*)["'`]\s*,\s*(?:[\w.()]+\s*,\s*)*(\w+)\s*\)""")


def mounts_of(path: str, content: str) -> Iterator[tuple[str, str]]:
    """(wanted file without ending, prefix) of what a file mounts: blueprints, routers, included URL lists, Express routers."""
    if path.endswith(".py"):
        names = {}
        for module, imported, alias, plain, plain_as in _PY_NAMES.findall(content):
            if plain:
                names[plain_as or plain.split(".")[-1]] = (plain, plain)
            for one in (x.strip() for x in imported.split(",") if x.strip()):
                names[alias or one] = (module, f"{module}.{one}")
        for target, prefix in _PY_MOUNT.findall(content):
            head, *rest = target.split(".")
            if head in names:
                # A name may be a module or something in one; both are looked for.
                module, full = names[head]
                for want in dict.fromkeys((full, module)) if not rest else (full,):
                    yield want.strip(".").replace(".", "/"), prefix
        for prefix, module, name in _DJANGO_MOUNT.findall(content):
            for want in (module,) if module else names.get(name, ())[::-1]:
                yield want.strip(".").replace(".", "/"), "/" + prefix.strip("^$/")
        # Lists of URLs that are added to the file's own.
        for name in {n for listed in _DJANGO_LISTS.findall(content) for n in re.findall(r"\w+", listed)}:
            for want in names.get(name, ())[::-1]:
                if want.endswith("urls"):
                    yield want.strip(".").replace(".", "/"), ""
    elif path.endswith(_JS):
        names = {a or c: b or d for a, b, c, d in _JS_NAMES.findall(content)}
        for prefix, name in _JS_MOUNT.findall(content):
            if name in names:
                at = path.split("/")[:-1]
                for x in names[name].split("/"):
                    at = at[:-1] if x == ".." else at if x == "." else [*at, x]
                yield re.sub(r"(?:/index)?(?:\.\w+)?$", "", "/".join(at)), prefix


def mount_edges(files: DataFrame) -> DataFrame:
    """Edges project, src, dst, prefix: src mounts the routes of dst. A Python module is found by the end of its path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, (p, c) in enumerate(zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)):
                for row in mounts_of(p or "", c or ""):
                    at.append(i)
                    found.append(row)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("project").take(take), batch.column("path").take(take), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["project", "src", "want", "prefix"])

    kind = files.schema["project"].dataType.simpleString()
    asked = files.filter(contains_any("content", (".register_blueprint(", ".include_router(", "include(", "urlpatterns", ".use("))).select("project", "path", "content").mapInArrow(run, f"project {kind}, src string, want string, prefix string")
    stem = F.regexp_replace(F.regexp_replace("path", r"\.\w+$", ""), "/(?:__init__|index)$", "")
    parts = F.split(stem, "/")
    ends = F.when(F.col("path").endswith(".py"), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array(stem))
    have = files.filter(F.col("path").rlike(r"\.(?:py|js|ts|mjs|cjs)$")).select("project", F.col("path").alias("dst"), F.explode(ends).alias("want"))
    found = asked.join(have, ["project", "want"]).groupBy("project", "src", "want", "prefix").agg(F.min("dst").alias("dst"))
    return found.filter("src <> dst").select("project", "src", "dst", "prefix").distinct()


def mounted_prefixes(files: DataFrame) -> DataFrame:
    """Prefixes (project, path, prefix) of files that others mount, along all mounts from files that nothing mounts."""
    from .graph import checkpointed, propagate_prefixes

    edges = checkpointed(mount_edges(files))  # each round joins them; the files are parsed once
    roots = edges.select("project", F.col("src").alias("file")).distinct().join(edges.select("project", F.col("dst").alias("file")).distinct(), ["project", "file"], "left_anti").withColumn("prefix", F.lit(""))
    return propagate_prefixes(edges, roots, join_routes).filter(~F.col("prefix").isin("", "/")).select("project", F.col("file").alias("path"), "prefix")


def import_edges(files: DataFrame) -> DataFrame:
    """Edges project, src, dst between files: Python modules by their dotted path, found at the end of a path; relative JavaScript modules by normalised path."""
    py = files.filter(F.col("path").endswith(".py"))
    names = F.array_distinct(F.concat(F.regexp_extract_all("content", F.lit(_PY_IMPORT), F.lit(1)), F.regexp_extract_all("content", F.lit(_PY_IMPORT), F.lit(2))))
    asked = py.select("project", F.col("path").alias("src"), F.explode_outer(names).alias("m")).filter("m <> ''").withColumn("want", F.replace("m", F.lit("."), F.lit("/")))
    # A module is found under each ending of its path, so the match is an equi-join.
    stem = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/__init__$", "")
    parts = F.split(stem, "/")
    have = py.select("project", F.col("path").alias("dst"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("want"))
    py_edges = asked.join(have, ["project", "want"]).groupBy("project", "src", "want").agg(F.min("dst").alias("dst")).select("project", "src", "dst")
    js = files.filter(F.col("path").rlike(r"\.(?:js|ts|jsx|tsx|mjs|cjs|vue)$"))
    up = js.select("project", F.col("path").alias("src"), F.explode_outer(F.regexp_extract_all("content", F.lit(_JS_IMPORT), F.lit(1))).alias("m")).filter("m IS NOT NULL")
    walk = F.aggregate(F.split("m", "/"), F.slice(F.split("src", "/"), F.lit(1), F.size(F.split("src", "/")) - 1), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(?:js|ts|jsx|tsx|mjs|cjs|vue)$", ""), "/index$", "")
    js_have = js.select("project", F.col("path").alias("dst"), bare(F.col("path")).alias("want"))
    js_edges = up.select("project", "src", bare(F.array_join(walk, "/")).alias("want")).join(js_have, ["project", "want"]).groupBy("project", "src", "want").agg(F.min("dst").alias("dst")).select("project", "src", "dst")
    return py_edges.unionByName(js_edges).unionByName(_java_edges(files)).unionByName(_go_edges(files)).filter("src <> dst").distinct()


_JAVA_IMPORT, _GO_IMPORTS = r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;", r'"([\w./-]+)"'


def _java_edges(files: DataFrame) -> DataFrame:
    """Imports of classes by the end of a file's path."""
    java = files.filter(F.col("path").rlike(r"\.(?:java|kt)$"))
    asked = java.select("project", F.col("path").alias("src"), F.explode_outer(F.regexp_extract_all("content", F.lit(_JAVA_IMPORT), F.lit(1))).alias("m")).filter("m <> ''").select("project", "src", F.replace("m", F.lit("."), F.lit("/")).alias("want"))
    parts = F.split(F.regexp_replace("path", r"\.\w+$", ""), "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    have = java.select("project", F.col("path").alias("dst"), F.explode(ends).alias("want"))
    return asked.join(have, ["project", "want"]).groupBy("project", "src", "want").agg(F.min("dst").alias("dst")).select("project", "src", "dst")


def _go_edges(files: DataFrame) -> DataFrame:
    """Imports of packages: every file of the directory that a package's path ends with, the module's own name taken off."""
    go = files.filter(F.col("path").endswith(".go"))
    module = files.filter(F.col("path") == "go.mod").select("project", F.regexp_extract("content", r"(?m)^module\s+(\S+)", 1).alias("module"))
    block = F.concat_ws("\n", F.regexp_extract_all("content", F.lit(r"import\s*\(([\s\S]*?)\)"), F.lit(1)), F.regexp_extract_all("content", F.lit(r'(import\s+"[^"]+")'), F.lit(1)))
    asked = go.join(module, "project", "left").select("project", F.col("path").alias("src"), F.coalesce("module", F.lit("")).alias("module"), F.explode_outer(F.regexp_extract_all(block, F.lit(_GO_IMPORTS), F.lit(1))).alias("m")).filter("m IS NOT NULL")
    inside = F.when((F.col("module") != "") & F.startswith("m", F.concat("module", F.lit("/"))), F.substring("m", F.length("module") + 2, F.length("m"))).otherwise(F.col("m"))
    directory = F.lower(F.regexp_extract("path", r"^(.*)/[^/]*$", 1))
    parts = F.split(directory, "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    dirs = go.filter(directory != "").select("project", directory.alias("directory"), F.explode(ends).alias("want")).groupBy("project", "want").agg(F.min("directory").alias("directory"))
    have = go.select("project", F.col("path").alias("dst"), directory.alias("directory"))
    return asked.select("project", "src", F.lower(inside).alias("want")).join(dirs, ["project", "want"]).join(have, ["project", "directory"]).select("project", "src", "dst")


def discovery(files: DataFrame, most_hubs: int = 40) -> dict[str, DataFrame]:
    """All that files tell before anything is audited, by name: tech_stack, directories, layouts, imports, hubs, middleware, guards, critical."""
    from .graph import in_degree_hubs

    imports, directories = import_edges(files), directory_roles(files)
    hubs = in_degree_hubs(imports, most_hubs)
    return {
        "tech_stack": tech_stack(files), "directories": directories, "layouts": project_layouts(directories), "imports": imports, "hubs": hubs,
        "middleware": middleware(files), "guards": guarded_routes(files), "critical": critical_files(files, hubs),
    }
