"""Column functions on file paths, routes and endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, contains_any, text_or_empty

#: Names and directories that are no source of one's own.
NOISE_MARKERS = (
    ".min.js", ".min.css", ".map", "jquery", "sweetalert", "fontawesome", "datatables", "plupload", "bootstrap", "lodash", "underscore", "moment.min",
    "react-dom.production", "react.production", "angular.min", "vue.min", "d3.min", "chart.min", "tinymce", "ckeditor", "monaco", "codemirror", "three.min",
    "echarts.min", "antd.min", "element-ui", "iview", "ant-design", ".test.js", ".test.ts", ".spec.js", ".spec.ts", ".test.py", "_test.py", "_test.go", "_test.rb",
    "/.next/", "/.nuxt/", "/.idea/", "/.vscode/", "/.vs/", ".ds_store", "thumbs.db", "/assets/", "/open/assets/", "/cache/", "/fonts/", "/images/", "/img/", "/icons/",
    "/svg/", "/media/", "/video/", "/__tests__/", "/__mocks__/", "/__fixtures__/", "/__snapshots__/", "/test/", "/tests/", "/spec/", "/testing/", "/mock/", "/mocks/",
    "/stub/", "/stubs/", "/fixtures/", "/cypress/", "/migrations/", "/generated/", "/auto_generated/", "/proto/", "/docs/", "/examples/", "/demo/", "/sample/",
    "/playground/", "/dist/", "/build/", "/out/", "/target/", "\\assets\\", "\\open\\assets\\", "\\cache\\", "\\fonts\\", "\\images\\", "\\img\\", "\\icons\\",
    "\\svg\\", "\\media\\", "\\video\\", "\\__tests__\\", "\\__mocks__\\", "\\__fixtures__\\", "\\__snapshots__\\", "\\test\\", "\\tests\\", "\\spec\\", "\\testing\\",
    "\\mock\\", "\\mocks\\", "\\stub\\", "\\stubs\\", "\\fixtures\\", "\\cypress\\", "\\migrations\\", "\\generated\\", "\\auto_generated\\", "\\proto\\", "\\docs\\",
    "\\examples\\", "\\demo\\", "\\sample\\", "\\playground\\", "\\dist\\", "\\build\\", "\\out\\", "\\target\\",
)


def is_noise_path(path: Column | str) -> Column:
    return F.lower(text_or_empty(path)).rlike("|".join(rf"\Q{m}\E" for m in NOISE_MARKERS))


def archive_member(path: Column | str) -> Column:
    """A member's name with forward slashes, without leading ones and '.' parts; null if it climbs with '..' or is empty."""
    parts = F.filter(F.split(F.replace(text_or_empty(path), F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.array_contains(parts, "..") & (F.size(parts) > 0), F.array_join(parts, "/"))


def is_noise_member(path: Column | str) -> Column:
    """What archives hold besides files: resource forks and folder settings."""
    name = F.element_at(F.split(_col(path), "/"), -1)
    return _col(path).startswith("__MACOSX/") | name.isin(".DS_Store", "Thumbs.db")


def match_path(path: Column | str) -> Column:
    """A path for comparing: forward slashes, lower-case, without slashes at the ends."""
    return F.lower(F.regexp_replace(F.replace(F.trim(text_or_empty(path)), F.lit("\\"), F.lit("/")), r"^/+|/+$", ""))


def route_path(path: Column | str) -> Column:
    """A route without white space and doubled slashes, with a leading and no trailing slash."""
    bare = F.regexp_replace(text_or_empty(path), r"\s+", "")
    one = F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/+$", "")).otherwise(one)


def http_path(c: Column | str) -> Column:
    """A path as requests have it: without host, query and fragment, one slash between parts, a leading and no trailing one; '' for none."""
    t = F.trim(text_or_empty(c))
    bare = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?i)^https?://[^/]+", ""), r"[?#][\s\S]*$", ""))
    one = F.regexp_replace(F.concat(F.lit("/"), bare), "/{2,}", "/")
    return F.when(t == "", "").when(F.length(one) > 1, F.regexp_replace(one, "/+$", "")).otherwise(one)


def join_routes(base: Column | str, segment: Column | str) -> Column:
    b, s = F.trim(text_or_empty(base)), F.trim(text_or_empty(segment))
    return F.when(s == "", route_path(F.when(b == "", "/").otherwise(b))).when(b == "", route_path(s)).otherwise(route_path(F.concat(F.regexp_replace(b, "/+$", ""), F.lit("/"), F.regexp_replace(s, "^/+", ""))))


def _ids(path: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(path, r"/\d+(?=/|$)", "/{id}"), r"/[0-9a-f-]{8,}(?=/|$)", "/{id}")
    return F.trim(F.regexp_replace(out, "/+", "/"))


def route_match_path(path: Column | str) -> Column:
    """A route's canonical path: lower-case, without query, every parameter and id as {id}."""
    out = F.split(F.replace(F.lower(F.regexp_replace(text_or_empty(path), r"\s+", "")), F.lit("\\"), F.lit("/")), r"\?").getItem(0)
    for pattern in (r"/:[^/]+", r"/<[^/]+>", r"/\{[^/]+\}"):
        out = F.regexp_replace(out, pattern, "/{id}")
    return _ids(out)


#: A verb and a path.
ENDPOINT = r"(?i)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT|ANY|UNKNOWN)\s+(\S+)$"


def endpoint_anchor(endpoint: Column | str) -> Column:
    """METHOD path, with ids as {id}; UNKNOWN without a verb; '' for none."""
    t = F.trim(text_or_empty(endpoint))
    told = F.when(t.rlike(ENDPOINT), t).when(t != "", F.concat(F.lit("UNKNOWN\0"), t))  # a verb, what parts it and a path
    verb, path = F.regexp_extract(told, r"^(\w+)", 1), F.regexp_replace(told, r"^\w+(?:\x00|\s+)", "")
    path = _ids(F.replace(F.lower(F.trim(F.substring_index(path, "?", 1))), F.lit("\\"), F.lit("/")))
    return F.coalesce(F.trim(F.concat(F.upper(verb), F.lit(" "), path)), F.lit(""))


#: What is none of them; single characters, since ranges take a comparison each.
_NO_WORD = r"[^0123456789abcdefghijklmnopqrstuvwxyz/._\-一-鿿]+"


def keyword_text(c: Column | str) -> Column:
    """Lower-case words of letters, digits, CJK and ./_-, without URLs."""
    out = F.replace(F.lower(F.trim(text_or_empty(c))), F.lit("\\"), F.lit("/"))
    out = F.when(F.contains(out, F.lit("http")), F.regexp_replace(out, r"https?://\S+", " ")).otherwise(out)
    return F.trim(F.regexp_replace(out, _NO_WORD, " "))


def file_anchor(path: Column | str) -> Column:
    """The last four segments."""
    one = F.regexp_replace(keyword_text(path), "/{2,}", "/")
    return F.substring_index(F.btrim(one, F.lit("/")), "/", -4)


def code_anchor(c: Column | str) -> Column:
    """A short hash of code with numbers, then hex strings, masked; '' for none."""
    t = code_text(c)
    return F.when(t == "", "").otherwise(short_hash(t))


def code_text(c: Column | str) -> Column:
    """Code with numbers, then hex strings, masked."""
    return F.substring(F.regexp_replace(F.regexp_replace(keyword_text(c), r"\b\d+\b", "{n}"), r"\b[0-9a-f]{8,}\b", "{hex}"), 1, 160)


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(_col(c).cast("binary"), 256), 1, 16)


def route_id(method: Column, path: Column, handler: Column, file_path: Column, existing: Column | None = None) -> Column:
    """rt_ and 12 hex digits of what identifies a route; an id it already has stays."""
    verb = F.upper(F.trim(text_or_empty(method)))
    raw = F.concat_ws("|", F.when(verb == "", "UNKNOWN").otherwise(verb), F.regexp_replace(text_or_empty(path), r"\s+", ""), F.trim(text_or_empty(handler)), match_path(file_path))
    made = F.concat(F.lit("rt_"), F.substring(F.sha1(raw.cast("binary")), 1, 12))
    return made if existing is None else F.when(F.trim(text_or_empty(existing)) != "", F.trim(existing)).otherwise(made)


#: Roles by directory, in order of precedence, then by what the file begins with.
ROLE_DIRS = (
    ("middleware", ("middleware", "middlewares", "interceptor", "guard", "guards")), ("controller", ("controller", "controllers", "handler", "handlers", "endpoints")),
    ("service", ("service", "services", "usecase")), ("model", ("model", "models", "entity", "entities", "domain")), ("route", ("route", "routes", "router", "routers", "urls")),
    ("config", ("config", "configuration", "settings", "conf")), ("auth", ("auth", "security", "permission")), ("dao", ("dao", "repository", "mapper", "persistence")),
)


def file_role(path: Column | str, head: Column | str) -> Column:
    """The role of a file by its directories, else by its head; null if neither tells."""
    parts = F.split(F.replace(F.lower(text_or_empty(path)), F.lit("\\"), F.lit("/")), "/")
    h = text_or_empty(head)
    out = None
    for role, names in ROLE_DIRS:
        hit = F.arrays_overlap(parts, F.array(*map(F.lit, names)))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    out = out.when(contains_any(h, ("class.*middleware", "def middleware")), "middleware").when(contains_any(h, ("@controller", "@restcontroller")), "controller")
    out = out.when(h.contains("@service"), "service").when(contains_any(h, ("router.get(", "router.post(", "include_router")), "route")
    return out.when(h.contains("jwt") & contains_any(h, ("sign", "verify")), "auth")


def auth_kind(content: Column | str) -> Column:
    low = F.lower(text_or_empty(content))
    return (
        F.when(low.rlike(r"\bjwt\b|\bbearer\b"), "JWT").when(low.rlike(r"\boauth\b"), "OAuth")
        .when(low.rlike(r"\bcookie\b|\bsessionmiddleware\b|\brequest\.session\b|\bset_cookie\b"), "Session")
        .when(low.rlike(r"\bauth\b|\blogin_required\b|\bauthorize\b"), "Unknown").otherwise("None")
    )
