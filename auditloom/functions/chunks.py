"""Predicates and scores of chunks, by path and content."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, contains_any, count_present, ends_with_any, text_or_empty

#: Endings and directories of static files.
STATIC_ENDINGS = (".min.js", ".min.css", ".map", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".avi", ".pdf")
STATIC_DIRS = ("/assets/", "\\assets\\", "/static/", "\\static\\", "/fonts/", "\\fonts\\", "/images/", "\\images\\", "/cache/index.html", "\\cache\\index.html")
#: What says little about a program's entries and structure.
LOW_ENDINGS = (".md", ".txt", ".css", ".scss", ".sass", ".less", ".map", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".woff", ".woff2", ".ttf")
LOW_NAMES = ("readme.md", "license", "license.md", "changelog", "changelog.md", "changes.md")
LOW_DIRS = (
    "/ckeditor/", "/codemirror/", "/tinymce/", "/ueditor/", "/styles/", "/style/", "/css/", "/fonts/", "/images/", "/img/", "/static/", "/assets/", "/public/", "/docs/", "/doc/", "/manual/",
    "/vendor/", "/dist/", "/build/",
)
#: Paths and contents of entry files.
ENTRY_PATHS = (
    "/router", "/routers/", "/routes/", "/api/", "/controller", "/controllers/", "/middleware", "/auth", "/security", "/guard", "/permission", "/policy", "urls.py", "views.py", "handlers/",
    "endpoints/", "gateway", "proxy", "webhook", "callback", "dto", "schema", "serializer", "validator", "request", "response", "route.ts", "route.js", ".module.ts", "main.py", "app.py",
    "server.js", "index.js", "manage.py",
)
ENTRY_CONTENT = (
    "include_router", "apirouter", "@router.", "@app.", "fastapi(", "router.get(", "router.post(", "router.put(", "router.delete(", "app.get(", "app.post(", "app.put(", "app.delete(",
    "router.use(", "app.use(", "urlpatterns", "re_path(", "path(", "blueprint.route(", "route::", "include(", "@controller(", "@module(", "@requestmapping(", "@getmapping(", "@postmapping(",
    "gin.", ".group(", "middleware", "jwt", "oauth", "session", "permission", "authorize", "shouldbind", "bindjson", "validator", "schema", "dto",
)
#: Paths and contents of files that say much.
SIGNAL_PATHS = (
    "main.py", "app.py", "server.js", "index.js", "manage.py", "/router", "/routers/", "/routes/", "/api/", "/controller", "/controllers/", "/middleware", "/auth", "/security", "urls.py",
    ".module.ts", "package.json", "requirements.txt", "pyproject.toml", ".env", "config",
)
SIGNAL_CONTENT = (
    "include_router", "apirouter", "@router.", "@app.", "fastapi(", "jwt", "oauth", "session", "middleware", "auth", "login", "router.get(", "router.post(", "app.get(", "app.post(",
    "urlpatterns", "include(", "@controller(", "@module(", "permission", "authorize", "cookie", "csrf",
)
#: The label that a stage looks for; endings and places of documents; how a short licence text is told; paths that a stage favours.
STAGE_LABEL = {2: "rce", 3: "injection", 4: "xss", 5: "auth", 6: "auth", 7: "config", 8: "file", 9: "business"}

DOCUMENTS, DOCUMENT_DIRS = (".md", ".txt", ".rst"), ("/document/", "/docs/")
BLURB, BLURB_CHARS = ("copyright", "license"), 1200
ROUTE_DIRS, GUARD_DIRS = ("/routes/", "/routers/", "/api/", "/controller", "/controllers/", "urls.py", "views.py"), ("/auth", "/security", "/middleware", "config", "settings", ".env")


def is_static(path: Column | str) -> Column:
    p = F.lower(text_or_empty(path))
    return (p != "") & (ends_with_any(p, STATIC_ENDINGS) | contains_any(p, STATIC_DIRS))


def is_low_value(path: Column | str, content: Column | str, must_keep: Column | None = None) -> Column:
    """Little use for a first look: documents, styles, assets, third parties, short licence texts. ``must_keep``: whether the path is kept whatever it is."""
    p = F.regexp_replace(F.lower(F.trim(text_or_empty(path))), r"#l\d+(?:-\d+)?$", "")
    name = F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1)
    low = F.lower(F.substring(text_or_empty(content), 1, 2000))
    blurb = low.contains(BLURB[0]) & low.contains(BLURB[1]) & (F.length(low) < BLURB_CHARS)
    poor = ends_with_any(name, (*LOW_ENDINGS, ".min.js", ".bundle.js")) | name.isin(*LOW_NAMES) | contains_any(p, LOW_DIRS) | blurb
    return (p == "") | (poor if must_keep is None else poor & ~F.coalesce(must_keep, F.lit(False)))


def is_entry(path: Column | str, content: Column | str) -> Column:
    return contains_any(F.lower(text_or_empty(path)), ENTRY_PATHS) | contains_any(F.lower(F.substring(text_or_empty(content), 1, 5000)), ENTRY_CONTENT)


def is_high_signal(path: Column | str, content: Column | str) -> Column:
    return contains_any(F.lower(text_or_empty(path)), SIGNAL_PATHS) | contains_any(F.lower(F.substring(text_or_empty(content), 1, 4000)), SIGNAL_CONTENT)


def is_low_signal(path: Column | str) -> Column:
    p = F.lower(F.trim(text_or_empty(path)))
    return ends_with_any(p, DOCUMENTS) | contains_any(p, DOCUMENT_DIRS) | p.startswith("document/")


def priority_boost(stage: int, in_routes: Column, in_evidence: Column) -> Column:
    """Of columns base_file_path, chunk_type, risk_score, risk_labels: what a stage gives a chunk beside its own keywords."""
    p, kind = F.lower(text_or_empty("base_file_path")), text_or_empty("chunk_type")
    labels = F.transform(F.coalesce("risk_labels", F.array().cast("array<string>")), lambda x: F.lower(x))
    one = lambda c, n: F.when(c, n).otherwise(0)
    return (
        F.coalesce("risk_score", F.lit(0)) + one(in_routes, 8) + one(in_evidence, 6) + F.when(kind.startswith("oversized_signal"), 5).when(kind.startswith("oversized_"), 2).otherwise(0)
        + one(F.array_contains(labels, STAGE_LABEL.get(stage, "")), 8) + one(contains_any(p, ROUTE_DIRS), 3)
        + one(contains_any(p, GUARD_DIRS), 2)
    )


def marker_score(content: Column | str, strong: Sequence[str], medium: Sequence[str], noise: Sequence[str], weights: tuple[int, int, int] = (4, 1, 2), chars: int = 6000) -> Column:
    """Strong and medium markers counted up and noise counted off, in the first characters."""
    low = F.lower(F.substring(text_or_empty(content), 1, chars))
    return weights[0] * count_present(low, strong) + weights[1] * count_present(low, medium) - weights[2] * count_present(low, noise)


def int_list(value: Column | str) -> Column:
    """Stage numbers 2 to 9 of a list written as JSON or with commas, distinct, in order."""
    v = F.trim(text_or_empty(value))
    parts = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.split(v, ","))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x).try_cast("int")), lambda n: n.between(2, 9)))


def text_list(value: Column | str) -> Column:
    """Items of a list written as JSON or with commas."""
    v = F.trim(text_or_empty(value))
    parts = F.when(v.startswith("["), F.from_json(v, "array<string>")).otherwise(F.split(v, ","))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""))


def is_stopping(status: Column | str) -> Column:
    return _col(status).isin("cancelled", "paused")


def is_valid(value: Column | str, allowed: Sequence[str]) -> Column:
    return F.coalesce(_col(value).isin(*allowed), F.lit(False))
