"""Rule tables. Operators take them as parameters; DEFAULT_RULES serve where none are given."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: Risk keywords by label.
RISK_KEYWORDS: dict[str, tuple[str, ...]] = {
    "rce": (
        "exec(", "eval(", "system(", "shell_exec", "passthru(", "popen(", "subprocess", "runtime.exec", "processbuilder", "child_process", "os.system", "pickle.loads",
        "yaml.load(", "marshal.loads", "deserialize", "unserialize", "assert(", "compile(", "proc_open", "pcntl_exec", "vm.run", "class.forname", "scriptengine",
        "objectinputstream", "readobject(", "os/exec", "exec.command", "spawn(", "ioctl(", "syscall(", "codebase", "jinja2", "freemarker", "velocity", "ognl", "spel",
    ),
    "injection": (
        "select ", "insert ", "update ", "delete ", "execute(", "executemany(", "raw(", "cursor", "query(", "$where", "mongodb", "redis", "sql", "orm", "statement",
        "preparedstatement", "jdbctemplate", "hibernate", "mybatis", "sequelize", "knex", "typeorm", "prisma", "mongoose", "db.query", "db.exec", "gorm", "sqlx",
        "ldap_search", "ldap_bind", "graphql", "mutation {", "executescript(", "rawsql", "raw_query", "text(",
    ),
    "xss": (
        "innerhtml", "outerhtml", "document.write", "dangerouslysetinnerhtml", "v-html", "render(", "template", "onclick", "onerror", "<script", "htmlspecialchars",
        "v-text", "insertadjacenthtml", "domparser", "contenteditable", "srcdoc", "javascript:", "data:", "postmessage(", "bypasssecuritytrust", "domsanitizer",
        "[innerhtml]", "strip_tags", "sanitize", "escape", "encodeuri",
    ),
    "auth": (
        "auth", "login", "logout", "session", "cookie", "jwt", "token", "oauth", "password", "captcha", "permission", "authorize", "role", "csrf", "signin", "signup",
        "authenticate", "bearer", "verify_token", "saml", "samlresponse", "kerberos", "ntlm", "recaptcha", "hcaptcha", "totp", "mfa", "2fa", "bcrypt", "argon2",
        "pbkdf2", "scrypt", "rate_limit", "throttle", "lockout", "login_attempts", "refresh_token", "access_token", "antiforgerytoken",
    ),
    "file": (
        "upload", "download", "file_get_contents", "fopen(", "readfile(", "open(", "realpath", "path", "os.path", "shutil", "zip", "tar", "../", "..\\",
        "move_uploaded_file", "attachment", "file_put_contents", "unlink(", "mkdir(", "rmdir(", "copy(", "rename(", "scandir(", "opendir(", "readdir(", "glob(",
        "basename(", "dirname(", "tempfile", "tmpfile", "symlink", "readlink", "fs.readfile", "fs.writefile", "fs.unlink", "files.delete", "files.copy",
        "multipartfile", "os.open", "os.create", "filepath.join", "extractto", "ziparchive", "phar(", "..%2f", "..%5c", "%2e%2e",
    ),
    "config": (
        ".env", "secret", "apikey", "api_key", "password", "token", "private_key", "access_key", "credentials", "config", "settings", "docker", "compose",
        "secret_key", "app_secret", "api_secret", "db_password", "database_url", "debug=true", "debug=1", "cors_origin", "allowed_hosts", "allowed_origins",
        "aws_secret", "azure_key", "gcp_key", "ssl", "tls", "certificate", "0.0.0.0", "nginx", "apache", "kubernetes", "k8s", "github_token", "slack_token",
        "stripe_key", "package.json", "requirements.txt", "pom.xml", "go.mod", ".git", ".svn", "backup.sql", "dump.sql",
    ),
    "business": (
        "order", "payment", "amount", "price", "inventory", "coupon", "balance", "workflow", "status", "business", "tenant", "owner", "refund", "withdraw",
        "deposit", "transfer", "recharge", "invoice", "billing", "receipt", "tax", "discount", "promo", "voucher", "reward", "stock", "quantity", "sku",
        "approve", "reject", "cancel", "confirm", "merchant", "seller", "buyer", "customer", "settlement", "commission", "profit", "margin", "points", "level",
        "vip", "membership", "quota", "limit", "threshold", "cap",
    ),
}
#: Keywords of further labels, for tables that have them: requests made by the server, XML entities, weak cryptography.
MORE_KEYWORDS: dict[str, tuple[str, ...]] = {
    "ssrf": ("requests.get(", "requests.post(", "urlopen(", "httpx.get", "curl_exec", "fsockopen(", "url.openconnection", "resttemplate", "axios", "fetch(", "http.newrequest", "169.254.169.254", "redirect_url"),
    "xxe": ("documentbuilderfactory", "saxparserfactory", "xmlinputfactory", "lxml.etree", "xml.etree", "xml.sax", "simplexml_load_string", "domdocument", "xmlreader", "<!entity", "<!doctype", "xinclude"),
    "crypto": ("md5(", "hashlib.md5", "sha1(", "hashlib.sha1", "3des", "rc4", "blowfish", "ecb", "math.random(", "random.random(", "verify=false", "hmac_key", "encryption_key", "b64decode"),
}
#: Stages that a label concerns; the least hits and weight of a rule hit; titles.
LABEL_STAGES = {"rce": (2,), "injection": (3,), "xss": (4,), "auth": (5, 6), "config": (7,), "file": (8,), "business": (9,), "ssrf": (2, 3), "xxe": (2, 3), "crypto": (5, 7)}
MIN_HITS = {"business": 2}
MIN_WEIGHT = {"auth": 4, "business": 4}
TITLES = {
    "rce": "危险执行/反序列化信号", "injection": "注入风险信号", "xss": "输出编码/XSS 信号", "auth": "认证鉴权信号", "config": "配置/敏感信息信号", "file": "文件操作信号", "business": "业务逻辑信号",
}
#: Paths that raise a hit of a label, and evidence without which a hit of it is worth less.
LABEL_PATHS = {
    "rce": ("exec", "command", "runtime", "serialize", "deserial", "queue", "worker"), "injection": ("sql", "query", "model", "dao", "repository", "db"),
    "xss": ("view", "template", "render", "html", "front", "admin"), "auth": ("login", "auth", "session", "oauth", "user", "token"),
    "config": ("config", "settings", ".env", "secret", "credential"), "file": ("upload", "download", "file", "path", "backup", "archive", "import", "export"),
    "business": ("order", "payment", "wallet", "coupon", "inventory", "trade"),
}
LABEL_EVIDENCE = {
    "file": (8, ("file_get_contents", "readfile(", "fopen(", "unlink(", "rename(", "copy(", "upload", "download", "realpath", "basename(", "ziparchive", "extractto")),
    "config": (10, ("secret", "api_key", "apikey", "private_key", "access_key", "credentials", ".env", "database_url", "db_password", "token=")),
}
#: Paths and endings that raise a chunk's risk.
RISK_PATHS = (
    "/router", "/routers/", "/routes/", "/api/", "/controller", "/controllers/", "/middleware", "/auth", "/security", "/admin/", "urls.py", "views.py", "config", "settings",
    ".env", "requirements", "package.json",
)
CODE_ENDINGS = (".php", ".py", ".java", ".go", ".rb", ".cs", ".js", ".ts", ".vue")


#: What a hit's path and evidence must hold. A label stands if each line of its list holds, and a line if one of its tests does:
#: (of the path or the evidence, whether it holds any, the markers) or ("hits", the least number).
_DOCUMENTS = (".json", ".md", ".txt", ".yml", ".yaml", ".xml")
_FILE_CALLS = ("file_get_contents", "readfile(", "fopen(", "unlink(", "mkdir(", "rmdir(", "copy(", "rename(", "ziparchive", "extractto", "realpath", "basename(", "scandir(", "opendir(", "readdir(", "glob(", "move_uploaded_file")
_SOURCES = ("$_get", "$_post", "$_request", "$_server", "$_cookie", "request.", "params", "query", "input", "form", "body", "json", "$request[", "$text", "$msg", "$message")
ACCEPT: dict[str, tuple[tuple[tuple, ...], ...]] = {
    "file": (
        (("ends", False, _DOCUMENTS),),
        (("evidence", True, _FILE_CALLS), ("hits", 2)),
        (("evidence", True, _FILE_CALLS), ("path", True, ("upload", "download", "file", "path", "archive", "backup", "import", "export"))),
    ),
    "business": (
        (("ends", False, _DOCUMENTS),),
        (("hits", 2),),
        (("path", True, ("order", "payment", "wallet", "coupon", "inventory", "trade", "cart")),),
    ),
    "config": (
        (("ends", False, (".sql",)),),
        (("evidence", False, ("__construct($private_key", "__construct ($private_key", "getrandomstring(")),),
        (("evidence", True, ("secret", "api_key", "apikey", "private_key", "access_key", "credentials", ".env", "database_url", "db_password", "client_secret", "appsecret")),),
        (
            ("path", True, ("config", "settings", ".env", "secret", "credential", "install", "verify", "admin/index.php")),
            ("evidence", True, ("md5(", "sha1(", "token=", "http_token", "appid=", "secret=")),
        ),
    ),
    "auth": (
        (("ends", False, (".sql",)),),
        (("path", True, ("login", "auth", "session", "oauth", "user", "token", "lock", "verify", "admin")),),
        (("evidence", True, ("login", "logout", "session_start", "session_regenerate_id", "setcookie", "jwt", "bearer", "oauth", "password_hash", "password_verify", "captcha", "signin", "signup", "validate()", "authorize", "permission", "role", "scope")),),
        (("evidence", True, ("login", "logout", "session_regenerate_id", "setcookie", "jwt", "bearer", "password_hash", "password_verify", "captcha", "signin", "signup", "validate()", "authorize", "permission", "grant_type", "authorization_code")),),
        (("evidence", True, ("login", "logout", "session_regenerate_id", "password", "captcha", "jwt", "bearer", "validate()", "authorization_code", "grant_type", "setcookie")),),
        (
            ("path", False, ("/role.php", "/user.php", "/log.php", "/index.php")),
            ("evidence", True, ("login", "logout", "validate()", "authorize", "permission", "grant_type", "authorization_code", "session_regenerate_id", "setcookie")),
        ),
        (
            ("path", False, ("/log.php", "/index.php")),
            ("evidence", True, ('header("location:?p=login', "header('location:?p=login", "validate()", "authorization_code", "grant_type", "session_regenerate_id", "setcookie", "password", "captcha")),
        ),
        (
            ("evidence", False, ("require_once 'session.php'", 'require_once "session.php"', "session_start();")),
            ("evidence", True, ("password", "jwt", "oauth", "setcookie", "session_regenerate_id", "validate()", "scope", "authorize", "permission")),
        ),
    ),
    "xss": (
        (("path", False, (".css", ".sql", ".json")),),
        (("evidence", True, ("innerhtml", "outerhtml", "document.write", "dangerouslysetinnerhtml", "v-html", "<script", "onerror=", "onclick=", 'echo"<script', "echo '<script")),),
        (("path", True, ("view", "template", "render", "html", "front", "admin", "session", "login")),),
        (("evidence", True, _SOURCES), ("evidence", True, ("$url", "$redirect", "$return", "location.href", "window.location"))),
        (("evidence", True, (*_SOURCES, "redirect=")),),
    ),
}
#: Places of translations, and the one label that counts there, whatever else its hit holds.
TRANSLATIONS, TRANSLATED = ("/lang/", "\\lang\\"), "config"


#: What brings input from outside, by kind; titles of what it may reach.
DEFAULT_SOURCES: dict[str, tuple[str, ...]] = {
    "query": (
        "request.args", "request.get(", "request.getlist(", "request.query_params", "request.query", "request.get_json", "request.form", "request.files", "request.body", "request.post", "request.data", "request.json",
        "ctx.query", "ctx.params", "querystring", "$_get", "$_post", "$_request", "input(", "formdata", "req.query", "req.params", "req.body", "c.queryparam", "c.formvalue", "c.param", "ctx.request.body", "params[",
        "request.parameter", "request.getparameter", "httpservletrequest", "req.param(", "c.request(", "request.input", "inputstream", "httpcontext",
    ),
    "db_input": (
        "username", "password", "token", "role", "user_id", "order", "price", "amount", "path", "file", "code", "captcha", "account_id", "tenant_id", "resource_id", "org_id", "customer_id", "balance", "coupon",
        "discount", "status", "url", "redirect", "email", "phone",
    ),
}
SINK_TITLES = {
    "rce": "外部输入到危险执行链", "injection": "外部输入到注入类 sink", "xss": "外部输入到输出渲染点", "auth": "外部输入到认证授权判断点", "file": "外部输入到文件操作点", "business": "外部输入到业务关键字段",
}
#: Sinks by label (title, stages, keywords), made of the risk keywords; other tables are parameters.
DEFAULT_SINKS = {k: (title, LABEL_STAGES[k], RISK_KEYWORDS[k]) for k, title in SINK_TITLES.items()}


@dataclass(frozen=True)
class Rule:
    """Keywords of a label: hits are counted (repeats count), strong ones weigh 3 and medium ones 1."""

    label: str
    hits: tuple[str, ...]
    strong: tuple[str, ...] = ()
    medium: tuple[str, ...] = ()
    min_hits: int = 1
    min_weight: int = 3
    stages: tuple[int, ...] = field(default_factory=tuple)

    @property
    def title(self) -> str:
        return TITLES.get(self.label, f"{self.label} 信号")


def _rule(label: str, words: tuple[str, ...]) -> Rule:
    """A rule made of the risk keywords: calls, members and markup are strong, bare words medium."""
    strong = tuple(w for w in words if not w.replace("_", "").strip().isalnum())
    return Rule(label, words, strong, tuple(w for w in words if w not in strong), MIN_HITS.get(label, 1), MIN_WEIGHT.get(label, 3), LABEL_STAGES.get(label, ()))


DEFAULT_RULES: tuple[Rule, ...] = tuple(_rule(k, v) for k, v in RISK_KEYWORDS.items())
#: All ten labels. Chunks get the last three only if their risk is scored with these keywords as well.
ALL_KEYWORDS = RISK_KEYWORDS | MORE_KEYWORDS
ALL_RULES: tuple[Rule, ...] = tuple(_rule(k, v) for k, v in ALL_KEYWORDS.items())


def load_rules(path: str) -> tuple[Rule, ...]:
    """Rules from a JSON file: {label: {hits, strong, medium, min_hits, min_weight, stages}}; lists are kept as they are."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return tuple(
        Rule(
            k, tuple(v["hits"]), tuple(v.get("strong", ())), tuple(v.get("medium", ())), v.get("min_hits", MIN_HITS.get(k, 1)),
            v.get("min_weight", MIN_WEIGHT.get(k, 3)), tuple(v.get("stages", LABEL_STAGES.get(k, ()))),
        )
        for k, v in found.items()
    )
