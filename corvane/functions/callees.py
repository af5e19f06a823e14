"""What a callee's or a value's name says: one table of clauses, read as Python, as a column and as SQL.

A clause holds when each of its parts holds for the lower-cased name (`::` written as `.`): leaf (its last part is one of), whole (it is
one of), prefix (it begins with one of), holds (it contains one of), alone (it has no dot). A kind's clauses are alternatives; of several
kinds the first decides, unless a table is read as "all that hold".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import ascii_lower

# Names that make a call a sink, an operation, a source, a guard or a sanitizer, by language.
_JS_PROCESS = ["exec", "execsync", "execfile", "execfilesync", "spawn", "spawnsync", "fork"]
_JS_FILES = ["readfile", "readfilesync", "writefile", "writefilesync", "appendfile", "unlink", "rm", "rename", "mkdir", "readdir", "createreadstream", "createwritestream"]
_JS_NETWORK = ["axios", "http.get", "http.request", "https.get", "https.request"]
MUTATIONS = ["create", "insert", "update", "upsert", "delete", "remove", "destroy", "save", "publish", "archive", "erase", "revoke", "mutate"]
STORES = ["db", "database", "prisma", "repository", "repo", "store", "model", "service", "vault", "resource", "record"]
SINKS = {
    "javascript": [
        ("process-execution", [{"leaf": _JS_PROCESS}, {"prefix": ["child_process."]}]),
        ("database-access", [{"leaf": ["query", "execute", "raw", "$queryraw", "$executeraw"]}]),
        ("filesystem-operation", [{"leaf": _JS_FILES, "prefix": ["fs."]}, {"leaf": _JS_FILES, "alone": True}, {"leaf": ["extract", "extractall", "unpack", "unpackin"], "holds": ["archive", "tar", "zip"]}]),
        ("network-request", [{"leaf": ["fetch"]}, {"prefix": ["axios."]}, {"whole": _JS_NETWORK}]),
        ("redirect", [{"leaf": ["redirect"]}]),
        ("dynamic-code-execution", [{"leaf": ["function"]}, {"whole": ["eval"]}]),
        ("sensitive-mutation", [{"leaf": ["revalidatepath", "revalidatetag"]}, {"leaf": MUTATIONS, "holds": STORES}]),
    ],
    "python": [
        ("process-execution", [{"prefix": ["subprocess."]}, {"whole": ["os.system", "os.popen"]}]),
        ("database-access", [{"leaf": ["execute", "executemany", "raw"]}]),
        ("filesystem-operation", [{"leaf": ["open", "unlink", "remove", "rename", "mkdir", "rmdir", "read_text", "write_text", "read_bytes", "write_bytes"]}]),
        ("network-request", [{"prefix": ["requests.", "httpx."]}, {"leaf": ["get", "post", "request", "send"], "holds": ["client."]}]),
        ("redirect", [{"leaf_holds": ["redirect"]}]),
        ("dynamic-code-execution", [{"leaf": ["eval", "exec", "__import__", "import_module"]}, {"whole": ["pickle.loads", "pickle.load"]}]),
    ],
    "go": [
        ("process-execution", [{"holds": ["exec.command", "os.exec"]}]),
        ("database-access", [{"leaf": ["query", "querycontext", "exec", "execcontext"], "prefix": ["db."]}, {"leaf": ["query", "querycontext", "exec", "execcontext"], "holds": ["sql"]}]),
        ("filesystem-operation", [{"leaf": ["open", "openfile", "readfile", "writefile", "remove", "removeall", "rename", "mkdir", "mkdirall"], "prefix": ["os."]}]),
        ("network-request", [{"leaf": ["get", "post", "newrequest"], "prefix": ["http."]}, {"leaf": ["do"], "holds": ["client."]}]),
        ("redirect", [{"leaf": ["redirect"]}]),
    ],
    "rust": [
        ("process-execution", [{"leaf": ["arg", "args", "spawn", "status", "output"], "holds": ["command"]}, {"holds": ["std.process.command"]}]),
        ("filesystem-operation", [{"prefix": ["std.fs."]}, {"holds": ["tokio.fs."]}, {"leaf": ["open", "create", "options"], "prefix": ["file."]}]),
        ("database-access", [{"holds": ["sqlx.query", "query_as"]}]),
        ("network-request", [{"leaf": ["get", "post", "request", "send"], "holds": ["reqwest", "client."]}]),
        ("redirect", [{"leaf": ["redirect"]}, {"holds": ["redirect."]}]),
    ],
}
#: API families of JavaScript callees as facts name them; one callee may be of several.
OPERATIONS = [
    ("process-execution", [{"leaf": _JS_PROCESS}, {"prefix": ["child_process."]}]),
    ("database-access", [{"leaf": ["query", "execute", "raw", "$queryraw", "$executeraw", "findmany", "findunique"]}, {"prefix": ["prisma."]}]),
    ("filesystem-operation", [{"leaf": _JS_FILES, "prefix": ["fs."]}, {"leaf": _JS_FILES, "alone": True}]),
    ("network-request", [{"leaf": ["fetch"]}, {"prefix": ["axios."]}, {"whole": _JS_NETWORK}]),
    ("redirect", [{"leaf": ["redirect"]}]),
    ("template-render", [{"leaf": ["render", "renderfile", "rendertostring"]}]),
    ("deserialization", [{"whole": ["json.parse", "yaml.load", "yaml.parsesafe"]}, {"leaf": ["deserialize", "deserializeunchecked"]}]),
]
#: Those of the other languages beyond their sinks.
MORE_OPERATIONS = {
    "rust": [("deserialization", [{"leaf": ["from_str", "from_slice", "deserialize"], "holds": ["serde", "bincode"]}])],
    "python": [("deserialization", [{"prefix": ["pickle."]}]), ("template-render", [{"leaf": ["render", "render_template", "render_template_string"]}])],
    "go": [("template-render", [{"holds": ["template."]}]), ("deserialization", [{"leaf": ["decode", "unmarshal"], "holds": ["json.", "gob."]}])],
}
DISCLOSURES = [
    ("sensitive-data-disclosure", [
        {"prefix": ["console."]}, {"leaf": ["log", "info", "warn", "error", "debug", "trace"], "holds": ["logger", "logging", "log"]},
        {"leaf": ["create", "generate", "complete", "completion", "invoke", "send"], "holds": ["openai", "anthropic", "llm", "model", "completion", "chat"]},
    ]),
]
SECRET_ENVIRONMENT = [("sensitive-configuration", [{"prefix": ["process.env.", "deno.env.", "bun.env."], "holds": ["token", "secret", "password", "passwd", "api_key", "apikey", "private_key", "credential", "cookie"]}])]
#: Member accesses and calls that read a request, in the languages without a type of request that a name gives away.
REQUESTS = {
    "python": [{"holds": ["request."], "and": ["get", "json", "data", "form", "args", "headers", "cookies"]}, {"prefix": ["request."], "and": ["args", "form", "json", "data", "headers", "cookies", "path", "values"]}],
    "go": [{"prefix": ["c.", "ctx.", "context.", "r.", "req.", "request."], "and": [".param", ".query", ".formvalue", ".bind", ".decode", ".header.get", ".cookie", ".url"]}],
    "rust": [{"prefix": ["req.", "request."], "and": ["query", "path", "json", "form", "headers", "cookie"]}, {"holds": ["extract"], "and": ["query", "path", "json", "form", "headers", "cookie"]}],
}
REQUEST_KINDS = [("request-header", [{"holds": ["header"]}]), ("request-cookie", [{"holds": ["cookie"]}]), ("request-body", [{"holds": ["body", "form", "json"]}]), ("request-url", [{"holds": ["url", "query"]}])]
#: Parts of a member access on a request parameter in JavaScript, the first that stands in it.
MEMBERS = [("http-header", ["headers", "header"]), ("http-cookie", ["cookies", "cookie"]), ("http-body", ["body"]), ("http-query", ["query", "params", "searchparams", "url"])]
GUARDS = {
    "facts": ["auth", "authoriz", "permission", "role", "session", "user", "tenant", "owner", "policy", "guard"],
    "javascript": ["auth", "authoriz", "permission", "requireuser", "session", "role", "policy", "guard", "owner", "tenant", "member", "canaccess", "enforce"],
    "other": ["auth", "login_required", "permission", "requireuser", "session", "role", "policy", "guard", "current_user"],
}
SANITIZERS = {
    "javascript": ["sanitize", "escape", "validate", "assertsafe", "allowlist", "normalizesafepath", "safeurl", "saferedirect", "parameterize"],
    "other": ["sanitize", "escape", "validate", "allowlist", "safe_join", "canonicalize", "is_relative_to", "strip_prefix", "parameterize"],
}
#: HTTP methods: of facts, of records, of the other languages. They differ.
METHODS = {
    "facts": ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "USE", "ALL"],
    "javascript": ["GET", "POST", "PUT", "PATCH", "DELETE", "OPTIONS", "HEAD", "ALL"],
    "other": ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS", "ANY"],
}


def plain(name: str | None) -> str:
    return (name or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("::", ".")


_PLAIN = {
    "leaf": lambda v, name: name.rpartition(".")[2] in v, "whole": lambda v, name: name in v, "prefix": lambda v, name: name.startswith(tuple(v)),
    "holds": lambda v, name: any(w in name for w in v), "and": lambda v, name: any(w in name for w in v), "alone": lambda v, name: "." not in name,
    "leaf_holds": lambda v, name: any(w in name.rpartition(".")[2] for w in v),
}


def clause_holds(clause: dict, name: str) -> bool:
    return all(_PLAIN[part](value, name) for part, value in clause.items())


def kinds_of(table: list, name: str | None) -> list[str]:
    low = plain(name)
    return [kind for kind, clauses in table if any(clause_holds(c, low) for c in clauses)]


def first_kind(table: list, name: str | None) -> str | None:
    return next(iter(kinds_of(table, name)), None)


def operation_kinds(language: str, name: str | None) -> list[str]:
    """The API families of a callee as facts name them."""
    if language == "javascript":
        return kinds_of(OPERATIONS, name)
    if language == "python" and plain(name) in ("pickle.load", "pickle.loads"):
        return ["deserialization"]
    found = first_kind(SINKS[language], name) or first_kind(MORE_OPERATIONS[language], name)
    return [found] if found else []


def named_guard(which: str, name: str | None) -> bool:
    return any(w in plain(name) for w in GUARDS[which])


def named_sanitizer(which: str, name: str | None) -> bool:
    return any(w in plain(name) for w in SANITIZERS[which])


def reads_request(language: str, name: str | None) -> bool:
    return any(clause_holds(c, plain(name)) for c in REQUESTS.get(language, []))


def _any(parts: list[Column]) -> Column:
    return reduce(Column.__or__, parts)


def _clause_column(clause: dict, name: Column) -> Column:
    leaf = F.split_part(name, F.lit("."), F.lit(-1))
    parts = {
        "leaf": lambda v: leaf.isin(*v), "whole": lambda v: name.isin(*v), "prefix": lambda v: _any([F.startswith(name, F.lit(w)) for w in v]),
        "holds": lambda v: _any([F.contains(name, F.lit(w)) for w in v]), "and": lambda v: _any([F.contains(name, F.lit(w)) for w in v]),
        "alone": lambda v: ~F.contains(name, F.lit(".")), "leaf_holds": lambda v: _any([F.contains(leaf, F.lit(w)) for w in v]),
    }
    return reduce(Column.__and__, [parts[k](v) for k, v in clause.items()])


def plain_column(name: Column) -> Column:
    return F.replace(ascii_lower(name), F.lit("::"), F.lit("."))


def first_kind_column(table: list, name: Column) -> Column:
    """Null where no clause holds."""
    low = plain_column(name)
    return F.coalesce(*[F.when(_any([_clause_column(c, low) for c in clauses]), kind) for kind, clauses in table])


def kinds_column(table: list, name: Column) -> Column:
    """All kinds whose clauses hold, in the table's order."""
    low = plain_column(name)
    return F.array_compact(F.array(*[F.when(_any([_clause_column(c, low) for c in clauses]), kind) for kind, clauses in table]))


def sink_kind_column(language: Column, name: Column) -> Column:
    return F.coalesce(*[F.when(language == x, first_kind_column(table, name)) for x, table in SINKS.items()])


def listed_column(words: list[str], name: Column) -> Column:
    """Whether the lower-cased name contains one of the words."""
    return F.coalesce(_any([F.contains(plain_column(name), F.lit(w)) for w in words]), F.lit(False))


def reads_request_column(language: Column, name: Column) -> Column:
    low = plain_column(name)
    return F.coalesce(*[F.when(language == x, _any([_clause_column(c, low) for c in clauses])) for x, clauses in REQUESTS.items()], F.lit(False))


def member_kind(name: str) -> str | None:
    parts = plain(name).split(".")[1:]
    return next((kind for kind, words in MEMBERS if any(w in parts for w in words)), None)


def member_kind_column(name: Column) -> Column:
    """What a member access on a request reads, by its parts behind the root."""
    parts = F.split(plain_column(name), r"\.")
    behind = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.coalesce(*[F.when((F.size(parts) > 1) & F.arrays_overlap(behind, F.array(*map(F.lit, words))), kind) for kind, words in MEMBERS])


def clause_sql(clause: dict, name: str) -> str:
    """The same in SQL, for a lower-cased name."""
    leaf = f"split_part({name}, '.', -1)"

    def among(words: list[str], of: str) -> str:
        return f"{of} IN ({', '.join(repr(w) for w in words)})"

    def some(words: list[str], of: str, function: str) -> str:
        return "(" + " OR ".join(f"{function}({of}, {w!r})" for w in words) + ")"

    parts = {
        "leaf": lambda v: among(v, leaf), "whole": lambda v: among(v, name), "prefix": lambda v: some(v, name, "starts_with"), "holds": lambda v: some(v, name, "contains"),
        "and": lambda v: some(v, name, "contains"), "alone": lambda v: f"NOT contains({name}, '.')", "leaf_holds": lambda v: some(v, leaf, "contains"),
    }
    return "(" + " AND ".join(parts[k](v) for k, v in clause.items()) + ")"


def first_kind_sql(table: list, name: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(clause_sql(c, name) for c in clauses)} THEN '{kind}'" for kind, clauses in table) + " END"
