"""Queries of what names, paths, options and identifiers mean. Events pick their names from lists; pages and documents give paths and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import callees, semantics, settings, text
from corvane.plans.inventory import ASCII, PATHS, page_path
from corvane.plans.registry import query, table
from corvane.sources import reports, tree

CALLEES = [
    "child_process.exec", "exec", "db.query", "prisma.user.findMany", "Fs.ReadFile", "readFile", "cache.rename", "fs.rename", "zip.extractAll", "extract", "axios", "axios.get", "http.request", "HTTP.Get", "res.redirect", "Function",
    "eval", "userModel.create", "accountStore.update", "list.update", "revalidatePath", "JSON.parse", "render", "subprocess.run", "os.system", "cursor.execute", "open", "pathlib.Path.read_text", "requests.get", "my_client.send", "pickle.loads",
    "RedirectResponse", "exec.Command", "runner.Exec", "db.Exec", "sqlx::query", "os.ReadFile", "http.NewRequest", "client.Do", "std::process::Command::new", "Command.new.arg", "std::fs::read", "File::open", "reqwest::get", "Redirect::to", "serde_json::from_str",
    "console.log", "logger.info", "catalog.error", "llm.generate", "openai.chat.completions.create", "process.env.API_TOKEN", "process.env.PUBLIC_KEY", "Deno.env.PASSWD", "bun.env.cookieName", "os.environ", "request.args.get", "c.Query", "r.Header.Get", "request.query_params.get",
    "requireUser", "login_required", "getAuthor", "canAccess", "current_user", "assertSafe", "safe_join", "escapeHtml", "path.Strip_Prefix", "ctx.request.body", "app.render", "template.Execute", "json.Unmarshal", "gob.decode", "bincode::deserialize", "plain", "a.b.c", "",
]
LANGUAGES = ["javascript", "python", "go", "rust"]


def _pick(words: list[str], key: str = "event_id", by: int = 1) -> Column:
    place = F.floor(F.col(key) / by) % len(words) + 1
    return F.element_at(F.array(*map(F.lit, words)), place.cast("int"))


def _quoted(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_pick(words: list[str], key: str = "event_id", by: int = 1) -> str:
    return f"{_quoted(words)}[CAST({key} // {by} % {len(words)} AS INT) + 1]"


_NAMED = f"n AS (SELECT event_id, {_sql_pick(LANGUAGES, by=len(CALLEES))} AS language, {_sql_pick(CALLEES)} AS name FROM events), l AS (SELECT *, replace({ASCII.format('name')}, '::', '.') AS low FROM n)"


def _named(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", _pick(LANGUAGES, by=len(CALLEES)).alias("language"), _pick(CALLEES).alias("name"))


@query(f"WITH {_NAMED} SELECT event_id, name, language, CASE language " + " ".join(f"WHEN '{x}' THEN {callees.first_kind_sql(t, 'low')}" for x, t in callees.SINKS.items()) + f" END AS sink, {callees.first_kind_sql(callees.DISCLOSURES, 'low')} AS disclosure FROM l")
def cls_sinks(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, sf).select("event_id", "name", "language", callees.sink_kind_column(F.col("language"), name).alias("sink"), callees.first_kind_column(callees.DISCLOSURES, name).alias("disclosure"))


@query(f"WITH {_NAMED}, k AS (SELECT event_id, unnest([{', '.join(callees.first_kind_sql([row], 'low') for row in callees.OPERATIONS)}]) AS kind FROM l) SELECT event_id, kind FROM k WHERE kind IS NOT NULL")
def cls_operations(spark: SparkSession, sf: str) -> DataFrame:
    """A callee may be of several families."""
    return _named(spark, sf).select("event_id", F.explode(callees.kinds_column(callees.OPERATIONS, F.col("name"))).alias("kind"))


def _holds(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


@query(f"WITH {_NAMED} SELECT event_id, {_holds(callees.GUARDS['facts'])} AS guard_of_facts, {_holds(callees.GUARDS['javascript'])} AS guard, {_holds(callees.GUARDS['other'])} AS guard_elsewhere, {_holds(callees.SANITIZERS['javascript'])} AS sanitizer, {_holds(callees.SANITIZERS['other'])} AS sanitizer_elsewhere FROM l")
def cls_guard_names(spark: SparkSession, sf: str) -> DataFrame:
    """Three lists of guards and two of sanitizers, kept apart."""
    name = F.col("name")
    return _named(spark, sf).select("event_id", *[callees.listed_column(words, name).alias(x) for x, words in (("guard_of_facts", callees.GUARDS["facts"]), ("guard", callees.GUARDS["javascript"]), ("guard_elsewhere", callees.GUARDS["other"]), ("sanitizer", callees.SANITIZERS["javascript"]), ("sanitizer_elsewhere", callees.SANITIZERS["other"]))])


_REQUESTS = " ".join(f"WHEN '{x}' THEN {' OR '.join(callees.clause_sql(c, 'low') for c in clauses)}" for x, clauses in callees.REQUESTS.items())
_MEMBERS = "CASE " + " ".join(f"WHEN len(string_split(low, '.')) > 1 AND list_has_any(list_slice(string_split(low, '.'), 2, 99), {_quoted(words)}) THEN '{kind}'" for kind, words in callees.MEMBERS) + " END"


@query(f"WITH {_NAMED} SELECT event_id, CASE language {_REQUESTS} ELSE false END AS reads, {callees.first_kind_sql(callees.REQUEST_KINDS, 'low')} AS kind, {_MEMBERS} AS member, {callees.first_kind_sql(callees.SECRET_ENVIRONMENT, 'low')} AS environment FROM l")
def cls_sources(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("name")
    return _named(spark, sf).select("event_id", callees.reads_request_column(F.col("language"), name).alias("reads"), callees.first_kind_column(callees.REQUEST_KINDS, name).alias("kind"), callees.member_kind_column(name).alias("member"), callees.first_kind_column(callees.SECRET_ENVIRONMENT, name).alias("environment"))


IDENTITIES = ["requireTenant", "is_owner", "user-role", "authorize", "loginUser", "auth", "escapeShell", "sqlQuote", "formData.get", "http-body", "request-url", "path.join", "fs.realpath", "decodeURIComponent", "process-execution", "redirect", "none"]
KINDS = ["source", "handler", "guard", "sanitizer", "sink", "assignment", "alias", "transformation", "argument", "return", "call", "function"]
_COMPACT = f"translate({ASCII.format('name')}, '-_.:', '')"


def _first(groups: dict, default: str = "NULL", value: str = "c") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({value}, '{w}')" for w in words) + f" THEN '{k}'" for k, words in groups.items()) + f" ELSE {default} END"


_CLEANERS = {"command": "command-control-data-separation", "sql": "sql-control-data-separation", "filesystem": "filesystem-path-confinement", "redirect-destination": "redirect-destination-policy", "outbound-destination": "outbound-destination-policy", "dynamic-code": "dynamic-code-control-data-separation"}
_AUTH = _first(semantics.AUTHORIZATION, "CASE WHEN c = 'auth' THEN 'authentication' END")
_SINK = "CASE name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in semantics.SINKS.items()) + " ELSE 'sink.sensitive-operation' END"


@query(f"""WITH n AS (SELECT event_id, {_sql_pick(KINDS, by=len(IDENTITIES))} AS kind, {_sql_pick(IDENTITIES)} AS name FROM events), x AS (SELECT *, {_COMPACT} AS c FROM n), a AS (SELECT *, {_AUTH} AS who FROM x)
SELECT event_id, kind, name, CASE WHEN kind IN ('source', 'handler') THEN 'untrusted-source' WHEN kind IN ('assignment', 'alias', 'transformation', 'argument', 'return', 'call') THEN 'transformation' WHEN kind = 'guard' THEN CASE WHEN who IS NOT NULL THEN 'authorization-check' ELSE 'guard' END WHEN kind = 'sanitizer' THEN 'sanitizer' WHEN kind = 'sink' THEN 'sensitive-sink' END AS role,
CASE kind WHEN 'handler' THEN 'untrusted.handler-entry' WHEN 'source' THEN {_first(semantics.SOURCES, "'untrusted.request-value'")}
  WHEN 'guard' THEN CASE WHEN who = 'authentication' THEN 'guard.authentication' WHEN who IS NOT NULL THEN 'guard.authorization.' || who ELSE 'guard.ambiguous' END
  WHEN 'sanitizer' THEN 'sanitizer.' || {_first({k: semantics.POLICIES[p] for k, p in _CLEANERS.items()}, "'unresolved'")} WHEN 'sink' THEN {_SINK}
  WHEN 'function' THEN NULL ELSE 'transformation.' || CASE WHEN kind = 'alias' THEN 'alias' WHEN c LIKE '%join' THEN 'path-base-join' WHEN c LIKE '%resolve' OR c LIKE '%normalize' THEN 'path-lexical-normalization' WHEN c LIKE '%realpath' OR c LIKE '%canonicalize' THEN 'path-canonicalization' WHEN c LIKE '%relative' THEN 'path-relative' WHEN contains(c, 'decode') THEN 'decoding'
    WHEN kind = 'argument' THEN 'argument' WHEN kind = 'return' THEN 'return' WHEN kind = 'call' THEN 'local-call' ELSE 'value' END END AS identity FROM a""")
def sem_identity(spark: SparkSession, sf: str) -> DataFrame:
    kind, name = F.col("kind"), F.col("name")
    rows = table(spark, sf, "events").select("event_id", _pick(KINDS, by=len(IDENTITIES)).alias("kind"), _pick(IDENTITIES).alias("name"))
    return rows.select("event_id", "kind", "name", semantics.semantic_role(kind, name).alias("role"), semantics.semantic_identity(kind, name).alias("identity"))


FACTS = ["function", "method", "module-import", "http-route-handler", "server-action-handler", "environment-access", "guard-candidate", "call", "redirect", "module-export"]
RECORDS = ["function", "argument", "source", "assignment", "alias", "transformation", "call", "sanitizer", "guard", "return", "sink", "handler", "control-gate", "import"]


@query(f"""SELECT event_id, CASE f {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in semantics.NODE_OF_FACT.items())} ELSE 'syntax-fact' END AS node_of_fact, CASE r {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in semantics.NODE_OF_RECORD.items())} END AS node_of_record, CASE l {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in semantics.EDGE_OF_RELATION.items())} ELSE 'containment' END AS edge
FROM (SELECT event_id, {_sql_pick(FACTS)} AS f, {_sql_pick(RECORDS)} AS r, {_sql_pick(['imports', 'calls', 'handles', 'handler', 'other'])} AS l FROM events)""")
def sem_graph_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", semantics.node_of_fact(_pick(FACTS)).alias("node_of_fact"), semantics.node_of_record(_pick(RECORDS)).alias("node_of_record"), semantics.edge_of_relation(_pick(["imports", "calls", "handles", "handler", "other"])).alias("edge"))


# Names and paths


PAIRS = ["a.b.c", "a", "a[0].b", "b", "ab", "a.b", "req.body", "req", "", "x.y[2]"]


@query(f"""WITH n AS (SELECT event_id, {_sql_pick(PAIRS)} AS a, {_sql_pick(PAIRS, by=len(PAIRS))} AS b FROM events)
SELECT event_id, split_part(a, '.', -1) AS terminal, split_part(split_part(a, '[', 1), '.', 1) AS root, a = b OR starts_with(a, b || '.') OR starts_with(a, b || '[') OR starts_with(b, a || '.') OR starts_with(b, a || '[') AS corresponds,
CASE WHEN a = '' THEN b WHEN b = '' THEN a ELSE a || '.' || b END AS appended FROM n""")
def exp_names(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = table(spark, sf, "events").select("event_id", _pick(PAIRS).alias("a"), _pick(PAIRS, by=len(PAIRS)).alias("b"))
    return rows.select("event_id", text.terminal(a).alias("terminal"), text.root(a).alias("root"), text.corresponds(a, b).alias("corresponds"), text.appended(a, b).alias("appended"))


@query("""SELECT doc_id, CASE WHEN trim(text) <> '' AND strlen(trim(text)) <= 512 THEN md5(trim(text)) END AS bounded, CASE WHEN strlen(t) <= 512 THEN md5(t) ELSE md5(t[1:(SELECT max(i) FROM range(0, 513) r(i) WHERE strlen(t[1:i]) <= 512)]) END AS truncated, md5(left(regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g'), 256)) AS shown FROM (SELECT doc_id, text, left(text, 513) AS t FROM documents)""")
def exp_bounded_names(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(text.bounded_name(name)).alias("bounded"), F.md5(text.truncated_name(name)).alias("truncated"), F.md5(text.display_name(name)).alias("shown"))


@query("SELECT doc_id, CAST((strlen(text) // 3 * 3 + 999) // 1000 + (n_chars * 15 + 999) // 1000 AS BIGINT) AS bound FROM documents")
def exp_cost_bound(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.floor(F.octet_length("text") / 3).alias("i"), F.col("n_chars").alias("o"))
    return docs.select("doc_id", text.cost_bound(F.col("i"), F.col("o"), 3, 15).alias("bound"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def exp_rfc3339(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.rfc3339(F.col("ts")).alias("at"))


ROUTES = ["app/route.ts", "web/app/api/x/route.js", "app/(shop)/cart/[id]/route.tsx", "src/route.ts", "app/api/page.tsx", "app/route.mts", "lib/app/(a)/(b)/route.cjs", "app", "route.ts", "app/app/route.ts"]


@query(f"""WITH n AS (SELECT page_id, {_sql_pick(ROUTES, 'page_id')} AS path FROM pages), p AS (SELECT *, string_split(path, '/') AS parts FROM n)
SELECT page_id, path, CASE WHEN list_position(parts, 'app') > 0 AND regexp_matches(parts[-1], '^route\\.[cm]?[jt]sx?$') THEN '/' || array_to_string(list_filter(parts[CAST(list_position(parts, 'app') AS BIGINT) + 1:-2], lambda x: NOT starts_with(x, '(')), '/') END AS route FROM p""")
def exp_routes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", _pick(ROUTES, "page_id").alias("path")).select("page_id", "path", text.route_of(F.col("path")).alias("route"))


ORIGINS = ["https://a.example", "http://a:80", "HTTPS://[::1]:443", "https://[::1", "ftp://a", "https://a/b", "https://", "https://a:", "https://a:b", "https://a:1:2", "https://u@a", "https://a b", "http://[]", "https://:80", "a.example"]
FINE = [True, True, True, False, False, False, False, False, False, False, False, False, False, False, False]


@query(f"SELECT event_id, {_sql_pick(ORIGINS)} AS origin, {FINE}[CAST(event_id % {len(FINE)} AS INT) + 1] AS valid FROM events")
def exp_origins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", _pick(ORIGINS).alias("origin")).withColumn("valid", text.is_origin(F.col("origin")))


@query("""WITH x AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS h FROM events), y AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN h WHEN 1 THEN upper(h) WHEN 2 THEN 'scan_' || left(h, 24) ELSE 'scan_' || left(h, 23) END AS id FROM x)
SELECT event_id, event_id % 4 = 0 OR (event_id % 4 = 1 AND NOT regexp_matches(id, '[A-F]')) AS fingerprint, event_id % 4 = 2 AS scan FROM y""")
def exp_id_formats(spark: SparkSession, sf: str) -> DataFrame:
    h, way = F.sha2(F.col("event_id").cast("string"), 256), F.col("event_id") % 4
    own = F.when(way == 0, h).when(way == 1, F.upper(h)).when(way == 2, F.concat(F.lit("scan_"), F.substring(h, 1, 24))).otherwise(F.concat(F.lit("scan_"), F.substring(h, 1, 23)))
    return table(spark, sf, "events").select("event_id", text.is_fingerprint(own).alias("fingerprint"), text.is_scan_id(own).alias("scan"))


SHELLS, OPTIONS = ["sh", "bash", "zsh", "dash"], ["-c", "-ec", "-lc", "-cc", "-e", "-l", "--", "-", "-x", "-exc", "-ce", "c", "-ecx", "-ee"]
_ANSWER = {"-c": "command", "-ec": "command", "-exc": "command", "-ce": "command", "-ecx": "command", "-e": "leading", "-x": "leading", "-ee": "leading"}


@query(f"""WITH n AS (SELECT event_id, {_sql_pick(SHELLS)} AS shell, {_sql_pick(OPTIONS, by=len(SHELLS))} AS option FROM events)
SELECT event_id, shell, option, CASE WHEN option = '-lc' AND shell IN ('bash', 'zsh') THEN 'command' WHEN option = '-l' AND shell IN ('bash', 'zsh') THEN 'leading' {' '.join(f"WHEN option = '{k}' THEN '{v}'" for k, v in _ANSWER.items())} END AS means FROM n""")
def exp_shell_options(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", _pick(SHELLS).alias("shell"), _pick(OPTIONS, by=len(SHELLS)).alias("option"))
    return rows.withColumn("means", text.shell_option(F.col("shell"), F.col("option")))


@query("""WITH s AS (SELECT event_id, event_id % 3 AS f, CAST(event_id % 7 AS INT) AS sl, CAST(event_id % 5 AS INT) AS sc, CAST(event_id % 7 + event_id % 4 AS INT) AS el, CAST(event_id % 5 + event_id % 3 AS INT) AS ec, lead(event_id) OVER (ORDER BY event_id) AS other FROM events), p AS (SELECT a.*, b.f AS f2, b.sl AS sl2, b.sc AS sc2, b.el AS el2, b.ec AS ec2 FROM s a JOIN s b ON a.other = b.event_id)
SELECT event_id, f2 <> 2 AND (f = f2 OR (f = 0 AND f2 = 1) OR (f = 1 AND f2 = 0)) AND f <> 2 AND ((f = f2 AND sl = sl2 AND sc = sc2 AND el = el2 AND ec = ec2) OR ((((sl, sc) <= (sl2, sc2) AND (el, ec) >= (el2, ec2)) OR ((sl2, sc2) <= (sl, sc) AND (el2, ec2) >= (el, ec))) AND greatest(el, el2) - least(sl, sl2) + 1 <= 3)) AS equivalent FROM p""")
def exp_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's span beside the next one's; the files are one file in two spellings, and one that climbs."""
    n = F.col("event_id")
    span = F.struct(F.element_at(F.array(F.lit("a/./b.ts"), F.lit("a\\b.ts"), F.lit("a/../b.ts")), (n % 3 + 1).cast("int")).alias("file"), (n % 7).cast("int").alias("start_line"), (n % 5).cast("int").alias("start_column"), (n % 7 + n % 4).cast("int").alias("end_line"), (n % 5 + n % 3).cast("int").alias("end_column"))
    rows = table(spark, sf, "events").select("event_id", span.alias("a"))
    pairs = rows.join(rows.select((n - 1).alias("event_id"), F.col("a").alias("b")), "event_id")
    return pairs.select("event_id", text.spans_equivalent(F.col("a"), F.col("b")).alias("equivalent"))


GLOBS = ["*.md", "src/**", "vendor/*/x*", "**/unit/*", "docs/?ueries.sql", "*.[ab]"]


@query(f"""SELECT page_id, path, regexp_matches(path, '^(?:.*/)?[^/]*\\.md$') OR path LIKE 'src/%' OR regexp_matches(path, '^vendor/[^/]*/x[^/]*$') OR regexp_matches(path, '^(?:.*/)?unit/[^/]*$') OR regexp_matches(path, '^docs/[^/]ueries\\.sql$') OR regexp_matches(path, '^(?:.*/)?[^/]*\\.\\[ab\\]$') AS excluded FROM {PATHS}""")
def cls_globs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", page_path().alias("path")).withColumn("excluded", tree.matches_any(F.col("path"), GLOBS))


UNSAFE = ["a/b", "a\\b", "C:/x", "/abs", "../up", "a/../b", "a/..b", "x:y", "tab\there", "ok..txt", ""]


@query(f"""WITH n AS (SELECT event_id, {_quoted(UNSAFE).replace(chr(9), "' || chr(9) || '")}[CAST(event_id % {len(UNSAFE)} AS INT) + 1] AS path FROM events) SELECT event_id, CASE WHEN event_id % {len(UNSAFE)} IN (0, 6, 9, 10) THEN path END AS safe FROM n""")
def path_safe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", text.safe_path(_pick(UNSAFE)).alias("safe"))


_LIMITS = "CASE " + " ".join(f"WHEN name = '{k}' THEN {v}" for k, v in settings.LIMITS.items()) + " END"


@query(f"""WITH n AS (SELECT event_id, {_sql_pick(list(settings.LIMITS))} AS name, CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN event_id ELSE event_id * 100000000000 END AS value FROM events)
SELECT event_id, name, CASE WHEN value < 1 THEN 'must be greater than zero' WHEN value > {_LIMITS} THEN 'cannot exceed ' || {_LIMITS} END AS problem FROM n""")
def cfg_problems(spark: SparkSession, sf: str) -> DataFrame:
    own = F.col("event_id")
    value = F.when(own % 4 == 0, 0).when(own % 4 == 1, 1).when(own % 4 == 2, own).otherwise(own * 100_000_000_000)
    return table(spark, sf, "events").select("event_id", _pick(list(settings.LIMITS)).alias("name"), value.alias("value")).select("event_id", "name", settings.problem(F.col("name"), F.col("value")).alias("problem"))


@query("""WITH f AS (SELECT 'd' || doc_id AS path, sha256(text) AS h, doc_id FROM documents), c AS (SELECT sha256('2' || chr(0) || path || chr(0) || CASE WHEN doc_id % 9 = 0 THEN sha256('other') ELSE h END) AS k FROM f WHERE doc_id % 3 = 0)
SELECT path FROM f WHERE sha256('2' || chr(0) || path || chr(0) || h) NOT IN (SELECT k FROM c)""")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files: every third is in the cache, of these every third with what it held before."""
    files = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    before = files.filter("doc_id % 3 = 0").withColumn("sha256", F.when(F.col("doc_id") % 9 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    return tree.cache_misses(files, before.select(tree.cache_key("2").alias("cache_key")), "2").select("path")


@query("""SELECT doc_id, md5(array_to_string(l[greatest(n - 2, 1):least(n + 2, len(l))], chr(10))) AS shown FROM (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 7 + 1 AS n FROM documents)""")
def src_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines on either side of one of the first seven."""
    shown = reports.preview(F.col("text"), (F.col("doc_id") % 7 + 1).cast("int"), 2)
    return table(spark, sf, "documents").select("doc_id", F.md5(F.array_join(shown, "\n")).alias("shown"))
