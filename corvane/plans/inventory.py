"""Inventory, classification, selection and scalar queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import classify, semantics, text
from corvane.operators import windows
from corvane.operators.lineage import cut
from corvane.plans.registry import query, table

#: Pages stand for repository files: each gets a path made of its number and address.
DIRECTORIES = ["src", "tests", "vendor/lib", "build/x", ".github/workflows", "docs", "Spec/unit"]
NAMES = ["main.rs", "App.py", "util_test.go", "package.json", "yarn.lock", "README.md", "settings.GRADLE", "query.sql", "x.test.ts", "Dockerfile", "a.csproj", ".env.local", "index.tsx", "notes", "page.vue", "server.js", "lib.c"]


def page_path() -> Column:
    def pick(words: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), (F.col("page_id") % len(words) + 1).cast("int"))

    return F.concat(pick(DIRECTORIES), F.lit("/"), pick(NAMES))


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


PATHS = f"(SELECT *, {_sql_list(DIRECTORIES)}[CAST(page_id % {len(DIRECTORIES)} AS INT) + 1] || '/' || {_sql_list(NAMES)}[CAST(page_id % {len(NAMES)} AS INT) + 1] AS path FROM pages)"
ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _case(value: str, groups: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {value} IN {tuple(w.split()) if len(w.split()) > 1 else chr(40) + repr(w) + chr(41)} THEN '{k}'" for k, w in groups.items()) + " END"


@query("SELECT lang, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY lang")
def inv_language_totals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n_files"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query("SELECT count(*) AS files, count(*) FILTER (strlen(text) > 8192) AS large, count(*) FILTER (text IS NULL OR text = '') AS blank, count(DISTINCT source) AS sources, count(*) FILTER (strpos(text, chr(10)) > 0) AS several_lines, CAST(max(strlen(text)) AS BIGINT) AS longest FROM documents")
def inv_counters(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf, "documents").agg(
        F.count("*").alias("files"), F.count_if(size > 8192).alias("large"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"),
        F.countDistinct("source").alias("sources"), F.count_if(F.contains("text", F.lit("\n"))).alias("several_lines"), F.max(size).cast("long").alias("longest"),
    )


@query(f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN strlen(html) > 4000 THEN 'too-large' WHEN path LIKE 'vendor/%' THEN 'vendor' WHEN path LIKE 'build/%' THEN 'generated' WHEN path LIKE '%/.%' THEN 'hidden' END AS reason FROM {PATHS}) WHERE reason IS NOT NULL GROUP BY reason")
def inv_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    path, kind = F.col("path"), classify.origin(F.col("path"))
    reason = F.when(F.octet_length("html") > 4000, "too-large").when(kind == "vendor", "vendor").when(kind == "generated", "generated").when(F.startswith(text.file_name(path), F.lit(".")), "hidden")
    return table(spark, sf, "pages").withColumn("path", page_path()).select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


_LOWER, _NAME, _EXT = ASCII.format("path"), ASCII.format("split_part(path, '/', -1)"), f"CASE WHEN contains(path, '.') THEN {ASCII.format(chr(115) + 'plit_part(path, chr(46), -1)')} END"


@query(f"""
WITH p AS (SELECT page_id, path, {_LOWER} AS low, {_NAME} AS name, {_EXT} AS ext FROM {PATHS}),
c AS (SELECT *, {_case('ext', classify.LANGUAGES)} AS language, {_case('ext', classify.PARSERS)} AS parser,
  coalesce({_case('name', classify.MANIFESTS | classify.LOCKFILES)}, CASE WHEN regexp_matches(name, '\\.(cs|fs|vb)proj$') THEN 'dotnet-project' END) AS manifest,
  name IN {tuple(' '.join(classify.LOCKFILES.values()).split())} AS locked, {_case('name', classify.ENTRY_POINTS)} AS entry_point,
  CASE WHEN len(list_intersect(string_split(low, '/'), {_sql_list(classify.VENDOR)})) > 0 THEN 'vendor' WHEN len(list_intersect(string_split(low, '/'), {_sql_list(classify.GENERATED)})) > 0 THEN 'generated' ELSE 'project' END AS origin,
  len(list_intersect(string_split(low, '/'), ['test', 'tests', 'spec', 'specs'])) > 0 OR regexp_matches(name, '\\.(test|spec)\\.|^test_|_test\\.(rs|go)$') AS test
  FROM p)
SELECT page_id, path, origin, language, parser, manifest, entry_point,
  CASE WHEN locked THEN 'lockfile' WHEN manifest IS NOT NULL THEN 'manifest' WHEN test AND language IS NOT NULL THEN 'test-source' WHEN language IS NOT NULL THEN 'source'
    WHEN name IN ('dockerfile', 'makefile', 'justfile') OR low LIKE '.github/workflows/%' OR low LIKE '.circleci/%' OR low IN ('.gitlab-ci.yml', 'azure-pipelines.yml') THEN 'build-configuration'
    WHEN coalesce(ext, '') IN {tuple(classify.DOCUMENTATION.split())} THEN 'documentation'
    WHEN name LIKE '.env.%' OR name IN ('.env', 'editorconfig') OR coalesce(ext, '') IN {tuple(classify.CONFIGURATION.split())} THEN 'configuration'
    WHEN coalesce(ext, '') IN {tuple(classify.DATA.split())} THEN 'data' ELSE 'other' END AS kind
FROM c""")
def cls_url_kind(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return table(spark, sf, "pages").select("page_id", page_path().alias("path")).select(
        "page_id", "path", classify.origin(path).alias("origin"), classify.language(path).alias("language"), classify.parser_mode(path).alias("parser"),
        classify.manifest_kind(path).alias("manifest"), classify.entry_point(path).alias("entry_point"), classify.file_kind(path).alias("kind"),
    )


@query(f"""SELECT coalesce({_case(_EXT, classify.PARSERS)}, 'none') AS parser, count(*) AS files, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes, count(*) FILTER (strlen(html) > 2000) AS large, count(*) FILTER (contains(html, 'table')) AS with_table FROM {PATHS} GROUP BY 1""")
def inv_parser_coverage(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn("parser", F.coalesce(classify.parser_mode(page_path()), F.lit("none")))
    return pages.groupBy("parser").agg(F.count("*").alias("files"), F.sum(F.octet_length("html")).cast("long").alias("n_bytes"), F.count_if(F.octet_length("html") > 2000).alias("large"), F.count_if(F.contains("html", F.lit("table"))).alias("with_table"))


@query("""SELECT doc_id, control_percent, control_percent > 10 OR has_nul AS is_binary FROM (SELECT doc_id, contains(h, '00') AND len(list_filter(b, lambda x: x = '00')) > 0 AS has_nul,
  CAST(CASE WHEN len(b) > 0 THEN len(list_filter(b, lambda x: x < '20' AND x NOT IN ('09', '0A', '0C', '0D') OR x = '7F')) * 100 // len(b) ELSE 0 END AS BIGINT) AS control_percent
FROM (SELECT doc_id, h, regexp_extract_all(h, '..') AS b FROM (SELECT doc_id, left(hex(encode(text)) || CASE WHEN doc_id % 50 = 0 THEN '00' ELSE '' END, 2 * 8192) AS h FROM documents)))""")
def cls_binary_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Every document by its first SAMPLE_BYTES; every fiftieth ends in a NUL here, which counts if it lies within them."""
    content = F.concat(F.encode("text", "UTF-8"), F.when(F.col("doc_id") % 50 == 0, F.unhex(F.lit("00"))).otherwise(F.unhex(F.lit(""))))
    docs = table(spark, sf, "documents").select("doc_id", content.alias("content"))
    return docs.select("doc_id", classify.control_percent(F.col("content")).alias("control_percent"), classify.is_binary(F.col("content")).alias("is_binary"))


NEEDLES = ["the", "class=", "&amp;", "table", "h2", "é"]


@query(f"""SELECT page_id, needle, CAST(strlen(head) AS BIGINT) AS start_byte, CAST(length(head) - length(replace(head, chr(10), '')) + 1 AS INT) AS line, CAST(length(split_part(head, chr(10), -1)) + 1 AS INT) AS col
FROM (SELECT page_id, needle, html[1:CAST(strpos(html, needle) AS BIGINT) - 1] AS head FROM pages, unnest({_sql_list(NEEDLES)}) AS n(needle) WHERE strpos(html, needle) > 0)""")
def scan_first_match(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", "html", F.explode(F.array(*[F.struct(F.lit(n).alias("needle"), F.instr("html", n).alias("at")) for n in NEEDLES])).alias("m")).filter("m.at > 0")
    at, html = F.col("m.at"), F.col("html")
    return found.select("page_id", "m.needle", F.octet_length(F.substring(html, F.lit(1), at - 1)).cast("long").alias("start_byte"), text.line_of(html, at).alias("line"), text.column_of(html, at).alias("col"))


@query(" UNION ALL ".join(f"SELECT page_id, '{k}' AS name, CAST(strlen(low[1:CAST(strpos(low, '{v}') AS BIGINT) - 1]) AS BIGINT) AS start_byte FROM (SELECT page_id, {ASCII.format('html')} AS low FROM pages) WHERE strpos(low, '{v}') > 0" for k, v in (classify.FRAMEWORKS | {"Rest": "the"}).items()))
def scan_frameworks(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "pages").select("page_id", F.explode(classify.framework_offsets(F.col("html"), classify.FRAMEWORKS | {"Rest": "the"})).alias("m"))
    return found.select("page_id", "m.name", "m.start_byte")


@query("SELECT page_id, url FROM pages ORDER BY url LIMIT 100")
def sel_topk_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "url").orderBy("url").limit(100)


@query("""SELECT doc_id, verdict FROM (SELECT doc_id, CASE WHEN strlen(text) > 20000 THEN 'too-large' WHEN sum(CASE WHEN strlen(text) <= 20000 THEN strlen(text) ELSE 0 END) OVER (ORDER BY doc_id) > 600000 THEN 'over-budget' ELSE 'admitted' END AS verdict FROM documents)""")
def sel_byte_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return windows.byte_budget(docs, ["doc_id"], "size", 20_000, 600_000).select("doc_id", "verdict")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 3 ORDER BY conv_id, turn LIMIT 200")
def sel_global_cap(spark: SparkSession, sf: str) -> DataFrame:
    return windows.capped(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"], 3, 200)


@query("SELECT doc_id FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id DESC) AS total FROM documents) WHERE total <= 500000")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    return windows.newest_within(docs, [-F.col("doc_id")], "size", 500_000).select("doc_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def hist_retention(spark: SparkSession, sf: str) -> DataFrame:
    return windows.newest(table(spark, sf, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")


@query("SELECT doc_id, text FROM (SELECT doc_id, md5(text) AS text, lag(md5(text)) OVER (PARTITION BY lang ORDER BY md5(text), doc_id) AS before FROM documents) WHERE before IS NULL OR before <> text")
def win_adjacent_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("text"))
    return windows.adjacent_distinct(docs, ["text", "doc_id"], ["text"], within="lang").select("doc_id", "text")


@query("""SELECT page_id, list_reduce(list_concat([''], list_transform(string_split(url, ''), lambda c: CASE WHEN regexp_matches(c, '^[A-Za-z0-9._~/-]$') THEN c ELSE regexp_replace(hex(encode(c)), '(..)', '%\\1', 'g') END)), lambda a, b: a || b) AS encoded FROM (SELECT page_id, url || ' é' AS url FROM pages)""")
def exp_uri_encode(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.percent_encoded(F.concat("url", F.lit(" é"))).alias("encoded"))


SEVERITIES = {"error": "critical", "purchase": "high", "click": "medium", "view": "low", "signup": "informational"}


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'note' WHEN 'signup' THEN 'note' ELSE 'none' END AS level,
CASE event_type WHEN 'error' THEN '9.5' WHEN 'purchase' THEN '8.0' WHEN 'click' THEN '5.5' WHEN 'view' THEN '3.0' ELSE '0.0' END AS score FROM events""")
def exp_severity(spark: SparkSession, sf: str) -> DataFrame:
    severity = text.mapped(F.col("event_type"), SEVERITIES, "")
    return table(spark, sf, "events").select("event_id", text.severity_level(severity).alias("level"), text.severity_score(severity).alias("score"))


@query("""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN NULL WHEN page_id % 5 = 2 THEN 'a/c/' || page_id ELSE 'x/' || page_id END AS normal FROM pages""")
def path_normalize(spark: SparkSession, sf: str) -> DataFrame:
    key, number = F.col("page_id") % 5, F.col("page_id").cast("string")
    raw = F.when(key == 0, F.concat(F.lit("a/../../"), number)).when(key == 1, F.concat(F.lit("/etc/"), number)).when(key == 2, F.concat(F.lit("a/./b/../c//"), number)).otherwise(F.concat(F.lit("./x/y/.././"), number))
    return table(spark, sf, "pages").select("page_id", text.normalize_path(raw).alias("normal"))


@query(f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words FROM documents),
k AS (SELECT doc_id, list_transform(words, lambda x, i: CASE WHEN regexp_matches(x, '{text.SECRET}') OR (i > 1 AND regexp_matches(words[i - 1], '{text.CARRIES}')) THEN '[REDACTED]' ELSE x END) AS words FROM w)
SELECT doc_id, coalesce(md5(array_to_string(words, ' ')), '') AS digest, CAST(len(list_filter(words, lambda x: x = '[REDACTED]')) AS BIGINT) AS hidden FROM k""")
def redact_words(spark: SparkSession, sf: str) -> DataFrame:
    out = table(spark, sf, "documents").select("doc_id", text.redacted(F.col("text")).alias("r"))
    return out.select("doc_id", F.md5("r.text").alias("digest"), "r.hidden")


_FOLD = "SELECT lang, (n - 1) // 1000 AS k, sha256(string_agg(sha, '' ORDER BY n)) AS sha FROM (SELECT lang, sha, row_number() OVER (PARTITION BY lang ORDER BY k) AS n FROM {of}) GROUP BY ALL"


def ordered_digest(rows: DataFrame, of: str) -> DataFrame:
    """rows (of, k, sha) -> of, digest: an ordered digest as a tree of a thousand children a node, by rank and not by value, so that no task gathers a whole table whatever the keys are.

    Each level is a thousandth of the one below; the largest group says how many there are. A group too large for a task is ranked by slices.
    """
    level = rows.select(of, "k", "sha")
    most = level.groupBy(of).count().agg(F.max("count")).first()[0] or 0
    while True:
        large = most > windows.TASK_ROWS
        ranked = windows.summed_upto(cut(level) if large else level, [of], ["k"], {"n": F.lit(1)}, large)
        parts = F.array_sort(F.collect_list(F.struct("n", "sha")))
        level = ranked.groupBy(of, F.floor((F.col("n") - 1) / 1000).alias("k")).agg(F.sha2(F.array_join(F.transform(parts, lambda r: r.sha), ""), 256).alias("sha"))
        most = -(-most // 1000)
        if most <= 1:
            return level.select(of, F.col("sha").alias("digest"))


@query(f"""WITH a AS ({_FOLD.format(of='(SELECT lang, doc_id AS k, sha256(text) AS sha FROM documents)')}), b AS ({_FOLD.format(of='a')}), n AS (SELECT count(*) AS n FROM (SELECT lang FROM a GROUP BY lang HAVING count(*) > 1))
SELECT lang, sha AS digest FROM b WHERE (SELECT n FROM n) > 0 UNION ALL SELECT lang, sha FROM a WHERE (SELECT n FROM n) = 0""")
def digest_ordered(spark: SparkSession, sf: str) -> DataFrame:
    return ordered_digest(table(spark, sf, "documents").select("lang", F.col("doc_id").alias("k"), F.sha2("text", 256).alias("sha")), "lang")


_WORDS = ["requireTenant", "is_owner", "user-role", "authorize", "loginUser", "auth", "escapeShell", "sqlQuery", "safePath", "returnUrl", "hostName", "evalCode", "plain"]


def _first(value: str, groups: dict, default: str = "NULL") -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({value}, '{w}')" for w in words) + f" THEN '{k}'" for k, words in groups.items()) + f" ELSE {default} END"


_COMPACT = f"translate({ASCII.format('name')}, '-_.:', '')"


@query(f"""SELECT event_id, name, {_first(_COMPACT, semantics.AUTHORIZATION, f"CASE WHEN {_COMPACT} = 'auth' THEN 'authentication' END")} AS authorization_kind, {_first(_COMPACT, semantics.POLICIES)} AS policy
FROM (SELECT event_id, {_sql_list(_WORDS)}[CAST(event_id % {len(_WORDS)} AS INT) + 1] AS name FROM events)""")
def sem_policies(spark: SparkSession, sf: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("event_id") % len(_WORDS) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", name.alias("name")).select("event_id", "name", semantics.authorization_kind(F.col("name")).alias("authorization_kind"), semantics.sanitizer_policy(F.col("name")).alias("policy"))
