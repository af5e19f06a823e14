"""A scan as one report: a header, the inventory and its sums, records, diagnostics, findings, and what the scan did not see or do."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import semantics
from corvane.functions.classify import parser_mode
from corvane.functions.semantics import RULES
from corvane.functions.settings import Settings
from corvane.operators import evidence, joins, windows
from corvane.operators.findings import SEVERITY, rank
from corvane.operators.lineage import cut
from corvane.plans import inventory
from corvane.plans.facts import evidence_graph, facts_of
from corvane.plans.fixpoint import RECORDS, candidates, findings
from corvane.plans.frontend import records_of
from corvane.plans.incremental import FlowStore, candidates_since
from corvane.plans.registry import query, table
from corvane.plans.running import Cancellation
from corvane.plans.scanner import LANGUAGE, Text
from corvane.sources import git, tree
from corvane.sources.cache import ParseCache

SCANNER_VERSION = "2"
DIAGNOSTICS = "repository string, path string, code string, start_byte long"
# What a scan can't see or do, always or under a condition.
ALWAYS = {
    "bounded-interprocedural-analysis": "values are followed through a bounded number of calls, of steps within a function, and of passes", "dynamic-resolution-limited": "dynamic imports, aliases of several meanings, callbacks and unresolved calls are not followed",
    "semantic-resolution-bounded": "meaning comes from local syntax alone", "framework-middleware-not-modeled": "checks that only a framework's configuration makes are not seen",
    "parser-coverage-limited": "a tolerant scanner reads JavaScript, TypeScript, Python, Go and Rust; other files are inventoried alone", "framework-hints-only": "a framework named in a manifest is a hint",
    "symlinks-not-followed": "symbolic links are counted and never followed", "vcs-metadata-excluded": "folders of version control are left out",
}


def diagnostics_of(files: DataFrame) -> DataFrame:
    """invalid-utf8, syntax-error (a bracket that closes nothing) and missing-syntax (one that nothing closes) of files that the scanner reads."""
    repository = F.coalesce(F.col("repository"), F.lit("")) if "repository" in files.columns else F.lit("")
    known = files.select("path", "content", parser_mode(F.col("path")).alias("mode"), repository.alias("repository")).filter("mode IS NOT NULL AND content IS NOT NULL")
    shape = pa.schema([("repository", pa.string()), ("path", pa.string()), ("code", pa.string()), ("start_byte", pa.int64())])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, mode, where in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                try:
                    raw = content.decode("utf-8")
                except UnicodeDecodeError as error:
                    rows.append({"repository": where, "path": path, "code": "invalid-utf8", "start_byte": error.start})
                    raw = content.decode("utf-8", "replace")
                text = Text(raw, LANGUAGE[mode])
                closed = set(text.closing.values())
                for at, sign in enumerate(text.text):
                    code = "missing-syntax" if sign in "([{" and at not in text.closing else "syntax-error" if sign in ")]}" and at not in closed else None
                    if code:
                        rows.append({"repository": where, "path": path, "code": code, "start_byte": text.byte(at)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return known.mapInArrow(check, DIAGNOSTICS)


def limitations(spark: SparkSession, settings: Settings, conditions: DataFrame) -> DataFrame:
    """code, message: those that always hold, those of the settings, and those whose condition (code, message, holds) came true."""
    rows = list(ALWAYS.items())
    for name, code, message in (("include_hidden", "hidden-files-excluded", "hidden files were left out"), ("include_generated", "generated-directories-excluded", "folders of generated files were left out"), ("include_vendor", "vendor-directories-excluded", "folders of foreign code were left out")):
        if not getattr(settings, name):
            rows.append((code, message))
    if settings.max_depth is not None:
        rows.append(("depth-limit-configured", f"folders below level {settings.max_depth} were left out"))
    return spark.createDataFrame(rows, "code string, message string").unionByName(conditions.filter("holds").select("code", "message"))


def conditions_of(files: DataFrame, records: DataFrame) -> DataFrame:
    """code, message, holds: what the tables themselves say was not seen. One pass over each."""
    states = files.agg(*[F.count_if(F.col("state") == s).alias(s.replace("-", "_")) for s in ("over-limit", "over-budget", "too-large", "unreadable", "unsafe-path")])
    seen = records.agg(
        F.coalesce(F.bool_or(F.col("name") == "filesystem-operation"), F.lit(False)).alias("files"), F.coalesce(F.bool_or(F.col("name") == "process-argument-execution"), F.lit(False)).alias("arguments"),
        *[F.coalesce(F.bool_or(F.col("language") == x), F.lit(False)).alias(x) for x in ("rust", "python", "go")],
    )

    def rows(frame: DataFrame, entries: list[tuple[str, str, str]]) -> DataFrame:
        found = F.array(*[F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.expr(test).alias("holds")) for code, message, test in entries])
        return frame.select(F.explode(found).alias("c")).select("c.*")

    of_files = rows(states, [("file-limit-reached", "files after the first ones were not read", "over_limit > 0"), ("byte-budget-reached", "files after the one that passed the budget were not read", "over_budget > 0"), ("large-files-not-read", "files over the size limit were not read", "too_large > 0"), ("unreadable-files", "files could not be read", "unreadable + unsafe_path > 0")])
    of_records = rows(seen, [("filesystem-symlink-safety-not-proven", "a path below its root may still lead elsewhere at run time", "files"), ("process-argument-semantics-not-modeled", "what a fixed program makes of its arguments is not known", "arguments"), ("rust-dynamic-dispatch-limited", "trait objects and macros are not expanded", "rust"), ("python-dynamic-runtime-limited", "dynamic attributes and decorators at run time are not resolved", "python"), ("go-interface-callback-limited", "interfaces, callbacks and reflection are not resolved", "go")])
    return of_files.unionByName(of_records)


def steps_of(found: DataFrame, records: DataFrame) -> DataFrame:
    """finding_id, ordinal, rule_id, role, identity, certainty, path, start, end, previous_edge: each finding's trail and its sink, with what their records mean."""
    known = records.select("record_id", "kind", F.coalesce("name", "callee").alias("name"), "path", F.col("start_byte").alias("start"), F.col("end_byte").alias("end")).dropDuplicates(["record_id"])
    whole = found.select("finding_id", "rule_id", F.transform(F.concat("trail", F.array("sink_id")), lambda x: F.regexp_replace(x, ":return$", "")).alias("trail"))
    steps = evidence.trail_steps(whole, known).join(whole.select("finding_id", "rule_id"), "finding_id")
    role = semantics.semantic_role(F.col("kind"), F.col("name"))
    return steps.select("finding_id", "ordinal", "rule_id", role.alias("role"), semantics.semantic_identity(F.col("kind"), F.col("name")).alias("identity"), F.when(role.isNotNull(), "proven").alias("certainty"), "path", "start", "end", "previous_edge")


#: Rules with a weakness number have a taxonomy; the others have no contract.
TAXONOMY = [(rule, "1", f"CWE-{cwe}", policy or "operation-authorization") for rule, _, policy, _, cwe in RULES if cwe]


def contracts_of(steps: DataFrame) -> DataFrame:
    return evidence.contracts(evidence.contract_steps(steps), steps.sparkSession.createDataFrame(TAXONOMY, "rule_id string, version string, category string, invariant string"))


#: What a limit of the settings has cut, where it did.
REACHED = {
    "record-limit-reached": "records after the first ones were not analysed", "candidate-limit-reached": "candidates after the first ones were not kept", "finding-limit-reached": "findings after the first ones are not shown",
    "diagnostic-limit-reached": "diagnostics after the first ones are not shown", "fact-limit-reached": "facts after the first ones of a file, or of all, are not shown", "graph-limit-reached": "nodes and edges after the first ones are not shown",
    "error-limit-reached": "further errors are not shown",
}
#: States of files that are errors.
ERRORS = {"unreadable": "the file could not be read", "unsafe-path": "the path leaves the tree or is not text", "too-large": "the file is over the size limit"}


def first_rows(rows: DataFrame, order: list[str], keep: int) -> tuple[DataFrame, bool]:
    """(the first `keep` rows of a table in that order, whether there are more). Sums of slices, not a sort in one task; a table within the limit is only counted."""
    if rows.count() <= keep:
        return rows, False
    return cut(windows.running_total(rows, order, F.lit(1), "__n").filter(F.col("__n") <= keep).drop("__n")), True


def errors_of(files: DataFrame, keep: int) -> DataFrame:
    """code, path, message of files that were not read for a fault, `keep` at most; where there are more, the last row says so."""
    message = F.coalesce(*[F.when(F.col("state") == state, text) for state, text in ERRORS.items()])
    rows = files.select(F.col("state").alias("code"), "path", message.alias("message")).filter("message IS NOT NULL")
    return windows.with_limit(rows, ["path", "code"], keep, {"code": "error-limit-reached", "message": REACHED["error-limit-reached"]})


@dataclass
class Report:
    """What a scan found. Diagnostics, facts, the evidence graph, errors and limitations are made when they are first asked for, and kept."""

    header: dict
    files: DataFrame
    inventory: DataFrame
    languages: DataFrame
    coverage: DataFrame
    exclusions: dict
    records: DataFrame
    findings: DataFrame
    steps: DataFrame
    contracts: DataFrame
    suppressed: DataFrame
    settings: Settings
    reached: list[str] = field(default_factory=list)

    def _mark(self, code: str, cut_off: bool) -> None:
        if cut_off and code not in self.reached:
            self.reached.append(code)

    @cached_property
    def diagnostics(self) -> DataFrame:
        most, every = self.settings.max_parser_diagnostics, cut(diagnostics_of(self.files))
        kept, more = first_rows(every, ["path", "start_byte", "code"], most)
        self._mark("diagnostic-limit-reached", more)
        return kept

    @cached_property
    def facts(self) -> DataFrame:
        each, most, order = self.settings.max_facts_per_file, self.settings.max_total_facts, ["path", "start_byte", "kind", "fact_id"]
        every = cut(facts_of(self.files))
        _, marks = windows.bounded_facts(every, "path", order[1:], each, most)
        over = not marks.isEmpty()
        kept, more = first_rows(cut(windows.newest(every, "path", [F.col(c) for c in order[1:]], each)) if over else every, order, most)
        self._mark("fact-limit-reached", over or more)
        return kept

    @cached_property
    def graph(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of files and their facts; an edge stays if both its ends do."""
        nodes, edges = (cut(f) for f in evidence_graph(self.facts))
        kept, fewer = first_rows(nodes, ["path", "node_id"], self.settings.max_graph_nodes)
        if fewer:
            ends = kept.select("node_id")
            known = nodes.select("node_id")
            lost = known.join(ends, "node_id", "left_anti")  # ends that are no node (names outside the tree) cut nothing
            for end in ("from_node", "to_node"):
                edges = edges.join(lost.withColumnRenamed("node_id", end), end, "left_anti")
            edges = cut(edges)
        left, more = first_rows(edges, ["edge_id"], self.settings.max_graph_edges)
        self._mark("graph-limit-reached", fewer or more)
        return kept, left

    @cached_property
    def errors(self) -> DataFrame:
        found = cut(errors_of(self.files, self.settings.max_errors))
        self._mark("error-limit-reached", not found.filter("code = 'error-limit-reached'").isEmpty())
        return found

    @cached_property
    def limitations(self) -> DataFrame:
        _ = self.diagnostics, self.graph, self.errors  # what they cut is said here
        spark = self.files.sparkSession
        cuts = spark.createDataFrame([(code, REACHED[code]) for code in self.reached], "code string, message string")
        return limitations(spark, self.settings, conditions_of(self.files, self.records)).unionByName(cuts)


def scan_report(spark: SparkSession, path: str, settings: Settings | None = None, cache: str | None = None, progress: Callable[[str], None] | None = None, depth: int | None = None, cancellation: Cancellation | None = None) -> Report:
    """Reads a source tree and finds what there is to find; nothing is cut without a limitation that says so.

    Where it is cancelled, its jobs are stopped and Cancelled is raised; caches and stores are as they were before their last step.
    """
    asked = cancellation or Cancellation()

    def tell(stage: str) -> None:
        asked.check()
        if progress:
            progress(stage)

    with asked.watching(spark):
        return _scanned(spark, path, settings or Settings(), cache, tell, depth)


def _scanned(spark: SparkSession, path: str, settings: Settings, cache: str | None, tell: Callable[[str], None], depth: int | None) -> Report:
    options = {
        "exclude": "\n".join(settings.exclude), "hidden": settings.include_hidden, "vendor": settings.include_vendor, "generated": settings.include_generated,
        "max_files": settings.max_files, "max_bytes": settings.max_file_bytes, "max_total_bytes": settings.max_total_bytes,
    } | ({"max_depth": settings.max_depth} if settings.max_depth else {})
    tell("discovery")
    options = tree.as_options(options)
    found, pruned = tree.listed(spark, path, options)
    files = cut(tree.contents(found, path, options))
    listed = tree.inventory(files)
    tell("parsing")
    hits = 0
    if cache:
        store = ParseCache(spark, cache, SCANNER_VERSION, RECORDS)
        known, missing = store.split(files)
        fresh = cut(records_of(missing))
        hits = files.filter("content IS NOT NULL").count() - missing.count()
        records = cut(known.unionByName(fresh))
        store.store(missing, fresh)
        if (store.entries().agg(F.sum("bytes")).first()[0] or 0) > settings.max_cache_bytes:
            store.evict(settings.max_cache_bytes)
    else:
        records = cut(records_of(files))
    tell("analysis")
    reached, depth = [], depth or settings.max_interprocedural_depth

    def within(rows: DataFrame, order: list[str], keep: int, code: str) -> DataFrame:
        kept, more = first_rows(rows, order, keep)
        reached.extend([code] * more)
        return kept

    records = within(records, ["path", "start_byte", "record_id"], settings.max_graph_nodes, "record-limit-reached")
    walked = None
    if cache:
        traces, walked = candidates_since(records, FlowStore(spark, f"{cache.rstrip('/')}/flows"), depth, SCANNER_VERSION)
    else:
        traces = candidates(records, depth)
    found = cut(findings(traces))
    found = within(found, ["path", "sink_start", "finding_id"], evidence.candidate_budget(settings.max_findings, depth, settings.max_graph_edges), "candidate-limit-reached")
    suppressed = spark.createDataFrame([], "rule_id string, path string, start_byte long, reason string, code string")
    if settings.suppressions:
        given = spark.createDataFrame(list(settings.suppressions), "rule_id string, path string, start_byte long, reason string")
        left, suppressed = joins.apply_suppressions(found.withColumn("start_byte", F.col("sink_start")), given, ["rule_id", "path", "start_byte"], "finding_id", [r[0] for r in RULES])
        found = cut(left.drop("start_byte"))
    ranked = found.withColumn("__rank", F.when(rank(F.col("severity"), SEVERITY) == 0, 99).otherwise(rank(F.col("severity"), SEVERITY)))
    found = within(ranked, ["__rank", "finding_id"], settings.max_findings, "finding-limit-reached").drop("__rank")
    tell("report")
    counts = files.agg(F.count("*").alias("files"), F.count("content").alias("read"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes")).first()
    content = inventory.ordered_digest(files.select(F.lit("").alias("of"), F.concat_ws(":", "path", F.coalesce("sha256", F.lit("-"))).alias("k"), F.sha2(F.concat_ws(":", "path", F.coalesce("sha256", F.lit("-"))), 256).alias("sha")), "of").collect()
    digest = content[0]["digest"] if content else hashlib.sha256(b"").hexdigest()
    header = {
        "repository": files.select("repository").limit(1).collect()[0][0] if counts["files"] else "", "files": counts["files"], "read": counts["read"], "left_out": counts["files"] - counts["read"], "bytes": counts["bytes"],
        "content_digest": digest, "cache_hits": hits, "components_walked": walked, "excluded": pruned, "scan_id": "scan_" + hashlib.sha256(f"{path}\x00{digest}\x00{SCANNER_VERSION}".encode()).hexdigest()[:24],
    } | git.head(path)
    languages = listed.filter("language IS NOT NULL").groupBy("language").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    coverage = listed.filter("parser IS NOT NULL").groupBy("parser").agg(F.count("*").alias("files"), F.count_if(F.col("state") == "listed").alias("scanned"), F.sum("size_bytes").alias("bytes"))
    steps = steps_of(found, records)
    return Report(header, files, listed, languages, coverage, pruned, records, found, steps, contracts_of(steps), suppressed, settings, reached)


@query("""WITH e AS (SELECT CASE WHEN event_type = 'error' THEN 'unreadable' WHEN event_type = 'view' AND value > 10 THEN 'too-large' END AS code, 'e' || event_id AS path FROM events),
p AS (SELECT *, row_number() OVER (ORDER BY path, code) AS n, count(*) OVER () AS total FROM e WHERE code IS NOT NULL)
SELECT CASE WHEN n = 500 AND total > 500 THEN 'error-limit-reached' ELSE code END AS code, CASE WHEN n = 500 AND total > 500 THEN NULL ELSE path END AS path FROM p WHERE n <= 500""")
def scan_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Events as files that could not be read, or were too large; five hundred at most."""
    kind = F.col("event_type")
    state = F.when(kind == "error", "unreadable").when((kind == "view") & (F.col("value") > 10), "too-large").otherwise("listed")
    return errors_of(table(spark, sf, "events").select(state.alias("state"), F.concat(F.lit("e"), "event_id").alias("path")), 500).select("code", "path")


@query("""WITH o AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM o WHERE n <= (SELECT count(*) // 3 FROM orders)""")
def scan_first_records(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as records of a scan that may keep a third as many as there are orders."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return first_rows(lines, lines.columns, table(spark, sf, "orders").count() // 3)[0]


@query("""SELECT code FROM (VALUES ('bounded-interprocedural-analysis'), ('dynamic-resolution-limited'), ('semantic-resolution-bounded'), ('framework-middleware-not-modeled'), ('parser-coverage-limited'), ('framework-hints-only'), ('symlinks-not-followed'), ('vcs-metadata-excluded'), ('hidden-files-excluded'), ('vendor-directories-excluded')) v(code)
UNION ALL SELECT 'large-files-not-read' WHERE (SELECT max(strlen(html)) FROM pages) > 4000 UNION ALL SELECT 'file-limit-reached' WHERE (SELECT count(*) FROM pages) > 200
UNION ALL SELECT 'filesystem-symlink-safety-not-proven' WHERE (SELECT count(*) FROM events WHERE event_type = 'view') > 0 UNION ALL SELECT 'go-interface-callback-limited' WHERE (SELECT count(*) FROM events WHERE event_type = 'click') > 0 UNION ALL SELECT 'rust-dynamic-dispatch-limited' WHERE (SELECT count(*) FROM events WHERE event_type = 'none') > 0""")
def scan_limitations(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as files (large ones unread, those after the first 200 too), events as records."""
    pages = table(spark, sf, "pages").select("page_id", F.octet_length("html").alias("size"))
    placed = windows.running_total(pages, ["page_id"], F.lit(1), "n")
    files = placed.select(F.when(F.col("n") > 200, "over-limit").when(F.col("size") > 4000, "too-large").otherwise("listed").alias("state"))
    large = pages.select(F.when(F.col("size") > 4000, "too-large").otherwise("listed").alias("state"))
    records = table(spark, sf, "events").select(F.when(F.col("event_type") == "view", "filesystem-operation").alias("name"), F.when(F.col("event_type") == "click", "go").otherwise("javascript").alias("language"))
    return limitations(spark, Settings(include_generated=True), conditions_of(files.unionByName(large), records)).select("code")


__all__ = ["Report", "conditions_of", "diagnostics_of", "errors_of", "first_rows", "limitations", "scan_report"]
