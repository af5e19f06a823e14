"""Reports: findings as JSON and as SARIF, written whole or marked as cut; baselines; versioned documents; contract verdicts; previews of source.

Documents are written by tasks from an ordered table, a row a line, and joined under a passing name that is then moved, or left as parts.
"""

from __future__ import annotations

import json
import os
import re
import stat
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.semantics import RULES
from corvane.functions.text import FINGERPRINT, percent_encoded, severity_level, severity_score, spans_equivalent
from corvane.operators.lineage import shared_folder
from corvane.sources import documents

SARIF_VERSION = "2.1.0"
NAME = "corvane"
SCHEMA_VERSION = 1
#: The largest document that is read back as one value, the longest line before a report's rows, and what a preview may show.
MAX_DOCUMENT, MAX_LEAD, MAX_PREVIEW, MAX_CONTEXT = 64 << 20, 1 << 20, 1 << 20, 200
#: How the first line of a report ends.
LEAD_END = ', "findings": ['
FINDING = "repository string, finding_id string, rule_id string, severity string, cwe int, path string, function string, sink_start long, source_path string, source_start long, trail array<string>, sanitizers array<string>, fingerprint string, related_key string, sink_id string"


def write_atomically(path: str, text: str) -> None:
    folder = os.path.dirname(os.path.abspath(path))
    handle, passing = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            file.write(text)
            file.flush()
            os.fsync(file.fileno())
        os.replace(passing, path)
    except BaseException:
        os.unlink(passing)
        raise


def _place(path: Column, at: Column) -> Column:
    return F.struct(F.struct(F.struct(percent_encoded(path).alias("uri")).alias("artifactLocation"), F.struct(at.alias("byteOffset")).alias("region")).alias("physicalLocation"))


def sarif_results(findings: DataFrame, assessments: DataFrame | None = None) -> DataFrame:
    """finding_id, result: each finding as one result in JSON, its whole trail as the flow. Stays a table; only a document gathers it.

    assessments (finding_id, fingerprint, verdict): those that belong to a finding stand among its properties.
    """
    # A step's record says where it is: `path:byte:kind...`.
    step = r"^(.*):(\d+):[a-z-]+(?::.*)?$"
    known = F.filter("trail", lambda x: x.rlike(step))
    flow = F.struct(F.array(F.struct(F.transform(known, lambda x: F.struct(_place(F.regexp_extract(x, step, 1), F.regexp_extract(x, step, 2).cast("long")).alias("location"))).alias("locations"))).alias("threadFlows"))
    rows = findings
    verdict = F.lit(None).cast("string")
    if assessments is not None:
        from corvane.operators.findings import attach_assessments

        rows = attach_assessments(findings, assessments)
        verdict = F.when(F.col("verdict") != "mismatch", F.col("verdict"))
    result = F.struct(
        F.col("rule_id").alias("ruleId"), severity_level(F.col("severity")).alias("level"), F.struct(F.concat(F.lit("untrusted value reaches "), "path").alias("text")).alias("message"),
        F.array(_place(F.col("path"), F.col("sink_start"))).alias("locations"), F.array(flow).alias("codeFlows"), F.struct(F.col("fingerprint").alias("evidence/v1")).alias("partialFingerprints"),
        F.struct(severity_score(F.col("severity")).alias("security-severity"), verdict.alias("assessment")).alias("properties"),
    )
    return rows.select("finding_id", F.to_json(result).alias("result"))


def _document(lead: str) -> tuple[str, str]:
    """What stands before and after the rows of a document whose other members are `lead`."""
    return lead[:-1] + LEAD_END, "\n]}\n"


def _write(rows: DataFrame, path: str, head: str, tail: str, parts: bool = False) -> None:
    """rows: one column of text, in order. Written by tasks (`corvane.sources.documents`), the driver joins bytes or names parts."""
    rows.sparkSession.dataSource.register(documents.Documents)
    writer = rows.write.format("documents").mode("append").option("path", os.path.abspath(path)).option("head", head).option("tail", tail)
    writer.option("staging", shared_folder(rows.sparkSession)).option("parts", str(parts).lower()).save()


def _head(findings: DataFrame, limit: int | None) -> tuple[DataFrame, int, int]:
    """(rows to write in order, their number, how many there are)."""
    total = findings.count()
    rows = findings.orderBy("finding_id")
    return (rows if limit is None or total <= limit else rows.limit(limit)), total if limit is None else min(total, limit), total


def export_sarif(findings: DataFrame, path: str, limit: int | None = None, assessments: DataFrame | None = None, parts: bool = False) -> int:
    """One document in the order of identifiers; with a limit that cuts it, its properties say how many results there are. parts: a folder of such documents, and their names."""
    rows, n, total = _head(sarif_results(findings, assessments), limit)
    rules = [{"id": rule, "properties": {"severity": severity, "cwe": cwe}} for rule, _, _, severity, cwe in RULES]
    lead = json.dumps({"driver": {"name": NAME, "rules": rules}}, sort_keys=True)
    whole = json.dumps({"complete": n == total, "results": total}, sort_keys=True)
    _write(rows.select("result"), path, f'{{"version": "{SARIF_VERSION}", "runs": [{{"tool": {lead}, "properties": {whole}, "results": [', "\n]}]}\n", parts)
    return n


def export_json(findings: DataFrame, path: str, limit: int | None = None, header: dict | None = None, parts: bool = False) -> int:
    """schema, complete, total, findings, and what the header says. Complete only if every finding is in it and the header names no file that was left out."""
    rows, n, total = _head(findings, limit)
    whole = n == total and not (header or {}).get("left_out")
    lead = json.dumps({"schema": SCHEMA_VERSION, "complete": whole, "total": total} | ({"header": header} if header else {}), sort_keys=True)
    _write(rows.select(F.to_json(F.struct("*")).alias("row")), path, *_document(lead), parts)
    return n


def checked_document(path: str, size: int = MAX_DOCUMENT) -> dict:
    """A JSON document from a regular file of bounded size."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(handle, "rb") as file:
        about = os.fstat(file.fileno())
        if not stat.S_ISREG(about.st_mode) or about.st_size > size:
            raise ValueError(f"{path} is no regular file of at most {size} bytes")
        data = file.read(size + 1)
    if len(data) > size:
        raise ValueError(f"{path} grew while it was read")
    found = json.loads(data)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no document")
    return found


def _first_line(path: str) -> dict:
    """The members before the rows of a document that is written a row a line, of whatever size."""
    handle = os.open(path, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
    with os.fdopen(handle, "rb") as file:
        if not stat.S_ISREG(os.fstat(handle).st_mode):
            raise ValueError(f"{path} is no regular file")
        line = file.readline(MAX_LEAD + 1)
        file.seek(-min(os.fstat(handle).st_size, 4), os.SEEK_END)
        end = file.read()
    if not line.endswith(f"{LEAD_END}\n".encode()) or end != b"\n]}\n":
        raise ValueError(f"{path} is no report, or was cut off")
    return json.loads(line[: -len(LEAD_END) - 1] + b"}")


class WrongSchema(ValueError, LookupError):
    """A report of another version."""


def _checked(path: str, found: dict, partial: bool) -> None:
    if found.get("schema") != SCHEMA_VERSION:
        raise WrongSchema(f"{path} has schema {found.get('schema')}, not {SCHEMA_VERSION}")
    if found.get("complete") is not True and not partial:
        raise ValueError(f"{path} is not complete")


def read_report(spark: SparkSession, path: str, partial: bool = False) -> DataFrame:
    """The findings of an exported report, a document or a folder of parts; of this schema, and whole unless `partial`.

    A document of at most MAX_DOCUMENT bytes is read as one value, however it is laid out. Larger ones, and parts, must be laid out as the
    exports write them: a row a line, which tasks read in pieces. There, a row that is no finding, or another number of rows than a whole
    document names, is a fault.
    """
    if not os.path.isdir(path) and os.path.getsize(path) <= MAX_DOCUMENT:
        found = checked_document(path)
        _checked(path, found, partial)
        rows = spark.read.schema(f"findings array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
        return rows.select(F.explode("findings").alias("f")).select("f.*") if found.get("findings") else spark.createDataFrame([], FINDING)
    places, expected = [path], None
    if os.path.isdir(path):
        manifest = checked_document(os.path.join(path, documents.MANIFEST))
        if any(os.path.basename(part["name"]) != part["name"] for part in manifest["parts"]):
            raise ValueError(f"{path} names parts outside itself")
        places, expected = [os.path.join(path, part["name"]) for part in manifest["parts"]], manifest["rows"]
    for place in places:
        lead = _first_line(place)
        _checked(place, lead, partial)
        expected = lead.get("total") if expected is None and not partial else expected
    lines = spark.read.text([f"file://{os.path.abspath(place)}" for place in places]).filter(~F.col("value").endswith(LEAD_END) & (F.col("value") != "]}"))
    rows = lines.select(F.from_json(F.regexp_replace("value", ",$", ""), FINDING, {"mode": "FAILFAST"}).alias("f")).select("f.*")
    if expected is not None and lines.count() != expected:
        raise ValueError(f"{path} does not hold the {expected} findings that it names")
    return rows


def write_artifact(path: str, kind: str, version: int, body: dict) -> None:
    """Any document with its kind and version."""
    write_atomically(path, json.dumps({"kind": kind, "version": version} | body, indent=1, sort_keys=True))


def read_artifact(path: str, kind: str, version: int) -> dict:
    found = checked_document(path)
    if (found.get("kind"), found.get("version")) != (kind, version):
        raise ValueError(f"{path} is {found.get('kind')} {found.get('version')}, not {kind} {version}")
    return found


BASELINE, BASELINE_VERSION = "baseline", 1


def write_baseline(rows: DataFrame, path: str) -> None:
    """(fingerprint, related_key) in strictly ascending order of fingerprints, one row each."""
    ordered = rows.groupBy("fingerprint").agg(F.max("related_key").alias("related_key")).orderBy("fingerprint")
    _write(ordered.select(F.to_json(F.struct("*")).alias("row")), path, *_document(json.dumps({"kind": BASELINE, "version": BASELINE_VERSION})))


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A baseline as it was written: kind, version, well-formed fingerprints, strictly ascending."""
    found = read_artifact(path, BASELINE, BASELINE_VERSION)
    rows = found.get("findings")
    if not isinstance(rows, list) or any(not isinstance(r, dict) or not re.match(FINGERPRINT, r.get("fingerprint") or "") or not isinstance(r.get("related_key"), str) for r in rows):
        raise ValueError(f"{path} has malformed rows")
    if any(a["fingerprint"] >= b["fingerprint"] for a, b in zip(rows, rows[1:], strict=False)):
        raise ValueError(f"{path} is not in order")
    return spark.createDataFrame([(r["fingerprint"], r["related_key"]) for r in rows], "fingerprint string, related_key string")


#: What two steps of a contract must share; columns that the steps don't have are left out.
STEP_FIELDS = ("kind", "role", "effect", "source_kind", "sink_kind")


def steps_match(expected: Column, observed: Column, fields: tuple[str, ...]) -> Column:
    """Equal in the fields, nulls included, and, with a span, in equivalent places."""
    same = F.lit(True)
    for name in fields:
        same = same & (spans_equivalent(expected.span, observed.span) if name == "span" else expected[name].eqNullSafe(observed[name]))
    return same


def paths_align(expected: Column, observed: Column, fields: tuple[str, ...] = ("kind",)) -> Column:
    """Arrays of steps with `skippable` and the fields: one walk over both; a step that doesn't match is skipped if it may be, the expected one first.

    A fold over as many turns as both have steps; its state is the two places, or -1 once a step neither matches nor may be skipped.
    """
    def turn(s: Column, _: Column) -> Column:
        i, j = s.i, s.j
        e, o = F.get(expected, i), F.get(observed, j)
        going = (i >= 0) & (i < F.size(expected)) & (j < F.size(observed))
        moved = F.when(steps_match(e, o, fields), _pair(i + 1, j + 1)).when(e.skippable, _pair(i + 1, j)).when(o.skippable, _pair(i, j + 1)).otherwise(_pair(F.lit(-1), F.lit(-1)))
        return F.when(going, moved).otherwise(s)

    end = F.aggregate(F.sequence(F.lit(1), F.size(expected) + F.size(observed) + 1), _pair(F.lit(0), F.lit(0)), turn)

    def rest(steps: Column, at: Column) -> Column:
        return F.forall(F.slice(steps, F.least(at, F.size(steps)) + 1, F.greatest(F.size(steps), F.lit(1))), lambda x: x.skippable)

    return (end.i >= 0) & rest(expected, F.greatest(end.i, F.lit(0))) & rest(observed, F.greatest(end.j, F.lit(0)))


def _pair(i: Column, j: Column) -> Column:
    return F.struct(i.alias("i"), j.alias("j"))


def contract_verdict(expected: Column, observed: Column, connected: Column, barriers: Column, uncertain: Column, fields: tuple[str, ...] = ("kind",), taxonomy: Column | None = None) -> Column:
    """no_match, partial or exact. A path runs from a source to a sink over connected edges, without a barrier in effect, and every step agrees in the fields.

    taxonomy: whether version, category and invariant of both sides are the same. The first field says what a source and a sink are.
    """
    n = F.size(observed)
    whole = (n >= 2) & (F.size(connected) + 1 == n) & F.forall(connected, lambda x: x) & (F.size(barriers) == 0)
    ends = (F.get(observed, F.lit(0))[fields[0]] == "source") & (F.element_at(observed, -1)[fields[0]] == "sink")
    agrees = F.lit(True) if taxonomy is None else taxonomy
    return F.when(~F.coalesce(agrees & whole & ends & paths_align(expected, observed, fields), F.lit(False)), "no_match").when(uncertain, "partial").otherwise("exact")


def preview(text: Column, line: Column, context: int = 3) -> Column:
    """Lines around a line (from 1), as an array; null for a text of more than MAX_PREVIEW bytes, and of at most MAX_CONTEXT lines on either side."""
    lines, around = F.split(text, "\n"), min(context, MAX_CONTEXT)
    first = F.greatest(line - around, F.lit(1))
    return F.when(F.octet_length(text) <= MAX_PREVIEW, F.slice(lines, first, F.greatest(F.least(line + around, F.size(lines)) - first + 1, F.lit(0))))


def verified_span(content: Column, start: Column, end: Column, digest: Column) -> Column:
    """The bytes of a span as text, if it lies in the content and still has the digest (SHA-256) that was noted; else null."""
    part = content.substr((start + 1).cast("int"), (end - start).cast("int"))
    fits = (start >= 0) & (end >= start) & (end <= F.octet_length(content))
    return F.when(fits & (F.sha2(part, 256) == digest), F.decode(part, "UTF-8"))
