"""Verbs over tables: scan, list, explain, rules, schema, doctor, baseline create and compare, history list, show and delete, ai providers, preview, validate and cache.

Exit codes: 0 nothing to report, 1 findings or baseline changes, 2 wrong input, 3 a document of another schema, 4 cancelled, 5 an internal failure.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.functions.semantics import RULES
from corvane.functions.settings import Settings
from corvane.operators import findings as found
from corvane.operators.joins import compare_snapshots
from corvane.session import local_session
from corvane.sources import assessments, reports, tree
from corvane.sources.cache import History
from corvane.sources.documents import MANIFEST

NOTHING, SOMETHING, WRONG, SCHEMA, CANCELLED, INTERNAL = 0, 1, 2, 3, 4, 5


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvane")
    verbs = out.add_subparsers(dest="verb", required=True)
    scan = verbs.add_parser("scan")
    scan.add_argument("path")
    scan.add_argument("--to", help="folder of a findings table")
    scan.add_argument("--json")
    scan.add_argument("--sarif")
    scan.add_argument("--limit", type=int, help="at most so many findings in a document, which then says that it is cut")
    scan.add_argument("--parts", action="store_true", help="documents are folders of parts, written by tasks alone")
    scan.add_argument("--exclude", action="append", default=[])
    scan.add_argument("--history", help="folder of past scans")
    scan.add_argument("--cache", help="folder of records of files that were scanned before")
    scan.add_argument("--progress", action="store_true")
    scan.add_argument("--depth", type=int, help="calls that a value is followed through")
    for name in ("explain", "list"):
        verb = verbs.add_parser(name)
        verb.add_argument("findings")
        verb.add_argument("what", nargs="?", default="")
        verb.add_argument("--sort", default="severity", choices=["severity", "confidence", "rule", "file", "category"])
    verbs.add_parser("rules")
    base = verbs.add_parser("baseline")
    base.add_argument("action", choices=["create", "compare"])
    base.add_argument("findings")
    base.add_argument("baseline")
    history = verbs.add_parser("history")
    history.add_argument("action", choices=["list", "show", "delete", "keep"])
    history.add_argument("folder")
    history.add_argument("what", nargs="?", default="")
    ai = verbs.add_parser("ai")
    ai.add_argument("action", choices=["providers", "preview", "validate", "cache"])
    ai.add_argument("findings", nargs="?", default="")
    ai.add_argument("what", nargs="?", default="")
    ai.add_argument("--recorded", help="a recorded assessment; without one, the mock")
    ai.add_argument("--cache")
    verbs.add_parser("schema")
    verbs.add_parser("doctor")
    return out


def main(arguments: list[str] | None = None) -> int:
    try:
        a = parser().parse_args(arguments)
    except SystemExit as stop:
        return NOTHING if not stop.code else WRONG
    try:
        return globals()[f"_{a.verb}"](a)
    except KeyboardInterrupt:
        return CANCELLED
    except LookupError as error:
        print(error, file=sys.stderr)
        return SCHEMA
    except (ValueError, OSError, StopIteration) as error:
        print(str(error).splitlines()[0] if str(error) else "nothing of that name", file=sys.stderr)
        return WRONG
    except PySparkException as error:
        print(str(error).splitlines()[0], file=sys.stderr)
        return WRONG if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error) else INTERNAL
    except Exception as error:  # noqa: BLE001  the code tells callers what kind it was
        print(repr(error).splitlines()[0], file=sys.stderr)
        return INTERNAL


def _rules(_) -> int:
    print(json.dumps([{"rule": r, "sink": s, "policy": p, "severity": v, "cwe": c} for r, s, p, v, c in RULES], indent=1))
    return NOTHING


def _schema(_) -> int:
    from corvane.plans.fixpoint import RECORDS

    print(json.dumps({"files": tree.SCHEMA, "records": " ".join(RECORDS.split()), "findings": reports.FINDING, "version": reports.SCHEMA_VERSION}, indent=1))
    return NOTHING


def _doctor(_) -> int:
    spark = local_session("corvane")
    print(json.dumps({"spark": spark.version, "cores": spark.sparkContext.defaultParallelism}))
    return NOTHING


def _scan(a) -> int:
    from corvane.plans.report import scan_report

    spark = local_session("corvane")
    settings = Settings(exclude=tuple(a.exclude), **({"max_interprocedural_depth": a.depth} if a.depth is not None else {}))
    report = scan_report(spark, a.path, settings, cache=a.cache, progress=(lambda stage: print(stage, file=sys.stderr)) if a.progress else None)
    n = report.findings.count()
    header = report.header | {"limitations": [r.code for r in report.limitations.orderBy("code").collect()], "diagnostics": report.diagnostics.count()}
    if a.to:
        report.findings.write.mode("overwrite").parquet(a.to)
    if a.json:
        reports.export_json(report.findings, a.json, a.limit, header, a.parts)
    if a.sarif:
        reports.export_sarif(report.findings, a.sarif, a.limit, parts=a.parts)
    if a.history:
        History(a.history).save(header["scan_id"], datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), header["repository"], {"findings": n, "files": header["files"], "content_digest": header["content_digest"]})
    print(json.dumps({"findings": n, "files": header["files"], "left_out": header["left_out"], "cache_hits": header["cache_hits"]}))
    return SOMETHING if n else NOTHING


def _table(path: str):
    """Findings of a table, or of an exported report."""
    spark = local_session("corvane")
    if path.endswith(".json") or os.path.isfile(os.path.join(path, MANIFEST)):
        return reports.read_report(spark, path)
    return spark.read.parquet(path)


def _print(rows) -> int:
    n = 0
    for line in rows.toJSON().toLocalIterator():
        print(line)
        n += 1
    return SOMETHING if n else NOTHING


def _list(a) -> int:
    rows = found.matching(_table(a.findings), a.what or None)
    known = set(rows.columns)
    if {"confidence": "confidence", "category": "category"}.get(a.sort, "rule_id") not in known:
        raise ValueError(f"these findings have no {a.sort}")
    return _print(found.ordered(rows, a.sort))


def _explain(a) -> int:
    return _print(found.explain(_table(a.findings), a.what))


def _baseline(a) -> int:
    spark, rows = local_session("corvane"), found.baseline_rows(_table(a.findings))
    if a.action == "create":
        reports.write_baseline(rows, a.baseline)
        return NOTHING
    states = {r.state: r["count"] for r in compare_snapshots(rows, reports.read_baseline(spark, a.baseline)).groupBy("state").count().collect()}
    print(json.dumps(states, sort_keys=True))
    return SOMETHING if set(states) - {"unchanged"} else NOTHING


def _history(a) -> int:
    history = History(a.folder)
    if a.action == "list":
        scans, corrupt = history.listing()
        print("\n".join(json.dumps(s, sort_keys=True) for s in scans))
        if corrupt:
            print(f"{corrupt} files were no scans", file=sys.stderr)
    elif a.action == "show":
        print(json.dumps(history.show(a.what), indent=1, sort_keys=True))
    elif a.action == "delete":
        if not history.delete(a.what):
            raise ValueError(f"no scan {a.what}")
    else:
        print(json.dumps({"deleted": history.keep(int(a.what))}))
    return NOTHING


def _ai(a) -> int:
    if a.action == "providers":
        print(json.dumps(assessments.providers(), indent=1))
        return NOTHING
    if a.action == "cache":
        print(json.dumps({"cleared": assessments.AssessmentCache(a.cache).clear()}))
        return NOTHING
    rows = found.explain(_table(a.findings), a.what)
    shown = rows.join(found.assessment_preview(rows, F.to_json(F.struct("rule_id", "path", "trail"))), "finding_id").collect()
    if not shown:
        raise ValueError(f"no finding {a.what}")
    row = shown[0]
    if a.action == "preview":
        print(json.dumps({"finding_id": row.finding_id, "payload": row.payload, "hidden": row.hidden, "consent": row.consent, "cost_bound": row.cost_bound}, indent=1))
        return NOTHING
    provider = assessments.recorded(a.recorded) if a.recorded else assessments.mock()
    print(json.dumps(assessments.assess({"finding_id": row.finding_id, "fingerprint": row.fingerprint}, row.payload, provider, assessments.AssessmentCache(a.cache) if a.cache else None), indent=1))
    return NOTHING


if __name__ == "__main__":
    sys.exit(main())
