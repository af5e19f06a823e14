"""Source text to program records and findings: the scanner over a table of files, in one pass without a shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.classify import parser_mode
from corvane.plans.cases import CASES
from corvane.plans.fixpoint import RECORDS, candidates, findings
from corvane.plans.registry import query, table
from corvane.plans.scanner import File
from corvane.sources.tree import read_tree


def records_of(files: DataFrame) -> DataFrame:
    """files: path, content (binary), and perhaps repository -> RECORDS."""
    repository = F.coalesce(F.col("repository"), F.lit("")) if "repository" in files.columns else F.lit("")
    known = files.select("path", "content", parser_mode(F.col("path")).alias("mode"), repository.alias("repository")).filter("mode IS NOT NULL AND content IS NOT NULL")
    item = pa.struct([("slot", pa.int32()), ("property", pa.string()), ("value", pa.string())])
    kinds = {"start_byte": pa.int64(), "end_byte": pa.int64(), "evaluation_order": pa.int64(), "dominance_start": pa.int64(), "dominance_end": pa.int64(), "values": pa.list_(item)}
    shape = pa.schema([(x, kinds.get(x, pa.string())) for x in re.findall(r"(\w+) (?:string|long|array<struct<[^>]*>>)", RECORDS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, mode, repository in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                rows = File(path, content.decode("utf-8", "replace"), mode).scan()
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"repository": repository} for r in rows], schema=shape)

    return known.mapInArrow(scan, RECORDS)


def scan(spark: SparkSession, path: str, depth: int = 4, **options) -> DataFrame:
    """Findings of a source tree."""
    return findings(candidates(records_of(read_tree(spark, path, **options)), depth))


#: A few small files, one finding each but the last two, that a scan is held against.
SAMPLES = {
    "a.ts": "import { exec } from 'child_process';\nexport function run(req) {\n  const name = req.query.name;\n  exec(`ls ${name}`);\n}\n",
    "b.py": "def view(request):\n    host = request.args.get('host')\n    cmd = wrap(host)\n    os.system(cmd)\n\ndef wrap(v):\n    return 'ping ' + v\n",
    "c.go": "func Handle(w http.ResponseWriter, r *http.Request) {\n\tp := r.URL.Query().Get(\"p\")\n\tos.ReadFile(p)\n}\n",
    "d.js": "export function safe(req) {\n  const name = escapeShell(req.query.name);\n  exec('ls ' + name);\n}\n",
    "e.js": "export function fixed(req, db) {\n  db.query(\"select ? as a\", [req.body.a]);\n}\n",
}


#: What stands behind a document's text in the file made of it, by its number: two flows, one cleaned, and one in Python.
PROGRAMS = [
    ("js", "/* ", " */\n", "export function run(req) {\n  exec(req.query.k);\n}\n"), ("js", "/* ", " */\n", "export function run(req) {\n  const c = shellEscape(req.query.k);\n  exec(c);\n}\n"),
    ("js", "/* ", " */\n", "app.get('/x', (req, res) => res.redirect(req.query.k));\n"), ("py", '\"\"\"', '\"\"\"\n', "def run(request):\n    os.system(request.args.get('k'))\n"),
]
SINK_AT = [("SE1001", PROGRAMS[0][3].index("exec")), None, ("SE1005", PROGRAMS[2][3].index("res.redirect")), ("SE1001", PROGRAMS[3][3].index("os.system"))]


def files_of_documents(docs: DataFrame) -> DataFrame:
    """path, content: each document's text as a remark of any length, and a small program after it."""
    way, plain = F.col("doc_id") % len(PROGRAMS), F.regexp_replace(F.coalesce("text", F.lit("")), r"\*/|\"|\\\\", "")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(way == 3, ".py").otherwise(".js"))
    content = F.coalesce(*[F.when(way == i, F.concat(F.lit(a), plain, F.lit(b), F.lit(program))) for i, (_, a, b, program) in enumerate(PROGRAMS)])
    return docs.select(path.alias("path"), F.encode(content, "UTF-8").alias("content"))


_PLAIN = r"""regexp_replace(coalesce(text, ''), '\*/|"|\\', '', 'g')"""


@query(" UNION ALL ".join(f"SELECT 'd' || doc_id || '.{PROGRAMS[i][0]}' AS path, '{rule}' AS rule_id, CAST(strlen({_PLAIN}) + {len(PROGRAMS[i][1]) + len(PROGRAMS[i][2]) + at} AS BIGINT) AS sink_start FROM documents WHERE doc_id % {len(PROGRAMS)} = {i}" for i, (rule, at) in ((i, x) for i, x in enumerate(SINK_AT) if x)))
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Source text to findings over every document, scanned whole."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return findings(candidates(records_of(files_of_documents(docs)))).select("path", "rule_id", "sink_start")


_CASES = sorted(CASES.items())
_LEAD = {"js": "// ", "py": "# ", "go": "// ", "rs": "// "}


def _case_of(number: Column) -> Column:
    return (number % len(_CASES)).cast("int")


@query("SELECT path, rule_id, sink_start FROM (" + " UNION ALL ".join(f"SELECT 'p' || page_id || '.{ending}' AS path, '{rule}' AS rule_id, CAST(strlen(url) + {len(_LEAD[ending]) + 1 + len(text[: text.index(mark)].encode())} AS BIGINT) AS sink_start, page_id % {len(_CASES)} = {i} AS own FROM pages" for i, (_, (ending, text, marks)) in enumerate(_CASES) for rule, mark in marks) + ") WHERE own")
def scan_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Every rule and its controls in four languages: each page is a file of its own repository with one of the cases in it."""
    which, pages = _case_of(F.col("page_id")), table(spark, sf, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"))
    endings, texts, leads = (F.element_at(F.array(*map(F.lit, x)), which + 1) for x in zip(*[(e, t, _LEAD[e]) for _, (e, t, _) in _CASES], strict=True))
    number = F.col("page_id").cast("string")
    files = pages.select(number.alias("repository"), F.concat(F.lit("p"), number, F.lit("."), endings).alias("path"), F.encode(F.concat(leads, "url", F.lit("\n"), texts), "UTF-8").alias("content"))
    return findings(candidates(records_of(files))).select("path", "rule_id", "sink_start")
