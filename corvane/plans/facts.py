"""Facts: what stands where in source text, public rows with spans in bytes, lines and columns, and the graph they make.

Like the records, they come from the tolerant scanner: one pass over files, no shuffle. Columns count characters, offsets count bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.classify import parser_mode
from corvane.functions.semantics import edge_of_relation, node_of_fact
from corvane.functions.text import digest
from corvane.operators.graph import union_distinct
from corvane.functions import callees
from corvane.plans.scanner import LANGUAGE, NAME, Text
from corvane.plans.frontend import _PLAIN, PROGRAMS, files_of_documents
from corvane.plans.registry import query, table

FACTS = "path string, kind string, name string, start_byte long, end_byte long, start_line int, start_column int, end_line int, end_column int, relationships array<struct<kind:string,target:string>>, parser string"
METHODS = callees.METHODS["facts"]

IMPORTS = {
    "javascript": re.compile(r"\bimport\b[^;\n\"'`]*[\"'](?P<m>[^\"'\n]+)[\"']|\brequire\(\s*[\"'](?P<n>[^\"'\n]+)[\"']\s*\)"),
    "python": re.compile(r"^[ \t]*(?:from\s+(?P<m>[\w.]+)\s+import\b|import\s+(?P<n>[\w.]+))", re.M),
    "go": re.compile(r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<m>[\w./-]+)\"\s*$", re.M),
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+(?P<m>[\w:]+)", re.M),
}
FUNCTIONS = {
    "javascript": re.compile(r"(?P<x>\bexport\s+(?:default\s+)?)?(?:async\s+)?\bfunction\s*\*?\s*(?P<a>[\w$]+)|(?P<y>\bexport\s+)?\b(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)[^=\n]*=>)"),
    "python": re.compile(r"^(?P<i>[ \t]*)(?:async\s+)?def\s+(?P<a>\w+)", re.M),
    "go": re.compile(r"\bfunc\s+(?P<i>\([^()]*\)\s*)?(?P<a>\w+)"),
    "rust": re.compile(r"(?P<i>^[ \t]+)?(?:pub\s+)?(?:async\s+)?\bfn\s+(?P<a>\w+)", re.M),
}
METHOD = re.compile(r"^[ \t]+(?:async\s+|static\s+|public\s+|private\s+)*(?P<a>[A-Za-z_$][\w$]*)\s*\([^()]*\)\s*(?::[^{\n]+)?\{", re.M)
EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\*?|const|let|var|class)?\s*(?P<a>[\w$]+)")
ENVIRONMENT = re.compile(r"\b(?:process|Deno|Bun)\.env\.(?P<a>[^\W\d]\w*)|\bos\.(?:environ\[\s*[\"'](?P<b>\w+)|getenv\(\s*[\"'](?P<c>\w+)|Getenv\(\s*\"(?P<d>\w+))|\benv::var\(\s*\"(?P<e>\w+)")
ROUTE = re.compile(r"\b(?:app|router|server)\.(?P<v>get|post|put|patch|delete|head|options|use|all)\(\s*[\"'`](?P<p>[^\"'`]*)[\"'`]\s*(?:,\s*(?P<h>[\w$.]+))?")
CALL = re.compile(rf"({NAME})\s*!?\(")


def next_route(path: str) -> str | None:
    """text.route_of for one path: the address that a route file serves."""
    parts = path.split("/")
    if "app" not in parts or not re.fullmatch(r"route\.[cm]?[jt]sx?", parts[-1]):
        return None
    return "/" + "/".join(p for p in parts[parts.index("app") + 1 : -1] if not p.startswith("("))


class Facts(Text):
    def __init__(self, path: str, raw: str, mode: str):
        super().__init__(raw, LANGUAGE[mode])
        self.path, self.mode, self.rows = path, mode, []
        self.lines = [0, *[m.end() for m in re.finditer("\n", raw)]]

    def place(self, at: int) -> tuple[int, int, int]:
        from bisect import bisect_right

        place = self.origin(at)
        line = bisect_right(self.lines, place)
        return self.byte(at), line, place - self.lines[line - 1] + 1

    def emit(self, kind: str, start: int, end: int, name: str | None, *related: tuple[str, str]) -> None:
        (a, line, column), (b, line_b, column_b) = self.place(start), self.place(end)
        named = name if name is None or len(name.encode()) <= 512 else name.encode()[:512].decode("utf-8", "ignore")
        self.rows.append({"path": self.path, "kind": kind, "name": named, "start_byte": a, "end_byte": b, "start_line": line, "start_column": column, "end_line": line_b, "end_column": column_b, "relationships": [{"kind": k, "target": t} for k, t in related], "parser": self.mode})

    def code(self, at: int) -> bool:
        """Whether the place is code, not a comment or the inside of a string."""
        return self.text[at] == self.raw[at]

    def scan(self) -> list[dict]:
        js, route = self.language == "javascript", next_route(self.path)
        actions = js and re.match(r"\s*[\"']use server[\"']", self.raw) is not None
        for m in IMPORTS[self.language].finditer(self.raw):
            if self.code(m.start()):
                target = m.groupdict().get("m") or m.groupdict().get("n")
                self.emit("module-import", m.start(), m.end(), target, ("imports", target))
        for m in FUNCTIONS[self.language].finditer(self.text):
            got = m.groupdict()
            name, start = got.get("a") or got.get("b"), m.start() + len(m[0]) - len(m[0].lstrip())
            exported = bool(got.get("x") or got.get("y"))
            begin = start + (len(got.get("x") or got.get("y") or "") if exported else 0)
            open_at = self.text.find("{", m.end())
            end = m.end() if self.language == "python" or open_at < 0 else min(self.close(open_at) + 1, len(self.text))
            self.emit("method" if not js and got.get("i") else "function", begin, end, name)
            if js and exported and name in METHODS and route:
                self.emit("http-route-handler", begin, end, name, ("handles", f"{name} {route}"))
            own = js and open_at >= 0 and re.match(r"\s*[\"']use server[\"']", self.raw[open_at + 1 : end]) is not None
            if actions and exported or own:
                self.emit("server-action-handler", begin, end, name, ("exports-server-action", name))
        if js:
            for m in METHOD.finditer(self.text):
                if m["a"] not in self.words | {"switch", "catch", "with"}:
                    self.emit("method", m.start("a"), min(self.close(m.end() - 1) + 1, len(self.text)), m["a"])
            for m in EXPORT.finditer(self.text):
                self.emit("module-export", m.start(), m.end(), m["a"])
            for m in ROUTE.finditer(self.raw):
                if self.code(m.start()):
                    related = [("handles", f"{m['v'].upper()} {m['p']}")] + ([("handler", m["h"])] if m["h"] else [])
                    self.emit("http-route", m.start(), m.end(), m["v"].upper(), *related)
        for m in ENVIRONMENT.finditer(self.raw):
            if self.code(m.start()):
                self.emit("environment-access", m.start(), m.end(), next(g for g in m.groups() if g))
        for m in CALL.finditer(self.text):
            name = m[1].replace("?.", ".").replace("::", ".")
            before = self.text[self.text.rfind("\n", 0, m.start()) + 1 : m.start()].rstrip()
            if name in self.words or re.search(r"\b(?:function|def|func|fn)\s*\*?$", before):
                continue
            end = min(self.close(m.end() - 1) + 1, len(self.text))
            self.emit("call", m.start(), end, name, ("calls", name))
            for kind in callees.operation_kinds(self.language, name):
                self.emit(kind, m.start(), end, name)
            if js and name in ("eval", "Function") and not re.search(rf"\b(?:const|let|var|function|class)\s+{name}\b", self.text):
                self.emit("dynamic-code-execution", m.start(), end, name)
            if callees.named_guard("facts" if js else "other", name):
                self.emit("guard-candidate", m.start(), end, name)
        return sorted(self.rows, key=lambda r: (r["start_byte"], r["kind"], r["end_byte"], r["name"] or ""))


def facts_of(files: DataFrame) -> DataFrame:
    """files: path, content (binary) -> FACTS with fact_id."""
    known = files.withColumn("mode", parser_mode(F.col("path"))).filter("mode IS NOT NULL AND content IS NOT NULL").select("path", "content", "mode")
    related = pa.list_(pa.struct([("kind", pa.string()), ("target", pa.string())]))
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    shape = pa.schema([(n, related if t.startswith("array") else kinds[t]) for n, t in re.findall(r"(\w+) (string|long|int|array<struct<[^>]*>>)", FACTS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, mode in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows := Facts(path, content.decode("utf-8", "replace"), mode).scan():
                    yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return known.mapInArrow(scan, FACTS).withColumn("fact_id", digest(F.col("kind"), F.col("path"), F.col("start_byte"), F.col("end_byte"), F.col("name"), prefix="sf_"))


def evidence_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): files and their facts, held together by containment, imports and calls."""
    kind = node_of_fact(F.col("kind"))
    file_node = digest(F.lit("file"), F.col("path"), prefix="gn_")
    own = digest(F.col("node_kind"), F.col("path"), F.col("start_byte"), F.col("name"), prefix="gn_")
    named = facts.withColumn("node_kind", kind).withColumn("node_id", own).withColumn("file_id", file_node)
    files = named.select(F.col("file_id").alias("node_id"), F.lit("file").alias("kind"), F.col("path").alias("name"), "path")
    nodes = union_distinct([files, named.select("node_id", F.col("node_kind").alias("kind"), "name", "path")], "node_id")
    inside = named.select(F.lit("containment").alias("kind"), F.col("file_id").alias("from_node"), F.col("node_id").alias("to_node"))
    links = named.select("node_id", F.explode("relationships").alias("r")).select(edge_of_relation(F.col("r.kind")).alias("kind"), F.col("node_id").alias("from_node"), digest(F.lit("name"), F.col("r.target"), prefix="gn_").alias("to_node"))
    edges = union_distinct([e.withColumn("edge_id", digest(F.col("kind"), F.col("from_node"), F.col("to_node"), prefix="ge_")) for e in (inside, links)], "edge_id")
    return nodes, edges


#: A few files whose facts are known.
FILES = {
    "web/app/api/orders/[order]/route.ts": "import { send } from \"kit\";\n\nexport async function GET() {\n  const stock = await fetch(STOCK + \"/count\");\n  return send(await stock.json());\n}\n",
    "src/names.ts": "// exec('never')\nimport { stat } from \"disk\";\nconst öl = 3, Maß = \"é\" + process.env.LÄNGE;\n\nfunction größe(k: number) {\n  return k * öl;\n}\napp.get(\"/items/:key\", showItem);\nJSON.parse(Maß);\n",
    "src/tool.py": "import os\n\nclass Worker:\n    def start(self):\n        os.system(os.getenv('SHELL'))\n",
}


def _fact_sql(way: int, kind: str, name: str, mark: str) -> str:
    suffix, before, after, program = PROGRAMS[way]
    at = program.index(mark)
    return f"SELECT 'd' || doc_id || '.{suffix}' AS path, '{kind}' AS kind, '{name}' AS name, CAST(strlen({_PLAIN}) + {len(before) + len(after) + at} AS BIGINT) AS start_byte, CAST(length({_PLAIN}) - length(replace({_PLAIN}, chr(10), '')) + {2 + program[:at].count(chr(10))} AS INT) AS start_line, {at - program.rfind(chr(10), 0, at)} AS start_column FROM documents WHERE doc_id % {len(PROGRAMS)} = {way}"


@query(" UNION ALL ".join(_fact_sql(*x) for x in [(0, "function", "run", "function"), (1, "function", "run", "function"), (3, "function", "run", "def"), (0, "process-execution", "exec", "exec"), (1, "process-execution", "exec", "exec(c)"), (2, "redirect", "res.redirect", "res.redirect"), (3, "process-execution", "os.system", "os.system"), (2, "http-route", "GET", "app.get")]))
def facts_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Functions, operations and routes of every document's file, with their places in bytes, lines and characters."""
    facts = facts_of(files_of_documents(table(spark, sf, "documents").select("doc_id", "text")))
    return facts.filter(F.col("kind").isin("function", "process-execution", "redirect", "http-route")).select("path", "kind", "name", "start_byte", "start_line", "start_column")
