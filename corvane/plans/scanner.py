"""A tolerant scanner of source text: functions, statements and expressions of JavaScript/TypeScript, Python, Go and Rust as records.

Comments and the contents of strings are blanked without moving anything, brackets are paired once, and everything else works on that text.
Code outside functions gives records without function; classes' methods, arrows and functions inside functions are functions of their own.
What the scanner can't make out gives no records, so it errs towards silence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from corvane.functions import callees
from corvane.functions.semantics import AUTHORIZATION, POLICIES

LANGUAGE = {"javascript": "javascript", "jsx": "javascript", "typescript": "javascript", "tsx": "javascript", "python": "python", "go": "go", "rust": "rust"}
NAME = r"[A-Za-z_$][\w$]*(?:\s*(?:\?\.|\.|::)\s*[A-Za-z_$][\w$]*)*"
COMMON = {"return", "if", "else", "for", "while", "true", "false", "in", "import", "as", "break", "continue"}
WORDS = {
    "javascript": COMMON | {"await", "async", "new", "const", "let", "var", "null", "undefined", "of", "typeof", "instanceof", "function", "switch", "catch", "case", "throw", "yield", "export", "from", "class", "extends", "try", "do", "with", "finally", "delete", "void", "static", "super"},
    "python": COMMON | {"await", "async", "None", "True", "False", "not", "and", "or", "is", "raise", "yield", "from", "class", "def", "try", "with", "lambda", "elif", "except", "finally", "del", "pass", "assert", "global", "nonlocal"},
    "go": COMMON | {"var", "const", "nil", "err", "switch", "case", "func", "defer", "go", "range", "type", "struct", "interface", "select", "package"},
    "rust": COMMON | {"let", "mut", "const", "static", "fn", "pub", "use", "match", "unsafe", "move", "impl", "struct", "enum", "mod", "ref", "where", "loop"},
}
VALUE = re.compile(rf"(?<![\w$.])({NAME})(\s*!?\()?")
STATEMENT = re.compile(rf"\breturn\b(?P<r>)|\b(?:if|elif)\b(?P<g>)|(?:\b(?:const|let|mut|var)\s+)*(?P<o>{NAME}(?:\[[^\[\]\n]*\])*|\{{[^{{}}=;]*\}})\s*(?::[^=;\n{{}}()]*)?(?::|\+)?=(?![=>])(?P<e>)|(?P<c>{NAME})\s*!?(?=\()")
BLANKS = {
    "javascript": re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|(?P<rx>/(?![*/\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)", re.S),
    "c": re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^'\n]*|[^'\\\n])'", re.S),
    "python": re.compile(r"#[^\n]*|[rbf]*(?:\"\"\".*?\"\"\"|'''.*?''')|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
}
PAIRS = {")": "(", "]": "[", "}": "{"}
GOES_ON = re.compile(r"\s*(?:\.|\?\.|\?|:|\+|&&|\|\|)")
CATCH = re.compile(r"\s*catch\s*(?:\([^()]*\)\s*)?\{")
AFTER_PARAMETERS = re.compile(r"\s*(?::\s*(?:[^={};()]|\{[^{}]*\})*?)?\s*(=>|\{)")
#: Calls on a value, or with it, that give the value in another shape.
SHAPES = {"tolowercase", "touppercase", "trim", "tostring", "replace", "replaceall", "slice", "substring", "substr", "concat", "split", "join", "decodeuricomponent", "encodeuricomponent", "decodeuri", "atob", "url", "searchparams", "href", "strip", "lower", "upper", "format", "to_string", "to_owned", "as_str", "clone", "unwrap", "resolve", "normalize", "relative", "basename", "stringify", "parse"}
PATHS = {"join", "resolve", "normalize", "relative", "basename"}
EXITS = re.compile(r"\b(?:return|throw|raise|panic!|abort|process\.exit)\b")
FIXED_SET = re.compile(r"\bconst\s+([\w$]+)\s*(?::[^=\n]+)?=\s*(?:new\s+Set\s*(?:<[^>]*>)?\s*\(\s*\[([^\]]*)\]\s*\)|(?:Object\.freeze\(\s*)?\[([^\]]*)\])")
DENIES = re.compile(r"block|deny|denied|reject|forbid|disallow|banned|black", re.I)
ROUTE_CALL = re.compile(r"\b[\w$]+\s*\.\s*(get|post|put|patch|delete|options|head|all|use|any|handlefunc|handle)\s*\(", re.I)


@dataclass
class Function:
    head: int
    start: int
    end: int
    name: str
    parameters: str
    key: str = ""
    exposed: bool = False
    action: bool = False
    route: str | None = None
    block: bool = True
    asynchronous: bool = False
    names: list = field(default_factory=list)


class Spans:
    """Disjoint ranges: of those that lie in one another the outer ones."""

    def __init__(self, ranges: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for a, b in sorted(ranges, key=lambda r: (r[0], -r[1])):
            if not self.ends or a >= self.ends[-1]:
                self.starts.append(a)
                self.ends.append(b)

    def end_of(self, at: int) -> int | None:
        """Where the range that holds the place ends."""
        k = bisect_right(self.starts, at) - 1
        return self.ends[k] if k >= 0 and at < self.ends[k] else None


class Text:
    """Text with its brackets: `text` is blanked, `raw` as it was. In both a remark is one blank, or one line end if it has any, so that long remarks cost nothing later; places are mapped back."""

    def __init__(self, raw: str, language: str):
        self.language, self.words = language, WORDS[language]
        self.original = raw
        self._shorten(raw)
        self.closing: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[()\[\]{}]", self.text):
            c = m[0]
            if c in "([{":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] == PAIRS[c]:
                self.closing[stack.pop()[1]] = m.start()
            else:  # of unmatched ones the innermost that fits closes
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == PAIRS[c]:
                        self.closing[stack[k][1]] = m.start()
                        del stack[k:]
                        break
        self.braces = sorted(a for a in self.closing if self.text[a] == "{")
        self.wide = [] if raw.isascii() else [m.start() for m in re.finditer(r"[^\x00-\x7f]", raw)]
        self.more = list(accumulate((len(raw[i].encode()) - 1 for i in self.wide), initial=0))

    def _shorten(self, raw: str) -> None:
        text, kept, self.cuts, self.gone, at, size = [], [], [], [0], 0, 0
        for m in BLANKS.get(self.language, BLANKS["c"]).finditer(raw):
            found, before = m[0], raw[at : m.start()]
            remark = found.startswith(("//", "/*", "#")) or found.startswith(('\"\"\"', "'''"))
            short = ("\n" if "\n" in found else " ") if remark else self._blanked(m, raw)
            text += [before, short]
            kept += [before, short if remark else found]
            size += len(before) + len(short)
            if remark:
                self.cuts.append(size)
                self.gone.append(self.gone[-1] + len(found) - len(short))
            at = m.end()
        self.text, self.raw = "".join([*text, raw[at:]]), "".join([*kept, raw[at:]])

    def _blanked(self, m: re.Match, raw: str) -> str:
        """A string or pattern without its contents; what stands in the holes of a template stays."""
        found = m[0]
        if m.groupdict().get("rx"):
            at = m.start()
            while at and raw[at - 1].isspace():
                at -= 1
            before = raw[max(0, at - 7) : at]
            if before and before[-1] not in "=(,:!&|?{};[\n" and not before.endswith("return"):
                return found  # a division
            return '"' + " " * (len(found) - 2) + '"'
        quote = found.lstrip("rbf")[:1]
        out = [c if c == "\n" else " " for c in found]
        if quote == "`" or found[0] == "f" or raw[max(0, m.start() - 1)] == "f":
            for hole in re.finditer(r"\$\{([^{}]*)\}" if quote == "`" else r"\{([^{}:!]*)[^{}]*\}", found):
                out[hole.start(1) : hole.end(1)] = hole[1]
        else:
            out[-1] = '"'
            out[len(found) - len(found.lstrip("rbf"))] = '"'
        return "".join(out)

    def origin(self, at: int) -> int:
        """The place in the original text."""
        return at + self.gone[bisect_right(self.cuts, at)]

    def close(self, at: int) -> int:
        return self.closing.get(at, len(self.text))

    def block_end(self, at: int, last: int) -> int:
        """The end of the innermost block that holds the place, `last` at most."""
        k = bisect_right(self.braces, at) - 1
        while k >= 0:
            if self.closing[self.braces[k]] >= at:
                return min(self.closing[self.braces[k]], last)
            k -= 1
        return last

    def guarded_end(self, at: int, last: int) -> int:
        """How far a check at the place holds: to the end of its block, and, out of a `try` whose `catch` leaves, on to the end of the block around it."""
        end = self.block_end(at, last)
        while end < last:
            opening = next((a for a in reversed(self.braces[: bisect_right(self.braces, at)]) if self.closing[a] == end), None)
            if opening is None or self.word_before(opening)[1] != "try":
                return end
            handler = CATCH.match(self.text, end + 1)
            if not handler or not self._leaves(handler.end(), self.close(handler.end() - 1)):
                return end
            at = self.close(handler.end() - 1) + 1
            end = self.block_end(at, last)
        return end

    def byte(self, at: int) -> int:
        at = self.origin(at)
        return at + self.more[bisect_left(self.wide, at)]

    def line_end(self, at: int, end: int) -> int:
        """Where the statement at the place ends."""
        last = ""  # its last sign so far
        while at < end:
            c = self.text[at]
            if c in ")]}":
                return at
            if c == ";" or c == "\n" and last and last not in "=(,+.&|?:" and not GOES_ON.match(self.text, at, end):
                return at
            if c in "([{":
                at = min(self.close(at), end)
                last = ")"
            elif not c.isspace():
                last = c
            at += 1
        return end

    def word_before(self, at: int) -> tuple[int, str]:
        """The word that ends before the place, blanks and type parameters left out, and where it begins."""
        while at and self.text[at - 1].isspace():
            at -= 1
        if at and self.text[at - 1] == ">" and self.text[at - 2 : at - 1] != "=":
            depth, k = 0, at
            while k and self.text[k - 1] not in "\n();{}":
                depth += (self.text[k - 1] == ">") - (self.text[k - 1] == "<")
                k -= 1
                if not depth:
                    break
            if not depth:
                at = k
                while at and self.text[at - 1].isspace():
                    at -= 1
        end = at
        while at and (self.text[at - 1].isalnum() or self.text[at - 1] in "_$#"):
            at -= 1
        return at, self.text[at:end]

    def slots(self, start: int, end: int) -> list[tuple[int, int]]:
        """Places of the parts between commas."""
        out, at, begin = [], start, start
        while at < end:
            c = self.text[at]
            if c in "([{":
                at = min(self.close(at), end)
            elif c == ",":
                out.append((begin, at))
                begin = at + 1
            at += 1
        return [(a, b) for a, b in [*out, (begin, end)] if self.text[a:b].strip()]

    def literal(self, start: int, end: int) -> str | None:
        """The text of a part that is one string and nothing else."""
        raw = self.raw[start:end].strip()
        if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "\"'`" and not (raw[0] == "`" and "${" in raw) and self.text[start:end].strip()[1:-1].strip() == "":
            return raw[1:-1]
        return None


class File(Text):
    def __init__(self, path: str, raw: str, mode: str):
        super().__init__(raw, LANGUAGE[mode])
        self.path, self.rows, self.js = path, [], LANGUAGE[mode] == "javascript"
        self.lists = "javascript" if self.js else "other"
        self.requests: set[str] = set()
        self.exposed = True

    def emit(self, kind: str, start: int, end: int, function: str | None, values: list[list[str]] | None = None, **more) -> dict:
        row = {"record_id": f"{self.path}:{self.byte(start)}:{kind}:{more.get('output') or more.get('name') or ''}", "path": self.path, "function": function, "kind": kind, "start_byte": self.byte(start), "end_byte": self.byte(end), "evaluation_order": len(self.rows), "language": self.language}
        row["values"] = [{"slot": i, "property": None, "value": v} for i, group in enumerate(values or []) for v in group]
        self.rows.append(row | more)
        return self.rows[-1]

    def dominance(self, start: int, end: int) -> dict:
        """Only JavaScript has ranges; elsewhere the order of the text stands in for them."""
        return {"dominance_start": self.byte(start), "dominance_end": self.byte(end)} if self.js else {}

    # functions

    def functions(self) -> list[Function]:
        found = getattr(self, f"_{self.language}_functions")()
        self.fixed = {m[1]: m[2] if m[2] is not None else m[3] for m in FIXED_SET.finditer(self.text) if not re.sub(r"[\s,\"]", "", m[2] or m[3] or "")} if self.js else {}
        for f in found:
            f.key = f"{self.path}::{f.name}:{f.start}"
        self._handlers(found)
        return sorted(found, key=lambda f: (f.start, -f.end))

    def _javascript_functions(self) -> list[Function]:
        found = []
        for open_at in (m.start() for m in re.finditer(r"\(", self.text)):
            close = self.close(open_at)
            after = AFTER_PARAMETERS.match(self.text, close + 1)
            if not after:
                continue
            arrow, (head, name) = after[1] == "=>", self.word_before(open_at)
            if arrow:  # what stands before the parenthesis is not its name
                head, name = open_at, self._bound_name(self._without_async(open_at))
            else:
                begin, word = (head, "") if not name else self.word_before(head)
                star = self.text[head - 1 : head] == "*"
                if star:
                    begin, word = self.word_before(head - 1)
                if name == "function" or word == "function":
                    head = head if name == "function" else begin
                    name = "" if name == "function" else name
                else:
                    end = head
                    while end and self.text[end - 1].isspace():
                        end -= 1
                    if not name or name in self.words or end and self.text[end - 1] not in "{};,*" and word not in ("async", "static", "get", "set", "public", "private", "protected", "override", "readonly") and "\n" not in self.text[end:head]:
                        continue
                name = name or self._bound_name(self._without_async(head))
            found.append(self._javascript_body(head, after, arrow, name or "anonymous", self.text[open_at + 1 : close]))
        for m in re.finditer(r"(?<![\w$.)])([A-Za-z_$][\w$]*)\s*(=>)", self.text):
            if m[1] != "async":
                found.append(self._javascript_body(m.start(), m, True, self._bound_name(self._without_async(m.start())) or "anonymous", m[1], group=2))
        return found

    def _javascript_body(self, head: int, after: re.Match, arrow: bool, name: str, parameters: str, group: int = 1) -> Function:
        at, before = after.end(group), self.text[max(0, head - 24) : head]
        asynchronous = re.search(r"\basync\s*(?:function\s*)?$", before) is not None or re.search(r"\basync\s+[\w$]*\s*$", before) is not None
        if arrow:
            body = re.compile(r"\s*\{").match(self.text, at)
            if not body:
                start = at + len(self.text[at:]) - len(self.text[at:].lstrip())
                return Function(head, start, self._arrow_end(start), name, parameters, block=False, asynchronous=asynchronous)
            at = body.end()
        return Function(head, at, self.close(at - 1), name, parameters, asynchronous=asynchronous)

    def _arrow_end(self, at: int) -> int:
        while at < len(self.text):
            c = self.text[at]
            if c in "([{":
                at = self.close(at)
            elif c in ")]};," or c == "\n" and not re.match(r"\s*[.?:+&|]", self.text[at:]):
                return at
            at += 1
        return at

    def _without_async(self, at: int) -> int:
        m = re.search(r"\basync\s*$", self.text[max(0, at - 16) : at])
        return at - len(m[0]) if m else at

    def _bound_name(self, at: int) -> str | None:
        """The name that what begins at the place is given: `name =`, `const name: T =`, `name:`."""
        m = re.search(r"([\w$]+)\s*(?::[^=;{}()\n]*)?=\s*$|([\w$]+)\s*:\s*$", self.text[max(0, at - 160) : at])
        return (m[1] or m[2]) if m else None

    def _python_functions(self) -> list[Function]:
        found = []
        for m in re.finditer(r"^(?P<i>[ \t]*)(?P<s>async\s+)?def\s+(?P<n>\w+)\s*\(", self.text, re.M):
            close = self.close(m.end() - 1)
            colon = self.text.find(":", close)
            if colon < 0:
                continue
            inside = re.compile(rf"^(?!{m['i']}[ \t]+\S|[ \t]*$)", re.M).search(self.text, self.text.find("\n", colon) + 1 or len(self.text))
            found.append(Function(m.start(), colon + 1, inside.start() if inside else len(self.text), m["n"], self.text[m.end() : close], asynchronous=bool(m["s"])))
        return found

    def _braced(self, pattern: str) -> list[Function]:
        found = []
        for m in re.finditer(pattern, self.text):
            open_at = self.text.index("(", m.end() - 1)
            close = self.close(open_at)
            body = re.compile(r"[^{;\n]*\{").match(self.text, close + 1)
            if body:
                found.append(Function(m.start(), body.end(), self.close(body.end() - 1), m["n"], self.text[open_at + 1 : close]))
        return found

    def _go_functions(self) -> list[Function]:
        return self._braced(r"\bfunc\s+(?:\([^()]*\)\s*)?(?P<n>\w+)\s*\(")

    def _rust_functions(self) -> list[Function]:
        return self._braced(r"\bfn\s+(?P<n>\w+)\s*(?:<[^()]*?>)?\s*\(")

    # who may be called from outside

    def _handlers(self, found: list[Function]) -> None:
        by_name: dict[str, list[Function]] = {}
        for f in found:
            by_name.setdefault(f.name, []).append(f)
        if self.js:
            server = re.match(r"\s*[\"']use server[\"']", self.raw) is not None
            route_file = re.search(r"(?:^|/)route\.[cm]?[jt]sx?$", self.path) is not None
            named = {x.strip().split(" as ")[0].strip() for m in re.finditer(r"\bexport\s*\{([^{}]*)\}|\bmodule\.exports\s*=\s*\{([^{}]*)\}", self.text) for x in (m[1] or m[2] or "").split(",")}
            named |= {x.partition(":")[2].strip() for x in named if ":" in x} | {m[1] for m in re.finditer(r"\bmodule\.exports\s*=\s*([\w$]+)|\bexport\s+default\s+([\w$]+)\s*;?", self.text) if m[1]}
            named |= {m[1] for m in re.finditer(r"\bexport\s+default\s+([\w$]+)\s*(?:;|\n|$)", self.text)} | {m[1] for m in re.finditer(r"\bexports\.[\w$]+\s*=\s*([\w$]+)", self.text)} | {m[1] for m in re.finditer(r"\bexport\s+const\s+[\w$]+\s*=\s*([\w$]+)\s*(?:;|\n|$)", self.text)}
            for f in found:
                line = self.text[max(0, f.head - 200) : f.head]
                exported = re.search(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?\s*)?$|\bexport\s+(?:const|let|var)\s+[\w$]+\s*(?::[^=;]*)?=\s*(?:async\s*)?$|\b(?:module\.)?exports(?:\.[\w$]+)?\s*=\s*(?:async\s*)?$", line) is not None or f.name in named and f.name != "anonymous"
                own = f.block and re.match(r"\s*[\"']use server[\"']", self.raw[f.start : f.end]) is not None
                f.exposed = exported or own
                if server and exported or own:
                    f.action, f.route = True, "server-action"
                elif exported and route_file and f.name in callees.METHODS["javascript"]:
                    f.route = f.name
        for m in ROUTE_CALL.finditer(self.text):
            verb, close = m[1].upper(), self.close(m.end() - 1)
            parts = self.slots(m.end(), close)
            if len(parts) < 2 or verb not in [*callees.METHODS["javascript" if self.js else "other"], "HANDLEFUNC", "HANDLE"] or not self.raw[slice(*parts[0])].strip()[:1] in "\"'`":
                continue
            for a, b in parts[1:]:
                for f in by_name.get(self.text[a:b].strip().rpartition(".")[2], []):
                    f.exposed, f.route = True, verb
                for f in found:
                    if a <= f.head and f.end <= b + 1 and not any(g is not f and a <= g.head <= f.head and f.end <= g.end and g.end <= b + 1 for g in found):
                        f.exposed, f.route = True, verb
        if self.language == "rust":
            for m in re.finditer(r"\b(get|post|put|patch|delete|any)\s*\(\s*(\w+)\s*\)", self.text):
                for f in by_name.get(m[2], []):
                    f.route = m[1].upper()
        for f in found:
            f.names = self._parameter_names(f.parameters)
            if self.language == "python":
                above = re.search(r"((?:^[ \t]*@[^\n]*\n)+)\Z", self.text[: f.head], re.M)
                f.marks = re.findall(r"@([\w.]+)", above[1]) if above else []
                if any(x.rpartition(".")[2].upper() in [*callees.METHODS["other"], "ROUTE"] for x in f.marks):
                    f.route = "ANY"
            if self.language == "rust":
                mark = re.search(r"#\[\s*(get|post|put|patch|delete)\b[^\n]*\n\s*(?:pub\s+)?(?:async\s+)?\Z", self.text[: f.head])
                f.route = f.route or (mark[1].upper() if mark else None)

    @staticmethod
    def _parameter_names(parameters: str) -> list[list[tuple[str | None, str]]]:
        """Of each slot: (property, name); a plain parameter has no property."""
        out, depth, begin = [], 0, 0
        for i, c in enumerate(parameters + ","):
            depth += (c in "([{<") - (c in ")]}") - (c == ">" and parameters[i - 1] != "=")
            if c == "," and depth <= 0:
                part = parameters[begin:i].strip()
                begin = i + 1
                if part.startswith("{"):
                    inside = part[1 : part.rfind("}")] if "}" in part else part[1:]
                    names = [x.split("=")[0].strip() for x in inside.split(",") if x.strip()]
                    out.append([(x.partition(":")[0].strip(), (x.partition(":")[2] or x).strip()) for x in names])
                elif part:
                    words = re.split(r"[:=\s?]", re.sub(r"^(?:(?:mut|public|private|readonly|self|&mut|&)\s+|[&*.]+)+", "", part))
                    out.append([(None, words[0])])
        return out

    # records

    def scan(self) -> list[dict]:
        spans = self.functions()
        inside = [(f.head, max(f.end, f.start)) for f in spans]
        self._imports()
        for f in spans:
            self.function(f, [(a, b) for a, b in inside if f.start <= a and b <= f.end and (a, b) != (f.head, f.end)])
        self.requests, self.exposed = set(), False
        self.owner = None
        self.statements(0, len(self.text), None, Spans(inside))
        return self.rows

    def _imports(self) -> None:
        if not self.js:
            return
        for m in re.finditer(r"\bimport\b(?P<w>[^;\"'`()]*?)\bfrom\s*(?P<q>[\"'])|\b(?:const|let|var)\s+(?P<r>[\w$]+|\{[^{}]*\})\s*=\s*(?:await\s+)?(?:require|import)\s*\(\s*(?P<p>[\"'])", self.text):
            at = m.end() - 1
            module = self.raw[at + 1 : self.raw.find(self.raw[at], at + 1)]
            bound = (m["w"] or m["r"] or "").strip()
            for group in re.finditer(r"\{([^{}]*)\}", bound):
                for x in group[1].split(","):
                    parts = [y for y in re.split(r"\s+as\s+|\s*:\s*", re.sub(r"^\s*type\s+", "", x.strip())) if y]
                    if parts:
                        self.emit("import", m.start(), m.end(), None, name=parts[0], output=parts[-1], callee=module)
            rest = re.sub(r"\{[^{}]*\}", "", bound)
            for x in rest.split(","):
                if space := re.search(r"\*\s*as\s+([\w$]+)", x):
                    self.emit("import", m.start(), m.end(), None, name="*", output=space[1], callee=module)
                elif x.strip() and x.strip() != "type":  # a default import never names a function; a required module is a name space
                    self.emit("import", m.start(), m.end(), None, name="*" if m["r"] else "default", output=x.strip(), callee=module)

    def function(self, f: Function, inner: list[tuple[int, int]]) -> None:
        key = f.key
        self.owner = f
        self.emit("function", f.start, f.end, key, name=f.name)
        if f.route:
            self.emit("handler", f.start, f.start, key, name=f.route)
        for slot, names in enumerate(f.names):
            for part, name in names:
                row = self.emit("argument", f.head, f.start, key, output=name)
                row["values"] = [{"slot": slot, "property": part, "value": ""}]
                if f.action or f.route and not self.js and self.language != "go" and name not in ("self", "cls"):
                    whole = "server-action-parameter" if self.js else "request-parameter"
                    if not (not self.js and name.lower() in ("request", "req")):
                        self.emit("source", f.head, f.start, key, name=whole, output=name)
        for mark in getattr(f, "marks", []):
            if callees.named_guard("other", mark):
                self.emit("guard", f.head, f.head, key, name=mark, dominance_start=self.byte(f.start), dominance_end=self.byte(f.end))
        self.requests = {name for names in f.names for _, name in names} if self.js and f.exposed else set()
        self.exposed, self.archives = f.exposed, {}
        if f.block:
            self.statements(f.start, f.end, key, Spans(inner))
        else:
            self.inner = Spans(inner)
            self.emit("return", f.start, f.end, key, [self.expression(f.start, f.end, key, f.end)])

    def statements(self, start: int, end: int, key: str | None, inner: Spans) -> None:
        self.inner, at = inner, start
        while (m := STATEMENT.search(self.text, at, end)) is not None:
            skip = inner.end_of(m.start())
            if skip is not None:
                at = skip
                continue
            at = m.end()
            if m["r"] is not None:
                stop = self.line_end(m.end(), end)
                self.emit("return", m.start(), stop, key, [self.expression(m.end(), stop, key, end)])
                at = max(at, stop)
            elif m["g"] is not None:
                at = max(at, self.condition(m.end(), key, end))
            elif m["o"] is not None:
                stop = self.line_end(m.end(), end)
                self.assignment(m, stop, key, end)
                at = max(at, stop)
            elif m["c"].split(".")[0].strip() in ("for",) and self.js:
                self._archive_loop(m.end(), key)
                at = self.text.find("(", m.end()) + 1
            elif re.split(r"\s*(?:\?\.|\.|::)\s*", m["c"])[0] not in self.words:
                stop = self.line_end(m.start(), end)
                self.expression(m.start(), stop, key, end)
                at = max(at, stop)

    def _archive_loop(self, at: int, key: str | None) -> None:
        """`for (const entry of archive.entries())`: the entry's path is not to be trusted."""
        open_at = self.text.find("(", at)
        head = self.text[open_at + 1 : self.close(open_at)].lower() if open_at >= 0 else ""
        m = re.match(r"\s*(?:const|let|var)\s+([\w$]+)\s+(?:of|in)\b(.*)", head, re.S)
        if m and any(x in head for x in ("archive", "tar", "zip")) and ("entr" in head or "member" in head):
            self.archives[self.text[open_at + 1 + m.start(1) : open_at + 1 + m.end(1)]] = True

    def assignment(self, m: re.Match, stop: int, key: str | None, end: int) -> None:
        values = self.expression(m.end(), stop, key, end)
        target = m["o"]
        if self.js and re.match(r"(?:object|function|array)\.prototype\b|.*(?:\.__proto__|\[[\"']__proto__[\"']\])", re.sub(r"\s", "", self.raw[m.start("o") : m.end("o")]).lower()):
            self.emit("sink", m.start(), stop, key, [values], name="prototype-mutation", callee=target)
        if target[0] == "{":
            pairs = [x.split("=")[0].strip() for x in target.strip("{}").split(",") if x.strip()]
            targets = [(x.partition(":")[0].strip(), (x.partition(":")[2] or x).strip().lstrip(".")) for x in pairs]
        else:
            targets = [(None, re.sub(r"\s", "", target).replace("?.", ".").replace("::", "."))]
        spread = self.dominance(m.start(), self.block_end(m.start(), end)) if self.js and key else {}
        for part, name in targets:
            own = [f"{v}.{part}" if part and not v.startswith("@") else v for v in values]
            if part:
                for v in own:
                    self.source(v, m.start(), stop, key)
            self.emit("assignment", m.start(), stop, key, [own], output=name, **spread)

    def expression(self, start: int, end: int, key: str | None, last: int) -> list[str]:
        """The values that an expression reads; its calls become records, inner ones first."""
        values, at = [], start
        fallback = self._safe_choice(start, end)
        while (m := VALUE.search(self.text, at, end)) is not None:
            skip = self.inner.end_of(m.start())
            if skip is not None:
                at = skip
                continue
            at = m.end()
            name = re.sub(r"\s*(?:\?\.|::|\.)\s*", ".", m[1])
            if name.partition(".")[0] in self.words and "." not in name or name in self.words:
                if m[2]:
                    at = m.end(1)
                continue
            if not m[2]:
                after = self.text[m.end() : end].lstrip()[:2]
                before = self.text[start : m.start()].rstrip()[-1:]
                if after[:1] == ":" and after != "::" and before in ("{", ",") and self.js:
                    continue  # a key, not a value
                at, name = self._subscripts(m.end(), name)
                while look := re.compile(r"\s*(?:\?\.)?\[").match(self.text, at, end):  # a computed index selects, it does not flow
                    close = min(self.close(look.end() - 1), end)
                    self.expression(look.end(), close, key, last)
                    at = close + 1
                self.source(name, m.start(), at, key)
                values.append(name)
                output, at = name, at
            else:
                close = min(self.close(m.end() - 1), end)
                output = self.call(name, m.start(), m.end(), close, key, last)
                values.append(output)
                at = close + 1
            at, output = self._chain(at, end, name if m[2] else None, output, m.start(), key, last)
            values[-1] = output
        return [v for v in dict.fromkeys(values) if v not in fallback]

    def _safe_choice(self, start: int, end: int) -> set[str]:
        """The value of `SET.has(x) ? x : "fixed"`, which is one of a fixed set."""
        m = re.search(r"([\w$]+)\s*\.\s*(?:has|includes)\s*\(\s*([\w$.]+)\s*\)\s*\?\s*([\w$.]+)\s*:\s*\"", self.text[start:end]) if self.js else None
        return {m[2]} if m and m[2] == m[3] and self._allows(m[1]) and "!" not in self.text[start : start + m.start()] else set()

    def _allows(self, name: str) -> bool:
        return name in self.fixed and not DENIES.search(name)

    def _subscripts(self, at: int, name: str) -> tuple[int, str]:
        """`a["b"]` is `a.b`, a dot inside the string included."""
        while m := re.compile(r"\s*(?:\?\.)?\[\s*([\"'])(.*?)\1\s*\]").match(self.raw, at):
            at, name = m.end(), f"{name}.{m[2]}"
            if more := re.compile(r"(?:\s*(?:\?\.|\.)\s*[A-Za-z_$][\w$]*)+(?!\s*\()").match(self.text, at):
                at, name = more.end(), name + re.sub(r"\s*(?:\?\.|\.)\s*", ".", more[0])
        return at, name

    def _chain(self, at: int, end: int, called: str | None, output: str, start: int, key: str | None, last: int) -> tuple[int, str]:
        """`.next(...)` behind a call: a call whose receiver is the value so far."""
        while m := re.compile(r"\s*(?:\?|\)?\s*\.await)?\s*(?:\?\.|\.|::)\s*([A-Za-z_$][\w$]*)(\s*!?\()?").match(self.text, at, end):
            if not m[2]:
                output, at, called = (output if output.startswith("@") else f"{output}.{m[1]}"), m.end(), f"{called}.{m[1]}" if called else None
                continue
            close = min(self.close(m.end() - 1), end)
            called = f"{called}.{m[1]}" if called else f"{output}.{m[1]}"
            output = self.call(called, m.start(1), m.end(), close, key, last, receiver=output, begin=start)
            at = close + 1
        return at, output

    def source(self, name: str, start: int, end: int, key: str | None) -> bool:
        kind = None
        root, _, part = name.partition(".")
        if self.js:
            if callees.kinds_of(callees.SECRET_ENVIRONMENT, name):
                kind = "sensitive-configuration"
            elif root in self.requests and part:
                kind = callees.member_kind(name)
            elif key and root in getattr(self, "archives", {}) and part in ("path", "name", "linkpath"):
                kind = "archive-entry-path"
        elif callees.reads_request(self.language, name):
            kind = callees.first_kind(callees.REQUEST_KINDS, name) or "request-parameter"
        if kind:
            self.emit("source", start, end, key, name=kind, output=name)
        return bool(kind)

    def _call_source(self, name: str, slots: list[list[str]], receiver: str | None) -> str | None:
        """What a call reads from the request, if it does."""
        low, root = callees.plain(name), name.partition(".")[0]
        if not self.js:
            return (callees.first_kind(callees.REQUEST_KINDS, name) or "request-parameter") if callees.reads_request(self.language, name) else None
        rooted = root in self.requests and "." in name or any(v.partition(".")[0] in self.requests for s in slots for v in s) and "formdata" in low
        if not rooted:
            return None
        leaf = low.rpartition(".")[2]
        if self.owner and self.owner.action and leaf == "get" or "formdata" in low:
            return "http-form-data"
        if "searchparams.get" in low:
            return "http-query"
        return {"json": "http-body", "header": "http-header", "get": "http-header", "cookie": "http-cookie"}.get(leaf)

    def call(self, name: str, start: int, open_at: int, close: int, key: str | None, last: int, receiver: str | None = None, begin: int | None = None) -> str:
        places = self.slots(open_at, close)
        slots = [self.expression(a, b, key, last) for a, b in places]
        end, output, low = close + 1, f"@call:{self.byte(start)}", callees.plain(name)
        leaf, owner = low.rpartition(".")[2], name.rpartition(".")[0]
        waited = re.search(r"\b(?:await|return)\s*$|[=(,&|!?:]\s*$", self.text[max(0, (begin or start) - 40) : begin or start]) is not None
        sink, choice = self.sink(name, places, slots, key)
        if sink:
            own = slots if self.js else [[v for s in slots for v in s]]
            if sink in ("cli-option-injection", "process-argument-execution") or choice is not None:
                own = [slots[0], [*slots[1], *(choice or [])], *slots[2:]] if len(slots) > 1 else own
            self.emit("sink", start, end, key, own or [[]], name=sink, callee=name)
        elif callees.named_guard(self.lists, name) and (self.js or not receiver):
            if not self._ignored(name, waited):
                self.emit("guard", start, end, key, [v for v in slots], name=name, callee=name, output=output, **(self.dominance(end, self.guarded_end(end, last)) if key else {}))
                return output
        elif callees.named_sanitizer(self.lists, name):
            self.emit("sanitizer", start, end, key, [[receiver] if receiver else [], *slots] if receiver else slots, name=name, callee=name, output=output)
            return output
        elif kind := self._call_source(name, slots, receiver):
            self.emit("source", start, end, key, name=kind, output=output)
            return output
        if receiver and low.endswith("searchparams.get"):
            self.emit("transformation", start, end, key, [[receiver]], callee=name, output=output, name="shape")
            return output
        subject = [receiver] if receiver else [owner] if owner and not (self.js and leaf in PATHS and owner in ("path", "posix")) else []
        if leaf in SHAPES and (self.js or leaf not in ("parse",)):
            self.emit("transformation", start, end, key, [[v for s in [*([subject] if leaf not in PATHS or not owner else []), *slots] for v in s]], callee=name, output=output, name="shape")
            return output
        extra = {"dominance_start": self.byte(end), "dominance_end": self.byte(self.guarded_end(end, last))} if self.js and key else {}
        self.emit("call", start, end, key, slots, callee=name, output=output, **extra)
        return output

    def _ignored(self, name: str, waited: bool) -> bool:
        """A check that runs on its own: its result is not waited for."""
        leaf = name.rpartition(".")[2]
        return self.js and not waited and (leaf.lower().endswith("async") or re.search(rf"\basync\s+function\s+{re.escape(leaf)}\b|\b{re.escape(leaf)}\s*=\s*async\b|\basync\s+{re.escape(leaf)}\s*\(", self.text) is not None)

    # sinks

    def sink(self, name: str, places: list[tuple[int, int]], slots: list[list[str]], key: str | None) -> tuple[str | None, list | None]:
        """(kind, further values of the second slot that matter)."""
        kind = callees.first_kind(callees.SINKS[self.language], name)
        if kind == "dynamic-code-execution" and self.js and callees.plain(name) == "eval" and re.search(r"\b(?:const|let|var|function)\s+eval\b|[(,]\s*eval\s*[,:)][^;{]*(?:\{|=>)", self.text):
            kind = None
        if kind == "database-access" and len(places) > 1 and self.literal(*places[0]) is not None and (self.js or self.language in ("python", "go")):
            kind = "database-parameterized"
        if not self.js:
            return kind, None
        low = callees.plain(name)
        target = re.sub(r"\s", "", self.raw[slice(*places[0])]).lower() if places else ""
        if low in ("object.assign", "object.defineproperty", "reflect.defineproperty") and re.match(r"(?:object|function|array)\.prototype\b|.*(?:\.__proto__|\[[\"']__proto__[\"']\])", target):
            kind = "prototype-mutation"
        if callees.kinds_of(callees.DISCLOSURES, name):
            kind = "sensitive-data-disclosure"
        if kind in ("redirect", "network-request") and places and self._safe_choice(*places[0]):
            return "destination-policy-selected", None
        if kind == "process-execution" and low.rpartition(".")[2] in ("spawn", "spawnsync", "execfile", "execfilesync") and len(places) > 1:
            return self._program(places, slots)
        return kind, None

    def _program(self, places: list[tuple[int, int]], slots: list[list[str]]) -> tuple[str, list | None]:
        program, (a, b) = self.literal(*places[0]), places[1]
        if program is None or self.text[a:b].strip()[:1] != "[":
            return "process-execution", None
        items = self.slots(self.text.index("[", a) + 1, self.close(self.text.index("[", a)))
        words = [self.literal(*i) for i in items]
        shell = program.rpartition("/")[2]
        if shell in ("sh", "bash", "dash", "ksh", "zsh"):
            at = next((i for i, w in enumerate(words) if w is not None and shell_command_option(shell, w)), None)
            if at is not None and all(w is not None and shell_leading_option(shell, w) for w in words[:at]):
                return ("process-execution", None) if at + 1 < len(words) and words[at + 1] is None else ("process-argument-execution", None)
        if len(places) > 2 and re.search(r"\bshell\s*:(?!\s*false\b)", self.text[slice(*places[2])]) or len(places) > 2 and self.text[slice(*places[2])].strip()[:1] != "{":
            return "process-execution", None
        ended = option = False
        for word in words:
            if word is not None:
                ended = ended or word == "--"
                option = not ended and word.startswith("-") and word != "-"
            elif not ended and not option:
                return "cli-option-injection", []
            else:
                option = False
        return "process-argument-execution", None

    # guards

    def condition(self, at: int, key: str | None, last: int) -> int:
        """An `if`: its calls are records; where the branch leaves, what its test proves holds behind it."""
        if self.language == "python":
            stop = self._colon(at, last)
            body = self._indented(at, stop, last)
        else:
            start = at + len(self.text[at:]) - len(self.text[at:].lstrip())
            if self.text[start : start + 1] == "(":
                stop = self.close(start) + 1
            else:
                stop = self.text.find("{", start, last)
                stop = stop if stop >= 0 else self.line_end(start, last)
            after = stop + len(self.text[stop:]) - len(self.text[stop:].lstrip())
            body = (after + 1, self.close(after)) if self.text[after : after + 1] == "{" else (after, self.line_end(after, last))
        leaves = self._leaves(*body)
        if not self.js:
            self.expression(at, stop, key, last)  # guards among its calls stand by their order
            return stop
        if key is None:
            self.expression(at, stop, key, last)
            return stop
        known = len(self.rows)
        self.expression(at, stop, key, last)
        tested = [r for r in self.rows[known:] if r["kind"] == "guard"]
        del_ids = {id(r) for r in tested}
        self.rows[known:] = [r for r in self.rows[known:] if id(r) not in del_ids]  # a test alone protects nothing
        text = self.text[at:stop]
        behind = (body[1], self.block_end(body[1] + 1, last) if body[1] + 1 < last else last)
        if "&&" not in text:
            self._authorization(at, stop, text, tested, leaves, body, behind, key)
        if leaves:
            self._proofs(at, stop, text, behind, key)
        return stop

    def _authorization(self, at: int, stop: int, text: str, tested: list[dict], leaves: bool, body: tuple[int, int], behind: tuple[int, int], key: str) -> None:
        names = [re.sub(r"\s*(?:\?\.|\.)\s*", ".", x) for x in re.findall(NAME, text)]
        names = [n for n in names if n not in self.words]
        hit = tested[0]["name"] if tested else next((n for n in names if authorization_word(n)), None) or next((n for n in names if callees.named_guard("javascript", n) and "." in n), None)
        if not hit:
            return
        callee = tested[0]["callee"] if tested else None
        inputs = [[*names, *[v["value"] for r in tested for v in r["values"]]]]
        negated = "!" in text or "==" in text
        if leaves and negated:
            self.emit("guard", at, stop, key, inputs, name=hit, callee=callee, **self.dominance(*behind))
        elif not negated and tested:
            self.emit("guard", at, stop, key, inputs, name=hit, callee=callee, **self.dominance(*body))

    def _proofs(self, at: int, stop: int, text: str, behind: tuple[int, int], key: str) -> None:
        """What a test of a value proves, where its failure leaves: one of a fixed set, a URL's host or origin, a path below its root."""
        def proven(policy: str, *values: str) -> None:
            self.emit("guard", at, stop, key, [list(values)], name=policy, **self.dominance(*behind))

        wide = re.sub(r"\s+", "", text)
        raw = re.sub(r"\s+", "", self.raw[at:stop])
        for m in re.finditer(r"!([\w$]+)\.(?:has|includes)\(([\w$.]+)\)", wide):
            if self._allows(m[1]):
                value = m[2]
                root, _, part = value.rpartition(".")
                if part in ("hostname", "host") and re.search(rf"{re.escape(root)}\.protocol!==?[\"']https?:[\"']", raw):
                    proven("outbound-destination-policy", root, f"{root}.href")
                elif part == "origin":
                    proven("redirect-destination-policy", root, f"{root}.href")
                    proven("outbound-destination-policy", root, f"{root}.href")
                elif part not in ("hostname", "host", "protocol"):
                    proven("exact-value-allowlist", value)
        for m in re.finditer(r"([\w$]+)\.(hostname|host|origin)!==?([\"'][^\"']*[\"']|[\w$]+)", raw):
            fixed = m[3][0] in "\"'" or self._constant(m[3])
            if fixed and m[2] == "origin":
                proven("redirect-destination-policy", m[1], f"{m[1]}.href")
                proven("outbound-destination-policy", m[1], f"{m[1]}.href")
            elif fixed and re.search(rf"{re.escape(m[1])}\.protocol!==?[\"']https?:[\"']", raw):
                proven("outbound-destination-policy", m[1], f"{m[1]}.href")
        for m in re.finditer(r"!([\w$]+)\.startsWith\(([^()]+)\)", raw):
            if self._below_root(m[1], m[2], at):
                proven("filesystem-path-confinement", m[1])

    def _constant(self, name: str) -> bool:
        return re.search(rf"\bconst\s+{re.escape(name)}\s*(?::[^=\n]+)?=\s*[\"']", self.raw) is not None

    def _below_root(self, value: str, root: str, at: int) -> bool:
        """The value is composed from the root, and the test's prefix ends at a separator."""
        composed = re.search(rf"\b{re.escape(value)}\s*(?::[^=\n]+)?=\s*(?:[\w$]+\s*\.\s*)?(?:resolve|join|normalize|realpath\w*)\s*\(\s*([\w$.]+)", self.text[:at])
        if not composed:
            return False
        separated = re.search(r"\+(?:[\w$]+\.)?sep$|\+[\"']/[\"']$|^`\$\{[\w$]+\}/`$", root) is not None
        name = re.match(r"`?\$?\{?([\w$.]+)", root)
        if not separated and name:
            separated = re.search(rf"\b{re.escape(name[1])}\s*(?::[^=\n]+)?=[^;\n]*\+\s*(?:(?:[\w$]+\.)?sep|[\"']/[\"'])\s*(?:;|\n)", self.raw[:at]) is not None
        return separated and bool(name) and name[1] == composed[1]

    def _leaves(self, start: int, end: int) -> bool:
        """Whether the branch returns or throws for sure: such a statement stands in it at its own depth."""
        indent = None
        if self.language == "python":
            first = re.compile(r"[ \t]*(?=\S)", re.M).search(self.text, start, end)
            indent = first.end() - self.text.rfind("\n", 0, first.end()) if first else 0
        for m in EXITS.finditer(self.text, start, end):
            if self.inner.end_of(m.start()) is not None:
                continue
            if indent is not None:
                if m.start() - self.text.rfind("\n", 0, m.start()) == indent:
                    return True
            elif self.block_end(m.start(), end) >= end and not re.search(r"\b(?:if|else|for|while)\b[^;{}]*$", self.text[start : m.start()]):
                return True
        return False

    def _colon(self, at: int, last: int) -> int:
        while at < last:
            c = self.text[at]
            if c in "([{":
                at = self.close(at)
            elif c in ":\n":
                return at
            at += 1
        return last

    def _indented(self, at: int, stop: int, last: int) -> tuple[int, int]:
        line = self.text.rfind("\n", 0, at) + 1
        indent = re.match(r"[ \t]*", self.text[line:])[0]
        after = self.text.find("\n", stop, last)
        if after < 0:
            return stop, last
        inside = re.compile(rf"^(?!{indent}[ \t]+\S|[ \t]*$)", re.M).search(self.text, after + 1, last)
        return after + 1, inside.start() if inside else last


def authorization_word(name: str) -> bool:
    value = callees.plain(name).translate(str.maketrans("", "", "-_.:"))
    return any(w in value for kind, words in AUTHORIZATION.items() if kind != "authentication" for w in words)


def shell_flags(shell: str, option: str) -> str | None:
    """The letters of a cluster of short options that the shell knows; null for anything else."""
    known = "cexl" if shell in ("bash", "ksh", "zsh") else "cex"
    flags = option[1:]
    return flags if option[:1] == "-" and flags and all(c in known for c in flags) else None


def shell_command_option(shell: str, option: str) -> bool:
    """Whether the next word is program text: `c` once, no letter twice."""
    flags = shell_flags(shell, option)
    return flags is not None and flags.count("c") == 1 and len(set(flags)) == len(flags)


def shell_leading_option(shell: str, option: str) -> bool:
    flags = shell_flags(shell, option)
    return flags is not None and "c" not in flags


__all__ = ["File", "Text", "LANGUAGE", "NAME", "WORDS", "POLICIES", "shell_command_option", "shell_leading_option"]
