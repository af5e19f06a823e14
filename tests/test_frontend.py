import pytest

from corvane.plans.cases import CASES
from corvane.plans.fixpoint import candidates
from corvane.plans.frontend import SAMPLES, records_of, scan


def found(spark, files):
    """(rule, path, line of the sink) of several small repositories at once."""
    rows = [(repository, path, bytearray(text.encode())) for repository, some in files.items() for path, text in some.items()]
    out = {repository: [] for repository in files}
    for r in candidates(records_of(spark.createDataFrame(rows, "repository string, path string, content binary"))).collect():
        text = files[r.repository][r.path].encode()
        out[r.repository].append((r.rule_id, r.path, text[: r.sink_start].count(b"\n") + 1))
    return {k: sorted(v) for k, v in out.items()}


def test_samples(spark, tmp_path):
    want = [("SE1001", "a.ts"), ("SE1001", "b.py"), ("SE1003", "c.go")]
    files = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in SAMPLES.items()], "path string, content binary")
    assert sorted((r.rule_id, r.path) for r in candidates(records_of(files)).collect()) == want
    for name, text in SAMPLES.items():
        (tmp_path / name).write_text(text)
    assert sorted((r.rule_id, r.path) for r in scan(spark, str(tmp_path)).collect()) == want


def test_cases(spark):
    got = found(spark, {name: {f"x.{ending}": text} for name, (ending, text, _) in CASES.items()})
    want = {name: sorted((rule, f"x.{ending}", text[: text.index(mark)].count("\n") + 1) for rule, mark in marks) for name, (ending, text, marks) in CASES.items()}
    assert got == want
    rules = {rule for _, _, marks in CASES.values() for rule, _ in marks}
    assert rules == {"SE1001", "SE1003", "SE1004", "SE1005", "SE1006", "SE1007", "SE1008", "SE1009", "SE1010"} | {"SE1002"}


def test_files_that_import_one_another(spark):
    caller = "import {{ {what} }} from '{where}';\nexport function f(req) {{\n  {call}(req.query.x);\n}}\n"
    helper = "export function run(x) {\n  exec(x);\n}\n"
    files = {
        "relative": {"src/a.ts": caller.format(what="run", where="./lib/b", call="run"), "src/lib/b.ts": helper},
        "renamed": {"src/a.ts": caller.format(what="run as go", where="../src/lib", call="go"), "src/lib/index.ts": helper},
        "root": {"web/src/a.ts": caller.format(what="run", where="@/lib/b.js", call="run"), "web/src/lib/b.ts": helper},
        "not imported": {"src/a.ts": "export function f(req) {\n  run(req.query.x);\n}\n", "src/lib/b.ts": helper},
        "default": {"src/a.ts": "import run from './b';\nexport function f(req) {\n  run(req.query.x);\n}\n", "src/b.ts": helper},
        "name space": {"src/a.ts": "import * as lib from './b';\nexport function f(req) {\n  lib.run(req.query.x);\n}\n", "src/b.ts": helper},
        "required": {"src/a.js": "const { run } = require('./b');\nexports.f = function (req) {\n  run(req.query.x);\n};\n", "src/b.js": helper},
        "another language": {"a.ts": "export function f(req) {\n  run(req.query.x);\n}\n", "b.py": "def run(x):\n    os.system(x)\n"},
        "python": {"a.py": "def f(request):\n    run(request.args.get('x'))\n", "b.py": "def run(x):\n    os.system(x)\n"},
    }
    got = found(spark, files)
    hit = {"relative": "src/lib/b.ts", "renamed": "src/lib/index.ts", "root": "web/src/lib/b.ts", "name space": "src/b.ts", "required": "src/b.js", "python": "b.py"}
    assert got == {k: [("SE1001", hit[k], 2)] if k in hit else [] for k in files}


@pytest.mark.parametrize("guarded", [False, True])
def test_checks_in_helpers_and_callers(spark, guarded):
    check = "enforce(req.actor);\n" if guarded else "\n"
    text = f"function enforce(actor) {{\n  if (!actor.permissions.includes('w')) {{\n    throw new Error('no');\n  }}\n}}\nfunction apply(change) {{\n  store.update(change);\n}}\nexport function f(req) {{\n  {check}  apply(req.body.change);\n}}\n"
    assert found(spark, {"r": {"x.ts": text}})["r"] == ([] if guarded else [("SE1007", "x.ts", 7)])
