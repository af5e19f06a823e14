from corvane.operators import lines, windows


def test_places_against_prefixes(spark, monkeypatch):
    texts = {"a": "one\ntwo one\n\nönë one", "b": "one", "c": "", "d": None, "e": "oneone\n\none\n", "f": "\n" * 50 + "é" * 30 + "one", "g": "aXaXa one\r\none"}
    files = spark.createDataFrame([*texts.items(), (None, "one")], "path string, text string")
    want = []
    for path, text in texts.items():
        i = (text or "").find("one")
        while i >= 0:
            before = text[:i]
            want.append((path, len(before.encode()), before.count("\n") + 1, len(before) - before.rfind("\n")))
            i = text.find("one", i + 3)
    for rows in (1 << 22, 5):  # the second: files too large for a task
        monkeypatch.setattr(windows, "TASK_ROWS", rows)
        found = lines.located(lines.occurrences(files, "path", "text", "one"), files, "path", "at", "text")
        assert sorted(map(tuple, found.collect())) == sorted(want)
    odd = spark.createDataFrame([("b", 0), ("b", 3), ("b", 4), ("b", -1), ("b", None), ("x", 0), (None, 0), ("a", 3), ("a", 4), ("c", 0)], "path string, at long")
    got = {(r.path, r["at"]): (r.line, r.column) for r in lines.located(odd, files, "path", "at", "text").collect()}
    none = (None, None)
    assert got == {("b", 0): (1, 1), ("b", 3): (1, 4), ("b", 4): none, ("b", -1): none, ("b", None): none, ("x", 0): none, (None, 0): none, ("a", 3): (1, 4), ("a", 4): (2, 1), ("c", 0): (1, 1)}
    assert lines.occurrences(files.filter("path = 'z'"), "path", "text", "one").count() == 0
