import os

import pytest

from corvane.sources import tree


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Folders of many depths and widths, a name that is no text, links, and things to leave out."""
    place = tmp_path_factory.mktemp("tree")
    for name in [f"a/{i % 5}/b{i % 3}/f{i}.py" for i in range(60)] + [f"{'d/' * i}x{i}.ts" for i in range(12)] + ["node_modules/x.js", ".git/config", "lib/.git/x", "skip/me.py", ".env", "é/ü.md", "A.md", "a.md"]:
        os.makedirs(place / os.path.dirname(name), exist_ok=True)
        (place / name).write_bytes(b"x" * (len(name) * 7))
    (place / "large.bin").write_bytes(b"\x00" * 3000)
    (place / "none.txt").write_bytes(b"")
    (place / "empty").mkdir()
    with open(os.fsencode(str(place)) + b"/odd\xff.py", "wb") as file:
        file.write(b"x")
    os.symlink(place / "a", place / "link")
    return str(place)


def by_tasks(spark, folder, options, most):
    files, pruned = tree.listed(spark, folder, options, most)
    return sorted((bytes(r.place), r.size_bytes, r.state) for r in files.collect()), pruned


@pytest.mark.parametrize("most", [1, 7, 20_000])
@pytest.mark.parametrize("options", [{}, {"exclude": "skip/**", "max_bytes": "200", "max_files": "40", "max_total_bytes": "3000", "hidden": "true"}, {"max_depth": "3", "max_total_bytes": "0"}])
def test_tasks_list_what_the_driver_lists(spark, folder, options, most):
    found, pruned = tree.listing(folder, options)
    assert by_tasks(spark, folder, options, most) == ([(p.encode("utf-8", "surrogateescape"), size, state) for p, size, state in found], pruned)


def test_contents_equal_the_data_source(spark, folder):
    spark.dataSource.register(tree.SourceTree)
    source = spark.read.format("source_tree").option("path", folder).option("max_bytes", 2000).load()
    ours = tree.read_tree(spark, folder, max_bytes=2000)
    assert ours.schema == source.schema
    rows = sorted(map(tuple, ours.collect()))
    assert rows == sorted(map(tuple, source.collect())) and len(rows) > 70
    assert {r[3] for r in rows} == {"listed", "too-large", "unsafe-path"}


def test_empty_and_missing_trees(spark, folder, tmp_path):
    assert tree.read_tree(spark, str(tmp_path)).count() == 0 and tree.listed(spark, str(tmp_path), {})[1] == {}
    with pytest.raises(Exception, match="No such file"):
        tree.read_tree(spark, str(tmp_path / "gone"))
    with pytest.raises(ValueError, match="not a usable glob"):
        tree.read_tree(spark, folder, exclude="../x")


def test_no_part_of_a_path_is_followed(tmp_path):
    """A folder that became a link after it was listed gives nothing."""
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "out").mkdir()
    (tmp_path / "out/f").write_text("secret")
    (tmp_path / "in/sub/f").write_text("own")
    root = str(tmp_path / "in")
    assert tree.content_of(root, "sub/f", "listed", 10) == ("listed", b"own")
    os.rename(tmp_path / "in/sub", tmp_path / "in/old")
    os.symlink(tmp_path / "out", tmp_path / "in/sub")
    assert tree.content_of(root, "sub/f", "listed", 10) == ("unreadable", None)
    os.mkfifo(tmp_path / "in/pipe")
    assert tree.content_of(root, "pipe", "listed", 10) == ("unreadable", None)
    assert tree.content_of(root, "old/f", "listed", 2) == ("too-large", None)
