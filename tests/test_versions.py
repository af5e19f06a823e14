import pytest
from pyspark.sql import functions as F

from corvane.plans.fixpoint import RECORDS
from corvane.plans.frontend import SAMPLES, records_of
from corvane.sources import cache, tree, versions
from corvane.sources.cache import ParseCache


@pytest.fixture
def files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for name, body in SAMPLES.items():
        (tmp_path / "src" / name).write_text(body)
    return tree.read_tree(spark, str(tmp_path / "src")).cache()


def stored(store, files):
    store.store(files, records_of(files))


def known(store, files):
    hits, missing = store.split(files)
    assert hits.select("path").distinct().join(missing.select("path"), "path").count() == 0
    return sorted(r.path for r in files.join(missing.select("path"), "path", "left_anti").collect())


def gone(*_):
    raise RuntimeError("the driver went")


def test_a_crash_before_the_log_changes_nothing(spark, files, tmp_path, monkeypatch):
    store = ParseCache(spark, str(tmp_path / "c"), "1", RECORDS)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ParseCache, "_log", gone)
        stored(store, files)
    assert store.entries().count() == 0 and known(store, files) == []
    stored(store, files)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(ParseCache, "_log", gone)
        store.evict(1)
    assert store.entries().count() == 5 and known(store, files) == sorted(SAMPLES)
    monkeypatch.setattr(versions, "GRACE_SECONDS", -1)
    store.sweep()  # folders that were never named go
    assert len(list((tmp_path / "c").glob("v-*"))) == 1 and known(store, files) == sorted(SAMPLES)
    assert store.evict(1).count() == 0 and known(store, files) == [] and len(list((tmp_path / "c").glob("v-*"))) == 1
    assert len([p for p in (tmp_path / "c" / "log").iterdir() if p.name.isdigit()]) == 1


def test_small_versions_become_one(spark, files, tmp_path, monkeypatch):
    monkeypatch.setattr(cache, "MOST_VERSIONS", 2)
    store = ParseCache(spark, str(tmp_path / "c"), "1", RECORDS)
    for i, name in enumerate(sorted(SAMPLES)):
        stored(store, files.filter(F.col("path") == name))
        stored(store, files.filter(F.col("path") == name))  # two scans of the same file
        assert known(store, files) == sorted(SAMPLES)[: i + 1] and len(store.versions()) <= 2
    hits, _ = store.split(files)
    every = records_of(files)
    assert sorted(map(str, hits.select(*every.columns).collect())) == sorted(map(str, every.collect()))


def test_readers_of_a_replaced_version_go_on(spark, files, tmp_path):
    store = ParseCache(spark, str(tmp_path / "c"), "1", RECORDS)
    stored(store, files)
    hits, _ = store.split(files)  # not read yet
    store.evict(1)
    assert hits.count() == records_of(files).count() and known(store, files) == []
