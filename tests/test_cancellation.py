import threading
import time

import pytest

from corvane.functions.settings import Settings
from corvane.plans import report
from corvane.plans.report import scan_report
from corvane.plans.running import Cancellation, Cancelled
from corvane.sources.cache import ParseCache

LONG = "SELECT sum(sqrt(id) * sin(id)) FROM range(0, 1000000000000, 1, 8)"


def test_running_jobs_are_stopped_and_others_are_not(spark):
    asked, other, outcome = Cancellation(), Cancellation(), []

    def beside():
        with other.watching(spark):
            outcome.append(spark.sql("SELECT count(*) FROM range(0, 20000000000, 1, 4)").first()[0])

    thread = threading.Thread(target=beside)
    thread.start()
    threading.Timer(1.5, asked.cancel).start()
    began = time.time()
    with pytest.raises(Cancelled), asked.watching(spark):
        spark.sql(LONG).collect()
    assert time.time() - began < 30
    thread.join(120)
    assert outcome == [20_000_000_000]
    asked.cancel()
    with pytest.raises(Cancelled), asked.watching(spark):
        raise AssertionError("nothing begins once it was asked")
    with pytest.raises(KeyError), other.watching(spark):  # other failures are what they are
        raise KeyError
    assert spark.range(3).count() == 3


def test_a_cancelled_scan_leaves_its_cache_as_it_was(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_text("export function h(req) {\n  eval(req.query.q);\n}\n")
    cache, asked, stages = str(tmp_path / "cache"), Cancellation(), []

    def tell(stage):
        stages.append(stage)
        if stage == "parsing":
            asked.cancel()

    with pytest.raises(Cancelled):
        scan_report(spark, str(tmp_path / "src"), Settings(), cache=cache, progress=tell, cancellation=asked)
    assert stages == ["discovery", "parsing"]
    assert ParseCache(spark, cache, report.SCANNER_VERSION, report.RECORDS).entries().count() == 0

    def slow(*_):
        threading.Timer(1, again.cancel).start()
        spark.sql(LONG).collect()

    again = Cancellation()
    with monkeypatch.context() as m, pytest.raises(Cancelled):
        m.setattr(report, "candidates", slow)
        scan_report(spark, str(tmp_path / "src"), Settings(), cancellation=again)
    assert scan_report(spark, str(tmp_path / "src"), Settings(), cache=cache).findings.count() == 1
