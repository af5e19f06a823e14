from unittest.mock import MagicMock

from corvane.streaming import incremental


def test_waits_for_the_whole_backlog(monkeypatch):
    stream = MagicMock()
    monkeypatch.setattr(incremental, "tainted_stream", lambda events: stream)
    incremental.run_once(MagicMock(), "in", None, "checkpoint", "out")
    (call,) = [c for c in stream.mock_calls if c[0].endswith("awaitTermination")]
    assert call.args == () and call.kwargs == {}
