"""Ending a scan from elsewhere: its jobs carry a tag, and no others are stopped."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

#: Seconds between two calls to stop a scan's jobs, as it may begin another one between them.
AGAIN = 0.2


class Cancelled(Exception):
    """The scan was asked to end. There is no part of a report."""


class Cancellation:
    """Asks what runs under it to end; from any thread, and more than once. One may watch several scans."""

    def __init__(self):
        self._asked = threading.Event()

    def cancel(self) -> None:
        self._asked.set()

    @property
    def cancelled(self) -> bool:
        return self._asked.is_set()

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("scan cancelled")

    @contextlib.contextmanager
    def watching(self, spark: SparkSession) -> Iterator[None]:
        """Jobs that this thread begins within are stopped once it is asked; their failure is then Cancelled. Tables that were cut short count for nothing."""
        self.check()
        context, tag, over = spark.sparkContext, f"corvane-{uuid.uuid4().hex}", threading.Event()

        def stop() -> None:
            while not over.is_set():
                if self._asked.wait(AGAIN):
                    context.cancelJobsWithTag(tag)
                    over.wait(AGAIN)

        watcher = threading.Thread(target=stop, daemon=True)
        context.addJobTag(tag)
        watcher.start()
        try:
            yield
            self.check()
        except Exception as error:
            if self.cancelled and not isinstance(error, Cancelled):
                raise Cancelled("scan cancelled") from error
            raise
        finally:
            over.set()
            context.removeJobTag(tag)
