"""A live service as a Python data source: paced, with bounded retries, failures as rows.

One partition asks one service, as a pace holds for a whole service and partitions do not know of each
other. The client is any importable callable `module:name` that takes a key and returns a JSON string,
None for what does not exist, or raises; TransientError asks for another attempt.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class TransientError(Exception):
    """A failure that may pass: time-outs, broken connections, rate limits. `wait` replaces the backoff."""

    def __init__(self, message: str = "", wait: float | None = None):
        super().__init__(message)
        self.wait = wait


class Pace:
    """At least `interval` seconds between grants."""

    def __init__(self, interval: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.interval, self.clock, self.sleep, self.last = interval, clock, sleep, None

    def wait(self) -> None:
        now = self.clock()
        if self.last is not None and (left := self.last + self.interval - now) > 0:
            self.sleep(left)
            now += left
        self.last = now


def fetch(key: str, client: Callable[[str], str | None], pace: Pace, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> tuple[str, str, int, str | None, str | None]:
    """(key, status, attempts used, body, error); status is ok, missing or failed. No wait after the last attempt."""
    for attempt in range(1, attempts + 1):
        pace.wait()
        try:
            body = client(key)
            return key, "missing" if body is None else "ok", attempt, body, None
        except TransientError as e:
            error = str(e) or type(e).__name__
            if attempt < attempts:
                sleep(2.0**attempt if e.wait is None else e.wait)
        except Exception as e:  # noqa: BLE001  any other failure is this key's result
            return key, "failed", attempt, None, str(e) or type(e).__name__
    return key, "failed", attempts, None, error


class _Keys(InputPartition):
    def __init__(self, keys: list[str]):
        super().__init__(0)
        self.keys = keys


class LiveSource(DataSource):
    """spark.dataSource.register(LiveSource); spark.read.format("paced_service").options(client=, keys=, interval=)."""

    @classmethod
    def name(cls) -> str:
        return "paced_service"

    def schema(self) -> str:
        return "key string, status string, attempts int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return LiveReader(self.options)


class LiveReader(DataSourceReader):
    def __init__(self, options):
        self.client, self.keys = options["client"], [k for k in options.get("keys", "").split(",") if k]
        self.interval, self.attempts, self.stop_after = float(options.get("interval", 1.0)), int(options.get("attempts", 4)), int(options.get("stop_after", 20))

    def partitions(self) -> list[InputPartition]:
        return [_Keys(self.keys)]

    def read(self, partition: _Keys) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        client, pace, failed = getattr(importlib.import_module(module), name), Pace(self.interval), 0
        for key in partition.keys:
            if failed >= self.stop_after:  # an outage: the rest is left for the next run
                yield key, "failed", 0, None, "not asked after repeated failures"
                continue
            row = fetch(key, client, pace, self.attempts)
            failed = failed + 1 if row[1] == "failed" else 0
            yield row
