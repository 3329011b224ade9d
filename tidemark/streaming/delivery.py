"""Live tails and at-least-once delivery with Structured Streaming."""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.model import SUBSCRIBER_QUEUE, EngineConfig
from tidemark.operators import hub, log


class Rejected(Exception):
    """The sink will never take this batch."""


class Transient(Exception):
    """The sink may take it later."""


class OutOfTime(Exception):
    """The time for the final drain is over."""


def classify_status(status: int | None) -> str:
    """ok, permanent or transient."""
    if status is None:
        return "transient"
    if 200 <= status <= 299:
        return "ok"
    return "permanent" if 400 <= status <= 499 and status not in (408, 429) else "transient"


def next_backoff(current: float, initial: float, most: float, rng: random.Random) -> float:
    """Decorrelated jitter: uniform between the initial delay and three times the current one, at most ``most``."""
    initial = initial if initial > 0 else 0.02
    most = max(most, initial)
    return min(most, max(initial, rng.uniform(initial, max(initial, 3 * min(current if current > 0 else initial, most)))))


def http_sink(url: str, opener=urllib.request.urlopen) -> Callable[[list[str], float], None]:
    """Posts a batch as a JSON array."""

    def deliver(items: list[str], timeout: float) -> None:
        request = urllib.request.Request(url, ("[" + ",".join(items) + "]").encode(), {"Content-Type": "application/json"})
        try:
            with opener(request, timeout=timeout) as answer:
                kind = classify_status(answer.status)
        except urllib.error.HTTPError as e:
            kind = classify_status(e.code)
        except OSError as e:
            raise Transient(str(e)) from e
        if kind == "permanent":
            raise Rejected(url)
        if kind == "transient":
            raise Transient(url)

    return deliver


def console_sink(items: list[str], timeout: float) -> None:
    """The sink without a url: prints and counts as delivered."""
    for item in items:
        print(json.loads(item))


@dataclass
class Dispatcher:
    """Delivers micro-batches in order of offset, at most ``config.batch_size`` records at a time.

    ``on_commit`` is told the next offset after each batch that was taken or rejected.  Within a streaming query a
    micro-batch counts as done only when all of its batches are, so a crash repeats it.  Rejected batches are counted
    and passed over; ``rejects`` has the offsets of the last 10,000 rejected records, an extension.  Anything else the
    sink raises is tried again after a growing delay, ``max_attempts`` times (0: for ever), until ``until``
    (``time.monotonic``), if given.
    """

    sink: Callable[[list[str], float], None]
    config: EngineConfig = field(default_factory=EngineConfig)
    max_attempts: int = 0
    sleep: Callable[[float], None] = time.sleep
    rng: random.Random = field(default_factory=random.Random)
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("delivered", "committed", "delivery_attempts", "retries", "sink_errors", "permanent_rejections", "corrupt_skips"), 0))
    rejects: deque[int] = field(default_factory=lambda: deque(maxlen=10_000))
    on_commit: Callable[[int], None] | None = None
    until: float | None = None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """``foreachBatch`` function over records (offset, id, ts_nanos, topic, payload, crc_ok)."""
        rows = batch.persist()
        try:
            ends = rows.agg(F.count_if(~F.col("crc_ok")).alias("bad"), F.max("offset").alias("last")).first()
            bad = ends["bad"]
            self.counters["corrupt_skips"] += bad
            self.counters["committed"] += bad
            good = rows.where("crc_ok")
            held: list = []
            # the stream's order is the contract, so one ordered iterator feeds the sink; Spark holds a partition at a time
            for r in log.sink_rows(good).orderBy("offset").toLocalIterator():
                if held and (len(held) >= self.config.batch_size or r["offset"] != held[-1]["offset"] + 1):
                    self._send(held)
                    held = []
                held.append(r)
            if held:
                self._send(held)
            if bad and self.on_commit:  # a corrupt record may be the last
                self.on_commit(ends["last"] + 1)
        finally:
            rows.unpersist()

    def _send(self, rows: list) -> None:
        delay, tries = self.config.initial_backoff_s, 0
        while True:
            if self.until is not None and time.monotonic() >= self.until:
                raise OutOfTime
            self.counters["delivery_attempts"] += 1
            tries += 1
            try:
                self.sink([r["item"] for r in rows], self.config.delivery_timeout_s)
            except Rejected:
                self.counters["sink_errors"] += 1
                self.counters["permanent_rejections"] += 1
                self.rejects += [r["offset"] for r in rows]
                break
            except Exception:  # whatever isn't a rejection may pass
                self.counters["sink_errors"] += 1
                self.counters["retries"] += 1
                if self.max_attempts and tries >= self.max_attempts:
                    raise
                delay = next_backoff(delay, self.config.initial_backoff_s, self.config.max_backoff_s, self.rng)
                self.sleep(delay)
            else:
                self.counters["delivered"] += len(rows)
                break
        self.counters["committed"] += len(rows)
        if self.on_commit:
            self.on_commit(rows[-1]["offset"] + 1)


def deliver(records: DataFrame, dispatcher: Dispatcher, checkpoint: str, until_drained: bool = True) -> StreamingQuery:
    """Start delivery of a stream of records; ``until_drained`` is the flush barrier: stop when all is delivered."""
    writer = records.writeStream.foreachBatch(dispatcher).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if until_drained else {"processingTime": f"{max(dispatcher.config.flush_interval_s, 0.001)} seconds"}
    return writer.trigger(**trigger).start()


def live_tail(entries: DataFrame, service: str = "", level: str = "") -> DataFrame:
    """What one subscriber sees of a stream of entries."""
    return hub.live_filter(entries, service, level)


def fan_out(subscribers: dict[str, tuple[str, str]], give: Callable[[str, list], None], then: Callable[[DataFrame, int], None] | None = None, queue: int = SUBSCRIBER_QUEUE, dropped: Callable[[str, int], None] | None = None):
    """``foreachBatch`` function: first ``then`` (such as the append to a table), and only if it succeeded every
    subscriber (name -> (service, level)) is given its matching rows: the first ``queue`` of the micro-batch, as a
    bounded subscriber's queue holds them.  ``dropped`` is told how many were beyond."""

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            if then is not None:
                then(rows, batch_id)
            for name, (service, level) in subscribers.items():
                matching = hub.live_filter(rows, service, level)
                got = matching.orderBy("offset").limit(queue).collect()
                give(name, got)
                if dropped is not None and len(got) == queue:
                    dropped(name, matching.count() - queue)
        finally:
            rows.unpersist()

    return each


def event_rates(entries: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Extension: events per topic and event-time window, with a watermark."""
    timed = entries.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "topic").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "topic", "n")
