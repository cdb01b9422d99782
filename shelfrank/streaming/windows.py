"""The last messages of threads, kept as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.threads import LAST_MESSAGES
from .threads import ORDER

_MESSAGE = "seq bigint, arrived timestamp, role string, content string"
#: State is kept by RocksDB, as time to live asks for.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Ring(StatefulProcessor):
    """A thread's last messages and how many it has had. Both leave the state when nothing has come for `seconds`."""

    def __init__(self, n: int, seconds: float | None):
        self.n, self.live = n, None if seconds is None else int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _MESSAGE, self.live)
        self.many = handle.getValueState("many", "n bigint", self.live)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        many = self.many.get()[0] if self.many.exists() else 0
        last: list[tuple] = []
        order = lambda r: tuple((r[c] is not None, r[c]) for c in ORDER)
        for k, row in enumerate(rows, 1):
            last.append(tuple(row[c] for c in ("arrived", "role", "content")))
            if k % (8 * self.n) == 0:  # a thread's batch may be long, what is held of it isn't
                last = sorted(last, key=lambda r: order(dict(zip(ORDER, r, strict=True))))[-self.n :]
        last = sorted(last, key=lambda r: order(dict(zip(ORDER, r, strict=True))))[-self.n :]
        total = many + k
        made = [(total - len(last) + i, *r) for i, r in enumerate(last)]
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        window = [*held, *made][-self.n :]
        self.ring.put(window)
        self.many.update((total,))
        yield Row(thread_id=key[0], n_messages=total, window=[(s, role, content) for s, _, role, content in window])

    def close(self) -> None:
        pass


def last_windows(messages: DataFrame, n: int = LAST_MESSAGES, seconds: float | None = None) -> DataFrame:
    """(thread_id, n_messages, window): after each batch of a stream of (thread_id, arrived, role, content), the last n
    messages of every thread that the batch has messages of, in order, numbered from the thread's first on.

    A thread's window is the operator's state, so nothing stored is read again. Messages of one batch are ordered by time,
    role and content; batches by their numbers. seconds: after so long without a message a thread leaves the state, and
    begins anew with its next one. Such a stream looks for what has ended in batches without data too, so it runs all the
    time or a batch at once; "available now" would never be over. The session has to keep state by PROVIDER.
    """
    out = "thread_id string, n_messages bigint, window array<struct<seq: bigint, role: string, content: string>>"
    typed = messages.select(F.col("thread_id").cast("string").alias("thread_id"), "arrived", "role", "content")
    return typed.groupBy("thread_id").transformWithState(Ring(n, seconds), out, "Update", "processingTime" if seconds is not None else "none")


def stored_windows(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """(thread_id, seq, arrived, role, content): the windows that a stream's state holds after its last batch, or after
    another one that its checkpoint still has, as a table."""
    reader = spark.read.format("statestore").option("stateVarName", "ring")
    rows = (reader if batch is None else reader.option("batchId", batch)).load(checkpoint)
    return rows.select("key.thread_id", "list_element.*")
