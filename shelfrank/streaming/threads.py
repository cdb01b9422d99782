"""Messages that arrive as a stream, appended to their threads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.threads import MOST_MESSAGES

#: What decides the order of messages of one batch; rows alike in all of it are interchangeable.
ORDER = ["arrived", "role", "content"]


def numbered(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """A stream of (thread_id, arrived, role, content) with seq, which goes on from each thread's earlier messages, and
    open: whether the thread had room. What finds none has no seq.

    How many messages a thread has is the operator's state, so nothing stored is read again; a batch that is run again
    starts from the same state and gives the same numbers. A task holds no more of a thread's batch than there is room for.
    """
    out = messages.withColumn("seq", F.lit(None).cast("long")).withColumn("open", F.lit(False)).schema

    def number(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored = state.get[0] if state.exists else 0
        held, room = None, max(0, most - stored)
        for batch in batches:
            rows = (batch if held is None else pd.concat([held, batch])).sort_values(ORDER, kind="stable")
            held, over = rows.iloc[:room], rows.iloc[room:]
            if len(over):
                yield over.assign(seq=pd.array([None] * len(over), "Int64"), open=False)
        if held is not None and len(held):
            yield held.assign(seq=pd.array(range(stored, stored + len(held)), "Int64"), open=True)
            stored += len(held)
        state.update((stored,))

    return messages.groupBy("thread_id").applyInPandasWithState(number, out, "stored long", "append", GroupStateTimeout.NoTimeout)


def _exists(messages: DataFrame, place: str) -> bool:
    spark = messages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def append_stream(messages: DataFrame, path: str, checkpoint: str, most: int = MOST_MESSAGES, every: str | None = None) -> StreamingQuery:
    """Appends a stream of (thread_id, arrived, role, content) to the table at path; what finds its thread full goes to
    path-rejected. A batch that is run again overwrites its own part, so each message is stored once.

    The checkpoint holds the threads' counts, so a table belongs to the stream that began it: one that is there without
    its checkpoint is an error.
    """
    if _exists(messages, path) and not _exists(messages, checkpoint):
        raise ValueError(f"{path} was begun by a stream with another checkpoint")

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        rows.where("open").drop("open").write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows.where("not open").drop("open").write.mode("overwrite").parquet(f"{path}-rejected/batch={number}")
        rows.unpersist()

    writer = numbered(messages, most).writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
