"""Windows of a stream: against the stored table after each batch, and their end."""

import random
import time

import pytest
from pyspark.sql import functions as F

from shelfrank.operators import threads
from shelfrank.streaming import windows

KIND = "thread_id string, arrived timestamp, role string, content string"


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, windows.PROVIDER)
    yield
    spark.conf.set(name, before)


def add(spark, place, rows):
    spark.createDataFrame(rows, "thread_id string, arrived string, role string, content string").withColumn("arrived", F.to_timestamp("arrived")).repartition(3).write.mode("append").parquet(place)


def run(spark, tmp_path, **how):
    """The windows that the stream's next batch gives."""
    out = []
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    writer = windows.last_windows(stream, **how).writeStream.outputMode("update").foreachBatch(lambda df, _: out.extend(df.collect()))
    assert writer.option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination(60)
    return {r["thread_id"]: (r["n_messages"], [(m["seq"], m["content"]) for m in r["window"]]) for r in out}


def test_windows_equal_the_last_messages_of_the_table(spark, tmp_path):
    rng, stored = random.Random(2), []
    for k in range(3):
        rows = [(rng.choice(["a", "b", "c", f"t{k}"]), f"2024-01-0{k + 1} 00:{i // 60:02}:{i % 60:02}", "user", f"m{k}-{i}") for i in range(60)]
        rows += [("long", f"2024-01-0{k + 1} 01:{i // 60:02}:{i % 60:02}", "user", f"l{k}-{i:03}") for i in range(150)]
        add(spark, str(tmp_path / "in"), rows)
        stored += [(t, at, c) for t, at, _, c in rows]
        found = run(spark, tmp_path, n=5)
        table = spark.createDataFrame([(t, at, c) for t, at, c in stored], "thread_id string, at string, content string")
        wanted = {}
        for r in threads.last_messages(table.selectExpr("thread_id", "content", "struct(at, content) AS seq"), 5).orderBy("seq").collect():
            wanted.setdefault(r["thread_id"], []).append(r["content"])
        assert {t: [c for _, c in w] for t, (_, w) in found.items()} == {t: w for t, w in wanted.items() if any(row[0] == t for row in rows)}
        assert all(n == sum(s[0] == t for s in stored) and [q for q, _ in w] == list(range(n - len(w), n)) for t, (n, w) in found.items())
        state = {}
        for r in windows.stored_windows(spark, str(tmp_path / "ck")).orderBy("seq").collect():
            state.setdefault(r["thread_id"], []).append(r["content"])
        assert state == wanted  # the state is the window of every thread, also of those without new messages


def test_expired_threads_leave_the_state(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("old", "2024-01-01 00:00:00", "user", "one"), ("old", "2024-01-01 00:00:01", "user", "two")])
    assert run(spark, tmp_path, n=3, seconds=12.0) == {"old": (2, [(0, "one"), (1, "two")])}
    time.sleep(13)
    add(spark, str(tmp_path / "in"), [("new", "2024-01-02 00:00:00", "user", "x")])
    assert run(spark, tmp_path, n=3, seconds=12.0) == {"new": (1, [(0, "x")])}
    left = windows.stored_windows(spark, str(tmp_path / "ck")).select("thread_id").distinct().collect()
    assert [r[0] for r in left] == ["new"]
    add(spark, str(tmp_path / "in"), [("old", "2024-01-03 00:00:00", "user", "again")])
    assert run(spark, tmp_path, n=3, seconds=12.0)["old"] == (1, [(0, "again")])
