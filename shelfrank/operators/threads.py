"""Conversation threads: lookups, caps, windows and chat turns over an append-only message table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedup import first_by

#: Messages a thread may hold, and those that are read back.
MOST_MESSAGES, LAST_MESSAGES = 50, 12
#: What stands over products if nothing is said of them.
DEFAULT_CONTENT = "Here is what fits your request."


def first_of_thread(threads: DataFrame, thread_id: str, ordinal: str = "_ordinal") -> DataFrame:
    """The first stored document of a thread, of several that may share its id; none for an unknown one. A blank id is an
    error."""
    if not thread_id.strip():
        raise ValueError("a thread id is needed")
    return threads.where(F.col("thread_id") == thread_id).orderBy(ordinal).limit(1)


def by_id(rows: DataFrame, value, id_col: str = "_id") -> DataFrame:
    return rows.where(F.col(id_col) == value)


def first_documents(threads: DataFrame, ordinal: str = "_ordinal") -> DataFrame:
    return first_by(threads.withColumn("__thread", F.col("thread_id").cast("string")), F.col("__thread"), ordinal).drop("__thread")


def may_append(messages: DataFrame, most: int = MOST_MESSAGES) -> DataFrame:
    """(thread_id, n_messages, open): whether a thread takes another message."""
    return messages.groupBy("thread_id").agg(F.count("*").alias("n_messages")).withColumn("open", F.col("n_messages") < most)


def last_messages(messages: DataFrame, n: int = LAST_MESSAGES, thread: str = "thread_id", seq: str = "seq") -> DataFrame:
    """The last n messages of every thread. Each task keeps n a thread before the shuffle."""
    at = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(seq)))
    return messages.withColumn("__n", at).where(F.col("__n") <= n).drop("__n")


def last_elements(messages: Column, n: int = LAST_MESSAGES) -> Column:
    """The last n elements of an array, all of a shorter one."""
    return F.when(F.size(messages) <= n, messages).otherwise(F.slice(messages, -n, n))


def turns(messages: DataFrame) -> DataFrame:
    """messages as chat turns: products of a view are listed below its content; other types than the two are dropped."""
    listed = F.array_join(F.transform("products", lambda p: F.concat(F.lit("Product: "), F.coalesce(p["title"], F.lit("")), F.lit("\nVerdict: "), F.coalesce(p["verdict"], F.lit("")))), "\n\n")
    view = F.col("type") == "product-view"
    content = F.when(view, F.concat(F.col("content"), F.lit("\n\n"), F.coalesce(listed, F.lit("")))).otherwise(F.col("content"))
    known = messages.where(F.col("type").isin("text", "product-view"))
    return known.select("thread_id", "seq", F.when(view, F.lit("assistant")).otherwise(F.col("role")).alias("role"), content.alias("content"))


def product_view(ranked: DataFrame) -> Column:
    """One array of a ranked result's products, best first, for a message; ranked is at most a page of rows."""
    verdict = F.coalesce(F.col("verdict"), F.lit("")) if "verdict" in ranked.columns else F.lit("")
    one = F.struct("images", "specs", "title", "price", verdict.alias("verdict"), "link", "brand", "dbRecordId")
    at = F.struct((-F.col("totalWeightedScore")).alias("score"), F.col("_ordinal"))
    order = lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)  # noqa: E731  maps have no order
    return F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), one.alias("product"))), order), lambda s: s["product"])


def appended_turn(messages: DataFrame, thread_id: str, user: str, answer: str | None, products: list | None = None, now: Column | None = None, most: int = MOST_MESSAGES) -> DataFrame:
    """The two rows that a turn adds to a thread: the user's, then the assistant's (a view if it has products).

    A full thread, an empty id or a blank message is an error. The rows are appended to the table; nothing is rewritten.
    `Store.append` also keeps two writers apart.
    """
    if not thread_id.strip() or not user.strip():
        raise ValueError("a thread id and a message are needed")
    n = messages.where(F.col("thread_id") == thread_id).count()
    if n >= most:
        raise ValueError(f"a thread holds at most {most} messages")
    rows = [(thread_id, n, "text", "user", user, None), (thread_id, n + 1, "product-view" if products else "text", "assistant", (answer or DEFAULT_CONTENT) if products else answer, products or None)]
    kind = messages.schema["products"].dataType.simpleString()
    made = messages.sparkSession.createDataFrame(rows, f"thread_id string, seq bigint, type string, role string, content string, products {kind}")
    return made.withColumn("timestamp", F.current_timestamp() if now is None else now).select(*messages.columns)
