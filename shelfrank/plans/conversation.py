"""A turn of a conversation: what is known of its thread decides whether products are recommended or talked about."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import threads
from ..operators.store import Store
from . import planner, recommend

#: Fixed value: products that a follow-up question is answered from.
TOLD_PRODUCTS = 8


class AnswerProvider(Protocol):
    def __call__(self, context: list[dict]) -> str: ...


@dataclass
class Reply:
    """What is said, and the products that were recommended with it."""

    said: str
    products: list[dict]


def product_json(fields: list[str] | None = None) -> Column:
    """A ranked product as JSON, scores by category included; fields: its columns, by default a reader's choice of them."""
    return F.to_json(F.struct(*(fields or ["title", "brand", "price", "link", "specs", "totalWeightedScore"])), {"ignoreNullFields": "false"})


def context(products: list[dict], query: str, history: DataFrame, message: str) -> list[dict]:
    """What a follow-up question is answered from: the best products and the query that found them, the last turns of the
    thread, the message. history: a thread's messages, of which the last few are read."""
    known = {"query": query, "products": products[:TOLD_PRODUCTS]}
    turns = threads.turns(threads.last_messages(history)).orderBy("seq").collect()  # a window
    return [{"role": "system", "content": json.dumps(known)}, *({"role": t["role"], "content": t["content"]} for t in turns), {"role": "user", "content": message}]


def named_product(context: list[dict]) -> str:
    """The default AnswerProvider: the product that the message names, else the best one."""
    products, message = json.loads(context[0]["content"])["products"], context[-1]["content"].lower()
    chosen = next((p for p in products if (p.get("title") or "").lower() in message), products[0])
    verdict = f" {chosen['verdict']}" if chosen.get("verdict") else ""
    return f"{chosen['title']} costs {chosen['price']}.{verdict}"


def reply(store: Store, devices: DataFrame, thread_id: str, message: str, answer: AnswerProvider = named_product, **how) -> Reply:
    """Takes a message into a thread, makes one if there is none, and stores the turn.

    A thread with products and a query is talked about; in any other the message is taken for a request, whose answer is
    products, or questions where they are needed, nothing is found or the request can't be read. A blank id or message,
    a full thread, and another writer at work on the same turn are errors. how: goes to `recommend`.
    """
    if not thread_id.strip() or not message.strip():
        raise ValueError("a thread id and a message are needed")
    document = store.found_or_inserted(thread_id, message)
    own, products = document["_id"], json.loads(document["products"] or "[]")
    history = store.messages(own).drop("part")
    stored = history.count()
    if stored >= threads.MOST_MESSAGES:
        raise ValueError(f"a thread holds at most {threads.MOST_MESSAGES} messages")
    lease = store.lease(own, stored)  # before the answer, which others needn't look for at the same time
    try:
        said = _answered(document["query"], products, history, devices, message, answer, **how)
        shown = [(p["title"], p["verdict"], p["price"], p["link"], p["brand"], p["dbRecordId"], p["images"]) for p in said.products]
        store.append(own, message, said.said, shown or None, lease=lease)
    except Exception:
        store.release(lease)
        raise
    return said


def _answered(query: str | None, products: list[dict], history: DataFrame, devices: DataFrame, message: str, answer: AnswerProvider, **how) -> Reply:
    view = history.where("type = 'product-view'").orderBy(F.desc("seq")).first()
    known = [p.asDict(recursive=True) for p in view["products"]] if view else products
    if known and query:
        return Reply(answer(context(known, query, history, message)), [])
    found = recommend.recommend(devices, message, **how)
    rows = [] if found.ranked is None else [r.asDict(recursive=True) for r in recommend.with_verdicts(found).collect()]  # a page
    questions = found.questions or planner.BLANK_QUESTIONS
    return Reply(threads.DEFAULT_CONTENT, rows) if rows else Reply("\n".join(questions), [])
