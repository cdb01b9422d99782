"""The elements of JSON arrays of any size, one array a file, read by many tasks.

Spark's text reader splits a file at a byte that JSON knows, "}", instead of at lines: what lies between two of them is a
row, whatever blanks the file has. A row tells neither whether it starts inside a string nor how deep it lies, so the first
pass makes a transition of each split: how it moves both, from outside a string and from inside one, and how many commas it
has at each depth, counted from its own start. Transitions compose, so running sums over a file's splits, a row each, give
every split its true start and the place of its first element. The second pass then cuts each split at the commas of
the outermost array. An element that a split's end cuts comes in pieces, which alone are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_QUOTE, _COMMA, _OPEN, _CLOSE = ord('"'), ord(","), ord("["), ord("]")
#: How a byte outside strings changes the depth, and which bytes matter at all.
_DELTA = np.zeros(256, np.int64)
_DELTA[[ord("{"), _OPEN]], _DELTA[[ord("}"), _CLOSE]] = 1, -1
_MARK = _DELTA != 0
_MARK[[_QUOTE, _COMMA]] = True
_ESCAPE = re.compile(rb"\\.", re.S)

_TRANSITION = "file bigint, start bigint, flip int, base int, d0 bigint, d1 bigint, c0 map<bigint, bigint>, c1 map<bigint, bigint>"


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): what lies before each "}", in order within a split, which starts at a byte of a file."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """(key, text) for each run of rows of one split; key: the columns beside the text. A split can have several runs. The
    separators are put back; the one too many at a file's end stands behind its value."""
    for batch in batches:
        names = [n for n in batch.schema.names if n != "value"]
        keys = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        file, start = keys[:2]
        ends = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        texts = batch.column("value").cast(pa.binary())
        for a, b in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            if b > a:
                yield tuple(int(k[a]) for k in keys), b"}".join(texts.slice(a, b - a).to_pylist()) + b"}"


def _marks(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bytes, quotes before and at each) of what matters. Escaped characters are blanked; no escape ends in "}"."""
    plain = np.frombuffer(_ESCAPE.sub(b"  ", text) if b"\\" in text else text, np.uint8)
    at = np.flatnonzero(_MARK[plain])
    return at, plain[at], np.cumsum(plain[at] == _QUOTE)


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: see _TRANSITION. base: the depth of a file's elements, known where it starts."""
    found: dict[tuple, dict] = {}
    for key, text in _splits(batches):
        own = found.setdefault(key, {"flip": 0, "base": None, "d": [0, 0], "c": [{}, {}]})
        if key[1] == 0 and own["base"] is None and (head := text.lstrip(b"\xef\xbb\xbf \t\r\n")):
            own["base"] = int(head[:1] != b"{")
        _, kind, quotes = _marks(text)
        for h in (0, 1):  # started outside a string, or inside
            out = (quotes + own["flip"] + h) % 2 == 0
            depth = own["d"][h] + np.cumsum(_DELTA[kind] * out)
            levels, counts = np.unique(depth[(kind == _COMMA) & out], return_counts=True)
            for level, n in zip(levels.tolist(), counts.tolist(), strict=True):
                own["c"][h][level] = own["c"][h].get(level, 0) + n
            own["d"][h] = int(depth[-1]) if len(depth) else own["d"][h]
        own["flip"] = int(own["flip"] + (quotes[-1] if len(quotes) else 0)) % 2
    rows = [{"file": f, "start": s, "flip": v["flip"], "base": v["base"], "d0": v["d"][0], "d1": v["d"][1], "c0": list(v["c"][0].items()), "c1": list(v["c"][1].items())} for (f, s), v in found.items()]
    counts = pa.map_(pa.int64(), pa.int64())
    kinds = [("file", pa.int64()), ("start", pa.int64()), ("flip", pa.int32()), ("base", pa.int32()), ("d0", pa.int64()), ("d1", pa.int64()), ("c0", counts), ("c1", counts)]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, base, inside, depth, first): how each split starts: whether inside a string, how deep, and with which
    element of its file. Depths are counted from the file's start. One row a split is all that is gathered of a file."""
    moves = _rows(spark, path).mapInArrow(_transitions, _TRANSITION)
    whole = Window.partitionBy("file").orderBy("start")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda x: F.coalesce(F.sum(x).over(before), F.lit(0))
    based = moves.withColumn("base", F.coalesce(F.first("base", ignorenulls=True).over(whole), F.lit(1)))
    sided = based.withColumn("inside", (so_far(F.col("flip")) % 2).cast("int"))
    outside = F.col("inside") == 0
    deep = sided.withColumn("depth", so_far(F.when(outside, F.col("d0")).otherwise(F.col("d1"))))
    commas = F.coalesce(F.try_element_at(F.when(outside, F.col("c0")).otherwise(F.col("c1")), F.col("base") - F.col("depth")), F.lit(0))
    placed = deep.withColumn("first", so_far(F.when(F.col("base") > 0, commas).otherwise(0)))
    return placed.select("file", "start", "base", "inside", "depth", "first")


def _cut(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """(file, place, part, value): the elements that lie in one split, or the pieces of those that don't."""
    now, state, out = None, None, {"file": [], "place": [], "part": [], "value": []}

    def give(value: bytes, is_whole: bool) -> None:
        if is_whole == whole and (not whole or value.strip()):
            for name, x in zip(out, (now[0], state["place"], now[1], value), strict=True):
                out[name].append(x)

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(out["file"], pa.int64()), pa.array(out["place"], pa.int64()), pa.array(out["part"], pa.int64()), pa.array(out["value"], pa.binary()).cast(pa.string())], names=list(out))
        for values in out.values():
            values.clear()
        return made

    def ended() -> None:
        """What is open at a split's end goes on in the next."""
        if now is not None and state["within"]:
            give(b"".join(state["held"]), False)

    for (file, start, base, inside, depth, first), text in _splits(batches):
        if (file, start) != now:
            ended()
            # within: between an array's brackets, or before a lone object's end; cut: whether the element began in an earlier split.
            now, state = (file, start), {"place": first, "inside": inside, "depth": depth, "within": depth >= base and (start == 0 or depth > 0 or inside), "cut": start > 0, "held": []}
            if start == 0 and text.startswith(b"\xef\xbb\xbf"):
                text = text[3:]
        at, kind, quotes = _marks(text)
        out_of = (quotes + state["inside"]) % 2 == 0
        deep = state["depth"] + np.cumsum(_DELTA[kind] * out_of)
        opens = out_of & (kind == _OPEN) & (deep == 1) if base else np.zeros(len(at), bool)
        closes = out_of & (_DELTA[kind] < 0) & (deep == 0)
        commas = out_of & (kind == _COMMA) & (deep == base) if base else np.zeros(len(at), bool)
        since = 0
        for k in np.flatnonzero(opens | closes | commas):
            here = int(at[k])
            if opens[k] and not state["within"]:
                state |= {"within": True, "cut": False, "held": []}
            elif state["within"]:
                end = here if base else here + 1
                give(b"".join([*state["held"], text[since:end]]), not state["cut"])
                state |= {"place": state["place"] + 1, "cut": False, "held": [], "within": bool(commas[k])}
            since = here + 1
        if state["within"]:
            state["held"].append(text[since:])
        state["inside"] = int(state["inside"] + (quotes[-1] if len(quotes) else 0)) % 2
        state["depth"] = int(deep[-1]) if len(deep) else state["depth"]
        if len(out["value"]) >= 1024:
            yield batch()
    ended()
    yield batch()


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): the elements of each file's array as JSON texts, file being the xxhash64 of its path and place
    the element's in its array. A file that holds one object instead of an array has it for its only element. Blank
    elements, of an empty array or after a last comma, are none. Files are read by as many tasks as they have splits; only
    elements that a split's end cuts are shuffled. Compressed files can't be split and are a task each.

    What is broadcast is a row of 40 bytes for each split, a third of a byte a megabyte at the usual size of splits.
    """
    states = F.broadcast(split_states(spark, path))
    # A broadcast join keeps the rows of a split in order, where they were read.
    rows = _rows(spark, path).join(states, ["file", "start"]).select("value", "file", "start", "base", "inside", "depth", "first")
    kind = "file bigint, place bigint, part bigint, value string"
    whole = rows.mapInArrow(lambda batches: _cut(batches, True), kind).select("file", "place", "value")
    pieces = rows.mapInArrow(lambda batches: _cut(batches, False), kind)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "value"))), lambda s: s["value"])  # one element's
    joined = pieces.groupBy("file", "place").agg(F.array_join(listed, "").alias("value"))
    return whole.union(joined.where(~F.col("value").rlike(r"^\s*$")))
