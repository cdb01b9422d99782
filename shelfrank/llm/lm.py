"""Language-model scores from a log-frequency Bloom filter.

Counts of words, of word pairs and, if asked for, of word triples are quantised to powers of two: an event seen c times has
level 1 + floor(log2 c), and the filter holds (event, 1), ..., (event, level). A level is read back by probing upwards until
a probe fails; its count is the middle of the level's range. Probabilities are smoothed towards those of shorter histories:

    P(w)       = (c(w) + 0.5) / (N + 0.5 * (V + 1))
    P(w | v)   = (c(v w) + mus[0] * P(w)) / (c(v) + mus[0])
    P(w | u v) = (c(u v w) + mus[1] * P(w | v)) / (c(u v) + mus[1])

with counts as the filter gives them, and none above that of its history. As many masses as are given, so long are the
histories. The text's start stands before its first word; each text ends with one end token.

Counting: each task sums its own events in arrays and sends packed blocks to the owners of the segments of the hash
space; an owner adds them up, keeps the words' exact counts and fills the segment's part of the filter. Segments are as
many as the training text's size asks for. Where there are more than BLOCKS of them, blocks go by way of groups of
segments, in which the blocks of ROUTED_TASKS tasks are added up first: blocks are then as many as tasks times segments
over ROUTED_TASKS, which still grows faster than the input, so many times later. A frequent event is one entry a task, so
no key is hot. Events go by 64-bit hashes; words are never gathered.

The segments are broadcast as long as they fit in BROADCAST_BYTES together. A larger model can't be in every worker's
memory; its segments stay where they are: each run of texts sends its distinct events to the segments' owners, who probe
their part of the filter, and gets counts and levels back, in two shuffles of packed blocks. An owner holds one segment and
goes through what is asked of it batch by batch, however much that is. The commonest events, which every run would ask
for, are answered from a broadcast table of COMMON_EVENTS events a kind at the most. What grows with the model is the
number of blocks: the more segments, the fewer events of a run go to the same one, down to a row for each event (26 events
a row with 4,096 segments, 1.2 with 400,000). Scores are the same on both ways.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import Shared, carried, crc_fold, pieces, space_words, staged, texts_of

#: Smoothing masses of pairs, and of pairs and triples. Triples predict better, and ask for twice the room.
MUS, TRIPLE_MUS = (1000.0,), (1000.0, 20.0)
BITS_PER_ENTRY, PROBES = 8, 5
#: Of filter and word counts, broadcast at once.
BROADCAST_BYTES = 160 << 20
#: Segments at the least, and training text for each, so that a segment's size doesn't follow the input's.
SEGMENTS, SEGMENT_BYTES = 64, 16 << 20
#: Blocks of a kind that a task sends at once, and the tasks whose blocks for a group of segments are added up together.
BLOCKS, ROUTED_TASKS = 4096, 64
#: Events of a kind that are answered from a broadcast table, at the most, where the model itself is too large for one.
COMMON_EVENTS = 400_000
#: Distinct events that a task sums before it sends them on.
KEPT_EVENTS = 1_500_000
START, END = b" start", b""  # neither can be a word
_HASH = partial(xxhash.xxh64_digest, seed=0)
_U = np.uint64


def token_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and where each text's tokens begin (one more at the end)."""
    packed, sizes = [], [0]
    for t in texts:
        words = space_words(t)
        packed += map(_HASH, words)
        packed.append(_END_HASH)
        sizes.append(len(words) + 1)
    return np.frombuffer(b"".join(packed), ">u8").astype(_U), np.cumsum(sizes)


_END_HASH = _HASH(END)
_START_HASH = _U(int.from_bytes(_HASH(START), "big"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def event_hashes(tokens: np.ndarray, starts: np.ndarray, kinds: int) -> list[np.ndarray]:
    """For each token: its own hash, that with the token before it and, of three kinds, that with the two before it."""
    before = np.r_[_START_HASH, tokens[:-1]]
    before[starts[:-1]] = _START_HASH
    pairs = _mix(_mix(before + _U(0x9E3779B97F4A7C15)) ^ tokens)
    if kinds == 2:
        return [tokens, pairs]
    second = np.r_[_START_HASH, before[:-1]]
    second[starts[:-1]] = _START_HASH
    return [tokens, pairs, _mix(_mix(second + _U(0xC2B2AE3D27D4EB4F)) ^ pairs)]


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    if counts is None:
        keys, counts = np.unique(keys, return_counts=True)
        return keys, counts.astype(np.uint64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)  # 1 + floor(log2 c)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level: 0, 1, 2.5, 5.5, ..."""
    lv = levels.astype(np.float64)
    return np.where(lv > 0, (3 * 2.0 ** (lv - 1) - 1) / 2, 0)


def _positions(keys: np.ndarray, level: int, size: np.ndarray) -> Iterator[np.ndarray]:
    g = _mix(keys + _U(level * 0xD1342543DE82EF95 % 2**64))
    at, step = g >> _U(32), (g & _U(0xFFFFFFFF)) | _U(1)
    for i in range(PROBES):
        yield (at + _U(i) * step) % size


def filter_bits(keys: np.ndarray, counts: np.ndarray, bits_per_entry: int = BITS_PER_ENTRY) -> np.ndarray:
    """The filter of one segment as bytes."""
    levels = levels_of(counts)
    size = max(64, -(-int(levels.sum()) * bits_per_entry // 64) * 64)
    bits = np.zeros(size // 8, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for at in _positions(keys[levels >= level], level, _U(size)):
            np.bitwise_or.at(bits, at >> _U(3), np.left_shift(1, (at & _U(7)).astype(np.uint8), dtype=np.uint8))
    return bits


class Shard:
    """Some segments of the model: exact word counts by sorted hash, and the filter."""

    def __init__(self, rows: list, segments: int):
        self.segments = segments
        self.held = np.zeros(segments, bool)
        self.offset, self.size = np.zeros(segments, _U), np.full(segments, 64, _U)
        at, bits, keys, counts = 0, [], [], []
        for seg, words, ns, part in rows:
            self.held[seg], self.offset[seg], self.size[seg] = True, at, len(part) * 8
            bits.append(np.frombuffer(part, np.uint8))
            keys.append(np.frombuffer(words, _U))
            counts.append(np.frombuffer(ns, np.uint64))
            at += len(part) * 8
        self.bits = np.concatenate([np.zeros(0, np.uint8), *bits])
        self.keys = np.concatenate([np.zeros(0, _U), *keys])
        order = np.argsort(self.keys)
        self.keys, self.counts = self.keys[order], np.concatenate([np.zeros(0, np.uint64), *counts])[order]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self.held[(keys % _U(self.segments)).astype(np.int64)]

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Exact counts of words, 0 for those never seen."""
        if not len(self.keys):
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], np.uint64(0))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each key's level, by probing upwards until a probe fails."""
        out, alive = np.zeros(len(keys), np.uint8), np.flatnonzero(self.holds(keys))
        level = 0
        while len(alive) and level < 64:
            level += 1
            seg = (keys[alive] % _U(self.segments)).astype(np.int64)
            off, size, own = self.offset[seg], self.size[seg], keys[alive]
            g = _mix(own + _U(level * 0xD1342543DE82EF95 % 2**64))
            at, step = g >> _U(32), (g & _U(0xFFFFFFFF)) | _U(1)
            for i in range(PROBES):
                bit = off + (at + _U(i) * step) % size
                yes = ((self.bits[bit >> _U(3)] >> (bit & _U(7)).astype(np.uint8)) & 1).astype(bool)
                if not yes.all():
                    alive, off, size, at, step = alive[yes], off[yes], size[yes], at[yes], step[yes]
            out[alive] = level
        return out


_SENT = "seg int, salt int, kind int, keys binary, ns binary"


def _packed(kind: int, keys: np.ndarray, ns: np.ndarray, to: np.ndarray, salt: int) -> pa.RecordBatch:
    """A row for each number in `to`, with the events that go there."""
    order = np.argsort(to, kind="stable")
    keys, ns, to = keys[order], ns[order], to[order]
    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True]) if len(to) else np.zeros(1, np.int64)
    n = len(cuts) - 1
    cols = [pa.array(to[cuts[:-1]], pa.int32()), pa.array([salt] * n, pa.int32()), pa.array([kind] * n, pa.int32())]
    cols += [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (keys, ns)]
    return pa.RecordBatch.from_arrays(cols, ["seg", "salt", "kind", "keys", "ns"])


def _added(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    rows = table.filter(pa.compute.equal(table.column("kind"), kind))
    return summed(*(np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64) for c in ("keys", "ns")))


def count_events(docs: DataFrame, segments: int, text_col: str = "text", bits_per_entry: int = BITS_PER_ENTRY, blocks: int = BLOCKS, kinds: int = 2, common: int | None = None) -> DataFrame:
    """(seg, words, ns, bits, tokens, often): exact word counts and the filter of every segment, over the texts of docs.
    often: its events of any kind that occur so often as `common` says; none without it."""
    groups = min(segments, blocks)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list] = [[] for _ in range(kinds)]
        size, salt = 0, TaskContext.get().partitionId() // ROUTED_TASKS if groups < segments else 0

        def merge() -> int:
            for k, parts in enumerate(kept):
                if len(parts) > 1:
                    kept[k] = [summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            return sum(len(p[0]) for parts in kept for p in parts)

        def emit() -> Iterator[pa.RecordBatch]:
            merge()
            for kind, parts in enumerate(kept):
                for keys, ns in parts:
                    yield _packed(kind, keys, ns, (keys % _U(segments) % _U(groups)).astype(np.int32), salt)
                parts.clear()

        for batch in batches:
            for run in pieces(batch):
                for kind, keys in enumerate(event_hashes(*token_hashes(texts_of(run, "text")), kinds)):
                    kept[kind].append(summed(keys))
                    size += len(kept[kind][-1][0])
                if size > KEPT_EVENTS and (size := merge()) > KEPT_EVENTS // 2:
                    yield from emit()
                    size = 0
        yield from emit()

    def route(table: pa.Table) -> pa.Table:
        out = []
        for kind in range(kinds):
            keys, ns = _added(table, kind)
            out.append(_packed(kind, keys, ns, (keys % _U(segments)).astype(np.int32), 0))
        return pa.Table.from_batches(out)

    def own(table: pa.Table) -> pa.Table:
        got = [_added(table, kind) for kind in range(kinds)]
        words, ns = got[0]
        bits = filter_bits(*(np.concatenate(x) for x in zip(*got, strict=True)), bits_per_entry)
        often = np.concatenate([np.empty(0, _U), *(keys[n >= np.uint64(common)] for keys, n in got if common is not None)])
        return pa.table({"seg": pa.array([table.column("seg")[0].as_py()], pa.int32()), "words": [words.tobytes()], "ns": [ns.tobytes()], "bits": [bits.tobytes()], "tokens": pa.array([int(ns.sum())], pa.int64()), "often": [often.tobytes()]})

    rows = docs.select(F.col(text_col).cast("string").alias("text"))
    sent = rows.mapInArrow(count, _SENT)
    if groups < segments:
        sent = sent.groupBy("seg", "salt").applyInArrow(route, _SENT)
    return sent.groupBy("seg").applyInArrow(own, "seg int, words binary, ns binary, bits binary, tokens long, often binary")


@dataclass
class _Table:
    """What is broadcast of common events."""

    rows: np.ndarray


@dataclass
class Settings:
    """Of the model as a whole."""

    train_tokens: int
    norm: float
    n_docs: int
    mus: tuple[float, ...]

    def columns(self, starts: np.ndarray, back: np.ndarray, counts: np.ndarray, levels: list[np.ndarray]) -> dict:
        """Results of a run of texts. counts: exact, of the distinct words that back points to; levels: the filter's,
        for each token as a word, the end of a pair and the end of a triple."""
        terms = np.log10((counts.astype(np.float64) + 0.5) / self.norm)
        add = lambda x: np.add.reduceat(x, starts[:-1])
        seen = count_of(levels[0])
        share, found = (seen + 0.5) / self.norm, seen
        for level, mu in zip(levels[1:], self.mus, strict=True):
            history = np.r_[0.0, found[:-1]]
            history[starts[:-1]] = self.n_docs
            found = np.minimum(count_of(level), history)
            share = (found + mu * share) / (history + mu)
        rows = len(starts) - 1
        return {"n_tokens": np.diff(starts), "n_known": add((counts > 0)[back].astype(np.int64)), "train_tokens": np.full(rows, self.train_tokens), "base_score": add(terms[back]), "score": add(np.log10(share))}


def _by_broadcast(rows: DataFrame, out, model: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """Scores where the texts lie, with the whole model on every worker."""
    kinds = len(settings.mus) + 1
    held = Shared(rows.sparkSession, Shard([tuple(r) for r in model.select("seg", "words", "ns", "bits").toLocalIterator()], segments))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in pieces(batch):
                tokens, starts = token_hashes(texts_of(run, "text"))
                words, back = np.unique(tokens, return_inverse=True)
                shard = held.value
                longer = [shard.levels(keys) for keys in event_hashes(tokens, starts, kinds)[1:]]
                cols = settings.columns(starts, back, shard.exact(words), [shard.levels(words)[back], *longer])
                yield pa.RecordBatch.from_arrays([pa.array(cols[c]) if c in cols else run.column(c) for c in out.names], out.names)

    return rows.mapInArrow(over, out)


def _common(model: DataFrame, segments: int) -> np.ndarray:
    """(event, level, exact count) of the commonest events, by event: as the segments answer."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys = np.frombuffer(r["often"], _U)
                shard = Shard([(r["seg"], r["words"], r["ns"], r["bits"])], segments)
                columns = [keys.tobytes(), shard.levels(keys).tobytes(), shard.exact(keys).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["keys", "levels", "counts"])

    rows = model.where(F.octet_length("often") > 0).mapInArrow(told, "keys binary, levels binary, counts binary").collect()  # bounded: COMMON_EVENTS a kind
    kind = [("key", _U), ("level", np.uint8), ("count", np.uint64)]
    found = np.zeros(sum(len(r["levels"]) for r in rows), kind)
    for name, column, of in (("key", "keys", _U), ("level", "levels", np.uint8), ("count", "counts", np.uint64)):
        found[name] = np.frombuffer(b"".join(r[column] for r in rows), of)
    return np.sort(found, order="key")


def _by_segments(rows: DataFrame, out, model: DataFrame, segments: int, settings: Settings) -> DataFrame:
    """Scores by asking each segment's owner: the distinct events of every run of texts, but for the commonest, go to their
    segments in packed blocks, counts and levels come back, and each run is scored from its answers. No task holds more
    than a run with its answers, or a segment and a batch of what is asked of it."""
    kinds = len(settings.mus) + 1
    numbered = rows.drop("run").selectExpr("*", "0L run").schema
    common = Shared(rows.sparkSession, _Table(_common(model, segments)))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for run in pieces(batch):
                yield pa.RecordBatch.from_arrays([*run.columns, pa.array(np.full(run.num_rows, at))], numbered.names)
                at += 1

    texts = staged(rows.mapInArrow(number, numbered), "lm-texts")  # from here on a run's number is fixed

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = batch.column("run").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else []
            for a, b in zip(cuts, cuts[1:], strict=False):
                tokens, starts = token_hashes(texts_of(batch.slice(a, b - a), "text"))
                for kind, keys in enumerate(map(np.unique, event_hashes(tokens, starts, kinds))):
                    keys = keys[~np.isin(keys, common.value.rows["key"])]
                    if not len(keys):
                        continue
                    seg = (keys % _U(segments)).astype(np.int32)
                    order = np.argsort(seg, kind="stable")
                    at = np.flatnonzero(np.r_[True, np.diff(seg[order]) != 0, True])
                    blocks = [keys[order[x:y]].tobytes() for x, y in zip(at, at[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(seg[order][at[:-1]]), pa.array([number[a]] * len(blocks), pa.int64()), pa.array([kind] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["seg", "run", "kind", "keys"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by segment, each segment's own row before what is asked of it. One that learned nothing has none."""
        seg, shard = None, None
        for batch in batches:
            for run in pieces(batch):
                found: dict[str, list] = {"run": [], "kind": [], "keys": [], "counts": [], "levels": []}
                for r in run.to_pylist():
                    if r["seg"] != seg:
                        seg, shard = r["seg"], Shard([], segments)
                    if r["keys"] is None:
                        shard = Shard([(seg, r["words"], r["ns"], r["bits"])], segments)
                        continue
                    keys = np.frombuffer(r["keys"], _U)
                    told = {"run": r["run"], "kind": r["kind"], "keys": r["keys"], "counts": shard.exact(keys).tobytes() if r["kind"] == 0 else b"", "levels": shard.levels(keys).tobytes()}
                    for c, v in told.items():
                        found[c].append(v)
                kinds_of = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found.values(), kinds_of, strict=True)], list(found))

    def score(own: pa.Table, told: pa.Table) -> pa.Table:
        if not len(own):
            return out_schema.empty_table()
        known = {}
        for kind in range(kinds):
            part = told.filter(pa.compute.equal(told.column("kind"), kind))
            joined = lambda c, t: np.frombuffer(b"".join(part.column(c).to_pylist()), t)  # noqa: E731, B023
            often = common.value.rows
            keys, order = np.unique(np.r_[joined("keys", _U), often["key"]], return_index=True)
            known[kind] = keys, np.r_[joined("levels", np.uint8), often["level"]][order], np.r_[joined("counts", np.uint64), often["count"]][order] if kind == 0 else None
        tokens, starts = token_hashes(own.column("text").cast(pa.binary()).to_pylist())
        words, back = np.unique(tokens, return_inverse=True)
        at = np.searchsorted(known[0][0], words)
        longer = [known[k][1][np.searchsorted(known[k][0], keys)] for k, keys in enumerate(event_hashes(tokens, starts, kinds)) if k]
        cols = settings.columns(starts, back, known[0][2][at], [known[0][1][at][back], *longer])
        return pa.table([pa.array(cols[c]) if c in cols else own.column(c) for c in out.names], out.names)

    out_schema = to_arrow_schema(out)
    asked = texts.select("run", "text").mapInArrow(ask, "seg int, run long, kind int, keys binary")
    both = model.select("seg", "words", "ns", "bits").unionByName(asked, allowMissingColumns=True)
    dealt = both.repartition("seg").sortWithinPartitions("seg", F.col("keys").isNotNull())
    told = dealt.mapInArrow(answer, "run long, kind int, keys binary, counts binary, levels binary")
    return texts.groupBy("run").cogroup(told.groupBy("run")).applyInArrow(score, out)


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, mus: tuple[float, ...] = MUS, broadcast_bytes: int = BROADCAST_BYTES, bits_per_entry: int = BITS_PER_ENTRY) -> DataFrame:
    """(id, keep..., n_tokens, n_known, train_tokens, base_score, score): a row for each row of docs.

    The model learns from training's whole texts. A null text is empty: its only token is the end. Repeated rows count
    as often as they stand. Without training rows every probability is the smoothing's own; without docs there is no
    row. keep: columns to carry along; one named like those, "text" or "run" is an error. mus: a smoothing mass for pairs,
    or one for pairs and one for triples.
    """
    own = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    keep = carried(keep, "id", "text", "run", *own)
    n_docs, size = training.agg(F.count("*"), F.sum(F.octet_length(F.col(text_col).cast("string")))).first()
    segments = max(SEGMENTS, -(-int(size or 0) // SEGMENT_BYTES))
    # A token takes two bytes of text at the least, so events of such a count are COMMON_EVENTS a kind at the most.
    common = max(2, -(-int(size or 0) // (2 * COMMON_EVENTS)))
    model = staged(count_events(training, segments, text_col, bits_per_entry, kinds=len(mus) + 1, common=common), "lm-segments")
    n, distinct, size = model.agg(F.sum("tokens"), F.sum(F.octet_length("words") / 8), F.sum(F.octet_length("words") * 2 + F.octet_length("bits"))).first()
    n, distinct = int(n or 0), int(distinct or 0)
    settings = Settings(n, n + 0.5 * (distinct + 1), n_docs, mus)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    out = rows.drop("text").selectExpr("*", "0L n_tokens", "0L n_known", "0L train_tokens", "0D base_score", "0D score").schema
    route = _by_broadcast if int(size or 0) <= broadcast_bytes else _by_segments
    return route(rows, out, model, segments, settings)


def training_rows(docs: DataFrame, id_col: str = "doc_id", held: int = 1) -> DataFrame:
    return docs.where(crc_fold(id_col) != held)
