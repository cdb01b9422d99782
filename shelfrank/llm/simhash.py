"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints of 64 bits link when they differ in at most RADIUS bits. Bits that rise and fall together are grouped
into partitions. If the partitions' thresholds t_i satisfy sum(t_i + 1) = RADIUS + 1 (-1 leaves a partition out), two
linked fingerprints agree within t_i bits in some partition i, whichever allocation a fingerprint takes. Each
fingerprint therefore takes its own cheapest allocation, found by dynamic programming over estimated candidate counts.
It is stored under its value in every partition, and probes the values around its own in those with t_i >= 1; what
meets under a value is verified on all 64 bits.

Exact copies meet before any of this, as one fingerprint. A bucket yields a spanning forest of its links rather than
all its pairs. The rows of a bucket that outgrows BUCKET_ROWS, stored and probing ones, are dealt out over chunks, and
chunks meet in pairs, so no task holds more than two chunks and no link is lost.

`wide_links` is the same search over fingerprints of two words each, for radii at which one word's worth of bits tells too
little: near in one word, found by its partitions, and near in both together. Its partitions are of 8 bits at such radii,
so their buckets grow with the input and comparisons with its square. For many fingerprints `Tables` take their place:
samples of the bits of both words, longer ones the more fingerprints there are, and so many of them that near pairs agree
in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Shared, discard, pieces, space_words, staged, texts_of

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Rows that one task compares under one value at once.
BUCKET_ROWS = 1 << 16
#: What one stored or probing row costs, in comparisons of candidates.
PROBE_COST = 1000.0
#: The same for fingerprints of two words, whose rows are wider and whose radius asks for many more of them.
WIDE_PROBE_COST = 20_000.0
#: What a row of a table costs, in comparisons, and what a bit of a sample is worth, as bits are neither fair nor independent.
TABLE_ROW_COST, BIT_WORTH = 2000.0, 0.85
#: Links that one task thins out.
LINKS_A_TASK = 500_000
_CHUNK = 1 << 15


def fingerprint(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 values of the word shingles, repeats included; 0 without words."""
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return majority(b"".join(map(partial(xxhash.xxh64_digest, seed=seed), grams)))


def majority(packed: bytes) -> int:
    """The bits that are set in over half of some 8-byte values."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(packed), 8 * _CHUNK):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, min(8 * _CHUNK, len(packed) - at), at)).reshape(-1, 64)
        full = len(bits) // 128 * 128  # sums of 128 rows fit in a byte
        total += bits[:full].reshape(-1, 128, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[full:].sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(packed) // 8).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): a row for each row of docs, with its fingerprint as a signed long. Null or wordless texts get 0."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in pieces(batch):
                fps = np.array([fingerprint(space_words(t), shingle) for t in texts_of(run, "text")], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([run.column("id"), pa.array(fps)], ["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(over, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones a fingerprint, the lowest bit first."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The fingerprints' values in one partition, its first bit lowest."""
    out = np.zeros(len(fps), np.int64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of the 64 bits: each grows from the most correlated free bit by its closest neighbours."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    near = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(near, 0)
    free, out = list(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        own = [max(free, key=lambda b: (near[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < size:
            own.append(max(free, key=lambda b: (near[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(own)
    return out


class Plan:
    """The partitions of the bits and the estimates from which each fingerprint allocates its thresholds."""

    def __init__(self, parts: list[list[int]], histograms: dict[int, np.ndarray], n: int, radius: int, probe_cost: float = PROBE_COST):
        self.parts, self.n, self.radius, self.probe_cost = parts, n, radius, probe_cost
        self.blocks = sub_blocks(parts)
        values = np.arange(256, dtype=np.uint64)
        apart = np.bitwise_count(values[:, None] ^ values[None, :])
        share = {j: h / max(n, 1) for j, h in histograms.items()}
        #: By block and value: the share of all fingerprints at each distance from it.
        self.at_distance = {j: np.stack([((apart == d) * share[j][None, :]).sum(1) for d in range(radius + 1)], 1) for j in share}

    def costs(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, threshold + 1]: probes and estimated candidates of that threshold."""
        out = np.zeros((len(fps), len(self.parts), self.radius + 2))
        for i, bits in enumerate(self.parts):
            dist = np.zeros((len(fps), self.radius + 1))
            dist[:, 0] = 1
            for j, own in self.blocks[i]:
                t = self.at_distance[j][_values(fps, own)]
                dist = np.stack([sum(dist[:, a] * t[:, d - a] for a in range(d + 1)) for d in range(self.radius + 1)], 1)
            within = np.cumsum(dist, 1) * self.n
            for t in range(self.radius + 1):
                out[:, i, t + 1] = within[:, t] + self.probe_cost * (sum(comb(len(bits), d) for d in range(t + 1)) - 1)
        return out

    def allocate(self, fps: np.ndarray) -> np.ndarray:
        """[fingerprint, partition]: the thresholds with sum(t + 1) = radius + 1 of least cost."""
        cost, units = self.costs(fps), self.radius + 1
        best = np.full((len(fps), units + 1), np.inf)
        best[:, 0] = 0
        took = []
        for i in range(len(self.parts)):
            options = np.stack([np.stack([best[:, u - k] + cost[:, i, k] if k <= u else np.full(len(fps), np.inf) for k in range(units + 1)], 1) for u in range(units + 1)], 1)
            took.append(options.argmin(2))
            best = options.min(2)
        out, left, rows = np.zeros((len(fps), len(self.parts)), np.int64), np.full(len(fps), units), np.arange(len(fps))
        for i in reversed(range(len(self.parts))):
            out[:, i] = took[i][rows, left]
            left = left - out[:, i]
        return out - 1

    def keys(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, position, probing): each stored under its own value in every partition, and probing others."""
        thresholds, buckets, owners, every = self.allocate(fps), [], [], np.arange(len(fps))
        for i, bits in enumerate(self.parts):
            buckets.append(_values(fps, bits) | i << 59)
            owners.append(every)
        n_stored = len(fps) * len(self.parts)
        for i, bits in enumerate(self.parts):
            own = _values(fps, bits)
            for t in range(1, self.radius + 1):
                on = thresholds[:, i] >= t
                if not on.any():
                    break
                for mask in _masks(len(bits), t):
                    buckets.append((own[on] ^ mask) | i << 59)
                    owners.append(every[on])
        out = np.concatenate(buckets)
        return out, np.concatenate(owners), np.arange(len(out)) >= n_stored

    def dealt(self, own: np.ndarray, other: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys of one word, those alone that a fingerprint is stored under without probes."""
        found = self.keys(own)
        return found if probes else tuple(x[~found[2]] for x in found)


class Tables:
    """Samples of the 128 bits of two words. A fingerprint is stored in every table, under what it has at the sample's bits."""

    def __init__(self, bits: int, tables: int):
        rng = np.random.default_rng(1)
        #: A column a table: what each of the 128 bits adds to its value.
        self.weights = np.zeros((128, tables))
        for t in range(tables):
            self.weights[rng.choice(128, bits, replace=False), t] = 2.0 ** np.arange(bits)
        #: Tables that are searched first, alone; they chain most of what is near.
        self.first = max(1, tables // 6)

    def dealt(self, own: np.ndarray, other: np.ndarray, probes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, position, probing), nothing probing: in the first tables, or in the rest of them."""
        chosen = np.arange(self.weights.shape[1])[slice(self.first, None) if probes else slice(0, self.first)]
        values = np.hstack([_bits(own), _bits(other)]).astype(np.float64) @ self.weights[:, chosen]  # whole numbers below 2^53
        buckets = values.astype(np.int64) | chosen << 40
        owners = np.repeat(np.arange(len(own)), len(chosen))
        return buckets.ravel(), owners, np.zeros(len(owners), bool)


def met_in_tables(bits: int, tables: int, apart: float, total: int) -> float:
    """How many of the pairs whose bits differ with a probability of `apart` are within `total` and agree in a table."""
    out = 0.0
    for d in range(total + 1):
        agree = comb(128 - d, bits) / comb(128, bits)
        out += comb(128, d) * apart**d * (1 - apart) ** (128 - d) * (1 - (1 - agree) ** tables)
    return out


def how_many_tables(n: int, apart: float, total: int, recall: float) -> tuple[int, int]:
    """(bits, tables) that are cheapest for n fingerprints and meet so many pairs. Bits grow with the logarithm of n, so
    that buckets hardly grow."""

    def enough(bits: int) -> int:
        tables = 1
        while met_in_tables(bits, tables, apart, total) < recall:
            tables += max(1, tables // 16)
        return tables

    found = {bits: enough(bits) for bits in range(8, 19, 2)}
    cost = lambda bits: found[bits] * (TABLE_ROW_COST + n / 2 ** (1 + BIT_WORTH * bits))
    best = min(found, key=cost)
    return best, found[best]


def sub_blocks(parts: list[list[int]]) -> list[list[tuple[int, list[int]]]]:
    """Numbered runs of at most 8 bits of each partition, small enough for an exact histogram."""
    out, j = [], 0
    for bits in parts:
        runs = [bits[a : a + 8] for a in range(0, len(bits), 8)]
        out.append([(j + k, own) for k, own in enumerate(runs)])
        j += len(runs)
    return out


def _masks(width: int, weight: int) -> Iterator[int]:
    for at in combinations(range(width), weight):
        yield sum(1 << b for b in at)


def how_many(n: int, radius: int, probe_cost: float = PROBE_COST) -> int:
    """The number of partitions that is cheapest for n fingerprints if bits were fair and thresholds even."""

    def cost(parts: int) -> float:
        total = 0.0
        for i in range(parts):
            width, t = 64 // parts + (i < 64 % parts), (radius + 1) // parts + (i < (radius + 1) % parts) - 1
            ball = sum(comb(width, d) for d in range(t + 1))
            total += probe_cost * max(ball, 1) + n * ball / 2**width
        return total

    return min(range(2, 9), key=cost)


def _summed(fps: DataFrame, size: int, count) -> np.ndarray:
    """Sums an array of fixed size that count() makes of each batch of fingerprints."""

    def over(batches):
        total = None
        for batch in batches:
            got = count(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)).ravel()
            total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["cell", "n"])

    cells = fps.mapInArrow(over, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(np.int64)
    return out


def plan_search(fps: DataFrame, radius: int = RADIUS, probe_cost: float = PROBE_COST) -> Plan:
    """Fits a Plan on counts over all fingerprints: 64 x 64 for the grouping, 256 for each block of bits."""
    pairs = _summed(fps, 4096, lambda x: (b := _bits(x).astype(np.float64)).T @ b).reshape(64, 64)
    n = fps.count()
    parts = group_bits(pairs, n, how_many(n, radius, probe_cost))
    blocks = [x for own in sub_blocks(parts) for x in own]
    counts = _summed(fps, 256 * len(blocks), lambda x: np.stack([np.bincount(_values(x, own), minlength=256) for _, own in blocks]))
    return Plan(parts, {j: counts.reshape(-1, 256)[j].astype(float) for j, _ in blocks}, n, radius, probe_cost)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y)


def forest(stored: np.ndarray, probing: np.ndarray, radius: int, others: np.ndarray | None = None, total: int = 0) -> list[tuple[int, int]]:
    """Links that join whatever links of stored fingerprints, with each other and with probing ones, join.

    Positions count on from stored into probing. Two probing fingerprints are never compared: they meet where one of
    them is stored. Few links are all returned; many are reduced to at most one a fingerprint. others: a second word of
    every fingerprint, in whose light a link has at most `total` differing bits in both words; a radius of 64 leaves it at that.
    """
    both = np.concatenate([stored, probing])
    n, m = len(stored), len(both)
    step = max(1, (1 << 21) // m)
    count, in_rows, in_cols = 0, np.zeros(n, bool), np.zeros(m, bool)
    found: list[np.ndarray] = []
    for at in range(0, n, step):
        near = apart(stored[at : at + step, None], both[None, :])
        if alone := others is not None and radius >= 64:  # the total alone decides
            near = near + apart(others[at : at + step, None], others[None, :]) <= total
        else:
            near = near <= radius
        near[np.arange(len(near)), at + np.arange(len(near))] = False
        if others is not None and not alone and near.any():
            i, j = np.nonzero(near)
            far = apart(both[at + i], both[j]) + apart(others[at + i], others[j]) > total
            near[i[far], j[far]] = False
        if near.any():
            count += int(near.sum())
            in_rows[at : at + step] = near.any(1)
            in_cols |= near.any(0)
            if count <= 2 * m:
                found.append(np.argwhere(near) + (at, 0))
    if count <= 2 * m:
        return [(int(a), int(b)) for a, b in np.concatenate(found)] if found else []
    # Dense: walk from each node to what isn't reached yet, which soon is little.
    in_cols[:n] |= in_rows
    free, out = np.flatnonzero(in_cols), []
    while len(free):
        queue, free = [free[0]], free[1:]
        while queue and len(free):
            at = queue.pop()
            may = free if at < n else free[free < n]
            bits = apart(both[may], both[at])
            hit = may[bits <= radius] if others is None else may[(bits <= radius) & (bits + apart(others[may], others[at]) <= total)]
            if len(hit):
                out += [(int(at), int(x)) for x in hit]
                queue += list(hit)
                free = np.setdiff1d(free, hit, assume_unique=True)
    return out


def _links(keys: np.ndarray, fps: np.ndarray, probing: np.ndarray, radius: int, others: np.ndarray | None = None, total: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Links, as positions, within runs of equal keys, in each of which stored fingerprints come before probing ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    stored = np.add.reduceat(~probing, starts)
    a, b = [], []
    short = np.repeat(sizes <= 8, sizes)
    for k in range(1, 8):  # short runs are compared by shifts
        i = np.flatnonzero((keys[k:] == keys[:-k]) & short[k:] & ~probing[:-k])
        if not len(i):
            break
        bits = apart(fps[i], fps[i + k])
        i = i[bits <= radius] if others is None else i[(bits <= radius) & (bits + apart(others[i], others[i + k]) <= total)]
        a.append(i)
        b.append(i + k)
    for r in np.flatnonzero((sizes > 8) & (stored > 0)):
        at, cut, end = starts[r], starts[r] + stored[r], starts[r] + sizes[r]
        if pairs := forest(fps[at:cut], fps[cut:end], radius, None if others is None else others[at:end], total):
            own = np.array(pairs)
            a.append(at + own[:, 0])
            b.append(at + own[:, 1])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


class _Joined:
    """Union-find over what a task has linked so far, to pass on only links that join something."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def new(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[x] = y
                keep[i] = True
        if len(self.up) > 2_000_000:
            self.up.clear()
        return keep


def _cells(keys: DataFrame, bucket_rows: int, numbers: list[str]) -> DataFrame:
    """keys (bucket, numbers..., probing) as rows of cells, sorted so that a cell's stored rows come before probing ones.

    Of a hot bucket the stored rows go to chunks, and the probing ones to chunks of their own. Every chunk of stored rows is
    a cell alone, with each later one, and with each chunk of probing rows, so no cell holds more than two chunks and no pair
    is lost. Cells are named by a hash; a collision only makes two cells one, and what meets is verified.
    """
    sizes = keys.groupBy("bucket").agg(F.count_if(~F.col("probing")).alias("s"), F.count_if("probing").alias("p"))
    hot = sizes.where((F.greatest("s", "p") > bucket_rows) & (F.col("s") > 0)).select("bucket", F.ceil(F.col("s") / bucket_rows).alias("gs"), F.ceil(F.col("p") / bucket_rows).alias("gp"))
    cells = keys.select(F.col("bucket").alias("cell"), *numbers, "probing")
    if hot.head(1):
        dealt = keys.join(hot, "bucket", "left")
        zero, gs, gp = F.lit(0).cast("long"), F.col("gs"), F.col("gp")
        mine = F.pmod(F.xxhash64(*numbers), F.when(F.col("probing"), gp).otherwise(gs))
        cell = lambda i, probes, j, probing: F.struct(F.xxhash64("bucket", i, F.lit(probes), j).alias("cell"), F.lit(probing).alias("probing"))
        none = F.array().cast("array<struct<cell: bigint, probing: boolean>>")
        upwards = F.transform(F.sequence(mine, gs - 1), lambda j: cell(mine, False, j, False))
        downwards = F.when(mine > 0, F.transform(F.sequence(zero, mine - 1), lambda i: cell(i, False, mine, True))).otherwise(none)
        probed = F.when(gp > 0, F.transform(F.sequence(zero, gp - 1), lambda j: cell(mine, True, j, False))).otherwise(none)
        probes = F.transform(F.sequence(zero, gs - 1), lambda i: cell(i, True, mine, True))
        alone = F.array(F.struct(F.col("bucket").alias("cell"), "probing"))
        to = F.when(gs.isNull(), alone).when(F.col("probing"), probes).otherwise(F.concat(upwards, downwards, probed))
        cells = dealt.select(F.explode(to).alias("to"), *numbers).select("to.cell", *numbers, "to.probing")
    n = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "probing")


def _whole_runs(batches, names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of successive batches, the first of which names the run, cut so that no run is parted."""
    rest = None
    for batch in _and_end(batches):
        if batch is None:
            if rest is not None and len(rest[0]):
                yield rest
            return
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        now = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last run may go on in the next batch
        rest = [x[cut:] for x in now]
        if cut:
            yield [x[:cut] for x in now]


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them to connect all that is linked.

    fps: a staged table with a column fp of distinct longs.
    """
    plan = Shared(fps.sparkSession, plan_search(fps, radius))  # a few KB, whatever the input

    def deal(batches):
        for batch in batches:
            all_fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                own = all_fps[at : at + 4096]
                buckets, owners, probing = plan.value.keys(own)
                yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(own[owners].view(np.int64)), pa.array(probing)], ["bucket", "fp", "probing"])

    def compare(batches):
        joined = _Joined()
        for cells, fps, probing in _whole_runs(batches, ["cell", "fp", "probing"]):
            fps = fps.view(np.uint64)
            a, b = (fps[i] for i in _links(cells, fps, probing, radius))
            new = joined.new(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64))], ["a", "b"])

    keys = staged(fps.select("fp").mapInArrow(deal, "bucket long, fp long, probing boolean"), "simhash-keys")
    found = staged(_cells(keys, bucket_rows, ["fp"]).mapInArrow(compare, "a long, b long"), "simhash-found")
    discard(keys)
    return _thinned(found)


def _thinned(found: DataFrame) -> DataFrame:
    """Links without those that join nothing new in their task. Tasks have repeated each other's inside large groups; what
    few tasks can hold is thinned out to forests once more."""

    def thin(batches):
        joined = _Joined()
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            new = joined.new(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], ["a", "b"])

    return found.repartition(max(1, -(-found.count() // LINKS_A_TASK))).mapInArrow(thin, "a long, b long")


def wide_plans(marks: DataFrame, words: tuple[str, str], radius: int) -> list[Shared]:
    """A plan of the search for each word; a few KB, whatever the input."""
    return [Shared(marks.sparkSession, plan_search(marks.select(F.col(w).alias("fp")), radius, WIDE_PROBE_COST)) for w in words]


def wide_tables(spark: SparkSession, n: int, apart: float, total: int, recall: float) -> list[Shared]:
    """Tables instead of plans, for many fingerprints; a few 100 KB, whatever the input."""
    return [Shared(spark, Tables(*how_many_tables(n, apart, total, recall)))]


def wide_links(marks: DataFrame, words: tuple[str, str], plans: list[Shared], radius: int, total: int, probes: bool = True, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links among fingerprints of two words, enough of them to connect all that is linked: what differs in at most
    `radius` bits of either word, and in at most `total` bits of both. Without probes those alone that also agree in a
    partition of a word.

    With tables, links are what agrees in a table and differs in at most `total` bits of both, whatever the word (a radius
    of 64). Without probes these are the first tables', with them those of the rest.

    marks: a staged table of distinct fingerprints: two words each as longs, a long, mark, that names them, and another, root,
    that fingerprints have in common that need no link with each other.
    """

    def deal(batches):
        for batch in batches:
            marked, roots, *both = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "root", *words))
            for at in range(0, len(marked), 1024):
                for k, plan in enumerate(plans):
                    own, other = (x[at : at + 1024].view(np.uint64) for x in (both[k], both[1 - k]))
                    buckets, owners, probing = plan.value.dealt(own, other, probes)
                    cols = [buckets | k << 50, own[owners].view(np.int64), other[owners].view(np.int64), marked[at : at + 1024][owners], roots[at : at + 1024][owners], probing]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, cols)), ["bucket", "own", "other", "mark", "root", "probing"])

    def compare(batches):
        joined = _Joined()
        for cells, own, other, marked, roots, probing in _whole_runs(batches, ["cell", "own", "other", "mark", "root", "probing"]):
            a, b = _links(cells, own.view(np.uint64), probing, radius, other.view(np.uint64), total)
            new = joined.new(roots[a], roots[b])
            yield pa.RecordBatch.from_arrays([pa.array(marked[a[new]]), pa.array(marked[b[new]])], ["a", "b"])

    # Dealt twice, to count and to compare, as keys take more room than the words that they are made from.
    keys = marks.select("mark", "root", *words).mapInArrow(deal, "bucket long, own long, other long, mark long, root long, probing boolean")
    found = staged(_cells(keys, bucket_rows, ["own", "other", "mark", "root"]).mapInArrow(compare, "a long, b long"), "simhash-wide")
    return _thinned(found)


def _and_end(batches):
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id): a row for each row of docs; component_id is the least id reachable over links.

    Null, empty and blank texts have fingerprint 0 and link like any other. A row whose id is null takes part, is
    returned, and gives its component no name unless no other row does (then null). Repeated ids are repeated rows.
    Ties for a component's name can't be: equal ids are one name. An empty table gives an empty result. Columns other
    than the two named are never read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "simhash")
    nodes = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes, radius), "simhash-links")
    # Only linked fingerprints have a component to look up. Names are staged, so that both sides of the join with them are
    # dealt out for it, and adaptive execution can split a component of many members.
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "least", "root")
    names = staged(linked.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = linked.select("fp", "root").join(names, "root").select("fp", "component_id")
    # Staged for the same reason: a fingerprint may have many copies.
    known = staged(nodes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-known")
    discard(nodes, names)
    return rows.join(known, "fp", "left").select("id", "fp", "component_id")
