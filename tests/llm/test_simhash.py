import numpy as np
import pytest
import xxhash

from shelfrank.llm import simhash
from shelfrank.llm.components import connected_components
from shelfrank.llm.shared import staged


def plain_fingerprint(text, k=3, seed=42):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=seed) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def plain_components(rows, radius, k=3, seeds=(42,)):
    each = [[plain_fingerprint(t, k, seed) for _, t in rows] for seed in seeds]
    fps = each[0]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if any((f[i] ^ f[j]).bit_count() <= radius for f in each)]
    roots = closure(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[i]] = min(d, least.get(roots[i], d))
    return [(d, fps[i], least.get(roots[i])) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize(("radius", "k"), [(3, 3), (9, 5)])
def test_equals_brute_force(docs, awkward, radius, k):
    found = simhash.near_duplicates(docs, radius=radius, shingle=k)
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    got = order((r["id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect())
    assert got == order(plain_components(awkward, radius, k))


def test_no_rows(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("bucket_rows", [1 << 16, 40])
@pytest.mark.parametrize("radius", [3, 9])
def test_links_connect_what_all_pairs_connect(spark, radius, bucket_rows):
    """Random fingerprints, scattered neighbours and a dense cluster; small buckets are dealt out as chunk pairs."""
    rng = np.random.default_rng(radius)
    base = [int(x) for x in rng.integers(0, 2**63, 300, dtype=np.uint64)]
    flip = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    fps = sorted({*base, *(flip(x, int(rng.integers(1, 12))) for x in base[:150]), *(flip(base[0], int(rng.integers(0, 5))) for _ in range(200))})
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    frame = staged(spark.createDataFrame([(x,) for x in signed], "fp long"), "test")
    found = [(r["a"], r["b"]) for r in simhash.links(frame, radius, bucket_rows).collect()]
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= radius
    assert all(near(a, b) for a, b in found)
    pairs = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if near(a, b)]
    assert closure(signed, found) == closure(signed, pairs)
    if radius == 3:
        assert len(found) < len(pairs) / 2  # a forest, not the cluster's pairs


def test_cells_of_a_hot_bucket_hold_two_chunks_at_the_most(spark):
    """One bucket of many chunks of stored and of probing rows, beside a small one."""
    rows = [(7, k, k % 3 == 0) for k in range(900)] + [(8, k, False) for k in range(5)]
    keys = spark.createDataFrame(rows, "bucket long, fp long, probing boolean").repartition(5)
    cells = {}
    for r in simhash._cells(keys, 60, ["fp"]).collect():
        cells.setdefault(r["cell"], []).append((r["fp"], r["probing"]))
    assert max(map(len, cells.values())) <= 2 * 60 * 1.6 and len(cells) > 60  # hashed chunks are of about a size
    stored = [k for k in range(900) if k % 3]
    met = {}
    for own in cells.values():
        first, second = [k for k, p in own if not p], [k for k, p in own if p]
        for i, a in enumerate(first):
            for b in [*first[i + 1 :], *second]:
                met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    hot = {(min(a, b), max(a, b)) for a in stored for b in range(900) if a != b}
    assert hot <= set(met)


def test_allocations_keep_the_pigeonhole():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for parts, radius in ((4, 3), (5, 9), (3, 3)):
        bits = np.array_split(rng.permutation(64), parts)
        blocks = [x for own in simhash.sub_blocks([list(map(int, b)) for b in bits]) for x in own]
        plan = simhash.Plan([list(map(int, b)) for b in bits], {j: np.bincount(simhash._values(fps, own), minlength=256).astype(float) for j, own in blocks}, 500, radius)
        took = plan.allocate(fps)
        assert (took >= -1).all() and ((took + 1).sum(1) == radius + 1).all()


def test_grouping_puts_correlated_bits_together():
    n, counts = 1000, np.full((64, 64), 250.0)
    np.fill_diagonal(counts, 500)
    for a in range(0, 64, 16):  # bits a, a + 1, a + 2 always agree
        for i in (a, a + 1, a + 2):
            for j in (a, a + 1, a + 2):
                counts[i, j] = 500
    parts = simhash.group_bits(counts, n, 4)
    assert sorted(b for p in parts for b in p) == list(range(64))
    assert all(any({a, a + 1, a + 2} <= set(p) for p in parts) for a in range(0, 64, 16))


def test_components_of_chains_hubs_and_nulls(spark):
    chain = [(i, i + 1) for i in range(40)]
    hub = [(100, 101 + i) for i in range(50)]
    edges = [*chain, *hub, *hub, (200, 200), (None, 5), (7, None)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 151), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
