"""Quality scores by a sparse rule ensemble.

Statistics of each text feed small boosted trees; every path from a root becomes a rule, a conjunction of thresholds;
logistic regression with a lasso penalty keeps the few that matter; and what is kept is compiled into one Spark
column expression over the statistics.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, carried, texts_of

#: The bounded sample of labelled rows that the driver fits on.
SAMPLE_ROWS = 12_000
TREES, DEPTH, RATE, CUTS, LEAST_LEAF = 24, 3, 0.3, 24, 20
LASSO, STEPS = 0.002, 400
STATS = ("size", "words", "word_length", "distinct", "commonest", "run", "repeats", "upper", "digits", "marks", "symbols", "pipes", "stops", "blanks", "wide", "lines", "line_length", "line_repeats", "no_letter", "exclamations")

_UPPER = bytes(range(0x41, 0x5B))
_LOWER = bytes(range(0x61, 0x7B))
_DIGITS = bytes(range(0x30, 0x3A))
_MARKS = b"!?.,;:'\"()-"
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_WIDE = bytes(range(0x80, 0x100))


def statistics(text: bytes | None) -> list[float]:
    """STATS of one text; all 0 where it is null or empty."""
    if not text:
        return [0.0] * len(STATS)
    size = len(text)
    share = lambda what: (size - len(text.translate(None, what))) / size
    words = text.lower().split()
    n = max(len(words), 1)
    counts = Counter(words)
    same = longest = 0
    for a, b in zip(words, words[1:], strict=False):
        if a == b:
            same += 1
            longest = max(longest, same)
        else:
            same = 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = sum(c for w, c in counts.items() if not w.translate(None, _DIGITS + _MARKS + _SYMBOLS))
    return [
        float(np.log1p(size)),
        float(np.log1p(len(words))),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        longest / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        share(_SYMBOLS),
        text.count(b"|") / n,
        (text.count(b".") + text.count(b"!") + text.count(b"?")) / n,
        share(b" \t\r\n"),
        share(_WIDE),
        float(np.log1p(len(lines))),
        size / max(len(lines), 1),
        1 - len(set(lines)) / max(len(lines), 1),
        bare / n,
        text.count(b"!") / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., one double for each of STATS): a row for each row of docs, repeated ones too. A column to carry
    along that is named "id", "text", "score" or like one of STATS is an error; other columns of docs are never read."""
    keep = carried(keep, "id", "text", "score", *STATS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep)
    out = rows.drop("text").selectExpr("*", *(f"0D `{s}`" for s in STATS)).schema

    def one(run: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([statistics(t) for t in texts_of(run, "text")], np.float64).reshape(-1, len(STATS))
        cols = {s: pa.array(found[:, i]) for i, s in enumerate(STATS)}
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else run.column(c) for c in out.names], out.names)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_batch(one)(batches)

    return rows.mapInArrow(over, out)


#: A rule: its conditions as (statistic, above, threshold).
Rule = tuple[tuple[int, bool, float], ...]


@dataclass
class Ensemble:
    intercept: float
    rules: list[Rule]
    weights: list[float]

    def matrix(self, x: np.ndarray) -> np.ndarray:
        return np.stack([holds(r, x) for r in self.rules], 1).astype(float) if self.rules else np.zeros((len(x), 0))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + self.matrix(x) @ np.array(self.weights))))

    def column(self) -> Column:
        """The score over columns named as STATS."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            held = F.lit(True)
            for i, above, cut in rule:
                held = held & (F.col(STATS[i]) > cut if above else F.col(STATS[i]) <= cut)
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, above, cut in rule:
        out &= (x[:, i] > cut) == above
    return out


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, depth: int, out: list, step: np.ndarray) -> None:
    """Splits rows where the second-order gain is largest; each split gives the two paths through it."""
    g, h = slope[rows].sum(), curve[rows].sum()
    step[rows] = g / (h + 1.0)
    if depth == 0 or len(rows) < 2 * LEAST_LEAF:
        return
    best = (1e-3, -1, 0.0)
    for i, own in enumerate(cuts):
        if not len(own):
            continue
        at = np.searchsorted(own, x[rows, i], side="left")  # values up to cut k have at <= k
        gs, hs, ns = (np.cumsum(np.bincount(at, w, len(own) + 1))[:-1] for w in (slope[rows], curve[rows], None))
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < LEAST_LEAF) | (len(rows) - ns < LEAST_LEAF)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], i, own[k])
    if best[1] < 0:
        return
    above = x[rows, best[1]] > best[2]
    for side, own in ((False, rows[~above]), (True, rows[above])):
        longer = (*path, (best[1], side, float(best[2])))
        out.append(longer)
        _grow(x, slope, curve, cuts, own, longer, depth - 1, out, step)


def fit_rules(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from boosted trees, weighted by lasso logistic regression. One class alone, or no row, gives a constant."""
    if len(y) == 0 or y.min() == y.max():
        rate = float((y.sum() + 0.5) / (len(y) + 1))
        return Ensemble(float(np.log(rate / (1 - rate))), [], [])
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, CUTS + 2)[1:-1])) for i in range(x.shape[1])]
    cuts = [c[c < x[:, i].max()] for i, c in enumerate(cuts)]
    rules: list[Rule] = []
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    rng = np.random.default_rng(7)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        own: list[Rule] = []
        _grow(x, y - p, p * (1 - p), cuts, rows, (), DEPTH, own, step)
        rules += own
        score += RATE * step
    rules = list(dict.fromkeys(rules))
    return _lasso(rules, x, y)


def _lasso(rules: list[Rule], x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Accelerated proximal steps on the mean logistic loss plus LASSO times the weights' absolute sum."""
    m = np.stack([holds(r, x) for r in rules], 1).astype(np.float64) if rules else np.zeros((len(y), 0))
    design = np.c_[np.ones(len(y)), m]
    v = np.ones(design.shape[1])
    for _ in range(20):  # the largest eigenvalue bounds the curvature
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    rate = 4 * len(y) / float(v @ (design.T @ (design @ v)) * 1.02)
    w = look = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(STEPS):
        slope = design.T @ (1 / (1 + np.exp(-design @ look)) - y) / len(y)
        new = look - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * LASSO, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    kept = np.flatnonzero(w[1:])
    return Ensemble(float(w[0]), [rules[i] for i in kept], [float(w[1 + i]) for i in kept])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> Ensemble:
    """Fits on at most `rows` labelled documents, those whose ids hash lowest. Labels that are null, or whose document
    isn't there, teach nothing."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("double").alias("label"))
    few = F.broadcast(known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(rows))  # `rows` pairs of numbers
    texts = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("body"))
    found = with_statistics(texts.join(few, "label_id"), "label_id", "body", ["label"]).drop("id").toPandas()
    found = found.sort_values(list(found.columns))  # whichever order the rows came in
    return fit_rules(found[list(STATS)].to_numpy(float), found["label"].to_numpy(float))


def score(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., score): a row for each row of docs; a null or empty text has statistics of 0 and a score too.
    Texts of any length are read whole. An empty table gives no row. For keep see with_statistics."""
    return with_statistics(docs, id_col, text_col, keep).withColumn("score", ensemble.column()).drop(*STATS)
