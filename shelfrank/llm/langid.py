"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of text in it. A text's lower-cased words of letters, without
a word's immediate repeats, are cut into blocks; each block is compressed with every dictionary, and the language of
the smallest total wins. Equal totals are settled by a second compression level, then by how common the languages are.
The margin is how much larger, in proportion, the second smallest total is; a narrow one rejects, whatever the length.

A few words alone tell nothing: what would be saved on them is less than a compressor asks for, and it stores them as they
are. So a text that is shorter than half a block is repeated, which makes compression worth while; its copies cost the same
with every dictionary, and the first one tells how much of it each dictionary has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_batch, carried

#: The bounded sample that dictionaries are made of: so many of the commonest languages, so many rows of each, of texts
#: longer than TEXT_BYTES a piece. Dictionaries take whole pieces while they fit into DICT_BYTES.
LANGUAGES, SAMPLE_ROWS, TEXT_BYTES, DICT_BYTES = 256, 96, 28 << 10, 112 << 10
BLOCK_BYTES, LEVEL, TIE_LEVEL = 1024, 9, 3
#: Copies in which short texts are compressed.
COPIES = 8
UNKNOWN = "und"
#: Margins below this are narrow.
NARROW_MARGIN = 0.002
#: The margin at which a prediction counts as certain.
SURE_MARGIN = 0.05
_LETTER, _OTHERS = regex.compile(r"\p{L}"), regex.compile(r"[^\p{L}]+")


def words_of(text: str) -> str:
    """The lower-cased runs of letters, blank-joined, without immediate repeats."""
    words = _OTHERS.sub(" ", text.lower()).split()
    return " ".join(a for a, b in zip(words, ["", *words], strict=False) if a != b)


def _piece(text: str, at: str) -> Column:
    """A text, or of one that may have more than TEXT_BYTES a piece of whole words from a place that its hash names."""
    chars = TEXT_BYTES // 4
    start = F.pmod(F.col(at), F.greatest(F.length(text) - chars, F.lit(1))) + 1
    cut = F.regexp_replace(F.substring(text, start.cast("int"), F.lit(chars)), r"^\S*\s+|\s+\S*$", "")
    return F.when(F.octet_length(text) <= TEXT_BYTES, F.col(text)).when(cut.rlike(r"\p{L}"), cut).otherwise(F.substring(text, F.lit(1), F.lit(chars)))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows: int = SAMPLE_ROWS, most: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each of the `most` commonest languages among docs, the commonest first, from the rows whose ids
    hash lowest; of languages equally common at that place the first by code points are learned. Rows without a language
    or a letter teach nothing and don't count. Long texts teach by a piece from anywhere in them. What reaches the driver
    is bounded by the parameters.
    """
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("at"))
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    if not sizes:
        return {}
    # Only rows that can be among the lowest are sorted: those below a bound on the hash.
    below = lambda n: min(2**63 - 1, int((2 * min(1.0, 8 * rows / n + 0.001) - 1) * 2**63))
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], below(r["n"])) for r in sizes], "lang string, below long"))  # a row a language
    wanted = usable.join(bounds, "lang").where(F.col("at") <= F.col("below")).withColumn("text", _piece("text", "at"))
    first = wanted.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("at", "text"))).where(F.col("n") <= rows)
    texts: dict[str, list[bytes]] = {}
    for r in first.orderBy("lang", "n").select("lang", "text").collect():
        if body := words_of(r["text"]).encode():
            own = texts.setdefault(r["lang"], [])
            if not own or sum(map(len, own)) + len(own) + len(body) <= DICT_BYTES:
                own.append(body)
    return {r["lang"]: b"\n".join(texts[r["lang"]]) for r in sizes if r["lang"] in texts}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.compressors = {level: [self._compressor(dictionaries[lang], level) for lang in self.langs] for level in (LEVEL, TIE_LEVEL)}

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_dict_id=False)

    def sizes(self, body: bytes, level: int) -> np.ndarray:
        if 2 * len(body) < BLOCK_BYTES:
            body = b"\n".join([body] * COPIES)
            return np.array([len(c.compress(body)) for c in self.compressors[level]], np.int64)
        total = np.zeros(len(self.langs), np.int64)
        for at in range(0, len(body), BLOCK_BYTES):
            block = body[at : at + BLOCK_BYTES]
            total += [len(c.compress(block)) for c in self.compressors[level]]
        return total

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, margin, rejected)."""
        if not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) < 2:
            return (self.langs[0], 1.0, False) if self.langs else (UNKNOWN, 0.0, False)
        body = words_of(text).encode()
        sizes = self.sizes(body, LEVEL)
        first, second = np.partition(sizes, 1)[:2]
        best = int(sizes.argmin())
        if first == second:
            tied = np.flatnonzero(sizes == first)
            best = int(tied[self.sizes(body, TIE_LEVEL)[tied].argmin()])
        margin = float(1 - first / second)
        return self.langs[best], margin, margin < NARROW_MARGIN


def identify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(id, keep..., lang_pred, margin, rejected): a row for each row of docs, repeated ones too. "und", margin 0 and
    rejection where the text is null or has no letter; "und" for all if no language was learned. Texts of any length are
    read whole.
    Languages that compress a text equally well at both levels give the commonest of them. An empty table gives no row.
    keep: columns to carry along; one named like those or "text" is an error."""
    held = docs.sparkSession.sparkContext.broadcast({"dictionaries": dictionaries})  # DICT_BYTES a language, LANGUAGES at most
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *carried(keep, "id", "text", "lang_pred", "margin", "rejected"))
    out = rows.drop("text").selectExpr("*", "'' lang_pred", "0D margin", "false rejected").schema

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value  # a worker's own copy, which keeps the classifier from task to task
        if "classifier" not in state:
            state["classifier"] = Classifier(state["dictionaries"])
        classifier = state["classifier"]

        def one(run: pa.RecordBatch) -> pa.RecordBatch:
            found = [classifier.classify(t) for t in run.column("text").to_pylist()]
            cols = {"lang_pred": pa.array([f[0] for f in found], pa.string()), "margin": pa.array([f[1] for f in found], pa.float64()), "rejected": pa.array([bool(f[2]) for f in found], pa.bool_())}
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else run.column(c) for c in out.names], out.names)

        yield from by_batch(one)(batches)

    return rows.mapInArrow(over, out)


def confidence(margin: str = "margin"):
    """0 to 1: how far the margin is on its way to SURE_MARGIN."""
    return F.least(F.lit(1.0), F.col(margin) / SURE_MARGIN)
