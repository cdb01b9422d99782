"""What the corpus operators share: table access, staging in the shared folder, byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where a session on one machine stages tables if it names no folder.
LOCAL_FALLBACK = "/tmp/checkpoints"

#: Rows of whole documents that are given to Python at once.
BATCH_ROWS = 1000

#: Deletes ASCII case and turns every byte outside [0-9a-z\x80-\xff] into a space, so that
#: bytes.split() yields the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of the lower-cased text.
ALNUM_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z lower-cased (bytes.lower and bytes.split are ASCII-only)."""
    return text.lower().split() if text else []


def crc_fold(id_col: str) -> Column:
    """crc32 of the id's decimal text, modulo 5; an id that is null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5


def short_batches(spark: SparkSession) -> None:
    """Has the session give Python BATCH_ROWS rows at once instead of 10,000, unless it gives fewer: whole texts beside whole
    rows fill an executor otherwise, once in the JVM and twice in each of its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def carried(keep: list[str] | None, *own: str) -> list[str]:
    """keep, unless it names one of an operator's own columns: then an error, as one of the two would be lost."""
    clash = {c.lower() for c in own} & {c.lower() for c in keep or []}
    if clash:
        raise ValueError(f"columns to carry along can't be named {sorted(clash)}")
    return list(keep or [])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL_FALLBACK
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Tables staged since a `Stage` began, as long as one is open.
_SINCE: list[list[DataFrame]] = []


class Stage:
    """What is staged within it, so that it can go when its result has been staged: `discard(*stage.made)`."""

    def __enter__(self) -> Stage:
        self.made: list[DataFrame] = []
        _SINCE.append(self.made)
        return self

    def __exit__(self, *_) -> None:
        _SINCE[:] = [made for made in _SINCE if made is not self.made]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back.

    This cuts the lineage at a point that survives the loss of any executor, and, unlike
    checkpoint(), computes df only once. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    for made in _SINCE:
        made.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no plan reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = jvm.org.apache.hadoop.fs.Path(path)
            if "/staged-" in path:
                place.getFileSystem(conf).delete(place, True)


def pieces(batch: pa.RecordBatch, most: int = 512) -> Iterator[pa.RecordBatch]:
    """Short runs of rows, so that what is derived from a run's texts stays small."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in pieces(batch):
                yield make(run)

    return over


class Shared:
    """An object of ours on every worker. Its state is broadcast as plain data and the object is made anew there, as
    broadcasts, unlike functions, can't bring classes along to workers without this package."""

    def __init__(self, spark: SparkSession, thing: object):
        self.kind, self.state, self.made = type(thing), spark.sparkContext.broadcast(thing.__dict__), None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"made": None}

    @property
    def value(self):
        if self.made is None:
            self.made = self.kind.__new__(self.kind)
            self.made.__dict__.update(self.state.value)
        return self.made
