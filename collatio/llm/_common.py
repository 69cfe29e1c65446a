"""What the operators of this subpackage share: table access, Arrow slicing, segment maths, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs outside ASCII white space; ``bytes.split()`` cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker takes through numpy at once.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where none is set and all runs in this one process (tests) a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = _LOCAL.get("folder") or _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="collatio-checkpoint-"))
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, as a Parquet table: for wide rows, of which later steps read some columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: Sequence[str], **sums: str) -> DataFrame:
    """``df`` with, for each ``name=expression``, the expression's sum over all rows before in ``order``.

    No task sees more than a partition of the order: rows are range-partitioned, summed by
    partition, and the partitions' offsets (one row each) are added. Keys should be unique.
    """
    parts = cut(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).select("*", *(F.expr(e).alias(f"_v_{n}") for n, e in sums.items()))
    )
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums)).select(
        "_part", *(F.sum(f"_s_{n}").over(ahead).alias(f"_o_{n}") for n in sums),
    )
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.select("*", *(F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in sums))
    zero = F.lit(0)
    return own.join(F.broadcast(offsets), "_part").select(
        *df.columns, *((F.coalesce(f"_o_{n}", zero) + F.coalesce(f"_i_{n}", zero)).alias(n) for n in sums),
    )


def slices(batch: pa.RecordBatch, column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``budget`` bytes of ``column`` each, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(lengths, dtype=np.int64)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + budget, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def byte_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads small integers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i]+1, …`` (``counts[i]`` numbers each), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``counts[i]`` values along the first axis; empty runs give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def run_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Like ``segment_sums`` for floating-point runs, each summed by itself."""
    out = np.zeros(len(counts))
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], dtype=np.float64)
    return out


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: bytes | str) -> int:
        n = self[key] = len(self)
        return n


class Words:
    """The words of some texts as integers: ``ids`` in order, ``counts`` per text, ``vocab`` by id."""

    def __init__(self, texts: list[bytes]):
        seen = Numbers()
        ids: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            words = text.split()
            counts[i] = len(words)
            ids.extend(map(seen.__getitem__, words))
        self.ids = np.array(ids, np.int64)
        self.counts = counts
        self.vocab = list(seen)
