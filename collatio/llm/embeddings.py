"""Embedding near-duplicates by sorted projection passes.

In each pass every vector gets the signs of seeded random projections as one long bit string;
vectors are ordered lexicographically by (label, bit string) and each is compared with the next
``window`` vectors in that order. Passes differ in their projections; pairs verified in any of
them are united. A window is a lesser part of a larger group, so the number of passes grows with
the largest group of one label and length, and passes go on until a round of them unites no two
components. One global order serves all passes at once: it is range-partitioned with a
unique last key, so a crowd of equal strings is spread over tasks, and cut into blocks with a
halo of ``window`` rows, so no pair in a window is lost at a border.

Exact copies (equal label and vector) are one class from the start. A crowd larger than the
window has links that no window shows. So components are formed from what was found, and those
whose pairs were not all found are completed exactly: members are dealt into tiles, and every
pair of tiles is one matrix product whose links are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm._common import cut
from collatio.llm._graph import components


@dataclass(frozen=True)
class Passes:
    least: float = 0.93
    passes: int = 12
    window: int = 32
    #: vectors of the largest group up to which ``passes`` are enough; beyond, they grow by this power
    enough: int = 10_000
    power: float = 0.25
    block: int = 512
    #: members of a component in one tile of its completion
    tile: int = 2048
    seed: int = 42


def needed(p: Passes, largest: int) -> int:
    """Passes for groups of up to ``largest`` vectors: the chance of one window to show a pair falls as a power."""
    return int(np.ceil(p.passes * max(largest / p.enough, 1.0) ** p.power))


def planes(p: Passes, number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([p.seed, number, dim]).standard_normal((dim, 63))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length, none zero, as rows of length 1 in double precision.

    Rows are divided by their largest component first, so that no square over- or underflows.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def classes(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(cid, label, dim, vec, n, rep)``: distinct usable vectors with their copies' number and least id."""
    floats = F.col(vec_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & F.exists(floats, lambda x: x != 0) & ~F.exists(
        floats, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")),
    )
    rows = df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    same = rows.groupBy("label", F.xxhash64("vec").alias("h"), "vec").agg(F.count("*").alias("n"), F.min("id").alias("rep"))
    return cut(same).withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))


def _signed(distinct: DataFrame, p: Passes, numbers: range) -> DataFrame:
    """``(cid, label, dim, pass, sig)``: a row for each class and pass."""
    kind = distinct.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows = unit_rows(part.column("vec"))
                for number in numbers:
                    sig = ((rows @ planes(p, number, int(dim)) > 0) * weights).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("cid"), part.column("label"), part.column("dim"), pa.array(np.full(len(sig), number, np.int32)),
                            pa.array(sig),
                        ], names=["cid", "label", "dim", "pass", "sig"]
                    )

    return distinct.select("cid", "label", "dim", "vec").mapInArrow(run, f"cid long, label {kind}, dim int, pass int, sig long")


def _ranked(signed: DataFrame) -> DataFrame:
    """The global order's row number as ``rank``; the offsets are one row for each partition."""
    keys = ["pass", "label", "dim", "sig", "cid"]
    ordered = cut(signed.repartitionByRange(*keys).sortWithinPartitions(*keys)).withColumn("part", F.spark_partition_id()).withColumn(
        "place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1),
    )
    sizes = ordered.groupBy("part").count()
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("offset"))
    return ordered.join(F.broadcast(offsets), "part").withColumn("rank", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def window_pairs(distinct: DataFrame, p: Passes, numbers: range | None = None) -> DataFrame:
    """``(a, b)``, a < b: classes of one label within a window of some pass whose cosine is enough."""
    block = F.floor(F.col("rank") / p.block)
    halo = (F.col("rank") % p.block < p.window) & (F.col("rank") >= p.block)
    blocks = F.explode(F.when(halo, F.array(block, block - 1)).otherwise(F.array(block)))
    dealt = _ranked(_signed(distinct, p, range(p.passes) if numbers is None else numbers)).select(
        "cid", "label", "dim", "pass", "rank", blocks.alias("block"),
    )
    full = dealt.join(distinct.select("cid", "vec"), "cid").select("block", "rank", "pass", "label", "cid", "dim", "vec")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rank")
        rank, number, cid, dims = (group.column(c).to_numpy() for c in ("rank", "pass", "cid", "dim"))
        label = group.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        runs = np.stack([number, label, dims])
        own = rank // p.block == group.column("block")[0].as_py()
        rows = np.zeros((len(rank), int(dims.max())))
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            rows[at, :dim] = unit_rows(group.column("vec").combine_chunks().take(pa.array(at)))
        left, right = [], []
        for off in range(1, min(p.window, len(rank) - 1) + 1):
            ok = np.flatnonzero(own[:-off] & (runs[:, :-off] == runs[:, off:]).all(axis=0))
            near = ok[np.einsum("ij,ij->i", rows[ok], rows[ok + off]) >= p.least]
            left.append(cid[near])
            right.append(cid[near + off])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return full.groupBy("block").applyInArrow(compare, "a long, b long").distinct()


def _rounds(distinct: DataFrame, p: Passes) -> tuple[DataFrame, DataFrame]:
    """The pairs found and their components, after as many passes as the groups need and until a round unites nothing."""
    largest = distinct.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    done = needed(p, largest)
    pairs = cut(window_pairs(distinct, p, range(done)))
    linked = cut(components(pairs).withColumnRenamed("node", "cid"))
    while True:
        more = cut(window_pairs(distinct, p, range(done, done + p.passes)))
        done += p.passes
        ends = more
        for end in ("a", "b"):
            named = linked.select(F.col("cid").alias(end), F.col("component").alias(f"in_{end}"))
            ends = ends.join(named, end, "left").withColumn(f"in_{end}", F.coalesce(f"in_{end}", end))
        united = not ends.where("in_a <> in_b").isEmpty()
        pairs = cut(pairs.union(more).distinct())
        if not united:
            return pairs, linked
        linked = cut(components(pairs).withColumnRenamed("node", "cid"))


def _complete(members: DataFrame, p: Passes) -> DataFrame:
    """``(cid, links)`` for ``members(component, size, cid, n, vec)``: links of each class inside its component."""
    tiles = F.ceil(F.col("size") / p.tile).cast("long")
    own = members.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(F.lit(p.seed), "cid"), F.col("tiles")))
    sent = own.select("component", "cid", "n", "vec", "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
    keyed = sent.select(
        "component", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "cid", "n", "vec",
        (F.col("tile") <= F.col("other")).alias("low"), (F.col("tile") >= F.col("other")).alias("high"),
    )

    def count(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        cid, n = group.column("cid").to_numpy(), group.column("n").to_numpy()
        low, high = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("low", "high"))
        rows = unit_rows(group.column("vec").combine_chunks())
        near = rows[low] @ rows[high].T >= p.least
        near &= cid[low][:, None] != cid[high]
        out = [(cid[low], near @ n[high])]
        if group.column("lo")[0].as_py() != group.column("hi")[0].as_py():
            out.append((cid[high], n[low] @ near))
        return pa.table({"cid": np.concatenate([x for x, _ in out]), "links": np.concatenate([y for _, y in out]).astype(np.int64)})

    return keyed.groupBy("component", "lo", "hi").applyInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", passes: Passes | None = None,
) -> DataFrame:
    """One row per row of ``df``: ``(id, n_links, component_id, kept)``.

    Rows link if their labels are equal and not null, their vectors have one length and their
    cosine in double precision is at least ``least``; a vector that is null, empty, zero or holds
    null or non-finite components links with nothing, nor does a row with a null label: its own
    id is its component. ``n_links`` counts the other rows linked directly, copies included;
    ``component_id`` is the least id reachable. Repeated ids are rows of their own; a null id
    names no component and is kept only as a component of null ids. Other columns are ignored.
    """
    p = passes or Passes()
    distinct = classes(df, id_col, vec_col, label_col)
    pairs, linked = _rounds(distinct, p)
    sizes = linked.groupBy("component").agg(F.count("*").alias("size"))
    found = pairs.select(F.col("a").alias("cid")).join(linked, "cid").groupBy("component").agg(F.count("*").alias("pairs"))
    state = sizes.join(found, "component").withColumn("whole", F.col("pairs") * 2 == F.col("size") * (F.col("size") - 1))
    members = linked.join(state, "component").join(distinct.select("cid", "n", "vec"), "cid")
    both = pairs.select(F.col("a").alias("cid"), F.col("b").alias("mate")).union(pairs.select(F.col("b").alias("cid"), F.col("a").alias("mate")))
    listed = both.join(members.where("whole").select("cid"), "cid").join(
        distinct.select(F.col("cid").alias("mate"), "n"), "mate",
    ).groupBy("cid").agg(F.sum("n").alias("links"))
    links = listed.union(_complete(members.where("not whole").select("component", "size", "cid", "n", "vec"), p))
    named = distinct.join(linked, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    lookup = named.join(least, "component").join(links, "cid", "left").select(
        "label", "h", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id",
    )
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.xxhash64(vec_col).alias("h"), F.col(vec_col).alias("vec"))
    out = rows.join(lookup, ["label", "h", "vec"], "left")
    own = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.col("id").eqNullSafe(own).alias("kept"),
    )
