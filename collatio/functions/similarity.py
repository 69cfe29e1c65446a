"""Similarity as columns: n-gram Dice and recall, weighted Jaccard, cosine, length cost."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(c: Column, n: int, whole: bool = True) -> Column:
    """Distinct character n-grams; a shorter text is its own gram (with ``whole``) or has none."""
    # characters once, then neighbours joined: linear, where a substring per place would not be
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    count = F.greatest(F.lit(0), F.length(c) - n + 1)
    several = F.slice(chars, F.lit(1), count)
    for k in range(1, n):
        several = F.zip_with(several, F.slice(chars, F.lit(k + 1), count), lambda a, b: F.concat(a, b))
    several = F.array_distinct(several)
    none = F.array().cast("array<string>")
    short = F.when(F.length(c) > 0, F.array(c)).otherwise(none) if whole else none
    return F.when(F.length(c) >= n, several).otherwise(short)


def dice_grams(c: Column) -> Column:
    """Distinct characters and pairs of characters: what ``dice`` compares, to be made once a text."""
    return F.array_distinct(F.concat(grams(c, 1), grams(c, 2)))


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of two lists of distinct n-grams; 0 if a side is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient over characters and pairs of characters; 0 if a side is empty."""
    return dice_of(dice_grams(a), dice_grams(b))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def gram_recall(truth: Column, output: Column, n: int = 4) -> Column:
    """Share of the truth's n-grams that the output has; 0 if the truth is too short."""
    t, o = grams(squeeze(truth), n, False), grams(squeeze(output), n, False)
    return F.when(F.size(t) > 0, F.size(F.array_intersect(t, o)) / F.size(t)).otherwise(F.lit(0.0))


def gram_rows(df: DataFrame, keys: Sequence[str], text: str, n: int) -> DataFrame:
    """A row ``(keys…, g)`` for each distinct n-gram of each text.

    A map over Arrow batches: a built-in substring counts code points from the text's start, which
    is quadratic in long texts.
    """
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in enumerate(batch.column(text).to_pylist()):
                found = sorted({t[i : i + n] for i in range(len(t or "") - n + 1)}) if t else []
                if found:
                    at = pa.array([row] * len(found))
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in keys), pa.array(found, pa.string())], names=[*keys, "g"])

    return df.select(*keys, text).mapInArrow(run, ", ".join([*fields, "g string"]))


def jaccard(a: Column, b: Column, heavy: str = "num:", weight: float = 2.0) -> Column:
    """Weighted Jaccard of two distinct key lists; keys that begin with ``heavy`` weigh more."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, k: s + F.when(k.startswith(heavy), weight).otherwise(1.0))

    union = total(F.array_union(a, b))
    return F.when(union > 0, total(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a vector of length 0 counts as length 1."""
    na, nb = (F.sqrt(dot(x, x)) for x in (a, b))
    one = F.lit(1.0)
    return dot(a, b) / (F.when(na == 0, one).otherwise(na) * F.when(nb == 0, one).otherwise(nb))


def length_cost(ref: Column, wit: Column, ratio: Column, variance: float = 6.8) -> Column:
    """Half the squared deviation of the witness length from ``ratio`` times the reference length."""
    z = (wit - ratio * ref) / F.sqrt(F.lit(variance) * ref)
    return 0.5 * z * z


def hybrid(anchor: Column, vector: Column, weight: float = 0.8) -> Column:
    return F.greatest(anchor, weight * vector)


LN2 = math.log(2.0)
