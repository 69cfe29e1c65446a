"""The units × witnesses matrix: cells, upsert, calibration, structure, wide pivots, ordering.

``units(unit, chapter, kind, text, length, position, flag)`` and ``cells(unit, witness, status,
d_*, similarity, …)`` are DataFrames; every step maps DataFrames to DataFrames, and chapters and
witnesses are partitions of one job, never a loop on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions.similarity import LN2

# Statuses and dimensions.
STATUSES = ("PRESENT", "PARTIAL", "ABSENT", "LACUNA", "NA", "UNALIGNED")
COUNTED = ("PRESENT", "PARTIAL", "ABSENT")
#: a residual this near to the threshold is on it; rounding noise of logarithms stays below
TIE = 1e-9
DIMS = ("d_cov", "d_len", "d_lit", "d_ord", "d_split", "d_lex")


def countable(status: Column) -> Column:
    return status.isin(*COUNTED)


def deviates(status: Column) -> Column:
    """True or false for countable cells, else null."""
    return F.when(countable(status), status != "PRESENT")


def is_orphan(unit: Column) -> Column:
    return unit.startswith("+")


def positions(df: DataFrame, group: Sequence[str], order: str, length: str) -> DataFrame:
    """Adds ``before`` (lengths ahead) and ``position`` (mid-point over the group's total)."""
    run = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(length).over(run), F.lit(0))
    total = F.sum(length).over(Window.partitionBy(*group))
    return df.withColumn("before", before).withColumn("position", (F.col("before") + F.col(length) / 2) / total)


def mint_units(segments: DataFrame, chapter: str = "chapter", order: str = "seq", style: str = "t%04d") -> DataFrame:
    """Units from reference segments with ``length``: numbered ids and positions in their chapter."""
    number = F.row_number().over(Window.partitionBy(chapter).orderBy(order))
    floored = segments.withColumn("length", F.greatest(F.lit(1), F.col("length")))
    return positions(floored, [chapter], order, "length").withColumn("unit", F.concat(F.col(chapter), F.lit("."), F.format_string(style, number)))


def upsert(cells: DataFrame, order: str, keys: Sequence[str] = ("unit", "witness"), last: bool = True) -> DataFrame:
    """One row per key: the last written (or the first)."""
    o = F.col(order).desc() if last else F.col(order).asc()
    return cells.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(o))).where("_n = 1").drop("_n")


def witness_order(cells: DataFrame, order: str) -> DataFrame:
    """``(witness, ord)`` by first write."""
    first = cells.groupBy("witness").agg(F.min(order).alias("first"))
    return first.select("witness", (F.row_number().over(Window.orderBy("first", "witness")) - 1).alias("ord"))


def edition_cells(units: DataFrame, edition: DataFrame, witness: str) -> DataFrame:
    """Cells of an edition matched by id: missing NA, flagged LACUNA or ABSENT, blank ABSENT."""
    found = units.select("unit", "chapter", "kind").join(edition.select("unit", "text", "flag", F.lit(True).alias("has")), "unit", "left")
    text = F.coalesce("text", F.lit(""))
    status = (
        F.when(F.col("has").isNull(), "NA")
        .when(F.col("flag") == "LACUNA", "LACUNA")
        .when((F.col("flag") == "ABSENT") | (F.length(F.trim(F.coalesce("text", F.lit("")))) == 0), "ABSENT")
        .otherwise("PRESENT")
    )
    span = F.when(F.col("has"), F.col("unit"))
    rows = found.select(
        "unit", F.lit(witness).alias("witness"), "chapter", "kind", status.alias("status"), span.alias("span_start"),
        span.alias("span_end"), F.when(F.col("has"), F.substring(text, 1, 80)).alias("text"),
    )
    return rows.withColumn(
        "d_cov", F.when(F.col("status") == "PRESENT", 1.0).when(F.col("status") != "NA", 0.0),
    ).withColumn("d_split", F.when(F.col("status") != "NA", 0.0))


def fill_missing(units: DataFrame, cells: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Cells for chapters a witness has nothing of: NA for partial scopes, else UNALIGNED.

    ``witnesses(witness, scope)``. Units of chapters that have any cell stay as they are.
    """
    done = cells.join(units.select("unit", "chapter"), "unit").select("witness", "chapter").distinct() if "chapter" not in cells.columns else cells.select("witness", "chapter").distinct()
    every = units.select("unit", "chapter", "kind").join(witnesses)  # every unit has a cell for every witness
    left = every.join(done, ["witness", "chapter"], "left_anti")
    return left.select(
        "unit", "witness", "chapter", "kind",
        F.when(F.col("scope").isin("anthology", "fragment", "quotation"), "NA").otherwise("UNALIGNED").alias("status"),
    )


def calibrate(cells: DataFrame) -> DataFrame:
    """Length residuals: minus the median by witness and kind over present cells; far below is PARTIAL."""
    usable = (F.col("status") == "PRESENT") & F.col("d_len").isNotNull() & ~is_orphan(F.col("unit"))
    medians = cells.where(usable).groupBy("witness", "kind").agg(F.median("d_len").alias("_m"))
    joined = cells.join(medians, ["witness", "kind"], "left")
    residual = F.when(F.col("d_len").isNotNull() & F.col("_m").isNotNull(), F.col("d_len") - F.col("_m"))
    partial = (F.col("status") == "PRESENT") & ~is_orphan(F.col("unit")) & (residual < -LN2 - TIE)
    out = joined.withColumn("_p", F.coalesce(partial, F.lit(False))).withColumn("_r", F.coalesce(residual, F.col("d_len")))
    return out.select(
        *(
            F.when(F.col("_p"), "PARTIAL").otherwise(F.col("status")).alias(c) if c == "status"
            else F.when(F.col("_p"), 0.5).otherwise(F.col("d_cov")).alias(c) if c == "d_cov"
            else F.col("_r").alias(c) if c == "d_len"
            else F.col(c)
            for c in cells.columns
        )
    )


def structure(cells: DataFrame, chapters: DataFrame, witnesses: DataFrame, dims: Sequence[str] = ("d_len", "d_lit", "d_ord", "d_lex")) -> DataFrame:
    """Per chapter and witness, empty pairs included: counts, coverage and mean deviations."""
    orphan, counted = is_orphan(F.col("unit")), countable(F.col("status"))
    some = ~orphan & F.col("status").isin("PRESENT", "PARTIAL")
    one = cells.groupBy("chapter", "witness").agg(
        F.count_if(~orphan).alias("n_units"),
        F.count_if(~orphan & counted).alias("n_counted"),
        F.count_if(some).alias("n_present"),
        F.count_if(~orphan & (F.col("status") == "ABSENT")).alias("n_absent"),
        F.count_if(orphan).alias("n_orphan"),
        *(F.round(F.avg(F.when(some, F.col(d))), 4).alias(f"mean_{d}") for d in dims if d in cells.columns),
    )
    counts = ["n_units", "n_counted", "n_present", "n_absent", "n_orphan"]
    full = chapters.select("chapter").join(witnesses.select("witness")).join(one, ["chapter", "witness"], "left").na.fill(0, counts)
    return full.withColumn("coverage", F.round(F.col("n_present") / F.nullif(F.col("n_counted"), F.lit(0)), 4))


def wide(cells: DataFrame, dim: str, witnesses: Sequence[str]) -> DataFrame:
    """Units × witnesses for one dimension, unrounded; the witnesses are given, so no job looks for them."""
    return cells.groupBy("unit", "chapter").pivot("witness", list(witnesses)).agg(F.first(dim))


def long_rows(cells: DataFrame, digits: int = 4) -> DataFrame:
    """Cells with deviations and similarity rounded."""
    rounded = {*DIMS, "similarity"}
    return cells.select(*(F.round(c, digits).alias(c) if c in rounded else F.col(c) for c in cells.columns))


def length_table(ref: DataFrame, wit: DataFrame, bridge: DataFrame) -> DataFrame:
    """Reference and witness lengths per chapter; ratios pool the chapters that share a local key.

    ``ref(chapter, length)``, ``wit(witness, local, length)``, ``bridge(chapter, witness, local)``
    with null ``local`` where a chapter has no counterpart.
    """
    by_ref = ref.groupBy("chapter").agg(F.sum("length").alias("ref_length"))
    by_wit = wit.groupBy("witness", "local").agg(F.sum("length").alias("witness_length"))
    rows = bridge.join(by_ref, "chapter", "left").na.fill(0, ["ref_length"]).join(by_wit, ["witness", "local"], "left").na.fill(0, ["witness_length"])
    pooled = rows.where("local is not null").groupBy("witness", "local").agg(
        F.sum("ref_length").alias("_pool"), F.array_join(F.array_sort(F.collect_list("chapter")), "+").alias("merged_group"),
    )
    out = rows.join(pooled, ["witness", "local"], "left")
    ratio = F.round(F.nullif(F.col("witness_length"), F.lit(0)) / F.nullif(F.col("_pool"), F.lit(0)), 3)
    return out.select(
        "chapter", "witness", F.coalesce("local", F.lit("")).alias("witness_local"),
        F.coalesce("merged_group", F.lit("")).alias("merged_group"), "ref_length", "witness_length", ratio.alias("ratio_pooled"),
    )
