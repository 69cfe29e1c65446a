"""Statistics over the matrix: decomposition, bootstrap, distances, tree, order, summaries, matching."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.operators.matrix import countable, deviates, is_orphan

# Classes of the decomposition.
CLASSES = ("vorlage_explained", "shared_with_cowitness", "residual")


def decompose_units(
    cells: DataFrame, witness: str, sources: Sequence[str] = (), cowitness: str | None = None, reference: str | None = None,
) -> DataFrame:
    """``(unit, deviating, class)`` over the witness's countable units; class null where undecided."""
    own = cells.where((F.col("witness") == witness) & countable(F.col("status")) & ~is_orphan(F.col("unit"))).select(
        "unit", deviates(F.col("status")).alias("deviating"),
    )
    others = [s for s in sources if s != reference]
    flags = cells.where(F.col("witness").isin(*others, *([cowitness] if cowitness else []))) if others or cowitness else cells.where(F.lit(False))
    per = flags.groupBy("unit").agg(
        F.max(
            F.when(F.col("witness").isin(*others) & F.col("status").isin("ABSENT", "PARTIAL"), True).otherwise(False)
        ).alias("lacking") if others else F.max(F.lit(False)).alias("lacking"),
        F.max(F.when(F.col("witness") == (cowitness or ""), deviates(F.col("status")))).alias("co"),
    )
    joined = own.join(per, "unit", "left")
    kind = F.when(F.coalesce("lacking", F.lit(False)), CLASSES[0])
    if cowitness:
        kind = kind.when(F.col("co").isNull(), None).when(F.col("co"), CLASSES[1])
    return joined.select("unit", "deviating", F.when(F.col("deviating"), kind.otherwise(CLASSES[2])).alias("class"))


def decompose(units: DataFrame) -> DataFrame:
    """Counts of ``decompose_units`` and their rates over the countable units."""
    counts = units.agg(
        F.count("*").alias("n_counted"), F.count_if("deviating").alias("n_deviating"),
        *(F.count_if(F.col("class") == c).alias(c) for c in CLASSES),
    )
    return counts.select("*", *(F.round(F.col(c) / F.greatest(F.col("n_counted"), F.lit(1)), 4).alias(f"rate_{c}") for c in CLASSES))


def decompose_all(cells: DataFrame, wanted: DataFrame, sources: Sequence[str] = (), reference: str | None = None) -> DataFrame:
    """``decompose`` for each row of ``wanted(witness, cowitness)``, all in one pass over the cells.

    A null co-witness asks for the two-term decomposition.
    """
    others = [s for s in sources if s != reference]
    own = cells.where(countable(F.col("status")) & ~is_orphan(F.col("unit"))).select("unit", "witness", deviates(F.col("status")).alias("deviating"))
    lacking = F.max(F.col("status").isin("ABSENT", "PARTIAL"))
    source = cells.where(F.col("witness").isin(*others) if others else F.lit(False)).groupBy("unit").agg(lacking.alias("lacking"))
    co = own.select("unit", F.col("witness").alias("cowitness"), F.col("deviating").alias("co"))
    met = own.join(wanted, "witness").join(source, "unit", "left").join(co, ["unit", "cowitness"], "left")
    kind = F.when(F.coalesce("lacking", F.lit(False)), CLASSES[0]).when(F.col("cowitness").isNull(), CLASSES[2]).when(F.col("co").isNull(), None).when(F.col("co"), CLASSES[1]).otherwise(CLASSES[2])
    classed = met.withColumn("class", F.when(F.col("deviating"), kind))
    counts = classed.groupBy("witness", "cowitness").agg(
        F.count("*").alias("n_counted"), F.count_if("deviating").alias("n_deviating"),
        *(F.count_if(F.col("class") == c).alias(c) for c in CLASSES),
    )
    return counts.select("*", *(F.round(F.col(c) / F.col("n_counted"), 4).alias(f"rate_{c}") for c in CLASSES))


def deviations(cells: DataFrame) -> DataFrame:
    """``(witness, chapter, total, n)`` for all witnesses."""
    own = cells.where(countable(F.col("status")) & ~is_orphan(F.col("unit")))
    return own.groupBy("witness", "chapter").agg(F.sum(deviates(F.col("status")).cast("long")).cast("double").alias("total"), F.count("*").alias("n"))


def deviation_by_chapter(cells: DataFrame, witness: str) -> DataFrame:
    """``(chapter, total, n)``: deviating and countable units, all that a mean's bootstrap needs."""
    own = cells.where((F.col("witness") == witness) & countable(F.col("status")) & ~is_orphan(F.col("unit")))
    return own.groupBy("chapter").agg(F.sum(deviates(F.col("status")).cast("long")).cast("double").alias("total"), F.count("*").alias("n"))


#: Draws are worked out modulo this prime, by squares, so that any SQL engine gets the same ones.
PRIME = 2147483647


def draw(seed: int, boot: Column, place: Column, blocks: Column) -> Column:
    """The block that a round draws at a place: a fixed function of seed, round and place."""
    x = (F.lit(seed % PRIME).cast("long") + boot * 1000003 + place * 7919) % PRIME
    y = (x * x + 12345) % PRIME
    z = (y * y + x) % PRIME
    return ((z * z + y) % PRIME) % blocks


def bootstrap(
    blocks: DataFrame, order: str = "chapter", n_boot: int = 1000, alpha: float = 0.05, seed: int = 20260930, stat: Column | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """A statistic and its percentile interval by resampling whole blocks: ``(by…, estimate, lo, hi, n_blocks)``.

    Rows are ``(by…, order, total, n)``, one a block, and the statistic is their mean; or any rows with a
    block's name in ``order`` and any aggregate ``stat`` of their columns. Each round draws as many
    blocks as there are. Rounds and places are rows made on the executors; only the blocks' names of
    a group of ``by`` are numbered in one task. Without ``by`` there is one row, whatever the input.
    """
    group = list(by)
    kept = blocks.where("n > 0") if stat is None else blocks
    value = F.sum("total") / F.sum("n") if stat is None else stat
    rows = kept.withColumnRenamed(order, "_key")
    numbered = rows.select(*group, "_key").distinct()
    inside = Window.partitionBy(*group)
    numbered = numbered.withColumn(
        "_block", (F.row_number().over(inside.orderBy("_key")) - 1).cast("long"),
    ).withColumn("_all", F.count("*").over(inside))
    rounds = numbered.select(*group, "_block", "_all", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("_boot"))
    drawn = rounds.select(
        *group, "_boot", draw(seed, F.col("_boot"), F.col("_block"), F.col("_all")).alias("_block"),
    ).groupBy(*group, "_boot", "_block").agg(F.count("*").alias("_times"))
    repeated = drawn.join(numbered.select(*group, "_block", "_key"), [*group, "_block"]).join(rows, [*group, "_key"])
    if stat is None:
        repeated = repeated.withColumn("total", F.col("total") * F.col("_times")).withColumn("n", F.col("n") * F.col("_times"))
    else:
        repeated = repeated.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    values = repeated.groupBy(*group, "_boot").agg(value.alias("v"))
    lo, hi = math.floor(alpha / 2 * n_boot), min(n_boot - 1, math.ceil((1 - alpha / 2) * n_boot) - 1)
    ordered = values.groupBy(*group).agg(F.array_sort(F.collect_list("v")).alias("v"))
    whole = rows.groupBy(*group).agg(value.cast("double").alias("estimate"), F.count_distinct("_key").alias("n_blocks"))
    nan = F.lit(float("nan"))
    ends = [F.coalesce(F.try_element_at("v", F.lit(i + 1)).cast("double"), nan).alias(n) for i, n in ((lo, "lo"), (hi, "hi"))]
    met = whole.join(ordered, group, "left") if group else whole.join(ordered)  # one row each
    return met.select(*group, F.coalesce("estimate", nan).alias("estimate"), *ends, "n_blocks")


def witness_distances(cells: DataFrame, dims: Sequence[str], weights: dict[str, float] | None = None) -> DataFrame:
    """``(a, b, distance, n)`` for all pairs a < b: a unit's cells meet in one row, its pairs are summed before they are shuffled."""
    w = weights or {}
    side = cells.where(countable(F.col("status")) & ~is_orphan(F.col("unit")))
    per = side.groupBy("unit").agg(F.collect_list(F.struct("witness", "status", *dims)).alias("ws"))
    one = per.select("ws", F.explode("ws").alias("a"))
    pairs = one.select("a", F.explode(F.filter("ws", lambda x: x["witness"] > F.col("a.witness"))).alias("b"))
    apart = F.when(F.col("a.status") != F.col("b.status"), w.get("status", 1.0)).otherwise(0.0)
    for d in dims:
        apart = apart + F.coalesce(w.get(d, 1.0) * F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")), F.lit(0.0))
    return pairs.groupBy(F.col("a.witness").alias("a"), F.col("b.witness").alias("b")).agg(
        (F.sum(apart) / F.count("*")).alias("distance"), F.count("*").alias("n"),
    )


def distance_matrix(distances: DataFrame, witnesses: DataFrame) -> DataFrame:
    """All ordered pairs, the diagonal 0, pairs without a common unit null."""
    names = witnesses.select("witness")
    both = distances.select("a", "b", "distance").union(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    every = names.select(F.col("witness").alias("a")).join(names.select(F.col("witness").alias("b")))
    return every.join(both, ["a", "b"], "left").withColumn("distance", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("distance")))


def tree(names: Sequence[str], distance: dict[tuple[str, str], float | None]) -> str:
    """Average-linkage clustering as a Newick string.

    Works on the distances of the witnesses (a registry of columns), so on the driver. A missing
    distance counts as twice the largest plus one; of equal pairs the first in order of insertion
    is joined; branch lengths are not negative and have four decimals.
    """
    if not names:
        return ";"
    known = [v for v in distance.values() if v is not None]
    far = 2 * max(known, default=0.0) + 1
    label, height, members = dict(enumerate(names)), dict.fromkeys(range(len(names)), 0.0), {i: [i] for i in range(len(names))}

    def apart(x: int, y: int) -> float:
        pair = [(names[i], names[j]) for i in members[x] for j in members[y]]
        got = [distance.get(p, distance.get(p[::-1])) for p in pair]
        return sum(far if v is None else v for v in got) / len(got)

    while len(label) > 1:
        order = list(label)
        x, y = min(((a, b) for i, a in enumerate(order) for b in order[i + 1 :]), key=lambda p: apart(*p))
        up = apart(x, y) / 2
        new = max(label) + 1
        parts = (f"{label[c]}:{max(0.0, up - height[c]):.4f}" for c in (x, y))
        label[new], height[new], members[new] = f"({','.join(parts)})", up, members[x] + members[y]
        for c in (x, y):
            del label[c]
    return f"{next(iter(label.values()))};"


def kendall(orders: DataFrame, group: Sequence[str], item: str, a: str, b: str) -> DataFrame:
    """Share of discordant pairs of ``item`` between ranks ``a`` and ``b``, per group; 0 under two items."""
    keys = list(group)
    x, y = orders.alias("x"), orders.alias("y")
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    cond = F.col(f"x.{a}") < F.col(f"y.{a}")
    for s in same:
        cond = cond & s
    pairs = x.join(y, cond).groupBy(*(F.col(f"x.{k}").alias(k) for k in keys)).agg(
        F.count_if(F.col(f"x.{b}") > F.col(f"y.{b}")).alias("discordant"), F.count("*").alias("pairs"),
    )
    every = orders.groupBy(*keys).agg(F.count("*").alias("n_items"))
    return every.join(pairs, keys, "left").select(
        *keys, "n_items", F.coalesce(F.round(F.col("discordant") / F.col("pairs"), 4), F.lit(0.0)).alias("tau"),
    )


def order_deviation(wit: DataFrame, ref: DataFrame, group: Sequence[str], item: str, cut: int) -> DataFrame:
    """Order of shared items against the reference: tau, share of (over ``cut``, up to ``cut``)
    pairs with the former first, and the sequence. ``wit(group…, item, pos)``, ``ref(item, ref_pos)``."""
    keys = list(group)
    both = wit.join(ref, item)
    tau = kendall(both, keys, item, "ref_pos", "pos")
    late = both.where(F.col(item) > cut).alias("l")
    early = both.where(F.col(item) <= cut).alias("e")
    cond = F.lit(True)
    for k in keys:
        cond = cond & (F.col(f"l.{k}") == F.col(f"e.{k}"))
    share = late.join(early, cond).groupBy(*(F.col(f"l.{k}").alias(k) for k in keys)).agg(
        F.round(F.count_if(F.col("l.pos") < F.col("e.pos")) / F.count("*"), 4).alias("late_first_share")
    )
    seq = both.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", item))), lambda s: s[item].cast("string")), " ").alias("sequence")
    )
    return tau.join(share, keys, "left").join(seq, keys)


def summarise(values: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    """n, mean, median and the value at floor(0.9 (n-1)) of the sorted values, per group."""
    sorted_values = F.array_sort(F.collect_list(col))
    place = F.floor(F.lit(0.9) * (F.size(sorted_values) - 1)).cast("int") + 1
    return values.where(F.col(col).isNotNull()).groupBy(*group).agg(
        F.count(col).alias("n"), F.round(F.avg(col), 4).alias("mean"), F.round(F.median(col), 4).alias("median"), F.round(F.element_at(sorted_values, place), 4).alias("p90")
    )


def dimension(cells: DataFrame, dim: str) -> DataFrame:
    """``summarise`` of one deviation by witness, over present and partial cells of the reference's units."""
    some = F.col("status").isin("PRESENT", "PARTIAL") & ~is_orphan(F.col("unit"))
    return summarise(cells.where(some), ["witness"], dim)


#: Units of one block of ``match_candidates``. A task buffers the pairs of two blocks, some 130 bytes each.
BLOCK = 256


def _blocks(side: DataFrame, step: float) -> DataFrame:
    """Units of one chapter, kind and length in blocks of about ``BLOCK``, with the number of their band of lengths."""
    keys = ["chapter", "kind", "length"]
    counts = side.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_n"))
    dealt = side.join(counts, keys).withColumn("_part", F.pmod(F.xxhash64("unit"), F.col("_n")))
    one = dealt.groupBy(*keys, "_part").agg(F.collect_list(F.struct("unit")).alias("_rows"))  # in structs, as lists drop nulls
    return one.select(*keys, "_part", F.transform("_rows", lambda r: r["unit"]).alias("units"), F.floor(F.ln("length") / step).alias("band"))


def match_candidates(units: DataFrame, tolerance: float = 0.35) -> DataFrame:
    """Pairs of a sensitive and a neutral unit of one chapter and kind with like lengths.

    ``units(unit, chapter, kind, length, sensitive)``; lengths are floored at 1. Every pair is listed,
    so the rows grow with the square of a group. Lengths are compared once for two blocks of units,
    not for each pair; bands of lengths a little wider than the tolerance keep far ones from meeting.
    Pairs of blocks are dealt over all tasks, whatever their groups, and written out row by row.
    """
    side = units.withColumn("length", F.greatest(F.lit(1), F.col("length")))
    step = max(tolerance, 0.0) + 1e-6
    u = _blocks(side.where("sensitive"), step).withColumn("band", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1))))).alias("u")
    v = _blocks(side.where("not sensitive"), step).alias("v")
    near = F.abs(F.ln(F.col("v.length") / F.col("u.length"))) <= tolerance
    same = [F.col(f"u.{k}") == F.col(f"v.{k}") for k in ("chapter", "kind", "band")]
    ids = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "uv" for c in ("length", "_part", "units")]
    met = u.join(v, [*same, near]).select(F.col("u.chapter").alias("chapter"), F.col("u.kind").alias("kind"), *ids)
    spark = units.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = met.repartition(tasks, "chapter", "kind", "u_length", "u__part", "v_length", "v__part")
    return dealt.select("chapter", "kind", F.explode("u_units").alias("unit"), "v_units").select(
        "chapter", "kind", "unit", F.explode("v_units").alias("mate"),
    )


def match(units: DataFrame, order: str = "unit", tolerance: float = 0.35, seed: int = 20260930) -> DataFrame:
    """Greedy 1:1 matching inside chapter and kind: sensitive units in order take the first free
    neutral unit of like length; the neutral ones are in a seeded hash order."""
    bound = tolerance

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = pdf[pdf.sensitive].sort_values("ord")
        pool = pdf[~pdf.sensitive].sort_values(["mark", "unit"]).to_dict("records")
        out = []
        for u in wanted.to_dict("records"):
            hit = next((i for i, v in enumerate(pool) if abs(math.log(v["length"] / u["length"])) <= bound), None)
            if hit is not None:
                out.append((u["chapter"], u["kind"], u["unit"], pool.pop(hit)["unit"]))
        return pd.DataFrame(out, columns=["chapter", "kind", "unit", "mate"])

    side = units.select(
        "unit", "chapter", "kind", F.greatest(F.lit(1.0), F.col("length").cast("double")).alias("length"), "sensitive",
        F.col(order).alias("ord"), F.md5(F.concat_ws(":", F.lit(str(seed)), "unit")).alias("mark"),
    )
    return side.groupBy("chapter", "kind").applyInPandas(run, "chapter string, kind string, unit string, mate string")


def matched_contrast(pairs: DataFrame, cells: DataFrame, witness: str) -> DataFrame:
    """``(chapter, total, n)`` of deviation differences over matched pairs whose cells count on both sides."""
    own = cells.where((F.col("witness") == witness) & countable(F.col("status"))).select("unit", deviates(F.col("status")).cast("long").alias("d"))
    both = pairs.join(own.withColumnRenamed("d", "du"), "unit").join(own.select(F.col("unit").alias("mate"), F.col("d").alias("dv")), "mate")
    return both.groupBy("chapter").agg(F.sum(F.col("du") - F.col("dv")).cast("double").alias("total"), F.count("*").alias("n"))


def indicator_blocks(df: DataFrame, block: Column, indicator: Column) -> DataFrame:
    return df.groupBy(block.alias("chapter")).agg(F.sum(indicator.cast("long")).cast("double").alias("total"), F.count("*").alias("n"))
