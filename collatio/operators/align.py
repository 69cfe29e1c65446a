"""Monotone alignment of reference and witness segments, chapter by chapter, with gaps.

Beads join one to three segments of either side (1:1, 1:2, 2:1, 2:2, 1:3, 3:1) or leave one
without partner (1:0, 0:1). ``bead_candidates`` has every two-sided bead's cost as a relation;
``align`` finds the cheapest sequence of beads per group. Groups are independent: a cogrouped map
solves each with numpy, along the diagonals of its table, so witness and chapter are the
partitioning and memory is one chapter's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import similarity as S
from collatio.operators.matrix import positions

#: Two-sided beads (reference, witness), in the order in which equal costs are preferred.
TWO_SIDED = ((3, 1), (2, 2), (2, 1), (1, 3), (1, 2), (1, 1))
BEADS_SCHEMA = "grp string, bead_no int, ref array<int>, wit array<int>, cost double, similarity double"


@dataclass(frozen=True)
class Params:
    prior_null: float = 3.0
    prior_12: float = 2.4
    prior_22: float = 4.5
    prior_13: float = 4.0
    length_weight: float = 1.0
    variance: float = 6.8
    anchor_weight: float = 8.0
    conflict: float = 2.0

    def prior(self, k: int, l: int) -> float:  # noqa: E741
        return {(1, 1): 0.0, (1, 2): self.prior_12, (2, 1): self.prior_12, (2, 2): self.prior_22, (1, 3): self.prior_13, (3, 1): self.prior_13}[k, l]


# ---- similarity of spans: each backend turns a side's payloads into rows whose products compare all pairs


class CharGrams:
    """Dice over characters and pairs of characters of the joined texts."""

    conflicts = False

    def features(self, payloads: Sequence[str], k: int) -> list[set[str]]:
        joined = ["".join(payloads[i : i + k]) for i in range(len(payloads) - k + 1)]
        return [set(t) | {t[j : j + 2] for j in range(len(t) - 1)} for t in joined]

    def compare(self, a: list, b: list) -> np.ndarray:
        both, x, y = _shared(a, b)
        size = x[:, None] + y
        return np.where((x > 0)[:, None] & (y > 0), 2 * both / np.maximum(size, 1), 0.0)

    def marked(self, a: list, b: list) -> np.ndarray:
        return np.zeros((len(a), len(b)), bool)


class Anchors:
    """Weighted Jaccard of anchor keys; sides that both have anchors but share none conflict."""

    conflicts = True

    def features(self, payloads: Sequence[Sequence[str]], k: int) -> list[set[str]]:
        return [set().union(*map(set, payloads[i : i + k])) for i in range(len(payloads) - k + 1)]

    def compare(self, a: list, b: list) -> np.ndarray:
        both, x, y = _shared(a, b, lambda key: 2.0 if key.startswith("num:") else 1.0)
        union = x[:, None] + y - both
        return np.where(union > 0, both / np.maximum(union, 1e-300), 0.0)

    def marked(self, a: list, b: list) -> np.ndarray:
        return np.array([bool(s) for s in a])[:, None] & np.array([bool(s) for s in b])


class Vectors:
    """Cosine of mean vectors, not below 0."""

    conflicts = False

    def features(self, payloads: Sequence[Sequence[float]], k: int) -> list[np.ndarray]:
        v = [np.asarray(p, float) for p in payloads]
        return [np.mean(v[i : i + k], axis=0) for i in range(len(v) - k + 1)]

    def compare(self, a: list, b: list) -> np.ndarray:
        x, y = (np.array(s) / np.array([np.linalg.norm(r) or 1.0 for r in s])[:, None] for s in (a, b))
        return np.maximum(0.0, x @ y.T)

    def marked(self, a: list, b: list) -> np.ndarray:
        return np.zeros((len(a), len(b)), bool)


class Hybrid:
    """The larger of anchor similarity and weighted cosine; payloads are (anchors, vector)."""

    conflicts = True

    def __init__(self, weight: float = 0.8):
        self.weight, self.anchors, self.vectors = weight, Anchors(), Vectors()

    def features(self, payloads: Sequence, k: int) -> list:
        return list(zip(self.anchors.features([p[0] for p in payloads], k), self.vectors.features([p[1] for p in payloads], k)))

    def compare(self, a: list, b: list) -> np.ndarray:
        one = self.anchors.compare([x for x, _ in a], [x for x, _ in b])
        return np.maximum(one, self.weight * self.vectors.compare([v for _, v in a], [v for _, v in b]))

    def marked(self, a: list, b: list) -> np.ndarray:
        return self.anchors.marked([x for x, _ in a], [x for x, _ in b])


def backend(name: str, weight: float = 0.8):
    """Similarity by name: chargrams, anchors, embedding or hybrid."""
    kinds = {"chargrams": CharGrams, "anchors": Anchors, "embedding": Vectors, "hybrid": lambda: Hybrid(weight)}
    if name not in kinds:
        raise ValueError(f"unknown similarity {name!r}: one of {', '.join(kinds)}")
    return kinds[name]()


#: Keys that are compared at once: a side's part is a dense matrix of its spans and so many keys.
TILE = 4096


def _shared(a: list[set], b: list[set], weigh: Callable[[str], float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of the keys that each pair of sets shares, and each set's own weight.

    Only keys of both sides are compared, a tile of them at a time.
    """
    own = [np.array([float(sum(map(weigh, s))) if weigh else float(len(s)) for s in side]) for side in (a, b)]
    keys = sorted(set().union(*a) & set().union(*b))
    place = {k: i for i, k in enumerate(keys)}
    sides = []
    for side in (a, b):
        at = [[place[k] for k in s if k in place] for s in side]
        row = np.repeat(np.arange(len(side)), [len(x) for x in at])
        key = np.fromiter((k for x in at for k in x), np.int64, len(row))
        order = np.argsort(key, kind="stable")
        sides.append((row[order], key[order], len(side)))
    weight = np.array([weigh(k) for k in keys], np.float32) if weigh else np.ones(len(keys), np.float32)
    both = np.zeros((len(a), len(b)))
    for begin in range(0, len(keys), TILE):
        tiles = []
        for row, key, n in sides:
            part = slice(*np.searchsorted(key, (begin, begin + TILE)))
            tile = np.zeros((n, min(TILE, len(keys) - begin)), np.float32)
            tile[row[part], key[part] - begin] = 1
            tiles.append(tile)
        both += (tiles[0] * weight[begin : begin + TILE]) @ tiles[1].T
    return both, *own


#: Costs this near to each other are equal: what is left is rounding.
EVEN = 1e-9


def solve(
    ref_len: Sequence[float], wit_len: Sequence[float], ref: Sequence, wit: Sequence, sim, p: Params, ratio: float | None = None,
) -> list[tuple[list[int], list[int], float, float]]:
    """The cheapest beads ``(ref indices, wit indices, cost, similarity)`` of one group.

    The table is filled diagonal by diagonal (reference plus witness segments used), a whole
    diagonal at once; of equal costs the bead named first in TWO_SIDED, then 1:0, then 0:1 wins.
    """
    n, m = len(ref_len), len(wit_len)
    lr, lw = (np.maximum(1.0, np.asarray(x, float)) for x in (ref_len, wit_len))
    c = ratio if ratio is not None else (lw.sum() / lr.sum() if n else 1.0)
    cr, cw = np.concatenate([[0], np.cumsum(lr)]), np.concatenate([[0], np.cumsum(lw)])
    cost: dict[tuple[int, int], np.ndarray] = {}
    like: dict[tuple[int, int], np.ndarray] = {}
    spans_r = {k: sim.features(ref, k) for k in (1, 2, 3) if k <= n}
    spans_w = {k: sim.features(wit, k) for k in (1, 2, 3) if k <= m}
    for k, l in TWO_SIDED:  # noqa: E741
        if k > n or l > m:
            continue
        s = sim.compare(spans_r[k], spans_w[l])
        a, b = (cr[k:] - cr[:-k])[:, None], (cw[l:] - cw[:-l])[None, :]
        z = (b - c * a) / np.sqrt(p.variance * a)
        x = p.prior(k, l) + p.length_weight * 0.5 * z * z - p.anchor_weight * s
        if sim.conflicts:
            x = x + p.conflict * ((s == 0) & sim.marked(spans_r[k], spans_w[l]))
        cost[k, l], like[k, l] = x, s
    best = np.full((n + 1, m + 1), np.inf)
    best[0, 0] = 0.0
    back = np.full((n + 1, m + 1), -1)
    shapes = [*TWO_SIDED, (1, 0), (0, 1)]
    for d in range(1, n + m + 1):
        i = np.arange(max(0, d - m), min(n, d) + 1)
        j = d - i
        top, arg = np.full(len(i), np.inf), np.full(len(i), -1)
        for number, (k, l) in enumerate(shapes):  # noqa: E741
            ok = (i >= k) & (j >= l)
            if not ok.any() or (k and l and (k, l) not in cost):
                continue
            a, b = i[ok] - k, j[ok] - l
            v = best[a, b] + (cost[k, l][a, b] if k and l else p.prior_null)
            at = np.flatnonzero(ok)
            less = v < top[at] - EVEN
            top[at[less]], arg[at[less]] = v[less], number
        best[i, j], back[i, j] = top, arg
    beads = []
    i, j = n, m
    while i or j:
        k, l = shapes[back[i, j]]  # noqa: E741
        a, b = i - k, j - l
        two = bool(k and l)
        beads.append(
            (list(range(a, i)), list(range(b, j)), float(cost[k, l][a, b]) if two else p.prior_null, float(like[k, l][a, b]) if two else 0.0)
        )
        i, j = a, b
    return beads[::-1]


def align(ref: DataFrame, wit: DataFrame, sim="chargrams", params: Params | None = None) -> DataFrame:
    """Beads of every group of ``ref`` and ``wit`` ``(grp, seq, length, payload)``, as BEADS_SCHEMA.

    ``payload`` is what the similarity compares: a text, anchor keys, a vector, or a struct of
    the last two. Indices count a group's segments from 0 in ``seq`` order. A group that only one
    side has consists of gaps.
    """
    p = params or Params()
    kind = backend(sim) if isinstance(sim, str) else sim

    def run(key: tuple, r: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        r, w = r.sort_values("seq"), w.sort_values("seq")
        lists = [[tuple(x.values()) if isinstance(x, dict) else x for x in side.payload] for side in (r, w)]
        beads = solve(r.length.tolist(), w.length.tolist(), *lists, kind, p)
        return pd.DataFrame([(key[0], i, *b) for i, b in enumerate(beads)], columns=["grp", "bead_no", "ref", "wit", "cost", "similarity"])

    # renamed afresh: both sides may come from one table
    ref, wit = (side.select(*(F.col(c).alias(c) for c in ("grp", "seq", "length", "payload"))) for side in (ref, wit))
    return ref.groupBy("grp").cogroup(wit.groupBy("grp")).applyInPandas(run, BEADS_SCHEMA)


def spans(side: DataFrame, sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """``(grp, first, k, length, text)``: all runs of one to three consecutive segments, natively."""
    w = Window.partitionBy("grp").orderBy("seq")
    rows = side.withColumn("first", F.row_number().over(w) - 1)
    ahead = w.rowsBetween(0, max(sizes) - 1)
    rows = rows.withColumn(
        "next", F.collect_list(F.struct(F.greatest(F.lit(1), F.col("length")).cast("double").alias("length"), "payload")).over(ahead),
    )
    cut = rows.select(
        "grp", "first", F.explode(F.array(*map(F.lit, sizes))).alias("k"), "next",
    ).where(F.size("next") >= F.col("k")).withColumn("part", F.slice("next", F.lit(1), F.col("k")))
    total = F.aggregate("part", F.lit(0.0), lambda s, x: s + x["length"])
    return cut.select("grp", "first", "k", total.alias("length"), F.array_join(F.transform("part", lambda x: x["payload"]), "").alias("text"))


def expected_ratio(ref: DataFrame, wit: DataFrame) -> DataFrame:
    """``(grp, ratio)`` of witness to reference length; 1 where the reference side is empty."""
    a = ref.groupBy("grp").agg(F.sum(F.greatest(F.lit(1), F.col("length"))).alias("r"))
    b = wit.groupBy("grp").agg(F.sum(F.greatest(F.lit(1), F.col("length"))).alias("w"))
    return a.join(b, "grp", "full").select(
        "grp", F.when(F.coalesce("r", F.lit(0)) > 0, F.coalesce("w", F.lit(0)) / F.col("r")).otherwise(1.0).alias("ratio"),
    )


def _for_partners(side: DataFrame, mine: int, other: str, own: str) -> DataFrame:
    """Spans with their n-grams, once for each size of a partner's span that makes a bead."""
    sizes: dict[int, list[int]] = {}
    for shape in TWO_SIDED:
        sizes.setdefault(shape[mine], []).append(shape[1 - mine])
    partner = None
    for n, others in sizes.items():
        these = F.array(*map(F.lit, others))
        partner = F.when(F.col("k") == n, these) if partner is None else partner.when(F.col("k") == n, these)
    gram = spans(side).withColumn("grams", S.dice_grams(F.col("text")))
    return gram.select("grp", "first", F.col("k").alias(own), F.explode(partner).alias(other), "length", "grams")


def bead_candidates(ref: DataFrame, wit: DataFrame, params: Params | None = None) -> DataFrame:
    """Costs of all two-sided beads under character-gram similarity, as a relation.

    Both sides meet by group and shape alone; n-grams are made once a span, before they meet.
    """
    p = params or Params(conflict=0.0)
    prior = None
    for k, l in TWO_SIDED:  # noqa: E741
        hit = (F.col("k") == k) & (F.col("l") == l)
        prior = F.when(hit, p.prior(k, l)) if prior is None else prior.when(hit, p.prior(k, l))
    r = _for_partners(ref, 0, "l", "k").select("grp", "k", "l", F.col("first").alias("i"), F.col("length").alias("lr"), F.col("grams").alias("gr"))
    w = _for_partners(wit, 1, "k", "l").select("grp", "k", "l", F.col("first").alias("j"), F.col("length").alias("lw"), F.col("grams").alias("gw"))
    met = r.join(w, ["grp", "k", "l"]).withColumn(
        "similarity", S.dice_of(F.col("gr"), F.col("gw")),
    ).drop("gr", "gw").join(expected_ratio(ref, wit), "grp")
    cost = prior + p.length_weight * S.length_cost(F.col("lr"), F.col("lw"), F.col("ratio"), p.variance) - p.anchor_weight * F.col("similarity")
    return met.select("grp", "i", "j", "k", "l", "similarity", cost.alias("cost"))


def shape_of(ref: Column, wit: Column) -> Column:
    return F.concat_ws(":", F.size(ref).cast("string"), F.size(wit).cast("string"))


def alignment_summary(beads: DataFrame) -> DataFrame:
    """Beads per group and shape."""
    return beads.groupBy("grp", shape_of(F.col("ref"), F.col("wit")).alias("shape")).agg(F.count("*").alias("n"))


def no_density(text: Column, lang: Column) -> Column:
    return F.lit(0.0)


def cells_from_beads(
    beads: DataFrame, units: DataFrame, wits: DataFrame, witness: Column | str, density: Callable[[Column, Column], Column] = no_density,
) -> DataFrame:
    """Cells of aligned groups; ``witness`` is a name, or a column computed from ``grp``.

    ``units(grp, seq, unit, chapter, kind, length, position, flag)``,
    ``wits(grp, seq, start, end, text, lang, kind, length, position)``. A bead n:m gives its n
    units one cell each with shared span and deviations, n:0 absent (or lacunose) units, 0:m one
    orphan named by the witness and its coordinates. ``density(text, lang)`` is the share of
    transliteration in a bead's text, its segments with blanks between.
    """
    witness = F.lit(witness) if isinstance(witness, str) else witness
    index = lambda df: df.withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("seq")) - 1)
    u, w = index(units), index(wits)
    b = beads.withColumn("bead", shape_of(F.col("ref"), F.col("wit")))
    wit_side = (
        b.select("grp", "bead_no", F.explode("wit").alias("i"))
        .join(w, ["grp", "i"])
        .groupBy("grp", "bead_no")
        .agg(
            F.min_by("start", "i").alias("span_start"), F.max_by("end", "i").alias("span_end"), F.min_by("kind", "i").alias("wit_kind"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ").alias("text"),
            F.sum("length").alias("lw"), F.avg("position").alias("pos_w"), F.min_by("lang", "i").alias("lang"),
        )
        .withColumn("density", density(F.col("text"), F.col("lang")))
    )
    ref_side = b.select("grp", "bead_no", F.explode("ref").alias("i")).join(u, ["grp", "i"])
    sums = ref_side.groupBy("grp", "bead_no").agg(F.sum("length").alias("lr"), F.count("*").alias("n"))
    both = b.select(
        "grp", "bead_no", "bead", "similarity", F.size("wit").alias("m"),
    ).join(wit_side, ["grp", "bead_no"], "left").join(sums, ["grp", "bead_no"], "left")
    matched = F.col("m") > 0
    on_units = ref_side.select("grp", "bead_no", "unit", "chapter", "kind", "position", "flag").join(both, ["grp", "bead_no"])
    unit_cells = on_units.select(
        "grp", "bead_no", "unit", witness.alias("witness"), "chapter", "kind",
        F.when(matched, "PRESENT").when(F.col("flag") == "LACUNA", "LACUNA").otherwise("ABSENT").alias("status"),
        "span_start", "span_end", "bead", F.when(matched, 1.0).otherwise(0.0).alias("d_cov"),
        F.when(matched, F.ln(F.col("lw") / F.col("lr"))).alias("d_len"), F.when(matched, F.col("density")).alias("d_lit"),
        F.when(matched, F.abs(F.col("pos_w") - F.col("position"))).alias("d_ord"), F.when(
            matched, F.ln((F.col("n") * F.col("m")).cast("double")),
        ).otherwise(0.0).alias("d_split"),
        F.lit(None).cast("double").alias("d_lex"), "similarity", F.substring("text", 1, 80).alias("text"), F.lit("auto").alias("provenance"),
    )
    orphan = F.concat(
        F.lit("+"), witness, F.lit(":"),
        F.when(F.col("span_start") == F.col("span_end"), F.col("span_start")).otherwise(F.concat_ws("-", "span_start", "span_end")),
    )
    nothing = F.lit(None).cast("double")
    orphans = both.where("n is null").select(
        "grp", "bead_no", orphan.alias("unit"), witness.alias("witness"), F.col("grp").alias("chapter"), F.col("wit_kind").alias("kind"), F.lit("PRESENT").alias("status"), "span_start", "span_end", "bead",
        nothing.alias("d_cov"), nothing.alias("d_len"), F.col("density").alias("d_lit"), nothing.alias("d_ord"), F.lit(0.0).alias("d_split"), nothing.alias("d_lex"),
        F.lit(0.0).alias("similarity"), F.substring("text", 1, 80).alias("text"), F.lit("auto").alias("provenance"),
    )
    return unit_cells.unionByName(orphans)


def reorder(cells: DataFrame, units: DataFrame, wits: DataFrame, low: float = 0.35, high: float = 0.6) -> DataFrame:
    """Relinks present cells of poor similarity to the best clause elsewhere in their chapter.

    ``units(unit, grp, norm, position)``, ``wits(grp, seq, start, end, text, norm, position)``. Of
    equally similar clauses the last one counts. Adds ``from_start`` where a cell was relinked.
    """
    poor = cells.where(
        (F.col("status") == "PRESENT") & ~F.col("unit").startswith("+") & (F.coalesce("similarity", F.lit(0.0)) < low)
    ).select("unit", "witness", "span_start")
    left = poor.join(units.select("unit", "grp", F.col("position").alias("up"), S.dice_grams(F.col("norm")).alias("ug")), "unit")
    right = wits.select("grp", "seq", "start", "end", "text", F.col("position").alias("wp"), S.dice_grams(F.col("norm")).alias("wg"))
    met = left.join(right, "grp").withColumn("s", S.dice_of(F.col("ug"), F.col("wg"))).drop("ug", "wg")
    best = met.groupBy("unit", "witness", "span_start", "up").agg(F.max(F.struct("s", "seq", "start", "end", "text", "wp")).alias("b"))
    hits = best.where((F.col("b.s") >= high) & ~F.col("b.start").eqNullSafe(F.col("span_start"))).select(
        "unit", "witness", F.col("span_start").alias("from_start"), "b", F.abs(F.col("b.wp") - F.col("up")).alias("moved"),
    )
    joined = cells.join(hits, ["unit", "witness"], "left")
    new = F.col("b").isNotNull()
    change = {
        "similarity": F.col("b.s"), "d_lex": 1 - F.col("b.s"), "d_ord": F.col("moved"), "span_start": F.col("b.start"),
        "span_end": F.col("b.end"), "text": F.substring(F.col("b.text"), 1, 80), "bead": F.lit("1:1*"), "provenance": F.lit("reorder_pass"),
    }
    return joined.select(*(F.when(new, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in cells.columns), "from_start")


def with_positions(side: DataFrame) -> DataFrame:
    return positions(side.withColumn("length", F.greatest(F.lit(1), F.col("length"))), ["grp"], "seq", "length")


