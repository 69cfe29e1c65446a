"""Same-language witnesses against a reference's coordinates: read, align, repair, calibrate, summarise.

All witnesses and chapters are groups of one alignment job; nothing loops over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import similarity as S
from collatio.functions import text as T
from collatio.operators import align as L
from collatio.operators import matrix as M
from collatio.operators import metrics as X
from collatio.session import kept
from collatio.sources.marked import chapter_order

# The parameters of this alignment, the chapters of the reference scheme and the last of its first part.
PARAMS = L.Params(anchor_weight=6.0, conflict=0.0)
CHAPTERS = tuple(f"L.{i}" for i in range(1, 82))
FIRST_PART = 37


def witness_of() -> Column:
    """A group is a witness's chapter: ``witness|chapter``."""
    return F.substring_index("grp", "|", 1)


@dataclass
class Matrix:
    """The matrix of a run: units, cells, beads to review, relinked cells, orders, and the grade of its reference.

    ``witnesses`` are its columns in order, ``chapters`` its rows' chapters; ``log`` has a row per
    aligned group and shape, and ``tables`` what else is to be written.
    """

    units: DataFrame
    cells: DataFrame
    review: DataFrame
    repairs: DataFrame
    orders: DataFrame
    grade: str
    reference: str = ""
    witnesses: tuple[str, ...] = ()
    chapters: tuple[str, ...] = CHAPTERS
    log: DataFrame | None = None
    cowitness: dict[str, str | None] = field(default_factory=dict)
    sources: tuple[str, ...] = ()
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def columns(self) -> DataFrame:
        return self.cells.sparkSession.createDataFrame([(w,) for w in self.witnesses], "witness string")

    def structure(self, witnesses: DataFrame | None = None) -> DataFrame:
        rows = self.cells.sparkSession.createDataFrame([(c, i) for i, c in enumerate(self.chapters)], "chapter string, ord int")
        got = M.structure(self.cells, rows, witnesses if witnesses is not None else self.columns())
        return got.join(rows, "chapter")

    def decompositions(self) -> DataFrame:
        rows = [(w, self.cowitness.get(w) if self.cowitness.get(w) in self.witnesses else None) for w in self.witnesses]
        return X.decompose_all(
            self.cells, self.cells.sparkSession.createDataFrame(rows, "witness string, cowitness string"), self.sources, self.reference,
        )

    def intervals(self) -> DataFrame:
        return X.bootstrap(X.deviations(self.cells), by=["witness"])

    def distances(self) -> DataFrame:
        dims = [d for d in M.DIMS if d in self.cells.columns]
        return X.distance_matrix(X.witness_distances(self.cells, dims), self.columns())


def available(registry: DataFrame, files: DataFrame) -> DataFrame:
    """``registry(witness, file)`` with ``present``: is the file among ``files(file)``?"""
    return registry.join(
        files.select("file").distinct().withColumn("present", F.lit(True)), "file", "left",
    ).withColumn("present", F.coalesce("present", F.lit(False)))


def transfer(segments: DataFrame, registry: DataFrame, variants: T.Variants, params: L.Params = PARAMS) -> Matrix:
    """The matrix of marked segments (``sources.marked``) and ``registry(witness, scope, reference[, cowitness])``."""
    plain = T.strip_marks(F.col("text"))
    length = F.greatest(F.lit(1), F.length(plain)).cast("long")
    known = segments.join(registry, "witness").withColumn("length", length).withColumn("whole", variants.normalize(plain))
    # what several later steps read is written once, so that files are parsed and groups aligned once
    known = kept(known.withColumn("norm", F.replace("whole", F.lit("□"), F.lit(""))))
    ref = known.where(F.col("reference") & (F.col("kind") == "prose"))
    units = M.mint_units(
        ref.select("chapter", "seq", "text", "norm", "whole", "length"), style="p%02d",
    ).withColumn("kind", F.lit("prose")).withColumn("flag", F.lit(None).cast("string"))
    others = known.where(~F.col("reference"))
    scopes = registry.where(~F.col("reference")).select("witness", "scope").join(others.select("witness").distinct(), "witness", "left_semi")
    wits = M.positions(others.withColumn("grp", F.concat_ws("|", "witness", "chapter")), ["grp"], "seq", "length")
    shared = wits.select("witness", "chapter", "grp").distinct()
    refs = units.join(shared, "chapter").drop("witness")
    both = wits.join(refs.select("grp").distinct(), "grp", "left_semi")
    payload = F.col("norm").alias("payload")
    beads = kept(L.align(refs.select("grp", "seq", "length", payload), both.select("grp", "seq", "length", payload), "chargrams", params))
    cells = L.cells_from_beads(
        beads, refs.select("grp", "seq", "unit", "chapter", "kind", "length", "position", "flag"),
        wits.select("grp", "seq", "start", "end", "text", "lang", "kind", "length", "position"), witness_of(),
    )
    chapter = F.coalesce(F.nullif(F.substring_index("chapter", "|", -1), F.lit("")), F.col("chapter"))
    cells = _lexical(cells.withColumn("chapter", chapter), beads, refs, wits).drop("grp", "bead_no")
    own = F.when(F.col("unit").startswith("+"), F.col("unit")).otherwise(F.concat_ws("|", "witness", "unit"))
    in_chapter = refs.select(F.concat_ws("|", witness_of(), "unit").alias("unit"), "grp", F.col("whole").alias("norm"), "position")
    marked = kept(cells.withColumn("unit", own))
    relinked = L.reorder(marked, in_chapter, wits.select("grp", "seq", "start", "end", "text", "norm", "position"))
    before = marked.select("unit", F.round("similarity", 3).alias("similarity_before"))
    relinked = kept(relinked.join(before, "unit").withColumn("unit", F.substring_index("unit", "|", -1)))
    repairs = relinked.where("from_start is not null").select(
        "unit", "witness", F.col("from_start").alias("from"), F.col("span_start").alias("to"), "similarity_before",
        F.round("similarity", 3).alias("similarity_after"),
    )
    aligned = M.calibrate(relinked.drop("from_start", "similarity_before"))
    missing = M.fill_missing(units, shared.select("witness", "chapter"), scopes)
    full = aligned.unionByName(missing, allowMissingColumns=True).withColumn("evidence", F.lit("C"))
    ref_order = chapter_order(ref.select("witness", "local_chapter", "order")).select("item", F.col("pos").alias("ref_pos"))
    orders = X.order_deviation(chapter_order(known), ref_order, ["witness"], "item", FIRST_PART)
    return Matrix(units, full, review(beads, refs, wits, variants), repairs, orders, "coordinate_only", log=L.alignment_summary(beads))


def _sides(beads: DataFrame, refs: DataFrame, wits: DataFrame) -> DataFrame:
    """Two-sided beads with the joined texts of both sides, raw and normalised, and damage."""

    def joined(side: DataFrame, indices: str, prefix: str, *more) -> DataFrame:
        numbered = side.withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("seq")) - 1)
        rows = beads.select("grp", "bead_no", F.explode(indices).alias("i")).join(numbered, ["grp", "i"])
        text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]), "")
        return rows.groupBy("grp", "bead_no").agg(text("text").alias(f"{prefix}_text"), text("norm").alias(f"{prefix}_norm"), *more)

    left = joined(refs, "ref", "ref", F.array_join(F.array_sort(F.collect_list("unit")), " ").alias("ref_units"))
    right = joined(
        wits, "wit", "wit", F.max(F.col("kind") == "lacuna").alias("damaged"), F.min_by("start", "i").alias("from"),
        F.max_by("end", "i").alias("to"),
    )
    return left.join(right, ["grp", "bead_no"], "full")


def _lexical(cells: DataFrame, beads: DataFrame, refs: DataFrame, wits: DataFrame) -> DataFrame:
    """Lexical distance of two-sided beads, and LACUNA where a witness clause is damaged."""
    both = _sides(beads, refs, wits).where("ref_norm is not null and wit_norm is not null")
    near = both.select("grp", "bead_no", "damaged", (1 - S.dice(F.col("ref_norm"), F.col("wit_norm"))).alias("_lex"))
    joined = cells.join(near, ["grp", "bead_no"], "left")
    lost = F.coalesce(F.col("damaged"), F.lit(False)) & (F.col("status") == "PRESENT") & ~F.col("unit").startswith("+")
    change = {"d_lex": F.col("_lex"), "status": F.when(lost, "LACUNA").otherwise(F.col("status")), "d_cov": F.when(~lost, F.col("d_cov"))}
    return joined.select(*(change[c].alias(c) if c in change else F.col(c) for c in cells.columns))


def review(beads: DataFrame, refs: DataFrame, wits: DataFrame, variants: T.Variants) -> DataFrame:
    """One row per bead for a human reviewer, texts cut to 120 characters."""
    ref_plain, wit_plain = (T.strip_marks(F.col(c)) for c in ("ref_text", "wit_text"))
    two = F.col("ref_text").isNotNull() & F.col("wit_text").isNotNull()
    rows = beads.join(_sides(beads, refs, wits), ["grp", "bead_no"], "left")
    order = Window.orderBy("grp", "bead_no")  # a run's review table, in one order
    return rows.select(
        F.row_number().over(order).cast("long").alias("row_no"), witness_of().alias("witness"), F.substring_index("grp", "|", -1).alias("chapter"), "bead_no", L.shape_of(F.col("ref"), F.col("wit")).alias("shape"),
        F.coalesce("ref_units", F.lit("")).alias("ref_units"), F.substring(F.coalesce("ref_text", F.lit("")), 1, 120).alias("ref_text"), F.substring(F.coalesce("wit_text", F.lit("")), 1, 120).alias("wit_text"),
        F.concat_ws("-", "from", "to").alias("wit_coords"), F.round("similarity", 3).alias("similarity"), F.round(F.when(two, 1 - S.dice(ref_plain, wit_plain)), 3).alias("d_lex_raw"),
        F.round(
            F.when(two, 1 - S.dice(F.col("ref_norm"), F.col("wit_norm"))), 3,
        ).alias("d_lex"), F.when(two, F.array_join(variants.explained(ref_plain, wit_plain), " ")).otherwise("").alias("variants_explained"),
        F.lit("").alias("review_status"), F.lit("").alias("review_note"),
    )
