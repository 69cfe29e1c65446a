"""Several languages against one reference: chapter mapping, alignment of merged groups, calibration.

With editions in the source language one of them is the reference (gold), the others are matched by
unit ids and all translations are aligned; without, the folio text is the reference (provisional).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.functions.lexicon import Lexicon
from collatio.operators import align as L
from collatio.operators import matrix as M
from collatio.plans.transfer import Matrix, witness_of
from collatio.session import kept
from collatio.sources import folio, tables, tei

# The kinds of segments that are aligned, the witnesses' names in the registry, the texts of the
# folio file, the edition whose units are preferred, and the reference's chapters.
ALIGNABLE = ("prose", "verse_line", "verse", "mantra", "provisional")
TEI_WITNESS, FOLIO_WITNESS = "zh_T0892_song", "bo_derge_D417_418"
TEXTS = ("D417", "D418")
PREFERRED = "sa_snellgrove1959"
CHAPTERS = tuple([f"I.{i}" for i in range(1, 12)] + [f"II.{i}" for i in range(1, 13)])

Encoder = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Similarity:
    """``anchors``, ``embedding`` or ``hybrid``; the latter two encode texts with ``encode`` or the named model."""

    kind: str = "anchors"
    model: str = "BAAI/bge-m3"
    weight: float = 0.8
    encode: Encoder | None = None


class SentenceEncoder:
    """A sentence-transformers model, loaded by each worker on first use where that package is installed."""

    def __init__(self, model: str, batch: int = 64):
        self.model, self.batch, self._loaded = model, batch, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_loaded": None}

    def __call__(self, texts: list[str]) -> Sequence[Sequence[float]]:
        if self._loaded is None:
            from sentence_transformers import SentenceTransformer

            self._loaded = SentenceTransformer(self.model)
        return self._loaded.encode(texts, batch_size=self.batch, normalize_embeddings=True, convert_to_numpy=True).tolist()


def embed(df: DataFrame, encode: Encoder, text: str = "text", batch: int = 64) -> DataFrame:
    """``df`` with ``vector``, its texts encoded in batches; every text once, before any alignment."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in encode(texts[i : i + batch])]
            yield pdf.assign(vector=[[float(x) for x in v] for v in vectors])

    return df.mapInPandas(run, f"{columns}, vector array<double>")


def with_payload(df: DataFrame, lexicon: Lexicon, s: Similarity) -> DataFrame:
    """``df(text, lang)`` with what its similarity compares."""
    keys = lexicon.anchors_in(F.col("text"), F.col("lang"))
    if s.kind == "anchors":
        return df.withColumn("payload", keys)
    vectors = embed(df, s.encode or SentenceEncoder(s.model))
    payload = F.col("vector") if s.kind == "embedding" else F.struct(keys.alias("keys"), F.col("vector").alias("vector"))
    return vectors.withColumn("payload", payload).drop("vector")


def groups(bridge: DataFrame) -> DataFrame:
    """``(witness, local, grp, chapters)``: reference chapters that share a local one are one group."""
    per = bridge.where("local is not null").groupBy("witness", "local").agg(F.array_sort(F.collect_list(F.struct("ord", "chapter"))).alias("cs"))
    names = F.transform("cs", lambda c: c["chapter"])
    return per.select("witness", "local", F.concat_ws("|", "witness", F.array_join(names, "+")).alias("grp"), names.alias("chapters"))


def align_witnesses(
    reference: DataFrame, witnesses: DataFrame, bridge: DataFrame, lexicon: Lexicon, ref_lang: str, grade: str,
    params: L.Params | None = None, similarity: Similarity | None = None, editions: DataFrame | None = None,
) -> Matrix:
    """The matrix of ``witnesses(witness, lang, local, seq, text, start, end, kind)`` against
    ``reference(chapter, seq, text, kind, flag[, unit])`` by ``bridge(chapter, ord, witness, local)``.

    Units without ids of their own are numbered ``t0001``. ``editions(witness, unit, text, flag)``
    are matched by unit. Chapters without counterpart, or whose counterpart has no segments, are
    UNALIGNED for that witness.
    """
    s = similarity or Similarity()
    ref = reference.where(F.col("kind").isin(*ALIGNABLE) & F.col("chapter").isNotNull()).withColumn(
        "length", T.length_in(F.col("text"), F.lit(ref_lang)),
    ).withColumn("lang", F.lit(ref_lang))
    named = ref.withColumnRenamed("unit", "own_id") if "unit" in ref.columns else ref.withColumn("own_id", F.lit(None).cast("string"))
    units = M.mint_units(named).withColumn("unit", F.coalesce("own_id", "unit")).withColumn(
        "kind", F.when(F.lit(grade == "provisional"), "provisional").otherwise(F.col("kind")),
    )
    if "flag" not in units.columns:
        units = units.withColumn("flag", F.lit(None).cast("string"))
    units = kept(with_payload(units.select("unit", "chapter", "seq", "kind", "text", "lang", "length", "position", "flag"), lexicon, s))
    by_local = groups(bridge)
    w = witnesses.where(F.col("kind").isin(*ALIGNABLE)).join(by_local.select("witness", "local", "grp"), ["witness", "local"]).withColumn(
        "length", F.greatest(F.lit(1).cast("long"), T.length_in(F.col("text"), F.col("lang"))),
    )
    u = units.join(by_local.select("grp", F.posexplode("chapters").alias("at", "chapter")), "chapter")
    w = w.join(u.select("grp").distinct(), "grp", "left_semi")
    w = kept(
        M.positions(with_payload(w.select("grp", "seq", "text", "lang", "start", "end", "kind", "length"), lexicon, s), ["grp"], "seq", "length")
    )
    u = u.join(w.select("grp").distinct(), "grp", "left_semi").withColumn("seq", F.col("at").cast("long") * (1 << 40) + F.col("seq"))
    kind = {"anchors": "anchors", "embedding": "embedding"}.get(s.kind) or L.backend(s.kind, s.weight)
    side = ("grp", "seq", "length", "payload")
    beads = kept(L.align(u.select(*side), w.select(*side), kind, params))
    cells = L.cells_from_beads(
        beads, u.select("grp", "seq", "unit", "chapter", "kind", "length", "position", "flag"),
        w.select("grp", "seq", "start", "end", "text", "lang", "kind", "length", "position"), witness_of(), lexicon.density_in,
    )
    cells = cells.withColumn("chapter", F.substring_index("chapter", "|", -1)).drop("grp", "bead_no")
    done = u.select(witness_of().alias("witness"), "chapter").distinct()
    scopes = bridge.select("witness").distinct().withColumn("scope", F.lit("complete"))
    full = M.calibrate(cells).unionByName(M.fill_missing(units.select("unit", "chapter", "kind"), done, scopes), allowMissingColumns=True)
    if editions is not None:
        full = full.unionByName(_matched(units, editions), allowMissingColumns=True)
    full = full.withColumn("evidence", F.lit("C"))
    spark = full.sparkSession
    nothing = spark.createDataFrame([], "unit string, witness string, `from` string, `to` string, similarity_before double, similarity_after double")
    orders = spark.createDataFrame([], "witness string, n_items long, tau double, late_first_share double, sequence string")
    return Matrix(units.drop("payload", "lang"), full, review(beads, u, w), nothing, orders, grade, chapters=CHAPTERS, log=L.alignment_summary(beads))


def _matched(units: DataFrame, editions: DataFrame) -> DataFrame:
    """Cells of all further editions at once, matched by unit."""
    every = units.select("unit", "chapter", "kind").join(editions.select("witness").distinct())
    has = editions.select("witness", "unit", F.col("text").alias("said"), F.col("flag"), F.lit(True).alias("has"))
    met = every.join(has, ["witness", "unit"], "left")
    said = F.coalesce("said", F.lit(""))
    status = F.when(F.col("has").isNull(), "NA").when(F.col("flag") == "LACUNA", "LACUNA").when(
        (F.col("flag") == "ABSENT") | (F.length(F.trim(said)) == 0), "ABSENT",
    ).otherwise("PRESENT")
    span = F.when(F.col("has"), F.col("unit"))
    rows = met.select(
        "unit", "witness", "chapter", "kind", status.alias("status"), span.alias("span_start"), span.alias("span_end"),
        F.when(F.col("has"), F.substring(said, 1, 80)).alias("text"),
    )
    return rows.withColumn(
        "d_cov", F.when(F.col("status") == "PRESENT", 1.0).when(F.col("status") != "NA", 0.0),
    ).withColumn("d_split", F.when(F.col("status") != "NA", 0.0))


def review(beads: DataFrame, units: DataFrame, wits: DataFrame) -> DataFrame:
    """One row per bead for a human reviewer, segments set off by `` / `` and cut to 160 characters."""
    numbered = lambda df: df.withColumn("i", F.row_number().over(Window.partitionBy("grp").orderBy("seq")) - 1)

    def listed(side: DataFrame, indices: str) -> DataFrame:
        return beads.select("grp", "bead_no", F.explode(indices).alias("i")).join(numbered(side), ["grp", "i"])

    def inside(c: str, by: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", c))), lambda x: x[c]), by)

    left = listed(units, "ref").groupBy("grp", "bead_no").agg(
        inside("unit", " ").alias("ref_units"), F.substring(inside("text", " / "), 1, 160).alias("ref_text"),
    )
    span = F.concat_ws("-", F.min_by("start", "i"), F.max_by("end", "i"))
    right = listed(wits, "wit").groupBy("grp", "bead_no").agg(span.alias("wit_span"), F.substring(inside("text", " / "), 1, 160).alias("wit_text"))
    rows = beads.join(left, ["grp", "bead_no"], "left").join(right, ["grp", "bead_no"], "left").na.fill(
        "", ["ref_units", "ref_text", "wit_span", "wit_text"],
    )
    return rows.select(
        F.row_number().over(Window.orderBy("grp", "bead_no")).cast("long").alias("row_no"), witness_of().alias("witness"), F.substring_index("grp", "|", -1).alias("chapters"), "bead_no", L.shape_of(F.col("ref"), F.col("wit")).alias("shape"),
        "ref_units", "ref_text", "wit_span", "wit_text", F.round("similarity", 3).alias("similarity"), F.round("cost", 3).alias("cost"), F.lit("").alias("review_status"), F.lit("").alias("review_note"),
    )


def run(
    spark: SparkSession, data: str, tei_path: str, folio_path: str, params: L.Params | None = None, similarity: Similarity | None = None,
    editions: DataFrame | None = None,
) -> Matrix:
    """The matrix of a TEI and a folio witness, and of editions ``(witness, …)`` where there are any.

    ``data`` holds ``concordance/chapters.yaml`` and ``anchors/terms.yaml``.
    """
    concordance = tables.load_concordance(spark, f"{data}/concordance/chapters.yaml")
    lexicon = tables.load_lexicon(f"{data}/anchors/terms.yaml")
    zh = tei.read_tei(spark, tei_path).withColumn("lang", F.lit("zh")).withColumn("text_id", F.lit(None).cast("string")).withColumn("witness", F.lit(TEI_WITNESS))
    bo = folio.read_folio(spark, folio_path, TEXTS).withColumn("lang", F.lit("bo")).withColumn("witness", F.lit(FOLIO_WITNESS))
    bo = bo.withColumn("seq", F.when(F.col("text_id") == TEXTS[1], 1 << 30).otherwise(0) + F.col("seq"))
    fields = ("witness", "lang", "text_id", "seq", "seg_id", "text", "start", "end", "kind", "local_chapter")
    local = tables.local_key_in(F.col("lang"), F.col("text_id"), F.col("local_chapter"))
    segments = kept(zh.select(*fields).unionByName(bo.select(*fields)).withColumn("local", local))
    names = [r.witness for r in editions.select("witness").distinct().orderBy("witness").collect()] if editions is not None else []
    gold = bool(names)
    reference = (PREFERRED if PREFERRED in names else names[0]) if gold else FOLIO_WITNESS
    if gold:
        ref, ref_lang = editions.where(F.col("witness") == reference).drop("witness"), "sa"
        others, targets = editions.where(F.col("witness") != reference), (TEI_WITNESS, FOLIO_WITNESS)
    else:
        lookup = tables.chapter_lookup(concordance).where("lang = 'bo'").select("local", "chapter")
        ref, ref_lang = segments.where(F.col("witness") == FOLIO_WITNESS).join(lookup, "local").select("chapter", "seq", "text", "kind"), "bo"
        others, targets = None, (TEI_WITNESS,)
    witness = F.when(F.col("lang") == "zh", TEI_WITNESS).otherwise(FOLIO_WITNESS)
    bridge = concordance.withColumn("witness", witness).where(F.col("witness").isin(*targets))
    m = align_witnesses(
        ref, segments.where(F.col("witness").isin(*targets)), bridge, lexicon, ref_lang, "gold" if gold else "provisional", params,
        similarity, others,
    )
    m.reference, m.witnesses = reference, (*(n for n in names if n != reference), *targets)
    m.sources = tuple(names)
    m.cowitness = {TEI_WITNESS: FOLIO_WITNESS, FOLIO_WITNESS: TEI_WITNESS} if gold else {}
    lengths = segments.where(F.col("witness").isin(*targets) & F.col("kind").isin(*ALIGNABLE)).select(
        "witness", "local", T.length_in(F.col("text"), F.col("lang")).alias("length"),
    )
    m.tables = {
        "structure_lengths": M.length_table(
            m.units.select("chapter", "length"), lengths, bridge.select("chapter", "witness", "local"),
        ), "glosses": tei.read_glosses(spark, tei_path), "apparatus": tei.read_apparatus(spark, tei_path),
        "colophons": folio.colophons(segments.where(F.col("witness") == FOLIO_WITNESS).withColumn("file", F.col("witness"))), "titles": tei.read_titles(spark, tei_path),
    }
    return m
