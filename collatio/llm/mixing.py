"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source is to give ``target`` words, cut into blocks of ``block_words``. All sources'
blocks, laid end to end in proportion to their numbers, are the cumulative weights; the van der
Corput sequence 0, 1/2, 1/4, 3/4, … runs through them, and each point is a slot of the source
it falls on. With 2^k points, 2^k at least the number of blocks, every block owns exactly one
point, so each source gets exactly its blocks, spread evenly from the first slot to the last.
A slot's rank among its source's slots is counted in closed form (a count of residues for each
bit), so no source's slots ever meet in one task. Slot and block of equal rank are joined; a
source's blocks are cut from its documents in the order of a seeded hash, a new order each pass.

Rows that are equal in all that is carried are one class with a number of copies, so a text that
a third of all rows repeat is one row of the axis; its copies come back when the mix is written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.llm._common import WORD, cut, running


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources by code point (null last), repeating; no source is taken over ``most`` times."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    block_words: int = 256
    seed: int = 42


#: Slots that one row of the schedule's seed table stands for.
CHUNK = 1 << 15


def reversed_bits(m: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of each number in reverse order: its place in the sequence and back."""
    out = np.zeros_like(m)
    for i in range(bits):
        out |= (m >> i & 1) << (bits - 1 - i)
    return out


def earlier(slots: np.ndarray, bits: int, bound: np.ndarray) -> np.ndarray:
    """How many of the cells 0 … bound-1 have a slot before each of ``slots``.

    A cell comes earlier if at the first differing bit of the slot numbers it has 0; the cells
    that agree up to there and have 0 are one residue class modulo a power of two.
    """
    out, low = np.zeros_like(slots), np.zeros_like(slots)
    for j in range(bits):
        one = slots >> (bits - 1 - j) & 1
        out += one * np.maximum(0, (bound - low + (1 << (j + 1)) - 1) >> (j + 1))
        low |= one << j
    return out


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``sources(source, total, docs)`` with ``sid``, ``weight`` and ``target``.

    All words are shared out by weight; a target stops at ``most`` times its source and the
    excess is shared among the others. Sorted by the ratio of cap to weight, the sources that
    reach their cap come first; the first that doesn't fixes the words per weight. Both orders are
    spread over tasks, as every domain may be a source.
    """
    n = len(mix.weights)
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), ((F.col("sid") - 1) % n + 1).cast("int"))
    keyed = sources.select("source", "total", "docs", F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("key"))
    named = running(keyed, ["none", "key"], place="1").select(
        "source", "total", "docs", (F.col("place") + 1).cast("long").alias("sid"),
    ).withColumn("weight", weight)
    ranked = cut(named.withColumn("cap", mix.most * F.col("total")).withColumn("ratio", F.col("cap") / F.col("weight")))
    whole = ranked.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    words, weights = int(whole[0]), int(whole[1])
    filled = running(ranked, ["ratio", "sid"], before="cap", lighter="weight")
    level = (F.lit(words) - F.col("before")) / (F.lit(weights) - F.col("lighter"))
    met = filled.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "sid"))).first()[0]
    target = F.least(F.col("cap").cast("double"), F.lit(met).cast("double") * F.col("weight"))
    return ranked.select("source", "sid", "weight", "total", "docs", F.coalesce(target, F.lit(0.0)).alias("target"))


def slots(sources: DataFrame) -> DataFrame:
    """``(sid, rank, slot)`` for every block of ``sources(sid, blocks)``."""
    some = cut(sources.where("blocks > 0").select("sid", "blocks"))
    every = int(some.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0])
    placed = running(some, ["sid"], first="blocks")
    starts = F.sequence("first", F.col("first") + F.col("blocks") - 1, F.lit(CHUNK).cast("long"))
    chunks = placed.select("*", F.explode(starts).alias("start"))
    bits = max(1, (every - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sid, blocks, first, start = (batch.column(c)[i].as_py() for c in ("sid", "blocks", "first", "start"))
                cells = np.arange(start, min(start + CHUNK, first + blocks), dtype=np.int64)
                slot = reversed_bits(cells, bits)
                rank = earlier(slot, bits, np.int64(first + blocks)) - earlier(slot, bits, np.int64(first))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), sid)), pa.array(rank), pa.array(slot)], names=["sid", "rank", "slot"])

    # a chunk is some 32,000 slots of work; dealt out evenly, whatever its source
    return chunks.select(
        "sid", "blocks", F.col("first").cast("long").alias("first"), "start",
    ).repartition("sid", "start").mapInArrow(run, "sid long, rank long, slot long")


def row_key(id_col: str, text_col: str, source_col: str, carry: Sequence[str]) -> list[Column]:
    """``k1, k2``: 128 bits that tell rows apart which differ in any of these columns."""
    names = (id_col, source_col, text_col, *carry)
    parts = [x for n in names for x in (F.col(n), F.col(n).isNull())]
    return [F.xxhash64(F.lit(salt), *parts).alias(f"k{salt}") for salt in (1, 2)]


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """``(k1, k2, id, source, size, copies)``: classes of equal rows."""
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = df.select(
        *row_key(id_col, text_col, source_col, carry), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        size.alias("size"),
    )
    return cut(
        rows.groupBy("k1", "k2").agg(
            F.first("id").alias("id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies"),
        )
    )


def copied(df: DataFrame, times: str) -> DataFrame:
    """Each row ``times`` times, with ``copy`` 0, 1, …; rows of many copies are dealt to tasks in chunks."""
    some = df.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1, F.lit(CHUNK).cast("long"))).alias("_from"),
    ).repartition("k1", "k2", "_from")
    upto = F.least(F.col("_from") + CHUNK, F.col(times)) - 1
    return some.select("*", F.explode(F.sequence("_from", upto)).alias("copy")).drop("_from")


def shares(docs: DataFrame, mix: Mix) -> DataFrame:
    """Per source: total, target, quota of whole words, blocks, and buckets for its running sums."""
    per = docs.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("total"), F.count("*").alias("docs"))
    aimed = targets(per, mix).withColumn("quota", F.least(F.round("target").cast("long"), mix.most * F.col("total")))
    blocks = F.ceil(F.col("quota") / mix.block_words).cast("long")
    return aimed.withColumn("blocks", blocks).withColumn("buckets", F.ceil(F.sqrt("docs")).cast("long"))


def _by_source(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull())


def pieces(docs: DataFrame, aimed: DataFrame, mix: Mix) -> DataFrame:
    """The mix: ``(slot, sid, k1, k2, copy, size, pass, word_from, words)``, a copy's part of a slot's block.

    A source's words, in shuffled order and pass after pass, are an axis on which its quota's
    blocks lie; the copies of a class lie side by side. Running sums are taken in hash buckets,
    about as many as each holds classes, so no task holds a whole source.
    """
    passes = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("total"))))
    wanted = _by_source(aimed.where("quota > 0")).select("key", "none", "sid", "total", "quota", "buckets")
    turns = _by_source(docs.where("size > 0")).join(wanted, ["key", "none"]).select(
        "k1", "k2", "size", "copies", "sid", "total", "quota", "buckets", passes.alias("pass"),
    )
    turn = F.xxhash64(F.lit(mix.seed), "pass", "k1", "k2")
    bucket = F.shiftrightunsigned(F.shiftrightunsigned("turn", 33) * F.col("buckets"), 31)
    dealt = turns.withColumn("turn", turn).withColumn("bucket", bucket).withColumn("length", F.col("size") * F.col("copies"))
    held = dealt.groupBy("sid", "pass", "bucket").agg(F.sum("length").alias("held"))
    over = Window.partitionBy("sid", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("sid", "pass", "bucket", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "pass", "bucket").orderBy("turn", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.withColumn("within", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(offsets.hint("merge"), ["sid", "pass", "bucket"])
    begin = F.col("pass") * F.col("total") + F.col("base") + F.col("within")
    # the copies that the quota reaches
    reached = F.least(F.col("copies"), F.ceil((F.col("quota") - F.col("begin")) / F.col("size"))).cast("long")
    single = copied(laid.withColumn("begin", begin).where("begin < quota").withColumn("reached", reached), "reached")
    start = F.col("begin") + F.col("copy") * F.col("size")
    taken = single.withColumn("start", start).select(
        "sid", "k1", "k2", "copy", "size", "pass", "start", F.least(F.col("size"), F.col("quota") - F.col("start")).alias("take"),
    )
    b = mix.block_words
    cutup = taken.select("*", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("take") - 1) / b))).alias("rank"))
    first = F.greatest(F.col("start"), F.col("rank") * b)
    words = F.least(F.col("start") + F.col("take"), (F.col("rank") + 1) * b) - first
    part = cutup.select("sid", "rank", "k1", "k2", "copy", "size", "pass", (first - F.col("start")).alias("word_from"), words.alias("words"))
    met = part.join(slots(aimed.select("sid", "blocks")).hint("merge"), ["sid", "rank"])
    return met.select("slot", "sid", "k1", "k2", "copy", "size", "pass", "word_from", "words")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix | None = None) -> DataFrame:
    """One row per row of ``df``: ``(id, size, source_size, target, taken, first_slot, n_parts, slots_hash)``.

    ``taken`` are the words of the row that the schedule's slots take, repeats counted: at most
    ``most`` times its ``size``; a source's sum is its target rounded to whole words.
    ``first_slot`` is the first slot that a part of the row fills (null: none), ``n_parts`` the
    number of its parts and ``slots_hash`` a digest of them all (slot, pass, first word, words).
    Null text has size 0 and nothing taken; a null source is a source of its own, the last. Null
    and repeated ids are rows like any other (equal rows may swap what is taken). Reruns agree, as
    the order of documents is a hash of seed, pass, id, source and text. Other columns are
    ignored. No rows: no rows.
    """
    mix = mix or Mix()
    docs = measured(df, id_col, text_col, source_col)
    aimed = cut(shares(docs, mix))
    took = pieces(docs, aimed, mix).groupBy("k1", "k2", "copy").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_parts"), F.bit_xor(F.xxhash64("slot", "pass", "word_from", "words")).alias("slots_hash")
    )
    met = copied(docs, "copies").join(took.hint("merge"), ["k1", "k2", "copy"], "left")
    per = _by_source(aimed).select("key", "none", F.col("total").alias("source_size"), "target")
    none = F.lit(0).cast("long")
    return _by_source(met).join(per, ["key", "none"]).select(
        F.col("id").alias(id_col), "size", F.col("source_size").cast("long").alias("source_size"), "target", F.coalesce("taken", none).alias("taken"),
        "first_slot", F.coalesce("n_parts", none).alias("n_parts"), F.coalesce("slots_hash", none).alias("slots_hash"),
    )


#: A place behind a word: texts are split here, so that words keep what is before them.
BEHIND = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix | None = None) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as its passes take it, sorted by their first slots.

    A row that a pass takes whole keeps its text; the last row of a source's quota is cut behind
    the last word taken. Rows without words are not taken. All columns of ``df`` come back, and
    ``mix_slot`` and ``mix_cut`` (was the text cut?) in place of any of these names. Null ids,
    repeated rows, null sources and no rows at all: as for ``mix_sources``.
    """
    mix = mix or Mix()
    df = df.drop("mix_slot", "mix_cut")
    carry = [c for c in df.columns if c not in (id_col, text_col, source_col)]
    docs = measured(df, id_col, text_col, source_col, carry)
    aimed = cut(shares(docs, mix))
    turns = pieces(docs, aimed, mix).groupBy("k1", "k2", "copy", "pass").agg(
        F.min("slot").alias("mix_slot"), F.sum("words").alias("_take"), F.first("size").alias("_size"),
    )
    # the turns of a class meet one of its rows, as they are equal; turns are many, so the rows' side is split by AQE
    rows = df.select(*row_key(id_col, text_col, source_col, carry), F.struct(*df.columns).alias("_row")).dropDuplicates(["k1", "k2"])
    met = rows.join(turns.hint("merge"), ["k1", "k2"]).withColumn("mix_cut", F.col("_take") < F.col("_size"))
    head = F.array_join(F.slice(F.split(F.col(f"_row.{text_col}"), BEHIND), F.lit(1), F.col("_take").cast("int")), "")
    text = F.when(F.col("mix_cut"), head).otherwise(F.col(f"_row.{text_col}"))
    ordered = met.orderBy("mix_slot", "pass", "k1", "k2", "copy")
    return ordered.select(*(text.alias(c) if c == text_col else F.col(f"_row.{c}").alias(c) for c in df.columns), "mix_slot", "mix_cut")
