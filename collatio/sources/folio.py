"""Folio-marked plain text: ``[1a.2]`` line coordinates, ``{D417}`` text starts, shad-delimited units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.functions import text as T
from collatio.sources.marked import text_lines

# The patterns and ordinals of colophons and front matter, units that are only delimiters,
# the coordinate before the first one, and how far front matter may reach.
FOLIO = r"^\[(\d+[ab])(?:\.(\d+))?\]"
COLOPHON = "ལེའུ་(?:ཞེས་བྱ་བ་)?སྟེ་?([ༀ-࿿་]*?)(པའོ|བའོ|པོའོ)"
TEXT_END = "རྫོགས་སོ"
OPENING = "འདི་སྐད་བདག་གིས་ཐོས་པ"
TITLE = "རྒྱ་གར་སྐད་དུ"
ORDINALS = {
    "དང་པོ": 1, "གཉིས་པ": 2, "གསུམ་པ": 3, "བཞི་པ": 4, "ལྔ་པ": 5, "དྲུག་པ": 6, "བདུན་པ": 7, "བརྒྱད་པ": 8, "དགུ་པ": 9, "དགུ་བ": 9,
    "བཅུ་པ": 10, "བཅུ་གཅིག་པ": 11, "བཅུ་གཉིས་པ": 12,
}
DELIMITERS = "།༎༏༐༑༔"
BARE = ("", "།", "། །", "།། །།")
START = "0a.0"
TITLE_UNITS, FRONT_UNITS = 4, 12


def classify(c: Column) -> Column:
    """colophon, mantra (over half transliterated, three syllables at least), verse_line, prose."""
    n = T.bo_length(c)
    colophon = c.rlike(COLOPHON) | c.rlike(TEXT_END)
    return F.when(colophon, "colophon").when(
        (T.bo_sanskrit_share(c) > 0.5) & (n >= 3), "mantra",
    ).when(n.isin(7, 9, 11), "verse_line").otherwise("prose")


def ordinal(c: Column) -> Column:
    """Chapter number at the end of what a colophon names, the longest ordinal that fits; else null."""
    said = F.concat(F.regexp_extract(c, COLOPHON, 1), F.regexp_extract(c, COLOPHON, 2))
    out = F.lit(None).cast("int")
    for word, n in sorted(ORDINALS.items(), key=lambda x: len(x[0])):
        out = F.when(said.endswith(word) | said.endswith(f"{word}འོ"), n).otherwise(out)
    return out


def fragments(lines: DataFrame) -> DataFrame:
    """``(file, line_no, pos, piece, coord, marker)``: lines cut behind each delimiter and around text marks.

    A line without a coordinate of its own is at the last one before; bare folio marks are dropped.
    """
    in_file = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    folio, number = (F.regexp_extract("line", FOLIO, i) for i in (1, 2))
    own = F.when(number != "", F.concat_ws(".", folio, number))
    placed = lines.where((folio == "") | (number != "")).withColumn("coord", F.coalesce(F.last(own, ignorenulls=True).over(in_file), F.lit(START)))
    pattern = f"(\\{{D\\d+\\}}|[^{DELIMITERS}{{]*[{DELIMITERS}]|[^{DELIMITERS}{{]+|\\{{)"
    pieces = F.regexp_extract_all(F.regexp_replace("line", FOLIO, ""), F.lit(pattern))
    cut = placed.select("file", "line_no", "coord", F.posexplode(pieces).alias("pos", "piece"))
    return cut.withColumn("marker", F.nullif(F.regexp_extract("piece", r"^\{(D\d+)\}$", 1), F.lit("")))


def parse_folio(lines: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Segments ``(file, text_id, seq, seg_id, text, start, end, kind, local_chapter, ordinal, text_end)``.

    A unit ends with a delimiter and may run over lines; its coordinates are those of its first and
    last piece. ``seq`` counts a text's units, bare delimiters included. Pieces are ordered inside
    their file, so a file (a volume) is one task's work and files are the parallelism.
    """
    in_file = Window.partitionBy("file").orderBy("line_no", "pos")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    closes = F.col("piece").rlike(f"[{DELIMITERS}]$") | F.col("marker").isNotNull()
    rows = fragments(lines).withColumn("text_id", F.last("marker", ignorenulls=True).over(in_file)).withColumn(
        "unit", F.coalesce(F.sum(closes.cast("long")).over(before), F.lit(0)),
    )
    rows = rows.where(F.col("marker").isNull() & F.col("text_id").isNotNull())
    if wanted is not None:
        rows = rows.where(F.col("text_id").isin(*wanted))
    place = F.struct("line_no", "pos")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "piece"))), lambda x: x["piece"]), "")
    units = rows.groupBy("file", "text_id", "unit").agg(
        joined.alias("raw"), F.min_by("coord", place).alias("start"), F.max_by("coord", place).alias("end"),
    )
    in_text = Window.partitionBy("file", "text_id").orderBy("unit")
    every = Window.partitionBy("file", "text_id")
    units = units.withColumn("seq", F.row_number().over(in_text) - 1).withColumn("text", F.regexp_replace("raw", r"(?U)^\s+|\s+$", ""))
    head = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") < TITLE_UNITS, F.struct("seq", "raw"))).over(every)), lambda x: x["raw"]),
        "",
    )
    units = units.withColumn("titled", head.rlike(TITLE)).where(~F.col("text").isin(*BARE)).withColumn("own", classify(F.col("text")))
    leaves = F.col("text").rlike(OPENING) | (F.col("seq") > FRONT_UNITS) | (F.col("own") == "colophon")
    front = F.col("titled") & (F.col("seq") < F.coalesce(F.min(F.when(leaves, F.col("seq"))).over(every), F.lit(1 << 30)))
    units = units.withColumn("kind", F.when(front, "meta").otherwise(F.col("own")))
    colophon = F.col("kind") == "colophon"
    text_end = colophon & F.col("text").rlike(TEXT_END) & ~F.col("text").rlike(COLOPHON)
    done = F.sum((colophon & ~text_end).cast("int")).over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    return units.select(
        "file", "text_id", "seq", F.concat(
            F.lit("bo:"), "text_id", F.lit(":"), F.format_string("%05d", "seq"),
        ).alias("seg_id"), "text", "start", "end", "kind",
        (1 + F.coalesce(done, F.lit(0))).cast("int").alias("local_chapter"), F.when(colophon, ordinal(F.col("text"))).alias("ordinal"), text_end.alias("text_end"),
    )


def chapters(segments: DataFrame) -> DataFrame:
    return segments.where("kind = 'colophon'").select("file", "text_id", F.col("local_chapter").alias("n"), "ordinal", "end", "text", "text_end")


def colophons(segments: DataFrame) -> DataFrame:
    """``(file, text_id, colophon)``: each text's last segment."""
    return segments.groupBy("file", "text_id").agg(F.max_by("text", "seq").alias("colophon"))


def read_folio(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    return parse_folio(text_lines(spark, path), wanted)
