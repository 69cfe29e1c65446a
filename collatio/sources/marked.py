"""Marked-chapter text: ``//`` comments, ``#N[上下][?] [@coord] [note]`` headers, punctuated body lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.functions import text as T

HEADER = r"^#\s*(\d{1,2})([上下]?)(\?)?\s*(?:@(\S+))?\s*(.*)$"


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, line)`` of whole files, in order; works on any path Spark can read."""
    whole = spark.read.text(path, wholetext=True).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("file"), "value",
    )
    return whole.select("file", F.posexplode(F.split("value", r"\r\n|\r|\n")).alias("line_no", "line"))


def parse_marked(lines: DataFrame, lacuna_threshold: float = 0.5) -> DataFrame:
    """Segments of ``lines(file, line_no, line)``: one per clause, numbered from its header on.

    ``order`` is the chapter's place among the file's headers; ``seq`` orders a chapter's clauses, over
    the headers of its halves. A clause whose share of damaged characters reaches the threshold is
    of kind lacuna. Lines before a header are dropped.
    """
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    clean = lines.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where((F.col("line") != "") & ~F.col("line").startswith("//"))
    is_head = F.col("line").rlike(HEADER)

    def part(i: int) -> Column:
        return F.when(is_head, F.regexp_extract("line", HEADER, i))

    def filled(c: Column) -> Column:
        return F.last(c, ignorenulls=True).over(w)

    marked = clean.select(
        "file", "line_no", "line", is_head.alias("head"), filled(part(1).cast("int")).alias("local_chapter"), filled(part(2)).alias("half"), filled(part(3)).alias("doubt"), filled(part(4)).alias("native"),
        filled(F.when(is_head, F.col("line_no"))).alias("from_line"),
    ).where("local_chapter is not null")
    first = marked.where("head").groupBy("file", "local_chapter").agg(F.min("line_no").alias("first_line"))
    order = F.dense_rank().over(Window.partitionBy("file").orderBy("first_line")) - 1
    first = first.select(F.col("file").alias("witness"), "local_chapter", order.alias("order"))
    clauses = marked.where(~F.col("head")).select("*", F.posexplode(T.clauses(F.col("line"))).alias("at", "text"))
    number = F.row_number().over(Window.partitionBy("file", "from_line").orderBy("line_no", "at"))
    seq = F.row_number().over(Window.partitionBy("file", "local_chapter").orderBy("line_no", "at"))
    share = T.lacuna_share(F.col("text"))
    here = F.concat(F.col("local_chapter").cast("string"), F.col("half"), F.lit(":"), F.col("number").cast("string"))
    coord = F.concat(F.lit("c"), here)
    rows = clauses.withColumn("number", number).withColumn("seq", seq).withColumn("native", F.nullif("native", F.lit("")))
    return rows.select(
        F.col("file").alias("witness"), F.concat_ws(":", "file", here).alias("seg_id"), F.lit("zh").alias("lang"), "text", F.concat_ws("@", coord, "native").alias("start"), coord.alias("end"),
        F.when(share >= lacuna_threshold, "lacuna").otherwise("prose").alias("kind"), F.concat(
            F.lit("L."), F.col("local_chapter").cast("string"),
        ).alias("chapter"), "local_chapter",
        "half", (F.col("doubt") == "?").alias("uncertain"), "native", F.round(share, 3).alias("lacuna_fraction"), "seq",
    ).join(first, ["witness", "local_chapter"])


def read_marked(spark: SparkSession, path: str, lacuna_threshold: float = 0.5) -> DataFrame:
    return parse_marked(text_lines(spark, path), lacuna_threshold)


def chapter_order(segments: DataFrame) -> DataFrame:
    """``(witness, item, pos)``: chapters in order of first appearance."""
    return segments.select("witness", F.col("local_chapter").alias("item"), F.col("order").alias("pos")).distinct()
