"""The star-schema tables seen as the engine's inputs: segments, a matrix, chapter pairs, orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.functions import ids
from collatio.operators import matrix as M


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Segments: a document's lines; witness = source, chapter = lang, local chapter = document."""
    docs = table(spark, d, "documents").select(
        "doc_id", "lang", F.col("source").alias("witness"), F.posexplode(F.split("text", "\n")).alias("seq", "text"),
    )
    return docs.where(F.length(F.trim("text")) > 0).select(
        "doc_id", F.col("seq").cast("long").alias("seq"), "witness", F.col("lang").alias("chapter"), "text",
    )


LINES = """lines AS (SELECT doc_id, witness, chapter, (p - 1)::BIGINT AS seq, l[p] AS text
  FROM (SELECT doc_id, source AS witness, lang AS chapter, l, unnest(range(1, len(l) + 1)) AS p
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)) WHERE len(trim(l[p])) > 0)"""


def units(spark: SparkSession, d: str) -> DataFrame:
    """Reference units: parts; chapter = brand, kind = type, length = size."""
    part = table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("chapter"), F.col("p_type").alias("kind"),
        F.col("p_size").cast("long").alias("length"), F.col("p_name").alias("text"),
    )
    return M.positions(part, ["chapter"], "seq", "length").select(
        F.col("seq").cast("string").alias("unit"), "seq", "chapter", "kind", "length", "position", "text",
        F.when(F.col("seq") % 53 == 0, "LACUNA").alias("flag"),
    )


UNITS = """units AS (SELECT p_partkey::VARCHAR AS unit, p_partkey AS seq, p_brand AS chapter, p_type AS kind, p_size::BIGINT AS length, p_name AS text,
  CASE WHEN p_partkey % 53 = 0 THEN 'LACUNA' END AS flag,
  (coalesce(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  0) + p_size / 2.0::DOUBLE) / sum(p_size) OVER (PARTITION BY p_brand) AS position FROM part)"""


def witnesses(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_name").alias("witness"))


#: Deviations that the cells carry besides coverage.
DIMS = ("d_len", "d_lit", "d_ord", "d_lex")


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells: what the suppliers of each nation deliver of each part; nothing is ABSENT, some are lacunae.

    Facts are summed by (part, nation) before the frame of all pairs is joined: parts x nations
    rows. Deliveries of fifty at the full discount are orphans, units of their nation alone.
    """
    nation = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("witness"))
    suppliers = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "witness")
    facts = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
    ).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    given = facts.groupBy(F.col("l_partkey").cast("string").alias("unit"), "witness").agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_linenumber").alias("line")
    )
    frame = units(spark, d).select("unit", "seq", "chapter", "kind", "length", "position").join(nation)
    joined = frame.join(given, ["unit", "witness"], "left")
    lost = (F.col("seq") + F.col("n_nationkey")) % 41 == 0
    has = F.col("quantity").isNotNull() & ~lost
    own = joined.select(
        "unit", "witness", "chapter", "kind", F.when(lost, "LACUNA").when(has, "PRESENT").otherwise("ABSENT").alias("status"), F.when(has, 1.0).when(~lost, 0.0).alias("d_cov"),
        F.when(has, F.ln(F.col("quantity") / F.col("length"))).alias("d_len"), F.when(has, F.col("discount") * 0.7321).alias("d_lit"),
        F.when(has, F.abs(F.col("line") / 8 - F.col("position"))).alias("d_ord"), F.when(has, F.col("tax") * 0.7321).alias("d_lex"),
    )
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("chapter"))
    alone = facts.where((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.1)).join(part, "l_partkey")
    coords = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    none = F.lit(None).cast("double")
    orphans = alone.select(
        ids.orphan_id(F.col("witness"), coords, coords).alias("unit"), "witness", "chapter", F.lit("orphan").alias("kind"),
        F.lit("PRESENT").alias("status"), none.alias("d_cov"), none.alias("d_len"), (F.col("l_discount") * 0.7321).alias("d_lit"),
        none.alias("d_ord"), none.alias("d_lex"),
    )
    return own.unionByName(orphans)


RAW = """facts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax, n_name AS witness
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
given AS (SELECT l_partkey::VARCHAR AS unit, witness, sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax,
  avg(l_linenumber) AS line FROM facts GROUP BY ALL),
frame AS (SELECT u.*, n_name AS witness, (u.seq + n_nationkey) % 41 = 0 AS lost FROM units u CROSS JOIN nation),
seen AS (SELECT f.*, quantity, discount, tax, line, quantity IS NOT NULL AND NOT lost AS has
  FROM frame f LEFT JOIN given g ON g.unit = f.unit AND g.witness = f.witness),
raw AS (SELECT unit, witness, chapter, kind, CASE WHEN lost THEN 'LACUNA' WHEN has THEN 'PRESENT' ELSE 'ABSENT' END AS status,
  CASE WHEN has THEN 1.0 WHEN NOT lost THEN 0.0 END::DOUBLE AS d_cov,
    CASE WHEN has THEN ln(quantity / length) END AS d_len, CASE WHEN has THEN discount * 0.7321::DOUBLE END::DOUBLE AS d_lit,
  CASE WHEN has THEN abs(line / 8 - position) END::DOUBLE AS d_ord, CASE WHEN has THEN tax * 0.7321::DOUBLE END::DOUBLE AS d_lex FROM seen
  UNION ALL SELECT '+' || witness || ':' || l_orderkey || '-' || l_linenumber, witness, p_brand, 'orphan', 'PRESENT', NULL, NULL,
  l_discount * 0.7321::DOUBLE, NULL, NULL FROM facts JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 AND l_discount >= 0.1::DOUBLE)"""


def cells(spark: SparkSession, d: str) -> DataFrame:
    return M.calibrate(raw_cells(spark, d))


CELLS = """med AS (SELECT witness, kind, median(d_len) AS m
  FROM raw WHERE status = 'PRESENT' AND d_len IS NOT NULL AND NOT starts_with(unit, '+') GROUP BY ALL),
res AS (SELECT r.*, CASE WHEN d_len IS NOT NULL AND m IS NOT NULL THEN d_len - m ELSE d_len END AS r FROM raw r LEFT JOIN med USING (witness, kind)),
cells AS (SELECT unit, witness, chapter, kind, d_lit, d_ord, d_lex,
  CASE WHEN status = 'PRESENT' AND r < -ln(2.0::DOUBLE) - 1e-9 THEN 'PARTIAL' ELSE status END AS status,
  CASE WHEN status = 'PRESENT' AND r < -ln(2.0::DOUBLE) - 1e-9 THEN 0.5 ELSE d_cov END::DOUBLE AS d_cov, r AS d_len FROM res)"""
MATRIX = f"{UNITS}, {RAW}, {CELLS}"


def turns(spark: SparkSession, d: str, role: str) -> DataFrame:
    """One side of a chapter pair: a conversation's turns of a role; length in words, payload the text."""
    c = table(spark, d, "conversations").where(F.col("role") == role)
    return c.select(
        F.col("conv_id").cast("string").alias("grp"), F.col("turn").alias("seq"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("long").alias("length"), F.col("text").alias("payload"),
    )


def turns_sql(name: str, role: str) -> str:
    return f"""{name} AS (SELECT conv_id::VARCHAR AS grp, turn AS seq, len(string_split_regex(trim(text), '\\s+'))::BIGINT AS length, text AS payload,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations WHERE role = '{role}')"""


def yearly_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders: nations ranked by revenue in a year, and over all years; ``(year, witness, a, b)``."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"),
    )
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    by = o.groupBy(F.year("o_orderdate").cast("long").alias("year"), F.col("n_nationkey").cast("long").alias("item")).agg(F.sum(cents).alias("r"))
    over = by.groupBy("item").agg(F.sum("r").alias("t"))
    ranked = over.select("item", F.row_number().over(Window.orderBy(F.desc("t"), "item")).cast("long").alias("a"))
    return by.select(
        "year", "item", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("r"), "item")).cast("long").alias("b"),
    ).join(ranked, "item")


ORDERS = """y AS (SELECT year(o_orderdate)::BIGINT AS year, n_nationkey::BIGINT AS item, sum(round(o_totalprice * 100)::BIGINT) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
t AS (SELECT item, row_number() OVER (ORDER BY sum(r) DESC, item) AS a FROM y GROUP BY item),
ord AS (SELECT year, y.item, t.a, row_number() OVER (PARTITION BY year ORDER BY r DESC, y.item) AS b FROM y JOIN t ON y.item = t.item)"""
