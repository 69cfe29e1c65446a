"""Queries over the matrix (adapter of parts, suppliers and deliveries) with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from collatio.operators import attribution as A
from collatio.operators import matrix as M
from collatio.operators import metrics as X
from collatio.plans import adapters as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The witness under study, its source editions and its co-witness.
WITNESS, SOURCES, CO = "NATION_7", ("NATION_3", "NATION_9"), "NATION_12"
#: The registry of witnesses, which are the columns of wide tables.
WITNESSES = tuple(f"NATION_{i}" for i in range(25))
SRC = ", ".join(f"'{s}'" for s in SOURCES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _rounded(c: DataFrame) -> DataFrame:
    return M.long_rows(c)


DEVIATIONS = ", ".join(f"round({x}, 4) AS {x}" for x in D.DIMS)
#: Cells that statistics look at: of units of the reference, and countable.
COUNTED = "counted AS (SELECT * FROM cells WHERE status IN ('PRESENT', 'PARTIAL', 'ABSENT') AND NOT starts_with(unit, '+'))"


@query(f"WITH {D.UNITS}, {D.RAW} SELECT unit, witness, chapter, kind, status, d_cov, {DEVIATIONS} FROM raw")
def matrix_cells(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.raw_cells(spark, d))


@query(f"WITH {D.MATRIX} SELECT unit, witness, chapter, kind, status, d_cov, {DEVIATIONS} FROM cells")
def calibrated_cells(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.cells(spark, d))


@query("""WITH w AS (SELECT l_partkey::VARCHAR AS unit, s_nationkey::BIGINT AS witness, l_orderkey * 10 + l_linenumber AS ord, l_quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT unit, witness, arg_max(l_quantity, ord) AS last_quantity, arg_min(l_quantity, ord) AS first_quantity FROM w GROUP BY unit, witness""")
def matrix_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Cells: the last write wins; orphan units: the first."""
    s = D.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("witness"))
    w = D.table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    writes = w.select(
        F.col("l_partkey").cast("string").alias("unit"), "witness", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        "l_quantity",
    )
    last = M.upsert(writes, "ord").select("unit", "witness", F.col("l_quantity").alias("last_quantity"))
    first = M.upsert(writes, "ord", last=False).select("unit", "witness", F.col("l_quantity").alias("first_quantity"))
    return last.join(first, ["unit", "witness"])


@query(f"""WITH {D.UNITS}, found AS (SELECT DISTINCT n_name AS witness, p_brand AS chapter
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 50 AND l_discount >= 0.09::DOUBLE AND l_tax >= 0.07::DOUBLE)
SELECT u.unit, n.n_name AS witness, u.chapter, u.kind, CASE WHEN n_regionkey = 1 THEN 'NA' ELSE 'UNALIGNED' END AS status
  FROM units u CROSS JOIN nation n WHERE NOT EXISTS (SELECT 1 FROM found s WHERE s.witness = n.n_name AND s.chapter = u.chapter)""")
def unmapped_units(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of which a witness has nothing: NA for anthologies, UNALIGNED for complete ones."""
    s = D.table(spark, d, "supplier").join(
        D.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"),
    ).select("s_suppkey", F.col("n_name").alias("witness"))
    li = D.table(spark, d, "lineitem").where((F.col("l_quantity") >= 50) & (F.col("l_discount") >= 0.09) & (F.col("l_tax") >= 0.07)).select("l_partkey", "l_suppkey")
    some = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(
        D.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("chapter")), F.col("l_partkey") == F.col("p_partkey"),
    ).select("witness", "chapter").distinct()
    scopes = D.table(spark, d, "nation").select(
        F.col("n_name").alias("witness"), F.when(F.col("n_regionkey") == 1, "anthology").otherwise("complete").alias("scope"),
    )
    return M.fill_missing(D.units(spark, d), some, scopes)


MEANS = ", ".join(f"round(avg(CASE WHEN NOT orphan AND status IN ('PRESENT', 'PARTIAL') THEN {x} END), 4) AS mean_{x}" for x in D.DIMS)


@query(f"""WITH {D.MATRIX}, c AS (SELECT *, starts_with(unit, '+') AS orphan, status IN ('PRESENT', 'PARTIAL', 'ABSENT') AS countable FROM cells),
one AS (SELECT chapter, witness, count(*) FILTER (NOT orphan) AS n_units, count(*) FILTER (NOT orphan AND countable) AS n_counted,
  count(*) FILTER (NOT orphan AND status IN ('PRESENT', 'PARTIAL')) AS n_present,
  count(*) FILTER (NOT orphan AND status = 'ABSENT') AS n_absent, count(*) FILTER (orphan) AS n_orphan, {MEANS} FROM c GROUP BY ALL)
SELECT c.chapter, n_name AS witness, coalesce(n_units, 0) AS n_units, coalesce(n_counted, 0) AS n_counted, coalesce(n_present,
  0) AS n_present, coalesce(n_absent, 0) AS n_absent, coalesce(n_orphan, 0) AS n_orphan, {", ".join(f"mean_{x}" for x in D.DIMS)},
  round(n_present / nullif(n_counted, 0), 4) AS coverage
FROM (SELECT DISTINCT chapter FROM units) c CROSS JOIN nation LEFT JOIN one ON one.chapter = c.chapter AND one.witness = n_name""")
def structure_l1(spark: SparkSession, d: str) -> DataFrame:
    return M.structure(D.cells(spark, d), D.units(spark, d).select("chapter").distinct(), D.witnesses(spark, d))


def _wide_sql(dim: str) -> str:
    picks = ", ".join(f"max(CASE WHEN witness = '{w}' THEN {dim if dim == 'status' else f'round({dim}, 4)'} END) AS \"{w}\"" for w in WITNESSES)
    return f"WITH {D.MATRIX}, r AS (SELECT unit, chapter, witness, status, d_len FROM cells) SELECT unit, chapter, {picks} FROM r GROUP BY unit, chapter"


@query(_wide_sql("status"))
def wide_status(spark: SparkSession, d: str) -> DataFrame:
    return M.wide(D.cells(spark, d), "status", WITNESSES)


@query(_wide_sql("d_len"))
def wide_d_len(spark: SparkSession, d: str) -> DataFrame:
    return M.wide(_rounded(D.cells(spark, d)), "d_len", WITNESSES)


@query(f"""WITH {D.MATRIX}, v AS (SELECT witness, list_sort(list(d_len)) AS l, count(d_len) AS n, avg(d_len) AS mean, median(d_len) AS median
  FROM cells WHERE d_len IS NOT NULL AND status IN ('PRESENT', 'PARTIAL') AND NOT starts_with(unit, '+') GROUP BY witness)
SELECT witness, n, round(mean, 4) + 0.0 AS mean, round(median, 4) + 0.0 AS median, round(l[floor(0.9::DOUBLE * (n - 1))::BIGINT + 1], 4) AS p90 FROM v""")
def dim_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.dimension(D.cells(spark, d), "d_len")


DECOMPOSED = f"""{COUNTED}, own AS (SELECT unit, status <> 'PRESENT' AS deviating FROM counted WHERE witness = '{WITNESS}'),
f AS (SELECT unit, bool_or(witness IN ({SRC}) AND status IN ('ABSENT', 'PARTIAL')) AS lacking, bool_or(CASE
  WHEN witness = '{CO}' THEN status <> 'PRESENT' END) AS co FROM counted WHERE witness IN ({SRC}, '{CO}') GROUP BY unit),
dec AS (SELECT unit, deviating, CASE WHEN deviating THEN
  CASE WHEN lacking THEN 'vorlage_explained' WHEN co IS NULL THEN NULL WHEN co THEN 'shared_with_cowitness' ELSE 'residual' END END AS class
  FROM own LEFT JOIN f USING (unit))"""


@query(f"WITH {D.MATRIX}, {DECOMPOSED} SELECT unit, deviating, class FROM dec")
def decompose_units(spark: SparkSession, d: str) -> DataFrame:
    return X.decompose_units(D.cells(spark, d), WITNESS, SOURCES, CO)


@query(f"""WITH {D.MATRIX}, {DECOMPOSED}, k AS (SELECT count(*) AS n_counted, count(*) FILTER (deviating) AS n_deviating,
  count(*) FILTER (class = 'vorlage_explained') AS vorlage_explained,
  count(*) FILTER (class = 'shared_with_cowitness') AS shared_with_cowitness, count(*) FILTER (class = 'residual') AS residual FROM dec)
SELECT *, round(vorlage_explained / greatest(n_counted, 1), 4) AS rate_vorlage_explained, round(shared_with_cowitness / greatest(n_counted,
  1), 4) AS rate_shared_with_cowitness, round(residual / greatest(n_counted, 1), 4) AS rate_residual FROM k""")
def decompose_rates(spark: SparkSession, d: str) -> DataFrame:
    return X.decompose(X.decompose_units(D.cells(spark, d), WITNESS, SOURCES, CO))


RATES = f"{COUNTED}, blocks AS (SELECT chapter, (count(*) FILTER (status <> 'PRESENT'))::DOUBLE AS total, count(*) AS n FROM counted WHERE witness = '{WITNESS}' GROUP BY chapter)"


def resampled(boots: int = 1000, seed: int = 20260930) -> str:
    """SQL for the bootstrap of ``blocks(chapter, total, n)``."""
    p = X.PRIME
    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY chapter) - 1 AS block, count(*) OVER () AS whole FROM blocks WHERE n > 0),
x0 AS (SELECT boot, whole, ({seed % p} + boot * 1000003 + block * 7919) % {p} AS x
  FROM numbered, range({boots}) r(boot)), x1 AS (SELECT *, (x * x + 12345) % {p} AS y FROM x0), x2 AS (SELECT *, (y * y + x) % {p} AS z FROM x1),
rounds AS (SELECT boot, sum(total) / sum(n) AS v FROM (SELECT boot, ((z * z + y) % {p}) % whole AS block
  FROM x2) drawn JOIN numbered USING (block) GROUP BY boot), vs AS (SELECT list_sort(list(v)) AS v FROM rounds)
SELECT round((SELECT sum(total) / sum(n) FROM numbered), 6) AS estimate, round(v[{int(0.025 * boots) + 1}], 6) AS lo,
  round(v[{-int(-0.975 * boots // 1)}], 6) AS hi, (SELECT count(*) FROM numbered) AS n_blocks FROM vs"""


def _interval(b: DataFrame) -> DataFrame:
    return b.select(*(F.round(c, 6).alias(c) for c in ("estimate", "lo", "hi")), "n_blocks")


@query(f"WITH {D.MATRIX}, {RATES} SELECT chapter, total, n FROM blocks")
def deviation_by_chapter(spark: SparkSession, d: str) -> DataFrame:
    return X.deviation_by_chapter(D.cells(spark, d), WITNESS)


@query(f"WITH {D.MATRIX}, {RATES}, {resampled()}")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the deviation rate."""
    return _interval(X.bootstrap(X.deviation_by_chapter(D.cells(spark, d), WITNESS)))


@query(
    f"""WITH {D.MATRIX}, {COUNTED}, obs AS (SELECT chapter, d_lit
  FROM counted WHERE witness = '{WITNESS}' AND d_lit IS NOT NULL) SELECT round(median(d_lit), 6) AS estimate, count(DISTINCT chapter) AS n_blocks FROM obs"""
)
def bootstrap_statistic(spark: SparkSession, d: str) -> DataFrame:
    """The bootstrap with a statistic of one's own, here a median; its ends lie around the estimate."""
    c = D.cells(spark, d).where(
        (F.col("witness") == WITNESS) & M.countable(F.col("status")) & ~M.is_orphan(F.col("unit")) & F.col("d_lit").isNotNull()
    ).select("chapter", "d_lit")
    return X.bootstrap(c, n_boot=50, stat=F.median("d_lit")).where("lo <= estimate and estimate <= hi").select(
        F.round("estimate", 6).alias("estimate"), "n_blocks",
    )


@query(
    """SELECT day AS chapter, count(*) FILTER (event_type = 'error')::DOUBLE AS total, count(*) AS n
  FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type FROM events) GROUP BY day"""
)
def event_error_blocks(spark: SparkSession, d: str) -> DataFrame:
    return X.indicator_blocks(D.table(spark, d, "events"), F.date_format("ts", "yyyy-MM-dd"), F.col("event_type") == "error")


@query(
    f"WITH blocks AS (SELECT strftime(ts, '%Y-%m-%d') AS chapter, (count(*) FILTER (event_type = 'error'))::DOUBLE AS total, count(*) AS n FROM events GROUP BY ALL), {resampled()}"
)
def event_error_ci(spark: SparkSession, d: str) -> DataFrame:
    return _interval(X.bootstrap(event_error_blocks(spark, d)))


ALL_DIMS = ("d_cov", *D.DIMS)
DIST = f"""{COUNTED}, dist AS (SELECT a.witness AS a, b.witness AS b,
  round(sum((a.status <> b.status)::INT + {" + ".join(f"coalesce(abs(a.{x} - b.{x}), 0)" for x in ALL_DIMS)}) / count(*), 4) AS distance,
  count(*) AS n FROM counted a JOIN counted b ON a.unit = b.unit AND a.witness < b.witness GROUP BY ALL)"""


@query(f"WITH {D.MATRIX}, {DIST} SELECT a, b, distance, n FROM dist")
def witness_distance(spark: SparkSession, d: str) -> DataFrame:
    return X.witness_distances(D.cells(spark, d), ALL_DIMS).withColumn("distance", F.round("distance", 4))


@query(
    f"""WITH {D.MATRIX}, {DIST} SELECT x.n_name AS a, y.n_name AS b, CASE WHEN x.n_name = y.n_name THEN 0.0::DOUBLE ELSE distance END AS distance
  FROM nation x CROSS JOIN nation y LEFT JOIN dist ON (dist.a = least(x.n_name, y.n_name) AND dist.b = greatest(x.n_name, y.n_name))"""
)
def distance_matrix(spark: SparkSession, d: str) -> DataFrame:
    return X.distance_matrix(witness_distance(spark, d), D.witnesses(spark, d))


@query()
def upgma_newick(spark: SparkSession, d: str) -> DataFrame:
    """Tree of all witnesses; their pairwise distances (a registry's) are joined on the driver."""
    rows = witness_distance(spark, d).collect()
    return spark.createDataFrame([(X.tree(WITNESSES, {(r.a, r.b): r.distance for r in rows}),)], "newick string")


@query(
    f"""WITH {D.ORDERS} SELECT x.year, (SELECT count(*)
  FROM ord o WHERE o.year = x.year) AS n_items, round((count(*) FILTER (x.b > y.b)) / count(*), 4) AS tau
  FROM ord x JOIN ord y ON x.year = y.year AND x.a < y.a GROUP BY x.year"""
)
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return X.kendall(D.yearly_orders(spark, d), ["year"], "item", "a", "b")


@query(f"""WITH {D.ORDERS}, tau AS (SELECT x.year, round((count(*) FILTER (x.b > y.b)) / count(*), 4) AS tau
  FROM ord x JOIN ord y ON x.year = y.year AND x.a < y.a GROUP BY x.year),
share AS (SELECT l.year, round((count(*) FILTER (l.b < e.b)) / count(*), 4) AS late_first_share
  FROM ord l JOIN ord e ON l.year = e.year AND l.item > 12 AND e.item <= 12 GROUP BY l.year)
SELECT year, count(*) AS n_items, any_value(tau) AS tau, any_value(late_first_share) AS late_first_share, string_agg(item::VARCHAR,
  ' ' ORDER BY b) AS sequence FROM ord JOIN tau USING (year) JOIN share USING (year) GROUP BY year""")
def order_deviation(spark: SparkSession, d: str) -> DataFrame:
    o = D.yearly_orders(spark, d)
    ref = o.select("item", F.col("a").alias("ref_pos")).distinct()
    return X.order_deviation(o.select("year", "item", F.col("b").alias("pos")), ref, ["year"], "item", 12)


SENS = "s AS (SELECT unit, chapter, kind, greatest(1, length) AS length, seq % 3 = 0 AS sensitive FROM units)"


def _sensitive(spark: SparkSession, d: str) -> DataFrame:
    return D.units(spark, d).withColumn("sensitive", F.col("seq") % 3 == 0)


@query(
    f"""WITH {D.UNITS}, {SENS} SELECT u.chapter, u.kind, u.unit, v.unit AS mate
  FROM s u JOIN s v ON u.chapter = v.chapter AND u.kind = v.kind AND u.sensitive AND NOT v.sensitive AND abs(ln(v.length / u.length)) <= 0.35::DOUBLE"""
)
def matched_candidates(spark: SparkSession, d: str) -> DataFrame:
    return X.match_candidates(_sensitive(spark, d))


GREEDY = f"""s1 AS (SELECT *, row_number() OVER (PARTITION BY chapter, kind ORDER BY seq) AS r
  FROM s WHERE sensitive), s0 AS (SELECT *, md5('20260930:' || unit) AS mark FROM s WHERE NOT sensitive),
cand AS (SELECT u.chapter, u.kind, u.unit, u.r, list(v.unit ORDER BY v.mark, v.unit) FILTER (v.unit IS NOT NULL) AS mates
  FROM s1 u LEFT JOIN s0 v ON u.chapter = v.chapter AND u.kind = v.kind AND abs(ln(v.length / u.length)) <= 0.35::DOUBLE GROUP BY ALL),
greedy(chapter, kind, r, unit, mate, used) AS (SELECT DISTINCT chapter, kind, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[] FROM cand
  UNION ALL SELECT chapter, kind, r, unit, free[1], CASE WHEN len(free) > 0 THEN list_append(used, free[1]) ELSE used END
  FROM (SELECT g.chapter, g.kind, c.r, c.unit, g.used, list_filter(coalesce(c.mates, []::VARCHAR[]), lambda x: NOT list_contains(g.used,
  x)) AS free FROM greedy g JOIN cand c ON c.chapter = g.chapter AND c.kind = g.kind AND c.r = g.r + 1)),
pairs AS (SELECT chapter, unit, mate FROM greedy WHERE mate IS NOT NULL)"""


@query(
    f"""WITH RECURSIVE {D.UNITS}, s AS (SELECT unit, seq, chapter, kind, greatest(1, length)::DOUBLE AS length, seq % 3 = 0 AS sensitive
  FROM units), {GREEDY} SELECT chapter, unit, mate FROM pairs"""
)
def matched_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Greedy 1:1 pairs of a sensitive and a neutral unit."""
    return X.match(_sensitive(spark, d), "seq").select("chapter", "unit", "mate")


@query(f"""WITH RECURSIVE {D.MATRIX}, {COUNTED}, s AS (SELECT unit, seq, chapter, kind, greatest(1, length)::DOUBLE AS length, seq % 3 = 0 AS sensitive
  FROM units), {GREEDY}, own AS (SELECT unit, (status <> 'PRESENT')::INT AS d FROM counted WHERE witness = '{WITNESS}'),
blocks AS (SELECT p.chapter, sum(a.d - b.d)::DOUBLE AS total, count(*) AS n
  FROM pairs p JOIN own a ON a.unit = p.unit JOIN own b ON b.unit = p.mate GROUP BY p.chapter), {resampled()}""")
def matched_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Greedy pairs, their deviation differences and the interval of the mean."""
    pairs = X.match(_sensitive(spark, d), "seq")
    return _interval(X.bootstrap(X.matched_contrast(pairs, D.cells(spark, d), WITNESS)))


#: The first source is the reference: it counts unless its unit is flagged, the other one if its cell is countable.
GATE = f"""{COUNTED}, gate AS (SELECT u.unit, count(*) FILTER (witness = '{SOURCES[1]}') + any_value(CASE
  WHEN u.flag = 'LACUNA' THEN 0 ELSE 1 END) AS n_source, count(*) FILTER (witness = '{CO}') > 0 AS co_ok
  FROM units u LEFT JOIN counted c ON c.unit = u.unit GROUP BY u.unit),
why AS (SELECT *, CASE WHEN n_source < 2 THEN 'INSUFFICIENT_SANSKRIT' WHEN NOT co_ok THEN 'INSUFFICIENT_COWITNESS' ELSE 'SUFFICIENT' END AS reason FROM gate)"""


@query(f"WITH {D.MATRIX}, {GATE} SELECT unit, n_source, co_ok, reason FROM why")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return A.gate(D.units(spark, d), D.cells(spark, d), SOURCES, CO, SOURCES[0], least=2)


SHARES = ("vorlage_attested", "shared_with_cowitness", "lacuna", "unexplained_at_translation", "abstain")


@query(f"""WITH {D.MATRIX}, {GATE}, p AS (SELECT unit, max(status) FILTER (witness = '{WITNESS}') AS own, max(status) FILTER (witness = '{CO}') AS co,
  count(*) FILTER (witness = '{SOURCES[1]}' AND status IN ('ABSENT', 'PARTIAL')) AS lacking,
  count(*) FILTER (witness = '{SOURCES[1]}') AS others FROM cells GROUP BY unit),
r AS (SELECT *, CASE WHEN lacking > 0 THEN 0.5::DOUBLE + 0.5::DOUBLE * lacking / (others + 1) ELSE 0 END AS v,
  CASE WHEN co IN ('ABSENT', 'PARTIAL') THEN CASE WHEN lacking = 0 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END ELSE 0 END AS s,
  CASE WHEN lacking = 0 AND co = 'PRESENT' THEN 0.5::DOUBLE ELSE 0 END AS u FROM why JOIN p USING (unit)),
n AS (SELECT unit, reason, own = 'PRESENT' AS plain, own = 'LACUNA' AS lost, reason <> 'SUFFICIENT' AS shut, v / nullif(v + s + 2 * u,
  0) AS v, s / nullif(v + s + 2 * u, 0) AS s, u / nullif(v + s + 2 * u, 0) AS u FROM r),
z AS (SELECT unit, reason, round(CASE WHEN plain OR lost OR shut THEN 0 ELSE coalesce(v, 0) END, 6)::DOUBLE AS vorlage_attested, round(CASE
  WHEN plain OR lost OR shut THEN 0 ELSE coalesce(s, 0) END, 6)::DOUBLE AS shared_with_cowitness, (NOT plain AND lost)::INT::DOUBLE AS lacuna,
  round(CASE WHEN plain OR lost OR shut THEN 0 ELSE coalesce(u, 0) END, 6)::DOUBLE AS unexplained_at_translation, round(CASE
  WHEN plain THEN 1 WHEN lost THEN 0 WHEN shut THEN 1 ELSE coalesce(u, 0) END, 6)::DOUBLE AS abstain FROM n)
SELECT *, CASE WHEN greatest({', '.join(SHARES)}) > 0 THEN
  CASE greatest({', '.join(SHARES)}) {' '.join(f"WHEN {x} THEN '{x}'" for x in SHARES)} END END AS top FROM z""")
def attribution_dist(spark: SparkSession, d: str) -> DataFrame:
    return A.attribute(D.units(spark, d), D.cells(spark, d), WITNESS, SOURCES, CO, SOURCES[0], least=2)


@query(
    f"""WITH {D.MATRIX} SELECT t.unit, t.witness, string_agg(o.witness || ': ' || o.status, '; ' ORDER BY o.witness) AS facts
  FROM cells t JOIN cells o ON t.unit = o.unit AND t.witness <> o.witness WHERE t.witness = '{WITNESS}' AND t.status IN ('ABSENT', 'PARTIAL') GROUP BY ALL"""
)
def attribution_facts(spark: SparkSession, d: str) -> DataFrame:
    c = D.cells(spark, d)
    return A.facts(c, c.where((F.col("witness") == WITNESS) & F.col("status").isin("ABSENT", "PARTIAL")))


@query(f"""WITH {D.MATRIX}, l AS (SELECT unit, bool_or(witness = '{CO}') AS c, bool_or(witness = '{SOURCES[0]}') AS i,
  bool_or(witness = '{SOURCES[1]}') AS j FROM cells WHERE status IN ('ABSENT', 'PARTIAL') GROUP BY unit)
SELECT u.unit, coalesce(nullif(array_to_string(list_filter([CASE WHEN c THEN '{A.CO_LACKS.format(CO)}' END,
  CASE WHEN i THEN '{A.SOURCE_LACKS.format(SOURCES[0])}' END,
  CASE WHEN j THEN '{A.SOURCE_LACKS.format(SOURCES[1])}' END], lambda x: x IS NOT NULL), '; '), ''), '{A.NOBODY_LACKS}') AS fact
  FROM units u LEFT JOIN l ON l.unit = u.unit""")
def cowitness_facts(spark: SparkSession, d: str) -> DataFrame:
    return A.cowitness_fact(D.cells(spark, d), D.units(spark, d), CO, SOURCES)


@query("""WITH r AS (SELECT c_mktsegment AS chapter, sum(length(c_name)) AS ref_length FROM customer GROUP BY ALL),
w AS (SELECT o_orderpriority AS local, sum(length(o_orderstatus) + 3) AS witness_length FROM orders GROUP BY ALL),
b AS (SELECT * FROM (VALUES ('AUTOMOBILE', '1-URGENT'), ('BUILDING', '1-URGENT'), ('FURNITURE', '2-HIGH'), ('HOUSEHOLD', '3-MEDIUM'),
  ('MACHINERY', NULL)) t(chapter, local)),
j AS (SELECT b.chapter, b.local, coalesce(ref_length, 0) AS ref_length, coalesce(witness_length, 0) AS witness_length
  FROM b LEFT JOIN r USING (chapter) LEFT JOIN w USING (local)),
p AS (SELECT local, sum(ref_length) AS pool, string_agg(chapter, '+' ORDER BY chapter) AS merged_group FROM j WHERE local IS NOT NULL GROUP BY local)
SELECT chapter, 'orders' AS witness, coalesce(j.local, '') AS witness_local, coalesce(merged_group, '') AS merged_group,
  ref_length::BIGINT AS ref_length, witness_length::BIGINT AS witness_length, round(nullif(witness_length, 0) / nullif(pool, 0),
  3) AS ratio_pooled FROM j LEFT JOIN p ON j.local = p.local""")
def length_table_pooled(spark: SparkSession, d: str) -> DataFrame:
    """Segments of customers against order priorities; two chapters share one local key, one has none."""
    bridge = spark.createDataFrame(
        [
            ("AUTOMOBILE", "orders", "1-URGENT"), ("BUILDING", "orders", "1-URGENT"), ("FURNITURE", "orders", "2-HIGH"),
            ("HOUSEHOLD", "orders", "3-MEDIUM"), ("MACHINERY", "orders", None),
        ],
        "chapter string, witness string, local string",
    )
    ref = D.table(spark, d, "customer").select(F.col("c_mktsegment").alias("chapter"), F.length("c_name").cast("long").alias("length"))
    wit = D.table(spark, d, "orders").select(
        F.lit("orders").alias("witness"), F.col("o_orderpriority").alias("local"),
        (F.length("o_orderstatus") + 3).cast("long").alias("length"),
    )
    return M.length_table(ref, wit, bridge)


@query(f"WITH {D.UNITS} SELECT unit, chapter, length, round(position, 6) AS position FROM units")
def unit_positions(spark: SparkSession, d: str) -> DataFrame:
    return D.units(spark, d).select("unit", "chapter", "length", F.round("position", 6).alias("position"))


@query(
    f"""WITH {D.LINES} SELECT doc_id, seq, doc_id::VARCHAR || '.t' || lpad(row_number() OVER (PARTITION BY doc_id ORDER BY seq)::VARCHAR, 4,
  '0') AS unit, greatest(1, length(text))::BIGINT AS length FROM lines"""
)
def mint_unit_ids(spark: SparkSession, d: str) -> DataFrame:
    segs = D.lines(spark, d).select("doc_id", "seq", F.col("doc_id").cast("string").alias("chapter"), F.length("text").cast("long").alias("length"))
    return M.mint_units(segs).select("doc_id", "seq", "unit", F.col("length").cast("long").alias("length"))


@query("""SELECT c_custkey::VARCHAR AS unit, 'edition' AS witness, c_mktsegment AS chapter, 'prose' AS kind,
  CASE WHEN o.t IS NULL THEN 'NA' WHEN o.f = 'LACUNA' THEN 'LACUNA' WHEN o.f = 'ABSENT' THEN 'ABSENT' ELSE 'PRESENT' END AS status,
  CASE WHEN o.t IS NULL THEN NULL WHEN o.f IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS d_cov
FROM customer LEFT JOIN (SELECT o_custkey, 1 AS t,
  CASE WHEN min(o_orderstatus) = 'F' THEN 'LACUNA' WHEN min(o_orderstatus) = 'O' THEN 'ABSENT' END AS f
  FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey""")
def edition_cells(spark: SparkSession, d: str) -> DataFrame:
    """An edition matched by id: customers with their orders' least status as flag."""
    flag = F.when(F.min("o_orderstatus") == "F", "LACUNA").when(F.min("o_orderstatus") == "O", "ABSENT")
    edition = D.table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("unit")).agg(F.lit("text").alias("text"), flag.alias("flag"))
    rows = D.table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("unit"), F.col("c_mktsegment").alias("chapter"), F.lit("prose").alias("kind"),
    )
    return M.edition_cells(rows, edition, "edition").select("unit", "witness", "chapter", "kind", "status", "d_cov")


@query(
    f"""WITH {D.MATRIX}, k AS (SELECT *, row_number() OVER (ORDER BY witness, unit) AS row_no
  FROM cells WHERE status = 'PARTIAL') SELECT row_no, unit, witness, round(d_len, 4) AS d_len FROM k ORDER BY row_no LIMIT 100"""
)
def topn_review(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred cells for review: a report's limit over a total order."""
    c = D.cells(spark, d).where("status = 'PARTIAL'").orderBy("witness", "unit").limit(100)
    return c.select(
        F.row_number().over(Window.orderBy("witness", "unit")).cast("long").alias("row_no"), "unit", "witness",
        F.round("d_len", 4).alias("d_len"),
    )
