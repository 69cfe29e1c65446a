"""Queries of the alignment: a conversation's user turns against its assistant turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import similarity as S
from collatio.operators import align as L
from collatio.operators import judging as J
from collatio.plans import adapters as D
from collatio.plans.text_queries import dice_sql
from collatio.session import kept

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P = L.Params(anchor_weight=6.0, conflict=0.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return D.turns(spark, d, "user"), D.turns(spark, d, "assistant")


SHAPES = ", ".join(f"({k}, {m}, {P.prior(k, m)}::DOUBLE)" for k, m in L.TWO_SIDED)


def _spans(name: str, side: str) -> str:
    return f"""{name} AS (SELECT a.grp, a.i AS first, k, sum(greatest(1, b.length))::DOUBLE AS length, string_agg(b.payload, '' ORDER BY b.i) AS text
  FROM {side} a, (VALUES (1), (2), (3)) s(k) JOIN {side} b ON b.grp = a.grp AND b.i BETWEEN a.i AND a.i + k - 1 GROUP BY a.grp, a.i, k HAVING count(*) = k)"""


CAND = f"""{D.turns_sql('u', 'user')}, {D.turns_sql('v', 'assistant')}, {_spans('rs', 'u')}, {_spans('ws', 'v')}, shape(k, l, prior) AS (VALUES {SHAPES}),
ratio AS (SELECT r.grp, w / r AS ratio FROM (SELECT grp, sum(greatest(1, length)) AS r
  FROM u GROUP BY grp) r JOIN (SELECT grp, sum(greatest(1, length)) AS w FROM v GROUP BY grp) w ON r.grp = w.grp),
met AS (SELECT rs.grp, rs.first AS i, ws.first AS j, rs.k, ws.k AS l, prior, rs.length AS lr, ws.length AS lw, ratio,
  {dice_sql('rs.text', 'ws.text')} AS sim FROM rs JOIN ws ON rs.grp = ws.grp JOIN shape ON shape.k = rs.k AND shape.l = ws.k JOIN ratio ON ratio.grp = rs.grp),
cand AS (SELECT grp, i, j, k, l, sim, prior + {P.length_weight}::DOUBLE * 0.5::DOUBLE * ((lw - ratio * lr) / sqrt({P.variance}::DOUBLE * lr)) * ((lw - ratio * lr) / sqrt({P.variance}::DOUBLE * lr)) - {P.anchor_weight}::DOUBLE * sim AS cost FROM met)"""


@query(f"WITH {CAND} SELECT grp, i, j, k, l, round(sim, 4) AS similarity, round(cost, 4) AS cost FROM cand")
def bead_candidates(spark: SparkSession, d: str) -> DataFrame:
    c = L.bead_candidates(*_sides(spark, d), P)
    return c.select(
        "grp", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "k", "l",
        F.round("similarity", 4).alias("similarity"), F.round("cost", 4).alias("cost"),
    )


#: The cheapest cost of every place (i, j) of a group's table: s counts the segments used so far.
TABLE = f"""{CAND},
size AS (SELECT g.grp, coalesce(n, 0)::BIGINT AS n, coalesce(m, 0)::BIGINT AS m FROM (SELECT grp FROM u UNION SELECT grp
  FROM v) g LEFT JOIN (SELECT grp, count(*) AS n FROM u GROUP BY grp) a ON a.grp = g.grp LEFT JOIN (SELECT grp, count(*) AS m
  FROM v GROUP BY grp) b ON b.grp = g.grp),
moves AS (SELECT grp, i, j, k, l, cost FROM cand),
front(grp, s, i, j, d) AS (
  SELECT grp, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM size
  UNION ALL
  SELECT grp, s + 1, i, j, min(d) FROM (
    SELECT f.grp, f.s, f.i, f.j, f.d FROM front f JOIN size ON size.grp = f.grp WHERE f.i + f.j > f.s AND f.s < n + m
    UNION ALL SELECT f.grp, f.s, f.i + 1, f.j, f.d + {P.prior_null}::DOUBLE FROM front f JOIN size ON size.grp = f.grp WHERE f.i + f.j = f.s AND f.i < n
    UNION ALL SELECT f.grp, f.s, f.i, f.j + 1, f.d + {P.prior_null}::DOUBLE FROM front f JOIN size ON size.grp = f.grp WHERE f.i + f.j = f.s AND f.j < m
    UNION ALL SELECT f.grp, f.s, f.i + moves.k, f.j + moves.l, f.d + moves.cost
  FROM front f JOIN moves ON moves.grp = f.grp AND moves.i = f.i AND moves.j = f.j WHERE f.i + f.j = f.s) GROUP BY grp, s, i, j)"""
PREFERRED = " ".join(f"WHEN k = {k} AND l = {m} THEN {i}" for i, (k, m) in enumerate([*L.TWO_SIDED, (1, 0), (0, 1)]))
#: The cheapest beads, found backwards: of equal costs the first in the solver's order of shapes.
BEADS = f"""{TABLE},
dp AS (SELECT grp, i, j, min(d) AS d FROM front WHERE i + j = s GROUP BY ALL),
arrive AS (SELECT c.grp, c.i + c.k AS i, c.j + c.l AS j, c.k, c.l, c.cost, c.sim, dp.d + c.cost AS total
  FROM cand c JOIN dp ON dp.grp = c.grp AND dp.i = c.i AND dp.j = c.j
  UNION ALL SELECT dp.grp, dp.i + 1, dp.j, 1, 0, {P.prior_null}::DOUBLE, 0.0::DOUBLE, d + {P.prior_null}::DOUBLE FROM dp JOIN size USING (grp) WHERE dp.i < n
  UNION ALL SELECT dp.grp, dp.i, dp.j + 1, 0, 1, {P.prior_null}::DOUBLE, 0.0::DOUBLE, d + {P.prior_null}::DOUBLE FROM dp JOIN size USING (grp) WHERE dp.j < m),
even AS (SELECT *, CASE {PREFERRED} END AS pref, min(total) OVER (PARTITION BY grp, i, j) AS least FROM arrive),
best AS (SELECT grp, i, j, arg_min(k, pref) AS k, arg_min(l, pref) AS l, arg_min(cost, pref) AS cost, arg_min(sim, pref) AS sim
  FROM even WHERE total <= least + {L.EVEN}::DOUBLE GROUP BY ALL),
walk(grp, i, j, t) AS (SELECT grp, n, m, 0 FROM size UNION ALL SELECT w.grp, w.i - b.k, w.j - b.l, w.t + 1
  FROM walk w JOIN best b ON b.grp = w.grp AND b.i = w.i AND b.j = w.j WHERE w.i + w.j > 0),
beads AS (SELECT w.grp, (count(*) OVER (PARTITION BY w.grp) - 1 - w.t)::INT AS bead_no, b.i - b.k AS r0, b.j - b.l AS w0, b.k, b.l,
  b.k || ':' || b.l AS shape, b.cost, b.sim FROM walk w JOIN best b ON b.grp = w.grp AND b.i = w.i AND b.j = w.j)"""
#: Cells of the beads: units are user turns, coordinates those of assistant turns.
CELLS = f"""{BEADS},
mid AS (SELECT side, grp, i, seq, payload, greatest(1, length) AS len, (coalesce(sum(greatest(1, length)) OVER (PARTITION BY side,
  grp ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + greatest(1, length) / 2.0::DOUBLE) / sum(greatest(1,
  length)) OVER (PARTITION BY side, grp) AS pos
  FROM (SELECT 'u' AS side, * FROM u UNION ALL SELECT 'v', * FROM v)),
rs2 AS (SELECT b.grp, bead_no, sum(len) AS lr FROM beads b JOIN mid ON side = 'u' AND mid.grp = b.grp AND mid.i >= r0 AND mid.i < r0 + k GROUP BY ALL),
ws2 AS (SELECT b.grp, bead_no, sum(len) AS lw, avg(pos) AS pos, arg_min(seq, i) AS a, arg_max(seq, i) AS z
  FROM beads b JOIN mid ON side = 'v' AND mid.grp = b.grp AND mid.i >= w0 AND mid.i < w0 + l GROUP BY ALL),
cells AS (SELECT 'C.' || b.grp || '.' || mid.seq AS unit, b.grp AS chapter,
  CASE WHEN l > 0 THEN 'PRESENT' ELSE 'ABSENT' END AS status, b.grp || '.' || a AS span_start, shape AS bead,
  CASE WHEN l > 0 THEN ln(lw / lr) END AS d_len, CASE WHEN l > 0 THEN abs(ws2.pos - mid.pos) END AS d_ord,
  CASE WHEN l > 0 THEN ln((k * l)::DOUBLE) ELSE 0.0 END::DOUBLE AS d_split, sim AS similarity, mid.payload, b.grp
    FROM beads b JOIN mid ON side = 'u' AND mid.grp = b.grp AND mid.i >= r0 AND mid.i < r0 + k
  JOIN rs2 ON rs2.grp = b.grp AND rs2.bead_no = b.bead_no LEFT JOIN ws2 ON ws2.grp = b.grp AND ws2.bead_no = b.bead_no
  UNION ALL SELECT '+assistant:' || b.grp || '.' || a ||
  CASE WHEN a = z THEN '' ELSE '-' || b.grp || '.' || z END, b.grp, 'PRESENT', b.grp || '.' || a, shape, NULL, NULL, 0.0, 0.0, NULL, b.grp
  FROM beads b JOIN ws2 ON ws2.grp = b.grp AND ws2.bead_no = b.bead_no WHERE k = 0)"""


@query(
    f"""WITH RECURSIVE {TABLE} SELECT f.grp, round(min(d), 3) AS cost FROM front f JOIN size ON size.grp = f.grp WHERE f.i = n AND f.j = m GROUP BY f.grp"""
)
def align_cost(spark: SparkSession, d: str) -> DataFrame:
    return _beads(spark, d).groupBy("grp").agg(F.round(F.sum("cost"), 3).alias("cost"))


def _beads(spark: SparkSession, d: str) -> DataFrame:
    return L.align(*_sides(spark, d), "chargrams", P)


@query(f"WITH RECURSIVE {BEADS} SELECT grp, bead_no, shape, round(cost, 4) AS cost, round(sim, 4) AS similarity FROM beads")
def align_beads(spark: SparkSession, d: str) -> DataFrame:
    return _beads(spark, d).select(
        "grp", "bead_no", L.shape_of(F.col("ref"), F.col("wit")).alias("shape"), F.round("cost", 4).alias("cost"),
        F.round("similarity", 4).alias("similarity"),
    )


@query(f"WITH RECURSIVE {BEADS} SELECT grp, shape, count(*) AS n FROM beads GROUP BY ALL")
def alignment_summary(spark: SparkSession, d: str) -> DataFrame:
    return L.alignment_summary(_beads(spark, d))


def _matrix_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    u, v = (L.with_positions(s) for s in _sides(spark, d))
    units = u.select(
        "grp", "seq", F.concat_ws(".", F.lit("C"), "grp", "seq").alias("unit"), F.col("grp").alias("chapter"), F.lit("prose").alias("kind"),
        "length", "position", F.lit(None).cast("string").alias("flag"), F.col("payload").alias("norm"),
    )
    coord = F.concat_ws(".", "grp", "seq")
    wits = v.select(
        "grp", "seq", coord.alias("start"), coord.alias("end"), F.col("payload").alias("text"), F.lit("xx").alias("lang"),
        F.lit("prose").alias("kind"), "length", "position", F.col("payload").alias("norm"),
    )
    return units, wits


def _cells(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units, wits = _matrix_sides(spark, d)
    # the cells and what lies beside them read the beads several times
    return L.cells_from_beads(kept(_beads(spark, d)), units, wits, "assistant"), units, wits


@query(
    f"WITH RECURSIVE {CELLS} SELECT unit, chapter, status, bead, {', '.join(f'round({x}, 4) AS {x}' for x in ('d_len', 'd_ord', 'd_split', 'similarity'))} FROM cells"
)
def cells_from_beads(spark: SparkSession, d: str) -> DataFrame:
    c, _, _ = _cells(spark, d)
    return c.select("unit", "chapter", "status", "bead", *(F.round(x, 4).alias(x) for x in ("d_len", "d_ord", "d_split", "similarity")))


@query(f"""WITH RECURSIVE {CELLS}, near AS (SELECT c.unit, c.span_start, v.grp || '.' || v.seq AS start, v.seq,
  {dice_sql('c.payload', 'v.payload')} AS s
  FROM cells c JOIN v ON v.grp = c.grp WHERE status = 'PRESENT' AND similarity < 0.75::DOUBLE AND NOT starts_with(unit, '+')),
top AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY s DESC, seq DESC) AS n FROM near)
SELECT unit, span_start AS from_start, start AS to_start, round(s, 4) AS similarity, '1:1*' AS bead
  FROM top WHERE n = 1 AND s >= 0.6::DOUBLE AND start <> span_start""")
def reorder_pass(spark: SparkSession, d: str) -> DataFrame:
    c, units, wits = _cells(spark, d)
    r = L.reorder(
        c, units.select("unit", "grp", "norm", "position"), wits.select("grp", "seq", "start", "end", "text", "norm", "position"), low=0.75,
        high=0.6,
    )
    return r.where("from_start is not null").select(
        "unit", "from_start", F.col("span_start").alias("to_start"), F.round("similarity", 4).alias("similarity"), "bead",
    )


@query(f"""WITH {D.turns_sql('u', 'user')}, {D.turns_sql('v', 'assistant')}, m AS (SELECT u.grp, u.seq, v.seq AS j,
  {dice_sql('u.payload', 'v.payload')} AS s
  FROM u JOIN v ON u.grp = v.grp), r AS (SELECT *, row_number() OVER (PARTITION BY grp, seq ORDER BY round(s, 9) DESC, j DESC) AS n FROM m)
SELECT grp, seq, j, round(s, 4) AS similarity FROM r WHERE n = 1""")
def best_match(spark: SparkSession, d: str) -> DataFrame:
    """Each user turn's most similar assistant turn; of equals the last."""
    u, v = (s.select("grp", "seq", S.dice_grams(F.col("payload")).alias("grams")) for s in _sides(spark, d))
    met = u.join(v.select("grp", F.col("seq").alias("j"), F.col("grams").alias("other")), "grp")
    m = met.select("grp", "seq", F.struct(F.round(S.dice_of(F.col("grams"), F.col("other")), 9).alias("s"), "j").alias("b"))
    return m.groupBy("grp", "seq").agg(F.max("b").alias("b")).select("grp", "seq", "b.j", F.round("b.s", 4).alias("similarity"))


@query(
    f"""WITH {D.turns_sql('v', 'assistant')} SELECT grp, seq, coalesce(lag(payload) OVER w, '') AS before, coalesce(lead(payload) OVER w,
  '') AS after FROM v WINDOW w AS (PARTITION BY grp ORDER BY seq)"""
)
def review_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = D.turns(spark, d, "assistant")
    return J.neighbours(v, "seq", "payload", ["grp"]).select("grp", "seq", "before", "after")


@query(
    f"""WITH RECURSIVE {CELLS} SELECT unit, bead AS shape, 'unsure' AS verdict, 0.0::DOUBLE AS confidence, 'llm:unsure' AS review_status,
  '[mock c=0.00]' AS review_note FROM cells WHERE bead IN ({', '.join(repr(x) for x in J.DOUBTFUL)})"""
)
def mock_judge(spark: SparkSession, d: str) -> DataFrame:
    """Doubtful beads through the judge with the mock model: empty answers come out unsure."""
    c, _, _ = _cells(spark, d)
    rows = c.select(
        "unit", F.col("bead").alias("shape"), F.lit("").alias("review_status"), F.coalesce("text", F.lit("")).alias("wit_text"),
        F.col("unit").alias("ref_text"), F.lit("").alias("before"), F.lit("").alias("after"),
    )
    return J.judge_beads(J.to_judge(rows), J.Mock()).select("unit", "shape", "verdict", "confidence", "review_status", "review_note")
