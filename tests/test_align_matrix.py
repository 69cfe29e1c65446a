import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from collatio.operators import align as L
from collatio.operators import attribution as A
from collatio.operators import judging as J
from collatio.operators import matrix as M
from collatio.operators import metrics as X


def brute(lr, lw, ref, wit, sim, p):
    """Least cost over all bead sequences, by plain recursion."""
    c = sum(lw) / sum(lr) if lr else 1.0

    def best(i, j):
        if i == len(lr) and j == len(lw):
            return 0.0
        out = []
        if i < len(lr):
            out.append(p.prior_null + best(i + 1, j))
        if j < len(lw):
            out.append(p.prior_null + best(i, j + 1))
        for k, m in L.TWO_SIDED:
            if i + k <= len(lr) and j + m <= len(lw):
                a, b = sum(lr[i : i + k]), sum(lw[j : j + m])
                s = sim.compare(sim.features(ref[i : i + k], k), sim.features(wit[j : j + m], m))[0, 0]
                both = sim.conflicts and s == 0 and any(ref[i : i + k]) and any(wit[j : j + m])
                out.append(p.prior(k, m) + 0.5 * ((b - c * a) / math.sqrt(p.variance * a)) ** 2 - p.anchor_weight * s + p.conflict * both + best(i + k, j + m))
        return min(out)

    return best(0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_alignment_is_optimal_and_tiles(seed):
    rng = random.Random(seed)
    n, m = rng.randint(0, 4), rng.randint(0, 4)
    for sim, make in ((L.CharGrams(), lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))), (L.Anchors(), lambda: rng.sample(["x", "y", "num:2"], rng.randint(0, 2)))):
        ref, wit = [make() for _ in range(n)], [make() for _ in range(m)]
        lr, lw = [rng.randint(1, 9) for _ in range(n)], [rng.randint(1, 9) for _ in range(m)]
        beads = L.solve(lr, lw, ref, wit, sim, L.Params())
        assert list(itertools.chain(*(b[0] for b in beads))) == list(range(n))
        assert list(itertools.chain(*(b[1] for b in beads))) == list(range(m))
        assert abs(sum(b[2] for b in beads) - brute(lr, lw, ref, wit, sim, L.Params())) < 1e-9


CELLS = [
    ("u1", "w", "c1", "PRESENT"), ("u2", "w", "c1", "ABSENT"), ("u3", "w", "c2", "PARTIAL"), ("u4", "w", "c2", "LACUNA"),
    ("u1", "s", "c1", "PRESENT"), ("u2", "s", "c1", "ABSENT"), ("u3", "s", "c2", "PRESENT"), ("u4", "s", "c2", "PRESENT"),
    ("u2", "co", "c1", "PRESENT"), ("u3", "co", "c2", "ABSENT"), ("+w:x", "w", "c1", "PRESENT"),
]


@pytest.fixture()
def cells(spark):
    return spark.createDataFrame([(*c, "prose", 1.0, 0.5) for c in CELLS], "unit string, witness string, chapter string, status string, kind string, d_cov double, d_len double")


def test_structure_and_decomposition(spark, cells):
    chapters = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "chapter string")
    got = {r.chapter: r for r in M.structure(cells, chapters, spark.createDataFrame([("w",)], "witness string")).collect()}
    assert (got["c1"].n_units, got["c1"].n_orphan, got["c1"].coverage, got["c3"].n_units, got["c3"].coverage) == (2, 1, 0.5, 0, None)
    units = X.decompose_units(cells, "w", ["s"], "co")
    assert {r.unit: r["class"] for r in units.collect()} == {"u1": None, "u2": "vorlage_explained", "u3": "shared_with_cowitness"}
    d = X.decompose(units).first()
    assert (d.n_counted, d.n_deviating, d.residual) == (3, 2, 0)


def test_gate_and_attribution(spark, cells):
    units = spark.createDataFrame([("u1", None), ("u2", None), ("u3", None), ("u4", None)], "unit string, flag string")
    got = {r.unit: r for r in A.attribute(units, cells, "w", ["s"], "co").collect()}
    assert (got["u1"].abstain, got["u2"].top, got["u3"].top, got["u4"].top) == (1.0, "vorlage_attested", "shared_with_cowitness", "lacuna")
    for r in got.values():
        assert abs(sum(r[x] for x in A.LABELS) - 1) < 1e-5


def test_bootstrap_distance_order(spark, cells):
    one = spark.createDataFrame([("c", 2.0, 4)], "chapter string, total double, n long")
    b = X.bootstrap(one, n_boot=50).first()
    assert (b.estimate, b.lo, b.hi, b.n_blocks) == (0.5, 0.5, 0.5, 1)
    several = spark.createDataFrame([(w, f"c{i}", float(i % 3), 3) for w in "xy" for i in range(12 if w == "x" else 1)], "witness string, chapter string, total double, n long")
    by = {r.witness: r for r in X.bootstrap(several, by=["witness"]).collect()}
    alone = X.bootstrap(several.where("witness = 'x'")).first()
    assert by["x"].lo < by["x"].estimate < by["x"].hi and by["y"].lo == by["y"].hi == 0.0 and (by["x"].lo, by["x"].hi) == (alone.lo, alone.hi)
    assert abs(by["x"].estimate - 1 / 3) < 1e-9 and by["x"].n_blocks == 12
    middle = X.bootstrap(several.where("witness = 'x'").select("chapter", "total"), n_boot=40, stat=F.median("total")).first()
    assert middle.estimate == 1.0 and middle.lo <= 1.0 <= middle.hi
    assert math.isnan(X.bootstrap(one.limit(0)).first().estimate)
    dist = {(r.a, r.b): r for r in X.witness_distances(cells, ["d_len"]).collect()}
    assert dist["s", "w"].n == 3 and abs(dist["s", "w"].distance - 1 / 3) < 1e-9
    o = spark.createDataFrame([("g", i, i, -i) for i in range(3)], "g string, item int, a int, b int")
    assert X.kendall(o, ["g"], "item", "a", "b").first().tau == 1.0
    assert X.tree(["a", "b", "c"], {("a", "b"): 1.0, ("a", "c"): 4.0, ("b", "c"): 4.0}) == "(c:2.0000,(a:0.5000,b:0.5000):1.5000);"


def test_calibration_and_upsert(spark):
    rows = [(f"u{i}", "w", "PRESENT", 1.0, x, "k") for i, x in enumerate((0.0, 0.1, -0.1, -2.0))] + [("u9", "w", "ABSENT", 0.0, None, "k")]
    c = spark.createDataFrame(rows, "unit string, witness string, status string, d_cov double, d_len double, kind string")
    got = {r.unit: (r.status, r.d_cov) for r in M.calibrate(c).collect()}
    assert got["u3"] == ("PARTIAL", 0.5) and got["u0"] == ("PRESENT", 1.0) and got["u9"] == ("ABSENT", 0.0)
    w = spark.createDataFrame([("u", "w", 1, "a"), ("u", "w", 2, "b")], "unit string, witness string, ord int, v string")
    assert M.upsert(w, "ord").first().v == "b" and M.upsert(w, "ord", last=False).first().v == "a"


def test_matching(spark):
    u = spark.createDataFrame([("a", "c", "k", 10, True), ("b", "c", "k", 10, True), ("x", "c", "k", 11, False), ("y", "c", "k", 99, False)], "unit string, chapter string, kind string, length int, sensitive boolean")
    assert [tuple(r) for r in X.match(u).collect()] == [("c", "k", "a", "x")]


def test_candidates_of_one_group_are_dealt_out(spark, monkeypatch):
    """All pairs, as many as a plain loop finds, and those of one group in many tasks, though the input is one partition."""
    rng = random.Random(3)
    rows = [(f"s{i}", "c", "k", 10, True) for i in range(60)] + [(f"n{i}", "c", "k", 10 + i % 2, False) for i in range(60)]
    rows += [(f"r{i}", rng.choice("ab"), rng.choice("xy"), rng.choice([None, 0, 1, 2, 7, 10, 14, 15, 99, 10**12]), rng.random() < 0.4) for i in range(150)]
    rows += [(None, "a", "x", 7, True), (None, "a", "x", 7, False), ("twice", "a", "x", 7, True), ("twice", "a", "x", 7, True), ("out", None, "x", 7, True), ("out", "a", "x", 7, None)]
    units = spark.createDataFrame(rows, "unit string, chapter string, kind string, length long, sensitive boolean").coalesce(1)
    monkeypatch.setattr(X, "BLOCK", 8, raising=False)
    size = lambda n: max(1, n or 1)
    for tolerance in (0.35, 0.0, 40.0):
        found = X.match_candidates(units, tolerance).withColumn("task", F.spark_partition_id()).collect()
        pairs = Counter(
            (a[1], a[2], a[0], b[0]) for a in rows for b in rows
            if a[4] and b[4] is False and a[1] and a[1:3] == b[1:3] and abs(math.log(size(b[3]) / size(a[3]))) <= tolerance
        )
        assert Counter((r.chapter, r.kind, r.unit, r.mate) for r in found) == pairs
        tasks = Counter(r.task for r in found if r.chapter == "c")
        assert len(tasks) >= 4 and max(tasks.values()) < sum(tasks.values()) / 2


def test_judge_with_mock(spark):
    rows = spark.createDataFrame([("r", "w", "", "", "2:2", None), ("r", "w", "", "", "1:1", None)], "ref_text string, wit_text string, before string, after string, shape string, review_status string")
    sure = J.Mock(respond=lambda p: '{"verdict": "split", "confidence": 0.9}')
    assert [r.review_status for r in J.judge_beads(J.to_judge(rows), sure).collect()] == ["llm:split"]
    assert [r.review_status for r in J.judge_beads(J.to_judge(rows), J.Mock()).collect()] == ["llm:unsure"]
    facts = spark.createDataFrame([("u", "x is ABSENT"), ("v", "")], "unit string, facts string")
    named = J.judge_attribution(facts, J.Mock(respond=lambda p: '{"distribution": {"lacuna": 1}, "note": "surely censored"}'))
    assert all(r.motive and r.top == "abstain" for r in named.collect())
    said = J.judge_attribution(facts, J.Mock(respond=lambda p: '{"distribution": {"lacuna": 1}}'))
    assert {r.unit: max(r.distribution, key=r.distribution.get) for r in said.collect()} == {"u": "lacuna", "v": "abstain"}


def test_ngrams_are_made_once_a_span(spark):
    """The plan of the candidates builds n-grams below the join of the spans, not for every pair."""
    side = spark.createDataFrame([("g", i, 2, t) for i, t in enumerate(("ab", "bc", "cd"))], "grp string, seq long, length long, payload string")
    c = L.bead_candidates(side, side)
    assert c.count() == 9 + 2 * 6 + 4 + 2 * 3
    plan = c._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = {name: [len(line) - len(line.lstrip(" :+-")) for line in plan if name in line] for name in ("Join Inner", "zip_with")}
    assert depth["zip_with"] and min(depth["zip_with"]) > min(depth["Join Inner"]) and sum("zip_with" in line for line in plan) <= 4


def test_shared_keys_by_tiles(monkeypatch):
    rng = random.Random(7)
    a, b = ([set(rng.sample([f"k{i}" for i in range(50)] + ["num:1"], rng.randint(0, 9))) for _ in range(n)] for n in (5, 7))
    monkeypatch.setattr(L, "TILE", 3)
    both, x, y = L._shared(a, b, lambda k: 2.0 if k.startswith("num:") else 1.0)
    weigh = lambda s: sum(2.0 if k.startswith("num:") else 1.0 for k in s)
    assert all(both[i, j] == weigh(a[i] & b[j]) for i in range(5) for j in range(7)) and list(x) == [weigh(s) for s in a] and list(y) == [weigh(s) for s in b]


def test_decompose_all_equals_single(spark, cells):
    wanted = spark.createDataFrame([("w", "co"), ("s", None)], "witness string, cowitness string")
    got = {r.witness: r for r in X.decompose_all(cells, wanted, ["s"], "s").collect()}
    one = X.decompose(X.decompose_units(cells, "w", ["s"], "co", "s")).first()
    assert all(got["w"][c] == one[c] for c in ("n_counted", "n_deviating", *X.CLASSES)) and got["s"].residual == got["s"].n_deviating == 1


def test_reports_and_roles_without_answers(spark):
    rows = spark.createDataFrame([("a", "x y", "xx", ["term:b"])], "unit string, text string, lang string, anchors array<string>")
    empty = J.extract_components(rows, J.Mock()).first()
    assert all(v == [] for v in empty.slots.values()) and empty.rejected == [] and empty.model_id == "mock"
    assert J.call_log(J.label_topics(rows, J.Mock())).first().n_response_chars == len('{"topic": "", "cues": []}')
    table = spark.createDataFrame([(0, "1:1", "r", "w0", ""), (1, "1:0", "r", "", ""), (2, "0:1", "", "w2", "human:ok")], "row_no long, shape string, ref_text string, wit_text string, review_status string")
    seen = []
    judged = J.judge_table(table, J.Mock(respond=lambda p: json.dumps({"verdict": "make_null", "confidence": 0.9, "shared_content": ["a", "b"], "note": "n" if "w0" in p and "w2" in p else "?"})))
    got = {r.row_no: (r.review_status, r.review_note, r.model_id) for r in judged.collect()}
    assert got == {0: ("", "", None), 1: ("llm:make_null", "[mock c=0.90] a; b n", "mock"), 2: ("human:ok", "", None)} and not seen
