from pyspark.sql import functions as F

from collatio.functions import guards as G
from collatio.functions import ids, lexicon
from collatio.functions import similarity as S
from collatio.functions import text as T


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_numerals(spark):
    got = one(spark, [("三十二",), ("十",), ("一百八",), ("萬",), ("二三",)], "x string", T.zh_number(F.col("x")))
    assert [g[0] for g in got] == [32, 10, 108, 0, 3]
    got = one(spark, [("སུམ་ཅུ་རྩ་གཉིས་",), ("བཅུ་ལྔ་དང་བརྒྱ་",), ("གཅིག",), ("",)], "x string", T.bo_numbers(F.col("x")))
    assert [g[0] for g in got] == [[32], [15, 100], [], []]
    got = one(spark, [("dvātriṃśan nāḍyaḥ",), ("",)], "x string", T.sa_numbers(F.col("x")))
    assert [g[0] for g in got] == [[32], []]


def test_lengths_and_clauses(spark):
    got = one(spark, [("彼，血。", "zh"), ("རྩ་ནི་སུམ།", "bo"), ("two words", "xx"), (None, "xx")], "x string, lang string", T.length_in(F.col("x"), F.col("lang")))
    assert [g[0] for g in got][:3] == [2, 3, 2]
    got = one(spark, [("絕智棄辯，民利百倍。  。tail",)], "x string", T.clauses(F.col("x")), T.sentences(F.col("x")))
    assert got[0][0] == ["絕智棄辯，", "民利百倍。", "tail"]


def test_similarity(spark):
    got = one(spark, [("abc", "abd"), ("", "a"), ("ab", "ab")], "a string, b string", S.dice(F.col("a"), F.col("b")), S.gram_recall(F.col("a"), F.col("b"), 2))
    assert [round(g[0], 4) for g in got] == [0.6, 0.0, 1.0] and [g[1] for g in got] == [0.5, 0.0, 1.0]
    got = one(spark, [(["num:3", "a"], ["num:3", "b"]), ([], [])], "a array<string>, b array<string>", S.jaccard(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.5, 0.0]
    got = one(spark, [([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>", S.cosine(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [0.0, 0.0]
    df = spark.createDataFrame([(1, "abcab"), (2, "a"), (3, None)], "k long, t string")
    assert sorted(tuple(r) for r in S.gram_rows(df, ["k"], "t", 2).collect()) == [(1, "ab"), (1, "bc"), (1, "ca")]


def test_lexicon_consumes_longest_first(spark):
    lex = lexicon.Lexicon((lexicon.Term("a", "name", {"zh": ("金剛",)}), lexicon.Term("b", "name", {"zh": ("金剛藏",)}, True)), "吽唵")
    got = one(spark, [("金剛藏三十",), ("金剛",), ("唵吽",)], "x string", lex.anchors(F.col("x"), "zh"), lex.density(F.col("x"), "zh"))
    assert [g[0] for g in got] == [["name:b", "num:30"], ["name:a"], []]
    assert [round(g[1], 2) for g in got] == [0.6, 0.0, 1.0]


def test_ids(spark):
    rows = [("I.5.12a",), ("I.1.p03",), ("II.12.t0012",), ("+zh:1-2",), ("I.12.1",), ("x",)]
    got = one(spark, rows, "u string", ids.render(ids.parse(F.col("u"))), ids.chapter_key(ids.parse(F.col("u"))))
    assert [g[0] for g in got] == ["I.5.12a", "I.1.p03", "II.12.t0012", "+zh:1-2", None, None]


def test_guards(spark):
    said = '<think>{"a": 0}</think> ok ```json\n{"v": "accept", "c": "7", "vals": [" a b ", "zz"]}\n```'
    got = one(spark, [(said, "x a b y"), ('noise {"v": "odd"} end', "t"), ("none", "t")], "r string, t string", G.answer(F.col("r"), "v string, c string, vals array<string>").alias("a"), "t")
    df = spark.createDataFrame(got, "a struct<v:string,c:string,vals:array<string>>, t string")
    out = df.select(G.one_of(F.col("a.v"), G.VERDICTS, "unsure"), G.unit_interval(F.col("a.c")), G.verbatim(F.col("a.vals"), F.col("t")), G.invented(F.col("a.vals"), F.col("t"))).collect()
    assert tuple(out[0]) == ("accept", 1.0, ["a b"], ["zz"]) and out[1][0] == "unsure" and out[2][1] == 0.0
    dist = one(spark, [({"a": "1", "b": "-3", "c": "x"},), ({},)], "m map<string,string>", G.distribution(F.col("m"), ("a", "b", "c", "abstain"), "abstain"))
    assert dist[0][0] == {"a": 1.0, "b": 0.0, "c": 0.0, "abstain": 0.0} and dist[1][0]["abstain"] == 1.0
    tiled = one(spark, [(["ab", "cd"], "ab cd"), (["cd", "ab"], "ab cd")], "p array<string>, t string", G.tiles(F.col("p"), F.col("t")))
    assert tiled == [(["ab", "cd"],), (["ab cd"],)]


def test_density_marks_terms_and_runs_apart(spark):
    lex = lexicon.Lexicon((lexicon.Term("a", "name", {"zh": ("拏吉", "吉尼金")}, True), lexicon.Term("b", "name", {"zh": ("薩",)}, True)), "拏吉尼")
    got = one(spark, [("拏金薩",), ("薩",), ("拏",), ("拏吉尼金",), ("",), ("金，拏尼。",)], "x string", lex.density(F.col("x"), "zh"))
    assert [round(g[0], 4) for g in got] == [0.3333, 1.0, 0.0, 1.0, 0.0, 0.6667]


def test_anchors_of_normalised_sanskrit(spark):
    lex = lexicon.Lexicon((lexicon.Term("yogin", "term", {"sa": ("yogin",)}),))
    got = one(spark, [("YOGIN 3",)], "x string", lex.anchors_in(F.col("x"), F.lit("sa")))
    assert got == [(["term:yogin"],)]
