import json

import pytest
from pyspark.sql import functions as F

from collatio import report
from collatio.functions import text as T
from collatio.operators import judging as J
from collatio.plans import transfer as TR
from collatio.sources import folio, marked, tables, tei

REF = "// note\n#1\n道生一，一生二。二生三。\n#2\n上善若水，水善利。\n#3\n天長地久。\n"
OTHER = "#3 @甲1\n天長地久。\n#1\n一生二，道生□。□□□□。\n"


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_marked_text_and_transfer(spark, tmp_path):
    put(tmp_path / "ref.txt", REF)
    put(tmp_path / "oth.txt", OTHER)
    segs = marked.read_marked(spark, f"{tmp_path}/*.txt")
    got = {(r.witness, r.seg_id): r for r in segs.collect()}
    assert [r.text for k, r in sorted(got.items()) if k[0] == "ref" and r.local_chapter == 1] == ["道生一，", "一生二。", "二生三。"]
    assert got["oth", "oth:1:3"].kind == "lacuna" and got["oth", "oth:3:1"].start == "c3:1@甲1" and got["oth", "oth:3:1"].end == "c3:1"
    orders = {(r.witness, r.item): r.pos for r in marked.chapter_order(segs).collect()}
    assert orders["oth", 3] == 0 and orders["oth", 1] == 1
    registry = spark.createDataFrame([("ref", "complete", True), ("oth", "anthology", False)], "witness string, scope string, reference boolean")
    m = TR.transfer(segs, registry, T.Variants([("恆", "常")]))
    cells = {r.unit: r for r in m.cells.collect()}
    assert cells["L.2.p01"].status == "NA" and cells["L.3.p01"].status == "PRESENT" and cells["L.3.p01"].similarity == 1.0
    assert {r.witness: r.tau for r in m.orders.collect()} == {"ref": 0.0, "oth": 1.0}
    assert m.review.count() >= 2
    report.export(m, f"{tmp_path}/out", ["oth"], {"k": 1})
    assert spark.read.parquet(f"{tmp_path}/out/structure.parquet").count() == len(TR.CHAPTERS)
    about = json.loads((tmp_path / "out/manifest.json").read_text(encoding="utf-8"))
    assert about["reference_grade"] == "coordinate_only" and about["k"] == 1 and about["decompositions"][0]["witness"] == "oth"
    assert "stroke" in (tmp_path / "out/status_strip.svg").read_text() and "oth" in (tmp_path / "out/summary.md").read_text()
    assert {"kendall_tau_distance", "n_chapters"} <= set(spark.read.parquet(f"{tmp_path}/out/chapter_order.parquet").columns)
    assert "<rect" in report.heatmap_svg([{"chapter": "c", "witness": "w", "coverage": 0.5}], "coverage")


def test_half_chapters_and_headers_without_text(spark, tmp_path):
    put(tmp_path / "w.txt", "lost\n#5\n#2上\n甲乙，丙。\n#2下?\n丁，□□戊。\n")
    rows = sorted(marked.read_marked(spark, f"{tmp_path}/w.txt").collect(), key=lambda r: r.seq)
    assert [(r.seg_id, r.end, r.seq, r.uncertain, r.order) for r in rows] == [("w:2上:1", "c2上:1", 1, False, 1), ("w:2上:2", "c2上:2", 2, False, 1), ("w:2下:1", "c2下:1", 3, True, 1), ("w:2下:2", "c2下:2", 4, True, 1)]
    assert rows[3].kind == "lacuna" and rows[3].lacuna_fraction == 0.667


FOLIO = """[1a]
[1a.1]༄༅། །{D1}རྒྱ་གར་སྐད་དུ། ཀ་ཁ། འདི་སྐད་བདག་གིས་
[1b.1]ཐོས་པ་དུས། རྩ་ནི་གསུམ། ལེའུ་སྟེ་དང་པོའོ།། ང་དང་
ཅ་ཆ། ལེའུ་སྟེ་གཉིས་པའོ།། ཆ་རྫོགས་སོ།། {D2}ཇ་ཉ།
"""


def test_folio(spark, tmp_path):
    put(tmp_path / "vol.txt", FOLIO)
    rows = folio.read_folio(spark, f"{tmp_path}/vol.txt", ["D1"]).orderBy("seq").collect()
    assert rows[0].kind == "meta" and all(r.text_id == "D1" for r in rows)
    opening = next(r for r in rows if "ཐོས་པ" in r.text)
    assert (opening.start, opening.end, opening.kind) == ("1a.1", "1b.1", "verse_line")
    # a line without a coordinate of its own goes on at the last one, and loses nothing
    over = next(r for r in rows if "ང་དང་" in r.text)
    assert over.text == "ང་དང་ཅ་ཆ།" and (over.start, over.end) == ("1b.1", "1b.1")
    # each delimiter ends a unit; bare ones are counted but no segments
    assert [r.seq for r in rows] == [0, 1, 2, 3, 4, 6, 7, 9] and rows[4].text == "ལེའུ་སྟེ་དང་པོའོ།" and rows[0].seg_id == "bo:D1:00000"
    chapters = folio.chapters(spark.createDataFrame(rows)).orderBy("n", "end").collect()
    assert [c.ordinal for c in chapters] == [1, 2, None] and [c.text_end for c in chapters] == [False, False, True]
    assert folio.colophons(spark.createDataFrame(rows)).first().colophon == "ཆ་རྫོགས་སོ།"
    both = folio.read_folio(spark, f"{tmp_path}/vol.txt")
    assert {r.text_id for r in both.collect()} == {"D1", "D2"} and both.where("text_id = 'D2'").first().text == "ཇ་ཉ།"


def test_ordinals_are_suffixes(spark):
    rows = [("ལེའུ་སྟེ་དང་དགའ་བའོ",), ("ལེའུ་སྟེ་བཅུ་གཉིས་པའོ",), ("ལེའུ་སྟེ་བཅུ་པའོ",)]
    got = spark.createDataFrame(rows, "t string").select(folio.ordinal(F.col("t")).alias("o")).collect()
    assert [r.o for r in got] == [None, 12, 10]


def test_reference_tsv(spark, tmp_path):
    put(tmp_path / "sa_x.tsv", "# c\nI.1.1\tevaṃ  mayā\nI.1.2\t\tlacuna\nII.1.p01\tx\tABSENT\n")
    rows = tables.read_reference(spark, f"{tmp_path}/sa_*.tsv").orderBy("seq").collect()
    assert [(r.unit, r.chapter, r.text, r.flag) for r in rows] == [("I.1.1", "I.1", "evaṃ mayā", None), ("I.1.2", "I.1", "", "LACUNA"), ("II.1.p01", "II.1", "x", "ABSENT")]
    assert tables.fingerprints(spark, f"{tmp_path}/sa_x.tsv").count() == 1
    put(tmp_path / "sa_y.tsv", "# only\nI.1.1\n")
    with pytest.raises(Exception, match="too few columns"):
        tables.read_reference(spark, f"{tmp_path}/sa_y.tsv").collect()
    assert tables.read_reference(spark, f"{tmp_path}/sa_y.tsv", strict=False).count() == 0


def test_tei(spark, tmp_path):
    xml = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://x"><text><body><lb n="00"/><cb:jhead>經<note>題注</note></cb:jhead><lb n="01"/><cb:mulu type="品" n="1"/><head>序</head>
<lb n="02"/><p>如是，一時<note>n</note>住<lb n="03"/>身語。</p><lg><l>慈，悲。</l></lg></body><back><cb:tt from="#a"><cb:t xml:lang="zh">慈</cb:t><cb:t xml:lang="sa">maitrī.</cb:t></cb:tt>
<app from="#b"><lem>晝</lem><rdg wit="#w">畫</rdg></app></back></text></TEI>"""
    put(tmp_path / "w.xml", xml)
    rows = tei.read_tei(spark, f"{tmp_path}/w.xml").orderBy("seq").collect()
    assert [(r.kind, r.text) for r in rows] == [("meta", "經"), ("head", "序"), ("prose", "如是，"), ("prose", "一時住身語。"), ("verse_line", "慈，"), ("verse_line", "悲。")]
    assert (rows[3].start, rows[3].end, rows[3].local_chapter, rows[3].inline_notes) == ("02", "03", 1, 1)
    assert tei.read_titles(spark, f"{tmp_path}/w.xml").first().title_note == "題注" and tuple(tei.read_chapters(spark, f"{tmp_path}/w.xml").first())[1:] == (1, "", "01")
    assert tei.read_glosses(spark, f"{tmp_path}/w.xml").first().sa == "maitrī"
    assert tei.read_apparatus(spark, f"{tmp_path}/w.xml").first().rdg == ["畫"]


def test_lookup_last_of_merged(spark):
    bridge = spark.createDataFrame([("a", 0, "zh", "1"), ("b", 1, "zh", "1"), ("c", 2, "zh", None)], "chapter string, ord int, lang string, local string")
    assert [tuple(r) for r in tables.chapter_lookup(bridge).select("local", "chapter").collect()] == [("1", "b")]


def test_registry_without_llm():
    import __spark_entry__ as entry

    assert {"structure_l1", "align_cost"} <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_concordance_keeps_parts_apart(spark, tmp_path):
    put(tmp_path / "c.yaml", "chapters:\n- {ref: I.1, bo: {chapter: 1}, zh: {pin: 1}}\n- {ref: II.1, bo: {chapter: 1}, zh: {pin: 11}}\n- {ref: II.2, bo: {}, zh: {pin: null}}\n")
    bridge = tables.load_concordance(spark, f"{tmp_path}/c.yaml")
    got = {(r.lang, r.local): r.chapter for r in tables.chapter_lookup(bridge).collect()}
    assert got == {("bo", "D417:1"): "I.1", ("bo", "D418:1"): "II.1", ("zh", "pin1"): "I.1", ("zh", "pin11"): "II.1"}


def test_lexicon_registry_and_profiles(spark, tmp_path):
    put(tmp_path / "t.yaml", "terms:\n- {sa: Yogin / yoga, zh: [瑜伽], type: term, zh_transliteration: true}\nzh_transliteration_chars: >\n  拏吉\n  尼儗\n")
    lex = tables.load_lexicon(f"{tmp_path}/t.yaml")
    assert lex.terms[0].key == "Yogin" and lex.terms[0].forms["sa"] == ("yogin",) and lex.transliteration_chars == "拏吉尼儗"
    put(tmp_path / "w.yaml", "witnesses:\n- {id: a, lang: sa, layer: edition, date: 1959}\n- {id: b, layer: pivot, cowitness: a}\n")
    reg = {r.id: r for r in tables.load_registry(spark, f"{tmp_path}/w.yaml").withColumn("counts", tables.counts_in_statistics(F.col("layer"))).withColumn("source", tables.is_source(F.col("lang"), F.col("layer"))).collect()}
    assert (reg["a"].counts, reg["a"].source, reg["b"].counts, reg["b"].source, reg["b"].file, reg["a"].date) == (True, True, False, False, "b.txt", "1959")
    put(tmp_path / "m.yaml", "generation:\n- {name: big, model_id: org/big, served_name: big-1, base_url: 'http://h/v1'}\n- {name: here, model_id: x, serve: transformers}\n")
    profiles = tables.load_profiles(f"{tmp_path}/m.yaml")["generation"]
    server = J.backend("big", profiles)
    assert (server.name, server.url) == ("big-1", "http://h/v1") and J.backend("mock") == J.Mock()
    body = server.body("p", J.VERDICT, 400)
    assert body["max_tokens"] == 400 and body["guided_json"]["required"] == ["verdict", "confidence"] and body["response_format"]["json_schema"]["schema"] == J.VERDICT
    for name in ("here", "none"):
        with pytest.raises(ValueError):
            J.backend(name, profiles)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd')], "k long, t string")
    report.write_csv(df, f"{tmp_path}/x.csv")
    assert tables.read_csv(spark, f"{tmp_path}/x.csv", ["k", "t"]).first().t == 'a "b", c\nd'
    report.write_csv(df.limit(0), f"{tmp_path}/empty.csv")
    assert (tmp_path / "empty.csv/part-00000.csv").read_text() == ""
    assert spark.range(1).select(report.xml_text(F.lit("a<b>&c"))).first()[0] == "a&lt;b&gt;&amp;c"
    files = spark.createDataFrame([("a.txt",)], "file string")
    reg = spark.createDataFrame([("a", "a.txt"), ("b", "b.txt")], "witness string, file string")
    assert {r.witness: r.present for r in TR.available(reg, files).collect()} == {"a": True, "b": False}
