"""Whole runs over small files, and the commands on what they wrote."""

import json

import pytest
from pyspark.sql import functions as F

from collatio import cli
from collatio.plans import run as R

CONCORDANCE = """chapters:
- {ref: I.1, bo: {chapter: 1}, zh: {pin: 1}}
- {ref: I.2, bo: {chapter: 2}, zh: {pin: 2}}
- {ref: I.11, bo: {}, zh: {pin: 11}}
- {ref: II.1, bo: {chapter: 1}, zh: {pin: 11}}
"""
TERMS = """terms:
- {sa: vajra x, bo: [རྡོ་རྗེ], zh: [金剛], type: name}
- {sa: nāḍī, bo: [རྩ], zh: [血脈], type: term}
- {sa: mantra, bo: [སྔགས], zh: [真言], type: term, zh_transliteration: true}
zh_transliteration_chars: "拏吉尼"
"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0" xmlns:cb="http://x" xml:lang="zh"><text><body><lb n="01"/><cb:jhead>經<note>題注</note></cb:jhead>
<cb:mulu type="品" n="1">序</cb:mulu><p>金剛說法，三十二血脈。</p><lb n="02"/><cb:mulu type="品" n="2">二</cb:mulu><p>真言品。</p></body>
<back><cb:tt from="#a"><cb:t xml:lang="zh-Hant">金剛</cb:t><cb:t xml:lang="sa">vajra.</cb:t></cb:tt><app from="#b"><lem>說</lem><rdg wit="#w">説</rdg></app></back></text></TEI>"""
FOLIO = "[1a.1]{D417}རྡོ་རྗེ་གསུངས། རྩ་ནི་སུམ་ཅུ་རྩ་གཉིས། ལེའུ་སྟེ་དང་པོའོ།། སྔགས་ཀྱི། ལེའུ་སྟེ་གཉིས་པའོ།། {D418}རབ་གནས། ལེའུ་སྟེ་དང་པོའོ།། {D419}ཨ།\n"
EDITION = "# a comment\nI.1.p01\tvajra\nI.1.1\tdvātriṃśan nāḍī\nI.2.1\tmantra\nII.1.1\tpratiṣṭhā\n"
OTHER = "I.1.p01\tvajra\nI.1.1\t\tABSENT\nI.2.1\t\tLACUNA\n"


@pytest.fixture(scope="module")
def staged(tmp_path_factory):
    root = tmp_path_factory.mktemp("staged")
    files = {"raw/w.xml": TEI, "raw/v.txt": FOLIO, "data/concordance/chapters.yaml": CONCORDANCE, "data/anchors/terms.yaml": TERMS, "bare/concordance/chapters.yaml": CONCORDANCE, "bare/anchors/terms.yaml": TERMS}
    files |= {f"data/reference/{R.PREFERRED}.tsv": EDITION, "data/reference/sa_other.tsv": OTHER}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return root


def command(spark, *argv, **more):
    args = cli.parser().parse_args([str(a) for a in argv])
    cli.COMMANDS[args.command][0](args, spark, **more)


@pytest.fixture(scope="module")
def gold(spark, staged):
    command(spark, "run", "--raw", staged / "raw", "--data", staged / "data", "--out", staged / "gold")
    return staged / "gold"


def cells_of(spark, out):
    return {(r.unit, r.witness): r for r in spark.read.parquet(f"{out}/cells.parquet").collect()}


def test_provisional(spark, staged):
    out = staged / "provisional"
    command(spark, "run", "--raw", staged / "raw", "--data", staged / "bare", "--out", out)
    about = json.loads((out / "manifest.json").read_text(encoding="utf-8"))
    assert (about["reference"], about["reference_grade"], about["witnesses"]) == (R.FOLIO_WITNESS, "provisional", [R.TEI_WITNESS])
    assert about["titles"][0]["title_note"] == "題注" and {c["text_id"] for c in about["colophons"]} == {"D417", "D418"} and set(about["inputs"]) == {"w.xml", "v.txt"}
    units = {r.unit: r for r in spark.read.parquet(f"{out}/units.parquet").collect()}
    # the parts' chapters of one number stay apart
    assert {"I.1.t0001", "I.1.t0002", "I.2.t0001", "II.1.t0001"} == set(units) and "རབ་གནས" in units["II.1.t0001"].text
    got = cells_of(spark, out)
    assert got["I.1.t0002", R.TEI_WITNESS].status == "PRESENT" and got["II.1.t0001", R.TEI_WITNESS].status == "UNALIGNED"
    assert "Provisional" in (out / "summary.md").read_text(encoding="utf-8")


def test_gold(spark, gold):
    got = cells_of(spark, gold)
    assert (got["I.1.1", "sa_other"].status, got["I.2.1", "sa_other"].status, got["II.1.1", "sa_other"].status) == ("ABSENT", "LACUNA", "NA")
    # II.1 is mapped to a chapter that the witness does not have: not aligned, which is not absent
    assert got["II.1.1", R.TEI_WITNESS].status == "UNALIGNED" and got["II.1.1", R.FOLIO_WITNESS].status == "PRESENT"
    assert got["I.1.1", R.TEI_WITNESS].similarity > 0
    about = json.loads((gold / "manifest.json").read_text(encoding="utf-8"))
    assert {d["witness"] for d in about["decompositions"]} == {"sa_other", R.TEI_WITNESS, R.FOLIO_WITNESS} and about["newick"].endswith(";") and about["similarity_backend"] == {"kind": "anchors", "embedding_model": None}
    lengths = {(r.chapter, r.witness): r for r in spark.read.parquet(f"{gold}/structure_lengths.parquet").collect()}
    assert lengths["II.1", R.TEI_WITNESS].merged_group == "I.11+II.1" and lengths["I.1", R.TEI_WITNESS].witness_local == "pin1"
    review = spark.read.parquet(f"{gold}/alignment_review.parquet").collect()
    assert review and {"ref_units", "wit_text", "review_status", "cost"} <= set(review[0].asDict())
    assert spark.read.json(f"{gold}/glosses.json").first().sa == "vajra" and spark.read.json(f"{gold}/apparatus.json").first().rdg == ["説"]
    for name in ("heatmap_coverage.svg", "heatmap_d_len.svg", "status_strip.svg", "summary.md"):
        assert (gold / name).stat().st_size > 0


def test_hybrid_similarity_with_an_encoder(spark, staged):
    def toy(texts):
        return [[float(any(k in t for k in ("金剛", "vajra", "རྡོ་རྗེ"))), 1.0] for t in texts]

    out = staged / "hybrid"
    command(spark, "run", "--raw", staged / "raw", "--data", staged / "data", "--out", out, "--similarity", "hybrid", "--embedding-model", "toy", encode=toy)
    assert json.loads((out / "manifest.json").read_text())["similarity_backend"] == {"kind": "hybrid", "embedding_model": "toy"}
    assert cells_of(spark, out)["II.1.1", R.FOLIO_WITNESS].similarity >= 0.5


def test_model_commands(spark, staged, gold):
    d = staged / "derived"
    command(spark, "llm-judge", "--review", gold / "alignment_review.csv", "--out", d / "review.csv", "--shapes", "1:1,2:1,1:2,1:0,0:1")
    rows = spark.read.csv(f"{d}/review.csv", header=True).collect()
    assert rows and {r.review_status for r in rows} == {"llm:unsure"} and spark.read.json(f"{d}/review.csv.calls.json").count() == len(rows)
    command(spark, "llm-extract", "--cells", gold / "cells.csv", "--data", staged / "data", "--witness", R.TEI_WITNESS, "--limit", 1, "--out", d / "components.jsonl")
    assert [r.lang for r in spark.read.json(f"{d}/components.jsonl").collect()] == ["zh"]
    command(spark, "llm-attribute", "--cells", gold / "cells.csv", "--witness", "sa_other", "--out", d / "attr.csv")
    got = spark.read.csv(f"{d}/attr.csv", header=True).collect()
    assert [(r.unit, r.top, r.p_abstain) for r in got] == [("I.1.1", "abstain", "1.0")]
    command(spark, "llm-probe", "--passages", gold / "cells.csv", "--min-chars", 5, "--prefix-chars", 2, "--out", d / "probe.json")
    about = json.loads((d / "probe.json").read_text())
    assert about["model_id"] == "mock" and about["memorised_rate"] == 0.0 and about["n"] == spark.read.json(f"{d}/probe.json.items.json").count() > 0
    (d / "items.csv").write_text("unit,sa_witness,sa_text,zh_span,zh_text,cowitness_fact\nI.1.1,sa,x,01,y,another one lacks it\n", encoding="utf-8")
    command(spark, "llm-counterfactual", "--llm", "mock,mock", "--items", d / "items.csv", "--out", d / "cf.csv")
    assert [(r.model_id, r.drop) for r in spark.read.csv(f"{d}/cf.csv", header=True).collect()] == [("mock", "0.0")]


def test_transfer_command(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "witnesses.yaml").write_text("witnesses:\n- {id: ref, reference: true}\n- {id: oth, scope: anthology, cowitness: lost, file: other.txt}\n- {id: lost}\n", encoding="utf-8")
    (tmp_path / "variants.yaml").write_text("groups:\n- {canonical: 常, variants: [恆]}\n", encoding="utf-8")
    (tmp_path / "texts/ref.txt").write_text("#1\n道可道，非常道。\n#2\n天下皆知。\n", encoding="utf-8")
    (tmp_path / "texts/other.txt").write_text("#1\n道可道，非恆道。\n", encoding="utf-8")
    command(spark, "transfer", "--config", tmp_path, "--texts", tmp_path / "texts", "--out", tmp_path / "out")
    about = json.loads((tmp_path / "out/manifest.json").read_text())
    assert about["missing"] == ["lost"] and about["witnesses"] == ["oth"] and set(about["inputs"]) == {"ref.txt", "other.txt"}
    got = cells_of(spark, tmp_path / "out")
    assert got["L.1.p02", "oth"].similarity == 1.0 and got["L.2.p01", "oth"].status == "NA"
    review = {r.ref_units: r for r in spark.read.parquet(f"{tmp_path}/out/alignment_review.parquet").collect()}
    assert review["L.1.p02"].variants_explained == "恆=常" or review["L.1.p02"].variants_explained == "常=恆"
    assert review["L.1.p02"].d_lex_raw > review["L.1.p02"].d_lex == 0.0
    (tmp_path / "texts/ref.txt").unlink()
    with pytest.raises(SystemExit):
        command(spark, "transfer", "--config", tmp_path, "--texts", tmp_path / "texts", "--out", tmp_path / "out")


def test_groups_of_merged_chapters(spark):
    bridge = spark.createDataFrame([("I.11", 0, "w", "pin11"), ("II.1", 1, "w", "pin11"), ("II.2", 2, "w", None)], "chapter string, ord int, witness string, local string")
    assert [(r.grp, r.chapters) for r in R.groups(bridge).select("grp", F.col("chapters")).collect()] == [("w|I.11+II.1", ["I.11", "II.1"])]
