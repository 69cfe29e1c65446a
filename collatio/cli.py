"""Command line: ``run``, ``transfer``, the model-backed ``llm-…`` commands and ``query``.

Every command reads and writes through Spark's file systems. Model-backed commands write the
answered rows once and derive their results from what was written, so that no model is asked twice.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio import report
from collatio.functions import text as T
from collatio.operators import align as L
from collatio.operators import attribution as A
from collatio.operators import judging as J
from collatio.plans import run as R
from collatio.plans import transfer as TR
from collatio.session import build_session, kept
from collatio.sources import marked, tables, tei


def _exists(spark: SparkSession, path: str) -> bool:
    """Does a path or glob name any file?"""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return files is not None and len(files) > 0


def _fingerprints(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    rows = [r for p in paths for r in tables.fingerprints(spark, p).collect()]
    return {r.path.rpartition("/")[2]: r.sha256 for r in sorted(rows, key=lambda r: r.path)}


# ---- matrices


def transfer(args: argparse.Namespace, spark: SparkSession) -> None:
    """Same-language witnesses; a witness whose file is missing is named in the manifest and has no column."""
    registry = tables.load_registry(spark, f"{args.config}/witnesses.yaml").select(
        F.col("id").alias("witness"), "scope", "reference", "cowitness", "file",
    )
    named = [r.asDict() for r in registry.collect()]  # the registry's rows, one a witness
    have = {w["witness"]: w for w in named if _exists(spark, f"{args.texts}/{w['file']}")}
    reference = next((w["witness"] for w in named if w["reference"]), None)
    if reference not in have:
        raise SystemExit("mark one witness as reference and provide its text")
    variants = tables.load_variants(f"{args.config}/variants.yaml") if _exists(spark, f"{args.config}/variants.yaml") else T.Variants([])
    stem = {w["file"].rpartition(".")[0]: n for n, w in have.items()}
    lines = marked.read_marked(spark, f"{args.texts}/{{{','.join(w['file'] for w in have.values())}}}").replace(stem, subset=["witness"])
    lines = lines.withColumn("seg_id", F.concat(F.col("witness"), F.expr("substr(seg_id, instr(seg_id, ':'))")))
    m = TR.transfer(lines, registry.where(F.col("witness").isin(*have)), variants)
    others = [n for n in have if n != reference]
    m.reference, m.cowitness = reference, {n: have[n]["cowitness"] for n in others}
    missing = [w["witness"] for w in named if w["witness"] not in have]
    about = {
        "command": "transfer", "params": TR.PARAMS.__dict__, "missing": missing, "variants_used": len(variants.mapping),
        "inputs": _fingerprints(spark, [f"{args.texts}/{w['file']}" for w in have.values()]),
    }
    report.export(m, args.out, others, about)


def run(args: argparse.Namespace, spark: SparkSession, encode: R.Encoder | None = None) -> None:
    """A TEI and a folio witness against editions in the source language, or, without any, against the folio text."""
    editions = f"{args.data}/reference/sa_*.tsv"
    tei_path, folio_path = f"{args.raw}/{args.tei}", f"{args.raw}/{args.folio}"
    given = tables.read_reference(spark, editions) if _exists(spark, editions) else None
    params = L.Params(prior_null=args.prior_null, anchor_weight=args.anchor_weight)
    m = R.run(spark, args.data, tei_path, folio_path, params, R.Similarity(args.similarity, args.embedding_model, encode=encode), given)
    inputs = [tei_path, folio_path, *([editions] if given is not None else [])]
    similarity = {"kind": args.similarity, "embedding_model": args.embedding_model if args.similarity != "anchors" else None}
    report.export(
        m, args.out, list(m.witnesses),
        {"command": "run", "params": params.__dict__, "similarity_backend": similarity, "inputs": _fingerprints(spark, inputs)},
    )


# ---- model-backed roles


def _model(args: argparse.Namespace, name: str | None = None):
    profiles = tables.load_profiles(args.models)["generation"] if args.models else None
    return J.backend(name or args.llm, profiles)


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV's rows, numbered in order; nulls are empty."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').na.fill("")
    return rows.withColumn("row_no", F.col("row_no").cast("long")) if "row_no" in rows.columns else rows.withColumn("row_no", F.monotonically_increasing_id())


def _limited(rows: DataFrame, limit: int, order: str | Sequence[str] = "row_no") -> DataFrame:
    return rows.orderBy(order).limit(limit) if limit else rows


def _answered(df: DataFrame, out: str) -> DataFrame:
    """The answered rows, written; the calls' records go beside the result."""
    done = kept(df)
    report.write_jsonl(J.call_log(done), f"{out}.calls.json")
    return done


def llm_judge(args: argparse.Namespace, spark: SparkSession) -> None:
    model = _model(args)
    rows = _limited(_rows(spark, args.review), args.limit)
    judged = J.judge_table(rows, model, tuple(args.shapes.split(",")), args.min_confidence, args.ref_lang, args.wit_lang)
    out = args.out or f"{args.review.rstrip('/').removesuffix('.csv')}_llm.csv"
    done = _answered(judged, out)
    report.write_csv(done.select(*rows.columns).orderBy("row_no"), out)
    print(f"{done.where('response is not null').count()} beads judged by {model.name}: {out}")


def llm_extract(args: argparse.Namespace, spark: SparkSession) -> None:
    lexicon = tables.load_lexicon(f"{args.data}/anchors/terms.yaml")
    rows = _rows(spark, args.cells).where(F.col("status").isin("PRESENT", "PARTIAL") & (F.col("text") != ""))
    rows = rows.where(F.col("witness") == args.witness) if args.witness else rows
    asked = _limited(rows, args.limit, ["witness", "unit"]).select(
        "unit", "witness", "text", F.lit(args.lang).alias("lang"), lexicon.anchors(F.col("text"), args.lang).alias("anchors"),
    )
    done = _answered(J.extract_components(asked, _model(args)), args.out)
    report.write_jsonl(done.select("unit", "witness", "text", "lang", "model_id", "slots", "lexicon_keys", "rejected"), args.out)
    print(f"{done.count()} segments: {args.out}")


def llm_attribute(args: argparse.Namespace, spark: SparkSession) -> None:
    cells = _rows(spark, args.cells)
    targets = _limited(cells.where((F.col("witness") == args.witness) & F.col("status").isin("ABSENT", "PARTIAL")), args.limit, ["unit"])
    own = targets.select(
        "unit", "witness",
        F.concat(
            F.col("witness"), F.lit(": "), F.col("status"), F.lit(", bead "), F.col("bead"), F.lit(", evidence "), F.col("evidence"),
        ).alias("own"),
    )
    met = own.join(A.facts(cells, targets), ["unit", "witness"], "left")
    rows = met.select("unit", "witness", F.concat_ws("; ", "own", "facts").alias("facts"))
    done = _answered(J.judge_attribution(rows, _model(args)), args.out)
    shares = [F.round(F.col("distribution")[x], 3).alias(f"p_{x}") for x in A.LABELS]
    cited = F.array_join(F.transform("cited", lambda i: i.cast("string")), " ").alias("cited_facts")
    report.write_csv(done.select("unit", "witness", "top", F.col("motive").alias("motive_flag"), cited, "model_id", *shares, "note"), args.out)
    print(f"{done.count()} cells judged; {done.where('motive').count()} name a motive and abstain: {args.out}")


def llm_probe(args: argparse.Namespace, spark: SparkSession) -> None:
    model = _model(args)
    if args.passages.rstrip("/").endswith(".csv"):
        found = _rows(spark, args.passages)
        passages = found.select(F.col("witness").alias("source"), F.col("unit").alias("ref"), "text").where("text <> ''")
    else:
        passages = tables.read_passages(spark, args.passages)
    asked = _limited(passages.where(F.length(F.trim("text")) >= args.min_chars), args.limit, ["source", "ref"])
    done = _answered(J.probe(asked, model, prefix=args.prefix_chars, least=args.min_chars), args.out)
    items = done.select("source", "ref", F.round("overlap", 3).alias("overlap"), (F.col("overlap") >= args.threshold).alias("memorised"))
    report.write_jsonl(items, f"{args.out}.items.json")
    rates = [r.asDict() for r in A.contamination(done, args.threshold).collect()]  # one row a source
    whole = next((r for r in rates if r["overall"]), {"n": 0, "mean_overlap": None, "memorised_rate": None})
    about = {
        "model_id": model.name, "threshold": args.threshold, "n": whole["n"], "mean_overlap": whole["mean_overlap"] or 0.0, "memorised_rate": whole["memorised_rate"] or 0.0,
        "by_source": {r["source"]: {k: r[k] for k in ("n", "mean_overlap", "memorised_rate")} for r in rates if not r["overall"]},
    }
    report.write_text(spark, json.dumps(about, ensure_ascii=False, indent=1), args.out)
    print(f"{about['n']} probes, memorised {about['memorised_rate']:.3f}, mean overlap {about['mean_overlap']:.3f}: {args.out}")


def llm_counterfactual(args: argparse.Namespace, spark: SparkSession) -> None:
    rows = _limited(_rows(spark, args.items), args.limit)
    context = F.concat_ws(" ", *(c for c in ("zh_span", "zh_text") if c in rows.columns))
    items = rows.select("unit", F.col("sa_text").alias("source_text"), F.col("cowitness_fact").alias("fact"), context.alias("context"))
    answers = kept(J.counterfactual(items, [_model(args, n) for n in args.llm.split(",")]))
    names = {"model": "model_id", "rate_a": "motive_rate_without_fact", "rate_b": "motive_rate_with_fact", "diff": "drop"}
    report.write_csv(A.counterfactual_rates(answers).withColumnsRenamed(names), args.out)
    print(f"{answers.count()} answers: {args.out}")


def query(args: argparse.Namespace, spark: SparkSession) -> None:
    from collatio.plans.registry import QUERIES

    QUERIES[args.name](spark, args.data).write.mode("overwrite").parquet(args.out)


def fingerprint(args: argparse.Namespace, spark: SparkSession) -> None:
    report.write_csv(tables.fingerprints(spark, args.paths), args.out)


def titles(args: argparse.Namespace, spark: SparkSession) -> None:
    report.write_csv(tei.read_chapters(spark, args.paths), args.out)


REQUIRED = object()
Options = dict[str, object]
MODEL: Options = {"llm": "mock", "models": None, "limit": 0}
COMMANDS: dict[str, tuple[Callable, Options]] = {
    "run": (
        run,
        {
            "raw": "data/raw", "out": "out", "data": "data", "tei": "*.xml", "folio": "*.txt", "prior-null": L.Params.prior_null,
            "anchor-weight": L.Params.anchor_weight, "similarity": "anchors", "embedding-model": R.Similarity.model,
        },
    ),
    "transfer": (transfer, {"config": REQUIRED, "texts": REQUIRED, "out": "out"}),
    "llm-judge": (
        llm_judge,
        MODEL | {
            "review": "out/alignment_review.csv", "out": None, "ref-lang": "bo", "wit-lang": "zh", "shapes": ",".join(J.DOUBTFUL),
            "min-confidence": 0.6,
        },
    ),
    "llm-extract": (
        llm_extract,
        MODEL | {"cells": "out/cells.csv", "data": "data", "witness": None, "lang": "zh", "out": "out/derived/components.jsonl"},
    ),
    "llm-attribute": (llm_attribute, MODEL | {"cells": "out/cells.csv", "witness": R.TEI_WITNESS, "out": "out/derived/attribution_llm.csv"}),
    "llm-probe": (
        llm_probe,
        MODEL | {"passages": "out/cells.csv", "prefix-chars": 40, "min-chars": 80, "threshold": 0.5, "out": "out/derived/contamination_probe.json"},
    ),
    "llm-counterfactual": (llm_counterfactual, MODEL | {"items": REQUIRED, "out": "out/derived/counterfactual.csv"}),
    "query": (query, {"name": REQUIRED, "data": REQUIRED, "out": REQUIRED}),
    "fingerprint": (fingerprint, {"paths": REQUIRED, "out": REQUIRED}),
    "chapters": (titles, {"paths": REQUIRED, "out": REQUIRED}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="collatio")
    out.add_argument("--master")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = commands.add_parser(name)
        for option, default in options.items():
            kind = type(default) if isinstance(default, (int, float)) else str
            p.add_argument(
                f"--{option}", required=default is REQUIRED, default=None if default is REQUIRED else default, type=kind,
                choices=("anchors", "embedding", "hybrid") if option == "similarity" else None,
            )
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    COMMANDS[args.command][0](args, build_session(f"collatio {args.command}", args.master))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
