"""Sinks: Parquet tables with CSV mirrors, JSON lines, a manifest, SVG figures and a Markdown summary."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.operators import metrics as X
from collatio.operators.matrix import DIMS, is_orphan, long_rows, wide
from collatio.plans.transfer import Matrix

SHADES = {"PRESENT": "#2f7d4f", "PARTIAL": "#e0b040", "ABSENT": "#b03030", "LACUNA": "#808080", "NA": "#d8d8d8", "UNALIGNED": "#ffffff"}
#: Columns of the chapter orders as they are written.
ORDER_NAMES = {"n_items": "n_chapters", "tau": "kendall_tau_distance", "late_first_share": "de_before_dao_share"}


def xml_text(c: Column) -> Column:
    """A column's text as the content of an XML element."""
    out = c
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One file through Spark's file systems, its folders made where they are missing."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers; an empty table is an empty file."""
    if df.isEmpty():
        write_text(df.sparkSession, "", f"{path.rstrip('/')}/part-00000.csv")
    else:
        df.write.mode("overwrite").csv(path, header=True, emptyValue="", quote='"', escape='"')


def write_jsonl(df: DataFrame, path: str) -> None:
    """A folder of JSON lines; null fields are left out."""
    df.write.mode("overwrite").json(path)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))))


def export(m: Matrix, out: str, witnesses: list[str], manifest: dict) -> None:
    """The matrix under ``out``: Parquet as the primary tables, CSV mirrors, figures, ``summary.md``, ``manifest.json``."""
    spark = m.cells.sparkSession
    m.witnesses = tuple(witnesses)

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}.parquet")
        back = spark.read.parquet(f"{out}/{name}.parquet")
        write_csv(_flat(back), f"{out}/{name}.csv")
        return back

    # what follows reads the written cells and units, so the alignment runs once
    m.cells = written("cells", long_rows(m.cells))
    m.units = written("units", m.units)
    written("alignment_review", m.review.orderBy("row_no"))
    written("reorder_repairs", m.repairs)
    written("chapter_order", m.orders.withColumnsRenamed(ORDER_NAMES))
    structure = written("structure", m.structure().orderBy("ord", "witness").drop("ord"))
    for dim in ("status", *DIMS):
        written(f"wide_{dim}", wide(m.cells, dim, witnesses))
    for name, df in m.tables.items():
        if name in ("glosses", "apparatus"):
            write_jsonl(df, f"{out}/{name}.json")
        else:
            m.tables[name] = written(name, df)
    log = written("alignment_log", m.log) if m.log is not None else None
    # chapters x witnesses, and a row a witness: what figures and the summary show
    rows = [r.asDict() for r in structure.collect()]
    for metric in ("coverage", "mean_d_len", "mean_d_lex"):
        if metric in structure.columns:
            write_text(spark, heatmap_svg(rows, metric), f"{out}/heatmap_{metric.removeprefix('mean_')}.svg")
    write_text(spark, strip_svg(m.cells, m.units, witnesses), f"{out}/status_strip.svg")
    small = {"decompositions": m.decompositions(), "deviation_rate_ci": m.intervals(), "distances": m.distances()}
    got = {name: [r.asDict() for r in df.collect()] for name, df in small.items()}
    tree = X.tree(witnesses, {(r["a"], r["b"]): r["distance"] for r in got["distances"] if r["a"] < r["b"]}) if len(witnesses) > 1 else None
    dims = {d: [r.asDict() for r in X.dimension(m.cells, d).orderBy("witness").collect()] for d in DIMS if d in m.cells.columns}
    write_text(spark, summary(m, rows, dims, got, tree), f"{out}/summary.md")
    about = {
        "reference": m.reference, "reference_grade": m.grade, "witnesses": witnesses, "chapters": list(m.chapters), "n_units": m.units.count(), "n_cells": m.cells.count(), "newick": tree,
        "alignment_log": [r.asDict() for r in log.orderBy("grp", "shape").collect()] if log is not None else [], **{k: v for k, v in got.items() if k != "distances"},
    }
    for name in ("titles", "colophons"):
        if name in m.tables:
            about[name] = [r.asDict() for r in m.tables[name].collect()]
    write_text(spark, json.dumps(about | manifest, ensure_ascii=False, indent=2, sort_keys=True), f"{out}/manifest.json")


def heatmap_svg(rows: list[dict], metric: str, cell: int = 14) -> str:
    """Chapters × witnesses: coverage from red to green, signed metrics red or blue by size, blank without value."""
    chapters, witnesses = (list(dict.fromkeys(r[k] for r in rows)) for k in ("chapter", "witness"))
    value = {(r["chapter"], r["witness"]): r[metric] for r in rows}
    out = []
    for i, c in enumerate(chapters):
        out.append(f'<text x="0" y="{(i + 2) * cell}" font-size="10">{escape(str(c))}</text>')
        for j, w in enumerate(witnesses):
            v = value.get((c, w))
            if v is None:
                continue
            if metric == "coverage":
                shade = f"rgb({round(200 * (1 - v))},{round(160 * v)},60)"
            else:
                size = round(255 * (1 - min(1.0, abs(v))))
                shade = f"rgb(255,{size},{size})" if v < 0 else f"rgb({size},{size},255)"
            out.append(
                f'<rect x="{80 + j * cell}" y="{(i + 1) * cell}" width="{cell}" height="{cell}" fill="{shade}"><title>{escape(f"{c} {w}: {v}")}</title></rect>'
            )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{80 + cell * len(witnesses)}" height="{(len(chapters) + 3) * cell}">{"".join(out)}</svg>'


def strip_svg(cells: DataFrame, units: DataFrame, witnesses: Sequence[str], most: int = 4000) -> str:
    """Status strip: a column per unit of the reference, a row per witness, a tick where a chapter begins.

    The first ``most`` units, which is what a figure can show.
    """
    own = units.where(~is_orphan(F.col("unit"))).withColumn("_c", F.split("chapter", r"\."))
    part, number = F.element_at("_c", 1), F.try_element_at("_c", F.lit(2)).try_cast("int")
    order = own.select(
        "unit", "chapter", F.length(part).alias("_p"), part.alias("_n"), number.alias("_i"),
        F.col("seq") if "seq" in units.columns else F.col("unit").alias("seq"),
    ).orderBy("_p", "_n", "_i", "seq", "unit").limit(most)
    shown = [(r.unit, r.chapter) for r in order.collect()]
    place = {u: i for i, (u, _) in enumerate(shown)}
    rows = cells.where(F.col("witness").isin(*witnesses)).join(order.select("unit"), "unit", "left_semi").select("unit", "witness", "status").collect()
    row = {w: i for i, w in enumerate(witnesses)}
    marks = "".join(
        f'<rect x="{100 + place[r.unit]}" y="{20 * row[r.witness]}" width="1" height="18" fill="{SHADES.get(r.status, "#000")}"/>' for r in rows if r.unit in place
    )
    names = "".join(f'<text x="0" y="{20 * i + 14}" font-size="10">{escape(w)}</text>' for w, i in row.items())
    depth = 20 * len(row)
    begins = [(i, c) for i, (_, c) in enumerate(shown) if i == 0 or shown[i - 1][1] != c]
    ticks = "".join(
        f'<line x1="{100 + i}" y1="0" x2="{100 + i}" y2="{depth}" stroke="#000" stroke-width="0.5"/><text x="{101 + i}" y="{depth + 12}" font-size="8">{escape(c)}</text>' for i,
        c in begins
    )
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{100 + len(shown)}" height="{depth + 20}">{names}{marks}{ticks}</svg>'


def _table(rows: list[dict], columns: Sequence[str]) -> list[str]:
    def shown(v: object) -> str:
        return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)

    return [
        "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns),
        *("| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows),
    ]


def summary(m: Matrix, structure: list[dict], dims: dict[str, list[dict]], got: dict[str, list[dict]], tree: str | None) -> str:
    """A report of the run: its structure, deviations, decompositions, intervals and distances."""
    out = ["# Witness matrix", "", f"- reference: `{m.reference}` ({m.grade})", f"- witnesses: {', '.join(m.witnesses)}"]
    if m.grade == "provisional":
        out.append(
            "- **Provisional**: no edition in the source language was given. The folio translation stands in, so figures compare translations and say nothing of the source."
        )
    if m.grade == "coordinate_only":
        out.append("- The reference lends its coordinates only: figures tell how far witnesses lie apart, not how far they lie from a source.")
    some = [r for r in structure if r["n_units"] or r["n_orphan"]]
    means = [c for c in (f"mean_{d}" for d in DIMS) if some and c in some[0]]
    out += [
        "", "## Chapters", "",
        *_table(some, ["chapter", "witness", "n_units", "n_counted", "n_present", "n_absent", "n_orphan", "coverage", *means]),
    ]
    spread = [r | {"dimension": d} for d, rows in dims.items() for r in rows]
    out += ["", "## Deviations", "", *_table(spread, ["witness", "dimension", "n", "mean", "median", "p90"])]
    if got["decompositions"]:
        out += [
            "", "## Decomposition", "",
            *_table(got["decompositions"], ["witness", "cowitness", "n_counted", "n_deviating", *X.CLASSES, *(f"rate_{c}" for c in X.CLASSES)]),
        ]
    out += ["", "## Deviation rates, chapters resampled", "", *_table(got["deviation_rate_ci"], ["witness", "estimate", "lo", "hi", "n_blocks"])]
    if len(m.witnesses) > 1:
        near = {(r["a"], r["b"]): r["distance"] for r in got["distances"]}
        out += [
            "", "## Distances", "",
            *_table([{"": a, **{b: near.get((a, b)) for b in m.witnesses}} for a in m.witnesses], ["", *m.witnesses]), "",
            f"Average linkage: `{tree}`",
        ]
    return "\n".join(out) + "\n"
