"""Tabular and configuration sources: reference TSV, CSV, passages, YAML registries, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions import ids
from collatio.functions import text as T
from collatio.functions.lexicon import Lexicon, Term
from collatio.sources.marked import text_lines


def parse_reference(lines: DataFrame, strict: bool = True) -> DataFrame:
    """``unit_id TAB text [TAB flag]`` per line, ``#`` comments.

    ``(witness, seq, unit, chapter, kind, local_chapter, text, flag)``. Rows with under two columns or
    an invalid id are errors (or dropped, if not ``strict``). Errors are raised by the values of the
    unit and the text, for lines that count alone, so no filter can be moved past them.
    """
    line = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    counts = (line != "") & ~line.startswith("#")
    cells = F.when(counts, F.split(line, "\t"))
    unit = F.regexp_replace(F.try_element_at(cells, F.lit(1)), r"(?U)^\s+|\s+$", "")
    if strict:
        short = F.raise_error(F.concat(F.lit("too few columns: "), line)).cast("string")
        unit = F.when(counts & (F.size(cells) < 2), short).when(counts, unit)
    else:
        unit = F.when(counts & (F.size(cells) >= 2), unit)
    rows = lines.select(F.col("file").alias("witness"), F.col("line_no").alias("seq"), unit.alias("unit"), cells.alias("cells"))
    parsed = F.when(F.col("unit").isNotNull(), ids.parse(F.col("unit"), strict=strict))
    flag = F.upper(F.nullif(F.trim(F.try_element_at("cells", F.lit(3))), F.lit("")))
    out = rows.withColumn("u", parsed).where("u is not null")
    kind = F.when(F.col("u.kind") == "verse", "verse").otherwise("prose")
    return out.select(
        "witness", "seq", "unit", ids.chapter_key(F.col("u")).alias("chapter"), kind.alias("kind"),
        F.col("u.chapter").alias("local_chapter"), T.sa_normalize(F.element_at("cells", 2)).alias("text"), flag.alias("flag"),
    )


def read_reference(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All editions that a path or glob names, one witness per file stem."""
    return parse_reference(text_lines(spark, path), strict)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), multiLine=True, escape='"')


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """``(source, ref, text)`` from CSV with a header, or from three-column TSV; empty texts are dropped."""
    schema = "source string, ref string, text string"
    got = spark.read.csv(
        path, header=True, schema=schema, multiLine=True, escape='"',
    ) if path.endswith(".csv") else spark.read.csv(path, sep="\t", schema=schema, quote="")
    return got.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", digest(F.col("content")).alias("sha256"))


def _yaml(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


# Layers that count in statistics, layers of source-language witnesses, and the texts of the two parts.
STATISTICAL = ("primary", "edition", "indirect")
SOURCE_LAYERS = ("edition", "primary")
PART_TEXTS = {"I": "D417", "II": "D418"}


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Witness registry: id, lang, layer, scope, role, reference, cowitness, file, and the rest as a map."""
    known = {
        "lang": "zh", "layer": "primary", "scope": "complete", "role": "", "reference": False, "cowitness": None, "source_lang": None,
        "independence": "unknown", "status": "to_verify", "title": "", "label": None, "note": "",
    }
    rows = []
    for w in _yaml(path).get("witnesses", []):
        rest = {k: str(v) for k, v in w.items() if k not in known and k not in ("id", "date", "file")}
        own = {k: w.get(k, d) for k, d in known.items()} | {"label": w.get("label", w["id"])}
        rows.append((w["id"], *own.values(), str(w.get("date", "")), w.get("file") or f"{w['id']}.txt", rest))
    fields = ", ".join(f"{n} {'boolean' if n == 'reference' else 'string'}" for n in known)
    return spark.createDataFrame(rows, f"id string, {fields}, date string, file string, raw map<string,string>")


def counts_in_statistics(layer: Column) -> Column:
    return layer.isin(*STATISTICAL)


def is_source(lang: Column, layer: Column) -> Column:
    """Witnesses in the source language itself."""
    return (lang == "sa") & layer.isin(*SOURCE_LAYERS)


def local_key(lang: str, chapter: str, local: int | None) -> str | None:
    """A witness's own chapter: ``pin11``, or ``D418:3`` where numbers begin anew with each part's text."""
    if local is None:
        return None
    return f"{PART_TEXTS[chapter.split('.')[0]]}:{local}" if lang == "bo" else f"pin{local}"


def local_key_in(lang: Column, text_id: Column, local: Column) -> Column:
    """``local_key`` of segments that know their text and chapter number."""
    return F.when(lang == "bo", F.concat_ws(":", text_id, local.cast("string"))).otherwise(F.concat(F.lit("pin"), local.cast("string")))


def load_concordance(spark: SparkSession, path: str, languages: tuple[str, ...] = ("bo", "zh")) -> DataFrame:
    """Bridge ``(chapter, ord, lang, local)`` from reference chapters to local ones; many may share one."""
    rows = []
    for i, c in enumerate(_yaml(path).get("chapters", [])):
        for lang in languages:
            number = (c.get(lang) or {}).get("chapter" if lang == "bo" else "pin")
            rows.append((c["ref"], i, lang, local_key(lang, c["ref"], number)))
    return spark.createDataFrame(rows, "chapter string, ord int, lang string, local string")


def chapter_lookup(bridge: DataFrame) -> DataFrame:
    """``(lang, local, chapter)``: of reference chapters that share a local one the last counts."""
    return bridge.where("local is not null").groupBy("lang", "local").agg(F.max_by("chapter", "ord").alias("chapter"))


def load_lexicon(path: str) -> Lexicon:
    """Terms by key, the first word of their Sanskrit; its normal form is the only Sanskrit form."""
    data = _yaml(path)
    terms = []
    for t in data.get("terms", []):
        key = str(t["sa"]).split(" ")[0]
        forms = {lang: tuple(t.get(lang) or ()) for lang in ("bo", "zh")}
        terms.append(Term(key, t.get("type", "term"), {"sa": (T.sa_normalized(key),), **forms}, bool(t.get("zh_transliteration"))))
    return Lexicon(tuple(terms), "".join(str(data.get("zh_transliteration_chars", "")).split()))


def load_profiles(path: str) -> dict[str, dict[str, dict]]:
    """Model profiles by section (generation, embeddings) and name."""
    data = _yaml(path)
    return {section: {p["name"]: p for p in data.get(section) or []} for section in ("generation", "embeddings")}


def load_variants(path: str) -> T.Variants:
    pairs = [(v, g["canonical"]) for g in _yaml(path).get("groups", []) if g.get("normalize", True) for v in g.get("variants", [])]
    return T.Variants(pairs)
