"""Unit identifiers: ``PART.chapter.index[ab]``, ``.pNN`` prose, ``.tNNNN`` provisional, ``+witness:coords`` orphans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = r"^([A-Z][A-Za-z0-9]*)\.(\d{1,3})\.(?:(\d{1,3})([ab])?|p(\d{1,3})|t(\d{1,4}))$"
ORPHAN = r"^\+([A-Za-z0-9_]+):(.+)$"


class Schemes:
    """Registered parts with their number of chapters; a part's rank is the order of registration."""

    def __init__(self) -> None:
        self.chapters: dict[str, int] = {}
        self.ranks: dict[str, int] = {}
        for part, n in (("I", 11), ("II", 12)):
            self.chapters[part], self.ranks[part] = n, len(self.ranks)

    def register(self, part: str, chapters: int) -> list[str]:
        self.chapters[part] = chapters
        self.ranks.setdefault(part, 10 + len(self.ranks))
        return [f"{part}.{i}" for i in range(1, chapters + 1)]


SCHEMES = Schemes()
SCHEMES.register("L", 81)


def parse(unit: Column, schemes: Schemes = SCHEMES, strict: bool = False) -> Column:
    """Struct of part, chapter, idx, kind, sub, witness, coords; null (or an error) where invalid."""

    def group(i: int) -> Column:
        return F.nullif(F.regexp_extract(unit, UNIT, i), F.lit(""))

    most = F.create_map(*(F.lit(x) for kv in schemes.chapters.items() for x in kv))
    chapter = group(2).cast("int")
    valid = unit.rlike(UNIT) & (chapter >= 1) & (chapter <= F.try_element_at(most, group(1)))
    kind = F.when(group(3).isNotNull(), "verse").when(group(5).isNotNull(), "prose").otherwise("provisional")
    nothing = F.lit(None).cast("string")
    own = F.struct(
        group(1).alias("part"), chapter.alias("chapter"), F.coalesce(group(3), group(5), group(6)).cast("int").alias("idx"), kind.alias("kind"), group(4).alias("sub"), nothing.alias("witness"), nothing.alias("coords")
    )
    orphan = F.struct(
        nothing.alias("part"), F.lit(None).cast("int").alias("chapter"), F.lit(None).cast("int").alias("idx"), F.lit("orphan").alias("kind"), nothing.alias("sub"),
        F.regexp_extract(unit, ORPHAN, 1).alias("witness"), F.regexp_extract(unit, ORPHAN, 2).alias("coords"),
    )
    out = F.when(unit.rlike(ORPHAN), orphan).when(valid, own)
    return out.otherwise(F.raise_error(F.concat(F.lit("invalid unit id: "), unit)).cast(_TYPE)) if strict else out


_TYPE = "struct<part:string,chapter:int,idx:int,kind:string,sub:string,witness:string,coords:string>"


def render(u: Column) -> Column:
    """The identifier of a parsed struct."""
    head = F.concat(u["part"], F.lit("."), u["chapter"].cast("string"), F.lit("."))
    return (
        F.when(u["kind"] == "orphan", F.concat(F.lit("+"), u["witness"], F.lit(":"), u["coords"]))
        .when(u["kind"] == "verse", F.concat(head, u["idx"].cast("string"), F.coalesce(u["sub"], F.lit(""))))
        .when(u["kind"] == "prose", F.concat(head, F.format_string("p%02d", u["idx"])))
        .when(u["kind"] == "provisional", F.concat(head, F.format_string("t%04d", u["idx"])))
    )


def chapter_key(u: Column) -> Column:
    return F.concat_ws(".", u["part"], u["chapter"].cast("string"))


def orphan_id(witness: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("+"), witness, F.lit(":"), F.when(start == end, start).otherwise(F.concat_ws("-", start, end)))


def sort_key(unit: Column, schemes: Schemes = SCHEMES) -> Column:
    """Struct that orders units: part, chapter, verse before prose before provisional, index, half; orphans rank 9."""
    u = parse(unit, schemes)
    ranks = F.create_map(*(F.lit(x) for kv in schemes.ranks.items() for x in kv))
    kind = F.when(u["kind"] == "verse", 0).when(u["kind"] == "prose", 1).otherwise(2)
    orphan = u["kind"] == "orphan"
    return F.struct(
        F.when(orphan, 9).otherwise(F.try_element_at(ranks, u["part"])).alias("rank"),
        F.when(orphan, 0).otherwise(u["chapter"]).alias("chapter"),
        F.when(orphan, 0).otherwise(kind).alias("kind"),
        F.when(orphan, 0).otherwise(u["idx"]).alias("idx"),
        F.when(orphan, F.concat(u["witness"], F.lit("\1"), u["coords"])).otherwise(F.coalesce(u["sub"], F.lit(""))).alias("rest"),
    )
