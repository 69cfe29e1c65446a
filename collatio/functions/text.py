"""Column functions for text: lengths, numerals, transliteration, normalisation, clauses.

All are built-in expressions (code-point semantics); only NFC, which Spark lacks, is a pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character sets, numerals and patterns that decide results.
ZH_PUNCT = "，。、；：？！「」『』（）〔〕【】《》〈〉—…‧·．,.;:?!()[]<>\"' 　\n\t"
ZH_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "兩": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ZH_UNITS = {"十": 10, "百": 100, "千": 1000, "萬": 10000, "万": 10000}
BO_SPLIT = "[་༌\\s།༎༏༐༑༔]+"
BO_TSHEG = "་"
BO_SANSKRIT = "ཱཾཻཽྃཊཋཌཌྷཎཥྚྛྜྜྷྞྵྷ྅ཿ"
BO_ONES = {"གཅིག": 1, "གཉིས": 2, "གསུམ": 3, "བཞི": 4, "ལྔ": 5, "དྲུག": 6, "བདུན": 7, "བརྒྱད": 8, "དགུ": 9}
BO_TEN = {"བཅུ": 10, "བཅོ": 10}
BO_TENS = {"ཉི་ཤུ": 20, "སུམ་ཅུ": 30, "བཞི་བཅུ": 40, "ལྔ་བཅུ": 50, "དྲུག་ཅུ": 60, "བདུན་ཅུ": 70, "བརྒྱད་ཅུ": 80, "དགུ་བཅུ": 90}
BO_HIGH = {"བརྒྱ": 100, "སྟོང": 1000, "ཁྲི": 10000, "འབུམ": 100000}
BO_CONNECTORS = ("རྩ", "རྩེ", "ར", "སོ", "ཞེ", "ང", "རེ", "དོན", "གྱ", "གོ")
SA_VOWELS = "ai|au|[aāiīuūṛṝḷḹeo]"
SA_NUMERALS = {
    "dvi": 2, "dvau": 2, "tri": 3, "traya": 3, "catur": 4, "catvāri": 4, "catuḥ": 4, "pañca": 5, "ṣaṣ": 6, "ṣaṭ": 6, "ṣaḍ": 6, "sapta": 7,
    "aṣṭa": 8, "aṣṭau": 8, "nava": 9, "daśa": 10, "ekādaśa": 11, "dvādaśa": 12, "ṣoḍaśa": 16, "viṃśati": 20, "caturviṃśati": 24,
    "catuḥviṃśati": 24, "dvātriṃśa": 32, "catuḥṣaṣṭi": 64, "śata": 100, "sahasra": 1000, "lakṣa": 100000,
}
CLAUSE_MARKS = "。？！，；：、"
STRIPPED = "[\\s。？！，；：、「」『』（）()《》〈〉\\[\\]【】…—－-]+"
LACUNA_MARKS = "□▢■囗〼"


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in (kv[0], F.lit(kv[1]).cast("long")))), key)


# ---- Chinese


def zh_strip(c: Column) -> Column:
    return F.translate(c, ZH_PUNCT, "")


def zh_length(c: Column) -> Column:
    return F.length(zh_strip(c)).cast("long")


def zh_number(c: Column) -> Column:
    """Value of a run of numerals: a later digit overwrites, a unit without a digit counts once
    below ten thousand and not at all from there."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("section"), F.lit(0).cast("long").alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        digit, unit = _lookup(ZH_DIGITS, ch), _lookup(ZH_UNITS, ch)
        small = acc["section"] + F.when(acc["digit"] == 0, 1).otherwise(acc["digit"]) * unit
        nothing = F.lit(0).cast("long")
        return (
            F.when(digit.isNotNull(), F.struct(acc["total"].alias("total"), acc["section"].alias("section"), digit.alias("digit")))
            .when(unit < 10000, F.struct(acc["total"].alias("total"), small.alias("section"), nothing.alias("digit")))
            .when(
                unit.isNotNull(),
                F.struct((acc["total"] + (acc["section"] + acc["digit"]) * unit).alias("total"), nothing.alias("section"), nothing.alias("digit")),
            )
            .otherwise(acc)
        )

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), zero, step, lambda a: a["total"] + a["section"] + a["digit"])


def zh_numbers(c: Column) -> Column:
    """Values of the maximal runs of numerals, those of 2 or more or of more than one character; sorted, distinct."""
    runs = F.regexp_extract_all(c, F.lit(f"([{''.join(ZH_DIGITS)}{''.join(ZH_UNITS)}]+)"))
    found = F.transform(runs, lambda r: F.struct(zh_number(r).alias("v"), F.length(r).alias("n")))
    return F.array_sort(F.array_distinct(F.transform(F.filter(found, lambda x: (x["v"] >= 2) | (x["n"] > 1)), lambda x: x["v"])))


# ---- Tibetan


def bo_syllables(c: Column) -> Column:
    return F.filter(F.split(c, f"(?U){BO_SPLIT}"), lambda s: s != "")


def bo_length(c: Column) -> Column:
    return F.size(bo_syllables(c)).cast("long")


def bo_sanskrit_share(c: Column) -> Column:
    """Share of syllables with a character that only transliteration uses; 0 without syllables."""
    s = bo_syllables(c)
    hits = F.size(F.filter(s, lambda x: x.rlike(f"[{BO_SANSKRIT}]")))
    return F.when(F.size(s) > 0, hits / F.size(s)).otherwise(F.lit(0.0))


def bo_numbers(c: Column) -> Column:
    """Numbers in a run of syllables, read left to right with compounds of tens; sorted, distinct."""
    empty = F.array().cast("array<bigint>")

    def read(syllables: Column) -> Column:
        def at(i: Column) -> Column:
            return F.try_element_at(syllables, (i + 1).cast("int"))

        def step(acc: Column, i: Column) -> Column:
            tens = _lookup(BO_TENS, F.concat(at(i), F.lit(BO_TSHEG), at(i + 1)))
            linked = F.when(at(i + 2).isin(*BO_CONNECTORS), _lookup(BO_ONES, at(i + 3)))
            ten, ones = _lookup(BO_TEN, at(i)), _lookup(BO_ONES, at(i + 1))
            single = F.coalesce(_lookup(BO_ONES, at(i)), _lookup(BO_HIGH, at(i)))

            def found(value: Column, jump: Column | int) -> Column:
                return F.struct((i + jump).cast("int").alias("next"), F.concat(acc["out"], F.array(value.cast("long"))).alias("out"))

            return (
                F.when(i < acc["next"], acc)
                .when(tens.isNotNull() & linked.isNotNull(), found(tens + linked, 4))
                .when(tens.isNotNull(), found(tens, 2))
                .when(ten.isNotNull() & ones.isNotNull(), found(ten + ones, 2))
                .when(ten.isNotNull(), found(ten, 1))
                .when(single.isNotNull() & (single != 1), found(single, 1))
                .otherwise(acc)
            )

        places = F.when(F.size(syllables) > 0, F.sequence(F.lit(0), F.size(syllables) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.struct(F.lit(0).alias("next"), empty.alias("out")), step, lambda a: F.array_sort(F.array_distinct(a["out"])))

    # the syllables are bound once, by a one-element array
    return F.element_at(F.transform(F.array(bo_syllables(c)), read), 1)


# ---- Sanskrit


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode NFC, which has no built-in."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def sa_normalize(c: Column) -> Column:
    low = nfc(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"(?U)[|।॥\d.\-()\[\]]+", " "), r"(?U)\s+", " "))


def sa_normalized(text: str) -> str:
    """``sa_normalize`` of a constant."""
    low = unicodedata.normalize("NFC", text.strip().lower())
    return re.sub(r"\s+", " ", re.sub(r"[|।॥\d.\-()\[\]]+", " ", low)).strip()


def sa_length(c: Column) -> Column:
    return F.regexp_count(sa_normalize(c), F.lit(SA_VOWELS)).cast("long")


def consume(text: Column, forms: list[tuple[str, object]], kind: str) -> Column:
    """Values of the forms found, longest first; a found form's characters can't be found again.

    ``forms`` are (form, value) in order of priority among equal lengths.
    """
    ordered = sorted(forms, key=lambda f: -len(f[0]))
    table = F.array(*(F.struct(F.lit(f).alias("form"), F.lit(v).cast(kind).alias("value"), F.lit("\0" * len(f)).alias("mask")) for f, v in ordered))
    zero = F.struct(text.alias("left"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, f: Column) -> Column:
        hit = F.struct(F.replace(acc["left"], f["form"], f["mask"]).alias("left"), F.concat(acc["out"], F.array(f["value"])).alias("out"))
        return F.when(F.contains(acc["left"], f["form"]), hit).otherwise(acc)

    return F.aggregate(table, zero, step, lambda a: F.array_sort(F.array_distinct(a["out"])))


def sa_numbers(c: Column) -> Column:
    return consume(sa_normalize(c), list(SA_NUMERALS.items()), "bigint")


# ---- dispatch by language


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")).cast("long")


def length_in(c: Column, lang: Column) -> Column:
    return F.when(lang == "zh", zh_length(c)).when(lang == "bo", bo_length(c)).when(lang == "sa", sa_length(c)).otherwise(token_count(c))


def numbers_in(c: Column, lang: Column) -> Column:
    return F.when(lang == "zh", zh_numbers(c)).when(lang == "bo", bo_numbers(c)).when(lang == "sa", sa_numbers(c)).otherwise(F.array().cast("array<bigint>"))


# ---- same-language witnesses


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U){STRIPPED}", "")


def lacuna_share(c: Column) -> Column:
    core = strip_marks(c)
    return F.when(F.length(core) > 0, (F.length(core) - F.length(F.translate(core, LACUNA_MARKS, ""))) / F.length(core)).otherwise(F.lit(0.0))


def clauses(c: Column, marks: str = CLAUSE_MARKS) -> Column:
    """Text cut behind each mark, trimmed; clauses of marks and blanks alone are dropped."""
    parts = F.regexp_extract_all(c, F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+$)"))
    return F.transform(F.filter(parts, lambda p: F.length(strip_marks(p)) > 0), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))


def sentences(c: Column, marks: str = CLAUSE_MARKS) -> Column:
    """Runs up to and with a run of marks and a closing quote; the tail without marks too."""
    return F.regexp_extract_all(c, F.lit(f"([^{marks}]*[{marks}]+[」』]?|[^{marks}]+$)"))


def shad_units(c: Column) -> Column:
    """Text cut behind each delimiter of Tibetan prose; the delimiter stays."""
    marks = "།༎༏༐༑༔"
    return F.regexp_extract_all(c, F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+$)"))


class Variants:
    """Characters that are read as one: ``(variant, canonical)`` pairs, later ones winning."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.mapping = dict(pairs)

    def normalize(self, c: Column) -> Column:
        return F.translate(c, "".join(self.mapping), "".join(self.mapping.values())) if self.mapping else c

    def explained(self, a: Column, b: Column) -> Column:
        """``x=y`` for the places, up to the shorter's end, that differ but are read as one."""
        n = F.least(F.length(a), F.length(b))
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

        def differ(i: Column) -> Column:
            x, y = F.substr(a, i, F.lit(1)), F.substr(b, i, F.lit(1))
            return (x != y) & (self.normalize(x) == self.normalize(y))

        return F.transform(F.filter(places, differ), lambda i: F.concat(F.substr(a, i, F.lit(1)), F.lit("="), F.substr(b, i, F.lit(1))))
