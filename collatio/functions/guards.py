"""Guards for model output as columns: tolerant JSON, closed sets, substrings, distributions, tiling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slots, verdicts and topics that a model may answer with.
SLOTS = ("actor", "action", "patient", "instrument", "negation", "condition", "quantity", "result")
VERDICTS = ("accept", "shift_left", "shift_right", "split", "merge", "make_null", "unsure")
TOPICS = (
    "sexual_yoga", "violent_rite", "transgressive_substance", "charnel_imagery", "mantra_ritual", "doctrine_philosophy", "iconography",
    "narrative_frame", "other",
)


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def json_object(text: Column) -> Column:
    """The first JSON object of an answer, thoughts and code fences left out; null if there is none."""
    t = _strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(.*?)```", 1)
    t = F.when(t.rlike(r"(?s)```(?:json)?\s*(.*?)```"), _strip(fenced)).otherwise(t)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.when(t.startswith("{"), t).otherwise(F.nullif(inner, F.lit("")))


def answer(text: Column, schema: str) -> Column:
    return F.from_json(json_object(text), schema)


def one_of(value: Column, allowed: Sequence[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def unit_interval(value: Column) -> Column:
    """A number clamped to 0 … 1; anything else is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def verbatim(values: Column, text: Column) -> Column:
    """Trimmed values that occur in the text as they are, in order, repeats kept."""
    return F.filter(F.transform(values, _strip), lambda v: (v != "") & F.contains(text, v))


def invented(values: Column, text: Column) -> Column:
    return F.filter(F.transform(values, _strip), lambda v: (v != "") & ~F.contains(text, v))


def allowed_only(values: Column, allowed: Column) -> Column:
    return F.filter(values, lambda v: F.array_contains(allowed, v))


def distribution(raw: Column, labels: Sequence[str], abstain: str) -> Column:
    """Map over ``labels`` that adds up to 1: what isn't a positive number is 0, all zeros abstain."""
    clean = {x: F.greatest(F.lit(0.0), F.coalesce(F.try_element_at(raw, F.lit(x)).try_cast("double"), F.lit(0.0))) for x in labels}
    total = sum(clean.values(), F.lit(0.0))
    pairs = [y for x in labels for y in (F.lit(x), F.when(total > 0, clean[x] / F.nullif(total, F.lit(0.0))).otherwise(float(x == abstain)))]
    return F.create_map(*pairs)


def tiles(pieces: Column, text: Column, least: float = 0.9) -> Column:
    """The pieces if they occur in the text one behind the other and cover enough of it, else the text."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, p: Column) -> Column:
        at = F.call_function("locate", p, text, acc["at"])
        return F.when((p != "") & (at > 0), F.struct((at + F.length(p)).alias("at"), F.concat(acc["kept"], F.array(p)).alias("kept"))).otherwise(acc)

    kept = F.aggregate(F.transform(pieces, _strip), start, step, lambda a: a["kept"])
    cover = F.aggregate(kept, F.lit(0), lambda s, p: s + F.length(p))
    return F.when((F.size(kept) > 0) & (cover >= least * F.length(F.replace(text, F.lit(" "), F.lit("")))), kept).otherwise(F.array(text))


def filled(slots: Column) -> Column:
    return F.map_keys(F.map_filter(slots, lambda k, v: F.size(v) > 0))


def component_deviation(ref: Column, wit: Column) -> Column:
    """Slots lost and added between two maps slot -> values, and the share of the reference's that is lost."""
    r, w = filled(ref), filled(wit)
    lost = F.array_sort(F.array_except(r, w))
    return F.struct(
        lost.alias("lost"), F.array_sort(F.array_except(w, r)).alias("added"),
        F.when(F.size(r) > 0, F.size(lost) / F.size(r)).otherwise(0.0).alias("loss_rate"),
    )


def probe_items(text: Column, prefix: int = 40, least: int = 80) -> Column:
    """Struct of prefix and continuation; null for short texts."""
    t = _strip(text)
    return F.when(F.length(t) >= least, F.struct(F.substring(t, 1, prefix).alias("prefix"), F.substr(t, F.lit(prefix + 1)).alias("continuation")))
