"""Model-backed roles: a model is called once per row in a map over partitions, its answers are
guarded by columns. Backends: any callable of prompt and system text, a deterministic mock, or a
client of a chat-completion server. Answers are rows like any other: write them before they are
read twice, so that no call is made again.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collatio.functions import guards as G
from collatio.functions.similarity import gram_recall
from collatio.operators.attribution import LABELS, asserts_motive

SYSTEM = "You compare versions of one text. You never speculate on anyone's motives. You answer only in the requested JSON."
# The seed of all calls, and the bead shapes that are judged.
SEED = 20260930
DOUBTFUL = ("1:0", "0:1", "1:3", "3:1", "2:2")


def schema(fields: dict[str, Any], required: tuple[str, ...] = ()) -> dict:
    """A JSON schema of an object: each field a type's name, a list of allowed values, or a schema."""

    def one(kind: Any) -> dict:
        if isinstance(kind, (tuple, list)):
            return {"type": "string", "enum": list(kind)}
        if kind == "array":
            return {"type": "array", "items": {"type": "string"}}
        return kind if isinstance(kind, dict) else {"type": kind}

    return {"type": "object", "properties": {k: one(v) for k, v in fields.items()}, "required": list(required or fields)}


@dataclass(frozen=True)
class Mock:
    """Answers without a model: what ``respond`` says, else empty values of the asked fields (null for
    numbers and objects), else fixed text."""

    name: str = "mock"
    respond: Callable[[str], str] | None = None

    def __call__(self, prompt: str, fields: dict | None = None, most: int = 1024) -> str:
        if self.respond is not None:
            return self.respond(prompt)
        if fields is None:
            return "mock response"
        empty = {"array": [], "string": ""}
        return json.dumps({k: empty.get(v["type"]) for k, v in fields["properties"].items()})


@dataclass(frozen=True)
class ChatServer:
    """A chat-completion endpoint on this network; temperature 0 and a fixed seed.

    A schema is sent both ways that servers know, as a response format and as guided decoding.
    """

    name: str
    url: str
    seed: int = SEED
    timeout: float = 600.0
    key: str = "EMPTY"

    def body(self, prompt: str, fields: dict | None = None, most: int = 1024) -> dict:
        out: dict[str, Any] = {
            "model": self.name, "seed": self.seed, "temperature": 0.0, "max_tokens": most,
            "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": prompt}],
        }
        if fields is not None:
            out["response_format"] = {"type": "json_schema", "json_schema": {"name": "out", "schema": fields}}
            out["guided_json"] = fields
        return out

    def __call__(self, prompt: str, fields: dict | None = None, most: int = 1024) -> str:
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        request = urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(self.body(prompt, fields, most)).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"] or ""


def backend(name: str, profiles: dict[str, dict] | None = None):
    """The mock, or the server of a model profile; models inside this process are out of scope."""
    if name == "mock":
        return Mock()
    known = profiles or {}
    if name not in known:
        raise ValueError(f"unknown model {name!r}: one of {', '.join(sorted([*known, 'mock']))}")
    profile = known[name]
    if profile.get("serve") == "transformers":
        raise ValueError(f"{name} is loaded in-process, which this engine leaves to a server")
    return ChatServer(profile.get("served_name", profile["model_id"]), profile.get("base_url", "http://localhost:8000/v1"))


#: Columns of a call's record.
CALL = ("model_id", "prompt_sha256", "system_sha256", "response_sha256", "temperature", "max_tokens", "seconds", "n_prompt_chars", "n_response_chars")


def ask(df: DataFrame, prompt: Column, model, fields: dict | None = None, most: int = 1024) -> DataFrame:
    """``df`` with ``response`` and the call's record (CALL)."""
    asked = df.withColumn("_prompt", prompt)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema) + ", response string, seconds double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said, seconds = [], []
            for p in pdf["_prompt"]:
                began = time.perf_counter()
                said.append(model(p, fields, most))
                seconds.append(round(time.perf_counter() - began, 3))
            yield pdf.assign(response=said, seconds=seconds)

    out = asked.mapInPandas(run, columns)
    record = {
        "model_id": F.lit(model.name), "prompt_sha256": F.sha2("_prompt", 256), "system_sha256": F.sha2(F.lit(SYSTEM), 256), "response_sha256": F.sha2("response", 256), "temperature": F.lit(0.0),
        "max_tokens": F.lit(most), "seconds": F.col("seconds"), "n_prompt_chars": F.length("_prompt"), "n_response_chars": F.length("response"),
    }
    return out.select(*df.columns, "response", *(c.alias(n) for n, c in record.items()))


def call_log(answered: DataFrame) -> DataFrame:
    """The records of an answered table's calls."""
    return answered.where("response is not null").select(*CALL)


def _said(response: Column) -> Column:
    """An answer in words: thoughts left out."""
    return F.trim(F.regexp_replace(response, r"(?s)<think>.*?</think>", ""))


# ---- alignment judge


def neighbours(rows: DataFrame, order: str = "row_no", text: str = "wit_text", partition: list[str] | None = None) -> DataFrame:
    """Witness text before and after each row of the review table, over the whole table unless partitioned.

    The whole table is one ordered window; a review table is one run's beads. Give ``partition``
    for many runs at once.
    """
    w = Window.partitionBy(*(partition or [])).orderBy(order)
    return rows.withColumn("before", F.lag(text, 1, "").over(w)).withColumn("after", F.lead(text, 1, "").over(w))


def to_judge(rows: DataFrame, shapes: tuple[str, ...] = DOUBTFUL) -> DataFrame:
    return rows.where(_doubtful(shapes))


def _doubtful(shapes: tuple[str, ...]) -> Column:
    return F.col("shape").isin(*shapes) & (F.coalesce("review_status", F.lit("")) == "")


VERDICT = schema({"verdict": G.VERDICTS, "confidence": "number", "shared_content": "array", "note": "string"}, ("verdict", "confidence"))


def judge_beads(rows: DataFrame, model, least: float = 0.6, ref_lang: str = "reference", wit_lang: str = "witness") -> DataFrame:
    """Verdict, confidence, review status and note of beads ``(shape, ref_text, wit_text, before, after, …)``."""

    def part(title: str, c: str) -> Column:
        return F.concat(F.lit(f"\n\n{title}:\n"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("(none)")))

    prompt = F.concat(
        F.lit("An aligner pairs two passages as a bead of shape "), F.col("shape"), part(f"Reference ({ref_lang})", "ref_text"), part(f"Witness ({wit_lang})", "wit_text"), part("Witness before", "before"), part("Witness after", "after"),
        F.lit(
            "\n\nDo they say the same? Answer with a verdict (" + ", ".join(G.VERDICTS) + "), your confidence from 0 to 1, and the content they share."
        ),
    )
    out = ask(rows, prompt, model, VERDICT, 400)
    a = G.answer(F.col("response"), "verdict string, confidence string, shared_content array<string>, note string")
    out = out.withColumn("_a", a).withColumn(
        "verdict", G.one_of(F.col("_a.verdict"), G.VERDICTS, "unsure"),
    ).withColumn("confidence", G.unit_interval(F.col("_a.confidence")))
    status = F.concat(F.lit("llm:"), F.when(F.col("confidence") >= least, F.col("verdict")).otherwise("unsure"))
    shared = F.array_join(F.coalesce("_a.shared_content", F.array().cast("array<string>")), "; ")
    note = F.trim(
        F.concat(F.lit(f"[{model.name} c="), F.format_string("%.2f", "confidence"), F.lit("] "), shared, F.lit(" "), F.coalesce("_a.note", F.lit("")))
    )
    return out.withColumn("review_status", status).withColumn("review_note", note).drop("_a")


def judge_table(
    rows: DataFrame, model, shapes: tuple[str, ...] = DOUBTFUL, least: float = 0.6, ref_lang: str = "reference", wit_lang: str = "witness",
) -> DataFrame:
    """A review table ``(row_no, …)`` whose doubtful rows without a status are judged; the others stay as they are.

    The calls' records stay in the table (null where no call was made).
    """
    named = rows if "review_note" in rows.columns else rows.withColumn("review_note", F.lit(""))
    near = neighbours(named)
    done = judge_beads(near.where(_doubtful(shapes)), model, least, ref_lang, wit_lang)
    return done.select(*named.columns, "response", *CALL).unionByName(
        near.where(~F.coalesce(_doubtful(shapes), F.lit(False))).select(*named.columns), allowMissingColumns=True,
    )


# ---- other roles


def segment(rows: DataFrame, model) -> DataFrame:
    """``propositions`` of each text: the model's pieces if they tile it, else the text."""
    out = ask(rows, F.concat(F.lit("Cut into propositions, copying characters:\n"), F.col("text")), model, schema({"propositions": "array"}), 768)
    a = G.answer(F.col("response"), "propositions array<string>")
    return out.withColumn("propositions", G.tiles(F.coalesce(a["propositions"], F.array().cast("array<string>")), F.col("text")))


def extract_components(rows: DataFrame, model) -> DataFrame:
    """``slots`` (verbatim values by slot), ``rejected`` and ``lexicon_keys`` of rows ``(text, lang, anchors)``."""
    asked = F.concat(
        F.lit("Segment ("), F.col("lang"), F.lit("):\n"), F.col("text"), F.lit("\n\nAnchors: "), F.array_join("anchors", ", "),
        F.lit("\n\nFill the slots " + ", ".join(G.SLOTS) + " with exact substrings; list the anchors used."),
    )
    out = ask(rows, asked, model, schema({**dict.fromkeys(G.SLOTS, "array"), "lexicon_keys": "array"}, G.SLOTS), 512)
    out = out.withColumn("_a", G.answer(F.col("response"), ", ".join(f"{s} array<string>" for s in (*G.SLOTS, "lexicon_keys"))))
    none = F.array().cast("array<string>")
    got = {s: F.coalesce(F.col(f"_a.{s}"), none) for s in (*G.SLOTS, "lexicon_keys")}
    slots = F.create_map(*(x for s in G.SLOTS for x in (F.lit(s), G.verbatim(got[s], F.col("text")))))
    rejected = F.concat(*(F.transform(G.invented(got[s], F.col("text")), _named(s)) for s in G.SLOTS))
    return out.withColumn("slots", slots).withColumn("rejected", rejected).withColumn(
        "lexicon_keys", G.allowed_only(got["lexicon_keys"], F.col("anchors")),
    ).drop("_a")


def _named(slot: str) -> Callable[[Column], Column]:
    return lambda v: F.concat(F.lit(f"{slot}:"), v)


def label_topics(rows: DataFrame, model) -> DataFrame:
    out = ask(rows, F.concat(F.lit("Topic of:\n"), F.col("text")), model, schema({"topic": G.TOPICS, "cues": "array"}, ("topic",)), 200)
    out = out.withColumn("_a", G.answer(F.col("response"), "topic string, cues array<string>"))
    return out.withColumn("topic", G.one_of(F.col("_a.topic"), G.TOPICS, "other")).withColumn(
        "cues", G.verbatim(F.coalesce("_a.cues", F.array().cast("array<string>")), F.col("text")),
    ).drop("_a")


SHARES = schema(
    {
        "distribution": {"type": "object", "properties": {k: {"type": "number"} for k in LABELS}},
        "cited_facts": {"type": "array", "items": {"type": "integer"}}, "note": "string",
    },
    ("distribution",),
)


def judge_attribution(rows: DataFrame, model) -> DataFrame:
    """Distribution over LABELS for rows ``(unit, facts)``, ``facts`` an array or a text of facts set off by ``; ``.

    Adds ``distribution``, ``top``, ``cited`` (numbers of facts there are), ``note`` and ``motive``. A
    note that names a motive, or no facts, abstains.
    """
    listed = F.col("facts") if rows.schema["facts"].dataType.simpleString().startswith("array") else F.filter(
        F.split(F.coalesce("facts", F.lit("")), "; "), lambda x: x != "",
    )
    kept = F.coalesce(listed, F.array().cast("array<string>"))
    numbered = F.array_join(F.transform(kept, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")
    prompt = F.concat(
        F.lit("A unit is not kept whole by a witness. These numbered facts are all the evidence:\n"), numbered,
        F.lit("\n\nShare out probability over " + ", ".join(LABELS) + ", and cite the numbers you used."),
    )
    out = ask(rows.withColumn("_facts", kept), prompt, model, SHARES, 300)
    out = out.withColumn("_a", G.answer(F.col("response"), "distribution map<string,string>, cited_facts array<string>, note string"))
    note = F.coalesce("_a.note", F.lit(""))
    motive = asserts_motive(note)
    empty = F.create_map().cast("map<string,string>")
    raw = F.when(motive | (F.size("_facts") == 0), empty).otherwise(F.coalesce("_a.distribution", empty))
    number = F.transform(F.coalesce("_a.cited_facts", F.array().cast("array<string>")), lambda x: x.try_cast("double").cast("int"))
    cited = F.filter(number, lambda i: (i >= 1) & (i <= F.size("_facts")))
    out = out.withColumn("motive", motive).withColumn("note", note).withColumn("cited", cited).withColumn(
        "distribution", G.distribution(raw, LABELS, "abstain"),
    )
    most = F.array_max(F.map_values("distribution"))
    top = F.coalesce(*(F.when(F.col("distribution")[x] == most, x) for x in LABELS))
    return out.withColumn("top", top).drop("_a", "_facts")


def explain(rows: DataFrame, model) -> DataFrame:
    """``rationale`` and ``motive`` of cells ``(unit, witness, status, …)``; only what can be seen is asked for."""
    seen = [c for c in ("unit", "witness", "status", "bead", "ref_text", "wit_text", "d_len", "d_lit") if c in rows.columns]
    out = ask(rows, F.concat(F.lit("Describe in three sentences at most what differs in this cell: "), F.to_json(F.struct(*seen))), model, None, 200)
    return out.withColumn("rationale", _said(F.col("response"))).withColumn("motive", asserts_motive(F.col("rationale")))


def counterfactual(items: DataFrame, models: list) -> DataFrame:
    """Answers ``(model, unit, a, b)`` without and with ``fact``, for items ``(unit, source_text, fact[, context])``."""
    context = F.col("context") if "context" in items.columns else F.lit("")
    asked = F.concat(
        F.lit("The source has unit "), F.col("unit"), F.lit(":\n"), F.col("source_text"),
        F.lit("\n\nThe translation has no counterpart of it; around its place stands:\n"), context,
        F.lit("\n\nSay in two sentences how this may have come about."),
    )
    out = None
    for m in models:
        a = ask(items.withColumn("_asked", asked), F.col("_asked"), m, None, 200).select("unit", "fact", "_asked", F.col("response").alias("a"))
        b = ask(
            a, F.concat(F.col("_asked"), F.lit("\n\nAdditional fact: "), F.col("fact")), m, None, 200,
        ).select(F.lit(m.name).alias("model"), "unit", "a", F.col("response").alias("b"))
        out = b if out is None else out.unionByName(b)
    return out


def probe(items: DataFrame, model, n: int = 4, prefix: int = 40, least: int = 80) -> DataFrame:
    """``(source, ref, overlap, response, CALL…)``: recall of a passage's continuation in the model's, cut to twice its length."""
    parts = items.withColumn(
        "_p", G.probe_items(F.col("text"), prefix, least),
    ).where("_p is not null").select("source", "ref", "_p.prefix", "_p.continuation")
    out = ask(parts, F.concat(F.lit("Continue this passage word for word as it was published; write nothing else.\n\n"), F.col("prefix")), model)
    said = F.substr(F.regexp_replace("response", r"(?s)<think>.*?</think>", ""), F.lit(1), 2 * F.length("continuation"))
    return out.select("source", "ref", gram_recall(F.col("continuation"), said, n).alias("overlap"), "response", *CALL)
