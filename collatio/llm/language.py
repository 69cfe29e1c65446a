"""Language identification: which languages a text mixes, and in what proportions.

Every language has a distribution over hashed n-grams of characters, learnt from labelled texts.
A word's likelihood under a language is that of its n-grams; a text is a mixture of languages
word by word, its proportions estimated by expectation-maximisation. Sets of languages, the
largest proportions first, of every size up to all, are compared by likelihood less a penalty for
each further language (half the logarithm of the number of words, as in the Bayesian information
criterion). No set fits better than all languages do, so a text's larger sets are left out once
that bound less their penalty is below the best value found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import Words, byte_texts, ranges, segment_sums, slices


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    lengths: tuple[int, ...] = (1, 2, 3, 4)
    smoothing: float = 0.5
    rounds: int = 10
    penalty: float = 1.0
    #: least likelihood of a word under a language, relative to its best language
    floor: float = 1e-4


def grams(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of each word (with its ends marked by blanks), and their number by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths - np.arange(len(words))  # neighbours share their blank
    word = np.repeat(np.arange(len(words)), lengths)
    at = ranges(starts, lengths)
    left = np.repeat(starts + lengths, lengths) - at  # characters to the word's end
    out, owner = [], []
    with np.errstate(over="ignore"):
        for n in s.lengths:
            ok = left >= n
            place = at[ok]
            code = np.full(len(place), n, np.uint64)
            for j in range(n):
                code = code * np.uint64(0x100000001B3) + data[place + j]
            out.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % s.buckets)
            owner.append(word[ok])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order], np.bincount(owner, minlength=len(words))


OTHERS = re.compile(r"[\W\d_]+")


def letters(word: bytes) -> str:
    """The word's letters, lower-cased; empty where it has none."""
    if word.isalpha() or (word := word.strip(b".,;:!?|\"'()*#$%&")).isalpha():  # ASCII letters only
        return word.lower().decode()
    left = OTHERS.sub("", word.decode("utf-8", "replace").lower())
    return left if left.isalpha() else "".join(filter(str.isalpha, left))


def _learn(df: DataFrame, s: Settings) -> DataFrame:
    """``(lang, bucket, n)`` from ``df(lang, text)``: n-grams counted for each partition, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                texts = byte_texts(part, "text")
                for lang in sorted(set(langs)):
                    words = Words([t for t, x in zip(texts, langs) if x == lang])
                    own = [letters(w) for w in words.vocab]
                    times = np.bincount(words.ids, minlength=len(own))
                    keep = [i for i, w in enumerate(own) if w]
                    bucket, each = grams([own[i] for i in keep], s)
                    n = counts.setdefault(lang, np.zeros(s.buckets, np.int64))
                    n += np.bincount(bucket, np.repeat(times[keep], each), s.buckets).astype(np.int64)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], names=["lang", "bucket", "n"],
            )

    return df.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(df: DataFrame, s: Settings) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities, one row each: at most ``buckets`` numbers a language."""
    got = _learn(df, s).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), s.buckets))
    place = {x: i for i, x in enumerate(langs)}
    counts[[place[x] for x in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    logs = np.log((counts + s.smoothing) / (counts.sum(axis=1, keepdims=True) + s.smoothing * s.buckets))
    return langs, logs.astype(np.float32)


def _em(lik: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by text after at most ``rounds`` from ``share``, and the log likelihood they reach.

    A text whose proportions have settled takes no part in further rounds.
    """
    share, live, rows, each = share.astype(np.float32), np.arange(len(counts)), lik, counts
    for _ in range(rounds):
        now = share[live]
        joint = rows * np.repeat(now, each, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        new = (segment_sums(joint.astype(np.float64), each) / np.maximum(each, 1)[:, None]).astype(np.float32)
        share[live] = new
        moving = np.abs(new - now).max(axis=1) > SETTLED
        if moving.mean() < 0.7:
            rows, live, each = rows[np.repeat(moving, each)], live[moving], each[moving]
        if not len(live):
            break
    fit = np.log((lik * np.repeat(share, counts, axis=0)).sum(axis=1, dtype=np.float32))
    return share.astype(np.float64), segment_sums(fit.astype(np.float64), counts)


#: A change of proportions below this ends a text's rounds.
SETTLED = 1e-3


def infer(texts: list[bytes], logs: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by text (all 0 without letters), and how far the mixture is above chance.

    The latter is the mean log likelihood of an n-gram over that of a uniform choice of buckets.
    """
    words = Words(texts)
    own = [letters(w) for w in words.vocab]
    real = np.array([bool(w) for w in own], bool)
    bucket, each = grams([w for w in own if w], s)
    ll, size = np.zeros((len(own), len(logs))), np.zeros(len(own))
    if len(bucket):
        ll[real] = np.stack([segment_sums(row[bucket].astype(np.float64), each) for row in logs], axis=1) / len(s.lengths)
        size[real] = each / len(s.lengths)
    top = ll.max(axis=1) if len(own) else np.zeros(0)
    lik = np.maximum(np.exp(ll - top[:, None]), s.floor) if len(own) else ll
    text = np.repeat(np.arange(len(texts)), words.counts)
    kept = real[words.ids] if len(own) else np.zeros(0, bool)
    counts = np.bincount(text[kept], minlength=len(texts))
    ids = words.ids[kept]
    lik = lik.astype(np.float32)[ids]
    langs = len(logs)
    share, all_fit = _em(lik, counts, np.full((len(texts), langs), 1 / langs), s.rounds)
    cost = s.penalty * 0.5 * np.log(np.maximum(counts, 1))
    best, fit, value = share.copy(), all_fit.copy(), all_fit - cost * (langs - 1)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    first = np.cumsum(counts) - counts
    for m in range(1, langs):
        live = np.flatnonzero((all_fit - cost * (m - 1) >= value) & (counts > 0))
        if not len(live):
            break
        begin = np.where(rank[live] < m, np.maximum(share[live], 1e-12), 0)
        got, reached = _em(lik[ranges(first[live], counts[live])], counts[live], begin / begin.sum(axis=1, keepdims=True), s.rounds if m > 1 else 0)
        worth = reached - cost[live] * (m - 1)
        better = worth >= value[live] if m == 1 else worth > value[live]
        at = live[better]
        best[at], fit[at], value[at] = got[better], reached[better], worth[better]
    size = segment_sums(size[ids], counts)
    above = (fit + segment_sums(top[ids], counts)) / np.maximum(size, 1e-9) + np.log(s.buckets)
    return np.where(counts[:, None] > 0, best, 0.0), np.where(counts > 0, above, 0.0)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def identify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per row of ``df``: ``(id, held_out, lang_pred, score, languages, above_chance)``.

    Learns from the rows with a language, a text and an id whose crc32 modulo 3 is not 1;
    predictions see the text alone. The columns of ``carry`` are passed on behind these. ``languages`` is the chosen
    set with proportions, ``array<struct<lang, share>>`` by falling share, ``lang_pred`` its
    first and ``score`` that share; ties go to the first language by code point. Null text, and
    text without letters, is ``und`` with score 0 and no languages, and so is all text where
    nothing was learnt. ``above_chance`` is the mean log likelihood of the text's n-grams under its
    mixture over that of buckets drawn at random: 0 or less means that no language explains the
    text (0 for ``und``). A null id is not held out and not learnt from. Repeated rows are
    learnt from each time; other columns are ignored. Texts are read whole.
    """
    s = settings or Settings()
    labelled = df.where((F.crc32(F.col(id_col).cast("string")) % 3 != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    langs, logs = train(labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), s)
    model = df.sparkSession.sparkContext.broadcast((langs, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = byte_texts(part, "text")
                share, above = infer(texts, logs, s) if langs else (np.zeros((len(texts), 0)), np.zeros(len(texts)))
                found = []
                for row in share:
                    at = np.argsort(-row, kind="stable")
                    found.append([{"lang": langs[i], "share": min(1.0, float(row[i]))} for i in at if row[i] > 0])
                kept = {f"carry_{i}": part.column(f"carry_{i}") for i in range(len(carry))}
                own = {
                    "id": part.column("id"), "held_out": part.column("held_out"), "languages": pa.array(found, kind),
                    "above_chance": pa.array(above),
                }
                yield pa.RecordBatch.from_arrays([*own.values(), *kept.values()], names=[*own, *kept])

    texts = df.select(
        F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"),
        *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)),
    )
    more = "".join(f", carry_{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))
    got = texts.mapInArrow(
        run,
        f"id {texts.schema['id'].dataType.simpleString()}, held_out boolean, languages array<struct<lang:string,share:double>>, above_chance double{more}",
    )
    first = F.try_element_at("languages", F.lit(1))
    return got.select(
        F.col("id").alias(id_col), "held_out", F.coalesce(first["lang"], F.lit("und")).alias("lang_pred"),
        F.coalesce(first["share"], F.lit(0.0)).alias("score"), "languages", "above_chance",
        *(F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)),
    )
