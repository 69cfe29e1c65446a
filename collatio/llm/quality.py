"""Quality rules: how much of a text lies inside repeated word n-grams and repeated lines.

Word n-grams of several lengths are compared by rolling hashes in numpy. Words are numbered
exactly (a dictionary per slice of texts), each number gets a random odd-looking 64-bit value,
and the hash of n words is the polynomial of their values in an odd base modulo 2^64, rolled
over all texts of the slice at once; the text's number goes into the hash, so repeats count
inside one text only. Where hashes repeat, the words themselves are compared with those of the
first n-gram of that hash, so a chance collision can't add a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import Words, byte_texts, mix64, ranges, segment_sums, slices

BASE = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are in percent of the characters in words."""

    min_words: int = 10
    #: the base rule: percent of words inside repeated windows of ``base_n`` words
    base_n: int = 5
    max_repeat_words: int = 20
    #: n-gram length -> percent of characters inside n-grams that came before
    max_ngram_chars: dict[int, int] = field(default_factory=lambda: {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10})
    #: percent of characters inside lines that came before
    max_line_chars: int = 20


def ngram_hashes(ids: np.ndarray, text: np.ndarray, lengths: Sequence[int]) -> dict[int, np.ndarray]:
    """For each length the rolling hash at every word position; those over a text's end are to be ignored."""
    with np.errstate(over="ignore"):
        value = mix64(ids.astype(np.uint64) + BASE)
        salt = mix64(text.astype(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93))
        out, rolled = {}, np.zeros(len(ids), np.uint64)
        for n in range(1, max(lengths, default=0) + 1):
            ahead = np.zeros(len(ids), np.uint64)
            ahead[: len(ids) - n + 1] = value[n - 1 :]
            rolled = rolled * BASE + ahead
            if n in lengths:
                out[n] = mix64(rolled ^ salt)
    return out


def repeats(hashes: np.ndarray, ids: np.ndarray, n: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(later, first)``: start positions of n-grams that came before in their text, and the first ones' starts."""
    at = np.flatnonzero(valid)
    order = np.sort(hashes[at])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slot = np.minimum(np.searchsorted(twice, hashes[at]), len(twice) - 1)
    hit = twice[slot] == hashes[at]
    at, slot = at[hit], slot[hit]
    first = np.full(len(twice), len(ids), np.int64)
    np.minimum.at(first, slot, at)
    first = first[slot]
    same = at > first
    for j in range(n):
        same &= ids[np.minimum(at + j, len(ids) - 1)] == ids[np.minimum(first + j, len(ids) - 1)]
    return at[same], np.unique(first[same])


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in an n-gram that begins at one of ``starts``."""
    edge = np.zeros(size + n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:size]) > 0


def _line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier one, and the characters of their words."""
    if b"\n" not in text:
        return 0, 0
    seen: set[bytes] = set()
    lines = chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            lines += 1
            chars += sum(len(w.decode()) for w in line.split())
        elif line.split():
            seen.add(line)
    return lines, chars


def measure(texts: list[bytes], rules: Rules) -> dict[str, np.ndarray]:
    """The counts behind the rules, an array by text for each."""
    words = Words(texts)
    ids, counts = words.ids, words.counts
    text = np.repeat(np.arange(len(texts)), counts)
    ends = np.repeat(np.cumsum(counts), counts)
    chars = np.array([len(w.decode()) for w in words.vocab], np.int64)[ids] if len(ids) else ids
    symbols = np.array([len(w) - len(w.translate(None, SYMBOLS)) for w in words.vocab], np.int64)[ids] if len(ids) else ids
    lines = np.array([_line_counts(t) for t in texts], np.int64).reshape(-1, 2)
    out = {"n_words": counts, "word_chars": segment_sums(chars, counts), "n_symbols": segment_sums(symbols, counts), "n_dup_lines": lines[:, 0]}
    hashes = ngram_hashes(ids, text, sorted({rules.base_n, *rules.max_ngram_chars}))
    place = np.arange(len(ids))
    for n, h in hashes.items():
        later, first = repeats(h, ids, n, place + n <= ends)
        if n == rules.base_n:
            out["n_repeat_words"] = segment_sums(covered(np.concatenate([later, first]), n, len(ids)).astype(np.int64), counts)
        if n in rules.max_ngram_chars:
            out[f"dup_chars_{n}"] = segment_sums(np.where(covered(later, n, len(ids)), chars, 0), counts)
    out["dup_line_chars"] = lines[:, 1]
    return out


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules | None = None) -> DataFrame:
    """One row per row of ``df`` with its counts, ``base_failed`` and ``kept``.

    ``base_failed``: under ``min_words`` words, or over ``max_repeat_words`` percent of the words
    in windows of ``base_n`` words found twice or more in the text (the first included). ``kept``:
    not ``base_failed``, and for each n-gram length at most the given percent of the characters
    in words lies in n-grams that came before in the text (``dup_chars_<n>``), and likewise for
    lines (``dup_line_chars``). Null and empty texts have zero counts and fail the base rule. Ids
    are passed on as they are, null and repeated ones too; other columns are ignored. Texts are
    handled whole, a slice of some megabytes at a time (a longer text is a slice of its own).
    """
    rules = rules or Rules()
    lengths = sorted(rules.max_ngram_chars)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"dup_chars_{n}" for n in lengths), "dup_line_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = measure(byte_texts(part, "text"), rules)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(found[c], pa.int64()) for c in counts)], names=["id", *counts])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    got = source.mapInArrow(run, ", ".join([f"id {kind}", *(f"{c} long" for c in counts)]))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_words * F.col("n_words"))
    good = 100 * F.col("dup_line_chars") <= rules.max_line_chars * F.col("word_chars")
    for n in lengths:
        good &= 100 * F.col(f"dup_chars_{n}") <= rules.max_ngram_chars[n] * F.col("word_chars")
    own = counts[:5]
    return got.select(F.col("id").alias(id_col), *own, failed.alias("base_failed"), (~failed & good).alias("kept"), *counts[5:])


def oracle(rules: Rules | None = None) -> str:
    """DuckDB SQL for ``quality`` over the view ``documents``."""
    rules = rules or Rules()
    lengths = sorted({rules.base_n, *rules.max_ngram_chars})
    grams = "\nUNION ALL ".join(
        f"SELECT r, p, {n} AS n, list_aggregate(list_slice(ws, p, p + {n} - 1), 'string_agg', ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {n} + 2)) AS p FROM d)" for n in lengths
    )
    dup = ", ".join(f"coalesce(sum(len(w)) FILTER (in_{n}), 0)::BIGINT AS dup_chars_{n}" for n in sorted(rules.max_ngram_chars))
    flags = ", ".join(f"bool_or(n = {n} AND later) AS in_{n}" for n in sorted(rules.max_ngram_chars))
    limits = " AND ".join(f"100 * dup_chars_{n} <= {m} * word_chars" for n, m in sorted(rules.max_ngram_chars.items()))
    names = ", ".join(f"dup_chars_{n}" for n in sorted(rules.max_ngram_chars))
    zero = ", ".join(f"coalesce(dup_chars_{n}, 0) AS dup_chars_{n}" for n in sorted(rules.max_ngram_chars))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM d),
g AS ({grams}),
k AS (SELECT r, p, n, count(*) OVER (PARTITION BY r, n, g) > 1 AS twice, p > min(p) OVER (PARTITION BY r, n, g) AS later FROM g),
c AS (SELECT r, unnest(range(p, p + n)) AS p, n, later FROM k WHERE twice),
f AS (SELECT r, p, bool_or(n = {rules.base_n}) AS rep, {flags} FROM c GROUP BY r, p),
a AS (SELECT w.r, sum(len(w))::BIGINT AS word_chars, coalesce(sum(len(w) - len(regexp_replace(w, '[#*$%&|<>]', '', 'g'))), 0)::BIGINT AS n_symbols, count(*) FILTER (rep)::BIGINT AS n_repeat_words, {dup} FROM w LEFT JOIN f ON w.r = f.r AND w.p = f.p GROUP BY w.r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
lc AS (SELECT r, line, count(*) - 1 AS more, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line),
ls AS (SELECT r, sum(more)::BIGINT AS n_dup_lines, sum(more * chars)::BIGINT AS dup_line_chars FROM lc GROUP BY r),
x AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {zero}, coalesce(dup_line_chars, 0) AS dup_line_chars FROM d LEFT JOIN a ON d.r = a.r LEFT JOIN ls ON d.r = ls.r),
y AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_words} * n_words AS base_failed FROM x)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * dup_line_chars <= {rules.max_line_chars} * word_chars AND {limits} AS kept, {names}, dup_line_chars FROM y"""
