"""Secret scans by a trigram inverted index over each slice of texts.

From every rule's parsed regular expression a Boolean query over trigrams is derived: a
conjunction of clauses, each a disjunction of trigram sets, that every matching text fulfils.
A slice's texts are indexed once for the trigrams any rule asks for (ASCII letters folded);
postings are intersected and united into each rule's candidate texts, and only these are
verified with the expression. A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import re
import re._constants as rc
import re._parser as rp
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collatio.llm._common import byte_texts, slices

#: Literal strings followed at once while a query is derived; more end the current clause.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """``kind`` of secret; matches of ``pattern`` whose ``group`` has ``least`` characters are spans."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

#: One clause: any of these trigram sets; a query: all of its clauses. No clauses: no demand.
Clause = frozenset[frozenset[str]]


def _small_set(items: list) -> set[str] | None:
    """The characters of a class, or None where there are many."""
    out: set[str] = set()
    for op, value in items:
        if op is rc.LITERAL:
            out.add(chr(value).lower())
        elif op is rc.RANGE and value[1] - value[0] < 4:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 6 else None


def _clause(strings: set[str]) -> Clause | None:
    """The demand that one of ``strings`` occurs; None where a string is too short to demand anything."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _strings(tree: Sequence) -> set[str] | None:
    """All strings that a subtree matches, where they are few."""
    ends = {""}
    for op, value in tree:
        if op is rc.LITERAL:
            more = {chr(value).lower()}
        elif op is rc.IN:
            more = _small_set(value)
        elif op is rc.SUBPATTERN:
            more = _strings(value[-1])
        elif op is rc.BRANCH:
            parts = [_strings(x) for x in value[1]]
            more = None if None in parts else set().union(*parts)
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[1] <= 3:
            unit = _strings(value[2])
            more = None
            if unit is not None:
                power, more = {""}, {""} if value[0] == 0 else set()
                for n in range(1, value[1] + 1):
                    power = {a + b for a in power for b in unit}
                    more |= power if n >= value[0] else set()
        elif op is rc.AT:
            more = {""}
        else:
            more = None
        if more is None or len(ends) * len(more) > MOST_STRINGS:
            return None
        ends = {a + b for a in ends for b in more}
    return ends


def _query(tree: Sequence) -> list[Clause]:
    clauses: list[Clause] = []
    ends = {""}

    def flush() -> None:
        nonlocal ends
        if (c := _clause(ends)) is not None:
            clauses.append(c)
        ends = {""}

    for item in tree:
        more = _strings([item])
        if more is not None and len(ends) * len(more) <= MOST_STRINGS:
            ends = {a + b for a in ends for b in more}
            continue
        flush()
        op, value = item
        if more is not None:
            ends = more
        elif op is rc.SUBPATTERN:
            clauses += _query(value[-1])
        elif op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and value[0] >= 1:
            clauses += _query(value[2])
        elif op is rc.BRANCH:
            parts = [_query(x) for x in value[1]]
            if all(parts):  # one clause of each alternative is demanded: any of them
                clauses.append(frozenset().union(*(p[0] for p in parts)))
    flush()
    return clauses


def trigram_query(rule: Rule) -> list[Clause]:
    """Clauses that every text with a match fulfils, over ASCII-folded trigrams of UTF-8 bytes."""
    clauses = _query(rp.parse(rule.pattern, re.ASCII))
    return [c for c in clauses if all(t.isascii() for s in c for t in s)]


class Index:
    """Postings of the wanted trigrams over some texts: sorted text numbers by trigram."""

    def __init__(self, wanted: set[str]):
        self.codes = {t: self._code(t) for t in wanted}
        self.lookup = np.zeros(1 << 24, bool)
        self.lookup[list(self.codes.values())] = True

    @staticmethod
    def _code(t: str) -> int:
        a, b, c = t.encode("latin-1")
        return a << 16 | b << 8 | c

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        joined = np.frombuffer(b"\0\0".join(texts).lower(), np.uint8).astype(np.int32)
        if len(joined) < 3:
            return {}
        codes = joined[:-2] << 16 | joined[1:-1] << 8 | joined[2:]
        at = np.flatnonzero(self.lookup[codes])
        ends = np.cumsum([len(t) + 2 for t in texts])
        pairs = np.unique(codes[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right"))
        found, docs = pairs >> 32, pairs & 0xFFFFFFFF
        return {t: docs[np.searchsorted(found, c) : np.searchsorted(found, c, "right")] for t, c in self.codes.items()}


def candidates(query: list[Clause], postings: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the texts that fulfil ``query``."""
    left = np.arange(n)
    none = np.zeros(0, np.int64)
    for clause in query:
        any_of = []
        for grams in clause:
            docs = left
            for t in sorted(grams, key=lambda t: len(postings.get(t, none))):
                docs = np.intersect1d(docs, postings.get(t, none), assume_unique=True)
            any_of.append(docs)
        left = np.unique(np.concatenate(any_of)) if any_of else left
    return left


Span = tuple[int, int, int]


class Scanner:
    """Spans ``(start, end, rule number)`` of some texts, ends exclusive, in code points."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        self.compiled = [r.compiled() for r in rules]
        self.queries = [trigram_query(r) for r in rules]
        self.index = Index({t for q in self.queries for c in q for s in c for t in s})

    def scan(self, texts: list[bytes]) -> list[list[Span]]:
        out: list[list[Span]] = [[] for _ in texts]
        postings = self.index.postings(texts)
        decoded: dict[int, str] = {}
        for k, (rule, rx, q) in enumerate(zip(self.rules, self.compiled, self.queries)):
            for i in candidates(q, postings, len(texts)).tolist() if q else range(len(texts)):
                if not texts[i]:
                    continue
                if i not in decoded:
                    decoded[i] = texts[i].decode()
                out[i] += [(m.start(), m.end(), k) for m in rx.finditer(decoded[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in out:
            spans.sort(key=lambda s: (s[0], s[2]))
        return out


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(id, spans)`` for every row of ``df``: ``array<struct<kind, start, end>>`` by start, then rule.

    A rule's spans are its leftmost non-overlapping matches, less those whose group is shorter
    than ``least``; spans of different rules may overlap. Null text counts as empty and has no
    spans. Ids pass unchanged (null and repeated ones too), other columns are ignored; texts are
    scanned whole.
    """
    kinds = [r.kind for r in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for part in slices(batch, "text"):
                spans = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in s] for s in scanner.scan(byte_texts(part, "text"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(name: str):
    return lambda s: s["kind"] == name


def digest(found: DataFrame, base: Sequence[Rule] = BASE_RULES) -> DataFrame:
    """Counts per base kind, the digest of base spans, and all spans as text."""
    names = [r.kind for r in base]
    own = F.filter("spans", lambda s: s["kind"].isin(names))
    counts = [F.size(F.filter("spans", _of_kind(n))).cast("long").alias(f"n_{n}") for n in names]
    return found.select(found.columns[0], *counts, F.sha2(written(own), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with every span (overlapping ones as one) in ``text_col`` replaced by ``mark``.

    Rows, column order and all other values stay; null text stays null.
    """
    at = df.columns.index(text_col)

    def clean(text: str, spans: list[Span]) -> str:
        parts, done = [], 0
        for a, b, _ in spans:
            if b <= done:
                continue
            if a >= done:
                parts += [text[done:a], mark]
            done = b
        return "".join([*parts, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                texts = part.column(at).to_pylist()
                found = scanner.scan([(t or "").encode() for t in texts])
                new = [clean(t, s) if s else t for t, s in zip(texts, found)]
                columns = [pa.array(new, pa.string()) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(run, df.schema)
