"""TEI with line marks in mixed content: segments, glosses and apparatus.

``from_xml`` loses the order of mixed content, so the tree walk is a Python map over whole files;
a file is one row of the source, so files are the parallelism.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collatio.functions.text import CLAUSE_MARKS

SEGMENTS = "witness string, seq int, seg_id string, text string, start string, end string, kind string, local_chapter int, inline_notes int"
GLOSSES = "witness string, zh string, sa string, anchor string"
APPARATUS = "witness string, anchor string, lem string, rdg array<string>, wit array<string>"
CLAUSE = re.compile(f"[^{CLAUSE_MARKS}]*[{CLAUSE_MARKS}]+[」』]?|[^{CLAUSE_MARKS}]+$")
SKIPPED = {"note", "anchor", "pb"}
TITLES = "witness string, title_note string"
CHAPTERS = "witness string, n int, title string, start string"
#: What a clause may consist of without being one.
ONLY_MARKS = CLAUSE_MARKS + "「」『』 "


def _name(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2] if isinstance(el.tag, str) else ""


def _text(el: ET.Element) -> str:
    return "".join(el.itertext()).strip()


@dataclass
class _Walk:
    """A document-order walk that knows the line and chapter it is in."""

    witness: str
    line: str = "0000a00"
    chapter: int | None = None
    title_note: str | None = None
    rows: list[tuple] = field(default_factory=list)
    chapters: list[tuple] = field(default_factory=list)

    def chars(self, el: ET.Element) -> list[tuple[str, str]]:
        out = [(c, self.line) for c in el.text or ""]
        for child in el:
            if _name(child) == "lb":
                self.line = child.get("n", self.line)
            elif _name(child) not in SKIPPED:
                out += self.chars(child)
            out += [(c, self.line) for c in child.tail or ""]
        return [x for x in out if x[0] not in "\n\r\t"]

    def add(self, chars: list[tuple[str, str]], kind: str, notes: int = 0) -> None:
        text = "".join(c for c, _ in chars).strip()
        if text:
            number = len(self.rows) + 1
            start, end = chars[0][1], chars[-1][1]
            self.rows.append((self.witness, number, f"zh:{start}:{number:05d}", text, start, end, kind, self.chapter, notes))

    def clauses(self, chars: list[tuple[str, str]], kind: str, notes: int = 0) -> None:
        for m in CLAUSE.finditer("".join(c for c, _ in chars)):
            if m.group().strip(ONLY_MARKS):
                self.add(chars[m.start() : m.end()], kind, notes)

    def block(self, el: ET.Element) -> None:
        name = _name(el)
        if name == "lb":
            self.line = el.get("n", self.line)
        elif name == "mulu":
            if el.get("type") == "品":
                self.chapter = int(el.get("n"))
                self.chapters.append((self.witness, self.chapter, (el.text or "").strip(), self.line))
        elif name in ("jhead", "byline", "docNumber"):
            if name == "jhead" and self.title_note is None:
                note = next((x for x in el.iter() if _name(x) == "note" and x.text), None)
                self.title_note = None if note is None else note.text.strip()
            self.add(self.chars(el), "meta")
        elif name == "head":
            self.add(self.chars(el), "head")
        elif name == "lg":
            for child in el:
                if _name(child) == "lb":
                    self.line = child.get("n", self.line)
                elif _name(child) == "l":
                    self.clauses(self.chars(child), "verse_line")
        elif name == "p":
            self.clauses(self.chars(el), "prose", sum(_name(x) == "note" for x in el.iter()))
        elif name not in SKIPPED:
            for child in el:
                self.block(child)


def parse(content: bytes, witness: str) -> tuple[list[tuple], ...]:
    """Segment, gloss, apparatus, title and chapter rows of one document; an error if it has no body."""
    root = ET.fromstring(content)
    walk = _Walk(witness)
    body = next((el for el in root.iter() if _name(el) == "body"), None)
    if body is None:
        raise ValueError(f"{witness}: no body")
    for child in body:
        walk.block(child)
    glosses, apparatus = [], []
    back = next((el for el in root.iter() if _name(el) == "back"), ())
    for el in back.iter() if len(back) else ():
        if _name(el) == "tt":
            said = {t.get("{http://www.w3.org/XML/1998/namespace}lang", ""): _text(t) for t in el if _name(t) == "t"}
            zh, sa = next((v for k, v in said.items() if k.startswith("zh")), ""), said.get("sa", "").rstrip(".")
            if zh and sa:
                glosses.append((witness, zh, sa, el.get("from", "")))
        elif _name(el) == "app":
            readings = [x for x in el if _name(x) == "rdg"]
            lem = next((_text(x) for x in el if _name(x) == "lem"), "")
            apparatus.append((witness, el.get("from", ""), lem, [_text(x) for x in readings], [x.get("wit", "") for x in readings]))
    return walk.rows, glosses, apparatus, [(witness, walk.title_note)], walk.chapters


def parsed(documents: DataFrame, which: int, schema: str) -> DataFrame:
    """One kind of ``parse``'s rows of ``documents(witness, content)``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for witness, content in zip(pdf.witness, pdf.content):
                yield pd.DataFrame(parse(bytes(content), witness)[which], columns=names)

    return documents.select("witness", "content").mapInPandas(run, schema)


def _read(spark: SparkSession, path: str, which: int, schema: str) -> DataFrame:
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return parsed(spark.read.format("binaryFile").load(path).select(stem.alias("witness"), "content"), which, schema)


def read_tei(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 0, SEGMENTS)


def read_glosses(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 1, GLOSSES)


def read_apparatus(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 2, APPARATUS)


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """The note in each document's first title, or null."""
    return _read(spark, path, 3, TITLES)


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, 4, CHAPTERS)
