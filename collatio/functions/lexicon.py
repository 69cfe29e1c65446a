"""Anchors: keys of a multilingual lexicon found in a text, and transliteration density."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from collatio.functions import text as T


#: Stands for a marked character; no text has it.
MARK = "\0"


@dataclass(frozen=True)
class Term:
    key: str
    kind: str
    forms: dict[str, tuple[str, ...]]
    transliterated: bool = False


@dataclass(frozen=True)
class Lexicon:
    """Terms in order. Forms of a language are tried longest first, equal ones in term order."""

    terms: tuple[Term, ...]
    transliteration_chars: str = ""

    def anchors(self, text: Column, lang: str) -> Column:
        """Sorted ``kind:key`` of the terms found (a form's characters are found once), and ``num:n``."""
        forms = [(f, f"{t.kind}:{t.key}") for t in self.terms for f in sorted(t.forms.get(lang, ()), key=lambda f: -len(f)) if f]
        none = F.array().cast("array<string>")
        found = T.consume(T.sa_normalize(text) if lang == "sa" else text, forms, "string") if forms else none
        numbers = F.transform(T.numbers_in(text, F.lit(lang)), lambda n: F.concat(F.lit("num:"), n.cast("string")))
        return F.array_sort(F.array_distinct(F.concat(found, numbers)))

    def density(self, text: Column, lang: str) -> Column:
        """Share of transliterated characters (zh) or syllables (bo); 0 elsewhere.

        A Chinese character counts inside a transliterated term, and beside another one of the class:
        each term and the class mark the text by themselves, and what any of them marked counts once.
        """
        if lang == "bo":
            return T.bo_sanskrit_share(text)
        if lang != "zh":
            return F.lit(0.0)
        core = T.zh_strip(text)
        forms = sorted({f for t in self.terms if t.transliterated for f in t.forms.get("zh", ()) if f})
        marked = [F.replace(core, F.lit(f), F.lit(MARK * len(f))) for f in forms]
        if self.transliteration_chars:
            some = f"[{re.escape(''.join(sorted(set(self.transliteration_chars))))}]"
            marked.append(F.regexp_replace(core, f"{some}(?={some})|(?<={some}){some}", MARK))
        if not marked:
            return F.lit(0.0)
        letters = [F.split(m, "") for m in marked]
        whole = letters[0]
        for more in letters[1:]:
            whole = F.zip_with(whole, more, lambda a, b: F.when(b == MARK, b).otherwise(a))
        hits = F.size(F.filter(whole, lambda c: c == MARK))
        return F.when(F.length(core) > 0, hits / F.length(core)).otherwise(F.lit(0.0))

    def anchors_in(self, text: Column, lang: Column) -> Column:
        """``anchors`` by a column of languages."""
        return F.when(lang == "zh", self.anchors(text, "zh")).when(lang == "bo", self.anchors(text, "bo")).when(lang == "sa", self.anchors(text, "sa")).otherwise(F.array().cast("array<string>"))

    def density_in(self, text: Column, lang: Column) -> Column:
        """``density`` by a column of languages."""
        return F.when(lang == "zh", self.density(text, "zh")).when(lang == "bo", self.density(text, "bo")).otherwise(F.lit(0.0))
