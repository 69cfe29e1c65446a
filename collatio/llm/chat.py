"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags.

A conversation becomes one string in which control strings mark the turns. Control strings
inside texts are escaped: wherever a control string would begin, one backslash is put after its
first character, and one more where backslashes are there already. Removing one backslash from
each such place is the exact inverse, so texts come back unchanged from the formatted string.
All steps are DataFrame expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """A turn is written ``open``, role, ``middle``, text, ``close``.

    Every control string begins with a character that occurs nowhere else in any of them, and
    holds no backslash. ``moves`` is the machine: state -> role -> next state; ``final`` are the
    states in which a conversation may end.
    """

    open: str = "<s>[INST] "
    middle: str = " [/INST]"
    close: str = "</s>"
    #: strings that must not occur unescaped in a text, ``first character -> rests``
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    loss_roles: tuple[str, ...] = ("assistant",)
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"}, "ready": {"user": "asked"}, "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def _pattern(self, slashes: str) -> str:
        by_first: dict[str, list[str]] = {}
        for c in self.controls:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        firsts = "".join("\\" + c for c in by_first)
        rests = "|".join(sorted({r for v in by_first.values() for r in v}))
        return rf"([{firsts}]){slashes}({rests})"

    @property
    def escape_pattern(self) -> str:
        return self._pattern(r"(\\*)")

    @property
    def unescape_pattern(self) -> str:
        return self._pattern(r"\\(\\*)")


def escape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(template.escape_pattern), F.lit(r"$1\\$2$3"))


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, F.lit(template.unescape_pattern), F.lit("$1$2$3"))


def _valid(turns: Column, template: Template) -> Column:
    """Whether the roles take the machine from ``start`` to a final state."""

    def step(state: Column, turn: Column) -> Column:
        out = F.lit("error")
        for at, roles in template.moves.items():
            for role, to in roles.items():
                out = F.when((state == at) & (turn["role"] == role), to).otherwise(out)
        return out

    return F.aggregate(turns, F.lit("start"), step).isin(*template.final)


def format_chats(
    df: DataFrame, template: Template | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``(conv, n_turns, valid, formatted, segments)``.

    ``segments`` is ``array<struct<text, loss>>`` in order; their texts joined are ``formatted``.
    Texts of ``loss_roles`` carry the flag, markers and other texts don't. Turns are ordered by
    (turn, role, text), nulls first, so ties and repeated rows have a defined order; repeated
    rows are turns of their own. Null role or text counts as empty. Rows with a null conversation
    are one conversation. Conversations whose roles break the machine are formatted all the same
    and have ``valid`` false. Other columns are ignored.

    One conversation's turns meet in one row, as its string must; that is the only gathering.
    """
    t = template or Template()
    rows = df.select(
        F.col(conv_col).alias("conv"),
        F.struct(
            F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    head = lambda x: F.concat(F.lit(t.open), escape(x["role"], t), F.lit(t.middle))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda x: F.array(
                F.struct(head(x).alias("text"), F.lit(False).alias("loss")),
                F.struct(escape(x["text"], t).alias("text"), x["role"].isin(*t.loss_roles).alias("loss")),
                F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    out = grouped.select("conv", F.size("turns").cast("long").alias("n_turns"), _valid(F.col("turns"), t).alias("valid"), segments.alias("segments"))
    return out.select(
        F.col("conv").alias(conv_col), "n_turns", "valid",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments",
    )


def parse_chat(formatted: Column, template: Template) -> Column:
    """``array<struct<role, text>>`` read back from a formatted string alone."""
    t = template
    pieces = F.split(formatted, re.escape(t.close))
    turns = F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0)))

    def read(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(t.open) + 1))
        at = F.instr(body, t.middle)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), t).alias("role"), unescape(F.substr(body, at + len(t.middle)), t).alias("text"))

    return F.transform(turns, read)


def digest(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of what ``format_chats`` returned: turns from the string, loss from the segments."""
    t = template or Template()
    read = chats.select(
        chats.columns[0], "formatted", "valid", parse_chat(F.col("formatted"), t).alias("turns"),
        F.filter("segments", lambda s: s["loss"]).alias("loss"),
    )
    loss = F.array_join(F.transform("loss", lambda s: unescape(s["text"], t)), "")
    turns = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        chats.columns[0],
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def oracle(template: Template | None = None, extra: str = "") -> str:
    """DuckDB SQL for ``digest(format_chats(conversations))``; ``extra``: rows to add, as a SELECT."""
    t = template or Template()
    source = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations" + (f" UNION ALL {extra}" if extra else "")
    escaped = lambda c: f"regexp_replace({c}, '{t.escape_pattern}', '\\1\\\\\\2\\3', 'g')"
    loss = " OR ".join(f"role = '{r}'" for r in t.loss_roles)
    # the default machine as an expression over the roles in order: [system] (user assistant)+
    return f"""
WITH c AS ({source}),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER ({loss}), '') AS loss,
  string_agg('{t.open}' || {escaped('role')} || '{t.middle}' || {escaped('text')} || '{t.close}', '' ORDER BY turn NULLS FIRST, role, text) AS formatted,
  string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, len(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, len(formatted)::BIGINT AS formatted_chars, regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid FROM g"""
