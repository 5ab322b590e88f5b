r"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "<|im_start|>" role LF body "<|im_end|>" LF

A marker with an odd number of backslashes before it is text; each pair of those backslashes is one, and
the odd one goes. With an even number it is a marker, and each pair is one backslash of the text before it.
In a role, \\ is a backslash and \n a line feed. Rendering writes every turn as it is, reparses, compares
the recovered turns with the source, and escapes the turns that came back otherwise, until all are alike;
text that the grammar doesn't take for something else thus stays untouched.

Turns are ordered by number, then role, then text; repeated turns all stay, null numbers come first. Null
roles and texts are rendered as empty ones. Turns of a null conversation id are one conversation. A table
without rows gives none; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import col, extended

START, END = "<|im_start|>", "<|im_end|>"
_MARK = re.compile(r"(\\*)(<\|im_(?:start|end)\|>)")
_TAIL = re.compile(r"\\+\Z")
_ROLE = re.compile(r"\\([\\n])")


class ParseError(ValueError):
    """The text is not a conversation of the grammar."""


def _escaped(role: str, body: str) -> tuple[str, str]:
    body = _MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], body)
    return role.replace("\\", "\\\\").replace("\n", "\\n"), _TAIL.sub(lambda m: m[0] * 2, body)


def render(turns: list[tuple[str, str]], escape: set[int] | frozenset[int] = frozenset()) -> str:
    out = []
    for i, (role, body) in enumerate(turns):
        if i in escape:
            role, body = _escaped(role, body)
        out.append(f"{START}{role}\n{body}{END}\n")
    return "".join(out)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, in one pass from left to right."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ParseError(f"no turn begins at {at}")
        head = at + len(START)
        line = text.find("\n", head)
        if line < 0:
            raise ParseError(f"the turn at {at} has no line feed after its role")
        role = _ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", text[head:line])
        parts, seen = [], line + 1
        for m in _MARK.finditer(text, line + 1):
            parts += text[seen : m.start()], "\\" * (len(m[1]) // 2)
            seen = m.end()
            if len(m[1]) % 2:
                parts.append(m[2])
            elif m[2] == END:
                break
            else:
                raise ParseError(f"a turn begins at {m.start(2)}, in another")
        else:
            raise ParseError(f"the turn at {at} has no end")
        if not text.startswith("\n", seen):
            raise ParseError(f"no line feed at {seen}")
        turns.append((role, "".join(parts)))
        at = seen + 1
    return turns


def _recovered(turns: list[tuple[str, str]], escape: set[int]) -> bool:
    try:
        return parse(render(turns, escape)) == turns
    except ParseError:
        return False


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """(text, indices of the escaped turns), verified: parse(text) == turns."""
    escape: set[int] = set()
    while not _recovered(turns, escape):
        wrong = {i for i, turn in enumerate(turns) if i not in escape and not _recovered([turn], set())}
        if not wrong:
            raise ParseError("the grammar cannot hold these turns")
        escape |= wrong
    return render(turns, escape), sorted(escape)


def format_chats(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_escaped, text), a row for each conversation."""
    turn = F.struct(col(turn_col).alias("turn"), F.coalesce(col(role_col), F.lit("")).alias("role"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    chats = df.groupBy(col(id_col).alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))
    out = extended(chats.select("conv_id").schema, "n_turns int, n_escaped int, text string")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(len(r), *format_turns(list(zip(r, t)))) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.int32()), pa.array([len(d[2]) for d in done], pa.int32()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "n_turns", "n_escaped", "text"])

    return chats.mapInArrow(formatted, out)
