"""Chat formatting (operator 4): a finite-state machine over roles and text segments with loss flags.

A declarative template says how a turn is marked and which roles are learnt.  Control strings within texts are escaped
with a backslash, which is itself escaped, so the formatted text reads back to the same turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import partitions


@dataclass(frozen=True)
class Template:
    """How a turn is written: opening, role, closing of the role, text, closing of the turn."""

    opening: str = "### "
    role_end: str = ": "
    closing: str = "</turn>\n"
    #: characters that are escaped within texts, so that none of the marks can begin there; in roles ':' is, too
    controls: tuple[str, ...] = ("#", "<")
    learnt: frozenset[str] = frozenset({"assistant"})
    #: state -> the roles that may come next; the state is the last role
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def escape(self, text: str, more: tuple[str, ...] = ()) -> str:
        text = text.replace("\\", "\\\\")
        for c in self.controls + more:
            text = text.replace(c, "\\" + c)
        return text

    def segments(self, role: str, text: str) -> tuple[str, str, str]:
        return f"{self.opening}{self.escape(role, (':',))}{self.role_end}", self.escape(text), self.closing

    def pattern(self) -> re.Pattern[str]:
        """A turn; it can't end before an unescaped closing, nor its role before an unescaped ':'."""
        held = lambda more: rf"((?:[^\\{re.escape(''.join(self.controls) + more)}]|\\.)*+)"
        return re.compile(re.escape(self.opening) + held(":") + re.escape(self.role_end) + held("") + re.escape(self.closing), re.DOTALL)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


SEGMENTS = "conv_id long, turn_no long, part int, text string, loss boolean, valid boolean"


def _format(batches: Iterable[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    conv, no, state, fresh = None, 0, "", True
    for batch in batches:
        out: list[tuple] = []
        for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
            if fresh or c != conv:
                conv, no, state, fresh = c, 0, "", False
            valid = role in template.follows.get(state, ())
            learnt = role in template.learnt
            out += [(c, no, k, x, learnt and k == 1, valid) for k, x in enumerate(template.segments(role, text))]
            no, state = no + 1, role
        columns = list(zip(*out, strict=True)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "turn_no", "part", "text", "loss", "valid"])


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of conversations(conv_id, turn, role, text), three a turn, in order within each partition.

    A turn is ``valid`` if the state machine allows its role after the one before it; turns that it doesn't allow are
    formatted too, so that callers may choose to drop their conversations.  Null roles and texts are empty strings, a
    null turn comes first, equal turns go by role and text, rows with a null conv_id are one conversation, and other
    columns are not read.  Turns stream through a task, so a conversation of any length needs little memory beyond
    its longest turn; its order binds it to one task.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    sorted_ = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.mapInArrow(partial(_format, template=template or Template()), SEGMENTS)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


class _Reader:
    """Reads a conversation's formatted text as it comes, whatever pieces it comes in; it holds one turn at a time."""

    def __init__(self, conv: int | None, pattern: re.Pattern[str]):
        self.conv, self.pattern = conv, pattern
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.loss_chars = self.size = 0
        self.valid = True
        self.text: list[str] = []
        self.learnt: list[tuple[int, int]] = []

    def add(self, text: str, flag: bool, valid: bool) -> None:
        if flag:
            self.learnt.append((self.size, self.size + len(text)))
        self.text.append(text)
        self.size, self.chars = self.size + len(text), self.chars + len(text)
        self.valid = self.valid and valid
        if "\n" in text:
            self.read()

    def read(self) -> None:
        joined, at = "".join(self.text), 0
        while found := self.pattern.match(joined, at):
            at = found.end()
            self.n += 1
            self.turns.update(f"{unescape(found[1])}\n{unescape(found[2])}\n".encode("utf-8", "surrogatepass"))
        # a learnt piece counts when the turn that it is in is complete
        for a, b in self.learnt:
            if b <= at:
                plain = unescape(joined[a:b])
                self.loss.update(plain.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(plain)
        self.learnt = [(a - at, b - at) for a, b in self.learnt if b > at]
        self.text, self.size = [joined[at:]], len(joined) - at

    def row(self) -> tuple:
        self.read()
        if self.size:
            raise ValueError(f"conversation {self.conv}, after {self.n} turns: the formatted text doesn't read back")
        return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid


def _read_back(batches: Iterable[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    pattern, reader = template.pattern(), None
    for batch in batches:
        done: list[tuple] = []
        for c, no, part, text, flag, ok in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if reader is None or no == 0 and part == 0:
                if reader is not None:
                    done.append(reader.row())
                reader = _Reader(c, pattern)
            reader.add(text, flag, ok)
        yield _backed(list(zip(*done, strict=True)) or [()] * 7)
    if reader is not None:
        yield _backed([[x] for x in reader.row()])


def _backed(columns: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in READ_BACK.split(", ")])


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation of format_conversations' segments, parsed from the formatted text: turns, their digest,
    and what is under the loss mask.  The segments must still be in their order."""
    return segments.mapInArrow(partial(_read_back, template=template or Template()), READ_BACK)
