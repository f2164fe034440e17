"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment.

The template marks each turn; control strings inside texts and roles are escaped
so that the formatted text can be read back exactly.  Rows of a conversation are
taken in the order (turn, role, text) and streamed: a task holds one turn at a
time, however long the conversation.

Defined cases: a null text or role is empty; a null turn comes first; null
conversation ids form one conversation; equal rows are all kept; a turn that the
machine does not allow is still formatted, with ``ok`` false; an empty table
gives no segments; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "start", "end"


@dataclass(frozen=True)
class Template:
    """Declarative format: what surrounds a turn, which roles are learned, who may follow whom."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>"
    between: str = "\n"
    learned: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}),
        "system": frozenset({"user"}),
        "user": frozenset({"assistant"}),
        "assistant": frozenset({"user", END}),
    })


def escape(s: str) -> str:
    """No control string (they all hold ``<|``) can appear in the result."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return "\\".join(p.replace("<\\|", "<|") for p in s.split("\\\\"))


def escape_role(s: str) -> str:
    return escape(s).replace("\n", "\\n")


def unescape_role(s: str) -> str:
    return "\\".join(p.replace("<\\|", "<|").replace("\\n", "\n") for p in s.split("\\\\"))


SEGMENTS = "conv_id {id}, seg_no long, turn_no long, role string, text string, loss boolean, ok boolean"


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments ``(conv_id, seg_no, turn_no, role, text, loss, ok)`` of all conversations.

    The texts of a conversation, joined by seg_no, are its formatted form.  Each
    turn gives a head, a body and a tail; a last empty segment (role ``end``)
    says whether the conversation may end where it does.
    """
    t = template or Template()
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                     F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, seg, turn = None, None, 0, 0  # state None: nothing open
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            out = []
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text")), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        out.append((conv, seg, turn, END, "", False, END in t.follows.get(state, ())))
                    conv, state, seg, turn = c, START, 0, 0
                ok = role in t.follows.get(state, ())
                state = role
                parts = ((t.before_role + escape_role(role) + t.after_role, False), (escape(text), role in t.learned),
                         (t.after_text + t.between, False))
                for part, loss in parts:
                    out.append((conv, seg, turn, role, part, loss, ok))
                    seg += 1
                turn += 1
            yield _table(out, id_type)
        if state is not None:
            yield _table([(conv, seg, turn, END, "", False, END in t.follows.get(state, ()))], id_type)

    return rows.mapInArrow(run, SEGMENTS.format(id=kind))


def _table(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
    names = ["conv_id", "seg_no", "turn_no", "role", "text", "loss", "ok"]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


DIGESTS = ("conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long, valid boolean")


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Digests of each conversation, parsed from the formatted text alone."""
    t = template or Template()
    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = (segments.select("conv_id", "seg_no", "text", "loss", "ok")
            .repartition("conv_id").sortWithinPartitions("conv_id", "seg_no"))

    def turn_of(piece: str) -> tuple[str, str]:
        head, _, body = piece.removeprefix(t.before_role).partition(t.after_role)
        return unescape_role(head), unescape(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, open_, id_type = None, False, None
        buffer, n, chars, loss_chars, valid, all_turns, learned = "", 0, 0, 0, True, hashlib.sha256(), hashlib.sha256()
        stop = t.after_text + t.between

        def row() -> tuple:
            return conv, n, all_turns.hexdigest(), loss_chars, learned.hexdigest(), chars, valid

        for batch in batches:
            id_type, out = batch.schema.field("conv_id").type, []
            columns = (batch.column(k).to_pylist() for k in ("conv_id", "text", "loss", "ok"))
            for c, text, loss, ok in zip(*columns, strict=True):
                if not open_ or c != conv:
                    if open_:
                        out.append(row())
                    conv, open_, buffer, n, chars, loss_chars, valid = c, True, "", 0, 0, 0, True
                    all_turns, learned = hashlib.sha256(), hashlib.sha256()
                chars += len(text)
                valid = valid and ok
                if loss:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    learned.update(plain.encode())
                buffer += text
                while (at := buffer.find(stop)) >= 0:
                    role, body = turn_of(buffer[:at])
                    buffer = buffer[at + len(stop):]
                    all_turns.update(f"{role}\n{body}\n".encode())
                    n += 1
            yield _digests(out, id_type)
        if open_:
            yield _digests([row()], id_type)

    return rows.mapInArrow(run, DIGESTS.format(id=kind))


def _digests(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
