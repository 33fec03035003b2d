"""Chat formatting by a role automaton and a declarative template (operator 2).

Rows of a conversation are read in turn order in one streamed pass a partition: a conversation of any
length needs no more memory than a turn. An automaton over roles checks turn order (turns out of
order are formatted and marked, not dropped). A turn becomes three segments, header, text and end,
each with its loss flag from the template. Control strings inside texts and roles are escaped with a
backslash code, so no text can open or close a turn and the reader gets every text back.

Defined results: null texts and roles are empty; a null turn sorts first; equal turns are ordered by
role and text; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    header: str = "### {role}: "
    end: str = "</turn>\n"
    names: dict = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss_roles: frozenset = frozenset({"assistant"})
    #: state -> role -> state; a role without an arc is out of order and leads to the state its role has in ``after``.
    arcs: dict = field(
        default_factory=lambda: {
            "start": {"system": "ready", "user": "asked"},
            "ready": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    after: dict = field(default_factory=lambda: {"system": "ready", "user": "asked", "assistant": "answered"})
    #: what texts must not hold, with the code letter that stands for it behind a backslash
    codes: dict = field(default_factory=lambda: {"\\": "\\", "###": "h", "</turn>": "e"})

    def escape(self, text: str) -> str:
        for plain, code in self.codes.items():  # the backslash itself comes first
            text = text.replace(plain, "\\" + code)
        return text

    def unescape(self, text: str) -> str:
        back = {code: plain for plain, code in self.codes.items()} | {"c": ":"}
        return re.sub(r"\\(.)", lambda m: back[m[1]], text, flags=re.S)

    def open(self, role: str) -> str:
        name = self.names.get(role)
        return self.header.format(role=name if name is not None else "=" + self.escape(role).replace(":", "\\c"))

    def step(self, state: str, role: str) -> tuple[str, bool]:
        to = self.arcs.get(state, {}).get(role)
        return (to, True) if to else (self.after.get(role, state), False)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.open(role), False), (self.escape(text), role in self.loss_roles), (self.end, False)]


SEGMENTS = "conv_id long, turn_no long, segment_no long, segment string, loss boolean, in_order boolean"


def format_conversations(
    turns: DataFrame, template: Template = Template(), conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row a segment; segments of a conversation follow each other within a partition."""
    rows = turns.selectExpr(
        f"cast(`{conversation}` as long) as c", f"cast(`{turn}` as long) as n",
        f"coalesce(cast(`{role}` as string), '') as r", f"coalesce(cast(`{text}` as string), '') as t",
    )
    rows = rows.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def run(batches):
        now, state, turn_no, first = None, "start", 0, True
        for batch in batches:
            out = ([], [], [], [], [], [])
            for c, r, t in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if first or c != now:
                    now, state, turn_no, first = c, "start", 0, False
                state, fits = template.step(state, r)
                for k, (segment, loss) in enumerate(template.segments(r, t)):
                    for column, item in zip(out, (c, turn_no, k, segment, loss, fits)):
                        column.append(item)
                turn_no += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            names = ["conv_id", "turn_no", "segment_no", "segment", "loss", "in_order"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return rows.mapInArrow(run, SEGMENTS)


class Reader:
    """Reads formatted text back, piece by piece: turns with role and text, and all text under the loss mask."""

    def __init__(self, template: Template):
        head, tail = map(re.escape, template.header.split("{role}"))
        self.turn = re.compile(f"{head}((?:[^:\\\\]|\\\\.)*){tail}(.*)", re.S)
        self.template, self.names = template, {v: k for k, v in template.names.items()}
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0
        self.in_order, self.pending = True, ""

    def feed(self, segment: str, loss: bool, in_order: bool) -> None:
        self.chars += len(segment)
        self.in_order &= in_order
        if loss:
            plain = self.template.unescape(segment)
            self.loss_chars += len(plain)
            self.masked.update(plain.encode())
        self.pending += segment
        while (cut := self.pending.find(self.template.end)) >= 0:
            name, text = self.turn.fullmatch(self.pending[:cut]).groups()
            role = self.names[name] if name in self.names else self.template.unescape(name[1:])
            self.turns.update(f"{role}\n{self.template.unescape(text)}\n".encode())
            self.n_turns += 1
            self.pending = self.pending[cut + len(self.template.end) :]


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """One row a conversation with digests of what the formatted text says; needs no shuffle after formatting."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"

    def run(batches):
        now, reader = None, None

        def row():
            values = (now, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.masked.hexdigest(), reader.chars, reader.in_order)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=[c.split()[0] for c in schema.split(", ")])

        for batch in batches:
            done = []
            for c, segment, loss, in_order in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5))):
                if reader is None or c != now:
                    if reader is not None:
                        done.append(row())
                    now, reader = c, Reader(template)
                reader.feed(segment, loss, in_order)
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if reader is not None:
            yield row()

    return segments.mapInArrow(run, schema)


#: The conversation that the query's contract adds (fixed values).
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select -7L as conv_id, id as turn, if(id = 0, 'user', 'assistant') as role, '' as text from range(2)")
    return read_back(format_conversations(turns.union(extra.withColumn("text", F.lit(CONTROL_TEXT)))))
