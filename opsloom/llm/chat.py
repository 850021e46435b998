"""Chat formatting by incremental rendering of a black-box template."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import text_batches

Message = tuple[str, str]
Template = Callable[[Sequence[Message]], str]

# The control strings that open and close a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Two texts that begin and end with different characters, to find where a turn's text stands.
PROBES = ("\ue000", "\ue001")


def escape(text: str) -> str:
    """No control string is left: ``<|`` becomes ``<\\|``, and a backslash is doubled."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def chatml(messages: Sequence[Message]) -> str:
    """Every turn as marker, role, line end, text, marker, line end; roles and texts escaped, line ends in roles too."""
    return "".join(f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{CLOSE}\n" for role, text in messages)


def role_of(header: str) -> str:
    """The role in the part of a turn before its text, unescaped."""
    body = header.removeprefix(OPEN).removesuffix("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], body, flags=re.DOTALL)


@dataclass(frozen=True)
class Turn:
    """A turn in the output: its span, and the span of its text."""

    start: int
    end: int
    text_start: int
    text_end: int


@dataclass(frozen=True)
class Rendering:
    text: str
    turns: list[Turn]
    rewritten_at: list[int]  # turns whose rendering changed what stood before them


def _shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def render(messages: Sequence[Message], template: Template = chatml) -> Rendering:
    """Render every prefix of the turns and compare consecutive outputs.

    What a prefix adds to the one before is the span of its last turn. If it changes what
    the one before had, the template rewrites history: the turn is listed in
    ``rewritten_at``, its span begins at the first change, and the spans of earlier turns
    end there at the latest. Inside a turn, the text is found by rendering two probes in
    its place: they share all that stands before and after the text.
    """
    done: list[Message] = []
    before, turns, rewritten = template([]), [], []
    for k, (role, text) in enumerate(messages):
        now = template([*done, (role, text)])
        start = len(before)
        if not now.startswith(before):
            rewritten.append(k)
            start = _shared(before, now)
            turns = [Turn(*(min(x, start) for x in (t.start, t.end, t.text_start, t.text_end))) for t in turns]
        a, b = (template([*done, (role, probe)]) for probe in PROBES)
        head = start + _shared(a[start:], b[start:])
        tail = _shared(a[head:][::-1], b[head:][::-1])
        turns.append(Turn(start, len(now), head, max(head, len(now) - tail)))
        done.append((role, text))
        before = now
    return Rendering(before, turns, rewritten)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[Message]]]:
    """Conversations, one at a time, from rows sorted by conversation and turn."""
    key, held, some = None, [], False
    for batch in batches:
        ids, roles, texts = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))
        for conv, role, text in zip(ids, roles, texts, strict=True):
            if some and conv != key:
                yield key, held
                held = []
            key, some = conv, True
            held.append((role or "", text or ""))
    if some:
        yield key, held


def format_conversations(rows: DataFrame, template: Template = chatml, learn: Sequence[str] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, turns, loss, rewrites) per conversation.

    ``turns`` are (start, end, text_start, text_end) in code points of ``formatted``; ``loss``
    are the (start, end) of the texts of the roles in ``learn``; ``rewrites`` the turns at which
    the template changed what stood before.

    Rows of a conversation go by turn, then role, then text (null turns first); repeated
    rows are repeated turns. Null roles and texts are empty. Rows without conv_id are one
    conversation. Extra columns are not read. A conversation is rendered in one task, one
    at a time.
    """
    text_batches(rows.sparkSession)
    learn = frozenset(learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, messages in _groups(batches):
            r = render(messages, template)
            spans = [{"start": t.start, "end": t.end, "text_start": t.text_start, "text_end": t.text_end} for t in r.turns]
            loss = [{"start": t.text_start, "end": t.text_end} for t, m in zip(r.turns, messages, strict=True) if m[0] in learn]
            out.append({"conv_id": conv, "formatted": r.text, "turns": spans, "loss": loss, "rewrites": r.rewritten_at})
            size += len(r.text)
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, ARROW)
                out, size = [], 0
        yield pa.RecordBatch.from_pylist(out, ARROW)

    wanted = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = wanted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, SCHEMA)


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_TURN = pa.struct([(c, pa.int64()) for c in ("start", "end", "text_start", "text_end")])
ARROW = pa.schema(
    [("conv_id", pa.int64()), ("formatted", pa.string()), ("turns", pa.list_(_TURN)), ("loss", pa.list_(_SPAN)), ("rewrites", pa.list_(pa.int64()))]
)
SCHEMA = (
    "conv_id long, formatted string, turns array<struct<start:long,end:long,text_start:long,text_end:long>>, "
    "loss array<struct<start:long,end:long>>, rewrites array<long>"
)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns, loss_text, formatted_chars): roles and texts of a ChatML output, and the text under the loss mask, unescaped.

    ``turns`` is role, line end, text, line end for every turn.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for conv, text, turns, loss in zip(f.conv_id, f.formatted, f.turns, f.loss, strict=True):
                said = [f"{role_of(text[t['start'] : t['text_start']])}\n{unescape(text[t['text_start'] : t['text_end']])}\n" for t in turns]
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv, len(said), "".join(said), learnt, len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns", "loss_text", "formatted_chars"]).astype({"conv_id": "Int64"})

    return formatted.select("conv_id", "formatted", "turns", "loss").mapInPandas(run, "conv_id long, n_turns long, turns string, loss_text string, formatted_chars long")
