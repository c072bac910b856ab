"""Chat formatting from an event log.

A conversation is a log of events (conv, message, twin, seq, kind, role, text): `message` begins a message or begins it
anew, `delta` adds to it (streamed output), `edit` replaces its text, `regenerate` empties it for new deltas. Messages go
by number; several of one number, told apart by `twin`, go by that. The log is dealt out by conversation and
message, so a conversation that holds a large part of all events is folded and rendered by many tasks; a task holds one
message at a time. Only `digests`, whose hashes are of all turns in order, deals turns out by conversation: its task
goes through them one by one and holds one.

The template marks a turn as START role NEWLINE text END NEWLINE. In roles and texts each backslash is
doubled, and each control string gets a backslash after its first character; a newline in a role
becomes backslash, control picture. Reading back undoes it, so a rendered log gives back every role and
text. The loss mask is the span of an assistant's text in its turn.

Null text or role: empty. Rows with a null conversation are one conversation. Null numbers come first; equal sequence
numbers of one message are taken in order of role and text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])}){re.escape(c[1:])}" for c in CONTROL))
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: "\\" + m[0], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\␊")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|␊?)", lambda m: {"␊": "\n"}.get(m[1], m[1]), role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text begins and ends if the loss counts it (else 0, 0), in code points."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return f"{head}{body}{END}\n", *span


def read_turn(turn: str) -> tuple[str, str]:
    role, _, text = turn.removeprefix(START).removesuffix(f"{END}\n").partition("\n")
    return unescape_role(role), unescape(text)


def formatted(events: DataFrame) -> DataFrame:
    """(conv, message, twin, role, turn, loss_from, loss_to) for each message.

    events: conv long, message long, seq long, kind string, role string, text string, and twin long, 0 where it is lacking.
    """
    if "twin" not in events.columns:
        events = events.withColumn("twin", F.lit(0).cast("long"))
    # a window needs a message's events together and in order; it deals nothing out anew that its input has so already
    place = F.row_number().over(Window.partitionBy("conv", "message").orderBy("twin", "seq", "role", "text"))
    ordered = events.withColumn("place", place).select("place", "conv", "message", "twin", "kind", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, text = None, "", []

        def out(rows):
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=["conv", "message", "twin", "role", "turn", "loss_from", "loss_to"])

        for batch in batches:
            rows = []
            for place, conv, message, twin, kind, r, t in zip(*(c.to_pylist() for c in batch.columns)):
                if place == 1 or now != (conv, message, twin):
                    if now:
                        rows.append((*now, role, *render(role, "".join(text))))
                    now, role, text = (conv, message, twin), r or "", []
                if r:
                    role = r
                if kind in ("message", "edit"):
                    text = [t or ""]
                elif kind == "regenerate":
                    text = []
                elif kind == "delta":
                    text.append(t or "")
                else:
                    raise ValueError(f"no such kind of event: {kind}")
            if rows:
                yield out(rows)
        if now:
            yield out([(*now, role, *render(role, "".join(text)))])

    return ordered.mapInArrow(run, "conv long, message long, twin long, role string, turn string, loss_from long, loss_to long")


def events_of(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of a table of turns; rows of equal turns are messages of their own, in order of role and text.

    By a hash of its place a turn comes whole, streamed in up to eight deltas, streamed after a draft of it was thrown
    away, or as a draft that an edit corrects.
    """
    said, at = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col(turn).cast("long")
    rows = rows.select(F.col(conv).cast("long").alias("conv"), at.alias("message"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), said.alias("said"))
    rows = rows.withColumn("twin", F.row_number().over(Window.partitionBy("conv", "message").orderBy("role", "said")).cast("long"))
    said, size = F.col("said"), F.length("said")
    none = F.lit(None).cast("string")
    event = lambda seq, kind, who, what: F.struct(F.lit(seq).cast("long").alias("seq") if isinstance(seq, int) else seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), who.alias("role"), what.alias("text"))
    begin = lambda what: F.array(event(0, "message", F.col("role"), what))
    piece = F.greatest(F.lit(16), F.ceil(size / 8).cast("int"))
    deltas = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / piece).cast("int")), lambda i: event(i + 2, "delta", none, F.substring(said, i * piece + 1, piece)))
    draft = F.concat(F.substring(said, F.lit(1), F.ceil(size / 2).cast("int")), F.lit(" ..."))
    way = F.pmod(F.xxhash64("conv", "message", "twin"), F.lit(4))
    events = (
        F.when(way == 0, begin(said))
        .when(way == 1, F.concat(begin(F.lit("")), deltas))
        .when(way == 2, F.concat(begin(draft), F.array(event(1, "regenerate", none, none)), deltas))
        .otherwise(F.concat(begin(draft), F.array(event(1, "edit", none, said))))
    )
    return rows.select("conv", "message", "twin", F.explode(events).alias("e")).select("conv", "message", "twin", "e.seq", "e.kind", "e.role", "e.text")


def digests(turns: DataFrame) -> DataFrame:
    """Read back, for each conversation: n_turns, hashes of all turns and of all text under the loss mask, and lengths.

    The rows come from `formatted`; hashes go on from turn to turn, nothing else is held. A hash of all turns is one
    chain, so a conversation is one task's, however long it is.
    """
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "message", "twin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class State:
            def __init__(self, conv):
                self.conv, self.n, self.loss, self.size = conv, 0, 0, 0
                self.turns, self.text = hashlib.sha256(), hashlib.sha256()

            def row(self):
                return self.conv, self.n, self.turns.hexdigest(), self.loss, self.text.hexdigest(), self.size

        def out(rows):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        now = None
        for batch in batches:
            rows = []
            for conv, turn, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "loss_from", "loss_to"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        rows.append(now.row())
                    now = State(conv)
                role, text = read_turn(turn)
                now.n += 1
                now.size += len(turn)
                now.turns.update(f"{role}\n{text}\n".encode())
                if b:
                    said = unescape(turn[a:b])
                    now.loss += len(said)
                    now.text.update(said.encode())
            if rows:
                yield out(rows)
        if now is not None:
            yield out([now.row()])

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
