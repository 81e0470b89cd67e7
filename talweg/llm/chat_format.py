"""Chat formatting by incremental rendering of a black-box template.

``render(turns)`` is any function from a list of (role, text) to a string. The turns of a
conversation are rendered prefix by prefix; where the earlier output is a prefix of the
later one, the rest is the new turn's span, and where it is not, the template has
rewritten history. A second rendering with a marker for the turn's text splits its span
into header, text and footer.

Rows are dealt by conversation, sorted by turn, and streamed. Each prefix is rendered in
full, however long: the template may look at any turn. A task then holds one conversation
and its output, and the work grows with the square of its turns. A template whose output
for a turn depends on that turn and the few before it alone may say so with a true
attribute ``turn_local``: from ``WHOLE`` turns on, its turns are rendered after their last
``CONTEXT`` turns and, as a check, after twice as many, and both must agree or the turn
counts as rewritten; a task then holds one window of turns.

Defined cases: a null text or role is an empty string; null conv_ids form one conversation;
equal turn numbers are ordered by role, then text; repeated rows are turns of their own; an
empty table gives no rows; other columns are ignored, whatever their names; very long texts
are rendered whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
MARK = "\ue000text\ue000"
WHOLE, CONTEXT = 32, 4

# The template's control strings: fixed values.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """text in which no control string occurs; unescape() gives it back."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_turn(role: str, text: str) -> str:
    if role == "user":
        return f"<s>[INST] {escape(text)} [/INST]"
    if role == "assistant":
        return f" {escape(text)} </s>"
    return f"<s>[ROLE] {escape(role)} [/ROLE] {escape(text)} </s>"


def inst_template(turns: list[Turn]) -> str:
    """User turns between [INST] marks, assistant turns up to </s>, others with their role named."""
    return "".join(render_turn(r, t) for r, t in turns)


inst_template.turn_local = True  # a turn is rendered by itself

_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>", re.DOTALL)


def parse(output: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of inst_template's output."""
    at = 0
    while at < len(output):
        m = _TURN.match(output, at)
        if m is None:
            raise ValueError(f"not a formatted conversation at character {at}")
        kind = "other" if m["role"] is not None else "user" if m["user"] is not None else "assistant"
        yield unescape(m["role"]) if kind == "other" else kind, unescape(m[kind]), m.start(kind), m.end(kind)
        at = m.end()


class Incremental:
    """Spans of successive turns of one conversation under a black-box template; the short context is for a template that is declared ``turn_local``."""

    def __init__(self, render: Callable[[list[Turn]], str], whole: int = WHOLE, context: int = CONTEXT):
        self.render, self.whole, self.context = render, whole, context
        self.local = getattr(render, "turn_local", False)
        self.turns: list[Turn] = []
        self.output, self.count = "", 0

    def add(self, turn: Turn) -> tuple[str, int, int, bool]:
        """The turn's span of output, where its text starts and ends in it, and whether history was rewritten.

        The span is what follows the earlier output, or, where that was rewritten, what follows the part of it that still stands.
        """
        short = not self.local or self.count < self.whole
        before = self.turns if short else self.turns[-self.context :]
        old = self.output if short else self.render(before)
        new = self.render([*before, turn])
        rewritten = not new.startswith(old)
        keep = len(os.path.commonprefix([old, new])) if rewritten else len(old)
        span = new[keep:]
        if not short and not rewritten:  # the same after twice as many turns
            longer = self.render(self.turns)
            rewritten = self.render([*self.turns, turn]) != longer + span
        marked = self.render([*before, (turn[0], MARK)])
        head, found, foot = (marked[keep:] if marked[:keep] == new[:keep] else "").partition(MARK)
        a, b = (len(head), len(span) - len(foot)) if found and span.startswith(head) and span.endswith(foot) and len(head) + len(foot) <= len(span) else (0, len(span))
        self.output = new if short else ""
        self.count += 1
        self.turns.append(turn)
        if self.local and self.count >= self.whole:
            del self.turns[: -2 * self.context]
        return span, a, b, rewritten


def turn_spans(conversations: DataFrame, render: Callable[[list[Turn]], str] = inst_template, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row for each turn, in order: conv_id, position, role, span (its piece of the output), text_start, text_end (of its text in the span), under_loss, rewritten."""
    schema = "conv_id long, position long, role string, span string, text_start long, text_end long, under_loss boolean, rewritten boolean"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def spans(batches):
        key, state = object(), None
        for b in batches:
            for a in range(0, b.num_rows, 1000):
                out = []
                part = b.slice(a, 1000)
                for conv, role, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if conv != key or state is None:
                        key, state = conv, Incremental(render)
                    span, start, end, rewritten = state.add((role, text))
                    out.append((conv, state.count - 1, role, span, start, end, role in trained, rewritten))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return _by_turn(conversations).select("conv_id", "role", "text").mapInArrow(spans, schema)


def _by_turn(conversations: DataFrame) -> DataFrame:
    """Conversations' rows, each conversation in one partition and sorted by turn."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from each conversation's formatted output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_rewritten.

    The spans come from turn_spans' method and are parsed again, so the roles and texts
    here have been through the template, its escapes and its loss mask.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_rewritten"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def read(batches):
        key, row, done = object(), None, []

        def close():
            if row is not None:
                done.append((key, row["n"], row["turns"].hexdigest(), row["chars"], row["loss"].hexdigest(), row["out"], row["rewritten"]))

        for b in batches:
            for a in range(0, b.num_rows, 1000):
                part = b.slice(a, 1000)
                for conv, role, text in zip(*(part.column(k).to_pylist() for k in range(3))):
                    if row is None or conv != key:
                        close()
                        key, state = conv, Incremental(inst_template)
                        row = {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "out": 0, "rewritten": 0}
                    span, start, end, rewritten = state.add((role, text))
                    if role == "assistant":
                        masked = unescape(span[start:end])
                        row["chars"] += len(masked)
                        row["loss"].update(masked.encode())
                    for r, t, _, _ in parse(span):
                        row["n"] += 1
                        row["turns"].update(f"{r}\n{t}\n".encode())
                    row["out"] += len(span)
                    row["rewritten"] += rewritten
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names)
                    done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names)

    return _by_turn(conversations).select("conv_id", "role", "text").mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_rewritten long")


def formatted(conversations: DataFrame, render: Callable[[list[Turn]], str] = inst_template) -> DataFrame:
    """(conv_id, position, span): the formatted texts as their successive pieces; joined by position they are the output."""
    return turn_spans(conversations, render).select("conv_id", "position", "span")
