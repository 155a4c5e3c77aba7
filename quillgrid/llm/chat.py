"""Chat formatting with a reversible template, token-budgeted windows and a loss mask.

A turn is written ``### Role: text </turn>`` and a line end; within roles and
texts ``\\``, ``#`` and ``<`` are written behind a backslash, so no text holds a
control string and reading back gives every text as it was. Line ends and
colons of a role are escaped as well.

Windows are chosen by prefix sums of turn tokens: a window takes turns from
the first that no window has taken, as many as the budget holds beside the
system turn (the conversation's first system turn, repeated in every later
window) and a limited history (the last turns that fit ``history`` tokens,
repeated). Where the first new turn does not fit beside these, the oldest
history gives way, and the system turn only if the new turn fits without it.
Turns are never cut: one beyond the budget stands in a window that exceeds it,
beside nothing but the system turn. Targets are the assistant's texts; repeated ones are masked, so
each is learned once.

Turns are ordered by turn, role and text, and turns are read in a stream:
memory holds one window and its history, however long a conversation is. Null
texts and roles are empty; a null turn number comes first; null conv_ids form
one conversation; texts are read whole, however long. Repeated rows are turns like any other. An empty table
gives an empty result; columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUDGET, HISTORY = 1024, 256
HEAD, MIDDLE, TAIL = "### ", ": ", " </turn>\n"
TARGET, SYSTEM = "assistant", "system"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_PLAIN = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<:\n]")
_BACK = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\<])*) </turn>\n", re.DOTALL)


def escape(text: str, special: re.Pattern = _PLAIN) -> str:
    return special.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def count_tokens(text: str) -> int:
    return len(_TOKEN.findall(text))


class Windows:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int, count: Callable[[str], int]) -> None:
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple[str, str, int] | None = None
        self.new: list[tuple[str, str, int]] = []
        self.past: list[tuple[str, str, int]] = []
        self.repeat: list[tuple[str, str, int]] = []
        self.used = self.number = 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        n = self.count(text) + self.count(role) + 3
        if self.new and self.used + n > self.budget:
            yield self.close()
        # The first new turn of a window comes before what is repeated: the oldest history goes first, the system turn last.
        while not self.new and self.past and self.used + n > self.budget:
            self.used -= self.past.pop(0)[2]
            self.repeat = ([self.system] if self.system else []) + self.past
        if not self.new and self.repeat and self.used + n > self.budget >= n:
            self.used, self.repeat = 0, []
        self.new.append((role, text, n))
        self.used += n

    def close(self) -> tuple:
        """(window, n_repeated, n_tokens, formatted, spans) of what is held; then the next window begins."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for k, (role, text, _) in enumerate([*self.repeat, *self.new]):
            head = HEAD + escape(role, _ROLE) + MIDDLE
            body = escape(text)
            if k >= len(self.repeat) and role == TARGET:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts += (head, body, TAIL)
            at += len(head) + len(body) + len(TAIL)
        out = (self.number, len(self.repeat), self.used, "".join(parts), spans)
        if self.system is None:
            self.system = next((t for t in self.new if t[0] == SYSTEM), None)
        # Suffix sums of tokens bound the history; the system turn is counted on its own.
        past, total, kept = [*self.past, *self.new], 0, []
        for turn in reversed(past):
            if turn is self.system or total + turn[2] > self.history:
                break
            total += turn[2]
            kept.append(turn)
        self.past = kept[::-1]
        self.repeat = ([self.system] if self.system else []) + self.past
        self.used = sum(t[2] for t in self.repeat)
        self.new = []
        self.number += 1
        return out


SCHEMA = "conv_id long, window int, n_repeated int, n_tokens int, formatted string, loss array<struct<start:int,end:int>>"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int32()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """One row a window, in order within a partition. ``count`` gives the tokens of a text; the default counts words and marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows, rows, size = None, None, [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if windows is None or conv != now:
                    if windows is not None:
                        rows.append((now, *windows.close()))
                    now, windows = conv, Windows(budget, history, count)
                rows += ((conv, *w) for w in windows.add(role or "", text or ""))
                size += len(text or "")
                if size > 1 << 22:
                    yield packed()
                    rows, size = [], 0
        if windows is not None:
            rows.append((now, *windows.close()))
        yield packed()

    named = turns.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.col("turn").cast("long"))
    return named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(work, SCHEMA)


def read_window(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a window."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """Conversations as read from ``format_windows``' rows: counts and digests of turns and targets.

    Windows may come in any order, as from a table; ``in_order`` says that they
    are as ``format_windows`` gives them, which spares a shuffle.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None
        rows: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["window"] == 0:
                    if state:
                        rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
                    state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_window(row["formatted"])[row["n_repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in row["loss"]:
                    text = unescape(row["formatted"][span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(row["formatted"])
        if state:
            rows.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        cols = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return windows.mapInArrow(work, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
