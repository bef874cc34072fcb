"""Chat formatting: turn-aligned windows within a token budget, with limited history and loss masks."""

from __future__ import annotations

import hashlib
import os
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordkit as W
from .store import tasks_for, whole_ids
from .wordkit import column

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(\\\\*){re.escape(c[1:])}" for c in CONTROL))
_GUARDED = re.compile("|".join(f"{re.escape(c[0])}(\\\\+){re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """Puts a backslash after the first character of each control string, and of each that already has some."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _GUARDED.sub(lambda m: m[0][0] + m[0][2:], text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text stands in it."""
    body = escape(text)
    head, tail = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}.get(role, (f"[ROLE]{escape(role)}[/ROLE]", "</s>"))
    return head + body + tail, len(head), len(head) + len(body)


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """The turns of formatted text."""
    at = 0
    while at < len(text):
        for role, head, tail in (("user", "<s>[INST] ", " [/INST]"), ("system", "<<SYS>>\n", "\n<</SYS>>\n\n"), ("", "[ROLE]", "</s>"), ("assistant", " ", " </s>")):
            if text.startswith(head, at):
                at += len(head)
                if not role:
                    end = text.index("[/ROLE]", at)
                    role, at = unescape(text[at:end]), end + len("[/ROLE]")
                end = text.index(tail, at)
                yield role, unescape(text[at:end])
                at = end + len(tail)
                break
        else:
            raise ValueError(f"no turn begins at {at}")


_tokenizers: dict[str, object] = {}


def _lengths(texts: list[str], path: str | None) -> list[int]:
    """Token counts by a tokenizer file; without one, words."""
    if path is None:
        return [len(t.split()) for t in texts]
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _tokenizers[path].encode_special_tokens = True
    return [len(e) for e in _tokenizers[path].encode_batch_fast(texts, add_special_tokens=False)]


@dataclass
class _Turn:
    role: str
    text: str
    size: int


@dataclass
class _Conversation:
    """The windows of one conversation as its turns come: no more of it is held than a window and its history."""

    budget: int
    history: int
    system: _Turn | None = None
    past: deque = field(default_factory=deque)
    new: list = field(default_factory=list)
    repeated: list = field(default_factory=list)
    total: int = 0  # prefix sum of tokens, up to the last turn
    start: int = 0  # the same, where this window's new turns begin
    window: int = 0
    turns: int = 0

    def add(self, turn: _Turn) -> Iterator[tuple]:
        if self.new and sum(t.size for t in self.repeated) + self.total - self.start + turn.size > self.budget:
            yield self.close()
            self._begin(turn.size)
        self.new.append(turn)
        self.total += turn.size
        self.turns += 1

    def _begin(self, coming: int) -> None:
        kept = [self.system] if self.system and self.system.size + coming <= self.budget else []
        room = min(self.history, self.budget - coming - sum(t.size for t in kept))
        back: list = []
        for t in reversed(self.past):
            if t.size > room:
                break
            back.append(t)
            room -= t.size
        self.repeated, self.start = kept + back[::-1], self.total

    def close(self) -> tuple:
        text, loss, at = [], [], 0
        for n, t in enumerate([*self.repeated, *self.new]):
            s, lo, hi = formatted(t.role, t.text)
            if t.role == "assistant" and n >= len(self.repeated):
                loss.append({"start": at + lo, "end": at + hi})
            text.append(s)
            at += len(s)
        row = (self.window, self.turns - len(self.new), len(self.new), len(self.repeated), sum(t.size for t in self.repeated) + self.total - self.start, "".join(text), loss)
        if self.window == 0 and self.new and self.new[0].role == "system":
            self.system = self.new[0]
        for t in self.new:
            if t is not self.system:
                self.past.append(t)
        held = sum(t.size for t in self.past)
        while self.past and held > self.history:
            held -= self.past.popleft().size
        self.window, self.new = self.window + 1, []
        return row


_KIND = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_new", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SCHEMA = "conv_id long, window long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def _windows(budget: int, history: int, tokenizer: str | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, talk, out = None, None, []
        for b in batches:
            ids, roles, texts = b.column(b.schema.get_field_index("conv_id")).to_pylist(), column(b, "role").to_pylist(), column(b, "text").to_pylist()
            for lo in range(0, len(ids), 500):
                cut = slice(lo, lo + 500)
                sizes = _lengths([formatted(r, t)[0] for r, t in zip(roles[cut], texts[cut], strict=True)], tokenizer)
                for i, r, t, n in zip(ids[cut], roles[cut], texts[cut], sizes, strict=True):
                    if talk is None or i != now:
                        if talk is not None:
                            out.append((now, *talk.close()))
                        now, talk = i, _Conversation(budget, history)
                    out += [(now, *w) for w in talk.add(_Turn(r, t, n))]
                yield _batch(out)
                out = []
        if talk is not None:
            yield _batch([(now, *talk.close())])

    return W.tidy(run)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_KIND)], schema=_KIND)


def chat_windows(turns: DataFrame, budget: int = 1024, history: int = 256, tokenizer: str | None = None) -> DataFrame:
    """Windows of conversations: conv_id, window, first_turn, n_new, n_repeated, n_tokens, text and loss.

    turns has conv_id, turn, role and text. Prefix sums of turn tokens cut a conversation into spans of whole turns within
    the budget; a longer turn is a window alone. Later windows repeat a leading system turn and the last whole turns
    within the history budget, where they fit. loss marks, in code points of text, what assistants say in new turns only.

    Turns are ordered by turn, then role and text (nulls first); null roles and texts are empty; equal rows are turns of
    their own; a null conv_id is one conversation; no rows, no windows. Conversations are sorted and read as a stream, so
    a task holds a window and its history of one, whatever its length. Other columns are not read.
    """
    whole_ids(turns, "conv_id")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    dealt = rows.repartition(tasks_for(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_windows(budget, history, tokenizer), SCHEMA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
    now, state, out = None, None, []
    done = lambda: (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
    for b in batches:
        get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
        for i, text, loss, repeated in zip(get("conv_id"), get("text"), get("loss"), get("n_repeated"), strict=True):
            if state is None or i != now:
                if state is not None:
                    out.append(done())
                now, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for n, (role, said) in enumerate(parsed(text)):
                if n >= repeated:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(text)
        yield made(out)
        out = []
    if state is not None:
        yield made([done()])


def digests(windows: DataFrame) -> DataFrame:
    """What windows say, by conversation, read back from their texts and masks: counts and digests of turns and loss."""
    rows = windows.select("conv_id", "window", "text", "loss", "n_repeated")
    dealt = rows.repartition(tasks_for(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(W.tidy(_digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
