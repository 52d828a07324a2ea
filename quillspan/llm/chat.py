"""Chat formatting in budgeted windows of whole turns.

A conversation's turns are laid out between control strings, which texts and roles can't forge: what
looks like one inside them is escaped, reversibly. Prefix sums of the turns' tokens choose how many
whole turns a window takes. Every window opens with the leading system turn and the last turns before
it, as far as `history` tokens go; those repeats are context, so that each assistant text is under the
loss mask once, in its first window. Turns are streamed in order: besides its system turn and history,
one window of a conversation is held at a time, however long the conversation is.

A null text or role is empty; turns with the same number go by role and text; null turn numbers come
first, null conversation ids form one conversation; repeated rows are turns of their own; a turn
longer than the budget gets a window of its own (`n_tokens` then exceeds it); an empty table gives an
empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_frames, framed
from .tokens import TOKENIZER, encoder, tokenizer_path

BUDGET = 2048
HISTORY = 256
START, END = "<|im_start|>", "<|im_end|>"
#: Strings that no text may hold as they are: those of this template and of other common ones.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n((?s:.*?))" + re.escape(END) + "\n")
WINDOW_COLUMNS = ["key", "window", "text", "loss_start", "loss_end", "n_context", "n_turns", "n_tokens"]


def escape(text: str) -> str:
    """Double each backslash, and put one inside each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """As escape, on one line."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


class Turn:
    __slots__ = ("head", "body", "target", "cost", "system")

    def __init__(self, role: str, text: str, cost: int):
        self.head, self.body = f"{START}{escape_role(role)}\n", escape(text)
        self.target, self.system, self.cost = role == "assistant", role == "system", cost


class Windows:
    """The windows of one conversation, as its turns come in."""

    def __init__(self, key: object, budget: int, history: int):
        self.key, self.budget, self.limit = key, budget, history
        self.system: Turn | None = None
        self.past: deque[Turn] = deque()
        self.new: list[Turn] = []
        self.prefix = [0]  # prefix sums of the new turns' tokens
        self.number = self.seen = 0

    def context(self, cost: int) -> list[Turn]:
        """The repeated turns before new turns of which the first costs this much."""
        if not self.number:
            return []
        kept = [self.system] if self.system else []
        room = min(self.limit, self.budget - cost - sum(t.cost for t in kept))
        past = list(self.past)
        sums = np.cumsum([t.cost for t in reversed(past)])
        n = int(np.searchsorted(sums, room, side="right"))
        return kept + past[len(past) - n :]

    def add(self, turn: Turn) -> Iterator[tuple]:
        if self.new and sum(t.cost for t in self.context(self.new[0].cost)) + self.prefix[-1] + turn.cost > self.budget:
            yield self.close()
        if not self.seen and turn.system:
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        self.prefix.append(self.prefix[-1] + turn.cost)

    def close(self) -> tuple:
        """The row of the window that is open."""
        context, starts, ends, parts, at = self.context(self.new[0].cost), [], [], [], 0
        for k, turn in enumerate(context + self.new):
            if turn.target and k >= len(context):
                starts.append(at + len(turn.head))
                ends.append(at + len(turn.head) + len(turn.body))
            parts += (turn.head, turn.body, END, "\n")
            at += len(turn.head) + len(turn.body) + len(END) + 1
        row = (self.key, self.number, "".join(parts), starts, ends, len(context), len(self.new), sum(t.cost for t in context) + self.prefix[-1])
        self.past.extend(t for t in self.new if t is not self.system)
        while self.past and sum(t.cost for t in self.past) > self.limit:
            self.past.popleft()
        self.new, self.prefix, self.number = [], [0], self.number + 1
        return row


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """A row for each window: key, window (its number), text, loss_start and loss_end (code points of the
    spans under the loss mask), n_context (repeated turns at its start), n_turns (new ones), n_tokens."""
    path = tokenizer_path(tokenizer)
    rows = df.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "turn", "role", "text").select("key", "role", "text")

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, marks, open_ = encoder(path).encode, {}, None
        for block in blocks(frames):
            out = []
            roles, texts = block["role"].tolist(), block["text"].tolist()
            for r in set(roles) - marks.keys():
                marks[r] = len(encode([f"{START}{escape_role(r)}\n{END}\n"])[0])
            costs = [len(ids) for ids in encode([escape(t) for t in texts])]
            for key_, r, t, cost in zip(block["key"].tolist(), roles, texts, costs, strict=True):
                key_ = None if key_ is pd.NA else key_
                if open_ is None or open_.key != key_:
                    if open_ is not None:
                        out.append(open_.close())
                    open_ = Windows(key_, budget, history)
                out += open_.add(Turn(r, t, cost + marks[r]))
            yield framed(out, WINDOW_COLUMNS)
        if open_ is not None:
            yield framed([open_.close()], WINDOW_COLUMNS)

    kind = df.schema[key].dataType.simpleString()
    made = by_frames(ordered, windows, f"key {kind}, window long, text string, loss_start array<long>, loss_end array<long>, n_context long, n_turns long, n_tokens long")
    return made.withColumnRenamed("key", key)


def read_window(text: str) -> list[tuple[str, str]]:
    """(role, text) of a window's turns; an error where it isn't wholly made of turns."""
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        found.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("a window isn't made of turns alone")
    return found


def digest_windows(windows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Read the windows back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation."""
    columns = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    ordered = windows.select(F.col(key).alias("key"), "window", "text", "loss_start", "loss_end", "n_context").repartition("key").sortWithinPartitions("key", "window")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: list | None = None

        def row() -> tuple:
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for frame in frames:
            out = []
            for key_, text, starts, ends, n_context in zip(frame["key"].tolist(), frame["text"], frame["loss_start"], frame["loss_end"], frame["n_context"].tolist(), strict=True):
                key_ = None if key_ is pd.NA else key_
                if state is None or state[0] != key_:
                    if state is not None:
                        out.append(row())
                    state = [key_, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_window(text)[n_context:]
                state[1] += len(turns)
                for role, said in turns:
                    state[2].update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends, strict=True):
                    said = unescape(text[a:b])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield framed(out, columns)
        if state is not None:
            yield framed([row()], columns)

    kind = windows.schema[key].dataType.simpleString()
    return by_frames(ordered, digest, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("key", key)
