"""Exact token ids of whole texts, with a cache of what stands between blanks.

The byte-level tokenizer cuts a text before every blank that a non-blank character follows, whatever
stands around it: none of its pre-tokens crosses such a place. So the ids of a text are the ids of its
chunks between those places, one after another, and a chunk's ids, found once with the tokenizers
library, hold wherever the chunk stands again. Texts where the cut is not this simple (runs of white
space) are cut by an expression instead. New chunks are encoded together, as one text: the bytes of its
tokens say where each chunk ends. The cache is bounded; chunks beyond it are encoded per batch.

A text that holds the string of an added token, and every text of a tokenizer of another kind, goes to
the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

from .common import give_back

#: Chunks that one Python worker keeps.
CACHE_CHUNKS = 400_000
#: New chunks that are encoded as one text.
JOINED_CHUNKS = 8_192
TOKENIZER = "byte_bpe_50k.json"
_CUT = re.compile(r"(?= \S)")
_ENCODERS: dict[str, ChunkEncoder] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """The place of a public tokenizer's file; a path stays as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Chunks(dict):
    """Chunk -> number; a chunk not met before gets the next number and is noted down."""

    def __init__(self, owner: ChunkEncoder, blank: bool):
        super().__init__()
        self.owner, self.blank = owner, blank
        self.fresh: dict[str, int] = {}  # what this call has met first

    def __missing__(self, chunk: str) -> int:
        if self.blank and (not chunk or chunk[0].isspace()):
            self.owner.odd = True  # a blank before white space is no place to cut
            return 0
        number = self.fresh.get(chunk)
        if number is None:
            number = self.fresh[chunk] = self.owner.met
            self.owner.met += 1
        if number < self.owner.limit:
            self[chunk] = number
        return number


class ChunkEncoder:
    """A tokenizer's ids. `chunked` says whether its kind allows the cache; otherwise whole texts are encoded."""

    def __init__(self, path: str, limit: int = CACHE_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.added = re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or r"(?!)")
        self.chunked = _cuts_at_blanks(told)
        if self.chunked:  # a byte-level token has a character for each byte
            self.bytes = np.zeros(max(told["model"]["vocab"].values()) + 1, np.int64)
            for token, number in told["model"]["vocab"].items():
                self.bytes[number] = len(token)
        self.limit = limit
        self.first = _Chunks(self, False)  # chunks as they stand
        self.later = _Chunks(self, True)  # chunks that a blank precedes
        self.lengths = np.zeros(1024, np.int64)
        self.starts = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.int32)
        self.n = self.used = self.met = 0
        self.odd = False

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that begin with a blank, encoded as one text, and how many each has."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0].ids, np.int32)
        ends = np.cumsum(np.fromiter((len(c) if c.isascii() else len(c.encode()) for c in chunks), np.int64, len(chunks)))
        upto = np.searchsorted(np.cumsum(self.bytes[ids]), ends) + 1
        return ids, np.diff(upto, prepend=0)

    def _encode_fresh(self) -> None:
        """Ids of the chunks that this call has met first, in the order of their numbers."""
        heads, tails = self.first.fresh, self.later.fresh
        if not heads and not tails:
            return
        sizes, order, parts = [], [*tails.values(), *heads.values()], []
        chunks = [" " + c for c in tails]
        for at in range(0, len(chunks), JOINED_CHUNKS):
            ids, size = self._joined(chunks[at : at + JOINED_CHUNKS])
            parts.append(ids)
            sizes.append(size)
        found = self._whole(heads)
        parts += found
        sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.first.fresh, self.later.fresh = {}, {}
        size, ids, number = np.concatenate(sizes), np.concatenate(parts), np.array(order, np.int64)
        n, used = self.met, self.used + len(ids)
        if n > len(self.lengths):
            self.lengths, self.starts = np.resize(self.lengths, 2 * n), np.resize(self.starts, 2 * n)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.lengths[number] = size
        begin = np.cumsum(size) - size
        sorted_size = self.lengths[self.n : n]
        own = np.cumsum(sorted_size) - sorted_size  # ids lie by number, so that the cache can be cut short
        at = own[number - self.n]
        self.starts[number] = self.used + at
        self.ids[np.repeat(self.used + at - begin, size) + np.arange(len(ids))] = ids
        self.n, self.used = n, used

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids (int32) of each text, as the library gives them; a null text is empty."""
        texts = [t or "" for t in texts]
        alone = [k for k, t in enumerate(texts) if not self.chunked or self.added.search(t)]
        whole = dict(zip(alone, self._whole([texts[k] for k in alone]), strict=True)) if alone else {}
        lists = []
        for k, text in enumerate(texts):
            if k in whole:
                lists += [np.zeros(0, np.int64)] * 2
                continue
            self.odd = False
            head, *tail = text.split(" ")
            got = np.fromiter(map(self.later.__getitem__, tail), np.int64, len(tail))
            if self.odd:
                head, *tail = _CUT.split(text)
                if not head and tail:  # the expression also cuts at the start
                    head, *tail = tail
                got = np.fromiter((self.later[t[1:]] for t in tail), np.int64, len(tail))
            lists += [np.array([self.first[head]], np.int64), got]
        self._encode_fresh()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        chunk = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        size = self.lengths[chunk]
        end = np.cumsum(size)
        flat = self.ids[np.repeat(self.starts[chunk] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        cut = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(counts)[1::2]))]
        if self.n > self.limit:  # what the cache doesn't keep goes
            self.n, self.met, self.used = self.limit, self.limit, int(self.starts[self.limit])
        return [whole.get(k, flat[a:b]) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]


def _cuts_at_blanks(told: dict) -> bool:
    """Whether a tokenizer is byte-level, with the expression that cuts before a blank which a non-blank follows."""
    pre, model = told.get("pre_tokenizer") or {}, told.get("model") or {}
    return (
        not told.get("normalizer") and not told.get("truncation") and not told.get("padding") and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and pre.get("type") == "ByteLevel" and bool(pre.get("use_regex", True)) and not pre.get("add_prefix_space")
    )


def encoder(path: str) -> ChunkEncoder:
    """This worker's encoder; the cache lasts as long as the worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this worker's caches, before work that doesn't encode, and give their memory back."""
    if _ENCODERS:
        _ENCODERS.clear()
        give_back()
