"""Benchmark decontamination by edit distance over words.

A document leaks an item where some window of its words lies within `rate` times the item's words of it
in edit distance. Items are embedded by CGK random walks: at each step of a walk a random bit of the word
under it says whether to move on, so that walks over two texts that differ by few edits soon meet again,
and edit distance becomes Hamming distance. An item longer than PIECE words is embedded in pieces, one of
which keeps its share of the edits at most. Bit sampling takes SAMPLED steps of a walk as an LSH key, KEYS
keys a walk; walks are added until the recall reaches its target, as simulated for each family of pieces of
like length with all edits made that are allowed (a target out of reach is an error).

Item-sized windows are laid at every word of every document, but where too few of the words there stand in
any item for a window within reach to start (exact: it never loses one). The windows are walked
alike, and where a window meets a key of an item, the words around it are aligned with the item, exactly.

Words are runs of letters and digits by Unicode category, with the marks on them; in scripts that are
written without blanks each letter is a word. Capitals of all scripts count as small letters. Null or empty
items match nothing, nor do null or empty texts; items and texts may be of any length; documents shorter than an item still match within the
edits allowed; equal rows are reported each; a benchmark larger than a block goes block by block; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, blocks, by_frames, framed, free_name, mix64, saved
from .shingles import powers
from .tokens import forget

RATE = 0.2
RECALL = 0.99
SAMPLED = 3
#: Keys of one walk, words of an embedded piece, and how much longer a family's longest piece may be than its shortest.
KEYS, PIECE, SPREAD = 4, 64, 1.6
#: Walks in one family at most, and edited pieces that the recall is simulated on.
MOST_WALKS, TRIALS = 64, 400
#: Characters of benchmark text that workers hold at once.
BENCHMARK_CHARS = 20_000_000
BLOCK = 2_000_000
#: In place of a word's number: not in any item, and beyond a piece's end.
UNKNOWN, PAD = -1, -2
#: Classes of code points: what parts words, letters and digits, letters that are words, marks on either.
GAP, LETTER, ALONE, MARK = range(4)
#: Names of letters of scripts without blanks begin like this.
UNSPACED = ("CJK UNIFIED", "CJK COMPATIBILITY IDEOGRAPH", "IDEOGRAPHIC", "HIRAGANA", "KATAKANA", "HALFWIDTH KATAKANA", "BOPOMOFO", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TAI ", "NEW TAI LUE", "JAVANESE", "BALINESE", "YI SYLLABLE", "TANGUT", "NUSHU")
_PLANES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _plane(number: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and hashes of the small letters, of 65536 code points."""
    if number not in _PLANES:
        kind, folded = np.zeros(65536, np.uint8), np.arange(65536, dtype=np.uint64) + np.uint64(number << 16)
        for k in range(65536):
            c = chr((number << 16) + k)
            category = unicodedata.category(c)
            if category[0] == "M":
                kind[k] = MARK
            elif c.isalnum():
                kind[k] = ALONE if category[0] == "L" and unicodedata.name(c, "").startswith(UNSPACED) else LETTER
                small = c.casefold()
                folded[k] = ord(small if len(small) == 1 else c.lower()[0])
        _PLANES[number] = kind, mix64(folded + np.uint64(1) << np.uint64(8))
    return _PLANES[number]


def split_words(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and places (first character, and after the last) of all words, bounds of each text's words, and where each text starts."""
    rows = [t or "" for t in texts]
    points = np.frombuffer((" ".join(rows) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind, mixed = (x[points & np.uint32(0xFFFF)] for x in _plane(0))
    if (beyond := points > 0xFFFF).any():
        for number in np.unique(points[beyond] >> np.uint32(16)).tolist():
            at = np.flatnonzero(points >> np.uint32(16) == number)
            kind[at], mixed[at] = (x[points[at] & np.uint32(0xFFFF)] for x in _plane(number))
    mark = kind == MARK
    if mark.any():  # a mark belongs to the letter before it
        kind = kind[np.maximum.accumulate(np.where(mark, 0, np.arange(len(kind))))]
        kind[kind == MARK] = GAP  # at the very start
    keep = kind != GAP
    before = np.concatenate(([GAP], kind[:-1]))
    opens = keep & ((before == GAP) | (~mark & ((kind == ALONE) | (before == ALONE))))
    starts = np.flatnonzero(opens)
    ends = np.flatnonzero(keep & np.concatenate((opens[1:] | ~keep[1:], [True]))) + 1
    at = np.concatenate(([0], np.cumsum([len(r) + 1 for r in rows]))).astype(np.int64)
    hashes = np.zeros(0, np.uint64)
    if len(starts):
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(first, sizes)
        hashes = mix64(np.add.reduceat(mixed[keep] * powers(int(sizes.max()))[inside], first))
    return hashes, starts, ends, np.searchsorted(starts, at), at


def coins(hashes: np.ndarray, number: int, part: int) -> np.ndarray:
    """For each word, whether a walk moves on from it at each of 64 steps: random bits."""
    return mix64(hashes ^ mix64(np.array([2 * number + 1 + (part << 32)], np.uint64))[0]).view(np.int64)


def walk(symbols: np.ndarray, hashes: np.ndarray, number: int, starts: np.ndarray, steps: Sequence[int]) -> dict[int, np.ndarray]:
    """The CGK embeddings from all starts, at some steps: the words' numbers there. Both arrays reach beyond the last step."""
    place, wanted, found, bits = starts.copy(), set(steps), {}, None
    for step in range(max(steps) + 1):
        if step % 64 == 0:
            bits = coins(hashes, number, step // 64)
        if step in wanted:
            found[step] = symbols[place]
        place += (bits[place] >> np.int64(step % 64)) & 1
    return found


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to a window of the region, and the first such window's end."""
    row, steps = np.zeros(len(region) + 1, np.int64), np.arange(len(region) + 1)
    for n, word in enumerate(item, 1):
        new = np.minimum(row + 1, np.concatenate(([n], row[:-1] + (region != word))))
        row = np.minimum.accumulate(new - steps) + steps
    end = int(np.argmin(row))
    return int(row[end]), end


class Family:
    """Pieces of like length, and the sorted keys of each walk over them."""

    def __init__(self, pieces: list[tuple[int, int, np.ndarray]], rate: float, sampled: int):
        self.items = np.array([p[0] for p in pieces])
        self.offsets = np.array([p[1] for p in pieces])
        self.words = [p[2] for p in pieces]
        self.lengths = np.unique([len(w) for w in self.words])
        self.edits = {int(n): int(n * rate + 1e-9) for n in self.lengths}
        least = int(self.lengths[0])
        self.steps = least if least < 8 else least + least // 2
        self.sampled = min(sampled, self.steps)
        self.walks: list[tuple[list[int], list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.uint64]]]] = []

    def draw(self, number: int) -> np.ndarray:
        """The steps that each key of a walk samples."""
        source = np.random.default_rng([number, self.steps])
        return np.stack([np.sort(source.choice(self.steps, self.sampled, replace=False)) for _ in range(KEYS)])

    @staticmethod
    def folded(found: dict[int, np.ndarray], steps: np.ndarray) -> np.ndarray:
        """One number for the symbols at a key's steps."""
        factors = mix64(np.arange(1, len(steps) + 1, dtype=np.uint64)) | np.uint64(1)
        return sum((found[int(s)].astype(np.uint64) * f for s, f in zip(steps, factors, strict=True)), np.uint64(0))

    def add_walk(self, number_of: Callable[[np.ndarray], np.ndarray]) -> None:
        """One more walk; number_of gives words' numbers."""
        number, draws = len(self.walks), self.draw(len(self.walks))
        pad = np.zeros(self.steps + 1, np.uint64)
        hashes = np.concatenate([x for w in self.words for x in (w, pad)])
        sizes = np.array([len(w) for w in self.words])
        ends = np.cumsum(sizes + self.steps + 1)
        starts = ends - sizes - self.steps - 1
        symbols = number_of(hashes)
        inside = np.arange(len(hashes)) < np.repeat(starts + sizes, sizes + self.steps + 1)
        symbols[~inside] = PAD
        used = sorted({int(s) for s in draws.ravel()})
        found, keys = walk(symbols, hashes, number, starts, used), []
        for steps in draws:
            valid = np.flatnonzero(np.all([found[int(s)] != PAD for s in steps], axis=0))
            value = self.folded(found, steps)[valid]
            order = np.argsort(value, kind="stable")
            shift = np.uint64(64 - min(20, max(12, (8 * len(value)).bit_length())))
            met = np.zeros(1 << (64 - int(shift)), bool)
            met[value >> shift] = True
            keys.append((steps, value[order], valid[order], met, shift))
        self.walks.append((used, keys))

    def windows(self, symbols: np.ndarray, known: np.ndarray, n: int) -> np.ndarray:
        """Where a window within reach of a piece may start: its first word is known, and enough of those that follow."""
        may = np.zeros(n, bool)
        for length, k in self.edits.items():
            may |= known[length + k : length + k + n] - known[:n] >= length - k
        return np.flatnonzero(may & (symbols[:n] >= 0))

    def meetings(self, number: int, symbols: np.ndarray, hashes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, pieces) of the windows that meet a key of a walk."""
        used, keys = self.walks[number]
        found = walk(symbols, hashes, number, starts, used)
        for steps, values, pieces, met, shift in keys:
            value = self.folded(found, steps)
            at = np.flatnonzero(met[value >> shift])
            low, high = np.searchsorted(values, value[at]), np.searchsorted(values, value[at], side="right")
            count = high - low
            which = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
            yield starts[np.repeat(at, count)], pieces[which]


class Benchmark:
    """Items' words, and families of their pieces; goes to the workers."""

    def __init__(self, ids: list, texts: list[str | None], rate: float, recall: float, sampled: int):
        hashes, _, _, bounds, _ = split_words(texts)
        kept = [i for i in range(len(ids)) if bounds[i + 1] > bounds[i]]
        self.ids = [ids[i] for i in kept]
        self.items = [hashes[bounds[i] : bounds[i + 1]] for i in kept]
        self.edits = [int(len(w) * rate + 1e-9) for w in self.items]
        self.bags = [np.unique(w) for w in self.items]
        self.vocabulary = np.unique(hashes)
        self.table = np.zeros(1 << 20, bool)
        self.table[self.vocabulary >> np.uint64(44)] = True
        pieces = []
        for i, w in enumerate(self.items):
            cuts = np.linspace(0, len(w), -(-len(w) // PIECE) + 1).astype(int)
            pieces += [(i, int(a), w[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        pieces.sort(key=lambda p: len(p[2]))
        self.families: list[Family] = []
        while pieces:
            n = sum(len(p[2]) <= max(len(pieces[0][2]) + 1, int(len(pieces[0][2]) * SPREAD)) for p in pieces)
            self.families.append(Family(pieces[:n], rate, sampled))
            pieces = pieces[n:]
        self.reach = 2 * PIECE + 64  # beyond a start, of steps and of words that count
        for family in self.families:
            self.reach = max(self.reach, family.steps + 1, int(family.lengths[-1]) + max(family.edits.values()) + 1)
        for family in self.families:
            self.fit(family, recall)

    def number_of(self, hashes: np.ndarray) -> np.ndarray:
        """Words' numbers in the items' vocabulary."""
        found = np.full(len(hashes), UNKNOWN, np.int64)
        at = np.flatnonzero(self.table[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        found[at] = np.where(self.vocabulary[place] == hashes[at], place, UNKNOWN)
        return found

    def laid(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and their numbers, with nothing known behind the last, and how many are known before each."""
        hashes = np.concatenate((hashes, np.zeros(self.reach, np.uint64)))
        symbols = self.number_of(hashes)
        symbols[len(hashes) - self.reach :] = UNKNOWN
        return hashes, symbols, np.concatenate(([0], np.cumsum(symbols >= 0)))

    def fit(self, family: Family, recall: float) -> None:
        """Walks until the recall is reached for pieces that are edited as much as allowed."""
        draw = np.random.default_rng(len(family.words))
        parts, begins, chosen, at = [], [], draw.integers(len(family.words), size=TRIALS), 0
        for i in chosen.tolist():
            words = list(family.words[i])
            for _ in range(family.edits[len(words)]):
                where, how = int(draw.integers(len(words))), int(draw.integers(3))
                if how == 0:
                    words[where] = np.uint64(draw.integers(1 << 62))
                elif how == 1 and len(words) > 1:
                    del words[where]
                else:
                    words.insert(where, np.uint64(draw.integers(1 << 62)))
            parts += [np.array(words, np.uint64), draw.integers(1 << 62, size=self.reach).astype(np.uint64)]
            begins.append(at)
            at += len(words) + self.reach
        hashes, symbols, known = self.laid(np.concatenate(parts))
        begins, caught = np.array(begins), np.zeros(TRIALS, bool)
        starts = family.windows(symbols, known, at)
        met = np.zeros(len(family.words), bool)
        while caught.mean() < recall or not met.all():
            if len(family.walks) == MOST_WALKS:
                raise ValueError(f"a recall of {recall} is out of reach for pieces of {family.lengths[0]} words and more")
            family.add_walk(self.number_of)
            for places, pieces in family.meetings(len(family.walks) - 1, symbols, hashes, starts):
                trial = np.searchsorted(begins, places, side="right") - 1
                caught[trial[(pieces == chosen[trial]) & (places - begins[trial] < PIECE)]] = True
            for _, _, pieces, _, _ in family.walks[-1][1]:
                met[pieces] = True

    def candidates(self, hashes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, first and last place where the item would start) for runs of windows that meet a key."""
        n, found = len(hashes), []
        hashes, symbols, known = self.laid(hashes)
        for family in self.families:
            starts = family.windows(symbols, known, n)
            for number in range(len(family.walks) if len(starts) else 0):
                for places, pieces in family.meetings(number, symbols, hashes, starts):
                    text = np.searchsorted(bounds, places, side="right") - 1
                    found.append(np.stack([text, family.items[pieces], places - family.offsets[pieces]]))
        if not found:
            return
        text, item, place = np.unique(np.concatenate(found, axis=1), axis=1)
        if not len(text):
            return
        reach = np.array(self.edits)[item] + 1
        opens = np.ones(len(text), bool)
        opens[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(place) > reach[1:])
        first = np.flatnonzero(opens)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(text)], strict=True):
            yield int(text[a]), int(item[a]), int(place[a]), int(place[b - 1])


def _leaks(docs: DataFrame, kind: str, benchmark: Benchmark) -> DataFrame:
    columns = ["key", "item", "distance", "item_words", "start_char", "end_char"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for block in blocks(frames, chars=BLOCK):
            hashes, starts, ends, bounds, begins = split_words(block["text"].tolist())
            keys, best = block["key"].tolist(), {}
            for text, item, first, last in benchmark.candidates(hashes, bounds):
                words, k = benchmark.items[item], benchmark.edits[item]
                low, high = max(int(bounds[text]), first - 2 * k), min(int(bounds[text + 1]), last + len(words) + 2 * k)
                bag, around = benchmark.bags[item], hashes[low:high]
                if np.count_nonzero(bag[np.minimum(np.searchsorted(bag, around), len(bag) - 1)] == around) < len(words) - k:
                    continue  # too few of its words are there
                distance, end = align(words, hashes[low:high])
                if distance <= k and (distance, low + end) < best.get((text, item), (k + 1, 0))[:2]:
                    _, back = align(words[::-1], hashes[low : low + end][::-1])
                    best[text, item] = distance, low + end, low + end - back
            rows = []
            for (text, item), (distance, end, start) in sorted(best.items()):
                chars = int(starts[start] - begins[text]), int(ends[end - 1] - begins[text])
                rows.append((keys[text], item, distance, len(benchmark.items[item]), *chars))
            yield framed(rows, columns)

    return by_frames(docs, search, f"key {kind}, item long, distance long, item_words long, start_char long, end_char long")


def find_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, recall: float = RECALL, sampled: int = SAMPLED) -> DataFrame:
    """key, item, distance, item_words, start_char, end_char: the nearest window of each text and item within reach."""
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind, item_kind = (t.schema[c].dataType.simpleString() for t, c in ((df, key), (benchmark, item)))
    rows = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / BENCHMARK_CHARS))
    found = None
    for part in range(parts):
        held = sorted(((r["id"], r["text"]) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()), key=lambda r: (r[0] is not None, r[0], r[1]))
        ready = Benchmark([r[0] for r in held], [r[1] for r in held], rate, recall, sampled)
        if not ready.ids:
            continue
        names = spark.createDataFrame([(i, x) for i, x in enumerate(ready.ids)], f"item long, name {item_kind}")  # a block's items
        leaks = _leaks(docs, kind, ready).join(F.broadcast(names), "item").select(F.col("key").alias(key), F.col("name").alias(item), "distance", "item_words", "start_char", "end_char")
        found = leaks if found is None else found.union(leaks)
    if found is None:
        return spark.createDataFrame([], f"{key} {kind}, {item} {item_kind}, distance long, item_words long, start_char long, end_char long")
    return found


def without_leaks(df: DataFrame, benchmark: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The rows that leak no item; a row with a null key stays unless null keys leak."""
    name = free_name(df.columns, "leaks")
    leaking = saved(find_leaks(df, benchmark, key, **settings).select(F.col(key).alias(name)).distinct(), small=True)
    few = leaking.count() <= BROADCAST_KEYS  # beyond that size both sides are shuffled
    return df.join(F.broadcast(leaking) if few else leaking, F.col(key).eqNullSafe(F.col(name)), "left_anti")
