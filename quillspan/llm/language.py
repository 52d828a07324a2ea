"""Language identification by character language models.

Each language has an interpolated Kneser-Ney model over letters and word gaps. The models lie together
in sorted hash arrays, one for each order: an n-gram's hash, and beside it its log probability in every
language, with what the lower orders add already in it; and a context's hash, with its weight for the
lower order. A text is scored by the longest n-gram found at each character; the language with the
lowest cross-entropy per character is its language. How sure that is comes from a softmax whose scale is
fitted on rows the models haven't seen, and so does the limit beyond which a text is rejected as being in
none of the languages.

The models are fitted on a bounded sample of the labelled rows: SAMPLE_CHARS characters over all
languages, of distinct texts, shared evenly. Each language gives its texts in hash order until its share
is full, the last one as a random span where it is too long; so every language with a letter has a model.
Languages are any number: their models lie in blocks of BLOCK_LANGUAGES. Prediction covers every row and
whole texts.

A null text, or one without a letter, is `und` with score 0 and is rejected; so is every text where no
row has a label. Ties go to the language that comes first by name. Equal rows get equal results; an
empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, by_frames, free_name, mix64, saved
from .tokens import forget

ORDER = 5
SAMPLE_CHARS = 6_000_000
#: No language's share of the sample is larger, however few there are.
LANGUAGE_CHARS = 1_500_000
#: Languages whose models share sorted arrays, as these have a column for each.
BLOCK_LANGUAGES = 8
#: A language with fewer texts in the sample has them cut into so many pieces, to keep one for calibration.
PIECES = 5
BLOCK = 500_000
#: A text is rejected beyond the mean of held-out texts by this many bits a character, and by this many deviations for its length.
MARGIN_BITS, MARGIN_DEVIATIONS = 1.0, 8.0
UNKNOWN = "und"
LETTER = r"\p{L}"
_FACTORS = mix64(np.arange(1, ORDER + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)
_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point (those beyond 65535 count as 65535): the symbol (0: a gap), and whether it is a letter."""
    if not _TABLES:
        symbol, letter = np.zeros(65536, np.uint32), np.zeros(65536, bool)
        for c in range(65536):
            if (x := chr(c)).isalpha() or unicodedata.category(x)[0] == "M":
                low = x.lower()
                symbol[c], letter[c] = ord(low) if len(low) == 1 and ord(low) < 65536 else c, x.isalpha()
        symbol[65535] = 65535
        _TABLES.update(symbol=symbol, letter=letter)
    return _TABLES["symbol"], _TABLES["letter"]


def symbols(text: str | None) -> np.ndarray:
    """A text's symbols: small letters, single gaps between words and at the end; empty without a letter."""
    symbol, letter = _tables()
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(points, 65535)
    if not letter[low].any() and not any(chr(c).isalpha() for c in np.unique(points[points > 65535]).tolist()):
        return np.zeros(0, np.uint32)
    found = np.concatenate((symbol[low], np.zeros(1, np.uint32)))
    keep = found != 0
    keep[1:] |= found[:-1] != 0
    return found[keep]


def grams(flat: np.ndarray) -> list[np.ndarray]:
    """Hashes, by order from 0 on, of the n-grams that end at each place."""
    mixed = mix64(flat.astype(np.uint64) + np.uint64(1))
    found = [np.zeros(len(flat), np.uint64)]
    for k in range(ORDER):
        shifted = np.concatenate((np.zeros(k, np.uint64), mixed[: len(mixed) - k])) if k else mixed
        found.append(found[-1] + shifted * _FACTORS[k])
    return found


def _lay(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts' symbols one after another, each after gaps for its first contexts; and which places are predicted."""
    pad, parts, marks = np.zeros(ORDER - 1, np.uint32), [], []
    for row in rows:
        parts += (pad, row)
        marks += (np.zeros(ORDER - 1, bool), np.ones(len(row), bool))
    return (np.concatenate(parts), np.concatenate(marks)) if parts else (np.zeros(0, np.uint32), np.zeros(0, bool))


class _Counts:
    """One language's n-grams of one order: sorted keys, their contexts and suffixes, and the discounted shares."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, context: np.ndarray, suffix: np.ndarray):
        self.keys, self.context, self.suffix = keys, context, suffix
        once, twice = (counts == 1).sum(), (counts == 2).sum()
        discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.95))
        self.contexts, owner = np.unique(context, return_inverse=True)
        total = np.bincount(owner, counts, len(self.contexts))
        self.share = (counts - np.minimum(counts, discount)) / total[owner]
        self.weight = discount * np.bincount(owner, minlength=len(self.contexts)) / total


def count_language(rows: Sequence[np.ndarray]) -> list[_Counts]:
    """The counts of each order, the first for single symbols; below the highest, of distinct left neighbours."""
    flat, marks = _lay(rows)
    hashes = grams(flat)
    at = np.flatnonzero(marks)
    found: list[_Counts] = []
    keys, first, counts = np.unique(hashes[ORDER][at], return_index=True, return_counts=True)
    at = at[first]
    for k in range(ORDER, 0, -1):
        suffix = hashes[k - 1][at]
        found.append(_Counts(keys, counts.astype(np.float64), hashes[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64), suffix))
        keys, first, counts = np.unique(suffix, return_index=True, return_counts=True)
        at = at[first]
    return found[::-1]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted array; -1 for those that aren't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


class _Block:
    """Sorted hash arrays of some languages' models; `width` is the number of symbols of all, and one."""

    def __init__(self, rows: Sequence[list[np.ndarray]], width: int):
        counted = [count_language(r) for r in rows]
        n = len(rows)
        self.keys, self.logs, self.contexts, self.weights = [], [], [], []
        lower = np.full((1, n), 1.0 / width)  # below single symbols: all alike
        for k in range(ORDER):
            each = [c[k] for c in counted]
            contexts = np.unique(np.concatenate([c.contexts for c in each]))
            weight = np.ones((len(contexts), n))
            keys, first = np.unique(np.concatenate([c.keys for c in each]), return_index=True)
            context, suffix = (np.concatenate([getattr(c, name) for c in each])[first] for name in ("context", "suffix"))
            chance = np.zeros((len(keys), n))
            for i, c in enumerate(each):
                weight[np.searchsorted(contexts, c.contexts), i] = c.weight
                chance[np.searchsorted(keys, c.keys), i] = c.share
            below = lower[np.searchsorted(self.keys[-1], suffix)] if k else lower
            lower = chance + weight[np.searchsorted(contexts, context)] * below
            self.keys.append(keys)
            self.logs.append(np.log2(lower).astype(np.float32))
            self.contexts.append(contexts)
            self.weights.append(np.log2(weight).astype(np.float32))
        self.unseen = (self.weights[0][0] - np.log2(width)).astype(np.float32)

    def find(self, here: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Log probability of each place in each language."""
        out = np.zeros((len(here[0]), len(self.unseen)), np.float32)
        left = np.arange(len(out))
        for k in range(ORDER, 0, -1):
            found = _find(self.keys[k - 1], here[k][left])
            met = found >= 0
            out[left[met]] += self.logs[k - 1][found[met]]
            left = left[~met]
            if not len(left):
                return out
            if k > 1:
                context = _find(self.contexts[k - 1], before[k - 1][left])
                known = context >= 0
                out[left[known]] += self.weights[k - 1][context[known]]
        out[left] += self.unseen
        return out


class Models:
    """All languages' models, in blocks, and their calibration."""

    def __init__(self, languages: list[str], rows: list[list[np.ndarray]]):
        self.languages = languages
        n = len(languages)
        width = len(np.unique(np.concatenate([np.unique(s) for r in rows for s in r]))) + 1
        self.blocks = [_Block(rows[at : at + BLOCK_LANGUAGES], width) for at in range(0, n, BLOCK_LANGUAGES)]
        self.scale, self.mean, self.spread = 1.0, np.zeros(n), np.zeros(n)

    def bits(self, rows: Sequence[np.ndarray]) -> np.ndarray:
        """Cross-entropy in bits per symbol of each text (rows) in each language; no row may be empty."""
        flat, marks = _lay(rows)
        sizes = np.array([len(r) for r in rows])
        ends = np.cumsum(sizes + ORDER - 1)
        total = np.zeros((len(rows), len(self.languages)))
        for low in range(0, len(flat), BLOCK):
            high = min(len(flat), low + BLOCK)
            back = max(0, low - ORDER)
            hashes = grams(flat[back:high])
            at = np.flatnonzero(marks[low:high]) + low
            if not len(at):
                continue
            here, before = [h[at - back] for h in hashes], [h[at - back - 1] for h in hashes]
            owner = np.searchsorted(ends, at, side="right")
            cut = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for k, block in enumerate(self.blocks):
                columns = slice(k * BLOCK_LANGUAGES, (k + 1) * BLOCK_LANGUAGES)
                total[owner[cut], columns] += np.add.reduceat(block.find(here, before), cut, axis=0, dtype=np.float64)
        return -total / sizes[:, None]

    def _logs(self, here: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        return np.concatenate([b.find(here, before) for b in self.blocks], axis=1)

    def calibrate(self, language: np.ndarray, rows: Sequence[np.ndarray]) -> None:
        """Fit the softmax's scale, and what cross-entropy texts of each language have, on labelled texts."""
        if not len(rows):
            return
        bits = self.bits(rows)
        own = bits[np.arange(len(rows)), language]
        scales = 2.0 ** np.arange(-4, 9)
        losses = [-np.log(np.maximum(1e-12, self._softmax(bits, s)[np.arange(len(rows)), language])).mean() for s in scales]
        self.scale = float(scales[int(np.argmin(losses))])
        root = np.sqrt([len(r) for r in rows])
        for i in range(len(self.languages)):
            if (mine := language == i).any():
                self.mean[i] = np.average(own[mine], weights=root[mine] ** 2)
                self.spread[i] = np.sqrt((((own[mine] - self.mean[i]) * root[mine]) ** 2).mean())
            else:
                self.mean[i], self.spread[i] = np.inf, 0.0

    @staticmethod
    def _softmax(bits: np.ndarray, scale: float) -> np.ndarray:
        x = -bits * scale
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, bits, rejected) of each text."""
        rows = [symbols(t) for t in texts]
        out: list[tuple[str, float, float | None, bool]] = [(UNKNOWN, 0.0, None, True)] * len(rows)
        some = [i for i, r in enumerate(rows) if len(r)]
        if some:
            bits = self.bits([rows[i] for i in some])
            best = bits.argmin(axis=1)
            chance = self._softmax(bits, self.scale)
            for k, i in enumerate(some):
                b, h = int(best[k]), float(bits[k, best[k]])
                limit = self.mean[b] + MARGIN_BITS + MARGIN_DEVIATIONS * self.spread[b] / np.sqrt(len(rows[i]))
                out[i] = (self.languages[b], float(chance[k, b]), h, bool(h > limit))
        return out


def sample_texts(rows: DataFrame, chars: int) -> pd.DataFrame:
    """lang, text: distinct texts of each language in hash order until its share of the characters is full.

    What is sorted are rows without text, and only those below a hash that leaves the share some 64 times
    the room of its longest text, or all; a language's first text is always among them.
    """
    top = 1 << 62
    place = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(top))
    light = saved(rows.groupBy("lang", place.alias("place")).agg(F.max(F.length("text")).cast("long").alias("n")))
    languages = light.select("lang").distinct().count()
    if not languages:
        return pd.DataFrame({"lang": [], "text": []})
    share = max(1, min(LANGUAGE_CHARS, chars // languages))
    size = F.least(F.col("n"), F.lit(share))
    totals = light.groupBy("lang").agg(F.sum(size.cast("double")).alias("total"), F.max(size).alias("longest"), F.min("place").alias("first"))
    reach = F.least(F.lit(1.0), (4 * F.lit(share) + 60 * F.col("longest")) / F.col("total"))
    near = light.join(F.broadcast(totals), "lang").where(F.col("place") <= F.greatest(F.col("first"), (reach * top).cast("long")))
    ahead = Window.partitionBy("lang").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    chosen = near.withColumn("room", share - F.coalesce(F.sum(size).over(ahead), F.lit(0))).where("room > 0")
    last = chosen.groupBy("lang").agg(F.max("place").alias("last"), F.max_by("room", "place").cast("int").alias("room"))
    found = rows.withColumn("place", place).join(F.broadcast(last), "lang").where("place <= last").select("lang", "text", "room", (F.col("place") == F.col("last")).alias("cut")).distinct()
    start = F.pmod(F.xxhash64("text", F.lit("span")), F.length("text") - F.col("room") + 1).cast("int") + 1
    span = F.substring("text", start, F.col("room"))
    span = F.when(span.rlike(LETTER), span).otherwise(F.substring("text", F.regexp_instr("text", F.lit(LETTER)), F.col("room")))
    text = F.when(F.col("cut") & (F.length("text") > F.col("room")), span).otherwise(F.col("text"))
    return found.select("lang", text.alias("text")).orderBy("lang", "text").toPandas()  # about `chars` characters


def fit_models(train: DataFrame, text: str = "text", lang: str = "lang", chars: int = SAMPLE_CHARS) -> Models | None:
    """Models of the languages in labelled rows; a fifth of the sample is kept for calibration."""
    rows = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    sample = sample_texts(rows, chars)
    languages: list[str] = []
    fitted: list[list[np.ndarray]] = []
    kept: list[tuple[int, np.ndarray]] = []
    for name, texts in sample.groupby("lang", sort=True)["text"]:
        found = [s for s in map(symbols, texts) if len(s)]
        if not found:
            continue
        if len(found) < PIECES:
            found = _pieces(found)
        fitted.append([s for k, s in enumerate(found) if k % PIECES != PIECES - 1])
        kept += [(len(languages), s) for s in found[PIECES - 1 :: PIECES]] or [(len(languages), s) for s in found]
        languages.append(name)
    if not languages:
        return None
    models = Models(languages, fitted)
    models.calibrate(np.array([i for i, _ in kept]), [s for _, s in kept])
    return models


def _pieces(rows: list[np.ndarray]) -> list[np.ndarray]:
    """A language's few texts, each cut between words into pieces of about a fifth of them all."""
    size, found = -(-sum(map(len, rows)) // PIECES), []
    for row in rows:
        gaps = np.flatnonzero(row == 0)
        at = 0
        while at < len(row):
            later = gaps[gaps >= at + size - 1]
            end = int(later[0]) + 1 if len(later) else len(row)
            found.append(row[at:end])
            at = end
    return found


def identify(df: DataFrame, models: Models | None, text: str = "text", prefix: str = "lang_") -> DataFrame:
    """df with pred, score (0 to 1), bits (per symbol) and rejected, each after the prefix; columns of these names are replaced."""
    names = [prefix + x for x in ("pred", "score", "bits", "rejected")]
    df = df.drop(*[c for c in df.columns if c != text and c.lower() in {n.lower() for n in names}])
    held = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for block in blocks(frames, text, BLOCK):
            known = held.value
            texts = [t if isinstance(t, str) else None for t in block[text]]
            found = known.predict(texts) if known else [(UNKNOWN, 0.0, None, True)] * len(texts)
            block = block.copy()
            for k, name in enumerate(names):
                block[name] = [f[k] for f in found]
            yield block

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    added = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double", "boolean"), strict=True))
    return by_frames(df, predict, f"{schema}, {added}")


def accepted(df: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """The rows, as they are, whose text isn't rejected; all of them where there is no model."""
    if models is None:
        return df
    prefix = free_name(df.columns, "lang")
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return identify(df, models, text, prefix).where(~F.col(f"{prefix}rejected")).select(*[F.col(f"`{c}`") for c in df.columns])
