"""Chunking: groups of compatible prose, sentence packs, windows, and where each chunk comes from."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_count
from .encoders import embedded_texts, made, provider

#: Characters of a stretch by which chunks and blocks of a group meet.
POSITIONS = 4096
SENTENCE = re.compile(r"(?s).+?(?:[.!?] |\n|$)")
#: Languages by suffix, and by how a file starts.
CODE_LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".go": "go", ".rs": "rust", ".rb": "ruby", ".php": "php", ".swift": "swift", ".sql": "sql", ".sh": "bash", ".ps1": "powershell", ".css": "css", ".scss": "scss", ".xml": "xml"}


@dataclass(frozen=True)
class ChunkingPolicy:
    """Sizes in characters or words, overlap, and the way to find boundaries."""

    target_size: int = 500
    overlap: int = 50
    size_unit: str = "characters"
    strategy: str = "sentence"
    preserve_code_blocks: bool = True
    semantic_threshold: float = 0.8
    semantic_similarity_window: int = 3

    def __post_init__(self) -> None:
        if self.target_size <= 0 or not 0 <= self.overlap:
            raise ValueError("sizes must be positive")
        if self.overlap >= self.target_size:
            raise ValueError("overlap must be smaller than target_size")
        if self.size_unit not in ("characters", "tokens") or self.strategy not in ("sentence", "semantic"):
            raise ValueError("unknown size unit or strategy")
        if self.strategy == "semantic" and self.size_unit != "tokens":
            raise ValueError("semantic chunking needs size_unit='tokens'")
        if not 0 < self.semantic_threshold < 1:
            raise ValueError("the threshold must lie between 0 and 1")

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]


def prose_groups(blocks: DataFrame) -> DataFrame:
    """blocks (document_id, block_no, kind, text, page, section) with group_no.

    Blank blocks go; code stands alone; a heading opens a group; so does a block whose page or section
    differs from that of the block before it, where both have one.
    """
    order = Window.partitionBy("document_id").orderBy("block_no")
    before = lambda c: F.lag(c).over(order)
    differs = lambda c: F.coalesce(before(c) != F.col(c), F.lit(False))
    opens = before("kind").isNull() | (F.col("kind") == "code") | (before("kind") == "code") | (F.col("kind") == "heading") | differs("page") | differs("section")
    kept = blocks.where(F.col("text").rlike(r"\S"))
    return kept.withColumn("_opens", opens.cast("int")).withColumn("group_no", F.sum("_opens").over(order)).drop("_opens")


def group_spans(grouped: DataFrame) -> DataFrame:
    """grouped with span_start and span_end: where a block stands in its group's text (joined by two line feeds)."""
    upto = Window.partitionBy("document_id", "group_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(upto), F.lit(0))
    return grouped.withColumn("span_start", start).withColumn("span_end", start + F.length("text"))


def group_texts(grouped: DataFrame) -> DataFrame:
    """document_id, group_no, text."""
    listed = grouped.groupBy("document_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "text"))).alias("parts"))
    return listed.select("document_id", "group_no", F.array_join("parts.text", "\n\n").alias("text"))


def project_spans(chunks: DataFrame, spans: DataFrame) -> DataFrame:
    """Where each chunk (document_id, group_no, chunk_no, start, end) lies in its blocks.

    Characters and lines are those of the source, where the block has them. Chunks and blocks meet by the stretches of
    POSITIONS characters that they have a part in, each pair in the first they share; so a group of many chunks and blocks costs as
    many rows as it has stretches and pairs.
    """
    group = ["document_id", "group_no"]
    stretch = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / POSITIONS), F.floor((F.col(b) - 1) / POSITIONS))).alias("_stretch")
    cut = chunks.where("start < end").select(*group, "chunk_no", "start", "end", stretch("start", "end"))
    place = spans.where("span_start < span_end").select(*group, "block_no", F.col("span_start").alias("_from"), F.col("span_end").alias("_to"), stretch("span_start", "span_end"))
    both = cut.join(place, [*group, "_stretch"]).where((F.greatest("start", "_from") < F.least("end", "_to")) & (F.col("_stretch") == F.floor(F.greatest("start", "_from") / POSITIONS)))
    joined = both.select(*group, "chunk_no", "start", "end", "block_no").join(spans, [*group, "block_no"])
    a, b = F.greatest("start", "span_start") - F.col("span_start"), F.least("end", "span_end") - F.col("span_start")
    picked = F.substring(F.col("text"), a + 1, b - a)
    lines = F.col("line_start") + line_count(F.substring(F.col("text"), F.lit(1), a))
    return joined.select(
        "document_id", "group_no", "chunk_no", "block_no", "page", "section",
        lines.alias("line_start"),
        (lines + line_count(picked) - F.when(picked.endswith("\n"), 1).otherwise(0)).alias("line_end"),
        (F.col("char_start") + a).alias("char_start"),
        (F.col("char_start") + b).alias("char_end"),
    )


def merge_locations(locations: DataFrame, *by: str) -> DataFrame:
    """One location for each chunk: page and section if all that have one agree, bounds if all have them."""
    agreed = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).alias(c)
    whole = lambda f, c: F.when(F.count(c) == F.count("*"), f(c)).alias(c)
    return locations.groupBy(*by).agg(
        agreed("page"), agreed("section"), whole(F.min, "line_start"), whole(F.max, "line_end"), whole(F.min, "char_start"), whole(F.max, "char_end"), F.count("*").alias("n_locations"),
    )


def windows(texts: DataFrame, size: int, text: str = "text") -> DataFrame:
    """texts with chunk_no, start, end and chunk_text: windows of so many characters, without blank ones."""
    count = F.greatest(F.lit(1), F.ceil(F.length(text) / size)).cast("int")
    cut = texts.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("start", F.col("chunk_no") * size)
    cut = cut.withColumn("end", F.least(F.col("start") + size, F.length(text))).withColumn("chunk_text", F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")))
    return cut.where(F.col("chunk_text").rlike(r"\S"))


def sentence_spans(text: str, size: int, overlap: int, unit: str = "characters") -> list[tuple[int, int]]:
    """(start, end) of packs of whole sentences up to a size, each opening with the last sentences before it.

    The overlap is the longest run of whole sentences within its limit that still leaves the next
    sentence room. A sentence over the size is cut into windows.
    """
    measure = len if unit == "characters" else (lambda s: len(s.split()))
    found: list[tuple[int, int]] = []
    pack: list[tuple[int, int]] = []
    for match in SENTENCE.finditer(text):
        at = match.span()
        if measure(text[at[0] : at[1]]) > size:
            if pack:
                found.append((pack[0][0], pack[-1][1]))
            found += _hard_windows(text, *at, size, unit)
            pack = []
            continue
        if pack and measure(text[pack[0][0] : at[1]]) > size:
            found.append((pack[0][0], pack[-1][1]))
            end = pack[-1][1]
            while pack and (measure(text[pack[0][0] : end]) > overlap or measure(text[pack[0][0] : at[1]]) > size):
                pack.pop(0)
        pack.append(at)
    if pack:
        found.append((pack[0][0], pack[-1][1]))
    return found


def _hard_windows(text: str, start: int, end: int, size: int, unit: str) -> list[tuple[int, int]]:
    if unit == "characters":
        return [(a, min(end, a + size)) for a in range(start, end, size)]
    words = [m.span() for m in re.finditer(r"\S+\s*", text[start:end])]
    return [(start + words[k][0], start + words[min(len(words), k + size) - 1][1]) for k in range(0, len(words), size)]


def sentence_table(groups: DataFrame) -> DataFrame:
    """document_id, group_no, sent_no, start, end, sentence: a row for each sentence of groups (document_id, group_no, text)."""
    rows = groups.select("document_id", "group_no", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s).+?(?:[.!?] |\n|\z)"), F.lit(0))).alias("sent_no", "sentence"))
    before = Window.partitionBy("document_id", "group_no").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("sentence")).over(before), F.lit(0)).cast("int")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.length("sentence"))


def semantic_boundaries(groups: DataFrame, embed: Callable[[list[str]], list[list[float]]], threshold: float = 0.8, window: int = 3) -> DataFrame:
    """sentence_table's rows with `similarity` to the sum of the vectors of the sentences before, and `topic`, from 1.

    A sentence that is less similar than the threshold opens a topic; so does one whose vector, or that sum, is
    zero. Sentences are embedded in batches over all documents, each text once; windows and topics are
    window functions over a group.
    """
    rows = sentence_table(groups).withColumn("key", F.sha2("sentence", 256))
    vectors = embedded_texts(rows.select("key", F.col("sentence").alias("text")).dropDuplicates(["key"]), embed)
    good = F.when(F.col("error").isNull(), F.col("vector")).otherwise(F.raise_error(F.col("error")).cast("array<double>"))
    order = Window.partitionBy("document_id", "group_no").orderBy("sent_no")
    with_recent = rows.join(vectors.select("key", good.alias("vector")), "key").withColumn("recent", F.collect_list("vector").over(order.rowsBetween(-window, -1)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    summed = with_recent.withColumn("sum", F.aggregate(F.slice("recent", F.lit(2), F.greatest(F.size("recent") - 1, F.lit(0))), F.get("recent", 0), add))
    norm = dot(F.col("sum"), F.col("sum")) * dot(F.col("vector"), F.col("vector"))
    likeness = summed.withColumn("similarity", F.when(norm > 0, dot(F.col("sum"), F.col("vector")) / F.sqrt(norm)))
    topic = F.sum(F.when(F.col("similarity") >= threshold, 0).otherwise(1)).over(order)
    return likeness.withColumn("topic", topic).select("document_id", "group_no", "sent_no", "start", "end", "sentence", "similarity", "topic")


def semantic_spans(text: str, sentences: list[tuple[int, int, int]], policy: ChunkingPolicy) -> list[tuple[int, int]]:
    """Packs of sentences (start, end, topic) of one topic up to a size, with the overlap before each."""
    base = policy.target_size - policy.overlap
    packs: list[list[int]] = []  # start, end, topic
    for start, end, topic in sentences:
        if packs and packs[-1][2] == topic and len(text[packs[-1][0] : end].split()) <= base:
            packs[-1][1] = end
        else:
            packs.append([start, end, topic])
    spans = [w for start, end, _ in packs for w in _hard_windows(text, start, end, base, "tokens")]
    out = []
    for k, (start, end) in enumerate(spans):
        if k and policy.overlap:
            words = [m.start() for m in re.finditer(r"\S+\s*", text[spans[k - 1][0] : spans[k - 1][1]])]
            start = spans[k - 1][0] + words[-policy.overlap :][0] if words else start
        out.append((start, end))
    return out


#: Languages whose declarations stand in braces.
BRACES = ("javascript", "typescript", "tsx", "java", "kotlin", "c", "cpp", "csharp", "go", "rust", "php", "swift", "css", "scss")


def _signs(language: str) -> re.Pattern[str]:
    """Comments and strings of a language, which are passed over, and the signs that open and close."""
    line = {"css": r"(?!)", "php": r"//[^\n]*|\#[^\n]*"}.get(language, r"//[^\n]*")
    quote = r"'(?:\\[^']*|[^'\\\n])'" if language in ("rust", "c", "cpp", "java", "kotlin", "csharp", "go", "swift") else r"'(?:\\.|[^'\\\n])*'"  # one character, or a string
    return re.compile(rf'{line}|/\*.*?\*/|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`|{quote}|[{{}}()\[\];\n]', re.S)


def declaration_starts(text: str, language: str) -> list[int] | None:
    """Where the top-level declarations of code in braces begin, each with the comments before it; None where brackets don't match.

    A declaration ends with the line that closes its outermost brace, or that has a semicolon outside of any bracket.
    """
    open_, starts, ended = [], [0], False
    closes = {"}": "{", ")": "(", "]": "["}
    for m in _signs(language).finditer(text):
        sign = m[0]
        if sign in ("{", "(", "["):
            open_.append(sign)
        elif sign in closes:
            if not open_ or open_.pop() != closes[sign]:
                return None
            ended |= sign == "}" and not open_
        elif sign == ";":
            ended |= not open_
        elif sign == "\n" and ended and not open_:
            starts.append(m.end())
            ended = False
    return None if open_ else starts


def code_spans(text: str, language: str | None, size: int, unit: str = "characters") -> tuple[str, list[tuple[int, int]]]:
    """How code was cut, and the spans: top-level statements or declarations packed to a size, parts at blank lines, else windows."""
    measure = len if unit == "characters" else (lambda s: len(s.split()))
    starts = [0]
    how = "blank-lines"
    lines = text.splitlines(keepends=True)
    places = [0]
    for line in lines:
        places.append(places[-1] + len(line))
    if language == "python":
        try:
            nodes = ast.parse(text).body
            starts = [places[min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1] for n in nodes]
            how = "syntax"
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return "windows-after-failure", _hard_windows(text, 0, len(text), size, unit)
    elif language in BRACES and (found_starts := declaration_starts(text, language)) is not None:
        how, starts = "scopes", found_starts
    else:
        starts = [m.end() for m in re.finditer(r"\n[ \t]*\n+", text)]
    bounds = sorted({0, *starts, len(text)})
    found: list[tuple[int, int]] = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if found and measure(text[found[-1][0] : b]) <= size:
            found[-1] = (found[-1][0], b)
        elif measure(text[a:b]) <= size:
            found.append((a, b))
        else:
            found += _hard_windows(text, a, b, size, unit)
    return how, found


def code_language(path: str, given: str | None, text: str) -> str | None:
    """A language that was given, else by the first line, else by the path."""
    if given:
        return given.lower()
    if text.startswith("#!"):
        first = text.split("\n", 1)[0]
        for name, language in (("python", "python"), ("bash", "bash"), ("/sh", "bash"), ("node", "javascript"), ("ruby", "ruby")):
            if name in first:
                return language
    if given is None and path.lower().endswith((".md", ".markdown")):
        return None  # prose, whatever it holds
    return CODE_LANGUAGES.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "")


def realigned(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """(start, end) of pieces that a chunker gave back, found one after another whatever their case; an error where one isn't there."""
    low, at, found = text.lower(), 0, []
    if len(low) != len(text):  # small letters of another length: compare letter by letter
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for piece in pieces:
        wanted = "".join(c.lower() if len(c.lower()) == 1 else c for c in piece.strip())
        start = low.find(wanted, at)
        if start < 0:
            raise ValueError("a chunk's text isn't in its source")
        found.append((start, start + len(wanted)))
        at = start + len(wanted)
    return found


def word_offsets(texts: list[str]) -> list[list[tuple[int, int]]]:
    """A tokenizer of words between white space: where each token stands."""
    return [[m.span() for m in re.finditer(r"\S+", t)] for t in texts]


def tokenizer_offsets(path: str) -> Callable[[], Callable[[list[str]], list[list[tuple[int, int]]]]]:
    """A provider of token offsets from a tokenizer's file, loaded once in a worker process."""

    @provider(f"tokenizer:{path}")
    def load() -> Callable[[list[str]], list[list[tuple[int, int]]]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        return lambda texts: [e.offsets for e in tokenizer.encode_batch(texts, add_special_tokens=False)]

    return load


def token_windows(groups: DataFrame, offsets: Callable, size: int, overlap: int = 0, batch: int = 64) -> DataFrame:
    """Groups (document_id, group_no, text) in windows of at most `size` tokens, the last `overlap` of the one before among them.

    document_id, group_no, chunk_no, start, end, n_tokens, chunk_text. `offsets` is a tokenizer: for each text it gives
    its tokens' (start, end), or the pieces themselves, which are then looked for in the text. Windows begin and end where tokens do, so their
    places are exact. White space between tokens belongs to the window around it; texts without a token have no window.
    """
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("windows have a token at least, and overlap by fewer than they have")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenize = made(offsets)
        for frame in frames:
            for at in range(0, len(frame), batch):
                part, rows = frame.iloc[at : at + batch], []
                texts = part["text"].tolist()
                for doc, group, text, tokens in zip(part["document_id"], part["group_no"], texts, tokenize(texts), strict=True):
                    places = realigned(text, list(tokens)) if len(tokens) and isinstance(tokens[0], str) else tokens
                    for n, low in enumerate(range(0, max(1, len(places) - overlap) if len(places) else 0, size - overlap)):
                        own = places[low : low + size]
                        start, end = own[0][0], own[-1][1]
                        rows.append((doc, group, n, start, end, len(own), text[start:end]))
                yield pd.DataFrame(rows, columns=["document_id", "group_no", "chunk_no", "start", "end", "n_tokens", "chunk_text"])

    kind = groups.schema["document_id"].dataType.simpleString()
    return groups.select("document_id", "group_no", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(cut, f"document_id {kind}, group_no long, chunk_no int, start int, end int, n_tokens int, chunk_text string")


def chunk_groups(groups: DataFrame, policy: ChunkingPolicy, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Groups (document_id, group_no, kind, language, source_path, text) cut by the policy.

    document_id, group_no, chunk_no, start, end, chunk_text, chunker. A group is cut in one place, as a
    pack depends on the one before; documents are apart. For semantic chunks the topics of prose are found first,
    for all groups together.
    """
    columns = ["document_id", "group_no", "kind", "language", "source_path", "text", "sentences"]
    if policy.strategy == "semantic":
        if embed is None:
            raise ValueError("semantic chunking needs an embedding function")
        prose = groups.where("kind <> 'code'").select("document_id", "group_no", "text")
        found = semantic_boundaries(prose, embed, policy.semantic_threshold, policy.semantic_similarity_window)
        listed = found.groupBy("document_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("start", "end", "topic"))).alias("sentences"))
        groups = groups.join(listed, ["document_id", "group_no"], "left")
    else:
        groups = groups.withColumn("sentences", F.lit(None).cast("array<struct<start:int,end:int,topic:bigint>>"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, group, kind, language, path, text, sentences in frame[columns].itertuples(index=False, name=None):
                if kind == "code" and policy.preserve_code_blocks:
                    how, spans = code_spans(text, code_language(path or "", language, text), policy.target_size, policy.size_unit)
                elif kind != "code" and policy.strategy == "semantic":
                    how, spans = "semantic", semantic_spans(text, [(x["start"], x["end"], x["topic"]) for x in sentences], policy)
                else:
                    how, spans = "sentence", sentence_spans(text, policy.target_size, policy.overlap, policy.size_unit)
                rows += [(doc, group, n, a, b, text[a:b], how) for n, (a, b) in enumerate(spans) if text[a:b].strip()]
            yield pd.DataFrame(rows, columns=["document_id", "group_no", "chunk_no", "start", "end", "chunk_text", "chunker"])

    return groups.select(*columns).mapInPandas(cut, "document_id string, group_no long, chunk_no int, start int, end int, chunk_text string, chunker string")


def chunk_documents(blocks: DataFrame, policy: ChunkingPolicy, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Blocks (document_id, block_no, kind, text, source_path, language, page, section, line_start, char_start)
    as chunks with an ordinal in their document, an id and one merged location."""
    grouped = group_spans(prose_groups(blocks))
    about = grouped.groupBy("document_id", "group_no").agg(F.min("kind").alias("kind"), F.min("language").alias("language"), F.min("source_path").alias("source_path"))
    cut = chunk_groups(group_texts(grouped).join(about, ["document_id", "group_no"]), policy, embed)
    by = ["document_id", "group_no", "chunk_no"]
    places = merge_locations(project_spans(cut, grouped.select("document_id", "group_no", "block_no", "text", "page", "section", "line_start", "char_start", "span_start", "span_end")), *by)
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("group_no", "chunk_no")) - 1
    located = cut.join(places, by).withColumn("ordinal", ordinal)
    identity = F.substring(F.sha2(F.to_json(F.struct("chunk_text", "document_id", "ordinal", F.lit(policy.version).alias("policy"))), 256), 1, 16)
    return located.withColumn("chunk_id", F.concat("document_id", F.lit(":"), identity))


def suffix_language(path: Column) -> Column:
    """The code language of a path, by its suffix."""
    from ..functions.text import path_suffix

    return F.create_map(*[F.lit(x) for pair in CODE_LANGUAGES.items() for x in pair])[path_suffix(path)]
