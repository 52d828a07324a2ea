"""Text functions over columns: tokens, overlap, support, facts, claims, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The words that don't count as support for a claim.
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
TOKEN = r"[\p{L}\p{N}_.\-]+"


def fold(text: Column) -> Column:
    """Case folding: small letters, and ss for the sharp s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """Search terms in order: runs of letters, digits, underscores, dots and hyphens."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two arrays as sets; 0 where either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(left, right)))


def claim_terms(claim: Column) -> Column:
    return F.array_except(tokenize(claim), F.array(*map(F.lit, STOPWORDS)))


def has_support(claim: Column, text: Column) -> Column:
    """Whether enough of the claim's terms stand in the text: one of up to two, else half, rounded up."""
    terms = claim_terms(claim)
    need = F.when(F.size(terms) <= 2, F.lit(1)).otherwise(F.floor((F.size(terms) + 1) / 2))
    return (F.size(terms) > 0) & (F.size(F.array_intersect(terms, tokenize(text))) >= need)


def contains_fact(text: Column, fact: Column) -> Column:
    """Whether a fact that isn't blank stands in the text, whatever the case and white space."""
    wanted = collapse(fold(fact))
    return (wanted != "") & F.contains(collapse(fold(text)), wanted)


def fact_seed(fact: Column) -> Column:
    """The longest word of a fact that has a blank on either side there, so that it stands whole wherever the fact does; null without one."""
    words = F.split(collapse(fold(fact)), " ")
    inside = F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2))
    return F.element_at(F.array_sort(F.transform(inside, lambda w: F.struct(F.length(w).alias("n"), w.alias("word")))), -1)["word"]


def texts_with_facts(texts: DataFrame, facts: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) of texts (key, text) and the facts (name, fact) that they contain.

    A fact is looked for in texts that hold its seed as a word; one of two words or fewer, in all.
    """
    asked = facts.select(name, "fact", fact_seed(F.col("fact")).alias("seed"))
    words = texts.select(key, F.explode(F.array_distinct(F.split(collapse(fold(F.col("text"))), " "))).alias("seed"))
    seeds = asked.where("seed is not null")
    maybe = words.join(seeds.select(name, "seed"), "seed").select(key, name).join(texts.select(key, "text"), key).join(asked.select(name, "fact"), name)
    short = asked.where("seed is null").select(name, "fact").join(texts.select(key, "text"), F.lit(True), "inner")
    columns = [key, name, "text", "fact"]
    return maybe.select(*columns).union(short.select(*columns)).where(contains_fact(F.col("text"), F.col("fact"))).select(key, name)


def claim_before(text: Column, marker_start: Column) -> Column:
    """The claim of the marker that starts at a place (from 0): the end of the sentence before it."""
    fragment = F.regexp_extract(F.substring(text, F.lit(1), marker_start), r"[^.!?\n]*$", 0)
    return F.regexp_replace(F.regexp_replace(fragment, r"\[[^\[\]\s]+\]", ""), r"^[ ,;:\-]+|[ ,;:\-]+$", "")


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def path_suffix(path: Column) -> Column:
    """The small-letter suffix of a path's last part, with its dot; empty without one."""
    tidy = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"/+$", "")
    return F.lower(F.regexp_extract(tidy, r"[^/]*[^/](\.[^./]+)$", 1))


def safe_path(path: Column) -> Column:
    """A relative path without parts that lead elsewhere; null where nothing is left."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.array_join(F.filter(parts, lambda p: ~p.isin("", ".", "..")), "/")
    return F.when(kept != "", kept)


def bytes_to_chars(text: Column, n_bytes: Column) -> Column:
    """How many characters the first so many UTF-8 bytes are."""
    return F.length(F.decode(F.substring(F.encode(text, "UTF-8"), F.lit(1), n_bytes), "UTF-8"))
