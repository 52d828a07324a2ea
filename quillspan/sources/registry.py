"""Parsers by what they support: the first that takes a file reads it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a parser gives back for each block of a file, or for the error that stands in its place.
BLOCKS = ("source_path", "block_no", "kind", "text", "page", "section", "line_start", "char_start", "error")
UNSUPPORTED = "no parser for this kind of file"


class Parsers:
    """Parsers in the order in which they are asked; each takes files (path, media_type, content) to BLOCKS."""

    def __init__(self) -> None:
        self._known: list[tuple[str, Callable[[Column, Column], Column], Callable[[DataFrame], DataFrame]]] = []

    def register(self, name: str, supports: Callable[[Column, Column], Column], parse: Callable[[DataFrame], DataFrame], first: bool = False) -> Parsers:
        """supports(path, media_type) says whether a parser takes a file; `first` asks it before those there are."""
        self._known.insert(0 if first else len(self._known), (name, supports, parse))
        return self

    def parser_of(self, path: Column, media_type: Column) -> Column:
        """The name of the parser that takes a file; null without one."""
        return F.coalesce(*[F.when(supports(path, media_type), name) for name, supports, _ in self._known], F.lit(None).cast("string"))

    def parse(self, files: DataFrame) -> DataFrame:
        """The blocks of all files (path, media_type, content); a file that none takes is an error row."""
        routed = files.withColumn("_parser", self.parser_of(F.col("path"), F.col("media_type")))
        found = [parse(routed.where(F.col("_parser") == name).drop("_parser")).select(*BLOCKS) for name, _, parse in self._known]
        types = ("string", "int", "string", "string", "int", "string", "int", "int", "string")
        values = {"source_path": F.col("path"), "error": F.lit(UNSUPPORTED)}
        rest = routed.where("_parser is null").select(*[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in zip(BLOCKS, types, strict=True)])
        return reduce(DataFrame.unionByName, [*found, rest])
