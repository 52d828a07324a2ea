"""Embedding and term-weight providers as tables: functions over texts, or factories that make one, once in each worker process."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64


#: What factories have made in this process, by their version.
_MADE: dict[str, Callable] = {}


def provider(version: str) -> Callable[[Callable[[], Callable]], Callable[[], Callable]]:
    """Mark a factory (a model's loader) with the version of what it makes."""

    def mark(factory: Callable[[], Callable]) -> Callable[[], Callable]:
        factory.factory, factory.version = True, version
        return factory

    return mark


def made(given: Callable) -> Callable:
    """The function of a provider. A factory with a version is called once in a process, whatever the number of tasks; one without, in each task."""
    if not getattr(given, "factory", False):
        return given
    version = getattr(given, "version", None)
    if version is None:
        return given()
    if version not in _MADE:
        _MADE[version] = given()
    return _MADE[version]


def embedded_texts(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """key, vector, error of texts (key, text), in batches over all of them; of a batch that fails, each text is tried by itself."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made(embed)

        def one(text: list[str]) -> list[list[float]]:
            vectors = [[float(x) for x in v] for v in model(text)]
            if len(vectors) != len(text):
                raise ValueError("embedding provider must return one vector per chunk")
            return vectors

        for frame in frames:
            for part in _batches(frame, batch):
                texts = part["text"].tolist()
                try:
                    rows = [(v, None) for v in one(texts)]
                except Exception:
                    rows = []
                    for text in texts:
                        try:
                            rows.append((one([text])[0], None))
                        except Exception as error:  # a text that fails is a row of its own
                            rows.append((None, str(error) or type(error).__name__))
                yield pd.DataFrame({"key": part["key"].to_numpy(), "vector": [v for v, _ in rows], "error": [e for _, e in rows]})

    return texts.select("key", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "key string, vector array<double>, error string")


def _batches(frame: pd.DataFrame, batch: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(frame), batch):
        yield frame.iloc[at : at + batch]


def embedded(rows: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]], batch: int = BATCH) -> DataFrame:
    """(key, vector) of rows (key, text); a provider that doesn't give one vector for each text is an error. Null texts count as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made(embed)
        for frame in frames:
            for part in _batches(frame, batch):
                vectors = [[float(x) for x in v] for v in model(part["text"].tolist())]
                if len(vectors) != len(part):
                    raise ValueError("embedding provider must return one vector per text")
                yield pd.DataFrame({key: part["key"].to_numpy(), "vector": vectors})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, f"{key} {kind}, vector array<double>")


def weighted(rows: DataFrame, key: str, text: str, encode: Callable[[list[str]], list[Mapping[str, float]]], batch: int = BATCH) -> DataFrame:
    """(key, term, weight) of rows (key, text) by a learned sparse encoder, which gives the weights of each text's terms."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = made(encode)
        for frame in frames:
            for part in _batches(frame, batch):
                found = list(model(part["text"].tolist()))
                if len(found) != len(part):
                    raise ValueError("sparse encoder must return the weights of each text")
                listed = [(k, term, float(w)) for k, weights in zip(part["key"], found, strict=True) for term, w in weights.items() if w]
                yield pd.DataFrame(listed, columns=[key, "term", "weight"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, f"{key} {kind}, term string, weight double")
