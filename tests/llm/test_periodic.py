import random
import re

import numpy as np
import pytest

from quillspan.llm import periodic
from quillspan.llm.periodic import find_runs, run_digests, runs_by_words, runs_of


def brute(ids, least, times):
    found = {}
    for p in range(1, len(ids) // times + 1):
        i = 0
        while i + p < len(ids):
            j = i
            while j + p < len(ids) and ids[j] == ids[j + p]:
                j += 1
            if j - i + p >= max(least, times * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, count):
    draw = random.Random(seed)
    for _ in range(count):
        n, words = draw.choice((0, 1, 5, 24, 30, 80, 200)), draw.choice((1, 2, 3, 50))
        ids = [draw.randrange(words) for _ in range(n)]
        for _ in range(draw.randrange(3)):
            if n > 10:
                a, p = draw.randrange(n), draw.randint(1, max(1, n // 4))
                ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(n)]
        yield ids


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 4)])
def test_runs_equal_comparing_every_distance(least, times):
    for ids in sequences(least, 200):
        want = brute(ids, least, times)
        assert [tuple(r) for r in runs_of(np.array(ids, np.int64), least, times).tolist()] == want
        assert [tuple(r) for r in runs_by_words(np.array(ids, np.int64), least, times).tolist()] == want


def test_long_run_in_many_slabs(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 1000)
    ids = np.concatenate((np.arange(50), np.tile(np.arange(100, 107), 400), [5]))
    assert runs_of(ids).tolist() == [[50, 2800, 7]]


def test_hash_that_misleads_is_found_out(monkeypatch):
    ids = np.array([x for seq in sequences(3, 6) for x in seq], np.int64)
    want = runs_of(ids).tolist()
    monkeypatch.setattr(periodic, "mix64", lambda x: x % np.uint64(2))  # next to no word differs by its hash
    assert runs_of(ids).tolist() == want and want


def test_texts(spark):
    again = "a b c d " * 9
    rows = [(1, None), (2, ""), (3, " \t"), (4, again), (4, again), (None, "x\x0b" * 30), (5, "Ä é é " * 20), (6, "one two three")]
    df = spark.createDataFrame([(k, t, "other", 1) for k, t in rows], "doc_id long, text string, runs string, collapsed int")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in find_runs(df).collect()]
    assert got == [
        (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, 36, [(0, 36, 4)], "a b c d"), (4, 36, [(0, 36, 4)], "a b c d"),
        (None, 30, [(0, 30, 1)], "x"), (5, 40, [(0, 40, 2)], "Ä é é"), (6, 3, [], "one two three"),
    ]
    digests = run_digests(find_runs(df)).collect()
    assert all(r.runs_sha256 and r.collapsed_sha256 for r in digests)
    assert [(r.n_runs, r.start, r.period, r.exponent_milli) for r in digests[3:4]] == [(1, 0, 4, 9000)] and digests[0].length is None
    assert find_runs(df.limit(0)).count() == 0


def test_greatest_exponent_and_ties(spark):
    rows = [(1, [(0, 30, 10), (40, 24, 2), (70, 48, 4), (200, 12, 1)], ""), (2, [], "")]
    got = run_digests(spark.createDataFrame(rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")).collect()
    assert (got[0].start, got[0].length, got[0].period, got[0].exponent_milli) == (40, 24, 2, 12000)
    assert got[1].start is None and got[1].exponent_milli is None


def test_planted_runs(spark):
    draw = random.Random(9)
    texts = [(k, " ".join(draw.choice("abcdefgh") for _ in range(draw.choice((0, 1, 2, 7, 90))))) for k in range(150)] + [(None, "p q")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    from pyspark.sql import functions as F
    import zlib

    for r in df.select("doc_id", "text", periodic.with_planted_run(F.col("doc_id"), F.col("text")).alias("planted")).collect():
        words, want = re.findall(periodic.WORD, r.text), r.text
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        assert r.planted == want
