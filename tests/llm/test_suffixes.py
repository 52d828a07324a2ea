import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspan.llm import suffixes
from quillspan.llm.suffixes import SuffixFamily, first_of_each, without_repeats


def brute(rows, least):
    """Per row: spans of bytes that a window covers which starts earlier; rows of one key and text are one document."""
    place = lambda r: (-(2**63) if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()) & suffixes.TAG)
    first = {}
    texts = {place(r): (r[1] or "").encode() for r in rows}
    for where in sorted(texts):
        for i in range(len(texts[where]) - least + 1):
            first.setdefault(texts[where][i : i + least], (where, i))
    found = []
    for r in rows:
        t, cover = (r[1] or "").encode(), set()
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] != (place(r), i):
                cover |= set(range(i, i + least))
        edges = sorted(cover)
        spans = [(a, b) for a, b in zip([x for x in edges if x - 1 not in cover], [x + 1 for x in edges if x + 1 not in cover], strict=True)]
        found.append((r[0], len(t), [(a, b - a) for a, b in spans], bytes(c for k, c in enumerate(t) if k not in cover)))
    return found


def run(spark, rows, least, batches=suffixes.BATCHES):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, spans string, n int")
    got = [(r.doc_id, r.n_bytes, [(s.start, s.length) for s in r.spans], bytes(r.kept)) for r in without_repeats(df, least=least, batches=batches).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[2]))
    assert order(got) == order(brute(rows, least))
    return got


def corpus(draw, n):
    """Prose with copies, passages that many share, edits, loops and characters of several bytes."""
    words = "alpha beta gamma delta épsilon zeta eta theta iota kappa λάμδα mu nu xi omicron pi rho".split()
    prose = lambda k: " ".join(draw.choice(words) + draw.choice(("", "", "s", str(draw.randrange(900)))) for _ in range(k))
    shared, rows = [prose(draw.choice((4, 9, 30))) for _ in range(6)], []
    for k in range(n):
        text = prose(draw.choice((0, 3, 12, 40)))
        if rows and draw.random() < 0.3:
            text = draw.choice(rows)[1] or ""
            cut = draw.randrange(len(text) + 1)
            text = draw.choice((text, text[:cut] + "!" + text[cut:], text[cut:] + text[:cut]))
        if draw.random() < 0.4:
            cut = draw.randrange(len(text) + 1)
            text = text[:cut] + draw.choice(shared) + text[cut:]
        rows.append((k * 7 % n, text + draw.choice(("", "", "ab" * draw.randrange(60), "z" * draw.randrange(90)))))
    return rows


@pytest.mark.parametrize("least,batches", [(16, 1), (20, 5), (100, 4)])
def test_equals_brute_force(spark, least, batches):
    run(spark, corpus(random.Random(least), 120), least, batches)


def test_nulls_repeats_and_short_texts(spark):
    text = "the same passage in every one of these rows, and long enough to be found"
    got = run(spark, [(3, text), (3, text), (None, text), (5, None), (6, ""), (7, "short"), (3, "another text of the key: " + text), (-2, text[10:]), (2**60, text * 3)], 20)
    assert [r[2] for r in got if r[0] is None] == [[]] and (5, 0, [], b"") in got
    assert run(spark, [(1, None), (2, "")], 20) and run(spark, [(1, "a" * 400)], 100)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_one_string_among_many_surroundings(spark):
    draw = random.Random(5)
    other = lambda: "".join(draw.choice("abcdefghijklmnop") for _ in range(draw.choice((2, 9, 40))))
    rows = [(k, f"{other()} one line that hundreds of texts have in common {other()}") for k in range(700)]
    run(spark, rows, 40)
    made = list(suffixes._suffixes(40)(iter([pa.record_batch({"doc": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]})])))
    assert any(len(b) and b.column(0)[0].as_py() == suffixes.OPENED for b in made)


def test_every_window_is_in_one_row_however_texts_are_cut(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = corpus(random.Random(8), 40) + [(99, "".join(random.Random(1).choice("ab") for _ in range(5000)))]
    batch = pa.record_batch({"doc": pa.array([k for k, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    seen, classes = defaultdict(list), {}
    texts = {(k, zlib.crc32(t.encode()) & suffixes.TAG): t.encode() for k, t in rows}
    for out in suffixes._suffixes(30)(iter([batch])):
        for kind, a, b, doc, at, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
            where, low = (doc, at >> suffixes.PLACE_BITS), at & ((1 << suffixes.PLACE_BITS) - 1)
            seen[where] += range(low, low + n)
            if kind == suffixes.SUFFIX:
                assert classes.setdefault((a, b), texts[where][low : low + n + 29]) == texts[where][low : low + n + 29]
    for where, text in texts.items():
        assert sorted(seen[where]) == list(range(max(0, len(text) - 29)))


def test_first_of_each():
    a, b = np.array([1, 1, 1, 2, 1]), np.array([5, 5, 6, 5, 5])
    first, repeat = first_of_each(a, b, np.array([9, 3, 0, 0, 3]), np.array([0, 4, 0, 0, 4]))
    assert first.tolist() == [False, True, True, True, False] and repeat.tolist() == [True, False, False, False, False]


def test_levels_of_equal_size_merge(spark):
    family, sizes = SuffixFamily(spark, 40), []
    draw = random.Random(2)
    for k in range(6):
        family.add(spark.createDataFrame([(k * 100 + j, "".join(draw.choice("abcdef") for _ in range(120))) for j in range(4)], "doc long, text string"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]]
    level = spark.table(family.levels[0][1])
    assert level.select(F.countDistinct(F.col("doc") % 100, F.floor(F.col("doc") / 100))).first()[0] == 16
    names = [t for _, t in family.levels]
    family.close()
    assert not any(spark.catalog.tableExists(t) for t in names)


def test_scans_of_levels_shuffle_nothing(spark):
    family = SuffixFamily(spark, 40)
    for k in range(2):
        family.add(spark.createDataFrame([(k, "x" * 60)], "doc long, text string"))
    (_, one), (_, two) = family.levels
    with suffixes.setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = family._suffixes_of(one).join(family._suffixes_of(two).select("a"), "a", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    family.close()
