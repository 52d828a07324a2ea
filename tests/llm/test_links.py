import random
import re

import numpy as np
import pytest

from quillspan.llm import jaccard, vectors
from quillspan.llm.graph import components, local_components
from quillspan.llm.shingles import shingle_sets


def groups(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(x) for x in range(n)]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_components(spark):
    draw = random.Random(3)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(300, 420)]
    want = groups(421, links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(want[a] == c for a, c in got.items()) and set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert local_components(421, np.array([a for a, _ in links]), np.array([b for _, b in links])).tolist() == want


def test_shingles_fold_and_cut():
    sets = shingle_sets(["A b C", "a\tB\nc", "a b", None, "", " \x0b", "a b c a b c", "Ä b c", "ä b c"], 3)
    assert sets[0].tolist() == sets[1].tolist() and [len(s) for s in sets] == [1, 1, 1, 0, 0, 0, 3, 1, 1]
    assert sets[7].tolist() != sets[8].tolist() and sets[2].tolist() != sets[0].tolist()


def corpus(seed, n=260):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [None, "", " \t", "one", "one", "two words", "Two  words"]
    while len(texts) < n:
        if draw.random() < 0.6 and len(texts) > 10:
            words = (draw.choice(texts[3:]) or "").split()
            for _ in range(draw.randint(0, 1 + len(words) // 25)):
                if words:
                    words[draw.randrange(len(words))] = draw.choice(vocabulary)
        else:
            words = [draw.choice(vocabulary) for _ in range(draw.choice((3, 8, 30, 120, 400)))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("k", "num", "den", "seed"), [(3, 90, 100, 1), (5, 80, 100, 2), (1, 7, 10, 3), (2, 1, 1, 4)])
def test_jaccard_join_equals_brute_force(spark, k, num, den, seed):
    texts = corpus(seed)
    sets = [shingles(t, k) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    want = groups(len(texts), links)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, tokens string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, words=k, num=num, den=den, tile=8).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_links_come_by_both_routes(spark):
    df = spark.createDataFrame(list(enumerate(corpus(2, 400))), "doc_id long, text string")
    _, _, links = jaccard.set_links(df, words=5, num=80, den=100, tile=8)
    found = {r.route: r["count"] for r in links.groupBy("route").count().collect()}
    assert found["pivot"] > 0 and found["group"] > 0


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, "A b c D")], "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard.jaccard_components(df).collect()) == [4] * 4
    assert jaccard.jaccard_components(df.where("false")).count() == 0
    kept = jaccard.one_of_each(df.selectExpr("doc_id", "text", "1 as copies"))
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 4, 4] and kept.columns == ["doc_id", "text", "copies"]
    with pytest.raises(ValueError):
        jaccard.Parts(1, 2)


def test_rows_with_a_null_key_bridge(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(7, " ".join([*words[:-1], "x"])), (None, " ".join(words)), (3, " ".join(["y", *words[1:]])), (9, "far away from all of them"), (None, "alone " * 5)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=93, den=100).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id is not None) == [(0, 3), (3, 3), (7, 3), (9, 9)]
    assert len(got) == 5


def test_open_tile_counts_in_slices():
    draw = np.random.default_rng(0)
    sets = [np.unique(draw.integers(0, 3000, 900).astype(np.uint64)) for _ in range(6)]
    sets += [np.unique(np.concatenate((s[: len(s) - 20], draw.integers(0, 3000, 10).astype(np.uint64)))) for s in sets]
    i, j = jaccard.open_tile(sets, sets, 90, 100)
    want = {(a, b) for a in range(12) for b in range(12) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize(("d", "tile"), [(3, 16), (24, 64), (1, 8)])
def test_vectors_equal_brute_force(spark, d, tile):
    draw = np.random.default_rng(d)
    x = draw.normal(size=(150, d))
    x = np.concatenate([x, x[:60] + 0.12 * draw.normal(size=(60, d)), x[:20], 3 * x[20:30]]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = groups(len(x), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    bad = [None, [0.0] * d, [float("nan")] + [1.0] * (d - 1), [None] + [1.0] * (d - 1), [float("inf")] * d, [1.0] * (d + 1), [1.0] * (d + 1)]
    rows = [(i, v.tolist(), 1, "s") for i, v in enumerate(x)] + [(1000 + i, v, 1, "s") for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, tile string")
    got = {r.vec_id: r for r in vectors.near_vectors(df, tile=tile).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(len(x))] == [(int(near[i].sum()), want[i]) for i in range(len(x))]
    assert [(got[1000 + i].n_links, got[1000 + i].component_id) for i in range(7)] == [(0, 1000 + i) for i in range(5)] + [(1, 1005), (1, 1005)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_very_large_and_small_components(spark):
    rows = [(1, [1e300, 1e300]), (2, [1.0, 1.0]), (3, [1e-300, 1.1e-300]), (4, [-1e300, 1e300]), (5, [5e-324, 5e-324])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_very_long_texts_and_a_hot_group(spark):
    draw = random.Random(8)
    long = [f"v{draw.randrange(5000)}" for _ in range(20_000)]
    base = [f"b{draw.randrange(500)}" for _ in range(60)]
    texts = [" ".join(long), " ".join([*long[:-300], *reversed(long[-300:])]), " ".join([*long, *base]), " ".join(long[:9_000])]
    for i in range(400):  # a third and more of the rows are one group, whose members are near to the base alone
        words = list(base)
        words[draw.randrange(60)] = f"e{i}"
        texts.append(" ".join(words))
    texts += [" ".join(base)] * 50 + [" ".join([*base[:30], *(f"c{draw.randrange(900)}" for _ in range(30))]) for _ in range(300)]
    sets = [shingles(t, 3) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    common = {}
    for rows in where.values():
        for a in rows:
            for b in rows:
                if b < a:
                    common[a, b] = common.get((a, b), 0) + 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n)]
    want = groups(len(texts), links)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, tile=64).collect()}
    assert got == {i: (len(s), want[i]) for i, s in enumerate(sets)}


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    texts = [" ".join(f"{c}{i}" for i in range(12)) for c in "pqrs"] + ["p0 p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11"]
    monkeypatch.setattr(jaccard, "set_id", lambda hashes: (5, int(hashes[0]) >> 1))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(r.component_id for r in jaccard.jaccard_components(df).collect()) == [0, 0, 1, 2, 3]
