import random

import numpy as np
import pytest

from quillspan.llm import decontam, language, sharding

WORDS = {"aa": "ka lo mi rana tolu besi".split(), "bb": "shre tchu vorn plix grud skre".split()}


def told(draw, lang, n):
    return " ".join(draw.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    draw = random.Random(0)
    rows = [(i, told(draw, lang, draw.randint(5, 60)), lang, "x") for i in range(300) for lang in ("aa", "bb")]
    return spark.createDataFrame(rows + [(900, None, "aa", "x"), (901, "123", "aa", "x"), (902, "ka lo", None, "x")], "doc_id long, text string, lang string, lang_pred string")


def test_languages_are_told_apart(spark, labelled):
    models = language.fit_models(labelled)
    draw = random.Random(1)
    rows = [(i, told(draw, lang, 8), lang) for i in range(50) for lang in ("aa", "bb")] + [(0, None, "und"), (0, "", "und"), (0, "12 !?", "und"), (0, "Ka LO mi " * 9000, "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = language.identify(df, models).collect()
    assert all(r.lang_pred == r.want and 0 <= r.lang_score <= 1 for r in got)
    assert all(r.lang_rejected == (r.want == "und") for r in got)
    strange = language.identify(spark.createDataFrame([("日本語の文章です " * 5,)], "text string"), models).first()
    assert strange.lang_rejected and strange.lang_pred in WORDS
    kept = language.accepted(labelled, models)
    assert kept.columns == labelled.columns and kept.count() == 601
    assert language.identify(df.where("false"), models).count() == 0


def test_languages_of_long_texts_keep_their_models(spark, labelled):
    draw = random.Random(5)
    rows = [(1, "12 34 " * 20_000 + " ".join(draw.choice("wox yfi zug qalm jeth".split()) for _ in range(30_000)), "cc", "x"), (2, "dirn vash ulmo peth kaar " * 20_000, "dd", "x")]
    models = language.fit_models(labelled.union(spark.createDataFrame(rows, labelled.schema)), chars=80_000)
    assert models.languages == ["aa", "bb", "cc", "dd"]
    got = models.predict(["zug qalm wox jeth yfi", "vash ulmo peth kaar dirn", told(draw, "aa", 8), told(draw, "bb", 8)])
    assert [g[0] for g in got] == ["cc", "dd", "aa", "bb"] and not any(g[3] for g in got)


def test_a_share_is_filled_from_few_texts(spark):
    rows = [("aa", f"ka lo {'mi ' * 300}{i}") for i in range(40)] + [("bb", "shre " * 50)] * 30
    got = language.sample_texts(spark.createDataFrame(rows, "lang string, text string"), 8_000)
    sizes = got.assign(n=got["text"].str.len()).groupby("lang")["n"].sum()
    assert sizes["aa"] == 4_000 and sizes["bb"] == 250


def test_any_number_of_languages(spark):
    draw = random.Random(6)
    words = {f"l{k:03}": ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(4, 7))) for _ in range(8)] for k in range(210)}
    rows = [(" ".join(draw.choice(v) for _ in range(60)), k) for k, v in words.items() for _ in range(8)]
    models = language.fit_models(spark.createDataFrame(rows, "text string, lang string"))
    assert models.languages == sorted(words)
    got = models.predict([" ".join(draw.choice(v) for _ in range(20)) for v in words.values()])
    assert [g[0] for g in got] == sorted(words) and not any(g[3] for g in got)


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "ka lo", None)], "doc_id long, text string, lang string")
    assert language.fit_models(df) is None
    assert language.identify(df, None).first().lang_pred == "und"
    assert language.accepted(df, None).count() == 1


def test_models_are_distributions():
    draw = random.Random(2)
    rows = [[language.symbols(told(draw, lang, 40)) for _ in range(20)] for lang in WORDS]
    models = language.Models(list(WORDS), rows)
    alphabet = sorted({int(c) for r in rows for s in r for c in s})
    for context in ([0] * 4, rows[0][0][:4].tolist(), [alphabet[1]] * 4):
        flat = np.array([[*context, c] for c in alphabet], np.uint32)
        logs = np.concatenate([models._logs([h[-1:] for h in g], [h[-2:-1] for h in g]) for g in map(language.grams, flat)])
        unseen = language.grams(np.array([*context, 60000], np.uint32))
        rest = models._logs([h[-1:] for h in unseen], [h[-2:-1] for h in unseen]).astype(np.float64)[0]
        total = (2.0 ** logs.astype(np.float64)).sum(axis=0) + 2.0**rest
        assert total == pytest.approx([1.0, 1.0], abs=1e-3)


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries, from its definition."""

    def __init__(self, rows, width, order=5):
        self.order, self.width, self.levels = order, width, {}
        types = {}
        for row in rows:
            padded = [0] * (order - 1) + [int(c) for c in row]
            for end in range(order - 1, len(padded)):
                gram = tuple(padded[end - order + 1 : end + 1])
                types[gram] = types.get(gram, 0) + 1
        for k in range(order, 0, -1):
            once, twice = (sum(c == n for c in types.values()) for n in (1, 2))
            discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
            total, kinds = {}, {}
            for gram, c in types.items():
                total[gram[:-1]] = total.get(gram[:-1], 0) + c
                kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
            self.levels[k] = types, total, kinds, discount
            lower = {}
            for gram in types:  # below, how many symbols stand before
                lower[gram[1:]] = lower.get(gram[1:], 0) + 1
            types = lower

    def chance(self, gram):
        k = len(gram)
        if not k:
            return 1 / self.width
        types, total, kinds, discount = self.levels[k]
        below = self.chance(gram[1:])
        if gram[:-1] not in total:
            return below
        n = total[gram[:-1]]
        return max(0, types.get(gram, 0) - discount) / n + discount * kinds[gram[:-1]] / n * below

    def bits(self, row):
        padded = [0] * (self.order - 1) + [int(c) for c in row]
        return -sum(np.log2(self.chance(tuple(padded[e - self.order + 1 : e + 1]))) for e in range(self.order - 1, len(padded))) / len(row)


def test_models_equal_plain_kneser_ney():
    draw = random.Random(9)
    rows = [[language.symbols(told(draw, lang, 30)) for _ in range(12)] for lang in WORDS]
    models = language.Models(list(WORDS), rows)
    width = len({int(c) for r in rows for s in r for c in s}) + 1
    plain = [PlainKneserNey(r, width) for r in rows]
    asked = [language.symbols(t) for t in (told(draw, "aa", 9), told(draw, "bb", 9), "ka shre tolux besi", "日本 vorn", "a")]
    want = [[m.bits(r) for m in plain] for r in asked]
    assert models.bits(asked) == pytest.approx(np.array(want), abs=1e-4)
    assert [g[0] for g in models.predict(["ka lo mi", "shre vorn", ""])] == ["aa", "bb", "und"]


def test_ties_go_to_the_first_language(spark):
    rows = [(t, lang) for lang in ("zz", "yy") for t in ["ka lo mi rana tolu " * 3] * 8]
    models = language.fit_models(spark.createDataFrame(rows, "text string, lang string"))
    assert models.predict(["ka lo mi"])[0][0] == "yy"


def nearest(item, words):
    row = [0] * (len(words) + 1)
    for n, w in enumerate(item, 1):
        new = [n]
        for j, x in enumerate(words, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_leaks_equal_brute_force(spark):
    draw = random.Random(4)
    vocabulary = [f"tok{i}" for i in range(400)]
    items = [" ".join(draw.choice(vocabulary) for _ in range(n)) for n in (1, 3, 5, 8, 12, 20, 31, 45, 60)]
    texts = []
    for i in range(240):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 80))]
        if i % 2:
            inside = draw.choice(items).split()
            for _ in range(draw.randint(0, max(1, len(inside) // 4))):
                at, how = draw.randrange(len(inside)), draw.random()
                if how < 0.4:
                    inside[at] = draw.choice(vocabulary)
                elif how < 0.7:
                    inside.insert(at, draw.choice(vocabulary))
                elif len(inside) > 1:
                    del inside[at]
            at = draw.randint(0, len(words))
            words[at:at] = inside
        texts.append(" ".join(words).upper() if i % 5 == 0 else ", ".join(words))
    want = {}
    for d, t in enumerate(texts):
        words = [w.strip(",").lower() for w in t.split()]
        for k, item in enumerate(items):
            if words and (n := nearest(item.split(), words)) <= int(0.2 * len(item.split()) + 1e-9):
                want[d, k] = n
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, leaks string")
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "?!")], "item_id long, text string")
    rows = decontam.find_leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.98 * len(want)
    assert {k for k, v in want.items() if v == 0} <= set(got)
    for r in rows:
        if r.distance == 0:
            assert [w.strip(",").lower() for w in texts[r.doc_id][r.start_char : r.end_char].split()] == items[r.item_id].split()
    kept = decontam.without_leaks(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in [*range(240), 900, 901] if i not in {d for d, _ in got}}
    assert decontam.find_leaks(docs, bench.where("false")).count() == 0 == decontam.find_leaks(docs.where("false"), bench).count()


def test_very_long_items_and_texts(spark):
    draw = random.Random(5)
    item = [f"i{draw.randrange(3000)}" for _ in range(2500)]
    near = [w if draw.random() > 0.15 else f"o{i}" for i, w in enumerate(item)]
    far = [w if draw.random() > 0.5 else f"o{i}" for i, w in enumerate(item)]
    filler = [f"f{draw.randrange(9000)}" for _ in range(20_000)]
    texts = [" ".join(x) for x in (filler + item, [*filler[:500], *near, *filler], far, filler, item[:1200])]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "alone")], "item_id long, text string")
    found = decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(0, 1), (1, 1)} and min(r.distance for r in found) == 0


def test_recall_of_edited_items():
    """The LSH alone: of windows with all edits made that are allowed, the share that meets a key."""
    draw = np.random.default_rng(7)
    words = [f"tok{i}" for i in range(3000)]
    items = [" ".join(draw.choice(words, n)) for n in draw.integers(15, 60, 60)]
    ready = decontam.Benchmark(list(range(60)), items, 0.2, 0.99, 3)
    caught = tried = 0
    for i, item in enumerate(items):
        for _ in range(5):
            text = item.split()
            for _ in range(ready.edits[i]):
                at, how = int(draw.integers(len(text))), int(draw.integers(3))
                text[at : at + (how != 1)] = [] if how == 0 else [f"x{draw.integers(10**9)}"]
            hashes, _, _, bounds, _ = decontam.split_words([" ".join([*draw.choice(words, 30), *text, *draw.choice(words, 30)])])
            tried += 1
            caught += any(j == i for _, j, _, _ in ready.candidates(hashes, bounds))
    assert caught >= 0.97 * tried


def test_recall_out_of_reach_is_an_error():
    with pytest.raises(ValueError, match="out of reach"):
        decontam.Benchmark([1], ["a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2], 0.8, 0.999, 3)


def test_words_of_any_script():
    def words(text):
        _, starts, ends, _, _ = decontam.split_words([text])
        return [text[a:b] for a, b in zip(starts, ends, strict=True)]

    assert words("日本語、テスト") == list("日本語テスト")
    assert words("a\u00a0b “c” «d»—e") == list("abcde")
    assert words("ที่ नमस्ते 한국어 x1 \u2764\ufe0f \U00020000y") == ["ที่", "नमस्ते", "한국어", "x1", "\U00020000", "y"]
    first, second = (decontam.split_words([t])[0].tolist() for t in ("ПРИВЕТ ΜΊΑ École", "привет μία école"))
    assert first == second and len(set(first)) == 3
    hashes, starts, _, bounds, at = decontam.split_words(["a b", None, "", "\u0301c d"])
    assert bounds.tolist() == [0, 2, 2, 2, 4] and (starts - at[[0, 0, 3, 3]]).tolist() == [0, 2, 1, 3]
    assert [len(x) for x in decontam.split_words([])[:3]] == [0, 0, 0]


def test_leaks_of_any_script(spark):
    items = [(1, "春天的花园里有许多美丽的花朵"), (2, "Привет мир дорогие друзья"), (3, "quick brown fox jumps")]
    texts = ["昨天我说：春天的花园里有许多美丽的花朵，真的很好看。", "да ПРИВЕТ МИР ДОРОГИЕ ДРУЗЬЯ да", "“quick\u00a0brown fox—jumps” up", "昨天我们去了别的地方看电影和吃饭"]
    found = decontam.find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.distance, texts[r.doc_id][r.start_char : r.end_char]) for r in found} == {(0, 1, 0, items[0][1]), (1, 2, 0, items[1][1].upper()), (2, 3, 0, "quick\u00a0brown fox—jumps")}


def test_shards_move_only_into_the_new_one(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7), "x") for i in range(3000)] + [(None, "a", "x"), (5, "b", "x"), (5, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    got = sharding.assign_shards(df, 24).collect()
    assert len(got) == len(rows)
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(24))
    assert max(map(len, by.values())) < 1.5 * 3003 / 24
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.assign_shards(df.where("false"), 24).count() == 0


def plain_shard(key, tree):
    """A key's descent, from its definition: the least exponential draw at each level."""
    import math
    import struct

    import xxhash

    def draw(level, place, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
        for part in (level, place):
            seed = xxhash.xxh64_intdigest(part.encode(), seed)
        return -math.log(((seed >> 11) + 0.5) / 2.0**53) / weight

    def least(level, places):
        return min(places, key=lambda p: (draw(level, p, places[p]), p))

    weight = lambda keep: sum(x.weight for x in tree if keep(x))
    region = int(least("region", {str(r): weight(lambda x, r=r: x.region == r) for r in {x.region for x in tree}}))
    rack = int(least("rack", {f"{region}/{k}": weight(lambda x, k=k: (x.region, x.rack) == (region, k)) for k in {x.rack for x in tree if x.region == region}}).split("/")[1])
    return int(least("shard", {str(x.shard): x.weight for x in tree if (x.region, x.rack) == (region, rack)}))


def test_shards_equal_brute_force(spark):
    import zlib

    texts = [None, "", "é", "same", "same", "long " * 50_000]
    rows = [(i, texts[i % 6]) for i in range(600)] + [(None, "x"), (7, "tie"), (7, "tie")]
    tree = sharding.even_tree(24)
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 24).collect()
    body = lambda t: (t or "").encode()
    want = sorted((k is not None, k or 0, len(body(t)) + 8, zlib.crc32(body(t)), plain_shard(k, tree), plain_shard(k, sharding.grow(tree, 24))) for k, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == want


def test_a_grown_tree_moves_rows_only_into_the_new_shard(spark):
    from pyspark.sql import functions as F

    tree = [sharding.Leaf(0, 0, 0, 2.0), sharding.Leaf(0, 1, 1), sharding.Leaf(1, 0, 2), sharding.Leaf(1, 0, 3, 5.0)]
    again = sharding.grow(sharding.grow(tree, 4, 3.0), 5)
    rows = spark.range(6000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), sharding.grow(tree, 4, 3.0)).alias("b"), sharding.shard_of(F.col("id"), again).alias("c")).collect()
    assert all(r.b in (r.a, 4) and r.c in (r.b, 5) for r in rows)
    assert sum(r.b == 4 for r in rows) / 6000 == pytest.approx(3 / 12, abs=0.03)


def test_weights_count_and_confine_movement(spark):
    tree = [sharding.Leaf(0, 0, 0), sharding.Leaf(0, 1, 1, 3.0), sharding.Leaf(1, 0, 2, 4.0)]
    more = [*tree[:2], sharding.Leaf(1, 0, 2, 8.0)]
    from pyspark.sql import functions as F

    rows = spark.range(8000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), more).alias("b")).collect()
    share = np.bincount([r.a for r in rows]) / len(rows)
    assert share == pytest.approx([0.125, 0.375, 0.5], abs=0.03)
    assert all(r.b in (r.a, 2) for r in rows)
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("id"), [])
