import zlib

import numpy as np
import pytest

from quillspan.llm import lengths, packing, planes
from quillspan.llm.tokens import ChunkEncoder, encoder, tokenizer_path

ODD = ["", " ", "  a", " a", "a  b", "a \n b", "x\x1c y", "a  b  ", "don't 's  's", "\n\n a\n b \n", "a <|endoftext|> b", "é  ñ 12 34!! ??", "a\u00a0 b \u2003c", "日本 語 \U0001f600 x"]
TABLE = "doc_id long, text string, size string, sequence_id int"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def docs(spark):
    rows = [(None, "null key", "x", 1), (1, None, None, None), (2, "", "x", 1), (3, "long " * 5000, "x", 1), (4, "same", "x", 1), (4, "same", "x", 1), (5, "other one", "x", 1), (6, "a <|endoftext|> b<|endoftext|>", "x", 1), (7, "x \n\n y  z", "x", 1)]
    return spark.createDataFrame(rows + [(100 + i, "word " * (i % 90), "x", 1) for i in range(200)], TABLE)


def test_cached_ids_equal_the_tokenizer(plain):
    for limit in (10**6, 5):
        e = ChunkEncoder(tokenizer_path(), limit)
        for _ in range(3):
            assert [x.tolist() for x in e.encode([*ODD, None])] == [plain(t) for t in [*ODD, None]]
        assert len(e.later) <= limit + 1


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_kinds_of_tokenizer_encode_whole_texts(name):
    from tokenizers import Tokenizer

    e, t = ChunkEncoder(tokenizer_path(name)), Tokenizer.from_file(tokenizer_path(name))
    assert not e.chunked
    assert [x.tolist() for x in e.encode(ODD)] == [t.encode(x, add_special_tokens=False).ids for x in ODD]


def test_histogram_answers_every_limit(spark, plain):
    rows = docs(spark).collect()
    sizes = np.array([len(plain(r.text)) for r in rows])
    got = lengths.context_table(lengths.length_histogram(docs(spark)))
    for r in got.collect():
        k = r.context_limit
        assert (r.n_docs, r.n_longer, r.tokens_longer, r.truncated_tokens, r.total_tokens) == ((sizes == k).sum(), (sizes > k).sum(), sizes[sizes > k].sum(), np.minimum(sizes, k).sum(), sizes.sum())
    assert lengths.truncated_total(got, 7).first().truncated_tokens == np.minimum(sizes, 7).sum()
    assert lengths.length_quantile(got, 0.5).first().n_tokens == np.sort(sizes)[int(np.ceil(len(sizes) / 2)) - 1]
    assert lengths.context_table(lengths.length_histogram(docs(spark).where("false"))).count() == 0


def check_packing(rows, plain, texts):
    ids = {k: [np.array([*plain(t), 1], "<u4") for t in v] for k, v in texts.items()}
    seen, used = {}, {}
    for r in rows:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {k: sum(map(len, v)) for k, v in ids.items()}
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 2048
    assert sorted(used) == list(range(len(used)))
    return sum(map(sum, (([n for _, n in p]) for p in used.values()))) / (2048 * len(used))


def test_packing_places_each_id_once(spark, plain):
    df, texts = docs(spark), {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert check_packing(packing.pack_documents(df).collect(), plain, texts) > 0.8
    assert packing.pack_documents(df.where("false")).count() == 0


def test_short_rows_leave_little_padding(spark, plain):
    rows = [(i, [None, "", "one", "two words", "w " * (i % 40)][i % 5]) for i in range(20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert check_packing(packing.pack_documents(df).collect(), plain, {k: [t] for k, t in rows}) > 0.97


def test_cutting_stock_is_near_its_bound():
    draw = np.random.default_rng(1)
    sizes = np.arange(1, 65)
    demand = draw.integers(0, 400, 64)
    keep = demand > 0
    plan = packing.plan_sequences(sizes[keep], demand[keep], 64)
    made = sum(times * pattern for times, pattern in plan)
    assert (made == demand[keep]).all()
    assert all((pattern * sizes[keep]).sum() <= 64 for _, pattern in plan)
    patterns, used = packing.cutting_stock(sizes[keep], demand[keep].astype(float), 64)
    assert patterns @ used == pytest.approx(demand[keep])
    assert (sizes * demand).sum() / 64 <= used.sum() <= sum(times for times, _ in plan) <= used.sum() * 1.005 + 1
    times = sum(t for t, _ in packing.plan_sequences(np.array([3, 4, 5]), np.array([6, 4, 4]), 12))
    assert times == 5  # 54 units in rooms of 12


def test_knapsack_is_exact():
    draw = np.random.default_rng(0)
    for _ in range(20):
        sizes, values = draw.integers(1, 9, 4), draw.random(4)
        value, counts = packing.best_pattern(values, sizes, 17)
        best = [0.0] * 18
        for c in range(1, 18):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(sizes, values, strict=True) if s <= c)])
        assert value == pytest.approx(best[17]) == pytest.approx(float(counts @ values)) and counts @ sizes <= 17


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("ids", [[], [0], [1, 2, 3, 70000, 2**32 - 1], list(range(1000))])
def test_planes_round_trip(bits, ids):
    assert planes.unpack_planes(planes.pack_planes(np.array(ids, "<u4"), bits)).tolist() == ids


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_files_round_trip(block):
    maker, rows = planes.FileMaker(block_ids=block), [(k, np.arange(n, dtype="<u4")) for k, n in enumerate((1, 5, 8, 2, 20, 1))]
    frames = [f for k, ids in rows for f in maker.add(k, ids)] + list(maker.close())
    data = b"".join(f + b"\n" for f in frames)
    start = 0
    for (key, ids), (k, s, back) in zip(rows, planes.read_documents(data), strict=True):
        assert (k, s, back.tolist()) == (key, start, ids.tolist())
        start += len(ids)


def test_ids_through_files(spark, plain):
    df = docs(spark)
    got = sorted(planes.ids_through_files(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in df.collect()), key=lambda k: -(2**63) if k is None else k)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ([*plain(r.text), 0] for r in df.collect()))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == want
    assert planes.ids_through_files(df.where("false")).count() == 0


def test_one_encoder_in_a_worker():
    assert encoder(tokenizer_path()) is encoder(tokenizer_path())
