import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from quillspan.llm import audit

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def brute(rows, letters):
    """rows: (part, failing letters, good, toxic); every order is run from the start."""
    out = []
    for part in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == part]
        found = {}
        for order in permutations(letters):
            left = mine
            for k, x in enumerate(order):
                gone, left = [r for r in left if x in r[1]], [r for r in left if x not in r[1]]
                found["".join(order), k + 1] = (x, len(left), len(gone), sum(x in r[1] for r in mine) - len(gone), sum(r[1] == {x} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
        for (order, step), v in found.items():
            out.append((part, order, step, *v[1:], sum(w[2] for w in found.values() if w[0] == v[0])))
    return sorted(out)


def docs(draw, n=90):
    made = [(None, None, "en"), (1, "", None), (1, "", None), (None, None, None), (2, "A" * 9, "de"), (2, "other text", "de")]
    for k in range(3, n):
        words = [draw.choice("ab cd ef gh ij kl mn op qr st uv".split()) + str(draw.randrange(draw.choice((2, 400)))) for _ in range(draw.choice((3, 150, 199, 200, 320)))]
        words += draw.choice(([], ["#"], ["XYZ"] * 40, ["é|"]))
        text = draw.choice(made)[1] if draw.random() < 0.2 else draw.choice(" \t\n").join(words)
        made.append((draw.choice((k, k, -k)), text, draw.choice(("en", "de", "fr", None))))
    return made


def failing(rows):
    for key, text, _ in rows:
        t = text or ""
        w = re.findall(audit.WORD, t)
        same = [k for k, x, _ in rows if (x or "") == t and k is not None]
        yield {x for x, bad in {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": key is not None and min(same) < key,
        }.items() if bad}


@pytest.fixture(scope="module")
def case(spark):
    rows = docs(random.Random(4))
    labels = [(k, draw % 2, draw % 3 == 0 and 1 or 0) for draw, k in enumerate(range(-20, 70))] + [(5, 1, None), (5, None, 1), (None, 1, 1)]
    df = spark.createDataFrame([(k, t, p, "x", True) for k, t, p in rows], "doc_id long, text string, lang string, part string, A boolean")
    return rows, labels, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order_equals_running_it(case):
    rows, labels, df, said = case
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    want = brute([(p or "", f, k in good, k in toxic) for (k, _, p), f in zip(rows, failing(rows), strict=True)], "ABCDE")
    flagged = audit.with_labels(audit.text_failures(df), said)
    assert flagged.count() == len(rows)
    got = audit.audit_filters(flagged, {x: F.col(x) for x in "ABCDE"}, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")}).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == want and len(want) == 4 * 600


def test_parts_without_survivors_null_flags_and_few_filters(spark):
    df = spark.createDataFrame([("x", True, None), ("x", True, True), ("y", None, False), (None, False, True)], "part string, p boolean, q boolean")
    got = audit.audit_filters(df, {"P": F.col("p"), "Q": F.col("q")}, {})
    assert sorted(tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley").collect()) == [
        ("", "PQ", 1, 1, 0, 0, 0, 0), ("", "PQ", 2, 0, 1, 0, 1, 2), ("", "QP", 1, 0, 1, 0, 1, 2), ("", "QP", 2, 0, 0, 0, 0, 0),
        ("x", "PQ", 1, 0, 2, 0, 1, 3), ("x", "PQ", 2, 0, 0, 1, 0, 1), ("x", "QP", 1, 1, 1, 0, 0, 1), ("x", "QP", 2, 0, 1, 1, 1, 3),
        ("y", "PQ", 1, 1, 0, 0, 0, 0), ("y", "PQ", 2, 1, 0, 0, 0, 0), ("y", "QP", 1, 1, 0, 0, 0, 0), ("y", "QP", 2, 1, 0, 0, 0, 0),
    ]
    assert audit.audit_filters(df.limit(0), {"P": F.col("p")}, {}).count() == 0
    with pytest.raises(ValueError):
        audit.audit_filters(df, {}, {})


def test_states_are_shared_and_freed(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    kept, freed, persist, unpersist = [], [], Classic.persist, Classic.unpersist
    monkeypatch.setattr(Classic, "persist", lambda self, *a: (kept.append(1), persist(self, *a))[1])
    monkeypatch.setattr(Classic, "unpersist", lambda self, *a: (freed.append(1), unpersist(self, *a))[1])
    df = spark.createDataFrame([("x", True, False, True)], "part string, p boolean, q boolean, r boolean")
    assert audit.audit_filters(df, {x: F.col(x) for x in "pqr"}, {}).count() == 18
    assert len(kept) == len(freed) == 2**3 - 2  # neither the whole table nor the state after all filters
