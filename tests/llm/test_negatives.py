"""Hard negatives beside brute force with Python integers, and packed products at all field widths."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, size string, q int, rank string"


def brute(rows, positives=5, negatives=10, lower=30, upper=90, scale=256):
    points = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        points[i] = min(points.get(i, (lab, q)), (lab, q))
    out = set()
    for a, (lab, q) in points.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, p)), i, pl == lab) for i, (pl, p) in points.items() if i != a and len(p) == len(q))
        for s, pos, _ in [x for x in scored if x[2]][:positives]:
            hits = [(-t, i) for t, i, same in scored if not same and lower * -s <= 100 * -t <= upper * -s][:negatives]
            out |= {(a, pos, k + 1, i, -s, t) for k, (t, i) in enumerate(hits)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "s", 1, "r") for i, v, lab in rows], SCHEMA)


def found(spark, rows):
    return [tuple(r) for r in hn.mine(frame(spark, rows), F.col("vec_id") % 100 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]


def table():
    rng = random.Random(5)
    centre = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(k, [c + rng.gauss(0, 1.2) for c in rng.choice(centre)], rng.randrange(3)) for k in range(0, 900, 3)]
    rows += [(k, [0.5] * 6, 1) for k in range(1000, 1120)]  # copies: ties in ids
    rows += [(k, [0.25] * 6, 2) for k in range(1120, 1200)]
    rows += [(k, [0.0] * 6, k % 2) for k in range(1400, 1404)]
    rows += [(1300, None, 1), (1301, [1.0] * 6, None), (1302, [1.0, None, 1, 1, 1, 1], 1), (1303, [float("nan")] * 6, 1), (1304, [float("inf")] * 6, 1), (None, [2.0] * 6, 1)]
    rows += [(1500, [1.0, 2.0], 0), (1501, [2.0, 2.0], 0), (1502, [1.0, 0.5], 1), (1600, [], 0), (1601, [], 0), (1602, [], 1)]
    return rows + rows[:40] + [(9, [3.0] * 6, 2), (9, [3.0] * 6, 0)]


def test_all_rows_beside_brute_force(spark):
    rows = table()
    got = found(spark, rows)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    assert {a for a, *_ in got} >= {1000, 1100, 1500, 1600}


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = table()
    for name, n in (("CANDIDATES", 7), ("ANCHORS", 2), ("FIELDS", 3)):
        monkeypatch.setattr(hn, name, n)
    assert set(found(spark, rows)) == brute(rows)


def test_empty_tables_and_lone_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == [(0, 1, 1, 2, 65536, 32768)]


@pytest.mark.parametrize("largest", [3, 200, 1 << 12, 1 << 20, 1 << 28, 1 << 29])
def test_packed_products_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, c = rng.integers(-largest, largest + 1, (5, 33)), rng.integers(-largest // 2, largest + 1, (1_300, 33))
    assert np.array_equal(np.array(list(hn.products(a, c))), a @ c.T)
    assert np.array_equal(np.array(list(hn.products(abs(a) + 1, -abs(c)))), (abs(a) + 1) @ -abs(c).T)


def test_wide_fields_and_overflow():
    big = np.array([[1 << 60, -(1 << 60), 7]])
    cand = np.array([[3, 3, 5], [-(1 << 30), -(1 << 30), 1], [0, 0, 1 << 40]])
    assert [x.tolist() for x in hn.products(big, cand)] == [[35, 7, 7 << 40]]
    with pytest.raises(OverflowError):
        list(hn.products(big, np.array([[8, 0, 0]])))


def test_of_the_table_beside_sql(spark):
    from harness import compare, duck
    from tocsin.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert compare("op13_hard_negatives", QUERIES["op13_hard_negatives"](spark, sf), duck(sf), ORACLES["op13_hard_negatives"]) == ""
