"""The n-gram join beside brute force, and the prefix property that it rests on."""

import random
import re

import numpy as np
import pytest

from tocsin.llm import combination_join as cj

SCHEMA = "doc_id long, text string, node string, n int, key string, component string"


def grams(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, similarity=90, words=3):
    sets = [(i, grams(t, words)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus():
    rng = random.Random(2)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice("xyz") * rng.randint(0, 3)
    rows = [(k, " ".join(word() for _ in range(rng.randint(9, 90)))) for k in range(40)]
    rows += [(50 + k, rows[k][1].upper().replace(" ", "\r\n")) for k in range(8)]
    rows += [(60 + k, rows[k][1] + " more") for k in range(12)]
    star = [word() for _ in range(150)]  # near copies, of which many are none of each other
    for k in range(70):
        w = list(star)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(9)}"
        rows.append((100 + k, " ".join(w)))
    chain = [word() for _ in range(120)]
    rows += [(200 + k, " ".join([*chain[3 * k :], *(f"n{j}" for j in range(3 * k))])) for k in range(15)]
    page = [word() for _ in range(60)]  # a frequent passage, more or less of the text
    rows += [(300 + k, " ".join(page + [f"own{k}x{j}" for j in range(k % 13)])) for k in range(60)]
    few = [[word() for _ in range(12)] for _ in range(5)]  # texts of frequent lines only
    rows += [(400 + k, " ".join(" ".join(rng.choice(few)) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "one two"), (504, "ONE\x0btwo"), (505, "one"), (506, "two one"), (507, "a b c d e f g h i j k l"), (508, "a b c d e f g h i j k"), (509, "w" * 70_000 + " a b c")]
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", "c") for r in rows], SCHEMA)


def found(df):
    return [tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()]


@pytest.mark.parametrize(("rare", "step", "similarity"), [(64, 64, 90), (3, 4, 90), (2, 5, 75)])
def test_components_beside_brute_force(spark, monkeypatch, rare, step, similarity):
    monkeypatch.setattr(cj, "RARE", rare)
    monkeypatch.setattr(cj, "STEP", step)
    rows = corpus()
    got = found(cj.join(frame(spark, rows), similarity=similarity))
    assert len(got) == len(rows)
    assert set(got) == brute(rows, similarity)


def test_ids_that_are_null_or_repeated(spark):
    w = [f"w{k}" for k in range(40)]
    rows = [(None, " ".join(w)), (3, " ".join(w)), (None, " ".join([*w[1:], "z"])), (4, "p q r s"), (5, "p q r s"), (5, "t u v x"), (9, "t u v x"), (None, None), (6, None)]
    got = found(cj.join(frame(spark, rows)))
    want = [(None, 38, 3), (3, 38, 3), (None, 38, None), (4, 2, 4), (5, 2, 4), (5, 2, 4), (9, 2, 4), (None, 0, None), (6, 0, 6)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert found(cj.join(frame(spark, []))) == []
    assert found(cj.join(frame(spark, [(None, "a b c")]))) == [(None, 1, None)]


@pytest.mark.parametrize("similarity", [50, 75, 90, 97])
@pytest.mark.parametrize("chances", [1, 4, 9])
def test_similar_sets_share_a_key(monkeypatch, similarity, chances):
    """Any similar, unequal sets share a key whatever the tokens' classes are."""
    monkeypatch.setattr(cj, "CHANCES", chances)
    rng, low = np.random.default_rng(similarity), cj.bands(similarity)
    tested = 0
    with np.errstate(over="ignore"):
        for turn in range(1500):
            n = int(rng.integers(1, 40 if turn % 2 else 400))
            x = rng.integers(0, 1 << 63, n, np.uint64)
            lost, extra = rng.integers(0, n + 1, 2) * (100 - similarity) // 80
            y = np.concatenate([x[: n - lost], rng.integers(0, 1 << 63, extra, np.uint64)])
            if len(y) == 0 or (len(y) == n and lost == 0) or 100 * (n - lost) < similarity * (n + extra):
                continue
            tested += 1
            chosen = rng.choice([0, 50, 5_000], 3)
            seen = lambda t: chosen[(t % np.uint64(3)).astype(int)] + (t % np.uint64(7)).astype(int)  # noqa: B023, E731
            a, b = (cj.keys(t, seen(t), 40, similarity, low) for t in (x, y))
            assert len(np.intersect1d(a, b)) > 0
            assert similarity < 75 or chances > 4 or len(a) <= 60 * n
    assert tested > 150


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for n in (5, 300, 700, 3_000):
        x = rng.integers(0, 1 << 63, n, np.uint64)
        for lost, extra in ((0, 1), (3, 0), (n // 9, n // 7)):
            y = np.concatenate([x[lost:], rng.integers(0, 1 << 63, extra, np.uint64)])
            two = cj.folded([cj.parity(x), cj.parity(y)])
            assert int(np.bitwise_count(two[0] ^ two[1]).sum()) <= lost + extra


def test_registered_query_beside_brute_force(spark):
    from tocsin.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert set(found(QUERIES["op12_jaccard_join"](spark, sf))) == brute(rows)
