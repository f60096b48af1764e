"""Near-duplicates, components, fingerprints, neighbours and URLs, beside brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tocsin.llm import bloom, common, near_duplicates, neighbours, urls, winnowing
from tocsin.llm.components import components


def words(rng, n):
    return [rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyz") * rng.randint(0, 3) for _ in range(n)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    ids = sorted({i for i, _ in rows})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, shingle_set(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets}


def corpus():
    rng = random.Random(11)
    texts = [" ".join(words(rng, rng.randint(5, 60))) for _ in range(30)]
    rows = [(10 * k, t) for k, t in enumerate(texts)]
    rows += [(10 * k + 1, t.upper().replace(" ", "\n")) for k, t in enumerate(texts[:6])]
    star = words(rng, 80)  # near copies of one text, of which many are no near copies of each other
    for k in range(60):
        w = list(star)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((1000 + k, " ".join(w)))
    chain = words(rng, 60)  # links of a chain whose ends share little
    for k in range(12):
        rows.append((2000 + k, " ".join([*chain[3 * k :], *(f"n{j}" for j in range(3 * k))])))
    passage = words(rng, 20)
    rows += [(3000 + k, " ".join(passage + words(rng, 40))) for k in range(40)]
    rows += [(4000, None), (4001, ""), (4002, " \t\n"), (4003, "one two"), (4004, "ONE\x0btwo"), (4005, "one two three four five"), (4006, "é ü\xa0ü"), (4007, "w" * 70_000 + " a b c d"), (4008, "w" * 70_000 + " A B C D")]
    return rows + rows[:3]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", 1) for i, t in rows], "doc_id long, text string, component_id string, n_shingles int")


def test_groups(spark):
    rows = corpus()
    got = {tuple(r) for r in near_duplicates.groups(frame(spark, rows)).collect()}
    assert got == brute_groups(rows)
    assert near_duplicates.groups(frame(spark, [])).count() == 0


def test_rows_without_id(spark):
    got = near_duplicates.groups(frame(spark, [(None, "a b"), (3, "a b"), (5, "a B"), (None, "c")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got if r["component_id"]) == [(0, 3, False), (3, 3, True), (5, 3, False)]


def test_groups_of_several_components_in_a_bucket(spark, monkeypatch):
    """One band of one hash, so that buckets are mixed; blocks of two, so that they are split."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 2)
    rows = corpus()
    assert {tuple(r) for r in near_duplicates.groups(frame(spark, rows)).collect()} == brute_groups(rows)


def test_rows_stay_in_proportion_in_groups_of_unlike_copies(spark, monkeypatch):
    """200 copies of one text with seven words changed each; two have 70 to 74 hundredths
    in common, and 76 and more only where they change three words in the same places."""
    made: dict = {}

    def counted(df, name, real=common.stage):
        out = real(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    for module in (common, near_duplicates):
        monkeypatch.setattr(module, "stage", counted)
    rng = random.Random(12)
    base = [f"w{k}" for k in range(404)]
    rows = []
    for i in range(200):
        w = list(base)
        for slot in rng.sample(range(80), 7):
            w[5 * slot + 4] = f"new{i}"
        rows.append((i, " ".join(w)))
    assert {tuple(r) for r in near_duplicates.groups(frame(spark, rows)).collect()} == brute_groups(rows)
    assert max(made.values()) <= near_duplicates.BANDS * len(rows)


def test_blocks_by_shingles(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK_SHINGLES", 100)
    rows = corpus()
    assert {tuple(r) for r in near_duplicates.groups(frame(spark, rows)).collect()} == brute_groups(rows)


def test_registered_groups(spark):
    from tocsin.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert {tuple(r) for r in QUERIES["op7_near_duplicates"](spark, sf).collect()} == brute_groups(rows)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(500, 560)] + [(700, k) for k in range(701, 760)]
    root = {i: i for x in links for i in x}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {(r["node"], r["component"]) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    alone = {a for a, b in links if a == b} - {i for a, b in links if a != b for i in (a, b)}
    assert got == {(i, find(i)) for i in root if i not in alone}


def test_fingerprint_definition():
    rng = random.Random(8)
    for text in ["a", "ab" * 200, "".join(rng.choice("abc \n") for _ in range(900)), "漢" * 300, "x" * 24, "x" * 25 + "é"]:
        hashes = winnowing.gram_hashes(text)
        window = min(winnowing.WINDOW, len(hashes))
        want = []
        for k in range(len(hashes) - window + 1):
            part = hashes[k : k + window].tolist()
            at = k + max(j for j, x in enumerate(part) if x == min(part))
            if not want or want[-1][0] != at:
                want.append((at, int(hashes[at])))
        position, kept = winnowing.fingerprint(text)
        assert list(zip(position.tolist(), kept.tolist(), strict=True)) == want
    a, b = ("".join(rng.choice("abcdef ") for _ in range(700)) for _ in range(2))
    shared = "".join(rng.choice("ghijkl ") for _ in range(winnowing.GRAM + winnowing.WINDOW - 1))
    assert set(winnowing.fingerprint(a + shared)[1]) & set(winnowing.fingerprint(shared + b)[1])


@pytest.mark.parametrize("rows", [1, 3, 100])
def test_next_document(spark, monkeypatch, rows):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", rows)
    rng = random.Random(9)
    docs = [(k * 7 - 50, "".join(rng.choice("abcdé ") for _ in range(rng.choice([0, 1, 30, 400])))) for k in range(60)]
    docs += [(900, None), (901, "same" * 50), (902, "same" * 50)]
    got = {r["doc_id"]: r for r in winnowing.with_next(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        prints = [[tuple(g) for g in r[c]] for c in ("fingerprint", "edited_fingerprint")]
        want = [list(zip(*(x.tolist() for x in winnowing.fingerprint(s)), strict=True)) for s in (t, new)]
        assert prints == want
        alike = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        a, b, c = (set(winnowing.fingerprint(s)[1].tolist()) for s in (t, new, after))
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == pytest.approx((alike(a, b), alike(a, c)))


def test_next_document_edges(spark):
    assert winnowing.with_next(frame(spark, [])).count() == 0
    [r] = winnowing.with_next(frame(spark, [(4, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    got = winnowing.with_next(frame(spark, [(None, "first one"), (1, "xy"), (1, "xy"), (2, "zw")])).collect()
    assert sorted(r["edited_sha256"] for r in got if r["doc_id"] == 2) == [hashlib.sha256(b"zf").hexdigest()]
    assert len(got) == 4


def brute_neighbours(rows, k):
    rows = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q, x in rows.items():
        if q % 20 == 0:
            near = sorted((-float((v * x).sum()), i) for i, v in rows.items() if i != q)
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST_ROWS", 60)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(800)]
    rows += [(k, rows[0][1]) for k in range(800, 1000)]  # a hot vector
    rows += [(2000, None), (2020, []), (2040, [0.0] * 16), (2060, [float("nan")] * 16), (2080, [None] + [1.0] * 15), (2100, [float("inf")] * 16), (2120, [1.0] * 3), (None, [1.0] * 16), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, list int, v string")
    got: dict = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_neighbours([r for r in rows if r[0] != 2120], 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)
    for q in (0, *range(800, 1000, 20)):  # copies: the smallest ids, but for the own
        assert [i for _, i, _ in got[q]] == [i for i, _ in want[q]]
    empty = neighbours.search(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0)
    assert empty.count() == 0
    few = neighbours.search(df.where("vec_id in (0, 3, 7)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2


def test_recall_of_the_table(spark):
    from tocsin.llm.queries import QUERIES

    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_neighbours(rows, 20)
    got = [(r["query_id"], r["vec_id"]) for r in QUERIES["op2_neighbours"](spark, sf).collect()]
    assert len(got) == 20 * len(want)
    assert len(set(got) & {(q, i) for q, x in want.items() for i, _ in x}) >= 0.9 * len(got)


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(0, 30_000, 3).selectExpr("cast(id as string) as k").unionByName(spark.sql("select cast(null as string) as k"))
    table, blocks = bloom.build(keys, "k", 10_000)
    out = bloom.possible(spark.range(30_000).selectExpr("cast(id as string) as k", "id", "'x' as w0", "1 as block"), F.col("k"), table, blocks)
    marks = out.agg(F.sum(F.when(F.col("id") % 3 == 0, (~F.col("maybe")).cast("int"))), F.avg(F.when(F.col("id") % 3 != 0, F.col("maybe").cast("int")))).first()
    assert marks[0] == 0
    assert marks[1] < 0.05
    assert out.columns == ["k", "id", "w0", "block", "maybe"]


URLS = [None, "", "nothing", "http://", "://x", "HTTP://Example.COM/en/a", "http://www.example.com/en/b?x=1", "http://a.b.example.com/en/", "http://example.com", "https://x.net/es/1", "https://net/fr/q", "https://planet/fr/q", "http://casino-win.example.org/en/1.html?utm_source=a&x=2#t", "https://www.casino-win.example.org//en/1?x=2", "http://m.casino-win.example.org/en/1/?x=2&ref=q", "http://casino-win.example.org/en/1?x=3", "http://user@h.org:443/p", "http://é.org/ü?q#f?x/y", "x://h.org?a/b", "x://h.org#a"]


def test_urls(spark):
    from tocsin.llm.queries import LISTED_WORDS, RULES

    df = spark.createDataFrame([(k, u, "h", 2) for k, u in enumerate(URLS * 2)], "page_id long, url string, host string, verdict int")
    listed = df.where(F.col("url").rlike(LISTED_WORDS)).limit(1)
    got = {r["page_id"]: r for r in urls.judge(df, listed.select("url"), RULES).collect()}
    assert len(got) == 2 * len(URLS)
    for k, u in enumerate(URLS):
        rest = u.partition("://")[2] if u else ""
        host = re.sub("[A-Z]", lambda m: m[0].lower(), re.split("[/?#]", rest)[0])
        path = re.split("[?#]", rest[len(host) :])[0]
        fit = [(v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        verdict, rule = max(fit, key=lambda x: len(x[1]), default=(None, None))
        r = got[k]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if k in (12, 13, 14) else "allow"))
    none = urls.judge(df, listed.where("false").select("url"), RULES)
    assert none.where("rule is null and verdict = 'block'").count() == 0
    assert urls.judge(df.where("false"), listed.select("url"), RULES).count() == 0


def test_urls_beside_sql(spark):
    from harness import compare, duck
    from tocsin.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert compare("op10_urls", QUERIES["op10_urls"](spark, sf), duck(sf), ORACLES["op10_urls"]) == ""


def test_short_texts_that_share_a_half_are_alike(spark):
    words = "the quick brown fox jumps over a lazy dog while seven wizards mix potions and jugglers vex quiet monks by night".split()
    rng = random.Random(8)
    docs = [(k, " ".join(rng.choice(words) for _ in range(60))[: 46 + 2 * k]) for k in range(75)]
    rows = winnowing.with_next(frame(spark, docs)).collect()
    assert len(rows) == 75
    assert all(r["near_edited"] > r["near_next"] for r in rows)
