import random
import re
from itertools import combinations

import pytest

from paperloom.llm import minhash
from paperloom.llm.minhash import components, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, component_id string"


def shingle_set(text, k):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k=2, percent=80):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {i: shingle_set(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(df, k=2, percent=80):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k, percent).collect()}


def test_driver_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert result(docs) == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_chains_and_dense_groups_against_all_pairs(spark):
    rnd, rows = random.Random(3), []
    for g in range(6):
        base = [f"w{rnd.randrange(400)}" for _ in range(60)]
        for _ in range(40):
            rows.append((len(rows), " ".join(base)))
            for _ in range(rnd.randrange(1, 3)):  # it drifts: far members are linked only through others
                base[rnd.randrange(len(base))] = f"n{rnd.randrange(10**6)}"
    for _ in range(60):  # short texts share buckets
        rows.append((len(rows), " ".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8)))))
    rnd.shuffle(rows)
    got = result(spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS))
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows).items()}


@pytest.mark.parametrize("percent", [60, 45, 92])
def test_other_similarities_against_all_pairs(spark, percent):
    rnd, rows = random.Random(percent), []
    for _ in range(60):  # pairs around the limit, and some groups
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(30, 90))]
        for _ in range(rnd.randrange(2, 5)):
            t = list(base)
            for _ in range(int(len(t) * (100 - percent) / 100 * rnd.uniform(0.1, 0.5))):
                t[rnd.randrange(len(t))] = f"n{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(t)))
    want = brute(rows, 2, percent)
    assert 20 < sum(c != i for i, (_, c) in want.items()) < len(rows) - 60
    assert result(spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS), 2, percent) == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_banding():
    assert minhash.banding(80)[:2] == (40, 5)
    for percent in (8, 30, 60, 79, 81, 100):
        bands, rows, least = minhash.banding(percent)
        assert bands * rows <= minhash.MOST and (1 - (percent / 100) ** rows) ** bands <= minhash.MISS and least <= percent / 100
    for percent in (0, 5, 101, -3):
        with pytest.raises(ValueError):
            minhash.banding(percent)


def test_hot_buckets_of_one_template(spark, monkeypatch):
    for name, value in (("HOT", 12), ("BLOCK", 8), ("MEMBERS", 3)):
        monkeypatch.setattr(minhash, name, value)
    rnd, rows = random.Random(8), []
    template = [f"t{i}" for i in range(70)]
    for _ in range(80):  # all share most of a template; every third has a near copy of its own
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.randrange(14, 30))]
        rows.append((len(rows), " ".join(template + own)))
        if rnd.random() < 0.4:
            own[rnd.randrange(len(own))] = "changed"
            rows.append((len(rows), " ".join(template + own)))
    rnd.shuffle(rows)
    want = brute(rows)
    assert len({c for _, c in want.values()}) > 20
    assert result(spark.createDataFrame([(i, t, "s", "x") for i, t in rows], DOCS)) == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_edges(spark):
    rows = [(5, None, None, "x"), (1, "", "s", None), (2, " \t\n", "s", "x"), (3, "One", "s", "x"), (9, "oNe", "s", "x"), (7, "É", None, None), (8, "é", None, None), (4, "a b " * 30000, "s", "x"), (6, "A  B " * 30001, "s", "x"), (4, "a b " * 30000, "s", "x")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=2).collect())
    assert got == [(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 2, 4, True), (4, 2, 4, True), (5, 0, 5, True), (6, 2, 4, False), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 3, False)]
    assert near_duplicates(df.limit(0), k=2).count() == 0


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "x y z"), (3, "x y z"), (None, "p q r"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(df, k=2).collect()), key=str)
    assert sorted(got, key=str) == sorted([(None, 3, False), (3, 3, True), (None, None, True), (None, None, True)], key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 150)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), spark).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 200: 100, 150: 100}
    assert components(spark.createDataFrame([], "a long, b long"), spark).count() == 0
