import random

import pytest

from paperloom.operators import documents as D
from paperloom.operators import regions as R
from paperloom.operators import tables as T
from pyspark.sql import functions as F


def test_position_map_spells_the_normal_body(spark):
    rnd = random.Random(2)
    parts = ["word", "bro-\nken", "[1-3]", "[2, 5-6].", "[4]", "x[9]y", "[a-b]", "\n", "  ", "\n\n", " end-", "-\n", "(3)", "see[1, 2-4]", "Ünï-\ncode", "[", "]"]
    rows = [(i, "".join(rnd.choice(parts) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 25)))) for i in range(300)] + [(900, None), (901, ""), (902, "a " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got: dict = {}
    for r in R.position_map(docs).orderBy("doc_id", "norm_no").collect():
        got.setdefault(r.doc_id, []).append((r.norm_no, r.orig_no, r.word))
    body = {r.doc_id: (r.b or "").split() for r in docs.select("doc_id", D.normal_body(F.coalesce("text", F.lit(""))).alias("b")).collect()}
    for i, t in rows:
        mine = got.get(i, [])
        assert [w for _, _, w in mine] == body[i] and [x for x, _, _ in mine] == list(range(len(mine)))
        original = (t or "").split()
        for _, at, w in mine:  # each word shares its beginning with the word it comes from, but for numbers made of a range
            assert 0 <= at < len(original) and (w[0] == original[at][0] or w[0].isdigit())


def brute_names(toks):
    out, cur = [], []
    for t in toks:
        if t.lower() in ("&", "and", ",", ";"):
            out, cur = out + [cur] * bool(cur), []
        elif cur and t.endswith(","):
            out, cur = out + [cur + [t]], []
        else:
            cur = cur + [t]
    return [" ".join(x) for x in out + [cur] * bool(cur)]


def test_author_groups_against_brute_force(spark):
    rnd = random.Random(3)
    docs = [[rnd.choice(["A", "B,", "C", "D,", "and", "&", ",", ";", "E,"]) for _ in range(rnd.randrange(1, 12))] for _ in range(400)]
    rows = spark.createDataFrame([(d, j, t, j * 3) for d, ts in enumerate(docs) for j, t in enumerate(ts)], "doc_id int, tok_no int, tok string, x int")
    got: dict = {}
    for r in R.author_groups(rows).orderBy("doc_id", "author_no").collect():
        got.setdefault(r.doc_id, []).append(r.name)
        assert r.x == 3 * r.tok_no
    for d, ts in enumerate(docs):
        assert got.get(d, []) == brute_names(ts), ts


def test_errors_are_named(spark):
    lines = spark.createDataFrame([(1, 0, "bodyText")], "doc_id int, line_no int, label string")
    with pytest.raises(Exception, match="no heading at line 0"):
        R.heading_kinds(lines, spark.createDataFrame([(1, 0, "method")], "doc_id int, line_no int, kind string")).collect()
    one = spark.createDataFrame([(1, 0)], "doc_id int, cite_no int")
    with pytest.raises(Exception, match="differ in document 1"):
        R.same_count(one, one.union(one)).collect()


def test_columns_of_the_users_stay(spark):
    rows = spark.createDataFrame([(1, j, "x", 5, j % 2, 7, 8, 9, 3, 2) for j in range(6)], "key int, at int, label string, b int, v int, gap int, lo int, hi int, part int, new int")
    names = {"b", "gap", "lo", "hi", "part", "new"}
    for out in (T.section_breaks(rows, "key", ["at"], ["v"]), T.gap_breaks(rows, "key", ["at"], "at", "v"), T.vertical_bins(rows, "key", "v"), T.folds(rows, "at", 2), D.runs(rows, "key", "at", "label")):
        got = out.orderBy("at").collect()
        assert names <= set(out.columns) and len(got) == 6 and all((r.b, r.gap, r.lo, r.hi, r.part, r.new) == (5, 7, 8, 9, 3, 2) for r in got)
    signals = spark.createDataFrame([(1, 0, "author", "a", 1), (1, 1, "signal", "s", 1), (1, 2, "author", "b", 1), (1, 3, "signal", "t", 1)], "doc_id int, i int, kind string, v string, s int")
    assert {(r.author, r.signal) for r in T.signal_fanout(signals, "doc_id", "i", "kind", "v").collect()} == {("a", "s"), ("b", "t")}


def test_folds_of_hashed_ids(spark):
    rnd = random.Random(4)
    ids = [rnd.randrange(-(2**63), 2**63) for _ in range(3000)]
    got = {r.id: r.fold for r in T.folds(spark.createDataFrame([(x,) for x in ids], "id long"), "id", 7).collect()}
    assert got == {x: j % 7 for j, x in enumerate(sorted(ids))}
    assert T.folds(spark.createDataFrame([], "id long"), "id", 7).count() == 0
