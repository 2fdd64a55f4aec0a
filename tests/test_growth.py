"""Steps whose time or memory must grow no faster than their input: what is moved how often, and the same results."""

import pyarrow as pa
import pytest

from paperloom.operators import affiliations as A
from paperloom.operators import crf, features, pipelines, training
from paperloom.operators import layout as L
from paperloom.operators import regions as R
from paperloom.operators import tables as T
from pyspark.sql import functions as F

PAGE = '<document><page><body><section><column><para>{}</para></column></section></body></page></document>'


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def moves(df):
    return plan(df).count("Exchange hashpartitioning")


def pages(spark, n, lines=3):
    line = '<ln t="{0}" b="{1}" fontSize="{2}"><wd>a{0}</wd><wd>b</wd></ln>'
    rows = [(i, PAGE.format("".join(line.format(10 * j, 10 * j + 8, 900 if j % 2 else 1000) for j in range(lines)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, xml string")


def test_layout_features_make_and_move_their_lines_once(spark):
    lines = L.layout_lines(L.layout_words(pages(spark, 3)))
    out = L.layout_features(lines)
    assert plan(out).count("MapInArrow") == 1 and "Join" not in plan(out) and moves(out) == 2
    rows = out.orderBy("doc_id", "line_no").collect()
    assert [(r.line_no, r["loc"], r.size_class, r.font_size_diff) for r in rows[:3]] == [(0, 0, "common", "new"), (1, 3, "smaller", "new"), (2, 7, "common", "new")]


def test_layout_lines_move_their_words_once(spark):
    lines = L.layout_lines(L.layout_words(pages(spark, 3)))
    assert plan(lines).count("MapInArrow") == 1 and "Join" not in plan(lines) and moves(lines) == 1


def test_a_range_of_lines_moves_only_its_words(spark):
    out = L.line_range(L.layout_lines(L.layout_words(pages(spark, 3, 9))), (0, 0, 0, 2), (0, 0, 0, 5)).select("doc_id", "ln")
    assert plan(out).count("MapInArrow") == 1 and "Join" not in plan(out) and moves(out) == 1
    assert sorted(tuple(r) for r in out.collect()) == [(i, j) for i in range(3) for j in range(2, 6)]


def test_small_documents_share_a_batch():
    docs = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "xml": [PAGE.format("<ln><wd>a</wd><wd>b</wd></ln>")] * 500})
    assert [b.num_rows for b in L.word_batches(iter([docs, docs]))] == [2000]


def test_mode_of(spark):
    rows = spark.createDataFrame([(1, [3, 1, 3, 1, 2]), (2, [None, None, 1]), (3, [None, 1]), (4, []), (5, [7])], "k int, v array<int>")
    got = {r.k: r.m for r in rows.select("k", T.mode_of(F.col("v"), "int").alias("m")).collect()}
    assert got == {1: 3, 2: None, 3: 1, 4: None, 5: 7}


def test_markup_moves_words_once(spark):
    words = L.layout_words(spark.createDataFrame([(1, PAGE.format("<ln><wd>a</wd></ln><ln><wd>&lt;</wd></ln>").replace("</para>", "</para><para><ln><wd>c</wd></ln></para>") * 2)], "doc_id long, xml string"))
    out = L.simplified(words)
    assert moves(out) == 1
    page = "<page><para><line><word>a</word></line><line><word>&lt;</word></line></para><para><line><word>c</word></line></para></page>"
    assert out.first().markup == f"<document>{page}{page}</document>"


@pytest.mark.parametrize("model, make, rows", [(training.citation_model, training.reference, features.token_rows), (training.section_model, training.paper, features.line_rows)])
def test_sequences_side_by_side_are_labelled_alike(model, make, rows, monkeypatch):
    m = model()
    seqs = [rows([x for x, _ in s]) for s in training.seeded(make, 25, 77)] + [[], rows(["x"]), rows(["A:b/c", "ü", "1999."])]
    monkeypatch.setattr(crf, "ROWS", 100)
    want = [m.label(s) for s in seqs]
    assert m.label_all(seqs) == want
    assert [y for y, _ in m.label_all(seqs, confident=False)] == [y for y, _ in want]


def test_equal_references_of_a_batch_are_decoded_once():
    seen = []

    def rows(items):
        seen.append(items)
        return features.token_rows(items)

    lists = [["A.", "Berg,", "1999."], None, ["", "x"], ["A.", "Berg,", "1999."]]
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "items": lists})
    out = next(pipelines._labeller(training.citation_model(), rows, " ", False)(iter([batch]))).to_pydict()
    assert seen == [["A.", "Berg,", "1999."], [], ["x"]] and out["k"] == [1, 2, 3, 4] and out["runs"][0] == out["runs"][3] != [] and out["runs"][1] == []
    assert sum(len(r["content"].split()) for r in out["runs"][0]) == 3 and all(0 < r["confidence"] <= 1 for r in out["runs"][0])


def test_pairs_are_neither_moved_nor_sorted(spark):
    s = "doc_id int, {0}_no int, {0} string, signals array<string>, page int, section int, para int, line int, x double, y double"
    authors = spark.createDataFrame([(1, j, "a", [str(j % 3)], 0, 0, 0, 0, float(j), float(j)) for j in range(600)], s.format("author"))
    affs = spark.createDataFrame([(1, j, "b", [str(j % 4)], 0, 0, 1, 0, float(j), 100.0 * j) for j in range(4)], s.format("affiliation"))
    out = A.match_affiliations(authors, affs)
    top = plan(out).split("Join")[0]  # what stands above the last join
    assert not any(x in top for x in ("Exchange", "Window", "Sort "))
    rows = out.collect()
    assert len(rows) == 2400 and {r.affiliation_no for r in rows if r.label == "yes"} == {0, 1, 2}
    assert all((r.label == "yes") == (r.author_no % 3 == r.affiliation_no % 4) for r in rows)


def test_position_map_stays_in_its_row(spark):
    docs = spark.createDataFrame([(1, "a be-\nta [3, 5-6].\nx")], "doc_id long, text string")
    out = R.position_map(docs)
    assert not any(x in plan(out) for x in ("Exchange", "Window", "Sort "))
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, "a"), (1, 1, "beta"), (2, 3, "[3,"), (3, 3, "5,"), (4, 3, "6]."), (5, 5, "x")]
