import random
import xml.etree.ElementTree as ET

import pytest

from paperloom.functions import lexical as X
from paperloom.functions import normalize as N
from paperloom.operators import contexts as C
from paperloom.operators import crf, features, pipelines, training
from paperloom.operators import documents as D
from paperloom.operators import export as E
from pyspark.sql import functions as F

PAPER = """Robust Parsing of References
Anna Berg* and Hugo Rossi
University of Oslo
anna@text.example.edu
Abstract
We study robust parsing of references and show that it is fast.
1 Introduction
The parsing of records is robust [1] and so we use fast ranking here. Others [2, 3-4] do too.
In prose, References are nothing special.
""" + "The clustering of queries is adaptive and so we use lexical tagging here.\n" * 12 + """References
[1] A. Berg, "Fast parsing of records," Data Review, vol. 3, pp. 10-19, 1999.
[2] H. Rossi, "On the ranking of graphs," Language Let-
ters, vol. 5, pages 1-9, 2001.
12
[3] V. Weiss, "Towards scalable tagging with tables," Data Review, 7(2), pp. 5-6, 2003.
[4] L. Silva, "A fast approach to caching," Data Review, vol. 9, pp. 7-8, 2004.
Appendix A
More text."""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_column_and_python_features_agree(spark):
    rnd = random.Random(1)
    toks = ["".join(rnd.choice("aZé1.,-()\"'[]:;!?Ä") for _ in range(rnd.randrange(1, 7))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in toks], "t string")
    for column, f in ((X.case_class, features.case_class), (X.number_class, features.number_class), (X.punct_class, features.punct_class), (X.last_char_class, features.last_char), (X.bare, features.bare)):
        got = [r.v for r in df.select(column(F.col("t")).alias("v")).collect()]
        want = [f(t) for t in toks]
        if f is features.case_class:
            want = [w for w in want]
        assert got == want, f.__name__


@pytest.mark.parametrize("text, want", [("vol. 5 (1)", ["5", "1"]), ("12", ["12"]), ("none", ["none"])])
def test_volume(spark, text, want):
    assert value(spark, N.volume(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("pp. 1-9", "1--9"), ("p 12", "12"), ("xii", "xii"), ("1234 – 56", "1234--56")])
def test_pages(spark, text, want):
    assert value(spark, N.pages(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("May 1999.", "1999"), ("in press", ""), ("2999", ""), (None, None)])
def test_date(spark, text, want):
    assert value(spark, N.date(F.lit(text).cast("string"), 2025)) == want


@pytest.mark.parametrize("text, want", [("  ,a title.", "a title."), ("(unpaired", "unpaired"), ("(pair) x", "(pair) x"), ("word)", "word"), ("[x]", "[x]")])
def test_strip_punctuation(spark, text, want):
    assert value(spark, N.strip_punctuation(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("A. Berg, H. Rossi and Li Wei", ["A Berg", "H Rossi", "Li Wei"]), ("Berg A, Rossi H B", ["A Berg", "H B Rossi"]), ("J.-P. Duval et al.", ["J-P Duval"]), ("M. van der Berg, Jr., and X. Xu", ["M van_der_Berg", "X Xu"]), ("Lia Silva; Ken Moreau III", ["Lia Silva", "Ken Moreau"])])
def test_authors(spark, text, want):
    assert value(spark, N.author_names(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("{a, b}@c.org", ["a@c.org", "b@c.org"]), ("a@c.org", ["a@c.org"]), ("{a|b}@c.org", ["a@c.org", "b@c.org"])])
def test_mail_groups(spark, text, want):
    assert value(spark, N.email_group(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("x [1, 2, 4-6] y", "x [1, 2, 4, 5, 6] y"), ("[1-2, 5-6]", "[1, 2, 5, 6]"), ("[3-1] [a-b]", "[3-1] [a-b]"), ("none", "none")])
def test_ranges(spark, text, want):
    assert value(spark, D.expand_ranges(F.lit(text))) == want


def test_unmarked_references(spark):
    lines = ["Berg, A., Rossi, H., and Silva, L.", "1999. Fast parsing of records.", "Data Review.", "Weiss, V. 2001. Lexical tagging", "of tables in the U.S.A.", "and beyond. Oslo.", "Xu, W. 2004. Caching. Lima."]
    other = ["Adam, B., Cole, D., Eve, F.,", "Gill, H. 1990. One.", "Iris, J., Kay, L., Moe, N.,", "Otto, P. 1991. Two.", "", "Quinn, R. 1992. Three"]
    df = spark.createDataFrame([(1, lines), (2, other), (3, ["no year at all.", "Nor here"]), (4, ["x 2001"]), (5, [])], "doc_id int, l array<string>")
    got = {}
    for r in D.split_unmarked(df).orderBy("doc_id", "cite_no").collect():
        got.setdefault(r.doc_id, []).append(r.raw.split(",")[0])
    assert got == {1: ["Berg", "Weiss", "Xu"], 2: ["Adam", "Iris", "Quinn"], 3: ["no year at all. Nor here"], 4: ["x 2001"]}


def test_citations_end_to_end(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, "no references here"), (3, None)], "doc_id long, text string")
    split = {r.doc_id: r for r in D.reference_split(docs).collect()}
    assert split[1].body.endswith("References") and split[1].cite.startswith("[1] A. Berg") and "Appendix" not in split[1].cite
    assert split[2].cite == "" and not split[1].oversized
    refs, ctx = pipelines.extract_citations(docs)
    rows = sorted(refs.collect(), key=lambda r: r.cite_no)
    assert [r.marker for r in rows] == ["[1]", "[2]", "[3]", "[4]"]
    assert "Language Letters" in rows[1].raw and [r.date for r in rows] == ["1999", "2001", "2003", "2004"]
    assert rows[0].authors == ["A Berg"] and rows[0].pages == "10--19" and rows[2].volume == "7" and rows[2].issue == "2" and all(r.valid for r in rows)
    got = sorted((r.cite_no, r.cit_str) for r in ctx.collect())
    assert got == [(0, "[1]"), (1, "[2, 3, 4]"), (2, "[2, 3, 4]"), (3, "[2, 3, 4]")]
    body = value(spark, D.normal_body(F.lit(split[1].body)))
    for r in ctx.collect():
        assert body[: r.position].endswith(r.cit_str) and r.cit_str in r.context
        words = body.split()
        assert r.cit_str.split()[0] in words[r.start_word] and r.cit_str.split()[-1] in words[r.end_word]
    for fmt in E.FORMATS:
        assert E.exported(refs, fmt).filter("entry is not null").count() == 4
    for r in refs.select(E.citation_xml().alias("x")).collect():
        assert ET.fromstring(r.x).get("valid") == "true"
    assert E.formats("ris-bib-ris") == ["bib", "ris"]
    with pytest.raises(ValueError):
        E.formats("nope")


def test_header_and_sections(spark):
    docs = spark.createDataFrame([(1, PAPER), (2, "")], "doc_id long, text string")
    h = {r.doc_id: r for r in pipelines.extract_header(docs).collect()}
    assert h[1].title == "Robust Parsing of References" and h[1].authors == ["Anna Berg", "Hugo Rossi"] and h[1].emails == ["anna@text.example.edu"]
    s = pipelines.extract_sections(docs)
    rows = {r.doc_id: r for r in s.collect()}
    assert rows[2].runs == [] and ("References", "references") in [(g.heading, g.kind) for g in rows[1].generic]
    info = {r.doc_id: r for r in pipelines.structure_info(s).collect()}
    assert info[1].header + info[1].body + info[1].reference == len([x for x in PAPER.split("\n") if x.strip()]) and info[1].reference >= 4
    x = s.filter("doc_id = 1").select(E.envelope("1", E.runs_xml()).alias("x")).first().x
    assert ET.fromstring(x.encode()).find("variant/title").text == "Robust Parsing of References"


@pytest.mark.parametrize("model, make, rows", [(training.citation_model, training.reference, features.token_rows), (training.heading_model, training.headings, features.heading_rows)])
def test_models_on_new_examples(model, make, rows):
    pairs = [(a, b) for s in training.seeded(make, 60, 99) for a, (_, b) in zip(model().label(rows([x for x, _ in s]))[0], s)]
    assert sum(a == b for a, b in pairs) / len(pairs) > 0.95


def test_crf_against_enumeration():
    from itertools import product

    import numpy as np

    seqs = [([["a"], ["b"], ["a"]], ["X", "Y", "X"]), ([["b"], ["b"]], ["Y", "Y"]), ([["a"], ["c"]], ["X", "Z"])]
    m = crf.train(seqs, "B\nU0:%x[0,0]\nU1:%x[-1,0]/%x[0,0]", cost=10)
    rows = [["a"], ["b"], ["c"]]
    e = m.emissions(rows)
    paths = {p: e[0, p[0]] + sum(m.pairs[p[i - 1], p[i]] + e[i, p[i]] for i in (1, 2)) for p in product(range(3), repeat=3)}
    assert m.best(rows) == [m.labels[k] for k in max(paths, key=paths.get)]
    w = {p: np.exp(s) for p, s in paths.items()}
    want = np.array([[sum(v for p, v in w.items() if p[i] == k) for k in range(3)] for i in range(3)]) / sum(w.values())
    assert np.allclose(m.marginals(rows), want)
    assert all(m.best(r) == y for r, y in seqs)


def test_presegmented(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["a", "b", "", "", "c"])], "doc_id int, line_no int, text string")
    assert [(r.cite_no, r.raw) for r in D.presegmented(lines).orderBy("cite_no").collect()] == [(0, "a b"), (1, "c")]


def test_context_limits(spark):
    body = " ".join(["[1]"] + ["word"] * 5) * 1 + " " + " ".join(f"w{i} [1]" for i in range(40))
    bodies = spark.createDataFrame([(1, body)], "doc_id int, body string")
    refs = spark.createDataFrame([(1, 0, ["[1", "(1"])], "doc_id int, cite_no int, keys array<string>")
    assert C.contexts(bodies, refs, radius=3).count() == 10
    wide = C.contexts(bodies, refs, radius=600).collect()
    assert len(wide) == 1 and wide[0].context == body
    assert C.contexts(bodies, refs, radius=600, parity=True).count() == 0
