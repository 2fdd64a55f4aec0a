import pytest

from paperloom.operators import affiliations as A
from paperloom.operators import layout as L
from paperloom.operators import pipelines
from paperloom.operators import tables as T
from paperloom.sources import readers as R
from paperloom.streaming.ingest import extracted, paper_stream

XML = """<?xml version="1.0"?><document><page><body><section><column>
<para alignment="centered"><ln l="10" t="5" r="90" b="15" fontSize="1400" bold="true" fontFace="Serif"><wd l="10" t="5" r="40" b="15">Big</wd><space/><wd l="45" t="5" r="90" b="15">Title</wd></ln></para>
<para><ln l="10" t="30" r="90" b="40" fontSize="1000"><wd>A</wd><space/><run bold="true"><wd>B</wd></run><tab/><wd><run>C</run><run subsuperscript="superscript">1</run></wd></ln><ln l="10" t="45" r="90" b="55" fontSize="1000"><wd>x &amp; y</wd></ln></para>
</column><dd l="0" t="60" r="9" b="70"><para><ln t="60" b="70" fontSize="800" bold="true"><wd>in picture</wd></ln></para></dd></section></body></page></document>
<?xml version="1.0"?><!-- next --><document><page><body><section><column><table><cell><para><ln t="5" b="9" fontSize="1000"><wd>cell</wd></ln></para></cell></table></column></section></body></page></document>"""


def test_layout(spark):
    docs = spark.createDataFrame([(1, XML), (2, None)], "doc_id long, xml string")
    words = L.layout_words(docs)
    rows = words.orderBy("page", "col", "para", "ln", "word").collect()
    assert [r.text for r in rows] == ["Big", "Title", "A", "B", "C", "1", "x & y", "in picture", "cell"]
    assert [r.bold for r in rows[:4]] == [True, True, False, True] and rows[5].script == "superscript" and rows[8].kind == "table"
    lines = L.layout_lines(words)
    got = {r.text: r for r in L.layout_features(lines).collect()}
    assert got["Big Title"].bold == "yes" and got["Big Title"].size_class == "larger" and got["A B C 1"].bold == "no"
    assert got["in picture"].bold == "no" and got["in picture"].pic == "yes" and got["in picture"].font_size == -1 and got["cell"].table == "yes"
    assert got["x & y"].paragraph_diff == "continue" and got["A B C 1"].paragraph_diff == "new"
    assert L.line_range(lines, (0, 0, 1, 0), (0, 1, 0, 0)).count() == 3
    assert L.line_set(lines, lines.filter("page = 1").select("doc_id", *L.LINE)).count() == 1
    assert "<word>x &amp; y</word>" in L.simplified(words).first().markup
    with pytest.raises(Exception, match="document 7"):
        L.layout_words(spark.createDataFrame([(7, "<a>")], "doc_id long, xml string")).collect()


def test_grid_and_spacing(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, ["a", "b"]), (1, 0, 0, 1, ["c"])], "doc_id int, table_no int, row int, col int, lines array<string>")
    assert [r.text for r in L.table_grid(cells).orderBy("line").collect()] == ["a\tc", "b\t"]
    gaps = spark.createDataFrame([(1, g) for g in [2] * 10 + [3] * 9 + [4] * 2 + [9]], "doc_id int, gap int")
    assert {r.gap for r in L.spacing(gaps, "doc_id", "gap").filter("wide = 'yes'").collect()} == {4, 9}


def test_affiliations(spark):
    s = "doc_id int, {0}_no int, {0} string, signals array<string>, page int, section int, para int, line int, x double, y double"
    authors = spark.createDataFrame([(1, 0, "Ann", ["1"], 0, 0, 0, 0, 10.0, 10.0), (1, 1, "Bo", ["2", "1"], 0, 0, 0, 0, 50.0, 10.0), (1, 2, "Cy", [""], 0, 0, 1, 0, 90.0, 40.0)], s.format("author"))
    affs = spark.createDataFrame([(1, 0, "Oslo", ["1"], 0, 0, 2, 0, 10.0, 20.0), (1, 1, "Lima", ["2"], 0, 0, 3, 0, 90.0, 45.0), (1, 2, "Kyoto", [""], 0, 0, 4, 0, 10.0, 90.0)], s.format("affiliation"))
    m = A.match_affiliations(authors, affs)
    assert {(r.author, r.affiliation) for r in m.filter("label = 'yes'").collect()} == {("Ann", "Oslo"), ("Bo", "Oslo"), ("Bo", "Lima"), ("Cy", "Lima")}
    assert m.count() == 9 and "<fullname>Bo</fullname><institution>Oslo</institution><institution>Lima</institution>" in A.author_xml(m).first().xml


def test_signal_fanout_and_chunks(spark):
    rows = spark.createDataFrame([(1, i, k, v) for i, (k, v) in enumerate([("author", "a"), ("author", "b"), ("signal", "1"), ("signal", "2"), ("author", "c"), ("signal", "3")])], "doc_id int, i int, kind string, v string")
    assert {(r.author, r.signal) for r in T.signal_fanout(rows, "doc_id", "i", "kind", "v").collect()} == {("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "3")}
    tags = spark.createDataFrame([(1, i, g, s) for i, (g, s) in enumerate([("B-x", "B-x"), ("I-x", "I-x"), ("O", "B-y"), ("B-y", "I-y"), ("B-x", "B-x")])], "k int, i int, gold string, guess string")
    got = {r.label: (r.tp, r.fp, r.fn) for r in T.chunk_scores(tags, "k", "i", "gold", "guess").collect()}
    assert got == {"x": (2, 0, 0), "y": (0, 1, 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("one\ntwo\n")
    (tmp_path / "in/b.txt").write_text("References\n[1] x\n")
    assert {r.text for r in R.papers(spark, str(tmp_path / "in")).collect()} == {"one\ntwo\n", "References\n[1] x\n"}
    assert [r.raw for r in R.references(spark, str(tmp_path / "in/a.txt")).orderBy("cite_no").collect()] == ["one", "two"]
    (tmp_path / "u.txt").write_bytes("été".encode("utf-16"))
    assert R.utf16(spark, str(tmp_path / "u.txt")).first().text == "été"
    lines = spark.createDataFrame([(0, "# no"), (1, "<author> A. Berg </author> <date> 1999 </date>")], "seq_no int, line string")
    assert [(r.tok, r.gold) for r in R.tagged_tokens(lines).orderBy("tok_no").collect()] == [("A.", "author"), ("Berg", "author"), ("1999", "date")]
    with pytest.raises(Exception, match="tags don't match"):
        R.tagged_tokens(spark.createDataFrame([(1, "<a> x </b>")], "seq_no int, line string")).collect()
    multi = spark.createDataFrame([(1, "<title> a b +L+ c +L+ </title> <author> d +L+ </author>")], "doc_id int, text string")
    assert [(r.gold, r.line) for r in R.tagged_lines(multi).orderBy("line_no").collect()] == [("title", "a b"), ("title", "c"), ("author", "d")]
    gaz = T.gazetteer(spark.createDataFrame(R.word_list(["## Male names", "anna\t0.1", "# note", "## Last names", "Anna", "berg"]), "word string, mask int"))
    assert {(r.word, r["mask"]) for r in gaz.collect()} == {("anna", 5), ("berg", 4)}
    assert R.keyword_lists(["title: a b", "x"]) == [("title", "a"), ("title", "b")]
    assert not R.FeatureConfig.read(["ngrams=0 # off", "layout=1"]).ngrams
    with pytest.raises(ValueError):
        R.FeatureConfig.read(["nope=1"])
    assert R.resolve("p/x.txt", "lib", {"lib": "/mnt/lib/"}) == "/mnt/lib/p/x.txt" and R.resolve("/x", "LOCAL", {}) == "/x"
    for bad in (("x", "other"), ("../x", "lib")):
        with pytest.raises(ValueError):
            R.resolve(*bad, {"lib": "/mnt"})
    R.write_cache(spark.createDataFrame([("http://a", "1"), ("http://b", "2")], "url string, body string"), str(tmp_path / "cache"))
    assert [r.body for r in R.cached(spark, str(tmp_path / "cache"), "http://b").collect()] == ["2"]
    q = extracted(paper_stream(spark, str(tmp_path / "in")), lambda d: pipelines.D.line_counts(d), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert {r.n_lines for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {2}
