from paperloom.operators import evaluate as V
from paperloom.operators import features, splitlines, training
from pyspark.sql import functions as F


def test_cross_validation(spark):
    seqs = [(features.heading_rows([t for t, _ in s]), [y for _, y in s]) for s in training.seeded(training.headings, 60, 7)]
    rows = V.cross_validate(spark, seqs, "B\nU0:%x[0,0]\nU1:%x[0,1]\nU2:%x[0,3]", k=3)
    per, overall = V.evaluate(rows)
    o = overall.first()
    assert o.n == sum(len(r) for r, _ in seqs) and o.accuracy > 0.9
    assert {r.label for r in per.collect()} >= {"method", "references"}


def test_small_steps(spark):
    folds = spark.range(11).select(V.contiguous_fold(F.col("id"), F.lit(11), 3).alias("f")).collect()
    assert [r.f for r in folds] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2]
    lines = spark.createDataFrame([(1, 0, "Title of it"), (1, 1, ""), (1, 2, "Abstract"), (1, 3, "We do"), (1, 4, "1 Introduction"), (1, 5, "x")], "doc_id int, line_no int, text string")
    assert [r.state for r in V.front_state(lines).orderBy("line_no").collect()] == [0, 0, 1, 1, 2, 2]
    labels = spark.createDataFrame([(1, 0, "title")], "doc_id int, line_no int, label string")
    assert [r.label for r in V.section_text(lines, labels).orderBy("line_no").collect()] == ["title"] + ["none"] * 5
    both = lines.withColumns({"gold": F.lit("a"), "guess": F.lit("b")})
    assert V.line_to_token_labels(both).count() == 9
    assert V.known_tags(labels, "label", ["author"]).count() == 0


def test_split_lines(spark):
    rows = [(1, i, t, p, 10, 50, "no", "no", "no") for i, (t, p) in enumerate([("Berg, A., Rossi, H., and Silva, L., eds", 0), ("Fast pars-", 0), ("ing of records. 1999.", 0), ("Weiss V (2001)", 1)])]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, text string, para int, font_size int, left int, bold string, italic string, bullet string")
    got = splitlines.split_features(lines).orderBy("line_no").collect()
    assert [r.authors for r in got][0] == "longAuthorLine" and [r.year for r in got] == ["noYear", "noYear", "hasYear", "hasYear"]
    assert [r.ending for r in got] == ["others", "hyphen", "period", "cbracket"] and [r.paragraph for r in got] == ["new", "continue", "continue", "new"]
    assert all(r.size == r.place == "normal" for r in got)
    labelled = lines.withColumn("label", F.when(F.col("line_no").isin(0, 3), "begin").otherwise("continue"))
    assert [r.raw for r in splitlines.split_by_labels(labelled).orderBy("cite_no").collect()] == ["Berg, A., Rossi, H., and Silva, L., eds Fast parsing of records. 1999.", "Weiss V (2001)"]
