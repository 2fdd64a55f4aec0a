import duckdb
import pandas as pd

from paperloom.llm.linerules import ORACLE, line_quality, rule_counts


def test_planted_lines_in_hosts_of_any_size(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(22))
    notice = " ".join(f"n{k}" for k in range(15))
    long = " ".join(f"b{k}" for k in range(60))
    rows = [(i, own(i) + (f"\n{notice}" if i < 7 else f"\n{long}" if i < 14 else ""), "small") for i in range(20)]
    # a host where a share of the texts would need more than the passage is in
    rows += [(100 + i, own(i) + (f"\n{long}" if i < 30 else ""), "large") for i in range(8000)]
    rows += [(9000, "too short", "small"), (9001, "a b c d e f g h " * 9, "small")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    judged = line_quality(df).cache()
    assert {r.rule: r.rows for r in rule_counts(judged).collect()} == {"short": 1, "repeated": 1, "depleted": 37, "cut": 7, "kept": 7976}
    assert {r.doc_id for r in judged.filter("not kept and not base_failed").collect()} == {*range(7, 14), *range(100, 130)}
    assert {r.rule: r.rows for r in rule_counts(line_quality(df, min_docs=20, share=0.005, depleted=0.8)).collect()} == {"short": 1, "repeated": 1, "kept": 8020}


def test_driver_table_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    want = con.sql(ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    got = line_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False)
    assert (got.removed_chars > 0).sum() > 0


def test_verdicts_come_from_the_cut_texts(spark, monkeypatch):
    from paperloom.llm import linerules

    notice = "  All Rights\tReserved by the owners of   this host "
    rows = [(i, "\n".join([notice.upper() if i % 2 else notice, "", *(f"own{i} line{k} " * 9 for k in range(i % 4)), notice]), "h") for i in range(12)]
    df = spark.createDataFrame([*rows, (20, None, "h"), (0, rows[0][1], "h")], "doc_id long, text string, source string")
    chars = lambda t: len("".join((t or "").split()))
    cut = {r.doc_id: r.text for r in linerules.cleaned(df, depleted=None).collect()}
    before = {r.doc_id: r for r in line_quality(df).collect()}
    assert {i: r.word_chars - r.removed_chars for i, r in before.items()} == {i: chars(t) for i, t in cut.items()}
    assert before[0].removed_chars == 2 * chars(notice) and not before[0].kept
    monkeypatch.setattr(linerules, "_cut", lambda text, gone: text)  # the operator takes the lines out; it doesn't count them instead
    assert all(r.removed_chars == 0 for r in line_quality(df).collect())
