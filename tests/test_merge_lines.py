import duckdb

from paperloom.plans.catalogue import ORACLE_SQL, QUERIES


def test_every_document_has_a_row(spark, tmp_path):
    texts = [None, "", " ", "short", " led by a space", "ends in one \n", "\n\nt line -\nnext\n", "cut it here, and 3t dash " * 400, "\tx- \n y " * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.merged for r in QUERIES["merge_lines"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(len(texts))) and got[0] is None and got[2] == "" and got[4] == "led by a space" and len(got[7]) > 2000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.sql(ORACLE_SQL["merge_lines"]).fetchall())


def test_driver_table_has_all_rows(spark, sf):
    assert QUERIES["merge_lines"](spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()
