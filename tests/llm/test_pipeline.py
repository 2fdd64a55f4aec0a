from collections import Counter

import corpus_pipeline
import public_tokenizers
import sentencepiece

from paperloom.llm import nbsvm
from tests.llm.test_minhash import brute, shingle_set
from tests.llm.test_pii import base


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "pieces":
            assert out.columns == columns
        rows[name] = out.collect()
        docs = spark.createDataFrame(rows[name], out.schema)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in nbsvm.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("predicted = 1").collect()}
    assert {r.doc_id for r in rows["quality"]} == good and len(rows["quality"]) == len(good)
    comp = brute([(r.doc_id, r.text) for r in rows["quality"]], k=5)
    assert sorted(r.doc_id for r in rows["near_duplicates"]) == sorted(i for i, (_, c) in comp.items() if i == c)
    before = {r.doc_id: r.text for r in rows["near_duplicates"]}
    assert {r.doc_id for r in rows["personal_data"]} == set(before)
    for r in rows["personal_data"]:
        for k, s, e in base(before[r.doc_id]):
            assert before[r.doc_id][s:e] not in r.text and f"<{k}>" in r.text or k == "ip"
        if not any(c.isdigit() or c == "@" for c in before[r.doc_id]):
            assert r.text == before[r.doc_id]
        assert r.n_chars == len(r.text)
    mixed = Counter((r.doc_id, r.text) for r in rows["mixing"])
    assert set(mixed) == {(r.doc_id, r.text) for r in rows["personal_data"]}
    sp = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    texts = {r.doc_id: r.text for r in rows["personal_data"]}
    assert Counter(r.doc_id for r in rows["pieces"]) == Counter(r.doc_id for r in rows["mixing"])
    for r in rows["pieces"]:
        assert r.lossless and sp.decode(list(r.ids)) == texts[r.doc_id] and len(r.ids) == r.n_pieces
    assert shingle_set("a b", 2)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).filter("not lossless").count() == 0
