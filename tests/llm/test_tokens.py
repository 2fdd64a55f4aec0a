import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paperloom.llm import tokencount

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["<|endoftext|>", "a<|startoftext|>b", "<|ENDOFTEXT|>", "\x1c", "\x85", " ", "İ", "Σ", "ΑΣ", "é", " ́", "it's", "'S", "don't", "12 345", "日本", "​", "...", "x" * 200, "　", "ﬁ", "\n\n", "\x00"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(max_size=12), st.just(" ")), max_size=8).map("".join))
def test_sum_over_pre_tokens_is_the_librarys_count(text):
    whole = Tokenizer.from_file(PATH)
    want = len(whole.encode(text, add_special_tokens=False))
    assert tokencount.count_texts([text.encode()], {}, tokencount.counter(PATH)) == [want]


def test_query_rows(spark, sf):
    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(9001, None), (9002, ""), (9003, " ".join(ODD)), (None, "a b"), (9004, "word " * 50_000), (9004, "word " * 50_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tokencount.token_counts(df, PATH).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False)), n > 2048) for i, t in rows]
    assert got == sorted(want, key=str)
    assert tokencount.token_counts(df.limit(0), PATH).count() == 0


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE", 50)
    cache = tokencount.Counts(PATH)
    for k in range(20):
        cache.learn({f"w{k}x{j}".encode() for j in range(30)})
    assert len(cache.young) + len(cache.old) <= 50 + 30 + 51
    assert cache.learn({b"hello", b"w3x4"}) == {b"hello": 1, b"w3x4": len(cache.tokenizer.encode("w3x4", add_special_tokens=False))}
