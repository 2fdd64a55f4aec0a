import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from paperloom.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*WORD.findall("".join(c.lower() if c.isascii() else c for c in text or "")), None]


def brute(rows):
    """doc_id to the result, and a function P(w | h)."""
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    uni, bi, after = Counter(), Counter(), defaultdict(set)
    for _, t in train:
        w = tokens(t)
        uni.update(w)
        for h, x in zip(["<s>", *w], w):
            bi[h, x] += 1
            after[h].add(x)
    n, v = sum(uni.values()), len(uni)
    of = lambda c: [sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]
    u, d = katz.Unigram(of(uni), n, v), katz.discounts(of(bi))
    p1 = lambda w: float(u(np.array([uni[w]]))[0])
    disc = lambda c: c * (d[c] if c <= katz.K else 1.0)
    cache = {}

    def p(w, h):
        if h not in after:
            return p1(w)
        if h not in cache:
            total = sum(bi[h, x] for x in after[h])
            kept = sum(disc(bi[h, x]) for x in after[h])
            div = total + (kept > total - 1e-9)
            left = 1 - (total if div > total else kept) / div
            cache[h] = div, left / (1 - sum(p1(x) for x in after[h]))
        div, alpha = cache[h]
        return disc(bi[h, w]) / div if bi[h, w] else alpha * p1(w)

    out = {}
    for i, t in rows:
        w = tokens(t)
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(x, h)) for h, x in zip(["<s>", *w], w)))
    return out, p, uni, after


def compare(got, want):
    assert len(got) == len(want)
    for r in got:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, abs=1e-8) and r.score == pytest.approx(score, abs=1e-8)


def test_driver_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, p, uni, after = brute(rows)
    compare(katz.language_model_scores(docs).collect(), want)
    for h in ["<s>", *random.Random(1).sample(sorted(x for x in after if x and x != "<s>"), 5)]:
        assert sum(p(w, h) for w in uni) + p("never seen", h) == pytest.approx(1, abs=1e-9)


def test_many_small_batches(spark, monkeypatch, sf):
    monkeypatch.setattr(katz, "ENTRIES", 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    compare(katz.language_model_scores(docs).collect(), brute(rows)[0])


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A a  a\tb"), (5, "é É"), (6, "word " * 40_000), (7, "a b c d e f g")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, score int")
    compare(katz.language_model_scores(df).collect(), brute(rows)[0])
    assert katz.language_model_scores(df.limit(0)).count() == 0
    twice = katz.language_model_scores(spark.createDataFrame([(3, "x y"), (3, "x y"), (None, "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.train_tokens, r.n_tokens) for r in twice) == [(0, 8, 2), (3, 8, 3), (3, 8, 3)]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (only,) = katz.language_model_scores(spark.createDataFrame([(held, "x y")], "doc_id long, text string")).collect()
    assert (only.train_tokens, only.n_known, only.base_score, only.score) == (0, 0, 0.0, 0.0)


def test_discounts():
    d = katz.discounts([1000, 400, 200, 120, 80, 55])
    assert d[0] == 1 and d[1] == pytest.approx((2 * 400 / 1000 - 6 * 55 / 1000) / (1 - 6 * 55 / 1000))
    assert (katz.discounts([0] * 6) == 1).all()
    assert katz.discounts([5, 0, 0, 0, 0, 0])[1] == 0.5


def test_packed_keys_and_counts():
    rng = np.random.default_rng(1)
    for keys in (np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.array([5], np.uint64), np.array([2**64 - 1, 3, 2**63, 0], np.uint64), np.arange(10, dtype=np.uint64)):
        assert (katz.unpack_keys(katz.pack_keys(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (katz.unpack(*katz.pack(counts)) == counts).all()
