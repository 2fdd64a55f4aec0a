import zlib

import numpy as np
import pyarrow as pa

from paperloom.llm import nbsvm


def test_held_out_accuracy_on_driver_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = nbsvm.quality_scores(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    good, bad = [np.array([r.score for r in held if r.quality == k]) for k in (1, 0)]
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_features_are_indicators():
    ids, first = nbsvm.features(pa.array(["a a a a", None, "", "A a", "x | y"]))
    rows = [set(ids[first[i] : first[i + 1]].tolist()) for i in range(5)]
    assert len(ids) == sum(map(len, rows)) and not rows[1] and not rows[2]
    assert {s for s in rows[0] if s < nbsvm.WORDS} == {s for s in rows[3] if s < nbsvm.WORDS}
    ids2, first2 = nbsvm.features(pa.array(["z", "x | y"]))
    assert set(ids2[first2[1] : first2[2]].tolist()) == rows[4]


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)).astype(np.int32) for _ in range(80)]
    labels = np.array([int((r < 20).sum() > (r >= 20).sum()) for r in rows])
    y, values, cost = np.where(labels > 0, 1.0, -1.0), [np.ones(len(r)) / np.sqrt(len(r)) for r in rows], np.full(80, 2.0)
    w, bias, alpha = nbsvm.descend(rows, values, y, cost, 40, 400)
    slack = np.array([max(0, 1 - t * (w[r] @ v + bias)) for r, v, t in zip(rows, values, y)])
    primal = (w @ w + bias**2) / 2 + (cost * slack).sum()
    dual = alpha.sum() - (w @ w + bias**2) / 2
    assert ((0 <= alpha) & (alpha <= cost)).all() and 0 <= primal - dual < 1e-3 * primal


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 3), (2, "", 3), (None, "a b", 3), (2, "", 3), (4, "word " * 50_000, 3)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in nbsvm.quality_scores(docs, none).collect()] == [0.5] * 5
    one = spark.createDataFrame([(i, 1) for i in range(9)] + [(None, 0), (5, None)], "doc_id long, quality int")
    assert {r.predicted for r in nbsvm.quality_scores(docs, one).collect()} == {1}
    assert nbsvm.quality_scores(docs.limit(0), one).count() == 0


def brute_slots(text):
    """The features by loops over words and characters, each hashed alone."""
    import re

    from paperloom.llm.text import hash_spans, mix, pair

    kind = lambda c: 4 if c in b"0123456789" else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 or c >= 128 else 8 if 33 <= c <= 126 else 0
    words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
    one = lambda w: hash_spans(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))
    h, shape = [one(w) for w in words], []
    for j, w in enumerate(words):
        kinds = 0
        for c in w:
            kinds |= kind(c)
        x = kinds + (kind(w[-1]) << 4) + (kind(w[0]) << 8) + ((len(w) == 1) << 12) + ((j > 0 and h[j - 1] == h[j])[0] << 13 if j else 0)
        x += (w[-1] if kind(w[-1]) == 8 else 0) << 16
        shape.append(mix(np.array([x + 1], np.uint64)))
    slot = lambda x, m: int(x[0] >> np.uint64(40)) % m
    out = {slot(x, nbsvm.WORDS) for x in h} | {slot(pair(a, b), nbsvm.WORDS) for a, b in zip(h, h[1:])}
    for j in range(len(words)):
        g = shape[j]
        for k in range(1, 5):
            if j + k > len(words):
                break
            g = pair(g, shape[j + k - 1]) if k > 1 else g
            out.add(nbsvm.WORDS + slot(g, nbsvm.SHAPES))
    return out


def test_fit_and_scores_against_brute_force(monkeypatch):
    monkeypatch.setattr(nbsvm, "EPOCHS", 400)  # to the optimum
    rnd = np.random.default_rng(6)
    texts = [" ".join(rnd.choice(["The", "the", "of", "été", "x1", "#", "!!", "End.", "ABC", "a"], rnd.integers(0, 25))) for _ in range(90)] + ["", " \n", "one"]
    ids, first = nbsvm.features(pa.array(texts))
    mine = [brute_slots(t) for t in texts]
    assert [set(ids[a:b].tolist()) for a, b in zip(first, first[1:])] == mine and first[-1] == sum(map(len, mine))
    # log-count ratios and the hinge objective by loops; the fitted weights are the optimum of a dense subgradient descent
    y = np.array([1 if ("!!" in t) else -1 for t in texts])
    rows = [np.array(sorted(s), np.int64) for s in mine]
    weights, bias, a, shift = nbsvm.fit(rows, (y > 0).astype(int))
    used = sorted(set().union(*mine))
    count = {s: [nbsvm.SMOOTH + sum(s in m for m, z in zip(mine, y) if z == c) for c in (1, -1)] for s in used}
    size = nbsvm.WORDS + nbsvm.SHAPES
    norm = [nbsvm.SMOOTH * size + sum(len(m) for m, z in zip(mine, y) if z == c) for c in (1, -1)]
    ratio = {s: np.log(p / norm[0]) - np.log(q / norm[1]) for s, (p, q) in count.items()}
    x = np.zeros((len(rows), len(used) + 1))
    for j, m in enumerate(mine):
        for s in m:
            x[j, used.index(s)] = ratio[s] / np.sqrt(max(1, len(m)))
        x[j, -1] = 1.0
    cost = nbsvm.COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    fitted = np.array([weights[s] / ratio[s] if ratio[s] else 0.0 for s in used] + [bias])
    best, w = np.inf, np.zeros(x.shape[1])
    for t in range(1, 6000):
        w = w - (w - ((cost * y * (y * (x @ w) < 1)) @ x)) / t
        best = min(best, objective(w))
    assert objective(fitted) <= best * 1.01
    want = []
    for m in mine:
        z = a * (sum(weights[s] for s in m) / np.sqrt(max(1, len(m))) + bias) + shift
        want.append(1 / (1 + np.exp(-min(30, max(-30, z)))))
    assert np.allclose(nbsvm.scores(pa.array(texts), weights, bias, a, shift), want, atol=1e-8)
