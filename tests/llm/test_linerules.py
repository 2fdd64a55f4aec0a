import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import random

from paperloom.llm.linerules import ORACLE, cleaned, line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, min_docs, share, depleted):
    texts, lines, out = defaultdict(set), defaultdict(set), []
    for _, t, s in rows:
        texts[s].add(t or "")
        for line in (t or "").split("\n"):
            if w := WORD.findall(line):
                lines[s, " ".join(w).lower()].add(t)
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        win = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        n, hit = Counter(win), set()
        for k, x in enumerate(win):
            if n[x] > 1:
                hit |= set(range(k, k + 8))
        full = [x for x in t.split("\n") if WORD.search(x)]
        gone = 0
        for x in full:
            v = WORD.findall(x)
            count = len(lines[s, " ".join(v).lower()])
            if count > min_docs and count > share * len(texts[s]):
                gone += len("".join(v))
        chars = len("".join(w))
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        out.append((i, len(w), chars, sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(hit), failed, gone, not failed and gone <= depleted * chars))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", "Été", "a|b", "#", "x<y>", "word", "other", "ünï"]) + rnd.choice(["", str(rnd.randrange(50))])
    shared = [" ".join(word() for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(120):
        lines = [" ".join(word() for _ in range(rnd.randrange(1, 15))) for _ in range(rnd.randrange(1, 6))]
        lines += rnd.sample(shared, rnd.randrange(3))
        lines += [lines[0].upper()] * rnd.randrange(2) + [" \t"] * rnd.randrange(2) + [lines[-1]] * rnd.randrange(3)
        rows.append((i, "\n".join(lines), rnd.choice(["h1", "h1", "h2", None])))
    rows += [(200 + i, shared[0] + "\n" + shared[1] + f"\n{i}", "h1") for i in range(8)]
    rows += [(300, None, "h1"), (301, "", None), (302, "a b c d e f g h " * 3000, "h2"), (None, "one two", "h1"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, h int, row string")
    got = sorted((tuple(r) for r in line_quality(df, min_docs=3, share=0.02, depleted=0.8).collect()), key=str)
    assert got == brute(rows, 3, 0.02, 0.8)
    assert any(x[7] for x in got) and line_quality(df.limit(0)).count() == 0


def test_driver_table_against_sql(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(ORACLE).df()
    got = line_quality(docs).toPandas()
    key = ["doc_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True)[sorted(got)], want.sort_values(key).reset_index(drop=True)[sorted(want)], check_dtype=False)


def test_cleaned_texts_against_brute_force(spark):
    rnd = random.Random(6)
    shared = [f"shared {k} LINE of the host" for k in range(3)]
    rows = []
    for i in range(60):
        lines = [f"own {i} {k} " + "x" * rnd.randrange(9) for k in range(rnd.randrange(1, 4))] + rnd.sample(shared, rnd.randrange(4)) + [""] * rnd.randrange(3) + [" \t"] * rnd.randrange(2)
        lines += [x.lower().replace(" ", "  ") for x in lines if x in shared and rnd.random() < 0.3]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), rnd.choice(["h1", "h2", None]), i % 7))
    rows += [(90, None, "h1", 1), (91, "", "h2", 2), (None, "alone", None, 3), (5, *rows[5][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    where = defaultdict(set)
    norm = lambda x: " ".join(WORD.findall(x)).lower()
    for _, t, s, _ in rows:
        for x in (t or "").split("\n"):
            where[s, norm(x)].add(t)

    def brute_clean(t, s):
        if t is None:
            return None
        return "\n".join(x for x in t.split("\n") if not norm(x) or len(where[s, norm(x)]) <= 4)

    chars = lambda t: len("".join(WORD.findall(t or "")))
    want = [(i, brute_clean(t, s), s, k) for i, t, s, k in rows]
    assert any(t != u for (_, t, _, _), (_, u, _, _) in zip(rows, want))
    assert sorted(map(tuple, cleaned(df, min_docs=4, depleted=None).collect()), key=str) == sorted(want, key=str)
    fit = [w for w, r in zip(want, rows) if chars(r[1]) - chars(w[1]) <= 0.5 * chars(r[1])]
    assert sorted(map(tuple, cleaned(df, min_docs=4).collect()), key=str) == sorted(fit, key=str) and len(fit) < len(rows)
    assert cleaned(df.limit(0)).count() == 0
