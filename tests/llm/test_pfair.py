import hashlib
import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from paperloom.llm.pfair import ORACLE, mixed, pattern

DOCS = "doc_id long, text string, source string, slot long, share string"


def edf(share):
    """Earliest deadline first over one frame, by simulation."""
    frame, done, order = sum(share), [0] * len(share), []
    for t in range(frame):
        ready = [(math.ceil(Fraction((done[s] + 1) * frame, share[s])), s) for s in range(len(share)) if Fraction(done[s] * frame, share[s]) // 1 <= t]
        order.append(min(ready)[1])
        done[order[-1]] += 1
    return order


def brute(rows, frame, size, temperature, seed=1):
    """The whole mixture of (doc_id, text, source) by simulation."""
    by = defaultdict(list)
    for i, text, source in rows:
        key = hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:16]
        by[source].append((key, i, len(text or "")))
    names = sorted(by, key=lambda s: (s is not None, s or ""))
    units = [sum(n for _, _, n in by[s]) for s in names]
    w = [max(u, 1) ** temperature for u in units]
    ideal = [x / sum(w) * (frame - len(names)) for x in w]
    share = [1 + math.floor(x) for x in ideal]
    for k in sorted(range(len(names)), key=lambda k: (round(math.floor(ideal[k]) - ideal[k], 9), k))[: frame - sum(share)]:
        share[k] += 1
    blocks = [max(1, math.ceil(u / size)) for u in units]
    order, begun, out, done = edf(share), [], [], [0] * len(names)
    placed = []
    for s in names:
        at, mine = 0, defaultdict(list)
        for _, i, n in sorted(by[s], key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            mine[min(at // size, blocks[len(placed)] - 1)].append((i, at))
            at += n
        placed.append(mine)
    slot = 0
    while any(d < b for d, b in zip(done, blocks)):
        s = order[slot % frame]
        block, epoch = done[s] % blocks[s], done[s] // blocks[s]
        out += [(i, names[s], block, epoch, slot, at) for i, at in placed[s][block]]
        done[s] += 1
        slot += 1
    return out


@pytest.mark.parametrize("share", [[1], [3, 2], [500, 300, 199, 1], [7, 7, 7, 7, 1, 1], [97, 1, 1, 1]])
def test_pattern_is_edf_within_a_block(spark, share):
    rows = pattern(spark.createDataFrame(list(enumerate(share)), "rank int, share int")).orderBy("slot").collect()
    assert [r["rank"] for r in rows] == edf(share)
    done = [0] * len(share)
    for t, r in enumerate(rows):
        assert r.nth == done[r["rank"]]
        done[r["rank"]] += 1
        assert all(abs(d - Fraction(s * (t + 1), sum(share))) < 1 for d, s in zip(done, share))


def test_mixture_against_simulation(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randrange(400), rnd.choice("aaaaaabc")) for i in range(400)] + [(None, "zz", None), (1000, None, "c"), (1001, "", "d"), (1002, "y" * 30000, "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)
    got = [(r.doc_id, r.source, r.block, r.epoch, r.slot, r["at"]) for r in mixed(df, frame=40, block_units=1000).collect()]
    key = lambda r: tuple((x is not None, x) if x is None else (True, x) for x in r)
    assert Counter(got) == Counter(brute(rows, 40, 1000, 0.8))
    assert {r[0] for r in got} == {r[0] for r in rows} and key


def test_edges(spark):
    df = spark.createDataFrame([(1, "ab", "s", 1, "x"), (1, "ab", "s", 1, "x")], DOCS)
    assert sorted((r.doc_id, r.epoch) for r in mixed(df).collect()) == [(1, 0), (1, 0)]
    assert mixed(df.limit(0)).count() == 0
    many = spark.createDataFrame([(i, "a", f"s{i}", 1, "x") for i in range(9)], DOCS)
    rows = [(r.doc_id, r.text, r.source) for r in many.collect()]
    got = mixed(many, frame=5, block_units=10).collect()  # more sources than slots: two slots for each
    assert sorted((r.doc_id, r.source, r.block, r.epoch, r.slot, r["at"]) for r in got) == sorted(brute(rows, 2 * len({s for _, _, s in rows}), 10, 0.8))
    none = mixed(many, weights={"s0": 1.0, "s1": 0.0}, frame=9, block_units=10).collect()
    assert {r.source for r in none} == {"s0"} and len(none) == sum(s == "s0" for _, _, s in rows)
    even = mixed(many, weights={f"s{i}": 1.0 for i in range(9)}, frame=9, block_units=10).collect()
    assert sorted(r.slot for r in even) == list(range(9))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_driver_table_against_sql(spark, size):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{size}/documents.parquet'")
    want, got = con.sql(ORACLE).df(), mixed(spark.read.parquet(f"/root/testdata/{size}/documents.parquet")).toPandas()
    cols = sorted(want)
    assert cols == sorted(got)
    a, b = (x[cols].sort_values(["slot", "at", "doc_id"]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
