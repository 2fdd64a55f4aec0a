"""Near-duplicate documents by MinHash: banded universal minima, signature check, full-set confirmation, components.

1. One pass over the texts gives each row its shingle set's size, a 128-bit key of the set, up to 200 minima of universal
   hashes (a * x + b mod 2^32), band keys, and one byte of each minimum as signature. Bands, their rows and the estimate's
   limit follow from the similarity: at 0.8 there are 40 bands of 5, and a pair shares none with probability 1.2e-7.
2. Rows with one set form one class (its smallest doc_id); all else works on classes, so exact copies cost nothing.
3. In every bucket each class is paired with the bucket's smallest one: rows, not pairs, per bucket. Pairs pass the size
   bound, the signature estimate, then the full sets.
4. Confirmed links give components by alternating large-star and small-star.
5. Buckets that still hold several components are the rest: their members are compared across components, in blocks of
   bounded size spread over tasks by signature, and again confirmed on full sets. So no link between bucket mates is lost.
   Members of a bucket of over HOT classes are first bucketed again by this band and a second one, as a similar pair shares
   two (all but 2.6e-6 of pairs at exactly 0.8): half-alike pages of one template mostly part there.

Only fixed-size rows are shuffled, but for the texts of candidates: members go to their leader's part, a leader of many
members has several. Tables are written, so the planner knows their sizes; AQE splits the joins of a hub's edges. Nothing
is collected or broadcast by hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop_written, ship, written
from .text import U64, mix, shingles, slices, words

MOST = 200  # minima at most
MISS = 2e-7  # probability that a pair at the limit shares no band
BLOCK = 256  # members compared with each other at a time
HOT = 2048  # members of a bucket that are bucketed again
MEMBERS = 4096  # candidates of a leader in one part
_rng = np.random.default_rng(7)
_A = (_rng.integers(0, 2**31, MOST, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _rng.integers(0, 2**32, MOST, dtype=np.uint32)[:, None]
_SALT = _rng.integers(0, 2**63, MOST, dtype=np.uint64) | U64(1)


def banding(percent: int) -> tuple[int, int, float]:
    """Bands, rows of a band, and the least share of equal minima, seven standard errors below percent / 100."""
    s = percent / 100
    fits = [r for r in range(1, 21) if (1 - s**r) ** (MOST // r) <= MISS]
    if not fits or not 0 < percent <= 100:
        raise ValueError(f"percent must be between 8 and 100, not {percent}")
    rows = max(fits)
    bands = MOST // rows
    return bands, rows, max(0.0, s - 7 * (s * (1 - s) / (bands * rows)) ** 0.5)


def minima(s: np.ndarray, n: int = MOST) -> np.ndarray:
    """The minimum of each universal hash over a set."""
    x = (s >> U64(32)).astype(np.uint32)[None, :]
    out = np.full(n, 2**32 - 1, np.uint32)
    for i in range(0, x.shape[1], 1024):
        part = x[:, i : i + 1024] * _A[:n]
        part += _B[:n]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def _fingerprint(k: int, n_bands: int, n_rows: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                h, first = words(batch.column(1))
                n, keys, bands, sigs = [], [], [], []
                for i in range(batch.num_rows):
                    s = shingles(h[first[i] : first[i + 1]], k)
                    n.append(len(s))
                    if not len(s):
                        keys.append(None), bands.append(None), sigs.append(None)
                        continue
                    m = minima(s, n_bands * n_rows)
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    b = mix((m.astype(U64) * _SALT[: len(m)]).reshape(n_bands, n_rows).sum(axis=1, dtype=U64) + np.arange(n_bands, dtype=U64))
                    bands.append(b.view(np.int64))
                    sigs.append(mix(m.astype(U64)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], schema=schema)

    return run


def _by_estimate(n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, n) for k in (2, 3))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return run


def _confirm(k: int, percent: int):
    """Rows (a, part, role, b, text) in that order: the texts of a leader a (role 0), then those of its candidates b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, sets = None, []
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                h, first = words(batch.column(4))
                found = []
                for i, (a, role, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)))):
                    s = shingles(h[first[i] : first[i + 1]], k)
                    if a != leader:
                        leader, sets = a, []
                    if not role:
                        if not any(np.array_equal(s, x) for x in sets):
                            sets.append(s)  # one, unless rows with different texts repeat the id
                        continue
                    for x in sets:
                        both = len(np.intersect1d(x, s, assume_unique=True))
                        if both and 100 * both >= percent * (len(x) + len(s) - both):
                            found.append((a, b))
                            break
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def _blocks(n_minima: int, least: float, percent: int):
    """Rows sorted by (key, i, j): members of a block pair. Gives the pairs of different components that may be similar."""

    def pairs(ids, comp, n, block, sig, i, j):
        rows, cols = (np.flatnonzero(block == x) for x in (i, j))
        if not len(rows) or not len(cols):
            return None
        x = np.frombuffer(b"".join(sig[r] for r in rows), np.uint8).reshape(-1, n_minima)
        y = np.frombuffer(b"".join(sig[r] for r in cols), np.uint8).reshape(-1, n_minima)
        same = np.zeros((len(rows), len(cols)), np.float32)
        for a in range(0, len(rows), 32):
            same[a : a + 32] = (x[a : a + 32, None, :] == y[None, :, :]).mean(axis=2)
        nx, ny = n[rows][:, None], n[cols][None, :]
        ok = (same >= least) & (comp[rows][:, None] != comp[cols][None, :]) & (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny))
        a, b = np.nonzero(ok)
        a, b = ids[rows[a]], ids[cols[b]]
        return np.minimum(a, b), np.maximum(a, b)

    def flush(rows):
        key = rows[0][:3]
        _, _, _, ids, comp, n, block, sig = zip(*rows)
        return pairs(np.array(ids), np.array(comp), np.array(n), np.array(block), sig, key[1], key[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[0][:3] != row[:3]:
                    out.append(flush(held))
                    held = []
                held.append(row)
            yield _pairs(out)
        if held:
            yield _pairs([flush(held)])

    return run


def _pairs(found: list) -> pa.RecordBatch:
    found = [x for x in found if x is not None]
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable.

    Alternating large-star and small-star; every round is a written table, so a lost executor costs a round at most. No
    neighbourhood is collected: a node's smallest neighbour is an aggregate, joined back to its edges. No edges: empty.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("v", "u"))  # both directions
        low = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = e.join(low, "u")
        if large:
            out = out.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = out.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v")
        return out.distinct()

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    cur = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges", spark)
    was = state(cur)
    while was[0]:
        nxt = written(star(written_large := written(star(cur, True), "large", spark), False), "small", spark)
        drop_written(written_large, spark)
        now = state(nxt)
        drop_written(cur, spark)
        cur = nxt
        if tuple(now) == tuple(was):
            break
        was = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Two texts are linked if their sets of k-word shingles have a Jaccard similarity of percent / 100 or more (8 to 100;
    other values are an error). A null or
    wordless text has an empty set, is linked with nothing and is kept. Rows that repeat a doc_id count as one node. A
    row without doc_id belongs to the class of its set, if a row with an id has the same set; else its component is null
    and it is kept. An empty table gives an empty result. Equal texts are ties: the smallest doc_id is kept.
    """
    bands, rows, least = banding(percent)
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fp = written(docs.mapInArrow(_fingerprint(k, bands, rows), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"), "fingerprints", spark)
    reps = fp.filter("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep")).filter("rep is not null")
    reps = written(reps, "classes", spark)
    nodes = written(fp.join(reps.withColumnRenamed("rep", "doc_id"), ["set_key", "doc_id"]).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "bands", "sig"), "nodes", spark)

    in_band = nodes.select("rep", F.explode("bands").alias("key"))
    buckets = in_band.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).filter("members > 1")
    shared = written(in_band.join(buckets, "key"), "buckets", spark)
    sig = nodes.select("rep", "n", "sig")

    def estimated(pairs: DataFrame) -> DataFrame:
        pairs = pairs.join(sig.toDF("a", "n_a", "sig_a"), "a").join(sig.toDF("b", "n_b", "sig_b"), "b")
        pairs = pairs.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent).select("a", "b", "sig_a", "sig_b")
        return written(pairs.mapInArrow(_by_estimate(bands * rows, least), "a long, b long"), "candidates", spark)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """pairs: a written table of distinct pairs. Only the texts of their members leave the rows of docs."""
        ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids", spark)
        texts = docs.join(ids, "doc_id", "left_semi")
        parts = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "leaders", spark)
        members = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "b").join(texts.toDF("b", "text"), "b")
        leaders = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("b")).join(texts.toDF("a", "text"), "a")
        order = ["a", "part", "role", "b", "text"]
        both = members.select(*order).union(leaders.select(*order)).repartition("a", "part").sortWithinPartitions("a", "part", "role")
        return both.mapInArrow(_confirm(k, percent), "a long, b long")

    stars = shared.filter("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    edges = written(confirmed(estimated(stars)), "links", spark)
    found = written(components(edges, spark), "components", spark)

    comp = found.withColumnRenamed("node", "rep")

    def mixed(members: DataFrame) -> DataFrame:
        """Members (key, rep, component) of the keys with several components, and each key's number of members."""
        keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).filter("lo != hi").select("key", "members")
        return members.select("key", "rep", "component").join(keys, "key")

    rest = shared.filter("members > 2").select("key", "rep").join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    rest = written(mixed(rest), "mixed", spark)
    hot = rest.filter(F.col("members") > HOT)
    if hot.limit(1).count():
        again = hot.join(nodes.select("rep", F.explode("bands").alias("second")), "rep").filter("second != key")
        again = again.select(F.xxhash64(F.least("key", "second"), F.greatest("key", "second")).alias("key"), "rep", "component").distinct()
        rest = rest.filter(F.col("members") <= HOT).unionByName(written(mixed(again), "mixed_again", spark))
    rest = rest.join(sig, "rep").withColumn("parts", F.ceil(F.col("members") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep", "key"), "parts").cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rest = rest.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "n", "block", "sig")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = written(rest.mapInArrow(_blocks(bands * rows, least, percent), "a long, b long").distinct(), "rest", spark)
    if more.limit(1).count():
        extra = written(confirmed(more), "more", spark)
        found = written(components(extra.union(found.filter("node != component").toDF("a", "b")), spark), "components", spark)
    drop_written(shared, spark)

    out = fp.select("doc_id", "n_shingles", "set_key").join(reps, "set_key", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id; all columns. See near_duplicates.

    Rows without doc_id stay; rows that repeat the kept doc_id are that document, and stay.
    """
    gone = written(near_duplicates(docs, k, percent).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone")).distinct(), "dropped", docs.sparkSession)
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
