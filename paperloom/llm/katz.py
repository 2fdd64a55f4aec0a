"""Language-model scores by Katz backoff: Good-Turing discounted bigram and unigram counts, exactly normalised.

P(w | h) = d(c(h,w)) c(h,w) / c(h) if the pair was seen in training, else a(h) P(w); P(w) = d(c(w)) c(w) / N if the word
was seen, else the mass that discounting left, as one open class. a(h) is the mass left by h's pairs over the unigram mass
of the words not seen after h, so every distribution sums to one.

Texts are cut into batches of tokens, a row each, and that table stays where it is. Counts and weights live in tables
partitioned by key: each batch sends its distinct keys (64-bit hashes) with its own counts, packed by key partition; the
partition sums them and answers each batch in the order it asked. The answers are written as tables partitioned by batch,
which the batch's next task reads. Three such rounds: words, pairs, and histories (their discounted and unigram sums, sent by the
batch that owns a pair). A key costs a batch one entry however often it occurs, so frequent words are no hot spot, and a
partition's size is bounded by the number of partitions, chosen by the number of entries.
"""

from __future__ import annotations

import ctypes
import posixpath
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import delete, drop_written, new_path, ship, written
from .text import U64, crc, mix, pair, slices, words

K = 5  # counts above it are not discounted
BATCH = 3 << 20  # bytes of text in a batch
CHUNK = 1 << 17  # tokens at a time in steps that need temporaries
ENTRIES = 2_000_000  # in a key partition
END, BEGIN = U64(0x51ED270B7F3C1A45), U64(0x1B873593CC9E2D51)


def pack(counts: np.ndarray) -> tuple[bytes, bytes]:
    """Counts as bytes, those from 255 on in full behind."""
    big = counts >= 255
    return np.where(big, 255, counts).astype(np.uint8).tobytes(), counts[big].astype(np.int64).tobytes()


def unpack(small: bytes, large: bytes) -> np.ndarray:
    out = np.frombuffer(small, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(large, np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys as the first one and differences of as few bytes as the largest needs; best if they ascend."""
    step = np.diff(keys)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + keys[:1].tobytes() + np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    step = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(step) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(raw, np.uint8, 8, 1)
    wide[1:, :width] = step
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def discounts(n: list[int]) -> np.ndarray:
    """d(0), ..., d(K) from the numbers of types that occur 1, ..., K + 1 times; d is 1 above K.

    Good-Turing as Katz has it; where these counts don't give values in (0, 1], absolute discounting by n1 / (n1 + 2 n2).
    """
    d = np.ones(K + 1)
    if not any(n[:K]):
        return d
    n1, a = n[0], (K + 1) * n[K] / n[0] if n[0] else 1.0
    if n1 and a < 1 and all(n[:K]):
        r = np.arange(1, K + 1)
        good = ((r + 1) * np.array(n[1 : K + 1]) / (r * np.array(n[:K])) - a) / (1 - a)
        if (good > 0).all() and (good <= 1).all():
            d[1:] = good
            return d
    cut = n1 / (n1 + 2 * n[1]) if n1 and n[1] else 0.5
    d[1:] = (np.arange(1, K + 1) - cut) / np.arange(1, K + 1)
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * np.where(c > K, 1.0, d[np.minimum(c, K)])


class Unigram:
    """P(w) by count; the count 0 is the open class."""

    def __init__(self, n: list[int], tokens: int, types: int):
        self.d, self.tokens, self.types = discounts(n), tokens, types
        r = np.arange(1, K + 1)
        left = float(((1 - self.d[1:]) * r * np.array(n[:K])).sum())
        self.total = tokens if left > 0 else tokens + 1
        self.open = (left or 1.0) / self.total

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / self.total, self.open)


def weights(total: np.ndarray, kept: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each history's divisor and a(h), from its count, its pairs' discounted count and their words' unigram mass. A
    history without any discounted pair leaves 1 / (count + 1). A history never seen: 0 and 1."""
    none = kept > total - 1e-9
    divisor = np.where(total > 0, total + none, 0)
    left = 1 - np.where(none, total, kept) / np.maximum(divisor, 1)
    return divisor, np.where(total > 0, left / np.maximum(1 - seen, 1e-15), 1.0)


# ---- batches


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    names = ["batch", "doc_ids", "sizes", "tokens", "vocab", "train"]
    part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        nonlocal number
        ids = [i for b in held for i in b[0]]
        h, sizes = np.concatenate([b[1] for b in held]), np.concatenate([b[2] for b in held])
        vocab, tokens = np.unique(h, return_inverse=True)
        train = np.repeat(crc(ids) % 7 != 2, sizes)
        counts = np.bincount(tokens[train], minlength=len(vocab))
        number += 1
        data = [[part << 32 | number - 1], [ids], *([x.astype(t).tobytes()] for x, t in ((sizes, np.int32), (tokens, np.int32), (vocab, np.uint64), (counts, np.int32)))]
        types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types)], names)

    for whole in batches:
        for b in slices(whole, "text"):
            h, first = words(b.column(1))
            n = b.num_rows
            out = np.full(len(h) + n, END)
            last = first[1:] + np.arange(n)  # each document's end
            keep = np.ones(len(out), bool)
            keep[last] = False
            out[keep] = h
            held.append((b.column(0).to_pylist(), out, np.diff(first) + 1))
            size += b.column(1).nbytes
            if size >= BATCH:
                yield row()
                held, size = [], 0
    if held:
        yield row()


class Batch:
    """A batch's row: hashes of its words and the begin mark, each token and the one before it, and its distinct pairs."""

    def __init__(self, b: pa.RecordBatch, i: int):
        get = lambda k, t: np.frombuffer(b.column(k)[i].as_buffer(), t)
        self.id, self.docs = b.column(0)[i].as_py(), b.column(1)[i].as_py()
        self.sizes, self.tokens = get(2, np.int32).astype(np.int64), get(3, np.int32)
        self.words, self.train = np.append(get(4, np.uint64), BEGIN), get(5, np.int32)

    def before(self) -> np.ndarray:
        """For each token the word before it in its text."""
        out = np.empty_like(self.tokens)
        out[1:] = self.tokens[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = len(self.words) - 1
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs' keys, an occurrence of each, and each token's pair."""
        before, n = self.before(), len(self.tokens)
        keys = np.empty(n, np.uint64)
        for i in range(0, n, CHUNK):
            keys[i : i + CHUNK] = pair(self.words[before[i : i + CHUNK]], self.words[self.tokens[i : i + CHUNK]])
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        which = np.empty(n, np.int32)
        which[order] = np.cumsum(new, dtype=np.int32) - 1
        return keys[new], order[new], which


def _trim() -> None:
    """Gives freed memory back between batches."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


# ---- a round: requests by key partition, answers by batch


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by partition, and each partition's first (length parts + 1). Top bits: sorted keys stay in order."""
    p = ((keys >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
    order = np.argsort(p, kind="stable")
    return order, np.searchsorted(p[order], np.arange(parts + 1))


def _requests(make: Callable, parts: int):
    """make(batch): keys and a dict of arrays as long as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = Batch(b, i)
                keys, values = make(one)
                order, first = _parts(keys, parts)
                used = np.flatnonzero(np.diff(first))
                cols = [pa.array(used, pa.int32()), pa.array(np.full(len(used), one.id))]
                x = keys[order]
                cols.append(pa.array([pack_keys(x[first[p] : first[p + 1]]) for p in used], pa.binary()))
                for x in values:
                    x = x[order]
                    cols.append(pa.array([x[first[p] : first[p + 1]].tobytes() for p in used], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["part", "batch", "keys", *[f"v{k}" for k in range(len(values))]])
                del one, keys, values, order, cols
                _trim()

    return run


def _answer(types: list, reply: Callable):
    """reply(which, first, *summed): for each request entry's key number and whether it is the key's first; gives arrays by
    entry as columns of bytes, and statistics."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch").combine_chunks()
        ids, part = t.column("batch").to_numpy(), t.column("part")[0].as_py()
        blobs = [unpack_keys(x.as_py()) for x in t.column("keys")]
        size = [len(x) for x in blobs]
        keys, index, which = np.unique(np.concatenate(blobs), return_index=True, return_inverse=True)
        del blobs
        sums = [np.bincount(which, np.frombuffer(b"".join(t.column(f"v{k}").to_pylist()), x).astype(np.float64), len(keys)) for k, x in enumerate(types)]
        first = np.zeros(len(which), bool)
        first[index] = True
        columns, stats = reply(which, first, *sums)
        ends = np.cumsum([0, *size])
        a, b, c = [], [], []
        for i, j in zip(ends[:-1], ends[1:]):
            x, y = pack(columns[0][i:j])
            more = columns[1][i:j]
            a.append(x), b.append(y), c.append((np.packbits(more) if more.dtype == bool else more).tobytes())
        rows = [pa.array([*ids, -1], pa.int64()), pa.array([part] * (len(ids) + 1), pa.int32()), pa.array([*a, b""], pa.binary()), pa.array([*b, b""], pa.binary()), pa.array([*c, b""], pa.binary()), pa.array([*[None] * len(ids), stats], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(rows, ["batch", "part", "small", "large", "more", "stats"])

    return run


_ANSWER = "batch long, part int, small binary, large binary, more binary, stats array<long>"


def _count_words(which, first, counts):
    c = np.rint(counts).astype(np.int64)
    return (c[which], np.zeros(0, np.int8)), [*[int((c == r).sum()) for r in range(1, K + 2)], int(c.sum()), int((c > 0).sum())]


def _count_pairs(which, first, counts):
    c = np.rint(counts).astype(np.int64)
    return (c[which], first & (c[which] > 0)), [int((c == r).sum()) for r in range(1, K + 2)] + [0, 0]


def _sum_histories(which, first, total, kept, seen):
    divisor, alpha = weights(np.rint(total), kept, seen)
    return (divisor.astype(np.int64)[which], alpha[which]), [0] * (K + 3)


def _round(batches: DataFrame, make: Callable, types: list, reply: Callable, parts: int, name: str, spark: SparkSession) -> tuple[str, list[int]]:
    """Gives the answers' table, partitioned by batch, and the summed statistics."""
    fields = "".join(f", v{k} binary" for k in range(len(types)))
    asked = batches.mapInArrow(_requests(make, parts), f"part int, batch long, keys binary{fields}")
    answers = asked.groupBy("part").applyInArrow(_answer(types, reply), _ANSWER)
    path = new_path(spark, name)
    # the statistics' rows share the batch number -1; part spreads them
    answers.repartition("batch", F.when(F.col("batch") < 0, F.col("part"))).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    stats = [0] * (K + 3)
    if parts and batches.limit(1).count():
        table = spark.read.parquet(f"{path}/batch=-1").select("stats")
        stats = list(table.agg(*[F.sum(F.col("stats")[k]).alias(f"s{k}") for k in range(K + 3)]).first())
    return path, stats


class Answers:
    """Reads what a batch was answered."""

    def __init__(self, path: str, parts: int):
        self.parts = parts
        self.fs, self.base = fs.FileSystem.from_uri(path)

    def __call__(self, batch: int, keys: np.ndarray, kind) -> tuple[np.ndarray, np.ndarray]:
        counts, more = np.zeros(len(keys), np.int64), np.zeros(len(keys), kind)
        order, first = _parts(keys, self.parts)
        folder = posixpath.join(self.base, f"batch={batch}")
        for info in self.fs.get_file_info(fs.FileSelector(folder)):
            if info.type != fs.FileType.File or posixpath.basename(info.path)[0] in "._":
                continue
            with self.fs.open_input_file(info.path) as f:
                t = pq.ParquetFile(f).read(["part", "small", "large", "more"])
            for j in range(t.num_rows):
                p, a, b, c = (t.column(k)[j].as_py() for k in range(4))
                at = order[first[p] : first[p + 1]]
                counts[at] = unpack(a, b)
                if kind is bool:
                    more[at] = np.unpackbits(np.frombuffer(c, np.uint8), count=len(at)).astype(bool)
                elif c:
                    more[at] = np.frombuffer(c, kind)
        return counts, more


def _ask_words(one: Batch):
    return one.words[:-1], (one.train,)


def _ask_pairs(one: Batch):
    keys, _, which = one.pairs()
    train = np.repeat(crc(one.docs) % 7 != 2, one.sizes)
    return keys, (np.bincount(which[train], minlength=len(keys)).astype(np.int32),)


def _ask_histories(words_at: str, pairs_at: str, parts: tuple, unigram: Unigram, d: np.ndarray):
    def make(one: Batch):
        keys, at, _ = one.pairs()
        n, own = Answers(pairs_at, parts[1])(one.id, keys, bool)
        n, at = n[own], at[own]
        before, word, size = one.before()[at], one.tokens[at], len(one.words)
        c, _ = Answers(words_at, parts[0])(one.id, one.words[:-1], np.int8)
        return one.words, tuple(np.bincount(before, x, size) for x in (n, discounted(n, d), unigram(c)[word]))

    return make


def _scores(words_at: str, pairs_at: str, histories_at: str, parts: tuple, unigram: Unigram, d: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = Batch(b, i)
                keys, _, which = one.pairs()
                n, _ = Answers(pairs_at, parts[1])(one.id, keys, bool)
                del keys
                top = discounted(n, d)
                seen, top = n > 0, np.log10(np.maximum(top, 1e-300))
                divisor, alpha = Answers(histories_at, parts[2])(one.id, one.words, np.float64)
                divisor, alpha = np.log10(np.maximum(divisor, 1)), np.log10(np.maximum(alpha, 1e-300))
                c, _ = Answers(words_at, parts[0])(one.id, one.words[:-1], np.int8)
                base_of, low_of = np.log10((c + 1) / (unigram.tokens + unigram.types + 1)), np.log10(unigram(c))
                before, score = one.before(), np.empty(len(which))
                for j in range(0, len(which), CHUNK):
                    p, h, w = which[j : j + CHUNK], before[j : j + CHUNK], one.tokens[j : j + CHUNK]
                    score[j : j + CHUNK] = np.where(seen[p], top[p] - divisor[h], alpha[h] + low_of[w])
                del which, before
                first = np.cumsum(one.sizes) - one.sizes
                known = np.add.reduceat((c > 0)[one.tokens], first, dtype=np.int64)
                held = crc(one.docs) % 7 == 2
                cols = [pa.array(one.docs, pa.int64()), pa.array(held), pa.array(one.sizes), pa.array(known), pa.array(np.full(len(first), unigram.tokens, np.int64))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.add.reduceat(base_of[one.tokens], first)), pa.array(np.add.reduceat(score, first))], names)
                del one, score, cols
                _trim()

    return run


def language_model_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Learns from rows whose crc32(doc_id as text) mod 7 is not 2; a null doc_id counts as the empty text (and trains). A null
    or empty text is its end token alone. Repeated rows each count and each give a row. Without training rows every
    probability is one. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    path = new_path(spark, "batches")
    docs.mapInArrow(_batches, "batch long, doc_ids array<long>, sizes binary, tokens binary, vocab binary, train binary").write.option("maxRecordsPerFile", 4).option("compression", "zstd").parquet(path)
    batches = spark.read.parquet(path)
    size = batches.agg(F.coalesce(F.sum(F.octet_length("vocab")), F.lit(0)) / 8, F.coalesce(F.sum(F.octet_length("tokens")), F.lit(0)) / 4).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = tuple(max(least, -(-int(n) // ENTRIES)) for n in (size[0], size[1], size[0]))
    free = spark.sparkContext._jvm.System.gc  # lets Spark's cleaner remove the shuffles of finished rounds

    words_at, s = _round(batches, _ask_words, [np.int32], _count_words, parts[0], "words", spark)
    unigram = Unigram(s[: K + 1], s[K + 1], s[K + 2])
    pairs_at, s = _round(batches, _ask_pairs, [np.int32], _count_pairs, parts[1], "pairs", spark)
    free()
    d = discounts(s[: K + 1])
    ask = _ask_histories(words_at, pairs_at, parts, unigram, d)
    histories_at, _ = _round(batches, ask, [np.float64] * 3, _sum_histories, parts[2], "histories", spark)
    free()
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = written(batches.mapInArrow(_scores(words_at, pairs_at, histories_at, parts, unigram, d), out), "scores", spark)
    for x in (words_at, pairs_at, histories_at):
        delete(spark, x)
    drop_written(batches, spark)
    return scores
