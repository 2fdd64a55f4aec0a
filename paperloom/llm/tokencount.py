"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

A text's count is the sum over its white-space-delimited pre-tokens, as the tokenizer never joins across white space.
Tier one is a hash table of the lengths of frequent pre-tokens, broadcast; it is built from a bounded sample and has at
most TABLE entries, and it decides speed only, never a result. Tier two is each Python worker's cache of the rest, of
bounded size, filled by the library itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import sampled, ship
from .text import column, slices

TABLE = 1 << 16
CACHE = 1 << 19  # entries a generation; two are kept
LONGEST = 64  # bytes of a pre-token that is worth keeping
SAMPLE, SAMPLE_CHARS = 3000, 20_000
_made: dict = {}


class Counts:
    """A worker's tokenizer and its cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}

    def encode(self, words: list[bytes]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]

    def learn(self, words: set[bytes]) -> dict[bytes, int]:
        """Lengths of words, from the cache or the library."""
        out, young, old = {}, self.young, self.old
        new = []
        for w in words:
            n = young.get(w)
            if n is None:
                n = old.get(w)
                if n is None:
                    new.append(w)
                    continue
                young[w] = n
            out[w] = n
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            for w, n in zip(part, self.encode(part)):
                out[w] = n
                if len(w) <= LONGEST:
                    young[w] = n
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return out


def counter(path: str) -> Counts:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _made:
        _made[path] = Counts(path)
    return _made[path]


def pre_tokens(text: bytes) -> list[bytes]:
    """White-space-delimited pieces. ASCII capitals don't count, unless something may be a special string."""
    return text.split() if b"<|" in text else text.lower().split()


def count_texts(texts: list[bytes], table: dict[bytes, int], cache: Counts) -> list[int]:
    split = [pre_tokens(t) for t in texts]
    got = [list(map(table.get, s)) for s in split]
    missed = [[w for w, n in zip(s, g) if n is None] if None in g else () for s, g in zip(split, got)]
    rest = cache.learn(set().union(*missed)).__getitem__
    return [sum(filter(None, g)) + sum(map(rest, m)) for g, m in zip(got, missed)]


def _count(path: str, limit: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, cache = table.value, counter(path)
        for whole in batches:
            for b in slices(whole, "text", 1 << 22):
                data, at = column(b.column(1))
                raw = data.tobytes()
                n = count_texts([raw[at[i] : at[i + 1]] for i in range(b.num_rows)], frequent, cache)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(x) for x in at[1:] - at[:-1]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs (doc_id, text).

    path: the tokenizer's file, the same on all workers. A null text is empty: no bytes, no tokens. Rows without doc_id
    keep their null; repeated rows each give a row; an empty table an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sampled(docs, "doc_id", SAMPLE, docs.count()).filter(F.length("text") <= SAMPLE_CHARS).select("text").collect()
    seen = Counter(w for r in sample for w in pre_tokens(r.text.encode()) if len(w) <= LONGEST)
    words = [w for w, _ in seen.most_common(TABLE)]
    table = spark.sparkContext.broadcast(dict(zip(words, Counts(path).encode(words))) if words else {})
    return docs.mapInArrow(_count(path, limit, table), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
