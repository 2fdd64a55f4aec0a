"""Sources and sinks: papers, references, tagged corpora, word lists, caches."""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical as X

BITS = {"male": 1, "female": 2, "last": 4, "month": 8, "place": 16, "publisher": 32}


def papers(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (a hash of the path), path, text: a whole file a row."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "text")


def references(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, cite_no, raw: one reference a line. cite_no is unique and ascends within a file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("cite_no"), F.col("value").alias("raw"))
    return rows.filter(~X.is_blank(F.col("raw"))).select(F.xxhash64("path").alias("doc_id"), "cite_no", "raw")


def utf16(spark: SparkSession, path: str) -> DataFrame:
    """path, text of UTF-16 files."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-16").alias("text"))


def tagged_tokens(lines: DataFrame) -> DataFrame:
    """lines (seq_no, line) of <tag> tokens </tag> to seq_no, tok_no, tok, gold. Comments are skipped; a tag that isn't closed
    by its own name is an error."""
    ok = lines.filter(~F.startswith("line", F.lit("#")) & ~X.is_blank(F.col("line")))
    spans = F.regexp_extract_all("line", F.lit(r"<([A-Za-z]+)>[^<]*</[A-Za-z]+>"), 0)
    bad = F.exists(spans, lambda s: F.regexp_extract(s, "^<([A-Za-z]+)>", 1) != F.regexp_extract(s, "</([A-Za-z]+)>$", 1)) | (F.trim(F.regexp_replace("line", r"<([A-Za-z]+)>[^<]*</[A-Za-z]+>", "")) != "")
    rows = ok.select("seq_no", F.when(bad, F.raise_error(F.concat(F.lit("tags don't match: "), F.col("line"))).cast("array<string>")).otherwise(spans).alias("s"))
    toks = F.flatten(F.transform("s", lambda s: F.transform(X.tokens(F.regexp_replace(s, "^<[A-Za-z]+>|</[A-Za-z]+>$", "")), lambda t: F.struct(t.alias("tok"), F.regexp_extract(s, "^<([A-Za-z]+)>", 1).alias("gold")))))
    return rows.select("seq_no", F.posexplode(toks).alias("tok_no", "x")).select("seq_no", "tok_no", "x.tok", "x.gold")


def tagged_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) of <tag> line +L+ line +L+ </tag> to doc_id, line_no, gold, line."""
    spans = F.regexp_extract_all("text", F.lit(r"<([A-Za-z]+)>[^<]*</[A-Za-z]+>"), 0)
    rows = F.flatten(F.transform(spans, lambda s: F.transform(F.filter(F.transform(F.split(F.regexp_replace(s, "^<[A-Za-z]+>|</[A-Za-z]+>$", ""), r"\+L\+", -1), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(s, "^<([A-Za-z]+)>", 1).alias("gold"), x.alias("line")))))
    return docs.select("doc_id", F.posexplode(rows).alias("line_no", "x")).select("doc_id", "line_no", "x.gold", "x.line")


def word_list(lines: list[str]) -> list[tuple[str, int]]:
    """Words with bits of a sectioned list: lines that begin with ## name the section, # is a comment; what follows a tab
    is dropped."""
    out, bit = [], 0
    for x in lines:
        if x.startswith("##"):
            bit = next((b for k, b in BITS.items() if k in x.lower()), 0)
        elif x.strip() and not x.startswith("#") and bit:
            out.append((x.split("\t")[0].strip().lower(), bit))
    return out


def keyword_lists(lines: list[str]) -> list[tuple[str, str]]:
    """(tag, word) of lines such as tag: word word."""
    return [(t.strip(), w) for x in lines if ":" in x for t, _, ws in [x.partition(":")] for w in ws.split()]


@dataclass
class FeatureConfig:
    """Which groups of line features are made."""

    token: bool = True
    line_number: bool = True
    line_punct: bool = True
    line_capital: bool = True
    line_place: bool = True
    line_length: bool = True
    ngrams: bool = True
    layout: bool = False

    @classmethod
    def read(cls, lines: list[str]) -> FeatureConfig:
        """From name=0|1 lines. Unknown names are an error."""
        known = {f.name for f in fields(cls)}
        pairs = [x.split("=", 1) for x in (y.split("#")[0].strip() for y in lines) if "=" in x]
        if bad := [k for k, _ in pairs if k.strip() not in known]:
            raise ValueError(f"unknown features: {', '.join(bad)}")
        return cls(**{k.strip(): v.strip() == "1" for k, v in pairs})


def resolve(path: str, repository: str, mounts: dict[str, str]) -> str:
    """A path in a named repository. LOCAL is the path itself; unknown repositories and paths that leave theirs are errors."""
    if repository == "LOCAL":
        return path
    if repository not in mounts:
        raise ValueError(f"unknown repository {repository}")
    if re.search(r"(^|/)\.\.(/|$)", path) or not path.strip("/"):
        raise ValueError(f"not a path within {repository}: {path}")
    return mounts[repository].rstrip("/") + "/" + path.lstrip("/")


def cache_key(url: Column) -> tuple[Column, Column]:
    """(id, fan) of a download cache: SHA-1 and its first two characters, to partition by."""
    key = F.sha1(url)
    return key, F.substring(key, 1, 2)


def write_cache(df: DataFrame, path: str, url: str = "url") -> None:
    key, fan = cache_key(F.col(url))
    df.withColumn("id", key).withColumn("fan", fan).write.mode("append").partitionBy("fan").parquet(path)


def cached(spark: SparkSession, path: str, url: str) -> DataFrame:
    """Rows of one URL: only its directory is read."""
    key, fan = cache_key(F.lit(url))
    k = spark.range(1).select(key.alias("k"), fan.alias("f")).first()
    return spark.read.parquet(path).filter((F.col("fan") == k.f) & (F.col("id") == k.k))
