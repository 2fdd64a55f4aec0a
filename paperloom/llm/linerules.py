"""Quality rules with cross-document line frequency, in DataFrame operations only.

One pass reads the texts and keeps per row the rule metrics and, per line with words, a 64-bit hash of the normalised line
(words joined by one space, lower case) and its word characters. From that table alone: distinct texts per host and line (exact
copies of a text count once, each text's lines count once); the lines above the host's limit; and for each distinct text
those it has. A second pass takes them out of these texts. A row that loses most of its characters is depleted.

A frequent line's counts are combined before the shuffle. The table of frequent lines is written, so the planner knows
its size and broadcasts it only if it is small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]"
WINDOW = 8
MIN_WORDS, MAX_REPEAT = 20, 30  # words; percent of words in repeated windows
MIN_DOCS, SHARE = 6, 0.0  # a line is frequent in more distinct texts of a host than both allow; the same for a host of any size
DEPLETED = 0.5  # of the word characters


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once; a plain reference inside a lambda may be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words within 8-word windows that occur twice or more."""

    def covered(hashes: Column) -> Column:
        # equal windows become neighbours; positions of windows with an equal neighbour, in order
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))).alias("d"))), lambda x: x["d"]), lambda x: x["i"]))
        steps = let(F.sort_array(twice), lambda p: F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(hashed: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashed, i, WINDOW)))

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(hashes))

    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count))


def metrics(text: Column) -> Column:
    """A struct of the rule metrics and the lines (h, c) of a text; null is empty."""

    def lines(parts: Column) -> Column:
        return F.transform(F.filter(F.transform(parts, lambda p: words_of(p)), lambda w: F.size(w) > 0), lambda w: F.struct(_line_key(w).alias("h"), F.length(F.array_join(w, "")).alias("c")))

    def with_words(w: Column, t: Column) -> Column:
        joined = F.array_join(w, "")
        full = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(joined).cast("long").alias("word_chars"),
            let(joined, lambda j: F.length(j) - F.length(F.translate(j, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
            let(F.split(t, "\n", -1), lines).alias("lines"),
        )

    return let(F.coalesce(text, F.lit("")), lambda t: let(words_of(t), lambda w: with_words(w, t)))


def line_quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float = DEPLETED) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, kept for every row
    of docs (doc_id, text, and the host column).

    The frequent lines are taken out of the texts, as cleaned does; removed_chars are the word characters that a text loses
    thereby. A null or empty text has no words and fails. A null host is a host of its own. Rows without doc_id and repeated rows
    are judged like any other. A line at exactly the limit stays. An empty table gives an empty result; other columns are
    ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id"), _host(docs[host]), F.xxhash64(text).alias("text_key"), metrics(text).alias("m"))
    rows = written(rows.select("doc_id", "host", "text_key", "m.*"), "lines", spark)
    frequent = _frequent(rows, min_docs, share, spark)
    gone = _gone(rows, frequent)
    texts = docs.select(_host(docs[host]), F.xxhash64(text).alias("text_key"), text.alias("text")).filter(F.col("text").isNotNull())
    cut = texts.join(gone, ["host", "text_key"]).select("host", "text_key", _word_chars(_cut(F.col("text"), F.col("gone"))).alias("left_chars"))
    left = written(cut.groupBy("host", "text_key").agg(F.first("left_chars").alias("left_chars")), "cut", spark)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    removed = F.col("word_chars") - F.coalesce("left_chars", "word_chars")
    out = rows.drop("lines").join(left, ["host", "text_key"], "left").withColumn("removed_chars", removed).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_chars", (~F.col("base_failed") & (F.col("removed_chars") <= depleted * F.col("word_chars"))).alias("kept"))


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), host.cast("string")), F.lit("")).alias("host")


def _line_key(words: Column) -> Column:
    return F.xxhash64(F.lower(F.array_join(words, " ")))


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, "")).cast("long")


def _cut(text: Column, gone: Column) -> Column:
    """text without the lines whose keys are in gone; the others, blank ones too, in order."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda p: ~p.rlike(WORD) | ~F.array_contains(gone, _line_key(words_of(p)))), "\n")


def _gone(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, text_key, gone): the keys of a text's frequent lines, for each distinct text that has any."""
    each = rows.select("host", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    return each.join(frequent, ["host", "h"]).groupBy("host", "text_key").agg(F.collect_set("h").alias("gone"))


def _frequent(rows: DataFrame, min_docs: int, share: float, spark) -> DataFrame:
    """(host, h) of the lines above their host's limit, from rows (host, text_key, lines)."""
    texts = rows.groupBy("host", "text_key").agg(F.first(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("hashes"))
    texts = written(texts, "texts", spark)
    limits = texts.groupBy("host").agg(F.greatest(F.lit(min_docs), F.ceil(F.count("*") * share)).alias("limit"))
    counts = texts.select("host", F.explode("hashes").alias("h")).groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    return written(counts.join(limits, "host").filter("n > limit").select("host", "h"), "frequent", spark)


def cleaned(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, depleted: float | None = DEPLETED) -> DataFrame:
    """docs with every line above its host's limit taken out of the text; the other lines, blank ones too, stay in order.
    All columns stay. Rows of which more than the share depleted of the word characters is gone are left out; None keeps them.

    Limits as in line_quality. A null text stays null. Lines are parted by \\n. A text without frequent lines stays as it is.
    """
    spark = docs.sparkSession
    text = docs["text"].cast("string")
    keys = let(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda parts: F.transform(F.filter(parts, lambda p: p.rlike(WORD)), lambda p: F.struct(_line_key(words_of(p)).alias("h"))))
    rows = written(docs.select(_host(docs[host]), F.xxhash64(text).alias("text_key"), keys.alias("lines")), "lines", spark)
    gone = _gone(rows, _frequent(rows, min_docs, share, spark))
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), _host(docs[host]), F.xxhash64(text).alias("text_key")).join(written(gone, "gone", spark), ["host", "text_key"], "left")
    old = F.col("doc.text")
    out = out.withColumn("new", F.when(F.col("gone").isNull(), old).otherwise(_cut(old.cast("string"), F.col("gone"))))
    if depleted is not None:
        total = _word_chars(old.cast("string"))
        out = out.filter(F.col("gone").isNull() | (total - _word_chars(F.col("new")) <= depleted * total))
    return out.select(*[F.col("new").alias("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def rule_counts(judged: DataFrame) -> DataFrame:
    """rule, rows: how many rows of line_quality's result each rule decides. short and repeated are the base rules, the first
    that fails; depleted rows fail by shared lines alone; kept rows stay, cut ones with frequent lines in them."""
    rule = F.when(F.col("n_words") < MIN_WORDS, "short").when(F.col("base_failed"), "repeated").when(~F.col("kept"), "depleted").when(F.col("removed_chars") > 0, "cut").otherwise("kept")
    return judged.groupBy(rule.alias("rule")).agg(F.count("*").alias("rows"))


def oracle(min_docs: int, share: float, depleted: float) -> str:
    """DuckDB SQL for line_quality over documents. Lines and windows are compared as text, not by hash."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
ln AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
nl AS (SELECT r, host, t, line, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS norm, length(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), '')) AS c FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, CAST(count(*) - count(DISTINCT line) AS BIGINT) AS n FROM nl GROUP BY r),
lim AS (SELECT host, greatest({min_docs}, ceil(count(DISTINCT t) * {share})) AS l FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM nl GROUP BY host, norm) JOIN lim USING (host) WHERE n > l),
gone AS (SELECT r, CAST(sum(c) AS BIGINT) AS n FROM nl JOIN freq USING (host, norm) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS removed_chars
 FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_chars, NOT base_failed AND removed_chars <= {depleted} * word_chars AS kept FROM b
"""


ORACLE = oracle(MIN_DOCS, SHARE, DEPLETED)
