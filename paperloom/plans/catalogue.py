"""Queries over whole tables that apply the operators, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical as X
from ..functions import normalize as N
from ..operators import contexts as C
from ..operators import documents as D
from ..operators import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: SQL of tokens and lines, for the oracles
TOK = r"tok AS (SELECT doc_id, len(t) AS n, unnest(range(len(t))) AS tok_no, unnest(t) AS tok FROM (SELECT doc_id, regexp_extract_all(text, '[^\x09-\x0D\x20]+') AS t FROM documents))"
LIN = r"lin AS (SELECT doc_id, line_no, line, regexp_extract_all(line, '[^\x09-\x0D\x20]+') AS toks FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '\r+$', '') AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE regexp_matches(line, '[^\x09-\x0D\x20]'))"
BARE = r"regexp_replace(tok, '[^\p{L}\p{M}\p{N}\p{Pc}]', '', 'g')"
#: lineitem has no key; rows that tie on all of these are alike
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
STOP = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on"]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokens(spark, sf_dir):
    return D.tokens_of(table(spark, sf_dir, "documents"))


def _lines(spark, sf_dir):
    return D.lines_of(table(spark, sf_dir, "documents")).withColumn("toks", X.tokens(F.col("text")))


def _histogram(rows, column, name):
    return rows.groupBy(column.alias(name)).agg(F.count("*").alias("n"))


def _token_histogram(spark, sf_dir, feature, name):
    """Counts of a token feature. Equal tokens are counted first, before the shuffle too, so the feature is computed once a
    distinct token."""
    counts = _tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("n"))
    return counts.groupBy(feature(F.col("tok")).alias(name)).agg(F.sum("n").alias("n"))


# ---- lines and tokens


@query(f"WITH {LIN}, b AS (SELECT doc_id, len(string_split(text, chr(10))) AS a FROM documents), c AS (SELECT doc_id, count(*) AS n FROM lin GROUP BY doc_id) SELECT b.doc_id, coalesce(n, 0) AS n_lines, CAST(a - coalesce(n, 0) AS BIGINT) AS n_blank FROM b LEFT JOIN c USING (doc_id)")
def line_explode_counts(spark, sf_dir):
    return D.line_counts(table(spark, sf_dir, "documents"))


@query(rf"WITH {TOK}, w AS (SELECT {BARE} AS w FROM tok) SELECT CASE WHEN regexp_matches(w, '^\p{{Lu}}$') THEN 'singleCap' WHEN regexp_matches(w, '^\p{{Lu}}\p{{Ll}}') THEN 'InitCap' WHEN w = '' OR regexp_matches(w, '^\p{{Lu}}+$') THEN 'AllCap' ELSE 'others' END AS case_class, count(*) AS n FROM w GROUP BY 1")
def token_case_histogram(spark, sf_dir):
    return _token_histogram(spark, sf_dir, X.case_class, "case_class")


@query(rf"WITH {TOK}, w AS (SELECT tok, {BARE} AS w FROM tok) SELECT CASE WHEN regexp_matches(w, '^(19|20)\d\d$') THEN 'year' WHEN regexp_matches(tok, '[0-9]-[0-9]') THEN 'possiblePage' WHEN regexp_matches(tok, '\d\(\d+\)') THEN 'possibleVol' WHEN regexp_matches(w, '^[0-9]$') THEN '1dig' WHEN regexp_matches(w, '^[0-9][0-9]$') THEN '2dig' WHEN regexp_matches(w, '^[0-9][0-9][0-9]$') THEN '3dig' WHEN regexp_matches(w, '^[0-9]+$') THEN '4+dig' WHEN regexp_matches(w, '^\d+(nd|rd|st|th)$') THEN 'ordinal' WHEN regexp_matches(w, '[0-9]') THEN 'hasDig' ELSE 'nonNum' END AS number_class, count(*) AS n FROM w GROUP BY 1")
def token_number_class(spark, sf_dir):
    return _token_histogram(spark, sf_dir, X.number_class, "number_class")


@query(rf"""WITH {TOK} SELECT CASE WHEN regexp_matches(tok, '^["''`]') THEN 'leadQuote' WHEN regexp_matches(tok, '["''`][^s]?$') THEN 'endQuote' WHEN regexp_matches(tok, '-.*-') THEN 'multiHyphen' WHEN regexp_matches(tok, '[,:;-]$') THEN 'contPunct' WHEN regexp_matches(tok, '[!?.]$') THEN 'stopPunct' WHEN regexp_matches(tok, '^[(\[{{<].+[)\]}}>].?$') THEN 'braces' WHEN regexp_matches(tok, '^\d{{2,5}}\(\d{{2,5}}\).?$') THEN 'possibleVol' ELSE 'others' END AS punct_class, count(*) AS n FROM tok GROUP BY 1""")
def token_punct_class(spark, sf_dir):
    return _token_histogram(spark, sf_dir, X.punct_class, "punct_class")


@query(rf"WITH {TOK} SELECT CASE WHEN regexp_matches(right(tok, 1), '\p{{Ll}}') THEN 'a' WHEN regexp_matches(right(tok, 1), '\p{{Lu}}') THEN 'A' WHEN regexp_matches(right(tok, 1), '[0-9]') THEN '0' ELSE right(tok, 1) END AS last_char, count(*) AS n FROM tok GROUP BY 1")
def token_last_char_class(spark, sf_dir):
    return _token_histogram(spark, sf_dir, X.last_char_class, "last_char")


@query(f"WITH {TOK}, a AS (SELECT 'p' || k AS side, left(tok, k) AS affix FROM tok, unnest([1, 2, 3, 4]) AS u(k) UNION ALL SELECT 's' || k, right(tok, k) FROM tok, unnest([1, 2, 3, 4]) AS u(k)), c AS (SELECT side, affix, count(*) AS n FROM a GROUP BY 1, 2) SELECT side, affix, n, row_number() OVER (PARTITION BY side ORDER BY n DESC, affix) AS rank FROM c QUALIFY rank <= 20")
def token_affixes_top(spark, sf_dir):
    t = F.col("tok")
    parts = [F.struct(F.lit(f"{s}{k}").alias("side"), f(t, k).alias("affix")) for k in range(1, 5) for s, f in (("p", X.prefix), ("s", X.suffix))]
    words = _tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("c"))
    counts = words.select("c", F.explode(F.array(*parts)).alias("a")).groupBy("a.side", "a.affix").agg(F.sum("c").alias("n"))
    return T.top_words(counts, "side", "affix", "n", 20).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {TOK} SELECT CAST(floor(CAST(tok_no + 1 AS DOUBLE) / (n + 1) * 12) AS INTEGER) AS bin, count(*) AS n FROM tok GROUP BY 1")
def token_position_bins(spark, sf_dir):
    return _histogram(_tokens(spark, sf_dir), X.token_bin(F.col("tok_no") + 1, F.col("n")), "bin")


@query(f"WITH {LIN}, p AS (SELECT row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM lin) SELECT 'POS-' || CAST(i * 8 // n AS VARCHAR) AS bin, count(*) AS n FROM p GROUP BY 1")
def line_position_bins(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.filter(X.lines(F.col("text")), lambda x: ~X.is_blank(x)).alias("l"))
    rows = docs.select(F.size("l").alias("n"), F.posexplode("l").alias("i", "x"))
    return _histogram(rows, X.line_bin(F.col("i"), F.col("n")), "bin")


@query(rf"WITH {LIN} SELECT CASE WHEN regexp_matches(line, '@[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]+\.') THEN 'possibleEmail' WHEN regexp_matches(line, 'www|http') THEN 'possibleWeb' WHEN regexp_matches(line, '\([0-9][0-9]?\)[\x09-\x0D\x20]*$') THEN 'endNumbering' ELSE 'linePunctOthers' END AS line_punct, count(*) AS n FROM lin GROUP BY 1")
def line_punct_class(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.line_punct(F.col("text")), "line_punct")


@query(rf"WITH {LIN}, t AS (SELECT toks[1] AS t, len(toks) > 1 AS m FROM lin) SELECT CASE WHEN m AND regexp_matches(t, '^[1-9](\.[1-9])\.?$') THEN 'posSubsec' WHEN m AND regexp_matches(t, '^[1-9](\.[1-9]){{2}}\.?$') THEN 'posSubsubsec' WHEN m AND regexp_matches(t, '^[\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}](\.[1-9]){{2}}\.?$') THEN 'posCategory' WHEN regexp_matches(t, '^[1-9][A-Za-z][\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}]*$') THEN 'numFootnote' WHEN regexp_matches(t, '^[1-9](http|www)') THEN 'numWebfootnote' ELSE 'lineNumOthers' END AS line_number, count(*) AS n FROM t GROUP BY 1")
def line_section_number(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.section_number(F.col("toks")), "line_number")


@query(rf"WITH {LIN}, c AS (SELECT len(list_filter(toks, lambda t: regexp_matches(t, '^\p{{P}}*[A-Za-z]+\p{{P}}*$'))) AS k FROM lin) SELECT CASE WHEN k >= 5 THEN '5+Words' ELSE k || 'Words' END AS bucket, count(*) AS n FROM c GROUP BY 1")
def line_word_bucket(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.word_bucket(F.col("toks")), "bucket")


@query(rf"""WITH {LIN}, a AS (SELECT toks[1] AS f, list_filter(toks, lambda t: NOT regexp_matches(t, '^\p{{P}}*$')) AS w FROM lin), b AS (SELECT f, w, list_filter(w, lambda t: length(t) >= 4) AS g FROM a), c AS (SELECT f, w, g, list_filter(g, lambda t: regexp_matches(t, '^[A-Z][A-Za-z]*$')) AS c, regexp_matches(f, '[0-9]') AS d FROM b),
e AS (SELECT *, (CASE WHEN len(w) - len(g) - CASE WHEN d AND length(f) < 4 THEN 1 ELSE 0 END > 0 THEN 'Most' ELSE 'All' END) || (CASE WHEN len(list_filter(c, lambda t: regexp_matches(t, '[a-z]'))) > 0 THEN 'InitCaps' ELSE 'CharCaps' END) AS name FROM c)
SELECT CASE WHEN len(c) = 0 OR len(c) <> len(g) THEN 'OthersCaps' WHEN d THEN 'number' || name WHEN len(c) = 1 THEN 'OthersCaps' ELSE name END AS capital, count(*) AS n FROM e GROUP BY 1""")
def line_capital_pattern(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.capital_pattern(F.col("toks")), "capital")


@query(rf"WITH {LIN}, t AS (SELECT list_filter(list_transform(toks, lambda t: regexp_replace(regexp_replace(regexp_replace(t, '^\p{{P}}+', ''), '\p{{P}}+$', ''), '[0-9]', '0', 'g')), lambda t: t <> '') AS t FROM lin WHERE NOT contains(line, '@')), g AS (SELECT list_transform(range(1, len(t)), lambda i: t[i] || '-' || t[i + 1]) AS g FROM t WHERE len(t) >= 2), u AS (SELECT unnest(list_slice(list_filter(g, lambda x: NOT regexp_matches(x, '^[0-9]*$')), 1, 4)) AS gram FROM g), c AS (SELECT gram, count(*) AS n FROM u GROUP BY 1) SELECT gram, n FROM c ORDER BY n DESC, gram LIMIT 100")
def line_ngrams_top(spark, sf_dir):
    rows = _lines(spark, sf_dir).filter(~F.contains("text", F.lit("@"))).select(F.explode(X.ngrams(F.col("toks"), 2)).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gram").limit(100)


_KEYWORDS = r"k AS (SELECT lang, unnest(list_slice(list_filter(list_transform(regexp_extract_all(line, '[^\x09-\x0D\x20]+'), lambda t: lower(regexp_replace(t, '[^\p{L}\p{M}\p{N}\p{Pc}]', '', 'g'))), lambda t: t <> ''), 1, 2)) AS word FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)), c AS (SELECT lang, word, count(*) AS n FROM k GROUP BY 1, 2), top AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c QUALIFY rank <= 100)"


def _keywords(spark, sf_dir):
    """First two words of each line by language; the 100 most frequent."""
    words = lambda x: F.filter(F.transform(X.tokens(x), lambda t: F.lower(F.regexp_replace(t, f"[^{X.W}]", ""))), lambda t: t != "")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("lang", F.explode(F.flatten(F.transform(F.split("text", "\n", -1), lambda x: F.slice(words(x), 1, 2)))).alias("word"))
    counts = rows.groupBy("lang", "word").agg(F.count("*").alias("n"))
    return T.top_words(counts, "lang", "word", "n", 100).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_KEYWORDS} SELECT lang, word, n, rank FROM top")
def keywords_per_lang(spark, sf_dir):
    return _keywords(spark, sf_dir)


@query(f"WITH {_KEYWORDS} SELECT lang, word, n FROM top WHERE word IN (SELECT word FROM top GROUP BY word HAVING count(DISTINCT lang) = 1)")
def keywords_exclusive(spark, sf_dir):
    return T.exclusive(_keywords(spark, sf_dir), "lang", "word").select("lang", "word", "n")


@query(f"WITH {LIN} SELECT CASE WHEN k = 0 THEN 'No' WHEN k <= 5 THEN 'Few' ELSE 'Alot' END AS amount, count(*) AS n FROM (SELECT len(list_filter(toks, lambda t: lower(t) IN ({', '.join(repr(s) for s in STOP)}))) AS k FROM lin) GROUP BY 1")
def function_words(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.function_word_count(F.col("toks"), STOP), "amount")


@query(f"WITH {TOK} SELECT CASE WHEN r >= 0.7 THEN 'High' WHEN r >= 0.4 THEN 'Medium' ELSE 'Low' END AS ratio, count(*) AS n FROM (SELECT length(regexp_replace(tok, '[^0-9]', '', 'g')) / length(tok) AS r FROM tok) GROUP BY 1")
def token_digit_ratio(spark, sf_dir):
    return _token_histogram(spark, sf_dir, X.digit_ratio, "ratio")


@query(f"WITH {LIN}, p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM lin) SELECT CASE WHEN i = 0 OR n <= 1 THEN 0 ELSE CAST(ceil(i * 10 / (n - 1)) AS INTEGER) END AS decile, count(*) AS n FROM p GROUP BY 1")
def heading_deciles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.filter(X.lines(F.col("text")), lambda x: ~X.is_blank(x)).alias("l"))
    rows = docs.select(F.size("l").alias("n"), F.posexplode("l").alias("i", "x"))
    return _histogram(rows, X.heading_decile(F.col("i"), F.col("n")), "decile")


# ---- dictionaries


@query(rf"""WITH g AS (SELECT word, bit_or(mask) AS mask FROM (SELECT lower(n_name) AS word, 16 AS mask FROM nation UNION ALL SELECT lower(r_name), 16 FROM region UNION ALL SELECT unnest(string_split(lower(p_name), ' ')), 32 FROM part UNION ALL SELECT unnest(['the', 'of', 'on', 'and']), 4 UNION ALL SELECT unnest(['the', 'as']), 1) GROUP BY word), {TOK}, w AS (SELECT lower(CASE WHEN {BARE} = '' THEN 'EMPTY' ELSE {BARE} END) AS word FROM tok)
SELECT coalesce(mask, 0) AS mask, count(*) AS n FROM w LEFT JOIN g USING (word) GROUP BY 1""")
def gazetteer_bits(spark, sf_dir):
    words = lambda w: spark.createDataFrame([(x,) for x in w], "word string")
    parts = [
        table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"), F.lit(16).alias("mask")),
        table(spark, sf_dir, "region").select(F.lower("r_name").alias("word"), F.lit(16).alias("mask")),
        table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"), F.lit(32).alias("mask")),
        words(["the", "of", "on", "and"]).withColumn("mask", F.lit(4)),
        words(["the", "as"]).withColumn("mask", F.lit(1)),
    ]
    gaz = parts[0]
    for p in parts[1:]:
        gaz = gaz.unionByName(p)
    # counting words first keeps the join small: a row for each distinct word
    toks = _tokens(spark, sf_dir).groupBy("tok").agg(F.count("*").alias("c")).groupBy(X.bare_lower(F.col("tok")).alias("word")).agg(F.sum("c").alias("c"))
    return T.with_gazetteer(toks, T.gazetteer(gaz)).groupBy("mask").agg(F.sum("c").alias("n"))


# ---- runs, windows, groups

_EV = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT *, sum(CASE WHEN prev IS NOT NULL AND prev <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS run_no FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY i) AS prev FROM e))"


def _event_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    return T_runs(e)


def T_runs(e):
    return D.runs(e, "user_id", "at", "event_type")


@query(f"WITH {_EV} SELECT user_id, CAST(run_no AS BIGINT) AS run_no, any_value(event_type) AS label, count(*) AS n FROM f GROUP BY user_id, run_no")
def label_runs(spark, sf_dir):
    return _event_runs(spark, sf_dir).groupBy("user_id", "run_no").agg(F.first("event_type").alias("label"), F.count("*").alias("n"))


@query(f"WITH {_EV} SELECT user_id, CAST(run_no AS BIGINT) AS run_no, round(avg(value), 4) AS confidence FROM f GROUP BY user_id, run_no")
def label_run_confidence(spark, sf_dir):
    return _event_runs(spark, sf_dir).groupBy("user_id", "run_no").agg(F.round(F.avg("value"), 4).alias("confidence"))


@query("SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def first_per_tag(spark, sf_dir):
    return D.first_per_tag(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")


@query("SELECT conv_id, max(turn) AS turn FROM conversations WHERE contains(text, ' ') GROUP BY conv_id")
def last_match(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter(F.contains("text", F.lit(" "))).groupBy("conv_id").agg(F.max("turn").alias("turn"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_linestatus, lag(l_returnflag) OVER o AS a, lag(l_linestatus) OVER o AS b FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus)) SELECT l_orderkey, l_linenumber, CASE WHEN a = l_returnflag THEN 'continue' ELSE 'new' END AS l_returnflag_diff, CASE WHEN b = l_linestatus THEN 'continue' ELSE 'new' END AS l_linestatus_diff FROM w")
def lag_diff_features(spark, sf_dir):
    out = T.changes(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE, ["l_returnflag", "l_linestatus"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag_diff", "l_linestatus_diff")


@query("WITH w AS (SELECT *, (l_returnflag, l_linestatus) AS s, lag((l_returnflag, l_linestatus)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN p IS NOT NULL AND p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) AS BIGINT) AS section FROM w")
def section_breaks(spark, sf_dir):
    return T.section_breaks(table(spark, sf_dir, "lineitem"), "l_orderkey", LINE, ["l_returnflag", "l_linestatus"]).select("l_orderkey", "l_linenumber", "section")


@query("WITH a AS (SELECT *, l_quantity - lag(l_discount * 100) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) AS gap FROM lineitem), b AS (SELECT *, CASE WHEN gap > 5.0 * lag(gap) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) THEN 1 ELSE 0 END AS b FROM a) SELECT l_orderkey, l_linenumber, CAST(sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) AS BIGINT) AS sequence FROM b")
def gap_breaks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_discount") * 100)
    return T.gap_breaks(rows, "l_orderkey", LINE, "l_quantity", "r").select("l_orderkey", "l_linenumber", "sequence")


@query("WITH c AS (SELECT l_orderkey, l_quantity, CAST(sum(l_linenumber) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_quantity, w AS weight FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY w DESC, l_quantity DESC) = 1")
def mode_font_size(spark, sf_dir):
    return T.weighted_mode(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", F.col("l_linenumber"))


@query("SELECT l_orderkey, CASE WHEN avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) >= 0.667 THEN 'yes' ELSE 'no' END AS bold FROM lineitem GROUP BY 1")
def bold_share(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(F.avg((F.col("l_returnflag") == "N").cast("double")) >= 0.667, "yes").otherwise("no").alias("bold"))


@query("WITH m AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, min(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS lo, max(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, CAST((q - lo) * 8 // (hi - lo + 1) AS INTEGER) AS bin FROM m")
def vertical_bins(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return T.vertical_bins(rows, "l_orderkey", "q").select("l_orderkey", "l_linenumber", "bin")


@query("SELECT c_custkey, s_suppkey, round(d, 4) AS distance FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d, row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - s_acctbal), s_suppkey) AS r FROM customer JOIN supplier ON c_nationkey = s_nationkey) WHERE r = 1")
def cross_nearest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "nation")
    s = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "nation")
    return T.nearest(c, s, "nation", "c_acctbal", "s_acctbal", "s_suppkey", "c_custkey").select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"))


@query("SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels")
def fold_assignment(spark, sf_dir):
    return T.folds(table(spark, sf_dir, "labels"), "doc_id", 10).select("doc_id", "fold")


@query("WITH f AS (SELECT quality, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels) SELECT h AS held_out, count(*) AS train_rows, CAST(sum(quality) AS BIGINT) AS train_good FROM f, range(10) AS r(h) WHERE fold <> h GROUP BY h")
def fold_union(spark, sf_dir):
    f = T.folds(table(spark, sf_dir, "labels"), "doc_id", 10)
    rows = f.groupBy("fold").agg(F.count("*").alias("n"), F.sum("quality").alias("q"))  # ten rows
    held = spark.range(10).withColumnRenamed("id", "held_out")
    return held.join(rows, F.col("fold") != F.col("held_out")).groupBy("held_out").agg(F.sum("n").alias("train_rows"), F.sum("q").alias("train_good"))


_RULE = r"r AS (SELECT CASE quality WHEN 1 THEN 'good' ELSE 'bad' END AS gold, CASE WHEN 20 * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) > length(text) OR length(text) < 100 THEN 'bad' ELSE 'good' END AS guess FROM labels JOIN documents USING (doc_id))"


def _rule(spark, sf_dir):
    symbols = F.length(F.regexp_replace("text", "[^#*$%&|<>]", ""))
    guess = F.when((20 * symbols > F.length("text")) | (F.length("text") < 100), "bad").otherwise("good")
    d = table(spark, sf_dir, "documents").select("doc_id", guess.alias("guess"))
    return table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold")).join(d, "doc_id")


@query(f"WITH {_RULE} SELECT gold, guess, count(*) AS n FROM r GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return T.confusion(_rule(spark, sf_dir), "gold", "guess")


@query(f"WITH {_RULE}, l AS (SELECT unnest(['good', 'bad']) AS label), c AS (SELECT label, count(*) FILTER (gold = label AND guess = label) AS tp, count(*) FILTER (gold <> label AND guess = label) AS fp, count(*) FILTER (gold = label AND guess <> label) AS fn FROM l, r GROUP BY label) SELECT label, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1 FROM c WHERE tp + fp + fn > 0")
def prf1_per_class(spark, sf_dir):
    return T.scores(_rule(spark, sf_dir), "gold", "guess")


@query("SELECT event_id // 5 AS grp, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value FROM events GROUP BY 1")
def group_argmax(spark, sf_dir):
    return T.group_argmax(table(spark, sf_dir, "events"), F.expr("event_id div 5"), "value", "event_id")


@query(r"""WITH t AS (SELECT unnest(regexp_extract_all(html, '<[a-zA-Z][a-zA-Z0-9]*\x20[^<>]*>')) AS t FROM pages), a AS (SELECT lower(regexp_extract(t, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS tag, unnest(regexp_extract_all(t, '[a-zA-Z-]+="[^"]*"')) AS a FROM t) SELECT tag, lower(regexp_extract(a, '^([a-zA-Z-]+)=', 1)) AS attr, regexp_extract(a, '="([^"]*)"', 1) AS value, count(*) AS n FROM a GROUP BY 1, 2, 3""")
def tag_attr_counts(spark, sf_dir):
    return T.tag_statistics(table(spark, sf_dir, "pages"), "html")


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.xml_escape(F.col("html")).alias("escaped"))


@query("WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'author' WHEN o_orderkey % 3 = 1 THEN 'affiliation' ELSE 'address' END AS label FROM orders), w AS (SELECT *, last_value(CASE WHEN label <> 'address' THEN label END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM o) SELECT o_orderkey, label FROM w WHERE label <> 'address' OR last = 'affiliation'")
def address_filter(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(k == 0, "author").when(k == 1, "affiliation").otherwise("address").alias("label"))
    return T.address_filter(o, "o_custkey", "o_orderkey", "label").select("o_orderkey", "label")


# ---- references, made of orders by the same expressions on both sides

_K = "CAST(o_orderkey AS VARCHAR)"
_REF = f"r AS (SELECT o_orderkey, o_custkey, '12' || {_K} || ' - ' || {_K} || '9 p.' AS pages, 'vol ' || (o_orderkey % 40) || CASE WHEN o_orderkey % 2 = 0 THEN ' (' || (o_orderkey % 7) || ')' ELSE '' END AS volume, CASE WHEN o_orderkey % 5 = 0 THEN 'in press' ELSE 'May ' || (1950 + o_orderkey % 90) || '.' END AS date, CASE WHEN o_orderkey % 3 = 0 THEN 'No. ' || (o_orderkey % 11) ELSE 'special' END AS number FROM orders)"


def _refs(spark, sf_dir):
    k = F.col("o_orderkey")
    s = k.cast("string")
    mod = lambda n: (k % n).cast("string")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.concat(F.lit("12"), s, F.lit(" - "), s, F.lit("9 p.")).alias("pages"),
        F.concat(F.lit("vol "), mod(40), F.when(k % 2 == 0, F.concat(F.lit(" ("), mod(7), F.lit(")"))).otherwise("")).alias("volume"),
        F.when(k % 5 == 0, "in press").otherwise(F.concat(F.lit("May "), (1950 + k % 90).cast("string"), F.lit("."))).alias("date"),
        F.when(k % 3 == 0, F.concat(F.lit("No. "), mod(11))).otherwise("special").alias("number"),
    )


@query(f"WITH {_REF} SELECT o_orderkey, regexp_extract(pages, '([0-9]+)[^0-9]+?([0-9]+)', 1) || '--' || regexp_extract(pages, '([0-9]+)[^0-9]+?([0-9]+)', 2) AS pages FROM r")
def normalize_pages(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", N.pages(F.col("pages")).alias("pages"))


@query(f"WITH {_REF} SELECT o_orderkey, regexp_extract(volume, '([0-9]+)', 1) AS volume, CASE WHEN contains(volume, '(') THEN regexp_extract(volume, '\\(([0-9]+)', 1) END AS issue FROM r")
def normalize_volume(spark, sf_dir):
    v = _refs(spark, sf_dir).select("o_orderkey", N.volume(F.col("volume")).alias("v"))
    return v.select("o_orderkey", F.get("v", F.lit(0)).alias("volume"), F.get("v", F.lit(1)).alias("issue"))


@query(f"WITH {_REF} SELECT o_orderkey, CASE WHEN coalesce(try_cast(regexp_extract(date, '([0-9]{{4}})', 1) AS INTEGER), 99999) <= 2028 THEN regexp_extract(date, '([0-9]{{4}})', 1) ELSE '' END AS year FROM r")
def normalize_date(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", N.date(F.col("date"), 2025).alias("year"))


@query(f"WITH {_REF} SELECT o_orderkey, CASE WHEN regexp_matches(number, '[0-9]') THEN regexp_extract(number, '([0-9]+)', 1) ELSE number END AS number FROM r")
def normalize_number(spark, sf_dir):
    return _refs(spark, sf_dir).select("o_orderkey", N.number(F.col("number")).alias("number"))


@query("SELECT c_custkey, unnest([lower(replace(c_name, '#', '')) || '@x' || c_nationkey || '.org', 'second@x' || c_nationkey || '.org']) AS mail FROM customer")
def email_group_expand(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    group = F.concat(F.lit("{"), F.lower(F.replace("c_name", F.lit("#"), F.lit(""))), F.lit(", second}@x"), F.col("c_nationkey").cast("string"), F.lit(".org"))
    return c.select("c_custkey", F.explode(N.email_group(group)).alias("mail"))


_CITE = "o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), cited AS (SELECT o_custkey, i, 'Author ' || o_orderkey || ', A title of its own' AS a, 'in two lines. ' || (1950 + o_orderkey % 60) AS b FROM o)"


def _reference_lists(spark, sf_dir):
    """A numbered list for each customer; odd ones in square brackets, others with dots."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("i"))
    i = F.col("i").cast("string")
    mark = F.when(F.col("o_custkey") % 2 == 1, F.concat(F.lit("["), i, F.lit("]"))).otherwise(F.concat(i, F.lit(".")))
    line = F.concat(mark, F.lit(" Author "), F.col("o_orderkey").cast("string"), F.lit(", A title of its own\nin two lines. "), (1950 + F.col("o_orderkey") % 60).cast("string"))
    return o.select("o_custkey", "i", line.alias("line")).groupBy(F.col("o_custkey").alias("doc_id")).agg(D.joined("i", "line", "\n").alias("cite"))


@query("SELECT o_custkey AS doc_id, CASE WHEN o_custkey % 2 = 1 THEN 'SQUARE' ELSE 'NAKEDNUMDOT' END AS kind FROM orders GROUP BY o_custkey")
def marker_vote(spark, sf_dir):
    return _reference_lists(spark, sf_dir).select("doc_id", D.marker_vote(F.col("cite")).alias("kind"))


@query(f"WITH {_CITE} SELECT o_custkey AS doc_id, CAST(i - 1 AS INTEGER) AS cite_no, CASE WHEN o_custkey % 2 = 1 THEN '[' || i || ']' ELSE i || '.' END AS marker, a || ' ' || b AS raw FROM cited")
def split_by_marker(spark, sf_dir):
    return D.split_by_marker(_reference_lists(spark, sf_dir)).select("doc_id", "cite_no", "marker", "raw")


@query("SELECT o_orderkey, 'see [' || (o_orderkey % 9) || ', ' || array_to_string(range(o_orderkey % 50, o_orderkey % 50 + 1 + o_orderkey % 4), ', ') || '] there' AS text FROM orders WHERE o_orderkey % 4 > 0 UNION ALL SELECT o_orderkey, 'see [' || (o_orderkey % 9) || ', ' || (o_orderkey % 50) || '-' || (o_orderkey % 50) || '] there' FROM orders WHERE o_orderkey % 4 = 0")
def range_expand(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    text = F.concat(F.lit("see ["), s(k % 9), F.lit(", "), s(k % 50), F.lit("-"), s(k % 50 + k % 4), F.lit("] there"))
    return table(spark, sf_dir, "orders").select("o_orderkey", D.expand_ranges(text).alias("text"))


@query("WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT o_custkey AS doc_id, CAST(i - 1 AS INTEGER) AS cite_no, '[' || i || ']' AS cit_str, CAST(i - 1 AS INTEGER) * 2 + 1 AS start_word, CAST(i - 1 AS INTEGER) * 2 + 1 AS end_word FROM o")
def citation_contexts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).alias("i"))
    mark = F.concat(F.lit("["), F.col("i").cast("string"), F.lit("]"))
    bodies = o.withColumn("m", F.concat(F.lit("word "), mark)).groupBy("doc_id").agg(D.joined("i", "m", " ").alias("body"))
    refs = o.select("doc_id", (F.col("i") - 1).alias("cite_no"), C.keys_of(mark, F.array().cast("array<string>"), F.lit("")).alias("keys"))
    return C.contexts(bodies, refs, radius=10).select("doc_id", "cite_no", "cit_str", "start_word", "end_word")


@query("WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), l AS (SELECT *, CASE WHEN i % 3 = 0 THEN CAST(i AS VARCHAR) WHEN i % 3 = 2 AND o_orderkey % 2 = 0 THEN 'pp. 3-' ELSE 'text ' || i END AS line FROM o), p AS (SELECT *, coalesce(lag(line) OVER (PARTITION BY o_custkey ORDER BY i), '') AS before FROM l) SELECT o_custkey AS doc_id, string_agg(line, '|' ORDER BY i) AS lines FROM p WHERE NOT (regexp_matches(line, '^[0-9]+$') AND NOT ends_with(before, '-')) GROUP BY 1")
def junk_lines(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w))
    line = F.when(F.col("i") % 3 == 0, F.col("i").cast("string")).when((F.col("i") % 3 == 2) & (F.col("o_orderkey") % 2 == 0), "pp. 3-").otherwise(F.concat(F.lit("text "), F.col("i").cast("string")))
    docs = o.withColumn("line", line).groupBy(F.col("o_custkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]).alias("l"))
    return docs.select("doc_id", F.array_join(D.without_junk(F.col("l")), "|").alias("lines")).filter("lines != ''")


@query(r"SELECT doc_id, trim(replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')), chr(10)), '([A-Za-z])-\n', '\1', 'g'), '-\n', '-', 'g'), chr(10), ' '), ' ') AS merged FROM (SELECT doc_id, regexp_replace(text, 't ', '-' || chr(10), 'g') AS text FROM documents)")
def merge_lines(spark, sf_dir):
    """Over every document: long texts, texts with white space at their ends, and null texts (null) too."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", D.merged(F.split(F.replace("text", F.lit("t "), F.lit("-\n")), "\n", -1)).alias("merged"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN FALSE ELSE (o_orderkey % 2 = 0 AND (o_orderkey % 3 = 0 OR TRUE)) OR o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 END AS valid FROM orders")
def valid_citation(spark, sf_dir):
    k = F.col("o_orderkey")
    some = lambda n, c: F.when(k % n == 0, F.lit(c))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", some(2, "A").alias("authors"), some(3, "T").alias("title"), F.when(k % 7 != 0, F.lit("1999")).alias("date"), some(5, "J").alias("journal"), F.lit(None).cast("string").alias("booktitle"), F.lit("raw").alias("raw"))
    return rows.select("o_orderkey", D.valid_citation().alias("valid"))


@query("SELECT conv_id AS doc_id, count(*) AS n FROM conversations c WHERE turn < coalesce((SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND contains(lower(d.text), 'introduction')), 1000000) AND NOT starts_with(text, '#') GROUP BY 1")
def header_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line_no"), "text")
    return D.header_part(rows).groupBy("doc_id").agg(F.count("*").alias("n"))
