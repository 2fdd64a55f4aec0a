"""Queries of the extraction operators over whole tables: their input is made of a table's rows by the same literals on both
sides, as the tables hold no papers. They join the catalogue's queries."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import lexical as X
from ..functions import normalize as N
from ..operators import affiliations as A
from ..operators import documents as D
from ..operators import evaluate as V
from ..operators import export as E
from ..operators import layout as L
from ..operators import pipelines as P
from ..operators import regions as R
from ..operators import splitlines as S
from ..operators import tables as T
from ..sources import readers as I
from .catalogue import LIN, _histogram, _lines, query, table

#: orders as numbered lines of documents, one document a customer
O = "o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"


def _o(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), F.row_number().over(w.orderBy("o_orderkey")).cast("long").alias("i"), F.count("*").over(w).alias("n"))


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _cat(*parts) -> Column:
    """Strings as they are, columns as strings, in a row."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- features of lines


@query(rf"WITH {LIN} SELECT CASE WHEN regexp_matches(line, '[^a-zA-Z](editor|eds?\.)') THEN 'possibleEditors' ELSE 'noEditors' END AS editor, count(*) AS n FROM lin GROUP BY 1")
def line_possible_editor(spark, sf_dir):
    return _histogram(_lines(spark, sf_dir), X.possible_editor(F.col("text")), "editor")


@query(r"WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS t FROM documents) SELECT doc_id, coalesce(t[1], 'EMPTY') AS first, coalesce(t[2], 'EMPTY') AS second, coalesce(t[-2], 'EMPTY') AS second_last, coalesce(t[-1], 'EMPTY') AS last FROM t")
def edge_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", X.edge_tokens(X.tokens(F.coalesce("text", F.lit("")))).alias("e"))
    return d.select("doc_id", "e.*")


@query(rf"WITH {LIN}, t AS (SELECT list_filter(list_transform(toks, lambda t: regexp_replace(regexp_replace(regexp_replace(t, '^\p{{P}}+', ''), '\p{{P}}+$', ''), '[0-9]', '0', 'g')), lambda t: t <> '') AS t FROM lin WHERE NOT contains(line, '@')), u AS (SELECT 1 AS size, unnest(list_slice(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]*$') AND x NOT IN ('the', 'of')), 1, 4)) AS gram FROM t UNION ALL SELECT 3, unnest(list_slice(list_transform(range(1, len(t) - 1), lambda i: t[i] || '-' || t[i + 1] || '-' || t[i + 2]), 1, 4)) FROM t WHERE len(t) >= 3 UNION ALL SELECT 4, unnest(list_slice(list_transform(range(1, len(t) - 2), lambda i: t[i] || '-' || t[i + 1] || '-' || t[i + 2] || '-' || t[i + 3]), 1, 4)) FROM t WHERE len(t) >= 4), c AS (SELECT size, gram, count(*) AS n FROM u GROUP BY 1, 2) SELECT size, gram, n FROM c QUALIFY row_number() OVER (PARTITION BY size ORDER BY n DESC, gram) <= 50")
def line_ngrams_by_size(spark, sf_dir):
    lines = _lines(spark, sf_dir).filter(~F.contains("text", F.lit("@"))).select("toks")
    each = [lines.select(F.lit(m).alias("size"), F.explode(X.ngrams(F.col("toks"), m, ["the", "of"] if m == 1 else None)).alias("gram")) for m in (1, 3, 4)]
    counts = each[0].union(each[1]).union(each[2]).groupBy("size", "gram").agg(F.count("*").alias("n"))
    return T.top_words(counts, "size", "gram", "n", 50).drop("rank")


@query(f"WITH {O}, l AS (SELECT doc_id, i, CASE WHEN i % 5 = 2 THEN 'Abstract. x' WHEN i % 7 = 4 THEN '2 Introduction' ELSE 'text' END AS t FROM o) SELECT doc_id, i AS line_no, CAST(max(CASE WHEN t LIKE '%Intro%' THEN 2 WHEN t LIKE 'Abs%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS state FROM l")
def front_state(spark, sf_dir):
    i = F.col("i")
    t = F.when(i % 5 == 2, "Abstract. x").when(i % 7 == 4, "2 Introduction").otherwise("text")
    return V.front_state(_o(spark, sf_dir).select("doc_id", i.alias("line_no"), t.alias("text"))).select("doc_id", "line_no", "state")


@query("SELECT doc_id, CAST(least((row_number() OVER (ORDER BY doc_id) - 1) // greatest(1, count(*) OVER () // 7), 6) AS INTEGER) AS fold FROM labels")
def contiguous_folds(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    size = labels.count()
    return T.folds(labels, "doc_id", 7).select("doc_id", V.contiguous_fold(F.col("row"), F.lit(size), 7).alias("fold"))


# ---- normalisers


@query(f"WITH {O} SELECT k, CASE k % 6 WHEN 0 THEN 'a' || k || '.' WHEN 1 THEN '[x' || k || '] y' WHEN 2 THEN 'word' || k WHEN 3 THEN 'T' || k WHEN 4 THEN '(pair) ' || k ELSE 'deep' || k END AS stripped FROM o")
def strip_punctuation(spark, sf_dir):
    k = F.col("k")
    s = F.when(k % 6 == 0, _cat("(((", ", a", k, ".")).when(k % 6 == 1, _cat("[x", k, "] y")).when(k % 6 == 2, _cat("word", k, ")")).when(k % 6 == 3, _cat(",;. T", k)).when(k % 6 == 4, _cat("(pair) ", k)).otherwise(_cat("(,[;{.(:[-{(", "deep", k, "}])"))
    return _o(spark, sf_dir).select("k", N.strip_punctuation(s).alias("stripped"))


@query(f"WITH {O}, a AS (SELECT k, CASE k % 4 WHEN 0 THEN ['A Berg', 'H B Rossi', 'X Weiss'] WHEN 1 THEN ['J-P Duval'] WHEN 2 THEN ['M van_der_Berg', 'X Xu'] ELSE ['Lia Silva', 'Ken Moreau'] END AS a FROM o) SELECT k, CAST(unnest(range(len(a))) AS INTEGER) AS author_no, unnest(a) AS name FROM a")
def author_split(spark, sf_dir):
    k = F.col("k")
    s = F.when(k % 4 == 0, "Berg A, Rossi H B and X. Weiss").when(k % 4 == 1, "J.-P. Duval et al. 1999").when(k % 4 == 2, "M. van der Berg, Jr., and X. Xu").otherwise("Lia Silva; Ken Moreau III")
    return _o(spark, sf_dir).select("k", F.posexplode(N.author_names(s)).alias("author_no", "name"))


@query(f"WITH {O} SELECT k, CASE WHEN k % 3 = 0 THEN 'van der Berg, Rossi' || k ELSE 'Weiss' END || ', ' || (1950 + k % 60) AS marker FROM o")
def marker_build(spark, sf_dir):
    k = F.col("k")
    names = F.when(k % 3 == 0, F.array(F.lit("Anna van_der_Berg"), _cat("Hugo B Rossi", k))).otherwise(F.array(F.lit("Weiss")))
    return _o(spark, sf_dir).select("k", N.marker(names, _s(1950 + k % 60)).alias("marker"))


@query(f"WITH {O} SELECT k, CASE k % 3 WHEN 0 THEN 'We study broken words of ' || k WHEN 1 THEN 'parsing, tables' ELSE 'Abstraction ' || k || ' stays' END AS field FROM o")
def header_field(spark, sf_dir):
    k = F.col("k")
    s = F.when(k % 3 == 0, _cat(" Abstract: We study bro- ken words of ", k, " ")).when(k % 3 == 1, "Keywords - parsing, tables").otherwise(_cat("Abstraction ", k, " stays"))
    return _o(spark, sf_dir).select("k", N.header_field(s).alias("field"))


@query(f"WITH {O}, a AS (SELECT k, CASE k % 3 WHEN 0 THEN ['Anna Berg', 'Hugo Rossi'] WHEN 1 THEN ['Li Wei'] ELSE ['B' || 'erg Anna'] END AS a FROM o) SELECT k, CAST(unnest(range(len(a))) AS INTEGER) AS author_no, unnest(a) AS name FROM a")
def header_authors(spark, sf_dir):
    k = F.col("k")
    s = F.when(k % 3 == 0, "Anna Berg1,2 and Hugo Rossi2*").when(k % 3 == 1, "Li Wei‡").otherwise("Berg Anna§ 3")
    return _o(spark, sf_dir).select("k", F.posexplode(N.author_names(F.regexp_replace(s, r"[0-9*†‡§]", ""))).alias("author_no", "name"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS plain FROM pages")
def entity_decode(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.unescape(F.col("html")).alias("plain"))


@query(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' (v.1-' || p_partkey || ')+? [a] "b" c\d ^e$', '([\\\-\[\]()''".])', '\\\1', 'g'), '[+?*^$]', '', 'g') AS escaped FROM part""")
def regex_escape(spark, sf_dir):
    s = _cat(F.col("p_name"), " (v.1-", F.col("p_partkey"), ")+? [a] \"b\" c\\d ^e$")
    return table(spark, sf_dir, "part").select("p_partkey", N.regex_escape(s).alias("escaped"))


@query(f"WITH {O} SELECT k, (k % 3) || '|' || chr(CAST(97 + k % 5 AS INTEGER)) AS author_signals, 'a' || (k % 4) AS affiliation_signals FROM o")
def signal_cleanup(spark, sf_dir):
    k = F.col("k")
    a = _cat(" ", k % 3, " , :", F.chr(97 + k % 5), ";")
    b = _cat("a ", k % 4, " ")
    return _o(spark, sf_dir).select("k", F.array_join(N.signals(a, True), "|").alias("author_signals"), F.array_join(N.signals(b, False), "|").alias("affiliation_signals"))


# ---- regions


@query(f"WITH {O} SELECT doc_id, CAST(i - 1 AS INTEGER) AS cite_no, 'Writer B' || k || 'x. ' || (1950 + k % 60) || '. The first part of it, second part of ' || k || ' pages.' AS raw FROM o")
def unmarked_split(spark, sf_dir):
    k = F.col("k")
    lines = _o(spark, sf_dir).select("doc_id", "i", F.explode(F.array(F.struct(F.lit(0).alias("p"), _cat("Writer B", k, "x. ", 1950 + k % 60, ". The first part of it,").alias("x")), F.struct(F.lit(1).alias("p"), _cat("second part of ", k, " pages.").alias("x")))).alias("l"))
    refs = lines.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "l.p", "l.x"))), lambda s: s["x"]).alias("l"))
    return D.split_unmarked(refs)


@query(f"WITH {O}, w AS (SELECT doc_id, i, unnest([struct_pack(j := 0, w := 'alpha', p := 0), struct_pack(j := 1, w := 'beta', p := 1), struct_pack(j := 2, w := '[' || k || ',', p := 3), struct_pack(j := 3, w := '2,', p := 3), struct_pack(j := 4, w := '3,', p := 3), struct_pack(j := 5, w := '4].', p := 3), struct_pack(j := 6, w := '[7,', p := 5), struct_pack(j := 7, w := '9]', p := 6)]) AS x FROM o) SELECT doc_id, CAST((i - 1) * 8 + x.j AS INTEGER) AS norm_no, CAST((i - 1) * 7 + x.p AS INTEGER) AS orig_no, x.w AS word FROM w")
def position_map(spark, sf_dir):
    k = F.col("k")
    t = _cat(" alpha\n\n be-\nta  [", k, ", 2-4].\n[7, 9]")
    docs = _o(spark, sf_dir).withColumn("t", t).groupBy("doc_id").agg(D.joined("i", "t", "\n").alias("text"))
    return R.position_map(docs)


_REGION = f"{O}, h AS (SELECT *, CASE WHEN n >= 3 THEN 2 ELSE n END AS s0 FROM o), s AS (SELECT *, CASE WHEN s0 >= 0.8 * (n - s0) THEN 0 ELSE s0 END AS s FROM h)"


def _front_lines(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    t = F.when(i == 3, F.when(k % 2 == 0, "1 Introduction").otherwise("Introduction and Background")).when(i == 2, "An Introduction to tables").otherwise(_cat("line ", i))
    return _o(spark, sf_dir).select("doc_id", i.alias("line_no"), t.alias("text"), (k % 2 == 0).alias("new_para"))


@query(f"WITH {_REGION} SELECT doc_id, i AS line_no FROM s WHERE i <= s")
def header_region(spark, sf_dir):
    return R.header_lines(_front_lines(spark, sf_dir)).select("doc_id", "line_no")


@query(f"WITH {_REGION} SELECT doc_id, i AS line_no, CASE WHEN i <= s THEN 'header' WHEN k % 2 = 0 THEN 'new' ELSE 'continue' END AS paragraph FROM s")
def paragraph_state(spark, sf_dir):
    return R.paragraph_state(_front_lines(spark, sf_dir)).select("doc_id", "line_no", "paragraph")


@query("SELECT conv_id, turn, CASE WHEN contains(text, chr(10)) THEN text[strpos(text, chr(10)) + 1:] ELSE '' END AS text FROM conversations")
def without_top_line(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.without_top_lines(F.col("text"), 1).alias("text"))


@query(f"WITH {O}, l AS (SELECT *, i * 4 > n * 3 OR i = 5 AS ref, CASE WHEN i % 4 = 0 THEN CAST(i AS VARCHAR) ELSE 'line ' || k END AS t FROM o), f AS (SELECT *, min(CASE WHEN ref THEN i END) OVER (PARTITION BY doc_id) AS first FROM l), g AS (SELECT doc_id, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (first IS NULL OR i < first), '') AS body, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (ref), '') AS whole, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (ref AND i % 4 > 0), '') AS part FROM f GROUP BY doc_id) SELECT doc_id, body, CASE WHEN length(whole) >= 0.8 * length(body) THEN whole ELSE part END AS cite, whole <> '' AND length(whole) >= 0.8 * length(body) AS oversized FROM g")
def section_label_split(spark, sf_dir):
    k, i, n = F.col("k"), F.col("i"), F.col("n")
    rows = _o(spark, sf_dir).select("doc_id", i.alias("line_no"), F.when(i % 4 == 0, _s(i)).otherwise(_cat("line ", k)).alias("text"), F.when((i * 4 > n * 3) | (i == 5), "reference").otherwise("bodyText").alias("label"))
    return R.split_by_section_labels(rows)


_HEADED = f"{O}, l AS (SELECT *, CASE WHEN i = 2 OR i = 1 + n - n // 3 THEN 'REFERENCES' WHEN i = n AND n % 2 = 0 THEN 'Appendix B' ELSE 'text ' || k END AS t FROM o), h AS (SELECT *, max(CASE WHEN t = 'REFERENCES' THEN i END) OVER (PARTITION BY doc_id) AS h FROM l)"


def _headed(spark, sf_dir):
    k, i, n = F.col("k"), F.col("i"), F.col("n")
    t = F.when((i == 2) | (i == 1 + n - F.floor(n / 3)), "REFERENCES").when((i == n) & (n % 2 == 0), "Appendix B").otherwise(_cat("text ", k))
    return _o(spark, sf_dir).select("doc_id", i.alias("line_no"), t.alias("text"))


@query(f"WITH {_HEADED} SELECT doc_id, CAST(n - r AS BIGINT) AS body_lines, CAST(r AS BIGINT) AS reference_lines FROM (SELECT doc_id, n, CASE WHEN n - h < 0.8 * h THEN n - h ELSE 0 END AS r FROM (SELECT DISTINCT doc_id, n, h FROM h))")
def reference_line_counts(spark, sf_dir):
    return R.reference_lines_by_count(_headed(spark, sf_dir))


@query(f"WITH {_HEADED}, x AS (SELECT *, i > h AND NOT (t = 'Appendix B' AND i > h + 1) AS inside FROM h), z AS (SELECT *, sum(CASE WHEN inside THEN length(t) + 1 END) OVER (PARTITION BY doc_id) AS r, sum(length(t) + 1) OVER (PARTITION BY doc_id) AS a FROM x) SELECT doc_id, i AS line_no, t AS text FROM z WHERE inside AND 1.8 * r < 0.8 * a")
def layout_reference_lines(spark, sf_dir):
    return R.reference_lines(_headed(spark, sf_dir), ["line_no"])


@query(f"WITH {O}, b AS (SELECT doc_id, string_agg(CASE WHEN i % 3 = 0 THEN '' ELSE 'line ' || k END, chr(10) ORDER BY i) AS t, max(n) AS n FROM o GROUP BY doc_id), g AS (SELECT doc_id, i, k, n, (i - 1) // 3 AS g FROM o WHERE i % 3 > 0) SELECT doc_id, CAST(g AS INTEGER) AS cite_no, string_agg('line ' || k, ' ' ORDER BY i) AS raw FROM g GROUP BY doc_id, g")
def presegmented_references(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    return D.presegmented(_o(spark, sf_dir).select("doc_id", i.alias("line_no"), F.when(i % 3 == 0, "").otherwise(_cat("line ", k)).alias("text")))


@query(f"WITH {O} SELECT doc_id, CAST((i - 1) // 4 AS INTEGER) AS cite_no, string_agg('piece ' || k, ' ' ORDER BY i) AS raw FROM o GROUP BY 1, 2")
def split_by_labels(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    return S.split_by_labels(_o(spark, sf_dir).select("doc_id", i.alias("line_no"), _cat("piece ", k).alias("text"), F.when(i % 4 == 1, "begin").otherwise("continue").alias("label")))


# ---- corpora, labels, reports


@query(f"WITH {O} SELECT k AS seq_no, CAST(unnest(range(4)) AS INTEGER) AS tok_no, unnest(['A.', 'Berg' || k, 'Title', CAST(1950 + k % 60 AS VARCHAR)]) AS tok, unnest(['author', 'author', 'title', 'date']) AS gold FROM o WHERE k % 5 > 0")
def tagged_corpus_tokens(spark, sf_dir):
    k = F.col("k")
    line = F.when(k % 5 == 0, "# a comment").otherwise(_cat("<author> A. Berg", k, " </author> <title>Title </title><date> ", 1950 + k % 60, "</date>"))
    return I.tagged_tokens(_o(spark, sf_dir).select(k.alias("seq_no"), line.alias("line")))


@query(f"WITH {O} SELECT k AS doc_id, CAST(unnest(range(3)) AS INTEGER) AS line_no, unnest(['title', 'title', 'author']) AS gold, unnest(['a b', 'c' || k, 'd e']) AS line FROM o")
def tagged_corpus_lines(spark, sf_dir):
    k = F.col("k")
    return I.tagged_lines(_o(spark, sf_dir).select(k.alias("doc_id"), _cat("<title> a b +L+ c", k, " +L+ </title> <author> d e +L+ </author>").alias("text")))


@query(f"WITH {O} SELECT k AS doc_id, CAST(unnest(range(5)) AS INTEGER) AS row_no, unnest(['//title', 'a b +L+', 'c' || k || ' +L+', '//author', 'd e +L+']) AS text FROM o")
def tagged_header_lines(spark, sf_dir):
    k = F.col("k")
    return R.tagged_header_lines(_o(spark, sf_dir).select(k.alias("doc_id"), _cat("<title> a b +L+ c", k, " +L+ </title> <author> d e +L+ </author>").alias("text")))


@query("WITH w AS (SELECT * FROM (VALUES ('urgency', '0-URGENT'), ('urgency', '0-HIGH'), ('rest', '0-LOW'), ('rest', '0-NOT')) AS v(tag, word)), t AS (SELECT regexp_replace(regexp_extract(o_orderpriority, '^([^ ]+)', 1), '[0-9]', '0', 'g') AS t FROM orders) SELECT tag, CASE WHEN EXISTS (SELECT 1 FROM w WHERE w.tag = g.tag AND w.word = t) THEN tag || '-' || t ELSE 'none' END AS value, count(*) AS n FROM t, (SELECT DISTINCT tag FROM w) AS g GROUP BY 1, 2")
def keyword_lookup(spark, sf_dir):
    words = spark.createDataFrame(I.keyword_lists(["urgency: 0-URGENT 0-HIGH", "rest: 0-LOW 0-NOT"]), "tag string, word string")
    rows = R.keyword_features(table(spark, sf_dir, "orders").select(_cat("(", F.col("o_orderpriority")).alias("text")), words)
    return rows.select(F.explode("keywords").alias("tag", "value")).groupBy("tag", "value").agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT c_custkey AS doc_id, ['Berg-', '**', '|x', '.,', '#', lpad(CAST(c_custkey AS VARCHAR), 3, '0')] AS t FROM customer) SELECT doc_id, CAST(unnest(range(6)) AS INTEGER) AS tok_no, unnest(t) AS content, unnest(list_transform(t, lambda x: lower(x))) AS lower, unnest(list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[a-zA-Z0-9]') THEN lower(regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')) ELSE x END)) AS bare_lower, unnest(list_transform(t, lambda x: CASE WHEN length(x) < 4 THEN length(x) || '-char' ELSE '4+char' END)) AS length_class, unnest(list_transform(range(6), lambda j: CASE WHEN j = 0 THEN 'begin' ELSE 'continue' END)) AS place FROM t")
def author_line_tokens(spark, sf_dir):
    text = F.concat(F.lit("Berg-** |x., #"), F.lpad(_s("c_custkey"), 3, "0"))
    return R.author_tokens(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("line_no"), text.alias("text"))).drop("line_no")


@query("SELECT c_custkey AS doc_id, unnest(['Ann Berg,', 'Hugo Rossi', 'Li, Wei,', 'Xu, M.', 'Y']) AS name, CAST(unnest(range(5)) AS INTEGER) AS author_no, unnest([0, 2, 5, 7, 10]) AS tok_no, unnest([0, 20, 50, 70, 100]) AS x FROM customer")
def author_name_groups(spark, sf_dir):
    toks = ["Ann", "Berg,", "Hugo", "Rossi", "and", "Li,", "Wei,", "Xu,", "M.", "&", "Y"]
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.posexplode(F.array(*map(F.lit, toks))).alias("tok_no", "tok"))
    out = R.author_groups(rows.withColumn("x", F.col("tok_no") * 10))
    return out.select("doc_id", "name", "author_no", "tok_no", "x")


@query("WITH l AS (SELECT *, lag((l_returnflag, l_linestatus)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_returnflag, l_linestatus) AS p FROM lineitem) SELECT l_orderkey AS doc_id, l_linenumber, CASE WHEN p = (l_returnflag, l_linestatus) THEN 'fcontinue' ELSE 'fbegin' END AS format FROM l")
def format_changes(spark, sf_dir):
    from .catalogue import LINE

    return R.format_changes(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "doc_id"), LINE, ["l_returnflag", "l_linestatus"]).select("doc_id", "l_linenumber", "format")


@query(f"WITH {O} SELECT doc_id, i AS line_no, CASE WHEN i % 4 = 1 THEN CASE k % 3 WHEN 0 THEN 'related_work' WHEN 1 THEN 'general terms' ELSE 'method' END END AS generic FROM o")
def heading_insertion(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    o = _o(spark, sf_dir)
    lines = o.select("doc_id", i.alias("line_no"), F.when(i % 4 == 1, "sectionHeader").otherwise("bodyText").alias("label"))
    kinds = o.filter(i % 4 == 1).select("doc_id", i.alias("line_no"), F.when(k % 3 == 0, "related-works").when(k % 3 == 1, "general-terms").otherwise("method").alias("kind"))
    return R.heading_kinds(lines, kinds).select("doc_id", "line_no", "generic")


@query(f"WITH {O} SELECT doc_id, i AS cite_no FROM o")
def citation_count_check(spark, sf_dir):
    i = F.col("i")
    c = _o(spark, sf_dir).select("doc_id", i.alias("cite_no"))
    return R.same_count(c, c.withColumn("title", F.lit("t"))).select("doc_id", "cite_no")


@query(f"WITH {O} SELECT doc_id, i - 1 AS tok_no, CASE WHEN k % 2 = k % 3 THEN 'tok&amp;' || k ELSE '<error correct=\"L' || (k % 2) || '\" taggedAs=\"L' || (k % 3) || '\">tok&amp;' || k || '</error>' END AS shown FROM o")
def label_error_report(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    rows = _o(spark, sf_dir).select("doc_id", (i - 1).alias("tok_no"), _cat("tok&", k).alias("tok"), _cat("L", k % 2).alias("gold"), _cat("L", k % 3).alias("guess"))
    return E.error_report(rows, "gold", "guess", "tok").select("doc_id", "tok_no", "shown")


@query(f"WITH {O}, a AS (SELECT doc_id, i, CASE WHEN i % 3 = 0 THEN 'none' ELSE 'L' || (k % 4) END AS label, 'line ' || k AS text FROM o) SELECT doc_id, i AS line_no, text, label FROM a")
def section_text(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    o = _o(spark, sf_dir)
    return V.section_text(o.select("doc_id", i.alias("line_no"), _cat("line ", k).alias("text")), o.filter(i % 3 > 0).select("doc_id", i.alias("line_no"), _cat("L", k % 4).alias("label"))).select("doc_id", "line_no", "text", "label")


@query(f"WITH {O}, r AS (SELECT doc_id, i, k, 'L' || (k % 4) AS gold FROM o WHERE k % 4 IN (1, 2)) SELECT doc_id, i AS line_no, CAST(unnest(range(2)) AS INTEGER) AS tok_no, unnest(['line', CAST(k AS VARCHAR)]) AS tok, gold, 'L1' AS guess FROM r")
def line_to_token_labels(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    rows = _o(spark, sf_dir).select("doc_id", i.alias("line_no"), _cat("line  ", k).alias("text"), _cat("L", k % 4).alias("gold"), F.lit("L1").alias("guess"))
    return V.line_to_token_labels(V.known_tags(rows, "gold", ["L1", "L2"]))


@query(f"WITH {O}, t AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN NULL ELSE (i // 5) % 2 END AS a, CASE WHEN i % 5 = 0 OR (i % 5 = 4 AND k % 3 = 0) THEN NULL ELSE (i // 5) % 2 END AS b FROM o), c AS (SELECT 'gold' AS s, doc_id, i // 5 AS g, min(i) AS x, max(i) AS y, min(a) AS t FROM t WHERE a IS NOT NULL GROUP BY doc_id, i // 5 UNION ALL SELECT 'guess', doc_id, i // 5, min(i), max(i), min(b) FROM t WHERE b IS NOT NULL GROUP BY doc_id, i // 5), j AS (SELECT coalesce(p.t, q.t) AS t, p.g AS pg, q.g AS qg FROM (FROM c WHERE s = 'gold') AS p FULL JOIN (FROM c WHERE s = 'guess') AS q ON p.doc_id = q.doc_id AND p.x = q.x AND p.y = q.y AND p.t = q.t), u AS (SELECT 'T' || t AS label, count(*) FILTER (pg IS NOT NULL AND qg IS NOT NULL) AS tp, count(*) FILTER (pg IS NULL) AS fp, count(*) FILTER (qg IS NULL) AS fn FROM j GROUP BY 1) SELECT label, tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM u")
def chunk_scores(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    kind = F.concat(F.lit("-T"), _s(F.floor(i / 5) % 2))
    gold = F.when(i % 5 == 0, "O").when(i % 5 == 1, F.concat(F.lit("B"), kind)).otherwise(F.concat(F.lit("I"), kind))
    guess = F.when((i % 5 == 0) | ((i % 5 == 4) & (k % 3 == 0)), "O").otherwise(F.concat(F.lit("I"), kind))
    return T.chunk_scores(_o(spark, sf_dir).select("doc_id", "i", gold.alias("gold"), guess.alias("guess")), "doc_id", "i", "gold", "guess")


@query(f"WITH {O}, t AS (SELECT doc_id, i, k, (i - 1) // 5 AS g, i % 5 IN (1, 2, 3) AS author FROM o) SELECT a.doc_id, 'A' || a.k AS author, 'S' || b.k AS signal FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.g = b.g AND a.author AND NOT b.author")
def signal_fanout(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    author = (i % 5).isin(1, 2, 3)
    rows = _o(spark, sf_dir).select("doc_id", "i", F.when(author, "author").otherwise("signal").alias("kind"), F.when(author, _cat("A", k)).otherwise(_cat("S", k)).alias("s"))
    return T.signal_fanout(rows, "doc_id", "i", "kind", "s")


# ---- authors and affiliations: customers and suppliers of a nation


@query("WITH a AS (SELECT n_nationkey AS doc_id, c_custkey AS author_no, c_acctbal AS x, c_custkey % 3 AS s FROM nation JOIN customer ON c_nationkey = n_nationkey), b AS (SELECT s_nationkey AS doc_id, s_suppkey AS affiliation_no, s_acctbal AS x, s_suppkey % 3 AS s FROM supplier), p AS (SELECT a.doc_id, author_no, affiliation_no, a.s = b.s AS same, row_number() OVER (PARTITION BY author_no ORDER BY abs(a.x - b.x), affiliation_no) = 1 AS near FROM a JOIN b USING (doc_id)), q AS (SELECT *, bool_or(same) OVER (PARTITION BY author_no) AS hit FROM p) SELECT doc_id, author_no, affiliation_no, CASE WHEN same THEN 'same' ELSE 'diff' END AS signal, CASE WHEN near THEN 'yes' ELSE 'no' END AS nearest_y, CASE WHEN CASE WHEN hit THEN same ELSE near END THEN 'yes' ELSE 'no' END AS label FROM q")
def affiliation_match(spark, sf_dir):
    place = [F.lit(0).alias(c) for c in ("page", "section")]
    side = lambda t, nation, no, name, bal, para: t.select(F.col(nation).alias("doc_id"), F.col(no).alias(f"{name}_no"), _cat(name, F.col(no)).alias(name), F.array(_s(F.col(no) % 3)).alias("signals"), *place, F.lit(para).alias("para"), F.lit(0).alias("line"), F.col(bal).alias("x"), F.col(bal).alias("y"))
    a = side(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "author", "c_acctbal", 0)
    b = side(table(spark, sf_dir, "supplier"), "s_nationkey", "s_suppkey", "affiliation", "s_acctbal", 1)
    return A.match_affiliations(a, b).select("doc_id", "author_no", "affiliation_no", "signal", "nearest_y", "label")


# ---- exports

_CITE = f"{O}, c AS (SELECT doc_id, i, k, 'T&' || k AS title, CASE WHEN k % 4 = 0 THEN 'J' || (k % 9) END AS journal, CASE WHEN k % 4 = 1 THEN 'Proc ' || (k % 9) END AS booktitle, CASE WHEN k % 2 = 0 THEN (k % 50) || '--' || (k % 50 + 5) END AS pages, CAST(1950 + k % 60 AS VARCHAR) AS date FROM o)"


def _cites(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    none = F.lit(None).cast("string")
    fields = {"authors": F.array(F.lit("A Berg"), _cat("H Rossi", k)), "title": _cat("T&", k), "journal": F.when(k % 4 == 0, _cat("J", k % 9)), "booktitle": F.when(k % 4 == 1, _cat("Proc ", k % 9)), "pages": F.when(k % 2 == 0, _cat(k % 50, "--", k % 50 + 5)), "date": _s(1950 + k % 60), "valid": F.lit(True), "raw": F.lit("raw"), "marker": none}
    for c in ("tech", "volume", "issue", "editor", "publisher", "institution", "location", "note"):
        fields[c] = none
    return _o(spark, sf_dir).select("doc_id", i.alias("cite_no"), *[v.alias(c) for c, v in fields.items()])


@query(f"WITH {_CITE} SELECT doc_id, i AS cite_no, CASE WHEN journal IS NOT NULL THEN 'article' WHEN booktitle IS NULL AND pages IS NULL THEN 'book' WHEN booktitle IS NOT NULL THEN 'section' END AS kind FROM c")
def export_kinds(spark, sf_dir):
    return _cites(spark, sf_dir).select("doc_id", "cite_no", E.kind().alias("kind"))


@query(f"""WITH {_CITE} SELECT doc_id, i AS cite_no, '@' || CASE WHEN journal IS NOT NULL THEN 'article' WHEN booktitle IS NOT NULL THEN 'inproceedings' ELSE 'book' END || '{{Berg' || date || ',' || chr(10) || array_to_string(list_filter(['  author = {{A Berg and H Rossi' || k || '}}', '  title = {{' || title || '}}', '  journal = {{' || journal || '}}', '  booktitle = {{' || booktitle || '}}', '  year = {{' || date || '}}', '  pages = {{' || pages || '}}'], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}}' AS entry FROM c WHERE journal IS NOT NULL OR booktitle IS NOT NULL OR pages IS NULL""")
def export_bib(spark, sf_dir):
    return E.exported(_cites(spark, sf_dir), "bib")


@query(f"""WITH {_CITE} SELECT doc_id, i AS cite_no, array_to_string(list_filter(['TY  - ' || CASE WHEN journal IS NOT NULL THEN 'JOUR' WHEN booktitle IS NOT NULL THEN 'CHAP' ELSE 'BOOK' END, 'AU  - A Berg' || chr(10) || 'AU  - H Rossi' || k, 'TI  - ' || title, 'T2  - ' || coalesce(journal, booktitle), 'PY  - ' || date, 'SP  - ' || split_part(pages, '--', 1), 'EP  - ' || split_part(pages, '--', 2), 'ER  - '], lambda x: x IS NOT NULL), chr(10)) AS entry FROM c WHERE journal IS NOT NULL OR booktitle IS NOT NULL OR pages IS NULL""")
def export_ris(spark, sf_dir):
    return E.exported(_cites(spark, sf_dir), "ris")


@query(f"""WITH {_CITE} SELECT doc_id, i AS cite_no, '<citation valid="true"><authors><author>A Berg</author><author>H Rossi' || k || '</author></authors><title>T&amp;' || k || '</title><date>' || date || '</date>' || coalesce('<journal>' || journal || '</journal>', '') || coalesce('<booktitle>' || booktitle || '</booktitle>', '') || coalesce('<pages>' || pages || '</pages>', '') || '<rawString>raw</rawString></citation>' AS xml FROM c""")
def citation_xml(spark, sf_dir):
    return _cites(spark, sf_dir).select("doc_id", "cite_no", E.citation_xml().alias("xml"))


@query(f"""WITH {O} SELECT doc_id, '<variant confidence="0.750000"><title confidence="0.500000">T&lt;' || max(n) || '</title><author confidence="1.000000">B</author></variant>' AS xml FROM o GROUP BY doc_id""")
def runs_xml(spark, sf_dir):
    n = F.col("n")
    run = lambda tag, content, p: F.struct(F.lit(tag).alias("tag"), content.alias("content"), F.lit(p).alias("confidence"))
    docs = _o(spark, sf_dir).groupBy("doc_id").agg(F.max("n").alias("n"))
    return docs.select("doc_id", F.array(run("title", _cat("T<", n), 0.5), run("author", F.lit("B"), 1.0)).alias("runs")).select("doc_id", E.runs_xml().alias("xml"))


@query(f"WITH {O} SELECT doc_id, CAST(2 AS INTEGER) AS header, CAST(max(n) + 1 AS INTEGER) AS body, CAST(3 AS INTEGER) AS reference FROM o GROUP BY doc_id")
def structure_counts(spark, sf_dir):
    run = lambda tag, content: F.struct(F.lit(tag).alias("tag"), content.alias("content"), F.lit(1.0).alias("confidence"))
    docs = _o(spark, sf_dir).groupBy("doc_id").agg(D.joined("i", "k", "\n").alias("b"))
    runs = F.array(run("title", F.lit("a")), run("author", F.lit("b")), run("bodyText", F.col("b")), run("figure", F.lit("x")), run("reference", F.lit("1\n2\n3")))
    return P.structure_info(docs.select("doc_id", runs.alias("runs")))


# ---- layout: pages written as XML, a line for each order


def _xml(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    line = F.concat(F.lit('<ln l="10" t="'), _s(i * 10), F.lit('" r="90" b="'), _s(i * 10 + 8), F.lit('" fontSize="'), _s(F.when(k % 3 == 0, 1200).otherwise(1000)), F.lit('"><wd bold="true">w'), _s(k), F.lit("</wd><space/><run"), F.when(k % 2 == 0, F.lit(' bold="true"')).otherwise(""), F.lit('><wd>x &amp; y</wd></run><wd><run fontSize="900">z</run><run subsuperscript="superscript" fontSize="900">1</run></wd></ln>'))
    o = _o(spark, sf_dir).withColumn("x", line)
    body = o.groupBy("doc_id").agg(D.joined("i", "x", "").alias("x"))
    return body.select("doc_id", F.concat(F.lit('<?xml version="1.0"?><document><page><body><section><column><para alignment="left">'), F.col("x"), F.lit("</para></column></section></body></page></document>")).alias("xml"))


@query(f"WITH {O} SELECT doc_id, CAST(i - 1 AS INTEGER) AS ln, 'w' || k || ' x & y z 1' AS text, CASE WHEN k % 3 = 0 THEN 1200 ELSE 1000 END AS font_size, 'no' AS bold, CAST(i * 10 AS INTEGER) AS t FROM o")
def layout_lines(spark, sf_dir):
    return L.layout_lines(L.layout_words(_xml(spark, sf_dir))).select("doc_id", "ln", "text", "font_size", "bold", "t")


@query(f"WITH {O}, z AS (SELECT *, CASE WHEN k % 3 = 0 THEN 1200 ELSE 1000 END AS f FROM o), m AS (SELECT doc_id, f AS u FROM (SELECT doc_id, f, count(*) AS c FROM z GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f DESC) = 1) SELECT doc_id, i - 1 AS line_no, CAST((i - 1) * 10 * 8 // ((n - 1) * 10 + 1) AS INTEGER) AS loc, CASE WHEN f < u THEN 'smaller' WHEN f > u THEN 'larger' ELSE 'common' END AS size_class, CASE WHEN lag(f) OVER (PARTITION BY doc_id ORDER BY i) = f THEN 'continue' ELSE 'new' END AS font_size_diff FROM z JOIN m USING (doc_id)")
def layout_line_features(spark, sf_dir):
    out = L.layout_features(L.layout_lines(L.layout_words(_xml(spark, sf_dir))))
    return out.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "loc", "size_class", "font_size_diff")


@query(f"WITH {O} SELECT doc_id, CAST(i - 1 AS INTEGER) AS ln FROM o WHERE i BETWEEN 3 AND 6")
def layout_line_range(spark, sf_dir):
    return L.line_range(L.layout_lines(L.layout_words(_xml(spark, sf_dir))), (0, 0, 0, 2), (0, 0, 0, 5)).select("doc_id", "ln")


@query(f"WITH {O} SELECT doc_id, '<document><page><para>' || string_agg('<line><word>w' || k || '</word><word>x &amp; y</word><word>z</word><word>1</word></line>', '' ORDER BY i) || '</para></page></document>' AS markup FROM o GROUP BY doc_id")
def layout_markup(spark, sf_dir):
    return L.simplified(L.layout_words(_xml(spark, sf_dir)))


@query(f"WITH {O}, c AS (SELECT doc_id, (i - 1) // 3 AS r, (i - 1) % 3 AS c, CASE WHEN i % 2 = 0 THEN ['a' || k, 'b' || k] ELSE ['a' || k] END AS l FROM o), m AS (SELECT doc_id, r, max(len(l)) AS m FROM c GROUP BY 1, 2) SELECT doc_id, CAST(c.r AS BIGINT) AS row, CAST(j AS INTEGER) AS line, string_agg(coalesce(l[j + 1], ''), chr(9) ORDER BY c) AS text FROM c JOIN m USING (doc_id, r), range(2) AS u(j) WHERE j < m GROUP BY ALL")
def table_grid(spark, sf_dir):
    k, i = F.col("k"), F.col("i")
    cells = _o(spark, sf_dir).select("doc_id", F.lit(0).alias("table_no"), F.floor((i - 1) / 3).alias("row"), ((i - 1) % 3).alias("col"), F.when(i % 2 == 0, F.array(_cat("a", k), _cat("b", k))).otherwise(F.array(_cat("a", k))).alias("lines"))
    return L.table_grid(cells).select("doc_id", "row", "line", "text")


# ---- models: rows only


@query()
def crf_decode(spark, sf_dir):
    """The parsed fields of made-up references, one for each order."""
    k, i = F.col("k"), F.col("i")
    raw = _cat("A. Berg, \"Fast parsing of tables ", k % 90, ",\" Data Review, vol. ", k % 40, ", pp. ", k % 50, "-", k % 50 + 7, ", ", 1950 + k % 60, ".")
    out = P.parse_references(_o(spark, sf_dir).select("doc_id", i.alias("cite_no"), raw.alias("raw")))
    return out.select("doc_id", "cite_no", "authors", "title", "journal", "volume", "pages", "date", "valid")
