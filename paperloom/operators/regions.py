"""Regions of labelled and laid-out documents, what links words of a normalised body to the original, and the tokens of
author and affiliation lines. Windows are keyed by document; nothing is collected across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import lexical as X
from ..functions.lexical import let
from . import documents as D

#: A line that ends in one of these words, perhaps with a colon; an introduction may go on with its background
_AFTER = r"(?:^|[^\p{L}\p{N}_])(?:Abstract|ABSTRACT|Introductions?|INTRODUCTIONS?)(?::?[\x09-\x0D\x20]*$|[^\p{L}\p{N}_].*[Bb][Aa][Cc][Kk][Gg][Rr][Oo][Uu][Nn][Dd])"
TOO_LONG = 0.8


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def body_start(lines: DataFrame) -> DataFrame:
    """doc_id, start, n: the line (counted from 0 over the lines given) at which the body begins: the first that is a heading
    of abstract or introduction. A header of 0.8 of the body or more, or no such heading, means no header: 0."""
    rows = lines.withColumn("__i", F.row_number().over(_doc().orderBy("line_no")) - 1)
    out = rows.groupBy("doc_id").agg(F.coalesce(F.min(F.when(F.col("text").rlike(_AFTER), F.col("__i"))), F.count("*")).cast("int").alias("start"), F.count("*").alias("n"))
    return out.select("doc_id", F.when(F.col("start") >= TOO_LONG * (F.col("n") - F.col("start")), 0).otherwise(F.col("start")).alias("start"), "n")


def header_lines(lines: DataFrame) -> DataFrame:
    """The lines (doc_id, line_no, text, ...) before body_start. All columns stay."""
    rows = lines.withColumn("__i", F.row_number().over(_doc().orderBy("line_no")) - 1)
    return rows.join(body_start(lines).select("doc_id", F.col("start").alias("__start")), "doc_id").filter("__i < __start").drop("__i", "__start")


def without_top_lines(text: Column, n: int) -> Column:
    """The text without its first n lines."""
    return F.array_join(F.slice(F.split(text, "\n", -1), n + 1, 1 << 30), "\n")


def paragraph_state(lines: DataFrame, new: str = "new_para") -> DataFrame:
    """lines with paragraph: header before the body, then new or continue by a boolean column."""
    rows = lines.withColumn("__i", F.row_number().over(_doc().orderBy("line_no")) - 1)
    rows = rows.join(body_start(lines).select("doc_id", F.col("start").alias("__start")), "doc_id")
    return rows.withColumn("paragraph", F.when(F.col("__i") < F.col("__start"), "header").when(F.col(new), "new").otherwise("continue")).drop("__i", "__start")


def split_by_section_labels(lines: DataFrame, reference: str = "reference") -> DataFrame:
    """doc_id, body, cite, oversized, from lines (doc_id, line_no, text, label): cite has the lines labelled as reference, body
    those before the first. References of 0.8 of the body or more are returned as they are, without clearing of junk lines.
    A document without reference lines is all body."""
    here = F.col("label") == reference
    rows = lines.withColumn("__first", F.min(F.when(here, F.col("line_no"))).over(_doc()))
    body = (F.col("__first").isNull()) | (F.col("line_no") < F.col("__first"))
    each = rows.groupBy("doc_id").agg(_joined(F.when(body, F.col("text"))).alias("b"), _joined(F.when(F.coalesce(here, F.lit(False)), F.col("text"))).alias("c"))
    text = lambda c: F.array_join(c, "\n")
    big = (F.length(text(F.col("c"))) >= TOO_LONG * F.length(text(F.col("b")))) & (F.size("c") > 0)
    return each.select("doc_id", text(F.col("b")).alias("body"), F.when(big, text(F.col("c"))).otherwise(text(D.without_junk(F.col("c")))).alias("cite"), big.alias("oversized"))


def _joined(text: Column) -> Column:
    """Aggregate: the texts that aren't null, in the order of line_no."""
    return F.transform(F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line_no", text.alias("x"))))), lambda s: s["x"])


def reference_lines(lines: DataFrame, order: list[str]) -> DataFrame:
    """Laid-out lines (doc_id, text, and the columns of order) of the reference section: behind the last heading of references, before
    the first following section. A section of 0.8 / 1.8 of the document's characters or more is dropped. All columns stay."""
    w = _doc().orderBy(*order)
    rows = lines.withColumn("__i", F.row_number().over(w))
    rows = rows.withColumn("__head", F.max(F.when(F.col("text").rlike(D.HEADING), F.col("__i"))).over(_doc()))
    rows = rows.withColumn("__end", F.min(F.when((F.col("__i") > F.col("__head") + 1) & F.col("text").rlike(D.TAIL), F.col("__i"))).over(_doc()))
    inside = (F.col("__i") > F.col("__head")) & F.coalesce(F.col("__i") < F.col("__end"), F.lit(True))
    size = F.sum(F.when(inside, F.length("text") + 1)).over(_doc())
    return rows.withColumn("__ok", inside & (1.8 * size < 0.8 * F.sum(F.length("text") + 1).over(_doc()))).filter("__ok").drop("__i", "__head", "__end", "__ok")


def reference_lines_by_count(lines: DataFrame) -> DataFrame:
    """doc_id, body_lines, reference_lines: the last heading of references parts them; references of 0.8 of the body's lines
    or more count as none."""
    rows = lines.withColumn("__i", F.row_number().over(_doc().orderBy("line_no")))
    out = rows.groupBy("doc_id").agg(F.max(F.when(F.col("text").rlike(D.HEADING), F.col("__i"))).alias("h"), F.count("*").alias("n"))
    refs = F.when(F.col("n") - F.col("h") < TOO_LONG * F.col("h"), F.col("n") - F.col("h")).otherwise(0)
    return out.select("doc_id", (F.col("n") - F.coalesce(refs, F.lit(0))).cast("long").alias("body_lines"), F.coalesce(refs, F.lit(0)).cast("long").alias("reference_lines"))


def position_map(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, norm_no, orig_no, word: for every word of normal_body(text) the word of the text that it comes from. A word
    broken by a hyphen at a line's end is its first half's; all numbers of an expanded range are their bracket's. All within
    the document's row, in time linear in its words."""
    # the original's words; a break within a normalised word leaves a continuation, a bracket with a range is taken whole
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^[\x09\x0B-\x0D\x20]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n+", "\n"), r"([A-Za-z])-\n", "$1\u0000")
    flat = F.trim(F.regexp_replace(t, X.BLANK, " "))
    unit = r"(?:[^\x09-\x0D\x20\[]++|\[[0-9]+(?:[,;-]\x20*[0-9]+)*\]|\[)++"
    # of each unit how many original words it has, and the words it becomes
    made = lambda raw: X.tokens(D.expand_ranges(F.replace(raw, F.lit("\u0000"), F.lit(""))))
    units = F.transform(F.regexp_extract_all(flat, F.lit(unit), 0), lambda raw: F.struct(F.size(F.regexp_extract_all(raw, F.lit(r"[^\x20\x00]+"), 0)).alias("n"), made(raw).alias("made")))

    def words(units: Column) -> Column:
        # a mark before each unit's original words: the place of the mark u, less the u marks before it, is where they begin
        marks = F.flatten(F.transform(units, lambda x: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), x["n"]))))
        first = F.filter(F.transform(marks, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())
        return let(first, lambda first: F.flatten(F.transform(units, lambda x, u: let(F.get(first, u) - u, lambda at: let(F.size(x["made"]) == x["n"], lambda kept: F.transform(x["made"], lambda w, j: F.struct((at + F.when(kept, j).otherwise(0)).cast("int").alias("orig_no"), w.alias("word"))))))))

    # words of a unit that nothing was done to keep their places
    return docs.select("doc_id", F.posexplode(let(units, words)).alias("norm_no", "w")).select("doc_id", "norm_no", "w.orig_no", "w.word")


def keyword_features(lines: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """lines with keywords: a map from each tag to tag-word, or none: whether the line's first word, outer punctuation off and digits
    as 0, is in the tag's list. keywords: tag, word; a few lists, so they are gathered into one row."""
    lists = keywords.groupBy("tag").agg(F.array_sort(F.collect_set("word")).alias("words")).agg(F.array_sort(F.collect_list(F.struct("tag", "words"))).alias("__lists"))
    tok = F.coalesce(F.get(X.tokens(F.col(text)), F.lit(0)), F.lit(""))
    tok = F.regexp_replace(F.regexp_replace(F.regexp_replace(tok, r"^\p{P}+", ""), r"\p{P}+$", ""), "[0-9]", "0")
    made = let(tok, lambda t: F.map_from_entries(F.transform("__lists", lambda k: F.struct(k["tag"], F.when(F.array_contains(k["words"], t), F.concat(k["tag"], F.lit("-"), t)).otherwise("none")))))
    return lines.crossJoin(F.broadcast(lists)).withColumn("keywords", made).drop("__lists")  # one row


def sub_words(word: Column) -> Column:
    """A word's parts: runs of word characters, hyphens and bars; runs of separators , . : ; |; and what is left, which may
    be a signal."""
    return F.regexp_extract_all(word, F.lit(rf"[{X.W}|-]+|[,.:;]+|[^{X.W}|,.:;\x09-\x0D\x20-]+"), 0)


def author_tokens(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, text) to a row a part of a word, with its features: content, lower, bare_lower (lower if nothing
    is left), length_class, place (begin: the first of its line)."""
    parts = F.flatten(F.transform(X.tokens(F.col("text")), sub_words))
    rows = lines.select("doc_id", "line_no", F.posexplode(parts).alias("tok_no", "content"))
    low = F.lower("content")
    only = F.lower(F.regexp_replace("content", f"[^{X.W}]", ""))
    n = F.length("content")
    return rows.withColumns({"lower": low, "bare_lower": F.when(only == "", low).otherwise(only), "length_class": F.when(n < 4, F.concat(n.cast("string"), F.lit("-char"))).otherwise("4+char"), "place": F.when(F.col("tok_no") == 0, "begin").otherwise("continue")})


def format_changes(tokens: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """tokens with format: fbegin where any of the columns differs from the token before in the document, else fcontinue."""
    here = F.struct(*columns)
    return tokens.withColumn("format", F.when(F.lag(here).over(_doc().orderBy(*order)) == here, "fcontinue").otherwise("fbegin"))


def author_groups(tokens: DataFrame, order: str = "tok_no") -> DataFrame:
    """Author names of tokens (doc_id, order, tok, and geometry): doc_id, author_no, name, and every other column of the name's
    first token. A name ends at &, and, a comma or a semicolon of its own, or with a token of two or more that ends in a comma."""
    w = _doc().orderBy(order)
    cut = F.lower("tok").isin("&", "and", ",", ";")
    rows = tokens.withColumn("__cut", cut).withColumn("__block", F.sum(cut.cast("int")).over(w)).filter("not __cut")
    # within a block a first token never closes a name, nor does one right behind a closed name
    lone = Window.partitionBy("doc_id", "__block").orderBy(order)
    comma = F.col("tok").endswith(",")
    rows = rows.withColumn("__comma", comma).withColumn("__run", F.row_number().over(lone) - F.sum(F.col("__comma").cast("int")).over(lone))
    streak = Window.partitionBy("doc_id", "__block", "__run").orderBy(order)
    # tokens that end in commas follow each other: every second of them closes, beginning with the one that another precedes
    first = F.lag("__comma").over(lone).isNull()
    nth = F.row_number().over(streak) - F.when(F.first("__comma").over(streak), 0).otherwise(1)
    rows = rows.withColumn("__first", first).withColumn("__nth", nth).withColumn("__led", F.first(F.col("__comma") & F.col("__first")).over(streak))
    closes = F.col("__comma") & (F.when(F.col("__led"), F.col("__nth") % 2 == 0).otherwise(F.col("__nth") % 2 == 1))
    rows = rows.withColumn("__closes", closes).withColumn("__name", F.coalesce(F.sum(F.col("__closes").cast("int")).over(lone.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rest = [c for c in tokens.columns if c not in ("doc_id", "tok")]
    each = rows.groupBy("doc_id", "__block", "__name").agg(D.joined(order, "tok", " ").alias("name"), *[F.min_by(c, order).alias(c) for c in rest if c != order], F.min(order).alias(order))
    return each.withColumn("author_no", F.row_number().over(_doc().orderBy(order)) - 1).drop("__block", "__name")


def heading_kinds(lines: DataFrame, kinds: DataFrame) -> DataFrame:
    """lines with generic: the kind of a heading at the line it begins; other lines null. kinds: doc_id, line_no, kind, a row for each
    heading. related_works is written related_work. A kind at a line that isn't a sectionHeader is an error."""
    k = kinds.select("doc_id", "line_no", F.when(F.col("kind").isin("related-works", "related_works", "related work"), "related_work").otherwise(F.regexp_replace("kind", "-", " ")).alias("generic"))
    out = lines.join(k, ["doc_id", "line_no"], "left")
    wrong = F.col("generic").isNotNull() & ~F.col("label").eqNullSafe("sectionHeader")
    return out.withColumn("generic", F.when(wrong, F.raise_error(F.concat(F.lit("no heading at line "), F.col("line_no").cast("string"))).cast("string")).otherwise(F.col("generic")))


def same_count(cites: DataFrame, parsed: DataFrame) -> DataFrame:
    """parsed, if every document has as many rows there as in cites (doc_id, cite_no); an error at the first other one."""
    n = cites.groupBy("doc_id").agg(F.count("*").alias("__a")).join(parsed.groupBy("doc_id").agg(F.count("*").alias("__b")), "doc_id", "full")
    bad = ~F.col("__a").eqNullSafe(F.col("__b"))
    n = n.select("doc_id", F.when(bad, F.raise_error(F.concat(F.lit("citations and parsed rows differ in document "), F.col("doc_id").cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
    return parsed.join(n, "doc_id").filter("__ok").drop("__ok")


def tagged_header_lines(headers: DataFrame) -> DataFrame:
    """headers (doc_id, text) of <tag> line +L+ line +L+ </tag> as rows doc_id, row_no, text: a //tag row before each field,
    then its lines, which keep their +L+."""
    fields = F.regexp_extract_all("text", F.lit(r"<([A-Za-z]+)>[^<]*</[A-Za-z]+>"), 0)

    def rows(s: Column) -> Column:
        inner = F.regexp_replace(s, "^<[A-Za-z]+>|</[A-Za-z]+>$", "")
        lines = F.filter(F.transform(F.split(inner, r"(?<=\+L\+)", -1), lambda x: F.trim(x)), lambda x: x != "")
        return F.concat(F.array(F.concat(F.lit("//"), F.regexp_extract(s, "^<([A-Za-z]+)>", 1))), lines)

    return headers.select("doc_id", F.posexplode(F.flatten(F.transform(fields, rows))).alias("row_no", "text"))
