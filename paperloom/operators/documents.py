"""Documents as lines, tokens, runs and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical as X
from ..functions.normalize import let

_NAMES = ["Bibliography", "Literature Cited", "Reference", "References", "References Cited", "References and Notes", "References and Note"]
_FOLLOWING = ["Annex", "Appendix", "Acknowledgement", "Acknowledgment", "Autobiographical", "Exhibit", "Fig", "Note", "Table"]
#: A line that ends in a heading of references, in title case or capitals
HEADING = r"(?:^|[^\p{L}\p{N}_])(?:" + "|".join(x.replace(" ", r"\x20+") for n in _NAMES for x in (n, n.upper())) + r"):?[\x09-\x0D\x20]*$"
#: A line that begins another section, perhaps numbered
TAIL = r"^[\x09-\x0D\x20\d.]*(?:" + "|".join(_FOLLOWING) + ")"
TOO_LONG = 0.8


def canonical_eol(text: Column) -> Column:
    """Every carriage return as a line feed."""
    return F.replace(text, F.lit("\r"), F.lit("\n"))


def lines_of(docs: DataFrame, blanks: bool = False) -> DataFrame:
    """doc_id, line_no (of the physical line, from 0), text; blank lines only if asked for."""
    out = docs.select("doc_id", F.posexplode(X.lines(F.coalesce("text", F.lit("")))).alias("line_no", "text"))
    return out if blanks else out.filter(~X.is_blank(F.col("text")))


def tokens_of(docs: DataFrame) -> DataFrame:
    """doc_id, tok_no, tok, n (tokens of the document)."""
    toks = docs.select("doc_id", X.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    return toks.select("doc_id", F.size("t").alias("n"), F.posexplode("t").alias("tok_no", "tok"))


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_blank: without leaving the row."""
    all_ = X.lines(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", F.size(F.filter(all_, lambda x: ~X.is_blank(x))).cast("long").alias("n_lines"), F.size(F.filter(all_, X.is_blank)).cast("long").alias("n_blank"))


def header_part(lines: DataFrame) -> DataFrame:
    """Lines before the first that holds the word introduction; comments go."""
    stop = lines.filter(F.lower("text").contains("introduction")).groupBy("doc_id").agg(F.min("line_no").alias("stop"))
    stop = stop.withColumnRenamed("stop", "__stop")
    return lines.join(stop, "doc_id", "left").filter((F.col("__stop").isNull() | (F.col("line_no") < F.col("__stop"))) & ~F.startswith("text", F.lit("#"))).drop("__stop")


def presegmented(lines: DataFrame) -> DataFrame:
    """References of a file in which blank lines part them: doc_id, cite_no, raw. The last one needs no blank line."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    group = lines.withColumn("g", F.sum(X.is_blank(F.col("text")).cast("int")).over(w)).filter(~X.is_blank(F.col("text")))
    out = group.groupBy("doc_id", "g").agg(joined("line_no", "text", " ").alias("raw"))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1).alias("cite_no"), "raw")


def joined(order: str, text: str, sep: str) -> Column:
    """Aggregate: texts of a group in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), sep)


def runs(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """rows with run_no: maximal runs of equal labels within a key."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce((F.lag(label).over(w) != F.col(label)).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("run_no", F.sum("__new").over(w)).drop("__new")


def first_per_tag(rows: DataFrame, key: str, tag: str, order: str, value: str) -> DataFrame:
    """The first value of each tag; later ones are ignored."""
    return rows.groupBy(key, tag).agg(F.min_by(value, order).alias(value))


def reference_split(docs: DataFrame) -> DataFrame:
    """doc_id, body, cite, oversized. The last heading line parts body (with it) and references; a following section ends
    them. oversized: references of 0.8 of the body or more; they are returned all the same."""
    none = F.array().cast("array<string>")

    def regions(l: Column) -> Column:
        at = F.array_max(F.transform(l, lambda x, i: F.when(x.rlike(HEADING), i)))
        return let(at, lambda h: let(F.when(h.isNull(), none).otherwise(F.slice(l, h + 2, F.greatest(F.size(l) - h - 1, F.lit(0)))), lambda rest: with_rest(l, h, rest)))

    def with_rest(l: Column, h: Column, rest: Column) -> Column:
        end = F.array_min(F.transform(rest, lambda x, i: F.when(x.rlike(TAIL) & (i > 0), i)))
        cut = let(end, lambda e: F.when(e.isNotNull(), F.slice(rest, F.lit(1), e)).otherwise(rest))
        body = F.array_join(F.when(h.isNull(), l).otherwise(F.slice(l, F.lit(1), h + 1)), "\n")
        return let(F.struct(body.alias("body"), F.array_join(rest, "\n").alias("whole"), F.array_join(cut, "\n").alias("part")), chosen)

    def chosen(r: Column) -> Column:
        big = F.length(r["whole"]) >= TOO_LONG * F.length(r["body"])
        cite = F.when(big | is_blank_text(r["part"]), r["whole"]).otherwise(r["part"])
        return F.struct(r["body"].alias("body"), cite.alias("cite"), (big & (F.length(r["whole"]) > 0)).alias("oversized"))

    return docs.select("doc_id", let(F.split(canonical_eol(F.coalesce("text", F.lit(""))), "\n", -1), regions).alias("r")).select("doc_id", "r.*")


def is_blank_text(text: Column) -> Column:
    return ~text.rlike(r"[^\x09-\x0D\x20]")


def without_junk(lines: Column) -> Column:
    """Reference lines trimmed; blank ones go, and lines of digits unless the line before ended in a hyphen."""
    t = F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", ""))
    marked = let(t, lambda t: F.transform(t, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(t, i - 1)).otherwise("").alias("before"))))
    return F.transform(F.filter(marked, lambda m: (m["x"] != "") & ~(m["x"].rlike("^[0-9]+$") & ~m["before"].endswith("-"))), lambda m: m["x"])


def merged(lines: Column) -> Column:
    """Lines as one text: a hyphen after a letter joins and goes, another hyphen joins and stays, else a space."""
    t = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$", "")), "\n")
    t = F.regexp_replace(t, r"([A-Za-z])-\n", "$1")
    return F.trim(F.replace(F.regexp_replace(t, r"-\n", "-"), F.lit("\n"), F.lit(" ")))


MARKERS = {"SQUARE": r"\[.+?\]", "PAREN": r"\(.+?\)", "NAKEDNUM": "[0-9]+ ", "NAKEDNUMDOT": r"[0-9]+\."}


def marker_vote(cite: Column) -> Column:
    """The kind of marker at the beginning of most lines: at least one, and a sixth of the lines; UNKNOWN otherwise. Ties go
    in the order of MARKERS."""
    t = F.concat(F.lit("\n"), cite)
    counts = F.array(*[F.size(F.regexp_extract_all(t, F.lit(rf"\n[\x09-\x0D\x20]*{p}[^\n]{{10}}"), 0)) for p in MARKERS.values()], F.size(F.split(cite, "\n", -1)))

    def kind(c: Column) -> Column:
        top = F.greatest(*[c[i] for i in range(len(MARKERS))])
        out = F.when((top < 1) | (top * 6 < c[len(MARKERS)]), "UNKNOWN")
        for i, k in enumerate(MARKERS):
            out = out.when(c[i] == top, k)
        return out

    return let(counts, kind)


def split_by_marker(refs: DataFrame) -> DataFrame:
    """refs (doc_id, cite) to doc_id, cite_no, marker_type, marker, raw. Lines before the first marker are one citation."""
    rows = refs.withColumn("kind", marker_vote(F.col("cite"))).filter("kind != 'UNKNOWN'")
    rows = rows.select("doc_id", "kind", F.posexplode(F.split("cite", "\n", -1)).alias("no", "line"))
    mark = None
    for k, p in MARKERS.items():
        m = F.regexp_extract("line", rf"^[\x09-\x0D\x20]*({p.strip()})", 1)
        mark = F.when(F.col("kind") == k, m) if mark is None else mark.when(F.col("kind") == k, m)
    rows = rows.withColumn("m", F.nullif(mark, F.lit("")))
    w = Window.partitionBy("doc_id").orderBy("no")
    rows = rows.withColumn("g", F.count("m").over(w)).withColumn("line", F.when(F.col("m").isNull(), F.col("line")).otherwise(F.expr("ltrim(substr(ltrim(line), length(m) + 1))")))
    out = rows.groupBy("doc_id", "kind", "g").agg(F.max("m").alias("marker"), merged(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])).alias("raw")).filter("raw != ''")
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1).alias("cite_no"), F.col("kind").alias("marker_type"), "marker", "raw")


YEAR = r"(?:^|[^\p{L}\p{N}_])\(?[12][0-9]{3}[a-z]?(?:$|[^\p{L}\p{N}_])"


def split_unmarked(refs: DataFrame) -> DataFrame:
    """refs (doc_id, l: lines without markers) to doc_id, cite_no, raw: cut where a citation seems to begin.

    A line with an upper-case letter is a boundary behind a line of less than two characters; behind lines of authors (no
    digits, three separators or more), of which the first that follows a full stop then begins the citation; or behind a line
    that ends a sentence (not in an initial), unless it begins with four digits. A line with a year confirms the last boundary up
    to it, or the section's beginning; each confirmed one begins a citation. Windows by document; every line is looked at once.
    """
    w = Window.partitionBy("doc_id").orderBy("no")
    line = F.col("line")
    rows = refs.select("doc_id", F.posexplode("l").alias("no", "line"))
    authors = ~line.rlike("[0-9]") & (F.length(line) - F.length(F.translate(line, ",;", "")) >= 3)
    rows = rows.select("doc_id", "no", "line", F.lag("line").over(w).alias("prev"), authors.alias("authors"), F.sum((~authors).cast("int")).over(w).alias("block"))
    begins = F.when(F.col("authors") & F.col("prev").rlike(r"\.[\x09-\x0D\x20]*$"), F.col("no"))
    in_block = Window.partitionBy("doc_id", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("list", F.when(F.col("authors"), F.min(begins).over(in_block)))
    upper = line.rlike(r"\p{Lu}") & (F.col("no") > 0)
    sentence = F.col("prev").rlike(r"[^.][^\n]\.[\x09-\x0D\x20]*$") & ~line.rlike("^[0-9]{4}")
    rows = rows.withColumn("list", F.lag("list").over(w))
    at = F.when(upper & (F.length("prev") < 2), F.col("no")).when(upper & F.col("list").isNotNull(), F.col("list")).when(upper & sentence, F.col("no"))
    start = F.coalesce(F.last(at, ignorenulls=True).over(w), F.lit(0))
    confirmed = F.max(F.when(line.rlike(YEAR), F.col("start"))).over(w)  # never goes back
    rows = rows.withColumn("start", start).withColumn("confirmed", confirmed)
    starts = rows.filter("confirmed is not null").select("doc_id", F.col("confirmed").alias("no"), F.lit(1).alias("first")).distinct()
    rows = rows.select("doc_id", "no", "line").join(starts, ["doc_id", "no"], "left").withColumn("g", F.count("first").over(w))
    out = rows.groupBy("doc_id", "g").agg(merged(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])).alias("raw")).filter("raw != ''")
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1).alias("cite_no"), "raw")


def expand_ranges(text: Column) -> Column:
    """Number ranges in square brackets written out: [1, 3-5] as [1, 3, 4, 5]. Every range of a bracket is expanded; ranges
    of more than 1,000 or that don't rise stay."""
    bracket = r"\[[0-9]+(?:[,;-]\x20*[0-9]+)*\]"

    def item(x: Column) -> Column:
        a, b = F.regexp_extract(x, "^([0-9]+)-([0-9]+)$", 1).try_cast("int"), F.regexp_extract(x, "^([0-9]+)-([0-9]+)$", 2).try_cast("int")
        return F.when(F.coalesce((b > a) & (b - a <= 1000), F.lit(False)), F.array_join(F.transform(F.sequence(a, F.greatest(a, b)), lambda k: k.cast("string")), ", ")).otherwise(x)

    def one(h: Column) -> Column:
        return F.when(~h.contains("-"), h).otherwise(F.concat(F.lit("["), F.array_join(F.transform(F.split(F.regexp_replace(h, r"[\[\]]", ""), r"[,;]\x20*", -1), item), ", "), F.lit("]")))

    hits, pieces = F.regexp_extract_all(text, F.lit(bracket), 0), F.split(text, bracket, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(F.when(i > 0, one(F.get(hits, i - 1))).otherwise(""), p)), "")


def normal_body(text: Column) -> Column:
    """Body text as contexts are searched in: lines trimmed at the left, broken words joined, blanks collapsed, ranges
    written out."""
    t = F.regexp_replace(text, r"(?m)^[\x09\x0B-\x0D\x20]+", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\n+", "\n"), r"([A-Za-z])-\n", "$1")
    return expand_ranges(F.trim(F.regexp_replace(t, X.BLANK, " ")))


def valid_citation() -> Column:
    """Whether parsed fields make a citation. Expects authors, title, date, journal, booktitle, raw."""
    venue = F.coalesce("journal", "booktitle").isNotNull()
    a, t, d = (F.col(c).isNotNull() for c in ("authors", "title", "date"))
    return d & (F.length("raw") <= 400) & ((a & (t | d)) | (venue & d) | t)
