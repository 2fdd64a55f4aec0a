"""Where references are cited. Mentions are found once per document and joined by key, instead of once per reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import let

RADIUS, MOST = 600, 10
BRACKET = r"[\[(][\p{L}\p{N}.+'-]+(?:[,;]\x20*[\p{L}\p{N}.+'-]+)*[\])]"
AUTHOR_YEAR = r"\p{Lu}[\p{L}'-]+(?:,?\x20(?:and|&)\x20\p{Lu}[\p{L}'-]+|\x20et\x20al\.?)?,?\x20\(?[12][0-9]{3}[a-z]?\)?"


def mentions(bodies: DataFrame) -> DataFrame:
    """doc_id, key, kind, start, end (characters), hit of all bracketed keys and author-year mentions of doc_id, body."""

    def of(pattern: str, kind: str) -> DataFrame:
        rows = bodies.select("doc_id", F.regexp_extract_all("body", F.lit(pattern), 0).alias("h"), F.split("body", pattern, -1).alias("p"))
        # offsets by a running sum over the matches of a document, as rows
        rows = rows.filter(F.size("h") > 0).select("doc_id", F.posexplode(F.arrays_zip("h", F.slice("p", F.lit(1), F.size("h")).alias("p"))).alias("i", "x"))
        from pyspark.sql import Window

        w = Window.partitionBy("doc_id").orderBy("i")
        end = F.sum(F.length("x.h") + F.length("x.p")).over(w)
        return rows.select("doc_id", F.col("x.h").alias("hit"), end.alias("end"), (end - F.length("x.h")).alias("start"), F.lit(kind).alias("kind"))

    b = of(BRACKET, "bracket")
    inner = F.regexp_replace("hit", r"^[\[(]|[\])]$", "")
    b = b.select("doc_id", "hit", "start", "end", "kind", F.explode(F.array_distinct(F.split(inner, r"[,;]\x20*", -1))).alias("key")).withColumn("key", F.concat(F.substring("hit", 1, 1), "key"))
    a = of(AUTHOR_YEAR, "author_year")
    name, year = F.regexp_extract("hit", r"^(\p{Lu}[\p{L}'-]+)", 1), F.regexp_extract("hit", r"([12][0-9]{3}[a-z]?)\)?$", 1)
    return b.unionByName(a.select("doc_id", "hit", "start", "end", "kind", F.concat_ws(", ", name, year).alias("key")))


def keys_of(marker: Column, authors: Column, year: Column) -> Column:
    """The keys under which a reference may be cited, best first: a bracketed marker as it is; a number in square
    brackets, then in round ones; else first author's last name and year; else the marker itself."""
    numeric = F.regexp_extract(marker, r"^\(?\[?([0-9]+)[\]).]?\.?", 1)
    bracketed = marker.rlike(r"^[\[(][\p{L}\p{N}+'-]+[\])]")
    last = F.regexp_extract(F.get(authors, F.lit(0)), r"([^\x20]+)$", 1)
    return (
        F.when(bracketed, F.array(F.regexp_replace(marker, r"[\])].*$", "")))
        .when(numeric != "", F.array(F.concat(F.lit("["), numeric), F.concat(F.lit("("), numeric)))
        .when((F.size(authors) > 0) & (year != ""), F.array(F.concat_ws(", ", last, year)))
        .otherwise(F.array(marker))
    )


def contexts(bodies: DataFrame, refs: DataFrame, radius: int = RADIUS, most: int = MOST, parity: bool = False) -> DataFrame:
    """doc_id, cite_no, context, position (end of the mark), cit_str, start_word, end_word.

    bodies: doc_id, body (normalised). refs: doc_id, cite_no, keys (array, best first; the first with any mention counts).
    At most most contexts a reference, whose windows don't overlap; a window is clipped at the body's ends, or with parity
    must fit into it.
    """
    m = mentions(bodies)
    k = refs.select("doc_id", "cite_no", F.posexplode("keys").alias("rank", "key"))
    hits = k.join(m, ["doc_id", "key"]).withColumn("best", F.min("rank").over(_by("doc_id", "cite_no"))).filter("rank = best")
    spot = F.struct("start", "end", "hit")
    per = hits.groupBy("doc_id", "cite_no").agg(F.array_sort(F.collect_list(spot)).alias("spots"))
    if parity:
        per = per.join(bodies.select("doc_id", F.length("body").alias("n")), "doc_id")
        per = per.withColumn("spots", F.filter("spots", lambda s: (s["start"] >= radius) & (s["end"] + radius <= F.col("n"))))
    empty = F.slice(F.col("spots"), 1, 0)
    # greedy: a mark counts if it lies behind the last window
    pick = F.aggregate("spots", F.struct(empty.alias("kept"), F.lit(-1).cast("long").alias("past")), lambda a, s: F.when((s["start"] - radius >= a["past"]) | (a["past"] < 0), F.struct(F.concat(a["kept"], F.array(s)).alias("kept"), (s["end"] + radius).alias("past"))).otherwise(a))
    picked = per.select("doc_id", "cite_no", F.explode(F.slice(pick["kept"], 1, most)).alias("s"))
    # a document's marks in order meet its body in one row: each body is moved once, and its words are counted from mark to mark
    marks = picked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.hit").alias("hit"), "cite_no"))).alias("marks"))
    count = lambda c: F.size(F.filter(F.split(c, r"[\x09-\x0D\x20]+", -1), lambda t: t != ""))
    blank = r"^[\x09-\x0D\x20]"

    def one(x: Column, i: Column) -> Column:
        begin = F.greatest(x["start"] - radius, F.lit(0)).cast("int")
        last = F.when(i > 0, F.get("marks", i - 1)["start"]).otherwise(0)
        # the words that begin between the last mark and this one; a word that runs on from before isn't one of them
        from_ = F.greatest(last - 1, F.lit(0)).cast("int")
        part = F.substr("body", from_ + 1, (x["start"] - from_).cast("int"))
        words = let(part, lambda t: count(t) - ((last > 0) & ~t.rlike(blank) & (t != "")).cast("int"))
        runs_on = ~F.substr("body", x["start"].cast("int"), F.lit(1)).rlike(blank) & (x["start"] > 0)
        text = F.substr("body", begin + 1, (x["end"] + radius - begin).cast("int"))
        return F.struct(x["cite_no"].alias("cite_no"), x["hit"].alias("hit"), x["end"].alias("end"), text.alias("context"), words.alias("words"), runs_on.alias("runs_on"))

    rows = marks.join(bodies.select("doc_id", "body"), "doc_id").select("doc_id", F.posexplode(F.transform("marks", one)).alias("i", "x"))
    before = F.sum("x.words").over(_by("doc_id").orderBy("i")).cast("int")
    hit = F.col("x.hit")
    cit = F.when(~hit.contains("(") & F.endswith(hit, F.lit(")")), F.regexp_replace(hit, r"\)$", "")).otherwise(hit)
    first = before - F.col("x.runs_on").cast("int")
    out = rows.withColumn("first", first)
    return out.select(
        "doc_id", "x.cite_no", "x.context", F.col("x.end").alias("position"), cit.alias("cit_str"),
        F.col("first").alias("start_word"), (F.col("first") + count(hit) - 1).alias("end_word"),
    )


def _by(*c: str):
    from pyspark.sql import Window

    return Window.partitionBy(*c)
