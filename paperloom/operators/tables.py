"""Operators on rows: dictionaries, keyword mining, windows over layout, matching, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexical import let

BITS = {"male": 1, "female": 2, "last": 4, "month": 8, "place": 16, "publisher": 32}


def gazetteer(words: DataFrame) -> DataFrame:
    """words (word, mask) to one row a word with all its bits."""
    return words.groupBy("word").agg(F.bit_or("mask").cast("int").alias("mask"))


def with_gazetteer(tokens: DataFrame, gaz: DataFrame, word: str = "word") -> DataFrame:
    """tokens with mask (0: unknown) and a yes or no column for each bit. The planner broadcasts gaz if it is small."""
    out = tokens.join(gaz, word, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    return out.withColumns({f"is_{k}": F.when(F.col("mask").bitwiseAND(b) > 0, "yes").otherwise("no") for k, b in BITS.items()})


def top_words(counts: DataFrame, tag: str, word: str, n: str, k: int) -> DataFrame:
    """The k most frequent words of each tag; ties by word."""
    w = Window.partitionBy(tag).orderBy(F.desc(n), word)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def exclusive(top: DataFrame, tag: str, word: str) -> DataFrame:
    """Rows whose word is in one tag's list only."""
    one = top.groupBy(word).agg(F.count_distinct(tag).alias("tags")).filter("tags = 1").select(word)
    return top.join(one, word, "left_semi")


def changes(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each column whether it goes on from the row before (continue) or not (new); the first row is new."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumns({f"{c}_diff": F.when(F.lag(c).over(w) == F.col(c), "continue").otherwise("new") for c in columns})


def section_breaks(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """section: counts the rows at which any column changes."""
    w = Window.partitionBy(key).orderBy(*order)
    here = F.struct(*columns)
    return rows.withColumn("__new", F.coalesce((F.lag(here).over(w) != here).cast("int"), F.lit(0))).withColumn("section", F.sum("__new").over(w)).drop("__new")


def gap_breaks(rows: DataFrame, key: str, order: list[str], left: str, right: str, factor: float = 5.0) -> DataFrame:
    """sequence: a new one begins where the gap to the row before is over factor times the gap before that."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("__gap", F.col(left) - F.lag(right).over(w))
    rows = rows.withColumn("__new", F.coalesce((F.col("__gap") > factor * F.lag("__gap").over(w)).cast("int"), F.lit(0)))
    return rows.withColumn("sequence", F.sum("__new").over(w)).drop("__new", "__gap")


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str | Column) -> DataFrame:
    """The value with the most weight in each group; ties: the larger value."""
    w = F.sum(weight if isinstance(weight, Column) else F.col(weight))
    each = rows.groupBy(*keys, value).agg(w.alias("w"))
    return each.groupBy(*keys).agg(F.max(F.struct("w", value)).alias("m")).select(*keys, F.col(f"m.{value}").alias(value), F.col("m.w").alias("weight"))


def mode_of(values: Column, kind: str) -> Column:
    """The most frequent value of an array; ties: the larger value. kind: the type of its values."""
    none = F.lit(None).cast(kind)

    def step(a: Column, x: Column) -> Column:
        n = F.when(x.eqNullSafe(a["x"]), a["n"] + 1).otherwise(1)
        return let(n, lambda n: F.when(n >= a["top"], F.struct(x.alias("x"), n.alias("n"), x.alias("best"), n.alias("top"))).otherwise(F.struct(x.alias("x"), n.alias("n"), a["best"].alias("best"), a["top"].alias("top"))))

    start = F.struct(none.alias("x"), F.lit(0).alias("n"), none.alias("best"), F.lit(0).alias("top"))
    return F.aggregate(F.sort_array(values), start, step, lambda a: a["best"])


def vertical_bins(rows: DataFrame, key: str, position: str, bins: int = 8) -> DataFrame:
    w = Window.partitionBy(key)
    rows = rows.filter(F.col(key).isNotNull()).withColumns({"__lo": F.min(position).over(w), "__hi": F.max(position).over(w)})
    return rows.withColumn("bin", F.floor((F.col(position) - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo") + 1)).cast("int")).drop("__lo", "__hi")


def nearest(left: DataFrame, right: DataFrame, key: str, x: str, y: str, right_id: str, left_id: str, distance: str = "distance") -> DataFrame:
    """For each row of left the row of right with the same key whose y is nearest to x; ties: the smallest right_id.

    An ordered merge instead of all pairs: per key both sides are put in one order, and each row looks to the last and
    the next row of the other side.
    """
    a = left.select(key, F.col(x).alias("v"), F.lit(1).alias("side"), F.col(left_id).alias("lid"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("rid"))
    b = right.groupBy(key, F.col(y).alias("v")).agg(F.min(right_id).alias("rid")).select(key, "v", F.lit(0).alias("side"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias("lid"), "rid")
    both = a.unionByName(b)
    hit = F.when(F.col("side") == 0, F.struct("v", "rid"))
    up, down = Window.partitionBy(key).orderBy("v", "side"), Window.partitionBy(key).orderBy(F.desc("v"), "side")
    both = both.withColumn("below", F.last(hit, ignorenulls=True).over(up)).withColumn("above", F.last(hit, ignorenulls=True).over(down)).filter("side = 1")
    cand = lambda c: F.struct(F.abs(F.col("v") - F.col(f"{c}.v")).alias("d"), F.col(f"{c}.rid").alias("rid"))
    best = F.array_min(F.filter(F.array(F.when(F.col("below").isNotNull(), cand("below")), F.when(F.col("above").isNotNull(), cand("above"))), lambda c: c.isNotNull()))
    return both.withColumn("best", best).filter("best is not null").select(key, F.col("lid").alias(left_id), F.col("best.rid").alias(right_id), F.col("best.d").alias(distance))


def signal_match(author: Column, affiliation: Column) -> Column:
    """Whether an author's signals hold the affiliation's first; empty ones never match."""
    a, b = (F.filter(c, lambda s: s != "") for c in (author, affiliation))
    return F.when((F.size(b) > 0) & F.array_contains(a, F.try_element_at(b, F.lit(1))), "same").otherwise("diff")


def folds(rows: DataFrame, order: str, k: int) -> DataFrame:
    """row (number, from 0) and fold (row mod k), in the order of a unique number column.

    Numbered within ranges of about equal numbers of rows, whatever the column's values: their bounds are approximate
    quantiles, at most 1,023, so no task holds all rows; then each range's rows are counted, and only these counts meet in one place.
    """
    parts = min(1024, max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    bounds = rows.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)])).first()[0] or []
    part = F.size(F.filter(F.lit(sorted(set(bounds))) if bounds else F.array().cast("array<long>"), lambda b: b <= F.col(order)))
    rows = rows.withColumn("__part", part)
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__part", before.alias("__before"))  # a row for each range
    out = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1).join(F.broadcast(counts), "__part")
    return out.withColumn("row", F.col("__before") + F.col("__i")).withColumn("fold", F.pmod("row", F.lit(k)).cast("int")).drop("__part", "__i", "__before")


def confusion(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    return rows.groupBy(gold, guess).agg(F.count("*").alias("n"))


def scores(rows: DataFrame, gold: str, guess: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of single-row chunks; 0 where a ratio isn't defined."""
    c = confusion(rows, gold, guess)
    each = c.select(F.explode(F.array(F.struct(F.col(gold).alias("label"), F.when(F.col(gold) == F.col(guess), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col(gold) != F.col(guess), F.col("n")).otherwise(0).alias("fn")), F.struct(F.col(guess).alias("label"), F.lit(0).cast("long").alias("tp"), F.when(F.col(gold) != F.col(guess), F.col("n")).otherwise(0).cast("int").alias("fp"), F.lit(0).cast("long").alias("fn")))).alias("x")).select("x.*")
    t = each.groupBy("label").agg(*[F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn")])
    return rates(t)


def rates(t: DataFrame) -> DataFrame:
    p, r = (F.coalesce(F.try_divide("tp", F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    t = t.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6))
    return t.withColumn("f1", F.round(F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 6))


def chunks(rows: DataFrame, key: str, order: str, tag: str) -> DataFrame:
    """Chunks of B-, I-, E- and O tags: key, type, begin, end. An I- of another type than before begins a chunk."""
    w = Window.partitionBy(key).orderBy(order)
    kind = F.when(F.col(tag) == "O", None).otherwise(F.regexp_replace(tag, "^[A-Z]-", ""))
    rows = rows.select(F.col(key), F.col(order), kind.alias("__kind"), F.substring(tag, 1, 1).alias("__head"))
    new = F.col("__kind").isNotNull() & ((F.col("__head") == "B") | ~F.lag("__kind").over(w).eqNullSafe(F.col("__kind")) | F.coalesce(F.lag("__head").over(w) == "E", F.lit(False)))
    rows = rows.withColumn("__c", F.sum(new.cast("int")).over(w)).filter("__kind is not null")
    return rows.groupBy(key, "__c").agg(F.first("__kind").alias("type"), F.min(order).alias("begin"), F.max(order).alias("end")).drop("__c")


def chunk_scores(rows: DataFrame, key: str, order: str, gold: str, guess: str) -> DataFrame:
    """label (chunk type), tp, fp, fn, precision, recall, f1 by whole chunks."""
    a = chunks(rows, key, order, gold).withColumn("g", F.lit(1))
    b = chunks(rows, key, order, guess).withColumn("s", F.lit(1))
    both = a.join(b, [key, "type", "begin", "end"], "full").groupBy(F.col("type").alias("label"))
    return rates(both.agg(F.count(F.when(F.col("g").isNotNull() & F.col("s").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("s").isNull(), 1)).alias("fn")))


def group_argmax(rows: DataFrame, key: str | Column, score: str, value: str) -> DataFrame:
    """The value with the best score of each group; ties: the smallest value."""
    k = key if isinstance(key, Column) else F.col(key)
    return rows.groupBy(k.alias("grp")).agg(F.max_by(value, F.struct(F.col(score), -F.col(value))).alias(value), F.max(score).alias(score))


def tag_statistics(pages: DataFrame, html: str) -> DataFrame:
    """tag, attr, value, n of all attributes of opening tags."""
    tags = pages.select(F.explode(F.regexp_extract_all(html, F.lit(r"<[a-zA-Z][a-zA-Z0-9]*\x20[^<>]*>"), 0)).alias("t"))
    tags = tags.select(F.lower(F.regexp_extract("t", "^<([a-zA-Z][a-zA-Z0-9]*)", 1)).alias("tag"), F.explode(F.regexp_extract_all("t", F.lit(r"[a-zA-Z-]+=\"[^\"]*\""), 0)).alias("a"))
    out = tags.select("tag", F.lower(F.regexp_extract("a", "^([a-zA-Z-]+)=", 1)).alias("attr"), F.regexp_extract("a", '="([^"]*)"', 1).alias("value"))
    return out.groupBy("tag", "attr", "value").agg(F.count("*").alias("n"))


def address_filter(rows: DataFrame, key: str, order: str, label: str) -> DataFrame:
    """Author and affiliation rows, and address rows whose last other label was affiliation."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(label) != "address", F.col(label)), ignorenulls=True).over(w)
    return rows.withColumn("__last", last).filter((F.col(label).isin("author", "affiliation")) | ((F.col(label) == "address") & (F.col("__last") == "affiliation"))).drop("__last")


def signal_fanout(rows: DataFrame, key: str, order: str, kind: str, value: str) -> DataFrame:
    """Signals after a group of authors go to each author of it: key, author, signal."""
    w = Window.partitionBy(key).orderBy(order)
    start = ((F.col(kind) == "author") & (F.coalesce(F.lag(kind).over(w), F.lit("signal")) == "signal")).cast("int")
    rows = rows.select(F.col(key), F.col(order), F.col(kind), F.col(value), start.alias("__start")).withColumn("__g", F.sum("__start").over(w))
    a = rows.filter(F.col(kind) == "author").select(key, "__g", F.col(value).alias("author"))
    b = rows.filter(F.col(kind) == "signal").select(key, "__g", F.col(value).alias("signal"))
    return a.join(b, [key, "__g"]).drop("__g")
