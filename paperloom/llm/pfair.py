"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Each source's documents are put in a pseudo-random order and cut into blocks of block_units characters. Target weights
are rounded to a_s / FRAME. Block i of source s is released at floor((i - 1) / w) and due at ceil(i / w); at every slot the
released block with the earliest deadline runs (ties: the source's rank). All weights sum to one, so every block keeps its
window and no source is ever a block away from its share. As weights are multiples of 1 / FRAME, the schedule repeats
after FRAME slots: it is computed once for FRAME slots by an aggregate expression over one row, and every block finds its
slot by arithmetic and a join with that table of FRAME rows. With more than FRAME sources the frame has two slots for each
of them; that expression's cost grows with the square of the number of sources then.

A source's running length is taken in two levels, over hash buckets and within them, so that a source of any size is
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

FRAME = 1000
BLOCK_UNITS = 1 << 16
BUCKET_ROWS = 20_000
TEMPERATURE = 0.8


def pattern(weights: DataFrame) -> DataFrame:
    """(rank, nth, slot): where block nth (from 0) of each source goes in a frame.

    weights: rank (0, 1, ...), share (positive integers; their sum is the frame's length). A row for each source, at most
    as many as the frame has slots.
    """
    row = weights.agg(F.sort_array(F.collect_list(F.struct("rank", "share"))).alias("s"), F.sum("share").cast("int").alias("frame"))
    # state: blocks done by source, and the slots' sources so far
    state = F.struct(F.transform("s", lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(acc: Column, t: Column) -> Column:
        # deadline of the next block if it is released, as (deadline, rank); integer arithmetic throughout
        due = F.transform("s", lambda x, i: F.when((F.get(acc["done"], i) * F.col("frame") / x["share"]).cast("int") <= t, F.struct((-F.floor(-((F.get(acc["done"], i) + 1) * F.col("frame")) / x["share"])).cast("int").alias("due"), i.alias("at"))))
        best = F.array_min(F.filter(due, lambda d: d.isNotNull()))["at"]
        return F.transform(F.array(best), lambda b: F.struct(F.transform(acc["done"], lambda n, i: F.when(i == b, n + 1).otherwise(n)).alias("done"), F.concat(acc["order"], F.array(b)).alias("order")))[0]

    order = row.select(F.aggregate(F.sequence(F.lit(0), F.col("frame") - 1), state, step)["order"].alias("order"))
    slots = order.select(F.posexplode("order").alias("slot", "rank"))
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("rank").orderBy("slot")) - 1)


def shares(totals: DataFrame, frame: int, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """source, units, rank, share: each source's slots of a frame, by largest remainder; one at least. A source that the
    weights leave out or give 0 has none and no row."""
    if weights is None:
        raw = totals.withColumn("w", F.pow(F.greatest("units", F.lit(1)).cast("double"), F.lit(float(temperature))))
    else:
        pick = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()], F.lit(0.0))
        raw = totals.withColumn("w", pick).filter("w > 0")
    every = Window.partitionBy(F.lit(0))  # a row for each source
    raw = raw.withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_first())) - 1)
    n = F.count("*").over(every)
    # one slot for each, the others in proportion
    fits = F.lit(frame) - n
    exact = raw.withColumn("ideal", F.col("w") / F.sum("w").over(every) * fits)
    floor = exact.withColumn("whole", F.floor("ideal").cast("int"))
    left = F.lit(frame) - n - F.sum("whole").over(every)
    order = F.row_number().over(every.orderBy(F.round(F.col("whole") - F.col("ideal"), 9), "rank"))
    return floor.withColumn("share", (1 + F.col("whole") + (order <= left).cast("int")).cast("int")).select("source", "units", "rank", "share")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, frame: int = FRAME, block_units: int = BLOCK_UNITS, seed: int = 1) -> DataFrame:
    """The mixture: a row for each occurrence of a document, to be read in the order of (slot, at).

    doc_id, source, units (characters), block, epoch, slot, at (the document's offset in its source). Without weights a source's target is its
    number of characters to the power temperature; with weights a source of weight 0, or without one, isn't in the mixture.
    No document of another is left out: the mixture ends with the slot in which the
    last source has been read once; the others are read again from their beginning (epoch 1, 2, ...) to keep their share.
    A document belongs to the block where it begins.

    A null or empty text has no units and follows its neighbour. A null source is a source of its own. Rows without
    doc_id are scheduled too. Repeated rows are each scheduled; they are ties, in any order. Any number of sources fits (see above). An empty
    table gives an empty result. Other columns are ignored.
    """
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("units"))
    rows = written(_ordered(rows, seed), "units", docs.sparkSession)  # the texts are read once
    return schedule(rows, weights, temperature, frame, block_units)


def mixed_documents(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, frame: int = FRAME, block_units: int = BLOCK_UNITS, seed: int = 1, slots_per_file: int = 256) -> DataFrame:
    """The mixture itself: the rows of docs with all their columns, each as often as it is scheduled. Written as files, a
    file holds runs of slots_per_file consecutive slots, in order. See mixed."""
    rows = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("units"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = schedule(_ordered(rows, seed), weights, temperature, frame, block_units)
    out = out.withColumn("run", F.floor(F.col("slot") / slots_per_file)).repartition("run").sortWithinPartitions("slot", "at")
    return out.select("row.*")


def _ordered(rows: DataFrame, seed: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return rows.withColumn("order", F.substring(key, 1, 16))


def schedule(rows: DataFrame, weights: dict[str, float] | None, temperature: float, frame: int, block_units: int) -> DataFrame:
    """rows (doc_id, source, units, order, and perhaps row) with block, epoch, slot, at."""
    spark = rows.sparkSession
    keep = ["doc_id", "source", "units", *(["row"] if "row" in rows.columns else [])]
    # 4,096 buckets by the hash's first three digits: a third of 10^9 rows is some 10^5 to a bucket
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit(""))  # noqa: E731 - a null source as a key of plain joins
    rows = rows.withColumn("key", key(F.col("source"))).withColumn("bucket", F.substring("order", 1, 3))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("units").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = written(buckets.withColumn("before", before), "buckets", spark)
    totals = buckets.groupBy("source").agg(F.sum("sum").alias("units"))
    n = totals.count()
    frame = frame if n <= frame else 2 * n
    share = shares(totals, frame, weights, temperature)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("units") / block_units)).cast("long")
    share = share.withColumn("blocks", blocks)
    share = share.withColumn("frames", F.max(F.ceil(F.col("blocks") / F.col("share"))).over(Window.partitionBy(F.lit(0))).cast("long"))
    share = written(share, "shares", spark)
    slots = written(pattern(share.select("rank", "share")), "pattern", spark)
    inner = F.coalesce(F.sum("units").over(Window.partitionBy("key", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = rows.withColumn("inner", inner)
    # the rows lie by key and bucket already: this join moves none of them again
    at = at.join(buckets.select(key(F.col("source")).alias("key"), "bucket", "before"), ["key", "bucket"]).select(*keep, (F.col("before") + F.col("inner")).alias("at"))
    # the mixture ends with the last first reading of any source
    last = share.withColumn("nth", ((F.col("blocks") - 1) % F.col("share")).cast("int")).join(slots, ["rank", "nth"])
    end = last.agg(F.max(F.floor((F.col("blocks") - 1) / F.col("share")) * frame + F.col("slot")).alias("end")).first()["end"]
    plan = share.select(F.col("source").alias("s"), "rank", "share", "blocks", "frames")
    placed = at.join(F.broadcast(plan), at.source.eqNullSafe(plan.s)).drop("s")  # at most a row for each slot of a frame
    placed = placed.withColumn("block", F.least(F.floor(F.col("at") / block_units), F.col("blocks") - 1).cast("long"))
    placed = placed.withColumn("rounds", F.floor((F.col("share") * F.col("frames") - F.col("block") - 1) / F.col("blocks")).cast("long"))
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds"))))
    placed = placed.withColumn("index", F.col("block") + F.col("epoch") * F.col("blocks")).withColumn("nth", (F.col("index") % F.col("share")).cast("int"))
    slots = slots.withColumnRenamed("slot", "in_frame")
    placed = placed.join(F.broadcast(slots), ["rank", "nth"])  # FRAME rows
    slot = F.floor(F.col("index") / F.col("share")) * frame + F.col("in_frame")
    return placed.withColumn("slot", slot.cast("long")).filter(F.col("slot") <= F.lit(end)).select(*keep, "block", "epoch", "slot", "at")


#: DuckDB SQL for mixed() over documents, with its default parameters; the frame's schedule is a recursive query.
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(length(coalesce(text, '')) AS BIGINT) AS units, substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16) AS ord FROM documents),
w AS (SELECT source, units, pow(CAST(greatest(units, 1) AS DOUBLE), {TEMPERATURE}) AS w, CAST(row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS INTEGER) AS rank, count(*) OVER () AS n FROM (SELECT source, CAST(sum(units) AS BIGINT) AS units FROM d GROUP BY source)),
f AS (SELECT *, CAST(floor(ideal) AS INTEGER) AS whole FROM (SELECT *, w / sum(w) OVER () * ({FRAME} - n) AS ideal FROM w)),
s AS (SELECT source, rank, CAST(greatest(1, ceil(units / {BLOCK_UNITS}.0)) AS BIGINT) AS blocks, CAST(1 + whole + CASE WHEN row_number() OVER (ORDER BY round(whole - ideal, 9), rank) <= {FRAME} - n - sum(whole) OVER () THEN 1 ELSE 0 END AS BIGINT) AS share FROM f),
sh AS (SELECT list(share ORDER BY rank) AS sh FROM s),
e AS (SELECT -1 AS slot, list_transform(sh, lambda x: CAST(0 AS BIGINT)) AS done, CAST(-1 AS BIGINT) AS pick, sh FROM sh
 UNION ALL SELECT slot + 1, list_transform(range(len(sh)), lambda k: done[k + 1] + CASE WHEN k = p THEN 1 ELSE 0 END), p, sh FROM (
  SELECT slot, done, sh, list_min(list_filter(list_transform(range(len(sh)), lambda k: CASE WHEN done[k + 1] * {FRAME} // sh[k + 1] <= slot + 1 THEN ((done[k + 1] + 1) * {FRAME} + sh[k + 1] - 1) // sh[k + 1] * 100000 + k END), lambda x: x IS NOT NULL)) % 100000 AS p FROM e WHERE slot < {FRAME - 1})),
pat AS (SELECT CAST(pick AS INTEGER) AS rank, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS nth FROM e WHERE slot >= 0),
fin AS (SELECT max((blocks - 1) // share * {FRAME} + slot) AS e, max(CAST(ceil(blocks / share) AS BIGINT)) AS frames FROM s JOIN pat ON s.rank = pat.rank AND (blocks - 1) % share = nth),
a AS (SELECT *, CAST(coalesce(sum(units) OVER (PARTITION BY source ORDER BY ord, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at" FROM d),
b AS (SELECT doc_id, a.source, units, "at", least("at" // {BLOCK_UNITS}, blocks - 1) AS block, blocks, share, rank, frames, e FROM a JOIN s ON a.source IS NOT DISTINCT FROM s.source, fin),
x AS (SELECT *, unnest(range(0, (share * frames - block - 1) // blocks + 1)) AS epoch FROM b),
y AS (SELECT *, block + epoch * blocks AS i FROM x),
z AS (SELECT doc_id, source, units, block, epoch, CAST(i // share * {FRAME} + slot AS BIGINT) AS slot, "at", e FROM y JOIN pat ON y.rank = pat.rank AND i % share = nth)
SELECT doc_id, source, units, block, epoch, slot, "at" FROM z WHERE slot <= e
"""
