"""Cross-validation of labellers and the smaller evaluation steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexical as X
from . import crf
from . import tables as T


def contiguous_fold(at: Column, n: Column, k: int) -> Column:
    """Fold of row at (from 0) of n: k runs of n // k rows, the last with the rest."""
    return F.least(F.floor(at / F.greatest(F.lit(1), F.floor(n / k))), F.lit(k - 1)).cast("int")


def cross_validate(spark: SparkSession, sequences: list[tuple[list, list[str]]], template: str, k: int = 10, **options) -> DataFrame:
    """seq_no, tok_no, gold, guess of every row by a model that hasn't seen its sequence. Folds are trained in parallel,
    one to a task; the corpus must fit a task."""
    from .pipelines import ship

    ship(spark)

    def run(batches):
        import pandas as pd

        for b in batches:
            for fold in b["fold"]:
                model = crf.train([s for i, s in enumerate(sequences) if i % k != fold], template, **options)
                rows = [(i, j, g, p) for i, (r, gold) in enumerate(sequences) if i % k == fold for j, (g, p) in enumerate(zip(gold, model.best(r)))]
                yield pd.DataFrame(rows, columns=["seq_no", "tok_no", "gold", "guess"])

    folds = spark.range(k).select(F.col("id").cast("int").alias("fold")).repartition(k, "fold")
    return folds.mapInPandas(run, "seq_no int, tok_no int, gold string, guess string")


def evaluate(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per label, overall): overall has n, correct and accuracy."""
    per = T.scores(rows, "gold", "guess")
    return per, rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("gold") == F.col("guess"), 1)).alias("correct")).withColumn("accuracy", F.round(F.try_divide("correct", "n"), 6))


def line_to_token_labels(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, text, gold, guess) to a row a token with its line's labels."""
    return lines.select("doc_id", "line_no", F.posexplode(X.tokens(F.col("text"))).alias("tok_no", "tok"), "gold", "guess")


def known_tags(rows: DataFrame, tag: str, vocabulary: list[str]) -> DataFrame:
    """Training rows whose tag is in the vocabulary."""
    return rows.filter(F.col(tag).isin(vocabulary))


def section_text(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Every physical line with its label; lines without one (blank ones) have none. lines: doc_id, line_no, text."""
    return lines.join(labels.select("doc_id", "line_no", "label"), ["doc_id", "line_no"], "left").withColumn("label", F.coalesce("label", F.lit("none")))


def front_state(lines: DataFrame) -> DataFrame:
    """state: 0 before the abstract, 1 within, 2 from the introduction on."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    low = F.lower(F.trim("text"))
    here = F.when(low.rlike(r"^[0-9.\x20]*introduction"), 2).when(low.rlike("^abstract"), 1).otherwise(0)
    return lines.withColumn("state", F.max(here).over(w))
