"""Line features for cutting reference sections into citations, and the cut by labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexical as X
from .documents import merged


def split_features(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, text, para, font_size, left, bold, italic, bullet) with features against the section's
    averages: length, year, author list, ending, edge words, size within 20 %, left within 2 %, paragraph."""
    doc = Window.partitionBy("doc_id")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    text, toks = F.col("text"), X.tokens(F.col("text"))
    separators = F.length(text) - F.length(F.regexp_replace(text, "[,;]", ""))
    last = F.coalesce(F.try_element_at(toks, F.lit(-1)), F.lit("EMPTY"))
    near = lambda c, share: X.first_of((F.col(c) > (1 + share) * F.avg(c).over(doc), "large"), (F.col(c) < (1 - share) * F.avg(c).over(doc), "small"), default="normal")
    return lines.withColumns(
        {
            "length": F.when(F.length(text) > 0.8 * F.avg(F.length(text)).over(doc), "normal").otherwise("short"),
            "year": F.when(text.rlike(r"(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)"), "hasYear").otherwise("noYear"),
            "authors": F.when((separators >= 3) & ~text.rlike("[0-9]"), "longAuthorLine").otherwise("others"),
            "ending": X.first_of((text.rlike(r"\.\s*$"), "period"), (text.rlike(r",\s*$"), "comma"), (text.rlike(r"-\s*$"), "hyphen"), (text.rlike(r"[)\]}]\s*$"), "cbracket"), default="others"),
            "first_case": X.case_class(F.coalesce(F.get(toks, F.lit(0)), F.lit("EMPTY"))),
            "second_case": X.case_class(F.coalesce(F.get(toks, F.lit(1)), F.lit("EMPTY"))),
            "last_number": X.number_class(last),
            "last_punct": X.punct_class(last),
            "size": near("font_size", 0.2),
            "place": near("left", 0.02),
            "paragraph": F.when(F.lag("para").over(order) == F.col("para"), "continue").otherwise("new"),
        }
    )


def split_by_labels(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, text, label of begin, continue, end, unknown) to doc_id, cite_no, raw: a citation for each
    begin; lines before the first are a citation too."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    g = lines.withColumn("g", F.sum((F.col("label") == "begin").cast("int")).over(w))
    out = g.groupBy("doc_id", "g").agg(merged(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])).alias("raw")).filter("raw != ''")
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("g")) - 1).alias("cite_no"), "raw")
