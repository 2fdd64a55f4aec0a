"""Which author belongs to which affiliation, by signals, place and nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables as T


#: Authors of a document that one task pairs with its affiliations, about
BLOCK = 256


def _pairs(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """The pairs with their features and what else is known of the authors. All that is one author's is in authors before, so pairs
    are made in the join and never moved or sorted. Authors of a document are dealt to blocks of about BLOCK, and its affiliations go
    to each, so a document of many pairs is made by many tasks."""
    blocks = authors.groupBy("doc_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    extra = [c for c in authors.columns if c.startswith("__")]
    shown = F.filter("signals", lambda s: s != "")  # T.signal_match, parted so that lists are filtered once a row
    places = ["page", "section", "para", "line"]
    a = authors.join(blocks, "doc_id").select("doc_id", "author_no", "author", shown.alias("__signals"), *[F.col(c).alias(f"a_{c}") for c in places], *extra, F.pmod(F.xxhash64("author_no", "author"), "__blocks").cast("int").alias("__block"))
    b = affiliations.join(blocks, "doc_id").select("doc_id", "affiliation_no", "affiliation", F.try_element_at(shown, F.lit(1)).alias("__first"), *[F.col(c).alias(f"b_{c}") for c in places], F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)).alias("__block"))
    out = a.join(b, ["doc_id", "__block"]).drop("__block")
    same = lambda *c: F.when(F.struct(*[f"a_{x}" for x in c]) == F.struct(*[f"b_{x}" for x in c]), "same").otherwise("diff")
    near = lambda axis: F.when(F.col(f"__near_{axis}") == F.col("affiliation_no"), "yes").otherwise("no")
    return out.withColumns({"signal": F.when(F.array_contains("__signals", F.col("__first")), "same").otherwise("diff"), "same_page": same("page"), "same_section": same("page", "section"), "same_para": same("page", "section", "para"), "same_line": same(*places), "nearest_x": near("x"), "nearest_y": near("y")}).drop("__signals", "__first")


def _with_nearest(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """authors with the affiliation nearest by x and by y."""
    out = authors
    for axis in ("x", "y"):
        near = T.nearest(authors, affiliations, "doc_id", axis, axis, "affiliation_no", "author_no").select("doc_id", "author_no", F.col("affiliation_no").alias(f"__near_{axis}"))
        out = out.join(near, ["doc_id", "author_no"], "left")
    return out


def pair_features(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """All author and affiliation pairs of a document with their features.

    authors: doc_id, author_no, author, signals, page, section, para, line, x, y (centre). affiliations: the same with
    affiliation_no and affiliation. A title page has few of either; the join is by document.
    """
    return _pairs(_with_nearest(authors, affiliations), affiliations).drop("__near_x", "__near_y")


def _hits(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """doc_id, author_no, __signal, __para: authors whose signals hold any affiliation's first, or with one in their paragraph."""
    shown = lambda c: F.filter(c, lambda s: s != "")
    para = F.struct("page", "section", "para")
    signal = affiliations.select("doc_id", F.try_element_at(shown("signals"), F.lit(1)).alias("s")).filter("s is not null").distinct()
    by_signal = authors.select("doc_id", "author_no", F.explode(shown("signals")).alias("s")).join(signal, ["doc_id", "s"], "left_semi")
    by_para = authors.select("doc_id", "author_no", para.alias("p")).join(affiliations.select("doc_id", para.alias("p")).distinct(), ["doc_id", "p"], "left_semi")
    both = by_signal.select("doc_id", "author_no", F.lit(1).alias("s"), F.lit(0).alias("p")).unionByName(by_para.select("doc_id", "author_no", F.lit(0).alias("s"), F.lit(1).alias("p")))
    return both.groupBy("doc_id", "author_no").agg((F.max("s") == 1).alias("__signal"), (F.max("p") == 1).alias("__para"))


def match_affiliations(authors: DataFrame, affiliations: DataFrame) -> DataFrame:
    """pair_features with label: an author with any matching signal has those affiliations; another, without signal, the
    one in its paragraph, else the nearest one below or beside it."""
    known = _with_nearest(authors, affiliations)
    hits = _hits(authors, affiliations).withColumnsRenamed({"doc_id": "__doc", "author_no": "__no"})
    known = known.join(hits, known["doc_id"].eqNullSafe(hits["__doc"]) & known["author_no"].eqNullSafe(hits["__no"]), "left").drop("__doc", "__no")
    near = F.col("nearest_y") == "yes"
    yes = F.when(F.col("__signal"), F.col("signal") == "same").when(F.col("__para"), (F.col("same_para") == "same") & near).otherwise(near)
    return _pairs(known, affiliations).withColumn("label", F.when(yes, "yes").otherwise("no")).drop("__signal", "__para", "__near_x", "__near_y")


def author_xml(matched: DataFrame) -> DataFrame:
    """doc_id, xml: authors with their institutions."""
    from ..functions.normalize import xml_escape

    inst = F.transform(F.array_sort(F.collect_list(F.struct("affiliation_no", "affiliation"))), lambda x: F.concat(F.lit("<institution>"), xml_escape(x["affiliation"]), F.lit("</institution>")))
    each = matched.filter("label = 'yes'").groupBy("doc_id", "author_no", "author").agg(F.array_join(inst, "").alias("i"))
    one = F.concat(F.lit("<author><fullname>"), xml_escape(F.col("author")), F.lit("</fullname>"), F.col("i"), F.lit("</author>"))
    each = each.withColumn("x", one)
    return each.groupBy("doc_id").agg(F.concat(F.lit("<authors>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("author_no", "x"))), lambda s: s["x"]), ""), F.lit("</authors>")).alias("xml"))
