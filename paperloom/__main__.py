"""python -m paperloom -m MODE -i raw|refs IN OUT [-e TYPES]: extraction from files into Parquet (and XML or exports)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import export as E
from .operators import pipelines as P
from .sources import readers as R

MODES = ("extract_citations", "extract_header", "extract_section", "extract_meta", "extract_all")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser("paperloom", description=__doc__)
    p.add_argument("-m", "--mode", choices=MODES, default="extract_citations")
    p.add_argument("-i", "--input", choices=("raw", "refs"), default="raw", help="papers, or a reference on each line")
    p.add_argument("-e", "--export", type=E.formats, help=f"formats joined by -, of {' '.join(E.FORMATS)}; needs a mode with citations")
    p.add_argument("path")
    p.add_argument("out")
    a = p.parse_args(args)
    cites = a.mode in ("extract_citations", "extract_meta", "extract_all") or a.input == "refs"
    if a.export and not cites:
        p.error("-e needs a mode with citations")
    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    if a.input == "refs":
        refs = P.parse_references(R.references(spark, a.path))
    else:
        docs = R.papers(spark, a.path)
        if a.mode in ("extract_header", "extract_meta", "extract_all"):
            P.extract_header(docs).withColumn("xml", E.envelope("1", E.runs_xml())).write.parquet(f"{a.out}/header")
        if a.mode in ("extract_section", "extract_all"):
            P.extract_sections(docs).withColumn("xml", E.envelope("1", E.runs_xml())).write.parquet(f"{a.out}/sections")
        if cites:
            refs, contexts = P.extract_citations(docs)
            contexts.write.parquet(f"{a.out}/contexts")
    if cites:
        refs.withColumn("xml", E.citation_xml()).write.parquet(f"{a.out}/citations")
        written = spark.read.parquet(f"{a.out}/citations")
        for fmt in a.export or ():
            E.exported(written, fmt).filter(F.col("entry").isNotNull()).write.parquet(f"{a.out}/{fmt}")


if __name__ == "__main__":
    main()
