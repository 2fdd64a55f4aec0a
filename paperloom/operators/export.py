"""Parsed citations as XML and bibliographic formats; one column expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import xml_escape

ORDER = ["authors", "title", "date", "journal", "booktitle", "tech", "volume", "issue", "pages", "editor", "publisher", "institution", "location", "note"]
FORMATS = ("ads", "bib", "end", "isi", "ris", "wordbib")


def formats(names: str) -> list[str]:
    """Names joined by -, sorted, each once. Unknown ones are an error."""
    out = sorted(set(names.split("-")))
    if unknown := [n for n in out if n not in FORMATS]:
        raise ValueError(f"unknown formats: {', '.join(unknown)}")
    return out


def element(name: str, value: Column) -> Column:
    """<name>value</name>, or nothing for null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"<{name}>"), xml_escape(value), F.lit(f"</{name}>")))


def citation_xml() -> Column:
    """A citation element in fixed field order. Expects the columns of parse_references."""
    authors = F.when(F.col("authors").isNotNull(), F.concat(F.lit("<authors>"), F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<author>"), xml_escape(a), F.lit("</author>"))), ""), F.lit("</authors>")))
    rest = [element(c, F.col(c)) for c in ORDER[1:]]
    return F.concat(F.lit('<citation valid="'), F.col("valid").cast("string"), F.lit('">'), F.concat_ws("", authors, *rest, element("marker", F.col("marker")), element("rawString", F.col("raw"))), F.lit("</citation>"))


def runs_xml(runs: str = "runs") -> Column:
    """A variant element with a field element for each run."""
    one = lambda r: F.concat(F.lit("<"), r["tag"], F.lit(' confidence="'), F.format_number(r["confidence"], 6), F.lit('">'), xml_escape(r["content"]), F.lit("</"), r["tag"], F.lit(">"))
    mean = F.aggregate(runs, F.lit(0.0), lambda a, r: a + r["confidence"]) / F.greatest(F.size(runs), F.lit(1))
    return F.concat(F.lit('<variant confidence="'), F.format_number(mean, 6), F.lit('">'), F.array_join(F.transform(runs, one), ""), F.lit("</variant>"))


def envelope(version: str, *parts: Column) -> Column:
    """Sub-documents without their XML declarations, in one algorithms element."""
    clean = [F.regexp_replace(p, r"^<\?xml[^>]*\?>\s*", "") for p in parts]
    return F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<algorithms version="{version}">\n'), F.concat_ws("\n", *clean), F.lit("\n</algorithms>"))


def kind() -> Column:
    """article, book or section; null: not exported."""
    has = {c: F.col(c).isNotNull() for c in ("journal", "title", "booktitle", "pages")}
    return F.when(has["journal"], "article").when(has["title"] & ~has["booktitle"] & ~has["pages"], "book").when(has["title"] & has["booktitle"], "section")


def exported(refs: DataFrame, fmt: str) -> DataFrame:
    """doc_id, cite_no, entry: citations of a kind that is exported, as one of FORMATS."""
    formats(fmt)
    rows = refs.withColumn("kind", kind()).filter("kind is not null")
    key = F.concat_ws("", F.regexp_extract(F.get("authors", F.lit(0)), r"([^\x20]+)$", 1), F.col("date"))
    first, last = (F.get(F.split("pages", "--"), F.lit(i)) for i in (0, 1))
    line = lambda tag, c, sep=" ": F.when(c.isNotNull() & (c != ""), F.concat(F.lit(tag + sep), c))
    each = lambda tag, sep=" ": F.array_join(F.transform("authors", lambda a: F.concat(F.lit(tag + sep), a)), "\n")
    c = F.col
    host = F.coalesce("journal", "booktitle")
    if fmt == "bib":
        name = F.when(c("kind") == "article", "article").when(c("kind") == "book", "book").otherwise("inproceedings")
        b = lambda tag, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"  {tag} = {{"), v, F.lit("}")))
        body = F.concat_ws(",\n", b("author", F.array_join("authors", " and ")), b("title", c("title")), b("journal", c("journal")), b("booktitle", c("booktitle")), b("year", c("date")), b("volume", c("volume")), b("number", c("issue")), b("pages", c("pages")), b("publisher", c("publisher")), b("address", c("location")))
        out = F.concat(F.lit("@"), name, F.lit("{"), key, F.lit(",\n"), body, F.lit("\n}"))
    elif fmt == "ris":
        kind_ = F.when(c("kind") == "article", "JOUR").when(c("kind") == "book", "BOOK").otherwise("CHAP")
        out = F.concat_ws("\n", F.concat(F.lit("TY  - "), kind_), each("AU  -"), line("TI  -", c("title")), line("T2  -", host), line("PY  -", c("date")), line("VL  -", c("volume")), line("IS  -", c("issue")), line("SP  -", first), line("EP  -", last), line("PB  -", c("publisher")), line("CY  -", c("location")), F.lit("ER  - "))
    elif fmt == "end":
        kind_ = F.when(c("kind") == "article", "Journal Article").when(c("kind") == "book", "Book").otherwise("Book Section")
        out = F.concat_ws("\n", F.concat(F.lit("%0 "), kind_), each("%A"), line("%T", c("title")), line("%J", c("journal")), line("%B", c("booktitle")), line("%D", c("date")), line("%V", c("volume")), line("%N", c("issue")), line("%P", c("pages")), line("%I", c("publisher")), line("%C", c("location")))
    elif fmt == "isi":
        kind_ = F.when(c("kind") == "article", "J").otherwise("B")
        out = F.concat_ws("\n", F.concat(F.lit("PT "), kind_), each("AU"), line("TI", c("title")), line("SO", host), line("PY", c("date")), line("VL", c("volume")), line("IS", c("issue")), line("BP", first), line("EP", last), line("PU", c("publisher")), F.lit("ER"))
    elif fmt == "ads":
        out = F.concat_ws("\n", F.concat(F.lit("%R "), F.coalesce("date", F.lit(""))), line("%A", F.array_join("authors", "; ")), line("%T", c("title")), line("%J", F.concat_ws(", ", host, F.concat(F.lit("vol. "), c("volume")), F.concat(F.lit("p. "), c("pages")))), line("%D", c("date")), line("%I", c("publisher")))
    else:
        people = F.concat(F.lit("<b:Author><b:Author><b:NameList>"), F.array_join(F.transform("authors", lambda a: F.concat(F.lit("<b:Person>"), element("b:Last", F.regexp_extract(a, r"([^\x20]+)$", 1)), element("b:First", F.trim(F.regexp_replace(a, r"[^\x20]+$", ""))), F.lit("</b:Person>"))), ""), F.lit("</b:NameList></b:Author></b:Author>"))
        kind_ = F.when(c("kind") == "article", "JournalArticle").when(c("kind") == "book", "Book").otherwise("BookSection")
        out = F.concat(F.lit("<b:Source>"), F.concat_ws("", element("b:SourceType", kind_), element("b:Tag", key), people, element("b:Title", c("title")), element("b:JournalName", c("journal")), element("b:BookTitle", c("booktitle")), element("b:Year", c("date")), element("b:Volume", c("volume")), element("b:Issue", c("issue")), element("b:Pages", c("pages")), element("b:Publisher", c("publisher")), element("b:City", c("location"))), F.lit("</b:Source>"))
    return rows.select("doc_id", "cite_no", out.alias("entry"))


def error_report(rows: DataFrame, gold: str, guess: str, tok: str) -> DataFrame:
    """rows with shown: the token, wrapped where the labels differ."""
    mark = F.concat(F.lit('<error correct="'), F.col(gold), F.lit('" taggedAs="'), F.col(guess), F.lit('">'), xml_escape(F.col(tok)), F.lit("</error>"))
    return rows.withColumn("shown", F.when(F.col(gold) != F.col(guess), mark).otherwise(xml_escape(F.col(tok))))
