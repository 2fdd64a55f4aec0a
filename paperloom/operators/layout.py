"""OCR layout XML as flat rows, and layout features.

Sibling order matters in this XML (words, runs, spaces and tabs mix), which from_xml loses; so documents are parsed in one
Arrow pass. All features after it are columns and windows within a document.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables as T
from .pipelines import ship

WORDS = "doc_id long, page int, col int, kind string, para int, ln int, run int, word int, text string, l int, t int, r int, b int, bold boolean, italic boolean, underline boolean, script string, font_size int, font_face string, bullet boolean, align string, space_before int"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in WORDS.split(", "))])
LINE = ["page", "col", "para", "ln"]


def repaired(xml: str) -> str:
    """Concatenated pages as one document: prologs and comments out, one root around."""
    return "<root>" + re.sub(r"<\?xml[^>]*\?>|<!DOCTYPE[^>]*>|<!--.*?-->", "", xml, flags=re.S) + "</root>"


def _tag(e: ET.Element) -> str:
    t = e.tag
    return t.rpartition("}")[2] if t[0] == "{" else t


@lru_cache(1 << 16)
def _number(v: str | None) -> int | None:
    return int(float(v)) if v and re.fullmatch(r"-?\d+(\.\d+)?", v) else None


_FORMATS = ("bold", "italic", "underlined", "subsuperscript", "fontSize", "fontFace")
_SIDES = ("l", "t", "r", "b")
#: Words of a batch, at the least; documents stay whole
BATCH = 1 << 13


def _inherited(e: ET.Element | None, outer: tuple) -> tuple:
    """The formats within an element: its own, else those around it."""
    if e is None or not e.attrib:
        return outer
    get = e.attrib.get
    return tuple([get(k, o) for k, o in zip(_FORMATS, outer)])


@lru_cache(1 << 12)
def _format(bold, italic, underlined, script, size, face) -> tuple:
    return bold == "true", italic == "true", underlined not in (None, "none", "false"), script or "none", int(float(size)) if size else -1, face or ""


def _columns(page: ET.Element) -> list[ET.Element]:
    """The outermost columns and pictures of a page, in order; the page if there are none."""
    out, stack = [], [page]
    while stack:
        e = stack.pop()
        if _tag(e) in ("column", "dd"):
            out.append(e)
        else:
            stack.extend(reversed(e))
    return out or [page]


def flatten(doc_id, xml: str | None) -> list[tuple]:
    """A row for each word. A line without runs is one run; a word with inner runs is one row a run. Formats are inherited
    from run, then line, then paragraph. Broken XML is an error that names the document."""
    if not xml or not xml.strip():
        return []
    try:
        root = ET.fromstring(repaired(xml))
    except ET.ParseError as e:
        raise ValueError(f"document {doc_id}: {e}") from None
    out: list[tuple] = []
    none = (None,) * len(_FORMATS)

    def words(line, at, kind, para):
        head = (doc_id, *at[:2], kind, *at[2:])
        tail = (para is not None and para.get("bullet") is not None, (para.get("alignment") if para is not None else None) or "left", _number(para.get("spaceBefore")) if para is not None else None)
        sides = tuple([_number(line.get(k)) for k in _SIDES])
        run_no = word_no = 0

        def put(text, e, fmt):
            nonlocal word_no
            own = sides
            if e.attrib:
                own = tuple([s if (v := _number(e.get(k))) is None else v for k, s in zip(_SIDES, sides)])
            out.append((*head, run_no, word_no, text, *own, *_format(*fmt), *tail))
            word_no += 1

        def visit(node, fmt):
            nonlocal run_no
            for e in node:
                name = _tag(e)
                if name == "wd":
                    if not len(e):
                        put((e.text or "").strip(), e, fmt)
                    elif inner := [x for x in e if _tag(x) == "run"]:
                        for x in inner:
                            run_no += 1
                            put("".join(x.itertext()).strip(), e, _inherited(x, fmt))
                    else:
                        put("".join(e.itertext()).strip(), e, fmt)
                elif name == "run":
                    run_no += 1
                    before, mine = word_no, _inherited(e, fmt)
                    visit(e, mine)
                    if word_no == before and (e.text or "").strip():
                        for w in e.text.split():
                            put(w, e, mine)
        visit(line, _inherited(line, _inherited(para, none)))

    def lines(node, page, col, counter, kind, para):
        for e in node:
            name = _tag(e)
            if name == "para":
                counter[0] += 1
                ln = -1
                for x in e:
                    if _tag(x) == "ln":
                        ln += 1
                        words(x, (page, col, counter[0], ln), kind, e)
            elif name == "ln":
                counter[0] += 1
                words(e, (page, col, counter[0], 0), kind, para)
            elif name in ("table", "frame", "dd", "cell", "section", "body", "column"):
                lines(e, page, col, counter, {"table": "table", "frame": "frame", "dd": "picture"}.get(name, kind), para)

    for p, page in enumerate([x for x in root.iter() if _tag(x) == "page"]):
        for c, column in enumerate(_columns(page)):
            lines(column, p, c, [-1], "picture" if _tag(column) == "dd" else "text", None)
    return out


def word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (doc_id, xml) to batches of words. Small documents share one."""
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)
    rows: list[tuple] = []
    for b in batches:
        for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows += flatten(i, x)
            if len(rows) >= BATCH:
                yield made(rows)
                rows = []
    if rows:
        yield made(rows)


def layout_words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, xml) to a row a word."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "xml").mapInArrow(word_batches, WORDS)


def layout_lines(words: DataFrame) -> DataFrame:
    """A row a line: text, place, size and face by most words (ties: the larger), bold and italic by 0.667 of words. In a
    picture formats are masked. The words are moved once; what is most frequent is found within a line's row."""
    key = ["doc_id", *LINE]
    pic = F.max((F.col("kind") == "picture").cast("int")) == 1
    share = lambda c: F.avg(F.col(c).cast("double"))
    yes = lambda c: F.when(pic, "no").when(share(c) >= 0.667, "yes").otherwise("no")
    out = words.dropna(subset=key).groupBy(*key).agg(F.collect_list(F.struct("word", "text", "font_size", "font_face")).alias("__w"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"), yes("bold").alias("bold"), yes("italic").alias("italic"), F.when(pic, "yes").otherwise("no").alias("pic"), F.when(F.max((F.col("kind") == "table").cast("int")) == 1, "yes").otherwise("no").alias("table"), F.when(F.max(F.col("bullet").cast("int")) == 1, "yes").otherwise("no").alias("bullet"), F.first("align").alias("align"))
    kinds = dict(words.dtypes)
    text = F.array_join(F.transform(F.array_sort("__w"), lambda x: x["text"]), " ")
    usual = lambda c, masked: F.when(F.col("pic") == "yes", masked).otherwise(T.mode_of(F.transform("__w", lambda x: x[c]), kinds[c]))
    return out.select(*key, text.alias("text"), *[c for c in out.columns if c not in (*key, "__w")], usual("font_size", -1).alias("font_size"), usual("font_face", "none").alias("font_face"))


def layout_features(lines: DataFrame, bins: int = 8) -> DataFrame:
    """lines with line_no, place on the page in bins, size against the document's most frequent, and what changes from the
    line before: size, face, bold, italic, align, paragraph. All of it in windows by document, so lines are made and moved once."""
    doc = Window.partitionBy("doc_id")
    lines = T.vertical_bins(lines, "doc_id", "t", bins).withColumnRenamed("bin", "loc")  # first, for the others keep its partitions
    same = F.count("*").over(Window.partitionBy("doc_id", "font_size"))
    lines = lines.withColumn("__n", F.when(F.col("font_size") > 0, F.struct(same.alias("n"), "font_size")))
    lines = lines.withColumn("__usual", F.max("__n").over(doc)["font_size"])
    lines = lines.withColumn("line_no", F.row_number().over(doc.orderBy(*LINE)) - 1)
    lines = lines.withColumn("size_class", F.when(F.col("font_size") < F.col("__usual"), "smaller").when(F.col("font_size") > F.col("__usual"), "larger").otherwise("common")).drop("__n", "__usual")
    lines = lines.withColumn("paragraph", F.struct("page", "col", "para"))
    return T.changes(lines, "doc_id", LINE, ["font_size", "font_face", "bold", "italic", "align", "paragraph"]).drop("paragraph")


def line_range(lines: DataFrame, start: tuple | None = None, end: tuple | None = None) -> DataFrame:
    """Lines between two addresses (page, col, para, ln), both included; None: open."""
    at = F.struct(*LINE)
    lit = lambda a: F.struct(*[F.lit(x).cast("int").alias(n) for x, n in zip(a, LINE)])
    if start is not None:
        lines = lines.filter(at >= lit(start))
    return lines if end is None else lines.filter(at <= lit(end))


def line_set(lines: DataFrame, addresses: DataFrame) -> DataFrame:
    """Lines whose address is in a table of them."""
    return lines.join(addresses, ["doc_id", *LINE], "left_semi")


def spacing(lines: DataFrame, key: str, gap: str) -> DataFrame:
    """wide: yes where a line's gap is above the usual ones: the most frequent gap, widened to larger ones whose frequency
    is over 0.8 of the one before."""
    freq = lines.groupBy(key, gap).agg(F.count("*").alias("n"))
    top = freq.groupBy(key).agg(F.max(F.struct("n", -F.col(gap))).alias("m"), F.array_sort(F.collect_list(F.struct(gap, "n"))).alias("all"))
    state = F.struct((-F.col("m.col2")).alias("g"), F.col("m.n").alias("n"), F.lit(True).alias("go"))
    step = lambda a, x: F.when(a["go"] & (x[gap] > a["g"]), F.when(x["n"] > 0.8 * a["n"], F.struct(x[gap].alias("g"), x["n"].alias("n"), F.lit(True).alias("go"))).otherwise(F.struct(a["g"].alias("g"), a["n"].alias("n"), F.lit(False).alias("go")))).otherwise(a)
    usual = top.select(key, F.aggregate("all", state, step)["g"].alias("usual"))
    return lines.join(usual, key).withColumn("wide", F.when(F.col(gap) > F.col("usual"), "yes").otherwise("no")).drop("usual")


def simplified(words: DataFrame) -> DataFrame:
    """doc_id, markup: pages, paragraphs, lines and words in plain elements, from one sorted list of a document's words."""
    from ..functions.normalize import xml_escape

    word = F.coalesce(F.concat(F.lit("<word>"), xml_escape(F.col("text")), F.lit("</word>")), F.lit("")).alias("x")
    docs = words.select("doc_id", F.struct(*LINE, "word", word).alias("w")).groupBy("doc_id").agg(F.array_sort(F.collect_list("w")).alias("w"))

    def opened(x: Column, i: Column, w: Column) -> Column:
        """The word, behind the ends and beginnings that part it from the word before."""
        change = lambda n, ends, begins: (~(F.struct(*[x[c] for c in LINE[:n]]) == F.struct(*[F.get(w, i - 1)[c] for c in LINE[:n]])), ends + begins)
        levels = (change(1, "</line></para></page>", "<page><para><line>"), change(3, "</line></para>", "<para><line>"), change(4, "</line>", "<line>"))
        tags = F.when(i == 0, "<page><para><line>")
        for differs, between in levels:
            tags = tags.when(differs, between)
        return F.concat(tags.otherwise(""), x["x"])

    body = F.array_join(F.transform("w", lambda x, i: opened(x, i, F.col("w"))), "")
    return docs.select("doc_id", F.concat(F.lit("<document>"), body, F.lit("</line></para></page></document>")).alias("markup"))


def table_grid(cells: DataFrame) -> DataFrame:
    """cells (doc_id, table_no, row, col, lines array) to doc_id, table_no, row, line, text: cells side by side, a line of
    each, with tabs between."""
    n = cells.groupBy("doc_id", "table_no", "row").agg(F.max(F.size("lines")).alias("n"))
    rows = cells.join(n, ["doc_id", "table_no", "row"]).select("doc_id", "table_no", "row", "col", "lines", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)))).alias("line"))
    rows = rows.withColumn("text", F.coalesce(F.get("lines", F.col("line")), F.lit("")))
    return rows.groupBy("doc_id", "table_no", "row", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"]), "\t").alias("text"))
