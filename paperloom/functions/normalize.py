"""Field normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexical import let

WORD = r"\p{Lu}\p{Ll}"


def strip_punctuation(s: Column) -> Column:
    """Leading junk off, unpaired outer brackets off, until nothing changes.

    A layer is taken at a time, so the text's length bounds the rounds; once a round changes nothing the others cost nothing.
    """

    def close(x: Column) -> Column:
        return F.when(x.rlike(r"\p{Pe}$") & ~x.rlike(r"\p{Ps}[^\p{Pe}\p{Ps}]+\p{Pe}$"), F.regexp_replace(x, r"\p{Pe}+$", "")).otherwise(x)

    def open_(x: Column) -> Column:
        return F.when(x.rlike(r"^\p{Ps}") & ~x.rlike(r"^\p{Ps}[^\p{Pe}\p{Ps}]+\p{Pe}"), F.regexp_replace(x, r"^\p{Ps}+", "")).otherwise(x)

    def layer(x: Column) -> Column:
        return let(let(F.regexp_replace(x, rf"^[^{WORD}0-9\p{{Ps}}]+", ""), close), open_)

    def step(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(let(layer(a["s"]), lambda t: F.struct(t.alias("s"), (t == a["s"]).alias("done"))))

    # only brackets begin a further layer
    rounds = lambda x: F.sequence(F.lit(0), F.length(F.regexp_replace(x, r"[^\p{Ps}\p{Pe}]", "")) + 1)
    return let(s, lambda x: F.when(x.isNull(), x).otherwise(F.aggregate(rounds(x), F.struct(x.alias("s"), F.lit(False).alias("done")), step)["s"]))


def volume(s: Column) -> Column:
    """[volume, issue] of 5 (1); [volume] of other text with digits; else the text."""
    both = r"([0-9]+)[\x09-\x0D\x20]*[({\[]+([0-9]+)"
    return F.when(s.rlike(both), F.array(F.regexp_extract(s, both, 1), F.regexp_extract(s, both, 2))).otherwise(F.array(number(s)))


def date(s: Column, as_of_year: int) -> Column:
    """The first four digits if they are no later than three years after as_of_year, else empty; null stays null."""
    y = F.regexp_extract(s, "([0-9]{4})", 1)
    return F.when(F.coalesce(F.expr("1") * y.try_cast("int"), F.lit(99999)) <= as_of_year + 3, y).when(s.isNotNull(), "")


def number(s: Column) -> Column:
    return let(s, lambda x: let(F.regexp_extract(x, "([0-9]+)", 1), lambda d: F.when(d != "", d).otherwise(x)))


def pages(s: Column) -> Column:
    p = "([0-9]+)[^0-9]+?([0-9]+)"
    return F.when(s.rlike(p), F.concat(F.regexp_extract(s, p, 1), F.lit("--"), F.regexp_extract(s, p, 2))).otherwise(number(s))


def xml_escape(s: Column) -> Column:
    """Control characters out, the five entities in; the ampersand first."""
    s = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


PARTICLES = r"\b(van der|van den|van de|von der|de la|de las|de los|von|van|della|dello|del|di|da|du|de|la|le|el|ter|ten)\x20"


def author_tokens(s: Column) -> Column:
    """Author text repaired and cut into tokens: et al and brackets gone, particles tied with _, suffixes and numerals out."""
    for pattern, by in (
        (r"et\.? al\.?.*$", ""),
        (rf"^.*?[{WORD}]{{2,}}\. ", ""),
        (r"\(.*?\)", ""), (r"^.*?\)\.?", ""), (r"\(.*?$", ""),
        (r"\[.*?\]", ""), (r"^.*?\]\.?", ""), (r"\[.*?$", ""),
        (";", ","), (",", ", "), (":", " "), (r'[!"#$%()*+/<=>?@\[\]^_{}~]', ""),
    ):
        s = F.regexp_replace(s, pattern, by)
    s = F.regexp_replace(F.regexp_replace(s, "(?i)" + PARTICLES, "$1_"), r"(?i)\b(van|von|de)\x20(der|den|de|la|las|los)_", "$1_$2_")
    return let(F.filter(F.split(s, r"[\x09-\x0D\x20]+", -1), lambda t: t != ""), _kept_tokens)


def _kept_tokens(toks: Column) -> Column:
    def step(acc: Column, x: Column) -> Column:
        t, early = x["t"], x["early"]
        junk = ~t.rlike(rf"[{WORD}&]")
        suffix = t.rlike(r"(?i)^(esq|jr|md|m\.d|phd|ph\.d|sr)\.?,?$") & F.coalesce(F.try_element_at(acc["out"], F.lit(-1)).endswith(","), F.lit(False))
        numeral = t.rlike(r"^[IVX]{2,}\.?,?$")
        none = F.array().cast("array<string>")
        out = F.when(acc["stop"] | suffix | numeral, acc["out"]).when(junk & early, none).when(junk, acc["out"]).otherwise(F.concat(acc["out"], F.array(t)))
        return F.struct(out.alias("out"), (acc["stop"] | (junk & ~early)).alias("stop"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop"))
    return F.aggregate(F.transform(toks, lambda t, i: F.struct(t.alias("t"), (i * 2 < F.size(toks) - 1).alias("early"))), start, step)["out"]


def author_names(s: Column) -> Column:
    """Names of an author field, each as First Middle Last."""
    none = F.array().cast("array<string>")

    def step(acc: Column, t: Column) -> Column:
        cut = F.lower(t).isin("&", "and")
        closes = t.endswith(",") & (F.size(acc["cur"]) >= 1)
        grown = F.concat(acc["cur"], F.array(t))
        done = F.when(cut, F.when(F.size(acc["cur"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["cur"], " ")))).otherwise(acc["done"])).when(closes, F.concat(acc["done"], F.array(F.array_join(grown, " ")))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(cut | closes, none).otherwise(grown).alias("cur"))

    split = F.aggregate(author_tokens(s), F.struct(none.alias("done"), none.alias("cur")), step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["done"], F.array(F.array_join(a["cur"], " ")))).otherwise(a["done"]))
    return F.filter(F.transform(split, author_name), lambda x: x != "")


def author_name(s: Column) -> Column:
    s = F.regexp_replace(s, r"^(.+),\x20*([^\x20].*)$", "$2 $1")
    s = F.regexp_replace(s, r"\.-", "-")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, "[,.]", " "), " {2,}", " "))
    return F.trim(F.regexp_replace(s, r"^([^\x20]{2,})((?:\x20[^\x20](?:-[^\x20])?)+)$", "$2 $1"))


def marker(authors: Column, year: Column) -> Column:
    """Last names and year, as the text cites them."""
    last = F.transform(authors, lambda a: F.replace(F.regexp_extract(a, r"([^\x20]+)$", 1), F.lit("_"), F.lit(" ")))
    return F.array_join(F.concat(last, F.array(year)), ", ")


def header_field(s: Column) -> Column:
    """Leading tag word off, broken words joined."""
    return F.regexp_replace(F.trim(F.regexp_replace(s, r"(?i)^[\x09-\x0D\x20]*(abstract|keywords?|key words|introduction)[\x09-\x0D\x20:.-]+", "")), r"([A-Za-z])- ([a-z])", "$1$2")


def email_group(s: Column) -> Column:
    """{a,b}@c gives a@c and b@c; a separator other than the comma is used if it is the only kind of symbol and occurs."""
    group = r"^[\x20]*\{?([^{}@]+)\}?@(.+?)[\x20]*$"
    names, domain = F.regexp_extract(s, group, 1), F.regexp_extract(s, group, 2)
    sep = F.when(names.rlike("[,;|/]"), "[,;|/]").otherwise(r"\x20+")
    out = F.transform(F.filter(F.transform(F.split(names, sep, -1), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(x, F.lit("@"), domain))
    return F.when(s.rlike(group), out).otherwise(F.array(F.trim(s)))


def regex_escape(s: Column) -> Column:
    """Safe within a pattern: some symbols escaped, the others that would be operators deleted."""
    return F.regexp_replace(F.regexp_replace(s, r"([\\\-\[\]()'\".])", r"\\$1"), r"[+?*^$]", "")


def unescape(s: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def signals(s: Column, author: bool) -> Column:
    """Superscripts that tie authors to affiliations; empty ones are dropped."""
    if author:
        return F.filter(F.split(F.trim(s), r"[\x20,:;]+", -1), lambda x: x != "")
    return F.filter(F.array(F.regexp_replace(s, r"[\x09-\x0D\x20]+", "")), lambda x: x != "")
