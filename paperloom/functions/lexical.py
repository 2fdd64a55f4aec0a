"""Token and line features as Column expressions; everything stays in the JVM.

W is the word class of Unicode letters, marks, numbers and connectors. Patterns are kept to what both Java and RE2 accept, so
each has a twin in the SQL that checks it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\x09-\x0D\x20]+"
W = r"\p{L}\p{M}\p{N}\p{Pc}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once. Without it, nested uses would multiply the expression."""
    return F.transform(F.array(value), body)[0]


def first_of(*cases: tuple[Column, str], default: str) -> Column:
    """The name of the first case that holds."""
    out = None
    for test, name in cases:
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def tokens(text: Column) -> Column:
    """Array of the tokens between blanks."""
    return F.filter(F.split(text, BLANK, -1), lambda t: t != "")


def lines(text: Column) -> Column:
    """Array of physical lines, carriage returns at their ends removed."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, r"\r+$", ""))


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"[^\x09-\x0D\x20]")


def bare(tok: Column) -> Column:
    """The token's word characters; EMPTY if there are none."""
    only = F.regexp_replace(tok, f"[^{W}]", "")
    return F.when(only == "", "EMPTY").otherwise(only)


def bare_lower(tok: Column) -> Column:
    return F.lower(bare(tok))


def last_char_class(tok: Column) -> Column:
    c = F.right(tok, F.lit(1))
    return F.when(c.rlike(r"^\p{Ll}"), "a").when(c.rlike(r"^\p{Lu}"), "A").when(c.rlike("^[0-9]"), "0").otherwise(c)


def prefix(tok: Column, n: int, pad: str | None = None) -> Column:
    """The first n characters; of a shorter token all, or padded."""
    out = F.substring(tok, 1, n)
    return F.rpad(out, n, pad) if pad else out


def suffix(tok: Column, n: int, pad: str | None = None) -> Column:
    out = F.right(tok, F.lit(n))
    return F.rpad(out, n, pad) if pad else out


def case_class(tok: Column) -> Column:
    w = bare(tok)
    return first_of((w.rlike(r"^\p{Lu}$"), "singleCap"), (w.rlike(r"^\p{Lu}\p{Ll}"), "InitCap"), (w.rlike(r"^\p{Lu}+$"), "AllCap"), default="others")


def number_class(tok: Column, line_style: bool = False) -> Column:
    """What kind of number a token is. line_style puts the two ending classes of line models first. Every class but the last
    has a digit, so most tokens cost one search."""
    w = bare(tok)
    cases = [
        (w.rlike(r"^(19|20)\d\d$"), "year"),
        (tok.rlike("[0-9]-[0-9]"), "possiblePage"),
        (tok.rlike(r"\d\(\d+\)"), "possibleVol"),
        (w.rlike("^[0-9]$"), "1dig"),
        (w.rlike("^[0-9]{2}$"), "2dig"),
        (w.rlike("^[0-9]{3}$"), "3dig"),
        (w.rlike("^[0-9]+$"), "4+dig"),
        (w.rlike(r"^\d+(nd|rd|st|th)$"), "ordinal"),
        (w.rlike("[0-9]"), "hasDig"),
    ]
    if line_style:
        cases = [(tok.rlike(r"^[0-9]+\.$"), "endDot"), (tok.rlike("^[0-9]+:$"), "endCol"), *cases]
    return F.when(~tok.rlike("[0-9]"), "nonNum").otherwise(first_of(*cases, default="nonNum"))


def punct_class(tok: Column) -> Column:
    return first_of(
        (tok.rlike("^[\"'`]"), "leadQuote"),
        (tok.rlike("[\"'`][^s]?$"), "endQuote"),
        (tok.rlike("-.*-"), "multiHyphen"),
        (tok.rlike("[,:;-]$"), "contPunct"),
        (tok.rlike("[!?.\"']$"), "stopPunct"),
        (tok.rlike(r"^[(\[{<].+[)\]}>].?$"), "braces"),
        (tok.rlike(r"^\d{2,5}\(\d{2,5}\).?$"), "possibleVol"),
        default="others",
    )


def possible_editor(line: Column) -> Column:
    return F.when(line.rlike(r"[^a-zA-Z](editor|eds?\.)"), "possibleEditors").otherwise("noEditors")


def token_bin(at: Column, n: Column, bins: int = 12) -> Column:
    """Relative place of token at (from 0) of n, counting the two tags around them: the same order of double operations
    as the original feature."""
    return F.floor(at.cast("double") / (n + 1) * bins).cast("int")


def line_bin(at: Column, n: Column, bins: int = 8) -> Column:
    return F.concat(F.lit("POS-"), F.floor(at * bins / n).cast("string"))


def section_number(toks: Column) -> Column:
    """Whether a line begins like a numbered heading or a footnote."""
    t = F.coalesce(F.get(toks, F.lit(0)), F.lit(""))
    many = F.size(toks) > 1
    return first_of(
        (many & t.rlike(r"^[1-9](\.[1-9])\.?$"), "posSubsec"),
        (many & t.rlike(r"^[1-9](\.[1-9]){2}\.?$"), "posSubsubsec"),
        (many & t.rlike(rf"^[{W}](\.[1-9]){{2}}\.?$"), "posCategory"),
        (t.rlike(f"^[1-9][A-Za-z][{W}]*$"), "numFootnote"),
        (t.rlike("^[1-9](http|www)"), "numWebfootnote"),
        default="lineNumOthers",
    )


def line_punct(line: Column) -> Column:
    return first_of((line.rlike(rf"@[{W}]+\."), "possibleEmail"), (line.rlike("www|http"), "possibleWeb"), (line.rlike(r"\([0-9][0-9]?\)[\x09-\x0D\x20]*$"), "endNumbering"), default="linePunctOthers")


def word_bucket(toks: Column) -> Column:
    n = F.size(F.filter(toks, lambda t: t.rlike(r"^\p{P}*[A-Za-z]+\p{P}*$")))
    return let(n, lambda k: F.when(k >= 5, "5+Words").otherwise(F.concat(k.cast("string"), F.lit("Words"))))


def capital_pattern(toks: Column) -> Column:
    """Whether all long words of a line are capitalised, in initials or throughout."""

    def pattern(words: Column, long_: Column, caps: Column) -> Column:
        first = F.coalesce(F.get(toks, F.lit(0)), F.lit(""))
        numbered = first.rlike("[0-9]")
        short = F.size(words) - F.size(long_)
        skipped = short - F.when(numbered & (F.length(first) < 4) & ~first.rlike(r"^\p{P}*$"), 1).otherwise(0) > 0
        name = F.concat(F.when(skipped, "Most").otherwise("All"), F.when(F.exists(caps, lambda t: t.rlike("[a-z]")), "InitCaps").otherwise("CharCaps"))
        n = F.size(caps)
        return F.when((n == 0) | (n != F.size(long_)), "OthersCaps").when(numbered, F.concat(F.lit("number"), name)).when(n == 1, "OthersCaps").otherwise(name)

    def with_words(words: Column) -> Column:
        return let(F.filter(words, lambda t: F.length(t) >= 4), lambda long_: let(F.filter(long_, lambda t: t.rlike("^[A-Z][A-Za-z]*$")), lambda caps: pattern(words, long_, caps)))

    return let(F.filter(toks, lambda t: ~t.rlike(r"^\p{P}*$")), with_words)


def digit_ratio(tok: Column) -> Column:
    share = F.length(F.regexp_replace(tok, "[^0-9]", "")) / F.length(tok)
    return F.when(share >= 0.7, "High").when(share >= 0.4, "Medium").otherwise("Low")


def function_word_count(toks: Column, words: list[str]) -> Column:
    n = F.size(F.filter(toks, lambda t: F.lower(t).isin(words)))
    return let(n, lambda k: F.when(k == 0, "No").when(k <= 5, "Few").otherwise("Alot"))


def canonical(tok: Column) -> Column:
    """Token for n-grams: outer punctuation off, digits to 0, words of a mail's local part to x."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(tok, r"^\p{P}+", ""), r"\p{P}+$", ""), "[0-9]", "0")
    mail = rf"([{W}].*)@(.*\..*)"
    spelled = lambda x: F.concat(F.regexp_replace(F.regexp_extract(x, mail, 1), f"[{W}]+", "x"), F.lit("@"), F.regexp_extract(x, mail, 2))
    return let(t, lambda x: F.when(F.contains(x, F.lit("@")) & x.rlike(rf"[{W}].*@.*\."), spelled(x)).otherwise(x))


def ngrams(toks: Column, n: int, stop: list[str] | None = None, limit: int = 4) -> Column:
    """The first limit n-grams of a line that aren't digits only or function words. Every token is made canonical once, and
    of n > 1 no more tokens than the result can need: their hyphens keep such n-grams from being digits only."""
    words = F.filter(toks, lambda t: ~t.rlike(r"^\p{P}*$"))  # the others have nothing left
    if n > 1 and not any("-" in s for s in stop or []):
        words = F.slice(words, 1, limit + n - 1)

    def grams(t: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), "-")) if n > 1 else t
        ok = F.filter(made, lambda g: ~g.rlike("^[0-9]*$") & (~g.isin(stop) if stop else F.lit(True)))
        return F.when(F.size(t) < n, F.array().cast("array<string>")).otherwise(F.slice(ok, 1, limit))

    return let(F.transform(words, canonical), grams)


def edge_tokens(toks: Column) -> Column:
    """First, second, second-last and last token, EMPTY where there is none."""
    return F.struct(*[F.coalesce(F.try_element_at(toks, F.lit(i)), F.lit("EMPTY")).alias(n) for i, n in ((1, "first"), (2, "second"), (-2, "second_last"), (-1, "last"))])


def heading_decile(at: Column, n: Column) -> Column:
    """0 for the first heading, else the smallest k with at / (n - 1) <= k / 10."""
    return F.when((at == 0) | (n <= 1), 0).otherwise(F.ceil(at * 10 / F.nullif(n - 1, F.lit(0)))).cast("int")
