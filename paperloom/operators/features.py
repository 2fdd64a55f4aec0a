"""The token and line features again, in Python, for training and for decoding within an Arrow pass.

functions.lexical has the same features as columns; a test holds both against each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

_BARE = re.compile(r"[^\w]", re.U)
_LETTERS = re.compile(r"^[^\w\s]*[a-zA-Z]+[^\w\s]*$")


def bare(t: str) -> str:
    return _BARE.sub("", t) or "EMPTY"


def last_char(t: str) -> str:
    c = t[-1]
    return "a" if c.islower() else "A" if c.isupper() else "0" if c in "0123456789" else c


def case_class(t: str) -> str:
    w = bare(t)
    if len(w) == 1 and w.isupper():
        return "singleCap"
    if len(w) > 1 and w[0].isupper() and w[1].islower():
        return "InitCap"
    return "AllCap" if all(c.isupper() for c in w) else "others"


def number_class(t: str) -> str:
    w = bare(t)
    for test, name in ((re.fullmatch("(19|20)[0-9]{2}", w), "year"), (re.search("[0-9]-[0-9]", t), "possiblePage"), (re.search(r"[0-9]\([0-9]{1,}\)", t), "possibleVol"), (re.fullmatch("[0-9]", w), "1dig"), (re.fullmatch("[0-9]{2}", w), "2dig"), (re.fullmatch("[0-9]{3}", w), "3dig"), (re.fullmatch("[0-9]+", w), "4+dig"), (re.fullmatch("[0-9]+(nd|rd|st|th)", w), "ordinal"), (re.search("[0-9]", w), "hasDig")):
        if test:
            return name
    return "nonNum"


def punct_class(t: str) -> str:
    for pattern, name in (("^[\"'`]", "leadQuote"), ("[\"'`][^s]?$", "endQuote"), ("-.*-", "multiHyphen"), ("[,:;-]$", "contPunct"), ("[!?.\"']$", "stopPunct"), (r"^[(\[{<].+[)\]}>].?$", "braces"), (r"(?a)^\d{2,5}\(\d{2,5}\).?$", "possibleVol")):
        if re.search(pattern, t):
            return name
    return "others"


_NO_BITS = ["no"] * 6


@lru_cache(1 << 16)
def _token(t: str) -> tuple:
    """What depends on the token alone."""
    return (t, last_char(t), *(t[:k] for k in range(1, 5)), *(t[-k:] for k in range(1, 5))), bare(t).lower(), (case_class(t), number_class(t)), punct_class(t)


def token_rows(tokens: list[str], mask: dict[str, int] | None = None) -> list[list[str]]:
    """23 columns a token: surface, last character, prefixes, suffixes, bare lower case, case, number, dictionary mask and
    its six bits, editor, place, punctuation."""
    editor = "possibleEditors" if re.search(r"[^a-zA-Z](editor|eds?\.)", " ".join(tokens)) else "noEditors"
    out, n = [], len(tokens)
    for j, t in enumerate(tokens):
        head, low, kinds, punct = _token(t)
        m = (mask or {}).get(low, 0)
        bits = ["yes" if m & b else "no" for b in (1, 2, 4, 8, 16, 32)] if m else _NO_BITS
        out.append([*head, low, *kinds, str(m), *bits, editor, str(int((j + 1) / (n + 1) * 12)), punct])
    return out


def line_rows(lines: list[str]) -> list[list[str]]:
    """11 columns a line: text; first, second, second-last and last token; case of the first; length; place; digits; symbols;
    what a heading, reference, caption or mail would begin with or hold."""
    out, n = [], len(lines)
    for i, x in enumerate(lines):
        t = x.split() or ["EMPTY"]
        words = sum(bool(_LETTERS.match(w)) for w in t)
        caps = sum(w[:1].isupper() for w in t)
        cue = "mail" if "@" in x else "mark" if re.match(r"^\s*(\[\d+\]|\(\d+\)|\d+\.)\s", x) else "caption" if re.match(r"^(Figure|Table|Fig\.)\s", x) else "numbered" if re.match(r"^\d+(\.\d+)*\.?\s+[A-Z]", x) else "digits" if re.fullmatch(r"[\d\s]+", x) else "none"
        low = bare(t[0]).lower()
        place = str(i * 8 // n) if i >= 12 else f"top{i}"
        out.append([x, low, bare(t[1]).lower() if len(t) > 1 else "EMPTY", bare(t[-2]).lower() if len(t) > 1 else "EMPTY", bare(t[-1]).lower(), case_class(t[0]), "5+" if words >= 5 else str(words), place, "digits" if re.search(r"\d", x) else "plain", cue, "caps" if caps * 2 > len(t) else "lower"])
    return out


def heading_rows(headings: list[str]) -> list[list[str]]:
    """Relative place, first and second word, normalised heading; a leading number is skipped."""
    out, n = [], len(headings)
    for i, x in enumerate(headings):
        t = [w for w in x.lower().split() if not re.fullmatch(r"[\d.]+|[ivx]+\.", w)] or ["null"]
        decile = 0 if i == 0 or n < 2 else -(-i * 10 // (n - 1))
        out.append([str(decile), bare(t[0]), bare(t[1]) if len(t) > 1 else "null", "-".join(map(bare, t[:3]))])
    return out
