"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from fixed patterns (e-mail, IPv4, card numbers with a Luhn check, international phone numbers) and always
stay. High-recall generators propose further candidates in the text between them: tokens that mix letters and digits, spaced
IBANs, and, from every group of digits on, phone-like, card-like and other grouped numbers, which overlap. Boosted trees
score a candidate from its format (length, digits, capitals, separators, Luhn check, ...) and its context (cue words before it);
those above the threshold become spans of kind secret or number. Of overlapping numbers the best score stays (ties: the
longest, then the first), and of the rest those that overlap no such number, chosen alike; numbers are sought outside of secrets.

The trees are trained here, on examples that a seeded generator makes; the threshold is the lowest at which held-out examples reach the target
precision. They are then one CASE expression. Only texts with a digit or an at sign are searched. Offsets are code points: running sums of the lengths
of matches and of what lies between them. All steps are linear in a text's length and spans, but for a sort: sums and maxima are
taken in two levels, pieces are cut from blocks of the text, and a number has a bounded length, so a bounded number of rivals.
"""

from __future__ import annotations

import random
import string
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linerules import let

# A match can't begin within a run that it would have had to begin with; without these guards long runs take quadratic
# time. Possessive repeats leave nothing to give back, and don't recurse.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# tokens with letters and digits, of six characters or more; IBANs in groups of four
TOKEN = r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{6,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
# numbers that begin at a group of digits, with an opening bracket if there is one, and end at a group's end
_OPEN, _END = r"(?:\(|(?<!\())", "(?![0-9A-Za-z])"
NUMBERS = (
    _OPEN + r"[0-9]{3}\)?[\x20.-]{1,2}[0-9]{2,3}[\x20.-][0-9]{4}" + _END,
    r"[0-9](?:[\x20-]?[0-9]){12,18}" + _END,
    _OPEN + r"[0-9](?:[\x20().-]{0,2}[0-9]){5,14}" + _END,
)
RIVALS = 30 * len(NUMBERS)  # a number has at most 45 characters or so, thus fewer groups
PIECE = 4096  # code points of a block of text
BASE = ("email", "ip", "card", "phone")
EXTRA = ("secret", "number")
CONTEXT = 24  # characters before a candidate that are searched for cue words
CUES = {"secret": r"(?i)(?:pass(?:word|wd|phrase)?|secret|token|api.?key|\bkey|credential|bearer|auth)\W*$", "number": r"(?i)(?:phone|tel|call|fax|mobile|ssn|social|passport|account|iban|id|nr|no)\W*$"}
FEATURES = ("length", "digits", "upper", "lower", "marks", "runs", "cue", "leading", "equal_tail", "hexed", "grouped", "fours", "luhn")
PRECISION = 0.995


# ---- positions


def running(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs the fold (0 at first) of those before it; two levels of 64, so long arrays stay
    near linear."""
    zero = F.lit(0).cast("long")

    def folds(v: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int")))
        total = lambda x: F.aggregate(x, zero, fold)
        of_chunk = F.transform(chunks, lambda j: total(F.slice(v, j * 64 + 1, 64)))
        starts = lambda c: F.transform(c, lambda _, j: F.when(j == 0, zero).otherwise(total(F.slice(c, 1, j))))
        return let(let(of_chunk, starts), lambda s: F.transform(v, lambda _, i: F.when(i % 64 == 0, F.get(s, F.shiftright(i, 6))).otherwise(fold(F.get(s, F.shiftright(i, 6)), total(F.slice(v, F.shiftright(i, 6) * 64 + 1, i % 64))))))

    return let(values, folds)


def before(values: Column) -> Column:
    """For each element the sum of those before it."""
    return running(values, lambda a, b: a + b)


_HITS = "array<struct<start:bigint,end:bigint,hit:string,before:string>>"


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern as structs (start, end, hit, before), in order; before: up to CONTEXT characters of the match
    before and what follows it."""

    def placed(pieces: Column, hits: Column) -> Column:
        gaps = F.transform(hits, lambda h, i: (F.length(F.get(pieces, i)) + F.length(h)).cast("long"))

        def one(at: Column, h: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(pieces, i))
            cue = F.right(F.concat(F.when(i > 0, F.get(hits, i - 1)).otherwise(""), F.get(pieces, i)), F.lit(CONTEXT))
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), cue.alias("before"))

        return let(before(gaps), lambda at: F.transform(hits, lambda h, i: one(at, h, i)))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) == 0, F.array().cast(_HITS)).otherwise(let(F.split(text, pattern, -1), lambda pieces: placed(pieces, hits))))


def found_from(text: Column, pattern: str) -> Column:
    """As found, for a pattern that is tried at every place behind anything but a letter or digit: matches may overlap."""
    place = "(?<![0-9A-Za-z])(?=({}))"
    led = F.concat(F.lit("\n"), text)  # a cut at the very beginning would leave no piece

    def placed(pieces: Column, hits: Column) -> Column:
        def one(at: Column, h: Column, i: Column) -> Column:
            start = F.get(at, i) + F.length(F.get(pieces, i)) - 1
            cue = F.right(F.concat(F.when(i > 0, F.get(pieces, i - 1)).otherwise(""), F.get(pieces, i)), F.lit(CONTEXT))
            return F.struct(start.alias("start"), (start + F.length(h)).alias("end"), h.alias("hit"), cue.alias("before"))

        return let(before(F.transform(pieces, lambda p: F.length(p).cast("long"))), lambda at: F.transform(hits, lambda h, i: one(at, h, i)))

    return let(F.regexp_extract_all(led, F.lit(place.format(pattern)), 1), lambda hits: F.when(F.size(hits) == 0, F.array().cast(_HITS)).otherwise(let(F.split(led, place.format(pattern), -1), lambda pieces: placed(pieces, hits))))


def blocks(text: Column) -> Column:
    """The text in blocks of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), 0)


def piece(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b of the text with these blocks, at a cost of its own length and that of two blocks."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
    return F.when(b > a, F.substr(F.array_join(F.slice(parts, i + 1, F.greatest(j - i + 1, F.lit(0))), ""), (a % PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")


def gaps(text: Column, spans: Column) -> Column:
    """What lies between spans (start, end), as structs (at, text)."""

    def between(s: Column, past: Column, parts: Column) -> Column:
        inner = F.transform(s, lambda x, i: F.struct(F.get(past, i).alias("at"), piece(parts, F.get(past, i), x["start"]).alias("text")))
        last = F.greatest(F.element_at(past, -1), F.element_at(s, -1)["end"])
        tail = let(last, lambda e: F.struct(e.alias("at"), piece(parts, e, F.length(text).cast("long")).alias("text")))
        return F.filter(F.concat(inner, F.array(tail)), lambda g: g["text"] != "")

    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    cut = let(ordered, lambda s: let(running(F.transform(s, lambda x: x["end"]), lambda a, b: F.greatest(a, b)), lambda past: let(blocks(text), lambda parts: between(s, past, parts))))
    return F.when(F.size(spans) == 0, F.array(F.struct(F.lit(0).cast("long").alias("at"), text.alias("text")))).otherwise(cut)


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    one = lambda i: F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 0, one(i)).otherwise(F.when(one(i) > 4, one(i) * 2 - 9).otherwise(one(i) * 2)))
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans (kind, start, end, hit) of the four base kinds, by kind as in BASE and then start."""
    octet = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"

    def card(h: Column) -> Column:
        d = digits_of(h)
        return F.when((F.length(d) >= 16) & (F.length(d) <= 19), luhn(d)).otherwise(False)

    def kind(name: str, needs: Column, pattern: str, ok: Callable[[Column], Column] | None) -> Column:
        hits = found(text, pattern)
        if ok is not None:
            hits = F.filter(hits, lambda x: ok(x["hit"]))
        empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,hit:string>>")
        return F.when(needs, F.transform(hits, lambda x: F.struct(F.lit(name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))).otherwise(empty)

    return F.concat(
        kind("email", F.contains(text, F.lit("@")), EMAIL, None),
        kind("ip", text.rlike(r"[0-9]\.[0-9]"), IP, lambda h: h.rlike(rf"^{octet}(?:\.{octet}){{3}}$")),
        kind("card", text.rlike(r"[0-9][\x20-]?[0-9]"), CARD, card),
        kind("phone", text.rlike(r"\+[0-9]"), PHONE, lambda h: F.length(digits_of(h)).between(8, 15)),
    )


# ---- features: the same numbers in Python, for training, and as columns

FOURS = r"[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-][0-9]{1,3})?"
_COUNTED = {"digits": "[^0-9]", "upper": "[^A-Z]", "lower": "[^a-z]", "marks": r"[A-Za-z0-9\x20]"}


def example_features(before_text: str, hit: str, kind: str) -> list[float]:
    import re

    f = {"length": len(hit), **{k: len(re.sub(p, "", hit)) for k, p in _COUNTED.items()}}
    f["runs"] = len(re.findall("[0-9]+", hit))
    f["cue"] = 1 if re.search("(?a)" + CUES[kind], before_text[-CONTEXT:]) else 0
    f["leading"] = 1 if re.match(r"AKIA|gh[pousr]_|sk-|xox[bp]-|eyJ|[A-Z]{2}[0-9]{2}", hit) else 0
    f["equal_tail"] = 1 if hit.endswith("=") else 0
    f["hexed"] = 1 if re.fullmatch("[0-9a-f]+|[0-9A-F]+", hit) else 0
    f["grouped"] = 1 if re.fullmatch(r"\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{2,3}[\x20.-][0-9]{4}", hit) else 0
    f["fours"] = 1 if re.fullmatch(FOURS, hit) else 0
    d = [int(c) for c in hit if c in "0123456789"]
    f["luhn"] = 1 if 13 <= len(d) <= 19 and len(d) + hit.count(" ") + hit.count("-") == len(hit) and sum(sum(divmod(c * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0 else 0
    return [float(f[k]) for k in FEATURES]


def column_features(before_text: Column, hit: Column, kind: str) -> Column:
    f = {"length": F.length(hit), **{k: F.length(F.regexp_replace(hit, p, "")) for k, p in _COUNTED.items()}}
    f["runs"] = F.size(F.regexp_extract_all(hit, F.lit("[0-9]+"), 0))
    f["cue"] = before_text.rlike(CUES[kind]).cast("int")
    f["leading"] = hit.rlike(r"^(?:AKIA|gh[pousr]_|sk-|xox[bp]-|eyJ|[A-Z]{2}[0-9]{2})").cast("int")
    f["equal_tail"] = hit.endswith("=").cast("int")
    f["hexed"] = hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int")
    f["grouped"] = hit.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{2,3}[\x20.-][0-9]{4}$").cast("int")
    f["fours"] = hit.rlike(f"^{FOURS}$").cast("int")
    f["luhn"] = F.when(hit.rlike(r"^[0-9](?:[\x20-]*[0-9]){12,18}$"), let(digits_of(hit), luhn)).otherwise(False).cast("int")
    return F.array(*[f[k].cast("double") for k in FEATURES])


def examples(kind: str, n: int, seed: int) -> list[tuple[list[float], int]]:
    """Made-up candidates with their label."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice(string.digits) for _ in range(k))
    alnum = lambda k, a: "".join(r.choice(a) for _ in range(k))

    def checked(n: int, sep: str) -> str:
        x = d(n - 1)
        total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(x)))
        x += str(-total % 10)
        return sep.join(x[i : i + 4] for i in range(0, n, 4))

    def unchecked(n: int) -> str:
        x = checked(n, "")
        return x[:-1] + str((int(x[-1]) + r.randrange(1, 10)) % 10)

    prose = ["and the ", "of 12 ", "see ", "", "in version ", "about ", "was, ", "chapter ", "Licensed under "]
    cue = {"secret": ["password=", "token: ", 'api_key = "', "secret key ", "Bearer ", 'token = "'], "number": ["phone ", "call ", "tel. ", "SSN ", "account no ", "Tel: "]}[kind]
    out = []
    for _ in range(n):
        good, cued = r.random() < 0.5, r.random() < 0.4
        if kind == "secret":
            if good:
                hit = r.choice([lambda: "AKIA" + alnum(16, string.ascii_uppercase + string.digits), lambda: alnum(r.choice([18, 20, 32, 40, 64]), "0123456789abcdef"), lambda: "ghp_" + alnum(36, string.ascii_letters + string.digits), lambda: alnum(r.randrange(20, 60), string.ascii_letters + string.digits + "+/") + "=", lambda: r.choice(["GB", "DE", "FR"]) + d(2) + alnum(4, string.ascii_uppercase) + d(14), lambda: r.choice(["GB", "DE", "FR", "NL", "ES"]) + d(2) + " " + " ".join(r.choice([d(4), alnum(4, string.ascii_uppercase)]) if not i else d(4) for i in range(r.randrange(3, 6))) + r.choice(["", " " + d(2)])])()
                if not any(c.isdigit() for c in hit):
                    hit += "7"
                cued = cued or r.random() < 0.5
            else:
                hit = r.choice([lambda: alnum(r.randrange(4, 12), string.ascii_lowercase) + d(r.randrange(1, 3)), lambda: "-".join(alnum(r.randrange(2, 9), string.ascii_lowercase) for _ in range(r.randrange(2, 6))) + "-" + d(1), lambda: d(4) + "-" + d(2) + "-" + d(2), lambda: d(r.randrange(6, 11)), lambda: alnum(1, string.ascii_uppercase) + alnum(7, string.ascii_lowercase) + d(2), lambda: "CC-BY-" + d(1), lambda: "http/" + alnum(12, string.ascii_lowercase) + d(1), lambda: alnum(r.randrange(6, 12), string.ascii_lowercase) + "/" + d(2), lambda: alnum(2, string.ascii_uppercase) + d(2) + " " + " ".join(alnum(4, string.ascii_uppercase) for _ in range(r.randrange(2, 4)))])()
                cued = cued and r.random() < 0.1
        elif good:
            hit = r.choice([lambda: f"({d(3)}) 555-{d(4)}", lambda: f"{d(3)}-555-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: d(r.randrange(9, 12)), lambda: checked(16, ""), lambda: checked(16, r.choice(" -"))])()
            cued = cued or hit.isdigit() and len(hit) < 16
        else:
            hit = r.choice([lambda: d(r.randrange(6, 16)), lambda: f"555-{d(4)}", lambda: f"{d(3)}-555", lambda: f"{d(4)} {d(3)}-555-{d(4)}", lambda: f"{d(4)} ({d(3)}) 555", lambda: f"555-{d(4)} {d(3)}-555", lambda: f"{d(2)}-{d(4)} {d(3)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: unchecked(r.randrange(13, 20)), lambda: f"{d(4)} {d(12)}", lambda: f"{d(4)} " + checked(13, ""), lambda: " ".join(d(3) for _ in range(r.randrange(4, 7))), lambda: f"{d(4)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(3)}", lambda: " ".join(d(r.randrange(1, 4)) for _ in range(r.randrange(4, 9))), lambda: f"{d(4)}-{d(4)}", lambda: f"{d(3)}.{d(5)}", lambda: f"{d(5)}.{d(2)}"])()
            cued = False
        out.append((example_features(r.choice(cue if cued else prose), hit, kind), int(good)))
    return out


def boost(rows: list[tuple[list[float], int]], trees: int = 24, depth: int = 3, rate: float = 0.3):
    """Gradient-boosted regression trees for the logistic loss, with second-order leaves. A tree is a nested tuple
    (feature, threshold, left, right) or a leaf's value; left is at or below the threshold."""
    import numpy as np

    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    total, forest = np.zeros(len(y)), []

    def grow(at, g, h, level):
        leaf = float(-rate * g[at].sum() / (h[at].sum() + 1.0))
        if level == depth or len(at) < 20:
            return leaf
        best = (1e-6, None)
        parent = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for t in (values[:-1] + values[1:]) / 2:
                left = x[at, f] <= t
                a, b = at[left], at[~left]
                gain = g[a].sum() ** 2 / (h[a].sum() + 1.0) + g[b].sum() ** 2 / (h[b].sum() + 1.0) - parent
                if gain > best[0]:
                    best = (gain, (f, float(t), a, b))
        if best[1] is None:
            return leaf
        f, t, a, b = best[1]
        return (f, t, grow(a, g, h, level + 1), grow(b, g, h, level + 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), 0)
        forest.append(tree)
        total += np.array([predict(tree, r) for r in x])
    return forest


def predict(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def total(forest, row) -> float:
    """The trees' sum in the order that the columns add them; sum() would round otherwise."""
    out = predict(forest[0], row)
    for tree in forest[1:]:
        out += predict(tree, row)
    return out


@lru_cache
def model(kind: str) -> tuple[tuple, float]:
    """The trees, and the least margin of a true held-out example down to which these reach PRECISION."""
    forest = boost(examples(kind, 1200, 17))
    held = sorted(((total(forest, row), label) for row, label in examples(kind, 1200, 18)), reverse=True)
    good, threshold = 0, held[0][0]
    for n, (score, label) in enumerate(held, 1):
        good += label
        tied = n < len(held) and held[n][0] == score
        if label and not tied and good >= PRECISION * n:
            threshold = score
    return tuple(forest), threshold


def margin(forest: tuple, f: Column) -> Column:
    def tree(t) -> Column:
        return F.when(F.get(f, F.lit(t[0])) <= F.lit(t[1]), tree(t[2])).otherwise(tree(t[3])) if isinstance(t, tuple) else F.lit(t)

    total = tree(forest[0])
    for t in forest[1:]:
        total = total + tree(t)
    return total


def settled(spans: Column) -> Column:
    """Of spans in the order of their starts, the best of all that overlap, then of the rest the best that overlap none of
    those. Only neighbours can overlap."""

    def best(all_: Column) -> Column:
        def rivals(i: Column) -> Column:
            return F.slice(all_, F.greatest(i - RIVALS, F.lit(0)) + 1, F.lit(2 * RIVALS + 1))

        def better(y: Column, x: Column) -> Column:
            n = lambda s: s["end"] - s["start"]
            return (y["score"] > x["score"]) | ((y["score"] == x["score"]) & ((n(y) > n(x)) | ((n(y) == n(x)) & (y["start"] < x["start"]))))

        return F.transform(all_, lambda x, i: F.struct((~F.exists(rivals(i), lambda y: _meet(x, y) & better(y, x))).alias("won"), x.alias("x")))

    def left(marked: Column) -> Column:
        """The spans that meet no winner, in order."""
        near = lambda i: F.slice(marked, F.greatest(i - RIVALS, F.lit(0)) + 1, F.lit(2 * RIVALS + 1))
        return F.transform(F.filter(F.transform(marked, lambda m, i: F.struct(m["x"].alias("x"), F.exists(near(i), lambda y: y["won"] & _meet(m["x"], y["x"])).alias("met"))), lambda m: ~m["met"]), lambda m: m["x"])

    won = lambda marked: F.transform(F.filter(marked, lambda m: m["won"]), lambda m: m["x"])
    both = lambda first: F.concat(won(first), let(left(first), lambda r: let(best(r), won)))
    return F.when(F.size(spans) < 2, spans).otherwise(let(best(spans), both))


def _meet(x: Column, y: Column) -> Column:
    return (y["start"] < x["end"]) & (x["start"] < y["end"])


def _judged(hits: Column, kind: str, at: Column) -> Column:
    """The candidates that score their kind's threshold or more; at: where the searched text begins."""
    forest, threshold = model(kind)
    score = lambda x: let(column_features(x["before"], x["hit"], kind), lambda f: margin(forest, f))
    made = F.transform(hits, lambda x: F.struct(score(x).alias("score"), (x["start"] + at).alias("start"), (x["end"] + at).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit")))
    return F.filter(made, lambda x: x["score"] >= threshold)


def secrets_in(g: Column) -> Column:
    hits = F.filter(found(g["text"], TOKEN), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]"))
    spaced = F.when(g["text"].rlike(r"[A-Z]{2}[0-9]{2}\x20[A-Z0-9]{4}\x20"), found(g["text"], IBAN)).otherwise(F.array().cast(_HITS))
    return _judged(F.concat(hits, spaced), "secret", g["at"])


def numbers_in(g: Column) -> Column:
    none = F.array().cast(_HITS)
    each = F.when(g["text"].rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){5}"), F.concat(*[found_from(g["text"], p) for p in NUMBERS])).otherwise(none)
    return let(_judged(each, "number", g["at"]), lambda v: F.when(F.size(v) < 2, v).otherwise(F.array_sort(F.array_distinct(v), _by_place)))


def with_spans(docs: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """The columns keep, t (the text), base and extra (its spans); text isn't null.

    A column a step: as one expression the steps would nest too deep for the analyser."""
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,hit:string>>")
    plain = lambda v: F.transform(v, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit")))
    out = docs.select(*keep, text.alias("t"))
    out = out.select(*keep, "t", F.when(F.col("t").rlike("[0-9@]"), base_spans(F.col("t"))).otherwise(empty).alias("base"))
    out = out.select("*", F.when(F.col("t").rlike("[0-9]"), gaps(F.col("t"), F.col("base"))).otherwise(F.array().cast("array<struct<at:bigint,text:string>>")).alias("near"))
    out = out.select("*", F.flatten(F.transform("near", secrets_in)).alias("secrets"))
    out = out.select(*keep, "t", "base", "secrets", F.when(F.size("secrets") == 0, F.col("near")).otherwise(gaps(F.col("t"), F.concat("base", plain(F.col("secrets"))))).alias("rest"))
    out = out.select(*keep, "t", "base", "secrets", F.transform("rest", numbers_in).alias("numbers"))
    numbers = F.flatten(F.transform("numbers", settled))
    return out.select(*keep, "t", "base", F.concat(F.array_sort(plain(F.col("secrets")), _by_place), F.array_sort(plain(numbers), _by_place)).alias("extra"))


def _by_place(x: Column, y: Column) -> Column:
    return F.signum(F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"])).cast("int")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs (doc_id, text).

    A null or empty text has no spans. Equal spans of two kinds (digits that are both a card and part of a phone number)
    are both listed. Rows without doc_id and repeated rows each give a row; an empty table gives an empty result; other
    columns are ignored.
    """
    rows = with_spans(docs, F.coalesce(docs["text"].cast("string"), F.lit("")), ["doc_id"])
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of a text replaced by its kind in angle brackets, as in <email>; overlapping spans become one mark,
    of the first kind. Null texts stay null. All columns stay as they are."""
    def cut(t: Column, spans: Column) -> Column:
        # a span whose start lies within an earlier one is part of it
        ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))

        def marked(s: Column, past: Column, parts: Column) -> Column:
            one = lambda x, e: F.when(x["start"] >= e, F.concat(piece(parts, e, x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
            tail = F.greatest(F.element_at(past, -1), -F.element_at(s, -1)["end"])
            return F.concat(F.array_join(F.transform(s, lambda x, i: one(x, F.get(past, i))), ""), let(tail, lambda e: piece(parts, e, F.length(t).cast("long"))))

        return let(ordered, lambda s: let(running(F.transform(s, lambda x: -x["end"]), lambda a, b: F.greatest(a, b)), lambda past: let(blocks(t), lambda parts: marked(s, past, parts))))

    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = with_spans(rows, F.coalesce(F.col("row.text").cast("string"), F.lit("")), ["row"])
    new = let(F.concat("base", "extra"), lambda a: F.when(F.size(a) == 0, F.col("t")).otherwise(cut(F.col("t"), a)))
    new = F.when(F.col("row.text").isNull(), F.lit(None).cast("string")).otherwise(new)
    return rows.select(*[new.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
