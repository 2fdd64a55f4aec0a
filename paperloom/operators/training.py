"""Made-up training material and the models trained from it.

No tagged corpus ships with the engine. These generators invent references, title pages and papers in several styles;
train() on a corpus of one's own gives better models for real documents.
"""

from __future__ import annotations

import random
from functools import lru_cache

from . import crf

FIRST = "Anna Bo Carla David Elif Farid Greta Hugo Ines Jun Karim Lena Mia Noor Omar Petra Qin Rosa Sven Tara Uma Vera Wei Yusuf Zoe".split()
LAST = "Abbas Berg Castillo Duval Eriksen Fontaine Gruber Haddad Ivanov Jansen Kowalski Lindqvist Moreau Nakata Okafor Petrov Quist Rossi Silva Tanaka Ueda Vargas Weiss Xu Yilmaz Zhang".split()
TOPIC = "parsing retrieval alignment clustering indexing translation summarisation tagging sampling caching scheduling learning ranking extraction inference annotation".split()
ADJ = "robust fast neural statistical incremental distributed adaptive shallow lexical probabilistic scalable efficient".split()
NOUN = "documents queries corpora graphs streams references sentences archives records tables lexicons networks dialogues treebanks".split()
VENUE = ["Journal of Text Studies", "Annals of Computing", "Language Letters", "Information Quarterly", "Transactions on Archives", "Data Review"]
MEETING = ["Proceedings of the Workshop on Text", "Proc. of the Meeting on Archives", "Proceedings of the Conference on Language", "International Symposium on Data"]
PUBLISHER = ["North Press", "Harbour Books", "University Press", "Meridian Publishers", "Springvale"]
CITY = ["Lisbon", "Oslo", "Kyoto", "Boston, MA", "Berlin, Germany", "Lima", "Toronto, Canada", "Nairobi"]
SCHOOL = ["University of Oslo", "Lisbon Institute of Technology", "Harbour College", "National University of Lima", "Department of Computer Science"]
SIGNAL = "*†‡§12345"


def _title(r: random.Random) -> str:
    t = r.choice([f"{r.choice(ADJ)} {r.choice(TOPIC)} of {r.choice(NOUN)}", f"on the {r.choice(TOPIC)} of {r.choice(ADJ)} {r.choice(NOUN)}", f"{r.choice(TOPIC)} and {r.choice(TOPIC)} for {r.choice(NOUN)}", f"a {r.choice(ADJ)} approach to {r.choice(TOPIC)}", f"towards {r.choice(ADJ)} {r.choice(TOPIC)} with {r.choice(NOUN)}"])
    return t.title() if r.random() < 0.4 else t[0].upper() + t[1:]


def _authors(r: random.Random, style: int) -> str:
    n = r.choice([1, 1, 2, 2, 3, 4])
    one = [lambda: f"{r.choice(FIRST)[0]}. {r.choice(LAST)}", lambda: f"{r.choice(LAST)}, {r.choice(FIRST)[0]}.", lambda: f"{r.choice(FIRST)} {r.choice(LAST)}", lambda: f"{r.choice(LAST)} {r.choice(FIRST)[0]}"][style % 4]
    names = [one() for _ in range(n)]
    return names[0] if n == 1 else ", ".join(names[:-1]) + r.choice([" and ", ", and ", " & "]) + names[-1]


def reference(r: random.Random) -> list[tuple[str, str]]:
    """A reference as (token, label)."""
    style, kind, year = r.randrange(4), r.choice(["journal", "journal", "meeting", "book", "report"]), str(r.randrange(1950, 2024))
    out: list[tuple[str, str]] = []

    def add(text: str, label: str) -> None:
        out.extend((t, label) for t in text.split())

    add(_authors(r, style) + ("," if style == 0 else "." if style != 1 else ""), "author")
    early = r.random() < 0.5
    if early:
        add(r.choice([f"({year}).", f"{year}.", f"({year})"]), "date")
    title = _title(r)
    add(r.choice([f'"{title},"', f"{title}.", f"{title},", f"{title}."]), "title")
    pages = f"{(a := r.randrange(1, 800))}-{a + r.randrange(1, 40)}"
    if kind == "journal":
        add(r.choice(VENUE) + r.choice(["", ",", "."]), "journal")
        add(r.choice([f"{r.randrange(1, 60)}({r.randrange(1, 12)}),", f"vol. {r.randrange(1, 60)},", f"{r.randrange(1, 60)}:", f"{r.randrange(1, 60)},"]), "volume")
        add(r.choice([f"pp. {pages}", f"pages {pages}", pages]) + ("." if early else ","), "pages")
    elif kind == "meeting":
        add(r.choice(["In ", "in: "]) + r.choice(MEETING) + ",", "booktitle")
        if r.random() < 0.6:
            add(f"pages {pages},", "pages")
        if r.random() < 0.7:
            add(r.choice(CITY) + r.choice([".", ","]), "location")
    elif kind == "book":
        add(r.choice(PUBLISHER) + ",", "publisher")
        if r.random() < 0.7:
            add(r.choice(CITY) + r.choice([".", ","]), "location")
    else:
        add(r.choice(["Technical Report TR-", "Tech. rep. "]) + str(r.randrange(10, 999)) + ",", "tech")
        add(r.choice(SCHOOL[:4]) + ",", "institution")
    if not early:
        add(r.choice([f"{year}.", f"({year}).", f"May {year}."]), "date")
    return out


def title_page(r: random.Random) -> list[tuple[str, str]]:
    """First lines of a paper as (line, label)."""
    out = [(_title(r).upper() if r.random() < 0.3 else _title(r), "title")]
    if r.random() < 0.3:
        out.append(("with " + r.choice(ADJ) + " " + r.choice(NOUN), "title"))
    for _ in range(r.choice([1, 1, 2])):
        out.append((r.choice([" and ", ", "]).join(f"{r.choice(FIRST)} {r.choice(LAST)}{r.choice(['', r.choice(SIGNAL)])}" for _ in range(r.choice([1, 2, 3]))), "author"))
        out.append((r.choice(["", r.choice(SIGNAL)]) + r.choice(SCHOOL), "affiliation"))
        if r.random() < 0.6:
            out.append((f"{r.randrange(1, 99)} {r.choice(['Hill', 'Park', 'Station'])} Road, {r.choice(CITY)}", "address"))
        if r.random() < 0.7:
            out.append((f"{r.choice(LAST).lower()}@{r.choice(['text', 'lab', 'cs'])}.example.edu", "email"))
    if r.random() < 0.3:
        out.append((f"{r.choice(['March', 'June', 'May'])} {r.randrange(1990, 2024)}", "date"))
    out.append((r.choice(["Abstract", "ABSTRACT"]), "abstract"))
    for _ in range(r.randrange(2, 5)):
        out.append((f"We study {r.choice(ADJ)} {r.choice(TOPIC)} of {r.choice(NOUN)} and show that it is {r.choice(ADJ)}.", "abstract"))
    if r.random() < 0.5:
        out.append((f"Keywords: {r.choice(TOPIC)}, {r.choice(TOPIC)}, {r.choice(NOUN)}", "keyword"))
    return out


HEADINGS = {"introduction": ["Introduction", "1 Introduction", "1. INTRODUCTION"], "method": ["2 Our Approach", "3 Model", "2. System Architecture", "Algorithm"], "evaluation": ["4 Experiments", "Evaluation", "5. Experimental Results"], "related_work": ["Related Work", "6 Related Work", "Previous Work"], "background": ["Background", "2 Preliminaries"], "discussions": ["Discussion", "7 Discussion"], "conclusions": ["Conclusions", "8 Conclusion and Future Work", "Conclusion"], "acknowledgments": ["Acknowledgments", "Acknowledgements"], "references": ["References", "REFERENCES", "Bibliography"], "abstract": ["Abstract"]}


def paper(r: random.Random) -> list[tuple[str, str]]:
    """A whole paper as (line, section label)."""
    out = [(t, {"abstract": "bodyText"}.get(y, y)) for t, y in title_page(r)]
    out = [(t, "sectionHeader" if t.lower() == "abstract" else y) for t, y in out]
    for kind in ["introduction", "background", "method", "evaluation", "related_work", "conclusions"]:
        if r.random() < 0.8:
            out.append((r.choice(HEADINGS[kind]), "sectionHeader"))
            for _ in range(r.randrange(2, 7)):
                out.append((f"The {r.choice(TOPIC)} of {r.choice(NOUN)} is {r.choice(ADJ)} [{r.randrange(1, 20)}] and so we use {r.choice(ADJ)} {r.choice(TOPIC)} here.", "bodyText"))
            if r.random() < 0.3:
                out.append((f"{r.randrange(2, 6)}.{r.randrange(1, 5)} {r.choice(ADJ).title()} {r.choice(TOPIC)}", "subsectionHeader"))
                out.append((f"We take {r.choice(NOUN)} and their {r.choice(TOPIC)} in turn.", "bodyText"))
            if r.random() < 0.25:
                out.append((f"Figure {r.randrange(1, 9)}: {r.choice(TOPIC)} of {r.choice(NOUN)}", "figureCaption"))
            if r.random() < 0.25:
                out.append((f"Table {r.randrange(1, 9)}: results on {r.choice(NOUN)}", "tableCaption"))
            if r.random() < 0.2:
                out.append((str(r.randrange(1, 30)), "page"))
    out.append((r.choice(HEADINGS["references"]), "sectionHeader"))
    for k in range(r.randrange(3, 9)):
        out.append((f"[{k + 1}] " + " ".join(t for t, _ in reference(r)), "reference"))
    return out


def headings(r: random.Random) -> list[tuple[str, str]]:
    out = []
    for kind in ["abstract", "introduction", "background", "method", "evaluation", "discussions", "related_work", "conclusions", "acknowledgments", "references"]:
        if r.random() < 0.75:
            out.append((r.choice(HEADINGS[kind]), kind))
            if kind == "method" and r.random() < 0.6:
                out.append((f"{r.choice(ADJ).title()} {r.choice(TOPIC)} of {r.choice(NOUN)}", "method"))
    return out


TOKEN_TEMPLATE = "\n".join(["B"] + [f"U{o + 2}{c}:%x[{o},{c}]" for c in (0, 10, 11, 12, 22) for o in (-2, -1, 0, 1, 2)] + [f"UA{c}:%x[0,{c}]" for c in (1, 2, 3, 4, 6, 7, 8, 13, 20, 21)] + ["UB0:%x[-1,11]/%x[0,11]", "UB1:%x[-1,22]/%x[0,12]"])
LINE_TEMPLATE = "\n".join(["B"] + [f"U{o + 1}{c}:%x[{o},{c}]" for c in range(1, 11) for o in (-1, 0, 1)] + ["UX:%x[0,1]/%x[0,6]"])


def seeded(make, n: int, seed: int) -> list:
    r = random.Random(seed)
    return [make(r) for _ in range(n)]


@lru_cache
def citation_model() -> crf.Model:
    from .features import token_rows

    return crf.train([(token_rows([t for t, _ in s]), [y for _, y in s]) for s in seeded(reference, 220, 1)], TOKEN_TEMPLATE, least=3, steps=40)


@lru_cache
def header_model() -> crf.Model:
    from .features import line_rows

    return crf.train([(line_rows([t for t, _ in s]), [y for _, y in s]) for s in seeded(title_page, 200, 2)], LINE_TEMPLATE, least=2)


@lru_cache
def section_model() -> crf.Model:
    from .features import line_rows

    return crf.train([(line_rows([t for t, _ in s]), [y for _, y in s]) for s in seeded(paper, 80, 3)], LINE_TEMPLATE, least=2)


@lru_cache
def heading_model() -> crf.Model:
    from .features import heading_rows

    return crf.train([(heading_rows([t for t, _ in s]), [y for _, y in s]) for s in seeded(headings, 150, 4)], "B\nU0:%x[0,0]\nU1:%x[0,1]\nU2:%x[0,2]\nU3:%x[0,3]\nU4:%x[-1,1]\nU5:%x[1,1]")
