"""Abusive, hateful or sexually explicit language: a score for each page, and rates for each source.

The weighted phrases of ``lexicon.py`` are found by an Aho-Corasick automaton over the letters of a page.  The score is
the weight of a passage normalised by its length; phrases of harmless use have negative weights.

Digits, marks and foreign look-alikes stand for the letters they look like.  Misread letters stand for one another
only in phrases too long to be met by chance; in shorter ones every letter counts ("where" and "saw" are not the
words of abuse they resemble).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate, count
from operator import add

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.lexicon import INSULTS, SCORN, SLURS, lexicon
from strandmill.llm.pages import SHAPES, page_readings

#: A passage has at most SPAN letters; its weight counts for each FLOOR letters, and for one FLOOR if it is shorter.
SPAN, FLOOR, THRESHOLD = 200, 100, 1.5
#: Letters around a passage in which a harmless phrase tells against it.
NEAR = 40
#: Phrases of so many letters are met in spite of misread letters.
LONG = 9
#: Phrases of fewer letters are met only as words of their own (or spelt letter by letter).
SHORT = 6

# What writers put for a letter, and foreign letters of the same look.
_FOR = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "€": "e"}
_LOOKS = dict(zip("аеорсухіѕαοενρικ", "aeopcyxisaoevpik"))
_SHAPES = SHAPES | {ord(c): SHAPES.get(ord(to[0]), to[0]) for c, to in (_FOR | _LOOKS).items()} | {ord("k"): "l", ord("q"): "g"}
_PLAIN = {ord(c): to for c, to in zip("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")} | {ord(c): to for c, to in _LOOKS.items()} | {ord("ß"): "ss", ord("ſ"): "s", ord("æ"): "ae", ord("œ"): "oe", 0xAD: "", 0x200B: "", 0xFEFF: "", ord("ﬁ"): "fi", ord("ﬂ"): "fl"}
_STRETCHED = re.compile(r"(\w)\1\1+")
_SEPARATE = "-‐‑–—/'’_"
_ENDS = ".,;:!?\"()[]{}<>«»„“”‘…|&+=~^`"
_NO_LETTER = re.compile(r"[^a-z ]+")
_MARK = re.compile(r"[^a-z0-9@$!|€]")


def _words(text: str) -> list[str]:
    text = _STRETCHED.sub(r"\1", text.lower())
    for mark in _SEPARATE:
        text = text.replace(mark, " ")
    return [w.strip(_ENDS) for w in text.split()]


def _plain(words: list[str]) -> str:
    return "".join(words).translate(_PLAIN)


def _shape(text: str) -> str:
    return _NO_LETTER.sub("", text.translate(_SHAPES))


class Lexicon:
    """Two automata over phrases by shape: short ones between blanks, others over the letters alone.

    Each key leads to its length and, of the phrases of that shape, (number, weight, letters, censored).
    """

    def __init__(self, weights: dict[str, float] | None = None):
        short: dict[str, list[tuple[int, float, str, bool]]] = {}
        joined: dict[str, list[tuple[int, float, str, bool]]] = {}
        for number, (phrase, weight) in enumerate((lexicon() if weights is None else weights).items()):
            words = _words(phrase)
            plain = _plain(words)
            value = (number, weight, plain, False)
            if len(plain) < SHORT:
                short.setdefault(f" {_shape(' '.join(words))} ", []).append(value)
                if len(words) == 1:
                    short.setdefault(f" {' '.join(map(_shape, plain))} ", []).append(value)
            else:
                joined.setdefault(_shape("".join(words)), []).append(value)
            if phrase in _CENSORED:  # a mark in place of a letter
                for i in range(1, len(plain) - 1):
                    rest = plain[:i] + plain[i + 1 :]
                    short.setdefault(f" {_shape(rest)} ", []).append((number, weight, rest, True))
        self.short, self.joined = ahocorasick.Automaton(), ahocorasick.Automaton()
        for trie, entries in ((self.short, short), (self.joined, joined)):
            for shape, found in entries.items():
                if shape.strip():
                    trie.add_word(shape, (len(shape), found))
            trie.make_automaton()


_CENSORED = {w for w in (*SLURS, *INSULTS, *SCORN) if len(w) >= 4}


def _stands_for(said: str, phrase: str) -> bool:
    """Whether ``said`` is the phrase with less than half of its letters written as digits or marks."""
    if len(said) != len(phrase):
        return False
    swaps = 0
    for a, b in zip(said, phrase):
        if a != b:
            if b not in _FOR.get(a, ""):
                return False
            swaps += 1
    return 2 * swaps < len(phrase)


def _hits(text: str, known: Lexicon) -> Iterator[tuple[int, int, int, float]]:
    """(begin, end, number, weight) of the phrases of a text, in letters without blanks.

    Stretched letters count once.  Words spelt letter by letter, torn apart or run together read as usual; a mark
    inside a word stays there, where it tells that the word is disguised.
    """
    words = _words(text)
    pieces = _shape(" ".join(words)).split(" ")
    edges = list(accumulate(map(len, pieces), initial=0))
    spaced = f" {' '.join(pieces)} "
    found = []
    if known.short:
        blanks: list[int] = []  # the place before each word
        for end, (length, entries) in known.short.iter(spaced):
            blanks = blanks or list(map(add, edges, count()))
            found.append((bisect_left(blanks, end + 1 - length), bisect_left(blanks, end), entries))
    if known.joined:
        for end, (length, entries) in known.joined.iter("".join(pieces)):
            first, last = bisect_left(edges, end + 1 - length), bisect_left(edges, end + 1)
            if edges[first] == end + 1 - length and edges[last] == end + 1:
                found.append((first, last, entries))
    for first, last, entries in found:
        said = _plain(words[first:last])
        bare = _MARK.sub("", said)
        for number, weight, phrase, censored in entries:
            if bare == phrase if censored and bare != said else not censored and (len(phrase) >= LONG or bare == phrase or _stands_for(bare, phrase)):
                yield edges[first], edges[last], number, weight


def page_score(text: str, known: Lexicon, span: int = SPAN, floor: int = FLOOR) -> tuple[float, float]:
    """(peak, density): the greatest weight for each ``floor`` letters of a passage, and of the page, for each thousand.

    A passage begins and ends with a phrase and has at most ``span`` letters; one shorter than ``floor`` counts as
    that long.  A harmless phrase spares the words in it, and one
    without any (a report of abuse) takes its weight from passages within NEAR letters.  Of a phrase that recurs in a passage, one counts.
    """
    hits = sorted(_hits(text, known))
    harmless = [h for h in hits if h[3] < 0]
    bad = [h for h in hits if h[3] > 0]
    if harmless:
        spared = [h for h in bad if any(b < h[1] and h[0] < e for b, e, *_ in harmless)]
        harmless = [x for x in harmless if not any(b < x[1] and x[0] < e for b, e, *_ in spared)]
        bad = [h for h in bad if h not in spared]
    peak = 0.0
    for first, (begin, *_) in enumerate(bad):
        seen: set[int] = set()
        weight, stop = 0.0, begin
        for start, end, number, more in bad[first:]:
            if start - begin > span:
                break
            if end - begin > span or number in seen:
                continue
            seen.add(number)
            weight += more
            stop = max(stop, end)
            score = weight * floor / max(floor, stop - begin)
            if score > peak:
                less = {n: w for b, e, n, w in harmless if e > begin - NEAR and b < stop + NEAR}
                peak = max(peak, (weight + sum(less.values())) * floor / max(floor, stop - begin))
    total = sum(h[3] for h in bad)
    return peak, 1000 * total / max(1, len(text))


def score_pages(
    documents: DataFrame, key: str = "doc_id", text: str = "text", boxes: str | None = "boxes", keep: tuple[str, ...] = (),
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """(``key``, ``keep``, peak, density) for every page, in one narrow pass over the whole texts (see ``page_score``).

    ``weights`` is another lexicon, phrase to weight.  Null, empty and blank texts score 0; a row comes out for each row that goes in, also of repeated or null keys;
    an empty table gives an empty one.  ``boxes`` gives the reading order of the lines (None: as they stand); inset
    lines are read in their place, left out and read alone, and the greatest peak counts.
    """
    kinds = dict(documents.dtypes)
    kept = [key, *[c for c in keep if c != key]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(weights)
        for batch in batches:
            at = len(kept)
            places = batch.column(at + 1) if boxes else None
            scores = []
            for readings in page_readings(batch.column(at), places):
                found = [page_score(t, known) for t in readings]
                scores.append((max(p for p, _ in found), found[0][1]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array([p for p, _ in scores], pa.float64()), pa.array([d for _, d in scores], pa.float64())],
                [*kept, "peak", "density"],
            )

    columns = [F.col(f"`{c}`") for c in kept] + [F.col(f"`{text}`").cast("string").alias("__text")] + ([F.col(f"`{boxes}`").alias("__boxes")] if boxes else [])
    return documents.select(*columns).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "peak double", "density double"]))


def excluded_pages(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scores.filter(F.col("peak") >= threshold)


def rates(scores: DataFrame, by: str, threshold: float = THRESHOLD) -> DataFrame:
    """(``by``, n_pages, n_excluded, rate) for each value, null among them; combined before the shuffle."""
    bad = F.count_if(F.col("peak") >= threshold)
    return scores.groupBy(by).agg(F.count("*").alias("n_pages"), bad.alias("n_excluded"), (bad / F.count("*")).alias("rate"))
