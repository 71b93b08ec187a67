"""Scanned pages as running text: reading order, broken words, letter shapes.

A page comes as lines of text and one box per line.  Columns are found from the left edges of the
boxes, a line that holds pieces of several columns is cut at its wide blanks, and words broken at a
line end are joined.  These are small per-page helpers; Spark distributes the pages (see
``leaks.py`` and ``abuse.py``).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

WIDE_BLANK = re.compile(r" {4,}")
COLUMN_STEP = 40  # left edges further apart than this belong to different columns
INSET = 7  # a line that begins this far inside its column is an advert
HYPHENS = "-­¬–‐‑"
# A hyphen at a line end is kept here until the next line is joined to it.
_BREAK = re.compile(rf"[{re.escape(HYPHENS)}]\s*\n\s*(?=\w)")
WORD = re.compile(r"[^\W_]+")

# Letters that scanners and writers put for one another, each class written as one
# letter; wide letters are written as the narrow ones that they break into.
_SHAPES = {
    "o": "oceau0qøω",
    "l": "lij1|!tıf7/",
    "n": "nr",
    "b": "bh6",
    "s": "s5$z2",
    "v": "vy4",
    "g": "g9",
    "nn": "m",
    "vv": "w",
    "ol": "d",
}


def _shape_table() -> dict[int, str]:
    table: dict[int, str] = {}
    for to, letters in _SHAPES.items():
        for letter in letters:
            table[ord(letter)] = to
    table[ord("u")] = "n"  # u and n are one shape upside down
    for source, to in {"ſ": "s", "ß": "ss", "æ": "ae", "œ": "oe", "@": "o"}.items():
        table[ord(source)] = "".join(table.get(ord(c), c) for c in to)
    for code in range(0xC0, 0x250):  # accents do not count
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalpha() and code not in table:
            table[code] = table.get(ord(base), base)
    for code in range(0x300, 0x370):
        table[code] = ""
    for hidden in ("​", "­", "﻿"):
        table[ord(hidden)] = ""
    table.update({ord("ﬁ"): "ll", ord("ﬂ"): "ll"})
    return table


SHAPES = _shape_table()


def fold_shapes(text: str) -> str:
    """Lower case, with letters that are mistaken for one another written alike."""
    return text.lower().translate(SHAPES)


# What a word can be made of before its letters are folded.
_RAW = re.compile("(?:[^\\W_]|[" + re.escape("".join(chr(c) for c in sorted(SHAPES))) + "])+")
REMEMBERED = 1 << 17  # words whose folded form is kept by a worker


class _Folds(dict):
    """Raw word to the words of its folded letters: one nearly always, else none or several."""

    def __missing__(self, raw: str) -> str | tuple[str, ...]:
        words = WORD.findall(fold_shapes(raw))
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = found = words[0] if len(words) == 1 else tuple(words)
        return found


_FOLDS = _Folds()


def folded_words(text: str) -> list[str]:
    """The words of ``fold_shapes(text)``; the same word is folded once only."""
    out = list(map(_FOLDS.__getitem__, _RAW.findall(text)))
    if tuple in set(map(type, out)):
        return [w for found in out for w in (found if isinstance(found, tuple) else (found,))]
    return out


def page_lines(text: str | None, x0, y0, x1) -> list[tuple[str, bool]]:
    """The lines of a page in reading order, each with whether it is inset (an advert).

    ``x0``, ``y0`` and ``x1`` are sequences over the lines; lines beyond the boxes, and pages without boxes,
    keep the order they come in.  Null and empty texts have no line.
    """
    if not text:
        return []
    lines = text.split("\n")
    n = min(len(lines), len(x0))
    rest = [(line, False) for line in lines[n:]]
    if n == 0:
        return rest
    edges = sorted(x0[:n])
    starts, members = [edges[0]], [[edges[0]]]
    for edge in edges[1:]:
        if edge - members[-1][-1] > COLUMN_STEP:
            starts.append(edge)
            members.append([])
        members[-1].append(edge)
    starts = [m[len(m) // 2] if len(m) > 2 else m[0] for m in members]
    bounds = [m[-1] for m in members]
    columns: dict[int, list] = {}
    if "    " not in text:
        if len(bounds) == 1:
            base = starts[0] + INSET
            return [(lines[i], x0[i] >= base) for i in sorted(range(n), key=y0.__getitem__)] + rest
        for i in range(n):
            c = 0
            x = x0[i]
            while x > bounds[c]:
                c += 1
            columns.setdefault(c, []).append((y0[i], i))
        return [(lines[i], x0[i] >= starts[c] + INSET) for c in sorted(columns) for _, i in sorted(columns[c])] + rest
    # Pieces of a merged line: the first begins at the box, the last ends with it.
    pieces = [WIDE_BLANK.split(lines[i].strip(" ")) for i in range(n)]
    most = max(map(len, pieces))
    if most == 1:
        for i in range(n):
            c = 0
            while x0[i] > bounds[c]:
                c += 1
            columns.setdefault(c, []).append((y0[i], pieces[i][0], x0[i] >= starts[c] + INSET))
        return [(p, ad) for c in sorted(columns) for _, p, ad in sorted(columns[c])] + rest
    width, last_left = _last_column([(len(pieces[i][-1]), x1[i]) for i in range(n) if len(pieces[i]) == most])
    lefts = [*starts, last_left]
    grouped: list[float] = []
    for left in sorted(lefts):
        if not grouped or left - grouped[-1] > COLUMN_STEP:
            grouped.append(left)
    while len(grouped) < most:  # a middle column that no line begins with
        grouped.insert(-1, (grouped[-2] + grouped[-1]) / 2 if len(grouped) > 1 else grouped[0] + 1)
    for i in range(n):
        row = pieces[i]
        first = min(range(len(grouped)), key=lambda c: abs(grouped[c] - x0[i]))
        first = min(first, len(grouped) - len(row))
        for j, piece in enumerate(row):
            c = first + j
            if j and j == len(row) - 1:
                at = x1[i] - width * len(piece)
                c = max(c, min(range(len(grouped)), key=lambda k: abs(grouped[k] - at)))
                inset = len(row) == most and at >= last_left + INSET + 1
            else:
                inset = j == 0 and x0[i] >= grouped[c] + INSET
            columns.setdefault(c, []).append((y0[i], piece, inset))
    return [(p, ad) for c in sorted(columns) for _, p, ad in sorted(columns[c], key=lambda t: t[0])] + rest


def reading_order(text: str | None, x0, y0, x1) -> str:
    """The lines of a page in reading order without the inset ones, joined by line feeds; empty for null."""
    return "\n".join([line for line, inset in page_lines(text, x0, y0, x1) if not inset])


def _last_column(rows: list[tuple[int, float]]) -> tuple[float, float]:
    """(width of a letter, left edge) of the last column, from the lengths and right edges of its pieces.

    A straight line through the points, drawn again without those that lie off it (adverts).
    """
    width, left = 9.0, 0.0
    for tolerance in (None, 12.0, 6.0):
        kept = rows if tolerance is None else [(k, x) for k, x in rows if abs(x - left - width * k) <= tolerance]
        m = len(kept)
        if not m:
            break
        mean_k, mean_x = sum(k for k, _ in kept) / m, sum(x for _, x in kept) / m
        spread = sum((k - mean_k) ** 2 for k, _ in kept)
        if spread:
            width = sum((k - mean_k) * (x - mean_x) for k, x in kept) / spread
        left = mean_x - width * mean_k
    return width, left


def join_broken(text: str) -> str:
    """Words broken at a line end are joined; other line ends become blanks."""
    return _BREAK.sub("", text).replace("\n", " ")


def _batch_lines(text_column, boxes_column) -> Iterator[list[tuple[str, bool]]]:
    """``page_lines`` of each row of an Arrow batch."""
    flat = boxes_column.flatten()  # without the boxes of null lists
    x0, y0, x1 = (flat.field(k).fill_null(0).to_pylist() for k in ("x0", "y0", "x1"))
    counts = boxes_column.value_lengths().fill_null(0).to_pylist()
    at = 0
    for text, n in zip(text_column.to_pylist(), counts):
        end = at + n
        yield page_lines(text, x0[at:end], y0[at:end], x1[at:end])
        at = end


def page_texts(text_column, boxes_column) -> Iterator[str]:
    """For an Arrow batch: the running text of each page without its inset lines (see ``join_broken``)."""
    if boxes_column is None:
        yield from (join_broken(text or "") for text in text_column.to_pylist())
        return
    for lines in _batch_lines(text_column, boxes_column):
        yield join_broken("\n".join([line for line, inset in lines if not inset]))


def page_readings(text_column, boxes_column) -> Iterator[list[str]]:
    """For an Arrow batch, the texts as which each page can be read: without its inset lines, these alone, and all
    lines in their places (a paragraph may begin with an inset line); the whole text alone where none is inset."""
    if boxes_column is None:
        yield from ([join_broken(text or "")] for text in text_column.to_pylist())
        return
    for lines in _batch_lines(text_column, boxes_column):
        whole = join_broken("\n".join([line for line, _ in lines]))
        if any(inset for _, inset in lines):
            yield [whole, *(join_broken("\n".join([line for line, inset in lines if inset == ad])) for ad in (False, True))]
        else:
            yield [whole]
