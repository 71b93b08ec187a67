"""Held-out test items printed in a corpus of pages, whole or in part.

Word n-grams of the items are looked for in every page and counted over all pages.  The rare ones, ranked within each
stretch of an item, join pages to items: a pair that has enough n-grams to go on has rare ones among them, however
often the item is reprinted.  It goes on where its n-grams follow one another on both sides.  Smith-Waterman alignment
then finds what is printed in spite of misread letters and of text set in between, and a pair is found if enough
consecutive words of the item are printed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.pages import folded_words, page_texts
from strandmill.session import cut

GRAM = 3  # words in a seed
BAND = 16  # words that a misread or cut stretch may shift a quotation
MIN_COVERED = 10  # candidate: so many of MIN_WORDS consecutive words of the item under seeds
MIN_WORDS = 16
#: MIN_COVERED words take at least so many seeds, all beginning in a stretch of MIN_WORDS + GRAM - 1 words.  So of any
#: such stretch the COMMON commonest seeds need not be looked up: a candidate has LEAST others there.
FEWEST, COMMON = -(-MIN_COVERED // GRAM), 2
LEAST = FEWEST - COMMON
STRETCH = MIN_WORDS + GRAM - 1
JUMP = 3  # words that a step over more than BAND words of other text counts less
REACH = MIN_WORDS - MIN_COVERED + GRAM  # item words from one seed of a candidate to the next, at most
MAX_ADVERT = 24  # words of other text that may stand within a quotation; more, where as many words are printed around it
PIECE = 3  # printed words between two insertions, at least
BLOCK_BYTES = 4_000_000  # bytes of items held by the driver and the workers at a time
LETTERS = 64  # of a word that are compared at once
CELLS = 1_000_000  # places of alignment matrices filled at a time

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _gram_keys(ids: np.ndarray) -> np.ndarray:
    """A 64-bit key for each run of GRAM word numbers (0: a word that no item has)."""
    n = len(ids) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = np.zeros(n, np.uint64)
    known = np.ones(n, bool)
    for i in range(GRAM):
        part = ids[i : i + n]
        known &= part > 0
        key = (key ^ part.astype(np.uint64)) * _MIX
        key ^= key >> np.uint64(29)
    return np.where(known, key.view(np.int64), 0)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The values of a sorted array, once each."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


class Items:
    """The words and seeds of a block of test items; seeds are numbered."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words = {i: folded_words(text) for i, text in rows}
        self.words = {i: words for i, words in self.words.items() if len(words) >= MIN_WORDS}
        self.number: dict[str, int] = {}
        self.ids = list(self.words)
        keys = []
        for words in self.words.values():
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.int64)
            # No stretch of MIN_WORDS lies in two items.
            keys.append(np.concatenate([_gram_keys(ids), np.zeros(GRAM - 1 + MIN_WORDS, np.int64)]))
        key = np.concatenate([np.empty(0, np.int64), *keys])
        self.starts = np.cumsum([0, *map(len, keys)])
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        self.sorted, seed = np.unique(key, return_inverse=True)  # key 0 of the spots without a seed among them
        self.seed = np.where(key == 0, -1, seed)
        self.rare = np.arange(len(self.sorted))
        self._index(self.seed >= 0)

    def _index(self, looked_up: np.ndarray) -> None:
        """Number the spots of each seed that joins pages to items."""
        spots = np.flatnonzero(looked_up)
        spots = spots[np.argsort(self.seed[spots], kind="stable")]
        self.spots, self.count = spots, np.bincount(self.seed[spots], minlength=len(self.sorted))
        self.first = np.cumsum(self.count) - self.count

    def keep_rare(self, pages: np.ndarray) -> None:
        """Given in how many pages each seed is, look up by a seed at a spot only where it is not among the COMMON
        commonest of every stretch that holds the spot.  Ranks, not counts, decide; so no size or reprint matters."""
        order = np.where(self.seed >= 0, pages[self.seed] * len(self.sorted) + self.seed, -1)
        if len(order) < STRETCH:
            return
        rows = np.lib.stride_tricks.sliding_window_view(order, STRETCH)
        bound = np.full(len(order), -1, order.dtype)  # the highest rank with which a spot is looked up
        limit = np.concatenate([np.partition(part, -COMMON - 1, axis=1)[:, -COMMON - 1] for part in np.array_split(rows, max(1, len(rows) // 100_000))])
        for i in range(STRETCH):
            np.maximum(bound[i : i + len(limit)], limit, out=bound[i : i + len(limit)])
        self._index((self.seed >= 0) & (order <= bound))

    def seeds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(seed numbers, places) of the seeds of items in a page, given by its folded words."""
        get = self.number.get
        keys = _gram_keys(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        at = np.flatnonzero(keys)
        if not len(at) or not len(self.sorted):
            return at[:0], at[:0]
        found = keys[at]
        place = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
        ok = self.sorted[place] == found
        return place[ok], at[ok]

    def candidates(self, seeds: np.ndarray, at: np.ndarray) -> list[tuple[int, set[int]]]:
        """(item_id, offsets of its seeds) for the items that a page, given by its ``seeds``, may print."""
        count = self.count[seeds]
        total = np.cumsum(count)
        if not len(total) or not total[-1]:
            return []
        rare = _distinct(np.sort(self.spots[np.repeat(self.first[seeds] - total + count, count) + np.arange(total[-1])]))
        # Spots of two items are further apart than a stretch.
        asked = _distinct(self.owner[rare[LEAST - 1 :][rare[LEAST - 1 :] - rare[: len(rare) - LEAST + 1] < STRETCH]])
        if not len(asked):
            return []
        # All seeds of the items asked for, rare or not, are compared with the page's.
        sizes = self.starts[asked + 1] - self.starts[asked]
        end = np.cumsum(sizes)
        spots = np.repeat(self.starts[asked] - end + sizes, sizes) + np.arange(end[-1])
        order = np.argsort(seeds, kind="stable")
        seeds, at = seeds[order], at[order]
        low = np.searchsorted(seeds, self.seed[spots])
        printed = seeds[np.minimum(low, len(seeds) - 1)] == self.seed[spots]
        spots, low = spots[printed], low[printed]
        if not len(spots):
            return []
        width = np.full(len(spots), GRAM)
        np.minimum(spots[1:] - spots[:-1], GRAM, out=width[:-1])
        total = np.cumsum(width)
        covered = np.repeat(spots - total + width, width) + np.arange(total[-1])
        near = MIN_COVERED - 1
        rich = covered[:-near][covered[near:] - covered[:-near] < MIN_WORDS]
        if not len(rich):
            return []
        chosen = _distinct(self.owner[rich])
        keep = chosen[np.minimum(np.searchsorted(chosen, self.owner[spots]), len(chosen) - 1)] == self.owner[spots]
        spots, low = spots[keep], low[keep]
        many = np.searchsorted(seeds, self.seed[spots], "right") - low
        total = np.cumsum(many)
        at = at[np.repeat(low - total + many, many) + np.arange(total[-1])]
        spots = np.repeat(spots, many)
        order = np.lexsort((at, spots))
        spots, at = spots[order], at[order]
        ends = np.searchsorted(self.owner[spots], chosen, "right").tolist()
        begin, out = 0, []
        places, at = spots.tolist(), at.tolist()
        for item, end in zip(chosen.tolist(), ends):
            offsets = _ordered(places[begin:end], at[begin:end], int(self.starts[item]))
            if offsets:
                out.append((self.ids[item], offsets))
            begin = end
        return out


def _ordered(spots: list[int], at: list[int], start: int) -> set[int]:
    """The offsets of the seeds in chains that cover MIN_COVERED words of the item in the page's order.

    Seeds come by place in the item.  A step to another diagonal costs one word, and JUMP beyond BAND, however far it goes.
    """
    score: list[int] = []
    back: list[int] = []
    for x, (q, p) in enumerate(zip(spots, at)):
        best, before = GRAM, -1
        for y in range(x - 1, -1, -1):
            step = q - spots[y]
            if step > REACH:
                break
            ahead = p - at[y]
            if step and ahead > 0:
                value = score[y] + min(step, GRAM) - (0 if -3 < ahead - step < 3 else 1 if -BAND < ahead - step < BAND else JUMP)
                if value > best:
                    best, before = value, y
        score.append(best)
        back.append(before)
    used: set[int] = set()
    for x, value in enumerate(score):
        if value >= MIN_COVERED:
            while x >= 0 and x not in used:
                used.add(x)
                x = back[x]
    return {at[x] - spots[x] + start for x in used}


@lru_cache(1 << 18)
def alike(a: str, b: str) -> bool:
    """Whether two folded words can be one word misread: equal but for a stretch of at most two fifths."""
    if a == b:
        return True
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if least < 3 or most - least > 2 + most // 4:
        return False
    head = 0
    while head < least and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < least - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return (head + tail) * 5 >= most * 3


def align(pairs: list[tuple[list[str], list[str], int, int]]) -> list[list[int]]:
    """Local alignments (Smith-Waterman) of (item, page, low, high), both as folded words: for each item word its page
    word, or -1.

    Equal words score 2 and misread ones 1, others -2; a word left out costs 1, and text in between on the page
    2 and a twentieth a word, so that an advert does not end a quotation.  Misread words are looked for where page and
    item place differ by ``low`` to ``high``.  The matrices of all pairs are filled together, row by row.
    """
    step, skip, leave = 0.05, 2.0, 1.0
    count, n, m = len(pairs), max(len(p[0]) for p in pairs), max(len(p[1]) for p in pairs)
    gain = np.full((n, count, m), -1e6)
    words = _Words([w for item, page, *_ in pairs for w in (*item, *page)])
    for x, (item, page, low, high) in enumerate(pairs):
        gain[: len(item), x, : len(page)] = words.gains(item, page, low, high)
    place = np.arange(m + 1, dtype=np.int32)
    ramp = place * step
    score = np.zeros((count, m + 1))
    moves = np.zeros((n + 1, count, m + 1), np.int8)  # 0 stop, 1 both, 2 item word left out, 3 page words skipped
    origin = np.zeros((n + 1, count, m + 1), np.int32)  # where a skip began
    best, ends = np.zeros(count), np.zeros((count, 2), int)
    for i in range(1, n + 1):
        both = np.zeros((count, m + 1))
        both[:, 1:] = score[:, :-1] + gain[i - 1]
        row = np.maximum(np.maximum(both, score - leave), 0)
        move = np.where(row <= 0, 0, np.where(row == both, 1, 2))
        raised = row + ramp
        top = np.maximum.accumulate(raised, axis=1)
        first = np.maximum.accumulate(np.where(raised >= top, place, 0), axis=1)
        skipped = top - ramp - skip
        use = skipped > row
        score = np.where(use, skipped, row)
        moves[i], origin[i] = np.where(use, 3, move), first
        j = score.argmax(axis=1)
        high_score = score[np.arange(count), j]
        better = high_score > best
        best[better] = high_score[better]
        ends[better, 0], ends[better, 1] = i, j[better]
    out = []
    for x, (item, *_) in enumerate(pairs):
        match = [-1] * len(item)
        i, j = map(int, ends[x])
        while i and j and moves[i, x, j]:
            if moves[i, x, j] == 1:
                if gain[i - 1, x, j - 1] > 0:
                    match[i - 1] = j - 1
                i, j = i - 1, j - 1
            elif moves[i, x, j] == 2:
                i -= 1
            else:
                j = int(origin[i, x, j])
        out.append(match)
    return out


class _Words:
    """Words by number, with their letters from either end."""

    def __init__(self, words: list[str]):
        self.number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.words = list(self.number)
        self.size = np.array([len(w) for w in self.words])
        self.width = min(LETTERS, int(self.size.max()))
        letters = lambda words: np.array(words, f"U{self.width}").view(np.uint32).reshape(len(words), self.width)
        self.head, self.tail = letters(self.words), letters([w[::-1] for w in self.words])

    def gains(self, item: list[str], page: list[str], low: int, high: int) -> np.ndarray:
        """What each item word gains on each page word (see ``align``)."""
        a = np.fromiter(map(self.number.__getitem__, item), np.int64, len(item))
        b = np.fromiter(map(self.number.__getitem__, page), np.int64, len(page))
        equal = a[:, None] == b[None, :]
        shift = np.arange(len(page)) - np.arange(len(item))[:, None]
        near = (shift >= low - 3) & (shift <= high + 3)
        rows, columns = np.nonzero(near & ~(equal & near).any(axis=1)[:, None])
        gain = np.where(equal, 2.0, -2.0)
        like = self.alike(a[rows], b[columns])
        gain[rows[like], columns[like]] = 1.0
        return gain

    def alike(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """``alike`` of unequal words by their numbers."""
        most, least = np.maximum(self.size[x], self.size[y]), np.minimum(self.size[x], self.size[y])
        maybe = np.flatnonzero(
            (least >= 3) & (most - least <= 2 + most // 4) & ((self.head[x, 0] == self.head[y, 0]) | (self.tail[x, 0] == self.tail[y, 0]))
        )
        out = np.zeros(len(x), bool)
        x, y, most, least = x[maybe], y[maybe], most[maybe], least[maybe]
        head = np.minimum(np.logical_and.accumulate(self.head[x] == self.head[y], axis=1).sum(axis=1), least)
        tail = np.minimum(np.logical_and.accumulate(self.tail[x] == self.tail[y], axis=1).sum(axis=1), least - head)
        out[maybe] = (head + tail) * 5 >= most * 3
        for i in np.flatnonzero(most > self.width).tolist():
            out[maybe[i]] = alike(self.words[x[i]], self.words[y[i]])
        return out


def printed_run(item: list[str], page: list[str], match: list[int]) -> int:
    """The most consecutive words of the item that the page prints, given their alignment.

    Words that were run together or torn apart count as printed when their letters are those of the item.  Of text set
    in between there may be any number of insertions, with PIECE printed words or more between two.
    """
    run = piece = 0
    parts: list[tuple[int, int | None]] = []  # printed words, and words of other text before them (None: another quotation)
    other: int | None = None
    last = None  # the last printed item word
    for i, k in enumerate(match):
        if k < 0:
            continue
        if last is None:
            run = piece = 1
        else:
            before = match[last]
            gap, between = i - last - 1, k - before - 1
            if gap and _same_letters(item[last : i + 1], page[before : k + 1]):
                run, piece = run + gap + 1, piece + gap + 1
            elif gap or (between > 2 and piece < PIECE):
                parts.append((run, other))
                run = piece = 1
                other = None
            elif between > MAX_ADVERT:
                parts.append((run, other))
                run = piece = 1
                other = between
            elif between > 2:
                run, piece = run + 1, 1
            else:
                run, piece = run + 1, piece + 1
        last = i
    best = whole = 0
    for n, between in [*parts, (run, other)]:
        whole = whole + n if between is not None and between <= whole + n else n
        best = max(best, whole)
    return best


def _same_letters(item: list[str], page: list[str]) -> bool:
    """Whether words between two printed ones are there after all, misread or divided otherwise.

    Both lists begin and end with the printed words.
    """
    if len(page) > len(item) + 2:
        return False
    if alike("".join(item[1:-1]), "".join(page[1:-1])):
        return True
    return SequenceMatcher(None, "".join(item), "".join(page), autojunk=False).ratio() >= 0.93


def _seeds(pages: DataFrame, items: Items, key: str, kind: str) -> DataFrame:
    """(key, seeds, places): the seeds of items in each page that has any, in one narrow pass over the texts."""
    shared = pages.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows, seeds, places = [], [], []
            boxes = batch.column(2) if batch.num_columns > 2 else None
            for r, text in enumerate(page_texts(batch.column(1), boxes)):
                seed, at = block.seeds(folded_words(text))
                if len(seed):
                    rows.append(r)
                    seeds.append(seed.astype(np.int32))
                    places.append(at.astype(np.int32))
            if rows:
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                ends = pa.array(np.cumsum([0, *map(len, seeds)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), pa.int32())) for x in (seeds, places)]
                yield pa.RecordBatch.from_arrays([keys, *lists], [key, "seeds", "places"])

    return pages.mapInArrow(run, f"`{key}` {kind}, seeds array<int>, places array<int>")


def _candidates(seeds: DataFrame, items: Items, key: str, kind: str) -> DataFrame:
    """(key, item_id, offsets) for the pairs that are worth an alignment."""
    shared = seeds.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            rows, ids, offsets = [], [], []
            ends = batch.column(1).offsets.to_numpy()
            all_seeds, all_places = (batch.column(x).values.to_numpy() for x in (1, 2))
            for r in range(batch.num_rows):
                here = slice(ends[r], ends[r + 1])
                for item, found in block.candidates(all_seeds[here], all_places[here]):
                    rows.append(r)
                    ids.append(item)
                    offsets.append(sorted(found))
            if rows:
                keys = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.int64()), pa.array(offsets, pa.list_(pa.int32()))], [key, "item_id", "offsets"])

    return seeds.mapInArrow(run, f"`{key}` {kind}, item_id bigint, offsets array<int>")


def _verified(candidates: DataFrame, items: Items, key: str, kind: str, min_words: int) -> DataFrame:
    """Rows (key, text, boxes, cands array<struct<item_id, offsets>>) to (key, item_id, n_words)."""
    shared = candidates.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            boxes = batch.column(2) if batch.num_columns > 3 else None
            todo = []  # (row, item, its words, the page's, least, greatest offset)
            for r, (text, pairs) in enumerate(zip(page_texts(batch.column(1), boxes), batch.column(batch.num_columns - 1).to_pylist())):
                words = folded_words(text)
                for pair in pairs:
                    item = block.words[pair["item_id"]]
                    for low, high, least, most in _windows(pair["offsets"], len(item), len(words)):
                        todo.append((r, pair["item_id"], item, words[low:high], least - low, most - low + BAND))
            lengths: dict[tuple[int, int], int] = {}
            for r, item, n in _runs(todo):
                if n >= min_words:
                    lengths[r, item] = max(n, lengths.get((r, item), 0))
            ids = batch.column(0).take(pa.array([r for r, _ in lengths], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([i for _, i in lengths], pa.int64()), pa.array(lengths.values(), pa.int32())], [key, "item_id", "n_words"])

    return candidates.mapInArrow(run, f"`{key}` {kind}, item_id bigint, n_words int")


def _runs(todo: list[tuple]) -> Iterator[tuple[int, int, int]]:
    """(row, item, printed run), aligning pairs of like size together."""
    todo = sorted((t for t in todo if t[2] and t[3]), key=lambda t: (len(t[2]), len(t[3])))
    begin = 0
    while begin < len(todo):
        end, widest = begin, 0
        while end < len(todo):
            widest = max(widest, len(todo[end][3]))
            if end > begin and (end - begin + 1) * len(todo[end][2]) * widest > CELLS:
                break
            end += 1
        group = todo[begin:end]
        for (r, item, words, page, *_), match in zip(group, align([t[2:] for t in group])):
            yield r, item, printed_run(words, page, match)
        begin = end


def _windows(offsets: list[int], item_words: int, page_words: int) -> list[tuple[int, int, int, int]]:
    """(begin, end, least offset, greatest offset) of stretches of the page around the offsets, joined where they overlap."""
    out: list[tuple[int, int, int, int]] = []
    for o in sorted(offsets):
        low, high = max(0, o - 10), min(page_words, o + item_words + BAND + 10)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]), out[-1][2], o)
        else:
            out.append((low, high, o, o))
    return out


def find_leaks(
    documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", boxes: str | None = "boxes",
    item_key: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(``key``, item_id, n_words): each page that prints at least ``min_words`` (MIN_WORDS or more) consecutive words of an item.

    ``items`` is a stated query set: it is taken in blocks of about ``block_bytes`` against all pages.  ``boxes`` gives
    the reading order of the lines (None: as they stand).  Null, empty and blank texts on either side match nothing,
    as do items shorter than ``min_words``; a repeated page or item gives its pairs once; a null key is left out;
    other columns are not read; an empty table on either side gives an empty one.  Texts are read whole.
    """
    kind = dict(documents.dtypes)[key]
    source = documents.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("__text"), *([F.col(f"`{boxes}`").alias("__boxes")] if boxes else []))
    source = source.filter(F.col(f"`{key}`").isNotNull() & F.col("__text").isNotNull())
    query = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("item"))
    query = query.filter("item_id is not null and item is not null").groupBy("item_id").agg(F.min("item").alias("item"))
    size = query.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    found = None
    for b in range(blocks):
        rows = query.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        part = _find_block(source, Items([tuple(r) for r in rows]), key, kind, min_words)
        found = part if found is None else found.unionByName(part)
    return found.groupBy(key, "item_id").agg(F.max("n_words").alias("n_words"))


def _find_block(source: DataFrame, block: Items, key: str, kind: str, min_words: int) -> DataFrame:
    seeds = cut(_seeds(source, block, key, kind), "leak-seeds")
    # One row for each seed of the block, whatever the number of pages.
    counted = seeds.select(F.explode(F.array_distinct("seeds")).alias("seed")).groupBy("seed").count().toArrow()
    pages = np.zeros(len(block.sorted), np.int64)
    pages[counted.column("seed").to_numpy()] = counted.column("count").to_numpy()
    block.keep_rare(pages)
    # A key may be on several rows; its page is aligned at the offsets of all.
    pairs = _candidates(seeds, block, key, kind).groupBy(key, "item_id").agg(F.array_distinct(F.flatten(F.collect_list("offsets"))).alias("offsets"))
    per_page = cut(pairs.groupBy(key).agg(F.collect_list(F.struct("item_id", "offsets")).alias("cands")), "leak-candidates")
    # Only pages with candidates are needed again, and they are spread for the costly alignment by their key.
    ready = source.join(per_page.withColumnRenamed(key, "__key"), F.col(f"`{key}`") == F.col("__key")).drop("__key")
    return _verified(ready.repartition(source.sparkSession.sparkContext.defaultParallelism * 2), block, key, kind, min_words)
