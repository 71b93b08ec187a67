"""Byte-level BPE as a lazily determinised finite-state transducer, applied to a whole corpus.

A token sequence is the BPE encoding of its bytes exactly if each neighbouring pair is the encoding of its own
bytes.  That makes a non-deterministic transducer over bytes: walk the trie of the vocabulary, and where a token
ends that may follow the last one, write it and begin at the root again.  ``Transducer`` determinises it on
demand: a state is the set of live readings with what each has still to write; what all readings agree on is
written at once, so a token comes out after a bounded look ahead.  States and transitions are remembered.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits a text into the pieces that are encoded one by one (fixed by the public vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pieces and transitions of a worker; beyond it they are forgotten and made anew.
MEMORY = 400_000

ROOT = 0


class Transducer:
    """Bytes to token ids for the vocabulary ``tokens`` (the bytes of each id, in merge order)."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for i, token in enumerate(tokens):
            node = ROOT
            for byte in token:
                step = self.children[node]
                if byte not in step:
                    step[byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = step[byte]
            self.ends[node] = i
        self.forget()

    def forget(self) -> None:
        self.may_follow: dict[tuple[int | None, int], bool] = {}
        start = ((None, ROOT, ()),)
        self.states: dict[tuple, int] = {start: 0}
        self.readings: list[tuple] = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]
        self.finals: list[tuple[int, ...] | None] = [()]

    def merge(self, data: bytes) -> list[int]:
        """The encoding by its definition: join the neighbouring pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def follows(self, last: int | None, token: int) -> bool:
        key = (last, token)
        known = self.may_follow.get(key)
        if known is None:
            before = b"" if last is None else self.tokens[last]
            expected = [token] if last is None else [last, token]
            known = self.may_follow[key] = self.merge(before + self.tokens[token]) == expected
        return known

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state, and the tokens that are certain by now."""
        live = []
        for last, node, pending in self.readings[state]:
            child = self.children[node].get(byte)
            if child is None:
                continue
            if self.children[child]:
                live.append((last, child, pending))
            token = self.ends[child]
            if token is not None and self.follows(last, token):
                live.append((token, ROOT, (*pending, token)))
        sure = 0
        first = live[0][2]
        while all(len(p) > sure and p[sure] == first[sure] for _, _, p in live) and sure < len(first):
            sure += 1
        key = tuple(sorted(((last, node, p[sure:]) for last, node, p in live), key=repr))
        move = self.moves[state][byte] = (self.number(key), first[:sure])
        return move

    def number(self, reading: tuple) -> int:
        """The state of a set of readings, a new one if it is met first."""
        state = self.states.get(reading)
        if state is None:
            state = self.states[reading] = len(self.readings)
            self.readings.append(reading)
            self.moves.append({})
            self.finals.append(next((p for _, node, p in reading if node == ROOT), None))
        return state

    def encode(self, data: bytes) -> tuple[int, ...]:
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in data:
            move = moves[state].get(byte)
            if move is None:
                if len(self.readings) > MEMORY or len(self.may_follow) > MEMORY:  # also within a piece
                    reading = self.readings[state]
                    self.forget()
                    state, moves = self.number(reading), self.moves
                move = self.step(state, byte)
            state = move[0]
            if move[1]:
                out += move[1]
        return (*out, *self.finals[state])


class Pieces(dict):
    """Piece of text to token ids, remembered."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.transducer.encode(piece.encode("utf-8", "surrogatepass"))
        if len(self) >= MEMORY:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Utf8Stream:
    """Incremental UTF-8: bytes in pieces of any size to text; broken sequences give U+FFFD as in the standard.

    The state is what has been read of an unfinished character (at most three bytes).
    """

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        text, self.open = decode_step(self.open, data)
        return text

    def close(self) -> str:
        left, self.open = self.open, b""
        return "�" if left else ""


def _follow(first: int) -> tuple[int, int, int] | None:
    """For a leading byte: how many bytes follow, and between what the next one must lie."""
    if 0xC2 <= first <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= first <= 0xEF:
        return 2, 0xA0 if first == 0xE0 else 0x80, 0x9F if first == 0xED else 0xBF
    if 0xF0 <= first <= 0xF4:
        return 3, 0x90 if first == 0xF0 else 0x80, 0x8F if first == 0xF4 else 0xBF
    return None


def decode_step(open_: bytes, data: bytes) -> tuple[str, bytes]:
    """One move of the state machine: (text that is complete, new unfinished bytes)."""
    out = []
    for byte in data:
        if open_:
            count, low, high = _follow(open_[0])
            if len(open_) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                open_ += bytes((byte,))
                if len(open_) > count:
                    out.append(open_.decode("utf-8"))
                    open_ = b""
                continue
            out.append("�")
            open_ = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif _follow(byte):
            open_ = bytes((byte,))
        else:
            out.append("�")
    return "".join(out), open_


class Decoder:
    """Token ids to text; moves of the state machine are remembered for whole tokens."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.plain = []  # text of each token that begins and ends between characters
        for token in tokens:
            text, left = decode_step(b"", token)
            self.plain.append(None if left or "�" in text else text)

    def decode(self, ids: Iterable[int]) -> str:
        out, stream = [], Utf8Stream()
        plain, tokens = self.plain, self.tokens
        for i in ids:
            text = plain[i]
            if text is None or stream.open:
                text = stream.feed(tokens[i])
            out.append(text)
        out.append(stream.close())
        return "".join(out)


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id from a file of lines ``base64 id``."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, i = line.split()
                ranks[int(i)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


_WORKER: dict[str, object] = {}


def _worker(kind: str, shared):
    """The worker's own transducer or decoder, kept for its later tasks."""
    key = f"{kind} {len(shared.value)} {hash(tuple(shared.value[-50:]))}"
    if key not in _WORKER:
        _WORKER[key] = Pieces(Transducer(shared.value)) if kind == "encode" else Decoder(shared.value)
    return _WORKER[key]


def encode_texts(documents: DataFrame, tokens: list[bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ids array<int>): the token ids of each whole text, in one narrow pass.

    Null and empty texts give the empty list.  Keys may repeat or be null; other columns are not read; an empty
    table gives an empty one.  ``tokens`` is the fixed vocabulary and goes to the workers once, as a broadcast.
    """
    shared = documents.sparkSession.sparkContext.broadcast(tokens)
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker("encode", shared)
        cut = regex.compile(PATTERN).findall
        get = pieces.__getitem__
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(chain.from_iterable(map(get, cut(t))))
                offsets.append(len(flat))
            values = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
            starts = pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, values)], [key, "ids"])

    source = documents.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("__text"))
    return source.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, tokens: list[bytes], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(``key``, text): the text of each list of token ids; null and empty lists give the empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _worker("decode", shared).decode
        for batch in batches:
            texts = [decode(row or ()) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(run, f"`{key}` {kind}, text string")


def default_vocabulary(spark: SparkSession) -> list[bytes]:
    """The public vocabulary in the folder ``spark.strandmill.tokenizers`` names (default ``/opt/tokenizers``)."""
    folder = spark.conf.get("spark.strandmill.tokenizers", "/opt/tokenizers")
    return read_vocabulary(f"{folder}/byte_bpe_50k.tiktoken")
