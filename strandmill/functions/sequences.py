"""Functions on nucleotide sequences."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reverse_complement(seq: Column | str) -> Column:
    """Letters other than A, C, G and T stay as they are."""
    return F.reverse(F.translate(F.col(seq) if isinstance(seq, str) else seq, "ATGC", "TACG"))


def chunks(seqs: DataFrame, key: str, seq: str, size: int = 100) -> DataFrame:
    """(``key``, start, piece): windows of ``size`` that follow one another; the last may be shorter."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(seq) - 1, F.lit(0)), F.lit(size))
    return (
        seqs.filter(F.length(seq) > 0)
        .select(key, seq, F.explode(starts).alias("start"))
        .select(key, F.col("start").cast("bigint").alias("start"), F.expr(f"substring({seq}, start + 1, {size})").alias("piece"))
    )


_UPPER = np.full(256, -1, np.int64)
_UPPER[[ord(x) for x in "ACGT"]] = range(4)


def _kmer_table(seq: str, k: int) -> np.ndarray:
    """How often each of the 4^k k-mers occurs in the sequence followed by its reverse complement, but for its last two."""
    codes = _UPPER[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    both = np.concatenate([codes, np.where(codes >= 0, 3 - codes, -1)[::-1]])
    n = len(both) - k - 1
    if n <= 0:
        return np.zeros(4**k, np.int64)
    index, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = both[i : i + n]
        index, known = index * 4 + part, known & (part >= 0)
    return np.bincount(index[known], minlength=4**k)


def kmer_counts(seqs: DataFrame, key: str, seq: str, ks: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(``key``, k, kmer, n) over the sequence followed by its reverse complement, without the last two k-mers of
    that; k-mers with letters other than A, C, G and T do not count.  One narrow pass; a null sequence gives no rows,
    a key that occurs twice has its rows twice."""
    names = {k: np.array(["".join(p) for p in product("ACGT", repeat=k)]) for k in ks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, kmers, counts = [], [], [], []
            for r, s in enumerate(batch.column(1).to_pylist()):
                for k in ks:
                    table = _kmer_table(s or "", k)
                    seen = np.flatnonzero(table)
                    rows.append(np.full(len(seen), r))
                    sizes.append(np.full(len(seen), k, np.int32))
                    kmers.append(names[k][seen])
                    counts.append(table[seen])
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows), pa.int64()))
                text = pa.array(np.concatenate(kmers).astype(object), pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(sizes)), text, pa.array(np.concatenate(counts))], [key, "k", "kmer", "n"])

    kind = dict(seqs.dtypes)[key]
    return seqs.select(F.col(key), F.col(seq).cast("string")).mapInArrow(run, f"`{key}` {kind}, k int, kmer string, n bigint")


def tetramer_scores(seqs: DataFrame, key: str, seq: str) -> DataFrame:
    """(``key``, kmer, n, expected, z) of the tetramers in each sequence, from its k-mer tables for k = 2, 3, 4.

    expected = n(abc) n(bcd) / n(bc); z = (n - expected) / sqrt(expected (n(bc) - n(abc)) (n(bc) - n(bcd)) / n(bc)^2),
    null where the root is 0.  One narrow pass.  K-mers are counted as in ``kmer_counts``.
    """
    names = np.array(["".join(p) for p in product("ACGT", repeat=4)])
    at = np.arange(256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kmers, counts, wanted, scores = [], [], [], [], []
            for r, s in enumerate(batch.column(1).to_pylist()):
                two, three, four = (_kmer_table(s or "", k).astype(float) for k in (2, 3, 4))
                abc, bcd, bc = three[at >> 2], three[at & 63], two[(at >> 2) & 15]
                seen = np.flatnonzero((four > 0) & (abc > 0) & (bcd > 0) & (bc > 0))
                abc, bcd, bc = abc[seen], bcd[seen], bc[seen]
                expected = abc * bcd / bc
                root = np.sqrt(np.maximum(expected * (bc - abc) * (bc - bcd) / (bc * bc), 0))
                rows.append(np.full(len(seen), r))
                kmers.append(seen)
                counts.append(four[seen].astype(np.int64))
                wanted.append(expected)
                scores.append(np.divide(four[seen] - expected, root, out=np.full(len(seen), np.nan), where=root > 0))
            if rows:
                z = np.concatenate(scores)
                ids = batch.column(0).take(pa.array(np.concatenate(rows), pa.int64()))
                text = pa.array(names[np.concatenate(kmers)].astype(object), pa.string())
                yield pa.RecordBatch.from_arrays([ids, text, pa.array(np.concatenate(counts)), pa.array(np.concatenate(wanted)), pa.array(z, mask=np.isnan(z))], [key, "kmer", "n", "expected", "z"])

    kind = dict(seqs.dtypes)[key]
    return seqs.select(F.col(key), F.col(seq).cast("string")).mapInArrow(run, f"`{key}` {kind}, kmer string, n bigint, expected double, z double")


_PIECE = 500_000  # letters that are counted at once


def _tetramer_tables(seqs: list[str]) -> np.ndarray:
    """A row of 256 counts for each sequence, as ``_kmer_table(seq, 4)`` gives them; all sequences in one pass."""
    lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
    total, starts = int(lens.sum()), np.cumsum(lens) - lens
    if total < 3:
        return np.zeros((len(seqs), 256), np.int64)
    if total > 2 * _PIECE:  # long ones: one at a time takes less memory
        return np.array([_kmer_table(s, 4) for s in seqs])
    codes = _UPPER[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8)].astype(np.int8)
    at = np.arange(total)
    both = np.empty(2 * total, np.int8)
    both[np.repeat(starts, lens) + at] = codes
    both[np.repeat(3 * starts + 2 * lens - 1, lens) - at] = np.where(codes >= 0, 3 - codes, -1)
    row, place = np.repeat(np.arange(len(seqs)), 2 * lens)[:-3], np.arange(2 * total - 3)
    known = place - 2 * starts[row] < 2 * lens[row] - 5
    index = row * 256
    for i in range(4):
        part = both[i : 2 * total - 3 + i]
        known &= part >= 0
        index += part.astype(np.int64) << 2 * (3 - i)
    return np.bincount(index[known], minlength=256 * len(seqs)).reshape(-1, 256)


def _distances(a: list[list[str]], b: list[list[str]]) -> np.ndarray:
    """Of each row; NaN where the two hold no tetramer in common."""
    rows = [*a, *b]
    sums = tables = _tetramer_tables([s or "" for row in rows for s in row])
    if any(len(row) != 1 for row in rows):
        sums = np.zeros((len(rows), 256), np.int64)
        np.add.at(sums, np.repeat(np.arange(len(rows)), [len(row) for row in rows]), tables)
    both = (sums[: len(a)] > 0) & (sums[len(a) :] > 0)
    left, right = np.where(both, sums[: len(a)], 0), np.where(both, sums[len(a) :], 0)
    with np.errstate(invalid="ignore"):
        apart = left / left.sum(1, keepdims=True) - right / right.sum(1, keepdims=True)
    return np.sqrt((apart * apart).sum(1))


def tetramer_distance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` without ``a`` and ``b``, with distance: Euclidean distance of the tetramer shares, over the tetramers
    that both hold; pairs that hold none in common are left out.

    ``a`` and ``b`` are arrays of sequences; the tetramers of an array are counted together, as in ``kmer_counts``.  Each
    side is normalised over the shared tetramers.  One narrow pass: no row for a tetramer is made.
    """
    rest = [f for f in pairs.schema.fields if f.name not in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, one, two, letters = [], [], [], 0
            for x, y in zip(batch.column(0), batch.column(1)):
                one.append(x.as_py() or [])
                two.append(y.as_py() or [])
                letters += sum(len(s or "") + 256 for side in (one[-1], two[-1]) for s in side)  # a sequence has a table of 256
                if letters >= _PIECE:
                    found.append(_distances(one, two))
                    one, two, letters = [], [], 0
            if one:
                found.append(_distances(one, two))
            if found:
                distance = np.concatenate(found)
                keep = pa.array(np.isfinite(distance))
                columns = [*batch.columns[2:], pa.array(distance)]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], [*[f.name for f in rest], "distance"])

    kinds = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], "distance double"])
    return pairs.select(a, b, *[f"`{f.name}`" for f in rest]).mapInArrow(run, kinds)


_CODES = np.full(128, -1, np.int64)
for _i, _letter in enumerate("ACGT"):
    _CODES[ord(_letter)] = _CODES[ord(_letter.lower())] = _i
DELETED = 4


def _expand(cigar: str, seq: bytes, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, codes) of one record: M, = and X lay read bases on the reference, D gives code 4, N passes on the
    reference only, I and S on the read only; H and P on neither.  Letters other than A, C, G and T do not count."""
    positions, codes, length, at, ref = [], [], 0, 0, start
    bases = _CODES[np.frombuffer(seq, np.uint8) & 127]
    for ch in cigar:
        if ch.isdigit():
            length = length * 10 + int(ch)
            continue
        if ch in "M=X":
            n = min(length, len(bases) - at)
            positions.append(np.arange(ref, ref + n))
            codes.append(bases[at : at + n])
            at, ref = at + length, ref + length
        elif ch == "D":
            positions.append(np.arange(ref, ref + length))
            codes.append(np.full(length, DELETED, np.int64))
            ref += length
        elif ch == "N":
            ref += length
        elif ch in "IS":
            at += length
        length = 0
    if not positions:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p, k = np.concatenate(positions), np.concatenate(codes)
    return p[k >= 0], k[k >= 0]


def cigar_pileup(records: DataFrame, contig: str = "contig", start: str = "tstart", cigar: str = "cigar", seq: str = "seq", barcode: str = "barcode") -> DataFrame:
    """(contig, pos, barcode, a, c, g, t, d): how many aligned bases of each kind lie on each position.

    ``seq`` is the aligned part of the read in the direction of the reference.  Each Arrow batch is expanded and
    counted in place, so that the shuffle carries counts and not bases.  Null contigs, starts, cigars or sequences
    count nothing; a null barcode is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, owner = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True) if batch.num_rows else ([], [])
            starts, barcodes = batch.column(1).to_pylist(), batch.column(4).to_pylist()
            cells = []
            for i, (cg, s) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                p, k = _expand(cg, s.encode("ascii", "replace"), starts[i])
                if len(p):
                    cells.append(np.stack([np.full(len(p), owner[i]), p, np.full(len(p), barcodes[i]), k]))
            if not cells:
                continue
            unique, n = np.unique(np.concatenate(cells, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in unique[0]], pa.string()), pa.array(unique[1]), pa.array(unique[2].astype(np.int32)), pa.array(unique[3].astype(np.int32)), pa.array(n.astype(np.int64))],
                ["contig", "pos", "barcode", "base", "n"],
            )

    source = records.select(
        F.col(contig).cast("string"), F.col(start).cast("bigint"), F.col(cigar), F.col(seq), F.coalesce(F.col(barcode).cast("int"), F.lit(0))
    ).dropna()
    cells = source.mapInArrow(run, "contig string, pos bigint, barcode int, base int, n bigint")
    sums = [F.sum(F.when(F.col("base") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate("acgt")]
    return cells.groupBy("contig", "pos", "barcode").agg(*sums, F.sum(F.when(F.col("base") == DELETED, F.col("n")).otherwise(0)).alias("d"))


DELETION_QUALITY = 20  # fixed value: the quality that a deletion counts with
_TURN = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


def aligned_parts(mappings: DataFrame, reads: DataFrame, min_quality: int = 0) -> DataFrame:
    """``mappings`` with ``seq``: the aligned part of the read in the direction of the reference, bases of a phred quality
    (letter - 33) below ``min_quality`` as N.

    ``mappings``: (qname, qstart, qend, strand, ...) of one record for each read, ``reads``: (read_id, seq, qual) each once.
    Mappings without a read are left out; null coordinates or sequences give a null.
    """
    kept = [x for x in mappings.columns if x not in ("seq", "qual")]
    joined = mappings.select(*kept).join(reads.select(F.col("read_id").alias("qname"), F.col("seq").alias("__seq"), F.col("qual").alias("__qual")), "qname")
    joined = joined.select(*kept, F.col("qstart").alias("__b"), F.col("qend").alias("__e"), (F.col("strand") == "-").alias("__rev"), "__seq", "__qual")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for begin, end, rev, seq, qual in zip(*(batch.column(len(kept) + i).to_pylist() for i in range(5))):
                if seq is None or begin is None or end is None:
                    parts.append(None)
                    continue
                part = np.frombuffer(seq.encode("ascii", "replace")[begin:end], np.uint8).copy()
                if min_quality and qual is not None:
                    low = np.frombuffer(qual.encode("ascii", "replace")[begin:end], np.uint8).astype(int) - 33 < min_quality
                    part[: len(low)][low[: len(part)]] = ord("N")
                text = part.tobytes()
                parts.append((text.translate(_TURN)[::-1] if rev else text).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(parts, pa.string())], [*kept, "seq"])

    kinds = dict(joined.dtypes)
    return joined.mapInArrow(run, ", ".join([*[f"`{x}` {kinds[x]}" for x in kept], "seq string"]))


def increments(mappings: DataFrame, reads: DataFrame, min_quality: int = 0) -> DataFrame:
    """(contig, pos, barcode, a, c, g, t, d) that the ``mappings`` (qname, qstart, qend, strand, tname, tstart, cigar, barcode; one for
    each read) add to the coverage, by the bases of good quality on either strand."""
    counted = cigar_pileup(aligned_parts(mappings, reads, min_quality), "tname")
    if min_quality <= DELETION_QUALITY:
        return counted
    return counted.withColumn("d", F.lit(0).cast("bigint")).filter("a + c + g + t > 0")


def add_increments(before: DataFrame, more: DataFrame) -> DataFrame:
    """The running coverage (contig, pos, barcode, a, c, g, t, d) with ``more`` added."""
    return before.unionByName(more).groupBy("contig", "pos", "barcode").agg(*[F.sum(x).alias(x) for x in "acgtd"])


def remove_stretches(seqs: DataFrame, cuts: DataFrame, key: str = "header", seq: str = "seq", cov: str | None = None) -> DataFrame:
    """Sequences (and their coverage, the array ``cov``) with ``[trim_start, trim_stop)`` of ``cuts`` (by ``sid``; stop null: to the
    end) taken out, and ``%`` put to their names; sequences without a cut are left out."""
    kept = F.expr(f"concat(substring({seq}, 1, trim_start), if(trim_stop is null, '', substring({seq}, trim_stop + 1)))")
    rest = F.expr(f"concat(slice({cov}, 1, trim_start), if(trim_stop is null, slice({cov}, 1, 0), slice({cov}, trim_stop + 1, size({cov}))))").alias(cov) if cov else None
    return seqs.join(cuts, F.col(key) == F.col("sid")).select(F.concat(F.col(key), F.lit("%")).alias(key), kept.alias(seq), *([rest] if cov else []))


def runs_at_least(depth: DataFrame, by: list[str], start: str, end: str, value: str, least: float, min_len: int = 0) -> DataFrame:
    """Gaps and islands: (``by``, start, end) of the longest stretches with ``value`` >= ``least`` and more than ``min_len`` long.

    ``depth`` holds stretches ``[start, end)`` of one value.
    """
    w = Window.partitionBy(*by).orderBy(start)
    high = depth.filter(F.col(value) >= least)
    new = F.coalesce((F.lag(end).over(w) < F.col(start)).cast("int"), F.lit(1))
    islands = high.withColumn("new", new).withColumn("no", F.sum("new").over(w))
    return islands.groupBy(*by, "no").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("no").filter(F.col("end") - F.col("start") > min_len)
