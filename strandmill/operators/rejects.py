"""Raw PAF text to typed records, with the rows that fail kept apart and explained.

Each row is one record.  It is assembled quote-aware and read by Python's strict csv reader inside the
tasks; structural errors are caught there, before any typed field is built.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NUMBERS = (1, 2, 3, 6, 7, 8, 9, 10, 11)
TAG = re.compile(r"[A-Za-z][A-Za-z0-9]:[AifZ]:")
INTEGER = re.compile(r"[+-]?[0-9]+")
DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
# Whole record: fields that are quoted from end to end, or hold no quote at all.
_FIELD = r'(?:"(?:[^"]++|"")*+"|[^"\t]*+)'
QUOTED_RECORD = re.compile(rf"{_FIELD}(?:\t{_FIELD})*+")

RECORD_FIELDS = (
    [("qname", pa.string())]
    + [(n, pa.int64()) for n in ("qlen", "qstart", "qend")]
    + [("strand", pa.string()), ("tname", pa.string())]
    + [(n, pa.int64()) for n in ("tlen", "tstart", "tend", "num_matches", "blen", "mapq")]
    + [("align_score", pa.int64()), ("s1", pa.int64()), ("is_primary", pa.bool_()), ("cigar", pa.string())]
    + [("beyond", pa.map_(pa.string(), pa.string()))]
)
RECORD_TYPE = "struct<" + ",".join(
    f"{n}:{'bigint' if t == pa.int64() else 'boolean' if t == pa.bool_() else 'string' if t == pa.string() else 'map<string,string>'}" for n, t in RECORD_FIELDS
) + ">"


def split_record(line: str) -> list[str]:
    """The fields of one stripped line; ``csv.Error`` where its quoting is broken.

    The strict reader finds quotes that never end or are gone on after; it takes a quote in a field that does not start
    with one for data, so such a field is looked for behind it.
    """
    # Line ends inside a record are data, and would end it for the reader: letters that the line lacks stand for them.
    ends = {e: next(c for c in map(chr, range(first, 0x110000)) if c not in line) for e, first in (("\r", 0xE000), ("\n", 0xF0000)) if e in line}
    text = line
    for end, letter in ends.items():
        text = text.replace(end, letter)
    fields = next(csv.reader((text,), delimiter="\t", quotechar='"', doublequote=True, strict=True), [])
    if '"' in line and not QUOTED_RECORD.fullmatch(line):
        raise csv.Error("a quote in a field that does not start with one")
    for end, letter in ends.items():
        fields = [f.replace(letter, end) for f in fields]
    return fields


def parse_line(line: str | None) -> tuple[str | None, dict | None]:
    """(reason, None) for a row that fails, (None, typed fields) for one that does not."""
    line = (line or "").strip()
    try:
        f = split_record(line)
    except csv.Error:
        return "quoting", None
    if len(f) < 12 or not all(map(TAG.match, f[12:])):
        return "columns", None
    if not all(f[i].isascii() and f[i].isdigit() for i in NUMBERS):
        return "value", None
    qlen, qstart, qend, tlen, tstart, tend, matches, blen, mapq = (int(f[i]) for i in NUMBERS)
    if (
        f[4] not in ("+", "-")
        or not f[0].strip()
        or not f[5].strip()
        or not qstart < qend <= qlen
        or not tstart < tend <= tlen
        or matches > blen
        or mapq > 255
    ):
        return "value", None
    tags = {}
    for tag in f[12:]:
        kind, value = tag[3], tag[5:]
        if kind == "i" and not INTEGER.fullmatch(value) or kind == "f" and not DECIMAL.fullmatch(value):
            return "value", None
        tags.setdefault(tag[:5], value)
    record = {
        "qname": f[0], "qlen": qlen, "qstart": qstart, "qend": qend, "strand": f[4], "tname": f[5],
        "tlen": tlen, "tstart": tstart, "tend": tend, "num_matches": matches, "blen": blen, "mapq": mapq,
        "align_score": int(tags.get("AS:i:", 0)), "s1": int(tags.get("s1:i:", 0)),
        "is_primary": tags.get("tp:A:") == "P", "cigar": tags.get("cg:Z:"),
    }
    beyond = {n: str(record[n]) for n, t in RECORD_FIELDS if t == pa.int64() and not -(2**63) <= record[n] < 2**63}
    return None, record | dict.fromkeys(beyond) | {"beyond": list(beyond.items()) or None}


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(2**31 - 1)
    kind = pa.struct(RECORD_FIELDS)
    for batch in batches:
        parsed = [parse_line(line) for line in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array([r for r, _ in parsed], pa.string()), pa.array([r for _, r in parsed], kind)],
            [*batch.schema.names[:-1], "reason", "record"],
        )


def parse_paf(lines: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but ``line``), ``reason`` and the typed ``record``; no shuffle.

    Exactly one of ``reason`` and ``record`` is null: ``reason`` is ``quoting``, ``columns`` or ``value``,
    the first that applies.  Null and blank lines fail for ``columns``.  Kept columns named ``reason`` or
    ``record`` give way to the operator's.  Repeated rows come out as often as they come in, an empty table
    gives an empty one, and a record of any length is read whole.  Numbers beyond 64 bits are valid; their
    field is null, and ``beyond`` maps its name to the digits (null where there is none).
    """
    kept = [c for c in (keep if keep is not None else lines.columns) if c != line and c.lower() not in ("reason", "record")]
    source = lines.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{line}`").cast("string").alias("__line"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    return source.mapInArrow(_parse_batches, ", ".join([*fields, "reason string", f"record {RECORD_TYPE}"]))


def rejected_rows(lines: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The rows that fail, with the reason."""
    return parse_paf(lines, line, keep).filter("reason is not null").drop("record")


def valid_records(lines: DataFrame, line: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The other rows, as typed columns after the kept ones (of equal names, the record's stay)."""
    parsed = parse_paf(lines, line, keep).filter("reason is null").drop("reason")
    names = {n for n, _ in RECORD_FIELDS}
    return parsed.select(*[c for c in parsed.columns if c != "record" and c.lower() not in names], "record.*")
