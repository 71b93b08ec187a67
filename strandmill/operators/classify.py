"""What an alignment of two sequences says: filters, classes, trimming.  Column expressions only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERNAL, FIRST_CONTAINED, SECOND_CONTAINED, OVERLAP_FIRST, OVERLAP_SECOND, RELAXED_DOVETAIL = 1, 2, 3, 4, 5, 6
c = F.col


def map_length() -> Column:
    return F.least(c("qend") - c("qstart"), c("tend") - c("tstart"))


def _reverse() -> Column:
    return c("strand") == "-"


def overhang() -> Column:
    q_right, t_right = c("qlen") - c("qend"), c("tlen") - c("tend")
    forward = F.least("qstart", "tstart") + F.least(q_right, t_right)
    return F.when(_reverse(), F.least(c("qstart"), t_right) + F.least(c("tstart"), q_right)).otherwise(forward)


def keep_mappings(paf: DataFrame, min_len: int = 1) -> DataFrame:
    """Primary records whose alignment block is long enough."""
    return paf.filter((c("blen") >= min_len) & c("is_primary"))


def keep_overlaps(paf: DataFrame, min_map_len: int = 2000, min_s1: int = 200, min_seq_len: int = 2500) -> DataFrame:
    """Without self hits, short or weak overlaps, and short sequences."""
    return paf.filter((c("qname") != c("tname")) & (map_length() >= min_map_len) & (c("s1") >= min_s1) & (F.least("qlen", "tlen") >= min_seq_len))


def _near_end(start: str, end: str, length: str, limit: float = 1000) -> Column:
    bound = c(length) * F.lit(limit) if limit < 1 else F.lit(limit)
    return F.least(c(start), c(length) - c(end)) < bound


def with_class(paf: DataFrame) -> DataFrame:
    """Adds ``maplen``, ``cls``, ``qside`` and ``tside`` (of overlaps, else null), ``qprox`` and ``tprox`` (of internal ones)."""
    q_right, t_right, rev = c("qlen") - c("qend"), c("tlen") - c("tend"), _reverse()
    t_left = F.when(rev, t_right).otherwise(c("tstart"))
    t_far = F.when(rev, c("tstart")).otherwise(t_right)
    internal = overhang() * 100 > 15 * map_length()
    first = (c("qstart") <= t_left) & (q_right < t_far)
    second = (c("qstart") >= t_left) & (q_right > t_far)
    q_cover, t_cover = c("qend") - c("qstart"), c("tend") - c("tstart")
    qprox = _near_end("qstart", "qend", "qlen")
    tprox = ~qprox & _near_end("tstart", "tend", "tlen")
    relaxed = (qprox & _near_end("tstart", "tend", "tlen", 0.15)) | (tprox & _near_end("qstart", "qend", "qlen", 0.15))
    long_enough = (c("qlen") > 15_000) & (c("tlen") > 15_000) & (map_length() > 5_000)
    # For the target, too, it is the query that has to be long.
    of_internal = (
        F.when((q_cover * 2 >= c("qlen")) & (c("qlen") > 20_000), FIRST_CONTAINED)
        .when((t_cover * 2 >= c("tlen")) & (c("qlen") > 20_000), SECOND_CONTAINED)
        .when(relaxed & long_enough, RELAXED_DOVETAIL)
        .otherwise(INTERNAL)
    )
    forward_first = c("qstart") > c("tstart")
    q_right_side = c("qstart") > q_right
    reverse_first = F.when(q_right_side, c("qstart") > t_right).otherwise(c("qlen") - c("qstart") > c("tend"))
    overlap = F.when(F.when(rev, reverse_first).otherwise(forward_first), OVERLAP_FIRST).otherwise(OVERLAP_SECOND)
    cls = (
        F.when(internal, of_internal)
        .when(first, FIRST_CONTAINED)
        .when(second, SECOND_CONTAINED)
        .when(q_cover * 10 >= c("qlen") * 9, FIRST_CONTAINED)
        .when(t_cover * 10 >= c("tlen") * 9, SECOND_CONTAINED)
        .otherwise(overlap)
    )
    out = paf.withColumn("maplen", map_length()).withColumn("cls", cls)
    is_overlap = c("cls").isin(OVERLAP_FIRST, OVERLAP_SECOND)
    qside = F.when(rev, F.when(q_right_side, "R").otherwise("L")).otherwise(F.when(forward_first, "R").otherwise("L"))
    tside = F.when(rev, qside).otherwise(F.when(forward_first, "L").otherwise("R"))
    return (
        out.withColumn("qside", F.when(is_overlap, qside))
        .withColumn("tside", F.when(is_overlap, tside))
        .withColumn("qprox", internal & qprox)
        .withColumn("tprox", internal & tprox)
    )


def trim_coords(classified: DataFrame) -> DataFrame:
    """(line_no, sid, trim_start, trim_stop, other) of relaxed dovetails: the side that is not at its end is trimmed.

    ``sid`` is ``0`` where the merged sequence would be shorter than what is trimmed; ``trim_stop`` null is the end.
    """
    t_is_cut = c("qprox")
    start, end, length = (F.when(t_is_cut, c(f"t{x}")).otherwise(c(f"q{x}")) for x in ("start", "end", "len"))
    other_len = F.when(t_is_cut, c("qlen")).otherwise(c("tlen"))
    at_start = start <= length - end
    cut_from, cut_to = F.when(at_start, 0).otherwise(end), F.when(at_start, start)
    new_length = length - (F.coalesce(cut_to, length) - cut_from) + other_len - c("blen")
    sid = F.when(new_length < length, "0").when(t_is_cut, c("tname")).otherwise(c("qname"))
    return classified.filter(c("cls") == RELAXED_DOVETAIL).select(
        "line_no", sid.alias("sid"), cut_from.alias("trim_start"), cut_to.alias("trim_stop"), F.when(t_is_cut, c("qname")).otherwise(c("tname")).alias("other")
    )


def pair_key() -> Column:
    return F.concat(F.least("qname", "tname"), F.lit("-"), F.greatest("qname", "tname"))


def best_of_pair(paf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each unordered pair the record of the highest ``s1`` (then of the highest ``line_no``), combined before the shuffle.

    Columns other than ``keep`` (default: all) are neither read nor shuffled."""
    rest = [x for x in keep or paf.columns if x != "pair"]
    best = paf.withColumn("pair", pair_key()).groupBy("pair").agg(F.max_by(F.struct(*rest), F.struct("s1", "line_no")).alias("r"))
    return best.select("pair", "r.*")


def best_mapping(paf: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For each read the record of the best mapq, then alignment score (nulls count as 0), then highest ``line_no``.

    Columns other than ``keep`` (default: all) are neither read nor shuffled."""
    order = F.struct(F.coalesce("mapq", F.lit(0)), F.coalesce("align_score", F.lit(0)), "line_no")
    best = paf.groupBy("qname").agg(F.max_by(F.struct(*[x for x in keep or paf.columns if x != "qname"]), order).alias("r"))
    return best.select("qname", "r.*")


def repeated_pairs(paf: DataFrame) -> DataFrame:
    """Unordered pairs with more than one record, with their number."""
    return paf.groupBy(pair_key().alias("pair")).agg(F.count("*").alias("n")).filter("n > 1")


def containments(classified: DataFrame) -> DataFrame:
    """(src, dst, ostart, oend, cstart, cend, rev, s1, line_no): one edge from contained to container for each ordered pair, that of the highest s1."""
    first = c("cls") == FIRST_CONTAINED
    pick = lambda a, b: F.when(first, c(a)).otherwise(c(b))
    edges = classified.filter(c("cls").isin(FIRST_CONTAINED, SECOND_CONTAINED)).select(
        pick("qname", "tname").alias("src"), pick("tname", "qname").alias("dst"),
        pick("tstart", "qstart").alias("ostart"), pick("tend", "qend").alias("oend"),
        pick("qstart", "tstart").alias("cstart"), pick("qend", "tend").alias("cend"),
        _reverse().alias("rev"), "s1", "line_no",
    )
    w = Window.partitionBy("src", "dst").orderBy(c("s1").desc(), c("line_no").desc())
    return edges.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def trims_by_success(trims: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``trims`` (sid, ...) with ``success``: whether the trimmed sequence, ``sid`` or ``sid%``, is in a proper ``overlaps`` (qname, tname)."""
    names = overlaps.select(F.explode(F.array("qname", "tname")).alias("__n"))
    found = names.select(F.regexp_replace("__n", "%$", "").alias("sid"), F.lit(True).alias("success")).distinct()
    return trims.join(found, "sid", "left").withColumn("success", F.coalesce("success", F.lit(False)))


def records_of(paf: DataFrame, ids: DataFrame, id_column: str = "read_id") -> DataFrame:
    """The records whose query is among ``ids``, as often as they occur."""
    return paf.join(ids.select(c(id_column).alias("qname")), "qname", "left_semi")
