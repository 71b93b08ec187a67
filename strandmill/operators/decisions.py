"""Looking reads up in the strategy, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.model import ACQUIRE, ANCHOR, BIN, REJECT
from strandmill.operators.ordered import PART, carry, spread

c = F.col


def strand_start(reverse_at: str = "tend - 1") -> Column:
    """Where a read begins on its target; simulations take ``tend - 1`` of reverse reads, the live service ``tend``."""
    return F.when(c("strand") == "-", F.expr(reverse_at)).otherwise(c("tstart"))


def look_up(mappings: DataFrame, strategy: DataFrame | None, contigs: DataFrame, default: bool, reverse_at: str = "tend - 1") -> DataFrame:
    """Adds ``accept``: the strategy's word for the bin where a read begins; ``default`` where it has none.

    Rejected contigs have no strategy and always say no.  ``strategy``: (contig, bin, strand, accept), and ``barcode`` where
    it tells them apart; then ``mappings`` have one, too (null is 0).  ``strategy`` null, as before the first update,
    accepts all else.
    """
    if strategy is None:
        no = contigs.filter("rejected").select(c("contig").alias("tname"), F.lit(False).alias("accept"))
        return mappings.join(no, "tname", "left").withColumn("accept", F.coalesce("accept", F.lit(True)))
    barcode = ["__barcode"] if "barcode" in strategy.columns else []
    asked = mappings.withColumn("__bin", F.floor(strand_start(reverse_at) / BIN).cast("bigint")).withColumn("__strand", (c("strand") == "-").cast("int"))
    cells = strategy.select(c("contig").alias("tname"), c("bin").alias("__bin"), c("strand").alias("__strand"), *[c("barcode").alias(b) for b in barcode], c("accept"))
    for b in barcode:
        asked = asked.withColumn(b, F.coalesce("barcode", F.lit(0)))
    out = asked.join(cells, ["tname", "__bin", "__strand", *barcode], "left")
    out = out.join(contigs.filter("rejected").select(c("contig").alias("tname"), F.lit(True).alias("__no")), "tname", "left")
    word = F.when(c("__no"), False).otherwise(F.coalesce("accept", F.lit(default)))
    return out.withColumn("accept", word).drop("__bin", "__strand", "__no", *barcode)


def decide_live(reads: DataFrame, looked_up: DataFrame) -> DataFrame:
    """(read_id, decision): by any hit among the alignments and whether there is none, one or more; reads without a
    sequence are ``no_seq``, without an alignment ``no_map``."""
    hits = looked_up.groupBy(c("qname").alias("read_id")).agg(F.bool_or("accept").alias("hit"), F.count("*").alias("n"))
    found = reads.select("read_id", "length").join(hits, "read_id", "left")
    name = F.concat(F.when(c("n") > 1, "multi_").otherwise("single_"), F.when(c("hit"), "on").otherwise("off"))
    return found.select("read_id", F.when(c("n").isNull(), F.when(F.coalesce("length", F.lit(0)) > 0, "no_map").otherwise("no_seq")).otherwise(name).alias("decision"))


def simulate(reads: DataFrame, decided: DataFrame, accept_unmapped: bool = False) -> DataFrame:
    """(read_id, length, seen_length, mapped, accepted): accepted reads are read in full, others for the anchor.

    ``decided``: (read_id, accept) of the mapped reads, once each.  ``reads`` are unique.
    """
    joined = reads.select("read_id", "length").join(decided.select("read_id", "accept"), "read_id", "left")
    yes = F.coalesce("accept", F.lit(accept_unmapped))
    return joined.select("read_id", "length", F.when(yes, c("length")).otherwise(F.least("length", F.lit(ANCHOR))).alias("seen_length"), c("accept").isNotNull().alias("mapped"), yes.alias("accepted"))


def pseudotime(simulated: DataFrame, batch: str, batch_size: int | None = None) -> DataFrame:
    """(batch, control, treatment, control_total, treatment_total) in bases, running over the batches.

    Control reads everything; the treatment what was seen, and the cost of each rejection; both the cost of each read
    (``batch_size`` null: of the reads there are).
    """
    reads = F.count("*") if batch_size is None else F.lit(batch_size)
    per = simulated.groupBy(batch).agg(
        (F.coalesce(F.sum("length"), F.lit(0)) + reads * ACQUIRE).alias("control"),
        (F.coalesce(F.sum("seen_length"), F.lit(0)) + F.count_if(~c("accepted")) * REJECT + reads * ACQUIRE).alias("treatment"),
    )
    # One row for each batch, some hundreds in a run.
    w = Window.orderBy(batch)
    return per.withColumn("control_total", F.sum("control").over(w)).withColumn("treatment_total", F.sum("treatment").over(w))


def dump_numbers(times: DataFrame, batch: str, total: str, every: int) -> DataFrame:
    """(batch, dump): the running number of the dump that a batch's reads go into.

    A batch whose end lies beyond ``every`` times the number of the dump that is due ends that dump; a batch ends at most
    one.  In closed form, the dumps ended by batch k (counted from 1) are min over j <= k of (crossed_j + k - j), where
    crossed_j = ceil(total_j / every) - 1 is how many were due by then.
    """
    w = Window.orderBy(batch)
    numbered = times.select(batch, total, F.row_number().over(w).alias("k"))
    due = F.ceil(c(total) / every) - 1
    # ended_k = min(ended_{k-1} + 1, due_k), as totals never fall.
    ended = F.least(F.min(due - c("k")).over(w) + c("k"), c("k"))
    out = numbered.withColumn("ended", F.greatest(ended, F.lit(0)).cast("bigint"))
    return out.select(batch, (F.coalesce(F.lag("ended").over(w), F.lit(0)) + 1).alias("dump"))


def override_actions(
    chunks: DataFrame, min_chunks: int, max_chunks: int, above: str = "unblock", below: str = "proceed",
    dry_run: bool = False, mid_run: bool = False, duplex: bool = False, possible_duplex: Column | None = None,
    order: tuple[str, ...] = ("seq_no",),
) -> DataFrame:
    """Adds ``final_action``, ``previous``, ``sent`` and ``overridden`` to (channel, ``order``, seen, control, action).

    Control channels always stop receiving.  Else more than ``max_chunks`` seen turns ``proceed`` into ``above``, and then
    fewer than ``min_chunks`` any other action into ``below``.  With ``duplex``, an ``unblock`` right after a read that was
    kept for its own sake is kept, too (where ``possible_duplex`` allows).  The first chunk of a channel stops receiving
    if the service began in mid run.  A dry run sends ``stop_receiving`` for ``unblock``.  ``previous`` is the channel's
    last final action other than ``proceed``.
    """
    by_max = F.when((c("seen") > max_chunks) & (c("action") == "proceed"), F.lit(above)).otherwise(c("action"))
    out = chunks.withColumn("__a", F.when(c("control"), "stop_receiving").otherwise(by_max))
    by_min = F.when(~c("control") & (c("seen") < min_chunks) & (c("__a") != "proceed"), F.lit(below)).otherwise(c("__a"))
    out = spread(out.withColumn("__a", by_min), "channel", *order)
    first = F.lit(False)
    if mid_run:
        out, first = carry(out, "channel", order, __seen=F.lit(True)), c("__seen").isNull()
    out = out.withColumn("__first", first)
    # What the last final chunk was for its own sake; one kept by an override lets no other be kept.
    own = F.when(c("__first"), "first").when(c("__a") != "proceed", c("__a"))
    out = carry(out, "channel", order, __last=own)
    kept = F.lit(duplex) & (c("__a") == "unblock") & (c("__last") == "stop_receiving") & (F.lit(True) if possible_duplex is None else possible_duplex)
    out = out.withColumn("__kept", F.coalesce(kept, F.lit(False)))
    out = out.withColumn("final_action", F.when(c("__first") | c("__kept"), "stop_receiving").otherwise(c("__a")))
    final = F.when(c("final_action") != "proceed", c("final_action"))
    dry = (c("final_action") == "unblock") & F.lit(dry_run)
    sent = F.when(dry, "stop_receiving").when(c("final_action") != "proceed", c("final_action"))
    out = carry(out, "channel", order, previous=final).withColumn("sent", sent)
    return out.withColumn("overridden", c("__first") | c("__kept") | dry).drop("__a", "__first", "__seen", "__last", "__kept", PART)


def abundance(best: DataFrame, reads_total: Column) -> DataFrame:
    """(tname, n, share) of best mappings; ``reads_total`` counts mapped and unmapped reads."""
    return best.groupBy("tname").agg(F.count("*").alias("n")).withColumn("share", c("n") / reads_total)


def full_or_truncated(decided: DataFrame, full: DataFrame, truncated: DataFrame) -> DataFrame:
    """What is mapped of each read after its decision: the record of the whole read where it is accepted, else that of its
    anchor.  ``decided``: (read_id, accept); ``full`` and ``truncated`` have one record for each qname and the same columns.
    An accepted read without a full record has none."""
    yes, no = (decided.filter(c("accept") == word).select(c("read_id").alias("qname")) for word in (True, False))
    return full.join(yes, "qname", "left_semi").unionByName(truncated.join(no, "qname", "left_semi"))


def accepted_mappings(mapped: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """Those of ``full_or_truncated`` that are of whole reads: all but records of anchors."""
    return mapped.filter(c("qlen") != anchor)


# The columns of the decision log, in order.
LOG_COLUMNS = [
    "loop_counter", "number_reads", "read_id", "channel", "read_number", "seq_length", "seen_count", "decision", "action", "condition",
    "barcode", "previous_action", "timestamp", "action_overridden",
]


def decision_log(chunks: DataFrame) -> DataFrame:
    """The log's columns in order; those that ``chunks`` lacks are null."""
    return chunks.select(*[c(x) if x in chunks.columns else F.lit(None).cast("string").alias(x) for x in LOG_COLUMNS])
