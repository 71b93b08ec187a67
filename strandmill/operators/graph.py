"""Overlap and containment graphs of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.classify import pair_key
from strandmill.session import cut

c = F.col
COVERAGE_CAP = 100.0


def without_ids(edges: DataFrame, ids: DataFrame, id_column: str = "id", ends: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """Edges neither end of which is among ``ids``."""
    for end in ends:
        edges = edges.join(ids.select(c(id_column).alias(end)).distinct(), end, "left_anti")
    return edges


def both_ways(links: DataFrame, a: str = "qname", b: str = "tname") -> DataFrame:
    """(src, dst): each link in either direction."""
    return links.select(F.explode(F.array(F.struct(c(a).alias("src"), c(b).alias("dst")), F.struct(c(b).alias("src"), c(a).alias("dst")))).alias("l")).select("l.*")


def route(classified: DataFrame, acceptors: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """``classified`` records with ``kind``: containment, overlap, trim or internal, and ``cls`` as it then holds.

    ``acceptors`` (header) names the sequences that take overlaps: an overlap onto another one becomes a containment, of
    the query if the target takes none, else of the target.  Overlaps of pairs in ``apart`` (qname, tname), such as
    those of different species, are left out.
    """
    known = acceptors.select("header").distinct().withColumn("__yes", F.lit(True))
    out = classified
    if apart is not None:
        is_overlap = c("cls").isin(4, 5)
        out = out.filter(~is_overlap).unionByName(out.filter(is_overlap).join(apart.select("qname", "tname").distinct(), ["qname", "tname"], "left_anti").select(*out.columns))
    for end in ("qname", "tname"):
        out = out.join(known.select(c("header").alias(end), c("__yes").alias(f"__{end}")), end, "left")
    demoted = F.when(c("cls").isin(4, 5) & c("__tname").isNull(), 2).when(c("cls").isin(4, 5) & c("__qname").isNull(), 3).otherwise(c("cls"))
    out = out.withColumn("cls", demoted).drop("__qname", "__tname")
    kind = F.when(c("cls").isin(2, 3), "containment").when(c("cls").isin(4, 5), "overlap").when(c("cls") == 6, "trim").otherwise("internal")
    return out.withColumn("kind", kind)


def members(headers: DataFrame, of: DataFrame, member: str = "member", with_self: bool = False) -> DataFrame:
    """(header, members): for each unitig the union of what its sequences consist of, one level down.

    ``headers``: (header, name); ``of``: (name, ``member``).  With ``with_self`` the sequences themselves belong to it.
    """
    found = headers.join(of.select("name", c(member).alias("m")), "name").select("header", "m")
    if with_self:
        found = found.unionByName(headers.select("header", c("name").alias("m")))
    return found.groupBy("header").agg(F.array_sort(F.collect_set("m")).alias("members"))


def longest(sequences: DataFrame, length: str = "length", n: int = 10) -> DataFrame:
    """The ``n`` longest, equal ones by name."""
    return sequences.orderBy(c(length).desc(), sequences.columns[0]).limit(n)


def long_enough(sequences: DataFrame, min_contig: int = 10_000, length: str = "length") -> DataFrame:
    """The sequences that get a strategy: those longer than ``min_contig``."""
    return sequences.filter(c(length) > min_contig)


def assembly_totals(sequences: DataFrame, length: str = "length") -> DataFrame:
    """(n, total, longest); 0 and nulls of none."""
    return sequences.agg(F.count("*").alias("n"), F.sum(length).cast("bigint").alias("total"), F.max(length).alias("longest"))


def contain_layers(edges: DataFrame) -> DataFrame:
    """(src, dst, layer, multiplicity): each edge in the layer in which it passes coverage on, once.

    The first layer are the edges whose source is nowhere contained; in each next one are those that begin where the
    last ended.  So an edge's layer is the least number of steps from such a source to its own; edges that none
    reaches, such as circles, are in no layer.  ``multiplicity`` is the number of the source's edges.  Paths without a
    branch are folded by pointer doubling first, so a chain takes as many rounds as the logarithm of its length.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    ends = edges.select(c("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(c("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    nodes = cut(ends.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in")), "nodes")
    # On a path: one edge in, one out.  Each points to the node before it, and then ever further back.
    path = nodes.filter("n_in = 1 and n_out = 1").select("node")
    up = cut(edges.join(path, c("dst") == c("node")).select("node", c("src").alias("up"), F.lit(1).cast("bigint").alias("steps")), "path")
    for _ in range(up.count().bit_length()):
        back = up.select(c("node").alias("up"), c("up").alias("__up"), c("steps").alias("__steps"))
        further = cut(up.join(back, "up", "left").select("node", F.coalesce("__up", "up").alias("up"), (c("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), c("__up").isNotNull().alias("moved")), "path")
        done = further.filter("moved").isEmpty()
        up = further.select("node", "up", "steps")
        if done:
            break
    # What still points to a path runs in a circle.
    up = up.join(path.select(c("node").alias("up")), "up", "left_anti")
    heads = up.select(c("node").alias("src"), "up", "steps")
    # Edges between the other nodes, as long as the paths in them.
    long = edges.join(path.select(c("node").alias("dst")), "dst", "left_anti").join(heads, "src", "left")
    on_path = path.select(c("node").alias("src"), F.lit(True).alias("__path"))
    long = long.join(on_path, "src", "left").filter("__path is null or up is not null")
    long = cut(long.groupBy(F.coalesce("up", "src").alias("src"), "dst").agg((F.min(F.coalesce("steps", F.lit(0))) + 1).alias("steps")), "long-edges")
    dist = cut(nodes.filter("n_in = 0").select("node", F.lit(0).cast("bigint").alias("d")), "distance")
    news = dist
    while not news.isEmpty():
        reached = news.join(long, c("node") == c("src")).groupBy(c("dst").alias("node")).agg(F.min(c("d") + c("steps")).alias("__d"))
        merged = dist.join(reached, "node", "full_outer").select("node", F.least("d", "__d").alias("d"), (c("d").isNull() | (c("__d") < c("d"))).alias("new"))
        merged = cut(merged, "distance")
        dist, news = merged.select("node", "d"), merged.filter("new").select("node", "d")
    reach = dist.unionByName(up.join(dist.select(c("node").alias("up"), "d"), "up").select("node", (c("d") + c("steps")).alias("d")))
    placed = reach.join(nodes, "node").select(c("node").alias("src"), c("d").cast("int").alias("layer"), c("n_out").alias("multiplicity"))
    return edges.join(placed, "src").select("src", "dst", "layer", "multiplicity")


def pass_coverage(cells: DataFrame, containments: DataFrame) -> DataFrame:
    """``cells`` (header, at, value) with the coverage of contained sequences added to their containers.

    ``containments``: (src, dst, ostart, oend, cstart, cend, rev).  In a layer all increments use the coverage from
    before it: the contained stretch is cut, or lengthened by its last value, to that of the container, turned round
    if reverse, divided by the multiplicity, added, and the sum is held at 100.  Only the cells of a layer's
    containers are written anew.  Cells are numbered from 0 without a gap.
    """
    layers = cut(contain_layers(containments.filter("src <> dst")).join(containments, ["src", "dst"]), "layers")
    last = layers.agg(F.max("layer")).first()[0]
    cells = cells.select("header", c("at").cast("int").alias("at"), c("value").cast("double").alias("value"))
    for no in range(0 if last is None else last + 1):
        now = layers.filter(c("layer") == no)
        asked = now.withColumn("n", (c("oend") - c("ostart")).cast("int")).filter("n > 0")
        part = asked.join(cells.withColumnRenamed("header", "src"), "src").filter("at >= cstart and at < cend")
        # The last cell of the stretch stands for what lacks behind it.
        size = F.least("cend", F.max("at").over(Window.partitionBy("src", "dst")) + 1) - c("cstart")
        part = part.withColumn("i", c("at") - c("cstart")).withColumn("size", size).filter("i < n")
        to = F.when(c("i") == c("size") - 1, c("n") - 1).otherwise(c("i"))
        part = part.withColumn("i", F.explode(F.sequence("i", to.cast("int"))))
        spot = c("ostart") + F.when(c("rev"), c("n") - 1 - c("i")).otherwise(c("i"))
        added = part.groupBy(c("dst").alias("header"), spot.cast("int").alias("at")).agg(F.sum(c("value") / c("multiplicity")).alias("more"))
        containers = now.select(c("dst").alias("header")).distinct()
        changed = cells.join(containers, "header", "left_semi").join(added, ["header", "at"], "left")
        changed = changed.select("header", "at", F.least(c("value") + F.coalesce("more", F.lit(0.0)), F.lit(COVERAGE_CAP)).alias("value"))
        cells = cut(cells.join(containers, "header", "left_anti").unionByName(changed), "coverage")
    return cells


def multiline_containments(internal: DataFrame, cell: int = 100) -> DataFrame:
    """(src, dst, ostart, oend, cstart, cend, n): pairs with 2 to 10 internal matches that together cover a sequence.

    On a grid of ``cell`` bases the matches must cover more than 0.9 of one sequence's cells and span more than 0.85
    (the query is tried first).  The container's stretch is the span of its cells, unless that is over 2.2 times as
    long as the contained one; then it is that of the longest match.
    """
    # Pairs are counted first, so that none with many records is gathered.
    keyed = internal.withColumn("key", pair_key())
    few = keyed.groupBy("key").count().filter("count between 2 and 10").select("key")
    groups = keyed.join(few, "key").withColumn("pair", F.struct("qname", "tname")).groupBy("key").agg(
        F.count("*").alias("n"), F.first("qlen").alias("qlen"), F.first("tlen").alias("tlen"), F.min("pair").alias("pair"),
        F.sort_array(F.collect_list(F.struct("line_no", "qname", "qstart", "qend", "tstart", "tend", "qlen", "tlen"))).alias("m"),
    )
    # All records of a pair in the direction of its first.
    first = groups.withColumn("q", c("m")[0]["qname"]).withColumn("ql", c("m")[0]["qlen"]).withColumn("tl", c("m")[0]["tlen"])
    first = first.withColumn("t", F.when(c("q") == c("pair.qname"), c("pair.tname")).otherwise(c("pair.qname")))

    def side(x: str, y: str):
        def turned(m, end):
            return F.when(m["qname"] == c("q"), m[f"{x}{end}"]).otherwise(m[f"{y}{end}"])

        return F.transform("m", lambda m: F.struct(turned(m, "start").alias("s"), turned(m, "end").alias("e")))

    first = first.withColumn("qs", side("q", "t")).withColumn("ts", side("t", "q"))
    for x in "qt":
        cells = f"array_distinct(flatten(transform({x}s, r -> if(r.e div {cell} > r.s div {cell}, sequence(r.s div {cell}, r.e div {cell} - 1), array()))))"
        first = first.withColumn(f"{x}c", F.expr(cells))
        first = first.withColumn(f"{x}0", F.array_min(f"{x}c")).withColumn(f"{x}1", F.array_max(f"{x}c"))
        grid = F.expr(f"{x}l div {cell}")
        first = first.withColumn(f"{x}ok", (F.size(f"{x}c") > grid * 0.9) & (c(f"{x}1") - c(f"{x}0") > grid * 0.85))
    longest = "aggregate(zip_with(qs, ts, (a, b) -> struct(least(a.e - a.s, b.e - b.s) as w, a as a, b as b)), cast(null as struct<w:bigint,a:struct<s:bigint,e:bigint>,b:struct<s:bigint,e:bigint>>), (acc, x) -> if(acc is null or x.w > acc.w, x, acc))"
    first = first.withColumn("qs", F.expr("transform(qs, r -> struct(cast(r.s as bigint) as s, cast(r.e as bigint) as e))"))
    first = first.withColumn("ts", F.expr("transform(ts, r -> struct(cast(r.s as bigint) as s, cast(r.e as bigint) as e))"))
    first = first.withColumn("best", F.expr(longest)).filter("coalesce(qok, false) or coalesce(tok, false)").withColumn("isq", F.coalesce("qok", F.lit(False)))
    pick = lambda a, b: F.when(c("isq"), c(a)).otherwise(c(b))
    out = first.select(
        pick("q", "t").alias("src"), pick("t", "q").alias("dst"), "n",
        (pick("q0", "t0") * cell).cast("bigint").alias("cstart"), (pick("q1", "t1") * cell).cast("bigint").alias("cend"),
        (pick("t0", "q0") * cell).cast("bigint").alias("o0"), (pick("t1", "q1") * cell).cast("bigint").alias("o1"),
        pick("best.b", "best.a").alias("alone"),
    )
    wide = (c("o1") - c("o0")) > (c("cend") - c("cstart")) * 2.2
    return out.select("src", "dst", F.when(wide, c("alone.s")).otherwise(c("o0")).alias("ostart"), F.when(wide, c("alone.e")).otherwise(c("o1")).alias("oend"), "cstart", "cend", "n")


def reset_temperature(sequences: DataFrame, warm: DataFrame, temperature: int = 60) -> DataFrame:
    """``sequences`` (header, temperature ...): those in ``warm`` (id) at full temperature."""
    hot = warm.select(c("id").alias("header"), F.lit(True).alias("__hot")).distinct()
    out = sequences.join(hot, "header", "left")
    return out.withColumn("temperature", F.when(c("__hot"), F.lit(temperature)).otherwise(c("temperature"))).drop("__hot")


def cool_down(sequences: DataFrame, max_length: int) -> DataFrame:
    """Sequences shorter than ``max_length`` lose a degree and are ``frozen`` without any; longer ones never freeze."""
    short = F.length("seq") < max_length
    out = sequences.withColumn("temperature", F.when(short, c("temperature") - 1).otherwise(c("temperature")))
    return out.withColumn("frozen", short & (c("temperature") <= 0))


def repeat_reads(mappings: DataFrame, limit: int = 5, edge: int = 500) -> DataFrame:
    """(id): reads on which repeats cover more than ``limit`` bases, counted for each repeat, of the first ``edge`` ones or
    of all that follow.  ``mappings``: (tname, tstart, tend) of repeats on reads.
    """
    parts = F.array(
        F.struct(F.lit(0).alias("part"), c("tstart").alias("s"), F.least("tend", F.lit(edge)).alias("e")),
        F.struct(F.lit(1).alias("part"), F.greatest("tstart", F.lit(edge)).alias("s"), c("tend").alias("e")),
    )
    per = mappings.select("tname", F.explode(parts).alias("p")).select("tname", "p.*").filter("s < e")
    return per.groupBy("tname", "part").agg(F.sum(c("e") - c("s")).alias("bases")).filter(c("bases") > limit).select(c("tname").alias("id")).distinct()


def unitig_coverage(atoms: DataFrame, sequences: DataFrame) -> DataFrame:
    """(header, cov): the coverage of each unitig from its atoms in order, and of those all members.

    ``atoms``: (header, pos, rev, name, n); an atom gives its first n values (n = -1: all), from its end if reverse.
    """
    joined = atoms.join(sequences.select(c("header").alias("name"), "cov"), "name")
    turned = F.when(c("rev"), F.reverse("cov")).otherwise(c("cov"))
    part = F.when(c("n") < 0, c("cov")).otherwise(F.expr("slice(cov, 1, n)"))
    pieces = joined.withColumn("cov", turned).select("header", "pos", part.alias("part"))
    ordered = pieces.groupBy("header").agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p"))
    return ordered.select("header", F.flatten("p.part").alias("cov"))
