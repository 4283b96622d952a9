"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stage

SEED = 20_17
MAX_COPIES = 3.0
#: Weights go round: the first source by code point has 1, the second 2, the third 3, the fourth 1.
WEIGHTS = (1.0, 2.0, 3.0)
#: Up to this many rows, per-source figures (about 100 bytes each) are broadcast; beyond it they are joined.
BROADCAST_ROWS = 100_000
#: Bits of a rank, of the order among equal ranks, and of one digit of them in the search for the cut.
RANK_BITS, TIE_BITS, DIGIT_BITS = 52, 39, 13
#: Expected copies this near to a whole number are one.
_NEAR = 1e-9


def _small(figures: DataFrame) -> DataFrame:
    """Staged figures, to be broadcast if there are few."""
    return F.broadcast(figures) if figures.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else figures


def _same_source(a: DataFrame, b: DataFrame, *also: str) -> DataFrame:
    """a with the figures that b has for its source (and other columns); null is a source like others."""
    names = {c: f"_{c}" for c in ("source", *also)}
    same = F.lit(True)
    for c, other in names.items():
        same &= F.col(c).eqNullSafe(F.col(other))
    return a.join(b.withColumnsRenamed(names), same).drop(*names.values())


def _weighted(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Staged: the sources with their weights, which go round in the order of code points. No task sorts all sources."""
    order = F.col("source").asc_nulls_last()
    placed = stage(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "places")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    found = placed.withColumn("part", part).join(F.broadcast(before), "part")
    turn = F.pmod(place + F.col("before"), F.lit(len(weights))).cast("int") + 1
    return stage(found.select("source", "source_size", F.element_at(F.array(*(F.lit(w) for w in weights)), turn).alias("weight")), "weights")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size): the total size, shared by weight.

    No source gets more than `most` times its size; the excess goes to the rest by weight. What a weight of one is worth grows as
    sources fill up, until no other one does: each round is one aggregate over the sources.
    """
    found, worth = _weighted(sources, weights), 0.0
    total = found.agg(F.sum("source_size")).first()[0] or 0
    limit = F.lit(most) * F.col("source_size")
    while True:
        full = F.lit(worth) * F.col("weight") > limit
        r = found.agg(F.sum(F.when(full, limit)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        now = (total - (r["given"] or 0.0)) / r["open"] if r["open"] else worth
        if now <= worth:
            break
        worth = now
    return found.select("source", "source_size", F.least(F.lit(worth) * F.col("weight"), limit).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> dict:
    """What the mix needs to know of a row: its source, size, draw, and the order among rows with the same draw."""
    text = F.col(text_col)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 11).cast("double") / F.lit(float(1 << 53))
    tie = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()), 64 - TIE_BITS)
    return {"source": F.col(source_col).cast("string"), "size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), "u": draw, "tie": tie}


def _digits() -> Column:
    """Binary digits of the size: what a document's chance of being taken grows with."""
    return F.length(F.bin("size"))


def _shares(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Staged: for each source and number of digits the whole copies and the inclusion probability p of one more.

    Expected copies are min(MAX_COPIES, c * digits), where c makes the expected words of the source its target: of the
    classes from the longest down, the first that is not full at the c that those above it leave. A source has at most 64 classes.
    """
    classes = stage(rows.groupBy("source", _digits().alias("digits")).agg(F.sum("size").alias("words")), "classes")
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    found = _same_source(classes, _small(stage(sources, "targets")))
    own = Window.partitionBy("source")
    down = own.orderBy(F.desc("digits"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("words") * F.col("digits")).over(down.rowsBetween(0, Window.unboundedFollowing))
    found = found.withColumn("c", F.when(rest > 0, (F.col("target") - MAX_COPIES * above) / rest))
    first = F.max(F.when(F.col("c") * F.col("digits") <= MAX_COPIES, F.struct("digits", "c"))).over(own)["c"]
    copies = F.when(F.col("target") > 0, F.least(F.lit(MAX_COPIES), F.coalesce(first * F.col("digits"), F.lit(MAX_COPIES)))).otherwise(F.lit(0.0))
    found = found.withColumn("copies", copies)
    found = found.withColumn("copies", F.when(F.abs(F.col("copies") - F.round("copies")) < _NEAR, F.round("copies")).otherwise(F.col("copies")))
    found = found.withColumn("whole", F.floor("copies").cast("int")).withColumn("p", F.col("copies") - F.col("whole"))
    missing = F.sum(F.col("words") * F.col("p")).over(own)
    return stage(found.select("source", "digits", "source_size", "target", "whole", "p", missing.alias("missing")), "shares")


def _ranked(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """Rows with the figures of their class and, where one more copy is drawn for, their rank in the source's order."""
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rank = F.when(F.col("p") > 0, (odds / (1 + odds) * F.lit(float(1 << RANK_BITS))).cast("long"))
    return _same_source(rows.withColumn("digits", _digits()), shares, "digits").withColumn("rank", rank)


def _crossing() -> Column:
    """Of a source's bins the one in which the cumulative size reaches what is missing, with that size; the last one if none does.

    A source has at most 2^DIGIT_BITS bins.
    """
    kind = "struct<digits:bigint,size:bigint,rank:bigint,tie:bigint,alone:boolean>"
    start = F.struct(F.lit(None).cast(kind).alias("bin"), F.first("below").alias("cum"))

    def step(found, bin_):
        done = found["bin"].isNotNull() & (found["cum"] >= F.first("missing"))
        return F.when(done, found).otherwise(F.struct(bin_.cast(kind).alias("bin"), (found["cum"] + bin_["size"]).alias("cum")))

    return F.aggregate(F.array_sort(F.collect_list(F.struct("digits", "size", "rank", "tie", "alone"))), start, step)


def _cuts(ranked: DataFrame, shares: DataFrame) -> DataFrame:
    """Staged (source, cut_rank, cut_tie, more_rank, more_tie): rows before the cut are taken, and of each source one more, if there is one.

    The cut is found digit by digit, over histograms of the ranks and then, among rows of one rank, of their ties. What is
    known of each source stays in staged tables.
    """
    ranked = ranked.where("p > 0").select("source", "size", "rank", "tie")
    here = shares.where("missing > 0").select("source", "missing", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("at_rank"), F.lit(0).cast("long").alias("below")).distinct()
    here, done = stage(here, "open"), None
    levels = [("rank", s) for s in range(RANK_BITS - DIGIT_BITS, -1, -DIGIT_BITS)] + [("tie", s) for s in range(TIE_BITS - DIGIT_BITS, -1, -DIGIT_BITS)]
    for k, (column, shift) in enumerate(levels):
        within = F.shiftright(column, shift + DIGIT_BITS) == F.col("at")
        if column == "tie":
            within &= F.col("rank") == F.col("at_rank")
        bins = _same_source(ranked, _small(here)).where(within).groupBy("source", "missing", "below", F.shiftright(column, shift).alias("digits"))
        bins = bins.agg(F.sum("size").alias("size"), F.max("rank").alias("rank"), F.max("tie").alias("tie"), (F.max(F.struct("rank", "tie")) == F.min(F.struct("rank", "tie"))).alias("alone"))
        edge = stage(bins.groupBy("source", "missing").agg(_crossing().alias("edge")).select("source", "missing", "edge.bin.*", "edge.cum"), "edges")
        all_of_it = F.col("cum") < F.col("missing")  # by rounding
        closed = all_of_it | F.col("alone") | F.lit(k == len(levels) - 1)
        cut = F.when(all_of_it, F.lit(1 << (RANK_BITS + 1))).otherwise(F.col("rank"))
        gap = F.col("missing") - F.when(all_of_it, F.col("cum")).otherwise(F.col("cum") - F.col("size"))
        found = edge.where(closed).select("source", cut.alias("cut_rank"), F.col("tie").alias("cut_tie"), gap.alias("gap"))
        done = found if done is None else done.unionAll(found)
        turn = F.lit(0).cast("long") if (column, shift) == ("rank", 0) else F.col("digits")
        here = stage(edge.where(~closed).select("source", "missing", turn.alias("at"), F.col("rank").alias("at_rank"), (F.col("cum") - F.col("size")).alias("below")), "open")
        if here.isEmpty():
            break
    done = stage(done, "cuts")
    beyond = _same_source(ranked, _small(done)).where(~_before()).where("size < 2 * gap")
    nearest = beyond.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "rank", "tie")).alias("best"))
    nearest = nearest.select(F.col("source").alias("_source"), F.col("best.rank").alias("more_rank"), F.col("best.tie").alias("more_tie"))
    return done.join(nearest, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "gap")


def _before() -> Column:
    return (F.col("rank") < F.col("cut_rank")) | ((F.col("rank") == F.col("cut_rank")) & (F.col("tie") < F.col("cut_tie")))


def _copies() -> Column:
    """Certain copies, and one more for the documents that the sample takes."""
    one_more = _before() | ((F.col("rank") == F.col("more_rank")) & (F.col("tie") == F.col("more_tie")))
    return F.col("whole") + F.coalesce(one_more, F.lit(False)).cast("int")


def _plan(rows: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Figures of each source and number of digits, to be joined with rows."""
    shares = _shares(rows, weights)
    cuts = _cuts(_ranked(rows, _small(shares)), shares).withColumnRenamed("source", "_source")
    return _small(stage(shares.join(cuts, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "plan"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The mix: doc_id, source, size, source_size, target, expected, copies, taken for each row.

    Within a source, the expected copies of a document are in proportion to the binary digits of its size, up to three, such that the
    expected words of the source are its target. Their whole part is certain; for the rest, p, it takes part in a Pareto order sample: each document draws a
    uniform u from its id and text, and the documents with the smallest odds(u) / odds(p) are taken as long as their sizes fit into
    what is missing; one more document beyond that cut is taken if its size brings the source nearer to its target.
    The cut of each source is found digit by digit over histograms of the ranks, so that a source with a third of all rows
    is summed in parallel and never sorted in one task, and figures of sources stay in tables.

    Null text has size 0; null sources are one source, the last. Rows that repeat an id and text have the same u, so the same chance, and are
    taken one by one in an order of their own: the cut may run between them. Documents of size 0 or 1 have one digit; the former take
    0 words. Where all sizes are 0, nothing is taken. An empty table gives an empty result. Other columns are ignored.
    """
    rows = stage(docs.select(F.col(id_col).cast("long").alias("doc_id"), *(c.alias(n) for n, c in _sized(docs, id_col, text_col, source_col, seed).items())), "sizes")
    found = _ranked(rows, _plan(rows, weights)).withColumn("copies", _copies().cast("long"))
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).alias("expected"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Each row is drawn where it is read, with the figures of its source: texts are not shuffled. For that docs is read twice; of rows
    that repeat an id and text, the same number is taken if it gives them in the same order both times, as files do.
    """
    kept = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select(kept, *(c.alias(n) for n, c in _sized(docs, id_col, text_col, source_col, seed).items()))
    sizes = stage(rows.drop("row"), "sizes")
    drawn = _ranked(rows, _plan(sizes, weights)).withColumn("copies", _copies()).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
