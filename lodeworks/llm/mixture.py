"""Mixing sources to target weights by Pareto order sampling.

Sizes are words. Each source's target comes from its weight; a document's expected number of copies is proportional to
its own weight and bounded by ``most`` copies, with one factor per source so that expected words equal the target. Whole
copies are certain. The remaining fraction is the inclusion probability ``p``; documents of a source are ranked by
``(u / (1 - u)) / (p / (1 - p))`` with ``u`` a hash of the document, and the lowest ranks are taken up to the words that
are still wanted. The document with which they would be exceeded is the cut; the words missing there go to the documents
behind it that are no larger, again in the order of their ranks, up to a second cut; what is missing then goes to the one
document not taken whose size comes nearest (or to none). So a source's words are off its target by half the document at
the second cut at most, in general by far less.

Nothing goes through the driver. Sources are numbered, and their targets found, by prefix sums over the sorted sources:
within the partitions of a range partitioning, and over one row for each partition. No source is ever ordered as a
whole: ranks are counted in 4096 bins, the bin in which the target falls is cut into 4096 again, and only the documents
of that last bin are put in order.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last in order; documents of
equal rank follow ``doc_id`` (null first) and a hash of the text, and of rows equal in all of these just as many are taken
as are still wanted (which of them makes no difference to the mix); columns of any name stay; an empty table gives no
rows; reruns agree because nothing but the rows' values enters the ranks; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeworks.llm import common

_BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def _prefix(rows: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over the rows before it in ``order``; no task sees more than its range."""
    ranged = common.settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), name)
    parts = ranged.groupBy("part_").agg(*(F.sum(c).alias(f"{n}_") for n, c in sums.items()))
    by_part = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    begins = parts.select("part_", *(F.coalesce(F.sum(f"{n}_").over(by_part), F.lit(0)).alias(f"{n}_") for n in sums))
    inside = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(begins, "part_").withColumns({n: F.col(f"{n}_") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).drop("part_", "at_", *(f"{n}_" for n in sums))


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``source, source_size, target``: shares of all words by weight, none above ``most`` times its source, settled.

    What full sources can't take is shared again by weight among the others. In order of ``most * size / weight`` the
    full ones come first, and the level at which the others are filled follows from the sums before the first of them.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    counted = _prefix(sums, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1).cast("long")}, "mix-sources")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    full = (F.col("source_size") * most).cast("double")
    rows = counted.withColumn("share", weight).withColumns({"full": full, "ratio": full / F.col("share")})
    # sums of words as decimals, exact in any order
    before = _prefix(rows.select("source", "source_size", "share", "full", "ratio"), [F.col("ratio"), F.col("source").isNull(), F.col("source")], {"size_before": F.col("source_size"), "share_before": F.col("share")}, "mix-ratios")
    total = before.agg(F.sum("source_size").alias("words"), F.sum("share").alias("shares"))
    level = (F.col("words") - F.col("size_before") * most) / (F.col("shares") - F.col("share_before"))
    levels = before.crossJoin(F.broadcast(total)).withColumn("level", level)  # total is one row
    first = levels.where(F.col("level") <= F.col("ratio")).agg(F.min_by("level", F.struct("ratio", F.col("source").isNull(), "source")).alias("level"))
    filled = before.crossJoin(F.broadcast(first))  # one row
    return common.settle(filled.select("source", "source_size", F.least(F.col("full"), F.coalesce(F.col("level") * F.col("share"), F.col("full"))).alias("target")), "mix-targets")


def _factors(classes: DataFrame, goals: DataFrame, most: float) -> DataFrame:
    """``goals`` with ``factor``: ``f`` with ``sum(size * min(most, f * weight)) = target`` over ``classes(source, weight, n)``.

    In order of falling weights the bounded classes come first; the factor follows from the first class that isn't.
    """
    order = Window.partitionBy("source").orderBy(F.desc("weight"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    useful = classes.where("weight > 0 and n > 0").withColumnRenamed("source", "s").join(goals, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    f = (F.col("target") - most * F.coalesce(F.sum("n").over(before), F.lit(0))) / F.sum(F.col("weight") * F.col("n")).over(after)
    first = useful.withColumn("f", f).where(F.col("f") * F.col("weight") <= most).groupBy("source").agg(F.max_by("f", "weight").alias("factor"))
    joined = goals.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("factor", F.coalesce("factor", F.lit(float("inf"))))


def _ranked(rows: DataFrame, plan: DataFrame, most: float, seed: int) -> DataFrame:
    """``rows`` (with ``size, weight, tie``) and their expected copies and ranks, by one row per source of ``plan``."""
    joined = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    expected = F.when(F.col("weight") > 0, F.least(F.lit(float(most)), F.col("factor") * F.col("weight"))).otherwise(0.0)
    u = (F.xxhash64(F.lit(seed), "doc_id", "source", "tie").bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)
    return (
        joined.withColumn("expected", expected)
        .withColumn("certain", F.floor("expected").cast("long"))
        .withColumn("p", F.col("expected") - F.col("certain"))
        .withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) * (1 - F.col("p")) / F.col("p")))
        .withColumn("order", F.col("q") / (1 + F.col("q")))  # the same order within 0 to 1
        .drop("q")
    )


def _sized(docs: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    chosen = weight if weight is not None else F.when(F.col("size") < 32, F.lit(0.5)).otherwise(F.lit(1.0))
    return docs.withColumn("size", word_count(F.col("text"))).withColumns({"weight": chosen.cast("double"), "tie": F.xxhash64("text", F.lit(seed))})


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    return left.join(right.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), how).drop("s")


def _cut(bins: DataFrame, name: str, cut: str) -> DataFrame:
    """``source``, the bin in which the wanted words run out, and the words wanted there; of ``bins(source, name, n, wanted)``."""
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    crossing = bins.withColumn("so_far", so_far).where(F.col("so_far") > F.col("wanted"))
    return crossing.groupBy("source").agg(F.min(F.struct(F.col(name).alias("bin"), (F.col("wanted") - F.col("so_far") + F.col("n")).alias("left"))).alias("m")).select("source", F.col("m.bin").alias(cut), F.col("m.left").alias("wanted"))


_DOC = "coalesce(doc_id, -9223372036854775808)"  # nulls first, as in the windows


def _crossing(rows: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """``source, cut, cut_fit, missing``: where the words of ``wanted(source, wanted)`` run out among ``rows``, in rank order, settled.

    ``cut`` is the document that would exceed them, ``cut_fit`` how many rows equal to it still fit, ``missing`` the words
    left then. A source whose rows all fit has no row.
    """
    bins = _by_source(rows.groupBy("source", "coarse").agg(F.sum("size").alias("n")), wanted)
    coarse = common.settle(_cut(bins, "coarse", "cut_coarse"), f"{name}-coarse")
    inside = _by_source(rows, coarse).where("coarse = cut_coarse")
    fine = _cut(inside.groupBy("source", "fine", "wanted").agg(F.sum("size").alias("n")), "fine", "cut_fine")
    last = common.settle(_by_source(fine, coarse.select("source", "cut_coarse")), f"{name}-fine")
    edge = _by_source(rows, last).where("coarse = cut_coarse and fine = cut_fine")
    # rows equal in all that ranks them are one step with a count
    steps = edge.groupBy("source", "here", "size", "wanted").agg(F.count("*").alias("rows"))
    w = Window.partitionBy("source").orderBy("here").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("wanted") - (F.sum(F.col("size") * F.col("rows")).over(w) - F.col("size") * F.col("rows"))
    over = steps.withColumn("left", left).where(F.col("size") * F.col("rows") > F.col("left"))
    first = over.groupBy("source").agg(F.min(F.struct("here", "size", "left")).alias("c")).select("source", "c.*")
    fit = F.floor(F.col("left") / F.col("size")).cast("long")
    return common.settle(first.select("source", F.col("here").alias("cut"), fit.alias("cut_fit"), (F.col("left") - fit * F.col("size")).alias("missing")), f"{name}-cut")


_DOC = "coalesce(doc_id, -9223372036854775808)"  # nulls first, as in the windows


def plan_mix(sized: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """One row per source: ``source_size, target, factor``, the cuts and the pick, settled.

    With it, whether and how often a document is taken follows from its own row: documents before ``cut`` are taken and
    ``cut_fit`` rows equal to it; then those behind it of at most ``room`` words and before ``cut2``, and ``cut2_fit``
    equal to that; and one row equal to ``pick``. A null ``cut`` takes all, a null ``cut2`` all that have room.
    """
    goals = targets(sized, weights, most)
    named = common.settle(_factors(sized.groupBy("source", "weight").agg(F.sum("size").alias("n")), goals, most), "mix-factors")
    coarse_bin = F.least(F.floor(F.col("order") * _BINS), F.lit(_BINS - 1)).cast("int")
    fine_bin = F.least(F.floor((F.col("order") * _BINS - F.col("coarse")) * _BINS), F.lit(_BINS - 1)).cast("int")
    here = F.struct("order", F.expr(_DOC).alias("doc"), "tie").alias("here")
    ranked = _ranked(sized, named, most, seed).withColumn("coarse", coarse_bin).withColumn("fine", fine_bin)
    ranked = common.settle(ranked.select("source", "size", "certain", "p", "coarse", "fine", here), "mix-ranked")
    certain = ranked.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("certain"))
    wanted = _by_source(named.select("source", "target"), certain).select("source", (F.col("target") - F.col("certain")).alias("wanted"))
    chance = ranked.where("p > 0").select("source", "size", "coarse", "fine", "here")
    cut = _crossing(chance, wanted, "mix")
    behind = _by_source(chance.where("size > 0"), cut.select("source", "cut", F.col("missing").alias("room")))
    fitting = behind.where((F.col("here") > F.col("cut")) & (F.col("size") <= F.col("room"))).select("source", "size", "coarse", "fine", "here")
    cut2 = _crossing(fitting, cut.select("source", F.col("missing").alias("wanted")), "mix-second")
    second = cut2.select("source", F.col("cut").alias("cut2"), F.col("cut_fit").alias("cut2_fit"), F.col("missing").alias("missing2"))
    filled = fitting.groupBy("source").agg(F.sum("size").alias("filled"))
    both = _by_source(_by_source(cut.withColumnRenamed("missing", "room"), second, "left"), filled, "left")
    both = common.settle(both.withColumn("rest", F.coalesce("missing2", F.col("room") - F.coalesce("filled", F.lit(0)))), "mix-cuts")
    free = _by_source(chance.where("size > 0"), both.select("source", "cut", "room", "cut2", "rest"))
    untaken = (F.col("here") == F.col("cut")) | ((F.col("here") > F.col("cut")) & ((F.col("size") > F.col("room")) | F.coalesce(F.col("here") >= F.col("cut2"), F.lit(False))))
    near = free.where(untaken).groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), F.col("here").alias("pick"), "rest")).alias("n"))
    pick = near.select("source", F.when(F.col("n.off") < F.col("n.rest"), F.col("n.pick")).alias("pick"))
    plan = _by_source(_by_source(named, both.select("source", "cut", "cut_fit", "room", "cut2", "cut2_fit"), "left"), pick, "left")
    return common.settle(plan, "mix-plan")


def apply_mix(rows: DataFrame, plan: DataFrame, most: int = 3, seed: int = 0) -> DataFrame:
    """``rows`` with ``source_size, target, expected, copies``.

    Each row is decided by itself; only rows equal to a source's cut or pick are numbered, by a window over those alone.
    """
    ranked = _ranked(rows, plan, most, seed).withColumn("here", F.struct("order", F.expr(_DOC).alias("doc"), "tie"))
    cut, cut2, pick, here = (F.col(c) for c in ("cut", "cut2", "pick", "here"))
    chance = F.col("p") > 0
    counted = F.coalesce(chance & ((here == cut) | (here == cut2) | (here == pick)), F.lit(False))
    small = (here > cut) & (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    before = cut.isNull() | (here < cut) | (small & (cut2.isNull() | (here < cut2)))
    plain = ranked.where(~counted).withColumn("copies", F.col("certain") + F.coalesce(chance & before, F.lit(False)).cast("long"))
    number = F.row_number().over(Window.partitionBy("source", "here").orderBy("order"))
    # a pick among the rows that are taken anyway can't be: it is one of the others
    fit = F.coalesce(F.when(here == cut, F.col("cut_fit")), F.when(here == cut2, F.col("cut2_fit")), F.lit(0)) + F.coalesce((here == pick).cast("long"), F.lit(0))
    last = ranked.where(counted).withColumn("copies", F.col("certain") + (number <= fit).cast("long"))
    return plain.unionByName(last).drop("certain", "p", "order", "factor", "cut", "cut_fit", "room", "cut2", "cut2_fit", "pick", "here")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, weight: Column | None = None, seed: int = 0) -> DataFrame:
    """Returns ``doc_id, source, size, source_size, target, weight, expected, copies, taken``.

    ``weight`` is a document's weight within its source, from a small set of values (default: texts under 32 words
    count half, longer ones 1). It is a function of ``size`` and the columns of ``docs``.
    """
    # one pass over the texts; later steps see a few numbers a document
    sized = common.settle(_sized(docs, weight, seed).select("doc_id", "source", "size", "weight", "tie"), "mix-sizes")
    mixed = apply_mix(sized, plan_mix(sized, weights, most, seed), most, seed)
    return mixed.withColumn("taken", (F.col("copies") * F.col("size")).cast("long")).drop("tie")


def take(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), most: int = 3, seed: int = 0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns only."""
    columns = docs.columns
    own = [F.col(c).alias(c) for c in ("doc_id", "text", "source")]
    kept = F.struct(*(F.col(c) for c in columns if c != "text")).alias("kept")  # out of the way of the mix's own names
    rows = _sized(docs.select(*own, kept), None, seed)
    sized = common.settle(rows.select("doc_id", "source", "size", "weight", "tie"), "mix-sizes")
    mixed = apply_mix(rows, plan_mix(sized, weights, most, seed), most, seed).where("copies > 0")
    each = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*(F.col("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in columns))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "expected", "copies")
