"""Mixing sources to target weights with hash-threshold histograms. JVM-side only.

Every row gets a 60-bit hash of its id. Whether a row is taken depends on its source's hash
threshold alone, so nothing is ever sorted: the sizes are summed by (source, hash bucket), the
bucket in which the running sum crosses the source's budget is found, and only the rows of that
boundary bucket are summed again at the next bits of the hash, and so on. Budgets are nested:
a larger budget takes every row that a smaller one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh, near

#: Bits of the hash used at each level, and levels.
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] | None, share: float, most: float) -> DataFrame:
    """Budget of each source: ``source, source_size, target``.

    ``sizes`` has one row for each source: source, source_size, and a weight column unless
    ``weights`` is given, which is dealt out to the sources by code point, null last, repeating.
    ``share`` times the total size is shared by weight; no target exceeds ``most`` times its
    source's size, and the excess is shared anew by weight until none does (water filling: with
    the sources in the order of size over weight, a source is at its limit exactly if the level
    that remains for it and all later ones is at or above its limit).
    A total of 0 gives every source the target 0.
    """
    if weights is not None:
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        sizes = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    limit = F.col("source_size") * F.lit(float(most))
    order = [(limit / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = F.greatest(F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum(limit).over(before), F.lit(0.0)), F.lit(0.0)) / F.sum("weight").over(onward)
    return sizes.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("weight") >= limit).withColumn(
        "_final", F.min(F.when(~F.col("_full"), F.struct(limit / F.col("weight"), F.col("source").isNull(), "source", F.col("_level").alias("level")))).over(whole)["level"]
    ).select("source", "source_size", F.when(F.col("_full"), limit).otherwise(F.col("_final") * F.col("weight")).alias("target"))


def _hash(row_id: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(row_id.cast("string"), F.lit("mix")), 64 - BITS * LEVELS)


def _thresholds(base: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``gs, source_size, target, whole, threshold`` for each source of base(id, source, size, h)."""
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sums, weights, share, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(rate).cast("int")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long"))
    goal = checkpointed(goal.withColumnRenamed("source", "gs"))
    for level in range(LEVELS):
        here = base.select("source", "size", F.shiftrightunsigned(F.col("h"), BITS * (LEVELS - 1 - level)).alias("b"))
        if level:  # only the rows of a boundary bucket are summed again
            here = here.join(near(goal.select("gs", "prefix")), F.col("source").eqNullSafe(F.col("gs")) & (F.shiftrightunsigned(F.col("b"), BITS) == F.col("prefix"))).drop("gs", "prefix")
        running = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        summed = here.groupBy("source", "b").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(running))
        fits = F.col("upto") <= F.col("left")
        level_sums = goal.join(summed, F.col("gs").eqNullSafe(F.col("source")), "left").groupBy(*goal.columns).agg(F.min(F.when(~fits, F.struct("b", "n"))).alias("over"), F.max(F.when(fits, F.col("upto"))).alias("spent"))
        end = F.shiftleft(F.col("prefix") + 1, BITS) if level else F.lit(1 << BITS).cast("long")  # all rows fit
        left = F.col("left") - F.coalesce("spent", F.lit(0))
        # The last boundary is one hash value: its rows are taken if that comes nearer to the target.
        nearer = (F.col("over.n") < 2 * left).cast("long") if level == LEVELS - 1 else F.lit(0)
        goal = checkpointed(level_sums.select("gs", "source_size", "target", "whole", left.alias("left"), F.coalesce(F.col("over.b") + nearer, end).alias("prefix")))
    # Nothing is left for a source whose target is whole passes: rows of size 0 aren't taken once more.
    more = F.col("target") > F.col("whole") * F.col("source_size")
    return goal.select("gs", "source_size", "target", "whole", F.when(more, F.col("prefix")).otherwise(F.lit(0)).alias("threshold"))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None) -> DataFrame:
    size = word_count(F.col(text_col)) if size is None else F.coalesce(size.cast("long"), F.lit(0))
    # The texts are read once: what follows works on short columns.
    return checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _hash(F.col(id_col)).alias("h")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1.0,), share: float = 1.0, most: float = 1.0, size: Column | None = None) -> DataFrame:
    """How often each row is taken so that the sources' sizes come to their targets.

    Returns ``id_col, size, source_size, target, copies, taken`` for every row (``taken`` is size
    times copies). A source whose target is r times its size gives each row floor(r) times, and
    once more for the rows whose hash lies under the source's threshold. The rows at
    the threshold are taken if that comes nearer to the budget, so a source misses it by at most half
    of what the rows of one 60-bit hash value hold, and no row is taken more than ceil(``most``) times.

    Null text: size 0. Null source: a source of its own. Rows of size 0 follow their hash. Rows
    that share an id share the hash and are taken or left together; a null id is one id.
    An empty input gives no rows. Other columns, whatever their names, play no part.
    """
    base = _base(docs, id_col, text_col, source_col, size)
    goal = _thresholds(base, weights, share, most)
    out = base.join(near(goal), F.col("source").eqNullSafe(F.col("gs")))
    out = out.withColumn("copies", F.col("whole") + F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("int"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1.0,), share: float = 1.0, most: float = 1.0, size: Column | None = None) -> DataFrame:
    """The rows of ``docs``, all columns kept, each repeated as often as :func:`mix` takes it.

    The texts are not shuffled: a row's copies follow from its id and its source's threshold.
    Nulls, ties and empty tables: as in :func:`mix`.
    """
    goal = _thresholds(_base(docs, id_col, text_col, source_col, size), weights, share, most)
    names = fresh(docs, "mix_gs", "mix_whole", "mix_threshold", "mix_copy")
    goal = goal.select("gs", "whole", "threshold").toDF(*names[:3])
    gs, whole, threshold = (F.col(n) for n in names[:3])
    out = docs.join(near(goal), F.col(source_col).eqNullSafe(gs))
    copies = whole + (_hash(F.col(id_col)) < threshold).cast("int")
    return out.withColumn(names[3], F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
