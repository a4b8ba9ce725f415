"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

Every document of a source is expected target/size times in the mix. Its whole copies are certain; the fractional part is
its inclusion probability p. Documents are ranked by Q = (u / (1 - u)) / (p / (1 - p)) with u a hash of the id, and the
sample is the prefix of that order whose words come nearest to what the whole copies leave of the target.

The prefix is found without sorting a source in one task: Q / (1 + Q) falls into BINS bins, their words are summed before
any shuffle, and only the one bin per source in which the target is reached is ordered, equal rows as one with their number.

Defined cases: null or empty text has size 0 and is taken 0 times over; a null source is a source of its own, last in
order; a null id hashes as an empty one; rows that repeat an id share u and follow one another by size, hash of the text and
row number, so any number of equal rows can be taken; an empty table gives an empty result; all sizes 0 give targets 0. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BINS = 16384
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = SEED) -> Column:
    """In (0, 1), from 52 bits of an md5: the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size). The water level: with sources in order of cap / weight, the
    first j whose level (total - caps before j) / (weights from j) is at most its own cap / weight ends the capped ones."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (n % len(weights) + 1).cast("int"))
    caps = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    leveled = caps.withColumn("total", F.sum("source_size").over(whole) * F.lit(share)).withColumn(
        "level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(on)
    )
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(whole)
    target = F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double")))
    return leveled.select("source", "source_size", target.alias("target"))


def pareto_order(u: Column, p: Column) -> Column:
    """Random odds over inclusion odds; null where p is 0 (never drawn)."""
    return F.when(p > 0, (u / (1 - u)) * ((1 - p) / p))


def _ranked(sized: DataFrame, per: DataFrame) -> DataFrame:
    """sized rows with their source's columns, rank q and bin."""
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = sized.join(per.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    return (
        joined.withColumn("whole", F.floor(expected).cast("long"))
        .withColumn("q", pareto_order(uniform(F.col("doc_id")), expected - F.floor(expected)))
        .withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    )


def plan(sized: DataFrame, **targets) -> DataFrame:
    """A row per source of sized: its target and where its sample ends, as bin and (q, doc_id, size, mark, row).

    Rows of the edge bin that are equal but for their row number are counted by block of row numbers before the order is
    followed; a group of n rows takes what fits, and only the rows of the last group's block are numbered."""
    per = common.materialise(source_targets(sized, **targets), "mix-targets")  # a true size lets the planner broadcast it, or not
    ranked = _ranked(sized, per).where("bin is not null and size > 0").withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    bins = ranked.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("left").alias("left"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = bins.where("before <= left and before + words > left").groupBy("source").agg(F.max("bin").alias("edge"), F.max_by("before", "bin").alias("before"))
    edge = common.materialise(edge.withColumnRenamed("source", "__source"), "mix-edges")
    at_edge = ranked.join(edge, F.col("source").eqNullSafe(F.col("__source")) & (F.col("bin") == F.col("edge")))
    equal = at_edge.groupBy("source", "q", "doc_id", "size", "mark", _block().alias("block")).agg(F.count("*").alias("n"), F.first(F.col("left") - F.col("before")).alias("left"))
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size", "mark", "block").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(order), F.lit(0))
    over = F.col("rest") - F.floor(F.col("rest") / F.col("size")) * F.col("size")
    fits = F.floor(F.col("rest") / F.col("size")) + F.when(F.col("size") - over < over, 1).otherwise(0)  # the last one may overshoot if that comes nearer
    taken = equal.withColumn("rest", rest).where("rest > 0").withColumn("k", F.least(F.col("n"), fits)).where("k > 0")
    last = taken.groupBy("source").agg(F.max(F.struct("q", "doc_id", "size", "mark", "block", "k")).alias("last"))
    last = common.materialise(last.withColumnRenamed("source", "__source"), "mix-last")
    here = F.struct("q", "doc_id", "size", "mark", _block().alias("block"))
    stop = F.struct("last.q", "last.doc_id", "last.size", "last.mark", "last.block")
    group = at_edge.drop("__source").join(last, F.col("source").eqNullSafe(F.col("__source")) & here.eqNullSafe(stop))
    numbered = group.withColumn("number", F.row_number().over(Window.partitionBy("source", "last.block").orderBy("row")))
    ends = numbered.where("number <= last.k").groupBy(F.col("source").alias("__at")).agg(F.max(F.struct("q", "doc_id", "size", "mark", "row")).alias("end"))
    out = per.join(edge, F.col("source").eqNullSafe(F.col("__source")), "left").join(ends, F.col("source").eqNullSafe(F.col("__at")), "left")
    return common.materialise(out.select("source", "source_size", "target", "edge", "end"), "mix-plan")


def copies(sized: DataFrame, planned: DataFrame) -> DataFrame:
    """Rows with their number of copies, each told by its own values and its source's plan: no document is shuffled."""
    at = F.struct("q", "doc_id", "size", "mark", "row")
    inside = F.col("edge").isNull() | (F.col("bin") < F.col("edge")) | ((F.col("bin") == F.col("edge")) & F.coalesce(at <= F.col("end"), F.lit(False)))
    more = F.coalesce((F.col("size") > 0) & F.col("q").isNotNull() & inside, F.lit(False))
    return _ranked(sized, planned).withColumn("copies", F.col("whole") + more.cast("long"))


def _sized(docs: DataFrame, *more: Column) -> DataFrame:
    """Rows (doc_id, source, size, mark, row), written once, so that row numbers stay what they are."""
    return docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"), *more)


def _block() -> Column:
    """Row numbers hold the partition in their upper bits; a block is at most 2**16 rows of one."""
    return F.shiftright("row", 16)


def mix(docs: DataFrame, **targets) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken."""
    sized = common.materialise(_sized(docs), "mix-sizes")
    out = copies(sized, plan(sized, **targets))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, **targets) -> DataFrame:
    """The rows of docs, whole, each as often as the mix takes it."""
    whole = common.materialise(_sized(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")), "mix-rows")
    planned = plan(whole.drop("__row"), **targets)
    taken = copies(whole, planned).where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
v AS (SELECT min_by(level, ratio) FILTER (level <= ratio) AS level FROM l),
t AS (SELECT l.source, source_size, least(cap::DOUBLE, coalesce(v.level * weight, cap::DOUBLE)) AS target FROM l, v),
e AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS m
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(m)::BIGINT AS whole, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0 AS u FROM e),
p AS (SELECT *, CASE WHEN m - whole > 0 THEN (u / (1 - u)) * ((1 - (m - whole)) / (m - whole)) END AS q, target - whole * source_size AS rest0 FROM q),
c AS (SELECT *, rest0 - coalesce(sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM p)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN q IS NOT NULL AND size > 0 AND rest > 0 AND (size <= rest OR size - rest < rest) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""
