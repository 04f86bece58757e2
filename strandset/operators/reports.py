"""Reports over reads, intervals, calls and run logs."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def depth_bins(reads: DataFrame, spacing: int, dense: bool = False) -> DataFrame:
    """contig, bin, depth: reads with start bin < bin <= end bin, sampled every `spacing` positions.

    The bin where a read starts isn't counted, so a read inside one bin counts nowhere. Starts and
    ends are summed by bin before the ordered pass; dense adds bins of depth 0 from 0 on.
    """
    r = reads.select("contig", F.floor(F.col("s") / spacing).alias("sb"), F.floor(F.col("e") / spacing).alias("eb")).where("eb > sb")
    ev = r.select("contig", F.explode(F.array(F.struct((F.col("sb") + 1).alias("bin"), F.lit(1).cast("long").alias("d")), F.struct((F.col("eb") + 1).alias("bin"), F.lit(-1).cast("long").alias("d")))).alias("x")).select("contig", "x.*")
    at = ev.groupBy("contig", "bin").agg(F.sum("d").alias("d"))
    w = Window.partitionBy("contig").orderBy("bin")
    runs = at.select("contig", "bin", F.lead("bin").over(w).alias("next"), F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"), F.lag("bin").over(w).isNull().alias("head"))
    each = runs.where("next is not null").select("contig", F.explode(F.sequence(F.when(F.col("head") & F.lit(dense), F.lit(0).cast("long")).otherwise(F.col("bin")), F.col("next") - 1)).alias("b"), "bin", "depth")
    out = each.select("contig", F.col("b").alias("bin"), F.when(F.col("b") < F.col("bin"), F.lit(0).cast("long")).otherwise(F.col("depth")).alias("depth"))
    return out if dense else out.where("depth > 0")


def in_range(bins: DataFrame, spacing: int, start: int, end: int) -> DataFrame:
    """Bins from start to end (positions), as far as there are any; an empty or negative range raises."""
    if not 0 <= start < end:
        raise ValueError("the range must not be empty or negative")
    return bins.where((F.col("bin") >= start // spacing) & (F.col("bin") < end // spacing))


def depth_stats(bins: DataFrame, *keys: str) -> DataFrame:
    """max, min, median, mean and population deviation of depth; keys and, by rollup, all together (null keys)."""
    aggs = [F.max("depth").alias("max_depth"), F.min("depth").alias("min_depth"), F.median("depth").alias("median_depth"), F.avg("depth").alias("mean_depth"), F.stddev_pop("depth").alias("std_depth"), F.count(F.lit(1)).alias("n_bins")]
    return bins.rollup(*keys).agg(*aggs) if keys else bins.agg(*aggs)


def log2_bin(depth: Column, top: int = 15) -> Column:
    """Bin of a depth on a log2 scale; 0 shares the bin of 1."""
    return F.when(depth < 2, F.lit(0)).otherwise(F.least(F.lit(top), F.floor(F.log2(depth)).cast("int")))


def runs(df: DataFrame, value: str, keys: Sequence[str], order: str) -> DataFrame:
    """keys, value, first, last, n: maximal runs of equal values over consecutive numbers in `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.when((F.lag(value).over(w) == F.col(value)) & (F.lag(order).over(w) == F.col(order) - 1), 0).otherwise(1)
    numbered = df.withColumn("_s", step).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run", value).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"), F.avg("depth").alias("mean_depth")).drop("_run")


def depth_threshold_bed(bins: DataFrame, spacing: int, threshold: int) -> DataFrame:
    """contig, s, e, above, depth: runs of bins at or above the threshold or below it; depth is the truncated mean."""
    r = runs(bins.withColumn("above", F.col("depth") >= threshold), "above", ["contig"], "bin")
    return r.select("contig", (F.col("first") * spacing).alias("s"), ((F.col("last") + 1) * spacing).alias("e"), "above", F.col("mean_depth").cast("int").alias("depth"))


def depth_increment_bed(bins: DataFrame, spacing: int, increment: int) -> DataFrame:
    r = runs(bins.withColumn("level", F.expr(f"{increment} * (depth div {increment})")), "level", ["contig"], "bin")
    return r.select("contig", (F.col("first") * spacing).alias("s"), ((F.col("last") + 1) * spacing).alias("e"), F.col("level").alias("depth"))


def weighted_median(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """keys, median: the weighted median, the mean of the two middle values if the weights split evenly."""
    by = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w")).where("_w > 0")
    w = Window.partitionBy(*keys).orderBy(value) if keys else Window.orderBy(value)
    full = Window.partitionBy(*keys) if keys else Window.partitionBy()
    c = by.withColumn("_c", F.sum("_w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_w").over(full))
    low = F.min(F.when(F.col("_c") * 2 >= F.col("_t"), F.col(value)))
    high = F.min(F.when(F.col("_c") * 2 > F.col("_t"), F.col(value)))
    return c.groupBy(*keys).agg(((low + high) / 2.0).alias("median"))


def n50(df: DataFrame, length: str, *keys: str) -> DataFrame:
    """keys, n50: the length at which lengths from the longest down reach half of their sum (halved without rest).

    Equal lengths are counted together first, so the ordered pass sees distinct lengths only.
    """
    by = df.groupBy(*keys, length).agg(F.sum(length).alias("_sum"))
    part = Window.partitionBy(*keys)
    c = by.withColumn("_c", F.sum("_sum").over(part.orderBy(F.desc(length)).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("_sum").over(part))
    return c.where("_c >= _t div 2").groupBy(*keys).agg(F.max(length).alias("n50"))


def length_summary(df: DataFrame, length: str, *keys: str) -> DataFrame:
    s = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("max_len"), F.min(length).alias("min_len"), F.avg(length).alias("mean_len"), F.median(length).alias("median_len"), F.stddev_pop(length).alias("std_len"))
    return s.join(n50(df, length, *keys), list(keys))


def log_histogram(df: DataFrame, length: str, base: int, *keys: str) -> DataFrame:
    level = F.floor(F.log2(length)) if base == 2 else F.floor(F.log(float(base), F.col(length)) + 1e-12)
    return df.where(F.col(length) > 0).groupBy(*keys, level.cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def length_buckets(df: DataFrame, length: str, width: int) -> DataFrame:
    """bucket, n: counts by length // width; empty buckets before the first one are left out, those between are 0."""
    by = df.groupBy(F.floor(F.col(length) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    span = by.agg(F.min("bucket").alias("a"), F.max("bucket").alias("z")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "z")).alias("bucket"))
    return every.join(by, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def read_counts(reads: DataFrame, secondary: int = 256, supplementary: int = 2048, min_mapq: int = 0) -> DataFrame:
    """Counts by contig and in all (null contig): total, secondary, supplementary, kept, and the median mapping quality."""
    flag = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0
    kept = ~flag(secondary) & ~flag(supplementary) & (F.col("mapq") >= min_mapq)
    return reads.rollup("contig").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag(secondary)).alias("n_secondary"), F.count_if(flag(supplementary)).alias("n_supplementary"), F.count_if(kept).alias("n_kept"), F.median("mapq").alias("median_mapq"))


def bucket_coverage(intervals: DataFrame, width: int) -> DataFrame:
    """contig, bucket, bp, density, over_mean, share: overlap of intervals with fixed buckets of positions."""
    each = intervals.where("s < e").select("contig", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("bucket"))
    by = each.groupBy("contig", "bucket").agg(F.sum(F.least(F.col("e"), (F.col("bucket") + 1) * width) - F.greatest(F.col("s"), F.col("bucket") * width)).alias("bp"))
    w = Window.partitionBy("contig")
    return by.select("contig", "bucket", "bp", (F.col("bp") / width).alias("density"), (F.col("bp") / width - F.avg("bp").over(w) / width).alias("over_mean"), (F.col("bp") / F.sum("bp").over(w)).alias("share"))


def covered_total(depths: DataFrame, *keys: str) -> DataFrame:
    """keys, share: the summed fractions of the rows (depth, fraction) that have a depth of one at least."""
    return depths.groupBy(*keys).agg(F.sum(F.when(F.col("depth") >= 1, F.col("fraction")).otherwise(F.lit(0.0))).alias("share"))


def within_call_range(intervals: DataFrame, calls: DataFrame) -> DataFrame:
    """contig, bp, and the total as a row with a null contig: bases of intervals between a contig's first and last call."""
    span = calls.groupBy("contig").agg(F.min("pos").alias("_a"), F.max("pos").alias("_z"))
    inside = F.greatest(F.lit(0).cast("long"), F.least("e", "_z") - F.greatest("s", "_a"))
    return intervals.join(span, "contig").rollup("contig").agg(F.sum(inside).alias("bp"))


def equal_buckets(low: float, high: float, n: int) -> list[float]:
    return [low + i * (high - low) / n for i in range(n + 1)]


def matrix_mean_std(df: DataFrame, array: str, row_length: int, *keys: str) -> DataFrame:
    """keys, idx, mean, std, normed: element-wise over arrays; normed divides a mean by the sum of its row."""
    by = df.select(*keys, F.posexplode(array).alias("idx", "v")).groupBy(*keys, "idx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    row = Window.partitionBy(*keys, F.floor(F.col("idx") / row_length))
    return by.withColumn("normed", F.try_divide(F.col("mean"), F.sum("mean").over(row)))


def class_share(df: DataFrame, cls: str) -> DataFrame:
    by = df.groupBy(cls).agg(F.sum(F.col("e") - F.col("s")).alias("bp"))
    return by.withColumn("share", F.col("bp") / F.sum("bp").over(Window.partitionBy()))


def scores(calls: DataFrame, *keys: str) -> DataFrame:
    """Precision, sensitivity, F and mean quality and depth by class, for keys by rollup; -1 where a class is empty."""
    n = lambda c: F.count_if(F.col("cls") == c)
    mean = lambda col, c: F.coalesce(F.avg(F.when(F.col("cls") == c, F.col(col))).cast("int"), F.lit(-1))
    out = calls.rollup(*keys).agg(n("TP").alias("tp"), n("FP").alias("fp"), n("FN").alias("fn"), *(mean(col, c).alias(f"{col}_{c.lower()}") for col in ("qual", "depth") for c in ("TP", "FP", "FN")))
    out = out.withColumn("precision", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).withColumn("sensitivity", F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fn")))
    return out.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("sensitivity"), F.col("precision") + F.col("sensitivity")), F.lit(0.0)))


def rescored(calls: DataFrame, thresholds: Sequence[int], key: str = "qual", drop_missed: bool = False) -> DataFrame:
    """threshold, tp, fp, fn: below a threshold a true call becomes a missed one and a false call goes."""
    steps = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    low = F.col(key) < F.col("threshold")
    each = calls.groupBy("cls", key).agg(F.count(F.lit(1)).alias("n")).select("*", steps)
    total = lambda on: F.coalesce(F.sum(F.when(on, F.col("n"))), F.lit(0)).cast("long")
    is_ = lambda c: F.col("cls") == c
    missed = (is_("TP") & low) | (is_("FN") & ~low if drop_missed else is_("FN"))
    return each.groupBy("threshold").agg(total(is_("TP") & ~low).alias("tp"), total(is_("FP") & ~low).alias("fp"), total(missed).alias("fn"))


def incomplete_prefixes(names: DataFrame, depth: int, fewest: int, skip: str = "merged") -> DataFrame:
    """prefix, n: dotted names grouped by their first `depth` parts, where fewer than `fewest` names are left."""
    parts = F.split("name", r"\.")
    good = names.where(~F.array_contains(F.slice(parts, 1, depth), skip))
    return good.groupBy(F.array_join(F.slice(parts, 1, depth), ".").alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < fewest)


def block_agreement(blocks: DataFrame) -> DataFrame:
    """agreement, blocks, mean and deviation of lengths: how many files have exactly the same block (contig, s, e)."""
    by = blocks.groupBy("contig", "s", "e").agg(F.countDistinct("file").alias("agreement"))
    return by.groupBy("agreement").agg(F.count(F.lit(1)).alias("blocks"), F.avg(F.col("e") - F.col("s")).alias("mean_len"), F.stddev_pop(F.col("e") - F.col("s")).alias("std_len"))


def block_containment(blocks: DataFrame, width: int = 1000) -> DataFrame:
    """file, contig, s, e, spans, contains, within, crosses: how a block that only one file has meets blocks of other files."""
    from .intervals import range_join

    seen = blocks.groupBy("contig", "s", "e").agg(F.countDistinct("file").alias("_n"), F.min("file").alias("file")).where("_n = 1").select("file", "contig", "s", "e")
    both = range_join(seen, blocks.select("contig", "s", "e", "file").distinct(), width).where("file <> r_file")
    inside, around = (F.col("s") <= F.col("r_s")) & (F.col("r_e") <= F.col("e")), (F.col("r_s") <= F.col("s")) & (F.col("e") <= F.col("r_e"))
    return both.groupBy("file", "contig", "s", "e").agg(F.count(F.lit(1)).alias("meets"), F.count_if(inside).alias("contains"), F.count_if(around).alias("within"), F.count_if(~inside & ~around).alias("crosses"))


def average_depth(calls: DataFrame) -> DataFrame:
    """file (null: all), n, mean_depth: the mean of DP by file and over all calls."""
    return calls.rollup("file").agg(F.count(F.lit(1)).alias("n"), F.avg("dp").alias("mean_depth"))


def log_totals(logs: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Ratios of sums over run logs: for (name, part, whole) the sum of part over the sum of whole; null over 0."""
    return logs.agg(*(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")).alias(n) for n, a, b in pairs))


def summary_mean_std(df: DataFrame, *cols: str) -> DataFrame:
    return df.agg(*(f(c).alias(f"{n}_{c}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
