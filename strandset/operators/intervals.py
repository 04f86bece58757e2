"""Interval algebra on half-open intervals (contig, s, e)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.s") < F.col(f"{b}.e")) & (F.col(f"{b}.s") < F.col(f"{a}.e"))


def range_join(left: DataFrame, right: DataFrame, width: int = 1000, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """Pairs of overlapping intervals: columns of left as they are, right's with the prefix `r_` (but for keys).

    Each interval is dealt to the bins it touches, so the join is an equi-join; a pair is kept only
    in the bin where the later of the two starts lies, so it comes once. A contig never lands in
    one task as a whole, and adaptive execution can split a bin that is too full.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width)))
    a = left.where("s < e").withColumn("_bin", bins("s", "e"))
    b = right.where("s < e").withColumn("_bin", bins("s", "e"))
    b = b.select(*keys, "_bin", *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    both = a.join(b, [*keys, "_bin"])
    return both.where((F.col("s") < F.col("r_e")) & (F.col("r_s") < F.col("e")) & (F.col("_bin") == F.floor(F.greatest("s", "r_s") / width))).drop("_bin")


def cut(df: DataFrame, width: int) -> DataFrame:
    """df cut at bins of positions, a row with _bin for each bin that an interval touches."""
    bins = df.where("s < e").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))))
    return bins.withColumns({"s": F.greatest("s", F.col("_bin") * width), "e": F.least("e", (F.col("_bin") + 1) * width)})


def dealt(df: DataFrame, width: int = 256, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """df cut at bins of positions, a row with _bin for each bin that an interval touches, and dealt by keys and _bin.

    What is then expanded to positions and grouped by keys, _bin and pos needs no further exchange:
    intervals are shuffled, some 1 + length / width times, instead of their positions.
    """
    return cut(df, width).repartition(*keys, "_bin")


def contained_points(points: DataFrame, intervals: DataFrame, inside: bool = True, width: int = 1000) -> DataFrame:
    """points (contig, pos) inside some interval, or outside of all; each once, contigs without intervals are outside."""
    bins = intervals.where("s < e").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width)))).select(F.col("contig").alias("_c"), "_bin", F.col("s").alias("_s"), F.col("e").alias("_e"))
    on = (F.col("contig") == F.col("_c")) & (F.floor(F.col("pos") / width) == F.col("_bin")) & (F.col("pos") >= F.col("_s")) & (F.col("pos") < F.col("_e"))
    return points.join(bins, on, "left_semi" if inside else "left_anti")


def islands(df: DataFrame, keys: Sequence[str] = ("contig",), touching: bool = False, width: int = 1000) -> DataFrame:
    """keys, s, e, n: maximal runs of overlapping intervals (touching ones too if asked) and how many they hold.

    Intervals are merged within bins of starts first, so the ordered pass over a contig sees the
    merged runs of each bin only.
    """

    def merged(rows: DataFrame, part: list[str]) -> DataFrame:
        w = Window.partitionBy(*part).orderBy("s", "e")
        reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
        new = F.when(reach.isNull() | (F.col("s") > reach if touching else F.col("s") >= reach), 1).otherwise(0)
        rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return rows.groupBy(*part, "_run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("_run")

    rows = df.where("s < e").select(*keys, "s", "e", F.lit(1).cast("long").alias("n"), F.floor(F.col("s") / width).alias("_bin"))
    return merged(merged(rows, [*keys, "_bin"]).drop("_bin"), [*keys])


def with_island(df: DataFrame, runs: DataFrame, width: int = 1000) -> DataFrame:
    """df with island, the start of the run that holds an interval; runs are disjoint, so one bin of each interval suffices."""
    b = runs.select("contig", F.col("s").alias("island"), F.col("e").alias("_e"), F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("_bin"))
    a = df.withColumn("_bin", F.floor(F.col("s") / width))
    return a.join(b, ["contig", "_bin"]).where((F.col("s") >= F.col("island")) & (F.col("s") < F.col("_e"))).drop("_bin", "_e")


def first_fit(starts: Sequence[int], ends: Sequence[int]) -> list[int]:
    """Colour of each interval, in order of starts: the lowest colour that is free."""
    import heapq

    free: list[int] = []
    busy: list[tuple[int, int]] = []
    out, used = [], 0
    for s, e in zip(starts, ends):
        while busy and busy[0][0] <= s:
            heapq.heappush(free, heapq.heappop(busy)[1])
        if free:
            c = heapq.heappop(free)
        else:
            c, used = used, used + 1
        heapq.heappush(busy, (e, c))
        out.append(c)
    return out


def colours(df: DataFrame, width: int = 1000) -> DataFrame:
    """contig, island, read_id, s, e, colour: tiling paths by first fit in order of start, longer first, then read_id.

    All colours are free where an island ends, so islands are coloured one by one, each in its own
    task; intervals of one colour don't overlap, and there are as many colours as the largest depth.
    """
    import pandas as pd

    def paint(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_n=pdf["s"] - pdf["e"]).sort_values(["s", "_n", "read_id"]).drop(columns="_n")
        return pdf.assign(colour=first_fit(pdf["s"].tolist(), pdf["e"].tolist()))

    rows = with_island(df.where("s < e"), islands(df, width=width), width).select("contig", "island", "read_id", "s", "e")
    return rows.groupBy("contig", "island").applyInPandas(paint, "contig string, island long, read_id string, s long, e long, colour int")


def coverage_cap(coloured: DataFrame, max_depth: int = 64) -> DataFrame:
    """Whole tiling paths, the last ones first, are dropped until the depth is max_depth."""
    return coloured.where(F.col("colour") < max_depth)


def running(at: DataFrame, keys: Sequence[str], width: int = 10_000) -> DataFrame:
    """keys, pos, d, next, total: the following position, and the sum of d so far, for distinct positions.

    Ordered windows are inside bins of positions; a second one over the bins, a row each, carries
    sums and first positions from bin to bin, so no task holds a contig's positions.
    """
    at = at.select(*keys, "pos", "d", F.floor(F.col("pos") / width).alias("_bin"))
    over = Window.partitionBy(*keys).orderBy("_bin")
    bins = at.groupBy(*keys, "_bin").agg(F.sum("d").alias("_t"), F.min("pos").alias("_first"))
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_carry"), F.lead("_first").over(over).alias("_after"))
    w = Window.partitionBy(*keys, "_bin").orderBy("pos")
    total = F.col("_carry") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return at.join(bins, [*keys, "_bin"]).select(*keys, "pos", "d", F.coalesce(F.lead("pos").over(w), F.col("_after")).alias("next"), total.alias("total"))


def segments(df: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """keys, s, e, depth: maximal intervals with a constant set of boundaries, where depth is above 0.

    Starts and ends are summed by position before the ordered passes, which go by bins.
    """
    df = df.where("s < e")
    events = df.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).cast("long").alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).cast("long").alias("d")))).alias("x")).select(*keys, "x.*")
    at = events.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))
    out = running(at, keys).select(*keys, F.col("pos").alias("s"), F.col("next").alias("e"), F.col("total").alias("depth"))
    return out.where("e is not null and depth > 0")


def columns(df: DataFrame, width: int = 100) -> DataFrame:
    """contig, s, e, read_ids (ordered), depth: maximal intervals with a constant set of reads.

    A bin's reads become one ordered array, from which each segment that starts there takes its own: pairs aren't shuffled.
    """
    seg = segments(df).select("contig", "s", "e").withColumn("_bin", F.floor(F.col("s") / width))
    parts = dealt(df.select("contig", "s", "e", "read_id"), width).groupBy("contig", "_bin").agg(F.array_sort(F.collect_list(F.struct("read_id", "s", "e"))).alias("_reads"))
    here = F.filter("_reads", lambda r: (r["s"] <= F.col("s")) & (F.col("s") < r["e"]))  # a read at a segment's start has all of it
    return seg.join(parts, ["contig", "_bin"]).select("contig", "s", "e", F.transform(here, lambda r: r["read_id"]).alias("read_ids")).withColumn("depth", F.size("read_ids"))


def complement(df: DataFrame, spans: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """The parts of spans (keys, s, e: one for each contig) that no interval covers."""
    runs = islands(df, keys, touching=True)
    w = Window.partitionBy(*keys).orderBy("s")
    runs = runs.withColumn("prev", F.lag("e").over(w)).withColumn("last", F.lead("s").over(w).isNull())
    full = spans.select(*keys, F.col("s").alias("lo"), F.col("e").alias("hi"))
    j = full.join(runs, [*keys], "left")
    gaps = F.when(F.col("s").isNull(), F.array(F.struct(F.col("lo").alias("s"), F.col("hi").alias("e")))).otherwise(
        F.concat(F.array(F.struct(F.coalesce("prev", "lo").alias("s"), F.col("s").alias("e"))), F.when(F.col("last"), F.array(F.struct(F.col("e").alias("s"), F.col("hi").alias("e")))).otherwise(F.array().cast("array<struct<s:bigint,e:bigint>>")))
    )
    out = j.select(*keys, "lo", "hi", F.explode(gaps).alias("g"))
    return out.select(*keys, F.greatest("lo", "g.s").alias("s"), F.least("hi", "g.e").alias("e")).where("s < e")


def membership(df: DataFrame, set_index: str, keys: Sequence[str] = ("contig",)) -> DataFrame:
    """keys, s, e, bitmap: elementary segments and the sets (bit numbers in set_index) that cover them."""
    merged = islands(df, [*keys, set_index], touching=True)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(set_index).cast("int"))
    events = merged.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("pos"), bit.alias("d")), F.struct(F.col("e").alias("pos"), (-bit).alias("d")))).alias("x")).select(*keys, "x.*")
    at = events.groupBy(*keys, "pos").agg(F.sum("d").alias("d"))  # intervals of a set are disjoint, so sums of bits are masks
    out = running(at, keys).select(*keys, F.col("pos").alias("s"), F.col("next").alias("e"), F.col("total").alias("bitmap"))
    return out.where("e is not null and bitmap <> 0")


def subset_coverage(bitmaps: DataFrame, n_sets: int) -> DataFrame:
    """mask, bp: length covered by all sets of each non-empty subset.

    Lengths are summed by bitmap first, so the subsets meet 2**n_sets rows at most.
    """
    by = bitmaps.groupBy("bitmap").agg(F.sum(F.col("e") - F.col("s")).alias("bp"))
    return by.withColumn("mask", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << n_sets) - 1).cast("long")))).where("bitmap & mask = mask").groupBy("mask").agg(F.sum("bp").alias("bp"))


def coverage(df: DataFrame, keys: Sequence[str] = ("contig",)) -> DataFrame:
    runs = islands(df, keys, touching=True)
    return runs.groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).alias("bp"), F.count(F.lit(1)).alias("runs"))


def feature_overlap(sets: DataFrame, features: DataFrame, name: str, feature: str, width: int = 1000) -> DataFrame:
    """name, feature, bp, feature_bp, share: how much of each feature class each set covers."""
    a = islands(sets, ["contig", name], touching=True, width=width).drop("n")
    b = islands(features, ["contig", feature], touching=True, width=width).drop("n")
    both = range_join(a, b, width).groupBy(name, F.col(f"r_{feature}").alias(feature)).agg(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s")).alias("bp"))
    total = b.groupBy(feature).agg(F.sum(F.col("e") - F.col("s")).alias("feature_bp"))
    return both.join(total, feature).withColumn("share", F.col("bp") / F.col("feature_bp"))


def nearest_boundary(points: DataFrame, boundaries: DataFrame, keys: Sequence[str] = ("contig",), width: int = 1000) -> DataFrame:
    """points (keys, pos and others) with distance to the nearest boundary (keys, pos) on either side.

    Boundaries of a bin become its first and last one; a bin without one takes those of the nearest
    bins that have some, found over bins rather than points.
    """
    b = boundaries.select(*keys, F.floor(F.col("pos") / width).alias("_bin"), F.col("pos").alias("_b"))
    lists = b.groupBy(*keys, "_bin").agg(F.array_sort(F.collect_set("_b")).alias("_list"))
    bins = points.select(*keys, F.floor(F.col("pos") / width).alias("_bin")).union(lists.select(*keys, "_bin")).distinct().join(lists, [*keys, "_bin"], "left")
    w = Window.partitionBy(*keys).orderBy("_bin")
    low = F.last(F.element_at("_list", -1), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    high = F.first(F.element_at("_list", 1), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    bins = bins.select(*keys, "_bin", F.concat(F.coalesce("_list", F.array().cast("array<bigint>")), F.array(low, high)).alias("_near"))
    out = points.withColumn("_bin", F.floor(F.col("pos") / width)).join(bins, [*keys, "_bin"], "left")
    return out.withColumn("distance", F.array_min(F.transform("_near", lambda x: F.abs(x - F.col("pos"))))).drop("_bin", "_near")
