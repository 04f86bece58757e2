"""Extensions: pileup and depth over growing input, as Structured Streaming aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.operators.pileup import site_counts


def base_counts(obs: DataFrame) -> DataFrame:
    """Weights by site of a stream of observations; state is a row for each site (update or complete mode)."""
    return site_counts(obs)


def depth_events(reads: DataFrame, spacing: int) -> DataFrame:
    """contig, bin, d: starts less ends by bin of a stream of reads; running sums of d over bins are depths."""
    r = reads.select("contig", F.floor(F.col("s") / spacing).alias("sb"), F.floor(F.col("e") / spacing).alias("eb")).where("eb > sb")
    ev = r.select("contig", F.explode(F.array(F.struct((F.col("sb") + 1).alias("bin"), F.lit(1).alias("d")), F.struct((F.col("eb") + 1).alias("bin"), F.lit(-1).alias("d")))).alias("x")).select("contig", "x.*")
    return ev.groupBy("contig", "bin").agg(F.sum("d").alias("d"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with pauses below `gap`; events later than `late` are dropped by the watermark."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
