"""Reports on reads, documents' lengths, events and intervals."""
from __future__ import annotations

from pyspark.sql import functions as F

from strandset.functions import codes
from strandset.operators import reports
from strandset.sources.driver_tables import BED, READS, bed, reads, table, with_

from .registry import query

BINS = """ev AS (SELECT contig, s // 5 AS sb, e // 5 AS eb FROM reads WHERE e // 5 > s // 5), bins AS (SELECT contig, bin, CAST(count(*) AS BIGINT) AS depth FROM (SELECT contig, unnest(range(sb + 1, eb + 1)) AS bin FROM ev) GROUP BY 1, 2)"""
DENSE = "dense AS (SELECT contig, bin, coalesce(depth, 0) AS depth FROM (SELECT contig, unnest(range(0, max(bin) + 1)) AS bin FROM bins GROUP BY contig) LEFT JOIN bins USING (contig, bin))"
RUNS = "SELECT contig, {v}, min(bin) AS a, max(bin) AS z, avg(depth) AS m FROM (SELECT *, sum(st) OVER (PARTITION BY contig ORDER BY bin) AS run FROM (SELECT *, CASE WHEN lag({v}) OVER (PARTITION BY contig ORDER BY bin) = {v} THEN 0 ELSE 1 END AS st FROM (SELECT *, {x} AS {v} FROM dense))) GROUP BY contig, run, {v}"


def _bins(spark, d, dense=False):
    return reports.depth_bins(reads(spark, d), 5, dense)


def _rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query(with_(READS, BINS) + "SELECT contig, bin, depth FROM bins")
def depth_bins(spark, d):
    return _bins(spark, d)


@query(with_(READS, BINS) + "SELECT contig, max(depth) AS max_depth, min(depth) AS min_depth, median(depth) AS median_depth, round(avg(depth), 6) AS mean_depth, round(stddev_pop(depth), 6) AS std_depth, CAST(count(*) AS BIGINT) AS n_bins FROM bins GROUP BY ROLLUP (contig)")
def depth_stats(spark, d):
    return _rounded(reports.depth_stats(_bins(spark, d), "contig"), "mean_depth", "std_depth")


@query(with_(READS, BINS) + "SELECT CASE WHEN depth < 2 THEN 0 ELSE least(15, CAST(floor(log2(depth)) AS INTEGER)) END AS level, CAST(count(*) AS BIGINT) AS n FROM bins WHERE bin >= 10 AND bin < 100 GROUP BY 1")
def depth_histogram(spark, d):
    return reports.in_range(_bins(spark, d), 5, 50, 500).groupBy(reports.log2_bin(F.col("depth")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(with_(READS, BINS, DENSE) + "SELECT contig, a * 5 AS s, (z + 1) * 5 AS e, above, CAST(trunc(m) AS INTEGER) AS depth FROM (" + RUNS.format(v="above", x="depth >= 20") + ")")
def depth_threshold_bed(spark, d):
    return reports.depth_threshold_bed(_bins(spark, d, True), 5, 20)


@query(with_(READS, BINS, DENSE) + "SELECT contig, a * 5 AS s, (z + 1) * 5 AS e, level AS depth FROM (" + RUNS.format(v="level", x="10 * (depth // 10)") + ")")
def depth_increment_bed(spark, d):
    return reports.depth_increment_bed(_bins(spark, d, True), 5, 10)


@query(with_(READS, BINS) + ", c AS (SELECT contig, depth, sum(n) OVER (PARTITION BY contig ORDER BY depth) AS c, sum(n) OVER (PARTITION BY contig) AS t FROM (SELECT contig, depth, count(*) * 5 AS n FROM bins GROUP BY 1, 2)) SELECT contig, (min(CASE WHEN c * 2 >= t THEN depth END) + min(CASE WHEN c * 2 > t THEN depth END)) / 2.0 AS median FROM c GROUP BY 1")
def weighted_median_depth(spark, d):
    return reports.weighted_median(_bins(spark, d).withColumn("bp", F.lit(5).cast("long")), "depth", "bp", "contig")


@query("SELECT lang, max(n_chars) AS n50 FROM (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents) WHERE c >= t // 2 GROUP BY 1")
def n50(spark, d):
    return reports.n50(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", "lang")


@query("""SELECT lang, n, max_len, min_len, mean_len, median_len, std_len, n50 FROM (SELECT lang, CAST(count(*) AS BIGINT) AS n, max(n_chars) AS max_len, min(n_chars) AS min_len, round(avg(n_chars), 6) AS mean_len, median(n_chars) AS median_len, round(stddev_pop(n_chars), 6) AS std_len FROM documents GROUP BY 1)
    JOIN (SELECT lang, max(n_chars) AS n50 FROM (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS c, sum(n_chars) OVER (PARTITION BY lang) AS t FROM documents) WHERE c >= t // 2 GROUP BY 1) USING (lang)""")
def length_summary(spark, d):
    return _rounded(reports.length_summary(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", "lang"), "mean_len", "std_len")


@query("SELECT lang, CAST(floor(log2(n_chars)) AS INTEGER) AS level, CAST(count(*) AS BIGINT) AS n FROM documents WHERE n_chars > 0 GROUP BY 1, 2")
def length_histogram(spark, d):
    return reports.log_histogram(table(spark, d, "documents").select("lang", "n_chars"), "n_chars", 2, "lang")


@query("SELECT bucket, coalesce(n, 0) AS n FROM (SELECT unnest(range(min(n_chars // 500), max(n_chars // 500) + 1)) AS bucket FROM documents) LEFT JOIN (SELECT n_chars // 500 AS bucket, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1) USING (bucket)")
def length_buckets(spark, d):
    return reports.length_buckets(table(spark, d, "documents").select("n_chars"), "n_chars", 500)


@query(with_(READS) + "SELECT contig, CAST(count(*) AS BIGINT) AS n, CAST(sum((flag & 256 <> 0)::INT) AS BIGINT) AS n_secondary, CAST(sum((flag & 1024 <> 0)::INT) AS BIGINT) AS n_supplementary, CAST(sum((flag & 256 = 0 AND flag & 1024 = 0 AND mapq >= 20)::INT) AS BIGINT) AS n_kept, median(mapq) AS median_mapq FROM reads GROUP BY ROLLUP (contig)")
def read_counts(spark, d):
    return reports.read_counts(reads(spark, d), supplementary=1024, min_mapq=20)


@query(with_(BED) + ", x AS (SELECT contig, s, e, unnest(range(s // 100, (e - 1) // 100 + 1)) AS bucket FROM bed WHERE s < e), b AS (SELECT contig, bucket, CAST(sum(least(e, (bucket + 1) * 100) - greatest(s, bucket * 100)) AS BIGINT) AS bp FROM x GROUP BY 1, 2) SELECT contig, bucket, bp, round(bp / 100, 6) AS density, round(bp / 100 - avg(bp) OVER (PARTITION BY contig) / 100, 6) AS over_mean, round(bp / sum(bp) OVER (PARTITION BY contig), 6) AS share FROM b")
def bucket_coverage(spark, d):
    return _rounded(reports.bucket_coverage(bed(spark, d), 100), "density", "over_mean", "share")


ARM = "CASE WHEN (s + e) / 2 >= cen THEN ((s + e) / 2 - cen_e) / (size - cen_e) ELSE (cen_s - (s + e) / 2) / cen_s END"


@query(with_(BED) + f", dim AS (SELECT CAST(n_nationkey % 10 AS VARCHAR) AS d, max(2200 + n_nationkey) AS size FROM nation GROUP BY 1), x AS (SELECT contig, s, e, size, 900.0::DOUBLE AS cen_s, 1100.0::DOUBLE AS cen_e, 1000.0::DOUBLE AS cen FROM bed JOIN dim ON d = right(contig, 1)), r AS (SELECT contig, e - s AS len, {ARM} AS ratio FROM x) SELECT contig, CAST(count(*) AS BIGINT) AS n, round(avg(len), 6) AS mean_len, round(stddev_pop(len), 6) AS std_len, round(avg(ratio), 6) AS mean_ratio, round(avg(CASE WHEN ratio <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS near_share FROM r GROUP BY ROLLUP (contig)")
def arm_ratio_report(spark, d):
    size = table(spark, d, "nation").groupBy(F.expr("cast(n_nationkey % 10 as string)").alias("d")).agg(F.max(F.col("n_nationkey") + 2200).alias("size"))
    x = bed(spark, d).join(F.broadcast(size), F.expr("right(contig, 1) = d"))  # ten rows, by their last digit
    ratio = codes.arm_ratio((F.col("s") + F.col("e")) / 2, F.col("size"), F.lit(900.0), F.lit(1100.0))
    out = x.select("contig", (F.col("e") - F.col("s")).alias("len"), ratio.alias("ratio")).rollup("contig").agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean_len"), F.stddev_pop("len").alias("std_len"), F.avg("ratio").alias("mean_ratio"), F.avg(F.when(F.col("ratio") <= 0.1, 1.0).otherwise(0.0)).alias("near_share"))
    return _rounded(out, "mean_len", "std_len", "mean_ratio", "near_share")


@query("WITH m AS (SELECT label, idx - 1 AS idx, avg(v::DOUBLE) AS mean, stddev_pop(v::DOUBLE) AS std FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS idx FROM embeddings) GROUP BY 1, 2) SELECT label, CAST(idx AS INTEGER) AS idx, round(mean, 5) AS mean, round(std, 5) AS std, round(mean / sum(mean) OVER (PARTITION BY label, idx // 8), 3) AS normed FROM m")
def matrix_mean_std(spark, d):
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return _rounded(reports.matrix_mean_std(e, "embedding", 8, "label"), "mean", "std", digits=5).withColumn("normed", F.round("normed", 3))


@query(with_(BED) + "SELECT cls, bp, round(bp / sum(bp) OVER (), 9) AS share FROM (SELECT left(contig, 1) AS cls, CAST(sum(e - s) AS BIGINT) AS bp FROM bed GROUP BY 1)")
def class_share(spark, d):
    return _rounded(reports.class_share(bed(spark, d).withColumn("cls", F.left("contig", F.lit(1))), "cls"), "share", digits=9)


CALLS = "calls AS (SELECT CAST(user_id % 5 AS INTEGER) AS chrom, CAST(event_id % 7 AS INTEGER) AS mpi, CASE event_id % 4 WHEN 0 THEN 'FP' WHEN 1 THEN 'FN' ELSE 'TP' END AS cls, CAST(floor(value) AS INTEGER) AS qual, CAST(event_id % 40 AS INTEGER) AS depth FROM events)"


def _calls(spark, d):
    return table(spark, d, "events").selectExpr("cast(user_id % 5 as int) as chrom", "cast(event_id % 7 as int) as mpi", "case event_id % 4 when 0 then 'FP' when 1 then 'FN' else 'TP' end as cls", "cast(floor(value) as int) as qual", "cast(event_id % 40 as int) as depth")


MEAN = lambda col, c: f"coalesce(CAST(trunc(avg(CASE WHEN cls = '{c}' THEN {col} END)) AS INTEGER), -1) AS {col}_{c.lower()}"


@query("WITH " + CALLS + ", g AS (SELECT chrom, mpi, CAST(count(*) FILTER (cls = 'TP') AS BIGINT) AS tp, CAST(count(*) FILTER (cls = 'FP') AS BIGINT) AS fp, CAST(count(*) FILTER (cls = 'FN') AS BIGINT) AS fn, " + ", ".join(MEAN(c, k) for c in ("qual", "depth") for k in ("TP", "FP", "FN")) + " FROM calls GROUP BY ROLLUP (chrom, mpi)), r AS (SELECT *, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, tp + fn) AS sensitivity FROM g) SELECT * REPLACE (round(precision, 6) AS precision, round(sensitivity, 6) AS sensitivity), round(CASE WHEN precision + sensitivity = 0 THEN 0 ELSE 2 * precision * sensitivity / (precision + sensitivity) END, 6) AS f FROM r")
def prf_rollup(spark, d):
    return _rounded(reports.scores(_calls(spark, d), "chrom", "mpi"), "precision", "sensitivity", "f")


@query("WITH " + CALLS + ", t(threshold) AS (VALUES (0), (20), (50), (100)) SELECT threshold, CAST(count(*) FILTER (cls = 'TP' AND qual >= threshold) AS BIGINT) AS tp, CAST(count(*) FILTER (cls = 'FP' AND qual >= threshold) AS BIGINT) AS fp, CAST(count(*) FILTER ((cls = 'TP' AND qual < threshold) OR cls = 'FN') AS BIGINT) AS fn FROM calls CROSS JOIN t GROUP BY 1")
def threshold_rescore(spark, d):
    return reports.rescored(_calls(spark, d), [0, 20, 50, 100])


@query("SELECT file, CAST(count(*) AS BIGINT) AS n, round(avg(dp), 6) AS mean_depth FROM (SELECT event_type AS file, CAST(floor(value) AS INTEGER) AS dp FROM events) GROUP BY ROLLUP (file)")
def average_depth(spark, d):
    return _rounded(reports.average_depth(table(spark, d, "events").selectExpr("event_type as file", "cast(floor(value) as int) as dp")), "mean_depth")


BLOCKS = "blocks AS (SELECT CAST(o_custkey % 3 AS INTEGER) AS file, concat('c', CAST(o_orderkey % 4 AS VARCHAR)) AS contig, o_orderkey % 9000 * 10 AS s, o_orderkey % 9000 * 10 + 10 + o_custkey % 4 * 10 AS e FROM orders)"


def _blocks(spark, d):
    return table(spark, d, "orders").selectExpr("cast(o_custkey % 3 as int) as file", "concat('c', cast(o_orderkey % 4 as string)) as contig", "o_orderkey % 9000 * 10 as s", "o_orderkey % 9000 * 10 + 10 + o_custkey % 4 * 10 as e")


@query("WITH " + BLOCKS + " SELECT agreement, CAST(count(*) AS BIGINT) AS blocks, round(avg(e - s), 6) AS mean_len, round(stddev_pop(e - s), 6) AS std_len FROM (SELECT contig, s, e, CAST(count(DISTINCT file) AS BIGINT) AS agreement FROM blocks GROUP BY 1, 2, 3) GROUP BY 1")
def block_agreement(spark, d):
    return _rounded(reports.block_agreement(_blocks(spark, d)), "mean_len", "std_len")


@query("WITH " + BLOCKS + ", one AS (SELECT contig, s, e, min(file) AS file FROM blocks GROUP BY 1, 2, 3 HAVING count(DISTINCT file) = 1), b AS (SELECT DISTINCT * FROM blocks) SELECT one.file, one.contig, one.s, one.e, CAST(count(*) AS BIGINT) AS meets, CAST(count(*) FILTER (one.s <= b.s AND b.e <= one.e) AS BIGINT) AS contains, CAST(count(*) FILTER (b.s <= one.s AND one.e <= b.e) AS BIGINT) AS within, CAST(count(*) FILTER (NOT (one.s <= b.s AND b.e <= one.e) AND NOT (b.s <= one.s AND one.e <= b.e)) AS BIGINT) AS crosses FROM one JOIN b ON one.contig = b.contig AND one.s < b.e AND b.s < one.e AND one.file <> b.file GROUP BY 1, 2, 3, 4")
def block_containment(spark, d):
    return reports.block_containment(_blocks(spark, d), 100)


@query("SELECT prefix, CAST(count(*) AS BIGINT) AS n FROM (SELECT concat('s', user_id % 50, '.', event_type) AS prefix FROM events) GROUP BY 1 HAVING count(*) < 40")
def incomplete_prefixes(spark, d):
    names = table(spark, d, "events").selectExpr("concat('s', user_id % 50, '.', event_type, '.', event_id) as name")
    return reports.incomplete_prefixes(names, 2, 40)


@query("SELECT round(sum(CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END) / sum(CASE WHEN event_id % 4 <> 0 THEN 1 ELSE 0 END), 9) AS sensitivity, round(sum(CASE WHEN event_id % 4 >= 2 THEN 1 ELSE 0 END) / sum(CASE WHEN event_id % 4 <> 1 THEN 1 ELSE 0 END), 9) AS precision, CAST(NULL AS DOUBLE) AS switch_rate FROM events")
def log_totals(spark, d):
    e = table(spark, d, "events").selectExpr("int(event_id % 4 >= 2) as tp", "int(event_id % 4 <> 0) as pos", "int(event_id % 4 <> 1) as called", "0 as zero")
    return _rounded(reports.log_totals(e, [("sensitivity", "tp", "pos"), ("precision", "tp", "called"), ("switch_rate", "zero", "zero")]), "sensitivity", "precision", digits=9)


@query("SELECT round(avg(value), 6) AS mean_value, round(stddev_pop(value), 6) AS std_value FROM events")
def summary_mean_std(spark, d):
    return _rounded(reports.summary_mean_std(table(spark, d, "events"), "value"), "mean_value", "std_value")


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS genes, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS ids FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def gene_lookup(spark, d):
    """Ids looked up in a dimension of fixed size (25 nations), and counted by its class."""
    return table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.expr("s_nationkey = n_nationkey")).groupBy(F.col("n_regionkey").alias("region")).agg(F.count(F.lit(1)).alias("genes"), F.countDistinct("n_nationkey").alias("ids"))


@query("SELECT CAST(floor(value / 10) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n, repeat('#', CAST(least(40, count(*) // 10) AS INTEGER)) AS bar FROM events GROUP BY 1")
def quality_histogram(spark, d):
    by = table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("bar", F.expr("repeat('#', cast(least(40, n div 10) as int))"))


@query("SELECT o_orderstatus AS status, round(sum(CASE WHEN o_custkey % 3 >= 1 THEN (o_orderkey % 100) / 100.0::DOUBLE ELSE 0 END), 4) AS share FROM orders GROUP BY 1")
def covered_total(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderstatus as status", "o_custkey % 3 as depth", "cast((o_orderkey % 100) / 100.0 as double) as fraction")
    return _rounded(reports.covered_total(o, "status"), "share", digits=4)


@query(with_(READS, BED) + "SELECT contig, CAST(sum(greatest(0, least(e, z) - greatest(s, a))) AS BIGINT) AS bp FROM bed JOIN (SELECT contig, min(s) AS a, max(s) AS z FROM reads GROUP BY 1) USING (contig) GROUP BY ROLLUP (contig)")
def within_call_range(spark, d):
    """Bases of the intervals between a contig's first and last call (starts of reads stand for calls)."""
    return reports.within_call_range(bed(spark, d), reads(spark, d).select("contig", F.col("s").alias("pos")))
