"""Interval algebra on reads (lineitem) and sparse intervals (orders)."""
from __future__ import annotations

from pyspark.sql import functions as F

from strandset.operators import intervals as iv
from strandset.sources.driver_tables import BED, READS, bed, reads, with_

from .registry import query

RB = with_(READS, BED)


def islands_sql(name: str, src: str, keys: str = "contig", touching: bool = False) -> str:
    op = ">" if touching else ">="
    return f"""{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(nw) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT *, CASE WHEN reach IS NULL OR s {op} reach THEN 1 ELSE 0 END AS nw FROM (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src} WHERE s < e))) GROUP BY {keys}, run)"""


@query(RB + "SELECT contig, read_id, name, greatest(r.s, b.s) AS lo, least(r.e, b.e) AS hi FROM reads r JOIN bed b USING (contig) WHERE r.s < b.e AND b.s < r.e")
def overlap_pairs(spark, d):
    j = iv.range_join(reads(spark, d).select("contig", "read_id", "s", "e"), bed(spark, d), 100)
    return j.select("contig", "read_id", F.col("r_name").alias("name"), F.greatest("s", "r_s").alias("lo"), F.least("e", "r_e").alias("hi"))


POINTS = "pts AS (SELECT contig, read_id, s AS pos FROM reads)"


def points(spark, d):
    return reads(spark, d).select("contig", "read_id", F.col("s").alias("pos"))


@query(with_(READS, BED, POINTS) + "SELECT contig, read_id, pos FROM pts p WHERE EXISTS (SELECT 1 FROM bed b WHERE b.contig = p.contig AND pos >= b.s AND pos < b.e)")
def point_in_bed(spark, d):
    return iv.contained_points(points(spark, d), bed(spark, d), True, 100)


@query(with_(READS, BED, POINTS) + "SELECT contig, read_id, pos FROM pts p WHERE NOT EXISTS (SELECT 1 FROM bed b WHERE b.contig = p.contig AND pos >= b.s AND pos < b.e)")
def bed_exclusion(spark, d):
    return iv.contained_points(points(spark, d), bed(spark, d), False, 100)


SPANS = "spans AS (SELECT contig, min(s) AS lo, max(e) AS hi FROM reads GROUP BY 1)"


@query(with_(READS, BED, SPANS, islands_sql("runs", "bed", touching=True)) + """, g AS (SELECT contig, coalesce(lag(e) OVER (PARTITION BY contig ORDER BY s), lo) AS s, s AS e, lo, hi FROM runs JOIN spans USING (contig)
    UNION ALL SELECT contig, max(e) AS s, any_value(hi) AS e, any_value(lo) AS lo, any_value(hi) AS hi FROM runs JOIN spans USING (contig) GROUP BY contig
    UNION ALL SELECT contig, lo, hi, lo, hi FROM spans WHERE contig NOT IN (SELECT contig FROM runs))
    SELECT contig, greatest(s, lo) AS s, least(e, hi) AS e FROM g WHERE greatest(s, lo) < least(e, hi)""")
def bed_complement(spark, d):
    r = reads(spark, d)
    return iv.complement(bed(spark, d), r.groupBy("contig").agg(F.min("s").alias("s"), F.max("e").alias("e")))


@query(with_(READS, islands_sql("i", "reads")) + "SELECT contig, s, e, n FROM i")
def overlap_islands(spark, d):
    return iv.islands(reads(spark, d))


@query(RB[:-1] + ",\n" + islands_sql("i", "bed", touching=True) + " SELECT contig, s, e, n FROM i")
def bed_merge_touching(spark, d):
    return iv.islands(bed(spark, d), touching=True)


@query(RB[:-1] + ",\n" + islands_sql("i", "bed", touching=True) + " SELECT contig, CAST(sum(e - s) AS BIGINT) AS bp, CAST(count(*) AS BIGINT) AS runs FROM i GROUP BY 1")
def bed_coverage(spark, d):
    return iv.coverage(bed(spark, d))


SETS = "sets AS (SELECT concat('c', CAST(l_suppkey % 10 AS VARCHAR)) AS contig, CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS k, l_partkey * 3 AS s, l_partkey * 3 + 1 + CAST(l_quantity AS BIGINT) % 7 AS e FROM lineitem WHERE l_linestatus = 'F' OR l_orderkey % 3 = 0)"


def _sets(spark, d):
    from strandset.sources.driver_tables import table

    t = table(spark, d, "lineitem").where("l_linestatus = 'F' or l_orderkey % 3 = 0")
    return t.selectExpr("concat('c', cast(l_suppkey % 10 as string)) as contig", "case when l_returnflag = 'A' then 0 when l_returnflag = 'N' then 1 else 2 end as k", "l_partkey * 3 as s", "l_partkey * 3 + 1 + cast(l_quantity as bigint) % 7 as e")


MEMBER = """ev AS (SELECT contig, s AS pos, CAST(1 AS BIGINT) << k AS d FROM i UNION ALL SELECT contig, e, -(CAST(1 AS BIGINT) << k) FROM i), atp AS (SELECT contig, pos, sum(d) AS d FROM ev GROUP BY 1, 2),
    mb AS (SELECT contig, pos AS s, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS e, CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS bitmap FROM atp)"""


@query(with_(SETS, islands_sql("i", "sets", "contig, k", True), MEMBER) + "SELECT * FROM mb WHERE e IS NOT NULL AND bitmap <> 0")
def bed_membership_bitmap(spark, d):
    return iv.membership(_sets(spark, d), "k")


@query(with_(SETS, islands_sql("i", "sets", "contig, k", True), MEMBER) + "SELECT mask, CAST(sum(e - s) AS BIGINT) AS bp FROM mb JOIN (SELECT CAST(unnest(range(1, 8)) AS BIGINT) AS mask) ON bitmap & mask = mask WHERE e IS NOT NULL AND bitmap <> 0 GROUP BY 1")
def subset_coverage(spark, d):
    return iv.subset_coverage(iv.membership(_sets(spark, d), "k"), 3)


FEAT = "feat AS (SELECT *, CAST(s % 3 AS BIGINT) AS cls FROM bed)"


@query(with_(READS, BED, FEAT, "setz AS (SELECT contig, s, e, flag // 256 AS k FROM reads)", islands_sql("a", "setz", "contig, k", True), islands_sql("b", "feat", "contig, cls", True)) + """
    SELECT k, cls, bp, feature_bp, round(bp / feature_bp, 9) AS share FROM (SELECT k, cls, CAST(sum(least(a.e, b.e) - greatest(a.s, b.s)) AS BIGINT) AS bp FROM a JOIN b ON a.contig = b.contig AND a.s < b.e AND b.s < a.e GROUP BY 1, 2)
    JOIN (SELECT cls, CAST(sum(e - s) AS BIGINT) AS feature_bp FROM b GROUP BY 1) USING (cls)""")
def feature_overlap(spark, d):
    sets = reads(spark, d).selectExpr("contig", "s", "e", "flag div 256 as k")
    out = iv.feature_overlap(sets, bed(spark, d).withColumn("cls", F.expr("s % 3")), "k", "cls", 200)
    return out.withColumn("share", F.round("share", 9))


DEPTH = """ev AS (SELECT contig, s AS pos, 1 AS d FROM reads WHERE s < e UNION ALL SELECT contig, e, -1 FROM reads WHERE s < e), atp AS (SELECT contig, pos, sum(d) AS d FROM ev GROUP BY 1, 2),
    seg AS (SELECT contig, pos AS s, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS e, CAST(sum(d) OVER (PARTITION BY contig ORDER BY pos) AS BIGINT) AS depth FROM atp)"""


@query(with_(READS, DEPTH) + "SELECT * FROM seg WHERE e IS NOT NULL AND depth > 0")
def columns_segments(spark, d):
    return iv.segments(reads(spark, d))


@query(with_(READS, DEPTH) + "SELECT seg.contig, seg.s, seg.e, string_agg(read_id, '|' ORDER BY read_id) AS read_ids, CAST(count(*) AS INTEGER) AS depth FROM seg JOIN reads ON reads.contig = seg.contig AND reads.s < seg.e AND seg.s < reads.e WHERE seg.e IS NOT NULL AND depth > 0 GROUP BY 1, 2, 3")
def column_read_sets(spark, d):
    return iv.columns(reads(spark, d)).withColumn("read_ids", F.array_join("read_ids", "|"))


@query(with_(READS, DEPTH, islands_sql("i", "reads")) + "SELECT i.contig, i.s AS island, CAST(any_value(i.n) AS BIGINT) AS n_reads, CAST(max(depth) AS BIGINT) AS n_colours, CAST(0 AS BIGINT) AS overlaps FROM i JOIN seg ON seg.contig = i.contig AND seg.s >= i.s AND seg.e <= i.e WHERE seg.e IS NOT NULL AND depth > 0 GROUP BY 1, 2")
def tiling_colours(spark, d):
    """Colours by island; there are as many as the largest depth, and no two intervals of one colour overlap."""
    from pyspark.sql import Window

    c = iv.colours(reads(spark, d))
    c = c.withColumn("bad", (F.lag("e").over(Window.partitionBy("contig", "island", "colour").orderBy("s", "e")) > F.col("s")).cast("int"))
    return c.groupBy("contig", "island").agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("colour").alias("n_colours"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("overlaps"))


def coverage_cap(spark, d):
    return iv.coverage_cap(iv.colours(reads(spark, d)), 4).select("contig", "island", "read_id", "colour")


query()(coverage_cap)


@query(with_(READS, BED) + ", b AS (SELECT contig, s AS pos FROM bed UNION SELECT contig, e FROM bed) SELECT r.contig, read_id, r.s AS pos, min(abs(b.pos - r.s)) AS distance FROM (SELECT * FROM reads) r LEFT JOIN b ON b.contig = r.contig GROUP BY 1, 2, 3")
def nearest_boundary(spark, d):
    b = bed(spark, d)
    edges = b.select("contig", F.col("s").alias("pos")).union(b.select("contig", F.col("e").alias("pos")))
    return iv.nearest_boundary(reads(spark, d).select("contig", "read_id", F.col("s").alias("pos")), edges, width=100)


@query(with_(READS) + " SELECT a.contig, a.read_id AS read_a, b.read_id AS read_b, least(a.e, b.e) - greatest(a.s, b.s) AS shared FROM reads a JOIN reads b ON a.contig = b.contig AND a.s < b.e AND b.s < a.e AND a.read_id < b.read_id WHERE least(a.e, b.e) - greatest(a.s, b.s) >= 3")
def shared_reads(spark, d):
    f = reads(spark, d).select("contig", "read_id", "s", "e")
    j = iv.range_join(f, f, 100).where("read_id < r_read_id")
    return j.select("contig", F.col("read_id").alias("read_a"), F.col("r_read_id").alias("read_b"), (F.least("e", "r_e") - F.greatest("s", "r_s")).alias("shared")).where("shared >= 3")
