"""Calls against a truth set: classes, switch errors and accuracy; and the merge of two call sets."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """Full outer join on (contig, pos); calls before the first or after the last truth record of a contig are left out.

    Both sides have contig, pos, a1, a2 (allele indices; negative: unknown), type (SNV, INS or
    DEL); calls have phased too. Columns: contig, pos, t1, t2, t_type, e1, e2, e_type, phased.
    """
    span = truth.groupBy("contig").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    mine = calls.join(span, "contig").where("pos between _lo and _hi").select("contig", "pos", F.col("a1").alias("e1"), F.col("a2").alias("e2"), F.col("type").alias("e_type"), "phased")
    return truth.select("contig", "pos", F.col("a1").alias("t1"), F.col("a2").alias("t2"), F.col("type").alias("t_type")).join(mine, ["contig", "pos"], "full_outer")


def classified(rows: DataFrame) -> DataFrame:
    """aligned rows with block, outcome (TP, FP, FN, FPFN), zygosity, uncertain, switch and consistent.

    An unphased call starts a new block. The first truth-heterozygous row of a block can't be in or
    out of phase: it is uncertain, true if its alleles match in either order, else false only. Of
    the later ones a row that matches in the order of the last match is consistent, in the other
    order a switch error; both are true. Others are false and missed. The order of a block's seed is
    its own, so a block whose haplotypes are exchanged as a whole has no switch error.
    """
    have_t, have_e = F.col("t1").isNotNull(), F.col("e1").isNotNull()
    known = have_e & (F.col("e1") >= 0) & (F.col("e2") >= 0)
    t_hom, e_hom = F.col("t1") == F.col("t2"), F.col("e1") == F.col("e2")
    straight, crossed = (F.col("t1") == F.col("e1")) & (F.col("t2") == F.col("e2")), (F.col("t1") == F.col("e2")) & (F.col("t2") == F.col("e1"))
    by_pos = Window.partitionBy("contig").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("block", F.sum(F.when(have_e & ~F.col("phased"), 1).otherwise(0)).over(by_pos))
    het = have_t & known & ~t_hom
    rows = rows.withColumn("_het", F.coalesce(het, F.lit(False))).withColumn("_o", F.when(het & straight, 1).when(het & crossed, -1))
    w = Window.partitionBy("contig", "block").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_first", F.col("_het") & (F.coalesce(F.sum(F.col("_het").cast("int")).over(before), F.lit(0)) == 0)).withColumn("_last", F.last("_o", ignorenulls=True).over(before))
    outcome = (
        F.when(~have_t, "FP").when(~have_e | ~known, "FN").when(t_hom, F.when(e_hom & straight, "TP").otherwise("FPFN"))
        .when(F.col("_o").isNotNull(), "TP").when(F.col("_first"), "FP").otherwise("FPFN")
    )
    later = F.col("_o").isNotNull() & ~F.col("_first")
    flipped = later & F.coalesce(F.col("_o") != F.col("_last"), F.lit(False))
    out = rows.withColumns({"outcome": outcome, "zygosity": F.when(F.coalesce(t_hom, e_hom), "hom").otherwise("het"), "type": F.coalesce("t_type", "e_type"), "uncertain": F.col("_first"), "switch": flipped, "consistent": later & ~flipped})
    return out.drop("_het", "_o", "_first", "_last")


def switches(rows: DataFrame) -> DataFrame:
    """contig, switches, distance: switch errors, and consistent rows before each, the last run of a block left out."""
    after = Window.partitionBy("contig", "block").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    counted = rows.withColumn("_more", F.max(F.col("switch").cast("int")).over(after) == 1)
    return counted.groupBy("contig").agg(F.count_if("switch").alias("switches"), F.count_if(F.col("consistent") & F.coalesce(F.col("_more"), F.lit(False))).alias("distance"))


def accuracy(rows: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each contig: counts, sensitivity, specificity, precision, switch rate and mean distance; null over 0."""
    is_ = lambda *k: F.col("outcome").isin(*k)
    snv, het = F.col("type") == "SNV", F.col("zygosity") == "het"
    n = lambda on, name: F.count_if(on).alias(name)
    g = rows.groupBy("contig").agg(n(is_("TP"), "tp"), n(is_("FP", "FPFN"), "fp"), n(is_("FN", "FPFN"), "fn"), n(is_("TP") & snv, "tp_snv"), n(is_("FN", "FPFN") & snv, "fn_snv"), n(is_("TP") & het, "tp_het"), n(is_("FN", "FPFN") & het, "fn_het"), n(F.col("uncertain"), "uncertain"))
    span = truth.groupBy("contig").agg((F.max("pos") - F.min("pos") - F.count(F.lit(1))).alias("negatives"))
    g = g.join(span, "contig").join(switches(rows), "contig").withColumn("tn", F.col("negatives") - F.col("fp"))
    over = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    return g.withColumns({
        "sensitivity": over(c("tp"), c("tp") + c("fn")), "sensitivity_snv": over(c("tp_snv"), c("tp_snv") + c("fn_snv")), "sensitivity_het": over(c("tp_het"), c("tp_het") + c("fn_het")), "specificity": over(c("tn"), c("negatives")),
        "precision": over(c("tp"), c("tp") + c("fp")), "switch_rate": over(c("switches"), c("tp_het") - c("uncertain")), "switch_distance": over(c("distance"), c("switches")),
    })


def detail(rows: DataFrame, verbosity: int) -> DataFrame:
    """Rows that a bit mask asks for: 1 true, 2 false, 4 missed."""
    keep = F.lit(False)
    for bit, kinds in ((1, ["TP"]), (2, ["FP", "FPFN"]), (4, ["FN", "FPFN"])):
        if verbosity & bit:
            keep = keep | F.col("outcome").isin(*kinds)
    return rows.where(keep)


def _same_filter(a: Column, b: Column) -> Column:
    plain = lambda x: F.when(x == ".", "PASS").otherwise(x)
    return plain(a) == plain(b)


def merge_calls(first: DataFrame, second: DataFrame, tags: tuple[str, str] = ("1", "2")) -> DataFrame:
    """Full outer merge of call sets (contig, pos, ref, alt, qual, filter, gt, info).

    source is first, second, both or conflict. Two records of a place are one if the references
    and the filters (PASS and . alike) are equal and the alternatives are the same set; the merged
    record has the lower quality, the first one's alternatives, and the second one's genotype with
    its two ends exchanged if its alternatives are in another order. Names in info get the tags.
    """
    a = first.select("contig", "pos", *(F.col(c).alias(f"{c}_1") for c in ("ref", "alt", "qual", "filter", "gt", "info")))
    b = second.select("contig", "pos", *(F.col(c).alias(f"{c}_2") for c in ("ref", "alt", "qual", "filter", "gt", "info")))
    j = a.join(b, ["contig", "pos"], "full_outer")
    alts = lambda c: F.array_sort(F.split(c, ","))
    same = (F.col("ref_1") == F.col("ref_2")) & (alts(F.col("alt_1")) == alts(F.col("alt_2"))) & _same_filter(F.col("filter_1"), F.col("filter_2"))
    source = F.when(F.col("ref_2").isNull(), "first").when(F.col("ref_1").isNull(), "second").when(same, "both").otherwise("conflict")
    tagged = lambda n, t: F.transform(F.split(F.col(f"info_{n}"), ";"), lambda x: F.concat(F.lit(f"{t}_"), x))
    info = F.array_join(F.concat(F.coalesce(tagged(1, tags[0]), F.array().cast("array<string>")), F.coalesce(tagged(2, tags[1]), F.array().cast("array<string>"))), ";")
    gt2 = F.when((F.col("alt_1") != F.col("alt_2")) & F.col("alt_1").isNotNull(), F.reverse("gt_2")).otherwise(F.col("gt_2"))
    return j.select("contig", "pos", source.alias("source"), F.coalesce("ref_1", "ref_2").alias("ref"), F.coalesce("alt_1", "alt_2").alias("alt"), F.least("qual_1", "qual_2").alias("qual"), F.coalesce("filter_1", "filter_2").alias("filter"), "gt_1", gt2.alias("gt_2"), info.alias("info"))
