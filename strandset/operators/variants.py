"""Variant rows, phase sets, read tags and the splitting of weakly linked fragments."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandset.functions.codes import GAP, N_SYMBOLS, base_char, phred_quality, variant_class
from strandset.functions.tags import encode
from strandset.sources.shared import settled

from .emission import WEIGHTS
from .genotype import likelihoods
from .intervals import range_join, running


def _genotype(ref: Column, one: Column, two: Column) -> tuple[Column, Column]:
    """Alternatives and genotype of two allele strings against the reference; null where both equal it."""
    alt = F.when(one == two, one).when(one == ref, two).when(two == ref, one).otherwise(F.concat_ws(",", one, two))
    gt = F.when((one == ref) & (two == ref), F.lit(None)).when(one == two, "1|1").when(one == ref, "0|1").when(two == ref, "1|0").otherwise("1|2")
    return alt, gt


def _genotype_values(gt: Column, at: Column) -> Column:
    """Values of at.gl for the genotypes of a row's alleles: one for the reference, two more with an alternative, three more with two."""
    value = lambda a, b: F.element_at(at["gl"], (a * N_SYMBOLS + b + 1).cast("int"))
    ref, one = at["ref_ch"], F.when(gt == "0|1", at["h2"]).otherwise(at["h1"])
    first = [value(ref, ref), value(ref, one), value(one, one)]
    two = at["h2"]
    return F.when(gt == "0|0", F.array(first[0])).when(gt == "1|2", F.array(*first, value(ref, two), value(one, two), value(two, two))).otherwise(F.array(*first))


def variant_rows(calls: DataFrame, hom_ref: bool = False, scored: bool = False) -> DataFrame:
    """contig, frag, pos, ref, alt, gt, dp, ac, kind from calls (contig, frag, pos, ref_ch, h1, h2, depth1, depth2).

    Positions where either haplotype has a gap, with the position before them as the anchor, make
    one indel row: alleles are the symbols without gaps, `*` if none is left. Other positions that
    differ from the reference make a row each; those that don't, only if hom_ref. ac is the depth
    of the haplotypes that carry each alternative.

    Calls with gt_p give rows with qual, of the row's first position; calls with gl (25 values by
    ordered pair of symbols) give rows with gl, the values of the genotypes of the reference and the
    alternatives in the usual order (00, 01, 11, 02, 12, 22), for an indel at its first gap. With
    scored, gl is computed from the calls' weights (a0..a4, b0..b4), for the rows' positions only.
    """
    has_p, has_gl = "gt_p" in calls.columns, scored or "gl" in calls.columns
    symbols = F.struct("ref_ch", "h1", "h2", *(WEIGHTS if scored else ["gl"] if has_gl else []))
    w = Window.partitionBy("contig", "frag").orderBy("pos")
    gap = (F.col("h1") == GAP) | (F.col("h2") == GAP)
    c = calls.withColumn("_gap", gap)
    follows = F.coalesce((F.lead("pos").over(w) == F.col("pos") + 1) & F.lead("_gap").over(w), F.lit(False))
    c = c.withColumn("_in", F.col("_gap") | follows)
    fresh = F.col("_in") & (~F.col("_gap") | ~F.coalesce((F.lag("pos").over(w) == F.col("pos") - 1) & F.lag("_in").over(w), F.lit(False)))
    c = c.withColumn("_run", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = lambda x: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("pos", F.col(x).alias("ch")))), lambda s: s["ch"] != GAP), lambda s: base_char(s["ch"])), "")
    some = lambda x: F.when(x == "", "*").otherwise(x)
    runs = c.where("_in").groupBy("contig", "frag", "_run").agg(F.min("pos").alias("pos"), *(some(text(x)).alias(n) for x, n in (("ref_ch", "ref"), ("h1", "one"), ("h2", "two"))), F.min("depth1").alias("depth1"), F.min("depth2").alias("depth2"), *([F.min_by("gt_p", "pos").alias("gt_p")] if has_p else []), *([F.min_by(symbols, F.when(F.col("_gap"), F.col("pos"))).alias("_at")] if has_gl else [])).drop("_run")
    single = c.where("not _in").select("contig", "frag", "pos", *(base_char(F.col(x)).alias(n) for x, n in (("ref_ch", "ref"), ("h1", "one"), ("h2", "two"))), "depth1", "depth2", *(["gt_p"] if has_p else []), *([symbols.alias("_at")] if has_gl else []))
    every = runs.unionByName(single)
    alt, gt = _genotype(F.col("ref"), F.col("one"), F.col("two"))
    out = every.withColumn("gt", gt)
    out = out.withColumn("gt", F.coalesce("gt", F.lit("0|0"))) if hom_ref else out.where("gt is not null")
    if scored:
        out = likelihoods(out.select("*", F.col("_at.ref_ch").alias("ref_ch"), *(F.col(f"_at.{w}").alias(w) for w in WEIGHTS))).withColumn("_at", F.struct("ref_ch", "_at.h1", "_at.h2", "gl"))
    ac = F.when(F.col("gt") == "0|1", F.col("depth2").cast("string")).when(F.col("gt") == "1|0", F.col("depth1").cast("string")).when(F.col("gt") == "1|1", (F.col("depth1") + F.col("depth2")).cast("string")).when(F.col("gt") == "1|2", F.concat_ws(",", F.col("depth1").cast("string"), F.col("depth2").cast("string"))).otherwise("0")
    alt = F.when(F.col("gt") == "0|0", ".").otherwise(alt)
    scores = ([phred_quality(F.col("gt_p")).alias("qual")] if has_p else []) + ([_genotype_values(F.col("gt"), F.col("_at")).alias("gl")] if has_gl else [])
    return out.select("contig", "frag", "pos", "ref", alt.alias("alt"), "gt", (F.col("depth1") + F.col("depth2")).alias("dp"), ac.alias("ac"), *scores).withColumn("kind", F.when(F.col("gt") == "0|0", "REF").otherwise(variant_class(F.col("ref"), F.col("alt"))))


def phased(rows: DataFrame) -> DataFrame:
    """rows with ps, the position of the fragment's first row, whose own genotype is unphased."""
    w = Window.partitionBy("contig", "frag").orderBy("pos")
    first = F.first("pos").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("ps", first).withColumn("gt", F.when(F.col("pos") == F.col("ps"), F.replace("gt", F.lit("|"), F.lit("/"))).otherwise(F.col("gt")))


def read_tags(reads: DataFrame, frags: DataFrame, width: int = 1000) -> DataFrame:
    """contig, read_id, tags, text: for each fragment (contig, s, e) of a read (with hap 1 or 2): block, offset, length.

    A read that no fragment meets has no tags and the unphased text.
    """
    j = range_join(reads.select("contig", "read_id", "s", "e", "hap"), frags.select("contig", "s", "e"), width)
    one = F.struct(F.col("hap").cast("long").alias("h"), (F.col("r_s") - 1).alias("p"), F.greatest(F.lit(0).cast("long"), F.col("r_s") - F.col("s")).alias("r"), (F.least("e", "r_e") - F.greatest("s", "r_s")).alias("l"))
    by = j.groupBy("contig", "read_id").agg(F.array_sort(F.collect_set(one)).alias("tags"))
    by = by.withColumn("tags", F.array_sort("tags", lambda a, b: F.when(a["p"] < b["p"], -1).when(a["p"] > b["p"], 1).otherwise(0)))
    return reads.select("contig", "read_id").join(by, ["contig", "read_id"], "left").withColumn("text", encode(F.col("tags")))


def routed(reads: DataFrame) -> DataFrame:
    """reads with hap_file, the haplotype of their last tag; 0 without one."""
    return reads.withColumn("hap_file", F.coalesce(F.when(F.size("tags") > 0, F.element_at("tags", -1)["h"]), F.lit(0)))


def linked_fragments(hets: DataFrame, reads: DataFrame, least: int, width: int = 1000) -> DataFrame:
    """contig, pos, next, support, split, frag: neighbouring heterozygous sites and the reads that cover both.

    Where support is below `least`, a new fragment begins at `split`, the middle between the sites.
    The sites, and the pairs with their support, are settled, as several steps read them.
    """
    hets = settled(hets.select("contig", "pos"))
    pairs = running(hets.select("contig", "pos", F.lit(0).alias("d")), ["contig"]).select("contig", "pos", "next")
    spans = pairs.where("next is not null").select("contig", F.col("pos").alias("s"), (F.col("next") + 1).alias("e"))
    hit = range_join(spans, reads.select("contig", "s", "e"), width).where("r_s <= s and r_e >= e")
    support = hit.groupBy("contig", F.col("s").alias("pos")).agg(F.count(F.lit(1)).alias("support"))
    out = pairs.join(support, ["contig", "pos"], "left").withColumn("support", F.when(F.col("next").isNotNull(), F.coalesce("support", F.lit(0))))
    weak = F.coalesce(F.col("support") < least, F.lit(False))
    out = settled(out.withColumn("split", F.when(weak, F.expr("pos + (next - pos + 1) div 2"))))
    before = running(out.select("contig", "pos", weak.cast("int").alias("d")), ["contig"])
    return out.join(before.select("contig", "pos", (F.col("total") - F.col("d")).alias("frag")), ["contig", "pos"])
