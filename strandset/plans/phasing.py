"""From alignments, a reference and parameters to variants and tagged reads: the whole analysis as one plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions.codes import base_code
from strandset.operators import align, emission, genotype, hmm, intervals, pileup, variants
from strandset.sources import formats, sinks
from strandset.sources.formats import Params
from strandset.sources.shared import settled

CHUNK = 10_000  # reference positions in a row
PHASED, MARGIN = 50_000, 5_000  # positions phased in one task, and what it sees of its neighbours


@dataclass
class Result:
    reads: DataFrame  # contig, read_id, s, e, hap
    calls: DataFrame  # contig, frag, pos, ref_ch, h1, h2, gt, gt_p, gl, depths
    fragments: DataFrame  # contig, frag, s, e
    variants: DataFrame  # rows with ps
    tags: DataFrame  # read_id, tags, text
    error: list  # read error matrix used


def with_reference(sites: DataFrame, fasta: DataFrame) -> DataFrame:
    """sites (contig, pos from 1) with ref_ch: sequences are cut into rows of CHUNK positions, so no task holds a contig's sites."""
    cut = fasta.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / CHUNK).cast("int"))).alias("_bin")).where("length(seq) > 0")
    cut = cut.select("contig", F.col("_bin").cast("long").alias("_bin"), F.substring(F.col("seq"), F.col("_bin") * CHUNK + 1, F.lit(CHUNK)).alias("_seq"))
    j = sites.withColumn("_bin", F.floor((F.col("pos") - 1) / CHUNK)).join(cut, ["contig", "_bin"], "left")
    return j.withColumn("ref_ch", base_code(F.substring(F.col("_seq"), (F.pmod(F.col("pos") - 1, F.lit(CHUNK)) + 1).cast("int"), F.lit(1)))).drop("_bin", "_seq")


def phase(alignments: DataFrame, fasta: DataFrame, params: Params, posteriors: DataFrame | None = None, size: int = PHASED, margin: int = MARGIN) -> Result:
    """Genotype and phase alignments (contig, read_id, flag, pos, mapq, cigar, seq).

    Islands much longer than `size` are phased in chunks that see `margin` positions of their neighbours, and stitched.
    """
    het = Params.matrix(params.haplotypeSubstitutionModel) if params.haplotypeSubstitutionModel else pileup.HET
    error = Params.matrix(params.readErrorModel) if params.readErrorModel else pileup.READ_ERROR
    ops = align.cigar_ops(F.col("cigar"))
    kept = align.admitted(alignments, min_length=1, flag_mask=params.filterAReadWithAnyOneOfTheseSamFlagsSet, min_mapq=params.mapqFilter, length=F.length("seq"), cigar=F.col("cigar"))
    reads = kept.select("contig", "read_id", F.col("pos").alias("s"), (F.col("pos") + align.reference_length(ops)).alias("e")).where("s < e")
    obs = align.expand(kept, params.gapCharactersForDeletions)
    if posteriors is not None:
        obs = formats.with_posteriors(obs, posteriors)
    counts = pileup.site_counts(obs)
    if params.filterBadReads:
        good = pileup.read_consensus(obs, counts, reads, params.filterMatchThreshold).where("kept").select("read_id")
        reads, obs = (x.join(good, "read_id", "left_semi") for x in (reads, obs))
    counts = settled(counts)
    coloured = settled(intervals.coverage_cap(intervals.colours(reads), params.maxCoverageDepth).select("contig", "read_id", "island"))
    reads = settled(reads.join(coloured, ["contig", "read_id"]))
    sites = with_reference(counts.select("contig", "pos"), fasta)
    if not params.useReferencePrior:
        sites = sites.withColumn("prior_ch", F.lit(None).cast("int"))
    else:
        sites = sites.withColumn("prior_ch", F.col("ref_ch"))
    obs = settled(obs.join(coloured, ["contig", "read_id"]).join(sites, ["contig", "pos"]))
    if params.estimateReadErrorProbsEmpirically:
        rows = pileup.error_model(obs.select("ref_ch", "ch", "w").where("ref_ch is not null"), params.offDiagonalReadErrorPseudoCount).collect()  # 25 rows
        error = [[next(r.p for r in rows if r.ref_ch == i and r.ch == j) for j in range(5)] for i in range(5)]
    model = obs.withColumn("ref_ch", F.col("prior_ch"))
    if params.filterLikelyHomozygousSites:
        hets = pileup.heterozygous(counts, params.minSecondMostFrequentBaseFilter, params.minSecondMostFrequentBaseLogProbFilter, error).where("included").select("contig", "pos")
        model = model.join(hets, ["contig", "pos"], "left_semi")
    spans = settled(reads.groupBy("contig", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")))
    phased = lambda obs, beam, het, error, *least: hmm.phase_chunks(obs, spans, size, margin, beam, het, error, *least)
    if params.trainingIterations:
        error = hmm.train(model, params.trainingIterations, params.maxPartitionsInAColumn, params.offDiagonalReadErrorPseudoCount, error, het, phased)
    hap = phased(model, params.maxPartitionsInAColumn, het, error, params.minPartitionsInAColumn, params.minPosteriorProbabilityForPartition)
    hap = settled(hap.select("contig", "read_id", (F.col("haplotype") == 1).alias("first")))
    bare = obs.drop("ref_ch").withColumnRenamed("prior_ch", "ref_ch")
    called = lambda mine: genotype.calls(emission.both_haplotypes(mine, F.col("first"), "contig", "island", "pos", "ref_ch"), het, error)
    if params.roundsOfIterativeRefinement:
        better = genotype.refine(bare, called, hap.select("read_id", "first"), params.roundsOfIterativeRefinement, settled)
        hap = reads.select("contig", "read_id").join(better, "read_id")
    calls = genotype.likelihoods(called(bare.join(hap, ["contig", "read_id"])), het, error)
    calls = settled(calls.drop("ref_ch").join(sites.select("contig", "pos", "ref_ch"), ["contig", "pos"]))
    # Fragments: islands, cut where too few reads link neighbouring heterozygous sites.
    het_sites = calls.where("h1 <> h2").select("contig", "pos")
    weak = variants.linked_fragments(het_sites, reads, params.minReadCoverageToSupportPhasingBetweenHeterozygousSites).where("split is not null").select("contig", F.col("split").alias("s"))
    cuts = spans.select("contig", "s").union(weak).distinct()
    ends = intervals.running(cuts.select("contig", F.col("s").alias("pos"), F.lit(0).alias("d")), ["contig"]).select("contig", F.col("pos").alias("s"), "next")
    frags = intervals.range_join(ends.where("next is not null").select("contig", "s", F.col("next").alias("e")), spans.select("contig", "s", "e"))
    last = ends.where("next is null").join(spans.groupBy("contig").agg(F.max("e").alias("e")), "contig").select("contig", "s", "e")
    fragments = settled(frags.select("contig", "s", F.least("e", "r_e").alias("e")).unionByName(last).withColumn("frag", F.col("s")))
    hit = intervals.range_join(calls.withColumn("s", F.col("pos")).withColumn("e", F.col("pos") + 1), fragments).withColumnRenamed("r_frag", "frag")
    calls = hit.select("contig", "frag", "pos", "ref_ch", "h1", "h2", "gt", "gt_p", "gl", "p1", "p2", "depth1", "depth2")
    calls = settled(calls)
    two = calls.groupBy("contig", "frag").agg(F.max("depth1").alias("a"), F.max("depth2").alias("b")).where("a > 0 and b > 0").select("contig", "frag")
    usable = calls.where("ref_ch is not null").join(two, ["contig", "frag"], "left_semi")  # a fragment with one haplotype has tags but no rows
    rows = variants.phased(variants.variant_rows(usable, params.writeGVCF))
    tagged = reads.join(hap, ["contig", "read_id"]).withColumn("hap", F.when(F.col("first"), 1).otherwise(2))
    tags = variants.read_tags(tagged, fragments)
    return Result(tagged.select("contig", "read_id", "s", "e", "hap"), calls, fragments, rows, tags, error)


def run(spark: SparkSession, alignments: str, fasta: str, params: str, out: str, posteriors: str | None = None) -> Result:
    """Read files (BAM if the name ends so, else SAM text), phase, and write variants and tagged alignments below out."""
    model = Params.from_json("\n".join(r[0] for r in spark.read.text(params, wholetext=True).collect()))
    rows = formats.read_bam(spark, alignments) if alignments.endswith(".bam") else formats.read_sam(spark, alignments)
    bases = formats.read_fasta(spark, fasta)
    got = phase(rows, bases, model, formats.read_posteriors(spark, posteriors) if posteriors else None)
    sizes = [(r.contig, r.n) for r in bases.select("contig", F.length("seq").alias("n")).orderBy("contig").collect()]  # a header line each
    sinks.write_vcf(got.variants, f"{out}/variants", sizes)
    lines = sinks.tagged(rows, got.tags)
    if model.writeUnifiedSam:
        lines.select("value").write.mode("overwrite").text(f"{out}/alignments")
    if model.writeSplitSams:
        sinks.write_split_sam(variants.routed(lines.join(got.tags.select("read_id", F.col("tags").alias("_t")), "read_id", "left").drop("tags").withColumnRenamed("_t", "tags")), f"{out}/by_haplotype")
    return got
