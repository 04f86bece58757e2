"""Sums by site in arrays equal sums of observations; alignments are shuffled, not positions, and sites are made once."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandset.operators import align, emission, intervals, pileup
from strandset.sources.driver_tables import observations, observed
from test_dealt import N, shuffled, sparse  # noqa: F401


def fetched(spark):
    """Rows that all stages so far read from a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleReadRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_alignments_are_shuffled_not_positions(spark, sparse):  # noqa: F811
    before = set(shuffled(spark))
    entry.queries()["sam_expanded"](spark, sparse).write.format("noop").mode("overwrite").save()
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < 8 * N


@pytest.mark.parametrize("name,times", [("split_weak_linkage", 4), ("vcf_written", 80)])
def test_reads_are_fetched_a_few_times(spark, sparse, name, times):  # noqa: F811
    """Sites are made from reads once, however many steps use them; vcf_written takes its sites, some 37 a read, to fragments once, and its rows on."""
    before = set(fetched(spark))
    entry.queries()[name](spark, sparse).write.format("noop").mode("overwrite").save()
    assert sum(n for s, n in fetched(spark).items() if s not in before) < times * N


def test_sites_are_scored_once(spark, sparse):  # noqa: F811
    for name in ("genotype_calls", "genotype_likelihoods", "emission_int", "emission_logsum", "hap_identity"):
        plan = entry.queries()[name](spark, sparse)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, name


@pytest.mark.parametrize("width,held", [(7, 1 << 15), (64, 5)])
def test_summed_reads_equal_sums_of_observations(spark, monkeypatch, width, held):
    rows = [("A", f"r{i}", 7919 * i + i % 3, 3 * i, 3 * i + 1 + 5 * i % 23) for i in range(90)] + [("B", "x", 1, 5, 5), ("B", "y", 4, 6, 7)]
    reads = spark.createDataFrame(rows, "contig string, read_id string, h long, s long, e long")
    monkeypatch.setattr(pileup, "SLICE", held)
    first = F.col("h") % 2 == 0
    parts = intervals.dealt(reads.withColumn("first", first), width)
    obs = observations(reads)
    n = pileup.summed(parts, observed, *(f"n{c}" for c in range(5)), width=width)
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, pileup.site_counts(obs).collect()))
    assert sorted(map(tuple, pileup.by_symbol(n).collect())) == sorted(map(tuple, pileup.base_counts(obs).collect()))
    ab = pileup.summed(parts, observed, *emission.WEIGHTS, width=width)
    assert sorted(map(tuple, ab.collect())) == sorted(map(tuple, emission.both_haplotypes(obs, first).collect()))


@pytest.mark.parametrize("gaps", [True, False])
def test_aligned_texts_equal_expanded_positions(spark, gaps):
    rows = [("r1", "c", 10, "2S3M1I2M2D1M1H", "NNACGTTAC"), ("r2", "c", 12, "3M40N2=1X", "acgT-n"), ("r3", "d", 1, "5M", "*"), ("r4", "d", 3, "0M2P4M2D", "ACé"), ("r5", "d", 9, "*", "AC"), ("r6", "c", 11, "4M", "RACG")]
    a = spark.createDataFrame(rows, "read_id string, contig string, pos long, cigar string, seq string")
    want = align.expand(a, gaps).groupBy("contig", "pos", "ch").agg(F.sum("w")).collect()
    parts = align.dealt_aligned(align.aligned(a, gaps), 8)
    got = pileup.by_symbol(pileup.summed(parts, align.observed_text, *(f"n{c}" for c in range(5)), width=8)).drop("cnt").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_two_symbols_of_most_weight(spark):
    rows = [(0, 5, 5, 2, 5), (7, 0, 0, 0, 0), (1, 2, 3, 4, 5), (0, 0, 0, 9, 9)]
    got = pileup.top_two(spark.createDataFrame(rows, ", ".join(f"n{c} long" for c in range(5)))).collect()
    want = [sorted(range(5), key=lambda c: (-r[c], c))[:2] for r in rows]
    assert [(x.ch1, x.w1, x.ch2, x.w2) for x in got] == [(a, r[a], b, r[b]) for r, (a, b) in zip(rows, want)]
