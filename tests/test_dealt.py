"""What goes by site shuffles reads, not their positions; look-ups by bins equal joins."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from strandset.operators import intervals, pileup
from strandset.sources.driver_tables import observations

N = 1500
BY_SITE = "bit_slice_counts emission_int emission_logsum expand_positions expected_identity genotype_calls genotype_likelihoods hap_identity haplotype_posteriors hetsites_of hom_mask pileup_counts pileup_pivot read_consensus_filter ref_prior refine_one_round top2_bases column_read_sets".split()


@pytest.fixture(scope="module")
def sparse(spark, tmp_path_factory):
    """Reads that hardly overlap, so that partial sums by position are as many as observations."""
    d = tmp_path_factory.mktemp("sparse")
    t = spark.range(N).selectExpr("id as l_orderkey", "cast(1 + id % 7 as int) as l_linenumber", "id * 37 as l_partkey", "id % 100 as l_suppkey", "cast(20 + id % 31 as double) as l_quantity", "cast(id as double) as l_extendedprice", "0.05D as l_tax", "'A' as l_returnflag")
    t.repartition(4).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def shuffled(spark):
    """Rows that all stages so far wrote for a shuffle."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("name", BY_SITE)
def test_reads_are_shuffled_not_positions(spark, sparse, name):
    before = set(shuffled(spark))
    entry.queries()[name](spark, sparse).write.format("noop").mode("overwrite").save()
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < 8 * N


def test_sets_with_many_equal_intervals(spark):
    rows = [("A", i % 3, 10 * (i % 5) + 4 * (i % 2), 10 * (i % 5) + 4 * (i % 2) + 4) for i in range(300)]
    got = intervals.membership(spark.createDataFrame(rows, "contig string, k int, s long, e long").repartition(7), "k").collect()
    assert {p: r.bitmap for r in got for p in range(r.s, r.e)} == {p: m for p in range(60) if (m := sum(1 << k for k in range(3) if any(j == k and s <= p < e for _, j, s, e in rows)))}


@pytest.mark.parametrize("width", [3, 100])
def test_columns_have_the_reads_of_each_position(spark, width):
    rows = [("A", f"r{i % 7}-{i}", 2 * i, 2 * i + 1 + 7 * i % 19) for i in range(40)] + [("B", "x", 3, 3)]
    got = {p: (tuple(r.read_ids), r.depth) for r in intervals.columns(spark.createDataFrame(rows, "contig string, read_id string, s long, e long"), width).collect() for p in range(r.s, r.e)}
    want = {p: tuple(sorted(n for _, n, s, e in rows if s <= p < e)) for p in range(120)}
    assert got == {p: (v, len(v)) for p, v in want.items() if v}


@pytest.mark.parametrize("width", [7, 256])
def test_look_ups_by_bin_equal_a_join(spark, width):
    reads = spark.createDataFrame([("A", f"r{i}", i, 3 * i, 3 * i + 1 + 5 * i % 23) for i in range(60)] + [("B", "x", 1, 5, 5)], "contig string, read_id string, h long, s long, e long")
    parts = intervals.dealt(reads, width)
    obs, plain = observations(parts, "_bin"), observations(reads)
    sites = pileup.top_two(pileup.site_counts(obs, "contig", "_bin", "pos")).where("pos % 5 > 0")
    want = plain.join(pileup.top_two(pileup.site_counts(plain)).where("pos % 5 > 0").select("contig", "pos", "ch1"), ["contig", "pos"])
    got = pileup.at_site(observations(pileup.with_sites(parts, sites, "ch1"), "_at", "ch1"), "ch1")
    cols = ["contig", "read_id", "pos", "ch", "w", "ch1"]
    rows = got.select(*cols).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted((tuple(r) for r in plain.join(want.select("contig", "pos", "ch1").distinct(), ["contig", "pos"], "left").select(*cols).collect()), key=repr)
    assert any(r.ch1 is None for r in rows) and sorted(map(tuple, pileup.site_counts(obs).collect())) == sorted(map(tuple, pileup.site_counts(plain).collect()))


@pytest.mark.parametrize("name", ["hmm_phase", "hmm_posteriors"])
def test_phasing_shuffles_reads(spark, sparse, name):
    """Islands, chunks and stitching shuffle reads a few times; observations, some 37 a read, stay where their reads were dealt."""
    before = set(shuffled(spark))
    entry.queries()[name](spark, sparse).write.format("noop").mode("overwrite").save()
    assert sum(n for s, n in shuffled(spark).items() if s not in before) < 20 * N
