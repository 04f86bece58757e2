import bisect
import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandset.functions import bits, codes
from strandset.operators import compare, emission, genotype, hmm, intervals, pileup, reports, stitch, variants
from strandset.streaming import incremental


def _intervals(spark, seed=1, n=200, top=400):
    r = random.Random(seed)
    rows = [(f"c{r.randrange(3)}", f"r{i:03d}", (s := r.randrange(top)), s + r.randrange(1, 40)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "contig string, read_id string, s long, e long")


def _islands(rows, touching=False):
    out = []
    for c in sorted({r[0] for r in rows}):
        for s, e in sorted((r[2], r[3]) for r in rows if r[0] == c):
            if out and out[-1][0] == c and (s <= out[-1][2] if touching else s < out[-1][2]):
                out[-1] = (c, out[-1][1], max(e, out[-1][2]), out[-1][3] + 1)
            else:
                out.append((c, s, e, 1))
    return out


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("touching", [False, True])
def test_islands(spark, width, touching):
    rows, df = _intervals(spark)
    assert sorted(map(tuple, intervals.islands(df, touching=touching, width=width).select("contig", "s", "e", "n").collect())) == _islands(rows, touching)


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_running_sums_go_from_bin_to_bin(spark, width):
    r = random.Random(2)
    rows = sorted((c, p, r.randrange(-3, 4)) for c in ("a", "b") for p in r.sample(range(200), 40))
    got = sorted(map(tuple, intervals.running(spark.createDataFrame(rows, "contig string, pos long, d long"), ["contig"], width).collect()))
    want, total = [], {}
    for (c, p, d), after in zip(rows, [*rows[1:], (None, None, None)]):
        total[c] = total.get(c, 0) + d
        want.append((c, p, d, after[1] if after[0] == c else None, total[c]))
    assert got == want


def test_range_join_has_each_pair_once(spark):
    rows, df = _intervals(spark, 2)
    got = intervals.range_join(df, df, 9).where("read_id < r_read_id").select("read_id", "r_read_id").collect()
    want = {(a[1], b[1]) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and a[2] < b[3] and b[2] < a[3]}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_colours_are_as_many_as_the_depth(spark):
    rows, df = _intervals(spark, 3)
    got = intervals.colours(df, 11).collect()
    assert len(got) == len(rows)
    for a, b in itertools.combinations(got, 2):
        assert not (a.contig == b.contig and a.colour == b.colour and a.s < b.e and b.s < a.e)
    for c in {r.contig for r in got}:
        depth = max(sum(1 for r in rows if r[0] == c and r[2] <= p < r[3]) for p in range(450))
        assert max(r.colour for r in got if r.contig == c) + 1 == depth
    assert max(r.colour for r in intervals.coverage_cap(intervals.colours(df), 2).collect()) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10)), max_size=30))
def test_first_fit(pairs):
    pairs = sorted((s, s + n) for s, n in pairs)
    got = intervals.first_fit([s for s, _ in pairs], [e for _, e in pairs])
    depth = max((sum(1 for s, e in pairs if s <= p < e) for p in range(41)), default=0)
    assert (max(got) + 1 if got else 0) == depth


def test_nearest_and_complement(spark):
    rows, df = _intervals(spark, 4, 40, 4000)
    edges = [(r[0], p) for r in rows for p in r[2:]]
    b = spark.createDataFrame(edges, "contig string, pos long")
    points = [(f"c{i % 4}", i * 37 % 4000) for i in range(100)]
    got = {(r.contig, r.pos): r.distance for r in intervals.nearest_boundary(spark.createDataFrame(points, "contig string, pos long"), b, width=50).collect()}
    for c, p in points:
        assert got[c, p] == min((abs(p - q) for k, q in edges if k == c), default=None)
    spans = spark.createDataFrame([(f"c{i}", 0, 5000) for i in range(4)], "contig string, s long, e long")
    gaps = intervals.complement(df, spans).collect()
    free = {(c, p) for c in ("c0", "c1", "c2", "c3") for p in range(5000)} - {(r[0], p) for r in rows for p in range(r[2], r[3])}
    assert {(g.contig, p) for g in gaps for p in range(g.s, g.e)} == free


def test_bits(spark):
    df = spark.createDataFrame([(-1, 64), (5, 3), (2**62, 63), (0, 0)], "m long, d int")
    got = df.select(bits.accept_mask(F.col("d")).alias("a"), bits.weight(F.col("m")).alias("w"), bits.invert(F.col("m"), F.col("d")).alias("i"), bits.text(F.col("m")).alias("t"), bits.bit(F.col("m"), F.lit(62)).alias("b"), bits.joined(F.lit(1).cast("long"), F.col("m"), F.col("d")).alias("j")).collect()
    assert [r.a for r in got] == [-1, 7, 2**63 - 1, 0]
    assert [r.w for r in got] == [64, 2, 1, 0] and [r.i for r in got] == [0, 2, 2**62 - 1, 0]
    assert [r.b for r in got] == [1, 0, 1, 0] and got[1].t == "0" * 61 + "101" and got[1].j == 13


def test_codes(spark):
    got = spark.createDataFrame([("a",), ("T",), ("-",), ("N",)], "c string").select(codes.base_code(F.col("c"))).collect()
    assert [r[0] for r in got] == [0, 3, 4, None]
    assert codes.scaled(1.0) == 0 and codes.scaled(float(np.exp(-12))) == 65535
    with pytest.raises(ValueError):
        codes.scaled(1e-6)
    q = spark.createDataFrame([(1.0,), (0.0,), (0.999,)], "p double").select(codes.phred_quality(F.col("p"))).collect()
    assert [r[0] for r in q] == [100, 0, 30] or [r[0] for r in q] == [100, 0, 29]
    assert [r[0] for r in spark.createDataFrame([("chr2",), ("X",), ("chrUn",)], "c string").select(codes.contig_rank(F.col("c"))).collect()] == [2, 23, 100]


def _sites(spark, n=30, seed=5):
    r = random.Random(seed)
    rows = [("c", i, r.choice([0, 1, 2, 3, None]), *(255 * r.randrange(4) for _ in range(10))) for i in range(n)]
    names = ["contig", "pos", "ref_ch", *(f"{x}{c}" for x in "ab" for c in range(5))]
    return rows, spark.createDataFrame(rows, "contig string, pos long, ref_ch int, " + ", ".join(f"{n} long" for n in names[3:]))


def test_integer_cost_follows_the_exact_maximum(spark):
    rows, df = _sites(spark)
    got = {r.pos: (r.cost, r.log_p) for r in df.select("pos", emission.integer_cost().alias("cost"), emission.exact_log().alias("log_p")).collect()}
    h, e = np.array(pileup.HET), np.array(pileup.READ_ERROR)
    for _, pos, ref, *w in rows:
        a, b = np.array(w[:5]) / 255, np.array(w[5:]) / 255
        la, lb = np.log(e) @ a, np.log(e) @ b
        prior = h[ref] if ref is not None else np.full(5, 0.2)
        terms = np.array([[[np.log(prior[r]) + np.log(h[r][i]) + la[i] + np.log(h[r][j]) + lb[j] for j in range(5)] for i in range(5)] for r in range(5)])
        assert abs(got[pos][1] - np.log(np.exp(terms - terms.max()).sum()) - terms.max()) < 1e-6
        assert abs(-got[pos][0] * hmm.UNIT - terms.max()) < 0.02


def test_genotype_posteriors(spark):
    rows, df = _sites(spark)
    h, e = np.array(pileup.HET), np.array(pileup.READ_ERROR)
    gl = {r.pos: r.gl for r in genotype.likelihoods(df).collect()}
    for r in genotype.calls(df).collect():
        w = next(x for x in rows if x[1] == r.pos)
        la, lb = np.log(e) @ (np.array(w[3:8]) / 255), np.log(e) @ (np.array(w[8:]) / 255)
        prior = h[w[2]] if w[2] is not None else np.full(5, 0.2)
        p = np.array([[sum(prior[k] * h[k][i] * h[k][j] for k in range(5)) * np.exp(la[i] + lb[j]) for j in range(5)] for i in range(5)])
        p /= p.sum()
        assert abs(r.p1 - p[r.h1].sum()) < 1e-6 and abs(r.p2 - p[:, r.h2].sum()) < 1e-6
        assert abs(r.gt_p - (p[r.h1, r.h2] + (p[r.h2, r.h1] if r.h1 != r.h2 else 0))) < 1e-6
        assert np.allclose(gl[r.pos], np.clip(-10 * np.log10(p.ravel()), 0, 1000), atol=1e-4)


def test_phasing_against_all_bipartitions():
    rng = np.random.default_rng(1)
    h, e = np.array(pileup.scaled_matrix(pileup.HET)), np.array(pileup.scaled_matrix(pileup.READ_ERROR))
    for _ in range(25):
        n = int(rng.integers(2, 7))
        span = [(a := int(rng.integers(0, 6)), a + int(rng.integers(2, 6))) for _ in range(n)]
        sites = []
        for p in range(12):
            rs = [f"r{i}" for i, (a, b) in enumerate(span) if a <= p < b]
            if rs:
                w = np.zeros((len(rs), 5), np.int64)
                w[np.arange(len(rs)), rng.integers(0, 3, len(rs))] = 255
                sites.append((int(rng.integers(-1, 5)), rs, w))
        got = hmm.phase(sites, beam=10**6)
        used = sorted({r for _, rs, _ in sites for r in rs})
        cost = lambda a: sum(int(hmm.site_costs(np.array([[a[r] for r in rs]], bool), w, ref, h, e)[0]) for ref, rs, w in sites)
        every = [(cost(a), a) for a in (dict(zip(used, x)) for x in itertools.product([True, False], repeat=len(used)))]
        assert got.cost == min(c for c, _ in every) == cost({r: got.haplotype[r] == 1 for r in used})
        assert all(-1e-9 <= p <= 1 + 1e-9 for p in got.posterior.values())
        assert hmm.phase(sites, beam=3).cost >= got.cost
        assert hmm.phase(sites, beam=10**6, least=4, share=1e-9).cost >= got.cost
        assert hmm.phase(sites, beam=10**6, least=4, share=0.0).cost == got.cost


def test_simulated_reads_are_phased(spark):
    r = random.Random(8)
    hets = {p: (r.randrange(4), r.randrange(4)) for p in range(0, 400, 10)}
    hets = {p: (a, b if a != b else (a + 1) % 4) for p, (a, b) in hets.items()}
    rows = []
    for i in range(80):
        s, hap = r.randrange(0, 340), i % 2
        for p, alleles in hets.items():
            if s <= p < s + 60:
                rows.append(("c", 0, f"r{i:02d}", p, alleles[hap] if r.random() > 0.05 else r.randrange(4), 255, hets[p][0]))
    obs = spark.createDataFrame(rows, "contig string, island long, read_id string, pos long, ch int, w long, ref_ch int")
    got = hmm.phase_islands(obs).collect()
    agree = sum((x.haplotype == 1) == (int(x.read_id[1:]) % 2 == 0) for x in got)
    assert max(agree, len(got) - agree) >= 0.95 * len(got)
    learnt = hmm.train(obs, rounds=1)
    assert all(abs(sum(row) - 1) < 1e-6 and row[i] == max(row) for i, row in enumerate(learnt[:4]))


def test_chunks_of_a_long_island_are_stitched(spark):
    """40,000 positions at depth 30 with noisy reads: in chunks as good as whole, within 0.01, and each task bounded."""
    r = random.Random(40)
    hets = sorted(r.sample(range(40_000), 500))
    alleles = {p: r.sample(range(4), 2) for p in hets}
    rows, spans = [], []
    for i in range(1200):
        s, hap = r.randrange(0, 39_000), i % 2
        spans.append((s, s + 1000))
        for p in hets[bisect.bisect_left(hets, s) : bisect.bisect_left(hets, s + 1000)]:
            rows.append(("c", 0, f"r{i:04d}", p, alleles[p][hap] if r.random() > 0.1 else r.randrange(5), 255, alleles[p][0]))
    obs = spark.createDataFrame(rows, "contig string, island long, read_id string, pos long, ch int, w long, ref_ch int")
    island = spark.createDataFrame([("c", 0, min(s for s, _ in spans), max(e for _, e in spans))], "contig string, island long, s long, e long")

    def right(df):
        got = df.collect()
        agree = sum((x.haplotype == 1) == (int(x.read_id[1:]) % 2 == 0) for x in got)
        assert len(got) == len({x[2] for x in rows}) and all((x.posterior >= 0.5) == (x.haplotype == 1) or 0.01 < x.posterior < 0.99 for x in got)
        return max(agree, len(got) - agree) / len(got)

    whole, parts = right(hmm.phase_islands(obs, 50)), right(hmm.phase_chunks(obs, island, 5000, 1000, 50))
    assert whole >= 0.97 and abs(whole - parts) <= 0.01
    pieces = hmm.chunked(obs, island, 5000, 1000).groupBy("idx").agg(F.min("pos").alias("a"), F.max("pos").alias("z")).collect()
    assert len(pieces) == 8 and all(x.z - x.a <= 7000 for x in pieces)
    one = hmm.chunked(obs, island, 50_000, 1000)
    assert one.count() == len(rows) and one.select("idx").distinct().count() == 1
    assert hmm.phase_chunks(obs.limit(0), island, 5000, 1000).count() == 0


def _moves(spark):
    obs = spark.createDataFrame([("c", f"r{i}", p, (0 if i % 2 else 1), 255) for i in range(10) for p in range(5)], "contig string, read_id string, pos long, ch int, w long")
    start = spark.createDataFrame([(f"r{i}", i in (0, 1, 3, 5, 7, 9)) for i in range(10)], "read_id string, first boolean")
    return obs, start


def test_refinement_moves_the_odd_read(spark):
    obs, start = _moves(spark)
    sites_of = lambda mine: genotype.calls(emission.both_haplotypes(mine, F.col("first")).withColumn("ref_ch", F.lit(0)))
    got = {r.read_id: r.first for r in genotype.refine(obs, sites_of, start).collect()}
    assert got == {f"r{i}": i % 2 == 1 for i in range(10)}


def test_comparison_cells(spark):
    truth = spark.createDataFrame([("c", p, a, b, "SNV") for p, a, b in [(10, 0, 1), (20, 0, 1), (30, 1, 1), (40, 0, 1), (50, 0, 1), (60, 1, 1), (70, 0, 1)]], "contig string, pos long, a1 int, a2 int, type string")
    calls = spark.createDataFrame([("c", p, a, b, "SNV", f) for p, a, b, f in [(5, 0, 1, True), (10, 1, 0, False), (15, 0, 1, True), (20, 1, 0, True), (30, 0, 1, True), (40, 0, 1, True), (50, -1, -1, True), (60, 1, 1, True), (99, 0, 1, True)]], "contig string, pos long, a1 int, a2 int, type string, phased boolean")
    rows = compare.classified(compare.aligned(truth, calls))
    assert {r.pos: r.outcome for r in rows.collect()} == {10: "TP", 15: "FP", 20: "TP", 30: "FPFN", 40: "TP", 50: "FN", 60: "TP", 70: "FN"}
    acc = compare.accuracy(rows, truth).first()
    assert (acc.tp, acc.fp, acc.fn, acc.switches, acc.distance, acc.uncertain) == (4, 2, 3, 1, 1, 1)


def test_reports(spark):
    lens = [1, 2, 2, 3, 9, 10]
    df = spark.createDataFrame([("k", x) for x in lens], "k string, n long")
    assert reports.n50(df, "n", "k").first().n50 == 10 or reports.n50(df, "n", "k").first().n50 == 9
    assert [tuple(r) for r in reports.length_buckets(df, "n", 2).orderBy("bucket").collect()] == [(0, 1), (1, 3), (2, 0), (3, 0), (4, 1), (5, 1)]
    w = spark.createDataFrame([(1, 2), (5, 1), (9, 1)], "v long, w long")
    assert reports.weighted_median(w, "v", "w").first().median == 3.0
    assert reports.equal_buckets(0, 10, 4) == [0, 2.5, 5, 7.5, 10]
    empty = df.where("n > 99")
    assert reports.length_buckets(empty, "n", 2).count() == 0 and reports.n50(empty, "n", "k").count() == 0


def test_chunks_cover_all_reads(spark):
    _, df = _intervals(spark, 6)
    c = stitch.chunks(pileup.contig_spans(df), 50, 5)
    got = stitch.assign(df, c, 20)
    assert got.select("read_id").distinct().count() == df.count()
    tag = F.array(F.struct(F.lit(1).cast("long").alias("h"), F.lit(10).cast("long").alias("p"), F.lit(0).cast("long").alias("r"), F.lit(30).cast("long").alias("l")))
    one = spark.range(1).select(stitch.split_tags(tag, F.lit(10), F.lit(25).cast("long"), "left").alias("l"), stitch.split_tags(tag, F.lit(10), F.lit(25).cast("long"), "right").alias("r")).first()
    assert [tuple(x) for x in one.l] == [(1, 10, 0, 15)] and [tuple(x) for x in one.r] == [(1, 25, 15, 15)]
    votes = spark.createDataFrame([(9, 1), (1, 9), (5, 5), (0, 0)], "a long, b long").select(stitch.merge_ratio(F.col("a"), F.col("b"), 0.8)).collect()
    assert [v[0] for v in votes] == ["SAME", "DIFFERENT", None, None]


def test_indel_run(spark):
    calls = spark.createDataFrame([("c", 0, 1, 0, 0, 0, 5, 5), ("c", 0, 2, 1, 1, 1, 5, 5), ("c", 0, 3, 2, 4, 2, 4, 5), ("c", 0, 4, 3, 4, 3, 4, 5), ("c", 0, 5, 0, 2, 3, 5, 6), ("c", 0, 6, 1, 1, 1, 5, 5)], "contig string, frag long, pos long, ref_ch int, h1 int, h2 int, depth1 long, depth2 long")
    got = {r.pos: tuple(r)[3:] for r in variants.phased(variants.variant_rows(calls)).collect()}
    assert got == {2: ("CGT", "C", "1/0", 9, "4", "DEL", 2), 5: ("A", "G,T", "1|2", 11, "5,6", "SNV", 2)}


def test_streaming_counts_equal_batch(spark, tmp_path):
    obs = spark.createDataFrame([("c", i % 5, i % 3, 255) for i in range(60)], "contig string, pos long, ch int, w long")
    obs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = incremental.base_counts(stream).writeStream.outputMode("complete").format("memory").queryName("sc").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sc").collect())) == sorted(map(tuple, pileup.site_counts(obs).collect()))


def test_chunk_tags(spark):
    a = spark.createDataFrame([("r1", {"ht": "h1,p9,r0,l5;h0,p0,r0,l0;h2,p20,r5,l3"}), ("r2", {"x": "y"})], "read_id string, tags map<string,string>")
    assert sorted(map(tuple, stitch.chunk_tags(a).collect())) == [("r1", 9, 1, 0, 5), ("r1", 20, 2, 5, 3)]
    with pytest.raises(Exception, match="malformed"):
        stitch.chunk_tags(spark.createDataFrame([("r", {"ht": "nonsense"})], "read_id string, tags map<string,string>")).collect()
