import json
import random

from strandset.plans import phasing
from strandset.sources import formats


def test_reads_to_variants(spark, tmp_path):
    r = random.Random(12)
    ref = "".join(r.choice("ACGT") for _ in range(600))
    other = {p: next(b for b in "ACGT" if b != ref[p - 1]) for p in range(20, 600, 45)}
    truth, lines = {}, ["@HD\tVN:1.6"]
    for i in range(90):
        s, hap = r.randrange(1, 480), i % 2
        seq = "".join((other.get(p, ref[p - 1]) if hap else ref[p - 1]) if r.random() > 0.02 else r.choice("ACGT") for p in range(s, s + 120))
        truth[f"r{i}"] = hap
        lines.append(f"r{i}\t0\tc1\t{s}\t60\t120M\t*\t0\t0\t{seq}\t*")
    lines += ["low\t0\tc1\t5\t3\t50M\t*\t0\t0\t" + ref[4:54] + "\t*", "flagged\t1024\tc1\t5\t60\t50M\t*\t0\t0\t" + ref[4:54] + "\t*"]
    (tmp_path / "a.sam").write_text("\n".join(lines) + "\n")
    (tmp_path / "r.fa").write_text(">c1\n" + ref + "\n")
    (tmp_path / "p.json").write_text(json.dumps({"mapqFilter": 10, "filterAReadWithAnyOneOfTheseSamFlagsSet": 1024, "useReferencePrior": True, "filterLikelyHomozygousSites": True, "roundsOfIterativeRefinement": 2, "minReadCoverageToSupportPhasingBetweenHeterozygousSites": 1}))
    got = phasing.run(spark, str(tmp_path / "a.sam"), str(tmp_path / "r.fa"), str(tmp_path / "p.json"), str(tmp_path / "out"))
    hap = {x.read_id: x.hap for x in got.reads.collect()}
    assert "low" not in hap and "flagged" not in hap and len(hap) == 90
    agree = sum((hap[k] == 1) == (v == 0) for k, v in truth.items())
    assert max(agree, 90 - agree) >= 85
    rows = formats.read_vcf(spark, str(tmp_path / "out/variants")).collect()
    found = {x.pos: (x.ref, x.alt) for x in rows if x.a1 != x.a2}
    covered = {p for p in other if 20 <= p < 560}
    assert all(found.get(p) == (ref[p - 1], other[p]) for p in covered) and len(found) <= len(other) + 1
    written = {x.read_id: x.tags["ht"] for x in formats.read_sam(spark, str(tmp_path / "out/alignments")).collect()}
    assert written["low"] == "h0,p0,r0,l0" and all(written[k].startswith(f"h{hap[k]},") for k in truth)
    split = spark.read.text(str(tmp_path / "out/by_haplotype")).groupBy("hap_file").count().collect()
    assert {x.hap_file: x["count"] for x in split}[0] == 2 and sum(x["count"] for x in split) == 92
