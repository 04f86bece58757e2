import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from strandset.functions import codes, tags
from strandset.operators import align
from strandset.plans import phasing
from strandset.sources import formats, sinks


def test_sam_and_expansion(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1\nr1\t0\tc1\t10\t60\t2S3M1I2M2D1M1H\t*\t0\t0\tNNACGTTAC\t*\tNM:i:3\tht:Z:h1,p9,r0,l5\n")
    a = formats.read_sam(spark, str(tmp_path / "a.sam"))
    row = a.first()
    assert (row.read_id, row.pos, row.mapq, row.tags["NM"], row.tags["ht"]) == ("r1", 10, 60, "3", "h1,p9,r0,l5")
    ops = align.cigar_ops(F.col("cigar"))
    got = a.select(align.reference_length(ops).alias("r"), align.query_length(ops).alias("q"), align.op_sum(ops, "I").alias("i"), align.clip(ops, True).alias("lead"), align.clip(ops, False).alias("tail")).first()
    assert tuple(got) == (8, 9, 1, 2, 0)
    obs = sorted((r.pos, r.ch, r.w) for r in align.expand(a).collect())
    assert obs == [(10, 0, 255), (11, 1, 255), (12, 2, 255), (13, 3, 255), (14, 0, 255), (15, 4, 255), (16, 4, 255), (17, 1, 255)]
    assert [p for p, _, _ in sorted((r.pos, r.ch, r.w) for r in align.expand(a, gaps=False).collect())] == [10, 11, 12, 13, 14, 17]


def test_bam(spark, tmp_path):
    seq, ops = [1, 2, 4, 8], [(4 << 4) | 0]
    body = b"r1\0" + struct.pack("<I", ops[0]) + bytes([seq[0] << 4 | seq[1], seq[2] << 4 | seq[3]]) + bytes([30] * 4) + b"NMC\x02" + b"htZh0,p0,r0,l0\0"
    fixed = struct.pack("<iiBBHHHiiii", 0, 9, 3, 60, 0, 1, 16, 4, -1, -1, 0)
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 100) + struct.pack("<i", len(fixed + body)) + fixed + body
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    z = c.compress(data) + c.flush()
    block = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<HBBHH", 6, 66, 67, 2, len(z) + 25) + z + struct.pack("<II", zlib.crc32(data), len(data))
    (tmp_path / "a.bam").write_bytes(block)
    r = formats.read_bam(spark, str(tmp_path / "a.bam")).first()
    assert (r.read_id, r.flag, r.contig, r.pos, r.mapq, r.cigar, r.seq, r.qual) == ("r1", 16, "c1", 10, 60, "4M", "ACGT", "????")
    assert r.tags == {"NM": "2", "ht": "h0,p0,r0,l0"}


def test_vcf_bed_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\n3\t7\t.\tA\tC,G\t.\tPASS\t.\tGT:PS\t1|2:7\n3\t9\t.\tAC\tA\t30\tPASS\t.\tGT\t./1\n")
    rows = formats.read_vcf(spark, str(tmp_path / "a.vcf.gz")).orderBy("pos").collect()
    assert [(r.pos, r.a1, r.a2, r.phased, r.qual) for r in rows] == [(7, 1, 2, True, None), (9, -1, 1, False, 30.0)]
    v = formats.read_vcf(spark, str(tmp_path / "a.vcf.gz"))
    assert [r[0] for r in v.orderBy("pos").select(codes.variant_class(F.col("ref"), F.col("alt"))).collect()] == ["SNV", "DEL"]
    assert [r[0] for r in v.orderBy("pos").select(codes.allele(F.col("ref"), F.col("alt"), F.col("a2"))).collect()] == ["G", "A"]
    assert [tuple(r) for r in sinks.vcf_to_bed(v, 8).orderBy("s").collect()] == [("3", 0, 15), ("3", 1, 17)]
    (tmp_path / "a.bed").write_text("c1 1 5\nc2\t2\t9\tgene\n")
    assert [tuple(r) for r in formats.read_bed(spark, str(tmp_path / "a.bed")).orderBy("s").collect()] == [("c1", 1, 5, None), ("c2", 2, 9, "gene")]
    assert formats.read_bed(spark, str(tmp_path / "a.bed"), ["c2"]).count() == 1
    (tmp_path / "bad.bed").write_text("c1 1\n")
    with pytest.raises(Exception, match="fewer than three"):
        formats.read_bed(spark, str(tmp_path / "bad.bed")).collect()
    (tmp_path / "a.fa").write_text(">c1 first\nacg\nTT\n>c2\nGGG\n")
    fa = formats.read_fasta(spark, str(tmp_path / "a.fa"))
    assert {r.contig: r.seq for r in fa.collect()} == {"c1": "ACGTT", "c2": "GGG"}
    sites = spark.createDataFrame([("c1", 3), ("c2", 1), ("c9", 1)], "contig string, pos long")
    assert {r.contig: r.ref_ch for r in phasing.with_reference(sites, fa).collect()} == {"c1": 2, "c2": 2, "c9": None}


def test_posteriors_sum_to_255_and_gaps(spark, tmp_path):
    (tmp_path / "r7.tsv").write_text("## x\n#CHROM\tPOS\tpA\tpC\tpG\tpT\tp_\nc\t5\t0.333\t0.333\t0.334\t0\t0\nc\t5\t1\t0\t0\t0\t0\nc\t8\t0\t0\t0\t1\t0\n")
    got = formats.read_posteriors(spark, str(tmp_path / "r7.tsv")).collect()
    by = {}
    for r in got:
        by.setdefault(r.pos, {})[r.ch] = r.w
        assert r.read_id == "r7"
    assert set(by) == {5, 6, 7, 8} and all(sum(x.values()) == 255 for x in by.values())
    assert by[6] == {4: 255} and by[8] == {3: 255} and by[5][2] >= by[5][0]


def test_params_and_manifest(spark, tmp_path):
    p = formats.Params.from_json('{"mapqFilter": 10, "readErrorModel": [' + ", ".join(["0.2"] * 25) + "],}")
    assert p.mapqFilter == 10 and formats.Params.from_json(p.to_json()) == p
    with pytest.raises(ValueError, match="unknown"):
        formats.Params.from_json('{"nope": 1}')
    (tmp_path / "m.tsv").write_text("# c\nu1\tfile:///a.bam\t\tref.fa\nu2\tfile:///b.bam\tchr2\n")
    rows = formats.read_manifest(spark, str(tmp_path / "m.tsv"), contig="chr1", params="p.json").orderBy("uuid").collect()
    assert [tuple(r) for r in rows] == [("u1", "file:///a.bam", "chr1", "ref.fa", "p.json"), ("u2", "file:///b.bam", "chr2", None, "p.json")]


def test_logs_and_summaries(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\nSensitivity: 0.447 (34 / 76)\n")
    r = formats.read_run_logs(spark, str(tmp_path / "a.log"), {"tp": r"\((\d+) / ", "missing": r"no (\d+)"}).first()
    assert (r.file, r.tp, r.missing) == ("a.log", 34.0, None)
    (tmp_path / "s.txt").write_text("Threshold a b\n----\n3.0 1 2 3 4 0.9 0.8 0.85\nNone 1 2 3 4 0.7 0.6 0.65\n")
    assert sorted(tuple(x)[1:] for x in formats.read_summaries(spark, str(tmp_path / "s.txt")).collect()) == [(0.7, 0.6), (0.9, 0.8)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 5, "A", "C", "0|1", 9, "4", 5)], "contig string, pos long, ref string, alt string, gt string, dp long, ac string, ps long")
    sinks.write_vcf(rows, str(tmp_path / "o"), [("c1", 10)])
    lines = [x for f in sorted((tmp_path / "o").glob("part-*.txt")) for x in f.read_text().splitlines()]
    assert lines[0] == "##fileformat=VCFv4.2" and lines[-2].startswith("#CHROM\t")
    assert lines[-1] == "c1\t5\t.\tA\tC\t.\tPASS\tDP=9;AC=4\tGT:PS:DP\t0|1:5:9"
    back = formats.read_vcf(spark, str(tmp_path / "o")).first()
    assert (back.a1, back.a2, back.phased) == (0, 1, True)
    a = spark.createDataFrame([("r1", 0, "c1", 3, 60, "1S3M", "ACGT", "*"), ("r2", 0, "c1", 4, 60, "2M", "GG", "AB")], "read_id string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual string")
    t = spark.createDataFrame([("r1", "h2,p1,r0,l3")], "read_id string, text string")
    lines = {r.read_id: r.value for r in sinks.tagged(a, t).collect()}
    assert lines["r1"].endswith("ht:Z:h2,p1,r0,l3") and lines["r2"].endswith("ht:Z:" + tags.UNPHASED)
    assert sorted(r.value for r in sinks.fastq(a).collect()) == ['@r1\nCGT\n+\n"""', "@r2\nGG\n+\nAB"]
