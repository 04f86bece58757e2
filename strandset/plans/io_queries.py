"""Files: tables written in a format in the shared folder and read back, and functions of their fields."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from strandset.functions import bits, codes, tags
from strandset.operators import align, genotype, pileup, stitch, variants
from strandset.sources import formats, sinks
from strandset.sources.driver_tables import BED, READS, bed, reads, table, with_
from strandset.sources.shared import folder, settled

from .phase_queries import BASE, FRAG, TAGS, VR, split_tag_sets
from .phasing import with_reference
from .pileup_queries import PAIRS, sites_of
from .registry import query

# Alignments of reads: short ones match whole; longer ones have clips, an insertion and a deletion.
CIGAR = """CASE WHEN e - s < 8 THEN concat(e - s, 'M') ELSE concat('2S', 1 + h % 3, 'M1I', 2 + h % 2, 'M2D', e - s - 5 - h % 3 - h % 2, 'M1H') END"""
BASES = "CASE WHEN e - s < 8 THEN e - s ELSE e - s + 1 END"
ALN = f"""aln AS (SELECT contig, read_id, h, s, e, flag, mapq, {CIGAR} AS cigar, array_to_string(list_transform(range(0, {BASES}), lambda i: substr('ACGTN', 1 + CAST((h * 3 + i * 7) % 5 AS INTEGER), 1)), '') AS seq FROM reads WHERE s < e)"""


def _alignments(spark, d):
    seq = f"substr(repeat('AGNCT', cast(({BASES}) div 5 + 2 as int)), 1 + cast(h * 4 % 5 as int), cast({BASES} as int))"  # symbol (3 h + 7 i) % 5 of ACGTN at place i
    return reads(spark, d).where("s < e").selectExpr("read_id", "flag", "contig", "s as pos", "mapq", f"{CIGAR} as cigar", f"{seq} as seq", "'*' as qual", "h")


def _written_sam(spark, d):
    path = folder(spark)
    tag = F.expr("concat('h', 1 + h % 2, ',p', pos - 1, ',r0,l', length(seq))")
    sinks.sam_lines(_alignments(spark, d), F.when(F.expr("h % 5 > 0"), tag), F.expr("concat(h % 7, ',', pos, '-', pos + 100)")).select("value").write.text(path)
    return formats.read_sam(spark, path)


@query(with_(READS, ALN) + "SELECT contig, read_id, flag, s AS pos, mapq, cigar, seq, CASE WHEN h % 5 > 0 THEN concat('h', 1 + h % 2, ',p', s - 1, ',r0,l', length(seq)) ELSE 'h0,p0,r0,l0' END AS ht, h % 7 AS chunk, s AS chunk_start, s + 100 AS chunk_end FROM aln")
def sam_written(spark, d):
    """Tagged alignments as SAM text, read back; the chunk tag taken apart."""
    chunk = tags.chunk_of(F.col("tags")["mp"])
    a = _written_sam(spark, d).withColumn("c", chunk)
    return a.select("contig", "read_id", "flag", "pos", "mapq", "cigar", "seq", F.col("tags")["ht"].alias("ht"), F.col("c.idx").alias("chunk"), F.col("c.start").alias("chunk_start"), F.col("c.end").alias("chunk_end"))


@query(with_(READS, ALN) + """, o AS (SELECT contig, h, s, e, seq, r, 1 + h % 3 AS k, 2 + h % 2 AS m FROM (SELECT *, unnest(range(0, e - s)) AS r FROM aln)),
    q AS (SELECT contig, s + r AS pos, CASE WHEN e - s < 8 THEN r WHEN r < k THEN 2 + r WHEN r < k + m THEN 3 + r WHEN r < k + m + 2 THEN NULL ELSE 1 + r END AS q, seq FROM o),
    b AS (SELECT contig, pos, CASE WHEN q IS NULL THEN 5 ELSE strpos('ACGT', substr(seq, CAST(q AS INTEGER) + 1, 1)) END AS x FROM q)
    SELECT contig, pos, CAST(x - 1 AS INTEGER) AS ch, CAST(count(*) AS BIGINT) AS n, CAST(255 * count(*) AS BIGINT) AS weight FROM b WHERE x > 0 GROUP BY 1, 2, 3""")
def sam_expanded(spark, d):
    """Positions that the CIGAR strings of written alignments cover."""
    parts = align.dealt_aligned(align.aligned(_written_sam(spark, d)), pileup.WIDTH)
    counts = pileup.by_symbol(pileup.summed(parts, align.observed_text, *(f"n{c}" for c in range(codes.N_SYMBOLS))))
    return counts.select("contig", "pos", "ch", F.expr("weight div 255").alias("n"), "weight")


@query(with_(READS, ALN) + "SELECT '@' || read_id || chr(10) || t || chr(10) || '+' || chr(10) || repeat('\"', length(t)) AS value FROM (SELECT read_id, CASE WHEN e - s < 8 THEN seq ELSE substr(seq, 3) END AS t FROM aln)")
def fastq_written(spark, d):
    """Reads without their clips, four lines each."""
    path = folder(spark)
    sinks.fastq(_written_sam(spark, d)).write.text(path)
    lines = spark.read.option("lineSep", "@").text(path).where("length(value) > 0")
    return lines.select(F.concat(F.lit("@"), F.rtrim(F.col("value"), F.lit("\n"))).alias("value"))


@query(with_(BED) + "SELECT contig, s, e, name FROM bed")
def bed_written(spark, d):
    path = folder(spark)
    sinks.write_bed(bed(spark, d).select("contig", "s", "e", "name"), path)
    return formats.read_bed(spark, path)


@query(with_(READS) + "SELECT DISTINCT contig, s AS pos, CASE WHEN s > 0 THEN CAST((s * 7 + 3) % 4 AS INTEGER) END AS ref_ch FROM reads")
def fasta_written(spark, d):
    """Sequences of the contigs as FASTA in lines of 60, read back and looked up at positions."""
    path = folder(spark)
    r = reads(spark, d)
    seq = F.expr("array_join(transform(sequence(1L, n), i -> substr('ACGT', 1 + cast((i * 7 + 3) % 4 as int), 1)), '')")
    spans = r.groupBy("contig").agg(F.max("e").alias("n"))
    spans.select(F.concat(F.lit(">"), "contig", F.lit(" made\n"), F.regexp_replace(seq, "(.{60})", "$1\n")).alias("value")).write.text(path)
    return with_reference(r.select("contig", F.col("s").alias("pos")).distinct(), formats.read_fasta(spark, path)).select("contig", "pos", "ref_ch")


def _listed(sep: str) -> str:
    pair = lambda a, b: f"list_extract(gls, CAST({a} * 5 + {b} + 1 AS INTEGER))"
    one = "(CASE WHEN gt = '0|1' THEN sh2 ELSE sh1 END)"
    first = [pair("sr", "sr"), pair("sr", one), pair(one, one)]
    more = [pair("sr", "sh2"), pair(one, "sh2"), pair("sh2", "sh2")]
    return "CASE WHEN gt = '1|2' THEN [" + ", ".join(first + more) + "] ELSE [" + ", ".join(first) + "] END"


TEN = repr(math.log(10))
GLS = f"""gp AS (SELECT contig, pos, list_transform([{PAIRS}], lambda u: u.v) AS v FROM lg), gm AS (SELECT contig, pos, v, list_max(v) AS m FROM gp),
    gs AS (SELECT contig, pos, v, m + ln(list_sum(list_transform(v, lambda x: exp(x - m)))) AS t FROM gm),
    gx AS (SELECT contig, pos, list_transform(v, lambda x: greatest(0, least(1000, -10 * (x - t) / {TEN}))) AS gls, list_transform(v, lambda x: exp(x - t)) AS ps FROM gs)"""
# Where a row's likelihoods are read: at the position itself, or the first gap of a run.
AT = """ax AS (SELECT contig, frag, min(pos) AS pos, min(pos) FILTER (gap) AS at FROM vr WHERE ins GROUP BY contig, frag, run UNION ALL SELECT contig, frag, pos, pos FROM vr WHERE NOT ins),
    ay AS (SELECT ax.contig, ax.frag, ax.pos, f.ref_ch AS sr, f.h1 AS sh1, f.h2 AS sh2, g.gls, list_extract(g0.ps, CAST(f0.h1 * 5 + f0.h2 + 1 AS INTEGER)) + CASE WHEN f0.h1 <> f0.h2 THEN list_extract(g0.ps, CAST(f0.h2 * 5 + f0.h1 + 1 AS INTEGER)) ELSE 0 END AS gt_p
        FROM ax JOIN fr f ON f.contig = ax.contig AND f.pos = ax.at JOIN gx g ON g.contig = ax.contig AND g.pos = ax.at JOIN fr f0 ON f0.contig = ax.contig AND f0.pos = ax.pos JOIN gx g0 ON g0.contig = ax.contig AND g0.pos = ax.pos)"""


@query(with_(*BASE, FRAG, VR, GLS, AT) + f"""SELECT vk.contig, vk.pos, ref, alt, CASE WHEN vk.pos = min(vk.pos) OVER (PARTITION BY vk.contig, vk.frag) THEN replace(gt, '|', '/') ELSE gt END AS gt, min(vk.pos) OVER (PARTITION BY vk.contig, vk.frag) AS ps, dp, ac,
    CAST(least(100, CASE WHEN gt_p >= 1 - 1e-11 THEN 100 ELSE floor(-10 * log10(1 - gt_p) + 1e-6) END) AS INTEGER) AS qual, round(list_sum(list_transform({_listed(',')}, lambda x: round(x, 2))), 0) AS gl_sum, len({_listed(',')}) AS n_gl, CAST(vk.frag % 7 AS INTEGER) AS mpi
    FROM vk JOIN ay USING (contig, frag, pos) WHERE gt <> '0|0'""")
def vcf_written(spark, d):
    """Variants with quality, likelihoods and chunk of origin as one VCF, read back."""
    path = folder(spark)
    s = sites_of(spark, d)
    c = genotype.calls(s).withColumn("frag", F.expr("pos div 200"))
    # Qualities are compared exactly, so probabilities are set apart from the steps of the scale first.
    c = c.withColumn("gt_p", F.when(F.col("gt_p") >= 1 - 1e-11, 1.0).otherwise(1 - (1 - F.col("gt_p")) * F.lit(10 ** (-1e-7))))
    # Parts are sorted by ranges, for which rows are read twice, so they are settled.
    rows = settled(variants.phased(variants.variant_rows(c, scored=True)).withColumn("mpi", F.expr("frag % 7")))
    sizes = [(x.contig, x.n) for x in reads(spark, d).where("s < e").groupBy("contig").agg(F.max(F.col("e") - 1).alias("n")).orderBy("contig").collect()]  # a header line each
    sinks.write_vcf(rows, path, sizes)
    v = formats.read_vcf(spark, path)
    gl = F.transform(F.split(F.col("sample")["GL"], ","), lambda x: x.cast("double"))
    info = lambda name: F.regexp_extract("info", f"{name}=([^;]*)", 1)
    total = F.round(F.aggregate(gl, F.lit(0.0), lambda a, x: a + x), 0)
    return v.select("contig", "pos", "ref", "alt", F.col("sample")["GT"].alias("gt"), F.col("sample")["PS"].cast("long").alias("ps"), info("DP").cast("long").alias("dp"), info("AC").alias("ac"), F.col("qual").cast("int").alias("qual"), total.alias("gl_sum"), F.size(gl).cast("long").alias("n_gl"), F.col("sample")["MPI"].cast("int").alias("mpi"))


@query(with_(READS) + "SELECT contig, greatest(0, s - 50) AS s, s + 50 AS e FROM reads")
def vcf_margins(spark, d):
    """Intervals around the positions of variants written as VCF."""
    path = folder(spark)
    r = reads(spark, d).selectExpr("contig", "s as pos", "'A' as ref", "'C' as alt", "'0|1' as gt", "1L as dp", "'1' as ac", "s as ps")
    sinks.write_vcf(r, path, [])
    return sinks.vcf_to_bed(formats.read_vcf(spark, path))


@query("SELECT uuid, url, coalesce(contig, 'chr9') AS contig, CASE WHEN k % 3 = 0 THEN 'ref.fa' ELSE 'r' || k || '.fa' END AS reference_url, 'p.json' AS params_url FROM (SELECT c_custkey AS k, 'u' || c_custkey AS uuid, 's3://b/' || c_custkey || '.bam' AS url, CASE WHEN c_custkey % 2 = 0 THEN 'chr' || c_nationkey END AS contig FROM customer)")
def manifest_read(spark, d):
    path = folder(spark)
    c = table(spark, d, "customer")
    line = F.expr("concat_ws('\\t', concat('u', c_custkey), concat('s3://b/', c_custkey, '.bam'), if(c_custkey % 2 = 0, concat('chr', c_nationkey), ''), if(c_custkey % 3 = 0, '', concat('r', c_custkey, '.fa')))")
    c.select(line.alias("value")).unionByName(spark.createDataFrame([("# a comment",)], "value string")).write.text(path)
    return formats.read_manifest(spark, path, contig="chr9", reference="ref.fa", params="p.json")


@query("SELECT CAST(c_acctbal AS INTEGER) // 1 AS value, CAST(count(*) AS BIGINT) AS n FROM (SELECT floor(c_acctbal) AS c_acctbal FROM customer) GROUP BY 1")
def numbers_read(spark, d):
    path = folder(spark)
    table(spark, d, "customer").selectExpr("cast(floor(c_acctbal) as string) as value").write.text(path)
    return formats.read_numbers(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a || '-' || b AS name, a, b, CAST(length(a) + length(b) AS INTEGER) AS n FROM (SELECT unnest(['np', 'pb']) AS a), (SELECT unnest(['chr1', 'chr2', 'chrX']) AS b)")
def manifest_product(spark, d):
    return formats.manifest_rows(spark, a=["np", "pb"], b=["chr1", "chr2", "chrX"]).select(F.concat_ws("-", "a", "b").alias("name"), "a", "b", (F.length("a") + F.length("b")).alias("n"))


@query("SELECT event_id, split_part(f, '.', 1) AS run, split_part(f, '.', 2) AS contig, nullif(split_part(f, '.', 3), '') AS sub, CASE WHEN contains(f, 'np') THEN 'np' WHEN contains(f, 'pb') THEN 'pb' END AS kind FROM (SELECT event_id, concat(CASE event_id % 3 WHEN 0 THEN 'np' WHEN 1 THEN 'pb' ELSE 'xx' END, user_id, '.chr', event_id % 22, CASE WHEN event_id % 2 = 0 THEN '.sub' ELSE '' END) AS f FROM events)")
def file_names(spark, d):
    name = F.expr("concat('/data/x/', case event_id % 3 when 0 then 'np' when 1 then 'pb' else 'xx' end, user_id, '.chr', event_id % 22, case when event_id % 2 = 0 then '.sub' else '' end)")
    return table(spark, d, "events").select("event_id", codes.file_tokens(name, "run", "contig", "sub").alias("x")).select("event_id", "x.*")


NAMES = "CASE c_custkey % 4 WHEN 0 THEN concat('chr', c_custkey % 30) WHEN 1 THEN 'chrX' WHEN 2 THEN 'Y' ELSE concat('un_', c_nationkey) END"
P = "((c_custkey % 997 + 1) / 1000.0)"


@query(f"""WITH c AS (SELECT *, {NAMES} AS contig, CAST(c_custkey % 50 AS INTEGER) AS idx, {P}::DOUBLE AS p, CAST(c_custkey % 3 - 1 AS INTEGER) AS a FROM customer), k AS (SELECT *, regexp_replace(contig, '^chr', '') AS bare, try_cast(regexp_replace(contig, '^chr', '') AS INTEGER) AS num FROM c)
    SELECT c_custkey, contig || '-' || lpad(CAST(idx AS VARCHAR), 3, '0') AS chunk, CASE bare WHEN 'X' THEN 23 WHEN 'Y' THEN 24 ELSE coalesce(num, 100) END AS contig_rank, CASE bare WHEN 'X' THEN 30 WHEN 'Y' THEN 31 ELSE coalesce(num, 100) END * 1000 + idx AS chunk_rank,
    CAST(round(-ln(p) * 65535 / 12) AS INTEGER) AS scaled, round(exp(-12.0::DOUBLE * CAST(round(-ln(p) * 65535 / 12) AS INTEGER) / 65535.0::DOUBLE), 6) AS unscaled, round((c_custkey % 256) / 255.0::DOUBLE, 6) AS linear, CAST(floor(-10 * log10(1 - p) + 1e-9) AS INTEGER) AS phred,
    CASE WHEN a >= 0 THEN list_extract(['A', 'C,G'], a + 1) END AS allele_text, CASE WHEN idx % 7 = 0 THEN 0 ELSE CAST(floor(100.0 * c_nationkey / (idx % 7)) AS INTEGER) END AS percent, lpad(bin(c_custkey), 64, '0') AS mask FROM k""".replace("list_extract(['A', 'C,G'], a + 1)", "list_extract(['A', 'C', 'G'], a + 1)"))
def scalar_functions(spark, d):
    """Keys and ranks of chunks and contigs, fixed-point logs, probabilities, alleles, percentages and masks as text."""
    c = table(spark, d, "customer").selectExpr("*", f"{NAMES} as contig", "cast(c_custkey % 50 as int) as idx", f"cast({P} as double) as p", "cast(c_custkey % 3 - 1 as int) as a")
    scaled = codes.scaled_log(F.col("p"))
    return c.select(
        "c_custkey", codes.chunk_key(F.col("contig"), F.col("idx")).alias("chunk"), codes.contig_rank(F.col("contig")).alias("contig_rank"), codes.chunk_rank(F.col("contig"), F.col("idx")).alias("chunk_rank"),
        scaled.alias("scaled"), F.round(F.exp(codes.log_of_scaled(scaled)), 6).alias("unscaled"), F.round(codes.linear(F.expr("c_custkey % 256")), 6).alias("linear"), codes.phred_quality(F.col("p") + 1e-12).alias("phred"),
        codes.allele(F.lit("A"), F.lit("C,G"), F.col("a")).alias("allele_text"), codes.percent(F.col("c_nationkey"), F.expr("idx % 7")).alias("percent"), bits.text(F.col("c_custkey")).alias("mask"),
    )


SPLIT = "CASE WHEN fs - 1 = blk THEN greatest(0, least(l, blk + 20 - p)) ELSE 0 END"


@query(with_(READS, TAGS) + f""", x AS (SELECT r.contig, read_id, 1 + h % 2 AS h, fs, fs - 1 AS p, greatest(0, fs - s) AS r, least(e, fs + 45) - greatest(s, fs) AS l, s // 60 * 60 - 1 AS blk FROM reads r JOIN fg ON r.contig = fg.contig AND s < fs + 45 AND fs < e WHERE fs > 0),
    y AS (SELECT *, {SPLIT} AS keep FROM x)
    SELECT contig, read_id, 'left' AS side, h, p, r, CASE WHEN p = blk THEN keep ELSE l END AS l FROM y WHERE CASE WHEN p = blk THEN keep ELSE l END > 0
    UNION ALL SELECT contig, read_id, 'right', h, CASE WHEN p = blk THEN blk + 20 ELSE p END, CASE WHEN p = blk THEN r + keep ELSE r END, CASE WHEN p = blk THEN l - keep ELSE l END FROM y WHERE CASE WHEN p = blk THEN l - keep ELSE l END > 0""")
def split_blocks(spark, d):
    """Tags cut at a position of their first block: what stays with it, and what becomes a new block."""
    t = split_tag_sets(spark, d)
    sides = [t.select("contig", "read_id", F.lit(side).alias("side"), F.explode(stitch.split_tags(F.col("tags"), F.col("blk"), F.col("blk") + 20, side)).alias("t")) for side in ("left", "right")]
    return sides[0].unionByName(sides[1]).select("contig", "read_id", "side", "t.h", "t.p", "t.r", "t.l")
