"""Writers: variants, tagged alignments, intervals and sequences as text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.tags import UNPHASED


def vcf_header(contigs: list[tuple[str, int]], sample: str = "SMPL1") -> list[str]:
    info = [("INFO", "DP", "1", "Integer", "Read depth"), ("INFO", "AC", "A", "Integer", "Depth of each alternative"), ("FORMAT", "GT", "1", "String", "Genotype"), ("FORMAT", "GL", "G", "Float", "Genotype likelihoods"), ("FORMAT", "PS", "1", "Integer", "Phase set"), ("FORMAT", "DP", "1", "Integer", "Read depth"), ("FORMAT", "MPI", "1", "Integer", "Chunk of origin")]
    return ["##fileformat=VCFv4.2", *(f"##contig=<ID={c},length={n}>" for c, n in contigs), *(f'##{k}=<ID={i},Number={n},Type={t},Description="{d}">' for k, i, n, t, d in info), "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def vcf_lines(rows: DataFrame) -> DataFrame:
    """value: a line for each row (contig, pos, ref, alt, gt, dp, ac, ps, optional qual, gl and mpi)."""
    text = lambda c: F.col(c).cast("string")
    qual = F.coalesce(text("qual"), F.lit(".")) if "qual" in rows.columns else F.lit(".")
    names, values = ["GT", "PS", "DP"], ["gt", text("ps"), text("dp")]
    if "gl" in rows.columns:
        names.append("GL")
        values.append(F.coalesce(F.array_join(F.transform("gl", lambda v: F.format_string("%.2f", v)), ","), F.lit(".")))
    if "mpi" in rows.columns:
        names.append("MPI")
        values.append(F.coalesce(text("mpi"), F.lit(".")))
    return rows.select(F.concat_ws("\t", "contig", text("pos"), F.lit("."), "ref", "alt", qual, F.lit("PASS"), F.concat(F.lit("DP="), text("dp"), F.lit(";AC="), text("ac")), F.lit(":".join(names)), F.concat_ws(":", *values)).alias("value"), "contig", "pos")


def write_vcf(rows: DataFrame, path: str, contigs: list[tuple[str, int]]) -> None:
    """Sorted parts, the header at the head of the first: in the order of their names they are one VCF."""
    spark = rows.sparkSession
    head = spark.createDataFrame([(x, "", i, 0) for i, x in enumerate(vcf_header(contigs))], "value string, contig string, pos long, _body int")
    every = head.unionByName(vcf_lines(rows).withColumn("_body", F.lit(1)))
    every.repartitionByRange("_body", "contig", "pos").sortWithinPartitions("_body", "contig", "pos").select("value").write.mode("overwrite").text(path)


def sam_lines(alignments: DataFrame, tag: Column | None = None, chunk: Column | None = None) -> DataFrame:
    """alignments with value: SAM text with the haplotype tag `ht` and, if given, the chunk tag `mp`."""
    tag = F.lit(UNPHASED) if tag is None else F.coalesce(tag, F.lit(UNPHASED))
    fields = ["read_id", F.col("flag").cast("string"), "contig", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", F.coalesce("qual", F.lit("*")), F.concat(F.lit("ht:Z:"), tag)]
    if chunk is not None:
        fields.append(F.concat(F.lit("mp:Z:"), chunk))
    return alignments.withColumn("value", F.concat_ws("\t", *fields))


def tagged(alignments: DataFrame, tags: DataFrame) -> DataFrame:
    """alignments with the text of their read's tags (read_id, text); the unphased tag without one."""
    return sam_lines(alignments.join(tags.select("read_id", F.col("text").alias("_ht")), "read_id", "left"), F.col("_ht")).drop("_ht")


def write_split_sam(lines: DataFrame, path: str) -> None:
    """One folder for each haplotype (column hap_file: 1, 2, or 0 for unphased)."""
    lines.select("value", "hap_file").write.mode("overwrite").partitionBy("hap_file").text(path)


def write_bed(df: DataFrame, path: str, *by: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).option("sep", "\t").csv(path)


def vcf_to_bed(variants: DataFrame, margin: int = 50) -> DataFrame:
    return variants.select("contig", F.greatest(F.lit(0).cast("long"), F.col("pos") - margin).alias("s"), (F.col("pos") + margin).alias("e"))


def fastq(alignments: DataFrame) -> DataFrame:
    """value: four lines for each read, its soft clips cut off; a read without qualities gets the lowest."""
    from strandset.operators.align import cigar_ops, clip, query_length

    ops = cigar_ops(F.col("cigar"))
    a = alignments.withColumns({"_lead": clip(ops, True), "_tail": clip(ops, False), "_len": query_length(ops)})
    cut = lambda c: F.substring(c, (F.col("_lead") + 1).cast("int"), (F.col("_len") - F.col("_lead") - F.col("_tail")).cast("int"))
    seq = cut(F.col("seq"))
    qual = F.when(F.coalesce(F.col("qual"), F.lit("*")) == "*", F.repeat(F.lit('"'), F.length(seq))).otherwise(cut(F.col("qual")))
    return a.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id")), seq, F.lit("+"), qual).alias("value"))
