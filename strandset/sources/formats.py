"""Readers for the text formats of read phasing, and for BAM.

All but BAM are lines that Spark splits and parses itself. Positions are 1-based in alignments and
variants, 0-based and half-open in BED.
"""
from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions.codes import N_SYMBOLS

ALIGNMENT = "read_id string, flag int, contig string, pos long, mapq int, cigar string, seq string, qual string, tags map<string,string>"


def _part(i: int, cols: Column | str = "x") -> Column:
    return F.get(F.col(cols) if isinstance(cols, str) else cols, F.lit(i))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text; header lines are left out. tags maps a tag's name to its value."""
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0)).select(F.split("value", "\t").alias("x"))
    tag = F.transform(F.slice("x", 12, F.greatest(F.lit(0), F.size("x") - 11)), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.regexp_extract(t, "^[^:]*:[^:]*:(.*)$", 1).alias("v")))
    return lines.select(_part(0).alias("read_id"), _part(1).cast("int").alias("flag"), _part(2).alias("contig"), _part(3).cast("long").alias("pos"), _part(4).cast("int").alias("mapq"), _part(5).alias("cigar"), _part(9).alias("seq"), _part(10).alias("qual"), F.map_from_entries(tag).alias("tags"))


def _bgzf(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(raw):
        extra = struct.unpack_from("<H", raw, at + 10)[0]
        z = at + 12 + extra
        i, size = at + 12, 0
        while i < z:
            a, b, n = struct.unpack_from("<BBH", raw, i)
            if (a, b) == (66, 67):
                size = struct.unpack_from("<H", raw, i + 4)[0] + 1
            i += 4 + n
        if not size:
            raise ValueError("not a BGZF block")
        yield zlib.decompress(raw[z : at + size - 8], -15)
        at += size


def _tags(raw: bytes) -> dict[str, str]:
    kinds = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
    out, at = {}, 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            values = struct.unpack_from(f"<{n}{kinds[sub]}", raw, at + 5)
            out[name], at = ",".join(map(str, values)), at + 5 + struct.calcsize(f"<{n}{kinds[sub]}")
        else:
            v = struct.unpack_from("<" + kinds[kind], raw, at)[0]
            out[name], at = v.decode() if kind == "A" else str(v), at + struct.calcsize("<" + kinds[kind])
    return out


def parse_bam(raw: bytes) -> Iterator[tuple]:
    data = b"".join(_bgzf(raw))
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n, at = struct.unpack_from("<i", data, at)[0], at + 4
    names = []
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(data):
        block, ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiiBBHHHi", data, at)
        p = at + 36
        name, p = data[p : p + l_name - 1].decode(), p + l_name
        ops, p = struct.unpack_from(f"<{n_cigar}I", data, p), p + 4 * n_cigar
        half, p = data[p : p + (l_seq + 1) // 2], p + (l_seq + 1) // 2
        seq = "".join("=ACMGRSVTWYHKDBN"[b >> 4] + "=ACMGRSVTWYHKDBN"[b & 15] for b in half)[:l_seq]
        qual, p = data[p : p + l_seq], p + l_seq
        text = "*" if not l_seq or qual[0] == 255 else "".join(chr(33 + q) for q in qual)
        yield name, flag, names[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{x >> 4}{'MIDNSHP=X'[x & 15]}" for x in ops) or "*", seq or "*", text, _tags(data[p : at + 4 + block])
        at += 4 + block


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of BAM files, one task for each file; a file is held whole, so large ones should come in parts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["content"]:
                rows = list(parse_bam(bytes(raw)))
                for i in range(0, max(1, len(rows)), 5000):
                    yield pd.DataFrame(rows[i : i + 5000], columns=["read_id", "flag", "contig", "pos", "mapq", "cigar", "seq", "qual", "tags"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ALIGNMENT)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, seq (upper case), one row for each sequence."""
    records = spark.read.option("lineSep", ">").text(path).where(F.length(F.trim("value")) > 0)
    return records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), F.upper(F.regexp_replace(F.regexp_extract("value", r"^[^\n]*\n([\s\S]*)$", 1), r"\s", "")).alias("seq"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variants of (gzipped) VCF text, with the first sample's fields as a map, genotype indices (-1 unknown) and phase."""
    x = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(F.split("value", "\t").alias("x"))
    v = x.select(*(_part(i).alias(n) for i, n in enumerate(("contig", "pos", "id", "ref", "alt", "qual", "filter", "info"))), F.split(_part(8), ":").alias("names"), F.split(_part(9), ":").alias("vals"))
    sample = F.when(F.col("names").isNotNull(), F.map_from_arrays(F.slice("names", F.lit(1), F.least(F.size("names"), F.size("vals"))), F.slice("vals", F.lit(1), F.least(F.size("names"), F.size("vals")))))
    v = v.withColumns({"pos": F.col("pos").cast("long"), "qual": F.when(F.col("qual") != ".", F.expr("try_cast(qual as double)")), "sample": sample}).drop("names", "vals")
    index = lambda i: F.coalesce(F.expr(f"try_cast(get(split(sample['GT'], '[|/]'), {i}) as int)"), F.lit(-1))
    return v.withColumns({"a1": index(0), "a2": index(1), "phased": F.coalesce(F.col("sample")["GT"].contains("|"), F.lit(False))})


def read_bed(spark: SparkSession, path: str, contigs: list[str] | None = None) -> DataFrame:
    """contig, s, e, name (null without a fourth column); a line of fewer than three columns raises."""
    x = spark.read.text(path).where((F.length(F.trim("value")) > 0) & ~F.col("value").startswith("#")).select(F.split(F.trim("value"), r"\s+").alias("x"))
    bad = F.when(F.size("x") < 3, F.raise_error(F.lit("a BED line has fewer than three columns")).cast("string")).otherwise(_part(0))
    out = x.select(bad.alias("contig"), _part(1).cast("long").alias("s"), _part(2).cast("long").alias("e"), _part(3).alias("name"))
    return out.where(F.col("contig").isin(contigs)) if contigs else out


def read_posteriors(spark: SparkSession, path: str) -> DataFrame:
    """contig, read_id, pos, ch, w from one file of base probabilities for each read (its name is the read's id).

    Weights are whole numbers that sum to 255: the largest remainders take what rounding leaves
    over. Positions that don't rise (inserts) are skipped; positions missing in between are gaps.
    """
    from pyspark.sql import Window

    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.length("value") > 0))
    x = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.tsv)?$", 1).alias("read_id"), F.split("value", "\t").alias("x"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n")).alias("line"))  # lines rise within a split of a file
    p = x.select("read_id", "line", _part(0).alias("contig"), _part(1).cast("long").alias("pos"), F.transform(F.slice("x", 3, N_SYMBOLS), lambda v: v.cast("double")).alias("p"))
    w = Window.partitionBy("read_id").orderBy("line")
    p = p.withColumn("top", F.max("pos").over(w.rowsBetween(Window.unboundedPreceding, -1))).where("top is null or pos > top")
    total = F.aggregate("p", F.lit(0.0), lambda acc, v: acc + v)
    scaled = F.transform("p", lambda v: v * 255 / total)
    p = p.withColumn("scaled", scaled).withColumn("floor", F.transform("scaled", lambda v: F.floor(v)))
    p = p.withColumn("left", F.lit(255) - F.aggregate("floor", F.lit(0).cast("long"), lambda acc, v: acc + v))
    order = F.transform(F.array_sort(F.transform("scaled", lambda v, i: F.struct((F.floor(v) - v).alias("r"), i.alias("i")))), lambda s: s["i"])
    weights = F.transform("floor", lambda v, i: v + F.when(F.array_position(order, i) <= F.col("left"), 1).otherwise(0))
    p = p.withColumn("weights", weights).withColumn("next", F.lead("pos").over(w))
    here = p.select("contig", "read_id", "pos", F.posexplode("weights").alias("ch", "w")).where("w > 0")
    gaps = p.where("next > pos + 1").select("contig", "read_id", F.explode(F.sequence(F.col("pos") + 1, F.col("next") - 1)).alias("pos"), F.lit(N_SYMBOLS - 1).alias("ch"), F.lit(255).cast("long").alias("w"))
    return here.unionByName(gaps)


def with_posteriors(aligned: DataFrame, posteriors: DataFrame, only: bool = False) -> DataFrame:
    """Observations of a read's posteriors if it has any, else (unless only) of its alignment."""
    if only:
        return posteriors
    return posteriors.unionByName(aligned.join(posteriors.select("read_id").distinct(), "read_id", "left_anti").select(*posteriors.columns))


@dataclass
class Params:
    """Model parameters; a key that isn't one raises."""

    # The keys of parameter files and the defaults of keys that a file leaves out.
    alphabet: list | None = None
    wildcard: str | None = None
    haplotypeSubstitutionModel: list | None = None
    readErrorModel: list | None = None
    maxNotSumTransitions: bool = True
    minPartitionsInAColumn: int = 50
    maxPartitionsInAColumn: int = 200
    minPosteriorProbabilityForPartition: float = 0.001
    maxCoverageDepth: int = 64
    minReadCoverageToSupportPhasingBetweenHeterozygousSites: int = 0
    onDiagonalReadErrorPseudoCount: float = 1
    offDiagonalReadErrorPseudoCount: float = 1
    trainingIterations: int = 0
    filterBadReads: bool = False
    filterMatchThreshold: float = 0.9
    useReferencePrior: bool = False
    includeInvertedPartitions: bool = True
    filterLikelyHomozygousSites: bool = False
    minSecondMostFrequentBaseFilter: float = 2
    minSecondMostFrequentBaseLogProbFilter: float = 0
    gapCharactersForDeletions: bool = True
    filterAReadWithAnyOneOfTheseSamFlagsSet: int = 0
    mapqFilter: int = 0
    estimateReadErrorProbsEmpirically: bool = False
    roundsOfIterativeRefinement: int = 0
    writeGVCF: bool = False
    writeSplitSams: bool = True
    writeUnifiedSam: bool = True
    verbose: bool = False

    @classmethod
    def from_json(cls, text: str) -> Params:
        got = json.loads(text.replace(",}", "}").replace(",\n}", "\n}"))
        got.pop("compareVCFs", None)  # an old key without a meaning
        names = {f.name for f in fields(cls)}
        if extra := sorted(set(got) - names):
            raise ValueError(f"unknown parameters: {', '.join(extra)}")
        out = cls(**got)
        for m in (out.haplotypeSubstitutionModel, out.readErrorModel):
            if m is not None and len(m) != N_SYMBOLS**2:
                raise ValueError(f"a matrix must have {N_SYMBOLS**2} numbers")
        return out

    def to_json(self) -> str:
        return json.dumps({f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) is not None}, indent=1)

    @staticmethod
    def matrix(flat: list) -> list[list[float]]:
        return [flat[i : i + N_SYMBOLS] for i in range(0, N_SYMBOLS**2, N_SYMBOLS)]


def read_manifest(spark: SparkSession, path: str, contig: str | None = None, reference: str | None = None, params: str | None = None) -> DataFrame:
    """uuid, url, contig, reference_url, params_url; empty cells take the defaults, lines from # on are comments."""
    x = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(F.split("value", "\t").alias("x"))
    cell = lambda i, d: F.coalesce(F.nullif(F.trim(_part(i)), F.lit("")), F.lit(d).cast("string"))
    return x.select(*(cell(i, d).alias(n) for i, (n, d) in enumerate((("uuid", None), ("url", None), ("contig", contig), ("reference_url", reference), ("params_url", params)))))


def manifest_rows(spark: SparkSession, **dims: list[str]) -> DataFrame:
    """One row for each choice of a value from each list: the configurations that a manifest names."""
    out = spark.range(1).drop("id")
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out


def read_run_logs(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """file and a number for each named pattern (its first group) in a whole log; null where it doesn't occur."""
    logs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return logs.select("file", *(F.regexp_extract("value", p, 1).try_cast("double").alias(n) for n, p in patterns.items()))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """file, precision, sensitivity: the fifth and sixth columns of the lines that begin with a number or None."""
    x = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("x"))
    return x.where(_part(0).rlike("^([0-9.]+|None)$")).select("file", _part(5).try_cast("double").alias("precision"), _part(6).try_cast("double").alias("sensitivity"))


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """value: a whole number a line; all of them (a sample is the caller's `sample`)."""
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.trim("value").cast("int").alias("value"))
