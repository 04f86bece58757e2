"""Scalar functions on bases, probabilities, genotypes and identifiers, as column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = ["A", "C", "G", "T", "-"]
N_SYMBOLS = len(ALPHABET)
GAP = 4
LOG_FLOOR = 12  # natural logs from 0 to -12 map to 0..65535
SCALE = 65535


def base_code(ch: Column) -> Column:
    """0..4 for A, C, G, T and the gap in either case; null for wildcards, which carry no information."""
    out = F.lit(None).cast("int")
    for i, c in enumerate(ALPHABET):
        out = F.when(F.upper(ch) == c, F.lit(i)).otherwise(out)
    return out


def base_char(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ALPHABET)), (code + 1).cast("int"))


def scaled(p: float) -> int:
    """Fixed-point negative natural log of a probability."""
    if p <= 0 or math.log(p) < -LOG_FLOOR:
        raise ValueError(f"a probability of {p} is below the smallest that the fixed-point scale holds")
    return math.floor(SCALE * -math.log(p) / LOG_FLOOR + 0.5)


def scaled_log(p: Column) -> Column:
    low = F.ln(p) < -LOG_FLOOR
    return F.when(low, F.raise_error(F.lit("probability below the fixed-point scale")).cast("int")).otherwise(F.round(-F.ln(p) * SCALE / LOG_FLOOR).cast("int"))


def log_of_scaled(i: Column) -> Column:
    return -F.lit(float(LOG_FLOOR)) * i / F.lit(float(SCALE))


def linear(w: Column) -> Column:
    return w / F.lit(255.0)


def genotype(a: Column, b: Column) -> Column:
    return F.least(a, b) * N_SYMBOLS + F.greatest(a, b)


def phred_quality(p: Column) -> Column:
    """-10 log10(1 - p) as a whole number, 100 at most."""
    return F.when(p >= 1, F.lit(100)).otherwise(F.least(F.lit(100), (-10 * F.log10(1 - p)).cast("int")))


def phred_likelihood(log_p: Column) -> Column:
    """-10 log10(p) of a natural log, within 0 and 1000."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1000.0), -10 * log_p / F.lit(math.log(10))))


def variant_class(ref: Column, alt: Column) -> Column:
    first = F.element_at(F.split(alt, ","), 1)
    return F.when(F.length(ref) > F.length(first), "DEL").when(F.length(ref) < F.length(first), "INS").otherwise("SNV")


def allele(ref: Column, alt: Column, index: Column) -> Column:
    """The allele string of a genotype index; null for an unknown (negative) one."""
    return F.when(index >= 0, F.element_at(F.concat(F.array(ref), F.split(alt, ",")), (index + 1).cast("int")))


def percent(a: Column, b: Column) -> Column:
    """100 a / b, cut to a whole number; 0 where b is 0."""
    return F.when(b == 0, F.lit(0)).otherwise((F.lit(100.0) * a / b).cast("int"))


def contig_rank(contig: Column) -> Column:
    """Sort key of a contig's name: its number, 23 and 24 for X and Y, 100 for others."""
    bare = F.regexp_replace(contig, "^chr", "")
    return F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.rlike("^[0-9]{1,6}$"), F.try_to_number(bare, F.lit("999999")).cast("int")).otherwise(100)


def chunk_key(contig: Column, index: Column) -> Column:
    return F.format_string("%s-%03d", contig, index.cast("int"))


def chunk_rank(contig: Column, index: Column) -> Column:
    bare = F.regexp_replace(contig, "^chr", "")
    number = F.when(bare == "X", 30).when(bare == "Y", 31).otherwise(F.coalesce(F.try_to_number(bare, F.lit("999999")).cast("int"), F.lit(100)))
    return number * 1000 + index


def file_tokens(name: Column, *names: str) -> Column:
    """A struct of the dot-separated parts of a file's name, by place (null where there are fewer), and kind: np, pb or null by what it contains."""
    bare = F.element_at(F.split(name, "/"), -1)
    parts = [F.get(F.split(bare, r"\."), F.lit(i)).alias(n) for i, n in enumerate(names)]
    return F.struct(*parts, F.when(bare.contains("np"), "np").when(bare.contains("pb"), "pb").alias("kind"))


def arm_ratio(pos: Column, size: Column, cen_start: Column, cen_end: Column) -> Column:
    """Distance from the centromere as a share of the arm's length; negative inside the centromere's half."""
    above = pos >= (cen_start + cen_end) / 2
    return F.when(above, (pos - cen_end) / (size - cen_end)).otherwise((cen_start - pos) / cen_start)
