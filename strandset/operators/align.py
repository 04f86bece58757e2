"""Read admission, CIGAR strings, and the positions a read covers."""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.codes import ALPHABET, GAP, base_code

from .intervals import cut

CIGAR_OP = re.compile("([0-9]+)([MIDNSHP=X])")


def reject_reason(min_length: int = 1, flag_mask: int = 0, min_mapq: int = 0, all_bits: bool = False, length: Column | None = None, cigar: Column | None = None) -> Column:
    """The first test that a read fails, or `admitted`: short, no_cigar, flag, mapq."""
    length = F.expr("e - s") if length is None else length
    hit = F.col("flag").bitwiseAND(F.lit(flag_mask))
    out = F.when(length < min_length, "short")
    if cigar is not None:
        out = out.when(cigar.isNull() | cigar.isin("", "*"), "no_cigar")
    return out.when((hit == flag_mask) & F.lit(flag_mask > 0) if all_bits else hit != 0, "flag").when(F.col("mapq") < min_mapq, "mapq").otherwise("admitted")


def admitted(reads: DataFrame, **tests) -> DataFrame:
    return reads.where(reject_reason(**tests) == "admitted")


def cigar_ops(cigar: Column) -> Column:
    """array<struct<n,op>> of a CIGAR string."""
    n = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 1)
    op = F.regexp_extract_all(cigar, F.lit("([0-9]+)([MIDNSHP=X])"), 2)
    return F.zip_with(n, op, lambda a, b: F.struct(a.cast("long").alias("n"), b.alias("op")))


def op_sum(ops: Column, kinds: str) -> Column:
    return F.aggregate(F.filter(ops, lambda x: x["op"].isin(*kinds)), F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def reference_length(ops: Column) -> Column:
    """Positions of the reference that the alignment spans: M, D, N, = and X."""
    return op_sum(ops, "MDN=X")


def query_length(ops: Column) -> Column:
    return op_sum(ops, "MIS=X")


def clip(ops: Column, leading: bool) -> Column:
    """Soft-clipped bases at one end; hard clips beside them don't count."""
    row = F.filter(ops, lambda x: x["op"] != "H")
    end = F.when(F.size(row) > 0, F.element_at(row, 1 if leading else -1))
    return F.coalesce(F.when(end["op"] == "S", end["n"]), F.lit(0).cast("long"))


def placed_ops(ops: Column) -> Column:
    """ops with r and q, the offsets in reference and read where each begins: one pass over the array."""
    start = F.struct(F.lit(0).cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast("array<struct<n:bigint,op:string,r:bigint,q:bigint>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        on_ref, on_read = x["op"].isin(*"MDN=X"), x["op"].isin(*"MIS=X")
        return F.struct(
            (acc["r"] + F.when(on_ref, x["n"]).otherwise(0)).alias("r"), (acc["q"] + F.when(on_read, x["n"]).otherwise(0)).alias("q"),
            F.concat(acc["out"], F.array(F.struct(x["n"].alias("n"), x["op"].alias("op"), acc["r"].alias("r"), acc["q"].alias("q")))).alias("out"),
        )

    return F.aggregate(ops, start, step, lambda acc: acc["out"])


def expand(alignments: DataFrame, gaps: bool = True) -> DataFrame:
    """contig, read_id, pos, ch, w from alignments (contig, read_id, pos, cigar, seq; pos is 1-based).

    Matched bases have weight 255; deleted positions are gaps if `gaps`, else absent; wildcards
    carry no information and are absent. Insertions and clips cover no position.
    """
    ops = F.explode(placed_ops(cigar_ops(F.col("cigar"))))
    each = alignments.select("contig", "read_id", F.col("pos").alias("s"), "seq", ops.alias("o")).where("o.n > 0").where(F.col("o.op").isin(*("MDN=X" if gaps else "M=X")))
    each = each.select("contig", "read_id", "s", "seq", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o.n") - 1)).alias("i"))
    ch = F.when(F.col("o.op").isin("D", "N"), F.lit(GAP)).otherwise(base_code(F.substring(F.col("seq"), (F.col("o.q") + F.col("i") + 1).cast("int"), F.lit(1))))
    out = each.select("contig", "read_id", (F.col("s") + F.col("o.r") + F.col("i")).alias("pos"), ch.cast("int").alias("ch"), F.lit(255).cast("long").alias("w"))
    return out.where("ch is not null")


def aligned(alignments: DataFrame, gaps: bool = True) -> DataFrame:
    """contig, s, e, text: the symbol that an alignment has at each position from s to e - 1, as expand has it; N or another letter where it has none."""
    nothing = "-" if gaps else "N"

    def text(cigar: str | None, seq: str | None) -> str:
        out, at, seq = [], 0, seq or ""
        for n, op in CIGAR_OP.findall(cigar or ""):
            n = int(n)
            if op in "M=X":
                out.append(seq[at : at + n].ljust(n, "N"))
            elif op in "DN":
                out.append(nothing * n)
            at += n if op in "MIS=X" else 0
        return "".join(out)

    def texts(cigars: pa.Array, seqs: pa.Array) -> pa.Array:
        return pa.array(map(text, cigars.to_pylist(), seqs.to_pylist()), pa.string(), size=len(cigars))

    made = F.arrow_udf(texts, "string").asNondeterministic()(F.col("cigar"), F.col("seq"))  # once, though a filter reads its length
    out = alignments.select("contig", F.col("pos").alias("s"), made.alias("text"))
    return out.select("contig", "s", (F.col("s") + F.length("text")).alias("e"), "text")


def dealt_aligned(texts: DataFrame, width: int) -> DataFrame:
    """aligned texts cut at bins of positions and dealt by them: alignments are shuffled, not their positions."""
    parts = cut(texts.withColumn("_from", F.col("s")), width)
    return parts.withColumn("text", F.substring("text", (F.col("s") - F.col("_from") + 1).cast("int"), (F.col("e") - F.col("s")).cast("int"))).drop("_from").repartition("contig", "_bin")


SYMBOL = np.full(256, -1)
for _code, _letter in enumerate(ALPHABET):
    SYMBOL[[ord(_letter), ord(_letter.lower())]] = _code


def observed_text(rows: pa.RecordBatch) -> Iterator[tuple]:
    """Observations of a batch of aligned texts as arrays, for pileup.summed; their weight is 255."""
    s, e = rows.column("s").to_numpy(), rows.column("e").to_numpy()
    n = e - s
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) + (s - np.cumsum(n) + n)[row]
    ch = SYMBOL[np.frombuffer("".join(rows.column("text").to_pylist()).encode("ascii", "replace"), np.uint8)]
    known = np.flatnonzero(ch >= 0)
    yield row[known], pos[known], ch[known], np.full(len(known), 255.0)


def pairwise_identity(obs: DataFrame, limit: int = 100) -> DataFrame:
    """read_a, read_b, shared, identity for pairs of the first `limit` reads of each contig (a report on a few reads)."""
    from pyspark.sql import Window

    first = obs.select("contig", "read_id").distinct().withColumn("_n", F.row_number().over(Window.partitionBy("contig").orderBy("read_id"))).where(F.col("_n") <= limit)
    few = obs.join(first.select("contig", "read_id"), ["contig", "read_id"], "left_semi")
    a = few.select("contig", "pos", F.col("read_id").alias("read_a"), F.col("ch").alias("ca"), F.col("w").alias("wa"))
    b = few.select("contig", "pos", F.col("read_id").alias("read_b"), F.col("ch").alias("cb"), F.col("w").alias("wb"))
    both = a.join(b, ["contig", "pos"]).where("read_a < read_b")
    got = F.sum(F.when(F.col("ca") == F.col("cb"), F.col("wa") * F.col("wb")).otherwise(F.lit(0)))
    return both.groupBy("contig", "read_a", "read_b").agg(F.countDistinct("pos").alias("shared"), got.alias("agree")).select("contig", "read_a", "read_b", "shared", F.round(F.col("agree") / (255.0 * 255.0) / F.col("shared"), 9).alias("identity"))
