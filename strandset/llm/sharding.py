"""Sharding by a Hilbert curve: documents near one another in language, source and size share files.

Each dimension is quantised to 16 steps, the cell's place on the curve orders the rows, and the
ordered rows are cut into runs whose counts differ by one at most. No step needs a global sort:
a cell is dealt over SALTS sub-cells by the hash of doc_id and text, the sub-cells are counted, and
the sums of the counts before a sub-cell give its first rank.

Language and source are quantised by CRC-32, size by its power of two from 8 bytes (null text) to
256 KiB and more. Law `rows` comes first: equal texts lie in one cell, but in any of its sub-cells,
as a text that a third of all rows repeat can't stay in one shard.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import table

BITS = 4
SALTS = 1024


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place on the Hilbert curve of a point with coordinates below 2**bits (Skilling's transposed form)."""
    x, n, top = list(point), len(point), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, top
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | v >> b & 1
    return out


def curve_column(dims: list, bits: int = BITS):
    """Curve index of quantised columns: a look-up in a table of 2**(bits * len(dims)) entries."""
    n, side = len(dims), 1 << bits
    table = [hilbert_index(tuple(code >> bits * (n - 1 - i) & side - 1 for i in range(n)), bits) for code in range(side**n)]
    code = F.lit(0)
    for d in dims:
        code = code * side + d
    return F.element_at(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), (code + 1).cast("int"))


def category(col: str, side: int = 1 << BITS):
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(side)).cast("int"), F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve: one row for each input row.

    Law `rows`: shard counts are at most one apart; slot counts the rows of a shard from 0. size is
    the text's UTF-8 bytes (null: none) plus 8. Null language or source takes step 0 of its
    dimension; a null doc_id is a value like others; rows that tie in everything get slots in any
    order. An empty table gives no rows. Missing lang or source columns count as null.
    """
    have = set(docs.columns)
    lang, source = (F.col(c) if c in have else F.lit(None).cast("string") for c in ("lang", "source"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), source.alias("source"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = rows.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source")
    step = F.least(F.lit((1 << BITS) - 1), F.length(F.bin("size")) - 4).cast("int")  # size is 8 at least
    rows = rows.select("doc_id", "size", "text_crc32", curve_column([category("lang"), category("source"), step]).alias("curve"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SALTS)).cast("int").alias("salt"))
    sub = rows.groupBy("curve", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = sub.groupBy("curve").agg(F.sum("n").alias("cell"))  # at most 4096
    before = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("cell").over(before), F.lit(0)).alias("base"), F.sum("cell").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    inside = Window.partitionBy("curve").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sub = sub.select("curve", "salt", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("within")).join(cells, "curve")
    sub = sub.select("curve", "salt", (F.col("base") + F.col("within")).alias("first"), "total")
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("curve", "salt").orderBy("doc_id", "size", "text_crc32")) - 1)
    rank = ranked.join(sub, ["curve", "salt"]).withColumn("rank", F.col("first") + F.col("r"))
    rank = rank.withColumn("shard", F.expr(f"cast(rank * {shards} div total as int)"))
    return rank.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"rank - (shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def write_shards(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """Write docs as one folder for each shard, rows in slot order; doc_id must be unique."""
    out = docs.join(plan.select("doc_id", "shard", "slot"), "doc_id")
    out.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_ranges(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Smallest and largest value of each dimension in each shard: what a reader prunes files by."""
    facts = docs.select("doc_id", "lang", "source").join(plan, "doc_id")
    return facts.groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in ("lang", "source", "size") for n, f in (("min", F.min), ("max", F.max))), F.count(F.lit(1)).alias("rows"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))
