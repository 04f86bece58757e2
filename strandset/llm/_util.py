"""What several operators share: normalised input, written tables, word and shingle hashes."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.sources.shared import folder

def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    path = folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), and the named columns; whatever else a table has stays out of the plan."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.
WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
SHINGLE = 5

_B = 0x9E3779B97F4A7C15 | 1
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[[*range(48, 58), *range(97, 123)]] = True


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_B, -1, 1 << 64)
_POW, _INV = _powers(1 << 16, _B), _powers(1 << 16, _INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased UTF-8."""
    global _POW, _INV
    b = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = _LETTER[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    if len(b) > len(_POW):
        _POW, _INV = _powers(2 * len(b), _B), _powers(2 * len(b), _INVERSE)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POW[: len(b)], out=total[1:])
    start, end = edges[::2], edges[1::2]
    return mix((total[end] - total[start]) * _INV[start] + (end - start).astype(np.uint64))


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; of all its words if they are fewer; none without words."""
    w = word_hashes(text.lower().encode("utf-8", "surrogatepass"))
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + w[i : i + len(h)])
    return np.unique(h)
