"""Benchmark decontamination: short test items inside long documents, by MinHash containment search.

The containment of an item in a document is the share of the item's distinct five-word shingles
that the document has. Items are partitioned by the size of their shingle sets, in powers of two.
Within the partition of sizes up to u, an item's sketch is its floor((1 - t) * u) + 1 smallest
hashes, at most all: a document that contains t of the item lacks fewer shingles than the sketch
has, so it must share a hash with the sketch. One pass over the documents' shingle hashes against
the sketches therefore finds every pair at or above t, and pairs found are verified by exact
shingle containment (on the shingles' words, not their hashes). An item of fewer than five
words is one shingle of all its words, looked for among the documents' shingles of that length.

Only DataFrame functions are used. Benchmarks are of bounded size, but the sketches are sent to
all executors only if they are counted to be at most BROADCAST_ROWS; beyond it they are joined by
a shuffle. The same goes for the documents found, of whose texts alone the verification is made: up
to BROADCAST_ROWS of them the corpus isn't shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import SHINGLE, documents, table, written

THRESHOLD = 0.8
BROADCAST_ROWS = 200_000
_SPLIT = "[^0-9a-z\\x{80}-\\x{10FFFF}]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters, digits and non-ASCII characters of the lower-cased text."""
    return F.filter(F.split(F.lower(text), _SPLIT), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    """Shingles of k words, as text; none if there are fewer words."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (k - 1)))
    return F.when(F.size(w) >= k, F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))).otherwise(F.array().cast("array<string>"))


def _items(benchmark: DataFrame, t: float) -> DataFrame:
    """item_id, shingles (distinct, as text), k (words of a shingle), n, sketch; items without words have no row."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))
    grams = F.when(F.size("w") >= SHINGLE, F.array_distinct(_grams(F.col("w"), SHINGLE))).otherwise(F.array(F.array_join("w", " ")))
    items = items.select("item_id", "k", grams.alias("shingles")).withColumn("n", F.size("shingles"))
    hashes = F.array_sort(F.transform("shingles", lambda s: _hash_of_length(F.split(s, " "))))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))  # the largest size in the item's partition
    length = F.least(F.col("n"), (F.floor((1 - t) * upper + 1e-9) + 1).cast("int"))
    return items.withColumn("sketch", F.slice(hashes, F.lit(1), length))


def _join_hash(w: Column, i: Column, k: int = SHINGLE) -> Column:
    """Hash of the k words from word i on, counted from 1."""
    return F.xxhash64(*(F.element_at(w, (i + j).cast("int")) for j in range(k)))


def _hash_of_length(w: Column) -> Column:
    """Hash of all the words of a shingle."""
    out = _join_hash(w, F.lit(1))
    for k in range(1, SHINGLE):
        out = F.when(F.size(w) == k, F.xxhash64(*(F.get(w, F.lit(j)) for j in range(k)))).otherwise(out)
    return out


def _found(texts: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame | None:
    """key, item_id, n_shingles, n_common, containment of pairs at or above the threshold, from texts (key, text)."""
    items = written(_items(benchmark, threshold).where("item_id is not null"))
    sketches = items.select("item_id", F.explode("sketch").alias("h")).distinct()
    if (rows := sketches.count()) == 0:
        return None
    small = rows <= BROADCAST_ROWS
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # at most SHINGLE values
    # Generate, hash and probe run in one stage of generated code: no row for a shingle leaves it.
    split = texts.select("key", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    probes = []
    for k in lengths:
        each = split.where(F.size("w") >= k).select("key", "w", F.explode(F.sequence(F.lit(1), F.size("w") - (k - 1))).alias("i"))
        probes.append(each.select("key", _join_hash(F.col("w"), F.col("i"), k).alias("h")).join(F.broadcast(sketches) if small else sketches, "h"))
    hits = probes[0]
    for more in probes[1:]:
        hits = hits.unionByName(more)
    pairs = written(hits.select("key", "item_id").distinct())
    wanted = pairs.join(items.select("item_id", "shingles", "n"), "item_id")
    # All of a document's candidates meet its text once.
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct("item_id", "n", "shingles")).alias("items"))
    keys = pairs.select("key").distinct()
    few = texts.join(F.broadcast(keys), "key", "left_semi") if keys.count() <= BROADCAST_ROWS else texts
    both = wanted.join(few, "key").select("key", "items", words(F.col("text")).alias("w"))
    both = both.select("key", "items", F.array_distinct(F.concat(*(_grams(F.col("w"), k) for k in lengths))).alias("grams"))
    counted = both.select("key", F.explode(F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), x["n"].alias("n_shingles"), F.size(F.array_intersect(x["shingles"], F.col("grams"))).alias("n_common")))).alias("x"))
    out = counted.select("key", "x.*").withColumn("containment", F.round(F.col("n_common") / F.col("n_shingles"), 6))
    return out.where(F.col("n_common") >= threshold * F.col("n_shingles") - 1e-9)


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_shingles, n_common, containment for each pair at or above the threshold.

    Null and empty texts contain nothing, and items without words are in no pair. Rows with
    a null doc_id or item_id are in no pair. Rows of one doc_id, or of one item_id, count as one
    set of shingles each if they repeat, and pair by pair if they differ: the largest
    containment is returned. Very long documents are searched whole.
    """
    texts = documents(docs).where("doc_id is not null").select(F.col("doc_id").alias("key"), "text")
    out = _found(texts, benchmark, threshold)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_shingles int, n_common int, containment double")
    best = F.max(F.struct("containment", "n_shingles", "n_common")).alias("b")
    return out.groupBy("key", "item_id").agg(best).select(F.col("key").alias("doc_id"), "item_id", "b.n_shingles", "b.n_common", "b.containment")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they had.

    Whether a document goes depends on its text alone: rows that repeat, or that share a doc_id with
    other texts, are judged each by its own, rows with a null doc_id too. Null and empty texts stay.
    An empty table, or a benchmark without items, changes nothing.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))  # 128 bits name a text
    out = _found(docs.select(key.alias("key"), text.alias("text")), table(spark, sf_dir, "benchmark"), THRESHOLD)
    if out is None:
        return docs
    dirty = written(out.select("key").distinct())
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), key.alias("key"))
    rows = rows.join(F.broadcast(dirty) if dirty.count() <= BROADCAST_ROWS else dirty, "key", "left_anti")
    return rows.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    def split(name: str, key: str) -> str:
        return f"""SELECT {key}, w, least({SHINGLE}, len(w)) AS k FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '{_SPLIT}'), lambda x: x <> '') AS w FROM {name} WHERE {key} IS NOT NULL AND text IS NOT NULL) WHERE len(w) > 0"""

    return f"""
    WITH bw AS ({split("benchmark", "item_id")}), dw AS ({split("documents", "doc_id")}),
    b AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
    d AS (SELECT DISTINCT doc_id, n AS k, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT k AS n FROM b) WHERE len(w) >= n)),
    n AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1),
    c AS (SELECT doc_id, item_id, count(*) AS c FROM d JOIN b USING (k, g) GROUP BY 1, 2)
    SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(c AS INTEGER) AS n_common, round(c / n, 6) AS containment FROM c JOIN n USING (item_id) WHERE c >= {THRESHOLD} * n - 1e-9
    """
