"""Near duplicates: a chosen-path join on five-word shingles at Jaccard similarity 0.8 or more.

Each of several independent runs splits the sets on MinHash tokens that no other run uses. In a run
a set goes to the node of the run's first token; a node of more than `bucket` sets is split again,
every set going to one child for each of two sampled tokens, and so on. Two sets of similarity J
agree on the first token with probability J and on one or the other of a further level's two with
1 - (1 - J)**2, so a pair is in a common leaf of one run with probability J * (1 - (1 - J)**2)**depth
(`survival`). Runs are repeated until a pair at the threshold has been in a common leaf with
probability `recall` at the depth that the deepest leaf has (`runs_needed`): 9 runs where no node is
split, 13 at the largest depth.

A node is split only if its children cost at most half as much to compare as itself. One of near
copies isn't: its children hold nearly all of it. Leaves of more than `bucket` sets are cut into
blocks, and pairs of blocks are compared by brute force in separate tasks, so no task holds an
unbounded group and no pair is left out. The work of such a leaf grows with the square of its size,
as the number of links of a group of near copies does.

Equal sets are one class member from the start: a representative stands for all its copies, which
are never expanded into pairs. Comparing is in two steps: the low bytes of all MinHash tokens name
the sets that have a likely partner in a leaf (a pair at the threshold has too few equal ones with
a probability of FILTER_MISS at most), and only these sets' shingles are brought to the leaf, where
pairs are verified exactly. A pair counts in the first of the leaves that both sets are in. Pairs
never become rows: a task returns a count of links for each set and edges of a spanning forest.

A document without words is like no other. Null texts are empty ones. Rows with a null doc_id are
returned with their own null class and no link. Rows that repeat a doc_id are separate members of
a class. Very long texts are shingled whole.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, mix, partitions, shingle_hashes, table, written

THRESHOLD = 0.8
RECALL = 1 - 1e-6  # probability that a pair at the threshold is in a common leaf
LEVELS = 4  # of splits below a run's first token
PER_RUN = 1 + 2 * LEVELS  # tokens
BUCKET = 500
BLOCK = 500
BLOCK_SHINGLES = 2_000_000  # of the sets of one block, on average
FILTER_MISS = 1e-9  # largest probability that a pair at the threshold has too few equal tokens to be verified


def survival(similarity: float, depth: int) -> float:
    """Probability that a pair is in a common leaf of one run, if `depth` levels of splits lead there."""
    return similarity * (1 - (1 - similarity) ** 2) ** depth


def runs_needed(threshold: float, depth: int, recall: float = RECALL) -> int:
    """Runs after which a pair at the threshold has been in a common leaf with probability `recall`."""
    return max(1, ceil(log(1 - recall) / log(1 - min(survival(threshold, depth), 1 - 1e-12)) - 1e-9))


def n_tokens(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    n = PER_RUN * runs_needed(threshold, LEVELS, recall)
    return n + n % 2


def filter_miss(similarity: float, least: int, n: int) -> float:
    """Probability that fewer than `least` of the n tokens of a pair are equal."""
    return sum(comb(n, i) * similarity**i * (1 - similarity) ** (n - i) for i in range(least))


@lru_cache(maxsize=64)
def least_equal(threshold: float, n: int) -> int:
    """Equal tokens of n from which a pair is verified: as many as FILTER_MISS allows."""
    return max(k for k in range(n + 1) if filter_miss(threshold, k, n) <= FILTER_MISS)


def tokens(shingles: np.ndarray, n: int) -> np.ndarray:
    """n MinHash tokens of a set, 32 bits each; zeros for an empty set. Each 64-bit hash gives two of them."""
    if not len(shingles):
        return np.zeros(n, np.uint32)
    seeds = mix(np.arange(1, n // 2 + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    high, low = (np.full(n // 2, np.uint64(0xFFFFFFFFFFFFFFFF)) for _ in range(2))
    for i in range(0, len(shingles), 2048):
        x = shingles[None, i : i + 2048] ^ seeds[:, None]
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        high = np.minimum(high, x.min(axis=1))
        x ^= x >> np.uint64(32)
        x <<= np.uint64(32)
        low = np.minimum(low, x.min(axis=1))
    return (np.stack([high, low], 1) >> np.uint64(32)).astype(np.uint32).reshape(-1)


def _name(shingles: np.ndarray) -> int:
    return int(mix(shingles).sum(dtype=np.uint64).astype(np.int64))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, row and row2 (128 bits that name the text)."""
    return documents(docs).select("doc_id", "text", F.xxhash64("text").alias("row"), F.xxhash64(F.lit(1), "text").alias("row2"))


def sketched(docs: DataFrame, n_of: int) -> DataFrame:
    """doc_id, row, row2, set_a, set_b (128-bit hash of the shingle set), n, tokens, sketch (their low bytes)."""
    names = ["doc_id", "row", "row2", "set_a", "set_b", "n", "tokens", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c, n, t = [], [], [], []
            for text in b.column("text"):
                s = shingle_hashes(text.as_py())
                n.append(len(s))
                a.append(_name(s))
                c.append(int(np.bitwise_xor.reduce(mix(s + np.uint64(77))).astype(np.int64)) if len(s) else 0)
                t.append(tokens(s, n_of))
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1, dtype=np.int32) * n_of), pa.array(np.concatenate([*t, np.zeros(0, np.uint32)]).view(np.int32)))
            low = pa.array([x.astype(np.uint8).tobytes() for x in t], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("row2"), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(n, pa.int32()), each, low], names)

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, row2 long, set_a long, set_b long, n int, tokens array<int>, sketch binary")


def _sized(rows: DataFrame) -> DataFrame:
    """rows (rep, run, node, n, ...) in nodes of two sets or more, with size and the sum of n as weight."""
    sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
    return rows.join(sizes, "node")


def grown(reps: DataFrame, first: int, last: int, bucket: int) -> tuple[DataFrame, int]:
    """Leaves (rep, node, size, weight) of the runs first to last - 1, and the depth of the deepest split."""
    cols = ["rep", "run", "n", "node", "size", "weight"]
    start = F.transform(F.sequence(F.lit(first), F.lit(last - 1)), lambda r: F.struct(r.alias("run"), F.xxhash64(r, F.get("tokens", r * PER_RUN)).alias("node")))
    here = written(_sized(written(reps.select("rep", "n", F.explode(start).alias("x")).select("rep", "n", "x.run", "x.node"))).select(*cols))
    leaves, depth = [here.where(F.col("size") <= bucket)], 0
    for level in range(1, LEVELS + 1):
        large = here.where(F.col("size") > bucket)
        if large.isEmpty():
            return _union(leaves), depth
        at = F.col("run") * PER_RUN + 2 * level - 1
        children = F.array(*(F.xxhash64("parent", F.lit(k), F.get("tokens", at + k)) for k in (0, 1)))
        below = large.withColumnRenamed("node", "parent").withColumnRenamed("size", "of").withColumnRenamed("weight", "w")
        below = below.join(reps.select("rep", "tokens"), "rep").withColumn("node", F.explode(children)).drop("tokens")
        below = written(_sized(written(below)))
        worth = below.groupBy("parent", "of").agg(F.sum(F.col("size").cast("double")).alias("cost")).where(F.col("cost") <= F.col("of").cast("double") * F.col("of") / 2).select("parent")
        every = large.select(F.col("node").alias("parent")).distinct()
        lost = every.join(below.select("parent").distinct(), "parent", "left_anti")  # no child has two sets
        split = written(worth.union(lost))
        leaves.append(large.join(split.withColumnRenamed("parent", "node"), "node", "left_anti").select(*cols))
        here = written(below.join(split, "parent").select(*cols))
        if split.isEmpty():
            return _union(leaves), depth
        depth = level
        leaves.append(here.where(F.col("size") <= bucket))
    leaves.append(here.where(F.col("size") > bucket))
    return _union(leaves), depth


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.select("rep", "node", "size", "weight")


def leaves(reps: DataFrame, threshold: float, recall: float, bucket: int) -> tuple[DataFrame, int, int]:
    """Leaves of all runs, the number of runs and the depth: runs are added until the depth that occurs needs no more."""
    done, depth, frames = 0, 0, []
    while done < (need := runs_needed(threshold, depth, recall)):
        more, deepest = grown(reps, done, need, bucket)
        frames.append(more)
        done, depth = need, max(depth, deepest)
    return written(_union(frames)), done, depth


def _tasks(rows: DataFrame, bucket: int, block: int) -> DataFrame:
    """rows (with rep, node, size, weight) in every pair of blocks that a set is part of: task, b (its block), lo, hi."""
    blocks = F.when((F.col("size") <= bucket) & (F.col("weight") <= 2 * BLOCK_SHINGLES), 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("size") / block), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int"))
    rows = rows.withColumn("g", blocks).withColumn("b", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    task = F.xxhash64("node", F.least("b", "o"), F.greatest("b", "o"))
    return rows.withColumn("task", task).withColumn("lo", F.least("b", "o")).withColumn("hi", F.greatest("b", "o")).drop("g", "o", "size", "weight")


def _met_before(held: list[list[int]], node: int) -> np.ndarray:
    """Which pairs of rows (by the leaves each is in) share a leaf that comes before this one."""
    n = len(held)
    owner = np.repeat(np.arange(n), list(map(len, held)))
    keys = np.fromiter((k for x in held for k in x), np.int64, len(owner))
    owner, keys = owner[keys < node], keys[keys < node]
    _, code, count = np.unique(keys, return_inverse=True, return_counts=True)
    owner, code = owner[count[code] > 1], code[count[code] > 1]
    met = np.zeros((n, n), bool)
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 1024):
        a, z = np.searchsorted(code, [lo, lo + 1024])
        m = np.zeros((n, min(1024, int(code[-1]) + 1 - lo)), np.float32)
        m[owner[a:z], code[a:z] - lo] = 1
        met |= (m @ m.T) > 0
    return met


def _by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one task after another; rows are sorted by task."""
    group: list[dict] = []
    for row in (row for batch in batches for i in range(0, batch.num_rows, 256) for row in batch.slice(i, 256).to_pylist()):
        if group and group[-1]["task"] != row["task"]:
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _likely(rows: list[dict], threshold: float = THRESHOLD) -> np.ndarray:
    """Pairs of a task's rows to verify: not met in an earlier leaf, of different blocks if there are two, alike by their sketches."""
    n = len(rows)
    s = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(n, -1)
    least = least_equal(threshold, s.shape[1])
    open_ = ~_met_before([r["held"] for r in rows], rows[0]["node"])
    open_ &= np.arange(n)[None, :] > np.arange(n)[:, None]
    if rows[0]["lo"] != rows[0]["hi"]:
        b = np.array([r["b"] for r in rows])
        open_ &= b[:, None] != b[None, :]
    out = []
    by_token = np.ascontiguousarray(s.T)
    for i in range(0, n, 64):
        some = open_[i : i + 64]
        many = np.count_nonzero(some)
        if many > max(2048, some.size // 16):
            same = np.zeros(some.shape, np.uint16 if s.shape[1] > 255 else np.uint8)
            for t in by_token:
                same += t[i : i + 64, None] == t[None, :]
            x, y = np.nonzero(some & (same >= least))
        elif many:
            x, y = np.nonzero(some)
            good = np.concatenate([(s[x[k : k + 4096] + i] == s[y[k : k + 4096]]).sum(1) >= least for k in range(0, len(x), 4096)])
            x, y = x[good], y[good]
        else:
            continue
        out.append(np.stack([x + i, y], 1))
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "task").sortWithinPartitions("task")


def classified(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, row, row2 (128 bits that name the text), head (the class's smallest doc_id, row and row2), n_links: one row for each input row.

    Rows that have no part (a null doc_id, no word) have a null head.
    """
    n_parts = partitions(docs.sparkSession)
    base = written(sketched(docs, n_tokens(threshold, recall)))
    known = base.where("doc_id is not null and n > 0")
    reps = known.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "row", "row2")).alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    reps = written(reps.withColumnRenamed("set_a", "rep"))  # a set's hash names it: a doc_id may repeat with other text
    ends, _, _ = leaves(reps, threshold, recall, bucket)
    held = ends.groupBy("rep").agg(F.collect_list("node").alias("held"))
    held = written(held.join(reps.select("rep", "sketch", "copies"), "rep"))
    cols = ["task", "node", "rep", "b", "lo", "hi"]
    likely_schema = pa.schema([("task", pa.int64()), ("node", pa.int64()), ("rep", pa.int64()), ("b", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            used = np.unique(_likely(rows, threshold))
            if len(used):
                yield pa.RecordBatch.from_pylist([{c: rows[i][c] for c in cols} for i in used], likely_schema)

    tasks = _tasks(ends.join(held, "rep"), bucket, block)
    wanted = written(_dealt(tasks.select(*cols, "sketch", "held"), n_parts).mapInArrow(likely, "task long, node long, rep long, b int, lo int, hi int"))
    texts = _keyed(docs).join(wanted.select("rep").distinct().join(reps, "rep").select("doc.*"), ["doc_id", "row", "row2"], "left_semi")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                sets = [shingle_hashes(t.as_py()) for t in b.slice(i, 500).column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([_name(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "shingles"])

    sets = written(texts.select("text").mapInArrow(shingled, "rep long, shingles binary").groupBy("rep").agg(F.first("shingles").alias("shingles")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_task(batches):
            pairs = _likely(rows, threshold)
            rep, copies = np.array([r["rep"] for r in rows]), np.array([r["copies"] for r in rows])
            good = _similar([np.frombuffer(r["shingles"], np.uint64) for r in rows], pairs, threshold)
            pairs = pairs[good]
            if not len(pairs):
                continue
            links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(rows)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(rows))
            root = _forest(pairs, len(rows), rep)
            used = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(rep[used]), pa.array(rep[root[used]]), pa.array(links[used].astype(np.int64))], ["rep", "root", "links"])

    ready = wanted.join(held, "rep").join(sets, "rep").select(*cols, "sketch", "held", "copies", "shingles")
    edges = written(_dealt(ready, n_parts).mapInArrow(verify, "rep long, root long, links long"))
    roots = components(edges.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = edges.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "set_b", "doc", "copies").join(links, "rep", "left").join(roots.select(F.col("a").alias("rep"), "root"), "rep", "left")
    named = written(named.select("rep", "set_b", "doc", F.coalesce("root", "rep").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = written(named.groupBy("root").agg(F.min("doc").alias("head")))
    named = written(named.join(heads, "root").select(F.col("rep").alias("set_a"), "set_b", "head", "n_links"))
    lonely = base.where("doc_id is null or n = 0").select("doc_id", "row", "row2", F.lit(None).cast(named.schema["head"].dataType).alias("head"), F.lit(0).cast("long").alias("n_links"))
    return known.select("doc_id", "row", "row2", "set_a", "set_b").join(named, ["set_a", "set_b"]).select("doc_id", "row", "row2", "head", "n_links").unionByName(lonely)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links: one row for each input row.

    class_id is the smallest doc_id of the connected class; n_links counts the other rows whose
    shingle sets are at least `threshold` similar, copies included.
    """
    return classified(docs, threshold, recall, bucket, block).select("doc_id", F.coalesce("head.doc_id", "doc_id").alias("class_id"), "n_links")


def _similar(sets: list[np.ndarray], pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs are at least `threshold` similar, by exact intersections of shingle sets."""
    if not len(pairs):
        return np.zeros(0, bool)
    size = np.array([len(s) for s in sets])
    if len(pairs) < 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs])
    else:
        # A dense product over the shingles that at least two of the sets hold, in strips of columns.
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), size)
        value, code, n = np.unique(every, return_inverse=True, return_counts=True)
        order = np.argsort(code, kind="stable")
        code, owner = code[order], owner[order]
        keep = n[code] > 1
        code, owner = np.cumsum(np.r_[False, np.diff(code[keep]) > 0]) if keep.any() else code[:0], owner[keep]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 2048):
            a, z = np.searchsorted(code, [lo, lo + 2048])
            m = np.zeros((len(sets), 2048), np.float32)
            m[owner[a:z], code[a:z] - lo] = 1
            total += m @ m.T
        common = total[pairs[:, 0], pairs[:, 1]].astype(np.int64)
    return common >= threshold * (size[pairs[:, 0]] + size[pairs[:, 1]] - common) - 1e-9


def _forest(pairs: np.ndarray, n: int, rep: np.ndarray) -> np.ndarray:
    """For each row the row with the smallest rep in its connected group."""
    root = np.arange(n)
    order = np.argsort(rep, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    label = rank.copy()
    a, b = pairs.T
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[order[new]]  # jump to the label's own label
        if (new == label).all():
            break
        label = new
    root = order[label]
    return root


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """a, root: for each node of edges (a, b) the smallest node of its connected component.

    Large-star and small-star steps in turn; every round writes its edges to the shared folder.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        linked = large.join(least, "a")
        small = linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = written(small)
        if new.count() == e.count() and new.join(e, ["a", "b"], "left_anti").isEmpty():
            e = new
            break
        e = new
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    return e.groupBy("a").agg(F.min("b").alias("root"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with the columns docs had.

    Rows are told apart by doc_id and text: of different texts with one doc_id only those of one
    class meet, and of equal rows one stays. Rows with a null doc_id and texts without a word, null
    and empty ones too, stay. An empty table gives an empty one.
    """
    key = ["_d", "_row", "_row2"]
    found = written(classified(docs).where("head is not null"))
    is_head = (F.col("head.doc_id") == F.col("doc_id")) & (F.col("head.row") == F.col("row")) & (F.col("head.row2") == F.col("row2"))
    named = found.select(F.col("doc_id").alias("_d"), F.col("row").alias("_row"), F.col("row2").alias("_row2"), is_head.alias("is_head"))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")).withColumn("_text", F.coalesce(F.col("_doc.text").cast("string"), F.lit("")))
    out = out.select("_doc", F.col("_doc.doc_id").cast("long").alias("_d"), F.xxhash64("_text").alias("_row"), F.xxhash64(F.lit(1), "_text").alias("_row2"))
    out = out.join(named.where("not is_head").select(*key).distinct(), key, "left_anti")
    repeated = written(named.where("is_head").groupBy(*key).count().where("count > 1").select(*key))
    if not repeated.isEmpty():
        one = out.join(repeated, key, "left_semi").groupBy(*key).agg(F.first("_doc").alias("_doc"))
        out = out.join(repeated, key, "left_anti").select("_doc").unionByName(one.select("_doc"))
    return out.select(*(F.col(f"_doc.`{c}`").alias(c) for c in docs.columns))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
