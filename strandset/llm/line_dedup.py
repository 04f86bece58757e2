"""Line dedup by pairwise alignment.

What is deleted: every line of a document that lies in a run of lines of MIN_BLOCK characters or
more which an earlier document (a smaller doc_id) holds as well, blank lines and ends included.
Every line of such a run is in a shortest window of MIN_BLOCK characters that begins or ends with
it, and the run holds that window whole. So the steps are:

1. The hashes of these windows, at most two for each line, are counted over all distinct texts:
   their document frequency and their owner, the first document that holds them.
2. A document follows its windows from the rarest to the most common, and takes a window's owner
   as a partner if the window has a line that none of the rarer ones had. So documents meet through
   the rarest lines they share, a line leads to few partners, however many documents have it, and
   yet each line that an earlier document shares is in a window that some partner holds whole: no
   link is lost, and no line is too common to be followed.
3. A document is aligned with each partner by a patience diff on line hashes: lines that occur once
   in both (the rarest ones) anchor it, the longest increasing sequence of anchors is kept, and
   runs of equal lines grow from anchors, in the gaps between them again. Runs that the alignment
   leaves, as their lines repeat or are in another order, are then looked up in the partner.
4. Runs of MIN_BLOCK characters or more go from the later document, as often as it has them.

Equal texts are aligned once: a copy of an earlier document is wholly aligned with it. Lines that
no window shares with another text can't be aligned, and only marks stand for them, so a pair moves
the shared lines of its two documents. Only hashes, lengths and positions move between tasks; texts
meet the positions to delete once, at the end.
"""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import mix, table, written

MIN_BLOCK = 40  # characters of an aligned run of lines, without white space around each line
ROWS = 256  # pairs of a batch that are Python objects at a time


def _increasing(js: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, j in enumerate(js):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned runs of equal lines: (start in a, start in b, length), in order."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if nb[b[j]] == 1}
        found = [(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 and a[i] in where]
        anchors = [found[k] for k in _increasing([j for _, j in found])]
        if not anchors:
            continue
        # The part before an anchor ends with it and the part after begins with it, so runs grow both ways.
        i0, j0 = a0, b0
        for i, j in anchors:
            todo.append((i0, i + 1, j0, j + 1))
            i0, j0 = i + 1, j + 1
        todo.append((i0, a1, j0, b1))
    runs: list[list[int]] = []
    for i, j in sorted(matched):
        if runs and i == runs[-1][0] + runs[-1][2] and j == runs[-1][1] + runs[-1][2]:
            runs[-1][2] += 1
        else:
            runs.append([i, j, 1])
    return [tuple(r) for r in runs]


def _windows(sizes: list[int], lo: int, hi: int, min_block: int) -> set[tuple[int, int]]:
    """(first, end) in sizes[lo:hi]: of every line the shortest windows of min_block characters that begin and that end with it."""
    out, i, total = set(), lo, 0
    for j in range(lo, hi):
        total += sizes[j]
        while i < j and total - sizes[i] >= min_block:
            total -= sizes[i]
            i += 1
        if total >= min_block:
            out.add((i, j + 1))
    j, total = hi - 1, 0
    for i in range(hi - 1, lo - 1, -1):
        total += sizes[i]
        while j > i and total - sizes[j] >= min_block:
            total -= sizes[j]
            j -= 1
        if total >= min_block:
            out.add((i, j + 1))
    return out


_PRIME, _BASE = (1 << 61) - 1, 0x1E3779B97F4A7C15


def _prefixes(values: list[int]) -> tuple[list[int], list[int]]:
    sums, powers = [0], [1]
    for v in values:
        sums.append((sums[-1] * _BASE + v + 1) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    return sums, powers


def _stretches(known: list[bool]) -> list[tuple[int, int]]:
    edges = [i for i in range(len(known) + 1) if (i > 0 and known[i - 1]) != (i < len(known) and known[i])]
    return list(zip(edges[::2], edges[1::2]))


def repeated_lines(a: list[int], sizes: list[int], b: list[int], min_block: int = MIN_BLOCK) -> set[int]:
    """Positions in a of the lines in any run of at least min_block characters that b holds, wherever and however often.

    A line of such a run is in a shortest window that begins or ends with some line of the run, and
    the run holds that window whole; so it is enough to look windows up, by a rolling hash.
    """
    size_of = dict(zip(a, sizes))
    code = {x: k for k, x in enumerate(size_of)}
    in_b = set(b)
    sb, pb = _prefixes([code.get(x, -1) for x in b])
    theirs = set()
    b_sizes = [size_of.get(x, 0) for x in b]
    for lo, hi in _stretches([x in code for x in b]):
        theirs |= {(j - i, (sb[j] - sb[i] * pb[j - i]) % _PRIME) for i, j in _windows(b_sizes, lo, hi, min_block)}
    sa, pa_ = _prefixes([code[x] for x in a])
    change = [0] * (len(a) + 1)
    for lo, hi in _stretches([x in in_b for x in a]):
        for i, j in _windows(sizes, lo, hi, min_block):
            if (j - i, (sa[j] - sa[i] * pa_[j - i]) % _PRIME) in theirs:
                change[i] += 1
                change[j] -= 1
    depth, out = 0, set()
    for i in range(len(a)):
        depth += change[i]
        if depth:
            out.add(i)
    return out


def common_lines(a: list[int], sizes: list[int], b: list[int], min_block: int = MIN_BLOCK) -> list[int]:
    """Positions in a of the lines in runs of at least min_block characters that b holds: aligned runs, and all others that the alignment leaves."""
    gone = {i for s, _, n in align(a, b) if sum(sizes[s : s + n]) >= min_block for i in range(s, s + n)}
    return sorted(gone if len(gone) == len(a) else gone | repeated_lines(a, sizes, b, min_block))


_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shortest_windows(sizes: np.ndarray, min_block: int = MIN_BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the shortest windows of min_block characters that begin, and that end, with each line; each once."""
    n = len(sizes)
    total = np.r_[0, np.cumsum(sizes, dtype=np.int64)]
    first = np.arange(n)
    end = np.searchsorted(total, total[:-1] + max(1, min_block), "left")
    last = np.arange(1, n + 1)
    begin = np.searchsorted(total, total[1:] - max(1, min_block), "right") - 1
    code = np.unique(np.r_[(first * (n + 1) + end)[end <= n], (begin * (n + 1) + last)[begin >= 0]])
    return code // (n + 1), code % (n + 1)


def window_hashes(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[first:end] for each window."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values.astype(np.uint64)) * _powers(_ODD, n), out=total[1:])
    return mix((total[end] - total[first]) * _powers(_INVERSE, n + 1)[first] + (end - first).astype(np.uint64))


def _lists(column: pa.Array, dtype) -> list[np.ndarray]:
    """A list column as arrays, without Python objects for the values."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return [flat[a:z] for a, z in zip(ends, ends[1:])]


def _windows_of(texts: DataFrame, min_block: int) -> DataFrame:
    """first, row, i, j, key: the shortest windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = []
                for k, (h, n) in enumerate(zip(_lists(part.column("h"), np.int64), _lists(part.column("n"), np.int64))):
                    i, j = shortest_windows(n, min_block)
                    if len(i):
                        out.append((np.full(len(i), k), i, j, window_hashes(h, i, j)))
                if out:
                    which, i, j, key = (np.concatenate(x) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([part.column("first").take(pa.array(which)), part.column("row").take(pa.array(which)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(key.astype(np.int64))], ["first", "row", "i", "j", "key"])

    return texts.select("first", "row", "h", "n").mapInArrow(run, "first long, row long, i int, j int, key long")


def chosen_windows(windows: list[tuple[int, int, int, int]], n_lines: int) -> list[int]:
    """Indices of windows (frequency, owner's rank, first, end) to follow: the rarest first, if one has a line that those before had not."""
    covered = np.zeros(n_lines, bool)
    out = []
    for k in sorted(range(len(windows)), key=lambda k: windows[k]):
        _, _, i, j = windows[k]
        if not covered[i:j].all():
            covered[i:j] = True
            out.append(k)
    return out


def _parts(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """first, row, pos, h, n, partners: of each text the lines in shared windows, a mark (pos -1) where others lie between, and whom it follows."""
    partner = pa.list_(pa.struct([("o_first", pa.int64()), ("o_row", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = [[], [], [], []]
                mine = part.column("first").to_pylist()
                for k, (windows, h, n) in enumerate(zip(part.column("windows").to_pylist(), _lists(part.column("h"), np.int64), _lists(part.column("n"), np.int32))):
                    held = np.zeros(len(h) + 1, np.int32)
                    for w in windows:
                        held[w["i"]] += 1
                        held[w["j"]] -= 1
                    pos = np.flatnonzero(np.cumsum(held)[:-1] > 0)
                    gaps = np.flatnonzero(np.diff(pos) > 1) + 1
                    rows[0].append(np.insert(pos, gaps, -1))
                    rows[1].append(np.insert(h[pos], gaps, 0))
                    rows[2].append(np.insert(n[pos], gaps, 0))
                    earlier = [(w["df"], w["o_first"], w["i"], w["j"], w["o_row"]) for w in windows if w["o_first"] < mine[k]]
                    rows[3].append([{"o_first": o, "o_row": r} for o, r in sorted({(earlier[c][1], earlier[c][4]) for c in chosen_windows([e[:4] for e in earlier], len(h))})])
                yield pa.RecordBatch.from_arrays([part.column("first"), part.column("row"), pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.list_(pa.int64())), pa.array(rows[2], pa.list_(pa.int32())), pa.array(rows[3], partner)], ["first", "row", "pos", "h", "n", "partners"])

    by_text = shared.groupBy("first", "row").agg(F.collect_list(F.struct("df", "o_first", "o_row", "i", "j")).alias("windows"))
    both = by_text.join(texts.select("first", "row", "h", "n"), ["first", "row"])
    return both.mapInArrow(run, "first long, row long, pos array<int>, h array<long>, n array<int>, partners array<struct<o_first:long,o_row:long>>")


def _gone(pos: list[int], h: list[int], n: list[int], their_pos: list[int], theirs: list[int], min_block: int) -> list[int]:
    """Positions that an alignment of two documents' shared lines deletes; marks are equal to nothing."""
    a = [x if p >= 0 else ("a", k) for k, (p, x) in enumerate(zip(pos, h))]
    b = [x if p >= 0 else ("b", k) for k, (p, x) in enumerate(zip(their_pos, theirs))]
    return [pos[i] for i in common_lines(a, n, b, min_block)]


def _text(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _named(text) -> list:
    """row and row2, 128 bits that name a text."""
    return [F.xxhash64(text).alias("row"), F.xxhash64(F.lit(1), text).alias("row2")]


def deletions(docs: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """row, row2, first, gone: for texts that lose lines, the first document that has it and the positions of the lines it loses there.

    A later document with the same text loses all lines, if they have min_block characters.
    """
    lines = F.split(_text(), "\n")
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("_id"), *_named(_text()), F.transform(lines, lambda x: F.xxhash64(F.trim(x))).alias("h"), F.transform(lines, lambda x: F.length(F.trim(x))).alias("n"))
    texts = hashed.groupBy("row", "row2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.first("h").alias("h"), F.first("n").alias("n"))
    texts = written(texts)
    each = written(_windows_of(texts, min_block))
    owners = each.groupBy("key").agg(F.min(F.struct("first", "row")).alias("o"), F.count(F.lit(1)).alias("uses"), F.max("first").alias("max_first")).where("uses > 1 and max_first > o.first")
    shared = each.join(owners.select("key", F.col("uses").alias("df"), F.col("o.first").alias("o_first"), F.col("o.row").alias("o_row")), "key")
    parts = written(_parts(shared, texts))
    pairs = parts.select("first", "row", "pos", "h", "n", F.explode("partners").alias("o")).select("first", "row", "pos", "h", "n", "o.o_first", "o.o_row")
    both = pairs.join(parts.select(F.col("first").alias("o_first"), F.col("row").alias("o_row"), F.col("pos").alias("their_pos"), F.col("h").alias("theirs")), ["o_first", "o_row"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                gone = [_gone(*x, min_block) for x in zip(*(part.column(c).to_pylist() for c in ("pos", "h", "n", "their_pos", "theirs")))]
                yield pa.RecordBatch.from_arrays([part.column("first"), part.column("row"), pa.array(gone, pa.list_(pa.int32()))], ["first", "row", "gone"])

    found = both.select("first", "row", "pos", "h", "n", "their_pos", "theirs").mapInArrow(run, "first long, row long, gone array<int>").where(F.size("gone") > 0)
    found = found.groupBy("first", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))
    enough = F.aggregate("n", F.lit(0).cast("long"), lambda acc, x: acc + x) >= min_block
    out = texts.join(found, ["first", "row"], "left").select("row", "row2", "first", F.coalesce("gone", F.array().cast("array<int>")).alias("gone"), (F.lit(bool(min_block <= 0)) | enough).alias("enough"), "last")
    return out.where((F.size("gone") > 0) | (F.col("enough") & (F.col("last") > F.col("first")))).drop("last", "enough")


def line_dedup(docs: DataFrame, min_block: int = MIN_BLOCK) -> DataFrame:
    """docs' columns, text without the deleted lines, n_lines and n_removed; one row for each input row.

    Null texts stay null and have one empty line; empty texts likewise. Later means a larger
    doc_id: rows with equal doc_ids aren't compared with one another, rows with a null doc_id with
    none; these stay as they are. Repeated lines inside a document stay. A document that an earlier
    one holds whole is left with an empty text. Columns named text, n_lines or n_removed are
    replaced. Texts of any length are aligned whole.
    """
    gone = deletions(docs, min_block)
    rows = docs.select(F.when(F.col("doc_id").isNotNull(), F.col("doc_id").cast("long")).alias("_id"), *_named(_text()), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    rows = rows.join(gone, ["row", "row2"], "left")
    old = F.col("_doc.text").cast("string")
    lines = F.split(F.coalesce(old, F.lit("")), "\n")
    copy = F.coalesce(F.col("_id") > F.col("first"), F.lit(False))
    own = F.coalesce(F.when(F.col("_id") == F.col("first"), F.col("gone")), F.array().cast("array<int>"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), own)
    kept = F.when(F.size(own) == 0, old).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return rows.select(*((F.when(copy, F.lit("")).otherwise(kept)).alias(c) if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in names), F.size(lines).alias("n_lines"), F.when(copy, F.size(lines)).otherwise(F.size(own)).alias("n_removed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with earlier ones; those left with blank lines alone go.

    Rows that lose nothing stay as they are: null and empty texts, null doc_ids and repeated rows of
    one doc_id too. n_chars, if there is such a column, is the new length. Other columns are kept,
    and an empty table gives an empty one.
    """
    out = line_dedup(docs)
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim(F.translate("text", "\n\r\t", ""))) > 0)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
