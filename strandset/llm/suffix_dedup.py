"""Suffix-array dedup: remove every byte covered by a 50-byte string that an earlier document has.

No task can hold the suffix array of a corpus, so the windows of 50 bytes are dealt by content
first. The smallest hash of the K-byte strings in a window (its minimiser) depends on the window's
bytes alone, so equal windows have equal minimisers; neighbouring windows mostly share theirs, and
a run of windows with one minimiser is one short string. The steps:

1. For each group of documents, the minimisers that occur; those of one document only are dropped
   (counted over all groups, a pair of minimiser and group at a time, so one that a third of all
   documents share costs a row for each group, not for each document).
2. Each group sends the strings of its runs with shared minimisers, each distinct string once with
   the smallest and largest doc_id that has it in the group, to the task of their minimiser.
   The strings of a minimiser that over HOT documents have (those at the ends of a common passage
   differ in all of them) are cut into their windows, which are dealt by their own hashes, so no
   task has all strings of one minimiser.
3. There strings without a partner are set aside: strings that share a window share the 35 bytes
   that begin or that end with the minimiser's. The others get one suffix array by two-stage
   sorting: suffixes smaller than
   their successors are sorted directly (to 56 bytes), the others are induced by scanning the
   buckets of first bytes in order. Neighbours whose common prefix is 50 bytes or more hold one
   window; its smallest doc_id goes back to the groups.
4. Each group marks the windows with a smaller doc_id in its documents.

The steps are one plan; the documents are dealt to groups by one exchange that steps 2 and 4 use.
What moves between tasks is packed into compressed blobs, many documents or strings in each.
"""
from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import documents, partitions, table

LENGTH = 50
K = 20
BLOCK = 1 << 20  # bytes of text hashed at a time
SEGMENT = (1 << 16) - LENGTH  # windows whose minimisers are found at a time: their places have 16 bits
FLUSH = 1 << 20  # minimisers held before they are sent
SLICES = 16  # for each shuffle partition; the strings of one slice are solved together
SIDE = (LENGTH - K) // 2  # bytes before or after a minimiser that any window around it has
GROUP = 1000  # documents, on average
HOT = 5000  # documents; the windows around a minimiser that more of them have are dealt one by one
_B = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = 0xFF  # never a byte of UTF-8


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_B), n, 1 << 64))


def _rolling(b: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each place of b on, 16 <= n < 64."""
    h = {1: b.astype(np.uint64) + np.uint64(1)}
    for k in (1, 2, 4, 8, 16):
        if 2 * k <= n:
            h[2 * k] = h[k][:-k] * _power(k) + h[k][k:]
    out, have = None, 0
    for k in (32, 16, 8, 4, 2, 1):
        if k in h and have + k <= n:
            out = h[k] if out is None else out[: len(b) - have - k + 1] * _power(k) + h[k][have:]
            have += k
    return out


def _spread(h: np.ndarray) -> np.ndarray:
    """A bijection of 48-bit numbers: minimisers are small numbers, and these spread evenly over ranges."""
    mask = np.uint64((1 << 48) - 1)
    for odd in (np.uint64(0x5851F42D4C95), np.uint64(0x9E3779B97F4B)):
        h = (h * odd) & mask
        h ^= h >> np.uint64(25)
    return h


def _minimisers(b: np.ndarray) -> np.ndarray:
    """For each window of LENGTH bytes, the smallest hash (48 bits) of the K-byte strings in it, then the place (16 bits) of the leftmost such string.

    Places are compared within segments that overlap by a window, in which they have no more than
    16 bits; so the leftmost of equal hashes is taken wherever the window lies.
    """
    h = _rolling(b, K)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h &= np.uint64(0xFFFFFFFFFFFF0000)
    inside = LENGTH - K + 1
    n = len(h) - inside + 1
    out = np.empty(max(0, n), np.uint64)
    for lo in range(0, n, SEGMENT):
        part = h[lo : lo + SEGMENT + inside - 1]
        part = part | np.arange(len(part), dtype=np.uint64)
        for step in (1, 2, 4, 8, inside - 16):
            part = np.minimum(part[:-step], part[step:])
        place = ((part & np.uint64(0xFFFF)) + np.uint64(lo)) & np.uint64(0xFFFF)
        out[lo : lo + len(part)] = (part & np.uint64(0xFFFFFFFFFFFF0000)) | place
    return out


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(text's index, first window, windows, minimiser, its offset in the run) of all runs, for blocks of texts in turn."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BLOCK):
            size += len(texts[j])
            j += 1
        chosen = [k for k in range(i, j) if len(texts[k]) >= LENGTH]
        i = j
        if not chosen:
            continue
        ends = np.cumsum([len(texts[k]) for k in chosen])
        m = _minimisers(np.frombuffer(b"".join(texts[k] for k in chosen), np.uint8))
        first = np.r_[0, ends[:-1]]
        new = np.ones(len(m), bool)
        np.not_equal(m[1:], m[:-1], out=new[1:])
        new[first] = True
        over = ends[:-1] - (LENGTH - 1)  # windows from here on run into the next text
        new[over] = True
        start = np.flatnonzero(new)
        count = np.diff(np.r_[start, len(m)])
        owner = np.searchsorted(ends, start, "right")
        keep = start <= ends[owner] - LENGTH
        start, count, owner = start[keep], count[keep], owner[keep]
        value = m[start]
        yield np.array(chosen)[owner], start - first[owner], count, _spread(value >> np.uint64(16)), ((value - start.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.int64)


def _packed(*things) -> bytes:
    raw = pickle.dumps(things, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> tuple:
    return pickle.loads(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def two_stage_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order; those that agree in their first 56 bytes or more may stand in any order."""
    n = len(s)
    wide = np.r_[s, np.zeros(64, np.uint8)].astype(np.uint64)
    wide = (wide[:-1] << np.uint64(8)) | wide[1:]
    wide = (wide[:-2] << np.uint64(16)) | wide[2:]
    wide = (wide[:-4] << np.uint64(32)) | wide[4:]
    # A suffix is smaller than its successor if the first byte that differs from the next one is smaller.
    differs = np.flatnonzero(s[1:] != s[:-1])
    after = np.searchsorted(differs, np.arange(n))
    smaller = np.zeros(n, bool)
    has = after < len(differs)
    at = differs[after[has]]
    smaller[has] = s[at] < s[at + 1]
    # First stage: sort these directly, eight bytes at a time, and only what is still tied.
    order = np.flatnonzero(smaller)
    order = order[np.argsort(wide[order], kind="stable")]
    key = wide[order]
    tied = np.r_[False, key[1:] == key[:-1]]
    group = np.cumsum(~tied)
    for depth in range(8, 56, 8):
        again = tied.copy()
        again[:-1] |= tied[1:]
        where = np.flatnonzero(again)
        if not len(where):
            break
        word = wide[np.minimum(order[where] + depth, len(wide) - 1)]
        by = np.lexsort((word, group[where]))
        order[where], word = order[where][by], word[by]
        same = np.zeros(len(where), bool)
        same[1:] = (word[1:] == word[:-1]) & (group[where][1:] == group[where][:-1])
        tied = np.zeros(len(order), bool)
        tied[where] = same
        group = np.cumsum(~tied)
    # Second stage: a bucket holds the induced suffixes, then the sorted ones; scanning it fills larger buckets.
    bounds = np.searchsorted(s[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        waiting[s[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(level):
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[s[level] == c]
        bucket.append(order[bounds[c] : bounds[c + 1]])
        bucket = np.concatenate(bucket)
        waiting[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = s[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        cuts = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(byte) else []
        for a, z in zip(cuts, [*cuts[1:], len(byte)]):
            waiting[byte[a]].append(before[a:z])
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def first_holders(strings: list[bytes], holder: np.ndarray) -> list[np.ndarray]:
    """For each string and each of its windows, the smallest holder of a string with that window."""
    lengths = np.array([len(x) + 1 for x in strings])
    s = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(strings)), lengths)
    order = two_stage_order(s)
    order = order[ends[owner[order]] - 1 - order >= LENGTH]  # windows that end before the separator
    wide = np.r_[s, np.zeros(64, np.uint8)]
    same = np.ones(max(0, len(order) - 1), bool)  # common prefix of neighbours of LENGTH or more
    word = wide.astype(np.uint64)
    word = (word[:-1] << np.uint64(8)) | word[1:]
    word = (word[:-2] << np.uint64(16)) | word[2:]
    word = (word[:-4] << np.uint64(32)) | word[4:]
    for at in (0, 8, 16, 24, 32, 40, LENGTH - 8):
        w = word[order + at]
        same &= w[1:] == w[:-1]
    heads = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(holder[owner[order]], heads) if len(order) else np.zeros(0, np.int64)
    by_place = np.zeros(len(s), np.int64)
    by_place[order] = np.repeat(least, np.diff(np.r_[heads, len(order)]))
    return [by_place[e - n : e - LENGTH] for e, n in zip(ends, lengths)]


def _key(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little", signed=True)


def _texts(column) -> list[bytes]:
    return [x.encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _split(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of each 48-bit hash, by its upper bits."""
    return (h >> np.uint64(16)) * np.uint64(parts) >> np.uint64(32)


def _cuts(x: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]).tolist() if len(x) else []
    return list(zip(at, [*at[1:], len(x)]))


def _shared(rows: DataFrame, n_parts: int, hot: int) -> DataFrame:
    """grp, found, common: minimisers of the group that two documents or more have, anywhere, and whether more than `hot` have them.

    A minimiser is sent as its bucket and 32 more bits. Two that agree in these may be taken for
    one another, which only keeps a string longer than needed.
    """
    buckets = max(4096, 64 * n_parts)
    low = np.uint64(0xFFFFFFFF)

    def send(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        m, grp = (np.concatenate(x) for x in zip(*held))
        by = np.lexsort((grp, m))
        m, grp = m[by], grp[by]
        head = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (grp[1:] != grp[:-1])])
        more = np.diff(np.r_[head, len(m)]) > 1
        m, grp = m[head], grp[head]
        grp = grp.astype(np.min_scalar_type(int(grp.max())))
        bucket = _split(m, buckets)
        short = (m & low).astype(np.uint32)
        spans = _cuts(bucket)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in spans]].astype(np.int64)), pa.array([grp.dtype.itemsize] * len(spans), pa.int32()), *(pa.array([x[a:z].tobytes() for a, z in spans], pa.binary()) for x in (short, grp)), pa.array([np.packbits(more[a:z]).tobytes() for a, z in spans], pa.binary())], ["bucket", "wide", "m", "grp", "more"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids, grps = part.column("doc_id"), part.column("grp").to_numpy()
                for index, _, _, m, _ in runs([t if d.is_valid else b"" for d, t in zip(ids, _texts(part.column("text")))]):
                    by = np.lexsort((m, index))
                    index, m = index[by], m[by]
                    head = np.r_[True, (m[1:] != m[:-1]) | (index[1:] != index[:-1])]
                    held.append((m[head], grps[index[head]]))
                    size += len(held[-1][0])
                    if size >= FLUSH:
                        yield from send(held)
                        held, size = [], 0
        if held:
            yield from send(held)

    def several(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        m = np.concatenate([np.frombuffer(r[2], np.uint32).astype(np.uint64) | np.uint64(r[0] << 32) for r in rows])
        grp = np.concatenate([np.frombuffer(r[3], f"u{r[1]}").astype(np.int64) for r in rows])
        more = np.concatenate([np.unpackbits(np.frombuffer(r[4], np.uint8))[: len(r[2]) // 4] for r in rows])
        by = np.argsort(m, kind="stable")
        m, grp, more = m[by], grp[by], more[by]
        head = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        docs = np.add.reduceat(1 + more.astype(np.int64), head)
        size = np.diff(np.r_[head, len(m)])
        keep, common = np.repeat(docs > 1, size), np.repeat(docs > hot, size)
        m, grp, common = m[keep], grp[keep], common[keep]
        by = np.argsort(grp, kind="stable")
        m, grp, common = m[by], grp[by], common[by]
        if len(m):
            spans = _cuts(grp)
            yield pa.RecordBatch.from_arrays([pa.array(grp[[a for a, _ in spans]]), pa.array([m[a:z].tobytes() for a, z in spans], pa.binary()), pa.array([m[a:z][common[a:z]].tobytes() for a, z in spans], pa.binary())], ["grp", "found", "common"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:  # sorted by bucket: a new bucket may begin a new chunk
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if size >= 4 * FLUSH and row[0] != last:
                    yield from several(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2]) // 4
                last = row[0]
        if held:
            yield from several(held)

    sent = rows.mapInArrow(collect, "bucket long, wide int, m binary, grp binary, more binary")
    return sent.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "grp long, found binary, common binary")


def _known(m: np.ndarray, buckets: int) -> np.ndarray:
    """Minimisers as `_shared` names them."""
    return _split(m, buckets) << np.uint64(32) | m & np.uint64(0xFFFFFFFF)


def _among(values: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Places in m of what the sorted values hold."""
    return np.flatnonzero(values[np.minimum(np.searchsorted(values, m), len(values) - 1)] == m) if len(values) else np.zeros(0, np.int64)


def _group(blobs: pa.Table) -> tuple[list, list[bytes]]:
    """doc_ids and texts of a group's blobs."""
    ids, texts = [], []
    for blob in blobs.column("blob").to_pylist():
        i, t = _unpacked(blob)
        ids += i
        texts += t
    return ids, texts


def _dealt(rows: DataFrame, n_parts: int) -> DataFrame:
    """grp, blob: documents packed by group, and dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            by = np.argsort(grp, kind="stable")
            batch = batch.take(pa.array(by))
            grp, ids = grp[by], batch.column("doc_id").to_pylist()
            text, out = batch.column("text"), []
            for a, z in _cuts(grp):
                out.append((int(grp[a]), _packed(ids[a:z], _texts(text.slice(a, z - a)))))
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["grp", "blob"])

    return rows.mapInArrow(run, "grp long, blob binary").repartition(n_parts, "grp")


def _strings(dealt: DataFrame, shared: DataFrame, n_parts: int) -> DataFrame:
    """slice, grp, blob: distinct strings of runs with a shared minimiser, for each group."""
    buckets, slices = max(4096, 64 * n_parts), SLICES * n_parts

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["slice", "grp", "blob"]
        empty = pa.schema([("slice", pa.int64()), ("grp", pa.int64()), ("blob", pa.binary())]).empty_table()
        if not left.num_rows or not right.num_rows:
            return empty
        found = np.unique(np.frombuffer(b"".join(right.column("found").to_pylist()), np.uint64))
        common = np.unique(np.frombuffer(b"".join(right.column("common").to_pylist()), np.uint64))
        ids, texts = _group(left)
        seen: dict[bytes, list[int]] = {}
        for index, start, count, m, at in runs([t if d is not None else b"" for d, t in zip(ids, texts)]):
            hit = _among(found, _known(m, buckets))
            index, start, count, m, at = index[hit], start[hit], count[hit], m[hit], at[hit]
            single = np.zeros(len(m), np.int64)
            single[_among(common, _known(m, buckets))] = 1
            each = np.where(single == 1, count, 1)
            step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            index, m, single = (np.repeat(x, each) for x in (index, m, single))
            start, at, count = np.repeat(start, each) + step, np.repeat(at, each) - step, np.where(single == 1, 1, np.repeat(count, each))
            for i, a, n, h, p, c in zip(index.tolist(), start.tolist(), count.tolist(), m.tolist(), at.tolist(), single.tolist()):
                content, d = texts[i][a : a + n + LENGTH - 1], ids[i]
                known = seen.get(content)
                if known is None:
                    seen[content] = [h, p, d, d, c]
                elif d < known[2]:
                    known[2] = d
                elif d > known[3]:
                    known[3] = d
        if not seen:
            return empty
        m, p, low, high, single = (np.array(x) for x in zip(*seen.values()))
        m = m.astype(np.uint64)
        content = list(seen)
        where = _split(m, slices)
        for i in np.flatnonzero(single).tolist():
            where[i] = _key(content[i]) % slices
        by = np.lexsort((m, where))
        where = where[by]
        grp, out = left.column("grp")[0].as_py(), []
        for a, z in _cuts(where):
            k = by[a:z]
            mine = [content[i] for i in k.tolist()]
            out.append((int(where[a]), _packed(b"".join(mine), np.array(list(map(len, mine)), np.uint32), m[k], p[k].astype(np.uint16), low[k], high[k] - low[k], single[k].astype(bool))))
        return pa.Table.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([grp] * len(out), pa.int64()), pa.array([b for _, b in out], pa.binary())], names)

    return dealt.groupBy("grp").cogroup(shared.groupBy("grp")).applyInArrow(run, "slice long, grp long, blob binary")


def _partnered(strings: list[bytes], at: np.ndarray) -> np.ndarray:
    """Which strings may share a window with another one; `at` is where each string's minimiser begins."""
    lengths = np.array(list(map(len, strings)))
    offset = np.r_[0, np.cumsum(lengths)[:-1]]
    h = _rolling(np.frombuffer(b"".join(strings), np.uint8), K + SIDE)
    out = np.zeros(len(strings), bool)
    for shift in (0, -SIDE):
        has = np.flatnonzero((at + shift >= 0) & (at + shift + K + SIDE <= lengths))
        if len(has):
            _, code, n = np.unique(h[offset[has] + at[has] + shift], return_inverse=True, return_counts=True)
            out[has] |= n[code] > 1
    return out


def _marks(strings: DataFrame, n_parts: int) -> DataFrame:
    """grp, blob: for strings of the group, runs of windows with one smallest doc_id, below the group's largest somewhere."""

    def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        lowest: dict[bytes, int] = {}
        places: dict[bytes, int] = {}
        parts = []
        for grp, blob in rows:
            joined, sizes, m, p, low, extra, single = _unpacked(blob)
            ends = np.cumsum(sizes.astype(np.int64)).tolist()
            mine = [joined[a:z] for a, z in zip([0, *ends], ends)]
            for content, d, at in zip(mine, low.tolist(), p.tolist()):
                if d < lowest.get(content, d + 1):
                    lowest[content] = d
                    places[content] = at
            parts.append((grp, mine, m, low + extra, single))
        every = list(lowest)
        paired = [every[i] for i in np.flatnonzero(_partnered(every, np.array(list(places.values())))).tolist()]
        windows = dict(zip(paired, first_holders(paired, np.array([lowest[x] for x in paired], np.int64)))) if paired else {}
        out = []
        for grp, mine, m, high, single in parts:
            kept, keys, cuts, holders = [], [], [], []
            for i, (content, top) in enumerate(zip(mine, high.tolist())):
                w = windows.get(content)
                if w is None:
                    if lowest[content] < top:
                        kept.append(i)
                        keys.append(_key(content))
                        cuts.append([0])
                        holders.append([lowest[content]])
                elif (w < top).any():
                    head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
                    kept.append(i)
                    keys.append(_key(content))
                    cuts.append(head.tolist())
                    holders.append(w[head].tolist())
            if kept:
                out.append((grp, _packed(m[kept], single[kept], np.array(keys, np.int64), np.array(list(map(len, cuts)), np.uint32), np.array([x for c in cuts for x in c], np.uint32), np.array([x for c in holders for x in c], np.int64))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["grp", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, *row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and part != last:
                    yield from solve(held)
                    held = []
                held.append(tuple(row))
                last = part
        if held:
            yield from solve(held)

    return strings.repartition(n_parts, "slice").sortWithinPartitions("slice").mapInArrow(run, "grp long, blob binary")


def _covered(ids: list, texts: list[bytes], marks: pa.Table) -> list[list[tuple[int, int]]]:
    """Removed spans (from, to) of each text, maximal and in order."""
    spans: list[list[tuple[int, int]]] = [[] for _ in ids]
    found, common, by_key = [], [], {}
    for blob in marks.column("blob").to_pylist():
        m, single, keys, n, cuts, holders = _unpacked(blob)
        found.append(m)
        common.append(m[single])
        ends = np.cumsum(n.astype(np.int64)).tolist()
        cuts, holders = cuts.tolist(), holders.tolist()
        by_key.update((k, (cuts[a:z], holders[a:z])) for k, a, z in zip(keys.tolist(), [0, *ends], ends))
    if not by_key:
        return spans
    found, common = np.unique(np.concatenate(found)), np.unique(np.concatenate(common))
    for index, start, count, m, _ in runs([t if d is not None else b"" for d, t in zip(ids, texts)]):
        hit = _among(found, m)
        single = np.zeros(len(m), bool)
        single[_among(common, m)] = True
        for i, a, n, cut in zip(index[hit].tolist(), start[hit].tolist(), count[hit].tolist(), single[hit].tolist()):
            for at, size in ((a + w, 1) for w in range(n)) if cut else ((a, n),):
                mark = by_key.get(_key(texts[i][at : at + size + LENGTH - 1]))
                if mark is None:
                    continue
                cuts, holders = mark
                for lo, hi, holder in zip(cuts, [*cuts[1:], size], holders):
                    if holder < ids[i]:
                        lo, hi = at + lo, at + hi - 1 + LENGTH
                        if spans[i] and lo <= spans[i][-1][1]:
                            spans[i][-1] = (spans[i][-1][0], max(hi, spans[i][-1][1]))
                        else:
                            spans[i].append((lo, hi))
    return spans


def suffix_dedup(docs: DataFrame, group: int = GROUP, digest: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes), or kept_sha256 if digest.

    One row for each input row. A string is removed from a document if it also starts in one with
    a smaller doc_id; rows with equal doc_ids don't count for one another, and rows with a null
    doc_id for none: they stay whole. Null texts are empty ones. Texts below 50 bytes stay whole.
    A removal may cut a character, so kept is binary.
    """
    n_parts = partitions(docs.sparkSession)
    groups = max(1, -(-docs.count() // group))
    rows = documents(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("long").alias("grp"), "doc_id", "text")
    dealt = _dealt(rows, n_parts)
    marks = _marks(_strings(dealt, _shared(rows, n_parts, hot), n_parts), n_parts)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = _group(left)
        removed, kept, n = [], [], []
        for text, spans in zip(texts, _covered(ids, texts, right)):
            n.append(len(spans))
            removed.append(sum(z - a for a, z in spans))
            edges = [0, *(x for s in spans for x in s), len(text)]
            rest = b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2]))
            kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return dealt.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
