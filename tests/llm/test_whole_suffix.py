"""Suffix-array dedup: ties of minimisers, even slices, and a whole table against brute force."""
import hashlib
import random

from strandset.llm import suffix_dedup


def test_ties_of_minimisers_at_any_place():
    """A window that holds its smallest string twice has the leftmost one, wherever the window lies in a block."""
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        half = bytes(r.randrange(97, 123) for _ in range(22))
        window = (half + bytes(r.randrange(97, 123) for _ in range(3)) + half + b"tail of it")[:50]
        if len(set(x for x in suffix_dedup._minimisers(np.frombuffer(window, np.uint8)).tolist())) != 1:
            continue
        offset = int(suffix_dedup._minimisers(np.frombuffer(window, np.uint8))[0]) & 0xFFFF
        for at in (7, suffix_dedup.SEGMENT - 20, 65536 - 24, 65536 - 25, 65536 - 3, 2 * suffix_dedup.SEGMENT - 10):
            block = np.frombuffer(b"z" * at + window + b"z" * 60, np.uint8)
            assert (int(suffix_dedup._minimisers(block)[at]) - at) & 0xFFFF == offset


def test_match_at_a_boundary_of_places(spark):
    """Text 1 ends with a window that holds its smallest string twice, and text 2 begins with it where places begin again."""
    import numpy as np

    r = random.Random(20)
    found = 0
    while found < 5:
        half = bytes(r.randrange(97, 123) for _ in range(20))
        window = half + bytes(r.randrange(97, 123) for _ in range(10)) + half
        h = suffix_dedup._rolling(np.frombuffer(window, np.uint8), suffix_dedup.K)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        if int((h & np.uint64(0xFFFFFFFFFFFF0000)).argmin()):
            continue
        found += 1
        filler = "".join(r.choice("mnopq") for _ in range(65536 - 15 - 80))
        docs = [(1, "".join(r.choice("rstuv") for _ in range(30)) + window.decode()), (2, filler), (3, window.decode() + "".join(r.choice("wxyz") for _ in range(40)))]
        for order in (docs, [(1, filler), (2, docs[0][1]), (3, docs[2][1])]):
            got = suffix_dedup.suffix_dedup(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
            assert sorted((x.doc_id, x.n_removed) for x in got) == [(1, 0), (2, 0), (3, 50)]


def test_slices_are_even():
    """Minimisers are spread evenly: no slice has twice the mean of its neighbours."""
    import numpy as np
    import pyarrow.parquet as pq

    texts = [t.encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    m = np.unique(np.concatenate([x[3] for x in suffix_dedup.runs(texts)]))
    assert int(m.max()) < 1 << 48
    n = np.bincount(suffix_dedup._split(m, 128).astype(np.int64), minlength=128)
    assert n.max() < 1.5 * n.mean() and n.min() > 0.5 * n.mean()


def test_whole_table(spark):
    """All of sf0.01 against sorted windows: each byte of a 50-byte string that a smaller doc_id has, and no other."""
    import numpy as np

    docs = sorted(tuple(x) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    raw = [(t or "").encode() for _, t in docs]
    keys, owner = [], []
    for k, b in enumerate(raw):
        if len(b) >= 50:
            view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b, np.uint8), 50)
            w = np.ascontiguousarray(view).reshape(-1).view("S50")
            keys.append(w)
            owner.append(np.full(len(w), k))
    lengths = list(map(len, keys))
    holder = np.concatenate(owner)
    every = np.concatenate(keys)
    order = np.argsort(every, kind="stable")  # documents come in order of doc_id, so the first of equal strings has the smallest
    sorted_ = every[order]
    head = np.r_[True, sorted_[1:] != sorted_[:-1]]
    least = np.empty(len(every), np.int64)
    least[order] = holder[order][np.flatnonzero(head)][np.cumsum(head) - 1]
    ends = np.cumsum(lengths)
    want, at = [], 0
    for k, b in enumerate(raw):
        hit = np.zeros(len(b) + 1, np.int64)
        if len(b) >= 50:
            n = len(b) - 49
            marked = np.flatnonzero(least[at : at + n] < k)
            np.add.at(hit, marked, 1)
            np.add.at(hit, marked + 50, -1)
            at += n
        gone = np.cumsum(hit)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
        want.append((docs[k][0], len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert at == ends[-1]
    got = suffix_dedup.op3_suffix_dedup(spark, "/root/testdata/sf0.01").collect()
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == sorted(want)
