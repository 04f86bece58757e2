"""Line dedup against the definition: every run of MIN_BLOCK characters that any earlier document holds."""
import hashlib
import random

import numpy as np
import pytest

from strandset.llm import line_dedup
from test_small import frame, words

SF = "/root/testdata/sf0.01"


def common(a, sizes, b, least):
    """All equal runs of two lists, from each place where one begins as far as lines are equal."""
    where = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    gone = set()
    for i, x in enumerate(a):
        for j in where.get(x, ()):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(sizes[i : i + n]) >= least:
                gone |= set(range(i, i + n))
    return gone


def by_definition(docs, least=line_dedup.MIN_BLOCK):
    """(doc_id, text left, lines removed) with every earlier document looked at, and no hashing."""
    rows = [(d, (t or "").split("\n")) for d, t in docs]
    rows = [(d, lines, [x.strip(" ") for x in lines]) for d, lines in rows]
    sets = [set(s) for _, _, s in rows]
    out = []
    for k, (d, lines, mine) in enumerate(rows):
        gone = set()
        for m, (e, _, theirs) in enumerate(rows):
            if d is not None and e is not None and e < d and not sets[k].isdisjoint(sets[m]):
                gone |= common(mine, list(map(len, mine)), theirs, least)
        out.append((str(d), "\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone)))
    return sorted(out)


def test_every_common_run_goes():
    r = random.Random(8)
    size = {x: r.choice([0, 1, 5, 12, 25, 39, 40, 60]) for x in range(7)}
    for _ in range(3000):
        a, b = ([r.randrange(7) for _ in range(r.randrange(14))] for _ in range(2))
        sizes = [size[x] for x in a]
        assert line_dedup.common_lines(a, sizes, b) == sorted(common(a, sizes, b, line_dedup.MIN_BLOCK))


def test_windows_are_the_shortest():
    r = random.Random(9)
    for _ in range(500):
        sizes = [r.choice([0, 12, 20, 39, 40]) for _ in range(r.randrange(12))]
        every = [(i, j) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1) if sum(sizes[i:j]) >= 40]
        want = {min((w for w in every if w[0] == i), key=lambda w: w[1]) for i, _ in every} | {max((w for w in every if w[1] == j), key=lambda w: w[0]) for _, j in every}
        i, j = line_dedup.shortest_windows(np.array(sizes, np.int64))
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_hashes_of_equal_windows_are_equal():
    r = random.Random(3)
    a = np.array([r.randrange(-3, 3) for _ in range(300)], np.int64)
    i = np.repeat(np.arange(290), 4)
    j = i + np.tile([1, 2, 5, 9], 290)
    seen = {}
    for x, y, h in zip(i.tolist(), j.tolist(), line_dedup.window_hashes(a, i, j).tolist()):
        assert seen.setdefault(tuple(a[x:y].tolist()), h) == h
    assert len(set(seen.values())) == len(seen)


def test_rarest_windows_are_followed():
    # Lines 0-2 have a rare window and a common one; the common one is followed only for line 3.
    assert line_dedup.chosen_windows([(900, 1, 0, 2), (2, 7, 0, 3), (900, 1, 2, 4), (50, 5, 1, 3)], 5) == [1, 2]
    assert line_dedup.chosen_windows([], 3) == []


def test_passage_quoted_twice(spark):
    block = "\n".join(f"a line of the passage, number {i}, somewhat long" for i in range(3))
    docs = [(1, f"first\n{block}\nlast"), (2, f"own one\n{block}\nown two\n{block}\nown three")]
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, docs)).collect()}
    assert got == {1: docs[0][1], 2: "own one\nown two\nown three"}


def test_partners_that_hold_one_line_only(spark):
    """5 and 9 share a block of two lines whose first holders, 1 and 2, have one line of it each."""
    one, two = "a" * 30, "b" * 30
    verse = "\n".join(f"short line {i}" for i in range(30))
    docs = [(1, f"x\n{one}"), (2, f"{two}\ny"), (5, f"five\n{one}\n{two}\nfive"), (9, f"\n{one}\n{two}\n9"), (10, f"ten\n{verse}\n10"), (11, f"11\n{verse}\n\neleven"), (12, f"ten\n{verse}\n\nzz")]
    got = sorted((str(x.doc_id), x.text, x.n_removed) for x in line_dedup.line_dedup(frame(spark, docs)).collect())
    assert got == by_definition(docs) and dict((d, t) for d, t, _ in got)["9"] == "\n9"


def test_random_documents(spark):
    r = random.Random(12)
    pool = ["", "  ", "short", " x", *("line " + words(r, n) for n in (1, 2, 3, 4, 5, 6, 7, 8))]
    docs = [(r.choice([None, *range(40)]), "\n".join(r.choice(pool) for _ in range(r.randrange(1, 14)))) for _ in range(70)]
    docs += [(50, docs[0][1]), (51, docs[0][1]), (51, docs[0][1]), (52, None), (53, ""), (54, "")]
    got = line_dedup.line_dedup(frame(spark, docs)).collect()
    assert sorted((str(x.doc_id), x.text or "", x.n_removed) for x in got) == by_definition(docs)


def test_whole_table(spark):
    """All of sf0.01: no line that any earlier document shares stays, and no other goes."""
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = by_definition(docs)
    got = line_dedup.op5_line_dedup(spark, SF).collect()
    assert sum(x[2] for x in want) > 100
    assert sorted((str(x.doc_id), x.kept_sha256, x.n_removed) for x in got) == sorted((d, hashlib.sha256(t.encode()).hexdigest(), n) for d, t, n in want)
