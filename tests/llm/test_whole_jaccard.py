"""Near duplicates of groups larger than a bucket, pairs at the threshold, and pairs with few equal tokens: none is lost."""
import random

import numpy as np

from strandset.llm import jaccard_join
from test_small import brute_links, frame, words

SF = "/root/testdata/sf0.01"


def near_copies(n, seed=5, edits=2, start=0):
    """n documents, every two of them about 0.81 similar."""
    r = random.Random(seed)
    base = words(r, 200, 100_000).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in range(edits):
            w[5 + (k * n + i) * 190 // (edits * n)] = f"edit{seed}x{i}"
        out.append((start + i, " ".join(w)))
    return out


def found(got):
    return sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in got.collect())


def test_large_node_loses_no_pair(spark):
    docs = near_copies(60)
    want = brute_links(docs)
    assert sum(x[2] for x in want) > 3000
    assert found(jaccard_join.near_duplicates(frame(spark, docs), bucket=6, block=8)) == want


def test_recall_at_the_threshold(spark):
    """Over 1,000 pairs with similarities of 0.8 to 0.9, in groups that share tokens with one another so that nodes are split."""
    from strandset.llm._util import shingle_hashes

    r = random.Random(2)
    common = words(r, 150, 90_000)
    docs = []
    for g in range(40):
        docs += [(d, common + " " + t) for d, t in near_copies(9, seed=100 + g, edits=3, start=9 * g)]
    sets = [set(shingle_hashes(t).tolist()) for _, t in docs]
    near = sum(0.8 <= len(a & b) / len(a | b) <= 0.9 for i, a in enumerate(sets) for b in sets[:i])
    assert near >= 1000
    reps = jaccard_join.sketched(frame(spark, docs), jaccard_join.n_tokens()).selectExpr("set_a rep", "n", "tokens")
    _, runs, depth = jaccard_join.leaves(reps, 0.8, jaccard_join.RECALL, 30)
    assert depth > 0 and runs == jaccard_join.runs_needed(0.8, depth) > jaccard_join.runs_needed(0.8, 0)
    assert found(jaccard_join.near_duplicates(frame(spark, docs), bucket=30, block=20)) == brute_links(docs)


def test_runs_meet_the_recall():
    for depth in range(jaccard_join.LEVELS + 1):
        runs = jaccard_join.runs_needed(0.8, depth)
        assert (1 - jaccard_join.survival(0.8, depth)) ** runs <= 1 - jaccard_join.RECALL + 1e-12
        assert runs * jaccard_join.PER_RUN <= jaccard_join.n_tokens()
    assert jaccard_join.runs_needed(0.8, 0) == 9 and jaccard_join.runs_needed(0.8, jaccard_join.LEVELS) == 13
    assert abs(jaccard_join.survival(0.8, 2) - 0.8 * 0.96**2) < 1e-12


def test_tokens_agree_as_often_as_sets_are_similar():
    from strandset.llm._util import mix

    a = mix(np.arange(1, 1001, dtype=np.uint64))
    b = mix(np.arange(112, 1112, dtype=np.uint64))  # 889 of 1111 in common: 0.8
    same = (jaccard_join.tokens(a, 4000) == jaccard_join.tokens(b, 4000)).reshape(-1, 2)
    assert abs(same.mean() - 0.8) < 0.03
    assert abs((same[:, 0] & same[:, 1]).mean() - 0.64) < 0.04  # the two of one hash are independent


def test_filter_passes_pairs_with_few_equal_tokens():
    n = jaccard_join.n_tokens()
    least = jaccard_join.least_equal(0.8, n)
    t = np.arange(n, dtype=np.uint8)
    for equal, hit in ((least, [[0, 1]]), (least - 1, [])):
        other = np.r_[t[:equal], t[equal:] + 128].astype(np.uint8)
        rows = [{"sketch": x.tobytes(), "held": [5], "node": 5, "b": 0, "lo": 0, "hi": 0} for x in (t, other)]
        assert jaccard_join._likely(rows).tolist() == hit


def test_filter_misses_less_than_the_runs():
    n = jaccard_join.n_tokens()
    least = jaccard_join.least_equal(0.8, n)
    assert jaccard_join.filter_miss(0.8, least, n) <= 1e-9 < jaccard_join.filter_miss(0.8, least + 1, n)


def test_pairs_count_in_their_first_leaf():
    held = [[1, 4, 9], [4, 9], [2, 9], [9]]
    met = jaccard_join._met_before(held, 9)
    assert met[0, 1] and met[1, 0] and not met[0, 2] and not met[2, 3] and not jaccard_join._met_before(held, 4)[0, 1]
    r = random.Random(1)
    held = [sorted(r.sample(range(3000), 400)) for _ in range(20)]
    met = jaccard_join._met_before(held, 1500)
    assert all(met[i, j] == bool({k for k in held[i] if k < 1500} & set(held[j])) for i in range(20) for j in range(20) if i != j)


def test_whole_table(spark):
    """All of sf0.01 against all pairs that share a shingle."""
    docs = [tuple(x) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(jaccard_join.op9_jaccard_join(spark, SF)) == brute_links(docs)


def test_stage_tells_rows_of_one_id_apart(spark):
    r = random.Random(4)
    one, two, three = (words(r, 60) for _ in range(3))
    docs = [(1, one), (2, one), (2, two), (3, three), (3, three), (4, ""), (4, ""), (None, one), (5, None)]
    got = jaccard_join.stage(spark, frame(spark, docs), "")
    assert got.columns == frame(spark, docs).columns
    assert sorted((str(x.doc_id), str(x.text)) for x in got.collect()) == sorted((str(d), str(t)) for d, t in [(1, one), (2, two), (3, three), (4, ""), (4, ""), (None, one), (5, None)])
