"""Likelihood of the reads at a site given a bipartition, as column expressions on site counts.

A site's row has the weights of its symbols in each haplotype (a0..a4 and b0..b4). All sums over
haplotype symbols and over the root symbol are array functions of batches of sites, so scoring needs
one aggregation by site and one by group, and no join with the matrices.
"""
from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.functions.codes import LOG_FLOOR, N_SYMBOLS, SCALE

from .pileup import HET, READ_ERROR, by_site, scaled_matrix, without_bin

S = range(N_SYMBOLS)


def both_haplotypes(obs: DataFrame, first: Column, *keys: str) -> DataFrame:
    """Weights by symbol of reads in haplotype 1 (a0..a4) and 2 (b0..b4), by site."""
    w = lambda on, c: F.sum(F.when(on & (F.col("ch") == c), F.col("w")).otherwise(F.lit(0)).cast("long"))
    return without_bin(by_site(obs, *(keys or ("contig", "pos"))).agg(*(w(first, c).alias(f"a{c}") for c in S), *(w(~first, c).alias(f"b{c}") for c in S)), *keys)


WEIGHTS = [f"{hap}{k}" for hap in "ab" for k in S]


def vectorised(kind: str, f: Callable, once: bool = False) -> Callable[[Column], Column]:
    """f of the weights (n x 5) of both haplotypes and the reference symbol (5 where it is unknown), by batches of sites.

    once keeps the planner from copying it into each filter and column that uses it (not within aggregates).
    """

    def run(*columns: pa.Array) -> pa.Array:
        w = np.stack([c.to_numpy(zero_copy_only=False) for c in columns[:-1]], 1)
        return f(w[:, :N_SYMBOLS], w[:, N_SYMBOLS:], columns[-1].fill_null(N_SYMBOLS).to_numpy(zero_copy_only=False))

    udf = F.arrow_udf(run, kind)
    udf = udf.asNondeterministic() if once else udf
    return lambda ref: udf(*(F.col(c).cast("long") for c in WEIGHTS), ref.cast("int"))


def integer_cost(het: list[list[float]] = HET, error: list[list[float]] = READ_ERROR, ref: Column | None = None) -> Column:
    """Fixed-point cost of a site: minimum over root and haplotype symbols; lower is likelier."""
    h, e = np.array(scaled_matrix(het)), np.array(scaled_matrix(error))
    flat = math.floor(SCALE * math.log(N_SYMBOLS) / LOG_FLOOR + 0.5)
    prior = 255 * np.vstack([h, np.full((1, N_SYMBOLS), flat)])

    def cost(a: np.ndarray, b: np.ndarray, ref: np.ndarray) -> pa.Array:
        root = lambda w: ((w @ e.T)[:, None] + 255 * h).min(2)
        return pa.array((root(a) + root(b) + prior[ref]).min(1))

    return vectorised("long", cost)(F.col("ref_ch") if ref is None else ref)


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), lambda v: f(v)), 1)


def log_sum(terms: np.ndarray) -> np.ndarray:
    """ln of the sum of exponentials along the last axis."""
    top = terms.max(-1)
    return top + np.log(np.exp(terms - top[..., None]).sum(-1))


def haplotype_logs(weights: np.ndarray, error: list[list[float]] = READ_ERROR) -> np.ndarray:
    """ln P(reads of the haplotype | its symbol): n x 5."""
    out = np.zeros(weights.shape)
    for k in S:
        out += (weights[:, k] / 255.0)[:, None] * np.log(error)[:, k]
    return out


def prior_logs(het: list[list[float]] = HET) -> np.ndarray:
    """ln P(root symbol | reference symbol), and a flat row for an unknown reference."""
    return np.vstack([np.log(het), np.full((1, N_SYMBOLS), -math.log(N_SYMBOLS))])


def pair_logs(het: list[list[float]] = HET) -> np.ndarray:
    """ln P(symbols i and j of the haplotypes | reference), the root summed out: rows as prior_logs, columns i and j."""
    return np.log(np.einsum("pr,ri,rj->pij", np.exp(prior_logs(het)), het, het))


def pair_terms(la: np.ndarray, lb: np.ndarray, ref: np.ndarray, het: list[list[float]] = HET) -> np.ndarray:
    """ln P(reads, symbols i and j) for all pairs: n x 5 x 5."""
    return pair_logs(het)[ref] + la[:, :, None] + lb[:, None, :]


def exact_log(het: list[list[float]] = HET, error: list[list[float]] = READ_ERROR) -> Column:
    """ln P(reads at a site | bipartition), summed over root and haplotype symbols; reads columns a0..a4, b0..b4, ref_ch."""

    def log(a: np.ndarray, b: np.ndarray, ref: np.ndarray) -> pa.Array:
        return pa.array(log_sum(pair_terms(haplotype_logs(a, error), haplotype_logs(b, error), ref, het).reshape(len(ref), -1)))

    return vectorised("double", log)(F.col("ref_ch"))


def group_cost(sites: DataFrame, *keys: str) -> DataFrame:
    return sites.groupBy(*(keys or ("contig",))).agg(F.sum(integer_cost()).cast("long").alias("cost"), F.count(F.lit(1)).alias("n_sites"))
