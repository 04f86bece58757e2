"""Byte-level BPE without a merge queue.

A piece of text is cut into tokens from left to right: the longest token that starts here is
tried first, then its prefixes that are tokens, and a token is taken if merging by rank would
never join bytes across its border with the token before. Whether two tokens can stand side by
side depends on these two alone and is remembered, and so is each position from which no
tokenisation goes on; so the work for a piece is linear in its length. The result is that of
merging by rank. pyahocorasick finds all tokens in a piece; as its keys are text, bytes are
mapped to the Latin-1 characters of the same codes.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._util import documents, table

PIECE_CACHE = 200_000  # distinct pieces a worker remembers, and as many of those used before them
PAIR_CACHE = 200_000  # pairs of tokens
LONG_PIECE = 256  # longer ones are not remembered


class ByteBPE:
    """Encoder and decoder for a table of byte strings and their ranks, which holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.rank = ranks
        self.bytes_of: dict[int, bytes] = {r: b for b, r in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.length = [0] * (max(self.bytes_of) + 1)
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.finder = ahocorasick.Automaton()
        for b, r in ranks.items():
            self.length[r] = len(b)
            if self.halves(r):
                self.finder.add_word(b.decode("latin-1"), r)
        self.finder.make_automaton()
        self.known = _Pieces(self)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as f:
            return cls({base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}, pattern)

    def halves(self, t: int) -> tuple[int, int] | None:
        """The last merge that makes token t; (t, t) for a byte; None if merging t's bytes doesn't end in t."""
        if t not in self.parts:
            b = self.bytes_of[t]
            if len(b) == 1:
                self.parts[t] = (t, t)
            else:
                row = [b[i : i + 1] for i in range(len(b))]
                while len(row) > 2:
                    best, at = min(((self.rank.get(x + y, 1 << 60), i) for i, (x, y) in enumerate(zip(row, row[1:]))))
                    if best == 1 << 60:
                        break
                    row[at : at + 2] = [row[at] + row[at + 1]]
                self.parts[t] = (self.rank[row[0]], self.rank[row[1]]) if len(row) == 2 else None
        return self.parts[t]

    def shorter(self, t: int) -> int:
        """The longest proper prefix of t that merging can make; -1 for a byte."""
        if t not in self.prefix:
            b = self.bytes_of[t]
            self.prefix[t] = next((r for n in range(len(b) - 1, 0, -1) if (r := self.rank.get(b[:n])) is not None and self.halves(r)), -1)
        return self.prefix[t]

    def side_by_side(self, left: int, right: int) -> bool:
        """Whether merging left's and right's bytes by rank leaves these two tokens."""
        key = (left, right)
        # Undo the latest merge on either side again and again; a pair that faces each other across
        # the border must not have a rank below that of the merge which consumed one of them.
        used, rank, of = 1 << 60, self.rank, self.bytes_of
        ok = True
        while True:
            joint = rank.get(of[left] + of[right])
            if joint is not None and joint < used:
                ok = False
                break
            can_left, can_right = len(of[left]) > 1, len(of[right]) > 1
            if can_left and (not can_right or left > right):
                used, left = left, self.halves(left)[1]
            elif can_right:
                used, right = right + 1, self.halves(right)[0]  # of equal ranks, the left pair merges first
            else:
                break
        self.fits[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.rank.get(piece)) is not None:
            return (whole,)
        n, length, fits = len(piece), self.length, self.fits
        longest = [-1] * (n + 1)
        for end, t in self.finder.iter(piece.decode("latin-1")):
            longest[end + 1 - length[t]] = t  # matches come by their ends: a later one is longer
        dead = bytearray(n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                to = at + length[t]
                if not dead[to]:
                    if not out:
                        break
                    ok = fits.get((out[-1], t))
                    if self.side_by_side(out[-1], t) if ok is None else ok:
                        break
                t = self.shorter(t)
            if t >= 0:
                out.append(t)
                at, t = to, longest[to]
            else:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if len(self.known) > PIECE_CACHE:
            self.known.age()
        if len(self.fits) > PAIR_CACHE:
            self.fits.clear()
        return list(chain.from_iterable(map(self.known.__getitem__, self.pattern.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Ids of pieces in two generations: what is used again moves to the young one, the old one is dropped in time."""

    def __init__(self, bpe: ByteBPE):
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= LONG_PIECE:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def loaded(file: str) -> ByteBPE:
    """The encoder for a file of the tokenizers package, once a worker."""
    import public_tokenizers

    return ByteBPE.from_file(public_tokenizers.path(file), public_tokenizers.PATTERN)


DEFAULT_FILE = "byte_bpe_multi_50k.tiktoken"


def encode(docs: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id and ids, the token ids of the whole text (null: no ids); one row for each input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                ids = pa.array([bpe.encode(t.as_py()) for t in part.column("text")], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id and decoded, the bytes of a column of ids (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([bpe.decode(x.as_py() or []) for x in part.column("ids")], pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def digests(docs: DataFrame, file: str = DEFAULT_FILE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of whole texts, encoded and decoded again.

    One row for each input row, in one pass without a shuffle. A null text is an empty one: no
    tokens, and both digests are those of nothing. Special tokens have no part; their strings are
    ordinary text. Null or repeated doc_ids are carried along.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file)
        names = [str(i) for i in range(max(bpe.bytes_of) + 1)]
        for batch in batches:
            n, ids_hex, decoded_hex = [], [], []
            for t in batch.column("text"):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                ids_hex.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded_hex.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and exact (whether the ids decode to the text's bytes) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(DEFAULT_FILE)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = part.column("text").to_pylist()
                ids = [bpe.encode(t) for t in texts]
                exact = [bpe.decode(x) == t.encode("utf-8", "surrogatepass") for x, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(exact)], ["doc_id", "n_tokens", "ids", "exact"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
