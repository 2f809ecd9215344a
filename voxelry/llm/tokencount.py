"""Token counts of byte-level BPE by merging ragged arrays rank by rank.

A batch's pre-tokens that are not known yet lie one after another in one array of symbols, with the pre-token that
each belongs to. In each round every pre-token finds the lowest rank among its neighbouring pairs, and all its
pairs of that rank are merged at once; of pairs that overlap, the left one counts. Pre-tokens without a pair that
the vocabulary merges leave the arrays. What is left of a pre-token is its number of tokens. As each merge makes a
symbol that no other makes, merges made possible by one come later in rank, so merging all pairs of a rank at
once gives the same symbols as one pair at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts

#: A text with more tokens is over the limit.
LIMIT = 512
#: The most cached pre-tokens in a Python worker, and the bytes of new ones that are merged together.
CACHE, TOGETHER = 400_000, 1 << 20
#: For texts of ASCII only the vocabulary's own expression means the same as this faster one.
ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Bytes that print in Latin-1, apart from white space and the soft hyphen, stand for themselves; the others get the
    characters from 256 on, in order.
    """
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Merges:
    """The merges of a vocabulary as sorted pairs; a symbol is a byte, or 256 and the rank of the merge that makes it."""

    def __init__(self, merges: list[tuple[str, str]]) -> None:
        number = {s: b for b, s in enumerate(byte_symbols())}
        for rank, (a, b) in enumerate(merges):
            if number.setdefault(a + b, 256 + rank) != 256 + rank:
                raise ValueError("two merges make the same symbol")
        self.base = 256 + len(merges)
        pairs = np.array([number[a] * self.base + number[b] for a, b in merges], np.int64)
        self.none = len(merges)
        order = np.argsort(pairs)
        # One pair that is never met ends the table, so that every search lands in it.
        self.pairs, self.of = np.append(pairs[order], np.iinfo(np.int64).max), np.append(order, self.none)
        byte = np.arange(256)
        self.of_bytes = self.ranks(np.repeat(byte, 256), np.tile(byte, 256))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where there is no merge."""
        pair = left * self.base + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.of[at], self.none)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of symbols left of each word."""
        out = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero(out > 1)  # the words in the arrays
        sizes = out[live]
        symbols = np.frombuffer(b"".join([words[i] for i in live]), np.uint8).astype(np.int64)
        # The rank of each symbol and the one after it; a word's last symbol has none.
        rank = np.full(len(symbols), self.none)
        rank[:-1] = self.of_bytes[256 * symbols[:-1] + symbols[1:]]
        rank[np.cumsum(sizes) - 1] = self.none
        while True:
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes) if len(live) else rank
            on = least < self.none
            if not on.all():  # the others are done
                kept = np.repeat(on, sizes)
                symbols, rank, live, sizes, least = symbols[kept], rank[kept], live[on], sizes[on], least[on]
            if not len(live):
                return out
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of hits in a row, which overlap, each second one stays out. Hits never run on into another word.
            begins = np.flatnonzero(np.diff(at, prepend=-2) != 1)
            place = np.arange(len(at)) - np.repeat(begins, np.diff(begins, append=len(at)))
            at = at[place % 2 == 0]
            of = np.searchsorted(np.cumsum(sizes), at, "right")
            symbols[at] = 256 + rank[at]
            kept = np.ones(len(symbols), bool)
            kept[at + 1] = False
            symbols, rank = symbols[kept], rank[kept]
            sizes = sizes - np.bincount(of, minlength=len(live))
            out[live] = sizes
            # Pairs to look up again: of each merged symbol with the next, and of the one before with it.
            ends = np.cumsum(sizes) - 1
            at = at - np.arange(len(at))
            right = at[at != ends[of]]
            rank[at] = self.none
            left = at[at != ends[of] - sizes[of] + 1] - 1
            again = np.concatenate([right, left])
            rank[again] = self.ranks(symbols[again], symbols[again + 1])


class Counter:
    """Counts of whole texts, by way of cached counts of pre-tokens."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.merges = Merges([tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]])
        self.special = [t["content"] for t in model["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))))
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> list[str]:
        return (ASCII if text.isascii() else self.pattern).findall(text)

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > CACHE:  # common ones come early, so the early half stays
            self.known = dict(islice(self.known.items(), CACHE // 2))
        some, size = [], 0
        for w in sorted(w for w in words if w not in self.known):
            some.append(w)
            size += len(w)
            if size > TOGETHER:
                self._add(some)
                some, size = [], 0
        self._add(some)

    def _add(self, words: list[str]) -> None:
        self.known.update(zip(words, self.merges.counts([w.encode() for w in words]).tolist(), strict=True))

    def count(self, batch: list[str]) -> list[int]:
        parts, extra = [], []
        for text in batch:
            if any(s in text for s in self.special):
                pieces = self.cut.split(text)
                parts.append([w for p in pieces for w in self.pre_tokens(p)])
                extra.append(len(pieces) - 1)  # each special string is a token of its own
            else:
                parts.append(self.pre_tokens(text))
                extra.append(0)
        self._learn(set().union(*parts))
        known = self.known.__getitem__
        return [sum(map(known, p)) + e for p, e in zip(parts, extra, strict=True)]


@cache
def counter(path: str) -> Counter:
    """One for each Python worker, whose tasks share what it has learnt."""
    return Counter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of ``docs``, without a shuffle.

    Null and empty texts have no bytes and no tokens. Every row counts for itself, repeated or not; null ids are
    carried. An empty table gives an empty result; other columns are ignored. Long texts are counted whole, a batch
    of texts at a time.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "n_tokens"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path or vocabulary_path())
        for batch in batches:
            tokens = pa.array(known.count(texts(batch)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), tokens], names)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col).cast("bigint"), F.lit(0)).alias("n_bytes"))
    return rows.mapInArrow(counted, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
