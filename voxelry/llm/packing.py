"""Packing documents into windows of tokens by Karmarkar-Karp multiway differencing.

Every task tokenizes its rows and packs them in chunks: no shuffle, and no more than a chunk is held.
Documents longer than a window give full windows first. The remaining pieces of a chunk start as partial
partitions of k windows with one piece each; the two with the largest differences are merged again and
again, the fullest windows of one with the emptiest of the other, until one partition is left. Its
windows are nearly equal; if one exceeds the capacity, k rises and the differencing starts anew. So that
k windows are full, the tokens beyond the last multiple of a window, and some for each window, are cut
off the longest pieces beforehand. They fill what differencing left open; the rest become sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count, islice
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts

if TYPE_CHECKING:
    from tokenizers import Tokenizer

WINDOW, END_ID = 4096, 2
#: Pieces that are packed together, and the most cached spellings in a Python worker.
CHUNK, CACHE = 512, 400_000
#: The share of a window that differencing leaves open, to be filled with cut-off tokens.
OPEN = 1 / 32
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_TASK_BITS = 36
#: Characters that, after a letter, begin a word of their own; the apostrophe is not one of them.
MARKS = b".,!?;:#%*|()[]{}\"/"
#: Words that are spelled at once.
JOINED = 64
#: Words that the tokenizer's normalizer leaves alone and its pattern takes whole: letters of ASCII and Latin-1 in lower case.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Spellings:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes, by way of cached spellings.

    The tokenizer drops white space, never joins text across it and lower-cases, so a text's ids are
    those of its parts between ASCII white space, lower-cased in ASCII. Marks after a letter are words of
    their own, and each word ends in one of the vocabulary's end pieces, so words made of letters are
    spelled many at a time; plain ones need the tokenizer's merges only, not its normalizer and patterns.
    Texts that hold a special token's string are given to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core of its own, threads only share it
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _joined(self, tokenizer: Tokenizer, words: list[bytes]) -> list[bytes]:
        """Spells words made of letters, some in one text. Returns those of texts whose pieces do not tell the words apart."""
        rest = []
        some = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for part, found in zip(some, tokenizer.encode_batch_fast([b" ".join(x).decode() for x in some], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                self.known.update((x, raw[a:b]) for x, a, b in zip(part, [0, *cuts], cuts, strict=False))
            else:
                rest += part
        return rest

    def _spell(self, parts: Iterable[bytes]) -> None:
        plain, words, rest = [], [], []
        for x in parts:
            text = x.decode()
            (plain if PLAIN(text) else words if text.isalpha() else rest).append(x)
        rest += self._joined(self.merges, plain) + self._joined(self.tokenizer, words)
        found = self.tokenizer.encode_batch_fast([x.decode() for x in rest], add_special_tokens=False)
        self.known.update((x, np.array(e.ids, "<u4").tobytes()) for x, e in zip(rest, found, strict=True))

    def _learn(self, parts: set[bytes]) -> None:
        known = self.known
        if len(known) > CACHE:  # common spellings come early, so the early half stays
            self.known = known = dict(islice(known.items(), CACHE // 2))
        new, marked = set(), []
        for x in parts.difference(known):
            word = x.rstrip(MARKS)
            if len(word) < len(x) and word[-1:].isalpha():
                marked.append((x, word, x[len(word) :]))
                new.update(marked[-1][1:])
            else:
                new.add(x)
        self._spell(new.difference(known))
        for x, word, marks in marked:
            known[x] = known[word] + known[marks]

    def encode(self, batch: list[str]) -> list[bytes]:
        whole, parts = {}, []
        for i, text in enumerate(batch):
            raw = text.encode()
            if any(x in raw for x in self.special):
                whole[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                parts.append([])
            else:
                parts.append(raw.lower().split())
        self._learn(set().union(*parts))
        spelled = self.known.__getitem__
        return [whole.get(i) or b"".join(map(spelled, p)) for i, p in enumerate(parts)]


@cache
def spellings(path: str) -> Spellings:
    """One for each Python worker, whose tasks share what it has learnt."""
    return Spellings(path)


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway Karmarkar-Karp: positions of ``sizes`` in each of k sets of nearly equal sums.

    Each partial partition holds its sums in falling order. Ties are broken by age, so reruns agree.
    """
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    left, right = list(range(len(sizes))), [-1] * len(sizes)  # a set is a leaf or joins two sets
    age = count()
    heap = []
    for i, n in enumerate(sizes):
        sums, sets = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], sets[0] = n, i
        heap.append((-n, next(age), sums, sets))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        sets = np.where(x < 0, y, x)
        both = np.flatnonzero((x >= 0) & (y >= 0))
        if len(both):
            sets[both] = np.arange(len(left), len(left) + len(both))
            left.extend(x[both].tolist())
            right.extend(y[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), next(age), sums, sets))
    out = []
    for root in heap[0][3].tolist():
        members, todo = [], [root] if root >= 0 else []
        while todo:
            node = todo.pop()
            if right[node] < 0:
                members.append(left[node])
            else:
                todo += [left[node], right[node]]
        out.append(sorted(members))
    return out


def windows(sizes: list[int], capacity: int, k: int = 1) -> list[list[int]]:
    """Sets of at most ``capacity`` in all, ``k`` or as many more as differencing needs. No size may exceed it."""
    k = max(k, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in x) <= capacity for x in found):
            return [x for x in found if x]
        k += 1


class _Packer:
    def __init__(self, window: int, chunk: int, first: int) -> None:
        self.window, self.chunk, self.next = window, chunk, first
        self.pieces: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.rows: list[tuple] = []

    def _sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, self.next, offset))
            offset += len(ids) // 4
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, full = len(ids) // 4, 4 * self.window
        for at in range(0, len(ids) - full + 1, full):
            self._sequence([(doc_id, at // 4, ids[at : at + full], n)])
        if rest := len(ids) % full:
            self.pieces.append((doc_id, (len(ids) - rest) // 4, ids[-rest:], n))
        if len(self.pieces) >= 2 * self.chunk:
            self.flush(self.chunk)

    def flush(self, n: int | None = None) -> None:
        some, self.pieces = (self.pieces, []) if n is None else (self.pieces[:n], self.pieces[n:])
        some.sort(key=lambda p: -len(p[2]))
        total = sum(len(p[2]) // 4 for p in some)
        full = total // self.window
        tail = []
        if full:
            over, i = total - full * self.window + round(full * self.window * OPEN), 0
            while over > 0:
                doc_id, start, ids, tokens = some[i]
                cut = min(over, len(ids) // 4)
                over -= cut
                tail.append((doc_id, start + len(ids) // 4 - cut, ids[len(ids) - 4 * cut :], tokens))
                some[i] = (doc_id, start, ids[: len(ids) - 4 * cut], tokens)
                i += 1
            some = [p for p in some if p[2]]
        else:
            some, tail = [], some
        if some:
            for members in windows([len(p[2]) // 4 for p in some], self.window, full):
                inside = [some[i] for i in members]
                self._sequence(inside + self._cut(tail, self.window - sum(len(p[2]) // 4 for p in inside)))
        left = sum(len(p[2]) // 4 for p in tail)
        while left:
            size = min(self.window, 1 << (left.bit_length() - 1))
            self._sequence(self._cut(tail, size))
            left -= size

    @staticmethod
    def _cut(pieces: list[tuple], room: int) -> list[tuple]:
        """Takes ``room`` tokens, or all there are, off the end of ``pieces``."""
        out = []
        while room and pieces:
            doc_id, start, ids, n = pieces.pop()
            take = min(room, len(ids) // 4)
            out.append((doc_id, start, ids[: 4 * take], n))
            if 4 * take < len(ids):
                pieces.append((doc_id, start + take, ids[4 * take :], n))
            room -= take
        return out

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [[]] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk: int = CHUNK, path: str | None = None) -> DataFrame:
    """One row per piece of a document, with its place in a sequence; see SCHEMA.

    Null and empty texts are the end id alone. Every row is a document of its own, repeated or not;
    null ids are carried. An empty table gives an empty result; other columns are ignored. Sequence
    ids are unique: the task's number, then a count. ``window`` is a power of two.
    """
    small_batches(docs.sparkSession)
    end = np.array([END_ID], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = spellings(path or tokenizer_path())
        packer = _Packer(window, chunk, TaskContext.get().partitionId() << _TASK_BITS)
        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), known.encode(texts(batch)), strict=True):
                packer.add(doc_id, ids + end)
            yield packer.taken()
        packer.flush()
        yield packer.taken()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(packed, SCHEMA)
