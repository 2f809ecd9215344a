"""Toxicity by a classifier chain.

The categories are predicted one after the other; each later linear model also gets the probabilities of
the earlier ones. In training these come from folds that the row was left out of, so that later models
see them as good or bad as they will be. The last category is ``toxic`` itself, as labelled. The ones
before are its kinds: columns of the labels, if named, else groups of the toxic training rows that
k-means finds in the features that mark them, so no list of words is given.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts
from voxelry.llm.linear import fit_binary, sparse

#: Kinds that are found where the labels have none, and the features by which they are told apart, at most.
KINDS, MARKS = 3, 512
BITS, FOLDS, THRESHOLD = 18, 3, 0.5
#: Besides whole words, a text's features are the beginnings of its words, of these lengths.
PREFIXES = (4, 6)
#: Features in fewer training rows are left out.
LEAST_ROWS = 4
#: Labelled rows that the chain is fitted on.
SAMPLE = 8000
#: Words whose cells a Python worker remembers.
CACHE = 20_000
_WORD = re.compile(r"\w+")


@dataclass
class Chain:
    """Weights by category: positions and values; positions from 2**bits on are the earlier categories, the last the bias."""

    models: list[tuple[np.ndarray, np.ndarray]]
    bits: int
    categories: tuple[str, ...]


class Cells(dict):
    """The cells of a word, lower-cased, and of its beginnings."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = (1 << bits) - 1

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word, *[word[:n] + "*" for n in PREFIXES if len(word) >= n]]
        found = tuple(zlib.crc32(w.encode("utf-8", "surrogatepass")) & self.mask for w in parts)
        if len(self) < CACHE:
            self[word] = found
        return found

    def of(self, text: str) -> np.ndarray:
        """The cells of all words of a text, each once, in rising order."""
        found: set[int] = set()
        for word in set(_WORD.findall(text.lower())):
            found.update(self[word])
        return np.sort(np.fromiter(found, np.int64, len(found)))


def _starts(rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows end to end, and where each starts."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])


def kinds(at: np.ndarray, start: np.ndarray, toxic: np.ndarray, size: int, k: int = KINDS, steps: int = 20) -> np.ndarray:
    """A column for each of ``k`` groups of the toxic rows: True for its members.

    Rows are compared by the features that are more than twice as frequent in toxic rows, weighted by the
    logarithm of how much; the first centre is the row with most of them, each next one the row farthest
    from all before. Groups may be empty.
    """
    out = np.zeros((len(toxic), k), bool)
    row = np.repeat(np.arange(len(toxic)), np.diff(start))
    bad, good = (np.bincount(at[m], minlength=size) for m in (toxic[row], ~toxic[row]))
    lift = np.log((bad + 1) / (toxic.sum() + 2)) - np.log((good + 1) / ((~toxic).sum() + 2))
    marks = np.flatnonzero((lift > np.log(2)) & (bad > 1))
    marks = marks[np.argsort(-(lift * bad)[marks], kind="stable")][:MARKS]
    rows = np.flatnonzero(toxic)
    if not len(marks) or not len(rows):
        return out
    place = np.full(size, -1)
    place[marks] = np.arange(len(marks))
    held = toxic[row] & (place[at] >= 0)
    x = np.zeros((len(rows), len(marks)))
    x[np.searchsorted(rows, row[held]), place[at[held]]] = lift[at[held]]
    length = np.linalg.norm(x, axis=1)
    x = x / np.maximum(length, 1e-12)[:, None]
    centres = [x[int(length.argmax())]]
    while len(centres) < k:
        centres.append(x[int(np.max(x @ np.array(centres).T, axis=1).argmin())])
    c = np.array(centres)
    for _ in range(steps):
        mine = (x @ c.T).argmax(1)
        sums = np.array([x[mine == j].sum(0) for j in range(k)])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    out[rows, (x @ c.T).argmax(1)] = True
    return out


def _proba(at: np.ndarray, start: np.ndarray, more: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each row; the weights are those of the cells, of ``more``, and the bias."""
    sums = np.concatenate([[0.0], np.cumsum(w[at])])
    size = len(w) - 1 - more.shape[1]
    margin = sums[start[1:]] - sums[start[:-1]] + more @ w[size:-1] + w[-1]
    return 1.0 / (1.0 + np.exp(-np.clip(margin, -50, 50)))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, folds: int = FOLDS, categories: tuple[str, ...] | None = None) -> Chain:
    """The chain over ``rows`` (cells) and ``labels`` (one column by category). A category without examples is never predicted.

    Folds deal the rows in turn. Features are renumbered for the fit, so its cost does not depend on ``bits``.
    """
    n, k = labels.shape
    at, start = _starts(rows)
    seen = np.bincount(at, minlength=1 << bits) >= LEAST_ROWS
    kept = seen[at]
    start = np.concatenate([[0], np.cumsum(kept)])[start]
    cells, at = np.flatnonzero(seen), (np.cumsum(seen) - 1).astype(np.int32)[at[kept]]
    earlier, models = np.zeros((n, 0)), []
    fold = np.arange(n) % folds
    for c in range(k):
        y = labels[:, c]
        if not y.any() or y.all():
            w = np.zeros(len(cells) + c + 1)
            w[-1] = 50.0 if n and y.all() else -50.0
            out = np.full(n, float(n > 0 and y.all()))
        else:
            out = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), fold == f
                if len(inside) and outside.any():
                    out[outside] = _proba(at, start, earlier, fit_binary(at, start, earlier, y, len(cells), among=inside))[outside]
            w = fit_binary(at, start, earlier, y, len(cells))
        whole = np.zeros((1 << bits) + c + 1)
        whole[cells] = w[: len(cells)]
        whole[1 << bits :] = w[len(cells) :]
        models.append(sparse(whole[:, None]))
        earlier = np.column_stack([earlier, out])
    return Chain(models, bits, categories or tuple(f"c{i}" for i in range(k)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: Sequence[str] = (), bits: int = BITS) -> Chain:
    """The chain fitted on up to ``sample`` rows of ``labels`` (doc_id, toxic), chosen by a hash of the id; of equal hashes by the id.

    ``categories`` are columns of the labels (1: the document is of that kind) that come before toxic in
    the chain; without any, kinds are found by :func:`kinds`. Rows with a null id or label are left out, null
    categories count as 0; of repeated labels the largest counts, of repeated ids the first text. Without rows nothing is ever rejected.
    """
    small_batches(docs.sparkSession)
    most = [F.coalesce(F.max(F.col(c).cast("bigint")), F.lit(0)).alias(f"y{i}") for i, c in enumerate(["toxic", *categories])]
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(*most)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = known.select("doc_id", F.array(*[f"y{i}" for i in range(len(most))]).alias("y"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(bits)
        for batch in batches:
            found = [cells.of(x).astype(np.int32) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "y", "at"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))  # repeated ids are one row
    got = rows.select("doc_id", "y", "text").mapInArrow(featured, "doc_id bigint, y array<bigint>, at array<int>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    values, ends = got["at"].combine_chunks().flatten().to_numpy(), np.cumsum(np.asarray(pc.list_value_length(got["at"]), int))
    cells = [values[ends[i - 1] if i else 0 : ends[i]] for i in order]
    y = np.asarray(got["y"].combine_chunks().flatten(), int).reshape(-1, len(most))[order] > 0
    toxic, before = y[:, :1], y[:, 1:]
    names = tuple(categories)
    if not names:
        before, names = kinds(*_starts(cells), toxic[:, 0], 1 << bits), tuple(f"kind_{i}" for i in range(KINDS))
    return fit_chain(cells, np.column_stack([before, toxic]), bits, categories=(*names, "toxic"))


class Scorer:
    """A chain's probabilities of texts."""

    def __init__(self, chain: Chain) -> None:
        size, k = 1 << chain.bits, len(chain.models)
        self.cells, self.table = Cells(chain.bits), np.zeros((size, k), np.float32)
        self.bias, self.links = np.zeros(k), np.zeros((k, k))
        for c, (at, values) in enumerate(chain.models):
            v, own, link = values[:, 0], at < size, (at >= size) & (at < size + c)
            self.table[at[own], c], self.links[c, at[link] - size] = v[own], v[link]
            self.bias[c] = v[at == size + c].sum()

    def __call__(self, batch: list[str]) -> np.ndarray:
        """Probabilities by text and category."""
        out = np.zeros((len(batch), len(self.bias)))
        margins = np.array([self.table[self.cells.of(x)].sum(axis=0) for x in batch]).reshape(out.shape) + self.bias
        for c in range(len(self.bias)):
            margin = margins[:, c] + out[:, :c] @ self.links[c, :c]
            out[:, c] = 1.0 / (1.0 + np.exp(-np.clip(margin, -50, 50)))
        return out


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, a probability by category, and ``rejected`` (the last is over the threshold, so not where nothing was learnt) for each row.

    Null and empty texts are scored like texts without words; texts of any length are read whole.
    Repeated rows are kept and scored alike; an empty table gives an empty result; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    names = [f"p_{c}" for c in chain.categories]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(chain)
        for batch in batches:
            p = score(texts(batch))
            columns = [batch.column("doc_id"), *[pa.array(p[:, c]) for c in range(len(names))], pa.array(p[:, -1] > THRESHOLD)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "rejected"])

    schema = ", ".join(["doc_id bigint", *[f"{x} double" for x in names], "rejected boolean"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scored, schema)


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` without the rejected rows, in one pass without a join; all columns kept.

    A row is judged by its text alone, null like empty, so repeated rows stay or go together. An empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(chain)
        for batch in batches:
            yield batch.filter(pa.array(score(texts(batch))[:, -1] <= THRESHOLD))

    return docs.mapInArrow(passed, docs.schema)
