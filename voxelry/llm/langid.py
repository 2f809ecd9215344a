"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover every training document; the weights are fitted on a bounded sample, equal
shares of each language, by follow-the-regularised-leader with elastic-net penalties, and a temperature fitted on rows
left out of that calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts
from voxelry.llm.linear import Ftrl, Row, dense, softmax, sparse

#: n-grams of 1 to 3 characters in 2**BITS cells.
BITS, GRAMS = 15, 3
#: Labelled rows that the weights are fitted on, in all, and the least by language, however many there are.
SAMPLE, LEAST = 3200, 8
UNKNOWN = "und"
_MIX = np.uint32(0x9E3779B1)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    at: np.ndarray
    values: np.ndarray
    temperature: float


@cache
def _letters() -> np.ndarray:
    """Each code point that is a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def grams(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the text's n-grams and how often each occurs; none without a letter. Other characters count as one separator."""
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not points.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    points = np.concatenate([[np.uint32(0)], points, [np.uint32(0)]]).astype(np.uint32)
    counts = np.zeros(1 << bits, np.int64)
    h = np.zeros(len(points), np.uint32)
    for n in range(GRAMS):
        h = (h[: len(points) - n] * np.uint32(31337) + points[n:] + np.uint32(n + 1)) * _MIX
        counts += np.bincount(h >> np.uint32(32 - bits), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Row:
    x = (1.0 + np.log(counts)) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def document_frequencies(docs: DataFrame, bits: int = BITS) -> tuple[np.ndarray, int]:
    """How many of all texts hold each cell, and how many texts there are."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            for text in texts(batch):
                found[grams(text, bits)[0]] += 1
                n += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], ["cell", "n"])

    rows = docs.select("text").mapInArrow(counted, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(1 << bits, np.int64), 0
    for cell, n in rows:  # 2**bits + 1 rows at most
        if cell < 0:
            total = n
        else:
            out[cell] = n
    return out, total


def sampled(docs: DataFrame, sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """doc_id and lang of up to ``sample`` rows, equal shares of all languages, ``least`` of each if there are so many; by a hash of the id.

    The rows of each language are counted first; then only rows whose hash is below a bound, which
    leaves somewhat more than the language's share, are ordered.
    """
    found = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language, all of which the model holds
    share = max(sample // max(len(found), 1), least)
    wide = share + 6 * share**0.5 + 16
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, wide / r["n"])) for r in found], "lang string, bound double")
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    low = docs.select("doc_id", "lang").join(F.broadcast(bounds), "lang").where(hashed < F.col("bound"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return low.withColumn("nth", nth).where(F.col("nth") <= share).select("doc_id", "lang").distinct()


def train(docs: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model | None:
    """A model from (doc_id, text, lang); rows without id or lang are left out. None if no row is left.

    Repeated rows of one id and language are fitted once, but count in the document frequencies.
    """
    small_batches(docs.sparkSession)
    docs = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL")
    found, total = document_frequencies(docs, bits)
    if not total:
        return None
    idf = np.log((1.0 + total) / (1.0 + found)) + 1.0
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(sampled(docs, sample)), ["doc_id", "lang"], "left_semi")
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [grams(x, bits) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([c for _, c in made], pa.list_(pa.int64()))],
                ["doc_id", "lang", "at", "counts"],
            )

    got = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang").mapInArrow(featured, "doc_id bigint, lang string, at array<int>, counts array<bigint>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["doc_id"][i].as_py(), got["lang"][i].as_py()))
    languages = sorted(set(got["lang"].to_pylist()))
    features: list[Row] = []
    labels: list[int] = []
    for i in order:
        at = got["at"][i].values.to_numpy()
        if len(at):
            features.append(tf_idf(at, got["counts"][i].values.to_numpy(), idf))
            labels.append(languages.index(got["lang"][i].as_py()))
    # Each fifth row of a language is left out for the temperature, so that every language is learned.
    fit, apart, seen = [], [], np.zeros(len(languages), int)
    for i, k in enumerate(labels):
        seen[k] += 1
        (fit if seen[k] % 5 else apart).append(i)
    learner = Ftrl(1 << bits, len(languages), alpha=1.0, l1=0.02)
    learner.fit([features[i] for i in fit], [labels[i] for i in fit])
    weights = learner.weights()
    logits = np.array([features[i][1] @ weights[features[i][0]] + weights[-1] for i in apart]).reshape(len(apart), len(languages))
    return Model(languages, idf.astype(np.float32), *sparse(weights), temperature(logits, np.array([labels[i] for i in apart], int)))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss among fixed steps; 1 without rows."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean()
    return float(min(np.geomspace(0.05, 5.0, 60), key=loss))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score for each row; ``und`` and 0 if the text is null or has no letter, or if there is no model at all.

    Of equal probabilities the first language by name is given; texts of any length are read whole.
    """
    small_batches(docs.sparkSession)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model and dense(model.at, model.values, len(model.idf) + 1)
        for batch in batches:
            names, scores = [], []
            for text in texts(batch):
                at, counts = grams(text) if model else ((), ())
                if not len(at):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at, x = tf_idf(at, counts, model.idf)
                p = softmax((x @ weights[at] + weights[-1]) / model.temperature)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scored, "doc_id bigint, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, trained on the rows that are not held out.

    Rows with a null id are neither trained on nor held out. Repeated rows count as often as they
    occur; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
