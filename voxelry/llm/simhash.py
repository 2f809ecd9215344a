"""Near duplicates by SimHash, searched with pivot distance tables.

Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints (pivots), part by
part. Fingerprints within r bits leave at least two of r + 2 parts alone, where all their distances to
the pivots agree: so pairs are searched in cells of equal distances on two parts, and fingerprints that
are alone in all their cells go. The others meet in finer cells: of sixteen parts all but r agree, so
that no cell has more than 16**r fingerprints, however dense the data. By the triangle inequality,
fingerprints within r bits also have whole distances within r to every pivot: a pair whose largest
coordinate difference exceeds r is discarded, and the survivors are verified bit by bit. The search is
exact; a fingerprint has at most as many links as there are values within r bits of it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import free_names, join_by_key, salted, small_batches, texts, with_all_salts, written
from voxelry.llm.components import components

#: Pivots are as many as distances to parts of a fingerprint fit into 64 bits.
WORDS, RADIUS, PIVOTS = 3, 2, 12
#: Parts of the finer cells.
FINE = 16
_AT_ONCE = 1 << 16


def pivots(n: int = PIVOTS) -> list[int]:
    """``n`` reference fingerprints as signed 64-bit numbers."""
    return [int(np.uint64(xxhash.xxh64_intdigest(f"pivot {i}", 1)).astype(np.int64)) for i in range(n)]


def hashed(text: str, words: int = WORDS) -> Iterator[np.ndarray]:
    """Hashes (XXH64, seed 42) of the word shingles in order, some at a time; without words none.

    A-Z count as lower case; fewer words than a shingle are one shingle.
    """
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    whole = b" ".join(w)
    if len(w) <= words:
        starts, ends = [0], [len(whole)]
    else:
        after = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
        starts = [0, *after[: len(w) - words].tolist()]
        ends = (after[words - 1 :] - 1).tolist()
    h = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _AT_ONCE):
        yield np.array([h(whole[a:b], 42) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the word shingles, as an unsigned number; without words 0.

    A bit is 1 if over half of the shingles' hashes have it.
    """
    counts, n = np.zeros(64, np.int64), 0
    for some in hashed(text, words):
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(some)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed number) for each row; null texts are empty."""
    small_batches(docs.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x) for x in texts(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(hashed, "doc_id bigint, fp bigint")


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _masks(n: int) -> list[int]:
    """``n`` parts of the 64 bits, of nearly equal width, as signed numbers."""
    ends = [64 * i // n for i in range(n + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in itertools.pairwise(ends)]


def _bits_to(fp: Column, pivot: int, mask: int = -1) -> Column:
    """Hamming distance to a pivot within a part."""
    return F.bit_count(fp.bitwiseXOR(F.lit(pivot).cast("bigint")).bitwiseAND(F.lit(mask).cast("bigint")))


def pivot_table(fps: DataFrame, n: int = PIVOTS) -> DataFrame:
    """``fps`` with d0.., the distances of fp to each pivot."""
    return fps.withColumns({f"d{i}": _bits_to(F.col("fp"), p).cast("tinyint") for i, p in enumerate(pivots(n))})


def coarse_cells(fps: DataFrame, radius: int = RADIUS, n: int = PIVOTS) -> DataFrame:
    """fp and cell, once for each two of radius + 2 parts: a hash of the distances to the pivots on both."""
    held = []
    for mask in _masks(radius + 2):
        near = [F.shiftleft(_bits_to(F.col("fp"), p, mask).cast("bigint"), 5 * i) for i, p in enumerate(pivots(n))]
        held.append(reduce(lambda a, b: a.bitwiseOR(b), near))
    parts = fps.select("fp", *[h.alias(f"p{i}") for i, h in enumerate(held)])
    cells = [F.xxhash64(F.lit(k), F.col(f"p{i}"), F.col(f"p{j}")) for k, (i, j) in enumerate(itertools.combinations(range(radius + 2), 2))]
    return parts.select("fp", F.explode(F.array(*cells)).alias("cell"))


def with_company(fps: DataFrame, radius: int = RADIUS, n: int = PIVOTS) -> DataFrame:
    """The fingerprints that share a coarse cell with another."""
    cells = coarse_cells(fps, radius, n)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell")
    return salted(cells, "fp").join(with_all_salts(shared), ["cell", "salt"], "left_semi").select("fp").distinct()


def met(fps: DataFrame, radius: int = RADIUS, n: int = PIVOTS) -> DataFrame:
    """x and y (fp and its distances) of each pair, once for each fine cell that it shares."""
    free = [_signed(sum(m & (1 << 64) - 1 for m in some)) for some in itertools.combinations(_masks(FINE), radius)]
    keys = F.transform(F.array(*[F.lit(~m).cast("bigint") for m in free]), lambda m: F.col("fp").bitwiseAND(m))
    fine = pivot_table(fps, n).select(F.posexplode(keys).alias("part", "cell"), F.struct("fp", *[f"d{i}" for i in range(n)]).alias("f"))
    x, y = fine.alias("x"), fine.alias("y")
    same = (F.col("x.part") == F.col("y.part")) & (F.col("x.cell") == F.col("y.cell"))
    y = y.hint("merge")  # the planner's sizes know nothing of the many cells
    return x.join(y, same & (F.col("x.f.fp") > F.col("y.f.fp"))).select(F.col("x.f").alias("x"), F.col("y.f").alias("y"))


def passed(pairs: DataFrame, radius: int = RADIUS, n: int = PIVOTS) -> DataFrame:
    """The pairs whose largest coordinate difference is within the radius."""
    return pairs.where(reduce(F.greatest, [F.abs(F.col(f"x.d{i}") - F.col(f"y.d{i}")) for i in range(n)]) <= radius)


def links(fps: DataFrame, radius: int = RADIUS, n_pivots: int = PIVOTS) -> DataFrame:
    """Every pair (a, b) of distinct fingerprints (column fp) that differ in ``radius`` bits at most.

    Cells and pairs grow with the radius as numbers of combinations do; it is meant for 1 to 3 bits.
    """
    some = written(with_company(fps, radius, n_pivots), "company")
    near = passed(met(some, radius, n_pivots), radius, n_pivots)
    near = near.where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    return near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for each row; component_id is the smallest id that links reach.

    Equal fingerprints are one node, so copies are never paired. Null, empty and blank texts have
    fingerprint 0 and are linked like any other; texts of any length are read whole. Null ids never
    become a component's id, unless all are null. Repeated rows are kept; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    return named(rows, nodes, components(links(nodes.select("fp"), radius)))


def named(rows: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp) with the component_id of their node, from nodes (fp, least, n rows) and roots (node, root) of those with links."""
    joined = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = written(salted(joined, "fp").join(with_all_salts(ids), ["root", "salt"]).select("fp", "component_id", "n"), "named")
    return join_by_key(rows, by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not their component's smallest id; all columns kept.

    Rows of one id are one document. Rows without an id stay only where their component has no id.
    """
    return without_copies(docs, simhash_components(docs))


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest id in ``found`` (doc_id, component_id)."""
    (name,) = free_names(docs, "kept_id")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    kept = written(kept, "kept")
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")
