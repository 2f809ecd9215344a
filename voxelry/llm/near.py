"""Near duplicates at a similarity of word shingles: SimHash says which pairs come first, the sets decide.

Pairs meet in two ways. First the fingerprints are searched in op8's tables of pivot distances (cells, largest coordinate
difference, bits), which finds sets that differ in few shingles. Fingerprints of texts at Jaccard 0.8 differ in ten bits of
64 on average and in up to some twenty, which no cell of pivot distances or of a 64-bit fingerprint holds together. So
pairs also meet by prefixes: in any fixed order of shingles, sets of similarity s share one of their first
n - ceil(s n) + 1 shingles. The order is by frequency in a sample of the texts, then by hash, so that common passages come
last; the result does not depend on it. Pairs that meet are kept only if the places of their common
shingle leave room for enough overlap.

Before any set is moved, tables of pivot distances discard pairs. A pivot is the set of all shingles whose hash has a
certain bit, so a set's distance to it (in how many shingles they differ, but for the pivot's own size) is the count whose
sign is a bit of SimHash. By the triangle inequality two sets differ in as many shingles at least as their distances to a
pivot do, and that holds for each part of the shingles on its own: the largest coordinate differences of all parts add up
to a bound that discards no similar pair. A bit of parity for each shingle gives another. Pairs whose fingerprints differ in
MOST_BITS at most are compared set by set first; the others are compared only if nothing links them by then, so no pair is
lost. Shingles of many prefixes are not paired up at once: their members are compared with one of them first, and then those
that no link joins yet meet by shingle and size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import forget, new_path, small_batches, texts, written
from voxelry.llm.components import components
from voxelry.llm.simhash import PIVOTS, hashed, links, named, without_copies

WORDS, SIMILARITY = 5, 0.8
#: Pairs whose fingerprints differ in no more bits are compared first; of large sets nearly all similar pairs are among them.
MOST_BITS = 28
#: Shingles in more prefixes are compared with one member first.
BLOCK = 64
#: Sizes of one bucket differ by less than this factor.
BUCKET = 1.05
#: One text in so many is read for frequencies; shingles that are rarer there count as unseen, and so many are kept.
SAMPLE, OFTEN, MOST = 16, 4, 1 << 16
#: Shingles of a part in tables of pivot distances, up to twice as many, and the first of the bits that make pivots; parts go by low bits.
PART, FIRST_BIT = 8, 32
_SLACK = 1e-9


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *hashed(text, words)])).view(np.int64)


def node(found: np.ndarray) -> int:
    """A hash of the set, as a signed number; of the empty set 0."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).astype(np.int64)) if len(found) else 0


def sketch(found: np.ndarray) -> int:
    """The SimHash fingerprint of a set, as a signed number; of the empty set 0."""
    counts = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little", signed=True)


def prefix(found: np.ndarray, often: np.ndarray, times: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The first shingles in order of frequency and hash; ``often`` is sorted and has the frequencies ``times``."""
    n = len(found)
    rank = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, found), len(often) - 1)
        rank = np.where(often[at] == found, times[at], 0)
    return found[np.lexsort((found, rank))][: n - math.ceil(similarity * n - _SLACK) + 1]


def parity(found: np.ndarray) -> bytes:
    """Of a set of n shingles, whether an odd number of them falls to each of n to 2n places (a power of two, 64 at least)."""
    places = max(64, 1 << max(len(found) - 1, 0).bit_length())
    return np.packbits(np.bincount(found & (places - 1), minlength=places).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """From the sets' parities, in how many shingles they differ at least: each changes one place. The longer one is folded."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0) ^ a).sum())


def distances(found: np.ndarray) -> bytes:
    """The set's distances to the pivots, less the pivots' sizes, a byte for each pivot and part (a power of two); empty if one needs more."""
    parts = max(1, 1 << (len(found) // PART).bit_length() >> 1)
    part = found & (parts - 1)
    held = [np.bincount(part[(found >> (FIRST_BIT + j)) & 1 == 1], minlength=parts) for j in range(PIVOTS)]
    table = np.bincount(part, minlength=parts) - 2 * np.stack(held)
    return table.astype(np.int8).tobytes() if np.abs(table).max() < 128 else b""


def apart_by_pivots(x: bytes, y: bytes) -> int:
    """From the sets' distances, in how many shingles they differ at least: by part, the largest coordinate difference. The longer table is folded."""
    if not x or not y:
        return 0
    a, b = sorted((np.frombuffer(x, np.int8), np.frombuffer(y, np.int8)), key=len)
    a = a.reshape(PIVOTS, -1)
    b = b.reshape(PIVOTS, -1, a.shape[1]).sum(axis=1, dtype=np.int64)
    return int(np.abs(a - b).max(axis=0).sum())


def _mapped(docs: DataFrame, of_text: Callable[[str], dict], schema: str) -> DataFrame:
    """doc_id and what ``of_text`` gives of each text."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64()), "binary": pa.binary()}
    fields = pa.schema([(k, kinds[t]) for k, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of_text(x) for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array([r[f.name] for r in rows], f.type) for f in list(fields)[1:]]], schema=fields)

    return docs.mapInArrow(run, schema)


def frequencies(docs: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of the texts, sorted, and in how many of these texts they are."""
    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    each = _mapped(some, lambda t: {"shingles": shingles(t, words)}, "doc_id bigint, shingles array<bigint>").select(F.explode("shingles").alias("shingle"))
    top = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(MOST)
    got = top.toArrow()  # MOST rows at most
    found, n = got["shingle"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(found, kind="stable")
    return found[order], n[order]


def _may_be(x: str, y: str, similarity: float) -> Column:
    """Whether sets can be similar: after their common shingle's places there is room for enough others."""
    left = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
    return (left >= similarity / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - _SLACK)


def _not_apart(pairs: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` (a, b and others) without those whose pivot distances or parities show that the sets are not similar. No similar pair goes."""
    @F.pandas_udf("bigint")
    def differ(x: pd.Series, y: pd.Series, p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([max(apart_by_pivots(a, b), apart(c, d)) for a, b, c, d in zip(x, y, p, q, strict=True)], dtype="int64")

    ids = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    held = ("n", "pivots", "parity")
    known = rows.select("fp", *held).join(ids, "fp", "left_semi").groupBy("fp").agg(*[F.first(c).alias(c) for c in held])
    of = lambda side: known.select(F.col("fp").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in held])
    # Sets of similarity s differ in (1 - s) / (1 + s) of their sizes at most.
    most = (1 - similarity) / (1 + similarity) * (F.col("n_a") + F.col("n_b")) + _SLACK
    return pairs.join(of("a"), "a").join(of("b"), "b").where(differ("pivots_a", "pivots_b", "parity_a", "parity_b") <= most).select(*pairs.columns)


def searched(rows: DataFrame) -> DataFrame:
    """a, b: nodes whose fingerprints op8's search in tables of pivot distances finds together, or that are equal.

    A fingerprint stands for its least node, to which its other nodes are paired, and is paired with the least one that the
    search finds for it, so there are no more pairs than nodes. All others meet by prefixes.
    """
    each = rows.groupBy("fp").agg(F.first("sketch").alias("sketch"))
    least = written(each.groupBy("sketch").agg(F.min("fp").alias("least")), "sketches")
    found = links(least.select(F.col("sketch").alias("fp"))).groupBy("a").agg(F.min("b").alias("b"))
    of = lambda side: least.select(F.col("sketch").alias(side), F.col("least").alias(f"least_{side}"))
    close = found.join(of("a"), "a").join(of("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    pairs = close.unionByName(each.join(least, "sketch").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _similar(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar. The sets are removed once they are compared."""
    spark = docs.sparkSession
    met_path, sets_path = new_path(spark, "met"), new_path(spark, "sets")
    pairs = written(pairs.distinct(), "met", met_path)
    ids = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = nodes.join(ids, "fp", "left_semi").select(F.col("least").alias("id")).distinct()
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def of_text(text: str) -> dict:
        found = shingles(text, words)
        return {"fp": node(found), "shingles": found}

    sets = written(_mapped(some, of_text, "doc_id bigint, fp bigint, shingles array<bigint>").drop("doc_id").dropDuplicates(["fp"]), "sets", sets_path)
    a, b = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = written(pairs.join(a, "a").join(b, "b").where(both >= similarity * (F.size("x") + F.size("y") - both) - _SLACK).select("a", "b"), "links")
    forget(spark, met_path)
    forget(spark, sets_path)
    return found


def linked(docs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """node and root, as :func:`components.components` gives them, of the similar nodes.

    ``rows`` have doc_id, fp, sketch, n, pivots, parity and prefix; ``nodes`` their fp and least id.
    """
    # Equal sets have equal prefixes, so any of them will do. Size and place share a number on their way through the shuffle.
    each = rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("sketch", "n", "prefix")]).select("fp", "sketch", "n", F.posexplode("prefix").alias("pos", "shingle"))
    each = each.select("fp", "sketch", "shingle", F.shiftleft(F.col("n").cast("bigint"), 32).bitwiseOR(F.col("pos").cast("bigint")).alias("place"))
    each = each.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).where("k > 1")
    each = each.select("fp", "sketch", "shingle", "k", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("pos"))
    each = written(each, "prefixes")
    pair = [F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), (F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= MOST_BITS).alias("close")]
    few, many = each.where(F.col("k") <= block), each.where(F.col("k") > block)
    met = few.alias("x").join(few.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.fp") > F.col("y.fp")) & _may_be("x", "y", similarity)).select(*pair)
    first = many.groupBy("shingle").agg(F.min_by(F.struct("fp", "sketch", "n", "pos"), F.struct("pos", "fp")).alias("y")).select("shingle", "y.*")
    first = written(first, "first")
    met = met.unionByName(many.alias("x").join(first.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.fp") != F.col("y.fp")) & _may_be("x", "y", similarity)).select(*pair))
    met = met.unionByName(written(searched(rows), "searched").withColumn("close", F.lit(True)))
    met = written(_not_apart(written(met.distinct(), "candidates"), rows, similarity), "alike")
    found = _similar(met.where("close").drop("close"), docs, nodes, words, similarity)
    roots = written(components(found), "roots")
    # Pairs of far fingerprints and pairs that share frequent shingles only are compared where nothing links them yet.
    far = met.where("NOT close").drop("close")
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    far = far.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = far if first.isEmpty() else far.unionByName(_not_apart(written(_unlinked(many, first, roots, similarity).distinct(), "unlinked"), rows, similarity))
    more = _similar(rest, docs, nodes, words, similarity)
    return roots if more.isEmpty() else components(found.unionByName(more))


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(BUCKET)).cast("int")


def _unlinked(many: DataFrame, first: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of a frequent shingle's members that no link joins yet and that can be similar.

    The members that are not linked to the shingle's first one look for partners. After a member's place of the shingle
    there is room for partners of certain sizes only, so they meet by shingle and bucket of sizes: members that differ in
    more than is left after the shingle, such as pages of one template, meet none.
    """
    root_of = roots.select("node", "root")
    named_ = many.join(root_of, many["fp"] == root_of["node"], "left").select("shingle", "fp", "sketch", "n", "pos", F.coalesce("root", "fp").alias("root"))
    main = first.join(root_of, first["fp"] == root_of["node"], "left").select("shingle", F.coalesce("root", "fp").alias("main"))
    members = written(named_.join(main, "shingle"), "members")
    n, left = F.col("n"), F.col("n") - F.col("pos")
    least = F.greatest(F.ceil(similarity * n - _SLACK), F.lit(1))
    most = F.least(F.floor(n / similarity + _SLACK), F.floor((1 + similarity) / similarity * left - n + _SLACK))
    # A little wider, so that rounding in the logarithm loses no bucket.
    wanted = F.sequence(_bucket(least * (1 - 1e-9)), _bucket(most * (1 + 1e-9)))
    seeking = members.where((F.col("root") != F.col("main")) & (most >= least)).withColumn("bucket", F.explode(wanted))
    found = members.withColumn("bucket", _bucket(n))
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.main")) | (F.col("x.fp") > F.col("y.fp")))
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.bucket") == F.col("y.bucket"))
    return seeking.alias("x").join(found.alias("y"), same & apart & _may_be("x", "y", similarity)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """doc_id, fp (a hash of the set), component_id for each row; component_id is the smallest id that links reach.

    Null texts are empty, and empty texts are one node. Null ids never become a component's id, unless
    all are null. Repeated rows are kept; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    often, times = frequencies(docs, words)

    def of_text(text: str) -> dict:
        found = shingles(text, words)
        return {"fp": node(found), "sketch": sketch(found), "n": len(found), "pivots": distances(found), "parity": parity(found), "prefix": prefix(found, often, times, similarity) if len(found) else []}

    rows = written(_mapped(docs, of_text, "doc_id bigint, fp bigint, sketch bigint, n int, pivots binary, parity binary, prefix array<bigint>"), "shingled")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    return named(rows.select("doc_id", "fp"), nodes, linked(docs, rows, nodes, words, similarity, block))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that are not their component's smallest id; all columns kept.

    Rows of one id are one document. Rows without an id stay only where their component has no id.
    """
    return without_copies(docs, near_components(docs))
