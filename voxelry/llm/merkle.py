"""A Merkle manifest of a dataset: one tree a language, and one over their roots.

Leaves are ranked by language and id without gathering a language: rows are dealt by ranges of (language,
id, leaf), and a range's places start where the ranges before it end. Ranked leaves are grouped in aligned
blocks of FANOUT ** DEPTH. A block is one contiguous matrix of 64-byte hex digests: rows of ``fanout`` nodes are
reshaped and hashed level by level, and a node's siblings are found by index arithmetic. The blocks' tops
are the leaves of the next, far smaller, table of blocks, until every tree has one top; the tops are ranked by
language and form the last tree in the same way. Paths then come down: each block learns the siblings above it
and proves its leaves from its own matrix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import forget, new_path, small_batches

FANOUT, DEPTH = 2, 10
#: Bytes of a digest as text.
HEX = 64
#: One level of a proof: what stands before a node in its run, and after it.
STEP = "array<struct<before:binary,after:binary>>"


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """SHA-256, as hex text, of the fields one after another: ``-`` if null, else UTF-8 byte count, ``:``, value."""
    return F.sha2(F.concat(*[_field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def tree_name(lang: Column) -> Column:
    """A name that is never null and orders like the languages, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit(""))


# The matrices of one block


def hashed_rows(rows: np.ndarray) -> np.ndarray:
    """The hex SHA-256 of each row of a contiguous byte matrix, as a matrix of HEX columns."""
    sha = hashlib.sha256
    return np.frombuffer("".join([sha(r).hexdigest() for r in rows]).encode(), np.uint8).reshape(-1, HEX)


def parents(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: every ``fanout`` consecutive nodes, fewer in the last run, become their digest."""
    full = len(nodes) // fanout
    found = hashed_rows(nodes[: full * fanout].reshape(full, fanout * HEX))
    if full * fanout == len(nodes):
        return found
    return np.concatenate([found, hashed_rows(nodes[full * fanout :].reshape(1, -1))])


def levels(leaves: np.ndarray, fanout: int, depth: int | None) -> list[np.ndarray]:
    """The matrices from the leaves to the top: ``depth`` levels, or as many as leave one node."""
    out = [leaves]
    while len(out) <= depth if depth is not None else len(out[-1]) > 1:
        out.append(parents(out[-1], fanout))
    return out


class Block:
    """A block's levels, and for all of its leaves at once their siblings and the fold to the top."""

    def __init__(self, leaves: np.ndarray, fanout: int, depth: int | None) -> None:
        self.fanout, self.n, self.levels = fanout, len(leaves), levels(leaves, fanout, depth)

    @property
    def top(self) -> bytes:
        return self.levels[-1].tobytes()

    def _runs(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each leaf at level k: the run its node is in, the node's place there, and the run's length."""
        nodes = self.levels[k]
        at = np.arange(self.n) // self.fanout**k
        run, place = at // self.fanout, at % self.fanout
        whole = np.zeros((-(-len(nodes) // self.fanout) * self.fanout, HEX), np.uint8)
        whole[: len(nodes)] = nodes
        return whole.reshape(-1, self.fanout, HEX)[run], place, np.minimum(len(nodes) - run * self.fanout, self.fanout)

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return (self._runs(k) for k in range(len(self.levels) - 1))

    def siblings(self) -> list[bytes]:
        """Each leaf's siblings level by level, left to right, as one text."""
        parts, missing = [], np.zeros(self.n, bool)
        held = []
        for runs, place, length in self.steps():
            other = np.arange(self.fanout - 1)[None, :]
            other = other + (other >= place[:, None])
            parts.append(np.take_along_axis(runs, other[:, :, None], 1).reshape(self.n, -1))
            held.append(other < length[:, None])
            missing |= length < self.fanout
        if not parts:
            return [b""] * self.n
        whole, kept = np.concatenate(parts, 1), np.concatenate(held, 1)
        out = [r.tobytes() for r in whole]
        for i in np.flatnonzero(missing):
            out[i] = whole[i].reshape(-1, HEX)[kept[i]].tobytes()
        return out

    def folded(self, leaves: np.ndarray) -> np.ndarray:
        """Each leaf's top when it stands in its own place among the block's other nodes."""
        now = leaves
        for runs, place, length in self.steps():
            runs[np.arange(self.n), place] = now
            now = np.empty((self.n, HEX), np.uint8)
            for size in np.unique(length):
                some = length == size
                now[some] = hashed_rows(np.ascontiguousarray(runs[some][:, :size]).reshape(some.sum(), -1))
        return now

    def paths(self) -> list[list[dict]]:
        """Each leaf's siblings as steps of what stands before and after it."""
        out = [[] for _ in range(self.n)]
        for runs, place, length in self.steps():
            for i, steps in enumerate(out):
                p = place[i]
                steps.append({"before": runs[i, :p].tobytes(), "after": runs[i, p + 1 : length[i]].tobytes()})
        return out


def _matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, HEX)


# Tables of blocks


def ranked(rows: DataFrame, path: str, order: list[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``at``, their place in their tree by ``order``, and ``n``, the tree's size.

    Written at ``path``. Rows are dealt by ranges, so a tree of any size is spread; each range has one row by
    tree in the table of starts. Rows that agree in all of ``order`` are told apart by where they were read.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    spread.drop("tie").withColumn("own", F.monotonically_increasing_id()).write.parquet(path)
    placed = rows.sparkSession.read.parquet(path).withColumn("range", F.shiftright("own", 33))
    tree = Window.partitionBy("tree")
    ranges = placed.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("rows"), F.min("own").alias("first"))
    starts = ranges.select("tree", "range", (F.sum("rows").over(tree.orderBy("range")) - F.col("rows") - F.col("first")).alias("start"), F.sum("rows").over(tree).alias("n"))
    return placed.join(starts, ["tree", "range"]).withColumn("at", F.col("own") + F.col("start")).drop("own", "range", "start")


def _blocks(nodes: DataFrame, path: str, fanout: int, depth: int) -> DataFrame:
    """One row a block of ``nodes`` (tree, at, n, digest; at the lowest level doc_id and tampered too), written at ``path``.

    tree, block, n (blocks of the tree), digests, top; doc_id and tampered where given. A group is a block,
    so it has ``fanout ** depth`` rows at most.
    """
    size, lowest = fanout**depth, "doc_id" in nodes.columns

    def built(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        n = rows.column("n")[0].as_py()
        digests = "".join(rows.column("digest").to_pylist()).encode()
        top = Block(_matrix(digests), fanout, depth if n > size else None).top
        out = {"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [-(-n // size)], "digests": [digests], "top": [top.decode()]}
        if lowest:
            own = rows.column("digest").to_pylist()
            out["doc_id"] = [rows.column("doc_id").to_pylist()]
            out["tampered"] = ["".join([t or d for t, d in zip(rows.column("tampered").to_pylist(), own, strict=True)]).encode()]
        return pa.table(out, schema=pa.schema([pa.field(k, types[k]) for k in out]))

    types = {"tree": pa.string(), "block": pa.int64(), "n": pa.int64(), "digests": pa.binary(), "top": pa.string(), "doc_id": pa.list_(pa.int64()), "tampered": pa.binary()}
    schema = "tree string, block bigint, n bigint, digests binary, top string" + (", doc_id array<bigint>, tampered binary" if lowest else "")
    nodes.withColumn("block", F.floor(F.col("at") / size)).groupBy("tree", "block").applyInArrow(built, schema).write.parquet(path)
    return nodes.sparkSession.read.parquet(path)


def _grown(nodes: DataFrame, folder: str, fanout: int, depth: int) -> list[DataFrame]:
    """The tables of blocks from the leaves up; the last has one block for each tree that got so far.

    Each has fewer rows by ``fanout ** depth``, so there are few; one number of each reaches the driver.
    """
    out = [_blocks(nodes, f"{folder}/0", fanout, depth)]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tops = out[-1].where("n > 1").select("tree", F.col("block").alias("at"), "n", F.col("top").alias("digest"))
        out.append(_blocks(tops, f"{folder}/{len(out)}", fanout, depth))
    return out


_STEPS = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
_ENTRY = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("path", _STEPS), ("subroot", pa.string())])


def _opened(blocks: DataFrame, fanout: int, depth: int) -> DataFrame:
    """tree, at, path, subroot for each node of ``blocks``: its siblings in its block, then the block's own path."""
    size = fanout**depth

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(_matrix(row["digests"]), fanout, depth if row["n"] > 1 else None)
                first = row["block"] * size
                yield pa.RecordBatch.from_pylist([{"tree": row["tree"], "at": first + i, "path": own + row["path"], "subroot": row["subroot"]} for i, own in enumerate(block.paths())], _ENTRY)

    return blocks.mapInArrow(opened, f"tree string, at bigint, path {STEP}, subroot string")


def _with_paths(tables: list[DataFrame], ends: DataFrame, fanout: int, depth: int) -> DataFrame:
    """The lowest table with ``path`` and ``subroot`` of each block. ``ends`` has them by tree, for its last block.

    Paths come down by tree and block, so that no join is by a tree alone, however many blocks it has.
    """
    above, key = None, ["tree", "block"]
    for i, table in reversed(list(enumerate(tables))):
        rows = table.where("n = 1").join(ends, key)
        if above is not None:
            rows = rows.unionByName(table.where("n > 1").join(above, key))
        if i:
            above = _opened(rows, fanout, depth).withColumnRenamed("at", "block")
    return rows


def _fold(node: bytes, path: list[dict]) -> bytes:
    for step in path:
        node = hashlib.sha256(step["before"] + node + step["after"]).hexdigest().encode()
    return node


def manifest(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    ``tampered`` says for which rows the fold starts at a leaf whose n_chars is greater by one; for none by default.
    A null there counts as false, and a null n_chars stays. Null fields have a mark of their own. Null ids come
    first in their tree; rows of equal ids are ordered by their leaves, and rows equal in all columns have
    places beside each other, so that they share a leaf but not a proof. Null, as a language, is a tree
    of its own. An empty table gives an empty result; extra columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = new_path(spark, "merkle")
    at = [docs[c] for c in ("doc_id", "source", "lang", "n_chars", "text")]
    more = [*at[:3], at[3].cast("decimal(20,0)") + 1, at[4]]
    flag = F.lit(False) if tampered is None else tampered
    leaves = docs.select(tree_name(docs["lang"].cast("string")).alias("tree"), docs["doc_id"].cast("bigint").alias("doc_id"), leaf(*at).alias("digest"), F.when(flag & at[3].isNotNull(), leaf(*more)).alias("tampered"))
    lowest = _grown(ranked(leaves, f"{folder}/leaves", ["doc_id", "digest"]), f"{folder}/rows", fanout, depth)
    forget(spark, f"{folder}/leaves")

    # The trees' tops, ranked by language, are the leaves of the last tree. A tree's top is that of its only block.
    tops = lowest[0].where("n = 1").select("tree", "top")
    for table in lowest[1:]:
        tops = tops.unionByName(table.where("n = 1").select("tree", "top"))
    whole = ranked(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest")), f"{folder}/tops", ["name"])
    highest = _grown(whole.select("tree", "at", "n", "digest"), f"{folder}/trees", fanout, depth)
    root = highest[-1].where("n = 1").select(F.col("top").alias("root"))  # one row
    no_path = F.array().cast(STEP)
    top = spark.range(1).select(F.lit("").alias("tree"), F.col("id").alias("block"), no_path.alias("path"), F.lit("").alias("subroot"))  # one row
    rest = _opened(_with_paths(highest, top, fanout, depth), fanout, depth).select("at", "path")
    ends = whole.select(F.col("name").alias("tree"), "at", F.col("digest").alias("subroot"), F.lit(0).cast("bigint").alias("block")).join(rest, "at").drop("at")

    def proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, changed = _matrix(row["digests"]), _matrix(row["tampered"])
                block = Block(own, fanout, depth if row["n"] > 1 else None)
                path = row["path"]
                above = b"".join(s["before"] + s["after"] for s in path)
                starts = [r.tobytes() for r in block.folded(changed)]
                top = {s: _fold(s, path).decode() for s in set(starts)}
                folded = [top[s] for s in starts]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["doc_id"], "leaf": [r.tobytes().decode() for r in own], "subroot": [row["subroot"]] * block.n, "root": [row["root"]] * block.n,
                    "proof_sha256": [hashlib.sha256(s + above).hexdigest() for s in block.siblings()], "folded_root": folded, "verified": [f == row["root"] for f in folded],
                }, out)

    text = pa.string()
    out = pa.schema([("doc_id", pa.int64()), ("leaf", text), ("subroot", text), ("root", text), ("proof_sha256", text), ("folded_root", text), ("verified", pa.bool_())])
    found = _with_paths(lowest, ends, fanout, depth).crossJoin(F.broadcast(root))
    return found.mapInArrow(proved, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def seventh(doc_id: Column) -> Column:
    """Whether 7 divides the CRC-32 of the id's decimal text."""
    return F.crc32(doc_id.cast("string")) % 7 == 0


_FIELDS = " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n", "text"))
_FOLD = "CASE WHEN s.h IS NULL THEN sha256(f.h) WHEN f.place % 2 = 0 THEN sha256(f.h || s.h) ELSE sha256(s.h || f.h) END"
_TREE = """{name}(tree, level, place, h, n) AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, place // 2, sha256(string_agg(h, '' ORDER BY place)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, place // 2, n
)"""
#: Levels of both kinds of tree, siblings by joins, and a fold by steps; CRC-32 is worked out bit by bit.
ORACLE = f"""
WITH RECURSIVE bits AS (
  SELECT DISTINCT doc_id, flatten([[(ascii(c) >> k) & 1 for k in range(8)] for c in string_split(doc_id::VARCHAR, '')]) AS b FROM documents WHERE doc_id IS NOT NULL
), crc AS (
  SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda r, x: xor(r >> 1, CASE WHEN xor(r, x) & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) AS crc FROM bits
), d AS (
  SELECT doc_id, source, lang, text, n_chars AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree, coalesce(crc % 7 = 0, false) AS bad FROM documents LEFT JOIN crc USING (doc_id)
), hashed AS (
  SELECT doc_id, tree, bad, sha256({_FIELDS}) AS leaf FROM d
), other AS (
  SELECT doc_id, sha256({_FIELDS.replace('n::', '(n + 1)::')}) AS changed FROM d WHERE bad
), leaves AS (
  SELECT h.doc_id, tree, leaf, CASE WHEN bad THEN changed ELSE leaf END AS start, row_number() OVER (PARTITION BY tree ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
  FROM hashed h LEFT JOIN other USING (doc_id)
), {_TREE.format(name='own', start='SELECT tree, 0, place, leaf, n FROM leaves')}, tops AS (
  SELECT tree, max(h) AS h, max(level) AS height FROM own WHERE n = 1 GROUP BY tree
), {_TREE.format(name='all_trees', start='SELECT 0::BIGINT, 0, tree - 1, h, count(*) OVER () FROM tops')}, root AS (
  SELECT h AS root, level AS height FROM all_trees WHERE n = 1
), fold(tree, leaf_place, level, place, h, proof) AS (
  SELECT tree, place, 0, place, start, '' FROM leaves
  UNION ALL
  SELECT f.tree, f.leaf_place, f.level + 1, f.place // 2, {_FOLD}, f.proof || coalesce(s.h, '')
  FROM fold f JOIN tops t ON t.tree = f.tree AND f.level < t.height LEFT JOIN own s ON s.tree = f.tree AND s.level = f.level AND s.place = xor(f.place, 1)
), up(tree, leaf_place, level, place, h, proof) AS (
  SELECT f.tree, f.leaf_place, 0, f.tree - 1, f.h, f.proof FROM fold f JOIN tops t ON t.tree = f.tree AND f.level = t.height
  UNION ALL
  SELECT f.tree, f.leaf_place, f.level + 1, f.place // 2, {_FOLD}, f.proof || coalesce(s.h, '')
  FROM up f JOIN root r ON f.level < r.height LEFT JOIN all_trees s ON s.level = f.level AND s.place = xor(f.place, 1)
)
SELECT l.doc_id, l.leaf, t.h AS subroot, r.root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = r.root AS verified
FROM leaves l JOIN tops t USING (tree) JOIN root r ON true JOIN up u ON u.tree = l.tree AND u.leaf_place = l.place AND u.level = r.height
"""
