"""Document fingerprints from closed syncmers, in SQL functions only.

A text is read as units: its runs of non-space characters, cut after eight code points. Of each k
neighbouring units, the inner substrings of s units are hashed; the k-mer is a closed syncmer when the
smallest of these hashes is that of the first or the last substring. The choice depends on the k-mer
alone, so equal passages give equal anchors wherever they stand. A fingerprint is the sorted array of
the anchors, each a hash with the place of its first k-mer; a text of which no k-mer is chosen has one
anchor of all its units instead, so that only texts without units have an empty one.

Two fingerprints are matched by position: anchors that both have are grouped by how far they are shifted
against each other, and those of the most frequent shift count as common.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import text_or_empty, written

UNIT = r"[^\x20\x09-\x0D]{1,8}"
#: A k-mer is chosen with a probability of 2 / (K - S + 1).
K, S = 7, 2
#: An anchor is a 64-bit number: a hash of 33 bits, a free bit, and a place of 30 bits, which hold every place: a string has
#: at most 2**31 bytes, and a unit with the space behind it two at least.
PLACE_BITS = 30
#: Ranges of ids by shuffle partition, and the most of them.
RANGES, MOST_RANGES = 16, 32768
_LAST = -(1 << 63)
_HASH = -(1 << (PLACE_BITS + 1))


def unit_hashes(text: Column) -> Column:
    """A 64-bit hash of each unit of the text."""
    return F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda x: F.xxhash64(x))


def _anchor(digest: Column, place: Column) -> Column:
    return digest.bitwiseAND(F.lit(_HASH).cast("bigint")).bitwiseOR(place.cast("bigint").bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("bigint")))


def _hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE_BITS + 1)


def with_anchors(df: DataFrame, units: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``df`` with the fingerprint of an array column of unit hashes as ``out``; the former is dropped.

    Fewer than k units, but one at least, are one anchor at 0, as are units of which no k-mer is
    chosen; none give an empty array. Of equal k-mers the first one's place is kept. Ties between inner
    substrings count as least at an edge if an edge is one of them.
    """
    if not 0 < s < k:
        raise ValueError("s is between 0 and k")
    inner, found = f"{out}_inner", f"{out}_found"
    u, n = F.col(units), F.size(units)
    df = df.withColumn(inner, F.when(n >= k, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[F.get(u, i + j) for j in range(s)])) if s > 1 else u))

    def at(i: Column) -> Column:
        hashes = [F.get(F.col(inner), i + j) for j in range(k - s + 1)]
        inside = hashes[1:-1]
        least = reduce(lambda a, b: F.least(a, b), inside) if inside else None
        chosen = F.least(hashes[0], hashes[-1]) <= least if inside else F.lit(True)
        return F.when(chosen, _anchor(F.xxhash64(*[F.get(u, i + j) for j in range(k)]), i))

    df = df.withColumn(found, F.when(n >= k, F.sort_array(F.array_compact(F.transform(F.sequence(F.lit(0), n - k), at)))))
    first = F.filter(found, lambda x, i: (i == 0) | (_hash_of(x) != _hash_of(F.get(F.col(found), i - 1))))
    whole = F.array(_anchor(F.xxhash64(u), F.lit(0)))
    made = F.when(F.size(found) > 0, first).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, made).drop(units, inner, found)


def with_matches(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the number of anchors that two fingerprints share at their most frequent shift, as ``out``."""
    merged, shifts = f"{out}_merged", f"{out}_shifts"
    other = F.transform(b, lambda x: x.bitwiseOR(F.lit(1 << PLACE_BITS).cast("bigint")))
    df = df.withColumn(merged, F.sort_array(F.concat(F.col(a), other)))
    m = F.col(merged)

    def shift(x: Column, i: Column) -> Column:
        return F.when(_hash_of(x) == _hash_of(F.get(m, i + 1)), F.get(m, i + 1) - x)

    df = df.withColumn(shifts, F.sort_array(F.array_compact(F.transform(m, shift))))

    def add(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    none = F.struct(F.lit(0).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return df.withColumn(out, F.aggregate(shifts, none, add, lambda acc: acc["most"])).drop(merged, shifts)


def likeness(a: Column, b: Column, matches: Column) -> Column:
    """Matches as a share of all anchors of both, like Jaccard's; of two empty fingerprints 1."""
    whole = F.size(a) + F.size(b) - matches
    return F.when(whole > 0, matches / whole).otherwise(F.lit(1.0)).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, text, fingerprint for each row. Null texts are empty and have an empty fingerprint, as blank ones have."""
    units = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("units", unit_hashes(F.col("text")))
    return with_anchors(units, "units", "fingerprint", k, s)


def _listed(values: list[int]) -> Column:
    """A constant array, which the optimiser folds into one value."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _parts(keys: DataFrame, n: int) -> Column:
    """A column with the part, of about ``n`` with as many rows each, of a row with ``key`` and ``mix``; earlier rows, larger part.

    Rows are ordered by falling key, then by ``mix``, a number of 31 bits. The bounds are quantiles of
    the key; a key that several of them fall on has a range of its own, dealt into parts by ``mix``.
    """
    bounds = Counter(keys.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 20 * n)).first()[0] or [])
    cuts, width = [], []  # keys up to each cut are a range, of so many parts
    for b, times in sorted(bounds.items()):
        if times > 1 and b > _LAST and (not cuts or cuts[-1] < b - 1):
            cuts.append(b - 1)
            width.append(1)
        cuts.append(b)
        width.append(times + 1 if times > 1 else 1)
    width.append(1)
    if not cuts:
        return F.lit(0).cast("bigint")
    below = [0, *accumulate(width[:-1])]
    limits = _listed(cuts)
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    beyond = lambda at, step: (at + step <= len(cuts)) & (F.get(limits, at + step - 1) < F.col("key"))
    index = F.aggregate(steps, F.lit(0), lambda at, step: F.when(beyond(at, step), at + step).otherwise(at))
    place = F.struct(F.get(_listed(below), index).alias("below"), F.get(_listed(width), index).alias("width"))
    sub = lambda p: p["below"] + p["width"] - 1 - F.shiftright(F.col("mix") * p["width"], 31)
    return F.get(F.transform(F.array(place), sub), 0)


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """doc_id, text, next_text, fingerprint, next_fingerprint: each row with its successor by descending id; the last row's is the first.

    Rows are dealt out by ranges of ids, and within an id of many rows (such as null) by a hash of the
    text; each part also gets a copy of the next part's first row, so that no task orders the table.
    Null ids come last; rows of equal id are ordered by a hash of their text. A single row is its own
    successor.
    """
    spark = docs.sparkSession
    n = min(max(16, RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_LAST)).cast("bigint"))
    keyed = keyed.withColumn("digest", F.xxhash64("text")).withColumn("mix", F.pmod("digest", F.lit(1 << 31)))
    keyed = keyed.withColumn("part", _parts(docs.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("bigint").alias("key")), n)).withColumn("guest", F.lit(False))
    # The first row of each part, and the part before it, which gets its copy.
    place = F.struct(F.bitwise_not("key").alias("key"), "mix", "digest")
    heads = keyed.groupBy("part").agg(F.min(place).alias("head"))
    order = Window.orderBy(F.desc("part"))
    last = F.last("part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.bitwise_not("head.key").alias("head_key"), F.col("head.digest").alias("head_digest"), F.coalesce(F.lag("part").over(order), last).alias("host"))
    heads = written(heads.coalesce(1), "heads")
    first = Window.partitionBy("host").orderBy("text")
    guests = keyed.join(F.broadcast(heads), (F.col("key") == F.col("head_key")) & (F.col("digest") == F.col("head_digest"))).withColumn("nth", F.row_number().over(first)).where("nth = 1")
    guests = guests.select("doc_id", "text", "key", "digest", "mix", F.col("host").alias("part"), F.lit(True).alias("guest"))
    dealt = keyed.unionByName(guests).repartition("part").withColumn("units", unit_hashes(F.col("text")))
    dealt = with_anchors(dealt, "units", "fingerprint", k, s)
    order = Window.partitionBy("part").orderBy("guest", F.desc("key"), "mix", "digest")
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("NOT guest")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they and the next document's are, matched by position.

    The edited text replaces the last third (rounded down) by the start of the next document, see
    :func:`next_texts`. Null texts are empty; two empty texts are alike to 1. Texts of any length are read
    whole. Repeated rows are successors of each other. Empty tables give an empty result; other columns
    are ignored.
    """
    n, cut = F.col("n_chars"), F.floor(F.col("n_chars") / 3)
    rows = next_texts(docs, id_col, text_col, k, s).withColumn("n_chars", F.char_length("text").cast("bigint"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - cut).cast("int")), F.substring("next_text", F.lit(1), cut.cast("int"))))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "next_fingerprint", unit_hashes(F.col("edited")).alias("edited_units"))
    rows = with_anchors(rows, "edited_units", "edited_fingerprint", k, s)
    rows = with_matches(with_matches(rows, "fingerprint", "edited_fingerprint", "match_edited"), "fingerprint", "next_fingerprint", "match_next")
    near = lambda other, m: likeness(F.col("fingerprint"), F.col(other), F.col(m))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        near("edited_fingerprint", "match_edited").alias("near_edited"), near("next_fingerprint", "match_next").alias("near_next"),
    )
