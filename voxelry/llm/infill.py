"""Fill-in-middle: a text is cut at two units and its parts change places.

Units are rows: the matches of a text are exploded with their ordinals. Units that no requested cut
separates, RUN at most, are added up before the shuffle; a window over each text's runs gives the characters before
each, cut requests meet the run that begins at their ordinal, and the offsets of a text become one row. The
texts meet their offsets by id and hash, and substring cuts them. A text is shuffled once, and not sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.llm.common import free_names, text_or_empty, written

UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many are changed, and of those so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
#: Units that are added up before the shuffle.
RUN = 256


def _drawn(doc_id: Column, k: int, seed: int) -> Column:
    """The k-th group of 8 digits of the seeded SHA-256 of the id, as an integer; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def form(doc_id: Column, text: Column, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> Column:
    """``plain``, ``spm`` or ``psm``."""
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (text == "") | marked | (_drawn(doc_id, 2, seed) % 100 >= changed)
    return F.when(plain, "plain").when(_drawn(doc_id, 3, seed) % 100 < suffix_first, "spm").otherwise("psm")


def keyed(docs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Adds two hashes of id and text, together the key of a row; rows of the same key agree in both."""
    return docs.withColumns({name: F.xxhash64(F.lit(k), "doc_id", "text") for k, name in enumerate((a, b))})


def offsets(docs: DataFrame, seed: int = 1, run: int = RUN) -> DataFrame:
    """a, b, n, p and q: the units of a text, and the characters before its first and its second cut.

    ``docs`` has a, b, doc_id and text, none of them empty; rows of the same key give one row. A text of any length
    leaves its task as sums by run.
    """
    units = docs.select("a", "b", "doc_id", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units")).withColumn("n", F.size("units").cast("bigint"))
    h1, h2 = (_drawn(F.col("doc_id"), k, seed) % (F.col("n") + 1) for k in (0, 1))
    units = units.withColumns({"lo": F.least(h1, h2), "hi": F.greatest(h1, h2)})
    # The outer form explodes the same rows, as no text is empty, and keeps the planner from matching twice.
    rows = units.select("a", "b", "n", "lo", "hi", F.posexplode_outer("units").alias("at", "unit"))
    # A run begins at the last of: the unit's own multiple of ``run``, and the cuts up to it.
    cut = lambda c: F.when(F.col(c) <= F.col("at"), F.col(c)).otherwise(F.lit(0))
    first = F.greatest(F.col("at") - F.col("at") % run, cut("lo"), cut("hi")).cast("bigint")
    text = ["a", "b", "n", "lo", "hi"]
    runs = rows.groupBy(*text, first.alias("first")).agg(F.sum(F.char_length("unit")).alias("chars"), F.count(F.lit(1)).alias("rows"), F.max("at").alias("last"))
    # A row that stands there r times gives each unit r times.
    once = runs.withColumn("chars", (F.col("chars") / (F.col("rows") / (F.col("last") - F.col("first") + 1))).cast("bigint"))
    by = Window.partitionBy("a", "b")
    summed = once.select(*text, "first", (F.sum("chars").over(by.orderBy("first")) - F.col("chars")).alias("before"), F.sum("chars").over(by).alias("all"))
    summed = written(summed, "runs")
    requests = summed.where("first = 0").select("a", "b", "n", "all", F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.col(c).alias("first")) for i, c in enumerate(("lo", "hi"))])).alias("r")).select("a", "b", "n", "all", "r.*")
    met = requests.join(summed.select("a", "b", "first", "before"), ["a", "b", "first"], "left")
    # No run begins behind the last unit: all characters are before such a cut.
    at = F.coalesce("before", "all")
    return met.groupBy("a", "b", "n").agg(F.max(F.when(F.col("cut") == 0, at)).alias("p"), F.max(F.when(F.col("cut") == 1, at)).alias("q"))


def transform(docs: DataFrame, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, run: int = RUN) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output; columns of these names give way.

    One row per row. Null and empty texts are plain, with no units, and so are texts that hold a marker; prefix_chars
    and middle_chars are null in plain rows. A null id draws like an empty number. Rows that repeat id and text are cut
    alike. An empty table gives an empty result.
    """
    a, b, n, p, q, kind, clean = free_names(docs, "a", "b", "n", "p", "q", "form", "clean")
    own = docs.withColumn(clean, text_or_empty()).withColumn(kind, form(F.col("doc_id"), F.col(clean), seed, changed, suffix_first))
    kept = [F.col(c) for c in docs.columns if c.lower() not in ("n", "form", "prefix_chars", "middle_chars", "output")]
    plain = own.where(F.col(kind) == "plain").withColumns({n: F.size(F.regexp_extract_all(clean, F.lit(UNIT), F.lit(0))).cast("bigint"), p: F.lit(None).cast("bigint"), q: F.lit(None).cast("bigint")})
    cut = keyed(own.where(F.col(kind) != "plain"), a, b)
    found = offsets(keyed(own.where(F.col(kind) != "plain").select("doc_id", F.col(clean).alias("text"))), seed, run).toDF(a, b, n, p, q)
    cut = cut.join(found.hint("shuffle_hash"), [a, b])
    prefix, middle, suffix = F.substring(clean, F.lit(1), F.col(p).cast("int")), F.substring(clean, (F.col(p) + 1).cast("int"), (F.col(q) - F.col(p)).cast("int")), F.substring(clean, (F.col(q) + 1).cast("int"), F.char_length(clean))
    output = F.when(F.col(kind) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)).when(F.col(kind) == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)).otherwise(F.col(clean))

    def shown(rows: DataFrame, out: Column) -> DataFrame:
        return rows.select(*kept, F.col(n).alias("n"), F.col(kind).alias("form"), F.col(p).alias("prefix_chars"), (F.col(q) - F.col(p)).alias("middle_chars"), out.alias("output"))

    return shown(cut, output).unionByName(shown(plain, F.col(clean)))


def restored(output: Column, kind: Column) -> Column:
    """The text, from its output and form alone. A changed text holds no marker, so each stands once in its output."""
    p, s, m = (F.instr(output, x) for x in (PREFIX, SUFFIX, MIDDLE))
    middle = F.substring(output, m + 3, F.char_length(output))
    psm = F.concat(F.substring(output, F.lit(4), s - 4), middle, F.substring(output, s + 3, m - s - 3))
    spm = F.concat(F.substring(output, p + 3, m - p - 3), middle, F.substring(output, F.lit(4), p - 4))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(output)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), g AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), p AS (
  SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
