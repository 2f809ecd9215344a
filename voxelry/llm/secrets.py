"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits, then checksums.

Tokens of formats that carry a checksum start at a character that no letter or digit is in front of. Runs
of hex digits have no keyword of their own: a copy of the text in which each hex digit is one
letter is searched for that letter sixteen times.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelry.llm.common import small_batches, texts

# The patterns, lengths and kinds of the base scan, then published token formats.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
GITHUB = re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(rb"(?<![A-Za-z0-9])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
GRAFANA = re.compile(rb"(?<![A-Za-z0-9])(glsa_[A-Za-z0-9]{32})_([0-9a-f]{8})(?![A-Za-z0-9])")
AGE = re.compile(rb"(?<![A-Za-z0-9])AGE-SECRET-KEY-1([QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{58})(?![A-Za-z0-9])")
KINDS = ("assign", "access", "hex", "github", "npm", "grafana", "age")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "grafana": ("glsa_",), "age": ("age-secret-key-1",)}
BECH32 = b"QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_AS_CLASS = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN = b"x" * LEAST_HEX


def base62_crc(payload: bytes) -> bytes:
    """The six digits that such tokens end in: CRC-32 of the payload in base 62."""
    n, out = zlib.crc32(payload), b""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE62[digit : digit + 1] + out
    return out


def bech32_holds(prefix: bytes, data: bytes) -> bool:
    """Whether the last six of the data's characters are their checksum (BIP 173)."""
    values = [c >> 5 for c in prefix.lower()] + [0] + [c & 31 for c in prefix.lower()] + [BECH32.index(c) for c in data]
    check = 1
    for v in values:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, words in WORDS.items():
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _match(kind: str, raw: bytes, at: int) -> tuple[int, bool] | None:
    """End of the kind's match at ``at`` and whether it passes; None without a match."""
    if kind == "assign":
        m = ASSIGN.match(raw, at)
        return m and (m.end(), len(m[2]) >= LEAST_ASSIGN)
    if kind == "access":
        m = ACCESS.match(raw, at)
        return m and (m.end(), m.end() - at >= LEAST_ACCESS)
    if kind == "grafana":
        m = GRAFANA.match(raw, at)
        return m and (m.end(), b"%08x" % zlib.crc32(m[1]) == m[2])
    if kind == "age":
        m = AGE.match(raw, at)
        return m and (m.end(), bech32_holds(b"age-secret-key-", m[1]))
    m = (GITHUB if kind == "github" else NPM).match(raw, at)
    return m and (m.end(), base62_crc(m[1]) == m[2])


def scan(text: str, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret by start, then kind as listed; in code points, end exclusive.

    Per kind, matches are leftmost and do not overlap. Matches that are too short or whose checksum is
    wrong are dropped, but hide what they cover, as when a text is searched from left to right.
    """
    raw = text.encode("utf-8", "surrogatepass")
    spans: list[tuple[int, int, int]] = []
    done = dict.fromkeys(WORDS, 0)
    for last, (kind, n) in words.iter(raw.lower().decode("latin-1")):
        at = last - n + 1
        if at >= done[kind] and (m := _match(kind, raw, at)):
            done[kind] = m[0]
            if m[1]:
                spans.append((at, KINDS.index(kind), m[0]))
    classes = raw.translate(_AS_CLASS)
    at = classes.find(_RUN)
    while at >= 0:
        end = HEX.match(raw, at).end()
        spans.append((at, KINDS.index("hex"), end))
        at = classes.find(_RUN, end)
    spans.sort()
    if len(raw) == len(text):
        return [(KINDS[k], a, b) for a, k, b in spans]
    places = sorted({x for a, _, b in spans for x in (a, b)})
    points, seen, n = {}, 0, 0
    for x in places:
        n += len(raw[seen:x].decode("utf-8", "surrogatepass"))
        seen, points[x] = x, n
    return [(KINDS[k], points[a], points[b]) for a, k, b in spans]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the array of its secrets (kind, start, stop, value), one row per input row.

    Null texts are empty; texts without a secret have an empty array; texts of any length are searched
    whole. Repeated rows are kept and searched alike; an empty table gives an empty result; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            found = [[{"kind": k, "start": a, "stop": b, "value": x[a:b]} for k, a, b in scan(x, words)] for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, schema)], ["doc_id", "secrets"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scanned, "doc_id bigint, secrets array<struct<kind:string,start:bigint,stop:bigint,value:string>>")


def digested(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256 (of the base kinds), spans from what :func:`scan_secrets` gives, row by row.

    Without secrets the counts are 0, the digest is that of the empty string and spans is empty.
    """
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("secrets", said), ",").alias("spans"),
    )
