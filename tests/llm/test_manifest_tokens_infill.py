"""Manifest, token counts and fill-in-middle held against plain Python, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from voxelry.llm import infill, merkle, queries, tokencount

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, at int, tree string, path string, a int, n int, form string, p string, output string, n_bytes int, tampered int, block int"
EXTRA = ("d", 1, "t", "x", 2, 3, "f", "p", "o", 4, 5, 6)


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def _odd_rows():
    text = "one two, three\nfour é 日本語 <end> 12 "
    rows = [
        (1, None, "en", "a", 3), (2, "", None, "a", None), (3, " \t\n", "en", None, 3), (4, "Lorem ipsum, dolor. " * 20000, "fr", "b", 1), (5, text, "en", "a", 9), (5, text, "en", "a", 9), (5, text + "!", "en", "a", 9),
        (None, text, "en", "b", 9), (None, text, "en", "b", 9), (6, "has <S> inside", "", None, 2), (7, "<P", "de", "b", 2), (8, "<|endoftext|>x <|endoftext|>", "en", "c", 2**63 - 1), (None, None, None, None, None),
        (9, "a" * 5000, "zz", "c", 0), (10, "<<<>>> P> S M>", "en", "c", 1), (-4, "😀😀 ok", "É", "c", 1),
    ]
    return rows + [(100 + i, f"w{i} " * (i % 7), "en", "x", i) for i in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, _odd_rows()).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(nodes, fanout):
    """The root, and each leaf's siblings with their places, level by level."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append((nodes[run:p], nodes[p + 1 : run + fanout]))
        nodes, at = [_h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)], [p // fanout for p in at]
    return nodes[0], paths


def _manifest(rows, fanout):
    trees = {}
    for doc_id, text, lang, source, n in rows:
        own = [_h(*map(_field, (doc_id, source, lang, m, text))) for m in (n, None if n is None else n + 1)]
        bad = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        trees.setdefault(lang, []).append((doc_id, own[0], own[bad]))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    tops, found = [], []
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        top, paths = _tree([r[1] for r in trees[name]], fanout)
        tops.append(top)
        found += [(len(tops) - 1, r, p) for r, p in zip(trees[name], paths, strict=True)]
    root, above = _tree(tops, fanout)
    for i, (doc_id, own, start), path in found:
        now, path = start, path + above[i]
        for before, after in path:
            now = _h(*before, now, *after)
        yield doc_id, own, tops[i], root, _h(*[x for before, after in path for x in before + after]), now, now == root


@pytest.mark.parametrize(("fanout", "depth"), [(2, 10), (2, 2), (3, 1), (4, 2)])
def test_manifest_equals_plain_trees(odd, fanout, depth):
    got = merkle.manifest(odd, fanout, depth, merkle.seventh(odd["doc_id"])).collect()
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    want = list(_manifest(_odd_rows(), fanout))
    assert order(got) == order(want)
    assert {r[6] for r in want} == {True, False}


def test_manifest_of_an_empty_table(none):
    assert merkle.manifest(none).count() == 0


def test_block_finds_siblings_and_folds():
    draw = np.random.default_rng(3)
    for fanout in (2, 3, 5):
        for n in (1, 2, 3, 7, 25, 26):
            leaves = [_h(str(draw.random())) for _ in range(n)]
            matrix = np.frombuffer("".join(leaves).encode(), np.uint8).reshape(-1, merkle.HEX)
            block, (root, paths) = merkle.Block(matrix, fanout, None), _tree(leaves, fanout)
            assert block.top.decode() == root and {x.tobytes().decode() for x in block.folded(matrix)} == {root}
            assert block.siblings() == ["".join(x for b, a in p for x in b + a).encode() for p in paths]
            assert [[(s["before"].decode(), s["after"].decode()) for s in p] for p in block.paths()] == [[("".join(b), "".join(a)) for b, a in p] for p in paths]


@pytest.mark.parametrize("name", ["op11_merkle", "op13_fill_in_middle"])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = queries.QUERIES[name](spark, sf_dir)
    found = duck.execute(queries.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(columns).collect()))) == sorted(map(str, found.fetchall()))


# Token counts


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokencount.vocabulary_path())
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = queries.op12_token_counts(spark, sf_dir).toPandas().set_index("doc_id")
    texts = docs.text.fillna("").tolist()
    for doc_id, text, n in zip(docs.doc_id, texts, library(texts), strict=True):
        assert tuple(got.loc[doc_id]) == (len(text.encode()), n, n > 512)


def test_counts_of_odd_texts(odd, none, library):
    got = tokencount.count_tokens(odd).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(_odd_rows(), library([r[1] or "" for r in _odd_rows()]), strict=True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and tokencount.count_tokens(none).count() == 0


def test_merges_of_random_and_repeated_characters(library):
    counter, draw = tokencount.Counter(tokencount.vocabulary_path()), random.Random(5)
    texts = ["a" * n for n in (1, 2, 3, 5, 64, 4097)] + ["ab" * 999, "  \n\n  a ", "don't 'S I'll", "\x1c\x85\xa0 a", "日本語" * 500, "<|endoftext|", "é" * 77]
    alphabet = "aAbzéß日0189 \n\t'.!,<|>_́😀stremvld"
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(80))) for _ in range(3000)]
    assert counter.count(texts) == library(texts)


def test_every_code_point_is_cut_like_the_library(library):
    counter = tokencount.Counter(tokencount.vocabulary_path())
    texts = ["".join(f"a{chr(i)}b {chr(i)} 1{chr(i)}2" for i in range(lo, lo + 256) if not 0xD800 <= i <= 0xDFFF) for lo in range(0, 0x30000, 256)]
    assert counter.count(texts) == library(texts)


def test_a_vocabulary_in_which_two_merges_make_one_symbol_is_refused():
    with pytest.raises(ValueError, match="same symbol"):
        tokencount.Merges([("a", "b"), ("b", "c"), ("a", "bc"), ("ab", "c")])


# Fill in the middle


def _infill(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("run", [1, 4, 256])
def test_infill_equals_plain_cuts(spark, odd, run):
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    found = infill.transform(odd, run=run)
    got, want = [tuple(r) for r in found.select(columns).collect()], [_infill(r[0], r[1] or "") for r in _odd_rows()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    assert found.where(infill.restored(found["output"], found["form"]) != infill.text_or_empty()).count() == 0
    assert set(found.columns) == set(odd.columns) | set(columns) | {"prefix_chars", "middle_chars"}


def test_infill_of_texts_with_pieces_of_markers(spark):
    draw = random.Random(9)
    rows = [(i, "".join(draw.choice("<>PSM a") for _ in range(draw.randrange(1, 12))), "en", "a", 1) for i in range(400)]
    found = infill.transform(_docs(spark, rows))
    want = [_infill(r[0], r[1]) for r in rows]
    assert sorted(map(str, found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect())) == sorted(
        str(r) for r in spark.createDataFrame(want, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").collect()
    )
    assert found.where(infill.restored(found["output"], found["form"]) != found["text"]).count() == 0


def test_infill_of_empty_table(none):
    assert infill.transform(none).count() == 0
