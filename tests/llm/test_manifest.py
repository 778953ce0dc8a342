"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from millrace.llm import merkle
from tests.llm.test_dedup import SF

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos string, key string, level int"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    n = None if row.n_chars is None else row.n_chars + add
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, n, row.text)))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, place):
    for level in levels[:-1]:
        other = place ^ 1
        yield (place & 1, level[other]) if other < len(level) else (0, "")
        place >>= 1


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by[lang].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {lang: tree([leaf(r) for r in by[lang]]) for lang in langs}
    over = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, r in enumerate(by[lang]):
            path = [*way(trees[lang], place), *way(over, k)]
            touched = r.n_chars is not None and zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 7 == 0
            now = leaf(r, int(touched))
            for left, sibling in path:
                now = digest(sibling, now) if left else digest(now, sibling)
            out.append((r.doc_id, leaf(r), trees[lang][-1][0], over[-1][0], digest(*(s for _, s in path)), now, now == over[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


ODD = [
    (None, None, None, None, None, "x", "k", 1), (None, None, None, 3, "", None, None, None), (5, "s", "", 0, "a", None, None, None), (5, "s", "", 0, "a", None, None, None),
    (5, "t", "", 0, "a", None, None, None), (-1, "s", "de", None, "Größe 😀 " * 20_000, None, None, None), *((k, "s", "ž" if k % 3 else "en", k, f"text {k}", None, None, None) for k in range(40)),
]


@pytest.mark.parametrize("step", [1, 2, 10])
def test_odd_rows_give_the_same_tree_at_any_step(spark, step):
    docs = spark.createDataFrame(ODD, SCHEMA)
    got = merkle.manifest(docs, step=step).select(*COLUMNS).collect()
    assert ordered(got) == ordered(plain(docs.collect()))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_few_rows(spark, n):
    docs = spark.createDataFrame([(k, "s", "en", 1, "x", None, None, None) for k in range(1, n + 1)], SCHEMA)
    assert ordered(merkle.manifest(docs).select(*COLUMNS).collect()) == ordered(plain(docs.collect()))


def test_proofs_lead_to_the_root(spark):
    docs = spark.createDataFrame([(k, "s", f"l{k % 5}", None, "x", None, None, None) for k in range(50)], SCHEMA)
    for row in merkle.manifest(docs, step=2).collect():
        path = [s[:1].encode() + bytes.fromhex(s[1:]) for s in row.proof]
        assert row.verified and merkle.fold(bytes.fromhex(row.leaf), path).hex() == row.root
        assert f"={row.subroot}" in row.proof


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert ordered(merkle.manifest(docs).select(*COLUMNS).collect()) == ordered(plain(docs.collect()))


def test_heights():
    assert [merkle.height(n) for n in (1, 2, 3, 4, 5, 8, 9)] == [0, 1, 2, 2, 3, 3, 4]
