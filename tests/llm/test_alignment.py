"""Aligned tokens against the libraries and plain loops."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment
from millrace.llm.queries import op13_token_alignment
from tests.llm.test_dedup import SF

HOW = alignment.Vocabularies(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """The byte of each character of a byte-level vocabulary: printable ones are themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(c): b for c, b in [*zip(own, own, strict=True), *((256 + k, b) for k, b in enumerate(rest))]}


def plain(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum and digest of each text."""
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=HOW.model)
    table, groups_of, holders = byte_of(), [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            raw_a = [bytes(table[c] for c in a_lib.id_to_token(i)) for i in a]
            raw_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            whole = (" " + text).encode()
            if b"".join(raw_a) == whole == b"".join(raw_b):
                ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
                low = 0
                for end in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(a, ends_a, strict=True) if low < e <= end], [i for i, e in zip(b, ends_b, strict=True) if low < e <= end]))
                    low = end
        groups_of.append(groups)
        holders.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = {}
    for (x, _), n in holders.items():
        top[x] = max(top.get(x, 0), n)
    for groups in groups_of:
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        whole = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        yield (
            sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(holders[p] == top[p[0]] for p in links),
            sum(holders[p] for p in links), hashlib.sha256(whole.encode()).hexdigest() if groups else "",
        )


def found(rows):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows]


ODD = [
    None, "", " ", "  ", "\n\n\t", "a", " lead", "trail  ", "x▁y", "<|endoftext|></s><s><unk><0x41>", "Größe 😀🏽 日本語テキスト", "e\u0301 \u00a0 \u200b", "aaaa" * 3000, "1234567890" * 50,
    "http://www.example.com/a?b=c", "The same.", "The same.", "the Same.", "\x00\x01", "ﬁ ½ Ⅷ", "word " * 4_000, "🙂" * 400, "𝔘𝔫𝔦" * 50, " \u3000 ", "\ud7ff", "a\r\nb",
]


def test_odd_texts_against_plain_loops(spark):
    docs = spark.createDataFrame([(None if k == 4 else k, t, "x", 1) for k, t in enumerate(ODD)], "doc_id long, text string, block string, pair int").repartition(3)
    rows = alignment.align(docs, HOW).collect()
    assert sorted(found(rows)) == sorted(plain(ODD))
    by_id = {r.doc_id: r for r in rows}
    assert set(by_id) == {None if k == 4 else k for k in range(len(ODD))}
    assert [found([by_id[k]])[0] for k in (8, 14, 21)] == [list(plain(ODD))[k] for k in (8, 14, 21)]


def test_large_groups_by_distinct_identifiers(monkeypatch):
    monkeypatch.setattr(alignment, "LARGE", 1)
    aligner = alignment.Aligner(HOW)
    texts = [t for t in ODD if t]
    by_distinct = [(n, p.tolist(), t.tolist()) for _, _, n, _, _, p, t in aligner.align(texts)]
    monkeypatch.setattr(alignment, "LARGE", 1 << 40)
    assert by_distinct == [(n, p.tolist(), t.tolist()) for _, _, n, _, _, p, t in aligner.align(texts)]


def test_small_blocks_give_the_same(spark, monkeypatch):
    texts = [f"{w} is number {k % 5}." for k in range(60) for w in ("This", "That", "Straße")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = alignment.align(docs, HOW).orderBy("doc_id").collect()
    assert found(rows) == list(plain(texts))


def test_components_against_cuts():
    rng = np.random.default_rng(7)
    for _ in range(200):
        a, b = rng.integers(1, 5, 30), rng.integers(1, 5, 30)
        gap = int(a.sum() - b.sum())
        a, b = (a, np.append(b, gap)) if gap > 0 else (np.append(a, -gap), b) if gap < 0 else (a, b)
        ends = np.intersect1d(np.cumsum(a), np.cumsum(b))
        got = alignment.components(a, b)
        for sizes, group in zip((a, b), got, strict=True):
            assert group.tolist() == np.searchsorted(ends, np.cumsum(sizes)).tolist()


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), HOW).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    rows = op13_token_alignment(spark, str(SF)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in docs]
    assert found(rows) == list(plain([r.text for r in docs]))
