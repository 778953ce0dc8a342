"""Encoding, counting and packing against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from millrace.llm import packing, sp_codec, token_counts
from millrace.llm.cutting_stock import plan, solve
from millrace.llm.queries import how_to_pack

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "▁", "a▁b", "\n", "a\nb. c,d", ".", "...", "<s></s><0x41>", "<|endoftext|>", "x" * 3000, "the " * 2000, "日本語 漢字😀", "\x00\t"]


def texts(n=1500, seed=4):
    random.seed(seed)
    bits = [*"abetion .,\n▁  é漢😀\t<s>)/\"'…²_0123456789-—", "</s>", "<0x0A>", "  ", "...", ").", "the ", " ▁"]
    return ODD + ["".join(random.choices(bits, k=random.randint(0, 60))) for _ in range(n)]


def test_codec_equals_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in sp_codec.encode(df, MODEL).collect()}
    back = {r.doc_id: r.text for r in sp_codec.decode(sp_codec.encode(df, MODEL), MODEL).collect()}
    for i, t in rows:
        want = [*lib.encode(t or ""), lib.eos_id()]
        assert got[i].ids == want and got[i].agreed
        assert back[i] == lib.decode(want)
    digests = sp_codec.codec_digests(df.limit(0), MODEL)
    assert digests.count() == 0 and "decoded_sha256" in digests.columns


def test_both_forms_of_the_agenda_merge_alike():
    order = sp_codec.Codec(MODEL).order
    random.seed(7)
    for t in [*texts(800), "the" * 15, "aaaaaaaaaaaaaaaa", "▁▁▁▁▁▁▁▁"]:
        chunk = (t or "").replace(" ", "▁")[:300]
        assert sp_codec._by_list(chunk, order) == sp_codec._by_heap(chunk, order)


def test_digests_of_the_round_trip(spark):
    import hashlib

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(None, "a b"), (1, None), (1, "a b"), *((k + 2, t) for k, t in enumerate(texts(100)))]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = [*lib.encode(t or ""), lib.eos_id()]
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), True))
    got = sp_codec.codec_digests(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_counts_equal_the_unigram_model(spark):
    v = token_counts.Vocabulary(MODEL)
    ref = Tokenizer(models.Unigram(list(zip(v.pieces, v.scores, strict=True)), unk_id=0, byte_fallback=True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    rows = list(enumerate(texts(600)))
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL).collect()}
    for i, t in rows:
        assert got[i].n_tokens == len(ref.encode(t or "", add_special_tokens=False).ids), t


def counted_plainly(text, v):
    """The best score of all segmentations and its pieces, by every start of every end; ties go to the earliest start."""
    if not text:
        return 0, 0, 0.0
    text = text.replace(" ", "▁")
    text = text if text[0] == "▁" else "▁" + text
    score = {p: v.scores[i] for i, p in enumerate(v.pieces)}
    unknown, total, tokens = min(v.scores) - 10, 0.0, 0
    for word in ["▁" + w for w in text[1:].split("▁")]:
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            options = [(best[a][0] + score[word[a:end]], best[a][1] + 1) for a in range(end) if word[a:end] in score]
            if word[end - 1] not in score:
                options.append((best[end - 1][0] + unknown, best[end - 1][1] + len(word[end - 1].encode())))
            top = max(x for x, _ in options)
            best.append(next(x for x in options if x[0] == top))
        total, tokens = total + best[-1][0], tokens + best[-1][1]
    return tokens, text.count("▁"), total


def test_counts_agree_with_all_segmentations(spark):
    v = token_counts.Vocabulary(MODEL)
    rows = [(None, "null id"), (1, "twice"), (1, "twice"), *((k + 2, t) for k, t in enumerate(texts(150)) if len(t or "") < 500)]
    df = spark.createDataFrame([(i, t, 0, 0.5) for i, t in rows], "doc_id long, text string, n_tokens int, score double").repartition(2)
    got = sorted((tuple(r) for r in token_counts.token_counts(df, MODEL).collect()), key=str)
    assert got == sorted([(i, *counted_plainly(t, v)) for i, t in rows], key=str)
    assert token_counts.token_counts(df.limit(0), MODEL).columns == ["doc_id", "n_tokens", "n_words", "score"] and token_counts.token_counts(df.limit(0), MODEL).count() == 0


def test_memory_is_bounded_in_entries_and_bytes():
    from millrace.llm.common import Memory

    held = Memory(len, 10, 100)
    assert [held["x" * 30] for _ in range(3)] == [30] * 3 and held.new == ["x" * 30] and held.held == 30
    held.trim()
    assert len(held) == 1 and not held.new
    assert held["y" * 80] == 80
    held.trim()
    assert not held and held.held == 0
    assert [held[str(k)] for k in range(11)] and len(held) == 11
    held.trim()
    assert not held


def test_a_disagreeing_chunk_gives_the_library_s_identifiers():
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    codec = sp_codec.Codec(MODEL)
    codec._ids = lambda chunk: ([5], "5")  # an encoder that is wrong
    codec.known.compute = codec._ids
    texts = ["the river. the house", ""]
    assert list(codec.encode(texts)) == [([*lib.encode(t), lib.eos_id()], " ".join(map(str, [*lib.encode(t), lib.eos_id()])), not t) for t in texts]


def test_ranks_equal_the_json_vocabulary():
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    how = how_to_pack()
    enc = packing.encoder(how.vocabulary, how.pattern)
    for t in texts(400):
        assert enc(t or "").tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["mixed", "one length", "wide", "few"])
def test_plan_places_every_item_once(kind):
    rng = np.random.default_rng(1)
    length = {"mixed": lambda: rng.lognormal(6.6, 0.9, 3000).astype(int) % 2048 + 1, "one length": lambda: np.full(5000, 1300), "wide": lambda: rng.integers(1100, 1500, 4000), "few": lambda: np.array([2047, 1, 64])}[kind]()
    size = -(-length // 8)
    counts = np.bincount(size, minlength=257)[1:]
    placed, n = plan(counts, 256, 8)
    full, cover = np.zeros(n, int), {}
    for p in placed:
        k = np.arange(p.run.count)
        np.add.at(full, p.sequence + (p.index + k) % p.times, p.run.size)
        for i in range(p.run.first, p.run.first + p.run.count):
            cover.setdefault((p.run.origin, i), []).append((p.run.start, p.run.size))
    assert full.max() <= 256 and len(cover) == len(length)
    for (origin, _), parts in cover.items():
        at = 0
        for start, width in sorted(parts):
            assert start == at and (start % 8 == 0)
            at += width
        assert at == origin
    if len(length) > 1000:
        assert length.sum() / 2048 / n > 0.985
    # against the linear program: no plan needs fewer sequences than its bound, this one few more than its value
    patterns, _ = solve(counts, 256, 8)
    value = sum(times for _, times in patterns)
    assert all(sum(a * (k + 1) for k, a in enumerate(p)) <= 256 for p, _ in patterns)
    assert size.sum() / 256 <= value * (1 + 1e-6) and value * (1 - 5e-3) - 1 <= n <= value * 1.01 + len(patterns)


@pytest.mark.parametrize("tokens", [16, 49, 130, 250])
def test_short_texts_leave_little_empty(spark, tokens):
    """Texts of one length, with the end identifier; the fill is that of whole pieces in a sequence, or more."""
    how = how_to_pack()
    df = spark.createDataFrame([(k, " a" * tokens) for k in range(1500)], "doc_id long, text string")
    got = packing.pieces(df, how).collect()
    n = len({r.sequence_id for r in got})
    assert sum(r.length for r in got) == 1500 * (tokens + 1) and n <= -(-1500 // (2048 // (tokens + 1)))


def test_mixed_short_texts_fill_their_sequences(spark):
    random.seed(12)
    df = spark.createDataFrame([(k, " a" * random.randint(3, 200)) for k in range(4000)], "doc_id long, text string").repartition(3)
    got = packing.pieces(df, how_to_pack()).collect()
    assert sum(r.length for r in got) / 2048 / len({r.sequence_id for r in got}) > 0.985
    ends = {}
    for r in got:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_pieces(spark):
    rows = [(None, "null id"), (1, None), (1, "again"), *((k + 2, (t or "") * random.randint(1, 400)) for k, t in enumerate(texts(150)))]
    rows = [(i, t) for i, t in rows]
    how = how_to_pack()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, slot int").repartition(3)
    got = packing.pieces(df, how).collect()
    enc = packing.encoder(how.vocabulary, how.pattern)
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append(np.append(enc(t or ""), 1).astype("<u4"))
    for r in got:
        found = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in found)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for (i, n), parts in by_doc.items():
        if i not in (1, None):
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == n
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= how.tokens
    assert sum(r.length for r in got) == sum(len(x) for xs in ids.values() for x in xs)
    unique = df.filter("doc_id > 1")
    packed = packing.pieces(unique, how)
    joined = packing.sequences(unique, packed, how).collect()
    assert sum(len(r.ids) for r in joined) == sum(len(x) for i, xs in ids.items() if i not in (1, None) for x in xs)


def test_packing_nothing(spark):
    assert packing.pieces(spark.createDataFrame([], "doc_id long, text string"), how_to_pack()).count() == 0


def test_a_counter_holds_no_more_than_its_bytes(spark, monkeypatch):
    """Texts without spaces are one chunk each; what is remembered is trimmed after each text."""
    held = []
    own = token_counts.counter(MODEL)
    monkeypatch.setattr(own.known, "size", 50_000)
    monkeypatch.setattr(type(own.known), "trim", lambda self, trim=type(own.known).trim: (held.append(self.held), trim(self)))
    monkeypatch.setattr(token_counts, "slim", lambda df, *_: df)

    class Frame:
        def mapInArrow(self, run, _):
            texts = [(chr(97 + k % 26) * 10_000 + str(k)).encode() for k in range(60)]
            batch = pa.record_batch({"doc_id": pa.array(range(60), pa.int64()), "text": pa.array(texts, pa.binary())})
            return [row for out in run(iter([batch])) for row in out.to_pylist()]

    rows = token_counts.token_counts(Frame(), MODEL)
    assert len(rows) == 60 and max(held) <= 50_000 + 10_010 and len(held) >= 9
