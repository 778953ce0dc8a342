"""Chat formatting and media archives."""

import hashlib
import json
import math
import zipfile
import zlib
from collections import Counter

import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import chat, media

PARTS = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "~", "\n", "<", "|", ">", chat.OPEN, chat.CLOSE]), st.characters(codec="utf-8")), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(PARTS)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages", [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "messages": [{"content": "a", "role": "user"}]}, "messages", [("system", "s"), ("user", "a")]),
        ({"id": 1, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "shared_conversations", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "", "output": "b"}, "instruction", [("user", "a"), ("assistant", "b")]),
        ({"instruction": "a", "input": "c", "output": "b"}, "instruction", [("user", "a\n\nc"), ("assistant", "b")]),
        ({"prompt": "a", "completion": "b"}, "prompt_completion", [("user", "a"), ("assistant", "b")]),
        ({"question": "a", "answer": "b", "context": "c"}, "question_answer", [("user", "c\n\na"), ("assistant", "b")]),
        ({"role": "user", "text": "a", "turn": 3}, "turn_rows", [("user", "a")]),
        ({"other": 1}, None, []),
        ({"messages": []}, None, []),
    ],
)
def test_layouts(record, layout, turns):
    found = chat.turns_of(json.dumps(record))
    assert (found[0], found[2]) == (layout, turns)


def test_layout_of_no_record():
    assert chat.turns_of(None)[0] is None and chat.turns_of("[1]")[0] is None and chat.turns_of("{")[0] is None


def test_formatting_reads_back(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a"), (2, 0, "user", None), (2, 0, "user", None), (None, 5, None, "x\\n"), (3, 0, "assistant", "é" * 10_000), (3, 1, "assistant", "[INST]"), (3, 2, "odd\nrole", "t")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, place int")
    records = df.select("conv_id", "turn", F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("record"))
    segments = chat.formatted(chat.canonical_turns(records, "conv_id", "record", "turn"))
    got = {r.conv_id: r for r in chat.read_back(segments).collect()}
    texts = {}
    for r in segments.collect():
        texts.setdefault(r.conv_id, []).append((r.offset, r.segment, r.loss_from, r.loss_to))
    for conv in {r[0] for r in rows}:
        turns = sorted([(t, role or "", text or "") for c, t, role, text in rows if c == conv])
        whole = "".join(s for _, s, _, _ in sorted(texts[conv]))
        loss = "".join(chat.unescape(whole[a:b]) for _, _, a, b in sorted(texts[conv]) if a is not None)
        assert loss == "".join(x for _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (conv, len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), len(whole))
        assert tuple(got[conv]) == want
    assert chat.read_back(chat.formatted(chat.canonical_turns(records.limit(0), "conv_id", "record", "turn"))).count() == 0


def test_media_round_trip(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (None, "x" * 64), (5, "é" * 40_000), (5, "hello")]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, media binary").repartition(3)
    got = media.media_features(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t or "" for i, t in rows if i == r.doc_id and len((t or "").encode()) == r.n_bytes).encode()
        payload = text + bytes(-len(text) % 64 or (0 if text else 64))
        assert r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = media.encode_wav(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert len({(r.feature, r.media_sha256) for r in got if r.n_bytes == 5}) == 1
    assert media.media_features(df.limit(0)).count() == 0


def feature_plainly(samples):
    mean = sum(samples) / len(samples)
    rms = math.sqrt(sum(x * x for x in samples) / len(samples))
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(samples, samples[1:], strict=False))
    entropy = -sum(n / len(samples) * math.log2(n / len(samples)) for n in Counter(samples).values())
    return [mean, rms, crossings, entropy]


def test_features_agree_with_plain_sums():
    for text in (b"", b"a", b"hello", "é日本".encode() * 50, bytes(range(256)) * 3, b"\xff" * 64):
        samples = media.payload_of(text)
        parts = dict(x.split("=") for x in media.feature_of(samples).split(";"))
        assert list(parts) == ["mean", "rms", "crossings", "entropy"]
        assert [float(x) for x in parts.values()] == pytest.approx(feature_plainly(samples), abs=6e-5)


def test_ranges_read_every_member_once(spark, tmp_path):
    df = spark.createDataFrame([(k, str(k) * (k % 50)) for k in range(500)], "doc_id long, text string")
    folder = f"file://{tmp_path}/a"
    from millrace.llm.common import slim

    media.store(slim(df.repartition(3)), folder, archive_bytes=4_000).write.format("noop").mode("overwrite").save()
    assert not [p for p in (tmp_path / "a").iterdir() if not p.name.endswith(".zip")]
    for size in (64, 700, 1 << 20):
        assert sorted(r.doc_id for r in media.load(spark, folder, rangeBytes=size, batchBytes=500).collect()) == list(range(500))


def test_a_member_is_tried_again_by_itself(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("1/2/0.wav", b"abc" * 100)
        z.writestr("2/2/1.wav", b"xyz" * 100)
    with zipfile.ZipFile(path) as z:
        first, second = z.infolist()
    files = pafs.LocalFileSystem()
    tries = []

    class Flaky:
        def open_input_file(self, p):
            tries.append(p)
            if len(tries) < 3:
                raise OSError("lost")
            return files.open_input_file(p)

    assert media.read_member(Flaky(), str(path), second, 3, 0) == b"xyz" * 100 and len(tries) == 3
    raw = bytearray(path.read_bytes())
    raw[first.header_offset + 45] ^= 255
    path.write_bytes(raw)
    with pytest.raises((OSError, zlib.error)):
        media.read_member(files, str(path), first, 2, 0)
    assert media.read_member(files, str(path), second, 2, 0) == b"xyz" * 100
