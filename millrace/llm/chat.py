"""Chat formatting: records of many layouts become canonical turns, and turns become one template's text.

A record's layout is known by its fingerprint, the hash of its sorted nested field paths. Declarative
mappings are registered under the fingerprints of their required fields with every subset of their
optional ones; a record with another fingerprint is kept, with layout null and no turns.

The template marks turns and escapes what could be taken for a marker, reversibly: a backslash is doubled,
and a backslash and a tilde follow the first character of every control string inside a text. The loss
mask covers the assistant's text of each turn, without markers. A conversation is streamed turn by turn in
the order (turn, place in its record, role, text), so its length has no bound in memory.

Defined cases: a null text or role is empty; a null conversation identifier is a conversation of its own;
rows that repeat are turns of their own; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain, combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
# Strings with a meaning of their own in public chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.S)
_ESCAPED = re.compile(r"\\(.)")
_PLAIN = {"\\": "\\", "~": "", "n": "\n"}


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns``: (role, field) for each turn of a flat record, in order; the texts of fields that follow one
    another under one role are joined by an empty line. Or ``items``: a list field whose entries have
    ``role`` and ``text`` fields. Or only ``role`` and ``text``: the record is one turn. ``roles`` renames roles.
    """

    layout: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    def fingerprints(self) -> Iterator[str]:
        for more in chain.from_iterable(combinations(self.optional, k) for k in range(len(self.optional) + 1)):
            yield digest_of({*self.required, *more})

    def apply(self, record: dict) -> list[tuple[str, str]]:
        if self.turns:
            out: list[tuple[str, str]] = []
            for role, name in self.turns:
                if (text := record.get(name)) in (None, ""):
                    continue
                if out and out[-1][0] == role:
                    out[-1] = (role, f"{out[-1][1]}\n\n{text}")
                else:
                    out.append((role, str(text)))
            return out
        found = record[self.items] if self.items else [record]
        return [(self.roles.get(r := str(x.get(self.role) or ""), r), str(x.get(self.text) or "")) for x in found]


# Field names of public data sets.
SHARED = {"human": "user", "gpt": "assistant", "bing": "assistant", "chatgpt": "assistant", "bard": "assistant"}
MAPPINGS = (
    Mapping("turn_rows", ("role", "text"), ("turn", "conv_id"), role="role", text="text"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system", "id"), items="messages", role="role", text="content"),
    Mapping("shared_conversations", ("conversations[].from", "conversations[].value"), ("id",), items="conversations", role="from", text="value", roles=SHARED),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), turns=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping("prompt_response", ("prompt", "response"), ("system", "id"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", ("prompt", "completion"), ("id",), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("question_answer", ("question", "answer"), ("context", "id"), turns=(("user", "context"), ("user", "question"), ("assistant", "answer"))),
)


def field_paths(value: object, path: str = "") -> set[str]:
    """The nested paths of a JSON value's leaves; entries of a list share the path ``name[]``."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in field_paths(v, f"{path}.{k}" if path else k)}
    if isinstance(value, list):
        return {p for v in value for p in field_paths(v, f"{path}[]")} or {f"{path}[]"}
    return {path}


def digest_of(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


@lru_cache(maxsize=4)
def registry(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in mappings:
        for f in m.fingerprints():
            if out.setdefault(f, m) is not m:
                raise ValueError(f"two mappings claim one layout: {m.layout} and {out[f].layout}")
    return out


def turns_of(record: str | None, mappings: tuple[Mapping, ...] = MAPPINGS) -> tuple[str | None, str, list[tuple[str, str]]]:
    """Layout, fingerprint and turns of one JSON record."""
    try:
        value = json.loads(record) if record else None
    except ValueError:
        value = None
    if not isinstance(value, dict):
        return None, digest_of(set()), []
    found = digest_of(field_paths(value))
    m = registry(mappings).get(found)
    if m is None:
        return None, found, []
    turns = m.apply(value)
    if m.layout == "messages" and value.get("system"):
        turns = [("system", str(value["system"])), *turns]
    return m.layout, found, turns


TURNS = "conv_id long, turn long, place long, layout string, fingerprint string, role string, text string"


def canonical_turns(df: DataFrame, id_col: str, record_col: str, turn_col: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """One row per turn. A record that no mapping knows gives one row with null layout, role and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, turn, record in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "record")), strict=True):
                layout, fingerprint, turns = turns_of(record, mappings)
                out += [(conv_id, turn, k, layout, fingerprint, *x) for k, x in enumerate(turns)] or [(conv_id, turn, 0, layout, fingerprint, None, None)]
            types = (pa.int64(),) * 3 + (pa.string(),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=[x.split()[0] for x in TURNS.split(", ")])

    turn = F.col(turn_col).cast("long") if turn_col else F.lit(0).cast("long")
    return df.select(F.col(id_col).cast("long").alias("conv_id"), turn.alias("turn"), F.col(record_col).alias("record")).mapInArrow(run, TURNS)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\~", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text) if "\\" in text else text


SEGMENTS = "conv_id long, place long, segment string, offset long, loss_from long, loss_to long"


def formatted(turns: DataFrame) -> DataFrame:
    """The template's text in segments, one per turn, by conversation and in order within a partition.

    The formatted conversation is its segments end to end; ``offset`` is where a segment starts there, and
    ``loss_from`` to ``loss_to`` is the part of the loss mask it holds, in code points of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, at = object(), 0, 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if conv_id != now:
                    now, place, at = conv_id, 0, 0
                head = OPEN + escape(role or "").replace("\n", "\\n") + "\n"
                body = escape(text or "")
                start = at + len(head)
                mask = (start, start + len(body)) if role in LOSS_ROLES else (None, None)
                out.append((conv_id, place, head + body + CLOSE, at, *mask))
                place, at = place + 1, start + len(body) + len(CLOSE)
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    ordered = turns.filter(F.col("layout").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "place", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE)):
        raise ValueError("not a turn")
    role, _, body = segment[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescape(role), unescape(body)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, from the formatted text and the loss mask alone: counts and digests of its turns and of what is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        state: list | None = None
        out: list[tuple] = []

        def close() -> None:
            if state:
                conv_id, n, turns, chars, loss, length = state
                out.append((conv_id, n, turns.hexdigest(), chars, loss.hexdigest(), length))

        def flush() -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[]] * len(schema)
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        for batch in batches:
            for conv_id, place, segment, offset, start, end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if place == 0:
                    close()
                    state = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(segment)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    learned = unescape(segment[start - offset : end - offset])
                    state[3] += len(learned)
                    state[4].update(learned.encode())
                state[5] += len(segment)
            yield flush()
        close()
        yield flush()

    return segments.mapInArrow(run, READ_BACK)
