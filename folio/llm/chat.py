"""Chat formatting with typed content parts, a loss mask, and reading back."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
CONTROL, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
PLACEHOLDER = re.compile(r"<\|(image|audio|document|other)\|>")
#: Tokens that a unit of each kind expands to: an image tile, a second of audio, a page.
EXPANSION = {"image": 256, "audio": 25, "document": 512, "other": 1}
PART = "struct<kind: string, text: string, ref: string, units: double>"


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash goes between the two characters."""
    return CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


class Flattener:
    """Visits a turn's parts in order and collects its body, text spans, attachments and token count."""

    def __init__(self, expansion: dict[str, int]):
        self.expansion, self.body, self.length = expansion, [], 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[dict] = []
        self.tokens = 0
        self.text = ""

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['kind'] or 'text'}", self.visit_unknown)(part)

    def visit_text(self, part: dict) -> None:
        self.text += part["text"] or ""  # texts side by side are one: a control string can't hide across them

    def visit_image(self, part: dict) -> None:
        self.attach(part)

    def visit_audio(self, part: dict) -> None:
        self.attach(part)

    def visit_document(self, part: dict) -> None:
        self.attach(part)

    def visit_unknown(self, part: dict) -> None:
        self.attach(part, "other")

    def attach(self, part: dict, placeholder: str | None = None) -> None:
        self.close()
        kind = placeholder or part["kind"]
        tokens = max(1, math.ceil((1 if part["units"] is None else part["units"]) * self.expansion[kind]))
        self.attachments.append({"place": len(self.attachments), "kind": part["kind"], "ref": part["ref"], "at": self.length, "tokens": tokens})
        self.tokens += tokens
        self.add(f"<|{kind}|>")

    def close(self) -> None:
        if self.text:
            text, self.text = escape(self.text), ""
            self.spans.append((self.length, self.length + len(text)))
            self.add(text)

    def add(self, text: str) -> None:
        self.body.append(text)
        self.length += len(text)


def render(role: str, parts: list[dict], trained: str = "assistant", expansion: dict[str, int] = EXPANSION) -> dict:
    """One turn: its string, the spans under the loss mask, its attachments and their tokens."""
    head = TURN + escape(role) + BODY
    flat = Flattener(expansion)
    flat.length = len(head)
    for part in parts:
        flat.visit(part)
    flat.close()
    return {
        "chunk": head + "".join(flat.body) + END,
        "loss": [{"start": a, "end": b} for a, b in flat.spans] if role == trained else [],
        "attachments": flat.attachments,
        "attachment_tokens": flat.tokens,
    }


def read_turn(chunk: str) -> tuple[str, str]:
    """Role and text (without placeholders) of a formatted turn."""
    role, _, body = chunk.removeprefix(TURN).partition(BODY)
    return unescape(role), "".join(unescape(x) for x in PLACEHOLDER.split(body.removesuffix(END))[::2])


_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_ATTACHMENT = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int64())]))
FORMATTED = "conv_id long, turn long, role string, chunk string, loss array<struct<start: int, end: int>>, attachments array<struct<place: int, kind: string, ref: string, at: int, tokens: long>>, attachment_tokens long"


def _format(batches):
    for batch in batches:
        conv, turn, role, parts = batch.columns
        done = [render(r or "", p or []) for r, p in zip(role.to_pylist(), parts.to_pylist(), strict=True)]
        columns = [pa.array([d[k] for d in done], t) for k, t in (("chunk", pa.string()), ("loss", _SPAN), ("attachments", _ATTACHMENT), ("attachment_tokens", pa.int64()))]
        yield pa.RecordBatch.from_arrays([conv, turn, role.cast(pa.string()), *columns], [c.split()[0] for c in re.sub("<.*?>+", "", FORMATTED).split(", ")])


def format_turns(turns: DataFrame, parts_col: str | None = None, text_col: str = "text") -> DataFrame:
    """Each turn formatted by itself, so a conversation of any length is formatted by many tasks.

    ``turns`` has conv_id, turn, role and either ``parts_col`` (an array of ``PART``) or
    ``text_col``.  A conversation's string is its turns' ``chunk`` in order.  ``loss`` has the
    spans (code points within the chunk) of the assistant's texts; placeholders are outside.
    Attachments keep their order, reference, place in the chunk and expanded token count.

    Null texts, roles and parts are empty; null conv_ids are one conversation; other columns are
    ignored.  A part of a kind not known here is an attachment of its own kind behind the placeholder
    ``<|other|>``, of one token a unit.
    """
    text = F.array(F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))
    parts = F.col(parts_col).cast(f"array<{PART}>") if parts_col else text
    source = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), parts.alias("parts"))
    return source.mapInArrow(_format, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Conversations come whole and in order; only running hashes are kept."""
    key, state = object(), None
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def rows(states):
        return pa.RecordBatch.from_pylist([dict(zip(names, (k, n, a.hexdigest(), c, b.hexdigest(), f), strict=True)) for k, n, a, c, b, f in states], pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names]))

    for batch in batches:
        done = []
        for conv, chunk, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != key:
                if state:
                    done.append(state)
                key, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(chunk)
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            for span in loss or ():
                under = unescape(chunk[span["start"] : span["end"]])
                state[3] += len(under)
                state[4].update(under.encode())
            state[5] += len(chunk)
        yield rows(done)
    if state:
        yield rows([state])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted turns alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns go by number, equal numbers by their string; nulls come first.
    """
    ordered = formatted.select("conv_id", "turn", "chunk", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "chunk")
    return ordered.select("conv_id", "chunk", "loss").mapInArrow(_digest, DIGEST)
