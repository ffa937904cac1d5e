"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, ``<s>[ROLE]role[/ROLE]text</s>`` per turn, and encoded once with offsets. The control
strings are tokens of their own, so no token crosses a turn's border; the assistant texts' spans, sorted as they are
rendered, meet the sorted token spans by binary search, which gives the loss mask.

Control strings inside roles and texts are escaped by a backslash after their first character, and one more where they
already have some, so unescaping gives back every text.

Nulls and odd rows: a null text or role is an empty one; turns are ordered by turn (nulls first), then role, then text;
repeated rows are repeated turns; rows with a null conv_id form one conversation; a conversation is one row of output,
as long as it may be; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, only

CONTROLS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<|endoftext|>"]
_TAILS = r"/?s>|\|endoftext\|>|/?(?:ROLE|INST)\]"
_ESCAPE, _UNESCAPE = re.compile(rf"([<\[])(\\*)({_TAILS})"), re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_TURN = re.compile(r"<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>", re.DOTALL)

_FORMATTED = "conv_id long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str | None, str | None]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts to learn, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<s>[ROLE]{escape(role or '')}[/ROLE]", escape(text or "")
        at += len(head)
        if role == learn and body:
            spans.append((at, at + len(body)))
        at += len(body) + 4
        out += head, body, "</s>"
    return "".join(out), spans


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that meet a span. Starts and ends of tokens are in order, so each span finds its own by search."""
    mask = np.zeros(len(starts) + 1, np.int8)
    if spans:
        low, high = np.array(spans).T
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        np.add.at(mask, first, 1)
        np.add.at(mask, last, -1)
    return np.cumsum(mask[:-1], dtype=np.int8)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The unescaped text under each run of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in edge.reshape(-1, 2)]


_TOKENIZERS: dict = kept("chat")


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens(CONTROLS)  # ids after the vocabulary's own
        _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _lists(parts: list, kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def _format(path: str, learn: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("chat")
        tokenizer = _tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, ids, starts, ends, masks = [], [], [], [], []
                for turns in part.column(1).to_pylist():
                    text, spans = render([(t["role"], t["text"]) for t in turns], learn)
                    e = tokenizer.encode(text, add_special_tokens=False)
                    offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                    texts.append(text)
                    ids.append(np.array(e.ids, np.int32))
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], spans))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), _lists(ids, pa.int32()), _lists(starts, pa.int32()), _lists(ends, pa.int32()), _lists(masks, pa.int8())], ["conv_id", "formatted", "ids", "starts", "ends", "loss_mask"])

    return run


def format_conversations(rows: DataFrame, tokenizer: str | None = None, learn: str = "assistant") -> DataFrame:
    """rows(conv_id, turn, role, text) -> conv_id, formatted, ids, starts, ends, loss_mask; one row per conversation."""
    import public_tokenizers

    turns = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")))).alias("turns"))
    return turns.mapInArrow(_format(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), learn), _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted conversations -> conv_id, turns array<role, text>, loss_texts array<string>, formatted_chars, tokens, loss_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {k: batch.column(i) for i, k in enumerate(batch.schema.names)}
            texts = columns["formatted"].to_pylist()
            arrays = {k: [x.values.to_numpy(zero_copy_only=False) for x in columns[k]] for k in ("starts", "ends", "loss_mask")}
            yield pa.RecordBatch.from_arrays(
                [
                    columns["conv_id"],
                    pa.array([[{"role": r, "text": t} for r, t in parse(x)] for x in texts], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))),
                    pa.array([masked_texts(x, s, e, m) for x, s, e, m in zip(texts, *arrays.values(), strict=True)], pa.list_(pa.string())),
                    pa.array([len(x) for x in texts], pa.int64()), pa.array([len(m) for m in arrays["loss_mask"]], pa.int64()), pa.array([int(m.sum()) for m in arrays["loss_mask"]], pa.int64()),
                ],
                ["conv_id", "turns", "loss_texts", "formatted_chars", "tokens", "loss_tokens"],
            )

    return formatted.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_texts array<string>, formatted_chars long, tokens long, loss_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what read_back gives."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "tokens", "loss_tokens")
