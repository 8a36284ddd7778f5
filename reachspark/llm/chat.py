"""Chat formatting with offset-aligned loss masks (operator 5).

A conversation is rendered whole, with the character span of each turn's text; it is
encoded once, with offsets; and the loss mask of its tokens comes from a binary search of
the sorted assistant spans. Control strings inside a text get a backslash after their
first character and backslashes are doubled, so that the template's own marks are the
only ones in the output and every text can be read back.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed marks of the template.
OPEN, CLOSE, BEGIN, END = "[INST]", "[/INST]", "<s>", "</s>"
_CONTROL = re.compile(r"\\|(?:\[INST\]|\[/INST\]|<s>|</s>)")
_ESCAPED = re.compile(r"\\(.?)", re.DOTALL)
_TURN = re.compile(r"\[INST\](.*?)\n(.*?)\[/INST\]|<s>(.*?)</s>", re.DOTALL)
#: Tokens are made of so many conversations at a time.
_AT_ONCE = 64


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\N")


def _unescape_role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "N" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of assistant texts in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        before, body, after = (BEGIN, escape(text), END) if role == "assistant" else (f"{OPEN}{_escape_role(role)}\n", escape(text), CLOSE)
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [("assistant", unescape(m[3])) if m[3] is not None else (_unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_mask(offsets: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens touch a span, and which span: both by binary search in the sorted spans.

    A token that covers a border counts, with the characters inside the span only.
    """
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), dtype=bool), np.zeros(len(offsets), dtype=np.int64)
    which = np.minimum(np.searchsorted(spans[:, 1], offsets[:, 0], side="right"), len(spans) - 1)
    return (offsets[:, 1] > spans[which, 0]) & (offsets[:, 0] < spans[which, 1]), which


def masked_text(formatted: str, offsets: np.ndarray, spans: np.ndarray) -> list[str]:
    """By span, the text that the loss mask covers, unescaped."""
    if not len(spans):
        return []
    loss, _ = loss_mask(offsets, spans)
    starts, ends = offsets[loss, 0], offsets[loss, 1]
    # a token that crosses a border can touch more than one span
    first = np.searchsorted(ends, spans[:, 0], side="right")
    last = np.searchsorted(starts, spans[:, 1], side="left")
    out = []
    for (low, high), i, j in zip(spans.tolist(), first.tolist(), last.tolist(), strict=True):
        a, b = np.maximum(starts[i:j], low), np.minimum(ends[i:j], high)
        upto = np.maximum.accumulate(np.r_[low, b])  # what the tokens before have covered
        a = np.maximum(a, upto[:-1])
        new = np.flatnonzero(np.r_[True, a[1:] > upto[1:-1]]) if len(a) else a[:0]  # runs of tokens without a gap, usually one
        close = upto[np.r_[new[1:], len(a)]] if len(a) else a
        out.append(unescape("".join([formatted[x:y] for x, y in zip(a[new].tolist(), close.tolist(), strict=True)])))
    return out


def token_bytes(encoder) -> np.ndarray:
    """Length of each token's text; of a byte-level vocabulary this is its number of bytes."""
    known = encoder.get_vocab(with_added_tokens=True)
    out = np.zeros(max(known.values(), default=0) + 1, dtype=np.int64)
    for token, i in known.items():
        out[i] = len(token)
    return out


def offsets_of(encoding, text: str, lengths: np.ndarray) -> np.ndarray:
    """First and last character of each token.

    Tokens of a byte-level vocabulary add up to the bytes of the text, and their lengths
    give the offsets without a Python object each; of any other the encoding's own are taken.
    """
    ends = np.cumsum(lengths[np.array(encoding.ids, dtype=np.int64)])
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    if (ends[-1] if len(ends) else 0) != len(raw):
        return np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    if len(raw) != len(text):
        character = np.cumsum((raw & 0xC0) != 0x80)
        starts, ends = character[starts] - 1, character[ends - 1]
    return np.stack([starts, ends], axis=1).astype(np.int32)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the rows of each conversation by turn; ties by role, then text; a null turn first."""
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns")).withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])))


def formatted(rows: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """conv_id, formatted, tokens, loss (0 or 1 a token), starts and ends (a token's characters), spans of each conversation.

    Null roles and texts are empty; a conversation is the rows with one conv_id (null is
    one too); repeated rows are repeated turns; an empty table gives no rows. A
    conversation is one text, whole.
    """

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(tokenizer)
        encoder.encode_special_tokens = True  # only the text counts
        lengths = token_bytes(encoder)
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                texts, spans = zip(*(render([(t["role"], t["text"]) for t in turns]) for turns in part[1].to_pylist()), strict=True)
                encoded = encoder.encode_batch(list(texts), add_special_tokens=False)
                offsets = [offsets_of(e, t, lengths) for e, t in zip(encoded, texts, strict=True)]
                borders = [np.array(s, dtype=np.int32).reshape(-1, 2) for s in spans]
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "conv_id": part[0], "formatted": pa.array(texts, pa.string()), "tokens": pa.array([e.ids for e in encoded], ints),
                    "loss": pa.array([loss_mask(o, b)[0].astype(np.int8) for o, b in zip(offsets, borders, strict=True)], pa.list_(pa.int8())),
                    "starts": pa.array([o[:, 0] for o in offsets], ints), "ends": pa.array([o[:, 1] for o in offsets], ints), "spans": pa.array([b.ravel() for b in borders], ints),
                })

    kind = rows.schema["conv_id"].dataType.simpleString()
    return conversations(rows).mapInArrow(run, f"conv_id {kind}, formatted string, tokens array<int>, loss array<tinyint>, starts array<int>, ends array<int>, spans array<int>")


def digest(done: DataFrame) -> DataFrame:
    """What is read back from the formatted text, the tokens' offsets and the loss mask."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), _AT_ONCE):
                batch, out = whole.slice(at, _AT_ONCE), []
                for row in zip(*(batch[c] for c in ("formatted", "loss", "starts", "ends", "spans")), strict=True):
                    text = row[0].as_py()
                    loss, starts, ends, spans = (x.values.to_numpy() for x in row[1:])
                    turns, keep = parse(text), loss.astype(bool)
                    said = "".join(masked_text(text, np.stack([starts[keep], ends[keep]], axis=1), spans.reshape(-1, 2)))
                    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                    out.append((len(turns), sha.hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
                names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
                yield pa.RecordBatch.from_pydict({"conv_id": batch["conv_id"]} | {n: pa.array([o[i] for o in out], pa.string() if n.endswith("256") else pa.int64()) for i, n in enumerate(names)})

    kind = done.schema["conv_id"].dataType.simpleString()
    return done.select("conv_id", "formatted", "loss", "starts", "ends", "spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    done = Scratch(spark, "chat").save(formatted(rows.unionByName(more)), "formatted")
    return digest(done)


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in (OPEN, CLOSE, BEGIN, END):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP5_SQL = f"""
with turn as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), each as (
  select *, length({_sql_escape('text')}) as text_chars, length(replace({_sql_escape('role')}, chr(10), '\\N')) as role_chars from turn
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' then text_chars + {len(BEGIN) + len(END)} else role_chars + text_chars + {len(OPEN) + len(CLOSE) + 1} end) as bigint) as formatted_chars
from each group by conv_id
"""
