"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole:

    <turn>role<text>text</turn><turn>role<text>text</turn>...

The three markers are special tokens, so no token spans a marker and a text. Inside roles and texts a backslash
is doubled, and one is put after the `<` of any marker or end-of-text string, so that texts cannot forge turns;
removing each backslash before the character it protects gives the text back.

The rendered string is encoded once, with offsets. Spans of the trained turns and spans of the tokens are both
sorted; binary search finds the tokens that meet each turn's span, and the intersections are the loss spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from strandloom.llm.vocabulary import BYTE_BPE, encode_with_offsets, tokenizer

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>"
MARKERS = (OPEN, BODY, CLOSE)
TRAINED_ROLES = ("assistant",)
_CONTROL = re.compile(r"\\|<(?=turn>|text>|/turn>|\|endoftext\|>)")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)" + re.escape(BODY) + r"(.*?)" + re.escape(CLOSE), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda found: "\\\\" if found[0] == "\\" else "<\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: Sequence[tuple[str | None, str | None]], trained: Sequence[str] = TRAINED_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the trained turns' texts in it."""
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role or '')}{BODY}", escape(text or "")
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += head, body, CLOSE
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask(offsets: np.ndarray, spans: Sequence[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask over tokens, and the merged intersections of masked tokens with spans.

    offsets: start and end of each token, both non-decreasing; tokens within one character share its span.
    """
    masked = np.zeros(len(offsets), np.int8)
    covered: list[tuple[int, int]] = []
    starts, ends = offsets[:, 0], offsets[:, 1]
    for start, end in spans:
        first, last = np.searchsorted(ends, start, "right"), np.searchsorted(starts, end, "left")
        masked[first:last] = 1
        a, b = np.maximum(starts[first:last], start), np.minimum(ends[first:last], end)
        a, b = a[a < b], b[a < b]
        if len(a):
            gap = np.flatnonzero(a[1:] > b[:-1])  # ends never fall, so a gap to the token before is one to all before
            covered += zip(a[np.concatenate(([0], gap + 1))].tolist(), b[np.concatenate((gap, [-1]))].tolist())
    return masked, covered


def chat_tokenizer(vocabulary: str = BYTE_BPE) -> Tokenizer:
    """The public vocabulary with the three markers as special tokens after its last id.

    Conversations take the same ids and offsets from vocabulary.encode_with_offsets, which is several times faster.
    """
    return tokenizer(vocabulary, MARKERS)  # it has no post-processor, so offsets keep white space


def loss_text(formatted: str, loss_spans: Sequence[tuple[int, int]]) -> str:
    """All text under the mask, unescaped."""
    return unescape("".join(formatted[a:b] for a, b in loss_spans))


def format_conversations(
    conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    trained_roles: Sequence[str] = TRAINED_ROLES, vocabulary: str = BYTE_BPE,
) -> DataFrame:
    """One row for each conversation: id_col, n_turns, formatted, ids, loss_mask (one 0 or 1 for each id) and
    loss_spans (start and end in code points of `formatted`).

    Turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own. A null
    role or text is empty. Rows with a null id form one conversation. No rows give none. Texts of any length are
    formatted whole; a conversation is one output row, so it must fit in a task, as its formatted text must in
    any case. Other columns are not carried.
    """
    row = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    grouped = conversations.select(F.col(id_col), row.alias("_row")).groupBy(id_col).agg(F.sort_array(F.collect_list("_row")).alias("_turns"))
    source = grouped.select(id_col, F.col("_turns.role").alias("_roles"), F.col("_turns.text").alias("_texts"))
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([
        T.StructField(id_col, source.schema[0].dataType), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.ByteType())), T.StructField("loss_spans", T.ArrayType(span)),
    ])
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                turns = [list(zip(r, t)) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                rendered = [render(x, trained_roles) for x in turns]
                encoded = [encode_with_offsets(text, vocabulary, MARKERS) for text, _ in rendered]
                masks = [mask(offsets, spans) for (_, offsets), (_, spans) in zip(encoded, rendered)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(map(len, turns), pa.int64()), pa.array([text for text, _ in rendered], pa.string()),
                    pa.array([ids.astype(np.int32) for ids, _ in encoded], pa.list_(pa.int32())), pa.array([m for m, _ in masks], pa.list_(pa.int8())),
                    pa.array([[{"start": a, "end": b} for a, b in spans] for _, spans in masks], span_type),
                ], names=schema.names)

    return source.mapInArrow(run, schema)


def digest(formatted: DataFrame, *, id_col: str = "conv_id") -> DataFrame:
    """Digests read back from format_conversations' output: what its turns say, and what its loss spans cover."""
    source = formatted.select(id_col, "formatted", "loss_spans")
    schema = T.StructType([
        T.StructField(id_col, source.schema[0].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            turns = [parse(x) for x in texts]
            lost = [loss_text(x, [(s["start"], s["end"]) for s in spans]) for x, spans in zip(texts, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(map(len, turns), pa.int64()), pa.array([sha("".join(f"{r}\n{t}\n" for r, t in x)) for x in turns], pa.string()),
                pa.array(map(len, lost), pa.int64()), pa.array(map(sha, lost), pa.string()), pa.array(map(len, texts), pa.int64()),
            ], names=schema.names)

    return source.mapInArrow(run, schema)


def oracle_sql(conversations: str) -> str:
    """digest() of format_conversations() in DuckDB SQL, over a relation (conv_id, turn, role, text)."""
    escaped = lambda x: f"regexp_replace(replace({x}, '\\', '\\\\'), '<(turn>|text>|/turn>|\\|endoftext\\|>)', '<\\\\\\1', 'g')"
    marks = sum(map(len, MARKERS))
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM ({conversations})),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
         CAST(sum(length({escaped("role")}) + length({escaped("text")}) + {marks}) AS BIGINT) AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said"""
