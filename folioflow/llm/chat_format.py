"""Chat formatting with offset-aligned loss masks.

Method: a conversation is rendered whole, encoded once with character offsets, and the sorted spans of its
assistant texts are intersected with the token spans by binary search.  Marks are special tokens, so that no
token reaches over the border of a text.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` per turn.  Inside roles and texts every ``<``, any
number of backslashes, ``|`` gets one backslash more, so no text holds a mark; :func:`unescape` takes it away.

Cases: a null text or role is an empty one.  Turns are ordered by turn (null first), then role, then text,
so repeated rows and ties have one order.  A null ``conv_id`` is a conversation of its own; ids may be of any
type.  Extra columns are not read.

A conversation of any length is encoded once, as a stream: what leaves the encoder are parts of whole turns.
Tokenizers cut at special tokens before all else, so the parts' ids in order are those of the whole string;
:func:`load_tokenizer` refuses a tokenizer for which that fails.  The task that holds a conversation keeps one part.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Fixed marks of the template.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "<\\" + m[1] + "|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "<" + m[1] + "|", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string of (role, text) turns and the spans of its assistant texts, in order."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += [head, body, END]
        at += len(head)
        if role == LEARNED_ROLE and body:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns of a formatted string."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, text = turn.removesuffix(END).partition(SEP)
        turns.append((unescape(role), unescape(text)))
    return turns


def mask_tokens(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that overlap a span; both sorted by start."""
    if not len(offsets) or not spans:
        return np.zeros(len(offsets), bool)
    s = np.array(spans)
    nearest = np.searchsorted(s[:, 0], offsets[:, 1], side="left") - 1
    return (nearest >= 0) & (s[np.maximum(nearest, 0), 1] > offsets[:, 0])


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """What the masked tokens cover, unescaped text by text."""
    out, start, end = [], -1, -1
    for a, b in offsets[mask].tolist():
        if a > end or start < 0:
            if start >= 0:
                out.append(unescape(formatted[start:end]))
            start = a
        end = max(end, b)
    if start >= 0:
        out.append(unescape(formatted[start:end]))
    return "".join(out)


@functools.lru_cache(maxsize=2)
def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in (START, SEP, END)])
    turn = render([("user", " One a\n"), ("assistant", "b ")])[0]
    ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    if ids(turn + turn) != ids(turn) * 2:
        raise ValueError("the tokenizer does not cut at the marks of turns")
    return tokenizer


def format_conversations(turns: DataFrame, tokenizer: str, *, part_chars: int = 1 << 20) -> DataFrame:
    """One row per part of a conversation: conv_id, part, formatted, ids, starts, ends, mask.

    ``starts`` and ``ends`` are the tokens' character offsets in the part, ``mask`` is true where a token is
    learned.  A part ends with the turn that brings it to ``part_chars`` characters.  Rows stay sorted by conv_id
    and part inside their partition, each conversation in one partition.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    ints, names = pa.list_(pa.int32()), ["conv_id", "part", "formatted", "ids", "starts", "ends", "mask"]

    id_type: list[pa.DataType] = []

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, list[tuple[str, str]]]]:
        conv, part, held, chars = None, 0, [], 0
        for batch in batches:
            id_type[:] = [batch.column(0).type]
            for c, r, t in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)], strict=True):
                if held and (c != conv or chars + len(t) > part_chars):
                    yield conv, part, held
                    part = part + 1 if c == conv else 0
                    held, chars = [], 0
                conv = c
                held.append((r, t))
                chars += len(t)
        if held:
            yield conv, part, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = load_tokenizer(tokenizer)
        waiting: list[tuple[object, int, str, list[tuple[int, int]]]] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            encoded = tokenize.encode_batch([w[2] for w in waiting], add_special_tokens=False)
            columns: list[list] = [[] for _ in names]
            for (conv, part, formatted, spans), e in zip(waiting, encoded, strict=True):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                mask = mask_tokens(offsets, spans)
                for c, v in zip(columns, (conv, part, formatted, e.ids, offsets[:, 0], offsets[:, 1], mask), strict=True):
                    c.append(v)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], id_type[0]), pa.array(columns[1], pa.int32()), pa.array(columns[2])]
                + [pa.array(c, ints) for c in columns[3:6]]
                + [pa.array(columns[6], pa.list_(pa.bool_()))],
                names=names,
            )

        for conv, part, held in parts(batches):
            formatted, spans = render(held)
            waiting.append((conv, part, formatted, spans))
            chars += len(formatted)
            if chars > 1 << 20:
                yield flush()
                waiting, chars = [], 0
        if waiting:
            yield flush()

    return map_arrow(rows, run, f"conv_id {kind}, part int, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from :func:`format_conversations`: turn and loss digests per conversation.

    It is applied to the formatter's result as it stands: parts that do not come in order raise an error.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out, id_type = None, [], None

        def close() -> tuple:
            conv, turns, n, loss, chars, length, tokens, _ = state
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), length, tokens)

        def rows() -> pa.RecordBatch:
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            columns = [c.to_pylist() for c in batch.columns[:3]] + [batch.column(i) for i in (4, 5, 6)]
            for i in range(batch.num_rows):
                conv, part, text = (columns[k][i] for k in range(3))
                starts, ends = (columns[k][i].values.to_numpy() for k in (3, 4))
                mask = columns[5][i].values.to_numpy(zero_copy_only=False).astype(bool)
                if part == 0:
                    if state is not None:
                        out.append(close())
                    state = [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, 0]
                elif state is None or (conv, part) != (state[0], state[7]):
                    raise ValueError(f"part {part} of conversation {conv} does not follow its predecessor")
                turns = parse(text)
                for role, said in turns:
                    state[1].update(f"{role}\n{said}\n".encode())
                learned = masked_text(text, np.column_stack([starts, ends]), mask)
                state[3].update(learned.encode())
                state[2] += len(turns)
                state[4] += len(learned)
                state[5] += len(text)
                state[6] += len(starts)
                state[7] = part + 1
            yield rows()
            out = []
        if state is not None:
            out = [close()]
            yield rows()

    return map_arrow(
        formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    )
