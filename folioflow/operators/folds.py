"""Folds over one document's ordered parts that no set of column functions expresses.

Each works on one document or row at a time; Spark deals the documents out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import text_column

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of about ``size`` characters, cut at the strongest separator that occurs; weaker ones cut what stays too long.

    A unit shorter than ``size`` is joined to its predecessors while the sum stays within ``size``.  A piece that
    is closed hands its last units on, as many as ``overlap`` allows, but always one.  Empty units are dropped,
    nothing is trimmed.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, weaker = separators[at], separators[at + 1 :]
    out: list[str] = []
    held: list[str] = []
    used = 0

    def close() -> None:
        nonlocal held, used
        if held:
            out.append(mark.join(held))
        held, used = [], 0

    for unit in text.split(mark) if mark else text:
        if not unit:
            continue
        if len(unit) >= size:
            close()
            out.extend(split_text(unit, size, overlap, weaker) if weaker else [unit])
            continue
        gap = len(mark) if held else 0
        if held and used + gap + len(unit) > size:
            out.append(mark.join(held))
            first = 0
            while used > overlap and len(held) - first > 1:
                used -= len(held[first]) + len(mark)
                first += 1
            held = held[first:]
        used += len(unit) + (len(mark) if held else 0)
        held.append(unit)
    close()
    return out


def split_oversized(text: str, most: int) -> list[str]:
    """Parts of at most ``most`` characters, cut after the last blank line, else line end, beyond a quarter; else hard.

    A text that fits, an empty one too, is one part.
    """
    out, start = [], 0
    while len(text) - start > most > 0:
        cut = start + most
        for mark in ("\n\n", "\n"):
            found = text.rfind(mark, start, start + most)
            if found - start > most // 4:
                cut = found + len(mark)
                break
        out.append(text[start:cut])
        start = cut
    if start < len(text) or not out:
        out.append(text[start:])
    return out


def split_column(size: int, overlap: int = 0):
    """:func:`split_text` as a column function."""

    return text_column(lambda texts: texts.map(lambda t: None if t is None else split_text(t, size, overlap)), T.ArrayType(T.StringType()))


def split_lists(size: int, overlap: int = 0):
    """:func:`split_text` of each text of a list; null stays."""

    return text_column(lambda lists: lists.map(lambda texts: None if texts is None else [None if t is None else split_text(t, size, overlap) for t in texts]), T.ArrayType(T.ArrayType(T.StringType())))


def oversized_column(most: int):
    return text_column(lambda texts: texts.map(lambda t: None if t is None else split_oversized(t, most)), T.ArrayType(T.StringType()))


def oversized_parts(most: int):
    """:func:`split_oversized` of each text of a list, in one list."""

    return text_column(lambda lists: lists.map(lambda texts: None if texts is None else [p for t in texts for p in split_oversized(t, most)]), T.ArrayType(T.StringType()))


def ordered_matches(before: list[tuple], after: list[tuple], window: int = 10) -> list[int]:
    """For each (toc_path, pages) of ``after`` the index of the best of the next ``window`` of ``before``; -1 if that is empty.

    The pointer never moves back; an equal path counts 1000, each common page 1; the first of equals wins, so
    where nothing scores the pointer stays and its chunk is the match.
    """
    if not before:
        return [-1] * len(after)
    pointer, out = 0, []
    for path, pages in after:
        near = range(pointer, min(len(before), pointer + window))
        pointer = max(near, key=lambda i: (1000 * (before[i][0] == path) + len(set(before[i][1] or []) & set(pages or [])), -i))
        out.append(pointer)
    return out


def match_enrichment(enriched: DataFrame, target: DataFrame) -> DataFrame:
    """document_id, seq, matched_seq of chunks whose metadata carries over to chunks cut anew; null where no chunk was enriched."""

    columns = ["document_id", "seq", "toc_path", "pages"]

    def run(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # a side without rows may come without columns
        a, b = (f.reindex(columns=columns).sort_values("seq") for f in (a, b))
        pairs = lambda f: list(zip(f["toc_path"].tolist(), [list(p) if hasattr(p, "__len__") else [] for p in f["pages"]], strict=True))
        seqs = a["seq"].tolist()
        found = [seqs[i] if i >= 0 else None for i in ordered_matches(pairs(a), pairs(b))]
        return pd.DataFrame({"document_id": b["document_id"], "seq": b["seq"], "matched_seq": pd.array(found, dtype="Int64")})

    kind = target.schema["document_id"].dataType.simpleString()
    left, right = enriched.select(*columns).groupBy("document_id"), target.select(*columns).groupBy("document_id")
    return left.cogroup(right).applyInPandas(run, f"document_id {kind}, seq int, matched_seq int")
