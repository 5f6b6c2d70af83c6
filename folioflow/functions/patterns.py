"""Many fixed strings in one text, found in one pass (Aho-Corasick)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick


def automaton(strings: Iterable[str]) -> ahocorasick.Automaton | None:
    """An automaton of the strings; None without any.  Empty strings are left out."""
    found = ahocorasick.Automaton()
    for s in strings:
        if s:
            found.add_word(s, s)
    if not len(found):
        return None
    found.make_automaton()
    return found


def places(text: str, strings: Iterable[str]) -> dict[str, list[int]]:
    """Where each string begins in ``text``, in order; strings that do not occur are left out."""
    out: dict[str, list[int]] = {}
    if search := automaton(strings):
        for end, s in search.iter(text):
            out.setdefault(s, []).append(end - len(s) + 1)
    return out


def leftmost_longest(text: str, strings: Iterable[str]) -> Iterator[tuple[int, str]]:
    """Occurrences that do not overlap, from the left; of those that begin at one place the longest."""
    search = automaton(strings)
    if search is None:
        return
    best: dict[int, str] = {}
    for end, s in search.iter(text):
        start = end - len(s) + 1
        if len(s) > len(best.get(start, "")):
            best[start] = s
    at = 0
    for start in sorted(best):
        if start >= at:
            yield start, best[start]
            at = start + len(best[start])
