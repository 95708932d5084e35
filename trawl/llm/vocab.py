"""Rank files of byte-level vocabularies, and merging by rank in plain Python."""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable


def vocabulary_path(name: str) -> str:
    """Where the box keeps a public vocabulary; callers may pass any other path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def splitter(pattern: str, public: bool) -> Callable[[str], list[str]]:
    """The function that splits a text by ``pattern``. If it is the ``public`` one, texts of Latin letters and common
    punctuation take an equal expression of explicit classes, which the standard library matches faster."""
    import regex

    general = regex.compile(pattern).findall
    if not public:
        return general

    def chars(of: Callable[[str], bool]) -> str:
        return "".join(re.escape(chr(c)) for c in range(0x250) if of(chr(c)))

    letters = chars(lambda c: unicodedata.category(c)[0] == "L")
    numbers = chars(lambda c: unicodedata.category(c)[0] == "N")
    space = "\t\n\x0b\x0c\r \x85\xa0"
    latin = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+").findall
    other = re.compile("[^\0-\u024f\u2010-\u2027]").search

    def split(text: str) -> list[str]:
        return general(text) if other(text) else latin(text)

    return split


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def merge_by_rank(word: bytes, ranks: dict[bytes, int], below: int | None = None) -> list[int]:
    """Ids of ``word``: again and again the leftmost pair of lowest rank is joined. O(n log n).

    A word that is a piece itself is its id; with ``below`` only ranks under it are joined instead.
    """
    if below is None and word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
    alive, heap = [True] * n, []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := ranks.get(word[i : end[j]])) is not None and (below is None or r < below):
            heapq.heappush(heap, (r, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts has changed meanwhile
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out
