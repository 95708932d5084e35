"""Prose and Markdown: sections, fences, tables and front matter, then pieces within the budget."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from trawl.chunkers.common import Chunk, Options, partial_windows

Piece = tuple[str, int, int]  # text, and the code points it spans
#: Cuts at each level, coarse to fine, and what joins neighbours that fit together.
LEVELS = ("paragraph", "line", "sentence", "clause", "word")
JOINTS = ("\n\n", "\n", " ", " ", " ")
ENDERS = ".!?…"


def _piece(text: str, start: int, stop: int) -> Piece | None:
    raw = text[start:stop]
    body = raw.strip()
    if not body:
        return None
    first = start + raw.index(body)
    return body, first, first + len(body)


def _cuts(text: str, level: int) -> Iterator[tuple[int, int]]:
    """Spans of the parts of a text at a level."""
    if level == 4:
        yield from (m.span() for m in re.finditer(r"\S+", text))
        return
    at = 0
    for m in re.finditer((r"\n{2,}", r"\n", rf"[{ENDERS}]\s*", r"[;:]\s+")[level], text):
        if level < 2:
            yield at, m.start()
        elif level == 2 and not (m.end() < len(text) and (text[m.end()].isupper() or unicodedata.category(text[m.end()]) == "Nd")):
            continue
        else:
            yield at, m.end()
        at = m.end()
    yield at, len(text)


def parts_at(text: str, level: int) -> list[Piece]:
    return [p for a, b in _cuts(text, level) if (p := _piece(text, a, b))]


def _merged(pieces: list[Piece], joint: str, fits) -> list[Piece]:
    """Neighbours joined as long as they fit; a joined piece spans all it is made of."""
    out: list[Piece] = []
    for p in pieces:
        if out and fits(whole := out[-1][0] + joint + p[0]):
            out[-1] = (whole, out[-1][1], p[2])
        else:
            out.append(p)
    return out


def _by_characters(text: str, start: int, fits) -> Iterator[Piece]:
    at = 0
    while at < len(text):
        low, high = at + 1, len(text)
        while low < high:  # the longest run that fits, one character at least
            mid = (low + high + 1) // 2
            low, high = (mid, high) if fits(text[at:mid]) else (low, mid - 1)
        yield text[at:low], start + at, start + low
        at = low


def recursive_split(text: str, budget: int, count, level: int = -1, start: int = 0) -> list[Piece]:
    """Pieces within ``budget``, cut as coarsely as that allows; offsets are code points from ``start``."""
    def fits(t: str) -> bool:
        return count(t) <= budget

    whole = _piece(text, 0, len(text))
    if whole is None:
        return []
    body, first = whole[0], start + whole[1]
    if fits(body):
        return [(body, first, first + len(body))]
    level = max(level, 0)
    while level < len(LEVELS) and len(found := parts_at(body, level)) < 2:
        level += 1
    if level >= len(LEVELS):
        return list(_by_characters(body, first, fits))
    joint, out = JOINTS[level], []
    for part, a, _ in found:
        out += _merged(recursive_split(part, budget, count, level + 1, first + a), joint, fits)
    return _merged(out, joint, fits)


def overlap_tail(body: str, budget: int, count) -> str:
    """The longest tail within ``budget`` tokens, begun at a sentence, else at a word."""
    if budget <= 0 or not body:
        return ""
    low, high = 0, len(body)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if count(body[mid:]) <= budget else (mid + 1, high)
    tail = body[low:].lstrip(" \t\n")
    if not tail or tail[0].isupper() or unicodedata.category(tail[0]) == "Nd" or tail[0] in "#-|>":
        return tail
    for m in re.finditer(rf"[{ENDERS}]\s*", tail):
        if m.end() < len(tail):
            return tail[m.end() :].lstrip(" \t\n")
    gap = re.search(r"\s", tail)
    return tail[gap.start() :].lstrip(" \t\n") if gap and gap.start() else tail


@dataclass
class Segment:
    kind: str  # prose, code, front or table
    lines: list[str]
    start: int
    title: str
    symbol_kind: str
    scope: str
    breaks: bool = False  # no overlap over its borders

    @property
    def text(self) -> str:
        return "\n".join(self.lines)


def _heading(line: str) -> tuple[int, str] | None:
    m = re.fullmatch(r"(#{1,6}) (.*\S.*)", line.strip())
    return (len(m[1]), m[2].strip()) if m else None


def _is_table(line: str) -> bool:
    s = line.strip()
    return s.startswith("|") or s.endswith("|")


def markdown_segments(text: str) -> Iterator[Segment]:
    """The segments of a Markdown text, in order; blank ones are left out."""
    lines = text.split("\n")
    titles: list[str] = []
    held: list[str] = []
    start, pending, at = 1, "", 0

    def scope() -> str:
        return "section " + " > ".join(titles) if titles else ""

    def flush(breaks: bool = False) -> Iterator[Segment]:
        nonlocal held, pending
        if held and "\n".join(held).strip():
            kind = "section" if pending else "paragraph"
            yield Segment("prose", held, start, pending, kind, scope(), breaks)
            pending = ""
        held = []

    if lines and lines[0].strip() == "---":
        stop = next((i for i in range(1, len(lines)) if lines[i].strip() == "---"), len(lines) - 1)
        yield Segment("front", lines[: stop + 1], 1, "", "section", "")
        at = stop + 1
    while at < len(lines):
        line = lines[at]
        fence = re.match(r"(`{3,}|~{3,})", line.strip())
        if fence:
            yield from flush()
            mark = fence[1]
            stop = next((i for i in range(at + 1, len(lines)) if len(s := lines[i].strip()) >= len(mark) and set(s) == {mark[0]}), len(lines) - 1)
            yield Segment("code", lines[at : stop + 1], at + 1, "", "code_block", scope())
            at = stop + 1
        elif head := _heading(line):
            yield from flush(True)
            level, pending = head
            titles[level - 1 if level <= len(titles) else len(titles) :] = [pending]
            start, held = at + 1, [line]
            at += 1
        elif _is_table(line):
            yield from flush()
            stop = next((i for i in range(at, len(lines)) if not _is_table(lines[i])), len(lines))
            yield Segment("table", lines[at:stop], at + 1, "", "paragraph", scope())
            at = stop
        else:
            if not held:
                start = at + 1
            if held or line.strip():
                held.append(line)
            at += 1
    yield from flush()


def _packed_lines(seg: Segment, budget: int, count) -> Iterator[Segment]:
    """Runs of whole lines within the budget."""
    at = 0
    while at < len(seg.lines):
        stop = at + 1
        while stop < len(seg.lines) and count("\n".join(seg.lines[at : stop + 1])) <= budget:
            stop += 1
        yield Segment(seg.kind, seg.lines[at:stop], seg.start + at, seg.title, seg.symbol_kind, seg.scope)
        at = stop


def _bytes(text: str, at: int) -> int:
    return len(text[:at].encode())


def prose_chunks(path: str, text: str, opts: Options, markdown: bool) -> Iterator[Chunk]:
    """Chunks of a prose file. Each begins with a tail of the one before, unless a heading or a cut block lies between."""
    lines = text.split("\n")
    segments = markdown_segments(text) if markdown else iter([Segment("prose", lines, 1, "", "paragraph", "")])
    before = ""
    for seg in segments:
        budget = opts.budget(path, seg.scope)
        model = Chunk(path, seg.start, seg.start + len(seg.lines) - 1, seg.text, "markdown", "prose", seg.title, seg.symbol_kind, seg.scope)
        if seg.kind == "code" and opts.count(seg.text) > budget:
            yield from partial_windows(model, seg.lines, opts)
            before = ""
            continue
        if seg.breaks:
            before = ""
        own = _packed_lines(seg, budget, opts.count) if seg.kind == "front" and opts.count(seg.text) > budget else [seg]
        for part in own:
            body, starts = part.text, [0, *accumulate(len(x) + 1 for x in part.lines)]
            whole = part.kind == "code"
            pieces = [(body, 0, len(body))] if whole else recursive_split(body, budget, opts.count)
            for i, (piece, a, b) in enumerate(pieces):
                first = bisect_right(starts, a, hi=len(starts) - 1) - 1
                last = max(0, bisect_left(starts, b, hi=len(starts) - 1) - 1)
                kind = "section" if part.symbol_kind == "paragraph" and part.title and i == 0 else part.symbol_kind
                snippet = piece
                if before and (tail := overlap_tail(before, opts.overlap(budget), opts.count)) and opts.count(tail + piece) <= budget:
                    snippet = tail + piece
                while opts.max_tokens > 0 and opts.count(snippet) > opts.max_tokens and len(snippet) > 1:
                    snippet = snippet[1:]
                yield Chunk(path, part.start + first, part.start + (len(part.lines) - 1 if whole else last), snippet, "markdown", "prose", part.title, kind, part.scope, 0 if whole else _bytes(body, a), 0 if whole else _bytes(body, b))
                before = piece
        if seg.breaks:
            before = ""
