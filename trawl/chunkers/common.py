"""What the chunkers share: options, token counts, chunks, partial windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from trawl.functions.text import count_tokens
from trawl.operators.windows import window_options


@dataclass(frozen=True)
class Options:
    max_tokens: int = 512
    embed_ratio: float = 0.85
    overlap_ratio: float = 0.12
    prefix: bool = True
    min_tokens: int = 24
    window_lines: int = 0
    overlap_lines: int = 0
    count: Callable[[str], int] = field(default=count_tokens)

    def budget(self, path: str, scope: str) -> int:
        """Tokens that a chunk's own text may have beside its context prefix."""
        total = math.floor(self.max_tokens * self.embed_ratio)
        total = total if total > 0 else self.max_tokens
        if not self.prefix:
            return total
        head = f"// file: {path}\n" + (f"// scope: {scope}\n" if scope else "")
        return max(1, total - self.count(head))

    def overlap(self, budget: int) -> int:
        n = math.floor(budget * (self.overlap_ratio if self.overlap_ratio > 0 else 0.12))
        return 1 if n < 1 < budget else n


@dataclass(frozen=True)
class Chunk:
    path: str
    start_line: int
    end_line: int
    snippet: str
    kind: str
    strategy: str
    symbol: str = ""
    symbol_kind: str = ""
    scope: str = ""
    start_byte: int = 0
    end_byte: int = 0


def partial_windows(model: Chunk, lines: list[str], opts: Options) -> Iterator[Chunk]:
    """Windows of lines within the budget, one line at least, cut from ``lines`` which begin at the model's first line."""
    size, over = window_options(opts.window_lines, opts.overlap_lines)
    budget, at = opts.budget(model.path, model.scope), 0
    while at < len(lines):
        stop = min(at + size, len(lines))
        while stop > at + 1 and opts.count("\n".join(lines[at:stop])) > budget:
            stop -= 1
        body = "\n".join(lines[at:stop])
        if body.strip():
            first = model.start_line + at
            yield replace(model, start_line=first, end_line=first + stop - at - 1, snippet=body, strategy="partial", start_byte=0, end_byte=0)
        elif stop < len(lines):
            at += 1
            continue
        if stop == len(lines):
            return
        at = max(stop - over, at + 1)
