"""Query texts: packages split at semicolons, blocks in XML schemas, strings in modules."""

from __future__ import annotations

import re
from collections.abc import Iterator

from trawl.chunkers.common import Chunk, Options, partial_windows
from trawl.functions.text import QUERY_BLOCK, QUERY_START

_STATEMENT = re.compile(r"""(?:[^;"']|"(?:[^"]|"")*(?:"|$)|'(?:[^']|'')*(?:'|$))+""")
_STRING = re.compile(r'"(?:[^"]|"")*"')


def is_query(text: str) -> bool:
    return re.match(QUERY_START, text) is not None


def split_queries(text: str) -> list[str]:
    """Statements between semicolons outside quotes, those that are queries."""
    return [q for m in _STATEMENT.finditer(text) if (q := m[0].strip()) and is_query(q)]


def query_name(query: str) -> str:
    fields = re.split(r"[\s,]+", next((x.strip() for x in query.split("\n") if x.strip()), ""))
    return fields[1] if len(fields) > 1 and fields[0].upper() in ("ВЫБРАТЬ", "SELECT") else ""


def unquoted(raw: str) -> str:
    """A string literal without quotes and leading bars of its lines."""
    s = raw.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'":
        s = s[1:-1]
    return "\n".join(x[1:].strip() if (x := line.lstrip(" \t")).startswith("|") else x for line in s.split("\n")).strip()


def query_chunks(path: str, text: str, start_line: int, opts: Options, scope: str = "") -> Iterator[Chunk]:
    queries = split_queries(text)
    budget = opts.budget(path, scope)

    def one(body: str, line: int, name: str, kind: str) -> Iterator[Chunk]:
        lines = body.split("\n")
        chunk = Chunk(path, line, line + len(lines) - 1, body, "query", "ast", name, kind, scope, 0, len(body.encode()))
        if opts.count(body) > budget:
            yield from partial_windows(chunk, lines, opts)
        else:
            yield chunk

    package = ";\n".join(queries)
    if len(queries) > 1 and opts.count(package) <= budget:
        yield from one(package, start_line, "", "query_package")
        return
    line = start_line
    for q in queries:
        yield from one(q, line, query_name(q), "query")
        line += q.count("\n") + 1


def xml_query_chunks(path: str, text: str, opts: Options, scope: str) -> tuple[list[Chunk], str]:
    """Chunks of the query blocks of an XML schema, and the text without the blocks."""
    out = []
    for m in re.finditer(QUERY_BLOCK, text):
        body = m[1].strip()
        if is_query(body):
            out += query_chunks(path, body, text.count("\n", 0, m.start()) + 1, opts, scope)
    return out, re.sub(QUERY_BLOCK, "", text)


def embedded_queries(path: str, text: str, opts: Options, scope_at) -> Iterator[Chunk]:
    """Chunks of string literals that are queries, beside the chunks they stand in."""
    for m in _STRING.finditer(text):
        body = unquoted(m[0])
        if is_query(body):
            line = text.count("\n", 0, m.start()) + 1
            yield from query_chunks(path, body, line, opts, scope_at(line))
