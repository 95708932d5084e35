"""Source code: chunks along declarations.

There is no grammar library here. A provider gives a tree of declarations by line: Python by
the standard parser, languages of braces by a scanner that knows strings and comments, and
module text by its keywords. Other text raises ``NoTree`` and goes to line windows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from trawl.chunkers.common import Chunk, Options, partial_windows
from trawl.chunkers.query_text import embedded_queries


class NoTree(Exception):
    """No usable tree: unknown language, empty file or too many errors."""


@dataclass
class Node:
    kind: str
    name: str
    start: int  # first line, from 1
    end: int  # last line
    children: list[Node] = field(default_factory=list)
    owner: str = ""  # the type that a method belongs to
    wrapped: bool = False  # decorated, exported or a group: looked into even if it fits


def python_tree(text: str) -> list[Node]:
    try:
        module = ast.parse(text)
    except (SyntaxError, ValueError) as e:
        raise NoTree(str(e)) from e

    def walk(body: list[ast.stmt], top: bool) -> list[Node]:
        out = []
        for s in body:
            start = min([s.lineno, *(d.lineno for d in getattr(s, "decorator_list", []))])
            if isinstance(s, ast.ClassDef):
                out.append(Node("class", s.name, start, s.end_lineno, walk(s.body, False), wrapped=True))
            elif isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(Node("function" if top else "method", s.name, start, s.end_lineno, walk(s.body, False), wrapped=bool(s.decorator_list)))
            elif top and isinstance(s, (ast.Assign, ast.AnnAssign)):
                target = s.targets[0] if isinstance(s, ast.Assign) else s.target
                out.append(Node("assignment", target.id if isinstance(target, ast.Name) else "", s.lineno, s.end_lineno))
        return out

    return walk(module.body, True)


_BRACED = {
    "go": re.compile(r"(?m)^(?:func\s+(?:\((?P<receiver>[^)]*)\)\s*)?(?P<function>\w+)|type\s+(?P<type>\w+)|const\s+(?P<const>\w+)|var\s+(?P<var>\w+)|(?P<group>const|var|type)\s*\()"),
    "js": re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?\s*(?P<function>\w*)|(?:abstract\s+)?class\s+(?P<class>\w*)|interface\s+(?P<interface>\w+)|enum\s+(?P<enum>\w+)|type\s+(?P<type>\w+)\s*[=<]|(?:const|let|var)\s+(?P<arrow>\w+)(?:\s*:[^=\n]+)?\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)(?:\s*:[^=\n]+)?\s*=>|\w+\s*=>)|(?:const|let|var)\s+(?P<declaration>\w+))"),
}
_METHOD = re.compile(r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set)\s+)*(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[^>\n]*>)?\([^;{]*\)[^;{]*\{")
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function"}


def _blanked(text: str) -> str:
    """The text with strings and comments blanked, lines kept."""
    pattern = r"""//[^\n]*|/\*.*?(?:\*/|$)|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.DOTALL)


def _close(plain: str, at: int, pairs: str = "{}") -> int:
    """Where the first bracket from ``at`` on closes, or the end of its line if none opens before that."""
    depth, seen, i = 0, False, at
    while i < len(plain):
        c = plain[i]
        if c in "{([":
            depth, seen = depth + 1, seen or c == pairs[0]
        elif c in "})]":
            depth -= 1
            if depth == 0 and seen and c == pairs[1]:
                return i + 1
        elif depth == 0 and (c == ";" or c == "\n" and plain[at:i].rstrip()[-1:] not in ("=", ",", "(", ">", "|", "&", "+")):
            return i
        i += 1
    return len(plain)


def _specs(plain: str, at: int, stop: int, kind: str, line) -> Iterator[Node]:
    """The declarations of a group in brackets, one a line unless brackets stay open."""
    while at < stop:
        m = re.compile(r"[ \t]*(\w+)[^\n]*").match(plain, at, stop)
        end = plain.find("\n", at)
        end = stop if end < 0 else end
        if m:
            end = max(end, min(stop, _close(plain, m.start(1))))
            yield Node(kind, m[1], line(m.start(1)), line(max(m.start(1), end - 1)))
        at = end + 1


def braced_tree(text: str, language: str) -> list[Node]:
    plain = _blanked(text)
    if not plain.strip():
        raise NoTree("empty")
    if abs(plain.count("{") - plain.count("}")) > 0.3 * max(1, plain.count("{")):
        raise NoTree("brackets do not match")
    line = lambda at: plain.count("\n", 0, at) + 1
    out, done = [], 0
    for m in _BRACED["go" if language == "go" else "js"].finditer(plain):
        if m.start() < done:
            continue
        kind = m.lastgroup or "function"
        found = {k: v for k, v in m.groupdict().items() if v and k not in ("receiver", "group")}
        kind, name = next(iter(found.items())) if found else (kind, "")
        receiver = re.search(r"(\w+)\s*$", m.groupdict().get("receiver") or "")
        kind = "method" if receiver else "function" if kind == "arrow" else kind
        group = m.groupdict().get("group")
        pairs = "()" if group else "{}"
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        stop = _close(plain, m.end() - bool(group), pairs)
        node = Node(group or kind, name, line(start), line(max(start, stop - 1)), owner=receiver[1] if receiver else "", wrapped=kind == "class" or bool(group))
        if group:
            node.children = list(_specs(plain, m.end(), stop - 1, group, line))
        if kind == "class":
            inner = plain.find("{", m.end())
            for k in _METHOD.finditer(plain, inner, stop):
                if k["name"] not in _WORDS and plain.count("{", inner, k.start()) - plain.count("}", inner, k.start()) == 1:
                    first = k.start() + len(k[0]) - len(k[0].lstrip())
                    node.children.append(Node("method", k["name"], line(first), line(_close(plain, k.end() - 1) - 1), owner=name))
        out.append(node)
        done = stop
    return out


_MODULE = re.compile(r"(?im)^[ \t]*(?:(?P<function>Функция|Function)|(?P<procedure>Процедура|Procedure))\s+(?P<name>\w+)")
_MODULE_END = re.compile(r"(?im)^[ \t]*(?:КонецФункции|КонецПроцедуры|EndFunction|EndProcedure)\b.*$")
_REGION = re.compile(r"(?im)^[ \t]*#(?:(?:Область|Region)\s+(?P<name>\w+)|(?P<end>КонецОбласти|EndRegion))")


def module_tree(text: str) -> list[Node]:
    out = []
    for m in _MODULE.finditer(text):
        end = _MODULE_END.search(text, m.end())
        stop = end.end() if end else len(text)
        out.append(Node("function" if m["function"] else "procedure", m["name"], text.count("\n", 0, m.start()) + 1, text.count("\n", 0, stop) + 1))
    if not text.strip():
        raise NoTree("empty")
    return out


def regions(text: str) -> list[tuple[int, list[str]]]:
    """(line, names of the open regions from that line on)."""
    out, stack = [(0, [])], []
    for m in _REGION.finditer(text):
        stack = stack[:-1] if m["end"] else [*stack, m["name"]]
        out.append((text.count("\n", 0, m.start()) + 1, list(stack)))
    return out


LANGUAGES = {".go": "go", ".py": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "tsx", ".ts": "typescript", ".tsx": "tsx", ".bsl": "bsl", ".os": "bsl"}


def tree(text: str, language: str) -> list[Node]:
    if not text.strip():
        raise NoTree("empty")
    return python_tree(text) if language == "python" else module_tree(text) if language == "bsl" else braced_tree(text, language)


def syntax_chunks(path: str, text: str, language: str, opts: Options) -> Iterator[Chunk]:
    """Chunks of a source file: declarations whole where they fit, classes also by method, small
    neighbours and the code between together, and what is too large in partial windows."""
    lines = text.split("\n")
    package = re.search(r"(?m)^package\s+(\w+)", text) if language == "go" else None
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    base = f"package {package[1]}" if package else f"module {stem}"
    open_regions = regions(text) if language == "bsl" else [(0, [])]

    def scope_at(line: int, scope: str = base) -> str:
        names = next(n for at, n in reversed(open_regions) if at < line or at == 0)
        return " > ".join([scope, *(f"region {n}" for n in names)])

    def cut(a: int, b: int) -> list[str]:
        return lines[a - 1 : b]

    def emit(a: int, b: int, name: str, kind: str, scope: str) -> Iterator[Chunk]:
        while a <= b and not lines[a - 1].strip():
            a += 1
        while b >= a and not lines[b - 1].strip():
            b -= 1
        if a > b:
            return
        body = "\n".join(cut(a, b))
        start = sum(len(x.encode()) + 1 for x in lines[: a - 1])
        chunk = Chunk(path, a, b, body, "code", "ast", name, kind, scope, start, start + len(body.encode()))
        if opts.count(body) <= opts.budget(path, scope):
            yield chunk
        else:
            yield from partial_windows(chunk, cut(a, b), opts)

    def loose(a: int, b: int, scope: str, opener: bool = False) -> Iterator[Chunk]:
        """Code between declarations, packed by lines within the budget; too little of it is left out."""
        at = a
        while at <= b:
            if language == "bsl" and _REGION.match(lines[at - 1]):
                at += 1
                continue
            stop = at
            while stop < b and not (language == "bsl" and _REGION.match(lines[stop])) and opts.count("\n".join(cut(at, stop + 1)).strip()) <= opts.budget(path, scope):
                stop += 1
            body = "\n".join(cut(at, stop)).strip()
            if opts.count(body) >= opts.min_tokens or opener and body:
                quoted = re.search(r"""["'`]([^"'`]+)["'`]""", body)
                if re.search(r"(?m)^\s*(import|from|require)\b", body):
                    yield from emit(at, stop, quoted[1] if quoted else "", "import", scope_at(at, scope))
                elif opener or re.match(r"//|#|/\*", body):
                    yield from emit(at, stop, "" if opener else "comment", "comment", scope_at(at, scope))
                else:
                    yield from emit(at, stop, "", "", scope_at(at, scope))
            at = stop + 1

    def scope_of(n: Node, scope: str) -> str:
        """Methods stand under their type; of classes of braces only the class is told."""
        if n.owner:
            return f"{scope} > type {n.owner}" if language == "go" else f"class {n.owner}"
        return scope_at(n.start, scope)

    def walk(nodes: list[Node], a: int, b: int, scope: str, only: bool, group: bool = False) -> Iterator[Chunk]:
        held, opener = a, group  # first line not yet in a chunk
        for n in nodes:
            size = opts.count("\n".join(cut(n.start, n.end)).strip())
            if n.kind in ("const", "var", "type") and n.wrapped:  # a group: its declarations are the chunks
                yield from loose(held, n.start - 1, scope)
                yield from walk(n.children, n.start, n.end, scope, only, True)
                held = n.end + 1
                continue
            if size < opts.min_tokens and not group:
                continue  # stays with what is around it
            here = scope_of(n, scope)
            if not only:
                yield from loose(held, n.start - 1, scope, opener)
                opener = False
            inner = f"{scope} > {n.kind} {n.name}" if n.name else scope
            if size <= opts.budget(path, here):
                yield from emit(n.start, n.end, n.name, n.kind, here)
                if n.children and (n.wrapped or only):
                    yield from walk(n.children, n.start, n.end, inner, True)
            elif n.children:
                yield from walk(n.children, n.start, n.end, inner, only)
            elif not only:
                yield from emit(n.start, n.end, n.name, n.kind, here)
            held = n.end + 1
        if not only:
            yield from loose(held, b, scope, group)

    yield from walk(tree(text, language), 1, len(lines), base, False)
    if language == "bsl":
        yield from embedded_queries(path, text, opts, scope_at)
