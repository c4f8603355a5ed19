"""Chunks that follow structure: statements and definitions of many languages, blocks of Markdown documents.

A file's structure depends on all of it, so one small function reads a file at a time, in batches within the tasks.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import nesting
from .derive import CHUNK, CHUNK_COST, HEADING_COST, MARKDOWN_CAP, MAX_TOKENS, MIN_GAP, MIN_TOKENS, Tokenizer, by_file, token_starts, windows

#: Weight of the semantic term of a packing.
SEMANTIC_WEIGHT = 1.0


class Lines:
    """A text by lines (from 0), with the tokens between two of them; a line is at bounds[k] to bounds[k + 1]."""

    def __init__(self, text: str, tokenizer: Tokenizer) -> None:
        self.text, self.starts = text, tokenizer(text)
        self.bounds = [0, *(m.end() for m in re.finditer("\n", text))]
        if self.bounds[-1] != len(text) or not text:
            self.bounds.append(len(text))
        self.n = len(self.bounds) - 1

    def line(self, k: int) -> str:
        return self.text[self.bounds[k] : self.bounds[k + 1]]

    def tokens(self, a: int, b: int) -> int:
        """Tokens of the lines a to b (b excluded)."""
        return bisect_left(self.starts, self.bounds[b]) - bisect_left(self.starts, self.bounds[a])


@dataclass
class Unit:
    """Lines first to last (last excluded) of a statement, and the statements in it."""

    first: int
    last: int
    inner: list[Unit] = field(default_factory=list)


class Nested:
    """The same of a unit of ``nesting``; the units in it are placed in lines when they are asked for."""

    def __init__(self, first: int, last: int, bounds: list[int], own: nesting.Unit, width: int) -> None:
        self.first, self.last, self._bounds, self._own, self._width = first, last, bounds, own, width

    @cached_property
    def inner(self) -> list[Nested]:
        return placed(self._bounds, self._own.wide(self._width), self._width)


def placed(bounds: list[int], units: list[nesting.Unit], width: int) -> list[Nested]:
    """Units by lines, which begin at ``bounds``; of those that share a line the first counts."""
    out: list[Nested] = []
    for u in units:
        first = bisect_right(bounds, u.start) - 1
        if not out or first >= out[-1].last:
            out.append(Nested(first, bisect_right(bounds, max(u.end - 1, u.start)), bounds, u, width))
    return out


def parsed(text: str) -> ast.Module | None:
    """The syntax tree of a Python text; None where it has none, or is too deep for the parser (a MemoryError of its own)."""
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


#: The fields of a statement that hold statements; expressions hold none.
_BODIES = ("body", "handlers", "orelse", "finalbody", "cases")


def inner(node: ast.stmt) -> list[ast.stmt]:
    """The statements right within one, by place."""
    fields = node._fields
    if "body" not in fields and "cases" not in fields:
        return []
    held = [x for name in _BODIES if name in fields for x in getattr(node, name)]
    return [x for h in held for x in ([h] if isinstance(h, ast.stmt) else h.body)]


def statements(text: str) -> list[Unit]:
    """The statements of a Python text as a tree; none where it does not parse."""

    def units(nodes: list[ast.stmt]) -> list[Unit]:
        out: list[Unit] = []
        for node in nodes:
            first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]) - 1
            if not out or first >= out[-1].last:  # statements that share a line count with the first of them
                out.append(Unit(first, node.end_lineno, units(inner(node))))
        return out

    tree = parsed(text)
    try:
        return units(tree.body) if tree else []
    except RecursionError:
        return []


def nested_units(lines: Lines, language: str, width: int = 0) -> tuple[list[Nested], set[int]]:
    """The units of a text by lines, as a tree, and the lines that hold only comments and attributes.

    Plain statements within others are left out where they stand in a run of lines of less than ``width`` characters.
    """
    found, notes = nesting.scan(lines.text, language)
    return placed(lines.bounds, found, width), nesting.noted_lines(lines.text, notes)


def chosen(lines: Lines, units: list[Unit] | list[Nested], least: int, most: int, is_note: Callable[[int], bool] | None = None) -> list[tuple[int, int]]:
    """Line spans of the topmost units of ``least`` to ``most`` tokens, from top to bottom, none within another.

    Smaller ones are left, larger ones are entered. A span takes in the lines of notes right above it, without a blank
    line between, as far as the bound and the span before allow.
    """
    is_note = is_note or (lambda k: lines.line(k).lstrip(" \t").startswith("#"))
    out: list[tuple[int, int]] = []
    todo = units[::-1]
    while todo:
        u = todo.pop()
        size = lines.tokens(u.first, u.last)
        if size > most:
            todo += u.inner[::-1]
        elif size >= least:
            first, floor = u.first, out[-1][1] if out else 0
            while first > floor and is_note(first - 1) and lines.tokens(first - 1, u.last) <= most:
                first -= 1
            if u.first >= floor:
                out.append((first, u.last))
    return out


def python_spans(text: str, tokenizer: Tokenizer = token_starts, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fill_gaps: bool = True) -> list[tuple[int, int]]:
    """Character spans of a Python file's chunks, in order; with ``fill_gaps`` the lines between go in windows."""
    lines = Lines(text, tokenizer)
    return filled(lines, chosen(lines, statements(text), least, most), tokenizer, most, fill_gaps)


def code_spans(text: str, language: str | None, tokenizer: Tokenizer = token_starts, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fill_gaps: bool = True) -> list[tuple[int, int]]:
    """Character spans of a file's chunks in any language: by syntax tree, blocks or nesting; else windows of lines."""
    if language == "python":
        return python_spans(text, tokenizer, least, most, fill_gaps)
    if language == "markdown":
        return markdown_spans(text, tokenizer)
    lines = Lines(text, tokenizer)
    width = least if tokenizer is token_starts else 0  # it finds no more tokens than characters
    units, notes = nested_units(lines, language, width) if language in nesting.SYNTAX else ([], set())
    return filled(lines, chosen(lines, units, least, most, notes.__contains__), tokenizer, most, fill_gaps)


def filled(lines: Lines, spans: list[tuple[int, int]], tokenizer: Tokenizer, most: int, fill_gaps: bool) -> list[tuple[int, int]]:
    """Character spans of the chosen lines, in order; with ``fill_gaps`` the lines between go in windows."""
    out, at, text = [], 0, lines.text
    for first, last in [*spans, (lines.n, lines.n)]:
        if fill_gaps and lines.tokens(at, first) >= MIN_GAP:
            base = lines.bounds[at]
            out += [(base + a, base + b) for a, b in windows(text[base : lines.bounds[first]], tokenizer, most)]
        if last > first:
            out.append((lines.bounds[first], lines.bounds[last]))
        at = last
    return out


def _sliced(files: DataFrame, spans, tokenizer: Tokenizer) -> DataFrame:
    named = "programming_language" in files.columns

    def cut(doc: int, text: str | None, *language: str | None) -> Iterator[tuple]:
        return chunk_rows(doc, text or "", spans(text or "", *language), tokenizer)

    return by_file(files.select("doc_id", "text", *["programming_language"] * named), cut, CHUNK)


def chunk_rows(doc: int, text: str, spans: list[tuple[int, int]], tokenizer: Tokenizer = token_starts) -> Iterator[tuple]:
    """The rows of CHUNK for the spans of a file, which come in their order."""
    line, at = 1, 0
    for a, b in spans:
        code = text[a:b]
        line, at = line + text.count("\n", at, a), a
        yield doc, line, line + code.rstrip("\n").count("\n"), len(tokenizer(code)), code


def slice_python(files: DataFrame, tokenizer: Tokenizer = token_starts, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fill_gaps: bool = True) -> DataFrame:
    """doc_id, start_line, end_line, tokens, code of the chunks of Python files (doc_id, text)."""
    return _sliced(files.select("doc_id", "text"), lambda text: python_spans(text, tokenizer, least, most, fill_gaps), tokenizer)


def slice_code(files: DataFrame, tokenizer: Tokenizer = token_starts, least: int = MIN_TOKENS, most: int = MAX_TOKENS, fill_gaps: bool = True) -> DataFrame:
    """doc_id, start_line, end_line, tokens, code of the chunks of files (doc_id, text, programming_language).

    Each file is cut by its own language; one of an unknown or null language goes in windows of lines.
    """
    return _sliced(files.select("doc_id", "text", "programming_language"), lambda text, language: code_spans(text, language, tokenizer, least, most, fill_gaps), tokenizer)


#: Kinds of Markdown blocks by the start of a line; what fits none is a paragraph.
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[^`]*$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]|$)")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*$")
_ITEM = re.compile(r"( {0,3})(?:[-+*]|\d{1,9}[.)])(?:[ \t]+|$)")
_QUOTE, _HTML, _CODE = re.compile(r" {0,3}>"), re.compile(r" {0,3}<(?:[A-Za-z/!?])"), re.compile(r"(?: {4}|\t)")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")


@dataclass
class Block:
    """Lines first to last (last excluded); level: a heading's depth, 0 for any other kind."""

    first: int
    last: int
    kind: str
    level: int = 0


def blocks(lines: list[str]) -> list[Block]:
    """The blocks of a Markdown text: nine kinds, and each item of a list; blank lines part them."""
    out: list[Block] = []
    k, n = 0, len(lines)
    row = lambda i: lines[i].rstrip("\r\n")
    blank = lambda i: not lines[i].strip()
    starts = lambda i: bool(_FENCE.match(row(i)) or _ATX.match(row(i)) or _RULE.match(row(i)) or _QUOTE.match(row(i)))  # noqa: E731  ends a paragraph
    while k < n:
        if blank(k):
            k += 1
            continue
        first, line, kind, level = k, row(k), "paragraph", 0
        k += 1
        if m := _FENCE.match(line):
            kind, close = "fenced_code_block", re.compile(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}[ \t]*$")
            while k < n and not close.match(row(k)):
                k += 1
            k = min(k + 1, n)
        elif m := _ATX.match(line):
            kind, level = "atx_heading", len(m[1])
        elif _RULE.match(line):
            kind = "thematic_break"
        elif _QUOTE.match(line):
            kind = "block_quote"
            while k < n and not blank(k) and (_QUOTE.match(row(k)) or not (starts(k) or _ITEM.match(row(k)))):
                k += 1
        elif m := _ITEM.match(line):
            kind, indent = "list_item", len(m[1]) + 2
            while k < n:
                deep = len(row(k)) - len(row(k).lstrip()) >= indent
                if blank(k):
                    after = next((i for i in range(k, n) if not blank(i)), n)
                    if after == n or len(row(after)) - len(row(after).lstrip()) < indent:
                        break
                elif not deep and (_ITEM.match(row(k)) or starts(k) or blank(k - 1)):
                    break
                k += 1
        elif _HTML.match(line):
            kind = "html_block"
            while k < n and not blank(k):
                k += 1
        elif _CODE.match(line):
            kind = "indented_code_block"
            while k < n and (_CODE.match(row(k)) or blank(k) and any(_CODE.match(row(i)) for i in range(k, min(k + 8, n)) if not blank(i))):
                k += 1
        elif "|" in line and k < n and "|" in row(k) and _DELIMITER.match(row(k)):
            kind = "table"
            while k < n and not blank(k) and not starts(k):
                k += 1
        else:
            while k < n and not blank(k):
                if _SETEXT.match(row(k)):
                    kind, level, k = "setext_heading", 1, k + 1
                    break
                if starts(k) or _ITEM.match(row(k)):
                    break
                k += 1
        out.append(Block(first, k, kind, level))
    return out


def packed(lines: Lines, bs: list[Block], cap: int = MARKDOWN_CAP, vectors: np.ndarray | None = None, weight: float = SEMANTIC_WEIGHT) -> list[tuple[int, int]]:
    """The cheapest packing of blocks into chunks, as (first, last) blocks with last excluded.

    A chunk costs CHUNK_COST, each heading of level 3 or deeper inside it HEADING_COST, and, with vectors (one per
    block), ``weight`` times what its blocks miss to point the same way: their tokens' share of the document less the
    length of the weighted sum of their unit vectors. Both are differences of prefix sums. Headings of level 1 and 2
    always begin a chunk; more than ``cap`` tokens only a single block may have.
    """
    n = len(bs)
    # tokens before the first and after the last line of each block
    lo, hi = [bisect_left(lines.starts, lines.bounds[b.first]) for b in bs], [bisect_left(lines.starts, lines.bounds[b.last]) for b in bs]
    if vectors is not None and n:
        size = np.array(hi, float) - np.array(lo, float)
        w = size / max(size.sum(), 1.0)
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
        mass, sums = np.r_[0.0, np.cumsum(w)], np.vstack([np.zeros(vectors.shape[1]), np.cumsum(w[:, None] * unit, axis=0)])
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        inside = 0.0
        for start in range(end - 1, -1, -1):
            if start < end - 1 and hi[end - 1] - lo[start] > cap:
                break
            cost = best[start] + CHUNK_COST + inside
            if vectors is not None:
                cost += weight * max(0.0, mass[end] - mass[start] - float(np.linalg.norm(sums[end] - sums[start])))
            if cost < best[end]:
                best[end], back[end] = cost, start
            if bs[start].level in (1, 2):
                break
            inside += HEADING_COST if bs[start].level else 0.0
    out, at = [], n
    while at:
        out.append((back[at], at))
        at = back[at]
    return out[::-1]


def markdown_spans(text: str, tokenizer: Tokenizer = token_starts, cap: int = MARKDOWN_CAP, embed=None) -> list[tuple[int, int]]:
    """Character spans of a Markdown document's chunks; a block above the cap goes in pieces, by lines, then by tokens."""
    lines = Lines(text, tokenizer)
    bs = blocks([lines.line(k) for k in range(lines.n)])
    vectors = embed([text[lines.bounds[b.first] : lines.bounds[b.last]] for b in bs]) if embed and bs else None
    out = []
    for i, j in packed(lines, bs, cap, vectors):
        first, last = bs[i].first, bs[j - 1].last
        if lines.tokens(first, last) <= cap:
            out.append((lines.bounds[first], lines.bounds[last]))
            continue
        at = first
        for k in range(first, last):  # one block above the cap
            if lines.tokens(at, k + 1) <= cap:
                continue
            if k > at:
                out.append((lines.bounds[at], lines.bounds[k]))
            at = k
            if lines.tokens(k, k + 1) > cap:
                lo, hi = bisect_left(lines.starts, lines.bounds[k]), bisect_left(lines.starts, lines.bounds[k + 1])
                cuts = [lines.bounds[k], *(lines.starts[t] for t in range(lo + cap, hi, cap)), lines.bounds[k + 1]]
                out += list(zip(cuts, cuts[1:]))
                at = k + 1
        if at < last:
            out.append((lines.bounds[at], lines.bounds[last]))
    return out


def slice_markdown(files: DataFrame, tokenizer: Tokenizer = token_starts, cap: int = MARKDOWN_CAP, embed=None) -> DataFrame:
    """doc_id, start_line, end_line, tokens, code of the chunks of Markdown documents (doc_id, text)."""
    return _sliced(files.select("doc_id", "text"), lambda text: markdown_spans(text, tokenizer, cap, embed), tokenizer)


def markdown_blocks(files: DataFrame, tokenizer: Tokenizer = token_starts) -> DataFrame:
    """doc_id, k, kind, level, start_line, end_line, tokens of each block of Markdown documents (doc_id, text)."""

    def cut(doc: int, text: str | None) -> Iterator[tuple]:
        lines = Lines(text or "", tokenizer)
        for k, b in enumerate(blocks([lines.line(i) for i in range(lines.n)])):
            yield doc, k, b.kind, b.level, b.first + 1, b.last, lines.tokens(b.first, b.last)

    return by_file(files.select("doc_id", "text"), cut, "doc_id long, k int, kind string, level int, start_line int, end_line int, tokens int")


#: A definition's kind and name at the start of a line.
_JS = r"^[ \t]*(?:export[ ]+)?(?:default[ ]+)?(?:async[ ]+)?(function\*?|class|const|let)[ ]+([A-Za-z_$][\w$]*)"
_TS = r"^[ \t]*(?:export[ ]+)?(?:default[ ]+)?(?:declare[ ]+)?(?:abstract[ ]+)?(?:async[ ]+)?(function\*?|class|interface|type|enum|namespace|const|let)[ ]+([A-Za-z_$][\w$]*)"
_TYPED = r"(?:[\w:<>,\[\]*&~]+[ ]+[*&]?)+"
DEFINITIONS = {
    "rust": r"^[ \t]*(?:pub(?:\([a-z ]+\))?[ ]+)?(?:default[ ]+)?(?:async[ ]+)?(?:unsafe[ ]+)?(fn|struct|enum|trait|mod|type|const|static|union|macro_rules!)[ ]+([A-Za-z_]\w*)",
    "go": r"^(func|type|var|const)[ ]+(?:\([^)]*\)[ ]*)?([A-Za-z_]\w*)",
    "javascript": _JS,
    "typescript": _TS,
    "tsx": _TS,
    "c": rf"^(struct|enum|union|typedef|#define)[ ]+([A-Za-z_]\w*)|^(?!(?:return|else|typedef)\b){_TYPED}([A-Za-z_]\w*)\([^;]*$",
    "cpp": rf"^[ \t]*(class|struct|enum(?: class)?|union|namespace)[ ]+([A-Za-z_]\w*)|^(?!(?:return|else|using|typedef)\b){_TYPED}(?:[A-Za-z_]\w*::)*(~?[A-Za-z_]\w*)\([^;]*$",
    "java": rf"^[ \t]*(?:(?:public|protected|private|static|final|abstract|sealed)[ ]+)*(class|interface|enum|record|@interface)[ ]+([A-Za-z_]\w*)|^[ \t]+(?:(?:public|protected|private|static|final|abstract|synchronized)[ ]+)+{_TYPED}?([A-Za-z_]\w*)\([^;]*$",
    "csharp": rf"^[ \t]*(?:(?:public|protected|private|internal|static|sealed|abstract|partial)[ ]+)*(class|interface|struct|enum|record|namespace)[ ]+([A-Za-z_][\w.]*)|^[ \t]+(?:(?:public|protected|private|internal|static|override|virtual|async)[ ]+)+{_TYPED}?([A-Za-z_]\w*)\([^;]*$",
    "ruby": r"^[ \t]*(def|class|module)[ ]+((?:self\.)?[A-Za-z_][\w:]*[?!=]?)",
    "php": r"^[ \t]*(?:(?:public|protected|private|static|final|abstract)[ ]+)*(function|class|interface|trait|enum)[ ]+&?([A-Za-z_]\w*)",
    "ocaml": r"^[ \t]*(let(?: rec)?|type|module(?: type)?|exception|val|external|class)[ ]+([A-Za-z_][\w']*)",
    "scala": r"^[ \t]*(?:(?:private|protected|override|implicit|final|sealed|abstract|case|lazy)[ ]+)*(def|class|object|trait|val|var|type|enum)[ ]+([A-Za-z_]\w*)",
}
SYMBOL = "doc_id long, name string, kind string, start_line int, end_line int"


def python_symbols(files: DataFrame) -> DataFrame:
    """Classes, functions and module constants of Python files (doc_id, text), by their syntax tree.

    Of a file that does not parse, the lines that begin a definition are told (kind def or class).
    """
    head = re.compile(r"^[ \t]*(?:async )?(def|class) +([A-Za-z_]\w*)", re.ASCII)

    def read(doc: int, text: str | None) -> Iterator[tuple]:
        tree = parsed(text or "")
        if tree is None:
            hits = ((i, head.match(line)) for i, line in enumerate((text or "").split("\n"), 1))
            yield from ((doc, m[2], m[1], i, i) for i, m in hits if m)
            return
        todo = [(node, True) for node in tree.body]
        while todo:
            node, top = todo.pop()
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                yield doc, node.name, "class" if isinstance(node, ast.ClassDef) else "function", node.lineno, node.end_lineno
            elif top and isinstance(node, (ast.Assign, ast.AnnAssign)):
                targets = node.targets if isinstance(node, ast.Assign) else [node.target]
                yield from ((doc, t.id, "constant", node.lineno, node.end_lineno) for t in targets if isinstance(t, ast.Name))
            todo += [(c, False) for c in inner(node)]

    return by_file(files.select("doc_id", "text"), read, SYMBOL)


DEFINITION = "doc_id long, name string, kind string, start_line int, end_line int, start_column int, end_column int, parent_name string, parent_kind string"


def python_definitions(text: str) -> list[tuple[str, str, int, int, str | None, str | None]]:
    """(name, kind, start, end, parent name, parent kind) of the classes and functions of a Python text, by place."""
    tree = parsed(text)
    if tree is None:
        return []
    # places in the syntax tree are lines and bytes
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    at = lambda line, column: starts[line - 1] + len(text[starts[line - 1] :].split("\n", 1)[0].encode()[:column].decode("utf-8", "ignore"))
    out, todo = [], [(node, None) for node in reversed(tree.body)]
    while todo:
        node, parent = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            own = (node.name, "class" if isinstance(node, ast.ClassDef) else "function")
            out.append((*own, at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset), *(parent or (None, None))))
            parent = own
        todo += [(c, parent) for c in reversed(inner(node))]
    return out


def places(text: str, ats: Iterable[int]) -> dict[int, tuple[int, int]]:
    """The line (from 1) and the column (bytes from 0) of places in a text, which is passed once."""
    out, line, column, last = {}, 1, 0, 0
    for at in sorted(set(ats)):
        piece = text[last:at]
        if ends := piece.count("\n"):
            line, column, piece = line + ends, 0, piece[piece.rfind("\n") + 1 :]
        column, last = column + len(piece.encode()), at
        out[at] = line, column
    return out


def definition_rows(doc: int, text: str | None, language: str | None) -> Iterator[tuple]:
    """The rows of DEFINITION for one file."""
    text = text or ""
    found = python_definitions(text) if language == "python" else nesting.definitions(text, language) if language in nesting.SYNTAX else []
    # an end is found from the last character before it, as it may be the beginning of the next line
    at = places(text, [x for d in found for x in (d[2], max(d[3] - 1, d[2]))])
    for name, kind, start, end, *parent in found:
        before = max(end - 1, start)
        (first, begin), (last, column) = at[start], at[before]
        yield doc, name, kind, first, last, begin, column + len(text[before:end].encode()), *parent


def definitions(files: DataFrame) -> DataFrame:
    """The definitions in files (doc_id, text, programming_language), with true ends and the innermost one around each.

    doc_id, name, kind, start_line, end_line (from 1), start_column, end_column (bytes from 0, the end exclusive),
    parent_name, parent_kind. Python's come from its syntax tree, those of the languages of ``nesting`` from a scan of
    brackets; a function within a class is a method there. Files of other languages have none.
    """

    return by_file(files.select("doc_id", "text", "programming_language"), definition_rows, DEFINITION)


def symbols(files: DataFrame, language: str) -> DataFrame:
    """doc_id, name, kind, start_line, end_line of the definitions in files (doc_id, text) of one language.

    Python's come from its syntax tree, with module constants. Those of the languages that ``nesting`` knows have their
    true ends; OCaml's come from one pattern per line. Other languages have none.
    """
    if language == "python":
        return python_symbols(files)
    if language in nesting.DEFINES:
        return definitions(files.withColumn("programming_language", F.lit(language))).select("doc_id", "name", "kind", "start_line", "end_line")
    return line_symbols(files, language)


def line_symbols(files: DataFrame, language: str) -> DataFrame:
    """The same from one pattern per line, for files that are broken or partial: end_line is start_line, the kind is the
    word that defines, and a definition over several lines is found by its first."""
    if language not in DEFINITIONS:
        return files.select("doc_id", F.lit("").alias("name"), F.lit("").alias("kind"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line")).limit(0)
    regex = DEFINITIONS[language]
    part = lambda k: F.regexp_extract("_line", regex, k)
    other = part(3) if re.compile(regex).groups > 2 else F.lit("")
    lines = files.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_i", "_line")).where(F.col("_line").rlike(regex))
    at = (F.col("_i") + 1).cast("int")
    return lines.select("doc_id", F.when(part(2) != "", part(2)).otherwise(other).alias("name"), F.when(part(1) != "", F.lower(part(1))).otherwise("function").alias("kind"), at.alias("start_line"), at.alias("end_line"))
