"""Nesting of a source text without its grammar: units with their true ends.

A scan knows the comments, strings and brackets of a language, and what ends a statement in it. It yields a tree: a unit
is a statement or definition of a body, and the units of the bodies in it, at any depth of brackets, are its inner ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\[\s\S])*+"?', r"'(?:[^'\\\n]|\\[\s\S])*+'?"
_CHAR = r"'(?:[^'\\\n]|\\(?:[^\nxu]|x[0-9A-Fa-f]{1,2}|u\{?[0-9A-Fa-f]+\}?))'"
_LONG = r'"""[\s\S]*?(?:"""|\Z)'
_SLASHES, _BLOCK = r"//[^\n]*+", r"/\*[\s\S]*?(?:\*/|\Z)"
#: A slash begins an expression, not a division, after an opening mark or an operator.
_REGEX = r"(?<=[=(,:\[!&|?;{}\n])[\x20\t]*/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*"
_TEMPLATE = r"`(?:[^`\\]|\\[\s\S])*+`?"


@dataclass(frozen=True)
class Syntax:
    """What the scan has to know of a language."""

    #: Comments, and what stands before a unit without being of it.
    notes: str = f"{_SLASHES}|{_BLOCK}"
    #: A reference to the one group that a pattern may have is \\2, as the lexer's own group is around it.
    strings: str = f"{_DOUBLE}|{_CHAR}"
    #: Comments within comments have their own ends.
    nested: bool = False
    #: Whole lines that are a unit.
    lines: str = r"(?!)"
    #: The end of a line ends a unit, where neither side goes on.
    newline: bool = False
    #: Words that go on after a closing brace, and words that a line goes on with.
    more: str = "else|catch|finally|as"
    #: Heads of units that go on on the line of their closing brace: ``struct {...} name;``.
    trails: str = r"(?!)"
    #: Words that open and close a body in place of braces.
    opens: str = r"(?!)"
    shut: str = r"(?!)"
    separator: str = ";"
    #: Marks of a plain statement beside words, blanks, closed strings and round or square brackets.
    plain: str = r".,=<>+*%&|^~!-"
    #: Marks that the head of a body may have beside them.
    heads: str = ":"


_JS = Syntax(strings=f"{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|{_REGEX}", newline=True, more="else|catch|finally|while|from|as|satisfies|extends|implements|instanceof|in|of")
_C = Syntax(strings=rf'[LuU8]*R"([^(\s]*+)\([\s\S]*?(?:\)\2"|\Z)|{_DOUBLE}|{_CHAR}', lines=r"^[\x20\t]*#(?:[^\n\\]|\\[\s\S])*+", more="else|catch|while", trails=r"\b(?:typedef|struct|union|enum|class)\b")
SYNTAX = {
    "rust": Syntax(notes=rf"{_SLASHES}|/\*|#!?\[(?:[^\[\]\"]|\"(?:[^\"\\]|\\[\s\S])*+\"|\[[^\]]*\])*+\]", strings=r'b?r(#*+)"[\s\S]*?(?:"\2|\Z)|b?"(?:[^"\\]|\\[\s\S])*+"?|' + f"b?{_CHAR}", nested=True),
    "go": Syntax(strings=f"`[^`]*+`?|{_DOUBLE}|{_CHAR}", newline=True, more="else"),
    "javascript": _JS,
    "typescript": _JS,
    "tsx": _JS,
    "c": _C,
    "cpp": replace(_C, heads="", notes=rf"{_SLASHES}|{_BLOCK}|\b(?:public|private|protected)[\x20\t]*:(?!:)"),
    "java": Syntax(strings=f"{_LONG}|{_DOUBLE}|{_CHAR}", more="else|catch|finally|while"),
    "csharp": Syntax(strings=rf'{_LONG}|\$?@\$?"(?:[^"]|"")*+"?|\$?{_DOUBLE}|{_CHAR}', lines=r"^[\x20\t]*#[^\n]*+", more="else|catch|finally|while"),
    "php": Syntax(plain=r".,=>+*%&|^~!-", notes=rf"{_SLASHES}|{_BLOCK}|#(?!\[)[^\n]*+|<\?(?:php|=)?|\?>", strings=r"<<<[\x20\t]*[\"']?(\w+)[\"']?\n[\s\S]*?(?:\n[\x20\t]*\2\b|\Z)|\"(?:[^\"\\]|\\[\s\S])*+\"?|'(?:[^'\\]|\\[\s\S])*+'?", more="else|elseif|catch|finally|while"),
    "scala": Syntax(notes=rf"{_SLASHES}|/\*", strings=f"{_LONG}|{_DOUBLE}|{_CHAR}", nested=True, newline=True, more="else|catch|finally|extends|with|yield|match|while"),
    "zig": Syntax(notes=_SLASHES, strings=rf"\\\\[^\n]*+|{_DOUBLE}|{_CHAR}"),
    "css": Syntax(notes=_BLOCK, strings=f"{_DOUBLE}|{_SINGLE}"),
    "json": Syntax(plain="", notes=f"{_SLASHES}|{_BLOCK}", strings=_DOUBLE, separator=","),
    "ruby": Syntax(
        plain="",
        notes=r"#[^\n]*+|^=begin\b[\s\S]*?(?:^=end\b[^\n]*+|\Z)", strings=f"{_DOUBLE}|{_SINGLE}|{_TEMPLATE}|{_REGEX}", newline=True, more="else|elsif|rescue|ensure|when",
        opens=r"(?<![.:@$\w])(?:(?:class|module|def(?![\x20]+[\w.]+[?!]?(?:\([^()\n]*\))?[\x20]+=\s)|begin|case|if|unless)(?![\w?!:=])|(?:while|until|for)(?![\w?!:=])(?:[^\n#]*?\sdo(?=[\x20\t]*(?:#|$)))?|do(?![\w?!:=])(?:[\x20\t]*\|[^|\n]*+\|)?)", shut=r"(?<![.:@$\w])end(?![\w?!:=])",
    ),
}
#: These open nothing after their statement.
_MODIFIERS = ("if", "unless", "while", "until")
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: A line goes on after these and with these; what follows a closing brace on a new line goes on with the last.
_BEFORE, _AFTER, _AFTER_BODY = set("=+-*/%&|^,.:([{~\\"), set("=+%&|^>,.?:"), set("=,.?:")


@dataclass(slots=True)
class Run:
    """Lines start to end, each a plain statement; they become units when they are asked for."""

    text: str
    start: int
    end: int

    def width(self) -> int:
        return max(map(len, self.text[self.start : self.end].split("\n")))

    def units(self) -> Iterator[Unit]:
        at = self.start
        for line in self.text[self.start : self.end].split("\n"):
            first, last = at + len(line) - len(line.lstrip(" \t")), at + len(line.rstrip(" \t\r"))
            if first < last:
                yield Unit(first, last, last)
            at += len(line) + 1


@dataclass(slots=True)
class Unit:
    """Characters start to end; head: the first place where a body opens, else the end."""

    start: int
    end: int = -1
    head: int = -1
    parts: list[Unit | Run] = field(default_factory=list)

    @property
    def inner(self) -> list[Unit]:
        """The units of its bodies."""
        return self.wide(0)

    def wide(self, width: int) -> list[Unit]:
        """The same without runs of lines that all have less than ``width`` characters."""
        return [u for p in self.parts for u in ((p,) if isinstance(p, Unit) else p.units() if p.width() >= width else ())]


#: A string that none of the other forms of a language can be.
_TEXT = r'(?<![\w$@])"(?!"")[^"\\\n]*+(?:\\[^\n][^"\\\n]*+)*+"'


def _plain(marks: str) -> str:
    """Words, marks, strings and brackets on one line, with nothing in them that could be a note, a body or a string of any
    other form; brackets stand two deep, which may hold separators."""
    marks = rf"\w\x20\t$@{marks}"
    inside = rf"[;{marks}]*+(?:{_TEXT}[;{marks}]*+)*+"
    deep = rf"{inside}(?:(?:\({inside}\)|\[{inside}\]){inside})*+"
    return rf"[^\W\d][{marks}]*+(?:(?:\({deep}\)|\[{deep}\]|{_TEXT})[{marks}]*+)*+"


def _statement(s: Syntax) -> str:
    """Whole lines, each one plain statement: read at once, they leave what their parts would leave one by one."""
    return rf"(?:^[\x20\t]*+{_plain(s.plain)};[\x20\t\r]*+\n)++" if s.plain else r"(?!)"


def _head(s: Syntax) -> str:
    """From the beginning of a line to a brace that opens a body, with no more in it than a plain statement has."""
    return rf"^[\x20\t]*+(?P<to>{_plain(s.heads + s.plain)}\{{)(?:[\x20\t\r]*+\n)?+" if s.plain else r"(?!)"


def _tail(s: Syntax) -> str:
    """A closing brace that has a line to itself, with the end of the line."""
    return r"^[\x20\t]*+(?P<brace>\})[\x20\t\r]*+\n" if s.plain else r"(?!)"


def _lexer(s: Syntax) -> re.Pattern[str]:
    return re.compile(rf"(?P<string>{s.strings})|(?P<note>{s.notes})|(?P<line>{s.lines})|(?P<statement>{_statement(s)})|(?P<head>{_head(s)})|(?P<tail>{_tail(s)})|(?P<opens>{s.opens})|(?P<shut>{s.shut})|(?P<mark>[()\[\]{{}}])|(?P<end>{re.escape(s.separator)})|(?P<nl>\n)|(?P<word>[\w$@]++|[^\s\w])", re.M)


_LEXERS = {name: _lexer(s) for name, s in SYNTAX.items()}
_MORE, _TRAILS = {name: re.compile(rf"(?:{s.more})\b") for name, s in SYNTAX.items()}, {name: re.compile(s.trails) for name, s in SYNTAX.items()}
_COMMENT_EDGE = re.compile(r"/\*|\*/")
#: The part of a match that is told, of those that take in blanks and the end of their line.
_OWN = {"head": "to", "tail": "brace"}


def tokens(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what stands in a text; white space is left out, and the line end that a statement, the head of
    a body (with its brace) or a brace alone on its line has."""
    for kind, start, end in _lexed(text, language):
        if kind == "statement":
            yield from ((kind, u.start, u.end) for u in Run(text, start, end).units())
        else:
            yield kind, start, end


def _lexed(text: str, language: str) -> Iterator[tuple[str, int, int]]:
    """The same, where lines of plain statements that follow one another are one: from the first line's beginning to the
    end of the last statement."""
    nested, lexer, at = SYNTAX[language].nested, _LEXERS[language], 0
    while at < len(text):
        for m in lexer.finditer(text, at):
            kind = m.lastgroup
            if nested and kind == "note" and m["note"] == "/*":
                depth, at = 1, m.end()
                while depth and (edge := _COMMENT_EDGE.search(text, at)):
                    depth += 1 if edge[0] == "/*" else -1
                    at = edge.end()
                if depth:
                    at = len(text)
                yield kind, m.start(), at
                break
            if kind == "statement":
                yield kind, m.start(), text.rfind(";", 0, m.end()) + 1
            else:
                yield kind, *m.span(_OWN.get(kind, 0))
        else:
            return


def scan(text: str, language: str) -> tuple[list[Unit], list[tuple[int, int]]]:
    """The units of a text, and the places of its notes (comments and attributes)."""
    syntax, more, trails = SYNTAX[language], _MORE[language], _TRAILS[language]
    top = Unit(0)
    # a frame: mark that opened it, the unit its bodies belong to, the unit under way in it, whether it has units
    frames: list[list] = [["", top, None, True]]
    open_marks: dict[str, int] = {}
    notes: list[tuple[int, int]] = []
    last = 0  # end of the last thing that is not a note
    closed = broke = False  # a body of the unit under way has just closed; a line has ended since the last thing

    def finish(frame: list, end: int) -> None:
        if frame[2] is not None:
            frame[2].end = end
            if frame[2].head < 0:
                frame[2].head = end
            frame[1].parts.append(frame[2])
            frame[2] = None

    for kind, start, end in _lexed(text, language):
        if kind == "nl":
            broke = True
            continue
        if kind == "note":
            notes.append((start, end))
            continue
        frame = frames[-1]
        if kind == "statement" and frame[2] is None:
            if frame[3]:
                frame[1].parts.append(Run(text, start, end))
            last, broke, closed = end, True, False
            continue
        run = start, end
        if kind == "statement":  # the first of them may belong to the unit under way
            stop = text.find("\n", start, end)
            line = text[start : end if stop < 0 else stop]
            start, end = start + len(line) - len(line.lstrip(" \t")), start + len(line.rstrip(" \t\r"))
        mark = text[start:end]
        shuts = kind in ("shut", "tail") or kind == "mark" and mark in _PAIRS
        if frame[3] and frame[2] is not None and kind != "end" and not shuts:
            # does the unit under way go on with this?
            if closed and broke:
                goes_on = kind in ("word", "statement", "head") and (bool(more.match(text, start)) or mark in _AFTER_BODY)
            elif closed:
                goes_on = kind in ("word", "statement", "head", "mark") and (kind == "mark" or not mark[0].isalnum() or bool(more.match(text, start)) or bool(trails.search(text, frame[2].start, frame[2].head)))
            elif syntax.newline and broke:
                before = text[max(last - 2, 0) : last]
                goes_on = mark in _AFTER or mark == "{" or bool(more.match(text, start)) or before == "=>" or before not in ("++", "--") and before[-1:] in _BEFORE
            else:
                goes_on = kind != "line"
            if not goes_on:
                finish(frame, last)
        if kind == "statement":
            if frame[3] and frame[2] is None:
                frame[2] = Unit(start)
            if frame[3]:
                finish(frame, end)
                if end < run[1]:
                    frame[1].parts.append(Run(text, text.find("\n", end) + 1, run[1]))
            end = run[1]
            last, broke, closed = end, True, False
            continue
        if kind == "line":
            if frame[3] and frame[2] is None:
                frame[1].parts.append(Unit(start + len(mark) - len(mark.lstrip()), end, end))
        elif kind == "end":
            if frame[3]:
                finish(frame, end if frame[2] is not None and syntax.separator == ";" else last)
        elif shuts:
            opener = "end" if kind == "shut" else _PAIRS[mark]
            if open_marks.get(opener):
                while True:
                    gone = frames.pop()
                    finish(gone, last)
                    open_marks[gone[0]] -= 1
                    if gone[0] == opener:
                        break
                closed = gone[3]
                last, broke = end, kind == "tail"
                continue
        else:
            begins = frame[3] and frame[2] is None
            if begins:
                frame[2] = Unit(start)
            own = frame[2] if frame[3] else frame[1]
            opens = kind == "opens" and (begins or not mark.startswith(_MODIFIERS) or text[last - 1] in _BEFORE)
            if kind == "head":  # its words and brackets have begun the unit; its brace is left
                kind, start, mark = "mark", end - 1, "{"
            if opens or kind == "mark":
                body = opens or mark == "{" or mark == "[" and syntax.separator == ","
                if body and own.head < 0 and frame[2] is own:
                    line = text.find("\n", start)
                    own.head = start if kind == "mark" else line if line >= 0 else len(text)
                opener = "end" if opens else mark
                frames.append([opener, own, None, body])
                open_marks[opener] = open_marks.get(opener, 0) + 1
        last, broke, closed = end, kind == "tail", False
    while frames:
        finish(frames.pop(), last)
    return top.inner, notes


def noted_lines(text: str, notes: list[tuple[int, int]]) -> set[int]:
    """The lines (from 0) that hold nothing but notes."""
    out, row, at = set(), 0, 0
    for start, end in notes:
        row += text.count("\n", at, start)
        line_start = text.rfind("\n", 0, start) + 1
        high = row + text.count("\n", start, end)
        stop = text.find("\n", end)
        tail = text[end : stop if stop >= 0 else len(text)]
        if not text[line_start:start].strip() and not tail.strip():
            out.update(range(row, high + 1))
        row, at = high, end
    return out


#: What may stand before the word that defines.
_BEFORE_DEF = re.compile(
    r"(?:@[\w.]++(?:\((?:[^()\"]|\"(?:[^\"\\]|\\[\s\S])*+\"|\([^()]*+\))*+\))?\s*+|#?\[(?:[^\]\"]|\"(?:[^\"\\]|\\[\s\S])*+\")*+\]\s*+|template\s*<[^{};]*?>\s*+"
    r"|(?:pub(?:\([^)]*+\))?|export|default|declare|abstract|async|unsafe|extern(?:\s*\"[^\"]*+\")?|public|private|protected|internal|static|final|sealed|non-sealed|partial|override|virtual|readonly|inline|implicit|lazy|open|synchronized|native|constexpr|explicit|typedef|strictfp|case(?=\s+(?:class|object))|const(?=\s+(?:fn|unsafe|async|enum)))\b(?:\[[^\]]*+\])?\s*+)*+"
)
_NAME = r"\s+&?([A-Za-z_$][\w$]*+)"
#: Kind by the word that defines; a function within a class is a method.
_WORDS = {
    "rust": {"fn": "function", "struct": "class", "enum": "class", "union": "class", "type": "class", "trait": "interface", "mod": "module", "macro_rules!": "macro"},
    "go": {"func": "function", "type": "type"},
    "javascript": {"function": "function", "function*": "function", "class": "class"},
    "typescript": {"function": "function", "function*": "function", "class": "class", "interface": "interface", "namespace": "module", "module": "module", "type": "type", "enum": "enum"},
    "c": {"struct": "class", "union": "class", "enum": "type"},
    "cpp": {"struct": "class", "union": "class", "class": "class", "enum": "type", "enum class": "type", "namespace": "module"},
    "java": {"class": "class", "interface": "interface", "@interface": "interface", "enum": "class", "record": "class"},
    "csharp": {"class": "class", "interface": "interface", "struct": "class", "record": "class", "record struct": "class", "enum": "class", "namespace": "module"},
    "php": {"function": "function", "class": "class", "interface": "interface", "trait": "interface", "enum": "class", "namespace": "module"},
    "scala": {"def": "function", "class": "class", "object": "object", "trait": "interface", "enum": "enum", "val": "variable", "var": "variable", "type": "type"},
    "ruby": {"def": "method", "class": "class", "module": "module"},
    "zig": {"fn": "function"},
}
_WORDS["tsx"] = _WORDS["typescript"]
#: Languages whose definitions are told; of the others only the units are.
DEFINES = frozenset(_WORDS)
#: These need a body to define something, where they may also only name a type.
_NEEDS_BODY = {"struct", "union", "enum", "enum class"}
_CLASSLIKE = {"class", "interface", "module", "object", "enum", "impl"}
_TYPED = {"c", "cpp", "java", "csharp"}
#: What stands before a function's parameters, and the name at its end.
_TO_BRACKET, _TYPE_LIKE, _CALLED = re.compile(r"[^=(]*+(?=\()"), re.compile(r"[\w\s:<>,\[\]*&~?.$]++"), re.compile(r"((?:\w+::)*+~?[A-Za-z_$][\w$]*+)\s*+(?:<[^<>()]*+>\s*+)?$")
_NOT_FUNCTIONS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "sizeof", "using", "lock", "foreach", "new", "throw", "synchronized", "await", "assert", "fixed", "defined", "try", "with", "super", "this"}
_RECEIVER, _ARROW, _MEMBER = re.compile(r"func\s*\([^)]*+\)\s*([A-Za-z_]\w*+)"), re.compile(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*+)\s*(?::[^=]*+)?=\s*(?:async\s*)?(?:function\b|\([^)]*+\)[^=;{]*?=>|[A-Za-z_$][\w$]*\s*=>)"), re.compile(r"(?:get\s+|set\s+|\*\s*)?(#?[A-Za-z_$][\w$]*+)\s*(?:<[^<>()]*>\s*)?\(")
_IMPL, _TYPEDEF = re.compile(r"(?:unsafe\s+)?impl\b"), re.compile(r"([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*;\s*$")
_KEYWORD = {name: re.compile(rf"({'|'.join(re.escape(w).replace(chr(92) + ' ', r'[ ]+') for w in sorted(words, key=len, reverse=True))}){_NAME if name != 'ruby' else r'[ ]+((?:self[.])?[A-Za-z_][A-Za-z0-9_:]*[?!=]?|[^ A-Za-z0-9(]+)'}") for name, words in _WORDS.items()}


#: The words that a definition of a language may begin with, whatever it stands in.
_FIRST = {name: frozenset("pub export default declare abstract async unsafe extern public private protected internal static final sealed non partial override virtual readonly inline implicit lazy open synchronized native constexpr explicit typedef strictfp case const template let var".split()) | {re.match(r"\w*", word)[0] for word in words} for name, words in _WORDS.items()}
_FIRST_WORD = re.compile(r"[A-Za-z_]\w*+")
_BEGINS = {name: rf"[\x20\t]*+(?=[{''.join(sorted({w[0] for w in words - {''}}))}])(?:{'|'.join(sorted(words - {''}))})\b" for name, words in _FIRST.items()}
_FIRST_OF_LINE, _FIRST_OF_NEXT = {name: re.compile(p) for name, p in _BEGINS.items()}, {name: re.compile(rf"\n{p}") for name, p in _BEGINS.items()}


def defining(text: str, unit: Unit, language: str, around: str) -> list[Unit]:
    """The units of a unit's bodies, without those whose first word shows that neither they nor units in them define."""
    if language in _TYPED and around not in ("function", "method") or around in ("class", "interface") and language in ("javascript", "typescript", "tsx"):
        return unit.inner
    out: list[Unit] = []
    for p in unit.parts:
        if isinstance(p, Run):
            out += p.units() if _FIRST_OF_LINE[language].match(text, p.start, p.end) or _FIRST_OF_NEXT[language].search(text, p.start, p.end) else ()
        elif p.parts or not (word := _FIRST_WORD.match(text, p.start, p.head)) or word[0] in _FIRST[language]:
            out.append(p)
    return out


def definition(text: str, unit: Unit, language: str, around: str) -> tuple[str, str] | None:
    """(name, kind) of what a unit defines; around: the kind of the unit that it stands in (empty: none)."""
    if language not in _WORDS:
        return None
    head = text[unit.start : unit.head]
    bare = _BEFORE_DEF.match(head).end()
    has_body = unit.head < unit.end
    method = "method" if around in _CLASSLIKE - {"module"} else "function"
    if m := _KEYWORD[language].match(head, bare):
        word = " ".join(m[1].split())
        kind = _WORDS[language][word]
        if head.startswith("typedef") and (t := _TYPEDEF.search(text, unit.head if has_body else unit.start, unit.end)):
            return t[1], "type"
        if not (language in ("c", "cpp") and word in _NEEDS_BODY) or has_body and not head[m.end() :].strip().startswith(("=", "(")):
            if language in ("c", "cpp") and word in _NEEDS_BODY and "(" in head[m.end() :] and ":" not in head[m.end() :]:
                pass  # a function that returns a struct
            else:
                return m[2], method if kind == "function" else kind
    if language == "go" and (m := _RECEIVER.match(head)):
        return m[1], "method"
    if language in ("javascript", "typescript", "tsx"):
        if m := _ARROW.match(head + text[unit.head : unit.head + 1], bare):
            return m[1], "function"
        if around in ("class", "interface") and (m := _MEMBER.match(head, bare)):
            return m[1], "method"
    if language in _TYPED and around not in ("function", "method"):
        if head.startswith("typedef"):
            t = _TYPEDEF.search(text, unit.start, unit.end)
            return (t[1], "type") if t else None
        before = _TO_BRACKET.match(head[bare:])
        if before and _TYPE_LIKE.fullmatch(before[0]) and (m := _CALLED.search(before[0])) and m[1] not in _NOT_FUNCTIONS and (has_body or before[0][: m.start()].strip() or around in _CLASSLIKE and language == "cpp"):
            if has_body or language in ("c", "cpp") or around in _CLASSLIKE:
                return m[1].rpartition("::")[2], "method" if "::" in m[1] else method
    return None


def definitions(text: str, language: str) -> list[tuple[str, str, int, int, str | None, str | None]]:
    """(name, kind, start, end, parent name, parent kind) of the definitions in a text, by place."""
    if language not in _WORDS:
        return []
    out = []
    todo = [(u, "", None) for u in reversed(scan(text, language)[0])]
    while todo:
        u, around, parent = todo.pop()
        found = definition(text, u, language, around)
        if found:
            out.append((*found, u.start, u.end, *(parent or (None, None))))
        inside = found[1] if found else "impl" if language == "rust" and _IMPL.match(text, u.start, u.head) else around
        todo += [(v, inside, found or parent) for v in reversed(defining(text, u, language, inside))]
    return out
