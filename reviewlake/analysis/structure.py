"""Symbols, imports and cognitive complexity of one source file.

Python files go through the standard library's parser.  The other languages go through the
lexer and a bracket matcher that knows each language's words for functions, types and control
flow; unusual code is approximated, never an error.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from typing import NamedTuple

from .lexer import Token, tokens


class Symbol(NamedTuple):
    name: str
    kind: str  # function, method, class, interface, enum, const, variable
    start_line: int
    end_line: int
    exported: bool


class Import(NamedTuple):
    names: list[str]
    source: str


class Function(NamedTuple):
    name: str
    start_line: int
    end_line: int
    score: int


@dataclass
class Parsed:
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    functions: list[Function] = field(default_factory=list)


JS = ("typescript", "tsx", "javascript", "jsx")


@dataclass(frozen=True)
class Words:
    """A language's vocabulary."""

    functions: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    nest: tuple[str, ...] = ("if", "for", "while", "do", "switch", "catch")
    flat: tuple[str, ...] = ()
    logic: tuple[str, ...] = ("&&", "||")
    ternary: bool = False
    typed: bool = False  # functions are a type, a name, parentheses and a block
    imports: tuple[str, ...] = ("import",)


CLASSIC = dict(ternary=True, typed=True)
VOCABULARY = {
    **dict.fromkeys(JS, Words(("function",), ("class", "interface", "enum"), logic=("&&", "||", "??"), ternary=True)),
    "go": Words(("func",), ("type",), ("if", "for", "switch", "select")),
    "rust": Words(("fn",), ("struct", "enum", "trait", "union", "mod"), ("if", "for", "while", "loop", "match"), imports=("use",)),
    "java": Words((), ("class", "interface", "enum", "record"), ("if", "for", "while", "do", "switch", "catch"), **CLASSIC),
    "csharp": Words((), ("class", "interface", "enum", "struct", "record"), ("if", "for", "foreach", "while", "do", "switch", "catch"), imports=("using",), **CLASSIC),
    "cpp": Words((), ("class", "struct", "enum", "union", "namespace"), ("if", "for", "while", "do", "switch", "catch"), imports=("include",), **CLASSIC),
    "c": Words((), ("struct", "enum", "union"), ("if", "for", "while", "do", "switch"), imports=("include",), **CLASSIC),
    "php": Words(("function",), ("class", "interface", "trait", "enum"), ("if", "for", "foreach", "while", "do", "switch", "catch", "match"), ("elseif",), ("&&", "||", "and", "or"), True, imports=("use",)),
    "ruby": Words(("def",), ("class", "module"), ("if", "unless", "while", "until", "for", "case", "rescue"), ("elsif",), ("&&", "||", "and", "or"), imports=("require", "require_relative")),
    "kotlin": Words(("fun",), ("class", "interface", "object"), ("if", "for", "while", "do", "when", "catch")),
    "swift": Words(("func",), ("class", "struct", "enum", "protocol", "extension", "actor"), ("if", "guard", "for", "while", "repeat", "switch", "catch"), ternary=True),
    "scala": Words(("def",), ("class", "object", "trait", "enum"), ("if", "for", "while", "do", "match", "catch")),
    "bash": Words(("function",), (), ("if", "for", "while", "until", "case", "select"), ("elif",), imports=("source",)),
}
NOT_NAMES = frozenset("if for while switch catch return new else do try throw sizeof function foreach using lock fixed await yield delete typeof in of case".split())
HIDDEN = frozenset(("private", "protected", "fileprivate"))


def kind_of_type(word: str) -> str:
    return "interface" if word in ("interface", "protocol") else "enum" if word == "enum" else "class"


# --- Python ------------------------------------------------------------------------------


def _python_score(body: list[ast.stmt]) -> int:
    score = 0

    def walk(node: ast.AST, depth: int, elif_: bool = False) -> None:
        nonlocal score
        inner = depth
        if elif_:
            score += 1
        elif isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)):
            score += 1 + depth
            inner = depth + 1
        elif isinstance(node, ast.BoolOp):
            score += len(node.values) - 1
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
            inner = depth + 1
        for name, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, ast.AST):
                    chained = name == "orelse" and isinstance(node, ast.If) and len(value) == 1 and isinstance(child, ast.If) and child.col_offset == node.col_offset
                    walk(child, inner, chained)

    for s in body:
        walk(s, 0)
    return score


def parse_python(source: str) -> Parsed:
    out = Parsed()
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return out
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def first_line(node) -> int:
        return min([node.lineno, *(d.lineno for d in node.decorator_list)])

    def symbols(nodes: list, top: bool) -> None:
        for n in nodes:
            if isinstance(n, functions):
                out.symbols.append(Symbol(n.name, "function" if top else "method", first_line(n), n.end_lineno or n.lineno, top and not n.name.startswith("_")))
            elif isinstance(n, ast.ClassDef):
                out.symbols.append(Symbol(n.name, "class", first_line(n), n.end_lineno or n.lineno, top and not n.name.startswith("_")))
                symbols(n.body, False)
            elif isinstance(n, ast.Import):
                out.imports += [Import([a.asname or a.name], a.name) for a in n.names]
            elif isinstance(n, ast.ImportFrom):
                out.imports.append(Import([a.asname or a.name for a in n.names], "." * n.level + (n.module or "")))

    symbols(tree.body, True)
    for n in ast.walk(tree):
        if isinstance(n, functions):
            out.functions.append(Function(n.name, n.lineno, n.end_lineno or n.lineno, _python_score(n.body)))
    out.functions.sort(key=lambda f: f.start_line)
    return out


# --- brace languages ---------------------------------------------------------------------

OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Scanner:
    def __init__(self, lang: str, source: str):
        self.lang, self.w = lang, VOCABULARY[lang]
        self.t: list[Token] = tokens(lang, source)
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSE and stack:
                while len(stack) > 1 and OPEN[self.t[stack[-1]].text] != t.text:
                    stack.pop()
                self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = len(self.t) - 1
        self.out = Parsed()

    def at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_word(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "word"

    def skip(self, i: int) -> int:
        """The next place that is no line end."""
        while i < len(self.t) and self.t[i].kind == "eol":
            i += 1
        return i

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """The first of ``stops`` at this bracket level, else ``end``."""
        while i < end:
            if self.t[i].text in stops:
                return i
            if self.t[i].text in OPEN and self.t[i].kind == "op":
                i = self.match.get(i, end)
            elif self.t[i].text in CLOSE and self.t[i].kind == "op":
                return i
            i += 1
        return end

    def statement_end(self, i: int, end: int) -> int:
        """Where the statement that begins at i ends: after its block, or at its end mark."""
        i = self.skip(i)
        if i >= end:
            return end
        if self.at(i) == "{":
            return min(end, self.match.get(i, end) + 1)
        if self.at(i) in self.w.nest:
            return self.control_end(i, end)
        stop = self.until(i, end, (";", "{") if self.lang in ("java", "csharp", "c", "cpp", "php", *JS) else (";", "\n", "{"))
        if self.at(stop) == "{":
            stop = self.match.get(stop, end)
        return min(end, stop + 1)

    def control_end(self, i: int, end: int) -> int:
        """The end of the control structure at i, with every else that belongs to it."""
        j = self.skip(i + 1)
        if self.at(j) == "(":
            j = self.match.get(j, end) + 1
            j = self.statement_end(j, end)
        else:
            brace = self.until(j, end, {"scala": ("{", ";", "\n"), "go": ("{",)}.get(self.lang, ("{", ";")))
            j = self.match.get(brace, end) + 1 if self.at(brace) == "{" else brace + 1
        after = self.skip(j)
        if self.at(i) in ("if", "guard") and self.at(after) == "else":
            return self.statement_end(after + 1, end)
        if self.at(i) == "do" and self.at(after) == "while":
            return self.until(after, end, (";", "\n"))
        return min(end, j)

    # --- complexity ----------------------------------------------------------------------

    def score(self, start: int, end: int) -> int:
        total, spans = 0, []  # spans: ends of the structures that are open
        ternary, tail_while = self.w.ternary, set()
        i = start
        while i < end:
            t = self.t[i]
            spans = [s for s in spans if s > i]
            if t.kind == "word":
                member = self.at(i - 1) in (".", "?.", "::", "->")
                if t.text in self.w.nest and not member and i not in tail_while:
                    total += 1 + len(spans)
                    stop = self.control_end(i, end)
                    spans.append(stop)
                    if t.text == "do":
                        tail_while.add(self.until(self.match.get(self.skip(i + 1), i) + 1, end, ("while",)))
                elif t.text in self.w.flat:
                    total += 1
                elif t.text in self.w.logic:
                    total += 1
                elif (t.text in self.w.functions or self.at(i + 1) == "=>") and i > start:
                    brace = self.until(i + 1, end, ("{", ";", "\n"))
                    spans.append(self.match.get(brace, end) if self.at(brace) == "{" else brace)
            elif t.kind == "op":
                if t.text in self.w.logic:
                    total += 1
                elif t.text == "?" and ternary and self.at(i + 1) not in (":", ".", ",", ")", ";", "=", ">"):
                    colon = self.until(i + 1, end, (":", ";", "\n"))
                    if self.at(colon) == ":":
                        total += 1 + len(spans)
                elif t.text == "=>" and self.at(i - 1) == ")" and self.lang in JS:
                    brace = self.skip(i + 1)
                    spans.append(self.match.get(brace, end) if self.at(brace) == "{" else self.until(i + 1, end, (";", ",", "\n")))
            i += 1
        return total

    # --- declarations --------------------------------------------------------------------

    def body(self, i: int, end: int) -> tuple[int, int]:
        """(first, last) token of a function's body whose parameters end before i."""
        stops = ("{", ";", "=", "=>") if self.lang in ("kotlin", "scala", "csharp", *JS) else ("{", ";")
        j = self.until(i, end, stops)
        if self.at(j) in ("=", "=>"):
            k = self.skip(j + 1)
            if self.at(k) == "{":
                return k + 1, self.match.get(k, end)
            return j + 1, self.until(k, end, (";", "\n"))
        if self.at(j) == "{":
            return j + 1, self.match.get(j, end)
        return j, j

    def modifiers(self, i: int) -> set[str]:
        """Words before place i in its statement."""
        found, j = set(), i - 1
        while j >= 0 and self.t[j].text not in ("{", "}", ";") and self.t[j].kind != "eol":
            if self.t[j].text == ":" and self.at(j - 1) in ("public", "private", "protected"):
                break
            if self.t[j].kind == "word":
                found.add(self.t[j].text)
            j -= 1
        return found

    def exported(self, name: str, i: int, in_type: bool) -> bool:
        words = self.modifiers(i)
        if self.lang == "go":
            return name[:1].isupper()
        if self.lang == "rust":
            return "pub" in words
        if self.lang in ("java", "csharp"):
            return "public" in words
        if self.lang in ("c", "cpp"):
            return "static" not in words
        if self.lang in JS:
            return "export" in words and not in_type
        if self.lang in ("php", "kotlin", "swift", "scala"):
            return not words & HIDDEN
        return True

    def add(self, name: str, kind: str, i: int, last: int, in_type: bool) -> None:
        self.out.symbols.append(Symbol(name, kind, self.t[i].line, self.t[min(last, len(self.t) - 1)].line, self.exported(name, i, in_type)))

    def function(self, name_at: int, decl: int, params: int, end: int, in_type: bool, named: bool = True) -> int:
        """Record a function; the place after it."""
        first, last = self.body(self.match.get(params, params) + 1 if self.at(params) == "(" else params, end)
        name = self.t[name_at].text
        if named:
            self.add(name, "method" if in_type else "function", decl, last, in_type)
        self.out.functions.append(Function(name, self.t[decl].line, self.t[min(last, len(self.t) - 1)].line, self.score(first, last)))
        self.nested(first, last)
        return max(last, first)

    def nested(self, start: int, end: int) -> None:
        """Functions with a name inside a function: scored, but no symbols."""
        for i in range(start, end):
            if self.t[i].kind == "word" and self.t[i].text in self.w.functions and self.is_word(i + 1) and self.at(i + 2) == "(":
                first, last = self.body(self.match.get(i + 2, i + 2) + 1, end)
                self.out.functions.append(Function(self.t[i + 1].text, self.t[i].line, self.t[last].line, self.score(first, last)))

    def typed_function(self, i: int, in_type: bool) -> bool:
        """Whether a name and parentheses at i begin a function rather than a call."""
        if not self.is_word(i) or self.at(i + 1) != "(" or self.t[i].text in NOT_NAMES:
            return False
        if self.at(i - 1) in (".", "new", "=", "return", "->", "(", ",") or (self.at(i - 1) == "::" and self.lang != "cpp"):
            return False
        after = self.skip(self.match.get(i + 1, i + 1) + 1)
        while self.is_word(after) and self.at(after) in ("const", "noexcept", "override", "final", "throws") or (self.at(after) == ":" and self.lang in ("csharp", "cpp")):
            after = self.until(after + 1, len(self.t), ("{", ";", "const", "override"))
        before = self.is_word(i - 1) or self.at(i - 1) in ("*", "&", ">", "]", "::", "~")
        opens = self.at(after) == "{" or (self.at(after) == "=>" and self.lang == "csharp") or (in_type and self.at(after) == ";" and before)
        return opens and (before or in_type)

    def scan(self, start: int, end: int, in_type: bool = False) -> None:
        i = start
        while i < end:
            t = self.t[i]
            w = self.w
            if t.kind == "word" and t.text in w.imports and not in_type and self.at(i - 1) not in (".", "::"):
                i = self.read_import(i, end)
                continue
            if t.kind == "word" and t.text in w.types and self.at(i - 1) not in (".", "::"):
                i = self.read_type(i, end, in_type)
                continue
            if self.lang == "rust" and t.text == "impl":
                brace = self.until(i, end, ("{", ";"))
                self.scan(brace + 1, self.match.get(brace, brace), True)
                i = self.match.get(brace, brace) + 1
                continue
            if t.kind == "word" and t.text in w.functions:
                i = self.read_function(i, end, in_type)
                continue
            if self.lang == "swift" and in_type and t.text == "init" and self.at(i + 1) in ("(", "?"):
                i = self.function(i, i, self.until(i, end, ("(",)), end, True) + 1
                continue
            if self.lang in JS and (i := self.read_js(i, end, in_type)) is not None and self.jumped:
                continue
            if w.typed and self.typed_function(i, in_type):
                name = i
                i = self.function(name, name, i + 1, end, in_type) + 1
                continue
            if self.lang == "bash" and t.kind == "word" and self.at(i + 1) == "(" and self.at(i + 2) == ")":
                i = self.function(i, i, i + 3, end, False) + 1
                continue
            if t.kind == "op" and t.text == "{" and (w.typed or self.lang == "php") and (not in_type or self.lang == "csharp"):
                self.scan(i + 1, self.match.get(i, i), in_type)
                i = self.match.get(i, i) + 1
                continue
            if t.kind == "op" and t.text in OPEN:
                i = self.match.get(i, i) + 1
                continue
            i += 1

    jumped = False

    def read_js(self, i: int, end: int, in_type: bool) -> int:
        """Methods, variables and exported names; sets ``jumped`` if it has moved on."""
        self.jumped = True
        t = self.t[i]
        if in_type and t.kind == "word" and self.at(i + 1) == "(" and t.text not in NOT_NAMES:
            first, _ = self.body(self.match.get(i + 1, i + 1) + 1, end)
            if self.at(first - 1) == "{":
                return self.function(i, i, i + 1, end, True) + 1
        if not in_type and t.text in ("const", "let", "var") and self.is_word(i + 1):
            name = i + 1
            eq = self.until(name + 1, end, ("=", ";", "\n"))
            value = self.skip(eq + 1)
            if self.at(eq) == "=":
                if self.at(value) == "async":
                    value += 1
                arrow = self.until(value, end, ("=>", ";", "\n"))
                if self.at(value) == "function" or self.at(arrow) == "=>":
                    params = value if self.at(value) == "(" else arrow
                    if self.at(value) == "function":
                        params = self.until(value, end, ("(",))
                    first, last = self.body(self.match.get(params, params) + 1, end) if self.at(params) == "(" else self.body(arrow, end)
                    self.add(self.t[name].text, "function", i, last, False)
                    self.out.functions.append(Function(self.t[name].text, t.line, self.t[min(last, len(self.t) - 1)].line, self.score(first, last)))
                    return last + 1
            stop = self.until(eq, end, (";", "\n"))
            self.add(self.t[name].text, "const" if t.text == "const" else "variable", i, max(i, min(stop, end) - 1), False)
            return stop + 1
        self.jumped = False
        return i

    def read_function(self, i: int, end: int, in_type: bool) -> int:
        name = self.skip(i + 1)
        if self.lang == "go" and self.at(name) == "(":
            name = self.match.get(name, name) + 1
        if self.lang in JS and self.at(name) == "*":
            name += 1
        if self.lang == "kotlin":
            if self.at(name) == "<":
                name = self.until(name, end, (">",)) + 1
            while self.at(name + 1) == "." and self.is_word(name + 2):
                name += 2
        if self.lang == "ruby" and self.at(name) == "self" and self.at(name + 1) == ".":
            name += 2
        if not self.is_word(name):
            return i + 1
        params = name + 1
        if self.at(params) in ("<", "["):
            close = ">" if self.at(params) == "<" else "]"
            params = self.until(params + 1, end, (close,)) + 1 if close == ">" else self.match.get(params, params) + 1
        return self.function(name, i, params, end, in_type) + 1

    def read_type(self, i: int, end: int, in_type: bool) -> int:
        name = self.skip(i + 1)
        if self.t[i].text == "enum" and self.at(name) in ("class", "struct"):
            name += 1
        if not self.is_word(name):
            return i + 1
        brace = self.until(name + 1, end, ("{", ";", "\n") if self.lang in ("go", "kotlin", "scala", "rust") else ("{", ";"))
        if self.lang in ("c", "cpp") and any(self.at(k) in ("(", "=", ")", ",", "*") for k in range(name + 1, min(brace, name + 3))):
            return i + 1  # a type's name in front of a variable or a function
        last = self.match.get(brace, brace) if self.at(brace) == "{" else brace - 1
        word = self.t[i].text
        kind = kind_of_type(word)
        if self.lang == "go":
            after = self.at(name + 1)
            kind = "interface" if after == "interface" else "class"
        if word != "namespace":
            self.add(self.t[name].text, kind, i, last, in_type)
        if self.at(brace) == "{" and self.lang != "go":
            self.scan(brace + 1, last, word not in ("namespace", "mod"))
        return last + 1 if self.at(brace) == "{" else brace

    def read_import(self, i: int, end: int) -> int:
        stop = self.until(i, end, (";", "\n"))
        if self.at(i + 1) in ("{", "(") and self.lang in (*JS, "go"):
            close = self.match.get(i + 1, i + 1)
            stop = self.until(close + 1, end, (";", "\n"))
        part = self.t[i + 1 : stop]
        quoted = [t.text[1:-1] for t in part if t.kind == "str"]
        if self.lang in JS:
            names, k = [], 0
            words = [t for t in part if t.kind in ("word", "op")]
            while k < len(words):
                t = words[k]
                if t.text == "from":
                    break
                if t.kind == "word" and t.text not in ("type", "as"):
                    if k + 2 < len(words) and words[k + 1].text == "as":
                        k += 2
                        t = words[k]
                    names.append(t.text)
                elif t.text == "*" and k + 2 < len(words) and words[k + 1].text == "as":
                    k += 2
                    names.append(words[k].text)
                k += 1
            if quoted:
                self.out.imports.append(Import(names, quoted[-1]))
        elif quoted:
            self.out.imports += [Import([], q) for q in quoted]
        else:
            path = "".join(t.text for t in part if t.kind != "eol").strip("<>")
            if path:
                last = re.split(r"::|\.|\\|/", path.rstrip("*{}"))[-1]
                self.out.imports.append(Import([last] if last else [], path))
        return stop + 1


# --- Ruby and Bash: blocks end with words ---------------------------------------------------

RUBY_OPEN = frozenset(("def", "class", "module", "begin", "do", "case", "while", "until", "for", "if", "unless"))
BASH_CLOSE = {"if": "fi", "for": "done", "while": "done", "until": "done", "select": "done", "case": "esac"}


def _first_in_statement(t: list[Token], i: int) -> bool:
    return i == 0 or t[i - 1].kind == "eol" or t[i - 1].text in (";", "=", "(", "{", "then", "do", "else", "&&", "||", "|", ")")


def parse_ruby(source: str) -> Parsed:
    t = tokens("ruby", source)
    w = VOCABULARY["ruby"]
    out, stack = Parsed(), []  # [word, name, line, functions' score, structures]
    for i, x in enumerate(t):
        if x.kind != "word" or (i and t[i - 1].text in (".", ":", "::")):
            if x.kind == "op" and x.text in w.logic:
                for s in stack:
                    if s[0] == "def":
                        s[3] += 1
            continue
        name = t[i + 1].text if i + 1 < len(t) else ""
        opener = x.text in RUBY_OPEN and (x.text in ("def", "class", "module", "begin", "do") or _first_in_statement(t, i))
        if x.text == "do" and stack and stack[-1][0] in ("while", "until", "for") and stack[-1][2] == x.line:
            opener = False
        if x.text in w.nest:
            for d, s in enumerate(stack):
                if s[0] == "def":
                    depth = sum(o[0] in w.nest for o in stack[d + 1 :])
                    s[3] += 1 + depth
        elif x.text in w.flat or x.text in w.logic:
            for s in stack:
                if s[0] == "def":
                    s[3] += 1
        if opener:
            if x.text == "def" and name == "self" and i + 3 < len(t):
                name = t[i + 3].text
            stack.append([x.text, name, x.line, 0])
        elif x.text == "end" and stack:
            word, name, line, score = stack.pop()
            inside = any(s[0] in ("class", "module") for s in stack)
            if word == "def":
                if not any(s[0] == "def" for s in stack):
                    out.symbols.append(Symbol(name, "method" if inside else "function", line, x.line, True))
                out.functions.append(Function(name, line, x.line, score))
            elif word in ("class", "module"):
                out.symbols.append(Symbol(name, "class", line, x.line, True))
        elif x.text in w.imports and i + 1 < len(t) and t[i + 1].kind == "str":
            out.imports.append(Import([], t[i + 1].text[1:-1]))
    out.symbols.sort(key=lambda s: s.start_line)
    return out


def parse_bash(source: str) -> Parsed:
    scan = Scanner("bash", source)
    t, w, out = scan.t, scan.w, scan.out
    for i, x in enumerate(t):
        head = None
        if x.kind == "word" and scan.at(i + 1) == "(" and scan.at(i + 2) == ")" and scan.at(i - 1) != "function":
            head = (i, i + 3)
        elif x.text == "function" and scan.is_word(i + 1):
            head = (i + 1, i + 4 if scan.at(i + 2) == "(" else i + 2)
        elif x.text in ("source", ".") and _first_in_statement(t, i) and i + 1 < len(t) and t[i + 1].kind != "eol":
            path = []
            k = i + 1
            while k < len(t) and t[k].kind != "eol" and t[k].text != ";":
                path.append(t[k].text.strip("\"'"))
                k += 1
            out.imports.append(Import([], "".join(path)))
        if head is None:
            continue
        brace = scan.skip(head[1])
        last = scan.match.get(brace, brace)
        score, open_ = 0, []
        for k in range(brace + 1, last):
            u = t[k]
            if u.kind == "word" and u.text in w.nest and _first_in_statement(t, k):
                score += 1 + len(open_)
                open_.append(BASH_CLOSE[u.text])
            elif u.text in w.flat or u.text in w.logic:
                score += 1
            elif open_ and u.text == open_[-1]:
                open_.pop()
        out.symbols.append(Symbol(t[head[0]].text, "function", x.line, t[last].line, True))
        out.functions.append(Function(t[head[0]].text, x.line, t[last].line, score))
    return out


def parse(lang: str, source: str) -> Parsed:
    """Symbols, imports and functions; nothing for languages without a vocabulary."""
    if lang == "python":
        return parse_python(source)
    if lang == "ruby":
        return parse_ruby(source)
    if lang == "bash":
        return parse_bash(source)
    if lang not in VOCABULARY:
        return Parsed()
    scan = Scanner(lang, source)
    scan.scan(0, len(scan.t))
    return scan.out
