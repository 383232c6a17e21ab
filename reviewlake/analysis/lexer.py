"""A small lexer for the brace and keyword languages: words, numbers, strings and operators.

Comments vanish, strings become one token, every token knows its line.  Line ends are tokens,
because several of the languages end statements there.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # word, num, str, op, eol
    text: str
    line: int


HASH_COMMENTS = {"python", "ruby", "bash", "php"}
SLASH_COMMENTS = {"typescript", "tsx", "javascript", "jsx", "go", "rust", "java", "csharp", "cpp", "c", "php", "kotlin", "swift", "scala"}
BACKTICK = {"typescript", "tsx", "javascript", "jsx", "go"}
#: Languages in which a single quote opens a string (elsewhere a character or a lifetime).
SINGLE = {"typescript", "tsx", "javascript", "jsx", "php", "ruby", "bash"}
OPERATORS = r"&&|\|\||\?\?=?|\?\.|\?:|=>|->|::|<-|\.\.\.|\.\.<|\.\.=?|==+|!==?|<=|>=|[-+*/%&|^]=|<<|>>|[^\s\w]"


@functools.cache
def pattern(lang: str) -> re.Pattern:
    parts = []
    if lang in SLASH_COMMENTS:
        parts.append(r"(?P<c1>//[^\n]*|/\*.*?(?:\*/|\Z))")
    if lang in HASH_COMMENTS:
        parts.append(r"(?P<c2>(?<![$\w{])\#[^\n]*)")
    if lang in ("kotlin", "scala", "swift"):
        parts.append(r'(?P<s0>""".*?(?:"""|\Z))')
    parts.append(r'(?P<s1>"(?:\\.|[^"\\])*(?:"|\Z))')
    if lang in SINGLE:
        parts.append(r"(?P<s2>'(?:\\.|[^'\\])*(?:'|\Z))")
    else:
        parts.append(r"(?P<s3>'(?:\\.[^']*|[^'\\\n])')")
    if lang in BACKTICK:
        parts.append(r"(?P<s4>`(?:\\.|[^`\\])*(?:`|\Z))")
    parts += [r"(?P<word>[$@]?[^\W\d]\w*[!?]?(?=\W|\Z))" if lang == "ruby" else r"(?P<word>[$@]?[^\W\d][\w$]*)", r"(?P<num>\d[\w.]*)", r"(?P<eol>\n)", f"(?P<op>{OPERATORS})"]
    return re.compile("|".join(parts), re.DOTALL)


def tokens(lang: str, source: str) -> list[Token]:
    out, line, at = [], 1, 0
    for m in pattern(lang).finditer(source):
        line += source.count("\n", at, m.start())
        at = m.start()
        kind = m.lastgroup or "op"
        if kind[0] == "c" and kind[1:].isdigit():
            continue
        out.append(Token("str" if kind[0] == "s" and kind[1:].isdigit() else kind, m.group(), line))
    return out
