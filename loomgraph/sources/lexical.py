"""Comments and strings of source code, found in one pass over a text by a table of each language.

A text is a sequence of code, comments and strings.  The scanner stands in code,
looks for the next opener of the language, and goes to the end of what it opens;
so a marker inside a string is no comment, and a quote inside a comment no string.
``#include``, ``#[derive]`` and ``$#`` are code where the language says so.

Unclosed strings of one line end with the line; other unclosed strings and
comments end with the text.  Null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Quote:
    """A kind of string: regular expressions of its opener, closer ({0}: what the opener's group matched) and escapes."""

    opener: str
    closer: str
    escapes: str = r"\\[\s\S]"
    lines: bool = False


@dataclass(frozen=True)
class Syntax:
    """How a language writes comments and strings; openers are regular expressions, tried in order at every place."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    nested: bool = False
    quotes: tuple[Quote, ...] = ()

    @cached_property
    def openers(self) -> re.Pattern:
        quotes = [f"(?P<q{i}>{q.opener})" for i, q in enumerate(self.quotes)]
        blocks = [f"(?P<b{i}>{re.escape(a) if not a.startswith('^') else a})" for i, (a, _) in enumerate(self.block)]
        lines = [f"(?P<l{i}>{x})" for i, x in enumerate(self.line)]
        # blocks before quotes and lines, so that a longer opener is never taken for the shorter one it begins with
        return re.compile("|".join([*blocks, *quotes, *lines]) or r"(?!)", re.M)

    def _quote_end(self, q: Quote, text: str, opened: re.Match, at: int) -> int:
        inner = next((g for g in opened.groups()[1:] if g is not None and g != opened.group()), "")
        closer = q.closer.format(re.escape(inner)) if "{0}" in q.closer else q.closer
        step = re.compile((q.escapes and f"{q.escapes}|") + f"(?P<end>{closer})" + ("" if q.lines else r"|(?P<eol>\n)"))
        for m in step.finditer(text, at):
            if m.lastgroup == "end":
                return m.end()
            if m.lastgroup == "eol":
                return m.start()
        return len(text)

    def _block_end(self, pair: tuple[str, str], text: str, at: int) -> int:
        first, last = pair
        if not self.nested:
            m = re.compile(last if last.startswith("^") else re.escape(last), re.M).search(text, at)
            return m.end() if m else len(text)
        depth = 1
        for m in re.compile(f"(?P<a>{re.escape(first)})|{re.escape(last)}").finditer(text, at):
            depth += 1 if m.lastgroup == "a" else -1
            if not depth:
                return m.end()
        return len(text)

    def spans(self, text: str) -> Iterator[tuple[str, int, int]]:
        """("comment" or "string", start, end) of all comments and strings, in order."""
        at = 0
        while m := self.openers.search(text, at):
            name = next(k for k, v in m.groupdict().items() if v is not None)
            kind, i = name[0], int(name[1:])
            if kind == "l":
                end = text.find("\n", m.end())
                end = len(text) if end < 0 else end
            elif kind == "b":
                end = self._block_end(self.block[i], text, m.end())
            else:
                end = self._quote_end(self.quotes[i], text, m, m.end())
            yield ("string" if kind == "q" else "comment"), m.start(), end
            at = max(end, m.start() + 1)


_DOUBLE, _SINGLE = Quote('"', '"'), Quote("'", "'")
_CHAR = Quote(r"'(?=(?:\\[^\n]{1,8}|[^\\'\n])')", "'")
_TRIPLE = (Quote('"""', '"""', lines=True), Quote("'''", "'''", lines=True))
_C_BLOCK = (("/*", "*/"),)
_C = Syntax(("//",), _C_BLOCK, quotes=(Quote(r'R"([^(\s]{0,16})\(', r"\){0}\"", escapes="", lines=True), _DOUBLE, _CHAR))
_WORD_HASH = r"(?:(?<=\s)|^)\#"

#: Syntax by language.
LANGUAGES: dict[str, Syntax] = {
    "python": Syntax(("\\#",), quotes=(*_TRIPLE, _DOUBLE, _SINGLE)),
    "rust": Syntax(("//",), _C_BLOCK, True, (Quote(r'\bb?r(\#*)"', '"{0}', escapes="", lines=True), Quote('"', '"', lines=True), _CHAR)),
    "c": _C,
    "cpp": _C,
    "java": Syntax(("//",), _C_BLOCK, quotes=(_TRIPLE[0], _DOUBLE, _CHAR)),
    "csharp": Syntax(("//",), _C_BLOCK, quotes=(_TRIPLE[0], Quote(r'\$?@\$?"', '"', '""', lines=True), _DOUBLE, _CHAR)),
    "kotlin": Syntax(("//",), _C_BLOCK, True, (Quote('"""', '"""', escapes="", lines=True), _DOUBLE, _CHAR)),
    "scala": Syntax(("//",), _C_BLOCK, True, (Quote('"""', '"""', escapes="", lines=True), _DOUBLE, _CHAR)),
    "swift": Syntax(("//",), _C_BLOCK, True, (_TRIPLE[0], _DOUBLE)),
    "go": Syntax(("//",), _C_BLOCK, quotes=(Quote("`", "`", escapes="", lines=True), _DOUBLE, _CHAR)),
    "typescript": Syntax(("//",), _C_BLOCK, quotes=(Quote("`", "`", lines=True), _DOUBLE, _SINGLE)),
    "php": Syntax(("//", r"\#(?!\[)"), _C_BLOCK, quotes=(Quote('"', '"', lines=True), Quote("'", "'", lines=True))),
    "ruby": Syntax((_WORD_HASH,), (("^=begin\\b", "^=end\\b.*"),), quotes=(Quote('"', '"', lines=True), Quote("'", "'", lines=True))),
    "shell": Syntax((_WORD_HASH,), quotes=(Quote('"', '"', lines=True), Quote("'", "'", escapes="", lines=True))),
    "perl": Syntax((_WORD_HASH,), (("^=\\w+", "^=cut\\b.*"),), quotes=(Quote('"', '"', lines=True), Quote("'", "'", lines=True))),
    "r": Syntax(("\\#",), quotes=(Quote('"', '"', lines=True), Quote("'", "'", lines=True))),
    "julia": Syntax(("\\#",), (("#=", "=#"),), True, (_TRIPLE[0], _DOUBLE, _CHAR)),
    "elixir": Syntax(("\\#",), quotes=(*_TRIPLE, _DOUBLE)),
    "lua": Syntax(("--",), (("--[[", "]]"),), quotes=(Quote(r"\[(=*)\[", r"\]{0}\]", escapes="", lines=True), _DOUBLE, _SINGLE)),
    "sql": Syntax(("--",), _C_BLOCK, quotes=(Quote("'", "'", "''", lines=True), Quote('"', '"', '""'))),
    "haskell": Syntax((r"--+(?![!#$%&*+./<=>?@\\^|~:-])",), (("{-", "-}"),), True, (_DOUBLE, _CHAR)),
    "ocaml": Syntax((), (("(*", "*)"),), True, (Quote('"', '"', lines=True), _CHAR)),
    "clojure": Syntax((";",), quotes=(Quote('"', '"', lines=True),)),
    "zig": Syntax(("//",), quotes=(_DOUBLE, _CHAR)),
    # other files: marks of comments after white space only, and no mark of a directive or an attribute
    "generic": Syntax((r"(?:(?<=\s)|^)//", r"(?:(?<=\s)|^)\#(?![\[!]|\s*(?:include|define|if|ifdef|ifndef|endif|else|elif|pragma|undef|error|line)\b)"), _C_BLOCK, quotes=(*_TRIPLE, _DOUBLE, _CHAR)),
}

#: Languages by file extension.
EXTENSIONS = {
    ext: name
    for name, exts in {
        "python": "py pyi", "rust": "rs", "c": "c h", "cpp": "cpp cxx cc hpp hxx hh", "java": "java", "csharp": "cs", "kotlin": "kt kts", "scala": "scala sc",
        "swift": "swift", "go": "go", "typescript": "ts tsx js jsx mjs cjs", "php": "php", "ruby": "rb rake gemspec", "shell": "sh bash zsh", "perl": "pl pm",
        "r": "r", "julia": "jl", "elixir": "ex exs", "lua": "lua", "sql": "sql", "haskell": "hs elm", "ocaml": "ml mli fs", "clojure": "clj cljs", "zig": "zig",
    }.items()
    for ext in exts.split()
}


def language_of(path: str | None) -> str:
    return EXTENSIONS.get((path or "").rpartition(".")[2].lower(), "generic")


def _blank(text: str) -> str:
    """Spaces for everything but line breaks, so that places and line numbers stay."""
    return re.sub(r"[^\n]", " ", text)


def blanked(text: str | None, language: str) -> tuple[str, str]:
    """The text with its comments blanked, and with the insides of its strings blanked too; both as long as the text."""
    text = text or ""
    code, bare, at = [], [], 0
    for kind, start, end in LANGUAGES.get(language, LANGUAGES["generic"]).spans(text):
        code.append(text[at:start])
        bare.append(text[at:start])
        inside = text[start:end]
        code.append(inside if kind == "string" else _blank(inside))
        bare.append(_blank(inside))
        at = end
    code.append(text[at:])
    bare.append(text[at:])
    return "".join(code), "".join(bare)


def without_comments(text: str | None, language: str) -> str:
    """The text less its comments; line breaks inside comments stay, and so do all strings."""
    text = text or ""
    out, at = [], 0
    for kind, start, end in LANGUAGES.get(language, LANGUAGES["generic"]).spans(text):
        if kind == "comment":
            out += [text[at:start], "\n" * text.count("\n", start, end)]
            at = end
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _stripped(text: pd.Series, path: pd.Series) -> pd.Series:
    return pd.Series([without_comments(t, language_of(p)) for t, p in zip(text, path, strict=True)])


def strip_comments(text: Column, path: Column) -> Column:
    """Code without comments, by the language of the path's extension; strings and directives stay."""
    return _stripped(text, path)
