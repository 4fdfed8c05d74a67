"""Definitions, containment, calls, imports, bases and references of source files, by a scope stack for each file.

A file is read once.  Its comments and strings are blanked first (:mod:`lexical`),
so nothing inside them is a definition or a call.  Scopes open and close by
braces, by indentation or by ``end``, as the language has it; a definition is
named by all that stands around it (``Outer::inner``), and its nearest
surrounding definition contains it.  ``impl`` blocks and receivers of methods are
scopes of the type that they name.

The scan is a Python UDTF, so that it is a lateral join in SQL and runs where the
file's row is: no shuffle, and a task holds one file at a time.

Empty and null texts give the file's own node; a null path gives nothing.  What
is defined twice under one name gives one node and one edge for each definition's
content.  Scopes that are never closed end with the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from loomgraph.sources.lexical import LANGUAGES, blanked, language_of

#: Node types by id prefix, and weights by relation.
NODE_TYPES = {"fn": 2, "class": 3, "struct": 4, "enum": 5, "type": 6, "interface": 6, "trait": 6, "module": 7}
WEIGHTS = {"contains": 1.0, "imports": 0.5, "implements": 0.7, "calls": 0.4, "references": 0.3, "routes_to": 0.5}
DECORATOR_WEIGHT = 0.4

#: Words before a parenthesis that are no calls, receivers that are the object itself, and types that are no references.
NOT_CALLS = frozenset("if for while switch match return catch def fn func fun function class super elif else and or not in sizeof typeof foreach until unless when with await yield throw new do case let sub guard defn except assert del print lambda".split())
OWN_RECEIVERS = frozenset("self cls super this Self".split())
PLAIN_TYPES = frozenset("None True False Any Optional List Dict Tuple Set Union Type Callable String Self Vec Option Result Box Int Integer Float Double Bool Boolean Object Void Unit Array Map".split())

_MOD = r"(?:@\w+(?:\([^()]*\))?\s+)*(?:(?:pub(?:\([^)]*\))?|public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|export|default|data|inner|inline|suspend|partial|readonly|unsafe|extern|const|mutating|indirect|fileprivate|implicit|native|synchronized|operator|declare|case|constexpr|explicit)\s+)*"
_TYPE_NAME = r"(?!(?:return|new|else|throw|await|yield|goto|case|using|import|package|delete|typedef|if|for|while|switch)\b)[\w:<>\[\],.?*&]+(?:\s*[*&]+)?"
_C_FUNCTION = ("fn", rf"\s*{_MOD}(?:<[^<>]*>\s*)?(?:{_TYPE_NAME}[\s*&]+)+(?:(?P<recv>\w+)::)?(?P<name>~?\w+)\s*\((?!\*)")


def _kinds(words: str, prefix: str) -> tuple[str, str]:
    return prefix, rf"\s*{_MOD}(?:{words})\s+(?P<name>\w+)"


@dataclass(frozen=True)
class Grammar:
    """Scopes (brace, indent, end, flat), definitions (prefix, pattern), how bases stand after a name, and imports."""

    scopes: str
    definitions: tuple[tuple[str, str], ...]
    bases: str = ""
    imports: tuple[str, ...] = ()
    patterns: tuple[tuple[str, re.Pattern], ...] = field(init=False)
    import_patterns: tuple[re.Pattern, ...] = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "patterns", tuple((k, re.compile(p)) for k, p in self.definitions))
        object.__setattr__(self, "import_patterns", tuple(re.compile(p, re.M) for p in self.imports))


_DOTTED = r"^\s*import\s+(?:static\s+)?([\w.]+\w)"
#: Grammar by language; languages without one are read as ``generic``.
GRAMMARS: dict[str, Grammar] = {
    "python": Grammar("indent", (("class", r"\s*class\s+(?P<name>\w+)"), ("fn", r"\s*(?:async\s+)?def\s+(?P<name>\w+)")), "paren", (r"^[ \t]*from\s+([\w.]+)\s+import\s+(\([^)]*\)|[^\n]+)", r"^[ \t]*import\s+([^\n(]+)")),
    "rust": Grammar("brace", (_kinds("mod", "module"), _kinds("struct|union", "struct"), _kinds("enum", "enum"), _kinds("trait", "trait"), ("impl", r"\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>(?=\s))?\s+(?:(?P<base>[\w:]+)(?:<[^{]*?>)?\s+for\s+)?&?(?P<name>[\w:]+)"), ("fn", rf"\s*{_MOD}fn\s+(?P<name>\w+)")), imports=(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);",)),
    "go": Grammar("brace", (("struct", r"\s*type\s+(?P<name>\w+)\s+struct"), ("interface", r"\s*type\s+(?P<name>\w+)\s+interface"), ("fn", r"func\s+\(\s*(?:\w+\s+)?\*?(?P<recv>\w+)[^)]*\)\s*(?P<name>\w+)"), ("fn", r"func\s+(?P<name>\w+)")), imports=(r"^import\s+(?:[\w.]+\s+)?\"([^\"]+)\"", r"^import\s*\(([^)]*)\)")),
    "java": Grammar("brace", (_kinds("class|record", "class"), _kinds("@?interface", "interface"), _kinds("enum", "enum"), ("fn", rf"\s*{_MOD}(?P<name>[A-Z]\w*)\s*\((?=[^;]*\)\s*(?:throws[^;{{]*)?\{{)"), _C_FUNCTION), "words", (_DOTTED,)),
    "csharp": Grammar("brace", (_kinds("namespace", "module"), _kinds("class|record", "class"), _kinds("struct", "struct"), _kinds("interface", "interface"), _kinds("enum", "enum"), ("fn", rf"\s*{_MOD}(?P<name>[A-Z]\w*)\s*\((?=[^;]*\)\s*(?::[^;{{]*)?\{{)"), _C_FUNCTION), "colon", (r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",)),
    "kotlin": Grammar("brace", (_kinds(r"enum\s+class", "enum"), _kinds("class|object", "class"), _kinds("interface", "interface"), ("fn", rf"\s*{_MOD}fun\s+(?:<[^>]*>\s*)?(?:(?P<recv>\w+)\.)?(?P<name>\w+)")), "colon", (_DOTTED,)),
    "scala": Grammar("brace", (_kinds("class|object", "class"), _kinds("trait", "trait"), ("fn", rf"\s*{_MOD}def\s+(?P<name>\w+)")), "words", (_DOTTED,)),
    "swift": Grammar("brace", (_kinds("class|actor", "class"), _kinds("struct", "struct"), _kinds("enum", "enum"), _kinds("protocol", "interface"), ("impl", r"\s*extension\s+(?P<name>\w+)"), ("fn", rf"\s*{_MOD}(?:class\s+)?func\s+(?P<name>\w+)"), ("fn", rf"\s*{_MOD}(?P<name>init)\b(?=[^\n]*\{{)")), "colon", (r"^\s*import\s+(\w+)",)),
    "typescript": Grammar("brace", (_kinds("class", "class"), _kinds("interface", "interface"), _kinds("enum", "enum"), _kinds("namespace|module", "module"), ("fn", rf"\s*{_MOD}function\s*\*?\s*(?P<name>\w+)"), ("fn", rf"\s*{_MOD}(?:const|let|var)\s+(?P<name>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|\w+)\s*(?::[^=\n]+)?=>"), ("method", rf"\s*{_MOD}(?:get\s+|set\s+)?(?P<name>\w+)\s*(?:<[^<>]*>)?\s*\((?=[^;{{}}]*\)[^;{{}}()]*\{{)")), "words", (r"\bfrom\s+['\"]([^'\"]+)['\"]", r"^\s*import\s+['\"]([^'\"]+)['\"]", r"\brequire\(\s*['\"]([^'\"]+)['\"]\s*\)")),
    "php": Grammar("brace", (_kinds("class", "class"), _kinds("interface", "interface"), _kinds("trait", "trait"), _kinds("enum", "enum"), ("fn", rf"\s*{_MOD}function\s+&?(?P<name>\w+)")), "words", (r"^\s*use\s+([\w\\]+)", r"\b(?:require|include)(?:_once)?\s*\(?\s*['\"]([^'\"]+)['\"]")),
    "c": Grammar("brace", (_kinds("struct|union", "struct"), _kinds("enum", "enum"), _C_FUNCTION), imports=(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",)),
    "cpp": Grammar("brace", (_kinds("namespace", "module"), _kinds("class", "class"), _kinds("struct|union", "struct"), _kinds(r"enum(?:\s+class)?", "enum"), _C_FUNCTION), "colon", (r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",)),
    "zig": Grammar("brace", (("struct", r"\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*(?:packed\s+|extern\s+)?struct"), ("enum", r"\s*(?:pub\s+)?const\s+(?P<name>\w+)\s*=\s*enum"), ("fn", r"\s*(?:pub\s+)?(?:inline\s+|export\s+)?fn\s+(?P<name>\w+)")), imports=(r"@import\(\"([^\"]+)\"\)",)),
    "perl": Grammar("brace", (("module", r"\s*package\s+(?P<name>[\w:]+)(?=\s*\{)"), ("fn", r"\s*sub\s+(?P<name>\w+)")), imports=(r"^\s*use\s+([\w:]+)",)),
    "shell": Grammar("brace", (("fn", r"\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)"),), imports=(r"^\s*(?:source|\.)\s+(\S+)",)),
    "r": Grammar("brace", (("fn", r"\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"),), imports=(r"\b(?:library|require)\(([\w.]+)\)",)),
    "ruby": Grammar("end", (("class", r"\s*class\s+(?P<name>[A-Z][\w:]*)"), ("module", r"\s*module\s+(?P<name>[A-Z][\w:]*)"), ("fn", r"\s*def\s+(?:self\.)?(?P<name>\w+[?!=]?)")), "less", (r"^\s*require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)",)),
    "lua": Grammar("end", (("fn", r"\s*(?:local\s+)?function\s+(?:(?P<recv>\w+)[.:])?(?P<name>\w+)"),), imports=(r"\brequire\s*\(?\s*['\"]([^'\"]+)",)),
    "elixir": Grammar("end", (("module", r"\s*defmodule\s+(?P<name>[\w.]+)"), ("interface", r"\s*defprotocol\s+(?P<name>[\w.]+)"), ("fn", r"\s*defp?\s+(?P<name>\w+[?!]?)")), imports=(r"^\s*(?:alias|import|use|require)\s+([\w.]+)",)),
    "julia": Grammar("end", (("module", r"\s*module\s+(?P<name>\w+)"), ("struct", r"\s*(?:mutable\s+)?struct\s+(?P<name>\w+)"), ("fn", r"\s*function\s+(?P<name>[\w.!]+)")), imports=(r"^\s*(?:using|import)\s+([\w.]+)",)),
    "sql": Grammar("flat", (("fn", r"(?i)\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+(?P<name>[\w.]+)"), ("struct", r"(?i)\s*create\s+table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.]+)"))),
    "haskell": Grammar("flat", (("type", r"(?:data|newtype|type)\s+(?P<name>\w+)"), ("class", r"class\s+(?:[^=\n]*=>\s*)?(?P<name>\w+)"), ("fn", r"(?P<name>[a-z_]\w*'?)\s*::")), imports=(r"^import\s+(?:qualified\s+)?([\w.]+)",)),
    "ocaml": Grammar("flat", (("module", r"\s*module\s+(?P<name>\w+)"), ("type", r"\s*type\s+(?P<name>\w+)"), ("fn", r"\s*let\s+(?:rec\s+)?(?P<name>\w+)\s+[\w(~]")), imports=(r"^\s*open\s+([\w.]+)",)),
    "clojure": Grammar("flat", (("fn", r"\s*\(defn-?\s+(?P<name>[\w!?*<>=-]+)"), ("type", r"\s*\((?:defrecord|deftype|defprotocol)\s+(?P<name>\w+)")), imports=(r"\[([\w.-]+)\s+:(?:as|refer)\b",)),
    "generic": Grammar("brace", (("type", rf"\s*{_MOD}(?:class|struct|type|record)\s+(?P<name>\w+)"), ("fn", rf"\s*{_MOD}(?:def|function|fn|func|sub|proc)\s+(?P<name>\w+)")), imports=(r"^\s*(?:import|use)\s+([\w.:]+)",)),
}

#: Words that open what ``end`` closes, by language: at the beginning of a statement, and anywhere.
_END_OPENERS = {
    "ruby": (r"(?:class|module|def|if|unless|while|until|case|for|begin)\b", r"\bdo\b"),
    "lua": (r"(?:if|for|while)\b", r"\bfunction\b|(?<!\S)do\b|\brepeat\b"),
    "elixir": (r"(?!)", r"\bdo\b(?!:)|\bfn\b"),
    "julia": (r"(?:module|mutable\s+struct|struct|function|macro|if|for|while|begin|let|try|quote)\b", r"\bdo\b"),
}
_ROUTE = re.compile(r"(?:@\w+|\b(?:app|router))\.(?:get|post|put|delete|patch|route)\(\s*['\"]([^'\"]+)['\"]")
_EVENT = re.compile(r"(?P<bracket>[(){}\[\];])|(?P<line>\n)|(?P<mark>@|\#\[)(?P<decorator>[A-Za-z_]\w*)|(?:(?<!\w)(?P<receiver>[A-Za-z_]\w*)(?:\.|::|->)|(?<![\w.@$:>]))(?P<call>[A-Za-z_]\w*[!?]?)(?=\()|(?:(?<!:):(?!:)|->)[ \t]*&?(?:mut\s+)?(?P<hint>[A-Z]\w*)(?![\w(]|(?:\.|::)\w+\()")
_CONTROL = frozenset("if for while switch catch return function".split())
#: Where a function's header without a body only announces it, outside types.
_PROTOTYPES = ("c", "cpp", "java", "csharp")
#: Where a definition may stand without braces to its line's end, and how its header goes on in the next line.
_EXPRESSIONS = ("kotlin", "scala", "swift")
_GOES_ON = re.compile(r"\s*(?:[{:.,)=]|with\b|extends\b|where\b)|\s*$")


@dataclass
class Scope:
    """An open definition: its names, its id (of a type where it is an ``impl``), its node, and where it opened."""

    names: tuple[str, ...]
    id: str
    prefix: str
    node: dict | None
    mark: int


class FileScan:
    """One file: nodes and edges by external id."""

    def __init__(self, path: str, text: str | None):
        self.path, self.file = path, f"file::{path}"
        self.language = language_of(path)
        self.grammar = GRAMMARS.get(self.language, GRAMMARS["generic"])
        self.code, self.bare = blanked(text, self.language)
        self.nodes: dict[str, dict] = {}
        self.edges: dict[tuple[str, str, str], tuple[float, int]] = {}
        self.types: dict[tuple[str, ...], str] = {}
        self.later: list[tuple[tuple[str, ...], str, str, float, int]] = []
        self.stack: list[Scope] = []
        self.decorators: list[str] = []
        self.last_line = self.bare.count("\n") + 1
        self.node(self.file, path.rpartition("/")[2], 0, 1)["end"] = self.last_line

    # --- what is found --------------------------------------------------------------------------

    def node(self, external_id: str, label: str, kind: int, line: int) -> dict:
        return self.nodes.setdefault(external_id, {"id": external_id, "label": label, "type": kind, "line": line, "end": line})

    def edge(self, src: str, dst: str, relation: str, line: int, weight: float | None = None) -> None:
        self.edges.setdefault((src, dst, relation), (WEIGHTS[relation] if weight is None else weight, line))

    def inside(self) -> str:
        """Who calls: the innermost function, else the file."""
        return next((s.id for s in reversed(self.stack) if s.prefix == "fn"), self.file)

    def open(self, prefix: str, m: re.Match, line: int, mark: int, header: str) -> None:
        """A definition's scope begins."""
        outer = self.stack[-1].names if self.stack else ()
        name, receiver = m["name"], m.groupdict().get("recv")
        if prefix == "impl":
            names, base = (*outer, *re.split(r"::|\.", name)[-1:]), m.groupdict().get("base")
            self.stack.append(Scope(names, "", "impl", None, mark))
            for b in [base] if base else _bases(header, "colon") if self.language == "swift" else []:
                self.later.append((names, f"ref::{b.rpartition('::')[2]}", "implements", WEIGHTS["implements"], line))
            return
        names = (*outer, receiver, name) if receiver and receiver not in outer[-1:] else (*outer, name)
        external_id = f"{self.file}::{prefix}::{'::'.join(names)}"
        node = self.node(external_id, name, NODE_TYPES[prefix], line)
        if prefix != "fn":
            self.types.setdefault(names, external_id)
        holder = self.stack[-1] if self.stack else None
        if receiver or holder is not None and holder.prefix == "impl":
            self.later.append((names[:-1], external_id, "contains", 1.0, line))
        else:
            self.edge(holder.id if holder else self.file, external_id, "contains", line)
        for b in _bases(header, self.grammar.bases) if prefix != "fn" else ():
            self.edge(external_id, f"ref::{b}", "implements", line)
        for d in self.decorators:
            self.edge(external_id, f"ref::{d}", "references", line, DECORATOR_WEIGHT)
        self.decorators = []
        self.stack.append(Scope(names, external_id, prefix, node, mark))

    def close(self, line: int) -> None:
        s = self.stack.pop()
        if s.node is not None:
            s.node["end"] = max(s.node["end"], line)

    def call(self, m: re.Match, line: int) -> None:
        name, receiver = m["call"].rstrip("!?"), m["receiver"]
        declares = bool(self.stack) and self.stack[-1].prefix in ("interface", "trait", "struct", "enum")
        if name in NOT_CALLS or receiver in OWN_RECEIVERS or declares or self.language in ("shell", "clojure"):
            return
        self.edge(self.inside(), f"ref::{receiver if receiver and receiver[0].isupper() else name}", "calls", line)

    def hint(self, name: str, line: int) -> None:
        if name not in PLAIN_TYPES:
            self.edge(self.stack[-1].id or self.file if self.stack else self.file, f"ref::{name}", "references", line)

    # --- scans ------------------------------------------------------------------------------------

    def definition(self, at: int) -> tuple[str, re.Match] | None:
        for prefix, pattern in self.grammar.patterns:
            if m := pattern.match(self.bare, at):
                if prefix == "method":  # a name and a parenthesis define something only in a class
                    if not (self.stack and self.stack[-1].prefix in ("class", "interface")) or m["name"] in _CONTROL:
                        continue
                    prefix = "fn"
                if m["name"] in _CONTROL or prefix == "fn" and m["name"] in NOT_CALLS - {"print", "do", "new", "match", "with", "when"}:
                    continue
                return prefix, m
        return None

    def braces(self) -> None:
        """Scopes by braces: a definition waits for its brace, or ends with a semicolon."""
        brackets: list[str] = []
        waiting: tuple[str, re.Match, int] | None = None
        held: list[tuple[re.Match, int]] = []  # what stands in the header of the definition that waits
        line, names = 1, -1

        def begins(at: int) -> None:
            nonlocal waiting, names
            if waiting is None and not (brackets and brackets[-1] != "{") and (found := self.definition(at)):
                names = found[1].start("name")
                waiting = (*found, line + self.bare.count("\n", at, names))

        def settle(body: bool, at: int) -> None:
            """The definition that waits gets its scope, or has none."""
            nonlocal waiting
            prefix, m, first = waiting
            waiting = None
            in_type = bool(self.stack) and self.stack[-1].prefix not in ("fn", "module")
            known = body or prefix != "impl" and (prefix != "fn" or in_type or self.language not in _PROTOTYPES)
            if known:
                self.open(prefix, m, first, len(brackets), self.code[m.end("name") : at])
            for e, number in held if prefix == "fn" or not known else ():
                self.other(e, number, names)
            held.clear()
            if known and not body:
                self.close(line)

        begins(0)
        for e in _EVENT.finditer(self.bare):
            kind, at = e.lastgroup, e.start()
            if kind == "line":
                if waiting and self.language in _EXPRESSIONS and not (brackets and brackets[-1] != "{") and not _GOES_ON.match(self.bare, e.end()):
                    settle(False, at)
                line += 1
                begins(e.end())
            elif kind == "bracket":
                c = e.group()
                if c == "{":
                    own = waiting and not (brackets and brackets[-1] != "{")
                    brackets.append(c)
                    if own:
                        settle(True, at)
                    begins(e.end())
                elif c in "([":
                    brackets.append(c)
                elif c == "}":
                    while brackets and brackets[-1] != "{":
                        brackets.pop()
                    if waiting and self.language in _EXPRESSIONS:
                        settle(False, at)
                    waiting = None
                    held.clear()
                    if self.stack and self.stack[-1].mark == len(brackets):
                        self.close(line)
                    if brackets:
                        brackets.pop()
                    begins(e.end())
                elif c == ";":
                    if not brackets or brackets[-1] == "{":
                        if waiting:
                            settle(False, at)
                        begins(e.end())
                elif brackets and brackets[-1] != "{":
                    brackets.pop()
            elif waiting and not e["decorator"]:
                held.append((e, line))
            else:
                self.other(e, line, names)
        if waiting:
            settle(False, len(self.bare))

    def other(self, e: re.Match, line: int, name_at: int) -> None:
        if e["call"]:
            if e.start("call") != name_at:
                self.call(e, line)
        elif e["decorator"]:
            if (e["mark"] == "@") and e["decorator"] not in ("interface", "import"):
                self.decorators.append(e["decorator"])
        elif e["hint"]:
            self.hint(e["hint"], line)

    def lines(self) -> Iterator[tuple[int, int, str]]:
        """(number, place, bare line)."""
        at = 0
        for i, text in enumerate(self.bare.split("\n")):
            yield i + 1, at, text
            at += len(text) + 1

    def indents(self) -> None:
        """Scopes by indentation: a line that begins inside brackets or a string goes on with the line before."""
        depth, last, previous = 0, 1, ""
        inside = {at + 1 for _, a, b in LANGUAGES[self.language].spans(self.code) for at in range(a, b) if self.code[at] == "\n"}
        for number, at, text in self.lines():
            goes_on = depth > 0 or previous.rstrip().endswith("\\") or at in inside
            names = -1
            if text.strip() and not goes_on:
                indent = len(text.expandtabs()) - len(text.expandtabs().lstrip())
                while self.stack and self.stack[-1].mark >= indent:
                    self.close(last)
                if found := self.definition(at):
                    prefix, m = found
                    end = self.bare.find(":\n", m.end())
                    self.open(prefix, m, number, indent, self.code[m.end("name") : max(end, m.end("name"))] if prefix != "fn" else "")
                    names = m.start("name")
                elif not text.lstrip().startswith("@"):
                    self.decorators = []
            for e in _EVENT.finditer(text):
                if e["bracket"]:
                    depth = max(0, depth + (1 if e.group() in "([{" else -1 if e.group() in ")]}" else 0))
                elif e["decorator"]:
                    if text.lstrip().startswith("@"):
                        self.decorators.append(e["decorator"])
                elif e["call"]:
                    if at + e.start("call") != names and not text.lstrip().startswith(("@", "class ")):
                        self.call(e, number)
                elif e["hint"] and not text.lstrip().startswith(("import", "from")):
                    self.hint(e["hint"], number)
            if text.strip():
                last = number
            previous = text

    def ends(self) -> None:
        """Scopes by ``end``: every opener counts, those of definitions name their scope."""
        first, anywhere = _END_OPENERS[self.language]
        first, words = re.compile(rf"\s*(?:{first})"), re.compile(rf"(?P<open>{anywhere})|(?P<end>\bend\b|\buntil\b)" if self.language == "lua" else rf"(?P<open>{anywhere})|(?P<end>\bend\b)")
        depth = 0
        for number, at, text in self.lines():
            found, names = self.definition(at), -1
            before, opens = depth, bool(first.match(text))
            rest = text
            if self.language in ("ruby", "julia") and found and re.match(r"[^=\n(]*(?:\([^)]*\))?\s*=(?![=~>])", text[found[1].end() - at :]):
                opens = False  # a definition of one expression
            if self.language == "ruby" and opens and re.match(r"\s*(?:while|until|for)\b", text):
                rest = re.sub(r"\bdo\b", "  ", text)
            if self.language == "lua" and re.match(r"\s*(?:for|while)\b", text):
                rest = re.sub(r"(?<!\S)do\b", "  ", text)
            depth += opens
            events = sorted([(m.start(), 1 if m["open"] else -1) for m in words.finditer(rest)])
            if found:
                prefix, m = found
                names = m.start("name")
                has_body = opens or any(d > 0 for _, d in events)
                self.open(prefix, m, number, before + 1, self.code[m.end("name") : at + len(text)])
            for e in _EVENT.finditer(text):
                if e["call"] and at + e.start("call") != names:
                    self.call(e, number)
            if found and not has_body:
                self.close(number)
            for _, d in events:
                if d < 0:
                    if self.stack and self.stack[-1].mark == depth:
                        self.close(number)
                    depth = max(0, depth - 1)
                else:
                    depth += 1

    def flat(self) -> None:
        """No nested scopes: a definition goes on until the next one."""
        for number, at, text in self.lines():
            found, names = self.definition(at), -1
            if found:
                while self.stack:
                    self.close(max(1, number - 1))
                self.open(*found, number, 0, "")
                names = found[1].start("name")
            for e in _EVENT.finditer(text):
                if e["call"] and at + e.start("call") != names:
                    self.call(e, number)

    def imports(self) -> None:
        for pattern in self.grammar.import_patterns:
            for m in pattern.finditer(self.code):
                line = self.code.count("\n", 0, m.start(1)) + 1
                for name in _imported(self.language, m):
                    self.edge(self.file, f"ref::{name}", "imports", line)
        for m in _ROUTE.finditer(self.code):
            self.edge(f"route::{m[1]}", self.file, "routes_to", self.code.count("\n", 0, m.start()) + 1)

    def run(self) -> FileScan:
        {"brace": self.braces, "indent": self.indents, "end": self.ends, "flat": self.flat}[self.grammar.scopes]()
        while self.stack:
            self.close(self.last_line)
        for names, other, relation, weight, line in self.later:
            owner = self.types.get(names) or self.types.get(names[-1:])
            self.edge(owner or self.file, other, relation, line, weight)
        self.imports()
        return self


def _bases(header: str, style: str) -> list[str]:
    """The names of the bases in what stands between a definition's name and its body."""
    header = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", header)) if style != "less" else header
    if style == "paren":
        m = re.match(r"\s*\(([^)]*)\)", header, re.S)
        found = m[1].split(",") if m else []
        return [b.strip() for b in found if re.fullmatch(r"\s*[\w.]+\s*", b) and b.strip() != "object"]
    if style == "words":
        found = re.split(r",|\bwith\b", " , ".join(re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|$)", header, re.S)))
    elif style == "colon":
        header = re.sub(r"\([^()]*\)", "", header)
        m = re.search(r"(?<!:):(?!:)(.*)", header, re.S)
        found = m[1].split(",") if m else []
    elif style == "less":
        m = re.match(r"\s*<\s*([\w:]+)", header)
        found = [m[1]] if m else []
    else:
        found = []
    names = [re.sub(r"^(?:(?:public|private|protected|virtual)\s+)+", "", b.strip()) for b in found]
    return [m[0] for b in names if (m := re.match(r"[A-Za-z_][\w.:\\]*", b))]


def _use_tree(tree: str) -> list[str]:
    """``a::{b, c::{d}}`` as ``a::b`` and ``a::c::d``."""
    tree = re.sub(r"\s+as\s+\w+", "", tree).strip()
    if "{" not in tree:
        return [tree] if tree else []
    head, _, rest = tree.partition("{")
    rest = rest[: rest.rfind("}")] if "}" in rest else rest
    out, depth, part = [], 0, ""
    for c in rest + ",":
        if c == "," and not depth:
            out += [head.strip() + x if x != "self" else head.strip().removesuffix("::") for x in _use_tree(part)]
            part = ""
        else:
            depth += (c == "{") - (c == "}")
            part += c
    return out


def _imported(language: str, m: re.Match) -> list[str]:
    if language == "python" and m.re.groups == 2:
        names = [re.split(r"\s+as\s+", x.strip())[0].strip() for x in m[2].strip("() \t").replace("\n", " ").split(",")]
        return [m[1], *(x for x in names if re.fullmatch(r"\w+", x))]
    if language == "python":
        return [x for part in m[1].split(",") if (x := re.split(r"\s+as\s+", part.strip())[0].strip()) and re.fullmatch(r"[\w.]+", x)]
    if language == "rust":
        return [re.sub(r"\s+", "", x) for x in _use_tree(m[1])]
    if language == "go" and '"' in m[1]:
        return re.findall(r'"([^"]+)"', m[1])
    return [m[1]] if m[1].strip() else []


class CodeScopes:
    """UDTF ``code_scopes(path, text)``: nodes (``relation`` is null) and edges of one file."""

    def eval(self, path: str, text: str):
        if path is None:
            return
        scan = FileScan(path, text).run()
        for n in scan.nodes.values():
            yield n["id"], None, None, n["label"], n["type"], None, n["line"], n["end"]
        for (src, dst, relation), (weight, line) in scan.edges.items():
            yield src, dst, relation, None, None, weight, line, None


SCHEMA = "src string, dst string, relation string, label string, node_type int, weight double, line_start int, line_end int"
code_scopes = udtf(CodeScopes, returnType=SCHEMA)


def register(spark: SparkSession) -> None:
    """Make ``code_scopes(path, text)`` a table function of SQL: ``FROM files, LATERAL code_scopes(path, text)``."""
    spark.udtf.register("code_scopes", code_scopes)


def scanned(files: DataFrame) -> DataFrame:
    """path and what ``code_scopes`` finds in each file of (path, text)."""
    held = files.select("path", "text")
    return held.lateralJoin(code_scopes(F.col("path").outer(), F.col("text").outer())).drop("text")
