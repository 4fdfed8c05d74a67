"""The lexical scan and the scope stack, against files with known contents and against a plain character machine."""

import random

import pytest
from pyspark.sql import functions as F

from loomgraph.sources import formats, scopes
from loomgraph.sources.lexical import LANGUAGES, blanked, language_of, without_comments

STRIPPED = [
    ("python", 'y = "a # b" # c\n', 'y = "a # b" \n'),
    ("python", "x = '''a # b\n\"c\" ''' # d", "x = '''a # b\n\"c\" ''' "),
    ("python", r'x = "a\" # b" # c', r'x = "a\" # b" '),
    ("rust", 'url = " //x" // z', 'url = " //x" '),
    ("rust", "#[derive(Debug)]\nstruct A; /* a /* b */ c */ x", "#[derive(Debug)]\nstruct A;  x"),
    ("rust", "fn f<'a>(x: &'a str) { '\"' } // c", "fn f<'a>(x: &'a str) { '\"' } "),
    ("rust", 'let r = r#"a " // b"#; // c', 'let r = r#"a " // b"#; '),
    ("rust", 'let r = r"a\\"; // c', 'let r = r"a\\"; '),
    ("c", "#include <x>\n#define A 1 /* q\n */\nint a; // b", "#include <x>\n#define A 1 \n\nint a; "),
    ("cpp", 'auto a = R"x(// " )" )x"; // c', 'auto a = R"x(// " )" )x"; '),
    ("csharp", 'var s = @"a\\" + "b"; // c', 'var s = @"a\\" + "b"; '),
    ("java", 'String s = """\n // "a"\n"""; // c', 'String s = """\n // "a"\n"""; '),
    ("go", "a := `// \\` // b\n", "a := `// \\` \n"),
    ("go", 'a = "x\nb // c', 'a = "x\nb '),
    ("typescript", "`a // ${b}` // c", "`a // ${b}` "),
    ("php", "#[Attr]\n$a = '#'; # b", "#[Attr]\n$a = '#'; "),
    ("shell", "echo $# ${a#b} # c\n# d", "echo $# ${a#b} \n"),
    ("ruby", "=begin\nx\n=end\ndef a # b\n", "\n\n\ndef a \n"),
    ("lua", "a -- b\nx = [==[ -- ]] ]==] --[[ q\n r ]] z", "a \nx = [==[ -- ]] ]==] \n z"),
    ("sql", "select 'it''s -- x' -- y", "select 'it''s -- x' "),
    ("haskell", "f x --> y -- z {- a {- b -} -}", "f x --> y "),
    ("ocaml", 'let a = "(*" (* b (* c *) *)', 'let a = "(*" '),
    ("generic", "#[a]\n#!/bin\n# x\n#include <a>\nhttp://a", "#[a]\n#!/bin\n\n#include <a>\nhttp://a"),
]


@pytest.mark.parametrize(("language", "text", "want"), STRIPPED)
def test_comments_go_and_strings_and_directives_stay(language, text, want):
    assert without_comments(text, language) == want
    code, bare = blanked(text, language)
    assert len(code) == len(bare) == len(text) and code.count("\n") == bare.count("\n") == text.count("\n")


def test_nulls_and_unknown_languages():
    assert without_comments(None, "python") == "" and blanked(None, "odd") == ("", "")
    assert language_of(None) == language_of("Makefile") == "generic" and language_of("a/B.RS") == "rust"


def machine(text):
    """C-like comments and strings by one character at a time."""
    out, state, i = [], "code", 0
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if state == "code" and two in ("//", "/*"):
            state, i = ("line" if two == "//" else "block"), i + 2
            continue
        if state == "line" and c == "\n":
            state = "code"
        if state == "block" and two == "*/":
            state, i = "code", i + 2
            continue
        if state in ("code", "string"):
            out.append(c)
            if c == '"':
                state = "string" if state == "code" else "code"
            elif state == "string" and c == "\n":
                state = "code"
            elif state == "string" and c == "\\" and i + 1 < len(text):
                out.append(text[i + 1])
                i += 1
        elif c == "\n":
            out.append(c)
        i += 1
    return "".join(out)


def test_the_scan_of_java_is_the_plain_machine():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["a", " ", "\n", '"', "/", "*", "//", "/*", "*/", "\\"]) for _ in range(rng.randint(0, 24)))
        if '"""' not in text:
            assert without_comments(text, "java") == machine(text), text


def test_every_language_ends_on_any_text():
    rng = random.Random(2)
    signs = ["a", " ", "\n", '"', "'", "`", "#", "--", "//", "/*", "*/", "{", "}", "(", ")", "[[", "]]", "=begin", "{-", '"""', "\\", "end", "def x", "class Y:", "fn z", ";", "function q() {"]
    for name in LANGUAGES:
        ext = next((e for e in ("py rs c cpp java cs kt scala swift go ts php rb sh pl r jl ex lua sql hs ml clj zig").split() if language_of(f"a.{e}") == name), "txt")
        for _ in range(60):
            text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
            scan = scopes.FileScan(f"a.{ext}", text).run()
            assert not scan.stack and all(1 <= n["line"] <= n["end"] <= scan.last_line for n in scan.nodes.values())


def found(path, text):
    s = scopes.FileScan(path, text).run()
    short = lambda x: x.removeprefix(f"file::{path}").lstrip(":") or "file"
    return {short(n): (s.nodes[n]["line"], s.nodes[n]["end"]) for n in s.nodes}, {(short(a), r, short(b)): w for (a, b, r), (w, _) in s.edges.items()}


def test_python_scopes():
    nodes, edges = found("a.py", 'import os, sys as s\nfrom x.y import (z,\n   w as v)\n@dec\nclass A(Base, object):\n    """doc\ndef no(): pass\n"""\n    def run(self, q: Thing) -> Other:\n        def inner():\n            return helper(1)  # nope(2)\n        x = "call(3)"\n        return self.run(foo(\nbar(1)))\n    async def two(self): Foo.bar(); self.z.go()\ndef top(): pass\ntop()\n')
    assert nodes == {"file": (1, 18), "class::A": (5, 15), "fn::A::run": (9, 14), "fn::A::run::inner": (10, 11), "fn::A::two": (15, 15), "fn::top": (16, 16)}
    assert {k for k in edges if k[1] == "contains"} == {("file", "contains", "class::A"), ("class::A", "contains", "fn::A::run"), ("fn::A::run", "contains", "fn::A::run::inner"), ("class::A", "contains", "fn::A::two"), ("file", "contains", "fn::top")}
    assert {k for k in edges if k[1] == "calls"} == {("fn::A::run::inner", "calls", "ref::helper"), ("fn::A::run", "calls", "ref::foo"), ("fn::A::run", "calls", "ref::bar"), ("file", "calls", "ref::top"), ("fn::A::two", "calls", "ref::Foo"), ("fn::A::two", "calls", "ref::go")}
    assert edges["class::A", "implements", "ref::Base"] == 0.7 and edges["class::A", "references", "ref::dec"] == 0.4 and edges["fn::A::run", "references", "ref::Thing"] == 0.3
    assert {k[2] for k in edges if k[1] == "imports"} == {"ref::os", "ref::sys", "ref::x.y", "ref::z", "ref::w"}


def test_rust_impls_are_scopes_of_their_types():
    nodes, edges = found("b.rs", 'use a::{b, c::{d, self}};\nimpl<T> Display for S<T> {\n    pub async fn go(&self, x: [u8; 4]) -> Res { helper(x); S::make(); }\n}\npub struct S<T> { b: Other }\nimpl S<u8> { fn new() -> Self { fn deep() {} Self::z() } }\ntrait Tr { fn decl(&self); }\nmod inner { enum E { A, B } fn f() { println!("x {}", g()); } }\n')
    assert set(nodes) == {"file", "struct::S", "fn::S::go", "fn::S::new", "fn::S::new::deep", "trait::Tr", "fn::Tr::decl", "module::inner", "enum::inner::E", "fn::inner::f"}
    assert {("struct::S", "contains", "fn::S::go"), ("struct::S", "contains", "fn::S::new"), ("fn::S::new", "contains", "fn::S::new::deep"), ("trait::Tr", "contains", "fn::Tr::decl"), ("module::inner", "contains", "fn::inner::f"), ("struct::S", "implements", "ref::Display")} <= set(edges)
    assert {k for k in edges if k[1] == "calls"} == {("fn::S::go", "calls", "ref::helper"), ("fn::S::go", "calls", "ref::S"), ("fn::inner::f", "calls", "ref::println"), ("fn::inner::f", "calls", "ref::g")}
    assert {k[2] for k in edges if k[1] == "imports"} == {"ref::a::b", "ref::a::c::d", "ref::a::c"}


NESTED = {
    "a.go": 'package m\nimport (\n  "fmt"\n  q "a/b"\n)\nfunc (s *S) Run(x int) error { fmt.Println(x); return helper(x) }\ntype S struct { a int }\nfunc Free() {}\n',
    "a.java": "public class S<T> extends Base<T> implements I, J {\n  public S(int a) { init(a); }\n  @Override\n  public static <T> List<T> Run(String s) throws E {\n    for (int i = 0; i < n; i++) { helper(); }\n  }\n}\n",
    "a.ts": "export abstract class S extends Base<C> implements I, J {\n  constructor(private x: Foo) { super(); }\n  async Run<T>(y: Bar): Promise<T> {\n    if (x) { helper(1) }\n  }\n}\n",
    "a.cpp": "class S : public Base, private I, J {\n public:\n  int Run(int x) const { return helper(x); }\n};\n",
    "a.cs": "namespace N {\n  public class S : Base, I, J {\n    public async Task<int> Run(string s) { return await helper(s); }\n  }\n}\n",
    "a.kt": "class S(val x: Int) : Base(x), I, J {\n  override fun Run(y: Foo): Bar = helper(y)\n}\n",
    "a.swift": "class S: Base, I {\n  func Run(_ y: Foo) -> Bar { helper(y) }\n}\nextension S: J { func more() {} }\n",
    "a.php": "<?php\nclass S extends Base implements I, J { public function Run($x) { return helper($x); } // no(1)\n}\n",
    "a.scala": "object S extends Base with I with J {\n  def Run(x: Int): Foo = helper(x)\n}\n",
    "a.rb": "class S < Base\n  def Run(x)\n    return 1 if x\n    items.each do |i| helper(i) end\n  end\n  def one = 5\nend\n",
    "a.ex": "defmodule S do\n  def Run(x) do\n    Enum.map(x, fn y -> helper(y) end)\n  end\nend\n",
    "a.lua": "function S.Run(x)\n  if x then helper(x) end\n  for i=1,2 do local f = function() end end\nend\n",
    "a.jl": "module S\nfunction Run(x)\n  if x\n    helper(x)\n  end\nend\nend\n",
}


@pytest.mark.parametrize("path", NESTED)
def test_methods_are_in_their_types(path):
    nodes, edges = found(path, NESTED[path])
    method = "fn::N::S::Run" if path == "a.cs" else "fn::S::Run"
    assert method in nodes and (method, "calls", "ref::helper") in edges
    owner = next((n for n in nodes if n.endswith("::S") and not n.startswith("fn")), "file")
    assert (owner, "contains", method) in edges
    if "Base" in NESTED[path]:
        assert (owner, "implements", "ref::Base") in edges
    if "J" in NESTED[path]:
        assert (owner, "implements", "ref::I") in edges and (owner, "implements", "ref::J") in edges


def test_code_scopes_in_sql_and_as_a_frame(spark):
    rows = [("a.py", "class A:\n    def f(self): pass\n"), ("b.rs", "fn g() { h(); }"), ("c.py", None), (None, "def x(): pass")]
    files = spark.createDataFrame(rows, "path string, text string")
    scopes.register(spark)
    got = spark.sql("SELECT path, src, dst FROM {f} f, LATERAL code_scopes(f.path, f.text) WHERE relation = 'contains'", f=files).collect()
    assert {tuple(r) for r in got} == {("a.py", "file::a.py", "file::a.py::class::A"), ("a.py", "file::a.py::class::A", "file::a.py::fn::A::f"), ("b.rs", "file::b.rs", "file::b.rs::fn::g")}
    nodes, edges = formats.extract_code(files)
    assert nodes.where("node_type = 0").count() == 3 and edges.where("relation = 'calls'").select("src", "dst", "weight").first() == ("file::b.rs::fn::g", "ref::h", 0.4)
    assert "Exchange" not in scopes.scanned(files)._jdf.queryExecution().executedPlan().toString()


def test_code_tree_leaves_out_binary_files_only(spark, tmp_path):
    (tmp_path / "bin").write_bytes(b"ab\x10\x01\x00cd")
    (tmp_path / "text.txt").write_bytes(b"ab\x10\x01\x10cd")
    (tmp_path / "late").write_bytes(b"x" * 8000 + b"\x00")
    assert {r["path"] for r in formats.code_tree(spark, str(tmp_path)).select("path").collect()} == {"text.txt"}


def test_strip_comments_by_the_language_of_the_path(spark):
    df = spark.createDataFrame([("a.py", 'x = "#" # y'), ("a.c", "#include <a> // b"), ("a.rs", None)], "path string, text string")
    got = {r[0]: r[1] for r in df.select("path", formats.strip_comments(F.col("text"), F.col("path"))).collect()}
    assert got == {"a.py": 'x = "#" ', "a.c": "#include <a> ", "a.rs": ""}
