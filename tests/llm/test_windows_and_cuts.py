"""Periodic runs, fill-in-the-middle and substring deduplication against plain restatements."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import fill_in_middle, periodic_runs, queries, substring_dedup
from tests.llm.brute import WORD
from tests.llm.test_operators import ODD, empty, table

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
SPACES = [" ", "  ", "\n", "\t ", "\x0b", "\r\n"]


def saved(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def runs_by_every_period(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic(doc_id, text):
    """The row that the contract of op11 asks for."""
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_every_period(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    return (doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def repetitive(rng, n, words):
    w = [rng.choice(words) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        a, q = rng.randrange(n), rng.randint(1, max(1, n // 3))
        for i in range(a, min(n, a + q * rng.randint(2, 6))):
            w[i] = w[a + (i - a) % q]
    return "".join(x + rng.choice(SPACES) for x in w)


def test_refinement_finds_the_runs_of_every_period():
    rng = random.Random(3)
    for least in (1, 2, 12):
        for _ in range(120):
            texts = [" ".join(str(rng.randrange(k)) for _ in range(rng.randint(0, 70))).encode() for k in rng.choices([1, 2, 3, 6], k=rng.randint(1, 5))]
            words, ids, at = periodic_runs.numbered(texts)
            got = [[] for _ in texts]
            for row, *run in zip(*(x.tolist() for x in periodic_runs.runs_of(ids, at, least)), strict=True):
                got[row].append(tuple(run))
            assert got == [runs_by_every_period(w, least) for w in words]


def test_refinement_of_words_of_one_letter_and_of_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 2000:
        a, b = b, b + a
    for w in ([7] * 3000, b, [0, 1] * 900):
        got = list(zip(*(x.tolist() for x in periodic_runs.runs_of(np.array(w), np.array([0, len(w)]))), strict=True))
        assert [r[1:] for r in got] == runs_by_every_period(w)


def test_periodic_runs_query_equals_the_contract(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, repetitive(rng, rng.randint(1, 90), [f"w{j}é" for j in range(rng.choice([2, 5, 60]))])) for i in range(250)]
    rows += [*ODD, (None, "a b " * 30), (None, None), (8000, "x y z " * 4000), (8001, "one 日本 two " * 5), (8001, "one 日本 two " * 5)]
    got = periodic_runs.op11_periodic_runs(spark, saved(spark, tmp_path, table(spark, rows, repeat=True))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((periodic(*r) for r in [*rows, rows[0]]), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 15


def test_periodic_runs_of_no_rows(spark):
    found = periodic_runs.document_runs(empty(spark))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and not found.count()


def middle(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if form == "spm" else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return (doc_id, n, form, a, b - a, sha(out), sha(text))


def test_fill_in_middle_equals_the_contract(spark, tmp_path):
    rng = random.Random(4)
    signs = ["a", "é", "é", "日", "🙂", "👩‍👧", "\n", "\r\n", "\x00", " ", "<", "<P", "S>", "M", "﻿"]
    rows = [(i, "".join(rng.choices(signs, k=rng.randint(1, 40)))) for i in range(300)]
    rows += [*ODD, (None, "no id"), (None, None), (500, "holds <M> a mark"), (501, "<P><S>"), (502, "long 日本 " * 9000), (503, "x" * fill_in_middle.BLOCK), (503, "x")]
    got = fill_in_middle.op12_fill_in_middle(spark, saved(spark, tmp_path, table(spark, rows, repeat=True))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((middle(*r) for r in [*rows, rows[0]]), key=str)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_rates_and_no_rows(spark):
    df = table(spark, [(i, f"text {i}") for i in range(40)])
    assert {r["form"] for r in fill_in_middle.fill_in_middle(df, plain=100).collect()} == {"plain"}
    assert {r["form"] for r in fill_in_middle.fill_in_middle(df, plain=0, suffix_first=100).collect()} == {"spm"}
    assert not fill_in_middle.fill_in_middle(empty(spark)).count()


def test_offsets_end_where_code_points_end(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "REMEMBERED", 7)
    splitter = fill_in_middle.Splitter()
    rng = random.Random(9)
    for text in ["", " ", "a日🙂" * 900, " \n\u2003" * 200, "é e\u0301 \r\n\x0b\x1c\x85 x", *("".join(rng.choices("ab日🙂 \n\u0301\u3000", k=300)) for _ in range(20))]:
        offsets = fill_in_middle.Offsets(splitter, text)
        assert offsets.n == len(text) and [offsets.end(k) for k in range(len(text) + 1)] == list(range(len(text) + 1))
        assert len(splitter.known) <= max(7, len(set(offsets.blocks)))


def deduplicated(rows, width=50):
    first = {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - width + 1) if d is not None and first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def passages(rng, n, vocab):
    """Documents that share passages of 30 to 120 words, whole copies, edited copies, and one line in every third."""
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared, line, base = [text(rng.randint(30, 120)) for _ in range(12)], text(25), text(130)
    rows = []
    for i in range(n):
        w = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + text(rng.randint(0, 40))
        if i % 3 == 0:
            w += line + text(30)
        if i % 7 == 0:
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
        rows.append((rng.randrange(10**6), "".join(x + rng.choice(SPACES) for x in w)))
    return rows


@pytest.mark.parametrize("change", [{}, {"LARGE": 5}, {"WORDS": 300, "ROWS": 20}, {"BITS": 10}])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, change):
    for name, value in change.items():
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(12)
    rows = passages(rng, 220, [f"w{i}" for i in range(400)]) + [(1, "a b c " * 60), (0, "b c a " * 30), (2, "x " * 9000), (3, "x " * 51), (3, "x " * 49), (2, "x " * 120)]
    rows += [*ODD, (None, "x " * 60), (None, rows[0][1]), (rows[5][0], rows[9][1]), rows[7]]
    got = substring_dedup.without_repeats(table(spark, rows, repeat=True)).collect()
    assert sorted(map(tuple, got), key=str) == deduplicated([*rows, rows[0]])


@pytest.mark.parametrize(("width", "gram"), [(1, 1), (2, 12), (7, 3), (32, 5)])
def test_substring_dedup_of_other_widths(spark, width, gram):
    rng = random.Random(width)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(9)], k=rng.randint(0, 60)))) for i in range(60)]
    got = substring_dedup.without_repeats(table(spark, rows), width, gram).collect()
    assert sorted(map(tuple, got), key=str) == deduplicated(rows, width)


def test_frequent_grams_leave_the_buckets_of_other_windows(spark):
    """A line in every document is no minimiser of a window that holds anything else."""
    rng = random.Random(6)
    line = [f"l{i}" for i in range(30)]
    rows = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(60)] + line + [f"b{rng.randrange(10**6)}" for _ in range(60)])) for i in range(200)]
    docs = table(spark, rows)
    found = substring_dedup.frequent_grams(docs, 12)
    assert len(found) == 19
    known = spark.sparkContext.broadcast(found)
    most = substring_dedup.minimiser_documents(docs, 50, 12, known).agg(F.max("n")).first()[0]
    assert most == 1
    plain = spark.sparkContext.broadcast(found[:0])
    assert substring_dedup.minimiser_documents(docs, 50, 12, plain).agg(F.max("n")).first()[0] > 50


def test_substring_dedup_of_no_rows(spark):
    assert not substring_dedup.without_repeats(empty(spark)).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(2)
    rows = passages(rng, 60, [f"w{i}" for i in range(200)]) + [(10**7 + i, repetitive(rng, 60, ["a", "b", "ü"])) for i in range(60)] + [r for r in ODD if r[0]]
    path = saved(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, path)
    con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in con.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(tuple, df.select(cols).collect()), key=str) == sorted(con.fetchall(), key=str)
