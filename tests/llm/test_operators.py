"""The training-data operators against plain restatements, round trips and planted cases.

Every operator is also given nulls, empty and long texts, ties, repeated rows,
empty tables and columns with clashing names.
"""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from loomgraph.llm import decontamination, fingerprints, html_text, jaccard_join, language, packing, quality, sharding, token_counts, toxicity
from tests.llm.brute import components

ODD = [(9000, None), (9001, ""), (9002, "  \n\t "), (9003, "one two"), (9004, "one two"), (9005, "x" * 20_000), (9006, "é ü 日本 🙂 <s> a_b")]


def table(spark, rows, repeat=False):
    """documents with extra columns whose names operators use inside."""
    df = spark.createDataFrame([*rows, *(rows[:1] if repeat else [])], "doc_id long, text string")
    return df.withColumns({"score": F.lit("clash"), "rank": F.lit(-1), "key": F.lit("k"), "n": F.lit(0), "lang": F.lit("en"), "source": F.lit("s")}).repartition(3)


def empty(spark):
    return table(spark, ODD).limit(0)


def family(rng, n, length, edits, start, vocab):
    base = [rng.choice(vocab) for _ in range(length)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows = family(rng, 120, 60, 4, 0, vocab) + family(rng, 120, 150, 12, 1000, vocab) + ODD
    rows += [(3000 + i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([5, 12, 18, 20, 22, 60])))) for i in range(120)]
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows, repeat=True)).collect()), key=str)
    assert got == components([*rows, rows[0]])
    assert jaccard_join.linked_components(empty(spark)).count() == 0


def test_jaccard_join_links_a_prefix_to_both_extensions(spark):
    rng = random.Random(11)
    rows = []
    for i in range(12):
        words = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
        base = words(84)
        rows += [(10 * i, " ".join(base + words(20))), (10 * i + 1, " ".join(base + words(20))), (10 * i + 2, " ".join(base))]
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows)).collect()), key=str)
    assert got == components(rows) and (1, 100, 0, 1, 0) in got


def test_jaccard_join_of_rows_with_null_and_shared_ids(spark):
    rng = random.Random(19)
    text = lambda n: [f"p{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = text(60), text(60), text(60)
    near = lambda w, k: " ".join([*w[:-k], *text(k)])
    rows = [(1, " ".join(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b, 4)), (None, near(b, 3)), (None, " ".join(c)), (None, near(c, 2)), (9, "x " * 30_000), (8, "x " * 40_000)]
    rows += [(20, " ".join(text(4000))), (3, " ".join(rows[0][1].split() * 3))]
    rows += [(21, rows[9][1] + " more words at the end")]
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows)).collect()), key=str)
    assert got == components(rows)


def test_jaccard_join_over_many_chunks_and_salts(spark, monkeypatch):
    """Large clusters, cut into small chunks; the same answers."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 16)
    monkeypatch.setattr(jaccard_join, "CELLS", 2000)
    monkeypatch.setattr(jaccard_join, "ROWS_A_SALT", 8)
    rng = random.Random(20)
    vocab = [f"w{i}" for i in range(3000)]
    rows = family(rng, 150, 70, 4, 0, vocab) + family(rng, 60, 90, 9, 1000, vocab)
    base = [rng.choice(vocab) for _ in range(100)]
    rows += [(2000 + i, " ".join([*base[: 70 + i % 30], *[f"x{rng.randrange(10**6)}" for _ in range(i % 7)]])) for i in range(120)]
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows)).collect()), key=str)
    assert got == components(rows)


def test_links_between_chunks_equal_plain_sets():
    import numpy as np

    rng = random.Random(21)
    token = lambda: rng.randrange(1 << 63)
    leaders = [sorted({token() for _ in range(60)})]
    leaders.append(sorted({*leaders[0][:52], *(token() for _ in range(8))}))
    pool = [token() for _ in range(6)]
    made = []
    for s in leaders:
        docs, sets, diffs = [], [], []
        for i in range(25):
            gone = sorted(rng.sample(range(60), rng.randint(0, 12)))
            come = sorted(set(rng.sample(pool, rng.randint(0, 4))) - set(s))
            docs.append(i)
            sets.append({t for k, t in enumerate(s) if k not in gone} | set(come))
            diffs.append(len(gone).to_bytes(4, "little") + np.array(gone, "<u4").tobytes() + np.array(come, "<u8").tobytes())
        made.append((jaccard_join.Chunk(docs, [len(x) for x in sets], diffs), sets))
    like = lambda a, b: 4 * len(a & b) >= 3 * len(a | b)
    (x, sx), (y, sy) = made
    got = jaccard_join.links_between(x, x, 60, None).sum(1).tolist()
    assert got == [sum(like(a, b) for k, b in enumerate(sx) if k != i) for i, a in enumerate(sx)]
    got = jaccard_join.links_between(x, y, np.array(leaders[0], np.uint64), np.array(leaders[1], np.uint64))
    assert got.tolist() == [[like(a, b) for b in sy] for a in sx]


def test_a_forest_joins_what_is_linked():
    import numpy as np

    rng = random.Random(22)
    for same in (True, False):
        for _ in range(200):
            m, k = rng.randint(1, 12), rng.randint(1, 12)
            k = m if same else k
            linked = np.array([[rng.random() < 0.12 for _ in range(k)] for _ in range(m)])
            if same:
                linked |= linked.T
                np.fill_diagonal(linked, False)
            n = m if same else m + k
            wanted = [(i, j if same else m + j) for i, j in zip(*np.nonzero(linked), strict=True)]
            edges = list(zip(*jaccard_join.forest(linked, same), strict=True))

            def parts(pairs, n=n):
                root = list(range(n))
                for _ in range(n):
                    for i, j in pairs:
                        root[i] = root[j] = min(root[i], root[j])
                return root

            assert parts(edges) == parts(wanted) and len(edges) < n


def half_alike(rng, n, edits, vocab, start=0, words=120):
    """Edited copies of one text that are too far from each other to link, but for some."""
    base = [rng.choice(vocab) for _ in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(words), edits):
            w[k] = rng.choice(vocab)
        out.append((start + i, " ".join(w)))
    return out


@pytest.mark.parametrize("chunk", [1 << 11, 8])
def test_jaccard_join_of_near_copies_that_hardly_link(spark, monkeypatch, chunk):
    """Followers that do not link with their leader: links and components among them all the same."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 3)
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    rng = random.Random(31)
    vocab = [f"w{i}" for i in range(3000)]
    rows = half_alike(rng, 60, 3, vocab) + half_alike(rng, 60, 5, vocab, 1000) + family(rng, 60, 90, 4, 2000, vocab)
    outlier = half_alike(rng, 40, 1, vocab, 3001)
    w = outlier[0][1].split()
    rows += [*outlier, (3000, " ".join([*w[:85], *(f"q{i}" for i in range(len(w) - 85))]))]  # the least id is half alike to all of its group
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows)).collect()), key=str)
    assert got == components(rows)
    assert {r[2] for r in got if r[0] > 3000} == {3001} and (3000, 116, 3000, 0, 0) in got


def test_near_copies_that_do_not_link_are_not_written_as_pairs(spark, monkeypatch):
    written = {}
    plain = jaccard_join.stored

    def counting(df, name, files=None):
        out = plain(df, name, files)
        if "pairs" in name:
            written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(jaccard_join, "stored", counting)
    rng = random.Random(3)
    rows = half_alike(rng, 300, 4, [f"w{i}" for i in range(3000)], words=160)
    got = sorted((tuple(r) for r in jaccard_join.linked_components(table(spark, rows)).collect()), key=str)
    assert got == components(rows)
    assert sum(written.values()) < 0.1 * 300 * 299 / 2


def test_token_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = token_counts.vocabulary(token_counts.default_path())
    own = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *vocab]
    t = Tokenizer(models.Unigram(own, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=token_counts.MARK, prepend_scheme="always", split=False)
    rng = random.Random(1)
    rows = [r for r in ODD if r[0] != 9006] + [(9007, "é ü 日本 🙂 a_b"), (9008, ("hello world " * 3000).strip())]
    rows += [(i, "".join(rng.choice("ab é日🙂 \nthe") for _ in range(rng.randint(1, 50)))) for i in range(300)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(table(spark, rows)).collect()}
    assert got == {d: len(t.encode(x or "").ids) for d, x in rows}
    assert got[9008] == 3000 * len(t.encode("hello world").ids)
    assert token_counts.token_counts(table(spark, [(None, "a b"), (1, "a b")], repeat=True)).select("n_tokens").distinct().count() == 1
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_token_counts_are_the_best_of_all_segmentations():
    mark = token_counts.MARK
    pieces = [(mark, -1.0), (mark + "a", -2.0), ("a", -3.0), ("ab", -3.5), ("b", -2.5), ("ba", -5.5), ("bab", -6.0), (mark + "ab", -4.5), ("c", -4.0), ("<", -3.0), ("s", -3.0), (">", -3.0)]
    counter, score = token_counts.Counter(pieces), dict(pieces)
    unknown = min(score.values()) - token_counts.UNKNOWN_PENALTY

    def every(text):
        """(score, count) of all segmentations; an unknown character counts as its bytes."""
        if not text:
            return [(0.0, 0)]
        out = []
        for k in range(1, len(text) + 1):
            head = text[:k]
            if head in score:
                own = (score[head], 1)
            elif k == 1:
                own = (unknown, len(head.encode()))
            else:
                continue
            out += [(own[0] + s, own[1] + n) for s, n in every(text[k:])]
        return out

    rng = random.Random(2)
    for text in ["foo<s>bar", "<s>", "<0x61>", *["".join(rng.choice("aabbcé ") for _ in range(rng.randint(1, 9))) for _ in range(300)]]:
        marked = text.replace(" ", mark)
        got = every(marked if marked.startswith(mark) else mark + marked)
        count, best = counter.text(text)
        assert abs(best - max(s for s, _ in got)) < 1e-9
        assert count in {n for s, n in got if abs(s - best) < 1e-9}


def test_control_and_byte_pieces_never_match():
    names = {p for p, _ in token_counts.vocabulary(token_counts.default_path())}
    assert not names & {"<unk>", "<s>", "</s>", "<0x41>"} and len(names) > 30_000
    counter = token_counts.Counter(token_counts.vocabulary(token_counts.default_path()))
    assert counter.text("hello world")[0] == 3
    assert counter.text("foo<s>bar")[0] == 5 and counter.text("foo<0x41>bar")[0] > 5


def test_fingerprints_and_edited_texts(spark):
    rows = [(5, "Ａ  b"), (7, "a B"), (3000, "Straße x"), (3001, "STRASSE  X "), *ODD]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(table(spark, rows)).collect()}
    order = sorted(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        h = len(t) // 2
        assert got[d]["n_chars"] == len(t)
        assert got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()
    assert got[5]["fingerprint"] == got[7]["fingerprint"] and got[7]["copy_of"] == 5 and got[5]["near_next"] == 1.0
    assert got[3000]["fingerprint"] == got[3001]["fingerprint"] != got[5]["fingerprint"]
    assert got[9003]["copy_of"] == got[9004]["copy_of"] == 9003 and got[9000]["copy_of"] == 9000
    for d, t in rows:  # the canonical form and the digest restated
        assert got[d]["fingerprint"] == digest(t or "")
    assert fingerprints.edited_fingerprints(table(spark, [(1, "alone")])).first()["near_next"] == 1.0
    assert fingerprints.edited_fingerprints(empty(spark)).count() == 0


def digest(text):
    import re
    import unicodedata

    nfkc = lambda t: unicodedata.normalize("NFKC", t)
    data = re.sub(r"[\s\u2028\u2029]+", " ", nfkc(nfkc(text).casefold())).strip(" ").encode()
    return "".join(f"{spark_xxhash64([seed, data]):016x}" for seed in (1, 2))


def spark_xxhash64(values):
    """xxhash64 of an int, then of a string with the first hash as its seed."""
    import xxhash

    seed = xxhash.xxh64_intdigest(values[0].to_bytes(4, "little"), 42)
    return xxhash.xxh64_intdigest(values[1], seed)


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "b"), (1, "x y"), (None, "a"), (None, "b"), (2, None), (1, "x y"), (1, "z"), (2000, "long " * 50_000), (-5, "neg")]
    got = [r.asDict() for r in fingerprints.edited_fingerprints(table(spark, rows)).collect()]
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 3
    h = {t: spark.sql("SELECT xxhash64(:t)", {"t": t or ""}).first()[0] for _, t in rows}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], h[r[1]]))
    nulls = sorted((r for r in rows if r[0] is None), key=lambda r: (h[r[1]] % fingerprints.NULL_BLOCKS, h[r[1]]))
    order += nulls
    want = []
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt = t or "", nxt or ""
        k = len(t) // 2
        want.append((d or -1, len(t), hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest(), float(digest(t) == digest(nxt))))
    assert sorted(want) == sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"], r["near_next"]) for r in got)


def test_sharding_is_minimax(spark):
    rng = random.Random(2)
    rows = [(i, "t" * rng.randint(0, 90) + str(i % 150)) for i in range(400)] + ODD[:5] + [(10_000 + i, "hot") for i in range(200)]
    out = [r.asDict() for r in sharding.shard(table(spark, rows), 7).collect()]
    texts = dict(rows)
    groups: dict = {}
    for r in out:
        assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode())
        groups.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in groups.values()) and max(r["shard"] for r in out) <= 6
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    keyed = table(spark, rows).select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("b")).groupBy("key").agg(F.sum("b").alias("bytes"))
    sizes = [r["bytes"] for r in keyed.orderBy("key").collect()]

    def fits(cap):
        n, at = 1, 0
        for x in sizes:
            if x > cap:
                return False
            n, at = (n, at + x) if at + x <= cap else (n + 1, x)
        return n <= 7

    least = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
    assert max(sum(r["size"] for r in out if r["shard"] == s) for s in range(7)) <= least == sharding.minimax_cuts(keyed, 7)[0]
    assert sharding.shard(empty(spark)).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    rng = random.Random(3)
    rows = [(i, " ".join(f"word{rng.randrange(500)}" for _ in range(rng.randint(0, 30)))) for i in range(150)] + ODD
    out = [r.asDict() for r in packing.pack(table(spark, rows, repeat=False), capacity=64).collect()]
    by_doc: dict = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["piece"])):
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        p = by_doc[d]
        assert [x["start"] for x in p] == [sum(y["length"] for y in p[:i]) for i in range(len(p))] and sum(x["length"] for x in p) == len(ids)
        assert all(x["length"] == 64 for x in p[1:])
        for x in p:
            part = ids[x["start"] : x["start"] + x["length"]]
            assert x["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
    bins: dict = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    rooms: list[int] = []  # best fit decreasing on the same pieces
    for x in sorted((r["length"] for r in out), reverse=True):
        k = min((i for i, free in enumerate(rooms) if free >= x), key=lambda i: rooms[i], default=None)
        if k is None:
            rooms.append(64 - x)
        else:
            rooms[k] -= x
    assert len(bins) <= len(rooms)
    assert packing.pack(empty(spark)).count() == 0


def test_bin_completion_is_exact_on_small_cases():
    import itertools

    import numpy as np

    rng = random.Random(4)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(0, 7))]
        counts = np.bincount(items, minlength=65)
        room = rng.randint(1, 60)
        best = max((sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room), default=0)
        assert sum(packing.completion(room, counts)) == best


def test_plan_needs_no_more_sequences_than_the_least():
    from collections import Counter

    def least(items, cap):
        best = [len(items)]

        def place(i, rooms):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, cap - items[i]])

        place(0, [])
        return best[0]

    rng = random.Random(13)
    cases = []
    for n in range(40):  # sequences of 2048 that are full
        cuts = [sorted(rng.sample(range(256, 1792), 2)) for _ in range(n % 20 + 2)]
        cases.append(([b - a for c in cuts for a, b in zip([0, *c], [*c, 2048], strict=True)], 2048, len(cuts)))
    for _ in range(60):
        items = sorted((rng.randint(8, 60) for _ in range(rng.randint(0, 9))), reverse=True)
        cases.append((items, 100, least(items, 100)))
    for items, cap, bins in cases:
        got = packing.plan(dict(Counter(items)), cap)
        assert Counter(s for chosen, t in got for s in chosen * t) == Counter(items)
        assert all(sum(chosen) <= cap for chosen, _ in got)
        assert sum(t for _, t in got) == bins


def placed(plan, cap):
    from collections import Counter

    used = Counter()
    for chosen, times in plan:
        assert sum(chosen) <= cap and times > 0
        for x in chosen:
            used[x] += times
    return used


def test_plans_of_short_pieces():
    from collections import Counter

    import numpy as np

    rng = random.Random(14)
    assert packing.plan({}) == []
    for n in range(60):
        lengths = {5: 1, 4: 1, 2: 5000} if n == 0 else {k: rng.randint(1, 10 ** rng.randint(1, 6)) for k in rng.sample(range(1, 9), rng.randint(1, 8))}
        counts = np.zeros(2049, np.int64)
        counts[list(lengths)] = list(lengths.values())
        got = packing.plan(lengths, nodes=20_000)
        assert placed(got, 2048) == lengths == placed(packing.best_fit(counts, 2048), 2048)
        assert packing.least_bins(counts, 2048) <= sum(t for _, t in got) <= min(sum(t for _, t in packing.best_fit(counts, 2048)), packing.least_bins(counts, 2048) + 1)
    lengths = {k: rng.randint(1, 50) for k in range(1, 2049)}
    assert placed(packing.plan(lengths, nodes=1000), 2048) == lengths
    items = [rng.randint(1, 30) for _ in range(40)]
    first = packing.best_fit(np.bincount(items, minlength=65), 64)
    rooms: list[int] = []
    for x in sorted(items, reverse=True):  # the same rule, piece by piece
        k = min((i for i, free in enumerate(rooms) if free >= x), key=lambda i: rooms[i], default=None)
        if k is None:
            rooms.append(64 - x)
        else:
            rooms[k] -= x
    assert sorted(64 - sum(c) for c, t in first for _ in range(t)) == sorted(rooms)
    assert placed(first, 64) == Counter(items)


def test_dominated_fillings():
    bits = lambda *xs: sum(1 << x for x in xs)
    assert packing._dominated([5, 3], 2, bits(7)) and packing._dominated([5, 3], 2, bits(2)) and packing._dominated([5, 3], 0, bits(8))
    assert not packing._dominated([5, 3], 2, bits(3, 11)) and not packing._dominated([5, 3], 0, bits(5, 3, 6)) and not packing._dominated([], 0, bits(1))


def test_packing_of_many_short_documents(spark):
    rows = [(i, "a") for i in range(5000)] + [(5000, "a b c d"), (5001, "a b c"), (None, "a"), (None, "a"), (5001, "a b c")]
    out = [r.asDict() for r in packing.pack(table(spark, rows)).collect()]
    assert len(out) == len(rows) and len({r["sequence_id"] for r in out}) == 5
    for s in {r["sequence_id"] for r in out}:
        at = 0
        for r in sorted((r for r in out if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def labelled(spark, rng, bad_word, column):
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ana", "olo", "ibe", "upu", "eri")]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(words) for _ in range(rng.randint(8, 60))]
        bad = i % 8 == 0
        if bad:
            w[rng.randrange(len(w))] = bad_word(rng)
        rows.append((i, " ".join(w)))
        if i % 3 or bad:
            labels.append((i, int(bad)))
    labels += [(0, None), (1, labels[0][1] * 0), (99_999, 1)]
    return rows, spark.createDataFrame(labels, f"doc_id long, {column} int")


def test_toxicity_finds_planted_words(spark):
    rows, labels = labelled(spark, random.Random(6), lambda r: r.choice(["vilezub", "vilezuk", "gromtar"]), "toxic")
    out = {r["doc_id"]: r for r in toxicity.classify(table(spark, rows + ODD), labels).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(out[d]["held_out"] for d in held) and len(out) == len(rows) + len(ODD)
    right = sum(out[d]["predicted"] == int(d % 8 == 0) for d in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and out[9000]["score"] == out[9001]["score"]
    none = toxicity.classify(table(spark, ODD), labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.classify(empty(spark), labels).count() == 0


def test_quality_separates_junk(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        w = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}" for _ in range(rng.randint(8, 60))]
        good = i % 4 != 0
        rows.append((i, " ".join(w if good else [x + rng.choice(["%%%", "$$$"]) for x in w])))
        labels.append((i, int(good)))
    out = {r["doc_id"]: r for r in quality.classify(table(spark, rows + ODD), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    held = [d for d, _ in rows if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(out[d]["held_out"] for d in held)
    assert sum(out[d]["predicted"] == int(d % 4 != 0) for d in held) >= 0.97 * len(held)
    assert all((r["score"] >= 0.7) == bool(r["predicted"]) for r in out.values())
    assert {r["score"] for r in quality.classify(table(spark, ODD), spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}


def test_language_of_code_switched_text(spark):
    rng = random.Random(8)
    stems = {"aa": ["sch", "ung", "keit", "ein"], "bb": ["tion", "ment", "eau", "oux"], "cc": ["cion", "mente", "ado", "llo"]}
    say = lambda k, n: " ".join("".join(rng.choice(stems[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k := "abc"[i % 3] * 2, 30), k) for i in range(240)]
    rows += [(1000, say("aa", 30) + " " + say("bb", 10), None), (1001, None, "aa"), (1002, "12 !!", "bb"), (1003, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert all(out[d]["lang_pred"] == k for d, _, k in rows[:240])
    assert out[1000]["lang_pred"] == "aa" and 0.6 < out[1000]["score"] < 0.9
    assert {out[d]["lang_pred"] for d in (1001, 1002, 1003)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    steps = language.Steps(lengths)
    w, jump = rng.random((9, 3)) + 0.1, rng.random((3, 3)) + 0.1
    laid = np.empty_like(w)
    laid[steps.place] = w
    sums, _, _ = steps.forward_backward(laid, jump)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    for rank, row in enumerate(steps.order[: len(sums)]):
        e, n = w[starts[row] : starts[row + 1]], lengths[row]
        total, marginal = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=n):
            p = np.prod([e[i, s] for i, s in enumerate(path)]) * np.prod([jump[a, b] for a, b in itertools.pairwise(path)])
            total += p
            marginal += p * np.bincount(path, minlength=3)
        assert np.allclose(sums[rank], marginal / total)


def test_html_main_text(spark):
    site = "<html><head><title>no</title><script>x('</p>')</script></head><body><header><a href=/>Site</a></header><nav><ul><li><a>m{0}</a></ul></nav><article><h1>T{0}</h1><p>One <b>bo</b>ld &eacute; a&nbsp;b<p>two {0} &lt; 3<div class=ad>buy</div><section class=comments><p>nice</section></article><aside>s</aside><footer>f {0}</footer>"
    plain = "<body><div id=top class=menu><a>x</a></div><div class=content><h2>H</h2><p>Text {0} of the page runs on here.</p><form>q</form></div><div class=cookie-notice>ok?</div></body>"
    rows = [(i, "https://a.example/p", site.format(i)) for i in range(30)] + [(100 + i, "http://B.example:80/x?y", plain.format(i)) for i in range(3)]
    rows += [(200, None, None), (201, "u", ""), (202, "https://a.example/q", "<p>cut & <a hre"), (203, "https://a.example/z", "just text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("clash")})
    out = {r["page_id"]: r for r in html_text.main_text(df).collect()}
    assert out[7]["text"] == "T7 One bold é a b two 7 < 3" and out[7]["n_chars"] == len(out[7]["text"])
    assert out[101]["text"] == "H Text 1 of the page runs on here."
    assert [out[i]["text"] for i in (200, 201, 202, 203)] == ["", "", "cut &", "just text"]
    assert html_text.main_text(df.limit(0)).count() == 0
    wrapper = html_text.induce([site.format(i) for i in range(3)] + [site.format(9).replace("<aside>s</aside>", "")])
    assert "(<p>#text</>)+" in wrapper.expression() and "(<aside>s</>)?" in wrapper.expression()


def test_contamination_and_slots(spark):
    item = "a train that leaves the old town travels 60 km in 2 hours before it stops at the small green station near the river"
    other = item.replace("60", "75").replace("2 hours", "3 hours")
    twisted = "x 60 y 60 z 60 we add w 60 and v 60 and u 60"
    wrong = "x 1 y 2 z 3 we add w 4 and v 5 and u 6"
    bench = spark.createDataFrame([(1, item), (2, twisted), (3, None), (4, "short one"), (5, "")], "item_id long, text string")
    filler = " ".join(f"f{chr(97 + i % 26)}" for i in range(40))
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, f"{filler}. {other} {filler}"), (3, wrong), (4, " ".join(item.split()[:9]) + " " + filler), (5, "this is a short one here"), (6, filler), *ODD]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contamination(table(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (5, 4)}
    assert got[2, 1]["n_reparameterised"] > 0 and got[1, 1]["n_reparameterised"] == 0
    assert decontamination.contamination(empty(spark), bench).count() == 0
    assert decontamination.contamination(table(spark, rows), bench.limit(0)).count() == 0


def test_contamination_by_several_occurrences(spark):
    rng = random.Random(12)
    text = "tom has {} red pens and {} blue pens while ann has {} red caps and {} green caps so they pay {} coins for {} bags with {} pears and {} plums"
    values = lambda: [rng.randint(10, 99) for _ in range(8)]
    item, years = text.format(*values()), "then 3 4 5 6 7 8 9 10 11 12 13"
    bench = spark.createDataFrame([(1, item), (2, years)], "item_id long, text string")
    filler = " ".join(f"f{chr(97 + i % 26)}" for i in range(40))
    rows = [(i, f"{item} {filler} {text.format(*values())}") for i in range(20)]
    rows += [(100 + i, f"{text.format(*values())} {filler} {text.format(*values())} {filler}") for i in range(20)]
    rows += [(200, years), (201, "then 24 25 26 27 28 29 30 31 32 33 34"), (202, item.replace("red caps", "very red caps"))]
    got = {(r["doc_id"], r["item_id"]): (r["n_found"], r["n_windows"], r["n_reparameterised"]) for r in decontamination.contamination(table(spark, rows), bench).collect()}
    whole = len(item.split()) - decontamination.WIDTH + 1
    assert all(got[i, 1] == (whole, whole, 0) for i in range(20))
    assert all(got[100 + i, 1][:2] == (whole, whole) for i in range(20))
    assert got[200, 2] == (5, 5, 0) and (201, 2) not in got
    assert got[202, 1] == (whole - 7, whole, 0)


STORIES = """{A} sold clips to {n} of her friends in {m}. Then {A} sold half as many clips to {B} in {m} and kept {k} of them. How many clips did {A} sell altogether?
Every day, {A} feeds each of {n} chickens {k} cups of feed. {B} gives the chickens {j} cups in the morning. How many cups does {A} need for the last meal of the day?
{A} drove {n} miles on Monday and {k} miles on Tuesday. On Wednesday {B} drove twice as far as {A} did on both days. How far did {B} drive in all, if the car used {j} gallons?
A shop of {A} sells {n} red apples for {k} dollars each. {B} buys {j} of these apples and pays with one note. What change does {B} get from {A} at the till?
{A} and {B} share a garden of {n} square metres. {A} plants roses on {k} metres of it, and {B} plants tulips on {j} metres. Which part of the garden is left for {A} to plant?""".split("\n")
NAMES = "Natalia Roberta Wendi Mark Olga Pedro Ingrid Tobias Farah Kenji Lucia Marek Nadia Oscar Petra Quentin Rosa Stefan Tamara Ulrich".split()


def told(rng, story):
    a, b = rng.sample(NAMES, 2)
    n, k, j = rng.sample(range(2, 99), 3)
    return story.format(A=a, B=b, n=n, k=k, j=j, m=rng.choice(["April", "May", "June"]))


def test_reparameterised_questions_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(15)
    items = [(i, told(rng, STORIES[i % 5])) for i in range(5)]
    filler = lambda: " ".join(rng.choice("Many people in the village said that Anna walked to the market with her dog and 12 eggs".split()) for _ in range(60))
    rows = [(i, f"{filler()}. {told(rng, STORIES[i % 5])} {filler()}.") for i in range(50)]
    rows += [(100 + i, items[i][1].lower()) for i in range(5)] + [(200 + i, items[i][1].upper()) for i in range(5)]
    clean = [(1000 + i, f"{filler()}. {filler()}.") for i in range(50)]
    clean += [(2000 + i, " ".join(rng.sample(told(rng, STORIES[i % 5]).split(), 25))) for i in range(20)]
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"]) for r in decontamination.contamination(table(spark, rows + clean), bench).collect()]
    assert len(got) == len(set(got))
    assert sum((d, d % 5) in got for d, _ in rows[:50]) >= 45
    assert all((d, d % 100) in got for d, _ in rows[50:])
    assert all(d < 1000 and (d < 100 or d % 100 == i) for d, i in got)


def windows_by_hand(text, width):
    """Template windows of a text, in both forms, spelled out word by word."""
    import re

    words = re.findall(r"[0-9A-Za-z\u00c0-\u00ff]+", text)
    forms = []
    for names in (False, True):
        out = []
        for i, w in enumerate(words):
            number = any(c.isdigit() for c in w) or w.lower() in decontamination.NUMBERS
            before = i and (any(c.isdigit() for c in words[i - 1]) or words[i - 1].lower() in decontamination.NUMBERS)
            unit = not number and before and w.lower() in decontamination.UNITS
            name = len(w) > 1 and w[0].isupper() and not w.isupper()
            out.append("<n>" if number else "<u>" if unit else "<name>" if names and name else w.lower())
        forms.append(out)
    k = min(width, len(words))
    rows = []
    for i in range(len(words) - k + 1):
        for f in forms[: 1 + (forms[0][i : i + k] != forms[1][i : i + k])]:
            rows.append((i, " ".join(f[i : i + k]), " ".join(words[i : i + k]).lower()))
    return rows


def test_benchmark_windows_by_hand(spark):
    rng = random.Random(16)
    texts = [told(rng, s) for s in STORIES] + ["Été à Paris: 5 km in two hours, IBM paid 3 euros", "one", "Anna", "", None]
    bench = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").withColumn("window", F.lit("clash"))
    got = sorted((r["item_id"], r["at"], r["template"], r["plain"]) for r in decontamination.benchmark_windows(bench).collect())
    assert got == sorted((i, *r) for i, t in enumerate(texts) if t for r in windows_by_hand(t, decontamination.WIDTH))


def test_contamination_of_long_and_repeated_rows(spark):
    rng = random.Random(17)
    item = told(rng, STORIES[0])
    long = ("word " * 60_000) + item + (" other" * 60_000)
    rows = [(1, long), (1, long), (None, item), (2, (item + " ") * 300)]
    bench = spark.createDataFrame([(1, item), (1, told(rng, STORIES[1])), (None, item)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"] or 0) for r in decontamination.contamination(table(spark, rows), bench).collect()))
    assert got == [(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (2, 0), (2, 1)]


def made_pages(rng, host, n, layout, say):
    """Pages of one layout around articles of known text: (url, html, truth)."""
    out = []
    for i in range(n):
        blocks = [say(rng.randint(4, 40)) for _ in range(rng.randint(1, 6))]
        title = say(5)
        paragraphs = "".join(f"<p>{b}</p>" if k % 3 else f"<p>{b.replace(' ', ' <b>', 1)}</b>" for k, b in enumerate(blocks))
        out.append((f"https://{host}/{layout}/{i}", LAYOUTS[layout].format(title=title, text=paragraphs, n=i, other=say(8), name=say(1)), " ".join([title, *blocks])))
    return out


LAYOUTS = {
    "sidebar": '<body class="home has-sidebar"><div id="page"><div class="layout with-sidebar"><article class="post comments-open"><h1>{title}</h1>{text}<section class="comments"><h2>2 comments</h2>'
    "<p>{other} thanks</p></section></article><div class='sidebar'><p>{other}</p></div></div></div><footer>(c) {n}</footer>",
    "main": '<body><header><h2>Site</h2></header><main class="main no-sidebar"><header><h1>{title}</h1><p>by {name}</p></header>{text}<form><label>Your mail</label><input></form></main><nav><a href=x>{other}</a></nav>',
    "plain": "<body><div class=top><a href=/>Home</a> <a href=/a>About</a></div><div class=c1><h1>{title}</h1>{text}<p>Read more of our stories every week in the paper.</p></div>"
    "<div class='cookie-notice'>We use cookies {n}</div>",
    "form": "<body><form id=aspnetForm><div class=holder><h1>{title}</h1>{text}<ul><li><a href=1>{other}</a><li><a href=2>{name} more</a><li><a href=3>{other} again</a></ul></div><div id=search><select><option>x</select></div></form>",
    "table": "<body><table><tr><td class=menu><a href=1>{other}</a></td><td><h1>{title}</h1>{text}</td></tr></table>",
}


def test_html_against_pages_made_around_known_articles(spark):
    rng = random.Random(18)
    vocab = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ana", "olo", "ibe", "upu", "eri", "é")]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    made = [p for layout in LAYOUTS for p in made_pages(rng, f"{layout}.example", 25, layout, say)]
    made += made_pages(rng, "both.example", 20, "sidebar", say) + made_pages(rng, "both.example", 20, "plain", say)  # two layouts of a host
    made += made_pages(rng, "copies.example", 1, "plain", say) * 10  # copies of a page are no template
    made += made_pages(rng, "one.example", 1, "sidebar", say)
    long = " ".join(["long"] * 100_000)
    made.append(("https://sidebar.example/long", LAYOUTS["sidebar"].format(title="T", text=f"<p>{long}", n=1, other="o", name="n"), f"T {long}"))
    df = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(made)], "page_id long, url string, html string").withColumns({"layout": F.lit(1), "key": F.lit("clash"), "rules": F.lit("x")})
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df.repartition(3)).collect()}
    assert len(got) == len(made)
    wrong = [(made[i][0], got[i], t) for i, (_, _, t) in enumerate(made) if got[i] != t and "copies" not in made[i][0]]
    assert not wrong, wrong[:3]
    assert all(got[i].startswith(t) for i, (u, _, t) in enumerate(made) if "copies" in u)


def test_class_words_of_layout_are_no_noise():
    for word in "has-sidebar no-sidebar comments-open with-header category-social related-work entry-header with_widgets navOpen".split():
        assert not html_text.noise_word(word), word
    for word in "ad ads sidebar cookie-notice adBanner widget2 site-header comment-list social_share main-nav".split():
        assert html_text.noise_word(word), word


def test_template_texts_count_articles_not_copies():
    own = [[f"text {i} of this article runs on", "Shared line."] for i in range(6)]
    assert html_text.template_texts(own) == ["Shared line."]
    assert html_text.template_texts([own[0]] * 9 + own[:2]) == []


def test_ftrl_equals_a_plain_loop():
    import math

    import numpy as np

    rng = np.random.default_rng(22)
    rows = [sorted(rng.choice(40, rng.integers(0, 9), replace=False).tolist()) for _ in range(60)]
    f = np.array([x for r in rows for x in r], np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    v, y = rng.random(len(f)) + 0.2, rng.integers(0, 2, 60)
    got = quality.ftrl(f, v, bounds, y, passes=2, seed=3)
    alpha, beta, l1, l2 = 0.3, 1.0, 0.02, 0.1
    z, n, zb, nb = {}, {}, 0.0, 0.0

    def weight(k):
        a = z.get(k, 0.0)
        return 0.0 if abs(a) <= l1 else (math.copysign(l1, a) - a) / ((beta + math.sqrt(n.get(k, 0.0))) / alpha + l2)

    order = np.random.default_rng(3)
    for _ in range(2):
        for i in order.permutation(60):
            xs = list(zip(f[bounds[i] : bounds[i + 1]].tolist(), v[bounds[i] : bounds[i + 1]].tolist(), strict=True))
            bias = -zb / ((beta + math.sqrt(nb)) / alpha)
            g = 1 / (1 + math.exp(-(sum(weight(k) * x for k, x in xs) + bias))) - y[i]
            for k, x in xs:
                w, gx, old = weight(k), g * x, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + gx - (math.sqrt(old + gx * gx) - math.sqrt(old)) / alpha * w
                n[k] = old + gx * gx
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * bias
            nb += g * g
    assert all(abs(got.weights[k] - weight(k)) < 1e-5 for k in range(40)) and abs(got.bias + zb / ((beta + math.sqrt(nb)) / alpha)) < 1e-9


def test_quality_score_is_a_sparse_dot_product(spark):
    import math

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(23)
    model = quality.Model(rng.normal(size=quality.SIZE).astype(np.float32), 0.3)
    texts = ["a b a", "", None, "One TWO %% three", "x " * 50_000, "same", "same"]
    df = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else 5, r["score"]) for r in quality.score(df, model).collect()))
    assert len(got) == len(texts) and got[5][1] == got[6][1]
    for i, s in got:
        f, c, _ = quality.features(pa.array([texts[i]], pa.string()))
        x = [math.log1p(k) for k in c.tolist()]
        norm = max(math.sqrt(sum(a * a for a in x)), quality.LEAST_NORM)
        dot = sum(float(model.weights[k]) * quality.SCALE * a / norm for k, a in zip(f.tolist(), x, strict=True))
        assert abs(s - 1 / (1 + math.exp(-(dot + model.bias)))) < 1e-6
    assert quality.classify(empty(spark), spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 0


def test_nnpu_follows_the_gradient_of_the_estimator():
    """The fit against Adam on finite differences of the non-negative risk, spelled out."""
    import numpy as np

    rng = np.random.default_rng(24)
    n_p, n_u, prior = 40, 120, 0.25
    p = [[k for k in range(3) if rng.random() < 0.7] for _ in range(n_p)]
    u = [[k for k in range(3) if rng.random() < 0.08] + [9] * (rng.random() < 0.5) for _ in range(n_u)]
    flat = lambda rows: (np.array([x for r in rows for x in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]))
    for rounds in (1, 8, 40):
        got = toxicity.nnpu(*flat(p), *flat(u), prior, rounds=rounds)
        dense = lambda rows: np.array([[float(k in r) for k in range(3)] for r in rows])
        xp, xu, w = dense(p), dense(u), np.zeros(4)
        m, s = np.zeros(4), np.zeros(4)

        def parts(w):
            zp, zu = xp @ w[:3] + w[3], xu @ w[:3] + w[3]
            corrected = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            return prior * np.logaddexp(0, -zp).mean(), corrected, 3e-4 / 2 * (w[:3] ** 2).sum()

        def risk(w, up):
            positive, corrected, small = parts(w)
            return (-corrected if up else positive + corrected) + small

        for t in range(1, rounds + 1):
            up = parts(w)[1] < 0
            g = np.array([(risk(w + d, up) - risk(w - d, up)) / 2e-6 for d in np.eye(4) * 1e-6])
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        assert np.allclose([*got.weights[:3], got.bias], w, atol=2e-3)
        assert got.weights[9] == 0  # not a sign of the confirmed texts


def test_labelled_operators_on_odd_rows(spark):
    """Null ids, repeated rows, very long texts, ties and clashing names."""
    rows = [(None, "abc def"), (None, "abc def"), (1, "word " * 60_000), (1, "word " * 60_000), (2, None), (3, ""), (4, "x"), (5, "x")]
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (4, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")
    df = table(spark, rows).withColumns({"f": F.lit(1), "held_out": F.lit("clash"), "label": F.lit(2), "text2": F.lit("z")})
    for out in (toxicity.classify(df, labels), quality.classify(df, labels)):
        got = [tuple(r) for r in out.select("doc_id", "held_out", "score", "predicted").collect()]
        assert len(got) == len(rows) and len({r[2] for r in got if r[0] == 1}) == 1 and len({r[2] for r in got if r[0] in (4, 5)}) == 1
        assert len({r[2] for r in got if r[0] in (2, 3)}) == 1 and all(not r[1] for r in got if r[0] is None)
    said = [tuple(r) for r in language.identify(df).select("doc_id", "held_out", "lang_pred", "score").collect()]
    assert len(said) == len(rows) and {r[2] for r in said if r[0] in (2, 3)} == {"und"} and len({r[2:] for r in said if r[0] == 1}) == 1
    shards = [r.asDict() for r in sharding.shard(df, 3).collect()]
    assert len(shards) == len(rows) and len({r["shard"] for r in shards if r["doc_id"] == 1}) == 1


def test_html_of_very_many_blocks():
    import time

    page = "<body><div class=a><h1>T</h1>" + "".join(f"<p>block {i} runs on</p>" for i in range(30_000)) + "</div>"
    began = time.time()
    text = html_text.extract(page, {})
    assert text.startswith("T block 0 runs on block 1") and text.endswith("block 29999 runs on") and time.time() - began < 20


def test_html_wrappers_see_all_pages_of_a_small_host(spark):
    """Four pages of a host are all in the sample, whatever their hashes: their shared line is a template text in every draw."""
    rng = random.Random(41)
    words = [f"{a}{b}" for a in "bcdfgklmn" for b in ("ana", "olo", "ibe", "upu")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows, bodies = [], {}
    for host in range(12):
        shared = f"Host {host} keeps this line on every page of its own."
        for i in range(4):
            bodies[4 * host + i] = [say(30), say(25), say(28)]
            rows.append((4 * host + i, f"http://h{host}.example/{i}", "<html><body><article>" + "".join(f"<p>{t}</p>" for t in [*bodies[4 * host + i], shared]) + "</article></body></html>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == {k: " ".join(v) for k, v in bodies.items()}


def test_html_sample_is_that_of_the_least_keys(spark):
    pages = [("h", k, f"<html><body><article><p>Some words of page {k} here.</p></article></body></html>") for k in [*range(-40, 40), 3, 3, -7]]
    df = spark.createDataFrame(pages, "host string, key long, html string").repartition(4)
    got = html_text.layouts(df, 5)
    assert got.agg(F.sum("n")).first()[0] == len(pages) and sorted(r["key"] for r in got.select("key").distinct().collect())[:5] == [-40, -39, -38, -37, -36]
    assert got.count() <= 20
