"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages_keep_columns_and_drop_planted_cases(spark, tmp_path):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("ana", "olo", "ibe", "upu", "eri")]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    item = " ".join(say(25))
    rows, labels, junk, toxic = [], [], set(), set()
    for i in range(500):
        w = say(rng.randint(20, 60))
        if i % 10 == 3:
            w[5] = "gromtar"
            toxic.add(i)
        if i % 10 == 6:
            w = [x + "%%%" for x in w]
            junk.add(i)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i not in junk), int(i in toxic)))
    rows += [(600, rows[0][1]), (601, rows[0][1].replace(rows[0][1].split()[0], "bana", 1)), (602, " ".join(say(20)) + " " + item + " " + " ".join(say(20))), (603, None), (604, "")]
    leak = " ".join(say(20)) + " " + item + " " + " ".join(say(20))
    bare = {"toxic": " ".join([*say(20), "gromtar", *say(20)]), "junk": " ".join(x + "%%%" for x in say(40)), "copy": rows[1][1], "leak": leak, "twice": " ".join(say(40)), "clean": " ".join(say(40))}
    rows += [(None, t) for name, t in bare.items() for _ in range(1 + (name == "twice"))] + [(605, " ".join(say(60_000)))]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept, without_id, names = {}, {}, {t: name for name, t in bare.items()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").where("doc_id IS NOT NULL").collect()}
        without_id[name] = sorted(names[r["text"]] for r in docs.where("doc_id IS NULL").collect())
    assert without_id["toxicity"] == ["clean", "copy", "junk", "leak", "twice", "twice"]
    assert without_id["quality_classifier"] == ["clean", "copy", "leak", "twice", "twice"]
    assert without_id["ngram_jaccard_join"] == ["clean", "leak", "twice"] and 1 in kept["ngram_jaccard_join"]
    assert without_id["benchmark_decontamination"] == ["clean", "twice"] and 605 in kept["benchmark_decontamination"]
    every = {i for i, _ in rows if i is not None}
    assert len((every - kept["toxicity"]) ^ toxic) <= 3
    assert len((kept["toxicity"] - kept["quality_classifier"]) ^ (junk & kept["toxicity"])) <= 3
    assert kept["quality_classifier"] - kept["ngram_jaccard_join"] >= {600} and 0 in kept["ngram_jaccard_join"]
    assert kept["ngram_jaccard_join"] - kept["benchmark_decontamination"] == {602}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {None} | kept["benchmark_decontamination"] and {603, 604} <= kept["benchmark_decontamination"]


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    d = str(tmp_path)
    shape = "doc_id long, text string, lang string, source string, n_chars long, score string, uid long, window string, label int"
    spark.createDataFrame([], shape).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0
    rows = [(1, "a b c d e f", "en", "s", 11, "x", 5, "w", 3), (2, "a b c d e f", "en", "s", 11, "x", 5, "w", 3), (3, None, None, None, None, None, None, None, None), (None, "lone", "en", "s", 4, "x", 5, "w", 3)]
    docs = spark.createDataFrame(rows, shape)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), shape)
    assert sorted((r["doc_id"] or 0 for r in docs.collect())) == [0, 1, 3]
