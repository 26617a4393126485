import random
from collections import defaultdict

import corpus_pipeline
from cloudweave.llm import rules, simhash, toxicity
from test_simhash import plain_components


def documents():
    rng = random.Random(0)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    bad = ["vilename", "rottenest", "rottenly", "rottenish", "rottenful"]
    rows, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(rng.randint(60, 200))]
        toxic = i % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), "en", f"h{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    for i in range(60):
        words = rows[1 + i % 7][1].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words), "en", "h9", 0))
    rows += [(2000, "short text", "en", "h1", 0), (2001, "# $ % " * 100 + "a b c d " * 5, "en", "h1", 0), (2002, None, None, None, None), (2003, "", "en", "h1", 0), (7, rows[7][1], "en", "h3", 0)]
    return rows, labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, labels = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    one = corpus_pipeline.clean(spark, docs, str(tmp_path))
    assert one.schema == docs.schema
    bad = {r[0] for r in rows if r[1] and ("vile" in r[1] or "rotten" in r[1])}
    assert sorted(r.doc_id for r in one.collect()) == sorted(r[0] for r in rows if r[0] not in bad)
    two = corpus_pipeline.good(spark, one, str(tmp_path))
    assert two.schema == docs.schema
    left = [r for r in rows if r[0] not in bad and r[0] < 2000]
    assert sorted(r.doc_id for r in two.collect()) == sorted(r[0] for r in left)
    three = corpus_pipeline.distinct(spark, two, str(tmp_path))
    assert three.schema == docs.schema
    want = sorted({c for _, _, c in plain_components([r[:2] for r in left])})
    assert sorted(r.doc_id for r in three.collect()) == want
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r.doc_id].append((r.start, r.length, r.doc_tokens))
    assert sorted(got) == want
    assert all(sum(n for _, n, _ in p) == p[0][2] for p in got.values())


def test_empty_tables(spark, tmp_path):
    rows, labels = documents()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_that_clash_go_along(spark, tmp_path):
    rows, labels = documents()
    extra = "kept string, id long, _bad string, n_words string, _host string, fp string, text_key string, held_out int"
    docs = spark.createDataFrame([(*r, "k", 5, "b", "w", "h", "f", "t", 3) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert {tuple(r)[5:] for r in docs.collect()} == {("k", 5, "b", "w", "h", "f", "t", 3)}
    assert docs.count() == docs.select("doc_id").distinct().count() > 100 and corpus_pipeline.packed(spark, docs, "").count() > 0


def test_one_of_each_with_nulls(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (4, "A b c"), (None, "other words here now"), (None, "other words here now"), (4, "A b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in simhash.one_of_each(docs).collect())
    assert got == [(0, "other words here now"), (4, "A b c")]
