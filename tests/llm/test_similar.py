import random

import corpus_pipeline
from cloudweave.llm import similar


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def plain_kept(rows):
    sets, group, changed = [shingles(t) for _, t in rows], list(range(len(rows))), True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if group[j] > group[i] and 10 * len(a & b) >= 8 * len(a | b):
                    group[j], changed = group[i], True
    return sorted(min(d for (d, _), h in zip(rows, group) if h == g) for g in set(group))


def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(30):
        text = [rng.choice(words) for _ in range(rng.randint(30, 200))]
        rows.append((100 * i, " ".join(text)))
        for j in range(1, 8):  # a chain: each copy is changed once more
            text[rng.randrange(len(text))] = "changed"
            rows.append((100 * i + j, " ".join(text)))
    return [*rows, (9000, ""), (9001, None), (9002, "one two"), (9003, "One  two")]


def test_five_word_similarity_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.dissimilar(spark, docs, "").collect()) == want
    # op4's two bits leave many of them in
    assert corpus_pipeline.distinct(spark, docs, "").count() > len(want) + 50


def test_torn_clusters_are_mended():
    rng = random.Random(3)
    rows = texts()
    sets = [similar.grams(t) for _, t in rows]
    found = similar.joins(list(range(len(rows))), list(range(len(rows))), sets, 0.8)
    lead = list(range(len(rows)))
    for a, b in rng.sample(found, len(found)):
        lead = [lead[a] if g == lead[b] else g for g in lead]
    assert len(set(lead)) == len(plain_kept(rows))


def test_clusters_of_any_size_are_mended_in_blocks(spark):
    rows = texts()
    sets = {i: [h - (1 << 64) if h >> 63 else h for h in similar.grams(t).tolist()] for i, (_, t) in enumerate(rows)}
    # one cluster of all texts: a large piece (every chain's even copies are linked to the first), the rest alone
    piece = {i: -1 if i % 8 == 0 and i < 240 else i for i in sets}
    table = spark.createDataFrame([(7, piece[i], i, g) for i, g in sets.items()], "cluster long, piece long, fp long, grams array<long>")
    want = {frozenset(p) for i in sets for j in sets if i < j and piece[i] != piece[j] and 10 * len(set(sets[i]) & set(sets[j])) >= 8 * len(set(sets[i]) | set(sets[j])) for p in [(piece[i], piece[j])]}

    def pieces(links):
        lead = {p: p for p in piece.values()}
        for a, b in links:
            lead = {p: lead[a] if g == lead[b] else g for p, g in lead.items()}
        return {frozenset(p for p in lead if lead[p] == g) for g in lead.values()}

    for cell in (1000, 10**9):
        dealt = similar.cells(table, cell)
        assert (dealt.select("cell").distinct().count() > 100) == (cell == 1000)
        assert pieces((piece[r.a], piece[r.b]) for r in similar.mend(table, 0.8, cell).collect()) == pieces(map(tuple, want))
    assert similar.mend(table.where("piece = -1")).count() == 0


def test_shingle_and_similarity_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g x"), (2, "a b c d e f g x"), (None, "a b c d e f g h")], "doc_id long, text string")
    assert [r.doc_id for r in similar.one_of_each(docs, shingle=1, similarity=0.7).collect()] == [1]
    assert sorted(r.doc_id for r in similar.one_of_each(docs).collect()) == [1, 2]
    assert similar.one_of_each(docs.limit(0)).count() == 0
