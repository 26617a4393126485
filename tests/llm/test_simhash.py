import re
import random

import xxhash

from cloudweave.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [(d, plain_fingerprint(t)) for d, t in rows]
    group = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and group[j] > group[i]:
                    group[j], changed = group[i], True
    least = {g: min((d for (d, _), h in zip(prints, group) if h == g and d is not None), default=None) for g in set(group)}
    return sorted(((d, f"{f:016x}", least[g]) for (d, f), g in zip(prints, group)), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha Beta gamma DELTA epsilon zeta".split()) for _ in range(rng.randint(0, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        if words and i % 3:
            words[rng.randrange(len(words))] = rng.choice(["eta", "theta", "É"])
        rows.append((100 + i, "\t".join(words)))
    rows += [(300, None), (301, ""), (302, " \n\x0b"), (303, "one"), (303, "one"), (None, "one two"), (304, "x\xa0y z"), (305, "long " * 30000)]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_components(rows)


def test_links_chain_of_prints(spark):
    prints = [0, 3, 15, 1 << 63, (1 << 63) - 1, 0xFF00]
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in [(0, 3), (3, 15), (0, -(1 << 63))]}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
