import random
from collections import defaultdict

import corpus_pipeline as pipe
from stopwise.llm import shingle_dedup as op
from stopwise.llm.common import table

from .helpers import HARD, docs_of


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    """Ids that stay: all pairs by five-word Jaccard similarity, linked ones through others too."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[find(i)].append((d is None, d))
    return sorted((min(m)[1] for m in members.values()), key=str)


def edited(rows, rng, most):
    """Each text again with up to ``most`` words replaced, so that similarities fall on both sides of 4/5."""
    out = list(rows)
    for d, t in rows:
        words = t.split()
        for _ in range(rng.randint(1, most)):
            words[rng.randrange(len(words))] = rng.choice("uvwxyz")
        out.append((d + 100_000, " ".join(words)))
    return out


def found(spark, rows):
    return sorted((r.doc_id for r in pipe.without_near_copies(spark, docs_of(spark, rows), "").collect()), key=str)


def test_edited_copies_like_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("length(text) between 200 and 3000").orderBy("doc_id").limit(80)
    rows = edited([(r.doc_id, r.text) for r in docs.collect()], random.Random(1), 6)
    want = brute(rows)
    assert 80 < len(want) < 160
    assert found(spark, rows) == want


def test_hard_rows_and_empty_table(spark):
    assert found(spark, HARD) == brute([r[:2] for r in HARD])
    assert found(spark, []) == []


def test_crowded_keys_and_common_shingles(spark):
    rng = random.Random(2)
    head = "one passage that very many texts hold unchanged and that is no reason to link them".split()
    rows = [(i, " ".join(head + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 4))])) for i in range(200)]
    docs = docs_of(spark, rows)
    rows_, named = op.classes(docs, block=16, share=1)
    roots = {r.fp: r.root for r in named.collect()}
    assert len({roots[r.fp] for r in rows_.collect()}) == len(brute(rows))


def test_groups_whose_least_member_is_not_near_all(spark):
    """Chains of copies, each some words further: all are linked through others only."""
    rng = random.Random(3)
    rows = []
    for g in range(3):
        words = [f"g{g}w{i}" for i in range(60)]
        for i in range(25):
            rows.append((100 * g + i, " ".join(words)))
            words = words[1:] + [f"g{g}n{rng.randrange(10**6)}"] if i % 2 else words[:30] + [f"g{g}m{i}"] + words[31:]
    assert found(spark, rows) == brute(rows)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    from stopwise.llm.simhash_dedup import keep_one

    text = "one two three four five six seven"
    names = ("_key", "_d", "_t", "key", "d", "t", "fp", "root", "k0", "text_key", "name")
    df = docs_of(spark, [(2, text), (1, text), (3, None)]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = keep_one(df, op.classes)
    assert out.columns == df.columns and sorted((r.doc_id, r._d, r.name) for r in out.collect()) == [(1, 1, 10), (3, 1, 10)]


def test_without_simhash_the_same_stay(spark, sf_dir):
    from functools import partial

    from stopwise.llm.simhash_dedup import keep_one

    docs = table(spark, sf_dir, "documents").where("length(text) between 200 and 3000").orderBy("doc_id").limit(40)
    rows = edited([(r.doc_id, r.text) for r in docs.collect()], random.Random(4), 6) + [(900_000 + i, r[1]) for i, r in enumerate(HARD)]
    got = keep_one(docs_of(spark, rows), partial(op.classes, simhash=False)).collect()
    assert sorted((r.doc_id for r in got), key=str) == brute(rows)
