import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from stopwise.llm import collocations as op
from stopwise.llm.common import stash, table

from .helpers import HARD, docs_of, duck, spark_rows


def brute(rows, least, longest=5, top=2000):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = tuple(w for w in re.split("[ \t]+", piece) if w)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                count[lang or "und"].update(words[i : i + k] for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        lost = {p[i : i + k] for p, b in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 100 * f[p[i : i + k]]}
        found = []
        for p in good.keys() - lost:
            score, cut = min((1000 * f[p] * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -f[p], " ".join(p).encode(), f[p[:cut]], f[p[cut:]], cut))
        for rank, (score, a, p, left, right, cut) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score, cut))
    return sorted(out)


def check(docs, least, **how):
    want = brute([(r.text, r.lang) for r in docs.collect()], least, **{k: v for k, v in how.items() if k != "shard_bytes"})
    got = sorted(tuple(r) for r in op.collocations(docs, least, **how).collect())
    assert got == want
    return len(got)


def test_query_equals_sql(spark, sf_dir):
    assert spark_rows(op.query(spark, sf_dir)) == duck(op.ORACLE, documents=f"{sf_dir}/documents.parquet")


def test_rare_phrases_of_the_whole_table(spark, sf_dir):
    assert check(table(spark, sf_dir, "documents").repartition(3), 7, shard_bytes=50_000) > 100


def test_hard_rows(spark):
    more = [(50 + i, t, lang) for i, (t, lang) in enumerate([
        ("a a a a a a a a. a a, a", "en"), ("A\tb  c;a B c!a b C? a\vb\fc\rd\na b", None), ("a b c a b c a b c", "und"), ("É é É é é. É é", "fr"),
        ("x y z x y z x y z", "fr"), ("nul\0 byte nul\0 byte nul\0 byte", "fr"), ("....,,,;;", "de"), ("one", "de"),
    ])]
    docs = docs_of(spark, [*HARD, *more])
    assert check(docs, 2) > 0
    check(docs, 2, shard_bytes=100)
    check(docs, 3, longest=2, top=3)
    check(docs, 1, longest=4)


def test_empty_table_and_clashing_names(spark):
    from pyspark.sql import functions as F

    assert op.collocations(docs_of(spark, [])).collect() == []
    assert op.collocations(docs_of(spark, [(1, None), (2, "... , ")])).collect() == []
    df = docs_of(spark, [(1, "p q " * 9)]).select("*", *[F.lit("?").alias(c) for c in ("phrase", "a", "n", "l", "r", "w", "p", "id", "shard", "uri", "at")])
    check(df, 3)


def test_shards_get_frequent_phrases_back_without_a_join(spark, monkeypatch):
    plans = []

    def noted(df, tag, *how):
        if tag == "phrase-steps":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stash(df, tag, *how)

    monkeypatch.setattr(op, "stash", noted)
    check(docs_of(spark, [(i, f"a b c d e {i % 3}. b c d", None if i % 2 else "en") for i in range(40)]), 5, shard_bytes=100)
    assert len(plans) == 4 and not any("Join" in p for p in plans)


def test_counts_of_phrases_over_shards(spark):
    most = (1 << 31) - 1
    rows = [(shard, at << 32 | n, p, w, None) for shard, at, n, p, w in [
        (0, 0, 3, 7, 1), (1, most, 3, 7, 1), (2, 5, 4, 7, 1), (0, 3, 9, 7, 2), (1, 0, most, 8, 1), (2, 9, most, 8, 1), (2, 4, 10, 1, 7),
    ]]
    files = [(s, -1, -1, -1 - s, f"file{s}") for s in range(3)]
    got = op._counted(spark.createDataFrame(rows + files, op.STEP).repartition(4), 10).collect()
    assert sorted((r.shard, r.uri) for r in got if r.uri) == [(s, f"file{s}") for s in range(3)]
    got = [r for r in got if not r.uri]
    assert sorted((r.p, r.w, r.shard, r.place, r.a) for r in got) == sorted((p, w, s, x, {(7, 1): 10, (8, 1): 2 * most, (1, 7): 10}[p, w]) for s, x, p, w, _ in rows if (p, w) != (7, 2))
    assert len({(r.p, r.w, r.id) for r in got}) == len({r.id for r in got}) == 3
    assert sorted((r.p, r.w) for r in got if r.first) == [(1, 7), (7, 1), (8, 1)]


def rows_of_python_nodes(spark, work):
    """Rows that each Python node made, in order, as ``work`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    drained = lambda: spark._jsc.sc().listenerBus().waitUntilEmpty(60_000)
    drained()
    before = store.executionsCount()
    work()
    drained()
    made = []
    for run in listed(store.executionsList())[before:]:
        metrics = store.executionMetrics(run.executionId())
        for node in listed(store.planGraph(run.executionId()).allNodes().toSeq()):
            if "InArrow" in node.name():
                found = [metrics.get(m.accumulatorId()) for m in listed(node.metrics()) if m.name() == "number of output rows"]
                made += [int(x.get().replace(",", "")) for x in found if x.isDefined()]
    return made


def test_rows_follow_the_input_when_phrases_become_frequent(spark):
    """Of 20 words two stand side by side some 5 times in 2000 words, which is rare, and 25 times in 10000, which is not."""
    rng = np.random.default_rng(5)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 20, 500)) for _ in range(20)]
    small, large = (
        rows_of_python_nodes(spark, lambda n=n: check(docs_of(spark, list(enumerate(text[:n]))).coalesce(1), 15, shard_bytes=4000)) for n in (4, 20)
    )
    assert len(small) == len(large) and max(large) >= 8000
    assert all(b <= 6 * a + 1000 for a, b in zip(small, large)), (small, large)


@pytest.mark.parametrize("symbols, ids, columns", [(3, 3, 1), (300, 1 << 20, 2), (30, 1 << 29, 3), (30, 1 << 39, 5)])
def test_windows_hold_every_phrase(symbols, ids, columns):
    """A window for each word at most; sorted and cut anywhere, their runs give every frequent phrase its number."""
    rng = np.random.default_rng(symbols)
    words = np.append(rng.integers(0, symbols, 3000) * (rng.random(3000) < 0.9), 0).astype(np.int32)
    ident = rng.choice(ids, int(words.max()), replace=False) if ids <= 1 << 20 else ids - 1 - np.arange(int(words.max()))
    keys = op.Keys(ids, 5)
    assert len(keys.columns) == columns
    found = list(op.windows(op.Index.of(words), ident, keys))
    held = [np.concatenate(c) for c in zip(*(c for c, _ in found))]
    n = np.concatenate([n for _, n in found])
    assert len(n) <= np.count_nonzero(words) and n.min() > 0
    order = np.lexsort(held[::-1])
    held, n = [c[order] for c in held], n[order]
    want = Counter(tuple(int(ident[x - 1]) for x in words[i : i + k]) for k in range(2, 6) for i in range(len(words) - k + 1) if words[i : i + k].all())
    for least in (1, 4):
        got, given = Counter(), 0
        cuts = [0, *sorted(rng.integers(0, len(n), 5).tolist()), len(n)]
        for a, b in zip(cuts, cuts[1:]):  # a task's range, in batches
            batches = (([c[i : min(i + 7, b)] for c in held], n[i : min(i + 7, b)]) for i in range(a, b, 7))
            for ids, number in op.runs(batches, keys, least):
                given += int((number < least).sum())
                for p, x in zip(ids.tolist(), number.tolist()):
                    got[tuple(p)] += x
        assert {p: a for p, a in got.items() if a >= least} == {p: a for p, a in want.items() if a >= least}
        assert given <= 8 * len(cuts)


def test_numbers_beyond_one_part():
    keys = op.Keys(3, 5)
    column = np.zeros(2, np.int64)
    for k, word in enumerate((2, 0)):
        column += keys.put(np.array([word, word]), k)[1]
    got = list(op.runs(iter([([column], np.array([1 << 40, 1 << 41]))]), keys, 100))
    assert [(ids.tolist(), n.tolist()) for ids, n in got] == [([[2, 0]], [3 << 40])]


def test_lengths_are_bounded(spark):
    for longest in (1, 6):
        with pytest.raises(ValueError):
            op.collocations(docs_of(spark, []), longest=longest)


@pytest.mark.parametrize("symbols", [2, 40, 5000])
def test_index_counts_every_phrase(symbols):
    """Intervals of an index, extended again and again, hold as many places as the phrase has occurrences."""
    rng = np.random.default_rng(symbols)
    words = np.append(rng.integers(0, symbols, 3000), 0).astype(np.int32)
    index = op.Index.of(words)
    n = np.bincount(words)
    at, count = (np.cumsum(n) - n)[1:], n[1:]
    phrases = [(int(s),) for s in range(1, len(n))]
    for k in range(2, 6):
        at, count, parent, symbol = index.extended(at, count)
        phrases = [(*phrases[p], int(s)) for p, s in zip(parent, symbol)]
        want = Counter(tuple(int(x) for x in words[i : i + k]) for i in range(len(words) - k + 1) if words[i : i + k].all())
        assert dict(zip(phrases, count.tolist())) == want and len(phrases) == len(want)


def test_numbers_give_the_words_back():
    data = "The  cat, the\tCAT;\n\n. sat".encode()
    found, words = op.numbers(data)
    assert [words[int(i) - 1].as_py().decode() if i else "|" for i in found] == ["|", "the", "cat", "|", "the", "cat", "|", "sat", "|"][: len(found)]
    assert op.numbers(b"")[0].tolist() == [0]
    assert b"".join(op.pieces_of(b"ab.cd,ef gh ij", 3)) == b"ab.cd,ef gh ij" and len(list(op.pieces_of(b"ab.cd,ef gh ij", 3))) > 1
