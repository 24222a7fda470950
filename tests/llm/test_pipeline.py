from collections import defaultdict

import corpus_pipeline as pipe
from stopwise.llm.common import table

from .helpers import HARD, docs_of

LONG = "the quick brown fox jumps over the lazy dog while nobody looks at it and then goes home again"


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    kept = pipe.by_language(spark, docs, sf_dir)
    assert kept.columns == list(pipe.COLUMNS)
    assert kept.count() >= 0.97 * n
    lines = pipe.without_repeated_lines(spark, kept, sf_dir)
    assert lines.columns == list(pipe.COLUMNS)
    seen = defaultdict(int)
    for r in lines.collect():
        assert r.n_chars == len(r.text)
        for x in r.text.split("\n"):
            seen[x] += len(x) >= 20
    assert max(seen.values()) == 1


def test_near_copies_keep_one(spark):
    near = LONG + " the end"
    rows = [(5, LONG), (3, LONG.upper()), (9, LONG), (9, LONG), (1, "something else altogether, with words of its own"), (2, None), (4, ""), (7, near * 20), (8, near * 20)]
    got = sorted((r.doc_id, r.text) for r in pipe.without_near_copies(spark, docs_of(spark, rows), "").collect())
    assert [d for d, _ in got] == [1, 2, 3, 7]
    again = pipe.without_near_copies(spark, docs_of(spark, [(1, LONG), (1, LONG), (None, "x y z w v"), (None, "x y z w v")]), "").collect()
    assert sorted(str(r.doc_id) for r in again) == ["1", "None"]


def test_mix_repeats_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = pipe.mixed(spark, docs, sf_dir)
    words = sum(len(r.text.encode().split()) for r in out.collect())
    total = sum(len(r.text.encode().split()) for r in docs.collect())
    assert out.columns == docs.columns and 1.4 * total < words < 1.8 * total


def test_hard_rows_through_all_stages(spark, sf_dir):
    df = docs_of(spark, [*HARD, (30, "the mat and the cat are here with us for the day and they were not there then", "en", "a")])
    for _, stage in pipe.STAGES[:-1]:
        df = stage(spark, df, sf_dir)
        assert df.columns == list(pipe.COLUMNS)
    packed = pipe.packed(spark, df, sf_dir)
    assert packed.count() >= df.count() > 0


def test_empty_tables_through_all_stages(spark, sf_dir):
    for _, stage in pipe.STAGES:
        assert stage(spark, docs_of(spark, []), sf_dir).count() == 0


def test_clashing_names_through_all_stages(spark, sf_dir):
    from pyspark.sql import functions as F

    names = ("lang_pred", "score", "n_lines", "n_removed", "copies", "nth", "d", "t", "k", "key", "size", "piece", "length")
    text = "the mat and the cat are here with us for the day and they were not there then"
    df = docs_of(spark, [(i, f"{text} {i}", "en", "a") for i in range(30)]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    for _, stage in pipe.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == list(pipe.COLUMNS) and out.count() > 0
    assert pipe.packed(spark, df, sf_dir).count() == 30


def test_run(spark, sf_dir):
    rows = pipe.run(spark, sf_dir).collect()
    used = defaultdict(int)
    for r in rows:
        used[r.sequence_id] += r.length
    assert rows and max(used.values()) <= 2048


def test_stages_like_brute_force(spark, sf_dir, tmp_path):
    """Each stage on what the one before kept, against definitions written out in other tests."""
    import hashlib
    from collections import Counter

    from stopwise.llm import source_mix

    from . import test_line_dedup, test_packing, test_shingle_dedup
    from .helpers import duck

    start = table(spark, sf_dir, "documents").where("length(text) < 3000").orderBy("doc_id").limit(60)
    docs = docs_of(spark, [(r.doc_id, r.text, r.lang, r.source) for r in start.collect()])

    lines = pipe.without_repeated_lines(spark, docs, sf_dir).collect()
    want = {d: (gone, sha) for d, _, gone, sha in test_line_dedup.brute([(r.doc_id, r.text) for r in docs.collect()])}
    got = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in lines}
    assert all(want[d][1] == sha for d, sha in got.items())
    blank = {hashlib.sha256(("\n" * k).encode()).hexdigest() for k in range(50)}
    assert all(want[d][0] > 0 and want[d][1] in blank for d in want.keys() - got.keys())

    docs = docs_of(spark, [(r.doc_id, r.text, r.lang, r.source) for r in lines])
    near = pipe.without_near_copies(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id for r in near), key=str) == test_shingle_dedup.brute([(r.doc_id, r.text) for r in lines])

    docs = docs_of(spark, [(r.doc_id, r.text, r.lang, r.source) for r in near])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names, rows = duck(source_mix.ORACLE, documents=f"{tmp_path}/documents.parquet/*.parquet", labels=f"{sf_dir}/labels.parquet")
    copies = {r[names.index("doc_id")]: r[names.index("copies")] for r in rows if r[names.index("copies")]}
    again = pipe.mixed(spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in again) == copies

    docs = docs_of(spark, [(r.doc_id, r.text, r.lang, r.source) for r in again])
    test_packing.check(spark, docs)
    assert pipe.packed(spark, docs, sf_dir).count() >= len(again)


def test_near_copies_are_compared_before_their_lines_go(spark, sf_dir):
    """Two long texts that differ in a line: the near-dup stage takes one, whatever stages run before it."""
    lines = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(30)]
    rows = [(1, "\n".join(lines), "en", "a"), (2, "\n".join([*lines[:-1], "a last line of its own with other words in it"]), "en", "a")]
    docs = docs_of(spark, rows)
    for name, stage in pipe.STAGES[1:]:
        if stage is pipe.without_near_copies:
            break
        docs = stage(spark, docs, sf_dir)
    assert [r.doc_id for r in pipe.without_near_copies(spark, docs, sf_dir).collect()] == [1]


def test_copies_that_only_show_once_their_lines_are_gone(spark, sf_dir):
    """Two texts under different long lines that a third one holds: no near copies as they are, and near copies without these lines."""
    one, two, core = ([f"{c}{i}" for i in range(100)] for c in "abc")
    text = lambda *lines: "\n".join(" ".join(words) for words in lines)
    rows = [(1, text(one, two), "en", "a"), (2, text(one, core), "en", "a"), (3, text(two, [*core[:-1], "elsewhere"]), "en", "a")]
    docs = docs_of(spark, rows)
    assert pipe.without_near_copies(spark, docs, sf_dir).count() == 3
    for name, stage in pipe.STAGES[1 : [stage for _, stage in pipe.STAGES].index(pipe.mixed)]:
        docs = stage(spark, docs, sf_dir)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(1, rows[0][1]), (2, text(core))]
    assert pipe.without_near_copies(spark, docs, sf_dir).count() == pipe.without_repeated_lines(spark, docs, sf_dir).count() == 2
