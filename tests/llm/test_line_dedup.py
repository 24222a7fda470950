import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from stopwise.llm import line_dedup as op
from stopwise.llm.common import table

from .helpers import HARD, docs_of


def distance(a, b):
    return op._plain(a, b)


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=30), st.lists(st.tuples(st.integers(0, 30), st.sampled_from("abc-")), max_size=5), st.integers(1, 3))
def test_banded_distance(a, changes, k):
    b = list(a)
    for at, c in changes:
        at = min(at, len(b))
        if c == "-":
            del b[at : at + 1]
        elif at % 2:
            b.insert(at, c)
        else:
            b[at : at + 1] = [c]
    b = "".join(b)
    assert op.within(a, b, k) == (distance(a, b) <= k) == op.within(b, a, k)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=10, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("ab-+")), max_size=2))
def test_close_lines_share_a_key(a, changes):
    b = list(a)
    for at, c in changes:
        at = min(at, len(b))
        if c == "-":
            del b[at : at + 1]
        elif c == "+":
            b.insert(at, "x")
        else:
            b[at : at + 1] = [c]
    b = "".join(b)
    x, y = (set(op.Lines([t], 10).keys(2, 10)[0].tolist()) for t in (a, b))
    assert x & y or op._plain(a, b) > min(2, len(a) // 10, len(b) // 10)


def brute(rows):
    """Classes of lines that aren't blank, by all pairs: an edit for every ten characters of the shorter line, at most two."""
    counts = lambda x: x.strip(" \t\v\f\r")
    lines = [(d is None, d or 0, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if counts(line)]
    distinct = sorted({x[-1] for x in lines}, key=len)
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(distinct)):
        for j in range(i - 1, -1, -1):
            most = min(2, len(distinct[j]) // 10)
            if not most or len(distinct[i]) - len(distinct[j]) > 2:
                break
            if op.sketch(distinct[i]).__xor__(op.sketch(distinct[j])).bit_count() <= 8 and op.within(distinct[i], distinct[j], most):
                root[find(i)] = find(j)
    of = {x: find(i) for i, x in enumerate(distinct)}
    first = {}
    for x in sorted(lines):
        first.setdefault(of[x[-1]], x[:3])
    out = []
    for d, t in rows:
        kept = [x for i, x in enumerate((t or "").split("\n")) if not counts(x) or first[of[x]] == (d is None, d or 0, i)]
        n = len((t or "").split("\n"))
        out.append((d, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    from pyspark.sql import functions as F

    out = op.line_dedup(df).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256))
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_hard_rows_and_empty_table(spark):
    rows = [r for r in HARD if r[0] is not None] + [(50, "the cat sat on the mat and then it ran far awey\nshort\nthe cat sat on a mat and then it ran far away")]
    assert found(docs_of(spark, rows)) == brute([r[:2] for r in rows])
    assert found(docs_of(spark, [])) == []
    only_null = found(docs_of(spark, [(None, "a line that is long enough"), (3, "a line that is long enough")]))
    assert [(r[0], r[2]) for r in only_null] == [(3, 0), (None, 1)]


def test_whole_table_like_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert found(docs_of(spark, rows)) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 40), st.sampled_from("abc-+")), max_size=2))
def test_sketch_allows_for_edits(a, changes):
    b = list(a)
    for at, c in changes:
        b[at : at + (c != "+")] = [] if c == "-" else [c]
    b = "".join(b)
    assert op._plain(a, b) > 2 or (op.sketch(a) ^ op.sketch(b)).bit_count() <= 8


def test_lines_with_one_rolling_hash_stay_apart(spark):
    """Thue-Morse lines over a and b and their complements have equal polynomial hashes modulo 2 ** 64."""
    rows = []
    for k, n in enumerate((1024, 2048, 4096)):
        one = "".join("ab"[i.bit_count() & 1] for i in range(n))
        rows += [(3 * k, one), (3 * k + 1, one.translate(str.maketrans("ab", "ba"))), (3 * k + 2, one)]
    lines = op.Lines([t for _, t in rows], 10).line.tolist()
    assert len(set(lines)) < 6
    assert [(d, gone) for d, _, gone, _ in sorted(found(docs_of(spark, rows)))] == [(d, int(d % 3 == 2)) for d, _ in rows]


def test_lines_with_one_rolling_hash_keep_their_links(spark):
    """Both of two such lines in one slice have near ones of their own."""
    one = "".join("ab"[i.bit_count() & 1] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    assert len(set(op.Lines([one, two], 10).line.tolist())) == 1
    near = {5: one[:700] + "x" + one[700:], 6: two[:900] + "y" + two[901:]}
    rows = [(1, f"{one}\n{two}"), *near.items()]
    assert [(d, gone) for d, _, gone, _ in sorted(found(docs_of(spark, rows)))] == [(1, 0), (5, 1), (6, 1)]


def test_edits_by_length(spark):
    """One edit for every ten characters of the shorter line, at most two; blank lines stay whatever their length."""
    pairs = [("nine char", "nine chax", 0), ("ten chars.", "ten chars!", 1), ("ten chars.", "ten charss.", 1), ("nine char", "nine chars", 0),
             ("nineteen characters", "nineteen charakterz", 0), ("nineteen characters", "nineteen charakters", 1),
             ("twenty characters ab", "twenty charakters aB", 1), ("nineteen characters", "nineteen charakters.", 0), (" " * 40, " " * 40, 0)]
    for a, b, gone in pairs:
        assert [r[2] for r in brute([(1, a), (2, b)])] == [0, gone]
    for a, b, gone in pairs:
        assert [r[2] for r in found(docs_of(spark, [(1, a), (2, b)]))] == [0, gone], (a, b)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    names = ("n_lines", "n_removed", "digest", "line", "text_key", "removed", "d", "t", "k0", "class", "place", "root", "set")
    df = docs_of(spark, [(1, "a line that is long enough"), (2, "a line that is long enough")]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = op.line_dedup(df, keep=("lang", *names))
    assert out.columns == ["doc_id", "lang", *names[2:], "text", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.n_lines, r.n_removed, r.d) for r in out.collect()) == [(1, 1, 0, 6), (2, 1, 1, 6)]


def test_crowded_keys(spark):
    rng = np.random.default_rng(4)
    head = "one segment that very many lines hold unchanged "
    rows = [(i, head + "".join(rng.choice(list("abcdefgh"), 24))) for i in range(300)]
    rows += [(1000 + i, rows[i][1][:-1] + "z") for i in range(0, 300, 3)]
    df = docs_of(spark, rows)
    links = op.line_links(df.select("text"), 2, 10, block=20, share=1).count()
    assert links == 100
    assert sum(r[2] for r in found(df)) == 100
