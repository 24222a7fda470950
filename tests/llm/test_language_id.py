import zlib

from stopwise.llm import language_id as op
from stopwise.llm.common import table

from .helpers import HARD, docs_of


def test_held_out_accuracy(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    rows = op.query(spark, sf_dir).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_hard_rows_and_empty_table(spark, sf_dir):
    from collections import Counter

    model = op.train(table(spark, sf_dir, "documents"), per_language=20, landmarks=16)
    got = op.identify(docs_of(spark, HARD), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in HARD)
    for d, text, *_ in HARD:
        same = {(r.lang_pred, r.score) for r in got if r.doc_id == d}
        assert len(same) == 1  # repeated rows are answered alike
        lang, score = same.pop()
        letters = any(c.isalpha() for c in text or "")
        assert (lang == "und") == (not letters) and (letters or score == 0) and 0 <= score <= 1
    assert op.identify(docs_of(spark, []), model).count() == 0
    none = op.train(docs_of(spark, [(1, "abc", None), (2, None, "en"), (None, "abc", "en")]))
    assert none is None and op.identify(docs_of(spark, HARD[:1]), none).first().lang_pred == "und"


def grams(text):
    """1-, 2- and 3-grams as strings, by the definition."""
    s, out = "", set()
    for c in f" {text.lower()} ":
        s += c if c.isalpha() else "" if s.endswith(" ") else " "
    for n in (1, 2, 3):
        out |= {s[i : i + n] for i in range(len(s) - n + 1)}
    return out - {" "}


def test_like_plain_kernel_ridge_regression(spark, sf_dir):
    """Whole table against dictionaries of n-grams and pseudo-inverses."""
    import numpy as np

    rows = table(spark, sf_dir, "documents").collect()
    usable = {(r.doc_id, r.text, r.lang) for r in rows if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 5 and len(r.text.encode()) <= op.TEXT_BYTES}
    train = sorted((zlib.crc32(t.encode()), t, lang) for _, t, lang in usable if any(map(str.isalpha, t)))
    sets = [grams(t) for _, t, _ in train]
    names = sorted({x for *_, x in train})
    turns, turn = {}, []
    for *_, lang in train:
        turn.append((turns.setdefault(lang, 0), lang))
        turns[lang] += 1
    marks = [sets[i] for i in sorted(range(len(train)), key=turn.__getitem__)[:128]]
    k = lambda xs: np.array([[len(a & b) / (len(a) * len(b)) ** 0.5 for b in marks] for a in xs])
    value, vector = np.linalg.eigh(k(marks))
    half = vector[:, value > 1e-6 * value[-1]] / np.sqrt(value[value > 1e-6 * value[-1]])
    phi = k(sets) @ half
    y = np.array([[lang == n for n in names] for *_, lang in train], float)
    w = half @ np.linalg.inv(phi.T @ phi + 0.1 * np.eye(phi.shape[1])) @ phi.T @ y
    got = {r.doc_id: r for r in op.query(spark, sf_dir).collect()}
    near = 0
    for r in rows:
        if any(c.isalpha() for c in r.text or ""):
            s = (k([grams(r.text)]) @ w)[0]
            assert abs(np.clip(s.max(), 0, 1) - got[r.doc_id].score) < 0.02
            near += names[int(s.argmax())] == got[r.doc_id].lang_pred
        else:
            near += got[r.doc_id].lang_pred == "und"
    assert near >= 0.99 * len(rows)


def test_scripts_are_told_apart(spark):
    """Languages that differ only beyond a-z."""
    words = {"ru": "мир дом вода хлеб книга", "el": "νερο ψωμι βιβλιο σπιτι", "zh": "水 面包 房子 书", "ja": "みず ぱん いえ ほん"}
    rows = [(5 * i + j, " ".join([w] * 3 + [f"{w}{i % 7}"]), lang) for i in range(40) for j, (lang, w) in enumerate(words.items())]
    model = op.train(docs_of(spark, rows))
    test = docs_of(spark, [(i, w.split()[0] + " " + w.split()[-1]) for i, w in enumerate(words.values())])
    assert [r.lang_pred for r in sorted(op.identify(test, model).collect())] == list(words)


def test_sample_is_bounded_and_equal_rows_count_once(spark, monkeypatch):
    monkeypatch.setattr(op, "SAMPLE_BYTES", 1000)
    monkeypatch.setattr(op, "TEXT_BYTES", 200)
    seen = []
    monkeypatch.setattr(op, "fit", lambda texts, langs, *a: seen.append(texts))
    rows = [(1, "same text", "en")] * 300 + [(i, "x" * 150 + str(i), "en") for i in range(2, 100)] + [(101, "y" * 5000, "en")]
    op.train(docs_of(spark, rows))
    assert len(seen[0]) == len(set(seen[0])) and sum(map(len, seen[0])) <= 1000 and max(map(len, seen[0])) <= 200


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = docs_of(spark, [(1, "abc", "en")]).select("*", *[F.lit(1).alias(c) for c in ("k0", "pick", "n", "size", "upto", "score", "lang_pred")])
    assert op.identify(df, op.train(df)).columns == ["doc_id", "lang_pred", "score"]


def test_kernel_is_blended_presence(spark, sf_dir):
    texts = ["abc abd", "Été abc", "zzz"]
    model = op.fit(texts, ["x", "y", "z"], 3, 0.1)
    sets = [grams(t) for t in texts]
    k = model.kernel(texts)
    order = [texts.index(t) for t in texts]
    for i in order:
        for j, chosen in enumerate(order):
            want = len(sets[i] & sets[chosen]) / (len(sets[i]) * len(sets[chosen])) ** 0.5
            assert abs(k[i, j] - want) < 1e-5
