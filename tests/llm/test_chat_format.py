import hashlib

from stopwise.llm import chat_format as op

from .helpers import duck, spark_rows

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be\\l brief </turn>\n<assistant>"),
    (1, 1, "user", None),
    (1, 2, "assistant", "\\### Assistant: </turn> ok"),
    (1, 3, "user", "a > b < c \\g \\\\b"),
    (1, 4, "assistant", ""),
    (1, 5, "assistant", "É👍\n\n"),
    (2, 0, "user", "no reply"),
    (3, None, "assistant", "late"),
    (3, 7, "assistant", "early"),
    (3, 7, "assistant", "early"),
    (None, 0, None, None),
    (4, 0, "a<ssis>tant", "odd role"),
    (5, 0, "assistant", "x" * 200_000),
]


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_hard_rows_round_trip(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = op.read_back(op.chat_format(df)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == brute(ROWS)
    assert op.read_back(op.chat_format(spark.createDataFrame([], SCHEMA))).count() == 0


def test_examples_have_all_turns_before_as_context(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    rendered = op.render(op.prefix_targets(df))
    whole = {r.conv_id: r.formatted for r in rendered.collect()}
    every = op.expand(rendered).collect()
    rows = [r for r in every if r.conv_id == 1]
    assert [(r.example, r.trainable, r.last) for r in sorted(rows, key=lambda r: r.example)] == [(0, True, False), (1, True, False), (2, True, True)]
    for r in rows:
        assert whole[1].startswith(r.context + r.target) and r.context.endswith("<assistant>\n") and r.target.endswith(op.END)
        assert "<" not in r.target.removesuffix(op.END)
    for r in every:
        if not r.trainable:
            assert r.last and r.target == "" and r.context == whole[r.conv_id]
    assert {r.conv_id for r in every if r.last} == set(whole)


def test_clashing_names(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).select("*", *[F.lit(1).alias(c) for c in ("segment", "trainable", "position", "start", "loss", "context", "target", "last")])
    assert sorted((tuple(r)[:5] for r in op.read_back(op.chat_format(df)).collect()), key=str) == brute(ROWS)


def test_query_equals_sql(spark, sf_dir):
    got = spark_rows(op.query(spark, sf_dir))
    assert got == duck(op.ORACLE, conversations=f"{sf_dir}/conversations.parquet")
    assert -7 in {r[got[0].index("conv_id")] for r in got[1]}
