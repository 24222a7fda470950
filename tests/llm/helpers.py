import duckdb
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs_of(spark, rows, schema=DOCS):
    """rows: (doc_id, text[, lang[, source]])"""
    full = [tuple(r) + (None,) * (4 - len(r)) + (None if r[1] is None else len(r[1]),) for r in rows]
    return spark.createDataFrame(full, schema)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, what in tables.items():
        if isinstance(what, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{what}'")
        else:
            con.register(name, what.toArrow())
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows_of(names, got.fetchall())


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(clean, key=lambda r: tuple((x is None, str(x)) for x in r))


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


#: Nulls, empty and blank texts, ties, repeated rows, one very long text, odd bytes.
HARD = [
    (1, "The Cat sat on the mat and then it ran far away", "en", "a"),
    (2, "the cat sat on the mat and then it ran far away", "en", "b"),
    (2, "the cat sat on the mat and then it ran far away", "en", "b"),
    (3, None, None, None),
    (4, "", "en", ""),
    (5, " \t\n ", None, "a"),
    (None, "the cat sat on the mat and then it ran far away", None, None),
    (6, "ÉTÉ   x\u001cy 👍 words", "fr", "b"),
    (7, "w" * 300 + " " + "tick tock " * 4000, "en", "a"),
    (8, "tick tock " * 4100 + "end", "en", "c"),
    (9, "a", "en", "c"),
    (-5, "12345 !!! ???", "de", "c"),
]
