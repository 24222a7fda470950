"""URL filters: logistic regression on hashed character n-grams of host and path, under rules.

Main path: DataFrame functions only. The labelled table is small by contract (``max_train`` rows
at most are fitted, chosen by hash; equal rows count as often as they occur). Training is full-batch gradient descent on
the regularised logistic loss: one SQL ``aggregate`` whose steps go over the sample by rows and by n-grams. n-grams of host and of path are counts over
the square root of their sum, each for itself, so that a long path doesn't hide a host. The model that reaches the
plan is an array of ``buckets`` + 1 weights; scoring is one narrow projection of the url column,
without shuffle. The built-in table has as many wanted as unwanted hosts and the same paths, subdomains and endings for both;
``bad_weight`` makes up for what wanted hosts have in common with unwanted ones.

Edge cases: a null url, or one without ``://``, has empty host and path and is judged by the
model's bias alone; an empty table gives an empty result; repeated rows are judged each; columns
other than id and url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm import url_examples
from stopwise.llm.common import UPPER, table

RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Of n-grams of the path beside those of the host.
PATH_WEIGHT = 0.5


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table of ``url_examples``: (url, bad)."""
    rows = ", ".join(f"('{url}', {bad})" for url, bad in url_examples.labelled())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, bad)")


def host_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(url, parts, 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(url, parts, 2)


def ngrams(text: Column, sizes: tuple[int, ...], tag: str) -> Column:
    """All n-grams of ``text`` between marks, as an array; shorter texts give fewer or none."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.char_length(marked) >= n, F.sequence(F.lit(1), F.char_length(marked) - n + 1))
        starts = F.coalesce(starts, F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit(f"{tag}{n}"), F.substring(marked, i, F.lit(n))))

    return F.concat(*[of(n) for n in sizes])


def features(host: Column, path: Column, buckets: int) -> Column:
    """(bucket, value) of every n-gram, repeats included."""

    def part(grams: Column, weight: float) -> Column:
        def of(held: Column) -> Column:  # the n-grams, made once
            value = F.lit(weight) / F.sqrt(F.greatest(F.size(held), F.lit(1)).cast("double"))
            return F.transform(held, lambda g: F.struct(F.pmod(F.xxhash64(g), F.lit(buckets)).cast("int").alias("bucket"), value.alias("value")))

        return F.flatten(F.transform(F.array(grams), of))

    return F.concat(part(ngrams(host, (3, 4, 5), "h"), 1.0), part(ngrams(path, (2, 3, 4), "p"), PATH_WEIGHT))


def train(labelled: DataFrame, buckets: int, max_train: int, rounds: int, rate: float, decay: float, bad_weight: float) -> list[float]:
    """``buckets`` weights and, last, the bias."""
    order = Window.orderBy(F.xxhash64("url"), "url", "y")  # over at most max_train rows
    host, path = host_path(F.col("url"))
    rows = (
        labelled.where("url IS NOT NULL AND bad IS NOT NULL")
        .select("url", F.col("bad").cast("double").alias("y"))
        .orderBy(F.xxhash64("url"), "url", "y")
        .limit(max_train)
        .groupBy("url", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("times"))
        .withColumn("id", F.row_number().over(order) - 1)
        .withColumn("f", features(host, path, buckets))
    )
    bias = F.array(F.struct(F.lit(buckets).alias("bucket"), F.lit(1.0).alias("value")))
    sparse = rows.select("id", F.explode(F.concat("f", bias)).alias("x")).groupBy("id", F.col("x.bucket").alias("bucket")).agg(F.sum("x.value").alias("v"))
    met = sparse.select("bucket").distinct().withColumn("pos", F.row_number().over(Window.orderBy("bucket")) - 1)  # at most buckets + 1
    sparse = sparse.join(met, "bucket")
    sample = rows.select("id", "y", "times", (F.col("times") * F.when(F.col("y") > 0, bad_weight).otherwise(1.0)).alias("m"))
    by_row = sparse.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("f")).join(sample, "id")
    by_row = by_row.agg(F.sort_array(F.collect_list(F.struct("id", "y", "m", "f"))).alias("rows"), F.sum("times").alias("n"), F.lit(1).alias("one"))
    by_bucket = sparse.groupBy("pos", "bucket").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("c"))
    by_bucket = by_bucket.agg(F.sort_array(F.collect_list(F.struct("pos", "bucket", "c"))).alias("cols"), F.lit(1).alias("one"))
    miss = "transform(rows, e -> e.m * (e.y - 1D / (1D + exp(-aggregate(e.f, 0D, (s, x) -> s + w[x.pos] * x.v)))))"
    step = f"transform(cols, (c, i) -> w[i] * {1 - rate * decay}D + {rate}D / n * aggregate(c.c, 0D, (s, x) -> s + r[x.id] * x.v))"
    fitted = by_row.join(by_bucket, "one").select(
        F.col("cols.bucket").alias("bucket"),
        F.expr(f"aggregate(sequence(1, {rounds}), transform(cols, c -> 0D), (w, t) -> transform(array({miss}), r -> {step})[0])").alias("w"),
    )
    got = fitted.first()  # at most buckets + 1 weights
    known = dict(zip(got["bucket"], got["w"])) if got else {}
    return [float(known.get(i, 0.0)) for i in range(buckets + 1)]


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; nulls if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        of, _, rest = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{rest}")
        name, action = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def url_filter(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[tuple[str, str], ...] = RULES,
    *,
    id_col: str = "page_id",
    buckets: int = 1 << 14,
    max_train: int = 800,
    rounds: int = 200,
    rate: float = 4.0,
    decay: float = 1e-5,
    bad_weight: float = 1.2,
    threshold: float = 0.5,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, score (probability of a bad url)."""
    spark = pages.sparkSession
    w = train(labelled if labelled is not None else labelled_urls(spark), buckets, max_train, rounds, rate, decay, bad_weight)
    host, path = host_path(F.col("url"))
    # one literal that is folded to an array, instead of thousands
    model = F.split(F.lit(" ".join(map(repr, w[:-1]))), " ").cast("array<double>")
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    margin = F.lit(w[-1]) + F.aggregate(features(F.col("host"), F.col("path"), buckets), F.lit(0.0), lambda s, x: s + F.get(model, x["bucket"]) * x["value"])
    rows = rows.withColumn("margin", margin)
    rows = rows.withColumn("score", 1 / (1 + F.exp(-F.col("margin"))))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    judged = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(action, judged).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
