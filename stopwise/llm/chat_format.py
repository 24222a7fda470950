r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and its reply
alone is trainable. Turns after the last reply make one more example without a target, so that no turn is lost.
``prefix_targets`` and ``render`` keep an example as a target turn plus the length of its prefix in the
conversation's rendering; ``expand`` explodes them into rows with context and target, and ``read_back`` gets turns and
trained text from these rows alone. Main path: DataFrame functions only.

Scale: one shuffle, by conversation. A conversation is one array and its rendering one string in one task, up to 2 GB
of text; its examples are streamed and never held together, and what is kept of each is its reply. Copying contexts
costs the square of the length of a conversation: ten thousand turns of 100 characters copy some 3 GB.

Template: ``<role>`` newline, text, ``</turn>`` newline. In roles and texts ``\``, ``<`` and ``>``
are written ``\b``, ``\l`` and ``\g``; no mark can then arise from a text, and every text is got
back exactly.

Edge cases: a null text or role is empty (and no assistant); turns with null numbers come last,
equal numbers go by role and text; repeated rows are turns each; a null conv_id is a conversation;
a conversation without assistant turns has no example and an empty loss text; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.llm.common import table

END = "</turn>\n"
PROBE = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    for a, b in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in (("\\g", ">"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def segments(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Map-only: conv_id, turn, role, text and each turn's rendering; whether it is a target."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.concat(F.lit("<"), escape(role), F.lit(">\n"), escape(text), F.lit(END)).alias("segment"),
        (role == trained_role).alias("trainable"),
    )


def prefix_targets(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per turn: conv_id, position, segment, trainable, start, loss_start, loss_end.

    The example of a trainable row is the conversation's rendering up to the end of ``segment``: the
    first ``start`` characters are context, and only [loss_start, loss_end) is trained on.
    """
    order = [F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("text")]
    in_order = Window.partitionBy("conv_id").orderBy(*order)
    rows = segments(conversations, trained_role)
    n = F.char_length("segment").cast("long")
    head = (F.char_length(escape(F.col("role"))) + 3).cast("long")
    return (
        rows.withColumn("position", F.row_number().over(in_order) - 1)
        .withColumn(
            "start",
            F.coalesce(F.sum(n).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
        )
        .withColumn("loss_start", F.when(F.col("trainable"), F.col("start") + head))
        .withColumn("loss_end", F.when(F.col("trainable"), F.col("start") + n - len(END)))
        .select("conv_id", "position", "segment", "trainable", "start", "loss_start", "loss_end")
    )


def render(turns: DataFrame) -> DataFrame:
    """Per conversation: its rendering and the loss spans of its examples, in order."""
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "segment", "loss_start", "loss_end"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("begin"), x["loss_end"].alias("end")))
    return grouped.select("conv_id", F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"), spans.alias("loss"))


def expand(rendered: DataFrame) -> DataFrame:
    """One row per example: conv_id, example, context, target (escaped reply with its end mark), trainable, last.

    If turns follow the last reply, or there is none, the last example has all turns as context and an empty target.
    """
    n = F.char_length("formatted").cast("long")
    done = F.coalesce(F.try_element_at("loss", F.lit(-1))["end"] + len(END), F.lit(0).cast("long"))
    rest = F.array(F.struct(n.alias("begin"), n.alias("end")))
    spans = F.transform("loss", lambda s: F.struct(s["begin"].alias("begin"), (s["end"] + len(END)).alias("end")))
    spans = F.when(done < n, F.concat(spans, rest)).otherwise(spans)
    rows = rendered.withColumn("spans", spans).select("conv_id", "formatted", F.size("spans").alias("n"), F.posexplode("spans").alias("example", "span"))
    return rows.select(
        "conv_id",
        "example",
        F.expr("substring(formatted, 1, CAST(span.begin AS INT))").alias("context"),
        F.expr("substring(formatted, CAST(span.begin AS INT) + 1, CAST(span.end - span.begin AS INT))").alias("target"),
        F.expr("span.begin < span.end").alias("trainable"),
        (F.col("example") == F.col("n") - 1).alias("last"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation: turns, parsed from its last example, and trained text, from the targets of all."""
    reply = F.expr(f"substring(target, 1, char_length(target) - {len(END)})")
    rows = examples.select(
        "conv_id",
        F.char_length("context").cast("long").alias("context"),
        F.when(F.col("trainable"), F.struct("example", unescape(reply).alias("text"))).alias("reply"),
        F.when(F.col("last"), F.concat("context", "target")).alias("formatted"),
    )
    rows = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list("reply")).alias("replies"),
        F.max("formatted").alias("formatted"),
        F.sum(F.when(F.col("reply").isNotNull(), F.col("context"))).alias("context_chars"),
    )
    pieces = F.filter(F.split("formatted", END, -1), lambda x: x != "")
    turn_text = F.array_join(
        F.transform(
            pieces,
            lambda x: F.concat(
                unescape(F.substring_index(F.substring(x, 2, 2147483647), ">", 1)), F.lit("\n"),
                unescape(F.substring(x, F.instr(x, ">\n") + F.lit(2), F.char_length(x))), F.lit("\n"),
            ),
        ),
        "",
    )
    return (
        rows.withColumn("turn_text", turn_text)
        .withColumn("trained", F.array_join(F.transform("replies", lambda x: x["text"]), ""))
        .select(
            "conv_id",
            F.size(pieces).cast("long").alias("n_turns"),
            F.sha2("turn_text", 256).alias("turns_sha256"),
            F.char_length("trained").cast("long").alias("loss_chars"),
            F.sha2("trained", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            F.size("replies").cast("long").alias("n_examples"),
            F.coalesce("context_chars", F.lit(0).cast("long")).alias("context_chars"),
        )
    )


def chat_format(conversations: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """The examples of all conversations: conv_id, example, context, target, trainable, last."""
    return expand(render(prefix_targets(conversations, trained_role)))


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose texts hold the template's own marks."""
    probe = F.array(
        *[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))]
    )
    extra = conversations.sparkSession.range(1).select(F.inline(probe))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(chat_format(with_probe(table(spark, sf_dir, "conversations"))))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS n,
    length(role) + length(text) + 11 + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars
  FROM c
), o AS (
  SELECT *, coalesce(sum(chars) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples,
  coalesce(sum(before + 12) FILTER (role = 'assistant'), 0)::BIGINT AS context_chars
FROM o GROUP BY conv_id
"""
