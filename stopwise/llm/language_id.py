"""Language ID by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the blended spectrum over n-gram presence: the number of distinct 1-, 2-
and 3-grams of code points that both hold, over the geometric mean of their own numbers. Texts are
lower-cased; anything but a letter reads as one space. N-grams of any script are told apart by a hash of HASH_BITS bits.
Landmarks map a text to its kernel values with them, whitened by the landmarks' own kernel matrix; ridge regression
with one target for each language is solved on the mapped sample.

Training takes at most ``per_language`` labelled documents of each of at most ``languages`` most
frequent languages, chosen by a hash of id and text, of at most TEXT_BYTES each and SAMPLE_BYTES a language; at most
``landmarks`` of these are landmarks. Those bounds (200 MB for 200 languages) are all that reaches the driver.
Scoring is map-only: whole texts, one batched matrix product of presence with the landmarks and one with the weights.

Edge cases: a null text, or one without letters, is ``und`` with score 0; if no labelled row
exists every text is ``und``; repeated rows are answered each and trained on once; a null doc_id is never trained on
and not held out; an empty table gives an empty result; other columns are not read unless named in ``keep``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stopwise.deploy import ship, tidied
from stopwise.llm.common import stash, table

FOLDS = 5
HASH_BITS = 19
ROWS = 64  # texts in one matrix product
#: Bounds of the training sample: longest text, and all texts of a language.
TEXT_BYTES, SAMPLE_BYTES = 64 << 10, 1 << 20
SPARE = 8
U = np.uint64
#: Odd multipliers of the n-gram hash.
FACTORS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_codes(text: str) -> np.ndarray:
    """Hashes of all 1-, 2- and 3-grams of a text; runs of non-letters are one space, also at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.concatenate(([0], np.where(letters()[points], points, 0), [0])).astype(U)
    s = s[np.concatenate(([True], (s[1:] > 0) | (s[:-1] > 0)))]
    if len(s) < 3:
        return np.empty(0, np.int64)
    a, b, c = (s * f for f in FACTORS)
    two = (a[:-1] ^ (b[1:] >> U(7))) + b[1:] + U(1)
    three = (two[:-1] ^ (c[2:] >> U(11))) * FACTORS[1] + c[2:]
    every = np.concatenate((a[s > 0], two * FACTORS[0], three * FACTORS[2]))
    return (every >> U(64 - HASH_BITS)).astype(np.int64)


def has_letters(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    column: np.ndarray  # of each gram that a landmark holds; else the last, which is not used
    landmarks: np.ndarray  # presence, grams x landmarks
    norms: np.ndarray
    weights: np.ndarray  # landmarks x languages, whitening included

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence of landmark grams by text; number of distinct grams of each text."""
        n = self.landmarks.shape[0]
        out, own = np.zeros((len(texts), n + 1), np.float32), np.zeros(len(texts))
        seen = np.zeros(1 << HASH_BITS, bool)
        for i, text in enumerate(texts):
            seen[gram_codes(text)] = True
            held = np.flatnonzero(seen)
            seen[held] = False
            own[i] = len(held)
            out[i, self.column[held]] = 1
        return out[:, :n], own

    def kernel(self, texts: list[str]) -> np.ndarray:
        p, own = self.presence(texts)
        return (p @ self.landmarks) / np.sqrt(np.maximum(own, 1)[:, None] * self.norms[None, :])

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        scores = self.kernel(texts) @ self.weights
        best = scores.argmax(axis=1)
        top = np.clip(scores[np.arange(len(texts)), best], 0, 1)
        return [self.languages[i] for i in best], top


def fit(texts: list[str], langs: list[str], landmarks: int, ridge: float) -> Model:
    """``texts`` in an order that doesn't depend on langs; landmarks are dealt to languages in turn."""
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(y), int)
    for k in range(len(names)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[:landmarks]
    column = np.full(1 << HASH_BITS, -1, np.int32)
    own = [np.unique(gram_codes(texts[i])) for i in chosen]
    grams = np.unique(np.concatenate(own))
    column[grams] = np.arange(len(grams))
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for j, g in enumerate(own):
        marks[column[g], j] = 1
    model = Model(names, column, marks, np.array([max(1, len(g)) for g in own], float), np.zeros((len(chosen), len(names))))
    k = (marks.T @ marks) / np.sqrt(model.norms[:, None] * model.norms[None, :])
    value, vector = np.linalg.eigh(k.astype(float))
    keep = value > 1e-6 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])
    mapped = np.concatenate([model.kernel(texts[i : i + ROWS]) for i in range(0, len(texts), ROWS)]) @ whiten
    target = (y[:, None] == np.arange(len(names))[None, :]).astype(float)
    solved = np.linalg.solve(mapped.T @ mapped + ridge * np.eye(mapped.shape[1]), mapped.T @ target)
    model.weights = whiten @ solved
    return model


def fold(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(FOLDS))


def train(docs: DataFrame, per_language: int = 250, languages: int = 200, landmarks: int = 128, ridge: float = 0.1) -> Model | None:
    """A model from rows outside the held-out fold; None if there is no labelled text with letters."""
    rows = docs.select("doc_id", "lang", "text")
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    usable = usable.where(F.octet_length("text") <= TEXT_BYTES).withColumn("pick", F.xxhash64("doc_id", "text"))
    frequent = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not frequent:
        return None
    # Of a large language a part is enough, some SPARE times what is taken, so that no task ranks all its rows.
    part = {r["lang"]: min(1.0, SPARE * per_language / r["count"]) for r in frequent}
    most = F.create_map(*[F.lit(x) for lang, share in part.items() for x in (lang, int(share * (1 << 20)))])
    usable = usable.where(F.pmod("pick", F.lit(1 << 20)) < F.try_element_at(most, F.col("lang")))
    size = F.max(F.octet_length("text").cast("long")).alias("size")
    once = usable.groupBy("lang", "pick").agg(size)  # equal rows count once
    order = Window.partitionBy("lang").orderBy("pick")
    some = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
    some = some.withColumn("upto", F.sum("size").over(order)).where(F.col("upto") <= SAMPLE_BYTES)
    chosen = stash(some.select("lang", "pick"), "language-sample")  # at most per_language * languages rows
    got = usable.join(F.broadcast(chosen), ["lang", "pick"]).dropDuplicates(["lang", "pick"]).select("lang", "text").collect()
    sample = sorted((zlib.crc32(r["text"].encode()), r["text"], r["lang"]) for r in got if has_letters(r["text"]))
    return fit([r[1] for r in sample], [r[2] for r in sample], landmarks, ridge) if sample else None


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) of every row, with lang_pred and score."""
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, top = ["und"] * len(texts), np.zeros(len(texts))
            if known is not None:
                rows = [i for i, t in enumerate(texts) if has_letters(t)]
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    found, value = known.predict([texts[i] for i in part])
                    for i, x in zip(part, found):
                        lang[i] = x
                    top[part] = value
            kept = [batch.column(f"k{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lang), pa.array(top)], [*[f"k{i}" for i in range(len(keep))], "lang_pred", "score"])

    plain = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col("text").alias("text"))
    schema = ", ".join(f"k{i} {plain.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    out = plain.mapInArrow(tidied(score), f"{schema}, lang_pred string, score double")
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
