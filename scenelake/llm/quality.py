"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

A text is cut into words (runs of letters and digits) and runs of other signs; words, pairs of neighbours, and
the mere fact that a word comes again in an n-gram are hashed into 2^18 features, weighted by 1 + log(count) and scaled to length one. Training takes a bounded sample of the labelled rows;
scoring takes every row.
"""

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenelake.scale import settle

from .catalog import computed, id_crc, mapped, query, table, utf8

FEATURE_BITS, SAMPLE, ROUNDS = 18, 12_000, 4
HELD_OUT_OF, HELD_OUT = 3, 1
_SAME = np.array([1, 2], np.uint64)             # features of n-grams in which a word follows itself, at once or after one other
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


class Featuriser:
    """Feature numbers and weights of texts; hashes of words are kept up to a bound."""

    def __init__(self, bits: int = FEATURE_BITS, keep: int = 100_000):
        self.mask, self.keep, self.known = np.uint64((1 << bits) - 1), keep, {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        tokens, known = _TOKEN.findall(text), self.known
        if len(known) > self.keep:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh64_intdigest(t)
        h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
        with np.errstate(over="ignore"):
            pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        same = np.repeat(_SAME, [np.count_nonzero(h[:-1] == h[1:]), np.count_nonzero(h[:-2] == h[2:])])
        at, n = np.unique(np.concatenate([h >> np.uint64(40), pairs >> np.uint64(40), same]) & self.mask, return_counts=True)
        w = 1 + np.log(n)
        return at.astype(np.int64), (w / np.sqrt((w * w).sum())) if len(w) else w


def follow_the_leader(rows, bits: int = FEATURE_BITS, rounds: int = ROUNDS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> np.ndarray:
    """Weights by FTRL-proximal updates (McMahan et al., 2013), the last one being the bias. rows: (features, weights, label)."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = np.array([1 << bits])

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
    for _ in range(rounds):
        for at, x, y in rows:
            i, v = np.concatenate([at, bias]), np.append(x, 1.0)
            w, ni = weights(z[i], n[i]), n[i]
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
    return weights(z, n)


def _features():
    feats = Featuriser()

    def step(batch):
        out = [feats(t.as_py()) for t in batch.column("__utf8")]
        return [batch.column("y"), batch.column("turn"), [a.astype("<i4").tobytes() for a, _ in out], [w.astype("<f4").tobytes() for _, w in out]]
    return step


def _fit(pdf):
    import pandas as pd
    rows = [(np.frombuffer(a, "<i4"), np.frombuffer(w, "<f4"), y) for a, w, y in pdf.sort_values("turn")[["at", "w", "y"]].itertuples(index=False)]
    return pd.DataFrame({"weights": [follow_the_leader(rows).astype("<f4").tobytes()]})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from at most `sample` labelled documents whose id isn't held out.

    The sample is the first by a hash of the id, so it does not depend on order or partitions. Null ids and labels are left
    out; an id with both labels counts as good; of rows that share an id the smallest text is taken. Without any labelled
    row all weights are zero and every score is a half.
    """
    turn = F.xxhash64(F.lit(5), "doc_id")
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.pmod(id_crc(), F.lit(HELD_OUT_OF)) != HELD_OUT))
    some = settle(known.groupBy("doc_id").agg(F.max("quality").alias("y")).orderBy(turn, "doc_id").limit(sample), "sample")
    texts = docs.select("doc_id", utf8().alias("__utf8")).join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("__utf8").alias("__utf8"))
    feats = mapped(texts.select("y", turn.alias("turn"), "__utf8"), _features, "y int, turn long, at binary, w binary")
    model = settle(feats.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(_fit, "weights binary"), "model").first()
    return np.frombuffer(bytes(model["weights"]), "<f4") if model else np.zeros((1 << FEATURE_BITS) + 1, "<f4")


def _scorer(weights):
    def start():
        feats, w = Featuriser(), weights.value

        def step(texts):
            scores = []
            for t in texts:
                at, x = feats(t.as_py())
                scores.append(1 / (1 + np.exp(-np.clip(float(w[at] @ x) + float(w[-1]), -35, 35))))
            return pa.array(scores, pa.float64())
        return step
    return start


def score(spark, weights: np.ndarray, text: str = "text") -> Column:
    """How likely label 1 is. Only the text counts, in whole at any length; null is as empty, which gets the bias alone. The weights, 2^18 numbers,
    are the only thing broadcast."""
    return computed(_scorer(spark.sparkContext.broadcast(weights)), "double")(utf8(text))


def scored(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` with a column `quality_score`, in place of one of that name. An empty table gives no rows; repeated rows get equal scores."""
    return docs.withColumn("quality_score", score(docs.sparkSession, weights))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows that the classifier, trained on these rows, doesn't reject. Columns may have any name."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), score(docs.sparkSession, train(docs, labels)).alias("score"))
    return rows.where(F.col("score") >= least).select("row.*")


@query("op5_quality_classifier")
def op5_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (F.pmod(id_crc(), F.lit(HELD_OUT_OF)) == HELD_OUT).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
