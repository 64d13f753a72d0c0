"""Toxicity scores: a factorization machine over hashed terms.

Terms are the distinct lower-cased words of a text and their five-letter stems (so inflected insults share
a term), hashed into ``dim`` buckets. The model is y = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j with
binary x: the factor vectors learn pairs of terms (an insult next to a group mention) that additive weights
miss. Term statistics are counted on Spark; the machine itself is fitted on a bounded, documented sample of
labelled rows (``sample_rows`` a class) over the ``terms`` buckets that separate the classes best.

Defined results: null and empty texts have no terms and get the model's base score; rows without a label
are only scored; repeated label rows count as their maximum; with no labels every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, fresh_name, table

WORD = re.compile(r"\w+")
STEM = 5
CACHE = 400_000


@dataclass(frozen=True)
class Params:
    dim: int = 1 << 18          # hash buckets
    terms: int = 1024           # buckets kept for the machine
    factors: int = 8            # length of a factor vector
    sample_rows: int = 12_000   # labelled rows a class at most, least hash of doc_id first
    epochs: int = 30
    rate: float = 0.02
    l2: float = 1e-4
    seed: int = 7


def terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def bucket(term: str, dim: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % dim


@dataclass
class Model:
    slot: dict[int, int]        # bucket -> position in w and v
    w0: float
    w: np.ndarray
    v: np.ndarray
    dim: int
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "cache": {}}

    def slots(self, text: str | None) -> list[int]:
        """Positions of the text's terms that the machine knows."""
        if not text:
            return []
        cache, found = self.cache, set()
        for word in set(WORD.findall(text.lower())):
            s = cache.get(word)
            if s is None:
                if len(cache) > CACHE:
                    cache.clear()
                all_of = (word, word[:STEM] + "*") if len(word) > STEM else (word,)
                s = cache[word] = tuple(self.slot[b] for b in (bucket(t, self.dim) for t in all_of) if b in self.slot)
            if s:
                found.update(s)
        return sorted(found)

    def score(self, text: str | None) -> float:
        s = self.slots(text)
        y = self.w0
        if s:
            v = self.v[s]
            y += float(self.w[s].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v * v).sum()))
        return float(1.0 / (1.0 + np.exp(-min(max(y, -30.0), 30.0))))


def fit_machine(rows: list[list[int]], y: np.ndarray, n_terms: int, p: Params) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam on the logistic loss over mini-batches of 512 rows (binary features given as position lists)."""
    rng = np.random.default_rng(p.seed)
    rate = float((y.sum() + 0.5) / (len(y) + 1))
    theta = [np.array([np.log(rate / (1 - rate))]), np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, p.factors))]
    m1, m2, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(p.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 512):
            pick = order[at:at + 512]
            x = np.zeros((len(pick), n_terms))
            for i, r in enumerate(pick):
                x[i, rows[r]] = 1.0
            xv = x @ theta[2]
            z = theta[0][0] + x @ theta[1] + 0.5 * ((xv ** 2).sum(1) - x @ (theta[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            xg = x.T @ g
            grads = [np.array([g.sum()]), xg + p.l2 * theta[1],
                     x.T @ (g[:, None] * xv) - theta[2] * xg[:, None] + p.l2 * theta[2]]
            step += 1
            for k, gr in enumerate(grads):
                m1[k] = 0.9 * m1[k] + 0.1 * gr
                m2[k] = 0.999 * m2[k] + 0.001 * gr * gr
                theta[k] = theta[k] - p.rate * (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return float(theta[0][0]), theta[1], theta[2]


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """Learns from labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    lab = (labels.where((crc_mod(F.col("doc_id"), 5) != 0) & F.col("toxic").isNotNull())
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")))
    key = F.xxhash64("doc_id")
    pick = (lab.where("y = 1").orderBy(key, "doc_id").limit(p.sample_rows)
            .unionAll(lab.where("y = 0").orderBy(key, "doc_id").limit(p.sample_rows)))
    # at most two times sample_rows ids: a proven bound for the broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").select("text", "y")
    dim = p.dim

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, dim), dtype=np.int64)
        for pdf in batches:
            for text, y in zip(pdf.text, pdf.y):
                for b in {bucket(t, dim) for t in terms_of(text or "")}:
                    n[y, b] += 1
        at = np.flatnonzero(n.sum(0))
        yield pd.DataFrame({"bucket": at, "neg": n[0, at], "pos": n[1, at]})

    counts = sample.mapInPandas(count, "bucket long, neg long, pos long").groupBy("bucket").agg(
        F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    size = sample.groupBy().agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, pos = size["n"], size["p"]
    if n == 0:
        return Model({}, -30.0, np.zeros(0), np.zeros((0, p.factors)), dim)
    # chi-square of term against class, rare terms left out
    a, b = F.col("pos"), F.col("neg")
    c, d = F.lit(float(pos)) - a, F.lit(float(n - pos)) - b
    chi = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d) + 1.0)
    top = counts.where(a + b >= 3).orderBy(chi.desc(), "bucket").limit(p.terms).select("bucket").collect()
    slot = {r["bucket"]: i for i, r in enumerate(top)}
    blank = Model(slot, 0.0, np.zeros(len(slot)), np.zeros((len(slot), p.factors)), dim)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"y": pdf.y, "s": [blank.slots(t) for t in pdf.text]})

    got = sample.mapInPandas(features, "y int, s array<int>").toPandas()  # bounded by sample_rows and terms
    got = got.assign(k=[tuple(s) for s in got.s]).sort_values(["k", "y"], kind="stable")  # same order whatever the tasks
    w0, w, v = fit_machine([list(k) for k in got.k], got.y.to_numpy(dtype=float), len(slot), p)
    return Model(slot, w0, w, v, dim)


def scorer(spark: SparkSession, model: Model):
    """Column function text -> score (0 to 1)."""
    held = spark.sparkContext.broadcast(model)  # terms x (factors + 1) numbers

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in text], dtype="float64")

    return lambda text: score(text)


def with_scores(docs: DataFrame, model: Model, name: str) -> DataFrame:
    return docs.withColumn(name, scorer(docs.sparkSession, model)(F.col("text")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, p: Params = Params()) -> DataFrame:
    """The documents that the machine does not reject (same columns)."""
    name = fresh_name(docs, "toxicity_score")
    return with_scores(docs, train(docs, labels, p), name).where(F.col(name) < threshold).drop(name)


def held_out(col: Column) -> Column:
    return F.coalesce(crc_mod(col, 5) == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return with_scores(docs, model, "score").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
