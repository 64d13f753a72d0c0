"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, everything but letters becomes a blank, and all 1- to 3-grams that hold a letter are
hashed into ``dim`` buckets. Counts per (language, bucket) are summed on Spark with numpy counters in each
task; the log-probability matrix (``dim`` x languages, its size is checked) is broadcast and scored in
sparse numpy batches. Very long texts are cut into pieces whose log-probabilities add up.

Defined results: null texts and texts without a letter are ``und`` with score 0; ties go to the first
language in sorted order; with no training rows every text is ``und`` with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, crc_mod, table

DIM = 1 << 15
ORDERS = 3
PIECE = 1 << 20
MAX_MATRIX_BYTES = 256 << 20
_LETTER: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTER[0]


def pieces(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """Lower-cased pieces with about ``size`` characters a group; a piece repeats the two characters before it."""
    at, held, total = [], [], 0
    for i, t in enumerate(texts):
        t = t or ""
        for k in range(0, max(len(t), 1), size):
            at.append(i)
            held.append(t[max(k - ORDERS + 1, 0):k + size].lower())
            total += len(held[-1])
            if total >= size:
                yield at, held
                at, held, total = [], [], 0
    if at:
        yield at, held


def grams(held: list[str], dim: int = DIM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: (positions in the joined pieces, buckets). Blanks before every piece keep n-grams inside."""
    c = code_points(("\0" * ORDERS).join(["", *held, ""]))
    is_letter = letter_table()[c]
    c = np.where(is_letter, c, np.uint32(32))
    h = np.zeros(len(c), dtype=np.uint32)
    seen = np.zeros(len(c), dtype=bool)
    shift = np.uint32(32 - (dim.bit_length() - 1))
    for n in range(ORDERS):
        h = h[:len(c) - n] * np.uint32(0x01000193) + c[n:]
        seen = seen[:len(c) - n] | is_letter[n:]
        at = np.flatnonzero(seen)
        yield at, ((h[at] + np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> shift


def starts(held: list[str]) -> np.ndarray:
    lens = np.fromiter((len(t) for t in held), dtype=np.int64, count=len(held)) + ORDERS
    return np.concatenate([[0], np.cumsum(lens)[:-1]])


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray    # dim x languages, float32
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        n, k = len(texts), len(self.langs)
        total, letters = np.zeros((n, max(k, 1))), np.zeros(n, dtype=np.int64)
        for at, held in pieces(texts):
            where, first = np.array(at), starts(held)
            for pos, b in grams(held, len(self.logp) or DIM):
                own = np.searchsorted(pos, np.append(first, np.iinfo(np.int64).max))
                full = own[1:] > own[:-1]
                if full.any():
                    np.add.at(letters, where[full], 1)
                    if k:
                        sums = np.add.reduceat(self.logp[b], own[:-1][full], axis=0, dtype=np.float64)
                        np.add.at(total, where[full], sums)
        if not k:
            return ["und"] * n, np.zeros(n)
        y = total + self.prior
        e = np.exp(y - y.max(1, keepdims=True))
        best, ok = y.argmax(1), letters > 0
        score = np.where(ok, e[np.arange(n), best] / e.sum(1), 0.0)
        return [self.langs[j] if good else "und" for j, good in zip(best, ok)], score


def train(docs: DataFrame, dim: int = DIM, alpha: float = 0.5) -> Model:
    """Counts n-grams of all documents with a language whose crc32(doc_id as text) mod 4 is not 2."""
    rows = docs.where(F.coalesce(crc_mod(F.col("doc_id"), 4) != 2, F.lit(True)) & F.col("lang").isNotNull()
                      & F.col("text").isNotNull()).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        n_docs: dict[str, int] = {}
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                n = total.setdefault(lang, np.zeros(dim, dtype=np.int64))
                n_docs[lang] = n_docs.get(lang, 0) + len(part)
                for _, held in pieces(list(part.text)):
                    for _, b in grams(held, dim):
                        n += np.bincount(b, minlength=dim)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1), "n": np.append(n[at], n_docs[lang])})

    sums = (rows.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket")
            .agg(F.sum("n").alias("n")))
    # dim rows a language at most; the size is checked before the matrix is gathered
    sums = sums.persist()
    langs = sorted(r["lang"] for r in sums.where("bucket = -1").select("lang").collect())
    if len(langs) * dim * 4 > MAX_MATRIX_BYTES:
        raise ValueError(f"{len(langs)} languages with {dim} buckets exceed the matrix bound; lower dim")
    got = sums.toPandas()
    sums.unpersist()
    n = np.zeros((dim, len(langs)))
    col = {c: i for i, c in enumerate(langs)}
    grid = got[got.bucket >= 0]
    n[grid.bucket.to_numpy(), grid.lang.map(col).to_numpy(dtype=np.int64)] = grid.n.to_numpy()
    docs_of = got[got.bucket < 0].set_index("lang").n.reindex(langs).to_numpy(dtype=float)
    logp = np.log((n + alpha) / (n.sum(0) + alpha * dim)).astype(np.float32)
    return Model(langs, logp, np.log(docs_of / docs_of.sum()) if langs else np.zeros(0))


def predictor(spark: SparkSession, model: Model):
    """Column function text -> struct<lang_pred string, score double>."""
    held = spark.sparkContext.broadcast(model)  # checked against MAX_MATRIX_BYTES in train

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        langs, score = held.value.predict(list(text))
        return pd.DataFrame({"lang_pred": langs, "score": score})

    return lambda text: predict(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    model = train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (docs.withColumn("p", predictor(spark, model)(F.col("text")))
            .select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
                    "p.lang_pred", "p.score"))
