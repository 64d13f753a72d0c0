"""Quality classifier: interpolated modified Kneser-Ney character n-grams trained on trusted text.

A gram is ``ORDER`` letters packed into one 64-bit number (12 bits a letter: code points above the table's
range share hashed codes), so contexts and suffixes are shifts and masks, and every step of the model is a
count join on such numbers, sharded by the shuffle:

1. one pass counts the grams of trusted documents (labels.quality = 1) and lists the grams of all documents;
2. continuation counts, the counts of counts with their three discounts per order, context totals and the
   interpolated probabilities are aggregations and equi-joins of the gram table (lower orders are suffixes);
3. the log-probability of every gram of the corpus is found by joining the grams with the model from the
   highest order down (back-off weights for what the trusted text lacks);
4. the resulting table is written in shards of bounded size; scoring tasks probe their texts shard by shard,
   so a task holds one shard and one batch.

A document's perplexity is exp of minus the mean log-probability of its letters. It is kept unless its
perplexity exceeds the ``quantile`` of its language's trusted documents (of all trusted documents where the
language has fewer than ``MIN_TRUSTED``). For the quantiles trusted documents are cross-fitted: dealt into
``FOLDS`` by their id, each fold scored by a model of the others, as documents are that no model has seen.

Defined results: null and empty texts have perplexity null and are not kept; documents without a language use
the overall threshold; without trusted text perplexities come from the uniform distribution and all non-empty
documents are kept; repeated label rows count as trusted when any of them is 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_broadcast, code_points, crc_mod, cut_lineage, scratch_path, table

ORDER = 5
BITS = 12
LETTERS = 1 << BITS
MASK = LETTERS - 1
QUANTILE = 0.99
MIN_TRUSTED = 50
FOLDS = 2
SHARD_GRAMS = 1 << 21       # grams of a shard: about 70 MB in a task
GROUP = 1 << 20             # letters handled at once


def codes(text: str) -> np.ndarray:
    """Letter codes 1..4095: code points below 2048 are their own, others share 2048 hashed codes."""
    c = code_points(text).astype(np.int64)
    return np.where(c < 2048, np.maximum(c, 1), 2048 + (c * 0x9E3779B1 >> 7) % 2048)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams of all letters in order, number of letters of each text); texts begin after ORDER - 1 zeros."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    c = np.zeros(int(lens.sum()) + (ORDER - 1) * len(texts), dtype=np.int64)
    at = np.cumsum(lens + ORDER - 1) - lens
    keep = np.zeros(len(c), dtype=bool)
    c_all = codes("".join(texts))
    place = np.arange(len(c_all)) + np.repeat(at - (np.cumsum(lens) - lens), lens)
    c[place] = c_all
    keep[place] = True
    g = c.copy()
    for k in range(1, ORDER):
        g[k:] |= c[:-k] << (BITS * k)
    return g[keep], lens


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document positions, grams, letters a document) in groups of bounded size; a very long text comes in
    several pieces, each with the letters before it as context."""
    at, held, total = [], [], 0
    for i, t in enumerate(texts):
        if t and len(t) > GROUP:
            for k in range(0, len(t), GROUP):
                lead = t[max(k - ORDER + 1, 0):k]
                g, n = grams([lead + t[k:k + GROUP]])
                yield np.array([i]), g[len(lead):], n - len(lead)
            continue
        at.append(i)
        held.append(t or "")
        total += len(held[-1])
        if total >= GROUP:
            yield np.array(at), *grams(held)
            at, held, total = [], [], 0
    if at:
        yield np.array(at), *grams(held)


class Slots:
    """Open-addressing set of grams in numpy: grams -> positions of a power-of-two table."""

    def __init__(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)

    def home(self, g: np.ndarray) -> np.ndarray:
        return ((g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def locate(self, g: np.ndarray) -> np.ndarray:
        """Position of every gram, -1 for those that are not in the table."""
        at = self.home(g)
        got = self.keys[at]
        left = np.flatnonzero((got != g) & (got != -1))
        out = np.where(got == g, at, -1)
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            got = self.keys[at]
            hit = got == g[left]
            out[left[hit]] = at[hit]
            go = ~hit & (got != -1)
            left, at = left[go], at[go]
        return out

    def insert(self, g: np.ndarray) -> np.ndarray:
        """Adds distinct grams that are not in the table; their positions."""
        at, left = self.home(g), np.arange(len(g))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = g[free]
            left = left[self.keys[at[left]] != g[left]]
            at[left] = (at[left] + 1) & self.mask
        return at


class Seen:
    """Grams and counts that a task gathers before it hands them on; emptied at half of its table."""

    def __init__(self, bits: int = 21) -> None:
        self.bits = bits
        self.take()

    def add(self, g: np.ndarray, trusted: bool) -> pd.DataFrame | None:
        at = self.table.locate(g)
        new, n = np.unique(g[at < 0], return_counts=True)
        if len(new):
            if 2 * (self.size + len(new)) > 1 << self.table.bits:
                full = self.take(len(new))
                self.add(g, trusted)        # the new table has room for all of them
                return full
            where = self.table.insert(new)
            self.size += len(new)
            if trusted:
                self.n[where] += n
        if trusted:
            self.n += np.bincount(at[at >= 0], minlength=len(self.n))
        return None

    def take(self, room: int = 0) -> pd.DataFrame | None:
        """What was gathered; the table starts anew, with room for at least so many grams."""
        out = None
        if getattr(self, "size", 0):
            at = np.flatnonzero(self.table.keys != -1)
            out = pd.DataFrame({"g": self.table.keys[at], "n": self.n[at]})
        bits = max(self.bits, int(4 * room).bit_length())
        self.table, self.n, self.size = Slots(bits), np.zeros(1 << bits, dtype=np.int64), 0
        return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, n): every gram of ``docs`` (text, trusted), with its count in trusted texts (0 if there is none)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Seen()
        for pdf in batches:
            for flag in (True, False):
                for _, g, _ in pieces(list(pdf.text[pdf.trusted == flag])):
                    if len(g) and (full := seen.add(g, flag)) is not None:
                        yield full
        if (rest := seen.take()) is not None:
            yield rest

    return docs.mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))


def suffix(col, k: int):
    """The last ``k`` letters of a gram."""
    return col.bitwiseAND(F.lit((1 << (BITS * k)) - 1))


def model(top: DataFrame) -> list[DataFrame]:
    """Tables of the orders 1..ORDER from trusted grams (g, n): (g, p) with the interpolated probability, and
    (ctx, gamma) with the back-off weight of a context; ``[(p_1, None), (p_2, gamma_2), ...]``."""
    out, lower = [], None
    for k in range(1, ORDER + 1):
        if k == ORDER:
            t = top.select("g", F.col("n").alias("c"))
        else:
            # continuation counts: distinct letters before the gram, that is distinct grams one longer
            longer = top.select(suffix(F.col("g"), k + 1).alias("l")).distinct()
            t = longer.groupBy(suffix(F.col("l"), k).alias("g")).agg(F.count("*").alias("c"))
        t = cut_lineage(t, f"kn-{k}")
        of = t.agg(*[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
        n1, n2, n3, n4 = (of[f"n{i}"] or 0 for i in (1, 2, 3, 4))
        d1, d2, d3 = discounts(n1, n2, n3, n4)
        d = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        t = t.withColumn("ctx", F.shiftrightunsigned("g", BITS)).withColumn("d", d)
        ctx = t.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum("d").alias("cut")).select(
            "ctx", "total", (F.col("cut") / F.col("total")).alias("gamma"))
        t = t.join(ctx, "ctx")
        direct = (F.col("c") - F.col("d")) / F.col("total")
        if k == 1:
            p = t.select("g", (direct + F.col("gamma") / LETTERS).alias("p"))
            gamma0 = ctx.select("gamma").first()
            out.append((p, gamma0["gamma"] if gamma0 else 1.0))
        else:
            low = lower.withColumnsRenamed({"g": "s", "p": "low"})
            p = t.withColumn("s", suffix(F.col("g"), k - 1)).join(low, "s").select(
                "g", (direct + F.col("gamma") * F.col("low")).alias("p"))
            out.append((p, ctx.select("ctx", "gamma")))
        lower = cut_lineage(p, f"kn-p{k}")
        out[-1] = (lower, out[-1][1])
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney; 0.5, 0.5, 0.5 where the counts of counts don't give them."""
    if not (n1 and n2 and n3):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))


def gram_logs(all_grams: DataFrame, tables: list) -> DataFrame:
    """(g, logp) for every gram: interpolated where the trusted text has it, else backed off order by order."""
    left = all_grams.select("g", F.lit(1.0).alias("w"))
    done = []
    for k in range(ORDER, 0, -1):
        p, gamma = tables[k - 1]
        here = left.withColumn("s", suffix(F.col("g"), k)).join(
            p.withColumnsRenamed({"g": "s"}), "s", "left")
        if k > 1:
            here = cut_lineage(here.select("g", "w", "p", F.shiftrightunsigned("s", BITS).alias("ctx")), f"kn-s{k}")
            left = here.where("p is null").join(gamma, "ctx", "left").select(
                "g", (F.col("w") * F.coalesce("gamma", F.lit(1.0))).alias("w"))
        else:
            here = here.withColumn("p", F.coalesce("p", F.lit(gamma / LETTERS)))
        done.append(here.where("p is not null").select("g", F.log(F.col("w") * F.col("p")).alias("logp")))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


# --- scoring by shards -------------------------------------------------------------------------------

class Shard:
    """gram -> logp of one shard."""

    def __init__(self, keys: np.ndarray, logs: np.ndarray) -> None:
        self.table = Slots(max(int(2 * len(keys)).bit_length(), 4))
        # the last place stands for grams of other shards
        self.logs = np.zeros((1 << self.table.bits) + 1, dtype=np.float32)
        self.logs[self.table.insert(keys)] = logs

    def get(self, g: np.ndarray) -> np.ndarray:
        """logp of every gram, 0 for grams of other shards."""
        return self.logs[self.table.locate(g)]


@lru_cache(maxsize=1)
def load_shard(path: str, shard: int) -> Shard:
    fs, where = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
        pyarrow.fs.LocalFileSystem(), path)
    files = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(f"{where}/shard={shard}", allow_not_found=True))
             if f.path.endswith(".parquet")]
    got = pa.concat_tables([pq.ParquetFile(fs.open_input_file(f.path)).read(columns=["g", "logp"]) for f in files])
    return Shard(got["g"].to_numpy(), got["logp"].to_numpy())


def write_shards(logs: DataFrame, spark: SparkSession) -> tuple[str, int]:
    """Writes (g, logp) in shards of about SHARD_GRAMS grams under the shared folder: (path, shards)."""
    logs = cut_lineage(logs, "kn-logs")
    n = max(1, math.ceil(logs.count() / SHARD_GRAMS))
    path = scratch_path(spark, "kn-shards")
    (logs.withColumn("shard", F.pmod(F.xxhash64("g"), F.lit(n)).cast("int")).repartition(n, "shard")
     .write.partitionBy("shard").parquet(path))
    return path, n


def mean_logs(path: str, n_shards: int):
    """Column function text -> mean log-probability of its letters (null for empty texts)."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        texts = list(text)
        total, letters = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        for shard in range(n_shards):
            s = load_shard(path, shard)
            for at, g, n in pieces(texts):
                full = n > 0
                if full.any():
                    first = (np.cumsum(n) - n)[full]
                    np.add.at(total, at[full], np.add.reduceat(s.get(g), first, dtype=np.float64))
                    if not shard:
                        np.add.at(letters, at[full], n[full])
        return pd.Series(np.where(letters > 0, total / np.maximum(letters, 1), np.nan)).astype(object).where(
            letters > 0, None).astype("Float64")

    return score


def marked_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, trusted) for every row of ``docs``."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    return docs.select("doc_id", "text", "lang").join(checked_broadcast(good), "doc_id", "left").withColumn(
        "trusted", F.coalesce("trusted", F.lit(False)))


def scores(marked: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, perplexity) for every row of ``marked``, by the model of its trusted rows."""
    counts = cut_lineage(count_grams(marked.select("text", "trusted")), "kn-grams")
    tables = model(counts.where("n > 0"))
    path, n = write_shards(gram_logs(counts, tables), marked.sparkSession)
    return marked.select("doc_id", "lang", "trusted", F.exp(-mean_logs(path, n)(F.col("text"))).alias("perplexity"))


def perplexities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, perplexity) for every row of ``docs`` (doc_id, text, lang)."""
    return scores(marked_docs(docs, labels))


def cross_fitted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, trusted, perplexity) of the trusted rows, each scored by the trusted rows of the other folds."""
    good = cut_lineage(marked_docs(docs, labels).where("trusted"), "kn-trusted")
    if good.isEmpty():
        return good.select("doc_id", "lang", "trusted", F.lit(None).cast("double").alias("perplexity"))
    fold, out = crc_mod(F.col("doc_id"), FOLDS), None
    for f in range(FOLDS):
        part = scores(good.withColumn("trusted", fold != f)).where("not trusted")
        out = part if out is None else out.unionAll(part)
    return out


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Adds threshold and keep (1 or 0) to ``perplexities``."""
    scored = cut_lineage(perplexities(docs, labels), "kn-scores")
    trusted = cut_lineage(cross_fitted(docs, labels), "kn-fitted").where("perplexity is not null")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    per = trusted.where("lang is not null").groupBy("lang").agg(cut.alias("own"), F.count("*").alias("n")).where(
        F.col("n") >= MIN_TRUSTED).select("lang", "own")
    overall = trusted.agg(cut).first()[0]
    out = scored.join(per, "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(overall).cast("double")))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.withColumn("keep", keep.cast("int")).select("doc_id", "lang", "perplexity", "threshold", "keep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep for every document."""
    return classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                    table(spark, sf_dir, "labels", "doc_id", "quality"))


__all__ = ["classify", "discounts", "grams", "perplexities", "query"]
