"""Hard-negative mining: cover trees over norm-augmented vectors, descended best first, exact.

Rows are (id, vector, label); a vector's components become floor(256 x). An anchor's positives are the first
``POSITIVES`` rows of its label by integer inner product (ties by smaller id); for each of them the hard negatives are
the first ``NEGATIVES`` rows of other labels with 30 x positive <= 100 x negative <= 90 x positive score.

Index: the rows of a label are dealt by hash into shards of about ``SHARD_ROWS``; a task builds a shard's cover tree. With the
component sqrt(M^2 - |x|^2) added (M: the shard's longest vector) all points lie on a sphere of radius M, where nearness is
inner product, so a node's covering radius, as an angle, bounds the product of a query with all that the node holds:
|q| M cos(angle to the centre -+ radius). Radii shrink by ``SHRINK`` a level; children are a greedy net of the parent's
points; nodes of few points are leaves. The trees are a written table, one row a shard; every row is indexed.

Search: anchors come in blocks; a task meets (tree, block) rows, keeps the best rows per anchor and window of all its trees
and passes those on. Of a tree it drops nodes, level by level, that lie outside all of an anchor's windows or
below its worst kept score, visits leaves in waves from the greatest bound on, and scores the points of visited leaves exactly.
Nothing is approximate: results equal a scan of all rows, also where the bounds prune nothing. Blocks are broadcast
only while their bytes stay under ``BROADCAST_BYTES``, else they are joined by (label, block).

Defined cases: rows with a null id, label or vector or a null or non-finite component take no part; rows with an anchor's own id
are no candidates of it; every row of a repeated id is a candidate, and asked by itself if it is an anchor; shorter
vectors count as filled up with zeros; negative positive scores have empty windows; products are exact
below 2^50; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, cut_lineage, table

POSITIVES, NEGATIVES = 5, 10
SHARD_ROWS, LEAF_ROWS, SHRINK = 2048, 32, 1.3
BLOCK_ANCHORS, HELD_BLOCKS = 256, 64
BROADCAST_BYTES = 64 << 20
#: Leaves per anchor that a wave visits; the last wave visits what is left.
WAVES = (2, 16)
NONE = np.iinfo(np.int64).min

TREE = "label long, ids binary, vectors binary, width int, nodes binary, leaves binary"
BLOCK = "label long, block long, anchors binary, ids binary, labels binary, vectors binary, width int, scores binary, positives binary"
FOUND = "anchor long, anchor_id long, positive_id long, positive_score long, id long, score long"
FOUND_ARROW = pa.schema([(n, pa.int64()) for n in ("anchor", "anchor_id", "positive_id", "positive_score", "id", "score")])


def whole_numbers(vectors: list) -> np.ndarray:
    """floor(256 x) of every component as doubles, rows filled up with zeros to one width."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = np.floor(256.0 * np.asarray(v, dtype=np.float64))
    return out


def narrow(x: np.ndarray) -> bytes:
    """Vectors as bytes: a letter for the type, then the least type that holds them."""
    top = np.abs(x).max() if x.size else 0
    kind = "h" if top < 2 ** 15 else "i" if top < 2 ** 31 else "d"
    return kind.encode() + x.astype(kind).tobytes()


def wide(data: bytes, width: int) -> np.ndarray:
    held = np.frombuffer(data, dtype=chr(data[0]), offset=1).astype(np.float64)
    return held.reshape(-1, width) if width else np.zeros((0, 0))


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


@dataclass
class Tree:
    """Points in leaf order; nodes by level: (parent, centre, covering angle); leaves: (node, first point, end)."""
    ids: np.ndarray
    x: np.ndarray
    nodes: np.ndarray
    leaves: np.ndarray

    def __post_init__(self):
        self.norm = float(np.sqrt((self.x * self.x).sum(axis=1).max())) if len(self.x) else 0.0
        self.rank = np.empty(len(self.ids), dtype=np.int64)              # places by id, for ties
        self.rank[np.argsort(self.ids, kind="stable")] = np.arange(len(self.ids))
        self.levels = []
        depth = np.zeros(len(self.nodes), dtype=np.int64)
        for i in range(1, len(self.nodes)):
            depth[i] = depth[int(self.nodes[i, 0])] + 1
        for d in range(int(depth.max(initial=-1)) + 1):
            self.levels.append(np.flatnonzero(depth == d))


def build_tree(ids: np.ndarray, x: np.ndarray) -> Tree:
    """Cover tree of a shard: greedy nets of shrinking radius, from one root down to leaves of few points."""
    norm2 = (x * x).sum(axis=1)
    top = max(float(norm2.max(initial=0)), 1.0)
    lift = np.sqrt(np.maximum(top - norm2, 0.0))
    cosine = np.clip((x @ x.T + lift[:, None] * lift[None, :]) / top, -1.0, 1.0)
    angle = np.arccos(cosine).astype(np.float32)
    np.fill_diagonal(angle, 0.0)
    nodes, leaves, order = [(-1, 0, 0.0)], [], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, members = todo.pop()
        centre = nodes[node][1]
        reach = angle[centre, members]
        radius = float(reach.max(initial=0.0))
        nodes[node] = (nodes[node][0], centre, radius)
        own = [members] if len(members) <= LEAF_ROWS or radius < 1e-6 else []
        if not own:
            small, rest = [], members
            net = radius / SHRINK
            near = rest[reach <= net]                                     # the centre covers its own again, one level down
            first = centre
            while len(rest):
                if len(near) == len(members):                             # nothing left to split off at this level
                    net /= SHRINK
                    near = rest[angle[first, rest] <= net]
                    continue
                if len(near) > LEAF_ROWS // 2:
                    nodes.append((node, int(first), 0.0))
                    todo.append((len(nodes) - 1, near))
                else:
                    small.append(near)
                gone = np.zeros(len(angle), dtype=bool)
                gone[near] = True
                rest = rest[~gone[rest]]
                if len(rest):
                    first = rest[0]
                    near = rest[angle[first, rest] <= net]
            # points in groups of few stay with this node, in leaves of their own
            loose = np.concatenate(small) if small else members[:0]
            own = [loose[i:i + LEAF_ROWS] for i in range(0, len(loose), LEAF_ROWS)]
        for part in own:
            if len(part):
                leaves.append((node, 0, len(part)))
                order.append(part)
    place = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
    held = np.array(leaves, dtype=np.int64).reshape(-1, 3)
    ends = np.cumsum(held[:, 2])
    held = np.stack([held[:, 0], ends - held[:, 2], ends], axis=1)
    where = np.empty(len(place), dtype=np.int64)
    where[place] = np.arange(len(place))
    table_ = np.array(nodes, dtype=np.float64).reshape(-1, 3)
    if len(place):
        table_[:, 1] = where[table_[:, 1].astype(np.int64)]
    return Tree(ids[place], x[place], table_, held)


class Best:
    """The first rows (score, id) per query and window so far."""

    def __init__(self, low: np.ndarray, high: np.ndarray, size: int):
        self.low, self.high = low, high                                  # (query, window)
        self.score = np.full((*low.shape, size), NONE, dtype=np.int64)
        self.id = np.zeros((*low.shape, size), dtype=np.int64)

    def bar(self) -> np.ndarray:
        """Scores below these can't enter a window's rows."""
        last = self.score[:, :, -1].astype(np.float64)
        return np.maximum(self.low, np.where(self.score[:, :, -1] == NONE, -np.inf, last))

    def take(self, scores: np.ndarray, seen: np.ndarray, tree: Tree, at: np.ndarray) -> None:
        """Merges the points ``at`` of a tree, whose ``scores`` (query, point) count where ``seen``."""
        size = self.score.shape[2]
        n = len(tree.ids)
        for w in range(self.low.shape[1]):
            inside = seen & (scores >= self.low[:, w, None]) & (scores <= self.high[:, w, None])
            asked = np.flatnonzero(inside.any(axis=1))
            if not len(asked):
                continue
            exact = np.where(inside[asked], scores[asked], 0).astype(np.int64)
            key = np.where(inside[asked], exact * n + (n - 1 - tree.rank[at]), NONE)
            if key.shape[1] > size:
                pick = np.argpartition(key, key.shape[1] - size, axis=1)[:, -size:]
            else:
                pick = np.broadcast_to(np.arange(key.shape[1]), key.shape)
            held = np.take_along_axis(key, pick, axis=1) != NONE
            score = np.where(held, np.take_along_axis(exact, pick, axis=1), NONE)
            score = np.concatenate([self.score[asked, w], score], axis=1)
            ids = np.concatenate([self.id[asked, w], tree.ids[at][pick]], axis=1)
            # greatest score first, then smallest id
            order = np.lexsort((ids, ~score), axis=1)[:, :size]
            self.score[asked, w] = np.take_along_axis(score, order, axis=1)
            self.id[asked, w] = np.take_along_axis(ids, order, axis=1)


def search(tree: Tree, q: np.ndarray, own: np.ndarray, best: Best, asked: np.ndarray) -> int:
    """Best-first search of one tree for the queries ``asked``; returns the number of points scored.

    ``own``: ids that are no candidates of their query. Only rows of ``best`` for ``asked`` change.
    """
    if not len(tree.ids) or not len(asked):
        return 0
    width = max(q.shape[1], tree.x.shape[1])
    q, x = fitted(q[asked], width), fitted(tree.x, width)
    view = Best(best.low[asked], best.high[asked], best.score.shape[2])
    view.score, view.id = best.score[asked], best.id[asked]
    size = np.sqrt((q * q).sum(axis=1))
    scale = size * max(tree.norm, 1.0)
    centre = x[tree.nodes[:, 1].astype(np.int64)]
    with np.errstate(invalid="ignore", divide="ignore"):
        theta = np.arccos(np.clip(np.nan_to_num((q @ centre.T) / scale[:, None]), -1.0, 1.0))
    radius = tree.nodes[:, 2][None, :] + 1e-5                              # more than single-precision angles are off by
    upper = scale[:, None] * np.cos(np.maximum(theta - radius, 0.0)) + 1.0 + 1e-9 * scale[:, None]
    lower = scale[:, None] * np.cos(np.minimum(theta + radius, np.pi)) - 1.0 - 1e-9 * scale[:, None]

    def wanted() -> np.ndarray:
        bar = view.bar()
        ok = np.zeros(upper.shape, dtype=bool)
        for w in range(bar.shape[1]):
            ok |= (upper >= bar[:, w, None]) & (lower <= view.high[:, w, None]) & (bar[:, w, None] <= view.high[:, w, None])
        for level in tree.levels[1:]:                                     # below a dropped node nothing is visited
            ok[:, level] &= ok[:, tree.nodes[level, 0].astype(np.int64)]
        return ok

    leaf_node, leaf_first, leaf_end = tree.leaves.T
    order = np.argsort(-upper[:, leaf_node], axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    done = np.zeros(rank.shape, dtype=bool)
    scored = 0
    for limit in (*WAVES, order.shape[1]):
        todo = wanted()[:, leaf_node] & (rank < limit) & ~done
        visit = np.flatnonzero(todo.any(axis=0))
        if not len(visit):
            continue
        done |= todo
        at = np.concatenate([np.arange(leaf_first[b], leaf_end[b]) for b in visit])
        seen = np.repeat(todo[:, visit], leaf_end[visit] - leaf_first[visit], axis=1)
        if seen.mean() > 0.3:
            scores = q @ x[at].T
        else:
            scores, begin = np.zeros(seen.shape), 0
            for b in visit:
                rows, n = np.flatnonzero(todo[:, b]), int(leaf_end[b] - leaf_first[b])
                scores[rows, begin:begin + n] = q[rows] @ x[leaf_first[b]:leaf_end[b]].T
                begin += n
        scored += int(seen.sum())
        seen &= tree.ids[at][None, :] != own[asked][:, None]
        view.take(np.rint(scores), seen, tree, at)
    best.score[asked], best.id[asked] = view.score, view.id
    return scored


def built(label: int, ids: np.ndarray, vectors: list) -> pd.DataFrame:
    tree = build_tree(ids, whole_numbers(vectors))
    return pd.DataFrame({"label": [label], "ids": [tree.ids.astype(np.int64).tobytes()], "vectors": [narrow(tree.x)],
                         "width": [tree.x.shape[1]], "nodes": [tree.nodes.tobytes()], "leaves": [tree.leaves.tobytes()]})


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, id, label, vector) of the rows that take part; ``row`` tells rows of one id apart."""
    fine = f"forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
    return (rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & F.expr(fine))
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")))


def dealt(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """Rows with the number of a part of about ``size`` rows of their keys, by hash, so that no key fills one task."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).alias("parts"))
    return rows.join(checked_broadcast(n), list(keys)).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))


def index(rows: DataFrame) -> DataFrame:
    """One row a shard with its cover tree."""
    def build(key, frame):
        return built(int(key[0]), frame["id"].to_numpy(np.int64), frame["vector"].tolist())

    return cut_lineage(dealt(rows, SHARD_ROWS, "label").groupBy("label", "part").applyInPandas(build, TREE), "cover-trees")


def blocks(anchors: DataFrame, by_label: bool) -> DataFrame:
    """One row a block of anchors (row, id, label, vector and, once known, scores and positives)."""
    def pack(key, frame):
        x = whole_numbers(frame["vector"].tolist())
        known = "scores" in frame
        low = [list(v) + [-1] * (POSITIVES - len(v)) for v in frame["scores"]] if known else []
        ids = [list(v) + [0] * (POSITIVES - len(v)) for v in frame["positives"]] if known else []
        return pd.DataFrame({
            "label": [int(key[0])], "block": [int(key[1])], "anchors": [frame["row"].to_numpy(np.int64).tobytes()],
            "ids": [frame["id"].to_numpy(np.int64).tobytes()], "labels": [frame["label"].to_numpy(np.int64).tobytes()],
            "vectors": [narrow(x)], "width": [x.shape[1]], "scores": [np.array(low, dtype=np.int64).tobytes()],
            "positives": [np.array(ids, dtype=np.int64).tobytes()]})

    group = F.col("label") if by_label else F.lit(0).cast("long")
    keyed = anchors.withColumn("group_", group)
    return cut_lineage(dealt(keyed, BLOCK_ANCHORS, "group_").groupBy("group_", "part").applyInPandas(pack, BLOCK), "anchor-blocks")


def met(trees: DataFrame, held: DataFrame, by_label: bool) -> DataFrame:
    """(tree, block) rows: every tree with the blocks that ask it, in all their numbers."""
    held = held.select(*[F.col(c).alias("b_" + c) for c in held.columns])
    size = held.agg(F.sum(F.length("b_vectors") + F.lit(64 * BLOCK_ANCHORS))).first()[0] or 0
    small = size <= BROADCAST_BYTES
    if by_label:
        numbers = held.groupBy(F.col("b_label").alias("label")).agg(F.collect_set("b_block").alias("asking"))
        asked = trees.join(F.broadcast(numbers) if small else numbers, "label")
        on = (F.col("label") == F.col("b_label")) & (F.col("asked") == F.col("b_block"))
    else:
        last = held.agg(F.max("b_block")).first()[0]
        every = F.array().cast("array<bigint>") if last is None else F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))
        asked = trees.withColumn("asking", every)
        on = F.col("asked") == F.col("b_block")
    asked = asked.withColumn("asked", F.explode("asking")).drop("asking")
    return asked.join(F.broadcast(held) if small else held, on)


def searched(pairs: DataFrame, size: int, negatives: bool) -> DataFrame:
    """Rows (anchor, candidate, score) that each task's trees have best; with ``negatives`` per positive's window."""
    def emit(block: dict, best: Best) -> Iterator[pa.RecordBatch]:
        query, window, place = np.nonzero(best.score != NONE)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (
            block["anchors"][query], block["ids"][query], block["positives"][query, window],
            block["scores"][query, window], best.id[query, window, place], best.score[query, window, place])],
            schema=FOUND_ARROW)

    def run(batches):
        state: OrderedDict[tuple, tuple[dict, Best]] = OrderedDict()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                tree = Tree(np.frombuffer(row["ids"], np.int64), wide(row["vectors"], row["width"]),
                            np.frombuffer(row["nodes"], np.float64).reshape(-1, 3),
                            np.frombuffer(row["leaves"], np.int64).reshape(-1, 3))
                name = (row["b_label"], row["b_block"])
                if name not in state:
                    block = {n: np.frombuffer(row["b_" + n], np.int64) for n in ("anchors", "ids", "labels")}
                    block["q"] = wide(row["b_vectors"], row["b_width"])
                    m = len(block["ids"])
                    if negatives:
                        block["scores"] = np.frombuffer(row["b_scores"], np.int64).reshape(m, POSITIVES)
                        block["positives"] = np.frombuffer(row["b_positives"], np.int64).reshape(m, POSITIVES)
                        low, high = -(-3 * block["scores"] // 10), 9 * block["scores"] // 10
                    else:
                        block["scores"] = block["positives"] = np.zeros((m, 1), dtype=np.int64)
                        low, high = np.full((m, 1), -np.inf), np.full((m, 1), np.inf)
                    state[name] = block, Best(low.astype(np.float64), high.astype(np.float64), size)
                    if len(state) > HELD_BLOCKS:
                        yield from emit(*state.popitem(last=False)[1])
                block, best = state[name]
                asked = np.flatnonzero((block["labels"] != row["label"]) if negatives else (block["labels"] == row["label"]))
                search(tree, block["q"], block["ids"], best, asked)
        for block, best in state.values():
            yield from emit(block, best)

    return pairs.mapInArrow(run, FOUND)


def first(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= size)


def mine(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Hard negatives of ``anchors`` (rows of ``usable``) among ``rows`` (all of them)."""
    trees = index(rows)
    found = first(searched(met(trees, blocks(anchors, True), True), POSITIVES, False), POSITIVES, "anchor")
    windows = found.groupBy(F.col("anchor").alias("row")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("best"))
    asking = anchors.join(windows, "row").select("row", "id", "label", "vector", F.col("best.score").alias("scores"),
                                                 F.col("best.id").alias("positives"))
    pairs = searched(met(trees, blocks(asking, False), False), NEGATIVES, True)
    # the positive's place among its anchor's keeps two positives of one id apart
    return first(pairs, NEGATIVES, "anchor", "positive_id", "positive_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    moved = raw.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    rows = cut_lineage(usable(moved, "vec_id", "embedding", "label"), "vectors")
    return (mine(rows, rows.where(F.col("id") % 100 == 0))
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")))


ORACLE = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.w, v.w) AS BIGINT) AS score
      FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 10
"""
