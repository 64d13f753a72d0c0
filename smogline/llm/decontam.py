"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit check.

A document is contaminated by an item when some stretch of it is within ``rate`` x (letters of the item) edits,
rounded down, of the whole item (letters lower-cased, runs of blanks as one blank): one rule for all lengths.

1. Windows. A stretch within k edits of an item of L letters shares at least L + 1 - q (k + 1) of its q-grams
   (the q-gram lemma; q is 10, or 6 for short items). Each hit of a gram in a bitmap of the items' grams votes
   for the begin that its place in the item implies; begins with so many votes of one item and document within
   2 k letters are item-sized windows, at any letter of the text. Grams that many items share don't vote where
   the rest can still decide (each one left out lowers the votes needed by one). No near stretch is lost here.
2. CGK embedding. A window is walked by random bits r(step, letter): each step writes the letter at hand and
   moves on by the bit, which maps edit distance to Hamming distance of the written strings.
3. Bit sampling. Each of R repetitions has a walk of its own and samples ``K`` written letters as an LSH key; a
   window meets an item where a key is equal. R is set for each class of like lengths: ``COPIES`` fresh copies
   with all allowed edits are embedded, and R grows until the lower 95 % bound (Wilson) of the share that meets
   its item reaches ``RECALL``. A class for which ``EXACT_BEYOND`` repetitions don't reach it uses no keys: all its
   windows are verified.
4. Windows that meet an item are verified exactly: bit-parallel (Myers) edit distance of the whole item against
   the best stretch of the windows and their margin.

The benchmark is read in blocks of at most ``BLOCK_LETTERS`` letters, each broadcast for one pass over the
documents, so its size is bounded per pass and all items are used. Votes are counted for ranges of items and
letters that give at most ``VOTES`` of them, so frequent grams cost time, not memory.

Defined results: null and empty documents and items without letters never match; items too short for one edit
are searched as whole strings; equal items each give a row; a pair is returned once, with its least distance and
first such place; places count in the folded text (lower case, single blanks).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, fresh_name, mix64, ranges, table

Q = 10
Q_SHORT = 6
RATE = 0.08
K = 3
RECALL = 0.99
COPIES = 800
EXACT_BEYOND = 512
COMMON = 8
VOTES = 1 << 21
BLOCK_LETTERS = 1 << 20
GROUP = 1 << 22
GRAM_BITS = 23


def fold(text: str | None) -> str:
    return " ".join((text or "").split()).lower()


def allowed(letters: int, rate: float = RATE) -> int:
    return int(letters * rate + 1e-9)


def gram_hashes(c: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash (GRAM_BITS) of the q letters from every place; the last q - 1 places are left out."""
    h = np.zeros(max(len(c) - q + 1, 0), dtype=np.uint32)
    for k in range(q):
        h *= np.uint32(0x01000193)
        h += c[k:k + len(h)]
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)


def walk_plan(letters: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Walks ``lo`` to ``hi`` - 1 for strings of at least ``letters``: the words that hash (step, letter) to a bit,
    and the sampled steps of each walk."""
    steps = np.stack([np.sort(np.random.default_rng([letters, r]).choice(2 * letters, size=K, replace=False))
                      for r in range(lo, hi)])
    at = np.arange(2 * letters, dtype=np.uint64)[:, None] << np.uint64(32)
    return mix64(at + np.arange(lo, hi, dtype=np.uint64)[None, :] + np.uint64(1)), steps


def lsh_keys(windows: np.ndarray, plan: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """CGK walks of many windows (rows of letters, 0-padded), all repetitions side by side: (windows x
    repetitions) keys of the letters written at the sampled steps."""
    words, steps = plan
    mul, add = (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), words.astype(np.uint32)
    n, width = windows.shape
    repeats = len(steps)
    base, flat = (np.arange(n) * width)[:, None], np.ascontiguousarray(windows).ravel()
    spread = flat * np.uint32(0x9E3779B1)
    spread ^= spread >> np.uint32(15)
    at = np.zeros((n, repeats), dtype=np.int64)
    key = np.zeros((n, repeats), dtype=np.uint64)
    writes: dict[int, list[int]] = {}
    for r, own in enumerate(steps.tolist()):
        for step in own:
            writes.setdefault(step, []).append(r)
    for step in range(int(steps.max()) + 1):
        place = base + np.minimum(at, width - 1)
        if step in writes:
            own = writes[step]
            key[:, own] = mix64(key[:, own] * np.uint64(0x9E3779B97F4A7C15) + flat[place[:, own]] + np.uint64(1))
        at += (spread[place] * mul[step] + add[step]) >> np.uint32(31)
    return key


def lower_bound(found: int, n: int) -> float:
    """Lower end of the two-sided 95 % Wilson interval of a share."""
    z, p = 1.96, found / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def edited_copies(texts: list[str], rate: float, seed: int = 3) -> list[str]:
    """Each text with as many random edits as ``rate`` allows."""
    rng, out = np.random.default_rng(seed), []
    for t in texts:
        s = list(t)
        for _ in range(allowed(len(t), rate)):
            at, kind = int(rng.integers(len(s))), int(rng.integers(3))
            letter = t[int(rng.integers(len(t)))]
            if kind == 0:
                s[at] = letter
            elif kind == 1:
                s.insert(at, letter)
            elif len(s) > 1:
                del s[at]
        out.append("".join(s))
    return out


def padded(texts: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(texts), width), dtype=np.uint32)
    for i, t in enumerate(texts):
        out[i, :min(len(t), width)] = t[:width]
    return out


def repetitions(texts: list[str], letters: int, width: int, rate: float, seed: int = 3) -> int:
    """The least number of repetitions (in steps of 16) that reaches ``RECALL`` on fresh copies; 0: none does."""
    some = (texts * -(-COPIES // len(texts)))[:max(COPIES, len(texts))]
    some = some[:: max(len(some) // COPIES, 1)][:COPIES]
    ways, back = np.unique(some, return_inverse=True)
    a = padded([code_points(t) for t in ways], width)
    b = padded([code_points(t) for t in edited_copies(some, rate, seed)], width)
    met = np.zeros(len(some), dtype=bool)
    for lo in range(0, EXACT_BEYOND, 16):
        plan = walk_plan(letters, lo, lo + 16)
        left = np.flatnonzero(~met)
        met[left] = (lsh_keys(a, plan)[back[left]] == lsh_keys(b[left], plan)).any(1)
        if lower_bound(int(met.sum()), len(met)) >= RECALL:
            return lo + 16
    return 0


def edit_end(item: str, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end) of the best stretch of ``text`` for the whole ``item`` (Myers' bit vectors); anchored
    stretches begin where the text begins."""
    m = len(item)
    peq: dict[str, int] = {}
    for i, ch in enumerate(item):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text, 1):
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        # without the anchor a match may begin anywhere in the text
        ph, mh = (ph << 1 | anchored) & full, (mh << 1) & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


@dataclass
class Block:
    """Items of one pass: their grams and LSH keys by class of like length, and the items without edits."""
    classes: list[dict]
    whole: list[tuple[int, str]]
    rate: float

    def bitmap(self, q: int) -> np.ndarray:
        """Bitmap of the items' voting grams of q letters; made once a process."""
        maps = self.__dict__.setdefault("_maps", {})
        if q not in maps:
            maps[q] = np.zeros(1 << GRAM_BITS, dtype=bool)
            for cl in self.classes:
                if cl["q"] == q:
                    maps[q][cl["grams"]] = True
        return maps[q]


def build(items: list[tuple[int, str]], rate: float = RATE) -> Block:
    """Items are grouped into classes of like length (a factor of 1.25), each with windows of its own size."""
    items = [(i, fold(t)) for i, t in items]
    items = [(i, t) for i, t in items if t]
    whole = [(i, t) for i, t in items if not allowed(len(t), rate)]
    rest = sorted(((len(t) // (allowed(len(t), rate) + 1) < Q, len(t), i, t) for i, t in items if allowed(len(t), rate)),
                  key=lambda x: (not x[0], x[1]))
    classes = []
    while rest:
        small, low = rest[0][:2]
        own = [(i, t) for s, n, i, t in rest if s == small and n <= 1.25 * low]
        rest = rest[len(own):]
        classes.append(build_class(own, min(Q_SHORT, low // (allowed(low, rate) + 1)) if small else Q, rate))
    return Block(classes, whole, rate)


def build_class(own: list[tuple[int, str]], q: int, rate: float) -> dict:
    letters = [code_points(t) for _, t in own]
    limits = np.array([allowed(len(t), rate) for _, t in own], dtype=np.int64)
    needs = np.array([len(t) for _, t in own], dtype=np.int64) + 1 - q * (limits + 1)
    marks = [gram_hashes(c, q) for c in letters]
    shared = np.bincount(np.concatenate([np.unique(g) for g in marks]), minlength=1 << GRAM_BITS)
    votes = []
    for n, g in enumerate(marks):
        # the most shared grams don't vote while at least a quarter of the votes needed is left
        most = np.argsort(-shared[g], kind="stable")[:max(int(needs[n]) - max(int(needs[n]) // 4, 1), 0)]
        most = most[shared[g[most]] > COMMON]
        needs[n] -= len(most)
        votes.append(np.setdiff1d(np.arange(len(g)), most))
    grams, offsets = np.concatenate([g[v] for g, v in zip(marks, votes, strict=True)]), np.concatenate(votes)
    owner = np.repeat(np.arange(len(own)), [len(v) for v in votes])
    by_gram = np.argsort(grams, kind="stable")
    low, width = min(len(c) for c in letters), max(len(c) for c in letters)
    embed = max(low - allowed(low, rate), 1 + K // 2)
    repeats = repetitions([t for _, t in own], embed, width, rate)
    keys = lsh_keys(padded(letters, width), walk_plan(embed, 0, repeats)) if repeats else None
    return {"items": own, "q": q, "grams": grams[by_gram], "offsets": offsets[by_gram], "owner": owner[by_gram],
            "needs": needs, "limits": limits, "width": width, "embed": embed, "repeats": repeats, "keys": keys}


def find(block: Block, ids: list, texts: list[str | None]) -> Iterator[tuple]:
    """(doc, item, start, end, distance): the best place of each pair found in the texts."""
    folded = [fold(t) for t in texts]
    at, n = 0, len(folded)
    while at < n:
        size, hi = 0, at
        while hi < n and size < GROUP:
            size += len(folded[hi]) + 1
            hi += 1
        yield from _find_group(block, ids[at:hi], folded[at:hi])
        at = hi


def _find_group(block: Block, ids: list, texts: list[str]) -> Iterator[tuple]:
    joined = "\0".join(texts) + "\0"
    for item, t in block.whole:
        if t in joined:
            for k, text in enumerate(texts):
                if (p := text.find(t)) >= 0:
                    yield ids[k], item, p, p + len(t), 0
    c = code_points(joined)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    for q in sorted({cl["q"] for cl in block.classes}):
        grams = gram_hashes(c, q)
        pos = np.flatnonzero(block.bitmap(q)[grams])
        for cl in block.classes:
            if cl["q"] != q or not len(pos):
                continue
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for windows in _windows(cl, first, pos, grams[pos]):
                for k, item, dist, start, stop in _verify(cl, texts, first, *_meet(cl, c, *windows)):
                    if (k, item) not in best or (dist, start) < best[k, item][:2]:
                        best[k, item] = dist, start, stop
            for (k, item), (dist, start, stop) in sorted(best.items()):
                yield ids[k], cl["items"][item][0], start, stop, dist


def _windows(cl: dict, first: np.ndarray, pos: np.ndarray, grams: np.ndarray) -> Iterator[tuple]:
    """(document, item, begin) of the windows with enough votes, in parts of at most ``VOTES`` votes (or the least
    range of letters that can hold a window)."""
    lo, hi = np.searchsorted(cl["grams"], grams, "left"), np.searchsorted(cl["grams"], grams, "right")
    met = hi > lo
    pos, lo, hi = pos[met], lo[met], hi[met]
    margin = cl["width"] + 4 * int(cl["limits"].max())
    # votes of an entry, then of an item
    mass = np.cumsum(np.bincount(lo, minlength=len(cl["grams"]) + 1) - np.bincount(hi, minlength=len(cl["grams"]) + 1))
    per_item = np.bincount(cl["owner"], weights=mass[:-1], minlength=len(cl["items"]))
    todo = [(0, len(cl["items"]), 0, int(first[-1]))]
    while todo:
        i, j, a, b = todo.pop()
        if a == 0 and b == int(first[-1]):
            total = per_item[i:j].sum()
        own_pos = slice(np.searchsorted(pos, a), np.searchsorted(pos, b))
        if a or b < int(first[-1]):
            total = (hi[own_pos] - lo[own_pos]).sum()       # at most: other items' votes count too
        if total == 0:
            continue
        if total > VOTES and j - i > 1:
            todo += [(i, (i + j) // 2, a, b), ((i + j) // 2, j, a, b)]
            continue
        if total > VOTES and b - a > 4 * margin:
            half = (a + b) // 2
            todo += [(i, j, a, half + margin), (i, j, half - margin, b)]
            continue
        p, l, h = pos[own_pos], lo[own_pos], hi[own_pos]
        if j - i < len(cl["items"]):
            yield from _voted(cl, first, p, l, h, i, j)
        else:
            yield from _voted(cl, first, p, l, h, None, None)


def _voted(cl: dict, first: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, i: int | None,
           j: int | None) -> Iterator[tuple]:
    if i is not None:       # entries of these items alone
        kept = np.flatnonzero((cl["owner"] >= i) & (cl["owner"] < j))
        lo, hi = np.searchsorted(kept, lo), np.searchsorted(kept, hi)
        own = kept[ranges(lo, hi - lo)]
    else:
        own = ranges(lo, hi - lo)
    at = np.repeat(pos, hi - lo)
    begin, item = at - cl["offsets"][own], cl["owner"][own]
    doc = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((begin, doc, item))
    begin, item, doc = begin[order], item[order], doc[order]
    # the shared grams of a stretch with k edits agree within k letters of its begin, wherever that is
    last = np.arange(len(begin)) + cl["needs"][item] - 1
    at = np.flatnonzero(last < len(begin))
    to = last[at]
    at, to = (x[(item[to] == item[at]) & (doc[to] == doc[at]) & (begin[to] - begin[at] <= 2 * cl["limits"][item[at]])]
              for x in (at, to))
    # every begin that one of these votes names is a window; groups of windows are verified together
    named = np.zeros(len(begin) + 1, dtype=np.int64)
    np.add.at(named, at, 1)
    np.add.at(named, to + 1, -1)
    at = np.flatnonzero(np.cumsum(named[:-1]) > 0)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (begin[at][1:] != begin[at][:-1]) | (item[at][1:] != item[at][:-1]) | (doc[at][1:] != doc[at][:-1])
    at = at[new]
    if len(at):
        yield doc[at], item[at], begin[at]


def _meet(cl: dict, c: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray) -> tuple:
    """The windows within 2 k letters of one that has an LSH key of the item. Windows still without one take
    their next repetitions, so plain copies cost few."""
    near = cl["limits"][item]
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] - begin[:-1] > 2 * near[1:])
    group = np.cumsum(new) - 1
    if not cl["repeats"]:
        return doc, item, begin, group
    met = np.zeros(int(group[-1]) + 1, dtype=bool)
    step = 8
    for lo in range(0, cl["repeats"], step):
        left = np.flatnonzero(~met[group])
        if not len(left):
            break
        places, back = np.unique(begin[left], return_inverse=True)
        plan = walk_plan(cl["embed"], lo, min(lo + step, cl["repeats"]))
        for a in range(0, len(places), 4096):
            some = places[a:a + 4096]
            at = some[:, None] + np.arange(cl["width"])[None, :]
            windows = np.where((at >= 0) & (at < len(c)), c[np.clip(at, 0, len(c) - 1)], np.uint32(0))
            keys = lsh_keys(windows, plan)
            own = left[(back >= a) & (back < a + 4096)]
            row = back[(back >= a) & (back < a + 4096)] - a
            for b in range(0, len(own), 1 << 18):
                some_own, some_row = own[b:b + (1 << 18)], row[b:b + (1 << 18)]
                hit = (keys[some_row] == cl["keys"][item[some_own], lo:lo + keys.shape[1]]).any(1)
                met[group[some_own[hit]]] = True
    keep = met[group]
    return doc[keep], item[keep], begin[keep], group[keep]


def _verify(cl: dict, texts: list[str], first: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray,
            group: np.ndarray) -> Iterator[tuple]:
    """(document, item, distance, start, end) of the best stretch of each group of windows (there may be none)."""
    if not len(group):
        return
    cut = np.flatnonzero(np.diff(group, prepend=-1))
    done: set[tuple[int, int]] = set()
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(group)], strict=True):
        k, i = int(doc[a]), int(item[a])
        if (k, i) in done:
            continue
        t, limit, base, best = cl["items"][i][1], int(cl["limits"][i]), int(first[k]), None
        checked_to = -(1 << 62)
        for p in begin[a:b].tolist():
            if p <= checked_to:
                continue
            # one check covers all windows within its margin: stretches begin within ``limit`` of a vote
            checked_to = p + 2 * limit
            lo, hi = max(p - limit - base, 0), checked_to - base + len(t) + 2 * limit
            dist, stop = edit_end(t, texts[k][lo:hi])
            if dist <= limit and (best is None or dist < best[0]):
                best = (dist, lo + _begin(t, texts[k][lo:lo + stop]), lo + stop)
                if not dist:
                    done.add((k, i))
                    break
        if best:
            yield k, i, *best


def _begin(item: str, text: str) -> int:
    """Begin of the best stretch that ends where ``text`` ends (the search backwards)."""
    return len(text) - edit_end(item[::-1], text[::-1][:2 * len(item)], anchored=True)[1]


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, start, end, distance) of every contaminated pair."""
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = "doc_id string, item_id string, start long, end long, distance int"
    out = spark.createDataFrame([], schema)
    held: list[tuple] = []
    size = 0

    def scan(items: list[tuple]) -> DataFrame:
        block = spark.sparkContext.broadcast(build(items, rate))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = list(find(block.value, list(pdf.doc_id), list(pdf.text)))
                if got:
                    yield pd.DataFrame(got, columns=["doc_id", "item_id", "start", "end", "distance"])

        return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(search, schema)

    found = None
    for row in benchmark.where("text is not null").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        held.append(tuple(row))
        size += len(row[1])
        if size >= BLOCK_LETTERS:
            found = scan(held) if found is None else found.unionAll(scan(held))
            held, size = [], 0
    if held:
        found = scan(held) if found is None else found.unionAll(scan(held))
    out = out if found is None else found
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("item_id").cast(item_kind).alias("item_id"),
                      "start", "end", "distance")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents that hold no item (same columns); rows with a null doc_id stay."""
    name = fresh_name(docs, "doc_id_leak")
    leak = contaminated(docs, benchmark, rate).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leak, docs["doc_id"] == leak[name], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, distance of all contaminated pairs."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"),
                        table(spark, sf_dir, "benchmark", "item_id", "text"))
