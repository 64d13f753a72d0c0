"""Periodic runs against a plain search of every period at every place, on tiles alone and through Spark."""

import hashlib
import random
import re
import zlib

import numpy as np

from smogline.llm import periodic

SCHEMA = "doc_id long, text string, uid string, runs long, period string"


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            for i in range(a, n):
                w[i] = w[a + (i - a) % p]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (key, len(runs), best[0], best[1], best[2], best[1] and 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def joined(texts):
    """Runs by tiles, stitched in plain Python."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    n = np.array([len(texts[i]) for i in order], dtype=np.int64)
    codes = np.array([c for i in order for c in texts[i]], dtype=np.int32)
    links = [{} for _ in texts]
    for t, low, high, place, anchors, tile in periodic.tiles(codes, np.cumsum(n) - n, n):
        for q, held in periodic.solve_tile(tile, anchors, low, high).items():
            links[order[t]].setdefault(q, []).extend((place + a, place + b) for a, b in held)
    out = []
    for by_period in links:
        found = []
        for q, held in by_period.items():
            whole = []
            for a, b in sorted(held):
                if whole and a <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], b)
                else:
                    whole.append([a, b])
            found += [(a, b - a + q, q) for a, b in whole if b - a + q >= max(6, 4 * q)]
        out.append(sorted(found, key=lambda r: (r[0], r[2])))
    return out


def made_words(rnd, longest, letters):
    n = rnd.randint(0, longest)
    w = [rnd.randrange(letters) for _ in range(n)]
    for _ in range(rnd.randint(0, 3)):
        if n > 8:
            p, a = rnd.randint(1, n // 5), rnd.randrange(n)
            for i in range(a, min(n, a + int(p * rnd.uniform(3, 7)))):
                w[i] = w[a + (i - a) % p]
    return w


def test_tiles_find_every_run():
    rnd = random.Random(5)
    for _ in range(120):
        texts = [made_words(rnd, rnd.choice([8, 40, 200, 600]), rnd.choice([1, 2, 3, 50])) for _ in range(rnd.randint(1, 6))]
        assert joined(texts) == [plain_runs(w) for w in texts]


def test_runs_over_many_tiles(monkeypatch):
    monkeypatch.setattr(periodic, "BLOCK_WORDS", 16)
    monkeypatch.setattr(periodic, "CELLS", 100)
    rnd = random.Random(6)
    texts = [made_words(rnd, 500, 3) for _ in range(30)] + [[7] * 300, [1, 2] * 200, [1, 2, 3, 4, 5, 6, 7, 8, 9] * 50]
    assert joined(texts) == [plain_runs(w) for w in texts]


def test_query_rows_against_brute_force(spark):
    rnd = random.Random(7)
    odd = [(1, None), (2, ""), (3, " \n\t "), (None, "a b a b a b a b"), (4, "x " * 50), (4, "x " * 50),
           (5, "a\x0bb\x0ca\x0bb a b a b"), (6, "é é " * 9), (7, "a b " * 8)]
    rows = odd + [(i, " ".join(f"w{c}" for c in made_words(rnd, 400, rnd.choice([2, 400])))) for i in range(10, 260)]
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, periodic.digest(docs).drop("n_words").collect()), key=repr)
    assert got == sorted((plain_row(k, t) for k, t in rows), key=repr)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows if k) >= 10


def test_long_text_empty_table_and_general_form(spark):
    long = " ".join(["once"] * 3 + [f"v{i % 5000}" for i in range(25_000)] + ["end"])
    docs = spark.createDataFrame([(1, long, "x", 1, "y"), (2, "no repeats here", "x", 1, "y")], SCHEMA)
    assert [tuple(r) for r in periodic.find_runs(docs).collect()] == [(1, 3, 25_000, 5000)]
    empty = periodic.digest(docs.where("false"))
    assert empty.count() == 0
    assert empty.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                 "collapsed_sha256"]
