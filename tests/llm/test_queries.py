"""The text operators on Spark: brute-force results on small tables, and nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from smogline.llm import (common, decontam, fingerprint, htmlmain, kneser, langid, linededup, queries, simhash, spm,
                          toxicity, warc)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [(1, None, "en"), (2, "", "en"), (3, "  \n\t", None), (4, "1234 !?", "de"), (5, LONG, "en"), (6, LONG, None),
       (None, "a row without an id, with some words in it", "en"), (8, "same words in both rows here", "en"),
       (8, "same words in both rows here", "en"), (9, "one", "fr")]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    return spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in ODD], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in (1, 2, 4, 5, 8, 9)] + [(8, None, None), (None, 1, 1)],
                                 "doc_id long, quality int, toxic int")


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    want = roots({x for ab in links for x in ab}, links)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if sum(v == r for v in want.values()) > 1}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, odd, labels):
    model = toxicity.train(odd, labels)
    scores = {(r["doc_id"], r["text"]): r["s"] for r in toxicity.with_scores(odd, model, "s").collect()}
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores.values()) and scores[(1, None)] == scores[(2, "")]
    assert toxicity.drop_toxic(odd, labels.limit(0)).count() == len(ODD)

    predict = langid.predictor(spark, langid.train(odd))
    langs = [(r["doc_id"], r["p"]["lang_pred"], r["p"]["score"]) for r in odd.withColumn("p", predict(F.col("text"))).collect()]
    assert {i: (g, s) for i, g, s in langs if i in (1, 2, 3, 4)} == {i: ("und", 0.0) for i in (1, 2, 3, 4)}
    assert all(0 < s <= 1 for i, _, s in langs if i not in (1, 2, 3, 4))

    tokens = spm.with_tokens(odd).collect()
    assert [r["n_tokens"] for r in tokens if r["doc_id"] in (1, 2)] == [0, 0]

    prints = fingerprint.fingerprints(odd).collect()
    by_id = {}
    for r in prints:
        by_id.setdefault(r["doc_id"], []).append(r)
    order = sorted(((i, t or "") for i, t, _ in ODD), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert len(prints) == len(ODD)
    want = sorted((hashlib.sha256(fingerprint.edited_text(t, order[(k + 1) % len(order)][1]).encode()).hexdigest(), len(t))
                  for k, (_, t) in enumerate(order))
    assert sorted((r["edited_sha256"], r["n_chars"]) for r in prints) == want
    assert by_id[5][0]["fingerprint"] == by_id[6][0]["fingerprint"] and by_id[6][0]["near_next"] == 1.0

    comp = {(r["doc_id"], r["fp"]): r["component_id"] for r in simhash.with_components(odd).collect()}
    assert {i: c for (i, _), c in comp.items() if i in (1, 2, 3, 5, 6)} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [None, 1, 4, 5, 8, 8, 9]))

    lines = linededup.drop_lines(odd)
    assert lines.columns == odd.columns and lines.count() == len(ODD)
    assert {r["doc_id"]: r["text"] for r in lines.collect() if r["doc_id"] in (5, 6, 9)} == {5: LONG, 6: "", 9: "one"}

    bench = spark.createDataFrame([(1, None), (2, ""), (3, "some words in it"), (4, " ".join(LONG.split()[500:560]))],
                                  "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.contaminated(odd, bench).collect()}
    assert found == {(None, 3): 0, (5, 4): 0, (6, 4): 0}
    assert {r["doc_id"] for r in decontam.drop_contaminated(odd, bench).collect()} == {None, 1, 2, 3, 4, 8, 9}
    assert decontam.contaminated(odd, bench.limit(0)).count() == 0

    judged = kneser.classify(odd, labels).collect()
    assert len(judged) == len(ODD) and all((r["perplexity"] is None) == (r["doc_id"] in (1, 2)) for r in judged)
    assert all(r["keep"] == 0 for r in judged if r["doc_id"] in (1, 2))
    blind = kneser.classify(odd, labels.limit(0)).collect()
    assert all(r["keep"] == (r["perplexity"] is not None) for r in blind)


def test_empty_tables(spark, odd, labels):
    none = odd.limit(0)
    assert toxicity.drop_toxic(none, labels).count() == 0
    assert langid.train(none).langs == []
    assert fingerprint.fingerprints(none).count() == 0
    assert linededup.drop_lines(none).count() == 0
    assert simhash.with_components(none).count() == 0
    assert decontam.contaminated(none, spark.createDataFrame([(1, "x" * 80)], "item_id long, text string")).count() == 0
    assert kneser.classify(none, labels).count() == 0
    assert spm.with_tokens(none).count() == 0 and spm.with_round_trip(none).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.as_records(pages).count() == 0
    assert pages.select(htmlmain.extractor()(F.col("html"))).count() == 0


def test_extra_and_clashing_columns(spark, odd, labels):
    more = odd
    for c in ("toxicity_score", "doc_id_gone", "line_nos_gone", "doc_id_lines", "doc_id_leak", "root", "first", "pid", "halo"):
        more = more.withColumn(c, F.lit(7))
    bench = spark.createDataFrame([(3, "some words in it")], "item_id long, text string")
    for out in (toxicity.drop_toxic(more, labels.limit(0)), linededup.drop_lines(more), simhash.keep_one(more),
                decontam.drop_contaminated(more, bench)):
        assert out.columns == more.columns and out.select("root").distinct().count() == 1


@pytest.mark.parametrize("distance,bucket_rows", [(2, 48), (2, 1), (3, 1)])
def test_simhash_links(spark, distance, bucket_rows):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist()[:20]:
        for _ in range(12):
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                f ^= 1 << int(b)
            fps.add(f)
    vals = sorted(simhash.signed(f) for f in fps)
    links = [(a, b) for i, a in enumerate(vals) for b in vals[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= distance]
    want = roots(vals, links)
    found = simhash.classes(spark.createDataFrame([(v,) for v in vals], "fp long"), distance, bucket_rows=bucket_rows)
    got = {r["fp"]: r["root"] for r in found.collect()}
    assert {v: got.get(v, v) for v in vals} == want


@pytest.mark.parametrize("bucket_rows", [64, 2])
def test_line_dedup_against_brute_force(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(linededup, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefg"), int(rng.integers(1, 7))))
    bases = [" ".join(word() for _ in range(int(rng.integers(6, 12)))) for _ in range(25)] + ["short", "Short"]

    def vary(s):
        t = list(s)
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(len(t)))] = str(rng.choice(list("abcxyz ")))
        return "".join(t)

    docs = [(i, "\n".join(vary(bases[int(rng.integers(len(bases)))]) for _ in range(int(rng.integers(1, 6))))) for i in range(80)]
    every = [(i, k, s) for i, t in docs for k, s in enumerate(t.split("\n")) if s.strip()]
    names = sorted({s for _, _, s in every})
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]
             if edit_distance(a, b) <= max(len(a), len(b)) // 20]
    of = roots(names, links)
    first = {}
    for i, k, s in sorted(every):
        first.setdefault(of[s], (i, k))
    want = {(i, "\n".join(s for k, s in enumerate(t.split("\n")) if not s.strip() or first[of[s]] == (i, k))) for i, t in docs}
    got = linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == want
    assert len(links) > 20


@pytest.mark.parametrize("bucket_rows", [64, 1])
def test_long_lines_lose_their_near_copies(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(linededup, "BUCKET_ROWS", bucket_rows)
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    bases = [" ".join(word() for _ in range(int(rng.integers(40, 90)))) for _ in range(12)]
    other = [b.replace(b.split()[9], "replaced", 1) for b in bases]
    docs = [(i, b) for i, b in enumerate(bases)] + [(100 + i, f"{b}\nown {i}") for i, b in enumerate(other)]
    got = {r["doc_id"]: r["text"] for r in linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: b for i, b in enumerate(bases)} | {100 + i: f"own {i}" for i in range(12)}


@pytest.mark.parametrize("bucket_rows", [64, 2])
def test_lines_of_all_lengths_against_all_pairs(spark, bucket_rows, monkeypatch):
    """Lines of 5 to 400 letters with up to a few more edits than allowed: classes equal those of all near pairs."""
    monkeypatch.setattr(linededup, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(linededup, "BLOCK_ROWS", 3)
    rng = np.random.default_rng(11)
    bases = ["".join(rng.choice(list("abcdefghijkl "), int(n))) for n in (5, 19, 20, 25, 39, 40, 58, 59, 60, 61, 79, 80, 99, 120, 200, 400)]

    def vary(s):
        t = list(s)
        for _ in range(int(rng.integers(0, len(s) // 20 + 2))):
            i = int(rng.integers(len(t)))
            kind = int(rng.integers(3))
            t[i:i + (kind != 1)] = [] if kind == 0 and len(t) > 1 else [str(rng.choice(list("xyzabc")))]
        return "".join(t)

    docs = [(i, "\n".join(vary(bases[int(rng.integers(len(bases)))]) for _ in range(int(rng.integers(1, 4))))) for i in range(110)]
    every = [(i, k, s) for i, t in docs for k, s in enumerate(t.split("\n")) if s.strip()]
    names = sorted({s for _, _, s in every})
    links = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]
             if abs(len(a) - len(b)) <= max(len(a), len(b)) // 20 and edit_distance(a, b) <= max(len(a), len(b)) // 20]
    of = roots(names, links)
    first = {}
    for i, k, s in sorted(every):
        first.setdefault(of[s], (i, k))
    want = {(i, "\n".join(s for k, s in enumerate(t.split("\n")) if not s.strip() or first[of[s]] == (i, k))) for i, t in docs}
    got = linededup.drop_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in got.collect()} == want
    assert {len(a) // 100 for a, _ in links} >= {0, 1, 3}


def test_kneser_against_plain_model(spark):
    """Perplexities against a dictionary form of interpolated modified Kneser-Ney."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "on and on and on", "zebra"]
    trusted = [True, True, True, False, False]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labs = spark.createDataFrame([(i, int(q)) for i, q in enumerate(trusted)], "doc_id long, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in kneser.perplexities(docs, labs).collect()}
    n = kneser.ORDER
    gram = lambda t: [tuple(([0] * n + [ord(c) for c in t])[i + 1:i + n + 1]) for i in range(len(t))]
    top = {}
    for t, q in zip(texts, trusted):
        for g in gram(t) if q else ():
            top[g] = top.get(g, 0) + 1
    tables = []
    for k in range(1, n + 1):
        c = {}
        if k == n:
            c = dict(top)
        else:
            for longer in {g[n - k - 1:] for g in top}:
                c[longer[1:]] = c.get(longer[1:], 0) + 1
        of = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        tables.append((c, kneser.discounts(*of)))

    def gamma(ctx, k):
        c, d = tables[k - 1]
        mine = {g: v for g, v in c.items() if g[:-1] == ctx}
        return sum(d[min(v, 3) - 1] for v in mine.values()) / sum(mine.values()) if mine else 1.0

    def prob(g):
        k = len(g)
        if not k:
            return 1.0 / kneser.LETTERS
        c, d = tables[k - 1]
        total = sum(v for x, v in c.items() if x[:-1] == g[:-1])
        own = c.get(g, 0)
        direct = (own - d[min(own, 3) - 1]) / total if own else 0.0
        return direct + gamma(g[:-1], k) * prob(g[1:])

    for i, t in enumerate(texts):
        want = np.exp(-np.mean([np.log(prob(g)) for g in gram(t)]))
        assert got[i] == pytest.approx(want, rel=1e-4)


def test_kneser_keeps_clean_documents_it_has_not_seen(spark):
    """Fresh documents of the trusted ones' kind are kept: thresholds come from held-out scores."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(3, 9)))) for _ in range(3000)]
    docs = [(i, " ".join(rng.choice(words, 40)), "en") for i in range(160)]
    docs += [(i, "".join(rng.choice(list("qrstuvwxyz0123456789"), 200)), "en") for i in range(160, 180)]
    labs = spark.createDataFrame([(i, 1) for i in range(80)], "doc_id long, quality int")
    keep = {r["doc_id"]: r["keep"] for r in kneser.classify(
        spark.createDataFrame(docs, "doc_id long, text string, lang string"), labs).collect()}
    assert sum(keep[i] for i in range(80, 160)) >= 72 and not any(keep[i] for i in range(160, 180))


def test_warc_source(spark, tmp_path):
    warc.register(spark)
    pages = spark.createDataFrame([(3, "u3", "<p>one</p>"), (1, "u1", "<p>one</p>"), (2, None, None), (4, "u4", ""),
                                   (5, "u5", "é" * 5000), (None, "u6", "x")], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.as_records(pages).repartition(3).write.format("warc").mode("append").save(path)
    open(os.path.join(path, "part-lost.warc"), "w").write("not committed")
    back = spark.read.format("warc").option("rangeBytes", 64).load(path)
    got = {r["record_id"]: (r["warc_type"], r["refers_to"], r["payload_bytes"], r["payload"]) for r in back.collect()}
    assert got["3"] == ("revisit", "1", 10, None) and got["1"][:3] == ("response", None, 10)
    assert got["2"] == ("response", None, 0, b"") and got["4"][:2] == ("revisit", "2") and got["5"][2] == 10000
    assert [r["record_id"] for r in back.where("warc_type = 'revisit' and record_id >= '4'").collect()] == ["4"]
    light = spark.read.format("warc").option("payload", "false").load(path)
    assert {r["record_id"]: r["payload_bytes"] for r in light.collect() if r["record_id"] == "5"} == {"5": 10000}
    plain = warc.as_records(pages, min_bytes=11)
    assert plain.where("warc_type = 'revisit'").count() == 0


def test_registered_queries_are_whole(spark):
    sf = "/root/testdata/sf0.001"
    assert set(queries.QUERIES) == {f"op{n}_{s}" for n, s in enumerate(
        ["toxicity", "warc", "fingerprint", "linededup", "sentencepiece", "langid", "simhash", "htmlmain", "decontam",
         "kneser", "hardneg", "secrets", "periodic"], 1)}
    n_docs, n_pages = (spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages"))
    for name, rows in (("op2_warc", n_pages), ("op8_htmlmain", n_pages), ("op3_fingerprint", n_docs), ("op5_sentencepiece", n_docs)):
        assert queries.QUERIES[name](spark, sf).count() == rows


def test_pipeline(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "sentencepiece"]
    assert out.columns == docs.columns + ["token_ids", "n_tokens", "round_trip"]
    assert out.where("not round_trip or n_tokens <> size(token_ids)").count() == 0
    ids = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 0.5 * docs.count() < len(ids) < docs.count()
