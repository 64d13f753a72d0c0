"""Numpy pieces of the text operators against plain brute force (no Spark)."""

import base64
import hashlib
import io
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from smogline.llm import decontam, fingerprint, htmlmain, kneser, langid, linededup, simhash, spm, toxicity, warc


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def random_text(rng, n, letters="abcd "):
    return "".join(rng.choice(letters) for _ in range(n))


def edited(rng, s, k, letters="abcd "):
    t = list(s)
    for _ in range(k):
        kind, at = rng.randrange(3), rng.randrange(len(t))
        if kind == 0:
            t[at] = rng.choice(letters)
        elif kind == 1:
            t.insert(at, rng.choice(letters))
        elif len(t) > 1:
            del t[at]
    return "".join(t)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 9, 31])
def test_banded_edit_distance(k):
    rng = random.Random(k)
    a = [random_text(rng, rng.randint(0, 30 + 4 * k)) for _ in range(800 if k < 9 else 200)] + ["", "", "abc"]
    b = [edited(rng, s, rng.randint(0, 5 + 2 * k)) if s else "a" for s in a[:-3]] + ["", "ab", ""]
    got = linededup.within(a, b, k)
    assert [bool(x) for x in got] == [edit_distance(x, y) <= k for x, y in zip(a, b)]


def test_line_signatures_meet_for_all_near_pairs():
    rng = random.Random(5)
    for _ in range(1500):
        a = random_text(rng, rng.randint(24, 45))
        b = edited(rng, a, rng.randint(1, 2))
        if a == b or len(b) < linededup.MIN_CHARS or edit_distance(a, b) > 2:
            continue
        keys, rows = linededup.signatures([a, b])
        of = {}
        for k, r in zip(keys.tolist(), rows.tolist()):
            of.setdefault(r, set()).add(k)
        assert of[0] & of.get(3, set()) or of[2] & of.get(1, set())
        x, y = linededup.sketches([a, b])
        bits = linededup.part_bits(2)
        assert any((int(x ^ y) >> bits * g) & ((1 << bits) - 1) == 0 for g in range(5))


def test_cut_ends_and_wide_bands_keep_the_distance():
    rng = random.Random(4)
    for _ in range(300):
        a = random_text(rng, rng.randint(0, 60))
        b = edited(rng, a, rng.randint(0, 12)) if a else "ab"
        x, y = linededup.without_ends(a, b)
        assert edit_distance(x, y) == edit_distance(a, b)
        for k in (0, 3, 8):
            assert linededup.edits_within(a, b, k) == (edit_distance(a, b) <= k)
    for w in (1, 2, 3, 6, 9, 10):
        x = np.array([rng.randint(0, 99) for _ in range(40)], dtype=np.uint64)
        assert linededup.least_of(x, w, np.minimum).tolist() == [int(x[i:i + w].min()) for i in range(41 - w)]


def test_long_lines_are_near_by_their_share():
    """Long lines with all allowed edits share a run key, pass the count test and are near; one word is no cut."""
    rng = random.Random(6)
    for _ in range(150):
        a = random_text(rng, rng.randint(60, 700), "abcdefghijklmnop ")
        k = int(linededup.allowed(len(a)))
        b = edited(rng, a, rng.randint(k // 2, k), "abcdefghijklmnop ")
        dist, limit = edit_distance(a, b), int(linededup.allowed(max(len(a), len(b))))
        assert linededup.near([a], [b]).tolist() == [dist <= limit]
        x, y = linededup.gram_counts([a, b])
        assert linededup.gram_gap(x[None], y[None])[0] <= 2 * linededup.TEXT_GRAM * dist
        assert x.sum() == len(a) - linededup.TEXT_GRAM + 1 and linededup.near_by_grams([a], [b]).tolist() == [dist <= limit]
        x, y = linededup.pair_counts([a, b])
        assert linededup.pair_gap(x[None], y[None])[0] <= 4 * dist
        if dist <= limit and max(len(a), len(b)) >= linededup.long_from():
            keys, rows, low, place, low_place = linededup.run_keys([a, b])
            assert all(low[rows == r].min() == keys[rows == r][keys[rows == r].view(np.uint64).argmin()] or len(set(low[rows == r])) > 1 for r in (0, 1))
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
            assert all(p == min(place[(rows == r) & (keys == x)]) for r, x, p in zip(rows, low, low_place))


@pytest.mark.parametrize("bucket_rows", [64, 2])
def test_near_lines_keep_enough_keys(bucket_rows, monkeypatch):
    """Near pairs have the least number of shared keys over all ranges or stand in a dense key, periodic lines too."""
    monkeypatch.setattr(linededup, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(16)
    lines, near = [], []
    for k in range(60):
        a = random_text(rng, rng.randint(60, 900), "abcdefgh ")
        if k % 3 == 0:                                      # periods repeat their keys
            a = (a[:rng.randint(5, 40)] * 200)[:len(a)]
        step = max(len(a) // (int(linededup.allowed(len(a))) + 1), 1)
        even = "".join("#" if i % step == step - 1 and i // step < linededup.allowed(len(a)) else ch for i, ch in enumerate(a))
        for b in (even, edited(rng, a, rng.randint(1, int(linededup.allowed(len(a)))), "abcdefgh ")):
            if a != b and edit_distance(a, b) <= linededup.allowed(max(len(a), len(b))):
                near.append((a, b))
        lines += [a] + [b for x, b in near if x == a]
    ids = dict(zip(lines, (linededup.line_ids(lines).view(np.int64) >> 1).tolist()))
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(lines[:90]), "\n".join(lines[90:])])], names=["text"])
    by_part: dict[int, list] = {}
    for out in linededup.emit_runs(2, 3)(iter([batch.slice(0, 1), batch.slice(1)])):
        by_part.setdefault(out.column(0)[0].as_py(), []).append(out)
    hits, need, dense = {}, {}, {}
    for held in by_part.values():
        for out in linededup.met_runs(2)(iter(held)):
            for key, a, b, h, t in zip(*(c.to_pylist() for c in out.columns)):
                if key is None:
                    hits[a, b], need[a, b] = hits.get((a, b), 0) + h, t
                else:
                    dense.setdefault(a, set()).add(key)
    assert len(near) > 80
    for a, b in near:
        x, y = sorted((ids[a], ids[b]))
        assert hits.get((x, y), 0) >= need.get((x, y), 1) or dense.get(x, set()) & dense.get(y, set()), (len(a), len(b))


def test_dense_blocks_walk_many_pairs_at_once(monkeypatch):
    """Links span the classes of all near pairs; pairs of any number of edits are walked together, not line by line."""
    rng = random.Random(21)
    texts = []
    for _ in range(4):
        line = random_text(rng, rng.randint(380, 560), "abcdefghijkl ")
        for _ in range(30):                                 # chains, whose ends are not near
            texts.append(line)
            line = edited(rng, line, rng.randint(4, 30), "abcdefghijkl ")
    texts = sorted(set(texts))
    i, j = np.triu_indices(len(texts), 1)
    ok = linededup.near([texts[x] for x in i], [texts[x] for x in j])

    def classes(links):
        root = list(range(len(texts)))
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {tuple(x for x in range(len(texts)) if root[x] == r) for r in root}

    walks = []
    walk, walk_one = linededup.in_band, linededup.edits_within
    monkeypatch.setattr(linededup, "in_band", lambda *a: walks.append(len(a[0])) or walk(*a))
    monkeypatch.setattr(linededup, "edits_within", lambda *a: walks.append(1) or walk_one(*a))
    links = linededup.spanning(list(range(len(texts))), texts, list(range(len(texts))))
    assert classes(links) == classes(zip(i[ok].tolist(), j[ok].tolist())) and 4 <= len(classes(links)) < len(texts) // 2
    assert sum(n > 1 for n in walks) <= 12
    # lines of one root, and pairs that meet under an earlier key, are left out
    assert not len(linededup.like_in_block(texts, [0] * len(texts))[0])
    met = np.array([[-1, x % 2 - 1] for x in range(len(texts))])
    every = set(map(frozenset, zip(*(x.tolist() for x in linededup.like_in_block(texts, range(len(texts)))))))
    some = set(map(frozenset, zip(*(x.tolist() for x in linededup.like_in_block(texts, range(len(texts)), met)))))
    assert some == {p for p in every if not all(x % 2 for x in p)} and {(a, b) for a, b in zip(i[ok], j[ok]) if {a, b} not in every} == set()


def test_keys_of_a_class_stand_in_its_own_ranges():
    """Ranges by class: a line stands in few of them, and each pair meets as often as in ranges of all classes."""
    rng = random.Random(3)
    lines = [random_text(rng, n, "abcdefgh ") for n in (60, 75, 90, 130, 200, 300, 500, 700, 1000, 4000) for _ in range(4)]
    lines += [edited(rng, s, len(s) // 25, "abcdefgh ") for s in lines]
    batch = pa.RecordBatch.from_arrays([pa.array(lines)], names=["text"])
    each = [2, 1, 3, 1, 2, 4, 4, 3, 2, 1, 1, 2, 1]
    times, hits = [], []
    for parts in (sum(each), each):
        held: dict[int, list] = {}
        for out in linededup.emit_runs(2, parts)(iter([batch])):
            held.setdefault(out.column(0)[0].as_py(), []).append(out)
        assert max(held) < sum(each)
        times.append(sum(len(o.column(1)[0].as_py()) // 8 for v in held.values() for o in v))
        met = {}
        for v in held.values():
            for out in linededup.met_runs(2)(iter(v)):
                for _, a, b, h, need in zip(*(c.to_pylist() for c in out.columns)):
                    met[a, b] = (met.get((a, b), (0, 0))[0] + h, need)
        hits.append(met)
    assert hits[0] == hits[1] and len(hits[0]) >= 30 and 2 * times[1] < times[0]
    x = np.array([1, 2, 300, 70000], dtype=np.uint32)
    assert linededup.from_planes(linededup.planes(x), np.uint32).tolist() == x.tolist()


def test_keys_of_a_range_are_met_in_bounded_parts(monkeypatch):
    """Any number of keys in a range is met with the memory of some of them, and gives the same pairs and dense keys."""
    rng = np.random.default_rng(8)
    lines, each = 20_000, 100
    keys = np.repeat(rng.integers(0, 1 << 32, lines * each // 2, dtype=np.uint32), 2)
    line = rng.permutation(np.repeat(np.arange(lines, dtype=np.uint32), each))
    place, n = rng.integers(0, 400, len(keys)).astype(np.uint16), rng.integers(390, 410, lines).astype(np.int32)
    keys[:600], place[:600] = 7, 5                          # a dense key
    g = rng.permutation(lines).astype(np.int64)
    low = np.arange(lines, dtype=np.uint32), np.zeros(lines, dtype=np.int32)

    def met():
        hits, dense = {}, set()
        peak = 0
        tracemalloc.start()
        for out in linededup.met_in(3, g, n, low, keys, line, place, 2):
            peak = max(peak, tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
            for key, a, b, h, _ in zip(*(c.to_pylist() for c in out.columns)):
                if key is None:
                    hits[a, b] = hits.get((a, b), 0) + h
                else:
                    dense.add((key, a))
            tracemalloc.start()
        peak = max(peak, tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return hits, dense, peak

    hits, dense, peak = met()
    assert len(hits) > 50_000 and len(dense) > 100 and peak < 90e6
    if hasattr(linededup, "KEYS_AT_ONCE"):
        monkeypatch.setattr(linededup, "KEYS_AT_ONCE", len(keys) + 1)
    assert met()[:2] == (hits, dense)


def test_one_word_is_no_cut():
    line = "The committee met on Tuesday and agreed that the report should be published before the end of the month."
    assert linededup.near([line], [line.replace("Tuesday", "Sunday")]).all() and not linededup.within(
        [line], [line.replace("Tuesday", "Sunday")]).any()


def test_simhash_against_plain_form():
    import xxhash

    def plain(text):
        import re
        words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            return 0
        shingles = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))]
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    texts = [None, "", " \t\n", "One", "One two", "a b c", "a  B\tc\x0bd É f g", "x y z " * 700, "İ ẞ ſ K a b"]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


def test_pigeonhole_thresholds_cover_the_distance():
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    for d, m in ((2, 3), (3, 2), (5, 4), (1, 2)):
        parts = simhash.correlated_parts(sample, m)
        assert sorted(b for p in parts for b in p) == list(range(64))
        ts = simhash.allocate(sample, parts, d)
        assert sum(t + 1 for t in ts) == d + 1 and min(ts) >= -1


def test_fingerprint_is_homomorphic_and_order_free():
    v = fingerprint.vectors
    a, b, c = "first paragraph of some words", "second one, it is longer than that", "third"
    assert fingerprint.texts_of(v(["\n".join([a, b, c])])) == fingerprint.texts_of(v(["\n".join([c, a, "", b])]))
    whole = v(["\n".join([a, b, c])])
    again = fingerprint.delete(fingerprint.insert(whole, v([a])), v([a]))
    assert fingerprint.texts_of(again) == fingerprint.texts_of(whole)
    assert fingerprint.texts_of(v([f"{a}\n{a}"])) != fingerprint.texts_of(v([a]))
    assert fingerprint.likeness(v(["", a]), v(["", a])).tolist() == [1.0, 1.0]
    long = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(2)]
    half = fingerprint.likeness(v([long[0]]), v([fingerprint.edited_text(long[0], long[1])]))[0]
    assert 0.25 < half < 0.75
    assert fingerprint.edited_text("abcde", "xyz") == "abcxy" and fingerprint.edited_text("abcdef", "x") == "abcx"


def test_sentencepiece_equals_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    vocab = spm.load()
    rng = random.Random(3)
    texts = [None, "", " ", "  two  blanks ", "a\nb\t c", "a\x00b", "▁a▁", "日本語 ひらがな 😀!", "It's (e.g.) 3,141.59!!",
             "x" * 500, "-" * 90 + "=" * 33, "<s> <unk> <0x0A>", "word,word. Word; ñandú Ünïcödé"]
    texts += [random_text(rng, 200, "abcdeéthrs ,.\n-1") for _ in range(200)]
    offsets, ids = vocab.encode(texts)
    for i, t in enumerate(texts):
        own = ids[offsets[i]:offsets[i + 1]].tolist()
        assert own == lib.encode(t or ""), t
        assert vocab.decode(own) == (t or "").replace("▁", " ")


def test_unigram_models_take_the_best_path():
    rng = random.Random(11)
    names = ["<unk>", "▁", "a", "b", "ab", "ba", "▁a", "aab", "bb", "▁ab"]
    scores = np.array([0.0] + [-rng.uniform(1, 5) for _ in names[1:]])
    vocab = spm.Vocab(names, scores, np.array([spm.UNKNOWN] + [spm.NORMAL] * (len(names) - 1)), False, True)

    def best(s):
        top = [(0.0, [])] + [(-1e9, [])] * len(s)
        for e in range(1, len(s) + 1):
            for i, p in enumerate(names[1:], 1):
                if s[:e].endswith(p):
                    top[e] = max(top[e], (top[e - len(p)][0] + scores[i], top[e - len(p)][1] + [i]))
        return top[-1][0]

    for _ in range(100):
        t = random_text(rng, 12, "ab").strip() or "a"
        offsets, ids = vocab.encode([t])
        assert "".join(names[i] for i in ids) == "▁" + t
        assert scores[ids].sum() == pytest.approx(best("▁" + t))
    assert vocab.encode(["aQQb"])[1].tolist().count(0) == 1      # neighbouring unknown letters are one id


def test_langid_grams_against_plain_counts():
    texts = ["Abc d", "", None, "12 34", "é x" * 50]
    found = np.zeros((len(texts), 2), dtype=np.int64)
    for at, held in langid.pieces(texts, 20):
        first = langid.starts(held)
        for pos, b in langid.grams(held):
            own = np.searchsorted(first, pos, side="right") - 1
            np.add.at(found, (np.array(at)[own], 0), 1)
    # three grams around every letter of an only word: "d" gives d, " d", "d ", ...
    assert found[0, 0] > 0 and not found[1:4].any() and found[4, 0] > 0
    model = langid.Model([], np.zeros((0, 0), dtype=np.float32), np.zeros(0))
    assert model.predict(["a", None])[0] == ["und", "und"]


def test_kneser_tables_against_brute_force():
    g, n = kneser.grams(["abc", "", "b"])
    assert n.tolist() == [3, 0, 1]
    c = [ord(x) for x in "abc"]
    assert g.tolist() == [c[0], c[0] << 12 | c[1], c[0] << 24 | c[1] << 12 | c[2], c[1]]
    long = "the cat sat on a mat. " * 40
    whole = [np.concatenate([g for _, g, _ in kneser.pieces([long])])]
    old, kneser.GROUP = kneser.GROUP, 64
    try:
        cut = [np.concatenate([g for _, g, _ in kneser.pieces([long])])]
    finally:
        kneser.GROUP = old
    assert (whole[0] == cut[0]).all()
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 60, 5000))
    shard = kneser.Shard(keys[::2], np.arange(len(keys[::2]), dtype=np.float32) + 1)
    assert (shard.get(keys)[::2] == np.arange(len(keys[::2])) + 1).all() and not shard.get(keys)[1::2].any()
    seen, total = kneser.Seen(bits=6), {}
    for _ in range(50):
        g = rng.integers(0, 200, 40)
        flag = bool(rng.integers(2))
        outs = [seen.add(g, flag)]
        for x in g.tolist():
            total[x] = total.get(x, 0) + flag
        for out in outs:
            if out is not None:
                for k, v in zip(out.g, out.n):
                    total[k] -= v
    rest = seen.take()
    for k, v in zip(rest.g, rest.n) if rest is not None else ():
        total[k] -= v
    assert not any(total.values())


def test_toxicity_machine_learns_a_pair():
    """Toxic only when both terms are there: additive weights cannot tell, the factors can."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1200):
        a, b = int(rng.integers(2)), int(rng.integers(2))
        rows.append([i for i, f in ((0, a), (1, b), (2 + int(rng.integers(20)), 1)) if f])
        y.append(float(a != b))
    w0, w, v = toxicity.fit_machine(rows, np.array(y), 22, toxicity.Params(epochs=300, rate=0.05))
    model = toxicity.Model({}, w0, w, v, 1)

    def score(s):
        vs = v[s]
        z = w0 + w[s].sum() + 0.5 * ((vs.sum(0) ** 2).sum() - (vs * vs).sum())
        return 1 / (1 + np.exp(-z))

    assert score([0, 5]) > 0.8 and score([1, 6]) > 0.8 and score([0, 1, 7]) < 0.2 and score([8]) < 0.2
    assert model.score(None) == model.score("") and 0 <= model.score("any words") <= 1


def test_decontamination_edit_search():
    rng = random.Random(9)
    for _ in range(150):
        item = random_text(rng, rng.randint(5, 30))
        text = random_text(rng, rng.randint(0, 20)) + edited(rng, item, rng.randint(0, 3)) + random_text(rng, rng.randint(0, 20))
        dist, end = decontam.edit_end(item, text)
        assert dist == min([edit_distance(item, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1)])
        assert min(edit_distance(item, text[i:end]) for i in range(end + 1)) == dist


def test_decontamination_reaches_its_recall():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(15, 60))) for i in range(60)] + [(90, "too short"), (91, ""), (92, None)]
    block = decontam.build(items)
    texts, truth = [], set()
    for d in range(300):
        i, t = items[d % 60]
        k = rng.randint(0, decontam.allowed(len(t)))
        texts.append(prose(rng.randint(0, 40)) + " " + edited(rng, t, k, "abcdefghij") + "\n" + prose(rng.randint(0, 40)))
        truth.add((d, i))
    texts += [prose(200) for _ in range(100)] + ["it is TOO  short, yes", "", None]
    got = {(d, i): (s, e, dist) for d, i, s, e, dist in decontam.find(block, list(range(len(texts))), texts)}
    assert len(truth & set(got)) >= 0.95 * len(truth)
    assert (400, 90) in got and all(d < 300 or i == 90 for d, i in got)
    for (d, i), (s, e, dist) in list(got.items())[:100]:
        item = decontam.fold(dict(items)[i])
        assert edit_distance(item, decontam.fold(texts[d])[s:e]) == dist <= decontam.allowed(len(item))


def test_decontamination_finds_every_copy_with_all_allowed_edits():
    """Fresh copies of a few items (a class each), with as many edits as allowed: none is missed."""
    rng = random.Random(13)
    letters = "abcdefghijklmnop "
    items = [(n, decontam.fold(random_text(rng, n, letters))) for n in (60, 130, 260)]
    texts, truth = [], set()
    for d in range(150):
        i, t = items[d % 3]
        texts.append(decontam.fold(random_text(rng, 50, letters) + " " + edited(rng, t, decontam.allowed(len(t)), letters) + " tail"))
        truth.add((d, i))
    got = {(d, i) for d, i, *_ in decontam.find(decontam.build(items), list(range(150)), texts)}
    assert truth <= got


def test_decontamination_repetitions_reach_the_recall_on_fresh_copies():
    """Windows of copies that did not choose the repetitions, cut at the true begin, by keys alone."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    for n in (6, 20, 60):
        texts = [decontam.fold(" ".join(rng.choice(words) for _ in range(n))) for _ in range(5)]
        block = decontam.build(list(enumerate(texts)))
        found = total = 0
        for cl in block.classes:
            own = [t for _, t in cl["items"]] * 80
            plan = decontam.walk_plan(cl["embed"], 0, cl["repeats"])
            copies = decontam.edited_copies(own, block.rate, seed=77)
            keys = decontam.lsh_keys(decontam.padded([decontam.code_points(t) for t in copies], cl["width"]), plan)
            found += int((keys == np.tile(cl["keys"], (80, 1))).any(1).sum())
            total += len(own)
        assert cl["repeats"] and found >= 0.95 * total


def test_decontamination_short_items_by_the_same_rule():
    rng = random.Random(22)
    letters = "abcdefghijklmnopqrstuvwxyz"
    items = [(n, random_text(rng, n, letters)) for n in range(1, 60)]
    texts, truth = [], set()
    for n, t in items:
        for _ in range(6):
            texts.append(random_text(rng, 30, "0123456789") + edited(rng, t, decontam.allowed(n), letters) + "0" * 9)
            truth.add((len(texts) - 1, n))
    got = {(d, i) for d, i, *_ in decontam.find(decontam.build(items), list(range(len(texts))), texts)}
    assert len(truth & got) >= 0.98 * len(truth)
    for d, i in got - truth:
        assert decontam.edit_end(dict(items)[i], texts[d])[0] <= decontam.allowed(i)


def test_decontamination_of_texts_whose_windows_meet_no_item():
    """The last third of an item alone has the votes for a window, but no repetition's key."""
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    item = random_text(rng, 200, letters)
    part = random_text(rng, 50, "0123456789") + random_text(rng, 134, letters) + item[134:] + random_text(rng, 300, "0123456789")
    block = decontam.build([(4, item)])
    assert block.classes[0]["repeats"]
    c, first = decontam.code_points(part + "\0"), np.array([0, len(part) + 1])
    grams = decontam.gram_hashes(c)
    pos = np.flatnonzero(block.bitmap(decontam.Q)[grams])
    windows = list(decontam._windows(block.classes[0], first, pos, grams[pos]))
    assert windows and all(not len(decontam._meet(block.classes[0], c, *w)[3]) for w in windows)
    assert list(decontam.find(block, [1], [part])) == []
    assert list(decontam.find(block, [1, 2], [part, "7" * 30 + item])) == [(2, 4, 30, 230, 0)]


def test_decontamination_votes_of_templated_items_in_parts(monkeypatch):
    """Items with one lead, texts with that lead, and one letter for ever: the parts give what the whole gives."""
    rng = random.Random(23)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    lead = "which of the following answers is right"
    items = [(i, lead + " " + prose(150)) for i in range(200)] + [(900, "z" * 150)]
    texts = [prose(40) + " " + lead + " " + prose(200) for _ in range(50)]
    texts += [prose(40) + " " + edited(rng, items[i][1], 5, "abcdef") + " tail" for i in range(20)] + ["z" * 3_000]
    block = decontam.build(items)
    want = sorted(decontam.find(block, list(range(len(texts))), texts))
    assert {(d, i) for d, i, *_ in want} == {(50 + i, i) for i in range(20)} | {(70, 900)}
    sizes = []
    voted = decontam._voted
    monkeypatch.setattr(decontam, "VOTES", 1 << 13)
    monkeypatch.setattr(decontam, "_voted", lambda cl, first, pos, lo, hi, i, j: sizes.append(int((hi - lo).sum())) or voted(
        cl, first, pos, lo, hi, i, j))
    assert sorted(decontam.find(block, list(range(len(texts))), texts)) == want
    assert len(sizes) > 4


def test_decontamination_finds_items_inside_runs_of_letters():
    """Verbatim items far from any blank: in text without blanks, and after a long token."""
    rng = random.Random(12)
    han = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    items = [(i, han(rng.randint(60, 200))) for i in range(20)] + [(50, "how many apples does the farmer have left when the week ends")]
    texts = [han(rng.randint(300, 900)) + t + han(rng.randint(0, 500)) for _, t in items[:20]]
    texts.append("x https://example.org/" + "a1b2" * 60 + "=" + items[-1][1] + "?")
    got = {(d, i): (s, e, k) for d, i, s, e, k in decontam.find(decontam.build(items), list(range(21)), texts)}
    assert got == {(d, i): (texts[d].index(t), texts[d].index(t) + len(t), 0) for d, (i, t) in enumerate(items)}


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div id="top-menu"><a>Home</a> <a>News</a></div><div class="ad">Buy this, now, it is good.</div>BODY
<div class="sidebar"><p>Other things to read, that are long, and have marks, as prose has.</p></div>
<section id="comments"><p>Nice post, I like it, really; thank you.</p></section><form><p>Subscribe now</p></form>
<div class="cookie-notice">We use cookies.</div><script>var x = "<p>no</p>";</script><footer>(c) me</footer></body></html>"""
TEXT = "The title\nFirst paragraph of the text, which is long enough; it has marks.\nSecond <one> & more, with words.\nShort.\nitem"


@pytest.mark.parametrize("body", [
    "<article><h1>The  title</h1><p><b>First paragraph</b> of the text, which is long\n enough; it has marks.<br></p>"
    "<p>Second &lt;one&gt; &amp; more, with words.<p>Short.</p><ul><li>item</ul></article>",
    "<div class='content'><h2>The title</h2><div>First paragraph of the text, which is long enough; it has marks.</div>"
    "<div>Second &#60;one> &amp more, with words.</div><p>Short.</p><ul><li>item</li></ul></div>",
    "<main><header><h1>The title</h1></header><p>First paragraph of the text, which is long enough; it has marks.</p>"
    "<!-- <p>hidden</p> --><p>Second &lt;one&gt; &amp; more, with words.</p><table><tr><td>Short.<td>item</table></main>",
])
def test_main_text(body):
    assert htmlmain.main_text(PAGE.replace("BODY", body)) == TEXT


@pytest.mark.parametrize("around", ["<div class='site has-sidebar'>ALL</div>", "<div id='page-no-sidebar'>ALL</div>",
                                    "<section class='search-result-page'>ALL</section>", "<form id='form1'>ALL</form>",
                                    "<form id='form1'><div class='has-sidebar'>ALL</div></form>"])
def test_main_text_inside_wrappers_with_furniture_words(around):
    body = ("<h1>The title</h1><p>First paragraph of the text, which is long enough; it has marks.</p>"
            "<p>Second &lt;one&gt; &amp; more, with words.</p><p>Short.</p><ul><li>item</ul>")
    menu = "<div class='menu'><a>Home</a> <a>News</a></div>"
    remarks = "<div id='comments'><article class='comment'>" + "<p>I like it, really; thank you, and so on.</p>" * 9 + "</article></div>"
    for tag in ("article", "div"):
        page = "<body>" + around.replace("ALL", f"{menu}<{tag}>{body}</{tag}>{remarks}") + "<footer>(c) me</footer></body>"
        assert htmlmain.main_text(page) == TEXT


def test_main_text_keeps_sibling_sections():
    """No selected node goes because it stands outside the element with most of the text."""
    part = lambda n, k: "".join(f"<p>Paragraph {n}{i} of the text, which is long enough; it has marks, too.</p>" for i in range(k))
    lead = "<div class='lead'><p>The lead says what the text is about, in one sentence, as leads do.</p></div>"
    page = f"<html><body><div>{lead}<div>{part('a', 9)}</div><div>{part('b', 3)}</div></div><footer>(c) me</footer></body></html>"
    got = htmlmain.main_text(page).split("\n")
    assert len(got) == 13 and got[0].startswith("The lead") and got[-1].startswith("Paragraph b2")
    two = f"<body><article>{part('a', 9)}</article><article><h2>Two</h2>{part('b', 3)}</article></body>"
    assert len(htmlmain.main_text(two).split("\n")) == 13


def test_main_text_of_odd_pages():
    assert [htmlmain.main_text(x) for x in (None, "", " ", "<", "a < b", "just &amp; text", "<p>a<p>b<script>x</script",
                                            "<p>cut off <b")] == ["", "", "", "<", "a < b", "just & text", "a\nb", "cut off"]
    deep = "<div>" * 3000 + "in the deep" + "</div>" * 10
    assert htmlmain.main_text(deep) == "in the deep"


def test_warc_records_read_back():
    rows = [("1", "http://a/%0A b\r\n", "response", None, b"<p>x\r\n\r\nWARC/1.1\r\n"), ("2", None, "revisit", "1", None),
            ("3", "u", "response", None, b"")]
    raw = b"".join(warc.record(i, u, k, r, warc.digest(p or b""), len(p or b""), p or b"") for i, u, k, r, p in rows)
    back = list(warc.read_records(io.BytesIO(raw), 0, len(raw), lambda head: True, True))
    assert [(b[1], b[2], b[0], b[3], b[7]) for b in back] == [(i, u, k, r, p) for i, u, k, r, p in rows]
    assert [b[5] for b in back] == [len(p or b"") for *_, p in rows]
    assert back[2][4] == base64.b32encode(hashlib.sha1(b"").digest()).decode() == warc.EMPTY_DIGEST
    only = list(warc.read_records(io.BytesIO(raw), 0, len(raw), lambda head: head["warc_type"] == "revisit", True))
    assert [b[1] for b in only] == ["2"]
    skipped = list(warc.read_records(io.BytesIO(raw), 0, len(raw), lambda head: True, False))
    assert [b[7] for b in skipped] == [None] * 3 and skipped[0][5] == len(rows[0][4])
    with pytest.raises(EOFError):
        list(warc.read_records(io.BytesIO(raw[:40]), 0, 40, lambda head: True, True))


def test_rows_decode_as_single_texts(monkeypatch):
    vocab = spm.load()
    texts = ["", "one  two", None, " lead", "tail ", "日本語 ☃ \U0001F600", "x" * 300, "a\nb\tc"]
    offsets, ids = vocab.encode(texts)
    ids = np.concatenate([ids, vocab.encode(["\U0001F600"])[1][:-1]])     # a row that ends inside a code point
    offsets = np.append(offsets, len(ids))
    want = [vocab.decode(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    assert want[:-1] == [t or "" for t in texts]
    for tokens in (1, 7, 1 << 16):
        monkeypatch.setattr(spm, "TOKENS", tokens)
        assert [t for some in vocab.decode_rows(ids, offsets) for t in some] == want


def test_sentencepiece_caches_are_bounded_by_letters(monkeypatch):
    """Texts without blanks are cached whole; the tables start anew before they grow past the bound."""
    monkeypatch.setattr(spm, "CACHE_LETTERS", 4_000)
    monkeypatch.setattr(spm, "GROUP", 2_000)
    rng = random.Random(31)
    texts = ["".join(chr(0x4E00 + rng.randrange(800)) for _ in range(rng.randint(200, 600))) for _ in range(60)]
    model, plain = spm.load(spm.MODEL), spm.load(spm.MODEL)
    offsets, ids = model.encode(texts)
    held = model.ready()
    assert max(held["words"].letters, held["cuts"].letters) <= 4_000 + 2 * 2_600
    monkeypatch.setattr(spm, "CACHE_LETTERS", 1 << 23)
    want_offsets, want = plain.encode(texts)
    assert offsets.tolist() == want_offsets.tolist() and ids.tolist() == want.tolist()
