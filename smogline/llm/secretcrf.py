"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Base spans are the whole matches of three patterns (``PATTERNS``), leftmost and non-overlapping per kind, matches that
fail their length dropped. The field tags the tokens of a text (runs of letters, digits and ``_+/.-``; any other
character that is no white space by itself) as begin, inside or outside of a secret. Its features are hashed:

* of a token: shape, length class, the word and its first letters, share of digits, changes of character class, hex;
* of the neighbours: the same, of the ``BEFORE`` tokens before and the ``AFTER`` tokens after, with weights of their own;
* of the file (the whole text): how often ``= : " { }``, line ends and letters beyond ASCII occur in it.

It learns from base spans (their values are begin and inside): windows round them and windows without them, from
documents whose crc32(id as text) mod 5 is not 0, at most ``Params.windows`` of either kind, those with the
least hash. Training maximises the likelihood by forward and backward sums over all windows at once. Decoding is
exact Viterbi: tokens whose margin for outside exceeds all that transitions can change are outside in the best path,
so only the stretches between them are walked. Tagged spans that no base span covers are added with kind ``crf``.

Defined cases: null and empty texts have no spans (the sha256 of the empty string, spans ``''``); without any base span in
the training documents nothing is added; repeated rows each return their row; null ids are scanned and never learned
from; spans that start together are ordered by kind; other columns of the input are ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, table, text_chunks

# Patterns, the least length of their value, and the order of the kinds.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = {kind: i for i, kind in enumerate((*PATTERNS, "crf"))}
#: The same matches as the plain hex pattern and its length check (greedy runs), found faster.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Without one of these, in either case, a text has no match of the first pattern.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

WITH_DIGITS = re.compile(r"[a-zA-Z+/]*[0-9][\w+/\-]{7,}")
NEAR_CHARS = 600
MADE = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
TOKENS = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
BUCKETS, WIDTH = 4096, 7
BEFORE, AFTER = 4, 2
OFFSETS = range(-BEFORE, AFTER + 1)
OUTSIDE, BEGIN, INSIDE = range(3)
BATCH_CHARS, KNOWN = 2_000_000, 200_000
CLASSES = {**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"),
           **dict.fromkeys("0123456789", "9")}


@dataclass(frozen=True)
class Params:
    """``windows``: most training windows of a kind; ``context``: tokens on either side of a span in a window."""
    windows: int = 1000
    context: int = 10
    rounds: int = 50
    rate: float = 0.15
    decay: float = 2e-4


def base_spans(text: str) -> list[tuple[str, int, int, int, int]]:
    """(kind, start, end, start of the value, its end) of all base spans, by start, then kind."""
    found = []
    low = text.lower()
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "assign" and not any(word in low for word in NAMES):
            continue
        for m in (LONG_HEX if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((kind, m.start(), m.end(), m.start(group), m.end(group)))
    return sorted(found, key=lambda s: (s[1], KINDS[s[0]]))


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


LENGTH = [bucket(f"l-{n}" if n <= 8 else f"l{n.bit_length()}") for n in range(65)]
SHAPE = {shape: bucket("s" + shape) for shape in ("a", "A", "Aa", "aA")}
REST = (BUCKETS,) * WIDTH


@lru_cache(maxsize=KNOWN)
def start_bucket(letters: str) -> int:
    return bucket("p" + letters)


@lru_cache(maxsize=KNOWN)
def token_features(token: str) -> tuple[int, ...]:
    """``WIDTH`` feature buckets of a token; the bucket after the last fills up (its weights stay 0)."""
    size = len(token)
    if token.isalpha():
        low = token.lower()
        shape = "a" if low == token else "A" if token.isupper() else "Aa" if token[1:].islower() else "aA"
        out = (SHAPE[shape], LENGTH[min(size, 64)], bucket("w" + low[:32]), start_bucket(low[:4]))
    elif size < 2:
        out = (bucket("c" + token) if token else bucket("edge"),)
    else:
        kinds = [CLASSES.get(c, "x" if c.isalpha() else c) for c in token[:256]]
        shape = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
        digits = sum(k == "9" for k in kinds)
        out = (bucket("s" + "".join(shape[:3])), LENGTH[min(size, 64)], bucket(f"d{8 * digits // len(kinds)}"),
               bucket(f"t{min(8, 16 * (len(shape) - 1) // len(kinds))}"), bucket("w" + token[:32].lower()),
               start_bucket(token[:4].lower()))
        if size >= 8 and all(c in "0123456789abcdefABCDEF" for c in token):
            out += (bucket("hex"),)
    return out + REST[len(out):]


def file_features(text: str) -> tuple[int, ...]:
    """Classes of how often characters of code and settings occur in a whole text."""
    size = max(1, len(text))
    counts = [text.count(c) for c in '=:"{}\n'] + [len(text.encode("utf-8", "surrogatepass")) - len(text)]
    return tuple(bucket(f"f{i}-{(1000 * c // size).bit_length() if c else -1}") for i, c in enumerate(counts))


def feature_rows(kinds: list[str]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(map(token_features, kinds)), dtype=np.int32,
                       count=len(kinds) * WIDTH).reshape(-1, WIDTH)


@dataclass(frozen=True)
class Field:
    """Weights (bucket, offset, tag), file weights (bucket, tag), transitions (tag, next tag)."""
    near: np.ndarray
    file: np.ndarray
    moves: np.ndarray

    def scores(self, rows: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Scores (token, tag) of tokens with these feature rows; ``code`` has BEFORE + AFTER edges between texts."""
        near = np.zeros((*self.near.shape[:2], 4), dtype=np.float32)     # four floats are gathered as one 16-byte value
        near[:, :, :3] = self.near
        held = near[rows[:, 0]]
        for j in range(1, WIDTH):
            held += near[rows[:, j]]
        out = np.zeros((len(code), 4), dtype=np.float32)
        for j, shift in enumerate(OFFSETS):
            of_kind = np.ascontiguousarray(held[:, j]).view(np.complex128).ravel()
            lo, hi = max(0, -shift), len(code) - max(0, shift)
            out[lo:hi] += of_kind.take(code[lo + shift:hi + shift]).view(np.float32).reshape(-1, 4)
        return out[:, :3]

    def slack(self) -> float:
        """Most that transitions to and from a tag can gain over those to and from outside."""
        m = self.moves
        gain = [m[a, y] + m[y, b] - m[a, OUTSIDE] - m[OUTSIDE, b] for a in range(3) for b in range(3) for y in (BEGIN, INSIDE)]
        # beside a text's edge or another changed token only one of the two counts
        one = [m[a, y] - m[a, OUTSIDE] for a in range(3) for y in (BEGIN, INSIDE)]
        two = [m[y, b] - m[OUTSIDE, b] for b in range(3) for y in (BEGIN, INSIDE)]
        return float(max(0.0, *gain, *one, *two))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best tags of one sequence; of equal ones the lower tag."""
    best = scores[0].astype(np.float64)
    back = np.zeros(scores.shape, dtype=np.int8)
    for i in range(1, len(scores)):
        step = best[:, None] + moves
        back[i] = step.argmax(axis=0)
        best = step[back[i], range(3)] + scores[i]
    tags = np.zeros(len(scores), dtype=np.int8)
    tags[-1] = int(best.argmax())
    for i in range(len(scores) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def decode(scores: np.ndarray, moves: np.ndarray, slack: float) -> np.ndarray:
    """Viterbi tags of a long sequence, walked only where a token may be tagged (its neighbours are outside)."""
    tags = np.zeros(len(scores), dtype=np.int8)
    open_ = np.flatnonzero(scores[:, OUTSIDE] - np.maximum(scores[:, BEGIN], scores[:, INSIDE]) <= slack)
    if not len(open_):
        return tags
    for part in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        lo, hi = max(0, int(part[0]) - 1), min(len(scores), int(part[-1]) + 2)
        held = scores[lo:hi].astype(np.float64)
        if lo < part[0]:
            held[0, 1:] = -np.inf
        if hi > part[-1] + 1:
            held[-1, 1:] = -np.inf
        tags[lo:hi] = viterbi(held, moves)
    return tags


def tag_texts(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """Spans (start, end) that the field tags in every text."""
    number: dict[str, int] = defaultdict(count().__next__)
    number[""]                                                          # 0: the edge of a text
    codes, first = [], []
    edge = np.zeros(max(BEFORE, AFTER), dtype=np.int32)
    at = 0
    for text in texts:
        found = TOKENS.findall(text)
        codes += [edge, np.fromiter(map(number.__getitem__, found), dtype=np.int32, count=len(found))]
        first.append((at + len(edge), len(found)))
        at += len(edge) + len(found)
    code = np.concatenate(codes + [edge]) if codes else edge
    scores = field.scores(feature_rows(list(number)), code)
    slack = field.slack()
    out = []
    for text, (lo, n) in zip(texts, first):
        if not n:
            out.append([])
            continue
        tags = decode(scores[lo:lo + n] + field.file[list(file_features(text))].sum(axis=0), field.moves, slack)
        spans = []
        if tags.any():
            last = -2
            for i, m in enumerate(TOKENS.finditer(text)):
                if tags[i] == BEGIN or (tags[i] == INSIDE and last != i - 1):
                    spans.append([m.start(), m.end()])
                elif tags[i] == INSIDE:
                    spans[-1][1] = m.end()
                if tags[i]:
                    last = i
        out.append([tuple(s) for s in spans])
    return out


def variants(tokens: list[str], tags: list[int], h: int) -> Iterator[tuple[list[str], list[int]]]:
    """A window as it is, and with other words beside a value of another look, so that neither is learned by heart."""
    yield tokens, tags
    rnd = random.Random(h)
    words = [t for t in tokens if t.isalpha()] or ["word"]
    for letters in (MADE, "0123456789ABCDEF", MADE):
        new, new_tags = [], []
        for i, token in enumerate(tokens):
            tag = tags[i - BEFORE] if 0 <= i - BEFORE < len(tags) else None
            if tag:
                new.append("".join(rnd.choice(letters) for _ in range(rnd.randint(16, 44))) if tag == BEGIN else token)
            else:
                new.append(rnd.choice(words) if token.isalpha() and rnd.random() < 0.4 else token)
            if tag is not None:
                new_tags.append(tag)
        yield new, new_tags


def near_tokens(text: str, place: int) -> list[re.Match]:
    """Tokens within ``NEAR_CHARS`` of a place, without those that the cut may have split."""
    lo, hi = max(0, place - NEAR_CHARS), min(len(text), place + NEAR_CHARS)
    found = list(TOKENS.finditer(text, lo, hi))
    if found and lo and found[0].start() == lo:
        found = found[1:]
    if found and hi < len(text) and found[-1].end() == hi:
        found = found[:-1]
    return found


def windows(text: str, key: int, p: Params, plain: bool = True) -> Iterator[tuple[bool, int, list[str], list[int], tuple[int, ...]]]:
    """Training windows of a text: (with a secret, hash, tokens with context, tags of the inner ones, file features).

    One window round every value and, in ``plain`` texts, one at a place that the id's hash names and one round the
    next token with digits.
    """
    if not text:
        return
    values = sorted({(lo, hi) for _, _, _, lo, hi in base_spans(text)}, key=lambda v: (v[0], -v[1]))
    if not values and not plain:
        return
    h = zlib.crc32(f"{key}:{len(text)}".encode())
    odd = WITH_DIGITS.search(text, h % len(text)) if plain else None
    of_file = file_features(text)
    for with_secret, place in [(True, lo) for lo, _ in values] + [(False, h % len(text))] * plain + \
            ([(False, odd.start())] if odd else []):
        found = near_tokens(text, place)
        if not found:
            continue
        starts, ends = [m.start() for m in found], [m.end() for m in found]
        tags = [OUTSIDE] * len(found)
        for lo, hi in values:
            a, b = bisect_right(ends, lo), bisect_left(starts, hi)
            if a < b and not any(tags[a:b]):
                tags[a:b] = [BEGIN] + [INSIDE] * (b - a - 1)
        middle = min(bisect_right(ends, place), len(found) - 1)
        lo = max(0, middle - p.context)
        hi = min(len(found), middle + p.context + 1)
        if with_secret != any(tags[lo:hi]):
            continue
        tokens = [found[i].group() if 0 <= i < len(found) else "" for i in range(lo - BEFORE, hi + AFTER)]
        yield with_secret, zlib.crc32(f"{key}:{place}".encode()), tokens, tags[lo:hi], of_file


def fit(sample: list[tuple[list[str], list[int], tuple[int, ...]]], p: Params) -> Field:
    """Field of the greatest penalised likelihood over windows (tokens with context, inner tags, file features)."""
    near = np.zeros((BUCKETS + 1, len(OFFSETS), 3), dtype=np.float32)
    file = np.zeros((BUCKETS, 3), dtype=np.float32)
    moves = np.zeros((3, 3))
    if not any(any(tags) for _, tags, _ in sample):
        file[:, OUTSIDE] = 1.0
        return Field(near, file, moves)
    number: dict[str, int] = {"": 0}
    longest, m = max(len(tags) for _, tags, _ in sample), len(sample)
    code = np.zeros((m, longest + BEFORE + AFTER), dtype=np.int32)
    gold = np.zeros((m, longest), dtype=np.int64)
    real = np.zeros((m, longest), dtype=bool)
    of_file = np.array([f for _, _, f in sample])
    for i, (tokens, tags, _) in enumerate(sample):
        code[i, :len(tokens)] = [number.setdefault(t, len(number)) for t in tokens]
        gold[i, :len(tags)] = tags
        real[i, :len(tags)] = True
    rows = feature_rows(list(number))
    flat = rows.ravel()
    used = np.unique(flat[flat < BUCKETS])
    place = np.full(BUCKETS + 1, len(used))
    place[used] = np.arange(len(used))
    ids = place[rows]
    size = len(used)
    w = np.zeros((size + 1, len(OFFSETS), 3))
    want = np.zeros((m, longest, 3))
    np.put_along_axis(want, gold[:, :, None], 1.0, axis=2)
    want[~real] = 0
    pair_want = np.zeros((3, 3))
    both = real[:, 1:]
    np.add.at(pair_want, (gold[:, :-1][both], gold[:, 1:][both]), 1)
    total = real.sum()
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, file.astype(float), moves)]
    weights = [w, file.astype(float), moves]
    for t in range(1, p.rounds + 1):
        w, wf, mv = weights
        held = w[ids].sum(axis=1)                                       # (kind, offset, tag)
        e = wf[of_file].sum(axis=1)[:, None, :] + sum(held[code[:, j:j + longest], j] for j in range(len(OFFSETS)))
        e[~real] = 0
        # forward and backward sums, all windows at once; places past a window's end are walked with weight 0
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0]
        for i in range(1, longest):
            new = np.logaddexp.reduce(fwd[:, i - 1, :, None] + mv, axis=1) + e[:, i]
            fwd[:, i] = np.where(real[:, i, None], new, fwd[:, i - 1])
        for i in range(longest - 2, -1, -1):
            new = np.logaddexp.reduce(mv + (e[:, i + 1] + bwd[:, i + 1])[:, None, :], axis=2)
            bwd[:, i] = np.where(real[:, i + 1, None], new, 0.0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        one = np.exp(fwd + bwd - z[:, None, None])
        one[~real] = 0
        pair = np.exp(fwd[:, :-1, :, None] + mv + (e[:, 1:] + bwd[:, 1:])[:, :, None, :] - z[:, None, None, None])
        gap = want - one
        by_kind = np.zeros((len(rows), len(OFFSETS), 3))
        for j in range(len(OFFSETS)):
            at = code[:, j:j + longest].ravel()
            for y in range(3):
                by_kind[:, j, y] = np.bincount(at, gap[:, :, y].ravel(), minlength=len(rows))
        g = np.zeros_like(w)
        for j in range(len(OFFSETS)):
            for y in range(3):
                g[:, j, y] = np.bincount(ids.ravel(), np.repeat(by_kind[:, j, y], WIDTH), minlength=size + 1)
        g[size] = 0
        gf = np.stack([np.bincount(of_file.ravel(), np.repeat(gap[:, :, y].sum(axis=1), of_file.shape[1]),
                                   minlength=BUCKETS) for y in range(3)], axis=1)
        gm = pair_want - pair[both].sum(axis=0)
        for x, grad, (first, second) in zip(weights, (g, gf, gm), state):
            grad = grad / total - p.decay * x
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            x += p.rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
    near[used] = weights[0][:size]
    return Field(near, weights[1].astype(np.float32), weights[2])


def train(docs: DataFrame, p: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Field learned from at most ``p.windows`` windows with and as many without secrets of the given documents."""
    shown = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
             .where("id IS NOT NULL AND text IS NOT NULL"))
    # windows without secrets come from this many documents: the least hashes, read from the ids alone
    plain = {r["id"] for r in shown.select("id").orderBy(F.crc32(F.col("id").cast("string").cast("binary")), "id")
             .limit(p.windows).collect()}

    def cut(batches):
        for batch in batches:
            out = [(w, h, t, g, list(f)) for k, s in zip(batch["id"], batch["text"])
                   for w, h, t, g, f in windows(s, int(k), p, int(k) in plain)]
            yield pd.DataFrame(out, columns=["secret", "h", "tokens", "tags", "file"])

    shown = shown.mapInPandas(cut, "secret boolean, h long, tokens array<string>, tags array<int>, file array<int>")
    least = F.row_number().over(Window.partitionBy("secret").orderBy("h", "tokens", "tags"))
    held = shown.withColumn("n", least).where(F.col("n") <= p.windows).collect()    # at most 2 x p.windows short rows
    held.sort(key=lambda r: (not r["secret"], r["h"], r["tokens"]))
    return fit([(tokens, tags, tuple(r["file"])) for r in held
                for tokens, tags in (variants(r["tokens"], r["tags"], r["h"]) if r["secret"] else
                                     [(r["tokens"], r["tags"])])], p)


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for kind, lo, hi in spans)


def scan_texts(texts: list[str], field: Field) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of every text, by start, then kind."""
    for text, tagged in zip(texts, tag_texts(texts, field)):
        base = [s[:3] for s in base_spans(text)]
        added = [("crf", lo, hi) for lo, hi in tagged if not any(a <= lo and hi <= b for _, a, b in base)]
        yield base, sorted(base + added, key=lambda s: (s[1], KINDS[s[0]], s[2]))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, numbers of base spans by kind, digest of the base spans, all spans, number of added ones."""
    shared = docs.sparkSession.sparkContext.broadcast(field)            # a few hundred KB, whatever the input

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            ids = batch["id"]
            for at, part in text_chunks(texts, BATCH_CHARS):
                found = list(scan_texts(part, shared.value))
                out = pd.DataFrame({"id": ids.iloc[at].to_numpy()})
                for kind in PATTERNS:
                    out[f"n_{kind}"] = [sum(s[0] == kind for s in base) for base, _ in found]
                out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
                out["spans"] = [written(spans) for _, spans in found]
                out["n_crf"] = [len(spans) - len(base) for base, spans in found]
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    done = (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
            .mapInPandas(run, "id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"))
    return done.select(F.col("id").cast(kind).alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, train(docs.where(crc_mod(F.col("doc_id"), 5) != 0)))
