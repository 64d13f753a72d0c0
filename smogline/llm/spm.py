"""SentencePiece encoding and decoding by suffix-array matching.

Encoding cuts the normalised text where no piece of the vocabulary can span (between letters that stand side
by side in no piece), and looks the cuts up in a bounded per-process table. The unknown ones of a batch are
concatenated and indexed by a suffix array (sorted by their first eight code points); every
piece is binary-searched for its range of occurrences; the ranges give edges (start, end, piece), which are
sorted by position and relaxed in that order:

* unigram models: the path of greatest score (Viterbi);
* BPE models: at every position exactly one piece can end the encoding of the text so far, the one whose
  pairing with the piece before it is itself a BPE encoding (no merge across the cut would have come first),
  so relaxing an edge tests that pair.

The model file is read once on the driver and broadcast (its size is checked). Decoding joins the pieces.

Defined results: null and empty texts have no ids, and no ids decode to the empty text; code points outside
the vocabulary become byte pieces (or the unknown id where the model has none). Texts round-trip but for
U+2581, which the format reads as a blank, and lone surrogates, which read as U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, ranges, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MAX_MODEL_BYTES = 64 << 20
CACHE = 300_000
CACHE_LETTERS = 1 << 23     # and of so many letters: texts without blanks are one entry
SEGMENT = 30_000     # cuts that are indexed at once
GROUP = 1 << 19
ROWS = 1024          # texts that are Python strings at once
TOKENS = 1 << 16     # ids whose bytes are gathered at once
BLANK = "▁"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
MEMO = 1 << 20
KEY = 8
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message (varint, 64-bit, bytes, 32-bit)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at:at + size]
            at += size


@dataclass
class Vocab:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    bpe: bool
    dummy_prefix: bool
    _ready: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_ready": {}}

    @classmethod
    def parse(cls, raw: bytes) -> Vocab:
        if len(raw) > MAX_MODEL_BYTES:
            raise ValueError("the model exceeds the broadcast bound")
        pieces, scores, types, bpe, prefix = [], [], [], False, True
        for number, value in fields(raw):
            if number == 1:
                got = dict(fields(value))
                pieces.append(got.get(1, b"").decode())
                scores.append(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0])
                types.append(got.get(3, NORMAL))
            elif number == 2:
                kind = dict(fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
                bpe = kind == 2
            elif number == 3:
                got = dict(fields(value))
                if got.get(2) or got.get(4, 1):
                    raise ValueError("only models without character maps and blank removal are supported")
                prefix = bool(got.get(3, 1))
        if USER in types:
            raise ValueError("user-defined pieces are not supported")
        return cls(pieces, np.array(scores, dtype=np.float64), np.array(types), bpe, prefix)

    # --- tables built once a process -------------------------------------------------------------

    def ready(self) -> dict:
        if not self._ready:
            self._ready.update(self._tables())
            self.reset()
        return self._ready

    def _tables(self) -> dict:
        normal = [i for i, t in enumerate(self.types) if t == NORMAL and self.pieces[i]]
        byte_of = {self.pieces[i]: i for i, t in enumerate(self.types) if t == BYTE}
        out = {
            "bytes": [byte_of.get(f"<0x{b:02X}>", -1) for b in range(256)] if byte_of else [],
            "unk": next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0),
        }
        out["raw"] = [b"" if t == CONTROL else bytes([int(p[3:5], 16)]) if t == BYTE else
                      " ⁇ ".encode() if t == UNKNOWN else p.replace(BLANK, " ").encode()
                      for p, t in zip(self.pieces, self.types)]
        spans = {p[k:k + 2] for p in (self.pieces[i] for i in normal) for k in range(len(p) - 1)}
        # cut before a blank, around line ends and between a letter and a mark, where no piece spans the place
        stops = re.escape("".join(c for c in "\n\t\r" if not any(c in s for s in spans)))
        marks = re.escape("".join(c for c in MARKS if not any(s[1] == c and s[0].isalpha() for s in spans)))
        out["blank_starts"] = not any(s[1] == BLANK and s[0] != BLANK for s in spans)
        if not out["blank_starts"]:
            out["cut"] = re.compile(r"(?s).+")
        else:
            inner = f"[^{BLANK}{stops}{marks}]+" + (f"|(?<![^\\W\\d_])[{marks}]" if marks else "")
            out["cut"] = re.compile(f"{BLANK}*[^{BLANK}{stops}](?:{inner})*|{BLANK}+" + (f"|[{stops}]" if stops else ""))
        if self.bpe:
            order = np.argsort(-self.scores[normal], kind="stable")
            ids = np.array(normal)[order]                       # ids by merge priority
            rank = {self.pieces[i]: r for r, i in enumerate(ids.tolist())}
            names = [self.pieces[i] for i in ids.tolist()]
            left, right = np.arange(len(names)), np.arange(len(names))
            keep = np.ones(len(names), dtype=bool)
            for r, p in enumerate(names):
                if len(p) > 1:
                    got = _merge(p, rank)
                    if got is None:
                        keep[r] = False                         # no merges lead to this piece
                    else:
                        left[r], right[r] = got
            pairs, into = [], []
            for r, p in enumerate(names):
                for k in range(1, len(p)):
                    a, b = rank.get(p[:k]), rank.get(p[k:])
                    if a is not None and b is not None:
                        pairs.append(a * len(names) + b)
                        into.append(r)
            o = np.argsort(pairs)
            out |= {"left": left, "right": right, "pair": np.array(pairs, dtype=np.int64)[o],
                    "into": np.array(into, dtype=np.int64)[o]}
            live = np.flatnonzero(keep)
        else:
            ids, names = np.array(normal), [self.pieces[i] for i in normal]
            live = np.arange(len(names))
        letters = np.zeros((len(names), 2 * KEY), dtype=np.uint32)
        for r, p in enumerate(names):
            head = [ord(c) for c in p[:2 * KEY]]
            letters[r, :len(head)] = head
        out |= {"ids": ids, "names": names, "live": live, "len": np.array([len(p) for p in names]), "letters": letters,
                "memo": np.full(MEMO, -1, dtype=np.int64), "memo_ok": np.zeros(MEMO, dtype=bool)}
        return out

    def reset(self) -> None:
        self._ready["cuts"], self._ready["words"] = _Table(), _Table()

    # --- encoding --------------------------------------------------------------------------------

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch of texts."""
        t = self.ready()
        n_ids, out, at = [0], [], 0
        simple = t["blank_starts"] and self.dummy_prefix
        while at < len(texts):
            for name in ("cuts", "words"):
                if len(t[name].known) > CACHE or t[name].letters > CACHE_LETTERS:
                    t[name] = _Table()
            size, words, ends = 0, [], []
            while at < len(texts) and size < GROUP:
                text = texts[at] or ""
                if simple and text and "  " not in text and text[0] != " " and text[-1] != " ":
                    words += text.split(" ")        # every word is its own run of cuts
                elif text:
                    # a word that starts with a blank stands for the whole text
                    words.append(" " + text)
                size += len(text)
                ends.append(len(words))
                at += 1
            where = list(map(t["words"].known.get, words))
            if None in where:
                self._learn_words(list(dict.fromkeys(c for c, w in zip(words, where) if w is None)))
                where = list(map(t["words"].known.get, words))
            ids, lens = t["words"].get(np.array(where, dtype=np.int64))
            out.append(ids)
            total = np.concatenate([[0], np.cumsum(lens)])
            n_ids += np.diff(total[np.array([0, *ends])]).tolist()
        ids = np.concatenate(out) if out else np.zeros(0, dtype=np.int32)
        offsets = np.cumsum(n_ids)
        if not t["bytes"] and len(ids):      # neighbouring unknown code points are one unknown id
            own = np.repeat(np.arange(len(texts)), np.diff(offsets))
            again = np.zeros(len(ids), dtype=bool)
            again[1:] = (ids[1:] == t["unk"]) & (ids[:-1] == t["unk"]) & (own[1:] == own[:-1])
            offsets = np.concatenate([[0], np.cumsum(np.bincount(own[~again], minlength=len(texts)))])
            ids = ids[~again]
        return offsets, ids

    def _learn_words(self, new: list[str]) -> None:
        t, cuts, ends = self._ready, [], [0]
        find = t["cut"].findall
        for w in new:
            whole = w[1:] if w[:1] == " " else w
            cuts += find((BLANK if self.dummy_prefix else "") + whole.replace(" ", BLANK))
            ends.append(len(cuts))
        where = list(map(t["cuts"].known.get, cuts))
        if None in where:
            fresh = list(dict.fromkeys(c for c, w in zip(cuts, where) if w is None))
            for k in range(0, len(fresh), SEGMENT):
                part = fresh[k:k + SEGMENT]
                t["cuts"].add(part, *self._segment(part))
            where = list(map(t["cuts"].known.get, cuts))
        ids, lens = t["cuts"].get(np.array(where, dtype=np.int64))
        total = np.concatenate([[0], np.cumsum(lens)])
        t["words"].add(new, np.diff(total[np.array(ends)]), ids)

    def _segment(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        t = self._ready
        text = "\0".join(c.replace("\0", "\U0010FFFF") for c in cuts) + "\0"
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        ends = np.flatnonzero(code == 0)
        first = np.concatenate([[0], ends[:-1] + 1])
        start, end, piece = edges(code, t["names"], t["live"], t["len"], t["letters"])
        # code points without a piece are edges of their own (piece -1)
        single = np.zeros(len(code), dtype=bool)
        single[start[end - start == 1]] = True
        lone = np.flatnonzero(~single & (code != 0))
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        owner = np.repeat(np.arange(len(cuts)), ends - first + 1)
        of = owner[start]
        rel = end - first[of]
        # by position within the cut; longest first within a place
        order = np.argsort((rel.astype(np.int64) << 40) | start)
        start, end, piece, of, rel = (x[order] for x in (start, end, piece, of, rel))
        last = np.full(len(code) + 1, -2, dtype=np.int64)       # piece that ends here; -2: none yet
        back = np.zeros(len(code) + 1, dtype=np.int64)
        best = np.full(len(code) + 1, -np.inf)
        best[first], last[first] = 0.0, -3                      # -3: the start of a cut
        bound = np.concatenate([[0], np.flatnonzero(np.diff(rel)) + 1, [len(rel)]])
        floor = self.scores[t["ids"]].min() - 10.0 if len(t["ids"]) else -10.0
        for lo, hi in zip(bound[:-1], bound[1:]):
            s, e, p, o = start[lo:hi], end[lo:hi], piece[lo:hi], of[lo:hi]
            group = np.concatenate([[0], np.flatnonzero(np.diff(o)) + 1])
            size = np.diff(np.append(group, hi - lo))
            if self.bpe:
                k = 0
                while len(group):
                    at = group + k
                    ok = (last[s[at]] != -2) & self._fits(last[s[at]], p[at])
                    hit = at[ok]
                    last[e[hit]], back[e[hit]] = p[hit], s[hit]
                    k += 1
                    more = ~ok & (size > k)
                    group, size = group[more], size[more]
            else:
                score = best[s] + np.where(p >= 0, self.scores[t["ids"][p]], floor)
                top = np.maximum.reduceat(score, group)
                hit = np.flatnonzero(score == np.repeat(top, size))
                hit = hit[np.unique(o[hit], return_index=True)[1]]
                best[e[hit]], last[e[hit]], back[e[hit]] = score[hit], p[hit], s[hit]
        # walk back from every end at once
        own, at, got_piece, got_start = np.arange(len(cuts)), ends.copy(), [], []
        while len(own):
            got_piece.append((own, last[at], back[at]))
            at = back[at]
            go = at > first[own]
            own, at = own[go], at[go]
        own, p, s = (np.concatenate(x) for x in zip(*got_piece)) if got_piece else (np.zeros(0, int),) * 3
        order = np.argsort(s)
        own, p, s = own[order], p[order], s[order]
        ids = np.where(p >= 0, t["ids"][np.maximum(p, 0)], -1).astype(np.int32)
        if (ids < 0).any():
            return self._with_bytes(cuts, own, ids, s, code)
        return np.bincount(own, minlength=len(cuts)), ids

    def _with_bytes(self, cuts, own, ids, s, code) -> tuple[np.ndarray, np.ndarray]:
        """Puts the byte pieces (or the unknown id) in the place of code points without a piece."""
        t, at = self._ready, np.flatnonzero(ids < 0)
        more = []
        for c in code[s[at]].tolist():
            raw = ("\0" if c == 0x10FFFF else chr(c)).encode()
            more.append([t["bytes"][b] for b in raw] if t["bytes"] else [t["unk"]])
        size = np.ones(len(ids), dtype=np.int64)
        size[at] = [len(m) for m in more]
        out = np.repeat(ids, size)
        out[out < 0] = [i for m in more for i in m]
        return np.bincount(np.repeat(own, size), minlength=len(cuts)), out

    def _fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a, b (merge ranks; negative: start or unknown) are the encoding of their text."""
        t = self._ready
        pair = a * len(t["names"]) + b
        slot = (pair * 0x9E3779B1 >> 8) & (MEMO - 1)
        out = t["memo_ok"][slot] | (a < 0) | (b < 0)
        new = np.flatnonzero((t["memo"][slot] != pair) & (a >= 0) & (b >= 0))
        if len(new):
            out[new] = self._pair_fits(a[new], b[new])
            t["memo"][slot[new]], t["memo_ok"][slot[new]] = pair[new], out[new]
            # several new pairs can share a slot; the last written owns it
            t["memo_ok"][slot[new]] = np.where(t["memo"][slot[new]] == pair[new], out[new], t["memo_ok"][slot[new]])
        return out

    def _pair_fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self._ready
        a, b = a.copy(), b.copy()
        ok, live = np.ones(len(a), dtype=bool), np.flatnonzero((a >= 0) & (b >= 0))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        n, pair, into, left, right = len(t["names"]), t["pair"], t["into"], t["left"], t["right"]
        while len(live):
            x, y, lim = a[live], b[live], limit[live]
            at = np.minimum(np.searchsorted(pair, x * n + y), max(len(pair) - 1, 0))
            clash = (pair[at] == x * n + y) & (into[at] < lim) if len(pair) else np.zeros(len(live), dtype=bool)
            ok[live[clash]] = False
            # undo the later of the two last merges; a merge across the cut had to come before it
            undo_left = x > y
            can_x, can_y = left[x] != x, left[y] != y
            take_x = np.where(undo_left, can_x, ~can_y & can_x)
            take_y = np.where(undo_left, ~can_x & can_y, can_y)
            limit[live] = np.where(take_x, x, np.where(take_y, y + 1, lim))
            a[live] = np.where(take_x, right[x], x)
            b[live] = np.where(take_y, left[y], y)
            live = live[~clash & (take_x | take_y)]
        return ok

    # --- decoding --------------------------------------------------------------------------------

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        raw = self.ready()["raw"]
        text = b"".join([raw[i] for i in ids] if ids is not None else []).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text

    def decode_rows(self, ids: np.ndarray, offsets: np.ndarray) -> Iterator[list[str]]:
        """The texts of rows of ids (row i: offsets[i] to offsets[i + 1]), some rows at a time; as ``decode``, with
        the bytes of all ids gathered at once."""
        t = self.ready()
        if "bytes_flat" not in t:
            size = np.array([len(b) for b in t["raw"]], dtype=np.int64)
            t |= {"bytes_flat": np.frombuffer(b"".join(t["raw"]), dtype=np.uint8), "bytes_len": size,
                  "bytes_first": np.cumsum(size) - size}
        lo = 0
        while lo + 1 < len(offsets):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + TOKENS, "right")) - 1)
            some = ids[offsets[lo]:offsets[hi]]
            size = t["bytes_len"][some]
            raw = t["bytes_flat"][ranges(t["bytes_first"][some], size)].tobytes()
            at = np.concatenate([[0], np.cumsum(size)])[offsets[lo:hi + 1] - offsets[lo]].tolist()
            skip = [a + (self.dummy_prefix and raw[a:a + 1] == b" " and a < b) for a, b in zip(at[:-1], at[1:])]
            yield [raw[a:b].decode("utf-8", "replace") for a, b in zip(skip, at[1:])]
            lo = hi


class _Table:
    """Strings with their ids, gathered by position."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.letters = 0
        self.first, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)

    def add(self, names: list[str], lens: np.ndarray, ids: np.ndarray) -> None:
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.letters += sum(map(len, names))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lens)])
        self.flat = np.concatenate([self.flat, ids])

    def get(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.first[at + 1] - self.first[at]
        return self.flat[ranges(self.first[at], lens)], lens


def _merge(piece: str, rank: dict[str, int]) -> tuple[int, int] | None:
    """The last two symbols that merges join into ``piece`` (their ranks), or None if they don't reach it."""
    parts, got = list(piece), None
    while len(parts) > 1:
        r, k = min(((rank.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1)))
        if r == 1 << 60:
            return None
        got = rank.get(parts[k]), rank.get(parts[k + 1])
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return got if got and None not in got else None


def suffixes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int, np.ndarray]:
    """(suffix array, first letters of the suffixes in its order and by place, letters and bits of a key, alphabet);
    0 ends a suffix. The order goes by as many letters as a 64-bit key holds, which is more than most pieces have."""
    alphabet, dense = np.unique(code, return_inverse=True)
    bits = max(int(len(alphabet) - 1).bit_length(), 1)
    per = min(KEY, 64 // bits)
    dense = dense.astype(np.uint64)
    key = dense.copy()
    live = dense > 0            # whether the suffix goes on so far
    for k in range(1, per):
        key <<= np.uint64(bits)
        live[-k:] = False
        live[:-k] &= dense[k:] > 0
        key[:-k] |= np.where(live[:-k], dense[k:], 0)
    order = np.argsort(key)
    return order, key[order], key, per, bits, alphabet


def edges(code: np.ndarray, names: list[str], live: np.ndarray, length: np.ndarray, letters: np.ndarray):
    """All occurrences of the pieces: (start, end, piece), from ranges of the suffix array."""
    order, key, by_place, per, bits, alphabet = suffixes(code)
    # letters of the pieces in the batch's alphabet; pieces with other letters don't occur
    known = np.searchsorted(alphabet, letters[live]).clip(max=len(alphabet) - 1)
    own = (alphabet[known] == letters[live]) | (letters[live] == 0)
    use = live[own.all(1)]
    known = np.where(letters[use] > 0, known[own.all(1)], 0).astype(np.uint64)

    def bounds(first: int) -> tuple[np.ndarray, np.ndarray]:
        low = np.zeros(len(use), dtype=np.uint64)
        high = np.zeros(len(use), dtype=np.uint64)
        for k in range(first, first + per):
            here = length[use] > k
            low = low << np.uint64(bits) | np.where(here, known[:, k], 0).astype(np.uint64)
            high = high << np.uint64(bits) | np.where(here, known[:, k], (1 << bits) - 1).astype(np.uint64)
        return low, high

    low, high = bounds(0)
    lo, hi = np.searchsorted(key, low, "left"), np.searchsorted(key, high, "right")
    n = np.maximum(hi - lo, 0)
    start = order[ranges(lo, n)]
    which = np.repeat(np.arange(len(use)), n)
    # pieces beyond the key: the letters after it are compared within the range
    more = np.flatnonzero(length[use][which] > per)
    if len(more):
        low, high = bounds(per)
        after = start[more] + per
        rest = by_place[np.minimum(after, len(code) - 1)]
        good = (after < len(code)) & (rest >= low[which[more]]) & (rest <= high[which[more]])
        for i in np.flatnonzero(good & (length[use][which[more]] > 2 * per)).tolist():
            s, name = int(start[more[i]]), names[use[which[more[i]]]]
            good[i] = code[s:s + len(name)].tobytes() == name.encode("utf-32-le")
        keep = np.ones(len(which), dtype=bool)
        keep[more[~good]] = False
        start, which = start[keep], which[keep]
    piece = use[which]
    return start, start + length[piece], piece


def load(path: str = MODEL) -> Vocab:
    with open(path, "rb") as f:
        return Vocab.parse(f.read())


def encoded(vocab: Vocab, text: pa.Array) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray]]:
    """(texts, offsets, ids), some rows at a time."""
    for k in range(0, len(text), ROWS):
        texts = text[k:k + ROWS].to_pylist()
        yield texts, *vocab.encode(texts)


def lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    size = [np.diff(offsets) for offsets, _ in parts]
    offsets = np.cumsum(np.concatenate([np.zeros(1, dtype=np.int64), *size]))
    ids = np.concatenate([np.zeros(0, dtype=np.int32), *(ids for _, ids in parts)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def codec(spark: SparkSession, path: str = MODEL):
    """Column functions (encode: text -> array<int>, decode: array<int> -> text)."""
    held = spark.sparkContext.broadcast(load(path))

    @F.arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return lists([(offsets, ids) for _, offsets, ids in encoded(held.value, text)])

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size)])
        parts = [pa.array(p, pa.string()) for p in held.value.decode_rows(ids.flatten().to_numpy(), offsets)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return (lambda c: encode(c)), (lambda c: decode(c))


def round_trip(spark: SparkSession, path: str = MODEL):
    """Column function text -> struct of token_ids and round_trip (the ids decode to the text). One function, as
    two chained ones would encode every text twice."""
    held = spark.sparkContext.broadcast(load(path))

    @F.arrow_udf("struct<token_ids: array<int>, round_trip: boolean>")
    def run(text: pa.Array) -> pa.Array:
        parts, same = [], []
        for texts, offsets, ids in encoded(held.value, text):
            back = (t for some in held.value.decode_rows(ids, offsets) for t in some)
            same += [b == (t or "").replace(BLANK, " ") for t, b in zip(texts, back, strict=True)]
            parts.append((offsets, ids))
        return pa.StructArray.from_arrays([lists(parts), pa.array(same, pa.bool_())], ["token_ids", "round_trip"])

    return lambda c: run(c)


def with_tokens(docs: DataFrame, path: str = MODEL, ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """``docs`` with the ids of each text and their number; columns that have these names already are replaced."""
    encode, _ = codec(docs.sparkSession, path)
    return docs.withColumn(ids, encode(F.col("text"))).withColumn(count, F.size(ids))


def with_round_trip(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``docs`` with token_ids, n_tokens and round_trip (the ids decode to the text, null as the empty one); columns that
    have these names already are replaced."""
    name = fresh_name(docs, "found")
    found = docs.withColumn(name, round_trip(docs.sparkSession, path)(F.col("text")))
    return found.withColumns({"token_ids": F.col(name)["token_ids"], "n_tokens": F.size(F.col(name)["token_ids"]),
                              "round_trip": F.col(name)["round_trip"]}).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip (the ids decode to the text) for every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("found", round_trip(spark)(F.col("text")))
    return docs.select("doc_id", F.size("found.token_ids").alias("n_tokens"), "found.token_ids", "found.round_trip")
