"""Operator 1: SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a slice are laid out as one flat symbol array, cut into segments: at word
ends, and between characters that no piece holds side by side, as nothing ever merges there. So
a word of any length (text without blanks, a binary blob) becomes many short segments. In each
round every pair of neighbours has a rank from the vocabulary, a segmented minimum gives each
segment's best rank, all leftmost non-overlapping pairs of that rank merge at once, and the
arrays are compacted; segments without a pair left drop out. Merging many pairs at once equals
the library's one-at-a-time order only until a merge makes a pair that ranks as well or better;
where the vocabulary allows that, a segment's merges after the first such one wait for a round.
Only a segment of over ``LONG`` symbols that has to wait (in public vocabularies: a run of
blanks, whose longer pieces rank better) is finished with a heap, as it could wait for a round a
symbol.

Defined results: null and empty texts have no ids and decode to the empty text; rows stay as
they are, repeated rows included; of equally good merges the leftmost comes first, as in the
library; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
NONE = np.int32(0x7FFFFFFF)
LONG = 1024


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of every field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


class Pieces:
    """A BPE vocabulary with byte fallback, read from a model file's bytes."""

    def __init__(self, model: bytes):
        self.text: list[str] = []
        scores, kinds = [], []
        self.prefix = True
        for number, value in _fields(model):
            if number == 1:
                piece, score, kind = "", 0.0, 1
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.text.append(piece)
                scores.append(score)
                kinds.append(kind)
            elif number == 3:
                rules = dict(_fields(value))
                self.prefix = bool(rules.get(3, 1))
                if rules.get(1, b"") not in (b"identity", b"") or rules.get(4, 1) or rules.get(5, 1) == 0:
                    raise ValueError("only identity normalisation that keeps all blanks is supported")
        n = self.size = len(self.text)
        kinds = np.array(kinds)
        if (kinds == 4).any():
            raise ValueError("user-defined pieces are not supported")
        self.byte_id = np.full(256, int(np.flatnonzero(kinds == 2)[0]), np.int64)
        self.id_byte = np.full(n, -1, np.int64)
        for i in np.flatnonzero(kinds == 6):
            b = int(self.text[i][3:-1], 16)
            self.byte_id[b], self.id_byte[i] = i, b
        normal = [i for i in range(n) if kinds[i] in (1, 5)]
        known = {self.text[i]: i for i in reversed(normal)}
        self.char_id = np.arange(0x110000, dtype=np.int64) + n  # characters without a piece
        for p, i in known.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        levels = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
        rank = {p: levels[scores[i]] for p, i in known.items()}
        part = lambda p: known.get(p) if len(p) > 1 else int(self.char_id[ord(p)])
        keys, ranks, merged = [], [], []
        self.chain = np.zeros(len(levels) + 1, bool)  # ranks whose merges may make a pair that ranks as well
        for p, i in known.items():
            for cut in range(1, len(p)):
                a, b = part(p[:cut]), part(p[cut:])
                if a is not None and b is not None:
                    keys.append(a << 21 | b)
                    ranks.append(rank[p])
                    merged.append(i)
                    for side in (p[:cut], p[cut:]):
                        if len(side) > 1 and rank[p] <= rank[side]:
                            self.chain[rank[side]] = True
        self.beside = np.unique([ord(a) << 21 | ord(b) for p in known for a, b in zip(p, p[1:])] or [0]).astype(np.int64)
        order = np.argsort(keys)
        self._hash(np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order], np.array(merged, np.int32)[order])
        crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in known)
        if crossing:
            raise ValueError("a piece reaches over a word start")
        self.breaks_line = not any("\n" in p for p in known)
        self.split = re.compile(f"{MARK}+[^{MARK}\n]*|\n|[^{MARK}\n]+" if self.breaks_line else f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        shown = ["" if k == 3 else " ⁇ " if k == 2 else t.replace(MARK, " ") for t, k in zip(self.text, kinds)]
        self.shown = shown
        self.silent = kinds == 3
        self.names = [str(i) for i in range(n)]
        self.clear()

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing table for whole arrays of lookups."""
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift, size = np.uint64(64 - bits), 1 << bits
        self.t_key, self.t_rank, self.t_id = np.full(size, -1, np.int64), np.full(size, NONE, np.int32), np.zeros(size, np.int32)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            at = slot[left]
            free = left[self.t_key[at] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.t_key[slot[put]], self.t_rank[slot[put]], self.t_id[slot[put]] = keys[put], ranks[put], merged[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            left = left[~done[left]]
            slot[left] = (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if no piece) and merged id of each pair of symbols."""
        keys = left << 21 | right
        slot = self._slot(keys)
        rank, out = np.full(len(keys), NONE, np.int32), np.zeros(len(keys), np.int32)
        open_, size = np.arange(len(keys)), len(self.t_key)
        for _ in range(self.probes):
            at = slot[open_]
            there = self.t_key[at]
            hit = there == keys[open_]
            rank[open_[hit]], out[open_[hit]] = self.t_rank[at[hit]], self.t_id[at[hit]]
            go = ~hit & (there >= 0)
            open_ = open_[go]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % size
        return rank, out

    def _segments(self, codes: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segment of every character, and the word of every segment."""
        if not len(codes):
            return word, word
        pair = codes[:-1].astype(np.int64) << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        first = np.r_[True, (word[1:] != word[:-1]) | (self.beside[at] != pair)]
        return np.cumsum(first) - 1, word[first]

    def _before_better(self, symbols: np.ndarray, seg: np.ndarray, at: np.ndarray, new: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Which of the merges at places ``at`` (to symbols ``new``) come before or with the first of their segment that makes a pair of a rank up to ``top``."""
        n = len(symbols)
        beside = np.r_[False, at[1:] - at[:-1] == 2]  # the symbol on the left has just been merged
        left = np.where(beside, np.r_[0, new[:-1]], symbols[np.maximum(at - 1, 0)])
        better = (at > 0) & (seg[np.maximum(at - 1, 0)] == seg[at]) & (self.ranks(left.astype(np.int64), new.astype(np.int64))[0] <= top)
        right = np.minimum(at + 2, n - 1)
        better |= (at + 2 < n) & (seg[right] == seg[at]) & (self.ranks(new.astype(np.int64), symbols[right])[0] <= top)
        first = np.flatnonzero(np.r_[True, seg[at[1:]] != seg[at[:-1]]])
        count = np.cumsum(better) - better  # better pairs made earlier
        return count == np.repeat(count[first], np.diff(np.r_[first, len(at)]))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each word has."""
        counts = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char_id[codes]
        seg, owner = self._segments(codes, np.repeat(np.arange(len(words)), counts))
        done_sym, done_seg = [], []
        rank, new = np.full(len(symbols), NONE, np.int32), np.zeros(len(symbols), np.int32)
        at = np.flatnonzero(seg[:-1] == seg[1:])  # whose pair with the next symbol is to be looked up
        while len(symbols):
            rank[at], new[at] = self.ranks(symbols[at], symbols[at + 1])
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seg)])
            if (best == NONE).any():  # these segments are finished
                over = np.repeat(best == NONE, size)
                done_sym.append(symbols[over])
                done_seg.append(seg[over])
                symbols, seg, rank, new = (x[~over] for x in (symbols, seg, rank, new))
                size, best = size[best != NONE], best[best != NONE]
                if not len(symbols):
                    break
            top = np.repeat(best, size)
            at = np.flatnonzero(rank == top)
            start = np.r_[True, (np.diff(at) > 1) | (seg[at[1:]] != seg[at[:-1]])]
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            pick = (np.arange(len(at)) - run) % 2 == 0
            at = at[pick]
            chain = self.chain[top[at]]
            if chain.any():
                some = at[chain]
                wait = np.zeros(len(at), bool)
                wait[chain] = ~self._before_better(symbols, seg, some, new[some], top[some])
                first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                size = np.diff(np.r_[first, len(seg)])
                held = np.isin(seg[first], seg[at[wait]]) & (size > LONG)
                if held.any():
                    for k in np.flatnonzero(held):
                        out = self._heap(symbols[first[k] : first[k] + size[k]].tolist())
                        done_sym.append(np.array(out, np.int64))
                        done_seg.append(np.full(len(out), seg[first[k]]))
                    over = np.repeat(held, size)
                    symbols, seg, rank, new = (x[~over] for x in (symbols, seg, rank, new))
                    at = np.zeros(0, np.int64)
                    continue
                at = at[~wait]
            symbols[at] = new[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            rank[at] = NONE
            touched = np.zeros(len(symbols), bool)
            touched[at] = True
            before = at[at > 0] - 1
            before = np.where(keep[before], before, before - 1)
            touched[before] = True
            symbols, seg, rank, new, touched = (x[keep] for x in (symbols, seg, rank, new, touched))
            rank[touched] = NONE
            at = np.flatnonzero(touched[:-1] & (seg[:-1] == seg[1:]))
        symbols = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        seg = np.concatenate(done_seg) if done_seg else np.zeros(0, np.int64)
        order = np.argsort(seg, kind="stable")
        symbols, seg = symbols[order], seg[order]
        odd = np.flatnonzero(symbols >= self.size)
        if len(odd):  # characters without a piece become bytes
            spelt = [self.byte_id[np.frombuffer(chr(c - self.size).encode("utf-8", "surrogatepass"), np.uint8)] for c in symbols[odd].tolist()]
            n = np.ones(len(symbols), np.int64)
            n[odd] = [len(x) for x in spelt]
            to = np.repeat(symbols, n)
            wide = np.repeat(symbols >= self.size, n)
            to[wide] = np.concatenate(spelt)
            symbols, seg = to, np.repeat(seg, n)
        return symbols, np.bincount(owner[seg], minlength=len(words))

    def _heap(self, symbols: list[int]) -> list[int]:
        """Merges one at a time: the best rank, then the leftmost place."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self.ranks(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        queue = [(int(r), i, symbols[i], symbols[i + 1], i + 1, int(m)) for i, (r, m) in enumerate(zip(rank, made)) if r != NONE]
        heapq.heapify(queue)
        known: dict[int, tuple[int, int]] = {}
        while queue:
            _, i, a, b, j, m = heapq.heappop(queue)
            if symbols[i] != a or after[i] != j or symbols[j] != b:
                continue
            symbols[i], symbols[j] = m, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (i, before[i]):
                y = after[x] if x >= 0 else n
                if y < n:
                    pair = symbols[x] << 21 | symbols[y]
                    if pair not in known:
                        r, made = self.ranks(np.array([symbols[x]], np.int64), np.array([symbols[y]], np.int64))
                        known[pair] = int(r[0]), int(made[0])
                    r, to = known[pair]
                    if r != NONE:
                        heapq.heappush(queue, (r, x, symbols[x], symbols[y], y, to))
        return [x for x in symbols if x >= 0]

    def decode(self, ids, lead: bool = True) -> str:
        """The text of ids; ``lead``: without the blank that encoding put first."""
        out, run = [], bytearray()
        for i in ids:
            if (b := int(self.id_byte[i])) >= 0:
                run.append(b)
                continue
            if run:
                out.append(_spell(bytes(run)))
                run = bytearray()
            out.append(self.shown[i])
        if run:
            out.append(_spell(bytes(run)))
        text = "".join(out)
        said = next((i for i in ids if not self.silent[i]), None)
        return text[1:] if lead and self.prefix and said is not None and self.text[said][:1] == MARK else text

    def clear(self) -> None:
        self.cache: dict[str, tuple[int, str, str]] = {}

    def known(self, words: set[str], most: int = 250_000) -> dict[str, tuple[int, str, str]]:
        """word -> (number of ids, ids joined by commas, decoded word), for these words at least."""
        cache = self.cache
        new = [w for w in words if w not in cache]
        if len(cache) + len(new) > most:
            self.clear()
            cache, new = self.cache, list(words)
        for i in range(0, len(new), 50_000):
            some = new[i : i + 50_000]
            flat, n = self.encode_words(some)
            odd = np.zeros(len(some), bool)
            odd[np.repeat(np.arange(len(some)), n)[self.id_byte[flat] >= 0]] = True
            flat, end = flat.tolist(), 0
            names, shown = [self.names[x] for x in flat], [self.shown[x] for x in flat]
            for w, k, bytes_ in zip(some, n.tolist(), odd.tolist()):
                begin, end = end, end + k
                cache[w] = (k, ",".join(names[begin:end]), self.decode(flat[begin:end], False) if bytes_ else "".join(shown[begin:end]))
        return cache

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        flat, _ = self.encode_words(self.words(text))
        return flat.tolist()

    def words(self, text: str) -> list[str]:
        return self.split(MARK * self.prefix + text.replace(" ", MARK))


def _spell(data: bytes) -> str:
    """UTF-8 with one replacement character for every byte that fits nowhere."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at : at + e.start].decode())
            out.append("�")
            at += e.start + 1
    return "".join(out)


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """One vocabulary a process."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encoded(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (joined by commas), decoded text of every row."""
    return _map(docs, model, key, text, "n_tokens long, ids string, decoded string", lambda n, ids, back: (n, ids, back))


def digests(docs: DataFrame, model: bytes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of every row."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _map(docs, model, key, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda n, ids, back: (n, sha(ids), sha(back)))


def _map(docs: DataFrame, model: bytes, key: str, text: str, schema: str, row) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        pieces = load(model)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            out = []
            while at < len(texts):  # a few MB at a time
                some, chars = [], 0
                while at < len(texts) and chars < 4_000_000:
                    some.append(pieces.words(t) if (t := texts[at]) else [])
                    chars += len(t or "")
                    texts[at] = None
                    at += 1
                cache = pieces.known(set().union(*some))
                for w in some:
                    hits = [cache[x] for x in w]
                    back = "".join([x[2] for x in hits])
                    out.append(row(sum([x[0] for x in hits]), ",".join([x[1] for x in hits]), back[1:] if pieces.prefix else back))
            columns = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=[key, *names])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {schema}")
