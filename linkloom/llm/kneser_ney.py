"""Operator 2: language-model scores from an interpolated modified Kneser-Ney bigram model.

Tokens are words with A-Z in lower case, then one end token for each text. Map tasks count
words and pairs as sorted arrays of 64-bit hashes and send them on as packed blocks, one for
each hash range; a range's blocks are merged by sorting. The number of ranges follows the bytes
of text, so that what is merged at once stays of one size: pairs come in parts, a file's parts one
after another in one stream. The model is written to the shared folder as sorted hash arrays, one
file a range, and scoring tasks map the files into memory.

* word files: hash, count, number of different words before it, numbers of pairs it begins
  that were seen once, twice, three times or more, in 64 bits each;
* pair files: hash of the pair, count in 32 bits, or the mark that a second file has it in 64;
  beside them where each part begins.

Pairs are dealt by their first word, so that what a word begins is counted in one place,
except those of words with over a fixed share of all tokens, which are dealt by both words:
those words are at most ``HEAVY`` many, and their partial counts are summed in a second step.

Defined results: a null or empty text is the end token alone; an empty training table scores
every token by its base score; repeated rows count as often as they come; a text of any length is scored whole, by one task; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import _text as tx
from linkloom.llm._run import Scratch, folder, mounted, remove

U64 = np.uint64
END, START = U64(0x0E4D0E4D0E4D0E4D), U64(0x57A457A457A457A5)
#: Words with over 1 / HEAVY of all tokens: fewer than HEAVY.
HEAVY = 512
WORD = np.dtype([(c, "<u8") for c in ("h", "n", "before", "one", "two", "more")])
PAIR = np.dtype([("h", "<u8"), ("n", "<u4")])
LARGE = np.dtype([("h", "<u8"), ("n", "<u8")])
#: A pair's count from here on stands in a file of its own.
MOST = 0xFFFFFFFF
BLOCK = "range int, part int, data binary"
#: Bytes of text for each part of the pairs, which is merged at once; most files, each of one or more parts.
PART_BYTES, FILES = 32 << 20, 4096


@dataclass(frozen=True)
class Model:
    """Where the files are, and the totals that every score needs."""

    path: str
    ranges: int
    parts: int  # of the pairs, in each range
    tokens: int
    words: int
    pairs: int  # different pairs
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_kinds: tuple[int, int, int]  # words with 1, 2, 3 or more different words before them
    heavy: tuple[int, ...]  # hashes of the words whose pairs are dealt by both words


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens, the end tokens included, and the first token of every row (n + 1 numbers)."""
    start, end, doc = tx.words(buf, offs)
    n = len(offs) - 1
    begin = np.r_[0, np.cumsum(np.bincount(doc, minlength=n) + 1)]
    out = np.full(begin[-1], END, U64)
    out[np.arange(len(start)) + doc] = tx.byte_prefix(tx.lower(buf)).spans(start, end)
    return out, begin


def _pairs(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The word before every token."""
    out = np.r_[START, h[:-1]] if len(h) else h
    out[begin[:-1]] = START
    return out


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)


def _packed(*columns: np.ndarray) -> bytes:
    """Arrays as one block; the first is sorted and kept as differences."""
    first = np.diff(columns[0], prepend=U64(0))
    data = b"".join(_field(c) for c in (first, *columns[1:]))
    return len(columns[0]).to_bytes(8, "little") + data


def _field(c: np.ndarray) -> bytes:
    import zstandard

    planes = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T  # byte by byte: high bytes are mostly 0
    data = zstandard.ZstdCompressor(level=1).compress(planes.tobytes())
    return c.dtype.itemsize.to_bytes(1, "little") + len(data).to_bytes(8, "little") + data


def _unpacked(block: bytes) -> list[np.ndarray]:
    import zstandard

    n, at, out = int.from_bytes(block[:8], "little"), 8, []
    while at < len(block):
        wide, size = block[at], int.from_bytes(block[at + 1 : at + 9], "little")
        at += 9
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[at : at + size], max_output_size=max(1, n * wide)), np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(wide, n).T).view(f"<u{wide}").ravel())
        at += size
    if out:
        out[0] = np.cumsum(out[0], dtype=U64)
    return out


def _summed(h: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Sums of the values by equal h, sorted."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return [h[first], *(np.add.reduceat(v[order], first) if len(h) else v for v in values)]


def _small(v: np.ndarray) -> np.ndarray:
    top = int(v.max(initial=0))
    return v.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def _blocks(where: np.ndarray, parts: int, *columns: np.ndarray):
    """A row (range, part, block) for each place that ``where`` names: range * parts + part."""
    order = np.argsort(where, kind="stable")
    at, first = np.unique(where[order], return_index=True)
    rows = [(int(w) // parts, int(w) % parts, _packed(*(c[order[a:b]] for c in columns))) for w, a, b in zip(at, first, np.r_[first[1:], len(order)])]
    r, p, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(p, pa.int32()), pa.array(d, pa.binary())], names=["range", "part", "data"])


def _dealt(blocks: DataFrame, ranges: int) -> DataFrame:
    """One partition a range, its parts in order."""
    return blocks.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "part")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[list[np.ndarray]]]]:
    """(range, part, its blocks), one after another."""
    key, held = None, []
    for batch in batches:
        for r, p, data in zip(*(batch.column(c) for c in ("range", "part", "data"))):
            if key != (r.as_py(), p.as_py()):
                if held:
                    yield *key, held
                key, held = (r.as_py(), p.as_py()), []
            held.append(_unpacked(data.as_py()))
    if held:
        yield *key, held


def _counted(batches, what, most: int = 3_000_000):
    """Blocks of what(hashes, row starts), summed over some millions of tokens."""
    held, size = [], 0
    for batch in batches:
        for _, _, buf, offs in tx.slices(batch.column(0)):
            held.append(tokens(buf, offs))
            size += len(held[-1][0])
            if size >= most:
                yield from what(held)
                held, size = [], 0
    if held:
        yield from what(held)


def _word_blocks(ranges: int):
    def what(held):
        h, n = np.unique(np.concatenate([t for t, _ in held]), return_counts=True)
        yield _blocks(_range(h, ranges), 1, h, _small(n))

    return lambda batches: _counted(batches, what)


def _pair_blocks(ranges: int, parts: int, heavy: np.ndarray):
    """(first word, second word, count), dealt by the first word or, if that is heavy, by both."""

    def what(held):
        a = np.concatenate([_pairs(t, b) for t, b in held])
        b = np.concatenate([t for t, _ in held])
        order = np.argsort(tx.pair(a, b), kind="stable")
        a, b = a[order], b[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        n = np.diff(np.r_[first, len(a)])
        a, b = a[first], b[first]
        order = np.argsort(a, kind="stable")
        a, b, n = a[order], b[order], n[order]
        by = np.where(np.isin(a, heavy), tx.pair(a, b), a)
        yield _blocks(_range(by, ranges * parts), parts, a, b, _small(n))

    return lambda batches: _counted(batches, what)


def _save(path: str, name: str, rows: np.ndarray) -> None:
    """Whole files only: a repeated task writes the same file again."""
    own = f"{path}/.{name}.{os.getpid()}.{os.urandom(6).hex()}"
    rows.tofile(own)
    os.replace(own, f"{path}/{name}")


STATS = "range int, part int, data binary, n long, kinds array<long>"


def _stats(r: int, part: int, data: bytes | None, n: int, kinds: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary()), pa.array([n], pa.int64()), pa.array([kinds], pa.list_(pa.int64()))], names=["range", "part", "data", "n", "kinds"])


def _kinds(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)] + [int((n >= 3).sum())]


def _discounts(k: np.ndarray) -> tuple[float, float, float]:
    """The usual estimates from how many n-grams were seen 1 to 4 times, each kept within its count."""
    n1, n2, n3, n4 = (max(float(x), 1.0) for x in k[:4])
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(c - (c + 1) * y * b / a, 0.05), c - 0.05) for c, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(texts: DataFrame, column: str = "text", part_bytes: int = PART_BYTES) -> Model:
    """The model of one text column's rows."""
    spark = texts.sparkSession
    size = int(texts.agg(F.sum(F.octet_length(column))).first()[0] or 0)
    parts = -(-size // part_bytes) or 1
    ranges = min(parts, FILES)
    parts = -(-parts // ranges)
    path = mounted(folder(spark, "kneser-ney"))
    with Scratch(spark) as own:
        return _train(own, texts.select(column), path, ranges, parts)


def _train(own: Scratch, texts: DataFrame, path: str, ranges: int, parts: int) -> Model:
    def merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _, blocks in _runs(batches):
            h, n = _summed(np.concatenate([p[0] for p in blocks]), np.concatenate([p[1].astype(U64) for p in blocks]))
            out = np.zeros(len(h), LARGE)
            out["h"], out["n"] = h, n
            _save(path, f"count-{r}", out)
            top = np.argsort(n)[-HEAVY:]
            yield _stats(r, 0, _field_pair(h[top], n[top]), int(n.sum()), [len(h)])

    counted = own.settle(_dealt(texts.mapInArrow(_word_blocks(ranges), BLOCK), ranges).mapInArrow(merge_words, STATS), "words")
    total, kinds = counted.agg(F.sum("n"), F.sum(F.col("kinds")[0])).first()
    total, different = int(total or 0), int(kinds or 0)

    def only_heavy(batches):
        for batch in batches:
            for data in batch.column(0):
                h, n = np.frombuffer(data.as_py(), np.uint64).reshape(2, -1)
                h = h[n > total / HEAVY]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    found = [r.h for r in counted.select("data").mapInArrow(only_heavy, "h long").collect()]  # under HEAVY rows
    heavy = np.r_[np.array(sorted(found), np.int64).view(U64), START]

    def merge_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Writes a range's parts in order; hands on what its words begin and end."""
        file: _Parts | None = None
        held: list[list[np.ndarray]] = []

        def words():
            stats = _summed(*(np.concatenate(c) for c in zip(*held)))
            held.clear()
            blocks = _blocks(_range(stats[0], ranges), 1, stats[0], *(_small(x) for x in stats[1:]))
            for i in range(blocks.num_rows):
                yield _stats(blocks.column(0)[i].as_py(), 1, blocks.column(2)[i].as_py(), 0, [0] * 5)

        for r, part, blocks in _runs(batches):
            if file is None or file.range != r:
                if file is not None:
                    file.close()
                file = _Parts(path, r, parts)
            a, b, n = (np.concatenate([p[i] for p in blocks]) for i in range(3))
            del blocks
            key = tx.pair(a, b)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            n = np.add.reduceat(n[order].astype(U64), first)
            a, b, key = a[order[first]], b[order[first]], key[first]
            file.add(part, key, n)
            h, one, two, more = _summed(a, (n == 1).astype(U64), (n == 2).astype(U64), (n >= 3).astype(U64))
            zero = np.zeros(len(h), U64)
            w, before = np.unique(b, return_counts=True)
            held.append(_summed(np.r_[h, w], np.r_[zero, before.astype(U64)], *(np.r_[x, np.zeros(len(w), U64)] for x in (one, two, more))))
            yield _stats(r, 0, None, len(key), _kinds(n))
            if sum(len(x[0]) for x in held) > 2_000_000:
                yield from words()
        if file is not None:
            file.close()
        if held:
            yield from words()

    pairs = own.settle(_dealt(texts.mapInArrow(_pair_blocks(ranges, parts, heavy), BLOCK), ranges).mapInArrow(merge_pairs, STATS), "pairs")

    def merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, _, blocks in _runs(batches):
            stats = _summed(*(np.concatenate([p[i].astype(U64) for p in blocks]) for i in range(5)))
            name = f"{path}/count-{r}"
            counts = np.fromfile(name, LARGE) if os.path.exists(name) else np.zeros(0, LARGE)
            h = np.union1d(stats[0], counts["h"])
            out = np.zeros(len(h), WORD)
            out["h"] = h
            out["n"][np.searchsorted(h, counts["h"])] = counts["n"]
            at = np.searchsorted(h, stats[0])
            for field, v in zip(("before", "one", "two", "more"), stats[1:]):
                out[field][at] = v
            _save(path, f"word-{r}", out)
            yield _stats(r, 0, None, 0, _kinds(out["before"]))

    words = own.settle(_dealt(pairs.filter("part = 1").select("range", "part", "data"), ranges).mapInArrow(merge_all, STATS), "kinds")
    sums = lambda df: [int(x or 0) for x in df.agg(*(F.sum(F.col("kinds")[i]) for i in range(5))).first()]
    pair_kinds, word_kinds = sums(pairs.filter("part = 0")), sums(words)
    number = int(pairs.agg(F.sum("n")).first()[0] or 0)
    return Model(path, ranges, parts, total, different, number, _discounts(np.array(pair_kinds)), _discounts(np.array(word_kinds)), (word_kinds[0], word_kinds[1], word_kinds[4]), tuple(heavy.tolist()))


class _Parts:
    """A range's pair files while they are written; whole files only take their names."""

    def __init__(self, path: str, r: int, parts: int):
        self.path, self.range, self.sizes = path, r, np.zeros(parts, np.int64)
        self.own = f"{path}/.pair-{r}.{os.getpid()}.{os.urandom(6).hex()}"
        self.file = open(self.own, "wb")
        self.large: list[np.ndarray] = []

    def add(self, part: int, key: np.ndarray, n: np.ndarray) -> None:
        out = np.zeros(len(key), PAIR)
        out["h"], out["n"] = key, np.minimum(n, U64(MOST))
        out.tofile(self.file)
        self.sizes[part] = len(key)
        big = n >= MOST
        if big.any():
            rows = np.zeros(int(big.sum()), LARGE)
            rows["h"], rows["n"] = key[big], n[big]
            self.large.append(rows)

    def close(self) -> None:
        self.file.close()
        if self.large:
            _save(self.path, f"large-{self.range}", np.sort(np.concatenate(self.large), order="h"))
        _save(self.path, f"at-{self.range}", np.r_[0, np.cumsum(self.sizes)])
        os.replace(self.own, f"{self.path}/pair-{self.range}")


def _field_pair(h: np.ndarray, n: np.ndarray) -> bytes:
    return np.stack([h, n.astype(U64)]).tobytes()


class _Mapped:
    """The rows of each range, whose file is mapped when the range is first met."""

    def __init__(self, path: str, kind: np.dtype):
        self.path, self.kind, self.held = path, kind, {}

    def __getitem__(self, r: int) -> np.ndarray:
        if r not in self.held:
            path = f"{self.path}-{r}"
            there = os.path.exists(path) and os.path.getsize(path)
            self.held[r] = np.memmap(path, self.kind, "r") if there else np.zeros(0, self.kind)
        return self.held[r]


class Reader:
    """The mapped files of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.pairs, self.at, self.large = (_Mapped(f"{model.path}/{name}", kind) for name, kind in (("word", WORD), ("pair", PAIR), ("at", np.dtype("<i8")), ("large", LARGE)))
        self.heavy = np.array(model.heavy, U64)

    def _part(self, q: int) -> np.ndarray:
        """The pairs of a part, counted over all ranges."""
        r, part = divmod(q, self.model.parts)
        return self.pairs[r][self.at[r][part] : self.at[r][part + 1]] if len(self.at[r]) else self.pairs[r]

    def _find(self, rows_of, number: int, by: np.ndarray, h: np.ndarray, fields: list[str]) -> np.ndarray:
        """Values of sorted hashes h, looked up in the rows that ``by`` falls into; 0 if absent."""
        out = np.zeros((len(fields), len(h)), np.int64)
        where = _range(by, number)
        order = np.lexsort((h, where))
        at_, first = np.unique(where[order], return_index=True)
        for q, begin, end in zip(at_.tolist(), first, np.r_[first[1:], len(order)]):
            own, rows = order[begin:end], rows_of(q)
            if not len(rows):
                continue
            at = np.minimum(np.searchsorted(rows["h"], h[own]), len(rows) - 1)
            got = rows[at]
            hit = got["h"] == h[own]
            for k, field in enumerate(fields):
                out[k, own[hit]] = got[field][hit]
        return out

    def word(self, h: np.ndarray) -> np.ndarray:
        return self._find(self.words.__getitem__, self.model.ranges, h, h, ["n", "before", "one", "two", "more"])

    def pair(self, by: np.ndarray, h: np.ndarray) -> np.ndarray:
        m = self.model
        (n,) = self._find(self._part, m.ranges * m.parts, by, h, ["n"])
        big = np.flatnonzero(n == MOST)
        if len(big):
            (n[big],) = self._find(lambda q: self.large[q // m.parts], m.ranges * m.parts, by[big], h[big], ["n"])
        return n

    def score(self, t: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's count in training and log10 probability after the word before it."""
        m = self.model
        u, at = np.unique(np.r_[t, START], return_inverse=True)
        n, before, one, two, more = self.word(u)
        d1, d2, d3 = m.word_discounts
        base = 1.0 / (m.words + 1)
        if m.pairs:
            k1, k2, k3 = m.word_kinds
            cut = np.select([before == 0, before == 1, before == 2], [0.0, d1, d2], d3)
            word_p = (before - cut) / m.pairs + (d1 * k1 + d2 * k2 + d3 * k3) / m.pairs * base
        else:
            word_p = np.full(len(u), base)
        a, b = _pairs(t, begin), t
        key, place, back = np.unique(tx.pair(a, b), return_index=True, return_inverse=True)
        pa_, pb = a[place], b[place]
        by = np.where(np.isin(pa_, self.heavy), key, pa_)
        c = self.pair(by, key)
        i, j = np.searchsorted(u, pa_), np.searchsorted(u, pb)
        d1, d2, d3 = m.pair_discounts
        total = n[i].copy()
        total[pa_ == START] = n[np.searchsorted(u, END)] if END in u else 0  # a text begins as often as one ends
        left = d1 * one[i] + d2 * two[i] + d3 * more[i]
        cut = np.select([c == 0, c == 1, c == 2], [0.0, d1, d2], d3)
        seen = total > 0
        safe = np.where(seen, total, 1)
        p = np.where(seen, (c - cut) / safe + left / safe * word_p[j], word_p[j])
        return n[at[: len(t)]], np.log10(p)[back]


_open: dict[str, Reader] = {}


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, base_score, score of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        if model.path not in _open:
            _open.clear()
            _open[model.path] = Reader(model)
        reader = _open[model.path]
        floor = np.log10(float(model.tokens + model.words + 1))
        for batch in batches:
            for row, stop, buf, offs in tx.slices(batch.column(1)):
                t, begin = tokens(buf, offs)
                n, p = reader.score(t, begin)
                base = np.log10(n + 1.0) - floor
                sums = lambda v: np.add.reduceat(v, begin[:-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(np.diff(begin)), pa.array(sums((n > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(p))], names=[key, "n_tokens", "n_known", "base_score", "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double")


def held_out_scores(docs: DataFrame, folds: int = 7, out: int = 2, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row scored by a model of the rows whose crc32(key as text) mod folds is not ``out``."""
    fold = F.crc32(F.col(key).cast("string").cast("binary")) % folds
    held = F.coalesce(fold == out, F.lit(False))
    model = train(docs.filter(~held), text, part_bytes)
    with Scratch(docs.sparkSession) as own:
        scores = own.keep(own.settle(scored(docs.select(F.struct(F.col(key), held.alias("held_out")).alias("id"), text), model, "id", text), "scores"))
        remove(docs.sparkSession, f"file://{model.path}")  # what is mapped stays readable until the last worker lets it go
    return scores.select(f"id.{key}", "id.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
