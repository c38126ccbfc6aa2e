"""Operator 7: removal of byte strings that repeat anywhere, by a distributed merge sort of suffixes.

Every string of ``LENGTH`` bytes holds the least-hashed short gram of its window, its anchor,
at the same place in each copy; so only suffixes at anchors are sorted. An anchor's context is
all the bytes that any such string through it can reach. Contexts that occur twice are repeats
as a whole. For anchors whose gram also occurs in other contexts, one suffix for each context
is sorted: every task sorts its own into a front-coded run, runs are exchanged by key range,
and a loser tree combines a range's runs, comparing only behind prefixes known to be common.
The common prefixes that the merge puts out, and those of the reversed bytes before the anchors,
tell which suffixes agree over any window that holds the gram, and so the repeated lengths.

With ``words``, runs of so many words, of any number of bytes, that start twice or more are
passages, which go too, with any white space between the words. They have anchors in the same
way, in words; where an anchor's gram has different contexts, the hashes (128 bits) of the runs
that it anchors are counted.

Defined results: null and empty texts, and those under ``LENGTH`` bytes, keep all; a repeated
row repeats as a whole; an empty table gives no rows; extra columns are not read or, in
``kept_rows``, returned unchanged. Positions are bytes of UTF-8; texts keep the bytes of a
character that is not cut whole, so that they stay valid.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import _text as tx
from linkloom.llm._run import Scratch

U64 = np.uint64
LENGTH = 400
GRAM = 32
#: Words of a gram that anchors runs of words.
WORD_GRAM = 8
#: Contexts of a range, of about 0.9 KB each.
RANGE = 1 << 16


def _window_min(keys: np.ndarray, w: int) -> np.ndarray:
    """The least key of every window of w keys."""
    n = len(keys)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, U64)
    padded[:n] = keys
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _windows(prefix: tx.Prefix, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and anchor of every window that stays in its row, and the hashes of all grams."""
    n = int(offs[-1])
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.arange(n - gram + 1)
    h = prefix.spans(at, at + gram)
    least = _window_min((h & U64(0xFFFFFFFF00000000)) | at.astype(U64), length - gram + 1)
    size = np.diff(offs)
    valid = np.zeros(n + 1, np.int32)  # window starts that stay in their row
    long = size >= length
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid)[: len(least)] > 0)
    return start, (least[start] & U64(0xFFFFFFFF)).astype(np.int64), h


def _anchors(prefix: tx.Prefix, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    _, found, h = _windows(prefix, offs, length, gram)
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    a = found[np.r_[True, found[1:] != found[:-1]]]
    row = np.searchsorted(offs, a, "right") - 1
    left = np.maximum(a - (length - gram), offs[row])
    right = np.minimum(a + length, offs[row + 1])
    return row, a - offs[row], h[a], tx.pair(prefix.spans(left, a), prefix.spans(a, right))


def anchors(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, place, gram hash, context hash) of every anchor."""
    return _anchors(tx.byte_prefix(buf), offs, length, gram)


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, and the offsets of the rows into them."""
    start, end, row = tx.words(buf, offs)
    return tx.byte_prefix(buf).spans(start, end), np.searchsorted(row, np.arange(len(offs)))


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes at least."""
    n = min(len(a), len(b))
    step = 16
    while known < n:
        if a[known : known + step] == b[known : known + step]:
            known = min(n, known + step)
            step *= 2
        elif step == 1:
            return known
        else:
            step = max(1, step // 4)
    return n


class Run:
    """A front-coded sorted run: each string as its common prefix with the one before, and the rest."""

    def __init__(self, keys: list[bytes], lefts: list[bytes], ids: np.ndarray):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        lcp, rest, before = [], [], b""
        for i in order:
            k = _common(before, keys[i], 0)
            lcp.append(k)
            rest.append(keys[i][k:])
            before = keys[i]
        self.lcp, self.rest, self.left, self.ids = lcp, rest, [lefts[i] for i in order], ids[order]

    def pack(self) -> bytes:
        import zstandard

        head = np.array([[a, len(r), len(x)] for a, r, x in zip(self.lcp, self.rest, self.left)], "<u4")
        body = b"".join([len(self.ids).to_bytes(8, "little"), head.tobytes(), self.ids.astype("<u8").tobytes(), *self.rest, *self.left])
        return zstandard.ZstdCompressor(level=1).compress(body)

    @staticmethod
    def unpack(data: bytes) -> "Run":
        import zstandard

        body = zstandard.ZstdDecompressor().decompress(data)
        n = int.from_bytes(body[:8], "little")
        run = Run([], [], np.zeros(0, U64))
        head = np.frombuffer(body, "<u4", 3 * n, 8).reshape(n, 3)
        run.ids = np.frombuffer(body, "<u8", n, 8 + 12 * n)
        at = 8 + 20 * n
        run.lcp = head[:, 0].tolist()
        for name, sizes in (("rest", head[:, 1].tolist()), ("left", head[:, 2].tolist())):
            out = []
            for size in sizes:
                out.append(body[at : at + size])
                at += size
            setattr(run, name, out)
        return run


def merge(runs: list[Run]) -> Iterator[tuple[int, bytes, bytes, int]]:
    """(common prefix with the one before, string, bytes before it, id) of all runs in order.

    A loser tree. Every head knows how many bytes it shares with the last string put out; of
    two heads, the one that shares more is the smaller, and only if both share the same are
    bytes compared, from there on. The loser then knows what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place, text, shared = [0] * k, [None] * k, [0] * k  # None: at its end, larger than all

    def advance(r: int) -> None:
        run, p = runs[r], place[r]
        if p == len(run.rest):
            text[r] = None
            return
        text[r] = run.rest[p] if p == 0 else text[r][: run.lcp[p]] + run.rest[p]
        shared[r] = run.lcp[p] if p else 0
        place[r] = p + 1

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        n = _common(x, y, shared[a])
        if x[n:] < y[n:] or (x == y and a < b):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    for r in range(len(runs)):
        advance(r)
    losers = [0] * k
    level = list(range(k))
    base = k
    while len(level) > 1:  # losers of a round stand before those of the round above it
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            w, x = play(level[i], level[i + 1])
            losers[base + i // 2] = x
            up.append(w)
        level = up
    top = level[0] if level else 0
    while runs and text[top] is not None:
        run, p = runs[top], place[top] - 1
        yield shared[top], text[top], run.left[p], int(run.ids[p])
        advance(top)
        node = (top + k) // 2
        while node >= 1:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(shared: list[int], lefts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For sorted suffixes, given by what each shares with the one before it, and the bytes before them: least and greatest number of bytes before the anchor at which a window starts that another one shares; (1, 0) if none.

    The common prefixes of the sorted order say which suffixes agree over any number of bytes
    from the anchor on; those of the reversed bytes before it, which agree over any number up to
    it. A window repeats if two suffixes agree in both parts of it.
    """
    m = len(lefts)
    low, high = np.full(m, length, np.int64), np.full(m, -1, np.int64)
    ahead = np.array([0, *shared[1:]])
    after = np.r_[ahead[1:], 0]
    back = [x[::-1] for x in lefts]
    order = sorted(range(m), key=back.__getitem__)
    behind = np.array([0, *(_common(back[a], back[b], 0) for a, b in zip(order, order[1:]))])
    rank = np.empty(m, np.int64)
    rank[order] = np.arange(m)
    for j in range(length - gram + 1):  # window: j bytes before the anchor, length - j from it on
        need = length - j
        ok = np.flatnonzero((ahead >= need) | (after >= need))
        if not len(ok):
            continue
        both = np.cumsum(ahead < need)[ok] * (m + 1) + np.cumsum(behind < j)[rank[ok]]
        place = np.argsort(both, kind="stable")
        same = both[place][1:] == both[place][:-1]
        hit = ok[np.union1d(place[1:][same], place[:-1][same])]
        low[hit] = np.minimum(low[hit], j)
        high[hit] = j
    return np.where(high >= 0, low, 1), np.where(high >= 0, high, 0)


def _found(docs: DataFrame, key: str, text: str, length: int, gram: int, how=None) -> DataFrame:
    """(key, _h, cuts): the byte intervals to remove of every row that has any; _h is a hash of its text."""
    with Scratch(docs.sparkSession) as own:
        return own.keep((how or _cuts)(own, docs, key, text, length, gram))


def _contexts(own: Scratch, docs: DataFrame, key: str, text: str, anchored) -> tuple[DataFrame, ...]:
    """Anchors, their contexts and how often each occurs, one place of every context whose gram has others, and the texts of those places.

    ``anchored`` gives the anchors of bytes and offsets.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_h"), F.col(text))

    def find(batches):
        for batch in batches:
            for at, stop, buf, offs in tx.slices(batch.column(2), 1 << 20):
                row, place, g, c = anchored(buf, offs)
                row = pa.array(row + at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(place), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], names=[key, "_h", "place", "g", "c"])

    marks = own.settle(rows.mapInArrow(find, f"`{key}` {kind}, _h long, place long, g long, c long"), "anchors")
    # any place of a context will do; the three are of one row, and numbers need no sort, as a struct's least value would
    kinds = own.settle(marks.groupBy("g", "c").agg(F.count("*").alias("n"), *(F.first(x).alias(x) for x in ("_h", "place", key))), "contexts")
    # settled, so that the join below reads plain rows by gram and a gram of very many contexts is split at run time
    mixed = own.settle(kinds.groupBy("g").agg(F.count("*").alias("k")).filter("k > 1").select("g"), "grams")
    ones = own.settle(kinds.join(mixed, "g", "left_semi").select("_h", "place", key, "c"), "suffixes")
    wanted = ones.groupBy(key, "_h").agg(F.collect_list(F.struct("place", "c")).alias("at"))
    # here and in _joined both sides grow with the documents: neither is ever broadcast, at any size
    fetched = rows.join(wanted.hint("merge"), F.expr("true") & rows[key].eqNullSafe(wanted[key]) & (rows["_h"] == wanted["_h"])).select(text, "at")
    own.drop(mixed)
    return marks, kinds, ones, fetched


def _spread(own: Scratch, marks: DataFrame, kinds: DataFrame, parts: DataFrame, key: str, length: int, gram: int, *used: DataFrame) -> DataFrame:
    """(key, _h, cuts): the repeats found at contexts, at all places of these contexts; ``used`` are tables that ``parts`` reads."""
    whole = kinds.filter("n > 1").select("c", F.lit(length - gram).cast("long").alias("back"), F.lit(length).cast("long").alias("ahead"))
    cuts = own.settle(whole.unionByName(parts).groupBy("c").agg(F.max("back").alias("back"), F.max("ahead").alias("ahead")), "repeats")
    own.drop(kinds, *used)
    spans = marks.join(cuts, "c").select(key, "_h", F.struct((F.col("place") - F.col("back")).alias("start"), (F.col("place") + F.col("ahead")).alias("end")).alias("cut"))
    return own.settle(spans.groupBy(key, "_h").agg(F.collect_set("cut").alias("cuts")), "cuts")


def _cuts(own: Scratch, docs: DataFrame, key: str, text: str, length: int, gram: int) -> DataFrame:
    spark = own.spark
    marks, kinds, ones, fetched = _contexts(own, docs, key, text, lambda buf, offs: anchors(buf, offs, length, gram))

    def cut(batch, i: int):
        body = (batch.column(0)[i].as_py() or "").encode()
        for x in batch.column(1)[i].as_py():
            a = x["place"]
            yield body[a : a + length], body[max(0, a - length + gram) : a], x["c"]

    # a range has about RANGE contexts, so that a task's memory does not grow with the data; a gram is never split
    total = ones.count()
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    # the ranges' splits are grams of a bounded sample of contexts, told by their hashes: about 32 a range
    share = min(1.0, 32.0 * ranges / max(total, 1))

    def sample(batches):
        for batch in batches:
            some = [k[:gram] for i in range(batch.num_rows) for k, _, c in cut(batch, i) if (c & 0xFFFFFF) < share * 0x1000000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], names=["first"])

    texts = own.settle(fetched, "fetched")
    own.drop(ones)
    seen = sorted(bytes(r.first) for r in texts.mapInArrow(sample, "first binary").collect())
    splits = sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)}) if seen else []

    def sort(batches):
        held: list[tuple[bytes, bytes, int]] = []

        def runs():
            by: dict[int, list] = {}
            for x in held:
                by.setdefault(bisect_right(splits, x[0][:gram]), []).append(x)
            out = [(r, Run([x[0] for x in v], [x[1] for x in v], np.array([x[2] for x in v], np.int64).view(U64)).pack()) for r, v in by.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["range", "run"])

        for batch in batches:
            for i in range(batch.num_rows):
                held.extend(cut(batch, i))
                if len(held) >= 100_000:
                    yield runs()
        if held:
            yield runs()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [Run.unpack(x.as_py()) for b in batches for x in b.column("run")]
        common, lefts, ids = [], [], []

        def flush() -> pa.RecordBatch:
            low, high = repeated(common, lefts, length, gram)
            hit = high >= low
            out = pa.RecordBatch.from_arrays([pa.array(np.array(ids, U64)[hit].view(np.int64)), pa.array(high[hit]), pa.array(length - low[hit])], names=["c", "back", "ahead"])
            for x in (common, lefts, ids):
                x.clear()
            return out

        for shared, _, left, i in merge(runs):
            if shared < gram and len(ids) >= 4_000:  # a new gram
                yield flush()
            common.append(shared)
            lefts.append(left)
            ids.append(i)
        if ids:
            yield flush()

    parts = texts.mapInArrow(sort, "range int, run binary").groupBy("range").applyInArrow(combine, "c long, back long, ahead long")
    return _spread(own, marks, kinds, parts, key, length, gram, texts)


def _runs(own: Scratch, docs: DataFrame, key: str, text: str, words: int, gram: int) -> DataFrame:
    """Like ``_cuts``, of runs of words; intervals count words."""

    def anchored(buf, offs):
        h, rows = _word_hashes(buf, offs)
        return _anchors(tx.Prefix(h), rows, words, gram)

    marks, kinds, ones, fetched = _contexts(own, docs, key, text, anchored)

    def hashes(batches):
        for batch in batches:
            at = batch.column(1)
            for first, stop, buf, offs in tx.slices(batch.column(0), 1 << 20):
                h, rows = _word_hashes(buf, offs)
                prefix = tx.Prefix(h)
                start, anchor, _ = _windows(prefix, rows, words, gram)
                some = at.slice(first, stop - first)
                flat = some.flatten()
                row = np.repeat(np.arange(stop - first), some.value_lengths().to_numpy())
                place = rows[row] + flat.field("place").to_numpy()
                order = np.argsort(place, kind="stable")
                i = np.searchsorted(place[order], anchor)
                i[i == len(order)] = 0
                hit = place[order][i] == anchor
                start, anchor, c = start[hit], anchor[hit], flat.field("c").to_numpy()[order][i[hit]]
                both = (prefix.spans(start, start + words), tx.Prefix(tx.mix(~h)).spans(start, start + words))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in both), pa.array(c), pa.array(anchor - start)], names=["a", "b", "c", "back"])

    held = own.settle(fetched.mapInArrow(hashes, "a long, b long, c long, back long"), "runs")
    own.drop(ones)
    twice = own.settle(held.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b"), "twice")
    parts = held.join(twice.hint("merge"), ["a", "b"], "left_semi").select("c", "back", (words - F.col("back")).alias("ahead"))
    return _spread(own, marks, kinds, parts, key, words, gram, held, twice)


def _joined(docs: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce(text, F.lit(""))))
    return rows.join(found.withColumnsRenamed({key: "_k", "_h": "_g"}).hint("merge"), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_h") == F.col("_g")), "left").drop("_k", "_g", "_h")


def _both(docs: DataFrame, key: str, text: str, length: int, gram: int, words: int | None) -> DataFrame:
    """(key, _h, cuts, runs): byte intervals and, with ``words``, intervals of words to remove of every row that has any."""
    found = _found(docs, key, text, length, gram).withColumn("runs", F.lit(False))
    if words is not None:
        found = found.unionByName(_found(docs, key, text, words, WORD_GRAM, _runs).withColumn("runs", F.lit(True)))
    cuts_of = lambda kind: F.flatten(F.collect_list(F.when(F.col("runs") == kind, F.col("cuts"))))
    return found.groupBy(key, "_h").agg(cuts_of(False).alias("cuts"), cuts_of(True).alias("runs"))


def _flat(cuts: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row, start and end of all intervals."""
    flat = cuts.flatten()
    row = np.repeat(np.arange(len(cuts)), cuts.value_lengths().fill_null(0).to_numpy())
    return row, flat.field("start").to_numpy(), flat.field("end").to_numpy()


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, start and end of sorted disjoint intervals within [0, size) of each row."""
    base = np.cumsum(size + 1) - (size + 1)  # rows lie one after the other, with a gap
    a, b = base[row] + np.maximum(start, 0), base[row] + np.minimum(end, size[row])
    order = np.argsort(a, kind="stable")
    a, row, reach = a[order], row[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.r_[True, a[1:] > reach[:-1]][: len(a)])
    row = row[new]
    return row, a[new] - base[row], reach[np.r_[new[1:], len(a)][: len(new)] - 1] - base[row]


def _of_words(buf: np.ndarray, offs: np.ndarray, runs: pa.ListArray) -> tuple[np.ndarray, ...]:
    """Row, first byte and end of the runs of words that the merged intervals of words are."""
    row, first, last = _flat(runs)
    if not len(row):
        return row, first, last
    start, end, of = tx.words(buf, offs)
    at = np.searchsorted(of, np.arange(len(offs)))
    row, first, last = _merged(row, first, last, np.diff(at))
    return row, start[at[row] + first] - offs[row], end[at[row] + last - 1] - offs[row]


def _by_row(intervals: tuple[np.ndarray, ...], n: int) -> Iterator[list[tuple[int, int]]]:
    row, start, end = intervals
    both, at = list(zip(start.tolist(), end.tolist())), np.searchsorted(row, np.arange(n + 1)).tolist()
    return (both[a:b] for a, b in zip(at, at[1:]))


def _bodies(texts: pa.Array) -> Iterator[tuple[str | None, bytes]]:
    for t in texts:
        t = t.as_py()
        yield t, (t or "").encode()


def _left(body: bytes, spans: list[tuple[int, int]]) -> str:
    """What is left without sorted disjoint intervals; bytes of a character that is not cut whole stay."""
    keep, at = [], 0
    for a, b in spans:
        while a < b and body[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
            b -= 1
        keep.append(body[at:a])
        at = b
    return b"".join([*keep, body[at:]]).decode()


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    With ``words``, which changes none of these, also n_passages and n_passage_bytes (maximal
    runs of repeated passages), and the text that ``kept_rows`` leaves: without both kinds.
    """
    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    more = {} if words is None else {"n_passages": pa.int64(), "n_passage_bytes": pa.int64(), text: pa.string()}
    types = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()} | more

    def run(batches):
        for batch in batches:
            for first, stop, buf, offs in tx.slices(batch.column(1), 1 << 22):
                part, out = batch.slice(first, stop - first), []
                cuts = _merged(*_flat(part.column(2)), np.diff(offs))
                passages = _of_words(buf, offs, part.column(3)) if more else None
                both = _merged(*(np.concatenate(x) for x in zip(cuts, passages)), np.diff(offs)) if more else None
                for (t, body), own, *other in zip(_bodies(part.column(1)), _by_row(cuts, len(part)), *(_by_row(x, len(part)) for x in (passages, both) if more)):
                    sha, at = hashlib.sha256(), 0
                    for a, b in own:
                        sha.update(body[at:a])
                        at = b
                    sha.update(body[at:])
                    row = [len(body), sum(b - a for a, b in own), len(own), sha.hexdigest()]
                    if more:
                        row += [len(other[0]), sum(b - a for a, b in other[0]), _left(body, other[1]) if other[1] else t]
                    out.append(row)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*out), types.values()))], names=[key, *types])

    found = _found(docs, key, text, length, gram) if words is None else _both(docs, key, text, length, gram, words)
    says = ", ".join(f"`{name}` {'string' if x == pa.string() else 'long'}" for name, x in types.items())
    return _joined(docs, found, key, text).mapInArrow(run, f"`{key}` {kind}, {says}")


def kept_rows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text", words: int | None = None) -> DataFrame:
    """docs with the repeats cut out of the text; bytes of a character that is not cut whole stay.

    With ``words``, runs of that many words that start twice or more go too, from the first
    byte of the first word to the last of the last; both kinds are judged on the input.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = f"c{names.index(key)}", f"c{names.index(text)}"
    both = _joined(plain, _both(plain, k, t, length, gram, words), k, t)

    @F.arrow_udf("string")
    def cut(texts: pa.Array, cuts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for first, stop, buf, offs in tx.slices(texts, 1 << 22):
            part = slice(first, stop)
            found = _flat(cuts[part]), _of_words(buf, offs, runs[part])
            both = _merged(*(np.concatenate(x) for x in zip(*found)), np.diff(offs))
            out += [_left(body, own) if own else t for (t, body), own in zip(_bodies(texts[part]), _by_row(both, stop - first))]
        return pa.array(out, pa.string())

    return both.withColumn(t, cut(F.col(t), F.col("cuts"), F.col("runs"))).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
