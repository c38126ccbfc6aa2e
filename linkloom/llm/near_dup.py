"""Operator 8: near-duplicate documents by DartMinHash signatures and banded joining.

An element (a run of five words) of weight w owns the strip [0, w) of a plane whose other axis
is rank. Links are decided by element sets, so every element of a document is thrown with weight 1. Darts fall on every element's plane as a fixed Poisson
process, drawn cell by cell from hashes of the element and the cell. The darts of a document
are those in its strips up to a rank at which enough are expected to reach all coordinates;
each dart names a coordinate, and the dart of least rank is kept there. Two documents keep the
same dart at a coordinate with the probability of their (weighted; here: set) Jaccard similarity. A
document whose darts miss a coordinate is thrown again up to a rank twice as high.

Documents with the same elements, however often each comes, are one text class from the start. Signature bands deal the
classes into buckets; a bucket's pivot is its class that meets most others, and buckets of one
pivot are one set of candidates. The distance (of element sets) of every pair of a pivot's classes
is worked out exactly, and links are counted. Classes are the
connected components of the links, found by label spreading over tables.

Defined results: texts of one to four words have one element, the whole text; texts without
words are each a class of their own (they say nothing to compare); null text is empty; repeated
rows with one key are one document; rows without a key are left out, as nothing can name them; an empty
table gives no rows; extra columns are not read or, in ``kept_rows``, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import _text as tx
from linkloom.llm._run import Scratch

U64 = np.uint64
WORDS = 5
SIMILAR = 0.8
COORDINATES = 120
BAND = 5  # coordinates in a band
PART, PART_BYTES = 512, 1 << 23  # classes of a pivot, and bytes of their elements, that are compared at once
COLUMNS = 4096


def elements(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the different runs of words of every row, sorted by row and hash.

    Words are compared in lower case (A-Z).
    """
    start, end, doc = tx.words(buf, offs)
    n = len(offs) - 1
    hashes = tx.byte_prefix(tx.lower(buf)).spans(start, end)
    size = np.bincount(doc, minlength=n)
    first = np.r_[0, np.cumsum(size)]
    prefix = tx.Prefix(hashes)
    at = np.arange(max(0, len(start) - words + 1))
    at = at[doc[at] == doc[at + words - 1]] if len(at) else at
    short = np.flatnonzero((size > 0) & (size < words))
    rows = np.concatenate([doc[at], short])
    runs = np.concatenate([prefix.spans(at, at + words), prefix.spans(first[short], first[short] + size[short])])
    # one sort of (row, upper 50 bits of the hash); slices have under 2**14 rows
    both = np.sort(rows.astype(U64) << U64(50) | runs >> U64(14))
    new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
    return (both[new] >> U64(50)).astype(np.int64), both[new] << U64(14), np.diff(np.r_[new, len(both)])


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> U64(11)).astype(np.float64) * 2.0**-53


def _throw(row: np.ndarray, element: np.ndarray, weight: np.ndarray, rank: np.ndarray, k: int):
    """(row, coordinate, rank, dart) of all darts of the elements below each one's rank limit.

    Cells: strips of weight [0, 1), [1, 2), [2, 4), [4, 8) ... by bands of rank
    [2**b, 2**(b + 1)); below the least band one band from 0. A cell of area over 1 is cut
    along the rank into parts of area 1 at most.
    """
    out = []
    top_strip = int(np.ceil(np.log2(max(1.0, weight.max(initial=1.0)))))
    low, high = -3, int(np.ceil(np.log2(max(rank.max(initial=0.25), 0.25))))
    for strip in range(top_strip + 1):
        left, width = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1), 2.0 ** (strip - 1))
        own = np.flatnonzero(weight > left)
        if not len(own):
            continue
        for band in range(low, high):
            base = 0.0 if band == low else 2.0**band
            tall = 2.0 ** (band + 1) - base
            use = own[rank[own] > base]
            if not len(use):
                break
            parts = max(1, int(np.ceil(width * tall)))
            area = width * tall / parts
            for part in range(parts):
                floor = base + tall * part / parts
                mine = use[rank[use] > floor] if part else use
                if not len(mine):
                    break
                seed = tx.mix(element[mine] + U64((strip + 1) * 0x9E3779B97F4A7C15 + (band + 64) * 0xC2B2AE3D27D4EB4F + part * 0x165667B19E3779F9 & (1 << 64) - 1))
                u = _unit(seed)
                chance = total = np.exp(-area)
                number = 0
                alive = np.flatnonzero(u >= total)
                while len(alive):  # dart number 1, 2 ... of the cell
                    number += 1
                    i, h = mine[alive], tx.mix(seed[alive] ^ U64(number * 0xA0761D6478BD642F & (1 << 64) - 1))
                    x = left + width * _unit(h)
                    h2 = tx.mix(h + U64(0xE7037ED1A0B428DB))
                    y = floor + tall / parts * _unit(h2)
                    hit = (x < weight[i]) & (y < rank[i])
                    if hit.any():
                        h3 = tx.mix(h2 + U64(0x8EBC6AF09C88C6E3))[hit]
                        out.append((row[i[hit]], (h3 % U64(k)).astype(np.int64), y[hit], h[hit]))
                    chance = chance * area / number
                    total = total + chance
                    alive = alive[u[alive] >= total] if number < 40 else alive[:0]
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0), np.zeros(0, U64))
    return tuple(np.concatenate(c) for c in zip(*out))


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """n x k dart identities; rows without elements are all 0."""
    out = np.zeros((n, k), U64)
    mass = np.bincount(row, weight, minlength=n)
    # a coordinate is missed with probability exp(-expected / k)
    limit = np.where(mass > 0, k * (np.log(k) + 2.0) / np.maximum(mass, 1e-9), 0.0)
    todo = mass > 0
    while todo.any():
        use = todo[row]
        r, j, y, dart = _throw(row[use], element[use], weight[use].astype(float), limit[row[use]], k)
        # by slot, then rank: the bits of positive floats order like their values
        order = np.argsort((r * k + j).astype(U64) << U64(40) | y.view(U64) >> U64(23) & U64((1 << 40) - 1))
        slot, dart = (r * k + j)[order], dart[order]
        first = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, np.int64)
        full = np.bincount(slot[first] // k, minlength=n) == k
        done = todo & full
        own = first[done[slot[first] // k]]
        out.reshape(-1)[slot[own]] = np.maximum(dart[own], U64(1))
        todo &= ~full
        limit = np.where(todo, limit * 2, limit)
    return out


def _signed(docs: DataFrame, key: str, text: str, k: int, band: int) -> DataFrame:
    """key, content (hash of the elements; null without), bands, runs (32-bit hashes of the elements, sorted)."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at, stop, buf, offs in tx.slices(batch.column(1), 1 << 20):
                n = stop - at
                row, element, _ = elements(buf, offs)
                sign = signatures(row, element, np.ones(len(row)), n, k)
                parts = sign.reshape(n, k // band, band)
                bands = np.full((n, k // band), 0, U64)
                for i in range(band):
                    bands = tx.pair(bands + U64(i), parts[:, :, i])
                bands = tx.pair(bands, np.arange(k // band, dtype=U64)[None, :].repeat(n, 0))
                first = np.searchsorted(row, np.arange(n + 1))
                both = tx.Prefix(tx.mix(element)).spans(first[:-1], first[1:])
                has = first[1:] > first[:-1]
                small = (element >> U64(32)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(both.view(np.int64), mask=~has), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([small[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                    names=[key, "content", "bands", "runs"],
                )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, content long, bands array<long>, runs binary")


def _common(sets: list[np.ndarray], k: int) -> np.ndarray:
    """How many values each of the first k sets has in common with each of the others (k = 0: all with all)."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = often[at] > 1
    row, at = row[use], (np.cumsum(often > 1) - 1)[at[use]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    out = np.zeros((k or len(sets), len(sets) - k), np.float32)
    edges = np.arange(0, at[-1] + 1 + COLUMNS, COLUMNS) if len(at) else np.zeros(0, np.int64)
    cuts = np.searchsorted(at, edges)
    for low, begin, end in zip(edges[:-1], cuts[:-1], cuts[1:]):
        have = np.zeros((len(sets), min(COLUMNS, at[end - 1] + 1 - low)), np.float32)
        have[row[begin:end], at[begin:end] - low] = 1
        out += have[: k or len(sets)] @ have[k:].T
    return out


def _roots(near: np.ndarray) -> np.ndarray:
    """A member of each member's component in a symmetric matrix of links, the same for all of a component."""
    root = np.full(len(near), -1)
    for first in range(len(near)):
        front = np.array([first]) if root[first] < 0 else np.zeros(0, np.int64)
        while len(front):
            root[front] = first
            front = np.flatnonzero(near[front].any(0) & (root < 0))
    return root


def _held(m: int, cross: bool, part: np.ndarray, runs: list[np.ndarray], ms: list[np.ndarray], similar: float) -> np.ndarray:
    """The links, as a symmetric matrix, among classes of pivot m (cross: only between its two parts) that have no lesser pivot in common."""
    n, k = len(runs), int((part == part.min()).sum()) if cross else 0
    size = np.array([len(x) for x in runs], float)
    both = _common(runs, k)
    near = 1.0 - both / (size[: k or n, None] + size[None, k:] - both) <= 1.0 - similar + 1e-9
    if near.any():
        near &= _common([x[x < m] for x in ms], k) == 0
    out = np.zeros((n, n), bool)
    out[: k or n, k:] = near
    out |= out.T
    np.fill_diagonal(out, False)
    return out


def _linked(own: Scratch, stars: DataFrame, runs: DataFrame, similar: float) -> DataFrame:
    """(a, b, n): class a has n links that this row stands for, and a chain of links to class b; a table of the shared folder.

    All pairs of classes of a pivot are compared. A pivot's classes are dealt into parts of a bounded
    size, and each two parts are a task's work, so that no task grows with a pivot. A pair that several
    pivots hold is counted at the least of them.
    """
    sized = stars.groupBy("m").agg(F.greatest(F.ceil(F.count("*") / F.lit(PART)), F.ceil(F.sum("size") / F.lit(PART_BYTES))).cast("int").alias("parts"))
    pivots = stars.groupBy("c").agg(F.collect_set("m").alias("ms"))
    each = stars.select("m", "c").join(sized, "m").join(pivots, "c").withColumn("part", F.pmod(F.xxhash64("c"), "parts").cast("int"))
    each = each.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("m", F.least("part", "to").alias("i"), F.greatest("part", "to").alias("j"), "part", "c", "ms")
    each = each.join(runs, "c").select("m", "i", "j", "part", "c", "ms", "runs").repartition("m", "i", "j").sortWithinPartitions("m", "i", "j", "part")

    def finish(key, rows):
        part, c, ms, runs = zip(*rows)
        near = _held(key[0], key[1] != key[2], np.array(part), list(runs), list(ms), similar) if len(set(part)) == 1 + (key[1] != key[2]) and len(c) > 1 else np.zeros((len(c), len(c)), bool)
        degree = near.sum(1)
        has = np.flatnonzero(degree)
        c = np.array(c)
        return c[has], c[_roots(near)[has]] if len(has) else c[has], degree[has]

    def run(batches):
        key, rows, out = None, [], []
        for batch in batches:
            numbers = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("m", "i", "j", "part", "c")]
            buf, offs = tx.raw(batch.column("runs"))
            values, lists = buf.view("<u4"), offs // 4
            pivot, where = batch.column("ms").flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(batch.column("ms").value_lengths().to_numpy(zero_copy_only=False))]
            for k in range(batch.num_rows):
                m, i, j, part, c = (int(x[k]) for x in numbers)
                if key != (m, i, j):
                    if rows:
                        out.append(finish(key, rows))
                    key, rows = (m, i, j), []
                rows.append((part, c, pivot[where[k] : where[k + 1]], values[lists[k] : lists[k + 1]]))
            rows = [(*x[:2], x[2].copy(), x[3].copy()) for x in rows]  # the batch is let go
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["a", "b", "n"])
                out = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in finish(key, rows)], names=["a", "b", "n"])

    return own.settle(each.mapInArrow(run, "a long, b long, n long"), "linked")


def components(edges: DataFrame, own: Scratch | None = None) -> DataFrame:
    """(node, label): the least node of each connected component of edges (a, b); a table of the shared folder.

    Every round links each node's larger neighbours, then its smaller ones, to its least
    neighbour, until nothing changes; long chains shrink by a constant factor a round.
    """
    own = own or Scratch(edges.sparkSession)
    edges = own.settle(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = own.settle(large, "links")
        own.drop(edges)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a != b").distinct()
        edges = own.settle(small, "links")
        own.drop(large)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before = state


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, k: int = COORDINATES, band: int = BAND) -> DataFrame:
    """key, class_id (the least key of the class), n_links (the different texts, by their elements, that are similar to the row's)."""
    with Scratch(docs.sparkSession) as own:
        return own.keep(_classes(own, docs, key, text, similar, k, band))


def _classes(own: Scratch, docs: DataFrame, key: str, text: str, similar: float, k: int, band: int) -> DataFrame:
    signed = own.settle(_signed(docs.select(key, text).filter(F.col(key).isNotNull()), key, text, k, band), "signatures")
    # texts with the same elements are one class c; its least key is k0
    rows = signed.filter("content is not null").groupBy(F.col("content").alias("c")).agg(F.min(F.struct(F.col(key).alias("k0"), "bands", "runs")).alias("r"))
    unique = own.bucketed(rows.select("c", "r.*", F.length("r.runs").alias("size")), "c", "texts")
    least = unique.select(F.col("c").alias("content"), "k0")
    runs = unique.select("c", "runs")
    buckets = unique.select("c", F.posexplode("bands").alias("i", "band")).select("c", "band")
    shared = own.settle(buckets.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    # a bucket's pivot: the class that meets most others in all its buckets
    weight = buckets.join(shared, "band").groupBy("c").agg(F.sum("n").alias("w"))
    members = own.settle(buckets.join(shared.select("band"), "band", "left_semi").join(weight, "c"), "buckets")
    pivots = members.groupBy("band").agg(F.max(F.struct("w", "c"))["c"].alias("m"))
    stars = members.join(pivots, "band").select("m", "c").distinct()
    stars = own.settle(stars.join(unique.select("c", "size"), "c"), "stars")
    own.drop(members, shared)
    links = _linked(own, stars, runs, similar)
    own.drop(stars)
    label = components(links, own)
    groups = least.select(F.col("content").alias("node"), "k0").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = groups.groupBy("label").agg(F.min("k0").alias("class_id"))
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    named = groups.join(heads, "label").join(degree, "node", "left").select(F.col("node").alias("content"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = signed.select(key, "content").join(named, "content", "left")
    out = out.select(key, F.coalesce("class_id", key).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return own.settle(out.groupBy(key).agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links")), "classes")


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs whose key is its class's least, and rows without a key; all columns unchanged."""
    kept = classes(docs, key, text, **options).filter(F.col(key) == F.col("class_id")).select(key)
    # both sides grow with the documents: neither is ever broadcast, at any size
    return docs.join(kept.hint("merge"), key, "left_semi").select(docs.columns).unionByName(docs.filter(F.col(key).isNull()))
