"""Operator 10: chroma fingerprints of audio columns, and alignment of recordings.

Frames of a recording become energies of the twelve pitch classes. Sixteen filters compare
sums over rectangles of that picture (from its integral image) at every window of frames; each
gives two bits (Gray code), together a 32-bit item. Recordings with equal fingerprints are one
group from the start. A query's items, each also with any one bit turned, meet equal items of
the index; of a pair's matching items the offsets are counted, and at the most frequent offset
the bit errors over the whole overlap decide.

Defined results: a null, empty or too short recording has no items and no match; silence has
items of its own value like any sound; repeated rows match each other without error; a key that comes twice is one recording; an empty
table gives no rows; a recording of any length is one row's; extra columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._run import Scratch

FRAME, HOP, WINDOW = 512, 128, 16
#: Filters (kind, first pitch class, pitch classes, frames), from a rule: kinds in turn, places spread evenly, sizes from fine to coarse.
FILTERS = [(i % 6, (5 * i) % 12, (12, 8, 6, 4, 3, 2)[i % 6], (16, 12, 8, 4)[i // 4]) for i in range(16)]
#: Outer limits of the four levels of a filter's value (log ratio).
LEVEL = 0.35


def chroma(pcm: np.ndarray, rate: int) -> np.ndarray:
    """Frames x 12 energies (sum 1 or all 0) of samples."""
    n = 1 + (len(pcm) - FRAME) // HOP
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float64), FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    out = power @ _classes(rate)
    total = out.sum(1, keepdims=True)
    return np.divide(out, total, out=np.zeros_like(out), where=total > 1e-6)


_maps: dict[int, np.ndarray] = {}


def _classes(rate: int) -> np.ndarray:
    """FFT bins x 12: the pitch class of each bin from 60 Hz on, A = 0."""
    if rate not in _maps:
        f = np.fft.rfftfreq(FRAME, 1 / rate)
        out = np.zeros((len(f), 12))
        use = np.flatnonzero(f >= 60)
        out[use, np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
        _maps[rate] = out
    return _maps[rate]


def items(picture: np.ndarray) -> np.ndarray:
    """32-bit items, one for each window of frames."""
    n = len(picture) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([picture, picture], axis=1)  # pitch classes go round
    total = np.zeros((len(wide) + 1, 25))
    total[1:, 1:] = wide.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t: int, y: int, w: int, h: int) -> np.ndarray:
        t = at + t
        return total[t + w, y + h] - total[t, y + h] - total[t + w, y] + total[t, y]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        if kind < 2:  # high against low
            a, b = area(0, y, w, h // 2), area(0, y + h // 2, w, h - h // 2)
        elif kind == 2:  # early against late
            a, b = area(0, y, w // 2, h), area(w // 2, y, w - w // 2, h)
        elif kind == 3:  # corners
            a = area(0, y, w // 2, h // 2) + area(w // 2, y + h // 2, w - w // 2, h - h // 2)
            b = area(0, y + h // 2, w // 2, h - h // 2) + area(w // 2, y, w - w // 2, h // 2)
        elif kind == 4:  # middle pitch against those around
            third = max(1, h // 3)
            a, b = area(0, y + third, w, third), area(0, y, w, third) + area(0, y + 2 * third, w, h - 2 * third)
        else:  # middle time against the time around
            third = max(1, w // 3)
            a, b = area(third, y, third, h), area(0, y, third, h) + area(2 * third, y, w - 2 * third, h)
        value = np.log((a + 0.1) / (b + 0.1))
        level = (value > -LEVEL).astype(np.uint32) + (value > 0) + (value > LEVEL)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out


def fingerprints(recordings: DataFrame, rate: int, key: str = "id", audio: str = "pcm", samples=None) -> DataFrame:
    """key, items (array<int>) of a column of little-endian 16-bit samples, or of what ``samples`` makes of a value."""
    kind = recordings.schema[key].dataType.simpleString()
    read = samples or (lambda x: np.frombuffer(x[: len(x) // 2 * 2], "<i2"))

    def run(batches):
        for batch in batches:
            found = [items(chroma(read(v), rate)) if (v := x.as_py()) is not None else np.zeros(0, np.uint32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.view(np.int32) for f in found], pa.list_(pa.int32()))], names=[key, "items"])

    return recordings.select(key, audio).mapInArrow(run, f"`{key}` {kind}, items array<int>")


def aligned(prints: DataFrame, queries: DataFrame, key: str = "id", errors: float = 0.1, overlap: float = 0.5) -> DataFrame:
    """A row for each query and each group of equal recordings that it matches: key, match (the least other key of the group), n_copies (other keys in it), offset (query frame less match frame), bit_errors, n_bits; a query without matches has one row with null and 0.

    prints, queries: key, items. A match has an error rate of at most ``errors`` over an
    overlap of at least the share ``overlap`` of the shorter fingerprint, at any offset that a
    common item (with one bit turned, or none) votes for; the offset of the least error rate, then
    most bits, then the least offset, is given.
    """
    with Scratch(prints.sparkSession) as own:
        return own.keep(_aligned(own, prints, queries, key, errors, overlap))


def _runs(column: str):
    """(at, n, item) of the runs of equal items: silence or a held tone is one run."""
    starts = f"filter(sequence(0, size({column}) - 1), i -> i = 0 OR {column}[i] <> {column}[i - 1])"
    return F.expr(f"transform({starts}, (i, k) -> named_struct('at', i, 'n', coalesce(get({starts}, k + 1), size({column})) - i, 'item', {column}[i]))")


_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _errors(x: np.ndarray, y: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bits that differ at each offset: item by item for few, by correlating each of the 32 bits' signs for many."""
    if int(length.sum()) <= 512 * (len(x) + len(y)):
        out = []
        for d, n in zip(offset.tolist(), length.tolist()):
            e = x[max(d, 0) : max(d, 0) + n] ^ y[max(-d, 0) : max(-d, 0) + n]
            out.append(int(_ONES[e & 0xFFFF].sum(dtype=np.int64) + _ONES[e >> 16].sum(dtype=np.int64)))
        return np.array(out, np.int64)
    size = 1 << (len(x) + len(y) - 1).bit_length()
    total = np.zeros(size // 2 + 1, complex)
    for b in range(32):
        u, v = (((z >> np.uint32(b)) & np.uint32(1)).astype(np.float64) * 2 - 1 for z in (x, y))
        total += np.fft.rfft(u, size) * np.conj(np.fft.rfft(v, size))
    alike = np.rint(np.fft.irfft(total, size)).astype(np.int64)
    return (32 * length - alike[offset % size]) // 2


def _best(x: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, errors: float, overlap: float) -> tuple[int, int, int] | None:
    """(offset, bit errors, bits) of the best of the intervals' offsets, if any is good enough."""
    change = np.zeros(len(x) + len(y) + 1, np.int64)  # offset d at d + len(y)
    np.add.at(change, low + len(y), 1)
    np.add.at(change, high + len(y) + 1, -1)
    offset = np.flatnonzero(np.cumsum(change[:-1]) > 0) - len(y)
    length = np.minimum(len(x) - np.maximum(offset, 0), len(y) - np.maximum(-offset, 0))
    fits = (length > 0) & (32 * length >= 32 * overlap * min(len(x), len(y)))
    offset, length = offset[fits], length[fits]
    if not len(offset):
        return None
    wrong, bits = _errors(x, y, offset, length), 32 * length
    good = wrong <= errors * bits
    if not good.any():
        return None
    order = np.lexsort((offset, -bits, wrong / bits))
    k = order[good[order]][0]
    return int(offset[k]), int(wrong[k]), int(bits[k])


def _aligned(own: Scratch, prints: DataFrame, queries: DataFrame, key: str, errors: float, overlap: float) -> DataFrame:
    named = prints.select(key, F.when(F.size("items") > 0, F.xxhash64("items")).alias("print"), "items").filter("print is not null")
    groups = own.settle(named.groupBy("print").agg(F.min(key).alias("k0"), F.max(key).alias("k1"), F.countDistinct(key).alias("n"), F.first("items").alias("items")), "groups")
    asked = own.settle(queries.select(key, F.when(F.size("items") > 0, F.xxhash64("items")).alias("print"), "items"), "queries")
    q = own.settle(asked.filter("print is not null").groupBy(F.col("print").alias("q")).agg(F.first("items").alias("qi")), "fingerprints")
    turned = F.concat(F.array(F.col("item")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.col("item").bitwiseXOR(F.call_function("shiftleft", F.lit(1), b))))
    wanted = q.select("q", F.explode(_runs("qi")).alias("r")).select("q", "r.*").select("q", "at", "n", F.explode(turned).alias("item"))
    there = groups.select("print", F.explode(_runs("items")).alias("r")).select("print", F.col("r.at").alias("place"), F.col("r.n").alias("long"), "r.item")
    # both sides grow with the tables, so they are never broadcast; an item of very many places is split at run time.
    # Two runs of one item vote for an interval of offsets
    hits = wanted.join(there.hint("merge"), "item").filter("q != print").select("q", "print", F.expr("at - place - long + 1").alias("low"), F.expr("at + n - 1 - place").alias("high"))
    tried = own.settle(hits.groupBy("q", "print").agg(F.collect_set(F.struct("low", "high")).alias("spans")), "offsets")
    pairs = tried.join(q.hint("merge"), "q").join(groups.select("print", "items").hint("merge"), "print").select("q", "print", "qi", "items", "spans")

    def judge(batches):
        for batch in batches:
            spans = batch.column(4).flatten()
            low, high = (spans.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bound = np.r_[0, np.cumsum(batch.column(4).value_lengths().to_numpy(zero_copy_only=False))]
            rows = []
            for i in range(batch.num_rows):
                x, y = (batch.column(k)[i].values.to_numpy(zero_copy_only=False).view(np.uint32) for k in (2, 3))
                rows.append(_best(x, y, low[bound[i] : bound[i + 1]], high[bound[i] : bound[i + 1]], errors, overlap) or (None, None, None))
            c = list(zip(*rows)) or [()] * 3
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(c[0], pa.int32()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64())], names=["q", "print", "offset", "bit_errors", "n_bits"])
            yield out.filter(out.column(2).is_valid())

    best = pairs.mapInArrow(judge, "q long, print long, offset int, bit_errors long, n_bits long")
    same = q.select("q", F.col("q").alias("print"), F.lit(0).alias("offset"), F.lit(0).cast("long").alias("bit_errors"), (32 * F.size("qi")).cast("long").alias("n_bits"))
    held = best.unionByName(same).join(groups.select("print", "k0", "k1", "n").hint("merge"), "print")
    rows = asked.select(key, F.col("print").alias("q")).join(held.hint("merge"), "q", "left")
    own_ = F.coalesce((F.col("q") == F.col("print")) & F.col(key).between(F.col("k0"), F.col("k1")), F.lit(False))
    # of its own group, a query's match is the least other key; without one the group is no match
    other = F.when(~own_, F.col("k0")).when(F.col("k0") != F.col(key), F.col("k0")).when(F.col("k1") != F.col(key), F.col("k1"))
    rows = rows.select(key, other.alias("match"), (F.col("n") - own_.cast("long")).alias("n_copies"), "offset", "bit_errors", "n_bits")
    found = own.settle(rows.filter("match is not null"), "matches")
    lone = asked.select(key).distinct().join(found.select(key).distinct().hint("merge"), key, "left_anti")
    none = lone.select(key, F.lit(None).cast(found.schema["match"].dataType).alias("match"), F.lit(0).cast("long").alias("n_copies"), *(F.lit(None).cast(k).alias(c) for c, k in (("offset", "int"), ("bit_errors", "long"), ("n_bits", "long"))))
    return own.settle(found.unionByName(none), "aligned")


RATE, NOTE = 2000, 128


def melody(vector) -> np.ndarray:
    """A test recording: one tone of 64 ms for each number of a vector, an octave from 220 Hz; equal numbers sound equal."""
    v = np.nan_to_num(np.asarray([0.0 if x is None else x for x in vector], np.float64))
    if not len(v):
        return np.zeros(0)
    scale = np.sqrt((v * v).mean()) or 1.0
    step = np.clip(np.floor(6 + 4 * v / scale), 0, 11)
    f = np.repeat(220 * 2.0 ** (step / 12), NOTE)
    return 8000 * np.sin(np.cumsum(2 * np.pi * f / RATE))
