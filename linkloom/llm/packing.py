"""Operator 6: packing tokenised documents into sequences by swap-based local search.

Every document becomes its ids and a closing id. Documents over the sequence length are cut
into full pieces, which fill a sequence each, and one shorter first piece. First pieces and
short documents are dealt at random (by a hash) into groups of bounded size, and each group is
packed alone: bins as documents arrive, then, while there are more bins than the total length
needs, the emptiest bins are taken apart by moving a document out, by exchanging one document
for a shorter one, two for one, or one for two. Every exchange fills the fuller bin further, so
the sum of squared fills rises and the search ends. What a group wastes does not depend on how
many groups there are.

Defined results: a null or empty text is the closing id alone; the strings of special tokens have
their own ids; repeated rows are packed like any other; of equal choices the least bin and item number wins; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from functools import cached_property
from math import ceil
from typing import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm._run import settle

PIECE = "piece int, start long, length long, ids_crc32 long"


#: Fixed value: how the byte-level vocabulary splits text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of the pattern's white space that are encoded by themselves; only texts of more characters are looked through.
LEAST = 100_000
LONG = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{LEAST},}}")


def _letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Ids:
    """Token ids of texts, each encoded whole.

    A token's id is its merge rank, so that ranks encode the texts, which is several times as
    fast as the JSON form's library. Special tokens of the vocabulary (its JSON form) that stand
    in a text are cut out first and have their own ids. The encoder keeps a place for every
    character of a run of white space, so that long runs are cut out too: but for its last
    character, which may begin the next token, such a run is one piece of the pattern.
    """

    def __init__(self, vocabulary: bytes):
        import json

        import tiktoken

        said = json.loads(vocabulary)
        spelt = {c: bytes([b]) for b, c in _letters().items()}
        own = {x["content"]: x for x in said["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in own.values()):
            raise ValueError("only special tokens that match as they stand are supported")
        self.table = {b"".join(spelt[c] for c in t): i for t, i in said["model"]["vocab"].items() if t not in own}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self.table, special_tokens={t: x["id"] for t, x in own.items()})
        self.special = {t: np.array([x["id"]], "<u4") for t, x in own.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(own, key=len, reverse=True)) + ")") if own else None

    @cached_property
    def single(self):
        """An encoder that takes its text for one piece."""
        import tiktoken

        return tiktoken.Encoding("piece", pat_str=r"(?s:.+)", mergeable_ranks=self.table, special_tokens={})

    def _plain(self, text: str) -> list[np.ndarray]:
        """Ids of a text without special tokens."""
        out, at = [], 0
        for run in LONG.finditer(text) if len(text) > LEAST else ():
            end = run.end() - (run.end() < len(text))
            out += [self._ids(self.encoding, text[at : run.start()]), self._ids(self.single, text[run.start() : end])]
            at = end
        return [*out, self._ids(self.encoding, text[at:])]

    @staticmethod
    def _ids(encoding, text: str) -> np.ndarray:
        return encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=())

    def of(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        for text in texts:
            text = text or ""
            if self.cut is None or not self.cut.search(text):
                found = self._plain(text)
            else:
                found = [x for k, part in enumerate(self.cut.split(text)) if part for x in ([self.special[part]] if k % 2 else self._plain(part))]
            yield b"".join([x.astype("<u4", copy=False).tobytes() for x in found])


_loaded: dict[int, Ids] = {}


def pieces(docs: DataFrame, vocabulary: bytes, size: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32."""
    kind = docs.schema[key].dataType.simpleString()
    crc = zlib.crc32
    close = np.array([end], "<u4").tobytes()

    def run(batches):
        own = hash(vocabulary)
        if own not in _loaded:
            _loaded.clear()
            _loaded[own] = Ids(vocabulary)
        for batch in batches:
            rows, which = [], []
            for i, ids in enumerate(_loaded[own].of(batch.column(1).to_pylist())):
                ids += close
                n = len(ids) // 4
                first = (n - 1) % size + 1
                begin = 0
                for p, stop in enumerate(range(first, n + 1, size)):
                    which.append(i)
                    rows.append((p, begin, stop - begin, crc(ids[4 * begin : 4 * stop])))
                    begin = stop
            c = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(c[0], pa.int32()), *[pa.array(x, pa.int64()) for x in c[1:]]], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {PIECE}")


def arrival(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers as they come: a bin is closed by the first item that does not fit."""
    bins: list[list[int]] = []
    gap = 0
    for i, n in enumerate(lengths):
        if n > gap:
            bins.append([])
            gap = size
        bins[-1].append(i)
        gap -= n
    return bins


class Search:
    """Swap-based local search over the bins that are not full.

    ``open`` bins are partners; the bin that is taken apart is not among them. ``by_gap`` and
    the bits of ``gaps`` find the bin that an item fits best, ``holders`` and ``most`` the
    fuller bin that an item can be exchanged with. Every change moves length into the fuller
    bin, so that the sum of squared fills rises.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], size: int):
        self.lengths, self.size, self.bins = lengths, size, bins
        self.gap = [size - sum(lengths[i] for i in b) for b in bins]
        self.by_gap: list[set[int]] = [set() for _ in range(size + 1)]
        self.gaps = 0  # bit g: an open bin with gap g
        self.holders: dict[int, dict[int, set[int]]] = defaultdict(dict)  # length -> gap -> open bins that hold such an item
        self.most = np.zeros(size + 1, np.int64)  # the largest gap of those bins
        self.open: set[int] = set()
        self.rising: dict[int, tuple[list[int], list[int]]] = {}  # bin -> its items, shortest first, and their lengths; until the bin changes
        self.moves = self.swaps = self.twos = self.splits = 0
        for b, g in enumerate(self.gap):
            if g > 0:
                self._enter(b)

    def _enter(self, b: int) -> None:
        g = self.gap[b]
        self.open.add(b)
        self.by_gap[g].add(b)
        self.gaps |= 1 << g
        for n in {self.lengths[i] for i in self.bins[b]}:
            self.holders[n].setdefault(g, set()).add(b)
            if self.most[n] < g:
                self.most[n] = g

    def _leave(self, b: int) -> None:
        g = self.gap[b]
        self.open.discard(b)
        self.by_gap[g].discard(b)
        if not self.by_gap[g]:
            self.gaps &= ~(1 << g)
        for n in {self.lengths[i] for i in self.bins[b]}:
            own = self.holders[n]
            own[g].discard(b)
            if not own[g]:
                del own[g]
                if self.most[n] == g:
                    self.most[n] = max(own, default=0)

    def _give(self, a: int, b: int, out: list[int], back: list[int]) -> None:
        """Items ``out`` of a go to b, items ``back`` of b to a."""
        self._leave(b)
        self.rising.pop(a, None)
        self.rising.pop(b, None)
        for x, y, items in ((a, b, out), (b, a, back)):
            n = sum(self.lengths[i] for i in items)
            self.gap[x] += n
            self.gap[y] -= n
            for i in items:
                self.bins[x].remove(i)
                self.bins[y].append(i)
        if self.gap[b] > 0:
            self._enter(b)

    def _partner(self, total: int, most: int) -> tuple[int, int] | None:
        """An open bin of gap ``most`` at most and its item, shorter than total by at most the bin's gap; the shortest such item."""
        top = min(total, self.size + 1)
        held = self.most[1:top]
        y = np.flatnonzero((held > 0) & (np.arange(1, top) + held >= total)) + 1
        for n in y.tolist():
            gaps = [g for g in self.holders[n] if total - n <= g <= most]
            if gaps:
                b = min(self.holders[n][min(gaps)])
                return b, next(i for i in self.bins[b] if self.lengths[i] == n)
        return None

    def take_apart(self, a: int) -> bool:
        """Whether bin a could be emptied."""
        self._leave(a)
        while self.bins[a]:
            items = sorted(self.bins[a], key=lambda i: (-self.lengths[i], i))
            if any(self._move(a, i) for i in items) or any(self._swap(a, [i]) for i in items) or self._two(a, items) or any(self._split(a, i) for i in items):
                continue
            return False
        return True

    def _move(self, a: int, i: int) -> bool:
        n = self.lengths[i]
        if not (fits := self.gaps >> n):
            return False
        gap = (fits & -fits).bit_length() - 1 + n
        if gap - n >= self.gap[a]:  # b would not become the fuller one
            return False
        self._give(a, min(self.by_gap[gap]), [i], [])
        self.moves += 1
        return True

    def _swap(self, a: int, out: list[int]) -> bool:
        hit = self._partner(sum(self.lengths[i] for i in out), self.gap[a])
        if not hit:
            return False
        self._give(a, hit[0], out, [hit[1]])
        if len(out) == 1:
            self.swaps += 1
        else:
            self.twos += 1
        return True

    def _two(self, a: int, items: list[int]) -> bool:
        seen = set()
        for k, i in enumerate(items):
            for j in items[k + 1 :]:
                s = self.lengths[i] + self.lengths[j]
                if s not in seen:
                    seen.add(s)
                    if self._swap(a, [i, j]):
                        return True
        return False

    def _split(self, a: int, i: int, looked: int = 400) -> bool:
        """Item i of a for two shorter ones of a fuller bin; ``looked`` bins are tried, those with the largest gaps first: a bound of the search's time, it leaves no item out."""
        total = self.lengths[i]
        left = self.gaps & (1 << self.gap[a] + 1) - 1
        while left and looked > 0:
            g = left.bit_length() - 1
            left &= ~(1 << g)
            for b in sorted(self.by_gap[g]):
                looked -= 1
                if (known := self.rising.get(b)) is None:
                    items = sorted(self.bins[b], key=self.lengths.__getitem__)
                    known = self.rising[b] = items, [self.lengths[x] for x in items]
                items, lengths = known
                p, q = 0, len(items) - 1
                if q < 1 or lengths[q - 1] + lengths[q] < total - g:
                    continue  # even the longest two are too short
                while p < q:
                    two = lengths[p] + lengths[q]
                    if two >= total:
                        q -= 1
                    elif two < total - g:
                        p += 1
                    else:
                        self._give(a, b, [i], [items[p], items[q]])
                        self.splits += 1
                        return True
        return False

    def run(self, least: int) -> list[list[int]]:
        """Takes bins apart, emptiest first, again while exchanges still change any; stops at ``least`` bins."""
        left = sum(1 for b in self.bins if b)
        before = None
        while left > least and (now := sum(g * g for g in self.gap)) != before:
            before = now
            for b, g in enumerate(self.gap):  # bins that could not be emptied take part again
                if 0 < g and self.bins[b] and b not in self.open:
                    self._enter(b)
            for b in sorted(self.open, key=lambda b: (-self.gap[b], b)):
                if left <= least:
                    break
                if b in self.open and self.take_apart(b):
                    left -= 1
        return [b for b in self.bins if b]


def pack(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers; each bin's lengths sum to ``size`` at most."""
    return Search(arrival(lengths, size), lengths, size).run(ceil(sum(lengths) / size))


def packed(docs: DataFrame, vocabulary: bytes, size: int = 2048, end: int = 0, group: int = 8192, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = settle(pieces(docs, vocabulary, size, end, key, text), "pieces")
    whole = cut.filter(F.col("length") == size)
    rest = cut.filter(F.col("length") < size)
    groups = max(1, ceil(rest.count() / group))
    # a full piece is a sequence: even numbers, from the row's own place
    whole = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 2).withColumn("offset", F.lit(0).cast("long"))
    dealt = F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.col("ids_crc32"), F.monotonically_increasing_id()), F.lit(groups))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, {PIECE}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        # in an order of their own, so that a task that is computed again packs alike
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("ids_crc32", "length", "piece", "start", key)]))
        lengths = table.column("length").to_numpy()
        number, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        own = int(table.column("_group")[0].as_py()) << 31
        for b, items in enumerate(pack(lengths.tolist(), size)):
            number[items] = 2 * (own + b) + 1
            place[items] = np.r_[0, np.cumsum(lengths[items])[:-1]]
        table = table.drop_columns(["_group"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(place))
        yield from table.to_batches()

    groups_ = rest.withColumn("_group", dealt).groupBy("_group")
    return whole.unionByName(groups_.applyInArrow(run, schema))
