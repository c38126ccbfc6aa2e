"""Requests in turn by host: so many of a host at a time, and who waits holds nobody up.

``Hosts`` is told the time, so that one set of rules serves both the threads that make requests
(``Drain``) and plans by known or guessed durations (``planned``).
"""

from __future__ import annotations

import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Hosts:
    """Queues by host. A host has ``slots``, each for one request at a time; what waits for a time is an entry of a heap."""

    def __init__(self, slots: int):
        self.slots = slots
        self.queues: dict[str, deque] = {}
        self.free: dict[str, list[int]] = {}
        self.turn: deque[str] = deque()  # hosts that may have both a free slot and a request
        self.listed: set[str] = set()
        self.later: list[tuple[float, int, str, object]] = []
        self.count = 0

    def add(self, host: str, item, at: float | None = None) -> None:
        """item joins the host's queue, now or when the time has come."""
        if at is not None:
            self.count += 1
            heappush(self.later, (at, self.count, host, item))
            return
        if host not in self.queues:
            self.queues[host] = deque()
            self.free.setdefault(host, list(range(self.slots)))
        self.queues[host].append(item)
        self._offer(host)

    def _offer(self, host: str) -> None:
        if self.queues.get(host) and self.free[host] and host not in self.listed:
            self.turn.append(host)
            self.listed.add(host)

    def take(self, now: float) -> tuple[str, int, object] | None:
        """The next (host, slot, item) that may begin; hosts take turns."""
        while self.later and self.later[0][0] <= now:
            _, _, host, item = heappop(self.later)
            self.add(host, item)
        while self.turn:
            host = self.turn.popleft()
            self.listed.discard(host)
            if self.queues.get(host) and self.free[host]:
                slot, item = heappop(self.free[host]), self.queues[host].popleft()
                self._offer(host)
                return host, slot, item
        return None

    def done(self, host: str, slot: int) -> None:
        """The slot is free again; a host that is idle is forgotten."""
        heappush(self.free[host], slot)
        if not self.queues.get(host) and len(self.free[host]) == self.slots:
            self.queues.pop(host, None)
            self.free.pop(host)
        else:
            self._offer(host)

    def wakes(self) -> float | None:
        """When the next entry that waits for a time is due."""
        return self.later[0][0] if self.later else None


class Drain:
    """Threads that make the requests of one task.

    ``make(item)`` gives (row, seconds to wait before the item is tried again, or None). A host's
    slot is free while an item of it waits. Rows are taken by ``rows``; as a context, all threads end with it.
    """

    def __init__(self, make: Callable, slots: int, threads: int):
        self.make, self.hosts, self.change = make, Hosts(slots), threading.Condition()
        self.found: list = []
        self.open, self.failed, self.ended = 0, None, False
        self.threads = [threading.Thread(target=self._run, daemon=True) for _ in range(threads)]

    def __enter__(self) -> Drain:
        for t in self.threads:
            t.start()
        return self

    def __exit__(self, *_) -> None:
        with self.change:
            self.ended = True
            self.change.notify_all()

    def add(self, host: str, item) -> None:
        with self.change:
            self.open += 1
            self.hosts.add(host, item)
            self.change.notify()

    def _next(self):
        with self.change:
            while not self.ended:
                now = time.monotonic()
                got = self.hosts.take(now)
                if got:
                    return got
                due = self.hosts.wakes()
                self.change.wait(None if due is None else max(0.0, due - now))
        return None

    def _run(self) -> None:
        while got := self._next():
            host, slot, item = got
            try:
                row, again = self.make(item)
            except BaseException as e:
                with self.change:
                    self.failed, self.ended = e, True
                    self.change.notify_all()
                return
            with self.change:
                self.found.append(row)
                self.hosts.done(host, slot)
                if again is None:
                    self.open -= 1
                else:
                    self.hosts.add(host, item, time.monotonic() + again)
                self.change.notify_all()

    def rows(self, most: int) -> list:
        """Waits until fewer than ``most`` items are open, at least one row is there or nothing is open; gives the rows so far."""
        with self.change:
            while self.open >= max(1, most) and not self.found and not self.failed:
                self.change.wait()
            if self.failed:
                raise self.failed
            out, self.found = self.found, []
            return out


def planned(requests: DataFrame, slots: int = 4, host: str = "host", order: str = "url", took: str = "took_ms") -> DataFrame:
    """requests with slot and start_ms: each in its host's first free slot, in order, if it takes ``took`` milliseconds.

    A host's rows are read in order by one task, which keeps the ends of its open requests only.
    Null hosts are one host; requests of equal order begin in any order; null durations count as 0.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    at = [requests.columns.index(c) for c in (host, took)]

    def run(batches: Iterator[pa.RecordBatch]):
        now_at, hosts, running, now = object(), None, [], 0
        for batch in batches:
            slot_of, start_of = [], []
            for name, ms in zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist()):
                if name != now_at or hosts is None:
                    now_at, hosts, running, now = name, Hosts(slots), [], 0
                hosts.add("", None)
                while not (got := hosts.take(now)):
                    now, slot = heappop(running)
                    hosts.done("", slot)
                heappush(running, (now + (ms or 0), got[1]))
                slot_of.append(got[1])
                start_of.append(now)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot_of, pa.int32()), pa.array(start_of, pa.int64())], names=[*batch.schema.names, "slot", "start_ms"])

    return requests.repartition(F.col(host)).sortWithinPartitions(host, order).mapInArrow(run, f"{kinds}, slot int, start_ms long")
