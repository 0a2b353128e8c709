"""Processors of keyed state for polls and caches.

Spark starts one of them in a process that knows no path of this package, so they are sent with
their code rather than by name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Polls (hours) after which a post that was not seen again is unknown, and for how long its state
#: is kept at all, in case its channel is never polled again.
KNOWN_FOR, KEPT_MS = 72, 30 * 86_400_000
#: Buckets of channels; a stream that goes on must keep their number.
BUCKETS = 2048
#: Seconds between polls: at least, at most (fixed values).
SHORTEST, LONGEST = 900, 86_400


def interval(rate: float | None, empty: int, overflow: bool) -> float:
    """Seconds to the next poll: target over rate, slowed by empty polls; half of it after an overflow."""
    seconds = LONGEST if not rate or rate <= 0 else min(max(60 / rate * 3600 * (1 + 0.5 * min(empty, 6)), SHORTEST), LONGEST)
    return max(seconds / 2, SHORTEST) if overflow else seconds


class PollStep(StatefulProcessor):
    """Responses of a bucket's channels in turn: what is new, whether posts were missed, the cursor, the next poll.

    Every call of a processor or of its state crosses to the JVM and back, so channels are kept by
    buckets and a bucket's state is read and written once a batch, as columns. Posts not seen for
    KNOWN_FOR polls leave it, and all posts of a channel that was not polled for KEPT_MS.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "channel array<long>, id array<long>, poll array<long>", ttlDurationMs=KEPT_MS)
        self.cursors = handle.getValueState("cursors", "channel array<long>, seen array<long>, poll array<long>, empty array<long>, rate array<double>, at array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentProcessingTimeInMs()
        cursors = {c: rest for c, *rest in zip(*(self.cursors.get() or [()]))}
        known: dict[int | None, dict[int | None, int]] = {}
        for c, i, poll in zip(*(self.known.get() or [()] * 3)):
            if now - cursors[c][-1] <= KEPT_MS:
                known.setdefault(c, {})[i] = poll
        turns: dict[int | None, list] = {}
        number = lambda x: None if x != x or x is None else int(x)  # noqa: E731  # frames turn null into NaN
        for b in rows:
            for c, poll, *rest in zip(b["channel"], b["poll"], b["ids"], b["blank"], b["oldest"], b["newest"]):
                turns.setdefault(number(c), []).append((int(poll), *rest))
        out = []
        for c, polls in turns.items():
            seen, last, empty, rate, _ = cursors.get(c, (None, None, 0, None, None))
            mine = known.setdefault(c, {})
            for poll, ids, blank, oldest, newest in sorted(polls, key=lambda r: r[0]):
                oldest, newest, fresh = number(oldest), number(newest), 0
                for i in [*ids.tolist(), *([None] if blank else [])]:
                    before = mine.get(i)
                    fresh += before is None or poll - before > KNOWN_FOR
                    mine[i] = poll
                overflow = oldest is not None and seen is not None and oldest > seen
                seen = newest if seen is None or newest is not None and newest > seen else seen
                if last is not None:
                    observed = fresh / (poll - last)
                    rate = observed if rate is None else 0.3 * observed + 0.7 * rate
                empty, last = 0 if fresh else empty + 1, poll
                out.append((c, poll, fresh, overflow, seen, rate, interval(rate, empty, overflow)))
            cursors[c] = (seen, last, empty, rate, now)
            known[c] = {i: p for i, p in mine.items() if last - p <= KNOWN_FOR}
        self.cursors.update(tuple(map(list, zip(*((c, *rest) for c, rest in cursors.items())))))
        kept = [(c, i, p) for c, posts in known.items() for i, p in posts.items()]
        self.known.update(tuple(map(list, zip(*kept))) or ([], [], []))
        frame = pd.DataFrame(out, columns=["channel", "poll", "fresh", "overflow", "seen", "rate", "seconds"])
        yield frame.astype({"channel": "Int64", "seen": "Int64", "rate": "float64"})

    def close(self) -> None:
        pass


#: Seconds for which an entry is served.
TTL = 6 * 3600


class Cache(StatefulProcessor):
    """An entry by key. Reads find it or store a new one, writes put one over it; an entry whose time
    is over is gone at the next use, or by its timer. Yields the key's counts whenever they change."""

    COUNTS = ("hits", "misses", "replaced", "expired")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "until long")
        self.counts = handle.getValueState("counts", ", ".join(f"{c} long" for c in self.COUNTS))

    def _shown(self, key, counts) -> pd.DataFrame:
        self.counts.update(tuple(counts))
        return pd.DataFrame([(key[0], *counts)], columns=["url", *self.COUNTS])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits, misses, replaced, expired = self.counts.get() or (0, 0, 0, 0)
        until = (self.entry.get() or (None,))[0]
        started = until
        for at, _, put in sorted((int(a), int(i), bool(p)) for b in rows for a, i, p in zip(b["second"], b["id"], b["put"])):
            if until is not None and until <= at:
                expired, until = expired + 1, None
            if put:
                replaced += until is not None
            else:
                hits, misses = hits + (until is not None), misses + (until is None)
            if put or until is None:
                until = at + TTL
        if until != started:
            if started is not None:
                self.handle.deleteTimer(started * 1000)
            self.entry.update((until,))
            self.handle.registerTimer(until * 1000)
        yield self._shown(key, (hits, misses, replaced, expired))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        hits, misses, replaced, expired = self.counts.get()
        self.entry.clear()
        yield self._shown(key, (hits, misses, replaced, expired + 1))

    def close(self) -> None:
        pass
