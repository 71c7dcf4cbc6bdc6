"""Suffix arrays by induced sorting through disk-backed priority queues.

The sorted suffixes that start a rise (LMS) induce the falling ones, and these the rising
ones. Both directions are one loop over a priority queue of tuples (first symbol, kind,
order of the inducing suffix; position): the least tuples leave the queue, each in turn
queueing the suffix one symbol longer. LMS suffixes themselves are sorted by the same loop
on LMS substrings, named, and, where names repeat, by recursion on the string of names, down to one that is ordered in memory.

The queue works on arrays: of a sorted stretch of tuples all those leave at once that lie
before every tuple the stretch itself queues. Tuples far ahead wait unsorted in buckets by
symbol; beyond ``MEMORY`` tuples the buckets go to temporary files and come back one at a
time, so sorting memory does not grow with the shard.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Waiting tuples held in memory, and tuples a bucket is made for.
MEMORY, BUCKET = 8_000_000, 1 << 15
#: A string of names up to this long is ordered in memory; a longer one by recursion.
DIRECT = 1 << 18
_SYMBOL, _KIND = np.uint64(34), np.uint64(33)
_LEAST, _MOST = 512, 1 << 17


class BucketQueue:
    """A priority queue of (key, position) whose keys never fall below those taken."""

    def __init__(self, counts: np.ndarray, memory: int = MEMORY, bucket: int = BUCKET):
        """``counts``: how many tuples each symbol will get."""
        group = (np.cumsum(counts) - counts) // bucket
        # The first symbol of each bucket.
        self.first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(counts) else np.zeros(1, np.int64)
        n = len(self.first)
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(n)]
        self.files: list = [None] * n
        self.memory, self.held, self.now = memory, 0, -1
        empty = np.zeros((2, 0), np.uint64)
        # The bucket being taken, what was put back (before it), and what was queued since.
        self.sorted, self.back, self.pending, self.at, self.size = empty, empty, empty, 0, 4096

    def push(self, pairs: np.ndarray) -> None:
        """Queue the columns of ``pairs``, keys above positions."""
        if not pairs.shape[1]:
            return
        to = np.searchsorted(self.first, (pairs[0] >> _SYMBOL).astype(np.int64), side="right") - 1
        here = to == self.now
        if here.any():
            self.pending = np.concatenate([self.pending, pairs[:, here]], axis=1)
            self.pending = self.pending[:, np.argsort(self.pending[0], kind="stable")]
            if here.all():
                return
            pairs, to = pairs[:, ~here], to[~here]
        order = np.argsort(to, kind="stable")
        pairs, to = pairs[:, order], to[order]
        edges = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        for part, bucket in zip(np.split(pairs, edges[1:], axis=1), to[edges].tolist(), strict=True):
            self.waiting[bucket].append(part)
        self.held += pairs.shape[1]
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        for bucket, parts in enumerate(self.waiting):
            if parts and bucket > self.now + 1:
                if self.files[bucket] is None:
                    self.files[bucket] = tempfile.TemporaryFile()
                for part in parts:
                    self.held -= part.shape[1]
                    self.files[bucket].write(np.ascontiguousarray(part.T).tobytes())
                parts.clear()

    def _load(self) -> bool:
        while self.now + 1 < len(self.first):
            self.now += 1
            parts = self.waiting[self.now]
            self.held -= sum(p.shape[1] for p in parts)
            if (file := self.files[self.now]) is not None:
                file.seek(0)
                parts.append(np.frombuffer(file.read(), np.uint64).reshape(-1, 2).T)
                file.close()
                self.files[self.now] = None
            if parts:
                whole = np.concatenate(parts, axis=1)
                self.sorted, self.at = whole[:, np.argsort(whole[0])], 0
                self.waiting[self.now] = []
                return True
        return False

    def take(self) -> np.ndarray | None:
        """A sorted stretch of the least tuples; those taken too early go to ``put_back``."""
        while self.at >= self.sorted.shape[1] and not self.pending.shape[1] and not self.back.shape[1]:
            if not self._load():
                return None
        if self.back.shape[1]:
            head, self.back = self.back[:, : self.size], self.back[:, self.size :]
        else:
            head = self.sorted[:, self.at : self.at + self.size]
            self.at += head.shape[1]
        if self.back.shape[1]:
            cut = int(np.searchsorted(self.pending[0], self.back[0, 0]))
        elif self.at < self.sorted.shape[1]:
            cut = int(np.searchsorted(self.pending[0], self.sorted[0, self.at]))
        else:
            cut = self.pending.shape[1]
        if not cut:
            return head
        both = np.concatenate([head, self.pending[:, :cut]], axis=1)
        self.pending = self.pending[:, cut:]
        return both[:, np.argsort(both[0], kind="stable")]

    def put_back(self, pairs: np.ndarray, used: int) -> None:
        self.size = min(_MOST, max(_LEAST, 2 * used))
        if pairs.shape[1]:
            self.back = np.concatenate([pairs, self.back], axis=1) if self.back.shape[1] else pairs


def _induce(symbol: np.ndarray, seeds: np.ndarray, wanted: np.ndarray, sigma: int) -> np.ndarray:
    """Positions of the wanted type in order, induced from the sorted ``seeds``.

    Of one symbol the induced suffixes come before the seeds: falling before rising ones, and
    with symbols turned round the other way about.
    """
    counts = np.bincount(symbol[wanted], minlength=sigma) + np.bincount(symbol[seeds], minlength=sigma)
    queue = BucketQueue(counts)
    key = symbol[seeds].astype(np.uint64) << _SYMBOL | np.uint64(1) << _KIND | np.arange(len(seeds), dtype=np.uint64)
    queue.push(np.stack([key, seeds.astype(np.uint64)]))
    out, order = [], 0
    while (pairs := queue.take()) is not None:
        keys, at = pairs[0], pairs[1].astype(np.int64)
        before = at - 1
        grows = (before >= 0) & wanted[before]
        longer = symbol[before].astype(np.uint64) << _SYMBOL | np.arange(order, order + len(at)).astype(np.uint64)
        # A tuple may leave if no tuple before it in the stretch queues a lesser one.
        least = np.minimum.accumulate(np.where(grows, longer, np.uint64(2**64 - 1)))
        early = keys[1:] > least[:-1]
        used = int(early.argmax()) + 1 if early.any() else len(at)
        queue.put_back(pairs[:, used:], used)
        grows[used:] = False
        queue.push(np.stack([longer[grows], before[grows].astype(np.uint64)]))
        induced = (keys[:used] >> _KIND & np.uint64(1)) == 0
        out.append(at[:used][induced])
        order += used
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _rising(symbol: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than the next one; the last counts as rising."""
    n = len(symbol)
    step = np.sign(np.diff(symbol.astype(np.int64)))
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n - 1)[::-1])[::-1]
    return np.r_[np.r_[step, 1][nearest] > 0, True]


def _names(symbol: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """The rank of the LMS substring at each of ``lms``, equal for equal ones."""
    stop = np.full(len(symbol), -1, np.int64)
    stop[lms] = np.r_[lms[1:], lms[-1]]
    a, b = ordered[:-1], ordered[1:]
    length = stop[a] - a
    differ = length != stop[b] - b
    open_ = np.flatnonzero(~differ)
    offset = 0
    while len(open_):
        unlike = symbol[a[open_] + offset] != symbol[b[open_] + offset]
        differ[open_[unlike]] = True
        offset += 1
        open_ = open_[~unlike]
        open_ = open_[length[open_] >= offset]
    name = np.zeros(len(symbol), np.int64)
    name[ordered] = np.r_[0, np.cumsum(differ)]
    return name[lms]


def _doubled(symbol: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by ranks of prefixes of doubling length."""
    rank, reach, n = symbol.astype(np.int64), 1, len(symbol)
    while True:
        following = np.zeros(n, np.int64)
        following[: max(n - reach, 0)] = rank[reach:] + 1
        key = rank << 32 | following
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(key[order][1:] != key[order][:-1])]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        reach *= 2


def suffix_array(symbol: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``symbol``, whose last symbol is 0 and the only 0 there is."""
    n, sigma = len(symbol), int(symbol.max()) + 1
    if n <= 2:
        return np.arange(n)[::-1].copy()
    rising = _rising(symbol)
    lms = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    falling, turned = ~rising, (sigma - 1 - symbol)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True

    def spread(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        down = _induce(symbol, seeds, falling, sigma)
        up = _induce(turned, down[::-1], rising, sigma)[::-1]
        return down, np.r_[n - 1, up]  # the end itself follows nothing

    _, up = spread(lms[np.argsort(symbol[lms], kind="stable")])
    ordered = up[is_lms[up]]
    names = _names(symbol, lms, ordered)
    if names.max() + 1 < len(lms):
        ordered = lms[suffix_array(names) if len(names) > DIRECT else _doubled(names)]
    down, up = spread(ordered)
    both = np.r_[down, up]
    return both[np.argsort(symbol[both] * 2 + rising[both], kind="stable")]
