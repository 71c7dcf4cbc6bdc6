"""Benchmark decontamination: SimHash of item-sized windows, then exact similarity.

A document is searched through windows of as many words as a benchmark item has. Each window
gets a ``BITS``-bit SimHash of its 5-word shingles, each labelled with its occurrence in the
window, so that all weigh one and a repeated word outweighs nothing. Fingerprints are cut into ``BLOCKS`` blocks; two within ``RADIUS`` bits agree in some block up to
``RADIUS // BLOCKS`` bits, so an index of the items by each block, probed with every pattern
of that many flipped bits, gives all items within the radius and no window is compared with
all items. Candidates are verified by weighted Jaccard similarity of the shingle counts, 0.8
or more.

Windows that cannot reach the similarity are passed over before hashing: a window and an item
of equal size that are 0.8 similar share 8/9 of their shingles, so fewer than that of the
window's shingles found in items of its size rule it out. Weighted similarity is plain
similarity of the labelled shingles, so at 0.8, repeats or not, a
fingerprint differs from the item's by 19 of 128 bits on average, with a standard deviation
of 4; the radius of 39 is almost five of these away.

The benchmark goes to the tasks in blocks, dealt by hash, of ``BLOCK_WORDS`` words on average
(some 64 MB with the index), so what is broadcast is bounded; a larger benchmark takes more
passes over the documents.

Nulls and odd input: a null or empty text has no windows, a null or empty item is never
found. A text or window of fewer than five words is one shingle and matches only itself.
Whole texts are searched, however long, some windows at a time. Equal rows give equal rows.
Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.shingles import WORDS_IN_SHINGLE, labelled, mixed, shingle_hashes, with_label, word_hashes
from evalframe.llm.tables import written

SIMILARITY = 0.8
BITS, BLOCKS, RADIUS = 128, 8, 39
BLOCK_WORDS = 500_000
#: Windows hashed at once.
WINDOWS = 4_096
_BLOCK_BITS = BITS // BLOCKS
_FLIPS = np.array(
    [sum(1 << b for b in bits) for n in range(RADIUS // BLOCKS + 1) for bits in combinations(range(_BLOCK_BITS), n)],
    np.uint16,
)
_OTHER = np.uint64(0x9E3779B97F4A7C15)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    two = np.stack([mixed(shingles), mixed(shingles ^ _OTHER)], axis=1)
    bits = np.unpackbits(two.view(np.uint8).reshape(len(shingles), BITS // 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as ``BLOCKS`` numbers of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def _window_sums(shingles: np.ndarray, per: int) -> np.ndarray:
    """Signs of the labelled shingles, added up over each window of ``per`` shingles."""
    windows = len(shingles) - per + 1
    _, value, times = np.unique(shingles, return_inverse=True, return_counts=True)
    if len(times) == len(shingles):
        sums = np.zeros((len(shingles) + 1, BITS), np.int32)
        np.cumsum(_signs(shingles), axis=0, out=sums[1:])
        return sums[per:] - sums[:-per]
    # A window's step takes the highest label of the shingle that leaves and gives the one that
    # enters the next; either is the number of equal shingles in the rest of the window.
    step = np.arange(windows - 1)
    wide = len(shingles) + 1
    places = np.sort(value * wide + np.arange(len(shingles)))

    def rest(of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, of * wide + end) - np.searchsorted(places, of * wide + begin)

    leaves = with_label(shingles[: windows - 1], rest(value[: windows - 1], step + 1, step + per))
    enters = with_label(shingles[per:], rest(value[per:], step + 1, step + per))
    sums = np.empty((windows, BITS), np.int32)
    sums[0] = _signs(labelled(shingles[:per])).sum(0)
    sums[1:] = _signs(enters) - _signs(leaves)
    return np.cumsum(sums, axis=0, out=sums)


class Items:
    """A block of the benchmark with its index."""

    def __init__(self, ids: list[int], words: list[bytes]):
        self.ids = ids
        hashes = [np.frombuffer(x, np.uint64) for x in words]
        self.words = np.array([len(x) for x in hashes])
        self.sizes = np.unique(self.words).tolist()
        # Documents at least this long are cut into full shingles for every item that can match.
        self.least_words = WORDS_IN_SHINGLE if self.sizes[0] >= WORDS_IN_SHINGLE else 2**62
        self.shingles = [shingle_hashes(x) for x in hashes]
        self.known = np.unique(np.concatenate(self.shingles))
        self.by_size = {
            size: np.unique(np.concatenate([x for x, n in zip(self.shingles, self.words, strict=True) if n == size]))
            for size in self.sizes
        }
        prints = np.concatenate([_packed(_signs(labelled(x)).sum(0)[None, :]) for x in self.shingles])
        self.prints = prints
        # Per block, items in the order of the block's value and where each value starts.
        self.order = [np.argsort(prints[:, k], kind="stable") for k in range(BLOCKS)]
        self.start = [
            np.searchsorted(prints[order, k], np.arange(2**_BLOCK_BITS + 1)) for k, order in enumerate(self.order)
        ]

    def near(self, one: np.ndarray) -> np.ndarray:
        """The items whose fingerprint is within the radius of ``one``."""
        found = []
        for k in range(BLOCKS):
            values = (_FLIPS ^ one[k]).astype(np.int64)
            begin, end = self.start[k][values], self.start[k][values + 1]
            full = np.flatnonzero(end > begin)
            found += [self.order[k][b:e] for b, e in zip(begin[full].tolist(), end[full].tolist(), strict=True)]
        if not found:
            return np.zeros(0, np.int64)
        items = np.unique(np.concatenate(found))
        return items[np.bitwise_count(self.prints[items] ^ one).sum(1) <= RADIUS]

    def _similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of the shingle counts."""
        both, place = np.unique(np.r_[self.shingles[item], window], return_inverse=True)
        a = np.bincount(place[: len(self.shingles[item])], minlength=len(both))
        b = np.bincount(place[len(self.shingles[item]) :], minlength=len(both))
        return float(np.minimum(a, b).sum() / np.maximum(a, b).sum())

    def search(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """For each item found its best similarity and the first word of that window."""
        best: dict[int, tuple[float, int]] = {}
        if not self._hits(words, WORDS_IN_SHINGLE).any() and len(words) >= self.least_words:
            return best
        for size in self.sizes:
            k = min(WORDS_IN_SHINGLE, size, len(words))
            item_shingles = size - min(WORDS_IN_SHINGLE, size) + 1
            # A document shorter than the item is one window.
            window = min(size, len(words))
            per = window - k + 1
            least = int(np.ceil(SIMILARITY / (1 + SIMILARITY) * (per + item_shingles) - 1e-9))
            if not len(words) or per < least:
                continue
            # Shingles of each window that items of this size have, from running totals.
            shingles, hits = self._cut(words, k), self._hits(words, k)
            own = np.flatnonzero(hits)
            if len(own) < least:
                continue
            own = own[np.isin(shingles[own], self.by_size[size])]
            if len(own) < least:
                continue
            total = np.zeros(len(shingles) + 1, np.int64)
            total[own + 1] = 1
            np.cumsum(total, out=total)
            shared = total[per:] - total[:-per]
            self._verify(shingles, np.flatnonzero(shared >= least), per, size, best)
        return best

    def _verify(self, shingles: np.ndarray, begin: np.ndarray, per: int, size: int, best: dict) -> None:
        if not len(begin):
            return
        # Windows start close together: one running total over the stretch they cover.
        for run in np.split(begin, np.flatnonzero(np.diff(begin) > per) + 1):
            for part in np.array_split(run, 1 + len(run) // WINDOWS):
                first = int(part[0])
                prints = _packed(_window_sums(shingles[first : int(part[-1]) + per], per)[part - first])
                seen: dict[bytes, np.ndarray] = {}
                for at, one in zip(part.tolist(), prints, strict=True):
                    key = one.tobytes()
                    if key not in seen:
                        near = self.near(one)
                        seen[key] = near[self.words[near] == size]
                    for item in seen[key].tolist():
                        alike = self._similarity(item, shingles[at : at + per])
                        if alike >= SIMILARITY and (item not in best or alike > best[item][0]):
                            best[item] = (alike, at)

    def _cut(self, words: np.ndarray, k: int) -> np.ndarray:
        if self._held is None or self._held[0] is not words:
            self._held = (words, {})
        if k not in self._held[1]:
            made = shingle_hashes(words, k)
            place = np.minimum(np.searchsorted(self.known, made), len(self.known) - 1)
            self._held[1][k] = (made, self.known[place] == made)
        return self._held[1][k][0]

    def _hits(self, words: np.ndarray, k: int) -> np.ndarray:
        self._cut(words, k)
        return self._held[1][k][1]

    _held: tuple[np.ndarray, dict] | None = None


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[tuple[list[int], list[bytes]]]:
    """The benchmark's word hashes, in blocks of bounded size, one at a time in the driver."""
    rows = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(text).alias("text")).where("text IS NOT NULL")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = list(word_hashes(batch["text"]))
            yield pd.DataFrame({"id": batch["id"], "words": [x.tobytes() for x in words], "n": [len(x) for x in words]})

    told = rows.mapInPandas(hashed, "id bigint, words binary, n bigint").where("n > 0")
    kept = written(told, "benchmark")
    blocks = 1 + (kept.agg(F.sum("n")).first()[0] or 0) // BLOCK_WORDS
    dealt = kept.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(blocks)))
    for block in range(blocks):
        held = dealt.where(F.col("block") == block).select("id", "words").collect()
        if held:
            yield [row["id"] for row in held], [bytes(row["words"]) for row in held]


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, similarity, word``: every item found in a document, once per row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id bigint, similarity double, word bigint"
    found = None
    for block in _blocks(items, item_id, item_text):
        sent = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(*sent.value)
            for batch in batches:
                row, found_here = [], []
                for n, words in enumerate(word_hashes(batch.column("text").to_pylist())):
                    for item, (alike, at) in index.search(words).items():
                        row.append(n)
                        found_here.append((index.ids[item], alike, at))
                ids, alike, at = zip(*found_here, strict=True) if found_here else ((), (), ())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(ids, pa.int64()),
                    pa.array(alike, pa.float64()), pa.array(at, pa.int64()),
                ], ["doc_id", "item_id", "similarity", "word"])

        part = rows.mapInArrow(searched, schema)
        found = part if found is None else found.unionAll(part)
    return spark.createDataFrame([], schema) if found is None else found


def drop_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents in which no item is found, as they came."""
    keyed = docs.withColumn("_key", F.xxhash64(doc_id, text))
    leaks = find_leaks(keyed, items, "_key", text).select(F.col("doc_id").alias("_leak")).distinct()
    return keyed.join(written(leaks, "leaks"), F.col("_key") == F.col("_leak"), "left_anti").drop("_key")
