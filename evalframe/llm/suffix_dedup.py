"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller
id is removed. Suffix arrays of shards, built by external induced sorting, decide which
strings are equal; the steps around them see to it that equal strings meet in a shard and
that only text which can repeat is sorted.

1. Documents are packed into blocks of some ``BLOCK`` bytes and written.
2. Each string of ``LENGTH`` bytes has an anchor, the least hash of the ``GRAM``-byte grams
   inside it. Equal strings have equal anchors. Blocks tell the hashes of their anchors to
   the task of each hash range, which returns those that several blocks hold. A string whose
   anchor only one document holds repeats nowhere and is done with.
3. Strings that follow each other with one anchor form a segment. A block sends each distinct
   segment once, with its smallest document id, to the shard of its anchor. However often a
   passage occurs, it goes once from each block. The segments at the edge of a frequent line
   also hold text of their own documents, so an anchor can have as many as there are documents
   with the line. The strings of anchors are counted with step 2; those of an anchor with more
   than ``HOT`` go one by one, each to a shard of its own hash. Such a shard grows only by the
   one copy of a string that each block sends.
4. A shard sorts the suffixes of its distinct segments, but for those that share no string with
   another; neighbours with a common prefix of ``LENGTH`` bytes are equal strings, and each
   gets the smallest document id among them.
5. Blocks take the ids back and remove what a smaller document also has.

Nulls and odd input: a null text is empty and an empty text loses nothing; rows with equal
ids are one document, so nothing is removed between them; a null id counts as the smallest.
Matches never cross documents. A document longer than a block is a block of its own, worked
a stretch at a time. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm.induced_sort import suffix_array
from evalframe.llm.shingles import _BASE, _Powers, _weight, mixed
from evalframe.llm.tables import written

LENGTH, GRAM = 50, 24
BLOCK, STRETCH, SHARD = 2_000_000, 1_000_000, 1_000_000
#: Bytes of text for which one task compares anchors and sorts suffixes.
PART_BYTES = 5_000_000
#: Strings of one anchor above which they are dealt by their own hashes, about as many to each.
HOT = 100_000
#: Strings that one gram can be the anchor of, unless it repeats.
_WIDTH = LENGTH - GRAM + 1
_NO_ID = np.iinfo(np.int64).min


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 32-bit keys as differences, byte planes apart."""
    steps = np.diff(keys, prepend=np.uint32(0)).astype(np.uint32)
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32)


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, ids, texts, size, made = TaskContext.get().partitionId(), [], [], 0, 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "block": pa.array([task << 32 | made], pa.int64()), "bytes": pa.array([size], pa.int64()),
            "docs": pa.array([_pack(np.array(ids, np.int64), np.array([len(x) for x in texts], np.int64))], pa.binary()),
            "data": pa.array([zstandard.compress(b"".join(texts), 1)], pa.binary()),
        })

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if texts and size + len(text) > BLOCK:
                yield block()
                ids, texts, size, made = [], [], 0, made + 1
            ids.append(_NO_ID if doc is None else doc)
            texts.append(text)
            size += len(text)
    if texts:
        yield block()


class _Block:
    def __init__(self, row: pd.Series):
        self.number = int(row["block"])
        self.ids, self.sizes = _unpack(row["docs"])
        self.data = np.frombuffer(zstandard.decompress(row["data"]) or b"", np.uint8)
        self.ends = np.cumsum(self.sizes)
        # Places where a string of full length starts inside its document.
        inner = np.maximum(self.sizes - LENGTH + 1, 0)
        starts = (self.ends - self.sizes).repeat(inner)
        self.starts = starts + (np.arange(len(starts)) - (np.cumsum(inner) - inner).repeat(inner))
        self.doc = np.arange(len(self.ids)).repeat(inner)

    def anchors(self) -> np.ndarray:
        """The anchor of the string at each of ``starts``."""
        out = np.empty(len(self.starts), np.uint64)
        for begin in range(0, len(self.data), STRETCH):
            a, b = np.searchsorted(self.starts, [begin, begin + STRETCH])
            if b > a:
                least = _least_grams(self.data[begin : begin + STRETCH + LENGTH - 1])
                out[a:b] = least[self.starts[a:b] - begin]
        return out

    def runs(self, anchor: np.ndarray) -> np.ndarray:
        """First places in ``starts`` of strings in a row with one anchor."""
        new = (np.diff(self.starts) != 1) | (anchor[1:] != anchor[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(np.r_[True, new]) if len(anchor) else np.zeros(0, np.int64)


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _Powers.of(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_weight[data] * up[: len(data)], out=total[1:])
    return total, down


def _least_grams(data: np.ndarray) -> np.ndarray:
    """The least gram hash in the string starting at each place."""
    total, down = _sums(data)
    value = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        value = np.minimum(value[:-span], value[span:])
        span *= 2
    return np.minimum(value[: len(value) - (width - span)], value[width - span :])


def _keys(anchor: np.ndarray, parts: int) -> np.ndarray:
    """Part and 32-bit key of anchors in one number."""
    return (anchor >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | (anchor & np.uint64(0xFFFFFFFF))


def _tell(batches: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """The distinct anchor keys of each block, by part, and the strings of keys with more than ``_WIDTH``."""
    for batch in batches:
        for _, row in batch.iterrows():
            block = _Block(row)
            anchor = block.anchors()
            run = block.runs(anchor)
            count = np.diff(np.r_[run, len(anchor)])
            _, one = np.unique(_hashes(block.data, block.starts[run], count + LENGTH - 1), return_index=True)
            keys, which = np.unique(_keys(anchor[run[one]], parts), return_inverse=True)
            strings = np.bincount(which, count[one], len(keys)).astype(np.int64)
            part = (keys >> np.uint64(32)).astype(np.int64)
            edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(keys) else np.zeros(0, np.int64)
            pieces = np.split((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), edge[1:]) if len(keys) else []
            counts = np.split(strings, edge[1:]) if len(keys) else []
            yield pd.DataFrame({
                "part": part[edge], "block": block.number, "keys": [_pack_keys(x) for x in pieces],
                "more": pd.Series([_pack_above(x, _WIDTH) for x in counts], dtype=object),
            })


def _pack_above(values: np.ndarray, least: int) -> bytes | None:
    """The places and values of numbers above ``least``; None if there are none."""
    at = np.flatnonzero(values > least)
    return _pack(at.astype(np.int32), values[at]) if len(at) else None


def _shared(rows: pd.DataFrame, hot: int) -> pd.DataFrame:
    """Of one part's keys those that several blocks hold, for each block, and into how many
    keys the strings of each with more than ``hot`` are dealt."""
    told = [_unpack_keys(x) for x in rows["keys"]]
    strings = [np.full(len(x), _WIDTH, np.int64) for x in told]
    for held, more in zip(strings, rows["more"], strict=True):
        if more is not None:
            at, n = _unpack(more)
            held[at] = n
    tagged = (
        np.concatenate(told).astype(np.uint64) << np.uint64(32)
        | np.arange(len(told), dtype=np.uint64).repeat([len(x) for x in told])
    )
    order = np.argsort(tagged)
    tagged = tagged[order]
    same = tagged[1:] >> np.uint64(32) == tagged[:-1] >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, ~same])
    total = np.add.reduceat(np.concatenate(strings)[order], first)
    fan = (1 + total // hot).repeat(np.diff(np.r_[first, len(tagged)]))
    several = np.r_[False, same] | np.r_[same, False]
    tagged, fan = tagged[several], fan[several]
    owner = (tagged & np.uint64(0xFFFFFFFF)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    keys, owner, fan = (tagged[order] >> np.uint64(32)).astype(np.uint32), owner[order], fan[order]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
    pieces = np.split(keys, edge[1:]) if len(owner) else []
    fans = np.split(fan, edge[1:]) if len(owner) else []
    return pd.DataFrame({
        "block": rows["block"].to_numpy()[owner[edge]], "part": int(rows["part"].iloc[0]), "keys": [_pack_keys(x) for x in pieces],
        "fans": pd.Series([_pack_above(x, 1) for x in fans], dtype=object),
    })


class _Segments:
    """The segments of a block whose anchor another document may hold.

    ``at`` and ``count`` are the first string and the number of strings of each occurrence,
    ``which`` its distinct segment, and ``one`` an occurrence of each distinct segment. The
    strings of a hot anchor are segments of one string each.
    """

    def __init__(self, block: _Block, shared: pd.DataFrame, parts: int):
        anchor = block.anchors()
        run = block.runs(anchor)
        key = _keys(anchor[run], parts)
        wide = [np.uint64(p) << np.uint64(32) | _unpack_keys(x).astype(np.uint64) for p, x in zip(shared["part"], shared["keys"], strict=True)]
        elsewhere = np.isin(key, np.concatenate(wide)) if wide else np.zeros(len(run), bool)
        count = np.diff(np.r_[run, len(anchor)])
        chosen = elsewhere | _in_several(key, block.doc[run])
        run, self.count, self.key = run[chosen], count[chosen], key[chosen]
        self.at, self.doc = block.starts[run], block.doc[run]
        fan = self._fans(shared, wide)
        n = np.where(fan > 1, self.count, 1)
        step = np.arange(int(n.sum())) - (np.cumsum(n) - n).repeat(n)
        self.at, self.doc, self.key = self.at.repeat(n) + step, self.doc.repeat(n), self.key.repeat(n)
        self.count, fan = np.where(fan > 1, 1, self.count).repeat(n), fan.repeat(n)
        digest = _hashes(block.data, self.at, self.count + LENGTH - 1)
        hot = np.flatnonzero(fan > 1)
        dealt = digest[hot] % fan[hot].astype(np.uint64) + np.uint64(1)
        self.key[hot] = _keys(mixed(self.key[hot] + dealt * _BASE), parts)
        _, self.one, self.which = np.unique(digest, return_index=True, return_inverse=True)

    def _fans(self, shared: pd.DataFrame, wide: list[np.ndarray]) -> np.ndarray:
        """Into how many keys the strings of each occurrence are dealt; 1 if it stays whole."""
        told = [(keys, *_unpack(x)) for keys, x in zip(wide, shared["fans"], strict=True) if x is not None]
        fan = np.ones(len(self.key), np.int64)
        if told:
            hot, fans = np.concatenate([keys[at] for keys, at, _ in told]), np.concatenate([n for _, _, n in told])
            order = np.argsort(hot)
            hot, fans = hot[order], fans[order]
            place = np.minimum(np.searchsorted(hot, self.key), len(hot) - 1)
            fan[hot[place] == self.key] = fans[place[hot[place] == self.key]]
        return fan


def _in_several(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which entries have a key that two different owners have."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key, kind="stable")
        owner = owner[order]
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
        out[order] = several.repeat(np.diff(np.r_[first, len(key)]))
    return out


def _hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hashes of the strings of ``data`` at ascending places, a stretch at a time."""
    length = np.broadcast_to(np.asarray(length, np.int64), begin.shape)
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = int(np.searchsorted(begin, begin[i] + STRETCH))
        low, a, n = begin[i], begin[i:j] - begin[i], length[i:j]
        total, down = _sums(data[low : low + int((a + n).max())])
        out[i:j] = mixed((total[a + n] - total[a]) * down[a]) + mixed(n.astype(np.uint64) * _BASE)
        i = j
    return out


def _send(blocks: pd.DataFrame, shared: pd.DataFrame, parts: int) -> pd.DataFrame:
    """The distinct segments of a block, for the shards of each part."""
    rows = []
    if len(blocks):
        block = _Block(blocks.iloc[0])
        segments = _Segments(block, shared, parts)
        one = segments.one
        smallest = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(smallest, segments.which, block.ids[segments.doc])
        part = (segments.key[one] >> np.uint64(32)).astype(np.int64)
        for p in np.unique(part).tolist():
            mine = np.flatnonzero(part == p)
            held = one[mine]
            stop = segments.at[held] + segments.count[held] + LENGTH - 1
            text = b"".join(block.data[a:b].tobytes() for a, b in zip(segments.at[held].tolist(), stop.tolist(), strict=True))
            packed = _pack(mine.astype(np.int32), segments.count[held].astype(np.int32), smallest[mine], segments.key[held], text)
            rows.append((block.number, p, packed))
    return pd.DataFrame(rows, columns=["block", "part", "packed"])


def _smallest_ids(text: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each full string in the segments of ``text`` the smallest id of an equal one.

    Segments lie one after the other; ``ids`` has one per segment.
    """
    begin = np.cumsum(length) - length
    symbol = np.ones(len(text) + len(length) + 1, np.int64)  # 1 parts segments, 0 ends
    place = np.arange(len(text)) + np.arange(len(length)).repeat(length)
    symbol[place] = text.astype(np.int64) + 2
    symbol[-1] = 0
    count = length - LENGTH + 1
    segment = np.arange(len(length)).repeat(count)
    within = np.arange(len(segment)) - (np.cumsum(count) - count).repeat(count)
    at = (begin + np.arange(len(length)))[segment] + within
    number = np.full(len(symbol), -1, np.int64)
    number[at] = np.arange(len(at))
    order = number[suffix_array(symbol)]
    order = order[order >= 0]
    padded = np.r_[text, np.zeros(8, np.uint8)]
    word = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(np.uint64).ravel()
    where = (begin[segment] + within)[order]
    same = np.ones(len(order) - 1, bool)
    for offset in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= word[where[1:] + offset] == word[where[:-1] + offset]
    group = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(ids[segment[order]], group)
    out = np.empty(len(order), np.int64)
    out[order] = least.repeat(np.diff(np.r_[group, len(order)]))
    return out


def _sort_part(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block the smallest id of every string it sent to this part, run by run."""
    sent = [_unpack(x) for x in rows["packed"]]
    number, count, ids, key = (np.concatenate([x[k] for x in sent]) for k in range(4))
    text = np.frombuffer(b"".join(x[4] for x in sent), np.uint8)
    owner = np.arange(len(sent)).repeat([len(x[0]) for x in sent])
    length = count.astype(np.int64) + LENGTH - 1
    begin = np.cumsum(length) - length
    digest = _hashes(text, begin, length)
    _, one, which = np.unique(digest, return_index=True, return_inverse=True)
    smallest = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, ids)
    found: list[np.ndarray] = [np.full(n, i) for n, i in zip(count[one].tolist(), smallest.tolist(), strict=True)]
    # Only segments that share a string with a different segment are sorted.
    order = np.argsort(begin[one])
    n = count[one][order].astype(np.int64)
    segment = order.repeat(n)
    place = begin[one][segment] + np.arange(len(segment)) - (np.cumsum(n) - n).repeat(n)
    busy = np.zeros(len(one), bool)
    busy[segment[_in_several(_hashes(text, place, LENGTH), segment)]] = True
    busy = np.flatnonzero(busy)
    # Shards of whole anchors.
    order = busy[np.argsort(key[one[busy]], kind="stable")]
    size = np.cumsum(length[one][order])
    start = 0
    ends = np.flatnonzero(np.r_[key[one][order][1:] != key[one][order][:-1], True]) + 1 if len(order) else np.zeros(0, np.int64)
    for end in ends.tolist():
        if end < len(order) and size[end - 1] - (size[start - 1] if start else 0) < SHARD:
            continue
        mine = order[start:end]
        held = one[mine]
        start = end
        shard = np.concatenate([text[a : a + n] for a, n in zip(begin[held].tolist(), length[held].tolist(), strict=True)])
        least = _smallest_ids(shard, length[held], smallest[mine])
        for n, part in zip(mine.tolist(), np.split(least, np.cumsum(length[held] - LENGTH + 1)[:-1]), strict=True):
            found[n] = part
    out = []
    for k, (block, packed) in enumerate(zip(rows["block"], sent, strict=True)):
        mine = np.flatnonzero(owner == k)
        least = np.concatenate([found[n] for n in which[mine].tolist()])
        per = count[mine].astype(np.int64)
        head = np.zeros(len(least), bool)
        head[np.cumsum(per) - per] = True
        head[1:] |= least[1:] != least[:-1]
        run = np.flatnonzero(head)
        runs = np.diff(np.r_[run, len(least)]).astype(np.int32)
        out.append((int(block), int(rows["part"].iloc[0]), _pack(packed[0], per.astype(np.int32), runs, least[run])))
    return pd.DataFrame(out, columns=["block", "part", "packed"])


def _remove(blocks: pd.DataFrame, told: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Cut the documents of one block. ``told`` has its shared anchors and the shards' answers."""
    block = _Block(blocks.iloc[0])
    change = np.zeros(len(block.data) + 1, np.int32)
    answers = [_unpack(x) for x in told.loc[told["packed"].notna(), "packed"]]
    if answers:
        segments = _Segments(block, told[told["keys"].notna()], parts)
        number, per = (np.concatenate([x[k] for x in answers]).astype(np.int64) for k in (0, 1))
        least = np.concatenate([x[3].repeat(x[2]) for x in answers])
        begin = np.empty(len(number), np.int64)
        begin[number] = np.cumsum(per) - per
        count = segments.count
        step = np.arange(int(count.sum())) - (np.cumsum(count) - count).repeat(count)
        place = segments.at.repeat(count) + step
        smaller = least[begin[segments.which].repeat(count) + step] < block.ids[segments.doc].repeat(count)
        change[: len(block.data)] += np.bincount(place[smaller], minlength=len(block.data)).astype(np.int32)
        change -= np.bincount(place[smaller] + LENGTH, minlength=len(change)).astype(np.int32)
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    for doc, end, size in zip(block.ids.tolist(), block.ends.tolist(), block.sizes.tolist(), strict=True):
        cut = gone[end - size : end]
        edge = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8)))
        kept = block.data[end - size : end]
        rows.append((None if doc == _NO_ID else doc, size, edge[::2], edge[1::2], (kept[~cut] if len(edge) else kept).tobytes()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "span_starts", "span_stops", "kept"])
    return out.astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, span_starts, span_stops, kept``: removed spans (bytes, ends outside)
    and the remaining bytes of every document."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text"))
    blocks = written(rows.mapInArrow(_to_blocks, "block bigint, bytes bigint, docs binary, data binary"), "text-blocks")
    parts = 1 + (blocks.agg(F.sum("bytes")).first()[0] or 0) // PART_BYTES
    told = blocks.mapInPandas(lambda batches: _tell(batches, parts), "part bigint, block bigint, keys binary, more binary")
    hot = HOT
    shared = written(
        told.groupBy("part").applyInPandas(lambda rows: _shared(rows, hot), "block bigint, part bigint, keys binary, fans binary"),
        "shared-anchors",
    )
    segments = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(
        lambda a, b: _send(a, b, parts), "block bigint, part bigint, packed binary"
    )
    answers = written(segments.groupBy("part").applyInPandas(_sort_part, segments.schema), "smallest-ids")
    # Segments are worked out again rather than kept: they are larger than the text.
    back = shared.withColumn("packed", F.lit(None).cast("binary")).unionByName(
        answers.withColumns({"keys": F.lit(None).cast("binary"), "fans": F.lit(None).cast("binary")})
    )
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        lambda a, b: _remove(a, b, parts),
        "doc_id bigint, n_bytes bigint, span_starts array<bigint>, span_stops array<bigint>, kept binary",
    )
