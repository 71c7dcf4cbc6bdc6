"""Near-duplicates by Order MinHash, verified by banded alignment.

Texts with the same words are one text; the smallest id stands for it. Of each distinct text
``BANDS * SKETCHES`` sketches are taken: the two smallest of its 5-word shingles, labelled
with their occurrence, under one hash function, kept in text order. Texts that agree in all
sketches of a band share a bucket.

A bucket is worked in levels, never as all its pairs. At each of the first levels the first
member still unlinked is a pivot and compared with every member, in tasks dealt by pair, unless
the links so far have put both in one component. Members linked to a pivot leave the level.
Members go by the sum of the sizes of their buckets, the largest first: the text that others
were copied from shares more buckets than any copy, so a large group of copies is settled at
once. A bucket is done once its members left are of one component.

The distance used, one less the similarity, is a metric, so of the members that were compared
with one pivot only those can be similar of which one is linked to it and the other lies within
the limit of the farthest linked one. Those, and the members left, are the crowd that still has to be
compared. It may hold many texts that are somewhat alike, often by a passage that very many share.

The crowd meets only over rare shingles (prefix and position filter of set similarity joins; no
pair of 0.8 is missed). Its shingles have one order: those of one component only come first, as
they join nobody, then those that the fewest texts hold. Two texts with n1 and n2 shingles that
align to 0.8 share 4/9 of n1 + n2, so from the first shingle they share on, each has that many;
they meet only over a shingle from which on both do. Texts that share no more than a common
passage meet nowhere. A shingle's members, too, are worked in levels: up to ``PIVOTS`` of them, of the
components with the fewest members there first, meet all others of other components, and four
times as many at each further level, until those that were no pivots are of one component.

Similarity is that of the two shingle sequences under their best order-preserving alignment:
aligned / (n1 + n2 - aligned), 0.8 or more. Shingles align only within the band outside
which no alignment can reach ``BORDER``.

Nulls and odd input: null texts and texts without words are alone in their class, unless
they have the same characters. A row is known by its id and its text: rows with equal ids and
texts are one document, rows of one id with different texts are judged each by its own text,
and a class is named by the smallest id of its rows, null only if no row of it has an id. Long texts
are sketched and aligned whole. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm.components import components
from evalframe.llm.shingles import labelled, mixed, shingle_hashes, word_hashes
from evalframe.llm.tables import written

SIMILARITY = 0.8
#: Twice the limit of the distance: farther members share no neighbour with a pivot.
BORDER = 1 - 2 * (1 - SIMILARITY) - 1e-9
BANDS, SKETCHES = 24, 3
#: Levels with a single pivot a bucket, and pivots of a rare shingle at first.
SINGLE, PIVOTS = 2, 32
#: Share of the shingles of two similar texts, counted together, that both must hold.
SHARED = SIMILARITY / (1 + SIMILARITY)
#: Hashes held at once while sketching one text.
CELLS = 1_000_000
_MAX = np.uint64(2**64 - 1)
_draw = np.random.Generator(np.random.PCG64(11))
_MASK = _draw.integers(0, 2**64, BANDS * SKETCHES, np.uint64)
_FACTOR = _draw.integers(0, 2**64, BANDS * SKETCHES, np.uint64) | np.uint64(1)
_TURN = np.uint64(0xA0761D6478BD642F)


def order_minhash(shingles: np.ndarray) -> np.ndarray:
    """One key per band from the labelled shingles of a text."""
    n = len(shingles)
    low, high = (np.zeros(BANDS * SKETCHES, np.int64) for _ in range(2))
    step = max(1, CELLS // n)
    for begin in range(0, BANDS * SKETCHES, step):
        part = slice(begin, begin + step)
        value = (shingles[None, :] ^ _MASK[part, None]) * _FACTOR[part, None]
        first = value.argmin(1)
        value[np.arange(len(value)), first] = _MAX
        second = value.argmin(1) if n > 1 else first
        low[part], high[part] = np.minimum(first, second), np.maximum(first, second)
    sketch = mixed(shingles[low] * _TURN + shingles[high]).reshape(BANDS, SKETCHES)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in sketch.T:
        key = mixed(key * _TURN + column)
    return key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints, sizes, bands = [], [], []
        ids, texts = batch.column("id"), batch.column("text").to_pylist()
        hashes = batch.column("text_hash")
        for doc, text, words in zip(ids, texts, word_hashes(texts), strict=True):
            if len(words):
                shingles = shingle_hashes(words)
                prints.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
                bands.append(order_minhash(labelled(shingles)).view(np.int64))
                sizes.append(len(shingles))
            else:
                print_of = hashlib.blake2b((text or str(doc)).encode("utf-8", "replace"), digest_size=15).digest()
                prints.append((b"t" if text else b"n") + print_of)
                bands.append(None)
                sizes.append(0)
        yield pa.RecordBatch.from_arrays(
            [ids, hashes, pa.array(prints, pa.binary()), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
            ["id", "text_hash", "print", "n", "bands"],
        )


def _places(sequence: np.ndarray) -> dict[int, int]:
    """For each hash the bit set of its places."""
    found: dict[int, int] = {}
    for at, value in enumerate(sequence.tolist()):
        found[value] = found.get(value, 0) | 1 << at
    return found


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two hash sequences within ``band`` of the diagonal.

    Equal ends are counted off. The rest goes row by row through a bit vector whose zeros
    are the alignment so far; columns left of the band are counted and dropped.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places, total, width = _places(a), 0, len(a)
    base = 0  # the first column still held
    state = (1 << width) - 1
    for row, value in enumerate(b.tolist()):
        start = row - band
        if start - base >= 4096:  # drop whole stretches, not a column at a time
            gone = start - base
            kept = state & ((1 << gone) - 1)
            total += gone - kept.bit_count()
            state, base = state >> gone, start
        match = places.get(value, 0) >> base
        if not match:
            continue
        stop = row + band + 1 - base
        if stop < width - base:
            match &= (1 << max(stop, 0)) - 1
        if start > base:
            match = match >> (start - base) << (start - base)
        both = state & match
        state = ((state + both) | (state - both)) & ((1 << max(width - base, 0)) - 1)
    return head + tail + total + max(width - base, 0) - state.bit_count()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Aligned share of two shingle sequences; 0 where it is below ``BORDER``."""
    total = len(a) + len(b)
    least = int(np.ceil(total * BORDER / (1 + BORDER) - 1e-9))
    if min(len(a), len(b)) < least:
        return 0.0
    common = aligned(a, b, total - 2 * least)
    return common / (total - common) if common >= least else 0.0


def _scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        last, scores = None, []
        for a, one, other in zip(batch["a"], batch["text_a"], word_hashes(batch["text_b"]), strict=True):
            if last is None or last[0] != a:
                last = (a, shingle_hashes(next(word_hashes([one]))))
            scores.append(similarity(last[1], shingle_hashes(other)))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": scores})


def _scored(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of pairs; the texts of both ends come by joins that split hot ends."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(two, "b").join(one, "a")
    return written(both.mapInPandas(_scores, "a bigint, b bigint, similarity double"), "scores")


def _placed(members: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Members with the component that the links so far put them in."""
    alone = members.drop("component")
    if joined is None:
        return alone.withColumn("component", F.col("id"))
    known = joined.select(F.col("id").alias("_id"), F.col("component").alias("_component"))
    return alone.join(known, alone["id"] == known["_id"], "left").withColumn(
        "component", F.coalesce("_component", "id")
    ).drop("_id", "_component")


def _shingle_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        held = [labelled(shingle_hashes(words)).view(np.int64) for words in word_hashes(batch["text"])]
        yield batch.drop(columns="text").assign(shingles=held)


def _rare_buckets(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Members in buckets of the rare shingles over which similar ones of two components must meet.

    All shingles have one order: those of a single text or component join nobody and come first,
    then the rarest. ``rest`` is the number of a member's shingles from that of the bucket on.
    """
    sets = written(
        members.join(texts, "id").mapInPandas(_shingle_sets, "id bigint, n int, weight bigint, component bigint, shingles array<bigint>"),
        "shingle-sets",
    )
    single = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(
        F.count(F.lit(1)).alias("f"), F.min("id").alias("id")
    ).where("f = 1").groupBy("id").agg(F.count(F.lit(1)).alias("_own"))
    places = F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1
    able = sets.join(single, "id", "left").where(F.coalesce("_own", F.lit(0)) < places).drop("_own")
    held = written(able, "able-sets").select("id", "n", "weight", "component", F.explode("shingles").alias("shingle"))
    common = held.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("f"), F.min("component").alias("a"), F.max("component").alias("b")
    ).where("a <> b").select("shingle", "f")
    rare_first = F.array_sort(F.collect_list(F.struct("f", "shingle")))
    ordered = held.join(common, "shingle").groupBy("id", "n", "weight", "component").agg(rare_first.alias("order"))
    begins = (places - F.col("n") + F.size("order")).cast("int")
    return ordered.withColumn("size", F.size("order")).select(
        "id", "n", "weight", "component", "size", F.posexplode(F.slice("order", 1, F.greatest(begins, F.lit(0)))).alias("at", "x")
    ).select(F.col("x.shingle").alias("bucket"), "id", "n", "weight", "component", (F.col("size") - F.col("at")).alias("rest"))


def _several(left: DataFrame) -> DataFrame:
    """Members of buckets that hold members of several components."""
    ends = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    return left.join(ends.select("bucket"), "bucket", "left_semi")


def _meetable(left: DataFrame) -> DataFrame:
    """The same for buckets of shingles, of members that have a partner of fitting length there."""
    reach = F.col("rest") / SHARED - F.col("n") + 1e-6  # the longest partner
    ends = left.groupBy("bucket").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.min("n").alias("_shortest"), F.max(reach).alias("_reach")
    ).where("a <> b").drop("a", "b")
    return left.join(ends, "bucket").where((reach >= F.col("_shortest")) & (F.col("n") <= F.col("_reach"))).drop("_shortest", "_reach")


def _apart(border: DataFrame, joined: DataFrame) -> DataFrame:
    """``id`` of members that may be similar although one is linked to a pivot and one is not.

    Of each pivot, the linked members that are far enough from it to reach the nearest one of
    another component, and those others that the farthest linked one may reach.
    """
    of = lambda name: joined.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
    placed = border.join(of("pivot"), "pivot", "left").join(of("id"), "id", "left").select(
        "bucket", "pivot", "id", (1 - F.col("similarity")).alias("d"), (F.col("similarity") >= SIMILARITY).alias("near"),
        (F.coalesce("_pivot", "pivot") != F.coalesce("_id", "id")).alias("far"),
    )
    limit = 1 - SIMILARITY + 1e-9
    ends = placed.groupBy("bucket", "pivot").agg(
        F.min(F.when(F.col("far"), F.col("d"))).alias("_far"), F.max(F.when(F.col("near"), F.col("d"))).alias("_near")
    ).where(F.col("_near") >= F.col("_far") - limit)
    reaching = F.col("near") & (F.col("d") >= F.col("_far") - limit) | F.col("far") & (F.col("d") <= F.col("_near") + limit)
    return placed.join(ends, ["bucket", "pivot"]).where(reaching).select("id").distinct()


def _link_texts(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, component`` of distinct texts under all links between texts that share a bucket
    (see the module's text)."""
    scores: DataFrame | None = None
    links: DataFrame | None = None
    border: DataFrame | None = None
    joined: DataFrame | None = None

    def compare(pairs: DataFrame) -> None:
        """Score pairs not scored yet, and join what they link."""
        nonlocal scores, links, joined
        if scores is not None:
            pairs = pairs.join(scores, ["a", "b"], "left_anti")
        fresh = _scored(pairs, texts)
        scores = fresh if scores is None else scores.unionAll(fresh)
        new_links = fresh.where(F.col("similarity") >= SIMILARITY).select("a", "b")
        if links is None or not new_links.isEmpty():
            links = new_links if links is None else links.unionAll(new_links)
            joined = components(links)

    left = members
    for level in range(SINGLE):
        # The first member left of each bucket and all others. No link is needed within a component.
        placed = written(_several(_placed(left, joined)), "unlinked") if level else _placed(left, None)
        ranked = Window.partitionBy("bucket").orderBy(F.col("weight").desc(), "id")
        chosen = written(
            placed.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1")
            .select("bucket", F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("component").alias("pivot_in")),
            "pivots",
        )
        met = _placed(members, joined).join(chosen, "bucket").where("component <> pivot_in").where(
            F.least("n", "pivot_n") >= BORDER * F.greatest("n", "pivot_n")
        )
        met = written(met.select("bucket", "id", "pivot", F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")), "met")
        compare(met.select("a", "b").distinct())
        told = written(met.join(scores.where(F.col("similarity") >= BORDER), ["a", "b"]).select("bucket", "pivot", "id", "similarity"), "border")
        border = told if border is None else border.unionAll(told)
        settled = told.where(F.col("similarity") >= SIMILARITY).select("bucket", "id").unionAll(
            chosen.select("bucket", F.col("pivot").alias("id"))
        )
        left = placed.join(settled, ["bucket", "id"], "left_anti")
    apart = _several(_placed(left, joined)).select("id").distinct()
    if border is not None:
        apart = apart.unionAll(_apart(border, joined)).distinct()
    crowd = members.select("id", "n", "weight").distinct().join(apart, "id", "left_semi")
    left, level = written(_meetable(_rare_buckets(_placed(crowd, joined), texts)), "rare-members"), 0
    while not left.isEmpty():
        # Members of small components are the pivots, so those of the largest need not be.
        of_component = left.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_of"))
        ranked = Window.partitionBy("bucket").orderBy("_of", F.col("weight").desc(), "id")
        chosen = written(
            left.join(of_component, ["bucket", "component"]).withColumn("_rank", F.row_number().over(ranked))
            .where(F.col("_rank") <= PIVOTS * 4**level).select("bucket", "id"),
            "pivots",
        )
        marked = left.join(chosen.withColumn("_chosen", F.lit(True)), ["bucket", "id"], "left")
        pivots = marked.where("_chosen").select("bucket", *(F.col(x).alias(f"pivot_{x}") for x in ("id", "n", "component", "rest")))
        met = marked.join(pivots, "bucket").where(
            (F.col("component") != F.col("pivot_component")) & (F.col("_chosen").isNull() | (F.col("id") > F.col("pivot_id")))
            & (F.least("rest", "pivot_rest") >= SHARED * (F.col("n") + F.col("pivot_n")) - 1e-6)
        )
        pairs = met.select(F.least("id", "pivot_id").alias("a"), F.greatest("id", "pivot_id").alias("b")).distinct()
        compare(written(pairs, "met"))
        after = _placed(left.join(chosen, ["bucket", "id"], "left_anti"), joined)
        left = written(_meetable(after), "rare-members")
        level += 1
    return _placed(members.select("id").distinct(), None) if joined is None else joined


def _classes(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, text_hash, class_id, first_hash`` of every row; id and text hash say which row it is.

    The first row of a class, by id and then by the hash of its text, has ``class_id`` and
    ``first_hash``. Texts have numbers of their own, so rows without an id are rows like others.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    sketched = written(
        rows.mapInArrow(_sketches, "id bigint, text_hash bigint, print binary, n int, bands array<bigint>"), "sketches"
    )
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "text_hash")).alias("first")
    texts_of = written(
        sketched.groupBy("print").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("number", F.monotonically_increasing_id()),
        "texts",
    )
    keyed = texts_of.where("n > 0").select(F.col("number").alias("id"), "n", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = written(keyed.join(shared, "bucket"), "met-buckets")
    weights = met.groupBy("id").agg(F.sum("_n").alias("weight"))
    members = written(met.select("id", "n", "bucket").join(weights, "id"), "members")
    involved = texts_of.join(weights.select(F.col("id").alias("number")), "number", "left_semi").select(
        "number", F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash")
    )
    of_first = rows.join(involved, rows["id"].eqNullSafe(involved["_id"]) & (rows["text_hash"] == involved["_hash"]))
    one_each = of_first.groupBy(F.col("number").alias("id")).agg(F.min("text").alias("text"))
    joined = _link_texts(members, written(one_each, "member-texts"))
    placed = texts_of.select("print", "number", "first").join(
        joined.select(F.col("id").alias("number"), "component"), "number", "left"
    )
    linked = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("class_first"))
    classes = placed.join(linked, "component", "left").select("print", F.coalesce("class_first", "first").alias("c"))
    return sketched.select("id", "text_hash", "print").join(classes, "print").select(
        "id", "text_hash", F.col("c.id").alias("class_id"), F.col("c.text_hash").alias("first_hash")
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, class_id`` for every document; the class is the smallest id of its group."""
    return _classes(docs, doc_id, text).select(F.col("id").alias("doc_id"), "class_id").distinct()


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stand for their class, as they came."""
    kept = _classes(docs, doc_id, text).where("id <=> class_id AND text_hash = first_hash").select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_hash")
    ).distinct()
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_hash"))
    return docs.join(kept, same, "left_semi")
