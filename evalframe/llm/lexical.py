"""Ranked lexical search by scanning documents with one automaton of all query terms.

There is no index of documents. The terms of the items, each between two blanks as guards, are
one Aho-Corasick automaton that is broadcast. A document is folded (A-Z in lower case, every
delimiter a blank), so one scan of its whole text counts how often each term occurs as a whole
word. The first scan counts documents, their terms and each query term's documents; these
sums are one row per task and term. With the weights they give, the second scan scores every
document for every item it shares a term with and keeps each task's best per item; the best
of all tasks are ranked together. No text and no count of a document is shuffled.

Items are dealt into blocks by the bytes of their terms, and a block is one automaton with its
two scans, so what the driver holds and broadcasts is bounded by ``BLOCK_BYTES`` however
many items there are. An item whose own terms are beyond that is cut by the hash of its terms
over several blocks; the parts of its scores are then summed per document before they are
ranked.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z
are lower-cased. Scores are whole numbers, so no order of additions changes them.

Nulls and odd input: a null or empty text has no terms; a document without terms is not counted
and never found. Every row is a document of its own: rows of one ``doc_id`` can each be in a
ranking. A null ``doc_id`` ranks after all others of its score. Rows of one ``item_id`` are one
item whose terms add up, equal rows counted once; items without a term found have no rows.
Long texts are scanned whole. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.tables import written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
#: Bytes of the terms of one automaton, each counted once per item it is in. An automaton takes
#: some 50 bytes per byte in each Python worker.
BLOCK_BYTES = 4_000_000

# Fold of a byte: bytes of characters beyond ASCII stay, so UTF-8 needs no decoding.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_TERM_ID = itemgetter(1)


class _Block:
    """The terms of a block of items, and for each term the items that have it."""

    def __init__(self, rows: list[tuple[int, str, int]]) -> None:
        """``rows``: number of the item, term, and how often the item has it."""
        self.terms = sorted({term for _, term, _ in rows})
        number = {term: k for k, term in enumerate(self.terms)}
        rows = sorted((number[term], item, n) for item, term, n in rows)
        # Postings of term k are those from starts[k] up to starts[k + 1].
        self.items = np.array([item for _, item, _ in rows], np.int64)
        self.times = np.array([n for _, _, n in rows], np.int64)
        self.starts = np.searchsorted(np.array([k for k, _, _ in rows], np.int64), np.arange(len(self.terms) + 1))
        self.numbers = np.unique(self.items)
        self.items = np.searchsorted(self.numbers, self.items)
        self.weights: np.ndarray | None = None
        self.documents = self.all_terms = 0
        self._automaton: ahocorasick.Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    @property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once in each worker from the broadcast terms."""
        if self._automaton is None:
            made = ahocorasick.Automaton()
            for k, term in enumerate(self.terms):
                made.add_word(f" {term} ".encode().decode("latin-1"), k)
            made.make_automaton()
            self._automaton = made
        return self._automaton

    def found(self, text: bytes) -> tuple[int, Counter]:
        """How many terms the text has, and how often each term of the block is among them."""
        guarded = b" " + text.translate(_FOLD) + b" "
        blank = np.frombuffer(guarded, np.uint8) == 32
        n = int(np.count_nonzero(blank[:-1] & ~blank[1:]))
        return n, Counter(map(_TERM_ID, self.automaton.iter(guarded.decode("latin-1")))) if n else Counter()

    def scores(self, n: int, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """The items that share a term with a document of ``n`` terms, and its score for each."""
        m = 100 - 75 + 75 * n * self.documents // self.all_terms
        terms = np.fromiter(found.keys(), np.int64, len(found))
        tf = np.fromiter(found.values(), np.int64, len(found))
        gains = self.weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        begin, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        # The places of all postings of these terms, run after run.
        ends = np.cumsum(size)
        places = np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)
        items, values = self.items[places], np.repeat(gains, size) * self.times[places]
        if len(self.numbers) <= 4 * len(items):
            total = np.zeros(len(self.numbers), np.int64)
            np.add.at(total, items, values)
            hit = np.flatnonzero(total)
            return hit, total[hit]
        order = np.argsort(items, kind="stable")
        hit, at = np.unique(items[order], return_index=True)
        return hit, np.add.reduceat(values[order], at)


def _counts(block: Broadcast):
    """Per task: documents and terms (as term -1) and the documents of each term."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = terms = 0
        df: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                n, found = block.value.found(text.as_py() or b"")
                documents, terms = documents + (n > 0), terms + n
                df.update(found.keys())
        names = ["term", "documents", "terms"]
        yield pa.RecordBatch.from_pydict(
            {"term": [-1, *df], "documents": [documents, *df.values()], "terms": [terms, *[0] * len(df)]},
            pa.schema([(name, pa.int64()) for name in names]),
        )

    return scan


_SCORES = "item bigint, doc_id bigint, print bigint, score bigint"
_SCORE_SCHEMA = pa.schema([(name, pa.int64()) for name in ("item", "doc_id", "print", "score")])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_SCORE_SCHEMA)


def _ranking(block: Broadcast, best: int, partial: frozenset[int]):
    """Per task: each item's best documents; of ``partial`` items every document."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = block.value
        heaps: list[list] = [[] for _ in terms.numbers]
        least = np.zeros(len(terms.numbers), np.int64)  # a score below is not among the best
        whole = np.array([int(x) not in partial for x in terms.numbers], bool)
        for batch in batches:
            parts: list[tuple] = []
            columns = (batch.column("doc_id").to_pylist(), batch.column("print").to_pylist(), batch.column("text"))
            for doc, mark, text in zip(*columns, strict=True):
                n, found = terms.found(text.as_py() or b"")
                if not found:
                    continue
                hit, scores = terms.scores(n, found)
                if partial:
                    cut = ~whole[hit]
                    parts += [(int(terms.numbers[i]), doc, mark, int(s)) for i, s in zip(hit[cut], scores[cut], strict=True)]
                good = np.flatnonzero(whole[hit] & (scores >= least[hit]) & (scores > 0))
                for k in good.tolist():
                    heap = heaps[hit[k]]
                    entry = (int(scores[k]), doc is not None, -(doc or 0))
                    if len(heap) < best:
                        heapq.heappush(heap, entry)
                    else:
                        heapq.heappushpop(heap, entry)
                    if len(heap) == best:
                        least[hit[k]] = heap[0][0]
            if parts:
                yield _batch(parts)
        rows = [(int(terms.numbers[i]), -x if known else None, None, score) for i, heap in enumerate(heaps) for score, known, x in heap]
        if rows:
            yield _batch(rows)

    return scan


def fold(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item, item_id, term, times``; ``item`` is a number for every different item id."""
    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    found = rows.select("item_id", F.explode(F.regexp_extract_all(fold(F.col("text")), F.lit(TERM), F.lit(0))).alias("term"))
    counted = found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))
    return counted.withColumn("item", F.coalesce(F.col("item_id").cast("bigint"), F.lit(-(2**63))))


def _blocks(terms: DataFrame, block_bytes: int) -> DataFrame:
    """Terms with the ``block`` they are in.

    Items smaller than half a block are dealt by their hash, a large one by the hash of its
    terms. The blocks' sizes are checked, and there are as many as keep every block within
    its bound; only a single term may be larger.
    """
    weighed = terms.withColumn("bytes", F.octet_length("term").cast("bigint"))
    size = weighed.groupBy("item").agg(F.sum("bytes").alias("_size"))
    wide = F.col("_size") * 2 > block_bytes
    keyed = written(weighed.join(size, "item").select(
        "item", "term", "times", "bytes", wide.alias("cut"),
        F.when(wide, F.xxhash64("item", "term")).otherwise(F.xxhash64("item")).alias("key"),
    ), "query-terms")
    total = keyed.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    blocks = max(1, math.ceil(2 * (total["bytes"] or 0) / block_bytes))
    while True:
        dealt = keyed.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
        largest = dealt.groupBy("block").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes")).first()[0] or 0
        if largest <= block_bytes or blocks > 64 * total["rows"]:
            return dealt.drop("key")
        blocks *= 2


def rank_documents(
    docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents."""
    spark = docs.sparkSession
    dealt = _blocks(item_terms(items, item_id, item_text), block_bytes)
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).cast("binary").alias("text")
    )
    found: list[DataFrame] = []
    filled = sorted(r[0] for r in dealt.select("block").distinct().collect())
    for number in filled:
        listed = dealt.where(F.col("block") == number).collect()  # bounded by the block's bytes
        block = _Block([(r["item"], r["term"], r["times"]) for r in listed])
        cut = frozenset(r["item"] for r in listed if r["cut"])
        sent = spark.sparkContext.broadcast(block)
        sums = rows.select("text").mapInArrow(_counts(sent), "term bigint, documents bigint, terms bigint")
        told = {r["term"]: r for r in sums.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()}
        sent.destroy()
        if not told or not told[-1]["documents"]:
            break
        block.documents, block.all_terms = told[-1]["documents"], told[-1]["terms"]
        # A term in no document has a weight too, though nothing is scored by it.
        df = [told[k]["documents"] if k in told else 0 for k in range(len(block.terms))]
        block.weights = np.array([math.floor(1000 * math.log((2 * block.documents + 2) / (2 * n + 1))) for n in df], np.int64)
        weighed = spark.sparkContext.broadcast(block)
        scored = rows.mapInArrow(_ranking(weighed, best, cut), _SCORES)
        found.append(written(scored.withColumn("block", F.lit(number)), "lexical-scores"))
        weighed.destroy()
    if not found:
        found.append(spark.createDataFrame([], f"{_SCORES}, block int"))
    scores = reduce(DataFrame.unionByName, found)
    whole = scores.where("print IS NULL").select("item", "doc_id", "score")
    # Parts of an item's score lie in several blocks. Equal rows have equal parts in each.
    alike = scores.where("print IS NOT NULL").groupBy("item", "doc_id", "print", "block").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("rows")
    )
    summed = alike.groupBy("item", "doc_id", "print").agg(F.sum("score").alias("score"), F.max("rows").alias("rows")).where("score > 0")
    summed = summed.select("item", "doc_id", "score", F.explode(F.sequence(F.lit(1), F.least("rows", F.lit(best).cast("bigint")))))
    summed = summed.select("item", "doc_id", "score")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = whole.unionByName(summed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    names = dealt.select("item").distinct()
    return ranked.join(names, "item", "left_semi").select(
        F.when(F.col("item") != -(2**63), F.col("item")).alias("item_id"), "rank", "doc_id", "score"
    )
