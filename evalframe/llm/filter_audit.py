"""How five filters interact: what each removes in every order, and its Shapley share.

A document is reduced to the set of filters it fails, five bits, and documents are counted per
part and set. For a coalition of filters the removal game's value is the number of documents
that fail any of them. Hart and Mas-Colell's potential of a coalition is its value plus the
potentials without each of its filters, over its size; a filter's Shapley share is the
potential of all filters less that without it. Potentials are kept 120-fold, which makes
them whole numbers. Every step of every order is a difference of two coalitions' values.

The text itself never shuffles: a text is its SHA-256. Copies of one text in one part with the
same labels are one row with a count before texts meet, so a text that a third of the rows
share costs a row per part. What comes out has 600 rows per part.

Nulls and odd input: a null text is an empty one, a null part the empty string. A row without
``doc_id`` has no label, makes no other row a copy and is none. Rows with one ``doc_id`` are
documents of their own, and not copies of each other; several labels of one ``doc_id`` count
as good or toxic if one of them says so. Long texts are judged whole. An empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm.quality import words_of
from evalframe.llm.tables import written

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
_ALL = (1 << len(FILTERS)) - 1
#: Orders of all filters; potentials are kept as many fold.
ORDERS = 120
_COPY = 1 << FILTERS.index("E")


def own_failures(text: Column, words: Column) -> Column:
    """The filters that a text fails by itself, as bits: all but ``E``."""
    n = F.size(words)
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = (
        n < MIN_WORDS,
        F.size(F.array_distinct(words)) * 100 < n * MIN_DISTINCT_PERCENT,
        capitals.cast("bigint") * 100 > F.length(text) * MAX_CAPITAL_PERCENT,
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(fail, 1 << bit).otherwise(0) for bit, fail in enumerate(fails)), F.lit(0))


def _flags(labels: DataFrame, doc_id: str) -> DataFrame:
    says = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False)))
    return labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        says("quality").alias("good"), says("toxic").alias("toxic")
    )


def failure_counts(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """``part, fails, n, good, toxic``: documents of a part that fail exactly these filters."""
    body = docs.select(
        F.col(doc_id).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text), F.lit("")).alias("body"),
    ).withColumn("words", words_of(F.col("body")))
    told = body.select(
        "id", "part", F.unhex(F.sha2("body", 256)).alias("print"), own_failures(F.col("body"), F.col("words")).alias("own")
    )
    # Repeated rows combine in the map tasks, before anything meets by id.
    rows = told.groupBy("id", "part", "print", "own").agg(F.count(F.lit(1)).alias("n"))
    marked = rows.join(_flags(labels, doc_id), "id", "left").withColumns({
        name: F.coalesce(name, F.lit(False)) for name in ("good", "toxic")
    })
    known = F.col("id").isNotNull()
    # Written, as two groupings read it and the texts are to be judged once.
    alike = written(marked.groupBy("print", "own", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(known, F.struct("id", "n"))).alias("first"),
    ), "alike-texts")
    # Of one text, the rows with the smallest id of the whole table are no copies.
    least = alike.groupBy("print").agg(F.min("first.id").alias("least"), F.sum("with_id").alias("copies"))
    told_apart = alike.join(least.where("copies > 1").select("print", "least"), "print", "left")
    firsts = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    copies = F.when(F.col("least").isNull(), 0).otherwise(F.col("with_id") - firsts)
    split = told_apart.select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct((F.col("own") + _COPY).alias("fails"), copies.cast("bigint").alias("n")),
            F.struct(F.col("own").alias("fails"), (F.col("n") - copies).cast("bigint").alias("n")),
        )).alias("x"),
    ).select("part", "good", "toxic", "x.*").where("n > 0")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return split.groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def _values(counted: Column, measure: str) -> Column:
    """For each of the 32 coalitions the documents that fail any of its filters."""
    def value(coalition: Column) -> Column:
        return F.aggregate(
            counted, F.lit(0).cast("bigint"),
            lambda total, x: total + F.when(x["fails"].bitwiseAND(coalition) != 0, x[measure]).otherwise(0),
        )

    return F.transform(F.sequence(F.lit(0), F.lit(_ALL)), value)


def potentials(values: Column) -> Column:
    """The potential of each coalition, ``ORDERS`` fold, from those of one filter less.

    A coalition's number is above those of all its parts, so one walk in order meets every
    part before the whole.
    """
    bits = F.array(*[F.lit(1 << bit) for bit in range(len(FILTERS))])

    def next_potential(done: Column, coalition: Column) -> Column:
        less = F.aggregate(
            bits, F.lit(0).cast("bigint"),
            lambda total, bit: total + F.when(coalition.bitwiseAND(bit) != 0, F.get(done, coalition.bitwiseXOR(bit))).otherwise(0),
        )
        whole = (F.get(values, coalition) * ORDERS + less) / F.bit_count(coalition)
        return F.concat(done, F.array(whole.cast("bigint")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_ALL)), F.array(F.lit(0).cast("bigint")), next_potential)


def _steps() -> Column:
    """Every step of every order: the filter and the coalition that went before."""
    steps = [
        {"filter_order": "".join(order), "step": k + 1, "bit": 1 << FILTERS.index(order[k]),
         "before": sum(1 << FILTERS.index(x) for x in order[:k])}
        for order in permutations(FILTERS) for k in range(len(order))
    ]
    return F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>"))


def audit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source"
) -> DataFrame:
    """One row per part, order of the filters and step."""
    counted = failure_counts(docs, labels, doc_id, text, part)
    parts = counted.groupBy("part").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("counted")
    )
    games = parts.select("part", "total", *[_values(F.col("counted"), name).alias(name) for name in ("n", "good", "toxic")])
    played = games.withColumn("potential", potentials(F.col("n")))
    bit, before = F.col("s.bit"), F.col("s.before")
    after = before.bitwiseOR(bit)
    gain = lambda name: F.get(name, after) - F.get(name, before)
    without = F.lit(_ALL).bitwiseXOR(bit)
    return played.select("*", _steps().alias("s")).select(
        "part", "s.filter_order", "s.step",
        (F.col("total") - F.get("n", after)).alias("kept"),
        gain("n").alias("removed"),
        (F.get("n", bit) - gain("n")).alias("redundant"),
        (F.get("n", F.lit(_ALL)) - F.get("n", without)).alias("unique_fails"),
        gain("good").alias("good_lost"),
        gain("toxic").alias("toxic_lost"),
        (F.get("potential", F.lit(_ALL)) - F.get("potential", without)).alias("shapley"),
    )
