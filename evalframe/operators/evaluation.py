"""Evaluation: validation, variants, runs, rubric scores, gates and summaries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalframe.session import shared_path

CASE_FIELDS = ("dataset_id", "case_id", "slice", "input", "expected")


@dataclass(frozen=True)
class Variant:
    """A prompt template with ``{field}`` places and literal parameters."""

    variant_id: str
    template: str
    params: Mapping[str, str] = field(default_factory=dict)


def case_violations(raw_cases: DataFrame, fields: Sequence[str] = CASE_FIELDS) -> DataFrame:
    """Violations per case id, from cases with their ``raw`` JSON line.

    All rules are counted in one grouping by id; counts combine before the shuffle and
    no text is shuffled.
    """
    unknown = F.size(F.array_except(
        F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")), F.array(*map(F.lit, fields))
    ))
    counted = raw_cases.groupBy("dataset_id", "case_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("input").isNull() | (F.btrim("input") == "")).alias("empty"),
        F.count_if(F.col("expected").isNull()).alias("unanswered"),
        F.count_if(unknown > 0).alias("strange"),
    )
    rules = F.array(
        F.struct(F.lit("duplicate_case_id").alias("violation"), F.when(F.col("rows") > 1, F.col("rows")).alias("n")),
        F.struct(F.lit("empty_input").alias("violation"), F.nullif("empty", F.lit(0)).alias("n")),
        F.struct(F.lit("missing_expected").alias("violation"), F.nullif("unanswered", F.lit(0)).alias("n")),
        F.struct(F.lit("unknown_field").alias("violation"), F.nullif("strange", F.lit(0)).alias("n")),
    )
    return counted.select("dataset_id", "case_id", F.explode(rules).alias("v")).where(
        F.col("v.n").isNotNull()
    ).select("dataset_id", "case_id", "v.violation", "v.n")


def rendered(template: str, fields: Sequence[str] = CASE_FIELDS, params: Mapping[str, str] | None = None) -> Column:
    """Template as one concat; values are never searched for places again.

    Only ``{name}`` of a known field or parameter is a place; all other braces are text.
    """
    parts, given = [], params or {}
    for n, piece in enumerate(re.split(r"\{(\w+)\}", template)):
        if n % 2 == 0:
            parts.append(F.lit(piece))
        elif piece in given:
            parts.append(F.lit(str(given[piece])))
        elif piece in fields:
            parts.append(F.coalesce(F.col(piece).cast("string"), F.lit("")))
        else:
            parts.append(F.lit(f"{{{piece}}}"))
    return F.concat(*parts)


def variant_matrix(cases: DataFrame, variants: Sequence[Variant], trials: int | None = None) -> DataFrame:
    """Every case under every variant: rows fan out in place, nothing is joined.

    With ``trials`` every prompt comes that many times, numbered from 1 in ``trial``.
    """
    prompts = F.explode(F.array(*[
        F.struct(F.lit(v.variant_id).alias("variant_id"), rendered(v.template, cases.columns, v.params).alias("prompt"))
        for v in variants
    ]))
    matrix = cases.select("dataset_id", "case_id", "slice", "expected", prompts.alias("p")).select(
        "dataset_id", "case_id", "slice", "expected", "p.*"
    )
    if trials is None:
        return matrix
    return matrix.withColumn("trial", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trials).cast("bigint"))))


def run_variants(
    matrix: DataFrame, answer: Callable[[str], str], run_id: str, path: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Apply ``answer`` to every prompt once; errors and latency are data.

    An answer that is not a text is an error too. Prompts spread over ``tasks`` tasks, or
    as many as a shuffle has, however few files the cases came from. The outputs are written
    before they are returned, so later stages and lost executors read them and do not call
    ``answer`` again.
    """
    spark = matrix.sparkSession
    trial = [name for name in ("trial",) if name in matrix.columns]
    given = matrix.select("dataset_id", "case_id", "slice", "variant_id", *trial, "expected", "prompt")
    spread = given.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def execute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            outputs, errors, took = [], [], []
            for prompt in batch["prompt"]:
                begun = time.perf_counter()
                try:
                    said = answer(prompt)
                    if not isinstance(said, str):
                        raise TypeError(f"answer is {type(said).__name__}, not text")
                    outputs.append(said)
                    errors.append(None)
                except Exception as failure:
                    outputs.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
                took.append((time.perf_counter() - begun) * 1_000)
            yield batch.assign(output=outputs, error=errors, latency_ms=took)

    schema = StructType(list(given.schema.fields)).add("output", "string").add("error", "string").add("latency_ms", "double")
    path = path or shared_path(spark, f"outputs-{run_id}")
    spread.mapInPandas(execute, schema).withColumn("run_id", F.lit(run_id)).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rubric_scores(
    outputs: DataFrame, ids: Sequence[str], rubrics: Mapping[str, Column], thresholds: Mapping[str, float] | None = None
) -> DataFrame:
    """Scores in long form with the pass flag of each rubric (threshold 1 by default)."""
    limits = thresholds or {}
    # Scores become columns first, so that each is worked out once for its value and flag.
    wide = outputs.select(*ids, *[score.alias(f"_{i}") for i, score in enumerate(rubrics.values())])
    scored = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("rubric"), F.col(f"_{i}").alias("score"),
            (F.col(f"_{i}") >= F.lit(float(limits.get(name, 1.0)))).alias("passed"),
        )
        for i, name in enumerate(rubrics)
    ]))
    return wide.select(*ids, scored.alias("s")).select(*ids, "s.*")


def composite_gate(
    scores: DataFrame, ids: Sequence[str], weights: Mapping[str, int], thresholds: Mapping[str, float], floor: float
) -> DataFrame:
    """Weighted mean of the rubrics that scored, and whether all gates hold.

    Weights are literals. A null score leaves the weight sum; a rubric below its own
    threshold fails the case, as does a composite below ``floor``. A rubric without a weight
    stops the job, as a mean without it would look whole; give it 0 to leave it out.
    """
    weight, limit = F, F
    for name, w in weights.items():
        weight = weight.when(F.col("rubric") == name, F.lit(w).cast("bigint"))
    unweighted = F.raise_error(F.concat(F.lit("no weight for rubric "), F.coalesce("rubric", F.lit("null")))).cast("bigint")
    weight = weight.otherwise(unweighted) if weights else unweighted
    for name, t in thresholds.items():
        limit = limit.when(F.col("rubric") == name, F.lit(float(t)))
    exact_score = F.col("score").cast("decimal(9,4)")
    weighed = scores.select(
        *ids, "score", exact_score.alias("_s"),
        F.when(F.col("score").isNotNull(), weight).alias("_w"),
        (limit if thresholds else F.lit(None).cast("double")).alias("_limit"),
    )
    summed = weighed.groupBy(*ids).agg(
        F.sum(F.col("_s") * F.col("_w")).cast("double").alias("_total"),
        F.sum("_w").alias("weight"),
        F.count_if(F.col("score") < F.col("_limit")).alias("failed_rubrics"),
        F.count_if(F.col("score").isNull()).alias("unscored"),
    )
    mean = F.try_divide(F.col("_total"), F.col("weight").cast("double"))
    return summed.select(
        *ids, "weight", "failed_rubrics", "unscored", mean.alias("composite"),
        F.coalesce((mean >= floor) & (F.col("failed_rubrics") == 0), F.lit(False)).alias("passed"),
    )


def run_summary(results: DataFrame, pass_at: float) -> DataFrame:
    """n, errors, mean, pass rate and quantiles per run and slice, with subtotals.

    Scores lie on a grid of 10,001 values. Rows are first counted per score, so the
    rollup and the exact percentiles work on that bounded table.
    """
    per_score = results.groupBy("run", "slice", "score").agg(
        F.count(F.lit(1)).alias("c"), F.count("error").alias("e")
    )
    score, c = F.col("score"), F.col("c")
    rolled = per_score.rollup("run", "slice").agg(
        F.grouping_id().alias("_level"),
        F.sum("c").alias("n"),
        F.sum("e").alias("errors"),
        F.sum(score * c).cast("double").alias("_sum"),
        F.sum(F.when(score >= F.lit(pass_at).cast("decimal(6,4)"), c).otherwise(0)).alias("passed"),
        F.percentile(score.cast("double"), [0.5, 0.95], F.when(score.isNotNull(), c).otherwise(0)).alias("_q"),
        F.sum(F.when(score.isNotNull(), c).otherwise(0)).alias("scored"),
    )
    scored = F.col("scored").cast("double")
    return rolled.select(
        F.element_at(F.array(F.lit("run_slice"), F.lit("run"), F.lit("?"), F.lit("all")), (F.col("_level") + 1).cast("int")).alias("level"),
        "run", "slice", "n", "errors", "passed",
        F.try_divide(F.col("_sum"), scored).alias("mean_score"),
        F.try_divide(F.col("passed").cast("double"), scored).alias("pass_rate"),
        F.col("_q")[0].cast("decimal(24,6)").cast("double").alias("p50"),
        F.col("_q")[1].cast("decimal(24,6)").cast("double").alias("p95"),
    )


def label_agreement(predictions: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Confusion counts of a pass verdict against golden labels, per slice.

    ``predictions`` holds (key, slice, passed) and ``labels`` (key, label): the text is
    already reduced to its verdict when the join shuffles.
    """
    joined = predictions.join(labels, key, "left")
    good, said = F.col("label") == 1, F.col("passed")
    counted = joined.groupBy("slice").agg(
        F.count_if(said & good).alias("tp"),
        F.count_if(said & ~good).alias("fp"),
        F.count_if(~said & good).alias("fn"),
        F.count_if(~said & ~good).alias("tn"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
    )
    tp, fp, fn = (F.col(name).cast("double") for name in ("tp", "fp", "fn"))
    return counted.select(
        "*",
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
