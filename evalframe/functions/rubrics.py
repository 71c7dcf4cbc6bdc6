"""Rubrics: column expressions that score an output in [0, 1], null when not scorable."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 10_000


def normalised(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def on_grid(score: Column) -> Column:
    """Score rounded half up to a ten-thousandth, so that sums of scores are exact."""
    return F.floor(score * GRID + 0.5) / F.lit(float(GRID))


def with_normal_forms(df: DataFrame) -> DataFrame:
    """Add normal forms and word sets of ``output`` and ``expected`` as columns.

    As columns they are worked out once per row, however many rubrics read them.
    """
    for name in ("output", "expected"):
        df = df.withColumn(f"{name}_normal", normalised(F.col(name)))
        df = df.withColumn(f"{name}_words", words(F.col(f"{name}_normal")))
    return df


def _verdict(expected: Column, passed: Column) -> Column:
    return F.when(expected.isNotNull(), F.coalesce(passed, F.lit(False)).cast("double"))


def exact(output: Column, expected: Column) -> Column:
    return _verdict(expected, output == expected)


def contains(output: Column, expected: Column) -> Column:
    return _verdict(expected, F.contains(output, expected))


def matches(output: Column, pattern: str) -> Column:
    return F.coalesce(output.rlike(pattern), F.lit(False)).cast("double")


def numeric_close(output: Column, expected: Column, tolerance: float) -> Column:
    want = expected.try_cast("double")
    return _verdict(want, F.abs(output.try_cast("double") - want) <= tolerance)


def length_within(output: Column, low: int, high: int) -> Column:
    return F.coalesce(F.length(output).between(low, high), F.lit(False)).cast("double")


def json_field_equals(output: Column, path: str, expected: Column) -> Column:
    return _verdict(expected, F.get_json_object(output, path) == expected)


def words(normal_text: Column) -> Column:
    """Set of words of a normalised text; null counts as no words."""
    return F.array_remove(F.array_distinct(F.split(F.coalesce(normal_text, F.lit("")), " ")), "")


def token_f1(got: Column, want: Column, expected: Column) -> Column:
    """F1 of two word sets."""
    shared = F.size(F.array_intersect(got, want))
    total = F.size(got) + F.size(want)
    f1 = F.when(total > 0, shared * 2.0 / F.when(total > 0, total)).otherwise(1.0)
    return F.when(expected.isNotNull(), on_grid(f1))


def edit_similarity(output: Column, expected: Column) -> Column:
    """One minus the edit distance over the longer length."""
    got = F.coalesce(output, F.lit(""))
    longest = F.greatest(F.length(got), F.length(expected))
    near = 1 - F.levenshtein(got, expected) / F.when(longest > 0, longest).cast("double")
    return F.when(expected.isNotNull(), on_grid(F.when(longest > 0, near).otherwise(1.0)))


def label_match(output: Column, expected: Column) -> Column:
    return _verdict(expected, normalised(output) == normalised(expected))


def custom(score: Callable[[pd.Series, pd.Series], pd.Series]) -> Callable[[Column, Column], Column]:
    """A user's vectorised rubric; its result is held to [0, 1]."""
    scorer = F.pandas_udf(score, "double")

    def rubric(output: Column, expected: Column) -> Column:
        raw = scorer(output, expected)
        return F.when(raw < 0, 0.0).when(raw > 1, 1.0).otherwise(raw)

    return rubric
