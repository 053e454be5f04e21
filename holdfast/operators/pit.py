"""Point-in-time lookups over facts with a period end and a filing date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUARTERLY_FORMS = ("10-K", "10-Q")
ANNUAL_FORMS = ("10-K", "20-F", "40-F")


def accepted(forms: Sequence[str]) -> str:
    names = ", ".join(f"'{form.upper()}'" for form in forms)
    return f"upper(form) IN ({names})"


def available_as_of(facts: DataFrame, as_of: str, forms: Sequence[str] = QUARTERLY_FORMS) -> DataFrame:
    """Facts already filed on ``as_of`` (an ISO date) under an accepted form."""
    return facts.filter(f"filed <= date'{as_of}'").filter(accepted(forms))


def latest_as_of(
    facts: DataFrame, requests: DataFrame, forms: Sequence[str] = QUARTERLY_FORMS
) -> DataFrame:
    """As-of join: per request (entity, tag, as_of), the newest fact filed by then.

    The newest fact is a running maximum over filing dates. It is taken inside calendar
    months and carried across them by a per-month maximum, so one busy entity is sorted
    month by month instead of in a single task and no fact meets a request as a pair.
    """
    keys = ["entity", "tag"]
    found = "struct(period_end, filed, accession, value)"
    shared = facts.filter(accepted(forms)).selectExpr(
        *keys, "filed AS day", "0 AS kind", f"{found} AS fact"
    )
    asked = requests.selectExpr(*keys, "as_of AS day", "1 AS kind", "NULL AS fact")
    events = shared.unionByName(asked).withColumn("month", F.expr("date_trunc('month', day)"))
    earlier = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy(*keys, "month").agg(F.max("fact").alias("best"))
        .withColumn("carried", F.max("best").over(earlier)).drop("best")
    )
    inside = (
        Window.partitionBy(*keys, "month").orderBy("day", "kind")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        events.withColumn("inside", F.max("fact").over(inside))
        .filter("kind = 1")
        .join(carried, [*keys, "month"])
        .selectExpr(*keys, "day AS as_of", "greatest(inside, carried) AS f")
        .selectExpr(*keys, "as_of", "f.period_end", "f.filed", "f.accession", "f.value")
    )


def annual_series_as_of(facts: DataFrame, as_of: str, max_years: int = 10) -> DataFrame:
    """Latest annual fact per fiscal year, newest ``max_years`` years per entity and tag."""
    if max_years <= 0:
        raise ValueError("max_years must be positive")
    yearly = (
        available_as_of(facts, as_of, ANNUAL_FORMS).filter("fiscal_year IS NOT NULL")
        .groupBy("entity", "tag", "fiscal_year")
        .agg(F.expr("max(struct(period_end, filed, accession, value)) AS f"))
    )
    newest = Window.partitionBy("entity", "tag").orderBy(F.col("fiscal_year").desc())
    return (
        yearly.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= max_years)
        .selectExpr("entity", "tag", "fiscal_year", "age", "f.period_end", "f.filed", "f.value")
    )
