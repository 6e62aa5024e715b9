"""A named, ordered set of queries that are run together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.operators.rangefn import over_time, rate_over_time
from telemill.operators.rollup import sum_by

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class RangeQuery:
    """An aggregate of a source's samples over ``(t - outer, t]``, of their rate over ``rate`` if given, summed per ``by``.

    Members of a query set that differ in ``agg`` alone are computed together.
    """

    source: Query
    key: tuple[str, ...]
    agg: str
    outer: str
    step: str
    rate: str | None = None
    by: tuple[str, ...] = ("t",)

    def shared(self) -> RangeQuery:
        return replace(self, agg="")

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.together(spark, path, [self.agg]).select(*self.by, F.col(self.agg).alias("value"))

    def together(self, spark: SparkSession, path: str, aggs: Sequence[str]) -> DataFrame:
        """All of ``aggs``, each as a column."""
        samples, aggs = self.source(spark, path), sorted(set(aggs))
        if self.rate:
            found = rate_over_time(samples, list(self.key), self.rate, self.outer, self.step, aggs)
        else:
            found = over_time(samples, list(self.key), self.outer, self.step, aggs)
        return sum_by(found.select(*self.by, *[F.col(a).cast("double").alias(a) for a in aggs]), self.by, *aggs)


class QuerySet:
    """Queries in order. Results stay lazy: nothing is read until a result is used."""

    def __init__(self, queries: Mapping[str, Query] | None = None):
        self.queries: dict[str, Query] = dict(queries or {})

    @classmethod
    def from_builder(cls, builder: Callable[[], Mapping[str, Query]]) -> QuerySet:
        return cls(builder())

    def run(self, spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
        """The result of every query by name; None when the set is empty."""
        if not self.queries:
            return None
        return {name: query(spark, path) for name, query in self.queries.items()}

    def run_as_one(self, spark: SparkSession, path: str) -> DataFrame | None:
        """All results in one DataFrame with the query's name as a column.

        Range queries that differ in their aggregate alone share one scan and one aggregation.
        """
        if not self.queries:
            return None
        groups: dict[object, list[str]] = {}
        for name, query in self.queries.items():
            groups.setdefault(query.shared() if isinstance(query, RangeQuery) else name, []).append(name)
        return reduce(DataFrame.unionByName, [self._named(spark, path, shared, names) for shared, names in groups.items()])

    def _named(self, spark: SparkSession, path: str, shared: object, names: list[str]) -> DataFrame:
        if not isinstance(shared, RangeQuery):
            return self.queries[names[0]](spark, path).withColumn("query_name", F.lit(names[0]))
        aggs = {name: self.queries[name].agg for name in names}
        wide = shared.together(spark, path, list(aggs.values()))
        each = F.inline(F.array(*[F.struct(F.col(agg).alias("value"), F.lit(name).alias("query_name")) for name, agg in aggs.items()]))
        return wide.select(*shared.by, each)
