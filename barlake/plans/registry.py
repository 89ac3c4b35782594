"""Query registration: one Spark callable and, where SQL can say it, one oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.plans.oracle import with_views
from barlake.session import prepare

# Added before rounding on both sides, so that decimal ties at the last place break the same way.
TIE_BREAK = 3.14159e-8

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None
    keys: tuple[str, ...]
    nums: tuple[str, ...]
    digits: int = 6
    extra: tuple[tuple[str, str], ...] = ()

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(prepare(spark), sf_dir)
        if "day" in self.keys and "day" not in df.columns:
            df = df.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
        return df.select(
            *self.keys, *[(F.round(F.col(n).cast("double") + F.lit(TIE_BREAK), self.digits) + F.lit(0.0)).alias(n) for n in self.nums]
        )

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        nums = [f"ROUND(CAST({n} AS DOUBLE) + {TIE_BREAK}::DOUBLE, {self.digits}) + 0.0::DOUBLE AS {n}" for n in self.nums]
        body = f"SELECT {', '.join([*self.keys, *nums])}\nFROM ({self.sql.strip()}) AS answer"
        return with_views(body, dict(self.extra))


QUERIES: dict[str, Query] = {}


def add(name: str, build: Build, sql: str | None, keys: str = "symbol day", nums: str = "", digits: int = 6, **extra: str) -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name}")
    QUERIES[name] = Query(name, build, sql, tuple(keys.split()), tuple(nums.split()), digits, tuple(extra.items()))
