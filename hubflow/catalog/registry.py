"""Registration of queries and their check statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hubflow.session import configure
from hubflow.sources.samples import Samples, with_views


@dataclass(frozen=True)
class Check:
    build: Callable[[Samples], DataFrame]
    sql: str

    def query(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Samples(configure(spark), sf_dir))

    def statement(self) -> str:
        return with_views(self.sql)


class Catalog(dict[str, Check]):
    def add(self, name: str, sql: str) -> Callable[[Callable[[Samples], DataFrame]], Callable[[Samples], DataFrame]]:
        """Register the decorated function, which builds the query from the sources."""

        def register(build: Callable[[Samples], DataFrame]) -> Callable[[Samples], DataFrame]:
            if name in self:
                raise ValueError(f"query {name} is registered twice")
            self[name] = Check(build, sql)
            return build

        return register
