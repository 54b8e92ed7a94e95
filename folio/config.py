"""Settings of an analysis, from defaults, a JSON file and the command line."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import SparkSession

from folio.plans.windows import window_rows


@dataclass(frozen=True)
class Config:
    """One run's settings; a run never changes them."""

    start_year: int = 1988
    end_year: int = 2025
    spans: tuple[int, ...] = (25, 20, 15, 10, 5)
    impute_within: int | None = 2
    recent: tuple[int, int] = (2021, 2025)
    sample_size: int = 200
    seed: int = 1

    def windows(self) -> list[tuple[str, int, int]]:
        return window_rows(self.start_year, self.end_year, self.spans)

    def with_values(self, **values) -> Config:
        """The same settings but for those given; unknown names are an error, nulls keep what is."""
        known = {f.name for f in fields(self)}
        if wrong := set(values) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(wrong))}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if v is not None})

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def load(spark: SparkSession, path: str | None) -> Config:
    """Settings of a JSON file that Spark can read; without one the defaults."""
    if path is None:
        return Config()
    return Config().with_values(**json.loads(spark.read.text(path, wholetext=True).first()[0]))
