"""Stages of a run: what each gave, how long it took, and how it failed."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

RESULTS = "stage string, success boolean, fatal boolean, elapsed_ms double, cache_hit boolean, provider string, confidence double, warnings array<string>, errors array<string>"


@dataclass(frozen=True)
class StageResult:
    stage: str
    success: bool = True
    data: Any = None
    warnings: tuple[str, ...] = ()
    errors: tuple[tuple[bool, str], ...] = field(default=())  #: (fatal, message)
    confidence: float = 1.0
    elapsed_ms: float = 0.0
    cache_hit: bool = False
    provider: str | None = None

    @property
    def fatal(self) -> bool:
        return any(f for f, _ in self.errors)

    def ok(self, data: Any, **more) -> StageResult:
        return StageResult(self.stage, True, data, **more)

    def fail(self, message: str, fatal: bool = True, **more) -> StageResult:
        return replace(self, success=False, errors=(*self.errors, (fatal, message)), **more)


def run_stage(stage: str, work: Callable[[], Any], provider: str | None = None, cache_hit: bool = False) -> StageResult:
    """Result of work() with its time; an exception becomes a fatal error and is not raised. A
    DataFrame is lazy: let work() write it if the time and failures of its rows are to count."""
    start = time.perf_counter()
    own = StageResult(stage, provider=provider, cache_hit=cache_hit)
    try:
        own = replace(own, data=work())
    except Exception as e:  # noqa: BLE001  whatever a provider raises is the stage's failure
        own = own.fail(str(e))
    return replace(own, elapsed_ms=(time.perf_counter() - start) * 1000)


def results_table(spark: SparkSession, results: list[StageResult]) -> DataFrame:
    """One row a stage, for timing roll-ups; a run has a handful."""
    rows = [(r.stage, r.success, r.fatal, r.elapsed_ms, r.cache_hit, r.provider, r.confidence, list(r.warnings), [m for _, m in r.errors]) for r in results]
    return spark.createDataFrame(rows, RESULTS)
