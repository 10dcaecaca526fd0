"""Reports and runs: markdown tables, facts about an engine, resumable steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def markdown(df: DataFrame, title: str, most: int = 500) -> str:
    """A small table as markdown; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    body = [" | ".join(["", *map(cell, r), ""]).strip() for r in rows]
    return "\n".join([f"## {title}", "", f"| {' | '.join(df.columns)} |", "|" + "-|" * len(df.columns), *body, ""])


def facts(params, engine: str, df: DataFrame) -> dict:
    """An engine's options and its plan."""
    return {"engine": engine, "options": asdict(params), "plan": df._jdf.queryExecution().executedPlan().toString()}


def steps(todo: list[tuple[str, Callable[[], None]]], done: Callable[[str], bool]) -> list[tuple[str, str]]:
    """Runs the steps in order, skipping those whose result is there; stops at the first that fails."""
    log = []
    for name, run in todo:
        if done(name):
            log.append((name, "skipped"))
            continue
        try:
            run()
        except Exception as e:
            log.append((name, f"failed: {e}"))
            break
        log.append((name, "done"))
    return log


def by_size(points: DataFrame, sizes: list[int]) -> DataFrame:
    """One row a target, a column of the best quality for each codebook size."""
    return points.groupBy("target").pivot("entries", sizes).agg(F.max("quality"))
