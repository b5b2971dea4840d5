"""Checks as a table of constraints: rows in one pass, references by an anti join each, repeats by a count; tallies with a share to reach."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Holds:
    """What each row keeps where ``applies``; a check that comes out null fails. ``share``: of the rows checked, how many must keep it."""

    name: str
    check: Column
    applies: Column | None = None
    share: float = 1.0

    def checked(self) -> Column:
        return F.lit(True) if self.applies is None else F.coalesce(self.applies, F.lit(False))

    def failed(self) -> Column:
        return self.checked() & ~F.coalesce(self.check, F.lit(False))


@dataclass(frozen=True)
class Refers:
    """``columns`` are found in ``columns_there`` of ``there``; rows where one of them is null refer to nothing and pass."""

    name: str
    columns: tuple[str, ...]
    there: DataFrame
    columns_there: tuple[str, ...]


@dataclass(frozen=True)
class Once:
    """``columns`` tell rows apart; rows with a null among them are passed over."""

    name: str
    columns: tuple[str, ...]


Constraint = Holds | Refers | Once


def _whole(columns: Sequence[str]) -> Column:
    return ~F.greatest(*(F.col(c).isNull() for c in columns), F.lit(False))


def problems(rows: DataFrame, ids: Sequence[str], constraints: Sequence[Constraint]) -> DataFrame:
    """(ids..., problem): one row for each row of the table and constraint it breaks; a repeat is told once for each value, with its least ids.

    All ``Holds`` are looked at in one pass without a shuffle; each ``Refers`` is an anti join with the distinct values
    there; each ``Once`` is a count that is combined before its shuffle. No constraint or no row: no problem.
    """
    ids = list(ids)
    rules = [c for c in constraints if isinstance(c, Holds)]
    found = F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(c.failed(), F.lit(c.name)) for c in rules)))
    out = rows.select(*ids, F.explode(found).alias("problem"))
    for c in constraints:
        if isinstance(c, Refers):
            there = c.there.select(*(F.col(b).alias(f"_r{i}") for i, b in enumerate(c.columns_there))).distinct()
            asked = rows.where(_whole(c.columns)).select(*ids, *(F.col(a).alias(f"_r{i}") for i, a in enumerate(c.columns)))
            lost = asked.join(there, [f"_r{i}" for i in range(len(c.columns))], "left_anti")
            out = out.unionByName(lost.select(*ids, F.lit(c.name).alias("problem")))
        elif isinstance(c, Once):
            asked = rows.where(_whole(c.columns)).select(F.struct(*ids).alias("_id"), *(F.col(a).alias(f"_r{i}") for i, a in enumerate(c.columns)))
            twice = asked.groupBy(*(f"_r{i}" for i in range(len(c.columns)))).agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
            out = out.unionByName(twice.select("_id.*", F.lit(c.name).alias("problem")))
    return out


def _metrics(rules: Sequence[Holds]) -> list[Column]:
    each = lambda x, name: F.count(F.when(x, F.lit(1))).alias(name)
    return [m for i, c in enumerate(rules) for m in (each(c.checked(), f"checked{i}"), each(c.failed(), f"failed{i}"))]


def tally(rows: DataFrame, rules: Sequence[Holds], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., name, checked, failed, passed): all rules in one aggregate; a rule passes where ``share`` of the rows checked keep it, and where none was checked."""
    counted = rows.groupBy(*keys).agg(*_metrics(rules))
    told = [F.struct(F.lit(c.name).alias("name"), F.col(f"checked{i}").alias("checked"), F.col(f"failed{i}").alias("failed"), (F.col(f"checked{i}") - F.col(f"failed{i}") >= F.lit(c.share) * F.col(f"checked{i}")).alias("passed")) for i, c in enumerate(rules)]
    return counted.select(*keys, F.inline(F.array(*told)))


def observed(rows: DataFrame, rules: Sequence[Holds], name: str = "constraints") -> tuple[DataFrame, Observation]:
    """``rows`` as they are, and an observation that holds checked<i> and failed<i> of rule i once a job has gone over them: checks that cost no pass of their own."""
    seen = Observation(name)
    return rows.observe(seen, *_metrics(rules)), seen


def broken(seen: Observation, rules: Sequence[Holds]) -> list[str]:
    """Names of the rules that the rows of an observation did not keep; waits for the job."""
    got = seen.get
    return [c.name for i, c in enumerate(rules) if got[f"checked{i}"] - got[f"failed{i}"] < c.share * got[f"checked{i}"]]
