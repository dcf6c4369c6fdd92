"""Registry of checked queries: a Spark callable and, where SQL can say it, an oracle.

``columns`` is the output contract, ``name:kind`` per column. Both sides are cast by
it, so a hash compares like with like: ``s`` text, ``d`` date, ``t`` exchange
wall-clock, ``i`` bigint, ``b`` boolean, ``fN`` double rounded to N places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from workload.views import Tables, oracle_ctes


@dataclass(frozen=True)
class Case:
    name: str
    columns: str
    run: Callable[[Tables], DataFrame]
    sql: str | None
    views: tuple[str, ...]
    steps: tuple[tuple[str, str], ...]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shape(self.run(Tables(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        parts = [oracle_ctes(self.views)] if self.views else []
        parts += [f"{name} as materialized ({body.strip()})" for name, body in self.steps]
        head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
        return head + shape_sql(self.sql, self.columns)


CASES: dict[str, Case] = {}


def case(name: str, columns: str, sql: str | None = None, views: tuple[str, ...] = (), steps: tuple[tuple[str, str], ...] = ()):
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in CASES:
            raise ValueError(f"duplicate case {name}")
        CASES[name] = Case(name, columns, fn, sql, tuple(views), tuple(steps))
        return fn

    return register


def _kinds(columns: str) -> list[tuple[str, str]]:
    return [tuple(item.rsplit(":", 1)) for item in columns.split()]


def shape(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _kinds(columns):
        c = F.col(name)
        if kind in ("s", "d", "t"):
            if kind == "d":
                c = c.cast("date")
            if kind == "t":
                c = c.cast("timestamp_ntz")
            c = c.cast("string")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        else:
            held = df.schema[name].dataType
            # The double nearest to a decimal of so few places is its own rounding.
            rounded = isinstance(held, DecimalType) and held.scale <= int(kind[1:])
            c = (c.cast("double") if rounded else F.round(c.cast("double"), int(kind[1:]))) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _kinds(columns):
        c = f'"{name}"'
        if kind == "d":
            c = f"cast({c} as date)"
        if kind == "t":
            c = f"cast({c} as timestamp)"
        if kind in ("s", "d", "t"):
            c = f"cast({c} as varchar)"
        elif kind == "i":
            c = f"cast({c} as bigint)"
        elif kind == "b":
            c = f"cast({c} as boolean)"
        else:
            c = f"round(cast({c} as double), {int(kind[1:])}) + 0.0"
        out.append(f'{c} as "{name}"')
    return f"select {', '.join(out)} from ({sql.strip()}) as answer"
