"""Estimators and oracle builders by name, and row-making operators as SQL table functions (2.15).

A table of the registry maps a name to a callable that takes and returns DataFrames; ``module:function`` names one that
is imported when it is asked for. Table functions make several rows of one and are called from SQL, in a lateral join.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from spindrift.functions import tokens as tk
from spindrift.operators import advantages as adv
from spindrift.operators import rewards as rw
from spindrift.sources.records import flatten_container


class Registry:
    """Callables by name, with the columns that each needs."""

    def __init__(self, kind: str):
        self.kind, self.entries, self.needs = kind, {}, {}

    def register(self, name: str, needs: tuple[str, ...] = ()) -> Callable:
        """A decorator that adds a callable; a name may be registered once."""

        def add(f: Callable) -> Callable:
            if name in self.entries:
                raise ValueError(f"there is a {self.kind} {name!r} already")
            self.entries[name], self.needs[name] = f, needs
            return f

        return add

    def get(self, name: str) -> Callable:
        if ":" in name:
            module, _, attribute = name.partition(":")
            found = getattr(import_module(module), attribute, None)
            if not callable(found):
                raise TypeError(f"{name!r} names no callable")
            return found
        if name not in self.entries:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self.entries))}")
        return self.entries[name]

    def run(self, name: str, df: DataFrame, **settings) -> DataFrame:
        """The entry's result for df, whose columns are checked first."""
        f = self.get(name)
        if absent := [c for c in self.needs.get(name, ()) if c not in df.columns]:
            raise ValueError(f"{self.kind} {name!r} needs columns {', '.join(absent)}")
        return f(df, **settings)


estimators = Registry("estimator")
builders = Registry("oracle builder")
GROUPED = ("uid", "row_id", "reward")
MASKED = ("reward_tokens", "mask")


@estimators.register("grpo", GROUPED)
def _(df: DataFrame, **settings) -> DataFrame:
    """Group-relative advantages."""
    return adv.grpo(df, **settings)


@estimators.register("rloo", GROUPED)
def _(df: DataFrame) -> DataFrame:
    """Each reward against the mean of the others of its group."""
    return adv.leave_one_out(df)


@estimators.register("gae", (*MASKED, "value_tokens"))
def _(df: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantages of each row's own tokens (G23), not whitened."""
    return df.withColumn("advantages", tk.gae(F.col("reward_tokens"), F.col("value_tokens"), F.col("mask"), gamma, lam))


@estimators.register("reinforce_plus_plus", MASKED)
def _(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Discounted returns of each row (G21), not whitened."""
    return df.withColumn("returns", tk.discounted_returns(F.col("reward_tokens"), F.col("mask"), gamma))


@estimators.register("remax", (*MASKED, "baseline"))
def _(df: DataFrame) -> DataFrame:
    """The sum of rewards over a baseline, spread over the mask."""
    gain = tk.masked_sum(F.col("reward_tokens"), F.col("mask")) - F.col("baseline")
    return df.withColumn("advantages", tk.spread(gain, F.col("mask")))


@builders.register("from_ground_truth", ("family", "item"))
def _(df: DataFrame) -> DataFrame:
    """Responses that win by their ground truth."""
    return rw.build_oracles(df)


# Table functions


@udtf(returnType="id string, query string, start double, stop double")
class ExpandSpans:
    """``expand_spans(video, queries, spans)``: a row for each query and span of a video."""

    def eval(self, video: str, queries: list, spans: list) -> Iterator[tuple]:
        if len(queries) != len(spans):
            raise ValueError("queries and spans differ in number")
        for n, (query, span) in enumerate(zip(queries, spans, strict=True)):
            yield f"{video}:{n:06d}", query, float(span[0]), float(span[1])


@udtf(returnType="ordinal long, record string")
class ContainerRecords:
    """``container_records(text)``: the records of one JSON container in a column."""

    def eval(self, text: str) -> Iterator[tuple]:
        for ordinal, record in enumerate(flatten_container(text) if text else ()):
            yield ordinal, json.dumps(record, ensure_ascii=False, sort_keys=True)


TABLE_FUNCTIONS = {"expand_spans": ExpandSpans, "container_records": ContainerRecords}


def register_table_functions(spark: SparkSession) -> None:
    """Make the table functions known to a session's SQL."""
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)

