"""Expressions as text, in stages that name intermediate values.

A stage maps new column names to SQL that both Spark and other engines read. Stages become projections on top of each other;
Catalyst leaves a projection in place where a value that is not cheap is used more than once, so each value is computed once
and the generated code stays small.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = dict[str, str]


def apply(df: DataFrame, stages: list[Stage], keep: list[str] | None = None) -> DataFrame:
    """``df`` with the stages' columns; with ``keep`` only its own and these. Columns of ``df`` that are named like a stage's value are
    set aside meanwhile; one that is named like a kept value is an error."""
    own = df.columns
    made = {n.lower() for s in stages for n in s}
    wanted = made if keep is None else {k.lower() for k in keep}
    if same := [c for c in own if c.lower() in wanted]:
        raise ValueError(f"the table already has {', '.join(same)}")
    aside = {c: f"__aside_{k}" for k, c in enumerate(own) if c.lower() in made}
    if aside:
        df = df.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in own])
    for s in stages:
        df = df.select("*", *[F.expr(e).alias(n) for n, e in s.items()])
    return df if keep is None else df.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in own], *[F.col(k) for k in keep])


def as_sql(table: str, stages: list[Stage], keep: list[str] | None = None) -> str:
    """The same as a query."""
    for k, s in enumerate(stages):
        table = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in s.items())} FROM {table} AS s{k})"
    return f"SELECT {', '.join(keep) if keep else '*'} FROM {table} AS stages"


def as_expression(stages: list[Stage], inputs: list[str], out: str) -> str:
    """One value of the stages as an expression over ``inputs``. Each stage is the body of a lambda over a struct of the values that it
    and later ones need, so each value is computed once here too. (After the keyword ARRAY the parser takes ``>>`` for the ends of types.)"""
    needs = {out}
    wanted = [needs]
    for s in reversed(stages):
        words = {w for n, e in s.items() if n in needs for w in re.findall(r"\b[A-Za-z_]\w*", e)}
        needs = (needs - set(s)) | words
        wanted.insert(0, needs)
    known = [n for n in inputs if n in wanted[0]]
    text = "named_struct({})".format(", ".join(f"'{n}', {n}" for n in known))
    for k, s in enumerate(stages):
        bound = re.compile(rf"\b({'|'.join(known)})\b")
        values = {n: f"v{k}.{n}" for n in known if n in wanted[k + 1]} | {n: bound.sub(rf"v{k}.\1", e) for n, e in s.items() if n in wanted[k + 1]}
        text = "transform(array_repeat({}, 1), v{} -> named_struct({}))[0]".format(text, k, ", ".join(f"'{n}', {e}" for n, e in values.items()))
        known = list(values)
    return f"{text}.{out}"
