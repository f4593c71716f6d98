"""Step-by-step enrichment of the findings array held in each document row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docplan.functions import spans as S

Field = Callable[[str], str]


class Findings:
    """An array-of-structs column, enriched field by field.

    Each step is one narrow projection, so Catalyst resolves it on its own
    instead of facing one deeply nested lambda for the whole analysis.
    """

    def __init__(self, df: DataFrame, column: str, expression: str, fields: str):
        self.df = df.selectExpr("*", f"{expression} as {column}")
        self.column = column
        self.fields = fields.split()

    def _set(self, expression: str) -> Findings:
        self.df = self.df.withColumn(self.column, F.expr(expression))
        return self

    def add(self, **fields: Field) -> Findings:
        names = [f for f in self.fields if f not in fields]

        def build(x: str) -> str:
            kept = {f: f"{x}.{f}" for f in names}
            return S.struct(**kept, **{f: make(x) for f, make in fields.items()})

        self.fields = names + list(fields)
        return self._set(S.transform(self.column, build))

    def keep(self, condition: Field) -> Findings:
        return self._set(S.keep(self.column, condition))

    def only(self, names: str) -> Findings:
        self.fields = names.split()
        return self._set(
            S.transform(self.column, lambda x: S.struct(**{f: f"{x}.{f}" for f in self.fields}))
        )

    def replace(self, expression: str, fields: str) -> Findings:
        self.fields = fields.split()
        return self._set(expression)


def table_of(docs: DataFrame, column: str, *keys: str, position: str | None = None) -> DataFrame:
    """One row per finding: ``keys``, the fields of the struct, and its position.

    An inner explode of a computed column makes Catalyst infer a non-empty
    filter, which it pushes below the projection together with a second copy of
    the whole analysis. An outer explode does not; empty rows are dropped after.
    """
    rows = docs.selectExpr(*keys, f"posexplode_outer({column}) as (_pos, _f)")
    kept = rows.where("_pos IS NOT NULL")
    return kept.selectExpr(*keys, *([f"_pos as {position}"] if position else []), "_f.*")
