"""Building small shops for the tests, and reading frames back."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from shoplytic.schema import SCHEMAS, Tables


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df) -> list[dict]:
    return [row.asDict() for row in df.collect()]


def frame(spark, name: str, records: list[dict]):
    """A table's frame from partial records; columns left out are null."""
    schema = SCHEMAS[name]
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}

    def value(record, column):
        given = record.get(column)
        if given is not None and kinds[column] == "decimal":
            return Decimal(str(given))
        if given is not None and kinds[column] == "date":
            return day(given)
        return given

    return spark.createDataFrame(
        [tuple(value(r, f.name) for f in schema.fields) for r in records], schema
    )


def shop(spark, **tables: list[dict]) -> Tables:
    return Tables(**{name: frame(spark, name, tables.get(name, [])) for name in SCHEMAS})


AS_OF = day("2025-01-01")
