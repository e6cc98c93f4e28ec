"""Launch callbacks: JSON bodies with an address and an application id, both required strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("address", "application_id")


def parse_callbacks(rows: DataFrame, body: str) -> DataFrame:
    """Other columns plus ``address``, ``application_id`` and ``accepted``; a bad body keeps its row.

    A number or an object isn't a string, so it doesn't pass for one.
    """
    parsed = rows.withColumn("_body", F.try_parse_json(F.col(body)))
    for field in FIELDS:
        value = f"try_variant_get(_body, '$.{field}', 'variant')"
        text = f"CASE WHEN schema_of_variant({value}) = 'STRING' THEN try_variant_get(_body, '$.{field}', 'string') END"
        parsed = parsed.withColumn(field, F.expr(text))
    return parsed.withColumn("accepted", F.expr(" AND ".join(f"{f} IS NOT NULL" for f in FIELDS))).drop("_body", body)
