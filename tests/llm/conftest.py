import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from llm_support import ODD, SMALL


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("d", "t", "h", "w", "v", "u", "part", "doc", "lows", "chunk", "kept", "score", "made", "item_id"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")
