"""op3: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import html_text
from .common import table


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
