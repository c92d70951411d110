"""Order of version names, in which runs of digits count as numbers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Column


def natural_key(name: str) -> tuple:
    return tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name))


def natural_order(name: Column) -> Column:
    """The same order on a column: numbers are padded with zeros."""
    parts = F.regexp_extract_all(name, F.lit(r"\d+|\D+"), 0)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(p, 30, "0"))).otherwise(F.concat(F.lit("1"), p)))


def latest_tag(tags: DataFrame) -> DataFrame:
    """One row (tag) from (tag, position): the smallest known position, else the last tag in natural order."""
    return tags.agg(F.coalesce(F.min_by("tag", "position"), F.max_by("tag", natural_order(F.col("tag")))).alias("tag"))
