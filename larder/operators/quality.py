"""Quality metrics of matches from sets of ids, their history and snapshot."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.vocabulary import MANY_MISSED_DEALS

METRICS = ("catalog", "on_offer", "matched", "stale", "missed_deals", "new_ids", "gone_matched")


def ids(rows: DataFrame, column: str = "id") -> DataFrame:
    return rows.select(F.col(column).cast("string").alias("id")).where("id IS NOT NULL").distinct()


def matched_ids(recipes: DataFrame) -> DataFrame:
    """Different product ids anywhere in recipes' ingredients. Lists recur with their ingredients, so each is taken apart once."""
    lists = recipes.select(F.explode(F.transform("I", lambda i: i["product_ids"])).alias("x")).distinct()
    return ids(lists.select(F.explode("x").alias("id")))


def id_sets(catalog: DataFrame, offers: DataFrame, matched: DataFrame, previous: DataFrame | None = None) -> dict[str, DataFrame]:
    """stale, missed_deals and, with an earlier catalog, new_ids and gone_matched."""
    out = {"stale": matched.subtract(catalog), "missed_deals": offers.subtract(matched)}
    if previous is not None:
        out["new_ids"] = catalog.subtract(previous)
        out["gone_matched"] = previous.subtract(catalog).intersect(matched)
    return out


def metrics(catalog: DataFrame, offers: DataFrame, matched: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """One row of counts; null for what needs an earlier catalog and there is none.

    All sets are flags of one full aggregation by id, so each id is shuffled once.
    """
    flagged = [x.select("id", F.lit(n).alias("s")) for n, x in (("c", catalog), ("o", offers), ("m", matched), ("p", previous)) if x is not None]
    rows = flagged[0]
    for x in flagged[1:]:
        rows = rows.union(x)
    has = {n: F.max(F.col("s") == n).alias(n) for n in "comp"}
    per_id = rows.groupBy("id").agg(*has.values())
    c, o, m, p = (F.col(n) for n in "comp")
    counts = {"catalog": c, "on_offer": o, "matched": m, "stale": m & ~c, "missed_deals": o & ~m, "new_ids": c & ~p, "gone_matched": p & ~c & m}
    out = per_id.agg(*(F.count_if(v).alias(n) for n, v in counts.items()))
    if previous is None:
        out = out.withColumns({n: F.lit(None).cast("bigint") for n in ("new_ids", "gone_matched")})
    return out


def sample(stale: DataFrame, n: int = 10) -> DataFrame:
    """The first ids in order, for a report."""
    return stale.orderBy("id").limit(n)


def run_gate(spark: SparkSession, catalog: DataFrame, offers: DataFrame, matched: DataFrame, history: str, snapshot: str, day: date | None = None) -> dict:
    """Compute the metrics, append them to the history, then replace the snapshot of catalog ids.

    The earlier snapshot is a numbered folder beside the new one, which is written whole before it counts, so no path is
    overwritten while it is read. Returns the metrics with the report's flags; never raises for stale ids.
    """
    from larder.sources.tables import read_snapshot, write_snapshot

    previous = read_snapshot(spark, snapshot)
    row = metrics(catalog, offers, matched, previous).first().asDict()
    day = day or date.today()
    spark.createDataFrame([(day, *(row[m] for m in METRICS))], "date date, " + ", ".join(f"{m} long" for m in METRICS)).write.mode("append").parquet(history)
    write_snapshot(catalog.orderBy("id"), snapshot)
    stale = [r.id for r in sample(id_sets(catalog, offers, matched)["stale"]).collect()]
    return row | {"date": day.isoformat(), "stale_sample": stale, "error": bool(row["stale"]), "warning": row["missed_deals"] > MANY_MISSED_DEALS}


def summary(result: dict) -> str:
    """A table of the metrics in Markdown."""
    lines = ["| metric | value |", "| --- | --- |", *(f"| {m} | {'' if result[m] is None else result[m]} |" for m in METRICS)]
    return "\n".join(lines) + "\n"


def outputs(result: dict) -> str:
    """key=value lines."""
    return "".join(f"{m}={'' if result[m] is None else result[m]}\n" for m in METRICS)
