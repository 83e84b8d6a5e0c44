"""Coverage and status reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage(prices: DataFrame, fixtures: DataFrame, spine: DataFrame) -> DataFrame:
    """Per date and bookmaker of the spine: prices and distinct games; what has none counts zero."""
    dated = prices.join(fixtures.select("fixture_id", "date_key"), "fixture_id")
    got = dated.groupBy("date_key", "bookmaker").agg(F.count(F.lit(1)).alias("odds"), F.count_distinct("fixture_id").alias("games"))
    return spine.join(got, ["date_key", "bookmaker"], "left").na.fill(0, ["odds", "games"])


def percent_colour(part: Column, whole: Column) -> Column:
    pct = F.when(whole > 0, F.floor(100 * part / whole + 0.5)).otherwise(0).cast("long")
    colour = F.when(part == 0, "red").when(pct < 50, "yellow").when(pct >= 80, "green").otherwise("white")
    return F.struct(pct.alias("pct"), colour.alias("colour"))


def status(prices: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Per bookmaker and league: games with prices, of how many, in per cent and as a colour."""
    total = fixtures.groupBy("league_id").agg(F.count(F.lit(1)).alias("api_games"))
    games = prices.select("fixture_id", "bookmaker").distinct().join(fixtures.select("fixture_id", "league_id"), "fixture_id")
    got = games.groupBy("bookmaker", "league_id").agg(F.count(F.lit(1)).alias("games")).join(total, "league_id")
    return got.withColumn("_p", percent_colour(F.col("games"), F.col("api_games"))).select("bookmaker", "league_id", "games", "api_games", "_p.pct", "_p.colour")


def node_summary(nodes: DataFrame, kind: str, value: str, most: int = 25) -> DataFrame:
    """Per kind of node: how many, and the first ``most`` distinct values in order (none but nulls: an empty list).

    Values are made distinct by a shuffle and ranked there, each task cutting its
    own rows to the first ``most`` before they meet.
    """
    each = nodes.groupBy(kind, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = each.groupBy(kind).agg(F.sum("_n").alias("n_nodes"))
    rank = F.row_number().over(Window.partitionBy(kind).orderBy(value))
    first = each.filter(F.col(value).isNotNull()).withColumn("_r", rank).filter(F.col("_r") <= most)
    lists = first.groupBy(kind).agg(F.array_sort(F.collect_list(value)).alias("values"))
    empty = F.array().cast(lists.schema["values"].dataType)
    return counts.join(lists, counts[kind].eqNullSafe(lists[kind]), "left").select(counts[kind], "n_nodes", F.coalesce("values", empty).alias("values"))


def league_counts(fixtures: DataFrame, supported: DataFrame) -> DataFrame:
    """Fixtures per league, and whether the league is supported."""
    mark = supported.select("league_id", F.lit(True).alias("supported")).distinct()
    return fixtures.groupBy("league_id").agg(F.count(F.lit(1)).alias("n_fixtures")).join(mark, "league_id", "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def catalog(configured: DataFrame, stored: DataFrame) -> DataFrame:
    """Leagues by state: synced, disabled, missing (configured only), unknown (stored only)."""
    a = configured.select("league_id", F.lit(True).alias("_c")).distinct()
    b = stored.select("league_id", "enabled")
    state = F.when(F.col("enabled").isNull(), "missing").when(F.col("_c").isNull(), "unknown").when(F.col("enabled"), "synced").otherwise("disabled")
    return a.join(b, "league_id", "full_outer").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n_leagues"))


def duration_text(ms: Column) -> Column:
    """``1h 02m``, ``3m 04s`` or ``5s``."""
    s = F.floor(ms / 1000)
    h, m, r = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
