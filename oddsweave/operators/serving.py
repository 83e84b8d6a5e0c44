"""Serving views: status, fixtures with prices, snapshot, feed.  ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsweave.functions.rules import clean_source_url
from oddsweave.operators.writepath import first_by


def upcoming(fixtures: DataFrame, leagues: DataFrame, as_of: Column) -> DataFrame:
    """Fixtures of enabled leagues that have not begun, with the league's columns and the later of both versions."""
    dim = leagues.filter("enabled").withColumnRenamed("updated_at", "league_updated_at")
    return fixtures.filter(F.col("starts_at") > as_of).join(dim, "league_id").withColumn("fixture_updated_at", F.greatest("updated_at", "league_updated_at")).drop("updated_at", "league_updated_at")


def with_prices(fixtures: DataFrame, prices: DataFrame, market: str = "1X2") -> DataFrame:
    """Fixtures for which a price of the market exists."""
    return fixtures.join(prices.filter(F.col("market_code") == market).select("fixture_id"), "fixture_id", "left_semi")


def status(fixtures: DataFrame, leagues: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """One row always: latest versions (null without rows) and counts."""
    games = with_prices(upcoming(fixtures, leagues, as_of), prices)
    a = games.agg(F.max("fixture_updated_at").alias("fixtures_version"), F.count(F.lit(1)).alias("upcoming_fixture_count"))
    version = F.max(F.greatest("updated_at", "last_seen_at"))
    b = prices.join(games.select("fixture_id"), "fixture_id", "left_semi").agg(version.alias("odds_version"), F.count(F.lit(1)).alias("odd_count"))
    # Both sides are one row.
    return a.join(b, F.lit(True)).select("fixtures_version", "odds_version", F.col("odds_version").alias("latest_odd_updated_at"), F.col("odds_version").alias("latest_odd_seen_at"), "upcoming_fixture_count", "odd_count")


def latest_links(links: DataFrame) -> DataFrame:
    """Per fixture and bookmaker the newest link that has an address, cleaned."""
    newest = first_by(links.filter("source_url IS NOT NULL"), ["fixture_id", "bookmaker"], F.col("updated_at").desc(), F.col("external_event_id"))
    return newest.select("fixture_id", "bookmaker", clean_source_url(F.col("bookmaker").cast("string"), F.col("source_url")).alias("source_url"))


#: Columns of a price in the order that rows of one bookmaker are sorted by.
_PRICE = ("market_code", "pa_category", "selection", "source_odd_id", "market_name", "price", "confidence_score", "updated_at", "last_seen_at")


def _collected(rows: DataFrame, bookmakers: DataFrame, links: DataFrame, market: str) -> DataFrame:
    """Per fixture all prices of known bookmakers as one JSON array in a fixed order, and ``_priced``: whether any price at all is of ``market``.

    Prices and links are shuffled once, by fixture; names and addresses come to
    a bookmaker's prices of a fixture, not to each of them.
    """
    known = bookmakers.withColumn("_known", F.lit(True))
    own = rows.select("fixture_id", "bookmaker", *_PRICE).repartition("fixture_id").groupBy("fixture_id", "bookmaker")
    lists = own.agg(
        F.max("updated_at").alias("_updated"),
        F.max("last_seen_at").alias("_seen"),
        F.bool_or(F.col("market_code") == market).alias("_priced"),
        F.collect_list(F.struct(*_PRICE)).alias("_prices"),
    )
    named = lists.join(known, "bookmaker", "left")
    group = F.struct("bookmaker", "name", "home_url", "_prices")
    # Joined by fixture alone, as both sides are partitioned by it.
    link = F.struct("bookmaker", "source_url")
    addresses = latest_links(links.filter("bookmaker IS NOT NULL").repartition("fixture_id")).groupBy("fixture_id").agg(F.map_from_entries(F.collect_list(link)).alias("_addresses"))
    of_known = lambda c: F.when(F.col("_known"), c)

    def keyed(g: Column, p: Column) -> Column:
        item = F.struct(
            g["bookmaker"].alias("bookmaker_slug"),
            g["name"].alias("bookmaker_name"),
            F.coalesce(F.try_element_at("_addresses", g["bookmaker"]), g["home_url"]).alias("bookmaker_event_url"),
            *(p[c].alias(c) for c in ("market_code", "market_name", "selection", "price", "pa_category", "confidence_score")),
            p["updated_at"].alias("odd_updated_at"),
            p["last_seen_at"].alias("odd_last_seen_at"),
        )
        return F.struct(g["bookmaker"].alias("bookmaker"), *(p[c].alias(c) for c in _PRICE[:4]), item.alias("item"))

    items = F.flatten(F.transform("_groups", lambda g: F.transform(g["_prices"], lambda p: keyed(g, p))))
    out = named.groupBy("fixture_id").agg(
        F.max(of_known(F.col("_updated"))).alias("latest_odd_updated_at"),
        F.max(of_known(F.col("_seen"))).alias("latest_odd_seen_at"),
        F.collect_list(of_known(group)).alias("_groups"),
        F.bool_or("_priced").alias("_priced"),
    )
    json = F.to_json(F.transform(F.array_sort(items), lambda r: r["item"]), {"ignoreNullFields": "false"})
    out = out.filter(F.size("_groups") > 0).join(addresses, "fixture_id", "left")
    return out.select("fixture_id", "latest_odd_updated_at", "latest_odd_seen_at", json.alias("prices"), "_priced")


def snapshot(fixtures: DataFrame, leagues: DataFrame, prices: DataFrame, bookmakers: DataFrame, links: DataFrame, as_of: Column) -> DataFrame:
    """Per fixture all its prices as one JSON array in a fixed order.

    ``bookmakers``: bookmaker, name, home_url (used where no link is known).
    """
    games = upcoming(fixtures, leagues, as_of).select("fixture_id")
    return _collected(prices.join(games, "fixture_id", "left_semi"), bookmakers, links, "").drop("_priced")


def feed(fixtures: DataFrame, leagues: DataFrame, prices: DataFrame, bookmakers: DataFrame, links: DataFrame, as_of: Column, market: str = "1X2") -> DataFrame:
    """Upcoming fixtures that have a price of the market, with all their prices as in ``snapshot``."""
    games = upcoming(fixtures, leagues, as_of)
    columns = [c for c in games.columns if c != "fixture_id"]
    out = _collected(prices.join(games.select("fixture_id"), "fixture_id", "left_semi"), bookmakers, links, market)
    return games.join(out.filter("_priced"), "fixture_id").select("fixture_id", *columns, "prices")


def public(rows: DataFrame, games: DataFrame, columns: list[str]) -> DataFrame:
    """What anyone may read: rows of upcoming fixtures of enabled leagues, and only the columns granted."""
    return rows.join(games.select("fixture_id"), "fixture_id", "left_semi").select(*columns)
