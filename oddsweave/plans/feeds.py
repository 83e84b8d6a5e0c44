"""Queries of feed adapters: payloads are built from the tables and read back as price rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsweave.plans.catalog import query
from oddsweave.plans.payloads import parts
from oddsweave.sources import feeds, pages
from oddsweave.sources.tables import table

_ROWS = """SELECT CAST(p_partkey AS VARCHAR) AS event_id, s.selection, round(s.k + p_size / 10.0, 6) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category
    FROM part, (VALUES ('HOME', 1), ('DRAW', 2), ('AWAY', 3)) s(selection, k)"""
_EARLY = "p_partkey % 2 = 0"


def _price(k: int) -> Column:
    return k + F.col("p_size") / F.lit(10.0)


def _three(make) -> Column:
    return F.array(*(make(k, side) for k, side in ((1, "HOME"), (2, "DRAW"), (3, "AWAY"))))


def _read(spark, d, adapter: feeds.Adapter, payload: Column, *more: str) -> DataFrame:
    rows = parts(spark, d, *more).select(F.to_json(payload).alias("value"))
    return feeds.prices(rows, adapter).select("event_id", "selection", F.round("price", 6).alias("price"), "pa_category")


def _home() -> Column:
    return F.split_part("p_name", F.lit(" "), F.lit(1))


def _when(early, normal) -> Column:
    return F.when(F.expr(_EARLY), early).otherwise(normal)


@query(_ROWS)
def a01_offer_ids(spark, d):
    """Offers joined to their market by id inside the payload."""
    key = F.col("p_partkey")
    market = F.struct(F.lit("Resultado Final").alias("name"), _three(lambda k, _: F.array(F.lit(k).cast("bigint"))).alias("desktopOddIds"), _when('{"type": 0, "parameter": 2}', "").alias("offers"))
    odds = _three(lambda k, _: F.struct(F.lit(k).cast("bigint").alias("id"), _price(k).alias("price"), F.lit(k).alias("typeId"), F.lit(0).alias("oddStatus")))
    return _read(spark, d, feeds.OFFER_IDS, F.struct(key.alias("id"), F.concat(_home(), F.lit(" vs. "), F.col("p_type")).alias("name"), F.lit("2026-08-05T19:00:00Z").alias("startDate"), F.array(market).alias("markets"), odds.alias("odds")), "p_type")


@query(_ROWS)
def a12_milli_odds(spark, d):
    """Prices in thousandths, sides by outcome type."""
    kinds = {1: "OT_ONE", 2: "OT_CROSS", 3: "OT_TWO"}
    outcomes = _three(lambda k, _: F.struct(F.lit(k).alias("id"), F.lit(kinds[k]).alias("type"), (_price(k) * 1000).alias("odds"), F.lit("OPEN").alias("status")))
    criterion = F.struct(_when("Resultado Final com Ganho Antecipado", "Resultado Final").alias("label"), _when("Full Time - 2UP", "Full Time").alias("englishLabel"))
    offer = F.struct(criterion.alias("criterion"), F.struct(F.lit(2).alias("id")).alias("betOfferType"), outcomes.alias("outcomes"))
    return _read(spark, d, feeds.MILLI_ODDS, F.struct(F.struct(F.col("p_partkey").alias("id"), _home().alias("homeName")).alias("event"), F.array(offer).alias("betOffers")))


@query(_ROWS)
def a14_nested_maps(spark, d):
    """Maps of maps instead of arrays."""
    kinds = {1: "W1", 2: "X", 3: "W2"}
    offers = F.map_from_entries(_three(lambda k, _: F.struct(F.lit(str(k)), F.struct(F.lit(k).alias("id"), F.lit(kinds[k]).alias("type_1"), _price(k).alias("price")))))
    market = F.struct(F.lit(1).alias("id"), _when("MatchResultEP", "P1XP2").alias("type"), offers.alias("event"))
    return _read(spark, d, feeds.NESTED_MAPS, F.struct(F.col("p_partkey").alias("id"), F.create_map(F.lit("m"), market).alias("market")))


@query(_ROWS)
def a16_outcome_ids(spark, d):
    """Prices as texts, sides by outcome id."""
    outcomes = _three(lambda k, _: F.struct(F.lit(str(k)).alias("id"), _price(k).cast("string").alias("odds"), F.lit(1).alias("isActive")))
    market = F.struct(_when("60100", "1").alias("id"), F.lit(0).alias("status"), outcomes.alias("outcomes"))
    return _read(spark, d, feeds.OUTCOME_IDS, F.struct(F.concat(F.lit("sr:match:"), F.col("p_partkey").cast("string")).alias("eventId"), F.array(market).alias("markets")))


@query(_ROWS)
def a17_coded_odds(spark, d):
    """Early payout as a property of the event."""
    codes = {1: "1", 2: "0", 3: "2"}
    odds = _three(lambda k, _: F.struct(F.lit(f"u{k}").alias("uuid"), F.lit(547).alias("marketId"), _price(k).alias("price"), F.lit("active").alias("status"), F.lit(codes[k]).alias("code"), F.lit("Resultado Final").alias("marketName")))
    return _read(spark, d, feeds.CODED_ODDS, F.struct(F.col("p_partkey").alias("eventId"), _when("SA_PREMATCH", None).alias("superAdvantage"), odds.alias("odds")))


@query(_ROWS)
def a08_market_maps(spark, d):
    """Markets as map keys."""
    offers = F.map_from_entries(_three(lambda k, _: F.struct(F.lit(f"50{k}"), F.struct(F.lit(k).alias("pos"), _price(k).alias("coef"), F.lit(2.0).alias("p1")))))
    return _read(spark, d, feeds.MARKET_MAPS, F.struct(F.col("p_partkey").alias("id"), F.when(F.expr(_EARLY), F.create_map(F.lit("27072"), offers)).otherwise(F.create_map(F.lit("448"), offers)).alias("ev")))


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS page_id, CASE WHEN p_partkey % 2 = 0 THEN '2026-08-05' ELSE '2025-08-06' END AS date_key, split_part(p_name, ' ', 1) AS home_team, split_part(p_name, ' ', 2) AS away_team, CAST(p_partkey % 24 AS BIGINT) AS hour FROM part")
def s24_listing_page(spark, d):
    """Pages of a date header, then clock, home and away line by line."""
    even = F.expr(_EARLY)
    block = F.concat_ws("\n", F.when(even, "Qua 05 Ago").otherwise("Qui 06 Ago"), F.lit("1"), F.format_string("%d:30", F.col("p_partkey") % 24), _home(), F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("2.15"))
    text = table(spark, d, "part").groupBy(F.col("p_size").cast("bigint").alias("page_id")).agg(F.array_join(F.collect_list(block), "\n").alias("text"), F.array(F.lit("2026-08-05")).alias("allowed_date_keys"))
    got = pages.listing_events(text, 2025)
    hour = F.hour(F.col("starts_at") - F.make_interval(hours=F.lit(3))).cast("bigint")
    return got.select("page_id", "date_key", "home_team", "away_team", hour.alias("hour")).distinct()


@query(_ROWS.replace("CAST(p_partkey AS VARCHAR) AS event_id", "p_partkey AS page_id"))
def s23_node_payload(spark, d):
    """Typed nodes in a text, state from event to market to offer."""
    # Prices as fractions: a/10 is a/10 + 1.
    offer = lambda k, n: F.concat(F.lit(f"PA;NA={n};OD="), ((k - 1) * 10 + F.col("p_size")).cast("string"), F.lit("/10;"))
    body = F.concat_ws("|", F.lit("EV;NA=a v b;"), F.concat(F.lit("MG;NA="), _when("Resultado Final - Pagamento Antecipado", "Resultado Final"), F.lit(";")), offer(1, "one"), offer(2, "Draw"), offer(3, "two"))
    got = pages.node_prices(parts(spark, d).select(F.col("p_partkey").alias("page_id"), body.alias("value")))
    return got.select("page_id", "selection", F.round("price", 6).alias("price"), "pa_category")


@query("SELECT p_partkey AS page_id, round(1 + p_size / 10.0, 6) AS home, round(2 + p_size / 10.0, 6) AS draw, round(3 + p_size / 10.0, 6) AS away, CASE WHEN p_partkey % 2 = 0 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category FROM part WHERE p_size > 0")
def s26_result_block(spark, d):
    """Labels and prices on alternating lines."""
    shown = lambda k: F.format_string("%.2f", _price(k))
    body = F.concat_ws("\n", _when("Resultado Final - Pagamento Antecipado", "Resultado Final"), F.lit("1"), shown(1), F.lit("X"), shown(2), F.lit("2"), shown(3), F.lit("Total de gols"), F.lit("1"), F.lit("9.99"))
    got = pages.result_blocks(parts(spark, d).filter("p_size > 0").select(F.col("p_partkey").alias("page_id"), body.alias("text")))
    return got.select("page_id", *(F.round(c, 6).alias(c) for c in ("home", "draw", "away")), "pa_category")
