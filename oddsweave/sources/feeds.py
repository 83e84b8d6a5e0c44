"""Feed adapters: nested payloads to price rows, each declared as columns.

An adapter names its payload's schema, where events, markets and selections lie
in it, and rules over them; one function turns any of them into the same flat
rows.  All rules are Catalyst expressions; names are compared by a UDF only where
a feed gives no code for a selection.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from oddsweave.functions import similarity
from oddsweave.functions.rules import digits_id, is_moneyline, oriented, payout_category, selection_of_type, split_teams
from oddsweave.functions.text import normalize_for_matching as norm
from oddsweave.functions.text import normalize_name, once

Rule = Callable[..., Column]
COLUMNS = ("event_id", "home_team", "away_team", "starts_at", "league_name", "bookmaker", "market_code", "market_name", "selection", "price", "pa_category", "confidence_score", "raw_market_name", "raw_label", "source_odd_id")


def text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def side_by(c: Column, home, draw, away) -> Column:
    """A side from codes: each of the three is a tuple of accepted values."""
    return F.when(c.isin(*home), "HOME").when(c.isin(*draw), "DRAW").when(c.isin(*away), "AWAY")


def payout(early: Column, confidence: float, otherwise: Column | None = None) -> Column:
    """category and confidence: early payout under a condition, else the standard market."""
    row = lambda c, x: F.struct(F.lit(c).alias("category"), F.lit(x).cast("double").alias("confidence"))
    return F.when(F.coalesce(early, F.lit(False)), row("COM_PA", confidence)).otherwise(row("SEM_PA", 1.0))


def teams_of(name: Column, k: str) -> Column:
    return split_teams(name)[k]


@dataclass(frozen=True)
class Adapter:
    """``e``: event, ``m``: market, ``s``: selection, each a struct column.

    ``similar``: where ``side`` has no answer, the least score of the label (or
    the best of ``compared`` labels) with a team, and whether a tie is the home
    side.  ``given``: boolean
    columns of the payloads that the rules read by name (false where there is
    no such column).  ``prepared``: columns worked out once per event, in this
    order, that later rules read by name.
    """

    bookmaker: str
    schema: str
    event: dict[str, Rule]
    markets: Rule
    selections: Rule
    side: Rule
    price: Rule
    odd_id: Rule
    market_ok: Rule = lambda e, m: F.lit(True)
    selection_ok: Rule = lambda e, m, s: F.lit(True)
    pa: Rule = lambda e, m: payout(F.lit(False), 1)
    market_name: Rule = lambda e, m: m["name"]
    label: Rule = lambda e, m, s: s["name"]
    similar: tuple[float, bool] | None = None
    slug: Rule | None = None
    odd_pa: Rule | None = None
    compared: Callable[..., tuple[Column, ...]] | None = None
    given: tuple[str, ...] = ()
    prepared: tuple[tuple[str, Rule], ...] = ()


def prices(payloads: DataFrame, adapter: Adapter, column: str = "value") -> DataFrame:
    """Flat price rows of payloads, one event each, as JSON (malformed ones give none) or as a struct that a decoder gave.

    Prices must be finite and above 0.
    """
    e, m, s = F.col("e"), F.col("m"), F.col("s")
    given = [(F.coalesce(F.col(c), F.lit(False)) if c in payloads.columns else F.lit(False)).alias(c) for c in adapter.given]
    event = F.col(column) if isinstance(payloads.schema[column].dataType, StructType) else F.from_json(F.col(column), adapter.schema)
    # Parsed once: a condition on what a generator gives isn't put, with the parsing in it, before it.
    events = payloads.select(F.explode(F.array(event)).alias("e"), *given).filter("e IS NOT NULL")
    for name, rule in adapter.prepared:
        events = events.withColumn(name, rule(e))
    kept = [*adapter.given, *(name for name, _ in adapter.prepared)]
    open_ = events.select("e", *kept, F.explode(adapter.markets(e)).alias("m")).filter(F.coalesce(adapter.market_ok(e, m), F.lit(False)))
    if not adapter.odd_pa:
        open_, kept = open_.withColumn("_pa", adapter.pa(e, m)), [*kept, "_pa"]
    rows = open_.select("e", *kept, "m", F.explode(adapter.selections(e, m)).alias("s")).filter(F.coalesce(adapter.selection_ok(e, m, s), F.lit(False)))
    # Likewise: side and price are looked at in the last condition and given out.
    known = F.struct(adapter.side(e, m, s).alias("selection"), number(adapter.price(e, m, s)).alias("price"))
    rows = rows.select("e", *kept, "m", "s", F.inline(F.array(known)))
    named = {k: f(e) for k, f in adapter.event.items()}
    flat = rows.select(
        named["id"].cast("string").alias("event_id"),
        named["home"].alias("home_team"),
        named["away"].alias("away_team"),
        named["starts"].cast("timestamp").alias("starts_at"),
        named.get("league", F.lit(None).cast("string")).alias("league_name"),
        (adapter.slug(e) if adapter.slug else F.lit(adapter.bookmaker)).alias("bookmaker"),
        F.lit("1X2").alias("market_code"),
        F.lit("MoneyLine").alias("market_name"),
        "selection",
        "price",
        (adapter.odd_pa(e, m, s) if adapter.odd_pa else F.col("_pa")).alias("_pa"),
        adapter.market_name(e, m).alias("raw_market_name"),
        adapter.label(e, m, s).alias("raw_label"),
        adapter.odd_id(e, m, s).cast("bigint").alias("source_odd_id"),
        *(c.alias(f"_label{k}") for k, c in enumerate(adapter.compared(e, m, s) if adapter.compared else ())),
    )
    if adapter.similar:
        least, tie_home = adapter.similar
        score = similarity.team_score_udf()
        unknown = F.col("selection").isNull()
        labels = [c for c in flat.columns if c.startswith("_label")] or ["raw_label"]
        near = lambda team: F.greatest(F.lit(0.0), *(score(F.when(unknown, F.col(c)), F.when(unknown, F.col(team))) for c in labels))
        flat = flat.withColumn("_h", near("home_team")).withColumn("_a", near("away_team"))
        home = (F.col("_h") >= F.col("_a")) if tie_home else (F.col("_h") > F.col("_a"))
        guess = F.when(F.greatest("_h", "_a") >= least, F.when(home, "HOME").otherwise("AWAY"))
        flat = flat.withColumn("selection", F.coalesce("selection", guess))
    flat = flat.withColumn("pa_category", F.col("_pa.category")).withColumn("confidence_score", F.col("_pa.confidence"))
    good = (F.col("price") > 0) & (F.col("price") < float("inf")) & F.col("selection").isNotNull()
    return flat.filter(good).select(*COLUMNS)


def linked(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Price rows of matched events, under their fixture; sides change places where the feed shows them inverted."""
    out = rows.join(links.select("bookmaker", "event_id", "fixture_id", "orientation"), ["bookmaker", "event_id"])
    return out.withColumn("selection", oriented(F.col("selection"), F.col("orientation"))).drop("orientation")


def best_complete(rows: DataFrame, priority: str) -> DataFrame:
    """Of an event's complete groups the one of the best priority per category; a later one must be better, not equal."""
    keys = ["bookmaker", "event_id", "pa_category"]
    groups = rows.groupBy(*keys, priority).agg(F.count_distinct("selection").alias("_n")).filter("_n = 3")
    best = groups.groupBy(*keys).agg(F.max(priority).alias(priority))
    return rows.join(best, [*keys, priority], "left_semi")


def _by_name(c: Column) -> Column:
    return side_by(norm(c), ("1", "casa", "home"), ("x", "empate", "draw"), ("2", "fora", "away"))


def _ids(*cols: Column, last: bool = False) -> Column:
    return digits_id(F.concat(*(F.coalesce(c.cast("string"), F.lit("")) for c in cols)), 15, last)


_flag = lambda c: F.coalesce(c, F.lit(False))
_DRAW = ("x", "empate", "draw")

OFFER_IDS = Adapter(
    "offer_ids",
    "id bigint, name string, startDate string, champ struct<name:string>, competitors array<struct<name:string>>, markets array<struct<id:bigint, name:string, shortName:string, desktopOddIds:array<array<bigint>>, mobileOddIds:array<array<bigint>>, offers:string>>, childMarkets array<struct<id:bigint, name:string, shortName:string, desktopOddIds:array<array<bigint>>, mobileOddIds:array<array<bigint>>, offers:string>>, odds array<struct<id:bigint, name:string, price:double, typeId:int, oddStatus:int, offers:string>>",
    {
        "id": lambda e: e["id"],
        "home": lambda e: F.coalesce(F.get(e["competitors"]["name"], 0), teams_of(e["name"], "home")),
        "away": lambda e: F.coalesce(F.get(e["competitors"]["name"], 1), teams_of(e["name"], "away")),
        "starts": lambda e: e["startDate"],
        "league": lambda e: e["champ"]["name"],
    },
    markets=lambda e: F.concat(F.coalesce(e["markets"], F.array().cast("array<struct<id:bigint,name:string,shortName:string,desktopOddIds:array<array<bigint>>,mobileOddIds:array<array<bigint>>,offers:string>>")), F.coalesce(e["childMarkets"], F.array().cast("array<struct<id:bigint,name:string,shortName:string,desktopOddIds:array<array<bigint>>,mobileOddIds:array<array<bigint>>,offers:string>>"))),
    market_ok=lambda e, m: is_moneyline(F.coalesce(m["name"], m["shortName"])),
    # The ids of a market's offers, joined to the event's offers inside the row.
    selections=lambda e, m: F.filter(e["odds"], lambda o: F.array_contains(F.flatten(F.coalesce(m["desktopOddIds"], m["mobileOddIds"])), o["id"])),
    selection_ok=lambda e, m, s: s["oddStatus"] == 0,
    side=lambda e, m, s: selection_of_type(s["typeId"]),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: F.struct(*(payout_category(m["name"], m["shortName"], m["offers"])[k].alias(k) for k in ("category", "confidence"))),
)
TOURNAMENT_TREE = Adapter(
    "apostabet",
    "id string, name string, tournamentId string, tournamentName string, isEarlyPayout boolean, homeCompetitorName string, awayCompetitorName string, scheduleTime string, sportMarketDetails array<struct<id:string, marketId:int, smarketId:int, nameDefault:string, nameTranslated:string, status:int, isMarketCancel:boolean, inPlay:boolean, sportOutcomeDetails:array<struct<id:string, outcomeId:string, active:boolean, name:string, odds:string>>>>",
    {
        "id": lambda e: e["id"],
        "home": lambda e: _named_team(e, 0),
        "away": lambda e: _named_team(e, 1),
        "starts": lambda e: e["scheduleTime"],
        "league": lambda e: e["tournamentName"],
    },
    markets=lambda e: e["sportMarketDetails"],
    market_ok=lambda e, m: (F.coalesce(m["marketId"], m["smarketId"]) == 1) & F.trim(F.coalesce(m["nameTranslated"], m["nameDefault"])).rlike("(?i)^1x2$") & (m["status"] == 1) & ~_flag(m["isMarketCancel"]) & ~_flag(m["inPlay"]),
    selections=lambda e, m: m["sportOutcomeDetails"],
    selection_ok=lambda e, m, s: _flag(s["active"]),
    side=lambda e, m, s: F.coalesce(side_by(s["outcomeId"], ("1",), ("2",), ("3",)), F.when(norm(s["name"]).isin(*_DRAW), "DRAW")),
    price=lambda e, m, s: s["odds"],
    odd_id=lambda e, m, s: _ids(s["id"]),
    pa=lambda e, m: payout(_flag(e["isEarlyPayout"]) | F.col("early_tournament"), 0.96),
    market_name=lambda e, m: F.coalesce(m["nameTranslated"], m["nameDefault"]),
    similar=(0.75, True),
    given=("early_tournament",),
)


def _named_team(e: Column, k: int) -> Column:
    """A team by its own field; by the event's name where neither field is given."""
    own = e["homeCompetitorName"], e["awayCompetitorName"]
    both = F.split(e["name"], r"(?i)\s+vs\.?\s+|\s+x\s+")
    return F.when(F.coalesce(*(F.nullif(o, F.lit("")) for o in own)).isNotNull(), own[k]).otherwise(F.nullif(F.trim(F.get(both, k)), F.lit("")))


def early_tournaments(payloads: DataFrame, tournaments: DataFrame, column: str = "value") -> DataFrame:
    """``payloads`` with ``early_tournament``: whether the event's tournament is among ``tournaments`` (``tournamentId``)."""
    ids = tournaments.select(F.col("tournamentId").alias("_tournament")).filter("_tournament <> ''").distinct().withColumn("early_tournament", F.lit(True))
    return payloads.join(ids, F.get_json_object(column, "$.tournamentId") == F.col("_tournament"), "left").withColumn("early_tournament", F.coalesce("early_tournament", F.lit(False))).drop("_tournament")


LOCALISED = Adapter(
    "bet7k",
    "_id string, EventName string, LeagueName string, StartEventDate string, Settings struct<EarlyPayout:string>, Participants array<struct<Name:string, VenueRole:string>>, Markets array<struct<_id:string, IsLive:boolean, IsRemoved:boolean, IsSuspended:boolean, MarketType:struct<_id:string, Name:string, LineTypeName:string>, Name:string, Selections:array<struct<_id:string, Name:string, OutcomeType:string, Side:int, IsDisabled:boolean, DisplayOdds:struct<Decimal:string>>>>>",
    {
        "id": lambda e: _ids(e["_id"], last=True),
        "home": lambda e: F.get(F.filter(e["Participants"], lambda p: p["VenueRole"] == "Home")["Name"], 0),
        "away": lambda e: F.get(F.filter(e["Participants"], lambda p: p["VenueRole"] == "Away")["Name"], 0),
        "starts": lambda e: e["StartEventDate"],
        "league": lambda e: e["LeagueName"],
    },
    markets=lambda e: e["Markets"],
    market_ok=lambda e, m: (
        ((m["MarketType"]["_id"] == "ML0") & (norm(m["MarketType"]["LineTypeName"]) == "1x2") & norm(F.coalesce(m["Name"], m["MarketType"]["Name"])).contains("resultado final"))
        | ((m["MarketType"]["_id"] == "ML5000") & (_flag(norm(m["MarketType"]["LineTypeName"]).contains("super odds")) | norm(F.coalesce(m["Name"], m["MarketType"]["Name"])).contains("super odds")))
    )
    & ~(_flag(m["IsLive"]) | _flag(m["IsRemoved"]) | _flag(m["IsSuspended"])),
    selections=lambda e, m: m["Selections"],
    selection_ok=lambda e, m, s: ~_flag(s["IsDisabled"]),
    side=lambda e, m, s: F.when((s["Side"] == 1) | (norm(s["OutcomeType"]) == "casa"), "HOME").when((s["Side"] == 2) | (norm(s["OutcomeType"]) == "empate"), "DRAW").when((s["Side"] == 3) | (norm(s["OutcomeType"]) == "fora"), "AWAY").when(norm(s["Name"]).isin(*_DRAW), "DRAW"),
    price=lambda e, m, s: s["DisplayOdds"]["Decimal"],
    odd_id=lambda e, m, s: _ids(s["_id"], last=True),
    pa=lambda e, m: F.when((m["MarketType"]["_id"] == "ML5000") | norm(text(m["Name"], m["MarketType"]["Name"], m["MarketType"]["LineTypeName"])).contains("super odds"), payout(F.lit(False), 1))
    .when(norm(text(m["Name"], m["MarketType"]["Name"], m["MarketType"]["LineTypeName"])).rlike("pagamento antecipado|early payout|2 ?up"), payout(F.lit(True), 1))
    .otherwise(payout((m["MarketType"]["_id"] == "ML0") & ~norm(F.coalesce(e["Settings"]["EarlyPayout"], F.lit(""))).isin("", "0", "false", "null", "undefined"), 0.98)),
    market_name=lambda e, m: F.coalesce(m["Name"], m["MarketType"]["Name"]),
    label=lambda e, m, s: s["Name"],
    similar=(0.75, True),
)


def _has_all(values: Column, *needed: str) -> Column:
    return F.forall(F.array(*map(F.lit, needed)), lambda c: F.array_contains(values, c))


def _early_offer(e: Column, market: Column) -> Column:
    offers = e["data"]["marketOffersData"]["marketOffers"][F.coalesce(market, F.lit(""))]
    early = F.exists(offers, lambda o: _flag(o["offerTypeId"] == 2) | text(o["text"], o["description"]).rlike(r"(?i)2\s*gols\s+de\s+vantagem|pagamento\s+antecipado|early\s+payout"))
    return F.coalesce(early, F.lit(False))


def _last_by_id(items: Column, name) -> Column:
    """Items that have a name, of those that share one the last, where the first stood."""
    named = F.filter(items, lambda m: name(m).isNotNull())
    last = lambda m: F.element_at(F.filter(named, lambda o: name(o) == name(m)), -1)
    return F.transform(F.filter(named, lambda m, i: ~F.exists(F.slice(named, 1, i), lambda o: name(o) == name(m))), last)


OFFERS_BY_MARKET = Adapter(
    "betano",
    "data struct<event:struct<id:string, name:string, startTime:bigint, leagueName:string, participants:array<struct<name:string>>>, markets:array<struct<id:string, uniqueId:string, name:string, type:string, selections:array<struct<id:string, name:string, price:double>>>>, marketOffersData:struct<marketOffers:map<string, array<struct<offerTypeId:int, text:string, description:string>>>>>",
    {
        "id": lambda e: e["data"]["event"]["id"],
        "home": lambda e: F.coalesce(F.get(e["data"]["event"]["participants"]["name"], 0), teams_of(e["data"]["event"]["name"], "home")),
        "away": lambda e: F.coalesce(F.get(e["data"]["event"]["participants"]["name"], 1), teams_of(e["data"]["event"]["name"], "away")),
        "starts": lambda e: F.timestamp_millis(e["data"]["event"]["startTime"]),
        "league": lambda e: e["data"]["event"]["leagueName"],
    },
    markets=lambda e: _last_by_id(e["data"]["markets"], lambda m: F.coalesce(F.nullif(m["id"], F.lit("")), F.nullif(m["uniqueId"], F.lit("")))),
    market_ok=lambda e, m: _has_all(m["selections"]["name"], "1", "X", "2") & (_flag(m["type"].isin("MRES", "MR12")) | m["name"].rlike(r"(?i)resultado\s+final")),
    selections=lambda e, m: m["selections"],
    side=lambda e, m, s: side_by(s["name"], ("1",), ("X",), ("2",)),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: _ids(s["id"]),
    # Offers of both of a market's ids.
    pa=lambda e, m: payout(_early_offer(e, m["id"]) | _early_offer(e, m["uniqueId"]), 0.98),
)
EXTERNAL_IDS = Adapter(
    "betesporte",
    "id bigint, homeTeamName string, awayTeamName string, date string, tournamentName string, markets array<struct<id:bigint, name:string, type:int, locked:boolean, options:array<struct<id:bigint, name:string, odd:double, externalId:string, locked:boolean, blocked:boolean, hide:boolean>>>>",
    {"id": lambda e: e["id"], "home": lambda e: e["homeTeamName"], "away": lambda e: e["awayTeamName"], "starts": lambda e: e["date"], "league": lambda e: e["tournamentName"]},
    markets=lambda e: _last_by_id(e["markets"], lambda m: F.coalesce(m["id"], F.lit(-1))),
    market_ok=lambda e, m: m["type"].isin(1, 1601) & m["name"].rlike(r"(?i)^1x2(\s*\(pagamento\s+antecipado\))?$") & (_has_all(m["options"]["externalId"], "1", "2", "3") | _has_all(m["options"]["name"], "Casa", "Empate", "Fora")) & ~_flag(m["locked"]),
    selections=lambda e, m: m["options"],
    selection_ok=lambda e, m, s: ~(_flag(s["locked"]) | _flag(s["blocked"]) | _flag(s["hide"])),
    side=lambda e, m, s: F.when((s["externalId"] == "1") | (s["name"] == "Casa"), "HOME").when((s["externalId"] == "2") | (s["name"] == "Empate"), "DRAW").when((s["externalId"] == "3") | (s["name"] == "Fora"), "AWAY"),
    price=lambda e, m, s: s["odd"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout((m["type"] == 1601) | m["name"].rlike(r"(?i)pagamento\s+antecipado|early\s+payout"), 0.98),
)
LIVE_RUNNERS = Adapter(
    "betfair",
    "urn string, sportevent struct<name:string, openDate:string, competition:struct<name:string>>, markets array<struct<groupTitle:string, market:struct<urn:string, name:string, marketType:string, liveData:struct<sportsbookMarketStatus:string, runners:array<struct<selectionId:bigint, runnerStatus:string, displayOdds:struct<decimal:double>, odds:struct<decimal:double>>>>, runners:array<struct<name:string, selectionId:bigint, resultType:string>>>>>",
    {"id": lambda e: F.coalesce(F.nullif(F.regexp_extract(e["urn"], r"event:(\d+)", 1), F.lit("")), e["urn"], e["sportevent"]["name"]), "home": lambda e: teams_of(e["sportevent"]["name"], "home"), "away": lambda e: teams_of(e["sportevent"]["name"], "away"), "starts": lambda e: e["sportevent"]["openDate"], "league": lambda e: e["sportevent"]["competition"]["name"]},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: m["market"]["liveData"]["sportsbookMarketStatus"] == "OPEN",
    # A runner and its live data, joined by their id inside the row.
    selections=lambda e, m: F.transform(m["market"]["runners"], lambda r: F.struct(r["name"].alias("name"), r["selectionId"].alias("id"), r["resultType"].alias("type"), F.try_element_at(F.filter(m["market"]["liveData"]["runners"], lambda x: x["selectionId"] == r["selectionId"]), F.lit(-1)).alias("live"))),
    selection_ok=lambda e, m, s: s["live"]["runnerStatus"] == "ACTIVE",
    side=lambda e, m, s: side_by(s["type"], ("HOME",), ("DRAW",), ("AWAY",)),
    price=lambda e, m, s: F.coalesce(s["live"]["displayOdds"]["decimal"], s["live"]["odds"]["decimal"]),
    # The market's digits and the last six of the selection's.
    odd_id=lambda e, m, s: digits_id(F.concat(F.regexp_replace(F.coalesce(m["market"]["urn"], F.lit("")), r"\D", ""), F.right(F.concat(F.lit("000000"), F.coalesce(s["id"].cast("string"), F.lit(""))), F.lit(6))), 18),
    pa=lambda e, m: payout(text(m["groupTitle"], m["market"]["name"]).rlike(r"(?i)2\s*gols\s+de\s+vantagem|pagamento\s+antecipado|early\s+payout"), 0.96),
    market_name=lambda e, m: F.coalesce(m["groupTitle"], m["market"]["name"]),
)
MARKET_MAPS = Adapter(
    "betfast",
    "id bigint, homeTeam string, awayTeam string, startsAt string, leagueName string, ev map<string, map<string, struct<pos:bigint, coef:double, lock:boolean, p1:double>>>",
    {"id": lambda e: e["id"], "home": lambda e: e["homeTeam"], "away": lambda e: e["awayTeam"], "starts": lambda e: e["startsAt"], "league": lambda e: e["leagueName"]},
    markets=lambda e: F.map_entries(e["ev"]),
    market_ok=lambda e, m: m["key"].isin("448", "27072"),
    selections=lambda e, m: F.map_entries(m["value"]),
    selection_ok=lambda e, m, s: ~_flag(s["value"]["lock"]) & ((m["key"] == "448") | (s["value"]["p1"] == 2)),
    side=lambda e, m, s: side_by(s["value"]["pos"], (1, 133827), (2, 133828), (3, 133829)),
    price=lambda e, m, s: s["value"]["coef"],
    odd_id=lambda e, m, s: _ids(s["key"], last=True),
    pa=lambda e, m: payout(m["key"] == "27072", 1),
    market_name=lambda e, m: F.when(m["key"] == "448", "Resultado da Partida").otherwise("Vence ao Abrir 2 Gols"),
    label=lambda e, m, s: s["value"]["pos"].cast("string"),
)


def _letters(name: Column) -> Column:
    """Sum of the code points of a name; none for null."""
    chars = F.filter(F.split(F.coalesce(name, F.lit("")), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda n, c: n + F.ascii(c))


THREE_WAY = Adapter(
    "betmgm",
    "id bigint, name string, eventName string, leagueName string, startTime string, participants array<struct<name:string, position:string>>, markets array<struct<id:string, type:string, name:string, betMarketStatus:string, metadata:map<string,string>, outcomes:array<struct<id:string, name:string, odds:string, formatDecimal:string>>>>",
    {
        "id": lambda e: e["id"],
        "home": lambda e: F.get(F.filter(e["participants"], lambda p: p["position"] == "HOME")["name"], 0),
        "away": lambda e: F.get(F.filter(e["participants"], lambda p: p["position"] == "AWAY")["name"], 0),
        "starts": lambda e: e["startTime"],
        "league": lambda e: e["leagueName"],
    },
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: m["type"].isin("standard-3-way", "standard-3-way-early-payout", "overtime-3-way", "match-odds")
    & (F.size(m["outcomes"]) >= 3)
    & (norm(m["name"]).rlike(r"resultado\s+(final|da partida)|1x2|vencedor|match\s+odds") | m["type"].isin("standard-3-way", "standard-3-way-early-payout"))
    & (m["betMarketStatus"] == "OPEN"),
    selections=lambda e, m: m["outcomes"],
    side=lambda e, m, s: _by_name(s["name"]),
    price=lambda e, m, s: F.coalesce(s["formatDecimal"], s["odds"]),
    odd_id=lambda e, m, s: F.coalesce(_ids(F.coalesce(s["id"], m["id"])), F.substring(F.concat(e["id"].cast("string"), _letters(s["name"]).cast("string")), 1, 15).cast("long")),
    pa=lambda e, m: payout((m["type"] == "standard-3-way-early-payout") | (F.coalesce(m["metadata"]["earlyPayout"], F.lit("")) == "true") | norm(text(m["type"], m["name"])).rlike("pagamento antecipado|early payout"), 0.99),
    similar=(0.75, True),
)


def _flat_kind(m: Column) -> Column:
    """Priority of a flat price's market: 100 early payout, 90 or 80 standard, null other."""

    def kind(words: Column) -> Column:
        name, code = words["name"], words["code"]
        early = (m["market_id"] == 99979617) | F.trim(text(name, code)).rlike("pag antecipado|pagamento antecipado|full time result 2 up|2 up")
        best = (m["market_id"] == 999133) | (code == "win draw win")
        standard = best | name.isin("resultado partida", "resultado da partida", "resultado final") | ((m["market_id"] == 1) & (m["market_code"] == "1x2"))
        return F.when(_flag(early), 100).when(_flag(best), 90).when(_flag(standard), 80)

    return once(F.struct(normalize_name(m["market_name"]).alias("name"), normalize_name(m["market_code"]).alias("code")), kind)


def _flat_odds(e: Column) -> Column:
    """The odds of open markets that have a side and a price, each with its market and side."""
    shut = lambda o: _flag(o["is_live"] == 1) | _flag(o["market_status_id"] == 0)
    told = lambda o, home, away: F.struct(F.struct(o["market_id"], o["market_name"], o["market_code"], o["selection_market_id"]).alias("market"), _flat_side(o, home, away).alias("side"), number(o["odd"]).alias("price"), o.alias("odd"))
    teams = F.struct(normalize_name(e["home"]).alias("home"), normalize_name(e["away"]).alias("away"))
    odds = once(teams, lambda t: F.transform(F.filter(e["odds"], lambda o: ~shut(o)), lambda o: told(o, t["home"], t["away"])))
    return F.filter(odds, lambda o: o["side"].isNotNull() & _flag((o["price"] > 0) & (o["price"] < float("inf"))))


def _flat_groups(e: Column) -> Column:
    """Complete markets of a priority, each with its first odd of either side in order; a market's names are read once."""
    odds = F.col("_odds")
    markets = F.transform(F.array_distinct(odds["market"]), lambda m: F.struct(_flat_kind(m).alias("priority"), m.alias("market")))
    first = lambda k: F.transform(F.array(*map(F.lit, ("HOME", "DRAW", "AWAY"))), lambda side: F.get(F.filter(odds, lambda o: (o["side"] == side) & (o["market"] == k["market"])), 0))
    groups = F.transform(F.filter(markets, lambda k: k["priority"].isNotNull()), lambda k: F.struct(k["priority"].alias("priority"), first(k).alias("odds")))
    return F.filter(groups, lambda g: F.forall(g["odds"], lambda o: o.isNotNull()))


def _flat_best(e: Column) -> Column:
    """The complete market of the best priority of either category, of equals the one that came first."""

    def first(priority: int) -> Column:
        return F.get(F.filter(F.col("_groups"), lambda g: g["priority"] == priority), 0)

    return F.filter(F.array(first(100), F.coalesce(first(90), first(80))), lambda g: g.isNotNull())


FLAT_ODDS = Adapter(
    "betnacional",
    "event_id bigint, home string, away string, date_start string, tournament_name string, odds array<struct<id:string, market_id:bigint, market_status_id:int, odd:string, outcome_id:string, outcome_name:string, outcome_code:string, market_name:string, market_code:string, selection_market_id:string, is_live:int>>",
    {"id": lambda e: e["event_id"], "home": lambda e: e["home"], "away": lambda e: e["away"], "starts": lambda e: F.to_timestamp(e["date_start"]) + F.make_interval(hours=F.lit(3)), "league": lambda e: e["tournament_name"]},
    markets=_flat_best,
    prepared=(("_odds", _flat_odds), ("_groups", _flat_groups)),
    selections=lambda e, m: m["odds"],
    side=lambda e, m, s: s["side"],
    price=lambda e, m, s: s["odd"]["odd"],
    odd_id=lambda e, m, s: digits_id(s["odd"]["id"], 18, True),
    pa=lambda e, m: payout(m["priority"] == 100, 1),
    market_name=lambda e, m: F.get(m["odds"], 0)["odd"]["market_name"],
    label=lambda e, m, s: s["odd"]["outcome_name"],
)


def _flat_side(o: Column, home: Column, away: Column) -> Column:
    coded = F.when((o["outcome_id"] == "1") | (o["outcome_code"] == "{$competitor1}"), "HOME").when((o["outcome_id"] == "2") | (o["outcome_code"] == "draw"), "DRAW").when((o["outcome_id"] == "3") | (o["outcome_code"] == "{$competitor2}"), "AWAY")
    named = lambda n: F.when(n == "", None).when(n.isin("empate", "draw"), "DRAW").when(n == home, "HOME").when(n == away, "AWAY")
    return F.coalesce(coded, once(normalize_name(F.coalesce(o["outcome_name"], o["outcome_code"])), named))


MARKET_TYPES = Adapter(
    "casadeapostas",
    "id bigint, name string, leagueName string, startDate string, competitors array<struct<name:string>>, markets array<struct<id:bigint, marketTypeId:int, name:string, published:boolean, state:int, odds:array<struct<id:bigint, value:double, state:int, name:string, externalId:string, published:boolean>>>>",
    {"id": lambda e: e["id"], "home": lambda e: F.get(e["competitors"]["name"], 0), "away": lambda e: F.get(e["competitors"]["name"], 1), "starts": lambda e: F.concat(F.regexp_replace(e["startDate"], "Z$", ""), F.lit("Z")), "league": lambda e: e["leagueName"]},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: m["marketTypeId"].isin(1, 1252) & norm(m["name"]).startswith("1x2") & F.coalesce(m["published"], F.lit(True)) & (F.coalesce(m["state"], F.lit(1)) != 0),
    selections=lambda e, m: m["odds"],
    selection_ok=lambda e, m, s: (s["state"] == 1) & F.coalesce(s["published"], F.lit(True)),
    side=lambda e, m, s: F.when(s["externalId"] == "1", "HOME").when((s["externalId"] == "2") | (norm(s["name"]) == "empate"), "DRAW").when(s["externalId"] == "3", "AWAY"),
    price=lambda e, m, s: s["value"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout((m["marketTypeId"] == 1252) | m["name"].rlike(r"(?i)pagamento\s+antecipado|early\s+payout"), 0.99),
    similar=(0.75, True),
)
#: Criterion ids of the result and of the result with early payout.
RESULT_CRITERION, EARLY_CRITERION = 1001159858, 2100089307


def _criterion(m: Column) -> Column:
    return norm(text(m["criterion"]["label"], m["criterion"]["englishLabel"]))


MILLI_ODDS = Adapter(
    "kto",
    "event struct<id:bigint, homeName:string, awayName:string, start:string, group:string>, betOffers array<struct<id:bigint, criterion:struct<id:bigint, label:string, englishLabel:string>, betOfferType:struct<id:int>, outcomes:array<struct<id:bigint, label:string, odds:double, participant:string, type:string, status:string>>>>",
    {"id": lambda e: e["event"]["id"], "home": lambda e: e["event"]["homeName"], "away": lambda e: e["event"]["awayName"], "starts": lambda e: e["event"]["start"], "league": lambda e: e["event"]["group"]},
    markets=lambda e: e["betOffers"],
    market_ok=lambda e, m: (m["betOfferType"]["id"] == 2)
    & (F.size(m["outcomes"]) == 3)
    & (_flag(m["criterion"]["id"].isin(RESULT_CRITERION, EARLY_CRITERION)) | (_criterion(m) == "resultado final full time") | _criterion(m).rlike("resultado final com ganho antecipado|full time 2up")),
    selections=lambda e, m: m["outcomes"],
    selection_ok=lambda e, m, s: s["status"] == "OPEN",
    side=lambda e, m, s: F.when((s["type"] == "OT_ONE") | (s["label"] == "1"), "HOME").when((s["type"] == "OT_CROSS") | (s["label"] == "X"), "DRAW").when((s["type"] == "OT_TWO") | (s["label"] == "2"), "AWAY").when(norm(F.coalesce(s["participant"], s["label"])).isin(*_DRAW), "DRAW"),
    price=lambda e, m, s: s["odds"] / 1000,
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout(_flag(m["criterion"]["id"] == EARLY_CRITERION) | text(m["criterion"]["label"], m["criterion"]["englishLabel"]).rlike(r"(?i)ganho\s+antecipado|2up"), 0.99),
    market_name=lambda e, m: m["criterion"]["label"],
    label=lambda e, m, s: F.coalesce(s["participant"], s["label"]),
    similar=(0.75, True),
)
TAGGED_MARKETS = Adapter(
    "novibet",
    "betContextId bigint, startTimeUTC string, additionalCaptions struct<competitor1:string, competitor2:string>, marketTags array<struct<marketId:bigint, tag:string>>, markets array<struct<marketId:bigint, marketSysname:string, caption:string, displayCaption:string, betItems:array<struct<id:string, code:string, caption:string, price:double, isAvailable:boolean>>>>",
    {"id": lambda e: e["betContextId"], "home": lambda e: e["additionalCaptions"]["competitor1"], "away": lambda e: e["additionalCaptions"]["competitor2"], "starts": lambda e: e["startTimeUTC"]},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: F.forall(F.array(F.lit("1"), F.lit("X"), F.lit("2")), lambda c: F.array_contains(m["betItems"]["code"], c)) & ((m["marketSysname"] == "SOCCER_MATCH_RESULT_PRELIVE") | m["marketSysname"].rlike(r"(?i)^SOCCER_MATCH_RESULT(?:_PRELIVE)?(?:_\d+)?_ODDS_KEY$")),
    selections=lambda e, m: m["betItems"],
    selection_ok=lambda e, m, s: _flag(s["isAvailable"]),
    side=lambda e, m, s: side_by(s["code"], ("1",), ("X",), ("2",)),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: _ids(s["id"]),
    pa=lambda e, m: F.when(F.exists(F.coalesce(e["marketTags"], F.array().cast("array<struct<marketId:bigint,tag:string>>")), lambda t: (t["marketId"] == m["marketId"]) & t["tag"].rlike("(?i)EARLY_PAYOUT|PAGAMENTO")), payout(F.lit(True), 0.99)).otherwise(payout(F.lower(text(m["marketSysname"], m["caption"], m["displayCaption"])).rlike(r"pagamento\s*antecipado|pague\s*antecipado|early\s*payout"), 0.95)),
    market_name=lambda e, m: F.coalesce(m["displayCaption"], m["caption"]),
    label=lambda e, m, s: F.coalesce(s["caption"], s["code"]),
)
NESTED_MAPS = Adapter(
    "segurobet",
    "id bigint, team1_name string, team2_name string, start_ts bigint, competitionName string, market map<string, struct<id:bigint, name:string, type:string, market_type:string, has_early_payout:boolean, event:map<string, struct<id:bigint, name:string, price:double, type_1:string>>>>",
    {"id": lambda e: e["id"], "home": lambda e: e["team1_name"], "away": lambda e: e["team2_name"], "starts": lambda e: F.timestamp_seconds(e["start_ts"]), "league": lambda e: e["competitionName"]},
    markets=lambda e: F.map_values(e["market"]),
    market_ok=lambda e, m: m["type"].isin("P1XP2", "MatchResultEP") | F.lower(text(m["name"], m["type"], m["market_type"])).rlike(r"resultado\s+final.*pagamento\s+antecipado"),
    selections=lambda e, m: F.map_values(m["event"]),
    side=lambda e, m, s: F.coalesce(side_by(s["type_1"], ("W1",), ("X",), ("W2",)), F.when(norm(s["name"]).isin("x", "empate"), "DRAW")),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout(_flag(m["has_early_payout"]) | (m["type"] == "MatchResultEP") | F.lower(text(m["name"], m["type"], m["market_type"])).rlike(r"pagamento\s+antecipado|early\s+payout"), 0.99),
)
def _parameter(m: Column, key: str) -> Column:
    """The first of a market's parameters of that key."""
    return F.get(F.filter(m["parameters"], lambda p: p["key"] == key), 0)["value"]


PARAMETERS = Adapter(
    "sportingbet",
    "id string, name struct<value:string>, startDate string, participants array<struct<name:struct<value:string>>>, optionMarkets array<struct<id:bigint, name:struct<value:string>, status:string, parameters:array<struct<key:string, value:string>>, options:array<struct<id:bigint, name:struct<value:string>, status:string, price:struct<odds:double>>>>>",
    {"id": lambda e: F.element_at(F.split(e["id"], ":"), -1).try_cast("bigint"), "home": lambda e: F.get(e["participants"]["name"]["value"], 0), "away": lambda e: F.get(e["participants"]["name"]["value"], 1), "starts": lambda e: e["startDate"]},
    markets=lambda e: e["optionMarkets"],
    market_ok=lambda e, m: (m["status"] == "Visible") & (_parameter(m, "MarketType") == "3way") & (_parameter(m, "Period") == "RegularTime"),
    selections=lambda e, m: m["options"],
    selection_ok=lambda e, m, s: s["status"] == "Visible",
    side=lambda e, m, s: F.when(s["name"]["value"].rlike("(?i)^x$|empate"), "DRAW"),
    price=lambda e, m, s: s["price"]["odds"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout(_flag(_parameter(m, "MarketSubType") == "2Up") | m["name"]["value"].rlike(r"(?i)VP\s*\(\+2\)"), 0.95),
    market_name=lambda e, m: m["name"]["value"],
    label=lambda e, m, s: s["name"]["value"],
    similar=(0.72, False),
)
OUTCOME_IDS = Adapter(
    "sportybet",
    "eventId string, estimateStartTime bigint, homeTeamName string, awayTeamName string, markets array<struct<id:string, name:string, status:int, marketGuide:string, outcomes:array<struct<id:string, odds:string, isActive:int, desc:string>>>>",
    {"id": lambda e: F.element_at(F.split(e["eventId"], ":"), -1), "home": lambda e: e["homeTeamName"], "away": lambda e: e["awayTeamName"], "starts": lambda e: F.timestamp_millis(e["estimateStartTime"])},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: (m["status"] == 0) & m["id"].isin("1", "60100"),
    selections=lambda e, m: m["outcomes"],
    selection_ok=lambda e, m, s: s["isActive"] == 1,
    side=lambda e, m, s: F.coalesce(side_by(s["id"], ("1",), ("2",), ("3",)), F.when(s["desc"].rlike("(?i)empate"), "DRAW")),
    price=lambda e, m, s: s["odds"],
    odd_id=lambda e, m, s: _ids(F.element_at(F.split(e["eventId"], ":"), -1), m["id"], s["id"]),
    pa=lambda e, m: payout((m["id"] == "60100") | m["name"].rlike("(?i)2UP") | m["marketGuide"].rlike("(?i)vantagem de dois gols"), 0.97),
    label=lambda e, m, s: s["desc"],
    similar=(0.72, False),
)
CODED_ODDS = Adapter(
    "superbet",
    "eventId bigint, matchName string, utcDate string, unixDateMillis bigint, superAdvantage string, sourceTournamentName string, odds array<struct<uuid:string, marketId:bigint, outcomeId:bigint, price:double, status:string, code:string, name:string, marketName:string>>",
    {"id": lambda e: e["eventId"], "home": lambda e: F.nullif(F.trim(F.split_part(e["matchName"], F.lit("·"), F.lit(1))), F.lit("")), "away": lambda e: F.nullif(F.trim(F.split_part(e["matchName"], F.lit("·"), F.lit(2))), F.lit("")), "starts": lambda e: F.coalesce(F.to_timestamp(e["utcDate"]), F.timestamp_millis(e["unixDateMillis"])), "league": lambda e: e["sourceTournamentName"]},
    markets=lambda e: F.array(F.struct(F.get(e["odds"]["marketName"], 0).alias("name"))),
    selections=lambda e, m: e["odds"],
    selection_ok=lambda e, m, s: (s["status"] == "active") & (s["marketId"] == 547) & s["marketName"].rlike("(?i)resultado final"),
    side=lambda e, m, s: side_by(s["code"], ("1",), ("0",), ("2",)),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: F.coalesce(_ids(s["uuid"]), s["outcomeId"]),
    pa=lambda e, m: payout(e["superAdvantage"] == "SA_PREMATCH", 0.98),
)
def _place(values: Column, value) -> Column:
    """Where a value stands first, from 0; -1 where it doesn't."""
    return (F.array_position(values, value) - 1).cast("int")


def _back(runner: Column) -> Column:
    """The first price to back, else the first."""
    return F.get(runner["prices"], F.greatest(_place(runner["prices"]["side"], "back"), F.lit(0)))


def _runner_side(runner: Column) -> Column:
    """A side by the normal form of a runner's name, which is read once."""
    names = F.array(F.lit("draw"), F.lit("empate"), F.col("_home"), F.col("_away"))
    return F.get(F.array(*map(F.lit, ("DRAW", "DRAW", "HOME", "AWAY"))), _place(names, norm(runner["name"])))


EXCHANGE = Adapter(
    "tradeball",
    "id string, name string, start string, source string, rawDball string, `event-participants` array<struct<`participant-name`:string>>, markets array<struct<id:string, name:string, live:boolean, status:string, `market-type`:string, `name-original`:string, runners:array<struct<id:string, name:string, status:string, withdrawn:boolean, prices:array<struct<odds:double, `decimal-odds`:double, side:string>>>>>>",
    {"id": lambda e: _ids(e["id"], last=True), "home": lambda e: F.get(e["event-participants"]["participant-name"], 0), "away": lambda e: F.get(e["event-participants"]["participant-name"], 1), "starts": lambda e: e["start"]},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: (m["status"] == "open") & ~_flag(m["live"]) & (m["market-type"] == "one_x_two") & norm(text(m["name"], m["name-original"])).rlike("match odds|resultado da partida|moneyline|winner|1x2"),
    selections=lambda e, m: m["runners"],
    prepared=(("_home", lambda e: norm(F.get(e["event-participants"]["participant-name"], 0))), ("_away", lambda e: norm(F.get(e["event-participants"]["participant-name"], 1)))),
    side=lambda e, m, s: _runner_side(s),
    selection_ok=lambda e, m, s: (s["status"] == "open") & ~_flag(s["withdrawn"]),
    price=lambda e, m, s: F.coalesce(_back(s)["decimal-odds"], _back(s)["odds"]),
    odd_id=lambda e, m, s: _ids(s["id"], last=True),
    pa=lambda e, m: payout(norm(text(m["name"], m["name-original"])).rlike("pagamento antecipado|early payout|2 ?up"), 1),
    slug=lambda e: F.when((e["source"] == "exchange") | e["rawDball"].isNull(), "exchange").otherwise("tradeball"),
)
SIDE_LABELS = Adapter(
    "vaidebet",
    "fId string, fsd bigint, hcN string, acN string, sourceLeagueName string, btgs array<struct<btgId:string, btgN:string, btgNO:string, btgMN:string, mbtgMN:string, mrkp:string, fos:array<struct<foId:string, btN:string, valid:boolean, tvalid:boolean, freeze:boolean, hO:double, hSh:string, pSh:string, oc:string>>>>",
    {"id": lambda e: e["fId"], "home": lambda e: e["hcN"], "away": lambda e: e["acN"], "starts": lambda e: F.timestamp_millis(e["fsd"]), "league": lambda e: e["sourceLeagueName"]},
    markets=lambda e: e["btgs"],
    market_ok=lambda e, m: m["btgId"].isin("7988", "115382") | (_labels(m).rlike("resultado") & _labels(m).rlike("partida|h/d/a|1x2")) | _labels(m).rlike(r"1x2\s*\(\s*2up\s*\)|xup=2"),
    selections=lambda e, m: m["fos"],
    selection_ok=lambda e, m, s: (F.coalesce(s["valid"], F.lit(True)) | _flag(s["tvalid"])) & ~_flag(s["freeze"]),
    side=lambda e, m, s: F.coalesce(_worded(text(s["pSh"], s["btN"])), F.when(text(s["hSh"], s["oc"]).rlike("(?i)empate|draw"), "DRAW")),
    price=lambda e, m, s: s["hO"],
    odd_id=lambda e, m, s: s["foId"].try_cast("bigint"),
    pa=lambda e, m: payout(_labels(m).rlike(r"1x2\s*\(\s*2up\s*\)|xup=2"), 0.95),
    market_name=lambda e, m: F.coalesce(m["mbtgMN"], m["btgNO"], m["btgN"]),
    label=lambda e, m, s: F.coalesce(s["hSh"], s["oc"], s["pSh"]),
    compared=lambda e, m, s: (s["hSh"], s["oc"]),
    similar=(0.72, False),
)


def _labels(m: Column) -> Column:
    return F.lower(text(m["btgN"], m["btgNO"], m["btgMN"], m["mbtgMN"], m["mrkp"]))


def _worded(label: Column) -> Column:
    return F.when(label.rlike("(?i)empate|draw"), "DRAW").when(label.rlike("(?i)home|casa"), "HOME").when(label.rlike("(?i)away|fora"), "AWAY")


#: Flat odds of one event, as ``wire.message_events`` gives them.
GROUPED_ODDS = Adapter(
    "betboom",
    "id bigint, startsAt string, homeTeam string, awayTeam string, tournamentName string, odds array<struct<id:string, name:string, shortName:string, side:int, price:double, marketName:string, groupName:string>>",
    {"id": lambda e: e["id"], "home": lambda e: e["homeTeam"], "away": lambda e: e["awayTeam"], "starts": lambda e: e["startsAt"], "league": lambda e: e["tournamentName"]},
    markets=lambda e: F.transform(F.array_distinct(F.transform(e["odds"], lambda o: F.struct(o["marketName"].alias("market"), o["groupName"].alias("group")))), lambda n: F.struct(n["market"].alias("market"), n["group"].alias("group"), F.coalesce(n["group"], n["market"]).alias("name"))),
    selections=lambda e, m: F.filter(e["odds"], lambda o: o["marketName"].eqNullSafe(m["market"]) & o["groupName"].eqNullSafe(m["group"])),
    selection_ok=lambda e, m, s: (norm(s["marketName"]) == "vencedor") & (norm(s["groupName"]) == "resultado") & norm(s["shortName"]).isin("1", "x", "2"),
    side=lambda e, m, s: F.when(_flag(norm(s["shortName"]) == "1") | _flag(s["side"] == 1), "HOME").when(_flag(norm(s["shortName"]) == "x") | _flag(s["side"] == 2), "DRAW").when(_flag(norm(s["shortName"]) == "2") | _flag(s["side"] == 3), "AWAY"),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: _ids(s["id"]),
    odd_pa=lambda e, m, s: payout(norm(text(s["marketName"], s["groupName"], s["name"])).rlike("pagamento antecipado|early payout|2up|2 up"), 1),
    market_name=lambda e, m: m["name"],
    label=lambda e, m, s: F.coalesce(s["name"], s["shortName"]),
)
#: Names of the result market, plain and boosted.
DECODED_NAMES = ("resultado da partida", "resultado final", "resultado da partida odds melhoradas", "resultado final odds melhoradas")
#: Markets with three named results, as ``wire.slice_events`` gives them.
DECODED_RESULTS = Adapter(
    "versusbet",
    "id bigint, name string, startsAt string, leagueName string, homeTeam string, awayTeam string, markets array<struct<id:bigint, name:string, additional:array<struct<key:string, value:string>>, results:array<struct<id:bigint, name:string, price:double>>>>",
    {"id": lambda e: e["id"], "home": lambda e: e["homeTeam"], "away": lambda e: e["awayTeam"], "starts": lambda e: e["startsAt"], "league": lambda e: e["leagueName"]},
    markets=lambda e: e["markets"],
    market_ok=lambda e, m: (F.size(m["results"]) == 3) & norm(m["name"]).isin(*DECODED_NAMES),
    selections=lambda e, m: m["results"],
    # A code in the name, else a place: 0 is home, 1 is away.
    side=lambda e, m, s: F.when(s["name"].rlike(r"(?i)\|\|x\|") | _is_or_begins(s["name"], "empate"), "DRAW").when(s["name"].contains("||1|") | _is_or_begins(s["name"], "0"), "HOME").when(s["name"].contains("||2|") | _is_or_begins(s["name"], "1"), "AWAY"),
    price=lambda e, m, s: s["price"],
    odd_id=lambda e, m, s: s["id"],
    pa=lambda e, m: payout(norm(F.concat_ws(" ", m["name"], F.transform(m["additional"], lambda a: text(a["key"], a["value"])))).rlike("early payout|earlypayout|pagamento antecipado|2 gols de vantagem|2up|2 up"), 0.99),
    similar=(0.75, True),
)


def _is_or_begins(name: Column, word: str) -> Column:
    return (norm(name) == word) | norm(name).startswith(f"{word} ")


ADAPTERS = {a.bookmaker: a for a in (OFFER_IDS, TOURNAMENT_TREE, LOCALISED, OFFERS_BY_MARKET, GROUPED_ODDS, EXTERNAL_IDS, LIVE_RUNNERS, MARKET_MAPS, THREE_WAY, FLAT_ODDS, MARKET_TYPES, MILLI_ODDS, TAGGED_MARKETS, NESTED_MAPS, PARAMETERS, OUTCOME_IDS, CODED_ODDS, EXCHANGE, SIDE_LABELS, DECODED_RESULTS)}
