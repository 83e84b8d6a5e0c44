"""Raw snapshots of feed events: validity of their nested markets, merging of raw JSON, failure counters, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.functions import similarity
from oddsweave.functions.text import mentions


def valid_market(market: Column) -> Column:
    """A market of a known category whose selections are all known and above 1, and have all three sides."""
    picks = market["selections"]
    known = F.forall(picks, lambda s: s["selection"].isin("HOME", "DRAW", "AWAY") & (s["price"] > 1))
    whole = F.size(F.array_distinct(picks["selection"])) == 3
    return F.coalesce(market["paCategory"].isin("COM_PA", "SEM_PA") & known & whole, F.lit(False))


def valid_markets(snapshots: DataFrame, column: str = "markets") -> DataFrame:
    """Snapshots with their valid markets only."""
    return snapshots.withColumn(column, F.filter(F.coalesce(column, F.array().cast(snapshots.schema[column].dataType)), valid_market))


def merged_raw(raw: Column, **fields: Column) -> Column:
    """A JSON object with some fields set anew (null as JSON null); all others keep their types and what is nested in them.

    What isn't an object starts empty.
    """
    empty = F.create_map().cast("map<string,variant>")
    old = F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$", "map<string,variant>"), empty)
    kept = F.map_filter(old, lambda k, _: ~k.isin(*fields))
    return F.to_json(F.map_concat(kept, F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("variant"))))))


def counted_failure(raw: Column, failed: Column) -> Column:
    """One more failure in the raw JSON, or none again after a success."""
    before = F.coalesce(F.get_json_object(raw, "$.failCount").try_cast("int"), F.lit(0))
    return merged_raw(raw, failCount=F.when(failed, before + 1).otherwise(0))


def usable_links(links: DataFrame, most: int = 3) -> DataFrame:
    """Links with an event's address that have not failed ``most`` times."""
    failures = F.coalesce(F.get_json_object("raw", "$.failCount").cast("int"), F.lit(0))
    return links.filter(F.col("source_url").rlike(r"/E?\d+(?:/F|/?$)") & (failures < most))


def without_other_link(matches: DataFrame, links: DataFrame) -> DataFrame:
    """Matches whose fixture is not linked to another event of the same bookmaker already."""
    taken = links.select("fixture_id", "bookmaker", F.col("event_id").alias("_other"))
    clash = matches.join(taken, ["fixture_id", "bookmaker"]).filter("event_id <> _other").select("fixture_id", "bookmaker", "event_id").distinct()
    return matches.join(clash, ["fixture_id", "bookmaker", "event_id"], "left_anti")


def right_event(rows: DataFrame, least: float = 0.4) -> DataFrame:
    """Captured pages on which each expected side resembles one of the two captured sides."""
    score = similarity.team_score_udf()
    side = lambda c: F.greatest(score(c, "home_team"), score(c, "away_team")) >= least
    return rows.filter(side("expected_home") & side("expected_away"))


def page_evidence(pages: DataFrame, zone: str = "America/Sao_Paulo") -> DataFrame:
    """``pages`` (text, home_names, away_names: arrays of aliases, starts_at) with what speaks for the fixture: either side's names, its local time."""
    label = F.date_format(F.from_utc_timestamp("starts_at", zone), "HH:mm")
    home, away = mentions(F.col("text"), F.col("home_names")), mentions(F.col("text"), F.col("away_names"))
    return pages.select("*", home.alias("has_home"), away.alias("has_away"), (home & away).alias("has_both"), F.coalesce(F.contains(F.col("text"), label), F.lit(False)).alias("has_time"))


def completeness(market: Column) -> Column:
    """How whole a captured market is: a point for each side, for the result's name, for boosted prices or early payout in its text."""
    sides = market["selections"]
    told = lambda pattern: F.coalesce(market["raw_text"].rlike(f"(?i){pattern}"), F.lit(False)).cast("int")
    has = sum((F.coalesce(F.array_contains(sides, side), F.lit(False)).cast("int") for side in ("HOME", "DRAW", "AWAY")), F.lit(0))
    # What a result's name and an extra look like in a market's text.
    return has + told("full time result|resultado final") + told("enhanced prices|precos ajustados|pagamento antecipado|early payout")


def merged_markets(markets: DataFrame) -> DataFrame:
    """Of an event's visible and payload markets one per category.

    ``markets``: event_id, visible, place, pa_category, selections, raw_text and
    any more.  Of equally whole visible markets the last counts; a payload's must
    be strictly better, of these the first.  An event without visible markets
    keeps all of its payload's.  ``position``: visible categories in the order
    they came, then those of the payload alone.
    """
    key = ["event_id", "pa_category"]
    scored = markets.withColumn("score", completeness(F.struct("selections", "raw_text")))
    row = F.struct(*scored.columns)
    pick = lambda visible, order: F.max_by(F.when(F.col("visible") == visible, row), F.when(F.col("visible") == visible, order))
    both = scored.groupBy(*key).agg(pick(True, F.struct("score", "place")).alias("v"), pick(False, F.struct("score", -F.col("place"))).alias("p"), F.min(F.when(F.col("visible"), F.col("place"))).alias("_v"), F.min(F.when(~F.col("visible"), F.col("place"))).alias("_p"))
    better = F.col("v").isNull() | (F.col("p.score") > F.col("v.score"))
    seen = F.bool_or(F.col("v").isNotNull()).over(Window.partitionBy("event_id"))
    chosen = both.withColumn("_seen", seen).filter("_seen").select(F.when(F.coalesce(better, F.lit(False)), F.col("p")).otherwise(F.col("v")).alias("m"), F.struct(F.col("_v").isNull(), F.coalesce("_v", "_p")).alias("_at"))
    alone = both.withColumn("_seen", seen).filter("NOT _seen").select("event_id").distinct()
    rest = scored.join(alone, "event_id", "left_semi").select(row.alias("m"), F.struct(F.lit(True), F.col("place")).alias("_at"))
    out = chosen.unionByName(rest.select("m", rest["_at"].cast(chosen.schema["_at"].dataType).alias("_at")))
    place = F.row_number().over(Window.partitionBy("m.event_id").orderBy("_at")) - 1
    return out.select("m.*", place.alias("position"))
