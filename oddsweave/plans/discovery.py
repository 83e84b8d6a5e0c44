"""Queries of discovery: canonical pages, links, listings, searches and phases, on pages made from the plain tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.functions import text
from oddsweave.operators import discovery
from oddsweave.plans.catalog import query
from oddsweave.sources.tables import AS_OF, table, with_views

_FIXTURES = with_views("fixtures")


@query("SELECT p_partkey AS fixture_id, CAST(p_size AS BIGINT) AS league_id, split_part(p_name, ' ', 1) AS home_team, p_brand AS status, '2000-01-01 20:00:00' AS starts_at FROM part")
def s01_canonical_fixtures(spark, d):
    """Pages of forty fixtures each, without errors."""
    entry = F.struct(
        F.struct(F.col("p_partkey").alias("id"), F.lit("2000-01-01T20:00:00+00:00").alias("date"), F.struct(F.col("p_brand").alias("short")).alias("status")).alias("fixture"),
        F.struct(F.col("p_size").alias("id"), F.col("p_type").alias("name"), F.lit("c").alias("country"), F.lit(2000).alias("season")).alias("league"),
        F.struct(F.struct(F.lit(1).alias("id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name")).alias("home"), F.struct(F.lit(2).alias("id"), F.lit("b").alias("name")).alias("away")).alias("teams"),
    )
    paged = table(spark, d, "part").groupBy(F.floor(F.col("p_partkey") / 40)).agg(F.collect_list(entry).alias("response"))
    got = discovery.api_fixtures(paged.select(F.to_json(F.struct(F.array().cast("array<string>").alias("errors"), "response")).alias("value")))
    return got.select("fixture_id", "league_id", "home_team", "status", F.date_format("starts_at", "yyyy-MM-dd HH:mm:ss").alias("starts_at"))


@query("SELECT CAST(p_size AS BIGINT) AS league_id, CAST(CASE WHEN p_size % 2 = 0 THEN 2000 + min(p_partkey) % 10 ELSE 2000 + max(p_partkey % 10) END AS INTEGER) AS season FROM part GROUP BY p_size")
def s02_league_catalog(spark, d):
    """Even leagues have a current season, odd ones only past ones."""
    year = (F.lit(2000) + F.col("p_partkey") % 10).cast("int")
    rows = table(spark, d, "part").groupBy("p_size").agg(F.min("p_partkey").alias("first"), F.collect_set(year).alias("years"))
    current = (F.lit(2000) + F.col("first") % 10).cast("int")
    seasons = F.transform("years", lambda y: F.struct(y.alias("year"), ((F.col("p_size") % 2 == 0) & (y == current)).alias("current")))
    entry = F.struct(F.struct(F.col("p_size").alias("id"), F.lit("n").alias("name")).alias("league"), F.struct(F.lit("c").alias("name")).alias("country"), seasons.alias("seasons"))
    got = discovery.league_catalog(rows.select(F.to_json(F.struct(F.array().cast("array<string>").alias("errors"), F.array(entry).alias("response"))).alias("value")))
    return got.select("league_id", "season")


@query(_FIXTURES + " SELECT DISTINCT league_id * 10 AS champ_id FROM fixtures WHERE fixture_id % 3 = 0 AND league_id % 4 <> 0")
def j15_champ_ids(spark, d):
    fixtures = table(spark, d, "fixtures")
    known = fixtures.select("league_id", F.when(F.col("league_id") % 4 != 0, F.col("league_id") * 10).alias("champ_id")).distinct()
    return discovery.champ_ids(fixtures.filter("fixture_id % 3 = 0"), known)


@query(
    with_views("links", "fixtures")
    + """, own AS (SELECT fixture_id, external_event_id AS event_id, updated_at, true AS linked FROM links WHERE fixture_id % 2 = 0 AND regexp_matches(source_url, '/E?[0-9]+(?:/F|/?$)')),
    seen AS (SELECT fixture_id, external_event_id AS event_id, updated_at, false AS linked FROM links WHERE regexp_matches(source_url, '/E?[0-9]+(?:/F|/?$)') AND external_event_id % 3 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id ORDER BY linked DESC, updated_at DESC, event_id DESC) AS k FROM (SELECT * FROM own UNION ALL SELECT * FROM seen) WHERE fixture_id IN (SELECT fixture_id FROM fixtures))
    SELECT fixture_id, event_id, linked FROM r WHERE k = 1"""
)
def w04_cached_links(spark, d):
    links = table(spark, d, "links").select("fixture_id", F.col("external_event_id").alias("event_id"), "source_url", F.lit("a").alias("home_team"), F.lit("b").alias("away_team"), "updated_at")
    snapshots = links.filter("event_id % 3 = 0").withColumn("raw", F.to_json(F.struct(F.col("fixture_id").cast("string").alias("fixtureId")))).drop("fixture_id")
    return discovery.cached_links(table(spark, d, "fixtures"), links.filter("fixture_id % 2 = 0"), snapshots).select("fixture_id", "event_id", "linked")


@query(
    _FIXTURES
    + """, a AS (SELECT * FROM fixtures WHERE fixture_id % 3 = 0), b AS (SELECT DISTINCT league_id, home_team, away_team FROM fixtures WHERE fixture_id % 3 = 1),
    u AS (SELECT league_id, home_team, away_team FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.league_id = b.league_id AND a.home_team = b.home_team AND a.away_team = b.away_team))
    SELECT league_id, count(*) AS n_events, count(DISTINCT home_team || '|' || away_team) AS n_pairs FROM u GROUP BY 1"""
)
def e13_merged_listing(spark, d):
    events = table(spark, d, "fixtures").select("fixture_id", "league_id", "home_team", "away_team")
    out = discovery.merged_listing(events.filter("fixture_id % 3 = 0"), events.filter("fixture_id % 3 = 1"), "league_id")
    return out.groupBy("league_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct(F.concat_ws("|", "home_team", "away_team")).alias("n_pairs"))


@query("SELECT o_custkey AS fixture_id, arg_min(o_orderkey, (CAST(o_orderkey % 3 AS INTEGER), -round(o_totalprice / 500000, 2), o_orderkey)) AS event_id FROM orders GROUP BY 1")
def e14_first_hit(spark, d):
    found = table(spark, d, "orders").select(F.col("o_custkey").alias("fixture_id"), (F.col("o_orderkey") % 3).cast("int").alias("nth"), F.col("o_orderkey").alias("event_id"), F.round(F.col("o_totalprice") / 500000, 2).alias("score"))
    return discovery.first_hit(found).select("fixture_id", "event_id")


@query(_FIXTURES + " SELECT fixture_id, fixture_id % 5 = 0 AS second, fixture_id % 5 <> 0 OR league_id < 25 AS cleaned FROM fixtures WHERE fixture_id % 5 = 0 OR fixture_id % 5 <> 0")
def e09_two_phases(spark, d):
    """What the second phase looks for, and what a run may clean: leagues from 25 on had errors, so there only what was linked."""
    fixtures = table(spark, d, "fixtures")
    linked = fixtures.filter("fixture_id % 5 <> 0")
    second = discovery.second_phase(fixtures, linked).select("fixture_id", F.lit(True).alias("second"))
    clean = discovery.cleanup_fixtures(fixtures.filter("league_id < 25"), linked, 0).unionByName(discovery.cleanup_fixtures(fixtures.filter("league_id >= 25"), linked, 1)).withColumn("cleaned", F.lit(True))
    out = fixtures.select("fixture_id").join(second, "fixture_id", "left").join(clean, "fixture_id", "left")
    return out.select("fixture_id", F.coalesce("second", F.lit(False)).alias("second"), F.coalesce("cleaned", F.lit(False)).alias("cleaned"))


@query("SELECT DISTINCT split_part(p_name, ' ', 1) AS word, regexp_matches(upper(split_part(p_name, ' ', 1)), '^[A-Z]+$') AS found FROM part")
def n14_search_pattern(spark, d):
    """Every word's pattern finds the word in capitals."""
    words = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()
    return words.select("word", F.regexp_like(F.upper("word"), F.concat(F.lit("(?i)^"), text.search_pattern(F.col("word")), F.lit("$"))).alias("found"))


@query(
    f"""SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN '{AS_OF}' WHEN p_size % 4 = 1 THEN '2000-02-02' WHEN p_size % 4 = 2 THEN '2000-02-02' ELSE '{AS_OF}' END AS date_key FROM part
    WHERE p_size % 4 <> 0"""
)
def a35_event_timing(spark, d):
    """Labels of tomorrow, of a day and month, and of neither; today isn't allowed where it is said."""
    from oddsweave.functions import rules

    label = F.element_at(F.array(*map(F.lit, ("Hoje", "Amanh\u00e3", "2/2", "?"))), (F.col("p_size") % 4 + 1).cast("int"))
    keys = F.when(F.col("p_size") % 4 == 0, F.array(F.lit("2000-02-02"))).otherwise(F.array(F.lit(AS_OF), F.lit("2000-02-02")))
    out = table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.event_timing(label, F.lit("20:30"), F.to_date(F.lit(AS_OF)), keys).alias("t"))
    return out.filter("t IS NOT NULL").select("id", "t.date_key")
