"""Snapshots: nested markets, raw JSON, guards."""

import json

from pyspark.sql import functions as F

from oddsweave.functions import rules, text
from oddsweave.operators import discovery, snapshots

MARKETS = "id long, markets array<struct<paCategory string, selections array<struct<selection string, price double>>>>"


def test_valid_markets(spark):
    three = [("HOME", 2.0), ("DRAW", 3.0), ("AWAY", 4.0)]
    rows = [(1, [("COM_PA", three), ("OTHER", three), ("SEM_PA", three[:2]), ("SEM_PA", [*three[:2], ("AWAY", 1.0)])]), (2, None)]
    got = {r.id: len(r.markets) for r in snapshots.valid_markets(spark.createDataFrame(rows, MARKETS)).collect()}
    assert got == {1: 1, 2: 0}


def test_raw_json(spark):
    rows = spark.createDataFrame([('{"a": "1", "failCount": 2}', True), ("{}", True), (None, False), ("no", True)], "raw string, failed boolean")
    got = [json.loads(r.v) for r in rows.select(snapshots.counted_failure(F.col("raw"), F.col("failed")).alias("v")).collect()]
    assert got == [{"a": "1", "failCount": 3}, {"failCount": 1}, {"failCount": 0}, {"failCount": 1}]
    nested = spark.createDataFrame([('{"a":{"b":[1,{"c":null}]},"n":3,"x":1.5,"t":"3","z":null,"stage":"new"}',), ("[1]",), ('"s"',)], "raw string")
    got = [json.loads(r.v) for r in nested.select(snapshots.merged_raw(F.col("raw"), stage=F.lit("matched"), score=F.lit(0.5), other=F.lit(None).cast("string")).alias("v")).collect()]
    assert got == [{"a": {"b": [1, {"c": None}]}, "n": 3, "x": 1.5, "t": "3", "z": None, "stage": "matched", "score": 0.5, "other": None}] + [{"stage": "matched", "score": 0.5, "other": None}] * 2
    links = spark.createDataFrame([("https://x/E12/F", '{"failCount": 2}'), ("https://x/12", '{"failCount": 3}'), ("https://x/", None)], "source_url string, raw string")
    assert snapshots.usable_links(links).count() == 1


def test_guards(spark):
    matches = spark.createDataFrame([(1, "a", 10), (2, "a", 20)], "fixture_id long, bookmaker string, event_id long")
    links = spark.createDataFrame([(1, "a", 11), (2, "a", 20)], "fixture_id long, bookmaker string, event_id long")
    assert [r.event_id for r in snapshots.without_other_link(matches, links).collect()] == [20]
    pages = spark.createDataFrame([("Boca Juniors", "Tigre", "Tigre", "Boca Juniors"), ("Boca Juniors", "Tigre", "PPPP", "Wdddd")], "expected_home string, expected_away string, home_team string, away_team string")
    assert snapshots.right_event(pages).count() == 1


def test_mentions(spark):
    page = spark.createDataFrame([("Hoje: São Paulo x Santos", ["Sao Paulo FC"]), ("Hoje: Santos", ["Sao Paulo"]), ("x", None), ("Brasil Sub 20 x Chile", ["brazil u20", "brasil u20"]), ("Brasil x Chile", ["brasil u20"]), ("the city", ["City"])], "p string, n array<string>")
    assert [r.v for r in page.select(text.mentions(F.col("p"), F.col("n")).alias("v")).collect()] == [True, False, False, True, False, False]
    rows = spark.createDataFrame([("19:30 Sao Paulo - Santos", ["sao paulo"], ["santos"], "2026-08-05 22:30:00"), ("Santos", ["sao paulo"], ["santos"], None)], "text string, home_names array<string>, away_names array<string>, at string")
    got = snapshots.page_evidence(rows.withColumn("starts_at", F.col("at").cast("timestamp"))).collect()
    assert [(r.has_home, r.has_away, r.has_both, r.has_time) for r in got] == [(True, True, True, True), (False, True, False, False)]


def test_merged_markets(spark):
    three = ["HOME", "DRAW", "AWAY"]
    rows = [
        (1, True, 0, "SEM_PA", three, "Full Time Result"), (1, True, 1, "SEM_PA", three, "Resultado Final"), (1, False, 0, "SEM_PA", three, "resultado final"), (1, False, 1, "COM_PA", three, "x"), (1, True, 2, "COM_PA", three[:2], "y"),
        (2, False, 0, "SEM_PA", three, "a"), (2, False, 1, "SEM_PA", three, "b"),
        (3, True, 5, "COM_PA", three, "z"), (3, False, 0, "SEM_PA", three, None), (3, False, 1, "SEM_PA", three, "w"),
    ]
    got = snapshots.merged_markets(spark.createDataFrame(rows, "event_id long, visible boolean, place int, pa_category string, selections array<string>, raw_text string")).collect()
    assert sorted((r.event_id, r.position, r.pa_category, r.visible, r.place) for r in got) == [(1, 0, "SEM_PA", True, 1), (1, 1, "COM_PA", False, 1), (2, 0, "SEM_PA", False, 0), (2, 1, "SEM_PA", False, 1), (3, 0, "COM_PA", True, 5), (3, 1, "SEM_PA", False, 0)]


def test_weighted_tournaments(spark):
    leagues = spark.createDataFrame([(1, "Serie A", "Brazil"), (2, "Serie A", "Italy"), (3, "Premier League", None), (4, "Eredivisie", "Netherlands")], "league_id long, league_name string, country string")
    tournaments = spark.createDataFrame([("a", "Brasileirao Serie A", "2026", ["Futebol", "Brasil"]), ("b", "Serie A", None, ["Italia"]), ("c", "Premier League", None, ["Inglaterra"]), ("d", "Serie B", None, ["Brasil"])], "tournament_id string, tournament_name string, season_name string, path array<string>")
    countries = spark.createDataFrame([("brazil", "brasil"), ("brazil", "bra"), ("italy", "italia")], "country string, alias string")
    got = discovery.weighted_tournaments(leagues, tournaments, countries).collect()
    assert {(r.league_id, r.tournament_id): round(r.score, 6) for r in got if r.tournament_id in "ab"} == {(1, "a"): 1.0, (2, "b"): 1.0}
    assert not [r for r in got if r.league_id in (3, 4)]  # half a country is below its gate


def test_feed_clock_and_keywords(spark):
    rows = spark.createDataFrame([("Hoje", "19:00"), ("Amanhã", "9:05"), ("06.8", "22:30"), ("?", "01:00"), ("07/08", "x")], "label string, clock string")
    timing = lambda keys: [(r.v.date_key, r.v.starts_at and r.v.starts_at.isoformat()) if r.v else None for r in rows.select(rules.event_timing(F.col("label"), F.col("clock"), F.to_date(F.lit("2026-08-05")), F.array(*map(F.lit, keys))).alias("v")).collect()]
    assert timing(["2026-08-05", "2026-08-06"]) == [("2026-08-05", "2026-08-05T22:00:00"), ("2026-08-06", "2026-08-06T12:05:00"), ("2026-08-06", "2026-08-07T01:30:00"), ("2026-08-05", "2026-08-05T04:00:00"), ("2026-08-05", None)]
    assert timing(["2026-08-06"])[:2] == [None, ("2026-08-06", "2026-08-06T12:05:00")]  # today isn't allowed
    name = spark.createDataFrame([("FC São Paulo (BRA) Futebol Clube",)], "n string")
    assert name.select(text.search_keywords(F.col("n")).alias("v")).first().v == ["sao paulo futebol clube", "sao paulo futebol", "sao paulo", "sao"]
