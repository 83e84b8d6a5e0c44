"""What to collect: canonical pages, leagues, links, listings, searches."""

import json
import re

import pytest
from pyspark.sql import functions as F

from oddsweave.functions import text
from oddsweave.operators import discovery
from oddsweave.sources import feeds, pages


def test_canonical_pages(spark):
    one = {"fixture": {"id": 7, "date": "2026-08-05T20:00:00+00:00", "status": {"short": "NS"}}, "league": {"id": 71, "name": "A", "country": "Brazil", "season": 2026}, "teams": {"home": {"id": 1, "name": "x"}, "away": {"id": 2, "name": "y"}}}
    rows = [json.dumps({"errors": [], "response": [one, one]}), json.dumps({"errors": [], "response": {}}), json.dumps({"response": [one]})]
    got = discovery.api_fixtures(spark.createDataFrame([(r,) for r in rows], "value string")).collect()
    assert len(got) == 3 and (got[0].fixture_id, got[0].home_team, got[0].status, got[0].starts_at.hour) == (7, "x", "NS", 20)
    bad = spark.createDataFrame([(json.dumps({"errors": {"token": "gone"}, "response": []}),)], "value string")
    with pytest.raises(Exception, match="page with errors"):
        discovery.api_fixtures(bad).collect()
    seasons = [{"year": 2024, "current": False}, {"year": 2025, "current": True}, {"year": 2026, "current": False}]
    page = {"errors": [], "response": [{"league": {"id": k, "name": "L"}, "country": {"name": "C"}, "seasons": s} for k, s in ((1, seasons), (2, seasons[:1] + seasons[2:]), (3, []))]}
    got = {r.league_id: r.season for r in discovery.league_catalog(spark.createDataFrame([(json.dumps(page),)], "value string")).collect()}
    assert got == {1: 2025, 2: 2026, 3: None}


def test_league_selection(spark):
    leagues = spark.createDataFrame([(1, "Serie A", "Brazil"), (2, "Premier League", "England"), (3, "Friendlies", "World"), (4, "Unknown Cup", None)], "league_id long, league_name string, country string")
    listed = spark.createDataFrame([("/a", "Brasileirao Serie A", "Brasil"), ("/b", "Copa", "Brasil"), ("/c", "Premier League", "Inglaterra"), ("/d", "Amistosos", "Mundo"), (None, "Serie A", "x")], "url string, name string, region string")
    names = spark.createDataFrame([("Brazil", "Brasil"), ("Brazil", "Brazil"), ("England", "Inglaterra")], "country string, alias string")
    got = {(r.league_id, r.url): round(r.score, 2) for r in discovery.selected_leagues(leagues, listed, names).collect()}
    assert got == {(1, "/a"): 0.5, (1, "/b"): 0.5, (2, "/c"): 0.5, (3, "/d"): 0.96}
    plain = {(r.league_id, r.url): round(r.score, 2) for r in discovery.selected_leagues(leagues, listed).collect()}
    assert plain == {(1, "/a"): 0.84, (2, "/c"): 1.0, (3, "/d"): 0.96}
    ids = spark.createDataFrame([(1, 10), (2, None), (9, 11)], "league_id long, champ_id long")
    assert [r.champ_id for r in discovery.champ_ids(leagues, ids).collect()] == [10]


def test_links_from_cache_and_snapshots(spark):
    fixtures = spark.createDataFrame([(1,), (2,), (3,), (4,)], "fixture_id long")
    links = spark.createDataFrame([(1, 10, "/e/10", "a", "b", 1), (1, 11, "/e/11", "a", "b", 2), (2, 20, "/nothing", "a", "b", 9)], "fixture_id long, event_id long, source_url string, home_team string, away_team string, updated_at long")
    raw = lambda f: json.dumps({"fixtureId": f})
    snapshots = spark.createDataFrame([(12, "/e/12", "a", "b", 99, raw("1")), (21, "/e/21", "a", "b", 1, raw("2")), (22, "/e/22", "a", "b", 2, raw("2")), (30, "/e/30", None, "b", 1, raw("3")), (40, "/e/40", "a", "b", 1, "no json")], "event_id long, source_url string, home_team string, away_team string, updated_at long, raw string")
    got = {r.fixture_id: (r.event_id, r.linked) for r in discovery.cached_links(fixtures, links, snapshots).collect()}
    assert got == {1: (11, True), 2: (22, False)}


def test_listings_searches_and_phases(spark):
    event = "page_id long, home_team string, away_team string, nth long"
    first = spark.createDataFrame([(1, "a", "b", 1)], event)
    more = spark.createDataFrame([(1, "a", "b", 2), (1, "c", "d", 3), (1, "c", "d", 3), (2, "a", "b", 4)], event)
    assert sorted(tuple(r) for r in discovery.merged_listing(first, more).collect()) == [(1, "a", "b", 1), (1, "c", "d", 3), (2, "a", "b", 4)]
    found = spark.createDataFrame([(1, 2, 5, 0.99), (1, 1, 6, 0.7), (1, 1, 7, 0.8), (2, 3, 8, 0.6)], "fixture_id long, nth int, event_id long, score double")
    assert {(r.fixture_id, r.event_id) for r in discovery.first_hit(found).collect()} == {(1, 7), (2, 8)}
    events = spark.createDataFrame([("t1", "Brasileirao Serie A"), ("t2", "La Liga"), (None, "Serie A")], "tournament_id string, tournament_name string")
    missing = spark.createDataFrame([("Serie A Brasileirao",)], "league_name string")
    assert [r.tournament_id for r in discovery.fallback_tournaments(events, missing).collect()] == ["t1"]
    fixtures = spark.createDataFrame([(1, 5, "2026-08-05", "Sao Paulo", "Santos"), (2, 5, "2026-08-05", "Bahia", "Vitoria")], "fixture_id long, league_id long, date_key string, home_team string, away_team string")
    listed = spark.createDataFrame([(5, "2026-08-05", "Sao Paulo FC", "Santos SP"), (5, "2026-08-06", "Bahia", "Vitoria")], "league_id long, date_key string, home_team string, away_team string")
    assert [(r.fixture_id, r.home_team) for r in discovery.listed_events(fixtures, listed).collect()] == [(1, "Sao Paulo FC")]
    one = fixtures.filter("fixture_id = 1")
    assert [r.fixture_id for r in discovery.second_phase(fixtures, one).collect()] == [2]
    assert {r.fixture_id for r in discovery.cleanup_fixtures(fixtures, one, 0).collect()} == {1, 2} and [r.fixture_id for r in discovery.cleanup_fixtures(fixtures, one, 3).collect()] == [1]


@pytest.mark.parametrize("token,hits,misses", [("sao", ["SÃO", "s.a.o", "são"], ["soa"]), ("gremio", ["Grêmio", "GREMIO"], ["gre-mio"]), ("u20", ["U20", "ú20"], ["u-20"]), ("ca.b", ["CA.B", "çá.b"], ["caxb"])])
def test_search_patterns(spark, token, hits, misses):
    pattern = spark.range(1).select(text.search_pattern(F.lit(token)).alias("p")).first().p
    assert all(re.search(pattern, h, re.I) for h in hits) and not any(re.fullmatch(pattern, m, re.I) for m in misses)


def test_node_markets_and_price_keys(spark):
    offers = "|".join(f"PA;NA={n};{k}=1/1" for n, k in (("a", "OD"), ("Draw", "O"), ("b", "SP")))
    rows = [(1, f"EV;NA=e|MG;NA=Vencedor da partida|{offers}"), (2, f"EV;NA=e|MG;NA=1x2|{offers}"), (3, f"EV;NA=e|MG;NA=Match Result Early Pay Out|{offers}"), (4, f"EV;NA=e|MG;NA=Full Time Result|{offers.replace('OD', 'OH')}")]
    got = {(r.page_id, r.pa_category) for r in pages.node_prices(spark.createDataFrame(rows, "page_id long, value string")).collect()}
    assert got == {(1, "SEM_PA"), (3, "COM_PA")}


def test_visible_market_ends_at_short_lines_of_other_markets(spark):
    body = "\n".join(["Resultado Final", "Casa 2.00", "Primeiro tempo escanteios extra", "Mais 1.50", "Menos 2.50"])
    assert pages.visible_markets(spark.createDataFrame([(1, body)], "page_id long, text string")).count() == 0


def test_markets_by_id_and_ids_by_letters(spark):
    one = spark.sql("SELECT array(named_struct('id', 'a', 'uniqueId', 'x', 'v', 1), named_struct('id', '', 'uniqueId', 'b', 'v', 2), named_struct('id', CAST(NULL AS STRING), 'uniqueId', CAST(NULL AS STRING), 'v', 3), named_struct('id', 'a', 'uniqueId', 'y', 'v', 4)) AS m")
    name = lambda m: F.coalesce(F.nullif(m["id"], F.lit("")), F.nullif(m["uniqueId"], F.lit("")))
    assert [r.v for r in one.select(F.explode(feeds._last_by_id(F.col("m"), name)).alias("m")).select("m.*").collect()] == [4, 2]
    assert spark.range(1).select(feeds._letters(F.lit("abé")).alias("n")).first().n == 97 + 98 + 233
