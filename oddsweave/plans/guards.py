"""Queries of rules on names, pages, captures, links and syncs that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.functions import text
from oddsweave.operators import control, discovery, matching, snapshots, writepath
from oddsweave.plans.catalog import query
from oddsweave.plans.payloads import parts, payloads, rule_sql
from oddsweave.sources import pages
from oddsweave.sources.tables import table, with_views

_NORM = "trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"
#: Team names of many shapes, one per part.
_TEAMS = """SELECT p_partkey AS k, concat(CASE p_partkey % 9 WHEN 0 THEN 'FC ' WHEN 1 THEN 'Clube de ' WHEN 2 THEN 'A B ' WHEN 3 THEN 'North ' ELSE '' END, split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2),
    CASE p_partkey % 7 WHEN 0 THEN ' Sub 20' WHEN 1 THEN ' U19' WHEN 2 THEN ' II' WHEN 3 THEN ' (W)' WHEN 4 THEN ' (Esports)' WHEN 5 THEN ' 1999' ELSE '' END) AS name FROM part"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SAFE = ", ".join(f"'{w}'" for w in text.SAFE_SHORT_TOKENS)
_TOKENS = f"list_filter(string_split(regexp_replace(regexp_replace({_NORM}, '\\bsub\\s*(\\d{{{{2}}}})\\b', 'u\\1', 'g'), '^a b ', 'ab '), ' '), lambda t: t <> '' AND t NOT IN ({_STOP}))"
_PROFILE = f"list_distinct(list_filter({_TOKENS.format('name')}, lambda t: len(t) >= 2 OR t IN ({_SAFE})))"


def _teams(spark, d):
    return spark.sql(_TEAMS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


@query(f"SELECT k, array_to_string(list_sort({_PROFILE}), ' ') AS token_key, len({_PROFILE}) AS n_tokens FROM ({_TEAMS}) q")
def n10_profile(spark, d):
    """A name's tokens in order and their number."""
    p = text.profile(F.col("name"))
    return _teams(spark, d).select("k", p["token_key"].alias("token_key"), F.size(p["tokens"]).cast("bigint").alias("n_tokens"))


@query(
    f"""SELECT k, array_to_string(list_sort(list_concat(CASE WHEN list_contains(t, 'north') THEN ['direction:north'] ELSE [] END, CASE WHEN list_contains(t, 'ii') THEN ['squad:ii'] ELSE [] END,
    list_transform(list_filter(t, lambda x: regexp_full_match(x, 'u\\d{{2}}')), lambda x: concat('age:', x)))), ' ') AS keys FROM (SELECT k, {_PROFILE} AS t FROM ({_TEAMS}) q) q"""
)
def n12_telling_keys(spark, d):
    """What sets teams of one name apart."""
    return _teams(spark, d).select("k", F.array_join(text.distinguishing_keys(text.profile_tokens(F.col("name"))), " ").alias("keys"))


_ALIAS_STOP = ", ".join(f"'{w}'" for w in text.ALIAS_STOP_WORDS)
_PARTS = f"list_filter(string_split(regexp_replace({_NORM}, '\\bsub\\s*(\\d{{{{2}}}})\\b', 'u\\1', 'g'), ' '), lambda t: len(t) >= 2 AND t NOT IN ({_ALIAS_STOP}) AND NOT regexp_full_match(t, '\\d+'))"
_TELL = "list_filter({0}, lambda t: len(t) >= 3)"


@query(f"SELECT k, array_to_string({_PARTS.format('name')}, ' ') AS parts FROM ({_TEAMS}) q")
def n17_alias_tokens(spark, d):
    """Tokens of an alias."""
    return _teams(spark, d).select("k", F.array_join(text.alias_parts(F.col("name")), " ").alias("parts"))


_AGE = "list_filter({0}, lambda t: regexp_full_match(t, 'u\\d{{2}}'))[1]"


@query(
    f"""WITH n AS ({_TEAMS}), p AS (SELECT a.k, {_PARTS.format('a.name')} AS want, string_split(regexp_replace({_NORM.format("concat('Hoje: ', b.name, ' x Outro')")}, '\\bsub\\s*(\\d{{2}})\\b', 'u\\1', 'g'), ' ') AS words FROM n a JOIN n b ON b.k = a.k + 7)
    SELECT k, len({_TELL.format('want')}) > 0 AND coalesce(list_contains(words, {_AGE.format('want')}), true) AND list_has_all(words, {_TELL.format('want')}[1:4]) AS mentioned FROM p"""
)
def n18_mentions(spark, d):
    """A page's text has a name's age and first four telling tokens."""
    names = _teams(spark, d)
    shown = names.select((F.col("k") - 7).alias("k"), F.concat(F.lit("Hoje: "), "name", F.lit(" x Outro")).alias("page"))
    return names.join(shown, "k").select("k", text.mentions(F.col("page"), F.array("name")).alias("mentioned"))


@query(
    f"""WITH n AS ({_TEAMS}), p AS (SELECT a.k, {_PARTS.format('a.name')} AS x, {_PARTS.format('b.name')} AS y FROM n a JOIN n b ON b.k = a.k + 7)
    SELECT k, {_AGE.format('x')} IS NOT DISTINCT FROM {_AGE.format('y')} AND list_has_any({_TELL.format('x')}, {_TELL.format('y')}) AS overlap FROM p"""
)
def n19_groups_overlap(spark, d):
    """Two names share a telling token where their ages agree."""
    names = _teams(spark, d)
    other = names.select((F.col("k") - 7).alias("k"), F.col("name").alias("other"))
    return names.join(other, "k").select("k", text.groups_overlap(F.array("name"), F.array("other")).alias("overlap"))


@query(f"SELECT k, name LIKE '%(Esports)' OR k % 11 = 0 AS simulated FROM ({_TEAMS}) q")
def n20_virtual(spark, d):
    """Qualifiers in brackets that real teams don't have, and leagues of simulations."""
    league = F.when(F.col("k") % 11 == 0, "e Soccer Battle").otherwise("Liga")
    return _teams(spark, d).select("k", text.looks_virtual(league, F.col("name"), F.lit("Outro")).alias("simulated"))


_CORE = f"trim(regexp_replace({_NORM.format(chr(39).join(['regexp_replace(name, ', chr(92) + '([^)]*' + chr(92) + ')', ', ', ' ', ', ', 'g', ')']))}, '^(({'|'.join(text.NAME_STOP_WORDS)})\\s+)+', ''))"


@query(f"SELECT k, array_to_string(list_distinct([c, array_to_string(string_split(c, ' ')[1:3], ' '), array_to_string(string_split(c, ' ')[1:2], ' '), string_split(c, ' ')[1]]), '|') IS NOT NULL AS any_keyword, c AS first_keyword, len(list_distinct(list_filter([c, array_to_string(string_split(c, ' ')[1:3], ' '), array_to_string(string_split(c, ' ')[1:2], ' '), string_split(c, ' ')[1]], lambda x: x <> ''))) AS n_keywords FROM (SELECT k, {_CORE} AS c FROM ({_TEAMS}) q) q")
def a36_keywords(spark, d):
    """Search words of a name: the whole and its first tokens."""
    words = text.search_keywords(F.col("name"))
    return _teams(spark, d).select("k", (F.size(words) > 0).alias("any_keyword"), F.get(words, 0).alias("first_keyword"), F.size(words).cast("bigint").alias("n_keywords"))


# --- captures

_LINK = """SELECT o_orderkey AS event_id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('https://x/E', CAST(o_orderkey AS VARCHAR(20)), '/F') WHEN 2 THEN concat('https://x/', CAST(o_orderkey AS VARCHAR(20))) WHEN 3 THEN 'https://x/list' ELSE concat('https://x/E', CAST(o_orderkey AS VARCHAR(20)), '/F2') END AS source_url,
    CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE concat('{"failCount": ', CAST(o_orderkey % 7 AS VARCHAR(20)), '}') END AS raw FROM orders"""


@query(f"SELECT event_id FROM ({_LINK}) q WHERE regexp_matches(source_url, '/E?\\d+(/F|/?$)') AND coalesce(CAST(json_extract_string(raw, '$.failCount') AS INTEGER), 0) < 3")
def f12_usable_links(spark, d):
    """Links with an event's address that haven't failed three times."""
    rows = spark.sql(_LINK.replace("FROM orders", "FROM {orders}").replace('{"failCount": ', '{{"failCount": ').replace("}')", "}}')"), orders=table(spark, d, "orders"))
    return snapshots.usable_links(rows).select("event_id")


F13 = [
    {"markets": [{"paCategory": "SEM_PA", "selections": [{"selection": s, "price": f"#{k}"} for k, s in ((1, "HOME"), (2, "DRAW"), (3, "AWAY"))]}]},
    {"markets": [{"paCategory": "OTHER", "selections": [{"selection": s, "price": "#1"} for s in ("HOME", "DRAW", "AWAY")]}, {"paCategory": "COM_PA", "selections": [{"selection": s, "price": "#1"} for s in ("HOME", "DRAW", "AWAY", "AWAY")]}]},
    {"markets": [{"paCategory": "COM_PA", "selections": [{"selection": "HOME", "price": "#1"}, {"selection": "DRAW", "price": "#2"}]}, {"paCategory": "SEM_PA", "selections": [{"selection": s, "price": 1} for s in ("HOME", "DRAW", "AWAY")]}]},
    {"markets": [{"paCategory": "COM_PA", "selections": [{"selection": s, "price": "#2"} for s in ("HOME", "DRAW", "AWAY", "OVER")]}]},
    {"markets": None},
]


@query(
    rule_sql(
        F13,
        """m AS (SELECT k, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p WHERE json_type(e->'$.markets') = 'ARRAY'),
r AS (SELECT k, count(*) AS n FROM m WHERE m->>'$.paCategory' IN ('COM_PA', 'SEM_PA') AND len(list_filter(CAST(m->'$.selections' AS JSON[]), lambda s: s->>'$.selection' NOT IN ('HOME', 'DRAW', 'AWAY') OR CAST(s->>'$.price' AS DOUBLE) <= 1)) = 0
  AND len(list_distinct(list_transform(CAST(m->'$.selections' AS JSON[]), lambda s: s->>'$.selection'))) = 3 GROUP BY k)""",
        "SELECT p.k, coalesce(n, 0) AS n_markets FROM p LEFT JOIN r ON r.k = p.k",
    )
)
def f13_valid_markets(spark, d):
    """Markets of a capture that are whole and known."""
    shape = "markets array<struct<paCategory:string, selections:array<struct<selection:string, price:double>>>>"
    rows = payloads(spark, d, F13).select(F.col("key").alias("k"), F.from_json("value", shape)["markets"].alias("markets"))
    return snapshots.valid_markets(rows).select("k", F.size("markets").cast("bigint").alias("n_markets"))


@query(
    """SELECT p_partkey AS k, p_partkey % 2 = 0 AS has_home, p_partkey % 3 = 0 AS has_away, p_partkey % 6 = 0 AS has_both, p_partkey % 5 = 0 AS has_time FROM part"""
)
def f16_page_evidence(spark, d):
    """Names of either side and the local time in a page's text (F16)."""
    k = F.col("p_partkey")
    at = F.timestamp_seconds(F.lit(1786042800) + (k % 24) * 3600)
    shown = F.date_format(F.from_utc_timestamp(at, "America/Sao_Paulo"), "HH:mm")
    body = F.concat_ws(" ", F.when(k % 2 == 0, "Atlético Mineiro"), F.lit("x"), F.when(k % 3 == 0, "Grêmio Novorizontino"), F.when(k % 5 == 0, shown).otherwise("99:99"))
    rows = table(spark, d, "part").select(k.alias("k"), body.alias("text"), F.array(F.lit("galo"), F.lit("atletico mineiro")).alias("home_names"), F.array(F.lit("Novorizontino")).alias("away_names"), at.alias("starts_at"))
    return snapshots.page_evidence(rows).select("k", "has_home", "has_away", "has_both", "has_time")


@query("SELECT p_partkey AS page_id, CASE WHEN p_partkey % 2 = 0 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, round(2 + p_size / 100.0, 2) AS home, round(3 + p_size / 100.0, 2) AS draw, round(4 + p_size / 100.0, 2) AS away FROM part")
def s25_visible_markets(spark, d):
    """Visible result markets of a page: the first three price rows."""
    shown = lambda k: F.format_string("%.2f", k + 1 + F.col("p_size") / 100)
    early = F.col("p_partkey") % 2 == 0
    body = F.concat_ws("\n", F.lit("Both Teams To Score"), F.lit("9.99"), F.when(early, "Full Time Result Early Payout").otherwise("Full Time Result"), F.lit("Casa"), shown(1), F.concat(F.lit("Draw "), shown(2)), F.lit("Fora"), shown(3), F.lit("outro 8.88"), F.lit("Total Goals"), F.lit("Over 1.50"))
    got = pages.visible_markets(parts(spark, d).select(F.col("p_partkey").alias("page_id"), body.alias("text")))
    return got.select("page_id", "pa_category", *(F.round(c, 2).alias(c) for c in ("home", "draw", "away")))


_CAPTURED = """SELECT l_orderkey AS event_id, l_linenumber % 2 = 0 AS visible, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS place, CASE WHEN l_partkey % 2 = 0 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category,
    CAST(l_suppkey % 4 AS INTEGER) AS sides, CASE l_partkey % 3 WHEN 0 THEN 'Full Time Result' WHEN 1 THEN 'RESULTADO FINAL - early payout' END AS raw_text FROM lineitem WHERE l_orderkey % 5 = 0"""


@query(
    f"""WITH m AS (SELECT *, least(sides, 3) + CASE WHEN raw_text IS NULL THEN 0 WHEN raw_text LIKE '%early%' THEN 2 ELSE 1 END AS score, bool_or(visible) OVER (PARTITION BY event_id) AS seen FROM ({_CAPTURED}) q),
    v AS (SELECT * FROM m WHERE visible QUALIFY row_number() OVER (PARTITION BY event_id, pa_category ORDER BY score DESC, place DESC) = 1),
    y AS (SELECT * FROM m WHERE NOT visible AND seen QUALIFY row_number() OVER (PARTITION BY event_id, pa_category ORDER BY score DESC, place) = 1),
    c AS (SELECT coalesce(v.event_id, y.event_id) AS event_id, CASE WHEN v.event_id IS NULL OR y.score > v.score THEN y.place ELSE v.place END AS place FROM v FULL JOIN y ON y.event_id = v.event_id AND y.pa_category = v.pa_category)
    SELECT event_id, place FROM c UNION ALL SELECT event_id, place FROM m WHERE NOT seen"""
)
def a22_merged_markets(spark, d):
    """Visible and payload markets of an event, one per category, ties by two rules."""
    rows = spark.sql(_CAPTURED.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))
    sides = F.slice(F.array(*map(F.lit, ("HOME", "DRAW", "AWAY"))), 1, F.col("sides"))
    return snapshots.merged_markets(rows.withColumn("selections", sides)).select("event_id", "place")


_MATCHED = "SELECT p_partkey AS fixture_id, p_partkey % 10 AS bookmaker, p_partkey + p_partkey % 3 AS event_id FROM part"


@query(f"SELECT m.* FROM ({_MATCHED}) m WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = m.fixture_id AND p.p_partkey % 2 = 0 AND p.p_partkey <> m.event_id)")
def e05_other_link(spark, d):
    """Matches whose fixture another event has already are refused."""
    part = table(spark, d, "part")
    matches = spark.sql(_MATCHED.replace("FROM part", "FROM {part}"), part=part)
    links = part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("fixture_id"), (F.col("p_partkey") % 10).alias("bookmaker"), F.col("p_partkey").alias("event_id"))
    return snapshots.without_other_link(matches, links).select("fixture_id", "bookmaker", "event_id")


@query("SELECT p_partkey AS k FROM part WHERE p_partkey % 4 IN (0, 1)")
def e12_right_event(spark, d):
    """Captured pages that show the expected sides, either way round."""
    k = F.col("p_partkey") % 4
    home, away = F.split_part("p_name", F.lit(" "), F.lit(1)), F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit("ense"))
    other = F.lit("Zyx Qvk")
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), home.alias("expected_home"), away.alias("expected_away"), F.when(k == 0, home).when(k == 1, away).when(k == 2, other).otherwise(other).alias("home_team"), F.when(k == 0, away).when(k == 1, home).otherwise(other).alias("away_team"))
    return snapshots.right_event(rows).select("k")


# --- listings and searches


@query(
    f"""{with_views("fixtures")}, e AS (SELECT o_orderkey AS event_id, CAST(o_custkey % 51 AS BIGINT) AS league_id FROM orders), m AS (SELECT league_id, count(*) AS many FROM fixtures GROUP BY league_id)
    SELECT event_id, e.league_id FROM (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY event_id) AS place FROM e) e JOIN m ON m.league_id = e.league_id WHERE place <= many"""
)
def w09_listed_up_to(spark, d):
    """Of a page's events as many as it has fixtures."""
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % 51).cast("bigint").alias("league_id"))
    return writepath.listed_up_to(events, table(spark, d, "fixtures"), ["league_id"], F.col("event_id")).select("event_id", "league_id")


@query(f"{with_views('fixtures')} SELECT fixture_id + 1000000 AS event_id, (SELECT min(g.fixture_id) FROM fixtures g WHERE g.league_id = f.league_id AND g.date_key = f.date_key AND g.home_team = f.home_team AND g.away_team = f.away_team) AS fixture_id FROM fixtures f WHERE fixture_id % 100 = 0")
def e10_listed_events(spark, d):
    """Events of a page and day with the first fixture that they resemble on both sides."""
    fixtures = table(spark, d, "fixtures")
    events = fixtures.filter("fixture_id % 100 = 0").select((F.col("fixture_id") + 1_000_000).alias("event_id"), "league_id", "date_key", F.upper("home_team").alias("home_team"), F.upper("away_team").alias("away_team"))
    return discovery.listed_events(fixtures, events, least=0.95).select("event_id", "fixture_id")


_LISTED = "SELECT p_partkey AS event_id, CAST(p_size AS BIGINT) AS page_id, split_part(p_name, ' ', 1) AS home_team, split_part(p_name, ' ', 2) AS away_team FROM part"


@query(
    f"""WITH l AS ({_LISTED}), f AS (SELECT * FROM l WHERE event_id % 3 = 0), r AS (SELECT * FROM l WHERE event_id % 50 = 0),
    s AS (SELECT page_id, home_team, away_team FROM l WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM f WHERE f.page_id = l.page_id AND f.home_team = l.home_team AND f.away_team = l.away_team) GROUP BY ALL),
    u AS (SELECT event_id, page_id, home_team, away_team FROM f UNION ALL SELECT NULL, page_id, home_team, away_team FROM s)
    SELECT page_id, home_team, away_team, count(*) AS n FROM u WHERE (event_id IS NULL OR event_id NOT IN (SELECT event_id FROM r)) AND concat(home_team, '|', away_team) NOT IN (SELECT concat(home_team, '|', away_team) FROM r) GROUP BY ALL"""
)
def e13_without_refreshed(spark, d):
    """Two listings of a page as one, without what has been collected anew, by id or pair."""
    rows = spark.sql(_LISTED.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    more = rows.filter("event_id % 3 <> 0").withColumn("event_id", F.lit(None).cast("bigint"))
    refreshed = rows.filter("event_id % 50 = 0").withColumn("home_team", F.upper("home_team"))
    out = discovery.merged_listing(rows.filter("event_id % 3 = 0"), more, refreshed=refreshed)
    return out.groupBy("page_id", "home_team", "away_team").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT p_partkey AS fixture_id, p_partkey * 10 AS event_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0")
def e15_cached_ids(spark, d):
    """Remembered event ids of fixtures that are still without an event."""
    part = table(spark, d, "part")
    cached = part.select(F.col("p_partkey").alias("fixture_id"), (F.col("p_partkey") * 10).alias("event_id"))
    return discovery.cached_ids(part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("fixture_id")), cached, part.filter("p_partkey % 5 = 0").select((F.col("p_partkey") * 10).alias("event_id"))).select("fixture_id", "event_id")


@query(
    """WITH l AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS league_id, concat('Liga ', CAST(p_size AS VARCHAR)) AS league_name, CASE p_size % 3 WHEN 0 THEN 'brazil' WHEN 1 THEN 'chile' END AS country FROM part),
    t AS (SELECT p_partkey AS tournament_id, concat('liga', CAST(p_size AS VARCHAR)) AS name, CASE p_partkey % 4 WHEN 0 THEN 'Brasil' WHEN 1 THEN 'Chile' WHEN 2 THEN 'bra' ELSE 'Zzz' END AS place FROM part),
    s AS (SELECT league_id, tournament_id, row_number() OVER (PARTITION BY league_id ORDER BY tournament_id) AS r FROM l JOIN t ON contains(t.name, replace(lower(l.league_name), ' ', '')) OR contains(replace(lower(l.league_name), ' ', ''), t.name)
          WHERE (country = 'brazil' AND place IN ('Brasil', 'bra')) OR (country = 'chile' AND place = 'Chile'))
    SELECT league_id, tournament_id, CAST(1 AS DOUBLE) AS score FROM s WHERE r <= 3"""
)
def j14_weighted_tournaments(spark, d):
    """Tournaments of a league by name and country, each behind a gate, the best three; here letters settle both."""
    part = table(spark, d, "part")
    k = F.col("p_size").cast("bigint")
    leagues = part.select(k.alias("league_id"), F.concat(F.lit("Liga "), k.cast("string")).alias("league_name"), F.when(k % 3 == 0, "brazil").when(k % 3 == 1, "chile").otherwise("xx").alias("country")).distinct()
    place = F.element_at(F.array(*map(F.lit, ("Brasil", "Chile", "bra", "Zzz"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    tournaments = part.select(F.col("p_partkey").alias("tournament_id"), F.concat(F.lit("liga"), k.cast("string")).alias("tournament_name"), F.lit(None).cast("string").alias("season_name"), F.array(F.lit("Futebol"), place).alias("path"))
    countries = spark.createDataFrame([("Brazil", "Brasil"), ("Brazil", "bra")], "country string, alias string")
    got = discovery.weighted_tournaments(leagues, tournaments, countries, least_name=1.0, least_country=1.0)
    return got.select("league_id", "tournament_id", F.round("score", 6).alias("score"))


@query(
    """WITH f AS (SELECT p_partkey AS fixture_id, p_partkey % 90 AS slot, concat('h', CAST(p_partkey % 40 AS VARCHAR)) AS h, concat('h', CAST(p_partkey * 7 % 40 AS VARCHAR)) AS a FROM part WHERE p_partkey % 25 = 0),
    e AS (SELECT p_partkey AS event_id, p_partkey % 90 AS slot, CASE WHEN p_partkey % 2 = 0 THEN concat('x', CAST(p_partkey % 40 AS VARCHAR)) ELSE concat('x', CAST(p_partkey * 7 % 40 AS VARCHAR)) END AS h, CASE WHEN p_partkey % 2 = 0 THEN concat('x', CAST(p_partkey * 7 % 40 AS VARCHAR)) ELSE concat('x', CAST(p_partkey % 40 AS VARCHAR)) END AS a FROM part),
    n AS (SELECT event_id, fixture_id, e.h AS eh, e.a AS ea, f.h AS fh, f.a AS fa, count(*) OVER (PARTITION BY event_id) AS many FROM e JOIN f USING (slot))
    SELECT event_id, fixture_id, CASE WHEN substr(eh, 2) = substr(fh, 2) AND substr(ea, 2) = substr(fa, 2) THEN 'NORMAL' ELSE 'INVERTED' END AS orientation FROM n
    WHERE many <= 30 AND ((substr(eh, 2) = substr(fh, 2) AND substr(ea, 2) = substr(fa, 2)) OR (substr(eh, 2) = substr(fa, 2) AND substr(ea, 2) = substr(fh, 2)))"""
)
def e06_pair_aliases(spark, d):
    """Events whose sides are both known under other names, straight before crossed."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    number = lambda letter, c: F.concat(F.lit(letter), (c % 40).cast("string"))
    at = F.timestamp_seconds(F.lit(1786042800) + (k % 90) * 86400)
    fixtures = part.filter("p_partkey % 25 = 0").select(k.alias("fixture_id"), at.alias("starts_at"), number("h", k).alias("home_team"), number("h", k * 7).alias("away_team"), F.lit("Liga").alias("league_name"))
    straight = k % 2 == 0
    events = part.select(k.alias("event_id"), at.alias("b_starts_at"), F.when(straight, number("x", k)).otherwise(number("x", k * 7)).alias("b_home_team"), F.when(straight, number("x", k * 7)).otherwise(number("x", k)).alias("b_away_team"), F.lit("Liga").alias("b_league_name"))
    known = part.select(number("h", k).alias("name_a"), number("x", k).alias("name_b"), F.lit(True).alias("same_team")).distinct()
    return matching.pair_alias_matches(fixtures, events, known, 1200, most=30).select("event_id", "fixture_id", "orientation")


@query(
    """WITH m AS (SELECT p_partkey % 700 AS team_id, concat('time ', CAST(p_partkey % 900 AS VARCHAR)) AS alias, concat('time ', CAST(p_partkey % 700 AS VARCHAR)) AS own FROM part)
    SELECT alias, min(team_id) AS team_id FROM m WHERE alias <> own AND alias NOT IN (SELECT concat('time ', CAST(p_partkey AS VARCHAR)) FROM part WHERE p_partkey % 10 = 0) GROUP BY alias HAVING count(DISTINCT team_id) = 1"""
)
def e08_learned_aliases(spark, d):
    """New names of matched teams, unless known or of two teams."""
    part, k = table(spark, d, "part"), F.col("p_partkey")
    named = lambda c: F.concat(F.lit("Time "), c.cast("string"))
    matched = part.select(named(k % 900).alias("name"), (k % 700).alias("team_id"), named(k % 700).alias("canonical"))
    return matching.learned_aliases(matched, part.filter("p_partkey % 10 = 0").select(F.lower(named(k)).alias("alias"))).select("alias", "team_id")


# --- write path and control


@query("SELECT o_orderkey AS external_event_id, CASE o_orderkey % 6 WHEN 0 THEN 'insert' WHEN 1 THEN 'stale' WHEN 2 THEN 'update' WHEN 3 THEN 'update' ELSE 'touch' END AS action FROM orders")
def u03_changed_links(spark, d):
    """Links that changed: confidence to three decimals, raw JSON by content."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("external_event_id"), (k % 10).alias("bookmaker"), F.col("o_custkey").alias("fixture_id"), F.lit("e").alias("event_name"), F.lit("h").alias("home_team"), F.lit(None).cast("string").alias("away_team"), F.timestamp_seconds(k).alias("starts_at"), F.lit(0.9).alias("confidence"), F.lit("u").alias("source_url"), F.lit('{"a": [1, 2], "b": null}').alias("raw"))
    new = rows.filter("external_event_id % 6 <> 1")
    new = new.withColumn("raw", F.when(F.col("external_event_id") % 6 == 2, '{"a": [2, 1], "b": null}').otherwise('{ "b" :null, "a":[1,2]}')).withColumn("confidence", F.when(F.col("external_event_id") % 6 == 3, 0.9012).otherwise(0.9002))
    return writepath.changed_links(rows.filter("external_event_id % 6 <> 0"), new).select("external_event_id", "action")


@query("SELECT p_partkey AS fixture_id FROM part WHERE NOT (p_size % 2 = 0 AND p_size < 40 AND p_partkey % 9 = 0)")
def u07_without_ineligible(spark, d):
    """Fixtures that a league of senior teams doesn't admit go."""
    part = table(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("fixture_id"), F.col("p_size").cast("bigint").alias("league_id"), F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.when(F.col("p_partkey") % 9 == 0, " Women").otherwise("")).alias("home_team"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("away_team"))
    leagues = part.filter("p_size < 40").select(F.col("p_size").cast("bigint").alias("league_id"), (F.col("p_size") % 2 == 0).alias("senior_only")).distinct()
    return writepath.without_ineligible(rows, leagues, ["home_team", "away_team"]).select("fixture_id")


@query(
    """WITH l AS (SELECT sha256(string_agg(CAST(league_id AS VARCHAR), ',' ORDER BY league_id)) AS h FROM (SELECT DISTINCT p_size AS league_id FROM part WHERE p_size % 5 <> 0) q)
    SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date_key, h AS league_hash FROM orders, l WHERE day(o_orderdate) % 4 <> 1"""
)
def u08_sync_due(spark, d):
    """Dates to fetch: never synced, too long ago, or for other leagues."""
    leagues = table(spark, d, "leagues")
    hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set("league_id")), lambda i: i.cast("string")), ","), 256)
    now = leagues.filter("enabled").agg(hashed.alias("h"))
    dates = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date_key")).distinct()
    kind = F.dayofmonth("date_key") % 4
    as_of = F.lit("2026-08-05 12:00:00").cast("timestamp")
    synced = dates.filter(kind > 0).join(F.broadcast(now)).select("date_key", F.when(kind == 2, as_of - F.expr("INTERVAL 721 MINUTES")).otherwise(as_of - F.expr("INTERVAL 719 MINUTES")).alias("synced_at"), F.when(kind == 3, "other").otherwise(F.col("h")).alias("league_hash"))
    return writepath.sync_due(dates, synced, leagues, as_of).select(F.col("date_key").cast("string").alias("date_key"), "league_hash")


@query(
    """WITH e AS (SELECT user_id AS lane, ts, CASE event_type WHEN 'click' THEN 'cycle-start' WHEN 'purchase' THEN 'cycle-end' ELSE 'heartbeat' END AS type FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'),
    s AS (SELECT lane, max(ts) AS last_at, max(ts) FILTER (type = 'cycle-start') AS b, max(ts) FILTER (type = 'cycle-end') AS x FROM e GROUP BY lane)
    SELECT lane, CASE WHEN lane % 10 = 0 THEN 'paused' WHEN last_at < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 6 HOUR THEN 'silent' WHEN b IS NOT NULL AND (x IS NULL OR x < b) AND b < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 25 MINUTE THEN 'stuck' ELSE 'well' END AS state FROM s"""
)
def r03_watchdog(spark, d):
    """Lanes that are paused, silent, stuck in a cycle or well, as of a time."""
    kind = F.when(F.col("event_type") == "click", "cycle-start").when(F.col("event_type") == "purchase", "cycle-end").otherwise("heartbeat")
    events = table(spark, d, "stream").select("lane", kind.alias("type"), F.col("ts").alias("at"))
    as_of = F.lit("2024-01-20 00:00:00").cast("timestamp")
    pauses = events.filter("lane % 10 = 0").select("lane", (as_of + F.expr("INTERVAL 1 MINUTE")).alias("until")).distinct()
    return control.watchdog(events, as_of, pauses, stale=6 * 3600).select("lane", "state")
