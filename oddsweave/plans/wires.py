"""Queries of payloads that are more than one JSON object of known shape: trees, pages, lists by a way of keys, binary messages and slices, raw JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.operators import snapshots
from oddsweave.plans.catalog import query
from oddsweave.plans.payloads import binary, message_of_part, parts, payloads, rule_sql, slice_of_part
from oddsweave.sources import feeds, wire

# --- trees of any depth

_TREE = """SELECT p_partkey AS k, list_reduce(list_prepend('{"id": 0}', list_transform(range(1, 1 + p_partkey % 14), lambda i: CAST(i AS VARCHAR))),
    lambda acc, i: concat('{"id": ', i, ', "groups": [', acc, ', {"id": 100', i, '}]}')) AS j FROM part"""


@query(
    f"""WITH RECURSIVE t AS ({_TREE}), n(k, depth, parent, node) AS (
      SELECT k, 1, CAST(NULL AS VARCHAR), CAST(j AS JSON) FROM t
      UNION ALL SELECT k, depth + 1, node->>'$.id', unnest(CAST(node->'$.groups' AS JSON[])) FROM n WHERE (node->'$.groups') IS NOT NULL)
    SELECT CAST(k AS VARCHAR) AS source, CAST(depth AS INTEGER) AS depth, parent, node->>'$.id' AS id FROM n"""
)
def s11_group_tree(spark, d):
    """Groups in groups, up to 14 deep here and as deep as they come: each with its depth and its parent's id."""
    step = lambda acc, i: F.concat(F.lit('{"id": '), i, F.lit(', "groups": ['), acc, F.lit(', {"id": 100'), i, F.lit("}]}"))
    levels = F.when(F.col("p_partkey") % 14 > 0, F.sequence(F.lit(1), (F.col("p_partkey") % 14).cast("int"))).otherwise(F.array().cast("array<int>"))
    body = F.concat(F.lit('{"data": ['), F.aggregate(F.transform(levels, lambda i: i.cast("string")), F.lit('{"id": 0}'), step), F.lit("]}"))
    nodes = wire.tree_nodes(parts(spark, d).select(F.col("p_partkey").alias("path"), body.alias("value")), "groups", ("data",))
    return nodes.select("source", "depth", F.get_json_object("parent_node", "$.id").alias("parent"), F.get_json_object("node", "$.id").alias("id"))


S22 = [
    {"data": [{"stN": "Futebol", "cs": [{"cN": "BR", "sns": [{"sId": 1, "pseaN": "Serie", "seaN": "A", "lName": "L1", "fs": [{"fId": "#K"}], "sns": [{"sId": 2, "seaN": "B", "fs": [{"fId": 1}, {"fId": 2}], "sns": [{"sId": 3, "lName": "L3", "fs": [{"fId": 3}]}]}]}]}, {"cN": "AR", "sns": [{"sId": 4, "fs": None}, {"sId": 5, "fs": [{"fId": 4}]}]}]}, {"stN": "Basquete", "cs": [{"sns": [{"sId": 9, "fs": [{"fId": 9}]}]}]}]},
    {"data": [{"stN": "Futebol", "cs": []}, {"stN": "Futebol", "cs": [{"sns": [{"sId": 6, "seaN": "", "pseaN": "P", "fs": [{"fId": 5}]}]}]}]},
    {"data": {}},
]


@query(
    rule_sql(
        S22,
        """sports AS (SELECT k, unnest(CAST(e->'$.data' AS JSON[])) AS s FROM p WHERE json_type(e->'$.data') = 'ARRAY'),
countries AS (SELECT k, unnest(CAST(s->'$.cs' AS JSON[])) AS c FROM sports WHERE s->>'$.stN' = 'Futebol'),
seasons AS (SELECT k, unnest(CAST(c->'$.sns' AS JSON[])) AS n FROM countries UNION ALL SELECT k, unnest(CAST(n->'$.sns' AS JSON[])) FROM seasons WHERE json_type(n->'$.sns') = 'ARRAY'),
r AS (SELECT k, n, unnest(CAST(n->'$.fs' AS JSON[])) AS f FROM seasons WHERE json_type(n->'$.fs') = 'ARRAY')""",
        "SELECT CAST(k AS VARCHAR) AS source, CAST(n->>'$.sId' AS BIGINT) AS season_id, concat_ws(' ', nullif(n->>'$.pseaN', ''), nullif(n->>'$.seaN', '')) AS season_name, n->>'$.lName' AS league_name, CAST(f->>'$.fId' AS BIGINT) AS fixture_id FROM r",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def s22_season_fixtures(spark, d):
    """Fixtures of seasons in seasons."""
    got = wire.season_fixtures(payloads(spark, d, S22), key="key")
    return got.select("source", "season_id", "season_name", "league_name", F.get_json_object("value", "$.fId").cast("bigint").alias("fixture_id"))


def _delta(early: bool = False, home=None, draw=None, away=None, **event) -> dict:
    side = lambda k, own: {"value": f"#{k}", "enable": True} | (own or {})
    return {"_id": "ev@K", "home_team": "@H", "away_team": "@A", "start_date": "2026-08-05T19:00:00Z", "market_config": {"has_early_payout": early}, "odds": {"full_time": {"home": side(1, home), "draw": side(2, draw), "away": side(3, away)}}} | event


S22_DELTA = [_delta(), _delta(True), _delta(draw={"enable": False}), _delta(away={"value": 0}), _delta(home_team=None), _delta(start_date="soon"), _delta(start_date=None, date="2026-08-05T19:00:00Z"), _delta(_id="")]
_HASH = "CAST(list_reduce(list_prepend(CAST(0 AS HUGEINT), list_transform(string_split({0}, ''), lambda c: CAST(ascii(c) AS HUGEINT))), lambda h, c: (h * 31 + c) % 9000000000000000) AS BIGINT)"


@query(
    rule_sql(
        S22_DELTA,
        f"""q AS (SELECT k, e, e->>'$._id' AS id FROM p WHERE coalesce(e->>'$._id', '') <> '' AND coalesce(e->>'$.home_team', '') <> '' AND coalesce(e->>'$.away_team', '') <> ''
  AND try_cast(coalesce(e->>'$.start_date', e->>'$.date') AS TIMESTAMPTZ) IS NOT NULL
  AND CAST(e->>'$.odds.full_time.home.value' AS DOUBLE) > 0 AND CAST(e->>'$.odds.full_time.draw.value' AS DOUBLE) > 0 AND CAST(e->>'$.odds.full_time.away.value' AS DOUBLE) > 0),
s AS (SELECT *, unnest(['home', 'draw', 'away']) AS side FROM q),
r AS (SELECT *, e->'$.odds.full_time'->side AS o FROM s)""",
        f"SELECT {_HASH.format('id')} AS event_id, upper(side) AS selection, round(CAST(o->>'$.value' AS DOUBLE), 6) AS price, CASE WHEN e->>'$.market_config.has_early_payout' = 'true' THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, {_HASH.format(chr(39).join(['concat(id, ', ':', ', side)']))} AS source_odd_id FROM r WHERE coalesce(o->>'$.enable', 'true') <> 'false'",
    )
)
def s22_delta_market(spark, d):
    """Delta events as a market of three, ids by hashing texts."""
    shape = "_id string, home_team string, away_team string, start_date string, date string, market_config struct<has_early_payout:boolean>, odds struct<full_time:struct<home:struct<value:double, enable:boolean>, draw:struct<value:double, enable:boolean>, away:struct<value:double, enable:boolean>>>"
    rows = payloads(spark, d, S22_DELTA).select(F.explode(F.array(F.from_json("value", shape))).alias("e")).select("e.*")
    return wire.delta_market(rows).select("event_id", "selection", F.round("price", 6).alias("price"), "pa_category", "source_odd_id")


# --- lists by a way of keys, and one row per id

S08 = [{"data": {"countries": [{"id": 1, "name": "BR", "tournaments": [{"id": 11, "name": "A", "events": [{"id": "#K", "homeTeamName": "@H"}, {"id": 2}]}, {"id": 12, "name": "B", "events": []}]}, {"id": 3, "name": None, "tournaments": [{"id": 13, "events": [{"id": 5}]}]}]}}, {"data": {"countries": [{"id": 1, "name": "BR"}]}}, {"data": None}]


@query(
    rule_sql(
        S08,
        """c AS (SELECT k, unnest(CAST(e->'$.data.countries' AS JSON[])) AS c FROM p WHERE json_type(e->'$.data.countries') = 'ARRAY'),
t2 AS (SELECT k, c, unnest(CAST(c->'$.tournaments' AS JSON[])) AS t FROM c WHERE json_type(c->'$.tournaments') = 'ARRAY'),
r AS (SELECT k, c, t, unnest(CAST(t->'$.events' AS JSON[])) AS ev FROM t2)""",
        "SELECT CAST(k AS VARCHAR) AS source, c->>'$.id' AS country_id, c->>'$.name' AS country, t->>'$.id' AS tournament_id, t->>'$.name' AS tournament, ev->>'$.id' AS event_id, ev->>'$.homeTeamName' AS home_team FROM r",
    )
)
def s08_listed_events(spark, d):
    """Events of tournaments of countries, with the names on the way."""
    levels = [("$.data.countries", {"country_id": "$.id", "country": "$.name"}), ("$.tournaments", {"tournament_id": "$.id", "tournament": "$.name"}), ("$.events", {"event_id": "$.id", "home_team": "$.homeTeamName"})]
    return wire.path_items(payloads(spark, d, S08), levels, key="key").drop("order", "value")


_GAME = {"ID": "#K", "Sport": 1, "t1": 5, "t2": 6}
S10 = [
    {"BR": {"Sports": {"1": {"Regions": {"r1": {"Name": "R", "Champs": {"c1": {"Name": "C", "GameSmallItems": {"a": _GAME, "b": _GAME | {"ID": 7, "t2": 0}, "d": _GAME | {"ID": 9, "Sport": 2}}}, "c2": {"GameSmallItems": {"a": _GAME | {"ID": 8}}}}}}}}}},
    {"BR": '{"Sports": {"1": {"Regions": {"r2": {"Name": "S", "Champs": {"c": {"Name": "D", "GameSmallItems": {"a": {"ID": 3, "Sport": 1, "t1": 5, "t2": 6}}}}}}}}}'},
    {"BR": {}},
]


@query(
    rule_sql(
        S10,
        """o AS (SELECT k, CASE WHEN json_type(e->'$.BR') = 'VARCHAR' THEN CAST(e->>'$.BR' AS JSON) ELSE e->'$.BR' END AS b FROM p),
r1 AS (SELECT k, x.value AS r FROM o, json_each(b, '$.Sports.1.Regions') x),
c AS (SELECT k, r->>'$.Name' AS region, x.value AS c FROM r1, json_each(r, '$.Champs') x),
r AS (SELECT k, region, c->>'$.Name' AS league, x.value AS g FROM c, json_each(c, '$.GameSmallItems') x)""",
        "SELECT CAST(k AS VARCHAR) AS source, region, league, CAST(g->>'$.ID' AS BIGINT) AS game_id FROM r WHERE g->>'$.Sport' = '1' AND CAST(g->>'$.t1' AS INT) <> 0 AND CAST(g->>'$.t2' AS INT) <> 0",
    )
)
def s10_game_index(spark, d):
    """Games of championships of regions, all objects by key, some kept as JSON in JSON."""
    levels = [("$.Sports['1'].Regions", {"region": "$.Name"}), ("$.Champs", {"league": "$.Name"}), ("$.GameSmallItems", {"game": "$.ID", "sport": "$.Sport", "t1": "$.t1", "t2": "$.t2"})]
    rows = payloads(spark, d, S10).select("key", F.get_json_object("value", "$.BR").alias("value"))
    got = wire.path_items(rows, levels, key="key").filter("sport = '1' AND t1 <> '0' AND t2 <> '0'")
    return got.select("source", "region", "league", F.col("game").cast("bigint").alias("game_id"))


def _page(shift: int) -> dict:
    return {"items": [{"id": "#K", "n": shift}, {"id": 100000 + shift, "n": shift}, {"id": None, "n": shift}, {"id": "#K", "n": shift + 10}]}


S13 = [_page(1), _page(2), {"items": None}, {"items": [{"id": 100001, "n": 5}]}]


@query(
    rule_sql(
        S13,
        "r AS (SELECT k, CAST(x.key AS INT) AS n, x.value AS i FROM p, json_each(e, '$.items') x)",
        "SELECT i->>'$.id' AS game_id, arg_max(i->>'$.n', k * 1000 + n) AS n FROM r WHERE i->>'$.id' IS NOT NULL GROUP BY 1",
    )
)
def s13_games_of_pages(spark, d):
    """Games of many pages, of one id the last."""
    games = wire.path_items(payloads(spark, d, S13).withColumn("page", F.format_string("%09d", "key")), [("$.items", {"game_id": "$.id", "n": "$.n"})], key="page")
    return wire.one_per_id(games, "game_id").select("game_id", "n")


_NAMED = {"id": "#K", "team1_name": "@H", "market": {"m": {"type": "P1XP2", "event": {k: {"id": n, "type_1": k, "price": f"#{n}"} for n, k in ((1, "W1"), (2, "X"), (3, "W2"))}}}}
S16 = [
    {"data": {"sport": {"s": {"region": {"r": {"name": "BR", "competition": {"c": {"id": 4, "name": "A", "game": {"g": _NAMED, "h": {"id": "x"}}}}}}}}}},
    {"data": {"sport": {"s": {"region": {"r": {"alias": "AR", "competition": {"c": {"name": "B", "game": {"g": _NAMED | {"market": {"m": _NAMED["market"]["m"] | {"type": "MatchResultEP"}}}}}}}}}}}},
    {"data": {"sport": {}}},
]


@query(
    rule_sql(
        S16,
        """c AS (SELECT k, s.value AS s FROM p, json_each(e, '$.data.sport') s), r2 AS (SELECT k, x.value AS r FROM c, json_each(s, '$.region') x), q AS (SELECT k, x.value AS c FROM r2, json_each(r, '$.competition') x),
g AS (SELECT k, c->>'$.name' AS league, x.value AS g FROM q, json_each(c, '$.game') x),
m AS (SELECT k, league, g, x.value AS m FROM g, json_each(g, '$.market') x WHERE try_cast(g->>'$.id' AS BIGINT) IS NOT NULL),
r AS (SELECT k, league, g, m, x.value AS o FROM m, json_each(m, '$.event') x)""",
        "SELECT g->>'$.id' AS event_id, league AS league_name, CASE o->>'$.type_1' WHEN 'W1' THEN 'HOME' WHEN 'X' THEN 'DRAW' ELSE 'AWAY' END AS selection, round(CAST(o->>'$.price' AS DOUBLE), 6) AS price, CASE WHEN m->>'$.type' = 'MatchResultEP' THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category FROM r",
    )
)
def s16_games_of_maps(spark, d):
    """Sports, regions, competitions and games as maps of maps, down to prices."""
    levels = [("$.data.sport", {}), ("$.region", {}), ("$.competition", {"league": "$.name"}), ("$.game", {"game_id": "$.id"})]
    games = wire.path_items(payloads(spark, d, S16), levels, key="key").withColumn("game_id", F.col("game_id").try_cast("bigint"))
    one = wire.one_per_id(games, "game_id")
    named = one.select(snapshots.merged_raw(F.col("value"), competitionName=F.col("league")).alias("value"))
    return feeds.prices(named, feeds.NESTED_MAPS).select("event_id", "league_name", "selection", F.round("price", 6).alias("price"), "pa_category")


_FIXTURE = {"id": "f@K", "startDate": "2026-08-05", "participants": []}
S17 = [
    {"page": 1, "fixtures": [_FIXTURE, {"id": 7, "startDate": "x", "name": {"value": "n", "inner": {"id": "i@K", "startDate": "y", "optionMarkets": [1]}}}]},
    {"page": 2, "view": {"deep": [[_FIXTURE | {"later": 1}], {"id": "z@K", "startDate": "x", "name": "text"}, {"id": True, "startDate": "x", "participants": []}, {"id": "s@K", "startDate": 5, "participants": []}]}},
    {"a": {"b": {"c": {"d": {"e": {"f": [{"g": _FIXTURE}]}}}}}},
]


@query(
    rule_sql(
        S17,
        """n AS (SELECT k, e AS n FROM p UNION ALL SELECT k, x.value FROM n, json_each(n) x WHERE json_type(n) IN ('OBJECT', 'ARRAY')),
r AS (SELECT k, n->>'$.id' AS id FROM n WHERE json_type(n) = 'OBJECT' AND json_type(n->'$.id') IN ('VARCHAR', 'UBIGINT', 'BIGINT') AND json_type(n->'$.startDate') = 'VARCHAR'
  AND (json_type(n->'$.optionMarkets') = 'ARRAY' OR json_type(n->'$.participants') = 'ARRAY' OR json_type(n->'$.name') = 'OBJECT'))""",
        "SELECT id AS fixture_id, CAST(min(k) AS VARCHAR) AS source FROM r GROUP BY id",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
)
def s17_fixture_candidates(spark, d):
    """Whatever looks like a fixture, anywhere, the first of an id."""
    found = wire.fixture_candidates(payloads(spark, d, S17).withColumn("page", F.format_string("%09d", "key")), key="page")
    one = wire.one_per_id(found, "id", ("source", "path"), last=False)
    return one.select(F.col("id").alias("fixture_id"), F.col("source").cast("bigint").cast("string").alias("source"))


# --- raw JSON

U10 = [
    {"a": {"b": [1, {"c": None}]}, "n": "#K", "price": "#1", "t": "3", "z": None, "stage": "new", "failCount": 2},
    {"failCount": "1", "flag": True, "deep": {"stage": "kept"}},
    {"failCount": None},
]


@query(
    rule_sql(
        U10,
        "r AS (SELECT k, e, CASE WHEN k % 2 = 0 THEN 0 ELSE coalesce(try_cast(e->>'$.failCount' AS INTEGER), 0) + 1 END AS fails FROM p)",
        """SELECT k AS event_id, CAST(fails AS VARCHAR) AS fail_count, 'number' AS fail_kind, e->>'$.n' AS n, CASE WHEN json_type(e->'$.n') LIKE '%BIGINT' THEN 'number' END AS n_kind, CASE WHEN json_type(e->'$.t') = 'VARCHAR' THEN 'text' END AS t_kind,
    e->>'$.a.b[0]' AS nested, e->>'$.deep.stage' AS deep_stage, 'matched' AS stage, e->>'$.flag' AS flag, CAST(e->>'$.price' AS DOUBLE) AS price, len(list_distinct(list_concat(json_keys(e), ['stage', 'failCount']))) AS n_keys FROM r""",
    )
)
def u10_merged_raw(spark, d):
    """Raw JSON with a stage and a counter set anew; all else keeps its type."""
    rows = payloads(spark, d, U10).withColumn("raw", snapshots.counted_failure(snapshots.merged_raw(F.col("value"), stage=F.lit("matched")), F.col("key") % 2 == 1))
    v = F.parse_json("raw")
    kind = lambda c: F.schema_of_variant(F.variant_get(v, f"$.{c}", "variant"))
    number = lambda c: F.when(kind(c) == "BIGINT", "number")
    get = lambda c: F.get_json_object("raw", f"$.{c}")
    return rows.select(
        F.col("key").alias("event_id"), get("failCount").alias("fail_count"), number("failCount").alias("fail_kind"), get("n").alias("n"), number("n").alias("n_kind"), F.when(kind("t") == "STRING", "text").alias("t_kind"),
        get("a.b[0]").alias("nested"), get("deep.stage").alias("deep_stage"), get("stage").alias("stage"), get("flag").alias("flag"), get("price").cast("double").alias("price"), F.size(F.json_object_keys("raw")).cast("bigint").alias("n_keys"),
    )


# --- binary messages and slices, down to prices


_ROWS = """SELECT CAST(p_partkey AS VARCHAR) AS event_id, s.selection, round(s.k + p_size / 10.0, 6) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category,
    split_part(p_name, ' ', 1) AS home_team FROM part, (VALUES ('HOME', 1), ('DRAW', 2), ('AWAY', 3)) s(selection, k)"""


def _rows(rows):
    return rows.select("event_id", "selection", F.round("price", 6).alias("price"), "pa_category", "home_team")


@query(_ROWS + " WHERE p_partkey <> 0")
def s07_message_prices(spark, d):
    """Bytes of nested wire messages to events, odds and prices; an event of id 0 is none."""
    events = wire.message_events(wire.protobuf_fields(binary(spark, d, message_of_part)))
    return _rows(feeds.prices(events, feeds.GROUPED_ODDS, "e"))


@query(_ROWS)
def s21_slice_prices(spark, d):
    """Bytes of columnar slices, some in LZMA, to tables, joins and prices."""
    cells = wire.columnar_tables(binary(spark, d, slice_of_part)).withColumn("feed", F.col("source"))
    return _rows(feeds.prices(wire.slice_events(cells), feeds.DECODED_RESULTS, "e"))
