"""Feeds on small payloads of our own: three prices of one event each, closed ones left out."""

import base64
import json
import struct

import pytest
import pandas as pd
from pyspark.sql import functions as F

from oddsweave.plans import payloads
from oddsweave.sources import feeds, pages, wire

WHEN = "2026-08-05T19:00:00Z"
MS = 1786042800000
H, A = "Boca Juniors", "Estudiantes"
THREE = {("HOME", 2.0), ("DRAW", 3.0), ("AWAY", 4.0)}


def named(*keys):
    return [dict(zip(keys, row)) for row in ((H, 2.0), ("Empate", 3.0), (A, 4.0))]


PAYLOADS = {
    "offer_ids": ({"id": 7, "name": f"{H} vs. {A}", "startDate": WHEN, "champ": {"name": "Liga"}, "markets": [{"id": 1, "name": "Resultado Final", "desktopOddIds": [[11], [12], [13]], "offers": '{"type": 0, "parameter": 2}'}, {"id": 2, "name": "Total", "desktopOddIds": [[14]]}], "odds": [{"id": 10 + k, "price": p, "typeId": k, "oddStatus": 0} for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))] + [{"id": 14, "price": 9.0, "typeId": 1, "oddStatus": 0}]}, "COM_PA"),
    "apostabet": ({"id": "x1", "isEarlyPayout": True, "homeCompetitorName": H, "awayCompetitorName": A, "scheduleTime": WHEN, "sportMarketDetails": [{"id": "m", "marketId": 1, "nameDefault": "1x2", "status": 1, "sportOutcomeDetails": [{"id": f"9{k}", "outcomeId": str(k), "active": True, "odds": str(p)} for k, p in ((1, 2.0), (2, 3.0))] + [{"id": "93", "active": True, "name": A, "odds": "4.0"}, {"id": "94", "outcomeId": "1", "active": False, "odds": "8"}]}]}, "COM_PA"),
    "bet7k": ({"_id": "a12", "StartEventDate": WHEN, "Settings": {"EarlyPayout": "1"}, "Participants": [{"Name": H, "VenueRole": "Home"}, {"Name": A, "VenueRole": "Away"}], "Markets": [{"_id": "m", "MarketType": {"_id": "ML0", "LineTypeName": "1x2"}, "Name": "Resultado Final", "Selections": [{"_id": f"s{k}", "Side": k, "DisplayOdds": {"Decimal": str(p)}} for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))]}]}, "COM_PA"),
    "betano": ({"data": {"event": {"id": "5", "name": f"{H} - {A}", "startTime": MS}, "markets": [{"id": "m1", "name": "Resultado Final", "type": "MRES", "selections": [{"id": str(k), "name": n, "price": p} for k, (n, p) in enumerate((("1", 2.0), ("X", 3.0), ("2", 4.0)))]}], "marketOffersData": {"marketOffers": {"m1": [{"offerTypeId": 2}]}}}}, "COM_PA"),
    "betboom": ({"id": 5, "startsAt": WHEN, "homeTeam": H, "awayTeam": A, "odds": [{"id": str(k), "shortName": n, "price": p, "marketName": "Vencedor", "groupName": "Resultado"} for k, (n, p) in enumerate((("1", 2.0), ("X", 3.0), ("2", 4.0)), 1)]}, "SEM_PA"),
    "betesporte": ({"id": 5, "homeTeamName": H, "awayTeamName": A, "date": WHEN, "markets": [{"id": 1, "name": "1x2", "type": 1601, "options": [{"id": k, "odd": p, "externalId": str(k)} for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))] + [{"id": 4, "odd": 9.0, "externalId": "1", "locked": True}]}]}, "COM_PA"),
    "betfair": ({"urn": "ppb:event:123", "sportevent": {"name": f"{H} x {A}", "openDate": WHEN}, "markets": [{"groupTitle": "2 Gols de Vantagem", "market": {"urn": "m:77", "liveData": {"sportsbookMarketStatus": "OPEN", "runners": [{"selectionId": k, "runnerStatus": "ACTIVE", "displayOdds": {"decimal": p}} for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))]}, "runners": [{"name": n, "selectionId": k, "resultType": n} for k, n in ((1, "HOME"), (2, "DRAW"), (3, "AWAY"))]}}]}, "COM_PA"),
    "betfast": ({"id": 5, "homeTeam": H, "awayTeam": A, "startsAt": WHEN, "ev": {"27072": {"501": {"pos": 133827, "coef": 2.0, "p1": 2}, "502": {"pos": 133828, "coef": 3.0, "p1": 2}, "503": {"pos": 133829, "coef": 4.0, "p1": 2}, "504": {"pos": 133827, "coef": 9.0, "p1": 1}}, "9": {"1": {"pos": 1, "coef": 7.0}}}}, "COM_PA"),
    "betmgm": ({"id": 5, "startTime": WHEN, "participants": [{"name": H, "position": "HOME"}, {"name": A, "position": "AWAY"}], "markets": [{"id": "1", "type": "standard-3-way", "name": "Resultado Final", "betMarketStatus": "OPEN", "outcomes": [{"id": f"o{k}", **o} for k, o in enumerate(named("name", "formatDecimal"))]}]}, "SEM_PA"),
    "betnacional": ({"event_id": 5, "home": H, "away": A, "date_start": "2026-08-05 16:00:00", "odds": [{"id": f"{m}{k}", "market_id": m, "odd": str(p + x), "outcome_id": str(k), "market_name": "Resultado Final", "market_code": "r"} for m, x in ((999133, 0), (7, 1)) for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))]}, "SEM_PA"),
    "casadeapostas": ({"id": 5, "startDate": "2026-08-05T19:00:00", "competitors": [{"name": H}, {"name": A}], "markets": [{"id": 1, "marketTypeId": 1252, "name": "1x2 - PA", "odds": [{"id": k, "value": p, "state": 1, "name": n} for k, (n, p) in enumerate(((H, 2.0), ("Empate", 3.0), (A, 4.0)))]}]}, "COM_PA"),
    "kto": ({"event": {"id": 5, "homeName": H, "awayName": A, "start": WHEN}, "betOffers": [{"id": 1, "criterion": {"label": "Resultado Final", "englishLabel": "Full Time"}, "betOfferType": {"id": 2}, "outcomes": [{"id": k, "odds": p * 1000, "type": t, "status": "OPEN"} for k, (t, p) in enumerate((("OT_ONE", 2.0), ("OT_CROSS", 3.0), ("OT_TWO", 4.0)))]}]}, "SEM_PA"),
    "novibet": ({"betContextId": 5, "startTimeUTC": WHEN, "additionalCaptions": {"competitor1": H, "competitor2": A}, "marketTags": [{"marketId": 9, "tag": "SOCCER_2_GOALS_AHEAD_EARLY_PAYOUT"}], "markets": [{"marketId": 9, "marketSysname": "SOCCER_MATCH_RESULT_PRELIVE", "betItems": [{"id": str(k), "code": c, "price": p, "isAvailable": True} for k, (c, p) in enumerate((("1", 2.0), ("X", 3.0), ("2", 4.0)))]}]}, "COM_PA"),
    "segurobet": ({"id": 5, "team1_name": H, "team2_name": A, "start_ts": MS // 1000, "market": {"m": {"id": 1, "type": "P1XP2", "event": {str(k): {"id": k, "type_1": t, "price": p} for k, (t, p) in enumerate((("W1", 2.0), ("X", 3.0), ("W2", 4.0)))}}}}, "SEM_PA"),
    "sportingbet": ({"id": "2:5", "startDate": WHEN, "participants": [{"name": {"value": H}}, {"name": {"value": A}}], "optionMarkets": [{"id": 1, "status": "Visible", "parameters": [{"key": "MarketType", "value": "3way"}, {"key": "Period", "value": "RegularTime"}, {"key": "MarketSubType", "value": "2Up"}], "options": [{"id": k, "name": {"value": n}, "status": "Visible", "price": {"odds": p}} for k, (n, p) in enumerate(((H, 2.0), ("X", 3.0), (A, 4.0)))]}]}, "COM_PA"),
    "sportybet": ({"eventId": "sr:match:5", "estimateStartTime": MS, "homeTeamName": H, "awayTeamName": A, "markets": [{"id": "60100", "status": 0, "outcomes": [{"id": str(k), "odds": str(p), "isActive": 1} for k, p in ((1, 2.0), (2, 3.0), (3, 4.0))]}]}, "COM_PA"),
    "superbet": ({"eventId": 5, "matchName": f"{H}·{A}", "utcDate": WHEN, "superAdvantage": "SA_PREMATCH", "odds": [{"uuid": f"u{k}", "marketId": 547, "price": p, "status": "active", "code": c, "marketName": "Resultado Final"} for k, (c, p) in enumerate((("1", 2.0), ("0", 3.0), ("2", 4.0)), 1)]}, "COM_PA"),
    "tradeball": ({"id": "5", "start": WHEN, "rawDball": "{}", "event-participants": [{"participant-name": H}, {"participant-name": A}], "markets": [{"id": "1", "name": "Match Odds", "status": "open", "market-type": "one_x_two", "runners": [{"id": str(k), "name": n, "status": "open", "prices": [{"decimal-odds": 99.0, "side": "lay"}, {"decimal-odds": p, "side": "back"}]} for k, (n, p) in enumerate(((H, 2.0), ("Draw", 3.0), (A, 4.0)))]}]}, "SEM_PA"),
    "vaidebet": ({"fId": "5", "fsd": MS, "hcN": H, "acN": A, "btgs": [{"btgId": "7988", "btgN": "Resultado 1X2 (2UP)", "fos": [{"foId": str(k), "hO": p, "pSh": s, "hSh": n} for k, (s, n, p) in enumerate((("", H, 2.0), ("Empate", "", 3.0), ("Fora", "", 4.0)))]}]}, "COM_PA"),
    "versusbet": ({"id": 5, "startsAt": WHEN, "homeTeam": H, "awayTeam": A, "markets": [{"id": 1, "name": "Resultado Final", "results": [{"id": k, "name": n, "price": p} for k, (n, p) in enumerate((("a||1|", 2.0), ("Empate", 3.0), (A, 4.0)))]}]}, "SEM_PA"),
}


@pytest.mark.parametrize("name", sorted(feeds.ADAPTERS))
def test_adapter(spark, name):
    payload, category = PAYLOADS[name]
    rows = spark.createDataFrame([(json.dumps(payload),), ("{}",), ("no json",), (None,)], "value string")
    got = feeds.prices(rows, feeds.ADAPTERS[name]).collect()
    assert {(r.selection, r.price) for r in got} == THREE and len(got) == 3
    assert {r.pa_category for r in got} == {category} and {(r.home_team, r.away_team) for r in got} == {(H, A)}
    assert {r.starts_at.strftime("%d %H:%M") for r in got} <= {"05 19:00", "06 19:00"} or name in ("betano", "segurobet", "sportybet", "vaidebet")
    assert all(r.source_odd_id is not None for r in got if name not in ("betmgm",))


def test_linked_rows_are_turned(spark):
    rows = feeds.prices(spark.createDataFrame([(json.dumps(PAYLOADS["kto"][0]),)], "value string"), feeds.MILLI_ODDS)
    links = spark.createDataFrame([("kto", "5", 77, "INVERTED")], "bookmaker string, event_id string, fixture_id long, orientation string")
    assert {(r.fixture_id, r.selection, r.price) for r in feeds.linked(rows, links).collect()} == {(77, "AWAY", 2.0), (77, "DRAW", 3.0), (77, "HOME", 4.0)}


def test_listing_page(spark):
    text = "\n".join(["Qua 05 Ago", "1", "X", "2", "19:00", H, A, "8", "2.15", "2.87", "4.00", "21:15", "Tigre", "Belgrano", "8", "2.55", "2.75", "3.40", "Qui 06 Ago", "9:30", "A Team", "B Team", "10:00", "10:30", "x1"])
    got = pages.listing_events(spark.createDataFrame([(1, text, ["2026-08-05"]), (2, None, [])], "page_id long, text string, allowed_date_keys array<string>"), 2025).orderBy("starts_at").collect()
    assert [(r.home_team, r.away_team, r.date_key) for r in got] == [("A Team", "B Team", "2025-08-06"), (H, A, "2026-08-05"), ("Tigre", "Belgrano", "2026-08-05")]
    assert got[1].starts_at.isoformat() == "2026-08-05T22:00:00" and len({r.event_key for r in got}) == 3


def test_result_blocks(spark):
    text = "\n".join(["Resultado Final", "1", "2.00", "X", "3,10", "2", "4.50", "Total de gols", "1", "9.99", "Resultado Final - Pagamento Antecipado", "1", "1.90", "X", "3.00", "2", "4.00", "Resultado Final", "1", "2.00"])
    got = pages.result_blocks(spark.createDataFrame([(1, text)], "page_id long, text string")).orderBy("block").collect()
    assert [(r.pa_category, r.home, r.draw, r.away) for r in got] == [("SEM_PA", 2.0, 3.1, 4.5), ("COM_PA", 1.9, 3.0, 4.0)]


def test_visible_markets(spark):
    text = "\n".join(["Full Time Result", H, "2.00", "Draw 3.00", A, "4.00", "Total Goals", "Over 1.50", "Full Time Result Early Payout", "a 1.90", "b 2.90", "c 3.90"])
    got = {r.pa_category: (r.home, r.draw, r.away) for r in pages.visible_markets(spark.createDataFrame([(1, text)], "page_id long, text string")).collect()}
    assert got == {"SEM_PA": (2.0, 3.0, 4.0), "COM_PA": (1.9, 2.9, 3.9)}


def test_node_payload(spark):
    text = f"EV;NA={H} v {A};X|MG;NA=Full Time Result;|PA;NA={H};OD=1/1;|PA;NA={A};OD=3/1;|PA;NA=Draw;OD=2/1;|PA;NA={H};OD=1/1;|MG;NA=Goals;|PA;NA=Over;OD=1/2;|MG;NA=Resultado Final Early Payout;|PA;NA={H};OD=0/1"
    df = spark.createDataFrame([(1, text)], "page_id long, value string")
    got = pages.node_prices(df).collect()
    assert {(r.selection, r.price) for r in got} == {("HOME", 2.0), ("DRAW", 3.0), ("AWAY", 4.0)}
    first = pages.nodes(df).orderBy("pos").first()
    assert first.type == "EV" and first.attributes == {"NA": f"{H} v {A}", "X": "true"}


def test_protobuf(spark):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    inner = varint(1 << 3) + varint(300) + varint(2 << 3 | 1) + struct.pack("<d", 2.5)
    data = varint(3 << 3 | 2) + varint(len(inner)) + inner + varint(4 << 3 | 2) + varint(4) + b"Boca"
    got = {r.path: (r.field, r.number, r.text) for r in wire.protobuf_fields(spark.createDataFrame([("f", bytearray(data))], "path string, content binary")).collect()}
    assert got["/0:3/0:1"][1] == 300 and got["/0:3/1:2"][1] == 2.5 and got["/1:4"][2] == "Boca"


def test_columnar_slice(spark):
    def string(s):
        return struct.pack("<H", len(s)) + s.encode()

    data = bytearray(400)
    data[0], data[17], data[11] = 201, 202, 1
    struct.pack_into("<i", data, 18, 40)
    data[40], data[49] = 203, 204
    struct.pack_into("<H", data, 47, 2)
    struct.pack_into("<ii", data, 50, 100, 200)
    data[58:64] = string("odds")
    for at, name, kind, items in ((100, "id", 4, struct.pack("<ii", 7, -8)), (200, "name", 10, struct.pack("<ii", 300, 310))):
        data[at], data[at + 20], data[at + 15] = 206, 207, kind
        struct.pack_into("<i", data, at + 11, 2)
        struct.pack_into("<H", data, at + 5, 40)
        data[at + 21 : at + 23 + len(name)] = string(name)
        data[at + 40 : at + 40 + len(items)] = items
    data[300:306], data[310:316] = string("Boca"), string("Tigr")
    cells = wire.columnar_tables(spark.createDataFrame([("f", data)], "path string, content binary"))
    assert [(r.id, r.name) for r in wire.table_of(cells, "odds", ["id", "name"]).orderBy("row").collect()] == [("7", "Boca"), ("-8", "Tigr")]


def test_json_trees(spark):
    doc = {"a": [{"marketId": 1, "betItems": []}, {"b": json.dumps({"c": {"marketId": 2, "betItems": [1]}})}], "marketId": 3}
    got = wire.json_nodes(spark.createDataFrame([("f", json.dumps(doc)), ("g", "no")], "path string, value string"), ["marketId", "betItems"]).collect()
    assert sorted((r.path, json.loads(r.node)["marketId"]) for r in got) == [("/a/0", 1), ("/a/1/b/c", 2)]


def test_stacked_prices(spark):
    row = spark.createDataFrame([("1", "2026-08-05 20:00:00", H, A, "2.0", "3.0", "0")], "ceId string, dg string, cthName string, ctaName string, wldHm string, wldDm string, wldAm string")
    got = wire.three_runners(row).collect()
    assert {(r.selection, r.price) for r in got} == {("HOME", 2.0), ("DRAW", 3.0)} and got[0].starts_at.hour == 19
    event = {"_id": "d", "home_team": H, "away_team": A, "start_date": WHEN, "seen": 1, "market_config": {"has_early_payout": True}, "odds": {"full_time": {"home": {"value": 2.0, "enable": True}, "draw": {"value": 3.0, "enable": False}, "away": {"value": 4.0, "enable": True}}}}
    unpriced = event | {"_id": "e", "odds": {"full_time": event["odds"]["full_time"] | {"draw": {"value": 0.0, "enable": False}}}}
    later = event | {"seen": 2, "market_config": {"has_early_payout": False}}
    delta = spark.read.json(spark.sparkContext.parallelize([json.dumps(x) for x in (event, unpriced, later, event | {"_id": "f", "start_date": "?"})]))
    assert {(r.event_id, r.selection, r.pa_category, r.source_odd_id) for r in wire.delta_market(delta).collect()} == {(100, side, "SEM_PA", number(f"d:{side.lower()}")) for side in ("HOME", "AWAY")}


def number(text):
    out = 0
    for c in text:
        out = (out * 31 + ord(c)) % 9_000_000_000_000_000
    return out


def test_trees(spark):
    tree = spark.createDataFrame([([(1, [(2, None), (3, [(4,)])])],)], "groups array<struct<id:int, groups:array<struct<id:int, groups:array<struct<id:int>>>>>>")
    assert sorted(r.id for r in wire.tree_leaves(tree, "groups", "groups").collect()) == [1, 2, 3, 4]
    deep = {"id": 300}
    for k in range(299, 0, -1):
        deep = {"id": k, "groups": [deep, None, 5]}
    rows = spark.createDataFrame([("a", json.dumps({"data": [deep, {"id": 0, "groups": {}}]})), ("b", "no"), ("c", "[]"), ("d", None), ("e", "[" * 100_000)], "path string, value string")
    got = wire.tree_nodes(rows, "groups", ("data",)).collect()
    assert sorted((json.loads(r.node)["id"], r.depth) for r in got) == [(0, 1)] + [(k, k) for k in range(1, 301)]
    assert {r.parent is None for r in got if r.depth == 1} == {True} and all(r.path.startswith(r.parent) for r in got if r.parent)
    season = lambda k, *below, **more: {"sId": k, "seaN": f"s{k}", "fs": [{"fId": k * 10}], "sns": list(below)} | more
    body = {"data": [{"stN": "Futebol", "cs": [{"sns": [season(1, season(2, season(3, pseaN="p", lName="L")))]}, {"sns": [season(4, fs=None)]}]}, {"stN": "Basquete", "cs": [{"sns": [season(9)]}]}]}
    got = wire.season_fixtures(spark.createDataFrame([("x", json.dumps(body))], "path string, value string")).collect()
    assert sorted((r.source, r.season_id, r.season_name, r.league_name, json.loads(r.value)["fId"]) for r in got if r.season_id < 3) == [("x", 1, "s1", None, 10), ("x", 2, "s2", None, 20)]
    assert [(r.season_name, r.league_name) for r in got if r.season_id == 3] == [("p s3", "L")] and len(got) == 3
    asked = spark.range(1).select(wire.request_path(F.struct(F.struct(F.array(F.lit(5), F.lit(6)).alias("seasonIds")).alias("requestBody"))).alias("v")).first().v
    assert json.loads(base64.b64decode(asked)) == {"requestBody": {"seasonIds": [5, 6]}}


def test_nodes_carry_their_parent(spark):
    rows = spark.createDataFrame([("a", json.dumps({"data": [{"id": 1, "groups": [{"id": "x", "groups": [{"id": 3}]}]}]}))], "path string, value string")
    got = wire.tree_nodes(rows, "groups", ("data",)).collect()
    assert {r.node: r.parent_node for r in got} == {'{"id": 1}': None, '{"id": "x"}': '{"id": 1}', '{"id": 3}': '{"id": "x"}'}


def test_small_files_are_dealt_out_and_what_is_decoded_is_not_broadcast(spark):
    folder = "/root/testdata/sf0.001"
    assert payloads.payloads(spark, folder, [{"id": "#K"}]).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    cells = wire.columnar_tables(payloads.binary(spark, folder, payloads.slice_of_part)).withColumn("feed", F.col("source"))
    for df in (wire.message_events(wire.protobuf_fields(payloads.binary(spark, folder, payloads.message_of_part))), wire.slice_events(cells)):
        assert "Broadcast" not in df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_decoded_rows_are_held_a_frame_at_a_time():
    """However many rows a batch of payloads gives, no more are read than a frame holds, and none is lost."""
    read = []

    def decode(v):
        for n in range(v):
            read.append(n)
            yield (n,)

    sizes = [wire.FRAME_ROWS * 2 + 5, 0, 7]
    frames = wire._decoded(iter([pd.DataFrame({"source": ["a", "b", "c"], "value": sizes}), pd.DataFrame({"source": ["d"], "value": [None]})]), decode, ["source", "n"])
    first = next(frames)
    assert len(first) == len(read) == wire.FRAME_ROWS
    rest = pd.concat(frames)
    assert len(first) + len(rest) == sum(sizes) and rest["source"].value_counts().to_dict() == {"a": wire.FRAME_ROWS + 5, "c": 7}
