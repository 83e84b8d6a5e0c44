"""Queries of feed adapters over payloads with open, closed, live, half-time, incomplete and repeated markets.

The SQL takes the same texts apart with JSON functions and states the feed's
rules once more over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.plans.catalog import query
from oddsweave.plans.payloads import payloads, rule_sql
from oddsweave.sources import feeds


def _priced(rows: DataFrame, adapter: feeds.Adapter) -> DataFrame:
    return feeds.prices(rows, adapter).select("event_id", "selection", F.round("price", 6).alias("price"), "pa_category", "confidence_score", "source_odd_id")


def _three(make) -> list:
    return [make(k) for k in (1, 2, 3)]


# --- tournaments


def _tournament(outcomes: list, tournament: str = "t9", early: bool = False, teams: bool = True, **market) -> dict:
    names = {"homeCompetitorName": "@H", "awayCompetitorName": "@A"} if teams else {"name": "@H vs. @A"}
    return {"id": "@K", "tournamentId": tournament, "isEarlyPayout": early, **names, "scheduleTime": "2026-08-05T19:00:00Z", "sportMarketDetails": [{"id": "m1", "marketId": 1, "nameDefault": "1x2", "status": 1, "sportOutcomeDetails": outcomes} | market]}


_CODED = _three(lambda k: {"id": f"9{k}7", "outcomeId": str(k), "active": True, "name": "?", "odds": f"@{k}"})
_NAMED = [{"id": "a1", "active": True, "name": "@H", "odds": "@1"}, {"id": "a2", "active": True, "name": "Empate", "odds": "@2"}, {"id": "a3", "active": True, "name": "@A", "odds": "@3"}, {"id": "a4", "active": True, "name": "Qwrtz", "odds": "@3"}]
A02 = [
    _tournament(_CODED),
    _tournament(_CODED, early=True),
    _tournament(_CODED, tournament="t1"),
    _tournament(_NAMED, teams=False),
    _tournament(_CODED, nameTranslated="1X2 "),
    _tournament(_CODED, nameTranslated="Dupla chance"),
    _tournament(_CODED, nameDefault="1x2 - 1o tempo"),
    _tournament(_CODED, status=2),
    _tournament(_CODED, isMarketCancel=True),
    _tournament(_CODED, inPlay=True),
    _tournament([o | {"active": o["outcomeId"] != "2"} for o in _CODED], marketId=None, smarketId=1),
    _tournament([{"id": "b1", "active": True, "name": "casa", "odds": "@1"}, *_CODED[1:]], marketId=4),
]
_A02_SQL = """
m AS (SELECT k, home, away, e, unnest(CAST(e->'$.sportMarketDetails' AS JSON[])) AS m FROM p),
s AS (SELECT k, home, away, e, unnest(CAST(m->'$.sportOutcomeDetails' AS JSON[])) AS s FROM m
  WHERE coalesce(m->>'$.marketId', m->>'$.smarketId') = '1' AND regexp_matches(trim(coalesce(m->>'$.nameTranslated', m->>'$.nameDefault')), '(?i)^1x2$')
    AND m->>'$.status' = '1' AND coalesce(m->>'$.isMarketCancel', 'false') <> 'true' AND coalesce(m->>'$.inPlay', 'false') <> 'true'),
r AS (SELECT k, CASE WHEN s->>'$.outcomeId' = '1' THEN 'HOME' WHEN s->>'$.outcomeId' = '2' THEN 'DRAW' WHEN s->>'$.outcomeId' = '3' THEN 'AWAY'
    WHEN norm(s->>'$.name') IN ('x', 'empate', 'draw') THEN 'DRAW' WHEN s->>'$.name' = home THEN 'HOME' WHEN s->>'$.name' = away THEN 'AWAY' END AS selection,
    CAST(s->>'$.odds' AS DOUBLE) AS price, CASE WHEN e->>'$.isEarlyPayout' = 'true' OR e->>'$.tournamentId' IN ('t1', 't2') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.96 AS early,
    CAST(left(regexp_replace(s->>'$.id', '[^0-9]', '', 'g'), 15) AS BIGINT) AS odd_id FROM s WHERE s->>'$.active' = 'true')
"""


@query(rule_sql(A02, _A02_SQL))
def a02_tournament_tree(spark, d):
    """Early payout by event or by a table of tournaments; names translated first; sides by code, word or similar name."""
    early = spark.createDataFrame([("t1",), ("t2",), ("t1",), (None,)], "tournamentId string")
    return _priced(feeds.early_tournaments(payloads(spark, d, A02), early), feeds.TOURNAMENT_TREE)


# --- localised texts


def _localised(market: dict, selections: list | None = None, early=None) -> dict:
    own = selections or _three(lambda k: {"_id": f"s{k}8", "Side": k, "DisplayOdds": {"Decimal": f"@{k}"}})
    return {"_id": "@K", "StartEventDate": "2026-08-05T19:00:00Z", "Settings": {"EarlyPayout": early}, "Participants": [{"Name": "@A", "VenueRole": "Away"}, {"Name": "@H", "VenueRole": "Home"}], "Markets": [{"_id": "m", "Name": "Resultado Final", "Selections": own} | market]}


_ML0 = {"MarketType": {"_id": "ML0", "Name": "Resultado", "LineTypeName": "1X2"}}
_ML5000 = {"MarketType": {"_id": "ML5000", "Name": "Super Odds", "LineTypeName": "Especial"}}
A03 = [
    _localised(_ML0),
    _localised(_ML0, early="1"),
    _localised(_ML0, early="False"),
    _localised(_ML0 | {"Name": "Resultado Final (Pagamento Antecipado)"}),
    _localised(_ML0 | {"Name": "Resultado Final 2UP"}),
    _localised(_ML0 | {"Name": "Resultado 1o Tempo"}),
    _localised(_ML5000 | {"Name": "Super Odds"}, early="1"),
    _localised(_ML5000 | {"Name": None}),
    _localised(_ML5000 | {"Name": "Resultado Final"}),
    _localised(_ML0 | {"IsLive": True}),
    _localised(_ML0 | {"IsSuspended": True}),
    _localised(_ML0 | {"IsRemoved": True}),
    _localised(_ML0, [{"_id": "u11", "OutcomeType": "Casa", "DisplayOdds": {"Decimal": "@1"}}, {"_id": "u12", "Name": "X", "DisplayOdds": {"Decimal": "@2"}}, {"_id": "u13", "Name": "@A", "DisplayOdds": {"Decimal": "@3"}}, {"_id": "u14", "Side": 1, "IsDisabled": True, "DisplayOdds": {"Decimal": "@3"}}, {"_id": "u15", "Name": "Qwrtz", "DisplayOdds": {"Decimal": "@3"}}]),
]
_A03_SQL = """
m AS (SELECT k, home, away, e, unnest(CAST(e->'$.Markets' AS JSON[])) AS m FROM p),
n AS (SELECT *, m->>'$.MarketType._id' AS kind, norm(m->>'$.MarketType.LineTypeName') AS line, norm(coalesce(m->>'$.Name', m->>'$.MarketType.Name')) AS name,
    norm(concat_ws(' ', m->>'$.Name', m->>'$.MarketType.Name', m->>'$.MarketType.LineTypeName')) AS words FROM m),
s AS (SELECT k, home, away, e, kind, words, unnest(CAST(m->'$.Selections' AS JSON[])) AS s FROM n
  WHERE ((kind = 'ML0' AND line = '1x2' AND contains(name, 'resultado final')) OR (kind = 'ML5000' AND (contains(line, 'super odds') OR contains(name, 'super odds'))))
    AND coalesce(m->>'$.IsLive', '') <> 'true' AND coalesce(m->>'$.IsRemoved', '') <> 'true' AND coalesce(m->>'$.IsSuspended', '') <> 'true'),
r AS (SELECT k, CASE WHEN s->>'$.Side' = '1' OR norm(s->>'$.OutcomeType') = 'casa' THEN 'HOME' WHEN s->>'$.Side' = '2' OR norm(s->>'$.OutcomeType') = 'empate' THEN 'DRAW'
    WHEN s->>'$.Side' = '3' OR norm(s->>'$.OutcomeType') = 'fora' THEN 'AWAY' WHEN norm(s->>'$.Name') IN ('x', 'empate', 'draw') THEN 'DRAW' WHEN s->>'$.Name' = home THEN 'HOME' WHEN s->>'$.Name' = away THEN 'AWAY' END AS selection,
    CAST(s->>'$.DisplayOdds.Decimal' AS DOUBLE) AS price,
    CASE WHEN kind = 'ML5000' OR contains(words, 'super odds') THEN 'SEM_PA' WHEN regexp_matches(words, 'pagamento antecipado|early payout|2up|2 up') THEN 'COM_PA'
      WHEN kind = 'ML0' AND norm(e->>'$.Settings.EarlyPayout') NOT IN ('', '0', 'false', 'null', 'undefined') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category,
    CASE WHEN regexp_matches(words, 'pagamento antecipado|early payout|2up|2 up') THEN 1.0 ELSE 0.98 END AS early,
    CAST(right(regexp_replace(s->>'$._id', '[^0-9]', '', 'g'), 15) AS BIGINT) AS odd_id FROM s WHERE coalesce(s->>'$.IsDisabled', '') <> 'true')
"""


@query(rule_sql(A03, _A03_SQL))
def a03_localised(spark, d):
    """Standard and boosted markets, early payout by text or by the event's setting."""
    return _priced(payloads(spark, d, A03), feeds.LOCALISED)


# --- offers by market


def _offers(*markets: dict, offers: dict | None = None) -> dict:
    sides = [{"id": f"7{k}", "name": n, "price": f"#{k}"} for k, n in ((1, "1"), (2, "X"), (3, "2"))]
    return {"data": {"event": {"id": "@K", "name": "@H - @A", "startTime": 1786042800000}, "markets": [{"selections": sides} | m for m in markets], "marketOffersData": {"marketOffers": offers or {}}}}


_MRES = {"id": "m1", "name": "Resultado Final", "type": "MRES"}
_SHORT = {"selections": [{"id": "71", "name": "1", "price": "#1"}, {"id": "72", "name": "X", "price": "#2"}]}
A04 = [
    _offers(_MRES),
    _offers(_MRES, offers={"m1": [{"offerTypeId": 2}]}),
    _offers(_MRES | {"uniqueId": "u1"}, offers={"u1": [{"offerTypeId": 1, "text": "2 Gols  de Vantagem"}]}),
    _offers(_MRES | {"id": None, "uniqueId": "u1"}, offers={"u1": [{"offerTypeId": 1, "description": "Pagamento Antecipado"}], "m1": [{"offerTypeId": 2}]}),
    _offers(_MRES, offers={"m2": [{"offerTypeId": 2}]}),
    _offers({"id": "m1", "name": "Dupla", "type": "MR12"}),
    _offers({"id": "m1", "name": "Resultado 1o Tempo", "type": "HTRS"}),
    _offers({"id": "m1", "name": "RESULTADO   FINAL", "type": "OTHER"}),
    _offers(_MRES | _SHORT),
    _offers(_MRES | {"selections": [{"id": f"5{k}", "name": n, "price": f"#{k}"} for k, n in ((1, "1"), (2, "x"), (3, "2"))]}),
    _offers(_MRES, _MRES | {"selections": [{"id": f"8{k}", "name": n, "price": f"#{k}"} for k, n in ((1, "2"), (2, "X"), (3, "1"))]}),
    _offers({"name": "Resultado Final", "type": "MRES"}),
]
_A04_SQL = """
u AS (SELECT k, e, unnest(CAST(e->'$.data.markets' AS JSON[])) AS m, unnest(range(len(CAST(e->'$.data.markets' AS JSON[])))) AS n FROM p),
m AS (SELECT k, e, m, list_transform(CAST(m->'$.selections' AS JSON[]), lambda x: x->>'$.name') AS names FROM u WHERE coalesce(m->>'$.id', m->>'$.uniqueId') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY k, coalesce(m->>'$.id', m->>'$.uniqueId') ORDER BY n DESC) = 1),
g AS (SELECT k, e, m, list_concat(CAST(e->'$.data.marketOffersData.marketOffers'->(coalesce(m->>'$.id', '?')) AS JSON[]), CAST(e->'$.data.marketOffersData.marketOffers'->(coalesce(m->>'$.uniqueId', '?')) AS JSON[])) AS offers
  FROM m WHERE list_has_all(names, ['1', 'X', '2']) AND (m->>'$.type' IN ('MRES', 'MR12') OR regexp_matches(m->>'$.name', '(?i)resultado\\s+final'))),
s AS (SELECT k, unnest(CAST(m->'$.selections' AS JSON[])) AS s,
  len(list_filter(coalesce(offers, []), lambda o: coalesce(o->>'$.offerTypeId' = '2', false) OR regexp_matches(concat_ws(' ', o->>'$.text', o->>'$.description'), '(?i)2\\s*gols\\s+de\\s+vantagem|pagamento\\s+antecipado|early\\s+payout'))) > 0 AS ep FROM g),
r AS (SELECT k, CASE s->>'$.name' WHEN '1' THEN 'HOME' WHEN 'X' THEN 'DRAW' WHEN '2' THEN 'AWAY' END AS selection, CAST(s->>'$.price' AS DOUBLE) AS price,
  CASE WHEN ep THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.98 AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id FROM s)
"""


@query(rule_sql(A04, _A04_SQL))
def a04_offers_by_market(spark, d):
    """Offers under either id of a market; of markets that share an id the last."""
    return _priced(payloads(spark, d, A04), feeds.OFFERS_BY_MARKET)


# --- decoded odds in groups


def _grouped(*odds: dict) -> dict:
    return {"id": "#K", "startsAt": "2026-08-05T19:00:00Z", "homeTeam": "@H", "awayTeam": "@A", "odds": [{"marketName": "Vencedor", "groupName": "Resultado"} | o for o in odds]}


_SHORTS = [{"id": f"3{k}", "shortName": n, "price": f"#{k}"} for k, n in ((1, "1"), (2, "X"), (3, "2"))]
A05 = [
    _grouped(*_SHORTS),
    _grouped(*(o | {"name": "Pagamento Antecipado"} for o in _SHORTS)),
    _grouped(*(o | {"marketName": "Vencedor do 1o tempo"} for o in _SHORTS)),
    _grouped(*(o | {"groupName": "Resultado 1o tempo"} for o in _SHORTS)),
    _grouped(*(o | {"name": "2 UP"} for o in _SHORTS[:1]), *_SHORTS),
    _grouped(*(o | {"side": 2} for o in _SHORTS)),
    _grouped(*(o | {"shortName": "12"} for o in _SHORTS), _SHORTS[2] | {"price": 0}),
]
_A05_SQL = """
s AS (SELECT k, unnest(CAST(e->'$.odds' AS JSON[])) AS s FROM p),
r AS (SELECT k, CASE WHEN norm(s->>'$.shortName') = '1' OR s->>'$.side' = '1' THEN 'HOME' WHEN norm(s->>'$.shortName') = 'x' OR s->>'$.side' = '2' THEN 'DRAW' ELSE 'AWAY' END AS selection,
  CAST(s->>'$.price' AS DOUBLE) AS price, CASE WHEN regexp_matches(norm(concat_ws(' ', s->>'$.marketName', s->>'$.groupName', s->>'$.name')), 'pagamento antecipado|early payout|2up|2 up') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 1.0 AS early,
  CAST(s->>'$.id' AS BIGINT) AS odd_id FROM s WHERE norm(s->>'$.marketName') = 'vencedor' AND norm(s->>'$.groupName') = 'resultado' AND norm(s->>'$.shortName') IN ('1', 'x', '2'))
"""


@query(rule_sql(A05, _A05_SQL))
def a05_grouped_odds(spark, d):
    """The whole market and group names decide; early payout in any of three names, odd by odd."""
    return _priced(payloads(spark, d, A05), feeds.GROUPED_ODDS)


# --- external ids


def _external(*markets: dict) -> dict:
    return {"id": "#K", "homeTeamName": "@H", "awayTeamName": "@A", "date": "2026-08-05T19:00:00Z", "markets": [{"id": 1, "name": "1x2", "type": 1, "options": _OPTIONS} | m for m in markets]}


_OPTIONS = _three(lambda k: {"id": 60 + k, "odd": f"#{k}", "externalId": str(k)})
_WORDS = [{"id": 70 + k, "odd": f"#{k}", "name": n} for k, n in ((1, "Casa"), (2, "Empate"), (3, "Fora"))]
A06 = [
    _external({}),
    _external({"type": 1601}),
    _external({"name": "1X2 (Pagamento  Antecipado)"}),
    _external({"name": "1x2 - 1o Tempo"}),
    _external({"name": "1x2 (1o Tempo)"}),
    _external({"type": 2}),
    _external({"locked": True}),
    _external({"options": _OPTIONS[:1]}),
    _external({}, {"options": _WORDS}),
    _external({"options": [_WORDS[0] | {"blocked": True}, *_WORDS[1:], {"id": 9, "odd": "#1", "externalId": "1", "hide": True}]}),
    _external({"id": 2, "options": [o | {"locked": o["id"] == 61} for o in _OPTIONS]}, {"id": 3, "type": 1601}),
]
_A06_SQL = """
u AS (SELECT k, unnest(CAST(e->'$.markets' AS JSON[])) AS m, unnest(range(len(CAST(e->'$.markets' AS JSON[])))) AS n FROM p),
m AS (SELECT k, m, CAST(m->'$.options' AS JSON[]) AS o FROM u QUALIFY row_number() OVER (PARTITION BY k, m->>'$.id' ORDER BY n DESC) = 1),
s AS (SELECT k, m, unnest(o) AS s FROM m WHERE m->>'$.type' IN ('1', '1601') AND regexp_full_match(m->>'$.name', '(?i)1x2(\\s*\\(pagamento\\s+antecipado\\))?') AND coalesce(m->>'$.locked', '') <> 'true'
  AND (list_has_all(list_transform(o, lambda x: x->>'$.externalId'), ['1', '2', '3']) OR list_has_all(list_transform(o, lambda x: x->>'$.name'), ['Casa', 'Empate', 'Fora']))),
r AS (SELECT k, CASE WHEN s->>'$.externalId' = '1' OR s->>'$.name' = 'Casa' THEN 'HOME' WHEN s->>'$.externalId' = '2' OR s->>'$.name' = 'Empate' THEN 'DRAW' WHEN s->>'$.externalId' = '3' OR s->>'$.name' = 'Fora' THEN 'AWAY' END AS selection,
  CAST(s->>'$.odd' AS DOUBLE) AS price, CASE WHEN m->>'$.type' = '1601' OR regexp_matches(m->>'$.name', '(?i)pagamento\\s+antecipado|early\\s+payout') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.98 AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id
  FROM s WHERE coalesce(s->>'$.locked', '') <> 'true' AND coalesce(s->>'$.blocked', '') <> 'true' AND coalesce(s->>'$.hide', '') <> 'true')
"""


@query(rule_sql(A06, _A06_SQL))
def a06_external_ids(spark, d):
    """Whole market names, all three sides, of markets that share an id the last."""
    return _priced(payloads(spark, d, A06), feeds.EXTERNAL_IDS)


# --- runners with live data


def _runners(title: str = "Resultado", status: str = "OPEN", live: list | None = None, ids=(12345601, 12345602, 7), urn: str = "ppb:sbkMarket:924.398") -> dict:
    data = live or [{"selectionId": i, "runnerStatus": "ACTIVE", "displayOdds": {"decimal": f"#{k}"}} for k, i in enumerate(ids, 1)]
    return {"urn": "ppb:sbkEvent:event:@K", "sportevent": {"name": "@H x @A", "openDate": "2026-08-05T19:00:00Z"}, "markets": [{"groupTitle": title, "market": {"urn": urn, "name": "Match Odds", "liveData": {"sportsbookMarketStatus": status, "runners": data}, "runners": [{"name": n, "selectionId": i, "resultType": n} for i, n in zip(ids, ("HOME", "DRAW", "AWAY"))] + [{"name": "?", "selectionId": 5, "resultType": "OTHER"}]}}]}


A07 = [
    _runners(),
    _runners("2 Gols de Vantagem"),
    _runners("Pagamento   Antecipado"),
    _runners(status="SUSPENDED"),
    _runners(live=[{"selectionId": 12345601, "runnerStatus": "ACTIVE", "odds": {"decimal": "#1"}}, {"selectionId": 12345602, "runnerStatus": "REMOVED", "odds": {"decimal": "#2"}}, {"selectionId": 5, "runnerStatus": "ACTIVE", "odds": {"decimal": "#3"}}]),
    _runners(urn="ppb:sbkMarket:924.39812345678", ids=(1, 22, 333)),
    _runners(live=[{"selectionId": 7, "runnerStatus": "ACTIVE", "odds": {"decimal": "#1"}}, {"selectionId": 7, "runnerStatus": "ACTIVE", "odds": {"decimal": "#3"}, "displayOdds": {}}]),
]
_A07_SQL = """
m AS (SELECT k, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
l AS (SELECT k, m, unnest(CAST(m->'$.market.liveData.runners' AS JSON[])) AS l, unnest(range(len(CAST(m->'$.market.liveData.runners' AS JSON[])))) AS n FROM m WHERE m->>'$.market.liveData.sportsbookMarketStatus' = 'OPEN'),
w AS (SELECT k, m, l, l->>'$.selectionId' AS id FROM l QUALIFY row_number() OVER (PARTITION BY k, l->>'$.selectionId' ORDER BY n DESC) = 1),
s AS (SELECT k, unnest(CAST(m->'$.market.runners' AS JSON[])) AS s FROM m),
r AS (SELECT s.k, CASE WHEN s->>'$.resultType' IN ('HOME', 'DRAW', 'AWAY') THEN s->>'$.resultType' END AS selection, CAST(coalesce(l->>'$.displayOdds.decimal', l->>'$.odds.decimal') AS DOUBLE) AS price,
  CASE WHEN regexp_matches(concat_ws(' ', m->>'$.groupTitle', m->>'$.market.name'), '(?i)2\\s*gols\\s+de\\s+vantagem|pagamento\\s+antecipado|early\\s+payout') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.96 AS early,
  CAST(left(concat(regexp_replace(m->>'$.market.urn', '[^0-9]', '', 'g'), right(concat('000000', id), 6)), 18) AS BIGINT) AS odd_id
  FROM s JOIN w ON w.k = s.k AND w.id = s->>'$.selectionId' WHERE l->>'$.runnerStatus' = 'ACTIVE')
"""


@query(rule_sql(A07, _A07_SQL))
def a07_live_runners(spark, d):
    """Runners and their live data by id, of equal ids the last; ids of the market's digits and the selection's last six."""
    return _priced(payloads(spark, d, A07), feeds.LIVE_RUNNERS)


# --- three-way markets


def _three_way(outcomes: list | None = None, **market) -> dict:
    own = outcomes or [{"id": f"o{k}4", "name": n, "formatDecimal": f"@{k}", "odds": "9"} for k, n in ((1, "@H"), (2, "Empate"), (3, "@A"))]
    return {"id": "#K", "startTime": "2026-08-05T19:00:00Z", "participants": [{"name": "@A", "position": "AWAY"}, {"name": "@H", "position": "HOME"}], "markets": [{"id": "1", "type": "standard-3-way", "name": "Vencedor", "betMarketStatus": "OPEN", "outcomes": own} | market]}


A09 = [
    _three_way(),
    _three_way(type="standard-3-way-early-payout"),
    _three_way(metadata={"earlyPayout": "true"}),
    _three_way(name="Resultado Final - Pagamento Antecipado", type="match-odds"),
    _three_way(type="overtime-3-way", name="Escanteios"),
    _three_way(type="match-odds", name="Match Odds"),
    _three_way(type="2-way"),
    _three_way(betMarketStatus="SUSPENDED"),
    _three_way([{"id": "o1", "name": "Casa", "odds": "@1"}, {"id": "o2", "name": "Fora", "odds": "@2"}]),
    _three_way([{"id": "o1", "name": "home", "odds": "@1"}, {"name": "X", "odds": "@2"}, {"id": "none", "name": "2", "odds": "@3"}, {"id": "o4", "name": "Qwrtz", "odds": "@3"}]),
]
_A09_SQL = """
m AS (SELECT k, home, away, e, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
s AS (SELECT k, home, away, e, m, unnest(CAST(m->'$.outcomes' AS JSON[])) AS s FROM m WHERE m->>'$.type' IN ('standard-3-way', 'standard-3-way-early-payout', 'overtime-3-way', 'match-odds') AND json_array_length(m->'$.outcomes') >= 3
  AND (regexp_matches(norm(m->>'$.name'), 'resultado\\s+(final|da partida)|1x2|vencedor|match\\s+odds') OR m->>'$.type' IN ('standard-3-way', 'standard-3-way-early-payout')) AND m->>'$.betMarketStatus' = 'OPEN'),
q AS (SELECT *, norm(s->>'$.name') AS n, regexp_replace(coalesce(s->>'$.id', m->>'$.id'), '[^0-9]', '', 'g') AS digits FROM s),
r AS (SELECT k, CASE WHEN n IN ('1', 'casa', 'home') THEN 'HOME' WHEN n IN ('2', 'fora', 'away') THEN 'AWAY' WHEN n IN ('x', 'empate', 'draw') THEN 'DRAW' WHEN s->>'$.name' = home THEN 'HOME' WHEN s->>'$.name' = away THEN 'AWAY' END AS selection,
  CAST(coalesce(s->>'$.formatDecimal', s->>'$.odds') AS DOUBLE) AS price,
  CASE WHEN m->>'$.type' = 'standard-3-way-early-payout' OR m->>'$.metadata.earlyPayout' = 'true' OR regexp_matches(concat_ws(' ', m->>'$.type', m->>'$.name'), '(?i)pagamento\\s+antecipado|early\\s+payout') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.99 AS early,
  CAST(CASE WHEN digits <> '' THEN left(digits, 15) ELSE left(concat(e->>'$.id', CAST(list_sum(list_transform(string_split(s->>'$.name', ''), lambda c: ascii(c))) AS BIGINT)), 15) END AS BIGINT) AS odd_id FROM q)
"""


@query(rule_sql(A09, _A09_SQL))
def a09_three_way(spark, d):
    """Types and names of three-way markets; ids from digits, else from the name's letters."""
    return _priced(payloads(spark, d, A09), feeds.THREE_WAY)


# --- flat odds


def _flat(*odds: dict) -> dict:
    return {"event_id": "#K", "home": "@H", "away": "@A", "date_start": "2026-08-05 16:00:00", "odds": list(odds)}


def _group(market: dict, first: int = 1, skip: int = 0) -> list[dict]:
    return [{"id": f"x{first}{k}", "odd": f"@{k}", "outcome_id": str(k)} | market for k in (1, 2, 3) if k != skip]


_WDW = {"market_id": 999133, "market_name": "Win Draw Win", "market_code": "w"}
_RESULT = {"market_id": 7, "market_name": "Resultado da Partida", "market_code": "r"}
_EARLY = {"market_id": 99979617, "market_name": "Qualquer", "market_code": "p"}
A10 = [
    _flat(*_group(_WDW)),
    _flat(*_group(_RESULT, 4), *_group(_WDW, 5)),
    _flat(*_group(_RESULT, 4), *_group(_WDW, 5, skip=2)),
    _flat(*_group(_EARLY, 6), *_group(_RESULT, 7)),
    _flat(*_group(_EARLY, 6, skip=1), *_group({"market_id": 5, "market_name": "Pag. Antecipado", "market_code": ""}, 8)),
    _flat(*_group(_RESULT | {"is_live": 1})),
    _flat(*_group(_RESULT | {"market_status_id": 0})),
    _flat(*_group(_RESULT | {"selection_market_id": "a"}, 2), *_group(_RESULT | {"selection_market_id": "b"}, 3)),
    _flat(*_group(_RESULT, 2), *_group(_RESULT, 3)),
    _flat({"id": "n1", "odd": "0", "outcome_id": "1"} | _RESULT, {"id": "n12", "odd": "@1", "outcome_name": "@H"} | _RESULT, {"id": "n3", "odd": "@2", "outcome_code": "draw"} | _RESULT, {"id": "n4", "odd": "@3", "outcome_name": "@A"} | _RESULT),
    _flat(*_group({"market_id": 1, "market_name": "Total", "market_code": "1x2"}, 4), *_group({"market_id": 1, "market_name": "Total", "market_code": "1X2"}, 5)),
    _flat(*_group({"market_id": 3, "market_name": "Full Time Result", "market_code": "2 up"})),
]
_A10_SQL = """
u AS (SELECT k, home, away, unnest(CAST(e->'$.odds' AS JSON[])) AS o, unnest(range(len(CAST(e->'$.odds' AS JSON[])))) AS n FROM p),
c AS (SELECT *, norm(o->>'$.market_name') AS name, norm(o->>'$.market_code') AS code, norm(coalesce(o->>'$.outcome_name', o->>'$.outcome_code')) AS word, try_cast(o->>'$.odd' AS DOUBLE) AS price FROM u
  WHERE coalesce(o->>'$.is_live', '') <> '1' AND coalesce(o->>'$.market_status_id', '') <> '0'),
f AS (SELECT *, CASE WHEN o->>'$.market_id' = '99979617' OR regexp_matches(trim(concat(name, ' ', code)), 'pag antecipado|pagamento antecipado|full time result 2 up|2 up') THEN 100
    WHEN o->>'$.market_id' = '999133' OR code = 'win draw win' THEN 90 WHEN name IN ('resultado da partida', 'resultado partida', 'resultado final') OR (o->>'$.market_id' = '1' AND o->>'$.market_code' = '1x2') THEN 80 END AS priority,
  CASE WHEN o->>'$.outcome_id' = '1' OR o->>'$.outcome_code' = '{$competitor1}' THEN 'HOME' WHEN o->>'$.outcome_id' = '2' OR o->>'$.outcome_code' = 'draw' THEN 'DRAW' WHEN o->>'$.outcome_id' = '3' OR o->>'$.outcome_code' = '{$competitor2}' THEN 'AWAY'
    WHEN word IN ('empate', 'draw') THEN 'DRAW' WHEN word = home THEN 'HOME' WHEN word = away THEN 'AWAY' END AS selection,
  concat_ws(':', coalesce(o->>'$.market_id', ''), coalesce(o->>'$.market_name', ''), coalesce(o->>'$.market_code', ''), coalesce(o->>'$.selection_market_id', '')) AS g FROM c),
s AS (SELECT * FROM f WHERE priority IS NOT NULL AND selection IS NOT NULL AND price > 0 QUALIFY row_number() OVER (PARTITION BY k, priority = 100, g, selection ORDER BY n) = 1),
w AS (SELECT *, count(*) OVER (PARTITION BY k, priority = 100, g) AS sides, min(n) OVER (PARTITION BY k, priority = 100, g) AS began FROM s),
b AS (SELECT *, dense_rank() OVER (PARTITION BY k, priority = 100 ORDER BY priority DESC, began) AS place FROM w WHERE sides = 3),
r AS (SELECT k, selection, price, CASE WHEN priority = 100 THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 1.0 AS early, CAST(right(regexp_replace(o->>'$.id', '[^0-9]', '', 'g'), 18) AS BIGINT) AS odd_id FROM b WHERE place = 1)
"""


@query(rule_sql(A10, _A10_SQL))
def a10_flat_odds(spark, d):
    """Flat odds by market; of the complete ones the best of either category."""
    return _priced(payloads(spark, d, A10), feeds.FLAT_ODDS)


# --- market types


def _typed(odds: list | None = None, **market) -> dict:
    own = odds or [{"id": 40 + k, "value": f"#{k}", "state": 1, "name": n} for k, n in ((1, "@H"), (2, "Empate"), (3, "@A"))]
    return {"id": "#K", "startDate": "2026-08-05T19:00:00", "competitors": [{"name": "@H"}, {"name": "@A"}], "markets": [{"id": 1, "marketTypeId": 1, "name": "1x2", "odds": own} | market]}


A11 = [
    _typed(),
    _typed(marketTypeId=1252),
    _typed(name="1X2 - Pagamento  Antecipado"),
    _typed(name="Handicap 1x2"),
    _typed(published=False),
    _typed(state=0),
    _typed(marketTypeId=9),
    _typed([{"id": 1, "value": "#1", "state": 1, "externalId": "1", "name": "?"}, {"id": 2, "value": "#2", "state": 1, "externalId": "3", "name": "Empate"}, {"id": 3, "value": "#3", "state": 1, "externalId": "3", "name": "?"}]),
    _typed([{"id": 1, "value": "#1", "state": 0, "externalId": "1"}, {"id": 2, "value": "#2", "state": 1, "externalId": "2", "published": False}, {"id": 3, "value": "#3", "state": 1, "externalId": "3"}, {"id": 4, "value": "#3", "state": 1, "name": "Qwrtz"}]),
]
_A11_SQL = """
m AS (SELECT k, home, away, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
s AS (SELECT k, home, away, m, unnest(CAST(m->'$.odds' AS JSON[])) AS s FROM m WHERE m->>'$.marketTypeId' IN ('1', '1252') AND starts_with(norm(m->>'$.name'), '1x2') AND coalesce(m->>'$.published', '') <> 'false' AND coalesce(m->>'$.state', '') <> '0'),
r AS (SELECT k, CASE WHEN s->>'$.externalId' = '1' THEN 'HOME' WHEN s->>'$.externalId' = '2' OR norm(s->>'$.name') = 'empate' THEN 'DRAW' WHEN s->>'$.externalId' = '3' THEN 'AWAY' WHEN s->>'$.name' = home THEN 'HOME' WHEN s->>'$.name' = away THEN 'AWAY' END AS selection,
  CAST(s->>'$.value' AS DOUBLE) AS price, CASE WHEN m->>'$.marketTypeId' = '1252' OR regexp_matches(m->>'$.name', '(?i)pagamento\\s+antecipado|early\\s+payout') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.99 AS early,
  CAST(s->>'$.id' AS BIGINT) AS odd_id FROM s WHERE s->>'$.state' = '1' AND coalesce(s->>'$.published', '') <> 'false')
"""


@query(rule_sql(A11, _A11_SQL))
def a11_market_types(spark, d):
    """Markets by type and beginning of their name; a draw's name comes before the away code."""
    return _priced(payloads(spark, d, A11), feeds.MARKET_TYPES)


# --- thousandths


def _milli(outcomes: list | None = None, label: str = "Resultado Final", english: str = "Full Time", criterion: int | None = None, kind: int = 2) -> dict:
    own = outcomes or [{"id": 20 + k, "odds": f"#M{k}", "type": t, "status": "OPEN"} for k, t in ((1, "OT_ONE"), (2, "OT_CROSS"), (3, "OT_TWO"))]
    return {"event": {"id": "#K", "homeName": "@H", "awayName": "@A", "start": "2026-08-05T19:00:00Z"}, "betOffers": [{"id": 1, "criterion": {"id": criterion, "label": label, "englishLabel": english}, "betOfferType": {"id": kind}, "outcomes": own}]}


A12 = [
    _milli(),
    _milli(label="Outro", english="Other", criterion=1001159858),
    _milli(label="Outro", english="Other", criterion=2100089307),
    _milli(label="Resultado Final com Ganho Antecipado", english="x"),
    _milli(label="x", english="Full Time - 2UP"),
    _milli(label="Intervalo", english="Half Time"),
    _milli(kind=6),
    _milli([{"id": 1, "odds": "#M1", "label": "1", "status": "OPEN"}, {"id": 2, "odds": "#M2", "participant": "Empate", "status": "OPEN"}, {"id": 3, "odds": "#M3", "participant": "@A", "label": "?", "status": "OPEN"}]),
    _milli([{"id": 1, "odds": "#M1", "type": "OT_ONE", "status": "OPEN"}, {"id": 2, "odds": "#M2", "type": "OT_CROSS", "status": "SUSPENDED"}, {"id": 3, "type": "OT_TWO", "status": "OPEN"}]),
    _milli([{"id": 1, "odds": "#M1", "type": "OT_ONE", "status": "OPEN"}, {"id": 2, "odds": "#M2", "type": "OT_TWO", "status": "OPEN"}]),
]
_A12_SQL = """
m AS (SELECT k, home, away, unnest(CAST(e->'$.betOffers' AS JSON[])) AS m FROM p),
c AS (SELECT *, norm(concat_ws(' ', m->>'$.criterion.label', m->>'$.criterion.englishLabel')) AS words FROM m),
s AS (SELECT k, home, away, m, unnest(CAST(m->'$.outcomes' AS JSON[])) AS s FROM c WHERE m->>'$.betOfferType.id' = '2' AND json_array_length(m->'$.outcomes') = 3
  AND (m->>'$.criterion.id' IN ('1001159858', '2100089307') OR words = 'resultado final full time' OR regexp_matches(words, 'resultado final com ganho antecipado|full time 2up'))),
q AS (SELECT *, coalesce(s->>'$.participant', s->>'$.label') AS n FROM s WHERE s->>'$.status' = 'OPEN'),
r AS (SELECT k, CASE WHEN s->>'$.type' = 'OT_ONE' OR s->>'$.label' = '1' THEN 'HOME' WHEN s->>'$.type' = 'OT_CROSS' OR s->>'$.label' = 'X' THEN 'DRAW' WHEN s->>'$.type' = 'OT_TWO' OR s->>'$.label' = '2' THEN 'AWAY'
    WHEN norm(n) IN ('x', 'empate', 'draw') THEN 'DRAW' WHEN n = home THEN 'HOME' WHEN n = away THEN 'AWAY' END AS selection, CAST(s->>'$.odds' AS DOUBLE) / 1000 AS price,
  CASE WHEN m->>'$.criterion.id' = '2100089307' OR regexp_matches(concat_ws(' ', m->>'$.criterion.label', m->>'$.criterion.englishLabel'), '(?i)ganho\\s+antecipado|2up') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.99 AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id FROM q)
"""


@query(rule_sql(A12, _A12_SQL))
def a12_criteria(spark, d):
    """Offers by criterion id or text, exactly three outcomes, sides by type, label, word or similar name."""
    return _priced(payloads(spark, d, A12), feeds.MILLI_ODDS)


# --- tags (A13, S15)


def _tagged(tags: list | None = None, items: list | None = None, **market) -> dict:
    own = items or [{"id": f"5{k}", "code": c, "price": f"#{k}", "isAvailable": True} for k, c in ((1, "1"), (2, "X"), (3, "2"))]
    return {"betContextId": "#K", "startTimeUTC": "2026-08-05T19:00:00Z", "additionalCaptions": {"competitor1": "@H", "competitor2": "@A"}, "marketTags": tags, "markets": [{"marketId": 9, "marketSysname": "SOCCER_MATCH_RESULT_PRELIVE", "betItems": own} | market]}


A13 = [
    _tagged(),
    _tagged([{"marketId": 9, "tag": "soccer_2_goals_ahead_early_payout"}]),
    _tagged([{"marketId": 8, "tag": "EARLY_PAYOUT"}, {"marketId": 9, "tag": "TOP"}]),
    _tagged(caption="Pague Antecipado"),
    _tagged(marketSysname="SOCCER_MATCH_RESULT_PRELIVE_12_ODDS_KEY"),
    _tagged(marketSysname="SOCCER_MATCH_RESULT_HALF"),
    _tagged(items=[{"id": "1", "code": "1", "price": "#1", "isAvailable": True}, {"id": "2", "code": "X", "price": "#2", "isAvailable": True}]),
    _tagged(items=[{"id": "1", "code": "1", "price": "#1", "isAvailable": True}, {"id": "2", "code": "X", "price": "#2", "isAvailable": False}, {"id": "3", "code": "2", "price": 0, "isAvailable": True}, {"id": "4", "code": "12", "price": "#3", "isAvailable": True}]),
]
_A13_SQL = """
m AS (SELECT k, e, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
g AS (SELECT k, unnest(CAST(e->'$.marketTags' AS JSON[])) AS g FROM p WHERE json_type(e->'$.marketTags') = 'ARRAY'),
y AS (SELECT DISTINCT k, g->>'$.marketId' AS id FROM g WHERE regexp_matches(g->>'$.tag', '(?i)EARLY_PAYOUT|PAGAMENTO')),
s AS (SELECT k, m, unnest(CAST(m->'$.betItems' AS JSON[])) AS s FROM m WHERE list_has_all(list_transform(CAST(m->'$.betItems' AS JSON[]), lambda x: x->>'$.code'), ['1', 'X', '2'])
  AND (m->>'$.marketSysname' = 'SOCCER_MATCH_RESULT_PRELIVE' OR regexp_full_match(m->>'$.marketSysname', '(?i)SOCCER_MATCH_RESULT(_PRELIVE)?(_\\d+)?_ODDS_KEY'))),
r AS (SELECT s.k, CASE s->>'$.code' WHEN '1' THEN 'HOME' WHEN 'X' THEN 'DRAW' WHEN '2' THEN 'AWAY' END AS selection, CAST(s->>'$.price' AS DOUBLE) AS price,
  CASE WHEN y.id IS NOT NULL OR regexp_matches(concat_ws(' ', m->>'$.marketSysname', m->>'$.caption', m->>'$.displayCaption'), '(?i)pagamento\\s*antecipado|pague\\s*antecipado|early\\s*payout') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category,
  CASE WHEN y.id IS NOT NULL THEN 0.99 ELSE 0.95 END AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id FROM s LEFT JOIN y ON y.k = s.k AND y.id = m->>'$.marketId' WHERE s->>'$.isAvailable' = 'true')
"""


@query(rule_sql(A13, _A13_SQL))
def a13_tagged_markets(spark, d):
    """Early payout by a tag of the market, else by its texts."""
    return _priced(payloads(spark, d, A13), feeds.TAGGED_MARKETS)


# --- parameters


def _parameters(parameters: list | None = None, options: list | None = None, **market) -> dict:
    own = options or [{"id": 30 + k, "name": {"value": n}, "status": "Visible", "price": {"odds": f"#{k}"}} for k, n in ((1, "@H"), (2, "X"), (3, "@A"))]
    return {"id": "2:@K", "startDate": "2026-08-05T19:00:00Z", "participants": [{"name": {"value": "@H"}}, {"name": {"value": "@A"}}], "optionMarkets": [{"id": 1, "name": {"value": "Resultado"}, "status": "Visible", "parameters": parameters or _USUAL, "options": own} | market]}


_USUAL = [{"key": "MarketType", "value": "3way"}, {"key": "Period", "value": "RegularTime"}]
A15 = [
    _parameters(),
    _parameters([*_USUAL, {"key": "MarketSubType", "value": "2Up"}]),
    _parameters(name={"value": "Resultado vp (+2)"}),
    _parameters([{"key": "MarketType", "value": "3way"}, {"key": "Period", "value": "FirstHalf"}]),
    _parameters([{"key": "MarketType", "value": "2way"}, *_USUAL]),
    _parameters(status="Hidden"),
    _parameters(options=[{"id": 1, "name": {"value": "O Empate"}, "status": "Visible", "price": {"odds": "#2"}}, {"id": 2, "name": {"value": "@A"}, "status": "Suspended", "price": {"odds": "#3"}}, {"id": 3, "name": {"value": "Qwrtz"}, "status": "Visible", "price": {"odds": "#3"}}]),
]
_A15_SQL = """
m AS (SELECT k, home, away, unnest(CAST(e->'$.optionMarkets' AS JSON[])) AS m FROM p),
v AS (SELECT *, list_filter(CAST(m->'$.parameters' AS JSON[]), lambda x: x->>'$.key' = 'MarketType')[1]->>'$.value' AS kind, list_filter(CAST(m->'$.parameters' AS JSON[]), lambda x: x->>'$.key' = 'Period')[1]->>'$.value' AS period,
  list_filter(CAST(m->'$.parameters' AS JSON[]), lambda x: x->>'$.key' = 'MarketSubType')[1]->>'$.value' AS sub FROM m),
s AS (SELECT k, home, away, m, sub, unnest(CAST(m->'$.options' AS JSON[])) AS s FROM v WHERE m->>'$.status' = 'Visible' AND kind = '3way' AND period = 'RegularTime'),
r AS (SELECT k, CASE WHEN regexp_matches(s->>'$.name.value', '(?i)^x$|empate') THEN 'DRAW' WHEN s->>'$.name.value' = home THEN 'HOME' WHEN s->>'$.name.value' = away THEN 'AWAY' END AS selection, CAST(s->>'$.price.odds' AS DOUBLE) AS price,
  CASE WHEN sub = '2Up' OR regexp_matches(m->>'$.name.value', '(?i)VP\\s*\\(\\+2\\)') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.95 AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id FROM s WHERE s->>'$.status' = 'Visible')
"""


@query(rule_sql(A15, _A15_SQL))
def a15_parameters(spark, d):
    """Markets by their parameters, the first of a key; sides by similar names."""
    return _priced(payloads(spark, d, A15), feeds.PARAMETERS)


# --- exchange


def _exchange(runners: list | None = None, source: str | None = None, dball: str | None = "{}", **market) -> dict:
    own = runners or [{"id": f"80{k}", "name": n, "status": "open", "prices": [{"decimal-odds": 99, "side": "lay"}, {"decimal-odds": f"#{k}", "side": "back"}]} for k, n in ((1, "@H"), (2, "Draw"), (3, "@A"))]
    return {"id": "@K", "start": "2026-08-05T19:00:00Z", "source": source, "rawDball": dball, "event-participants": [{"participant-name": "@H"}, {"participant-name": "@A"}], "markets": [{"id": "1", "name": "Match Odds", "status": "open", "market-type": "one_x_two", "runners": own} | market]}


A18 = [
    _exchange(),
    _exchange(dball=None),
    _exchange(source="exchange"),
    _exchange(name="Winner 2 UP"),
    _exchange(**{"name": "?", "name-original": "Resultado da Partida (Pagamento Antecipado)"}),
    _exchange(name="Half Time"),
    _exchange(live=True),
    _exchange(status="suspended"),
    _exchange(**{"market-type": "total"}),
    _exchange([{"id": "1", "name": "Empate", "status": "open", "prices": [{"odds": "#2", "side": "lay"}]}, {"id": "2", "name": "@H", "status": "open", "withdrawn": True, "prices": [{"odds": "#1", "side": "back"}]}, {"id": "3", "name": "@A", "status": "closed", "prices": [{"odds": "#1", "side": "back"}]}, {"id": "5", "name": "@A", "status": "open", "prices": []}]),
]
_A18_SQL = """
m AS (SELECT k, home, away, e, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
n AS (SELECT *, norm(concat_ws(' ', m->>'$.name', m->>'$."name-original"')) AS words FROM m),
s AS (SELECT k, home, away, e, words, unnest(CAST(m->'$.runners' AS JSON[])) AS s FROM n WHERE m->>'$.status' = 'open' AND coalesce(m->>'$.live', '') <> 'true' AND m->>'$."market-type"' = 'one_x_two'
  AND regexp_matches(words, 'match odds|resultado da partida|moneyline|winner|1x2')),
b AS (SELECT *, coalesce(list_filter(CAST(s->'$.prices' AS JSON[]), lambda x: x->>'$.side' = 'back')[1], CAST(s->'$.prices' AS JSON[])[1]) AS b FROM s WHERE s->>'$.status' = 'open' AND coalesce(s->>'$.withdrawn', '') <> 'true'),
r AS (SELECT k, CASE WHEN norm(s->>'$.name') IN ('draw', 'empate') THEN 'DRAW' WHEN norm(s->>'$.name') = norm(home) THEN 'HOME' WHEN norm(s->>'$.name') = norm(away) THEN 'AWAY' END AS selection,
  CAST(coalesce(b->>'$."decimal-odds"', b->>'$.odds') AS DOUBLE) AS price, CASE WHEN regexp_matches(words, 'pagamento antecipado|early payout|2up|2 up') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 1.0 AS early,
  CAST(right(regexp_replace(s->>'$.id', '[^0-9]', '', 'g'), 15) AS BIGINT) AS odd_id, CASE WHEN coalesce(e->>'$.source', '') = 'exchange' OR e->>'$.rawDball' IS NULL THEN 'exchange' ELSE 'tradeball' END AS bookmaker FROM b)
"""


@query(rule_sql(A18, _A18_SQL, "SELECT CAST(k AS VARCHAR) AS event_id, bookmaker, selection, round(price, 6) AS price, pa_category, odd_id AS source_odd_id FROM r WHERE selection IS NOT NULL AND price > 0"))
def a18_exchange(spark, d):
    """The first price to back, else the first; two bookmakers by the event's source."""
    got = feeds.prices(payloads(spark, d, A18), feeds.EXCHANGE)
    return got.select("event_id", "bookmaker", "selection", F.round("price", 6).alias("price"), "pa_category", "source_odd_id")


# --- side labels


def _labelled(odds: list | None = None, **market) -> dict:
    own = odds or [{"foId": f"#K{k}", "hO": f"#{k}", "pSh": s, "hSh": n} for k, s, n in ((1, "", "@H"), (2, "Empate", ""), (3, "Fora", ""))]
    return {"fId": "@K", "fsd": 1786042800000, "hcN": "@H", "acN": "@A", "btgs": [{"btgId": 7988, "btgN": "Mercado", "fos": [o | {"foId": 100 + n} for n, o in enumerate(own)]} | market]}


A19 = [
    _labelled(),
    _labelled(btgId=115382, btgN="1X2 ( 2UP )"),
    _labelled(btgId=1, btgN="Resultado", btgNO="H/D/A"),
    _labelled(btgId=1, btgN="Resultado do tempo"),
    _labelled(btgId=1, btgN="x", mrkp="xUp=2"),
    _labelled([{"hO": "#1", "hSh": "?", "oc": "@H"}, {"hO": "#2", "oc": "O empate"}, {"hO": "#3", "btN": "away"}, {"hO": "#3", "hSh": "Qwrtz"}]),
    _labelled([{"hO": "#1", "pSh": "Casa", "valid": False}, {"hO": "#2", "pSh": "Draw", "valid": False, "tvalid": True}, {"hO": "#3", "pSh": "Fora", "freeze": True}, {"hO": 0, "pSh": "Fora"}]),
]
_A19_SQL = """
m AS (SELECT k, home, away, unnest(CAST(e->'$.btgs' AS JSON[])) AS m FROM p),
n AS (SELECT *, concat_ws(' ', m->>'$.btgN', m->>'$.btgNO', m->>'$.btgMN', m->>'$.mbtgMN', m->>'$.mrkp') AS words FROM m),
s AS (SELECT k, home, away, words, unnest(CAST(m->'$.fos' AS JSON[])) AS s FROM n WHERE m->>'$.btgId' IN ('7988', '115382') OR (regexp_matches(words, '(?i)resultado') AND regexp_matches(words, '(?i)partida|h/d/a|1x2')) OR regexp_matches(words, '(?i)1x2\\s*\\(\\s*2up\\s*\\)|xup=2')),
q AS (SELECT *, concat_ws(' ', s->>'$.pSh', s->>'$.btN') AS side, concat_ws(' ', s->>'$.hSh', s->>'$.oc') AS label FROM s WHERE (coalesce(s->>'$.valid', '') <> 'false' OR s->>'$.tvalid' = 'true') AND coalesce(s->>'$.freeze', '') <> 'true'),
r AS (SELECT k, CASE WHEN regexp_matches(side, '(?i)empate|draw') THEN 'DRAW' WHEN regexp_matches(side, '(?i)home|casa') THEN 'HOME' WHEN regexp_matches(side, '(?i)away|fora') THEN 'AWAY' WHEN regexp_matches(label, '(?i)empate|draw') THEN 'DRAW'
    WHEN s->>'$.hSh' = home OR s->>'$.oc' = home THEN 'HOME' WHEN s->>'$.hSh' = away OR s->>'$.oc' = away THEN 'AWAY' END AS selection, CAST(s->>'$.hO' AS DOUBLE) AS price,
  CASE WHEN regexp_matches(words, '(?i)1x2\\s*\\(\\s*2up\\s*\\)|xup=2') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.95 AS early, CAST(s->>'$.foId' AS BIGINT) AS odd_id FROM q)
"""


@query(rule_sql(A19, _A19_SQL))
def a19_side_labels(spark, d):
    """Sides by a label, else by the better of two names."""
    return _priced(payloads(spark, d, A19), feeds.SIDE_LABELS)


# --- decoded results


def _results(names=("@H", "Empate", "@A"), name: str = "Resultado Final", additional: list | None = None, price3="#3") -> dict:
    return {"id": "#K", "startsAt": "2026-08-05T19:00:00Z", "homeTeam": "@H", "awayTeam": "@A", "markets": [{"id": 1, "name": name, "additional": additional, "results": [{"id": 10 + k, "name": n, "price": p} for k, (n, p) in enumerate(zip(names, ("#1", "#2", price3)))]}]}


A20 = [
    _results(),
    _results(name="Resultado da partida - Odds Melhoradas"),
    _results(name="Resultado da partida", additional=[{"key": "promo", "value": "2 gols de vantagem"}]),
    _results(additional=[{"key": "EarlyPayout", "value": ""}]),
    _results(name="Resultado final 1o tempo"),
    _results(("0", "empate tecnico", "1")),
    _results(("a||1|", "b||x|", "c||2|")),
    _results(("0 @H", "Empate", "1 @A"), name="resultado final odds melhoradas"),
    _results(("@H", "Qwrtz", "@A"), price3=0),
    _results(("@H", "@A"), name="Resultado Final"),
]
_A20_SQL = """
m AS (SELECT k, home, away, unnest(CAST(e->'$.markets' AS JSON[])) AS m FROM p),
s AS (SELECT k, home, away, m, unnest(CAST(m->'$.results' AS JSON[])) AS s FROM m WHERE json_array_length(m->'$.results') = 3 AND norm(m->>'$.name') IN ('resultado da partida', 'resultado final', 'resultado da partida odds melhoradas', 'resultado final odds melhoradas')),
q AS (SELECT *, norm(s->>'$.name') AS n, s->>'$.name' AS raw, norm(concat_ws(' ', m->>'$.name', m->>'$.additional[0].key', m->>'$.additional[0].value')) AS words FROM s),
r AS (SELECT k, CASE WHEN regexp_matches(raw, '(?i)\\|\\|x\\|') OR n = 'empate' OR starts_with(n, 'empate ') THEN 'DRAW' WHEN contains(raw, '||1|') OR n = '0' OR starts_with(n, '0 ') THEN 'HOME' WHEN contains(raw, '||2|') OR n = '1' OR starts_with(n, '1 ') THEN 'AWAY'
    WHEN raw = home THEN 'HOME' WHEN raw = away THEN 'AWAY' END AS selection, CAST(s->>'$.price' AS DOUBLE) AS price,
  CASE WHEN regexp_matches(words, 'early payout|earlypayout|pagamento antecipado|2 gols de vantagem|2up|2 up') THEN 'COM_PA' ELSE 'SEM_PA' END AS pa_category, 0.99 AS early, CAST(s->>'$.id' AS BIGINT) AS odd_id FROM q)
"""


@query(rule_sql(A20, _A20_SQL))
def a20_decoded_results(spark, d):
    """Four market names, three results, sides by code, place or similar name."""
    return _priced(payloads(spark, d, A20), feeds.DECODED_RESULTS)
