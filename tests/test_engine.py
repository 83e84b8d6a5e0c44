"""Behaviour and boundaries of the price engine."""

import itertools
import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddsweave.functions import rules, similarity, text
from oddsweave.operators import consensus, control, dedupe, matching, reports, state, targets, writepath

START = datetime(2026, 7, 14, 18, 45)
PAIR = "starts_at timestamp, home_team string, away_team string, league_name string, b_starts_at timestamp, b_home_team string, b_away_team string, b_league_name string"


def pairs(spark, rows, league=None, shift=0):
    return spark.createDataFrame([(START, a, b, league, START + timedelta(seconds=shift), c, d, league) for a, b, c, d in rows], PAIR)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_unrelated_events_are_rejected_at_the_same_kickoff(spark):
    rows = [("Clyde", "Airdrie United", "FC United of Manchester", "Rochdale FC"), ("Brechin", "Livingston", "Leamington FC", "Brackley Town"), ("Linlithgow Rose", "ST Johnstone", "Spartans", "Stirling Albion"), ("Spartans", "Stirling Albion", "Bedfont Sports FC", "St Albans City")]
    got = matching.match(pairs(spark, rows, "Scottish League Cup"), matching.Options(league_scoped=True, trusted=True)).collect()
    assert not any(r.matched for r in got)


def test_known_aliases_are_accepted(spark):
    rows = [("KuPS", "Inter Turku", "Kuopion Palloseura", "FC Inter Turku"), ("Manchester United", "Arsenal", "Man Utd", "Arsenal FC"), ("CRB", "Nautico", "Clube de Regatas Brasil", "Nautico Recife"), ("Gyori ETO FC", "Vikingur Reykjavik", "Gyor ETO FC", "Vikingur Reykjavik"), ("KuPS", "Vardar Skopje", "KuPS Kuopio", "FK Vardar")]
    assert all(r.matched for r in matching.match(pairs(spark, rows)).collect())


def test_one_candidate_is_no_trusted_scope(spark):
    fixtures = spark.createDataFrame([(1, START, "Brechin", "Livingston", None)], "fixture_id long, starts_at timestamp, home_team string, away_team string, league_name string")
    events = spark.createDataFrame([(9, START, "Leamington FC", "Brackley Town", None)], "event_id long, b_starts_at timestamp, b_home_team string, b_away_team string, b_league_name string")
    assert matching.best_canonical(fixtures, events, matching.Options(league_scoped=True)).count() == 0


def test_inverted_order(spark):
    got = matching.match(pairs(spark, [("Celtic", "Aberdeen", "Aberdeen", "Celtic")], "Premiership"), matching.Options(league_scoped=True, trusted=True)).first()
    assert got.matched and got.orientation == "INVERTED"
    assert [one(spark, rules.oriented(F.lit(s), F.lit("INVERTED"))) for s in ("HOME", "DRAW", "AWAY")] == ["AWAY", "DRAW", "HOME"]


def test_time_bounds_and_reasons(spark):
    rows = [("Celtic", "Aberdeen", "Celtic", "Aberdeen")]
    assert matching.match(pairs(spark, rows, shift=1200)).first().reason == "below-threshold"  # in time, but with a time score of 0
    assert matching.match(pairs(spark, rows, shift=600)).first().reason == "matched"
    assert matching.match(pairs(spark, rows, shift=1201)).first().reason == "time-rejected"
    virtual = [("Celtic", "Aberdeen", "Celtic (Esports)", "Aberdeen")]
    assert matching.match(pairs(spark, virtual)).first().reason == "virtual-event-rejected"
    assert matching.match(pairs(spark, [("Celtic", "Aberdeen", "Rapid", "Sturm")])).first().reason == "no-shared-token"
    none = spark.createDataFrame([(None, "a", "b", None, START, "a", "b", None)], PAIR)
    assert matching.match(none).first().reason == "invalid-time"


def test_margin_and_ties(spark):
    rows = [(1, 10, 0.90), (1, 11, 0.89), (2, 10, 0.90), (2, 11, 0.85), (3, 10, 0.5)]
    scored = spark.createDataFrame([(e, f, s, True, "matched") for e, f, s in rows], "event_id long, fixture_id long, score double, matched boolean, reason string")
    got = matching.top_with_margin(scored, "event_id", "fixture_id").collect()
    assert sorted((r.event_id, r.fixture_id) for r in got) == [(2, 10), (3, 10)]
    assert matching.best_match(scored, "event_id", "fixture_id").count() == 3


def test_interval_join_is_inclusive_and_whole(spark):
    left = spark.createDataFrame([(k, START + timedelta(seconds=37 * k)) for k in range(200)], "a long, ta timestamp")
    right = spark.createDataFrame([(k, START + timedelta(seconds=53 * k)) for k in range(150)], "b long, tb timestamp")
    got = {(r.a, r.b) for r in matching.interval_join(left, right, "ta", "tb", 106).collect()}
    assert got == {(a, b) for a in range(200) for b in range(150) if abs(37 * a - 53 * b) <= 106}


@pytest.mark.parametrize("a,b,score", [("", "", 0.0), ("abc", "abc", 1.0), ("abc", "xyz", 0.0), ("martha", "marhta", 0.9611111111), ("dixon", "dicksonx", 0.8133333333), ("atlas", "tolima", 0.7)])
def test_jaro_winkler(a, b, score):
    assert similarity.jaro_winkler(a, b) == pytest.approx(score)


def test_names_that_differ_by_category_are_capped():
    score = similarity.team_scorer()
    assert score("Brazil U20", "Brazil") <= 0.61 and score("Brazil U20", "Brazil Sub 20") == 1.0
    assert score("Korea Republic", "South Korea") == 1.0 and score("North Korea", "South Korea") <= 0.61
    assert score("Congo DR", "Congo") <= 0.61 and score("Santos FC", "Santos") >= 0.98


def test_normalisation_and_tokens(spark):
    names = ["São Paulo F.C.", "A. B. C. Real", "Brasil Sub 20", "Club de Foot-ball", None, "x^y´z", "ÀÉÎÕÜ ç ñ"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(text.normalize_for_matching(F.col("n")).alias("m"), text.matching_tokens(F.col("n")).alias("t"), text.normalize_name(F.col("n")).alias("s")).collect()
    assert [r.m for r in got] == [similarity.normalized(n) for n in names]
    assert [r.t for r in got] == [similarity.tokens(n) for n in names]
    assert got[0].m == "sao paulo f c" and got[0].t == ["sao", "paulo"] and got[1].t == ["abc", "real"] and got[2].t == ["brasil", "u20"] and got[3].s == "foot ball"


def test_native_and_python_scores_agree(spark):
    names = ["Real Madrid", "Madrid Real", "realmadrid", "Real Madrid B", "Korea Republic", "Congo DR", "U20 Brasil", "Santos", "Women Lyon", "AC Milan II"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = df.select("a", "b", text.identity_score(text.profile(F.col("a")), text.profile(F.col("b"))).alias("s"), text.distinguishing_keys(text.profile_tokens(F.col("a"))).alias("k"), text.distinguishing_keys(text.profile_tokens(F.col("b"))).alias("l")).collect()
    for r in got:
        ta, tb = (list(dict.fromkeys(t for t in similarity.tokens(x) if len(t) > 1 or t in similarity.SAFE_SHORT_TOKENS)) for x in (r.a, r.b))
        assert r.s == similarity._identity(similarity.normalized(r.a), similarity.normalized(r.b), ta, tb)
        assert (r.k == r.l) == (similarity._keys(ta) == similarity._keys(tb))


def odds(spark, rows):
    return spark.createDataFrame(rows, "fixture_id long, bookmaker string, pa_category string, selection string, price double").withColumn("market_code", F.lit("1X2"))


def test_consensus_boundaries(spark):
    # Implied 0.5 for the others: 0.70 is 20 points away and stays, 0.71 goes.
    rows = [(1, b, "SEM_PA", "HOME", 2.0) for b in "abc"] + [(1, "d", "SEM_PA", "HOME", 1 / 0.71)]
    found = consensus.mismatches(odds(spark, rows)).collect()
    assert [(r.bookmaker, r.scope, r.reason) for r in found] == [("d", "EVENTO", "todos os mercados fora do consenso (max 21.0pp)")]
    assert consensus.mismatches(odds(spark, rows[:2] + rows[3:])).count() == 0  # three bookmakers are too few
    assert consensus.mismatches(odds(spark, rows[:3] + [(1, "d", "SEM_PA", "HOME", 1 / 0.6999)])).count() == 0


def test_consensus_scopes(spark):
    base = [(1, b, p, s, 3.0) for b in "abcd" for p in ("SEM_PA", "COM_PA") for s in ("HOME", "DRAW", "AWAY")]
    one = [(1, "e", "SEM_PA", "HOME", 1.2), (1, "e", "SEM_PA", "DRAW", 3.0), (1, "e", "SEM_PA", "AWAY", 3.0)]
    two = [(2 if r[0] == 1 else r[0], *r[1:]) for r in base] + [(2, "e", "SEM_PA", "HOME", 1.2), (2, "e", "SEM_PA", "DRAW", 1.2), (2, "e", "COM_PA", "HOME", 3.0)]
    got = {(r.fixture_id, r.bookmaker, r.scope, r.pa_category) for r in consensus.mismatches(odds(spark, [*base, *one, *two])).collect()}
    assert got == {(1, "e", "PARCIAL", "SEM_PA"), (2, "e", "PARCIAL", "SEM_PA")}
    left = consensus.surviving_prices(odds(spark, [*base, *one]), consensus.mismatches(odds(spark, [*base, *one])))
    assert left.filter("bookmaker = 'e'").count() == 0 and left.count() == len(base)


def test_block_state_machine(spark):
    found = spark.createDataFrame([(1, "a", "EVENTO", "", "r"), (2, "a", "EVENTO", "", "r"), (3, "a", "PARCIAL", "COM_PA", "r")], "fixture_id long, bookmaker string, scope string, pa_category string, reason string")
    blocks = spark.createDataFrame([(2, "a", "EVENTO", "", 3, ["7"]), (3, "a", "PARCIAL", "COM_PA", 0, None)], "fixture_id long, bookmaker string, scope string, pa_category string, attempts int, rejected_event_ids array<string>")
    links = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (2, "a", 8)], "fixture_id long, bookmaker string, external_event_id long")
    got = {r.fixture_id: (r.attempts, r.blocked, r.rejected_event_ids) for r in consensus.next_blocks(found, blocks, links).collect()}
    assert got == {1: (1, False, ["5"]), 2: (4, True, ["7", "8"]), 3: (0, True, [])}


@pytest.mark.parametrize("prices,valid", [((3.0, 3.0, 3.0), True), ((10 / 3, 10 / 3, 10 / 3), True), ((3.4, 3.4, 3.4), False), ((1 / 0.45, 1 / 0.45, 1 / 0.45), True), ((2.2, 2.2, 2.2), False)])
def test_probability_bounds(spark, prices, valid):
    rows = [(1, "a", "SEM_PA", s, p) for s, p in zip(("HOME", "DRAW", "AWAY"), prices)]
    total = sum(1 / p for p in prices)
    got = writepath.group_verdicts(odds(spark, rows)).first()
    assert got.complete and got.valid == (0.9 <= total <= 1.35)


def test_saved_prices_are_within_the_bounds_of_the_plain_sum(spark):
    """Three prices of 10 / 3 add up to less than 0.9 in any order, whatever they round to; 2, 5, 5 reach it smallest probability first."""
    groups = [(10 / 3,) * 3, *itertools.permutations((2.0, 5.0, 5.0))]
    rows = [(k, "a", "1X2", "SEM_PA", s, p, i) for k, prices in enumerate(groups) for i, (s, p) in enumerate(zip(("HOME", "DRAW", "AWAY"), prices))]
    assert {r.fixture_id for r in writepath.valid_prices(spark.createDataFrame(rows, PRICES)).collect()} == set(range(1, len(groups)))


def test_two_way_groups_and_unknown_selections(spark):
    rows = [(1, "a", "COM_PA", "HOME", 1.1), (1, "a", "COM_PA", "AWAY", 1.1), (2, "a", "SEM_PA", "HOME", 1.9), (2, "a", "SEM_PA", "AWAY", 1.9), (3, "a", "COM_PA", "HOME", 2.0), (3, "a", "COM_PA", "AWAY", 2.0), (3, "a", "COM_PA", "OVER", 2.0)]
    assert {r.fixture_id: r.valid for r in writepath.group_verdicts(odds(spark, rows)).collect()} == {1: True, 2: False, 3: False}


def test_best_price_takes_the_first_on_a_tie(spark):
    rows = spark.createDataFrame([(1, "a", "S", "HOME", 2.0, 5), (1, "a", "S", "HOME", 2.0, 3), (1, "a", "S", "HOME", 1.9, 1)], "fixture_id long, bookmaker string, pa_category string, selection string, price double, source_odd_id long").withColumn("market_code", F.lit("1X2"))
    assert writepath.best_price(rows).first().source_odd_id == 3


PRICES = "fixture_id long, bookmaker string, market_code string, pa_category string, selection string, price double, source_odd_id long"


def test_other_markets_neither_spoil_groups_nor_get_lost(spark):
    group = [(1, "a", "1X2", "SEM_PA", s, 3.0, k) for k, s in enumerate(("HOME", "DRAW", "AWAY"))]
    over = [(1, "a", "OU", "SEM_PA", "OVER", 1.9, 7), (1, "a", "OU", "SEM_PA", "OVER", 1.8, 8)]
    got = writepath.valid_prices(spark.createDataFrame([*group, *over], PRICES))
    assert sorted(tuple(r) for r in got.select(*[c.split()[0] for c in PRICES.split(", ")]).collect()) == sorted([*group, *over])
    assert writepath.group_verdicts(spark.createDataFrame([*group, *over], PRICES)).count() == 1


def test_merge_keeps_what_is_out_of_scope(spark):
    old = spark.createDataFrame([(1, "a", "1X2", "S", "HOME", 2.0, 1), (1, "a", "1X2", "S", "AWAY", 2.0, 2), (1, "a", "OU", "S", "OVER", 2.0, 3), (2, "a", "1X2", "S", "HOME", 2.0, 4), (1, "b", "1X2", "S", "HOME", 2.0, 5), (1, "a", "1X2", None, "HOME", 2.5, 6)], PRICES)
    old = old.withColumn("updated_at", F.lit("1999-01-01").cast("date")).withColumn("last_seen_at", F.col("updated_at"))
    new = spark.createDataFrame([(1, "a", "1X2", "S", "HOME", 2.00001, 1), (1, "a", "1X2", None, "HOME", 3.0, 6)], PRICES)
    keys = ["fixture_id", "bookmaker", "market_code", "pa_category", "selection"]
    got = {r.source_odd_id: (r.price, str(r.updated_at), str(r.last_seen_at)) for r in writepath.merged(old, new, keys, {"price": 4}, F.lit("2000-01-01").cast("date")).collect()}
    first, now = "1999-01-01", "2000-01-01"
    assert got == {1: (2.00001, first, now), 3: (2.0, first, first), 4: (2.0, first, first), 5: (2.0, first, first), 6: (3.0, now, now)}


def test_save_scope_blocks_conflicts_and_moved_links(spark):
    group = lambda f, price: [(f, "a", "1X2", "S", s, price, f * 10 + k) for k, s in enumerate(("HOME", "DRAW", "AWAY"))]
    stored = spark.createDataFrame([r for f in range(1, 7) for r in group(f, 2.9)] + [(4, "a", "OU", "S", "OVER", 1.5, 49)], PRICES)
    incoming = spark.createDataFrame([r for f in (1, 2, 3, 4) for r in group(f, 3.0)], PRICES)
    link = "fixture_id long, bookmaker string, external_event_id long"
    links = spark.createDataFrame([(1, "a", 100), (2, "a", 200), (3, "a", 300), (3, "a", 301), (4, "a", 500)], link)
    before = spark.createDataFrame([(1, "a", 100), (2, "a", 200), (3, "a", 300), (5, "a", 500), (6, "a", 600)], link)
    blocks = spark.createDataFrame([(1, "a", "EVENTO", "", True, []), (2, "a", "EVENTO", "", False, ["200"]), (9, "a", "PARCIAL", "S", False, None)], "fixture_id long, bookmaker string, scope string, pa_category string, blocked boolean, rejected_event_ids array<string>")
    got = writepath.save(stored, incoming, links, blocks, before)
    prices = {(r.fixture_id, r.market_code): r.price for r in got.prices.collect()}
    # 1: exhausted and 2: rejected, so both keep what is stored; 3: in conflict, loses it; 4: replaced, its other market stays; 5: its link moved away; 6: not in the batch.
    assert prices == {(1, "1X2"): 2.9, (2, "1X2"): 2.9, (4, "1X2"): 3.0, (4, "OU"): 1.5, (6, "1X2"): 2.9}
    assert {(r.fixture_id, r.external_event_id) for r in got.links.collect()} == {(1, 100), (2, 200), (4, 500), (6, 600)}
    parts = spark.createDataFrame([(1, "a", "PARCIAL", "S", False, None)], blocks.schema)
    assert writepath.apply_blocks(incoming, parts).filter("fixture_id = 1").count() == 0


def test_diff_compares_null_keys_and_rounds(spark):
    schema = "k long, s string, price double"
    old = spark.createDataFrame([(1, None, 2.00001), (2, "x", 3.0), (3, "y", 1.5)], schema)
    new = spark.createDataFrame([(1, None, 2.00002), (2, "x", 3.1), (4, "z", 1.1)], schema)
    got = {r.k: r.action for r in writepath.diff(old, new, ["k", "s"], {"price": 4}).collect()}
    assert got == {1: "touch", 2: "update", 3: "stale", 4: "insert"}
    assert 3 not in {r.k for r in writepath.diff(old, new, ["k", "s"], {"price": 4}, new.select("k")).collect()}


def test_lease(spark):
    now = datetime(2026, 1, 1)
    state = spark.createDataFrame([("a", "x", True, now + timedelta(hours=1)), ("b", "x", True, now - timedelta(hours=1)), ("c", "x", False, None)], "slug string, owner string, running boolean, lease_until timestamp")
    for slug, owner in (("a", "x"), ("b", "me"), ("c", "me")):
        assert writepath.lease(state, slug, "me", F.lit(now)).filter(F.col("slug") == slug).first().owner == owner


@pytest.mark.parametrize("shown,price", [("5/2", 3.5), ("2,50", 2.5), ("1/0", 0.0), ("x", 0.0), ("", 0.0), ("3", 3.0)])
def test_fractional_prices(spark, shown, price):
    assert one(spark, rules.decimal_price(F.lit(shown))) == price


def test_link_orientation(spark):
    rows = [('{"orientation": "NORMAL"}', "NORMAL"), ('{"orientation": "INVERTED"}', "INVERTED"), ('{"orientation": "UNKNOWN"}', None), (None, None)]
    assert [one(spark, rules.link_orientation(F.lit(r).cast("string"))) for r, _ in rows] == [w for _, w in rows]


def test_unique_aliases_and_learning(spark):
    aliases = spark.createDataFrame([("estudiantes la plata", 1), ("city", 2), ("city", 3)], "alias string, team_id long")
    assert [r.alias for r in matching.unique_aliases(aliases).collect()] == ["estudiantes la plata"]
    matched = spark.createDataFrame([("Estudiantes La Plata", 1, "Estudiantes L.P."), ("New Name", 1, "Estudiantes L.P."), ("Boca Juniors", 4, "Boca Juniors"), ("Both", 5, "b"), ("Both", 6, "c"), ("", 7, "d")], "name string, team_id long, canonical string")
    assert [r.alias for r in matching.learned_aliases(matched, aliases).collect()] == ["new name"]


def test_pair_alias_fallback(spark):
    known = spark.createDataFrame([("alpha", "first"), ("beta", "second")], "name_a string, name_b string").withColumn("same_team", F.lit(True))
    rows = pairs(spark, [("Alpha", "Beta", "First", "Second"), ("Alpha", "Beta", "Second", "First"), ("Alpha", "Gamma", "First", "Second")], "Cup")
    rows = rows.withColumn("event_id", F.monotonically_increasing_id()).withColumn("fixture_id", F.col("event_id"))
    assert sorted(r.orientation for r in matching.pair_alias_fallback(rows, known).collect()) == ["INVERTED", "NORMAL"]
    crowded = rows.withColumn("event_id", F.lit(1))
    assert matching.pair_alias_fallback(crowded, known, most=3).count() == 2 and matching.pair_alias_fallback(crowded, known, most=2).count() == 0
    late = rows.withColumn("b_starts_at", F.col("starts_at") + F.expr("INTERVAL 21 MINUTES"))
    assert matching.pair_alias_fallback(late, known).count() == 0 and matching.pair_alias_fallback(rows.withColumn("b_starts_at", F.lit(None).cast("timestamp")), known).count() == 2


def test_watchdog(spark):
    at = lambda m: START + timedelta(minutes=m)
    events = [("fast", "cycle-start", at(0)), ("fast", "heartbeat", at(26)), ("bet365", "cycle-start", at(0)), ("bet365", "heartbeat", at(26)), ("meridianbet", "cycle-start", at(0)), ("meridianbet", "cycle-end", at(20)), ("x", "cycle-start", at(1)), ("x", "heartbeat", at(26)), ("late", "heartbeat", at(30))]
    pauses = spark.createDataFrame([("x", at(27)), ("x", at(5))], "lane string, until timestamp")
    got = control.watchdog(spark.createDataFrame(events, "lane string, type string, at timestamp"), F.lit(at(26)), pauses).collect()
    assert {r.lane: r.state for r in got} == {"fast": "stuck", "bet365": "well", "meridianbet": "silent", "x": "paused"}


def test_lease_and_watermark_by_compare_and_set(spark, tmp_path):
    folder, now = f"file://{tmp_path}", datetime(2026, 8, 5, 12)
    with ThreadPoolExecutor(8) as pool:
        for n in range(20):  # once may go well by chance
            won = list(pool.map(lambda k: state.acquire(state.Versions(spark, folder, f"lease{n}"), f"w{k}", now), range(8)))
            assert sum(won) == 1
    lease = state.Versions(spark, folder, "lease19")
    owner = f"w{won.index(True)}"
    assert not state.acquire(lease, "other", now + timedelta(minutes=30)) and not state.release(lease, "other")
    assert state.release(lease, owner) and state.acquire(lease, "other", now) and state.acquire(lease, "third", now + timedelta(hours=1))

    marks, written = state.Versions(spark, folder, "sweep"), []
    prices = [(f, b, s, "SEM_PA", p, "1X2", datetime(2026, 8, 5, h)) for f, h in ((1, 9), (2, 11)) for b in range(5) for s, p in zip(("HOME", "DRAW", "AWAY"), (2.0, 3.4, 4.0) if b else (1.2, 3.4, 9.0))]
    rows = spark.createDataFrame(prices, "fixture_id long, bookmaker long, selection string, pa_category string, price double, market_code string, updated_at timestamp")
    upcoming = spark.createDataFrame([(1,), (2,)], "fixture_id long")
    write = lambda found: written.append(sorted({r.fixture_id for r in found.collect()}))

    def failing(found):
        raise RuntimeError("store is down")

    with pytest.raises(RuntimeError):
        state.swept(marks, lambda: rows, upcoming, failing, now)
    assert marks.latest() == (0, None)
    assert not state.swept(marks, lambda: rows, upcoming.limit(0), write, now) and marks.latest() == (0, None)
    assert state.swept(marks, lambda: rows, upcoming, write, datetime(2026, 8, 5, 10)) and written == [[1, 2]]
    # What came in during the first sweep, after it began, is judged by the next.
    assert state.swept(marks, lambda: rows, upcoming, write, now) and written[1] == [2]
    assert state.swept(marks, lambda: rows, upcoming, write, now) and written[2] == []


def test_last_and_first_win(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, ord long, v string")
    assert {r.k: r.v for r in dedupe.last_wins(rows, ["k"], "ord").collect()} == {1: "b", 2: "c"}
    assert {r.k: r.v for r in dedupe.first_wins(rows, ["k"], "ord").collect()} == {1: "a", 2: "c"}


def test_restart_budget(spark):
    rows = spark.createDataFrame([("l", START + timedelta(minutes=m)) for m in (0, 5, 10, 15, 20, 25, 31)], "lane string, at timestamp")
    got = [(r.in_window, r.allowed, r.cooldown_s) for r in control.restart_budget(rows, "lane", "at").orderBy("at").collect()]
    assert got[4:] == [(5, True, 25), (6, False, 30), (6, False, 30)]


def test_streaming_sweep_and_sessions(spark, tmp_path):
    from oddsweave.streaming import jobs

    lines = [control.PREFIX + json.dumps({"type": "heartbeat", "lane": "fast", "at": f"2026-01-01T00:{m:02d}:00.000Z", "cycle": m}) for m in (0, 1, 2, 30, 31)] + ["noise", control.PREFIX + "{}"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines))
    stream = jobs.lane_silences(jobs.worker_events(spark.readStream.schema("value string").text(str(tmp_path / "in"))), late="1 minute", gap="5 minutes")
    q = stream.writeStream.format("memory").queryName("silences").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.lane, r.n_events) for r in spark.table("silences").collect()][:1] == [("fast", 3)]

    current = odds(spark, [(1, b, "SEM_PA", "HOME", 2.0) for b in "abc"] + [(1, "d", "SEM_PA", "HOME", 1.2)])
    odds(spark, [(1, "d", "SEM_PA", "HOME", 1.2)]).write.json(str(tmp_path / "changes"))
    seen = []
    changes = spark.readStream.schema(current.schema).json(str(tmp_path / "changes"))
    run = jobs.sweep_batch(lambda: current, lambda: current.select("fixture_id"), lambda df, _: seen.extend(df.collect()))
    changes.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)
    assert [(r.fixture_id, r.bookmaker) for r in seen] == [(1, "d")]


def test_ineligible_fixtures_go_and_listings_are_cut(spark):
    from pyspark.sql import functions as F

    from oddsweave.operators import writepath

    rows = spark.createDataFrame([(1, 10, "Brazil", "Chile"), (2, 10, "Brazil U20", "Chile U20"), (3, 11, "Ajax U20", None), (4, None, "Spain U20", "Italy")], "fixture_id long, league_id long, home_team string, away_team string")
    leagues = spark.createDataFrame([(10, True), (11, False)], "league_id long, senior_only boolean")
    left = writepath.without_ineligible(rows, leagues, ["home_team", "away_team"])
    assert left.columns == rows.columns and sorted(r.fixture_id for r in left.collect()) == [1, 3, 4]
    assert writepath.without_ineligible(rows, leagues.limit(0), ["home_team"]).count() == 4
    events = spark.createDataFrame([("a", k) for k in range(4)] + [("b", 0)], "page string, nth int")
    cut = writepath.listed_up_to(events, spark.createDataFrame([("a", 1), ("a", 2)], "page string, fixture_id long"), ["page"], F.col("nth"))
    assert sorted(map(tuple, cut.collect())) == [("a", 0), ("a", 1)]


def test_cascade_stages(spark):
    """One event for each stage, one that nothing finds, and one whose fixture has another event."""
    at = lambda hours: START + timedelta(hours=hours)
    fixtures = spark.createDataFrame(
        [(1, at(0), "Alpha", "Beta", "L", 1), (2, at(0), "Gamma Town", "Delta City", "L", 1), (3, at(30), "Epsilon Rovers", "Zeta United", "L", 1), (4, at(30), "Northwich Athletic", "Southport Wanderers", "L", 2), (5, at(0), "Kappa", "Omikron", "L", 3), (6, at(0), "Sigma Vale", "Rho Park", "L", 4)],
        "fixture_id long, starts_at timestamp, home_team string, away_team string, league_name string, league_id long",
    )
    event = "event_id long, b_starts_at timestamp, b_home_team string, b_away_team string, b_league_name string, league_id long"
    events = spark.createDataFrame(
        [(11, at(5), "x", "y", "L", 1), (12, at(0), "Delta City", "Gamma Town", "L", 1), (13, at(0), "Epsilon Rovers", "Zeta United", "L", 1), (14, at(0), "Northwich Athletic", "Southport Wanderers", "L", None), (15, at(0.25), "Foo", "Bar", "L", 3), (16, at(0), "Sigma Vale", "Rho Park", "L", 4), (17, at(0), "nobody", "nowhere", "L", 9)],
        event,
    )
    remembered = spark.createDataFrame([(11, 1, "INVERTED")], "event_id long, fixture_id long, orientation string")
    confirmed = spark.createDataFrame([(14, 4), (14, 5)], "event_id long, fixture_id long")
    known = spark.createDataFrame([("foo", "omikron", True), ("kappa", "bar", True), ("kappa", "foo", False)], "name_a string, name_b string, same_team boolean")
    links = spark.createDataFrame([(6, 99), (2, 12)], "fixture_id long, event_id long")
    got = {r.event_id: (r.fixture_id, r.orientation, r.stage) for r in matching.cascade(fixtures, events, remembered, confirmed, known, links).collect()}
    assert got == {11: (1, "INVERTED", "remembered"), 12: (2, "INVERTED", "strict"), 13: (3, "NORMAL", "wide"), 14: (4, "NORMAL", "confirmed"), 15: (5, "INVERTED", "alias"), 16: (None, None, "pending"), 17: (None, None, "pending")}


def test_state_is_carried_over_buckets(spark):
    rows = [(k % 2, START + timedelta(hours=5 * k), k, float(k) if k % 7 == 0 else None) for k in range(60)]
    frame = spark.createDataFrame(rows, "lane long, ts timestamp, event_id long, value double")
    got = {r.event_id: r.last for r in targets.carried(frame, ["lane"], ["ts", "event_id"], last=F.col("value")).collect()}
    want, state = {}, {}
    for lane, _, k, value in rows:
        state[lane] = value if value is not None else state.get(lane)
        want[k] = state[lane]
    assert got == want


def test_node_summary_keeps_the_first_values(spark):
    rows = [("a", f"v{k:03d}") for k in range(60)] * 3 + [("b", None), (None, "x")]
    got = {r.kind: (r.n_nodes, r["values"]) for r in reports.node_summary(spark.createDataFrame(rows, "kind string, value string"), "kind", "value").collect()}
    assert got == {"a": (180, [f"v{k:03d}" for k in range(25)]), "b": (1, []), None: (1, ["x"])}


def test_tokens_of_long_texts_and_single_letters(spark):
    cases = {"F C B Sub 20 de S. Paulo A B": ["fcb", "u20", "s", "paulo", "ab"], "a b c d": ["abcd"], "x": ["x"], "ab c y ef": ["ab", "cy", "ef"], "": [], None: [], "1 a 2": ["1", "a", "2"]}
    frame = spark.createDataFrame(list(enumerate(cases)), "k int, t string")
    got = {r.k: r.v for r in frame.select("k", text.matching_tokens(F.col("t")).alias("v")).collect()}
    assert got == dict(enumerate(cases.values()))
    assert spark.createDataFrame([("a b word " * 200_000,)], "t string").select(F.size(text.matching_tokens(F.col("t")))).first()[0] == 400_000


def test_every_query_gives_the_rows_of_its_sql(spark):
    import glob
    from pathlib import Path

    import duckdb

    from oddsweave.plans.catalog import ORACLES, QUERIES

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    assert set(ORACLES) <= set(QUERIES)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v if v is None or isinstance(v, (bool, int, str)) else str(v)
    rows = lambda names, data: sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in data)
    for name, query in QUERIES.items():
        got = query(spark, sf)
        mine = rows(got.columns, [tuple(r) for r in got.collect()])
        if name in ORACLES:
            other = con.execute(ORACLES[name])
            columns = [c[0] for c in other.description]
            assert sorted(columns) == sorted(got.columns), name
            assert mine == rows(columns, other.fetchall()), name


@pytest.mark.parametrize("prices", [(2.0, 5.0, 5.0), (5.0, 2.0, 5.0), (5.0, 5.0, 2.0), (3.0, 6.0, 2.5), (2.5, 3.0, 6.0), (6.0, 2.5, 3.0)])
def test_a_sum_on_the_bound_is_valid_in_any_order(spark, prices):
    rows = [(1, 1, "1X2", "SEM_PA", s, p, k) for k, (s, p) in enumerate(zip(writepath.SIDES, prices))]
    got = writepath.group_verdicts(spark.createDataFrame(rows, "fixture_id long, bookmaker long, market_code string, pa_category string, selection string, price double, source_odd_id long")).first()
    assert got.complete and got.valid


def test_alias_tables_and_their_joins_are_not_broadcast(spark):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "d")], "group_id long, alias string")
    known = matching.alias_table(groups)
    named = matching.with_aliases(spark.createDataFrame([("C",), ("x",)], "name string"), known, ("name",))
    assert {r.name: r.name_aliases for r in named.collect()} == {"C": ["a", "b", "c"], "x": None}
    assert "Broadcast" not in named._jdf.queryExecution().sparkPlan().toString()


def test_names_are_compared_as_the_scalar_rule_says(spark):
    """Array scores equal the letter by letter ones, for long texts and other letters too."""
    texts = ["", "a", "ab", "ba", "abcabc", "no123", "no1234", "x" * 64, "x" * 65, "xy" * 40, "são", "a-b", "largering", "largerings"]
    left, right = (x.reshape(-1) for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    got = similarity.Texts(texts).jaro_winkler(left, right)
    assert got.tolist() == [similarity.jaro_winkler(texts[a], texts[b]) for a, b in zip(left, right)]


def test_a_pair_of_events_goes_to_python_once(spark):
    """Leagues and names are compared in one pass."""
    plan = matching.match(pairs(spark, [("Celtic", "Aberdeen", "Celtic", "Aberdeen")], "Cup"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_pairs_are_shuffled_once_as_ids(spark):
    """Behind the shuffle by number, pairs of ids are made distinct and joined where they are, and no full rows are dealt out by event."""
    fixtures = spark.createDataFrame([(1, START, "Celtic", "Aberdeen", "Cup")], "fixture_id long, starts_at timestamp, home_team string, away_team string, league_name string")
    events = spark.createDataFrame([(9, START, "Celtic", "Aberdeen", "Cup")], "event_id long, b_starts_at timestamp, b_home_team string, b_away_team string, b_league_name string")
    got = matching.best_canonical(fixtures, events)
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "REPARTITION_BY_NUM" in x]
    assert len(dealt) == 1 and "hashpartitioning(_at#" in dealt[0]
    assert [(r.event_id, r.fixture_id) for r in got.collect()] == [(9, 1)]


def test_an_event_of_a_crowded_window_finds_its_known_fixture(spark):
    """The cascade's last stage has no cap: of forty fixtures of the league the one by known names is found, straight before crossed."""
    schema = "fixture_id long, starts_at timestamp, home_team string, away_team string, league_name string, league_id long"
    fixtures = spark.createDataFrame([(k, START + timedelta(hours=k % 5), f"Home {k}", f"Away {k}", "Cup", 1) for k in range(40)], schema)
    events = spark.createDataFrame([(90, START + timedelta(hours=2), "Foo", "Bar", "Cup", 1), (91, START + timedelta(hours=3), "Bar", "Foo", "Cup", 1)], "event_id long, b_starts_at timestamp, b_home_team string, b_away_team string, b_league_name string, league_id long")
    known = spark.createDataFrame([("foo", "home 7", True), ("away 7", "bar", True), ("foo", "home 8", True), ("bar", "away 8", True), ("bar", "away 12", False)], "name_a string, name_b string, same_team boolean")
    remembered = spark.createDataFrame([], "event_id long, fixture_id long, orientation string")
    got = {r.event_id: (r.fixture_id, r.orientation, r.stage) for r in matching.cascade(fixtures, events, remembered, known=known).collect()}
    assert got == {90: (7, "NORMAL", "alias"), 91: (8, "INVERTED", "alias")}
    rows = matching.interval_join(events, fixtures, "b_starts_at", "starts_at", matching.TWO_DAYS, ("league_id",))
    keys = ["event_id", "fixture_id", "orientation", "score"]
    for most in (30, 40):
        paired = matching.pair_alias_fallback(rows, known, most=most).select(keys).collect()
        assert sorted(paired) == sorted(matching.pair_alias_matches(fixtures, events, known, matching.TWO_DAYS, ("league_id",), most=most).select(keys).collect())
        assert bool(paired) == (most == 40)
