"""Where payloads are parsed, and how often."""

import json

import pytest

from oddsweave.plans import catalog, payloads
from oddsweave.sources import feeds


def _plan(spark, name: str) -> str:
    return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["a05_grouped_odds", "a07_live_runners", "a10_flat_odds", "a03_localised", "a20_decoded_results", "a18_exchange", "a19_side_labels", "s22_delta_market"])
def test_payloads_are_parsed_once_and_where_they_are_dealt_out(spark, name):
    """No condition is moved, with the parsing in it, into the task that reads the file."""
    plan = _plan(spark, name)
    dealt, read = plan.split("REPARTITION_BY_NUM")
    assert "from_json" not in read and "- Filter" not in read
    assert dealt.count("from_json(") == 1


def test_node_prices_are_worked_out_once(spark):
    """The number of a price is looked at in four places of one expression, not again in each condition."""
    dealt, read = _plan(spark, "s23_node_payload").split("REPARTITION_BY_NUM")
    assert "- Filter" not in read
    assert dealt.count("^[+-]?") == 4


def test_offers_take_the_type_of_a_part(spark):
    """A payload may need more of a part than most do."""
    assert catalog.QUERIES["a01_offer_ids"](spark, "/root/testdata/sf0.001").count() > 0


def test_payloads_are_filled_in_one_pass(spark, tmp_path):
    """No pass over the whole text for each token; a part without a name has no payload, signs in names stay as they are."""
    assert "replace(replace(" not in _plan(spark, "a10_flat_odds")
    spark.createDataFrame([(1, "a@Ab% c", 7), (2, None, 7), (3, "a b", None), (4, "%1$s @K", 3)], "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    rows = payloads.payloads(spark, str(tmp_path), [{"k": "#K", "h": "@H", "a": "@A", "p": "50%", "o": "#1", "m": "#M2"}]).collect()
    assert {r["key"]: r["value"] for r in rows} == {
        1: '{"k": 1, "h": "acenseb%", "a": "cense", "p": "50%", "o": 1.7, "m": 2700}',
        2: None,
        3: None,
        4: '{"k": 4, "h": "%1$s", "a": "@Kense", "p": "50%", "o": 1.3, "m": 2300}',
    }


def test_names_of_a_flat_market_are_worked_out_once(spark):
    """Two teams once an event, two names once a market, a name once an odd; no more in conditions."""
    assert _plan(spark, "a10_flat_odds").count("[^a-z0-9]+") == 5


def test_names_of_an_exchange_are_worked_out_once(spark):
    """Two teams once an event, a market's name in its condition and its category, a runner's name once."""
    assert _plan(spark, "a18_exchange").count("[^a-z0-9]+") == 5


def test_first_price_to_back_counts_and_without_one_the_first(spark):
    runner = lambda k, name, prices: {"id": str(k), "name": name, "status": "open", "prices": prices}
    runners = [
        runner(1, "Ünião", [{"odds": 9, "side": "lay"}, None, {"decimal-odds": 2, "odds": 8, "side": "back"}, {"odds": 7, "side": "back"}]),
        runner(2, "Empate", [{"odds": 3}, {"odds": 5, "side": "lay"}]),
        runner(3, "b", []),
        runner(4, "c", [{"odds": 4, "side": "back"}]),
        runner(5, "b", [{"odds": 6, "side": "back"}]),
    ]
    event = {"id": "7", "event-participants": [{"participant-name": "Uniao"}, {"participant-name": "B"}], "markets": [{"name": "Match Odds", "status": "open", "market-type": "one_x_two", "runners": runners}]}
    rows = feeds.prices(spark.createDataFrame([(json.dumps(event),)], "value string"), feeds.EXCHANGE).collect()
    assert {(r["source_odd_id"], r["selection"], r["price"]) for r in rows} == {(1, "HOME", 2.0), (2, "DRAW", 3.0), (5, "AWAY", 6.0)}
