"""How the feed's rows are shuffled where no side is small."""

import re

from oddsweave.plans import catalog


def test_feed_shuffles_prices_by_fixture_alone(spark):
    """No exchange by fixture and bookmaker: prices, links and groups share one partitioning."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["v04_feed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"hashpartitioning\(fixture_id#\w+, bookmaker#\w+", plan)
    assert re.search(r"hashpartitioning\(fixture_id#\w+, \d+\)", plan)
