"""How a batch's prices and links are shuffled."""

import re

from oddsweave.plans import catalog


def test_links_of_a_batch_need_no_whole_prices(spark):
    """Prices come to the scope as categories alone; no full outer join breaks the pairs' partitioning."""
    plan = catalog.QUERIES["u01_saved_links"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and not re.search(r"struct\([^()]*source_odd_id", plan)
