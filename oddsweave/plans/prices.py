"""Queries over price facts: consensus, write path, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.operators import consensus, dedupe, targets, writepath
from oddsweave.plans.catalog import query
from oddsweave.sources.tables import AS_OF, table, with_views

ODDS = with_views("odds")
_IMPLIED = ODDS + """, implied AS (SELECT fixture_id, pa_category, selection, bookmaker, min(1 / price) AS p FROM odds WHERE market_code = '1X2' AND price > 1 GROUP BY ALL),
    gate AS (SELECT fixture_id FROM implied GROUP BY 1 HAVING count(DISTINCT bookmaker) >= 4),
    sized AS (SELECT *, count(*) OVER (PARTITION BY fixture_id, pa_category, selection) AS n FROM implied WHERE fixture_id IN (SELECT fixture_id FROM gate)),
    loo AS (SELECT a.fixture_id, a.bookmaker, a.pa_category, a.selection, a.p, median(b.p) AS med, abs(a.p - median(b.p)) * 100 AS dev
        FROM sized a JOIN sized b ON a.fixture_id = b.fixture_id AND a.pa_category = b.pa_category AND a.selection = b.selection AND a.bookmaker <> b.bookmaker
        WHERE a.n >= 4 GROUP BY 1, 2, 3, 4, 5)"""
_FOUND = _IMPLIED + """, by_pa AS (SELECT fixture_id, bookmaker, pa_category, count(*) AS ev, count(*) FILTER (dev > 20) AS d, max(dev) FILTER (dev > 20) AS worst FROM loo GROUP BY 1, 2, 3),
    src AS (SELECT fixture_id, bookmaker, count(*) AS n, count(*) FILTER (d > 0 AND d >= least(2, ev)) AS c, max(worst) AS worst FROM by_pa GROUP BY 1, 2),
    found AS (SELECT fixture_id, bookmaker, 'EVENTO' AS scope, '' AS pa_category, worst FROM src WHERE c > 0 AND c = n
        UNION ALL SELECT b.fixture_id, b.bookmaker, 'PARCIAL', b.pa_category, b.worst FROM by_pa b JOIN src s USING (fixture_id, bookmaker) WHERE b.d > 0 AND NOT (s.c > 0 AND s.c = s.n))"""


def _odds(spark, d):
    return table(spark, d, "odds")


def _blocks(spark, d):
    return table(spark, d, "blocks").withColumn("rejected_event_ids", F.array("rejected"))


@query(_FOUND + " SELECT fixture_id, bookmaker, scope, pa_category, round(worst, 6) AS worst_pp FROM found")
def c01_detect_mismatches(spark, d):
    return consensus.mismatches(_odds(spark, d)).withColumn("worst_pp", F.round("worst_pp", 6)).drop("reason")


@query(ODDS + " SELECT DISTINCT fixture_id FROM odds WHERE market_code = '1X2' AND updated_at > DATE '2001-06-01'")
def c02_changed_fixtures(spark, d):
    return consensus.changed_fixtures(_odds(spark, d), "2001-06-01")


@query(
    _FOUND.replace("WITH odds", with_views("blocks", "links").replace("WITH ", "WITH ", 1) + ", odds")
    + """, linked AS (SELECT fixture_id, bookmaker, list(DISTINCT CAST(external_event_id AS VARCHAR)) AS ids FROM links GROUP BY 1, 2)
    SELECT f.fixture_id, f.bookmaker, f.scope, f.pa_category,
        CAST(CASE WHEN f.scope = 'EVENTO' THEN least(coalesce(b.attempts, 0) + 1, 4) ELSE coalesce(b.attempts, 0) END AS INTEGER) AS attempts,
        CASE WHEN f.scope = 'EVENTO' THEN coalesce(b.attempts, 0) + 1 > 3 ELSE true END AS blocked,
        array_to_string(list_sort(list_distinct(CASE WHEN f.scope = 'EVENTO' THEN list_concat(CASE WHEN b.rejected IS NULL THEN [] ELSE [b.rejected] END, coalesce(l.ids, [])) ELSE CASE WHEN b.rejected IS NULL THEN [] ELSE [b.rejected] END END)), ',') AS rejected_ids
    FROM found f LEFT JOIN blocks b USING (fixture_id, bookmaker, scope, pa_category) LEFT JOIN linked l ON l.fixture_id = f.fixture_id AND l.bookmaker = f.bookmaker"""
)
def c03_next_blocks(spark, d):
    out = consensus.next_blocks(consensus.mismatches(_odds(spark, d)), _blocks(spark, d), table(spark, d, "links"))
    return out.withColumn("rejected_ids", F.array_join("rejected_event_ids", ",")).drop("rejected_event_ids", "reason")


@query(
    _FOUND
    + """ SELECT fixture_id, count(*) AS n_prices, round(sum(price), 6) AS total FROM odds o
    WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.fixture_id = o.fixture_id AND f.bookmaker = o.bookmaker AND (f.scope = 'EVENTO' OR (f.pa_category = o.pa_category AND o.market_code = '1X2'))) GROUP BY 1"""
)
def c03_surviving_prices(spark, d):
    odds = _odds(spark, d)
    return consensus.surviving_prices(odds, consensus.mismatches(odds)).groupBy("fixture_id").agg(F.count(F.lit(1)).alias("n_prices"), F.round(F.sum("price"), 6).alias("total"))


@query(
    _FOUND.replace("WITH odds", with_views("links") + ", odds")
    + " SELECT fixture_id, bookmaker, external_event_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.scope = 'EVENTO' AND f.fixture_id = l.fixture_id AND f.bookmaker = l.bookmaker)"
)
def c03_surviving_links(spark, d):
    return consensus.surviving_links(table(spark, d, "links"), consensus.mismatches(_odds(spark, d))).select("fixture_id", "bookmaker", "external_event_id")


@query(_FOUND + " SELECT count(*) AS mismatches, count(*) FILTER (scope = 'EVENTO') AS event_mismatches, count(*) FILTER (scope = 'PARCIAL') AS partial_mismatches, count(DISTINCT fixture_id) AS fixtures FROM found")
def c04_summary(spark, d):
    return consensus.summary(consensus.mismatches(_odds(spark, d)))


@query(with_views("blocks") + " SELECT fixture_id, bookmaker, scope, attempts FROM blocks WHERE blocked")
def c05_fetch_blocks(spark, d):
    return targets.fetch_blocks(table(spark, d, "blocks"))


@query(ODDS + " SELECT fixture_id, bookmaker, market_code, pa_category, selection, max(price) AS price, arg_min(source_odd_id, (-price, source_odd_id)) AS source_odd_id FROM odds GROUP BY 1, 2, 3, 4, 5")
def g01_best_price(spark, d):
    return writepath.best_price(_odds(spark, d)).select("fixture_id", "bookmaker", "market_code", "pa_category", "selection", "price", "source_odd_id")


#: Groups of the result market by the rule of the write path: only 1X2 rows form groups.
_GROUPS = """best AS (SELECT fixture_id, bookmaker, pa_category, selection, max(price) AS price FROM {rows} WHERE market_code = '1X2' GROUP BY ALL),
    g AS (SELECT fixture_id, bookmaker, pa_category, bool_or(selection = 'HOME') AS h, bool_or(selection = 'DRAW') AS x, bool_or(selection = 'AWAY') AS a,
        bool_or(selection NOT IN ('HOME', 'DRAW', 'AWAY')) AS odd, sum(1 / price) FILTER (selection IN ('HOME', 'DRAW', 'AWAY')) AS p FROM best GROUP BY 1, 2, 3),
    v AS (SELECT *, h AND x AND a AND NOT odd AS complete, pa_category = 'COM_PA' AND h AND a AND NOT x AND NOT odd AS two_way FROM g),
    ok AS (SELECT *, (complete AND p BETWEEN 0.9 AND 1.35) OR two_way AS valid FROM v)"""


@query(ODDS + ", " + _GROUPS.format(rows="odds") + " SELECT fixture_id, bookmaker, '1X2' AS market_code, pa_category, complete, two_way, round(p, 6) AS probability, valid FROM ok")
def g02_moneyline_validation(spark, d):
    return writepath.group_verdicts(_odds(spark, d)).withColumn("probability", F.round("probability", 6))


@query(_IMPLIED + " SELECT fixture_id, pa_category, selection, bookmaker, round(p, 9) AS implied FROM implied")
def g03_implied_probability(spark, d):
    return consensus.implied(_odds(spark, d)).withColumn("implied", F.round("implied", 9))


@query(_IMPLIED + " SELECT fixture_id, bookmaker, pa_category, selection, round(p, 9) AS implied, round(med, 9) AS others_median, round(dev, 6) AS deviation_pp FROM loo")
def g04_leave_one_out_median(spark, d):
    out = consensus.leave_one_out(consensus.implied(_odds(spark, d)))
    return out.withColumns({"implied": F.round("implied", 9), "others_median": F.round("others_median", 9), "deviation_pp": F.round("deviation_pp", 6)})


@query(_IMPLIED + " SELECT fixture_id, count(DISTINCT bookmaker) AS n_bookmakers FROM implied GROUP BY 1 HAVING count(DISTINCT bookmaker) >= 4")
def g06_fixture_gate(spark, d):
    return consensus.enough_bookmakers(consensus.implied(_odds(spark, d)))


@query(with_views("links") + " SELECT bookmaker, fixture_id, count(DISTINCT external_event_id) AS n_events FROM links GROUP BY 1, 2 HAVING count(DISTINCT external_event_id) > 1")
def g07_conflicts(spark, d):
    return writepath.conflicts(table(spark, d, "links"))


@query(
    with_views("odds", "blocks")
    + """ SELECT bookmaker, pa_category, count(*) AS n_prices, round(sum(price), 6) AS total FROM odds o
    WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.fixture_id = o.fixture_id AND b.bookmaker = o.bookmaker AND ((b.scope = 'EVENTO' AND b.blocked) OR (b.scope = 'PARCIAL' AND b.pa_category = o.pa_category))) GROUP BY 1, 2"""
)
def f08_apply_blocks(spark, d):
    return writepath.apply_blocks(_odds(spark, d), _blocks(spark, d)).groupBy("bookmaker", "pa_category").agg(F.count(F.lit(1)).alias("n_prices"), F.round(F.sum("price"), 6).alias("total"))


_KEYS = ["fixture_id", "bookmaker", "pa_category", "selection"]
_HALVES = ODDS + """, old AS (SELECT fixture_id, bookmaker, pa_category, selection, max(price) AS price FROM odds WHERE source_odd_id % 3 <> 0 GROUP BY ALL),
    new AS (SELECT fixture_id, bookmaker, pa_category, selection, max(price) AS price FROM odds WHERE source_odd_id % 3 <> 1 GROUP BY ALL)"""


def _halves(spark, d):
    best = lambda rest: _odds(spark, d).filter(f"source_odd_id % 3 <> {rest}").groupBy(*_KEYS).agg(F.max("price").alias("price"))
    return best(0), best(1)


@query(
    _HALVES
    + """ SELECT fixture_id, bookmaker, pa_category, selection, o.price AS old_price, n.price AS new_price,
    CASE WHEN o.price IS NULL THEN 'insert' WHEN n.price IS NULL THEN 'stale' WHEN round(o.price, 4) = round(n.price, 4) THEN 'touch' ELSE 'update' END AS action
    FROM old o FULL JOIN new n USING (fixture_id, bookmaker, pa_category, selection)"""
)
def j08_diff_actions(spark, d):
    return writepath.diff(*_halves(spark, d), _KEYS, {"price": 4})


_MERGE = ODDS + f""", old AS (SELECT fixture_id, bookmaker, market_code, pa_category, selection, max(price) AS price FROM odds WHERE source_odd_id % 3 <> 0 GROUP BY ALL),
    new AS (SELECT fixture_id, bookmaker, market_code, pa_category, selection, max(price) AS price FROM odds WHERE source_odd_id % 3 <> 1 AND fixture_id % 2 = 0 GROUP BY ALL)"""


@query(
    _MERGE
    + f""" SELECT fixture_id, bookmaker, market_code, pa_category, selection, n.price, CASE WHEN round(o.price, 4) = round(n.price, 4) THEN '1999-01-01' ELSE '{AS_OF}' END AS updated_at, '{AS_OF}' AS last_seen_at
        FROM new n LEFT JOIN old o USING (fixture_id, bookmaker, market_code, pa_category, selection)
    UNION ALL SELECT fixture_id, bookmaker, market_code, pa_category, selection, price, '1999-01-01', '1999-01-01' FROM old o
        WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.fixture_id = o.fixture_id AND n.bookmaker = o.bookmaker AND n.market_code = o.market_code AND n.pa_category = o.pa_category AND n.selection = o.selection)
        AND (market_code <> '1X2' OR NOT EXISTS (SELECT 1 FROM new n WHERE n.fixture_id = o.fixture_id AND n.bookmaker = o.bookmaker))"""
)
def u02_merge(spark, d):
    """A batch of half the fixtures merged into all stored prices: other fixtures and other markets stay."""
    keys = ["fixture_id", "bookmaker", "market_code", "pa_category", "selection"]
    best = lambda rows: rows.groupBy(*keys).agg(F.max("price").alias("price"))
    first = F.lit("1999-01-01").cast("date")
    old = best(_odds(spark, d).filter("source_odd_id % 3 <> 0")).withColumn("updated_at", first).withColumn("last_seen_at", first)
    out = writepath.merged(old, best(_odds(spark, d).filter("source_odd_id % 3 <> 1 AND fixture_id % 2 = 0")), keys, {"price": 4}, F.lit(AS_OF).cast("date"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("updated_at", "last_seen_at")})


#: A batch (even price ids, links to two thirds of the events under other fixtures for some) over what is stored.
_BATCH = with_views("odds", "links", "blocks") + """, inc AS (SELECT * FROM odds WHERE source_odd_id % 2 = 0), cur AS (SELECT * FROM odds WHERE source_odd_id % 2 = 1),
    was AS (SELECT DISTINCT fixture_id, bookmaker, external_event_id FROM links),
    batch AS (SELECT DISTINCT CASE WHEN external_event_id % 5 = 0 THEN fixture_id + 1 ELSE fixture_id END AS fixture_id, bookmaker, external_event_id FROM links WHERE external_event_id % 3 <> 0),
    judged AS (SELECT l.*, EXISTS (SELECT 1 FROM blocks b WHERE b.scope = 'EVENTO' AND b.fixture_id = l.fixture_id AND b.bookmaker = l.bookmaker AND (b.blocked OR b.rejected = CAST(l.external_event_id AS VARCHAR))) AS gone FROM batch l),
    open AS (SELECT * FROM judged WHERE NOT gone),
    several AS (SELECT fixture_id, bookmaker FROM open GROUP BY 1, 2 HAVING count(DISTINCT external_event_id) > 1),
    clean_links AS (SELECT fixture_id, bookmaker, external_event_id FROM open o WHERE NOT EXISTS (SELECT 1 FROM several s WHERE s.fixture_id = o.fixture_id AND s.bookmaker = o.bookmaker)),
    clean AS (SELECT * FROM inc i WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.fixture_id = i.fixture_id AND b.bookmaker = i.bookmaker AND ((b.scope = 'EVENTO' AND b.blocked) OR (b.scope = 'PARCIAL' AND b.pa_category = i.pa_category)))
        AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.gone AND j.fixture_id = i.fixture_id AND j.bookmaker = i.bookmaker)
        AND NOT EXISTS (SELECT 1 FROM several s WHERE s.fixture_id = i.fixture_id AND s.bookmaker = i.bookmaker)),
    moved AS (SELECT w.fixture_id, w.bookmaker FROM was w JOIN clean_links c ON c.bookmaker = w.bookmaker AND c.external_event_id = w.external_event_id AND c.fixture_id <> w.fixture_id),
    area AS (SELECT fixture_id, bookmaker FROM open UNION SELECT fixture_id, bookmaker FROM clean UNION SELECT fixture_id, bookmaker FROM moved), """ + _GROUPS.format(rows="clean")


@query(
    _BATCH
    + """, nxt AS (SELECT fixture_id, bookmaker, market_code, price FROM cur c WHERE market_code <> '1X2' OR NOT EXISTS (SELECT 1 FROM area i WHERE i.fixture_id = c.fixture_id AND i.bookmaker = c.bookmaker)
        UNION ALL SELECT fixture_id, bookmaker, '1X2', price FROM best JOIN ok USING (fixture_id, bookmaker, pa_category) WHERE valid
        UNION ALL SELECT fixture_id, bookmaker, market_code, price FROM clean WHERE market_code <> '1X2')
    SELECT fixture_id, bookmaker, market_code, count(*) AS n_prices, round(sum(price), 6) AS total FROM nxt GROUP BY 1, 2, 3"""
)
def u01_save_all(spark, d):
    return _saved(spark, d).prices.groupBy("fixture_id", "bookmaker", "market_code").agg(F.count(F.lit(1)).alias("n_prices"), F.round(F.sum("price"), 6).alias("total"))


@query(
    _BATCH
    + """ SELECT fixture_id, bookmaker, external_event_id FROM was w WHERE NOT EXISTS (SELECT 1 FROM area a WHERE a.fixture_id = w.fixture_id AND a.bookmaker = w.bookmaker)
        AND NOT EXISTS (SELECT 1 FROM clean_links c WHERE c.bookmaker = w.bookmaker AND c.external_event_id = w.external_event_id) UNION ALL SELECT * FROM clean_links"""
)
def u01_saved_links(spark, d):
    """Links after the same batch: moved ones under their new fixture, others of its fixtures gone."""
    return _saved(spark, d).links


def _saved(spark, d):
    odds, links = _odds(spark, d), table(spark, d, "links").select("fixture_id", "bookmaker", "external_event_id").distinct()
    moved = F.when(F.col("external_event_id") % 5 == 0, F.col("fixture_id") + 1).otherwise(F.col("fixture_id"))
    batch = links.filter("external_event_id % 3 <> 0").withColumn("fixture_id", moved)
    return writepath.save(odds.filter("source_odd_id % 2 = 1"), odds.filter("source_odd_id % 2 = 0"), batch, _blocks(spark, d), links)


@query(ODDS + " SELECT bookmaker, count(*) AS kept FROM odds WHERE CAST(last_seen_at AS TIMESTAMP) >= TIMESTAMP '2000-02-01' - INTERVAL 2 HOUR GROUP BY 1")
def u04_ttl(spark, d):
    return writepath.within_ttl(_odds(spark, d), F.to_timestamp(F.lit(AS_OF))).groupBy("bookmaker").agg(F.count(F.lit(1)).alias("kept"))


@query(with_views("odds", "fixtures") + " SELECT bookmaker, count(*) AS kept FROM odds WHERE last_seen_at >= DATE '2000-02-01' OR fixture_id NOT IN (SELECT fixture_id FROM fixtures WHERE status = 'Brand#1') GROUP BY 1")
def u05_unseen_before(spark, d):
    reliable = table(spark, d, "fixtures").filter("status = 'Brand#1'")
    return writepath.unseen_before(_odds(spark, d), reliable, F.lit(AS_OF).cast("date")).groupBy("bookmaker").agg(F.count(F.lit(1)).alias("kept"))


@query(with_views("odds", "fixtures") + " SELECT fixture_id, count(*) AS kept FROM odds WHERE fixture_id IN (SELECT fixture_id FROM fixtures WHERE CAST(starts_at AS TIMESTAMP) > TIMESTAMP '2000-02-01' - INTERVAL 3 HOUR) GROUP BY 1")
def u06_cascade(spark, d):
    left = writepath.without_started(table(spark, d, "fixtures"), F.to_timestamp(F.lit(AS_OF)))
    return writepath.cascade(_odds(spark, d), left).groupBy("fixture_id").agg(F.count(F.lit(1)).alias("kept"))


@query(with_views("fixtures") + " SELECT fixture_id, status FROM fixtures WHERE fixture_id % 4 <> 0 UNION ALL SELECT fixture_id, status FROM fixtures WHERE fixture_id % 4 = 0 AND league_id < 25 AND status NOT IN ('Brand#1', 'Brand#2') UNION ALL SELECT fixture_id, status FROM fixtures WHERE fixture_id % 4 = 0 AND league_id >= 25")
def u08_synced_fixtures(spark, d):
    fixtures = table(spark, d, "fixtures")
    leagues = table(spark, d, "leagues").filter("league_id < 25")
    return writepath.synced_fixtures(fixtures.filter("fixture_id % 4 = 0"), fixtures, leagues, ("Brand#1", "Brand#2")).select("fixture_id", "status")


@query(with_views("leagues") + " SELECT league_id, enabled AND league_id < 25 AS enabled, CASE WHEN enabled AND league_id >= 25 THEN '2000-02-01' END AS deleted_at FROM leagues")
def u09_soft_delete(spark, d):
    leagues = table(spark, d, "leagues")
    out = writepath.soft_deleted(leagues.withColumn("deleted_at", F.lit(None).cast("date")), leagues.filter("league_id < 25"), F.lit(AS_OF).cast("date"))
    return out.select("league_id", "enabled", F.col("deleted_at").cast("string").alias("deleted_at"))


@query(ODDS + " SELECT fixture_id, CAST(max(least(updated_at, DATE '2000-02-01')) AS VARCHAR) AS updated_at, CAST(max(last_seen_at) AS VARCHAR) AS last_seen_at FROM odds GROUP BY 1")
def u13_clamped(spark, d):
    out = writepath.clamped(_odds(spark, d), F.lit(AS_OF).cast("date"))
    return out.groupBy("fixture_id").agg(F.max("updated_at").cast("string").alias("updated_at"), F.max("last_seen_at").cast("string").alias("last_seen_at"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def d01_dedupe_last(spark, d):
    return dedupe.last_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def d02_dedupe_first(spark, d):
    return dedupe.first_wins(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY 1")
def d03_feeds_united(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    feed = lambda kind: events.filter(F.col("event_type") == kind).drop("event_type")
    return dedupe.feeds_united(feed("click"), feed("view"), feed("error"), keys=["user_id"], order="event_id")


@query(_HALVES + " SELECT fixture_id, bookmaker, pa_category, selection FROM old ANTI JOIN new USING (fixture_id, bookmaker, pa_category, selection)")
def d04_stale(spark, d):
    return dedupe.stale(*_halves(spark, d), _KEYS).select(*_KEYS)


@query(with_views("odds", "fixtures") + " SELECT fixture_id FROM fixtures WHERE starts_at > DATE '2000-02-01' AND fixture_id IN (SELECT fixture_id FROM odds WHERE updated_at > DATE '2001-06-01')")
def d05_changed_upcoming(spark, d):
    late = table(spark, d, "fixtures").filter(F.col("starts_at") > F.lit(AS_OF).cast("date"))
    return dedupe.changed(late, _odds(spark, d).filter("updated_at > DATE '2001-06-01'"), ["fixture_id"]).select("fixture_id")


@query(
    with_views("links", "blocks")
    + """, l AS (SELECT fixture_id, bookmaker, list(DISTINCT CAST(external_event_id AS VARCHAR)) AS ids FROM links GROUP BY 1, 2)
    SELECT fixture_id, bookmaker, array_to_string(list_sort(list_distinct(list_concat([rejected], coalesce(ids, [])))), ',') AS ids FROM blocks LEFT JOIN l USING (fixture_id, bookmaker)"""
)
def d06_array_union(spark, d):
    links = table(spark, d, "links").groupBy("fixture_id", "bookmaker").agg(F.collect_set(F.col("external_event_id").cast("string")).alias("linked"))
    out = dedupe.united_ids(_blocks(spark, d).join(links, ["fixture_id", "bookmaker"], "left"), "rejected_event_ids", "linked")
    return out.select("fixture_id", "bookmaker", F.array_join("ids", ",").alias("ids"))


@query(
    with_views("links")
    + """, k AS (SELECT *, coalesce(regexp_extract(source_url, '/(\\d+)(?:[/?#]|$)', 1) = CAST(external_event_id AS VARCHAR), false) AS own FROM links WHERE source_url IS NOT NULL),
    w AS (SELECT *, count(*) OVER p AS n, bool_or(own) OVER p AS any_own FROM k WINDOW p AS (PARTITION BY fixture_id, source_url))
    SELECT fixture_id, external_event_id, source_url FROM w WHERE n < 2 OR NOT any_own OR own"""
)
def w10_own_link_only(spark, d):
    return dedupe.own_link_only(table(spark, d, "links").filter("source_url IS NOT NULL")).select("fixture_id", "external_event_id", "source_url")


_PRIORITY = ODDS + """, g AS (SELECT fixture_id, pa_category, source_odd_id % 4 AS pr, count(DISTINCT selection) AS n, max(price) AS top FROM odds GROUP BY 1, 2, 3),
    r AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, pa_category ORDER BY pr DESC) AS k FROM g WHERE n = 3)"""


@query(_PRIORITY + " SELECT fixture_id, pa_category, pr AS priority, top FROM r WHERE k = 1")
def g14_best_priority(spark, d):
    """Of complete groups the one of the best priority per category."""
    return targets.best_priority(_odds(spark, d).withColumn("priority", F.col("source_odd_id") % 4))


@query(ODDS + " SELECT source_odd_id, arg_min(fixture_id, (bookmaker, selection, price, fixture_id)) AS fixture_id, count(*) AS n_prices, array_to_string(list_sort(list(DISTINCT selection)), ',') AS selections FROM odds GROUP BY 1")
def g13_group_odds(spark, d):
    """Flat prices to events: the first row gives the attributes."""
    return targets.group_prices(_odds(spark, d)).withColumn("selections", F.array_join("selections", ","))