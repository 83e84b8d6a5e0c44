"""Queries of the serving views, reports and their joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddsweave.operators import matching, reports, serving, targets, writepath
from oddsweave.plans.catalog import query
from oddsweave.sources.tables import AS_OF, table, with_views

NOW = f"DATE '{AS_OF}'"
_UP = """up AS (SELECT f.*, greatest(f.updated_at, l.updated_at) AS version FROM fixtures f JOIN leagues l USING (league_id) WHERE f.starts_at > DATE '2000-02-01' AND l.enabled),
    game AS (SELECT * FROM up WHERE EXISTS (SELECT 1 FROM odds o WHERE o.fixture_id = up.fixture_id AND o.market_code = '1X2'))"""
GAMES = with_views("odds", "fixtures", "leagues") + ", " + _UP


def _now():
    return F.lit(AS_OF).cast("date")


def _views(spark, d, *names):
    return [table(spark, d, n) for n in names]


@query(GAMES + ", o AS (SELECT greatest(updated_at, last_seen_at) AS v FROM odds WHERE fixture_id IN (SELECT fixture_id FROM game)) SELECT CAST((SELECT max(version) FROM game) AS VARCHAR) AS fixtures_version, CAST((SELECT max(v) FROM o) AS VARCHAR) AS odds_version, CAST((SELECT max(v) FROM o) AS VARCHAR) AS latest_odd_updated_at, CAST((SELECT max(v) FROM o) AS VARCHAR) AS latest_odd_seen_at, (SELECT count(*) FROM game) AS upcoming_fixture_count, (SELECT count(*) FROM o) AS odd_count")
def v01_status(spark, d):
    out = serving.status(*_views(spark, d, "fixtures", "leagues", "odds"), _now())
    return out.withColumns({c: F.col(c).cast("string") for c in out.columns if not c.endswith("count")})


@query(GAMES + " SELECT fixture_id, home_team, away_team, league_id, CAST(starts_at AS VARCHAR) AS starts_at, status, CAST(version AS VARCHAR) AS fixture_updated_at FROM game")
def v02_fixtures(spark, d):
    fixtures, leagues, odds = _views(spark, d, "fixtures", "leagues", "odds")
    out = serving.with_prices(serving.upcoming(fixtures, leagues, _now()), odds)
    return out.select("fixture_id", "home_team", "away_team", "league_id", F.col("starts_at").cast("string").alias("starts_at"), "status", F.col("fixture_updated_at").cast("string").alias("fixture_updated_at"))


_SNAP = with_views("odds", "fixtures", "leagues", "links", "bookmakers") + ", " + _UP + """,
    link AS (SELECT fixture_id, bookmaker, CASE WHEN regexp_matches(source_url, '(?i)/api/') THEN NULL ELSE source_url END AS url FROM
        (SELECT *, row_number() OVER (PARTITION BY fixture_id, bookmaker ORDER BY updated_at DESC, external_event_id) AS k FROM links WHERE source_url IS NOT NULL) WHERE k = 1),
    snap AS (SELECT o.fixture_id, CAST(max(o.updated_at) AS VARCHAR) AS latest_odd_updated_at, CAST(max(o.last_seen_at) AS VARCHAR) AS latest_odd_seen_at, count(*) AS n_prices,
        string_agg(concat_ws('|', b.name, coalesce(k.url, b.home_url), o.market_code, o.pa_category, o.selection, CAST(round(o.price * 10) AS BIGINT)), ';' ORDER BY o.bookmaker, o.market_code, o.pa_category, o.selection, o.source_odd_id, o.price) AS prices
        FROM odds o JOIN up USING (fixture_id) JOIN bookmakers b ON b.bookmaker = o.bookmaker LEFT JOIN link k ON k.fixture_id = o.fixture_id AND k.bookmaker = o.bookmaker GROUP BY 1)"""
_ITEM = "array<struct<bookmaker_name string, bookmaker_event_url string, market_code string, pa_category string, selection string, price double>>"


def _digest(df):
    items = F.from_json("prices", _ITEM)
    line = lambda r: F.concat_ws("|", r["bookmaker_name"], r["bookmaker_event_url"], r["market_code"], r["pa_category"], r["selection"], F.round(r["price"] * 10).cast("bigint").cast("string"))
    return df.withColumn("n_prices", F.size(items).cast("bigint")).withColumn("prices", F.array_join(F.transform(items, line), ";"))


@query(_SNAP + " SELECT * FROM snap")
def v03_snapshot(spark, d):
    fixtures, leagues, odds, bookmakers, links = _views(spark, d, "fixtures", "leagues", "odds", "bookmakers", "links")
    out = _digest(serving.snapshot(fixtures, leagues, odds, bookmakers, links, _now()))
    return out.withColumns({c: F.col(c).cast("string") for c in ("latest_odd_updated_at", "latest_odd_seen_at")})


@query(_SNAP + " SELECT fixture_id, g.home_team, g.away_team, g.league_id, s.n_prices, s.prices FROM game g JOIN snap s USING (fixture_id)")
def v04_feed(spark, d):
    fixtures, leagues, odds, bookmakers, links = _views(spark, d, "fixtures", "leagues", "odds", "bookmakers", "links")
    return _digest(serving.feed(fixtures, leagues, odds, bookmakers, links, _now())).select("fixture_id", "home_team", "away_team", "league_id", "n_prices", "prices")


@query("SELECT p_partkey AS fixture_id, string_split(p_name, ' ')[1] AS token FROM part WHERE list_contains(string_split(p_name, ' '), 'ring') ")
def v05_token_search(spark, d):
    return targets.having_tokens(table(spark, d, "part"), "p_name", "ring").select(F.col("p_partkey").alias("fixture_id"), F.split("p_name", " ")[0].alias("token"))


@query(GAMES + " SELECT fixture_id, bookmaker, selection, pa_category, price FROM odds WHERE fixture_id IN (SELECT fixture_id FROM up)")
def f10_public_prices(spark, d):
    fixtures, leagues, odds = _views(spark, d, "fixtures", "leagues", "odds")
    return serving.public(odds, serving.upcoming(fixtures, leagues, _now()), ["fixture_id", "bookmaker", "selection", "pa_category", "price"])


@query(with_views("fixtures", "leagues") + " SELECT f.fixture_id, f.league_id, l.enabled FROM fixtures f LEFT JOIN leagues l USING (league_id)")
def j01_fixture_league(spark, d):
    return targets.with_league(*_views(spark, d, "fixtures", "leagues")).select("fixture_id", "league_id", "enabled")


@query(with_views("odds", "fixtures", "leagues", "bookmakers") + " SELECT b.name, l.league_id, count(*) AS n_prices, round(sum(o.price), 4) AS total FROM odds o JOIN fixtures f USING (fixture_id) JOIN leagues l ON l.league_id = f.league_id JOIN bookmakers b ON b.bookmaker = o.bookmaker WHERE l.enabled GROUP BY 1, 2")
def j02_multiway(spark, d):
    rows = targets.enabled_prices(*_views(spark, d, "odds", "fixtures", "leagues", "bookmakers"))
    return rows.groupBy("name", "league_id").agg(F.count(F.lit(1)).alias("n_prices"), F.round(F.sum("price"), 4).alias("total"))


@query(with_views("odds", "fixtures") + " SELECT fixture_id FROM fixtures f WHERE EXISTS (SELECT 1 FROM odds o WHERE o.fixture_id = f.fixture_id AND o.market_code = '1X2')")
def j03_semi_exists(spark, d):
    fixtures, odds = _views(spark, d, "fixtures", "odds")
    return serving.with_prices(fixtures, odds).select("fixture_id")


@query(_SNAP + " SELECT fixture_id, bookmaker, url AS source_url FROM link")
def j04_latest_link(spark, d):
    return serving.latest_links(table(spark, d, "links"))


_STREAM = with_views("stream")


@query(_STREAM + " SELECT a.event_id AS left_id, b.event_id AS right_id FROM stream a JOIN stream b ON a.lane = b.lane AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 1200000000")
def j05_interval_join(spark, d):
    stream = table(spark, d, "stream").select("event_id", "ts", "lane")
    right = stream.select(F.col("event_id").alias("right_id"), F.col("ts").alias("right_ts"), "lane")
    out = matching.interval_join(stream, right, "ts", "right_ts", 1200, ("lane",))
    return out.filter("event_id < right_id").select(F.col("event_id").alias("left_id"), "right_id")


@query(_STREAM + " SELECT event_id FROM stream a WHERE event_type = 'click' AND EXISTS (SELECT 1 FROM stream b WHERE b.event_type = 'error' AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000)")
def f04_near_window(spark, d):
    stream = table(spark, d, "stream")
    errors = stream.filter("event_type = 'error'").select(F.col("ts").alias("error_ts"))
    return matching.interval_join(stream.filter("event_type = 'click'"), errors, "ts", "error_ts", 600, how="left_semi").select("event_id")


@query(with_views("links") + ", r AS (SELECT fixture_id, min(external_event_id) AS remembered, min(source_url) AS url FROM links WHERE external_event_id % 2 = 0 GROUP BY 1), by_url AS (SELECT url, min(remembered) AS remembered FROM r WHERE url IS NOT NULL GROUP BY 1) SELECT l.external_event_id, coalesce(a.remembered, b.remembered, -1) AS remembered FROM links l LEFT JOIN (SELECT remembered AS id, remembered FROM r) a ON a.id = l.external_event_id LEFT JOIN by_url b ON b.url = l.source_url")
def j10_remembered_link(spark, d):
    """The remembered link by event id, or else by address."""
    links = table(spark, d, "links")
    known = links.filter("external_event_id % 2 = 0").groupBy("fixture_id").agg(F.min("external_event_id").alias("id"), F.min("source_url").alias("url"))
    return targets.remembered_links(links, known).select("external_event_id", F.coalesce("remembered", F.lit(-1).cast("bigint")).alias("remembered"))


@query("SELECT lower(p_name || p_brand) AS alias, min(p_partkey) AS team_id FROM part GROUP BY 1 HAVING count(DISTINCT p_size) = 1")
def j11_unique_alias(spark, d):
    parts = table(spark, d, "part").groupBy(F.lower(F.concat("p_name", "p_brand")).alias("alias"), F.col("p_size").alias("size")).agg(F.min("p_partkey").alias("first"))
    return matching.unique_aliases(parts.select("alias", F.col("size").alias("team_id"))).join(parts.groupBy("alias").agg(F.min("first").alias("first")), "alias").select("alias", F.col("first").alias("team_id"))


@query("WITH p AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name_a, split_part(p_name, ' ', 2) AS name_b FROM part), k AS (SELECT DISTINCT least(name_a, name_b) AS a, greatest(name_a, name_b) AS b FROM p WHERE length(name_a) <> length(name_b)) SELECT name_a, name_b, k.a IS NOT NULL AS same_team FROM p LEFT JOIN k ON k.a = least(name_a, name_b) AND k.b = greatest(name_a, name_b)")
def j12_unordered_pair(spark, d):
    pairs = table(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name_a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("name_b")).distinct()
    known = pairs.filter(F.length("name_a") != F.length("name_b")).select(F.col("name_b").alias("name_a"), F.col("name_a").alias("name_b"), F.lit(True).alias("same_team"))
    return matching.same_team(pairs, known).withColumn("same_team", F.coalesce("same_team", F.lit(False)))


@query(with_views("odds", "fixtures") + " SELECT fixture_id FROM fixtures WHERE fixture_id NOT IN (SELECT fixture_id FROM odds WHERE pa_category = 'COM_PA' AND price < 1.5)")
def j16_not_collected(spark, d):
    fixtures, odds = _views(spark, d, "fixtures", "odds")
    return targets.not_collected(fixtures, odds.filter("pa_category = 'COM_PA' AND price < 1.5")).select("fixture_id")


@query(with_views("links") + " SELECT fixture_id, arg_max(external_event_id, (updated_at, external_event_id)) AS external_event_id FROM links GROUP BY 1")
def w03_latest_link_per_fixture(spark, d):
    return targets.latest_link(table(spark, d, "links"))


@query(with_views("fixtures") + " SELECT fixture_id, league_id FROM (SELECT *, row_number() OVER (PARTITION BY league_id ORDER BY fixture_id DESC) AS k FROM fixtures) WHERE k <= 3")
def w05_top3_per_league(spark, d):
    return targets.top_of(table(spark, d, "fixtures"), ["league_id"], 3, F.col("fixture_id").desc()).select("fixture_id", "league_id")


@query(_STREAM + " SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY lane ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase, lead(event_type, 2) OVER (PARTITION BY lane ORDER BY ts, event_id) AS second_next FROM stream")
def w07_forward_fill(spark, d):
    """State carried forward over ordered rows, and what stands two rows on."""
    stream = table(spark, d, "stream")
    out = targets.carried(stream, ["lane"], ["ts", "event_id"], last_purchase=F.when(F.col("event_type") == "purchase", F.col("value")))
    by = Window.partitionBy("lane").orderBy("ts", "event_id")
    return out.select("event_id", "last_purchase", F.lead("event_type", 2).over(by).alias("second_next"))


@query(with_views("links") + " SELECT external_event_id, fixture_id FROM links ORDER BY updated_at DESC, external_event_id LIMIT 500")
def w11_latest_500(spark, d):
    return targets.latest(table(spark, d, "links"), 500, F.col("updated_at").desc(), F.col("external_event_id")).select("external_event_id", "fixture_id")


@query(with_views("odds", "fixtures") + ", spine AS (SELECT d.date_key, b.bookmaker FROM (SELECT DISTINCT date_key FROM fixtures WHERE date_key < DATE '2000-01-11') d, (SELECT unnest(range(12)) AS bookmaker) b) SELECT CAST(s.date_key AS VARCHAR) AS date_key, s.bookmaker, count(o.fixture_id) AS odds, count(DISTINCT o.fixture_id) AS games FROM spine s LEFT JOIN (SELECT f.date_key, o.bookmaker, o.fixture_id FROM odds o JOIN fixtures f USING (fixture_id)) o ON o.date_key = s.date_key AND o.bookmaker = s.bookmaker GROUP BY 1, 2")
def g10_coverage(spark, d):
    fixtures, odds = _views(spark, d, "fixtures", "odds")
    days = fixtures.filter("date_key < DATE '2000-01-11'").select("date_key").distinct()
    spine = days.withColumn("bookmaker", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint"))))
    return reports.coverage(odds, fixtures, spine).withColumn("date_key", F.col("date_key").cast("string"))


@query(with_views("odds", "fixtures") + ", t AS (SELECT league_id, count(*) AS api_games FROM fixtures GROUP BY 1), g AS (SELECT o.bookmaker, f.league_id, count(DISTINCT fixture_id) AS games FROM odds o JOIN fixtures f USING (fixture_id) GROUP BY 1, 2), p AS (SELECT g.*, api_games, CAST(floor(100.0 * games / api_games + 0.5) AS BIGINT) AS pct FROM g JOIN t USING (league_id)) SELECT *, CASE WHEN games = 0 THEN 'red' WHEN pct < 50 THEN 'yellow' WHEN pct >= 80 THEN 'green' ELSE 'white' END AS colour FROM p")
def g11_status(spark, d):
    fixtures, odds = _views(spark, d, "fixtures", "odds")
    return reports.status(odds, fixtures)


@query("SELECT event_type, count(*) AS n_nodes, array_to_string(list_slice(list_sort(list(DISTINCT user_id)), 1, 25), ',') AS first_values FROM events GROUP BY 1")
def g12_node_summary(spark, d):
    out = reports.node_summary(table(spark, d, "events"), "event_type", "user_id")
    return out.select("event_type", "n_nodes", F.array_join(F.col("values").cast("array<string>"), ",").alias("first_values"))


@query(with_views("fixtures") + " SELECT league_id, count(*) AS n_fixtures, league_id < 25 AS supported FROM fixtures GROUP BY 1")
def g15_league_counts(spark, d):
    return reports.league_counts(table(spark, d, "fixtures"), table(spark, d, "leagues").filter("league_id < 25"))


@query(with_views("leagues") + ", c AS (SELECT DISTINCT league_id + 10 AS league_id FROM leagues), j AS (SELECT CASE WHEN l.enabled IS NULL THEN 'missing' WHEN c.league_id IS NULL THEN 'unknown' WHEN l.enabled THEN 'synced' ELSE 'disabled' END AS state FROM c FULL JOIN leagues l ON l.league_id = c.league_id) SELECT state, count(*) AS n_leagues FROM j GROUP BY 1")
def g16_catalog(spark, d):
    leagues = table(spark, d, "leagues")
    return reports.catalog(leagues.select((F.col("league_id") + 10).alias("league_id")), leagues)


@query(with_views("fixtures") + " SELECT league_id, count(*) FILTER (starts_at >= DATE '2000-02-01') AS targeted, count(*) FILTER (NOT starts_at >= DATE '2000-02-01') AS skipped, count(*) AS available FROM fixtures GROUP BY 1")
def f01_prematch_counts(spark, d):
    return targets.prematch_counts(table(spark, d, "fixtures"), _now())


@query(with_views("fixtures") + " SELECT fixture_id FROM fixtures WHERE starts_at > DATE '2000-02-01' AND starts_at < DATE '2000-02-03'")
def f02_canonical_window(spark, d):
    return targets.canonical_window(table(spark, d, "fixtures"), _now()).select("fixture_id")


@query(with_views("fixtures") + " SELECT fixture_id FROM fixtures WHERE date_key IN (DATE '2000-01-31', DATE '2000-02-01', DATE '2000-02-02')")
def f03_date_keys(spark, d):
    return targets.around_dates(table(spark, d, "fixtures"), _now()).select("fixture_id")


@query(with_views("fixtures") + " SELECT fixture_id FROM fixtures WHERE status NOT IN ('Brand#1', 'Brand#2', 'Brand#3') AND league_id IN (SELECT league_id FROM fixtures WHERE league_id < 25)")
def f06_active_target_fixtures(spark, d):
    """Finished states go (F06), only target leagues stay."""
    fixtures, leagues = _views(spark, d, "fixtures", "leagues")
    return targets.active_targets(fixtures, leagues.filter("league_id < 25"), ("Brand#1", "Brand#2", "Brand#3")).select("fixture_id")


@query(with_views("links", "odds", "fixtures") + " SELECT l.external_event_id FROM links l WHERE l.source_url IS NULL OR l.fixture_id NOT IN (SELECT fixture_id FROM fixtures) OR (l.external_event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM odds o WHERE o.fixture_id = l.fixture_id AND o.bookmaker = l.bookmaker))")
def f11_snapshot_work(spark, d):
    """Work left: no link, its fixture gone, or no prices and another signature."""
    links, fixtures, odds = _views(spark, d, "links", "fixtures", "odds")
    return targets.work_left(links, fixtures, odds, F.col("external_event_id") % 3 != 0).select("external_event_id")


@query(with_views("fixtures") + " SELECT league_id, CAST(min(starts_at) - INTERVAL 1 HOUR AS VARCHAR) AS opens, CAST(max(starts_at) + INTERVAL 1 HOUR AS VARCHAR) AS closes, count(DISTINCT date_key) AS days FROM fixtures GROUP BY 1")
def f14_collection_window(spark, d):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return targets.collection_window(table(spark, d, "fixtures")).select("league_id", stamp("opens"), stamp("closes"), "days")


@query("SELECT DISTINCT ON (url) url, priority FROM (SELECT url, 1 AS priority FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT url, 2 FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT url, 3 FROM pages) ORDER BY url, priority")
def f17_url_candidates(spark, d):
    """Addresses of several origins, each once, under its best origin."""
    pages = table(spark, d, "pages")
    return targets.best_origin(pages.filter("page_id % 2 = 0"), pages.filter("page_id % 3 = 0"), pages)


@query(GAMES + " SELECT fixture_id, bookmaker, pa_category, price FROM (SELECT *, row_number() OVER (PARTITION BY fixture_id, bookmaker ORDER BY price DESC, pa_category, source_odd_id) AS k FROM odds) WHERE k = 1")
def w06_best_market(spark, d):
    return writepath.first_by(table(spark, d, "odds"), ["fixture_id", "bookmaker"], F.col("price").desc(), F.col("pa_category"), F.col("source_odd_id")).select("fixture_id", "bookmaker", "pa_category", "price")
