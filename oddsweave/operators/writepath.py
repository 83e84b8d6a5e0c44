"""Write path: best prices, group validation, conflicts, blocks, differences, next states.

No table format with MERGE is assumed: every change of a table is a function from
its rows and the incoming rows to its next rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.functions.rules import eligibility

LEAST_PROBABILITY, MOST_PROBABILITY = 0.9, 1.35
MONEYLINE, SIDES = "1X2", ("HOME", "DRAW", "AWAY")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


GROUP = ["fixture_id", "bookmaker", "market_code", "pa_category"]


def moneyline(prices: DataFrame) -> DataFrame:
    """Prices of the full-time result market, the only one that is grouped and compared."""
    return prices.filter(F.col("market_code") == MONEYLINE)


def best_price(prices: DataFrame, order: str = "source_odd_id") -> DataFrame:
    """The highest price per fixture, bookmaker, market, category and selection; on a tie the first by ``order``."""
    keys = [*GROUP, "selection"]
    rest = [c for c in prices.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col("price"), -F.col(order)))
    return prices.groupBy(*keys).agg(best.alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def _groups(prices: DataFrame, order: str | None = None, *more: Column) -> DataFrame:
    """One row per group of result prices (of all, where there is ``more`` to gather): the best price of each side (with ``order``: its row), what else there is, and the verdict's parts."""
    rows = []
    at = lambda s: F.col("selection") == s
    if order:
        kept = F.struct(*(c for c in prices.columns if c not in GROUP))
        rows = [F.max_by(F.when(at(s), kept), F.when(at(s), F.struct(F.col("price"), -F.col(order)))).alias(f"row_{s}") for s in SIDES]
    sides = [F.max(F.when(at(s), F.col("price"))).alias(s) for s in SIDES]
    grouped = (prices if more else moneyline(prices)).groupBy(*GROUP)
    got = grouped.agg(*sides, F.bool_or(~F.col("selection").isin(*SIDES)).alias("odd"), *rows, *more)
    home, draw, away = (F.col(s).isNotNull() for s in SIDES)
    # Smallest probability first: 2, 5, 5 are 0.9 or a bit less as doubles by the order of the sides, so one order holds for all.
    ordered = F.sort_array(F.array(*SIDES), asc=False)
    probability = sum((F.coalesce(1 / ordered[k], F.lit(0.0)) for k in range(len(SIDES))), F.lit(0.0))
    complete = home & draw & away & ~F.col("odd")
    two_way = (F.col("pa_category") == "COM_PA") & home & away & ~draw & ~F.col("odd")
    out = got.select("*", complete.alias("complete"), two_way.alias("two_way"), probability.alias("probability"))
    return out.withColumn("valid", (F.col("complete") & F.col("probability").between(LEAST_PROBABILITY, MOST_PROBABILITY)) | F.col("two_way"))


def group_verdicts(prices: DataFrame) -> DataFrame:
    """One row per fixture, bookmaker, market and category of the result market: complete, two_way, probability, valid.

    Complete groups have all three selections and a sum of probabilities within
    bounds; early-payout groups may be home and away alone, without a check.
    Other markets have no verdict.
    """
    return _groups(prices).select(*GROUP, "complete", "two_way", "probability", "valid")


def valid_prices(prices: DataFrame, order: str = "source_odd_id") -> DataFrame:
    """Best prices of valid groups of the result market, and all prices of other markets; one grouping, one pass."""
    kept = [c for c in prices.columns if c not in GROUP]
    other = F.collect_list(F.when(F.col("market_code") != MONEYLINE, F.struct(*kept)))
    groups = _groups(prices, order, other.alias("_other"))
    sides = F.array_compact(F.array(*(f"row_{s}" for s in SIDES)))
    rows = F.when(F.col("market_code") != MONEYLINE, F.col("_other")).when(F.col("valid"), sides)
    return groups.select(*GROUP, F.explode(rows).alias("row")).select(*(c if c in GROUP else F.col(f"row.`{c}`").alias(c) for c in prices.columns))


def conflicts(links: DataFrame) -> DataFrame:
    """Fixtures to which a bookmaker's batch links more than one event: fixture_id, bookmaker, n_events."""
    return links.groupBy("bookmaker", "fixture_id").agg(F.count_distinct("external_event_id").alias("n_events")).filter("n_events > 1")


def _stops(blocks: DataFrame) -> DataFrame:
    """Per fixture and bookmaker: whether its event is exhausted, else the rejected event ids, and the categories that are stopped, exhausted or not."""
    event = F.col("scope") == "EVENTO"
    return blocks.groupBy("fixture_id", "bookmaker").agg(
        F.bool_or(event & F.col("blocked")).alias("_exhausted"),
        F.flatten(F.collect_list(F.when(event & ~F.col("blocked"), F.col("rejected_event_ids")))).alias("_rejected"),
        F.collect_set(F.when(F.col("scope") == "PARCIAL", F.col("pa_category"))).alias("_parts"),
    )


def _judged_links(links: DataFrame, stops: DataFrame) -> DataFrame:
    """Links with ``_gone``: those of exhausted events, and those to events that were rejected."""
    event = F.col("external_event_id").cast("string")
    gone = F.coalesce("_exhausted", F.lit(False)) | F.coalesce(F.array_contains("_rejected", event), F.lit(False))
    return links.join(stops.drop("_parts"), ["fixture_id", "bookmaker"], "left").withColumn("_gone", gone).drop("_exhausted", "_rejected")


def open_links(links: DataFrame, blocks: DataFrame) -> DataFrame:
    """Links that no block stops."""
    return _judged_links(links, _stops(blocks)).filter(~F.col("_gone")).drop("_gone")


def apply_blocks(prices: DataFrame, blocks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Prices that no block stops.

    An exhausted event stops all of a fixture and bookmaker, a link to a rejected
    event too; a category is stopped by its block, whether or not that says blocked.
    """
    return _open_prices(prices, _stops(blocks), None if links is None else _judged_links(links, _stops(blocks)))


def _open_prices(prices: DataFrame, stops: DataFrame, judged: DataFrame | None, conflicting: bool = False) -> DataFrame:
    """Prices that ``stops``, dropped links and (``conflicting``) links to several events leave: two joins, on one partitioning."""
    key = ["fixture_id", "bookmaker"]
    out = prices.join(stops.drop("_rejected"), key, "left")
    stop = F.coalesce("_exhausted", F.lit(False)) | F.coalesce(F.array_contains("_parts", F.col("pa_category")), F.lit(False))
    if judged is not None:
        kept = F.when(~F.col("_gone"), F.col("external_event_id"))
        out = out.join(judged.groupBy(*key).agg(F.bool_or("_gone").alias("_lost"), (F.count_distinct(kept) > 1).alias("_several")), key, "left")
        stop = stop | F.coalesce("_lost", F.lit(False))
        if conflicting:
            stop = stop | F.coalesce("_several", F.lit(False))
    return out.filter(~stop).select(*prices.columns)


def diff(current: DataFrame, incoming: DataFrame, keys: list[str], values: dict[str, int | None], scope: DataFrame | None = None) -> DataFrame:
    """Keys, both sides' values and the action: insert, update, touch or stale.

    ``values`` maps compared columns to the decimals they are compared at (None:
    as they are).  Keys and values compare null to null.  ``scope`` limits what
    may become stale to the keys' first column's values in it.
    """
    names = list(values)
    left = current.select(*(F.col(k).alias(f"c_{k}") for k in keys), *(F.col(v).alias(f"old_{v}") for v in names), F.lit(True).alias("_old"))
    right = incoming.select(*keys, *(F.col(v).alias(f"new_{v}") for v in names), F.lit(True).alias("_new"))
    on = [F.col(f"c_{k}").eqNullSafe(F.col(k)) for k in keys]
    both = left.join(right, on, "full_outer")
    rounded = lambda c, d: F.col(c) if d is None else F.round(F.col(c), d)
    same = F.lit(True)
    for v, d in values.items():
        same = same & rounded(f"old_{v}", d).eqNullSafe(rounded(f"new_{v}", d))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "stale").when(same, "touch").otherwise("update")
    out = both.select(*(F.coalesce(F.col(k), F.col(f"c_{k}")).alias(k) for k in keys), *(f"old_{v}" for v in names), *(f"new_{v}" for v in names), action.alias("action"))
    if scope is not None:
        out = out.join(scope.select(keys[0], F.lit(True).alias("_in")).distinct(), keys[0], "left").filter("action <> 'stale' OR _in").drop("_in")
    return out


#: What a link's change is judged by, with the decimals that numbers are compared at.
LINK_VALUES = {"fixture_id": None, "event_name": None, "home_team": None, "away_team": None, "starts_at": None, "confidence": 3, "source_url": None, "raw": None}


def changed_links(current: DataFrame, incoming: DataFrame, keys: list[str] = ["bookmaker", "external_event_id"], values: dict[str, int | None] = LINK_VALUES) -> DataFrame:
    """``diff`` of links: names and addresses as they are, times by instant, confidence to three decimals, raw JSON by content (not by blanks or the order of keys)."""
    plain = lambda df: df.withColumns({v: F.to_json(F.parse_json(v)) for v in values if v == "raw"})
    return diff(plain(current), plain(incoming), keys, values)


def _named(rows: DataFrame, markets: tuple[str, ...]) -> Column:
    """Whether a row is of one of the markets; rows of a table without markets are."""
    return F.col("market_code").isin(*markets) if "market_code" in rows.columns else F.lit(True)


def merged(current: DataFrame, incoming: DataFrame, keys: list[str], values: dict[str, int | None], as_of: Column, scope: DataFrame | None = None, markets: tuple[str, ...] = (MONEYLINE,)) -> DataFrame:
    """Next rows in merge mode: new and changed rows from ``incoming``, unchanged ones seen again, stale ones gone, all others as they were.

    ``scope``: the fixtures and bookmakers of which rows may be stale (default:
    those of ``incoming``), and ``markets`` of which.  Keys compare null to null.
    ``updated_at`` moves only where a compared value did; ``last_seen_at`` always.
    """
    on = [c for c in ("fixture_id", "bookmaker") if c in current.columns]
    inside = (incoming if scope is None else scope).select(*on).distinct().withColumn("_inside", F.lit(True))
    old = current.join(inside, on, "left").select(F.struct(*current.columns).alias("_old"), (F.coalesce("_inside", F.lit(False)) & F.coalesce(_named(current, markets), F.lit(False))).alias("_stale"))
    new = incoming.select(F.struct(*incoming.columns).alias("_new"))
    both = old.join(new, [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in keys], "full_outer")
    rounded = lambda c, d: F.col(c) if d is None else F.round(F.col(c), d)
    same = F.col("_old").isNotNull()
    for v, d in values.items():
        same = same & rounded(f"_old.{v}", d).eqNullSafe(rounded(f"_new.{v}", d))
    fresh = F.col("_new").isNotNull()

    def column(name: str) -> Column:
        was = F.col(f"_old.{name}") if name in current.columns else F.lit(None)
        if name == "updated_at":
            return F.when(fresh & ~same, as_of).otherwise(was)
        if name == "last_seen_at":
            return F.when(fresh, as_of).otherwise(was)
        return F.when(fresh, F.col(f"_new.{name}")).otherwise(was) if name in incoming.columns else was

    names = [*incoming.columns, *(c for c in (*current.columns, "updated_at", "last_seen_at") if c not in incoming.columns)]
    return both.filter(fresh | ~F.col("_stale")).select(*(column(c).alias(c) for c in dict.fromkeys(names)))


def replaced(current: DataFrame, incoming: DataFrame, scope: DataFrame, on: list[str], markets: tuple[str, ...] = (MONEYLINE,)) -> DataFrame:
    """Next rows in replace mode: all rows of ``markets`` whose ``on`` columns are in ``scope`` give way to ``incoming``.

    A fixture in ``scope`` that was dropped from ``incoming`` loses these rows.
    """
    inside = scope.select(*on).distinct().withColumn("_inside", F.lit(True))
    kept = current.join(inside, on, "left").filter(F.col("_inside").isNull() | ~F.coalesce(_named(current, markets), F.lit(False))).select(*current.columns)
    return kept.unionByName(incoming, allowMissingColumns=True)


def moved_links(current: DataFrame, links: DataFrame) -> DataFrame:
    """Fixtures (with bookmaker) that a stored link leaves, as its event is linked to another one now."""
    now = links.select("bookmaker", F.col("external_event_id").cast("string").alias("_event"), F.col("fixture_id").alias("_to")).distinct()
    was = current.withColumn("_event", F.col("external_event_id").cast("string"))
    return was.join(now, ["bookmaker", "_event"]).filter("fixture_id <> _to").select("fixture_id", "bookmaker").distinct()


def next_links(current: DataFrame, links: DataFrame, scope: DataFrame) -> DataFrame:
    """Links after a batch: one per bookmaker and event; the batch's come in, other links of fixtures in ``scope`` go, the rest stays."""
    event = lambda df: df.withColumn("_event", F.col("external_event_id").cast("string"))
    inside = scope.select("fixture_id", "bookmaker").distinct()
    old = event(current.join(inside, ["fixture_id", "bookmaker"], "left_anti"))
    kept = old.join(event(links).select("bookmaker", "_event").distinct(), ["bookmaker", "_event"], "left_anti").select(*current.columns)
    return kept.unionByName(links.select(*current.columns))


@dataclass(frozen=True)
class Saved:
    """``prices`` and ``links`` after a batch, and its ``scope`` (fixture_id, bookmaker)."""

    prices: DataFrame
    links: DataFrame
    scope: DataFrame


def save(current: DataFrame, incoming: DataFrame, links: DataFrame, blocks: DataFrame, stored_links: DataFrame, markets: tuple[str, ...] = (MONEYLINE,)) -> Saved:
    """The full replace-mode write of a batch: blocks, conflicts, validation, then the next prices and links.

    In scope are the fixtures of links and prices that no block stops, and those
    that a moved link leaves; of these, stored rows of ``markets`` give way.  A
    fixture that a block stops keeps what is stored; one whose links are in
    conflict loses it.
    """
    key = ["fixture_id", "bookmaker"]
    stops = _stops(blocks)
    linked = _batch_links(links, stops)
    clean = _unpacked(_batch_prices(incoming, linked, stops).select(F.explode("_clean").alias("row")), incoming.columns)
    clean_links = _unpacked(linked.filter("_clean_links").select(F.explode("_open").alias("row")), links.columns)
    # The scope needs no prices, only of which categories a pair has any.
    priced = _batch_prices(incoming.select(*key, "pa_category"), linked, stops, F.collect_set).filter(F.size("_clean") > 0)
    touched = linked.filter(F.size("_open") > 0).select(*key).union(priced.select(*key))
    scope = touched.union(moved_links(stored_links, clean_links)).distinct()
    prices = replaced(current, valid_prices(clean).select(*current.columns), scope, key, markets)
    return Saved(prices, next_links(stored_links, clean_links, scope), scope)


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in columns))


def _batch_links(links: DataFrame, stops: DataFrame) -> DataFrame:
    """A batch's links by fixture and bookmaker: ``_open`` ones, whether they are clean (of one event), and whether the pair's prices are ``_stopped``.

    Links, prices and stops are partitioned by the pair, and every join of them
    keeps that.  Rows without a fixture or a bookmaker are a pair of their own
    that nothing blocks.
    """
    pairs = _packed(links, "_links", F.collect_list).join(stops.drop("_parts"), ["fixture_id", "bookmaker"], "left")
    rejected = lambda link: F.coalesce(F.array_contains(F.col("_rejected"), link["external_event_id"].cast("string")), F.lit(False))
    open_ = pairs.withColumn("_open", F.filter("_links", lambda x: ~F.coalesce("_exhausted", F.lit(False)) & ~rejected(x)))
    events = F.array_compact(F.array_distinct(F.transform("_open", lambda x: x["external_event_id"])))
    stopped = (F.size("_open") < F.size("_links")) | (F.size(events) > 1)
    return open_.select("fixture_id", "bookmaker", "_open", (F.size(events) <= 1).alias("_clean_links"), stopped.alias("_stopped"))


def _batch_prices(incoming: DataFrame, linked: DataFrame, stops: DataFrame, gather=F.collect_list) -> DataFrame:
    """A batch's prices by fixture and bookmaker that neither a block nor the pair's links stop, as ``_clean``: all that a bookmaker has for a fixture."""
    key = ["fixture_id", "bookmaker"]
    pairs = _packed(incoming, "_prices", gather).join(stops.drop("_rejected"), key, "left").join(linked.select(*key, "_stopped"), key, "left")
    stopped = F.coalesce("_exhausted", F.lit(False)) | F.coalesce("_stopped", F.lit(False))
    parted = lambda price: F.coalesce(F.array_contains(F.col("_parts"), price["pa_category"]), F.lit(False))
    return pairs.filter(~stopped).select(*key, F.filter("_prices", lambda x: ~parted(x)).alias("_clean"))


def _packed(rows: DataFrame, name: str, gather) -> DataFrame:
    return rows.groupBy("fixture_id", "bookmaker").agg(gather(F.struct(*rows.columns)).alias(name))


def save_all(current: DataFrame, incoming: DataFrame, links: DataFrame, blocks: DataFrame, stored_links: DataFrame | None = None) -> DataFrame:
    """The prices of ``save``; without ``stored_links`` no link moves."""
    return save(current, incoming, links, blocks, links.limit(0) if stored_links is None else stored_links).prices


def within_ttl(rows: DataFrame, as_of: Column, hours: int = 2, column: str = "last_seen_at") -> DataFrame:
    """Rows within their time to live."""
    return rows.filter(F.col(column) >= as_of - F.make_interval(hours=F.lit(hours)))


def unseen_before(rows: DataFrame, reliable: DataFrame, before: Column, column: str = "last_seen_at") -> DataFrame:
    """Without rows of reliably collected fixtures that the collection did not see."""
    sure = reliable.select("fixture_id", F.lit(True).alias("_sure")).distinct()
    return rows.join(sure, "fixture_id", "left").filter(F.col("_sure").isNull() | (F.col(column) >= before)).drop("_sure")


def without_started(fixtures: DataFrame, as_of: Column, hours: int = 3) -> DataFrame:
    return fixtures.filter(F.col("starts_at") > as_of - F.make_interval(hours=F.lit(hours)))


def without_ineligible(rows: DataFrame, leagues: DataFrame, texts: list[str], on: str = "league_id") -> DataFrame:
    """Fixtures or snapshots (columns ``texts``) without those that a league of senior teams doesn't admit; rows of unlisted leagues stay.

    ``leagues``: ``on`` and ``senior_only``.  Without leagues, nothing goes.
    """
    rule = leagues.groupBy(on).agg(F.max("senior_only").alias("_senior"))
    out = rows.join(rule, on, "left").filter(F.col("_senior").isNull() | eligibility(F.col("_senior"), *(F.col(c) for c in texts))["eligible"])
    return out.select(*rows.columns)


def listed_up_to(events: DataFrame, fixtures: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of each page (``keys``) the first events in the order, as many as it has fixtures; none where it has none."""
    many = fixtures.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return events.withColumn("_place", place).join(many, keys).filter("_place <= _many").select(*events.columns)


def cascade(rows: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Rows whose fixture still exists."""
    return rows.join(fixtures.select("fixture_id").distinct(), "fixture_id", "left_semi")


def soft_deleted(leagues: DataFrame, wanted: DataFrame, as_of: Column) -> DataFrame:
    """Leagues that are no longer wanted are disabled and stamped; others are left as they are."""
    keep = wanted.select("league_id", F.lit(True).alias("_keep")).distinct()
    gone = F.col("_keep").isNull() & F.col("enabled")
    out = leagues.join(keep, "league_id", "left")
    return out.withColumn("deleted_at", F.when(gone, as_of).otherwise(F.col("deleted_at"))).withColumn("enabled", F.col("enabled") & ~gone).drop("_keep")


def clamped(rows: DataFrame, as_of: Column) -> DataFrame:
    """No update lies in the future, and what was never seen was seen when it was updated."""
    now = rows.withColumn("updated_at", F.least("updated_at", as_of))
    return now.withColumn("last_seen_at", F.coalesce("last_seen_at", "updated_at"))


def lease(state: DataFrame, slug: str, owner: str, as_of: Column, minutes: int = 30) -> DataFrame:
    """A collector's lease goes to ``owner`` if it isn't running or its lease has run out; the row says who holds it."""
    free = (F.col("slug") == slug) & (~F.col("running") | (F.col("lease_until") <= as_of))
    return state.select(
        "slug",
        F.when(free, F.lit(owner)).otherwise(F.col("owner")).alias("owner"),
        (F.col("running") | free).alias("running"),
        F.when(free, as_of + F.make_interval(mins=F.lit(minutes))).otherwise(F.col("lease_until")).alias("lease_until"),
    )


def synced_fixtures(api: DataFrame, existing: DataFrame, leagues: DataFrame, finished: tuple[str, ...]) -> DataFrame:
    """Fixtures after a canonical sync: those of wanted leagues come in, finished ones go, the rest stays."""
    wanted = api.join(leagues.select("league_id").distinct(), "league_id", "left_semi")
    alive = wanted.filter(~F.col("status").isin(*finished))
    return existing.join(wanted.select("fixture_id").distinct(), "fixture_id", "left_anti").unionByName(alive, allowMissingColumns=True)


def sync_due(dates: DataFrame, state: DataFrame, leagues: DataFrame, as_of: Column, minutes: int = 720) -> DataFrame:
    """Dates (date_key) to fetch again: never synced, synced longer ago than ``minutes``, or for other leagues than those enabled now.

    ``state``: date_key, synced_at, league_hash.  The hash to store comes along.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_set("league_id")), lambda i: i.cast("string")), ",")
    now = leagues.filter("enabled").agg(F.sha2(ids, 256).alias("league_hash"))
    known = state.select("date_key", "synced_at", F.col("league_hash").alias("_hash"))
    old = F.col("synced_at").isNull() | (F.col("synced_at") < as_of - F.make_interval(mins=F.lit(minutes)))
    out = dates.select("date_key").distinct().join(known, "date_key", "left").join(F.broadcast(now))  # one row
    return out.filter(old | ~F.col("_hash").eqNullSafe(F.col("league_hash"))).select("date_key", "league_hash")


def synced_dimensions(api: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leagues and teams of fetched fixtures, one row per id, named as in the latest fixture that names them."""
    last = lambda id_, name, order: api.filter(F.col(id_).isNotNull()).groupBy(F.col(id_)).agg(F.max_by(name, order).alias(name))
    leagues = last("league_id", "league_name", F.struct("starts_at", "fixture_id"))
    sides = api.select(F.col("home_team_id").alias("team_id"), F.col("home_team").alias("team"), "starts_at", "fixture_id").unionByName(api.select(F.col("away_team_id").alias("team_id"), F.col("away_team").alias("team"), "starts_at", "fixture_id"))
    teams = sides.filter("team_id IS NOT NULL").groupBy("team_id").agg(F.max_by("team", F.struct("starts_at", "fixture_id", "team")).alias("team"))
    return leagues, teams
