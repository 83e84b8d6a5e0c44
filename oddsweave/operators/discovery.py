"""Finding what to collect: canonical fixtures and leagues, tournaments of leagues, known links, listings and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.functions import similarity
from oddsweave.functions.text import matching_tokens, normalize_for_matching, normalize_name
from oddsweave.sources.tables import spread as dealt_out

FIXTURE = "struct<errors:string, response:array<struct<fixture:struct<id:bigint, date:string, status:struct<short:string>>, league:struct<id:bigint, name:string, country:string, season:int>, teams:struct<home:struct<id:bigint, name:string>, away:struct<id:bigint, name:string>>>>>"
LEAGUE = "struct<errors:string, response:array<struct<league:struct<id:bigint, name:string>, country:struct<name:string>, seasons:array<struct<year:int, current:boolean>>>>>"
NO_ERRORS = ("[]", "null", "false", "0", '""', "")


def _responses(pages: DataFrame, column: str, schema: str) -> DataFrame:
    """Entries of ``{response, errors}`` pages; a page with errors stops the job, one whose response is no list has none."""
    page = F.from_json(column, schema)
    errors = F.coalesce(F.get_json_object(column, "$.errors"), F.lit(""))
    checked = F.when(errors.isin(*NO_ERRORS), page["response"]).otherwise(F.raise_error(F.concat(F.lit("page with errors: "), errors)).cast(page_type(schema)))
    return pages.select(F.explode(checked).alias("e"))


def page_type(schema: str) -> str:
    """The type of ``response`` in a page's."""
    return schema[schema.index("response:") + len("response:") : -1]


def api_fixtures(pages: DataFrame, column: str = "value") -> DataFrame:
    """Canonical fixtures of JSON pages."""
    e = F.col("e")
    return _responses(pages, column, FIXTURE).select(
        e["fixture"]["id"].alias("fixture_id"),
        e["league"]["id"].alias("league_id"),
        e["league"]["name"].alias("league_name"),
        e["league"]["country"].alias("country"),
        e["league"]["season"].alias("season"),
        e["teams"]["home"]["name"].alias("home_team"),
        e["teams"]["away"]["name"].alias("away_team"),
        F.to_timestamp(e["fixture"]["date"]).alias("starts_at"),
        e["fixture"]["status"]["short"].alias("status"),
    )


def league_catalog(pages: DataFrame, column: str = "value") -> DataFrame:
    """Leagues of JSON pages with one season: the current one, else the latest."""
    e = F.col("e")
    current = F.get(F.filter(e["seasons"], lambda s: s["current"])["year"], 0)
    return _responses(pages, column, LEAGUE).select(e["league"]["id"].alias("league_id"), e["league"]["name"].alias("league_name"), e["country"]["name"].alias("country"), F.coalesce(current, F.array_max(e["seasons"]["year"])).alias("season"))


def champ_ids(fixtures: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ids under which a feed lists the fixtures' leagues; ``known``: league_id and champ_id (null: not listed)."""
    return known.filter("champ_id IS NOT NULL").join(fixtures.select("league_id").distinct(), "league_id", "left_semi").select("champ_id").distinct()


def _compact(name: Column) -> Column:
    return F.regexp_replace(normalize_for_matching(name), " ", "")


def league_score(canonical: Column, candidate: Column) -> Column:
    """How alike two league names are: friendlies, equal, one within the other, else shared telling tokens."""
    a, b, x, y = normalize_for_matching(canonical), normalize_for_matching(candidate), _compact(canonical), _compact(candidate)
    tell = lambda c: F.array_distinct(F.filter(matching_tokens(c), lambda t: F.length(t) > 3))
    left, right = tell(canonical), tell(candidate)
    shared = F.size(F.array_intersect(left, right))
    overlap = shared / F.size(left)
    by_tokens = F.when((F.size(left) == 0) | (F.size(right) == 0) | (shared == 0), 0.0).otherwise(overlap * 0.85 - (F.size(right) - shared) * 0.04)
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(a.rlike("friendlies|friendly") & b.rlike("amistoso|amistosos|friendly|friendlies"), 0.96)
        .when(x == y, 1.0)
        .when(F.contains(x, y) | F.contains(y, x), F.greatest(F.lit(0.75), 0.95 - F.abs(F.length(x) - F.length(y)) / 100))
        .otherwise(by_tokens)
    )


def selected_leagues(leagues: DataFrame, listed: DataFrame, countries: DataFrame | None = None, strong: float = 0.8, least: float = 0.62) -> DataFrame:
    """Per canonical league the feed's leagues to open: all strong ones, else the best, and those of its country's region.

    ``leagues``: league_id, league_name, country; ``listed``: url, name, region;
    both are dimensions.  Names meet through three letters that both begin some
    word with or a shared piece of their compact form, never all pairs.
    ``countries``: country and alias, for regions under other names.
    """
    def pieces(name):  # of one name within another every piece is shared; telling tokens share their own
        compact = _compact(name)
        grams = F.when(F.length(compact) >= 3, F.transform(F.sequence(F.lit(1), F.length(compact) - 2), lambda i: F.substring(compact, i, F.lit(3))))
        friendly = F.when(normalize_for_matching(name).rlike("amistoso|friendly|friendlies"), F.array(F.lit("friendly")))
        empty = F.array().cast("array<string>")
        return F.array_distinct(F.concat(F.coalesce(grams, F.array(compact)), F.coalesce(friendly, empty)))

    left = leagues.select("league_id", "league_name", F.explode(pieces(F.col("league_name"))).alias("_p"))
    right = listed.filter("url IS NOT NULL").select("url", "name", F.explode(pieces(F.col("name"))).alias("_p"))
    pairs = left.join(right, "_p").drop("_p").distinct().withColumn("score", league_score(F.col("league_name"), F.col("name")))
    by = Window.partitionBy("league_id").orderBy(F.col("score").desc(), "url")
    ranked = pairs.withColumn("_r", F.row_number().over(by))
    chosen = ranked.filter((F.col("score") >= strong) | ((F.col("_r") == 1) & (F.col("score") >= least))).select("league_id", "url", "score")
    named = leagues.select("league_id", normalize_for_matching(F.col("country")).alias("_c"))
    if countries is not None:
        alias = countries.select(normalize_for_matching(F.col("country")).alias("_c"), normalize_for_matching(F.col("alias")).alias("_a")).distinct()
        named = named.join(alias, "_c", "left").withColumn("_c", F.coalesce("_a", "_c")).drop("_a")
    region = listed.filter("url IS NOT NULL").select("url", normalize_for_matching(F.col("region")).alias("_region")).withColumn("_w", F.explode(F.split("_region", " ")))
    around = named.filter("_c <> ''").withColumn("_w", F.split_part("_c", F.lit(" "), F.lit(1))).join(region, "_w").filter(F.contains("_region", "_c"))
    out = chosen.unionByName(around.select("league_id", "url", F.lit(0.5).alias("score")))
    # A region's hit is written last, over a score of the name.
    return out.groupBy("league_id", "url").agg(F.min(F.when(F.col("score") == 0.5, 0.5)).alias("_region"), F.max("score").alias("score")).select("league_id", "url", F.coalesce("_region", "score").alias("score"))


def weighted_tournaments(leagues: DataFrame, tournaments: DataFrame, countries: DataFrame, k: int = 3, blocks: int = 16, name_weight: float = 0.78, least_name: float = 0.72, least_country: float = 0.65) -> DataFrame:
    """Per league the ``k`` tournaments of the best weighted score of name and country, behind a gate for each.

    ``leagues``: league_id, league_name, country; ``tournaments``: tournament_id,
    tournament_name, season_name, path (an array of texts, the country among
    them); ``countries``: country and alias (a country without aliases is its
    own).  Every league is asked against all names and paths of tournaments, once
    each, in blocks.  A league without a country scores half a country.
    """
    alike = similarity.token_set_udf()
    keyed = tournaments.select("tournament_id", F.concat(F.array("tournament_name", "season_name"), F.array(F.array_join("path", " "))).alias("_names"), normalize_for_matching(F.array_join("path", " ")).alias("_path"))
    keyed = dealt_out(keyed, "tournament_id").withColumn("_form", F.xxhash64("_names", "_path"))
    # What tournaments share, names and path, is judged once; the tournaments come back behind the gates.
    form = ["_form", "_names", "_path"]
    written = F.filter("_names", lambda n: F.coalesce(n, F.lit("")) != "")
    forms = keyed.select(*form).distinct().select(*form, written.alias("_written"), F.filter(F.transform(written, _compact), lambda n: n != "").alias("_short"), F.pmod("_form", F.lit(blocks)).cast("int").alias("_block"))
    aliases = countries.select(normalize_for_matching(F.col("country")).alias("_c"), normalize_for_matching(F.col("alias")).alias("_a")).distinct().groupBy("_c").agg(F.array_sort(F.collect_set("_a")).alias("_known"))
    own = leagues.select("league_id", "league_name", _compact(F.col("league_name")).alias("_x"), normalize_for_matching(F.col("country")).alias("_c")).join(aliases, "_c", "left")
    own = own.withColumn("_known", F.when(F.col("_c") != "", F.coalesce("_known", F.array("_c")))).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = own.join(forms, "_block").drop("_block", "_c")
    x = F.col("_x")
    within = F.exists("_short", lambda n: (x != "") & (F.contains(n, x) | F.contains(x, n)))
    # Names and countries that letters settle aren't compared.
    known = F.exists(F.coalesce("_known", F.array().cast("array<string>")), lambda a: F.contains(F.col("_path"), a))
    judged = pairs.select("league_id", *form, "league_name", "_known", "_written", within.alias("_within"), known.alias("_there"))
    open_ = lambda when, c: F.explode_outer(F.when(when, F.col(c)))
    named = judged.withColumn("_n", open_(~F.col("_within"), "_written")).withColumn("_s", F.when(F.col("_within"), 1.0).otherwise(F.coalesce(alike("league_name", "_n"), F.lit(0.0))))
    name_score = named.groupBy("league_id", *form, "_known", "_there").agg(F.max("_s").alias("name_score")).filter(F.col("name_score") >= least_name)
    placed = name_score.withColumn("_a", open_(~F.col("_there"), "_known")).withColumn("_s", F.when(F.col("_known").isNull(), 0.5).when(F.col("_there"), 1.0).otherwise(F.coalesce(alike("_a", "_path"), F.lit(0.0))))
    passed = placed.groupBy("league_id", *form, "name_score").agg(F.max("_s").alias("country_score")).filter(F.col("country_score") >= least_country)
    same = [F.col("p._form") == F.col("t._form"), F.col("p._names").eqNullSafe(F.col("t._names")), F.col("p._path").eqNullSafe(F.col("t._path"))]
    named = passed.alias("p").join(keyed.alias("t"), same).groupBy("league_id", "tournament_id", "p._path").agg(F.max("name_score").alias("name_score"), F.max("country_score").alias("country_score"))
    scored = named.groupBy("league_id", "tournament_id", "name_score").agg(F.max("country_score").alias("country_score"))
    score = F.col("name_score") * name_weight + F.col("country_score") * (1 - name_weight)
    by = Window.partitionBy("league_id").orderBy(F.col("score").desc(), "tournament_id")
    return scored.withColumn("score", score).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def cached_links(fixtures: DataFrame, links: DataFrame, snapshots: DataFrame, page: str = r"/E?\d+(?:/F|/?$)") -> DataFrame:
    """A link to open for each fixture: the latest stored one, else that of the latest snapshot that names the fixture.

    ``links``: fixture_id, event_id, source_url, home_team, away_team, updated_at;
    ``snapshots``: the same without fixture_id, which stands in ``raw``.  Links
    without an event page (``page``) or a side's name don't count.
    """
    whole = F.col("source_url").rlike(page) & (F.coalesce("home_team", F.lit("")) != "") & (F.coalesce("away_team", F.lit("")) != "")
    columns = ["fixture_id", "event_id", "source_url", "home_team", "away_team", "updated_at"]
    own = links.filter(whole).select(*columns, F.lit(True).alias("linked"))
    seen = snapshots.withColumn("fixture_id", F.get_json_object("raw", "$.fixtureId").try_cast("bigint")).filter(whole & F.col("fixture_id").isNotNull())
    rows = own.unionByName(seen.select(*columns, F.lit(False).alias("linked"))).join(fixtures.select("fixture_id").distinct(), "fixture_id", "left_semi")
    best = F.max_by(F.struct("event_id", "source_url", "home_team", "away_team", "linked"), F.struct("linked", "updated_at", "event_id"))
    return rows.groupBy("fixture_id").agg(best.alias("r")).select("fixture_id", "r.*")


def merged_listing(first: DataFrame, more: DataFrame, page: str = "page_id", refreshed: DataFrame | None = None) -> DataFrame:
    """Events of a league's page and of its second listing: of the second, those of pairs of teams that the first hasn't; once each.

    ``refreshed`` (event_id, home_team, away_team): what has been collected anew
    already, by id or by its teams' normal forms, isn't listed again.
    """
    key = [page, "home_team", "away_team"]
    new = more.join(first.select(*key).distinct(), key, "left_anti").dropDuplicates(key)
    out = first.unionByName(new.select(*first.columns))
    if refreshed is None:
        return out
    pair = team_pair(F.col("home_team"), F.col("away_team"))
    ids = refreshed.select("event_id").filter("event_id IS NOT NULL").distinct()
    pairs = refreshed.select(pair.alias("_pair")).distinct()
    return out.join(ids, "event_id", "left_anti").withColumn("_pair", pair).join(pairs, "_pair", "left_anti").drop("_pair")


def first_hit(found: DataFrame) -> DataFrame:
    """Matches of the first keyword of a fixture that has any, of these the best.

    ``found``: fixture_id, nth (of the keyword), event_id, score, of matches only.
    """
    by = Window.partitionBy("fixture_id").orderBy("nth", F.col("score").desc(), "event_id")
    return found.withColumn("_r", F.row_number().over(by)).filter("_r = 1").drop("_r")


def fallback_tournaments(events: DataFrame, missing: DataFrame, least: float = 0.62) -> DataFrame:
    """Tournaments to list whole: those of seen events whose name looks like the league of a fixture that has no event yet."""
    seen = events.filter("tournament_id IS NOT NULL").select("tournament_id", "tournament_name").distinct()
    wanted = missing.select("league_name").distinct()
    token = lambda df, c: df.withColumn("_t", F.explode(F.array_distinct(matching_tokens(F.col(c)))))
    pairs = token(seen, "tournament_name").join(token(wanted, "league_name"), "_t").drop("_t").distinct()
    return pairs.filter(similarity.token_set_udf()("league_name", "tournament_name") >= least).select("tournament_id").distinct()


def cached_ids(missing: DataFrame, cached: DataFrame, seen: DataFrame) -> DataFrame:
    """Event ids to fetch for fixtures that are still without an event: those that a link remembers and that the listing hasn't given already."""
    wanted = cached.join(missing.select("fixture_id").distinct(), "fixture_id", "left_semi").filter("event_id IS NOT NULL")
    return wanted.select("fixture_id", "event_id").distinct().join(seen.select("event_id").distinct(), "event_id", "left_anti")


def listed_events(fixtures: DataFrame, events: DataFrame, least: float = 0.6) -> DataFrame:
    """Events of a league's page with the fixture both of whose sides they resemble, by page and day, the first by id."""
    score = similarity.team_score_udf()
    pairs = events.join(fixtures.select("league_id", "date_key", "fixture_id", F.col("home_team").alias("_h"), F.col("away_team").alias("_a")), ["league_id", "date_key"])
    both = pairs.filter((score("_h", "home_team") >= least) & (score("_a", "away_team") >= least))
    return both.groupBy(*events.columns).agg(F.min("fixture_id").alias("fixture_id"))


def second_phase(fixtures: DataFrame, collected: DataFrame) -> DataFrame:
    """Fixtures that the first phase, by known links, left: the second looks for these."""
    return fixtures.join(collected.select("fixture_id").distinct(), "fixture_id", "left_anti")


def cleanup_fixtures(fixtures: DataFrame, linked: DataFrame, errors: int | Column) -> DataFrame:
    """Fixtures whose stale rows a run may delete: all of them after a run without errors, else those it linked."""
    own = linked.select("fixture_id", F.lit(True).alias("_linked")).distinct()
    clean = F.lit(errors) == 0 if isinstance(errors, int) else errors == 0
    return fixtures.select("fixture_id").distinct().join(own, "fixture_id", "left").filter(clean | F.coalesce("_linked", F.lit(False))).select("fixture_id")


def team_pair(home: Column, away: Column) -> Column:
    return F.concat_ws("|", normalize_name(home), normalize_name(away))
