"""Page texts and node payloads to events and prices: line state machines as windows over one page's lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddsweave.functions.rules import decimal_price
from oddsweave.functions.text import fold, normalize_for_matching, normalize_name, normalize_price_text, once

# Month names of two languages, and what ends a block of prices.
MONTHS = {"jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12}
DAYS = "dom|seg|ter|qua|qui|sex|sab|sun|mon|tue|wed|thu|fri|sat"
CLOCK, PRICE = r"^(?:[01]?\d|2[0-3]):[0-5]\d$", r"^(?:[1-9]\d{0,2})[.,]\d{2,3}$"
# What begins and ends a result block.
RESULT_BLOCK = r"^resultado\s+final(?:\s+-\s+pagamento\s+antecipado)?"
RESULT_END = r"^(resultado\s+final|total\s+de\s+gols|gols|resultados\s+finais|gg-ng|inicio|time\s+visitante|dupla\s+chance|1o\s*/\s*2o\s*tempo|marca\s+1)"
# Fixed values, in their order: how lines begin that end a visible market, and words that end it in a short line without prices.
VISIBLE_END = (
    "to qualify|para se qualificar|para se classificar|team to kick off|time para dar o pontape inicial|equipe a dar o pontape inicial|aposta aumentada|ganhos aumentados|criar aposta|"
    "correct score|placar correto|both teams|ambas equipes|total goals|total de gols|goals|gols|corners|escanteios|cartoes faltas|cartoes|cards|half|intervalo|1 tempo 2 tempo|"
    "other|outro|outros|asian lines|odds asiaticas|linhas asiaticas|bet builder|marcadores|scorers|chutes|shots|estatisticas do jogador|player stats"
)
VISIBLE_END_WORDS = "qualify|qualificar|classificar|kick|pontape|score|placar|goals|gols|corners|escanteios|cards|cartoes|half|tempo|other|outro|asian|asiaticas|builder|stats|estatisticas|chutes|marcadores"
# Names of the result market in node payloads, whole and as a part, and its early-payout terms.
NODE_MARKETS, NODE_MARKET_PARTS = ("full time result", "resultado final", "match result", "resultado da partida", "vencedor da partida"), "full time result|resultado final|match result"
NODE_EARLY = "pagamento antecipado|early payout|early pay out"
DRAW = ("x", "draw", "tie", "empate")


def lines(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Trimmed lines of each page that aren't blank, numbered."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\n+"), lambda x: F.trim(x)), lambda x: x != "")
    return pages.select(*(c for c in pages.columns if c != text), F.posexplode(parts).alias("pos", "line"))


def listing_events(pages: DataFrame, year: int, key: str = "page_id") -> DataFrame:
    """Events of a league page: a date header, then a clock, home and away on lines of their own.

    ``pages``: key, text and allowed_date_keys.  The year of a header is that of
    the allowed day of its month and day, else ``year``.  Clocks are UTC-3.
    """
    by = Window.partitionBy(key).orderBy("pos")
    rows = lines(pages, key)
    plain = normalize_name(F.col("line"))
    names = "|".join(MONTHS)
    day = F.regexp_extract(plain, rf"\b(\d{{1,2}})\s+({names})\b", 1)
    month = F.element_at(F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv)), F.nullif(F.regexp_extract(plain, rf"\b(\d{{1,2}})\s+({names})\b", 2), F.lit("")))
    tail = F.concat_ws("-", F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    allowed = F.get(F.filter("allowed_date_keys", lambda k: F.substring(k, 6, 5) == tail), 0)
    header = fold(F.col("line")).rlike(rf"\b(?:{DAYS})\b.*\b\d{{1,2}}\s+(?:{names})\b")
    date = F.when(day != "", F.coalesce(allowed, F.concat_ws("-", F.lit(str(year)), tail)))
    # A header that names no date closes the day before it: so a struct is carried, not the date alone.
    dated = rows.withColumn("_header", header).withColumn("_date", F.last(F.when(header, F.struct(date.alias("d"))), ignorenulls=True).over(by)["d"])
    dated = dated.withColumn("home_team", F.lead("line", 1).over(by)).withColumn("away_team", F.lead("line", 2).over(by))
    letters = lambda c: F.col(c).rlike(r"[A-Za-zÀ-ɏ]") & ~F.col(c).rlike(CLOCK) & ~F.col(c).rlike(PRICE)
    found = dated.filter(~F.col("_header") & F.col("_date").isNotNull() & F.col("line").rlike(CLOCK) & letters("home_team") & letters("away_team"))
    starts = F.to_timestamp(F.concat_ws(" ", F.col("_date"), F.lpad(F.col("line"), 5, "0"))) + F.make_interval(hours=F.lit(3))
    event = found.select(key, F.col("_date").alias("date_key"), "home_team", "away_team", starts.alias("starts_at"), F.concat_ws(":", F.col("_date"), normalize_name(F.col("home_team")), normalize_name(F.col("away_team"))).alias("event_key"))
    return event.dropDuplicates([key, "event_key", "starts_at"])


def result_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Home, draw and away prices of each full-time result block: a line 1, X or 2 and a price on the next."""
    by = Window.partitionBy(key).orderBy("pos")
    rows = lines(pages, key).withColumn("_plain", fold(F.col("line")))
    start = F.col("_plain").rlike(RESULT_BLOCK)
    rows = rows.withColumn("_block", F.count_if(start).over(by)).filter("_block > 0").withColumn("_next", F.lead("line").over(by))
    in_block = Window.partitionBy(key, "_block").orderBy("pos")
    rows = rows.withColumn("_nth", F.row_number().over(in_block))
    rows = rows.withColumn("_ended", F.coalesce(F.max((F.col("_nth") > 3) & F.col("_plain").rlike(RESULT_END)).over(in_block), F.lit(False))).filter("NOT _ended")
    rows = rows.withColumn("_last", F.row_number().over(Window.partitionBy(key, "_block").orderBy(F.col("pos").desc())) == 1)
    price = F.regexp_replace("_next", ",", ".").try_cast("double")
    good = ~F.col("_last") & F.col("_next").rlike(PRICE) & price.between(1.01, 1000)
    of = lambda label: F.max_by(F.when(good & (F.upper("line") == label), price), F.when(good & (F.upper("line") == label), F.col("pos")))
    got = rows.groupBy(key, "_block").agg(of("1").alias("home"), of("X").alias("draw"), of("2").alias("away"), F.bool_or(normalize_for_matching(F.col("line")).contains("pagamento antecipado")).alias("_early"))
    good_rows = got.filter("home IS NOT NULL AND draw IS NOT NULL AND away IS NOT NULL")
    return good_rows.select(key, F.col("_block").alias("block"), F.when(F.col("_early"), "COM_PA").otherwise("SEM_PA").alias("pa_category"), F.when(F.col("_early"), 0.99).otherwise(1.0).alias("confidence"), "home", "draw", "away")


def visible_markets(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Per category the best block of a page's visible full-time result markets: its first three price rows are home, draw and away."""
    by = Window.partitionBy(key).orderBy("pos")
    rows = lines(pages, key).withColumn("_plain", normalize_price_text(F.col("line")))
    plain = F.col("_plain")
    header = plain.rlike("full time result|resultado final")
    end = plain.rlike(rf"^(?:{VISIBLE_END})\b") | (plain.rlike(r"^[a-z0-9 ]{3,70}$") & plain.rlike(rf"\b(?:{VISIBLE_END_WORDS})\b"))
    rows = rows.withColumn("_mark", F.when(header, True).when(end, False)).withColumn("_in", F.last("_mark", ignorenulls=True).over(by)).withColumn("_block", F.count_if(header).over(by)).filter("_in")
    block = Window.partitionBy(key, "_block").orderBy("pos")
    token = F.regexp_extract("line", r"\b([1-9]\d{0,2}[.,]\d{2,3})\b", 1)
    label = F.trim(F.replace(F.col("line"), token, F.lit("")))
    before = F.last(F.when((token == "") & ~header, F.col("line")), ignorenulls=True).over(block.rowsBetween(-4, -1))
    priced = rows.withColumn("_token", token).withColumn("label", F.when(label != "", label).otherwise(before)).filter((F.col("_token") != "") & ~header)
    priced = priced.withColumn("price", F.regexp_replace("_token", ",", ".").cast("double")).withColumn("_k", F.row_number().over(block))
    texts = rows.groupBy(key, "_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_plain"))), lambda r: r["_plain"]), " ").alias("_text"))
    three = priced.filter("_k <= 3").groupBy(key, "_block").agg(F.array_sort(F.collect_list(F.struct("_k", "label", "price"))).alias("rows")).filter(F.size("rows") == 3)
    early = F.col("_text").rlike("pagamento antecipado|early pay ?out")
    quality = 5 + F.when(early, 1).otherwise(0) + F.when(F.col("_text").rlike("enhanced prices|precos ajustados"), 1).otherwise(0) + F.when(~F.col("_text").rlike("to qualify|para se classificar"), 1).otherwise(0)
    judged = three.join(texts, [key, "_block"]).withColumn("pa_category", F.when(early, "COM_PA").otherwise("SEM_PA")).withColumn("quality", quality)
    best = judged.withColumn("_r", F.row_number().over(Window.partitionBy(key, "pa_category").orderBy(F.col("quality").desc(), "_block"))).filter("_r = 1")
    price = lambda k: F.col("rows")[k]["price"]
    return best.select(key, "pa_category", "quality", price(0).alias("home"), price(1).alias("draw"), price(2).alias("away"), F.col("rows.label").alias("labels"))


def nodes(payloads: DataFrame, column: str = "value", key: str = "page_id") -> DataFrame:
    """Nodes of ``TYPE;K=V;...|`` payloads: pos, type and attributes (without a value: ``true``)."""
    blocks = F.filter(F.transform(F.split(column, r"\|"), lambda b: F.trim(b)), lambda b: b != "")
    rows = payloads.select(key, F.posexplode(F.transform(blocks, lambda b: F.filter(F.split(b, ";"), lambda a: a != ""))).alias("pos", "fields"))
    fields = F.col("fields")
    kind = F.upper(F.regexp_replace(F.get(fields, 0), "(?i)^[^A-Z0-9]+|[^A-Z0-9]+$", ""))
    pair = lambda a: F.struct(F.trim(F.split_part(a, F.lit("="), F.lit(1))).alias("k"), F.when(F.contains(a, F.lit("=")), F.trim(F.substr(a, F.instr(a, "=") + 1))).otherwise("true").alias("v"))
    pairs = F.filter(F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), pair), lambda p: p["k"] != "")
    # Of a repeated key the last value counts.
    last = once(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.size(all_)), lambda q: q["k"] == p["k"])))
    # Out of a generator, so that conditions on them don't work them out anew.
    return rows.select(key, "pos", F.inline(F.array(F.struct(kind.alias("type"), F.map_from_entries(last).alias("attributes"))))).filter("type <> ''")


def _side(plain: Column, place: Column) -> Column:
    return F.when(plain.isin(*DRAW), "DRAW").otherwise(F.element_at(F.array(F.lit("HOME"), F.lit("DRAW"), F.lit("AWAY")), place + 1))


def node_prices(payloads: DataFrame, column: str = "value", key: str = "page_id") -> DataFrame:
    """Prices of node payloads: state runs from event to market to offers; per event and category the first complete market."""
    by = Window.partitionBy(key).orderBy("pos")
    a = lambda k: F.col("attributes")[k]
    rows = nodes(payloads, column, key)
    event = (F.col("type") == "EV") & a("NA").isNotNull()
    market = F.col("type").isin("MG", "MA") & a("NA").isNotNull()
    # An event closes the market before it.
    state = F.last(F.when(event, F.struct(F.lit("").alias("n"))).when(market, F.struct(a("NA").alias("n"))), ignorenulls=True).over(by)["n"]
    rows = rows.withColumn("event", F.coalesce(F.last(F.when(event, a("NA")), ignorenulls=True).over(by), F.lit(""))).withColumn("market", F.coalesce(state, F.lit("")))
    raw = F.coalesce(a("OD"), a("O"), a("PR"), a("SP"))
    offers = rows.filter((F.col("type") == "PA") & a("NA").isNotNull() & raw.isNotNull()).withColumn("label", a("NA"))
    plain = [normalize_price_text(F.col(c)).alias(f"_{c[0]}") for c in ("event", "market", "label")]
    offers = offers.select(key, "pos", "event", "market", "label", F.inline(F.array(F.struct(decimal_price(raw).alias("price"), *plain))))
    result = (F.col("market") == "") | F.col("_m").isin(*NODE_MARKETS) | F.col("_m").rlike(NODE_MARKET_PARTS)
    offers = offers.filter(result & F.col("price").between(1.01, 1000))
    once_each = offers.groupBy(key, "_e", "_m", "_l", "price").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"), F.min_by("event", "pos").alias("event"), F.min_by("market", "pos").alias("market"))
    grouped = once_each.groupBy(key, "_e", "_m").agg(F.min("pos").alias("first"), F.min_by("event", "pos").alias("event"), F.min_by("market", "pos").alias("market"), F.slice(F.array_sort(F.collect_list(F.struct("pos", "label", "price", "_l"))), 1, 3).alias("three")).filter(F.size("three") == 3)
    is_draw = lambda k: F.col("three")[k]["_l"].isin(*DRAW)
    t = F.col("three")
    ordered = F.when(is_draw(2) & ~is_draw(0) & ~is_draw(1), F.array(t[0], t[2], t[1])).otherwise(t)
    early = F.col("_m").rlike(NODE_EARLY)
    category = F.when(early, "COM_PA").otherwise("SEM_PA")
    kept = grouped.withColumn("three", ordered).withColumn("pa_category", category).withColumn("confidence", F.when(early, 0.99).otherwise(0.96))
    kept = kept.withColumn("_r", F.row_number().over(Window.partitionBy(key, "pa_category").orderBy("first"))).filter("_r = 1")
    flat = kept.select(key, "event", "market", "pa_category", "confidence", F.posexplode("three").alias("place", "o"))
    return flat.select(key, "event", "market", "pa_category", "confidence", _side(F.col("o._l"), F.col("place")).alias("selection"), F.col("o.label").alias("label"), F.col("o.price").alias("price"))
