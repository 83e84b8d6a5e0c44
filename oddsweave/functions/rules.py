"""Scalar rules of price feeds: markets, payout categories, selections, prices, ids, links, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsweave.functions.text import fold, normalize_name, once

# Names of the full-time result market.
MONEYLINE = (
    "1x2",
    "vencedor do encontro",
    "resultado final",
    "resultado da partida",
    "resultado da partida 1x2",
    "match odds",
    "match winner",
    "moneyline",
    "quem vence",
    "vencedor do encontro - super odds",
    "vencedor do encontro - odds aumentadas",
    "vencedor do encontro - odds turbinadas",
    "resultado final - super odds",
    "resultado final - odds aumentadas",
    "resultado final - odds turbinadas",
)
BOOSTED = r"^1x2\s*-\s*(odds aumentadas|super odds|odds turbinadas|turbo odds|boost)"
EARLY_PAYOUT = r"(pagamento antecipado|pague antecipado|early payout|early pay out|ganha antes|cashout antecipado)"
# Ordered reasons to reject a fixture of a competition for senior national teams.
REJECTIONS = (
    (r"\bu\s*(?:17|18|19|20|21|22|23)\b", "youth-age-category"),
    (r"\bsub\s*(?:17|18|19|20|21|22|23)\b", "youth-age-category"),
    (r"\bunder\s*(?:17|18|19|20|21|22|23)\b", "youth-age-category"),
    (r"\b(women|woman|female|feminino|feminina|femenino|femenina|feminil|fem|w)\b", "women-category"),
    (r"\b(youth|junior|juniors|academy|olympic|olimpico|olimpica|olimpicos|olimpicas)\b", "non-senior-category"),
    (r"\b(reserve|reserves|reserva|reservas|b)\b", "reserve-category"),
)
CIVIL_ZONE = "America/Bahia"


def is_moneyline(name: Column) -> Column:
    text = F.trim(fold(name))
    return text.isin(*MONEYLINE) | text.rlike(BOOSTED)


def payout_category(*parts: Column) -> Column:
    """category, confidence and reason from all texts about a market."""
    text = F.trim(fold(F.concat_ws(" ", *(F.nullif(p.cast("string"), F.lit("")) for p in parts))))
    row = lambda c, s, r: F.struct(F.lit(c).alias("category"), F.lit(s).alias("confidence"), F.lit(r).alias("reason"))
    return (
        F.when(text.rlike(r'"type"\s*:\s*0') & text.rlike(r'"parameter"\s*:\s*2'), row("COM_PA", 0.95, "offer-type-0-parameter-2"))
        .when(text.rlike(EARLY_PAYOUT), row("COM_PA", 0.98, "explicit-pa-term"))
        .when(text.rlike(r"\bpa\b") & text.rlike("(antecip|payout|pague|pagamento)"), row("COM_PA", 0.9, "pa-with-context"))
        .otherwise(row("SEM_PA", 1.0, "no-explicit-pa-term"))
    )


def selection_of_type(type_id: Column) -> Column:
    number = type_id.cast("double")
    return F.when(number == 1, "HOME").when(number == 2, "DRAW").when(number == 3, "AWAY")


def oriented(selection: Column, orientation: Column) -> Column:
    """Home and away change places under INVERTED."""
    swap = F.when(selection == "HOME", "AWAY").when(selection == "AWAY", "HOME").otherwise(selection)
    return F.when(orientation == "INVERTED", swap).otherwise(selection)


def decimal_price(text: Column) -> Column:
    """``a/b`` is a/b+1; a comma is a decimal point; what isn't a number is 0."""
    number = lambda c: F.when(F.trim(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), F.trim(c).cast("double"))
    ratio = lambda parts: number(parts[0]) / F.nullif(number(parts[1]), F.lit(0.0)) + 1
    value = lambda parts: F.when(F.size(parts) == 2, ratio(parts)).when(F.size(parts) == 1, number(parts[0]))
    return F.coalesce(once(F.split(F.trim(F.translate(text, ",", ".")), "/"), value), F.lit(0.0))


def code_units(text: Column) -> Column:
    """UTF-16 units of a text: a character beyond the basic plane has two."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    pair = lambda c: F.array(F.lit(0xD800) + F.shiftright(c - 0x10000, 10), F.lit(0xDC00) + (c - 0x10000).bitwiseAND(0x3FF))
    return F.flatten(F.transform(codes, lambda c: F.when(c > 0xFFFF, pair(c)).otherwise(F.array(c))))


def _fold_codes(text: Column, start: int, step, wide: str = "bigint") -> Column:
    return F.aggregate(code_units(text), F.lit(start).cast(wide), lambda h, c: step(h, c.cast(wide)).cast(wide))


def fnv1a(text: Column) -> Column:
    """FNV-1a over UTF-16 units, 32 bits; a product of a 32-bit hash and the prime fits in 64 bits."""
    return _fold_codes(text, 2166136261, lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))


def polynomial_id(text: Column, modulus: int = 9_000_000_000_000_000) -> Column:
    """31-polynomial of the UTF-16 units, modulo a number below 2^53."""
    return _fold_codes(text, 0, lambda h, c: F.pmod(h * F.lit(31) + c, F.lit(modulus).cast("bigint")))


def digits_id(text: Column, most: int = 15, last: bool = False) -> Column:
    """The first (or last) ``most`` digits as a number; null without digits."""
    digits = F.regexp_replace(text.cast("string"), r"\D", "")
    part = F.right(digits, F.lit(most)) if last else F.left(digits, F.lit(most))
    return F.nullif(part, F.lit("")).cast("bigint")


def url_event_id(url: Column, parameter: str = "page") -> Column:
    """The first number that is a whole path step's end; else a query parameter; else a hash."""
    step = F.regexp_extract(url, r"/(\d+)(?:[/?#]|$)", 1)
    query = F.regexp_extract(url, rf"[?&]{parameter}=(\d+)", 1)
    return F.coalesce(F.nullif(step, F.lit("")).cast("bigint"), F.nullif(query, F.lit("")).cast("bigint"), fnv1a(url))


def split_teams(name: Column) -> Column:
    """home and away from an event's name; null where there is no separator."""
    parts = F.split(name, r"(?i)\s+(?:-|vs\.?|x|·|–)\s+", 2)
    side = lambda k: F.nullif(F.trim(F.try_element_at(parts, F.lit(k))), F.lit(""))
    return F.struct(F.when(F.size(parts) == 2, side(1)).alias("home"), F.when(F.size(parts) == 2, side(2)).alias("away"))


def utc_of_local(local: Column, offset_hours: int) -> Column:
    """A timestamp without zone that a feed gives in a fixed offset, as UTC."""
    return F.to_timestamp(local) - F.make_interval(hours=F.lit(offset_hours))


def civil_date(ts: Column, zone: str = CIVIL_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def event_timing(label: Column, clock: Column, today: Column, allowed: Column) -> Column:
    """date_key and starts_at of an event page's label and clock (UTC-3); null on a day that isn't allowed.

    ``allowed``: an array of date keys.  The label is today's, tomorrow's or a day
    and month of an allowed key; any other one means the first allowed key.
    """
    text = F.trim(fold(label))
    day_month = r"^(\d{1,2})[./-](\d{1,2})$"
    part = lambda k: F.lpad(F.nullif(F.regexp_extract(text, day_month, k), F.lit("")).cast("int").cast("string"), 2, "0")
    found = F.when(text.rlike(day_month), F.get(F.filter(allowed, lambda key: F.substring(key, 6, 5) == F.concat_ws("-", part(2), part(1))), 0))
    key = F.when(text == "hoje", today.cast("string")).when(text == "amanha", F.date_add(today, 1).cast("string")).otherwise(found)
    key = F.coalesce(key, F.get(allowed, 0))
    time = F.when(clock.rlike(r"^\d{1,2}:\d{2}$"), F.lpad(clock, 5, "0"))
    starts = F.concat_ws(" ", key, time).try_cast("timestamp") + F.make_interval(hours=F.lit(3))
    return F.when(F.array_contains(allowed, key), F.struct(key.alias("date_key"), F.when(time.isNotNull(), starts).alias("starts_at")))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def relative_path(url: Column) -> Column:
    """Path and query of a link."""
    query = F.parse_url(url, F.lit("QUERY"))
    return F.concat(F.parse_url(url, F.lit("PATH")), F.when(query.isNotNull(), F.concat(F.lit("?"), query)).otherwise(""))


def link_orientation(raw: Column) -> Column:
    """The orientation kept in a link's JSON, if it is one of the two."""
    value = F.get_json_object(raw, "$.orientation")
    return F.when(value.isin("NORMAL", "INVERTED"), value)


def signature(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def eligibility(senior_only: Column, *texts: Column) -> Column:
    """eligible and reason; only competitions for senior national teams reject."""
    text = normalize_name(F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts)))
    reason = F.lit("senior-international")
    for pattern, why in reversed(REJECTIONS):
        reason = F.when(text.rlike(pattern), why).otherwise(reason)
    reason = F.when(senior_only, reason).otherwise("default")
    return F.struct(reason.isin("default", "senior-international").alias("eligible"), reason.alias("reason"))


def clean_source_url(bookmaker: Column, url: Column) -> Column:
    """Links to interfaces and to pages without a single event are no links."""
    bad = (
        url.rlike("(?i)/api/")
        | (bookmaker.isin("bet7k", "betvip") & url.rlike("(?i)/esportes/evento/"))
        | ((bookmaker == "sportybet") & url.rlike("(?i)/br/sport/football/?$"))
    )
    return F.when(~F.coalesce(bad, F.lit(False)), url)
