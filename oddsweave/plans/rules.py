"""Queries of text and feed rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddsweave.functions import rules, text
from oddsweave.plans.catalog import query
from oddsweave.sources.tables import table

_NAMES = """names AS (SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '1X2' WHEN 1 THEN 'Resultado Final - Super Odds' WHEN 2 THEN '1x2 - Turbo odds ' || p_name WHEN 3 THEN 'Match Odds'
    WHEN 4 THEN 'Pagamento Antecipado ' || p_name WHEN 5 THEN 'PA com pagamento' WHEN 6 THEN '{"type": 0, "parameter": 2}' WHEN 7 THEN 'Copa Sub 20 ' || p_name WHEN 8 THEN 'Liga Feminina ' || p_name
    WHEN 9 THEN p_name || ' B' WHEN 10 THEN 'Olímpico ' || p_name ELSE p_name || ' vs. ' || p_type END AS name, p_size FROM part)"""
NAMES = "WITH " + _NAMES
_SPARK_NAMES = _NAMES.removeprefix("names AS (").removesuffix(")").replace("FROM part", "FROM {part}")


def _names(spark, d):
    # The braces of the JSON sample are data.
    sql = _SPARK_NAMES.replace("""'{"type": 0, "parameter": 2}'""", """'{{"type": 0, "parameter": 2}}'""")
    return spark.sql(sql, part=table(spark, d, "part"))


_FOLD = "lower(strip_accents(text))"


@query(f"SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents")
def n02_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_for_matching(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_FOLD}, '\\b({'|'.join(text.NAME_STOP_WORDS)})\\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM documents")
def n01_normalize_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("normalized"))


@query(f"SELECT doc_id, trim(regexp_replace({_FOLD}, '[^a-z0-9.,]+', ' ', 'g')) AS normalized FROM documents")
def n03_normalize_price_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_price_text(F.col("text")).alias("normalized"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


#: Tokens of documents: ages written as one, letters that stand alone glued (a mark behind each tells which), stop words gone.
_TOKENS = (
    f"""WITH p AS (SELECT doc_id, string_split(regexp_replace(trim(regexp_replace({_FOLD}, '[^a-z0-9]+', ' ', 'g')), '\\bsub\\s*(\\d{{2}})\\b', 'u\\1', 'g'), ' ') AS parts FROM documents),
    m AS (SELECT doc_id, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[a-z]$') THEN x || chr(1) ELSE x END) AS parts FROM p),
    g AS (SELECT doc_id, list_reduce(parts, lambda a, x: CASE WHEN ends_with(a, chr(1)) AND ends_with(x, chr(1)) THEN left(a, length(a) - 1) || x ELSE a || ' ' || x END) AS joined FROM m),
    t AS (SELECT doc_id, list_filter(string_split(replace(joined, chr(1), ''), ' '), lambda x: x <> '' AND x NOT IN ({_STOP})) AS tokens FROM g)"""
)


@query(_TOKENS + " SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(tokens, lambda x: length(x) > 2))), ' ') AS tokens FROM t")
def n05_significant_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(text.significant_tokens(F.col("text"))), " ").alias("tokens"))


@query(_TOKENS + " SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t")
def n04_matching_tokens(spark, d):
    tokens = text.matching_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(F.array_join(tokens, " ").cast("binary")).alias("tokens_md5"))


@query(
    NAMES
    + r""", f AS (SELECT id, trim(lower(strip_accents(name))) AS t FROM names)
    SELECT id, t IN ("""
    + ", ".join(f"'{m}'" for m in rules.MONEYLINE)
    + r""") OR regexp_matches(t, '^1x2\s*-\s*(odds aumentadas|super odds|odds turbinadas|turbo odds|boost)') AS moneyline FROM f"""
)
def a24_moneyline(spark, d):
    return _names(spark, d).select("id", rules.is_moneyline(F.col("name")).alias("moneyline"))


@query(
    NAMES
    + r""", f AS (SELECT id, trim(lower(strip_accents(name))) AS t FROM names)
    SELECT id, CASE WHEN regexp_matches(t, '"type"\s*:\s*0') AND regexp_matches(t, '"parameter"\s*:\s*2') THEN 0.95 WHEN regexp_matches(t, '(pagamento antecipado|pague antecipado|early payout|early pay out|ganha antes|cashout antecipado)') THEN 0.98
    WHEN regexp_matches(t, '\bpa\b') AND regexp_matches(t, '(antecip|payout|pague|pagamento)') THEN 0.9 ELSE 1.0 END::DOUBLE AS confidence,
    CASE WHEN (regexp_matches(t, '"type"\s*:\s*0') AND regexp_matches(t, '"parameter"\s*:\s*2')) OR regexp_matches(t, '(pagamento antecipado|pague antecipado|early payout|early pay out|ganha antes|cashout antecipado)') OR (regexp_matches(t, '\bpa\b') AND regexp_matches(t, '(antecip|payout|pague|pagamento)')) THEN 'COM_PA' ELSE 'SEM_PA' END AS category FROM f"""
)
def a25_payout_category(spark, d):
    got = _names(spark, d).select("id", rules.payout_category(F.col("name")).alias("p"))
    return got.select("id", "p.category", "p.confidence")


@query("SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'HOME' WHEN 2 THEN 'DRAW' WHEN 3 THEN 'AWAY' END AS selection FROM lineitem")
def a26_selection_of_type(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.selection_of_type(F.col("l_linenumber")).alias("selection"))


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_linestatus = 'F' THEN CASE l_returnflag WHEN 'R' THEN 'AWAY' WHEN 'A' THEN 'DRAW' ELSE 'HOME' END ELSE CASE l_returnflag WHEN 'R' THEN 'HOME' WHEN 'A' THEN 'DRAW' ELSE 'AWAY' END END AS selection, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def a27_orientation(spark, d):
    base = F.when(F.col("l_returnflag") == "R", "HOME").when(F.col("l_returnflag") == "A", "DRAW").otherwise("AWAY")
    turned = rules.oriented(base, F.when(F.col("l_linestatus") == "F", "INVERTED").otherwise("NORMAL"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus", turned.alias("selection")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id, round(CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS DOUBLE) / (p_partkey % 7 + 1) + 1 WHEN p_size % 3 = 1 THEN p_size + 0.5 ELSE 0 END, 9) AS price FROM part")
def a28_fractional(spark, d):
    size = F.col("p_size")
    shown = F.when(size % 3 == 0, F.concat_ws("/", size.cast("string"), (F.col("p_partkey") % 7 + 1).cast("string"))).when(size % 3 == 1, F.concat(size.cast("string"), F.lit(",5"))).otherwise("n/a")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(rules.decimal_price(shown), 9).alias("price"))


@query("SELECT p_partkey AS id, CAST(list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::BIGINT, c::BIGINT)::HUGEINT * 16777619) % 4294967296) AS BIGINT) AS hash FROM part")
def a29_fnv1a(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.fnv1a(F.col("p_name")).alias("hash"))


@query("SELECT p_partkey AS id, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(p_name || p_brand, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 9000000000000000) AS BIGINT) AS hash FROM part")
def a30_polynomial(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.polynomial_id(F.concat("p_name", "p_brand")).alias("hash"))


@query("SELECT page_id, TRY_CAST(left(regexp_replace(url, '\\D', '', 'g'), 15) AS BIGINT) AS first_digits, TRY_CAST(right(regexp_replace(url, '\\D', '', 'g'), 15) AS BIGINT) AS last_digits FROM pages")
def a31_digits_id(spark, d):
    return table(spark, d, "pages").select("page_id", rules.digits_id(F.col("url")).alias("first_digits"), rules.digits_id(F.col("url"), last=True).alias("last_digits"))


@query("SELECT page_id, CAST(nullif(regexp_extract(url, '/(\\d+)(?:[/?#]|$)', 1), '') AS BIGINT) AS event_id FROM pages WHERE regexp_matches(url, '/(\\d+)(?:[/?#]|$)')")
def a32_url_id(spark, d):
    return table(spark, d, "pages").filter(F.col("url").rlike(r"/(\d+)(?:[/?#]|$)")).select("page_id", rules.url_event_id(F.col("url")).alias("event_id"))


@query(NAMES + ", f AS (SELECT id, regexp_extract(name, '^(.*?)\\s+(?:-|vs\\.?|x)\\s+(.*)$', ['home', 'away'], 'i') AS m FROM names) SELECT id, nullif(trim(m.home), '') AS home, nullif(trim(m.away), '') AS away FROM f")
def a33_split_teams(spark, d):
    return _names(spark, d).select("id", rules.split_teams(F.col("name")).alias("t")).select("id", "t.home", "t.away")


@query("SELECT event_id, CAST(epoch_us(ts + INTERVAL 3 HOUR) AS BIGINT) AS utc_us FROM events")
def a34_local_time(spark, d):
    stream = table(spark, d, "stream")
    return stream.select("event_id", F.unix_micros(rules.utc_of_local(F.col("ts"), -3)).alias("utc_us"))


@query("SELECT p_partkey AS id, trim(regexp_replace(lower(strip_accents(p_name || ' / ' || p_type)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def a37_slug(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.slug(F.concat_ws(" / ", "p_name", "p_type")).alias("slug"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'INVERTED' END AS orientation FROM part")
def a38_link_orientation(spark, d):
    word = F.when(F.col("p_size") % 3 == 0, "NORMAL").when(F.col("p_size") % 3 == 1, "INVERTED").otherwise("UNKNOWN")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.link_orientation(F.to_json(F.struct(word.alias("orientation")))).alias("orientation"))


@query("""SELECT p_partkey AS id, sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') AS signature FROM part""")
def a39_signature(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), rules.signature(F.col("p_partkey"), F.col("p_name")).alias("signature"))


@query(
    NAMES
    + r""", f AS (SELECT id, p_size % 2 = 0 AS senior, trim(regexp_replace(regexp_replace(lower(strip_accents(name)), '\b(fc|cf|sc|ec|ac|ca|cd|sd|ud|club|clube|de|do|da|the)\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS t FROM names),
    r AS (SELECT id, CASE WHEN NOT senior THEN 'default' WHEN regexp_matches(t, '\b(u|sub|under)\s*(17|18|19|20|21|22|23)\b') THEN 'youth-age-category'
    WHEN regexp_matches(t, '\b(women|woman|female|feminino|feminina|femenino|femenina|feminil|fem|w)\b') THEN 'women-category'
    WHEN regexp_matches(t, '\b(youth|junior|juniors|academy|olympic|olimpico|olimpica|olimpicos|olimpicas)\b') THEN 'non-senior-category'
    WHEN regexp_matches(t, '\b(reserve|reserves|reserva|reservas|b)\b') THEN 'reserve-category' ELSE 'senior-international' END AS reason FROM f)
    SELECT id, reason IN ('default', 'senior-international') AS eligible, reason FROM r"""
)
def f05_eligibility(spark, d):
    return _names(spark, d).select("id", rules.eligibility(F.col("p_size") % 2 == 0, F.col("name")).alias("e")).select("id", "e.eligible", "e.reason")


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)/api/') OR (page_id % 4 = 0 AND regexp_matches(url, '(?i)/esportes/evento/')) THEN NULL ELSE url END AS url FROM pages")
def f09_url_hygiene(spark, d):
    slug = F.when(F.col("page_id") % 4 == 0, "bet7k").otherwise("other")
    return table(spark, d, "pages").select("page_id", rules.clean_source_url(slug, F.col("url")).alias("url"))


@query("SELECT page_id, regexp_matches(regexp_replace(url, '[?#].*$', ''), '/\\d+/?$') AS event_page FROM pages")
def f15_url_shape(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").rlike(r"/\d+/?$").alias("event_page"))
