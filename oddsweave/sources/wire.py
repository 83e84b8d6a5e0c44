"""Binary and irregular payloads to rows: protobuf wires, columnar memory slices, JSON trees of unknown shape.

Spark partitions the payloads; each task decodes its own with a small reader.
A payload is one feed message, so what a row holds is bounded.
"""

from __future__ import annotations

import json
import lzma
import struct
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddsweave.functions.rules import polynomial_id
from oddsweave.functions.text import once
from oddsweave.operators.components import checkpointed
from oddsweave.sources.tables import spread

DEPTH, CHILD_BYTES = 8, 250_000
FIELDS = "source string, path string, field int, wire int, number double, text string"
CELLS = "source string, table string, row int, name string, value string"
FOUND = "source string, path string, node string"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while at < len(data):
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            break
    return value, at


def wire_fields(data: bytes):
    """(field, wire, number, bytes) of one level; stops where the bytes are no message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        if not 0 < number <= 10_000 or kind not in (0, 1, 2, 5):
            return
        if kind == 0:
            value, at = _varint(data, at)
            yield number, kind, float(value), None
            continue
        size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
        if at + size > len(data):
            return
        part = data[at : at + size]
        at += size
        yield number, kind, None if kind == 2 else struct.unpack("<d" if kind == 1 else "<f", part)[0], part if kind == 2 else None


def _walk(data: bytes, path: str, depth: int):
    for n, (number, kind, value, part) in enumerate(wire_fields(data)):
        here = f"{path}/{n}:{number}"
        yield here, number, kind, value, None if part is None else part.decode("utf-8", "replace")
        if part and depth < DEPTH and len(part) < CHILD_BYTES:
            yield from _walk(part, here, depth + 1)


#: So many decoded rows are held at once.
FRAME_ROWS = 1 << 16


def _decoded(frames, decode, names: list[str]):
    """Rows of payloads as frames; a payload may give any number of rows, so these are cut by rows, not by payloads."""
    rows = ((k, *r) for f in frames for k, v in zip(f["source"], f["value"]) if v is not None for r in decode(v))
    while some := list(islice(rows, FRAME_ROWS)):
        yield pd.DataFrame(some, columns=names)


def _each(df: DataFrame, key: str, column: str, decode, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return df.select(F.col(key).cast("string").alias("source"), F.col(column).alias("value")).mapInPandas(lambda frames: _decoded(frames, decode, names), schema)


def protobuf_fields(df: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """Every field of every message that may be nested in the payloads, with its path."""
    return _each(df, key, column, lambda v: _walk(bytes(v), "", 0), FIELDS)


#: Bytes that mark a slice, a table and a column; item bytes by column type.
SLICE, TABLE, COLUMN = (201, 202), (203, 204), (206, 207)
ITEM_BYTES = {0: 1, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 8, 10: 4, 12: 2, 13: 2, 14: 4, 15: 4, 16: 4, 17: 8}
FORMATS = {0: "<B", 2: "<h", 3: "<H", 4: "<i", 5: "<I", 6: "<i", 7: "<Q"}


def columnar_cells(data: bytes):
    """(table, row, column, value as text) of a columnar memory slice."""
    u16 = lambda at: struct.unpack_from("<H", data, at)[0]
    i32 = lambda at: struct.unpack_from("<i", data, at)[0]
    string = lambda at: data[at + 2 : at + 2 + u16(at)].decode("utf-8", "replace")

    def marked(at: int, pair: tuple[int, int], gap: int) -> None:
        if (data[at], data[at + gap]) != pair:
            raise ValueError(f"no {pair} at {at}")

    def value(kind: int, base: int, n: int):
        if kind == 1:
            return bool(data[base + n // 8] >> n % 8 & 1)
        at = base + n * ITEM_BYTES[kind]
        if kind == 10:
            return string(i32(at))
        return struct.unpack_from(FORMATS[kind], data, at)[0] if kind in FORMATS else None

    marked(0, SLICE, 17)
    for t in range(u16(11)):
        table = i32(18 + 4 * t)
        if not table:
            return
        marked(table, TABLE, 9)
        many = u16(table + 7)
        name = string(table + 10 + 4 * many)
        for c in range(many):
            column = i32(table + 10 + 4 * c)
            marked(column, COLUMN, 20)
            kind, base = data[column + 15], column + u16(column + 5)
            for n in range(i32(column + 11)):
                v = value(kind, base, n)
                yield name, n, string(column + 21), None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def columnar_tables(df: DataFrame, key: str = "path", column: str = "content") -> DataFrame:
    """Cells of columnar slices, plain or in LZMA; a table of one comes back by pivoting its names."""
    return _each(df, key, column, lambda v: columnar_cells(unpacked(bytes(v))), CELLS)


def table_of(cells: DataFrame, table: str, names: list[str]) -> DataFrame:
    """One decoded table, one row per source and row."""
    return cells.filter(F.col("table") == table).groupBy("source", "row").pivot("name", names).agg(F.first("value"))


def inner_json(value, depth: int = 3):
    """JSON that is kept as text inside JSON, opened up to ``depth`` levels."""
    if isinstance(value, str) and depth and value[:1] in "{[":
        try:
            return inner_json(json.loads(value), depth - 1)
        except ValueError:
            return value
    if isinstance(value, dict):
        return {k: inner_json(v, depth) for k, v in value.items()}
    return [inner_json(v, depth) for v in value] if isinstance(value, list) else value


def _search(value, needed: frozenset[str], path: str):
    if isinstance(value, dict):
        if needed <= value.keys():
            yield path, json.dumps(value, ensure_ascii=False)
        value = value.items()
    elif isinstance(value, list):
        value = enumerate(value)
    else:
        return
    for k, v in value:
        yield from _search(v, needed, f"{path}/{k}")


def json_nodes(df: DataFrame, needed: list[str], key: str = "path", column: str = "value") -> DataFrame:
    """Objects anywhere in JSON payloads that have all ``needed`` keys, as JSON, with their path; texts that are JSON are opened."""
    keys = frozenset(needed)

    def decode(v):
        try:
            return _search(inner_json(json.loads(v)), keys, "")
        except ValueError:
            return ()

    return _each(df, key, column, decode, FOUND)


def three_runners(rows: DataFrame) -> DataFrame:
    """A feed's row with three price columns as one row per selection; its clock is UTC+1."""
    starts = F.to_timestamp("dg") - F.make_interval(hours=F.lit(1))
    flat = rows.select("ceId", starts.alias("starts_at"), F.col("cthName").alias("home_team"), F.col("ctaName").alias("away_team"), F.expr("stack(3, 'HOME', cast(wldHm as double), 'DRAW', cast(wldDm as double), 'AWAY', cast(wldAm as double)) AS (selection, price)"))
    return flat.filter("price > 0")


def delta_market(rows: DataFrame) -> DataFrame:
    """Delta events as a market of three rows, under hashes of their texts; early payout as the event's configuration says.

    Events without a name, a time or one of three prices above 0 give none; of
    events of one id the last (by column ``seen``, where there is one) counts.
    """
    o = "odds.full_time"
    odd = lambda k: F.col(f"{o}.{k}")
    priced = [F.coalesce((odd(k)["value"].cast("double") > 0) & (odd(k)["value"].cast("double") < float("inf")), F.lit(False)) for k in ("home", "draw", "away")]
    named = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("_id", "home_team", "away_team")]
    starts = F.coalesce(*(F.col(c).try_cast("timestamp") for c in ("start_date", "date") if c in rows.columns))
    good = rows.withColumn("starts_at", starts).filter(starts.isNotNull())
    for x in (*priced, *named):
        good = good.filter(x)
    if "seen" in rows.columns:
        last = good.groupBy("_id").agg(F.max_by(F.struct(*good.columns), "seen").alias("r"))
        good = last.select("r.*")
    sides = F.array(*(F.struct(F.lit(side).alias("selection"), odd(k)["value"].cast("double").alias("price"), F.coalesce(odd(k)["enable"], F.lit(True)).alias("enabled"), polynomial_id(F.concat("_id", F.lit(f":{k}"))).cast("bigint").alias("source_odd_id")) for side, k in (("HOME", "home"), ("DRAW", "draw"), ("AWAY", "away"))))
    flat = good.select(
        polynomial_id(F.col("_id")).cast("bigint").alias("event_id"),
        "starts_at",
        "home_team",
        "away_team",
        F.when(F.coalesce("market_config.has_early_payout", F.lit(False)), "COM_PA").otherwise("SEM_PA").alias("pa_category"),
        F.inline(sides),
    )
    return flat.filter("enabled").drop("enabled")


def request_path(payload: Column) -> Column:
    """A request's body as the text that its address carries."""
    return F.base64(F.encode(F.to_json(payload), "UTF-8"))


def tree_leaves(rows: DataFrame, node: str, children: str) -> DataFrame:
    """All nodes of nested groups, as deep as the column's type goes, one row each: an explode per level that still has children."""
    field = rows.schema[node].dataType
    out, current, kind = None, rows.select(F.explode(node).alias("n")), field.elementType
    while True:
        flat = current.select(*(F.col(f"n.{f.name}").alias(f.name) for f in kind.fields if f.name != children))
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
        nested = next((f for f in kind.fields if f.name == children), None)
        if nested is None:
            return out
        current, kind = current.select(F.explode(f"n.{children}").alias("n")), nested.dataType.elementType


TREE = "source string, path string, parent string, depth int, node string, parent_node string"


def _roots(value, keys: tuple[str, ...], path: str = ""):
    """What lies under the keys, through the arrays on the way."""
    if isinstance(value, list):
        for n, item in enumerate(value):
            yield from _roots(item, keys, f"{path}/{n}")
    elif not keys:
        yield path, value
    elif isinstance(value, dict):
        yield from _roots(value.get(keys[0]), keys[1:], f"{path}/{keys[0]}")


def _nodes(value, roots: tuple[str, ...], children: str):
    waiting = [(path, None, 1, node, None) for path, node in _roots(value, roots)]
    while waiting:
        path, parent, depth, node, above = waiting.pop()
        if not isinstance(node, dict):
            continue
        below = node.get(children)
        own = json.dumps({k: v for k, v in node.items() if k != children}, ensure_ascii=False)
        yield path, parent, depth, own, above
        for n, child in enumerate(below if isinstance(below, list) else ()):
            waiting.append((f"{path}/{children}/{n}", path, depth + 1, child, own))


def tree_nodes(df: DataFrame, children: str, roots: tuple[str, ...] = (), key: str = "path", column: str = "value") -> DataFrame:
    """Every node of the trees in JSON payloads, however deep, with its path, its parent's path (null at a root), its depth, its JSON and its parent's without children.

    ``roots``: keys that lead to the roots, through arrays.  A payload that is
    no JSON, or deeper than a JSON parser goes (some thousand levels), has none.
    """

    def decode(v):
        try:
            return list(_nodes(json.loads(v), roots, children))
        except (ValueError, RecursionError):
            return ()

    return _each(df, key, column, decode, TREE)


def season_fixtures(df: DataFrame, sport: str = "Futebol", key: str = "path", column: str = "value") -> DataFrame:
    """Fixtures of all seasons of a sport, however deep a season lies in others: source, season and league names, and the fixture as JSON."""
    one = df.select(F.col(key).alias("_key"), F.posexplode(F.from_json(F.get_json_object(column, "$.data"), "array<string>")).alias("_n", "_sport"))
    own = one.filter(F.get_json_object("_sport", "$.stN") == sport).select(F.concat_ws("#", F.col("_key").cast("string"), "_n").alias("_key"), "_sport")
    seasons = tree_nodes(own, "sns", ("cs", "sns"), "_key", "_sport")
    name = F.concat_ws(" ", *(F.nullif(F.get_json_object("node", f"$.{k}"), F.lit("")) for k in ("pseaN", "seaN")))
    return seasons.select(
        F.split_part("source", F.lit("#"), F.lit(1)).alias("source"),
        F.get_json_object("node", "$.sId").cast("bigint").alias("season_id"),
        name.alias("season_name"),
        F.get_json_object("node", "$.lName").alias("league_name"),
        F.explode(F.from_json(F.get_json_object("node", "$.fs"), "array<string>")).alias("value"),
    )


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def _step(path: Column, part: int) -> Column:
    """Of a path's last step its place (1) or its field (2)."""
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit(":"), F.lit(part)).try_cast("int")


def message_events(fields: DataFrame) -> DataFrame:
    """Events with their odds, rebuilt from the flat fields of ``protobuf_fields``: one row each, ``e`` as ``feeds.GROUPED_ODDS`` reads it.

    A message is what shares a parent path; of a field that repeats the first
    counts.  An event is a message whose first field 1 is a match (with id, time
    and two named teams) and whose fields 2 are odds; without odds it is none.
    """
    own = fields.filter(F.col("field").isin(1, 2, 3, 4, 5, 6, 7, 10, 13, 14, 16, 18)).select("source", "path", _parent(F.col("path")).alias("parent"), "field", "number", F.when(F.col("wire") == 2, F.col("text")).alias("text"), _step(F.col("path"), 1).alias("place"))
    own = spread(own, "source")  # all that follows is grouped by it, so nothing moves again

    def first(k: int, what: str) -> Column:
        return F.min_by(F.struct(what), F.when(F.col("field") == k, F.col("place")))[what]

    # The numbers of a team's, a match's and an odd's fields.
    messages = own.groupBy("source", "parent").agg(
        first(1, "number").alias("n1"), first(2, "number").alias("n2"), first(7, "number").alias("n7"), first(10, "number").alias("n10"),
        first(1, "text").alias("t1"), first(3, "text").alias("t3"), first(4, "text").alias("t4"), first(5, "text").alias("t5"), first(6, "text").alias("t6"),
        first(13, "text").alias("t13"), first(14, "text").alias("t14"), first(18, "text").alias("t18"),
        first(1, "path").alias("p1"), first(3, "path").alias("p3"), first(16, "path").alias("p16"),
    )
    odd = F.struct(_step(F.col("parent"), 1).alias("place"), F.col("t1").alias("id"), F.col("t5").alias("name"), F.col("t6").alias("shortName"), F.col("n7").cast("int").alias("side"), F.col("n10").alias("price"), F.col("t14").alias("marketName"), F.col("t18").alias("groupName"))
    is_odd = F.expr("t1 <> '' AND n2 IS NOT NULL AND n10 IS NOT NULL") & (_step(F.col("parent"), 2) == 2)
    match = F.struct(F.col("n1").cast("bigint").alias("id"), F.col("t13").alias("startsAt"), F.col("p16").alias("teams"))
    gathered = lambda when, value: F.collect_list(F.when(when, F.struct(F.col("parent").alias("at"), value.alias("value"))))
    # As many as one payload holds.
    whole = messages.groupBy("source").agg(
        F.map_from_entries(gathered(F.coalesce("t3", "t4") != "", F.coalesce("t3", "t4"))).alias("names"),
        F.map_from_entries(gathered(F.expr("p1 IS NOT NULL AND p3 IS NOT NULL"), F.struct("p1", "p3"))).alias("teams"),
        F.map_from_entries(gathered(F.expr("n1 IS NOT NULL AND n1 <> 0 AND t13 <> '' AND p16 IS NOT NULL"), match)).alias("matches"),
        gathered(F.col("p1").isNotNull(), F.col("p1")).alias("groups"),
        F.collect_list(F.when(is_odd, F.struct(_parent(F.col("parent")).alias("at"), odd.alias("value")))).alias("odds"),
    )
    found = F.filter("groups", lambda g: F.map_contains_key("matches", g["value"]))
    events = whole.select("source", "names", "teams", "matches", "odds", F.explode(found).alias("_group"))
    events = events.withColumn("_match", F.col("matches")[F.col("_group.value")]).withColumn("_teams", F.col("teams")[F.col("_match.teams")])
    mine = F.transform(F.filter("odds", lambda o: o["at"] == F.col("_group.at")), lambda o: o["value"])
    events = events.select("source", F.col("_match.id").alias("id"), F.col("_match.startsAt").alias("startsAt"), F.col("names")[F.col("_teams.p1")].alias("homeTeam"), F.col("names")[F.col("_teams.p3")].alias("awayTeam"), F.array_sort(mine).alias("odds"))
    events = events.filter((F.size("odds") > 0) & F.col("homeTeam").isNotNull() & F.col("awayTeam").isNotNull())
    return events.select("source", F.struct("id", "startsAt", "homeTeam", "awayTeam", F.lit(None).cast("string").alias("tournamentName"), "odds").alias("e"))


def unpacked(data: bytes) -> bytes:
    """A slice as it is, or out of its LZMA envelope."""
    return data if data[:1] == bytes(SLICE[:1]) else lzma.decompress(data)


SLICE_COLUMNS = ("id", "value", "dec", "key_id", "key", "node_id", "parent_node_id", "dictionary_id", "odd_map_id", "market_type_id", "is_active", "is_displayed", "start_date", "participant_home_dictionary_id", "participant_away_dictionary_id")


def slice_events(cells: DataFrame, feed: str = "feed") -> DataFrame:
    """Events with markets and results, joined from the tables of decoded slices: one row each, ``e`` as ``feeds.DECODED_RESULTS`` reads it.

    ``cells`` (of ``columnar_tables``) with a column ``feed``: slices of one feed
    share their dictionary, odd map, keys and structure; of rows of one id the
    last, by slice and row, counts.  Prices are thousandths by the odd map.  Sides of joins all grow with
    the slices, and a plan's size says little of what is decoded: none is broadcast.
    """

    # Decoded once: what follows reads the rows of one table or another a dozen times.
    tables = cells.filter(F.col("name").isin(*SLICE_COLUMNS)).groupBy(feed, "source", "row", "table")
    tables = checkpointed(tables.agg(*(F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in SLICE_COLUMNS)))

    def rows(name: str, *columns: str) -> DataFrame:
        return tables.filter(F.col("table") == name).select(feed, "source", "row", *columns)

    def lookup(name: str, key: str, value: str, as_key: str, as_value: str) -> DataFrame:
        last = rows(name, key, value).filter(F.col(key).isNotNull()).groupBy(feed, F.col(key).alias(as_key)).agg(F.max_by(F.struct(value), F.struct("source", "row"))[value].alias(as_value))
        return last

    def named(df: DataFrame, key: str, value: str) -> DataFrame:
        return df.join(lookup("DictionaryEntry", "id", "value", key, value).hint("merge"), [feed, key], "left")

    shown = lambda df: df.filter("is_active IN ('true', '1') AND is_displayed IN ('true', '1')")
    price = F.col("_dec").cast("double") / 1000
    results = rows("Result", "parent_node_id", "node_id", "dictionary_id", "odd_map_id").dropna(subset=["parent_node_id", "node_id", "dictionary_id", "odd_map_id"])
    results = named(results, "dictionary_id", "_name").join(lookup("OddMap", "id", "dec", "odd_map_id", "_dec").hint("merge"), [feed, "odd_map_id"], "left")
    result = F.struct("source", "row", F.col("node_id").cast("bigint").alias("id"), F.coalesce("_name", F.lit("")).alias("name"), price.alias("price"))
    bare = lambda c: F.transform(F.array_sort(c), lambda x: x.dropFields("source", "row"))
    by_market = results.groupBy(feed, F.col("parent_node_id").alias("node_id")).agg(bare(F.collect_list(result)).alias("results"))  # a market's results
    values = rows("AdditionalValue", "node_id", "key_id", "dictionary_id").dropna(subset=["node_id", "key_id", "dictionary_id"])
    values = named(values, "dictionary_id", "_value").join(lookup("AdditionalValueKey", "key_id", "key", "key_id", "_key").hint("merge"), [feed, "key_id"], "left")
    value = F.struct("source", "row", F.coalesce("_key", "key_id").alias("key"), F.coalesce("_value", F.lit("")).alias("value"))
    by_node = values.groupBy(feed, "node_id").agg(bare(F.collect_list(value)).alias("additional"))
    markets = shown(rows("Market", "node_id", "parent_node_id", "market_type_id", "dictionary_id", "is_active", "is_displayed")).dropna(subset=["node_id", "market_type_id", "dictionary_id"])
    markets = named(markets, "dictionary_id", "_name").join(by_market.hint("merge"), [feed, "node_id"], "left").join(by_node.hint("merge"), [feed, "node_id"], "left")
    market = F.struct("source", "row", F.col("node_id").cast("bigint").alias("id"), F.coalesce("_name", F.lit("")).alias("name"), "additional", F.coalesce("results", F.array().cast("array<struct<id:bigint,name:string,price:double>>")).alias("results"))
    by_event = markets.groupBy(feed, F.col("parent_node_id").alias("node_id")).agg(bare(F.collect_list(market)).alias("markets"))
    events = shown(rows("Event", "node_id", "start_date", "is_active", "is_displayed", "participant_home_dictionary_id", "participant_away_dictionary_id", "parent_node_id")).dropna(subset=["node_id", "start_date"])
    events = named(named(events, "participant_home_dictionary_id", "homeTeam"), "participant_away_dictionary_id", "awayTeam").filter("homeTeam <> '' AND awayTeam <> ''")
    parents = named(lookup("Structure", "node_id", "dictionary_id", "parent_node_id", "dictionary_id"), "dictionary_id", "leagueName")
    events = events.join(parents.drop("dictionary_id").hint("merge"), [feed, "parent_node_id"], "left").join(by_event.hint("merge"), [feed, "node_id"])
    starts = F.date_format(F.timestamp_seconds(F.col("start_date").cast("bigint")), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return events.select(feed, F.struct(F.col("node_id").cast("bigint").alias("id"), F.lit(None).cast("string").alias("name"), starts.alias("startsAt"), "leagueName", "homeTeam", "awayTeam", "markets").alias("e"))


def opened(value: Column, depth: int = 3) -> Column:
    """A variant out of the JSON texts that it stands in, up to ``depth`` deep."""
    for _ in range(depth):
        value = once(value, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_parse_json(F.try_variant_get(v, "$", "string"))).otherwise(v))
    return value


def path_items(df: DataFrame, levels: list[tuple[str, dict[str, str]]], key: str = "path", column: str = "value") -> DataFrame:
    """Items at the end of a way through arrays and objects of JSON payloads, all on the JVM.

    ``levels``: the path that leads on from each item, and the fields (name and
    path) of the items there that what lies in them carries along as texts.  An array or
    object at a key is taken item by item, JSON kept as text is opened.  Gives
    source, those fields, ``order`` (places on the way, comparable in a source)
    and ``value``; malformed payloads and missing keys give no rows.
    """
    current = df.select(F.col(key).cast("string").alias("source"), F.array().cast("array<int>").alias("order"), opened(F.try_parse_json(F.col(column).cast("string"))).alias("_v"))
    carried: list[str] = []
    for name, fields in levels:
        below = opened(F.try_variant_get("_v", name, "variant"))
        items = once(below, lambda b: F.coalesce(F.try_variant_get(b, "$", "array<variant>"), F.map_values(F.try_variant_get(b, "$", "map<string,variant>"))))
        step = current.select("source", *carried, "order", F.posexplode(items).alias("_n", "_v"))
        new = [F.try_variant_get("_v", path, "string").alias(c) for c, path in fields.items()]
        current = step.select("source", *carried, F.concat("order", F.array("_n")).alias("order"), opened(F.col("_v")).alias("_v"), *new)
        carried += fields
    return current.select("source", *carried, "order", F.to_json("_v").alias("value"))


def one_per_id(items: DataFrame, item: str, order: tuple[str, ...] = ("source", "order"), last: bool = True) -> DataFrame:
    """Of rows that share an id the last (or first) by ``order``; rows without an id go.  An aggregation, so a common id is combined before it is shuffled."""
    pick = F.max_by if last else F.min_by
    kept = items.filter(F.col(item).isNotNull()).groupBy(F.col(item).alias("_id")).agg(pick(F.struct(*items.columns), F.struct(*order)).alias("r"))
    return kept.select("r.*")


def fixture_candidates(df: DataFrame, key: str = "path", column: str = "value") -> DataFrame:
    """Objects anywhere in JSON payloads that look like fixtures: an id, a start as text, and markets, participants or a name that is an object; with path and id."""
    found = json_nodes(df, ["id", "startDate"], key, column).withColumn("_v", F.parse_json("node"))
    kind = lambda c: F.schema_of_variant(F.try_variant_get("_v", f"$.{c}", "variant"))
    is_ = lambda c, *starts: F.coalesce(F.greatest(*(kind(c).startswith(x) for x in starts)) if len(starts) > 1 else kind(c).startswith(starts[0]), F.lit(False))
    like = is_("id", "STRING", "BIGINT") & is_("startDate", "STRING") & (is_("optionMarkets", "ARRAY") | is_("participants", "ARRAY") | is_("name", "OBJECT"))
    return found.filter(like).select("source", "path", F.try_variant_get("_v", "$.id", "string").alias("id"), F.col("node").alias("value"))
