"""Payloads of queries, built from the table of parts: JSON by templates, wire messages and columnar slices by small encoders.

In a template ``#1`` to ``#3`` are the three prices (``#M1``: in thousandths) as
numbers, ``@1`` to ``@3`` as texts, ``@K`` the key, ``@H`` and ``@A`` the teams.
Nothing here registers a query, so that workers import no more than this.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.sources import wire
from oddsweave.sources.tables import spread, table

#: What stands for a token, in Spark and DuckDB alike; longer tokens come first.
_TOKENS = {
    **{f"@M{k}": f"CAST(({k} * 10 + p_size) * 100 AS {{text}})" for k in (1, 2, 3)},
    **{f"@{k}": f"concat(CAST(CAST(floor(({k} * 10 + p_size) / 10) AS BIGINT) AS {{text}}), '.', CAST((({k} * 10 + p_size) % 10) AS {{text}}))" for k in (1, 2, 3)},
    "@K": "CAST(p_partkey AS {text})",
    "@H": "split_part(p_name, ' ', 1)",
    "@A": "concat(split_part(p_name, ' ', 2), 'ense')",
}


def _texts(templates: list[dict]) -> list[str]:
    out = []
    for t in templates:
        text = json.dumps(t, ensure_ascii=False)
        for k in ("M1", "M2", "M3", "1", "2", "3", "K"):
            text = text.replace(f'"#{k}"', f"@{k}")
        out.append(text)
    return out


def parts(spark, d, *more: str) -> DataFrame:
    """What payloads are made of (and ``more`` columns); dealt out before they are, as a part is a few bytes and its payload some hundred."""
    return spread(table(spark, d, "part").select("p_partkey", "p_name", "p_size", *more), "p_partkey")


def payloads(spark, d, templates: list[dict]) -> DataFrame:
    """One payload per part, as ``value``; the part's key is ``key``.

    All tokens are filled in one pass over the text.
    """
    texts = _texts(templates)
    used = [token for token in _TOKENS if any(token in t for t in texts)]
    formats = [t.replace("%", "%%") for t in texts]
    for n, token in enumerate(used, 1):
        formats = [f.replace(token, f"%{n}$s") for f in formats]
    values = {token: F.expr(_TOKENS[token].format(text="STRING")) for token in used}
    if {"@H", "@A"} <= values.keys():  # a token in a name counts, too
        values["@H"] = F.replace(values["@H"], F.lit("@A"), values["@A"])
    template = F.element_at(F.array(*map(F.lit, formats)), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    whole = F.col("p_partkey").isNotNull() & F.col("p_name").isNotNull() & F.col("p_size").isNotNull()
    value = F.when(whole, F.call_function("format_string", template, *values.values()))
    return parts(spark, d).select(F.col("p_partkey").alias("key"), value.alias("value"))


def rule_sql(templates: list[dict], rules: str, result: str = "SELECT CAST(k AS VARCHAR) AS event_id, selection, round(price, 6) AS price, pa_category, CAST(CASE WHEN pa_category = 'COM_PA' THEN early ELSE 1.0 END AS DOUBLE) AS confidence_score, odd_id AS source_odd_id FROM r WHERE selection IS NOT NULL AND price > 0") -> str:
    """``rules`` are common table expressions from ``p`` (k, home, away, e) to ``r``; ``norm`` is the feeds' normal form."""
    value = "j"
    for token, sql in _TOKENS.items():
        value = f"replace({value}, '{token}', {sql.format(text='VARCHAR')})"
    texts = ", ".join("({}, '{}')".format(n, t.replace("'", "''")) for n, t in enumerate(_texts(templates)))
    head = f"""WITH t(v, j) AS (VALUES {texts}),
p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS home, concat(split_part(p_name, ' ', 2), 'ense') AS away, CAST({value} AS JSON) AS e FROM part JOIN t ON t.v = p_partkey % {len(templates)}),
"""
    out = head + rules.strip() + "\n" + result
    while "norm(" in out:  # the innermost first
        at = out.rindex("norm(")
        end, depth = at + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(out[end], 0)
            end += 1
        out = f"{out[:at]}trim(regexp_replace(lower(strip_accents(coalesce({out[at + 5 : end - 1]}, ''))), '[^a-z0-9]+', ' ', 'g')){out[end:]}"
    return out


def binary(spark, d, encode):
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"path": f["p_partkey"].astype(str), "content": [encode(int(k), *n.split(" ", 1), int(s)) for k, n, s in zip(f["p_partkey"], f["p_name"], f["p_size"])]})

    return parts(spark, d).mapInPandas(run, "path string, content binary")


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields: tuple) -> bytes:
    """A wire message: whole numbers as varints, floats as doubles, texts and messages by length."""
    out = b""
    for k, v in fields:
        if isinstance(v, int):
            out += _varint(k << 3) + _varint(v)
        elif isinstance(v, float):
            out += _varint(k << 3 | 1) + struct.pack("<d", v)
        else:
            raw = v.encode() if isinstance(v, str) else v
            out += _varint(k << 3 | 2) + _varint(len(raw)) + raw
    return out


def message_of_part(key: int, home: str, away: str, size: int) -> bytes:
    team = lambda n, *name: message((1, n), *name)
    teams = message((1, team(1, (3, home))), (2, "x"), (3, team(2, (4, away))))
    match = message((1, key), (9, 3), (10, 77), (13, "2026-08-05T19:00:00Z"), (16, teams))
    early = ((5, "Pagamento Antecipado"),) if key % 2 == 0 else ()
    odds = [message((1, f"{key}{k}"), (2, key), *early, (6, short), (10, k + size / 10), (14, "Vencedor"), (18, "Resultado")) for k, short in ((1, "1"), (2, "X"), (3, "2"))]
    odds.append(message((1, f"{key}9"), (2, key), (6, "1"), (10, 9.5), (14, "Vencedor do 1o tempo"), (18, "Resultado")))
    odds.append(message((1, f"{key}8"), (2, key), (6, "1"), (14, "Vencedor"), (18, "Resultado")))  # no price
    group = message((1, match), *((2, o) for o in odds))
    empty = message((1, match))  # no odds
    return message((1, "envelope"), (7, message((2, message((4, group), (4, empty))))))


def slice_bytes(tables: dict[str, dict[str, tuple[int, list]]]) -> bytes:
    """A columnar slice: tables of columns of a type (1 bits, 4 whole numbers, 10 texts)."""
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    out = bytearray(18 + 4 * len(tables))
    out[0], out[17] = wire.SLICE
    struct.pack_into("<H", out, 11, len(tables))
    for n, (name, columns) in enumerate(tables.items()):
        table_at = len(out)
        struct.pack_into("<i", out, 18 + 4 * n, table_at)
        head = bytearray(10 + 4 * len(columns))
        head[0], head[9] = wire.TABLE
        struct.pack_into("<H", head, 7, len(columns))
        out += head + text(name)
        for c, (column, (kind, values)) in enumerate(columns.items()):
            at = len(out)
            struct.pack_into("<i", out, table_at + 10 + 4 * c, at)
            own = bytearray(21) + text(column)
            own[0], own[20] = wire.COLUMN
            own[15] = kind
            struct.pack_into("<H", own, 5, len(own))
            struct.pack_into("<i", own, 11, len(values))
            if kind == 1:
                items = bytearray((len(values) + 7) // 8)
                for k, v in enumerate(values):
                    items[k // 8] |= v << k % 8
            elif kind == 4:
                items = b"".join(struct.pack("<i", v) for v in values)
            else:
                base, items, strings = at + len(own) + 4 * len(values), b"", b""
                for v in values:
                    items += struct.pack("<i", base + len(strings))
                    strings += text(v)
                items += strings
            out += own + items
    return bytes(out)


def slice_of_part(key: int, home: str, away: str, size: int) -> bytes:
    words = [home, away, "Resultado Final", "Empate", "Liga", "Total", "antecipado", "velha"]
    results = [(1, 1, 1), (2, 4, 2), (3, 2, 3)]
    tables = {
        # The dictionary names key 3 twice; the last counts.
        "DictionaryEntry": {"id": (4, [3, *range(1, len(words) + 1)]), "value": (10, ["falsa", *words])},
        "OddMap": {"id": (4, [1, 2, 3, 9]), "dec": (4, [1000 + size * 100, 2000 + size * 100, 3000 + size * 100, 5])},
        "Structure": {"node_id": (4, [50]), "dictionary_id": (4, [5])},
        "Event": {"node_id": (4, [key, key + 900_000]), "start_date": (4, [1786042800] * 2), "is_active": (1, [1, 1]), "is_displayed": (1, [1, 0]), "participant_home_dictionary_id": (4, [1, 1]), "participant_away_dictionary_id": (4, [2, 2]), "parent_node_id": (4, [50, 50])},
        "Market": {"node_id": (4, [70, 71, 72]), "parent_node_id": (4, [key, key, key]), "market_type_id": (4, [1, 1, 1]), "dictionary_id": (4, [3, 6, 3]), "is_active": (1, [1, 1, 0]), "is_displayed": (1, [1, 1, 1])},
        "Result": {"parent_node_id": (4, [m for m in (70, 71, 72) for _ in results]), "node_id": (4, [m * 10 + r[0] for m in (70, 71, 72) for r in results]), "dictionary_id": (4, [r[1] for _ in range(3) for r in results]), "odd_map_id": (4, [r[2] for _ in range(3) for r in results])},
        "AdditionalValueKey": {"key_id": (4, [4]), "key": (10, ["pagamento"])},
        "AdditionalValue": {"node_id": (4, [70 if key % 2 == 0 else 71]), "key_id": (4, [4]), "dictionary_id": (4, [7])},
    }
    plain = slice_bytes(tables)
    # A small window: the default one takes longer to set up than all the rest.
    small = [{"id": wire.lzma.FILTER_LZMA1, "preset": 0, "dict_size": 1 << 16}]
    return wire.lzma.compress(plain, format=wire.lzma.FORMAT_ALONE, filters=small) if key % 3 == 0 else plain
