"""Text normalisation and tokens as native expressions (no Python at run time)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that matching ignores, and tokens that count in spite of their length.
NAME_STOP_WORDS = ("fc", "cf", "sc", "ec", "ac", "ca", "cd", "sd", "ud", "club", "clube", "de", "do", "da", "the")
STOP_WORDS = ("fc", "cf", "sc", "ec", "ac", "ca", "cd", "sd", "ud", "club", "clube", "de", "do", "da", "of", "the", "and", "e")
SAFE_SHORT_TOKENS = ("u17", "u18", "u19", "u20", "u21", "u22", "u23", "usa", "eua", "uae", "dr", "rd", "us")
# Words and short tokens of aliases, the former ignored, the latter kept.
ALIAS_STOP_WORDS = ("fc", "cf", "sc", "ec", "ac", "ca", "cd", "sd", "ud", "club", "clube", "de", "do", "da", "dos", "das", "of", "and", "e", "the", "real", "new", "united", "city", "sub")
SAFE_SHORT_ALIAS_TOKENS = ("u17", "u18", "u19", "u20", "u21", "u22", "u23", "usa", "eua", "uae")
# Words that set teams of one name apart (Korea and republic together: south).
TELLING_WORDS = {
    "direction:north": ("dpr", "north", "norte"),
    "direction:south": ("south", "sul"),
    "state:democratic-republic": ("dr", "rd", "democratic", "democratica", "democratico", "kinshasa"),
    "state:republic": ("brazzaville",),
    "direction:east": ("east", "oriental"),
    "direction:west": ("west", "oeste"),
    "gender:women": ("w", "women", "woman", "f", "fem", "feminino", "feminina"),
}
# Spacing characters that have the Unicode property Diacritic without being marks.
SPACING_DIACRITICS = "^`¨¯´·¸"
# Simulated events, and qualifiers in brackets that real teams have.
VIRTUAL = r"\b(?:e\s*soccer|esoccer|virtual|fantasy|simulado|simulacao|srl|cyber|pes|ebasket|basketball\s*cyber|kings\s*league)\b"
SAFE_QUALIFIER = r"^(?:w|women|woman|f|fem|feminino|feminina|u\d{2}|sub\s*\d{2}|reserve|reserves|reserva|b|ii|iii|iv)$"


@lru_cache(1)
def _folding() -> tuple[str, str]:
    """Letters whose decomposition is one ASCII character and marks, that character, and behind them all marks to delete."""
    source, target, marks = [], [], []
    for code in range(0xA0, 0x3000):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
        elif len(parts) > 1 and ord(parts[0]) < 128 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            source.append(char)
            target.append(parts[0])
    return "".join([*source, *marks, *SPACING_DIACRITICS]), "".join(target)


def fold(text: Column) -> Column:
    """Without diacritics, in lower case; null is empty."""
    source, target = _folding()
    return F.lower(F.translate(F.coalesce(text.cast("string"), F.lit("")), source, target))


def once(value: Column, then) -> Column:
    """``then`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), then)[0]


def _squeeze(text: Column, other: str) -> Column:
    return F.trim(F.regexp_replace(text, other, " "))


def normalize_name(text: Column) -> Column:
    """Folded, without club words, other characters than letters and digits as single blanks."""
    return _squeeze(F.regexp_replace(fold(text), rf"\b({'|'.join(NAME_STOP_WORDS)})\b", " "), "[^a-z0-9]+")


def normalize_for_matching(text: Column) -> Column:
    """Folded, all but letters and digits as single blanks."""
    return _squeeze(fold(text), "[^a-z0-9]+")


def normalize_price_text(text: Column) -> Column:
    """Like ``normalize_for_matching``, but full stops and commas stay."""
    return _squeeze(fold(text), "[^a-z0-9.,]+")


def matching_tokens(text: Column) -> Column:
    """Tokens: ``sub 20`` is ``u20``, runs of single letters are one token, stop words go."""
    ages = F.regexp_replace(normalize_for_matching(text), r"\bsub\s*(\d{2})\b", "u$1")
    # A blank between two letters that stand alone goes.
    merged = F.split(F.regexp_replace(ages, "(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", ""), " ")
    return F.filter(merged, lambda t: (F.length(t) > 0) & ~t.isin(*STOP_WORDS))


def significant_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(matching_tokens(text), lambda t: F.length(t) > 2))


def profile_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(matching_tokens(text), lambda t: (F.length(t) >= 2) | t.isin(*SAFE_SHORT_TOKENS)))


def alias_parts(text: Column) -> Column:
    """Tokens of an alias: two letters or more, no club words, no numbers; ``sub 20`` is ``u20``."""
    ages = F.regexp_replace(normalize_for_matching(text), r"\bsub\s*(\d{2})\b", "u$1")
    return F.filter(F.split(ages, " "), lambda t: (F.length(t) >= 2) & ~t.isin(*ALIAS_STOP_WORDS) & ~t.rlike(r"^\d+$"))


def alias_tokens(text: Column) -> Column:
    """Tokens of an alias by which two names may meet."""
    return F.filter(alias_parts(text), lambda t: (F.length(t) >= 3) | t.isin(*SAFE_SHORT_ALIAS_TOKENS))


def _age(parts: Column) -> Column:
    return F.get(F.filter(parts, lambda t: t.rlike(r"^u\d{2}$")), 0)


def groups_overlap(left: Column, right: Column) -> Column:
    """Two sides' aliases (arrays of names) share a telling token where their age categories agree."""
    meets = lambda a, b: _age(alias_parts(a)).eqNullSafe(_age(alias_parts(b))) & F.arrays_overlap(alias_tokens(a), alias_tokens(b))
    return F.coalesce(F.exists(left, lambda a: F.exists(right, lambda b: meets(a, b))), F.lit(False))


def mentions(page: Column, names: Column) -> Column:
    """A page's text has, of one of the names (an array of aliases), the age category and the first four telling tokens."""
    words = F.split(F.regexp_replace(normalize_for_matching(page), r"\bsub\s*(\d{2})\b", "u$1"), " ")

    def there(name: Column) -> Column:
        wanted, age = F.slice(alias_tokens(name), 1, 4), _age(alias_parts(name))
        return (F.size(wanted) > 0) & (age.isNull() | F.array_contains(words, age)) & F.forall(wanted, lambda t: F.array_contains(words, t))

    return F.coalesce(F.exists(names, there), F.lit(False))


def without_age(text: Column) -> Column:
    """A normal form without its age category."""
    return F.trim(F.regexp_replace(F.regexp_replace(normalize_for_matching(text), r"\bu\d{2}\b", ""), r"\bsub\s*\d{2}\b", ""))


def profile(text: Column) -> Column:
    """normalized, tokens, token_key (tokens in order), compact (tokens without blanks)."""
    tokens = profile_tokens(text)
    return F.struct(
        normalize_for_matching(text).alias("normalized"),
        tokens.alias("tokens"),
        F.array_join(F.array_sort(tokens), " ").alias("token_key"),
        F.array_join(tokens, "").alias("compact"),
    )


def identity_score(left: Column, right: Column) -> Column:
    """Score of two profiles: equal, equal when compacted, equal in any order, one within the other."""
    within = lambda a, b: (F.size(a) >= 2) & F.forall(a, lambda t: F.array_contains(b, t))
    a, b = left["tokens"], right["tokens"]
    return (
        F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0)
        .when(left["normalized"] == right["normalized"], 1.0)
        .when((left["compact"] != "") & (left["compact"] == right["compact"]), 0.995)
        .when((left["token_key"] != "") & (left["token_key"] == right["token_key"]), 0.985)
        .when(within(a, b) | within(b, a), 0.94)
        .otherwise(0.0)
    )


def distinguishing_keys(tokens: Column) -> Column:
    """What sets teams of one name apart: age, direction, state, gender, squad."""
    has = lambda *words: F.arrays_overlap(tokens, F.array(*map(F.lit, words)))
    told = {key: has(*words) for key, words in TELLING_WORDS.items()}
    told["direction:south"] |= has("korea") & has("republic")
    fixed = F.array(*(F.when(when, F.lit(key)) for key, when in told.items()))
    squad = F.transform(F.filter(tokens, lambda t: t.isin("b", "ii", "iii", "iv", "reserve", "reserves", "reserva")), lambda t: F.concat(F.lit("squad:"), t))
    age = F.transform(F.filter(tokens, lambda t: t.rlike(r"^u\d{2}$")), lambda t: F.concat(F.lit("age:"), t))
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(fixed), squad, age)))


def looks_virtual(league: Column, home: Column, away: Column) -> Column:
    """A simulated event, or a participant with a qualifier in brackets that is not a usual one."""
    whole = normalize_for_matching(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in (league, home, away))))

    def odd(name: Column) -> Column:
        inner = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"\(([^)]{1,40})\)"), 1)
        return F.exists(inner, lambda q: (normalize_for_matching(q) != "") & ~normalize_for_matching(q).rlike(SAFE_QUALIFIER))

    return whole.rlike(VIRTUAL) | odd(home) | odd(away)


def search_keywords(name: Column, most: int = 3) -> Column:
    """Without brackets and leading club words: the whole, and its first one to ``most`` tokens, distinct."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(fold(name), r"\([^)]*\)", " "), r"[^a-z0-9]+", " "))
    core = F.trim(F.regexp_replace(plain, rf"^(?:(?:{'|'.join(NAME_STOP_WORDS)})\s+)+", ""))
    parts = F.split(core, " ")
    heads = [F.array_join(F.slice(parts, 1, k), " ") for k in range(most, 0, -1)]
    return F.filter(F.array_distinct(F.array(core, *heads)), lambda t: t != "")


# Letters and their accented forms that a search takes as equal.
ACCENTS = {"a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîï", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ýÿ"}
#: Between the letters of a short name a search lets a few other signs stand.
BETWEEN = r"[^A-Za-z0-9\u00C0-\u024F]{0,3}"


def search_pattern(token: Column) -> Column:
    """A regex that finds a token whatever its accents and case; the letters of a short one may stand apart."""
    group = F.create_map(*(F.lit(x) for k, forms in ACCENTS.items() for x in (k, "[" + "".join(c + c.upper() for c in k + forms if c != "ÿ") + ("ÿ" if "ÿ" in forms else "") + "]")))
    letter = lambda c: F.coalesce(group[F.lower(c)], F.when(c.rlike("[A-Za-z0-9]"), c).otherwise(F.concat(F.lit("\\"), c)))
    letters = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), letter)
    short = token.rlike("^[a-z]{2,4}$") & ((F.length(token) <= 3) | token.isin(*SAFE_SHORT_TOKENS))
    return F.when(short, F.array_join(letters, BETWEEN)).otherwise(F.array_join(letters, ""))
