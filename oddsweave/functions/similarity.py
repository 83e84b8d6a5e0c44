"""Similarity of team names: Jaro-Winkler and scores on tokens, as Arrow-fed UDFs over name pairs.

Spark has no Jaro-Winkler.  A batch's distinct name pairs are compared together,
all their token pairs at once with array operations.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from oddsweave.functions.text import ALIAS_STOP_WORDS, SAFE_SHORT_ALIAS_TOKENS, SAFE_SHORT_TOKENS, SPACING_DIACRITICS, STOP_WORDS, TELLING_WORDS

REMEMBERED = 1 << 17
MISMATCH_CAP = 0.61
# Clubs under two names that no rule connects. Users pass their own groups for more.
ALIAS_GROUPS = (
    ("crb", "clube de regatas brasil"),
    ("kups", "kuopion palloseura", "kups kuopio"),
    ("vardar skopje", "vardar", "fk vardar"),
    ("manchester united", "man utd"),
    ("usa", "united states", "estados unidos", "eua"),
    ("south korea", "korea republic", "coreia do sul"),
    ("north korea", "korea dpr", "coreia do norte"),
)
_SPACING = dict.fromkeys(map(ord, SPACING_DIACRITICS))


def normalized(value: str | None) -> str:
    parts = unicodedata.normalize("NFD", value or "").translate(_SPACING)
    plain = "".join(c for c in parts if unicodedata.category(c) != "Mn")
    return " ".join(re.findall("[a-z0-9]+", plain.lower()))


def tokens(value: str | None) -> list[str]:
    out: list[str] = []
    joining = False
    for part in re.sub(r"\bsub\s*(\d{2})\b", r"u\1", normalized(value)).split():
        letter = len(part) == 1 and part.isalpha()
        if letter and joining:
            out[-1] += part
        else:
            out.append(part)
        joining = letter
    return [t for t in out if t not in STOP_WORDS]


def jaro_winkler(left: str, right: str) -> float:
    """Half transpositions count, and the prefix bonus applies at any score; two empty names are unlike."""
    a, b = left.replace(" ", ""), right.replace(" ", "")
    if a == b or not a or not b:
        return float(bool(a) and a == b)
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    left_over, mine, taken = b, [], []
    for i, c in enumerate(a):
        j = left_over.find(c, max(0, i - reach), i + reach + 1)
        if j >= 0:
            left_over = f"{left_over[:j]}\0{left_over[j + 1:]}"
            mine.append(c)
            taken.append(j)
    if not mine:
        return 0.0
    theirs = [b[j] for j in sorted(taken)]
    m, swaps = len(mine), sum(x != y for x, y in zip(mine, theirs))
    jaro = (m / len(a) + m / len(b) + (m - swaps / 2) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Longer texts, and those of other letters, are compared one pair at a time.
_WIDTH = 64
_PLAIN = re.compile("[a-z0-9]*")
_LOW = np.array([(1 << n) - 1 for n in range(_WIDTH + 1)], np.uint64)
#: By place and reach: the places within reach.
_NEAR = np.array([[_LOW[min(i + r + 1, _WIDTH)] & ~_LOW[max(i - r, 0)] for r in range(_WIDTH // 2)] for i in range(_WIDTH)], np.uint64)


class Texts:
    """Distinct texts of letters and digits; of each letter the places where it stands are the bits of one number, so pairs are compared a place at a time."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.odd = np.array([len(t) > _WIDTH or not _PLAIN.fullmatch(t) for t in texts], bool)
        short = ["" if odd else t for t, odd in zip(texts, self.odd.tolist())]
        width = max([4, *map(len, short)])
        flat = np.frombuffer("".join(t.ljust(width) for t in short).encode("ascii"), np.uint8).reshape(len(texts), width)
        # Letters are 1 to 36, behind a text's end stands 0, which is nowhere.
        self.codes = np.ascontiguousarray(np.where(flat == 32, 0, np.where(flat < 97, flat - 21, flat - 96)).T).astype(np.int64)
        places = np.zeros((len(texts), len(_LETTERS) + 1), np.uint64)
        rows = np.arange(len(texts))
        for i, codes in enumerate(self.codes):
            places[rows, codes] |= np.uint64(1 << i)
        places[:, 0] = 0
        self.places = places.reshape(-1)

    def jaro_winkler(self, left: np.ndarray, right: np.ndarray, step: int = 1 << 14) -> np.ndarray:
        """``jaro_winkler`` of pairs of texts, by their numbers."""
        out = np.zeros(len(left))
        for at in range(0, len(left), step):
            out[at : at + step] = self._block(left[at : at + step], right[at : at + step])
        for k in np.flatnonzero(self.odd[left] | self.odd[right]).tolist():
            out[k] = jaro_winkler(self.texts[left[k]], self.texts[right[k]])
        return out

    def _block(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        la, lb = self.length[a], self.length[b]
        reach = np.clip(np.maximum(la, lb) // 2 - 1, 0, _WIDTH // 2 - 1)
        whole = _LOW[np.minimum(lb, _WIDTH)]
        free, start = whole.copy(), b * (len(_LETTERS) + 1)
        steps = []
        for i in range(min(int(la.max(initial=0)), len(self.codes))):
            here = self.places[start + self.codes[i][a]]
            first = here & _NEAR[i][reach] & free
            first &= np.negative(first)
            free ^= first
            steps.append((here, first != 0))
        matches, swaps, rest = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), whole ^ free
        for here, own in steps:
            # The next matched letter of the other text, in its order.
            low = (rest & np.negative(rest)) * own
            matches += own
            swaps += own & ((here & low) == 0)
            rest ^= low
        m = np.maximum(matches, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = (matches / la + matches / lb + (matches - swaps / 2) / m) / 3
        going, prefix = np.ones(len(a), bool), np.zeros(len(a), np.int64)
        for codes in self.codes[:4]:
            mine = codes[a]
            going &= (mine == codes[b]) & (mine > 0)
            prefix += going
        score = np.where(matches > 0, jaro + prefix * 0.1 * (1 - jaro), 0.0)
        return np.where((a == b) & (la > 0), 1.0, score)


class Sets:
    """Rows of numbers, padded by kinds of length when two are held against each other."""

    def __init__(self, rows: list):
        self.size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.fromiter((x for row in rows for x in row), np.int64, int(self.size.sum()))

    def of(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.flat[self.start[rows][:, None] + np.arange(size)]

    def shapes(self, left: np.ndarray, right: np.ndarray, cells: int = 1 << 21):
        """Pairs of rows by their two lengths, in blocks: places of the pairs, both rows' numbers."""
        kind = self.size[left] * (int(self.size.max(initial=0)) + 1) + self.size[right]
        order = np.argsort(kind, kind="stable")
        bounds = np.flatnonzero(np.diff(kind[order], prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x, y = int(self.size[left[order[lo]]]), int(self.size[right[order[lo]]])
            step = max(1, cells // max(x * y, 1))
            for at in range(lo, hi, step):
                own = order[at : min(at + step, hi)]
                yield own, self.of(left[own], x), self.of(right[own], y)

    def common(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many numbers pairs of rows share; a row has each number once."""
        out = np.zeros(len(left), np.int64)
        for own, a, b in self.shapes(left, right):
            if a.shape[1] and b.shape[1]:
                out[own] = sum((a[:, i] == b[:, j]).astype(np.int64) for i in range(a.shape[1]) for j in range(b.shape[1]))
        return out


class Numbers(dict):
    """Numbers of values in order of their first use."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


class Forms:
    """What scores of names need of their aliases' parts (of ``_form``), as arrays."""

    def __init__(self, forms: list[tuple]):
        texts, words, keys, joined, ordered = Numbers(), Numbers(), Numbers(), Numbers(), Numbers()
        self.whole = np.array([texts[alias.replace(" ", "")] for alias, *_ in forms], np.int64)
        self.parts = Sets([[texts[t] for t in parts] for _, parts, _, _ in forms])
        self.named = Sets([[words[t] for t in named] for _, _, named, _ in forms])
        self.joined = np.array([joined["".join(named)] for _, _, named, _ in forms], np.int64)
        self.ordered = np.array([ordered[tuple(sorted(named))] for _, _, named, _ in forms], np.int64)
        self.keys = np.array([keys[k] for *_, k in forms], np.int64)
        self.texts = Texts(list(texts))

    def identity(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_identity`` of pairs of forms."""
        na, nb, common = self.named.size[a], self.named.size[b], self.named.common(a, b)
        inside = (na > 1) & (common == na) | (nb > 1) & (common == nb)
        found = np.select([a == b, self.joined[a] == self.joined[b], self.ordered[a] == self.ordered[b], inside], [1.0, 0.995, 0.985, 0.94], 0.0)
        return np.where((na > 0) & (nb > 0), found, 0.0)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        most = np.where(self.keys[a] != self.keys[b], MISMATCH_CAP, 1.0)
        score = self.identity(a, b)
        asked = np.flatnonzero(score < most)
        a, b = a[asked], b[asked]
        best = np.maximum(score[asked], self.texts.jaro_winkler(self.whole[a], self.whole[b]))
        blocks = [(own, x, y, x[:, :, None] * len(self.texts.texts) + y[:, None]) for own, x, y in self.parts.shapes(a, b) if x.shape[1] and y.shape[1]]
        if blocks:
            # Pairs of tokens recur: each is compared once.
            at, pairs = pd.factorize(np.concatenate([codes.reshape(-1) for *_, codes in blocks]))
            read = self.texts.jaro_winkler(*np.divmod(pairs, len(self.texts.texts)))[at]
            done = 0
            for own, x, y, codes in blocks:
                grid = read[done : done + codes.size].reshape(codes.shape)
                done += codes.size
                n, m = codes.shape[1:]
                both = (grid.max(2).sum(1) / n + grid.max(1).sum(1) / m) / 2
                order = np.trace(grid, axis1=1, axis2=2) / max(n, m)
                best[own] = np.maximum(best[own], np.maximum(both, order))
        score[asked] = best
        return np.minimum(score, most)


@lru_cache(REMEMBERED)
def _token_pair(a: str, b: str) -> float:
    return jaro_winkler(a, b)


def token_set(left: list[str], right: list[str]) -> float:
    """Mean of both directions' mean of the best partner's score."""
    if not left or not right:
        return 0.0
    grid = [[_token_pair(a, b) for b in right] for a in left]
    return (sum(map(max, grid)) / len(left) + sum(map(max, zip(*grid))) / len(right)) / 2


def in_order(left: list[str], right: list[str]) -> float:
    """Scores of tokens at the same place, over the longer name."""
    if not left or not right:
        return 0.0
    return sum(_token_pair(a, b) for a, b in zip(left, right)) / max(len(left), len(right))


def alias_index(groups=ALIAS_GROUPS) -> dict[str, frozenset[str]]:
    """Alias to all its aliases; groups that share one are one."""
    index: dict[str, set[str]] = {}
    for group in groups:
        merged = {normalized(a) for a in group} - {""}
        for alias in list(merged):
            merged |= index.get(alias, set())
        for alias in merged:
            index[alias] = merged
    return {k: frozenset(v) for k, v in index.items()}


def aliases(value: str | None, index: dict[str, frozenset[str]]) -> list[str]:
    """The name and its aliases; an age category is carried over to each."""
    name = normalized(value)
    if not name:
        return []
    age = re.search(r"\bu(\d{2})\b", name) or re.search(r"\bsub\s*(\d{2})\b", name)
    base = re.sub(r"\bsub\s*\d{2}\b|\bu\d{2}\b", "", name).strip() if age else name
    known = sorted(index.get(base, ()))
    if age:
        known = [f"{a} {form}{age[1]}" for a in known for form in ("u", "sub ")]
    return list(dict.fromkeys([name, *known]))


def _keys(parts: list[str]) -> frozenset[str]:
    """The Python twin of ``text.distinguishing_keys``."""
    have = set(parts)
    out = {k for k, words in TELLING_WORDS.items() if not have.isdisjoint(words)}
    out |= {"direction:south"} if {"korea", "republic"} <= have else set()
    squads = have & {"b", "ii", "iii", "iv", "reserve", "reserves", "reserva"}
    return frozenset(out | squads | {t for t in have if re.fullmatch(r"u\d{2}", t)})


def _identity(left: str, right: str, a: list[str], b: list[str]) -> float:
    if not a or not b:
        return 0.0
    if left == right:
        return 1.0
    if "".join(a) == "".join(b):
        return 0.995
    if sorted(a) == sorted(b):
        return 0.985
    return 0.94 if len(a) > 1 and set(a) <= set(b) or len(b) > 1 and set(b) <= set(a) else 0.0


@lru_cache(REMEMBERED)
def _form(alias: str) -> tuple:
    """An alias' parts: itself, tokens, telling tokens, keys."""
    parts = tokens(alias)
    named = list(dict.fromkeys(t for t in parts if len(t) > 1 or t in SAFE_SHORT_TOKENS))
    return alias, parts, named, _keys(named)


def with_age(name: str, known) -> list[str]:
    """The name and its aliases; an age category is carried over to each."""
    age = re.search(r"\bu(\d{2})\b", name) or re.search(r"\bsub\s*(\d{2})\b", name)
    if age:
        known = [f"{a} {form}{age[1]}" for a in known for form in ("u", "sub ")]
    return list(dict.fromkeys([name, *known]))


@lru_cache(REMEMBERED)
def _listed_forms(name: str | None, groups) -> tuple:
    return tuple(_form(a) for a in aliases(name, _index(groups)))


def forms_of(name: str | None, known, groups) -> tuple:
    """A name's aliases with their parts."""
    if known and name in known and normalized(name):
        return tuple(_form(a) for a in with_age(normalized(name), known[name]))
    return _listed_forms(name, groups)


def name_scores(forms: list[tuple], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of pairs of names, by their numbers, the best score over their ``forms``, capped where something sets them apart."""
    numbers, kept = Numbers(), {}
    rows = []
    for own in forms:
        rows.append([numbers[f[0]] for f in own])
        kept.update((f[0], f) for f in own)
    table, lists = Forms([kept[a] for a in numbers]), Sets(rows)
    at, pairs = pd.factorize(left * len(forms) + right)
    a, b = np.divmod(pairs, max(len(forms), 1))
    out = np.zeros(len(pairs))
    for own, x, y in lists.shapes(a, b):
        if x.shape[1] and y.shape[1]:
            jobs = np.repeat(x, y.shape[1], axis=1).reshape(-1), np.tile(y, (1, x.shape[1])).reshape(-1)
            out[own] = table.scores(*jobs).reshape(len(own), -1).max(1)
    return out[at]


def team_scores(pairs: list[tuple[str | None, str | None]], known=None, groups=ALIAS_GROUPS) -> list[float]:
    """Of each pair of names the best score over their aliases, capped where something sets them apart.

    ``known``: of a name its aliases, where a table of them was joined; else ``groups``.
    """
    names = Numbers()
    sides = [np.fromiter((names[pair[k]] for pair in pairs), np.int64, len(pairs)) for k in (0, 1)]
    return name_scores([forms_of(n, known, groups) for n in names], *sides).tolist()


def team_scorer(groups=ALIAS_GROUPS):
    """A function of two names, see ``team_scores``."""
    return lambda left, right: team_scores([(left, right)], groups=tuple(map(tuple, groups)))[0]


def token_groups(names) -> list[tuple[str | None, frozenset[str]]]:
    """Of each alias with tokens: its age category, and the tokens that tell it apart."""
    out = []
    for a in names:
        parts = [t for t in re.sub(r"\bsub\s*(\d{2})\b", r"u\1", a).split() if len(t) > 1 and t not in ALIAS_STOP_WORDS and not t.isdigit()]
        if parts:
            age = next((t for t in parts if re.fullmatch(r"u\d{2}", t)), None)
            out.append((age, frozenset(t for t in parts if len(t) > 2 or t in SAFE_SHORT_ALIAS_TOKENS)))
    return out


def groups_overlap(left, right) -> bool:
    """Two sides' token groups share a telling token, and their age categories agree."""
    return any(a == b and not x.isdisjoint(y) for a, x in left for b, y in right)


@lru_cache(REMEMBERED)
def _tokens(value: str | None) -> tuple[str, ...]:
    return tuple(tokens(value))


@lru_cache(REMEMBERED)
def _token_set(a: str | None, b: str | None) -> float:
    return token_set(_tokens(a), _tokens(b))


def jaro_winkler_udf():
    @F.pandas_udf("double")
    def jw(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(normalized(x), normalized(y)) for x, y in zip(a, b)])

    return jw


def token_set_udf():
    @F.pandas_udf("double")
    def ts(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_token_set(x, y) for x, y in zip(a, b)])

    return ts


def in_order_udf():
    @F.pandas_udf("double")
    def io(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([in_order(list(_tokens(x)), list(_tokens(y))) for x, y in zip(a, b)])

    return io


def team_score_udf(groups=ALIAS_GROUPS):
    """Score of two names; distinct pairs of a batch are compared once."""
    groups = tuple(map(tuple, groups))

    @F.pandas_udf("double")
    def team(a: pd.Series, b: pd.Series) -> pd.Series:
        rows = list(zip(a, b))
        distinct = list(dict.fromkeys(rows))
        found = dict(zip(distinct, team_scores(distinct, groups=groups)))
        return pd.Series([found[r] for r in rows], dtype="float64")

    return team


@lru_cache(REMEMBERED)
def _telling(home: str | None, away: str | None) -> tuple[frozenset[str], str]:
    both = tokens(f"{home or ''} {away or ''}")
    return frozenset(t for t in both if len(t) > 2), "".join(both)


@lru_cache(REMEMBERED)
def _groups_of(names: tuple[str, ...]):
    return token_groups(names)


@lru_cache(REMEMBERED)
def _listed_groups(name: str | None, groups):
    return token_groups(aliases(name, _index(groups)))


def event_scores_udf(groups=ALIAS_GROUPS, league: float = 0.0):
    """Of canonical home and away and a feed's home and away: whether the events share a telling token, whether they are ``strong``, and four name scores.

    Events are strong that are ``sure``, or whose leagues, if both have one, score
    ``league`` or more.  The four names' aliases may follow (none or null: by
    ``groups``).  Names are compared only for rows of ``go`` that share a token or
    are strong; each distinct name and pair of a batch is worked out once.
    """
    groups = tuple(map(tuple, groups))

    @F.pandas_udf("home_home double, away_away double, home_away double, away_home double, shared boolean, strong boolean")
    def scores(ch: pd.Series, ca: pd.Series, bh: pd.Series, ba: pd.Series, cl: pd.Series, bl: pd.Series, go: pd.Series, sure: pd.Series, *aliases_: pd.Series) -> pd.DataFrame:
        known = {n: tuple(x) for column, more in zip((ch, ca, bh, ba), aliases_) for n, x in zip(column, more) if x is not None}
        at, names = pd.factorize(pd.concat([ch, ca, bh, ba], ignore_index=True).fillna(""))
        names, sides, wanted = list(names), at.reshape(4, len(ch)), go.fillna(False).to_numpy(bool)
        strong = sure.fillna(False).to_numpy(bool) | (_league_scores(cl.fillna(""), bl.fillna("")) >= league)
        shared = _shared(sides, names, wanted, known, groups)
        rows = np.flatnonzero(wanted & (shared | strong))
        found = np.full((4, len(ch)), np.nan)
        if len(rows):
            a, b, c, d = sides[:, rows]
            used, asked = np.unique(np.concatenate([a, b, a, b, c, d, d, c]), return_inverse=True)
            found[:, rows] = name_scores([forms_of(names[n], known, groups) for n in used.tolist()], *asked.reshape(2, -1)).reshape(4, -1)
        return pd.DataFrame({"home_home": found[0], "away_away": found[1], "home_away": found[2], "away_home": found[3], "shared": shared, "strong": strong})

    return scores


def _league_scores(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Scores of two names' token sets, below all where a name is empty; distinct pairs are compared once."""
    at, names = pd.factorize(pd.concat([left, right], ignore_index=True))
    a, b = at.reshape(2, -1)
    asked, pairs = pd.factorize(a * len(names) + b)
    return np.array([_token_set(x, y) if x and y else -1.0 for x, y in ((names[i], names[j]) for i, j in zip(*(z.tolist() for z in np.divmod(pairs, max(len(names), 1)))))])[asked]


def _shared(sides: np.ndarray, names: list[str], go: np.ndarray, known, groups) -> np.ndarray:
    """Of rows of four names, by their numbers: whether the events share a telling token, one is within the other, or both sides' aliases overlap."""
    out, rows = np.zeros(sides.shape[1], bool), np.flatnonzero(go)
    a, b, c, d = sides[:, rows]
    at, events = pd.factorize(np.concatenate([a * len(names) + b, c * len(names) + d]))
    left, right = at.reshape(2, -1)
    words = Numbers()
    told = [_telling(names[h], names[w]) for h, w in zip(*(x.tolist() for x in np.divmod(events, max(len(names), 1))))]
    out[rows] = Sets([[words[t] for t in tokens_] for tokens_, _ in told]).common(left, right) > 0
    rest = np.flatnonzero(~out[rows])
    letters = [x for _, x in told]
    out[rows[rest]] = [len(letters[i]) >= 5 and len(letters[j]) >= 5 and (letters[i] in letters[j] or letters[j] in letters[i]) for i, j in zip(left[rest].tolist(), right[rest].tolist())]
    rest = np.flatnonzero(~out[rows])
    used, asked = np.unique(sides[:, rows[rest]], return_inverse=True)
    a, b, c, d = asked.reshape(4, -1)

    def told_apart(name):
        own = normalized(name) if name in known else ""
        return _groups_of(tuple(with_age(own, known[name]))) if own else _listed_groups(name, groups)

    forms = Sets([sorted({words[age, t] for age, tokens_ in told_apart(names[n]) for t in tokens_}) for n in used.tolist()])
    alike = lambda x, y: forms.common(x, y) > 0
    out[rows[rest]] = alike(a, c) & alike(b, d) | alike(a, d) & alike(b, c)
    return out


@lru_cache(8)
def _index(groups):
    return alias_index(groups)
