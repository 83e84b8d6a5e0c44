"""Secret scans with one combined deterministic automaton.

The regexes of all rules are parsed to trees, turned into one nondeterministic
automaton that may start a match at any byte, made deterministic by subset
construction over byte classes, minimised by partition refinement and laid out
as transition arrays.  One pass over the bytes drives all rules.

The pass is data-parallel: texts are cut into lanes of equal length that advance
together, one table look-up per byte and lane.  A lane that starts inside a text
guesses the start state; lanes whose guess was wrong run again from the true
state, until every lane starts where its left neighbour ended.  Only texts in
which some rule fired are then walked, for the rules that fired, to give the
exact spans: leftmost, longest, not overlapping within a kind.  An automaton of
the reversed rule reads the text once from its end and marks where matches
start; from a start the rule's own automaton finds the end.  So no place without
a match is ever tried, and time grows with the text's length.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddsweave.llm._shared import row_key, slabs

LANE = 1024


@dataclass(frozen=True)
class Rule:
    """``least``: characters of the match (with ``value``: of what is assigned in it) below which it is dropped.

    ``scan``: what the combined pass looks for instead; every match that is long
    enough must hold it.  A counted run makes far fewer texts fire, and a part
    without loops keeps the product with other rules' loops small.
    """

    kind: str
    pattern: str
    least: int = 0
    value: bool = False
    scan: str = ""


#: The three base rules, in their order, as the contract states them, then those that the method adds.
BASE = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24, scan=r"[0-9a-f]{24}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", scan=r"PRIVATE KEY-----"),
    Rule("bearer", r"(?:ghp|gho|ghs|ghu|xoxb|xoxp|xoxa|sk_live|rk_live)[_-][A-Za-z0-9-]+", 24, scan=r"(?:ghp|gho|ghs|ghu|xoxb|xoxp|xoxa|sk_live|rk_live)[_-][A-Za-z0-9-]"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, scan=r"\.eyJ"),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", 39, scan=r"AIza[A-Za-z0-9_-]"),
    Rule("package", r"(?:npm_|pypi-|glpat-|github_pat_)[A-Za-z0-9_-]+", 26, scan=r"(?:npm_|pypi-|glpat-|github_pat_)[A-Za-z0-9_-]"),
    Rule("login", r"[a-z]+://[A-Za-z0-9._-]+:[A-Za-z0-9._%!+-]+@[A-Za-z0-9]", scan=r"[A-Za-z0-9._%!+-]@[A-Za-z0-9]"),
)
RULES = BASE + ADDED
#: Bits of the word in which a state says which rules end in it.
MOST_RULES = 64


class _Nfa:
    """Thompson's construction over the parse tree of a byte regex; ``back``: of what it matches, read from the end."""

    def __init__(self, back: bool = False):
        self.back = back
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def new(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree, at: int) -> int:
        """Adds what ``tree`` matches behind state ``at``; the state where it ends."""
        for op, arg in reversed(list(tree)) if self.back else tree:
            at = getattr(self, f"_{str(op).lower()}")(arg, at)
        return at

    def _take(self, allowed, at: int) -> int:
        end = self.new()
        here = self.new()
        self.eps[at].append(here)
        self.step[here] = (frozenset(allowed), end)
        return end

    def _literal(self, code, at):
        return self._take({code}, at)

    def _in(self, items, at):
        codes: set[int] = set()
        for op, arg in items:
            if str(op) == "NEGATE":
                raise ValueError("negated classes are not supported in rules")
            codes |= {arg} if str(op) == "LITERAL" else set(range(arg[0], arg[1] + 1))
        return self._take(codes, at)

    def _subpattern(self, arg, at):
        return self.add(arg[-1], at)

    def _branch(self, arg, at):
        end = self.new()
        for tree in arg[1]:
            start = self.new()
            self.eps[at].append(start)
            self.eps[self.add(tree, start)].append(end)
        return end

    def _max_repeat(self, arg, at):
        least, most, tree = arg
        for _ in range(least):
            at = self.add(tree, at)
        if str(most) == "MAXREPEAT":
            start, end = self.new(), self.new()
            self.eps[at] += [start, end]
            self.eps[self.add(tree, start)] += [start, end]
            return end
        end = self.new()
        for _ in range(most - least):
            self.eps[at].append(end)
            at = self.add(tree, at)
        self.eps[at].append(end)
        return end


@dataclass(frozen=True)
class Dfa:
    """``move[state, byte class]``; ``accept[state]`` has a bit for each rule that ends in that state. State 0 starts; ``dead`` never leaves itself."""

    classes: np.ndarray
    move: np.ndarray
    accept: np.ndarray
    dead: int


def compile_rules(patterns: tuple[str, ...], anywhere: bool, back: bool = False) -> Dfa:
    """One minimal automaton for all patterns; ``anywhere``: a match may begin at any byte; ``back``: texts are read from their end."""
    from re import _parser

    if len(patterns) > MOST_RULES:
        raise ValueError(f"{len(patterns)} rules; one automaton tells {MOST_RULES} apart")
    nfa = _Nfa(back)
    root = nfa.new()
    final: dict[int, int] = {}
    for bit, pattern in enumerate(patterns):
        start = nfa.new()
        nfa.eps[root].append(start)
        final[nfa.add(_parser.parse(pattern), start)] = 1 << bit

    def closure(states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in nfa.eps[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(x for x in seen if nfa.step[x] or x in final)

    signature: dict[tuple, list[int]] = {}
    sets = list({s[0] for s in nfa.step if s})
    for byte in range(256):
        signature.setdefault(tuple(byte in s for s in sets), []).append(byte)
    classes = np.zeros(256, np.int64)
    for k, members in enumerate(signature.values()):
        classes[members] = k
    heads = [members[0] for members in signature.values()]

    begin = closure([root])
    again = begin if anywhere else frozenset()
    index, order, move = {begin: 0}, [begin], []
    for state in order:  # grows while it is read
        row = []
        for byte in heads:
            to = closure([nfa.step[x][1] for x in state if nfa.step[x] and byte in nfa.step[x][0]]) | again
            if to not in index:
                index[to] = len(order)
                order.append(to)
            row.append(index[to])
        move.append(row)
    table = np.array(move, np.int64)
    accept = np.array([sum({final[x] for x in state if x in final}) for state in order], np.uint64)

    part = np.unique(accept, return_inverse=True)[1].ravel()
    while True:  # refine until states of one part move to the same parts
        finer = np.unique(np.column_stack((part, part[table])), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    _, head = np.unique(part, return_index=True)
    rank = np.empty(len(head), np.int64)
    rank[np.argsort(head)] = np.arange(len(head))
    head = np.sort(head)
    small = rank[part[table[head]]]
    dead = next((s for s in range(len(head)) if not accept[head[s]] and (small[s] == s).all()), -1)
    return Dfa(classes.astype(np.uint8), small.astype(np.uint16 if len(head) < 65536 else np.uint32), accept[head], dead)


@lru_cache(8)
def automata(rules: tuple[Rule, ...]) -> tuple[Dfa, tuple[tuple[Dfa, Dfa], ...]]:
    """The combined automaton that scans, and two of each rule: one that finds where a match ends, one that finds from behind where matches start."""
    return compile_rules(tuple(r.scan or r.pattern for r in rules), True), tuple((compile_rules((r.pattern,), False), compile_rules((r.pattern,), True, True)) for r in rules)


def fired(dfa: Dfa, data: np.ndarray, at: np.ndarray, lane: int = LANE) -> np.ndarray:
    """For each text, the bits of the rules of which some match ends in it."""
    sizes = np.diff(at)
    per = -(-sizes // lane)
    owner = np.repeat(np.arange(len(sizes)), per)
    if not len(owner):
        return np.zeros(len(sizes), np.uint64)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    begin = at[owner] + nth * lane
    length = np.minimum(at[owner + 1] - begin, lane)
    cls = np.zeros(len(data) + lane, np.uint8)
    cls[: len(data)] = dfa.classes[data]
    width = dfa.move.shape[1]
    flat = dfa.move.ravel()
    state = np.zeros(len(owner), np.int64)  # the guess at each lane's start
    out = np.zeros(len(owner), np.int64)
    bits = np.zeros(len(owner), np.uint64)
    todo = np.arange(len(owner))
    while len(todo):
        by = todo[np.argsort(-length[todo], kind="stable")]
        size, where, now = length[by], begin[by], state[by].copy()
        seen = np.zeros(len(by), np.uint64)
        active = len(by)
        for k in range(int(size[0])):
            while size[active - 1] <= k:
                active -= 1
            now[:active] = flat[now[:active] * width + cls[where[:active] + k]]
            seen[:active] |= dfa.accept[now[:active]]
        out[by], bits[by] = now, seen
        true = np.where(nth > 0, np.concatenate(([0], out[:-1])), 0)
        todo = np.flatnonzero(true != state)
        state = true
    result = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(result, owner, bits)
    return result


def starts(back: Dfa, body: bytes) -> list[int]:
    """Where matches of a rule start, ascending; ``back``: the automaton of the reversed rule."""
    move, accept = back.move.tolist(), back.accept.tolist()
    state, found = 0, []
    for k, c in enumerate(back.classes[np.frombuffer(body, np.uint8)[::-1]].tolist()):
        state = move[state][c]
        if accept[state]:
            found.append(len(body) - 1 - k)
    return found[::-1]


def matches(pair: tuple[Dfa, Dfa], body: bytes) -> list[tuple[int, int]]:
    """Byte spans of the leftmost, longest, not overlapping matches of one rule."""
    dfa, back = pair
    move, accept = dfa.move.tolist(), dfa.accept.tolist()
    cls, found, free = dfa.classes[np.frombuffer(body, np.uint8)].tolist(), [], 0
    for start in starts(back, body):
        if start < free:
            continue
        state, end = 0, start
        for k in range(start, len(cls)):
            state = move[state][cls[k]]
            if state == dfa.dead:
                break
            if accept[state]:
                end = k + 1
        if end > start:
            found.append((start, end))
            free = end
    return found


def spans(body: bytes, rules: tuple[Rule, ...], single: tuple[tuple[Dfa, Dfa], ...], bits: int) -> list[tuple[int, int, int]]:
    """(start, rule number, end) in code points, by start and then rule; ``single``: the automata of each rule."""
    out = []
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80)))
    for n, rule in enumerate(rules):
        if not bits >> n & 1:
            continue
        for a, b in matches(single[n], body):
            size = _value_size(body[a:b]) if rule.value else b - a
            if size >= rule.least:
                out.append((int(chars[a]), n, int(chars[b])))
    return sorted(out)


def _value_size(match: bytes) -> int:
    """Length of the value of an assignment: all behind the first sign, blanks and an opening quote."""
    cut = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    value = match[cut:].lstrip(b" ")
    return len(value) - (value[:1] in (b'"', b"'"))


def joined(found: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in found)


def _scan(rules: tuple[Rule, ...], base: int):
    kinds = [r.kind for r in rules]
    dfa, single = automata(rules)  # compiled once, on the driver; some hundred kB, whatever the data

    def run(batches):
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            for lo, hi, data, at in slabs(batch):
                bits = fired(dfa, data, at)
                n = hi - lo
                counts = np.zeros((len(rules), n), np.int64)
                digest, text = [nothing] * n, [""] * n
                for i in np.flatnonzero(bits).tolist():
                    found = spans(data[at[i] : at[i + 1]].tobytes(), rules, single, int(bits[i]))
                    for _, k, _ in found:
                        counts[k, i] += 1
                    digest[i] = hashlib.sha256(joined([x for x in found if x[1] < base], rules).encode()).hexdigest()
                    text[i] = joined(found, rules)
                yield pa.record_batch(
                    [batch.column(0).slice(lo, n), *(pa.array(c) for c in counts), pa.array(digest), pa.array(text)],
                    names=["row_id", *(f"n_{k}" for k in kinds), "base_sha256", "spans"],
                )

    return run, "row_id long, " + ", ".join(f"n_{k} long" for k in kinds) + ", base_sha256 string, spans string"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: matches of each rule, a digest of the spans of the first ``base`` rules, all spans.

    Null or empty text has no spans (the digest is that of the empty string);
    repeated rows give repeated rows; keys are whole numbers or null; other
    columns are not read; no rows give no rows.  No shuffle.
    """
    run, schema = _scan(rules, base)
    return docs.select(row_key(docs, key).alias("row_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of their texts replaced by ``mark``.

    Null stays null, spans that overlap share a mark, all other columns and the
    number of rows stay as they are.
    """
    dfa, single = automata(rules)

    def run(batches):
        for batch in batches:
            col = batch.schema.get_field_index("text")
            new = batch.column(col).to_pylist()
            for lo, _, data, at in slabs(batch):
                for i in np.flatnonzero(fired(dfa, data, at)).tolist():
                    body, out, free = new[lo + i], [], 0
                    for a, _, b in spans(body.encode(), rules, single, (1 << len(rules)) - 1):
                        if a >= free:
                            out += [body[free:a], mark]
                        free = max(free, b)
                    new[lo + i] = "".join([*out, body[free:]])
            yield batch.set_column(col, batch.schema.field(col), pa.array(new, batch.column(col).type))

    return docs.mapInArrow(run, docs.schema)
