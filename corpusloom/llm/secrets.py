"""Secret scans with one combined deterministic automaton.

Each rule is a prefix pattern and a tail: a run of bytes of one class. Prefixes become Thompson
NFAs; the subset construction follows all rules of all kinds at once, and a state also holds which kinds are in
their tail; for kinds without a prefix, whose tails begin everywhere, also how long it is (counting
the others too would multiply the states, so their length is taken when the tail ends). Partition refinement merges equal states. The result is one
flat transition array, so that a text is scanned for all rules in one pass over its bytes.

Matches of a kind are leftmost, greedy and don't overlap, as with a regex engine; a match that is
too short is dropped after it has used up its characters.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches


@dataclass(frozen=True)
class Rule:
    """``prefix`` then one or more bytes of the class ``tail``.

    ``least``: the tail's least length, or with ``whole`` that of the match. Patterns know
    literals, ``[classes]``, ``(a|b)``, ``?``, ``*``, ``+`` and ``\\xHH``. ``fold``: letters of the
    prefix match in either case.
    """

    kind: str
    prefix: str
    tail: str
    least: int
    whole: bool = False
    fold: bool = False


# The three base kinds, in the order in which spans at one start are listed.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", 12, fold=True),
    Rule("access", "AKIA", "[A-Z0-9]", 18, whole=True),
    Rule("hex", "", "[0-9a-f]", 16),
)
# Public formats of further credentials.
MORE = (
    Rule("github", "gh[pousr]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abprs]-", "[A-Za-z0-9-]", 10),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.", "[A-Za-z0-9_-]", 8),
    Rule("pem", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", r"[A-Za-z0-9+/=\x0A\x0D]", 32),
)


class _Nfa:
    """Thompson construction for the small pattern language; all fragments share one state list."""

    def __init__(self) -> None:
        self.moves: list[list[tuple[frozenset[int], int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def build(self, pattern: str, fold: bool) -> tuple[int, int]:
        """Start and end state of ``pattern``."""
        self.text, self.at, self.fold = pattern, 0, fold
        start, end = self._choice()
        if self.at != len(pattern):
            raise ValueError(f"unbalanced pattern: {pattern}")
        return start, end

    def _choice(self) -> tuple[int, int]:
        start, end = self.new(), self.new()
        while True:
            a, b = self._row()
            self.free[start].append(a)
            self.free[b].append(end)
            if self.at < len(self.text) and self.text[self.at] == "|":
                self.at += 1
                continue
            return start, end

    def _row(self) -> tuple[int, int]:
        start = end = self.new()
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            a, b = self._piece()
            self.free[end].append(a)
            end = b
        return start, end

    def _piece(self) -> tuple[int, int]:
        if self.text[self.at] == "(":
            self.at += 1
            a, b = self._choice()
            self.at += 1
        else:
            a, b = self.new(), self.new()
            self.moves[a].append((self._set(), b))
        if self.at < len(self.text) and self.text[self.at] in "?*+":
            sign, self.at = self.text[self.at], self.at + 1
            start, end = self.new(), self.new()
            self.free[start].append(a)
            self.free[b].append(end)
            if sign in "?*":
                self.free[start].append(end)
            if sign in "*+":
                self.free[b].append(a)
            return start, end
        return a, b

    def _char(self) -> int:
        if self.text[self.at] == "\\":
            if self.text[self.at + 1] == "x":
                self.at += 4
                return int(self.text[self.at - 2 : self.at], 16)
            self.at += 1
        self.at += 1
        return ord(self.text[self.at - 1])

    def _set(self) -> frozenset[int]:
        if self.text[self.at] != "[":
            got = {self._char()}
        else:
            self.at += 1
            got = set()
            while self.text[self.at] != "]":
                low = high = self._char()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    high = self._char()
                got |= set(range(low, high + 1))
            self.at += 1
        if self.fold:
            got |= {ord(chr(c).swapcase()) for c in got if chr(c).isascii() and chr(c).isalpha()}
        return frozenset(got)

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def step(self, states: frozenset[int], byte: int) -> set[int]:
        return {to for s in states for chars, to in self.moves[s] if byte in chars}


def byte_class(pattern: str) -> frozenset[int]:
    nfa = _Nfa()
    nfa.text, nfa.at, nfa.fold = pattern, 0, False
    return nfa._set()


class Automaton:
    """The combined automaton of ``rules``: ``table[state + byte]`` is the next state (a multiple of 256).

    States from ``hot`` on are those in which some kind's tail is reported; ``ready`` has the
    kinds for each of these. ``back`` is, for each kind, a DFA that reads a prefix backwards.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa = _Nfa()
        ends = [nfa.build(r.prefix, r.fold) for r in rules]
        begin = [nfa.closed({a}) for a, _ in ends]
        tails = [byte_class(r.tail) for r in rules]
        need = [r.least - (self._shortest(nfa, *ends[k]) if r.whole else 0) for k, r in enumerate(rules)]
        self.need = need
        #: Length from which a tail is reported: all of it where no prefix makes it rare.
        self.count = [n if ends[k][1] in begin[k] else 1 for k, n in enumerate(need)]
        mixed = [[c for c in range(256)]]  # bytes that no rule tells apart share a column
        for chars in [*(s for m in nfa.moves for s, _ in m), *tails]:
            mixed = [part for old in mixed for part in ([c for c in old if c in chars], [c for c in old if c not in chars]) if part]

        def after(state: tuple, byte: int) -> tuple:
            out = []
            for k, own in enumerate(state):
                if isinstance(own, int) and byte in tails[k]:
                    out.append(min(own + 1, self.count[k]))  # within a match: it alone counts
                    continue
                threads = begin[k] if isinstance(own, int) else own | begin[k]
                if ends[k][1] in threads and byte in tails[k]:
                    out.append(1)
                else:
                    out.append(nfa.closed(nfa.step(threads, byte)))
            return tuple(out)

        first = tuple(frozenset() for _ in rules)
        ids, order, rows = {first: 0}, [first], []
        for state in order:
            row = []
            for part in mixed:
                to = after(state, part[0])
                if to not in ids:
                    ids[to] = len(order)
                    order.append(to)
                row.append(ids[to])
            rows.append(row)
        ready = [tuple(k for k, x in enumerate(s) if isinstance(x, int) and x >= self.count[k]) for s in order]
        group = self._minimal(rows, ready)
        count = max(group) + 1
        seat: dict[int, int] = {}
        for g in sorted(range(count), key=lambda g: bool(ready[group.index(g)])):
            seat[g] = len(seat)
        self.states, self.hot = count, 256 * sum(not ready[group.index(g)] for g in range(count))
        self.cells = array("I", bytes(4 * 256 * count))
        self.ready: dict[int, tuple[int, ...]] = {}
        for g in range(count):
            i = group.index(g)
            if ready[i]:
                self.ready[256 * seat[g]] = ready[i]
            for part, to in zip(mixed, rows[i]):
                for c in part:
                    self.cells[256 * seat[g] + c] = 256 * seat[group[to]]
        self.start = 256 * seat[group[0]]
        self.back = [self._reverse(nfa, a, b) for a, b in ends]

    @cached_property
    def table(self) -> list[int]:
        """The transitions as a list that holds one int object a state, so that few are touched."""
        names = {256 * i: 256 * i for i in range(self.states)}
        return [names[x] for x in self.cells]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}

    @staticmethod
    def _shortest(nfa: _Nfa, start: int, end: int) -> int:
        """Length of the shortest prefix; kinds judged by the whole match have prefixes of one length."""
        states, n = nfa.closed({start}), 0
        while end not in states:
            states, n = nfa.closed({to for s in states for _, to in nfa.moves[s]}), n + 1
        return n

    @staticmethod
    def _minimal(rows: list[list[int]], ready: list[tuple[int, ...]]) -> list[int]:
        """Group of each state: refined until states of a group agree on every successor's group."""
        names: dict = {}
        group = [names.setdefault(r, len(names)) for r in ready]
        while True:
            names = {}
            finer = [names.setdefault((group[i], *(group[to] for to in row)), len(names)) for i, row in enumerate(rows)]
            if len(names) == max(group) + 1:
                return finer
            group = finer

    @staticmethod
    def _reverse(nfa: _Nfa, start: int, end: int) -> tuple[list[dict[int, int]], set[int]]:
        moves: dict[int, list[tuple[frozenset[int], int]]] = {}
        free: dict[int, list[int]] = {}
        for s in range(len(nfa.moves)):
            for chars, to in nfa.moves[s]:
                moves.setdefault(to, []).append((chars, s))
            for to in nfa.free[s]:
                free.setdefault(to, []).append(s)

        def closed(states: set[int]) -> frozenset[int]:
            todo, out = list(states), set(states)
            while todo:
                for x in free.get(todo.pop(), ()):
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            return frozenset(out)

        order = [closed({end})]
        ids, rows = {order[0]: 0}, []
        for state in order:
            row = {}
            for c in range(256):
                to = {s for x in state for chars, s in moves.get(x, ()) if c in chars}
                if to:
                    key = closed(to)
                    if key not in ids:
                        ids[key] = len(order)
                        order.append(key)
                    row[c] = ids[key]
            rows.append(row)
        return rows, {i for i, s in enumerate(order) if start in s}

    def _begin(self, data: bytes, kind: int, at: int, least: int) -> int:
        """The leftmost start of a prefix of ``kind`` that ends at ``at``."""
        rows, final = self.back[kind]
        state, best = 0, at
        for i in range(at - 1, least - 1, -1):
            state = rows[state].get(data[i], -1)
            if state < 0:
                break
            if state in final:
                best = i
        return best

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) in bytes, in that order, of every match that is long enough."""
        table, hot, s = self.table, self.hot, self.start
        open_: dict[int, tuple[int, int]] = {}
        last = [0] * len(self.rules)
        found = []
        rest = iter(data)
        n = len(data)
        for b in rest:
            s = table[s + b]
            if s >= hot or open_:
                at = n - rest.__length_hint__()  # one past this byte
                now = self.ready.get(s, ())
                for k in [k for k in open_ if k not in now]:
                    start, tail = open_.pop(k)
                    last[k] = at - 1
                    if at - 1 - tail >= self.need[k]:
                        found.append((start, k, at - 1))
                for k in now:
                    if k not in open_:
                        tail = at - self.count[k]
                        open_[k] = self._begin(data, k, tail, last[k]), tail
        found += [(start, k, n) for k, (start, tail) in open_.items() if n - tail >= self.need[k]]
        return sorted(found)


@lru_cache(maxsize=8)
def automaton(rules: tuple[Rule, ...] = BASE + MORE) -> Automaton:
    return Automaton(rules)


def spans(text: str | None, machine: Automaton | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by the rules' order; none for null."""
    machine = machine or automaton()
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    got = machine.scan(data)
    if got and len(data) != len(text):
        marks = sorted({x for a, _, b in got for x in (a, b)})
        at, chars, place = 0, 0, {}
        for m in marks:
            chars += len(data[at:m].decode("utf-8", "surrogatepass"))
            at = m
            place[m] = chars
        got = [(place[a], k, place[b]) for a, k, b in got]
    return [(machine.rules[k].kind, a, b) for a, k, b in got]


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Add ``secret_spans``: array of (kind, start, end) of every whole text, empty for null or empty texts.

    All columns and repeated rows stay; a column named secret_spans is replaced.
    """
    small_batches(df.sparkSession)
    df = df.drop("secret_spans")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)
    machine = df.sparkSession.sparkContext.broadcast(automaton(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, machine.value)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, "secret_spans"])

    return df.mapInArrow(scan, f"{fields}, secret_spans array<struct<kind:string,start:bigint,end:bigint>>")


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = BASE + MORE, mark: str = "[SECRET]") -> DataFrame:
    """Replace every secret of ``text`` by ``mark`` (overlapping spans by one mark); rows and columns stay.

    A span of a rule with a prefix is replaced as a whole, keyword included. Null stays null.
    """
    small_batches(df.sparkSession)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema.fields)

    machine = df.sparkSession.sparkContext.broadcast(automaton(rules))

    def clean(t: str | None) -> str | None:
        got = spans(t, machine.value)
        if not got:
            return t
        parts, at = [], 0
        for _, a, b in got:
            if a >= at:
                parts += [t[at:a], mark]
            at = max(at, b)
        return "".join([*parts, t[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = pa.array([clean(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    return df.mapInArrow(run, fields)
