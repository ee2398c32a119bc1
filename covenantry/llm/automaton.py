"""Deterministic automata over bytes from a small language of regular expressions.

Expressions have literals, ``\\xHH`` and escaped characters, classes ``[...]`` of characters and ranges,
groups, ``|``, ``?``, ``*``, ``+`` and ``{m}``, ``{m,}``, ``{m,n}``. A match is the leftmost one and of
these the longest; the next is sought from its end on.

``Scanner`` holds all rules in one automaton (subset construction, then minimisation), which reads each
byte once. It looks for the rules' *cores*: the matches of a rule of which no shorter beginning is a match. Every
match begins with one, so their ends lead to all places where a match can begin; cores keep the
combined automaton small, since what may follow a match need not be followed for all rules at once. Where a core
ends, the rule's reversed core, read to the left, gives the beginnings, and the rule's own automaton
the longest match from there. Both read the surroundings of hits only, each byte a bounded number of times.
"""

from __future__ import annotations

from collections.abc import Iterable

_KEPT_SETS = 10_000  # sets of a reversed core that a worker remembers; beyond, it forgets them and starts anew


def _fold(symbols: Iterable[int]) -> frozenset[int]:
    return frozenset(x for c in symbols for x in (*chr(c).lower().encode("latin-1"), *chr(c).upper().encode("latin-1")))


class _Parser:
    def __init__(self, expression: str, either_case: bool):
        self.s, self.at, self.either_case = expression, 0, either_case

    def _peek(self) -> str:
        return self.s[self.at : self.at + 1]

    def _next(self) -> str:
        self.at += 1
        return self.s[self.at - 1]

    def _character(self) -> int:
        c = self._next()
        if c == "\\":
            c = self._next()
            if c == "x":
                self.at += 2
                return int(self.s[self.at - 2 : self.at], 16)
        if ord(c) > 127:
            raise ValueError(f"only ASCII is understood in {self.s!r}")
        return ord(c)

    def _symbols(self, found: Iterable[int]) -> tuple:
        return ("set", _fold(found) if self.either_case else frozenset(found))

    def _class(self) -> tuple:
        found: set[int] = set()
        while self._peek() != "]":
            low = high = self._character()
            if self._peek() == "-" and self.s[self.at + 1] != "]":
                self.at += 1
                high = self._character()
            found.update(range(low, high + 1))
        self.at += 1
        return self._symbols(found)

    def _atom(self) -> tuple:
        if self._peek() == "(":
            self.at += 1
            inner = self.either()
            self.at += 1
            return inner
        if self._peek() == "[":
            self.at += 1
            return self._class()
        return self._symbols([self._character()])

    def _times(self) -> tuple[int, int | None] | None:
        c = self._peek()
        if c and c in "?*+":
            self.at += 1
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        if c == "{":
            end = self.s.index("}", self.at)
            low, comma, high = self.s[self.at + 1 : end].partition(",")
            self.at = end + 1
            return int(low), (int(high) if high else None) if comma else int(low)
        return None

    def _row(self) -> tuple:
        parts = []
        while self._peek() not in ("", "|", ")"):
            part = self._atom()
            while times := self._times():
                part = ("times", part, *times)
            parts.append(part)
        return ("row", *parts)

    def either(self) -> tuple:
        found = [self._row()]
        while self._peek() == "|":
            self.at += 1
            found.append(self._row())
        return ("either", *found)


def parse(expression: str, either_case: bool = False) -> tuple:
    parser = _Parser(expression, either_case)
    tree = parser.either()
    if parser.at != len(expression):
        raise ValueError(f"cannot read {expression!r} from {parser.at} on")
    return tree


class _Graph:
    """A nondeterministic automaton: per state an optional (symbols, next) and states that are reached for nothing."""

    def __init__(self):
        self.reads: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.reads.append(None)
        self.free.append([])
        return len(self.free) - 1

    def add(self, tree: tuple, begin: int) -> int:
        """States for ``tree`` from ``begin`` on; the state where it ends."""
        kind, *parts = tree
        if kind == "set":
            end = self.state()
            read = self.state()
            self.free[begin].append(read)
            self.reads[read] = (parts[0], end)
            return end
        if kind == "row":
            for part in parts:
                begin = self.add(part, begin)
            return begin
        if kind == "either":
            end = self.state()
            for part in parts:
                self.free[self.add(part, begin)].append(end)
            return end
        part, low, high = parts
        for _ in range(low):
            begin = self.add(part, begin)
        if high is None:
            loop = self.state()
            self.free[begin].append(loop)
            self.free[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        for _ in range(high - low):
            self.free[begin].append(end)
            begin = self.add(part, begin)
        self.free[begin].append(end)
        return end

    def add_core(self, own: Automaton, begin: int) -> int:
        """States for the matches of ``own`` of which no shorter beginning is a match; the state where they end."""
        end = self.state()
        states = {own.start: begin}
        for s in range(0, own.first_match, own.width):
            if s not in states:
                states[s] = self.state()
        for s, state in states.items():
            leads: dict[int, set[int]] = {}
            for symbol in range(256):
                t = own.table[s + own.classes[symbol]]
                if t != own.dead:
                    leads.setdefault(end if t >= own.first_match else states[t], set()).add(symbol)
            for target, symbols in leads.items():
                read = self.state()
                self.free[state].append(read)
                self.reads[read] = (frozenset(symbols), target)
        return end

    def closure(self, states: Iterable[int]) -> frozenset[int]:
        found, open_ = set(states), list(states)
        while open_:
            for nxt in self.free[open_.pop()]:
                if nxt not in found:
                    found.add(nxt)
                    open_.append(nxt)
        return frozenset(found)

    def step(self, states: Iterable[int], symbol: int) -> frozenset[int]:
        return self.closure({self.reads[s][1] for s in states if self.reads[s] and symbol in self.reads[s][0]})


def _byte_classes(graph: _Graph) -> tuple[bytes, list[int]]:
    """The class of each byte (bytes that no expression tells apart share one) and a byte of each class."""
    sets = list({x[0] for x in graph.reads if x})
    numbers: dict[tuple, int] = {}
    table = bytes(numbers.setdefault(tuple(b in s for s in sets), len(numbers)) for b in range(256))
    return table, [table.index(k) for k in range(len(numbers))]


def _minimised(moves: list[list[int]], marks: list[frozenset]) -> tuple[list[list[int]], list[frozenset], list[int]]:
    """Equivalent states become one: states are split by their marks, then by where each symbol leads, until none splits."""
    names: dict = {}
    block = [names.setdefault(m, len(names)) for m in marks]
    while True:
        names = {}
        finer = [names.setdefault((block[s], *(block[t] for t in row)), len(names)) for s, row in enumerate(moves)]
        if len(names) == len(set(block)):
            break
        block = finer
    first = {b: s for s, b in reversed(list(enumerate(block)))}
    return [[block[t] for t in moves[first[b]]] for b in range(len(first))], [marks[first[b]] for b in range(len(first))], block


class Automaton:
    """A minimal deterministic automaton. ``table[s + c]`` is the next state for the class c of a byte; a state's
    number is a multiple of the number of classes, and states with a match are the last ones."""

    def __init__(self, graph: _Graph, starts: list[int], ends: dict[int, int], anywhere: bool = False):
        self.classes, sample = _byte_classes(graph)
        begin = graph.closure(starts)
        sets, moves, marks, todo = {begin: 0}, [], [], [begin]
        for states in todo:
            row = []
            for symbol in sample:
                nxt = graph.step(states | begin if anywhere else states, symbol)
                if nxt not in sets:
                    sets[nxt] = len(sets)
                    todo.append(nxt)
                row.append(sets[nxt])
            moves.append(row)
            marks.append(frozenset(ends[s] for s in states if s in ends))
        moves, marks, block = _minimised(moves, marks)
        order = sorted(range(len(moves)), key=lambda s: (bool(marks[s]), s))
        place = {s: k * len(sample) for k, s in enumerate(order)}
        self.width, self.start = len(sample), place[block[0]]
        self.table = [place[t] for s in order for t in moves[s]]
        self.marks = [tuple(sorted(marks[s])) for s in order]
        self.first_match = sum(not m for m in self.marks) * self.width
        # the state from which no match can be reached, if there is one
        dead = [place[s] for s in range(len(moves)) if not marks[s] and set(moves[s]) == {s}]
        self.dead = dead[0] if dead else -1

    @classmethod
    def of(cls, tree: tuple) -> Automaton:
        """The automaton of one expression, from its first byte on."""
        graph = _Graph()
        begin = graph.state()
        return cls(graph, [begin], {graph.add(tree, begin): 0})

    @classmethod
    def of_cores(cls, owns: list[Automaton]) -> Automaton:
        """The automaton of the cores of several expressions, which may begin at any place."""
        graph = _Graph()
        starts = [graph.state() for _ in owns]
        ends = {graph.add_core(own, s): k for k, (own, s) in enumerate(zip(owns, starts, strict=True))}
        return cls(graph, starts, ends, anywhere=True)

    @property
    def n_states(self) -> int:
        return len(self.marks)

    def longest(self, data: bytes, begin: int) -> int:
        """The end of the longest match that begins at ``begin``; -1 if there is none."""
        table, classes, s, end = self.table, self.classes, self.start, -1
        if s >= self.first_match:
            end = begin
        for at in range(begin, len(data)):
            s = table[s + classes[data[at]]]
            if s >= self.first_match:
                end = at + 1
            elif s == self.dead:
                break
        return end


def _reversed(tree: tuple) -> tuple:
    kind, *parts = tree
    if kind == "set":
        return tree
    if kind == "times":
        return (kind, _reversed(parts[0]), *parts[1:])
    return (kind, *(_reversed(x) for x in (reversed(parts) if kind == "row" else parts)))


class _Backward:
    """An expression read to the left from known ends; its sets of states are made when a text asks for them.

    A set that is met again is looked up, so each byte left of an end costs one step, however many ends reach it."""

    def __init__(self, tree: tuple):
        self.graph = _Graph()
        begin = self.graph.state()
        self.end = self.graph.add(_reversed(tree), begin)
        self.begin = self.graph.closure([begin])
        self.known: dict[tuple, frozenset[int]] = {}

    def _step(self, states: frozenset[int], symbol: int, ends_here: bool) -> frozenset[int]:
        key = (states, symbol, ends_here)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= _KEPT_SETS:
                self.known.clear()
            found = self.known[key] = self.graph.step(states | self.begin if ends_here else states, symbol)
        return found

    def begins(self, data: bytes, ends: list[int]) -> list[int]:
        """Places, ascending, where a match begins that ends at one of ``ends`` (ascending)."""
        found, states, k, at = [], frozenset(), len(ends) - 1, 0
        while states or k >= 0:
            if not states:
                at = ends[k]
            here = k >= 0 and ends[k] == at
            k -= here
            if at == 0:
                break
            at -= 1
            states = self._step(states, data[at], here)
            if self.end in states:
                found.append(at)
        return found[::-1]


class Scanner:
    """Finds all rules (expression, either_case) in one pass over the bytes of a text; no rule may match an empty text."""

    def __init__(self, rules: list[tuple[str, bool]]):
        trees = [parse(*rule) for rule in rules]
        self.own = [Automaton.of(tree) for tree in trees]
        if any(x.start >= x.first_match for x in self.own):
            raise ValueError("a rule matches the empty text")
        self.combined = Automaton.of_cores(self.own)
        self.backward = [_Backward(tree) for tree in trees]

    def core_ends(self, data: bytes) -> dict[int, list[int]]:
        """For each rule that occurs, the ends of its shortest matches, ascending."""
        found: dict[int, list[int]] = {}
        combined = self.combined
        table, s, hit = combined.table, combined.start, combined.first_match
        for at, c in enumerate(data.translate(combined.classes), 1):
            s = table[s + c]
            if s >= hit:
                for rule in combined.marks[s // combined.width]:
                    found.setdefault(rule, []).append(at)
        return found

    def matches(self, data: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each rule that occurs, its leftmost longest matches, none of which overlap."""
        found = {}
        for rule, ends in self.core_ends(data).items():
            spans, free = [], 0
            for begin in self.backward[rule].begins(data, ends):
                if begin >= free:
                    free = self.own[rule].longest(data, begin)
                    spans.append((begin, free))
            found[rule] = spans
        return found
