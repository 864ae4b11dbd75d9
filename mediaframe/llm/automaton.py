"""Rules of one regular dialect compiled into one minimal deterministic automaton over bytes.

The dialect: literals, ``[...]`` classes with ranges, groups, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``
and ``\\xNN``. Every rule is a regular language, so the automaton finds the leftmost longest match.
"""

from __future__ import annotations

from operator import length_hint

import numpy as np


class Parser:
    """Thompson construction: states hold byte-set moves and empty moves."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def rule(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.text, self.at, self.fold = pattern, 0, fold
        return self.build(self.choice())

    def choice(self):
        options = [self.sequence()]
        while self.at < len(self.text) and self.text[self.at] == "|":
            self.at += 1
            options.append(self.sequence())
        return ("or", options) if len(options) > 1 else options[0]

    def sequence(self):
        items = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            items.append(self.repeat(self.atom()))
        return ("seq", items)

    def repeat(self, item):
        while self.at < len(self.text) and self.text[self.at] in "?*+{":
            sign = self.text[self.at]
            self.at += 1
            if sign == "{":
                body, self.at = self.text[self.at : self.text.index("}", self.at)], self.text.index("}", self.at) + 1
                low, comma, high = body.partition(",")
                least, most = int(low), int(high) if high else (None if comma else int(low))
            else:
                least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[sign]
            item = ("rep", item, least, most)
        return item

    def atom(self):
        sign = self.text[self.at]
        self.at += 1
        if sign == "(":
            inner = self.choice()
            self.at += 1
            return inner
        if sign == "[":
            found: set[int] = set()
            while self.text[self.at] != "]":
                first = self.byte()
                if self.text[self.at] == "-" and self.text[self.at + 1] != "]":
                    self.at += 1
                    found.update(range(first, self.byte() + 1))
                else:
                    found.add(first)
            self.at += 1
            return ("set", self.cased(found))
        self.at -= 1
        return ("set", self.cased({self.byte()}))

    def byte(self) -> int:
        sign = self.text[self.at]
        self.at += 1
        if sign == "\\":
            kind = self.text[self.at]
            self.at += 1
            if kind == "x":
                self.at += 2
                return int(self.text[self.at - 2 : self.at], 16)
            return ord(kind)
        return ord(sign)

    def cased(self, found: set[int]) -> frozenset:
        if self.fold:
            found |= {b ^ 32 for b in found if chr(b).isalpha()}
        return frozenset(found)

    def build(self, node) -> tuple[int, int]:
        start, end = self.state(), self.state()
        if node[0] == "set":
            self.moves[start].append((node[1], end))
        elif node[0] == "seq":
            last = start
            for item in node[1]:
                a, b = self.build(item)
                self.empty[last].append(a)
                last = b
            self.empty[last].append(end)
        elif node[0] == "or":
            for item in node[1]:
                a, b = self.build(item)
                self.empty[start].append(a)
                self.empty[b].append(end)
        else:
            _, item, least, most = node
            last = start
            for _ in range(least):
                a, b = self.build(item)
                self.empty[last].append(a)
                last = b
            if most is None:
                a, b = self.build(item)
                self.empty[last] += [a, end]
                self.empty[b] += [a, end]
            else:
                for _ in range(most - least):
                    self.empty[last].append(end)
                    a, b = self.build(item)
                    self.empty[last].append(a)
                    last = b
                self.empty[last].append(end)
        return start, end


def reverse(empty, moves):
    back_empty, back_moves = [[] for _ in empty], [[] for _ in moves]
    for s, targets in enumerate(empty):
        for t in targets:
            back_empty[t].append(s)
    for s, targets in enumerate(moves):
        for found, t in targets:
            back_moves[t].append((found, s))
    return back_empty, back_moves


def determinise(empty, moves, starts, accepts: dict[int, int], restart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Subset construction. ``accepts``: end state -> rule number. With ``restart`` a match may begin at
    every byte. Returns transitions (states, 256) and the bit set of rules each state accepts; state 0 is
    the start, and without ``restart`` the last state is dead."""
    signature: dict[bytes, list[int]] = {}
    sets = list({found for row in moves for found, _ in row})
    member = np.zeros((256, max(1, len(sets))), bool)
    for j, found in enumerate(sets):
        member[list(found), j] = True
    for b in range(256):
        signature.setdefault(member[b].tobytes(), []).append(b)
    classes = list(signature.values())
    has = {found: {k for k, cls in enumerate(classes) if cls[0] in found} for found in sets}

    def close(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if moves[s] or s in accepts)

    first = close(starts)
    number, order, rows = {first: 0}, [first], []
    for states in order:
        targets = [set() for _ in classes]
        for s in states:
            for found, t in moves[s]:
                for k in has[found]:
                    targets[k].add(t)
        row = []
        for target in targets:
            key = close(target) | first if restart else close(target)
            if key not in number:
                number[key] = len(order)
                order.append(key)
            row.append(number[key])
        rows.append(row)
    table = np.zeros((len(order), 256), np.int32)
    compact = np.array(rows, np.int32).reshape(len(order), len(classes))
    for k, cls in enumerate(classes):
        table[:, cls] = compact[:, [k]]
    marks = np.array([sum(1 << r for r in {accepts[s] for s in states if s in accepts}) for states in order], np.int64)
    return minimise(table, marks)


def minimise(table: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement; the start keeps number 0."""
    _, block = np.unique(marks, return_inverse=True)
    columns = np.unique(table, axis=1)
    while True:
        _, finer = np.unique(np.column_stack((block[:, None], block[columns])), axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    seen = np.full(block.max() + 1, -1)
    heads = []
    for s, b in enumerate(block.tolist()):
        if seen[b] < 0:
            seen[b] = len(heads)
            heads.append(s)
    return seen[block[table[heads]]].astype(np.int32), marks[heads]


class Scanner:
    """All rules in one pass over the bytes; where a rule's end is met, its own backward and forward
    automata settle the leftmost start and the longest end."""

    def __init__(self, rules: list[tuple[str, str, bool]]) -> None:
        """``rules``: (kind, pattern, letters in either case)."""
        nfa = Parser()
        ends = [nfa.rule(pattern, fold) for _, pattern, fold in rules]
        self.kinds = [kind for kind, _, _ in rules]
        table, marks = determinise(nfa.empty, nfa.moves, [a for a, _ in ends], {b: r for r, (_, b) in enumerate(ends)}, True)
        self.table, self.marks = table, marks
        back = reverse(nfa.empty, nfa.moves)
        self.forward = [self._single(nfa.empty, nfa.moves, a, b) for a, b in ends]
        self.backward = [self._single(*back, b, a) for a, b in ends]

    @staticmethod
    def _single(empty, moves, start: int, end: int):
        table, marks = determinise(empty, moves, [start], {end: 0}, False)
        own = np.arange(len(table))
        dead = np.flatnonzero((table == own[:, None]).all(axis=1) & (marks == 0))
        return [row.tolist() for row in table], [bool(m) for m in marks], int(dead[0]) if len(dead) else -1

    def compiled(self) -> "Runner":
        return Runner(self)


class Runner:
    """A task's copy of the automaton: a state is a list of the 256 next lists, and None stands for a next
    state that ends a match, so that the loop over bytes does one look-up and one test."""

    def __init__(self, scanner: Scanner) -> None:
        self.kinds, self.forward, self.backward = scanner.kinds, scanner.forward, scanner.backward
        rules = [[r for r in range(len(self.kinds)) if m >> r & 1] for m in scanner.marks.tolist()]
        nodes: list[list] = [[] for _ in rules]
        self.ends: dict[int, dict[int, tuple[list, list[int]]]] = {}
        for s, row in enumerate(scanner.table.tolist()):
            nodes[s].extend(None if rules[t] else nodes[t] for t in row)
            if ends := {b: (nodes[t], rules[t]) for b, t in enumerate(row) if rules[t]}:
                self.ends[id(nodes[s])] = ends
        self.start, self.nodes = nodes[0], nodes

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of each rule's leftmost longest non-overlapping matches, by end."""
        node, found, size = self.start, [], len(data)
        done = [0] * len(self.kinds)
        todo = iter(data)
        for b in todo:
            after = node[b]
            if after is None:
                after, rules = self.ends[id(node)][b]
                at = size - length_hint(todo)
                for r in rules:
                    if at > done[r]:
                        start = self._start(r, data, at, done[r])
                        if start >= 0:
                            done[r] = end = self._end(r, data, start)
                            found.append((start, end, r))
            node = after
        return found

    def _start(self, r: int, data: bytes, at: int, least: int) -> int:
        table, marks, dead = self.backward[r]
        state, start = 0, -1
        while at > least:
            at -= 1
            state = table[state][data[at]]
            if state == dead:
                break
            if marks[state]:
                start = at
        return start

    def _end(self, r: int, data: bytes, at: int) -> int:
        table, marks, dead = self.forward[r]
        state, end, size = 0, at, len(data)
        while at < size:
            state = table[state][data[at]]
            at += 1
            if state == dead:
                break
            if marks[state]:
                end = at
        return end
