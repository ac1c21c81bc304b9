"""Generalised LL recognition over recursive transition networks with a graph-structured stack.

A grammar is text in EBNF: 'x' a token by its text, UPPER a class of tokens, lower a rule, [ ] optional, { } repeated,
( | ) alternatives. !'x' takes a token only without a line break before it. @name lets through the dialects of that
name. Every rule's right side becomes a deterministic automaton; calls share stack nodes by rule and position, and
descriptors carry the set of dialects that still accept, so all dialects of a language run together in one parse.
Lookahead sets choose the moves of a state; where they leave one, the parser goes on without scheduling anything.
"""

from __future__ import annotations

import re
from collections import defaultdict

_SYMBOL = re.compile(r"\s+|(?P<guard>@\w+)|(?P<literal>!?'[^']+')|(?P<name>[A-Za-z_]\w*)|(?P<sign>[=;|(){}\[\]])|#[^\n]*")
END = "$"


class Grammar:
    def __init__(self, text: str, start: str, dialects: tuple[str, ...], breaks: bool = False, eos: str | None = None, barred: dict[str, set[str]] | None = None, inline: tuple[str, ...] = ()):
        """breaks: tokens after a line break have a ~ at their end. eos: a rule that may be empty only before a closing
        brace, the end, or after a line break. barred: tokens with which a rule must not begin. inline: rules that
        are copied to where they are used, which saves calls; they must not contain themselves."""
        self.dialects, self.breaks = dialects, breaks
        self.bits = {d: 1 << i for i, d in enumerate(dialects)}
        self._arcs: list[list[tuple]] = []  # of the nondeterministic automata
        rules = self._rules(text, frozenset(inline))
        self.rules = rules
        self.moves: list[dict[tuple, int]] = []  # of the deterministic ones
        self.accepts: list[bool] = []
        self.owner: list[str] = []
        self.start_of = {name: self._determine(name, a, b) for name, (a, b) in rules.items()}
        self._lookahead(start, eos)
        for rule, tokens in (barred or {}).items():
            for state in range(len(self.moves)):
                for (kind, x) in self.moves[state]:
                    if kind == "c" and x == rule:
                        row, call = self.table[state], self.start_of[rule]
                        for t in tokens | {t + "~" for t in tokens}:
                            if t in row:
                                row[t] = tuple(m for m in row[t] if not (m[0] == 1 and m[1] == call))
        self.start = self.start_of[start]

    # text to automata
    def _new(self) -> int:
        self._arcs.append([])
        return len(self._arcs) - 1

    def _rules(self, text: str, inline: frozenset[str]) -> dict[str, tuple[int, int]]:
        symbols = [(m.lastgroup, m.group()) for m in _SYMBOL.finditer(text) if m.lastgroup]
        bodies: dict[str, int] = {}
        at = 0
        while at < len(symbols):  # names of rules and where their right sides begin
            assert symbols[at + 1][1] == "=", (symbols[at], symbols[at + 1])
            bodies[symbols[at][1]] = at = at + 2
            while symbols[at] != ("sign", ";"):
                at += 1
            at += 1

        def sequence(at: int, stops: str) -> tuple[int, int, int]:
            """(first state, last state, position of the sign that ends it)."""
            first, last = self._new(), self._new()
            here = self._new()
            self._arcs[first].append((None, here))
            while True:
                kind, s = symbols[at]
                if kind == "sign" and s in stops:
                    self._arcs[here].append((None, last))
                    return first, last, at
                at += 1
                if s == "|":
                    self._arcs[here].append((None, last))
                    here = self._new()
                    self._arcs[first].append((None, here))
                    continue
                after = self._new()
                if kind == "sign":
                    a, b, at = sequence(at, {"(": ")", "[": "]", "{": "}"}[s])
                    at += 1
                    self._arcs[here].append((None, a))
                    self._arcs[b].append((None, after))
                    if s in "[{":
                        self._arcs[here].append((None, after))
                    if s == "{":
                        self._arcs[b].append((None, a))
                elif kind == "guard":
                    self._arcs[here].append((("g", self.bits.get(s[1:], 0)), after))
                elif kind == "literal" or s.isupper():
                    tight = s[0] == "!"
                    name = s.lstrip("!").strip("'")
                    self._arcs[here].append((("t", name), after))
                    if self.breaks and not tight:
                        self._arcs[here].append((("t", name + "~"), after))
                elif s in inline:
                    a, b, _ = sequence(bodies[s], ";")
                    self._arcs[here].append((None, a))
                    self._arcs[b].append((None, after))
                else:
                    self._arcs[here].append((("c", s), after))
                here = after

        return {name: sequence(at, ";")[:2] for name, at in bodies.items() if name not in inline}

    def _determine(self, name: str, first: int, last: int) -> int:
        def closure(states):
            todo, seen = list(states), set(states)
            while todo:
                for label, to in self._arcs[todo.pop()]:
                    if label is None and to not in seen:
                        seen.add(to)
                        todo.append(to)
            return frozenset(seen)

        ids: dict[frozenset, int] = {}

        def number(s):
            if s not in ids:
                ids[s] = len(self.moves)
                self.moves.append({})
                self.accepts.append(last in s)
                self.owner.append(name)
                todo.append(s)
            return ids[s]

        todo: list[frozenset] = []
        start = number(closure([first]))
        while todo:
            s = todo.pop()
            by = defaultdict(set)
            for q in s:
                for label, to in self._arcs[q]:
                    if label is not None:
                        by[label].add(to)
            for label, to in by.items():
                self.moves[ids[s]][label] = number(closure(to))
        return start

    # lookahead
    def _lookahead(self, start: str, eos: str | None) -> None:
        n = len(self.moves)
        empty = list(self.accepts)
        first: list[set] = [set() for _ in range(n)]
        changed = True
        while changed:
            changed = False
            for s in range(n):
                size, was = len(first[s]), empty[s]
                for (kind, x), to in self.moves[s].items():
                    if kind == "t":
                        first[s].add(x)
                    elif kind == "c":
                        c = self.start_of[x]
                        first[s] |= first[c]
                        if empty[c]:
                            first[s] |= first[to]
                            empty[s] |= empty[to]
                    else:
                        first[s] |= first[to]
                        empty[s] |= empty[to]
                changed |= len(first[s]) != size or empty[s] != was
        follow: dict[str, set] = {name: set() for name in self.rules}
        follow[start] |= {END, END + "~"}
        changed = True
        while changed:
            changed = False
            for s in range(n):
                for (kind, x), to in self.moves[s].items():
                    if kind == "c":
                        more = first[to] | (follow[self.owner[s]] if empty[to] else set())
                        if not more <= follow[x]:
                            follow[x] |= more
                            changed = True
        everything = {x for m in self.moves for kind, x in m if kind == "t"} | {END, END + "~"}
        self.table: list[dict[str, tuple]] = []
        for s in range(n):
            row = defaultdict(list)
            for (kind, x), to in self.moves[s].items():
                if kind == "t":
                    row[x].append((0, to, 0))
                elif kind == "c":
                    c = self.start_of[x]
                    for t in first[c] | ((first[to] | (follow[self.owner[s]] if empty[to] else set())) if empty[c] else set()):
                        row[t].append((1, c, to))
                else:
                    for t in first[to] | (follow[self.owner[s]] if empty[to] else set()):
                        row[t].append((3, to, x))
            if self.accepts[s]:
                allowed = follow[self.owner[s]]
                if self.owner[s] == eos and s == self.start_of[eos]:
                    allowed = {t for t in everything if t.endswith("~") or t in ("}", END)}
                for t in allowed:
                    row[t].append((2, 0, 0))
            self.table.append({t: tuple(a) for t, a in row.items()})


class _Node:
    __slots__ = ("edges", "pops", "seen", "mask")

    def __init__(self, mask: int):
        self.edges: dict = {}
        self.pops: dict[int, int] = {}
        self.seen: dict[tuple[int, int], int] = {}
        self.mask = mask


def recognise(grammar: Grammar, tokens: list[str], mask: int | None = None) -> tuple[int, int]:
    """(set of dialects that accept, furthest token reached). tokens: types, without the end mark."""
    table = grammar.table
    kinds = tokens + [END]
    n = len(tokens)
    every = (1 << len(grammar.dialects)) - 1
    mask = every if mask is None else mask
    root = _Node(mask)
    nodes: dict[tuple[int, int], _Node] = {}
    todo = [(grammar.start, root, 0, mask)]
    far = 0
    while todo:
        state, node, pos, mask = todo.pop()
        while True:
            moves = table[state].get(kinds[pos])
            if not moves:
                if pos > far:
                    far = pos
                break
            if len(moves) > 1:
                if pos > far:
                    far = pos
                for kind, a, b in moves:
                    _move(todo, kind, a, b, node, pos, mask, nodes)
                break
            kind, a, b = moves[0]
            if kind == 0:
                state = a
                pos += 1
                continue
            if kind == 1 and (a, pos) not in nodes:
                child = nodes[a, pos] = _Node(mask)
                child.edges[b, node] = mask
                state, node = a, child
                continue
            if kind == 2 and len(node.edges) == 1 and pos not in node.pops:
                node.pops[pos] = mask
                ((ret, parent), m) = next(iter(node.edges.items()))
                seen = parent.seen.get((ret, pos), 0)
                if mask := m & mask & ~seen:
                    parent.seen[ret, pos] = seen | mask
                    state, node = ret, parent
                    continue
                break
            if pos > far:
                far = pos
            _move(todo, kind, a, b, node, pos, mask, nodes)
            break
    return root.pops.get(n, 0), far


def _schedule(todo, state, node, pos, mask):
    seen = node.seen.get((state, pos), 0)
    if new := mask & ~seen:
        node.seen[state, pos] = seen | new
        todo.append((state, node, pos, new))


def _move(todo, kind, a, b, node, pos, mask, nodes):
    """A move that may meet others: consume, call, return or let dialects through."""
    if kind == 0:
        todo.append((a, node, pos + 1, mask))
    elif kind == 1:
        child = nodes.get((a, pos))
        if child is None:
            child = nodes[a, pos] = _Node(mask)
            child.edges[b, node] = mask
            todo.append((a, child, pos, mask))
            return
        old = child.edges.get((b, node), 0)
        if new := mask & ~old:
            child.edges[b, node] = old | new
            for p, m in list(child.pops.items()):
                if m & new:
                    _schedule(todo, b, node, p, m & new)
            if more := mask & ~child.mask:
                child.mask |= more
                todo.append((a, child, pos, more))
    elif kind == 2:
        old = node.pops.get(pos, 0)
        if new := mask & ~old:
            node.pops[pos] = old | new
            for (ret, parent), m in list(node.edges.items()):
                if m & new:
                    _schedule(todo, ret, parent, pos, m & new)
    elif m := mask & b:
        todo.append((a, node, pos, m))
