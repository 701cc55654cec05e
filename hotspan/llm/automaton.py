"""Byte automata: rules compiled by subset construction and minimised.

The rules are regular expressions over bytes without anchors, captures or
back references: literals, ``[...]``, ``(a|b)``, ``? * + {m,} {m,n}``, ``\\xHH``
and escaped characters. The compiled form is a transition array.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np


class _Net:
    """A nondeterministic automaton, grown piece by piece."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def node(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1


class _Rule:
    """Reads one rule; ``build`` adds it to a net behind a given node, read from its end if ``backward``."""

    TOKEN = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|\[((?:\\.|[^\]\\])+)\]|(\{\d+(?:,\d*)?\})|([()|?*+])|(.)", re.S)

    def __init__(self, text: str, ignore_case: bool, backward: bool = False) -> None:
        self.tokens, self.backward = list(self.TOKEN.finditer(text)), backward
        self.at, self.ignore_case = 0, ignore_case
        self.tree = self._choice()

    def _bytes(self, chars: set[int]) -> frozenset[int]:
        if self.ignore_case:
            chars = chars | {ord(x) for c in chars for x in (chr(c).lower() + chr(c).upper()) if ord(x) < 128}
        return frozenset(chars)

    def _set(self, body: str) -> set[int]:
        items = [int(m[1], 16) if m[1] else ord((m[2] or m[3])[0]) for m in re.finditer(r"\\x([0-9A-Fa-f]{2})|\\(.)|(.)", body)]
        out, i = set(), 0
        while i < len(items):
            if i + 2 < len(items) and items[i + 1] == ord("-"):
                out |= set(range(items[i], items[i + 2] + 1))
                i += 3
            else:
                out.add(items[i])
                i += 1
        return out

    def _peek(self) -> str:
        return self.tokens[self.at][5] or "" if self.at < len(self.tokens) else ")"

    def _choice(self):
        parts = [self._sequence()]
        while self.at < len(self.tokens) and self._peek() == "|":
            self.at += 1
            parts.append(self._sequence())
        return ("or", parts)

    def _sequence(self):
        parts = []
        while self.at < len(self.tokens) and self._peek() not in ("|", ")"):
            token = self.tokens[self.at]
            self.at += 1
            if token[5] == "(":
                part = self._choice()
                self.at += 1
            elif token[3]:
                part = ("set", self._bytes(self._set(token[3])))
            else:
                part = ("set", self._bytes({int(token[1], 16) if token[1] else ord(token[2] or token[6])}))
            if self.at < len(self.tokens) and (self._peek() in ("?", "*", "+") and self._peek() or self.tokens[self.at][4]):
                token = self.tokens[self.at]
                self.at += 1
                if token[4]:
                    low, _, high = token[4][1:-1].partition(",")
                    least, most = int(low), (int(high) if high else None if "," in token[4] else int(low))
                else:
                    least, most = {"?": (0, 1), "*": (0, None), "+": (1, None)}[token[5]]
                part = ("times", part, least, most)
            parts.append(part)
        return ("then", parts)

    def build(self, net: _Net, start: int, tree=None) -> int:
        tree = tree or self.tree
        if tree[0] == "set":
            end = net.node()
            net.moves[start].append((tree[1], end))
            return end
        if tree[0] == "then":
            for part in reversed(tree[1]) if self.backward else tree[1]:
                start = self.build(net, start, part)
            return start
        end = net.node()
        if tree[0] == "or":
            for part in tree[1]:
                net.free[self.build(net, start, part)].append(end)
            return end
        _, part, least, most = tree
        for _ in range(least):
            start = self.build(net, start, part)
        if most is None:
            loop = net.node()
            net.free[start].append(loop)
            net.free[self.build(net, loop, part)].append(loop)
            net.free[loop].append(end)
        else:
            net.free[start].append(end)
            for _ in range(most - least):
                start = self.build(net, start, part)
                net.free[start].append(end)
        return end


@dataclass
class Automaton:
    """``table[state, group[byte]]`` is the next state; ``accepts[state]`` the bit mask of matched rules.

    State 0 is the start.
    """

    table: np.ndarray
    group: np.ndarray
    accepts: np.ndarray

    @property
    def resets(self) -> np.ndarray:
        """The bytes that lead back to the start from every state."""
        return (self.table == 0).all(axis=0)[self.group]

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match that begins at ``at``, or -1."""
        rows, state, end = self.rows, 0, -1
        for i in range(at, len(data)):
            state = rows[state][data[i]]
            if state == self.dead:
                break
            if self.accepting[state]:
                end = i + 1
        return end

    def marks(self, data: bytes) -> list[int]:
        """The masks of accepted rules after each byte, reading from the end; one step a byte."""
        rows, accepts, state = self.rows, self.accepting, 0
        out = [0] * len(data)
        for i in range(len(data) - 1, -1, -1):
            state = rows[state][data[i]]
            out[i] = accepts[state]
        return out

    @cached_property
    def rows(self) -> list[list[int]]:
        return self.table[:, self.group].tolist()

    @cached_property
    def accepting(self) -> list[int]:
        return self.accepts.tolist()

    @cached_property
    def dead(self) -> int:
        """The state without a way out or a match, or -1."""
        stuck = (self.table == np.arange(len(self.table))[:, None]).all(axis=1) & (self.accepts == 0)
        return int(np.flatnonzero(stuck)[0]) if stuck.any() else -1

    def shortest(self) -> int:
        """Length of the shortest accepted input."""
        seen, front, steps = {0}, {0}, 0
        while front and not any(self.accepts[s] for s in front):
            front = {int(t) for s in front for t in self.table[s]} - seen
            seen |= front
            steps += 1
        return steps


def compile_rules(rules: list[tuple[str, bool]], anchored: bool = False, backward: bool = False) -> Automaton:
    """One minimal automaton for all ``(expression, ignore case)`` rules.

    Without ``anchored`` it accepts wherever a match of a rule ends. A
    ``backward`` one reads its input from the end, so it accepts wherever a
    match begins.
    """
    net = _Net()
    start = net.node()
    accepting: dict[int, int] = {}
    for bit, (text, ignore_case) in enumerate(rules):
        first = net.node()
        net.free[start].append(first)
        accepting[_Rule(text, ignore_case, backward).build(net, first)] = 1 << bit

    signature = [tuple(b in s for moves in net.moves for s, _ in moves) for b in range(256)]
    kinds = {k: i for i, k in enumerate(dict.fromkeys(signature))}
    group = np.array([kinds[s] for s in signature], np.int64)
    sample = [int(np.flatnonzero(group == g)[0]) for g in range(len(kinds))]

    def close(nodes: set[int]) -> frozenset[int]:
        todo, out = list(nodes), set(nodes)
        while todo:
            for n in net.free[todo.pop()]:
                if n not in out:
                    out.add(n)
                    todo.append(n)
        return frozenset(out)

    reach = [[close({t}) for _, t in moves] for moves in net.moves]
    begin = close({start})
    states, order, table = {begin: 0}, [begin], []
    for state in order:
        row = []
        for byte in sample:
            goal: set[int] = set() if anchored else set(begin)
            for n in state:
                for (s, _), r in zip(net.moves[n], reach[n], strict=True):
                    if byte in s:
                        goal |= r
            key = frozenset(goal)
            if key not in states:
                states[key] = len(order)
                order.append(key)
            row.append(states[key])
        table.append(row)
    full = np.array(table, np.int64)
    accepts = np.array([sum(bit for n, bit in accepting.items() if n in s) for s in order], np.int64)

    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # states stay together while all their ways lead to the same parts
        _, first, finer = np.unique(np.column_stack([part, part[full]]), axis=0, return_index=True, return_inverse=True)
        finer = finer.reshape(-1)
        if len(first) == part.max() + 1:
            break
        part = finer
    rank = {int(p): i for i, p in enumerate(dict.fromkeys(part.tolist()))}
    number = np.array([rank[int(p)] for p in part])
    keep = np.array([int(np.flatnonzero(number == i)[0]) for i in range(len(rank))])
    return Automaton(number[full[keep]].astype(np.int32), group.astype(np.int32), accepts[keep])
