"""Regular expressions over bytes compiled to one minimal deterministic automaton in transition arrays.

Syntax: literals, escapes (\\d \\w \\s and punctuation), classes, groups (?:...), alternation, ? * + {m} {m,} {m,n}, a leading
(?i), and \\b at either end, before a first or after a last word character. Classes hold ASCII only.
"""

from __future__ import annotations

import numpy as np

#: Stands before the first, between any two and after the last text; it can't occur in UTF-8.
SEPARATOR = 0xFF
WORD = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")
_ALL = frozenset(range(256))
_ESCAPES = {"d": frozenset(b"0123456789"), "w": WORD, "s": frozenset(b" \t\n\r\f"), "t": frozenset(b"\t"), "n": frozenset(b"\n")}


class Nfa:
    """Thompson's construction; edges[state] is a list of (bytes or None, state)."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset | None, int]]] = []

    def state(self) -> int:
        self.edges.append([])
        return len(self.edges) - 1

    def rule(self, pattern: str, start: int) -> int:
        """Adds a rule from start on; gives its accepting state, which a closing \\b moves to after the next byte."""
        fold = pattern.startswith("(?i)")
        body = pattern[4:] if fold else pattern
        opens, closes = body.startswith("\\b"), body.endswith("\\b")
        body = body[2 * opens : len(body) - 2 * closes]
        tree, rest = _parse(body, 0, fold)
        if rest != len(body):
            raise ValueError(f"unexpected {body[rest]!r} in {pattern!r}")
        if opens:
            start, before = self.state(), start
            self.edges[before].append((_ALL - WORD, start))
        end = self.build(tree, start)
        if closes:
            after = self.state()
            self.edges[end].append((_ALL - WORD, after))
            end = after
        return end

    def build(self, tree, at: int) -> int:
        kind, value = tree[0], tree[1]
        if kind == "set":
            to = self.state()
            self.edges[at].append((value, to))
            return to
        if kind == "cat":
            for part in value:
                at = self.build(part, at)
            return at
        if kind == "alt":
            to = self.state()
            for part in value:
                begin = self.state()
                self.edges[at].append((None, begin))
                self.edges[self.build(part, begin)].append((None, to))
            return to
        low, high = tree[2], tree[3]
        for _ in range(low):
            at = self.build(value, at)
        if high is None:
            loop = self.state()
            self.edges[at].append((None, loop))
            self.edges[self.build(value, loop)].append((None, loop))
            return loop
        to = self.state()
        self.edges[at].append((None, to))
        for _ in range(high - low):
            at = self.build(value, at)
            self.edges[at].append((None, to))
        return to

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for on, to in self.edges[todo.pop()]:
                if on is None and to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


def _parse(p: str, i: int, fold: bool):
    """An alternation from i on, and where it ends."""
    options, parts = [], []
    while i < len(p) and p[i] != ")":
        if p[i] == "|":
            options.append(("cat", parts))
            parts, i = [], i + 1
            continue
        if p[i] == "(":
            i += 3 if p.startswith("(?:", i) else 1
            item, i = _parse(p, i, fold)
            if i >= len(p):
                raise ValueError(f"missing ) in {p!r}")
            i += 1
        elif p[i] == "[":
            chosen, i = _class(p, i + 1, fold)
            item = ("set", chosen)
        else:
            chosen, i = _single(p, i)
            item = ("set", _folded(chosen, fold))
        if i < len(p) and p[i] in "?*+{":
            if p[i] == "{":
                stop = p.index("}", i)
                low, _, high = p[i + 1 : stop].partition(",")
                low, high = int(low), (int(high) if high else None) if "," in p[i:stop] else int(low)
                i = stop + 1
            else:
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[p[i]]
                i += 1
            item = ("repeat", item, low, high)
        parts.append(item)
    options.append(("cat", parts))
    return (options[0] if len(options) == 1 else ("alt", options)), i


def _single(p: str, i: int) -> tuple[frozenset, int]:
    if p[i] == "\\":
        return _ESCAPES.get(p[i + 1], frozenset(p[i + 1].encode())), i + 2
    if p[i] == ".":
        return frozenset(range(128)) - {10}, i + 1
    return frozenset(p[i].encode()), i + 1


def _class(p: str, i: int, fold: bool) -> tuple[frozenset, int]:
    chosen: set[int] = set()
    while p[i] != "]":
        one, j = _single(p, i) if p[i] != "." else (frozenset(b"."), i + 1)
        if p[j] == "-" and p[j + 1] != "]":
            last, j = _single(p, j + 1)
            one = frozenset(range(min(one), max(last) + 1))
        chosen |= one
        i = j
    return _folded(frozenset(chosen), fold), i + 1


def _folded(chosen: frozenset, fold: bool) -> frozenset:
    return frozenset(b for c in chosen for b in bytes([c]).lower() + bytes([c]).upper()) if fold else chosen


class Automaton:
    """The minimal automaton that finds every rule's ends anywhere in a text, in one pass over its bytes.

    of: byte -> class; table[state * classes + class] -> next state * classes; accepting states come last, from .accepting
    on, and rules[state - accepting] is the set of rules that end there.
    """

    def __init__(self, patterns: list[str], most: int = 20_000):
        nfa = Nfa()
        start = nfa.state()
        ends = {nfa.rule(p, start): r for r, p in enumerate(patterns)}
        sets = sorted({on for edges in nfa.edges for on, _ in edges if on is not None}, key=sorted)
        marks = [tuple(b in s for s in sets) + (b == SEPARATOR,) for b in range(256)]
        kinds = {m: k for k, m in enumerate(dict.fromkeys(marks))}
        self.of = np.array([kinds[m] for m in marks], np.uint8)
        self.classes = len(kinds)
        sample = [int(np.flatnonzero(self.of == k)[0]) for k in range(self.classes)]
        moves = [[(k, to) for k, b in enumerate(sample) for on, to in edges if on is not None and b in on] for edges in nfa.edges]
        closed = [nfa.closure([s]) for s in range(len(nfa.edges))]
        begin = closed[start]
        place, todo, table, found = {begin: 0}, [begin], [], []
        while len(table) < len(todo):
            if len(todo) > most:
                raise ValueError(f"the rules need more than {most} states; counted classes that other rules can begin in multiply")
            now = todo[len(table)]
            to = [set(begin) for _ in range(self.classes)]
            for s in now:
                for k, t in moves[s]:
                    to[k] |= closed[t]
            row = []
            for k in range(self.classes):
                key = frozenset(to[k])
                if key not in place:
                    place[key] = len(todo)
                    todo.append(key)
                row.append(place[key])
            table.append(row)
            found.append(frozenset(ends[s] for s in now if s in ends))
        self.subsets = len(table)
        self.minimise(np.array(table), found)

    def minimise(self, table: np.ndarray, found: list[frozenset]) -> None:
        """Moore's partition refinement from the sets of rules that states accept."""
        kinds = {f: i for i, f in enumerate(dict.fromkeys(found))}
        part = np.array([kinds[f] for f in found])
        while True:
            _, first, new = np.unique(np.column_stack([part, part[table]]), axis=0, return_index=True, return_inverse=True)
            new = new.ravel()
            if len(first) == part.max() + 1:
                break
            part = new
        accept = np.array([bool(found[i]) for i in first])
        order = np.argsort(accept, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.states = len(order)
        self.accepting = int((~accept).sum())
        self.rules = [tuple(sorted(found[first[s]])) for s in order[self.accepting :]]
        self.start = int(rank[new[0]]) * self.classes
        self.table = (rank[new[table[first[order]]]] * self.classes).astype(np.intp).ravel()

    def ends(self, data: np.ndarray, lanes: int = 4096, warm: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(position, state) of every byte that takes the automaton to an accepting state.

        The bytes are cut into lanes that advance together. A lane starts in the state that the bytes before it lead to; where the lane
        before ends in another, the lane is run again from there, so that the result is that of one pass from the left.
        """
        n = len(data)
        lanes = max(1, min(lanes, n // 256))
        steps = -(-n // lanes)
        kind = np.zeros(lanes * steps, np.uint8) + self.of[SEPARATOR]
        np.take(self.of, data, out=kind[:n])
        kind = np.ascontiguousarray(kind.reshape(lanes, steps).T)
        state = np.full(lanes, self.start, np.intp)
        at = np.empty(lanes, np.intp)
        for i in range(max(0, steps - warm), steps):
            np.add(state[:-1], kind[i, :-1], out=at[1:])
            state[1:] = self.table[at[1:]]
            state[:-1] = state[1:]
        state[1:] = state[:-1]
        state[0] = self.start
        log = np.empty((steps, lanes), np.int32)
        todo = np.arange(lanes)
        while len(todo):
            now = state[todo]
            part = kind if len(todo) == lanes else kind[:, todo]
            at, some = np.empty(len(todo), np.intp), np.empty((steps, len(todo)), np.int32)
            for i in range(steps):
                np.add(now, part[i], out=at)
                np.take(self.table, at, out=now)
                some[i] = now
            log[:, todo] = some
            wrong = np.flatnonzero(log[-1, :-1] != state[1:]) + 1
            state[wrong] = log[-1, wrong - 1]
            todo = wrong
        step, lane = np.nonzero(log >= self.accepting * self.classes)
        place = lane * steps + step
        order = np.argsort(place)
        place = place[order]
        return place[place < n], (log[step, lane][order] // self.classes)[place < n]
