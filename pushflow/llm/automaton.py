"""Regular expressions of several rules compiled into one minimal deterministic automaton
over bytes, and a scan that runs it over a buffer in parallel lanes.

compile_rules() builds position automata, determinises them together by subset
construction and merges equivalent states; the result is a transition array indexed by
(state, byte class) and, for each state, a bit mask of the rules that match up to it.

scan() cuts the buffer into lanes, steps all lanes at once and then repairs lanes whose
true start state differs from the assumed one, until nothing changes: the masks are those
of one sequential pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _parser as sre

import numpy as np


@dataclass
class Automaton:
    """step[state * width + kind[byte]] is the next state; accept[state] the rules' bits; state 0 is the start."""

    step: np.ndarray
    kind: np.ndarray
    accept: np.ndarray
    width: int

    @property
    def states(self) -> int:
        return len(self.accept)


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []  # moves without a byte
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1


def _both_cases(codes: set[int]) -> frozenset[int]:
    return frozenset(codes | {c ^ 32 for c in codes if 65 <= c & ~32 <= 90})


def _codes(op: str, arg) -> set[int]:
    if op == "LITERAL":
        return {arg}
    if op == "RANGE":
        return set(range(arg[0], arg[1] + 1))
    raise ValueError(f"unsupported in a class: {op}")


def _build(nfa: _Nfa, tree, start: int, fold: bool) -> int:
    """Add the parsed expression from state start; returns its end state."""
    for op, arg in tree:
        name = str(op)
        if name in ("LITERAL", "NOT_LITERAL", "IN"):
            if name == "NOT_LITERAL":
                codes = set(range(256)) - {arg}
            elif name == "IN" and str(arg[0][0]) == "NEGATE":
                codes = set(range(256)).difference(*(_codes(str(o), a) for o, a in arg[1:]))
            else:
                codes = set().union(*(_codes(str(o), a) for o, a in arg)) if name == "IN" else {arg}
            if max(codes) > 255:
                raise ValueError("rules are over bytes")
            end = nfa.state()
            nfa.moves[start].append((_both_cases(codes) if fold else frozenset(codes), end))
        elif name == "SUBPATTERN":
            _, add, _, inner = arg
            end = _build(nfa, inner, start, fold or bool(add & 2))
        elif name == "BRANCH":
            end = nfa.state()
            for option in arg[1]:
                nfa.empty[_build(nfa, option, start, fold)].append(end)
        elif name == "MAX_REPEAT":
            least, most, inner = arg
            end = start
            for _ in range(least):
                end = _build(nfa, inner, end, fold)
            if most == sre.MAXREPEAT:
                loop = nfa.state()
                nfa.empty[end].append(loop)
                nfa.empty[_build(nfa, inner, loop, fold)].append(loop)
                end = loop
            else:
                last = nfa.state()
                nfa.empty[end].append(last)
                for _ in range(most - least):
                    end = _build(nfa, inner, end, fold)
                    nfa.empty[end].append(last)
                end = last
        else:
            raise ValueError(f"unsupported in a rule: {name}")
        start = end
    return start


def _closure(nfa: _Nfa, states) -> frozenset[int]:
    seen, todo = set(states), list(states)
    while todo:
        for s in nfa.empty[todo.pop()]:
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return frozenset(seen)


def _one(rule: str) -> tuple[list[list[int]], list[int]]:
    """The minimal automaton of a rule that may begin anywhere: moves by byte and whether a state accepts."""
    nfa = _Nfa()
    root = nfa.state()
    tree = sre.parse(rule)
    end = _build(nfa, tree, root, bool(tree.state.flags & 2))
    # bytes that no move tells apart share a column
    kind, width = _columns([codes for moves in nfa.moves for codes, _ in moves])
    sample = [kind.index(c) for c in range(width)]
    start = _closure(nfa, [root])
    number, order, step = {start: 0}, [start], []
    for here in order:  # grows while it is read
        moves = [m for s in here for m in nfa.moves[s]]
        for byte in sample:
            there = _closure(nfa, {t for codes, t in moves if byte in codes} | {root})
            if there not in number:
                number[there] = len(order)
                order.append(there)
            step.append(number[there])
    dfa = _minimal(np.array(step, np.int32).reshape(-1, width), np.array([end in here for here in order], np.uint8), np.array(kind, np.int32))
    return (dfa.step.reshape(-1, width) // width)[:, kind].tolist(), dfa.accept.tolist()


def _columns(sets) -> tuple[list[int], int]:
    sets, seen = list(dict.fromkeys(sets)), {}
    kind = [seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)]
    return kind, len(seen)


def compile_rules(rules: list[str]) -> Automaton:
    """At most 64 rules, each of which may match anywhere; a byte's mask has as many bits as it needs.

    Each rule is determinised and minimised by itself, since counted rules that may begin
    inside themselves have many more subsets than states; the subsets of all rules
    together, one state of each, are then built and minimised again.
    """
    if len(rules) > 64:
        raise ValueError("an automaton takes 64 rules at most")
    parts = [_one(rule) for rule in rules]
    seen: dict[tuple, int] = {}
    kind = [seen.setdefault(tuple(row[b] for moves, _ in parts for row in moves), len(seen)) for b in range(256)]
    sample = [kind.index(c) for c in range(len(seen))]
    moves = [[[row[b] for b in sample] for row in m] for m, _ in parts]
    start = (0,) * len(parts)
    number, order, step = {start: 0}, [start], []
    for here in order:
        for there in zip(*(m[s] for m, s in zip(moves, here, strict=True)), strict=True):
            if there not in number:
                number[there] = len(order)
                order.append(there)
            step.append(number[there])
    accept = np.array([sum(bool(a[s]) << i for i, ((_, a), s) in enumerate(zip(parts, here, strict=True))) for here in order], np.min_scalar_type((1 << len(rules)) - 1))
    return _minimal(np.array(step, np.int32).reshape(-1, len(sample)), accept, np.array(kind, np.int32))


def _minimal(step: np.ndarray, accept: np.ndarray, kind: np.ndarray) -> Automaton:
    """Merge states that accept the same rules and move to merged states alike, until that changes nothing."""
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        _, new = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        new = new.ravel()
        if new.max() == block.max():
            break
        block = new
    rank = np.full(block.max() + 1, -1)
    _, first = np.unique(block, return_index=True)
    for i, b in enumerate(sorted(range(len(first)), key=lambda b: first[b])):
        rank[b] = i  # the start state comes first
    block = rank[block]
    _, first = np.unique(block, return_index=True)
    return Automaton((block[step[first]] * step.shape[1]).astype(np.int32).ravel(), kind, accept[first], step.shape[1])


def scan(dfa: Automaton, data: np.ndarray, lane: int = 512, lanes: int = 8192) -> np.ndarray:
    """For each byte the mask of the rules that have a match ending with it."""
    n = len(data)
    if not n:
        return np.zeros(0, dfa.accept.dtype)
    k = max(1, min(lanes, n // lane))
    size = -(-n // k)
    kinds = np.zeros(k * size, np.int32)
    kinds[:n] = dfa.kind[data]
    kinds = np.ascontiguousarray(kinds.reshape(k, size).T)
    trail = np.empty((size, k), np.int32)  # states, times width
    state = np.zeros(k, np.int32)
    for i in range(size):
        state = dfa.step[state + kinds[i]]
        trail[i] = state
    began = np.zeros(k, np.int32)
    while True:  # each round fixes the lanes behind those that ended otherwise than assumed
        true = np.concatenate([[0], trail[-1, :-1]]).astype(np.int32)
        lane_no = np.flatnonzero(true != began)
        if not len(lane_no):
            break
        began[lane_no] = true[lane_no]
        state = true[lane_no]
        for i in range(size):
            state = dfa.step[state + kinds[i, lane_no]]
            keep = state != trail[i, lane_no]
            trail[i, lane_no] = state
            lane_no, state = lane_no[keep], state[keep]
            if not len(lane_no):
                break
    return dfa.accept[trail.T.reshape(-1)[:n] // dfa.width]
