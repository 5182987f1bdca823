"""Byte automata: regexes to one minimal table that scans all rules in one pass.

A rule's regex is parsed into a nondeterministic automaton over bytes, made
deterministic by subset construction with *ordered* subsets (threads that begin
earlier come first, and an accepting thread cuts off those after it), which gives
leftmost-longest matches for rules whose matches end only where nothing of the
match can go on. ``compile_rule`` checks that property. ``combine`` runs all
rules side by side as the product of their automata and minimises it by
partition refinement.

Syntax: literals, escapes ``\\xHH`` and ``\\c``, classes with ranges, groups,
``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

DEAD = -1


@dataclass
class Nfa:
    """step: state -> [(set of bytes, state)]; free: state -> states in order."""

    step: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1


class _Parser:
    """Recursive descent; each method returns a syntax tree node."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.text, self.at, self.fold = pattern, 0, ignore_case

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        c = self.text[self.at]
        self.at += 1
        return c

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("or", options)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("seq", parts)

    def repeated(self):
        node = self.single()
        while (c := self.peek()) and c in "?*+{":
            self.take()
            if c == "{":
                inside = self.text[self.at : (end := self.text.index("}", self.at))]
                self.at = end + 1
                low, _, high = inside.partition(",")
                bounds = (int(low), (int(high) if high else None) if "," in inside else int(low))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("repeat", node, *bounds)
        return node

    def single(self):
        c = self.take()
        if c == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives()
            assert self.take() == ")", f"unbalanced group in {self.text}"
            return node
        if c == "[":
            return ("bytes", self.bracket())
        return ("bytes", self.folded({self.escaped() if c == "\\" else ord(c)}))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return {"n": 10, "r": 13, "t": 9}.get(c, ord(c))

    def bracket(self) -> frozenset[int]:
        negated = self.peek() == "^"
        self.at += negated
        chosen: set[int] = set()
        while self.peek() != "]":
            low = self.escaped() if (c := self.take()) == "\\" else ord(c)
            high = low
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                high = self.escaped() if (c := self.take()) == "\\" else ord(c)
            chosen.update(range(low, high + 1))
        self.take()
        both = self.folded(chosen)
        return frozenset(range(256)) - both if negated else both

    def folded(self, chosen: set[int]) -> frozenset[int]:
        if self.fold:
            chosen = chosen | {b ^ 32 for b in chosen if chr(b).isascii() and chr(b).isalpha()}
        return frozenset(chosen)


def _build(nfa: Nfa, node, start: int) -> int:
    """Adds node from start; returns the state behind it."""
    kind = node[0]
    if kind == "bytes":
        nfa.step[start].append((node[1], end := nfa.state()))
        return end
    if kind == "seq":
        for part in node[1]:
            start = _build(nfa, part, start)
        return start
    if kind == "or":
        end = nfa.state()
        for option in node[1]:
            nfa.free[start].append(begin := nfa.state())
            nfa.free[_build(nfa, option, begin)].append(end)
        return end
    _, inner, low, high = node
    for _ in range(low):
        start = _build(nfa, inner, start)
    if high is None:
        begin, end = nfa.state(), nfa.state()
        nfa.free[start].append(begin)
        nfa.free[begin].append(into := nfa.state())
        nfa.free[_build(nfa, inner, into)].append(begin)
        nfa.free[begin].append(end)
        return end
    end = nfa.state()
    for _ in range(high - low):
        nfa.free[start].append(begin := nfa.state())
        nfa.free[start].append(end)
        start = _build(nfa, inner, begin)
    nfa.free[start].append(end)
    return end


@dataclass
class RuleAutomaton:
    """table[state][byte]: the next state or DEAD; accepting: states that end a match."""

    table: list[list[int]]
    accepting: set[int]


def _determinise(nfa: Nfa, first: list[int], last: int, restart: int | None) -> RuleAutomaton:
    """restart: a thread with the lowest priority that begins at every byte."""

    def closed(states: list[int]) -> tuple[int, ...]:
        order: dict[int, None] = {}

        def visit(s: int) -> None:
            if s not in order:
                order[s] = None
                for t in nfa.free[s]:
                    visit(t)

        for s in states:
            visit(s)
        kept = list(order)
        return tuple(kept)

    def subset(threads: list[int]) -> tuple[int, ...]:
        """Threads in order; those that begin later than an accepting one go."""
        out: dict[int, None] = {}
        for s in threads:
            group = closed([s])
            out.update(dict.fromkeys(group))
            if last in group:
                return tuple(out)
        if restart is not None:
            out.update(dict.fromkeys(closed([restart])))
        return tuple(out)

    begin = subset(first) if restart is None else subset([])
    number, table, accepting, todo = {begin: 0}, [], set(), [begin]
    while todo:
        states = todo.pop(0)
        if last in states:
            accepting.add(number[states])
        row = []
        for byte in range(256):
            threads = [t for s in states for chosen, t in nfa.step[s] if byte in chosen]
            # Within an accepted match only its own threads go on.
            following = subset(threads) if threads or restart is not None and last not in states else ()
            if not following:
                row.append(DEAD)
                continue
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row.append(number[following])
        table.append(row)
    return RuleAutomaton(table, accepting)


def compile_rule(pattern: str, ignore_case: bool = False) -> RuleAutomaton:
    """The automaton that finds the rule's leftmost matches from any byte on."""
    nfa = Nfa()
    first = nfa.state()
    last = _build(nfa, _Parser(pattern, ignore_case).alternatives(), first)
    found = _determinise(nfa, [first], last, restart=first)
    if 0 in found.accepting:
        raise ValueError(f"{pattern}: a rule may not match nothing")
    for state in found.accepting:
        if any(t != DEAD and t not in found.accepting for t in found.table[state]):
            raise ValueError(f"{pattern}: a match must end where it can't go on")
    return found


def compile_reverse(pattern: str, ignore_case: bool = False) -> RuleAutomaton:
    """The automaton that reads a match backwards from its end."""
    forward = Nfa()
    first = forward.state()
    last = _build(forward, _Parser(pattern, ignore_case).alternatives(), first)
    nfa = Nfa([[] for _ in forward.step], [[] for _ in forward.free])
    for s, steps in enumerate(forward.step):
        for chosen, t in steps:
            nfa.step[t].append((chosen, s))
    for s, states in enumerate(forward.free):
        for t in states:
            nfa.free[t].append(s)
    # All threads count: the longest way back is the leftmost start.
    number, table, accepting, todo = {}, [], set(), []

    def closed(states: set[int]) -> frozenset[int]:
        stack, seen = list(states), set(states)
        while stack:
            for t in nfa.free[stack.pop()]:
                if t not in seen:
                    seen.add(t)
                    stack.append(t)
        return frozenset(seen)

    number[begin := closed({last})] = 0
    todo.append(begin)
    while todo:
        states = todo.pop(0)
        if first in states:
            accepting.add(number[states])
        row = []
        for byte in range(256):
            following = closed({t for s in states for chosen, t in nfa.step[s] if byte in chosen})
            if not following:
                row.append(DEAD)
                continue
            if following not in number:
                number[following] = len(number)
                todo.append(following)
            row.append(number[following])
        table.append(row)
    return RuleAutomaton(table, accepting)


@dataclass
class Combined:
    """All rules in one automaton.

    table: 256 entries a state, each the next state times 256. States from
    ``quiet`` on (times 256) are those in which a rule accepts; ending[state][byte]
    has the rules whose matches end before that byte, accepting[state] those that
    accept there.
    """

    table: list[int]
    quiet: int
    ending: dict[int, list[tuple[int, ...]]]
    accepting: dict[int, tuple[int, ...]]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(rule, end) of every match, by end: one pass over the bytes."""
        table, quiet, state, found = self.table, self.quiet, 0, []
        for at, byte in enumerate(data):
            if state >= quiet:
                for rule in self.ending[state][byte]:
                    found.append((rule, at))
            state = table[state + byte]
        if state >= quiet:
            found += [(rule, len(data)) for rule in self.accepting[state]]
        return found


def combine(rules: list[RuleAutomaton]) -> Combined:
    """The product of all rules' automata, each beginning anew when it ends, made
    minimal by partition refinement over classes of equal bytes."""
    classes: dict[tuple[int, ...], list[int]] = {}
    for byte in range(256):
        classes.setdefault(tuple(row[byte] for rule in rules for row in rule.table), []).append(byte)
    bytes_of = list(classes.values())
    kind = {byte: k for k, members in enumerate(bytes_of) for byte in members}
    start = tuple(0 for _ in rules)
    number, states, rows = {start: 0}, [start], []
    for own in states:  # grows while new states are met
        row = []
        for members in bytes_of:
            byte = members[0]
            key = tuple(t if (t := rule.table[s][byte]) != DEAD else rule.table[0][byte] for rule, s in zip(rules, own, strict=True))
            if key not in number:
                number[key] = len(states)
                states.append(key)
            row.append(number[key])
        rows.append(row)
    accepting = [tuple(r for r, s in enumerate(own) if s in rules[r].accepting) for own in states]
    ending = [
        tuple(tuple(r for r in accepting[i] if rules[r].table[own[r]][members[0]] == DEAD) for members in bytes_of) if accepting[i] else ()
        for i, own in enumerate(states)
    ]
    names: dict = {}
    block = [names.setdefault((accepting[i], ending[i]), len(names)) for i in range(len(states))]
    while True:
        finer: dict = {}
        refined = [finer.setdefault((block[i], *[block[t] for t in rows[i]]), len(finer)) for i in range(len(states))]
        if len(finer) == len(set(block)):
            break
        block = refined
    member: dict[int, int] = {}
    for i, b in enumerate(block):
        member.setdefault(b, i)
    order = sorted(member, key=lambda b: (bool(accepting[member[b]]), member[b]))
    place = {b: 256 * k for k, b in enumerate(order)}
    table = [place[block[rows[member[b]][kind[byte]]]] for b in order for byte in range(256)]
    loud = [b for b in order if accepting[member[b]]]
    return Combined(
        table,
        256 * (len(order) - len(loud)),
        {place[b]: [ending[member[b]][kind[byte]] for byte in range(256)] for b in loud},
        {place[b]: accepting[member[b]] for b in loud},
    )


def start_of(reverse: RuleAutomaton, data: bytes, end: int, least: int) -> int:
    """The leftmost start, not before least, of the match that ends at end."""
    state, found = 0, end
    for at in range(end - 1, least - 1, -1):
        state = reverse.table[state][data[at]]
        if state == DEAD:
            break
        if state in reverse.accepting:
            found = at
    return found
