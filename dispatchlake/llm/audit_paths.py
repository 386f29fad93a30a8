"""Cheapest edits of a conversation as persistent strings that share their beginnings.

A conversation is right when its role initials read `(s?(ua)+)?`. Four states say
how far such a reading has come; per row and state the search keeps the cheapest
edits, of equally cheap ones the least string. Strings are nodes linked to the node
they go on from, so a step costs one node whatever came before it. To compare two
strings, both climb binary-lifting ancestors while the rolling hashes differ, down
to their longest common prefix; a common prefix is then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

START, SYSTEM, USER, ASSISTANT = range(4)
DELETE, INSERT, KEEP, REROLE = range(4)
LETTERS = "DIKR"
COST = [2, 5, 0, 1]
TRUNCATED = 5
# the role that a state asks for next, and the state after it
NEXT = [("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER)]
# inserts a state needs before the conversation may end
CLOSING = [0, 2, 1, 0]

BASE, PRIME = 1_000_003, (1 << 61) - 1


class Audits:
    """Strings of small numbers as linked nodes; node 0 is the empty string."""

    def __init__(self, base: int = BASE, prime: int = PRIME):
        self.base, self.prime = base, prime
        self.symbol, self.depth, self.hash = [-1], [0], [0]
        self.up: list[tuple[int, ...]] = [()]  # ancestors 1, 2, 4 ... steps back

    def push(self, node: int, symbol: int) -> int:
        """The string of `node` and one more symbol."""
        above, k = [node], 0
        while k < len(self.up[above[k]]):
            above.append(self.up[above[k]][k])
            k += 1
        self.up.append(tuple(above))
        self.symbol.append(symbol)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + symbol + 1) % self.prime)
        return len(self.up) - 1

    def ancestor(self, node: int, depth: int) -> int:
        """The node's first `depth` symbols."""
        back = self.depth[node] - depth
        while back:
            k = back.bit_length() - 1
            node, back = self.up[node][k], back - (1 << k)
        return node

    def symbols(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.symbol[node])
            node = self.up[node][0]
        return out[::-1]

    def _same(self, a: int, b: int) -> bool:
        """Whether two strings of one length are equal; ends where they share a node."""
        while a != b:
            if self.symbol[a] != self.symbol[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of `a` sorts before that of `b`."""
        least = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, least), self.ancestor(b, least)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        # climb to the first symbols that differ
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]):
                p, q = self.up[x][k], self.up[y][k]
                if self.hash[p] != self.hash[q]:
                    x, y = p, q
        if self.symbol[x] == self.symbol[y] or not self._same(self.up[x][0], self.up[y][0]):
            return self.symbols(a) < self.symbols(b)  # hashes collided
        return self.symbol[x] < self.symbol[y]


class Frontier:
    """Per state the cheapest string so far, as (cost, node)."""

    def __init__(self, audits: Audits):
        self.audits = audits
        self.best: list[tuple[int, int] | None] = [None] * 4

    def offer(self, state: int, cost: int, node: int, symbol: int) -> None:
        """Take the string of `node` and `symbol` if it beats the state's own."""
        now = self.best[state]
        if now is None or cost < now[0]:
            self.best[state] = (cost, self.audits.push(node, symbol))
        elif cost == now[0]:
            new = self.audits.push(node, symbol)
            if self.audits.less(new, now[1]):
                self.best[state] = (cost, new)

    def insert(self) -> None:
        """Turns that may be put in before the next row."""
        for state in (START, SYSTEM, ASSISTANT, USER):
            if self.best[state] is not None:
                cost, node = self.best[state]
                target = NEXT[state][1]
                now = self.best[target]
                if now is None or cost + COST[INSERT] <= now[0]:
                    self.offer(target, cost + COST[INSERT], node, INSERT)

    def after(self, forced: bool, truncated: bool, initial: str) -> Frontier:
        """The states after one row; a `forced` row must go."""
        self.insert()
        out = Frontier(self.audits)
        extra = TRUNCATED if truncated else 0
        for state in range(4):
            if self.best[state] is None:
                continue
            cost, node = self.best[state]
            out.offer(state, cost + COST[DELETE], node, DELETE)
            if forced:
                continue
            role, target = NEXT[state]
            step = KEEP if initial == role[0] else REROLE
            out.offer(target, cost + extra + COST[step], node, step)
            if state == START and initial == "s":
                out.offer(SYSTEM, cost + extra, node, KEEP)
        return out


def letters(audits: Audits, node: int) -> str:
    return "".join(LETTERS[s] for s in audits.symbols(node))


def chunk_paths(rows: list[tuple[bool, bool, str]]) -> list[list[tuple[int, str] | None]]:
    """Cheapest edits of these rows from each state to each state, as (cost, audit).

    An audit ends with a row's edit; inserts stand before the row that follows.
    """
    audits, out = Audits(), []
    for start in range(4):
        front = Frontier(audits)
        front.best[start] = (0, 0)
        for row in rows:
            front = front.after(*row)
        out.append([b and (b[0], letters(audits, b[1])) for b in front.best])
    return out


def finish(audits: Audits, best: list[tuple[int, int] | None]) -> tuple[int, int, int]:
    """Cost with the closing inserts, last state and node of the best whole string."""
    chosen = None
    for state in range(4):
        if best[state] is None:
            continue
        cost = best[state][0] + COST[INSERT] * CLOSING[state]
        node = best[state][1]
        if (
            chosen is None
            or cost < chosen[0]
            or (cost == chosen[0] and audits.less(node, chosen[2]))
        ):
            chosen = (cost, state, node)
    return chosen


def whole_path(rows: list[tuple[bool, bool, str]]) -> tuple[int, str]:
    """Cost and audit of a conversation."""
    audits = Audits()
    front = Frontier(audits)
    front.best[START] = (0, 0)
    for row in rows:
        front = front.after(*row)
    cost, state, node = finish(audits, front.best)
    return cost, letters(audits, node) + "I" * CLOSING[state]


def chunk_choice(
    chunks: list[tuple[list[int | None], list[int | None]]],
) -> tuple[int, list[tuple[int, int]], int]:
    """Cheapest way through chunks: cost, (entry, exit) state per chunk, closing inserts.

    A chunk has the cost from each state to each (4 x state + state) and the place
    of its audit among those from the same state. Two ways are equal up to some
    chunk, enter it in one state, and differ there: so places compare as audits do.
    """
    audits, states = Audits(), {0: START}
    best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
    for costs, places in chunks:
        front = Frontier(audits)
        for state in range(4):
            if best[state] is None:
                continue
            for target in range(4):
                if costs[4 * state + target] is not None:
                    total = best[state][0] + costs[4 * state + target]
                    front.offer(target, total, best[state][1], places[4 * state + target])
        best = front.best
        states.update((b[1], k) for k, b in enumerate(best) if b)
    cost, state, node = finish(audits, best)
    ends = []
    while node:
        ends.append(states[node])
        node = audits.up[node][0]
    ends = [START, *ends[::-1]]
    return cost, list(zip(ends, ends[1:], strict=False)), CLOSING[state]


def edits(
    audit: str, initials: list[str], state: int = START
) -> Iterator[tuple[list[str], int, str | None]]:
    """Per row: roles put in before it, its edit, its new role (null: it keeps its own).

    `initials` are the rows' role initials. Closing inserts come last, with the
    edit `INSERT`.
    """
    before: list[str] = []
    rows = iter(initials)
    for letter in audit:
        edit = LETTERS.index(letter)
        role, target = NEXT[state]
        if edit == INSERT:
            before.append(role)
            state = target
            continue
        initial = next(rows)
        yield before, edit, role if edit == REROLE else None
        before = []
        if edit == KEEP and state == START and initial == "s":
            state = SYSTEM
        elif edit != DELETE:
            state = target
    if before:
        yield before, INSERT, None
