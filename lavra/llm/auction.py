"""Shortest edits of a run of conversation rows by the auction algorithm, many runs in step.

The lattice of a run of n rows has the nodes (rows used, state), the state being what the roles written so
far allow next: nothing written (0), system written (1), user written (2), assistant written (3). Arcs are
the edits: Delete and Keep and Rerole use a row, Insert does not. A run ends in one of four exits, each with
a cost of its own.

Every node has an integer price. A path starts at the entry; at its last node it is extended along the
cheapest arc, by cost plus price of the arc's end, if the node's own price has risen to that sum; else the
price is raised to it and the path contracted by one node. No price ever exceeds its cheapest arc's sum, so
when the path reaches an exit, the entry's price is the least cost, and the arcs of all cheapest paths are
tight: price equals cost plus price of the end. The cheapest edits least in ASCII follow the tight arcs that
lead to an exit, Delete before Insert before Keep before Rerole.
"""

from __future__ import annotations

import numpy as np

RUN = 32
FAR = 1 << 40
LETTERS = np.frombuffer(b"DIKR", np.uint8)
START, SYSTEM, USER, ASSISTANT = range(4)
# The only role that may be written next, by state; a system row may be kept at the start.
NEXT = np.array([USER, USER, ASSISTANT, USER])
NAMES = {USER: "user", ASSISTANT: "assistant"}

# The costs of the edits, and of leaving a truncated row.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

# One character a row: its role's initial, in upper case if truncated; a digit if it must be deleted.
CODES = "suaoSUAO0123"
# What ends a conversation from each exit: rows still to be inserted.
TAIL = ("", "II", "I", "")
END = np.array([len(t) * INSERT for t in TAIL])


def _arcs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs and end states by code, state and edit; and the least cost of a row, by code."""
    cost = np.full((len(CODES), 4, 4), FAR, np.int64)
    end = np.tile(np.arange(4)[None, :, None], (len(CODES), 1, 4))
    for k, code in enumerate(CODES):
        for state in range(4):
            cost[k, state, 0] = DELETE
            cost[k, state, 1], end[k, state, 1] = INSERT, NEXT[state]
            if code.isdigit():
                continue
            more = TRUNCATED if code.isupper() else 0
            cost[k, state, 3], end[k, state, 3] = REROLE + more, NEXT[state]
            if code.lower() == "s" and state == START:
                cost[k, state, 2], end[k, state, 2] = more, SYSTEM
            elif code.lower() == "?ua"[NEXT[state] - 1]:
                cost[k, state, 2], end[k, state, 2] = more, NEXT[state]
    return cost, end, cost[:, :, [0, 2, 3]].min(axis=(1, 2))


COST, ENDS, LEAST = _arcs()
_USED = np.array([1, 0, 1, 1])
_PLACE = np.zeros(256, np.int8)
_PLACE[list(CODES.encode())] = np.arange(len(CODES))


class Lattices:
    """Runs of rows with an entry state and exit costs each; a run may be empty."""

    def __init__(self, codes: list[str], entry: np.ndarray, exits: np.ndarray):
        self.n = np.array([len(c) for c in codes], np.int64)
        self.size, self.most = len(codes), int(self.n.max(initial=0))
        self.entry = np.asarray(entry, np.int64)
        self.rows = np.zeros((self.size, self.most + 1), np.int64)
        for i, c in enumerate(codes):
            self.rows[i, : len(c)] = _PLACE[np.frombuffer(c.encode(), np.uint8)]
        exits = np.minimum(exits, FAR)
        # First prices: what every row costs at least from here on, and the cheapest exit.
        floor = np.where(np.arange(self.most + 1) < self.n[:, None], LEAST[self.rows], 0)
        floor = floor[:, ::-1].cumsum(axis=1)[:, ::-1] + exits.min(axis=1)[:, None]
        self.price = np.repeat(floor[:, :, None], 4, axis=2)
        self.price[np.arange(self.size), self.n] = exits

    def _open(self, run: np.ndarray, level: np.ndarray, state: np.ndarray):
        """Of one node in each run: the sums of its arcs, and where they lead."""
        code = self.rows[run, level]
        to_level, to_state = level[:, None] + _USED, ENDS[code, state]
        return COST[code, state] + self.price[run[:, None], to_level, to_state], to_level, to_state

    def auction(self) -> np.ndarray:
        """Raise prices until every path has reached an exit; the least costs."""
        run = np.flatnonzero(self.n > 0)
        path = np.zeros((self.size, 4 * self.most + 5), np.int64)
        path[:, 0] = self.entry
        depth = np.zeros(self.size, np.int64)
        while len(run):
            node = path[run, depth[run]]
            level, state = node >> 2, node & 3
            sums, to_level, to_state = self._open(run, level, state)
            best = sums.argmin(axis=1)
            here = np.arange(len(run))
            least = sums[here, best]
            raised = self.price[run, level, state] < least
            back = run[raised]
            self.price[back, level[raised], state[raised]] = least[raised]
            depth[back] = np.maximum(depth[back] - 1, 0)
            on = run[~raised]
            depth[on] += 1
            arrived = to_level[here, best]
            path[on, depth[on]] = (arrived * 4 + to_state[here, best])[~raised]
            ended = ~raised & (arrived == self.n[run])
            if ended.any():
                run = run[~ended]
        return self.price[np.arange(self.size), 0, self.entry]

    def _leading(self) -> np.ndarray:
        """Nodes from which tight arcs lead to an exit."""
        leads = np.zeros((self.size, self.most + 1, 4), bool)
        every = np.arange(self.size)
        leads[every, self.n] = self.price[every, self.n] < FAR
        for level in range(self.most - 1, -1, -1):
            run = np.flatnonzero(self.n > level)
            for _ in range(3):  # an insert leads on inside the level, twice at most
                for state in range(4):
                    at = np.full(len(run), level), np.full(len(run), state)
                    sums, to_level, to_state = self._open(run, *at)
                    tight = sums == self.price[run, level, state][:, None]
                    leads[run, level, state] = (tight & leads[run[:, None], to_level, to_state]).any(axis=1)
        return leads

    def traced(self) -> tuple[list[str], np.ndarray]:
        """After the auction: the edits least in ASCII among the cheapest, and the exits they reach."""
        leads = self._leading()
        level, state = np.zeros(self.size, np.int64), self.entry.copy()
        out = np.zeros((self.size, 3 * self.most + 3), np.uint8)
        done = np.zeros(self.size, np.int64)
        run = np.flatnonzero(self.n > 0)
        while len(run):
            sums, to_level, to_state = self._open(run, level[run], state[run])
            fits = (sums == self.price[run, level[run], state[run]][:, None]) & leads[run[:, None], to_level, to_state]
            arc, here = fits.argmax(axis=1), np.arange(len(run))
            out[run, done[run]] = LETTERS[arc]
            done[run] += 1
            level[run], state[run] = to_level[here, arc], to_state[here, arc]
            run = run[level[run] < self.n[run]]
        return [out[i, :k].tobytes().decode() for i, k in enumerate(done.tolist())], state


def solve(codes: list[str], entry: np.ndarray, exits: np.ndarray) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Least costs, edits and exits reached. Equal problems are solved once."""
    seen: dict[tuple, int] = {}
    which = [seen.setdefault(key, len(seen)) for key in zip(codes, np.asarray(entry).tolist(), map(tuple, np.asarray(exits).tolist()))]
    asked = sorted(seen, key=lambda k: len(k[0]))
    place = {key: i for i, key in enumerate(asked)}
    cost, edits, reached = np.zeros(len(asked), np.int64), [], np.zeros(len(asked), np.int64)
    for a in range(0, len(asked), 4096):
        part = asked[a : a + 4096]
        runs = Lattices([k[0] for k in part], np.array([k[1] for k in part]), np.array([k[2] for k in part], np.int64))
        cost[a : a + len(part)] = runs.auction()
        letters, ends = runs.traced()
        edits += letters
        reached[a : a + len(part)] = ends
    order = [place[key] for key in seen]
    at = np.array([order[i] for i in which], np.int64)
    return cost[at], [edits[i] for i in at.tolist()], reached[at]


def transfers(codes: list[str]) -> np.ndarray:
    """Least costs of every run from each entry to each exit, ``FAR`` if there is no way.

    To the first two exits there is one way at most: all rows go, but for a system row kept to reach the
    second from the start. The others are reached from everywhere.
    """
    out = np.full((len(codes), 4, 4), FAR, np.int64)
    for i, code in enumerate(codes):
        out[i, START, START] = out[i, SYSTEM, SYSTEM] = DELETE * len(code)
        if "s" in code or "S" in code:
            out[i, START, SYSTEM] = DELETE * (len(code) - 1) + (0 if "s" in code else TRUNCATED)
    run, entry, to = (x.ravel() for x in np.meshgrid(np.arange(len(codes)), np.arange(4), [USER, ASSISTANT], indexing="ij"))
    exits = np.where(np.arange(4) == to[:, None], 0, FAR)
    out[run, entry, to] = solve([codes[i] for i in run.tolist()], entry, exits)[0]
    return out
