"""A navigable small-world graph over Hamming distance, built and searched in whole numpy batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: The widest beam short of all nodes.
WIDEST = 192


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits along the last axis of uint64 words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.uint16)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of two code arrays."""
    d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        d = d + np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.uint16)
    return d.astype(np.uint16)


class SmallWorld:
    """Nodes enter in random order, batch by batch. Each links to the ``links`` nearest
    nodes that a beam search over the graph so far, together with an exact look at its own batch,
    finds; links run both ways. A node's first ``lasting`` links, made while the graph was small,
    reach far and are never replaced; when the other places are full, the nearest stay."""

    def __init__(self, codes: np.ndarray, links: int = 10, most: int = 32, lasting: int = 6, beam: int = 24, batch: int = 1024, seed: int = 7):
        n = len(codes)
        self.order = np.random.default_rng(seed).permutation(n)
        self.codes = np.ascontiguousarray(codes[self.order])
        self.near = np.full((n, most), -1, np.int32)
        self.used = np.zeros(n, np.int32)
        self.lasting = lasting
        done = 0
        while done < n:
            size = min(n - done, batch, max(64, done))
            new = np.arange(done, done + size)
            keys = self._within(new, links)
            if done:
                found = self.search(self.codes[new], beam, limit=done)[:, :links]
                keys = np.sort(np.concatenate([found, keys], axis=1), axis=1)[:, :links]
            done += size
            good = keys != _NONE
            a, b = np.repeat(new, keys.shape[1])[good.ravel()], ((keys >> np.uint64(1)) & np.uint64(0x7FFFFFFF)).astype(np.int64)[good]
            d = (keys >> np.uint64(32)).astype(np.int64)[good]
            self._link(np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d]))

    def _within(self, new: np.ndarray, links: int) -> np.ndarray:
        """Keys of each new node's nearest others of its own batch."""
        d = _cross(self.codes[new], self.codes[new]).astype(np.uint64)
        keys = (d << np.uint64(32)) | (new.astype(np.uint64) << np.uint64(1))[None, :] | np.uint64(1)
        np.fill_diagonal(keys, _NONE)
        k = min(links, len(new))
        return np.sort(np.partition(keys, k - 1, axis=1)[:, :k], axis=1)

    def _link(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        most = self.near.shape[1]
        pairs = (a.astype(np.uint64) << np.uint64(36)) | (d.astype(np.uint64) << np.uint64(28)) | b.astype(np.uint64)
        pairs = np.unique(pairs)
        a, b = (pairs >> np.uint64(36)).astype(np.int64), (pairs & np.uint64(0xFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        count = np.diff(np.append(start, len(a)))
        targets, rank = a[start], np.arange(len(a)) - np.repeat(start, count)
        room = self.used[a] + rank
        fits = room < most
        self.near[a[fits], room[fits]] = b[fits]
        self.used[targets] = np.minimum(self.used[targets] + count, most)
        over_a, over_b = a[~fits], b[~fits]
        while len(over_a):  # one more link a round for each full node
            first = np.concatenate([[True], over_a[1:] != over_a[:-1]])
            x, y = over_a[first], over_b[first]
            held = self.near[x][:, self.lasting :]
            dist = hamming(self.codes[x][:, None], self.codes[held])
            worst = dist.argmax(1)
            closer = hamming(self.codes[x], self.codes[y]) < dist[np.arange(len(x)), worst]
            self.near[x[closer], self.lasting + worst[closer]] = y[closer]
            over_a, over_b = over_a[~first], over_b[~first]

    def search(self, queries: np.ndarray, beam: int, limit: int | None = None, wide: int = 4) -> np.ndarray:
        """Sorted beam of each query as keys: distance << 32 | node << 1 | a bit that is set while
        the node waits to be expanded. The ``wide`` nearest waiting nodes of a query are expanded at a time,
        until none waits within the beam."""
        n = len(self.codes) if limit is None else limit
        entry = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int64)) if n <= 16 else np.arange(16)
        beam = max(1, min(beam, n))
        out = np.full((len(queries), beam), _NONE)
        d = _cross(queries, self.codes[entry]).astype(np.uint64)
        keys = np.sort((d << np.uint64(32)) | (entry.astype(np.uint64) << np.uint64(1))[None, :] | np.uint64(1), axis=1)[:, :beam]
        out[:, : keys.shape[1]] = keys
        live = np.arange(len(queries))
        while len(live):
            b = out[live]
            waits = ((b & np.uint64(1)) == 1) & (b != _NONE)
            some = waits.any(1)
            live, b, waits = live[some], b[some], waits[some]
            if not len(live):
                break
            pick = waits & (np.cumsum(waits, axis=1) <= wide)
            r, c = np.nonzero(pick)
            node = ((b[r, c] >> np.uint64(1)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
            b[r, c] &= ~np.uint64(1)
            nb = self.near[node]
            ok = nb >= 0
            q = queries[live[r]]
            dist = hamming(q[:, None], self.codes[nb]).astype(np.uint64)
            key = np.where(ok, (dist << np.uint64(32)) | (nb.astype(np.uint64) & np.uint64(0x7FFFFFFF)) << np.uint64(1) | np.uint64(1), _NONE)
            slot = np.cumsum(pick, axis=1)[r, c] - 1
            fresh = np.full((len(live), wide, nb.shape[1]), _NONE)
            fresh[r, slot] = key
            fresh = fresh.reshape(len(live), -1)
            if beam < b.shape[1] + fresh.shape[1]:
                fresh[fresh >= b[:, -1:]] = _NONE  # farther than the whole beam
            both = np.sort(np.concatenate([b, fresh], axis=1), axis=1)
            same = (both[:, 1:] >> np.uint64(1)) == (both[:, :-1] >> np.uint64(1))
            same &= both[:, 1:] != _NONE
            if same.any():
                both[:, 1:][same] = _NONE
                both.sort(axis=1)
            out[live] = both[:, :beam]
        return out

    def within(self, queries: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None], beam: int = 16, chunk: int = 4096) -> None:
        """Tells ``found`` (places in ``queries``, nodes in the order given to the constructor) of all pairs within ``radius``, a chunk of
        queries at a time. A query whose whole beam lies within ``radius`` may have more neighbours: its beam doubles
        until the beam ends outside; beyond ``WIDEST`` it becomes one that holds every node, an exact scan."""
        n = len(self.codes)
        todo, beam = np.arange(len(queries)), min(beam, n)
        while len(todo):
            if beam > WIDEST and beam < n:  # from here on a look at every node costs less than a beam
                exact_within(self.codes, queries[todo], radius, lambda q, node: found(todo[q], self.order[node]))  # noqa: B023
                return
            again = []
            size = max(1, chunk * 16 // max(16, beam))
            for i in range(0, len(todo), size):
                part = todo[i : i + size]
                keys = self.search(queries[part], beam)
                inside = (keys != _NONE) & ((keys >> np.uint64(32)).astype(np.int64) <= radius)
                full = inside.all(1) & (beam < n)
                again.append(part[full])
                r, c = np.nonzero(inside & ~full[:, None])
                found(part[r], self.order[((keys[r, c] >> np.uint64(1)) & np.uint64(0x7FFFFFFF)).astype(np.int64)])
            todo, beam = np.concatenate(again), min(2 * beam, n)


def exact_within(codes: np.ndarray, queries: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None], chunk: int = 64) -> None:
    """Tells ``found`` of the same pairs by looking at every node."""
    for i in range(0, len(queries), chunk):
        r, c = np.nonzero(_cross(queries[i : i + chunk], codes) <= radius)
        found(i + r, c)


def _keys(search: Callable, n: int) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    search(lambda q, node: out.append(q * n + node))
    return np.unique(np.concatenate(out))


def searched(codes: np.ndarray, queries: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], None], beam: int = 16, audit: int = 256, recall: float = 0.95, seed: int = 7) -> float:
    """Tells ``found`` of the pairs (query, node) within ``radius`` and returns the audited recall.

    ``audit`` seeded queries are searched exactly too; while the graph misses more than 1 - ``recall`` of their pairs, all beams start twice as
    wide, at last as wide as the shard; if even that misses some, as no link reaches parts of the graph, every node is looked at."""
    n = len(codes)
    if not n or not len(queries):
        return 1.0
    world = SmallWorld(codes, seed=seed)
    rows = queries[np.sort(np.random.default_rng(seed + 1).permutation(len(queries))[:audit])]
    truth = _keys(lambda f: exact_within(codes, rows, radius, f), n)
    while True:
        got = float(np.isin(truth, _keys(lambda f: world.within(rows, radius, f, beam), n)).mean()) if len(truth) else 1.0  # noqa: B023
        if got >= recall:
            world.within(queries, radius, found, beam)
            return got
        if beam >= n:
            exact_within(codes, queries, radius, found)
            return 1.0
        beam = min(n, beam * 2)
