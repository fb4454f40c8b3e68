"""Hierarchical navigable small-world graphs in numpy, searched and built for many points at a time.

Points are unit rows of a float32 matrix, ordered so that the points of each layer are the first ones of the matrix.
Layers are built from the top; the points of a layer are put in by batches that grow with what is there: each batch
searches the graph so far, also looks at its own members, chooses diverse neighbours, and is linked back."""

from __future__ import annotations

import numpy as np

M, M0, BUILD_BEAM, SCALE, FIRST, BATCH = 16, 32, 32, 16, 256, 1024
#: Cells of a table of visited points; it bounds how many queries go together.
CELLS = 24_000_000


def layer_sizes(n: int) -> list[int]:
    """Points of each layer, the ground layer first; a sixteenth of the points goes up."""
    out = [n]
    while out[-1] > SCALE * 4:
        out.append(out[-1] // SCALE)
    return out


def search(x: np.ndarray, links: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best `beam` points found for each row of q, and their similarities, descending; -1 where there are fewer."""
    n, m = len(links), len(q)
    step = max(1, CELLS // max(1, n))
    if m > step:
        parts = [search(x, links, q[i : i + step], entries[i : i + step], beam) for i in range(0, m, step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ids = np.full((m, beam), -1, np.int32)
    sims = np.full((m, beam), -np.inf, np.float32)
    done = np.ones((m, beam), bool)
    visited = np.zeros((m, n + 1), bool)
    visited[:, n] = True  # where links of fewer neighbours point to
    entries = entries[:, -beam:]
    e = entries.shape[1]
    start = np.where(entries < 0, n, entries)
    row = np.arange(m)[:, None]
    fresh = ~visited[row, start]
    fresh &= ~(np.tril(start[:, :, None] == start[:, None, :], -1).any(2))  # entries may name a point twice
    visited[row, start] = True
    s = np.where(fresh, np.matmul(x[np.minimum(start, n - 1)], q[:, :, None])[:, :, 0], -np.inf)
    ids[:, :e], sims[:, :e], done[:, :e] = np.where(fresh, start, -1), s, ~fresh
    active = np.arange(m)
    while len(active):
        a_ids, a_sims, a_done = ids[active], sims[active], done[active]
        open_sims = np.where(a_done, -np.inf, a_sims)
        best = open_sims.argmax(1)
        go = np.isfinite(open_sims[np.arange(len(active)), best])
        if not go.all():
            active, a_ids, a_sims, a_done, best = active[go], a_ids[go], a_sims[go], a_done[go], best[go]
            if not len(active):
                break
        r = np.arange(len(active))
        a_done[r, best] = True
        near = links[a_ids[r, best]]
        near = np.where(near < 0, n, near)
        fresh = ~visited[active[:, None], near]
        visited[active[:, None], near] = True
        s = np.matmul(x[np.minimum(near, n - 1)], q[active][:, :, None])[:, :, 0]
        s = np.where(fresh, s, -np.inf).astype(np.float32)
        all_sims = np.concatenate((a_sims, s), 1)
        keep = np.argpartition(all_sims, all_sims.shape[1] - beam, axis=1)[:, -beam:]
        at = r[:, None]
        ids[active] = np.concatenate((a_ids, np.where(fresh, near, -1)), 1)[at, keep]
        sims[active] = all_sims[at, keep]
        done[active] = np.concatenate((a_done, ~fresh), 1)[at, keep]
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int, width: int = 0) -> np.ndarray:
    """Up to `most` of each row of candidates (sorted by similarity, -1 for none): first those that are nearer to
    the point than to any chosen before, then the nearest of the rest. Rows are filled up with -1 to `width`."""
    m, c = cand.shape
    v = x[np.maximum(cand, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((m, c), bool)
    worst = np.full((m, c), -np.inf, np.float32)
    count = np.zeros(m, int)
    for k in range(c):
        ok = (cand[:, k] >= 0) & (sims[:, k] > worst[:, k]) & (count < most)
        chosen[:, k] = ok
        count += ok
        worst = np.where(ok[:, None], np.maximum(worst, among[:, k]), worst)
    rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, max(most, width) - out.shape[1])), constant_values=-1)


def exact(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    s = q @ x.T
    if own is not None:
        s[np.arange(len(q)), own] = -np.inf
    k = min(k, s.shape[1])
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, 1)
    got = np.take_along_axis(s, top, 1)
    return np.where(np.isfinite(got), top, -1).astype(np.int32), got


class Graph:
    """Links of each layer, the ground layer first."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray]):
        self.x, self.layers = x, layers

    def entries(self, q: np.ndarray, down_to: int = 0, wide: int = 8) -> np.ndarray:
        """Where to enter a layer: the points that searches of the layers above it find."""
        at = np.zeros((len(q), 1), np.int32)
        for links in self.layers[:down_to:-1]:
            at = search(self.x[: len(links)], links, q, at, wide)[0]
        return at

    def near(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        return search(self.x, self.layers[0], q, self.entries(q), beam)


def build(x: np.ndarray) -> Graph:
    g = Graph(x, [])
    for depth, n in enumerate(reversed(layer_sizes(len(x)))):
        ground = n == len(x)
        most = M0 if ground else M
        links = np.full((n, most), -1, np.int32)
        g.layers.insert(0, links)
        done = min(n, FIRST)
        if done > 1:
            cand, sims = exact(x[:done], x[:done], BUILD_BEAM, np.arange(done))
            links[:done] = diverse(x, cand, sims, most)
        while done < n:
            m = min(BATCH, done, n - done)
            q = x[done : done + m]
            at = g.entries(q)
            at = np.concatenate((np.where(at < done, at, -1), np.zeros((m, 1), np.int32)), 1)
            cand, sims = search(x[:done], links[:done], q, at, BUILD_BEAM)
            own, own_sims = exact(q, q, BUILD_BEAM // 3, np.arange(m))
            cand, sims = np.concatenate((cand, np.where(own >= 0, own + done, -1)), 1), np.concatenate((sims, own_sims), 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            chosen = diverse(x, cand, sims, M)
            links[done : done + m, :M] = chosen
            _link_back(x, links, chosen, done)
            done += m
    return g


def _link_back(x: np.ndarray, links: np.ndarray, chosen: np.ndarray, first: int) -> None:
    """Adds new points to the lists of the points that they chose, which keep the most diverse."""
    most = links.shape[1]
    new = np.repeat(np.arange(first, first + len(chosen)), chosen.shape[1])
    to = chosen.ravel()
    new, to = new[to >= 0], to[to >= 0]
    sims = np.einsum("nd,nd->n", x[new], x[to])
    order = np.lexsort((-sims, to))
    new, to = new[order], to[order]
    points, at, counts = np.unique(to, return_index=True, return_counts=True)
    held = (links[points] >= 0).sum(1)
    room = held + counts <= most  # these just take the new ones
    k = np.arange(len(new)) - np.repeat(at, counts)
    fits = np.repeat(room, counts)
    links[to[fits], (np.repeat(held, counts) + k)[fits]] = new[fits]
    points, at, counts = points[~room], at[~room], np.minimum(counts[~room], most // 2)
    width = int(counts.max(initial=0))
    for i in range(0, len(points), 2048):
        p, a, c = points[i : i + 2048], at[i : i + 2048], counts[i : i + 2048]
        k = np.arange(width)[None, :]
        added = np.where(k < c[:, None], new[np.minimum(a[:, None] + k, len(new) - 1)], -1)
        cand = np.concatenate((links[p], added), 1)
        s = np.where(cand >= 0, np.matmul(x[np.maximum(cand, 0)], x[p][:, :, None])[:, :, 0], -np.inf)
        order = np.argsort(-s, axis=1, kind="stable")
        links[p] = diverse(x, np.take_along_axis(cand, order, 1), np.take_along_axis(s, order, 1), most * 3 // 4, most)


def audited_beam(g: Graph, similarity: float, recall: float, seed: int = 0, first: int = 32, queries: int = 512) -> int:
    """The beam, doubled from `first`, with which queries at the given similarity to points of the graph find them
    with the recall asked for; 0 if only a scan of all points would do."""
    n, d = g.x.shape
    rng = np.random.default_rng(seed)
    at = rng.choice(n, min(n, queries), replace=False)
    side = rng.standard_normal((len(at), d)).astype(np.float32)
    side -= np.einsum("nd,nd->n", side, g.x[at])[:, None] * g.x[at]
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    q = similarity * g.x[at] + np.sqrt(1 - similarity**2) * np.where(norm > 1e-6, side / np.maximum(norm, 1e-6), 0)
    beam = first
    while beam < n:
        ids, sims = g.near(q.astype(np.float32), beam)
        # found, or pushed out of a beam that is full of nearer points, which a wider beam is for anyway
        hit = (ids == at[:, None]).any(1) | (sims[:, -1] >= similarity)
        if hit.mean() >= recall:
            return beam
        beam *= 2
    return 0
