"""Balanced centroids of a bounded sample, and a neighbour graph that searches them in memory, all queries of a batch at once."""

from __future__ import annotations

import heapq

import numpy as np

DEGREE, PIVOTS = 24, 16


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Halves the sample along its two-means direction, at the median, until there are enough equal cells; their means."""
    cells, rng, made = [(-len(sample), 0, np.arange(len(sample)))], np.random.default_rng(5), 1
    while len(cells) < lists and cells[0][0] < -1:
        own = heapq.heappop(cells)[2]
        x = sample[own]
        a, b = x[rng.choice(len(own), 2, replace=False)]
        for _ in range(6):
            near = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
        order = np.argsort(x @ (a - b), kind="stable")
        for half in (own[order[: len(own) // 2]], own[order[len(own) // 2 :]]):
            heapq.heappush(cells, (-len(half), made, half))
            made += 1
    return np.stack([sample[c].mean(0) for _, _, c in sorted(cells, key=lambda x: x[1])]) if len(sample) else sample


class CentroidGraph:
    """Each centroid knows its nearest ones; a search walks from the best pivot, keeping a beam."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n = len(centroids)
        self.norm = (centroids**2).sum(1)
        near = []
        for i in range(0, n, 512):
            d = self.norm[i : i + 512, None] + self.norm[None] - 2 * centroids[i : i + 512] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            m = min(DEGREE // 2, n - 1)
            some = np.argpartition(d, m - 1, 1)[:, :m] if 0 < m < n else np.argsort(d, 1)[:, :m]
            near.append(np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), 1, kind="stable"), 1))
        near = np.concatenate(near) if near else np.zeros((0, 0), np.int64)
        back: list[list[int]] = [row.tolist() for row in near]
        for i, row in enumerate(near.tolist()):
            for j in row:
                if len(back[j]) < DEGREE and i not in back[j]:
                    back[j].append(i)
        # a ring through all centroids keeps the graph in one piece
        width = DEGREE + 1
        self.links = np.full((n, width), -1, np.int64)
        for i, row in enumerate(back):
            row = row[:DEGREE] + [(i + 1) % n]
            self.links[i, : len(row)] = row
        self.pivots = np.linspace(0, n - 1, min(n, PIVOTS)).astype(np.int64)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row, as far as the walk finds them, and their squared distances."""
        m, n = len(x), len(self.c)
        beam = min(beam, n)
        sq = (x**2).sum(1)
        seen = np.zeros((m, n), bool)
        ids = np.broadcast_to(self.pivots, (m, len(self.pivots)))
        dist = sq[:, None] + self.norm[self.pivots][None] - 2 * x @ self.c[self.pivots].T
        seen[:, self.pivots] = True
        order = np.argsort(dist, 1)[:, :beam]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        if ids.shape[1] < beam:
            pad = beam - ids.shape[1]
            ids, dist = np.pad(ids, ((0, 0), (0, pad))), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        done = np.isinf(dist)
        live = np.arange(m)
        while len(live):
            open_dist = np.where(done[live], np.inf, dist[live])
            pick = open_dist.argmin(1)
            more = np.isfinite(open_dist[np.arange(len(live)), pick])
            live, pick = live[more], pick[more]
            if not len(live):
                break
            done[live, pick] = True
            to = self.links[ids[live, pick]]
            new = (to >= 0) & ~np.take_along_axis(seen[live], np.maximum(to, 0), 1)
            r, c = np.nonzero(new)
            t = to[r, c]
            seen[live[r], t] = True
            d = np.full(to.shape, np.inf)
            d[r, c] = sq[live[r]] + self.norm[t] - 2 * np.einsum("ij,ij->i", x[live[r]], self.c[t])
            all_d = np.concatenate([dist[live], d], 1)
            order = np.argpartition(all_d, beam - 1, 1)[:, :beam]
            dist[live] = np.take_along_axis(all_d, order, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], to], 1), order, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], np.isinf(d)], 1), order, 1)
        order = np.argsort(dist, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)
