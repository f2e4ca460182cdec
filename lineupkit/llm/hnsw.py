"""A hierarchical navigable small-world graph in numpy, built and searched many vectors at a time."""

from __future__ import annotations

import numpy as np


#: Bytes for the marks of the vectors that searches under way have seen.
SEEN_BYTES = 32 << 20


class Hnsw:
    """Graph over unit vectors (float32, one a row); nearness is the inner product.

    Layers nest: a vector's level is geometric, layer 0 holds all.  Vectors are inserted in rounds
    that double in size; a round's vectors search the graph of the earlier ones together and then
    link to diverse near neighbours, in both directions.
    """

    def __init__(self, vectors: np.ndarray, degree: int = 16, beam: int = 64, seed: int = 1) -> None:
        self.x = np.ascontiguousarray(vectors, np.float32)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        levels = np.minimum(12, (-np.log(1 - rng.random(n)) / np.log(degree)).astype(int))
        self.members = [order[levels[order] >= k] for k in range(int(levels.max(initial=0)) + 1)]
        self.links = [np.full((n, 2 * degree if k == 0 else degree), -1, np.int32) for k in range(len(self.members))]
        self.degree = degree
        # The topmost vector of the first round is where every search starts.
        self.entry = int(self.members[-1][0]) if n else -1
        for k in range(len(self.members) - 1, -1, -1):
            self._build(k, beam)

    def _build(self, layer: int, beam: int) -> None:
        members = self.members[layer]
        members = np.concatenate([[self.entry], members[members != self.entry]]).astype(np.int64)
        done, links = 1, self.links[layer]
        while done < len(members):
            new = members[done : done + max(32, min(done, 2048))]
            if done <= 256:  # few enough to look at all
                near = members[:done]
                sims = self.x[new] @ self.x[near].T
                top = np.argsort(-sims, 1)[:, :beam]
                ids, sims = near[top], np.take_along_axis(sims, top, 1)
            else:
                start = self._descend(self.x[new], layer)
                ids, sims = self._search(self.x[new], start, layer, beam)
            # Vectors of one round see each other too.
            own = self.x[new] @ self.x[new].T
            np.fill_diagonal(own, -2)
            k = min(16, len(new) - 1)
            if k > 0:
                peer = np.argpartition(-own, k - 1, 1)[:, :k]
                ids = np.concatenate([ids, new[peer]], 1)
                sims = np.concatenate([sims, np.take_along_axis(own, peer, 1)], 1)
            self._link(layer, new, ids, sims)
            done += len(new)
        del links

    def _link(self, layer: int, new: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links, room = self.links[layer], self.links[layer].shape[1]
        for at in range(0, len(new), 512):
            some = slice(at, at + 512)
            links[new[some]] = self._diverse(ids[some], sims[some], room)
        # Reverse links: a vector's proposals, nearest first, together with its present links, best kept.
        source = np.repeat(new, room)
        target = links[new].ravel()
        keep = target >= 0
        source, target = source[keep], target[keep]
        value = np.concatenate([np.einsum("ij,ij->i", self.x[source[at : at + 65_536]], self.x[target[at : at + 65_536]]) for at in range(0, len(source), 65_536)] or [[]])
        order = np.lexsort((-value, target))
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(min(count.max(initial=0), 4 * room))  # more than a choice looks at: it takes the nearest 3 * room
        for at in range(0, len(heads), 512):
            h, f, c = heads[at : at + 512], first[at : at + 512], np.minimum(count[at : at + 512], width)
            place = f[:, None] + np.arange(width)
            more = np.where(np.arange(width) < c[:, None], source[np.minimum(place, len(source) - 1)], -1)
            all_ids = np.concatenate([links[h], more], 1)
            sims = np.einsum("ijk,ik->ij", self.x[np.maximum(all_ids, 0)], self.x[h])
            sims[all_ids < 0] = -2
            links[h] = self._diverse(all_ids, sims, room)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, room: int) -> np.ndarray:
        """Up to ``room`` of each row's candidates: near ones that are nearer to the vector than to
        those already chosen, then the nearest of the rest."""
        order = np.argsort(-sims, 1, kind="stable")[:, : 3 * room]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        n, m = ids.shape
        valid = sims > -1.5
        # Repeats of an id stand apart only by rounding: drop those after the first.
        by_id = np.argsort(ids, 1, kind="stable")
        run = np.take_along_axis(ids, by_id, 1)
        again = np.zeros_like(valid)
        np.put_along_axis(again, by_id[:, 1:], run[:, 1:] == run[:, :-1], 1)
        valid &= ~again
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("ijk,ilk->ijl", v, v)
        chosen = np.zeros((n, m), bool)
        nearest = np.full((n, m), -2.0, np.float32)  # to a chosen one
        for j in range(m):
            take = valid[:, j] & (nearest[:, j] < sims[:, j]) & (chosen.sum(1) < room * 3 // 4)
            chosen[:, j] = take
            nearest = np.where(take[:, None], np.maximum(nearest, between[:, j]), nearest)
        rank = np.where(chosen, 0, np.where(valid, 1, 2)) * m + np.arange(m)
        pick = np.argsort(rank, 1)[:, :room]
        out = np.where(np.take_along_axis(valid, pick, 1), np.take_along_axis(ids, pick, 1), -1)
        if out.shape[1] < room:
            out = np.concatenate([out, np.full((n, room - out.shape[1]), -1, out.dtype)], 1)
        return out.astype(np.int32)

    def _descend(self, queries: np.ndarray, layer: int) -> np.ndarray:
        """Greedy walk down to the layer above ``layer``: where each query starts."""
        at = np.full(len(queries), self.entry, np.int64)
        best = queries @ self.x[self.entry]
        for k in range(len(self.members) - 1, layer, -1):
            moving = np.arange(len(queries))
            while len(moving):
                near = self.links[k][at[moving]]
                sims = np.einsum("ijk,ik->ij", self.x[np.maximum(near, 0)], queries[moving])
                sims[near < 0] = -2
                top = sims.argmax(1)
                value = sims[np.arange(len(moving)), top]
                better = value > best[moving] + 1e-7
                moving, top, value = moving[better], top[better], value[better]
                at[moving], best[moving] = near[better][np.arange(len(moving)), top], value
        return at

    def _search(self, queries: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first beam search: (ids, similarities), best first, -1 padded; so many queries at once
        that their marks of seen vectors stay within ``SEEN_BYTES``."""
        step = max(1, SEEN_BYTES // max(1, len(self.x)))
        found = [self._step(queries[k : k + step], start[k : k + step], layer, beam) for k in range(0, max(1, len(queries)), step)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _step(
        self, queries: np.ndarray, start: np.ndarray, layer: int, beam: int, expand: int = 4
    ) -> tuple[np.ndarray, np.ndarray]:
        """The search of some queries in step."""
        q, n = len(queries), len(self.x)
        links = self.links[layer]
        seen = np.zeros((q, n), bool)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -2.0, np.float32)
        open_ = np.zeros((q, beam), bool)
        ids[:, 0], open_[:, 0] = start, True
        sims[:, 0] = np.einsum("ij,ij->i", queries, self.x[start])
        rows = np.arange(q)
        seen[rows, start] = True
        live = rows
        while len(live):
            # The best few unexpanded members of each beam (the beams are sorted).
            rank = np.where(open_[live], np.arange(beam), beam)
            pick = np.partition(rank, min(expand, beam) - 1, 1)[:, :expand] if beam > expand else rank
            ok = pick < beam
            live_rows, pick = live[ok.any(1)], pick[ok.any(1)]
            live = live_rows
            if not len(live):
                break
            ok = pick < beam
            pick = np.minimum(pick, beam - 1)
            r = np.broadcast_to(live[:, None], pick.shape)
            open_[r[ok], pick[ok]] = False
            near = links[np.where(ok, ids[r, pick], 0)].astype(np.int64)
            near[~ok] = -1
            near = near.reshape(len(live), -1)
            known = np.maximum(near, 0)
            fresh = (near >= 0) & ~seen[live[:, None], known]
            # Several expanded members can name the same neighbour: sort to see it once.
            a, b = np.nonzero(fresh)
            flat = live[a] * n + known[a, b]
            flat = np.unique(flat)
            if not len(flat):
                continue
            row, node = flat // n, flat % n
            seen[row, node] = True
            value = np.einsum("ij,ij->i", self.x[node], queries[row])
            good = value > sims[row, beam - 1]
            row, node, value = row[good], node[good], value[good]
            if not len(row):
                continue
            heads, first, count = np.unique(row, return_index=True, return_counts=True)
            width = int(count.max())
            place = np.arange(len(row)) - np.repeat(first, count)
            slot = np.repeat(np.arange(len(heads)), count)
            new_ids = np.full((len(heads), width), -1, np.int64)
            new_sims = np.full((len(heads), width), -2.0, np.float32)
            new_ids[slot, place], new_sims[slot, place] = node, value
            all_sims = np.concatenate([sims[heads], new_sims], 1)
            order = np.argsort(-all_sims, 1, kind="stable")[:, :beam]
            sims[heads] = np.take_along_axis(all_sims, order, 1)
            ids[heads] = np.take_along_axis(np.concatenate([ids[heads], new_ids], 1), order, 1)
            open_[heads] = np.take_along_axis(np.concatenate([open_[heads], new_ids >= 0], 1), order, 1)
        return ids, sims

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest found for each query, best first; -1 where there are fewer."""
        queries = np.ascontiguousarray(queries, np.float32)
        if not len(self.x) or not len(queries):
            return np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -2.0, np.float32)
        return self._search(queries, self._descend(queries, 0), 0, beam)
