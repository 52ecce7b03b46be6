"""Sequential algorithms on one component, for use within grouped maps.

Input is a list of (src, dst, weight) rows of one component.
"""

from __future__ import annotations

import heapq
import random
import time
from collections import defaultdict, deque


def neighbours(rows) -> dict[int, set[int]]:
    """Simple undirected adjacency."""
    out: dict[int, set[int]] = defaultdict(set)
    for a, b, *_ in rows:
        if a != b:
            out[a].add(b)
            out[b].add(a)
    return out


def bridges_and_cuts(adj: dict[int, set[int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Bridges (u < v) and articulation points by low-links, without recursion."""
    depth: dict[int, int] = {}
    low: dict[int, int] = {}
    bridges, cuts = [], set()
    for root in sorted(adj):
        if root in depth:
            continue
        depth[root] = low[root] = 0
        stack = [(root, None, iter(sorted(adj[root])))]
        root_children = 0
        while stack:
            v, parent, rest = stack[-1]
            for w in rest:
                if w == parent:
                    continue
                if w in depth:
                    low[v] = min(low[v], depth[w])
                else:
                    depth[w] = low[w] = depth[v] + 1
                    stack.append((w, v, iter(sorted(adj[w]))))
                    break
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[v])
                    if low[v] > depth[parent]:
                        bridges.append((min(parent, v), max(parent, v)))
                    if parent == root:
                        root_children += 1
                    elif low[v] >= depth[parent]:
                        cuts.add(parent)
        if root_children > 1:
            cuts.add(root)
    return sorted(bridges), sorted(cuts)


def matching(adj: dict[int, set[int]], left: set[int]) -> list[tuple[int, int]]:
    """A largest matching of a bipartite component (Hopcroft and Karp)."""
    mate: dict[int, int] = {}
    while True:
        level = {v: 0 for v in left if v not in mate}
        queue, free_found = deque(sorted(level)), False
        while queue:
            v = queue.popleft()
            for w in adj[v]:
                nxt = mate.get(w)
                if nxt is None:
                    free_found = True
                elif nxt not in level:
                    level[nxt] = level[v] + 1
                    queue.append(nxt)
        if not free_found:
            return sorted((v, mate[v]) for v in left if v in mate)
        pending = {v: iter(sorted(adj[v])) for v in level}
        for start in sorted(v for v in level if v not in mate):
            trail = [start]
            edges: list[tuple[int, int]] = []
            while trail:
                v = trail[-1]
                for w in pending[v]:
                    nxt = mate.get(w)
                    if nxt is None:
                        for a, b in [*edges, (v, w)]:
                            mate[a], mate[b] = b, a
                        trail = []
                        break
                    if level.get(nxt) == level[v] + 1:
                        edges.append((v, w))
                        trail.append(nxt)
                        break
                else:
                    trail.pop()
                    if edges:
                        edges.pop()


def betweenness(rows, weighted: bool) -> dict[int, float]:
    """Dependencies of all sources over directed rows, ends excluded (Brandes); parallel rows count apart."""
    adj: dict[int, list] = {}
    for a, b, w in rows:
        adj.setdefault(a, []).append((b, w))
        adj.setdefault(b, [])
    score = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, before, order = {s: 0.0}, {s: 1.0}, {s: []}, []
        if weighted:
            heap, done = [(0.0, s)], set()
            while heap:
                d, v = heapq.heappop(heap)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for t, w in adj[v]:
                    if t not in dist or d + w < dist[t]:
                        dist[t], sigma[t], before[t] = d + w, sigma[v], [v]
                        heapq.heappush(heap, (d + w, t))
                    elif d + w == dist[t]:
                        sigma[t] += sigma[v]
                        before[t].append(v)
        else:
            order.append(s)
            for v in order:
                d = dist[v] + 1
                for t, _ in adj[v]:
                    if t not in dist:
                        dist[t], sigma[t], before[t] = d, sigma[v], [v]
                        order.append(t)
                    elif dist[t] == d:
                        sigma[t] += sigma[v]
                        before[t].append(v)
        unit = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            share = (1.0 + unit[v]) / sigma[v]
            for u in before[v]:
                unit[u] += sigma[u] * share
            if v != s:
                score[v] += unit[v]
    return score


def reach_all(rows) -> tuple[list[int], list[int]]:
    """Every node with each node that it reaches, itself included."""
    adj: dict[int, list[int]] = {}
    for a, b in rows:
        adj.setdefault(a, []).append(b)
        adj.setdefault(b, [])
    src, dst = [], []
    for s in adj:
        seen, order = {s}, [s]
        for v in order:
            for t in adj[v]:
                if t not in seen:
                    seen.add(t)
                    order.append(t)
        src += [s] * len(order)
        dst += order
    return src, dst


def replaced_edges(rows) -> list[tuple[int, int]] | None:
    """The edges that a longer way replaces; None where there is a cycle."""
    adj: dict[int, set[int]] = {}
    entries: dict[int, int] = {}
    for a, b in rows:
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set())
    for v in adj:
        for t in adj[v]:
            entries[t] = entries.get(t, 0) + 1
    order = [v for v in adj if v not in entries]
    for v in order:
        for t in adj[v]:
            entries[t] -= 1
            if not entries[t]:
                order.append(t)
    if len(order) < len(adj):
        return None
    below: dict[int, set[int]] = {}
    out = []
    for v in reversed(order):
        longer = set().union(*(below[t] for t in adj[v]))
        out += [(v, t) for t in adj[v] if t in longer]
        below[v] = longer | adj[v]
    return out


def core_numbers(adj: dict[int, set[int]]) -> dict[int, int]:
    """Core numbers by taking the node of least degree away."""
    degree = {v: len(near) for v, near in adj.items()}
    heap = [(d, v) for v, d in degree.items()]
    heapq.heapify(heap)
    core: dict[int, int] = {}
    k = 0
    while heap:
        d, v = heapq.heappop(heap)
        if v in core or d != degree[v]:
            continue
        core[v] = k = max(k, d)
        for w in adj[v]:
            if w not in core:
                degree[w] -= 1
                heapq.heappush(heap, (degree[w], w))
    return core


def maximal_cliques(candidates: set[int], excluded: set[int], adj: dict[int, set[int]]) -> list[list[int]]:
    """Maximal cliques within ``candidates`` that no member of ``excluded`` extends (Bron and Kerbosch with pivots)."""
    out, stack = [], [([], candidates, excluded)]
    while stack:
        clique, p, x = stack.pop()
        if not p and not x:
            out.append(sorted(clique))
            continue
        if not p:
            continue
        pivot = max(p | x, key=lambda u: (len(p & adj[u]), -u))
        for v in sorted(p - adj[pivot]):
            stack.append(([*clique, v], p & adj[v], x & adj[v]))
            p, x = p - {v}, x | {v}
    return out


def dsatur(adj: dict[int, set[int]]) -> dict[int, int]:
    """Greedy colours from 1: most different neighbour colours first, then degree, then lowest id."""
    color: dict[int, int] = {}
    seen = {v: set() for v in adj}
    heap = [(0, -len(adj[v]), v) for v in adj]
    heapq.heapify(heap)
    while heap:
        saturation, _, v = heapq.heappop(heap)
        if v in color or -saturation != len(seen[v]):
            continue
        c = 1
        while c in seen[v]:
            c += 1
        color[v] = c
        for w in adj[v]:
            if w not in color and c not in seen[w]:
                seen[w].add(c)
                heapq.heappush(heap, (-len(seen[w]), -len(adj[w]), w))
    return color


def exact_coloring(adj: dict[int, set[int]], seconds: float) -> tuple[dict[int, int], bool]:
    """A colouring with the fewest colours, and whether that is proven within ``seconds``."""
    best = dsatur(adj)
    order = sorted(adj, key=lambda v: (-len(adj[v]), v))
    clique: list[int] = []
    for v in order:
        if all(v in adj[c] for c in clique):
            clique.append(v)
    order = clique + [v for v in order if v not in clique]
    until = time.monotonic() + seconds
    most = max(best.values(), default=0)
    color: dict[int, int] = {}
    choices = [iter(())] * len(order)
    top = [0] * (len(order) + 1)
    at = 0
    fresh = True
    steps = 0
    while most > len(clique):
        steps += 1
        if steps % 512 == 0 and time.monotonic() > until:
            return best, False
        if at == len(order):
            best, most = dict(color), top[at]
            at, fresh = at - 1, False
            color.pop(order[at])
            continue
        v = order[at]
        if fresh:
            taken = {color[w] for w in adj[v] if w in color}
            choices[at] = iter([c for c in range(1, top[at] + 2) if c not in taken])
        c = next((c for c in choices[at] if max(c, top[at]) < most), None)
        if c is None:
            if at == 0:
                break
            at, fresh = at - 1, False
            color.pop(order[at])
            continue
        color[v], top[at + 1] = c, max(top[at], c)
        at, fresh = at + 1, True
    return best, True


def max_flow(rows, source: int, sink: int, algorithm: str) -> tuple[float, dict[tuple[int, int], float]]:
    """Value and residual capacities by pair; ``algorithm`` is edmonds_karp or push_relabel."""
    residual: dict[tuple[int, int], float] = defaultdict(float)
    adj: dict[int, set[int]] = defaultdict(set)
    for a, b, w in rows:
        residual[a, b] += w
        residual[b, a] += 0.0
        adj[a].add(b)
        adj[b].add(a)
    if source == sink:
        return 0.0, residual
    return (_push_relabel if algorithm == "push_relabel" else _augment)(residual, adj, source, sink), residual


def _augment(residual, adj, source: int, sink: int) -> float:
    value = 0.0
    while True:
        parent = {source: source}
        queue = deque([source])
        while queue and sink not in parent:
            v = queue.popleft()
            for w in sorted(adj[v]):
                if w not in parent and residual[v, w] > 0:
                    parent[w] = v
                    queue.append(w)
        if sink not in parent:
            return value
        path, v = [], sink
        while v != source:
            path.append((parent[v], v))
            v = parent[v]
        push = min(residual[e] for e in path)
        for a, b in path:
            residual[a, b] -= push
            residual[b, a] += push
        value += push


def _push_relabel(residual, adj, source: int, sink: int) -> float:
    n = len(adj)
    height = dict.fromkeys(adj, n)
    height[sink] = 0
    queue = deque([sink])
    reached = {sink}
    while queue:  # heights start as distances to the sink
        v = queue.popleft()
        for w in adj[v]:
            if w not in reached and residual[w, v] > 0:
                reached.add(w)
                height[w] = height[v] + 1
                queue.append(w)
    height[source] = n
    excess: dict[int, float] = defaultdict(float)
    counts: dict[int, int] = defaultdict(int)
    for v in adj:
        counts[height[v]] += 1
    active: list[tuple[int, int]] = []

    def push(a: int, b: int, amount: float) -> None:
        residual[a, b] -= amount
        residual[b, a] += amount
        excess[a] -= amount
        if excess[b] == 0 and b not in (source, sink):
            heapq.heappush(active, (-height[b], b))
        excess[b] += amount

    for w in sorted(adj[source]):
        if residual[source, w] > 0:
            push(source, w, residual[source, w])
    while active:
        h, v = heapq.heappop(active)
        if -h != height[v] or excess[v] <= 0:
            continue
        while excess[v] > 0:
            for w in sorted(adj[v]):
                if residual[v, w] > 0 and height[v] == height[w] + 1:
                    push(v, w, min(excess[v], residual[v, w]))
                    if excess[v] <= 0:
                        break
            if excess[v] <= 0:
                break
            old = height[v]
            new = 1 + min(height[w] for w in adj[v] if residual[v, w] > 0)
            counts[old] -= 1
            if counts[old] == 0 and old < n:  # nothing above the gap reaches the sink
                for u in adj:
                    if old < height[u] < n and u != v:
                        counts[height[u]] -= 1
                        height[u] = n + 1
                        counts[n + 1] += 1
                        if excess[u] > 0 and u not in (source, sink):
                            heapq.heappush(active, (-height[u], u))
                new = max(new, n + 1)
            height[v] = new
            counts[new] += 1
    return excess[sink]


def residual_side(residual, source: int) -> set[int]:
    """What the source still reaches."""
    out, links = {source}, defaultdict(list)
    for (a, b), c in residual.items():
        if c > 0:
            links[a].append(b)
    queue = deque([source])
    while queue:
        for w in links[queue.popleft()]:
            if w not in out:
                out.add(w)
                queue.append(w)
    return out


def stoer_wagner(rows) -> tuple[float, set[int]]:
    """Global minimum cut of a connected graph of summed weights, and one side."""
    weight: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b, w in rows:
        if a != b:
            weight[a][b] += w
    for a in list(weight):
        for b in list(weight[a]):
            weight[b][a] += 0.0
    groups = {v: {v} for v in weight}
    best, side = float("inf"), set()
    while len(groups) > 1:
        start = min(groups)
        attached = dict.fromkeys(groups, 0.0)
        heap = [(0.0, start)]
        done: list[int] = []
        inside: set[int] = set()
        while len(done) < len(groups):
            while True:
                w, v = heapq.heappop(heap) if heap else (0.0, min(set(groups) - inside))
                if v not in inside and -w == attached[v]:
                    break
            inside.add(v)
            done.append(v)
            for u, x in weight[v].items():
                if u not in inside:
                    attached[u] += x
                    heapq.heappush(heap, (-attached[u], u))
        last, before = done[-1], done[-2]
        if attached[last] < best:
            best, side = attached[last], set(groups[last])
        groups[before] |= groups.pop(last)
        for u, x in weight.pop(last).items():
            del weight[u][last]
            if u != before:
                weight[before][u] += x
                weight[u][before] += x
    return best, side


class _Partition:
    """Communities of one level with the sums that modularity gains need."""

    def __init__(self, adj: dict[int, dict[int, float]], loops: dict[int, float], start: dict[int, int]):
        self.adj, self.of = adj, dict(start)
        self.degree = {v: sum(adj[v].values()) + loops.get(v, 0.0) for v in adj}
        self.total: dict[int, float] = defaultdict(float)
        for v, c in self.of.items():
            self.total[c] += self.degree[v]

    def links(self, v: int) -> dict[int, float]:
        out: dict[int, float] = defaultdict(float)
        for w, x in self.adj[v].items():
            out[self.of[w]] += x
        return out

    def gain(self, v: int, to: int, links: dict[int, float], m2: float) -> float:
        """Growth of modularity, times m, by moving ``v`` from its community."""
        own, k = self.of[v], self.degree[v]
        return 2 * ((links.get(to, 0.0) - links.get(own, 0.0)) / m2 + k * (self.total[own] - k - self.total[to]) / m2**2)

    def move(self, v: int, to: int) -> None:
        self.total[self.of[v]] -= self.degree[v]
        self.total[to] += self.degree[v]
        self.of[v] = to


def _local_moves(p: _Partition, m2: float, least: float, sweeps: int, rng: random.Random) -> bool:
    order = sorted(p.adj)
    rng.shuffle(order)
    moved_any = False
    for _ in range(sweeps):
        moved = False
        for v in order:
            links = p.links(v)
            best, to = max(((p.gain(v, c, links, m2), -c) for c in links if c != p.of[v]), default=(0.0, 0))
            if best > least:
                p.move(v, -to)
                moved = moved_any = True
        if not moved:
            break
    return moved_any


def _refine(p: _Partition, parent: dict[int, int], m2: float, theta: float, rng: random.Random) -> dict[int, int]:
    """Communities within ``parent``: lone nodes join one at random, likelier where the gain is larger."""
    from math import exp

    order = sorted(p.adj)
    rng.shuffle(order)
    size = dict.fromkeys(p.adj, 1)
    fine = _Partition(p.adj, {}, {v: v for v in p.adj})
    fine.degree = p.degree
    fine.total = defaultdict(float, p.degree)
    for v in order:
        if size[fine.of[v]] != 1:
            continue
        links: dict[int, float] = defaultdict(float)
        for w, x in p.adj[v].items():
            if parent[w] == parent[v]:
                links[fine.of[w]] += x
        options = [(c, g) for c in sorted(links) if c != fine.of[v] and (g := fine.gain(v, c, links, m2)) >= 0]
        weights = [1.0] + [exp(min(g * m2 / theta, 50.0)) for _, g in options]
        chosen = rng.choices([fine.of[v]] + [c for c, _ in options], weights)[0]
        if chosen != fine.of[v]:
            size[fine.of[v]] -= 1
            size[chosen] += 1
            fine.move(v, chosen)
    return fine.of


def communities(rows, m2: float, *, refine: bool, least: float = 1e-6, sweeps: int = 100, theta: float = 1.0, seed: int = 42) -> list[dict[int, int]]:
    """Partitions of one component from the finest to the coarsest level.

    Louvain: local moves, then the communities become nodes.  With ``refine``
    (Leiden) the refined communities become nodes, which start in the
    communities of the local moves.
    """
    rng = random.Random(seed)
    adj: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    loops: dict[int, float] = defaultdict(float)
    for a, b, w in rows:
        adj[a]
        if a == b:
            loops[a] += w
        else:
            adj[a][b] += w
    member = {v: v for v in adj}  # original node -> node of this level
    start = {v: v for v in adj}
    levels: list[dict[int, int]] = []
    while True:
        p = _Partition(adj, loops, start)
        moved = _local_moves(p, m2, least, sweeps, rng)
        coarse = {v: p.of[member[v]] for v in member}
        if not moved or len(set(p.of.values())) == 1:
            if not levels or coarse != levels[-1]:
                levels.append(coarse)
            return levels
        groups = _refine(p, p.of, m2, theta, rng) if refine else dict(p.of)
        if refine and len(set(groups.values())) == len(adj):
            groups = dict(p.of)
        names = {}
        for v in sorted(groups):
            names.setdefault(groups[v], v)
        group = {v: names[groups[v]] for v in groups}
        levels.append({v: group[member[v]] for v in member} if refine else coarse)
        start = {}
        for v in group:
            start[group[v]] = p.of[v] if refine else group[v]
        tags = {}
        for v in sorted(start):
            tags.setdefault(start[v], v)
        start = {v: tags[c] for v, c in start.items()}
        new_adj: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        new_loops: dict[int, float] = defaultdict(float)
        for v in adj:
            new_adj[group[v]]
            new_loops[group[v]] += loops[v]
            for w, x in adj[v].items():
                if group[v] == group[w]:
                    new_loops[group[v]] += x
                else:
                    new_adj[group[v]][group[w]] += x
        adj, loops = new_adj, new_loops
        member = {v: group[member[v]] for v in member}
