"""Graphs of ordered pairs, one a document: greedy acyclic subgraphs, cycles, paths and reachability.

A document's graph has as many nodes as it has event triggers, so the sequential algorithms run on one
document's edges at a time, in parallel over documents.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame

# Limits of exact cycle search.
MOST_NODES, MOST_EDGES, MOST_CYCLES = 120, 800, 1000

DAG_SCHEMA = "doc_id bigint, src string, dst string, confidence double, kept boolean, src_order int, dst_order int"
SHAPE_SCHEMA = "doc_id bigint, nodes int, edges int, longest_path int, mean_depth double, global_coherence double, is_dag boolean"
CYCLE_SCHEMA = "doc_id bigint, cycle_count int, cycle_edges int, approx int"


def topological(nodes: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """Nodes in topological order, smallest name first among equals; None if there is a cycle."""
    into = dict.fromkeys(nodes, 0)
    out: dict[str, list[str]] = {n: [] for n in nodes}
    for a, b in edges:
        into[b] += 1
        out[a].append(b)
    ready, order = sorted(n for n in nodes if not into[n]), []
    while ready:
        x = heapq.heappop(ready)
        order.append(x)
        for y in out[x]:
            into[y] -= 1
            if not into[y]:
                heapq.heappush(ready, y)
    return order if len(order) == len(nodes) else None


def acyclic(pairs: list[tuple[str, str]]) -> list[bool]:
    """Whether each pair, in order, is kept: not a loop, and its end doesn't reach its start by those kept before."""
    number = {x: i for i, x in enumerate(dict.fromkeys(x for pair in pairs for x in pair))}
    below, above = [0] * len(number), [0] * len(number)
    kept = []
    for a, b in pairs:
        i, j = number[a], number[b]
        ok = i != j and not below[j] >> i & 1
        kept.append(ok)
        if ok and not below[i] >> j & 1:
            down, up = below[j] | 1 << j, above[i] | 1 << i
            for of, ends, starts in ((below, up, down), (above, down, up)):
                while ends:
                    x = (ends & -ends).bit_length() - 1
                    of[x] |= starts
                    ends &= ends - 1
    return kept


def _greedy(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values(["confidence", "src", "dst"], ascending=[False, True, True])
    pairs = list(zip(g["src"], g["dst"]))
    kept = acyclic(pairs)
    nodes = sorted({*g["src"], *g["dst"]})
    order = topological(nodes, sorted({x for x, ok in zip(pairs, kept) if ok}))
    rank = {n: i for i, n in enumerate(order or nodes)}
    return pd.DataFrame({"doc_id": g["doc_id"], "src": g["src"], "dst": g["dst"], "confidence": g["confidence"], "kept": kept, "src_order": g["src"].map(rank), "dst_order": g["dst"].map(rank)})


def greedy_dag(edges: DataFrame) -> DataFrame:
    """Edges by falling confidence, each kept unless it closes a cycle; with the topological ranks of its ends.

    ``edges(doc_id, src, dst, confidence)``; self loops are never kept.
    """
    return edges.select("doc_id", "src", "dst", "confidence").groupBy("doc_id").applyInPandas(_greedy, DAG_SCHEMA)


def _reachable(nodes: list[str], out: dict[str, list[str]], order: list[str] | None) -> int:
    """Pairs of a node and another one that a path leads to: by sets of bits in topological order, by search where there is none."""
    pairs = 0
    if order:
        bit = {n: 1 << i for i, n in enumerate(order)}
        below: dict[str, int] = {}
        for x in reversed(order):
            bits = 0
            for y in out[x]:
                bits |= bit[y] | below[y]
            below[x] = bits
            pairs += bits.bit_count()
        return pairs
    for n in nodes:
        seen, stack = set(), [n]
        while stack:
            for y in out[stack.pop()]:
                if y not in seen and y != n:
                    seen.add(y)
                    stack.append(y)
        pairs += len(seen)
    return pairs


def shape(edges: list[tuple[str, str]]) -> tuple[int, int, int, float, float, bool]:
    """Nodes, edges, longest path, mean depth, coherence and whether it is acyclic, from sorted edges without repetition."""
    nodes = sorted({x for pair in edges for x in pair})
    order = topological(nodes, edges)
    out: dict[str, list[str]] = {n: [] for n in nodes}
    into: dict[str, int] = dict.fromkeys(nodes, 0)
    for a, b in edges:
        out[a].append(b)
        into[b] += 1
    longest = 0
    if order:
        far = dict.fromkeys(nodes, 0)
        for x in order:
            for y in out[x]:
                far[y] = max(far[y], far[x] + 1)
        longest = max(far.values(), default=0)
    at = {n: 0 for n in nodes if not into[n]}
    queue = list(at)
    for x in queue:
        for y in out[x]:
            if y not in at:
                at[y] = at[x] + 1
                queue.append(y)
    depth = sum(at.values()) / len(at) if at else 0.0
    pairs = _reachable(nodes, out, order)
    coherence = len(edges) / pairs if pairs else 0.0
    return len(nodes), len(edges), longest, depth, coherence, order is not None


def _shape(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(g["doc_id"].iloc[0], *shape(sorted(set(zip(g["src"], g["dst"])))))], columns=[c.split()[0] for c in SHAPE_SCHEMA.split(", ")])


def shapes(edges: DataFrame) -> DataFrame:
    """Per document: longest path, mean depth from the sources, and edges over reachable pairs."""
    return edges.select("doc_id", "src", "dst").groupBy("doc_id").applyInPandas(_shape, SHAPE_SCHEMA)


def _simple_cycles(out: list[list[int]], used: set) -> int:
    """Number of simple cycles up to MOST_CYCLES, each found from its least node; their edges are added to ``used``.

    Johnson's search: a node that led back to no start stays blocked until a node after it is left on a cycle, so
    there is a bounded number of steps for each cycle, and the cycles come in the order of a plain search.
    """
    count, into = 0, [[] for _ in out]
    for a, ends in enumerate(out):
        for b in ends:
            into[b].append(a)
    for start in range(len(out)):
        ahead, back = {start}, {start}
        for links, seen in ((out, ahead), (into, back)):
            stack = [start]
            while stack:
                for y in links[stack.pop()]:
                    if y > start and y not in seen:
                        seen.add(y)
                        stack.append(y)
        inside = ahead & back
        own = {x: [y for y in reversed(out[x]) if y in inside] for x in inside}
        path, stack = [start], [own[start][:]]
        blocked, closed, waiting = {start}, set(), {}
        while stack:
            if stack[-1]:
                y = stack[-1].pop()
                if y == start:
                    count += 1
                    closed.update(path)
                    used.update(zip(path, path[1:]))
                    used.add((path[-1], start))
                    if count >= MOST_CYCLES:
                        return count
                elif y not in blocked:
                    path.append(y)
                    blocked.add(y)
                    closed.discard(y)
                    stack.append(own[y][:])
                continue
            stack.pop()
            x = path.pop()
            if x in closed:
                free = [x]
                while free:
                    y = free.pop()
                    if y in blocked:
                        blocked.discard(y)
                        free += waiting.pop(y, ())
            else:
                for y in own[x]:
                    waiting.setdefault(y, set()).add(x)
    return count


def _short_cycles(out: list[list[int]], used: set) -> int:
    """Number of cycles of up to 4 nodes from the first 50 nodes, up to MOST_CYCLES; their edges are added to ``used``."""
    count = 0
    for start in range(min(50, len(out))):
        stack, path, steps = [iter(out[start])], [start], 0
        while stack and count < MOST_CYCLES and steps < 200_000:
            steps += 1
            y = next(stack[-1], None)
            if y is None:
                stack.pop()
                path.pop()
            elif y == start:
                count += 1
                used.update(zip(path, [*path[1:], start]))
            elif y > start and y not in path and len(path) < 4:
                path.append(y)
                stack.append(iter(out[y]))
        if count >= MOST_CYCLES:
            break
    return count


def found_cycles(edges: list[tuple[str, str]]) -> tuple[int, int, int]:
    """Cycles, edges on them and whether only short ones were tried, from sorted edges without repetition."""
    rank = {n: i for i, n in enumerate(sorted({x for pair in edges for x in pair}))}
    out: list[list[int]] = [[] for _ in rank]
    for a, b in edges:
        out[rank[a]].append(rank[b])
    exact = len(rank) <= MOST_NODES and len(edges) <= MOST_EDGES
    used: set = set()
    count = _simple_cycles(out, used) if exact else _short_cycles(out, used)
    return count, len(used), 0 if exact else 1


def _cycles(g: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([(g["doc_id"].iloc[0], *found_cycles(sorted(set(zip(g["src"], g["dst"])))))], columns=["doc_id", "cycle_count", "cycle_edges", "approx"])


def cycles(edges: DataFrame) -> DataFrame:
    """Simple cycles up to MOST_CYCLES and the edges on them; flagged where only short ones from some starts were tried."""
    return edges.select("doc_id", "src", "dst").groupBy("doc_id").applyInPandas(_cycles, CYCLE_SCHEMA)
