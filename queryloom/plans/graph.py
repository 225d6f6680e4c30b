"""The directed multigraph of table relationships."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Edge:
    source: str
    target: str
    label: Any = field(default=None, compare=False)
    default: bool = False


class Graph:
    def __init__(self) -> None:
        self._out: dict[str, list[Edge]] = {}

    def add_node(self, node: str) -> None:
        self._out.setdefault(node, [])

    def add_edge(self, source: str, target: str, label: Any = None, default: bool = False) -> None:
        self.add_node(source)
        self.add_node(target)
        self._out[source].append(Edge(source, target, label, default))

    def nodes(self) -> list[str]:
        return list(self._out)

    def edges(self, node: str) -> list[Edge]:
        return list(self._out.get(node, ()))

    def all_edges(self) -> list[Edge]:
        return [e for edges in self._out.values() for e in edges]

    def has_node(self, node: str) -> bool:
        return node in self._out

    def edges_to(self, source: str, target: str) -> list[Edge]:
        return [e for e in self._out.get(source, ()) if e.target == target]

    def default_edge(self, source: str, target: str) -> Edge | None:
        """The edge marked as default, else the one declared first."""
        edges = self.edges_to(source, target)
        return next((e for e in edges if e.default), edges[0] if edges else None)

    def _known(self, start: str, end: str) -> None:
        if not self.has_node(start):
            raise LookupError(f"Start node '{start}' does not exist.")
        if not self.has_node(end):
            raise LookupError(f"End node '{end}' does not exist.")

    def all_paths(self, start: str, end: str) -> list[list[Edge]]:
        """All simple paths, depth first in order of declaration. Exponential: for small graphs and tests."""
        self._known(start, end)
        if start == end:
            return [[]]
        found: list[list[Edge]] = []

        def walk(node: str, path: list[Edge], seen: set[str]) -> None:
            for e in self._out[node]:
                if e.target == end:
                    found.append([*path, e])
                elif e.target not in seen:
                    walk(e.target, [*path, e], seen | {e.target})

        walk(start, [], {start})
        return found

    def shortest_path(self, start: str, end: str, first: Callable[[Edge], bool] = lambda e: True) -> list[Edge] | None:
        """The shortest path; of several the first by the text ``a>b|b>c``, then by declaration.

        ``first`` says which edges may begin it. Distances to the end come from one
        backward search, so the choice is linear in the graph.
        """
        self._known(start, end)
        into: dict[str, list[str]] = {}
        for e in self.all_edges():
            into.setdefault(e.target, []).append(e.source)
        far, queue = {end: 0}, deque([end])
        while queue:
            node = queue.popleft()
            for source in into.get(node, ()):
                if source not in far:
                    far[source] = far[node] + 1
                    queue.append(source)

        def best(edges: Iterable[Edge]) -> Edge | None:
            near = [e for e in edges if e.target in far and e.target != start or e.target == end]
            return min(near, key=lambda e: (far[e.target], e.target + "|"), default=None)

        path = []
        step = best(e for e in self._out[start] if first(e))
        while step is not None:
            path.append(step)
            if step.target == end:
                return path
            step = best(self._out[step.target])
        return None
