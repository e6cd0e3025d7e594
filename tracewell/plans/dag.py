"""A directed acyclic graph of operators, kept on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from tracewell.plans.nodes import DagNode


class Dag:
    """Nodes in the order in which they were added, which is a topological one, with their parents in order."""

    def __init__(self):
        self._parents: dict[DagNode, tuple[DagNode, ...]] = {}

    def add(self, node: DagNode, parents: tuple[DagNode, ...] = ()) -> DagNode:
        if missing := [p for p in parents if p not in self._parents]:
            raise ValueError(f"unknown parents: {missing}")
        self._parents[node] = parents
        return node

    @property
    def nodes(self) -> list[DagNode]:
        return list(self._parents)

    @property
    def edges(self) -> list[tuple[DagNode, DagNode]]:
        return [(p, n) for n, parents in self._parents.items() for p in parents]

    def parents(self, node: DagNode) -> tuple[DagNode, ...]:
        return self._parents[node]

    def children(self, node: DagNode) -> list[DagNode]:
        return [n for n, parents in self._parents.items() if node in parents]

    def sources(self) -> list[DagNode]:
        return [n for n, parents in self._parents.items() if not parents]

    def sinks(self) -> list[DagNode]:
        used = {p for parents in self._parents.values() for p in parents}
        return [n for n in self._parents if n not in used]

    def topological(self) -> Iterator[DagNode]:
        return iter(self._parents)

    def walk(self, visit: Callable[[DagNode, list], object]) -> dict[DagNode, object]:
        """``visit(node, results of its parents)`` for every node, parents first."""
        out: dict[DagNode, object] = {}
        for node in self.topological():
            out[node] = visit(node, [out[p] for p in self._parents[node]])
        return out

    def __len__(self) -> int:
        return len(self._parents)

    def to_dot(self) -> str:
        """The graph in the DOT language."""
        quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
        nodes = [f"  {quote(n.node_id)} [label={quote(f'{n.op.value}\n{n.description}')}];" for n in self._parents]
        edges = [f"  {quote(a.node_id)} -> {quote(b.node_id)};" for a, b in self.edges]
        return "\n".join(["digraph {", *nodes, *edges, "}"])
