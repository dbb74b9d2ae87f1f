"""Tree search over operators: UCB1 selection, expansion, evaluation, backpropagation. The tree is small; evaluation runs on Spark."""

from __future__ import annotations

import math
import random
import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, field


def ucb1(parent_visits: int, visits: int, total: float, c: float = 1.4) -> float:
    """Mean reward plus c * sqrt(ln(parent's visits) / visits); infinite without visits."""
    return math.inf if not visits else total / visits + c * math.sqrt(math.log(max(parent_visits, 1)) / visits)


@dataclass
class Node:
    number: int
    operation: str | None = None
    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    visits: int = 0
    total: float = 0.0
    score: float | None = None
    pruned: bool = False

    def path(self) -> list[str]:
        return [] if self.parent is None else [*self.parent.path(), self.operation]

    @property
    def depth(self) -> int:
        return 0 if self.parent is None else self.parent.depth + 1


@dataclass
class Operation:
    name: str
    needs: frozenset = frozenset()
    gives: frozenset = frozenset()
    weight: float = 1.0
    cost: float = 1.0


class Search:
    """evaluate(path of operation names) gives a score; equal sets of operations are evaluated once."""

    def __init__(self, operations: list[Operation], evaluate: Callable[[list[str]], float], start: frozenset = frozenset(), c: float = 1.4, max_depth: int = 5, max_children: int = 5, threshold: int = 1, seed: int = 42):
        self.operations, self.evaluate, self.start = {o.name: o for o in operations}, evaluate, start
        self.c, self.max_depth, self.max_children, self.threshold, self.random = c, max_depth, max_children, threshold, random.Random(seed)
        self.root, self.nodes, self.scores, self.history = Node(0), 1, {}, []
        self.best: tuple[float, list[str]] = (-math.inf, [])
        self.iteration = 0

    def available(self, node: Node) -> list[Operation]:
        have, used = set(self.start), set(node.path())
        for name in used:
            have |= self.operations[name].gives
        taken = {k.operation for k in node.children}
        return sorted((o for o in self.operations.values() if o.name not in used | taken and o.needs <= have and o.weight > 0), key=lambda o: (-o.weight, o.cost, o.name))

    def select(self) -> Node:
        node = self.root
        while node.visits >= self.threshold and any(not k.pruned for k in node.children):
            node = max((k for k in node.children if not k.pruned), key=lambda k: ucb1(node.visits, k.visits, k.total, self.c))
        return node

    def expand(self, node: Node) -> list[Node]:
        room = self.max_children - len(node.children)
        ops = self.available(node) if node.depth < self.max_depth and room > 0 else []
        for o in sorted(self.random.sample(ops, min(room, len(ops))), key=lambda o: o.name):
            node.children.append(Node(self.nodes, o.name, node))
            self.nodes += 1
        return node.children

    def backpropagate(self, node: Node, score: float) -> None:
        while node:
            node.visits, node.total, node = node.visits + 1, node.total + score, node.parent

    def run(self, iterations: int, seconds: float | None = None, memory_mb: float | None = None) -> tuple[float, list[str]]:
        """Search for so many more iterations, or until the time or this process's memory is used up."""
        start = time.monotonic()
        for _ in range(iterations):
            if seconds is not None and time.monotonic() - start >= seconds or memory_mb is not None and memory_used_mb() > memory_mb:
                break
            leaf = self.select()
            for node in self.expand(leaf) or [leaf]:
                key = frozenset(node.path())
                if key not in self.scores:
                    self.scores[key] = self.evaluate(node.path())
                score = self.scores[key]
                self.backpropagate(node, score)
                node.score = score
                self.best = max(self.best, (score, node.path()), key=lambda b: b[0])
                self.history.append({"iteration": self.iteration, "node": node.number, "parent": node.parent.number if node.parent else None, "operation": node.operation, "score": score, "visits": node.visits})
            self.iteration += 1
        return self.best

    def all_nodes(self) -> list[Node]:
        out, todo = [], [self.root]
        while todo:
            out.append(todo.pop())
            todo += out[-1].children
        return sorted(out, key=lambda n: n.number)

    def rows(self) -> list[dict]:
        """The tree as rows, from which resume() builds it again."""
        return [{"node": n.number, "parent": n.parent.number if n.parent else None, "operation": n.operation, "visits": n.visits, "total": n.total, "score": n.score} for n in self.all_nodes()]

    def resume(self, rows: list[dict]) -> None:
        """Build the tree that was stored; the root may be missing, and nodes without a stored parent are children of the root."""
        nodes = {0: self.root}
        for r in sorted(rows, key=lambda r: r["node"]):
            if r["node"] not in nodes:
                parent = nodes.get(r["parent"], self.root)
                nodes[r["node"]] = Node(r["node"], r["operation"], parent)
                parent.children.append(nodes[r["node"]])
        for r in rows:
            n = nodes[r["node"]]
            n.visits, n.total, n.score = r["visits"], r["total"], r["score"]
            if n.score is not None:
                self.scores[frozenset(n.path())] = n.score
                self.best = max(self.best, (n.score, n.path()), key=lambda b: b[0])
        self.nodes = max(nodes) + 1
        if self.root.visits == 0:
            self.root.visits = sum(n.visits for n in self.root.children)
            self.root.total = sum(n.total for n in self.root.children)

    def prune(self, margin: float = 0.1, least_visits: int = 2) -> list[int]:
        """Mark nodes whose mean is worse than the best score by more than the margin; selection passes them by. The numbers of those marked now."""
        found = [n for n in self.all_nodes() if n.parent and not n.pruned and n.visits >= least_visits and n.total / n.visits < self.best[0] - margin]
        for n in found:
            n.pruned = True
        return [n.number for n in found]

    def stats(self) -> dict:
        """Size and depth of the tree, and the share of the operations that have been tried."""
        nodes = self.all_nodes()
        tried = {n.operation for n in nodes if n.operation}
        return {"nodes": len(nodes), "depth": max(n.depth for n in nodes), "leaves": sum(not n.children for n in nodes), "pruned": sum(n.pruned for n in nodes), "visits": self.root.visits, "coverage": len(tried) / max(1, len(self.operations))}

    def best_path(self) -> list[str]:
        """From the root down, the child of the best mean each time."""
        node, path = self.root, []
        while any(k.visits for k in node.children):
            node = max((k for k in node.children if k.visits), key=lambda k: (k.total / k.visits, -k.number))
            path.append(node.operation)
        return path


def memory_used_mb() -> float:
    """The most memory that this process has used."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
