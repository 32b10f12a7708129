"""Maximum flow on a small graph: breadth-first levels, then blocking paths."""

from __future__ import annotations

from collections import deque


class Flow:
    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[float] = []

    def edge(self, a: int, b: int, there: float, back: float = 0) -> int:
        """An edge and its reverse; the number returned names it."""
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]
        return len(self.to) - 2

    def levels(self, source: int, least: float) -> list[int]:
        level = [-1] * len(self.out)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.left[e] > least and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def run(self, source: int, sink: int, least: float = 0) -> None:
        """Push all that goes; called again after capacities grew, it goes on from there."""
        while (level := self.levels(source, least))[sink] >= 0:
            place, path = [0] * len(self.out), []
            while True:
                a = self.to[path[-1]] if path else source
                if a == sink:
                    most = min(self.left[e] for e in path)
                    for e in path:
                        self.left[e] -= most
                        self.left[e ^ 1] += most
                    path = path[: next(i for i, e in enumerate(path) if self.left[e] <= least)]
                    continue
                while place[a] < len(self.out[a]):
                    e = self.out[a][place[a]]
                    if self.left[e] > least and level[self.to[e]] == level[a] + 1:
                        path.append(e)
                        break
                    place[a] += 1
                else:
                    if not path:
                        break
                    place[self.to[path.pop() ^ 1]] += 1

    def reached(self, source: int, least: float = 0) -> list[bool]:
        """The source's side of the minimum cut."""
        return [x >= 0 for x in self.levels(source, least)]
