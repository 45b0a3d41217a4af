"""The graph of claims and all their parents within a document: levels, cycles and ancestors.

No built-in function tells what can be reached over edges in fewer joins than the longest path has edges, so documents are streamed through a
small function, one shuffle for all of them: cycles are found by Tarjan's walk, and what a claim depends on is a bit set in a whole number, the
union of its parents' sets, taken parents first. A set is let go once the last claim that depends on it has it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of a batch that is given out.
BATCH = 10_000


def components(edges: list[list[int]]) -> list[list[int]]:
    """Strongly connected components of the nodes 0, 1, ... by their edges to others, each after all that can be reached from it. Without
    recursion, so that chains may have any length."""
    seen, low, stack, on_stack, out = [0] * len(edges), [0] * len(edges), [], [False] * len(edges), []
    count = 0
    for root in range(len(edges)):
        work = [] if seen[root] else [(root, iter(edges[root]))]
        while work:
            node, ahead = work[-1]
            if not seen[node]:
                count += 1
                seen[node] = low[node] = count
                stack.append(node)
                on_stack[node] = True
            for other in ahead:
                if not seen[other]:
                    work.append((other, iter(edges[other])))
                    break
                if on_stack[other]:
                    low[node] = min(low[node], seen[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    held = []
                    while not held or held[-1] != node:
                        held.append(stack.pop())
                        on_stack[held[-1]] = False
                    out.append(held)
    return out


class Graph:
    """One document's claims: their numbers in ascending order, and for each the numbers of its parents."""

    def __init__(self, numbers: list[int], parents: list[list[int]]):
        place = {number: k for k, number in enumerate(numbers)}
        self.numbers, self.given = numbers, [set(p) for p in parents]
        self.edges = [sorted(place[p] for p in some if p in place) for some in self.given]
        self.components = components(self.edges)
        self.of = [0] * len(numbers)
        for k, members in enumerate(self.components):
            for m in members:
                self.of[m] = k
        self.above = [sorted({self.of[p] for m in members for p in self.edges[m]} - {k}) for k, members in enumerate(self.components)]

    def levels(self) -> list[int]:
        """By component: the edges of the longest path to one that depends on no other."""
        out: list[int] = []
        for above in self.above:
            out.append(1 + max((out[a] for a in above), default=-1))
        return out

    def reached(self, above: list[list[int]], order: Iterable[int]) -> Iterator[tuple[int, int]]:
        """Components in ``order``, each after all in ``above``, with the bit set of what they reach, their own members among it."""
        waiting, sets = [0] * len(above), {}
        for some in above:
            for a in some:
                waiting[a] += 1
        for k in order:
            bits = 0
            for m in self.components[k]:
                bits |= 1 << m
            for a in above[k]:
                bits |= sets[a]
                waiting[a] -= 1
                if not waiting[a]:
                    del sets[a]
            if waiting[k]:
                sets[k] = bits
            yield k, bits

    def ancestors(self) -> Iterator[tuple[int, int]]:
        return self.reached(self.above, range(len(self.components)))

    def descendants(self) -> Iterator[tuple[int, int]]:
        below: list[list[int]] = [[] for _ in self.components]
        for k, some in enumerate(self.above):
            for a in some:
                below[a].append(k)
        return self.reached(below, reversed(range(len(self.components))))

    def rows(self) -> Iterator[tuple]:
        """number, level, component, component_size, n_parents, n_missing, n_ancestors, n_descendants."""
        levels, names = self.levels(), [self.numbers[min(c)] for c in self.components]
        up, down = (dict((k, bits.bit_count() - 1) for k, bits in some) for some in (self.ancestors(), self.descendants()))
        for i, number in enumerate(self.numbers):
            k = self.of[i]
            yield number, levels[k], names[k], len(self.components[k]), len(self.edges[i]), len(self.given[i]) - len(self.edges[i]), up[k], down[k]

    def pairs(self) -> Iterator[tuple]:
        """number and ancestor, for each claim and each other that it depends on."""
        for k, bits in self.ancestors():
            reached = [i for i, bit in enumerate(reversed(bin(bits)[2:])) if bit == "1"]
            for m in self.components[k]:
                yield from ((self.numbers[m], self.numbers[i]) for i in reached if i != m)


def _streamed(claims: DataFrame, keys: tuple[str, ...], parents: str, rows_of: Callable[[Graph], Iterator[tuple]], names: tuple[str, ...]) -> DataFrame:
    """``rows_of`` each document's graph, with its keys. The claims of a document are sorted together; of a number the first counts."""
    table = claims.where("number is not null").select(*keys, F.col("number").cast("long").alias("number"), "claim_pos", F.col(parents).cast("array<bigint>").alias("parents"))
    fields = [*(table.schema[k] for k in keys), *(T.StructField(n, T.LongType()) for n in names)]
    schema, width = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in fields]), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for doc, rows in groupby(given, key=lambda row: row[:width]):
            firsts: dict[int, list[int]] = {}
            for row in rows:
                firsts.setdefault(row[width], [p for p in row[-1] or () if p is not None])
            for found in rows_of(Graph(list(firsts), list(firsts.values()))):
                out.append((*doc, *found))
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    ordered = table.repartition(*keys).sortWithinPartitions(*keys, "number", "claim_pos")
    return ordered.mapInArrow(run, T.StructType(fields))


def dependency_graph(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",), parents: str = "parent_claims") -> DataFrame:
    """One row per claim number of a document (keys, number, claim_pos, ``parents``: array of numbers): keys, number,
    level (edges of the longest path of parents; claims of a cycle share theirs), component (the smallest number of its cycle, or its own),
    component_size, n_parents and n_missing (distinct parents that the document has and hasn't), n_ancestors and n_descendants (other claims
    that it depends on, or that depend on it, over any parents, however far).

    Of claims with the same number the first one counts; claims without a number are left out. Parents that are null are passed over.
    """
    return _streamed(claims, keys, parents, Graph.rows, ("number", "level", "component", "component_size", "n_parents", "n_missing", "n_ancestors", "n_descendants"))


def ancestors(claims: DataFrame, keys: tuple[str, ...] = ("doc_id",), parents: str = "parent_claims") -> DataFrame:
    """keys, number and ancestor: each claim with each other claim of the document that it depends on (see dependency_graph)."""
    return _streamed(claims, keys, parents, Graph.pairs, ("number", "ancestor"))
