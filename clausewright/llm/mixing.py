"""Mixing sources to target weights by Pfair scheduling (operator 2)."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Documents in a block.
BLOCK_ROWS = 16
#: Slots of a part of the schedule, slots before it over which its begin is found at first, and parts that a worker remembers.
SEGMENT, WARM_UP, REMEMBERED_PARTS = 1 << 15, 1 << 11, 64
#: Digits of the buckets into which a source is cut to be numbered.
BUCKET_DIGITS = 3


def shares(weights: list[float]) -> tuple[int, ...]:
    """Whole numbers in the proportion of the weights, exactly."""
    exact = [Fraction(w) for w in weights]
    whole = [int(w * math.lcm(*(w.denominator for w in exact))) for w in exact]
    return tuple(w // math.gcd(*whole) for w in whole)


@dataclass(frozen=True)
class Pfair:
    """Endless Pfair schedule of sources with ``given`` shares of ``slots`` in all, worked out from any slot on.

    Block j (from 0) of a source with a of M shares is released at slot floor(j M / a) and due by ceil((j + 1) M / a); of the
    released blocks the one due earliest goes first, ties to the first source. So after t slots each source has had floor or ceil
    of its target t a / M.
    """

    given: tuple[int, ...]

    @cached_property
    def slots(self) -> int:
        return sum(self.given)

    def release(self, k: int, j: int) -> int:
        return j * self.slots // self.given[k]

    def due(self, k: int, j: int) -> int:
        return -(-(j + 1) * self.slots // self.given[k])

    def _begun(self, t: int) -> list[int]:
        """A state at slot t from which no deadline will be missed: each source has had the floor of its target, and those
        with the earliest deadlines among the others have had one block more. (Let m sources be ahead, the fractions of the targets sum
        to m. Of those ahead that aren't due by a later t', all fractional sources with later deadlines aren't either, and their
        fractions have only grown, so that the blocks due by t' fit.)"""
        done = [t * a // self.slots for a in self.given]
        behind = sorted((self.due(k, n), k) for k, n in enumerate(done) if t * self.given[k] % self.slots)
        for _, k in behind[: t - sum(done)]:
            done[k] += 1
        return done

    def _reachable(self, t: int, done: list[int], since: int) -> bool:
        """Whether ``done`` at t can be reached from any state that misses no deadline: true for what was released from ``since``
        on, as a schedule from there led to it; of the sources that are behind since before, no more may have been released before
        a slot s than the targets leave room for at s."""
        behind = [r for k, n in enumerate(done) if n * self.slots < t * self.given[k] and (r := self.release(k, n)) < since]
        for s in {r + 1 for r in behind}:
            room = sum(-(s * a) % self.slots for a in self.given)  # in shares of a slot
            if sum(r < s for r in behind) * self.slots > room:
                return False
        return True

    def state(self, t: int) -> tuple[int, ...]:
        """The blocks that each source has had before slot t: the same wherever and whenever it is asked for. Found by the schedule
        over the slots before, as many as it takes for the state to be reachable."""
        back = WARM_UP
        while True:
            since = max(0, t - back)
            done = self._begun(since)
            for k, _ in self.run(since, t, done):
                done[k] += 1
            if not since or self._reachable(t, done, since):
                return tuple(done)
            back *= 4

    def run(self, since: int, until: int, done: Sequence[int], last: Sequence[int] | None = None) -> Iterator[tuple[int, int]]:
        """Source and block of each slot from ``since`` on; with ``last``, so that they have had these blocks at ``until``."""
        most = last or [None] * len(self.given)

        def window(k: int, j: int) -> tuple[int, int]:
            due = self.due(k, j)
            return max(since, self.release(k, j)), min(due, until) if last else due

        coming = [(window(k, n)[0], k, n) for k, n in enumerate(done) if most[k] is None or n < most[k]]
        heapq.heapify(coming)
        ready: list[tuple[int, int, int]] = []
        for t in range(since, until):
            while coming and coming[0][0] <= t:
                _, k, j = heapq.heappop(coming)
                heapq.heappush(ready, (window(k, j)[1], k, j))
            due, k, j = heapq.heappop(ready)
            if due <= t:
                raise RuntimeError("a block missed its deadline")
            yield k, j
            if most[k] is None or j + 1 < most[k]:
                heapq.heappush(coming, (window(k, j + 1)[0], k, j + 1))


#: The parts of one source's blocks: the first block, and the slots of it and those after it.
Part = list[tuple[int, np.ndarray]]


@dataclass(frozen=True)
class Phase:
    """``length`` slots from ``start`` on in which the same ``sources`` are active; ``done``: the blocks that they have had before.

    It is cut at each SEGMENT slots up to ``tail``, so that a part of it can be worked out by itself; the last part ends with the
    phase, when one of the sources is used up.
    """

    start: int
    length: int
    tail: int
    sources: tuple[int, ...]
    done: tuple[int, ...]
    pfair: Pfair

    def part(self, n: int) -> Part:
        since = n * SEGMENT
        begun = self.pfair.state(since)
        if since < self.tail:
            order = self.pfair.run(since, since + SEGMENT, begun, self.pfair.state(since + SEGMENT))
        else:
            order = self.pfair.run(since, self.length, begun)
        slots: list[list[int]] = [[] for _ in self.sources]
        for t, (k, _) in enumerate(order, since):
            slots[k].append(t)
        return [(first, np.array(at, np.int64)) for first, at in zip(begun, slots, strict=True)]

    def slots_of(self, k: int, blocks: np.ndarray, part: Callable[[int], Part]) -> np.ndarray:
        """The slots of ``blocks`` (ascending, counted in the phase) of sources[k]; ``part`` is self.part, or remembers it."""
        out, at = np.empty(len(blocks), np.int64), 0
        while at < len(blocks):
            n = min(self.pfair.release(k, int(blocks[at])) // SEGMENT, self.tail // SEGMENT)
            first, slots = part(n)[k]
            while blocks[at] >= first + len(slots):  # its window reaches into a later part
                n += 1
                first, slots = part(n)[k]
            until = int(np.searchsorted(blocks, first + len(slots)))
            out[at:until] = slots[blocks[at:until] - first]
            at = until
        return self.start + out


def schedule(blocks: list[int], weights: list[float]) -> list[Phase]:
    """Phases that use up all blocks. When a source runs out, the others go on at weights in the same proportion. Of a phase the
    slots around its end alone are gone through here."""
    left, done, start, out = [*blocks], [0] * len(blocks), 0, []
    weights = [w if w > 0 else 0.0 for w in weights]
    while any(n > 0 for n in left):
        active = [k for k in range(len(left)) if left[k] > 0]
        wanted = [k for k in active if weights[k] > 0] or active  # what has no weight comes last
        pfair = Pfair(shares([weights[k] or 1.0 for k in wanted]))
        first_end = min(pfair.release(i, left[k] - 1) for i, k in enumerate(wanted))
        tail = first_end // SEGMENT * SEGMENT
        had = [*pfair.state(tail)]
        for length, (i, j) in enumerate(pfair.run(tail, tail + max(blocks) * pfair.slots, had), tail + 1):
            had[i] = j + 1
            if had[i] == left[wanted[i]]:
                break
        out.append(Phase(start, length, tail, tuple(wanted), tuple(done[k] for k in wanted), pfair))
        start += length
        for i, k in enumerate(wanted):
            left[k] -= had[i]
            done[k] += had[i]
    return out


class Slots:
    """Slots of any blocks, from the phases alone. The parts that were worked out last are remembered."""

    def __init__(self, phases: list[Phase]):
        self.phases = phases
        self.known: dict[tuple[int, int], Part] = {}
        self.of: dict[int, list[tuple[int, int, int]]] = {}  # of each source: first block, phase, place in it
        for p, phase in enumerate(phases):
            for i, k in enumerate(phase.sources):
                self.of.setdefault(k, []).append((phase.done[i], p, i))

    def _part(self, p: int, n: int) -> Part:
        if (p, n) not in self.known:
            if len(self.known) >= REMEMBERED_PARTS:
                self.known.clear()
            self.known[p, n] = self.phases[p].part(n)
        return self.known[p, n]

    def __call__(self, k: int, blocks: np.ndarray) -> np.ndarray:
        found, places = np.unique(blocks, return_inverse=True)
        turns = self.of[k]
        which = np.searchsorted(np.array([first for first, _, _ in turns]), found, side="right") - 1
        out = np.empty(len(found), np.int64)
        for w in np.unique(which):
            first, p, i = turns[w]
            mine = which == w
            out[mine] = self.phases[p].slots_of(i, found[mine] - first, lambda n, p=p: self._part(p, n))
        return out[places]


def numbered(docs: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Each row's number within its source (from 0) in the order of md5(doc_id), and the number of rows of each source.

    A source is cut into 4096 buckets by the digits of the md5; rows are numbered within their bucket and the
    buckets' sizes are summed up, so that no task holds a whole source.
    """
    keyed = docs.withColumn("mix_source", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("mix_draw", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn("mix_bucket", F.substring("mix_draw", 1, BUCKET_DIGITS))
    sizes = keyed.groupBy("mix_source", "mix_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_source", "mix_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_before"))
    ties = [F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))]
    within = F.row_number().over(Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_draw", "doc_id", *ties))
    rows = keyed.withColumn("mix_within", within).join(offsets, ["mix_source", "mix_bucket"])
    rows = rows.withColumn("mix_number", F.col("mix_before") + F.col("mix_within") - 1)
    return rows.drop("mix_draw", "mix_bucket", "mix_before", "mix_within"), sizes.groupBy("mix_source").agg(F.sum("n").alias("n"))


_slots: dict[str, Slots] = {}  # of the last mixture, in a Python worker


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` (doc_id, source, any other columns) with the added columns mix_block, mix_slot and mix_place.

    A source's documents, in an order drawn by md5(doc_id), make blocks of ``block_rows``; slot s of the mixture
    is one block, and mix_place the place within it. All rows are kept, once. Up to any slot of a phase each source has
    had its target share to within less than one block. Targets are ``weights`` by source (a source without one comes
    when the others are used up); by default the square root of a source's rows, which favours small sources.

    The driver gets one row for each source; it and the tasks hold the sources' shares and numbers of blocks for each phase, of which
    there are as many as sources at most, and nothing for a block: a task works out the parts of the schedule in which its own blocks lie,
    at the exact weights (no short period, whose rounding would add up).

    A null source is a source of its own, apart from "", and has the key None in ``weights``. Rows that repeat are separate documents; an
    empty table gives an empty one. Column names that begin with ``mix_`` are taken by the result; others are kept as they are.
    """
    rows, totals = numbered(docs, block_rows)
    counts = sorted((r.mix_source, r.n) for r in totals.collect())
    names = [name for name, _ in counts]
    targets = [math.sqrt(n) if weights is None else float(weights.get(name[1:] if name else None, 0)) for name, n in counts]
    phases = schedule([-(-n // block_rows) for _, n in counts], targets)
    table, name = docs.sparkSession.sparkContext.broadcast((names, phases)), uuid.uuid4().hex
    kept = [c for c in rows.columns if c not in ("mix_source", "mix_number")]

    @F.pandas_udf("long")
    def slot_of(source, block):  # noqa: ANN001
        names, phases = table.value
        if name not in _slots:
            _slots.clear()
            _slots[name] = Slots(phases)
        which = np.searchsorted(np.array(names, object), source.to_numpy(object))
        number, out = block.to_numpy(np.int64), np.zeros(len(block), np.int64)
        for k in np.unique(which):
            at = np.flatnonzero(which == k)
            out[at] = _slots[name](int(k), number[at])
        return source.__class__(out)

    size = F.lit(block_rows)
    rows = rows.withColumn("mix_block", F.floor(F.col("mix_number") / size)).withColumn("mix_place", F.pmod("mix_number", size))
    return rows.withColumn("mix_slot", slot_of("mix_source", "mix_block")).select(*(c for c in kept), "mix_block", "mix_slot", "mix_place")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("mix_block").alias("block"), F.col("mix_slot").alias("slot"), F.col("mix_place").alias("place"))


QUERIES = {"op2_pfair_mixing": op2_pfair_mixing}
ORACLES: dict[str, str] = {}
