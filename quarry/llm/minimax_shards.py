"""Sharding by a minimax contiguous partition of atomic groups.

Documents with equal text form one atomic group, so that all copies land in one shard. Groups are ordered by the
64-bit hash of their text and cut into contiguous runs: the shard capacity is the smallest integer for which a greedy
fill of the whole order needs no more than the given number of shards, found by binary search.

One group may be heavier than an equal share of all bytes, and then the capacity is its weight, which a greedy fill
would use for all other shards too, leaving many of them empty. So among the partitions with that smallest capacity one
with even shards is looked for: groups heavier than an equal share of what is left stand alone where they lie in the
order, and the runs between them are cut by a second binary search for the smallest capacity at which the runs together
need no more than the shards left; each run is then cut evenly into its number of shards. It is taken only if its largest shard is no larger than the smallest capacity of
the whole order; else the greedy cuts are. Either way the result is a contiguous partition with the smallest maximum.

The searches run on the driver over a summary of bounded size: total weight of hash ranges (``cells``), at most about
``summary_rows`` of them whatever the input. A greedy fill over cells gives a lower and an upper bound of where each
cut lies; cells that hold a cut in doubt are split again until the capacity and all cuts are exact. The open cells go
back to the cluster as a table of their numbers, so that the filter's plan doesn't grow with them.

Slots are gapless in each shard. They are numbered per (shard, slice of doc_id) with offsets from a table of counts,
so that no task sorts a whole shard.

Main path: DataFrame functions only. Defined cases: null text counts as empty (size = 16, crc of no bytes); rows with
equal text, also null and empty, share a shard; repeated rows get slots of their own, in any order among themselves; a
text of any length is one row of its group and is read whole; fewer groups than shards leave shards empty; an empty
table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.runtime import Workspace


@dataclass(frozen=True)
class ShardSpec:
    shards: int = 40
    overhead: int = 16
    summary_rows: int = 65_536
    slices: int = 1024


#: (first hash, last hash, weight, groups, heaviest group, run, shift, cell number) of the groups of one cell
_Row = tuple[int, int, int, int, int, int, int, int]


class _Cells:
    """The cells of one run of the order, by hash."""

    def __init__(self, rows: list[_Row]):
        self.rows = sorted(rows)
        self.ends = [0]
        for r in self.rows:
            self.ends.append(self.ends[-1] + r[2])
        self.total = self.ends[-1]

    def reach(self, start: int, capacity: int) -> tuple[int, int]:
        """Least and greatest weight that a shard from ``start`` ends at."""
        goal = start + capacity
        if goal >= self.total:
            return self.total, self.total
        i = bisect_right(self.ends, goal) - 1
        if self.rows[i][3] == 1 or self.ends[i] == goal:
            return self.ends[i], self.ends[i]
        return max(self.ends[i], goal - self.rows[i][4] + 1), goal

    def cuts(self, capacity: int, side: int, most: int) -> list[int]:
        """Least (side 0) or greatest (side 1) ends of greedy shards, until all weight is held or ``most`` are full."""
        ends, at = [], 0
        while at < self.total and len(ends) < most:
            at = self.reach(at, capacity)[side]
            ends.append(at)
        return ends

    def doubtful(self, bounds: list[tuple[int, int]]) -> set[int]:
        """Cells with several groups that a cut may divide."""
        found = set()
        for low, high in bounds:
            if low >= self.total:
                continue
            for i in range(bisect_right(self.ends, low) - 1, min(bisect_right(self.ends, high), len(self.rows))):
                inside = self.ends[i] < high and low < self.ends[i + 1]
                if self.rows[i][3] > 1 and (inside or low == high and self.ends[i] < low < self.ends[i + 1]):
                    found.add(i)
        return found


class _Order:
    """All groups in hash order, as cells that are split where a search asks for it; ``giants`` stand alone."""

    def __init__(self, groups: DataFrame, giants: list[tuple[int, int]], spec: ShardSpec):
        self.spec = spec
        self.giants = sorted(giants)
        run = F.lit(0)
        for h, _ in self.giants:
            run = run + (F.col("h") > F.lit(h)).cast("int")
        self.groups = (groups.where(~F.col("h").isin([h for h, _ in self.giants])) if giants else groups).withColumn("run", run)
        bits = max(1, spec.summary_rows.bit_length() - 1)
        self.shift = 64 - bits
        self.rows = self._summary(self.groups)

    def _summary(self, groups: DataFrame) -> list[_Row]:
        got = groups.groupBy("run", F.shiftright("h", self.shift).alias("cell")).agg(F.min("h"), F.max("h"), F.sum("weight"), F.count("*"), F.max("weight"))
        return [(r[2], r[3], r[4], r[5], r[6], r[0], self.shift, r[1]) for r in got.collect()]

    def refine(self, picked: list[_Row]) -> None:
        """Split ``picked`` cells, into single groups where the summary has room for them."""
        spark, by_shift = self.groups.sparkSession, {}
        for r in picked:
            by_shift.setdefault(r[6], []).append(f"{r[5]} {r[7]}")
        room = max(2, self.spec.summary_rows // len(picked))
        few = sum(r[3] for r in picked) <= self.spec.summary_rows
        self.shift = 0 if few else max(0, min(by_shift) - (room.bit_length() - 1))
        inside = None
        for shift, cells in by_shift.items():
            numbers = spark.range(1).select(F.explode(F.split(F.lit(",".join(cells)), ",")).alias("c"))
            numbers = numbers.select(*(F.split("c", " ")[i].cast("long").alias(n) for i, n in enumerate(("in_run", "cell"))))
            here = (F.shiftright("h", shift) == F.col("cell")) & (F.col("run") == F.col("in_run"))
            part = self.groups.join(F.broadcast(numbers), here, "left_semi")  # at most summary_rows numbers
            inside = part if inside is None else inside.union(part)
        gone = set(picked)
        self.rows = [r for r in self.rows if r not in gone] + self._summary(inside)

    def runs(self, alone: bool) -> list[_Cells]:
        """The whole order as one run, or the runs between the giants."""
        if not alone:
            return [_Cells(self.rows + [(h, h, w, 1, w, -1, 0, h) for h, w in self.giants])]
        return [_Cells([r for r in self.rows if r[5] == i]) for i in range(len(self.giants) + 1)]

    def search(self, alone: bool) -> tuple[int, list[int]] | None:
        """(smallest capacity, its greedy shards in each run); None if the shards can't suffice."""
        shards = self.spec.shards - (len(self.giants) if alone else 0)
        while True:
            runs = self.runs(alone)
            if sum(c.total > 0 for c in runs) > shards:
                return None
            capacity, picked = _smallest(runs, shards)
            if not picked:
                return capacity, [len(c.cuts(capacity, 0, shards)) for c in runs]
            self.refine(picked)

    def starts(self, alone: bool, counts: list[int]) -> list[int]:
        """First hashes of the shards after the first; each run has its own smallest capacity for its shards."""
        while True:
            runs = self.runs(alone)
            best = [_smallest([c], n) for c, n in zip(runs, counts, strict=True)]
            picked = [r for _, rows in best for r in rows]
            if not picked:
                break
            self.refine(picked)
        found = [h for h, _ in self.giants] if alone else []
        for c, n, (capacity, _) in zip(runs, counts, best, strict=True):
            for at in [0, *c.cuts(capacity, 0, n)]:
                if at < c.total:
                    found.append(c.rows[bisect_right(c.ends, at) - 1][0])
        return sorted(found)[1:]


def _smallest(runs: list[_Cells], shards: int) -> tuple[int, list[_Row]]:
    """(smallest capacity that surely suffices, cells that leave a smaller one or a cut in doubt)."""
    total = sum(c.total for c in runs)
    if not total:
        return 1, []
    least = max(-(-total // shards), *(r[4] for c in runs for r in c.rows))

    def smallest(side: int) -> int:
        low, high = least - 1, total
        while high - low > 1:
            mid = (low + high) // 2
            enough = sum(len(c.cuts(mid, side, shards + 1)) for c in runs) <= shards
            low, high = (low, mid) if enough else (mid, high)
        return high

    sure, maybe = smallest(0), smallest(1)
    picked = []
    for c in runs:
        low, high = c.cuts(maybe, 0, shards + 1), c.cuts(sure, 1, shards + 1)
        n = max(len(low), len(high))
        low, high = ([*x, *[c.total] * (n - len(x))] for x in (low, high))
        picked += [c.rows[i] for i in sorted(c.doubtful(list(zip(low, high, strict=True))))]
    return sure, picked


def plan_cuts(groups: DataFrame, spec: ShardSpec) -> list[int]:
    """First hash of each shard after the first. ``groups``: h, weight."""
    total = groups.agg(F.sum("weight")).first()[0] or 0
    heaviest = [(r[0], r[1]) for r in groups.orderBy(F.desc("weight"), "h").select("h", "weight").limit(spec.shards).collect()]
    giants, left = [], total
    for h, weight in heaviest:
        shards = spec.shards - len(giants)
        if shards <= 1 or weight * shards <= left:
            break
        giants.append((h, weight))
        left -= weight
    if not total:
        return []
    order = _Order(groups, giants, spec)
    smallest, counts = order.search(alone=False)
    while giants:
        even = order.search(alone=True)
        if even and max(even[0], heaviest[0][1]) <= smallest:
            return order.starts(True, even[1])
        giants = giants[:-1]  # too many runs: the lightest giant joins one
        order = _Order(groups, giants, spec)
    return order.starts(False, counts)


def _shard_of(h: Column, starts: list[int], first: int = 0) -> Column:
    """Number of ``starts`` up to ``h``, by halving, so that the expression is only log(shards) deep."""
    if not starts:
        return F.lit(first)
    mid = len(starts) // 2
    return F.when(h < F.lit(starts[mid]), _shard_of(h, starts[:mid], first)).otherwise(_shard_of(h, starts[mid + 1 :], first + mid + 1))


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", spec: ShardSpec | None = None) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``."""
    spec = spec or ShardSpec()
    ws = Workspace(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(spec.overhead)).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(body).alias("h"),
        # kept in the table, so that all steps see the same slices; rows of one key or text lie in many of them
        F.pmod(F.xxhash64(F.col(key), F.monotonically_increasing_id()), F.lit(spec.slices)).cast("int").alias("slice"),
    )
    rows = ws.save(rows, "rows")
    groups = ws.save(rows.groupBy("h").agg(F.sum("size").alias("weight")), "groups")
    shard = _shard_of(F.col("h"), plan_cuts(groups, spec))
    placed = rows.withColumn("shard", shard.cast("int"))
    counts = placed.groupBy("shard", "slice").count()
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "slice", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slice").orderBy(key, "h")
    numbered = placed.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(offsets), ["shard", "slice"])
    return numbered.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
