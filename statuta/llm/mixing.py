"""Mixing sources to target weights by Pfair scheduling.

The rows of each source form blocks of equal length. Block j of a source with weight w has
release time floor(j / w) and deadline ceil((j + 1) / w); in every slot the released block
with the earliest deadline is placed. With weights that sum to one no deadline is ever
missed, so after any number of slots each source is less than one block away from its share.

When a source runs out, the shares of the others hold among themselves and a new phase begins;
every row is placed exactly once. Weights are integer shares, so a phase repeats after as many
slots as the shares sum to: no more of it is simulated, and the place of any block follows by
division. The law is the same for any number of sources, and no phase costs more than its slots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

BLOCK_ROWS = 64
#: Of the default weights: rows of a source to this power.
TEMPER = 0.7
#: Parts of a source with the mean weight.
SHARES = 1000
#: A schedule of so many sources and blocks at most is sent to every task; a larger one is dealt over POOLS tasks and joined. The places are the same.
MOST_SOURCES, BROADCAST_BLOCKS, POOLS = 1000, 500_000, 256
#: Rows of one source that are ordered together, about.
RUN_ROWS = 50_000
SEED = 7


class _Phases:
    """Earliest deadline first among the sources with blocks left; ties by the larger share, then by name."""

    def __init__(self, blocks: dict[str, int], shares: dict[str, int]):
        self.names = sorted((k for k, n in blocks.items() if n), key=lambda k: (-shares[k], k))
        self.share, self.left = [shares[k] for k in self.names], [blocks[k] for k in self.names]
        self.total, self.count = sum(self.share), len(self.names)
        self.after = list(range(1, self.count + 1))  # the next source with blocks left; of each source the one before it
        self.before = list(range(-1, self.count - 1))
        self.first = 0

    def simulated(self) -> tuple[dict[int, list[int]], int, int | None]:
        """The slots by source until one runs out or the schedule repeats, how many they are, and the period if that came first.

        All begin with a block that is released, of which those of the larger shares end first:
        sources are taken from that order one by one, and the later blocks wait in heaps.
        """
        share, total, slots = self.share, self.total, {}
        new, ready, waiting, period, t = self.first, [], [], None, 0
        while True:
            while waiting and waiting[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            if new < len(share) and (not ready or (-(-total // share[new]), new) < ready[0]):
                deadline, i, new = -(-total // share[new]), new, self.after[new]
                slots[i] = []
            else:
                deadline, i = heapq.heappop(ready)
            if t >= deadline:
                raise AssertionError("a block missed its deadline")
            slots[i].append(t)
            t, j = t + 1, len(slots[i])
            if j == self.left[i]:
                return slots, t, None
            heapq.heappush(waiting, (j * total // share[i], -(-(j + 1) * total // share[i]), i))
            if t == self.count:  # no period is shorter
                period = total // reduce(math.gcd, (share[k] for k in self.rest()))
            if t == period:
                return slots, t, period

    def rest(self):
        i = self.first
        while i < len(self.names):
            yield i
            i = self.after[i]

    def take(self, used: dict[int, int]) -> None:
        for i, n in used.items():
            self.left[i] -= n
            if not self.left[i]:
                before, after = self.before[i], self.after[i]
                if before < 0:
                    self.first = after
                else:
                    self.after[before] = after
                if after < len(self.names):
                    self.before[after] = before
                self.total, self.count = self.total - self.share[i], self.count - 1


def period(shares: dict[str, int]) -> dict[str, list[int]]:
    """For each source the slots of its blocks within one period, earliest deadline first."""
    twice = phases({k: 2 * n for k, n in shares.items()}, shares)  # none runs out within a period
    return {p["source"]: [j // p["share"] * p["total"] + p["slots"][j % p["share"]] for j in range(shares[p["source"]])] for p in twice if p["phase"] == 0}


def phases(blocks: dict[str, int], shares: dict[str, int]) -> Iterator[dict]:
    """Rows (source, phase, from_block, to_block, first_slot, share, total, slots).

    Block from_block + j lies in slot first_slot + j // share * total + slots[j % share].
    """
    now, at, start, phase = _Phases(blocks, shares), {}, 0, 0
    while now.count:
        slots, length, whole = now.simulated()
        if whole:
            length = 1 + min((now.left[i] - 1) // len(s) * whole + s[(now.left[i] - 1) % len(s)] for i, s in slots.items())
        used = {i: length // whole * len(s) + sum(x < length % whole for x in s) if whole else len(s) for i, s in slots.items()}
        for i, n in used.items():
            begun = at.get(i, 0)
            yield {"source": now.names[i], "phase": phase, "from_block": begun, "to_block": begun + n, "first_slot": start, "share": len(slots[i]), "total": whole or length, "slots": slots[i]}
            at[i] = begun + n
        now.take(used)
        start, phase = start + length, phase + 1


def tempered(rows: dict[str, int], temper: float = TEMPER, shares: int = SHARES) -> dict[str, int]:
    """Integer shares in proportion to rows ** temper: `shares` for the mean of it, one at least."""
    mean = math.fsum(n**temper for n in rows.values()) / max(len(rows), 1) or 1.0
    return {k: max(1, round(shares * n**temper / mean)) for k, n in rows.items()}


def mix(df: DataFrame, shares: dict[str | None, int] | None = None, source: str = "source", key: str = "doc_id", block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """All rows of df with phase, block, slot, row_in_block and position; position orders the mixture.

    shares: integer target shares by source; without them, rows ** TEMPER of each source in
    parts, SHARES for the mean. A source without a share raises ValueError. A null source is a
    source of its own. position = slot * block_rows +
    row_in_block; it has gaps only behind a source's last, shorter block. Rows of a source come
    in a seeded order; rows that agree in all columns are interchangeable. No rows give no rows.
    An input column named like one of the added ones is replaced; names that begin with two
    underscores are this function's own.
    """
    df = df.drop("phase", "block", "slot", "row_in_block", "position")
    name = F.when(F.col(source).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source).cast("string")))
    row = F.xxhash64(F.lit(seed), *[F.to_json(F.col(f"`{c}`")) if kind.startswith("map") else F.col(f"`{c}`") for c, kind in df.dtypes])
    counted = df.groupBy(name.alias("__s")).agg(F.count(F.lit(1)).alias("n"))
    if shares is not None:
        shares = {"-" if k is None else f"={k}": int(v) for k, v in shares.items()}
        known = df.sparkSession.createDataFrame(list(shares.items()), "__s string, share long")
        if missing := [r["__s"] for r in counted.join(known.filter("share > 0"), "__s", "left_anti").limit(5).collect()]:
            raise ValueError(f"no target share for {sorted(missing)}")
    planned, most = _schedule(counted, shares, block_rows)
    # runs of each source, so that no source is ordered in one task; a run is a stretch of the seeded order, which is the same in any number of runs
    runs = max(32, math.ceil(most / RUN_ROWS))
    keyed = df.withColumns({"__s": name, "__row": row})
    keyed = keyed.withColumn("__at", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "__row"), 33))
    keyed = keyed.withColumn("__run", F.shiftright(F.col("__at") * runs, 31).cast("int"))
    sizes = keyed.groupBy("__s", "__run").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__s", "__run", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = keyed.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__run").orderBy("__at", "__row", key)) - 1)
    ranked = ranked.join(starts, ["__s", "__run"]).withColumn("__i", F.col("__start") + F.col("__rank"))
    ranked = ranked.withColumns({"block": F.floor(F.col("__i") / block_rows).cast("long"), "row_in_block": F.pmod("__i", F.lit(block_rows)).cast("int")})
    placed = ranked.join(planned, (F.col("__s") == F.col("__ps")) & (F.col("block") == F.col("__block")))
    placed = placed.withColumn("position", F.col("slot") * block_rows + F.col("row_in_block"))
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], "phase", "block", "slot", "row_in_block", "position")


PLAN = "__ps string, phase int, __from long, __to long, __first long, __share long, __total long, __slots array<long>"


def _schedule(counted: DataFrame, shares: dict | None, block_rows: int) -> tuple[DataFrame, int]:
    """(__ps, __block, phase, slot) of every block, and the rows of the largest source.

    The phases are found in one task, of a row for each source; the driver sees neither.
    """

    def plan(frames):
        found = pd.concat([pd.DataFrame({"__s": [], "n": []}), *frames])
        rows = dict(sorted(zip(found["__s"], (int(n) for n in found["n"]), strict=True)))
        out = []
        for p in phases({k: -(-n // block_rows) for k, n in rows.items()}, tempered(rows) if shares is None else shares):
            out.append(tuple(p.values()))
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = [x.split()[0] for x in PLAN.split(", ")]
    counted = materialize(counted)
    size = counted.agg(F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"), F.sum(F.ceil(F.col("n") / block_rows)).alias("blocks")).first()
    planned = materialize(counted.repartition(1).mapInPandas(plan, PLAN))
    small = size["sources"] <= MOST_SOURCES and (size["blocks"] or 0) <= BROADCAST_BLOCKS
    if not small:
        planned = planned.repartition(POOLS, "__ps", "__from")
    j = F.col("__block") - F.col("__from")
    slot = F.col("__first") + F.floor(j / F.col("__share")).cast("long") * F.col("__total") + F.get("__slots", F.pmod(j, F.col("__share")).cast("int"))
    placed = planned.withColumn("__block", F.explode(F.sequence("__from", F.col("__to") - 1))).select("__ps", "__block", "phase", slot.alias("slot"))
    return F.broadcast(placed) if small else placed, size["most"] or 0


def op10_pfair_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "source", "phase", "block", "slot", "row_in_block", "position")
