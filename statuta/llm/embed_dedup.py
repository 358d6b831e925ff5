"""Near-duplicate embeddings by hierarchical navigable small-world graphs per shard.

Equal vectors of a label are one class. The classes of a label fall into shards of bounded
size; each shard gets a graph, and the vectors of every shard search the graphs of their own
and of all earlier shards of the label, so that each pair of shards is searched once. A sample of the
queries of each pair of shards is held against brute force: the nearest vectors, whatever their
cosine, and the links must be found, or all beams widen and the audit is made again. Beams
widen besides for a query whose finds fill half its beam; a query that would need a beam of a
good part of the shard is compared with all of it. What is found is verified by cosine in double
precision, and the links are united to components.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, table
from .components import components

COSINE = 0.93
SHARD_ROWS = 8192
M = 12
EF_BUILD, EF = 48, 48
#: Of a pair of shards so many queries are audited, but no more than one in AUDIT_SHARE; how many of
#: the nearest vectors of each are looked for, the share of those that must be found, and the share of the links.
AUDITED, AUDIT_SHARE, NEAREST, NEAREST_RECALL, RECALL = 200, 10, 10, 0.95, 0.99
BLOCK = 256
EXPAND = 4
#: A beam of more than one in so many of a shard's vectors costs more than comparing with all of them.
WIDEST = 16


def units(x: np.ndarray) -> np.ndarray:
    """Vectors of length one; they are scaled first, so that no square is lost or overflows."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-320)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """A navigable small-world graph with layers over unit vectors; links[l][v]: neighbours in layer l, -1 for none."""

    def __init__(self, vectors: np.ndarray, seed: int = 1):
        self.v = np.ascontiguousarray(vectors, np.float32)
        n, rng = len(vectors), np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / math.log(M)).astype(np.int64), 4)
        self.links = [np.full((n, 2 * M if layer == 0 else M), -1, np.int32) for layer in range(int(self.level.max(initial=0)) + 1)]
        self.entries: list[np.ndarray] = []
        order = rng.permutation(n)
        done = 0
        while done < n:
            batch = order[done : done + max(1, min(BLOCK, done // 2))]
            self._insert(batch, order[:done])
            done += len(batch)
        self._order = order

    def _insert(self, batch: np.ndarray, known: np.ndarray) -> None:
        for layer in range(len(self.links) - 1, -1, -1):
            here = batch[self.level[batch] >= layer]
            there = known[self.level[known] >= layer]
            if not len(here):
                continue
            sims = np.full((len(here), 0), 0, np.float32)
            near = np.zeros((len(here), 0), np.int64)
            if len(there):
                near, sims = self.beam(self.v[here], there[: min(len(there), 8)][None].repeat(len(here), 0) if layer else self._start(here, there), EF_BUILD, layer)
            # those of one batch see each other too
            own = self.v[here] @ self.v[here].T
            np.fill_diagonal(own, -2)
            k = min(len(here), EF_BUILD)
            top = np.argpartition(-own, k - 1, 1)[:, :k]
            near = np.concatenate([near, here[top]], 1)
            sims = np.concatenate([sims, np.take_along_axis(own, top, 1)], 1)
            sims[near == here[:, None]] = -2
            chosen = self._diverse(near, sims, M)
            width = self.links[layer].shape[1]
            self.links[layer][here, : chosen.shape[1]] = chosen
            pairs = [(int(b), int(a)) for a, row in zip(here, chosen, strict=True) for b in row if b >= 0]
            self._back(pairs, layer, width)

    def _start(self, here: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Where the search of layer 0 starts: the best of the layers above, and some known nodes."""
        some = there[:: max(1, len(there) // 128)]
        sims = self.v[here] @ self.v[some].T
        k = min(4, len(some))
        return some[np.argpartition(-sims, k - 1, 1)[:, :k]]

    def _diverse(self, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates, those nearer to it than to any chosen before; then the nearest others."""
        order = np.argsort(-sims, 1)[:, : EF_BUILD]
        near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
        among = np.einsum("bid,bjd->bij", self.v[near], self.v[near])
        worst = np.full(near.shape, -2, np.float32)  # similarity to the chosen ones
        pick = np.zeros(near.shape, bool)
        for j in range(near.shape[1]):
            good = (worst[:, j] < sims[:, j]) & (sims[:, j] > -2) & (pick.sum(1) < most)
            pick[:, j] = good
            worst = np.where(good[:, None], np.maximum(worst, among[:, j]), worst)
        score = np.where(sims <= -2, -9, sims + 4 * pick)
        order = np.argsort(-score, 1)[:, :most]
        out = np.take_along_axis(near, order, 1)
        return np.where(np.take_along_axis(score, order, 1) <= -9, -1, out).astype(np.int32)

    def _back(self, pairs: list, layer: int, width: int) -> None:
        links, full = self.links[layer], {}
        for a, b in pairs:
            row = links[a]
            if b in row:
                continue
            free = np.flatnonzero(row < 0)
            if len(free):
                row[free[0]] = b
            else:
                full.setdefault(a, []).append(b)
        if full:
            most = max(map(len, full.values()))
            nodes = np.array(list(full))
            near = np.full((len(nodes), width + most), -1, np.int64)
            near[:, :width] = links[nodes]
            for i, extra in enumerate(full.values()):
                near[i, width : width + len(extra)] = extra
            sims = np.einsum("bd,bid->bi", self.v[nodes], self.v[np.maximum(near, 0)])
            sims[near < 0] = -2
            if near.shape[1] > EF_BUILD:
                order = np.argsort(-sims, 1)[:, :EF_BUILD]
                near, sims = np.take_along_axis(near, order, 1), np.take_along_axis(sims, order, 1)
            links[nodes] = self._diverse(np.maximum(near, 0), sims, width)

    def beam(self, queries: np.ndarray, starts: np.ndarray, ef: int, layer: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ef nodes nearest to each query that a beam search from its starts finds; similarity -2 where there are fewer."""
        links, n, rows = self.links[layer], len(self.v), np.arange(len(queries))[:, None]
        ef = min(ef, n)
        seen = np.zeros((len(queries), n + 1), bool)
        ids = np.full((len(queries), ef), n, np.int64)
        sims = np.full((len(queries), ef), -2, np.float32)
        opened = np.ones((len(queries), ef), bool)
        new = np.unique(starts, axis=1) if len(starts) == 1 else starts
        active = np.arange(len(queries))
        while len(active):
            new = np.where(seen[active[:, None], new], n, new)
            new.sort(1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            seen[active[:, None], new] = True
            seen[:, n] = True
            fresh = np.einsum("bd,bid->bi", queries[active], self.v[np.minimum(new, n - 1)])
            fresh[new == n] = -2
            all_ids = np.concatenate([ids[active], new], 1)
            all_sims = np.concatenate([sims[active], fresh], 1)
            all_open = np.concatenate([opened[active], new == n], 1)
            order = np.argsort(-all_sims, 1, kind="stable")[:, :ef]
            ids[active], sims[active] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            opened[active] = np.take_along_axis(all_open, order, 1)
            active = active[~opened[active].all(1)]
            if not len(active):
                break
            k = min(EXPAND, ef)
            first = np.argsort(opened[active], 1, kind="stable")[:, :k]
            done = np.take_along_axis(opened[active], first, 1)
            at = np.where(done, n, ids[active[:, None], first])
            opened[active[:, None], first] = True
            new = np.where((at == n)[:, :, None], -1, links[np.minimum(at, n - 1)]).reshape(len(active), -1).astype(np.int64)
            new[new < 0] = n
        return np.where(sims > -2, ids, -1), sims

    def entry(self, queries: np.ndarray) -> np.ndarray:
        """Descends the layers: the nearest few found in each are the starts of the next."""
        top = len(self.links) - 1
        starts = np.flatnonzero(self.level >= top)[:16][None].repeat(len(queries), 0)
        for layer in range(top, 0, -1):
            found, _ = self.beam(queries, starts, 16, layer)
            starts = np.where(found[:, :8] >= 0, found[:, :8], found[:, :1])
        return starts


def links_between(graph: Graph, a: np.ndarray, b: np.ndarray, same: bool, cosine: float = COSINE) -> np.ndarray:
    """Which pairs of unit vectors have the cosine, a row for each of b and a column for each of a, found by searching a's graph with b's vectors.

    A byte for each pair of a shard's vectors, however many of them link. same: a and b are one shard; then
    the result is symmetric, and no vector is linked with itself. A beam passes by the audit only. A graph
    that doesn't even pass with a beam of all its nodes is broken: a warning is given, and its shard compared whole."""
    q, n, m = b.astype(np.float32), len(a), len(b)
    found = np.zeros((m, n), bool)

    def search(which: np.ndarray, ef: int) -> np.ndarray:
        """Marks what is found; returns which queries filled half their beam."""
        full, step = np.zeros(len(which), bool), max(8, min(BLOCK, (1 << 23) // (n + 16 * ef)))
        for i in range(0, len(which), step):
            some = which[i : i + step]
            starts = np.concatenate([graph.entry(q[some]), some[:, None]], 1) if same else graph.entry(q[some])
            ids, sims = graph.beam(q[some], starts, ef)
            near = (sims >= cosine - 1e-4) & (ids >= 0)
            full[i : i + len(some)] = near.sum(1) * 2 >= min(ef, n + 1)
            row, at = np.nonzero(near)
            found[some[row], ids[row, at]] = True
        return full

    def exact(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), n), bool)
        for i in range(0, len(which), BLOCK):
            out[i : i + BLOCK] = b[which[i : i + BLOCK]] @ a.T >= cosine
        if same:  # a vector's link to itself says nothing
            out[np.arange(len(which)), which] = False
        return out

    def verify() -> None:
        for i in range(0, m, BLOCK):
            block = found[i : i + BLOCK]
            row, at = np.nonzero(block)
            if len(row) * 8 > block.size:
                block &= b[i : i + BLOCK] @ a.T >= cosine
            else:
                for k in range(0, len(row), 1 << 16):
                    r, c = row[k : k + (1 << 16)], at[k : k + (1 << 16)]
                    block[r, c] = np.einsum("id,id->i", b[i + r], a[c]) >= cosine
        if same:
            np.fill_diagonal(found, False)

    audited = np.sort(np.random.default_rng(2).permutation(m)[: min(AUDITED, -(-m // AUDIT_SHARE))])
    true = b[audited] @ a.T
    if same:
        true[np.arange(len(audited)), audited] = -2
    truth, nearest = true >= cosine, min(NEAREST, n - same)
    least = -np.partition(-true, nearest - 1, 1)[:, nearest - 1] if nearest > 0 else np.full(len(audited), 2.0)

    def passes(ef: int) -> bool:
        starts = np.concatenate([graph.entry(q[audited]), audited[:, None]], 1) if same else graph.entry(q[audited])
        ids, _ = graph.beam(q[audited], starts, ef)
        hit = np.zeros((len(audited), n), bool)
        row, at = np.nonzero(ids >= 0)
        hit[row, ids[row, at]] = True
        near = (hit & (true >= least[:, None] - 1e-7)).sum(1)
        # with a beam no wider than what is linked, links are found by the widening for their query
        room = truth.sum(1) * 2 < min(ef, n)
        return np.minimum(near, nearest).sum() >= NEAREST_RECALL * nearest * len(audited) and (hit & truth)[room].sum() >= RECALL * truth[room].sum()

    ef = EF
    while not passes(ef) and ef < 2 * n:
        ef *= 2
    if ef >= 2 * n and not passes(ef):
        warnings.warn("a graph failed its audit with a beam of all its nodes", RuntimeWarning, stacklevel=2)
        found[:] = exact(np.arange(m))
    else:
        which, wide = np.arange(m), ef
        while len(which):
            if wide * WIDEST >= n and wide > ef:
                found[which] = exact(which)
                break
            which, wide = which[search(which, wide)], wide * 4
        verify()
    found[audited] = truth
    if same:
        found |= found.T
    return found


def forest(found: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Linked pairs (row, column) that span each component of the links; each row and column is visited once."""
    m, n = found.shape
    rows, columns, out = np.ones(m, bool), np.ones(n, bool), []
    if same:
        columns = rows
    for first in np.flatnonzero(found.any(1)):
        if not rows[first]:
            continue
        rows[first], open_ = False, [(int(first), True)]
        while open_:
            at, is_row = open_.pop()
            new = np.flatnonzero(found[at] & columns) if is_row else np.flatnonzero(found[:, at] & rows)
            (columns if is_row else rows)[new] = False
            out += [(at, int(x)) if is_row else (int(x), at) for x in new]
            open_ += [(int(x), same or not is_row) for x in new]
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine of their vectors is at
    least COSINE. Vectors that are null, zero, or hold a null or a value that isn't finite link
    with nothing; nor do vectors of different lengths. Equal rows are other vectors of each
    other. component_id: the smallest key reachable; null keys count for nothing, and a
    component without other keys has a null one. kept: the key is the component's. No rows
    give no rows.
    """
    bounded_batches(vectors.sparkSession)
    value = F.col(vector).cast("array<double>")
    sane = F.coalesce(F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0), F.lit(False)) & F.col(label).isNotNull()
    rows = vectors.select(F.col(key).alias("vec_id"), F.when(sane, F.struct(F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>").alias("embedding"))).alias("v"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = classes.withColumn("class", F.monotonically_increasing_id()).select("class", "copies", "least", F.col("v.label").alias("label"), F.col("v.embedding").alias("embedding"), F.size("v.embedding").alias("dim"))
    classes = materialize(classes)
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"))
    dealt = classes.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("class"), F.col("shards")).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        group = group.take(pa.array(np.argsort(np.asarray(group.column("class")))))
        flat = np.concatenate([np.asarray(x.values) for c in group.column("embedding").chunks for x in c]).astype(np.float64)
        v = units(flat.reshape(group.num_rows, -1))
        graph = Graph(v)
        return pa.table(
            {
                "label": group.column("label")[:1],
                "dim": group.column("dim")[:1],
                "shard": group.column("shard")[:1],
                "classes": pa.array([np.asarray(group.column("class"))], pa.list_(pa.int64())),
                "copies": pa.array([np.asarray(group.column("copies"))], pa.list_(pa.int64())),
                "vectors": pa.array([flat.astype("<f8").tobytes()], pa.binary()),
                "level": pa.array([graph.level], pa.list_(pa.int64())),
                "links": pa.array([[x.astype("<i4").tobytes() for x in graph.links]], pa.list_(pa.binary())),
            }
        )

    shards = materialize(dealt.select("label", "dim", "shard", "class", "copies", "embedding").groupBy("label", "dim", "shard").applyInArrow(build, "label string, dim int, shard int, classes array<long>, copies array<long>, vectors binary, level array<long>, links array<binary>"))
    names = shards.select("label", "dim", "shard")
    pairs = names.join(names.withColumnRenamed("shard", "other"), ["label", "dim"]).filter("shard <= other")
    left = pairs.join(shards, ["label", "dim", "shard"])
    right = shards.select("label", "dim", F.col("shard").alias("other"), F.col("classes").alias("classes_b"), F.col("copies").alias("copies_b"), F.col("vectors").alias("vectors_b"))
    both = left.join(right, ["label", "dim", "other"]).repartition("label", "dim", "shard", "other")

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c, r=r, batch=batch: batch.column(c)[r]
                dim = get("dim").as_py()
                a, b = (units(np.frombuffer(get(c).as_py(), "<f8").reshape(-1, dim)) for c in ("vectors", "vectors_b"))
                graph = Graph.__new__(Graph)
                graph.v, graph.level = a.astype(np.float32), np.asarray(get("level").values)
                graph.links = [np.frombuffer(x, "<i4").reshape(len(a), -1) for x in get("links").as_py()]
                same = get("shard").as_py() == get("other").as_py()
                links = links_between(graph, a, b, same)
                ca, cb = np.asarray(get("classes").values), np.asarray(get("classes_b").values)
                na, nb = np.asarray(get("copies").values), np.asarray(get("copies_b").values)
                of_a, of_b = (np.zeros(len(a), np.int64) if same else nb @ links), links @ na
                nodes, counts = np.concatenate([ca[of_a > 0], cb[of_b > 0]]), np.concatenate([of_a[of_a > 0], of_b[of_b > 0]])
                edges = np.array(forest(links, same), np.int64).reshape(-1, 2)
                edges = np.stack([cb[edges[:, 0]], ca[edges[:, 1]]], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([nodes, edges[:, 0]])), pa.array(np.concatenate([np.full(len(nodes), -1), edges[:, 1]])), pa.array(np.concatenate([counts, np.zeros(len(edges), np.int64)]))], ["class", "other", "n"]
                )

    found = materialize(both.mapInArrow(search, "class long, other long, n long"))
    counts = found.filter("other < 0").groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other >= 0").select(F.col("class").alias("a"), F.col("other").alias("b")))
    known = classes.select("class", "copies", "least", F.struct("label", "embedding").alias("v")).join(counts, "class", "left").join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(known, "v", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
