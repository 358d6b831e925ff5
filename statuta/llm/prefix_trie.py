"""The trie of the prefixes that conversations share, rolled up by centroid decomposition.

A node is a sequence of turns with which at least one conversation begins. Its key is its depth
and a 128-bit sum of hashes of (place, turn), so the keys of all prefixes of a conversation are
running sums. Conversations of any length are numbered and summed in parts, never in one task.

Totals of subtrees: a component of the forest of parent edges is cut at its centroid, the total
of what lies in the component at or below the centroid is added to every node on the path from
it to the component's top, and the parts, each of at most half the nodes, are treated alike.
How many turns of conversations lie at or below a node is a plain sum over its members; nodes
with more than a bound are the spine, and below it hang components of bounded size. Each is
decomposed within a task, many to a task. The totals of the components' tops go to the spine;
there, unbranched stretches are one node each, of which no more are left than the turns divided
by half the bound; these are decomposed in one task, and a running sum along each stretch gives
every node its share.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Turns at or below the top of a component that one task decomposes; more, the root of all turns, in larger tables.
COMPONENT_TURNS = 2_000
#: Rows of a running sum that one task takes in order, and ids that one row of members holds.
STRETCH = 4096
KEY = ["depth", "k1", "k2"]
LIMBS = ["s1", "s2", "s3", "s4"]
LOW = 0xFFFFFFFF


def rollup(parent: list[int], values: list[list[int]]) -> list[list[int]]:
    """Of each node the sum of each of the values over its subtree, by centroid decomposition.

    parent: the number of a node's parent, smaller than its own; -1 for a top.
    """
    cut, part, size = list(parent), [-1] * len(parent), [1] * len(parent)
    out = [[0] * len(parent) for _ in values]

    def parted(nodes: list[int]) -> list[list[int]]:
        groups: dict[int, list[int]] = {}
        for v in nodes:
            groups.setdefault(part[v], []).append(v)
        return list(groups.values())

    for v, p in enumerate(cut):
        part[v] = v if p < 0 else part[p]
    rest = parted(list(range(len(cut))))
    while rest:
        nodes = rest.pop()
        for v in nodes:
            size[v] = 1
        for v in reversed(nodes):
            if cut[v] >= 0:
                size[cut[v]] += size[v]
        centroid = min((v for v in nodes if 2 * size[v] >= len(nodes)), key=size.__getitem__)
        below = [centroid]
        for v in nodes:
            p = cut[v]
            if v == centroid:
                part[v] = v
            elif p < 0:
                part[v] = -1  # the part that keeps the top
            else:
                part[v] = v if p == centroid else part[p]
                if part[v] >= 0:
                    below.append(v)
        for own, total in zip(values, out, strict=True):
            t, v = sum(own[u] for u in below), centroid
            while v >= 0:
                total[v] += t
                v = cut[v]
        for v in below:
            if cut[v] == centroid:
                cut[v] = -1
        nodes.remove(centroid)
        rest += parted(nodes)
    return out


def numbered(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, t1, t2, bytes) of rows (conv_id, turn, role, text), and conversations (conv_id, n).

    Places run from 0 in the order of turn, null first; equal turns are ordered by role and a
    digest of the text. A null role or text is empty. Rows without conv_id belong to no
    conversation and are left out. The order is that of ranges of (conv_id, turn), so that a
    conversation may lie in many of them; texts themselves aren't moved.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("t1")]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("gid", F.monotonically_increasing_id())
    turns = materialize(turns.select("conv_id", "t1", "t2", "bytes", F.shiftright("gid", 33).alias("part"), F.col("gid").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")))
    placed = turns.join(parts.select("conv_id", "part", "offset"), ["conv_id", "part"]).select("conv_id", (F.col("offset") + F.col("at")).alias("place"), "t1", "t2", "bytes")
    return placed, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def running(df: DataFrame, group: list[str], at: str, values: list[str]) -> DataFrame:
    """df, a written table, with the sums of values over the rows of the group up to each, in the
    order of at, which counts from 0 or 1 without large gaps. No task takes more than STRETCH rows of a group in order."""
    df = df.withColumn("stretch", F.floor(F.col(at) / STRETCH))
    own = Window.partitionBy(*group, "stretch").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, "stretch").agg(*[F.sum(v).alias(v) for v in values])
    totals = totals.select(*group, "stretch", *[F.sum(v).over(before).alias(f"before_{v}") for v in values]).filter(F.col(f"before_{values[0]}").isNotNull())
    df = df.withColumns({f"upto_{v}": F.sum(v).over(own) for v in values}).join(totals, [*group, "stretch"], "left")
    return df.withColumns({f"upto_{v}": F.col(f"upto_{v}") + F.coalesce(F.col(f"before_{v}"), F.lit(0)) for v in values}).drop("stretch", *[f"before_{v}" for v in values])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each prefix of each conversation but the empty one: conv_id, depth, its key k1, k2
    and its parent's p1, p2, the bytes of its last text, and left, the turns from that one on."""
    e = {"e1": F.xxhash64("t1", "place"), "e2": F.xxhash64("t2", "place")}
    low, high = lambda c: F.col(c).bitwiseAND(F.lit(LOW)), lambda c: F.shiftrightunsigned(c, 32)
    rows = turns.withColumns(e).select("conv_id", "place", "bytes", high("e1").alias("s1"), low("e1").alias("s2"), high("e2").alias("s3"), low("e2").alias("s4"))
    rows = running(materialize(rows), ["conv_id"], "place", LIMBS)
    # sums of halves can't overflow; their lower halves make the key
    key = lambda a, b: F.shiftleft(a.bitwiseAND(F.lit(LOW)), 32).bitwiseOR(b.bitwiseAND(F.lit(LOW)))
    upto = [F.col(f"upto_{s}") for s in LIMBS]
    past = [F.col(f"upto_{s}") - F.col(s) for s in LIMBS]
    rows = rows.join(convs.select("conv_id", "n"), "conv_id")
    return rows.select("conv_id", (F.col("place") + 1).alias("depth"), key(*upto[:2]).alias("k1"), key(*upto[2:]).alias("k2"), key(*past[:2]).alias("p1"), key(*past[2:]).alias("p2"), "bytes", (F.col("n") - F.col("place")).alias("left"))


def _parent_key(df: DataFrame) -> list[Column]:
    return [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]


def _nodes(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node: key, parent's key and conv_id, conv_id, n_convs, n_children, turns at or below, own values."""
    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum("left").alias("turns"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("bytes").alias("bytes"))
    nodes = materialize(nodes)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns")).filter("n_convs > 0")
    least = convs.agg(F.min("conv_id").alias("m")).first()["m"]
    zero = F.lit(0).cast("long")
    top = top.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", "turns", zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"))
    children = nodes.groupBy(*_parent_key(nodes)).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.unionByName(top).join(children, KEY, "left")
    # the root's many children need no join
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    deep = out.filter("depth > 1").join(parents, ["depth", "p1", "p2"])
    flat = out.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(least).cast("long")))
    out = deep.unionByName(flat).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    return materialize(out.withColumns({"leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("bytes")}))


def _components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rollups of whole components; rows come component by component, and in each by depth."""

    def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
        f = pd.concat(parts) if len(parts) > 1 else parts[0]
        at: dict[tuple, int] = {}
        depth, k1, k2, p1, p2 = (f[c].tolist() for c in ("depth", "k1", "k2", "p1", "p2"))
        parent = []
        for i in range(len(f)):
            parent.append(at.get((depth[i] - 1, p1[i], p2[i]), -1))
            at[depth[i], k1[i], k2[i]] = i
        leaves, saved = rollup(parent, [f["leaf"].tolist(), f["saved"].tolist()])
        return pd.DataFrame({"conv_id": f["conv_id"].to_numpy(), "depth": depth, "p1": p1, "p2": p2, "n_leaves": leaves, "saved_tokens": saved, "top": [p < 0 for p in parent]})

    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        names = list(zip(frame["t_depth"].tolist(), frame["t1"].tolist(), frame["t2"].tolist(), strict=True))
        tail = len(names)
        while tail and names[tail - 1] == names[-1]:
            tail -= 1
        if held and (tail or names[0] != tuple(held[-1][c].iat[-1] for c in ("t_depth", "t1", "t2"))):
            if tail:
                held.append(frame.iloc[:tail])
            yield done(held)
            held = []
        elif tail:
            yield done([frame.iloc[:tail]])
        held.append(frame.iloc[tail:])
    if held:
        yield done(held)


def _spine_totals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rollup of the stretches of the spine, in one task: their number is bounded."""
    parts = [f for f in frames if len(f)]
    if parts:
        f = pd.concat(parts).sort_values("top_depth", kind="stable")
        at = {name: i for i, name in enumerate(zip(f["m"], f["q"], strict=True))}
        parent = [-1 if pd.isna(m) else at[m, q] for m, q in zip(f["pm"], f["pq"], strict=True)]
        leaves, saved = rollup(parent, [f["leaf"].astype(int).tolist(), f["saved"].astype(int).tolist()])
        yield pd.DataFrame({"m": f["m"].to_numpy(), "q": f["q"].to_numpy(), "all_leaf": leaves, "all_saved": saved})


def _totals(nodes: DataFrame, paths: DataFrame, bound: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of every node."""
    heavy = (F.col("turns") > bound) | (F.col("depth") == 0)
    # the top of a node's component: the first node that isn't heavy on its conversation's path
    tops = paths.join(nodes.filter(heavy).select(*KEY), KEY, "left_anti").groupBy("conv_id").agg(F.min(F.struct(*KEY)).alias("t")).select("conv_id", F.col("t.depth").alias("t_depth"), F.col("t.k1").alias("t1"), F.col("t.k2").alias("t2"))
    light = nodes.filter(~heavy).select("conv_id", *KEY, "p1", "p2", "leaf", "saved").join(tops, "conv_id")
    light = light.repartition("t_depth", "t1", "t2").sortWithinPartitions("t_depth", "t1", "t2", "depth")
    done = materialize(light.mapInPandas(_components, "conv_id long, depth long, p1 long, p2 long, n_leaves long, saved_tokens long, top boolean"))
    hung = done.filter("top").groupBy(*_parent_key(done)).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
    spine = nodes.filter(heavy).join(hung, KEY, "left")
    spine = materialize(spine.select(*KEY, "conv_id", "p1", "p2", (F.col("leaf") + F.coalesce("more_leaves", F.lit(0))).alias("leaf"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
    # a stretch: the nodes of the spine with the same ends below, named by the first of them and their number
    ends = materialize(spine.join(spine.filter("depth > 0").select(*_parent_key(spine)).distinct(), KEY, "left_anti").select(F.col("conv_id").alias("end"), F.col("depth").alias("end_depth")))
    above = paths.join(ends, (F.col("conv_id") == F.col("end")) & (F.col("depth") <= F.col("end_depth"))).select(*KEY, "end")
    zero = F.lit(0).cast("long")
    stretches = above.union(ends.select(zero, zero, zero, "end")).groupBy(*KEY).agg(F.min("end").alias("m"), F.count(F.lit(1)).alias("q"))
    spine = materialize(spine.join(stretches, KEY))
    sums = spine.groupBy("m", "q").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"), F.min(F.struct("depth", "p1", "p2")).alias("t"))
    sums = sums.select("m", "q", "leaf", "saved", F.col("t.depth").alias("top_depth"), (F.col("t.depth") - 1).alias("depth"), F.col("t.p1").alias("k1"), F.col("t.p2").alias("k2"))
    sums = sums.join(spine.select(*KEY, F.col("m").alias("pm"), F.col("q").alias("pq")), KEY, "left")
    whole = sums.select("m", "q", "pm", "pq", "leaf", "saved", "top_depth").coalesce(1).mapInPandas(_spine_totals, "m long, q long, all_leaf long, all_saved long")
    along = running(spine, ["m", "q"], "depth", ["leaf", "saved"]).join(materialize(whole), ["m", "q"])
    here = lambda v: (F.col(f"all_{v}") - F.col(f"upto_{v}") + F.col(v))
    out = along.select("conv_id", "depth", here("leaf").alias("n_leaves"), here("saved").alias("saved_tokens"))
    return out.unionByName(done.select("conv_id", "depth", "n_leaves", "saved_tokens"))


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the members' ids of each node; rows come node by node, and in each by id."""
    key, sha = None, None
    for frame in frames:
        out = []
        for *now, ids in zip(*[frame[c].tolist() for c in KEY], frame["ids"], strict=True):
            if now == key:
                sha.update(b",")
            else:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = now, hashlib.sha256()
            sha.update(ids.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"]).astype(dict.fromkeys(KEY, "int64"))
    if key is not None:
        yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*KEY, "ends_sha256"])


def _ends(paths: DataFrame, convs: DataFrame) -> DataFrame:
    """Of each node at which conversations end the digest of their ids: ids are packed in rows of bounded length first."""
    zero = F.lit(0).cast("long")
    last = paths.filter("left = 1").select(*KEY, "conv_id").union(convs.filter("n = 0").select(zero, zero, zero, "conv_id"))
    packed = last.groupBy(*KEY, F.floor(F.col("conv_id") / STRETCH).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "part").mapInPandas(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, component_turns: int = COMPONENT_TURNS) -> DataFrame:
    """A row for each node of the trie of conversations: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    turns: (conv_id, place, t1, t2, bytes) with places from 0; convs: (conv_id, n), a row for
    each conversation, those without turns included. A node goes by its smallest member and its
    depth. Without conversations there are no nodes, else one root.
    """
    convs = materialize(convs.select("conv_id", "n"))
    paths = materialize(prefixes(turns, convs))
    nodes = _nodes(paths, convs)
    whole = convs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    totals = _totals(nodes, paths, max(component_turns, math.isqrt(whole)))
    none = hashlib.sha256(b"").hexdigest()
    out = nodes.select(*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children").join(totals, ["conv_id", "depth"]).join(_ends(paths, convs), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, component_turns: int = COMPONENT_TURNS) -> DataFrame:
    """The trie of rows (conv_id, turn, role, text); other columns are left out. See numbered() and trie()."""
    return trie(*numbered(rows), component_turns)


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with others' turns: the first h of conversation c - c % 5, all if
    it has fewer, then c's own after its first h; h is the CRC-32 of the id's digits modulo 9."""
    turns, convs = materialize(turns), materialize(convs)
    base = (F.col("conv_id") - F.pmod("conv_id", F.lit(5))).alias("base")
    c = convs.select("conv_id", "n", base, (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % 9).alias("h"))
    c = c.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base")), "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0))))
    c = materialize(c)
    own = turns.join(c.select("conv_id", "h", "taken"), "conv_id").filter("place >= h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "t1", "t2", "bytes")
    lent = turns.filter((F.pmod("conv_id", F.lit(5)) == 0) & (F.col("place") < 8)).withColumnRenamed("conv_id", "base").join(c.select("conv_id", "base", "h"), "base").filter("place < h").select("conv_id", "place", "t1", "t2", "bytes")
    return own.union(lent), c.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(*numbered(table(spark, sf_dir, "conversations"))))


#: CRC-32 is a fold over the bits of the id's digits: -1 shifts, other values are bytes.
SQL = """with c as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as place, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
 n as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 9 as h from c group by conv_id),
 m as (select n.*, least(n.h, coalesce(b.n, 0)) as taken from n left join n b on n.base = b.conv_id),
 r as (select m.conv_id, c.place - m.h + m.taken as place, role, text from c join m on c.conv_id = m.conv_id where c.place >= m.h union all select m.conv_id, c.place, role, text from m join c on c.conv_id = m.base where c.place < m.h),
 p as (select conv_id, place + 1 as depth, strlen(text) as bytes, string_agg(md5(concat(role, chr(0), text)), '' order by place) over (partition by conv_id order by place) as path from r union all select conv_id, 0, 0, '' from n),
 g as (select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(bytes) as bytes from p group by depth, path),
 k as (select left(path, length(path) - 32) as path, depth - 1 as depth, count(*) as n_children from g where depth > 0 group by all),
 v as (select g.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * bytes as saved from g left join k on g.path = k.path and g.depth = k.depth),
 o as (select p.*, v.n_children, sum(case when v.conv_id = p.conv_id then v.saved else 0 end) over w as saved, sum(case when v.conv_id = p.conv_id and v.n_children = 0 then 1 else 0 end) over w as leaves, max(p.depth) over (partition by p.conv_id) as last from p join v on p.path = v.path and p.depth = v.depth window w as (partition by p.conv_id order by p.depth desc)),
 s as (select depth, path, sum(saved)::bigint as saved_tokens, sum(leaves)::bigint as n_leaves, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (depth = last), '')) as ends_sha256 from o group by depth, path)
 select v.conv_id, v.depth, u.conv_id as parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, s.ends_sha256 from v join s on v.path = s.path and v.depth = s.depth left join v u on u.depth = v.depth - 1 and u.path = left(v.path, length(v.path) - 32)"""
