"""Graph analytics (A1-A18). Edges need source and target; most also relation, pmids, pmid_count, confidence."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.text import padded
from ..vocab import ACTIVATE, ARCHITECTURES, LOOP_RULES, OTHER_LOOPS, SUPPRESS
from . import held as H
from .iterate import staged as cut
from .iterate import unstage


def _ends(edges: DataFrame) -> DataFrame:
    both = F.array(F.struct(F.col("source").alias("id"), F.col("target").alias("other")), F.struct(F.col("target").alias("id"), F.col("source").alias("other")))
    return edges.select(F.inline(both))


def pairs(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs without self-loops."""
    return edges.where("source <> target").select("source", "target").distinct()


#: Rows that a task makes distinct (some 100 MB).
TASK_ROWS = 1 << 19


def distinct_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows, by tasks whose number grows with the rows, so that a task's memory doesn't. Rows go to them as they are: where few occur twice, sets of what
    a task has read would be as large as its share of the input, and are of no use."""
    return rows.repartition(rows.count() // TASK_ROWS + 1, *rows.columns).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs (source, target) without self-loops, each in one direction."""
    return distinct_rows(edges.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")))


def degree(nodes: DataFrame, edges: DataFrame, core: Column | None = None) -> DataFrame:
    """A1: id, degree (edges that touch the node; with ``core``, a condition on ``id``, only of core nodes) and distinct neighbours."""
    found = _ends(edges).groupBy("id", "other").agg(F.count("*").alias("n")).groupBy("id").agg(F.sum("n").alias("degree"), F.count("other").alias("neighbours"))
    out = nodes.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"))
    return out.where(core) if core is not None else out


def core_degree(edges: DataFrame, core: DataFrame, k: int = 20) -> DataFrame:
    """A1: the k nodes with the most edges that touch the core (id), and how many edges lie inside it."""
    c = core.select("id").distinct()
    marked = edges.join(c.select(F.col("id").alias("source"), F.lit(1).alias("s")), "source", "left").join(c.select(F.col("id").alias("target"), F.lit(1).alias("t")), "target", "left")
    touching = marked.where("s = 1 or t = 1")
    top = _ends(touching).groupBy("id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "id").limit(k)
    return top.crossJoin(touching.agg(F.count_if((F.col("s") == 1) & (F.col("t") == 1)).alias("core_edges")))


def degree_ratio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A2: distinct-neighbour degree over the largest one, 4 places."""
    d = degree(nodes, edges)
    top = d.agg(F.max("neighbours").alias("top"))
    return d.crossJoin(F.broadcast(top)).select("id", F.round(F.col("neighbours") / F.greatest("top", F.lit(1)), 4).alias("degree_ratio"))


#: Pivots, and nodes, of a block of path counts; blocks of nodes that one product makes.
PATHS_BLOCK, PATHS_WIDE = 512, 4


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame | None = None, block: int = PATHS_BLOCK, wide: int = PATHS_WIDE, most: int = H.HELD_PAIRS) -> DataFrame:
    """A3: directed betweenness by Brandes' sums, exact, until no new node is reached.

    ``pivots`` (id) samples the sources for large graphs; scores are then sums over those sources alone. Up to ``most`` pairs are held by each
    task, which goes through a group of pivots one by one (``held``). Beyond, levels grow for all pivots at once: the state has a cell for
    each pivot and node that it reaches, in blocks of path counts; a level is a product of such blocks and the pairs' 0/1 matrix, so that a
    way is never a row, and no task holds more than the blocks of ``block`` pivots.
    """
    p = cut(pairs(edges))
    ids = cut(numbered(cut(nodes.select("id").union(p.select("source")).union(p.select("target")).distinct()), ["id"], "no").select("id", (F.col("no") - 1).alias("no")))
    at = lambda e: ids.select(F.col("id").alias(e), F.col("no").alias(f"{e}_no"))
    seeds = cut(numbered(cut((pivots if pivots is not None else nodes).select("id").distinct()), ["id"], "s_no").join(ids, "id").select((F.col("s_no") - 1).alias("s_no"), "no"))
    whole = ids.count() * seeds.count()
    hops = cut(p.join(at("source"), "source").join(at("target"), "target").select("source_no", "target_no"))
    if hops.count() <= most:
        total = H.betweenness(hops, seeds, ids.count())
        unstage(p, hops, seeds)
        return _scores(nodes, total, ids)
    on = cut(_packed_cells(hops, "source_no", "target_no", block, block * wide, "uint8"))
    levels = [cut(_packed_cells(seeds, "s_no", "no", block, block, "float64").select(F.col("row").alias("s"), F.col("col").alias("v"), "data"))]
    reached = seeds.count()
    while reached < whole:
        seen = levels[0]
        for one in levels[1:]:
            seen = seen.union(one.select("s", "v", "data"))
        new = cut(_path_products(levels[-1], seen, on, block, wide, back=False))
        cells = new.agg(F.sum("cells")).first()[0]
        if not cells:
            unstage(new)
            break
        levels.append(new)
        reached += cells
    total = None
    if len(levels) > 2:
        home = cut(_packed_cells(hops, "target_no", "source_no", block, block * wide, "uint8"))
        share, invert = levels[-1], True
        for level in range(len(levels) - 2, 0, -1):  # a node's share goes to the nodes before it on its shortest paths
            gain = cut(_path_products(share, levels[level], home, block, wide, back=True, invert=invert))
            mine = cut(gain.select("v", F.posexplode("sums").alias("pos", "b")).where("b > 0").groupBy((F.col("v") * block + F.col("pos")).alias("no")).agg(F.sum("b").alias("b")))
            total = mine if total is None else total.union(mine)
            if not invert:
                unstage(share)
            share, invert = gain, False
        unstage(home, share)
    unstage(p, hops, seeds, on, *levels)
    if total is None:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    return _scores(nodes, total, ids)


def _scores(nodes: DataFrame, total: DataFrame, ids: DataFrame) -> DataFrame:
    found = total.groupBy("no").agg(F.sum("b").alias("betweenness")).join(ids, "no").select("id", "betweenness")
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _packed_cells(cells: DataFrame, row: str, col: str, rows: int, cols: int, kind: str) -> DataFrame:
    """(row, col, data): blocks of a 0/1 matrix whose ones are ``cells`` (row, col), as compressed arrays of ``kind``."""

    def packed(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((rows, cols), kind)
        m[one["i"], one["j"]] = 1
        return pd.DataFrame({"row": [key[0]], "col": [key[1]], "data": [zlib.compress(m.tobytes(), 1)]})

    split = lambda c, n: ((F.col(c) / n).cast("int"), (F.col(c) % n).cast("int"))
    (r, i), (c, j) = split(row, rows), split(col, cols)
    return cells.select(r.alias("row"), c.alias("col"), i.alias("i"), j.alias("j")).groupBy("row", "col").applyInPandas(packed, "row int, col int, data binary")


def _path_products(front: DataFrame, own: DataFrame, on: DataFrame, block: int, wide: int, back: bool, invert: bool = False) -> DataFrame:
    """(s, v, data, cells, sums): the blocks of the product of ``front`` (s, v, data) and the matrix ``on``, for ``wide`` blocks of nodes in one group.

    Forward they are path counts, of nodes that none of ``own``'s blocks has reached; ``cells`` counts them. Back, ``own`` is the level before: its nodes' gains are
    summed over the pivots in ``sums``, and ``data`` is what a node hands on by each of its paths, one plus its gain over its path counts; ``invert`` takes
    ``front`` as path counts of nodes without any gain.
    """
    every = F.explode(F.array(*map(F.lit, sorted(r[0] for r in on.select("col").distinct().collect()))).cast("array<int>")).alias("wide")
    left = front.select("s", every, F.lit(True).alias("front"), "v", "data").union(own.select("s", (F.col("v") / wide).cast("int").alias("wide"), F.lit(False), "v", "data"))
    stripes = front.select("s").distinct() if not back else front.select("s").union(own.select("s")).distinct()
    right = on.select(F.col("row").alias("v"), F.col("col").alias("wide"), "data").crossJoin(F.broadcast(stripes.select(F.col("s").alias("stripe"))))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        read = lambda data, kind, shape: np.frombuffer(zlib.decompress(data), kind).reshape(shape)
        total = np.zeros((block, block * wide))
        pair = dict(zip(right["v"], right["data"]))
        for v, data in left.loc[left["front"], ["v", "data"]].itertuples(index=False):
            if v in pair:
                ways = read(data, np.float64, (block, block))
                if invert:
                    ways = np.divide(1.0, ways, out=np.zeros_like(ways), where=ways > 0)
                total += ways @ read(pair[v], np.uint8, (block, block * wide)).astype(np.float64)
        out = []
        mine = left.loc[~left["front"], ["v", "data"]].itertuples(index=False)
        if back:
            for v, data in mine:
                paths = read(data, np.float64, (block, block))
                gain = paths * total[:, v % wide * block : (v % wide + 1) * block]
                out.append((v, np.divide(1 + gain, paths, out=np.zeros_like(paths), where=paths > 0), 0, gain.sum(0).tolist()))
        elif len(left):
            for v, data in mine:
                total[:, v % wide * block : (v % wide + 1) * block][read(data, np.float64, (block, block)) > 0] = 0
            for k in range(wide):
                new = total[:, k * block : (k + 1) * block]
                if new.any():
                    out.append((int(left["wide"].iloc[0]) * wide + k, new, int(np.count_nonzero(new)), None))
        s = int(left["s"].iloc[0]) if len(left) else 0
        return pd.DataFrame([(s, v, zlib.compress(m.tobytes(), 1), cells, sums) for v, m, cells, sums in out], columns=["s", "v", "data", "cells", "sums"])

    return left.groupBy("s", "wide").cogroup(right.groupBy("stripe", "wide")).applyInPandas(product, "s int, v int, data binary, cells long, sums array<double>")


def sampled_betweenness(nodes: DataFrame, edges: DataFrame, error: float = 0.01, chance: float = 0.1, seed: int = 11, most: int = 1 << 20, first: int = 1024, long: int = 12) -> DataFrame:
    """A3 for large graphs: betweenness estimated from random shortest paths (Riondato and Kornaropoulos, 2016): id, betweenness, samples, error.

    Pairs of nodes are drawn by hashes; both ends of a pair grow frontiers over its own rows until they meet, and one of its shortest paths is drawn,
    each with its share, by path counts. A node's estimate is the share of samples whose path it lies inside, times n (n - 1), the scale of the exact
    form. Samples double until a bound on all nodes at once (Hoeffding and a union over nodes and rounds) is below ``error``, as a share of the pairs; so the
    state is the samples' frontiers, never a row per pair of nodes. ``error`` in the result is the bound reached, and less than asked for where ``most`` samples end it.
    Pairs further apart than ``2 * long`` hops count as unconnected.
    """
    ids = cut(numbered(cut(nodes.select("id").distinct()), ["id"], "no"))
    n = ids.count()
    if n < 3:
        return nodes.select("id", F.lit(0.0).alias("betweenness"), F.lit(0).cast("long").alias("samples"), F.lit(0.0).alias("error"))
    p = cut(pairs(edges))
    spark, done, size, rounds, hits = edges.sparkSession, 0, first, 0, None
    while True:
        rounds += 1
        draw = lambda k: F.pmod(F.xxhash64("sample", F.lit(seed), F.lit(k)), F.lit(n)) + 1
        drawn = spark.range(done, done + size).select(F.col("id").alias("sample")).select("sample", draw(0).alias("s_"), draw(1).alias("t_")).where("s_ <> t_")
        drawn = drawn.join(ids.select(F.col("no").alias("s_"), F.col("id").alias("s")), "s_").join(ids.select(F.col("no").alias("t_"), F.col("id").alias("t")), "t_").select("sample", "s", "t")
        inner = _drawn_paths(cut(drawn), p, seed, long)
        part = cut(inner.groupBy("id").agg(F.count("*").alias("hits")))
        hits = part if hits is None else cut(hits.union(part).groupBy("id").agg(F.sum("hits").alias("hits")))
        done += size
        # two-sided Hoeffding over n nodes; round k may fail with chance / 2^k
        bound = (math.log(2 * n * 2**rounds / chance) / (2 * done)) ** 0.5
        if bound <= error or done * 2 > most:
            break
        size = done
    scale = F.col("hits") / done * n * n  # ends are drawn from n^2 pairs, of which those of a node with itself have no path
    out = nodes.select("id").join(hits, "id", "left").select("id", F.coalesce(scale, F.lit(0.0)).alias("betweenness"), F.lit(done).cast("long").alias("samples"), F.lit(bound).alias("error"))
    return cut(out)


def _drawn_paths(drawn: DataFrame, p: DataFrame, seed: int, long: int) -> DataFrame:
    """(sample, id): the inner nodes of one shortest path of each (sample, s, t) that has any, drawn with equal chances."""
    ahead = [cut(drawn.select("sample", F.col("s").alias("v"), F.lit(1.0).alias("paths")))]
    behind = [cut(drawn.select("sample", F.col("t").alias("v"), F.lit(1.0).alias("paths")))]
    seen = {True: ahead[0].select("sample", "v"), False: behind[0].select("sample", "v")}
    open_, out = drawn.select("sample"), None

    def grow(levels: list[DataFrame], forward: bool) -> None:
        own, other = ("source", "target") if forward else ("target", "source")
        step = levels[-1].join(open_, "sample", "left_semi").join(p, F.col("v") == F.col(own)).groupBy("sample", F.col(other).alias("v")).agg(F.sum("paths").alias("paths"))
        levels.append(cut(step.join(seen[forward], ["sample", "v"], "left_anti")))
        seen[forward] = seen[forward].union(levels[-1].select("sample", "v"))

    for hop in range(2 * long):
        # the distance is ``hop + 1``: frontiers a hops from s and b from t meet, where a + b is the distance
        grow(ahead if hop % 2 == 0 else behind, hop % 2 == 0)
        a, b = len(ahead) - 1, len(behind) - 1
        meet = ahead[a].join(behind[b].select("sample", "v", F.col("paths").alias("back")), ["sample", "v"]).join(open_, "sample", "left_semi")
        chosen = cut(_one_of(meet.select("sample", "v", (F.col("paths") * F.col("back")).alias("weight")), seed + hop).select("sample", F.col("v").alias("at")))
        if not chosen.isEmpty():
            found = chosen.select("sample", F.col("at").alias("id"), F.lit(a).alias("from_s"), F.lit(b).alias("from_t"))
            way, home = chosen, chosen
            for k in range(a - 1, 0, -1):  # back to s: each time one of the predecessors, by its paths from s
                way = _step(way, ahead[k], p, True, seed + 100 + k)
                found = found.union(way.select("sample", F.col("at").alias("id"), F.lit(k), F.lit(-1)))
            for k in range(b - 1, 0, -1):  # on to t
                home = _step(home, behind[k], p, False, seed + 200 + k)
                found = found.union(home.select("sample", F.col("at").alias("id"), F.lit(-1), F.lit(k)))
            inner = cut(found.where("from_s <> 0 and from_t <> 0").select("sample", "id"))
            out = inner if out is None else out.union(inner)
            open_ = cut(open_.join(chosen, "sample", "left_anti"))
        if open_.isEmpty() or ahead[-1].isEmpty() or behind[-1].isEmpty():
            break
    unstage(*ahead, *behind)
    return out if out is not None else drawn.select("sample", F.col("s").alias("id")).where("false")


def _step(at: DataFrame, level: DataFrame, p: DataFrame, back: bool, seed: int) -> DataFrame:
    """The next node of each sample's path, drawn among its neighbours in ``level`` by their numbers of paths."""
    here, there = ("target", "source") if back else ("source", "target")
    near = at.join(p, F.col("at") == F.col(here)).select("sample", F.col(there).alias("v")).join(level, ["sample", "v"])
    return cut(_one_of(near.select("sample", "v", F.col("paths").alias("weight")), seed).select("sample", F.col("v").alias("at")))


def _one_of(rows: DataFrame, seed: int) -> DataFrame:
    """One row of each sample, with chances by ``weight``: the least of exponential variables with these rates."""
    u = (F.shiftrightunsigned(F.xxhash64("sample", "v", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    return rows.groupBy("sample").agg(F.min_by("v", -F.log(u) / F.col("weight")).alias("v"))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-8) -> DataFrame:
    """A4: PageRank over distinct pairs; dangling mass spread evenly; stops at an L1 change below tol (0: never).

    Each round is one job: ranks are written once, and what the next round needs to know is observed while they are.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    p = cut(distinct_rows(edges.select("source", "target")))
    found = p
    out = p.groupBy("source").agg(F.count("*").alias("out"))
    p = cut(p.join(out, "source").select("source", "target", (1 / F.col("out")).alias("share")))
    rank = nodes.select("id").join(out.select(F.col("source").alias("id"), "out"), "id", "left")
    rank = cut(rank.select("id", F.col("out").isNull().alias("loose"), F.lit(1.0 / n).alias("r")))
    unstage(found)
    loose = rank.where("loose").count() / n
    for _ in range(max_iter):
        got = p.join(rank.select(F.col("id").alias("source"), "r"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("in_"))
        nxt = rank.withColumnRenamed("r", "old").join(got, "id", "left").withColumn("r", (1 - alpha) / n + alpha * (F.coalesce("in_", F.lit(0.0)) + loose / n))
        seen = Observation()
        nxt = nxt.observe(seen, F.sum(F.abs(F.col("r") - F.col("old"))).alias("change"), F.sum(F.when(F.col("loose"), F.col("r")).otherwise(0.0)).alias("loose"))
        nxt = cut(nxt.select("id", "loose", "r"))
        unstage(rank)
        rank, loose = nxt, seen.get["loose"]
        if tol and seen.get["change"] < tol:
            break
    unstage(p)
    return rank.select("id", F.col("r").alias("pagerank"))


def eigenvector_centrality(nodes: DataFrame, edges: DataFrame, max_iter: int = 100, tol: float = 1e-8) -> DataFrame:
    """A5: power iteration over undirected distinct neighbours, scaled to length 1; zeros where nothing is connected.

    Each round writes the product once; its length is observed on the way and divided out when it is read.
    """
    p = cut(_ends(undirected(edges)))
    x = cut(nodes.select("id", F.lit(1.0).alias("y"), F.lit(0.0).alias("old")))
    norm = 1.0
    for _ in range(max_iter):
        unit = x.select("id", (F.col("y") / norm).alias("x"))
        got = p.join(unit, "id").groupBy(F.col("other").alias("id")).agg(F.sum("x").alias("y"))
        seen = Observation()
        nxt = unit.withColumnRenamed("x", "old").join(got, "id", "left").select("id", F.coalesce("y", F.lit(0.0)).alias("y"), "old")
        nxt = cut(nxt.observe(seen, F.sum(F.col("y") * F.col("y")).alias("square")))
        unstage(x)
        x, norm = nxt, (seen.get["square"] or 0.0) ** 0.5 or 1.0
        if tol and (x.agg(F.sum(F.abs(F.col("y") / norm - F.col("old")))).first()[0] or 0.0) < tol:
            break
    unstage(p)
    return x.select("id", (F.col("y") / norm).alias("eigenvector"))


def connected_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Id, component (least member), size; alternating star steps, so rounds grow with the log of a component.

    Joins meet on a salted copy of the key, so that adaptive execution may split a hub.
    """
    key = lambda c: F.xxhash64(c, F.lit(7))
    e = cut(undirected(edges).select(F.col("target").alias("a"), F.col("source").alias("b")))
    last = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.withColumn("k_", key("a")).join(least.select(key("a").alias("k_"), "m"), "k_").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.withColumn("k_", key("a")).join(low.select(key("a").alias("k_"), "m"), "k_").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        seen = Observation()
        step = down.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = cut(step.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")))
        unstage(e)
        e, state = nxt, (seen.get["n"], seen.get["sum"])
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    of = nodes.select("id").join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    return of.join(of.groupBy("component").agg(F.count("*").alias("size")), "component").select("id", "component", "size")


def strong_pairs(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """The distinct pairs inside strongly connected components: those that can lie on a cycle, staged.

    Forward-backward reachability by colours (Orzan, 2004): the greatest id that reaches a node is its colour; pairs of two colours go; the nodes
    of a colour that reach its namesake are a component, and only the others are looked at again. Rounds follow the longest way along which
    a colour travels, one job each.
    """
    rest = cut(pairs(edges))
    found = []
    for _ in range(most_rounds):
        color = cut(rest.select(F.col("source").alias("id")).union(rest.select("target")).distinct().select("id", F.col("id").alias("color")))
        for _ in range(most_rounds):  # forward: the greatest id that reaches a node
            sent = rest.join(color.select(F.col("id").alias("source"), F.col("color").alias("c")), "source").groupBy(F.col("target").alias("id")).agg(F.max("c").alias("c"))
            seen = Observation()
            nxt = color.join(sent, "id", "left").select("id", F.greatest("color", F.coalesce("c", "color")).alias("color"), (F.col("c") > F.col("color")).alias("new"))
            nxt = cut(nxt.observe(seen, F.count_if("new").alias("n")).drop("new"))
            unstage(color)
            color = nxt
            if not seen.get["n"]:
                break
        else:
            raise RuntimeError("colours did not settle")
        mark = lambda e: color.select(F.col("id").alias(e), F.col("color").alias(f"{e[0]}_"))
        inside = cut(rest.join(mark("source"), "source").join(mark("target"), "target").where("s_ = t_").select("source", "target", F.col("s_").alias("color")))
        member = cut(color.where("id = color").select("id"))
        front = member
        for _ in range(most_rounds):  # backward: what reaches the namesake inside its colour
            step = inside.join(front.select(F.col("id").alias("target")), "target").select(F.col("source").alias("id")).distinct()
            front = cut(step.join(member, "id", "left_anti"))
            if front.isEmpty():
                break
            member = cut(member.union(front))
        else:
            raise RuntimeError("components did not settle")
        ends = lambda df, e, how: df.join(member.select(F.col("id").alias(e)), e, how)
        found.append(cut(ends(ends(inside, "source", "left_semi"), "target", "left_semi").select("source", "target")))
        left = cut(ends(ends(inside, "source", "left_anti"), "target", "left_anti").select("source", "target"))
        unstage(rest, color, inside, member, front)
        rest = left
        if rest.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def simple_cycles(edges: DataFrame, max_len: int = 6) -> DataFrame:
    """Every simple directed cycle of 2 to max_len nodes once, from its least node on.

    Only pairs inside strongly connected components count. A cycle is two half-paths over nodes above its least one: from it to the middle and from
    there back, so paths of at most (max_len + 1) / 2 hops are grown, and halves meet on (least, middle).
    """
    p = strong_pairs(edges)
    there = {1: cut(p.where("source < target").select(F.col("source").alias("least"), F.col("target").alias("middle"), F.array("target").alias("way")))}
    back = {1: cut(p.where("source > target").select(F.col("target").alias("least"), F.col("source").alias("middle"), F.array().cast("array<string>").alias("way")))}
    for n in range(2, (max_len + 1) // 2 + 1):
        step = there[n - 1].join(p, F.col("middle") == F.col("source")).where((F.col("target") > F.col("least")) & ~F.array_contains("way", F.col("target")))
        there[n] = cut(step.select("least", F.col("target").alias("middle"), F.concat("way", F.array("target")).alias("way")))
        if n <= max_len // 2:
            # ``way`` of the way back: the nodes after the middle, in order
            step = back[n - 1].join(p, F.col("middle") == F.col("target")).where((F.col("source") > F.col("least")) & (F.col("source") != F.col("middle")) & ~F.array_contains("way", F.col("source")))
            back[n] = cut(step.select("least", F.col("source").alias("middle"), F.concat(F.array("middle"), "way").alias("way")))
    found = None
    for n in range(2, max_len + 1):
        one, two = there[(n + 1) // 2], back[n // 2]
        met = one.join(two.withColumnRenamed("way", "home"), ["least", "middle"]).where(~F.arrays_overlap("way", "home"))
        closed = met.select(F.concat(F.array("least"), "way", "home").alias("path"), F.lit(n).alias("length"))
        found = closed if found is None else found.union(closed)
    return found


def path_hops(paths: DataFrame, key: str, path: str = "path", close: bool = False) -> DataFrame:
    """(key, pos, source, target) of each hop; ``close`` adds the hop back to the start."""
    full = F.concat(F.col(path), F.slice(F.col(path), 1, 1)) if close else F.col(path)
    hops = F.transform(F.sequence(F.lit(1), F.size(full) - 1), lambda i: F.struct(i.alias("pos"), F.element_at(full, i).alias("source"), F.element_at(full, i + 1).alias("target")))
    return paths.where(F.size(full) > 1).select(key, F.explode(hops).alias("h")).select(key, "h.*")


def loop_category(path: Column, rules=LOOP_RULES, otherwise: str = OTHER_LOOPS) -> Column:
    """The first rule of which the path has all members of one set."""
    out = F.lit(otherwise)
    for name, sets in reversed(list(rules)):
        fits = F.lit(False)
        for members in sets:
            fits = fits | (F.size(F.array_except(F.array(*map(F.lit, members)), path)) == 0)
        out = F.when(fits, name).otherwise(out)
    return out


def build_loops(edges: DataFrame, cycles: DataFrame, rules=LOOP_RULES, otherwise: str = OTHER_LOOPS) -> DataFrame:
    """Cycles with the evidence of every hop: share of hops with papers (2 places), distinct pmids, category by members, and whether
    every hop has an edge. ``number`` and ``loop_id`` follow the order of the paths; loops rank by completeness, then papers, then number.
    """
    cycles = cycles.withColumn("key", F.array_join("path", "\x01"))
    pair = edges.groupBy("source", "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("pmids"), F.lit(True).alias("edge"))
    hops = path_hops(cycles, "key", close=True).join(pair, ["source", "target"], "left")
    none = F.array().cast("array<string>")
    hop = F.struct("pos", F.concat("source", F.lit("->"), "target").alias("hop"), F.coalesce("pmids", none).alias("pmids"))
    per = hops.groupBy("key").agg(F.array_sort(F.collect_list(hop)).alias("hops"), F.bool_and(F.coalesce("edge", F.lit(False))).alias("complete"))  # a loop has few hops
    pmids = F.array_sort(F.array_distinct(F.flatten(F.transform("hops", lambda h: h["pmids"]))))
    backed = F.size(F.filter("hops", lambda h: F.size(h["pmids"]) > 0))
    out = cycles.join(per, "key").select(
        "path", "length", loop_category(F.col("path"), rules, otherwise).alias("category"), F.round(backed / F.size("hops"), 2).alias("completeness"), pmids.alias("supporting_pmids"), "complete",
        F.map_from_entries(F.transform("hops", lambda h: F.struct(h["hop"], h["pmids"]))).alias("hop_pmids"),
    )
    out = out.withColumn("pmid_count", F.size("supporting_pmids"))
    return numbered(cut(out), ["path"], "number").select("*", F.concat(F.lit("L"), padded("number")).alias("loop_id"))


def counted_loops(claims: DataFrame, rules=LOOP_RULES, otherwise: str = OTHER_LOOPS, most: int = H.HELD_PAIRS) -> DataFrame:
    """A8 in counts, for loops of two and three nodes over ``claims`` (source, target, pmid): path, length, category, completeness, complete, pmid_count, number and loop_id as ``build_loops`` has them.

    Up to ``most`` rows are held by each task, which finds the loops that begin at its nodes in the order of their paths and counts their papers in place:
    nothing is shuffled or sorted for a loop. Beyond, loops are built with all their evidence.
    """
    rows = cut(claims.where("source <> target").select("source", "target", "pmid"))
    if rows.count() > most:
        edges = cut(rows.groupBy("source", "target").agg(F.array_sort(F.collect_set("pmid")).alias("pmids")))
        return build_loops(edges, simple_cycles(edges, 3), rules, otherwise).drop("supporting_pmids", "hop_pmids")
    ids = cut(numbered(cut(rows.select(F.explode(F.array("source", "target")).alias("id")).distinct()), ["id"], "no").select("id", (F.col("no") - 1).cast("int").alias("no")))
    n = ids.count()
    few = F.broadcast(ids) if n <= 1 << 20 else ids
    at = lambda e, name: few.select(F.col("id").alias(name), F.col("no").alias(e))
    papers = cut(numbered(cut(rows.where("pmid is not null").select("pmid").distinct()), ["pmid"], "paper").select("pmid", F.col("paper").cast("int").alias("paper")))
    hops = rows.join(papers, "pmid", "left").join(at("source_no", "source"), "source").join(at("target_no", "target"), "target")
    found = H.short_loops(hops.select("source_no", "target_no", F.coalesce("paper", F.lit(-1)).alias("paper")), n)
    unstage(rows, papers)
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("group").agg(F.count("*").alias("n_")).select("group", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("start_"))  # a row per group
    named = found.join(F.broadcast(starts), "group").join(at("a", "a_"), "a").join(at("b", "b_"), "b").join(at("c", "c_"), "c", "left")
    path = F.when(F.col("c") < 0, F.array("a_", "b_")).otherwise(F.array("a_", "b_", "c_"))
    out = named.select(path.alias("path"), F.when(F.col("c") < 0, 2).otherwise(3).alias("length"), "backed", F.col("papers").alias("pmid_count"), (F.col("start_") + F.col("at") + 1).alias("number"))
    out = out.withColumns({"category": loop_category(F.col("path"), rules, otherwise), "completeness": F.round(F.col("backed") / F.col("length"), 2), "complete": F.lit(True)})
    return out.select("path", "length", "category", "completeness", "complete", "pmid_count", "number", F.concat(F.lit("L"), padded("number")).alias("loop_id"))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 1 on in a total order, over all executors: numbers inside value ranges, plus what the ranges before hold.

    ``rows`` is read twice (a staged table).
    """
    by = [F.expr(o) for o in order]
    ranged = rows.repartitionByRange(*by).withColumn("part_", F.spark_partition_id())
    ranged = cut(ranged)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part_").agg(F.count("*").alias("n_")).withColumn("start_", F.coalesce(F.sum("n_").over(before), F.lit(0)))  # a row per partition
    inside = F.row_number().over(Window.partitionBy("part_").orderBy(*by))
    return ranged.withColumn("in_", inside).join(starts.select("part_", "start_"), "part_").withColumn(name, F.col("in_") + F.col("start_")).drop("part_", "in_", "start_")


def architectures(spark) -> DataFrame:
    """The default motifs: name, category, path."""
    return spark.createDataFrame(ARCHITECTURES, "name string, category string, path array<string>")


def motif_completeness(edges: DataFrame, motifs: DataFrame | None = None, graph_key: list[str] = [], nodes: DataFrame | None = None) -> DataFrame:
    """Per motif (and graph): nodes and hops present, completeness, pmids, mean confidence, hop support, rank score.

    ``nodes`` (id and the graph's key) tells which nodes a graph has; without it they are the ends of its edges. Edges that no motif asks
    for are left out before anything is grouped.
    """
    motifs = motifs if motifs is not None else architectures(edges.sparkSession)
    hops = path_hops(motifs, "name")
    asked = hops.select("source", "target").distinct()
    if graph_key:
        graphs = (nodes if nodes is not None else edges).select(*graph_key).distinct()
        hops = hops.crossJoin(graphs)
    keys = [*graph_key, "name"]
    mine = edges.join(asked, ["source", "target"], "left_semi")
    e = mine.groupBy(*graph_key, "source", "target").agg(F.flatten(F.collect_list("pmids")).alias("pmids"), F.sum("confidence").alias("conf"), F.count("*").alias("n"))
    joined = hops.join(e, [*graph_key, "source", "target"], "left")
    support = F.size(F.array_distinct(F.coalesce("pmids", F.array().cast("array<string>"))))
    per = joined.withColumn("support", support).groupBy(*keys).agg(
        F.count("*").alias("edges_total"), F.count("n").alias("edges_present"), F.coalesce(F.sum("conf"), F.lit(0.0)).alias("conf"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("supporting_pmids"), F.min("support").alias("min_support"), F.max("support").alias("max_support"), F.round(F.avg("support"), 4).alias("avg_support"),
        F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.concat("source", F.lit(" → "), "target")))).alias("missing_edges"),
    )
    completeness = F.col("edges_present") / F.col("edges_total")
    mean = F.when(F.col("n") > 0, F.col("conf") / F.col("n")).otherwise(0.0)
    out = per.select(*keys, "edges_present", "edges_total", completeness.alias("c"), "supporting_pmids", F.size("supporting_pmids").alias("pmid_count"), mean.alias("m"), "min_support", "max_support", "avg_support", "missing_edges")
    out = out.select("*", F.round("c", 4).alias("completeness"), F.round("m", 4).alias("avg_confidence"), F.round(F.col("c") * F.col("pmid_count") * F.col("m"), 4).alias("rank_score")).drop("c", "m")
    # places of the path that the graph has, a node that stands twice counting twice
    places = motifs.select("name", F.posexplode("path").alias("place", "id"))
    ids = nodes.select(*graph_key, "id") if nodes is not None else edges.select(*graph_key, F.explode(F.array("source", "target")).alias("id"))
    have = ids.join(places.select("id").distinct(), "id", "left_semi").distinct()
    present = places.join(have, "id").groupBy(*keys).agg(F.count("*").alias("nodes_present"))
    out = out.join(present, keys, "left").withColumn("nodes_present", F.coalesce("nodes_present", F.lit(0)))
    return out.join(motifs.select("name", "category", F.size("path").alias("nodes_total")), "name")


def rank_architectures(loops: DataFrame, k: int = 25) -> DataFrame:
    """A10: the first k loops by completeness, papers and number, with rank, name and score (completeness times papers, one at least)."""
    order = [F.desc("completeness"), F.desc("pmid_count"), F.asc("number")]
    top = loops.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # k rows
    score = F.round(F.col("completeness") * F.greatest("pmid_count", F.lit(1)), 2)
    name = F.concat("category", F.lit(":"), F.array_join("path", " -> "))
    return top.select("rank", name.alias("name"), "completeness", "pmid_count", F.lit(0.0).alias("avg_confidence"), score.alias("composite_score"), "path", "loop_id")


def cross_graph_motifs(edges: DataFrame, motifs: DataFrame, graph_key: str = "graph_id") -> DataFrame:
    """Motif by graph: completeness everywhere, class shared, specific, partial or absent, and whether support is comparable."""
    per = motif_completeness(edges, motifs, [graph_key])
    full, some = F.count_if(F.col("completeness") >= 1), F.count_if(F.col("completeness") > 0)
    out = per.groupBy("name").agg(F.count("*").alias("graphs"), full.alias("full_graphs"), some.alias("some_graphs"), F.round(F.max("completeness"), 4).alias("best"), F.round(F.min("completeness"), 4).alias("worst"), F.sum("pmid_count").alias("pmids"))
    kind = F.when(F.col("full_graphs") == F.col("graphs"), "shared").when((F.col("full_graphs") > 0) & (F.col("worst") < 0.5), "specific").when(F.col("some_graphs") > 0, "partial").otherwise("absent")
    return out.withColumn("class", kind)


def transfer_notes(edges: DataFrame, motifs: DataFrame, papers: DataFrame, graph_key: str = "graph_id", comparable: float = 0.5) -> DataFrame:
    """Per motif and pair of graphs what may be carried over, and whether both corpora are of comparable size.

    ``papers``: (graph, papers) sizes of the corpora; comparable where the smaller has at least that share of the larger.
    """
    per = motif_completeness(edges, motifs, [graph_key]).select("name", F.col(graph_key).alias("g"), F.col("completeness").alias("c"), F.col("pmid_count").alias("p"))
    sizes = papers.select(F.col(graph_key).alias("g"), F.col("papers").alias("size"))
    per = per.join(sizes, "g", "left")
    one = per.select("name", *(F.col(c).alias(f"{c}_a") for c in ("g", "c", "p", "size")))
    two = per.select("name", *(F.col(c).alias(f"{c}_b") for c in ("g", "c", "p", "size")))
    both = one.join(two, "name").where("g_a < g_b")
    note = F.expr(
        """case when c_a >= 1 and c_b < 0.5 then 'full in the first, weak in the second' when c_b >= 1 and c_a < 0.5 then 'full in the second, weak in the first'
        when c_a >= 1 and c_b >= 1 then 'present in both' when p_a >= 3 and p_b <= 1 then 'several sources in the first, one or none in the second'
        when p_b >= 3 and p_a <= 1 then 'several sources in the second, one or none in the first' end"""
    )
    return both.select("name", F.col("g_a").alias("graph_a"), F.col("g_b").alias("graph_b"), note.alias("note"), (F.least("size_a", "size_b") >= comparable * F.greatest("size_a", "size_b")).alias("comparable"))


def contradictions(edges: DataFrame, activate: list[str] = ACTIVATE, suppress: list[str] = SUPPRESS) -> DataFrame:
    """Opposite claims, once per unordered pair and kind, both sides kept and no winner.

    Kinds: same_direction (a->b activates and suppresses; ``one_edge`` where a single edge does both) and reverse (a->b activates, b->a suppresses or
    the other way round). Pairs meet by one aggregation on the unordered pair instead of a scan of all edges.
    """
    has = lambda words: F.arrays_overlap("relations", F.array(*map(F.lit, words)))
    rows = edges.where("source <> target").select("source", "target", F.explode("relations").alias("r"), "pmids", (has(activate) & has(suppress)).alias("both"))
    sign = F.when(F.col("r").isin(activate), "+").when(F.col("r").isin(suppress), "-")
    rows = rows.withColumn("sign", sign).where("sign is not null")
    rows = rows.withColumns({"a": F.least("source", "target"), "b": F.greatest("source", "target"), "way": F.when(F.col("source") < F.col("target"), ">").otherwise("<")})
    side = rows.groupBy("a", "b", "way", "sign").agg(F.array_sort(F.collect_set("r")).alias("relations"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pmids")))).alias("pmids"), F.max("both").alias("both"))
    slot = lambda way, sign, c: F.max(F.when((F.col("way") == way) & (F.col("sign") == sign), F.col(c)))
    cells = {f"{n}_{c}": slot(w, s, c) for n, w, s in (("fp", ">", "+"), ("fm", ">", "-"), ("bp", "<", "+"), ("bm", "<", "-")) for c in ("relations", "pmids", "both")}
    wide = side.groupBy("a", "b").agg(*(v.alias(k) for k, v in cells.items()))

    def pick(kind: str, x: str, y: str) -> Column:
        both = F.col(f"{x}_relations").isNotNull() & F.col(f"{y}_relations").isNotNull()
        return F.when(both, F.struct(F.lit(kind).alias("kind"), F.lit(x).alias("side_a"), F.lit(y).alias("side_b"), F.col(f"{x}_relations").alias("relations_a"), F.col(f"{y}_relations").alias("relations_b"), F.col(f"{x}_pmids").alias("pmids_a"), F.col(f"{y}_pmids").alias("pmids_b"), (F.lit(kind == "same_direction") & F.col(f"{x}_both")).alias("one_edge")))

    found = F.array_compact(F.array(pick("same_direction", "fp", "fm"), pick("same_direction", "bp", "bm"), pick("reverse", "fp", "bm"), pick("reverse", "fm", "bp")))
    return wide.select("a", "b", F.explode(found).alias("x")).select("a", "b", "x.*")


def contradiction_coverage(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Ordered pairs with two or more edges, and contradictions logged."""
    several = edges.groupBy("source", "target").count().where("count > 1").agg(F.count("*").alias("pairs_checked"))
    return several.crossJoin(found.agg(F.count("*").alias("contradictions")))


def motif_gaps(nodes: DataFrame, edges: DataFrame, motifs: DataFrame) -> DataFrame:
    """Missing hops, contradictory where only the reverse exists, unknown where both nodes do, else untested."""
    p = edges.select("source", "target").distinct()
    lone = path_hops(motifs, "name").join(p, ["source", "target"], "left_anti")
    back = p.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(True).alias("reverse"))
    ids = nodes.select("id").distinct()
    out = lone.join(back, ["source", "target"], "left")
    out = out.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("has_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("has_t")), "target", "left")
    status = F.when(F.col("reverse"), "contradictory").when(F.col("has_s") & F.col("has_t"), "unknown").otherwise("untested")
    return out.select(F.col("name").alias("architecture"), F.concat("source", F.lit(" → "), "target").alias("missing_edge"), status.alias("status"), F.coalesce("has_s", F.lit(False)).alias("source_in_graph"), F.coalesce("has_t", F.lit(False)).alias("target_in_graph"))


def support_gaps(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with one paper or none, and directions in conflict."""
    thin = nodes.where("pmid_count = 1").select(F.lit("poorly_studied").alias("status"), F.col("id").alias("subject"))
    bare = nodes.where("pmid_count = 0").select(F.lit("canonical_only").alias("status"), F.col("id").alias("subject"))
    clash = found.select(F.lit("direction_conflict").alias("status"), F.concat_ws("|", "a", "b").alias("subject")).distinct()
    return thin.union(bare).union(clash)


def priority_gaps(edges: DataFrame, watch: DataFrame, sample: int = 5) -> DataFrame:
    """Watched pairs (source, target, tag): EVIDENCED or UNTESTED, with support and the first pmids.

    Only the edges of watched pairs are grouped; papers are distinct by (pair, paper) and ranked, so no array holds more than ``sample``.
    """
    mine = edges.join(watch.select("source", "target").distinct(), ["source", "target"], "left_semi")
    papers = mine.select("source", "target", F.explode_outer("pmids").alias("pmid")).distinct()
    rank = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.asc_nulls_last("pmid")))
    support = papers.groupBy("source", "target").agg(F.count("pmid").alias("support"))
    first = papers.where("pmid is not null").withColumn("n_", rank).where(F.col("n_") <= sample).groupBy("source", "target").agg(F.array_sort(F.collect_list("pmid")).alias("first_pmids"))
    out = watch.join(support, ["source", "target"], "left").join(first, ["source", "target"], "left")
    status = F.when(F.col("support").isNotNull(), "EVIDENCED").otherwise("UNTESTED")
    return out.select("source", "target", "tag", status.alias("status"), F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("first_pmids", F.array().cast("array<string>")).alias("first_pmids"))


#: A node with more than so many ways through it is heavy; ends of a block of heavy ways; pairs that one holds at most about, and that are worth a block of their own where blocks
#: are fewer than five; rows of a block that are added up at once.
HEAVY_WAYS, WAYS_BLOCK, WAYS_PAIRS, WAYS_FEW, WAYS_ROWS = 4096, 4096, 1 << 24, 1 << 18, 512


def untested_transitive(edges: DataFrame, heavy: int = HEAVY_WAYS, block: int = WAYS_BLOCK, top: int | None = None) -> DataFrame:
    """A->b->c evidenced while a->c is not; with the number of ways over b. ``top`` keeps each a's most frequented c.

    Nodes with few ways through them are joined out. Those with more, of which E pairs have at most E / sqrt(heavy), are numbered, and so are the ends
    of their pairs. A block of a has their heavy successors, the pairs that aren't asked for and the light ways as compressed arrays, a block of c its heavy predecessors; every block of a
    meets every block of c where it is read, so that what is written grows with the pairs, not with the blocks. Ways are added up row by row, and the pairs
    that come out, which may be all pairs of nodes, leave as they are found and are not shuffled.
    """
    p = cut(pairs(edges))
    into = p.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"))
    out = p.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"))
    through = cut(into.join(out, "id").select("id", (F.col("n_in") * F.col("n_out") > heavy).alias("heavy")))
    light = through.where("not heavy").select(F.col("id").alias("b"))
    one, two = p.select(F.col("source").alias("a"), F.col("target").alias("b")), p.select(F.col("source").alias("b"), F.col("target").alias("c"))
    known = p.select(F.col("source").alias("a"), F.col("target").alias("c"))
    ways = one.join(light, "b").join(two, "b").where("a <> c").groupBy("a", "c").agg(F.count("*").alias("ways"))
    hubs = cut(numbered(cut(through.where("heavy").select("id")), ["id"], "no").select(F.col("id").alias("b"), (F.col("no") - 1).alias("no")))
    if hubs.isEmpty():
        found = ways.join(known, ["a", "c"], "left_anti")
    else:
        sides = {"a": cut(one.join(hubs, "b").select("a", "no")), "c": cut(two.join(hubs, "b").select("c", "no"))}
        ends = {e: cut(numbered(cut(side.select(e).distinct()), [e], "k").select(e, (F.col("k") - 1).alias(f"k_{e}"))) for e, side in sides.items()}
        marked = cut(ways.join(ends["a"], "a", "left").join(ends["c"], "c", "left"))
        both = F.col("k_a").isNotNull() & F.col("k_c").isNotNull()
        found = marked.where(~both).select("a", "c", "ways").join(known, ["a", "c"], "left_anti")
        sides = {e: side.join(ends[e], e).select(f"k_{e}", "no") for e, side in sides.items()}
        met = known.join(ends["a"], "a").join(ends["c"], "c").select("k_a", "k_c")
        found = found.union(_heavy_ways(sides, ends, met, marked.where(both).select("k_a", "k_c", "ways"), block))
    if top is not None:
        found = found.withColumn("n_", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("ways"), "c"))).where(F.col("n_") <= top).drop("n_")
    return found


def _heavy_ways(sides: dict[str, DataFrame], ends: dict[str, DataFrame], met: DataFrame, light: DataFrame, block: int) -> DataFrame:
    """(a, c, ways) of all a and c that share numbers: sides (k_a, no) and (k_c, no); pairs ``met`` (k_a, k_c) aren't asked for, ``light`` (k_a, k_c, ways) adds ways. ``ends`` has the names."""
    light_ways = light.count()
    size = {}
    for e, side in sides.items():
        held = max(side.count(), light_ways if e == "a" else 0)
        size[e] = min(block, -(-ends[e].count() // (max(held // WAYS_PAIRS, min(held // WAYS_FEW, 4)) + 1)))
    split = lambda k, n: ((F.col(k) / n).cast("int").alias("block"), (F.col(k) % n).cast("int").alias("at"))

    def columns(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values(["no", "at"])
        no, many = np.unique(one["no"], return_counts=True)
        return pd.DataFrame({"block": [key[0]], "data": [H.packed(np.concatenate([[len(no)], no, many, one["at"]]))]})

    def extra(key: tuple, one: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [key[0]], "data": [H.packed(np.concatenate([one[c] for c in ("at", "k_c", "ways")]))]})

    data = "block int, data binary"
    names = {e: ids.select(split(f"k_{e}", size[e])[0], F.struct(f"k_{e}", e).alias("x")).groupBy("block").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x[e]).alias("names")) for e, ids in ends.items()}
    parts = [names["a"], H.packed_neighbours(sides["a"], "k_a", "no", size["a"]).withColumnRenamed("data", "hubs")]
    parts += [H.packed_neighbours(met, "k_a", "k_c", size["a"]).withColumnRenamed("data", "met")]
    parts += [light.select(*split("k_a", size["a"]), "k_c", "ways").groupBy("block").applyInPandas(extra, data).withColumnRenamed("data", "light")]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.join(part, "block", "left")
    cols = names["c"].join(sides["c"].select(*split("k_c", size["c"]), "no").groupBy("block").applyInPandas(columns, data), "block")
    # a block is a partition, and each of a is read again for each of c
    spread = lambda df: df.repartitionById(df.count(), "block")
    rows = spread(cut(rows)).withColumnsRenamed({"block": "a_block", "names": "a_names"})
    cols = spread(cut(cols)).withColumnsRenamed({"block": "c_block", "names": "c_names"})
    wide, high = size["c"], size["a"]

    def product(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = {c: batch.column(c)[at] for c in batch.schema.names}
                yield from _ways_of_block(one, high, wide)

    return rows.hint("shuffle_replicate_nl").crossJoin(cols).mapInArrow(product, "a string, c string, ways long")


def _ways_of_block(one: dict, high: int, wide: int):
    """The ways from a block of a to a block of c, as batches (a, c, ways)."""
    names = {e: one[f"{e}_names"].values for e in ("a", "c")}
    n_a, n_c, low = len(names["a"]), len(names["c"]), one["c_block"].as_py() * wide
    unpack = lambda c: H.unpacked(one[c].as_py()) if one[c].is_valid else np.zeros(high if c == "met" else 0, np.int32)

    def lists(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(values[:high], dtype=np.int64)]), values[high:]

    hub_at, hubs = lists(unpack("hubs"))
    met_at, met = lists(unpack("met"))
    light_at, light_to, light_ways = unpack("light").reshape(3, -1)
    mine = (light_to >= low) & (light_to < low + n_c)
    light_at, light_to, light_ways = light_at[mine], light_to[mine] - low, light_ways[mine]
    values = unpack("data")
    used = values[1 : values[0] + 1]
    top = int(max(used.max(initial=0), hubs.max(initial=0))) + 1
    many = np.zeros(top, np.int64)
    many[used] = values[values[0] + 1 : 2 * values[0] + 1]
    ends, stop = values[2 * values[0] + 1 :], np.cumsum(many)
    start = stop - many
    here = {name: k for k, name in enumerate(names["c"].to_pylist())}
    own = np.array([here.get(name, -1) for name in names["a"].to_pylist()])
    for first in range(0, n_a, WAYS_ROWS):
        last = min(first + WAYS_ROWS, n_a)
        total = np.zeros((last - first, n_c), np.int32)
        near = hubs[hub_at[first] : hub_at[last]]
        row = np.repeat(np.arange(last - first), np.diff(hub_at[first : last + 1]))
        if many[near].sum() * 12 > total.size * len(used):  # dense: products of 0/1 matrices
            for low_no in range(0, top, 4096):
                bits = [np.zeros((x, min(4096, top - low_no)), np.uint8) for x in total.shape]
                part = (near >= low_no) & (near < low_no + 4096)
                bits[0][row[part], near[part] - low_no] = 1
                no = np.repeat(np.arange(bits[1].shape[1]), many[low_no : low_no + 4096])
                bits[1][ends[start[low_no] : start[low_no] + len(no)], no] = 1
                _add_ways(total, np.arange(last - first), np.arange(n_c), *bits)
        else:
            for k in range(first, last):
                own_hubs = hubs[hub_at[k] : hub_at[k + 1]]
                found = [ends[x:y] for x, y in zip(start[own_hubs].tolist(), stop[own_hubs].tolist()) if x < y]
                if found:
                    total[k - first] = np.bincount(np.concatenate(found), minlength=n_c)
        added = (light_at >= first) & (light_at < last)
        np.add.at(total, (light_at[added] - first, light_to[added]), light_ways[added])
        gone = met[met_at[first] : met_at[last]] - low
        row = np.repeat(np.arange(last - first), np.diff(met_at[first : last + 1]))
        inside = (gone >= 0) & (gone < n_c)
        total[row[inside], gone[inside]] = 0
        same = np.flatnonzero(own[first:last] >= 0)
        total[same, own[first:last][same]] = 0
        i, j = np.nonzero(total)
        for cut_at in range(0, len(i), 1 << 18):
            x, y = i[cut_at : cut_at + (1 << 18)], j[cut_at : cut_at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([names["a"].take(pa.array(x + first)), names["c"].take(pa.array(y)), pa.array(total[x, y].astype(np.int64))], ["a", "c", "ways"])


def _add_ways(total: np.ndarray, rows: np.ndarray, cols: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    """Adds the numbers shared by each row of two 0/1 matrices: number by number where few rows have each, else as a product."""
    ways = int(left.sum(0, dtype=np.int64) @ right.sum(0, dtype=np.int64))
    if ways * 64 > left.size * len(right):
        total[np.ix_(rows, cols)] += (left.astype(np.float32) @ right.astype(np.float32).T).astype(np.int32)
        return
    (k, i), (l, j) = np.nonzero(left.T), np.nonzero(right.T)
    number = np.arange(left.shape[1] + 1)
    i_at, j_at = np.searchsorted(k, number), np.searchsorted(l, number)
    i, j = rows[i], cols[j]
    for one in np.flatnonzero((np.diff(i_at) > 0) & (np.diff(j_at) > 0)):
        total[i[i_at[one] : i_at[one + 1], None], j[j_at[one] : j_at[one + 1]]] += 1


def graph_health(nodes: DataFrame, edges: DataFrame, loops: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counts."""
    touched = _ends(edges).select("id").distinct().withColumn("touched", F.lit(True))
    n = nodes.join(touched, "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("touched").isNull() | (F.col("edge_count") == 1)).alias("isolated_nodes"), F.count_if(F.col("pmid_count") == 0).alias("canonical_nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("evidence_strength") == "weak").alias("weak_edges"), F.count_if(F.col("pmid_count") == 1).alias("single_paper_edges"))
    top = F.max_by(F.array_join("path", ">"), F.struct("completeness", "pmid_count", -F.col("number"))) if "path" in loops.columns else F.max(F.lit(None).cast("string"))
    return n.crossJoin(e).crossJoin(loops.agg(F.count("*").alias("loops"), top.alias("top_loop"))).crossJoin(found.agg(F.count("*").alias("contradictions")))


def graph_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of two versions by change: added, removed, kept."""
    b, a = before.select(*key).distinct().withColumn("b", F.lit(True)), after.select(*key).distinct().withColumn("a", F.lit(True))
    both = b.join(a, key, "full_outer")
    return both.groupBy(F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("kept").alias("change")).agg(F.count("*").alias("rows"))
