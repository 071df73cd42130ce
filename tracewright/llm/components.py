"""Connected components of a table of links: stars within chunks of links, then alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import HEAVY, dropped, written

#: Links that a task holds at once.
CHUNK = 1 << 18


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _with_least(rows: DataFrame, least: DataFrame, hubs: list[int]) -> DataFrame:
    """rows with m, the least neighbour of u; hubs, a few nodes of very many links, come by broadcast."""
    if not hubs:
        return rows.join(least, "u")
    is_hub = F.col("u").isin(hubs)
    return rows.where(~is_hub).join(least.where(~is_hub), "u").unionByName(rows.where(is_hub).join(F.broadcast(least.where(is_hub)), "u"))


def _large(edges: DataFrame, hubs: list[int]) -> DataFrame:
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return _with_least(both.where("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(edges: DataFrame, hubs: list[int]) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _with_least(down, least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _look(edges: DataFrame, links: int) -> tuple[tuple, list[int], int]:
    """A sign of the edges that changes when they do, the nodes with over one in HEAVY of links ends, and the number of edges."""
    per_node = _both(edges).groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    hub = F.when(F.col("n") > max(HEAVY, 2 * links // HEAVY), F.col("u"))
    n, h, hubs = per_node.agg(F.sum("n"), F.sum("h"), F.collect_list(hub)).first()  # a bounded list: hubs have most links between them
    return (n, h), sorted(hubs), (n or 0) // 2


def _stars(chunk: int):
    """Links to links of the same components, from every node to the least that it reaches within a chunk: fewer than the chunk has nodes."""

    def star(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        parent = list(range(len(nodes)))
        for p, q in zip(at[: len(u)].tolist(), at[len(u) :].tolist()):
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            while parent[q] != q:
                parent[q] = q = parent[parent[q]]
            if p < q:
                parent[q] = p
            else:
                parent[p] = q
        for x, p in enumerate(parent):  # a parent is less than its node
            parent[x] = parent[p]
        root = np.array(parent)
        some = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], ["u", "v"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for first in range(0, batch.num_rows, chunk):
                held.append([batch.slice(first, chunk).column(c).to_numpy() for c in "uv"])
                n += len(held[-1][0])
                if n >= chunk:
                    yield star(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if held:
            yield star(*map(np.concatenate, zip(*held)))

    return run


def components(edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(node, root) for every node that has a link, roots included; the root is the component's least node.

    edges: columns u and v of type long.  Rows with a null or with u = v link nothing.  Many links among few nodes, as those of
    a crowd to its many pivots, become few within chunks, which lose no connection; the steps then join the chunks.
    """
    given = written(edges.where("u != v").select("u", "v"), "links")
    n = given.count()
    now = written(given.coalesce(max(1, -(-n // chunk))).mapInArrow(_stars(chunk), "u long, v long"), "chunk-stars")
    dropped(given)
    before, hubs, n = _look(now, now.count())
    while True:
        after = written(_small(_large(now, hubs), hubs), "stars")
        dropped(now)
        now = after
        sign, hubs, n = _look(now, n)
        if sign == before:
            break
        before = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
