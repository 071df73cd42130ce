"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles (words as runs of letters and digits,
A-Z in lower case).  Copies, that is equal sets, are folded into one
representative first.  Each set is embedded as a sketch of minhash values; in
every run a tree of paths is grown over the sketches: a node samples few sketch
positions, the same for all sets, and splits its sets by their values there.
Sets that share many shingles share a path in a run with good odds, and runs
are repeated until the target recall at the threshold is reached.

Nodes that few sets share are brute-forced: pairs whose sketches look alike
become candidate links.  In a node that more sets share, one of them, drawn for
the node, is the pivot.  Sets that look alike to it are linked to it; those that
look very like it are done with in that node, since what they resemble resembles
the pivot too; the others are split again, at most to the last level, where all
sets of a large node are linked to its pivot unseen, so that none is cut off.  Components of candidate links then hold every
pair that can matter, and all pairs of a component are compared exactly on the
shingles, block against block, so that links inside a component are found
whatever paths found it.  Blocks hold sets of like size, and only blocks are
compared whose sizes allow the threshold.  Out of each comparison of blocks come
counts of links for each set and a spanning forest, never the pairs.  The number
of links of a set is a count over pairs, so a group of very many different texts
that are all alike costs the square of their number, in tasks of bounded size.

Defined cases: a document of fewer than five words has one shingle of all its
words; a document without words, or a null, has no links and is a class of its
own; rows of equal sets are copies of each other, whatever their doc_ids; rows
of one doc_id with different texts are different documents; rows without doc_id
take part and bear a null; a very long text is a chunk of its own and is read
whole; an empty table gives no rows; other columns are carried along by
representatives(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import dropped, join_counted, written
from . import textops
from .components import components

WIDTH = 5
THRESHOLD = 0.8
SKETCH = 48
#: The chance for each position of a sketch to be sampled is 1 / (BRANCH * SKETCH).
BRANCH = 0.7
#: The same below the first trees' last level, where sets share many nodes already: a pair at the threshold shares one child of a node.
BRANCH_BELOW = 0.8
#: Levels of the first trees, and of the further split of nodes with many sets.
LEVELS = (3, 5)
#: Sets of a node that is brute-forced.
SMALL = 48
RECALL = 0.999
#: Pairs with a lower share of equal sketch values aren't candidates: over five standard deviations below the threshold.
ALIKE = 0.5
#: A set with as large a share of a pivot's sketch values needs no further split: what is at the threshold with it is at 0.65 or more
#: with the pivot, two standard errors above ALIKE, and a pair shares several nodes, each with a pivot of its own.
SETTLED = 0.85
#: Sets in a block of the exact comparison.
BLOCK = 512
#: Sizes of a block's sets are within this ratio, where a component has several blocks.
SIZE_RATIO = 1.25

SEEDS = textops.mix(np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = textops.mix(SEEDS) | np.uint64(1)


def _lost(similar: float, levels: int, below: int) -> float:
    """The chance that a pair of similar sketches shares no node after so many levels of the first trees and of those below."""
    lost = 0.0
    for branch, n in ((BRANCH_BELOW, below), (BRANCH, levels)):
        for _ in range(n):  # a Poisson number of shared children for each shared node
            lost = math.exp(-(similar / branch) * (1 - lost))
    return lost


def runs_for(recall: float = RECALL, threshold: float = THRESHOLD, levels: tuple[int, ...] = LEVELS) -> int:
    """Runs after which a pair at the threshold has shared a node with probability recall.

    A node of the first trees, if its sketch is two standard errors below the threshold; and a node of the last level, if
    all nodes that the pair shares have many sets, down to there.
    """
    low = threshold - 2 * math.sqrt(threshold * (1 - threshold) / SKETCH)
    worst = max(_lost(low, levels[0], 0), _lost(threshold, levels[0], levels[-1] - levels[0]))
    return math.ceil(math.log(1 - recall) / math.log(worst))


def fingerprints(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    hi, lo = np.zeros(len(first) - 1, np.uint64), np.zeros(len(first) - 1, np.uint64)
    some = np.diff(first) > 0
    if len(values):
        hi[some] = np.add.reduceat(textops.mix(values + np.uint64(1)), first[:-1][some])
        lo[some] = np.add.reduceat(textops.mix(values ^ SEEDS[0]), first[:-1][some])
    return hi, lo


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (distinct shingles), hi and lo (a 128-bit sum over the set), sketch (SKETCH 32-bit minhash values)."""

    def run(batches):
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                values, first = textops.shingles(texts, width)
                n = np.diff(first)
                some = n > 0
                sketch = np.zeros((len(texts), SKETCH), np.uint32)
                hi, lo = fingerprints(values, first)
                if len(values):
                    at = first[:-1][some]
                    for k in range(SKETCH):
                        sketch[some, k] = np.minimum.reduceat((values ^ SEEDS[k]) * FACTORS[k], at) >> np.uint64(32)
                rows = [sketch[i].tobytes() for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), pa.array(n, pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(rows, pa.binary())], ["doc_id", "n", "hi", "lo", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, hi long, lo long, sketch binary")


def _grow(sketch: np.ndarray, rows: np.ndarray, path: np.ndarray, levels: int, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Splits nodes levels times: (rows, path) of the sets in the nodes reached."""
    chance = np.uint64(int(2**64 / (branch * SKETCH)))
    for _ in range(levels):
        out_rows, out_path = [], []
        for k in range(SKETCH):
            take = textops.mix(path ^ SEEDS[k]) < chance
            out_rows.append(rows[take])
            out_path.append(textops.mix(path[take] * textops._Q + SEEDS[k] + sketch[rows[take], k]))
        rows, path = np.concatenate(out_rows), np.concatenate(out_path)
    return rows, path


def _paths(levels: int, runs: int):
    """Arrow batches (id, sketch, paths) to one row for each node (path) that a set reaches."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, SKETCH).astype(np.uint64)
            if "path" in batch.schema.names:
                branch = BRANCH_BELOW
                rows, path = np.arange(len(sketch)), batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            else:
                branch = BRANCH
                rows = np.tile(np.arange(len(sketch)), runs)
                path = np.repeat(textops.mix(np.arange(1, runs + 1, dtype=np.uint64)), len(sketch))
            rows, path = _grow(sketch, rows, path, levels, branch)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(path.view(np.int64))], ["id", "path"])

    return run


def _pairs(batches):
    """Sets of small nodes, with their sketches, to candidate links that join all alike ones: a forest for each node, not its pairs."""
    for batch in batches:
        u, v = [], []
        for ids, raw in zip(batch.column("ids").to_pylist(), batch.column("sketches").to_pylist()):
            sketch = np.frombuffer(b"".join(raw), np.uint32).reshape(-1, SKETCH)
            ids = np.array(ids)
            alike = (sketch[:, None, :] == sketch[None, :, :]).mean(2) >= ALIKE
            if forest := _forest(len(ids), *np.nonzero(np.triu(alike, 1))):
                pair = ids[np.array(forest)]
                u.append(pair.max(1))
                v.append(pair.min(1))
        if u:
            pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])


def _against_pivots(batches):
    """Sets of large nodes beside their pivots to (id, path, pivot, alike, settled)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SKETCH) for c in ("sketch", "pivot_sketch"))
        share = (own == other).mean(1)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("path"), batch.column("pivot"), pa.array(share >= ALIKE), pa.array(share >= SETTLED)], ["id", "path", "pivot", "alike", "settled"])


def candidate_links(sets: DataFrame, recall: float = RECALL, tables: list[DataFrame] | None = None) -> DataFrame:
    """Links (u, v) whose components hold all pairs of sets that some run brings together.  sets: a table of id and sketch; tables: takes the tables that the links are made of."""
    tables = [] if tables is None else tables
    links = None
    sketches_of = sets.select("id", "sketch")
    todo, runs = sketches_of, runs_for(recall)
    for turn, level in enumerate(LEVELS):
        steps = level - (LEVELS[turn - 1] if turn else 0)
        reached = written(todo.mapInArrow(_paths(steps, runs), "id long, path long"), f"paths-{turn}")
        pivot = F.min(F.struct(F.xxhash64("id", "path").alias("draw"), "id"))["id"]
        nodes = written(reached.groupBy("path").agg(F.count("*").alias("n"), pivot.alias("pivot")).where("n > 1"), f"nodes-{turn}")
        tables += [reached, nodes]
        small = reached.join(nodes.where(F.col("n") <= SMALL).select("path"), "path").groupBy("path").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("ids").distinct()
        small = small.select(F.xxhash64("ids").alias("node"), F.explode("ids").alias("id")).join(sketches_of, "id")
        small = small.groupBy("node").agg(F.collect_list("id").alias("ids"), F.collect_list("sketch").alias("sketches")).select("ids", "sketches")
        found = small.mapInArrow(_pairs, "u long, v long")
        links = found if links is None else links.unionByName(found)
        large = nodes.where(F.col("n") > SMALL).select("path", "pivot")
        if not large.head(1):
            break
        many = reached.join(large, "path")
        if turn == len(LEVELS) - 1:
            links = links.unionByName(many.where("id != pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")))
            break
        beside = many.join(sketches_of, "id").join(sketches_of.select(F.col("id").alias("pivot"), F.col("sketch").alias("pivot_sketch")), "pivot")
        judged = written(beside.select("id", "path", "pivot", "sketch", "pivot_sketch").mapInArrow(_against_pivots, "id long, path long, pivot long, alike boolean, settled boolean"), f"pivots-{turn}")
        tables.append(judged)
        links = links.unionByName(judged.where("alike and id != pivot").select(F.col("id").alias("u"), F.col("pivot").alias("v")))
        todo = judged.where("not settled").select("id", "path").join(sketches_of, "id")
    return links.distinct()


def _dense(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    known = np.intersect1d(np.concatenate(left), np.concatenate(right))
    if not len(known):
        return np.zeros((len(left), len(right)))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        values = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        ok = known[at] == values
        return owner[ok], at[ok]

    out = np.zeros((len(left), len(right)), np.float32)
    (lo, la), (ro, ra) = matrix(left), matrix(right)
    step = min(8192, len(known))
    for a in range(0, len(known), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        keep = (la >= a) & (la < a + step)
        x[lo[keep], la[keep] - a] = 1
        keep = (ra >= a) & (ra < a + step)
        y[ro[keep], ra[keep] - a] = 1
        out += x @ y.T
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links among (a, b) that join the same components of 0 to n - 1."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
            if len(out) == n - 1:
                break
    return out


LINKS = "id long, links long, other long"


def _compare_sets(pdf: pd.DataFrame, threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links, other) of the sets of one component's block, or two blocks."""
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    ids, copies, block = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["block"].to_numpy()
    one = pdf["low"].iloc[0] == pdf["high"].iloc[0]
    cut = len(ids) if one else int(np.searchsorted(block, block[0], "right"))
    if len(ids) < 2 or not one and cut == len(ids):
        return []
    left, right = sets[:cut], sets if one else sets[cut:]
    shared = _dense(left, right).astype(np.float64)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    linked = shared >= threshold * (size_l[:, None] + size_r[None, :] - shared) - 1e-9
    if one:
        np.fill_diagonal(linked, False)
    none = np.full(len(ids), -1)
    if one:
        out = [(ids, linked @ copies, none)]
    else:
        out = [(ids, np.concatenate([linked @ copies[cut:], copies[:cut] @ linked]), none)]
    a, b = np.nonzero(np.triu(linked) if one else linked)
    if forest := _forest(len(ids), a, b if one else b + cut):
        x = np.array(forest)
        out.append((ids[x[:, 0]], np.zeros(len(x), np.int64), ids[x[:, 1]]))
    return out


def _compare(threshold: float):
    """Every pair of sets within a block, or of two blocks: how many documents each is linked to, and a spanning forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["component", "block", "id"])
        edges = np.flatnonzero(np.diff(pdf["component"].to_numpy())) + 1
        edges = [0, *edges.tolist(), len(pdf)]
        out = [x for a, b in zip(edges, edges[1:]) for x in _compare_sets(pdf.iloc[a:b], threshold)]
        parts = [np.concatenate(x).astype(np.int64) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("id", "links", "other"), parts)))

    return run


KEPT = ["id", "component", "copies", "step"]


def _shingles_of(width: int):
    """Shingles of the texts whose set is the one asked for: a doc_id may stand for several texts."""

    def run(batches):
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                values, first = textops.shingles(texts, width)
                _, lo = fingerprints(values, first)
                part = batch.slice(texts.first, len(texts))
                sets = pa.array([values[first[i] : first[i + 1]].tobytes() for i in range(len(texts))], pa.binary())
                same = pa.array(lo.view(np.int64) == part.column("lo").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEPT), sets], [*KEPT, "shingles"]).filter(same)

    return run


def _classes(docs: DataFrame, width: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Tables: every row's doc_id, n, hi and lo; every set's hi, lo, n, root, least_doc, copies and n_links."""
    all_docs = written(sketches(docs, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    known = all_docs.where("n > 0")
    # a set's id is its least row; a set's copies are counted before anything is shuffled by set
    sets = written(known.groupBy("hi", "lo", "n").agg(F.min("row").alias("id"), F.count("*").alias("copies"), F.min("doc_id").alias("least_doc")), "sets")
    reps = written(known.select(F.col("row").alias("id"), "doc_id", "n", "lo", "sketch").join(sets.select("id", "copies"), "id"), "representatives")
    tables: list[DataFrame] = []
    rough = written(components(candidate_links(reps, recall, tables)), "rough")
    dropped(*tables)
    chosen = rough.join(reps.select("id", "doc_id", "n", "lo", "copies"), rough["node"] == reps["id"])
    # sets at the threshold differ in size by its inverse at most, so that only near steps of size are compared
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_RATIO)).cast("int")
    chosen = written(chosen.select("id", "doc_id", "lo", "copies", F.col("root").alias("component"), step.alias("step")), "chosen")
    sizes = written(chosen.groupBy("component", "step").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")), "sizes")
    # sets of a component that fits a block share one, whatever their sizes
    whole = written(sizes.groupBy("component").agg(F.sum("size").alias("all")).where(F.col("all") <= BLOCK), "small-components")
    near = math.ceil(-math.log(threshold) / math.log(SIZE_RATIO) - 1e-9)
    split = sizes.join(whole, "component", "left_anti")
    other = split.select("component", F.col("step").alias("to"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to_block"))
    meets = split.join(other, "component").where(F.abs(F.col("to") - F.col("step")) <= near)
    meets = written(meets.groupBy("component", "step", "size", "blocks").agg(F.collect_list(F.struct("to", "to_block")).alias("with")), "meetings")
    texts = docs.select(F.col("doc_id").cast("long").alias("of"), "text")
    # texts are shuffled at every size of the other side, which grows with the documents
    with_text = chosen.hint("merge").join(texts, chosen["doc_id"].eqNullSafe(texts["of"])).select(*KEPT, "lo", "text")
    with_sets = written(with_text.mapInArrow(_shingles_of(width), "id long, component long, copies long, step int, shingles binary").dropDuplicates(["id"]), "shingles")
    # a component of one block shares its task with others, so that a task has about BLOCK sets
    few = max(1, (whole.agg(F.sum("all")).first()[0] or 0) // BLOCK)
    one = with_sets.join(whole, "component", "left_semi").withColumns({"block": F.lit("0"), "low": F.lit("0"), "high": F.lit("0"), "task": -1 - F.pmod(F.xxhash64("component"), F.lit(few))})
    many = join_counted(with_sets, meets, ["component", "step"], "size")
    block = lambda a, b: F.concat_ws(":", F.lpad(a.cast("string"), 9, "0"), F.lpad(b.cast("string"), 9, "0"))
    many = many.withColumn("block", block(F.col("step"), F.pmod(F.xxhash64("id"), F.col("blocks"))))
    many = many.withColumn("x", F.explode("with")).withColumn("other", block(F.col("x.to"), F.col("x.to_block")))
    many = many.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other"), "task": F.col("component")})
    tasks = one.unionByName(many.select(*one.columns)).select("id", "component", "copies", "block", "shingles", "low", "high", "task")
    found = written(tasks.groupBy("task", "low", "high").applyInPandas(_compare(threshold), LINKS), "links-found")
    dropped(with_sets, meets, sizes, whole, chosen, rough)
    classes = components(found.where("other >= 0").select(F.greatest("id", "other").alias("u"), F.least("id", "other").alias("v")))
    counts = found.where("other < 0").groupBy("id").agg(F.sum("links").alias("links"))
    per_set = sets.join(counts, "id", "left").join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
    per_set = written(per_set.select("hi", "lo", "n", F.coalesce("root", "id").alias("root"), "least_doc", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "per-set")
    dropped(sets, reps, found)
    return all_docs.select("doc_id", "n", "hi", "lo"), per_set


def join(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Every document with class_id (the least doc_id of its class) and n_links (the documents at or over the threshold, copies included)."""
    rows, per_set = _classes(docs, width, threshold, recall)
    least = per_set.groupBy("root").agg(F.min("least_doc").alias("class_id"), F.count("*").alias("sets"))
    per_set = written(join_counted(per_set, written(least, "class-ids"), ["root"], "sets").select("hi", "lo", "n", "class_id", "n_links", "copies"), "class-sets")
    alone = rows.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    linked = join_counted(rows.where("n > 0"), per_set, ["hi", "lo", "n"], "copies")
    return linked.select("doc_id", "class_id", "n_links").unionByName(alone)


def _with_fingerprint(docs: DataFrame, width: int, names: dict[str, str]) -> DataFrame:
    """docs and, under names, the size and fingerprint of the shingles of text."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")

    def run(batches):
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                values, first = textops.shingles(texts, width)
                hi, lo = fingerprints(values, first)
                part = batch.column("doc").slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([part, pa.array(np.diff(first), pa.int64()), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["doc", *(names[c] for c in ("n", "hi", "lo"))])

    return out.mapInArrow(run, T.StructType([out.schema["doc"], *(T.StructField(names[c], T.LongType()) for c in ("n", "hi", "lo"))]))


def representatives(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs, in their own columns, with one row of each class: of its sets the one with the least doc_id (a null comes last), of that set's rows one with that doc_id.

    A document without words is a class of its own and stays.  Rows are told apart by doc_id and set, so that a doc_id
    may stand for several texts, and many rows may have none.
    """
    rows, per_set = _classes(docs, width, threshold, recall)
    place = F.struct(F.col("least_doc").isNull().alias("unknown"), "least_doc", "hi", "lo", "n")
    best = written(per_set.groupBy("root").agg(F.min(place).alias("x"), F.count("*").alias("sets")), "best-sets")
    chosen = best.select(F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo"), F.col("x.n").alias("n"), F.lit(True).alias("is_best"))
    kept = written(per_set.join(chosen, ["hi", "lo", "n"], "left").select("hi", "lo", "n", "least_doc", "copies", F.coalesce("is_best", F.lit(False)).alias("is_best")), "kept-sets")
    judged = join_counted(rows.where("n > 0"), kept, ["hi", "lo", "n"], "copies")
    judged = judged.select("doc_id", (F.col("is_best") & F.col("doc_id").eqNullSafe(F.col("least_doc"))).alias("kept"))
    judged = judged.unionByName(rows.where("n = 0").select("doc_id", F.lit(True).alias("kept")))
    per_doc = written(judged.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")), "kept-documents")
    # nearly every doc_id has one row, which goes or stays; the rows of the others, and those without doc_id, are looked at one by one
    key = "__jaccard_doc"
    several = per_doc.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias(key))
    gone = per_doc.where("(rows = 1 and not kept and doc_id is not null) or rows > 1").select(F.col("doc_id").alias(key))
    plain = docs.where("doc_id is not null").join(gone.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left_anti")
    if not several.head(1):
        return plain
    names = {c: f"__jaccard_{c}" for c in ("n", "hi", "lo")}
    unsure = docs.where("doc_id is not null").join(several.hint("merge"), F.col("doc_id").cast("long") == F.col(key), "left_semi").unionByName(docs.where("doc_id is null"))
    printed = written(_with_fingerprint(unsure, width, names), "looked-at")
    best = kept.where("is_best").select(*[F.col(c).alias(f"__best_{c}") for c in names], F.col("least_doc").alias(key))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col(key))
    for c in names:
        same = same & (F.col(names[c]) == F.col(f"__best_{c}"))
    right = printed.where(F.col(names["n"]) > 0).join(best.hint("merge"), same, "left_semi")
    # equal rows fold before the shuffle
    single = right.groupBy(*names.values()).agg(F.min_by("doc", F.xxhash64("doc.text")).alias("doc")).select("doc.*")
    wordless = printed.where(F.col(names["n"]) == 0).select("doc.*")
    return plain.unionByName(single).unionByName(wordless)
