"""Benchmark decontamination with a broadcast hash set of test n-grams.

The benchmark's normalised 13-word windows become a sorted array of 64-bit
hashes; training texts are scanned in Arrow batches, candidate windows are those
whose words all occur in the benchmark and whose hash is in the set, and each
candidate is verified on its words.

A benchmark of at most BROADCAST_BYTES of text, which is checked first, is
broadcast as it is, and every worker process makes the set from it once.  Texts
then pass through one scan and are never shuffled.  For a larger one, a Bloom
filter of bounded size stands for the set: a text's candidates, few of them
false, are joined with the table of windows, and verified there.  Verdicts belong
to texts by a 128-bit hash, so that copies share one.

Defined cases: a null text or a text without words has no words, no hits and
isn't contaminated; an item without words has no window; equal items are all
counted by their ids, an item without id is counted as the string 'null';
repeated documents are judged each by itself; a very long text is a chunk of its
own and is read whole; an empty benchmark hits nothing; other columns of
documents don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import join_counted, written
from . import textops

WINDOW = 13
#: Bytes of benchmark text up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
#: Bits of the Bloom filter for a larger benchmark, at most, and of each window in it.
BLOOM_BITS, BLOOM_HASHES = 1 << 30, 3

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Windows(NamedTuple):
    """Windows of one width, sorted by hash."""

    width: int
    hashes: np.ndarray
    at: np.ndarray  # the first word of an occurrence
    first: np.ndarray  # where each window's items begin in items
    items: np.ndarray


class Block(NamedTuple):
    """All windows of a benchmark's items."""

    seen: np.ndarray  # whether the low 20 bits of a word's hash occur
    windows: list[Windows]
    names: list[str]
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def words(self, at: int, width: int) -> bytes:
        return _joined(self.data, self.starts, self.ends, at, width)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, width: int) -> bytes:
    return b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(at, at + width))


def _low(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(0xFFFFF)).astype(np.int64)


def _gram(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the width words from each place."""
    value = words[at].copy()
    for j in range(1, width):
        value *= textops._Q
        value += words[at + j]
    return textops.mix(value)


def _places(first: np.ndarray, window: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(width, first words, items) of the windows: window words each, or an item's all if it has fewer."""
    n = np.diff(first)
    out = []
    for width in np.unique(np.minimum(n[n > 0], window)).tolist():
        items = np.flatnonzero(n >= window if width == window else n == width)
        count = n[items] - width + 1
        owner = np.repeat(items, count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
        out.append((width, at, owner))
    return out


def block_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> Block:
    """The windows of (item_id, text) rows."""
    names = ["null" if i is None else str(i) for i, _ in items]
    seen = np.zeros(1 << 20, bool)
    texts = next(textops.chunks(pa.array([t or "" for _, t in items], pa.string()), most=1 << 62), None)
    if texts is None:
        return Block(seen, [], names, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    data, starts, ends, first = textops.lower_words(texts)
    words = textops.span_hashes(data, starts, ends)
    seen[_low(words)] = True
    out = []
    for width, at, owner in _places(first, window):
        one, two = _gram(words, at, width), _gram(words ^ textops._Q, at, width)  # two: windows of one hash are told apart
        order = np.lexsort((owner, two, one))
        one, two, at, owner = one[order], two[order], at[order], owner[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        again = np.zeros(len(one), bool)
        again[1:] = ~new[1:] & (owner[1:] == owner[:-1])
        begin = np.flatnonzero(new[~again])
        out.append(Windows(width, one[new], at[new], np.append(begin, (~again).sum()), owner[~again]))
    return Block(seen, out, names, data, starts, ends)


_blocks: dict[str, Block] = {}


def _block(key: str, rows: list, window: int) -> Block:
    """This process's block of a broadcast benchmark; another one's is let go."""
    if key not in _blocks:
        _blocks.clear()
        _blocks[key] = block_of(rows, window)
    return _blocks[key]


def _likely(words: np.ndarray, last: np.ndarray, seen: np.ndarray, width: int) -> np.ndarray:
    """Places from which width words of one text all occur in the benchmark."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    total = np.zeros(len(words) + 1, np.int64)
    np.cumsum(seen[_low(words)], out=total[1:])
    at = np.flatnonzero(total[width:] - total[:-width] == width)
    return at[at + width <= last[at]]


def scan(texts: textops.Texts, block: Block) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
    """The first word of each text, which words are hit, and the items (their numbers) found in a text."""
    data, starts, ends, first = textops.lower_words(texts)
    words = textops.span_hashes(data, starts, ends)
    hit, found = np.zeros(len(words), bool), {}
    last = np.repeat(first[1:], np.diff(first))  # the end of the text that a word is in
    for w in block.windows:
        at = _likely(words, last, block.seen, w.width)
        if not len(at):
            continue
        value = _gram(words, at, w.width)
        place = np.minimum(np.searchsorted(w.hashes, value), len(w.hashes) - 1)
        for k, p in zip(at[ok := w.hashes[place] == value].tolist(), place[ok].tolist()):
            own, hash_of = _joined(data, starts, ends, k, w.width), w.hashes[p]
            while p < len(w.hashes) and w.hashes[p] == hash_of:
                if own == block.words(int(w.at[p]), w.width):
                    hit[k : k + w.width] = True
                    found.setdefault(int(np.searchsorted(first, k, "right")) - 1, set()).update(w.items[w.first[p] : w.first[p + 1]].tolist())
                    break
                p += 1
    return first, hit, found


def _verdicts(n_words: np.ndarray, n_hit: np.ndarray, items: list) -> list[pa.Array]:
    joined = [",".join(sorted(x)) if x else "" for x in items]
    none = hashlib.sha256(b"").hexdigest()
    return [
        pa.array(n_words.astype(np.int64)),
        pa.array(n_hit.astype(np.int64)),
        pa.array([len(x) if x else 0 for x in items], pa.int64()),
        pa.array([hashlib.sha256(x.encode()).hexdigest() if x else none for x in joined]),
        pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
    ]


def _small(benchmark: DataFrame, most: int) -> list | None:
    """The benchmark's rows, or None if they have more than most bytes of text."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    return [(r[0], r[1]) for r in benchmark.select("item_id", "text").collect()] if size <= most else None


def scan_documents(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, window: int = WINDOW) -> DataFrame:
    """One row for each document, in RESULT's columns."""
    rows = _small(benchmark, broadcast_bytes)
    if rows is None:
        return _scan_by_join(docs, benchmark, window)
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches):
        block = _block(key, shared.value, window)
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                first, hit, found = scan(texts, block)
                total = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=total[1:])
                items = [{block.names[x] for x in found.get(i, ())} for i in range(len(texts))]
                out = _verdicts(np.diff(first), total[first[1:]] - total[first[:-1]], items)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(texts.first, len(texts)), *out], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


# The way for a benchmark of any size: a Bloom filter, then a join


class Bloom(NamedTuple):
    seen: np.ndarray
    widths: list[int]
    bits: np.ndarray  # bytes

    def has(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for at in _bits(hashes, len(self.bits) * 8):
            ok &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return ok


def _bits(hashes: np.ndarray, n: int) -> list[np.ndarray]:
    return [(textops.mix(hashes + np.uint64((k + 1) * int(textops._Q) % (1 << 64))) & np.uint64(n - 1)).astype(np.int64) for k in range(BLOOM_HASHES)]


def _table_of_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """width, hash, words (of one window, joined) and item, in a table."""

    def run(batches):
        for batch in batches:
            rows = list(zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()))
            texts = next(textops.chunks(batch.column("text"), most=1 << 62), None)
            if texts is None:
                continue
            data, starts, ends, first = textops.lower_words(texts)
            words = textops.span_hashes(data, starts, ends)
            for width, at, owner in _places(first, window):
                joined = pa.array([_joined(data, starts, ends, k, width) for k in at.tolist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), width, np.int32)), pa.array(_gram(words, at, width).view(np.int64)), joined, pa.array([rows[i][0] for i in owner.tolist()], pa.string())], ["width", "hash", "words", "item"])

    slim = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    return written(slim.mapInArrow(run, "width int, hash long, words binary, item string").distinct(), "benchmark-windows")


def _bloom(windows: DataFrame) -> Bloom:
    """Of bounded size, whatever the benchmark's; the driver holds it and one part of the hashes at a time."""
    n = max(1, windows.count())
    size = min(BLOOM_BITS, 1 << max(10, (16 * n - 1).bit_length()))
    bits, seen = np.zeros(size // 8, np.uint8), np.zeros(1 << 20, bool)
    held: list[int] = []

    def put() -> None:
        for at in _bits(np.array(held, np.int64).view(np.uint64), size):
            np.bitwise_or.at(bits, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))
        held.clear()

    for r in windows.select("hash").distinct().toLocalIterator():
        held.append(r[0])
        if len(held) == 1 << 20:
            put()
    put()
    seen[:] = True  # a large benchmark has most words' bits
    return Bloom(seen, sorted(r[0] for r in windows.select("width").distinct().collect()), bits)


#: A window of the benchmark meets a text's candidates in so many places.
SALTS = 16


def _verdicts_by_join(docs: DataFrame, benchmark: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Every document's doc_id, h1, h2 (its text's hash), n_words and n_cands; and the verdicts of texts: h1, h2, copies, n_hit, items, hits, contaminated."""
    windows = _table_of_windows(benchmark, window)
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(windows))
    schema = "doc_id long, h1 long, h2 long, n_words long, cands array<struct<at:int,width:int,hash:bigint,words:binary>>"

    def run(batches):
        bloom = shared.value
        kind = pa.list_(pa.struct([("at", pa.int32()), ("width", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))
        for batch in batches:
            for texts in textops.chunks(batch.column("text")):
                data, starts, ends, first = textops.lower_words(texts)
                words = textops.span_hashes(data, starts, ends)
                last = np.repeat(first[1:], np.diff(first))
                cands: list[list] = [[] for _ in range(len(texts))]
                for width in bloom.widths:
                    at = _likely(words, last, bloom.seen, width)
                    value = _gram(words, at, width)
                    ok = bloom.has(value)
                    for k, v in zip(at[ok].tolist(), value[ok].view(np.int64).tolist()):
                        i = int(np.searchsorted(first, k, "right")) - 1
                        cands[i].append({"at": k - int(first[i]), "width": width, "hash": v, "words": _joined(data, starts, ends, k, width)})
                part = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h1"), part.column("h2"), pa.array(np.diff(first), pa.int64()), pa.array(cands, kind)], ["doc_id", "h1", "h2", "n_words", "cands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(17), "text").alias("h2"), "text")
    table = written(slim.mapInArrow(run, schema), "candidate-windows")
    some = table.where(F.size("cands") > 0)
    cands = some.select("h1", "h2", "n_words", F.explode("cands").alias("x")).select("h1", "h2", "n_words", "x.*").distinct()
    cands = cands.withColumn("salt", F.pmod(F.xxhash64("h1", "at"), F.lit(SALTS)).cast("int"))
    of_items = windows.groupBy("width", "hash", "words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    of_items = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = cands.join(of_items.hint("shuffle_merge"), ["width", "hash", "words", "salt"])
    per_text = met.groupBy("h1", "h2", "n_words").agg(F.sort_array(F.collect_set(F.struct("at", "width"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("aggregate(hits, named_struct('n', 0L, 'to', 0), (s, x) -> named_struct('n', s.n + greatest(0, x.at + x.width - greatest(s.to, x.at)), 'to', greatest(s.to, x.at + x.width)), s -> s.n)")
    per_text = per_text.withColumn("n_hit", covered).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    copies = some.groupBy("h1", "h2").agg(F.count("*").alias("copies"))
    return table.withColumn("n_cands", F.size("cands")).drop("cands"), written(per_text.drop("n_words").join(copies, ["h1", "h2"]), "verdicts")


def _scan_by_join(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    table, verdicts = _verdicts_by_join(docs, benchmark, window)
    none = table.where("n_cands = 0").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    some = join_counted(table.where("n_cands > 0"), verdicts, ["h1", "h2"], "copies", "left")
    some = some.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = none.unionByName(some)
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated.alias("contaminated"))


def _without(texts: textops.Texts, i: int, first: np.ndarray, hit: np.ndarray) -> str:
    """Text i without its hit words and what stands between two of them."""
    starts, ends = textops.spans(texts, textops.ALNUM)
    keep = np.ones(texts.offsets[i + 1] - texts.offsets[i], bool)
    for k in range(first[i], first[i + 1]):
        if hit[k]:
            after = k + 1 < first[i + 1] and hit[k + 1]
            keep[starts[k] - texts.offsets[i] : (starts[k + 1] if after else ends[k]) - texts.offsets[i]] = False
    return np.frombuffer(texts.bytes_of(i), np.uint8)[keep].tobytes().decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", broadcast_bytes: int = BROADCAST_BYTES, window: int = WINDOW) -> DataFrame:
    """Documents without the contaminated ones (remove='documents'), or with hit passages cut out of those (remove='spans').

    Columns of documents stay as they are; a document that isn't contaminated keeps its text.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove: {remove!r} is neither 'documents' nor 'spans'")
    rows = _small(benchmark, broadcast_bytes)
    if rows is None:
        return _decontaminated_by_join(docs, benchmark, remove, window)
    shared, key = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

    at, numbered = docs.columns.index("text"), _numbered(docs)

    def run(batches):
        block = _block(key, shared.value, window)
        for batch in batches:
            for texts in textops.chunks(batch.column(at)):
                first, hit, _ = scan(texts, block)
                total = np.zeros(len(hit) + 1, np.int64)
                np.cumsum(hit, out=total[1:])
                n_hit = total[first[1:]] - total[first[:-1]]
                bad = (n_hit > 0) & (20 * n_hit >= np.diff(first))
                part = batch.slice(texts.first, len(texts))
                if remove == "documents":
                    part = part.filter(pa.array(~bad))
                elif bad.any():
                    text = [_without(texts, i, first, hit) if bad[i] else x for i, x in enumerate(part.column(at).to_pylist())]
                    part = part.set_column(at, batch.schema.field(at), pa.array(text, batch.schema.field(at).type))
                yield part

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


def _numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by number: mapInArrow takes no names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def _decontaminated_by_join(docs: DataFrame, benchmark: DataFrame, remove: str, window: int) -> DataFrame:
    _, verdicts = _verdicts_by_join(docs, benchmark, window)
    bad = verdicts.where("contaminated").select(F.col("h1").alias("__bench_1"), F.col("h2").alias("__bench_2"), F.col("hits").alias("__bench_hits")).hint("merge")
    same = (F.xxhash64("text") == F.col("__bench_1")) & (F.xxhash64(F.lit(17), "text") == F.col("__bench_2"))
    if remove == "documents":
        return docs.join(bad, same, "left_anti")
    at, hits = docs.columns.index("text"), _numbered(docs.join(bad, same, "left").drop("__bench_1", "__bench_2"))

    def run(batches):
        for batch in batches:
            own = pa.RecordBatch.from_arrays([batch.column(k) for k in range(batch.num_columns - 1)], schema=pa.schema(list(batch.schema)[:-1]))
            if batch.column(batch.num_columns - 1).null_count < batch.num_rows:
                spans, text = batch.column(batch.num_columns - 1).to_pylist(), own.column(at).to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        texts = next(textops.chunks(pa.array([text[i]], pa.string())))
                        first = textops.lower_words(texts)[3]
                        hit = np.zeros(int(first[1]), bool)
                        for x in found:
                            hit[x["at"] : x["at"] + x["width"]] = True
                        text[i] = _without(texts, 0, first, hit)
                own = own.set_column(at, own.schema.field(at), pa.array(text, own.schema.field(at).type))
            yield own

    return hits.mapInArrow(run, T.StructType(hits.schema.fields[:-1])).toDF(*docs.columns)
