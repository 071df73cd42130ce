"""Quality rules with a hashed n-gram likelihood ratio, in DataFrame operations only.

N-grams of words, of each order, are hashed into a fixed number of buckets of
their own.  Two multinomials of each order are counted over all documents: one
over the raw corpus, one over the documents that labels trust, drawn towards the
raw one by a prior so that rare buckets weigh little in a small corpus.  A
document's score is the sum over the orders of the mean, over its n-grams of the
order, of the log-likelihood ratio of the two; it is kept if no base rule fails
it and the score reaches a fixed threshold.  Each order has a mean of its own,
so that the many different pairs, whose ratios say little one by one, don't thin
out what the words say.  The weights are one array of BUCKETS doubles for each
order, whatever the corpus; documents never leave their partitions.

Defined cases: a null text has no words and fails the base rule on length; an
order of which a document has no n-gram adds 0; labels with nulls or repeated
rows count once for a doc_id, and trust it if any of its rows does; without a
trusted word all weights are 0, so that only base rules decide; rows repeated in
documents are judged each by itself; a very long text is hashed whole within its
row; an empty table gives no rows; keep_good() carries other columns along,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import once

BUCKETS = 1 << 14
ORDERS = (1, 2)
#: Added to a bucket's trusted count and to the count that the raw corpus lets expect.
PRIOR = 20.0
#: Clean text scores near 0, since most of the raw corpus is clean; text with marks and cases that trusted text lacks scores far below.
#: Of labelled documents held out from the fit on sf0.1, good ones that no base rule fails score -0.055 or more and bad ones -0.151 or less.
THRESHOLD = -0.11
#: Trusted doc_ids up to which they are broadcast; beyond, Spark joins them by a shuffle.
BROADCAST_ROWS = 2_000_000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SPACES = r"[\x20\x09-\x0D]+"
_SOLID = r"[^\x20\x09-\x0D]"

RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _words() -> Column:
    """Hashes of the words of text, in order."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), _SPACES), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _codes(buckets: int, orders: tuple[int, ...]) -> Column:
    """Buckets of all n-grams of the orders, order after order, from column __w; order k's buckets begin at k * buckets."""
    each = []
    for k, n in enumerate(orders):
        if n == 1:
            each.append(f"transform(__w, w -> int({k * buckets} + pmod(w, {buckets})))")
            continue
        gram = "xxhash64(" + ", ".join(f"__w[i + {j}]" for j in range(n)) + ")"
        each.append(f"if(size(__w) < {n}, array(), transform(sequence(0, size(__w) - {n}), i -> int({k * buckets} + pmod({gram}, {buckets}))))")
    return F.expr(f"concat({', '.join(each)})" if len(each) > 1 else each[0])


def weights(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> list[float]:
    """The log-likelihood ratio of each bucket, order after order."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("__trusted")).distinct()
    if trusted.count() <= BROADCAST_ROWS:
        trusted = F.broadcast(trusted)
    df = docs.select(F.col("doc_id").cast("long").alias("__id"), once(_words()).alias("__w"))
    df = df.select("__id", once(_codes(buckets, orders)).alias("codes"))
    df = df.join(trusted, F.col("__id") == F.col("__trusted"), "left").select(F.col("__trusted").isNotNull().cast("int").alias("t"), F.explode_outer("codes").alias("code")).where("code is not null")  # outer: else Spark infers a filter and hashes all words again for it
    raw, target = [0] * buckets * len(orders), [0] * buckets * len(orders)
    for code, n, t in df.groupBy("code").agg(F.count("*"), F.sum("t")).collect():  # at most buckets rows for each order
        raw[code], target[code] = n, t
    out = []
    for k in range(len(orders)):
        r_all, t_all = raw[k * buckets : (k + 1) * buckets], target[k * buckets : (k + 1) * buckets]
        share = sum(t_all) / max(1, sum(r_all))
        out += [math.log((t + PRIOR) / (r * share + PRIOR)) if share else 0.0 for r, t in zip(r_all, t_all)]
    return out


def features(docs: DataFrame) -> DataFrame:
    """docs with the columns of the base rules in front of their own, and __w."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(_SOLID))
    df = docs.withColumn("__w", once(_words()))
    df = df.withColumn("__g", once(F.expr("if(size(__w) < 3, array(), transform(sequence(0, size(__w) - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])))")))
    # windows are sorted by hash and place, those with an equal neighbour repeat, and each covers three words from its place, less what the next one covers
    # only texts with a repeated window pay for the sort by hash and place
    df = df.withColumn("__s", once(F.expr("if(size(array_distinct(__g)) = size(__g), array(), sort_array(transform(__g, (x, i) -> struct(x as h, i as i))))")))
    df = df.withColumn("__r", once(F.expr("sort_array(filter(transform(__s, (x, i) -> if(x.h = get(__s, i + 1).h or x.h = get(__s, i - 1).h, x.i, null)), y -> y is not null))")))
    n_repeat = F.expr("if(size(__r) = 0, 0L, 3L + aggregate(zip_with(slice(__r, 2, size(__r)), slice(__r, 1, size(__r) - 1), (a, b) -> least(3, a - b)), 0L, (s, x) -> s + x))")
    return df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, _SPACES, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": n_repeat,
    }).drop("__g", "__s", "__r")


def _verdict(docs: DataFrame, table: Column, threshold: float, buckets: int, orders: tuple[int, ...]) -> DataFrame:
    df = features(docs).withColumn("__c", once(_codes(buckets, orders)))
    # codes stand order after order, and the n-grams of order n are n - 1 fewer than the words
    start = F.lit(0)
    score = F.lit(0.0)
    for n in orders:
        size = F.greatest(F.size("__w") - (n - 1), F.lit(0))
        total = F.aggregate(F.slice("__c", start + 1, size), F.lit(0.0), lambda s, c: s + F.get(table, c))
        score = score + F.when(size > 0, total / size).otherwise(F.lit(0.0))
        start = start + size
    score = F.round(score, 9)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    df = df.withColumns({"base_failed": failed, "score": score})
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def _table(docs: DataFrame, labels: DataFrame, buckets: int, orders: tuple[int, ...]) -> Column:
    """The weights as one literal array."""
    return F.split(F.lit(",".join(map(repr, weights(docs, labels, buckets, orders)))), ",").cast("array<double>")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """RESULT's columns and score for every document."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _verdict(own, _table(docs, labels, buckets, orders), threshold, buckets, orders).select(*RESULT, "score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """docs, in their own columns, without those that judge() doesn't keep."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), "text")
    return _verdict(own, _table(docs, labels, buckets, orders), threshold, buckets, orders).where("kept").select("__doc.*")
