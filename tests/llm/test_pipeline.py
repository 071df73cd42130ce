"""Each stage of the pipeline against brute force on its own input, and the whole run."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewright.llm import quality

from .test_operators import ITEMS, LINES, alnum, prose, shingle_set, texts, windows_of, words, ws


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("pipeline")
    long = [t for t in texts() if t is None or len(ws(t)) > 20]
    more = [" ".join(words(90)) for _ in range(10)]
    long += more + [m.rsplit(" ", 2)[0] + " other end" for m in more[:4]] + [prose(70) + "\n" + LINES for _ in range(3)]
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(long)]
    rows.append(rows[4])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string").repartition(2).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def count(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    good = corpus_pipeline.quality_rules(spark, docs, sf_dir).cache()
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert good.columns == columns and count(good, "doc_id") == count(judged.where("kept"), "doc_id")

    lines = corpus_pipeline.line_removal(spark, good, sf_dir).cache()
    assert lines.columns == columns
    seen, want = set(), {}
    for i, t in sorted({(r["doc_id"], r["text"]) for r in good.collect()}):
        own = [(p, x) for p, x in enumerate(t.split("\n")) if ws(x)]
        gone = set()
        for _, run, _ in windows_of(own):
            key = tuple(x for _, x in run)
            if key in seen:
                gone.update(p for p, _ in run)
            seen.add(key)
        left = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
        if ws(left):
            want[i] = left
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == want
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    near = corpus_pipeline.near_duplicates(spark, lines, sf_dir).cache()
    sets = sorted((i, shingle_set(t)) for i, t in want.items())
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if j < i and a and b and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert near.columns == columns and sorted(r["doc_id"] for r in near.collect()) == sorted(set(root.values()))
    assert len(set(root.values())) < len(root)

    clean = corpus_pipeline.benchmark_passages(spark, near, sf_dir).cache()

    def contaminated(text):
        w, hit = alnum(text), set()
        for _, item in ITEMS:
            g = alnum(item)
            n = min(13, len(g))
            for k in range(len(w) - n + 1) if n else ():
                if any(w[k : k + n] == g[j : j + n] for j in range(len(g) - n + 1)):
                    hit.update(range(k, k + n))
        return hit and 20 * len(hit) >= len(w)

    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(r["doc_id"] for r in near.collect() if not contaminated(r["text"]))
    packed = corpus_pipeline.packed(spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in clean.collect()}


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    used = collections.Counter()
    for r in rows:
        used[r["sequence_id"]] += r["length"]
    assert rows and max(used.values()) <= 2048
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
