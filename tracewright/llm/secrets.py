"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

An owner is a document's source, and a repository is a source's documents of one
lang: the tables name no finer ones.  Fixed patterns give base spans of three
kinds.  A wider pattern gives further candidates: opaque tokens of 20 characters
or more, however long, that mix cases and digits.  Every candidate's value is
hashed, and the corpus counts in how many distinct repositories and by how many
distinct owners it occurs, folding repeated values before each shuffle.  A value
of EXAMPLE_OWNERS owners, or of EXAMPLE_REPOS repositories if their owners are
fewer, is a widely copied example; one below both that looks random is live.
Live opaque candidates that overlap no base span are added to the spans; base
spans always stay.

Positions are sums over what the pattern leaves between its matches and the
matches, taken with a window over a document's own matches, only for documents
that have any.  Verdicts reach the spans by a join on counted keys, in which a
very common value is broadcast.

Defined cases: a null text is empty and has no spans; a null source or lang
counts as one further owner or repository, and so does a table without such a
column; repeated documents are judged each by itself, and do not add owners; a
very long text is matched whole within its row; an empty table gives no rows;
other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import join_counted, written

# Kinds in the order of the report, their patterns and the group that holds the secret.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: What an opaque token holds, anywhere.
MIXED = ("[0-9]", "[A-Z]", "[a-z]")
KINDS = {"assign": (ASSIGN, 1), "access": (ACCESS, 0), "hex": (HEX, 0), "opaque": (OPAQUE, 0)}

MIN_ASSIGNED = 6
#: Distinct owners, or repositories, from which a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6
#: A value with fewer distinct characters or fewer characters doesn't look live.
LIVE_CHARACTERS, LIVE_LENGTH = 8, 12


def _matches(pattern: str, group: int) -> Column:
    """For each match of text: the length of what is before it, since the last match, its own length and the secret."""
    text = F.col("text")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    both = F.zip_with(whole, value, lambda m, v: F.struct(F.length(m).alias("own"), v.alias("value")))
    zipped = F.zip_with(gaps, both, lambda g, x: F.struct(g.alias("gap"), x["own"].alias("own"), x["value"].alias("value")))  # the last gap has no match
    return F.when(text.rlike(pattern), zipped)


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All documents (row, doc_id), and their candidates: row, k (kind), start, end, h1 and h2 (the value's hash), owner, repo, looks (whether it looks live)."""
    owner, lang = (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string") for c in ("source", "lang"))
    scan = docs.select(F.col("doc_id").cast("long").alias("doc_id"), owner.alias("owner"), F.xxhash64(owner, lang).alias("repo"), "text")
    for k, (pattern, group) in enumerate(KINDS.values()):
        scan = scan.withColumn(f"m{k}", _matches(pattern, group))
    slim = written(scan.drop("text").withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    found = None
    for k in range(len(KINDS)):
        one = slim.where(F.col(f"m{k}").isNotNull()).select("row", "owner", "repo", F.lit(k).alias("k"), F.posexplode(f"m{k}").alias("pos", "x")).where("x.own is not null")
        found = one if found is None else found.unionByName(one)
    upto = Window.partitionBy("row", "k").orderBy("pos")
    end = F.sum(F.col("x.gap") + F.col("x.own")).over(upto)
    value = F.col("x.value")
    looks = (F.length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
    found = found.withColumn("end", end).select("row", "owner", "repo", "k", (F.col("end") - F.col("x.own")).alias("start"), "end", F.xxhash64(value).alias("h1"), F.xxhash64(F.lit(17), value).alias("h2"), value.alias("value"), looks.alias("looks"))
    mixed = F.lit(True)
    for pattern in MIXED:
        mixed = mixed & F.col("value").rlike(pattern)
    right = F.when(F.col("k") == 0, F.length("value") >= MIN_ASSIGNED).when(F.col("k") == 3, mixed).otherwise(True)
    return slim.select("row", "doc_id"), found.where(right).drop("value")


def ownership(found: DataFrame) -> DataFrame:
    """h1, h2, owners, repos and uses of each candidate value; each step folds equal rows before the next shuffle."""
    by_row = found.groupBy("h1", "h2", "owner", "repo").agg(F.count("*").alias("n"))
    by_owner = by_row.groupBy("h1", "h2", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("h1", "h2").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("uses"))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"], x["end"])), ",")


def _free(judged: DataFrame) -> DataFrame:
    """judged with free: whether a span overlaps no base span, from the furthest end of those that begin before it and the next one's begin."""
    base = F.col("k") < 3
    before = Window.partitionBy("row").orderBy("start", "k", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("k"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    reach, following = F.max(F.when(base, F.col("end"))).over(before), F.min(F.when(base, F.col("start"))).over(after)
    rows = judged.withColumns({"__reach": reach, "__next": following})
    free = (F.coalesce("__reach", F.lit(0)) <= F.col("start")) & (F.coalesce("__next", F.col("end")) >= F.col("end"))
    return rows.withColumn("free", free).drop("__reach", "__next")


def find(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; and n_added, n_live and n_example, added spans and base or added ones of either verdict, for every document."""
    rows, found = candidates(docs)
    found = written(found, "secret-spans")
    judged = join_counted(found, written(ownership(found), "secret-owners"), ["h1", "h2"], "uses")
    example = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    judged = judged.select("row", "k", "start", "end", (F.col("looks") & ~example).alias("live"), example.alias("example"))
    kept = _free(judged).where((F.col("k") < 3) | (F.col("live") & F.col("free")))
    mine = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end"))).alias("all"), F.count_if("live").alias("n_live"), F.count_if("example").alias("n_example"))
    mine = mine.withColumn("base", F.filter("all", lambda x: x["k"] < 3))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    mine = mine.select(
        "row", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
        (F.size("all") - F.size("base")).cast("long").alias("n_added"), "n_live", "n_example",
    )
    out = rows.join(mine, "row", "left").drop("row")
    numbers = {c: 0 for c in ("n_assign", "n_access", "n_hex", "n_added", "n_live", "n_example")}
    return out.na.fill(numbers).withColumns({"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))})
