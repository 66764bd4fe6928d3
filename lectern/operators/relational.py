"""Joins, windows and set operations over jobs, segments and chapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.partitioning import cut


def status_counts(segments: DataFrame, key: str = "job_id") -> DataFrame:
    """Segments of each status by key, aggregated before any join, so a key
    that holds a third of the rows leaves each task as one row."""
    of = lambda s: F.count_if(F.col("status") == s).alias(f"{s}_count")
    return segments.groupBy(key).agg(F.count("*").alias("segment_count"), *(of(s) for s in ("completed", "failed", "running", "pending", "stopped")))


def with_counts(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Jobs with the counts of their segments; zeros for a job without any."""
    counts = status_counts(segments).withColumnRenamed("job_id", "id")
    names = [c for c in counts.columns if c != "id"]
    joined = jobs.join(counts, "id", "left")
    return joined.select(*jobs.columns, *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in names))


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The row of highest ``by`` (unique within a key) of each key: the highest
    numbers are found by partial aggregation of slim rows, and the rows they name
    are kept by a semi join, so wide rows are neither sorted nor aggregated."""
    if set(df.columns) == {*keys, by}:
        return df.groupBy(*keys).agg(F.max(by).alias(by)).select(*df.columns)
    top = df.groupBy(*keys).agg(F.max(by).alias(by)).where(F.col(by).isNotNull())
    top = top.select(*(F.col(c).alias(f"_top_{c}") for c in (*keys, by)))
    same = F.lit(True)
    for c in (*keys, by):
        same = same & F.col(c).eqNullSafe(F.col(f"_top_{c}"))
    return df.join(top, same, "left_semi")


def without_newer(jobs: DataFrame, keys: list[str], by: str = "id") -> DataFrame:
    """Jobs that no newer job of the same keys supersedes.  A highest ``by`` of
    each key is joined instead of all pairs; rows with a NULL key have no rival."""
    top = jobs.where(_all_there(keys)).groupBy(*keys).agg(F.max(by).alias("_top"))
    joined = jobs.join(top, keys, "left")
    return joined.where(F.col("_top").isNull() | (F.col(by) >= F.col("_top"))).select(*jobs.columns)


def _all_there(keys: list[str]) -> Column:
    got = F.lit(True)
    for k in keys:
        got = got & F.col(k).isNotNull()
    return got


def all_done(segments: DataFrame, key: str, result: str) -> DataFrame:
    """Keys whose segments are all completed with a result."""
    ok = (F.col("status") == "completed") & F.col(result).isNotNull()
    return segments.groupBy(key).agg(F.bool_and(ok).alias("_ok")).where("_ok").select(key)


def next_in_queue(segments: DataFrame, key: str = "job_id", order: str = "segment_index", workers: int = 1) -> DataFrame:
    """The first ``workers`` pending segments of each key."""
    pending = segments.where("status = 'pending'")
    if workers == 1:
        return pending.groupBy(key).agg(F.min_by(F.struct(*segments.columns), order).alias("_r")).select("_r.*")
    w = Window.partitionBy(key).orderBy(order)
    return pending.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= workers).drop("_n")


def first_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def ordered_paths(*paths: Column) -> Column:
    """Paths of arrays or single ones in order, the first of equal ones, NULLs
    and empty ones dropped."""
    return F.array_distinct(F.filter(F.concat(*paths), lambda p: F.coalesce(p, F.lit("")) != ""))


def replaced(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with all rows of the keys in ``new`` replaced by its rows."""
    kept = existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns)
    return kept.unionByName(new)


def upserted(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` with the columns of ``changes`` set where its key is
    there (NULL sets NULL), and the rows of new keys, other columns NULL.  Keys
    are unique in ``changes``."""
    new = {c: f"_new_{c}" for c in changes.columns if c != key}
    there = changes.select(key, *(F.col(c).alias(n) for c, n in new.items()), F.lit(True).alias("_there"))
    joined = existing.join(there, key, "full")
    cols = [F.when(F.col("_there"), F.col(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in existing.columns]
    return joined.select(*cols)


def cascade_deleted(tables: dict[str, DataFrame], gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without the rows that hang on deleted ones.

    ``gone``: ids of the first link's parent; ``links``: (parent, its id, child,
    child's column), parents before children.
    """
    dead = {links[0][0]: gone.toDF("_id")}
    out = dict(tables)
    first = links[0][0]
    out[first] = out[first].join(dead[first], F.col(links[0][1]) == F.col("_id"), "left_anti")
    for parent, _, child, column in links:
        lost = tables[child].join(dead[parent], F.col(column) == F.col("_id"), "left_semi").select(F.col("id").alias("_id"))
        dead[child] = dead[child].union(lost) if child in dead else lost
        out[child] = out[child].join(dead[parent], F.col(column) == F.col("_id"), "left_anti")
    return out


def stale_rejected(results: DataFrame, chapters: DataFrame, revision: Column) -> DataFrame:
    """Results made for the revision that their chapter still has."""
    c = chapters.select(F.col("id").alias("chapter_id"), "content_revision")
    return results.withColumn("_rev", revision).join(c, "chapter_id").where(F.col("_rev") == F.col("content_revision")).select(*results.columns)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense numbers from 1 in an order that has no ties, made like a parallel
    prefix sum: rows are range-partitioned and numbered within their partition,
    to which the sizes of the partitions before are added (one row a partition
    is collected, none of the data).  The partitions are fixed by a checkpoint, as
    range bounds are sampled and may fall otherwise when rows are made again."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = parts.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    marked = cut(marked)
    sizes = {r["_p"]: r["n"] for r in marked.groupBy("_p").agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    if not before:
        return df.withColumn(out, F.lit(None).cast("bigint"))
    # One row a partition, whatever their number.
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_p int, _before bigint")
    joined = marked.join(F.broadcast(offsets), "_p")
    return joined.withColumn(out, F.col("_i") + F.col("_before") + 1).drop("_p", "_i", "_before")


#: Rows of a key that one task may sort.
HOT_ROWS = 200_000


def placed(df: DataFrame, keys: list[str], order: list[str], out: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Places from 1 of the rows of each key, like ``row_number`` but without a
    task that holds a key of more than ``hot_rows`` rows: these are numbered over all
    partitions, less the first number of their key.  Keys, which aren't NULL, and
    order together have no ties."""
    ordinary = lambda rows: rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > hot_rows).select(*keys)
    if hot.isEmpty():
        return ordinary(df)
    hot = cut(hot)  # no more keys than rows / hot_rows
    numbers = numbered(df.join(hot, keys, "left_semi"), [*keys, *order], "_n")
    first = numbers.groupBy(*keys).agg(F.min("_n").alias("_first"))
    spread_out = numbers.join(first, keys).withColumn(out, F.col("_n") - F.col("_first") + 1)
    return ordinary(df.join(hot, keys, "left_anti")).unionByName(spread_out.select(*df.columns, out))


def typed(df: DataFrame, schema: str) -> DataFrame:
    """Columns of ``df`` as the types of a schema; what doesn't fit is NULL."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    return df.select(*(F.col(n).try_cast(t).alias(n) for n, t in fields))


def stamped(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the time of the query in columns (created_at and updated_at)."""
    return df.withColumns({c: F.current_timestamp() for c in columns or ("created_at", "updated_at")})


def matched_rows(existing: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """One row ``matched``: how many rows a change by key would touch."""
    return existing.join(changes.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("matched"))


def edited_chapters(chapters: DataFrame, edits: DataFrame, made: dict[str, str]) -> DataFrame:
    """Chapters with the columns of ``edits`` (id, ...) set; an edited one gets the
    next ``content_revision`` and loses the columns ``made`` (name -> type) from its
    old text."""
    changes = edits.join(chapters.select("id", (F.col("content_revision") + 1).alias("content_revision")), "id")
    return upserted(chapters, changes.select("*", *(F.lit(None).cast(t).alias(c) for c, t in made.items())), "id")


def promoted(chapters: DataFrame, jobs: DataFrame, kind: str, revision: Column, results: DataFrame) -> DataFrame:
    """Chapters with the ``results`` (job_id, ...) of jobs of a kind that are still in
    force: made for the chapter's present revision, and no newer job of the kind."""
    own = jobs.withColumn("_rev", revision).where((F.col("kind") == kind) & F.col("chapter_id").isNotNull())
    newest = latest(own.select("id", "chapter_id", "_rev"), ["chapter_id"], "id")
    fresh = stale_rejected(newest, chapters, F.col("_rev"))
    changes = fresh.select(F.col("id").alias("job_id"), F.col("chapter_id").alias("_id")).join(results, "job_id").drop("job_id").withColumnRenamed("_id", "id")
    return upserted(chapters, changes, "id")


def replaced_cascading(tables: dict[str, DataFrame], new: DataFrame, key: str, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """The first link's parent with all rows of the keys in ``new`` replaced, and
    its children without what hung on the rows that went."""
    parent, column = links[0][0], links[0][1]
    gone = tables[parent].join(new.select(key).distinct(), key, "left_semi").select(column)
    left = cascade_deleted(tables, gone, links)
    return left | {parent: left[parent].select(*new.columns).unionByName(new)}
