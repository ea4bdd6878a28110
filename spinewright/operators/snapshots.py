"""Upserts into a stored snapshot: a table in hash buckets, of which a batch rewrites those it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What becomes of a key's stored row and its new one, both structs without the key; either may be null, not both.
Rule = Callable[[Column, Column], Column]


def hash_gated(payload: list[str], seen: list[str], hash_col: str = "payload_hash", first: str = "fetched_at") -> Rule:
    """A row that comes again takes the new ``seen`` fields, but its ``payload`` only if its hash has moved, and its ``first``
    sighting stays."""

    def rule(old: Column, new: Column) -> Column:
        moved = ~old[hash_col].eqNullSafe(new[hash_col])

        def field(name: str) -> Column:
            both = F.when(moved, new[name]).otherwise(old[name]) if name in payload else old[name] if name == first else new[name]
            return F.when(old.isNull(), new[name]).when(new.isNull(), old[name]).otherwise(both)

        return F.struct(*[field(c).alias(c) for c in (*payload, hash_col, first, *seen)])

    return rule


def only_up(value: str, ranks: dict[str, int]) -> Rule:
    """The stored row stays unless the new one's ``value`` ranks higher."""
    rank = lambda row: F.coalesce(*[F.when(row[value] == v, r) for v, r in ranks.items()], F.lit(-1))
    return lambda old, new: F.when(old.isNull(), new).when(new.isNull() | (rank(old) >= rank(new)), old).otherwise(new)


def decisions_kept(frozen: tuple[str, str] = ("rejected", "confirmed"), top: str = "attached") -> Rule:
    """Attachments ``status, reason, score, run``: a rejected or confirmed row is frozen, an attached one never moves down but is
    seen by the new run, everything else takes the new row."""

    def rule(old: Column, new: Column) -> Column:
        fixed = (old["status"] == frozen[0]) | (old["reason"] == frozen[1])
        keeps = (old["status"] == top) & (new["status"] != top)
        seen = F.struct(*[old[c].alias(c) for c in ("status", "reason", "score")], new["run"].alias("run"))
        return F.when(old.isNull(), new).when(new.isNull() | F.coalesce(fixed, F.lit(False)), old).when(F.coalesce(keeps, F.lit(False)), seen).otherwise(new)

    return rule


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # nothing is there yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they stand, without the store's own columns."""
    return spark.read.parquet(f"{path}/rows").drop("bucket", "batch_first", "batch_moved")


def tallies(spark: SparkSession, path: str) -> DataFrame:
    """``batch, inserted, changed, unchanged`` of every batch."""
    return spark.read.parquet(f"{path}/batches").groupBy("batch").agg(*[F.sum(c).alias(c) for c in ("inserted", "changed", "unchanged")])


def upsert_into(path: str, batch: DataFrame, key: list[str], batch_id: int, rule: Rule, buckets: int = 64) -> bool:
    """Bring a batch, a row a key, into the snapshot at ``path``; false if it was there already.

    A key's bucket follows from its hash, whatever batch it comes in. The buckets a batch touches are read (the others'
    folders are pruned), joined with it and put in place of the old ones by dynamic partition overwrite; the others keep
    their files. Its tally is then written under its number, and a batch that has one isn't applied again. If a run is
    lost between the two, the next attempt finds its own rows and gives the same snapshot and the same tally, as rows
    hold the batches that brought and last changed them and a rule applied twice changes nothing. Batches are applied one
    at a time; ``buckets`` is fixed for a snapshot, and should leave a bucket what one task can rewrite."""
    spark = batch.sparkSession
    done = _stored(spark, f"{path}/batches")
    if done is not None and not done.where(F.col("batch") == batch_id).isEmpty():
        return False
    fields = [c for c in batch.columns if c not in key]
    new = batch.select(*key, F.struct(*fields).alias("n"), _bucket(key, buckets).alias("bucket"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # numbers below ``buckets``
    if not touched:
        return True
    stored = _stored(spark, f"{path}/rows")
    if stored is None:
        kind = new.schema["n"].dataType
        old = new.limit(0).select(*key, "bucket", F.lit(None).cast(kind).alias("o"), F.lit(0).cast("long").alias("batch_first"), F.lit(0).cast("long").alias("batch_moved"))
    else:
        old = stored.where(F.col("bucket").isin(touched)).select(*key, "bucket", F.struct(*fields).alias("o"), "batch_first", "batch_moved")
    j = old.join(new, ["bucket", *key], "full").withColumn("r", rule(F.col("o"), F.col("n")))
    this = F.lit(batch_id).cast("long")
    # what the row was before this batch came, if an attempt at it was lost
    moved = F.when(F.col("o").isNull(), this).when(F.col("n").isNotNull() & ~_same(F.col("o"), F.col("r"), fields), this).otherwise(F.col("batch_moved"))
    out = j.select(*key, *[F.col(f"r.{c}").alias(c) for c in fields], F.coalesce("batch_first", this).alias("batch_first"), moved.alias("batch_moved"), F.col("n").isNotNull().alias("came"), "bucket")
    written = out.drop("came").repartition(len(touched), "bucket")
    written.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    now = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched)).join(new.select("bucket", *key), ["bucket", *key], "left_semi")
    first, last = F.col("batch_first") == this, F.col("batch_moved") == this
    tally = now.groupBy("bucket").agg(F.count_if(first).alias("inserted"), F.count_if(~first & last).alias("changed"), F.count_if(~first & ~last).alias("unchanged"))
    tally.withColumn("batch", this).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/batches")
    return True


def _same(old: Column, new: Column, fields: list[str], seen: tuple[str, ...] = ("last_seen_at", "source_version", "run")) -> Column:
    """Whether a row's fields are as they were, apart from those that only say it was seen."""
    telling = [c for c in fields if c not in seen] or fields
    return F.struct(*[old[c].alias(c) for c in telling]).eqNullSafe(F.struct(*[new[c].alias(c) for c in telling]))


def snapshot_sink(path: str, key: list[str], rule: Rule, buckets: int = 64):  # noqa: ANN201
    """A ``foreachBatch`` function that brings each micro-batch, deduplicated by key, into a snapshot once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_into(path, batch.dropDuplicates(key), key, batch_id, rule, buckets)

    return write
