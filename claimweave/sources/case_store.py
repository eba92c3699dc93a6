"""Stored tables of cases in Parquet: scopes replaced whole, resets, purges and snapshots, each visible at once or not at all.

Every change writes the rows of its tables to a folder of its own, then which scopes (a case, or a content hash) it
covers, and last a commit of one file. A reader takes the rows of a scope from the latest committed batch that covers
it. A job that dies before its commit has changed nothing, and the next one writes over what it left. There is one
writer at a time. Rows that are covered by later batches stay on disk until the store is copied to a new root.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COVERS, COMMITS, BATCH = "store_covers", "store_commits", "store_batch"


@dataclass(frozen=True)
class CaseStore:
    """Where a store lies, the scope column of each of its tables, and the tables that a reset empties."""

    root: str
    scopes: Mapping[str, str]
    derived: tuple[str, ...] = ("context", "chains", "reports", "history")
    cache: str = "doc_cache"
    manifest: str = "documents"

    def path(self, part: str, batch: int | None = None) -> str:
        return f"{self.root}/{part}" + ("" if batch is None else f"/{BATCH}={batch}")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """What a folder holds; None where there is no folder yet, which is the only error that is answered."""
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def committed(spark: SparkSession, store: CaseStore) -> int:
    """The number of the last committed batch, 0 for none."""
    commits = _read(spark, store.path(COMMITS))
    return 0 if commits is None else commits.agg(F.max(BATCH)).first()[0]


def _holders(spark: SparkSession, store: CaseStore, table: str) -> DataFrame:
    """(_scope, _batch, _filled): the batch that last covered each scope of a table, and whether it wrote rows of that table."""
    covers, last = _read(spark, store.path(COVERS)), committed(spark, store)
    if covers is None or not last:
        return spark.createDataFrame([], "_scope string, _batch int, _filled boolean")
    own = covers.filter((F.col("table") == table) & (F.col(BATCH) <= last))
    return own.groupBy(F.col("scope").alias("_scope")).agg(F.max(BATCH).alias("_batch"), F.max_by("filled", BATCH).alias("_filled"))


def current(spark: SparkSession, store: CaseStore, table: str) -> DataFrame | None:
    """A table's rows as last committed; None for a table that was never written."""
    rows = _read(spark, store.path(table))
    if rows is None:
        return None
    held = _holders(spark, store, table).filter("_filled").drop("_filled")
    own = F.col(store.scopes[table]).cast("string")
    return rows.join(held, (own == F.col("_scope")) & (F.col(BATCH) == F.col("_batch")), "left_semi").drop(BATCH)


def commit(spark: SparkSession, store: CaseStore, rows: Mapping[str, DataFrame], covered: Mapping[str, DataFrame]) -> int:
    """Writes a batch: rows by table, and the scopes (one column) that each table's rows replace, rows or none.

    Rows outside their table's covered scopes are never seen, nor are null scopes. Rows may come from the store itself,
    as no batch that a reader can see is written over. A table keeps the columns that it had first.
    """
    batch = committed(spark, store) + 1
    for table, df in rows.items():
        df.write.mode("overwrite").parquet(store.path(table, batch))
    covers = spark.createDataFrame([], "table string, scope string, filled boolean")
    for table, df in covered.items():
        each = df.select(F.lit(table).alias("table"), F.col(df.columns[0]).cast("string").alias("scope"), F.lit(table in rows).alias("filled"))
        covers = covers.unionByName(each.filter("scope is not null").distinct())
    covers.write.mode("overwrite").parquet(store.path(COVERS, batch))
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(store.path(COMMITS, batch))
    return batch


def replace_cases(spark: SparkSession, store: CaseStore, cases: DataFrame, rows: Mapping[str, DataFrame], keys: Mapping[str, list[str]], order: str) -> int:
    """Replaces all given tables of the given cases (case_id); the last row by `order` of a key stays, rows of other cases are left out.

    A case without rows in a table has none afterwards. Keys of which a column is null are each their own.
    """
    own = cases.select("case_id").distinct()
    kept = {}
    for table, df in rows.items():
        scope, key = store.scopes[table], keys[table]
        inside = df.join(own.withColumnRenamed("case_id", scope), scope, "left_semi") if scope == "case_id" else df
        whole = F.lit(True)
        for c in key:
            whole = whole & F.col(c).isNotNull()
        last = Window.partitionBy(*key).orderBy(F.col(order).desc())
        kept[table] = inside.withColumn("_rn", F.when(whole, F.row_number().over(last)).otherwise(1)).filter("_rn = 1").drop("_rn")
    covered = {t: own if store.scopes[t] == "case_id" else kept[t].select(store.scopes[t]) for t in rows}
    return commit(spark, store, kept, covered)


def reset_cases(spark: SparkSession, store: CaseStore, cases: DataFrame) -> int:
    """Empties what is derived for the given cases; documents, claims and judgments stay."""
    return commit(spark, store, {}, {t: cases.select("case_id") for t in store.derived if t in store.scopes})


def purge_cases(spark: SparkSession, store: CaseStore, cases: DataFrame) -> int:
    """Empties every table of the given cases, and the cache of each content hash that their manifest names, whoever else names it."""
    covered = {t: cases.select("case_id") for t, scope in store.scopes.items() if scope == "case_id"}
    manifest = current(spark, store, store.manifest)
    if store.cache in store.scopes and manifest is not None:
        covered[store.cache] = manifest.join(cases.select("case_id").distinct(), "case_id", "left_semi").select(store.scopes[store.cache])
    return commit(spark, store, {}, covered)


def purge_all(spark: SparkSession, store: CaseStore) -> int:
    """Empties every table of every scope that any batch covers."""
    covers = _read(spark, store.path(COVERS))
    if covers is None:
        return 0
    return commit(spark, store, {}, {t: covers.filter(F.col("table") == t).select("scope") for t in store.scopes})


def copy_store(spark: SparkSession, store: CaseStore, root: str, cases: DataFrame | None = None) -> CaseStore:
    """The store's current rows as the first batch of a new root, of all cases or of the given ones, without what is covered or gone."""
    fresh = CaseStore(root, store.scopes, store.derived, store.cache, store.manifest)
    tables = {t: df for t in store.scopes if (df := current(spark, store, t)) is not None}
    if cases is not None:
        own = cases.select("case_id").distinct()
        tables = {t: df.join(own, "case_id", "left_semi") for t, df in tables.items() if store.scopes[t] == "case_id"}
    commit(spark, fresh, tables, {t: df.select(store.scopes[t]) for t, df in tables.items()})
    return fresh


def golden_snapshot(spark: SparkSession, store: CaseStore, root: str, cases: DataFrame, selections: DataFrame) -> CaseStore:
    """Claims and judgments of the given cases with the pair that each family has now, in a store of its own.

    selections (case_id, root_claim, primary_idx, secondary_idx) come from a build without locks; chains and locks are not
    copied, so that a later build from the snapshot selects anew.
    """
    own = cases.select("case_id").distinct()
    fresh = CaseStore(root, {"claims": "case_id", "judgments": "case_id", "expected": "case_id"}, ())
    tables = {t: df.join(own, "case_id", "left_semi") for t in ("claims", "judgments") if (df := current(spark, store, t)) is not None}
    tables["expected"] = selections.select("case_id", "root_claim", "primary_idx", "secondary_idx").join(own, "case_id", "left_semi")
    commit(spark, fresh, tables, {t: own for t in tables})
    return fresh


def golden_changes(spark: SparkSession, golden: CaseStore, selections: DataFrame) -> DataFrame:
    """Families of the snapshot's cases whose pair is another one now, that are gone, or that are new; no rows for no change."""
    pair = ("primary_idx", "secondary_idx")
    old = current(spark, golden, "expected").select("case_id", "root_claim", *[F.col(c).alias(f"golden_{c}") for c in pair], F.lit(True).alias("_old"))
    own = _holders(spark, golden, "expected").select(F.col("_scope").cast("long").alias("case_id"))
    now = selections.join(own, "case_id", "left_semi").select("case_id", "root_claim", *pair, F.lit(True).alias("_now"))
    both = old.join(now, ["case_id", "root_claim"], "full")
    same = F.col("golden_primary_idx").eqNullSafe(F.col("primary_idx")) & F.col("golden_secondary_idx").eqNullSafe(F.col("secondary_idx"))
    change = F.when(F.col("_old").isNull(), "new").when(F.col("_now").isNull(), "gone").when(~same, "other_pair")
    return both.withColumn("change", change).filter("change is not null").drop("_old", "_now")
