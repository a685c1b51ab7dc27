"""Helpers shared by the training-data operators: scratch tables, word splitting and what workers keep."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it has this share of all rows or more; so there are 1 / HOT of them at most.
HOT = 0.001


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and everything runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, whatever executor is lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def worker_memory(operator: str) -> dict:
    """What this Python worker keeps for an operator from one task to the next; every task can do without it.

    A worker keeps nothing for two operators: what another one left here is given up first, and the pages that Arrow holds in reserve.
    """
    kept = sys.modules.setdefault("_tessella_worker_memory", types.ModuleType("_tessella_worker_memory")).__dict__
    if kept.get("operator") != operator:
        kept.update(operator=operator, memory={})
        pa.default_memory_pool().release_unused()
    return kept["memory"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of ASCII alone take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def split_words(text: Column, gap: str) -> Column:
    """The words between the gaps; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like those given that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}

    def free(name: str) -> str:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        return name

    return [free(n) for n in names]


def named(*columns: str) -> list[Column]:
    """Columns by their exact names, which may hold dots."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; what cannot be hashed as it is (maps, variants) is written as JSON first."""
    odd = [c for c, kind in df.dtypes if "map<" in kind or "variant" in kind]
    return F.xxhash64(*named(*[c for c in df.columns if c not in odd]), *[F.to_json(F.struct(c)) for c in named(*odd)])


def hot_of(counts: DataFrame, *keys: str) -> DataFrame | None:
    """The keys that hold at least HOT of all rows (so 1 / HOT of them at most), or None; counts is a stored table of keys and their rows n."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") >= max(HOT * total, 2)).select(*keys)
    return None if hot.isEmpty() else hot


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has one row for each key; rows of hot keys meet a broadcast table of 1 / HOT rows at most and are not shuffled."""
    if hot is None:
        return left.join(right, keys, how)
    hot = F.broadcast(hot)
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    often = left.join(hot, keys, "left_semi").join(few, keys, how)
    return often.unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))
