"""Helpers shared by the operators: input columns, folds, written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import ensure_checkpoint_dir

OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]  # at least what any pattern means by it
WHITE = " \t\n\x0b\x0c\r"  # the word separators of every operator: [\x20\x09-\x0D]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, through Spark's reader (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the cluster's shared checkpoint folder and read back.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    root = ensure_checkpoint_dir(spark).removeprefix("file://").removeprefix("file:")
    for folder in folders:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name when the input already has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def bounded_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, so very long texts can't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


class Remembered:
    """Values of the keys met of late, at most about twice ``limit`` keys or thirty times as many characters.

    Once that much is in ``now``, it becomes the older half; keys met again come back from there, the others go with
    the next turn.
    """

    def __init__(self, limit: int):
        self.limit, self.now, self.older, self.size = limit, {}, {}, 0

    def unknown(self, keys: set[str]) -> list[str]:
        """The keys without a value; those of the older half come back into ``now``."""
        now, older = self.now, self.older
        missing = [k for k in keys if k not in now]
        found = [k for k in missing if k in older]
        self.add([(k, older[k]) for k in found])
        return [k for k in missing if k not in older] if found else missing

    def add(self, pairs: list[tuple[str, object]]) -> None:
        self.now.update(pairs)
        self.size += sum(len(k) for k, _ in pairs)

    def turn(self) -> None:
        if len(self.now) >= self.limit or self.size >= 32 * self.limit:
            self.older, self.now, self.size = self.now, {}, 0


def words_of(text: str) -> tuple[str | None, list[str]]:
    """The first word and the others, a line end before a word kept with it; None and none if white space is not single."""
    first, *rest = text.replace("\n", " \n").split(" ")
    if not first or "" in rest or "\n" in rest or any(c in text for c in OTHER_SPACE):
        return None, []
    return first, rest


def texts_of(batch: object, at: int) -> list[str]:
    """The texts of a record batch's column, null as empty."""
    return [t or "" for t in batch.column(at).to_pylist()]


def schema_with(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The frame's schema and one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])
