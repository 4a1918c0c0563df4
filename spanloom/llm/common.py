"""What the operators share: shared scratch folders, staged tables, batches and skew-safe joins."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Tables staged within settled(), innermost last.
_PASSING: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; the path goes to Spark only, so any file system that it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share: the one the session names in spark.checkpoint.dir.

    Only where the session names none and runs on one machine (tests), a folder of our own is made; it goes when Python ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spanloom-")
            atexit.register(shutil.rmtree, folder, True)
            _OWN[app] = f"file://{folder}"
            spark.sparkContext.setCheckpointDir(_OWN[app])
        base = _OWN[app]
    return f"{base.rstrip('/')}/spanloom/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, **options) -> DataFrame:
    """Cuts the lineage: writes df to the shared folder and reads it again."""
    path = scratch(df.sparkSession, label)
    if _PASSING:
        _PASSING[-1].append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() returns as a written table; every table that it staged on the way is deleted then."""
    _PASSING.append([])
    try:
        out = build()
        path = scratch(spark, label)
        out.write.parquet(path)
    finally:
        for old in _PASSING.pop():
            removed(spark, old)
    if _PASSING:
        _PASSING[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def slices(texts: list, most: int = 2_000_000):
    """(start, end) of runs of texts of about `most` characters, so that temporary arrays stay small. A longer text is a run of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: Rows are counted by SLOTS hash slots of their key. A slot is heavy with over HEAVY_ROWS rows; the HEAVY_SLOTS fullest come to the driver, so
#: their list is bounded whatever the input, and a key outside it has less than 1 / HEAVY_SLOTS of all rows.
SLOTS, HEAVY_SLOTS, HEAVY_ROWS = 1 << 17, 1 << 14, 500
#: Null keys match nothing; they are dealt out so widely.
_NULL_SALTS = 1 << 10


def _slot(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(SLOTS)).cast("int")


class Heavy(list):
    """(slot, salts) of heavy slots, with one table of them: joins that use the same one can share their exchanges."""

    table: DataFrame | None = None

    def rows(self, spark: SparkSession) -> DataFrame:
        if self.table is None:
            self.table = spark.createDataFrame(list(self), "__slot int, __salts int")
        return self.table

    def with_more(self, other: "Heavy") -> "Heavy":
        """The slots of both, each with the larger number of salts."""
        both = dict(self)
        for slot, n in other:
            both[slot] = max(n, both.get(slot, 0))
        return Heavy(sorted(both.items()))


def heavy_keys(df: DataFrame, key: str) -> Heavy:
    """(slot, salts) of the heavy slots, by a count that is combined on the map side. Salts grow with a slot's rows, so that each
    salt's share is about that of the lightest slot in the list."""
    counts = df.where(F.col(key).isNotNull()).groupBy(_slot(key).alias("__slot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > HEAVY_ROWS)
    rows = counts.orderBy(F.desc("__n"), "__slot").limit(HEAVY_SLOTS).collect()
    share = HEAVY_ROWS if len(rows) < HEAVY_SLOTS else rows[-1]["__n"]
    return Heavy((r["__slot"], -(-r["__n"] // share)) for r in rows)


def skew_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", heavy: Heavy | None = None) -> DataFrame:
    """Joins `many` with `one` (unique by `key`), dealing the rows of heavy keys over several tasks.

    heavy: what heavy_keys() found, where `many` is costly to compute twice. Null keys of `many` match nothing (a left join keeps
    their rows). A row's salt depends on its own values and the input partition that it stands in, so equal rows are dealt out too, and a
    task that is run again deals its rows as before.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    heavy = heavy_keys(many, key) if heavy is None else heavy
    own = F.xxhash64(*[c for c in many.columns if c != key], F.spark_partition_id())
    if not heavy:
        if how == "inner":
            return many.join(one, key)
        spread = many.withColumn("__salt", F.when(F.col(key).isNull(), F.pmod(own, F.lit(_NULL_SALTS)).cast("int")).otherwise(0))
        return spread.join(one.where(F.col(key).isNotNull()).withColumn("__salt", F.lit(0)), [key, "__salt"], how).drop("__salt")
    named = F.broadcast(heavy.rows(many.sparkSession))
    spread = many.withColumn("__slot", _slot(key)).join(named, "__slot", "left")
    salts = F.when(F.col(key).isNull(), F.lit(_NULL_SALTS)).otherwise(F.coalesce("__salts", F.lit(1)))
    spread = spread.withColumn("__salt", F.pmod(own, salts).cast("int")).drop("__slot", "__salts")
    copies = one.where(F.col(key).isNotNull()).withColumn("__slot", _slot(key)).join(named, "__slot", "left")
    copies = copies.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__slot", "__salts")
    return spread.join(copies, [key, "__salt"], how).drop("__salt")


#: Bits of the filter that stands before joins of whole texts with lists of ids: 4 MB at most as rows, whatever the list.
FILTER_BITS = 1 << 23


def with_possible(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Adds __possible: false only if the key isn't in `ids` (one column). Texts whose key can't match then needn't be shuffled to find that out.

    The filter is a bitmap of FILTER_BITS bits in at most FILTER_BITS / 32 rows, so broadcasting it is bounded. With very many ids it lets more
    rows through; the join behind it decides.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    h = place(F.col(ids.columns[0]).cast(df.schema[key].dataType))
    bits = ids.select(F.floor(h / 32).cast("int").alias("__word"), F.expr("1L").alias("__one"), (h % 32).cast("int").alias("__bit"))
    words = bits.groupBy("__word").agg(F.expr("bit_or(shiftleft(__one, __bit))").alias("__bits"))
    own = df.withColumn("__h", place(F.col(key))).withColumn("__word", F.floor(F.col("__h") / 32).cast("int"))
    out = own.join(F.broadcast(words), "__word", "left")
    return out.withColumn("__possible", F.coalesce(F.expr("shiftright(__bits, cast(__h % 32 as int)) & 1L = 1L"), F.lit(False))).drop("__h", "__word", "__bits")


def ids_and_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Just the key as long and the text, null as empty: extra columns, whatever their names, can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def tidy() -> None:
    """Gives memory that a worker no longer uses back to the system: idle workers are kept for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run):
    """A function for mapInArrow that tidies up when its task ends."""

    def own(batches):
        yield from run(batches)
        tidy()

    return own


def quiet_threads() -> None:
    """The tokenizers library must not start threads of its own in an executor's worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
