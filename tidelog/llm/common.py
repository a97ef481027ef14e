"""What several operators share: shared folders, gapless ranks, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sub-groups into which a group is dealt before its rows are numbered.
SUBGROUPS = 1024
#: Parts that the rows of one key are dealt to where they are joined.
SALTS = 64
#: Bytes that a task holds before it writes them out.
BLOCK_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between two steps, which driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset, as
    in tests on one machine, is a folder under the warehouse taken.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    place = held.get() if not held.isEmpty() else spark.conf.get("spark.checkpoint.dir", None)
    if place is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        place = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return place


def written(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet to a new shared folder and goes on from there, so that loops don't grow plans and lost
    executors cost no more than a step.  ``drop`` deletes the folder once nothing reads it any more."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(place)
    found = spark.read.schema(df.schema).parquet(place)
    found.__dict__["_shared_place"] = place
    return found


def drop(*tables: DataFrame) -> None:
    """Deletes the folders of tables that ``written`` wrote."""
    for df in tables:
        if (place := df.__dict__.get("_shared_place")) is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """doc_id (long) and text (string) of a table.  Columns that fit already stay as they are, without an alias, so that
    a plan that uses the table twice can share one exchange."""
    kind = dict(docs.dtypes)
    one = F.col(id_col) if (id_col, kind[id_col]) == ("doc_id", "bigint") else F.col(id_col).cast("long").alias("doc_id")
    two = F.col(text_col) if (text_col, kind[text_col]) == ("text", "string") else F.col(text_col).cast("string").alias("text")
    return [one, two]


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(*keyed_columns(docs, id_col, text_col))


def fresh(name: str) -> str:
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def fixed(value: Column) -> Column:
    """The same value, in a column that the optimiser neither copies into conditions on it nor moves: the branch always
    holds, but hangs on the row's number.  Long expressions that use one another would be spelled out many times over."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def gapless_rank(df: DataFrame, group: list[str], order: list[str | Column], to: str, subgroups: int = SUBGROUPS) -> DataFrame:
    """Numbers the rows of each group 0, 1, 2 ... without one task ever holding a whole group.

    Rows are dealt by a hash of ``order`` to ``subgroups`` sub-groups; those are
    numbered on their own, and each gets the sum of the counts of the sub-groups
    before it.  Per group only ``subgroups`` counts meet.  Rows equal in every
    column of ``order`` get neighbouring numbers in any order.
    """
    sub, base, n = fresh("sub"), fresh("base"), fresh("n")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.withColumn(sub, F.pmod(F.xxhash64(*keys), F.lit(subgroups)).cast("int"))
    counts = dealt.groupBy(*group, sub).agg(F.count("*").alias(n))
    before = Window.partitionBy(*group).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"{base}_{i}") for i, g in enumerate(group)], F.col(sub).alias(f"{base}_s"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    on = [F.col(g).eqNullSafe(F.col(f"{base}_{i}")) for i, g in enumerate(group)] + [F.col(sub) == F.col(f"{base}_s")]
    joined = dealt.join(counts, on)
    number = F.row_number().over(Window.partitionBy(*group, sub).orderBy(*keys)) - 1
    return joined.withColumn(to, F.col(base) + number).drop(sub, base, f"{base}_s", *[f"{base}_{i}" for i in range(len(group))])


def salt(*by: str) -> Column:
    return F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")


def salts(*by: str) -> Column:
    """An aggregate: which salts the rows of a group have, a bit for each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt(*by))).alias("salts")


def each_salt(table: DataFrame, to: str) -> DataFrame:
    """Each row once for every salt in its column ``salts``."""
    held = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.call_function("getbit", F.col("salts"), i) == 1)
    return table.withColumn(to, F.explode(held)).drop("salts")


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``rows`` joined with ``table``, which has a row for each key and in ``salts`` which salts of ``by`` its rows have.

    The rows of a key meet in up to ``SALTS`` parts, and the table's row goes to those that there are, so a key that a
    third of all rows have doesn't make one task as large as that.
    """
    part = fresh("salt")
    return rows.withColumn(part, salt(by)).join(each_salt(table, part), [*keys, part]).drop(part)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (columns a, b; long): one row (node, label) for each node of an edge but
    the smallest of its component.

    Alternates large-star and small-star steps until the edges stand still.
    ``label`` is the smallest node of the component.  Each step is an aggregation
    and a ``lookup`` of its minima, so the edges of a hub are dealt over tasks.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(b as decimal(38,0)))")).first())

    seen = signature(now)
    while seen[0]:
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), salts("b"))
        large = lookup(both, low, ["a"], "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node hands its lower neighbours and itself to the lowest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"), salts("b"))
        small = lookup(large, low, ["a"], "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).distinct()
        old, now = now, written(small)
        drop(old)
        was, seen = seen, signature(now)
        if was == seen:
            break
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
