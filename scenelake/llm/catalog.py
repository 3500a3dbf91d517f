"""Where the queries of this subpackage are registered, and small helpers that its operators share."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"                      # words of the contracts that count white-space separated words
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of an id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def crc32_sql(text: str) -> str:
    """DuckDB's expression for the unsigned crc32 of a text's UTF-8 bytes, ASCII only: it has no such function."""
    shift = "case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    entries = f"list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {shift}, i))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint), lambda c, b: xor(c >> 8, ({entries})[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


def utf8(col: str = "text") -> Column:
    """A text as bytes, null as none: workers then need no decoding, and ASCII case and white space are bytes methods."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more, so that a job's disk holds what is still needed only."""
    for t in tables:
        files = t.inputFiles()
        folder = files[0].rsplit("/", 1)[0] if files else ""
        context = t.sparkSession.sparkContext
        if f"/scenelake/{context.applicationId}/" in folder:     # only what `settle` has written in this application
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give back to the system what Arrow and malloc hold free."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def tidied(run: Callable) -> Callable:
    """`run`, a generator over batches, that leaves a worker small: workers live on from stage to stage, beside the executor's heap."""
    def whole(batches):
        yield from run(batches)
        release()                                # by now `run` and all it held are gone
    return whole


def mapped(df: DataFrame, worker: Callable, schema: T.StructType | str, rows: int | None = None) -> DataFrame:
    """`mapInArrow` with a worker that turns each record batch into columns (a list of arrays) of `schema`.

    `worker()` is called once a task and returns the function for batches, so that caches live as long as the task. Where a step's
    arrays are many times its input, `rows` hands it slices of so many rows, and what comes of one goes out before the next.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    fields = to_arrow_schema(schema)

    def run(batches):
        step = worker()
        for b in batches:
            size = rows or b.num_rows
            for lo in range(0, b.num_rows, size or 1):
                cols = step(b.slice(lo, size))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(cols, fields)], schema=fields)
    return df.mapInArrow(tidied(run), schema)


def computed(worker: Callable, kind: str):
    """A column function: `worker()` is called once a task and returns the function from an Arrow array to an Arrow array.

    Only the argument goes to Python and only the result comes back; the other columns of a row wait in the JVM, which can spill them.
    """
    def each(batches):
        step = worker()
        for b in batches:
            yield step(b)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(each)(batches)
    return run
