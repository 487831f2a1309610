"""Shared pieces of the corpus operators: Arrow buffers as numpy arrays, words, rolling hashes, row keys, checkpoints.

Texts reach the vectorised operators as UTF-8 bytes in Arrow buffers. They are processed in slices of a few MB, so
memory does not depend on the size of a record batch; one text is never split, so it must itself fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet below the shared checkpoint folder and read again; `discard` removes it."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/strandline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that `stored` has written, through Spark's own file system."""
    for f in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/strandline-" in f:
            jvm = df.sparkSession._jvm
            path = jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. Only a local session may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = f"/tmp/strandline-{uuid.uuid4().hex}"
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What row_key makes, as a column type.
ROW = "struct<doc_id:bigint,hash:bigint>"


def row_hash(*columns: str) -> Column:
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def row_key(*columns: str) -> Column:
    """A row's doc_id and a 64-bit hash of its values: equal rows share it and then also share their results, and rows
    of different documents never do. Structs compare by their fields, nulls included. The cast makes both fields nullable,
    as they come back from Python: otherwise a join casts one side, and what groups by the key afterwards shuffles again."""
    return F.struct(F.col("doc_id").cast("long").alias("doc_id"), row_hash(*columns).alias("hash")).cast(ROW)


def unused(df: DataFrame, name: str) -> str:
    """name, made longer until df has no such column; case does not count, as in Spark."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def least_hash_sample(rows: DataFrame, column: str, k: int) -> DataFrame:
    """Rows of the k distinct values of `column` with the least hash, one each. Only hashes are sorted, no whole values."""
    keyed = rows.withColumn("__h", F.xxhash64(column))
    least = keyed.select("__h").distinct().orderBy("__h").limit(k)
    return keyed.join(F.broadcast(least), "__h", "left_semi").dropDuplicates(["__h"]).drop("__h")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 random 64-bit values, one a byte."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 16)) * np.uint64(0x9E3779B97F4A7C15))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for later slices."""
    if len(_powers["up"]) < n:
        size = max(n, 2 * len(_powers["up"]))
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] times rising powers of the base, modulo 2**64."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of every run of `length` values; equal contents hash alike wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[length:] - sums[:-length]) * down[: len(sums) - length])


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls count as empty."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `limit` bytes of text together (one row at least), with their bytes and offsets."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        whole, offs = utf8(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at), whole[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def pieces_of(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """As slices, but a longer text comes in pieces of its own that begin `limit` bytes apart and share `overlap` bytes, each with
    its place in the text. Whatever is at most overlap + 1 bytes long stands whole in a piece, begins below `limit` in just one."""
    for rows, data, offs in slices(batches, limit=limit):
        if len(data) <= limit + overlap or rows.num_rows > 1:
            yield rows, data, offs, 0
            continue
        for at in range(0, len(data), limit):
            piece = data[at : at + limit + overlap]
            yield rows, piece, np.array([0, len(piece)]), at
            if at + len(piece) == len(data):
                break


#: Bytes that end a word `[^\x20\x09-\x0D]+`.
IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte ranges of the words of all texts, and the index of each text's first word."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = np.zeros(len(data) + 1, bool)
    ends[1:] = inside[:-1] & ~inside[1:]
    cuts = offs[1:-1]  # a text's end closes a word even if the next text begins with one
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] |= inside[cuts]
    ends[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return start, end, np.searchsorted(start, offs)


_PLACES = 64


def place_table(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte at each of the first places of a span."""
    return mix((np.arange(1, _PLACES * 256 + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 20)) * np.uint64(0x9E3779B97F4A7C15))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *tables: np.ndarray) -> list[np.ndarray]:
    """Hashes of data[start:end], one array a table: the sum of a random value for each (byte, place within the span).

    Unlike a polynomial modulo 2**64, no two contents collide under every table: each table is a hash of its own.
    """
    length = end - start
    first = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=first[1:])
    local = np.arange(first[-1]) - np.repeat(first[:-1], length)
    byte = data[local + np.repeat(start, length)]
    code = (local & (_PLACES - 1)).astype(np.uint16) << 8 | byte
    far = np.flatnonzero(local >= _PLACES)
    beyond = (local[far] // _PLACES).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for table in tables:
        value = table[code]
        if len(far):
            value[far] = mix(value[far] + beyond)
        sums = np.zeros(first[-1] + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        out.append(mix(sums[first[1:]] - sums[first[:-1]]))
    return out


def lookup(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each key its place in a sorted table, -1 where it is not there."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
