"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrospark.session import checkpoint_dir

# Bytes of lower-cased ASCII letters, digits and all non-ASCII bytes are word
# bytes, everything else separates words.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32
    for b in range(256)
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def alnum_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, A-Z lower-cased."""
    return data.translate(_WORD_BYTES).split()


def space_words(data: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, A-Z lower-cased."""
    return data.lower().split()


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words of ``alnum_words`` as a Spark expression (null: no words)."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    return F.filter(words, lambda w: w != "")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so
    that a lost executor costs no recomputation of what stands before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def drop_folder(spark, path: str) -> None:
    """Delete a folder of intermediate files that this package wrote and that no
    result depends on any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def text_key(text: Column) -> list[Column]:
    """Together with doc_id, two columns that identify a row's content."""
    return [F.xxhash64(text).alias("_text_hash"), F.coalesce(F.octet_length(text), F.lit(-1)).alias("_text_bytes")]


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text mod 3 is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def broadcast_if_small(df: DataFrame, max_rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """Broadcast hint for a materialised table of at most ``max_rows`` rows and
    ``max_bytes`` bytes (strings and binaries by their length, other values as
    16); a larger one stays a shuffle join."""
    size = F.lit(0).cast("long")
    for f in df.schema.fields:
        flat = f.dataType.typeName() in ("string", "binary")
        text = F.col(f"`{f.name}`") if flat else F.to_json(F.struct(F.col(f"`{f.name}`")))
        nested = f.dataType.typeName() in ("array", "map", "struct")
        size = size + (F.coalesce(F.octet_length(text), F.lit(0)) if flat or nested else 16)
    n, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and held <= max_bytes else df


def byte_slices(column, max_rows: int = 256, max_bytes: int = 1 << 20):
    """Cut an Arrow string column into lists of UTF-8 values of bounded total
    size (one longer text makes a list of its own). Yields (first row, values).
    What the batches before left in Arrow's memory pool goes back to the system,
    since a worker process lives on through later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    out, start, total = [], 0, 0
    for i, v in enumerate(column.cast(pa.binary())):
        v = v.as_py()
        n = len(v) if v is not None else 0
        if out and (len(out) >= max_rows or total + n > max_bytes):
            yield start, out
            out, start, total = [], i, 0
        out.append(v)
        total += n
    if out:
        yield start, out
