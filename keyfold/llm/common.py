"""What the training-data operators share: durable intermediate tables, code shipping, connected components."""

from __future__ import annotations

import atexit
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from keyfold.functions import shared
from keyfold.functions.shipping import ship  # noqa: F401

_written: list[tuple[SparkSession, str]] = []


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared.shared_dir(df.sparkSession)}/keyfold-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove_all)
    _written.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._keyfold_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote and returned as df, if it did; only once nothing reads it any more."""
    path = getattr(df, "_keyfold_path", None) if "_keyfold_path" in vars(df) else None
    for w in [w for w in _written if w[1] == path]:
        shared.delete(*w)
        _written.remove(w)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            shared.delete(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


#: Rows that may be broadcast: a few tens of megabytes of keys.
BROADCAST_ROWS = 1 << 18


def fits(df: DataFrame) -> bool:
    """Whether df has at most BROADCAST_ROWS rows."""
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it fits; beyond, joins with it shuffle, and adaptive execution splits hot keys."""
    return F.broadcast(df) if fits(df) else df.hint("merge")


def lowest(df: DataFrame, h: Column, k: int, rows: int) -> DataFrame:
    """The k rows of df with the lowest hashes h, of a table of so many rows.

    A cut at about 4 k rows of the table goes first, so that tasks don't each send k rows to one; fewer than k come only where few of the table's rows are in df.
    """
    place = F.pmod(h, F.lit(1 << 30))
    cut = df.where(place < (4 * k << 30) // rows) if rows > 8 * k else df
    return cut.withColumn("__place", place).withColumn("__h", h).orderBy("__place", "__h").limit(k).drop("__place", "__h")


def sample(df: DataFrame, k: int, text: str, stretch: int, where: Column) -> list[Row]:
    """At most k of df's distinct rows that meet where, those with the lowest hashes, less all of column text but `stretch` characters from a place that the hash chooses."""
    h = F.xxhash64(*df.columns)
    hashes = materialize(df.where(where).select(h.alias("__key")).distinct(), "hashes")
    low = lowest(hashes, F.col("__key"), k, hashes.count())
    start = F.pmod(F.col("__key"), F.greatest(F.length(text) - stretch, F.lit(0)) + 1).cast("int")
    rows = df.withColumn("__key", h).join(F.broadcast(low), "__key").withColumn(text, F.substring(F.col(text), start + 1, F.lit(stretch)))
    found = rows.groupBy("__key").agg(*(F.min(c).alias(c) for c in df.columns)).drop("__key").collect()
    release(hashes)
    return found


def tokenizer_json(path: str | None = None) -> str:
    """The byte-level BPE file's text; path: a place that the driver can read."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Path(path).read_text(encoding="utf-8")


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph given as (u, v) longs.

    Returns (node, component): every node of an edge, with the smallest node that it reaches.  Alternates the
    large-star and small-star steps of Kiveris et al.; a step is one aggregation with map-side combine and one
    equi-join, so a node with very many links is never gathered in one task (adaptive execution splits its side
    of the join).  Each round is a table in the shared folder.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "edges")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        release(e)
        e = after
        if state == before or state[0] == 0:
            break
        before = state
    tops = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops.select("node", F.col("node").alias("component")))
