"""WARC archives of a table of pages: sharded writer and reader.

Equal payloads are stored once: the record with the largest id is a response,
the others revisit it.  Records are sorted by id and payload digest and dealt to
shards at pivots that a hash-chosen sample of keys gives, so the same table
makes the same files, byte for byte, however it is partitioned.  A task writes
its shard's records into files under temporary names, rolled by compressed
size, and returns a manifest row for each; rows of attempts that failed never
get there.  A second job gives the files of the manifest their names, the
manifest is stored last, and readers go by the manifest alone.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import warc as W
from .session import BROADCAST_KEYS, bounded_batches, stored

#: Payloads of fewer bytes are stored as often as they occur.
LEAST_BYTES = 1000
#: Bytes of payload that a shard aims at, shards at most (then they grow), sampled keys a shard, compressed bytes that end a file.
SHARD_BYTES, MOST_SHARDS, KEYS_A_SHARD, ROLL_BYTES = 32 << 20, 20_000, 20, 256 << 20
#: Digests are hot from this share of all copies on, so there are at most as many.
HOT = 1000
#: WARC-Date of records: pages have none, and the writer's clock would make each run differ.
DATE = "1970-01-01T00:00:00Z"
_MANIFEST = "shard int, number int, name string, temporary string, n_records long, n_bytes long, sha256 string, first_key string, last_key string"
_RECORDS = "file string, warc_type string, record_id string, row_id long, url string, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _sort_key() -> Column:
    """Text in the order of (id, digest); null ids come first."""
    return F.concat(F.coalesce(F.lpad(F.hex(F.col("id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("")), F.lit("/"), F.col("digest"))


def _winners(own: DataFrame, most: int) -> DataFrame:
    """Adds ``top``: the largest id among the rows of an equal payload, where there are several.

    Up to ``most`` such digests are broadcast, counted first.  Of more, the
    hot ones, at most ``HOT``, are broadcast and the others joined by a shuffle
    that rows of hot digests enter under keys of their own.
    """
    groups = own.where(F.col("n_bytes") >= LEAST_BYTES).groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null")
    groups = stored(groups, "warc-copies")
    if groups.limit(most + 1).count() <= most:
        return own.join(F.broadcast(groups.drop("n")), "digest", "left")
    hot = F.col("n") * HOT > groups.agg(F.sum("n")).first()[0]
    marked = own.join(F.broadcast(groups.where(hot).select("digest", F.col("top").alias("hot"))), "digest", "left")
    marked = marked.withColumn("j", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit("/"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    joined = marked.join(groups.where(~hot).select(F.col("digest").alias("j"), "top"), "j", "left")
    return joined.withColumn("top", F.coalesce("hot", "top")).drop("hot", "j")


def _pivots(own: DataFrame, shard_bytes: int) -> list[str]:
    """Keys at which shards begin, but for the first: equal shares of bytes of a sample of at most about ``MOST_SHARDS * KEYS_A_SHARD`` keys."""
    total = own.agg(F.count("*").alias("n"), F.sum(F.col("n_bytes") + 500).alias("bytes")).first()
    n_shards = min(MOST_SHARDS, -(-(total["bytes"] or 0) // shard_bytes))
    if n_shards < 2:
        return []
    every = max(1, total["n"] // (n_shards * KEYS_A_SHARD))
    sample = own.where(F.pmod(F.xxhash64("id", "digest"), F.lit(every)) == 0).groupBy(_sort_key().alias("key")).agg(F.sum(F.col("n_bytes") + 500).alias("bytes"))
    rows = sorted((r["key"], r["bytes"]) for r in sample.collect())
    ends = list(accumulate(b for _, b in rows))
    cuts = [bisect_right(ends, ends[-1] * k // n_shards) for k in range(1, n_shards)] if rows else []
    return sorted({rows[c][0] for c in cuts if 0 < c < len(rows)})


def _shard(pivots: list[str]):
    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(pivots, k) for k in keys], dtype="int32")

    return shard


class _File:
    """A file under a temporary name, and its manifest row."""

    def __init__(self, store: fs.FileSystem, folder: str, shard: int, number: int, date: str):
        self.name = f"shard-{shard:05d}-{number:05d}.warc.gz"
        self.temporary = f"_temporary/{uuid.uuid4().hex}"
        self.shard, self.number, self.n, self.size, self.sha, self.first, self.last = shard, number, 0, 0, hashlib.sha256(), None, None
        store.create_dir(f"{folder}/_temporary", recursive=True)
        self.out = store.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.write(W.info(self.name, date))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def row(self) -> dict:
        self.out.close()
        return {
            "shard": self.shard, "number": self.number, "name": self.name, "temporary": self.temporary, "n_records": self.n, "n_bytes": self.size, "sha256": self.sha.hexdigest(), "first_key": self.first, "last_key": self.last,
        }


def _writer(folder: str, roll_bytes: int, date: str):
    schema = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("temporary", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string()), ("first_key", pa.string()), ("last_key", pa.string())])

    def write(batches):
        store, path = _filesystem(folder)
        file, before, again = None, None, 0
        for batch in batches:
            columns = [batch.column(n) for n in ("shard", "key", "id", "url", "digest", "n_bytes", "payload", "refers_to")]
            for i in range(batch.num_rows):
                shard, key, row_id, url, digest, n_bytes, payload, refers_to = (c[i].as_py() for c in columns)
                if file and (file.shard != shard or file.size >= roll_bytes):
                    yield pa.RecordBatch.from_pylist([file.row()], schema)
                    file = _File(store, path, shard, file.number + 1 if file.shard == shard else 0, date)
                file = file or _File(store, path, shard, 0, date)
                again = again + 1 if key == before else 0
                before = key
                file.write(W.page(row_id, again, url, digest, n_bytes, payload, refers_to, date))
                file.n, file.first, file.last = file.n + 1, file.first or key, key
        if file:
            yield pa.RecordBatch.from_pylist([file.row()], schema)

    return write


def _committer(folder: str):
    def commit(batches):
        store, path = _filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                source, target = f"{path}/{r['temporary']}", f"{path}/{r['name']}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                if store.get_file_info(target).size != r["n_bytes"]:  # a task that runs again finds its files moved
                    raise OSError(f"{r['name']} is missing or has another size than written")
            yield batch

    return commit


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE, most: int = BROADCAST_KEYS
) -> DataFrame:
    """Writes archives of all pages into a new ``folder`` that all executors share, and returns its manifest.

    Payloads are UTF-8; null is empty.  Of rows of one payload of at least
    ``LEAST_BYTES`` those with the largest id are responses (several, if that
    id is repeated) and the others revisit them; where all ids are null all are
    responses.  Ids are longs; a record of a null id has none.  A null or empty URL is left out, other
    columns are not read, a table without rows makes an empty manifest.  A
    payload is held whole, by one task.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    own = own.withColumns({"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    pivots = _pivots(own, shard_bytes)
    revisit = F.col("top").isNotNull() & (F.col("id").isNull() | (F.col("id") < F.col("top")))
    typed = _winners(own, most).withColumns({"refers_to": F.when(revisit, F.col("top")), "payload": F.when(~revisit, F.col("payload")), "key": _sort_key()})
    dealt = typed.withColumn("shard", _shard(pivots)("key")).repartitionById(len(pivots) + 1, "shard").sortWithinPartitions("key", "url")
    staged = dealt.select("shard", "key", "id", "url", "digest", "n_bytes", "payload", "refers_to").mapInArrow(_writer(folder, roll_bytes, date), _MANIFEST)
    staged.write.parquet(f"{folder}/_staged")  # the files of tasks that ended well
    spark.read.schema(_MANIFEST).parquet(f"{folder}/_staged").mapInArrow(_committer(folder), _MANIFEST).drop("temporary").write.parquet(f"{folder}/manifest")
    store, path = _filesystem(folder)
    for name in ("_temporary", "_staged"):
        if store.get_file_info(f"{path}/{name}").type == fs.FileType.Directory:
            store.delete_dir(f"{path}/{name}")
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder of archives: ``shard, number, name, n_records, n_bytes, sha256, first_key, last_key``; a folder that was not written to its end has none."""
    return spark.read.parquet(f"{folder}/manifest")


def _reader(folder: str, with_payload: bool):
    def rows(name, stream):
        for record in W.members(stream):
            fields, block = W.parse(record)
            told = fields.get("warc-payload-digest")
            n_bytes, body = W.http_body(block) if fields["warc-type"] in ("response", "revisit") else (None, b"")
            intact = fields.get("warc-block-digest") in (None, W.digest(block))
            if fields["warc-type"] == "response":
                own = W.digest(body)
                intact, n_bytes, told = intact and told in (None, own), len(body), own
            number = lambda k, fields=fields: int(fields[k]) if k in fields else None
            row = [name, fields["warc-type"], fields.get("warc-record-id"), number("x-row-id"), fields.get("warc-target-uri"), n_bytes, W.hex_digest(told), number("x-refers-to-row-id"), intact]
            yield [*row, body if fields["warc-type"] == "response" else None] if with_payload else row, len(body)

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *[pa.binary()] * with_payload]
    names = [x.split()[0] for x in _RECORDS.split(", ")] + ["payload"] * with_payload

    def read(batches):
        store, path = _filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                held, size = [], 0
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for row, n in rows(name, stream):
                        held.append(row)
                        size += n * with_payload
                        if len(held) >= 2000 or size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Records of all files of the manifest: type, ids, URL, length and hex SHA-1 of the payload, ``refers_to`` of revisits, ``intact`` (digests told anew agree).

    A revisit has the length and digest that it states.  Files are streams, a
    record is held whole.  ``with_payload`` adds ``payload`` of responses.
    """
    files = manifest(spark, folder).select("name")
    n = max(1, min(files.count(), 10 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(_reader(folder, with_payload), _RECORDS + (", payload binary" if with_payload else ""))
