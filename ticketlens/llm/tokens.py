"""Token files: flat unsigned integers, 64-bit document offsets, memory-mapped readers.

A store is a folder in a shared file system. Documents are dealt by ranges of their order into
shards; each shard is one task's work and has three flat little-endian files:

* ``NNNNN.ids``: the ids, unsigned 16-bit where the vocabulary allows, else 32-bit;
* ``NNNNN.doc``: signed 64-bit doc_id of each document (the smallest value stands for null);
* ``NNNNN.off``: signed 64-bit first id of each document in the whole store, and one past the last.

A shard knows only its own lengths when its ids are written. Its base is the sum of the ids of
all shards before it (a prefix sum over one number a shard); a second, small pass adds the base.
Files get their names when complete, by an atomic rename, and the same task always writes the
same bytes, so that a task which is run again leaves the store as it was.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.encoder import encoder, give_back, slices
from ticketlens.llm.rows import documents, keyed
from ticketlens.plans.shared import shared_dir, small_batches

NULL_ID = -(1 << 63)
END_ID = 1
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """Local files are memory-mapped; other stores go through Arrow's file systems."""
    if uri.startswith("/"):
        return arrow_fs.LocalFileSystem(use_mmap=True), uri
    found, path = arrow_fs.FileSystem.from_uri(uri)
    return (arrow_fs.LocalFileSystem(use_mmap=True) if isinstance(found, arrow_fs.LocalFileSystem) else found), path


def _put(folder: str, name: str, write: Callable) -> None:
    place, path = _place(folder)
    place.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with place.open_output_stream(part) as out:
        write(out)
    place.move(part, f"{path}/{name}")


def _get(folder: str, name: str, kind: str) -> np.ndarray:
    place, path = _place(folder)
    with place.open_input_file(f"{path}/{name}") as file:
        return np.frombuffer(file.read_buffer(), kind)


@dataclass(frozen=True)
class TokenStore:
    """A written store. ``shards`` holds (shard, documents, ids, base) in document order."""

    folder: str
    kind: str
    shards: tuple[tuple[int, int, int, int], ...]

    @property
    def n_tokens(self) -> int:
        return sum(s[2] for s in self.shards)


def _write_ids(folder: str, kind: str, path: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = encoder(path), TaskContext.get().partitionId()
        ids, first, sizes = [], None, []

        def write(out) -> None:
            nonlocal first
            for batch in batches:
                for part in slices(batch):
                    got, counts = coder.encode(part.column("text"))
                    got = np.insert(got, np.cumsum(counts), end_id)
                    out.write(got.astype(kind).tobytes())
                    sizes.append(counts + 1)
                    ids.append(part.column("doc_id").fill_null(NULL_ID).to_numpy())
                    first = part.column("_rid")[0].as_py() if first is None else first

        _put(folder, f"{shard:05d}.ids", write)
        give_back()
        counts = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        if len(counts):
            _put(folder, f"{shard:05d}.doc", lambda out: out.write(np.concatenate(ids).astype("<i8").tobytes()))
            _put(folder, f"{shard:05d}.len", lambda out: out.write(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes()))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "first": [first], "docs": [len(counts)], "ids": [int(counts.sum())]}, pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())]))

    return run


def _by_shard(spark: SparkSession, shards: list, run: Callable, schema: str) -> DataFrame:
    """One task for each shard. What goes to the tasks is a few numbers a shard."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                yield from run(*shards[i])

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(tasks, schema)


def write_tokens(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> TokenStore:
    """Encodes whole texts (null: empty) in ascending doc_id order and writes a store.

    Every row becomes one document, repeated and null doc_ids included (null first; rows equal in
    doc_id by a hash of their text). Each document ends in ``end_id``. Other columns are ignored.
    An empty table gives a store without shards.
    """
    spark, path = docs.sparkSession, path or tokenizer_path()
    folder = folder or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    kind = "<u2" if max(encoder(path).vocabulary, end_id + 1) <= 1 << 16 else "<u4"
    ordered = keyed(docs).select("_rid", F.col("doc_id").cast("long"), "text").repartitionByRange("_rid").sortWithinPartitions("_rid")
    with small_batches(spark, size="4m"):
        made = ordered.mapInArrow(_write_ids(folder, kind, path, end_id), "shard long, first long, docs long, ids long").collect()
    made.sort(key=lambda r: r["first"])
    base, shards = 0, []
    for r in made:
        shards.append((r["shard"], r["docs"], r["ids"], base))
        base += r["ids"]

    def lift(shard: int, n_docs: int, n_ids: int, base: int) -> Iterator[pa.RecordBatch]:
        lengths = _get(folder, f"{shard:05d}.len", "<i8")
        _put(folder, f"{shard:05d}.off", lambda out: out.write((lengths + base).astype("<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64())})

    if shards:
        _by_shard(spark, shards, lift, "shard long").collect()
    return TokenStore(folder, kind, tuple(shards))


def read_tokens(spark: SparkSession, store: TokenStore, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the store's files.

    ``start`` is the number of ids before the document in the whole store, ``ids_crc32`` the
    CRC-32 of its ids as little-endian unsigned 32-bit integers.
    """
    folder, kind = store.folder, store.kind
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digest_only else ", ids array<long>")

    def read(shard: int, n_docs: int, n_ids: int, base: int) -> Iterator[pa.RecordBatch]:
        ids, doc, off = (_get(folder, f"{shard:05d}.{x}", k) for x, k in (("ids", kind), ("doc", "<i8"), ("off", "<i8")))
        for at in range(0, n_docs, 2000):
            edges = off[at : at + 2001]
            inside = [ids[a - base : b - base] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            key = doc[at : at + 2000]
            columns = [
                pa.array(key, pa.int64(), mask=key == NULL_ID),
                pa.array(edges[:-1], pa.int64()),
                pa.array(np.diff(edges), pa.int64()),
                pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in inside], pa.int64()),
            ]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if not digest_only:
                columns.append(pa.array(inside, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return _by_shard(spark, list(store.shards), read, schema)


def op1_tokens(spark, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(documents(spark, sf_dir)), digest_only=True)
