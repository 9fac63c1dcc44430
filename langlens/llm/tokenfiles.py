"""Flat token files: export of documents, the separator scan (operator 10) and training-order shards (operator 2).

Files lie in shared storage and are reached through pyarrow's file systems by URI. A task writes under a name
of its own and renames it, so that a repeated task leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, flat, open_store, shared_dir, written

END_OF_DOCUMENT = 50256
#: Blocks that a task of the separator scan takes, where they are many.
BLOCKS_A_TASK = 32


@lru_cache(2)
def tokenizer(path: str):
    """A byte-level BPE from a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def export_tokens(docs: DataFrame, folder: str, vocabulary: str, eod: int = END_OF_DOCUMENT) -> DataFrame:
    """Writes documents as flat little-endian 16-bit files, one a partition, each document followed by eod.

    Returns (file, ordinal, doc_id), the order of documents in each file; lengths are stored nowhere. An empty
    document is a lone separator. Empty partitions leave no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        part = TaskContext.get().partitionId()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        name, mine = f"part-{part:06d}.bin", f"{root}/.{part}-{uuid.uuid4().hex}"
        n = 0
        with store.open_output_stream(mine) as out:
            for batch in batches:
                for text in batch[1].to_pylist():
                    out.write(np.array([*encode(text or ""), eod], "<u2").tobytes())
                ids = batch[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids)), pa.array(np.arange(n, n + len(ids))), ids], ["file", "ordinal", "doc_id"])
                n += len(ids)
        if n:
            store.move(mine, f"{root}/{name}")
        else:
            store.delete_file(mine)

    kind = documents(docs).schema["doc_id"].dataType.simpleString()
    return documents(docs).mapInArrow(run, f"file string, ordinal long, doc_id {kind}")


def token_counts(spark: SparkSession, folder: str, eod: int = END_OF_DOCUMENT, dtype: str = "<u2", block_tokens: int = 1 << 19) -> DataFrame:
    """Documents of flat token files by a scan for separators: (file, ordinal, first_token, n_tokens).

    Files are cut into blocks that are searched independently; a document that spans blocks is stitched by a
    prefix scan over the blocks' carried lengths. Tokens after the last separator are a last document; a file
    without tokens has none. Files whose size is no multiple of the token are an error.
    """
    width = np.dtype(dtype).itemsize
    store, root = open_store(folder)
    sizes = [(x.base_name, x.size) for x in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.is_file and not x.base_name.startswith((".", "_"))]
    if bad := [n for n, s in sizes if s % width]:
        raise ValueError(f"not whole tokens: {bad[:3]}")
    files = spark.createDataFrame([(n, s // width) for n, s in sizes] or [("", 0)], "file string, tokens long").where("tokens > 0")
    n_blocks = sum(-(-s // (width * block_tokens)) for _, s in sizes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = files.select("file", "tokens", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block")).repartition(max(1, min(n_blocks, max(parts, n_blocks // BLOCKS_A_TASK))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        for batch in batches:
            out = []
            for file, tokens, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_tokens
                n = min(block_tokens, tokens - first)
                with store.open_input_file(f"{root}/{file}") as f:
                    f.seek(first * width)
                    ids = np.frombuffer(f.read(n * width), dtype)
                out.append((file, block, first + n == tokens, first, n, np.flatnonzero(ids == eod)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))] + [pa.array([x[5] for x in out], pa.list_(pa.int64()))],
                ["file", "block", "last", "first", "n", "ends"],
            )

    seen = written(blocks.mapInArrow(scan, "file string, block long, last boolean, first long, n long, ends array<long>"), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # The prefix scan carries two numbers a block: documents ended so far, and where the last of them ended. The places of
    # the separators stay where they are and are joined afterwards.
    end = F.expr("case when size(ends) > 0 then first + ends[size(ends) - 1] + 1 end")
    light = seen.select("file", "block", F.size("ends").cast("long").alias("k"), end.alias("end"))
    sums = light.select("file", "block", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("ordinal"), F.coalesce(F.max("end").over(before), F.lit(0)).alias("open"))
    carried = seen.select("*", F.size("ends").cast("long").alias("k"), end.alias("end")).join(sums, ["file", "block"])
    cuts = F.expr("transform(ends, (e, i) -> named_struct('i', i, 'first', if(i = 0, open, first + ends[i - 1] + 1), 'stop', first + e))")
    tail = F.expr("if(last and coalesce(end, open) < first + n, array(named_struct('i', cast(k as int), 'first', coalesce(end, open), 'stop', first + n)), cast(array() as array<struct<i:int,first:bigint,stop:bigint>>))")
    rows = carried.select("file", "ordinal", F.explode(F.concat(cuts, tail)).alias("d"))
    return rows.select("file", (F.col("ordinal") + F.col("d.i")).alias("ordinal"), F.col("d.first").alias("first_token"), (F.col("d.stop") - F.col("d.first")).alias("n_tokens"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as flat token files, then their token counts by the separator scan: doc_id, n_tokens, file, first_token."""
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    order = written(export_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.tiktoken")), "order")
    return order.join(token_counts(spark, folder).hint("merge"), ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "first_token")


# Training order -----------------------------------------------------------------------------------------


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 4) -> np.ndarray:
    """A keyed permutation of 0 .. n-1: a balanced Feistel network over the next even power of two, cycle-walked."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [int.from_bytes(hashlib.sha256(f"{key}:{r}".encode()).digest()[:8], "little") | 1 for r in range(rounds)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & low)
        return left << np.uint64(half) | right

    out = once(index.astype(np.uint64))
    while (walk := np.flatnonzero(out >= n)).size:
        out[walk] = once(out[walk])
    return out.astype(np.int64)


#: Tasks that write shards; a task of more writes one after another.
MOST_TASKS = 65536


def _manifest(folder: str, holds: dict) -> None:
    """Writes the folder's manifest, or compares it with the one that is there."""
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)
    name, text = f"{root}/manifest.json", json.dumps(holds, sort_keys=True).encode()
    if store.get_file_info(name).is_file:
        with store.open_input_file(name) as f:
            if f.read() != text:
                raise ValueError(f"{folder} holds other shards")
        return
    mine = f"{root}/.manifest-{uuid.uuid4().hex}"
    with store.open_output_stream(mine) as out:
        out.write(text)
    store.move(mine, name)


def training_shards(docs: DataFrame, folder: str, key: int, length: int = 512, dtype: str = "u1", slots_per_shard: int = 16384, pad: int = 0, ids_col: str | None = None) -> DataFrame:
    """Materialises sequences in training order: (doc_id, seq, slot, shard, byte_offset, n_tokens, crc32).

    Token ids are those of the column ids_col (array<int>, in a dtype that holds them, such as what the byte-level BPE
    gives) or, without one, the UTF-8 bytes of each text (a vocabulary of 256). They are cut into sequences of `length`,
    the last padded with `pad` up to the fixed stride; a document without tokens, null ones too, is one sequence of 0
    tokens. Null ids are kept, repeated rows are documents of their own, an empty table writes no shard. Sequences are
    numbered by input partition and place, the Feistel permutation gives each its global slot, and ranges of slots are
    the partitions that write the shards, in which slot s lies at byte (s mod slots_per_shard) * stride. On the way there,
    the sequences that a batch sends to one shard travel as one compressed block; a task holds one shard. Partition
    numbering needs a repeatable input, such as a table; a partition that comes out different the second time is an error.

    A manifest tells what the folder holds. A call for the same folder and the same manifest goes on where a broken one
    stopped: shards that are there are not written again. Another manifest is an error.
    """
    width = np.dtype(dtype).itemsize
    rows = docs.select("doc_id", F.coalesce(F.col(ids_col), F.array()).cast("array<int>").alias("text")) if ids_col else documents(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    count = F.greatest(F.lit(1), F.ceil((F.size("text") if ids_col else F.octet_length("text")) / length))
    sizes = dict(rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(count)).collect())
    base, total = {}, 0
    for p in sorted(sizes):
        base[p], total = total, total + sizes[p]
    _manifest(folder, {"key": key, "length": length, "dtype": dtype, "slots_per_shard": slots_per_shard, "pad": pad, "sequences": total, "ids": ids_col or "bytes"})

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = TaskContext.get().partitionId()
        at = first = base.get(p, 0)
        for batch in batches:
            if ids_col:
                raw, off = np.asarray(batch[1].flatten()), np.asarray(batch[1].offsets).astype(np.int64)
                off = off - off[0]
            else:
                raw, off = flat(batch[1])
            size = np.diff(off)
            n = np.maximum(1, -(-size // length))
            row = np.repeat(np.arange(len(n)), n)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            tokens = np.clip(size[row] - seq * length, 0, length)
            slot = feistel(np.arange(at, at + len(row)), total, key)
            starts = off[row] + seq * length
            data = np.full((len(row), length), pad, dtype)
            inside = np.arange(length) < tokens[:, None]
            data[inside] = raw[(starts[:, None] + np.arange(length))[inside]]
            at += len(row)
            order = np.lexsort((slot, slot // slots_per_shard))
            shard = (slot // slots_per_shard)[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(order)]]).astype(np.int32)
            blobs = [pa.compress(data[order[a:b]].tobytes(), "zstd", asbytes=True) for a, b in zip(cuts, cuts[1:])]
            fields = [batch[0].take(pa.array(row[order])), *(pa.array(x[order]) for x in (seq, slot, tokens))]
            yield pa.RecordBatch.from_arrays([pa.array(shard[cuts[:-1]]), *(pa.ListArray.from_arrays(pa.array(cuts), x) for x in fields), pa.array(blobs, pa.binary())], ["shard", "doc_id", "seq", "slot", "n_tokens", "data"])
        if at - first != sizes.get(p, 0):
            raise RuntimeError("the input's partitions changed between two reads; write it as a table first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)

        def close(shard: int, blocks: list[pa.RecordBatch]) -> pa.RecordBatch:
            part = pa.Table.from_batches(blocks)
            ids, seq, slot, tokens = (pa.concat_arrays([x.flatten() for x in part[c].chunks]) for c in ("doc_id", "seq", "slot", "n_tokens"))
            place = np.asarray(slot) - shard * slots_per_shard
            data = np.empty((len(place), length), dtype)
            if sorted(place.tolist()) != list(range(len(place))):
                raise RuntimeError(f"shard {shard} lacks slots")
            sizes = [len(x) for x in part["slot"].to_pylist()]
            for blob, n, lo in zip(part["data"].to_pylist(), sizes, np.cumsum([0, *sizes])):
                data[place[lo : lo + n]] = np.frombuffer(pa.decompress(blob, n * length * width, "zstd"), dtype).reshape(n, length)
            name = f"{root}/shard-{shard:08d}.bin"
            if store.get_file_info(name).size != data.nbytes:
                mine = f"{root}/.{shard}-{uuid.uuid4().hex}"
                with store.open_output_stream(mine) as out:
                    out.write(data.tobytes())
                store.move(mine, name)
            crc = [zlib.crc32(data[x]) for x in place]
            return pa.RecordBatch.from_arrays([ids, seq, slot, pa.array(np.full(len(place), shard)), pa.array(place * length * width), tokens, pa.array(crc, pa.int64())], ["doc_id", "seq", "slot", "shard", "byte_offset", "n_tokens", "crc32"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for i, shard in enumerate(batch[0].to_pylist()):
                if held and held[0][0][0].as_py() != shard:
                    yield close(held[0][0][0].as_py(), held)
                    held = []
                held.append(batch.slice(i, 1))
        if held:
            yield close(held[0][0][0].as_py(), held)

    n_shards = max(1, -(-total // slots_per_shard))
    placed = rows.mapInArrow(number, f"shard long, doc_id array<{kind}>, seq array<long>, slot array<long>, n_tokens array<long>, data binary")
    # Ranges of equal numbers of shards: the permutation fills all alike, so that no sample of the keys is needed.
    tasks = min(n_shards, MOST_TASKS)
    ranged = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / n_shards).cast("int")).sortWithinPartitions("shard")
    return ranged.mapInArrow(write, f"doc_id {kind}, seq long, slot long, shard long, byte_offset long, n_tokens long, crc32 long")


def read_slots(folder: str, first: int, n: int, length: int = 512, dtype: str = "u1", slots_per_shard: int = 16384) -> Iterator[np.ndarray]:
    """Sequences of slots first, first+1, ...: sequential reads, resumable at any slot."""
    stride = length * np.dtype(dtype).itemsize
    store, root = open_store(folder)
    while n > 0:
        shard, inside = divmod(first, slots_per_shard)
        take = min(n, slots_per_shard - inside)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(inside * stride)
            yield from np.frombuffer(f.read(take * stride), dtype).reshape(-1, length)
        first, n = first + take, n - take


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-token sequences in keyed training order; the index of the written shards."""
    return training_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "shards"), key=20240607)
