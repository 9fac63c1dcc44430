"""Byte-level BPE: Spark higher-order functions fold ranked merges over the distinct words of all documents.

(1) A scan cuts texts at the pre-tokenisation pattern and gives, for a block of documents, its distinct words, dealt
to buckets by their hashes; the words' order in the block goes to a file in shared storage. (2) A bucket's words
of all blocks meet, so that each distinct word of the corpus is encoded once: DataFrame expressions fold merges over
its bytes with a rank map, and decode it again by concatenating the ids' binary pieces. (3) The codes go back
to their blocks, where the documents' ids and bytes are put together. In the fold, bytes are strings of the code points
0 to 255. Words of more than LONG_WORD bytes, for which a fold of immutable arrays would take quadratic time, are
encoded by a heap of merges instead; they too are decoded from their ids.

Null texts are empty texts, which have no ids. Rows that repeat, and rows with null ids, are rows of their own. An empty
table gives no rows. Columns that aren't asked for are ignored. The input must be repeatable, such as a table.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, flat, open_store, quoted, ragged, shared_dir, slice_hashes, steps, trim

LONG_WORD = 200
#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 24 << 20
#: References to words that one row of a bucket holds; a larger bucket is several rows.
ROW_WORDS = 1 << 20
#: Words that are put together at a time; a longer document is a step of its own.
STEP_WORDS = 200_000
_BUCKETS = 8192


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


# Words ----------------------------------------------------------------------------------------------------

#: Classes of bytes in plain texts: 0 other, 1 letter, 2 number, 3 white space.
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[0xC3] = 1
_CLASS[128:192] = 1
_WHITE = r"\x09-\x0D\x20\x85\xA0  -     　"


@lru_cache(1)
def _general():
    """The pattern with white space as Unicode has it, whatever the library takes \\s for."""
    import public_tokenizers
    import regex

    p = public_tokenizers.PATTERN.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")
    return regex.compile(p)


def _plain(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of ASCII and letters U+00C0 to U+00FF alone."""
    lead = raw == 0xC3
    odd = (raw >= 0x80) & ~lead
    odd[1:] &= ~lead[:-1]
    odd[1:] |= lead[:-1] & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    total = np.concatenate([[0], np.cumsum(odd | (raw > 0xC3))])
    return total[at[1:]] == total[at[:-1]]


def split_plain(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mask of the bytes at which a match of the pattern starts; every row is plain."""
    n = len(raw)
    kind = _CLASS[raw]
    begin = np.ones(n, bool)
    begin[1:] = kind[1:] != kind[:-1]
    begin[at[:-1][np.diff(at) > 0]] = True
    run = begin.copy()
    doc_end = np.zeros(n + 1, bool)
    doc_end[at] = True
    nxt = np.flatnonzero(run[1:] & ~doc_end[1:n]) + 1 if n else np.zeros(0, np.int64)  # runs with a run before them in the row
    after = nxt[kind[nxt - 1] == 3]  # runs that follow white space
    begin[after - 1] = True
    begin[after[raw[after - 1] == 32]] = False
    quote = np.flatnonzero((raw == 39) & begin & run)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == 1) & ~doc_end[quote + 1]]
    a = raw[quote + 1]
    second = np.minimum(quote + 2, n - 1)
    b = np.where((quote + 2 < n) & ~doc_end[quote + 2], raw[second], 0)
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    hit = one | two
    begin[quote[hit] + 1] = False
    rest = quote[hit] + np.where(one[hit], 2, 3)
    begin[rest[rest < n]] = True
    return begin


def split_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all words, and the rows' offsets in them (words tile each text)."""
    plain = _plain(raw, at)
    if plain.all():
        begin = split_plain(raw, at)
    else:
        begin = np.zeros(len(raw), bool)
        pick = np.flatnonzero(plain)
        size = np.diff(at)
        where = np.repeat(plain, size)
        begin[where] = split_plain(raw[where], np.concatenate([[0], np.cumsum(size[pick])]))
        for i in np.flatnonzero(~plain):
            text = raw[at[i] : at[i + 1]].tobytes().decode()
            width = np.cumsum([0, *(len(m.encode()) for m in _general().findall(text))])
            begin[at[i] + width[:-1]] = True
    start = np.flatnonzero(begin)
    return start, np.searchsorted(start, at)


# Merges ---------------------------------------------------------------------------------------------------


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by a heap of candidate merges: lowest rank first, leftmost among equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))  # end of the piece that starts here
    start_of = list(range(n))  # start of the piece that ends after here
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        alive[end[i]] = False
        end[i] = stop
        start_of[stop - 1] = i
        if stop < n and (r := ranks.get(word[i : end[stop]])) is not None:
            heapq.heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(word[(j := start_of[i - 1]) : stop])) is not None:
            heapq.heappush(heap, (r, j, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: lambdas don't share subexpressions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """One row: maps, the rank maps dealt out by CRC-32, as a map lookup scans its keys; pieces, the byte strings by rank.

    A table to be broadcast, as the text of a literal of this size is part of each description of the plan, of which the
    driver makes and keeps several for a query."""
    dealt: list[list[tuple[str, int]]] = [[] for _ in range(_BUCKETS)]
    pieces = [""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        s = pieces[v] = k.decode("latin-1")
        dealt[zlib.crc32(s.encode()) % _BUCKETS].append((s, v))
    kinds = {"maps": pa.list_(pa.map_(pa.string(), pa.int32())), "pieces": pa.list_(pa.string())}
    return spark.createDataFrame(pa.table({k: pa.array([x], kind) for (k, kind), x in zip(kinds.items(), (dealt, pieces))}))


def rank_of(maps: Column):
    """Column -> Column: the rank of a byte string, null if it has none."""
    return lambda s: F.element_at(F.get(maps, (F.crc32(s.cast("binary")) % _BUCKETS).cast("int")), s)


def encode_word(rank, word: Column) -> Column:
    """array<int> of a word's ids: the whole word if it has a rank, else a fold that merges the lowest-ranked pair
    (leftmost among equals) until no pair has a rank."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(word, i, 1))
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: rank(F.substring(word, i, 2)))
    none = F.array().cast("array<int>")

    def merge(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]
        return _let(F.array_position(r, F.array_min(r)).cast("int"), lambda k: F.when(k.isNull(), state).otherwise(_let(F.concat(F.get(p, k - 1), F.get(p, k)), lambda both: joined(p, r, k, both))))

    def joined(p: Column, r: Column, k: Column, both: Column) -> Column:
        left = F.when(k > 2, F.concat(F.slice(r, F.lit(1), k - 2), F.array(rank(F.concat(F.get(p, k - 2), both))))).when(k > 1, F.array(rank(F.concat(F.get(p, k - 2), both)))).otherwise(none)
        right = F.when(k < F.size(r), F.concat(F.array(rank(F.concat(both, F.get(p, k + 1)))), F.slice(r, k + 2, F.size(r)))).otherwise(none)
        merged = F.concat(F.slice(p, F.lit(1), k - 1), F.array(both), F.slice(p, k + 2, F.size(p)))
        return F.struct(merged.alias("p"), F.concat(left, right).alias("r"))

    start = F.struct(pieces.alias("p"), pairs.alias("r"))
    fold = F.aggregate(F.sequence(F.lit(2), F.length(word)), start, merge, lambda s: F.transform(s["p"], rank))
    return _let(F.struct(word.alias("w"), rank(word).alias("r")), lambda x: F.when(x["r"].isNotNull(), F.array(x["r"])).otherwise(fold))


def decode_ids(pieces: Column, ids: Column) -> Column:
    """The bytes of ids: their binary pieces, concatenated."""
    return F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")


# Documents ------------------------------------------------------------------------------------------------


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 32, byte plane by byte plane, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _unplanes(data: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(raw.T).view("<u4").ravel().astype(kind, copy=False)


def _binary(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The slices of raw as a binary column."""
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ragged(raw, start, size)))])


def _word_rows(docs: DataFrame, names: list[str], folder: str, buckets: int) -> DataFrame:
    """Step 1: block, bucket, numbers, words of all blocks. Each block's file has its rows' `names`, their numbers of words
    and the words' numbers in order; the most frequent word of a block has the number 0."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = TaskContext.get().partitionId() << 32
        own: list[pa.RecordBatch] = []
        parts: list[tuple] = []  # of each step: its distinct words and their counts; the words in order; words of each row
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal serial, own, parts, size
            every = pa.concat_arrays([x[0] for x in parts]).dictionary_encode()  # by their bytes, not by a hash
            number, distinct = np.asarray(every.indices), every.dictionary
            count = np.bincount(number, np.concatenate([x[1] for x in parts]), len(distinct))
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order))
            shift = np.cumsum([0, *(len(x[0]) for x in parts)])
            numbers = np.concatenate([place[number[a:b]][x[2]] for x, a, b in zip(parts, shift, shift[1:])])
            schema = pa.schema([*own[0].schema, ("n_words", pa.int64())])
            counts = pa.array(np.concatenate([x[3] for x in parts]))
            table = pa.table([*pa.Table.from_batches(own).columns, counts], schema=schema)
            store, root = open_store(folder)
            store.create_dir(root, recursive=True)
            mine = f"{root}/.{uuid.uuid4().hex}"
            with store.open_output_stream(mine) as out:
                with pa.ipc.new_stream(out, table.schema.with_metadata({"words": str(len(numbers))})) as to:
                    to.write_table(table.replace_schema_metadata({"words": str(len(numbers))}))
                out.write(_planes(numbers))
            store.move(mine, f"{root}/{serial}.bin")
            raw, at = flat(distinct.take(pa.array(order)))
            at, width = at[:-1], np.diff(at)
            bucket = (slice_hashes(raw, at, at + width) % np.uint64(buckets)).astype(np.int64)
            deal = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[deal])) + 1, [len(deal)]]) if len(deal) else np.zeros(2, np.int64)
            where = bucket[deal][cuts[:-1]] if len(deal) else np.array([serial % buckets])
            words = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), _binary(raw, at[deal], width[deal]))
            dealt = [_planes(np.diff(deal[a:b], prepend=0)) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), serial)), pa.array(where), pa.array(dealt, pa.binary()), words], ["block", "bucket", "numbers", "words"])
            serial, own, parts, size = serial + 1, [], [], 0
            trim()

        for batch in batches:
            raw_all, at_all = flat(batch[k])
            for lo, hi in steps(at_all):
                raw, at = raw_all[at_all[lo] : at_all[hi]], at_all[lo : hi + 1] - at_all[lo]
                if own and size + len(raw) > BLOCK_BYTES:
                    yield from close()
                start, by_doc = split_words(raw, at)
                each = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.append(start, len(raw)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
                each = each.dictionary_encode()
                number = np.asarray(each.indices).astype(np.uint32)
                own.append(pa.RecordBatch.from_arrays([batch[i].take(pa.array(np.arange(lo, hi))) for i in range(k)], names))  # copies, as a slice keeps the texts
                parts.append((each.dictionary, np.bincount(number, minlength=len(each.dictionary)), number, np.diff(by_doc)))
                size += len(raw)
        if own:
            yield from close()

    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    return docs.select(*names, text).mapInArrow(run, "block long, bucket long, numbers binary, words array<binary>")


def _met(rows: DataFrame, parts: int) -> DataFrame:
    """The buckets' distinct words; blocks, numbers and refs: for each block the places of its words in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, head = 0, None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                every = pa.concat_arrays([w for _, _, w in held]).dictionary_encode()
                index = np.asarray(every.indices).astype("<u4")
                cut = np.cumsum([0, *(len(w) for _, _, w in held)])
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                words = pa.ListArray.from_arrays(pa.array([0, len(every.dictionary)], pa.int32()), every.dictionary)
                refs = [index[a:b].tobytes() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([one([x[0] for x in held], pa.int64()), one([x[1] for x in held], pa.binary()), one(refs, pa.binary()), words], ["blocks", "numbers", "refs", "words"])

        for b in batches:
            for i, (block, bucket, numbers) in enumerate(zip(*(b[j].to_pylist() for j in range(3)))):
                if held and (bucket != head or size > ROW_WORDS):
                    yield from close()
                    held, size = [], 0
                head = bucket
                held.append((block, numbers, b[3].slice(i, 1).flatten()))
                size += len(held[-1][2])
        yield from close()
        held = []
        trim()

    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, "blocks array<long>, numbers array<binary>, refs array<binary>, words array<binary>")


def encoded_words(met: DataFrame, vocabulary: str) -> DataFrame:
    """Step 2: blocks, numbers, refs, words, codes (array<int> of each word, null for long ones) and decoded (binary)."""
    rank, pieces = rank_of(F.col("maps")), F.col("pieces")
    latin = lambda w: F.decode(w, "ISO-8859-1")
    codes = F.transform("words", lambda w: F.when(F.length(w) <= LONG_WORD, _let(latin(w), lambda x: encode_word(rank, x))))
    decoded = F.transform("codes", lambda c: F.when(c.isNotNull(), F.encode(decode_ids(pieces, c), "ISO-8859-1")))
    coded = met.crossJoin(F.broadcast(rank_table(met.sparkSession, load_ranks(vocabulary)))).withColumn("codes", codes)
    return coded.select(*met.columns, "codes", decoded.alias("decoded"))


def _returned(coded: DataFrame, vocabulary: str) -> DataFrame:
    """block, data: the codes and bytes of some of a block's words, with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocabulary)
        bytes_of = {i: b for b, i in ranks.items()}
        for batch in batches:
            for row in range(batch.num_rows):
                blocks, numbers, refs = (batch[j][row].as_py() for j in range(3))
                codes, decoded = (batch[j].slice(row, 1).flatten() for j in (4, 5))
                if codes.null_count:  # long words: encoded here, and decoded from their ids
                    words, some, back = batch[3].slice(row, 1).flatten().to_pylist(), codes.to_pylist(), decoded.to_pylist()
                    for i, c in enumerate(some):
                        if c is None:
                            some[i] = merge_long(words[i], ranks)
                            back[i] = b"".join(map(bytes_of.__getitem__, some[i]))
                    codes, decoded = pa.array(some, pa.list_(pa.int32())), pa.array(back, pa.binary())
                size = np.asarray(codes.value_lengths()).astype(np.int64)
                ids, first = np.asarray(codes.flatten()), np.cumsum(size) - size
                raw, at = flat(decoded)
                width = np.diff(at)
                out = []
                for number, ref in zip(numbers, refs):
                    mine = np.frombuffer(ref, "<u4").astype(np.int64)
                    cols = (size[mine], width[mine], ragged(ids, first[mine], size[mine]))
                    texts = pa.compress(ragged(raw, at[mine], width[mine]).tobytes(), "zstd", asbytes=True)
                    blobs = [number, *map(_planes, cols), texts]
                    head = np.array([len(mine), len(cols[2]), int(cols[1].sum()), *map(len, blobs)], "<i8").tobytes()
                    out.append(head + b"".join(blobs))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(out, pa.binary())], ["block", "data"])
        trim()

    return coded.mapInArrow(run, "block long, data binary")


def _dictionary(rows: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all words of a block, by number: how many ids, the ids, how many bytes, the bytes."""
    number, size, width, ids, texts = [], [], [], [], []
    for data in rows:
        n, n_ids, n_bytes, *lengths = np.frombuffer(data, "<i8", 8).tolist()
        cut = np.cumsum([64, *lengths]).tolist()
        part = [data[a:b] for a, b in zip(cut, cut[1:])]
        number.append(np.cumsum(_unplanes(part[0], n)))
        size.append(_unplanes(part[1], n))
        width.append(_unplanes(part[2], n))
        ids.append(_unplanes(part[3], n_ids))
        texts.append(np.frombuffer(pa.decompress(part[4], n_bytes, "zstd", asbytes=True), np.uint8))
    number, size, width, ids, texts = (np.concatenate(x) for x in (number, size, width, ids, texts))
    order = np.argsort(number)
    if not np.array_equal(number[order], np.arange(len(number))):
        raise RuntimeError("words of a block are missing; the input must be a table")
    return size[order], ragged(ids, (np.cumsum(size) - size)[order], size[order]), width[order], ragged(texts, (np.cumsum(width) - width)[order], width[order])


def _decimal(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """'0 1 2 ... ' as bytes, with each number's place and length (its space included)."""
    texts = [b"%d " % i for i in range(n)]
    length = np.array([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(length) - length, length


def assembled(docs: DataFrame, names: list[str], vocabulary: str, with_ids: bool = False) -> DataFrame:
    """A row for each document: `names`, n_tokens, ids_sha256, decoded_sha256 or, with_ids, ids and the decoded text."""
    spark = docs.sparkSession
    # Numbered meanwhile, as names may have dots.
    given, names = names, [f"c{i}" for i in range(len(names))]
    docs = docs.select(*(F.col(quoted(n)).alias(c) for n, c in zip(given, names)), "text")
    kinds = {n: docs.schema[n].dataType.simpleString() for n in names}
    rest = "ids array<int>, decoded string" if with_ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = shared_dir(spark, "blocks")
    k = len(names)

    def put_together(block: int, rows: list[bytes], pool: np.ndarray, place: np.ndarray, width: np.ndarray) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        with store.open_input_file(f"{root}/{block}.bin") as f:
            with pa.ipc.open_stream(f) as stream:
                total = int(stream.schema.metadata[b"words"])
                table = stream.read_all().combine_chunks()
            number = _unplanes(f.read(), total, np.uint32)
        n_words = np.asarray(table["n_words"])
        size, ids, bsize, pieces = _dictionary(rows)
        first, bfirst = np.cumsum(size) - size, np.cumsum(bsize) - bsize
        every = np.concatenate([[0], np.cumsum(n_words)])
        for lo, hi in steps(every, STEP_WORDS):
            mine, cut = number[every[lo] : every[hi]].astype(np.int64), every[lo : hi + 1] - every[lo]
            ends = lambda n: np.concatenate([[0], np.cumsum(n)])[cut]  # noqa: B023, E731
            btext, bcut, tcut = ragged(pieces, bfirst[mine], bsize[mine]), ends(bsize[mine]), ends(size[mine])
            mids = ragged(ids, first[mine], size[mine])
            own = [table.column(i).slice(lo, hi - lo).combine_chunks() for i in range(k)]
            own = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in own]
            if with_ids:
                out = [pa.ListArray.from_arrays(pa.array(tcut, pa.int32()), pa.array(mids.astype(np.int32))), pa.array([btext[a:b].tobytes().decode() for a, b in zip(bcut, bcut[1:])], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *out], [*names, "ids", "decoded"])
                continue
            wide = width[mids]
            text, dcut = ragged(pool, place[mids], wide), np.concatenate([[0], np.cumsum(wide)])[tcut]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(np.diff(tcut)), pa.array([sha(text[a : max(a, b - 1)]) for a, b in zip(dcut, dcut[1:])], pa.string()), pa.array([sha(btext[a:b]) for a, b in zip(bcut, bcut[1:])], pa.string())],
                [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = _decimal(max(load_ranks(vocabulary).values()) + 1)
        head, held = None, []
        for batch in batches:
            for block, data in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                if held and block != head:
                    yield from put_together(head, held, *digits)
                    held = []
                    trim()
                head = block
                held.append(data)
        if held:
            yield from put_together(head, held, *digits)
        trim()

    rows = _word_rows(docs, names, folder, min(8192, 16 * parts))
    back = _returned(encoded_words(_met(rows, parts), vocabulary), vocabulary)
    return back.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kinds.items()) + f", {rest}").toDF(*given, *(x.split()[0] for x in rest.split(", ")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; a null text has no ids."""
    import public_tokenizers

    docs = documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return assembled(docs, ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"))
