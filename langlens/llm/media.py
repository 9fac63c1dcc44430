"""Media columns: payloads stored in ISO base media containers, read back by walking the boxes.

`pack` writes ftyp, mdat and moov (one track of fixed-size raw samples); `probe` walks nested boxes of any
such file, decodes the sample tables (stts, stsc, stsz, stco/co64, stss) and gives codec, duration and the
byte range of every keyframe group, without looking at the payload; `payload` reads the samples through the
tables. Null and empty payloads are padded to one unit; equal payloads give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

UNIT = 64
TIMESCALE = 1000
SAMPLE_TICKS = 20
KEY_EVERY = 16
CODEC = b"raw8"
_CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"dinf", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 >= 1 << 32:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pack(data: bytes, unit: int = UNIT, key_every: int = KEY_EVERY, chunk: int = 64) -> bytes:
    """A container whose samples are the units of data (padded with zero bytes to a positive multiple)."""
    data += b"\0" * (-len(data) % unit if data else unit)
    n = len(data) // unit
    keys = range(1, n + 1, key_every)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    large = len(data) + 8 >= 1 << 32
    first = len(head) + (16 if large else 8)
    offsets = range(first, first + len(data), chunk * unit)
    runs = [(1, chunk, 1)] if n % chunk == 0 else [(1, n % chunk, 1)] if n < chunk else [(1, chunk, 1), (len(offsets), n % chunk, 1)]
    ticks = n * SAMPLE_TICKS
    entry = _box(CODEC, b"\0" * 6, struct.pack(">H", 1))
    places = _full(b"co64", struct.pack(f">I{len(offsets)}Q", len(offsets), *offsets)) if large else _full(b"stco", struct.pack(f">I{len(offsets)}I", len(offsets), *offsets))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE_TICKS)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", unit, n)),
        _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        places,
    )
    minf = _box(b"minf", _full(b"nmhd"), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
    mdia = _box(b"mdia", mdhd, _full(b"hdlr", struct.pack(">I4s12x", 0, b"meta"), b"samples\0"), minf)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0, 0), matrix, struct.pack(">II", 0, 0), version=1, flags=3)
    mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), matrix, b"\0" * 24, struct.pack(">I", 2), version=1)
    return b"".join((head, _box(b"mdat", data), _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path, body start, body end) of every box, parents first. A box that overruns its parent is an error."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} overruns its parent")
        yield (*path, kind), body, stop
        if kind in _CONTAINERS:
            yield from walk(data, body, stop, (*path, kind))
        start = stop


def tracks(data: bytes | memoryview) -> list[dict]:
    """Of every track, in order of the file, its fragments (moof, trun) included: codec, timescale, duration (ticks), samples [(offset, size)], keyframes
    [(first byte, end byte)]. Each track has its own tables; one without stss has keyframes alone."""
    found: list[dict[bytes, tuple[int, int]]] = []
    for path, body, stop in walk(data):
        if path == (b"moov", b"trak"):
            found.append({})
        elif found and path[:2] == (b"moov", b"trak"):
            found[-1].setdefault(path[-1], (body, stop))
    out = [_track(data, at) for at in found]
    ids = [struct.unpack_from(">I", data, at[b"tkhd"][0] + (20 if data[at[b"tkhd"][0]] else 12))[0] if b"tkhd" in at else None for at in found]
    runs: dict[int, list] = {}
    for number, sample in _fragments(data):
        runs.setdefault(number, []).append(sample)
    for track, number in zip(out, ids, strict=True):
        if more := runs.get(number):
            first = len(track["samples"])
            track["samples"] += [(place, size) for place, size, _, _ in more]
            track["ticks"] += sum(ticks for *_, ticks in more)
            keys = [first + i for i, (_, _, key, _) in enumerate(more) if key]
            bounds = [*keys, len(track["samples"])]
            track["keyframes"] += [(track["samples"][a][0], sum(track["samples"][b - 1])) for a, b in zip(bounds, bounds[1:])]
    return out


def _fragments(data: bytes | memoryview) -> Iterator[tuple[int, tuple[int, int, bool, int]]]:
    """(track, (offset, size, whether a keyframe, ticks)) of the samples of movie fragments, in order: moof boxes have the
    runs of samples (trun), whose missing fields are those of the fragment (tfhd) or of the movie (trex)."""
    defaults: dict[int, tuple[int, int, int]] = {}
    moof = place = number = 0
    ticks = size = flags = 0

    def fields(at: int, have: int, *bits: int) -> Iterator[int | None]:
        for bit in bits:
            yield struct.unpack_from(">I", data, at)[0] if have & bit else None
            at += 4 if have & bit else 0

    for path, body, _ in walk(data):
        kind = path[-1]
        if kind == b"trex":
            number, _, *rest = struct.unpack_from(">5I", data, body + 4)
            defaults[number] = tuple(rest)
        elif kind == b"moof":
            moof = place = body - (8 if bytes(data[body - 4 : body]) == b"moof" else 16)
        elif kind == b"tfhd":
            have, number = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF, struct.unpack_from(">I", data, body + 4)[0]
            at = body + 8
            if have & 1:
                place, at = struct.unpack_from(">Q", data, at)[0], at + 8
            elif have & 0x20000:
                place = moof
            base = place
            given = list(fields(at, have, 2, 8, 16, 32))[1:]
            ticks, size, flags = (a if a is not None else b for a, b in zip(given, defaults.get(number, (0, 0, 0)), strict=True))
        elif kind == b"trun":
            have, n = struct.unpack_from(">I", data, body)[0] & 0xFFFFFF, struct.unpack_from(">I", data, body + 4)[0]
            at = body + 8
            if have & 1:
                place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
            first = next(fields(at, have, 4))
            at += 4 if have & 4 else 0
            step = 4 * bin(have & 0xF00).count("1")
            for i in range(n):
                own = list(fields(at + i * step, have, 0x100, 0x200, 0x400))
                t, z, f = (a if a is not None else b for a, b in zip(own, (ticks, size, flags), strict=True))
                f = first if i == 0 and first is not None else f
                yield number, (place, z, not f & 0x10000, t)
                place += z


def probe(data: bytes | memoryview) -> dict:
    """The first track of tracks(); a file without any is an error."""
    found = tracks(data)
    if not found:
        raise ValueError("no track")
    return found[0]


def _track(data: bytes | memoryview, at: dict[bytes, tuple[int, int]]) -> dict:
    u32 = lambda kind, skip, n: struct.unpack_from(f">{n}I", data, at[kind][0] + 4 + skip)
    version = data[at[b"mdhd"][0]]
    scale, duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"][0] + (20 if version else 12))
    codec = bytes(data[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
    size, n = u32(b"stsz", 0, 2)
    sizes = [size] * n if size else list(u32(b"stsz", 8, n))
    kind, form = (b"co64", "Q") if b"co64" in at else (b"stco", "I")
    places = struct.unpack_from(f">{u32(kind, 0, 1)[0]}{form}", data, at[kind][0] + 8)
    n_runs = u32(b"stsc", 0, 1)[0]
    flat = u32(b"stsc", 4, 3 * n_runs)
    runs = [flat[i : i + 3] for i in range(0, len(flat), 3)]
    per_chunk = []
    for i, (first, count, _) in enumerate(runs):
        last = runs[i + 1][0] if i + 1 < n_runs else len(places) + 1
        per_chunk += [count] * (last - first)
    samples, k = [], 0
    for place, count in zip(places, per_chunk, strict=True):
        for _ in range(count):
            samples.append((place, sizes[k]))
            place, k = place + sizes[k], k + 1
    keys = u32(b"stss", 4, u32(b"stss", 0, 1)[0]) if b"stss" in at else range(1, n + 1)
    bounds = [*keys, n + 1]
    ranges = [(samples[a - 1][0], samples[b - 2][0] + samples[b - 2][1]) for a, b in zip(bounds, bounds[1:])]
    times = u32(b"stts", 4, 2 * u32(b"stts", 0, 1)[0])
    return {"codec": codec, "timescale": scale, "duration": duration, "ticks": sum(a * b for a, b in zip(times[::2], times[1::2])), "samples": samples, "keyframes": ranges}


def payload(data: bytes, seen: dict | None = None) -> bytes:
    """The samples' bytes, read through the tables."""
    return b"".join(data[o : o + s] for o, s in (seen or probe(data))["samples"])


def feature(seen: dict) -> str:
    ranges = ",".join(f"{a}-{b}" for a, b in seen["keyframes"])
    return f"codec={seen['codec']};timescale={seen['timescale']};duration={seen['duration']};samples={len(seen['samples'])};keyframes={ranges}"


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_TRACKS = "codec string, timescale long, duration long, n_samples long, keyframes array<struct<start:long,end:long>>, error string"


def media_tracks(media: DataFrame, id_col: str = "media_id", data_col: str = "data", every: bool = False) -> DataFrame:
    """media_id (of any type), codec, duration and keyframe byte ranges of binary media, a row for each row: of its first
    track, or with `every` a row for each track in the file's order. Null, empty or damaged files: one row with null columns
    and an error. Null ids are kept; an empty table gives no rows."""
    kept = media.select(F.col(id_col).alias("media_id"), F.col(data_col).alias("data"))
    kind = kept.schema["media_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("error", pa.string())])
        for batch in batches:
            rows, of = [], []
            for i, data in enumerate(batch[1].to_pylist()):
                try:
                    found = tracks(data or b"") if every else [probe(data or b"")]
                    if not found:
                        raise ValueError("no track")
                    mine = [{"codec": x["codec"], "timescale": x["timescale"], "duration": x["duration"], "n_samples": len(x["samples"]), "keyframes": [{"start": a, "end": b} for a, b in x["keyframes"]], "error": None} for x in found]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    mine = [{"error": f"{type(e).__name__}: {e}"}]
                rows += mine
                of += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([batch[0].take(pa.array(of, pa.int64())), *pa.RecordBatch.from_pylist(rows, schema).columns], ["media_id", *schema.names])

    return kept.mapInArrow(run, f"media_id {kind}, {_TRACKS}")


def media_digests(docs: DataFrame) -> DataFrame:
    """Every text through a container and back: what was stored, and its features. Ids of any type, null ones too, are
    kept; null texts are empty; repeated rows are rows of their own; other columns are ignored."""
    rows = documents(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
        for batch in batches:
            out = []
            for text in batch[1].to_pylist():
                raw = (text or "").encode()
                stored = pack(raw)
                seen = probe(stored)
                back = payload(stored, seen)
                out.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(seen)))
            yield pa.RecordBatch.from_arrays([batch[0], *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, {_DIGEST}")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of every document; see media_digests for odd rows."""
    return media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
