import hashlib
import zlib

import numpy as np
import pytest

from langlens.llm import media, tokenfiles

from .docs import BASE, empty, frame, write


def key(r):
    return (r[0] is None, r[0], *map(str, r[1:]))


@pytest.mark.parametrize("n", [0, 1, 64, 65, 64 * 64, 64 * 64 * 3 + 5])
def test_media_round_trip(n):
    data = bytes(i * 7 % 256 for i in range(n))
    stored = media.pack(data)
    seen = media.probe(stored)
    assert media.payload(stored, seen).rstrip(b"\0") == data.rstrip(b"\0")
    assert seen["codec"] == "raw8" and seen["duration"] == seen["ticks"] == 20 * len(seen["samples"])
    assert b"".join(stored[a:b] for a, b in seen["keyframes"]) == media.payload(stored, seen)


def test_media_digests(spark):
    rows = media.media_digests(frame(spark)).collect()
    want = []
    for i, t in BASE:
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        want.append((i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((tuple(r)[:5] for r in rows), key=key) == sorted(want, key=key)
    assert media.media_digests(empty(spark)).collect() == []


def test_media_tracks(spark):
    df = spark.createDataFrame([(1, media.pack(b"abc")), (2, None), (3, b"\0\0\0\x20moov"), (4, b"junk" * 9)], "media_id long, data binary")
    got = {r.media_id: r for r in media.media_tracks(df).collect()}
    assert got[1].codec == "raw8" and got[1].n_samples == 1 and got[1].error is None
    assert all(got[i].error for i in (2, 3, 4))


def test_tracks_have_their_own_tables(spark):
    """A track without stss before one that has it, in one file: made of two files of one track."""
    one, two = media.pack(b"a" * 64 * 40, key_every=1), media.pack(b"b" * 64 * 40, key_every=4)
    trak = lambda data: next(data[body - 8 : stop] for path, body, stop in media.walk(data) if path == (b"moov", b"trak"))
    plain = trak(one).replace(b"stss", b"free")
    data = media._box(b"moov", plain, trak(two))
    first, second = media.tracks(data)
    assert len(first["keyframes"]) == 40 and second["keyframes"] == media.probe(two)["keyframes"] and len(second["keyframes"]) == 10
    table = spark.createDataFrame([("x", data), ("y", None), (None, one)], "media_id string, data binary")
    rows = [(r.media_id, len(r.keyframes or []), r.error is None) for r in media.media_tracks(table, every=True).collect()]
    assert sorted(rows, key=str) == sorted([("x", 40, True), ("x", 10, True), ("y", 0, False), (None, 40, True)], key=str)
    assert media.media_tracks(table).count() == 3


def test_fragmented_files():
    """A movie without samples and two fragments: fields of the run, of the fragment, and of the movie."""
    import struct

    box, full = media._box, media._full
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", b"\0" * 8)), full(b"stts", struct.pack(">I", 0)), full(b"stsc", struct.pack(">I", 0)), full(b"stsz", struct.pack(">II", 0, 0)), full(b"stco", struct.pack(">I", 0)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7) + b"\0" * 68), box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 90, 0)), box(b"minf", stbl)))
    head = box(b"ftyp", b"iso5") + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 30, 5, 0x10000))))

    def fragment(tfhd, trun, payload):
        size = len(box(b"moof", box(b"traf", tfhd, trun(0))))
        return box(b"moof", box(b"traf", tfhd, trun(size + 8))) + box(b"mdat", payload)

    one = fragment(full(b"tfhd", struct.pack(">I", 7), flags=0x20000), lambda at: full(b"trun", struct.pack(">IiI", 3, at, 0), flags=0x5), b"aaaaabbbbbccccc")
    two = fragment(full(b"tfhd", struct.pack(">II", 7, 40), flags=0x20008), lambda at: full(b"trun", struct.pack(">Ii", 3, at), struct.pack(">6I", 4, 0, 2, 0x10000, 3, 0), flags=0x601), b"ddddeefff")
    data = head + one + two
    (track,) = media.tracks(data)
    assert media.payload(data, track) == b"aaaaabbbbbcccccddddeefff" and track["codec"] == "avc1" and track["ticks"] == 3 * 30 + 3 * 40
    assert [data[a:b] for a, b in track["keyframes"]] == [b"aaaaabbbbbccccc", b"ddddee", b"fff"]


def test_separator_scan_blocks(spark, tmp_path):
    ids = np.random.default_rng(1).integers(0, 6, 1000).astype("<u2")
    ids[100:400] = 3
    ids.tofile(tmp_path / "a.bin")
    np.array([5, 5], "<u2").tofile(tmp_path / "b.bin")
    np.array([], "<u2").tofile(tmp_path / "c.bin")
    for block in (7, 64, 5000):
        got = sorted(map(tuple, tokenfiles.token_counts(spark, f"file://{tmp_path}", eod=5, block_tokens=block).collect()))
        ends = np.flatnonzero(ids == 5)
        starts = np.concatenate([[0], ends + 1])
        want = [("a.bin", i, int(a), int(b - a)) for i, (a, b) in enumerate(zip(starts, np.concatenate([ends, [1000]]))) if not (a == 1000)]
        assert got == want + [("b.bin", 0, 0, 0), ("b.bin", 1, 1, 0)]
    (tmp_path / "d.bin").write_bytes(b"odd")
    with pytest.raises(ValueError):
        tokenfiles.token_counts(spark, f"file://{tmp_path}")


def test_op10(spark, tmp_path):
    import public_tokenizers

    enc = tokenfiles.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = tokenfiles.op10_token_counts(spark, write(spark, tmp_path)).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, len(enc.encode_ordinary(t or ""))) for i, t in BASE), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = tokenfiles.feistel(np.arange(n), n, 7)
    assert sorted(got) == list(range(n))
    assert n < 100 or (got != tokenfiles.feistel(np.arange(n), n, 8)).any()


def test_training_shards(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    src = spark.read.parquet(write(spark, tmp_path) + "/documents.parquet")
    rows = tokenfiles.training_shards(src, folder, key=3, length=64, slots_per_shard=16).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    data = list(tokenfiles.read_slots(folder, 0, len(rows), 64, slots_per_shard=16))
    by = {}
    for r in sorted(rows, key=lambda r: r.slot):
        assert zlib.crc32(data[r.slot].tobytes()) == r.crc32 and r.byte_offset == r.slot % 16 * 64 and r.shard == r.slot // 16
        by.setdefault(r.doc_id, {}).setdefault(r.seq, []).append(data[r.slot][: r.n_tokens].tobytes())
    for i, t in BASE:
        if i != 2:
            assert b"".join(by[i][k][0] for k in sorted(by[i])) == (t or "").encode()
    again = [x.tobytes() for x in tokenfiles.read_slots(folder, 20, 30, 64, slots_per_shard=16)]
    assert again == [x.tobytes() for x in data[20:50]]
    assert tokenfiles.training_shards(empty(spark), folder + "2", key=3).collect() == []


def test_training_shards_of_token_ids_go_on_by_the_manifest(spark, tmp_path):
    folder = f"file://{tmp_path}/ids"
    spark.createDataFrame([(i, [(i * 7 + k) % 50_000 for k in range(i * 3 % 40)], "x") for i in range(50)] + [(None, None, "y")], "doc_id long, tokens array<int>, slot string").repartition(3).write.parquet(f"{tmp_path}/t")
    src = spark.read.parquet(f"{tmp_path}/t")
    args = {"key": 5, "length": 8, "dtype": "<u2", "slots_per_shard": 16, "ids_col": "tokens"}
    rows = sorted(map(tuple, tokenfiles.training_shards(src, folder, **args).collect()), key=str)
    data = list(tokenfiles.read_slots(folder, 0, len(rows), 8, "<u2", 16))
    got = {}
    for i, _, slot, _, _, n, _ in sorted(rows, key=lambda r: r[1]):
        got.setdefault(i, []).extend(data[slot][:n].tolist())
    assert got == {**{i: [(i * 7 + k) % 50_000 for k in range(i * 3 % 40)] for i in range(50)}, None: []}
    shards = sorted(p for p in (tmp_path / "ids").iterdir() if p.name.startswith("shard"))
    lost, kept = shards[0], shards[1]
    whole, stamp = lost.read_bytes(), kept.stat().st_mtime_ns
    lost.unlink()
    assert sorted(map(tuple, tokenfiles.training_shards(src, folder, **args).collect()), key=str) == rows
    assert lost.read_bytes() == whole and kept.stat().st_mtime_ns == stamp
    with pytest.raises(ValueError):
        tokenfiles.training_shards(src, folder, **args | {"key": 6})


def test_media_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "x"), (None, None)], "doc_id string, text string")
    assert {r.doc_id: r.n_bytes for r in media.media_digests(docs).collect()} == {"a": 1, None: 0}
    rows = spark.createDataFrame([("k", bytearray(media.pack(b"abc")))], "media_id string, data binary")
    assert media.media_tracks(rows).first().media_id == "k"


def test_media_bytes_are_those_of_the_container(spark):
    rows = {r.doc_id: r for r in media.media_digests(frame(spark)).collect()}
    for i, t in BASE:
        stored = media.pack((t or "").encode())
        keys = ",".join(f"{a}-{b}" for a, b in media.probe(stored)["keyframes"])
        n = -(-max(1, len((t or "").encode())) // 64)
        assert (rows[i].media_bytes, rows[i].media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert rows[i].feature == f"codec=raw8;timescale=1000;duration={20 * n};samples={n};keyframes={keys}"
