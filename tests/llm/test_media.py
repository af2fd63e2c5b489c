import hashlib
import io
import zlib

import numpy as np
import pytest

from starloom.llm import media


def padded(t):
    raw = (t or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))


def test_round_trip(spark, make_docs):
    given = ["", None, "x", "é" * 288, "y" * 576, "z" * 577, "日本" * 5000, "x"]
    docs = make_docs(given).withColumnRenamed("lang", "feature")
    got = {r["doc_id"]: r for r in media.media_digest(docs).collect()}
    for i, t in enumerate(given):
        p = padded(t)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len((t or "").encode()), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(p[-32:])
    assert {c: got[2][c] for c in ("media_sha256", "feature")} == {c: got[7][c] for c in ("media_sha256", "feature")}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.text_media(docs).collect()}
    for i, x in stored.items():
        assert (len(x), hashlib.sha256(x).hexdigest()) == (got[i]["media_bytes"], got[i]["media_sha256"])
    assert media.media_digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("encode", media.ENCODERS)
def test_formats(encode):
    payload = np.random.default_rng(1).integers(0, 256, 576 * 3, np.uint8).tobytes()
    assert media.decode(encode(payload)).tobytes() == payload


def test_other_netpbm():
    assert media.decode(b"P1 # c\n2 2\n1 0\n01").ravel().tolist() == [0, 255, 255, 0]
    assert media.decode(b"P2\n2 1\n15\n0 15\n").ravel().tolist() == [0, 255]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").ravel().tolist() == [1, 2, 3]
    assert media.decode(b"P4\n3 1\n\xa0").ravel().tolist() == [0, 255, 0]
    for bad in (b"", b"GIF89a", b"P5\n2 2\n255\n1", b"BM", b"P5\n0 1\n255\n"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_mean_over_areas():
    pixels = np.random.default_rng(2).integers(0, 256, (12, 18, 3), np.uint8)
    got = media.area_resize(pixels, 4, 6)
    want = pixels.reshape(4, 3, 6, 3, 3).mean(axis=(1, 3))
    assert np.abs(got - want).max() <= 0.5
    # fractional cells: every pixel repeated, then averaged
    big = pixels.repeat(5, axis=0).repeat(7, axis=1).reshape(5, 12, 7, 18, 3).mean(axis=(1, 3))
    assert np.abs(media.area_resize(pixels, 5, 7) - big).max() <= 0.5001


def test_strips_give_the_same_image(monkeypatch):
    pixels = np.random.default_rng(4).integers(0, 256, (101, 24, 3), np.uint8)
    want = media.area_resize(pixels, 16, 16), media.difference_hash(pixels)
    monkeypatch.setattr(media, "STRIP", 200)
    assert (media.area_resize(pixels, 16, 16) == want[0]).all() and media.difference_hash(pixels) == want[1]


def test_difference_hash_by_hand():
    # each row of 9 cells grows to the right, but the last row falls
    grid = np.tile(np.arange(9, dtype=np.uint8) * 20, (8, 1))
    grid[7] = grid[7, ::-1]
    assert media.difference_hash(grid.repeat(2, axis=0).repeat(3, axis=1)[:, :, None]) == "ff" * 7 + "00"


@pytest.mark.parametrize("bad", [b"P5 99999999999999999999 2 255\n", b"P4 4000000000 4000000000\n", b"P2 1 1 255\n99999999999999999999999", b"P6 1 1 70000\n", b"BM" + b"\xff" * 60, b"BM" + bytes(52), b"P5 2 2 x\n"])
def test_bad_sizes_are_errors_of_their_rows(spark, bad):
    with pytest.raises(ValueError):
        media.decode(bad)
    df = spark.createDataFrame([(1, bad), (None, None)], "id long, media binary")
    assert {r["id"]: bool(r["error"]) for r in media.decode_media(df, "id", "media").collect()} == {1: True, None: False}


def test_tiles(spark):
    rows = [(1, media.encode_ppm(bytes(range(256)) * 6 + bytes(192))), (2, b"nothing"), (3, None)]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = {r["id"]: r for r in media.decode_media(df, "id", "media", 8, 8).collect()}
    tile = np.load(io.BytesIO(bytes(got[1]["tile"])))
    assert tile.shape == (8, 8, 3) and len(got[1]["dhash"]) == 16
    assert got[2]["tile"] is None and got[2]["error"] and got[3]["tile"] is None and got[3]["error"] is None
