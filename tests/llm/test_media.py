import hashlib
import io
import zlib

import numpy as np
import pytest

from larder.llm import media


def plain_area(image, height, width):
    """Cell means by summing each source sample's share of area."""
    h, w = image.shape
    out = np.zeros((height, width))
    for r in range(height):
        for c in range(width):
            y0, y1, x0, x1 = r * h / height, (r + 1) * h / height, c * w / width, (c + 1) * w / width
            total = 0.0
            for y in range(int(y0), min(h, int(np.ceil(y1)))):
                for x in range(int(x0), min(w, int(np.ceil(x1)))):
                    total += image[y, x] * max(0, min(y + 1, y1) - max(y, y0)) * max(0, min(x + 1, x1) - max(x, x0))
            out[r, c] = total / ((y1 - y0) * (x1 - x0))
    return out


@pytest.mark.parametrize("shape", [(1, 1), (3, 64), (17, 5), (8, 9), (40, 41)])
def test_area_resize_equals_sums_of_shares(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    for target in ((8, 9), (16, 16), (2, 3)):
        assert np.allclose(media.area_resize(image, *target), plain_area(image, *target))


def test_area_resize_in_bands(monkeypatch):
    image = np.random.default_rng(3).integers(0, 256, (97, 13)).astype(np.uint8)
    whole = media.area_resize(image, 16, 16)
    monkeypatch.setattr(media, "BAND", 40)
    assert np.allclose(media.area_resize(image, 16, 16), whole) and np.allclose(whole, plain_area(image, 16, 16))


def test_formats_round_trip():
    rng = np.random.default_rng(2)
    grey, colour = rng.integers(0, 256, (7, 5)).astype(np.uint8), rng.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    samples = lambda data: media.decode(data)[0]
    assert (samples(media.encode_pgm(grey)) == grey).all()
    assert (samples(media.encode_bmp(colour)) == colour).all()
    assert samples(media.encode_bmp(grey)).shape == (7, 5) and (samples(media.encode_bmp(grey)) == grey).all()
    assert (samples(b"P2 # note\n5 7\n# more\n255\n" + b" ".join(b"%d" % x for x in grey.ravel())) == grey).all()
    assert (samples(b"P6\n5 7 255\n" + colour.tobytes()) == colour).all()
    assert samples(b"P5 2 1 65535\n" + np.array([1, 40000], ">u2").tobytes()).tolist() == [[1, 40000]]
    assert samples(b"P1\n3 1\n1 0 1").tolist() == samples(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    palette = np.zeros((256, 4), np.uint8)
    palette[:, 2] = np.arange(256)
    bmp8 = bytearray(media.encode_bmp(grey))
    bmp8[54 : 54 + 1024] = palette.tobytes()
    assert (samples(bytes(bmp8))[:, :, 0] == grey).all()


def test_tiles_see_parts_of_the_sample_maximum(spark):
    images = {b"P1\n2 2\n0 0 0 0": 255, b"P1\n2 1\n0 1": (255, 0), b"P2\n1 1\n9\n3": 85, b"P5 2 1 65535\n\xff\xff\x80\x00": (255, 128), b"P4\n8 1\n\xf0": (0, 255)}
    rows = [(i, x, "old") for i, x in enumerate(images)]
    got = {r.k: r for r in media.features(spark.createDataFrame(rows, "k int, media binary, dhash string")).collect()}
    for i, want in enumerate(images.values()):
        tile = np.load(io.BytesIO(bytes(got[i].tile_npy)))
        assert (tile[0, 0], tile[0, -1]) == (want if isinstance(want, tuple) else (want, want)) and got[i].dhash != "old"


def test_texts_as_images(spark):
    texts = [None, "", "a", "ä" * 40, "x" * 64, "y" * 65, "z" * 300_000, "a"]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = sorted(media.features(media.store_texts(docs), keep_media=False).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        raw = (t or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert got[0][1:] == got[1][1:] and got[2][1:] == got[7][1:] and got[3].dhash != got[5].dhash
    assert media.features(media.store_texts(docs.limit(0))).count() == 0


def test_damaged_images(spark):
    images = [
        None, b"nothing", b"P5\n9 9\n255\nxx", b"BM", b"", b"P5\n0 0\n255\n", b"P1\n3 3\n1 0", b"P2\n2 1\n255\n300 1", b"P2\n1 1\n255\n-4", b"P2\n1 1\n70000\n5",
        b"P2\n1 1\n255\nx", b"P3\n1 1\n255\n1 2", b"P4\n99 99\n\0", b"P5\n1 1\n0\n\0", b"P5\n2 1\n7\n\x01\x09", b"P6\n1 1\n255\n\0", b"P2\n99999999 99999999\n255\n1",
        b"P2\n1 1\n255\n" + b"9" * 5000, media.encode_bmp(np.zeros((4, 4), np.uint8))[:-3], media.encode_bmp(np.zeros((4, 4, 3), np.uint8))[:60],
        b"BM" + b"\xff" * 60, b"BM" + b"\0" * 60,
    ]
    got = media.features(spark.createDataFrame([(i, x) for i, x in enumerate(images)], "k int, media binary")).collect()
    for r in got:
        assert r.dhash is None and r.payload_bytes is None and r.tile_npy is None, images[r.k]
        assert r.media_bytes == (None if images[r.k] is None else len(images[r.k]))


def test_query_stores_both_formats(spark, tmp_path):
    from larder.llm.queries import op3_media_columns

    spark.createDataFrame([(1, "ab" * 200), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op3_media_columns(spark, str(tmp_path)).collect():
        assert r.bmp_payload_sha256 == r.payload_sha256 and r.feature.startswith(r.bmp_dhash) and r.bmp_media_bytes == 54 + 1024 + r.payload_bytes
        assert np.load(io.BytesIO(bytes(r.tile_npy))).shape == (16, 16)
