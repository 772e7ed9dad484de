"""From written image files to plates, with hooks that look at the pixels."""

import struct
import sys
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plateworks.options import Options
from plateworks.plans import photos, reading
from plateworks.sources.images import size_of
from plateworks.sources.tables import photo_files

LETTER = "د"
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def _png(pixels, level=6):
    """A grey image file, rows without filters."""
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def _pixels(data):
    w, h = struct.unpack(">II", data[16:24])
    body, at = b"", 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, w + 1)[:, 1:]


def _detector():
    """Boxes of one grey level each; the level is the plate's number, and levels from 200 on are sure."""

    def detect(frame):
        for t in frame.itertuples():
            image = _pixels(t.content)
            assert image.shape == (t.img_h, t.img_w)
            out = []
            for level in np.unique(image[image > 0]):
                y, x = np.nonzero(image == level)
                out.append((x.min(), y.min(), x.max() + 1.0, y.max() + 1.0, float(level) / 256))
            yield out

    return detect


def _crop(content, boxes):
    image = _pixels(content)
    return [_png(image[y1:y2, x1:x2]) for x1, y1, x2, y2 in boxes]


def _reader():
    def read(frame):
        for t in frame.itertuples():
            level = int(_pixels(t.crop).max())
            yield [({"digits": str(level), "letter": LETTER, "region": "7"}.get(t.field) or f"{level}{LETTER}7", 0.5)]

    return read


def _segmenter():
    """Two bars in crops of even levels."""

    def parts(frame):
        for t in frame.itertuples():
            even = int(_pixels(t.crop).max()) % 2 == 0
            yield [(t.plate_w * k // 3, 0, 4, int(t.plate_h * 0.6), 4 * t.plate_h) for k in (1, 2)] if even else []

    return parts


def _photo(*plates):
    image = np.zeros((240, 320), np.uint8)
    for x, y, level in plates:
        image[y : y + 30, x : x + 100] = level
    return image


@pytest.fixture
def folder(tmp_path):
    for name, data in {"car1/a.png": _png(_photo((10, 10, 200), (10, 100, 201), (150, 10, 40))), "car1/b.PNG": _png(_photo((200, 200, 200))), "car2/c.png": _png(_photo()), "car2/d.jpg": b"no image", "car2/e.txt": b"x"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    large = np.zeros((5000, 10000), np.uint8)
    large[100:400, 500:1500] = 202
    (tmp_path / "in" / "car2" / "large.png").write_bytes(_png(large, 0))  # 50 MB
    return tmp_path / "in"


def test_plates_of_photo_files(spark, folder):
    o = Options()
    done = photos.read_photos(photo_files(spark, str(folder)), _detector, _reader, o, _crop, _segmenter)
    name = lambda path: path.rsplit("/", 1)[1]
    assert {name(r.path): r.error for r in done.failed.collect()} == {"d.jpg": "ValueError: no image of a known kind"}
    found = {(name(r.photo_id), r.det_seq): (r.x1, r.y1, r.x2, r.y2) for r in done.found.collect()}
    # Level 40 is not sure enough; boxes are grown by 8 percent and cut at the rim.
    assert found == {("a.png", 2): (2, 7, 118, 42), ("a.png", 3): (2, 97, 118, 132), ("b.PNG", 1): (192, 197, 308, 232), ("large.png", 1): (420, 76, 1580, 424)}
    sizes = {(name(r.photo_id), r.det_seq): size_of(bytes(r.crop)) for r in done.crops.collect()}
    assert sizes == {k: (x2 - x1, y2 - y1) for k, (x1, y1, x2, y2) in found.items()}
    calls = {(name(r.photo_id), r.det_index): r.calls for r in done.staged.calls().collect()}
    assert calls == {("a.png", 1): 14, ("a.png", 2): 15, ("b.PNG", 1): 15, ("large.png", 1): 15}
    read = done.staged.readings()
    assert {(name(r.photo_id), r.det_index): (r.segmented, r.text) for r in read.collect()} == {("a.png", 1): (False, f"201-{LETTER}-7"), ("a.png", 2): (True, f"200-{LETTER}-7"), ("b.PNG", 1): (True, f"200-{LETTER}-7"), ("large.png", 1): (True, f"202-{LETTER}-7")}
    plates = reading.group_plate(reading.group_votes(done.staged.routed, done.photos), done.photos)
    agreed = reading.agreement(plates, reading.photo_results(done.photos, reading.photo_best(read), read))
    assert {(name(r.group_id), r.plate, r.n_images) for r in agreed.collect()} == {("car1", f"200-{LETTER}-7", 2), ("car2", f"202-{LETTER}-7", 3)}


def test_boxes_in_python_are_those_of_the_tables(spark):
    from plateworks.operators import boxes

    rows = [(1, k, *b, 0.5) for k, b in enumerate([(-4.0, 10.0, 96.0, 60.0), (700.0, 0.0, 800.0, 9.0), (1.5, 2.5, 3.9, 479.9), (5.0, 5.0, 5.0, 5.0)])]
    raw = spark.createDataFrame(rows, "photo_id long, det_seq int, x1 double, y1 double, x2 double, y2 double, confidence double")
    got = {r.det_seq: (r.x1, r.y1, r.x2, r.y2) for r in boxes.padded(raw, spark.createDataFrame([(1, 640, 480)], "photo_id long, img_w int, img_h int"), Options()).collect()}
    assert got == {r[1]: g for r in rows if (g := photos.grown(r[2:6], 640, 480, Options()))}


def test_sizes_of_image_files():
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x11\x08" + struct.pack(">HH", 480, 640) + b"\x03" * 9
    assert size_of(jpeg) == (640, 480) and size_of(jpeg[:12]) is None
    assert size_of(_png(np.zeros((3, 5), np.uint8))) == (5, 3)
    assert size_of(b"BM" + bytes(16) + struct.pack("<ii", 7, -9) + bytes(8)) == (7, 9)
    webp = lambda kind, body: b"RIFF" + bytes(4) + b"WEBP" + kind + bytes(4) + body + bytes(9)
    assert size_of(webp(b"VP8X", bytes(4) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little"))) == (100, 50)
    assert size_of(webp(b"VP8L", b"\x2f" + (99 | 49 << 14).to_bytes(4, "little") + bytes(5))) == (100, 50)
    assert size_of(webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 100, 50))) == (100, 50)
    assert size_of(b"") is None and size_of(b"GIF89a") is None


def test_no_files_give_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "path string, content binary")
    done = photos.read_photos(none, _detector, _reader, Options())
    assert done.staged.readings().count() == 0 and done.photos.select(F.count("*")).first()[0] == 0
