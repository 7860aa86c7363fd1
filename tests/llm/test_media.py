import hashlib
import random
import zlib

import numpy as np
import pytest

from arealith.llm import jpeg
from arealith.llm.media import decoded_images, stored_images


class Writer:
    """A scalar progressive writer, a bit at a time: every symbol has a code of eight bits."""

    def __init__(self):
        self.bits, self.out, self.run, self.late = "", b"", 0, ""

    def symbol(self, s):
        self.bits += format(s, "08b")

    def number(self, v, n):
        self.bits += format(v, f"0{n}b") if n else ""

    def flush_run(self):
        if self.run:
            n = self.run.bit_length() - 1
            self.symbol(n << 4)
            self.number(self.run - (1 << n), n)
            self.bits += self.late
            self.run, self.late = 0, ""

    def value(self, v):
        n = abs(v).bit_length()
        self.number(v if v > 0 else v + (1 << n) - 1, n)

    def close(self, restart=None):
        self.flush_run()
        self.bits += "1" * (-len(self.bits) % 8)
        data = int(self.bits, 2).to_bytes(len(self.bits) // 8, "big") if self.bits else b""
        self.out += data.replace(b"\xff", b"\xff\x00") + (bytes([0xFF, 0xD0 + restart % 8]) if restart is not None else b"")
        self.bits = ""

    def ac_first(self, c, ss, se, al):
        zeros = 0
        for v in c[ss : se + 1]:
            v = int(np.sign(v)) * (abs(int(v)) >> al)
            if not v:
                zeros += 1
                continue
            self.flush_run()
            while zeros > 15:
                self.symbol(0xF0)
                zeros -= 16
            self.symbol(zeros << 4 | abs(v).bit_length())
            self.value(v)
            zeros = 0
        self.run += zeros > 0

    def ac_refine(self, c, ss, se, al):
        size = [abs(int(v)) >> al for v in c]
        last = max((k for k in range(ss, se + 1) if size[k] == 1), default=0)
        zeros, late = 0, ""
        for k in range(ss, se + 1):
            if size[k] == 0:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                self.flush_run()
                self.symbol(0xF0)
                self.bits, late, zeros = self.bits + late, "", zeros - 16
            if size[k] > 1:
                late += str(size[k] & 1)
                continue
            self.flush_run()
            self.symbol(zeros << 4 | 1)
            self.bits, late, zeros = self.bits + ("1" if c[k] > 0 else "0") + late, "", 0
        if zeros or late:
            self.run += 1
            self.late += late


def written(coef, width, height, sampling, restart):
    """A file of the components' coefficients, each (rows, columns, 64), by scans of every kind."""
    seg = lambda k, b: bytes([0xFF, k]) + (len(b) + 2).to_bytes(2, "big") + b
    syms = [s for s in range(256) if s != 255]
    table = lambda t: bytes([t]) + bytes(7) + bytes([len(syms)]) + bytes(8) + bytes(syms)
    out = b"\xff\xd8" + seg(0xFE, b"note") + seg(0xDB, b"\x00" + bytes(range(1, 65)))
    out += seg(0xC2, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(coef)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += seg(0xC4, table(0x00) + table(0x10)) + seg(0xDD, restart.to_bytes(2, "big"))
    hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)

    def scan(parts, ss, se, ah, al, blocks):
        w = Writer()
        before = [0] * len(coef)
        for n, mcu in enumerate(blocks):
            if restart and n and n % restart == 0:
                w.close(n // restart - 1)
                before = [0] * len(coef)
            for comp, r, c in mcu:
                b = coef[comp][r, c]
                if ss == 0 and ah:
                    w.bits += str(int(b[0]) >> al & 1)
                elif ss == 0:
                    d = (int(b[0]) >> al) - before[comp]
                    before[comp] = int(b[0]) >> al
                    w.symbol(abs(d).bit_length())
                    w.value(d)
                else:
                    (w.ac_refine if ah else w.ac_first)(b, ss, se, al)
        w.close()
        return seg(0xDA, bytes([len(parts)]) + b"".join(bytes([p + 1, 0]) for p in parts) + bytes([ss, se, ah << 4 | al])) + w.out

    mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
    every = [[(i, y * v + dy, x * h + dx) for i, (h, v) in enumerate(sampling) for dy in range(v) for dx in range(h)] for y in range(my) for x in range(mx)]
    if len(coef) == 1:
        every = [[(0, r, c)] for r in range(-(-height // 8)) for c in range(-(-width // 8))]
    used = [(-(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)) for h, v in sampling]
    alone = lambda i: [[(i, r, c)] for r in range(used[i][0]) for c in range(used[i][1])]
    ids = list(range(len(coef)))
    out += scan(ids, 0, 0, 0, 1, every)
    for i in ids:
        out += scan([i], 1, 5, 0, 2, alone(i)) + scan([i], 6, 63, 0, 2, alone(i))
    out += scan(ids, 0, 0, 1, 0, every)
    for i in ids:
        out += scan([i], 1, 63, 2, 1, alone(i)) + scan([i], 1, 63, 1, 0, alone(i))
    return out + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decoder_against_a_scalar_writer(restart):
    rng = np.random.default_rng(restart)
    files, truth = [], []
    for sampling, width, height in (([(2, 2), (1, 1), (1, 1)], 37, 21), ([(1, 1)], 20, 9), ([(2, 1), (1, 1), (1, 1)], 33, 16), ([(2, 2), (1, 1), (1, 1)], 37, 21)):
        hm, vm = max(h for h, _ in sampling), max(v for _, v in sampling)
        mx, my = -(-width // (8 * hm)), -(-height // (8 * vm))
        coef = []
        for h, v in sampling:
            c = np.where(rng.random((my * v, mx * h, 64)) < rng.choice([0.02, 0.3]), rng.integers(-60, 61, (my * v, mx * h, 64)), 0)
            c[..., 0] = rng.integers(-500, 500, c.shape[:2])
            uh, uw = -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)
            c[uh:, :, 1:] = 0  # scans of one component leave out blocks of padding
            c[:, uw:, 1:] = 0
            if len(sampling) == 1:
                c[uh:], c[:, uw:] = 0, 0
            coef.append(c)
        files.append(written(coef, width, height, sampling, restart))
        truth.append(np.concatenate([c.reshape(-1, 64) for c in coef]))
    images, got = jpeg.decode(files)
    for g, t in zip(got, truth):
        assert (g == t).all()
    for im, b in zip(images, jpeg.samples(images, got)):
        assert jpeg.rgb(im, b).shape == (im.height, im.width, 3)


def test_inverse_transform_against_the_formula():
    rng = np.random.default_rng(3)
    c = np.zeros((1, 64), np.int16)
    c[0, :12] = rng.integers(-80, 80, 12)
    im = jpeg.parse(written([c.reshape(1, 1, 64)], 8, 8, [(1, 1)], 0))
    block = np.zeros((8, 8))
    block.reshape(-1)[jpeg.ZIGZAG] = c[0] * im.quant[0]
    k = lambda u: np.sqrt(0.125) if u == 0 else 0.5
    want = np.array([[sum(k(u) * k(v) * block[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for x in range(8)] for y in range(8)])
    got = jpeg.samples([im], [c])[0].reshape(8, 8)
    assert np.abs(np.clip(want + 128, 0, 255) - got).max() <= 1


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and sorted(jpeg.ZIGZAG) == list(range(64))


def test_only_progressive_files():
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8\xff\xc0\x00\x04\x00\x00")


def test_round_trip_and_equal_values(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "é" * 288, "x" * 576, "y" * 577, "\x7f~\x00" * 500, "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(70_000))]
    rows = [(i, t, "clash") for i, t in enumerate(texts * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string").repartition(3)
    got = {r.doc_id: r for r in decoded_images(stored_images(df)).collect()}
    for i, t, _ in rows:
        data = (t or "").encode()
        want = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        twin = got[(i + len(texts)) % len(rows)]
        assert (r.media_sha256, r.feature, r.rgb) == (twin.media_sha256, twin.feature, twin.rgb)
        assert len(r.rgb) == r.width * r.height * 3


def test_null_ids_ties_and_columns_of_any_name(spark):
    rows = [(None, "a text", "m"), (None, "a text", "m"), (1, "a text", "m"), (2, None, "m")]
    d = spark.createDataFrame(rows, "doc_id long, text string, media string")
    images = stored_images(d, keep=("doc_id", "media"))
    assert images.columns == ["doc_id", "media", "media_"]
    out = decoded_images(images, keep=("doc_id", "media"), tensors=False, media="media_")
    got = [(r.doc_id, r.media, r.payload_sha256, r.feature) for r in out.collect()]
    assert len(got) == 4 and len({g[2:] for g in got if g[0] != 2}) == 1 and {g[1] for g in got} == {"m"} and sum(g[0] is None for g in got) == 2


def test_empty_table(spark):
    assert decoded_images(stored_images(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
