"""Progressive JPEG: a lossless byte store in quantised coefficients, and a vectorised progressive decoder.

*Decoder.* The scans of all images of a batch are decoded wave by wave. Every restart interval of every
image is a lane of arrays, and all lanes take one Huffman symbol at a time through look-up tables, so
Python loops over symbols of an interval, not over bytes. Spectral-selection and
successive-approximation scans (DC and AC, first and refining, end-of-band runs included) add up in
coefficient arrays; these are dequantised, inverse-transformed by one integer-valued matrix product
(exact in double precision, so equal images give equal pixels whatever the batch), upsampled and
converted to full-resolution RGB.

*Writer.* The unit of storage is a coefficient: byte ``b`` is stored as ``b`` if it is 128 or more, else
as ``b - 255``. Images have 4:2:0 components; the payload fills the blocks of Y, Cb and Cr in this
order. Each image has eleven scans: DC of all components with one bit held back, AC 1-5 and 6-63 of
each component with one bit held back, then the refining scans. Intervals are one MCU long. The
number of bytes stands in a comment.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of the format: position of each zigzag index in a block, row by row.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
UNIT = 576

# ---------------------------------------------------------------- writer


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def _marker(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, list[int]]) -> bytes:
    return bytes([kind]) + bytes(len(lengths.get(n, [])) for n in range(1, 17)) + bytes(v for n in sorted(lengths) for v in lengths[n])


#: DC sizes 0 to 8 have codes of four bits; AC symbols that the writer needs have the one code of one bit.
_TABLES = _marker(0xC4, _table(0x00, {4: list(range(9))}) + _table(0x10, {1: [0x07]}) + _table(0x11, {1: [0x00]}))
_Q = _marker(0xDB, b"\x00" + b"\x01" * 64)
_RESTART = _marker(0xDD, b"\x00\x01")


def _sos(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int) -> bytes:
    return _marker(0xDA, bytes([len(parts)]) + b"".join(bytes([c, t]) for c, t in parts) + bytes([ss, se, ah << 4 | al]))


def _entropy(flat: np.ndarray, size: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Intervals' bytes with stuffing and restart markers, cut into images. size: bytes of each interval; first: of each image, its first interval."""
    k = np.repeat(np.arange(len(size)), size)
    full = flat == 255
    place = np.arange(len(flat)) + np.cumsum(full) - full + 2 * k
    ends = np.cumsum(size)
    behind = ends + np.r_[0, np.cumsum(full)][ends] + 2 * np.arange(len(size))
    out = np.zeros(len(flat) + int(full.sum()) + 2 * len(size), np.uint8)
    out[place] = flat
    out[behind] = 255
    number = np.arange(len(size)) - np.repeat(first[:-1], np.diff(first))
    out[behind + 1] = 0xD0 + number % 8
    stops = behind[first[1:] - 1]
    starts = np.r_[0, stops[:-1] + 2]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def _dc_first(dc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the first DC scan's intervals. dc: (MCUs, 6), one bit held back."""
    diff = dc.copy()
    diff[:, 1:4] -= dc[:, 0:3]
    size = np.zeros(diff.shape, np.int64)
    for n in range(9):
        size += np.abs(diff) >= 1 << n
    word = (size << size | np.where(diff < 0, diff + (1 << size) - 1, diff)) << (12 - size)
    bits = np.unpackbits(word.astype(">u2").view(np.uint8).reshape(len(dc), 6, 2), axis=2)
    valid = np.arange(16) < (4 + size)[:, :, None]
    length = (4 + size).sum(1)
    held = -(-length // 8)
    start = (np.cumsum(held) - held) * 8
    out = np.ones(int(held.sum()) * 8, np.uint8)
    picked = bits[valid]
    out[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(len(picked))] = picked
    return np.packbits(out), held


def geometry(blocks: int) -> tuple[int, int]:
    """Columns and rows of MCUs that hold so many blocks."""
    n = -(-blocks // 6)
    cols = int(np.ceil(np.sqrt(n)))
    return cols, -(-n // cols)


def encode(payloads: list[bytes], sizes: list[int]) -> list[bytes]:
    """An image for each payload (a multiple of 64 bytes); sizes: the numbers that go to the comments."""
    shape = [geometry(len(p) // 64) for p in payloads]
    n = np.array([c * r for c, r in shape])
    base = np.r_[0, np.cumsum(6 * n)]
    store = np.zeros((int(base[-1]), 64), np.uint8)
    flat = store.reshape(-1)
    for b, p in zip(base, payloads, strict=False):
        flat[64 * b : 64 * b + len(p)] = np.frombuffer(p, np.uint8)
    low = store < 128
    size_of = np.where(low, 255 - store, store)
    value = store.astype(np.int64)[:, 0] - 255 * low[:, 0]
    # Blocks of an MCU, as the interleaved scans take them.
    mcu = np.concatenate([b + np.column_stack([luma_order(c, r), 4 * c * r + np.arange(c * r), 5 * c * r + np.arange(c * r)]) for b, (c, r) in zip(base, shape, strict=False)])
    per_image = np.r_[0, np.cumsum(n)]
    one = np.ones(len(mcu), np.int64)
    half = size_of >> 1
    first = np.where(low, 127 - half, half)
    bit = size_of & 1
    refine = np.packbits(np.concatenate([np.zeros((len(bit), 1), np.uint8), bit[:, 1:]], axis=1), axis=1)
    dc_bits = np.packbits(np.concatenate([(value[mcu] & 1).astype(np.uint8), np.ones((len(mcu), 2), np.uint8)], axis=1), axis=1)
    comp = [np.concatenate([np.arange(b + lo * k, b + hi * k) for b, k in zip(base, n, strict=False)]) for lo, hi in ((0, 4), (4, 5), (5, 6))]
    ends = [np.r_[0, np.cumsum(w * n)] for w in (4, 1, 1)]
    every = [(1, 0x00), (2, 0x00), (3, 0x00)]
    scans = [(_sos(every, 0, 0, 0, 1), _entropy(*_dc_first(value[mcu] >> 1), per_image))]
    for lo, hi in ((1, 5), (6, 63)):
        for c in range(3):
            part = first[comp[c], lo : hi + 1]
            scans.append((_sos([(c + 1, 0x00)], lo, hi, 0, 1), _entropy(part.ravel(), np.full(len(part), hi - lo + 1), ends[c])))
    scans.append((_sos(every, 0, 0, 1, 0), _entropy(dc_bits.ravel(), one, per_image)))
    for c in range(3):
        part = refine[comp[c]]
        scans.append((_sos([(c + 1, 0x01)], 1, 63, 1, 0), _entropy(part.ravel(), np.full(len(part), 8), ends[c])))
    out = []
    for i, (cols, rows) in enumerate(shape):
        frame = _marker(0xC2, b"\x08" + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        out.append(b"\xff\xd8" + _marker(0xFE, b"bytes=%d" % sizes[i]) + _Q + frame + _TABLES + _RESTART + b"".join(h + d[i] for h, d in scans) + b"\xff\xd9")
    return out


def luma_order(cols: int, rows: int) -> np.ndarray:
    """Of each MCU, its four luma blocks in the raster of luma blocks."""
    r, c = np.divmod(np.arange(cols * rows), cols)
    top = 2 * r * 2 * cols + 2 * c
    return np.column_stack([top, top + 1, top + 2 * cols, top + 2 * cols + 1])


# ---------------------------------------------------------------- decoder


@dataclass
class Component:
    ident: int
    h: int
    v: int
    q: int
    base: int = 0
    wide: int = 0  # blocks in a row, padded to whole MCUs
    high: int = 0
    used_wide: int = 0
    used_high: int = 0


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""
    scans: list[tuple] = field(default_factory=list)
    mcu: tuple[int, int] = (0, 0)

    @property
    def blocks(self) -> int:
        return sum(c.wide * c.high for c in self.components)


@lru_cache(maxsize=64)
def huffman(counts: bytes, values: bytes) -> np.ndarray:
    """Symbol and code length (length << 8 | symbol) for every 16 bits that may come next."""
    out, code, k = np.zeros(65536, np.int32), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def parse(data: bytes) -> Image:
    """Segments of a progressive image; entropy-coded bytes stay where they are."""
    im, dc, ac, restart, at = Image(), {}, {}, 0, 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG image")
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        kind = data[at + 1]
        if kind == 0xD9:
            return im
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            im.comment = body
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                (ac if body[0] >> 4 else dc)[body[0] & 15] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
            im.mcu = (-(-im.width // (8 * hm)), -(-im.height // (8 * vm)))
            base = 0
            for c in im.components:
                c.wide, c.high, c.base = im.mcu[0] * c.h, im.mcu[1] * c.v, base
                c.used_wide, c.used_high = -(-(-(-im.width * c.h // hm)) // 8), -(-(-(-im.height * c.v // vm)) // 8)
                base += c.wide * c.high
        elif kind == 0xDA:
            ids = [c.ident for c in im.components]
            parts = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            ss, se, approx = body[-3:]
            tables = tuple(dc.get(t >> 4) for _, t in parts) if ss == 0 else (ac.get(parts[0][1] & 15),)
            end = _MARKER.search(data, at).start()
            im.scans.append((tuple(c for c, _ in parts), ss, se, approx >> 4, approx & 15, tables, restart, at, end))
            at = end
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("not a progressive Huffman-coded image")


@lru_cache(maxsize=512)
def block_order(mcu: tuple[int, int], width: int, height: int, components: tuple, parts: tuple[int, ...]) -> tuple[np.ndarray, list[int]]:
    """Blocks of each MCU of a scan, and the component (position in the scan) of each of them."""
    if len(parts) == 1:
        _, _, base, wide, used_wide, used_high = components[parts[0]]
        return (base + np.arange(used_high)[:, None] * wide + np.arange(used_wide)).reshape(-1, 1), [0]
    y, x = np.divmod(np.arange(mcu[0] * mcu[1]), mcu[0])
    cols, of = [], []
    for k, p in enumerate(parts):
        h, v, base, wide, _, _ = components[p]
        for dy in range(v):
            for dx in range(h):
                cols.append(base + (y * v + dy) * wide + x * h + dx)
                of.append(k)
    return np.column_stack(cols), of


class Bits:
    """Lanes over one buffer: ``at`` is each lane's place in bits."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        b = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.int32)
        self.three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
        self.at = at

    def next16(self, at: np.ndarray) -> np.ndarray:
        return self.three[np.minimum(at >> 3, len(self.three) - 1)] >> (8 - (at & 7)) & 0xFFFF

    def take(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.next16(at) >> (16 - n)


def signed(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where((size > 0) & (bits < 1 << np.maximum(size - 1, 0)), bits - (1 << size) + 1, bits)


def _dc_scan(bits: Bits, lanes: np.ndarray, count: np.ndarray, of: list[int], luts: list, ah: int, al: int, coef: np.ndarray) -> None:
    """lanes: (lanes, blocks) of block numbers; count: blocks in each lane."""
    before = np.zeros((len(lanes), max(of) + 1), np.int64)
    for j in range(lanes.shape[1]):
        live = np.flatnonzero(count > j)
        at, block = bits.at[live], lanes[live, j]
        if ah:
            coef[block, 0] |= (bits.take(at, 1) << al).astype(coef.dtype)
            bits.at[live] = at + 1
            continue
        k = of[j % len(of)]
        code = luts[k][bits.next16(at)]
        at, size = at + (code >> 8), code & 255
        before[live, k] += signed(bits.take(at, size), size)
        coef[block, 0] = before[live, k] << al
        bits.at[live] = at + size


def _ac_first(bits: Bits, lanes: np.ndarray, count: np.ndarray, lut: np.ndarray, ss: int, se: int, al: int, coef: np.ndarray) -> None:
    run = np.zeros(len(lanes), np.int64)  # blocks left of an end-of-band run
    flat = coef.reshape(-1)
    for j in range(lanes.shape[1]):
        ended = (count > j) & (run > 0)
        live = np.flatnonzero((count > j) & (run == 0))
        run[ended] -= 1
        at, base, k = bits.at[live], lanes[live, j] * 64, np.full(len(live), ss)
        while len(live):
            code = lut[bits.next16(at)]
            at = at + (code >> 8)
            size, skip = code & 15, code >> 4 & 15
            extra = bits.take(at, size)
            if size.all():
                k = k + skip
                flat[base + np.minimum(k, se)] = signed(extra, size) << al
                at, k = at + size, k + 1
                done = k > se
            else:
                put = size > 0
                end = ~put & (skip < 15)
                length = np.where(end, skip, 0)
                run[live[end]] = (1 << skip[end]) - 1 + bits.take(at[end], length[end])
                k = np.where(end, se + 1, k + skip)
                flat[base[put] + np.minimum(k[put], se)] = signed(extra[put], size[put]) << al
                at, k = at + size + length, k + 1
                done = k > se
            if done.any():
                bits.at[live[done]] = at[done]
                go = ~done
                live, at, base, k = live[go], at[go], base[go], k[go]


def _ac_refine(bits: Bits, lanes: np.ndarray, count: np.ndarray, lut: np.ndarray, ss: int, se: int, al: int, coef: np.ndarray) -> None:
    run = np.zeros(len(lanes), np.int64)
    flat = coef.reshape(-1)
    for j in range(lanes.shape[1]):
        here = np.flatnonzero(count > j)
        begin = np.full(len(lanes), ss)  # where a block's end-of-band part begins
        live = here[run[here] == 0]
        at, base, k = bits.at[live], lanes[live, j] * 64, np.full(len(live), ss)
        left, new, scan = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), bool)
        while len(live):
            ask = np.flatnonzero(~scan)
            done = np.zeros(len(live), bool)
            if len(ask):
                code = lut[bits.next16(at[ask])]
                p = at[ask] + (code >> 8)
                size, skip = code & 15, code >> 4 & 15
                end = (size == 0) & (skip < 15)
                n = np.where(end, skip, (size > 0).astype(np.int64))
                extra = bits.take(p, n)
                run[live[ask[end]]] = (1 << skip[end]) + extra[end]
                begin[live[ask[end]]] = k[ask[end]]
                at[ask] = p + n
                done[ask[end]] = True
                left[ask] = skip
                new[ask] = np.where(size > 0, np.where(extra > 0, 1, -1), 0) << al
                scan[ask] = True
            go = np.flatnonzero(~done)
            if len(go):
                c = flat[base[go] + k[go]].astype(np.int64)
                old = c != 0
                o = go[old]
                flat[base[o] + k[o]] = c[old] + np.sign(c[old]) * (bits.take(at[o], 1) << al)
                at[o] += 1
                z = go[~old]
                place = z[left[z] == 0]
                flat[base[place] + k[place]] = new[place]
                scan[place] = False
                left[z] -= 1
                k[go] += 1
                done[go] |= k[go] > se
            if done.any():
                bits.at[live[done]] = at[done]
                s = ~done
                live, at, base, k, left, new, scan = live[s], at[s], base[s], k[s], left[s], new[s], scan[s]
        # Blocks under an end-of-band run: a bit for each coefficient that is not zero yet, all at once.
        tail = here[run[here] > 0]
        if len(tail):
            part = coef[lanes[tail, j], ss : se + 1].astype(np.int64)
            old = (part != 0) & (np.arange(ss, se + 1) >= begin[tail][:, None])
            n = np.cumsum(old, axis=1)
            got = bits.take(bits.at[tail][:, None] + np.maximum(n - 1, 0), 1)
            coef[lanes[tail, j], ss : se + 1] = part + np.where(old, np.sign(part) * (got << al), 0)
            bits.at[tail] += n[:, -1]
            run[tail] -= 1


def decode(files: list[bytes]) -> tuple[list[Image], list[np.ndarray]]:
    """Images and their coefficients: (blocks, 64) in zigzag order, components one after the other."""
    images = [parse(f) for f in files]
    base = np.r_[0, np.cumsum([im.blocks for im in images])].astype(np.int64)
    coef = np.zeros((int(base[-1]), 64), np.int16)
    for wave in range(max((len(im.scans) for im in images), default=0)):
        groups: dict[tuple, list[int]] = {}
        for i, im in enumerate(images):
            if wave < len(im.scans):
                s = im.scans[wave]
                shape = tuple((im.components[c].h, im.components[c].v) for c in s[0]) if len(s[0]) > 1 else ()
                groups.setdefault((s[1:6], len(s[0]), shape), []).append(i)
        for ((ss, se, ah, al, tables), _, _), members in groups.items():
            lanes, counts, parts = [], [], []
            for i in members:
                im = images[i]
                which, *_, restart, lo, hi = im.scans[wave]
                order, of = block_order(im.mcu, im.width, im.height, tuple((c.h, c.v, c.base, c.wide, c.used_wide, c.used_high) for c in im.components), which)
                step = restart or len(order)
                n, per = -(-len(order) // step), order.shape[1]
                count = [step * per] * n
                if n * step > len(order):
                    count[-1] = (len(order) - (n - 1) * step) * per
                    order = np.concatenate([order, np.zeros((n * step - len(order), per), np.int64)])
                lanes.append((order + base[i]).reshape(n, -1))
                counts += count
                parts.append(np.frombuffer(files[i], np.uint8, hi - lo, lo))
            # Plain bytes: stuffed zeros and restart markers go; a lane begins with an image or behind a marker.
            raw = np.concatenate(parts)
            heads = np.cumsum([0, *map(len, parts)])[:-1]
            full = np.flatnonzero(raw[:-1] == 255)
            mark = raw[full + 1] != 0
            keep = np.ones(len(raw) + 1, bool)
            keep[full + 1] = False
            keep[full[mark]] = False
            starts = np.sort(np.concatenate([heads, full[mark] + 2]))
            count = np.array(counts)
            if len(starts) != len(count):
                raise ValueError("restart markers do not match the image's size")
            wide = max(x.shape[1] for x in lanes)
            lane = np.concatenate([x if x.shape[1] == wide else np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in lanes])
            bits = Bits(raw[keep[:-1]], (np.cumsum(keep) - keep)[starts] * 8)
            luts = [huffman(*t) if t else None for t in tables]
            if ss == 0:
                _dc_scan(bits, lane, count, of, luts, ah, al, coef)
            elif ah == 0:
                _ac_first(bits, lane, count, luts[0], ss, se, al, coef)
            else:
                _ac_refine(bits, lane, count, luts[0], ss, se, al, coef)
    return images, [coef[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]


@lru_cache(maxsize=1)
def transform() -> np.ndarray:
    """Inverse DCT of a block in zigzag order as a (64, 64) matrix of integers, scaled by 2^14."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    both = np.einsum("yv,xu->vuyx", one, one).reshape(64, 64)
    return np.rint(both[ZIGZAG] * 2**14)


def samples(images: list[Image], coefs: list[np.ndarray], step: int = 1 << 14) -> list[np.ndarray]:
    """Blocks of 8-bit samples. Sums of integers below 2^53: the same whatever the order of summation."""
    coef = np.concatenate(coefs)
    tables = {t.tobytes(): t for im in images for t in im.quant.values()}
    place = {k: i for i, k in enumerate(tables)}
    quant = np.array(list(tables.values()))
    of = np.repeat([place[im.quant[c.q].tobytes()] for im in images for c in im.components], [c.wide * c.high for im in images for c in im.components])
    out = np.empty(coef.shape, np.uint8)
    for lo in range(0, len(coef), step):
        part = coef[lo : lo + step] * (quant[0] if len(quant) == 1 else quant[of[lo : lo + step]])
        s = part @ transform()
        s += 2**13 + (128 << 14)
        out[lo : lo + step] = np.clip(s.astype(np.int64) >> 14, 0, 255)
    ends = np.cumsum([len(c) for c in coefs])
    return [out[e - len(c) : e] for e, c in zip(ends, coefs, strict=True)]


def rgb(im: Image, blocks: np.ndarray) -> np.ndarray:
    """Full-resolution (height, width, 3) tensor of an image from its blocks of samples."""
    hm, vm = max(c.h for c in im.components), max(c.v for c in im.components)
    planes = []
    for c in im.components:
        plane = blocks[c.base : c.base + c.wide * c.high].reshape(c.high, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.high * 8, c.wide * 8)
        if c.v < vm:
            plane = plane.repeat(vm // c.v, axis=0)
        if c.h < hm:
            plane = plane.repeat(hm // c.h, axis=1)
        planes.append(plane[: im.height, : im.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    y, cb, cr = planes[0].astype(np.int32), planes[1].astype(np.int32) - 128, planes[2].astype(np.int32) - 128
    # Fixed values of the format: YCbCr to RGB, scaled by 2^16.
    out = np.empty((*y.shape, 3), np.uint8)
    for k, plane in enumerate((y + ((91881 * cr + 32768) >> 16), y - ((22554 * cb + 46802 * cr + 32768) >> 16), y + ((116130 * cb + 32768) >> 16))):
        out[:, :, k] = np.minimum(np.maximum(plane, 0), 255)
    return out


def payload(im: Image, coef: np.ndarray) -> tuple[bytes, int]:
    """Stored bytes with their padding, and how many of them are not padding."""
    n = int(im.comment.removeprefix(b"bytes="))
    size = n + (-n % UNIT or (0 if n else UNIT))
    c = coef.reshape(-1)[:size]
    return np.where(c < 0, c + 255, c).astype(np.uint8).tobytes(), n
