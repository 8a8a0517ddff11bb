"""The JPEG reader against a writer of its own: codes of many lengths of run, restart intervals, fill bytes, odd sizes."""

import itertools
import struct

import numpy as np
import pytest

from pairloom.llm import jpeg

DC, AC = list(range(12)), [r << 4 | s for r in range(16) for s in range(11)]


class Writer:
    """Bits of a scan; DC codes have 4 bits and AC codes 8, each its symbol's place in the table."""

    def __init__(self):
        self.bits, self.run, self.waiting = [], 0, []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in reversed(range(n))]

    def signed(self, v):
        n = abs(v).bit_length()
        self.put(v if v > 0 else v + (1 << n) - 1, n)

    def end_run(self):
        """Blocks without anything new so far, and the corrections that go with them."""
        if self.run:
            n = self.run.bit_length() - 1
            self.put(AC.index(n << 4), 8)
            self.put(self.run - (1 << n), n)
            self.bits += self.waiting
            self.run, self.waiting = 0, []

    def data(self):
        self.end_run()
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")


def first_ac(w, block, lo, hi, low):
    zeros = 0
    for k in range(lo, hi + 1):
        v = int(np.sign(block[k])) * (abs(int(block[k])) >> low)
        if not v:
            zeros += 1
            continue
        w.end_run()
        while zeros > 15:
            w.put(AC.index(0xF0), 8)
            zeros -= 16
        w.put(AC.index(zeros << 4 | abs(v).bit_length()), 8)
        w.signed(v)
        zeros = 0
    w.run += zeros > 0


def more_ac(w, block, lo, hi, low):
    size = [abs(int(x)) >> low for x in block]
    new = [k for k in range(lo, hi + 1) if size[k] == 1]
    zeros, fixes = 0, []
    for k in range(lo, hi + 1):
        if not size[k]:
            zeros += 1
            continue
        while zeros > 15 and new and k <= new[-1]:
            w.end_run()
            w.put(AC.index(0xF0), 8)
            w.bits += fixes
            zeros, fixes = zeros - 16, []
        if size[k] > 1:
            fixes.append(size[k] & 1)
            continue
        w.end_run()
        w.put(AC.index(zeros << 4 | 1), 8)
        w.put(int(block[k] > 0), 1)
        w.bits += fixes
        zeros, fixes = 0, []
    if zeros or fixes:
        w.run += 1
        w.waiting += fixes


def write(parts, width, height, restart, quant):
    """parts: (h, v, coefficients in raster order of blocks, blocks across, own blocks across and down)."""
    seg = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    table = lambda kind, n, symbols: seg(0xC4, bytes([kind, *(len(symbols) if k == n else 0 for k in range(1, 17))]) + bytes(symbols))
    out = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + b"\xff\xff" + seg(0xDB, bytes([0, *quant])) + table(0, 4, DC) + table(0x10, 8, AC)
    out += seg(0xC2, struct.pack(">BHHB", 8, height, width, len(parts)) + bytes(x for i, p in enumerate(parts) for x in (i + 1, p[0] << 4 | p[1], 0)))
    out += seg(0xDD, struct.pack(">H", restart)) if restart else b""
    across, down = -(-width // (8 * max(p[0] for p in parts))), -(-height // (8 * max(p[1] for p in parts)))
    mcus = [[(i, (y * v + b) * wide + x * h + a) for i, (h, v, _, wide, _) in enumerate(parts) for b in range(v) for a in range(h)] for y in range(down) for x in range(across)]
    single = [[[(i, y * p[3] + x)] for y in range(p[4][1]) for x in range(p[4][0])] for i, p in enumerate(parts)]

    def scan(units, chosen, lo, hi, high, low):
        spans = []
        for some in itertools.batched(units, restart or len(units)):
            w, before = Writer(), [0] * len(parts)
            for i, b in itertools.chain.from_iterable(some):
                block = parts[i][2][b]
                if lo:
                    (more_ac if high else first_ac)(w, block, lo, hi, low)
                elif high:
                    w.put(int(block[0]) >> low & 1, 1)
                else:
                    v = int(block[0]) >> low
                    d, before[i] = v - before[i], v
                    w.put(abs(d).bit_length(), 4)
                    w.signed(d)
            spans.append(w.data())
        body = spans[0] + b"".join(b"\xff\xff" + bytes([0xD0 + k % 8]) + x for k, x in enumerate(spans[1:]))
        return seg(0xDA, bytes([len(chosen), *(x for i in chosen for x in (i + 1, 0)), lo, hi, high << 4 | low])) + body

    every = list(range(len(parts)))
    dc = mcus if len(parts) > 1 else single[0]
    out += scan(dc, every, 0, 0, 0, 1) + scan(single[0], [0], 1, 5, 0, 2) + scan(single[0], [0], 6, 63, 0, 2)
    for i in every[1:]:
        out += scan(single[i], [i], 1, 63, 0, 1)
    out += scan(single[0], [0], 1, 63, 2, 1) + scan(dc, every, 0, 0, 1, 0)
    for i in every:
        out += scan(single[i], [i], 1, 63, 1, 0)
    return out + b"\xff\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
@pytest.mark.parametrize("shapes", [((2, 2), (1, 1), (1, 1)), ((2, 1), (1, 1), (1, 1)), ((1, 1),)])
def test_reads_what_others_write(shapes, restart):
    rng = np.random.default_rng(7)
    width, height = 53, 41
    hs, vs = max(h for h, _ in shapes), max(v for _, v in shapes)
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    parts = []
    for h, v in shapes:
        own = (-(-(-(-width * h // hs)) // 8), -(-(-(-height * v // vs)) // 8))
        c = rng.integers(-40, 41, (across * h * down * v, 64)) * (rng.random((across * h * down * v, 64)) < 0.15)
        c[:, 0] = rng.integers(-300, 300, len(c))
        c[::3, 1:] = 0
        outside = np.ones((down * v, across * h), bool)
        outside[: own[1], : own[0]] = False
        c[np.flatnonzero(outside.ravel()), 1:] = 0  # single scans leave those out
        parts.append((h, v, c, across * h, own))
    quant = [1 + k // 8 for k in range(64)]
    image = jpeg.decode(write(parts, width, height, restart, quant))
    for p, q in zip(image["parts"], parts, strict=True):
        assert (p["coefs"] == q[2]).all() and list(p["quant"]) == quant
    got = jpeg.pixels(image)
    assert got.shape == (height, width, 3)
    # samples by the definition of the transform
    scale = lambda k: (1 / 8) ** 0.5 if not k else 0.5
    wave = np.array([[scale(u) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
    planes = []
    for h, v, c, wide, _ in parts:
        grid = np.zeros((len(c), 64))
        grid[:, jpeg.ZIGZAG] = c * quant
        s = np.clip(np.rint(wave @ grid.reshape(-1, 8, 8) @ wave.T + 128), 0, 255)
        s = s.reshape(-1, wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, wide * 8)
        planes.append(s.repeat(vs // v, axis=0).repeat(hs // h, axis=1)[:height, :width])
    y, cb, cr = planes if len(planes) == 3 else (planes[0], np.full_like(planes[0], 128), np.full_like(planes[0], 128))
    want = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
    assert np.abs(got - np.clip(want, 0, 255)).max() <= 3.5


def test_others_are_refused():
    with pytest.raises(ValueError):
        jpeg.decode(b"\xff\xd8" + struct.pack(">BBHBHHB", 0xFF, 0xC0, 11, 8, 8, 8, 1) + bytes([1, 0x11, 0]) + b"\xff\xd9")
