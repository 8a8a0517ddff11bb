"""Progressive JPEG (ITU-T T.81, 8 bits, Huffman) in numpy: scans into coefficient arrays, and arrays into scans.

``decode`` reads such a file of one component, or of three as luma and chroma: each scan adds to arrays of
coefficients (blocks in raster order, zigzag order within a block), by spectral selection and successive
approximation. Restart intervals hold in every scan, fill bytes may stand before any marker; a file that
is not progressive is refused. A scan whose code table has one code has codes of one length throughout,
and is read as a matrix of bits; so are the correction bits of runs of whole blocks. Other scans are read
code by code.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Zigzag order of an 8 x 8 block's coefficients: from the sums of row and column, alternating direction.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: A marker that ends a scan, and those between a scan's restart intervals, with fill bytes before them.
_MARK, _RESTART = re.compile(rb"\xff+[^\x00\xff\xd0-\xd7]"), re.compile(rb"\xff+[\xd0-\xd7]")
_SHIFT = 14


def _idct_matrix() -> np.ndarray:
    """From 64 coefficients in zigzag order to 64 samples times 2^_SHIFT, in whole numbers, so that sums are exact."""
    x, u = np.arange(8)[:, None], np.arange(8)[None]
    one = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    both = np.einsum("xu,yv->uvxy", one, one).reshape(64, 64)[ZIGZAG]
    return np.rint(both * (1 << _SHIFT))


_IDCT = _idct_matrix()


def samples(coefficients: np.ndarray) -> np.ndarray:
    """Samples 0 to 255 of blocks (n, 64) of dequantised coefficients: (n, 8, 8)."""
    raw = coefficients.astype(np.float64) @ _IDCT  # whole numbers below 2^53
    raw = np.floor((raw + (1 << (_SHIFT - 1))) / (1 << _SHIFT)) + 128
    return np.clip(raw, 0, 255).astype(np.uint8).reshape(-1, 8, 8)


def to_rgb(y: np.ndarray, cb: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """Whole-number conversion of equal arrays of luma and chroma samples; a last axis of 3 is added."""
    y, cb, cr = (np.int32(1 << 16) * y.astype(np.int32)), cb.astype(np.int32) - 128, cr.astype(np.int32) - 128
    out = np.empty((*y.shape, 3), np.uint8)
    for k, v in enumerate((y + 91881 * cr, y - 22554 * cb - 46802 * cr, y + 116130 * cb)):
        out[..., k] = np.clip((v + 32768) >> 16, 0, 255)
    return out


# --- reading


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, np.uint8)), 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out * 2 + b
        self.at += n
        return out

    def symbol(self, codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code * 2 + self.take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _codes(counts: bytes, symbols: bytes) -> dict:
    out, code, at = {}, 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code *= 2
    return out


def _extend(v: int, n: int) -> int:
    return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _matrix(bits: _Bits, rows: int, cols: int) -> np.ndarray:
    """Numbers of cols bits each."""
    got = bits.bits[bits.at : bits.at + rows * cols].reshape(rows, cols)
    bits.at += rows * cols
    out, tail = np.zeros(rows, np.int32), max(0, cols - 8)
    for k in range(tail):
        out = out * 2 + got[:, k]
    last = np.packbits(got[:, tail:], axis=1).ravel() >> (8 - (cols - tail))
    return (out << (cols - tail)) | last


def _signed(v: np.ndarray, n: int) -> np.ndarray:
    return np.where(v >> (n - 1) if n else 0, v, v - (1 << n) + 1) if n else v


def _dc_first(bits: _Bits, orders: list[np.ndarray], units: list[int], coefs: list[np.ndarray], tables: list[dict], low: int) -> None:
    """orders: the blocks of each component as the scan has them; units: how many of them an MCU has."""
    mcus = len(orders[0]) // units[0]
    if len({frozenset(t.items()) for t in tables}) == 1 and len(tables[0]) == 1 and (1, 0) in tables[0]:
        n = tables[0][1, 0]
        got = _matrix(bits, mcus * sum(units), 1 + n).reshape(mcus, sum(units))
        at = 0
        for order, u, c in zip(orders, units, coefs, strict=True):
            diff = _signed(got[:, at : at + u].ravel(), n)
            c[order, 0] = np.cumsum(diff) << low
            at += u
        return
    before = [0] * len(orders)
    for m in range(mcus):
        for k, (order, u) in enumerate(zip(orders, units, strict=True)):
            for b in order[m * u : (m + 1) * u]:
                n = bits.symbol(tables[k])
                before[k] += _extend(bits.take(n), n)
                coefs[k][b, 0] = before[k] << low


def _ac_first(bits: _Bits, order: np.ndarray, c: np.ndarray, table: dict, lo: int, hi: int, low: int) -> None:
    if len(table) == 1 and (1, 0) in table and table[1, 0] >> 4 == 0 and table[1, 0]:
        n = table[1, 0]
        c[order[:, None], np.arange(lo, hi + 1)] = (_signed(_matrix(bits, len(order) * (hi - lo + 1), 1 + n), n) << low).reshape(len(order), -1)
        return
    run = 0
    for b in order:
        if run:
            run -= 1
            continue
        k = lo
        while k <= hi:
            r, s = divmod(bits.symbol(table), 16)
            if s:
                k += r
                c[b, k] = _extend(bits.take(s), s) << low
                k += 1
            elif r == 15:
                k += 16
            else:
                run = (1 << r) + bits.take(r) - 1
                break


def _corrected(bits: _Bits, c: np.ndarray, blocks: np.ndarray, ks: np.ndarray, low: int) -> None:
    """A correction bit for each coefficient of these that is not zero."""
    part = c[blocks[:, None], ks]
    at = part != 0
    n = int(at.sum())
    got = bits.bits[bits.at : bits.at + n].astype(np.int32)
    bits.at += n
    part[at] += np.sign(part[at]) * (got << low) * ((np.abs(part[at]) >> low) & 1 == 0)
    c[blocks[:, None], ks] = part


def _ac_refined(bits: _Bits, order: np.ndarray, c: np.ndarray, table: dict, lo: int, hi: int, low: int) -> None:
    i = 0
    while i < len(order):
        k = lo
        while k <= hi:
            r, s = divmod(bits.symbol(table), 16)
            if not s and r < 15:
                run = (1 << r) + bits.take(r)
                _corrected(bits, c, order[i : i + 1], np.arange(k, hi + 1), low)
                _corrected(bits, c, order[i + 1 : i + run], np.arange(lo, hi + 1), low)
                i += run - 1
                break
            new = (1 if bits.take(1) else -1) if s else 0
            while k <= hi:
                if c[order[i], k]:
                    _corrected(bits, c, order[i : i + 1], np.array([k]), low)
                elif r:
                    r -= 1
                else:
                    c[order[i], k] = new << low if new > 0 else -(1 << low) * (new < 0)
                    k += 1
                    break
                k += 1
        i += 1


def _scanned(bits: _Bits, chosen: list, orders: list[np.ndarray], units: list[int], tables: dict, bounds: tuple) -> None:
    """One scan, or what lies between two of its restarts."""
    lo, hi, high, low = bounds
    coefs = [p["coefs"] for p, _ in chosen]
    if lo == 0 and not high:
        _dc_first(bits, orders, units, coefs, [tables[t >> 4] for _, t in chosen], low)
    elif lo == 0:
        mcus = len(orders[0]) // units[0]
        got = _matrix(bits, mcus * sum(units), 1).reshape(mcus, sum(units)) << low
        n = 0
        for c, order, u in zip(coefs, orders, units, strict=True):
            c[order, 0] |= got[:, n : n + u].ravel()
            n += u
    elif not high:
        _ac_first(bits, orders[0], coefs[0], tables[0x10 | (chosen[0][1] & 15)], lo, hi, low)
    else:
        _ac_refined(bits, orders[0], coefs[0], tables[0x10 | (chosen[0][1] & 15)], lo, hi, low)


def decode(data: bytes) -> dict:
    """height, width, comment, and of each component: its sampling factors, blocks across, quantisation, coefficients (n, 64)."""
    at, tables, quant, out, restart = 2, {}, {}, {"comment": b""}, 0
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        if data[at + 1] == 0xD9:
            break
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xFE:
            out["comment"] += body
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC2, 0xC8, 0xCC):
            raise ValueError("not a progressive JPEG with Huffman codes")
        elif mark == 0xC2:
            out["height"], out["width"] = struct.unpack(">HH", body[1:5])
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
            across, down = -(-out["width"] // (8 * hmax)), -(-out["height"] // (8 * vmax))
            out["parts"] = [{"id": i, "h": h, "v": v, "across": across * h, "own": (-(-(-(-out["width"] * h // hmax)) // 8), -(-(-(-out["height"] * v // vmax)) // 8)), "quant": q, "coefs": np.zeros((across * h * down * v, 64), np.int32)} for i, h, v, q in parts]
            out["mcus"] = (across, down)
        elif mark == 0xDA:
            chosen = [(next(p for p in out["parts"] if p["id"] == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            lo, hi, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = _MARK.search(data, at).start()
            spans = _RESTART.split(data[at:end]) if restart else [data[at:end]]
            at, high, low = end, approx >> 4, approx & 15
            across, down = out["mcus"]
            orders, units = [], []
            for p, _ in chosen:
                grid = np.arange(len(p["coefs"])).reshape(down * p["v"], across * p["h"])
                if len(chosen) > 1:
                    orders.append(grid.reshape(down, p["v"], across, p["h"]).transpose(0, 2, 1, 3).ravel())
                    units.append(p["h"] * p["v"])
                else:
                    orders.append(grid[: p["own"][1], : p["own"][0]].ravel())
                    units.append(1)
            for k, span in enumerate(spans):  # each starts anew, on a whole byte
                own = [o[k * restart * u : (k + 1) * restart * u] for o, u in zip(orders, units, strict=True)] if restart else orders
                _scanned(_Bits(span.replace(b"\xff\x00", b"\xff")), chosen, own, units, tables, (lo, hi, high, low))
    for p in out["parts"]:
        p["quant"] = quant[p["quant"]]
    return out


def pixels(image: dict) -> np.ndarray:
    """The image as (height, width, 3); chroma is upsampled by repetition."""
    planes = []
    hmax, vmax = max(p["h"] for p in image["parts"]), max(p["v"] for p in image["parts"])
    for p in image["parts"]:
        s = samples(p["coefs"] * p["quant"])
        plane = s.reshape(-1, p["across"], 8, 8).transpose(0, 2, 1, 3).reshape(-1, p["across"] * 8)
        planes.append(plane.repeat(vmax // p["v"], axis=0).repeat(hmax // p["h"], axis=1)[: image["height"], : image["width"]])
    if len(planes) == 1:
        return np.repeat(planes[0][..., None], 3, axis=2)
    return to_rgb(*planes)


# --- writing: blocks of 64 bytes as coefficients whose codes all have one length

#: Spectral bands of the first scans.
BANDS = ((1, 5), (6, 63))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _flat(bits: np.ndarray) -> bytes:
    bits = bits.ravel()
    raw = np.packbits(np.concatenate((bits, np.ones(-len(bits) % 8, np.uint8))))
    return raw.tobytes().replace(b"\xff", b"\xff\x00")


def _table(kind: int, counts: dict[int, int], symbols: bytes) -> bytes:
    return _segment(0xC4, bytes([kind, *(counts.get(n, 0) for n in range(1, 17))]) + symbols)


_TABLES = _segment(0xDB, bytes([0]) + bytes([1] * 64)) + _table(0x00, {1: 1}, bytes([9])) + _table(0x10, {1: 1}, bytes([8])) + _table(0x11, {4: 15}, bytes(r << 4 for r in range(15)))


def shape_of(blocks: int) -> tuple[int, int]:
    """MCUs across and down for so many blocks, six in an MCU."""
    mcus = max(1, -(-blocks // 6))
    across = int(np.ceil(np.sqrt(mcus)))
    return across, -(-mcus // across)


def encode(payload: bytes, comment: bytes) -> bytes:
    """A 4:2:0 image whose coefficients are the bytes of a payload of 64-byte blocks; blocks that fill the last MCUs are zero."""
    across, down = shape_of(len(payload) // 64)
    mcus = across * down
    raw = np.zeros(mcus * 6 * 64, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(mcus, 6, 64)
    out = [b"\xff\xd8", _segment(0xFE, comment), _TABLES, _segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))]
    scan = lambda parts, table, lo, hi, approx: _segment(0xDA, bytes([len(parts), *(x for p in parts for x in (p, table)), lo, hi, approx]))
    # first coefficients: -512 - b and b in turn, so that all differences have nine bits
    dc = [raw[:, :4, 0].ravel().astype(np.int32), raw[:, 4, 0].astype(np.int32), raw[:, 5, 0].astype(np.int32)]
    dc = [np.where(np.arange(len(x)) % 2, x, -512 - x) for x in dc]
    diff = [np.diff(x >> 1, prepend=0).reshape(mcus, -1) for x in dc]
    diff = np.hstack(diff).ravel()
    nine = np.where(diff < 0, diff + 511, diff).astype(">u2")
    bits = np.unpackbits(nine.view(np.uint8).reshape(-1, 2), axis=1)[:, 6:].copy()
    bits[:, 0] = 0
    out += [scan((1, 2, 3), 0x00, 0, 0, 0x01), _flat(bits)]
    grids = [raw[:, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64), raw[:, 4], raw[:, 5]]
    for lo, hi in BANDS:
        for p, g in enumerate(grids):
            part = np.unpackbits((g[:, lo : hi + 1] >> 1) | np.uint8(128)).reshape(-1, 8)
            nine = np.zeros((len(part), 9), np.uint8)
            nine[:, 1:] = part
            out += [scan((p + 1,), 0x00, lo, hi, 0x01), _flat(nine)]
    for p, g in enumerate(grids):
        last, parts, at = g[:, 1:] & 1, [], 0
        while at < len(last):
            r = min(14, (len(last) - at).bit_length() - 1)
            run = min(len(last) - at, (2 << r) - 1)
            more = run - (1 << r)
            head = [int(b) for b in f"{r:04b}" + (f"{more:0{r}b}" if r else "")]
            parts += [np.array(head, np.uint8), last[at : at + run].ravel()]
            at += run
        out += [scan((p + 1,), 0x01, 1, 63, 0x10), _flat(np.concatenate(parts))]
    last = np.hstack([(x & 1).reshape(mcus, -1) for x in dc]).astype(np.uint8)
    out += [scan((1, 2, 3), 0x00, 0, 0, 0x10), _flat(last), b"\xff\xd9"]
    return b"".join(out)


def blocks_of(image: dict) -> np.ndarray:
    """Coefficients in MCU order: (MCUs, 6, 64)."""
    across, down = image["mcus"]
    y, cb, cr = (p["coefs"] for p in image["parts"])
    y = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
    return np.concatenate((y, cb[:, None], cr[:, None]), axis=1)


def payload_of(blocks: np.ndarray) -> np.ndarray:
    """The bytes that encode stored, those of filling blocks included: (MCUs * 6, 64)."""
    out = (blocks - 256).astype(np.uint8)
    for part in (slice(0, 4), slice(4, 5), slice(5, 6)):
        dc = blocks[:, part, 0].ravel()
        out[:, part, 0] = np.where(np.arange(len(dc)) % 2, dc, -512 - dc).reshape(len(blocks), -1)
    return out.reshape(-1, 64)
