"""Media columns: progressive JPEG files decoded to RGB tensors, with nothing but numpy.

The decoder takes baseline, extended and progressive Huffman files of 8 bits with one or three components,
any sampling factors, restart intervals and tables of 8 or 16 bits. Scans of a progressive file, by spectral
selection and successive approximation, accumulate in one coefficient array for each component; these are
dequantised, inverse-transformed in one matrix product, upsampled to the full resolution by repetition, and
converted to RGB.

A null file gives null tensors; a file that cannot be decoded (truncated, arithmetic-coded, lossless, of 12
bits or four components) gives null tensors and the reason in `error`. Rows that repeat are decoded each.

The tables at hand hold no images, so `render` makes one of each embedding, and `encode_progressive` writes
it as a progressive file; both serve the query and the tests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.common import col, extended

ZIGZAG = np.array([0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63])
_U, _X = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
DCT = np.where(_U == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _X + 1) * _U * np.pi / 16)


class JpegError(ValueError):
    """The bytes are not a JPEG file that the decoder takes."""


@lru_cache(maxsize=256)
def _lookup(table: bytes) -> list[int]:
    """For each 16 bits ahead: length of the code << 8 | symbol; 0 where none begins so."""
    out, code, at = [0] * 65536, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            if lo + (1 << (16 - length)) > 65536 or at >= len(table):
                raise JpegError("bad Huffman table")
            out[lo : lo + (1 << (16 - length))] = [length << 8 | table[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    """The bits of one entropy-coded segment."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data + b"\0\0\0\0", 0, 8 * len(data)

    def symbol(self, table: list[int]) -> int:
        at = self.at
        i, d = at >> 3, self.data
        if at >= self.size:
            raise JpegError("the file is cut short")
        found = table[((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (8 - (at & 7))) & 0xFFFF]
        if not found:
            raise JpegError("bad Huffman code")
        self.at = at + (found >> 8)
        return found & 255

    def bits(self, n: int) -> int:
        if not n:
            return 0
        if n > 16:
            raise JpegError("a value of more than 16 bits")
        at = self.at
        i, d = at >> 3, self.data
        self.at = at + n
        if self.at > self.size:
            raise JpegError("the file is cut short")
        return ((d[i] << 16 | d[i + 1] << 8 | d[i + 2]) >> (24 - (at & 7) - n)) & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.bits(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


class _Component:
    def __init__(self, ident: int, h: int, v: int, quant: int):
        self.ident, self.h, self.v, self.quant = ident, h, v, quant
        self.pred = 0


def _ac_first(bits: _Bits, coef: list[int], base: int, table: list[int], ss: int, se: int, al: int, run: int) -> int:
    if run:
        return run - 1
    k = ss
    while k <= se:
        rs = bits.symbol(table)
        r, s = rs >> 4, rs & 15
        if s:
            k += r
            if k > se:
                raise JpegError("a run leaves its block")
            coef[base + k] = bits.signed(s) << al if s else 0
            k += 1
        elif r == 15:
            k += 16
        else:
            return (1 << r) - 1 + bits.bits(r)
    return 0


def _ac_refine(bits: _Bits, coef: list[int], base: int, table: list[int], ss: int, se: int, al: int, run: int) -> int:
    one, k = 1 << al, ss
    if not run:
        while k <= se:
            rs = bits.symbol(table)
            r, s = rs >> 4, rs & 15
            new = 0
            if s:
                new = one if bits.bits(1) else -one
            elif r < 15:
                run = (1 << r) + bits.bits(r)
                break
            while k <= se:
                at = base + k
                if coef[at]:
                    if bits.bits(1) and not abs(coef[at]) & one:
                        coef[at] += one if coef[at] > 0 else -one
                elif r:
                    r -= 1
                else:
                    if new:
                        coef[at] = new
                    k += 1
                    break
                k += 1
    if run:
        while k <= se:
            at = base + k
            if coef[at] and bits.bits(1) and not abs(coef[at]) & one:
                coef[at] += one if coef[at] > 0 else -one
            k += 1
        run -= 1
    return run


class _Decoder:
    def __init__(self, data: bytes):
        self.data, self.quants, self.tables, self.parts, self.restart, self.progressive, self.adobe = data, {}, {}, [], 0, False, None

    def decode(self) -> np.ndarray:
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise JpegError("no JPEG file")
        scans = 0
        while True:
            while at < len(d) and d[at] != 0xFF:
                at += 1
            while at < len(d) and d[at] == 0xFF:
                at += 1
            if at >= len(d):
                raise JpegError("the file has no end")
            mark = d[at]
            at += 1
            if mark == 0xD9:
                break
            if mark == 0 or mark == 1 or 0xD0 <= mark <= 0xD7:
                continue
            if at + 2 > len(d):
                raise JpegError("the file is cut short")
            size = d[at] << 8 | d[at + 1]
            body = d[at + 2 : at + size]
            if size < 2 or len(body) != size - 2:
                raise JpegError("the file is cut short")
            at += size
            if mark == 0xDB:
                self._quant(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark in (0xC0, 0xC1, 0xC2):
                self._frame(body, mark == 0xC2)
            elif 0xC3 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
                raise JpegError("lossless, arithmetic or hierarchical coding")
            elif mark == 0xDD:
                self.restart = body[0] << 8 | body[1]
            elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
                self.adobe = body[11]
            elif mark == 0xDA:
                at = self._scan(body, at)
                scans += 1
        if not scans:
            raise JpegError("the file has no scan")
        return self._image()

    def _quant(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quants[ident] = np.frombuffer(body[at + 1 : at + 1 + n], dtype=">u2" if wide else np.uint8).astype(np.int64)
            at += 1 + n

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at + 17 <= len(body):
            n = sum(body[at + 1 : at + 17])
            self.tables[body[at]] = _lookup(bytes(body[at + 1 : at + 17 + n]))
            at += 17 + n

    def _frame(self, body: bytes, progressive: bool) -> None:
        if self.parts or len(body) < 6 or body[0] != 8 or body[5] not in (1, 3) or len(body) < 6 + 3 * body[5]:
            raise JpegError("two frames, other than 8 bits, or neither one nor three components")
        self.progressive, self.height, self.width = progressive, body[1] << 8 | body[2], body[3] << 8 | body[4]
        self.parts = [_Component(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        if not self.height or not self.width or any(not 1 <= x <= 4 for c in self.parts for x in (c.h, c.v)):
            raise JpegError("bad size or sampling factors")
        self.h, self.v = max(c.h for c in self.parts), max(c.v for c in self.parts)
        self.across, self.down = -(-self.width // (8 * self.h)), -(-self.height // (8 * self.v))
        # a block takes a bit at least, so a frame that the file cannot fill is refused before it takes memory
        if self.across * self.down * sum(c.h * c.v for c in self.parts) > 8 * len(self.data):
            raise JpegError("the file is cut short")
        for c in self.parts:
            c.stride, c.rows = self.across * c.h, self.down * c.v
            c.own_across, c.own_down = -(-(-(-self.width * c.h // self.h)) // 8), -(-(-(-self.height * c.v // self.v)) // 8)
            c.coef = [0] * (64 * c.stride * c.rows)

    def _scan(self, body: bytes, at: int) -> int:
        n = body[0] if body else 0
        if not self.parts or len(body) < 4 + 2 * n or not n:
            raise JpegError("bad scan")
        chosen = []
        for i in range(n):
            part = next((c for c in self.parts if c.ident == body[1 + 2 * i]), None)
            if part is None:
                raise JpegError("a scan of an unknown component")
            part.dc, part.ac, part.pred = self.tables.get(body[2 + 2 * i] >> 4), self.tables.get(16 | body[2 + 2 * i] & 15), 0
            chosen.append(part)
        ss, se, ah, al = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if not self.progressive:
            ss, se, ah, al = 0, 63, 0, 0
        if ss > se or se > 63 or (self.progressive and ss and n > 1):
            raise JpegError("bad spectral selection")
        segments, end = self._segments(at)
        if n > 1:
            units = [[(c, (y * c.v + j) * c.stride + x * c.h + i) for c in chosen for j in range(c.v) for i in range(c.h)] for y in range(self.down) for x in range(self.across)]
        else:
            c = chosen[0]
            units = [[(c, y * c.stride + x)] for y in range(c.own_down) for x in range(c.own_across)]
        step = self.restart or len(units)
        for nth, begin in enumerate(range(0, len(units), step)):
            if nth >= len(segments):
                raise JpegError("the file is cut short")
            bits, run = _Bits(segments[nth]), 0
            for c in chosen:
                c.pred = 0
            for unit in units[begin : begin + step]:
                for c, block in unit:
                    run = self._block(bits, c, 64 * block, ss, se, ah, al, run)
        return end

    def _block(self, bits: _Bits, c: _Component, base: int, ss: int, se: int, ah: int, al: int, run: int) -> int:
        if ss == 0:
            if ah:
                if bits.bits(1):
                    c.coef[base] |= 1 << al
            else:
                if c.dc is None:
                    raise JpegError("no Huffman table")
                c.pred += bits.signed(bits.symbol(c.dc))
                c.coef[base] = c.pred << al
            if self.progressive:
                return 0
        if c.ac is None and se:
            raise JpegError("no Huffman table")
        return (_ac_refine if ah else _ac_first)(bits, c.coef, base, c.ac, max(ss, 1), se, al, run)

    def _segments(self, at: int) -> tuple[list[bytes], int]:
        d, out, begin = self.data, [], at
        while True:
            at = d.find(b"\xff", at)
            if at < 0 or at + 1 >= len(d):
                out.append(d[begin:].replace(b"\xff\0", b"\xff"))
                return out, len(d)
            if d[at + 1] == 0:
                at += 2
            elif d[at + 1] == 0xFF:
                at += 1
            elif 0xD0 <= d[at + 1] <= 0xD7:
                out.append(d[begin:at].replace(b"\xff\0", b"\xff"))
                at = begin = at + 2
            else:
                out.append(d[begin:at].replace(b"\xff\0", b"\xff"))
                return out, at

    def _image(self) -> np.ndarray:
        planes = []
        for c in self.parts:
            if c.quant not in self.quants or len(self.quants[c.quant]) != 64:
                raise JpegError("no quantisation table")
            flat = np.zeros((c.stride * c.rows, 64))
            flat[:, ZIGZAG] = np.array(c.coef, dtype=np.int64).reshape(-1, 64) * self.quants[c.quant]
            blocks = DCT.T @ flat.reshape(-1, 8, 8) @ DCT
            plane = blocks.reshape(c.rows, c.stride, 8, 8).transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.stride)
            plane = np.clip(np.rint(plane + 128), 0, 255)
            y = np.arange(self.height) * c.v // self.v
            x = np.arange(self.width) * c.h // self.h
            planes.append(plane[y[:, None], x[None, :]])
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        if self.adobe == 0:
            return np.stack(planes, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb], axis=2)
        return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) uint8."""
    try:
        return _Decoder(data).decode()
    except JpegError:
        raise
    except (IndexError, ValueError, OverflowError) as e:
        raise JpegError(f"a damaged file: {e}") from e


_LUMA = np.array([16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99])
#: A code for every symbol, so that one table serves all scans: 1 of 2 bits, 6 of 4, 12 of 6, 60 of 9, 177 of 12.
_ORDER = [0x01, 0x00, 0x02, 0x11, 0x03, 0x21, 0x10]
_SYMBOLS = bytes(_ORDER + [s for s in range(256) if s not in _ORDER])
_COUNTS = bytes([0, 1, 0, 6, 0, 12, 0, 0, 60, 0, 0, 177, 0, 0, 0, 0])


def _codes() -> list[tuple[int, int]]:
    out, code, at = [(0, 0)] * 256, 0, 0
    for length in range(1, 17):
        for _ in range(_COUNTS[length - 1]):
            out[_SYMBOLS[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_CODES = _codes()


class _Writer:
    def __init__(self):
        self.acc, self.n = 1, 0

    def put(self, value: int, n: int) -> None:
        self.acc = self.acc << n | value
        self.n += n

    def symbol(self, s: int) -> None:
        self.put(*_CODES[s])

    def amount(self, v: int, size: int) -> None:
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        acc = ((self.acc << pad | (1 << pad) - 1) & ((1 << self.n + pad) - 1)) if self.n else 0
        return acc.to_bytes((self.n + pad) // 8, "big").replace(b"\xff", b"\xff\0")


def _shift(v: int, al: int) -> int:
    return v >> al if v >= 0 else -(-v >> al)


def _write_ac_first(w: _Writer, blocks: list[list[int]], ss: int, se: int, al: int) -> None:
    run = 0

    def flush() -> None:
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for block in blocks:
        zeros = 0
        for k in range(ss, se + 1):
            v = _shift(block[k], al)
            if not v:
                zeros += 1
                continue
            flush()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            size = abs(v).bit_length()
            w.symbol(zeros << 4 | size)
            w.amount(v, size)
            zeros = 0
        if zeros:
            run += 1
            if run == 32767:
                flush()
    flush()


def _write_ac_refine(w: _Writer, blocks: list[list[int]], ss: int, se: int, al: int) -> None:
    run, pending = 0, []

    def flush() -> None:
        nonlocal run, pending
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
        for b in pending:
            w.put(b, 1)
        run, pending = 0, []

    for block in blocks:
        size = [abs(v) >> al for v in block]
        last = max((k for k in range(ss, se + 1) if size[k] == 1), default=-1)
        zeros, own = 0, []
        for k in range(ss, se + 1):
            if not size[k]:
                zeros += 1
                continue
            while zeros > 15 and k <= last:
                flush()
                w.symbol(0xF0)
                zeros -= 16
                for b in own:
                    w.put(b, 1)
                own = []
            if size[k] > 1:
                own.append(size[k] & 1)
                continue
            flush()
            w.symbol(zeros << 4 | 1)
            w.put(int(block[k] > 0), 1)
            for b in own:
                w.put(b, 1)
            zeros, own = 0, []
        if zeros or own:
            run += 1
            pending += own
            if run == 32767 or len(pending) > 900:
                flush()
    flush()


def encode_progressive(rgb: np.ndarray, quality: int = 75, sampling: tuple[int, int] = (2, 2), gray: bool = False, restart: int = 0) -> bytes:
    """A progressive file of ten scans (DC in two, luma's and chroma's AC in first and refining ones)."""
    height, width = rgb.shape[:2]
    r, g, b = (rgb[..., i].astype(float) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b]
    if not gray:
        planes += [128 - 0.168735892 * r - 0.331264108 * g + 0.5 * b, 128 + 0.5 * r - 0.418687589 * g - 0.081312411 * b]
    h, v = sampling if not gray else (1, 1)
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    quant = np.clip((_LUMA * scale + 50) // 100, 1, 255).astype(int)
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    parts = []
    for i, plane in enumerate(planes):
        ph, pv = (h, v) if i == 0 else (1, 1)
        full = np.pad(plane, ((0, 8 * v * down - height), (0, 8 * h * across - width)), mode="edge")
        full = full.reshape(full.shape[0] * pv // v, v // pv, full.shape[1] * ph // h, h // ph).mean(axis=(1, 3)) - 128
        rows, stride = full.shape[0] // 8, full.shape[1] // 8
        blocks = DCT @ full.reshape(rows, 8, stride, 8).transpose(0, 2, 1, 3) @ DCT.T
        coef = np.rint(blocks.reshape(-1, 64) / quant).astype(int)[:, ZIGZAG].tolist()
        own = [y * stride + x for y in range(-(-(-(-height * pv // v)) // 8)) for x in range(-(-(-(-width * ph // h)) // 8))]
        parts.append((ph, pv, stride, coef, [coef[o] for o in own]))
    units = [[(i, (y * p[1] + j) * p[2] + x * p[0] + k) for i, p in enumerate(parts) for j in range(p[1]) for k in range(p[0])] for y in range(down) for x in range(across)]
    if gray:
        units = [[(0, y * parts[0][2] + x)] for y in range(down) for x in range(across)]

    def segment(mark: int, body: bytes) -> bytes:
        return bytes([0xFF, mark]) + (len(body) + 2).to_bytes(2, "big") + body

    out = [b"\xff\xd8", segment(0xDB, b"\0" + bytes(quant[ZIGZAG].tolist()))]
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(parts)])
    out.append(segment(0xC2, frame + b"".join(bytes([i + 1, p[0] << 4 | p[1], 0]) for i, p in enumerate(parts))))
    out += [segment(0xC4, bytes([kind]) + _COUNTS + _SYMBOLS) for kind in (0x00, 0x10)]
    if restart:
        out.append(segment(0xDD, restart.to_bytes(2, "big")))

    def scan(which: list[int], ss: int, se: int, ah: int, al: int, pieces: list[bytes]) -> None:
        out.append(segment(0xDA, bytes([len(which)]) + b"".join(bytes([i + 1, 0]) for i in which) + bytes([ss, se, ah << 4 | al])))
        out.append(b"".join(p + (bytes([0xFF, 0xD0 + n % 8]) if n + 1 < len(pieces) else b"") for n, p in enumerate(pieces)))

    def dc(al: int, refine: bool) -> list[bytes]:
        done, step = [], restart or len(units)
        for begin in range(0, len(units), step):
            w, pred = _Writer(), [0] * len(parts)
            for unit in units[begin : begin + step]:
                for i, at in unit:
                    value = parts[i][3][at][0] >> al
                    if refine:
                        w.put(value & 1, 1)
                    else:
                        size = abs(value - pred[i]).bit_length()
                        w.symbol(size)
                        w.amount(value - pred[i], size)
                        pred[i] = value
            done.append(w.bytes())
        return done

    def ac(i: int, ss: int, se: int, al: int, write) -> list[bytes]:
        done, blocks = [], parts[i][4]
        step = restart or len(blocks)
        for begin in range(0, len(blocks), step):
            w = _Writer()
            write(w, blocks[begin : begin + step], ss, se, al)
            done.append(w.bytes())
        return done

    every = list(range(len(parts)))
    scan(every, 0, 0, 0, 1, dc(1, False))
    scan([0], 1, 5, 0, 2, ac(0, 1, 5, 2, _write_ac_first))
    for i in every[1:]:
        scan([i], 1, 63, 0, 1, ac(i, 1, 63, 1, _write_ac_first))
    scan([0], 6, 63, 0, 2, ac(0, 6, 63, 2, _write_ac_first))
    scan([0], 1, 63, 2, 1, ac(0, 1, 63, 1, _write_ac_refine))
    scan(every, 0, 0, 1, 0, dc(0, True))
    for i in every:
        scan([i], 1, 63, 1, 0, ac(i, 1, 63, 0, _write_ac_refine))
    return b"".join([*out, b"\xff\xd9"])


def render(vector: np.ndarray, width: int = 16, height: int = 12) -> np.ndarray:
    """An RGB picture of a vector: its values along three paths through the picture."""
    v = np.asarray(vector, dtype=float)
    top = np.abs(v).max() or 1.0
    y, x = np.mgrid[0:height, 0:width]
    at = np.stack([(y // 3) * 5 + x // 3, (x // 3) * 7 + y // 3, (x // 4) + (y // 2) * 11], axis=2) % len(v)
    return np.clip(128 + 110 * v[at] / top, 0, 255).astype(np.uint8)


def _file_of(v: np.ndarray) -> bytes:
    n = zlib.crc32(v.astype(np.float32).tobytes())
    sampling = ((2, 2), (2, 1), (1, 1), (1, 2))[n >> 8 & 3]
    return encode_progressive(render(v, 9 + n % 16, 7 + (n >> 4) % 12), 60 + (n >> 10) % 36, sampling, gray=n >> 16 & 15 == 0, restart=2 * (n >> 20 & 3 == 0))


def with_pictures(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, jpeg): a progressive file for each vector; null for a null or empty one or one that isn't finite.

    Width (9 to 24), height (7 to 18), sampling, gray and restarts differ by the vector's values.
    """
    rows = df.select(col(id_col).alias("id"), col(vec_col).alias("vec"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for v in batch.column(1).to_pylist():
                ok = v and None not in v and np.isfinite(v).all()
                files.append(_file_of(np.array(v)) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["id", "jpeg"])

    return rows.mapInArrow(draw, extended(rows.select("id").schema, "jpeg binary"))


def decode_column(df: DataFrame, id_col: str, jpeg_col: str) -> DataFrame:
    """(id, height, width, channels, tensor, error), a row for each row; tensor: rows of RGB bytes."""
    rows = df.select(col(id_col).alias("id"), col(jpeg_col).alias("jpeg"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tensors, errors = [], []
            for data in batch.column(1).to_pylist():
                tensor = error = None
                if data is not None:
                    try:
                        tensor = decode(data)
                    except JpegError as e:
                        error = str(e)
                tensors.append(tensor)
                errors.append(error)
            shape = [pa.array([t.shape[i] if t is not None else None for t in tensors], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *shape, pa.array([t.tobytes() if t is not None else None for t in tensors], pa.binary()), pa.array(errors, pa.string())], ["id", "height", "width", "channels", "tensor", "error"])

    return rows.mapInArrow(unpack, extended(rows.select("id").schema, "height int, width int, channels int, tensor binary, error string"))
