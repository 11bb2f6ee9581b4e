"""Bytes of the binary container: header, pages of cells, symbol table, footer.

A cell has 16 bytes, a 64-bit key and a 64-bit payload; a tick takes one, two or
four.  Pages span 4 MiB of a file, the first one less the header, and end in
marker cells where they aren't full.  Behind them come the symbol table, a trie
of two arrays, and the footer, which locates pages.
"""

from __future__ import annotations

import lzma
import struct
from dataclasses import dataclass

import numpy as np

# Fixed values of the format: signature, versions, marks of the byte order, flags, sizes.
SIGNATURE, OLD, NEW = b"UTE+", b"v0.1", b"v0.2"
LITTLE, BIG = b"><", b"<>"
ORDERED, PACKED, GROWING = 2, 8, 16
HEADER, FIRST, CELL, PAGE = 64, 4096, 16, 4 << 20
XZ = b"\xfd7zXZ\0"
ARRAYS, TAILS = 0xDAFCDAFC, 0xDFFCDFFC
ROOT, POOL = 2, 3
LEAST_CHAR = 0x20
LONGEST_SYMBOL, MOST_SYMBOLS = 63, 65_535
#: A further flag of this package's own: behind the header's fields stands what is to be added to the file's indices.
BASED, BASE_AT = 1, 32

#: Places that are tried for a node of the symbol table before it goes behind all others.
MOST_TRIES = 1024

#: Cells that a page gets: as many as the first one can take.
PAGE_CELLS = (PAGE - HEADER) // CELL
MARKER = np.uint64(0xFFFFFFFFFFFFFFFF)


class ContainerError(ValueError):
    """A file that isn't a container, or one that is broken."""


@dataclass(frozen=True)
class Header:
    order: str
    old: bool
    flags: int
    place: int
    table: int
    symbols: int
    pages: int
    footer: int
    #: An index in the file is 16 bits; the tick's own is this more.
    base: int = 0

    def pack(self) -> bytes:
        head = SIGNATURE + (OLD if self.old else NEW) + (LITTLE if self.order == "<" else BIG) + bytes([self.flags, BASED if self.base else 0])
        return (head + struct.pack(f"{self.order}IIHHIII", self.place, self.table, self.symbols, 0, self.pages, self.footer, self.base)).ljust(HEADER, b"\0")


def read_header(data: bytes) -> Header:
    if len(data) < 32 or data[:4] != SIGNATURE or data[4:8] not in (OLD, NEW):
        raise ContainerError("no container")
    if data[8:10] not in (LITTLE, BIG, b"\0\0"):
        raise ContainerError(f"byte order {data[8:10]!r}")
    order = ">" if data[8:10] == BIG else "<"
    place, table, symbols, _, pages, footer = struct.unpack_from(f"{order}IIHHII", data, 12)
    base = struct.unpack_from(f"{order}I", data, BASE_AT)[0] if data[11] & BASED and len(data) >= BASE_AT + 4 else 0
    return Header(order, data[4:8] == OLD, data[10], place or FIRST, table, symbols, pages, footer, base)


def footer_at(header: Header, size: int) -> int:
    return (size - header.footer) // CELL * CELL


def table_at(header: Header, size: int) -> int:
    """Where the symbol table begins: it ends before the footer."""
    return (size - header.footer - header.table) // CELL * CELL


def footer_cells(data: bytes, order: str) -> list[tuple[int, int, int]]:
    """(offset, length, unpacked cells) of each page."""
    return [struct.unpack_from(f"{order}QII", data, at) for at in range(0, len(data) // CELL * CELL, CELL)]


def pack_footer(pages: list[tuple[int, int, int]], order: str) -> bytes:
    return b"".join(struct.pack(f"{order}QII", *p) for p in pages)


def packed_size(head: bytes) -> int:
    """Bytes in the file of a packed page that begins so, 0 for a plain one."""
    if head[4:10] != XZ:
        return 0
    # The length is in the byte order of the machine that packed; only one of both is that of a page.
    size = min(struct.unpack("<I", head[:4])[0], struct.unpack(">I", head[:4])[0])
    return -(-(size + 4) // CELL) * CELL


def pack_page(data: bytes, order: str = "<") -> bytes:
    out = lzma.compress(data, lzma.FORMAT_XZ, lzma.CHECK_CRC64, preset=2)
    out = struct.pack(f"{order}I", len(out)) + out
    return out.ljust(-(-len(out) // CELL) * CELL, b"\0")


def unpack_page(data: bytes) -> bytes:
    if not packed_size(data[:10]):
        return data
    size = min(struct.unpack("<I", data[:4])[0], struct.unpack(">I", data[:4])[0])
    try:
        return lzma.decompress(data[4 : 4 + size])
    except lzma.LZMAError as error:
        raise ContainerError(f"packed page: {error}") from error


def key_fields(key: np.ndarray, old: bool = False) -> tuple[np.ndarray, ...]:
    """(sec, msec, idx, ttf) of keys; the old layout has second, millisecond, type and index from the low bits on."""
    part = lambda at, bits: (key >> np.uint64(at) & np.uint64((1 << bits) - 1)).astype(np.int64)
    if old:
        return part(0, 32), part(32, 10), part(48, 16), part(42, 6)
    return part(32, 32), part(22, 10), part(6, 16), part(0, 6)


def starts(step: np.ndarray) -> np.ndarray:
    """Places that are reached from 0 by going step[i] on from each i: jumps are doubled until they leave the page."""
    n = step.size
    if n == 0 or (step == 1).all():
        return np.arange(n)
    jump = np.minimum(np.append(np.arange(n) + step, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        before = int(reached.sum())
        reached[jump[reached]] = True
        if int(reached.sum()) == before:
            return np.flatnonzero(reached[:n])
        jump = jump[jump]


def decode_page(data: bytes, order: str = "<", old: bool = False) -> dict[str, np.ndarray]:
    """Ticks of a page: key fields, the first six 32-bit words of the payload as integers, and w, the first two as one."""
    words = np.frombuffer(data[: len(data) // CELL * CELL], f"{order}u4").astype(np.uint64).reshape(-1, 4)
    high, low = (1, 0) if order == "<" else (0, 1)
    key = words[:, high] << np.uint64(32) | words[:, low]
    free = (key == 0) | (key == MARKER)
    ttf = key_fields(key, old)[3]
    step = np.where(free, 1, np.where(ttf & 32 != 0, 4, np.where(ttf & 16 != 0, 2, 1)))
    at = starts(step)
    at = at[~free[at] & (at + step[at] <= key.size)]
    sec, msec, idx, ttf = key_fields(key[at], old)
    words = np.concatenate([words, np.zeros((1, 4), np.uint64)]).astype(np.int64)
    two = step[at] > 1
    word = lambda cell, k: np.where(two, words[np.minimum(at + cell, len(words) - 1), k], 0) if cell else words[at, k]
    first, second = words[at, 2 + high].astype(np.uint64), words[at, 2 + low].astype(np.uint64)
    return {"sec": sec, "msec": msec, "idx": idx, "ttf": ttf, "a": word(0, 2), "b": word(0, 3), "c": word(1, 0), "d": word(1, 1), "e": word(1, 2), "f": word(1, 3), "w": (first << np.uint64(32) | second).view(np.int64)}


def encode_page(t: dict[str, np.ndarray], order: str = "<", old: bool = False) -> bytes:
    """Cells of ticks; w counts for types of one wide number, and in the first two words of a volume candle."""
    ttf = t["ttf"].astype(np.int64)
    if ((ttf & 0x30) == 0x30).any() or ((ttf & 0x20) != 0).any():
        raise ContainerError("a tick type that isn't written")
    if ((t["idx"] < 0) | (t["idx"] > MOST_SYMBOLS)).any():
        raise ContainerError(f"an index that isn't within 0 and {MOST_SYMBOLS}")
    u = lambda c: t[c].astype(np.int64).view(np.uint64)
    if old:
        key = u("idx") << np.uint64(48) | u("ttf") << np.uint64(42) | u("msec") << np.uint64(32) | u("sec")
    else:
        key = u("sec") << np.uint64(32) | u("msec") << np.uint64(22) | u("idx") << np.uint64(6) | u("ttf")
    two = (ttf & 16) != 0
    at = np.cumsum(np.where(two, 2, 1)) - np.where(two, 2, 1)
    words = np.zeros((int(np.where(two, 2, 1).sum()), 4), np.uint64)
    high, low = (1, 0) if order == "<" else (0, 1)
    cut = np.uint64(0xFFFFFFFF)
    words[at, high], words[at, low] = key >> np.uint64(32), key & cut
    words[at, 2], words[at, 3] = u("a"), u("b")
    wide = np.isin(ttf, (8, 9, 10, 11, 15, 0x18))
    words[at[wide], 2 + high], words[at[wide], 2 + low] = (u("w") >> np.uint64(32))[wide], (u("w") & cut)[wide]
    for k, c in enumerate("cdef"):
        words[at[two] + 1, k] = u(c)[two]
    return words.astype(f"{order}u4").tobytes()


def symbol_table(names: dict[str, int]) -> bytes:
    """The trie of symbols: base and check cells with a circular list of free ones, then tails with indices."""
    keys = {}
    for name, idx in names.items():
        raw = name.encode("ascii", "replace")
        if raw.decode() != name or not 0 < len(raw) <= LONGEST_SYMBOL or min(raw) < LEAST_CHAR or not 0 < idx <= MOST_SYMBOLS:
            raise ContainerError(f"symbol {name!r} with index {idx}")
        keys[bytes(c - LEAST_CHAR + 1 for c in raw)] = idx
    base, check, tails, lowest, top = {ROOT: POOL}, {ROOT: 0}, [], POOL, POOL
    # Cells are never freed: where some characters found no room once there is none for them later.
    full: dict[tuple[int, ...], int] = {}
    # Nodes that branch, with the keys below them and how much of a key leads there.
    open_nodes = [(ROOT, sorted(keys), 0)] if keys else []
    while open_nodes:
        node, below, depth = open_nodes.pop()
        groups: dict[int, list[bytes]] = {}
        for key in below:
            groups.setdefault(key[depth] if depth < len(key) else 0, []).append(key)
        chars = tuple(sorted(groups))
        at = max(lowest - chars[0], full.get(chars, POOL), POOL)
        until = at + MOST_TRIES
        while any(at + c in check for c in chars):
            at += 1
            if at == until:
                break
        full[chars] = at
        at = at if at < until else max(top, POOL)
        base[node] = at
        for c, own in groups.items():
            check[at + c] = node
            top = max(top, at + c + 1)
            if len(own) == 1:
                tails.append((keys[own[0]], own[0][depth + 1 :]))
                base[at + c] = -len(tails)
            else:
                open_nodes.append((at + c, own, depth + 1))
        while lowest in check:
            lowest += 1
    n = max(check) + 1
    free = [1, *(i for i in range(POOL, n) if i not in check)]
    cells = np.zeros((n, 2), ">u4")
    signed = cells.view(">i4")
    for i in check:
        signed[i] = base[i], check[i]
    for i, cell in enumerate(free):
        signed[cell] = -free[i - 1], -free[(i + 1) % len(free)]
    cells[0] = ARRAYS, n
    out = [cells.tobytes(), struct.pack(">III", TAILS, 0, len(tails))]
    out += [struct.pack(">iiH", -1, idx, len(rest)) + rest for idx, rest in tails]
    return b"".join(out)


def read_symbols(data: bytes) -> dict[int, str]:
    """Symbols by index."""
    if len(data) < 8:
        return {}
    mark, n = struct.unpack_from(">II", data)
    if mark != ARRAYS or 8 * n + 12 > len(data):
        raise ContainerError("symbol table")
    cells = np.frombuffer(data, ">i4", 2 * n).reshape(-1, 2)
    mark, _, count = struct.unpack_from(">III", data, 8 * n)
    if mark != TAILS:
        raise ContainerError("tails of the symbol table")
    tails, at = [], 8 * n + 12
    for _ in range(count):
        _, idx, length = struct.unpack_from(">iiH", data, at)
        tails.append((idx, data[at + 10 : at + 10 + length]))
        at += 10 + length
    out = {}
    for leaf in np.flatnonzero(cells[:, 0] < 0).tolist():
        node, chars = leaf, []
        while node > ROOT:
            up = int(cells[node, 1])
            if not ROOT <= up < n or len(chars) > LONGEST_SYMBOL:  # a free cell, or a ring
                break
            chars.append(node - int(cells[up, 0]))
            node = up
        if node == ROOT and -cells[leaf, 0] <= len(tails):
            idx, rest = tails[-int(cells[leaf, 0]) - 1]
            out[idx] = bytes(c - 1 + LEAST_CHAR for c in [*chars[::-1], *rest] if 0 < c <= 256 - LEAST_CHAR).decode("latin-1")
    return out
