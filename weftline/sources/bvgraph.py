"""Decoder, encoder and indexes of graphs in the public BV format (WebGraph, Boldi & Vigna 2004).

A vertex is stored as its outdegree, a reference to an earlier vertex and which of its
successors to copy, intervals of successive ids, and the remaining ids as gaps.
"""

from __future__ import annotations

import os
import uuid
from array import array
from heapq import merge

import numpy as np

from weftline.sources import bitio, bitvec
from weftline.sources.properties import read_properties

_READ = {"GAMMA": bitio.read_gamma, "DELTA": bitio.read_delta, "UNARY": bitio.read_unary}


class Codes:
    """Codes and parameters of a graph, from its properties."""

    def __init__(self, properties: dict[str, str]):
        self.vertices, self.edges = int(properties["nodes"]), int(properties["arcs"])
        self.window = int(properties.get("windowsize", 7))
        self.min_interval = int(properties.get("minintervallength", 4))
        self.k = k = int(properties.get("zetak", 3))
        flags = {f.strip().rpartition("_")[0]: f.strip().rpartition("_")[2] for f in properties.get("compressionflags", "").split("|") if "_" in f}
        usual = {"OUTDEGREES": "GAMMA", "BLOCKS": "GAMMA", "BLOCK_COUNT": "GAMMA", "REFERENCES": "UNARY", "RESIDUALS": "ZETA", "OFFSETS": "GAMMA"}
        self.kinds = {name: flags.get(name, default) for name, default in usual.items()}
        zeta = lambda s, at: bitio.read_zeta(s, at, k)
        pick = lambda name: zeta if (c := self.kinds[name]) == "ZETA" else _READ[c]
        self.outdegree, self.blocks, self.block_count = pick("OUTDEGREES"), pick("BLOCKS"), pick("BLOCK_COUNT")
        self.references, self.residuals = pick("REFERENCES"), pick("RESIDUALS")


def decode_vertex(s: str, at: int, x: int, c: Codes, successors_of) -> tuple[list[int], int]:
    """Successors of vertex x, whose code starts at ``at``, and the position behind it."""
    degree, at = c.outdegree(s, at)
    if not degree:
        return [], at
    copied: list[int] = []
    reference = 0
    if c.window:
        reference, at = c.references(s, at)
    if reference:
        source = successors_of(x - reference)
        count, at = c.block_count(s, at)
        place = 0
        for i in range(count):
            n, at = c.blocks(s, at)
            n += i > 0
            if i % 2 == 0:
                copied += source[place : place + n]
            place += n
        if count % 2 == 0:
            copied += source[place:]
    extra, intervals = degree - len(copied), []
    if extra and c.min_interval:
        count, at = bitio.read_gamma(s, at)
        last = x
        for i in range(count):
            n, at = bitio.read_gamma(s, at)
            left = bitio.from_nat(n) + x if i == 0 else last + n + 1
            n, at = bitio.read_gamma(s, at)
            n += c.min_interval
            intervals += range(left, left + n)
            last, extra = left + n, extra - n
    rest: list[int] = []
    if extra:
        n, at = c.residuals(s, at)
        value = x + bitio.from_nat(n)
        rest.append(value)
        read = c.residuals
        for _ in range(extra - 1):
            n, at = read(s, at)
            value += n + 1
            rest.append(value)
    parts = [p for p in (copied, intervals, rest) if p]
    return (parts[0] if len(parts) == 1 else list(merge(*parts))), at


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length)."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _sums(steps: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Prefix sums inside each of the consecutive runs of ``counts`` numbers."""
    total, first = np.cumsum(steps), np.cumsum(counts) - counts
    return total - np.repeat((total[first[counts > 0]] - steps[first[counts > 0]]), counts[counts > 0]) if len(steps) else total


def _signed(n: np.ndarray) -> np.ndarray:
    return (n >> 1) ^ -(n & 1)


def decode_vertices(bits: bitvec.Bits, at: np.ndarray, x: np.ndarray, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Outdegrees and successors of the ascending vertices x, side by side; their references must be among them."""
    read = lambda name: bits.reader(c.kinds[name], c.k)
    degree, at = read("OUTDEGREES")(at)
    copied, reference = np.zeros_like(degree), np.zeros_like(degree)
    some = np.flatnonzero(degree)
    if c.window and len(some):
        reference[some], at[some] = read("REFERENCES")(at[some])
    place = np.cumsum(degree) - degree
    out = np.empty(int(degree.sum()), np.int64)

    # which runs of the referred vertex's successors are copied
    by = np.flatnonzero(reference)
    source = np.searchsorted(x, x[by] - reference[by])
    count, at[by] = read("BLOCK_COUNT")(at[by])
    length, at[by] = bitvec.runs(read("BLOCKS"), at[by], count)
    rank = _spread(np.zeros_like(count), count)
    length += rank > 0
    begin, owner = _sums(length, count) - length, np.repeat(np.arange(len(by)), count)
    covered = np.bincount(owner, length, len(by)).astype(np.int64)
    tail = np.where(count % 2 == 0, degree[source] - covered, 0)
    even = rank % 2 == 0
    copied[by] = np.bincount(owner[even], length[even], len(by)).astype(np.int64) + tail
    run_owner = np.concatenate([owner[even], np.arange(len(by))])
    run_begin, run_length = np.concatenate([begin[even], covered]), np.concatenate([length[even], tail])
    order = np.argsort(run_owner, kind="stable")
    run_owner, run_begin, run_length = run_owner[order], run_begin[order], run_length[order]

    extra = degree - copied
    spans = np.zeros_like(degree)
    if c.min_interval:
        by_span = np.flatnonzero(extra)
        count, at[by_span] = bits.gamma(at[by_span])
        pairs, at[by_span] = bitvec.runs(bits.gamma, at[by_span], 2 * count)
        gap, length = pairs[::2].copy(), pairs[1::2] + c.min_interval
        first = _spread(np.zeros_like(count), count) == 0
        owner = np.repeat(by_span, count)
        before = np.concatenate([[0], length[:-1]]) if len(length) else length
        left = _sums(np.where(first, _signed(gap) + x[owner], gap + 1 + before), count)
        spans = np.bincount(owner, length, len(x)).astype(np.int64)
        out[_spread(place[by_span] + copied[by_span], spans[by_span])] = _spread(left, length)
        extra = extra - spans
    by_rest = np.flatnonzero(extra)
    gap, at[by_rest] = bitvec.runs(read("RESIDUALS"), at[by_rest], extra[by_rest])
    first = (np.cumsum(extra[by_rest]) - extra[by_rest]).astype(np.int64)
    head = gap[first]
    gap += 1
    gap[first] = _signed(head) + x[by_rest]
    out[_spread(place[by_rest] + copied[by_rest] + spans[by_rest], extra[by_rest])] = _sums(gap, extra[by_rest])
    if len(at) and int(at.max()) > bits.size:
        raise ValueError("the bit stream ends inside a vertex")

    mixed = ((copied > 0).astype(np.int8) + (spans > 0) + (extra > 0)) > 1

    def sort(rows: np.ndarray) -> None:
        """Ascending successors for vertices whose parts have to be merged."""
        rows = rows[mixed[rows]]
        if len(rows):
            where = _spread(place[rows], degree[rows])
            high = np.repeat(np.arange(len(rows)) * c.vertices, degree[rows])
            out[where] = np.sort(out[where] + high) - high

    known = reference == 0
    sort(np.flatnonzero(known))
    run_at = np.searchsorted(run_owner, np.arange(len(by) + 1))
    waiting = np.arange(len(by))
    while len(waiting):  # one step for each link of the longest chain of references
        ready = waiting[known[source[waiting]]]
        r = _spread(run_at[ready], run_at[ready + 1] - run_at[ready])
        out[_spread(place[by[ready]], copied[by[ready]])] = out[_spread(place[source[run_owner[r]]] + run_begin[r], run_length[r])]
        waiting = waiting[~known[source[waiting]]]
        known[by[ready]] = True
        sort(by[ready])
    return degree, out


def _scalar_pass(base: str, codes: Codes, size: int = 1 << 18, rows: int = 1 << 16):
    """(bit position, outdegree) arrays of all vertices by one sequential pass; for graphs without .offsets."""
    with open(f"{base}.graph", "rb") as f:
        s, at, gone, ended = "", 0, 0, False
        recent, where, degrees = {}, [], []
        for x in range(codes.vertices):
            while True:
                try:
                    if not ended and len(s) - at < 4096:
                        raise IndexError
                    got, to = decode_vertex(s, at, x, codes, recent.__getitem__)
                    if to > len(s):
                        raise IndexError
                    break
                except (LookupError, ValueError):  # the code may go on behind what was read
                    more = b"" if ended else f.read(size)
                    if ended:
                        raise ValueError(f"{base}.graph ends inside vertex {x}") from None
                    ended = len(more) < size
                    s, gone, at = s[at:] + bitio.bits_of(more), gone + at, 0
            where.append(gone + at)
            degrees.append(len(got))
            recent[x], at = got, to
            recent.pop(x - codes.window, None)
            if len(where) == rows:
                yield np.array(where), np.array(degrees)
                where, degrees = [], []
        yield np.array([*where, gone + at]), np.array(degrees, np.int64)


def _indexed_pass(base: str, codes: Codes):
    """The same from .offsets: outdegrees are the first codes at the known positions."""
    graph = np.memmap(f"{base}.graph", np.uint8, "r") if os.path.getsize(f"{base}.graph") else np.zeros(1, np.uint8)
    total, left = 0, codes.vertices
    for gaps in bitvec.values_of_file(f"{base}.offsets", codes.vertices + 1, codes.kinds["OFFSETS"], codes.k):
        where = total + np.cumsum(gaps)
        total, n = int(where[-1]), min(left, len(where))
        left -= n
        heads = graph[np.minimum((where[:n] >> 3)[:, None] + np.arange(16), len(graph) - 1)]
        at = 128 * np.arange(n) + (where[:n] & 7)
        yield where, bitvec.Bits(heads.tobytes()).reader(codes.kinds["OUTDEGREES"], codes.k)(at)[0]


def write_offsets_file(path: str, positions: np.ndarray, rows: int = 1 << 16) -> None:
    rest, last = "", 0
    with open(path, "wb") as f:
        for i in range(0, len(positions), rows):
            part = np.asarray(positions[i : i + rows]).astype(np.int64)
            rest += "".join(map(bitio.write_gamma, np.diff(part, prepend=last).tolist()))
            last, cut = int(part[-1]), len(rest) // 8 * 8
            f.write(bitio.bytes_of(rest[:cut]))
            rest = rest[cut:]
        f.write(bitio.bytes_of(rest))


def _spots(base: str, side: str | None) -> list[str]:
    return [base, *([os.path.join(side, os.path.basename(base))] if side else [])]


def _writable(base: str, side: str | None) -> str:
    """Where index files go: beside the graph, or a side folder that every machine can open."""
    if side is None:
        if not os.access(os.path.dirname(os.path.abspath(base)), os.W_OK):
            raise PermissionError(f"the folder of {base} cannot be written: name a shared folder for its indexes with the option sideDir")
        return base
    os.makedirs(side, exist_ok=True)
    return os.path.join(side, os.path.basename(base))


def index_files(base: str, side: str | None = None) -> dict[str, str]:
    """Paths of the offset indexes of a graph, building those that do not exist.

    ``bits``: u64 bit position of each vertex, V + 1 entries; ``csx``: u64 prefix sums of the
    outdegrees, V + 1 entries. Both are memory-mapped by the readers, and made in one pass in
    bounded memory. A finished index appears under its name at once.
    """
    codes = Codes(read_properties(base))
    size = 8 * (codes.vertices + 1)
    good = lambda p: os.path.exists(p) and os.path.getsize(p) == size
    csx = next((p for b in _spots(base, side) if good(p := f"{b}_offsets.bin")), None)
    bits = next((p for b in _spots(base, side) if good(p := f"{b}_bitoffsets.bin")), None)
    if csx and bits:
        return {"csx": csx, "bits": bits}
    out = _writable(base, side)
    listed = os.path.exists(f"{base}.offsets")
    quick = listed and codes.kinds["OUTDEGREES"] != "UNARY"
    made = {name: f"{out}_{name}.bin" for name in ("offsets", "bitoffsets")}
    new = {name: f"{path}.{uuid.uuid4().hex}" for name, path in made.items()}
    total = 0
    with open(new["offsets"], "wb") as f, open(new["bitoffsets"], "wb") as g:
        f.write(bytes(8))
        for where, degrees in (_indexed_pass if quick else _scalar_pass)(base, codes):
            sums = total + np.cumsum(degrees)
            total = int(sums[-1]) if len(sums) else total
            sums.astype("<u8").tofile(f)
            where.astype("<u8").tofile(g)
    if total != codes.edges:
        for path in new.values():
            os.remove(path)
        raise ValueError(f"{base}: the stream has {total} edges, its properties say {codes.edges}")
    if not listed:
        write_offsets_file(f"{out}.offsets", np.memmap(new["bitoffsets"], "<u8", "r"))
    for name, path in made.items():
        os.replace(new[name], path)
    return {"csx": csx or made["offsets"], "bits": bits or made["bitoffsets"]}


def label_index(base: str, vertices: int, side: str | None = None) -> str:
    """Path of the u64 bit positions of each vertex's labels, building it if it does not exist."""
    size = 8 * (vertices + 1)
    found = next((p for b in _spots(base, side) if os.path.exists(p := f"{b}_labelbits.bin") and os.path.getsize(p) == size), None)
    if found:
        return found
    path = f"{_writable(base, side)}_labelbits.bin"
    new, total = f"{path}.{uuid.uuid4().hex}", 0
    with open(new, "wb") as f:
        for gaps in bitvec.values_of_file(f"{base}.labeloffsets", vertices + 1, "GAMMA"):
            where = total + np.cumsum(gaps)
            total = int(where[-1])
            where.astype("<u8").tofile(f)
    os.replace(new, path)
    return path


def _bytes_between(file, where: np.ndarray, first: int, last: int) -> tuple[bytes, int]:
    """The bytes that hold the codes of vertices [first, last), and the bit position of the first byte."""
    a, b = int(where[first]) // 8, -(-int(where[last]) // 8)
    file.seek(a)
    return file.read(b - a), a * 8


class Reader:
    """Random access to the successors of vertex ranges, one contiguous read for a range.

    A range's memory is a few arrays of its edges; a vertex is always decoded whole.
    """

    def __init__(self, base: str, index: dict[str, str]):
        self.codes = Codes(read_properties(base))
        self.where = np.memmap(index["bits"], np.uint64, "r")
        self.file = open(f"{base}.graph", "rb")  # noqa: SIM115

    def _before(self, x: np.ndarray, bits: bitvec.Bits, at: np.ndarray, first: int) -> np.ndarray:
        """Vertices before ``first`` that the vertices x refer to."""
        degree, at = bits.reader(self.codes.kinds["OUTDEGREES"], self.codes.k)(at)
        some = degree > 0
        reference, _ = bits.reader(self.codes.kinds["REFERENCES"], self.codes.k)(at[some])
        to = np.unique(x[some] - reference)
        return to[to < first]

    def _pieces(self, vertices: list[int]) -> tuple[bytes, np.ndarray]:
        """The codes of single vertices behind each other, and where each starts."""
        raw, at = b"", []
        for v in vertices:
            got, start = _bytes_between(self.file, self.where, v, v + 1)
            at.append(8 * len(raw) + int(self.where[v]) - start)
            raw += got
        return raw, np.array(at, np.int64)

    def successors(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Outdegrees of vertices [first, last) and their successors behind each other."""
        raw, start = _bytes_between(self.file, self.where, first, last)
        x, at = np.arange(first, last), self.where[first:last].astype(np.int64) - start
        early: set[int] = set()
        if self.codes.window:
            fresh = self._before(x, bitvec.Bits(raw), at, first)
            while len(fresh):  # what they refer to in turn
                early.update(fresh.tolist())
                piece, piece_at = self._pieces(fresh.tolist())
                fresh = self._before(fresh, bitvec.Bits(piece), piece_at, first)
                fresh = fresh[[v not in early for v in fresh.tolist()]]
        if early:
            piece, piece_at = self._pieces(sorted(early))
            raw, x, at = piece + raw, np.concatenate([sorted(early), x]), np.concatenate([piece_at, at + 8 * len(piece)])
        degree, out = decode_vertices(bitvec.Bits(raw), at, x, self.codes)
        skip = len(early)
        return degree[skip:], out[int(degree[:skip].sum()) :]


class LabelReader:
    """Integer labels of a vertex range: gamma-coded or of fixed width."""

    def __init__(self, base: str, index: str):
        spec = read_properties(base).get("labelspec", "GammaCodedIntLabel(w)")
        self.width = int(spec.rpartition(",")[2].strip(" )")) if "FixedWidth" in spec else None
        self.where = np.memmap(index, np.uint64, "r")
        self.file = open(f"{base}.labels", "rb")  # noqa: SIM115

    def labels(self, first: int, last: int, degree: np.ndarray) -> np.ndarray:
        raw, start = _bytes_between(self.file, self.where, first, last)
        bits, at = bitvec.Bits(raw), self.where[first:last].astype(np.int64) - start
        if self.width is None:
            out = bitvec.runs(bits.gamma, at, degree)[0]
        else:
            out = bits.fixed(self.width)(np.repeat(at, degree) + self.width * _spread(np.zeros_like(degree), degree))[0]
        return out & 0xFFFFFFFF


def encode_vertex(x: int, successors: list[int], window: dict[int, list[int]], depth: dict[int, int], size: int, max_references: int, min_interval: int, k: int) -> tuple[str, int]:
    """Shortest code of a vertex over all references in the window, and the reference."""
    head = bitio.write_gamma(len(successors))
    if not successors:
        return head, 0
    best: tuple[str, int] | None = None
    for r in range(min(size, x) + 1):
        source = window.get(x - r) if r else None
        if r and (not source or depth.get(x - r, 0) >= max_references):
            continue
        bits, rest = (bitio.write_unary(r) if size else ""), successors
        if r:
            have, blocks, copying, run = set(successors), [], True, 0
            for v in source:
                if (v in have) == copying:
                    run += 1
                else:
                    blocks.append(run)
                    copying, run = not copying, 1
            # the last run is implied: a copy behind an even number of blocks, a skip behind an odd one
            bits += bitio.write_gamma(len(blocks)) + "".join(bitio.write_gamma(n - (i > 0)) for i, n in enumerate(blocks))
            copied = set(source) & have
            rest = [v for v in successors if v not in copied]
        if rest and min_interval:
            spans, single, i = [], [], 0
            while i < len(rest):
                e = i + 1
                while e < len(rest) and rest[e] == rest[e - 1] + 1:
                    e += 1
                if e - i >= min_interval:
                    spans.append((rest[i], e - i))
                else:
                    single += rest[i:e]
                i = e
            bits += bitio.write_gamma(len(spans))
            last = None
            for left, n in spans:
                bits += bitio.write_gamma(bitio.to_nat(left - x) if last is None else left - last - 1) + bitio.write_gamma(n - min_interval)
                last = left + n
            rest = single
        if rest:
            bits += bitio.write_zeta(bitio.to_nat(rest[0] - x), k) + "".join(bitio.write_zeta(b - a - 1, k) for a, b in zip(rest, rest[1:], strict=False))
        if best is None or len(bits) < len(best[0]):
            best = bits, r
    return head + best[0], best[1]


def _candidate(first: int, degree: np.ndarray, owner: np.ndarray, flat: np.ndarray, key: np.ndarray, most: int, r: int, size: int, min_interval: int, k: int):
    """(vertex, number, bits) of the codes behind the outdegree of every vertex, if it refers to the vertex r before it.

    A vertex that shares nothing with that one has no code, as it is always longer than that without a reference.
    """
    fit, rest = degree > 0, np.ones(len(flat), bool)
    parts = []  # in the order of the format; each is ascending in the vertices
    if r:
        fit = np.zeros(len(degree), bool)
        source = np.flatnonzero(owner < len(degree) - r)
        want = key[source] + r * most
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        hit = key[at] == want
        fit[owner[at[hit]]] = True
        rest[at[hit]] = False
        kept = fit[owner[source] + r]
        to, hit = owner[source][kept] + r, hit[kept]
        begins = np.flatnonzero(np.diff(to, prepend=-1) | np.diff(hit, prepend=False))
        length, by, copies = np.diff(begins, append=len(to)), to[begins], hit[begins]
        start, last = np.diff(by, prepend=-1) != 0, np.diff(by, append=-1) != 0
        skips = by[start & ~copies]  # a skip at the beginning stands behind an empty copy
        every = np.concatenate([skips, by[~last]])
        order = np.argsort(every, kind="stable")
        runs = np.concatenate([np.zeros_like(skips), (length - ~(start & copies))[~last]])[order]
        x = np.flatnonzero(fit)
        parts.append((x, *bitvec.gamma_codes(np.bincount(every, minlength=len(degree))[x])))
        parts.append((every[order], *bitvec.gamma_codes(runs)))
    x = np.flatnonzero(fit)
    if size:
        parts.insert(0, (x, np.ones_like(x), np.full_like(x, r + 1)))
    left = np.flatnonzero(rest & fit[owner])
    by, v = owner[left], flat[left]
    nat = lambda n: np.where(n >= 0, 2 * n, -2 * n - 1)
    if min_interval and len(left):
        begins = np.flatnonzero((np.diff(by, prepend=-1) != 0) | (np.diff(v, prepend=-2) != 1))
        length = np.diff(begins, append=len(v))
        span = length >= min_interval
        x, low, n = by[begins[span]], v[begins[span]], length[span]
        new = np.diff(x, prepend=-1) != 0
        gap = np.where(new, nat(low - first - x), low - np.concatenate([[0], (low + n)[:-1]])[: len(low)] - 1)
        some = by[np.diff(by, prepend=-1) != 0]
        parts.append((some, *bitvec.gamma_codes(np.bincount(x, minlength=len(degree))[some])))
        parts.append((np.repeat(x, 2), *bitvec.gamma_codes(np.stack([gap, n - min_interval], 1).reshape(-1))))
        single = ~np.repeat(span, length)
        by, v = by[single], v[single]
    new = np.diff(by, prepend=-1) != 0
    parts.append((by, *bitvec.zeta_codes(np.where(new, nat(v - first - by), np.diff(v, prepend=0) - 1), k)))
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(3))


def encode_vertices(first: int, degree: np.ndarray, flat: np.ndarray, window: int = 7, max_references: int = 3, min_interval: int = 4, k: int = 3) -> tuple[bytes, np.ndarray]:
    """The codes of the vertices from ``first`` on, side by side, and the bits of each; the same as those of ``encode_vertex``.

    No vertex refers to one before ``first``.
    """
    owner = np.repeat(np.arange(len(degree)), degree)
    if np.any((np.diff(flat) <= 0) & (np.diff(owner) == 0)):
        raise ValueError("the successors of a vertex must ascend, none twice")
    most = int(flat.max()) + 1 if len(flat) else 1
    key = owner * most + flat
    choice, codes, bits = np.zeros(len(degree), np.int64), [], []
    for r in range(min(window, len(degree) - 1) + 1 if len(flat) else 0):
        got = _candidate(first, degree, owner, flat, key, most, r, window, min_interval, k)
        codes.append(got)
        bits.append(np.bincount(got[0], got[2], len(degree)).astype(np.int64))
    depth: dict[int, int] = {}
    gains = np.zeros(len(degree), bool)
    for b in bits[1:]:
        gains |= (b > 0) & (b < bits[0])
    for x in np.flatnonzero(gains).tolist():
        best, pick = int(bits[0][x]), 0
        for r in range(1, len(bits)):
            if 0 < (n := int(bits[r][x])) < best and depth.get(x - r, 0) < max_references:
                best, pick = n, r
        if pick:
            choice[x], depth[x] = pick, depth.get(x - pick, 0) + 1
    parts = [(np.arange(len(degree)), *bitvec.gamma_codes(degree))]
    for r, got in enumerate(codes):
        taken = choice[got[0]] == r
        parts.append(tuple(c[taken] for c in got))
    by, value, width = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.argsort(by, kind="stable")
    return bitvec.pack(value[order], width[order])[0], np.bincount(by, width, len(degree)).astype(np.int64)


def write_properties(base: str, vertices: int, arcs: int, window: int, max_references: int, min_interval: int, k: int) -> None:
    with open(f"{base}.properties", "w") as f:
        f.write(f"#BVGraph properties\nversion=0\nnodes={vertices}\narcs={arcs}\nwindowsize={window}\nmaxrefcount={max_references}\nminintervallength={min_interval}\nzetak={k}\ncompressionflags=\n")


def write_label_properties(base: str, graph: str, width: int | None) -> None:
    spec = "GammaCodedIntLabel(w)" if width is None else f"FixedWidthIntLabel(w,{width})"
    with open(f"{base}.properties", "w") as f:
        f.write(f"underlyinggraph={os.path.relpath(graph, os.path.dirname(base) or '.')}\nlabelspec={spec}\n")


def encode(base: str, vertices: int, adjacency, window: int = 7, max_references: int = 3, min_interval: int = 4, k: int = 3) -> None:
    """Writes .graph, .offsets and .properties; ``adjacency`` yields the ascending successors of 0, 1, ..."""
    recent: dict[int, list[int]] = {}
    depth: dict[int, int] = {}
    where, arcs, parts, at = np.zeros(vertices + 1, np.uint64), 0, [], 0
    with open(f"{base}.graph", "wb") as f:
        for x, successors in enumerate(adjacency):
            bits, r = encode_vertex(x, successors, recent, depth, window, max_references, min_interval, k)
            recent[x], depth[x] = successors, depth[x - r] + 1 if r else 0
            recent.pop(x - window, None)
            arcs += len(successors)
            at += len(bits)
            where[x + 1] = at
            parts.append(bits)
            if len(parts) >= 4096:
                whole = "".join(parts)
                cut = len(whole) // 8 * 8
                f.write(bitio.bytes_of(whole[:cut]))
                parts = [whole[cut:]]
        f.write(bitio.bytes_of("".join(parts)))
    write_offsets_file(f"{base}.offsets", where)
    write_properties(base, vertices, arcs, window, max_references, min_interval, k)


def encode_labels(base: str, graph: str, labels, width: int | None = None) -> None:
    """Writes .labels, .labeloffsets and .properties of a labelled graph over ``graph``; ``labels`` yields those of 0, 1, ..."""
    where, rest = array("q", [0]), ""
    with open(f"{base}.labels", "wb") as f:
        for row in labels:
            bits = "".join(map(bitio.write_gamma, row)) if width is None else "".join(format(n, f"0{width}b") for n in row)
            where.append(where[-1] + len(bits))
            rest += bits
            if len(rest) >= 1 << 20:
                cut = len(rest) // 8 * 8
                f.write(bitio.bytes_of(rest[:cut]))
                rest = rest[cut:]
        f.write(bitio.bytes_of(rest))
    write_offsets_file(f"{base}.labeloffsets", np.array(where))
    write_label_properties(base, graph, width)
