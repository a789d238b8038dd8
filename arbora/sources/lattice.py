"""Byte lattices (label volumes on a uniform grid) as tables of runs: a splittable source and a writer.

    spark.dataSource.register(lattice.LatticeSource)
    spark.read.format("byte_lattice").option("path", p).load()        # z, y, x0, x1, value

A row is a longest run of one value other than 0 along x, half open. The payload is either plain bytes or packets: a control byte n above 127 is followed by
n - 128 bytes as they are, any other by one byte that repeats n times; x varies fastest, then y, then z. Partitions are ranges of slices. For packets
an index says at which byte each slice begins and how many decoded bytes before it belong to the slice before; it is made by one pass over the
control bytes when partitions are asked for. With byte_lattice_pushed, conditions on z that Spark hands down leave out slices, and so whole partitions.

write() deals slices to tasks, each of which encodes its slices one by one and leaves one part: a folder with `header` and `part-00000`, `part-00001`, ... that,
one after another, are a file of the format; the source reads such folders and single files alike. A task that is run again writes the same part again.

write_pieces() leaves out what is empty: a piece is a whole file of the format that has only those columns, rows and slices in which its runs lie, with their places as Kept
among its Parameters (stretches as begin+length; an empty column follows each, so that runs of two stretches never touch). A range of slices is cut into pieces of at most
SPARSE voxels a run (of more only if one row's unbroken runs have more), which lie one after another in one file. So what is written follows the runs, however far apart they
lie in the lattice. read_pieces() reads such folders.

Paths are those of a file system that driver and executors share: plain, file: or any that pyarrow.fs knows. Options: path, field (the first, if none is given),
slices (of a partition, 64). Headers that say other things than a uniform grid of single bytes are refused; so are payloads that end too early, runs
outside the lattice, overlapping runs of different values, and values outside 1 to 255. Null runs are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "z long, y long, x0 long, x1 long, value int"
MOST = 127
SPARSE = 1000  # voxels of a piece to each of its runs, at most
# fixed words of the format
MAGIC, DATA_LINE, PACKED = "# Avizo BINARY-LITTLE-ENDIAN 3.0", "# Data section follows", "HxByteRLE"


class Header(NamedTuple):
    nx: int
    ny: int
    nz: int
    box: tuple[float, ...]
    field: str
    encoding: str | None
    n_bytes: int
    materials: tuple[str, ...]
    offset: int
    kept: tuple[tuple[tuple[int, int], ...], ...] = ()


def _open(path: str):
    """(file system, path in it)."""
    return (pa.fs.LocalFileSystem(), path) if re.match(r"[^:]*$|/", path) else pa.fs.FileSystem.from_uri(path)


def _parts(path: str) -> list[str]:
    """The file, or the header and the parts of a folder, in order."""
    fs, at = _open(path)
    if fs.get_file_info(at).type != pa.fs.FileType.Directory:
        return [at]
    names = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(at)) if re.search(r"/(header|part-\d+)$", f.path))
    return names


def parse_header(raw: bytes, field: str | None = None) -> Header:
    """What a header says of a field, and where the payload of the first data block begins."""
    found = re.search(rb"(?m)^@\d+\r?\n", raw)
    if found is None:
        raise ValueError("no data marker")
    text = raw[: found.start()].decode("latin-1")
    size, box = re.search(r"(?m)^\s*define\s+Lattice\s+(\d+)\s+(\d+)\s+(\d+)", text), re.search(r"BoundingBox\s+([-+\d.eE\s]+)", text)
    kind = re.search(r'CoordType\s+"(\w+)"', text)
    fields = re.findall(r"(?m)^\s*Lattice\s*\{\s*(\w+)(?:\[(\d+)\])?\s+(\w+)\s*\}\s*@(\d+)(?:\((\w+),(\d+)\))?", text)
    if size is None or box is None or len(box[1].split()) != 6 or (kind and kind[1] != "uniform") or not fields:
        raise ValueError("not the header of a uniform lattice: it needs sizes, a box of six numbers and a field")
    chosen = [f for f in fields if field in (None, f[2])]
    if not chosen or chosen[0][0] != "byte" or chosen[0][1] not in ("", "1") or chosen[0][4] not in ("", PACKED) or chosen[0] != min(fields, key=lambda f: int(f[3])):
        raise ValueError(f"field {field or fields[0][2]} is not one byte a voxel in the first data block")
    nx, ny, nz = map(int, size.groups())
    _, _, name, _, encoding, n = chosen[0]
    return Header(nx, ny, nz, tuple(map(float, box[1].split())), name, encoding or None, int(n) if n else nx * ny * nz, _materials(text), found.end(), _kept(text))


def _kept(text: str) -> tuple[tuple[tuple[int, int], ...], ...]:
    """(begin, length) of the stretches of columns, rows and slices that a piece has; none if it isn't one."""
    found = re.search(r'(?m)^\s*Kept "([\d+ ]+),([\d+ ]+),([\d+ ]+)",?\s*$', text)
    return tuple(tuple(tuple(map(int, stretch.split("+"))) for stretch in axis.split()) for axis in found.groups()) if found else ()


def _materials(text: str) -> tuple[str, ...]:
    """Names of the materials, by value: those that open a block directly inside Materials."""
    begun = re.search(r"\bMaterials\s*\{", text)
    names, depth = [], 1
    for token in re.finditer(r'([\w.-]+)?\s*([{}])', text[begun.end() :] if begun else ""):
        if token[2] == "{":
            if depth == 1 and token[1]:
                names.append(token[1])
            depth += 1
        else:
            depth -= 1
        if not depth:
            break
    return tuple(names)


def read_header(path: str, field: str | None = None) -> Header:
    fs, _ = _open(path)
    with fs.open_input_file(_parts(path)[0]) as f:
        return parse_header(f.read(4 << 20), field)


class _Payload:
    """The payload of a file or of a folder's parts, by position."""

    def __init__(self, path: str, head: Header):
        self.fs, _ = _open(path)
        names = _parts(path)
        sizes = [self.fs.get_file_info(n).size for n in names]
        self.pieces, at = [], 0
        for i, (name, size) in enumerate(zip(names, sizes)):
            skip = head.offset if i == 0 else 0
            self.pieces.append((at, at + size - skip, name, skip))
            at += size - skip
        self.size = min(at, head.n_bytes)

    def read(self, a: int, b: int) -> bytes:
        out = []
        for begin, end, name, skip in self.pieces:
            lo, hi = max(a, begin), min(b, end, self.size)
            if lo < hi:
                with self.fs.open_input_file(name) as f:
                    out.append(f.read_at(hi - lo, skip + lo - begin))
        return b"".join(out)


def slice_index(payload: _Payload, slice_bytes: int, n: int, chunk: int = 8 << 20) -> list[tuple[int, int]]:
    """(byte of the packet, decoded bytes of it to leave out) at which each of n slices begins, and the end."""
    found, at, out, base, raw = [(0, 0)], 0, 0, 0, b""
    while len(found) <= n and at < payload.size:
        if at - base + 1 > len(raw):
            base, raw = at, payload.read(at, at + chunk)
        c = raw[at - base]
        run, step = (c - 128, c - 127) if c > MOST else (c, 2)
        while run and len(found) <= n and out + run >= len(found) * slice_bytes:
            over = len(found) * slice_bytes - out
            found.append((at + step, 0) if over == run else (at, over))
        out, at = out + run, at + step
    if len(found) <= n:
        raise ValueError(f"the payload ends after {out} of {n * slice_bytes} bytes")
    return found


def decode(raw: bytes, skip: int, want: int) -> np.ndarray:
    """want bytes of the packets, without the first skip."""
    out, at, size = [], 0, 0
    while size < skip + want:
        c = raw[at]
        if c > MOST:
            out.append(raw[at + 1 : at + c - 127])
            at, size = at + c - 127, size + c - 128
        else:
            out.append(raw[at + 1 : at + 2] * c)
            at, size = at + 2, size + c
    return np.frombuffer(b"".join(out), np.uint8)[skip : skip + want]


def encode(lengths: list[tuple[int, int]]) -> bytes:
    """Packets of (value, length) stretches: three or more of a value repeat, what lies between is written as it is."""
    out, plain = bytearray(), bytearray()

    def settle() -> None:
        for i in range(0, len(plain), MOST):
            piece = plain[i : i + MOST]
            out.append(128 + len(piece))
            out.extend(piece)
        plain.clear()

    for value, n in lengths:
        if n < 3:
            plain.extend(bytes([value]) * n)
            continue
        settle()
        out.extend(bytes([MOST, value]) * (n // MOST))
        if n % MOST:
            out.extend(bytes([n % MOST, value]))
    settle()
    return bytes(out)


def _runs(plane: np.ndarray, z: int) -> pa.RecordBatch:
    """Longest runs of values other than 0 of one slice (ny, nx)."""
    ny, nx = plane.shape
    edge = np.ones((ny, nx + 1), bool)
    edge[:, 1:-1] = plane[:, 1:] != plane[:, :-1]
    y, x = np.nonzero(edge)
    inner = x < nx
    y, x, end = y[inner], x[inner], x[np.flatnonzero(inner) + 1]
    value = plane[y, x].astype(np.int32)
    keep = value > 0
    y, x, end, value = y[keep], x[keep], end[keep], value[keep]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(y), z, np.int64)), pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), pa.array(end.astype(np.int64)), pa.array(value)], ["z", "y", "x0", "x1", "value"])


class Slices(InputPartition):
    def __init__(self, z: list[int], starts: list[tuple[int, int]], end: int):
        self.z, self.starts, self.end = z, starts, end


class LatticeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("slices", 64))
        self.head = read_header(self.path, options.get("field"))
        self.low, self.high = 0, self.head.nz
        self.only: set[int] | None = None

    def partitions(self) -> list[Slices]:
        h = self.head
        slices = [z for z in range(self.low, self.high) if self.only is None or z in self.only]
        if not slices:
            return [Slices([], [], 0)]
        size = h.nx * h.ny
        payload = _Payload(self.path, h)
        index = slice_index(payload, size, h.nz) if h.encoding else [(z * size, 0) for z in range(h.nz + 1)]
        if not h.encoding and payload.size < size * h.nz:
            raise ValueError(f"the payload ends after {payload.size} of {size * h.nz} bytes")
        out = []
        for i in range(0, len(slices), self.step):
            own = slices[i : i + self.step]
            at, over = index[own[-1] + 1]
            out.append(Slices(own, [index[z] for z in own], at + (over > 0) * (MOST + 1)))
        return out

    def read(self, part: Slices) -> Iterator[pa.RecordBatch]:
        h = self.head
        if not part.z:
            return
        payload, size = _Payload(self.path, h), h.nx * h.ny
        ends = [*part.starts[1:], (part.end, 0)]
        for z, (at, skip), (nxt, _) in zip(part.z, part.starts, ends):
            # a slice's packets end within one packet of where the next one read begins
            raw = payload.read(at, at + size if not h.encoding else max(nxt + MOST + 1, at + 1))
            flat = decode(raw, skip, size) if h.encoding else np.frombuffer(raw, np.uint8)
            yield _runs(flat.reshape(h.ny, h.nx), z)


class PushedReader(LatticeReader):
    """Takes conditions on z out of Spark's hands."""

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if getattr(f, "attribute", None) != ("z",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = values if self.only is None else self.only & values
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class Pieces(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PiecesReader(DataSourceReader):
    """Reads the files that write_pieces() left, some a partition; headers are read in the tasks."""

    def __init__(self, options: dict):
        self.path, self.tasks = options["path"].rstrip("/"), int(options.get("tasks", 400))

    def partitions(self) -> list[Pieces]:
        fs, at = _open(self.path)
        names = sorted(f.base_name for f in fs.get_file_info(pa.fs.FileSelector(at)) if re.fullmatch(r"piece-\d+", f.base_name))
        return [Pieces([f"{self.path}/{n}" for n in names[i :: self.tasks]]) for i in range(max(1, min(self.tasks, len(names))))]

    def read(self, part: Pieces) -> Iterator[pa.RecordBatch]:
        for path in part.paths:
            fs, at = _open(path)
            with fs.open_input_stream(at) as f:
                raw = f.read()
            yield from _pieces_of(raw)


def _pieces_of(raw: bytes) -> Iterator[pa.RecordBatch]:
    """The runs of the pieces that lie one after another in a file."""
    at = 0
    while at < len(raw):
        # a header is short but for its stretches, so the part searched grows
        size = 4096
        while re.search(rb"(?m)^@\d+\r?\n", raw[at : at + size]) is None and at + size < len(raw):
            size *= 4
        head = parse_header(raw[at : at + size])
        begin = at + head.offset
        at = begin + head.n_bytes
        if at > len(raw):
            raise ValueError(f"the payload ends after {len(raw) - begin} of {head.n_bytes} bytes")
        volume = decode(raw[begin:at], 0, head.nx * head.ny * head.nz).reshape(1, head.nz * head.ny, head.nx)
        runs = _runs(volume[0], 0)
        x, y, z = (np.concatenate([np.arange(a, a + n + (axis == 0)) for a, n in stretches]) for axis, stretches in enumerate(head.kept))
        row, x0, x1 = (runs.column(c).to_numpy() for c in ("y", "x0", "x1"))
        yield pa.RecordBatch.from_arrays([pa.array(z[row // head.ny]), pa.array(y[row % head.ny]), pa.array(x[x0]), pa.array(x[x1 - 1] + 1), runs.column("value")], ["z", "y", "x0", "x1", "value"])


class LatticeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "byte_lattice"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LatticeReader:
        return LatticeReader(self.options)


class PiecesSource(LatticeSource):
    @classmethod
    def name(cls) -> str:
        return "byte_lattice_pieces"

    def reader(self, schema) -> PiecesReader:
        return PiecesReader(self.options)


class PushedLatticeSource(LatticeSource):
    """The same with conditions on z; Spark refuses it unless spark.sql.python.filterPushdown.enabled is true."""

    @classmethod
    def name(cls) -> str:
        return "byte_lattice_pushed"

    def reader(self, schema) -> LatticeReader:
        return PushedReader(self.options)


def header_text(nx: int, ny: int, nz: int, box: tuple[float, ...], n_bytes: int, field: str = "Labels", materials: tuple[str, ...] = (), kept: list[list[tuple[int, int]]] | None = None) -> str:
    named = "".join(f"        {m} {{\n            Id {i + 1}\n        }}\n" for i, m in enumerate(materials))
    listed = f"    Materials {{\n{named}    }}\n" if materials else ""
    bounds = " ".join(repr(float(v)) for v in box)
    begin = '    Kept "' + ",".join(" ".join(f"{a}+{n}" for a, n in axis) for axis in kept) + '",\n' if kept else ""
    return f'{MAGIC}\n\n\ndefine Lattice {nx} {ny} {nz}\n\nParameters {{\n{listed}{begin}    Content "{nx}x{ny}x{nz} byte, uniform coordinates",\n    BoundingBox {bounds},\n    CoordType "uniform"\n}}\n\nLattice {{ byte {field} }} @1({PACKED},{n_bytes})\n\n{DATA_LINE}\n@1\n'


def slice_bytes(rows: list[tuple[int, int, int, int]], nx: int, ny: int) -> bytes:
    """One slice's packets from its (y, x0, x1, value) runs."""
    out, at = [], 0
    for y, a, b, value in sorted(rows):
        begin, end = y * nx + a, y * nx + b
        if not (0 <= y < ny and 0 <= a < b <= nx and 1 <= value <= 255):
            raise ValueError(f"run {(y, a, b, value)} does not fit a slice of {nx} by {ny} bytes")
        if begin < at:
            if out[-1][0] != value:
                raise ValueError(f"run {(y, a, b, value)} overlaps one of another value")
            begin = at
        if end > begin:
            if begin > at:
                out.append((0, begin - at))
            if out and out[-1][0] == value and begin == at:
                out[-1] = (value, out[-1][1] + end - begin)
            else:
                out.append((value, end - begin))
            at = end
    if at < nx * ny:
        out.append((0, nx * ny - at))
    return encode(out)


def write(runs: DataFrame, path: str, size: tuple[int, int, int], box: tuple[float, ...] | None = None, field: str = "Labels", materials: tuple[str, ...] = (), slices: int = 64) -> None:
    """Write runs (z, y, x0, x1, value) as a folder of a header and parts; size is (nx, ny, nz), box the centres of the outermost voxels."""
    nx, ny, nz = size
    fs, at = _open(path)
    if fs.get_file_info(at).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    clean = runs.where(" and ".join(f"{c} is not null" for c in ("z", "y", "x0", "x1", "value"))).select(F.floor(F.col("z") / slices).alias("part"), "z", "y", "x0", "x1", "value")
    if not clean.where((F.col("z") < 0) | (F.col("z") >= nz)).isEmpty():
        raise ValueError(f"runs lie outside the {nz} slices")
    fs.create_dir(at)
    every = runs.sparkSession.range(-(-nz // slices)).select(F.col("id").alias("part"))

    def put(key: tuple, part: pa.Table, own: pa.Table) -> pa.Table:
        fs, at = _open(path)
        k, n, held = key[0].as_py(), 0, {}
        for r in own.to_pylist():
            held.setdefault(r["z"], []).append((r["y"], r["x0"], r["x1"], r["value"]))
        name = f"{at}/part-{k:05d}"
        with fs.open_output_stream(f"{name}.tmp") as f:
            for z in range(k * slices, min((k + 1) * slices, nz)):
                raw = slice_bytes(held.get(z, []), nx, ny)
                f.write(raw)
                n += len(raw)
        fs.move(f"{name}.tmp", name)
        return pa.table({"part": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64())})

    # sizes first: the header tells how long the payload is
    n = every.groupBy("part").cogroup(clean.groupBy("part")).applyInArrow(put, "part long, n long").agg(F.sum("n")).first()[0] or 0
    box = box or (0.0, nx - 1.0, 0.0, ny - 1.0, 0.0, nz - 1.0)
    with fs.open_output_stream(f"{at}/header") as f:
        f.write(header_text(nx, ny, nz, box, n, field, materials).encode("latin-1"))


def _stretches(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and lengths of what the half-open stretches a to b fill, those that touch as one."""
    order = np.argsort(a, kind="stable")
    a, top = a[order], np.maximum.accumulate(b[order])
    first = np.flatnonzero(np.append(True, a[1:] > top[:-1]))
    return a[first], top[np.append(first[1:], len(a)) - 1] - a[first]


def _cut(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of runs, sorted by (z, y, x0), that make a piece each: halved until a range's kept columns, rows and slices are at most SPARSE voxels a run.

    Runs of a row that touch stay together.
    """
    row = np.append(True, (z[1:] != z[:-1]) | (y[1:] != y[:-1]))
    lead = np.flatnonzero(row)[np.cumsum(row) - 1]
    # the farthest end so far in a row: ends are lifted by a row's number, so that one running maximum does
    far = int(x1.max()) + 1
    reach = np.maximum.accumulate(x1 + lead * far) - lead * far
    free = np.flatnonzero(row | np.append(True, x0[1:] > reach[:-1]))
    out, todo = [], [(0, len(z))]
    while todo:
        a, b = todo.pop()
        begin, n = _stretches(x0[a:b], x1[a:b])
        volume = (int(n.sum()) + len(n)) * len(np.unique(y[a:b])) * len(np.unique(z[a:b]))
        inner = free[np.searchsorted(free, a, "right") : np.searchsorted(free, b)]
        if volume <= SPARSE * (b - a) or not len(inner):
            out.append((a, b))
        else:
            k = min(int(np.searchsorted(inner, (a + b) // 2)), len(inner) - 1)
            todo += [(int(inner[k]), b), (a, int(inner[k]))]
    return out


def _piece(z: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, value: np.ndarray, field: str, materials: tuple[str, ...]) -> bytes:
    """A file of the format with the columns, rows and slices of these runs alone."""
    begin, wide = _stretches(x0, x1)
    start = np.cumsum(wide + 1) - (wide + 1)
    of = np.searchsorted(begin, x0, "right") - 1
    left = x0 - begin[of] + start[of]
    at, kept = [], [list(zip(begin.tolist(), wide.tolist()))]
    for v in (y, z):
        places, own = np.unique(v, return_inverse=True)
        at.append((own, len(places)))
        kept.append([(int(a), int(n)) for a, n in zip(*_stretches(places, places + 1))])
    (iy, ny), (iz, nz) = at
    nx = int(wide.sum()) + len(wide)
    # its slices lie one after another, so it is encoded as one slice of all rows
    raw = slice_bytes(list(zip((iz * ny + iy).tolist(), left.tolist(), (left + x1 - x0).tolist(), value.tolist())), nx, ny * nz)
    box = (float(x0.min()), float(x1.max() - 1), float(y.min()), float(y.max()), float(z.min()), float(z.max()))
    return header_text(nx, ny, nz, box, len(raw), field, materials, kept).encode("latin-1") + raw


def write_pieces(runs: DataFrame, path: str, size: tuple[int, int, int], field: str = "Labels", materials: tuple[str, ...] = (), slices: int = 64) -> None:
    """Write runs as a folder of files of pieces, one for every `slices` slices that hold any; voxels are 1 wide and the first lies at 0. See write()."""
    nx, ny, nz = size
    fs, at = _open(path)
    if fs.get_file_info(at).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    clean = runs.where(" and ".join(f"{c} is not null" for c in ("z", "y", "x0", "x1", "value"))).select(F.floor(F.col("z") / slices).alias("part"), "z", "y", "x0", "x1", "value")
    outside = (F.col("z") < 0) | (F.col("z") >= nz) | (F.col("y") < 0) | (F.col("y") >= ny) | (F.col("x0") < 0) | (F.col("x1") > nx) | (F.col("x0") >= F.col("x1"))
    if not clean.where(outside).isEmpty():
        raise ValueError(f"runs lie outside the lattice of {nx} by {ny} by {nz}")
    fs.create_dir(at)

    def put(key: tuple, own: pa.Table) -> pa.Table:
        fs, at = _open(path)
        columns = [own.column(c).to_numpy() for c in ("z", "y", "x0", "x1", "value")]
        order = np.lexsort(columns[2::-1])
        columns = [c[order] for c in columns]
        name, n = f"{at}/piece-{key[0].as_py():07d}", 0
        with fs.open_output_stream(f"{name}.tmp") as f:
            for a, b in _cut(*columns[:4]):
                raw = _piece(*(c[a:b] for c in columns), field, materials)
                f.write(raw)
                n += len(raw)
        fs.move(f"{name}.tmp", name)
        return pa.table({"n": pa.array([n], pa.int64())})

    clean.groupBy("part").applyInArrow(put, "n long").agg(F.sum("n")).collect()


def read_pieces(spark, path: str) -> DataFrame:
    """The runs of a folder that write_pieces() made."""
    spark.dataSource.register(PiecesSource)
    return spark.read.format(PiecesSource.name()).option("path", path).load()


def read(spark, path: str, **options: object) -> DataFrame:
    """The runs of a lattice; conditions on z reach the source where the session lets them."""
    source = PushedLatticeSource if spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "true" else LatticeSource
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()
