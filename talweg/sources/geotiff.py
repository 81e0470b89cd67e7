"""GeoTIFF elevation tiles, read by byte ranges.

A Python data source plans partitions of a few blocks (strips or tiles) from a file's header,
and a task reads the ranges of its own blocks only, so files of any size are read in bounded
memory and by as many tasks as there are groups of blocks. A box, given as an option or as
comparisons of r and c that Spark pushes down, leaves out the blocks beside it. Uncompressed
blocks are cut by rows; a compressed one is unpacked whole by one task. Blocks that a sparse
file does not store are nodata.

North-up tiles of TIFF and BigTIFF; plain, deflated, LZW or Zstandard; without a predictor
or with the horizontal or the floating-point one; the first band counts. Paths are those that
pyarrow's file systems open (local and shared folders, hdfs, s3, gs, abfs). For a store that
only Spark reads, ``whole=True`` fetches each file as one binary value, 2 GB at most.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from talweg.sources.grid import Grid, TerrainError, clean_path

# TIFF field types as numpy kinds, and sample formats: fixed values.
_TYPES = {1: "u1", 2: "S1", 3: "u2", 4: "u4", 5: "u4", 6: "i1", 8: "i2", 9: "i4", 11: "f4", 12: "f8", 16: "u8"}
_SAMPLES = {1: "u", 2: "i", 3: "f"}
GROUP_BYTES, GROUP_CELLS = 8 << 20, 1 << 21  # of a partition
BATCH_CELLS = 1 << 18  # of what a task hands on at a time
HEAD = 1 << 16  # bytes of a file that are read at once for its header
PLANNERS = 32  # headers read at a time

Fetch = Callable[[int, int], bytes]


def tags(fetch: Fetch | bytes) -> tuple[str, dict[int, tuple | str]]:
    """Byte order, and the tags of the first image, of a TIFF or a BigTIFF."""
    if isinstance(fetch, bytes):
        fetch = lambda at, n, raw=fetch: raw[at : at + n]
    front = fetch(0, HEAD)
    get = lambda at, n: front[at : at + n] if at + n <= len(front) else fetch(at, n)
    order = {b"II": "<", b"MM": ">"}.get(front[:2])
    magic = struct.unpack_from(order + "H", front, 2)[0] if order and len(front) >= 16 else 0
    if magic not in (42, 43):
        raise TerrainError("not a TIFF file")
    big = magic == 43
    place, counted, head = ("Q", 8, "HHQ") if big else ("I", 2, "HHI")
    room, entry = (8, 20) if big else (4, 12)
    at = struct.unpack_from(order + place, front, 8 if big else 4)[0]
    n = struct.unpack(order + ("Q" if big else "H"), get(at, counted))[0]
    listed = get(at + counted, entry * n)
    out: dict[int, tuple | str] = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + head, listed, entry * k)
        if kind not in _TYPES:
            continue
        count *= 2 if kind == 5 else 1
        size = np.dtype(_TYPES[kind]).itemsize * count
        body = listed[entry * (k + 1) - room : entry * (k + 1)]
        if size > room:
            body = get(struct.unpack(order + place, body)[0], size)
        out[tag] = body[:size].split(b"\0")[0].decode("latin-1") if kind == 2 else tuple(np.frombuffer(body, order + _TYPES[kind], count).tolist())
    return order, out


def system(t: dict[int, tuple | str]) -> str:
    """``EPSG:n`` of the geo keys, or an empty string."""
    keys = t.get(34735, ())
    held = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    code = held.get(3072) or held.get(2048) or 0
    return f"EPSG:{code}" if 0 < code < 32767 else ""


def header(raw: Fetch | bytes) -> Grid:
    """The tile's grid."""
    return _grid(tags(raw)[1])


def _grid(t: dict[int, tuple | str]) -> Grid:
    width, height = t[256][0], t[257][0]
    if 34264 in t:
        m = t[34264]
        x0, dx, rx, y0, ry, dy = m[3], m[0], m[1], m[7], m[4], m[5]
    elif 33550 in t and 33922 in t:
        (sx, sy), p = t[33550][:2], t[33922]
        x0, dx, rx, y0, ry, dy = p[3] - p[0] * sx, sx, 0.0, p[4] + p[1] * sy, 0.0, -sy
    else:
        raise TerrainError("the tile has no georeference")
    try:
        nodata = float(t[42113]) if 42113 in t else None
    except ValueError:
        nodata = None
    return Grid(height, width, x0, dx, rx, y0, ry, dy, nodata, system(t))


# LZW codes since the table was cleared: the width of each and its first bit. TIFF widens one code early.
_LZW_MOST = 1 << 13
_LZW_WIDTH = np.select([np.arange(_LZW_MOST) < k for k in (254, 766, 1790)], [9, 10, 11], 12)
_LZW_AT = np.append(0, np.cumsum(_LZW_WIDTH))


def _lzw_codes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All codes but clears and the end, and the place of each one's first code since the table was cleared."""
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    bit, ends = 0, 8 * len(data)
    codes, starts, n = [], [], 0
    while bit + 9 <= ends:
        k = int(np.searchsorted(_LZW_AT, ends - bit, "right")) - 1  # codes that fit, if the table is not cleared again
        at, width = bit + _LZW_AT[:k], _LZW_WIDTH[:k]
        byte = at >> 3
        got = (raw[byte] << 24 | raw[byte + 1] << 16 | raw[byte + 2] << 8 | raw[byte + 3]) >> (32 - (at & 7) - width).astype(np.uint32) & ((1 << width) - 1).astype(np.uint32)
        stop = np.flatnonzero((got == 256) | (got == 257))
        m = int(stop[0]) if len(stop) else k
        if m:
            codes.append(got[:m].astype(np.int64))
            starts.append(np.full(m, n))
            n += m
        if not len(stop) or got[m] == 257:
            break
        bit += int(_LZW_AT[m + 1])
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(starts)


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's variable-width codes, on whole arrays.

    A code of the table stands for the text of the code that made its entry and one byte
    more, and both stand side by side in what was unpacked before. So each code gives its
    length, each byte of it the place it is copied from, and places are followed to literal
    bytes by halving.
    """
    code, start = _lzw_codes(data)
    if not len(code):
        return b""
    maker = np.where(code < 256, -1, start + code - 258)  # the code whose text, with the next byte, the entry is
    if (maker >= np.arange(len(code))).any():
        raise TerrainError("broken LZW data")
    size, up = (code >= 256).astype(np.int64), np.where(maker < 0, np.arange(len(code)), maker)
    while (more := np.where(up == np.arange(len(up)), 0, size[up])).any():  # how many makers stand behind each code
        size, up = size + more, up[up]
    size += 1
    first = np.cumsum(size) - size
    own = np.repeat(np.arange(len(code)), size)
    place = np.arange(len(own))
    source = np.where(maker[own] < 0, place, first[np.maximum(maker[own], 0)] + place - first[own])
    while ((after := source[source]) != source).any():
        source = after
    return code[own[source]].astype(np.uint8).tobytes()


def unpack(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return unpack_lzw(data)
    if compression == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise TerrainError(f"TIFF compression {compression} is not supported")


@dataclass(frozen=True)
class Layout:
    """How the blocks of a file's first band are stored."""

    kind: str
    compression: int
    predictor: int
    mixed: int  # samples of a pixel that lie together
    width: int  # of a block

    def values(self, data: bytes, rows: int) -> np.ndarray:
        kind, raw = np.dtype(self.kind), unpack(data, self.compression)
        if self.predictor == 3:  # differences of bytes, which lie by significance within a row
            planes = np.frombuffer(raw, np.uint8, rows * self.width * self.mixed * kind.itemsize).reshape(rows, -1, self.mixed)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, -1)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, self.width, self.mixed)[:, :, 0]
        block = np.frombuffer(raw, kind, rows * self.width * self.mixed).reshape(rows, self.width, self.mixed)
        return (np.cumsum(block, axis=1, dtype=kind.newbyteorder("=")) if self.predictor == 2 else block)[:, :, 0]


@dataclass(frozen=True)
class Image:
    """A file's grid, and where the blocks of its first band lie."""

    grid: Grid
    layout: Layout
    height: int  # of a block
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]

    @classmethod
    def of(cls, fetch: Fetch | bytes) -> "Image":
        order, t = tags(fetch)
        one = lambda tag, default: t.get(tag, (default,))[0]
        width, height = t[256][0], t[257][0]
        if one(317, 1) not in (1, 2, 3):
            raise TerrainError(f"TIFF predictor {one(317, 1)} is not supported")
        tiled = 322 in t
        bw, bh = (t[322][0], t[323][0]) if tiled else (width, min(one(278, height), height))
        layout = Layout(f"{order}{_SAMPLES[one(339, 1)]}{t[258][0] // 8}", one(259, 1), one(317, 1), one(277, 1) if one(284, 1) == 1 else 1, bw)
        offsets, sizes = (t[324], t[325]) if tiled else (t[273], t[279])
        across = -(-width // bw) * -(-height // bh)  # blocks of the first band
        return cls(_grid(t), layout, bh, tiled, tuple(offsets[:across]), tuple(sizes[:across]))

    def blocks(self, window: tuple[int, int, int, int] | None = None) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(first row, first column, rows inside the grid, rows stored, offset, bytes) of the blocks that meet the window (rows and columns, ends left out)."""
        r0, r1, c0, c1 = window or (0, self.grid.rows, 0, self.grid.cols)
        bw, bh = self.layout.width, self.height
        across = -(-self.grid.cols // bw)
        plain = self.layout.compression == 1 and self.layout.predictor != 3
        row = bw * self.layout.mixed * np.dtype(self.layout.kind).itemsize
        step = max(1, min(bh, GROUP_CELLS // (4 * bw))) if plain else bh
        for j in range(r0 // bh, -(-r1 // bh)):
            for i in range(c0 // bw, -(-c1 // bw)):
                k = j * across + i
                inside = min(bh, self.grid.rows - j * bh)
                stored = bh if self.tiled else inside
                offset, size = self.offsets[k], self.sizes[k]
                if step >= stored:
                    yield j * bh, i * bw, inside, stored, offset, size
                    continue
                for a in range(0, inside, step):  # rows of a plain block lie one after the other
                    n = min(step, inside - a)
                    if j * bh + a < r1 and j * bh + a + n > r0:
                        yield j * bh + a, i * bw, n, n, offset + a * row, n * row if size else 0

    def groups(self, window: tuple[int, int, int, int] | None = None) -> Iterator[np.ndarray]:
        """blocks() in groups of a bounded size, one a row."""
        held, size, cells = [], 0, 0
        for block in self.blocks(window):
            n = block[3] * self.layout.width
            if held and (size + block[5] > GROUP_BYTES or cells + n > GROUP_CELLS):
                yield np.array(held, np.int64)
                held, size, cells = [], 0, 0
            held.append(block)
            size, cells = size + block[5], cells + n
        if held:
            yield np.array(held, np.int64)


def blocks(raw: bytes) -> Iterator[tuple[int, int, int, int, Layout, bytes]]:
    """(first row, first column, rows inside the grid, rows stored, layout, packed bytes) of each block of a whole file."""
    image = Image.of(raw)
    for r, c, inside, stored, offset, size in image.blocks():
        yield r, c, inside, stored, image.layout, raw[offset : offset + size]


def _values(layout: Layout, data: bytes, stored: int, nodata: float | None) -> np.ndarray:
    """A block's cells; those of a block that is not stored are nodata, or 0 without such a value."""
    if not data:
        return np.full((stored, layout.width), 0.0 if nodata is None else nodata)
    return layout.values(data, stored).astype(np.float64)


def _open(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store, inner


def _fetcher(path: str) -> Fetch:
    store, inner = _open(path)

    def fetch(at: int, n: int) -> bytes:
        with store.open_input_file(inner) as f:
            f.seek(at)
            return f.read(n)

    return fetch


def list_files(path: str) -> list[str]:
    """The file, or the .tif and .tiff files of the folder."""
    from pyarrow import fs

    path = clean_path(path)
    store, inner = _open(path)
    info = store.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else "file://"
    if info.type == fs.FileType.File:
        return [path]
    if info.type != fs.FileType.Directory:
        raise TerrainError(f"there is no {path}")
    return sorted(prefix + x.path for x in store.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File and x.extension.lower() in ("tif", "tiff"))


Box = tuple[float, float, float, float]


def window_of(grid: Grid, box: Box | None) -> tuple[int, int, int, int]:
    """Rows and columns (ends left out) of the cells whose centres lie in the box (xmin, ymin, xmax, ymax); all without a box."""
    if box is None:
        return 0, grid.rows, 0, grid.cols
    span = lambda a, b, at, step, n: sorted(((a - at) / step - 0.5, (b - at) / step - 0.5)) + [n]
    out = []
    for low, high, n in (span(box[1], box[3], grid.y0, grid.dy, grid.rows), span(box[0], box[2], grid.x0, grid.dx, grid.cols)):
        out += [min(n, max(0, int(np.ceil(low)))), max(0, min(n, int(np.floor(high)) + 1))]
    return out[0], max(out[0], out[1]), out[2], max(out[2], out[3])


@dataclass
class _Blocks(InputPartition):
    path: str
    cols: int
    layout: Layout
    nodata: float | None
    window: tuple[int, int, int, int]
    blocks: np.ndarray


class GeoTiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.box: Box | None = tuple(map(float, options["box"].split(","))) if options.get("box") else None
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}  # ends left out

    def _plan(self, path: str) -> list[_Blocks]:
        image = Image.of(_fetcher(path))
        w = window_of(image.grid, self.box)
        w = (max(w[0], self.low.get("r", 0)), min(w[1], self.high.get("r", w[1])), max(w[2], self.low.get("c", 0)), min(w[3], self.high.get("c", w[3])))
        if w[0] >= w[1] or w[2] >= w[3]:
            return []
        return [_Blocks(path, image.grid.cols, image.layout, image.grid.nodata, w, g) for g in image.groups(w)]

    def partitions(self):
        with ThreadPoolExecutor(PLANNERS) as pool:
            return [p for part in pool.map(self._plan, list_files(self.path)) for p in part] or [_Blocks("", 1, None, None, (0, 0, 0, 0), np.zeros((0, 6), np.int64))]

    def read(self, p: _Blocks) -> Iterator[pa.RecordBatch]:
        if not len(p.blocks):
            return
        r0, r1, c0, c1 = p.window
        store, inner = _open(p.path)
        with store.open_input_file(inner) as f:
            for r, c, inside, stored, offset, size in p.blocks.tolist():
                data = b""
                if size and offset:
                    f.seek(offset)
                    data = f.read(size)
                block = _values(p.layout, data, stored, p.nodata)[:inside, : p.cols - c]
                block = block[max(0, r0 - r) : max(0, r1 - r), max(0, c0 - c) : max(0, c1 - c)]
                yield from _cells(p.path, p.cols, max(r, r0), max(c, c0), block)


class _PushedReader(GeoTiffReader):
    def pushFilters(self, filters):
        """Comparisons of r and c with numbers; Spark still checks them."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in ("r", "c") and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high.get(name, 1 << 62), f.value + (not isinstance(f, LessThan)))
            yield f


def _cells(dem: str, cols: int, r0: int, c0: int, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, BATCH_CELLS // max(1, block.shape[1]))
    for a in range(0, len(block), step):
        part = block[a : a + step]
        r, c = np.indices(part.shape).reshape(2, -1) + [[r0 + a], [c0]]
        yield pa.RecordBatch.from_arrays([pa.array([dem]).take(pa.array(np.zeros(len(r), np.int64))), *(pa.array(x) for x in (r * cols + c, r, c, np.ascontiguousarray(part).ravel()))], ["dem_id", "cell_id", "r", "c", "z"])


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff").option("path", ...): cells of a file or a folder.

    Options: box, as xmin,ymin,xmax,ymax; pushdown, true where PUSHDOWN is set for the
    session, as Spark refuses readers that take comparisons otherwise.
    """

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "dem_id string, cell_id long, r long, c long, z double"

    def reader(self, schema) -> DataSourceReader:
        if "path" not in self.options:
            raise TerrainError("option path: a GeoTIFF file or a folder of them")
        options = dict(self.options)
        return (_PushedReader if options.get("pushdown", "").lower() == "true" else GeoTiffReader)(options)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FIELDS = "rows long, cols long, x0 double, dx double, rx double, y0 double, ry double, dy double, nodata double, crs string"


def _heads(batches, fetch: Callable) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    names = [x.split() for x in FIELDS.split(", ")]
    for b in batches:
        for k in range(b.num_rows):
            g = header(fetch(b, k))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([getattr(g, n)], kinds[t]) for n, t in names)], ["dem_id", *(n for n, _ in names)])


def read_geotiffs(spark: SparkSession, path: str, box: Box | None = None, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """grids (dem_id and the header's fields) and cells (dem_id, cell_id, r, c, z) of a tile or a folder of tiles; dem_id is the file's path.

    With a box, only cells with their centres in it, by reading only blocks that meet it.
    """
    if whole:
        return _read_whole(spark, path, box)
    spark.dataSource.register(GeoTiffSource)
    files = spark.createDataFrame([(x,) for x in list_files(path)], "dem_id string")
    reader = spark.read.format("geotiff").option("path", path).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    if box:
        reader = reader.option("box", ",".join(repr(float(v)) for v in box))
    heads = files.repartition(max(1, min(1000, files.count()))).mapInArrow(lambda it: _heads(it, lambda b, k: _fetcher(b.column(0)[k].as_py())), f"dem_id string, {FIELDS}")
    return heads, reader.load()


def _read_whole(spark: SparkSession, path: str, box: Box | None) -> tuple[DataFrame, DataFrame]:
    """Each file as one binary value: a task cuts its packed blocks out, which are dealt to all tasks."""
    files = spark.read.format("binaryFile").load(clean_path(path)).select("path", "content")
    names = ("dem_id", "cols", "nodata", "r", "c", "inside", "stored", "r0", "r1", "c0", "c1", "kind", "compression", "predictor", "mixed", "width", "data")
    types = (pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 8, pa.string(), *[pa.int32()] * 4, pa.binary())
    packed = "dem_id string, cols long, nodata double, r long, c long, inside long, stored long, r0 long, r1 long, c0 long, c1 long, kind string, compression int, predictor int, mixed int, width int, data binary"

    def cut_out(batches):
        for b in batches:
            for k in range(b.num_rows):
                raw, dem = b.column(1)[k].as_py(), b.column(0)[k].as_py()
                image = Image.of(raw)
                w, x = window_of(image.grid, box), image.layout
                for r, c, inside, stored, offset, size in image.blocks(w):
                    row = (dem, image.grid.cols, image.grid.nodata, r, c, inside, stored, *w, x.kind, x.compression, x.predictor, x.mixed, x.width, raw[offset : offset + size] if offset else b"")
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    def cells(batches):
        for b in batches:
            for dem, cols, nodata, r, c, inside, stored, r0, r1, c0, c1, *layout, data in zip(*(x.to_pylist() for x in b.columns)):
                block = _values(Layout(*layout), data, stored, nodata)[:inside, : cols - c]
                yield from _cells(dem, cols, max(r, r0), max(c, c0), block[max(0, r0 - r) : max(0, r1 - r), max(0, c0 - c) : max(0, c1 - c)])

    parts = files.mapInArrow(cut_out, packed).repartition("dem_id", "r", "c")
    heads = files.mapInArrow(lambda it: _heads(it, lambda b, k: b.column(1)[k].as_py()), f"dem_id string, {FIELDS}")
    return heads, parts.mapInArrow(cells, "dem_id string, cell_id long, r long, c long, z double")


def read_geotiff(spark: SparkSession, path: str, box: Box | None = None, whole: bool = False) -> tuple[Grid, DataFrame]:
    """Grid and cells of one tile; with a box, the cells whose centres lie in it."""
    grids, cells = read_geotiffs(spark, path, box, whole)
    head = grids.limit(2).collect()
    if len(head) != 1:
        raise TerrainError(f"{path} holds {'no' if not head else 'several'} tiles")
    r = head[0]
    return Grid(r.rows, r.cols, r.x0, r.dx, r.rx, r.y0, r.ry, r.dy, r.nodata, r.crs), cells.drop("dem_id")
