"""Images as columns: Netpbm and BMP bytes as numpy arrays, area-resized copies as NPY tiles, and difference hashes."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caresift.llm._support import documents, slices

WIDTH = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_netpbm(samples: np.ndarray) -> bytes:
    """Raw PGM of a (rows, columns) array, raw PPM of a (rows, columns, 3) one; 8 bits a sample."""
    kind = b"P5" if samples.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, samples.shape[1], samples.shape[0]) + samples.astype(np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey or 24-bit colour BMP, rows from the bottom up, padded to four bytes."""
    rows, columns = samples.shape[:2]
    grey = samples.ndim == 2
    body = samples[::-1].astype(np.uint8) if grey else samples[::-1, :, ::-1].astype(np.uint8)
    line = body.reshape(rows, -1)
    line = np.pad(line, ((0, 0), (0, -line.shape[1] % 4)))
    table = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1) if grey else np.empty((0, 4), np.uint8)
    if grey:
        table[:, 3] = 0
    at = 54 + table.size
    number = lambda n, size=4: int(n).to_bytes(size, "little")
    head = b"BM" + number(at + line.size) + number(0) + number(at)
    info = number(40) + number(columns) + number(rows) + number(1, 2) + number(8 if grey else 24, 2) + number(0) + number(line.size) + number(2835) * 2 + number(256 if grey else 0) + number(0)
    return head + info + table.tobytes() + line.tobytes()


def _netpbm(data: bytes) -> np.ndarray:
    kind, place, numbers = data[:2], 2, []
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, place)
        numbers.append(int(m[1]))
        place = m.end()
    columns, rows = numbers[:2]
    most = numbers[2] if len(numbers) > 2 else 1
    if not (columns > 0 < rows and 0 < most < 65536):
        raise ValueError("no samples, or no largest value")
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|\s", b"", data[place:]), np.uint8)[: rows * columns] - 48
        out = (1 - bits) * 255
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[place:]).split()[: rows * columns * depth], np.int64)
    elif kind == b"P4":
        line = -(-columns // 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, rows * line, place + 1).reshape(rows, line), axis=1)[:, :columns]
        out = (1 - bits) * 255
    else:
        out = np.frombuffer(data, np.uint8 if most < 256 else ">u2", rows * columns * depth, place + 1)
    if most not in (1, 255):
        out = (out.astype(np.int64) * 255 + most // 2) // most
    return out.astype(np.uint8, copy=False).reshape((rows, columns) if depth == 1 else (rows, columns, 3))


def _bmp(data: bytes) -> np.ndarray:
    number = lambda at, size=4: int.from_bytes(data[at : at + size], "little", signed=True)
    at, head, columns, rows, bits = number(10), number(14), number(18), number(22), number(28, 2)
    if number(30) or bits not in (8, 24, 32):
        raise ValueError("only plain 8, 24 and 32-bit BMP")
    if columns <= 0 or not rows:
        raise ValueError("no samples")
    line = (columns * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, abs(rows) * line, at).reshape(abs(rows), line)[:, : columns * bits // 8]
    body = body[::-1] if rows > 0 else body
    if bits != 8:
        return body.reshape(abs(rows), columns, bits // 8)[:, :, 2::-1]
    colours = np.frombuffer(data, np.uint8, (number(46) or 256) * 4, 14 + head).reshape(-1, 4)[:, 2::-1]
    grey = (colours == colours[:, :1]).all()
    return colours[:, 0][body] if grey else colours[body]


def decode(data: bytes) -> np.ndarray:
    """8-bit samples of a Netpbm (P1 to P6) or BMP image: (rows, columns) if grey, else (rows, columns, 3)."""
    if data[:2] == b"BM":
        return _bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456":
        return _netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def resize(grey: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Area averages as float64, from the integral image at the edges of the target's cells.

    Of the integral image only the lines that an edge falls on or between are kept, so that memory doesn't follow the
    number of rows.
    """

    def edges(sums: np.ndarray, image: np.ndarray, target: int) -> np.ndarray:
        cut = np.linspace(0, len(image), target + 1)
        low = np.minimum(cut.astype(np.int64), len(image) - 1)
        return sums + (cut - low)[:, None] * image[low]

    def lines(image: np.ndarray, target: int) -> np.ndarray:
        low = np.minimum(np.linspace(0, len(image), target + 1).astype(np.int64), len(image) - 1)
        out = np.zeros((target + 1, image.shape[1]))
        for i in range(1, target + 1):
            out[i] = out[i - 1] + image[low[i - 1] : low[i]].sum(axis=0, dtype=np.float64)
        return edges(out, image, target)

    integral = lines(lines(grey, rows).T.copy(), columns).T  # (rows + 1, columns + 1)
    area = (len(grey) / rows) * (grey.shape[1] / columns)
    return np.diff(np.diff(integral, axis=0), axis=1) / area


def grey_of(samples: np.ndarray) -> np.ndarray:
    return samples if samples.ndim == 2 else samples @ np.array([0.299, 0.587, 0.114])


def difference_hash(grey: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 9 area averages is over its left neighbour (by more than rounding)."""
    small = resize(grey, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def store_payloads(df: DataFrame, form: str = "netpbm", key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, media: the UTF-8 bytes, padded with 0 to a multiple of 64 (64 at least), as a grey image 64 wide.

    A null text is empty; every row gives one row, and equal texts give equal media; other columns are left out.
    """
    write = {"netpbm": encode_netpbm, "bmp": encode_bmp}[form]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, body, at in slices(batches):
            out = []
            for i, j in zip(at[:-1], at[1:], strict=True):
                padded = np.zeros(max(1, -(-(j - i) // WIDTH)) * WIDTH, np.uint8)
                padded[: j - i] = body[i:j]
                out.append(write(padded.reshape(-1, WIDTH)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(out, pa.binary())], ["key", "n_bytes", "media"])

    made = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return made.mapInArrow(run, f"key {made.schema['key'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("key", key)


def image_columns(df: DataFrame, media: str = "media", tile: int = 32) -> DataFrame:
    """``df``'s columns and, of the image in ``media``: rows, columns, payload, tile (NPY, tile x tile uint8), feature.

    ``payload``: the samples, row by row.  A null, unreadable or empty image gives nulls there, and ``problem`` says why.
    Columns of ``df`` with one of these names give way to them.
    """
    fields = "rows int, columns int, payload binary, tile binary, feature string, problem string"
    names = [f.split()[0] for f in fields.split(", ")]

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, None, None, "null"
        try:
            samples = decode(data)
            grey = grey_of(samples)
            small = np.rint(resize(grey, tile, tile)).astype(np.uint8)
            return samples.shape[0], samples.shape[1], samples.tobytes(), npy(small), difference_hash(grey), None
        except (ValueError, TypeError, IndexError, OverflowError) as e:  # whatever the bytes say is the image's problem, not the job's
            return None, None, None, None, None, str(e) or "cut off"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string()]
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = zip(*map(one, batch.column(0).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], [*batch.schema.names[1:], *names])

    others = [f for f in df.schema if f.name not in names]
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return df.select(F.col(f"`{media}`").alias("__media"), *[F.col(f"`{f.name}`") for f in others]).mapInArrow(run, f"{kept}{fields}")


def query(spark, sf_dir: str) -> DataFrame:
    out = image_columns(store_payloads(documents(spark, sf_dir)))
    size = F.octet_length("payload")
    return out.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.sha2("tile", 256).alias("tile_sha256"),
    )
