"""Media columns: TIFF files in binary columns.

``read_pages`` walks each file's chain of image directories, decodes PackBits, LZW or deflate strips
and tiles, undoes horizontal (2) and floating-point (3) predictors and gives one row per page.
``encode`` writes lossless multi-page files of 8-bit grey samples in the same forms.

Nothing is believed before it is checked: directories, values and data must lie inside the file, strips and tiles must
be as many as the image needs, and an image is not larger than ``EXPANSION`` times its data, which no compression
read here exceeds. So what a file makes the reader allocate is in proportion to the file.

Defined results: a null or unreadable file gives one row with page null and ``error`` set; a file whose
directory chain loops, points outside it or meets a damaged page gives the pages up to there and an error row. Extra
columns of the input are kept unless their names clash with those of the output, in which case the output's win.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quadra.llm.bytestok import blocks
from quadra.llm.documents import table
from quadra.llm.store import small_batches

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}


#: An LZW code of nine bits and more gives 4,096 bytes at most, a deflate stream about 1,030 times its bytes.
EXPANSION = 4096


class TiffError(ValueError):
    """A file that breaks the format."""


#: A run of 2 to 128 equal bytes, or 1 to 128 bytes of which none equals the next.
_RUNS = re.compile(rb"(.)\1{1,127}|(?:(.)(?!\2)){1,128}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()
    for m in _RUNS.finditer(data):
        x = m.group()
        if m.group(1):
            out += bytes((257 - len(x), x[0]))
        else:
            out.append(len(x) - 1)
            out += x
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """MSB-first codes of 9 to 12 bits, with the early change of width that the format asks for."""
    out, acc, bits, width, nxt = bytearray(), 256, 9, 9, 258
    codes: dict[int, int] = {}
    seen = -1
    for k in data:
        if seen < 0:
            seen = k
            continue
        grown = codes.get(seen << 8 | k)
        if grown is not None:
            seen = grown
            continue
        acc, bits = acc << width | seen, bits + width
        if nxt == 4093:
            acc, bits = acc << 12 | 256, bits + 12
            codes, width, nxt = {}, 9, 258
        else:
            codes[seen << 8 | k] = nxt
            nxt += 1
            if nxt in (512, 1024, 2048):
                width += 1
        seen = k
        if bits > 4000:
            keep = bits % 8
            out += (acc >> keep).to_bytes((bits - keep) // 8, "big")
            acc, bits = acc & ((1 << keep) - 1), keep
    if seen >= 0:
        acc, bits, nxt = acc << width | seen, bits + width, nxt + 1
        width += nxt in (512, 1024, 2048)
    acc, bits = acc << width | 257, bits + width
    pad = -bits % 8
    return bytes(out) + (acc << pad).to_bytes((bits + pad) // 8, "big")


def lzw_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    known, width, last = first.copy(), 9, None
    acc = bits = 0
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            known, width, last = first.copy(), 9, None
            continue
        if last is None:
            entry = known[code] if code < 256 else None
        elif code < len(known):
            entry = known[code]
        else:
            entry = last + last[:1] if code == len(known) else None
        if entry is None:
            raise TiffError("a code outside the LZW table")
        out += entry
        if last is not None and len(known) < 4096:
            known.append(last + entry[:1])
        last = entry
        n = len(known)
        width = 12 if n >= 2047 else 11 if n >= 1023 else 10 if n >= 511 else 9
    return bytes(out[:size])


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE or not size:
        return data[:size]
    if kind == LZW:
        return lzw_decode(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if kind == PACKBITS:
        return packbits_decode(data, size)
    raise TiffError(f"compression {kind}")


def _unpredict(raw: bytes, predictor: int, rows: int, cols: int, samples: int, bits: int, order: str) -> bytes:
    if predictor == 1:
        return raw
    if predictor == 2 and bits in (8, 16, 32):
        kind = np.dtype(f"{order}u{bits // 8}")
        x = np.frombuffer(raw, kind).reshape(rows, cols, samples)
        return np.cumsum(x, axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()
    if predictor == 3 and bits in (16, 32, 64):
        # differences of bytes a pixel apart, over planes of bytes, the most significant first
        width = bits // 8
        x = np.frombuffer(raw, np.uint8).reshape(rows, cols * width, samples)
        x = np.cumsum(x, axis=1, dtype=np.uint8).reshape(rows, width, cols * samples).transpose(0, 2, 1)
        return np.ascontiguousarray(x if order == ">" else x[:, :, ::-1]).tobytes()
    raise TiffError(f"predictor {predictor} with {bits} bits")


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Numbers of each tag (other kinds of values are left out), and the place of the next directory."""
    head, entry, off = (8, 20, 8) if big else (2, 12, 4)
    word = "Q" if big else "I"
    (n,) = struct.unpack_from(order + ("Q" if big else "H"), data, at)
    if at + head + n * entry + off > len(data):
        raise TiffError("a directory lies outside the file")
    tags: dict[int, tuple] = {}
    for k in range(n):
        p = at + head + k * entry
        tag, kind = struct.unpack_from(order + "HH", data, p)
        (count,) = struct.unpack_from(order + word, data, p + 4)
        size, q = _SIZES.get(kind, 1) * count, p + entry - off
        if size > off:
            (q,) = struct.unpack_from(order + word, data, q)
        if q + size > len(data):
            raise TiffError(f"tag {tag} lies outside the file")
        if kind in _FORMS and count:
            tags[tag] = struct.unpack_from(f"{order}{count}{_FORMS[kind]}", data, q)
    (nxt,) = struct.unpack_from(order + word, data, at + head + n * entry)
    return tags, nxt


def _whole(tags: dict[int, tuple], tag: int, default: int) -> int:
    value = tags.get(tag, (default,))[0]
    if not isinstance(value, int) or value < 0:
        raise TiffError(f"tag {tag} is no whole number")
    return value


def _parts(data: bytes, tags: dict[int, tuple], places: int, counts: int, n: int, size: int) -> list[bytes]:
    """The data of ``n`` strips or tiles, which make an image of ``size`` bytes."""
    where = list(zip(tags.get(places, ()), tags.get(counts, ()), strict=False))
    if len(tags.get(places, ())) != n or len(where) != n:
        raise TiffError("strips or tiles do not fill the image")
    if any(not isinstance(x, int) or x < 0 for w in where for x in w) or any(o + c > len(data) for o, c in where):
        raise TiffError("a strip or tile lies outside the file")
    if size > EXPANSION * (sum(c for _, c in where) + 1):
        raise TiffError("the image is larger than its data")
    return [data[o : o + c] for o, c in where]


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    get = lambda tag, default: _whole(tags, tag, default)
    width, height, samples = get(256, 0), get(257, 0), get(277, 1)
    bits, kind, predictor = get(258, 1), get(259, 1), get(317, 1)
    if get(284, 1) != 1 and samples > 1:
        raise TiffError("separate planes")
    pixel = samples * bits

    def read(raw: bytes, rows: int, row: int, cols: int) -> bytes:
        x = _unpack(kind, raw, rows * row)
        if len(x) != rows * row:
            raise TiffError("a strip or tile is too short")
        return _unpredict(x, predictor, rows, cols, samples, bits, order)

    if 322 in tags:
        tw, th, step = get(322, 0), get(323, 0), pixel // 8
        if not tw or not th or not step or pixel % 8:
            raise TiffError("tiles of no whole bytes")
        across, down = -(-width // tw), -(-height // th)
        parts = _parts(data, tags, 324, 325, across * down, across * down * tw * th * step)
        image = np.zeros((height, width * step), np.uint8)
        for k, raw in enumerate(parts):
            block = np.frombuffer(read(raw, th, tw * step, tw), np.uint8).reshape(th, tw * step)
            y, x = k // across * th, k % across * tw * step
            image[y : y + th, x : x + tw * step] = block[: height - y, : width * step - x]
        pixels = image.tobytes()
    else:
        row, per = -(-width * pixel // 8), min(get(278, height), height) or height or 1
        parts = _parts(data, tags, 273, 279, -(-height // per), row * height)
        pixels = b"".join(read(raw, min(per, height - k * per), row, width) for k, raw in enumerate(parts))
    return {"width": width, "height": height, "samples": samples, "bits": bits, "compression": kind, "predictor": predictor, "pixels": pixels}


def pages(data: bytes) -> Iterator[dict]:
    """One dict per image directory: page, width, height, samples, bits, compression, predictor, pixels."""
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (magic,) = struct.unpack_from(order + "H", data, 2)
    if magic not in (42, 43):
        raise TiffError("not a TIFF file")
    big = magic == 43
    seen: set[int] = set()
    try:
        (at,) = struct.unpack_from(order + ("Q" if big else "I"), data, 8 if big else 4)
        while at:
            if at in seen or at >= len(data):
                raise TiffError("the chain of directories is broken")
            seen.add(at)
            tags, at = _directory(data, at, order, big)
            yield {"page": len(seen) - 1} | _page(data, tags, order)
    except (struct.error, zlib.error, OverflowError) as e:
        raise TiffError(str(e)) from e


def encode(payload: bytes, width: int = 64, page_rows: int = 4096, strip_rows: int = 1024, compression: int = DEFLATE, predictor: int = 1, level: int = 1, order: str = "<", tile: int = 0) -> bytes:
    """A TIFF of 8-bit grey pages, ``width`` samples a row; the payload must fill whole rows."""
    if not payload or len(payload) % width:
        raise TiffError("the payload must fill whole rows")
    rows = len(payload) // width
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for top in range(0, rows, page_rows):
        height = min(page_rows, rows - top)
        image = np.frombuffer(payload, np.uint8, height * width, top * width).reshape(height, width)
        if tile:
            cut = [(y, x) for y in range(0, height, tile) for x in range(0, width, tile)]
            parts = []
            for y, x in cut:
                block = np.zeros((tile, tile), np.uint8)
                piece = image[y : y + tile, x : x + tile]
                block[: piece.shape[0], : piece.shape[1]] = piece
                parts.append(block)
        else:
            parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        places, counts = [], []
        for x in parts:
            if predictor == 2:
                x = np.diff(x, axis=1, prepend=np.uint8(0))
            raw = x.tobytes()
            packed = {NONE: lambda r: r, LZW: lzw_encode, DEFLATE: lambda r: zlib.compress(r, level), PACKBITS: packbits_encode}[compression](raw)
            out += b"\0" * (len(out) % 2)
            places.append(len(out))
            counts.append(len(packed))
            out += packed
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1])]
        where = [(322, 4, [tile]), (323, 4, [tile]), (324, 4, places), (325, 4, counts)] if tile else [(273, 4, places), (278, 4, [strip_rows]), (279, 4, counts)]
        tags = sorted([*tags, (277, 3, [1]), (317, 3, [predictor]), *where])
        entries = b""
        for tag, kind, values in tags:
            form = order + f"{len(values)}{_FORMS[kind]}"
            value = struct.pack(form, *values)
            if len(value) > 4:
                out += b"\0" * (len(out) % 2)
                place = len(out)
                out += value
                value = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def read_pages(df: DataFrame, column: str = "media") -> DataFrame:
    """One row per page of the TIFF files in ``column``, beside the other columns of ``df``."""
    fields = T._parse_datatype_string(PAGE_FIELDS).fields
    taken = {f.name for f in fields}
    others = [f for f in df.schema.fields if f.name != column and f.name not in taken]
    names = [f.name for f in others]
    out = T.StructType([*others, *fields])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows, size = [], [], 0
            for i in range(batch.num_rows):
                try:
                    for page in pages(batch.column(len(names))[i].as_py() or b""):
                        at.append(i)
                        rows.append(page | {"error": None})
                        size += len(page["pixels"])
                        if size > 32_000_000:
                            yield _page_batch(batch, names, at, rows, fields)
                            at, rows, size = [], [], 0
                except TiffError as e:
                    at.append(i)
                    rows.append(dict.fromkeys(taken) | {"error": str(e)})
            yield _page_batch(batch, names, at, rows, fields)

    return df.select(*[df[n] for n in names], df[column]).mapInArrow(decode, out)


def _page_batch(batch: pa.RecordBatch, names: list[str], at: list[int], rows: list[dict], fields: list) -> pa.RecordBatch:
    kept = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(names))]
    kinds = [pa.binary() if f.name == "pixels" else pa.string() if f.name == "error" else pa.int32() for f in fields]
    made = [pa.array([r[f.name] for r in rows], k) for f, k in zip(fields, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(kept + made, names=[*names, *(f.name for f in fields)])


def text_payload(text: bytes, unit: int = 64) -> bytes:
    """The text, then zero bytes up to a positive multiple of ``unit``."""
    return text + b"\0" * (-len(text) % unit if text else unit)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def form_of(payload: bytes) -> dict:
    """The form in which a payload is stored: one of 32, told by its checksum, so equal payloads are stored alike."""
    v = zlib.crc32(payload)
    return {"compression": (DEFLATE, LZW, PACKBITS, NONE)[v % 4], "predictor": 1 + (v >> 2) % 2, "tile": 32 * ((v >> 3) % 2), "order": "<>"[(v >> 4) % 2]}


def text_media(df: DataFrame, text: str = "text", key: str = "doc_id", page_rows: int = 256, strip_rows: int = 64) -> DataFrame:
    """Store each whole text as a TIFF, read the stored bytes back and describe what was read.

    Pages have ``page_rows`` rows of 64 samples. Compression, predictor, strips or tiles and byte order are
    those of ``form_of``, so all are in use. The feature has pages, rows, mean and entropy (bits, four decimals) of the samples
    read back, and the form as read. A null text is empty, and an empty one is a page of one row of zeros. One row per
    input row, repeated or not.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, j, data, offsets in blocks(batch.column(1), 8_000_000):
                cols: list[list] = [[] for _ in range(7)]
                for k in range(j - i):
                    raw = data[offsets[k] : offsets[k + 1]].tobytes()
                    payload = text_payload(raw)
                    media = encode(payload, page_rows=page_rows, strip_rows=strip_rows, **form_of(payload))
                    sha, n, tail, counts, n_pages, rows = hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, 0
                    for page in pages(media):
                        pixels = page["pixels"]
                        sha.update(pixels)
                        tail = (tail + pixels[-64:])[-64:]
                        counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
                        n, n_pages, rows = n + len(pixels), n_pages + 1, rows + page["height"]
                    share = counts[counts > 0] / n
                    entropy = abs(float(-(share * np.log2(share)).sum()))
                    mean = float(counts @ np.arange(256)) / n
                    feature = f"pages={n_pages};rows={rows};mean={mean:.4f};entropy={entropy:.4f};compression={page['compression']};predictor={page['predictor']}"
                    row = (len(raw), n, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), feature)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return df.select(df[key].cast("long").alias("doc_id"), df[text]).mapInArrow(run, DIGEST)


def op3_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


QUERY = ("op3_media_tiff", op3_media_tiff)
#: SQL cannot write image files; tests hold the query against a brute-force version.
ORACLE = None
