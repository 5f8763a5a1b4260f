"""Media columns: content-addressed payloads in tar shards.

Payloads are stored as 8-bit grey PNG images (64 samples a row), lossless and self-describing, under the digest of
their stored bytes, once a corpus: of equal texts the row with the smallest id is the one that stores. Every task
writes one tar shard per portion of its rows into the shared folder, under a name of its own attempt; the written
table of addresses names the shards that count, so a task that ran twice leaves a shard that nothing points to. Rows
carry shard, digest, offset and length; they are dealt to tasks by shard, read first the headers alone, in small
range reads that fill the metadata columns, and then, for features, the payloads.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import new_path, released, salted_join, slices, written

WIDTH = 64
#: Fixed values of the PNG format: its signature and the bytes of signature and header chunk.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33
#: Payload bytes after which a shard is closed.
SHARD = 64 << 20
ADDRESS = "shard string, digest binary, offset long, length long"
#: Contents of several rows, of 40 bytes each, that may be broadcast.
FEW = 200_000


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, filled with zeros up to a positive multiple of 64, and their number before."""
    data = (text or "").encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH)), len(data)


def png(samples: bytes) -> bytes:
    """A grey 8-bit image of WIDTH columns without filters."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")


def header(data: bytes) -> tuple[int, int, int]:
    """Width, height and bits per sample from an image's first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR" or zlib.crc32(data[12:29]) != struct.unpack(">I", data[29:33])[0]:
        raise ValueError("not the header of a PNG image")
    return struct.unpack(">IIB", data[16:25])


def samples(data: bytes) -> bytes:
    """The samples of an image that ``png`` made; checksums are held against their chunks."""
    width, height, _ = header(data)
    at, body = HEADER, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a chunk's checksum does not hold")
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(data: bytes) -> str:
    """Mean, deviation and entropy of the samples, and four means of quarters of the rows."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    share = np.bincount(grid.ravel(), minlength=256) / grid.size
    share = share[share > 0]
    quarters = [float(x.mean()) if len(x) else 0.0 for x in np.array_split(grid, 4)]
    return ";".join(f"{x:.4f}" for x in (grid.mean(), grid.std(), -(share * np.log2(share)).sum(), *quarters))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    where, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return where, path


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, digest, offset, length) per row, the payloads in tar shards beside the table.

    Defined cases: a null or empty text is one row of zeros; repeated rows and equal texts share an entry (rows that
    repeat the smallest id of a text may store it again, and then all point to one of these); a null id stays null;
    an empty table makes no shard; other columns play no part.
    """
    spark = docs.sparkSession
    folder = new_path(spark, "media")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("content"))
    seen = written(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "media-contents")
    least = F.coalesce(F.min("doc_id"), F.lit(-(1 << 63)))
    several = written(seen.groupBy("content").agg(F.count("*").alias("rows"), least.alias("keep")).filter("rows > 1"), "media-several")
    own = F.coalesce("doc_id", F.lit(-(1 << 63)))
    if several.count() <= FEW:  # the texts meet only the contents that several rows have, by broadcast
        keepers = F.broadcast(several.select("content", "keep"))
        mine = rows.join(keepers, "content", "left").filter(F.col("keep").isNull() | (own == F.col("keep")))
    else:  # each content meets its keeper by content and id, which spreads the rows of a common content over tasks
        keepers = seen.groupBy("content").agg(least.alias("keep"))
        mine = rows.withColumn("keep", own).join(keepers, ["content", "keep"])

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, top = opened(folder)
        held: set[bytes] = set()
        sink, tar, size, shard = None, None, 0, ""
        for batch in slices(batches):
            out = []
            for content, text in zip(batch["content"], batch["text"], strict=True):
                if content in held:
                    continue
                held.add(content)
                if sink is None:
                    where.create_dir(top, recursive=True)
                    shard = f"{uuid.uuid4().hex}.tar"
                    sink = where.open_output_stream(f"{top}/{shard}")
                    tar = tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT)
                data, _ = payload(text)
                image = png(data)
                digest = hashlib.sha256(image)
                entry = tarfile.TarInfo(f"{digest.hexdigest()[:2]}/{digest.hexdigest()}.png")
                entry.size = len(image)
                out.append((content, f"{folder}/{shard}", digest.digest(), tar.offset + tarfile.BLOCKSIZE, len(image)))
                tar.addfile(entry, io.BytesIO(image))
                size += len(data)
            if size >= SHARD:
                tar.close()
                sink.close()
                held, sink, size = set(), None, 0
            yield pd.DataFrame(out, columns=["content", "shard", "digest", "offset", "length"])
        if sink is not None:
            tar.close()
            sink.close()

    made = written(mine.select("content", "text").mapInPandas(write, f"content binary, {ADDRESS}"), "media-entries")
    # each content once, with the number of its rows
    address = made.groupBy("content").agg(F.min(F.struct("shard", "digest", "offset", "length")).alias("at"))
    address = written(address.join(several.select("content", "rows"), "content", "left").select("content", "at.*", F.coalesce("rows", F.lit(1)).alias("rows")), "media-addresses")
    found = salted_join(seen, address, ["content"], "rows", ["doc_id", "n_bytes"])
    rows = written(found.select("doc_id", "n_bytes", "shard", F.lower(F.hex("digest")).alias("digest"), "offset", "length"), "media-rows")
    released(spark, seen, several, made, address)
    return rows


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def dealt(rows: DataFrame, portions: int = 16) -> DataFrame:
    """Rows of ``stored`` dealt by shard, each in so many runs of its entries, and in their order there."""
    run = F.expr(f"offset div {max(1, SHARD // portions)}")
    return rows.repartition("shard", run).sortWithinPartitions("shard", "offset")


def ranges(batches: Iterator[pd.DataFrame], most: int | None = None) -> Iterator[tuple[pd.DataFrame, list[bytes]]]:
    """Batches with the bytes that their rows point to, or the first ``most`` of each; one shard is open at a time."""
    name, file, last = None, None, (None, b"")
    try:
        for batch in slices(batches):
            found = []
            for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    where, path = opened(shard)
                    name, file, last = shard, where.open_input_file(path), (None, b"")
                if last[0] != offset:
                    last = offset, file.read_at(min(length, most or length), offset)
                found.append(last[1])
            yield batch, found
    finally:
        if file is not None:
            file.close()


def metadata(rows: DataFrame) -> DataFrame:
    """``rows`` of ``stored`` with width, height and bits, from range reads of HEADER bytes each.

    Defined cases: null ids and repeated rows keep their rows; rows of one entry get equal values; no rows give none.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, found in ranges(batches, HEADER):
            known = [header(x) for x in found]
            yield batch.assign(**{n: [x[k] for x in known] for k, n in enumerate(("width", "height", "bits"))})

    return rows.mapInPandas(read, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, width long, height long, bits long")


def features(rows: DataFrame) -> DataFrame:
    """A row per row of ``metadata``: what is read back from its shard, and features of it.

    Defined cases: as in ``metadata``; a payload of zeros has features like any other.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, found in ranges(batches):
            out, known = [], (None, ())
            for doc, n, digest, width, height, bits, image in zip(*(batch[c] for c in ("doc_id", "n_bytes", "digest", "width", "height", "bits")), found, strict=True):
                if digest != known[0]:
                    if hashlib.sha256(image).hexdigest() != digest:
                        raise ValueError(f"stored bytes do not match their digest {digest}")
                    data = samples(image)
                    if 8 * len(data) != width * height * bits:
                        raise ValueError(f"stored samples do not match the header of {digest}")
                    known = digest, (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-WIDTH:]), len(image), digest, feature(data))
                out.append((None if pd.isna(doc) else int(doc), n, *known[1], width, height, bits))
            yield _frame(out, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits"])

    return rows.mapInPandas(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long, bits long")
