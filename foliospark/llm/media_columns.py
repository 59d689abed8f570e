"""Media columns: archives of members, read by a custom data source that plans byte ranges."""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliospark.llm.support import new_path, stage_table
from foliospark.sources.staging import arrow_filesystem

#: Samples a row of an image; bytes of an archive, of a planned range and of a batch; tries of a member.
WIDTH = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES = 32 << 20, 8 << 20, 4 << 20, 3
#: Tasks that a folder is planned into at most; beyond, ranges are longer.
MAX_TASKS = 50_000
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_media(text: bytes) -> bytes:
    """An 8-bit grey PNG of WIDTH columns whose samples are the text, padded with 0 to whole rows.

    The text's own length is kept in a text chunk. Equal texts give equal files.
    """
    rows = max(1, -(-len(text) // WIDTH))
    image = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # a filter byte of 0 before each row
    flat = np.zeros(rows * WIDTH, dtype=np.uint8)
    flat[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    image[:, 1:] = flat.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"Length\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(image, 1)) + _chunk(b"IEND", b"")


def decode_media(media: bytes) -> tuple[bytes, int]:
    """(payload, the text's own length) of a PNG from encode_media; checks every chunk's sum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, length, rows = 8, [], 0, 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            rows = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"tEXt" and body.startswith(b"Length\0"):
            length = int(body[7:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    image = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(rows, WIDTH + 1)
    if image[:, 0].any():
        raise ValueError("rows with a filter")
    return image[:, 1:].tobytes(), length


def features(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, share of zeros and mean step of the samples, as text."""
    x = np.frombuffer(payload, dtype=np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    value = np.arange(256)
    mean = float((n * value).sum() / len(x))
    sd = float(np.sqrt(max(0.0, (n * value * value).sum() / len(x) - mean * mean)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};sd={sd:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};zeros={n[0] / len(x):.4f};step={step:.4f}"


#: Header of the extra field of a ZIP member that holds its key; a field's bytes at most.
_KEY_FIELD, _KEY_BYTES = 0x6B64, 65_000


def key_field(key: str | None) -> bytes:
    """A member's extra field: whether it has a key, and the key, any string of up to 65,000 bytes."""
    raw = b"n" if key is None else b"k" + key.encode("utf-8", "surrogatepass")
    if len(raw) > _KEY_BYTES:
        raise ValueError("a key is longer than a ZIP member's extra field")
    return struct.pack("<HH", _KEY_FIELD, len(raw)) + raw


def key_of(extra: bytes) -> str | None:
    """The key that key_field() wrote; null if there is none."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == _KEY_FIELD and extra[at + 4 : at + 5] == b"k":
            return extra[at + 5 : at + 4 + n].decode("utf-8", "surrogatepass")
        at += 4 + n
    return None


def _write_archives(uri: str, archive_bytes: int):
    """(key, text) -> (archive, bytes, members): a task writes whole archives, named by its partition.

    An archive appears under its name in one move once it is complete, so a lost task leaves nothing
    that a reader sees, and a repeated one puts the same archive in its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_filesystem(uri)
        task = TaskContext.get()
        part, count = task.partitionId(), 0
        buffer, members = io.BytesIO(), 0
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def close() -> pa.RecordBatch:
            nonlocal buffer, archive, members, count
            archive.close()
            name = f"part-{part:06d}-{count:05d}.zip"
            wip = f"{root}/.{name}.{task.taskAttemptId()}"
            with fs.open_output_stream(wip) as out:
                out.write(buffer.getbuffer())
            fs.move(wip, f"{root}/{name}")
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([buffer.tell()], pa.int64()), pa.array([members], pa.int64())], ["archive", "bytes", "members"])
            buffer, members, count = io.BytesIO(), 0, count + 1
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
            return done

        for b in batches:
            for key, text in zip(b.column("key"), b.column("text"), strict=True):
                info = zipfile.ZipInfo(f"{members:08d}.png", (1980, 1, 1, 0, 0, 0))
                info.extra = key_field(key.as_py())
                archive.writestr(info, encode_media((text.as_py() or "").encode("utf-8", "surrogatepass")))
                members += 1
                if buffer.tell() >= archive_bytes:
                    yield close()
        if members:
            yield close()

    return run


@dataclass
class ByteRanges(InputPartition):
    """(archive, start, end, members of the archive or -1) of each range that one task reads."""

    ranges: list[tuple[str, int, int, int]]


class ArchiveReader(DataSourceReader):
    """Members of all archives in a folder: (archive, offset, name, key, media).

    The driver plans byte ranges from the archives' sizes alone: from the manifest that the writers'
    committed tasks left, or by listing the folder. A task holds ranges of at least rangeBytes in all, more
    where the total would make over MAX_TASKS tasks. It takes the members whose local header begins in a
    range, from the archive's own central directory, and streams them in Arrow batches of bounded
    size. Neighbouring members are read at once; one whose bytes are wrong is read again by itself, by its
    offset. An archive that has not the members its manifest says is an error.
    """

    def __init__(self, options):
        self.path = options["path"]
        self.manifest = options.get("manifest")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchBytes", BATCH_BYTES))
        self.tries = int(options.get("tries", TRIES))

    def _archives(self) -> list[tuple[str, int, int]]:
        """(path, bytes, members or -1) of the archives."""
        from pyarrow import fs as pafs

        fs, root = arrow_filesystem(self.path)
        if self.manifest:
            from pyarrow import dataset

            store, table = arrow_filesystem(self.manifest)
            rows = dataset.dataset(table, filesystem=store, format="parquet", exclude_invalid_files=False).to_table(["archive", "bytes", "members"])
            return sorted((f"{root}/{x['archive']}", x["bytes"], x["members"]) for x in rows.to_pylist())
        return sorted((f.path, f.size, -1) for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".zip") and not f.base_name.startswith("."))

    def partitions(self):
        files = self._archives()
        size = max(self.range_bytes, sum(n for _, n, _ in files) // MAX_TASKS)
        parts: list[ByteRanges] = []
        room = 0
        for path, n, members in files:
            for start in range(0, n, size):
                end = min(start + size, n)
                if end - start > room:
                    parts.append(ByteRanges([]))
                    room = size
                parts[-1].ranges.append((path, start, end, members))
                room -= end - start
        return parts or [ByteRanges([])]

    def read(self, partition):
        fs, _ = arrow_filesystem(self.path)
        rows, held = [], 0
        for archive, start, end, members in partition.ranges:
            with fs.open_input_file(archive) as f, zipfile.ZipFile(f) as z:
                every = z.infolist()
                if members not in (-1, len(every)):
                    raise OSError(f"{archive} has {len(every)} members, its manifest says {members}")
                own = sorted((m.header_offset, m.filename, key_of(m.extra)) for m in every if start <= m.header_offset < end)
                # where each member ends: the next one's header, or the central directory
                stops = dict(zip(at := sorted(m.header_offset for m in every), [*at[1:], z.start_dir], strict=True))
                for offset, name, key, media in self.members(fs, f, archive, own, stops):
                    rows.append((archive, offset, name, key, media))
                    held += len(media)
                    if held >= self.batch_bytes:
                        yield self.batch(rows)
                        rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def members(self, fs, f, archive, own, stops):
        """(offset, name, key, media) of members in order, read in runs of at most batch_bytes."""
        k = 0
        while k < len(own):
            first = last = k
            while last + 1 < len(own) and own[last + 1][0] == stops[own[last][0]] and stops[own[last + 1][0]] - own[first][0] <= self.batch_bytes:
                last += 1
            base = own[first][0]
            try:
                data = f.read_at(stops[own[last][0]] - base, base)
            except OSError:
                data = b""
            for offset, name, key in own[first : last + 1]:
                media = self.cut(data, offset - base)
                yield offset, name, key, self.member(fs, archive, offset) if media is None else media
            k = last + 1

    @staticmethod
    def cut(data: bytes, at: int) -> bytes | None:
        """The member whose local header is at ``at``, checked against its CRC; null if it is not whole."""
        if len(data) < at + 30:
            return None
        mark, *_, crc, n, _, names, extra = struct.unpack_from("<4s5H3I2H", data, at)
        begin = at + 30 + names + extra
        media = data[begin : begin + n]
        return media if mark == b"PK\x03\x04" and len(media) == n and zlib.crc32(media) == crc else None

    @staticmethod
    def batch(rows) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["archive", "offset", "name", "key", "media"])

    def member(self, fs, archive: str, offset: int) -> bytes:
        """One member's bytes from its local header on, checked against its CRC; retried by itself."""
        for k in range(self.tries):
            try:
                with fs.open_input_file(archive) as f:
                    head = f.read_at(30, offset)
                    if len(head) < 30:
                        raise OSError("no member at this offset")
                    *_, n, _, names, extra = struct.unpack("<4s5H3I2H", head)
                    media = self.cut(f.read_at(30 + names + extra + n, offset), 0)
                if media is None:
                    raise OSError("a member's checksum differs")
                return media
            except OSError as e:
                if k + 1 == self.tries:
                    raise OSError(f"{archive} at {offset}: {e}") from e
                time.sleep(0.1 * 2**k)
        raise AssertionError


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(folder)``: members of the ZIP archives in a folder."""

    @classmethod
    def name(cls):
        return "archive_members"

    def schema(self):
        return "archive string, offset long, name string, key string, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


def write_media(rows: DataFrame, uri: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, str]:
    """Stores (key string, text string) as archives of media files; their folder, and the manifest's: a table of
    (archive, bytes, members) that the committed tasks reported."""
    uri = uri or new_path(rows.sparkSession, "media")
    fs, root = arrow_filesystem(uri)
    fs.create_dir(root, recursive=True)
    made = stage_table(rows.select("key", "text").mapInArrow(_write_archives(uri, archive_bytes), "archive string, bytes long, members long"), "archives")
    return uri, made._staged_path


def read_media(spark: SparkSession, uri: str, manifest: str | None = None) -> DataFrame:
    """(key, archive, offset, media) of every member; key null where it was. With a manifest exactly its archives."""
    spark.dataSource.register(ArchiveMembers)
    reader = spark.read.format("archive_members")
    members = (reader.option("manifest", manifest) if manifest else reader).load(uri)
    return members.select("key", "archive", "offset", "media")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for b in batches:
        rows = []
        for m in b.column("media"):
            media = m.as_py()
            payload, n = decode_media(media)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload)))
        yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], ["key", *names])


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as a media file, reads it back through the data source, and digests it.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, one row per row of ``docs``. Null and empty texts are one row of 64 zero samples; null
    doc_ids come back null, strings as they were (up to 65,000 bytes, beyond that an error); repeated rows are members of their own; extra columns are ignored; an empty
    table gives none. No shuffle: the archives in the shared folder lie between the two stages.
    """
    kind = docs.schema["doc_id"].dataType
    uri, manifest = write_media(docs.select(F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text")))
    found = read_media(docs.sparkSession, uri, manifest).select("key", "media")
    out = found.mapInArrow(_digest, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.select(F.col("key").cast(kind).alias("doc_id"), *out.columns[1:])
