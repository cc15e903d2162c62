"""Raw files: listing, decoding, archives."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed, rules, text as tx
from ..functions.storage import written
from ..operators import inventory
from ..operators.keyed import top_per_key


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root``: path, modificationTime, length, content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)


MAX_CONTENT = 2 ** 31 - 1  # Spark reads no longer file into one value
WHOLE = 1 << 25  # bytes of a file that is read into one value
MAX_LINE = 1 << 26  # bytes of a line; a file with a longer one is read into one value
#: Names by which Spark's line reader would decompress a file.
CODECS = r"(?i)\.(gz|bz2|deflate|lz4|snappy|zst)$"
_BOM = b"\xef\xbb\xbf"


def _plain(path: str) -> str:
    """A path as listed, from the encoded form of ``_metadata.file_path``."""
    return re.sub("^file:/*", "/", unquote(path))


def _hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, hash) of files that come line by line, in order (file_path, file_size, value).

    The reader drops a byte order mark at the beginning, and a last line end:
    the size tells whether there was one.  Without a hash, lines were left out.
    """
    now, size, held, sums = None, 0, 0, []

    def done() -> pa.RecordBatch:
        found = None
        for mark, digest in zip((0, len(_BOM)), sums):
            if size - held - mark in (0, 1):
                digest.update(b"\n" * (size - held - mark))
                found = digest.hexdigest()
                break
        return pa.RecordBatch.from_arrays(
            [pa.array([now], pa.string()), pa.array([_plain(now)], pa.string()), pa.array([found], pa.string())],
            names=["file_path", "path", "hash"])

    for batch in batches:
        paths = batch.column("file_path").dictionary_encode()
        files = paths.indices.to_numpy()
        edges = [0, *(np.flatnonzero(files[1:] != files[:-1]) + 1), len(files)]
        for begin, end in zip(edges, edges[1:]):
            if begin == end:
                continue
            path = paths.dictionary[int(files[begin])].as_py()
            text = b"\n".join(batch.column("value").slice(begin, end - begin).to_pylist())
            if path == now:
                text = b"\n" + text
            else:
                if now is not None:
                    yield done()
                now, size, held = path, batch.column("file_size")[begin].as_py(), 0
                sums = [hashlib.sha256(), hashlib.sha256(_BOM)]
            held += len(text)
            for digest in sums:
                digest.update(text)
    if now is not None:
        yield done()


def _large_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of the files longer than WHOLE.

    A task reads one of them from its beginning to its end through Spark's line
    reader, so it holds a batch of lines, never the file.  The few files that
    cannot be read that way are read into one value.
    """
    reader = spark.newSession()  # its own sizes of splits: a whole file, and no two of them
    for name, value in (("maxPartitionBytes", 1 << 40), ("openCostInBytes", 1 << 40)):
        reader.conf.set(f"spark.sql.files.{name}", str(value))
    meta = {n: F.col(f"_metadata.{n}") for n in ("file_path", "file_size")}
    lines = (
        reader.read.options(**{
            "recursiveFileLookup": True, "lineSep": "\n", "ignoreCorruptFiles": True,
            "mapreduce.input.linerecordreader.line.maxlength": MAX_LINE}).text(root)
        .filter((meta["file_size"] > WHOLE) & ~meta["file_path"].rlike(CODECS))
        .select(*[c.alias(n) for n, c in meta.items()], F.col("value").cast("binary").alias("value"))
    )
    hashed = written(lines.mapInArrow(_hashed_lines, "file_path string, path string, hash string"), "file-hashes")
    found = spark.read.schema(hashed.schema).parquet(*hashed.inputFiles()).filter("hash IS NOT NULL")  # in the caller's session
    raw, codec, long = read_files(spark, root), meta["file_path"].rlike(CODECS), F.col("length") > WHOLE
    left = raw.filter(long & ~codec).select(meta["file_path"].alias("file_path")).join(found, "file_path", "left_anti")
    names = [r[0] for r in left.collect()]
    rest = raw.filter((codec | meta["file_path"].isin(names) if names else codec) & long & (F.col("length") <= MAX_CONTENT)).select(
        F.regexp_replace("path", "^file:/*", "/").alias("path"), F.sha2("content", 256).alias("hash"))
    return found.select("path", "hash").unionByName(rest)


def scan_inventory(spark: SparkSession, root: str, with_hash: bool = True) -> DataFrame:
    """Recursive inventory of ``root`` on any file system Spark can read.

    Spark lists no empty files; ``walk_inventory`` does, on a shared mount.
    Content is read only when hashes are wanted, that of a file over WHOLE bytes
    in pieces; files that can only be read into one value and are too long for
    it get the code ``error_too_large``.  Creation and access times are not listed
    by file systems in general and stay null.
    """
    raw = read_files(spark, root)
    listed = raw.select("path", "length", "modificationTime")
    plain = F.regexp_replace("path", "^file:/*", "/")
    if with_hash:
        small = raw.filter(F.col("length") <= WHOLE).select(
            plain.alias("path"), "length", "modificationTime", F.sha2("content", 256).alias("hash"))
        large = listed.filter(F.col("length") > WHOLE).withColumn("path", plain)
        if large.limit(1).count():
            large = large.join(_large_hashes(spark, root), "path", "left").withColumn(
                "hash", F.coalesce("hash", F.lit("error_too_large")))
            small = small.unionByName(large)
        hashed = small
    else:
        hashed = listed.withColumn("path", plain).withColumn("hash", F.lit(None).cast("string"))
    files = hashed.select(
        "path", F.col("length").alias("size_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("created_time"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_time"),
        F.lit(None).cast("timestamp_ntz").alias("access_time"),
        "hash", F.lit("").alias("source_archive"),
    )
    return inventory.inventory_row(files, root=re.sub("^file:/*", "/", root))


MEMBER_SCHEMA = (
    "source_archive string, member string, position int, size_bytes long, "
    "modified_time timestamp_ntz, hash string, content binary"
)


MEMBER_TYPES = {
    "source_archive": pa.string(), "member": pa.string(), "position": pa.int32(), "size_bytes": pa.int64(),
    "modified_time": pa.timestamp("us"), "hash": pa.string(), "content": pa.binary(),
}


def _zip_rows(path: str, content: bytes) -> Iterator[tuple]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError):
        yield path, None, None, 0, None, "error_unreadable", b""  # the archive itself
        return
    with archive:
        for position, info in enumerate(archive.infolist()):
            if info.is_dir():
                continue
            try:
                data = archive.read(info)
                digest, size = hashlib.sha256(data).hexdigest(), info.file_size
            except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError):
                data, digest, size = b"", "error", 0
            yield path, info.filename, position, size, datetime(*info.date_time), digest, data


def zip_members(archives: DataFrame, with_content: bool = True, batch_bytes: int = 1 << 22) -> DataFrame:
    """One row per file inside each zip (path, content).

    An unreadable archive gives one row without a member.  Archives are opened
    one at a time and members go out in batches of about 4 MB, so neither a
    large archive nor many small ones are held unpacked.
    """
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(values, kind) for values, kind in zip(zip(*rows), MEMBER_TYPES.values())], names=list(MEMBER_TYPES))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in _zip_rows(path.as_py(), content.as_py()):
                    held += 256 + (len(row[-1]) if with_content else 0)
                    rows.append(row if with_content else row[:-1] + (None,))
                    if held >= batch_bytes:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return archives.select("path", "content").mapInArrow(expand, MEMBER_SCHEMA)


def archive_members(archives: DataFrame, base_depth: int = 0) -> DataFrame:
    """Inventory rows of zip members, path ``archive::inner``.

    Delete candidates and members of review categories are dropped.
    """
    members = zip_members(archives, with_content=False).filter("member IS NOT NULL")
    name = rules.file_name(F.regexp_replace("member", "/+$", ""))
    inner_folder = F.when(F.col("member").contains("/"), F.regexp_replace("member", "/[^/]+$", "")).otherwise(".")
    rows = members.select(
        F.concat_ws("::", "source_archive", "member").alias("path"),
        name.alias("name"), rules.stem(name).alias("stem"), rules.extension(name).alias("extension"),
        F.concat_ws("::", F.col("source_archive"), inner_folder).alias("folder"),
        (F.size(F.split("member", "/")) + base_depth).cast("long").alias("depth"),
        "size_bytes", F.round(F.col("size_bytes") / F.lit(1048576.0), 2).alias("size_mb"),
        (F.col("size_bytes") == 0).alias("is_empty"), "modified_time", "hash", "source_archive",
    )
    rows = inventory.inventory_status(inventory.categorize_extension(rows))
    return rows.filter((F.col("status") != "DELETE_CANDIDATE")
                       & ~F.col("category").isin(*fixed.REVIEW_CATEGORIES))


def full_inventory(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) for a folder: scanned files, zip members, refused files.

    Files of review categories, unreadable zips and zips too long for one value
    are quarantined with a reason.
    """
    kept, held = inventory.quarantine_split(scan_inventory(spark, root))
    raw = read_files(spark, root).filter(F.lower("path").endswith(".zip") & (F.col("length") <= MAX_CONTENT))
    zips = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content").join(
        kept.select("path", F.col("depth").alias("_depth")), "path")
    too_large = kept.filter((F.col("extension") == ".zip") & (F.col("size_bytes") > MAX_CONTENT)).select(
        "path", F.lit("archive_too_large").alias("reason"))
    broken = (
        zip_members(zips, with_content=False).filter("member IS NULL")
        .select(F.col("source_archive").alias("path"), F.lit("unreadable_archive").alias("reason"))
        .unionByName(too_large)
    )
    depths = kept.select(F.col("path").alias("source_archive"), F.col("depth").alias("_depth"))
    members = (
        archive_members(zips).join(depths, "source_archive")
        .withColumn("depth", F.col("depth") + F.col("_depth")).drop("_depth")
    )
    held = held.unionByName(kept.join(broken, "path"))
    kept = kept.join(broken.select("path"), "path", "left_anti")
    return kept.unionByName(members, allowMissingColumns=True), held


READABLE_MEMBERS = (
    fixed.ROUTE_TEXT + fixed.ROUTE_CSV + fixed.ROUTE_PDF + fixed.ROUTE_DOC + fixed.ROUTE_SHEET
    + fixed.ROUTE_SLIDES + fixed.ROUTE_IMAGE + fixed.ROUTE_JAR + fixed.ROUTE_ARCHIVE + fixed.ROUTE_BINARY
)


def archive_text_rollup(members: DataFrame, limit: int | None = None) -> DataFrame:
    """(source_archive, text, extraction_method): members with text, each under its name.

    ``limit`` takes the first members only, where the caller wants no more.

    Members of types no extractor reads are passed over; .jar and .war files are
    read alike.  Needs source_archive, member, position, text.
    """
    readable = rules.extension(rules.file_name(F.col("member"))).isin(READABLE_MEMBERS)
    with_text = members.filter(readable & (F.coalesce("text", F.lit("")) != ""))
    first = with_text if limit is None else top_per_key(with_text, "source_archive", limit, F.col("position"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "member", "text")))  # one archive's text is one value
    joined = F.array_join(
        F.transform(ordered, lambda m: F.concat(F.lit("["), m["member"], F.lit("]\n"), m["text"])), "\n\n")
    jar = rules.extension(rules.file_name(F.col("source_archive"))).isin(fixed.ROUTE_JAR)
    return first.groupBy("source_archive").agg(tx.strip(joined).alias("text")).withColumn(
        "extraction_method", F.when(jar, "jar_archive").otherwise("archive"))


def text_source(raw: DataFrame) -> DataFrame:
    """Add ``text``: content as UTF-8, bad bytes replaced, stripped."""
    return raw.withColumn("text", tx.strip(F.make_valid_utf8(F.col("content").cast("string"))))


def binary_guard(raw: DataFrame, first_bytes: int | None = None) -> DataFrame:
    """Add ``is_binary``: over 30 % unprintable bytes, in the whole content or the first bytes.

    Known text extensions are exempt.
    """
    content = F.col("content") if first_bytes is None else F.substring("content", 1, first_bytes)
    head = F.decode(content, "ISO-8859-1")
    odd = F.char_length(F.regexp_replace(head, r"[\x20-\x7e\t\n\r\x0b\x0c]", ""))
    share = F.coalesce(F.try_divide(odd, F.char_length(head)), F.lit(0.0))
    exempt = F.col("extension").isin(fixed.ROUTE_TEXT + fixed.ROUTE_CSV)
    return raw.withColumn("is_binary", ~exempt & (share > 0.30))


def printable_strings(raw: DataFrame, min_run: int = 4, runs: int | None = None) -> DataFrame:
    """Add ``text``: the runs of four or more printable ASCII bytes, one per line; the first ``runs`` if given."""
    found = F.regexp_extract_all(
        F.decode("content", "ISO-8859-1"), F.lit(r"[\x20-\x7e]{%d,}" % min_run), F.lit(0))
    return raw.withColumn("text", F.array_join(found if runs is None else F.slice(found, 1, runs), "\n"))
