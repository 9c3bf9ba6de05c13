"""Zip archives as tables: an index of members, and the members' bytes by ranged reads."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ("jpg", "jpeg", "png")
#: Members that one task reads, about; members of one archive are spread over tasks.
MEMBERS_PER_TASK = 2_000


def _open(uri: str) -> pa.NativeFile:
    if uri.startswith("file:/") and not uri.startswith("file://"):  # as Spark writes local paths
        uri = "file://" + uri[5:]
    place, path = fs.FileSystem.from_uri(uri)
    return place.open_input_file(path)


def index(spark: SparkSession, path: str, extensions: tuple[str, ...] = IMAGES) -> DataFrame:
    """(archive, member, offset, packed, size) of the members with one of the extensions, of the zips below path.

    Only an archive's directory is read, on executors; an unreadable archive has no rows. Save the
    table where it is used more than once.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path).select("path")

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    with _open(uri) as f, zipfile.ZipFile(f) as z:
                        found = [i for i in z.infolist() if i.filename.lower().endswith(tuple("." + e for e in extensions))]
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter for files shorter than a zip's end
                    continue
                columns = [[uri] * len(found), [i.filename for i in found], *([getattr(i, a) for i in found] for a in ("header_offset", "compress_size", "file_size"))]
                kinds = [pa.string()] * 2 + [pa.int64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "member", "offset", "packed", "size"])

    return files.mapInArrow(list_members, "archive string, member string, offset bigint, packed bigint, size bigint")


def contents(members: DataFrame) -> DataFrame:
    """(archive, member, content) of rows of an index; a member that can't be unpacked has null content."""
    wanted = members.select("archive", "member", "offset")
    parts = max(1, -(-wanted.count() // MEMBERS_PER_TASK))
    wanted = wanted.repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = z = None
        for batch in batches:
            for archive, member in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                if archive != uri:
                    uri, z = archive, zipfile.ZipFile(_open(archive))
                try:
                    content = z.read(member)
                except (zipfile.BadZipFile, NotImplementedError, KeyError):
                    content = None
                kinds = [pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((archive, member, content), kinds, strict=True)], ["archive", "member", "content"])

    return wanted.mapInArrow(read, "archive string, member string, content binary")


def in_every_archive(members: DataFrame) -> DataFrame:
    """(name): paths below the top folder that all archives of an index hold."""
    named = members.filter(F.instr("member", "/") > 0).select("archive", F.expr("substring(member, instr(member, '/') + 1)").alias("name"))
    archives = members.agg(F.count_distinct("archive").alias("n"))
    held = named.groupBy("name").agg(F.count_distinct("archive").alias("k"))
    return held.join(F.broadcast(archives)).filter("k = n").select("name")  # one row is broadcast
