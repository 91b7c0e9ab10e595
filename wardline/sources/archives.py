"""Archives of any size, member by member.

A ZIP keeps its directory at its end. It is read first, for all archives in
parallel and without their content; limits are checked there. Members are then
dealt to tasks, each of which opens the archive at its member and unpacks it in
parts, so neither an archive nor a member is ever whole in memory. Files are
opened through pyarrow's file systems, which take local paths and those of the
usual stores.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.files import MAX_MEMBER, MAX_MEMBERS, MAX_RATIO, MAX_TOTAL, unsafe

PART = 4 << 20
#: Members of a directory handed on at once.
PAGE = 1000


def open_file(path: str):
    """A seekable file of any store that pyarrow knows."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(name)


def _local_uri(path: str) -> str:
    """Spark writes file:/a where others write file:///a."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def checked(infos: list[zipfile.ZipInfo], max_members: int, max_member: int, max_total: int, max_ratio: int) -> str | None:
    """What is wrong with a directory, if anything."""
    if len(infos) > max_members or sum(i.file_size for i in infos) > max_total:
        return "archive is too large"
    for i in infos:
        if unsafe(i.filename):
            return f"unsafe name {i.filename}"
        if i.file_size > max_member or i.file_size > max_ratio * max(i.compress_size, 1):
            return f"member is too large: {i.filename}"
    return None


def directory(spark: SparkSession, path: str, max_members: int = MAX_MEMBERS, max_member: int = MAX_MEMBER, max_total: int = MAX_TOTAL, max_ratio: int = MAX_RATIO) -> DataFrame:
    """(path, member, n, size, error) of the ZIP files under ``path``; a broken archive or one beyond the limits is one row with an error."""
    limits = (max_members, max_member, max_total, max_ratio)
    columns = ["path", "member", "n", "size", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in b["path"]:
                try:
                    with open_file(_local_uri(p)) as f, zipfile.ZipFile(f) as z:
                        infos = [i for i in z.infolist() if not i.is_dir()]
                    error = checked(infos, *limits)
                except (zipfile.BadZipFile, ValueError, OSError) as e:
                    infos, error = [], str(e) or type(e).__name__
                if error:
                    yield pd.DataFrame([(p, None, None, None, error)], columns=columns)
                    continue
                for at in range(0, len(infos), PAGE):
                    yield pd.DataFrame([(p, i.filename, at + n, i.file_size, None) for n, i in enumerate(infos[at : at + PAGE])], columns=columns)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").filter(F.lower("path").endswith(".zip"))
    return files.mapInPandas(run, "path string, member string, n long, size long, error string")


def members(listed: DataFrame, part: int = PART) -> DataFrame:
    """(path, member, part, last, content, error): the members of ``directory`` in parts of ``part`` bytes, and its errors.

    Members are dealt by name, so those of one archive go to many tasks. A
    member that is more or less than its directory says, or fails its checksum,
    ends in a row with an error. An empty member is one empty part.
    """
    columns = ["path", "member", "part", "last", "content", "error"]

    def one(z: zipfile.ZipFile, path: str, info: zipfile.ZipInfo) -> Iterator[tuple]:
        at, number = 0, 0
        try:
            with z.open(info) as f:
                while True:
                    data = f.read(part)
                    at += len(data)
                    if at > info.file_size or (not data and at < info.file_size):
                        raise ValueError("member is not as large as declared")
                    if data or not number:
                        yield path, info.filename, number, at == info.file_size, data, None
                        number += 1
                    if at == info.file_size:
                        f.read(1)  # the checksum is compared at the end
                        return
        except (zipfile.BadZipFile, ValueError, OSError, EOFError) as e:
            yield path, info.filename, number, True, None, str(e) or type(e).__name__
        except Exception as e:  # noqa: BLE001 - what zlib raises of broken data
            yield path, info.filename, number, True, None, str(e) or type(e).__name__

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened: tuple = (None, None, None, [])
        held: list[tuple] = []  # small parts leave together
        weight = 0
        for b in batches:
            for p, n, error in zip(b["path"], b["n"], b["error"], strict=True):
                if error is not None and not pd.isna(error):
                    held.append((p, None, None, None, None, error))
                    continue
                if opened[0] != p:
                    if opened[2] is not None:
                        opened[1].close()
                        opened[2].close()
                    f = open_file(_local_uri(p))
                    z = zipfile.ZipFile(f)
                    opened = (p, z, f, [i for i in z.infolist() if not i.is_dir()])
                for row in one(opened[1], p, opened[3][int(n)]):
                    held.append(row)
                    weight += len(row[4] or b"")
                    if weight >= part or len(held) >= PAGE:
                        yield pd.DataFrame(held, columns=columns)
                        held, weight = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns)

    dealt = listed.repartition("path", F.pmod(F.xxhash64("member"), F.lit(1 << 20))).sortWithinPartitions("path", "n")
    return dealt.mapInPandas(run, "path string, member string, part long, last boolean, content binary, error string")
