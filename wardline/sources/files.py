"""Uploaded files: kinds, magic bytes, hashes, zip members, RTF text."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an archive.
MAX_MEMBERS, MAX_MEMBER, MAX_TOTAL, MAX_RATIO = 100_000, 4 << 30, 50 << 30, 100


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, kind, magic_ok, file_hash, content) of all files under ``path``."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return b.select("path", F.col("length").alias("size"), kind(F.col("path"), F.col("content")).alias("kind"), magic_ok(F.col("path"), F.col("content")).alias("magic_ok"), F.sha2("content", 256).alias("file_hash"), "content")


def kind(path: Column, content: Column) -> Column:
    """File type by extension; XML is CDA only if its first 500 characters say so."""
    p = F.lower(path)
    head = F.try_to_binary(F.lit("")) if content is None else F.substring(content, 1, 500)
    return (
        F.when(p.endswith(".zip"), "zip")
        .when(p.endswith(".json"), "fhir_r4")
        .when(p.endswith(".tsv"), "epic_ehi")
        .when(p.endswith(".xml") & F.decode(head, "ISO-8859-1").contains("ClinicalDocument"), "cda_r2")
        .when(p.endswith(".pdf"), "pdf")
        .when(p.endswith(".rtf"), "rtf")
        .when(p.rlike(r"\.tiff?$"), "tiff")
        .otherwise("unknown")
    )


def magic_ok(path: Column, content: Column) -> Column:
    """Whether a document starts as its extension promises; other files pass."""
    p, head = F.lower(path), F.hex(F.substring(content, 1, 5))
    return F.when(p.endswith(".pdf"), head.startswith("25504446")).when(p.endswith(".rtf"), head == "7B5C727466").when(p.rlike(r"\.tiff?$"), head.startswith("49492A00") | head.startswith("4D4D002A")).otherwise(True)


def unsafe(name: str) -> bool:
    """A member name that would leave the target folder."""
    return name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name) or bool(re.match(r"^[A-Za-z]:", name))


def expand_zips(files: DataFrame, max_members: int = MAX_MEMBERS, max_member: int = MAX_MEMBER, max_total: int = MAX_TOTAL, max_ratio: int = MAX_RATIO) -> DataFrame:
    """Members of zip files (path, member, content, error): one archive per row in, limits checked on declared and on read bytes."""

    def one(path: str, content: bytes):
        try:
            z = zipfile.ZipFile(io.BytesIO(content))
            infos = [i for i in z.infolist() if not i.is_dir()]
            if len(infos) > max_members or sum(i.file_size for i in infos) > max_total:
                raise ValueError("archive is too large")
            for i in infos:
                if unsafe(i.filename):
                    raise ValueError(f"unsafe name {i.filename}")
                if i.file_size > max_member or i.file_size > max_ratio * max(i.compress_size, 1):
                    raise ValueError(f"member is too large: {i.filename}")
            total = 0
            for i in infos:
                with z.open(i) as f:
                    data = f.read(min(max_member, i.file_size) + 1)
                total += len(data)
                if len(data) > i.file_size or total > max_total:
                    raise ValueError(f"member is larger than declared: {i.filename}")
                yield path, i.filename, data, None
        except (zipfile.BadZipFile, ValueError, OSError) as e:
            yield path, None, None, str(e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b.path, b.content, strict=True):
                for row in one(p, c):  # one member at a time
                    yield pd.DataFrame([row], columns=["path", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, member string, content binary, error string")


def routed(members: DataFrame) -> DataFrame:
    """Members with the reader that takes them; manifests make an archive XDM, schemas and read-me files are skipped."""
    name = F.lower("member")
    skip = name.contains("schema") | name.contains("readme")
    how = F.when(skip, "skip").when(name.endswith("metadata.xml"), "xdm").when(name.endswith(".tsv"), "epic_ehi").when(name.endswith(".json"), "fhir_r4").when(name.endswith(".xml"), "cda_r2").when(name.rlike(r"\.(pdf|rtf|tiff?)$"), "unstructured").otherwise("skip")
    return members.withColumn("route", how)


def rtf_text(rtf: str) -> str:
    """Plain text of an RTF document: groups of tables and pictures go, controls become what they stand for."""
    rtf = re.sub(r"\{\\\*?\\?(fonttbl|colortbl|stylesheet|info|pict|generator)[^{}]*(\{[^{}]*\}[^{}]*)*\}", "", rtf)
    rtf = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), rtf)
    rtf = re.sub(r"\\u(-?\d+)\??", lambda m: chr(int(m[1]) % 65536), rtf)
    rtf = re.sub(r"\\(par|line)\b ?", "\n", rtf)
    rtf = re.sub(r"\\tab\b ?", "\t", rtf)
    rtf = re.sub(r"\\[a-zA-Z]+-?\d* ?", "", rtf)
    return re.sub(r"[{}]", "", rtf).strip()
