"""Book archives and bytes: unpacking with limits, packages, encodings, and writing archives and reports."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import tokens as M


@dataclass(frozen=True)
class Limits:
    """What an archive may hold."""

    entries: int = 100_000
    entry_bytes: int = 2 << 30
    total_bytes: int = 8 << 30
    ratio: int = 200


ENTRIES = "source string, bookpath string, size long, bytes binary, issue string"


def unsafe(path: str) -> bool:
    clean = posixpath.normpath(path.replace("\\", "/"))
    return path.startswith(("/", "\\")) or ":" in path.split("/")[0] or clean == ".." or clean.startswith("../") or "\0" in path


def scan_archives(spark: SparkSession, glob: str, limits: Limits | None = None) -> DataFrame:
    """One row for each entry of each archive (source, bookpath, size, bytes, issue); entries are read one at a time.

    Unsafe paths and entries beyond a limit have an issue and no bytes; what is no archive is one row with an issue.
    """
    return unpacked(spark.read.format("binaryFile").load(glob).select("path", "content"), limits)


def unpacked(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The entries of archives given as rows (path, content); an entry beyond a limit is a row with an issue, and so is each one after it."""
    limits = limits or Limits()

    def run(frames: Iterator):
        import pandas as pd

        def entries(source, content):
            try:
                archive = zipfile.ZipFile(io.BytesIO(content))
            except zipfile.BadZipFile:
                yield source, None, None, None, "not an archive"
                return
            total = 0
            for n, info in enumerate(x for x in archive.infolist() if not x.is_dir()):
                total += info.file_size
                issue = (
                    "too many entries" if n >= limits.entries else "unsafe path" if unsafe(info.filename) else "entry too large" if info.file_size > limits.entry_bytes
                    else "archive too large" if total > limits.total_bytes else "ratio" if info.file_size > limits.ratio * max(info.compress_size, 1) else None
                )
                yield source, info.filename, info.file_size, None if issue else archive.read(info), issue

        def table(rows):
            return pd.DataFrame(rows, columns=["source", "bookpath", "size", "bytes", "issue"])

        for frame in frames:
            for source, content in zip(frame["path"], frame["content"], strict=True):
                rows, held = [], 0
                for row in entries(source, content):
                    rows.append(row)
                    held += len(row[3] or b"")
                    if len(rows) == 1000 or held > 4 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return files.mapInPandas(run, ENTRIES)


def decode_bytes(c: Column | str) -> tuple[Column, Column]:
    """(text, encoding) of bytes: by byte order mark, zero bytes, declared charset, validity as UTF-8; line ends are made one sign."""
    b = T.col(c)
    head = F.hex(F.substring(b, 1, 4))
    ascii_head = F.decode(F.substring(b, 1, 1024), "ISO-8859-1")
    declared = F.upper(F.regexp_extract(ascii_head, r"""(?i)(?:charset|encoding)\s*=\s*["']?([-\w]+)""", 1))
    encoding = (
        F.when(F.startswith(head, F.lit("EFBBBF")), "UTF-8").when(F.startswith(head, F.lit("FEFF")), "UTF-16BE").when(F.startswith(head, F.lit("FFFE")), "UTF-16LE")
        .when(head.rlike("^00[0-9A-F]{2}00"), "UTF-16BE").when(head.rlike("^[0-9A-F]{2}00[0-9A-F]{2}00"), "UTF-16LE")
        .when(declared.isin("ISO-8859-1", "LATIN1", "WINDOWS-1252", "US-ASCII"), "ISO-8859-1").when(F.is_valid_utf8(b.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    )
    text = F.when(encoding == "UTF-16BE", F.decode(b, "UTF-16BE")).when(encoding == "UTF-16LE", F.decode(b, "UTF-16LE")).when(encoding == "UTF-8", b.cast("string")).otherwise(F.decode(b, "ISO-8859-1"))
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n"), encoding


def package_files(files: DataFrame) -> DataFrame:
    """book_id, bookpath, text of the package file of each book (book_id, bookpath, text): the first that its container names, else the first .opf by path."""
    container = files.where("bookpath = 'META-INF/container.xml'").select("book_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<(?:\w+:)?rootfile\b[^<>]*>"), F.lit(0))).alias("tok"))
    a = M.attributes("tok")
    named = container.where(F.coalesce(F.try_element_at(a, F.lit("media-type")), F.lit("application/oebps-package+xml")) == "application/oebps-package+xml")
    first = named.groupBy("book_id").agg(F.first(T.url_decode(F.try_element_at(a, F.lit("full-path"))), ignorenulls=True).alias("bookpath")).join(files.select("book_id", "bookpath"), ["book_id", "bookpath"], "left_semi")
    other = files.where(F.endswith(F.lower("bookpath"), F.lit(".opf"))).join(first.select("book_id"), "book_id", "left_anti").groupBy("book_id").agg(F.min("bookpath").alias("bookpath"))
    return first.unionByName(other).join(files.select("book_id", "bookpath", "text"), ["book_id", "bookpath"])


def with_modified(package: Column | str, when: Column | str) -> Column:
    """A package text with its modification date (dcterms:modified) set, or put in before the end of the metadata; one without metadata stays."""
    told = F.date_format(F.col(when) if isinstance(when, str) else when, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rx = r"""(?is)(<meta\b[^<>]*\bproperty\s*=\s*["']dcterms:modified["'][^<>]*>)[^<]*"""
    c = T.col(package)
    return F.when(c.rlike(rx), F.regexp_replace(c, rx, F.concat(F.lit("$1"), told))).otherwise(F.regexp_replace(c, r"(?i)(</(?:\w+:)?metadata\s*>)", F.concat(F.lit('<meta property="dcterms:modified">'), told, F.lit("</meta>$1"))))


def package_tables(resources: DataFrame) -> dict[str, DataFrame]:
    """metadata, manifest, spine, guide, bindings of package files (book_id, bookpath, text): from their tags, in order."""
    toks = M.tokens(resources.select("book_id", "text"), "book_id", "text", positions=False).withColumn("a", M.attributes("tok"))
    own = lambda k: F.try_element_at("a", F.lit(k))
    tags = toks.where("ttype in ('begin', 'single')")
    folder = resources.select(F.col("book_id").alias("doc"), F.col("bookpath").alias("package"))
    manifest = tags.where("tname = 'item'").join(folder, "doc").select(F.col("doc").alias("book_id"), F.col("seq").alias("pos"), own("id").alias("id"), own("href").alias("href"), T.resolve("package", own("href")).alias("bookpath"), own("media-type").alias("media_type"), own("properties").alias("properties"))
    spine = tags.where("tname = 'itemref'").select(F.col("doc").alias("book_id"), F.col("seq").alias("pos"), own("idref").alias("idref"), F.coalesce(own("linear"), F.lit("yes")).alias("linear"))
    guide = tags.where("tname = 'reference'").select(F.col("doc").alias("book_id"), own("type").alias("type"), own("title").alias("title"), own("href").alias("href"))
    bindings = tags.where("tname = 'mediatype'").select(F.col("doc").alias("book_id"), F.col("seq").alias("pos"), own("media-type").alias("media_type"), own("handler").alias("handler"))
    texts = toks.where("ttype = 'text'").select("doc", (F.col("seq") - 1).alias("seq"), F.col("tok").alias("content"))
    metadata = tags.where("tname like 'dc:%' or tname = 'meta'").select("doc", "seq", "tname", "a").join(texts, ["doc", "seq"], "left")
    metadata = metadata.select(F.col("doc").alias("book_id"), F.col("seq").alias("pos"), F.coalesce(own("name"), own("property"), "tname").alias("name"), F.coalesce(own("content"), "content").alias("content"), F.col("a").alias("attrs"))
    return {"metadata": metadata, "manifest": manifest, "spine": spine, "guide": guide, "bindings": bindings}


def manifest_audit(resources: DataFrame, manifest: DataFrame) -> DataFrame:
    """(book_id, bookpath, issue): files not listed, items without a file, repeated paths and ids."""
    key = ["book_id", "bookpath"]
    parts = [
        resources.join(manifest, key, "left_anti").select(*key, F.lit("not listed").alias("issue")),
        manifest.join(resources, key, "left_anti").select(*key, F.lit("no file").alias("issue")),
        manifest.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated path").alias("issue")),
        manifest.groupBy("book_id", F.col("id").alias("bookpath")).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated id").alias("issue")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def manifest_spine(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    return spine.select("book_id", "pos", F.col("idref").alias("id"), "linear").join(manifest.drop("pos"), ["book_id", "id"], "left")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_archives(resources: DataFrame, rows: int = 10_000, size: int = 64 << 20) -> DataFrame:
    """(book_id, volume, bytes): archives of books (book_id, bookpath, bytes), mimetype first and stored, the rest deflated.

    A book of up to ``rows`` entries and ``size`` bytes is one archive, volume 0. A larger one is dealt by a hash of the paths
    into volumes of about that size, so that no task or cell holds a whole large book; its mimetype is in volume 0.
    """
    import pandas as pd

    def run(frame):
        out = io.BytesIO()
        entries = sorted(zip(frame["bookpath"], frame["bytes"], strict=True), key=lambda x: (x[0] != "mimetype", x[0]))
        with zipfile.ZipFile(out, "w") as z:
            for name, data in entries:
                info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
                z.writestr(info, bytes(data), zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"book_id": [frame["book_id"].iloc[0]], "volume": [frame["volume"].iloc[0]], "bytes": [out.getvalue()]})

    entries = resources.select("book_id", "bookpath", "bytes")
    volumes = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum(F.octet_length("bytes")) / size))
    large = entries.groupBy(F.col("book_id").alias("_book")).agg(volumes.alias("_n")).where("_n > 1")  # one row for each volume at most
    dealt = entries.join(F.broadcast(large), F.col("book_id").eqNullSafe(F.col("_book")), "left")
    volume = F.when((F.col("bookpath") == "mimetype") | F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64("bookpath"), F.col("_n")))
    return dealt.select("book_id", volume.cast("long").alias("volume"), "bookpath", "bytes").groupBy("book_id", "volume").applyInPandas(run, "book_id string, volume long, bytes binary")


def font_kind(c: Column | str) -> Column:
    """Container of a font by its first bytes."""
    head = F.hex(F.substring(T.col(c), 1, 4))
    return F.when(head.isin("00010000", "74727565", "74797031"), "truetype").when(head == "4F54544F", "opentype").when(head == "774F4646", "woff").when(head == "774F4632", "woff2").when(head == "74746366", "collection").otherwise("unknown")


def font_embedding_bits(c: Column | str) -> Column:
    """fsType of a font's OS/2 table, found by the table directory at its start; null if there is none."""
    h = F.hex(T.col(c))
    n = F.conv(F.substring(h, 9, 4), 16, 10).cast("int")
    directory = F.substring(h, F.lit(25), n * 32)
    offset = F.conv(F.regexp_extract(directory, "^(?:[0-9A-F]{32})*?4F532F32[0-9A-F]{8}([0-9A-F]{8})", 1), 16, 10).cast("int")
    bits = F.substring(h, offset * 2 + 17, F.lit(4))
    return F.when(F.length(bits) == 4, F.conv(bits, 16, 10).cast("int"))


def font_license(bits: Column | str) -> Column:
    """Licence class by the embedding bits."""
    b = T.col(bits)
    embedding = b.bitwiseAND(0x000E)
    known = (b.bitwiseAND(~0x030E & 0xFFFF) == 0) & embedding.isin(0, 2, 4, 8)
    return (
        F.when(b.isNull() | ~known, "invalid-or-missing").when(b.bitwiseAND(0x0100) != 0, "no-subsetting").when(b.bitwiseAND(0x0200) != 0, "bitmap-only").when(embedding == 2, "restricted")
        .when(embedding == 4, "preview-and-print").when(embedding == 8, "editable").otherwise("installable")
    )


def image_size(c: Column | str) -> tuple[Column, Column]:
    """Width and height from the header of a PNG or GIF; null otherwise."""
    h = F.hex(F.substring(T.col(c), 1, 24))
    number = lambda s, n: F.conv(F.substring(h, s, n), 16, 10).cast("long")
    swapped = lambda s: F.conv(F.concat(F.substring(h, s + 2, 2), F.substring(h, s, 2)), 16, 10).cast("long")
    png, gif = F.startswith(h, F.lit("89504E470D0A1A0A")), F.startswith(h, F.lit("474946"))
    return F.when(png, number(33, 8)).when(gif, swapped(13)), F.when(png, number(41, 8)).when(gif, swapped(17))
