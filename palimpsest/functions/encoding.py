"""Which file contents are texts: signatures by extension, byte order marks, UTF-8 validity; expressions over binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are searched for byte order marks.
HEAD_BYTES = 8192
MARKS = ("EFBBBF", "FEFF", "FFFE")

_ELF, _PE, _ZIP, _OGG, _MP4, _MKV, _OLE, _JPG, _TIF = "7F454C46", "4D5A", "504B0304", "4F676753", "66747970", "1A45DFA3", "D0CF11E0A1B11AE1", "FFD8FF", ("49492A00", "4D4D002A")

#: Extension to (offset, signature in hex), any of which marks the type.
SIGNATURES: dict[str, list[tuple[int, str]]] = {
    "png": [(0, "89504E470D0A1A0A")], "gif": [(0, "474946383761"), (0, "474946383961")], "bmp": [(0, "424D")], "ico": [(0, "00000100")],
    "webp": [(0, "52494646"), (8, "57454250")], "wav": [(0, "52494646"), (8, "57415645")], "avi": [(0, "52494646"), (8, "41564920")],
    "zip": [(0, _ZIP), (0, "504B0506"), (0, "504B0708")], "gz": [(0, "1F8B")], "bz2": [(0, "425A68")], "7z": [(0, "377ABCAF271C")],
    "rar": [(0, "526172211A0700"), (0, "526172211A070100")], "xz": [(0, "FD377A585A00")], "mp3": [(0, "494433"), (0, "FFFB"), (0, "FFF3"), (0, "FFF2")],
    "pdf": [(0, "25504446")], "ps": [(0, "25215053")], "rtf": [(0, "7B5C727466")], "class": [(0, "CAFEBABE")], "wasm": [(0, "0061736D")],
    **dict.fromkeys(("jpg", "jpeg"), [(0, _JPG)]), **dict.fromkeys(("tif", "tiff"), [(0, x) for x in _TIF]), **dict.fromkeys(("elf", "so", "o"), [(0, _ELF)]),
    **dict.fromkeys(("exe", "dll", "sys"), [(0, _PE)]), **dict.fromkeys(("jar", "apk", "docx", "xlsx", "pptx"), [(0, _ZIP)]), **dict.fromkeys(("ogg", "opus", "ogv"), [(0, _OGG)]),
    **dict.fromkeys(("mp4", "mov", "3gp", "3g2", "m4a"), [(4, _MP4)]), **dict.fromkeys(("mkv", "webm"), [(0, _MKV)]), **dict.fromkeys(("doc", "xls", "ppt"), [(0, _OLE)]),
}


def extension(path: Column) -> Column:
    """What follows the last dot of the file name; '' if there is none."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def has_signature(content: Column, ext: Column) -> Column:
    """Whether a binary column has, at its place, a signature that belongs to the extension."""
    out = F.lit(False)
    for name, marks in SIGNATURES.items():
        for at, mark in marks:
            out = out | ((ext == name) & (F.hex(F.substring(content, at + 1, len(mark) // 2)) == mark))
    return F.coalesce(out, F.lit(False))


def has_mark(content: Column) -> Column:
    """Whether the first HEAD_BYTES hold a byte order mark anywhere."""
    pairs = F.hex(F.substring(content, 1, HEAD_BYTES))
    return pairs.rlike("^(?:..)*?(?:" + "|".join(MARKS) + ")")


def looks_like_text(content: Column, ext: Column) -> Column:
    """The first test of the indexer: a known signature, or no byte order mark in the head."""
    return has_signature(content, ext) | ~has_mark(content)


def is_text(content: Column, path: Column) -> Column:
    """What is indexed: it passes the first test and is valid UTF-8."""
    return looks_like_text(content, extension(path)) & F.is_valid_utf8(content.cast("string"))


def split_texts(files: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(texts, ignored paths) of rows (path, commit_index, content as binary).

    A path is ignored for good once one of its versions is no valid UTF-8; with strict such a
    version is an error at run time. What fails the first test is left out at that version only.
    Deletions (null content) and rows without a path stay as they are.
    """
    first = files.where(F.col("content").isNull() | looks_like_text(F.col("content"), extension(F.col("path"))))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    if strict:
        checked = first.withColumn("content", F.when(F.col("content").isNull(), F.lit(None)).otherwise(F.validate_utf8(F.col("content").cast("string"))))
        return checked, files.select("path").where(F.lit(False))
    ignored = first.where(F.col("content").isNotNull() & ~valid).select("path").distinct()
    return first.join(ignored, "path", "left_anti").select(*files.columns).withColumn("content", F.col("content").cast("string")), ignored
