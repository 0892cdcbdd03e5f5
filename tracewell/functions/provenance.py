"""What supports a recovered name and path, in the words of the report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name and path sources, and the sentences that explain them.
NAME_CHECKSUM = "checksum-verified"
NAME_ADJACENCY = "adjacency-only"
NAME_DIRECTORY = "deleted-directory-entry"
NAME_JOURNAL = "journal-record"
NAME_CARVED = "carved-no-metadata"
PATH_MFT = "ntfs-file-name-attribute"
PATH_UNRECOVERABLE = "not-recoverable"

NAME_TEXT = {
    NAME_CHECKSUM: "long filename bound to its 8.3 entry by the LFN checksum, which Windows and FAT32 store for exactly this purpose",
    NAME_ADJACENCY: (
        "long filename reconstructed from fragment order and adjacency only. The 8.3 entry it belonged to is deleted, so its "
        "checksum cannot be recomputed and the name cannot be verified"
    ),
    NAME_DIRECTORY: (
        "filename read from a deleted directory entry. exFAT stores a deleted file's name in one entry with no checksum, so "
        "there is nothing to verify it against"
    ),
    NAME_JOURNAL: (
        "name from a filesystem change-journal record. The journal is written by the filesystem as it happens, so this is a "
        "contemporaneous record rather than a structure that survived deletion"
    ),
    NAME_CARVED: "no filesystem metadata: the name was assigned from the recovered content's format, not recovered from the volume",
}
NAME_TEXT_BY_FILESYSTEM = {
    ("ntfs", NAME_DIRECTORY): (
        "filename read from the $FILE_NAME attribute of a deleted MFT record. NTFS keeps the full path there, so the name and "
        "the path are both filesystem metadata rather than inference"
    ),
    ("ext4", NAME_DIRECTORY): (
        "filename read from a deleted inode's directory entry. The entry names the file but records no parent, so the directory "
        "it lived in is not recoverable from the entry"
    ),
}
PATH_TEXT = {
    PATH_MFT: (
        "original path from the NTFS $FILE_NAME attribute, which the filesystem writes in full at creation and leaves in the "
        "MFT record of a deleted file"
    ),
    PATH_UNRECOVERABLE: (
        "original path is not recoverable. A deleted record in this filesystem holds the name and the first cluster but no "
        "parent, and the containing directory may itself be deleted. No path is reported rather than one assembled from "
        "whatever directories still parse"
    ),
}
FILESYSTEM_DEFAULTS = {
    "ntfs": (NAME_DIRECTORY, PATH_MFT),
    "fat32": (NAME_ADJACENCY, PATH_UNRECOVERABLE),
    "exfat": (NAME_DIRECTORY, PATH_UNRECOVERABLE),
    "ext4": (NAME_DIRECTORY, PATH_UNRECOVERABLE),
    "raw": (NAME_CARVED, PATH_UNRECOVERABLE),
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    flat: list[Column] = []
    for name, value in table.items():
        flat += [F.lit(name), F.lit(value)]
    return F.try_element_at(F.create_map(*flat), key)


def name_detail(source: Column, filesystem: Column) -> Column:
    """The sentence for a name source, more specific where the file system's mechanism differs."""
    specific = _lookup({f"{fs}|{src}": text for (fs, src), text in NAME_TEXT_BY_FILESYSTEM.items()}, F.concat_ws("|", F.lower(filesystem), source))
    empty = F.coalesce(source, F.lit("")) == ""
    return F.when(empty, F.lit(NAME_TEXT[NAME_CARVED])).otherwise(F.coalesce(specific, _lookup(NAME_TEXT, source), source))


def provenance(filesystem: Column, path: Column, name_source: Column | None = None) -> Column:
    """The provenance struct of a recovered name; only a checksum-bound name counts as verified."""
    fs = F.lower(F.coalesce(filesystem, F.lit("raw")))
    known = F.when(fs.isin(*FILESYSTEM_DEFAULTS), fs).otherwise(F.lit("raw"))
    default_name = _lookup({k: v[0] for k, v in FILESYSTEM_DEFAULTS.items()}, known)
    default_path = _lookup({k: v[1] for k, v in FILESYSTEM_DEFAULTS.items()}, known)
    source = default_name if name_source is None else F.coalesce(name_source, default_name)
    has_path = F.coalesce(path, F.lit("")) != ""
    path_source = F.when(has_path, default_path).otherwise(F.lit(PATH_UNRECOVERABLE))
    detail = name_detail(source, filesystem)
    path_detail = F.when(has_path, F.coalesce(_lookup(PATH_TEXT, path_source), path_source)).otherwise(F.lit(PATH_TEXT[PATH_UNRECOVERABLE]))
    return F.struct(
        source.alias("name_source"),
        (source == NAME_CHECKSUM).alias("name_is_verified"),
        F.nullif(F.lower(F.coalesce(filesystem, F.lit(""))), F.lit("")).alias("filesystem"),
        detail.alias("name_detail"),
        path.alias("path"),
        path_source.alias("path_source"),
        has_path.alias("path_is_recovered"),
        path_detail.alias("path_detail"),
        F.concat(detail, F.lit("; "), F.when(has_path, F.concat(F.lit("path from "), path_detail)).otherwise(path_detail)).alias("description"),
    )
