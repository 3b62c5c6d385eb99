"""Paths and file roles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
COMPRESSED_IMAGES = ("wbfs", "rvz", "wia", "ciso", "gcz", "nkit", "nfs", "cso", "zso", "nsz", "xcz")
PROTECTED_NAMES = ("gamelist.xml", "gamelist.xml.old", "gamelist.xml.bak", "_info.txt", "metadata.txt", "systeminfo.txt", "es_systems.cfg", "es_settings.cfg")
PROTECTED_EXTENSIONS = ("srm", "sav", "sa1", "eep", "fla", "mcr", "mc", "m3u", "sbi", "cfg", "cht", "ips", "ups", "bps", "ppf", "png", "jpg", "jpeg", "wbfs", "rvz", "wia", "ciso", "gcz", "nkit", "nfs")
PROTECTED_FOLDERS = ("images", "videos", "manuals", "media", "downloaded_images", "downloaded_videos", "downloaded_media", "screenshots", "marquees", "covers", "boxart", "snaps", "thumbnails", "wheel", "fanart", "titles")
COMPANIONS = ("msu", "pcm", "bml")
UNSUPPORTED = ("rar", "tar", "gz", "bz2", "xz")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def extension(path: Column) -> Column:
    """Lower-cased, empty without one; a leading full stop starts no extension."""
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def under(path: Column, root: Column) -> Column:
    """The root itself, below it, or an entry of it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/"))) | path.startswith(F.concat(root, F.lit("::")))


def os_junk(path: Column) -> Column:
    return file_name(path).startswith("._") | path.contains("__MACOSX/") | (file_name(path) == ".DS_Store")


def size_comparable(name: Column) -> Column:
    return ~F.arrays_overlap(F.split(F.lower(name), r"\."), F.array(*[F.lit(x) for x in COMPRESSED_IMAGES]))


def protected(path: Column) -> Column:
    """Files of other programs, all but those known by a companion file (see plans)."""
    ext, up = extension(path), folder(path)
    return F.lower(file_name(path)).isin(*PROTECTED_NAMES) | ext.isin(*PROTECTED_EXTENSIONS, *COMPANIONS) | ext.startswith("state") | F.lower(file_name(up)).isin(*PROTECTED_FOLDERS) | F.lower(file_name(folder(up))).isin(*PROTECTED_FOLDERS)


def unsupported_container(path: Column) -> Column:
    return extension(path).isin(*UNSUPPORTED) | extension(path).rlike("^r[0-9]{2}$")


def safe_component(name: Column) -> Column:
    return F.regexp_replace(name, "[/:]", "_")


def with_case(name: Column, policy: str, catalog: Column | None = None) -> Column:
    """``name`` with its stem upper, lower, capitalised or as the catalog spells it; the extension stays."""
    dot = F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    body = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    if policy == "catalog":
        return catalog
    return F.concat({"upper": F.upper, "lower": F.lower, "capitalised": F.initcap}[policy](body), dot)


def keep_layout_extension(actual: Column, wanted: Column) -> Column:
    """The wanted name with the actual extension, where that says how the bytes are laid out."""
    ext = extension(actual)
    return F.when((ext.isin("v64", "n64") & (extension(wanted) == "z64")) | ext.isin(*COMPRESSED_IMAGES), F.concat(stem(wanted), F.lit("."), ext)).otherwise(wanted)


def roles(path: Column, entry: Column) -> dict[str, Column]:
    ext = extension(path)
    return {"in_container": file_name(path) != entry, "is_zip": ext == "zip", "is_loose": file_name(path) == entry, "rewritable": ext == "zip"}
