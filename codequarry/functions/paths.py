"""Path functions as column expressions; paths use / throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions that mean binary content.
BINARY_EXTENSIONS = (
    "jpg jpeg png gif bmp webp svg ico tiff raw pdf doc docx xls xlsx ppt pptx odt ods odp zip tar gz bz2 7z rar xz "
    "exe dll so dylib bin app mp3 mp4 avi mov mkv flv wmv webm wav flac aac ttf otf woff woff2 eot swf fla psd ai sketch fig"
).split()
#: MIME types by extension; anything else is a stream of bytes.
MIME_TYPES = {
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp",
    "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "pdf": "application/pdf", "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "zip": "application/zip",
    "tar": "application/x-tar", "gz": "application/gzip", "mp3": "audio/mpeg", "mp4": "video/mp4", "avi": "video/x-msvideo",
}


def language(path: Column) -> Column:
    return F.when(F.lower(path).endswith(".py"), "py").otherwise("ts")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot, lower-cased; the whole name without one."""
    return F.lower(F.substring_index(basename(path), ".", -1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]+$", "")


def source_path(path: Column) -> Column:
    """From the first part named src; without one the last two parts."""
    parts = F.split(path, "/")
    at = F.array_position(parts, F.lit("src")).cast("int")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.array_join(F.when(at > 0, F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts))).otherwise(last), "/")


def inside(path: Column, root: Column) -> Column:
    """Whether the path is the root or below it; an empty root holds every relative path."""
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def under_source(path: Column) -> Column:
    return path.rlike(r"[\\/](src|lib)[\\/]")


def is_binary(path: Column, head: Column | None = None) -> Column:
    """By extension, or by a NUL byte among the first 4096."""
    by_name = extension(path).isin(BINARY_EXTENSIONS)
    return by_name if head is None else by_name | (F.instr(F.substring(head, 1, 4096), "\0") > 0)


def mime_type(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in MIME_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, extension(path)), F.lit("application/octet-stream"))


#: Languages of fenced code, by extension.
FENCES = ("tsx", "ts", "jsx", "js", "py")


def fence(path: Column) -> Column:
    return F.when(extension(path).isin(*FENCES), extension(path)).otherwise("text")


def python_module(rel_path: Column, import_roots: list[str]) -> Column:
    """Dotted module of a file relative to the first import root that gives one."""
    options = []
    for root in import_roots:
        root = root.strip("/")
        prefix = "" if root in ("", ".") else root + "/"
        rest = F.when(rel_path.startswith(prefix), F.substr(rel_path, F.lit(len(prefix) + 1))) if prefix else rel_path
        name = F.regexp_replace(F.regexp_replace(rest, r"\.py$", ""), r"(^|/)__init__$", "")
        options.append(F.nullif(F.replace(name, F.lit("/"), F.lit(".")), F.lit("")))
    return F.coalesce(*options)
