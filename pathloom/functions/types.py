"""File types by extension.  Small fixed tables, looked up inside the expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col, fold

# Extension, MIME type, description.
TYPES = """
7z application/x-7z-compressed 7-zip archive
avi video/x-msvideo AVI video
bmp image/bmp Windows BMP image
c text/x-csrc C source code
cpp text/x-c++src C++ source code
css text/css CSS stylesheet
csv text/csv CSV document
doc application/msword Word document
docx application/vnd.openxmlformats-officedocument.wordprocessingml.document Word document
flac audio/flac FLAC audio
gif image/gif GIF image
gz application/gzip Gzip archive
h text/x-chdr C header
htm text/html HTML document
html text/html HTML document
java text/x-java Java source code
jpeg image/jpeg JPEG image
jpg image/jpeg JPEG image
js text/javascript JavaScript program
json application/json JSON document
log text/x-log application log
md text/markdown Markdown document
mkv video/x-matroska Matroska video
mp3 audio/mpeg MP3 audio
mp4 video/mp4 MPEG-4 video
ogg audio/ogg Ogg audio
pdf application/pdf PDF document
png image/png PNG image
py text/x-python Python script
svg image/svg+xml SVG image
tar application/x-tar Tar archive
tmp application/x-trash Backup file
txt text/plain Plain text document
wav audio/x-wav WAV audio
xls application/vnd.ms-excel Excel spreadsheet
xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet Excel spreadsheet
xml application/xml XML document
zip application/zip Zip archive
"""
TABLE = [tuple(line.split(" ", 2)) for line in TYPES.strip().splitlines()]


def _lookup(name: Column, field: int) -> Column:
    ext = fold(F.regexp_extract(name, r"(?s)^.+[.]([^.]+)\z", 1))
    pairs = F.create_map(*(F.lit(x) for row in TABLE for x in (row[0], row[field])))
    return F.element_at(pairs, ext)


def file_type(name: Column | str, is_folder: Column | str) -> Column:
    """"Folder", a description guessed from the name, or "Unknown Type"."""
    return F.when(col(is_folder), F.lit("Folder")).otherwise(F.coalesce(_lookup(col(name), 2), F.lit("Unknown Type")))


def content_type(name: Column | str, is_folder: Column | str) -> Column:
    """MIME type guessed from the name; ``unknown`` if there is none."""
    return F.when(col(is_folder), F.lit("inode/directory")).otherwise(F.coalesce(_lookup(col(name), 1), F.lit("unknown")))
