"""Content types told by the first bytes of a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col

#: Bytes from the start of a file that are looked at.
HEAD = 512
EMPTY, TEXT, OTHER = "application/x-zerosize", "text/plain", "application/octet-stream"

# Offset, bytes in hexadecimal (.. for any byte), MIME type.
SIGNATURES = """
0 89504e470d0a1a0a image/png
0 ffd8ff image/jpeg
0 474946383761 image/gif
0 474946383961 image/gif
0 424d........00000000 image/bmp
0 49492a00 image/tiff
0 4d4d002a image/tiff
0 00000100 image/vnd.microsoft.icon
0 38425053 image/vnd.adobe.photoshop
0 52494646........57454250 image/webp
0 0000000c6a5020200d0a870a image/jp2
0 762f3101 image/x-exr
0 233f52414449414e4345 image/vnd.radiance
0 53445058 image/dpx
0 44445320 image/x-dds
0 67696d7020786366 image/x-xcf
0 41542654464f524d image/vnd.djvu
0 41433130 image/vnd.dwg
4 6674797061766966 image/avif
4 6674797068656963 image/heif
4 667479706d696631 image/heif
0 3c737667 image/svg+xml
0 52494646........57415645 audio/x-wav
0 464f524d........41494646 audio/x-aiff
0 664c6143 audio/flac
0 494433 audio/mpeg
0 fffb audio/mpeg
0 fff3 audio/mpeg
0 4d546864 audio/midi
0 2e736e64 audio/basic
0 2321414d52 audio/amr
0 4d414320 audio/x-ape
0 7776706b audio/x-wavpack
4 667479704d344120 audio/mp4
0 4f676753 application/ogg
0 52494646........41564920 video/x-msvideo
0 1a45dfa3 application/x-matroska
0 464c5601 video/x-flv
0 000001ba video/mpeg
0 000001b3 video/mpeg
0 3026b2758e66cf11 application/vnd.ms-asf
4 6d6f6f76 video/quicktime
4 667479707174 video/quicktime
4 66747970336770 video/3gpp
4 66747970 video/mp4
0 435753 application/vnd.adobe.flash.movie
0 465753 application/vnd.adobe.flash.movie
0 255044462d application/pdf
0 25215053 application/postscript
0 7b5c727466 application/rtf
0 d0cf11e0a1b11ae1 application/x-ole-storage
0 4954534603 application/vnd.ms-htmlhelp
30 6d696d65747970656170706c69636174696f6e2f657075622b7a6970 application/epub+zip
30 6d696d65747970656170706c69636174696f6e2f766e642e6f617369732e6f70656e646f63756d656e742e74657874 application/vnd.oasis.opendocument.text
30 6d696d65747970656170706c69636174696f6e2f766e642e6f617369732e6f70656e646f63756d656e742e7370726561647368656574 application/vnd.oasis.opendocument.spreadsheet
30 6d696d65747970656170706c69636174696f6e2f766e642e6f617369732e6f70656e646f63756d656e742e70726573656e746174696f6e application/vnd.oasis.opendocument.presentation
0 504b0304 application/zip
0 504b0506 application/zip
0 1f8b application/gzip
0 1f9d application/x-compress
0 425a68 application/x-bzip2
0 fd377a585a00 application/x-xz
0 28b52ffd application/zstd
0 04224d18 application/x-lz4
0 4c5a4950 application/x-lzip
0 377abcaf271c application/x-7z-compressed
0 526172211a07 application/vnd.rar
0 4d534346 application/vnd.ms-cab-compressed
257 7573746172 application/x-tar
0 213c617263683e application/x-archive
0 213c617263683e0a64656269616e application/vnd.debian.binary-package
0 edabeedb application/x-rpm
0 303730373031 application/x-cpio
0 78617221 application/x-xar
0 514649fb application/x-qemu-disk
0 4b444d56 application/x-vmdk-disk
0 7f454c46 application/x-executable
0 4d5a application/vnd.microsoft.portable-executable
0 cafebabe application/x-java
0 0061736d application/wasm
0 53514c69746520666f726d6174203300 application/vnd.sqlite3
0 50415231 application/vnd.apache.parquet
0 4f626a01 application/vnd.apache.avro
0 4f5243 application/vnd.apache.orc
0 4152524f5731 application/vnd.apache.arrow.file
0 894844460d0a1a0a application/x-hdf5
0 d4c3b2a1 application/vnd.tcpdump.pcap
0 a1b2c3d4 application/vnd.tcpdump.pcap
0 0a0d0d0a application/x-pcapng
0 64383a616e6e6f756e6365 application/x-bittorrent
0 774f4646 font/woff
0 774f4632 font/woff2
0 4f54544f font/otf
0 0001000000 font/ttf
0 74746366 font/collection
0 3c3f786d6c application/xml
0 3c21444f43545950452068746d6c text/html
0 3c21646f63747970652068746d6c text/html
0 3c68746d6c text/html
0 3c48544d4c text/html
0 23212f62696e2f7368 application/x-shellscript
0 23212f62696e2f62617368 application/x-shellscript
0 23212f7573722f62696e2f656e762062617368 application/x-shellscript
0 23212f7573722f62696e2f656e7620707974686f6e text/x-python
0 424547494e3a5643415244 text/vcard
0 424547494e3a5643414c454e444152 text/calendar
0 2d2d2d2d2d424547494e20504750204d455353414745 application/pgp-encrypted
"""
TABLE = [(int(a), b, c) for a, b, c in (line.split(" ") for line in SIGNATURES.strip().splitlines())]


def _pieces(offset: int, pattern: str) -> tuple[tuple[int, int], ...]:
    """(start, length) of the runs of given bytes, in the file."""
    given = [i for i in range(len(pattern) // 2) if pattern[2 * i : 2 * i + 2] != ".."]
    starts = [i for i in given if i - 1 not in given]
    return tuple((offset + s, next(n for n in range(1, len(pattern)) if s + n not in given)) for s in starts)


def signature_type(head: Column | str) -> Column:
    """MIME type of the signature that ``head`` (binary, from a file's start) shows; null without one.

    The table is looked up once for each shape that its signatures have (which bytes of a file
    they name), the shapes that name most bytes first, so that the narrower type wins.
    """
    shapes: dict[tuple, dict[str, str]] = {}
    for offset, pattern, mime in TABLE:
        shapes.setdefault(_pieces(offset, pattern), {})[pattern.replace(".", "").upper()] = mime
    head = col(head)
    found = []
    for shape in sorted(shapes, key=lambda s: (-sum(n for _, n in s), s)):
        asked = F.hex(F.concat(*(F.substring(head, start + 1, n) for start, n in shape)))
        pairs = F.create_map(*(F.lit(x) for pair in shapes[shape].items() for x in pair))
        found.append(F.element_at(pairs, asked))
    return F.coalesce(*found)


def _is_text(head: Column) -> Column:
    """UTF-8 without control characters; a character that the end of a full head cuts is let go."""
    tail = r"(?:(?:[CD][0-9A-F])|(?:E[0-9A-F](?:[89AB][0-9A-F])?)|(?:F[0-4](?:[89AB][0-9A-F]){0,2}))$"
    whole = F.when(F.octet_length(head) >= HEAD, F.unhex(F.regexp_replace(F.hex(head), tail, ""))).otherwise(head).cast("string")
    return F.is_valid_utf8(whole) & ~F.rlike(whole, F.lit(r"[\x00-\x07\x0B\x0E-\x1A\x1C-\x1F\x7F]"))


def bytes_type(head: Column | str) -> Column:
    """MIME type of a file that starts with ``head`` (its first ``HEAD`` bytes, or all it has): empty,
    of a known signature, text, or any other; null where ``head`` is null."""
    head = F.substring(col(head), 1, HEAD)
    other = F.when(_is_text(head), F.lit(TEXT)).otherwise(F.lit(OTHER))
    return F.when(F.octet_length(head) == 0, F.lit(EMPTY)).when(head.isNotNull(), F.coalesce(signature_type(head), other))
