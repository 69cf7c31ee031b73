"""The nine default searches, and tagging entries with many searches in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import Flags, Macros, everything, ext, files_only, folders_only, two_valued

# Extensions of the default searches; each also counts in capitals.
APPLICATIONS = "desktop"
ARCHIVES = "7z ace arj bz2 cab gz gzip jar rar tar tgz z zip"  # and r00 to r29
AUDIO = "aac ac3 aif aifc aiff au cda dts fla flac it m1a m2a m3u m4a mid midi mka mod mp2 mp3 mpa ogg opus ra rmi spc snd umx voc wav wma xm"
DOCUMENTS = "c chm cpp csv cxx doc docm docx dot dotm dotx h hpp htm html hxx ini java lua mht mhtml ods odt odp pdf potx potm ppam ppsm ppsx pps ppt pptm pptx rtf sldm sldx thmx txt vsd vsdx wpd wps wri xlam xls xlsb xlsm xlsx xltm xltx xml"
PICTURES = "ani bmp gif ico jpe jpeg jpg pcx png psd tga tif tiff webp svg avif nef dds exr hdr wmf"
VIDEOS = "3g2 3gp 3gp2 3gpp amr amv asf avi bdmv bik d2v divx drc dsa dsm dss dsv evo f4v flc fli flic flv hdmov ifo ivf m1v m2p m2t m2ts m2v m4b m4p m4v mkv mp2v mp4 mp4v mpe mpeg mpg mpls mpv2 mpv4 mov mts ogm ogv pss pva qt ram ratdvd rm rmm rmvb roq rpm smil smk swf tp tpr ts vob vp6 webm wm wmp wmv"


def _both(words: str, *more: str) -> list[str]:
    items = [*words.split(), *more]
    return [*items, *(w.upper() for w in items if w.upper() != w)]


EXTENSIONS = {
    "app": _both(APPLICATIONS),
    "archive": _both(ARCHIVES, *(f"r{i:02d}" for i in range(30))),
    "audio": _both(AUDIO),
    "doc": _both(DOCUMENTS),
    "pic": [*_both(PICTURES), ""],  # the list ends with an empty item: files without extension
    "video": _both(VIDEOS),
}
NAMES = {"app": "Applications", "archive": "Archives", "audio": "Audio", "doc": "Documents", "pic": "Pictures", "video": "Videos"}


def macros() -> Macros:
    """The default searches that have a macro; they match case whatever surrounds them."""
    return Macros({k: (lambda _, flags, items=items: ext(*items, flags=flags.but(case=True))) for k, items in EXTENSIONS.items()})


def default_filters() -> dict[str, Column]:
    """Name -> predicate, in the order shown."""
    m = macros()
    return {"All": everything(), "Folders": folders_only(), "Files": files_only()} | {NAMES[k]: m.macro(k, Flags()) for k in EXTENSIONS}


def tag(entries: DataFrame, searches: dict[str, Column], name: str = "search") -> DataFrame:
    """One row per entry and search that it meets: a single scan evaluates all searches."""
    hits = F.array(*(F.when(two_valued(p), F.lit(n)) for n, p in searches.items()))
    return entries.withColumn(name, F.explode(F.filter(hits, lambda x: x.isNotNull())))
