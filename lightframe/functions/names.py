"""Paths, extensions, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions, screenshot names, marks of copies, illegal and reserved file names.
VIDEO = ("mov", "mp4", "m4v", "avi", "mkv", "webm", "3gp", "3g2", "mts", "m2ts", "mpg", "mpeg", "wmv", "flv")
RAW = ("cr2", "cr3", "crw", "nef", "nrw", "arw", "srf", "sr2", "dng", "raf", "orf", "rw2", "pef", "srw", "3fr", "iiq", "erf", "kdc", "mrw", "x3f")
PHOTO = ("jpg", "jpeg", "jpe", "png", "webp", "gif", "tif", "tiff", "avif", "heic", "heif", "hif", "bmp", "jxl", *RAW)
ORIGINAL = ("heic", "heif", "cr2", "cr3", "nef", "arw", "dng", "raf", "orf", "rw2", "jpg", "jpeg", "mov", "mp4")
SCREENSHOT = "(?i)(screen ?shot|capture d.[ée]cran|capture_d_ecran|bildschirmfoto|captura de pantalla|schermafbeelding|スクリーンショット)"
COPY_DIR = "(?i)(copie|copy|copies|duplicate|doublon|whatsapp|download|t[ée]l[ée]chargement|export|backup|sauvegarde|received|re[çc]u)"
COPY_NAME = r"(?i)(\(\d+\)|[-_ ]copy|[-_ ]copie|^copie de |~\d+|-\d{1,2}$)"
ILLEGAL = r'[<>:"/\\|?*\u0000-\u001f]'
RESERVED = r"(?i)^(con|prn|aux|nul|com\d|lpt\d)$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ext(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def stem(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def rel_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def kind(extension: Column) -> Column:
    return F.when(extension.isin(*VIDEO), "video").when(extension.isin(*PHOTO), "photo")


def is_screenshot(name: Column, extension: Column, has_camera: Column, comment: Column) -> Column:
    return F.coalesce(comment.rlike("(?i)screenshot"), F.lit(False)) | name.rlike(SCREENSHOT) | ((extension == "png") & ~has_camera & name.rlike(r"(?i)^(IMG_\d+|Screenshot)"))


def looks_like_copy(folder: Column, name: Column) -> tuple[Column, Column]:
    return folder.rlike(COPY_DIR), F.regexp_replace(name, r"\.[^.]+$", "").rlike(COPY_NAME)


def sanitize(name: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, ILLEGAL, "_"), r"[. ]+$", ""))
    return F.substring(F.when((clean == "") | clean.rlike(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean), 1, 180)


def camera(make: Column, model: Column, absent: str = "camera") -> Column:
    """Make and model, without the make's name in the model."""
    rest = F.nullif(F.trim(F.replace(model, F.coalesce(make, F.lit("\u0000")), F.lit(""))), F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(make, F.lit("")), rest), F.lit("")), F.lit(absent))


def from_pattern(pattern: str, *, stem: Column, taken_at: Column, offset: Column, index: Column, camera: Column) -> Column:
    """A file name with {name} {date} {time} {year} {month} {day} {n} {camera} in the capture zone."""
    wall = F.timestamp_millis(F.unix_millis(taken_at) + F.coalesce(offset, F.lit(0)) * 60_000)
    out = F.lit(pattern)
    for key, value in (("name", stem), ("date", F.date_format(wall, "yyyy-MM-dd")), ("time", F.date_format(wall, "HH.mm.ss")), ("year", F.date_format(wall, "yyyy")), ("month", F.date_format(wall, "MM")), ("day", F.date_format(wall, "dd")), ("n", F.lpad(index.cast("string"), F.greatest(F.lit(4), F.length(index.cast("string"))), F.lit("0"))), ("camera", camera)):
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return sanitize(out)


def byte_label(n: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB", "TB")) -> Column:
    """One decimal, steps of 1024; a zero decimal is not shown."""
    i = F.coalesce(*(F.when(n < 1024.0 ** (k + 1), F.lit(k)) for k in range(len(units) - 1)), F.lit(len(units) - 1))
    tenths = F.floor(n / F.pow(F.lit(1024.0), i.cast("double")) * 10 + 0.5)
    text = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
    return F.concat(text, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), i + 1))


def dms(degrees: Column) -> Column:
    """Degrees as d/1 m/1 s/10000 rationals."""
    a = F.abs(degrees)
    d = F.floor(a)
    m = F.floor((a - d) * 60)
    s = F.floor(((a - d) * 60 - m) * 60 * 10000 + 0.5)
    return F.concat(d.cast("string"), F.lit("/1 "), m.cast("string"), F.lit("/1 "), s.cast("string"), F.lit("/10000"))
