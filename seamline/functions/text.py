"""Names, codes and label tokens as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from seamline import schema as S

# --- fixed values: name patterns --------------------------------------------------------------
SLUG_OTHER = r"[^a-z0-9áéíóúñ]+"
INTEGER_TOKEN = r"^[+-]?[0-9]+$"
FLOAT_TOKEN = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|nan|inf|infinity)$"
# --- end of fixed values ----------------------------------------------------------------------


def slug(name: Column) -> Column:
    """Lower-case identifier; runs of other characters become one underscore."""
    body = F.regexp_replace(F.lower(strip(name)), SLUG_OTHER, "_")
    return F.coalesce(F.nullif(F.regexp_replace(body, "^_+|_+$", ""), F.lit("")), F.lit(S.DEFAULT_SLUG))


#: Small Latin letters that are another letter with a mark, and those letters, in the same order.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.decomposition(chr(c))[:1].isdigit()]
_PLAIN = [unicodedata.normalize("NFD", c)[0] for c in _MARKED]


def folded(value: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(value), "".join(_MARKED), "".join(_PLAIN))


def folded_text(text: str) -> str:
    return text.lower().translate(str.maketrans("".join(_MARKED), "".join(_PLAIN)))


def strip(value: Column) -> Column:
    """Remove leading and trailing white space of every kind, line ends included."""
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def inspection_code(captured_at: Column, capture_key: Column) -> Column:
    """``INS-HHmmss-XXXX``; the suffix is a hash of the capture key, so a retry repeats it."""
    suffix = F.upper(F.substring(F.md5(capture_key.cast("string")), 1, 4))
    return F.concat(F.lit("INS-"), F.date_format(captured_at, "HHmmss"), F.lit("-"), suffix)


def capture_name(garment: Column, defect: Column, at: Column, suffix: Column) -> Column:
    """Dataset capture file name ``garment_defect_yyyyMMdd_HHmmss_suffix.jpg``."""
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    return F.concat(F.concat_ws("_", garment, defect, stamp, suffix), F.lit(".jpg"))


def station_image_path(at: Column, capture_key: Column) -> Column:
    """Relative path under which a station frame is stored."""
    suffix = F.upper(F.substring(F.md5(capture_key.cast("string")), 1, 6))
    stamp = F.date_format(at, "yyyyMMdd_HHmmss")
    return F.concat(F.lit("captures/inspection_"), stamp, F.lit("_"), suffix, F.lit(".jpg"))


def capture_name_pattern(garments=None, defects=None) -> str:
    """Pattern whose groups are garment, defect, day, time and suffix of a capture file name."""
    garment = "|".join(garments or S.CAPTURE_GARMENTS)
    defect = "|".join(defects or S.CAPTURE_DEFECTS)
    return rf"^({garment})_({defect})_([0-9]{{8}})_([0-9]{{6}})_([0-9A-Za-z]+)\.jpg$"


def parse_capture_name(name: Column, garments=None, defects=None) -> Column:
    """Struct of the parts of a capture file name; all null when the name does not follow it."""
    pattern = capture_name_pattern(garments, defects)

    def part(group: int) -> Column:
        return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))

    stamp = F.concat(part(3), part(4))
    return F.struct(
        part(1).alias("garment"),
        part(2).alias("defect"),
        F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("captured_at"),
        part(5).alias("suffix"),
    )


def label_int(token: Column) -> Column:
    """Strict integer: null where the token is not plainly one."""
    return F.when(token.rlike(INTEGER_TOKEN), token.try_cast("long"))


def label_float(token: Column) -> Column:
    """Strict float: ``nan`` and ``inf`` are numbers, type suffixes and digit separators are not."""
    return F.when(token.rlike(FLOAT_TOKEN), token.try_cast("double"))


def display_code(code: Column) -> Column:
    return F.replace(code, F.lit("INS-"), F.lit(""))


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def path_split(path: Column) -> Column:
    """``train`` / ``val`` / ``test`` folder the file lies in, directly or deeper."""
    return F.nullif(F.regexp_extract(path, rf"/({'|'.join(S.SPLITS)})/", 1), F.lit(""))


def prepared_target(relative: Column) -> Column:
    """Relative path of a prepared image: the same place, with a ``.png`` suffix."""
    return F.regexp_replace(relative, r"\.[^./]*$", ".png")
