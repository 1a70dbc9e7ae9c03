"""How a stored text value is read: blanks dropped, upper case, no-data words missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mean "no data", compared after trimming and upper-casing.
NO_DATA = (
    "DESCONOCIDO",
    "DESCONOCIDA",
    "SIN INFORMACIÓN",
    "NO APLICA",
    "NO IDENTIFICADA",
    "NO IDENTIFICADO",
    "NO CONSIGNADO",
    "IGNORADO",
    "NO RESPONDE",
    "NO ESPECIFICADO",
    "SERVICIO NO DEFINIDO",
)

# Every character that Unicode or Python's str.strip counts as white space.
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())

MODES = ("texto", "grd")


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def read_value(c: Column | str) -> Column:
    """Trimmed, upper case; the empty text and the no-data words become null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.upper(trim_blanks(c))
    return F.when((t != "") & ~t.isin(*NO_DATA), t)


def read_grd(c: Column | str) -> Column:
    """A GRD code as read, zero-filled to six characters; longer codes stay whole."""
    t = read_value(c)
    return F.when(F.length(t) < 6, F.lpad(t, 6, "0")).otherwise(t)


def read_plain(value: str | None) -> str | None:
    """read_value for one Python string, used on the distinct values of a batch."""
    if value is None:
        return None
    t = value.strip(BLANKS).upper()
    return None if not t or t in NO_DATA else t


def clean_text(c: Column) -> Column:
    """Trim, collapse inner white space of any Unicode kind to one blank, upper case."""
    return F.upper(F.regexp_replace(trim_blanks(c), r"(?U)[\s\x1c-\x1f]+", " "))


def null_if_token(c: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.when((c != "") & ~c.isin(*NO_DATA, *extra), c)


def count_filled(cols: list[Column]) -> Column:
    """Row-wise number of non-null values over repeated columns."""
    return reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in cols), F.lit(0))


def value_mask(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\p{Nd}", "9"), r"\p{L}", "A")


def short_mask(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value_mask(c), "9+", "9"), "A+", "A")


# Fixed value: the shape of a national identity number, with or without check digit.
ID_SHAPE = r"[0-9]{1,2}\.?[0-9]{3}\.?[0-9]{3}(-[0-9kK])?"


def redact(c: Column, shown: str = "omitted") -> Column:
    """The value, or `shown` where all of it, blanks aside, has the shape of an identity number."""
    return F.when(trim_blanks(c).rlike(f"^(?:{ID_SHAPE})$"), F.lit(shown)).otherwise(c)


def fold_spanish(c: Column) -> Column:
    """Accent folding for the letters of Spanish, inside the JVM."""
    return F.translate(c, "ÁÉÍÓÚÜÑáéíóúüñ", "AEIOUUNaeiouun")


def parse_two_format_date(c: Column) -> Column:
    """YYYY-MM-DD or DD-MM-YYYY by full match; anything else, impossible days included, is null."""
    t = trim_blanks(c)
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    dmy = F.when(t.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_date(t, "dd-MM-yyyy"))
    return F.coalesce(iso, dmy)


def relayout_date(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d\d)-(\d\d)-(\d{4})$", "$3-$2-$1")


def parse_integer(c: Column, pattern: str, kind: str = "bigint") -> Column:
    t = trim_blanks(c)
    return F.when(t.rlike(f"^(?:{pattern})$"), t.try_cast(kind))


def parse_decimal_comma(c: Column) -> Column:
    """'0,5744' and ',3045' become doubles; text that is not a plain number becomes null."""
    t = F.regexp_replace(trim_blanks(c), ",", ".")
    t = F.when(t.startswith("."), F.concat(F.lit("0"), t)).otherwise(t)
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double"))


def code_category(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def spanish_number(c: Column, decimals: int) -> Column:
    """1234.5 -> 1.234,5"""
    return F.translate(F.format_number(c, decimals), ",.", ".,")
