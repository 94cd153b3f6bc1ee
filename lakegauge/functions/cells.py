"""Cell-level expressions: missing values, text forms, parsing. All Column -> Column."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from lakegauge import constants as C

# Blanks as Python's strip() sees them, inside a character class; and one cell padded by them.
_WS = r"\s\x1c-\x1f"
_PADDED = rf"(?dU)\A[{_WS}]*+(?:%s)[{_WS}]*+\z"
_NOT_BLANK = rf"(?U)[^{_WS}]"
# What Python's float() accepts, once trimmed (words in any case).
_FLOAT = r"[+-]?(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?"
_FLOAT_WORD = r"[+-]?(?i:infinity|inf|nan)"
# Cheap tests that nearly all prose fails within a few characters. A pt-BR number
# opens with signs and a digit, or spells a float word with marks strewn in.
_MAYBE_NUMBER = rf"^[{_WS}.,%+\-]*+(?:\d[{_WS}\d.,%+\-_eE]*+$|(?i:i[.,%]*n[.,%]*f|n[.,%]*a[.,%]*n))"
_MAYBE_DATE = rf"^[{_WS}]*+\d[\dTZ:/.+{_WS}-]*+(?:[A-Za-z]{{3,9}}\.?,?[ -][\dTZ:.+{_WS}-]*+)?$"
_TIME = r"(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)? ?(Z|[+-]\d{2}:?\d{2})?)?$"
# One pattern for all shapes, so that a text is matched once: year first (groups 1 to 9), year last (10 to 18), eight digits
# (19 to 21), month by name (22 to 29). A group that took no part is replaced by nothing.
_ANY_DATE = (r"^(?:(\d{4})([-/])(\d{1,2})\2(\d{1,2})" + _TIME + r"|(\d{1,2})([-/.])(\d{1,2})\11(\d{4})" + _TIME
             + r"|(\d{4})(\d{2})(\d{2})$" + r"|(\d{1,2})[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})" + _TIME + ")")
_ANY_PARTS = "$1$13$19$24|$3$10$20$23|$4$12$21$22|$5$14$25|$6$15$26|$7$16$27|$8$17$28|$9$18$29|$11"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often the body names it.

    Optimizer rules copy an expression to every place that names it, so that a chain
    of comparisons over a long formula grows with each step. Meant for small result
    tables: an operator that holds such a body runs outside whole-stage code.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def kind_of(data_type: T.DataType) -> str:
    """numeric, temporal, text or nested; booleans count as numeric."""
    if isinstance(data_type, (T.NumericType, T.BooleanType)):
        return "numeric"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType, T.BinaryType)):
        return "text"
    return "nested"


def is_fractional(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def present(c: Column, data_type: T.DataType) -> Column:
    """The value, with NaN turned into null (both count as missing)."""
    return F.when(~F.isnan(c), c) if is_fractional(data_type) else c


def is_missing(c: Column, data_type: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if is_fractional(data_type) else c.isNull()


def strip(c: Column) -> Column:
    """Trim every Unicode blank, not only spaces."""
    return F.btrim(c, F.lit(C.WHITESPACE))


def not_blank(c: Column) -> Column:
    """Whether anything is left after `strip`, without building the stripped text."""
    return c.rlike(_NOT_BLANK)


def matches_stripped(c: Column, pattern: str) -> Column:
    """Whether the stripped text matches as a whole, without building it."""
    return c.rlike(_PADDED % pattern)


def as_text(c: Column, data_type: T.DataType) -> Column:
    """Text form of a cell; null stays null."""
    if isinstance(data_type, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if is_fractional(data_type):
        return _float_text(present(c, data_type), data_type)
    if isinstance(data_type, T.BinaryType):
        return F.hex(c)
    if isinstance(data_type, T.VariantType):
        return F.to_json(c)
    if kind_of(data_type) == "nested":
        # wrapped in a struct, so that maps and arrays of any element type convert
        return F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v"))))
    return c.cast("string")


def _float_text(c: Column, data_type: T.DataType) -> Column:
    """Plain digits from 1e-4 up to 1e16, where the JVM would already switch to exponents; beyond, 1e-05 and 1e+16."""
    large = F.abs(c).between(1e7, 9999999999999998.0)
    digits = F.rtrim(c.cast("decimal(38,12)").cast("string"), F.lit("0"))
    plain = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    text = c.cast("string")
    # the JVM writes d.dddE-4
    figures = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$", ""), r"\.", "")
    sign = F.when(c < 0, "-").otherwise("")
    small = F.concat(sign, F.lit("0.000"), figures)
    power = F.regexp_extract(text, r"E(-?)([0-9]+)$", 2)
    exponent = F.concat(F.when(F.contains(text, F.lit("E-")), "e-").otherwise("e+"),
                        F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    far = F.concat(sign, F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0$", ""), exponent)
    return F.when(large, plain).when(F.endswith(text, F.lit("E-4")), small).when(F.contains(text, F.lit("E")), far).otherwise(text)


def safe_str(c: Column, data_type: T.DataType = T.StringType()) -> Column:
    return F.coalesce(strip(as_text(c, data_type)), F.lit(""))


def filled(c: Column, data_type: T.DataType = T.StringType()) -> Column:
    """Trimmed text, null when nothing is left."""
    return F.nullif(strip(as_text(c, data_type)), F.lit(""))


def is_float_text(c: Column) -> Column:
    return matches_stripped(c, _FLOAT) | matches_stripped(c, _FLOAT_WORD)


def float_of_text(c: Column) -> Column:
    """Double for texts Python's float() would read, else null ('1d' stays text)."""
    return F.when(is_float_text(c), F.replace(strip(c), F.lit("_"), F.lit("")).try_cast("double"))


def to_number(c: Column, data_type: T.DataType) -> Column:
    """Numeric coercion: unreadable or NaN gives null; instants count in nanoseconds."""
    if kind_of(data_type) == "numeric":
        return present(c.cast("double"), T.DoubleType())
    if kind_of(data_type) == "temporal":
        return epoch_seconds(c) * 1e9
    if isinstance(data_type, T.StringType):
        return present(float_of_text(c), T.DoubleType())
    return F.lit(None).cast("double")


def _ptbr_plain(text: Column) -> Column:
    """Decimal comma to dot; % and the thousands dots go."""
    return F.translate(text, ",%.", ".")


def _ptbr_value(text: Column) -> Column:
    value = F.nanvl(float_of_text(_ptbr_plain(text)), F.lit(None))
    return F.when(F.endswith(strip(text), F.lit("%")), value / 100).otherwise(value)


def parse_ptbr_number(text: Column) -> Column:
    """'1.234,56' -> 1234.56, '12,5%' -> 0.125; dots are always thousands marks."""
    return F.when(_begins(text, "in") & text.rlike(_MAYBE_NUMBER), _ptbr_value(text))


def is_ptbr_number(text: Column) -> Column:
    return F.when(_begins(text, "in") & text.rlike(_MAYBE_NUMBER), is_float_text(_ptbr_plain(text))).otherwise(False)


def parse_datetime(c: Column, data_type: T.DataType = T.StringType(), day_first: bool = False) -> Column:
    """Lenient datetime: numbers give null, texts are taken apart by pattern and put together from their parts.

    Read are year-first dates with - or /, year-last dates with - / or . (month first unless told otherwise or it
    exceeds 12), eight digits, and `05 Jan 2024`; each but the digits with an optional time of minutes, seconds or
    fractions (kept to microseconds) and zone, which is converted to UTC. No formatter is involved, so a text that is
    no date costs no exception. Returns timestamp without zone.
    """
    kind = kind_of(data_type)
    if kind == "temporal":
        return c.cast("timestamp_ntz")
    if not isinstance(data_type, T.StringType):
        return F.lit(None).cast("timestamp_ntz")
    # year|month|day|hour|minute|second|fraction|zone|sign between the parts where the year comes last
    parts = F.split(F.when(_begins(c, "") & c.rlike(_MAYBE_DATE), F.regexp_replace(strip(c), _ANY_DATE, _ANY_PARTS)), r"\|")
    parsed = F.transform(F.array(parts), lambda p: F.when(F.size(p) == 9, _assembled(p, day_first)))
    return F.get(parsed, F.lit(0))


def _begins(c: Column, letters: str) -> Column:
    """Whether the first character is no letter but one of those given: spares nearly all prose a pattern, which looks at
    every place of a text even when it can only match at its start."""
    first = F.ascii(c)
    return (first < 65) | (first > 127) | first.isin([ord(x) for x in letters.lower() + letters.upper()])


def _assembled(p: Column, day_first: bool) -> Column:
    def number(i: int) -> Column:
        return F.coalesce(F.get(p, F.lit(i)).try_cast("int"), F.lit(0))

    month = F.get(p, F.lit(1))
    named = (F.position(F.lower(F.substring(month, 1, 3)), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3
    first = F.when(month.rlike("^[0-9]"), month.try_cast("int")).when(named == F.floor(named), named.cast("int")).otherwise(0)
    second = number(2)
    swapped = (F.get(p, F.lit(8)) != "") & ((second <= 12) if day_first else (first > 12))
    seconds = F.concat(number(5).cast("string"), F.lit("."), F.substring(F.rpad(F.get(p, F.lit(6)), 6, "0"), 1, 6)).try_cast("decimal(16,6)")
    made = F.try_make_timestamp_ntz(number(0), F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second),
                                    number(3), number(4), seconds)
    zone = F.replace(F.get(p, F.lit(7)), F.lit(":"), F.lit(""))
    ahead = F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")
    ahead = F.when(zone.startswith("-"), -ahead).when(zone.startswith("+"), ahead)
    return made - F.make_dt_interval(mins=F.coalesce(ahead, F.lit(0)))


def moment(value: datetime | Column) -> Column:
    """A moment without zone. It goes in as text, since a datetime literal would pass
    through the zones of the Python process and of the session."""
    return value if isinstance(value, Column) else F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def epoch_seconds(c: Column) -> Column:
    """Seconds since 1970 read off the wall clock, so no zone or daylight rule enters."""
    ts = c.cast("timestamp_ntz")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts).cast("double")
    return F.unix_date(ts.cast("date")).cast("long") * 86400 + seconds


def sanitize_expr(c: Column, empty: str = "obj") -> Column:
    """Identifier form of a text: lower case, blanks to _, other characters dropped."""
    name = F.regexp_replace(F.lower(strip(c)), r"(?U)[\s\x1c-\x1f]+", "_")
    name = F.regexp_replace(name, "[^a-z0-9_]", "")
    name = F.when(name == "", empty).otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("s_"), name)).otherwise(name)


def text_regex(pattern: str) -> str:
    """A Python pattern for `match` (anchored at the start only), in Java syntax."""
    java = pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z")
    return rf"(?dU)\A(?:{java})"


def is_email(text: Column) -> Column:
    return matches_stripped(text, C.EMAIL_PATTERN.strip("^$"))


def ratio(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """part / whole, or `empty` when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty).cast("double"))
