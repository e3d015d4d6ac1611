"""Column functions that read loosely written settings, names and lists. Bad text gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that settings use for yes and no, and compass points in order from north.
TRUE_WORDS = ["1", "true", "t", "yes", "y", "on", "enable", "enabled"]
FALSE_WORDS = ["0", "false", "f", "no", "n", "off", "disable", "disabled"]
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]


def bound(x: Column, f) -> Column:
    """f of x, where x is worked out once however often f names it, also within a lambda."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stripped_comment(line: Column) -> Column:
    """The line without a // or # comment; comment signs inside quotes stay."""
    signs = F.contains(line, F.lit("#")) | F.contains(line, F.lit("//"))
    return F.rtrim(F.when(signs, F.regexp_replace(line, r"""^((?:[^"'/#]|"[^"]*"|'[^']*'|/(?!/))*)(?://|#).*$""", "$1")).otherwise(line))


def unquoted(x: Column) -> Column:
    quoted = lambda t: F.when(t.startswith('"') | t.startswith("'"), F.regexp_replace(t, r"""^(["'])(.*)\1$""", "$2")).otherwise(t)
    return bound(F.trim(x), quoted)


def key_name(x: Column) -> Column:
    """Lower case, blanks and dashes as one underscore."""
    return F.regexp_replace(F.lower(F.trim(x)), r"[\s_-]+", "_")


def plain_name(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimals, rounded as C's printf does it: by its exact binary value.

    format_string rounds the shortest decimal that reads as the number: 0.1245 is a little less and gives 0.124, not 0.125.
    """
    x = x.cast("double")
    unit, half = f"{10.0**-digits:.{digits}f}", float(f"5e-{digits + 1}")
    # Below one unit format_number takes half a unit (0.0005) as if it were exact.
    above = F.abs(x) >= half if f"{half:.{digits}f}" == unit else F.abs(x) > half
    least = F.concat(F.when(x < 0, "-").otherwise(""), F.lit(unit))
    odd = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.coalesce(odd, F.when((F.abs(x) < float(unit)) & above, least).otherwise(F.call_function("format_number", x, F.lit("0." + "0" * digits))))


def file_stem(x: Column) -> Column:
    """A name safe for files and variables."""
    return F.regexp_replace(F.regexp_replace(F.trim(x), "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")


def number(x: Column) -> Column:
    """A finite number with p or comma as decimal point, %, or m/s after it; else null."""
    bare = lambda t: F.when(F.contains(t, F.lit("%")) | F.contains(t, F.lit("m/s")), F.regexp_replace(t, r"\s*(%|m/s)$", "")).otherwise(t)
    point = lambda t: F.replace(F.when(F.contains(t, F.lit("p")), F.regexp_replace(t, r"(?<=\d)p(?=\d)", ".")).otherwise(t), F.lit(","), F.lit("."))
    read = lambda t: F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), t.try_cast("double"))
    return bound(bound(bound(bound(F.lower(F.trim(x)), bare), point), read), lambda n: F.when(F.abs(n) < float("inf"), n))


def truth(x: Column) -> Column:
    return bound(F.lower(F.trim(x)), lambda t: F.when(t.isin(TRUE_WORDS), F.lit(True)).when(t.isin(FALSE_WORDS), F.lit(False)).otherwise(number(t) != 0))


def tokens(x: Column) -> Column:
    """Items of '[a, b]' or 'a, b', blanks dropped."""
    inner = F.regexp_replace(F.trim(x), r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), unquoted), lambda v: v != "")


def floats(x: Column) -> Column:
    """All items as numbers; one bad item makes the list empty."""
    return bound(F.transform(tokens(x), number), lambda values: F.when(F.exists(values, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(values))


def pair(x: Column) -> Column:
    """Two numbers in rising order, else null."""
    return bound(floats(x), lambda values: F.when(F.size(values) == 2, F.array_sort(values)))


def compass_degrees(x: Column) -> Column:
    """Degrees of a compass point, or of a number within 0.51 of a multiple of 22.5 below 360; else null."""
    t = F.upper(F.trim(x))
    named = F.array_position(F.array(*map(F.lit, COMPASS)), t)
    n = F.pmod(number(t), F.lit(360.0))
    near = F.round(n / 22.5) * 22.5
    return F.when(named > 0, (named - 1) * 22.5).when((F.abs(n - near) <= 0.51) & (near < 360), near)


def step_of(name: Column) -> Column:
    """The step number that ends a result's name: <case>_avg-<step>.vtk."""
    return F.regexp_extract(name, r"-(\d+)\.\w+$", 1).try_cast("bigint")


def angle_of(name: Column) -> Column:
    """The last numeric token before 'avg' in a result's name."""
    head = F.split(F.split(F.lower(name), "avg")[0], "[_-]")
    return F.try_element_at(F.filter(F.transform(head, number), lambda v: v.isNotNull()), F.lit(-1))


def stamp(x: Column) -> Column:
    """A 14-digit date and time, or the default far in the future."""
    t = F.regexp_extract(x, r"(?<!\d)(\d{14})(?!\d)", 1)
    return F.when(F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")).isNotNull(), t).otherwise("20990101120000")


def probe_offset(x: Column) -> Column:
    """[east, north] metres or cells of a probe's offset: N100E50, or NNE counting letters."""
    t = F.upper(F.trim(x))
    metres = lambda sign: F.coalesce(F.regexp_extract(t, sign + r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))
    letters = lambda sign: (F.length(t) - F.length(F.replace(t, F.lit(sign), F.lit("")))).cast("double")
    of = F.when(t.rlike(r"\d"), F.array(metres("E") - metres("W"), metres("N") - metres("S"))).otherwise(F.array(letters("E") - letters("W"), letters("N") - letters("S")))
    return F.when(t.rlike(r"^([NESW]\d+(\.\d+)?)+$|^[NESW]+$"), of)


def human_bytes(n: Column) -> Column:
    power = F.when(n < 1, 0).otherwise(F.least(F.floor(F.log2(n) / 10), F.lit(5))).cast("int")
    unit = F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB", "TB", "PB"])), power + 1)
    return F.concat_ws(" ", F.format_string("%.1f", n / F.pow(F.lit(1024.0), power)), unit)


def decoded(content: Column) -> Column:
    """Text of unknown encoding: by its mark (UTF-8, UTF-16), else UTF-8 where that is valid, else Latin-1, which always is."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda k: F.substring(content, k, F.greatest(F.octet_length(content), F.lit(1)))
    return (
        F.when(head == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .when(F.substring(head, 1, 4) == "FFFE", F.decode(rest(3), "UTF-16LE"))
        .when(F.substring(head, 1, 4) == "FEFF", F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
