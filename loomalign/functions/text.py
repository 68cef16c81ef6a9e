"""Column expressions on cell texts and column names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of a missing cell (case-sensitive, after strip).
MISSING = ("", "NA", "NaN", "nan", "null", "None")

# What Python's float() accepts, commas taken out before; underscores only between digits.
NUMBER = r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$"
NOT_FINITE = r"(?i)^[+-]?(inf|infinity|nan)$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once for each row: inside a lambda the optimiser would put the expression itself."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Unicode white space off both ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def _bare(c: Column) -> Column:
    """Do both ends hold visible ASCII characters? Then there is nothing to strip, and no pattern has to run."""
    return F.ascii(c).between(33, 126) & F.ascii(F.right(c, F.lit(1))).between(33, 126)


def strip_cell(c: Column) -> Column:
    """strip() for a plain column, fast for cells without outer white space."""
    return F.when(_bare(c), c).otherwise(strip(c))


def normalise_name(c: Column) -> Column:
    """A column name without byte-order marks and outer white space; null becomes empty."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), "﻿", ""))


def is_missing(c: Column) -> Column:
    return F.when(_bare(c), c.isin(*MISSING)).otherwise(strip(c).isin(*MISSING))


def is_number(c: Column) -> Column:
    """Would Python's float() take the cell, commas taken out? Infinities and NaN count."""
    bare = strip(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""))
    return bare.rlike(NUMBER) | bare.rlike(NOT_FINITE)


def number(c: Column) -> Column:
    """The cell as a finite double, else null: infinities and NaN would poison means, so they count as unparsable."""
    bare = strip(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""))
    return F.when(bare.rlike(NUMBER), F.regexp_replace(bare, "_", "").try_cast("double"))


def is_dated(c: Column) -> Column:
    """Not a number, with a digit and one of / - :"""
    return ~is_number(c) & c.rlike(r"\p{Nd}") & c.rlike("[/:-]")


def name_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(normalise_name(c)), "[^a-z0-9]+"), lambda t: t != ""))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal lower-cased names, else Jaccard of their ASCII tokens; 0 for empty names or names without tokens."""
    x, y = F.lower(normalise_name(a)), F.lower(normalise_name(b))
    s, t = name_tokens(a), name_tokens(b)
    jaccard = F.size(F.array_intersect(s, t)) / F.size(F.array_union(s, t))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((F.size(s) == 0) | (F.size(t) == 0), 0.0).otherwise(jaccard)


# The default rules of semantic families, first match wins. (family, names equal to, parts of the name,
# parts of the name's letters and digits). Replaceable: they are made for weather and air-quality tables.
FAMILIES: tuple[tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    ("identifier", ("no", "id", "idx", "index"), (), ()),
    ("year", ("year",), (), ()),
    ("month", ("month",), (), ()),
    ("date", ("day", "date"), (), ()),
    ("time", ("hour", "time"), (), ()),
    ("season", (), ("season",), ()),
    ("dew_point", (), ("dewp",), ("dewpoint",)),
    ("temperature", ("temp", "t"), ("temp",), ()),
    ("humidity", ("humi", "rh"), ("humid",), ()),
    ("absolute_humidity", ("ah",), (), ()),
    ("pressure", (), ("pres",), ()),
    ("wind_direction", (), ("cbwd",), ("winddir",)),
    ("wind_speed", ("iws",), (), ("windspeed",)),
    ("precipitation", ("ir", "iprec"), ("precip", "rain"), ()),
    ("snow", ("is",), ("snow",), ()),
    ("particulate_matter", (), ("pm",), ()),
    ("gas_sensor", (), ("(gt)", "pt08"), ()),
    ("gas_sensor", (), ("co", "nox", "no2", "nmhc", "c6h6", "o3"), ()),
)


def semantic_family(c: Column, rules: Sequence[tuple] = FAMILIES) -> Column:
    name = F.lower(normalise_name(c))
    bare = F.regexp_replace(name, "[^a-z0-9]", "")
    out = F.when(name == "", "unknown")
    for family, equal, parts, bare_parts in rules:
        test = F.lit(False)
        if equal:
            test = test | name.isin(*equal)
        for p in parts:
            test = test | name.contains(p)
        for p in bare_parts:
            test = test | bare.contains(p)
        out = out.when(test, family)
    return out.otherwise("unknown")


def family_compatibility(a: Column, b: Column, rules: Sequence[tuple] = FAMILIES, penalty: float = 0.35) -> Column:
    """1 for equal families or an unknown one, else penalty."""
    x, y = semantic_family(a, rules), semantic_family(b, rules)
    return F.when((x == "unknown") | (y == "unknown") | (x == y), 1.0).otherwise(penalty)


def general(x: Column, digits: int = 4) -> Column:
    """A double in the form of C's %.{digits}g: that many significant digits (a half is rounded up), no trailing zeros, an exponent below -4 and from `digits` on."""
    clean = lambda s: F.regexp_replace(F.regexp_replace(s, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    ten = lambda k: F.pow(F.lit(10.0), k)
    e = F.split(F.format_string("%.16e", x), "e")[1].cast("int")
    m = F.round(F.when(e >= digits - 1, F.abs(x) / ten(e - (digits - 1))).otherwise(F.abs(x) * ten(F.lit(digits - 1) - e)), 0)
    over = m >= 10**digits
    m, e = F.when(over, m / 10).otherwise(m), F.when(over, e + 1).otherwise(e)
    fixed = clean(F.format_string(f"%.{digits + 3}f", F.when(e >= digits - 1, m).otherwise(m / ten(F.lit(digits - 1) - e))))
    power = F.concat(clean(F.format_string(f"%.{digits - 1}f", m / 10 ** (digits - 1))), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
    return F.when(x == 0, "0").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), F.when((e < -4) | (e >= digits), power).otherwise(fixed)))


def draw(*parts: Column) -> Column:
    """A repeatable number from 0 to 2 ** 32 - 1 for a key: the first eight digits of its MD5, so SQL engines agree on it."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
