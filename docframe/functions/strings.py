"""String methods as column expressions; positions count code points from 0."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docframe.functions.values import WHITE


def length(s: Column, utf16: bool = False) -> Column:
    """Code points, or UTF-16 units."""
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("long") if utf16 else F.length(s).cast("long")


def upper(s: Column) -> Column:
    return F.upper(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def trim_start(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WHITE}", "")


def trim_end(s: Column) -> Column:
    return F.regexp_replace(s, rf"{WHITE}\z", "")


def trim(s: Column) -> Column:
    return trim_end(trim_start(s))


def _from_end(i: int, n: Column) -> Column:
    return F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)


def slice_text(s: Column, start: int, end: int | None = None) -> Column:
    """Negatives count from the end; empty where start isn't before end."""
    n = F.length(s)
    a = _from_end(start, n)
    z = n if end is None else _from_end(end, n)
    return F.substring(s, a + 1, F.greatest(z - a, F.lit(0)))


def substring(s: Column, start: int, end: int | None = None) -> Column:
    """Negatives count as 0; the bounds are swapped where start is after end."""
    n = F.length(s)
    a = F.least(F.lit(max(0, start)), n)
    z = n if end is None else F.least(F.lit(max(0, end)), n)
    return F.substring(s, F.least(a, z) + 1, F.greatest(a, z) - F.least(a, z))


def replace_first(s: Column, search: str, put: str) -> Column:
    """The first place of a literal."""
    at = F.instr(s, search)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(put), F.substring(s, at + len(search), F.length(s)))).otherwise(s)


def replace_first_match(s: Column, pattern: str, put: str) -> Column:
    """The first match of a pattern; $1 and the like stand for groups, $& for the match."""
    groups = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 2}", put).replace("$&", "$2")
    # two groups come before the pattern's own, and the text before the match may have line ends
    shifted = re.sub(r"\\(.)", lambda m: f"\\{int(m[1]) + 2}" if m[1] in "123456789" else m[0], pattern, flags=re.S)
    return F.regexp_replace(s, f"\\A((?s:.*?))({shifted})", f"$1{groups}")


def replace_all(s: Column, search: str, put: str) -> Column:
    return F.replace(s, F.lit(search), F.lit(put))


def replace_matches(s: Column, pattern: str, put: str) -> Column:
    return F.regexp_replace(s, pattern, put.replace("$&", "$0"))


def split(s: Column, separator: str, limit: int | None = None) -> Column:
    """Parts between a literal; what is beyond the limit is dropped; '' gives the characters."""
    parts = F.split(s, f"\\Q{separator}\\E" if separator else "(?!^)(?!\\z)", -1)
    return parts if limit is None else F.slice(parts, 1, limit)


def includes(s: Column, part: str) -> Column:
    return F.contains(s, F.lit(part))


def starts_with(s: Column, part: str) -> Column:
    return F.startswith(s, F.lit(part))


def ends_with(s: Column, part: str) -> Column:
    return F.endswith(s, F.lit(part))


def index_of(s: Column, part: str) -> Column:
    return (F.instr(s, part) - 1).cast("long")


def last_index_of(s: Column, part: str) -> Column:
    found = F.instr(F.reverse(s), part[::-1])
    return F.when(found > 0, F.length(s) - found - (len(part) - 1)).otherwise(F.lit(-1)).cast("long")


def char_at(s: Column, i: int) -> Column:
    """'' out of range."""
    return F.substring(s, i + 1, 1) if i >= 0 else F.when(s.isNotNull(), "")


def at(s: Column, i: int) -> Column:
    """Negatives count from the end; null out of range."""
    place = F.lit(i) if i >= 0 else F.length(s) + i
    return F.when((place >= 0) & (place < F.length(s)), F.substring(s, place + 1, F.lit(1)))


def pad_start(s: Column, n: int, pad: str = " ") -> Column:
    """Never cuts; an empty pad changes nothing."""
    return F.lpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(pad)) if pad else s


def pad_end(s: Column, n: int, pad: str = " ") -> Column:
    return F.rpad(s, F.greatest(F.lit(n), F.length(s)), F.lit(pad)) if pad else s


def repeat(s: Column, n: int) -> Column:
    if n < 0:
        raise ValueError("repeat needs a count of 0 or more")
    return F.repeat(s, n)


def match(s: Column, pattern: str, groups: int = 0) -> Column:
    """The first match with its groups, or null."""
    return F.when(s.rlike(pattern), F.array(*[F.regexp_extract(s, pattern, g) for g in range(groups + 1)]))


def match_each(s: Column, pattern: str) -> Column:
    """All whole matches, or null if there is none."""
    return F.when(s.rlike(pattern), F.regexp_extract_all(s, F.lit(pattern), F.lit(0)))


def match_all(s: Column, pattern: str, groups: int = 0) -> Column:
    """All matches as structs g0 (whole), g1..; empty if there is none."""
    return F.arrays_zip(*[F.regexp_extract_all(s, F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in range(groups + 1)])


def fill_template(s: Column, variables: dict[str, str]) -> Column:
    """{{name}} for each variable in order, literally and at every place; unknown ones stay."""
    for name, value in variables.items():
        s = F.replace(s, F.lit("{{" + name + "}}"), F.lit(value))
    return s


def fill_template_text(text: str, variables: dict[str, str]) -> str:
    """The same for text on the driver."""
    for name, value in variables.items():
        text = text.replace("{{" + name + "}}", value)
    return text


def strip_fences(s: Column) -> Column:
    """Text without the code fences around it, trimmed."""
    return trim(F.regexp_replace(F.regexp_replace(trim(s), r"(?i)^```(?:javascript|js)?\s*", ""), r"\s*```\z", ""))


def locale_key(s: Column) -> Column:
    """To order by: a A b B é f."""
    return F.collate(s, "UNICODE")


def contains_any_case(s: Column, term: str) -> Column:
    """The term is trimmed; an empty one is in every text."""
    return F.contains(F.lower(s), F.lit(term.strip().lower()))
