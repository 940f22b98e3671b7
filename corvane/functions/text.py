"""String expressions with the whitespace and slicing rules of Python strings, all of them built-in Spark functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() removes.
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c: Column | str) -> Column:
    """The string without white space at either end, in time that is linear whatever blanks stand inside."""
    return F.btrim(_col(c), F.lit(BLANKS))


def strip_block(c: Column | str, tag: str = "think") -> Column:
    """Without <tag>...</tag> blocks and the space after them, stripped. An unclosed block stays."""
    return py_strip(F.regexp_replace(_col(c), rf"(?sU)<{tag}>.*?</{tag}>\s*", ""))


def normalised(c: Column | str) -> Column:
    """Stripped and in lower case."""
    return F.lower(py_strip(c))


def first_word(c: Column | str, trimmed: str = ".,!") -> Column:
    """The first word without the characters of `trimmed` at its ends; a blank string is its own key."""
    word = F.regexp_extract(_col(c), r"(?U)^[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1)
    return F.when(word == "", _col(c)).otherwise(F.btrim(word, F.lit(trimmed)))


def first_word_of(c: Column | str, trimmed: str = ".,!") -> Column:
    """first_word of the normalised string, without normalising all of it."""
    word = F.regexp_extract(_col(c), r"(?U)^[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1)
    return F.btrim(F.lower(word), F.lit(trimmed))


def hits(c: Column | str, target: Column | str, whole_word: bool = False) -> Column:
    """Whether the string contains the target; with whole_word (targets as str only), between word boundaries."""
    if whole_word:
        return _col(c).rlike(rf"\b{target}\b")
    return F.contains(_col(c), F.lit(target) if isinstance(target, str) else target)


def model_slug(c: Column | str) -> Column:
    """The last path segment of a model's name, in lower case, with _ for - and dots."""
    return F.translate(F.lower(F.element_at(F.split(_col(c), "/"), -1)), "-.", "__")


def of_family(c: Column | str, family: str) -> Column:
    """Whether a model's name contains the family's, in any case."""
    return F.contains(F.lower(_col(c)), F.lit(family.lower()))


def replaced(c: Column | str, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, _col(c))


def before(c: Column | str, placeholder: str, strict: bool = False) -> Column:
    """What stands before the placeholder; where it doesn't occur null, or with strict an error."""
    at = F.locate(placeholder, _col(c))
    front = F.when(at > 0, F.substring(_col(c), F.lit(1), at - 1))
    return F.when(_col(c).isNotNull() & (at == 0), F.raise_error(F.lit(f"no {placeholder} in the template"))).otherwise(front) if strict else front


def percent(c: Column | str, digits: int = 1, signed: bool = False, width: int = 0) -> Column:
    """A rate as per cent, "12.5%"; signed with its sign, right-aligned in width; "nan%" for a missing rate. As printf and
    Python do, it rounds the exact double, and keeps the minus of what rounds to zero: so does format_number, but not
    round, bround and format_string."""
    c = _col(c)
    number = F.replace(F.format_number((100 * c).cast("double"), digits), F.lit(","))
    if signed:
        number = F.when(F.startswith(number, F.lit("-")), number).otherwise(F.concat(F.lit("+"), number))
    shown = F.when(c.isNull() | F.isnan(c), F.lit("nan%")).otherwise(F.concat(number, F.lit("%")))
    return F.when(F.length(shown) < width, F.lpad(shown, width, " ")).otherwise(shown) if width else shown


def padded(c: Column | str, width: int = 5) -> Column:
    """A whole number with zeros in front, never cut."""
    return F.format_string(f"%0{width}d", _col(c).cast("long"))


def grouped(c: Column | str) -> Column:
    """A whole number with commas between thousands."""
    return F.format_string("%,d", _col(c).cast("long"))


def aligned(c: Column | str, width: int) -> Column:
    """The string left-aligned in width, never cut."""
    return F.when(F.length(_col(c)) < width, F.rpad(_col(c), width, " ")).otherwise(_col(c))


def preview(c: Column | str, n: int = 80) -> Column:
    """The first n characters, and dots if there are more."""
    return F.when(F.length(_col(c)) > n, F.concat(F.left(_col(c), F.lit(n)), F.lit("..."))).otherwise(_col(c))


def token_estimate(c: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_col(c)) / 4).cast("long")
