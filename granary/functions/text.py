"""Column functions on labels, numbers, years, headings and units. All native; ``(?U)`` makes Java's classes
Unicode, as ``\\s`` and ``\\b`` must be here."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary import registry as R

#: Line ends as text tools see them: CR LF, LF, CR, VT, FF, FS-RS, NEL, line and paragraph separators.
LINE_END = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
NEWLINES = r"\r\n|\r|\n|\\n"
#: White space of any script, as \s with (?U).
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Numbers in text, months and years in headers, and what a cell says instead of a number.
NUMBER = r"\(?[-−]?(?U)\d[\d,]*(?:\.\d+)?\)?"
_MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec"
DATE_YEAR = rf"(?iU)(?:(?:\d{{1,2}}\s+)?(?:{_MONTHS})\s+(20\d{{2}})|fy\s*(20\d{{2}})|(20\d{{2}})-\d{{2}}\b)"
BARE_YEAR = r"(?U)\b(20\d{2})\b"
NO_NUMBER = ("", "-", "--", "—", "–", "na", "n/a", "nil", "Nil", "NA", "N/A")


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def squeeze(c: Column) -> Column:
    return trim(sub(c, r"(?U)\s+", " "))


def lines(c: Column) -> Column:
    """Lines of a text; none for an empty one, no empty last one."""
    ended = sub(c, rf"(?:{LINE_END})\z")
    return F.when(F.coalesce(F.length(c), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(ended, LINE_END))


def top_lines(c: Column, n: int) -> Column:
    """The first lines of a text as one text; what follows them is not split."""
    return F.array_join(F.slice(F.split(c, LINE_END, n + 1), 1, n), "\n")


def has_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether a text holds one of the phrases, in one pass."""
    return c.rlike("|".join(f"\\Q{p}\\E" for p in phrases))


def ordered(cases: Iterable[tuple[str, Column]], default: str | None = None) -> Column:
    """The name of the first case that holds."""
    out = None
    for name, cond in cases:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(F.lit(default))


def label_key(label: Column) -> Column:
    """A label as the registry sees it: one leading "(7) ", one trailing "(a)", one run of note marks go."""
    s = sub(trim(F.lower(trim(label))), r"(?U)\s+", " ")
    s = sub(s, r"(?U)^\(\d+\)\s*")
    s = sub(s, r"(?U)\s*\([a-z]\)$")
    return sub(s, r"(?U)\s*[*#†‡]+$")


def match_metric(label: Column, statement: Column | None = None) -> Column:
    """The first registry metric whose aliases the label has and whose excludes it lacks; NULL if none."""

    def first(key: Column) -> Column:
        cases = []
        for name, stmt, alias, exclude in R.METRICS:
            hit = key.rlike("(?iU)" + "|".join(f"(?:{a})" for a in alias))
            if exclude:
                hit = hit & ~key.rlike("(?iU)" + "|".join(f"(?:{e})" for e in exclude))
            if statement is not None:
                hit = (F.coalesce(statement, F.lit("")).isin("", stmt)) & hit
            cases.append((name, hit))
        return ordered(cases)

    return F.when(F.coalesce(label, F.lit("")) != "", let(label_key(label), first))


def line_label(text: Column) -> Column:
    """A line's label: ligatures spelt out, footnote marks in brackets and leading numbering dropped."""
    s = sub(trim(F.lower(trim(F.coalesce(text, F.lit(""))))), r"(?U)\s+", " ")
    s = sub(F.replace(F.replace(s, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), r"\[[^\]]+\]")
    return squeeze(sub(s, r"(?U)^[\(\)ivxabc\d]+[.)\s]\s*"))


def grounding_key(s: Column) -> Column:
    """Text as grounding compares it: line ends (a literal backslash-n too) to spaces, lower case, no commas
    between digits, single spaces."""
    s = F.lower(sub(s, NEWLINES, " "))
    return trim(sub(sub(s, r"(?U)(?<=\d),(?=\d)"), r"(?U)\s+", " "))


def parse_value(raw: Column) -> Column:
    """A printed number as double, NULL for dashes, nil and anything else. Round brackets negate, so "(-5)"
    is 5."""

    def value(s: Column) -> Column:
        t = F.translate(F.btrim(s, F.lit("()")), "−–₹$€£", "--")
        t = trim(F.translate(sub(t, r"[Rr][Ss]\.?"), ",", ""))
        v = let(t, lambda x: F.when(x.rlike(r"^-?[0-9]+(?:\.[0-9]+)?\z"), x.try_cast("double")))
        return F.when(~s.isin(*NO_NUMBER), F.when(s.startswith("(") & s.endswith(")"), -v).otherwise(v))

    return let(trim(raw), value)


def numbers(text: Column) -> Column:
    """All numbers of a text, parsed, those that don't parse left out."""
    return F.array_compact(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), parse_value))


def _valid_years(found: Column) -> Column:
    return F.filter(F.transform(F.filter(found, lambda x: x != ""), lambda x: x.cast("int")), lambda y: (y >= 2000) & (y <= 2100))


def header_years(cell: Column) -> Column:
    """Distinct years of a header: month-year, FY and range forms (a range gives its first year) in order of
    place, then bare years."""
    dated = F.regexp_extract_all(cell, F.lit(DATE_YEAR), F.lit(0))
    dated = F.transform(dated, lambda x: F.regexp_extract(x, r"(20[0-9]{2})(?:-[0-9]{2})?\z", 1))
    return F.array_distinct(F.concat(_valid_years(dated), _valid_years(F.regexp_extract_all(cell, F.lit(BARE_YEAR), F.lit(1)))))


def column_years(cell: Column) -> Column:
    """Distinct years of a structural column header: a range 2023-24 gives the year it ends in, first of all;
    month-year and FY forms follow, then bare years outside ranges."""
    span = r"(?U)\b(20\d{2})-\d{2}\b"
    ends = F.transform(F.regexp_extract_all(cell, F.lit(span), F.lit(1)), lambda x: x.cast("int") + 1)
    dated = F.filter(F.regexp_extract_all(cell, F.lit(DATE_YEAR), F.lit(0)), lambda x: ~x.rlike(r"^20[0-9]{2}-[0-9]{2}\z"))
    dated = F.transform(dated, lambda x: F.regexp_extract(x, r"(20[0-9]{2})(?:-[0-9]{2})?\z", 1))
    bare = F.regexp_extract_all(sub(cell, span, "-"), F.lit(BARE_YEAR), F.lit(1))
    return F.array_distinct(F.concat(ends, _valid_years(dated), _valid_years(bare)))


def unit_of(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return ordered([(u, has_any(low, hints)) for u, hints in R.UNIT_HINTS], "as_reported")


def unit_key(unit: Column) -> Column:
    return sub(F.lower(trim(unit)), "s$")


def heading_shaped(line: Column) -> Column:
    """Short, few digits, and a capital first or throughout."""

    def shaped(s: Column) -> Column:
        upper = s.rlike(r"^[\p{Lu}\p{Lt}]") | ((F.upper(s) == s) & (F.lower(s) != s))
        return (F.length(s) > 0) & (F.length(s) <= 120) & (F.regexp_count(s, F.lit(r"(?U)\s+")) < 14) & (F.regexp_count(s, F.lit(r"(?U)\d")) <= F.length(s) * 0.3) & upper

    return let(trim(line), shaped)


def section_type(text: Column) -> Column:
    """consolidated, standalone or unknown by the first three lines; consolidated wins."""
    top = top_lines(text, 3)
    return let(top, lambda t: ordered([("consolidated", t.rlike(r"(?iU)\bconsolidated\b")), ("standalone", t.rlike(r"(?iU)\bstandalone\b"))], "unknown"))


def section_hint(text: Column) -> Column:
    """As section_type on the whole text, but unknown where both words stand."""
    low = F.lower(text)
    con, alone = low.contains("consolidated"), low.contains("standalone")
    return ordered([("consolidated", con & ~alone), ("standalone", alone & ~con)], "unknown")


def section_of_heading(heading: Column) -> Column:
    low = F.lower(heading)
    return ordered([(n, has_any(low, words)) for n, words in R.SECTIONS], "other")


def title_case(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def close_relative(a: Column, b: Column, tolerance: float) -> Column:
    """Equal, or within ``tolerance`` of b."""
    return (a == b) | F.coalesce(F.try_divide(F.abs(b - a), F.abs(b)) < tolerance, F.lit(False))


def printed(value: Column, places: int, grouped: bool = False) -> Column:
    """A number with so many decimals, halves to even as they are in binary: 0.125 is 0.12, and 2.675, which is
    a little less, 2.67. Twice the scaled number is rounded to a whole one; what that is off is known exactly (the
    product's own error by splitting both factors), so an odd whole number is told from a true half."""
    factor = 2.0 * 10**places
    split = lambda x: 134217729.0 * x - (134217729.0 * x - x)
    high = split(factor)

    def rounded(q: Column) -> Column:
        def told(p: Column) -> Column:
            top = split(q)
            error = ((top * high - p) + top * (factor - high) + (q - top) * high) + (q - top) * (factor - high)
            off = (p - F.rint(p)) + error
            n = F.rint(p).cast("decimal(20,0)").cast("long")
            half = F.floor(n / F.lit(2.0)).cast("long")
            return F.when(n % 2 == 0, half).otherwise(half + F.when(off > 0, 1).when(off < 0, 0).otherwise(half % 2))

        return let(q * factor, told)

    def text(q: Column) -> Column:
        whole = F.when(q * factor < 2.0**52, rounded(q).cast("decimal(38,0)")).otherwise(F.bround(q.cast("decimal(38,6)") * 10**places, 0).cast("decimal(38,0)"))
        unit = 10**places

        def put(n: Column) -> Column:
            ones = F.floor(n / unit) if places else n
            ones = ones.cast("decimal(38,0)")
            front = F.format_number(ones, 0) if grouped else ones.cast("string")
            return F.concat(front, F.lit("."), F.lpad((n - ones * unit).cast("decimal(38,0)").cast("string"), places, "0")) if places else front

        return let(whole, put)

    sign = F.when((value < 0) | (F.lower(value.cast("string")) == "-0.0"), "-").otherwise("")
    big = F.when(F.abs(value) < 1e30, F.concat(sign, let(F.abs(value), text)))
    return F.when(F.isnan(value), "nan").when(F.abs(value) == float("inf"), F.concat(sign, F.lit("inf"))).otherwise(F.coalesce(big, value.cast("string")))
