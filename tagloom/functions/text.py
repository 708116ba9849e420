"""Scalar expressions over tag strings, dates and URLs; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagloom.model import COLORS, NO_COLOR

UNIT_CHARS = {"Year": 4, "Month": 7, "Day": 10}


def literal_pattern(text: str) -> str:
    """A regular expression for the text itself, understood by Java and RE2 alike."""
    return "".join("\\" + c if not (c.isalnum() or c == "_" or ord(c) > 127) else c for c in text)


def wildcard_pattern(text: str, star: str) -> str:
    """The text with its other characters quoted and each * as the given expression."""
    return star.join(literal_pattern(part) for part in text.split("*"))


def glob_pattern(glob: str) -> str:
    """An anchored expression for a shell glob with *, ?, [set] and [!set]."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 if glob[i + 1 : i + 2] != "!" else i + 3) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = close
        else:
            out += literal_pattern(c)
        i += 1
    return f"^{out}$"


def tag_array(tags: Column) -> Column:
    """The tags of a tag string, in order, without empty ones; null has none."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), r"\s+"), lambda t: t != "")


def spaced_tags(tags: Column) -> Column:
    """The tags between single spaces; null has none."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), " "), lambda t: t != "")


def has_tag(tags: Column, tag: str) -> Column:
    """Whether the tag stands between spaces, or the string's ends; null has no tags."""
    return F.contains(F.concat(F.lit(" "), F.coalesce(tags, F.lit("")), F.lit(" ")), F.lit(f" {tag} "))


def date_unit(created_at: Column, interval: str) -> Column:
    """The year, month or day prefix of an ISO date; null if it is too short."""
    unit = F.substring(created_at, 1, UNIT_CHARS[interval])
    return F.when(F.char_length(unit) == UNIT_CHARS[interval], unit)


def day_of_leap_year(created_at: Column) -> Column:
    """0 to 365 in a calendar in which every year has a 29 February; null for no such day.
    Year, month and day are read by their places, whatever stands between them."""
    digits = F.concat(F.substring(created_at, 1, 4), F.substring(created_at, 6, 2), F.substring(created_at, 9, 2))
    day = F.try_to_date(F.concat(F.lit("2000"), F.substring(digits, 5, 4)), "yyyyMMdd")
    return F.when(digits.rlike(r"^\d{8}$"), F.datediff(day, F.lit("2000-01-01").cast("date")))


def year_month(created_at: Column) -> Column:
    return F.concat(F.substring(created_at, 1, 4), F.lit("-"), F.substring(created_at, 6, 2))


def leap_label(day: Column) -> Column:
    """MM-dd of a day of the leap calendar; days beyond it are 01-01."""
    shown = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), day.cast("int")), "MM-dd")
    return F.when(day < 366, shown).otherwise("01-01")


def share(part: Column, whole: Column) -> Column:
    """part of whole in percent; 0 where there is no whole."""
    return F.when(whole > 0, part / whole * 100.0).otherwise(0.0)


def human_count(n: Column) -> Column:
    """950, 1.2k or 3.4M."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def file_hash(md5: Column, url: Column) -> Column:
    """The md5 of a file: its own column, or else what its URL shows."""
    return F.coalesce(F.nullif(md5, F.lit("")), F.nullif(F.regexp_extract(url, r"/([a-f0-9]{32})\.", 1), F.lit("")))


def absolute_url(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(url)


def derived_url(base: str, size: str, extension: str, digest: Column, url: Column) -> Column:
    """The URL of a file's rendition by its hash, or its own URL without one."""
    path = F.concat(F.lit(f"{base}/{size}/"), F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 2), F.lit("/"), digest, F.lit(f".{extension}"))
    return F.coalesce(path, absolute_url(url))


def color_of(category: Column) -> Column:
    """The colour in which a category's tags are shown."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in COLORS.items() for x in pair))[category], F.lit(NO_COLOR))


def anchors(tags: Column, color: str) -> Column:
    """Each tag of a tag string as a link to itself, in a colour."""
    link = lambda t: F.concat(F.lit('<a href="'), t, F.lit(f'" style="color:{color}; text-decoration:none;">'), t, F.lit("</a>"))
    return F.array_join(F.transform(tag_array(tags), link), " ")
