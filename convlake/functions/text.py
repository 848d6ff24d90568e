"""Text and time expressions of the ledger, as columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from convlake.schemas import TAG_STOPWORDS

BLANKS = r"[\s]+"


def squeeze(c: Column) -> Column:
    """Runs of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, BLANKS, " "))


def strip(c: Column) -> Column:
    """Without blanks (space, tab, newline and the like) at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_tags(c: Column) -> Column:
    """a comma list of tags in canonical form; null and empty give the empty string."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.substring(squeeze(F.lower(p)), 1, 64))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ", ")


def auto_tag(title: Column) -> Column:
    """the first word of a title that is no stopword, normalized; empty if there is none."""
    words = F.filter(F.split(strip(F.coalesce(title, F.lit(""))), BLANKS), lambda w: ~F.lower(w).isin(*TAG_STOPWORDS) & (w != ""))
    return normalize_tags(F.get(words, F.lit(0)))


def add_tag(tags: Column, tag: Column) -> Column:
    """a comma list with another tag at its end."""
    return normalize_tags(F.concat_ws(",", tags, tag))


def remove_tag(tags: Column, tag: Column) -> Column:
    """a comma list without a tag, both in canonical form."""
    return F.array_join(F.array_remove(F.split(normalize_tags(tags), ", "), normalize_tags(tag)), ", ")


def shorten(c: Column, most: int) -> Column:
    """at most ``most`` characters; a longer text ends in an ellipsis."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def cut(c: Column, most: int) -> Column:
    """the first ``most`` characters and an ellipsis where there were more."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most), F.lit("…")))


def safe_name(title: Column, most: int = 60) -> Column:
    """file-name form of a title: other characters than ASCII letters, digits, space, ``-_.`` become ``_``."""
    name = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^0-9A-Za-z \-_.]", "_")
    name = F.substring(F.trim(name), 1, most)
    return F.when(name == "", "untitled").otherwise(name)


def slug(c: Column) -> Column:
    """lower-case words of letters and digits joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def yaml_quote(c: Column) -> Column:
    """a double-quoted scalar."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cut_at_line(c: Column, most: int, suffix: str) -> Column:
    """at most ``most`` characters, cut after the last line if that keeps over half, with a suffix."""
    budget = most - len(suffix)
    head = F.substring(c, 1, budget)
    after = F.instr(F.reverse(head), "\n")  # characters after the last newline, plus one
    at = F.when(after > 0, budget - after)
    kept = F.when(at > budget * 0.5, F.left(head, at)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit(suffix)))


def capitalized(c: Column) -> Column:
    """F8: first character upper-case, the rest lower-case."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def at(unix: Column) -> Column:
    return F.timestamp_micros((unix * 1_000_000).cast("long"))


def iso(unix: Column) -> Column:
    """``2024-01-31T10:00:00Z``; null stays null."""
    return F.date_format(at(unix), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_or_na(unix: Column) -> Column:
    """``123.000 (2024-...Z)`` or ``N/A``."""
    return F.coalesce(F.concat(F.format_string("%.3f", unix), F.lit(" ("), iso(unix), F.lit(")")), F.lit("N/A"))


def day(unix: Column) -> Column:
    return F.date_format(at(unix), "yyyy-MM-dd")


def month(unix: Column) -> Column:
    return F.date_format(at(unix), "yyyy-MM")


def relative(unix: Column, now: Column) -> Column:
    """``5m ago`` to ``2y ago``; the last minute and the future are ``just now``."""
    s = now - unix
    steps = ((60, None), (3600, ("m", 60)), (86400, ("h", 3600)), (86400 * 7, ("d", 86400)), (86400 * 30, ("w", 86400 * 7)), (86400 * 365, ("mo", 86400 * 30)))
    out = F.when(s < 60, F.lit("just now"))
    for most, (unit, size) in ((m, u) for m, u in steps if u):
        out = out.when(s < most, F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago")))
    return out.otherwise(F.concat(F.floor(s / (86400 * 365)).cast("string"), F.lit("y ago")))


def date_range(first: Column, last: Column) -> Column:
    """``Mar 1 — Mar 9, 2026``, with both years if they differ; one date if equal; empty if there is none."""
    long = lambda u: F.date_format(at(u), "MMM d, yyyy")
    same_year = F.year(at(first)) == F.year(at(last))
    out = F.when(long(first) == long(last), long(first))
    out = out.when(same_year, F.concat(F.date_format(at(first), "MMM d"), F.lit(" — "), long(last)))
    return F.coalesce(out.otherwise(F.concat(long(first), F.lit(" — "), long(last))), F.lit(""))


def words_of(c: Column, pattern: str, stopwords: Iterable[str]) -> Column:
    """Distinct matches of a pattern in the lower-cased text, without the stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.array_except(found, F.array(*(F.lit(w) for w in stopwords)))


def html_text(c: Column) -> Column:
    """Text of HTML: tags become newlines, of which runs become one, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", "\n"), r"\n{2,}", "\n"))


def stable_id(kind: str, number: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), number.cast("string"))


def stable_number(c: Column, kind: str) -> Column:
    """the number of a stable id of that kind; null for others."""
    return F.when(c.rlike(rf"^{kind}:[0-9]{{1,18}}$"), F.substring_index(c, ":", -1).cast("long"))
