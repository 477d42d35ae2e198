"""Text expressions. Missing values follow the source surveys' convention: in
pasted text they show as the word NA."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how a missing value shows inside pasted text.
MISSING = "NA"


def paste_na(*parts: Column | str, sep: str = " ") -> Column:
    """Join the parts as text; a null part becomes the word NA."""
    texts = [F.coalesce(_column(p).cast("string"), F.lit(MISSING)) for p in parts]
    return F.concat_ws(sep, *texts)


def date_text(moment: Column | str) -> Column:
    return _column(moment).cast("date").cast("string")


def datetime_text(moment: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm:ss``. A plain cast keeps the wall clock; date_format
    would go through the session time zone."""
    return F.substring(_column(moment).cast("string"), 1, 19)


def number_text(value: Column | str) -> Column:
    """Shortest plain decimal text (12, 1.25, 10000000), null as the word NA. Numbers
    of up to 20 digits before the point; digits after the 18th place are rounded."""
    plain = _column(value).cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(plain, r"\.?0+$", ""), F.lit(MISSING))


def replace_first(text: Column | str, find: str, new: str) -> Column:
    """Replace only the first occurrence of a literal."""
    text = _column(text)
    at = F.instr(text, find)
    return F.when(
        at > 0,
        F.concat(
            F.substring(text, F.lit(1), at - 1),
            F.lit(new),
            F.substring(text, at + len(find), F.length(text)),
        ),
    ).otherwise(text)


def readable(name: Column | str) -> Column:
    """``Water_quality`` as ``Water quality``."""
    return replace_first(name, "_", " ")


def link(url: Column | str, label: Column | str) -> Column:
    """HTML anchor."""
    return paste_na(F.lit("<a href='"), url, F.lit("'>"), label, F.lit("</a>"), sep="")


def first_containing(text: Column | str, names: list[str]) -> Column:
    """The first of ``names`` found inside the text, else the text itself.
    Order matters when one name holds another."""
    text = _column(text)
    found = [F.when(text.contains(n), F.lit(n)) for n in names]
    return F.coalesce(*found, text)


def recode(text: Column | str, changes: dict[str, str]) -> Column:
    """Whole-value replacement; values not listed stay as they are."""
    text = _column(text)
    entries = [F.lit(part) for pair in changes.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), text), text)


def split_part(text: Column | str, sep: str, index: int) -> Column:
    """The index-th piece (from 1); null when there are fewer pieces."""
    pieces = F.split(_column(text), "\\Q" + sep + "\\E")
    return F.try_element_at(pieces, F.lit(index))


def split_list(text: Column | str, sep: str = ",") -> Column:
    return F.split(_column(text), "\\Q" + sep + "\\E")


def table_rows_html(rows: list[tuple[str, Column]]) -> Column:
    """A bordered two-column HTML table: a label and a value in each row."""
    # The markup of a pop-up.
    pattern = "".join(f"<tr><td>{label} &nbsp</td><td>%s</td></tr>" for label, _ in rows)
    return F.format_string(
        "<table  border='1'>" + pattern + "</table>", *[value for _, value in rows]
    )


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
