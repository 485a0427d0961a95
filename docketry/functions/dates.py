"""Column functions over dates written in legal texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docketry.functions.text import NULL_WORDS, WHITE, strip

# Words that stand for no date.
NO_DATE = ("none", "null", "unknown", "đã biết", "không xác định")
# Words that mean the present.
NOW_WORDS = ("hiện nay", "hiện tại", "bây giờ", "thời điểm này", "mới nhất", "hiện hành")

# Dates in numbers and in words.
DAY_FIRST = r"(?<![\p{L}\p{N}_])(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?![\p{L}\p{N}_])"
YEAR_FIRST = r"(?<![\p{L}\p{N}_])(\d{4})[/.-](\d{1,2})[/.-](\d{1,2})(?![\p{L}\p{N}_])"
WORDED = rf"(?iu)ngày{WHITE}+(\d{{1,2}}){WHITE}+tháng{WHITE}+(\d{{1,2}}){WHITE}+năm{WHITE}+(\d{{4}})"


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts of digits; null if one is empty or the calendar has no such day."""
    parts = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.try_to_timestamp(F.when((year != "") & (month != "") & (day != ""), parts), F.lit("yyyy-MM-dd")).cast("date")


def _found(text: Column, pattern: str, order: str) -> tuple[Column, Column]:
    """(whether the pattern occurs, its date)."""
    part = {c: F.regexp_extract(text, pattern, k + 1) for k, c in enumerate(order)}
    return F.coalesce(text.rlike(pattern), F.lit(False)), calendar_date(part["y"], part.get("m", F.lit("1")), part.get("d", F.lit("1")))


def parse_legal_date(text: Column) -> Column:
    """The first d/m/y anywhere, else the first y-m-d; null for no date, words for none, and days that do not exist."""
    text = F.when(~F.lower(strip(text)).isin("", *NO_DATE), text)
    day_first, a = _found(text, DAY_FIRST, "dmy")
    _, b = _found(text, YEAR_FIRST, "ymd")
    return F.when(day_first, a).otherwise(b)


def recover_dates(issued: Column, effective: Column, body: Column) -> tuple[Column, Column]:
    """Issue date and effective date.

    The issue field may hold the effective date after "Ngày hiệu lực:"; else it is in its own field; else in the body: from the day of signing (the issue
    date), from a worded day, or the first worded day of the enforcement block.
    """
    flat = lambda c: F.regexp_replace(c, r"[\r\n\t]+", " ")
    parts = F.split(flat(issued), rf"(?iu)Ngày{WHITE}+hiệu{WHITE}+lực:")
    issue = parse_legal_date(parts[0])
    body = F.coalesce(body, F.lit(""))
    # What says from which day a law is in force, and the block that does.
    force = rf"có{WHITE}+hiệu{WHITE}+lực{WHITE}+(?:thi{WHITE}+hành{WHITE}+)?(?:kể{WHITE}+)?từ{WHITE}+"
    signing = F.when(body.rlike(rf"(?iu){force}ngày{WHITE}+ký"), issue)
    _, worded = _found(body, rf"(?iu){force}" + WORDED.removeprefix("(?iu)"), "dmy")
    block = F.regexp_extract(body, rf"(?ius)(Hiệu{WHITE}+lực{WHITE}+thi{WHITE}+hành.*?(?:Điều{WHITE}+\d+|\z))", 1)
    _, first = _found(block, WORDED, "dmy")
    return issue, F.coalesce(parse_legal_date(F.get(parts, F.lit(1))), parse_legal_date(flat(effective)), signing, worded, first)


def legal_status(declared: Column, effective: Column) -> Column:
    """The declared status, else "Còn hiệu lực" with an effective date, else "unknown"."""
    said = strip(F.regexp_replace(declared, r"[\r\n\t]+", " "))
    return F.coalesce(F.when(~F.lower(said).isin(*NULL_WORDS), said), F.when(effective.isNotNull(), "Còn hiệu lực"), F.lit("unknown"))


def status_as_of(declared: Column, effective: Column, as_of: Column) -> Column:
    """C7, first version: without a declared status, "Chưa có hiệu lực" if the effective date is after ``as_of``."""
    said = strip(F.regexp_replace(declared, r"[\r\n\t]+", " "))
    ahead = F.when(effective > as_of, "Chưa có hiệu lực").when(effective.isNotNull(), "Còn hiệu lực")
    return F.coalesce(F.when(~F.lower(said).isin(*NULL_WORDS), said), ahead, F.lit("unknown"))


def temporal_intent(question: Column, as_of: Column) -> Column:
    """The day a question asks about: words for now -> ``as_of``; a worded day; d/m/y; a month -> its first day; a year -> its last day; else null."""
    q = F.lower(F.coalesce(question, F.lit("")))
    now = F.lit(False)
    for word in NOW_WORDS:
        now = now | q.contains(word)
    _, day = _found(q, WORDED, "dmy")
    _, slashed = _found(q, DAY_FIRST, "dmy")
    # A month and a year in words.
    _, month = _found(q, rf"tháng{WHITE}+(\d{{1,2}})(?:{WHITE}*[/.-]{WHITE}*|{WHITE}+năm{WHITE}+)(\d{{4}})", "my")
    year = F.regexp_extract(q, rf"năm{WHITE}+(\d{{4}})", 1)
    return F.when(now, as_of).otherwise(F.coalesce(day, slashed, month, calendar_date(year, F.lit("12"), F.lit("31"))))
