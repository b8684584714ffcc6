"""Scalar functions on columns: trimming, numbers, prices, dates, booleans, hashes. All native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as JavaScript has it.
SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: Words that mean true (fixed value).
TRUE_WORDS = ("yes", "true", "1", "on", "available", "in stock", "active")
#: Signs and codes that may lead a price (fixed value).
CURRENCY = r"(?i)^([$€£¥₹]|USD|EUR|GBP|JPY|INR)"
#: Milliseconds of the units of relative dates (fixed values).
UNIT_MS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
MONTHS = r"(?i)(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
#: Further forms of a whole text, and the groups that hold its year, month and day (0: the first).
OTHER_DATES = (
    (r"(\d{4})", 1, 0, 0),
    (r"(\d{4})-(\d{2})", 1, 2, 0),
    (r"(\d{4})/(\d{1,2})/(\d{1,2})", 1, 2, 3),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", 3, 1, 2),
    (r"(\d{1,2})/(\d{1,2})/(\d{2})", 3, 1, 2),
    (r"(\d{1,2})-([a-z]{3,9})-(\d{4})", 3, 2, 1),
    (r"([a-z]{3,9})-(\d{1,2})-(\d{4})", 3, 1, 2),
    (r"([a-z]{3,9})\.? (\d{4})", 2, 1, 0),
    (r"(\d{4}) ([a-z]{3,9}) (\d{1,2})", 1, 2, 3),
)
CLOCK = r"(?:,? +(\d{1,2}):(\d{2})(?::(\d{2}))?(?: *([ap])m)?(?: *(?:utc|gmt|z))?)?"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse_whitespace(c: Column) -> Column:
    return trim(F.regexp_replace(c, f"{SPACE}+", " "))


def strip_html(c: Column) -> Column:
    return trim(F.regexp_replace(c, "<[^>]+>", ""))


def regex(c: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match; null without a match, and where the group took no part in it."""
    found = F.regexp_extract(c, pattern, group)
    if not group:
        return F.when(c.rlike(pattern), found)
    # A reference to a group that took no part fails, and what a group holds stands at the match or after it.
    took_part = F.regexp_instr(c, F.lit(f"(?={pattern})(?=[\\s\\S]*?\\{group})")) == F.regexp_instr(c, F.lit(pattern))
    return F.when(c.rlike(pattern) & ((found != "") | took_part), found)


def replace(c: Column, search: str, replacement: str) -> Column:
    """Replace every match; $1 and $& name groups, $$ is a dollar."""
    java = replacement.replace("\\", "\\\\").replace("$$", "\0").replace("$&", "$0").replace("\0", "\\$")
    return F.regexp_replace(c, search, java)


def parse_number(c: Column) -> Column:
    x = F.regexp_replace(c, r"[^\d.,\-]", "")
    grouped = x.rlike(r"^\d{1,3}(\.\d{3})+(,\d{1,2})?$")
    plain = F.when(grouped, F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(x, F.lit(","), F.lit("")))
    head = F.regexp_extract(plain, r"^-?(\d+\.?\d*|\.\d+)", 0)
    return F.when(head != "", head).try_cast("double")


def parse_price(c: Column) -> Column:
    amount = parse_number(c)
    currency = F.regexp_extract(c, CURRENCY, 1)
    return F.when(amount.isNotNull(), F.struct(amount.alias("amount"), F.when(currency != "", currency).alias("currency")))


def parse_boolean(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lower(trim(c)).isin(*TRUE_WORDS))


def other_date(c: Column) -> Column:
    """Time of a text that is a date in one of ``OTHER_DATES``, with a time of day or without; years of two digits are
    those from 1950 to 2049. Null for all else, for days that no month has too."""
    x = F.lower(c)

    def at(form: str, year: int, month: int, day: int) -> Column:
        whole = f"^{form}{CLOCK}$"
        clock = max(year, month, day)
        part = lambda k: F.regexp_extract(x, whole, k)
        y, m = part(year), part(month) if month else F.lit("1")
        y = F.when(F.length(y) > 2, y).otherwise(F.concat(F.when(y < "50", "20").otherwise("19"), y))
        m = F.when(m.rlike(r"^\d"), m).when(m.rlike(f"^{MONTHS}$"), ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.left(m, F.lit(3))) + 2) / 3).cast("int").cast("string"))
        hour = part(clock + 1).try_cast("int")
        half = part(clock + 4)
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(-1)
        said = F.concat_ws(" ", y, m, part(day) if day else F.lit("1"), F.when(part(clock + 1) == "", "0").otherwise(hour.cast("string")), *(F.when(part(clock + k) == "", "0").otherwise(part(clock + k)) for k in (2, 3)))
        return F.when(x.rlike(whole) & m.isNotNull(), F.try_to_timestamp(said, F.lit("yyyy M d H m s")))

    return F.coalesce(*(at(*form) for form in OTHER_DATES))


def parse_date(c: Column, now: Column | None = None) -> Column:
    """ISO text in UTC of the first date pattern that fits; ``now`` is what relative dates count from."""
    x = trim(c)
    now = F.current_timestamp() if now is None else now

    def at(text: Column, form: str) -> Column:
        return F.try_to_timestamp(text, F.lit(form))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(x, pattern, group)

    iso, us = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{4})"
    mdy, dmy = r"(\w+)\s+(\d{1,2}),?\s+(\d{4})", r"(\d{1,2})\s+(\w+)\s+(\d{4})"
    ago = r"(?i)(\d+)\s+(second|minute|hour|day|week|month|year)s?\s+ago"

    def named(pattern: str, month: int, day: int) -> Column:
        word = part(pattern, month)
        return F.when(word.rlike(f"^{MONTHS}$"), at(F.concat_ws(" ", F.initcap(F.substring(word, 1, 3)), part(pattern, day), part(pattern, 3)), "MMM d yyyy"))

    unit = F.lower(part(ago, 2))
    ms = F.when(unit == "second", UNIT_MS["second"])
    for name, n in list(UNIT_MS.items())[1:]:
        ms = ms.when(unit == name, n)
    relative = F.timestamp_millis(F.unix_millis(now) - part(ago, 1).try_cast("bigint") * ms)
    found = F.coalesce(
        F.when(x.rlike(iso), at(part(iso, 0), "yyyy-MM-dd")),
        F.when(x.rlike(us), at(F.concat_ws("-", part(us, 3), F.lpad(part(us, 1), 2, "0"), F.lpad(part(us, 2), 2, "0")), "yyyy-MM-dd")),
        F.when(x.rlike(mdy), named(mdy, 1, 2)),
        F.when(x.rlike(dmy), named(dmy, 2, 1)),
        F.when(x.rlike(ago), relative),
        other_date(x),
    )
    return F.date_format(found, ISO)


def hash_content(c: Column) -> Column:
    return F.sha2(c, 256)


def js_number(c: Column) -> Column:
    """A double as JavaScript prints it: the shortest digits, plain from 1e-6 up to 1e21, else with an exponent."""
    said = c.cast("string")
    size = F.abs(c)

    def plain(kind: str) -> Column:
        # A decimal holds all digits of the size it is for; the zeros behind them go, and a point with none.
        return F.rtrim(F.rtrim(said.cast(kind).cast("string"), F.lit("0")), F.lit("."))

    # The common cases need none of the digits' work.
    return (
        F.when((c == F.floor(c)) & (size < 1e15), c.cast("bigint").cast("string")).when((size >= 1e-3) & (size < 1e7), said)
        .when((size >= 1e7) & (size < 1e21), plain("decimal(38,16)")).when((size >= 1e-6) & (size < 1e-3), plain("decimal(38,24)"))
        .otherwise(F.regexp_replace(F.regexp_replace(said, r"(?:\.0)?E(?=\d)", "e+"), r"(?:\.0)?E", "e"))
    )


def js_text(c: Column, kind: str = "string") -> Column:
    """A value as JavaScript prints it: null is empty, whole numbers have no fraction, structs are objects."""
    if kind in ("double", "float"):
        return F.coalesce(js_number(c.cast("double")), F.lit(""))
    if kind.startswith("struct"):
        return F.when(c.isNull(), "").otherwise("[object Object]")
    return F.coalesce(c.cast("string"), F.lit(""))


def record_id(values: list[Column]) -> Column:
    """Content-addressed id: 16 hex digits of the SHA-256 of the key values joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *values), 256), 1, 16)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n - 3)), F.lit("..."))).otherwise(c)


def round2(c: Column) -> Column:
    return F.floor(c * 100 + 0.5) / 100


def domain(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("HOST")), c)


def new_id() -> Column:
    return F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 12)
