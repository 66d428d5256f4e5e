"""Scalar helpers that records share, all native: null where the source does not say, never a guess."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom.functions.bind import let

# The characters that count as white space, as a regular expression's class.
SPACE = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
# Words of work places.
REMOTE_WORDS = ("remote", "fully", "telecommuting")
ONSITE_WORDS = ("onsite", "on_site", "none", "office")


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(c, F.lit(""))


def trimmed(c: Column) -> Column:
    return filled(strip(c))


def tidy(c: Column) -> Column:
    """White space collapsed, nothing left is null."""
    return trimmed(F.regexp_replace(c, f"{SPACE}+", " "))


def leading_number(c: Column) -> Column:
    """The number that a text begins with, as double."""
    return _cast(F.regexp_extract(c, rf"^{SPACE}*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1))


def _cast(c: Column, kind: str = "double") -> Column:
    return filled(c).try_cast(kind)


def leading_int(c: Column) -> Column:
    return _cast(F.regexp_extract(c, rf"^{SPACE}*([+-]?\d+)", 1), "long")


def fixed2(c: Column) -> Column:
    return F.when(c.isNotNull(), F.format_string("%.2f", c))


def money(c: Column) -> Column:
    """A price stays the text that it came as."""
    return filled(c)


def compare_at_price(c: Column) -> Column:
    """A price of nothing is no price."""
    return F.when(F.coalesce(leading_number(c) == 0, F.lit(False)), none()).otherwise(money(c))


def variant_available(v: Column) -> Column:
    """What is said, else whether stock is tracked, may be oversold, or is there; null if nothing tells."""
    return (
        F.when(v["available"].isNotNull(), v["available"])
        .when(filled(v["inventory_management"]).isNull(), F.lit(True))
        .when(v["inventory_policy"] == "continue", F.lit(True))
        .otherwise(v["inventory_quantity"] > 0)
    )


def tags(c: Column) -> Column:
    """A JSON array of texts as it is, a text cut at commas; anything else is no tags."""
    cut = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.coalesce(F.when(c.startswith("["), F.from_json(c, "array<string>")), cut, F.array().cast("array<string>"))


def epoch_iso(seconds: Column) -> Column:
    return iso_millis((seconds * 1000).cast("long"))


def iso_millis(ms: Column) -> Column:
    """Milliseconds since 1970 as an ISO text in UTC, by arithmetic alone: the session's zone has no say."""
    day, rest = F.floor(ms / F.lit(86_400_000)), F.pmod(ms, F.lit(86_400_000))
    part = lambda unit, most: (F.floor(rest / F.lit(unit)) % most).cast("long")
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string")
    return F.when(ms.isNotNull(), F.format_string("%sT%02d:%02d:%02d.%03dZ", date, part(3_600_000, 24), part(60_000, 60), part(1000, 60), part(1, 1000)))


def iso_instant(at: Column) -> Column:
    return iso_millis(F.unix_millis(at))


# Months, and zones by name with their hours.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {"utc": 0, "gmt": 0, "ut": 0, "z": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_ISO = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,3})\d*)?)?\s*([Zz]|UTC|[+-]\d{2}:?\d{2})?)?$"
_CLOCK = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3})\d*)?)?"
_HALF = r"^\s*([ap])\.?m\b\.?"
_ZONE = rf"(?<![a-z])(?:{'|'.join(ZONES)})(?![a-z])"
_SHIFT = r"([+-])(\d{2}):?(\d{2})(?!\d)"


def _number(c: Column, default: int | None = None) -> Column:
    n = _cast(c, "int")
    return n if default is None else F.coalesce(n, F.lit(default))


def _shift(c: Column) -> Column:
    """Minutes east of UTC that +hhmm or +hh:mm says, null without one."""
    at = lambda k: F.regexp_extract(c, _SHIFT, k)
    return F.when(at(1) != "", (_number(at(2)) * 60 + _number(at(3))) * F.when(at(1) == "-", -1).otherwise(1))


def _milliseconds(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column, milli: Column, shift: Column) -> Column:
    """Since 1970 in UTC; null where a part is out of range. Days beyond a month's end go on into the next."""
    names = dict(year=year, month=month, day=day, hour=hour, minute=minute, second=second, milli=milli, shift=shift)

    def of(p: Column) -> Column:
        fits = p["month"].between(1, 12) & p["day"].between(1, 31) & p["year"].between(1, 9999) & (p["hour"] < 24) & (p["minute"] < 60) & (p["second"] < 60)
        first = F.datediff(F.make_date(F.when(fits, p["year"]), F.when(fits, p["month"]), F.lit(1)), F.lit("1970-01-01").cast("date"))
        clock = ((p["hour"] * 60 + p["minute"] - p["shift"]) * 60 + p["second"]).cast("long") * 1000 + p["milli"]
        return (first + p["day"] - 1).cast("long") * 86_400_000 + clock

    return let(F.struct(*[c.alias(n) for n, c in names.items()]), of)


def _padded(c: Column) -> Column:
    """Digits after a point as thousandths."""
    return F.coalesce(_number(F.rpad(filled(c), 3, "0")), F.lit(0))


def _iso_parts(raw: Column) -> Column:
    at = lambda k: F.regexp_extract(raw, _ISO, k)
    return _milliseconds(_number(at(1)), _number(at(2), 1), _number(at(3), 1), _number(at(4), 0), _number(at(5), 0), _number(at(6), 0), _padded(at(7)), F.coalesce(_shift(at(8)), F.lit(0)))


def _written_out(raw: Column) -> Column:
    """Dates as people and mails write them: a clock with a zone, a month by name or first of its numbers, years of two digits between 1950 and 2049."""
    months = "|".join(MONTHS)

    def split(text: Column) -> Column:
        """What stands before the clock, the clock, and what stands after it."""
        clock = F.array(*[F.regexp_extract(text, _CLOCK, k) for k in range(1, 5)])
        timed = text.rlike(_CLOCK)
        before, after = F.when(timed, F.regexp_extract(text, rf"^(.*?){_CLOCK}", 1)).otherwise(text), F.when(timed, F.regexp_extract(text, rf"{_CLOCK}(.*)$", 5)).otherwise("")
        return let(F.struct(clock.alias("clock"), before.alias("before"), after.alias("after")), dated)

    def dated(p: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(p["after"], _HALF, " "), _SHIFT, " ")
        date = F.regexp_replace(F.concat_ws(" ", p["before"], rest), _ZONE, " ")
        return let(F.struct(p["clock"].alias("clock"), p["after"].alias("after"), date.alias("date")), numbered)

    def numbered(p: Column) -> Column:
        month = F.regexp_extract(p["date"], rf"(?<![a-z])({months})[a-z]*", 1)
        left = F.regexp_replace(p["date"], rf"(?<![a-z])(?:{months})[a-z]*\.?", " ")
        return let(F.struct(p["clock"].alias("clock"), p["after"].alias("after"), month.alias("month"), left.alias("left"), F.regexp_extract_all(left, F.lit(r"(\d+)"), F.lit(1)).alias("n")), read)

    def read(p: Column) -> Column:
        part, clock = lambda i: F.get(p["n"], F.lit(i)), lambda i: F.get(p["clock"], F.lit(i))
        strange = F.regexp_replace(p["left"], r"^[^0-9]*", "").rlike("[a-z]")  # words count for nothing before the first number only
        year_first, bare = (F.char_length(part(0)) > 2) | (_number(part(0)) > 31), p["month"] == ""
        by_name = F.coalesce(*[F.when(p["month"] == m, F.lit(i)) for i, m in enumerate(MONTHS, 1)])
        order = lambda a, b, c, d: F.when(bare & year_first, part(a)).when(bare, part(b)).when(year_first, part(c)).otherwise(part(d))
        year, day = order(0, 2, 0, 1), order(2, 1, 1, 0)
        month = F.when(bare & year_first, _number(part(1))).when(bare, _number(part(0))).otherwise(by_name)
        full = _number(year) + F.when(F.char_length(year) > 2, 0).when(_number(year) < 50, 2000).otherwise(1900)
        half, hour = F.regexp_extract(p["after"], _HALF, 1), _number(clock(0), 0)
        hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
        named = F.regexp_extract(F.concat(F.lit(" "), p["after"]), f"({_ZONE})", 1)
        zone = F.coalesce(*[F.when(named == n, F.lit(h * 60)) for n, h in ZONES.items() if h], F.lit(0))
        ms = _milliseconds(full, month, _number(day), hour, _number(clock(1), 0), _number(clock(2), 0), _padded(clock(3)), F.coalesce(_shift(p["after"]), zone))
        return F.when(~strange & (F.size(p["n"]) == F.when(bare, 3).otherwise(2)), ms)

    return let(F.regexp_replace(F.lower(raw), r"\([^()]*\)", " "), split)


def iso_date(c: Column, number: Column | None = None) -> Column:
    """Dates as ISO texts in UTC: milliseconds, a day alone (kept as it is), ISO forms, mail dates, dates as people write them; else null.

    A time without a zone counts as UTC, whatever the session's zone; with numbers alone the month comes first, unless the year does.
    What has the form of a day isn't held against the calendar. Texts of more than 200 characters are no dates.
    """

    def text(raw: Column) -> Column:
        ms = F.when(raw.rlike(_ISO), _iso_parts(raw)).when(F.char_length(raw) <= 200, _written_out(raw))
        return F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), raw).otherwise(let(ms, iso_millis))

    said = let(strip(c), text)
    return said if number is None else F.coalesce(F.when(number.isNotNull(), iso_millis(number.cast("long"))), said)


def is_remote(c: Column) -> Column:
    """true or false where the word says so, null for hybrid and for words that say nothing."""
    word = F.regexp_replace(F.lower(strip(c)), rf"(?:{SPACE}|-)+", "")
    bare = F.replace(word, F.lit("_"), F.lit(""))
    return F.when(word.isin(*REMOTE_WORDS) | bare.isin(*REMOTE_WORDS), F.lit(True)).when(word.isin(*ONSITE_WORDS) | bare.isin(*ONSITE_WORDS), F.lit(False))


def join_location(*parts: Column) -> Column:
    kept = F.array_distinct(F.array_compact(F.array(*[trimmed(p) for p in parts])))
    return filled(F.array_join(kept, ", "))


def texts(c: Column) -> Column:
    """An array's texts, trimmed, without the empty ones."""
    return F.array_compact(F.transform(F.coalesce(c, F.array().cast("array<string>")), trimmed))


def vin_value(c: Column) -> Column:
    return trimmed(c)


def vin_error_codes(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: (x != "") & (x != "0"))


def npi_part(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "--", t)


def npi_name(organization: Column, *parts: Column) -> Column:
    """An organisation's name, else the parts of a person's in order."""
    person = filled(F.concat_ws(" ", *[npi_part(p) for p in parts]))
    return F.when(filled(organization).isNotNull(), npi_part(organization)).otherwise(person)


def npi_yes_no(c: Column) -> Column:
    return F.when(c == "YES", F.lit(True)).when(c == "NO", F.lit(False))


def query_int(url: Column, name: str) -> Column:
    """An integer from a URL's query, null without one."""
    return leading_int(F.try_parse_url(url, F.lit("QUERY"), F.lit(name)))


def ld_number(c: Column) -> Column:
    """A price written with thousands commas, a decimal comma or a currency."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[^\d.,-]", ""), r",(?=\d{3}(?!\w))", "")
    return _cast(F.regexp_replace(digits, r"^([^,]*),", "$1."))


def availability(c: Column) -> Column:
    return F.when(c.rlike("(?i)InStock|PreOrder|BackOrder|LimitedAvailability|OnlineOnly"), F.lit(True)).when(c.rlike("(?i)OutOfStock|SoldOut|Discontinued"), F.lit(False))


def points(c: Column) -> Column:
    """`12 points` is 12."""
    return _cast(F.regexp_extract(strip(c), rf"(?i)^(\d+){SPACE}*points?$", 1), "long")


def comments(c: Column) -> Column:
    """`12 comments` is 12, `discuss` is 0, anything else is not known."""
    return F.when(F.lower(strip(c)) == "discuss", F.lit(0).cast("long")).otherwise(_cast(F.regexp_extract(strip(c), rf"(?i)^(\d+){SPACE}*comments?$", 1), "long"))


def rating(c: Column) -> Column:
    """Of the numbers in a text the first that isn't the scale's 5."""
    numbers = F.transform(F.regexp_extract_all(tidy(c), F.lit(r"(\d+(?:[.,]\d+)?)"), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.when(F.size(numbers) == 1, F.get(numbers, F.lit(0))).when(F.size(numbers) > 1, F.coalesce(F.get(F.filter(numbers, lambda x: x != 5), F.lit(0)), F.lit(5.0)))


def count_of(c: Column) -> Column:
    return _cast(F.regexp_replace(c, r"[^0-9]", ""), "long")


def exact_count(c: Column) -> Column:
    """`1,234` is 1234; a rounded count (`32.4k`) is not known."""
    digits = strip(F.replace(c, F.lit(","), F.lit("")))
    return F.when(digits.rlike(r"^\d+$"), digits.try_cast("long"))


def full_size_image(c: Column) -> Column:
    """The picture without its size token; placeholders are none."""
    return F.when(~c.rlike(r"transparent-pixel|/x-locale/common/"), F.regexp_replace(filled(c), r"(?i)\._[^/]*_\.(jpe?g|png|gif)$", ".$1"))


def reddit_post_id(c: Column) -> Column:
    return filled(F.regexp_extract(c, r"(?i)/comments/([a-z0-9]+)", 1))


def github_repo_name(c: Column) -> Column:
    return filled(F.regexp_replace(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/[^/?#]+/([^/?#]+)", 1), r"(?i)\.git$", ""))


def spdx(spdx_id: Column, name: Column) -> Column:
    return F.coalesce(F.when(spdx_id != "NOASSERTION", filled(spdx_id)), filled(name))
