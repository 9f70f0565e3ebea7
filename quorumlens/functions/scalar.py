"""Column helpers with the semantics of the application being analysed (JavaScript numbers and strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The enumerations of the data model.
PLATFORMS = ("instagram", "tiktok", "linkedin")
ROLES = ("target", "competitor")
STATUSES = ("pending", "scraping", "categorizing", "computing", "synthesizing", "rendering", "done", "failed")
CATEGORIES = ("collaboration", "campaign", "paid_promotion", "product", "testimonial", "educational", "other")
MEDIA_TYPES = ("image", "video", "reel", "carousel", "article", "document", "text")
COLLAB = ("collaboration", "paid_promotion")
SPACE = r"[\s\x0b\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
WINDOW_DAYS, LEGACY_DAYS, COMPETITORS, LEGACY_COMPETITORS = 90, 30, 3, 5
LOW_FOLLOWERS, LOW_INTERACTIONS = 1000, 10
HISTORY_DAYS, STUCK_MINUTES, POST_LIMIT = 31, 30, 1000


def js_round(x: Column, digits: int = 2) -> Column:
    """Rounds halves towards plus infinity, at `digits` decimals."""
    factor = float(10**digits)
    return F.floor(x * F.lit(factor) + F.lit(0.5)) / F.lit(factor)


def ratio(a: Column, b: Column) -> Column:
    """a / b as double; null where b is null or not above 0 (division by zero raises under ANSI)."""
    return F.when(b > 0, a.cast("double") / b.cast("double"))


def js_trim(s: Column) -> Column:
    """All Unicode white space off both ends."""
    return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")


def strip_handle(s: Column) -> Column:
    """Trimmed, without one leading @; case stays."""
    return F.regexp_replace(js_trim(s), "^@", "")


def legacy_handle(s: Column) -> Column:
    """The earlier prototype's rule: every leading @ goes."""
    return F.regexp_replace(js_trim(s), "^@+", "")


def blank(s: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(~s.rlike(f"[^{SPACE[1:]}"), F.lit(True))


def monday(ts: Column) -> Column:
    """Date of the week's Monday (the session's time zone is UTC)."""
    return F.to_date(F.date_trunc("week", ts))


def number_text(x: Column) -> Column:
    """A number of four decimals at most as plain text, without an exponent or zeros at its end; null from 1e34 on."""
    return F.regexp_replace(x.try_cast("decimal(38,4)").cast("string"), r"\.?0+$", "")


def _tie(x: Column, digits: int) -> tuple[Column, Column, Column]:
    """Of a number x >= 0: whether its decimal text ends in a 5 behind `digits` decimals, the integer below x times
    10 ** digits, and the sign of what the binary number is over that half: only its exact value tells a tie."""
    factor = float(10**digits)
    scaled = x.cast("decimal(38,15)") * F.lit(10**digits)
    whole = F.floor(scaled)
    # x is split in halves of 26 bits, whose products with the factor are exact
    big = x * F.lit(float(2**27 + 1))
    high = big - (big - x)
    over = (high * F.lit(factor) - (whole.cast("double") + 0.5)) + (x - high) * F.lit(factor)
    return scaled - whole == F.lit("0.5").cast("decimal(2,1)"), whole, over


def _nearest(x: Column, digits: int, at_tie: Column, whole: Column, half: Column, over: Column) -> Column:
    """x >= 0 to `digits` decimals by its exact value; at_tie: the integer of an exact tie."""
    factor = F.lit(float(10**digits))
    chosen = F.when(over > 0, whole + 1).when(over < 0, whole).otherwise(at_tie)
    return F.when(half, chosen.cast("double") / factor).otherwise(F.bround(x, digits))


def py_round(x: Column, digits: int = 0) -> Column:
    """The earlier prototype's rounding: the decimal nearest to the exact binary value, exact ties to even; so 2.675,
    which is a little less than it says, gives 2.67."""
    size = F.abs(x)
    half, whole, over = _tie(size, digits)
    return F.signum(x) * _nearest(size, digits, whole + F.pmod(whole, F.lit(2)), whole, half, over)


def to_fixed(x: Column, digits: int) -> Column:
    """Text with exactly `digits` decimals of the nearest by exact value, exact ties away from zero."""
    size = F.abs(x)
    half, whole, over = _tie(size, digits)
    text = _nearest(size, digits, whole + 1, whole, half, over).cast(f"decimal(38,{digits})").cast("string")
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), text)


def first_rule(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds, or null."""
    return F.coalesce(*[F.when(condition, name) for condition, name in rules])


def media_type_a(raw: Column) -> Column:
    """Ordered rules of the first platform; null if none fits."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    return first_rule([(t.contains("carousel") | (t == "sidecar"), "carousel"), (t.contains("reel") | (t == "clips"), "reel"), (t.contains("video"), "video"), (t.contains("image") | (t == "photo"), "image")])


def media_type_c(raw: Column) -> Column:
    """Ordered rules of the third platform; null if none fits."""
    t = F.lower(F.coalesce(raw, F.lit("")))
    return first_rule([(t.contains("video"), "video"), (t.contains("image") | t.contains("photo"), "image"), (t.contains("document") | t.contains("pdf"), "document"), (t.contains("article"), "article"), (t.contains("text"), "text")])


#: What counts as a number in text: digits with a point and an exponent, nothing behind them; blanks around are no matter.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def number(text: Column) -> Column:
    """The finite number that a text is, as double, else null: 1200, 1200.0 and 1.2e3 are one and the same; 12d, 5f, NaN
    and Infinity are none; an empty text is 0."""
    found = F.when(js_trim(text) == "", F.lit(0.0)).when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(found) <= F.lit(1.7976931348623157e308), found)


def whole(x: Column) -> Column:
    """A double as bigint, cut towards zero; null beyond its range."""
    return x.try_cast("bigint")


def int_or_zero(x: Column) -> Column:
    """Permissive number as bigint; what isn't one, or isn't in its range, counts as 0."""
    return F.coalesce(whole(number(x)), F.lit(0).cast("bigint"))


def epoch_time(seconds: Column) -> Column:
    """The time so many seconds after 1970, null beyond 8.64e12 on either side, where dates end in the application."""
    return F.when(F.abs(seconds) <= F.lit(8.64e12), F.timestamp_seconds(seconds))


def evaluated(x: Column) -> Column:
    """x, worked out where it stands: a filter above isn't moved below it with x in place of the column's name."""
    return F.when(F.spark_partition_id() >= 0, x)


def low_sample(followers: Column, interactions: Column) -> Column:
    """The warning text, or null."""
    # fixed values: the application's sentence
    text = F.concat(
        F.lit("Reach is small ("), F.format_number(followers, 0), F.lit(" followers, ~"), number_text(js_round(interactions, 1)),
        F.lit(" avg interactions/post) — treat the engagement rate as low-sample and directionally indicative, not a sign of outsized performance."),
    )
    return F.when((followers < LOW_FOLLOWERS) | (interactions < LOW_INTERACTIONS), text)


# Fixed value: the application's text.
GROWTH_GAP = "Fewer than two weekly snapshots are available for this account in the window — growth requires at least two data points and is a data gap here, not a zero."
