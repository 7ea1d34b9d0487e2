"""Scalar functions as columns. Rounding is half up towards +infinity, as in floor(x + 0.5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def falsy(c: Column, default: str) -> Column:
    """A text with null and '' replaced."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def number(c: Column) -> Column:
    """null counts as 0."""
    return F.coalesce(c, F.lit(0))


def iso_seconds(c: Column) -> Column:
    """PT#H#M#S in seconds; what doesn't match is 0. All parts are optional, days aren't known."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(c, r"PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?", i), F.lit("")).try_cast("int"), F.lit(0))
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def local_date(ts: Column, hours: int = 9) -> Column:
    return F.to_date(ts + F.expr(f"INTERVAL {hours} HOURS"))


def local_day_start(ts: Column, hours: int = 9) -> Column:
    """The beginning of the local day, in UTC."""
    shift = F.expr(f"INTERVAL {hours} HOURS")
    return F.date_trunc("day", ts + shift) - shift


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def days_between(later: Column, earlier: Column, rounded: bool = True) -> Column:
    seconds = (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000
    return half_up(seconds) if rounded else F.floor(seconds)


def _tenth(x: Column) -> Column:
    return F.regexp_replace(x.cast("decimal(30,10)").cast("decimal(30,1)").cast("string"), r"\.0$", "")


def compact(n: Column, thousands: bool = False) -> Column:
    """억 and 만 (and 천) with one decimal, which is left out where it is 0."""
    n = F.coalesce(n.cast("double"), F.lit(0.0))
    out = F.when(n >= 100_000_000, F.concat(_tenth(n / 100_000_000), F.lit("억"))).when(n >= 10_000, F.concat(_tenth(n / 10_000), F.lit("만")))
    if thousands:
        return out.when(n >= 1000, F.concat(_tenth(n / 1000), F.lit("천"))).otherwise(F.regexp_replace(n.cast("decimal(30,3)").cast("string"), r"\.?0+$", ""))
    return out.otherwise(F.format_number(n, 0))


def won(n: Column) -> Column:
    n = half_up(F.coalesce(n.cast("double"), F.lit(0.0))).cast("double")
    return (
        F.when(n >= 100_000_000, F.concat((n / 100_000_000).cast("decimal(30,10)").cast("decimal(30,1)").cast("string"), F.lit("억원")))
        .when(n >= 10_000, F.concat(F.format_number(half_up(n / 10_000), 0), F.lit("만원")))
        .otherwise(F.concat(F.format_number(n, 0), F.lit("원")))
    )


def grade(daily_views: Column) -> Column:
    out = F.when(daily_views.isNull(), "")
    for name, least in V.GRADES:
        out = out.when(daily_views >= least, name)
    return out.otherwise("D")


def channel_type(short_share: Column) -> Column:
    return F.when(short_share.isNull(), V.NONE).when(short_share >= V.SHORT_SHARE, V.SHORT).when(short_share <= V.LONG_SHARE, V.LONG).otherwise(V.MIXED)


def revenue(daily_views: Column, kind: Column) -> Column:
    """Estimated won a day; null without a rise."""
    rates = F.create_map(*[F.lit(x) for pair in V.RATE.items() for x in pair])
    return F.when(daily_views > 0, daily_views * F.coalesce(F.element_at(rates, kind), F.lit(V.RATE[V.NONE])))


def clock(ms: Column) -> Column:
    """m:ss of milliseconds."""
    s = half_up(ms / 1000).cast("long")
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def seconds_label(s: Column) -> Column:
    s = s.cast("long")
    return F.concat((s / 60).cast("long").cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def date_label(ts: Column, as_of: Column) -> Column:
    return F.when(F.to_date(ts) == F.to_date(as_of), F.date_format(ts, "HH:mm")).otherwise(F.date_format(ts, "yyyy.MM.dd"))


_ENTITIES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def escape_html(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ENTITIES, c)


def unescape_html(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), _ENTITIES[::-1], c)


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]+>", "")


def video_id(url: Column) -> Column:
    """An 11-character id; the text itself if it is one, null if there is none."""
    return F.when(url.rlike(r"^[A-Za-z0-9_-]{11}$"), url).otherwise(F.nullif(F.regexp_extract(url, V.VIDEO_ID, 1), F.lit("")))


def host(url: Column) -> Column:
    return F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", "")


def platform(site: Column, url: Column) -> Column:
    hay = F.concat_ws("\n", site, url)
    out = None
    for name, marks in V.PLATFORMS:
        hit = reduce(lambda a, b: a | b, [F.contains(hay, F.lit(m)) for m in marks])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(F.coalesce(host(url), F.lit(V.NO_PLATFORM)))


def category(genre: Column) -> Column:
    out = F.when(genre.isNull() | (genre == "") | genre.isin(V.NO_GENRE), F.lit(None).cast("string"))
    for name, pattern in V.CATEGORY_PATTERNS:
        out = out.when(genre.rlike(pattern), name)
    return out


def first_match(c: Column, rules: list[tuple[str, str]]) -> Column:
    out = F.when(c.rlike(rules[0][1]), rules[0][0])
    for name, pattern in rules[1:]:
        out = out.when(c.rlike(pattern), name)
    return out


def tidy(c: Column, most: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(c, r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def letters_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z가-힣]", "")


def wrapped(c: Column, width: int = 12, lines: int = 3) -> Column:
    """Words filled into lines of at most width characters (longer words stand alone), the first few of them."""
    words = F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(state, w):
        joined = F.trim(F.concat(state["line"], F.lit(" "), w))
        full = (F.length(joined) > width) & (state["line"] != "")
        return F.struct(F.when(full, F.array_append(state["done"], state["line"])).otherwise(state["done"]).alias("done"), F.when(full, w).otherwise(joined).alias("line"))

    return F.aggregate(words, start, add, lambda s: F.array_join(F.slice(F.when(s["line"] != "", F.array_append(s["done"], s["line"])).otherwise(s["done"]), 1, lines), "\n"))


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.8, "상").when(p >= 0.5, "중").otherwise("하")


def short_confidence(seconds: Column) -> Column:
    return F.when(seconds == 0, "알수없음").when(seconds <= 60, "높음").when(seconds <= 180, "중간").otherwise("낮음")


def clamp(x: Column, low, high) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def clamp10(x: Column) -> Column:
    return clamp(half_up(F.coalesce(x.cast("double"), F.lit(0.0))), 0, 10).cast("int")


def floor16(x: Column) -> Column:
    return F.floor(x / 16) * 16


def snap16(x: Column) -> Column:
    return half_up(x / 16) * 16


def round_to(x: Column, digits: int) -> Column:
    return half_up(x * 10**digits) / 10**digits


def json_between_braces(c: Column) -> Column:
    """The text from the first { to the last }; null without any."""
    return F.nullif(F.regexp_extract(c, r"(\{[\s\S]*\})", 1), F.lit(""))


def percent_encoded(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def handle(c: Column) -> Column:
    return F.when(c.startswith("@"), c).otherwise(F.concat(F.lit("@"), c))


def nickname(meta: Column, email: Column, default: str = "회원") -> Column:
    return F.coalesce(F.nullif(meta, F.lit("")), F.nullif(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("")), F.lit(default))


def extension(name: Column, default: str = "mp4") -> Column:
    return falsy(F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)), default)


def frame_rate(rational: Column, default: float = 30.0) -> Column:
    """a/b as a number above 0 and up to 120, else the default."""
    a, b = F.split_part(rational, F.lit("/"), F.lit(1)).try_cast("double"), falsy(F.split_part(rational, F.lit("/"), F.lit(2)), "1").try_cast("double")
    f = F.try_divide(a, b)
    return F.when((f > 0) & (f <= 120), f).otherwise(default)


def numbers_after(c: Column, key: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(key + r"[:=]\s*(-?[0-9.]+)"), F.lit(1)), lambda x: x.try_cast("double"))


def warnings(**conditions: Column) -> Column:
    return F.filter(F.array(*[F.when(c, name) for name, c in conditions.items()]), lambda x: x.isNotNull())


def any_of(c: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words]), F.lit(False))


def is_video_site(url: Column) -> Column:
    return any_of(url, V.VIDEO_SITES)


def is_listing(url: Column) -> Column:
    return F.coalesce(F.when(url.rlike(V.TIKTOK), ~url.rlike(V.TIKTOK_VIDEO)).otherwise(url.rlike(V.LISTINGS)), F.lit(False))


def rights_notice(*parts: Column) -> Column:
    return F.when(any_of(F.concat_ws(" ", *parts), V.RISKY_RIGHTS), V.RIGHTS_CAREFUL).otherwise(V.RIGHTS_CHECK)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap of two boxes x0, y0, x1, y1 as a share of their union."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    area = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
    return F.coalesce(F.try_divide((w * h).cast("double"), (area(a) + area(b) - w * h).cast("double")), F.lit(0.0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column) -> Column:
    """64 numbers as a 64-bit fingerprint: bit i is set where number i is above 0."""
    bits = F.transform(F.slice(vector, 1, 63), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    top = F.when(F.element_at(vector, 64) > 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).bitwiseOR(top)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def difference_hash(grey: Column, width: int = 9, height: int = 8) -> Column:
    """64 bits of a width x height grey image, row by row: bit set where a pixel is brighter than its right neighbour."""
    out = F.lit(0).cast("long")
    for i in range(height * (width - 1)):
        y, x = divmod(i, width - 1)
        bit = -(1 << 63) if i == 63 else 1 << i
        out = out.bitwiseOR(F.when(F.element_at(grey, y * width + x + 1) > F.element_at(grey, y * width + x + 2), F.lit(bit)).otherwise(F.lit(0).cast("long")))
    return out
