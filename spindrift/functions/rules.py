"""Decision rules, scores and texts as columns."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import values as V
from .external import asked
from .scalars import half_up, letters_only


def short_by_length(seconds: Column) -> Column:
    return (seconds > 0) & (seconds <= V.SHORT_SECONDS)


def probe(status: Column) -> Column:
    """What an address says of a short: it answers (true), sends elsewhere (false), or neither (null)."""
    return F.when(status == 200, True).when((status >= 300) & (status < 400), False)


def trending_short(probed: Column, seconds: Column) -> Column:
    """A trending video counts as short if it isn't too long and the probe says so, or is silent and it is short indeed."""
    return (seconds <= V.TRENDING_SECONDS) & F.coalesce(probed, seconds <= V.TRENDING_FALLBACK)


def objective_score(parts: dict[str, Column], context_dep: Column, objective: Column) -> Column:
    """Weighted sum of scores by objective ('views' where it is unknown), to 2 digits; a missing score counts as 0."""
    value = {**parts, "context_indep": 10 - context_dep}
    whole = lambda weights: sum((F.coalesce(value[k], F.lit(0)) * round(w * 100) for k, w in weights.items()), F.lit(0))
    out = F.lit(None)
    for name, weights in V.OBJECTIVES.items():
        if name != "views":
            out = F.coalesce(out, F.when(objective == name, whole(weights)))
    return half_up(F.coalesce(out, whole(V.OBJECTIVES["views"])).cast("double")) / 100


def not_itself(address: Column, own: Column) -> Column:
    """False for addresses that hold the item's own id; without an own id, true."""
    return ~F.coalesce(F.contains(address, own) & (own != ""), F.lit(False))


def truth(value: Column) -> Column:
    """A flag that comes as a text: true for these words only, never null."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "y", "yes", "1"), F.lit(False))


def has_failed(status: Column, mark: str = "failed") -> Column:
    return F.startswith(status, F.lit(mark))


def same_letters(text: Column, edited: Column, low: float = 0.9, high: float = 1.12) -> Column:
    """Whether an edit keeps about as many letters and digits as the text has; a text without any fails."""
    a, b = F.length(letters_only(text)), F.length(letters_only(edited))
    return (a > 0) & (b >= low * a) & (b <= high * a)


def milliseconds(seconds: Column) -> Column:
    return half_up(seconds * 1000)


def frame_span(start: Column, end: Column, fps: float) -> tuple[Column, Column]:
    """First frame and the one after the last of a time on a grid of frames, one frame at least."""
    first = half_up(start * fps)
    return first, F.greatest(first + 1, half_up(end * fps))


def pixel_side(at: Column, size: Column, whole: int, least: int = 8) -> tuple[Column, Column]:
    """Begin and length in pixels of a share of a side, within it and of some pixels at least."""
    begin = F.least(F.lit(whole - least), F.greatest(F.lit(0), half_up(at * whole)))
    return begin, F.least(F.lit(whole) - begin, F.greatest(F.lit(least), half_up(size * whole)))


def is_video_id(c: Column) -> Column:
    return F.coalesce(c.rlike(V.ID_FORM), F.lit(False))


def is_address(c: Column) -> Column:
    return F.coalesce(c.rlike(V.ADDRESS_FORM), F.lit(False))


def is_picture(c: Column) -> Column:
    return F.coalesce(c.rlike(V.PICTURE_FORM), F.lit(False))


def weighted_mean(value: Column, weight: Column) -> Column:
    """An aggregate: mean by weight, whose sum counts as 1 at least."""
    return F.sum(value * weight) / F.greatest(F.lit(1), F.sum(weight))


def progress(done: Column, total: Column) -> Column:
    """Per cent, from 0 to 99: the last one is given at the end."""
    return F.least(F.lit(99), F.greatest(F.lit(0), half_up(done / total * 100))).cast("int")


def medal(place: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[x for i, m in enumerate(V.MEDALS) for x in (F.lit(i + 1), F.concat(F.lit(m + " "), F.lit(f"{i + 1}{V.PLACE}")))]), place.cast("int")), F.concat(place.cast("string"), F.lit(V.PLACE)))


def json_cut(value: Column, n: int) -> Column:
    return F.substring(F.to_json(value), 1, n)


def _hours(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60).cast("string"), (minutes % 60).cast("int").cast("string")
    return F.when(minutes < 60, F.concat(minutes.cast("int").cast("string"), F.lit("분"))).when(minutes % 60 == 0, F.concat(h, F.lit("시간"))).otherwise(F.concat(h, F.lit("시간 "), m, F.lit("분")))


def eta_text(seconds: Column) -> Column:
    """About one to two minutes of work for a minute of film, in steps of 5 from 20 minutes up; empty without a length."""
    step = lambda m: F.when(m >= 20, F.greatest(F.lit(5), half_up(m / 5) * 5)).otherwise(F.greatest(F.lit(1), m))
    low, high = step(half_up(seconds / 60)), step(half_up(seconds / 30))
    high = F.when(high <= low, low + F.when(low >= 20, 5).otherwise(1)).otherwise(high)
    return F.when(seconds > 0, F.concat(F.lit("약 "), _hours(low), F.lit("~"), _hours(high))).otherwise("")


def length_bar(before: Column, after: Column) -> Column:
    """What is left of a length in per cent, 4 at least; 100 without a length."""
    return F.when(before > 0, F.greatest(F.lit(4), half_up(after / before * 100))).otherwise(100).cast("int")


def channel_line(key: Column, title: Column, recent: Column) -> Column:
    """A channel's line of a question: key, name, and titles where there are any."""
    titles = F.array_join(recent, " / ")
    return F.concat(key.cast("string"), F.lit(" | 채널명: "), title, F.when(F.coalesce(titles, F.lit("")) != "", F.concat(F.lit(" | 최근영상: "), titles)).otherwise(""))


def terms_union(a: Column, more: Sequence[str]) -> Column:
    return F.array_union(a, F.array(*map(F.lit, more)))


def fits(fit: Column, seconds: Column, least: int = 70, shortest: int = 8, longest: int = 480) -> Column:
    """Material good enough by the model's judgement and of a usable length."""
    return (fit >= least) & seconds.between(shortest, longest)


def digest_stub(prompts: Sequence[str]) -> list[str]:
    """A stand-in for a multiple-choice model: a category by the prompt's digest, one answer in 16 outside the list."""
    n = [int(hashlib.md5(p.encode()).hexdigest()[:6], 16) % (len(V.CATEGORIES) + 1) for p in prompts]
    return [V.CATEGORIES[i] if i < len(V.CATEGORIES) else "?" for i in n]


def asked_category(df: DataFrame, prompt: str, category: str, model=digest_stub, batch: int = 15) -> DataFrame:
    """A category by a model asked in batches; only answers in the list of categories count (column valid)."""
    rows = asked(df, F.col(prompt), model, batch, "_answer")
    valid = F.coalesce(F.col("_answer").isin(V.CATEGORIES), F.lit(False))
    return rows.withColumn("valid", valid).withColumn(category, F.when(F.col("valid"), F.col("_answer")).otherwise(F.col(category))).drop("_answer")
