"""Calls of external models as pluggable functions, with the rules that surround them.

A model is a function from a batch of prompts to texts; the default is a deterministic stub, as there is no network.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import values as V

Model = Callable[[Sequence[str]], Sequence[str]]


def stub(prompts: Sequence[str]) -> list[str]:
    """A stand-in answer that depends on the prompt alone."""
    out = []
    for p in prompts:
        n = int(hashlib.md5(p.encode()).hexdigest()[:6], 16)
        out.append(json.dumps({"creator_face": ("none", "brief", "often")[n % 3], "creator_voice": ("none", "own")[n // 3 % 2], "confidence": n % 101 / 100, "category": V.CATEGORIES[n % len(V.CATEGORIES)], "reason": f"stub {n % 1000}"}, ensure_ascii=False))
    return out


def salvaged(text: str | None):
    """JSON in a model's answer: without fences, from its first bracket, cut back to the last brace that gives valid JSON (an
    array that was cut off is closed). None without any."""
    t = re.sub(r"\s*```\s*$", "", re.sub(r"^\s*```[a-zA-Z]*\s*", "", text or "")).strip()
    try:
        return json.loads(t)
    except ValueError:
        pass
    start = min((i for i in (t.find("["), t.find("{")) if i >= 0), default=-1)
    if start < 0:
        return None
    closing = "]" if t[start] == "[" else ""
    body = t[start:]
    ends = [len(body), *(m.end() for m in reversed(list(re.finditer("}", body))))]
    for i, end in enumerate(ends):
        try:
            return json.loads(body[:end] + (closing if i else ""))
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def salvaged_udf(text: pd.Series) -> pd.Series:
    return pd.Series([None if (v := salvaged(t)) is None else json.dumps(v, ensure_ascii=False) for t in text])


def with_fallback(models: Sequence[Model], wait: float = 0.0, busy: tuple = (429, 503)) -> Model:
    """The first model that answers; one that raises with a busy code (its attribute code) gives way to the next."""

    def call(prompts: Sequence[str]) -> Sequence[str]:
        for i, model in enumerate(models):
            try:
                return model(prompts)
            except Exception as e:
                if getattr(e, "code", None) not in busy or i == len(models) - 1:
                    raise
                time.sleep(wait)
        raise ValueError("no models")

    return call


def retried(model: Model, tries: int = 2, wait: float = 8.0, factor: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Model:
    """A model asked again after a pause where it raises, so many times in all; pauses grow by the factor. The last error stays."""

    def call(prompts: Sequence[str]) -> Sequence[str]:
        for i in range(tries):
            try:
                return model(prompts)
            except Exception:
                if i == tries - 1:
                    raise
                sleep(wait * factor**i)
        raise ValueError("no tries")

    return call


def polled(submit: Callable[[str], object], state: Callable[[object], tuple[str, str | None]], pause: float = 3.0, longest: float = 240.0, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic) -> Model:
    """A model behind jobs: each prompt is submitted and asked for every so often until it is completed. state(job) gives
    (status, answer); an error or no end in time raises."""

    def wait_for(prompt: str) -> str:
        job, until = submit(prompt), now() + longest
        while now() < until:
            sleep(pause)
            status, answer = state(job)
            if status == "completed":
                return answer or ""
            if status == "error":
                raise RuntimeError(answer or "the job failed")
        raise TimeoutError(f"no answer within {longest:g} s")

    return lambda prompts: [wait_for(p) for p in prompts]


def asked(df: DataFrame, prompt: Column, model: Model = stub, batch: int = 15, answer: str = "answer") -> DataFrame:
    """Adds a model's answers, asked in batches."""

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        out: list[str] = []
        for i in range(0, len(prompts), batch):
            out += model(prompts.iloc[i : i + batch].fillna("").tolist())
        return pd.Series(out)

    return df.withColumn(answer, call(prompt))


ANSWER = "creator_face string, creator_voice string, confidence double, category string, reason string, genre string, copyright_risk string, voice_type string"


def classified(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Columns of a classifier's answer: faceless only if the maker's face is absent or brief, the voice absent, and the
    confidence 0.5 at least (0.6 where none is given)."""
    a = F.from_json(salvaged_udf(answer), ANSWER)
    conf = F.coalesce(a["confidence"], F.lit(0.6))
    face = a["creator_face"].isin("none", "brief") & (a["creator_voice"] == "none")
    band = F.when(conf >= 0.8, "상").when(conf >= 0.5, "중").otherwise("하")
    return df.withColumns({
        "faceless": F.when(conf < 0.5, False).otherwise(F.coalesce(face, F.lit(False))), "confidence": band, "reason": F.substring(F.coalesce(a["reason"], F.lit("")), 1, 200),
        "genre": F.substring(F.coalesce(F.nullif(a["genre"], F.lit("")), F.lit("")), 1, 40), "copyright_risk": a["copyright_risk"], "voice_type": a["voice_type"],
    })


def recategorised(df: DataFrame, category: str = "category", answer: str = "answer") -> DataFrame:
    """A new category where the answer names a known one, differs, and is sure by 0.5 at least; changed tells which."""
    a = F.from_json(salvaged_udf(answer), ANSWER)
    ok = a["category"].isin(V.CATEGORIES) & (F.coalesce(a["confidence"], F.lit(0.0)) >= 0.5) & ~a["category"].eqNullSafe(F.col(category))
    return df.withColumn("changed", F.coalesce(ok, F.lit(False))).withColumn(category, F.when(F.col("changed"), a["category"]).otherwise(F.col(category)))


def ranked_or_first(candidates: DataFrame, ranking: DataFrame, key: str, order: str, n: int = 5) -> DataFrame:
    """Candidates in the order of a ranking (key, place, grade, reason); without any match, the first n for reference."""
    hit = candidates.join(ranking, key).orderBy("place").limit(n)
    if hit.limit(1).count():
        return hit
    return candidates.orderBy(order).limit(n).select("*", F.lit(None).cast("int").alias("place"), F.lit("참고").alias("grade"), F.lit("").alias("reason"))
