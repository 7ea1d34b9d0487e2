"""Secret scans: patterns of known kinds, then a token-efficiency test.

The base finds assignments, access keys and hex runs. The method adds spans of
kind "random": a vocabulary trained on text needs many tokens for random
strings, so a run of key-like characters that averages few characters a token
is suspect. What base spans cover of a run is cut out and each rest is tested by
itself. Known digests (bare hex), UUIDs, and numbers and dates are excluded
first. Paths and names are left out where the vocabulary covers their words, in
lower case, with long tokens.

Nulls: a null text is empty and has no spans; a null identifier is carried
along. Each row is scanned by itself, whatever its length (the patterns take
time in proportion to it), so repeated rows repeat their result and an empty
table gives an empty one. Columns besides the two named ones are not read.
Offsets count code points.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, remembered

KINDS = ("assign", "access", "hex", "random")
#: Shortest run that is tested, and the characters a token below which it is random.
MIN_RUN, MAX_RATIO = 16, 2.2
#: Letters a token from which words of a run, each by itself in lower case, are known ones.
WORD_RATIO = 3

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

# Keywords in either case of ASCII letters only; the quantifiers of the other two are those of the longest runs.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
#: Numbers and dates.
NUMBER = re.compile(r"[0-9+/_=-]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def vocabulary(path: str | None):
    def load():
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return remembered(("secrets vocabulary", path), load)


def excluded(run: str) -> bool:
    """A known digest or UUID, or no letters at all."""
    return bool(UUID.fullmatch(run) or DIGEST.fullmatch(run) or NUMBER.fullmatch(run))


def worded(run: str, encoding) -> bool:
    """Whether the vocabulary covers the run's words with long tokens, whatever their case."""
    parts = PART.findall(run)
    return sum(map(len, parts)) >= WORD_RATIO * sum(len(encoding.encode_ordinary(" " + p.lower())) for p in parts)


def covered(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The union of sorted spans as stretches apart from each other."""
    out: list[tuple[int, int]] = []
    for a, _, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def outside(start: int, end: int, stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What covered stretches leave of another."""
    out = []
    for i in range(bisect.bisect_right(stretches, start, key=lambda s: s[1]), len(stretches)):
        a, b = stretches[i]
        if a >= end:
            break
        if a > start:
            out.append((start, a))
        start = b
    if start < end:
        out.append((start, end))
    return out


def random_run(run: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a run has fewer characters a token than text has, and isn't of a known form or made of words."""
    return len(run) >= MIN_RUN and not excluded(run) and len(run) < max_ratio * len(encoding.encode_ordinary(run)) and not worded(run, encoding)


def scan(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """Spans (start, place of kind in KINDS, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = covered(sorted(spans))
    for m in RUN.finditer(text):
        for a, b in outside(m.start(), m.end(), base):
            if random_run(text[a:b], encoding, max_ratio):
                spans.append((a, 3, b))
    return sorted(spans)


def shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None, max_ratio: float = MAX_RATIO) -> DataFrame:
    """A row for each row of docs: counts by kind, the digest of the base spans, and all spans."""

    def run(batches):
        encoding = vocabulary(vocabulary_path)
        for batch in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                found = scan(text or "", encoding, max_ratio)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in found))
                digests.append(hashlib.sha256(shown(s for s in found if s[1] < 3).encode()).hexdigest())
                spans.append(shown(found))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return arrow_map(docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text"), run, SCHEMA)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
