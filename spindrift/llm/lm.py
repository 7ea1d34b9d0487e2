"""LM scoring by a log-bilinear model, trained in numpy with noise-contrastive estimation.

The score of a word after two others is c1*r(w1)*q(w) + c2*r(w2)*q(w) + b(w),
and that of its class likewise. Every task trains on its own documents from
common parameters, against noise words and noise classes drawn from the unigram
distribution; parameters are averaged by row, weighted by tokens, in as many
rounds as asked for. The vocabulary grows with the square root of the training
tokens, up to MOST words. Probabilities are normalised exactly: over all
classes, then over the words of the class, by products of matrices; classes
are runs of words by falling frequency, of equal sums of the root of it, so
frequent words meet few others. A word outside the vocabulary has the
probability of "unknown" times its smoothed share of the unknown words, so the
model and the base share one event space.

Counts cover all training documents. The base and the unknown words' shares
need each word's count: frequent words (a bounded number) are sent to all
tasks, the others are joined by word. Which documents a trainer sees follows
from how the input is split, so the same files with the same settings give the
same scores, other splits slightly other ones.

Nulls: a null text is empty, one end token; a null identifier hashes as the
empty string. Repeated rows count and are scored each; a very long text is
scored in steps of bounded size. Columns besides the two named ones are not
read. Without training tokens score equals base_score. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, partitions
from .words import LOWER, count_words, frequency_bound, pack, sent, unpacked_table

#: Ids of the model's vocabulary: unknown words, the end of a text, the place before its beginning (context only), then words.
UNKNOWN, END, BEGIN, WORDS = 0, 1, 2, 3
LEAST, MOST, DIMENSIONS = 1 << 8, 1 << 16, 32
#: Words whose counts are sent to every task, at most.
FREQUENT = 1 << 19
NOISE, STEP_TOKENS, RATE, ROUNDS = 32, 1024, 0.05, 1
#: Tokens that are scored at once.
SCORED = 1 << 17
#: Logits that are held at once.
LOGITS = 1 << 16
HELD_OUT, FOLDS = 1, 5


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def grown(tokens: int) -> int:
    """Entries of the vocabulary: about the square root of the training tokens, a power of two."""
    return min(MOST, max(LEAST, 1 << round(np.log2(max(1, tokens)) / 2)))


class Places(dict):
    """word -> place in a list; a word outside it has -1 and is noted."""

    def __init__(self, words: list[bytes]):
        super().__init__(zip(words, range(len(words))))
        self.missed: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.missed.append(word)
        return -1


class Classes:
    """Runs of entries by falling frequency; the place before a beginning is never predicted and has no class."""

    def __init__(self, unigram: np.ndarray):
        order = np.argsort(-unigram, kind="stable")
        self.order = order[order != BEGIN]
        root = np.sqrt(unigram[self.order])
        n = max(1, min(len(self.order), round(np.sqrt(len(unigram)))))
        share = (np.cumsum(root) - root / 2) / root.sum()
        of = np.unique(np.minimum((share * n).astype(np.int64), n - 1), return_inverse=True)[1]
        self.ends = np.flatnonzero(np.r_[of[1:] != of[:-1], True]) + 1  # where each class ends in order
        self.of = np.zeros(len(unigram), np.int64)
        self.of[self.order] = of
        self.mass = np.bincount(of, unigram[self.order])


def start(unigram: np.ndarray, classes: Classes, dimensions: int = DIMENSIONS) -> list[np.ndarray]:
    """r, q, c (two rows), b, and of classes q and b: small random vectors, biases at the unigram distribution."""
    rng = np.random.default_rng(7)
    v, k = len(unigram), len(classes.ends)
    small = lambda n: (rng.standard_normal((n, dimensions)) * 0.1).astype(np.float32)
    log = lambda p: np.log(p / p.sum()).astype(np.float32)
    return [small(v), small(v), np.ones((2, dimensions), np.float32), log(unigram), small(k), log(classes.mass)]


class Sums:
    """Sums of rows by place, laid out by the rank of each place that occurs: no sorting, no table as large as the model. Rows of
    even width are added as complex numbers, two parameters at once."""

    def __init__(self, shape: tuple[int, int]):
        self.kind = np.complex64 if shape[1] % 2 == 0 else np.float32
        self.across = np.arange(shape[1] * 4 // np.dtype(self.kind).itemsize)
        self.met, self.start = np.zeros(shape[0], bool), np.zeros(shape[0], np.int64)

    def of(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct places, sums); rows: 32-bit floats, one row after the other."""
        width = len(self.across)
        self.met[at] = True
        places = np.flatnonzero(self.met)
        self.met[places], self.start[places] = False, np.arange(0, len(places) * width, width)
        sums = np.zeros(len(places) * width, self.kind)
        np.add.at(sums, (self.start.take(at)[:, None] + self.across).ravel(), rows.view(self.kind).ravel())
        return places, sums.view(np.float32).reshape(len(places), -1)


class Noise:
    """Draws from a distribution."""

    def __init__(self, mass: np.ndarray, rng):
        p = mass / mass.sum()
        self.ends, self.log, self.rng = np.cumsum(p), np.log(NOISE * p).astype(np.float32), rng

    def draw(self) -> np.ndarray:
        return np.searchsorted(self.ends, self.rng.random(NOISE)).clip(0, len(self.ends) - 1)


def contrast(h: np.ndarray, q: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, log: np.ndarray, sums: Sums) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the noise-contrastive loss of true outputs w against noise k that all tokens share: by h, the rows of q that
    change and by them, by b."""
    qw, qk, less = q.take(w, axis=0), q.take(k, axis=0), b - log
    s = np.einsum("ij,ij->i", h, qw) + less.take(w)
    gk = h @ qk.T
    gk += less.take(k)
    g = -1 / (1 + np.exp(np.clip(s, -30, 30)))  # of the loss by s: true outputs
    gk *= 0.5  # and noise: the logistic function is (1 + tanh(x / 2)) / 2
    np.tanh(gk, out=gk)
    gk += 1
    gk *= 0.5
    rows = np.empty((len(w) + len(k), h.shape[1]), np.float32)
    np.multiply(g[:, None], h, out=rows[: len(w)])
    np.matmul(gk.T, h, out=rows[len(w) :])
    at, rows = sums.of(np.concatenate([w, k]), rows)
    by_h = gk @ qk
    qw *= g[:, None]
    by_h += qw
    return by_h, at, rows, np.bincount(np.concatenate([w, k]), np.concatenate([g, gk.sum(axis=0)]), len(b))


class Trainer:
    """Steps of AdaGrad on the noise-contrastive loss of words and of classes."""

    def __init__(self, parameters: list[np.ndarray], unigram: np.ndarray, classes: Classes, seed: int):
        self.p = [p.copy() for p in parameters]
        self.squares = [np.full(len(p), 1.0, np.float32) for p in self.p]
        self.rng, self.classes = np.random.default_rng(seed), classes
        self.words, self.groups = Noise(unigram, self.rng), Noise(classes.mass, self.rng)
        self.sums = {i: Sums(self.p[i].shape) for i in (0, 1, 4)}

    def update(self, i: int, at: np.ndarray, grad: np.ndarray) -> None:
        squares = self.squares[i].take(at) + (np.einsum("ij,ij->i", grad, grad) / grad.shape[1] if grad.ndim > 1 else grad * grad)
        self.squares[i][at] = squares
        rate = RATE / np.sqrt(squares)
        self.p[i][at] = self.p[i].take(at, axis=0) - (rate[:, None] if grad.ndim > 1 else rate) * grad

    def step(self, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> None:
        r, q, c, b, kq, kb = self.p
        n = len(w)
        before = np.concatenate([w1, w2])
        both = r.take(before, axis=0)
        r1, r2 = both[:n], both[n:]
        h = r1 * c[0]
        h += r2 * c[1]
        gh = np.zeros_like(h)
        for i, j, out, bias, true, noise in ((1, 3, q, b, w, self.words), (4, 5, kq, kb, self.classes.of[w], self.groups)):
            more, at, rows, gb = contrast(h, out, bias, true, noise.draw(), noise.log, self.sums[i])
            gh += more
            self.update(i, at, rows)
            self.update(j, at, gb[at].astype(np.float32))
        c_grad = np.stack([np.einsum("ij,ij->j", gh, r1), np.einsum("ij,ij->j", gh, r2)])
        np.multiply(gh, c[0], out=r1)
        np.multiply(gh, c[1], out=r2)
        at, rows = self.sums[0].of(before, both)
        self.update(0, at, rows)
        self.update(2, np.arange(2), c_grad)


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that, of texts laid end to end; ends: where each text ends."""
    w1 = np.r_[BEGIN, ids[:-1]]
    starts = np.r_[0, ends[:-1]]
    w1[starts] = BEGIN
    w2 = np.r_[BEGIN, w1[:-1]]
    w2[starts] = BEGIN
    return w1, w2


def train(docs: DataFrame, ids: dict[bytes, int], unigram: np.ndarray, classes: Classes, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Parameters after so many rounds over the texts (column text) of docs."""
    spark = docs.sparkSession
    parameters = start(unigram, classes)
    shapes = [p.shape for p in parameters]
    words = spark.sparkContext.broadcast(ids)
    for turn in range(rounds):
        common = spark.sparkContext.broadcast((parameters, unigram))

        def local(batches, common=common, turn=turn):
            parameters, unigram = common.value
            trainer = Trainer(parameters, unigram, Classes(unigram), seed=1000 * turn + TaskContext.get().partitionId())
            get, tokens, seen = words.value.get, [], 0
            ends: list[int] = []

            def learn():
                nonlocal tokens, ends, seen
                w = np.array(tokens, np.int64)
                seen += len(w)
                w1, w2 = contexts(w, np.array(ends))
                order = trainer.rng.permutation(len(w))
                for i in range(0, len(w), STEP_TOKENS):
                    at = order[i : i + STEP_TOKENS]
                    trainer.step(w1[at], w2[at], w[at])
                tokens, ends = [], []

            for batch in batches:
                for text in batch.column(0).cast(pa.binary()).to_pylist():
                    tokens += [get(x, UNKNOWN) for x in (text or b"").translate(LOWER).split()]
                    tokens.append(END)
                    ends.append(len(tokens))
                    if len(tokens) >= 1 << 18:
                        learn()
            if tokens:
                learn()
            if seen:
                rows = np.concatenate([p if p.ndim > 1 else np.pad(p, (0, -len(p) % DIMENSIONS)).reshape(-1, DIMENSIONS) for p in trainer.p])
                for i in range(0, len(rows), 256):
                    part = rows[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part))), pa.array(np.full(len(part), float(seen))), pa.array([x.tobytes() for x in part.astype("<f4")], pa.binary())], names=["row", "weight", "value"])

        def average(batches):
            row, weight, total = None, 0.0, None
            for batch in batches:
                for r, w, v in zip(*(c.to_pylist() for c in batch.columns)):
                    if r != row:
                        if row is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["row", "value"])
                        row, weight, total = r, 0.0, np.zeros(DIMENSIONS)
                    weight += w
                    total += w * np.frombuffer(v, "<f4")
            if row is not None:
                yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], names=["row", "value"])

        rows = arrow_map(docs.select("text"), local, "row long, weight double, value binary")
        rows = rows.repartition(partitions(spark), "row").sortWithinPartitions("row", "weight", "value")
        got = arrow_map(rows, average, "row long, value binary").toArrow().sort_by("row")  # as many rows as the model has
        if not len(got):
            break
        flat = np.frombuffer(b"".join(got.column("value").to_pylist()), "<f4")
        parameters, done = [], 0
        for shape in shapes:
            size = int(np.prod(shape))
            parameters.append(flat[done : done + size].reshape(shape).copy())
            done += -(-size // DIMENSIONS) * DIMENSIONS
    return parameters


def log10_probabilities(parameters: list[np.ndarray], classes: Classes, w1: np.ndarray, w2: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log10 p(w | w1, w2) = log10 p(class of w | w1, w2) + log10 p(w | its class, w1, w2), both normalised exactly. Normalisers
    are computed once for each context, and each context and class, of SCORED tokens."""
    r, q, c, b, kq, kb = parameters
    begins, out = np.r_[0, classes.ends[:-1]], np.zeros(len(w))
    several = classes.ends - begins > 1  # a class of one word has nothing to tell apart
    ordered, biases = q[classes.order], b[classes.order]
    for i in range(0, len(w), SCORED):
        part = slice(i, i + SCORED)
        x, of = w[part], classes.of.take(w[part])
        contexts_met, at = np.unique(w1[part] * len(b) + w2[part], return_inverse=True)
        h = r.take(contexts_met // len(b), axis=0) * c[0]
        h += r.take(contexts_met % len(b), axis=0) * c[1]
        own = h.take(at, axis=0)
        found = np.einsum("ij,ij->i", own, kq.take(of, axis=0)) + kb.take(of) - log_sums(h, kq, kb).take(at)
        open_ = np.flatnonzero(several.take(of))
        x = x.take(open_)
        pairs, which = np.unique(of.take(open_) * len(h) + at.take(open_), return_inverse=True)  # by class, then context
        inside = np.zeros(len(pairs))
        cuts = np.flatnonzero(np.diff(pairs // len(h), prepend=-1, append=-1))
        for a, z in zip(cuts, cuts[1:]):
            k = pairs[a] // len(h)
            members = slice(begins[k], classes.ends[k])
            inside[a:z] = log_sums(h.take(pairs[a:z] - k * len(h), axis=0), ordered[members], biases[members])
        found[open_] += np.einsum("ij,ij->i", own.take(open_, axis=0), q.take(x, axis=0)) + b.take(x) - inside.take(which)
        out[part] = found
    return out / np.log(10)


def log_sums(h: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithms of the sums of exp(h * q + b) over q, for blocks of contexts whose logits stay in a processor's cache."""
    out, ones = np.zeros(len(h)), np.ones(len(q), np.float32)
    rows = max(16, LOGITS // len(q))
    for i in range(0, len(h), rows):
        logits = q @ h[i : i + rows].T
        logits += b[:, None]
        most = logits.max(axis=0)
        logits -= most
        np.exp(logits, out=logits)
        out[i : i + rows] = np.log(ones @ logits) + most
    return out


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: int | None = None, frequent: int = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. vocabulary: its entries,
    grown() of the training tokens unless given."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"))
    learn = docs.where("not held_out")
    table = scratch.keep(count_words(learn, "text", lower=True), "words")
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = learn.count()
    every, distinct = totals["n"] + texts, totals["v"] + (texts > 0)
    mass = every + 0.5 * (distinct + 1)
    least = frequency_bound(table, frequent)
    words, counts = sent(table.where(F.col("n") >= least).select("word", "n"), [("n", "descending"), ("word", "ascending")])
    packed = pack([words])
    counts = counts.to_numpy().astype(float)
    top = min(len(words), (vocabulary or grown(every)) - WORDS)
    inside = counts[:top].sum() + texts
    outside = mass - inside - 0.5 * (top + (texts > 0))  # smoothed mass of all other words, the unseen one included
    unigram = np.r_[max(1.0, every - inside), max(1.0, texts), 1e-3, counts[:top]]
    classes = Classes(unigram / unigram.sum())
    ids = {w: i + WORDS for i, w in enumerate(words[:top].cast(pa.binary()).to_pylist())}
    model = (train(learn, ids, unigram / unigram.sum(), classes, rounds), unigram / unigram.sum()) if every else None

    log_counts = np.log10(counts + 0.5)
    known = spark.sparkContext.broadcast(packed)
    rest = spark.sparkContext.broadcast((log_counts, model))
    end_log, mass_log, outside_log = np.log10(texts + 0.5), np.log10(mass), np.log10(outside) if every else 0.0

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        places_of = unpacked_table(known, "places", lambda t: Places(t.column(0).cast(pa.binary()).to_pylist()))
        get, (logs, model) = places_of.__getitem__, rest.value
        classes = Classes(model[1]) if model is not None else None
        for batch in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            texts_in = batch.column(1).cast(pa.binary()).to_pylist()
            at, ends, rare = [], [], []
            for text in texts_in:
                places_of.missed = []
                at += map(get, (text or b"").translate(LOWER).split())
                at.append(-2)
                ends.append(len(at))
                rare.append(Counter(places_of.missed))
            at, ends = np.array(at, np.int64), np.array(ends, np.int64)
            firsts = np.r_[0, ends[:-1]]
            if len(ends):
                value = np.where(at >= 0, logs[at] if len(logs) else 0.0, np.where(at == -2, end_log, 0.0))  # a rare word's comes by the join
                base = np.add.reduceat(value - mass_log, firsts)
                frequent_known = np.add.reduceat((at >= 0) | ((at == -2) & (every > 0)), firsts, dtype=np.int64)
                if model is not None:
                    w = np.where(at == -2, END, np.where((at >= 0) & (at < top), at + WORDS, UNKNOWN))
                    w1, w2 = contexts(w, ends)
                    p = log10_probabilities(model[0], classes, w1, w2, w) + np.where(w == UNKNOWN, value - outside_log, 0.0)
                    score = np.add.reduceat(p, firsts)
                else:
                    score = base
                n = np.diff(np.r_[0, ends])
                out = [[(part << 32) + row + i for i in range(len(ends))], n, frequent_known, base, score]
                row += len(ends)
                pairs = pa.MapArray.from_arrays(pa.array(np.cumsum([0, *map(len, rare)]).astype(np.int32)), pa.array([w for x in rare for w in x], pa.binary()).cast(pa.string()), pa.array([c for x in rare for c in x.values()], pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), batch.column(0), batch.column(2), *[pa.array(c) for c in out[1:]], pairs], names=["key", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "score", "rare"])

    schema = f"key long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_frequent long, base double, score double, rare map<string,bigint>"
    scored = scratch.keep(arrow_map(docs.select("doc_id", "text", "held_out"), run, schema), "scored")
    occurrences = scored.select("key", F.explode("rare").alias("word", "times"))
    met = occurrences.join(table.where(F.col("n") < least), "word", "left")
    sums = met.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.coalesce(F.col("n"), F.lit(0)) + F.lit(0.5))).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    more, known_more = F.coalesce(F.col("log"), F.lit(0.0)), F.coalesce(F.col("known"), F.lit(0))
    return scored.drop("rare").join(sums, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + known_more).alias("n_known"), F.lit(every).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
