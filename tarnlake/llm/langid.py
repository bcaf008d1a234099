"""Language identification: averaged hashed subword embeddings with a linear softmax.

Byte n-grams of the lower-cased text are hashed into buckets; a text is the mean of its n-grams' embeddings, and a linear
softmax gives its language.  Embeddings and softmax are trained by stochastic gradient descent in numpy on a bounded sample
of labelled rows; a temperature fitted on rows kept out of training calibrates the score, and a rejection threshold is the
least score at which the accepted rows of that part reach the wanted precision.

Once trained, embedding and softmax multiply out to a table of one row of class scores a bucket, so predicting is a
lookup an n-gram and a mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, written

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
#: The sample: about so many rows a language at most, and about so many in all (but one or more of each language).
ROWS_A_LANGUAGE, ROWS = 1500, 6000
#: The sample's n-gram counts (eight bytes each) number about so many at most, by an upper bound a text; longer texts leave fewer rows.
FEATURES = 40_000_000
BROADCAST_LANGUAGES = 100_000
EPOCHS, BATCH, RATE = 12, 32, 60.0
PRECISION = 0.95
PIECE = 1 << 20
_ASCII = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII.search(text)) or any(map(str.isalpha, text))


def ngram_buckets(data: bytes) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each byte; the data must end in three spare bytes."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    n, out, mixed = len(b), [], b
    for order in range(2, max(ORDERS) + 1):
        mixed = mixed[: n - order + 1] * np.uint32(0x01000193) ^ b[order - 1 :]
        if order in ORDERS:
            out.append((mixed * np.uint32(0x9E3779B1) + np.uint32(order * 0x3C6EF372)) >> np.uint32(17))
    return out


def padded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b"    "


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of a text; weights sum to 1.  Long texts are taken in pieces, whole."""
    data, counts = padded(text), np.zeros(BUCKETS, np.float64)
    n = len(data) - 4  # an n-gram begins at each byte but those of the padding
    for at in range(0, n, PIECE):
        for found in ngram_buckets(data[at : at + PIECE + 4]):
            counts += np.bincount(found[: min(PIECE, n - at)], minlength=BUCKETS)
    where = np.flatnonzero(counts)
    return where.astype(np.int32), (counts[where] / counts.sum()).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, temperature included
    bias: np.ndarray
    threshold: float

    def scores(self, means: np.ndarray) -> np.ndarray:
        z = means + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def means(self, texts: list[str]) -> np.ndarray:
        """The mean table row of each text's n-grams, texts taken together up to PIECE bytes."""
        out = np.zeros((len(texts), len(self.languages)))
        batch: list[bytes] = []
        held: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            data = padded(text)
            if len(data) > PIECE:
                total, n = np.zeros(out.shape[1]), len(data) - 4
                for at in range(0, n, PIECE):
                    for found in ngram_buckets(data[at : at + PIECE + 4]):
                        total += self.table[found[: min(PIECE, n - at)]].sum(0, dtype=np.float64)
                out[i] = total / (n * len(ORDERS))
                continue
            batch.append(data)
            held.append(i)
            size += len(data)
            if size >= PIECE:
                self._together(batch, held, out)
                batch, held, size = [], [], 0
        if batch:
            self._together(batch, held, out)
        return out

    def _together(self, batch: list[bytes], held: list[int], out: np.ndarray) -> None:
        lengths = np.array([len(x) for x in batch])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        cuts = np.column_stack((starts, starts + lengths - 4)).ravel()  # a text's own n-grams, then those of its padding
        total = np.zeros((len(batch), out.shape[1]))
        for found in ngram_buckets(b"".join(batch)):
            total += np.add.reduceat(self.table[found], np.minimum(cuts, len(found) - 1), axis=0, dtype=np.float64)[::2]
        out[held] = total / ((lengths - 4) * len(ORDERS))[:, None]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], seed: int = 5) -> Model:
    """Fit on (buckets, weights, class) rows; every tenth row calibrates instead of training."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    if n == 0:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    order = rng.permutation(len(rows))
    kept = [rows[i] for i in order[: len(rows) // 10]]
    used = [rows[i] for i in order[len(rows) // 10 :]]
    counts = np.bincount([c for _, _, c in used], minlength=n)
    emphasis = np.where(counts > 0, len(used) / np.maximum(counts, 1) / n, 0.0)
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    weight = rng.normal(0, 0.3, (DIM, n)).astype(np.float32)
    bias = np.zeros(n, np.float32)
    steps, step = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(len(used))
        for at in range(0, len(used), BATCH):
            batch = [used[i] for i in shuffled[at : at + BATCH]]
            buckets = np.unique(np.concatenate([b for b, _, _ in batch])) if batch else np.zeros(0, np.int32)
            x = np.zeros((len(batch), len(buckets)), np.float32)
            for r, (b, w, _) in enumerate(batch):
                x[r, np.searchsorted(buckets, b)] = w
            hidden = x @ embed[buckets]
            z = hidden @ weight + bias
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            classes = [c for _, _, c in batch]
            z[np.arange(len(batch)), classes] -= 1
            z *= (emphasis[classes] / len(batch)).astype(np.float32)[:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            back = z @ weight.T
            weight -= (rate / 60) * (hidden.T @ z)
            bias -= (rate / 600) * z.sum(0)
            embed[buckets] -= rate * (x.T @ back)
    table = (embed @ weight).astype(np.float32)
    check = kept or used
    logits = np.array([w @ table[b] for b, w, _ in check]) + bias
    truth = np.array([c for _, _, c in check])

    def loss(t: float) -> float:
        z = logits * t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean())

    heat = min((2.0**e for e in np.arange(-4, 4.01, 0.25)), key=loss)
    model = Model(languages, table * np.float32(heat), bias * np.float32(heat), 0.0)
    score = model.scores(logits * heat - model.bias)
    best, right = score.max(1), score.argmax(1) == truth
    ranked = np.argsort(-best)
    precise = np.flatnonzero(np.cumsum(right[ranked]) / np.arange(1, len(ranked) + 1) >= PRECISION)
    model.threshold = float(best[ranked[precise[-1]]]) if len(precise) else 1.0
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(0)]
        columns = [pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([w for _, w in found], pa.list_(pa.float32())), batch.column(1)]
        yield pa.RecordBatch.from_arrays(columns, ["buckets", "weights", "lang"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5) -> Model:
    """Train on about ROWS_A_LANGUAGE rows of each language and ROWS in all at most, chosen by a hash of their id.

    Every language is learned, however many there are: with more of them each gives fewer rows, one at least, and so does one of very long
    texts.  Rows without a language or without a letter teach nothing.  What the driver gets is n-gram counts of the sample, about
    FEATURES at most; the texts that are taken are counted whole."""
    rows = own_columns(labelled, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null")
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000_000)) / F.lit(1_000_000_000.0)
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("chance", chance)
    kinds = F.least(F.lit(float(BUCKETS)), F.lit(float(len(ORDERS))) * (F.octet_length("text") + 1))  # a text has no more n-gram counts
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("chance").alias("least"), F.avg(kinds).alias("kinds"))
    known = counts.agg(F.count(F.lit(1)).alias("languages"))  # one row
    each = F.least(F.lit(float(ROWS_A_LANGUAGE)), F.lit(float(ROWS)) / F.col("languages"), F.lit(float(FEATURES)) / F.col("languages") / F.col("kinds"))
    wanted = written(counts.join(F.broadcast(known)).select("lang", "least", (each / F.col("n")).alias("share")), "shares")
    shares = F.broadcast(wanted) if wanted.count() <= BROADCAST_LANGUAGES else wanted
    sample = rows.join(shares, "lang").where("chance < share or chance = least").select("text", "lang")
    got = sample.mapInArrow(_feature_batches, "buckets array<int>, weights array<float>, lang string").toArrow()
    if not got.num_rows:
        return train([], [])
    languages = sorted(set(got.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    found = zip(got.column("buckets"), got.column("weights"), got.column("lang").to_pylist())
    data = [(b.values.to_numpy(), w.values.to_numpy(), number[c]) for b, w, c in found]
    data.sort(key=lambda x: (x[2], len(x[0]), x[0].tobytes(), x[1].tobytes()))
    return train(data, languages, seed)


def _predict_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lang, score = ["und"] * n, np.zeros(n)
            texts = [t.as_py() for t in batch.column("text")]
            known = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
            if known:
                p = model.scores(model.means([texts[i] for i in known]))
                for i, c, s in zip(known, p.argmax(1), p.max(1)):
                    lang[i], score[i] = model.languages[c], round(float(s), 9)  # sums differ in their last bits by what they are batched with
            columns = [batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(score < model.threshold)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    lang_pred is 'und' with score 0 if the text is null, empty or has no letter, or if nothing was learned; rejected marks a
    score below the model's calibrated threshold.  Whole texts are read.  Repeated rows get the same answer, a null id keeps its
    row (held_out is then false), an empty table gives no rows, and other columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    rows = own_columns(docs, id=id_col, text=text_col).select(F.col("id").cast("bigint").alias("id"), "text", held.alias("held_out"))
    return rows.mapInArrow(_predict_batches(model), "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")


def learnable(docs: DataFrame, id_col: str = "doc_id", mod: int = 4, but: int = 2) -> DataFrame:
    """The rows whose crc32(id as text) mod ``mod`` is not ``but``."""
    return docs.where(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod != but)
