"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed letter n-grams (2 to 4 letters, with word
borders).  Embeddings and softmax are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows; a fifth of the sample sets the temperature of the
probabilities and the confidence below which a prediction is rejected.  Since the softmax is
linear, every n-gram contributes a fixed row of class scores, so scoring is one table look-up
per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.samples import held_out, stratified_keys
from vouchspark.llm.worker import kept

UNKNOWN = "und"
BUCKET_BITS = 15
DIMENSIONS = 16
ORDERS = (2, 3, 4)
#: Bound of the training sample: rows that reach the driver as bucket counts.
SAMPLE_ROWS = 3000
#: Every language has so many rows among them, if it has them at all.
LEAST_ROWS = 50
EPOCHS, RATE, SEED = 4, 2.0, 7
#: Share of right predictions on the validation part that rejection may cost, at most.
REJECT_SHARE = 0.001
REJECT_BELOW = 0.5
BLOCK = 1 << 19
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D), np.uint32(0x27D4EB2F))


def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Lower-cased letters as code points, everything else as 0, with a border at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") if text else np.empty(0, dtype="<u4")
    out = np.zeros(len(codes) + 2, dtype=np.uint32)
    out[1:-1] = np.where(kept("letters", _letters)[codes], codes, 0)
    return out


def subword_buckets(codes: np.ndarray) -> np.ndarray:
    """Hash buckets of all letter n-grams; borders may stand at their ends only."""
    found, is_letter = [], codes > 0
    mixed = [codes * m for m in _MIX]
    for n in ORDERS:
        many = len(codes) - n + 1
        if many <= 0:
            continue
        value = mixed[0][:many].copy()
        for k in range(1, n):
            value ^= (mixed[k][k : k + many] << np.uint32(k)) + (value >> np.uint32(7))
        if n == 2:
            keep = is_letter[:many] | is_letter[1:]
        else:
            keep = is_letter[1 : 1 + many].copy()
            for k in range(2, n - 1):
                keep &= is_letter[k : k + many]
        value = value[keep]
        value = (value ^ (value >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        found.append(((value ^ (value >> np.uint32(13))) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    return np.concatenate(found) if found else np.empty(0, dtype=np.int32)


def blocks(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of a long text, cut at borders, so that no n-gram is lost or counted twice."""
    start = 0
    while len(codes) - start > BLOCK:
        border = np.flatnonzero(codes[start + BLOCK :] == 0)
        stop = start + BLOCK + int(border[0])
        yield codes[start : stop + 1]
        start = stop
    yield codes[start:]


@dataclass
class LanguageModel:
    """``table`` has the class scores of every bucket: embeddings times softmax weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, text: str | None) -> np.ndarray | None:
        """NULL for a text without letters."""
        codes = letter_codes(text)
        if not self.languages or not codes.any():
            return None
        total, n = np.zeros(len(self.languages), dtype=np.float64), 0
        for part in blocks(codes):
            buckets = subword_buckets(part)
            total += self.table[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        return softmax((total / max(n, 1) + self.bias) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = SEED) -> LanguageModel:
    """Train on (language, buckets, counts).  Every fifth row is kept for calibration."""
    languages = sorted({r[0] for r in rows})
    k, size = len(languages), 1 << BUCKET_BITS
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (size, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, k), dtype=np.float32), np.zeros(k, dtype=np.float32)
    order = rng.permutation(len(rows))
    valid, learn = (order[::5], np.concatenate([order[1::5], order[2::5], order[3::5], order[4::5]])) if len(rows) >= 50 else (order, order)
    place = {name: i for i, name in enumerate(languages)}
    steps, step = EPOCHS * len(learn), 0
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            name, buckets, counts = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(buckets):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            own = embed[buckets]
            mean = share @ own
            gap = softmax(mean @ weight + bias)
            gap[place[name]] -= 1
            back = weight @ gap
            weight -= rate * np.outer(mean, gap)
            bias -= 0.1 * rate * gap
            embed[buckets] = own - rate * len(buckets) ** 0.5 * share[:, None] * back
    model = LanguageModel(languages, embed @ weight, bias.astype(np.float64))
    return _calibrated(model, [rows[i] for i in valid if len(rows[i][1])], place)


def _calibrated(model: LanguageModel, rows: list, place: dict[str, int]) -> LanguageModel:
    """Temperature by the likelihood of the validation rows, rejection by their confidence."""
    if not rows:
        return model
    scores = np.array([(model.table[b] * c[:, None]).sum(axis=0) / c.sum() + model.bias for _, b, c in rows])
    truth = np.array([place[r[0]] for r in rows])
    losses = {t: -np.log(np.maximum(softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in np.geomspace(0.1, 10, 41)}
    model.temperature = float(min(losses, key=losses.get))
    sure = softmax(scores / model.temperature)
    right = np.sort(sure.max(axis=1)[sure.argmax(axis=1) == truth])
    if len(right):
        model.reject_below = float(min(REJECT_BELOW, right[int(REJECT_SHARE * len(right))]))
    return model


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = SEED) -> LanguageModel:
    """Learn from text and language of rows that are not held out.

    At most ``sample_rows`` rows are sampled by a seeded hash of their ids, ``LEAST_ROWS`` of every
    language among them (all it has, if fewer; fewer where languages are too many); their texts are read
    whole in tasks, and only bucket counts (at most 2^15 per row) come to the driver.  Rows with
    a NULL language are never learned from.  Without labelled rows the model knows no language.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("doc_id", "lang")
    keys = stratified_keys(labelled, "lang", LEAST_ROWS, sample_rows, seed)
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(keys), ["doc_id", "lang"], "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, lang, text in zip(frame["doc_id"], frame["lang"], frame["text"], strict=True):
                seen = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
                for part in blocks(letter_codes(text)):
                    seen += np.bincount(subword_buckets(part), minlength=1 << BUCKET_BITS)
                buckets = np.flatnonzero(seen)
                out.append((key, lang, buckets.astype("<u2").tobytes(), seen[buckets].astype("<u4").tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "lang", "buckets", "counts"])

    found = rows.mapInPandas(count, "doc_id long, lang string, buckets binary, counts binary").collect()
    found.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["buckets"])))
    return train([(r["lang"], np.frombuffer(r["buckets"], dtype="<u2").astype(np.int64), np.frombuffer(r["counts"], dtype="<u4").astype(np.float32)) for r in found], seed)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``lang_score`` and ``lang_rejected``.

    A NULL text, or one without a letter, is ``und`` with score 0 and rejected.  Other texts get
    a learned language and its calibrated probability, and are rejected below the model's bound.
    Existing columns of these names are replaced.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double, lang_rejected boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        m, out = sent.value, []
        for text in texts:
            p = m.probabilities(text)
            if p is None:
                out.append((UNKNOWN, 0.0, True))
            else:
                best = int(p.argmax())
                out.append((m.languages[best], float(p[best]), bool(p[best] < m.reject_below)))
        return pd.DataFrame(out, columns=["lang_pred", "lang_score", "lang_rejected"])

    names = ("lang_pred", "lang_score", "lang_rejected")
    judged = docs.drop(*names).withColumn("_lang", judge("text"))
    return judged.select("*", *[F.col(f"_lang.{n}").alias(n) for n in names]).drop("_lang")
