"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, intent, target, negation, report, other).  Four small
transducers read the symbols of a clause in turn and mark its insults and threats: as negated,
as reported speech, as aimed at somebody, as intended.  They are composed into one table.  A
marked insult or threat is a path, every path has a factor, and a clause weighs as much as its
strongest path times the word's own probability.  Clauses join by a noisy-or.

The words of the insult class, their probabilities and the factors of the paths are learned
from a bounded sample of labelled rows on top of a small seed grammar.  A stem counts only where
several words carry it.  Stems that clean texts know too are doubtful: one hit says little, so a
last counter adds the doubtful hits of all clauses, less what a clean text of this length has,
and the probability of each level is learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vouchspark.llm.samples import held_out, sample_keys
from vouchspark.llm.storage import stored
from vouchspark.llm.worker import WORD_LIMIT, Memo, batches_of

OTHER, INSULT, THREAT, INTENT, TARGET, NEGATION, REPORT = range(7)
NEGATED, REPORTED, AIMED, INTENDED = 1, 2, 4, 8
CUT = 0.7
#: Bound of what is learned from: labelled rows.
SAMPLE_ROWS = 8000
SEED = 11
#: Insults below this probability are doubtful.
SURE_P = 0.75
#: A term needs so many rows, this purity, and a log-likelihood ratio against independence that
#: lets through so many wrong terms, in expectation, among all that are tested.
LEAST_ROWS, LEAST_PURITY, WRONG_TERMS = 5, 0.95, 0.05
STEMS = (5, 6, 7)
#: A stem of this purity and below ``LEAST_PURITY`` is doubtful; hits in excess of the usual, as
#: levels, with their probabilities before any evidence.
DOUBTFUL_PURITY, LEVELS = 0.3, (0.0, 0.1, 0.5, 0.8, 0.9)
#: Rows of the sample that a worker gets at once, and texts whose terms it sends at once.
BATCH_ROWS, TEXTS = 1000, 32
SEED_P, SEED_ROWS, PATH_ROWS = 0.85, 4.0, 4.0
SHORTEST_WORD = 3
TOKENS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# Seed grammar: plain words of four languages.
SEEDS = {
    INSULT: "idiot idiots stupid moron morons loser losers scum pathetic worthless disgusting trash dumbass imbecile imbécile abruti "
    "connard dummkopf abschaum trottel idiota imbécil estúpido basura",
    THREAT: "kill murder hurt stab strangle shoot destroy töten umbringen verletzen tuer frapper matar golpear",
    INTENT: "will shall gonna going must should werde werden vais va voy vas",
    TARGET: "you your you're u them they him her he she du dich dir ihr euch sie tu te toi vous ils tú te usted ustedes",
    NEGATION: "not never no don't isn't aren't nicht kein keine niemals nie pas jamais no nunca jamás",
    REPORT: "said says saying called calls wrote writes claimed quoted reported sagte sagt schrieb dit écrit dijo dice escribió",
}
#: Factors of paths before any evidence: marks to a share of the plain weight.  A single insult
#: aimed at nobody stays below ``CUT`` unless the sample says more.
PRIOR = {NEGATED: 0.3, REPORTED: 0.4, NEGATED | REPORTED: 0.15}
PRIOR_LOOSE = 0.8


@dataclass(frozen=True)
class Transducer:
    """States and a step: (state, symbol) to (next state, marks put on an insult or threat)."""

    states: int
    step: object

    def table(self) -> dict[tuple[int, int], tuple[int, int]]:
        return {(s, a): self.step(s, a) for s in range(self.states) for a in range(7)}


def _negation(state: int, symbol: int) -> tuple[int, int]:
    """A negation reaches over the next four words."""
    mark = NEGATED if state and symbol in (INSULT, THREAT) else 0
    return (4, mark) if symbol == NEGATION else (max(0, state - 1), mark)


def _report(state: int, symbol: int) -> tuple[int, int]:
    """A verb of speech makes the rest of the clause reported."""
    return (1 if symbol == REPORT else state), (REPORTED if state and symbol in (INSULT, THREAT) else 0)


def _target(state: int, symbol: int) -> tuple[int, int]:
    return (1 if symbol == TARGET else state), (AIMED if state and symbol in (INSULT, THREAT) else 0)


def _intent(state: int, symbol: int) -> tuple[int, int]:
    """An auxiliary of intent holds for three words."""
    mark = INTENDED if state and symbol == THREAT else 0
    return (3, mark) if symbol == INTENT else (max(0, state - 1), mark)


def compose(first: dict, second: dict) -> dict:
    """Both read the same symbols; marks add up.  Only states that can be reached are built."""
    out, todo, number = {}, [(0, 0)], {(0, 0): 0}
    while todo:
        s, t = pair = todo.pop()
        for a in range(7):
            (s2, m1), (t2, m2) = first[s, a], second[t, a]
            if (s2, t2) not in number:
                number[s2, t2] = len(number)
                todo.append((s2, t2))
            out[number[pair], a] = (number[s2, t2], m1 | m2)
    return out


def grammar() -> dict[tuple[int, int], tuple[int, int]]:
    table = Transducer(5, _negation).table()
    for step, states in ((_report, 2), (_target, 2), (_intent, 4)):
        table = compose(table, Transducer(states, step).table())
    return table


@dataclass
class ToxicityModel:
    words: dict[str, tuple[int, float]] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    factors: dict[tuple[int, int], float] = field(default_factory=dict)
    base: float = 0.02
    levels: tuple[float, ...] = LEVELS
    usual: float = 0.0
    table: dict = field(default_factory=grammar)

    def symbol(self, word: str) -> tuple[int, float]:
        """Class of a lower-cased word and its probability; the shortest known stem counts, since
        most rows speak for it."""
        own = self.words.get(word)
        if own is not None:
            return own
        for n in STEMS:
            if len(word) >= n and word[:n] in self.stems:
                return INSULT, self.stems[word[:n]]
        return OTHER, 0.0

    def code(self, word: str) -> int:
        return self.symbol(word)[0]

    def paths(self, text: str) -> list[list[tuple[int, int, float, bool]]]:
        """Per clause with insults or threats: class, marks, word probability of each, and
        whether it rests on a doubtful stem."""
        out, clause = [], []
        for token in [*TOKENS.findall(text.lower()), "\n"]:
            if token in ".!?;:\n":
                if any(s in (INSULT, THREAT) for s, _ in clause):
                    out.append(self._read(clause))
                clause = []
            else:
                clause.append(self.symbol(token))
        return out

    def _read(self, clause: list[tuple[int, float]]) -> list[tuple[int, int, float, bool]]:
        state, found = 0, []
        # Somebody named after the insult is its target as well.
        last = max((i for i, (s, _) in enumerate(clause) if s == TARGET), default=-1)
        for i, (symbol, p) in enumerate(clause):
            state, marks = self.table[state, symbol]
            if symbol in (INSULT, THREAT):
                found.append((symbol, marks | (AIMED if last > i else 0), p, p < SURE_P))
        return found

    def factor(self, symbol: int, marks: int) -> float:
        return self.factors.get((symbol, marks), prior_factor(symbol, marks))

    def score(self, text: str | None) -> float:
        clear = 1.0 - self.base
        if text and self.has_hit(text):
            doubt = 0.0
            for clause in self.paths(text):
                sure = [p * self.factor(s, m) for s, m, p, d in clause if not d]
                clear *= 1.0 - max(sure, default=0.0)
                doubt += max((share(m) for _, m, _, d in clause if d), default=0.0)
            if doubt:
                clear *= 1.0 - self.levels[level(doubt, self.usual * len(WORD.findall(text)))]
        return float(min(1.0, max(0.0, 1.0 - clear)))

    def has_hit(self, text: str) -> bool:
        # The broadcast model lives as long as the worker process, and so does its memo.
        memo = self.__dict__.setdefault("_codes", Memo(self.code, WORD_LIMIT))
        seen = bytes(map(memo.__getitem__, WORD.findall(text.lower())))
        return INSULT in seen or THREAT in seen


def share(marks: int) -> float:
    """What negation and reported speech leave of a hit."""
    return PRIOR.get(marks & (NEGATED | REPORTED), 1.0)


def level(hits: float, usual: float) -> int:
    """Whole doubtful hits beyond those that a clean text of the same length has."""
    return int(min(max(hits - usual, 0.0), len(LEVELS) - 1))


def prior_factor(symbol: int, marks: int) -> float:
    if symbol == THREAT:
        # A verb of violence alone says little; aimed and intended it is a threat.
        return share(marks) * {0: 0.2, AIMED: 0.5, INTENDED: 0.5}.get(marks & (AIMED | INTENDED), 1.0)
    return share(marks) * (1.0 if marks & AIMED else PRIOR_LOOSE)


def seeded() -> ToxicityModel:
    """The grammar before any learning."""
    words = {w: (c, SEED_P if c in (INSULT, THREAT) else 0.0) for c in (REPORT, NEGATION, TARGET, INTENT, THREAT, INSULT) for w in SEEDS[c].split()}
    return ToxicityModel(words)


def _text_terms(text: str | None) -> dict[str, list[str]]:
    """Distinct words and stems of a text, a stem with the first and last of its words."""
    found: dict[str, list[str]] = {}
    for w in sorted({w for w in WORD.findall((text or "").lower()) if len(w) >= SHORTEST_WORD}):
        found[w] = [w, w]
        for n in STEMS:
            if len(w) >= n:
                found.setdefault(w[:n] + "*", [w, w])[1] = w
    return found


def _near_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sampled texts with a key that near copies share (the smallest hash of their five-word runs) and
    the number of their terms."""
    for frame in frames:
        keys, sizes = [], []
        for text in frame["text"]:
            words = WORD.findall((text or "").lower())
            runs = (" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
            keys.append(min(xxhash.xxh3_64_intdigest(r) >> 1 for r in runs))
            sizes.append(len(_text_terms(text)))
        yield frame.assign(key=keys, size=sizes)[["key", "toxic", "size", "text"]]


def _document_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per term of every text and one with no term, ``TEXTS`` texts at a time: the terms of a
    text take many times its size."""
    for frame in frames:
        for at in range(0, len(frame), TEXTS):
            part, rows = frame.iloc[at : at + TEXTS], []
            for toxic, text in zip(part["toxic"], part["text"], strict=True):
                rows.append((toxic, "", "", ""))
                rows.extend((toxic, t, lo, hi) for t, (lo, hi) in _text_terms(text).items())
            yield pd.DataFrame(rows, columns=["toxic", "term", "lo", "hi"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """``text`` and ``toxic`` of at most ``rows`` labelled rows that are not held out."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & ~held_out()).select("doc_id", "toxic").distinct()
    return docs.select("doc_id", "text").join(F.broadcast(sample_keys(usable, rows, seed)), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, seed: int = SEED) -> ToxicityModel:
    """Learn insult words, their stems, the factors of paths and the levels of doubtful hits.

    Of near copies in the sample one counts, so that a copied toxic text does not make all its
    words toxic; only texts are shuffled for that, and terms are made of those that are left.  Terms are counted and tested by Spark; those that pass the likelihood ratio
    reach the driver, all of them: the sample bounds their number.  A stem needs two words that
    carry it; a word with a doubtful stem is judged by that.  Rows with a NULL label or text
    teach nothing; a label that repeats counts once.  Reads the sample twice.
    """
    with batches_of(docs.sparkSession, BATCH_ROWS):
        return _fitted(labelled_sample(docs, labels, rows, seed).filter(F.col("text").isNotNull()))


def _fitted(sample: DataFrame) -> ToxicityModel:
    model = seeded()
    each = sample.mapInPandas(_near_keys, "key long, toxic int, size int, text string")
    one = each.groupBy("key").agg(F.min_by(F.struct("toxic", "text"), F.struct("toxic", "size", "text")).alias("d")).select("d.toxic", "d.text")
    counted = stored(
        one.mapInPandas(_document_terms, "toxic int, term string, lo string, hi string").groupBy("term")
        .agg(F.sum("toxic").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter((F.col("n") >= LEAST_ROWS) | F.col("term").isin("", *SEEDS[INSULT].split())),
        "terms",
    )
    every = counted.filter(F.col("term") == "").first()
    if every is None:
        return model
    least = 2 * float(np.log(counted.count() / WRONG_TERMS))
    tested = counted.withColumn("p", (F.col("bad") + 0.1) / (F.col("n") + 0.2)).filter((F.col("term") != "") & (F.col("n") >= LEAST_ROWS))
    stem = F.col("term").endswith("*")
    pure = tested.filter(F.when(stem, (F.col("lo") != F.col("hi")) & (F.col("p") >= DOUBTFUL_PURITY)).otherwise(F.col("p") >= LEAST_PURITY))
    found = {r["term"]: r["p"] for r in pure.filter(_ratio(F.col("bad"), F.col("n"), every["bad"], every["n"]) >= least).collect()}
    # Between doubtful and pure enough a stem stays doubtful.
    model.stems = {t[:-1]: p if p >= LEAST_PURITY else min(p, SURE_P - 0.01) for t, p in found.items() if t.endswith("*")}
    for term, p in found.items():
        if not term.endswith("*") and model.words.get(term, (INSULT,))[0] == INSULT and not 0 < model.symbol(term)[1] < SURE_P:
            model.words[term] = (INSULT, p)
    _temper_seeds(model, counted.filter(F.col("term").isin(SEEDS[INSULT].split())).collect())
    return _learn_paths(model, sample)


def _temper_seeds(model: ToxicityModel, counts: list) -> None:
    """Seed words keep a prior of a few rows against what the sample says of them."""
    for r in counts:
        if model.words[r["term"]][0] == INSULT:
            model.words[r["term"]] = (INSULT, (r["bad"] + SEED_ROWS * SEED_P) / (r["n"] + SEED_ROWS))


def _ratio(k: Column, n: Column, bad: float, total: float) -> Column:
    """Log-likelihood ratio of a term's rows against the rest."""

    def loss(a: Column, b: Column) -> Column:
        one = lambda x: F.when(x > 0, x * F.log(x / (a + b))).otherwise(0.0)
        return one(a) + one(b)

    toxic, clean = F.lit(bad), F.lit(total - bad)
    return 2 * (loss(k, n - k) + loss(toxic - k, clean - n + k) - loss(toxic, clean))


def _learn_paths(model: ToxicityModel, sample: DataFrame) -> ToxicityModel:
    """Share of toxic rows among those whose strongest path is of a kind, against its prior, and
    among those without a sure path by their level of doubtful hits.  One narrow row per sampled
    text reaches the driver."""

    def strongest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                clauses = model.paths(text)
                sure = [x[:3] for clause in clauses for x in clause if not x[3]]
                s, m, p = max(sure, key=lambda x: x[2] * prior_factor(x[0], x[1]), default=(OTHER, 0, 0.0))
                doubt = sum(max((share(x[1]) for x in clause if x[3]), default=0.0) for clause in clauses)
                rows.append((s, m, p, doubt, len(WORD.findall(text)), int(toxic)))
            yield pd.DataFrame(rows, columns=["symbol", "marks", "p", "doubt", "words", "toxic"])

    seen = sample.mapInPandas(strongest, "symbol int, marks int, p double, doubt double, words long, toxic int").toPandas()
    for (symbol, marks), rows in seen[seen["symbol"] != OTHER].groupby(["symbol", "marks"]):
        prior = prior_factor(symbol, marks)
        model.factors[int(symbol), int(marks)] = min(1.0, float(rows["toxic"].sum() + PATH_ROWS * prior) / float(rows["p"].sum() + PATH_ROWS))
    rest = seen[seen["symbol"] == OTHER]
    clean = seen[seen["toxic"] == 0]
    model.usual = float(clean["doubt"].sum() / max(1, clean["words"].sum()))
    levels = np.array([level(d, model.usual * w) if d else -1 for d, w in zip(rest["doubt"], rest["words"], strict=True)], dtype=int)
    toxic = rest["toxic"].to_numpy()
    none = toxic[levels <= 0]
    model.base = min(0.5, float(none.sum() + 0.02) / (len(none) + 1.0))
    shares = [(toxic[levels == k].sum() + PATH_ROWS * prior) / ((levels == k).sum() + PATH_ROWS) for k, prior in enumerate(LEVELS)]
    # More hits never count for less.
    model.levels = (0.0, *np.maximum.accumulate(shares[1:]).tolist())
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns of ``docs`` with ``toxicity`` (0 to 1).  Reads ``text`` alone.

    A NULL or empty text, and one without an insult or a threat, has the base score.  A text is
    read whole, whatever its length; rows that repeat are scored alike.  An existing column of this name is replaced.  No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    return docs.drop("toxicity").withColumn("toxicity", judge("text"))
