"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two words sums, over all common subsequences of four letters, a
decay to the power of the stretch they take in either word, so that letters put
in between (``idXiot``) or left out cost little.  Landmarks are words, or parts of
words, that set apart the labelled texts.  A text's view of a landmark is the logarithm of
one plus the sum of its words' normalised kernels; Nystroem's map turns the views
of all landmarks into features of a linear support vector machine, and a logistic
fit of its margins gives the score.

A word is a mark of its beginning and the letters of a token of the lower-cased text, whatever stands between
them; single letters in a row are read as one word too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language_id import held_out

#: Labelled rows that the model is fitted on, about.
FIT_ROWS = 8_000
LANDMARKS = 24
DECAY, LETTERS = 0.8, 4
#: Lengths of landmarks, and words whose parts may become one.
PARTS, PART_WORDS = range(4, 11), 400
BEGIN = "^"
#: A word longer than this is read in windows of so many letters that overlap by half.
LONGEST = 24
#: A kernel below this says that the words have little in common, and counts as 0.
LEAST_KERNEL = 0.5
#: Words whose kernels one Python worker keeps.
KEPT_WORDS = 500_000
#: Weight of a toxic text where margins are turned into scores.
POSITIVE_WEIGHT = 2.0
#: A text is toxic from this score on.
TOXIC_FROM = 0.7

_NO_LETTERS = re.compile(r"[\W\d_]+")
_SPACED = re.compile(r"(?:(?<!\w)[^\W\d_][\W\d_]+){2,}[^\W\d_](?!\w)")
_SINGLE = frozenset("abcdefghijklmnopqrstuvwxyz")


def words_of(token: str) -> list[str]:
    """The letters of a token, in windows if they are many."""
    letters = token if token.isalpha() else _NO_LETTERS.sub("", token)
    if len(letters) < LETTERS - 1:
        return []
    letters = BEGIN + letters
    if len(letters) <= LONGEST:
        return [letters]
    step = LONGEST // 2
    return [letters[at : at + LONGEST] for at in range(0, len(letters) - step, step)]


def tokens_of(text: str | None) -> set[str]:
    low = (text or "").lower()
    tokens = set(low.split())
    if len(tokens & _SINGLE) >= 2:
        tokens.update(_NO_LETTERS.sub("", m) for m in _SPACED.findall(low))
    return tokens


def coded(words: list[str]) -> np.ndarray:
    """One row of code points per word, padded by 0."""
    width = max(map(len, words), default=1)
    raw = "".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.int32).reshape(len(words), width)


def letter_sets(codes: np.ndarray) -> np.ndarray:
    """The letters of each row as bits of one number."""
    bits = np.where(codes > 0, np.left_shift(np.uint64(1), (codes % 61).astype(np.uint64)), np.uint64(0))
    return np.bitwise_or.reduce(bits, axis=1)


def kernel(words: np.ndarray, other: str, letters: int = LETTERS, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each row of ``words`` with one word.

    ``inner[j]`` holds, for the prefix of ``other`` of j letters and the prefix of
    the words read so far, the common subsequences weighed by their stretch up to
    both ends.
    """
    n, width = words.shape
    m = len(other)
    codes = np.array([ord(c) for c in other], np.int32)
    equal = words[:, :, None] == codes  # word, place, place in other
    inner = np.ones((width + 1, m + 1, n), np.float32)
    for _ in range(letters - 1):
        deeper = np.zeros_like(inner)
        for i in range(1, width + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, m + 1):
                run = decay * run + np.where(equal[:, i - 1, j - 1], decay * decay * inner[i - 1, j - 1], np.float32(0))
                deeper[i, j] = decay * deeper[i - 1, j] + run
        inner = deeper
    total = np.zeros(n, np.float32)
    for i in range(1, width + 1):
        for j in range(1, m + 1):
            total += np.where(equal[:, i - 1, j - 1], decay * decay * inner[i - 1, j - 1], np.float32(0))
    return total


def self_kernels(words: list[str]) -> np.ndarray:
    """The kernel of each word with itself."""
    own: np.ndarray = np.zeros(len(words), np.float32)
    if not words:
        return own
    x = coded(words)
    n, width = x.shape
    equal = (x[:, :, None] == x[:, None, :]) & (x[:, :, None] > 0)
    inner = np.ones((width + 1, width + 1, n), np.float32)
    for _ in range(LETTERS - 1):
        deeper = np.zeros_like(inner)
        for i in range(1, width + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, width + 1):
                run = DECAY * run + np.where(equal[:, i - 1, j - 1], DECAY * DECAY * inner[i - 1, j - 1], np.float32(0))
                deeper[i, j] = DECAY * deeper[i - 1, j] + run
        inner = deeper
    for i in range(1, width + 1):
        for j in range(1, width + 1):
            own += np.where(equal[:, i - 1, j - 1], DECAY * DECAY * inner[i - 1, j - 1], np.float32(0))
    return own


@dataclass
class KernelViews:
    """Views of landmarks; the kernels of words seen before are kept."""

    landmarks: list[str]
    own: np.ndarray = field(init=False)
    seen: set = field(default_factory=set)
    views: dict = field(default_factory=dict)

    def __post_init__(self):
        self.own = self_kernels(self.landmarks)
        self.letters = [letter_sets(coded([w]))[0] for w in self.landmarks]

    def of_words(self, words: list[str]) -> np.ndarray:
        """Normalised kernels (word, landmark); below LEAST_KERNEL they are 0.

        A word that lacks over a third of a landmark's letters has few of its
        subsequences, so only words with two thirds of them are compared.
        """
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words:
            return out
        order = np.array(sorted(range(len(words)), key=lambda i: len(words[i])))
        codes = coded([words[i] for i in order])
        sets, widths = letter_sets(codes), (codes > 0).sum(1)
        for j, (mark, letters) in enumerate(zip(self.landmarks, self.letters)):
            need = max(2, -(-2 * int(np.bitwise_count(letters)) // 3))
            near = np.flatnonzero(np.bitwise_count(sets & letters) >= need)
            for at in range(0, len(near), 2048):
                part = near[at : at + 2048]
                k = kernel(codes[part, : widths[part[-1]]], mark)
                # against the landmark alone: what a word has besides must not hide it
                out[order[part], j] = np.minimum(1, k / self.own[j])
        out[out < LEAST_KERNEL] = 0
        return out

    def learn(self, tokens: set[str]) -> None:
        """Compute the views of tokens not seen yet."""
        new = sorted(tokens - self.seen)
        if not new:
            return
        if len(self.seen) + len(new) > KEPT_WORDS:
            self.seen, self.views = set(), {}
        pairs = [(t, w) for t in new for w in words_of(t)]
        unique = sorted({w for _, w in pairs})
        place = {w: i for i, w in enumerate(unique)}
        kernels = self.of_words(unique)
        some = kernels.any(1)
        for t, w in pairs:
            if some[i := place[w]]:
                old = self.views.get(t)
                self.views[t] = kernels[i] if old is None else np.maximum(old, kernels[i])
        self.seen.update(new)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """Views of each landmark by the different words of each text."""
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        for at in range(0, len(texts), 512):
            tokens = [tokens_of(t) for t in texts[at : at + 512]]
            self.learn(set().union(*tokens))
            for row, own in zip(out[at:], tokens):
                for t in self.views.keys() & own:
                    row += self.views[t]
        return np.log1p(out)


@dataclass
class ToxicityModel:
    landmarks: list[str]
    whitened: np.ndarray  # Nystroem's map
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, views: np.ndarray) -> np.ndarray:
        margin = views @ self.whitened @ self.weights + self.bias
        found = 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))
        return np.zeros(len(views)) if self.offset == -np.inf else found


def fit_svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-5, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear squared-hinge SVM, by Newton steps on the rows inside the margin."""
    n = len(y)
    sign = np.where(y > 0, 1.0, -1.0)
    rows = np.hstack([x, np.ones((n, 1))])
    ridge = penalty * np.eye(rows.shape[1])
    ridge[-1, -1] = 1e-9  # the bias is free
    w = np.zeros(rows.shape[1])

    def loss(w: np.ndarray) -> float:
        return float(w @ ridge @ w + (np.maximum(0, 1 - sign * (rows @ w)) ** 2).mean())

    for _ in range(rounds):
        slack = 1 - sign * (rows @ w)
        inside = slack > 0
        gradient = ridge @ w - (rows[inside] * (sign * slack)[inside, None]).sum(0) / n
        step = np.linalg.solve(rows[inside].T @ rows[inside] / n + ridge, gradient)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-4:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn margins into scores; a toxic text weighs POSITIVE_WEIGHT."""
    weight = np.where(y > 0, POSITIVE_WEIGHT, 1.0)
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        gap, curve = weight * (p - (y > 0)), weight * p * (1 - p)
        hessian = np.array([[curve @ margin**2, curve @ margin], [curve @ margin, curve.sum()]]) + 1e-3 * np.eye(2)
        ds, do = np.linalg.solve(hessian, [gap @ margin + 1e-3 * slope, gap.sum()])
        slope, offset = slope - np.clip(ds, -5, 5), offset - np.clip(do, -5, 5)
    return float(max(slope, 1e-3)), float(offset)


def fit(landmarks: list[str], views: np.ndarray, y: np.ndarray) -> ToxicityModel:
    own = KernelViews(landmarks).of_words(landmarks)
    gram = (own + own.T) / 2 + 1e-3 * np.eye(len(landmarks))
    values, vectors = np.linalg.eigh(gram)
    whitened = vectors / np.sqrt(np.maximum(values, 1e-2)) @ vectors.T
    x = views @ whitened
    w, b = fit_svm(x, y)
    return ToxicityModel(landmarks, whitened, w, b, *fit_logistic(x @ w + b, y))


def constant(label: int) -> ToxicityModel:
    """A model that gives every text the score of this label."""
    return ToxicityModel(["none"], np.zeros((1, 1)), np.zeros(1), 0.0, 0.0, 30.0 if label else -np.inf)


def _overlap(a: str, b: str) -> bool:
    """Whether the words share four letters in a row."""
    return any(a[i : i + 4] in b for i in range(len(a) - 3))


def _counted(rows: DataFrame, parts_of, pos: int, neg: int) -> DataFrame:
    """``part, n, lift``: in how many texts a part occurs, and how much it tells of toxic ones."""

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, int(y)) for text, y in zip(frame["text"], frame["toxic"]) for p in parts_of(text)], columns=["part", "toxic"])

    counts = rows.mapInPandas(found, "part string, toxic int").groupBy("part").agg(F.sum("toxic").alias("pos"), F.count("*").alias("n"))
    spread = F.sqrt((F.col("n") + 1) / (pos + neg))
    return counts.withColumn("lift", (F.col("pos") / pos - (F.col("n") - F.col("pos")) / neg) / spread)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, landmarks: int = LANDMARKS) -> ToxicityModel:
    """Model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    About ``fit_rows`` labelled documents with the smallest hashes are taken, so
    the ids are few and broadcast; their tokens are counted, and their views
    computed, where the rows are.  Null labels and null texts are left out; of rows
    that repeat a doc_id in ``labels`` the largest label counts, and rows that repeat
    one in ``docs`` are texts of that label.  Without labelled texts, or with
    labels of one kind only, nothing is learned: every text has that kind's score, 0
    or 1, and 0 without any.
    """
    labels = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    if not n:
        return constant(0)
    grain = 1 << 30
    few = labels.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(grain)) < min(grain, grain * fit_rows // n))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(few), "doc_id")

    sides = rows.agg(F.sum("toxic"), F.count("*")).first()
    pos, neg = sides[0] or 0, sides[1] - (sides[0] or 0)
    if not pos or not neg:
        return constant(1 if pos else 0)
    words = _counted(rows, lambda text: {w for t in tokens_of(text) for w in words_of(t)}, pos, neg)
    telling = [r["part"] for r in words.where("n >= 3").orderBy(F.desc("lift"), "part").limit(PART_WORDS).collect()]
    parts = {w[i : i + k] for w in telling for k in PARTS for i in range(len(w) - k + 1)}

    def parts_of(text: str | None) -> set[str]:
        found = {w for t in tokens_of(text) for w in words_of(t)}
        return parts.intersection(w[i : i + k] for w in found for k in PARTS for i in range(len(w) - k + 1))

    ranked = _counted(rows, parts_of, pos, neg).where("lift > 0").orderBy(F.desc("lift"), F.desc(F.length("part")), "part").limit(landmarks * 50)
    marks: list[str] = []
    for part in (r["part"] for r in ranked.collect()):
        if len(marks) < landmarks and not any(_overlap(part, m) for m in marks):
            marks.append(part)
    marks = marks or ["none"]

    def viewed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        views = KernelViews(marks)
        for frame in frames:
            x = views.of_texts(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "views": list(x)})

    got = sorted(rows.mapInPandas(viewed, "doc_id long, toxic int, views array<float>").collect(), key=lambda r: (r["doc_id"], r["toxic"]))
    x = np.array([r["views"] for r in got], float).reshape(len(got), len(marks))
    return fit(marks, x, np.array([r["toxic"] for r in got]))


def toxicity(model: ToxicityModel):
    """A function of a text column: its score from 0 to 1."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        views = KernelViews(model.landmarks)
        for texts in batches:
            yield pd.Series(model.scores(views.of_texts(texts.tolist())).astype(float))

    return scored


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from a score of 0.7 on).

    A null or empty text, or one without words, has no view of any landmark, and
    the score of such a text.  Whole texts count, at any length.  Rows and other
    columns stay; columns of these names are replaced.
    """
    return docs.withColumn("score", toxicity(model)(F.col(text))).withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, name) for name in ("documents", "labels"))
    model = train(docs, labels.where(~held_out()))
    found = with_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
