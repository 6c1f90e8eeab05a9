"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Vectors count trigrams of bytes (lower case, all that is no letter one space),
hashed into a fixed number of dimensions.  The training rows of a language are
clustered by spherical k-means into several centroids; a text has the language
of the centroid with the largest cosine.  Whether a text is too far from all of
them is judged against texts of about its length that centroids were not fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIMENSIONS = 4096
#: Training rows of a language that the model is fitted on, about.
ROWS_PER_LANGUAGE = 600
CENTROIDS = 4
LENGTH_CLASSES = 32
#: A text is rejected below this share of the smallest cosine of held-out texts of about its length;
#: where there was none, if it has next to nothing in common with any centroid.
SLACK, NOTHING = 0.8, 0.02
#: Every so many training rows are held out while distances are measured.
FOLD = 4

_LATIN = re.compile("[A-Za-z]")
_TABLE = np.full(256, 32, np.uint8)
_TABLE[128:] = np.arange(128, 256)
_TABLE[97:123] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def trigram_counts(text: str | None) -> np.ndarray:
    """Hashed trigram counts of a whole text, spaces around it."""
    raw = f" {text or ''} ".lower().encode("utf-8", "surrogatepass")
    b = _TABLE[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    blank = code == 0x202020
    slot = (code * np.uint32(2654435761)) >> np.uint32(20)
    return np.bincount(slot[~blank] if blank.any() else slot, minlength=DIMENSIONS)


@dataclass
class CentroidModel:
    languages: list[str]
    centroids: np.ndarray  # of all languages, one under the other
    language_of: np.ndarray
    idf: np.ndarray
    least: np.ndarray  # smallest cosine that is not rejected, by length class

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return normalised(np.log1p(counts) * self.idf)

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """``lang_pred, score, rejected`` of each text; without a language all are ``und``."""
        if not self.languages:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "rejected": True})
        out = []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            counts = np.stack([trigram_counts(t) for t in part]).astype(np.float32)
            cosines = self.vectors(counts) @ self.centroids.T
            best = cosines.argmax(1)
            score = np.clip(cosines[np.arange(len(part)), best], 0, 1).astype(float)
            far = score < self.least[length_class(counts.sum(1))]
            for text, k, s, f in zip(part, best, score, far):
                if has_letter(text):
                    out.append((self.languages[self.language_of[k]], float(s), bool(f)))
                else:
                    out.append(("und", 0.0, True))
        return pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])


def normalised(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n + 1).astype(int), LENGTH_CLASSES - 1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length; seeds are the rows farthest from those taken before."""
    mean = normalised(x.mean(0, keepdims=True))
    seeds = [int((x @ mean[0]).argmax())]
    while len(seeds) < min(k, len(x)):
        seeds.append(int((x @ x[seeds].T).max(1).argmin()))
    centres = x[seeds]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        centres = normalised(np.stack([x[own == j].sum(0) if (own == j).any() else centres[j] for j in range(len(centres))]))
    # the mean of all stays among them: it stands for texts of no cluster
    return np.concatenate([mean, centres])


def _centroids(vectors: np.ndarray, of: np.ndarray, languages: int, centroids: int) -> tuple[np.ndarray, np.ndarray]:
    groups = [spherical_kmeans(vectors[of == k], centroids) if (of == k).any() else np.empty((0, vectors.shape[1]), np.float32) for k in range(languages)]
    return np.concatenate(groups), np.repeat(np.arange(languages), [len(g) for g in groups])


def least_cosines(vectors: np.ndarray, counts: np.ndarray, of: np.ndarray, languages: int, centroids: int) -> np.ndarray:
    """Smallest cosine that is not rejected, by length class, from rows held out of the centroids."""
    out = np.full(LENGTH_CLASSES, NOTHING)
    away = np.arange(len(of)) % FOLD == 0
    if away.all() or not away.any():
        return out
    centres, _ = _centroids(vectors[~away], of[~away], languages, centroids)
    nearest, classes = (vectors[away] @ centres.T).max(1), length_class(counts[away].sum(1))
    for c in range(LENGTH_CLASSES):
        near = np.abs(classes - c) <= 1
        if near.any():
            out[c] = max(NOTHING, SLACK * float(nearest[near].min()))
    return out


def fit(languages: list[str], counts: np.ndarray, centroids: int = CENTROIDS) -> CentroidModel:
    seen = (counts > 0).sum(0)
    idf = (np.log((1 + len(counts)) / (1 + seen)) + 0.1).astype(np.float32)
    names = sorted(set(languages), key=lambda v: (-languages.count(v), v))
    if not names:
        return CentroidModel([], np.empty((0, DIMENSIONS), np.float32), np.empty(0, np.int64), idf, np.full(LENGTH_CLASSES, NOTHING))
    vectors = normalised(np.log1p(counts) * idf)
    of = np.array([names.index(v) for v in languages])
    centres, language_of = _centroids(vectors, of, len(names), centroids)
    return CentroidModel(names, centres, language_of, idf, least_cosines(vectors, counts, of, len(names), centroids))


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> CentroidModel:
    """Model of ``labelled(doc_id, text, lang)``, from a bounded part of each language's rows.

    About ``rows_per_language`` rows of each language with the smallest hashes are
    taken.  Counting trigrams is done where the rows are; the driver gets vectors.
    Null labels and null texts are left out; without a labelled text that has a
    letter the model knows no language, and all that it judges is ``und``.
    """
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return fit([], np.empty((0, DIMENSIONS), np.float32))
    grain = 1 << 30
    most = F.coalesce(*(F.when(F.col("lang") == v, F.lit(min(grain, grain * rows_per_language // n))) for v, n in sizes.items()))
    taken = labelled.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(grain)) < most)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"]):
                if has_letter(text):
                    c = trigram_counts(text)
                    at = np.flatnonzero(c)
                    rows.append((doc, lang, at.astype(np.uint16).tobytes(), c[at].astype(np.uint32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "at", "n"])

    rows = sorted(taken.mapInPandas(counted, "doc_id long, lang string, at binary, n binary").collect(), key=lambda r: (r["lang"], r["doc_id"] or 0, r["at"]))
    counts = np.zeros((len(rows), DIMENSIONS), np.float32)
    for row, r in zip(counts, rows):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
    return fit([r["lang"] for r in rows], counts)


def with_language(docs: DataFrame, model: CentroidModel, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0, and rejected.
    Others have a learned language, whatever their length; they are rejected if
    they are too far from every centroid for a text of their length.  Equal
    cosines go to the language with more training rows.  Repeated rows and other
    columns stay; columns of these names are replaced.  An empty table gives no rows.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield model.predict(texts.tolist())

    # not to be evaluated again where its parts are filtered
    found = docs.withColumn("__language", predicted.asNondeterministic()(F.col(text)))
    return found.withColumns({c: F.col(f"__language.{c}") for c in ("lang_pred", "score", "rejected")}).drop("__language")


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    found = with_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
