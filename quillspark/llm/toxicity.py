"""A toxicity classifier with counterfactual regularisation.

Features are the presence of words and of their first four to six letters. A logistic model is fitted on
a bounded sample of labelled rows. Where a labelled sentence names a group, each name is swapped for the
other names of its kind and for a neutral one, and the squared change of the score's logit is penalised,
so that naming a group is no evidence by itself.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import slices
from .common import ship_package

WORDS = re.compile(r"[^\W\d_]+")

#: Names that may be swapped for each other, and a neutral one for all.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("disabled", "deaf", "blind", "autistic", "elderly", "young"),
)
NEUTRAL = "people"


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to fit on at most; least: documents that a feature needs; strength: of the
    evidence that it needs, as the G statistic of its table with the label; most: features; ridge: weight
    decay; counterfactual: weight of the penalty on swapped names."""

    sample: int = 20_000
    least: int = 5
    strength: float = 20.0
    most: int = 4096
    ridge: float = 1e-5
    counterfactual: float = 1.0
    steps: int = 800
    terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS


def features_of(word: str) -> list[str]:
    return [word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) >= n)]


def words_of(text: str | None) -> set[str]:
    return set(WORDS.findall(text.lower())) if text else set()


class Presence(dict):
    """Places of a word's known features; forgets its words when it holds `limit`."""

    def __init__(self, places: dict[str, int], limit: int = 400_000):
        super().__init__()
        self.places, self.limit = places, limit

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = tuple(self.places[f] for f in features_of(word) if f in self.places)
        return out

    def of(self, words: set[str]) -> list[int]:
        return sorted({i for hit in filter(None, map(self.__getitem__, words)) for i in hit})


@dataclass
class Model:
    places: dict[str, int]
    weights: np.ndarray
    bias: float

    def logit(self, hits: list[int]) -> float:
        return self.bias + float(self.weights[hits].sum()) if hits else self.bias


def swaps(words: set[str], terms: tuple[tuple[str, ...], ...]) -> list[set[str]]:
    """The sentence's words with each name that it holds swapped for each other of its kind and the neutral one."""
    out = []
    for kind in terms:
        for term in kind:
            if term in words:
                rest = words - {term}
                out += [rest | {other} for other in (*kind, NEUTRAL) if other != term]
    return out


def swapped_features(text: str | None, presence: Presence, terms: tuple[tuple[str, ...], ...]) -> list[list[list[int]]]:
    """Features before and after each swap in each sentence of the whole text."""
    sentences = [words_of(x) for x in re.split(r"[.!?\n]+", text or "")]
    return [[presence.of(x), presence.of(y)] for x in sentences for y in swaps(x, terms)]


def fit(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, swapped: list[tuple[list[int], list[int]]], n: int, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. rows, cols: which features each labelled text has.
    swapped: features before and after a swap."""
    at = np.repeat(np.arange(len(swapped)), [len(a) + len(b) for a, b in swapped])
    moved = np.array([i for a, b in swapped for i in (*a, *b)], np.int64)
    sign = np.array([x for a, b in swapped for x in (*[1.0] * len(a), *[-1.0] * len(b))])
    w = np.zeros(n + 1)
    # Both labels weigh the same together: a single insult in a short text then counts against it.
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, s.steps + 1):
        z = w[n] + np.bincount(rows, w[cols], len(labels))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        off = (p - labels) * share
        g = np.append(np.bincount(cols, off[rows], n), off.sum())
        g[:n] += s.ridge * w[:n]
        if len(swapped):
            change = np.bincount(at, sign * w[moved], len(swapped))
            g[:n] += s.counterfactual * 2 / len(swapped) * np.bincount(moved, sign * change[at], n)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-12)
    return w[:n], float(w[n])


def held_out(id_col) -> F.Column:
    """Whether the CRC-32 of the id as text is divisible by 5 (a null id: of the empty text)."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. Rows held out, unlabelled or labelled both ways are not used."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other")).where("toxic = other").select("doc_id", "toxic")
    share = min(1.0, settings.sample / max(1, known.count()))
    # At most about `sample` rows, whatever the table's size: a bound that allows the broadcast.
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample = docs.join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id", "text").alias("key"))

    def count(batches):
        seen: Counter[str] = Counter()
        bad: Counter[str] = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = {f for w in words_of(text) for f in features_of(w)}
                seen.update(found)
                if toxic:
                    bad.update(found)
                if len(seen) > 300_000:
                    yield _counts(seen, bad)
                    seen.clear(), bad.clear()
        if seen:
            yield _counts(seen, bad)

    by_label = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_bad, n_good = by_label.get(1, 0), by_label.get(0, 0)
    if not n_bad or not n_good:
        return Model({}, np.zeros(0), 30.0 if n_bad else -30.0)
    counted = sample.mapInArrow(count, "feature string, n long, bad long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad, total = F.col("n").cast("double"), F.col("bad").cast("double"), n_bad + n_good
    cell = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    strength = 2 * (
        cell(bad, n * n_bad / total) + cell(n - bad, n * n_good / total)
        + cell(n_bad - bad, (total - n) * n_bad / total) + cell(n_good - n + bad, (total - n) * n_good / total)
    )
    chosen = counted.where(F.col("n") >= settings.least).withColumn("z", strength).where(F.col("z") >= settings.strength).orderBy(F.desc("z"), "feature").limit(settings.most)
    names = sorted({r["feature"] for r in chosen.collect()} | {t for kind in settings.terms for t in kind} | {NEUTRAL})
    places = {f: i for i, f in enumerate(names)}

    def present(batches):
        presence = Presence(places)
        for batch in batches:
            hits, swapped = [], []
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                hits.append(presence.of(words))
                named = any(t in words for kind in settings.terms for t in kind)
                swapped.append(swapped_features(text, presence, settings.terms) if named else [])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(hits, pa.list_(pa.int32())), pa.array(swapped, pa.list_(pa.list_(pa.list_(pa.int32()))))], ["key", "toxic", "hits", "swapped"])

    table = sample.mapInArrow(present, "key long, toxic int, hits array<int>, swapped array<array<array<int>>>").toArrow().sort_by("key")  # sums in one order
    pairs = [(x, y) for own in table["swapped"].filter(pc.greater(pc.list_value_length(table["swapped"]), 0)).to_pylist() for x, y in own]
    rows = np.repeat(np.arange(table.num_rows), pc.list_value_length(table["hits"]).to_numpy())
    weights, bias = fit(rows, pc.list_flatten(table["hits"]).to_numpy(), table["toxic"].to_numpy().astype(float), pairs, len(names), settings)
    return Model(places, weights, bias)


def _counts(seen: Counter, bad: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64()), pa.array([bad[f] for f in seen], pa.int64())], ["feature", "n", "bad"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= 0.5) of each whole text."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    shared: Broadcast = spark.sparkContext.broadcast((model.places, model.weights, model.bias))

    def run(batches):
        own = Model(*shared.value)
        presence = Presence(own.places)
        for batch in batches:
            for part in slices(batch, "text"):
                z = np.array([own.logit(presence.of(words_of(t))) for t in part.column(1).to_pylist()])
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, whose score is below 0.5; decided row by row, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.places, model.weights, model.bias))
    at = docs.columns.index(text_col)

    def run(batches):
        own = Model(*shared.value)
        presence = Presence(own.places)
        for batch in batches:
            yield batch.filter(pa.array([own.logit(presence.of(words_of(t.as_py()))) < 0 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = Settings()) -> DataFrame:
    """Train on the labelled rows that are not held out and score every document.

    Returns one row per input row: doc_id, held_out, score, predicted. Only the text is an input of the
    score. A null or empty text has no features and scores as such a text does in the sample. Null ids
    are scored too, and held out. Labels that are null, other than 0 and 1, or contradict each other are
    not used; without labels of both kinds, every score is that of the only label (0 without any). Other
    columns are ignored. An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(plain, labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")), settings)
    return score(plain, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
