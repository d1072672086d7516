"""Toxicity by compression distance.

Two zstandard dictionaries share one base, trained on ordinary text; one adds a dictionary
trained on what recurs in toxic texts, the other one trained on what recurs in ordinary
texts. A window of words is compressed with both, and the difference in bytes says which
side explains it better. Windows cover the whole text; their mean, extremes and counts are
turned into a probability by a logistic calibration.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuskit.llm.common import Scratch, blank_words, prepare, residue

WINDOW, LEVEL = 8, 12
BASE_BYTES, EXTRA_BYTES = 64 << 10, 1 << 10
#: The classifier is fitted on at most so many labelled texts of each class and so many others
#: of any class for the calibration, of at most ``SAMPLE_CHARS`` characters each.
SAMPLE_CLASS, SAMPLE_ANY, SAMPLE_CHARS = 1500, 3000, 20_000
#: A word recurs in a class if so many of its sample texts hold it, and so many times the other's share.
RECURS, RATIO = 15, 8
CUTOFF = 0.3
#: What ends the entropy tables of a trained dictionary: the three first repeat offsets (format constant).
REPEATS = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"


def windows(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i:i + WINDOW]) for i in range(0, len(words), WINDOW)] or [b" "]


def _trained(size: int, samples: list[bytes], k: int) -> tuple[bytes, bytes]:
    """(tables, content); empty where there is too little to train on."""
    try:
        whole = zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"", b""
    at = whole.index(REPEATS) + len(REPEATS)
    return whole[:at], whole[at:]


def _recurring(mine: list[list[bytes]], other: list[list[bytes]]) -> list[bytes]:
    here, there = (Counter(w for x in side for w in set(x)) for side in (mine, other))
    scale = RATIO * len(mine) / max(len(other), 1)
    keep = {w for w, c in here.items() if c >= RECURS and c >= scale * there[w]}
    return [w for x in mine for w in windows([t for t in x if t in keep]) if w != b" "]


@dataclass
class Model:
    """Dictionaries and calibration; plain bytes and numbers, so it can be sent to tasks."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] = field(default_factory=list)

    def _compressor(self, dictionary: bytes) -> zstandard.ZstdCompressor:
        if not dictionary:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
        how = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, dict_size=len(dictionary), source_size=256, write_content_size=False,
            write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=how)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=how)

    def open(self) -> Model:
        self._a, self._b = self._compressor(self.toxic).compress, self._compressor(self.ordinary).compress
        return self

    def features(self, words: list[bytes]) -> list[float]:
        a, b = self._a, self._b
        d = np.array([len(b(w)) - len(a(w)) for w in windows(words)], np.float64)
        top = np.sort(d)[::-1]
        return [1.0, d.mean(), top[0], top[:3].mean(), (d >= 2).mean(), np.log1p((d >= 2).sum()),
                np.log1p((d >= 3).sum()), d.min(), np.log1p(len(d))]

    def score(self, words: list[bytes]) -> float:
        x = float(np.dot(self.features(words), self.weights)) if self.weights else -2.0
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton steps with a ridge on standardised features; weights for the raw ones."""
    mean, scale = x[:, 1:].mean(axis=0), x[:, 1:].std(axis=0) + 1e-9
    z = np.column_stack([x[:, 0], (x[:, 1:] - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6] + [ridge] * (z.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    raw = w[1:] / scale
    return np.concatenate([[w[0] - raw @ mean], raw])


def fit(toxic: list[str], ordinary: list[str], any_: list[tuple[str, int]]) -> Model:
    """Dictionaries from the two class samples, calibration from labelled texts of both."""
    bad, good = [blank_words(t) for t in toxic], [blank_words(t) for t in ordinary]
    rng = random.Random(7)
    plain = [w for x in good for w in windows(x)]
    rng.shuffle(plain)
    tables, base = _trained(BASE_BYTES, plain[:80_000], 32)
    if not tables:
        return Model(b"", b"")
    sides = []
    for mine, other in ((bad, good), (good, bad)):
        samples = _recurring(mine, other)
        rng.shuffle(samples)
        sides.append(tables + base + _trained(EXTRA_BYTES, samples[:80_000], 16)[1])
    model = Model(*sides).open()
    y = np.array([t for _, t in any_], float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(np.array([model.features(blank_words(x)) for x, _ in any_]), y).tolist()
    return Model(model.toxic, model.ordinary, model.weights)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
             held_out: tuple[int, int] = (4, 2), sample_class: int = SAMPLE_CLASS, sample_any: int = SAMPLE_ANY) -> DataFrame:
    """(key, held_out, score, predicted) of every row.

    Rows whose crc32(key) leaves ``held_out[1]`` modulo ``held_out[0]`` teach nothing. Null
    and empty texts are scored as an empty window, very long ones whole, window by window.
    Without usable labels all scores equal the prior of a model without weights. Null labels and
    keys teach nothing; of rows that share a key one teaches. An empty table gives an empty
    result. Columns other than those named take no part, whatever their names.

    The sample is drawn on keys alone: labels meet the keys of texts of at most ``SAMPLE_CHARS``
    characters, a hash of the key deals them to the dictionaries (three of four) or to the
    calibration, and only the texts of the at most 2 x ``sample_class`` + ``sample_any`` drawn
    keys are read for the fit. No text is shuffled.
    """
    spark = docs.sparkSession
    prepare(spark)
    modulus, rest = held_out
    scratch = Scratch(spark, "toxicity")
    teach = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & (residue(F.col(key), modulus) != rest))
    known = docs.filter(F.char_length(text) <= SAMPLE_CHARS).select(key).distinct()
    part = F.pmod(F.xxhash64(F.lit("part"), key), F.lit(4))
    use = F.when(part == 0, "calibration").when(F.col("_label") == 1, "toxic").when(F.col("_label") == 0, "ordinary")
    drawn = scratch.store(known.join(teach.groupBy(key).agg(F.max(label).alias("_label")), key).select(
        key, "_label", use.alias("_use"), F.xxhash64(F.lit("sample"), key).alias("_u")), "keys")
    most = {"toxic": sample_class, "ordinary": sample_class, "calibration": sample_any}
    keys = [r for name, n in most.items()
            for r in drawn.filter(F.col("_use") == name).orderBy("_u", key).limit(n).select(key, "_label", "_use").collect()]
    scratch.drop(drawn)
    picked = spark.createDataFrame(keys, f"`{key}` {docs.schema[key].dataType.simpleString()}, _label int, _use string")
    sample = (docs.select(key, text).join(F.broadcast(picked), key)  # a row for each drawn key
              .groupBy(key, "_label", "_use").agg(F.min(text).alias("_text")).orderBy(key).collect()) if keys else []
    bad, good = ([r["_text"] for r in sample if r["_use"] == name] for name in ("toxic", "ordinary"))
    any_ = [(r["_text"], r["_label"]) for r in sample if r["_use"] == "calibration"]
    model = fit(bad, good, any_)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        own = Model(model.toxic, model.ordinary, model.weights).open()
        for batch in batches:
            scores = [own.score(blank_words(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=[key, "score"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double").select(
        key, (residue(F.col(key), modulus) == rest).alias("held_out"), "score",
        (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
