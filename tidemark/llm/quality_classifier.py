"""Quality by importance resampling with hashed n-gram models.

A model of wanted text is counted over words and word pairs, hashed to buckets, of labelled
good documents; a model of raw text over those of all documents.  A document's importance is
the mean logarithm of the ratio of the two, so that long texts aren't drawn for their length.
Documents are drawn without replacement with weights exp(importance / temperature): Gumbel
noise is added to importance / temperature and the top k stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

BUCKETS = 1 << 15
#: Labelled rows that the wanted model and the size of the sample are fitted on, at most.
LABELLED = 6_000

#: N-grams of no evidence that every document counts: a mean over few words is noise, and with
#: 30 more the mean of a text of ten words (19 n-grams) counts 0.39 of what it says.
PRIOR = 30
#: Of labelled good documents that the model wasn't counted on, the share that may score below the
#: sample's limit; one in 2,000 is what 3,000 of them can tell.
SPARE = 0.0005
#: Of the draw: at 0.005 noise of one moves a document by 0.005 in the mean log ratio.
TEMPERATURE = 0.005


def grams(data: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each row's words, as they are written, and word pairs; and where rows begin (rows + 1)."""
    starts, ends, begins = _kit.words(data, offs)
    h = _kit.span_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(begins))
    pair = _kit.sequence_hashes(h, 2)
    inside = row[:-1] == row[1:] if len(row) > 1 else np.zeros(0, bool)
    owner = np.r_[row, row[:-1][inside] if len(row) > 1 else row[:0]]
    value = (np.r_[h, pair[inside] if len(pair) else pair] >> np.uint64(20)) % np.uint64(buckets)
    order = np.argsort(owner, kind="stable")
    return value[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(offs)))


def tallied(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket comes up in the texts (column text): a task sends one row per bucket at most."""

    def count(batches):
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs in _kit.slices(batch["text"]):
                n += np.bincount(grams(data, offs, buckets)[0], minlength=buckets)
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full])], ["bucket", "n"])

    out = np.zeros(buckets)
    for x in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # buckets rows at most
        out[x["bucket"]] = x["n"]
    return out


@dataclass
class Model:
    """ratio: of each bucket, the logarithm of its probability in wanted text over that in raw text."""

    ratio: np.ndarray

    @staticmethod
    def of(wanted: np.ndarray, raw: np.ndarray) -> Model:
        # what raw text has of a bucket bounds what the wanted text can have: smoothing follows raw text
        prior = (raw + 1) / (raw + 1).sum()
        smooth = len(raw) / 4
        return Model(np.log((wanted + smooth * prior) / (wanted.sum() + smooth) / prior))

    def scores(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's mean ratio, as if PRIOR n-grams of ratio 0 were there too, and number of n-grams."""
        value, begins = grams(data, offs, len(self.ratio))
        n = np.diff(begins)
        total, full = np.zeros(len(n)), n > 0
        if full.any():  # each row is summed by itself: equal texts score alike, whatever is beside them
            total[full] = np.add.reduceat(self.ratio[value], begins[:-1][full])
        return total / (n + PRIOR), n


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "log_ratio", size: str = "n_grams") -> DataFrame:
    """docs with a score and a number of n-grams for each row; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 8 bytes a bucket

    def add(batches):
        for batch in batches:
            value, n = np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for row, end, data, offs in _kit.slices(batch["_text"]):
                value[row:end], n[row:end] = held.value.scores(data, offs)
            names = [x for x in batch.schema.names if x != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch[x] for x in names), pa.array(value), pa.array(n)], [*names, score, size])

    # inside, columns have numbers for names: names that clash do no harm
    plain = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)), _kit.text_of(text_col).alias("_text"))
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return plain.mapInArrow(add, f"{fields}, {score} double, {size} long").toDF(*docs.columns, score, size)


def gumbel(id_col: str, seed: int) -> Column:
    """Standard Gumbel noise from the id and the seed."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col).cast("string")), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def cut_off(keys: DataFrame, k: int, column: str = "key", bins: int = 1024) -> float:
    """The k-th largest value, by counting in bins that narrow around it; a few rows reach the driver."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    if low is None or k <= 0:
        return float("inf")
    above = 0  # rows over high, or at it once narrowed
    for _ in range(6):
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        at = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int")
        seen = {x["i"]: x for x in keys.where((F.col(column) >= low) & (F.col(column) <= high)).groupBy(at.alias("i")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for i in sorted(seen, reverse=True):
            if above + seen[i]["n"] >= k:
                low, high = seen[i]["low"], seen[i]["high"]
                break
            above += seen[i]["n"]
    return low


def lower_bound(sample: list[float], spare: float, sure: float = 0.95) -> float:
    """What all but a share ``spare`` of the values that a sorted sample stands for are over: one rule at any size.

    It is the lower of the sample's own quantile and of a normal tolerance bound, which is ``sure`` to be
    low enough: with few values it lies deeper, and with many it comes to the normal tail.
    """
    if not sample:
        return float("-inf")
    n, z, more = len(sample), NormalDist().inv_cdf(1 - spare), NormalDist().inv_cdf(sure)
    spread = float(np.std(sample, ddof=1)) if n > 1 else 0.0
    return min(sample[int(spare * n)], float(np.mean(sample)) - (z + more * (1 / n + z * z / (2 * n)) ** 0.5) * spread)


@dataclass
class Sampler:
    """A fitted classifier: importance / temperature + noise of a document at or over the limit stays."""

    model: Model
    limit: float
    temperature: float
    seed: int

    def key(self, id_col: str) -> Column:
        return F.col("log_ratio") / self.temperature + gumbel(id_col, self.seed)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = LABELLED, buckets: int = BUCKETS, temperature: float = TEMPERATURE, spare: float = SPARE, seed: int = 7) -> tuple[Sampler, DataFrame]:
    """A classifier with its sample size, and (id, log_ratio, n_grams, key) of every row of docs, written.

    Raw text is every document, wanted text every other good one of at most ``labelled``
    labelled rows (those of the smallest hashes).  The good rows between are held out: a model
    knows the texts it is made of too well.  k is the number of documents that score no lower
    than ``lower_bound`` tells all but a share ``spare`` of the good ones to do: the sample is to
    hold what is good, not to be small.  Lower temperatures draw closer to the order of importance.
    """
    few = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    few = few.orderBy(F.xxhash64(F.lit(seed), F.col("id")), "id").limit(labelled).collect()
    good = [x["id"] for x in few if x["label"] == 1]
    source = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))
    those = lambda ids: F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in ids], source.select("id").schema))  # noqa: E731  ``labelled`` ids at most
    known = source.join(those(good[::2]), "id", "left_semi")
    sampler = Sampler(Model.of(tallied(known, buckets), tallied(source, buckets)), float("-inf"), temperature, seed)
    keys = _kit.written(scored(source, sampler.model).select("id", "log_ratio", "n_grams", sampler.key("id").alias("key")), "scores")
    sample = sorted(x["log_ratio"] for x in keys.join(those(good[1::2]), "id", "left_semi").select("log_ratio").collect())
    sampler.limit = cut_off(keys, keys.where(F.col("log_ratio") >= lower_bound(sample, spare)).count())
    return sampler, keys


def resampled(docs: DataFrame, fitted: Sampler, id_col: str = "doc_id", text_col: str = "text", kept: str = "kept") -> DataFrame:
    """docs with log_ratio, n_grams and kept, whether the document is in the sample."""
    return scored(docs, fitted.model, text_col).withColumn(kept, fitted.key(id_col) >= fitted.limit)


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row per input row: id_col, log_ratio, n_grams, kept.

    A null text, or one without words, has the importance 0 of text no model tells apart.
    Rows that repeat an id get the same noise, and so equal texts of one id the same verdict;
    of rows that tie at the limit all stay.  The limit's rule is the same for any number of labels.  Without good labels every bucket's ratio comes
    from smoothing alone, and all documents stay.  Texts may be of any length.  Other columns
    are ignored; an empty table gives an empty result.
    """
    sampler, keys = fit(docs, labels, id_col, text_col, **fitting)
    return keys.select(F.col("id").alias(id_col), "log_ratio", "n_grams", (F.col("key") >= sampler.limit).alias("kept"))
