"""Language identification by Bayesian fusion of evidence.

For each row the log-probabilities of the languages add up from

* the text: naive Bayes over hashed byte trigrams, tempered, since neighbouring trigrams say much the same;
* the language that its markup declares: how often that is declared for texts of each language;
* the suffix of its address: how often that is seen for texts of each language;
* its host: a prior smoothed towards the host's domain, which is smoothed towards all rows.

Counts of declarations, suffixes and hosts are sums of the text's posteriors over all rows, by grouped aggregation; evidence that
a row doesn't have adds nothing. Only the trigram table is fitted on labelled rows, of which ``TRAINING_ROWS`` are drawn at most.

The posterior only compares the fitted languages with each other. Whether a text is in any of them is told by its mean
log-likelihood per trigram: labelled rows, each judged by a table without it, say how low that may be for a text of that length.
A text that fits none is not accepted and is no evidence for others.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm import rolling
from caseloom.llm.common import cut_lineage, slices, small_batches

#: Labelled rows that the trigram table is fitted on, about, and its size.
TRAINING_ROWS, BINS = 4000, 1 << 15
#: Trigrams that count as one independent piece of evidence.
TEMPER = 3.0
#: Rows that a smoothed prior or share counts its parent for.
WEIGHT = 10.0
#: Posterior from which a row with letters is accepted, if it fits its language. Low, so that short texts that fit several languages stay.
ACCEPT = 0.3
#: Standard deviations below the labelled rows' mean at which a text doesn't fit a language; rows that a spread of 0.5 counts for.
BOUND, SPREAD = 6.0, 0.5

#: Letters outside ASCII are bytes from 0x80 on in UTF-8.
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.DOTALL | re.IGNORECASE)


def _trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams that hold a letter, and the row of each."""
    data, offsets = rolling.text_bytes(column)
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = rolling.LOWERED[data]
    x = data.astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    letter = _LETTER[data]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (row[:-2] == row[2:]) & (letter[:-2] | letter[1:-1] | letter[2:])
    bins = ((code[inside] * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int64)
    return bins, row[:-2][inside]


@dataclass(frozen=True)
class TextModel:
    languages: list[str]
    table: np.ndarray  # languages x bins, log-probabilities
    mean: np.ndarray  # per language, of the labelled rows' log-likelihoods per trigram
    row_variance: np.ndarray  # between rows
    trigram_variance: np.ndarray  # between trigrams

    def fits(self, values: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether tempered log-likelihoods of ``n`` trigrams are as high as those of labelled rows; a text without trigrams fits."""
        n = np.maximum(n, 1)[:, None]
        low = self.mean - BOUND * np.sqrt(self.row_variance + TEMPER * self.trigram_variance / n)
        return (values * TEMPER / n >= low) | (values == 0)

    def log_likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tempered log-likelihoods (rows x languages), and the numbers of trigrams and of letter bytes of each row."""
        bins, row = _trigrams(column)
        data, offsets = rolling.text_bytes(column)
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])[offsets]
        out = np.empty((len(column), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(row, self.table[k][bins], len(column)) / TEMPER
        return out, np.bincount(row, minlength=len(column)), np.diff(letters)


def fit_text_model(labelled: DataFrame, text_column: str = "text", language_column: str = "lang", rows: int = TRAINING_ROWS) -> TextModel | None:
    """Trigram table of a hash sample of about ``rows`` rows with a label; None without labels. The sums are of fixed size."""
    small_batches(labelled.sparkSession)
    usable = labelled.filter(F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(text_column).alias("text"), F.col(language_column).alias("lang"))
    total = usable.count()
    share = min(1.0, rows / total) if total else 0.0
    sample = usable.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            bins, row = _trigrams(batch.column("text"))
            names = batch.column("lang").to_pylist()
            for name in set(names):
                own = np.array([n == name for n in names])
                sums[name] = sums.get(name, 0) + np.bincount(bins[own[row]], minlength=BINS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.astype(np.int64).tobytes() for v in sums.values()], pa.binary())], names=["lang", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] = sums.get(name, 0) + np.frombuffer(part, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["lang", "sums"])

    schema = "lang string, sums binary"
    found = sorted(sample.mapInArrow(count, schema).repartition("lang").mapInArrow(add, schema).collect())
    if not found:
        return None
    names, counts = [r.lang for r in found], np.stack([np.frombuffer(r.sums, np.int64) for r in found]) + 0.5
    shared = labelled.sparkSession.sparkContext.broadcast((names, counts))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = shared.value
        total, sums = counts.sum(axis=1), np.zeros((len(names), 6))
        for batch in slices(batches):
            bins, row = _trigrams(batch.column("text"))
            number = np.array([names.index(n) for n in batch.column("lang").to_pylist()], np.int64)
            n = np.bincount(row, minlength=batch.num_rows)
            _, back, own = np.unique(row * BINS + bins, return_inverse=True, return_counts=True)
            label = number[row]
            value = np.log((counts[label, bins] - own[back]) / (total[label] - n[row]))
            some = n > 0
            means = np.bincount(row, value, batch.num_rows)[some] / n[some]
            for c, (of, v) in enumerate([(number[some], np.ones(len(means))), (number[some], means), (number[some], means ** 2), (label, np.ones(len(value))), (label, value), (label, value ** 2)]):
                sums[:, c] += np.bincount(of, v, len(names))
        yield pa.RecordBatch.from_arrays([pa.array(names), *[pa.array(v) for v in sums.T]], names=["lang", *"abcdef"])

    judged = sample.mapInArrow(judge, "lang string, " + ", ".join(f"{c} double" for c in "abcdef")).groupBy("lang").agg(*[F.sum(c).alias(c) for c in "abcdef"]).collect()
    rows_, x, xx, trigrams, v, vv = np.array([list(r)[1:] for r in sorted(judged)]).T
    mean = np.where(rows_ > 0, x / np.maximum(rows_, 1), -math.log(BINS))
    row_variance = (np.maximum(xx - rows_ * mean ** 2, 0) + WEIGHT * SPREAD ** 2) / (rows_ + WEIGHT)
    trigram_variance = np.maximum(vv / np.maximum(trigrams, 1) - (v / np.maximum(trigrams, 1)) ** 2, 0)
    return TextModel(names, np.log(counts / counts.sum(axis=1, keepdims=True)), mean, row_variance, trigram_variance)


def visible_text(page: str) -> str:
    return html.unescape(_MARKUP.sub(" ", page))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``page_id``, ``text`` (markup, to be stripped), ``declared``, ``suffix``, ``host``, ``domain`` from ``page_id, url, html``."""
    attribute = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    labels = F.split("host", r"\.")
    named = pages.select("page_id", F.col("html").alias("text"), F.nullif(attribute, F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    several = F.size(labels) > 1
    return named.withColumn("suffix", F.when(several, F.element_at(labels, -1))).withColumn("domain", F.when(several, F.array_join(F.slice(labels, -2, 2), ".")))


def _text_evidence(rows: DataFrame, model: TextModel, markup: bool) -> DataFrame:
    """``key``, ``declared``, ``suffix``, ``host``, ``domain``, ``trigrams``, ``letters``, ``likelihood`` and
    ``fits`` (one log-likelihood per language, and whether the text fits it)."""
    small_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    carried = ["key", "declared", "suffix", "host", "domain"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = batch.column("text")
            if markup:
                text = pa.array([visible_text(t or "") for t in text.to_pylist()], pa.string())
            values, n, letters = shared.value.log_likelihoods(text)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], pa.array(n.astype(np.int64)), pa.array(letters.astype(np.int64)), pa.array(values.tolist(), pa.list_(pa.float64())), pa.array(shared.value.fits(values, n).tolist(), pa.list_(pa.bool_()))],
                                             names=[*carried, "trigrams", "letters", "likelihood", "fits"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.select(*carried, "text").mapInArrow(run, f"{kinds}, trigrams bigint, letters bigint, likelihood array<double>, fits array<boolean>")


def _softmax(values: Column) -> Column:
    top = F.array_max(values)
    raised = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def fuse(evidence: DataFrame, model: TextModel, accept: float = ACCEPT) -> DataFrame:
    """``key, lang, confidence, accepted, text_lang, declared, suffix, host`` for the rows of ``_text_evidence`` (a checkpoint).

    Sums over a frequent host or suffix are pre-aggregated in each task; hosts are joined back by an ordinary join, whose skew
    the adaptive join splits. A row without trigrams has no text evidence: ``lang`` then says what the rest makes likely. A row
    without letters, or whose text doesn't fit that language, isn't accepted. Texts that fit no language are left out of all sums.
    """
    names = range(len(model.languages))
    seen = evidence.filter("trigrams > 0 AND exists(fits, f -> f)").withColumn("_p", _softmax(F.col("likelihood"))).select("declared", "suffix", "host", "domain", *[F.col("_p")[k].alias(f"r{k}") for k in names])
    sums = [F.sum(f"r{k}").alias(f"s{k}") for k in names]
    total = seen.agg(*[F.coalesce(F.sum(f"r{k}"), F.lit(0.0)).alias(f"s{k}") for k in names]).first()
    n = sum(total)
    overall = F.array(*[F.lit((s + 1) / (n + len(names))) for s in total])

    def smoothed(parent: Column) -> Column:
        count = sum((F.col(f"s{k}") for k in names), F.lit(0.0))
        return F.array(*[(F.col(f"s{k}") + WEIGHT * parent[k]) / (count + WEIGHT) for k in names])

    hosts = seen.filter("host IS NOT NULL").groupBy("host", "domain", "suffix").agg(*sums)
    domains = hosts.filter("domain IS NOT NULL").groupBy("domain").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in names]).select("domain", smoothed(overall).alias("_domain"))
    suffixes = hosts.filter("suffix IS NOT NULL").groupBy("suffix").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in names])
    # a language's share of rows with this suffix; the weight of one average suffix smooths it
    kinds, *addressed = suffixes.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in names]).first()
    suffixes = suffixes.select(F.col("suffix").alias("_s"), F.array(*[F.log((F.col(f"s{k}") + WEIGHT / max(kinds, 1)) / (addressed[k] + WEIGHT)) for k in names]).alias("_suffix"))
    prior = hosts.join(domains, "domain", "left").join(suffixes, F.col("suffix") == F.col("_s"), "left")
    none = F.array(*[F.lit(0.0) for _ in names])
    prior = prior.select(F.col("host").alias("_host"), F.transform(smoothed(F.coalesce("_domain", overall)), lambda v: F.log(v)).alias("_prior"), F.coalesce("_suffix", none).alias("_suffix"))
    # at most one row per language and one for all other declarations
    said = F.when(F.col("declared").isin(model.languages), F.col("declared")).otherwise("other")
    table = {r["said"]: [r[f"s{k}"] for k in names] for r in seen.filter("declared IS NOT NULL").groupBy(said.alias("said")).agg(*sums).collect()}
    kinds = [*model.languages, "other"]
    column = [sum(table.get(d, [0.0] * len(names))[k] for d in kinds) for k in names]
    declared = F.coalesce(*[F.when(said == d, F.array(*[F.lit(math.log((table.get(d, [0.0] * len(names))[k] + WEIGHT / len(kinds)) / (column[k] + WEIGHT))) for k in names])) for d in kinds])
    joined = evidence.join(prior, evidence["host"] == prior["_host"], "left")
    values = F.array(*[F.col("likelihood")[k] + F.coalesce(F.col("_prior")[k], F.log(overall[k])) + F.coalesce(F.col("_suffix")[k], F.lit(0.0)) + F.when(F.col("declared").isNull(), 0.0).otherwise(declared[k]) for k in names])
    scored = joined.withColumn("_post", _softmax(values))
    label = lambda column: F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position(column, F.array_max(column)).cast("int"))
    return scored.select("key", label(F.col("_post")).alias("lang"), F.array_max("_post").alias("confidence"), ((F.array_max("_post") >= accept) & (F.col("letters") > 0) & F.element_at("fits", F.array_position("_post", F.array_max("_post")).cast("int"))).alias("accepted"),
                         F.when(F.col("trigrams") > 0, label(F.col("likelihood"))).alias("text_lang"), "declared", "suffix", "host")


def identify(documents: DataFrame, pages: DataFrame | None = None, model: TextModel | None = None) -> DataFrame:
    """Languages of ``documents`` (doc_id, text, lang, source) and ``pages`` (page_id, url, html) in one model.

    A document's source is its host; its ``lang`` is only a label to fit on. Pages bring declaration, suffix, host and domain; in
    the result a page has ``doc_id = -1 - page_id``. Result: ``doc_id, lang, confidence, accepted, text_lang, declared, suffix, host``.

    Nulls are missing evidence. Null, empty and letterless texts are not accepted, nor are texts in none of the labelled languages. Ties go to the first language by name. Repeated
    rows count and are answered each; null ids stay null. Without any labelled document ``lang`` is null and all rows are accepted,
    as there is nothing to tell them apart. Other columns are not read; empty tables give an empty result.
    """
    model = model or fit_text_model(documents)
    none = F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").alias("key"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    sites = page_evidence(pages).withColumn("key", -1 - F.col("page_id")) if pages is not None else None
    if model is None:
        whole = rows if sites is None else rows.unionByName(sites.select(*rows.columns))
        return whole.select(F.col("key").alias("doc_id"), none.alias("lang"), F.lit(None).cast("double").alias("confidence"), F.lit(True).alias("accepted"), none.alias("text_lang"), "declared", "suffix", "host")
    evidence = _text_evidence(rows, model, False)
    if sites is not None:
        evidence = evidence.unionByName(_text_evidence(sites, model, True))
    return fuse(cut_lineage(evidence), model).withColumnRenamed("key", "doc_id")


def in_known_language(documents: DataFrame) -> DataFrame:
    """The documents whose language is accepted, with all their columns. Rows are told apart by id and text."""
    marked = documents.select(F.struct("doc_id", F.xxhash64("text").alias("print")).alias("doc_id"), "text", "lang", "source")
    rejected = identify(marked).filter(~F.col("accepted")).select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.print").alias("_print")).distinct()
    same = documents["doc_id"].eqNullSafe(rejected["_id"]) & (F.xxhash64(documents["text"]) == rejected["_print"])
    return documents.join(rejected, same, "left_anti")
