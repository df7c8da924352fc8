"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import markup, textvec
from .common import written

BUCKETS = 1 << 15
TRAIN_DOCS = 2000  #: labelled texts per language that the text model is fitted on, about (picked by hash); all that there are, where fewer
MOST_LANGUAGES = 1024  #: of a model, which is sent to all tasks: 128 KB a language
GRAMS = 100  #: a text counts as so many independent trigrams at most
PRIOR_WEIGHT = 5.0  #: rows that a wider level of the prior weighs as
SMOOTH = 0.5

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class TextModel:
    """Log-probabilities of hashed trigrams: one row per language."""

    languages: list[str]
    logs: np.ndarray


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of bytes (letters folded, all else a blank) that lies in one text and is no run of blanks, and its text."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x = _LETTER[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    inside = np.ones(len(code), bool)
    for cut in off[1:-1]:
        inside[max(cut - 2, 0) : cut] = False
    inside &= ~((x[:-2] == 32) & (x[1:-1] == 32)) & ~((x[1:-1] == 32) & (x[2:] == 32))
    at = np.flatnonzero(inside)
    bucket = (code[at] * np.uint32(2654435761)) >> np.uint32(17)
    return bucket.astype(np.int64), np.searchsorted(off, at, "right") - 1


def label_of(c: Column) -> Column:
    """A language label as the model and the declared language have it: in lower case, up to the first hyphen, underscore or blank ('en-US' is 'en'); empty where there is none."""
    return F.regexp_extract(F.lower(F.coalesce(c, F.lit(""))), r"^\s*([^-_\s]+)", 1)


def fit(docs: DataFrame, text: str = "text", label: str = "lang", per_language: int = TRAIN_DOCS) -> TextModel:
    """Fit the text model on about ``per_language`` whole texts of each label, counted in tasks and summed by language and bucket; all labels count (see ``label_of``); the table of sums, BUCKETS a language at most, comes to the driver. More than MOST_LANGUAGES labels are an error: such a column doesn't hold languages."""
    whole = F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t])  # of the row, so that copies of a text are picked one by one
    rows = docs.select(label_of(F.col(label)).alias("lang"), F.col(text).alias("text"), whole.alias("row")).where("lang <> '' and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{label} has more than {MOST_LANGUAGES} labels, so it doesn't hold languages")
    names = sorted(sizes)
    place = {x: i for i, x in enumerate(names)}
    if not names:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])[F.col("lang")]
    picked = rows.where(F.pmod("row", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for i, _, data, off in textvec.chunks(batch.column(1)):
                bucket, doc = _grams(data, off)
                cell, n = np.unique(of[i + doc] * BUCKETS + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell // BUCKETS), pa.array(cell % BUCKETS), pa.array(n)], ["k", "b", "n"])

    total = np.full((len(names), BUCKETS), SMOOTH)
    for r in picked.mapInArrow(counted, "k long, b long, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["k"], r["b"]] += r["n"]
    return TextModel(names, np.log(total / total.sum(1, keepdims=True)).astype(np.float32))


def text_evidence(rows: DataFrame, model: TextModel, text: str) -> DataFrame:
    """``rows`` without ``text``, with grams (trigrams in the text) and ll (log-likelihood per language, tempered to GRAMS trigrams)."""
    names = [c for c in rows.columns if c != text]
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != text) + ", grams long, ll array<double>"
    shared = rows.sparkSession.sparkContext.broadcast(model.logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            for i, j, data, off in textvec.chunks(batch.column(len(names))):
                bucket, doc = _grams(data, off)
                n = np.bincount(doc, minlength=j - i)
                ll = np.stack([np.bincount(doc, row[bucket], j - i) for row in logs], 1).astype(np.float64) if len(logs) else np.zeros((j - i, 0))
                ll *= np.minimum(1, GRAMS / np.maximum(n, 1))[:, None]
                ll -= ll.max(1, keepdims=True, initial=-np.inf) if len(logs) else 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * len(logs)), pa.array(ll.ravel()))
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in batch.columns[:-1]], pa.array(n), lists], [*names, "grams", "ll"])

    return rows.select(*names, text).mapInArrow(run, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """From pages (page_id, url, html): page_id, host, domain (its last two labels), declared, suffix and plain text.

    declared: the two or three letters of the html element's lang, else of its xml:lang, else of a meta element's content-language. suffix: a first path part of two letters, else the top-level domain.
    Null urls, null pages and pages without any such mark have empty values; a page is read whole, in time linear in its length (``markup``).
    """
    kind = dict(pages.dtypes)["page_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of = [x or "" for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([markup.declared(x) for x in pages_of], pa.string()), pa.array([markup.plain(x) for x in pages_of], pa.string())], ["page_id", "url", "declared", "plain"])

    seen = pages.select("page_id", F.lower(F.coalesce("url", F.lit(""))).alias("url"), "html").mapInArrow(read, f"page_id {kind}, url string, declared string, plain string")
    url = F.col("url")
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#-]|$)", 1)
    top = F.regexp_extract(host, r"\.([a-z]{2,3})$", 1)
    return seen.select("page_id", host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), "declared", F.when(path != "", path).otherwise(top).alias("suffix"), "plain")


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    return F.transform(scores, lambda x: F.exp(x - top))


def fused(rows: DataFrame, model: TextModel, id_col: str, text: str) -> DataFrame:
    """Fuse the evidence of rows (id, host, domain, declared, suffix, text): id, host, declared, suffix, grams, lang, confidence, text_lang.

    The posterior of a language is proportional to P(text) * P(declared) * P(suffix) * prior of the host. P(text) is the trigram model. The channels
    P(declared | language) and P(suffix | language) and the priors are grouped sums of the text posteriors over all rows. A host's prior is smoothed to its domain's, and that
    to the whole table's, each as if by PRIOR_WEIGHT more rows; a row's own share is taken out of its host's and domain's sums.
    Tables of the channels and host sums are joined by their known size, in parts where one host is large.
    An empty or missing value is an ordinary value of its channel. Without any language in the model lang is null.
    """
    k = len(model.languages)
    kind = dict(rows.dtypes)[id_col]
    base = rows.select(F.col(id_col).alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("host", "domain", "declared", "suffix")], F.col(text).alias("text"))
    if not k:
        return base.select(F.col("id").cast(kind).alias(id_col), "host", "declared", "suffix", F.lit(0).cast("long").alias("grams"), F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"))
    seen = text_evidence(base, model, "text").withColumn("e", _softmax(F.col("ll")))
    seen = written(seen.withColumn("p", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda s, y: s + y))).drop("e"))
    sums = [F.sum(F.element_at("p", i + 1)).alias(f"p{i}") for i in range(k)]
    total = [float(x or 0) for x in seen.agg(*sums).first()]
    whole = [(x + SMOOTH) / (sum(total) + k * SMOOTH) for x in total]
    prior = F.array(*[F.lit(x) for x in whole])
    vector = F.array(*[F.col(f"p{i}") for i in range(k)])

    def channel(name: str) -> DataFrame:
        t = written(seen.groupBy(name).agg(*sums))
        seen_values = t.count()
        return written(t.select(F.col(name).alias(f"c_{name}"), F.transform(vector, lambda x, i: F.log((x + SMOOTH) / (F.element_at(F.array(*[F.lit(v) for v in total]), i + 1) + SMOOTH * seen_values))).alias(f"log_{name}")))

    hosts = seen.groupBy("host", "domain").agg(*sums)
    hosts = written(hosts.select("host", "domain", vector.alias("host_p")))
    domains = written(hosts.groupBy("domain").agg(*[F.sum(F.element_at("host_p", i + 1)).alias(f"p{i}") for i in range(k)]).select("domain", vector.alias("domain_p")))
    hosts = written(hosts.join(domains, "domain").select(F.col("host").alias("h"), F.col("domain").alias("d"), "host_p", "domain_p"))
    out = seen.join(hosts, (F.col("host") == F.col("h")) & (F.col("domain") == F.col("d")))
    for name in ("declared", "suffix"):
        c = channel(name)
        out = out.join(c, F.col(name) == F.col(f"c_{name}"))
    m = PRIOR_WEIGHT
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    out = out.withColumns({"host_p": less("host_p", "p"), "domain_p": less("domain_p", "p")})
    size = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    out = out.withColumns({"host_n": size("host_p"), "domain_n": size("domain_p"), "prior": prior})
    out = out.withColumn("prior", F.zip_with("domain_p", "prior", lambda x, q: (x + m * q) / (F.col("domain_n") + m)))
    out = out.withColumn("prior", F.zip_with("host_p", "prior", lambda x, q: (x + m * q) / (F.col("host_n") + m)))
    score = F.transform(F.arrays_zip("ll", "log_declared", "log_suffix", "prior"), lambda z: z["ll"] + z["log_declared"] + z["log_suffix"] + F.log(z["prior"]))
    out = out.withColumn("score", score).withColumn("e", _softmax(F.col("score")))
    name_of = lambda c: F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position(c, F.array_max(c)).cast("int"))
    return out.select(F.col("id").alias(id_col), "host", "declared", "suffix", "grams", name_of(F.col("score")).alias("lang"), (1 / size("e")).alias("confidence"), F.when(F.col("grams") > 0, name_of(F.col("ll"))).alias("text_lang"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """Language of each page (page_id, url, html); null urls and pages have no evidence of that kind, repeated rows have a result each, an empty table has none."""
    return fused(page_evidence(pages), model, "page_id", "plain")


def identify_documents(docs: DataFrame, model: TextModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of each document (doc_id, text, lang, source), with the source as host and lang as the declared language; adds text_hash, and keeps the columns ``carry``."""
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("text_hash"), *carry).alias("key"), F.col("source").alias("host"), F.lit("").alias("domain"), label_of(F.col("lang")).alias("declared"), F.lit("").alias("suffix"), "text")
    return fused(rows, model, "key", "text").select("key.doc_id", "key.text_hash", *[f"key.{c}" for c in carry], *[c for c in ("declared", "grams", "lang", "confidence", "text_lang")])
