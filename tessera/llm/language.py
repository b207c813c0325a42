"""Language of web pages by Bayesian evidence fusion.

For each language, the log posterior adds up
 text      a naive Bayes likelihood of the visible text's runs of 1 to 3 characters, its mean over
           the runs counted for `text_runs` of them at most, so that long texts don't drown the rest
 declared  P(lang attribute of the html element | language)
 suffix    P(last label of the host name | language)
 host      P(language | host), smoothed towards the registered domain, and that towards all pages,
           without the page's own share
The last three are estimated from all pages by grouped aggregation of the text's own posteriors, so
no page needs a label. The likelihood is fitted on about `sample` documents of each language (by a
hash of their ids), the classes are the languages found there; beyond MOST_LANGUAGES the codes of the fewest documents
are one class, OTHER.

Null html is an empty text, null url an empty host; an absent attribute or suffix is a value of its
own. Without any text, the text is no evidence. Ties go to the language code that sorts first. Rows
with the same page_id are judged each. Without any labelled document the result is empty of columns'
values: language and probability are null. Extra columns are ignored.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, join_spread
from .textops import LOWER, U, combine, flat, mix, slices, small

SAMPLE, TEXT_RUNS, HOST_WEIGHT, DOMAIN_WEIGHT, SMOOTHING = 300, 25, 4.0, 8.0, 0.5
SLOT_BITS, MOST_LANGUAGES, OTHER = 16, 200, "other"
# Labels under which countries register names, so that a registered name has one label more.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gouv", "gov", "go", "gv", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SLICE_BYTES = 1 << 20


def visible_text(page: str | Column) -> Column:
    """The text of a page: no scripts, styles, comments or tags; white space as one blank. Entities stay for `decoded`."""
    bare = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def declared_language(page: str) -> Column:
    """The first two or three letters of the html element's lang attribute, wherever it stands outside comments and scripts, or ''."""
    bare = F.regexp_replace(page, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    tag = F.regexp_extract(bare, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})\b", 1)
    return F.coalesce(F.lower(tag), F.lit(""))


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def decoded(texts: pa.Array) -> pa.Array:
    """Texts with their entities as the characters that they stand for."""
    found = pc.indices_nonzero(pc.fill_null(pc.match_substring(texts, "&"), False)).to_pylist()
    if not found:
        return texts
    plain = texts.to_pylist()
    for k in found:
        plain[k] = html.unescape(plain[k])
    return pa.array(plain, pa.large_string())


def domain_of(host: str) -> Column:
    """The registered name: the last two labels, or three under a country's second-level label."""
    three = F.col(host).rlike(r"(^|\.)(" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2}$")
    return F.when(three, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def _runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all runs of 1 to 3 characters within documents (digits and signs count as blanks), and the document of each."""
    low = LOWER[data]
    letter = (low >= 97) & (low <= 122) | (low >= 128)
    low = np.where(letter, low, 32)
    first = np.flatnonzero((low & 0xC0) != 0x80)
    doc = np.searchsorted(offs, first, "right") - 1
    size = np.diff(np.append(first, len(low)))
    char = low[first].astype(np.uint64)
    for k in (1, 2, 3):
        on = size > k
        char[on] = char[on] << U(8) | low[np.minimum(first + k, len(low) - 1)][on]
    char = mix(char + U(1))
    out, who = [], []
    for n in (1, 2, 3):
        h = combine(char, n)
        ok = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, bool)
        out.append(mix(h + U(n)) >> U(64 - SLOT_BITS))
        out[-1] = out[-1][ok].astype(np.int64)
        who.append(doc[: len(h)][ok])
    return np.concatenate(out), np.concatenate(who)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and each slot's log probability in each, from about `sample` documents of a language: those whose ids hash below the language's share.

    The MOST_LANGUAGES - 1 codes with the most documents are languages of their own; if there are more codes, the others are together one, OTHER.
    """
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"))
    sizes = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1)
    sizes = sorted((r["lang"], r["count"]) for r in sizes.collect())
    if len(sizes) > MOST_LANGUAGES:
        top = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES - 1).select("lang")
        known = known.join(F.broadcast(top.withColumn("own", F.lit(True))), "lang", "left")  # MOST_LANGUAGES rows
        known = known.withColumn("lang", F.when(F.col("own"), F.col("lang")).otherwise(OTHER)).drop("own")
        sizes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    if not sizes:
        return [], np.zeros((0, 1 << SLOT_BITS))
    below = [(lang, max(-(1 << 63), min((1 << 63) - 1, int(min(1.0, sample / n) * 2.0**64) - (1 << 63)))) for lang, n in sizes]
    share = docs.sparkSession.createDataFrame(below, "lang string, below long")  # a row for each language
    own = known.join(F.broadcast(share), "lang").where("h <= below").select("lang", "text").repartition("lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data, offs = flat(pa.array([text.as_py()], pa.large_string()))
                total = found.setdefault(lang, np.zeros(1 << SLOT_BITS))
                for a in range(0, len(data), SLICE_BYTES):
                    part = data[a : a + SLICE_BYTES + 12]  # runs at the cut count on either side
                    total += np.bincount(_runs(part, np.array([0, len(part)]))[0], minlength=1 << SLOT_BITS)
        for lang, total in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([total.tobytes()], pa.binary())], names=["lang", "counts"])

    counts = {lang: np.full(1 << SLOT_BITS, 0.01) for lang, _ in sizes}
    for r in own.mapInArrow(count, "lang string, counts binary").toLocalIterator():  # a row for each language
        counts[r["lang"]] += np.frombuffer(r["counts"], float)
    return [lang for lang, _ in sizes], np.array([np.log(counts[lang] / counts[lang].sum()) for lang, _ in sizes])


def text_evidence(pages: DataFrame, weights: np.ndarray, text_runs: int = TEXT_RUNS) -> DataFrame:
    """pages(text, ...) with `evidence`: a tempered log likelihood for each language."""
    sent = pages.sparkSession.sparkContext.broadcast(weights.astype(np.float32))  # languages x 2**SLOT_BITS
    names = pages.columns

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in small(batches):
            data, offs = flat(decoded(batch.column("text")))
            rows = []
            for i, j in slices(offs, SLICE_BYTES):
                slot, doc = _runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                n = np.bincount(doc, minlength=j - i)
                total = np.stack([np.bincount(doc, w[k][slot], j - i) for k in range(len(w))], 1)
                rows.append(total / np.maximum(n, 1)[:, None] * np.minimum(n, text_runs)[:, None])
            found = np.concatenate(rows) if rows else np.zeros((0, len(w)))
            found -= found.max(1, keepdims=True) if len(found) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.float64()))], names=[*names, "evidence"])

    schema = pages.select("*", F.array(F.lit(0.0)).alias("evidence")).schema
    return pages.mapInArrow(weigh, schema)


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per page: page_id, lang, probability, text_lang (of the text alone), declared, suffix, host."""
    scratch = Scratch(pages.sparkSession, "language")
    langs, weights = fit(docs, sample)
    host = host_of("url")
    own = pages.select("page_id", F.coalesce(visible_text("html"), F.lit("")).alias("text"), declared_language("html").alias("declared"), host.alias("host"))
    own = own.withColumn("suffix", F.when(F.col("host").rlike(r"\.[a-z]{2,}$"), F.substring_index("host", ".", -1)).otherwise(""))
    own = own.withColumn("domain", domain_of("host"))
    if not langs:
        none = F.lit(None).cast("string")
        return own.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"), none.alias("text_lang"), "declared", "suffix", "host")
    k, n = range(len(langs)), len(langs)
    seen = text_evidence(own, weights)
    sums = F.aggregate("evidence", F.lit(0.0), lambda s, x: s + F.exp(x))
    seen = seen.select("page_id", "declared", "suffix", "host", "domain", "evidence", F.transform("evidence", lambda x: F.exp(x) / sums).alias("w"))
    seen = scratch.keep(seen, "seen")
    whole = seen.agg(*[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"all{i}") for i in k], F.count("*").alias("pages"), F.count_distinct("declared").alias("declared_n"), F.count_distinct("suffix").alias("suffix_n")).first()
    total = [whole[f"all{i}"] for i in k]
    page = seen
    for by in ("declared", "suffix", "domain", "host"):
        counted = scratch.keep(seen.groupBy(by).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("w")[i]) for i in k]).alias("s")), by)
        page = join_spread(page, counted, by, "s", f"{by}_s", whole["pages"])
    page = page.select("*", *[F.col(f"{by}_s")[i].alias(f"{by}{i}") for by in ("declared", "suffix", "domain", "host") for i in k])
    logs = []
    for i in k:
        w = F.col("w")[i]
        share = (F.lit(total[i]) - w + 1) / (F.lit(sum(total)) - 1 + n)
        domain_rest, host_rest = (sum((F.col(f"{by}{j}") for j in k), F.lit(0.0)) - 1 for by in ("domain", "host"))
        domain = (F.col(f"domain{i}") - w + DOMAIN_WEIGHT * share) / (domain_rest + DOMAIN_WEIGHT)
        prior = (F.col(f"host{i}") - w + HOST_WEIGHT * domain) / (host_rest + HOST_WEIGHT)
        log = F.col("evidence")[i] + F.ln(F.greatest(prior, F.lit(1e-9)))
        for by in ("declared", "suffix"):
            values = whole[f"{by}_n"]
            log = log + F.ln((F.greatest(F.col(f"{by}{i}") - w, F.lit(0.0)) + SMOOTHING) / (F.lit(total[i]) - w + SMOOTHING * values))
        logs.append(log)
    page = page.select("page_id", "declared", "suffix", "host", "evidence", F.array(*logs).alias("logs"))
    codes = F.array(*[F.lit(x) for x in langs])
    best = F.array_max("logs")
    first = lambda c: F.element_at(codes, F.array_position(c, F.array_max(c)).cast("int"))
    probability = F.lit(1.0) / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    return page.select("page_id", first("logs").alias("lang"), probability.alias("probability"), first("evidence").alias("text_lang"), "declared", "suffix", "host")
