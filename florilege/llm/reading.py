"""Reading level of each document: boosted regression trees over what the sender wrote.

1. A first pass over the documents takes out the sender's own text (`mail.own_lines`) and counts its paragraphs: one that stands
   in `REPEATS` messages or more is a notice that a mail system adds, not the sender's.
2. A second pass measures what is left: distributions of word and sentence length, vocabulary, syntax (lengths of clauses and
   how they open, marks) and cohesion between sentences.
3. Trees are fitted on the labelled documents: all of them up to `most_labels`, beyond that those with the smallest hashes.
4. They are cross-validated by source (no document is judged by a model that saw its source); the cut points between grades
   are set on the held-out scores.
5. The model is broadcast and every document is graded.

Messages whose own text fills one line or less (`mail.lines_of`), or has no words, have no level. Without labels no document
has a level.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.boosting import Boosted, Calibration, Settings, calibrate
from florilege.llm.mail import lines_of, own_lines
from florilege.session import cut
from florilege.skew import hot_values, salted_join

#: A paragraph that stands in this many messages is a notice.
REPEATS = 10
#: Up to this many notices (as 64-bit hashes, 1.6 MB) are broadcast; more are joined.
MOST_NOTICES = 200_000
MOST_LABELS = 20_000
FOLDS = 5

_SENTENCE = re.compile(r"[.!?]+(?:\s+|$)")
_CLAUSE = re.compile(r"[,;:()–]")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
#: Example and number notes in parentheses are no sentence ends and no words of the text.
_ASIDE = re.compile(r"\((?:e\.g\.|z\. ?B\.|p\. ?ex\.|no\.|nr\.|\d)[^()]*\)", re.I)
#: Words by which the language is told.
_MARKERS = ({"the", "and", "of"}, {"der", "die", "das", "und"}, {"la", "le", "et", "les"})
FEATURES = (
    "words", "sentences", "chars_mean", "chars_sd", "chars_q50", "chars_q75", "chars_q90", "chars_max", "share_7", "share_10", "share_13", "share_16", "share_3",
    "sentence_mean", "sentence_sd", "sentence_q10", "sentence_q50", "sentence_q90", "sentence_max", "types", "once", "entropy", "long_types",
    "commas", "commas_sentence", "clause_words", "clause_sd", "clause_q90", "openers", "asides", "colons", "questions", "paragraphs", "paragraph_words", "overlap_mean", "overlap_zero", "repeat_next", "long_sentence_share", "en", "de", "fr",
)


def measure(paragraphs: list[str]) -> list[float] | None:
    """The features of a text in the order of FEATURES; None for a text without words."""
    sentences: list[list[str]] = []
    clauses: list[list[str]] = []
    commas = questions = asides = colons = 0
    for p in paragraphs:
        p, dropped = _ASIDE.subn(" ", p)
        commas += p.count(",") + p.count(";")
        questions += p.count("?")
        asides += dropped + p.count("(")
        colons += p.count(":") + p.count("–") + p.count(" - ")
        for s in _SENTENCE.split(p):
            parts = [w for c in _CLAUSE.split(s.lower()) if (w := _WORD.findall(c))]
            if parts:
                clauses += parts
                sentences.append(list(chain.from_iterable(parts)))
    n = sum(map(len, sentences))
    if not n:
        return None
    counts = Counter(chain.from_iterable(sentences))
    by_length = [0] * (max(map(len, counts)) + 1)
    for w, k in counts.items():
        by_length[len(w)] += k
    above = list(accumulate(reversed(by_length)))[::-1]  # above[k]: words of k letters or more
    at_least = lambda k: above[k] / n if k < len(above) else 0.0
    mean = sum(k * c for k, c in enumerate(by_length)) / n
    spread = math.sqrt(max(0.0, sum(k * k * c for k, c in enumerate(by_length)) / n - mean * mean))
    per = sorted(map(len, sentences))
    m = len(per)
    per_mean = n / m
    per_spread = math.sqrt(max(0.0, sum(k * k for k in per) / m - per_mean * per_mean))
    entropy = math.log(n) - sum(k * math.log(k) for k in counts.values()) / n
    spans = sorted(map(len, clauses))
    c = len(spans)
    span_spread = math.sqrt(max(0.0, sum(k * k for k in spans) / c - (n / c) ** 2))
    # A word that opens several clauses is one that joins them.
    opens = Counter(x[0] for x in clauses)
    content = [{w for w in s if len(w) > 4} for s in sentences]
    shared = [len(a & b) / (min(len(a), len(b)) or 1) for a, b in zip(content, content[1:])]
    language = [sum(counts[w] for w in m) / n for m in _MARKERS]
    return [
        n, m, mean, spread, _rank(by_length, n, 0.5), _rank(by_length, n, 0.75), _rank(by_length, n, 0.9), len(by_length) - 1, at_least(7), at_least(10), at_least(13), at_least(16), 1 - at_least(4),
        per_mean, per_spread, per[m // 10], per[m // 2], per[m * 9 // 10], per[-1], len(counts) / n, sum(k == 1 for k in counts.values()) / n, entropy, sum(len(w) >= 10 for w in counts) / len(counts),
        commas / n, commas / m, n / c, span_spread, spans[c * 9 // 10], sum(k for k in opens.values() if k > 1) / c, asides / m, colons / m, questions / m, len(paragraphs), n / len(paragraphs), sum(shared) / len(shared) if shared else 0.0,
        shared.count(0.0) / len(shared) if shared else 1.0, sum(a[-1] == b[0] for a, b in zip(sentences, sentences[1:])) / m, sum(k >= 20 for k in per) / m, *language,
    ]


def _rank(by_length: list[int], n: int, share: float) -> float:
    """The word length below which `share` of the words lie, with the place within words of that length as fraction."""
    want, seen = share * n, 0
    for length, k in enumerate(by_length):
        if seen + k >= want:
            return length - 0.5 + (want - seen) / k if k else float(length)
        seen += k
    return float(len(by_length) - 1)


def notices(documents: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(h): hashes of the paragraphs that stand in `repeats` messages or more of documents (text)."""
    each = documents.select("text").mapInPandas(_paragraphs, "h long")
    return each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= repeats).select("h")


def _hash(paragraph: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(paragraph)) - (1 << 63)


def _paragraphs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": np.array([h for t in pdf["text"] for h in {_hash(p) for p in own_lines(t)}], np.int64)})


FEATURE_SCHEMA = "doc_id long, source string, n_words int, x array<float>"


def features(documents: DataFrame, most_notices: int = MOST_NOTICES) -> DataFrame:
    """documents (doc_id, source, text) to (doc_id, source, n_words, x: array<float>); x is null where there is no level."""
    found = cut(notices(documents))
    if found.limit(most_notices + 1).count() > most_notices:
        return _features_by_join(documents, found)
    known = found.sparkSession.sparkContext.broadcast(np.sort(np.array([r["h"] for r in found.collect()], np.int64)))

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drop = frozenset(known.value.tolist())
        for pdf in batches:
            yield _measured(pdf, [[p for p in own_lines(t) if _hash(p) not in drop] for t in pdf["text"]])

    return documents.select("doc_id", "source", "text").mapInPandas(measured, FEATURE_SCHEMA)


def _measured(pdf: pd.DataFrame, own: list[list[list[str]]]) -> pd.DataFrame:
    x = [measure([" ".join(lines) for lines in p]) for p in own]
    level = [v if v and lines_of(p) > 1 else None for v, p in zip(x, own)]
    return pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_words": [int(v[0]) if v else 0 for v in x], "x": level})


def _features_by_join(documents: DataFrame, found: DataFrame) -> DataFrame:
    """`features` with more notices than can be broadcast: own paragraphs as rows, notices anti-joined away, and regrouped.

    Rows are told apart by a number of their own, so that repeated document ids stay repeated.
    """
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [own_lines(t) for t in pdf["text"]]
            at = np.repeat(np.arange(len(pdf)), [len(p) for p in own])
            rows = pdf.iloc[at][["row", "doc_id", "source"]].assign(k=[k for p in own for k in range(len(p))], lines=[x for p in own for x in p], h=np.array([_hash(x) for p in own for x in p], np.int64))
            # Each document has a row without a paragraph, so that one that loses all of them is still there.
            yield pd.concat([rows, pdf[["row", "doc_id", "source"]].assign(k=-1, lines=None, h=pd.array([None] * len(pdf), "Int64"))])

    def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _measured(pdf, [[list(x["lines"]) for x in sorted(p, key=lambda x: x["k"]) if x["k"] >= 0] for p in pdf["own"]])

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "text")
    rows = cut(numbered.mapInPandas(split, "row long, doc_id long, source string, k int, lines array<string>, h long"))
    kept = salted_join(rows, found, "h", F.col("row"), hot_values(rows, "h"), "left_anti")
    whole = kept.groupBy("row", "doc_id", "source").agg(F.collect_list(F.struct("k", "lines")).alias("own"))
    return whole.mapInPandas(gathered, FEATURE_SCHEMA)


def training_rows(measured: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS) -> pd.DataFrame:
    """(source, level, x) of the labelled documents, at most `most_labels` of them, in the order of their hashes."""
    one = labels.where("doc_id is not null and level is not null").groupBy("doc_id").agg(F.max("level").alias("level"))
    both = measured.where("x is not null").dropDuplicates(["doc_id"]).join(one, "doc_id").select("doc_id", "source", "level", "x")
    return both.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).toPandas()


def fold_of(sources: pd.Series, folds: int = FOLDS) -> np.ndarray:
    """A fold for each row such that a source is in one fold only, the folds as even as that allows; a null source is one source."""
    names = sources.fillna("")
    load = np.zeros(folds, np.int64)
    fold = {}
    for name, n in names.value_counts().sort_index().sort_values(ascending=False, kind="stable").items():
        k = int(load.argmin())
        fold[name], load[k] = k, load[k] + n
    return names.map(fold).to_numpy()


def cross_validate(rows: pd.DataFrame, settings: Settings = Settings(), folds: int = FOLDS) -> np.ndarray:
    """Each row's score by a model that was fitted without its source; with one source only, without its half of the rows."""
    x, y = np.array(rows["x"].tolist(), np.float64), rows["level"].to_numpy(np.float64)
    part = fold_of(rows["source"], folds)
    if len(np.unique(part)) < 2:
        part = np.arange(len(rows)) % 2
    out = np.zeros(len(rows))
    for k in np.unique(part):
        held = part == k
        out[held] = Boosted(settings).fit(x[~held], y[~held]).predict(x[held])
    return out


def train(rows: pd.DataFrame, settings: Settings = Settings()) -> tuple[Boosted, Calibration, np.ndarray]:
    """The model over all rows, the grade cuts, and the held-out scores they were set on."""
    held_out = cross_validate(rows, settings)
    model = Boosted(settings).fit(np.array(rows["x"].tolist(), np.float64), rows["level"].to_numpy(np.float64))
    return model, calibrate(held_out, rows["level"].to_numpy()), held_out


def validate(rows: pd.DataFrame, settings: Settings = Settings(), folds: int = FOLDS) -> np.ndarray:
    """Each row's grade by a model and by cuts that both know nothing of its source: the cuts are set on scores held out among
    the other folds only. Rows of a single source are halved."""
    part = fold_of(rows["source"], folds)
    if len(np.unique(part)) < 2:
        part = np.arange(len(rows)) % 2
    out = np.zeros(len(rows), np.int64)
    for k in np.unique(part):
        held = part == k
        if held.all():
            return rows["level"].to_numpy(np.int64)
        model, calibration, _ = train(rows[~held].reset_index(drop=True), settings)
        out[held] = calibration.grade(model.predict(np.array(rows.loc[held, "x"].tolist(), np.float64)))
    return out


def grade(measured: DataFrame, model: Boosted, calibration: Calibration) -> DataFrame:
    """measured to (doc_id, source, n_words, score, level); score and level are null where there is no level."""
    shared = measured.sparkSession.sparkContext.broadcast((model, calibration))

    def graded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, calibration = shared.value
        for pdf in batches:
            has = pdf["x"].notna().to_numpy()
            score = np.full(len(pdf), np.nan)
            level = pd.array([None] * len(pdf), "Int32")
            if has.any():
                score[has] = model.predict(np.array(pdf.loc[has, "x"].tolist(), np.float64))
                level[has] = calibration.grade(score[has])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_words": pdf["n_words"], "score": pd.Series(score).astype("Float64").mask(~has), "level": level})

    return measured.mapInPandas(graded, "doc_id long, source string, n_words int, score double, level int")


def levels(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """documents and labels to (doc_id, source, n_words, score, level); all levels are null when no label can be used."""
    measured = cut(features(documents))
    rows = training_rows(measured, labels)
    if rows.empty:
        return measured.select("doc_id", "source", "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("level"))
    model, calibration, _ = train(rows, settings)
    return grade(measured, model, calibration)
