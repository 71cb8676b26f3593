"""Toxicity from many weak voters: a label model weighs them, a linear classifier learns from its posterior.

Method. Voters are the annotation, (a) lexicon voters: word beginnings and words that are far commoner in texts labelled toxic, each a
voter of its own that speaks (toxic) when the text has it, and (b) pattern voters on the text's form (shouting, repeated
marks, no lexicon word at all) that may speak for either side. The annotation's reliability is given, so that the classes
cannot drift; the others' is estimated. A generative label model estimates by
expectation-maximisation how often each voter speaks under either class, and which voters speak together more than
their class explains: a voter's evidence is divided by one plus the sum of those correlations. A logistic classifier over selected hashed features is
trained on the posterior labels; it alone scores texts.

Counts and votes are Spark aggregations; the label model and the classifier are fitted on the driver from at
most TRAIN_ROWS labelled rows reduced to a few numbers each.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ship, written

TRAIN_ROWS = 30_000  # labelled rows to learn from: a sample by hash if there are more
LEXICON = 256  # lexicon voters
FEATURES = 4096  # features of the classifier
MIN_TOXIC = 8  # texts that a lexicon unit must be in
MIN_ODDS = 8.0  # and how much commoner it must be in toxic ones
ANNOTATION = (0.97, 0.005)  # share of toxic and of clean texts that an annotation calls toxic
MIN_FAR = 4.0  # deviations from chance that make a unit a feature
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("shouting", "marks", "no_lexicon")


def units(word: str) -> list[str]:
    """What a word tells: itself, and its beginnings, so that inflected forms are met."""
    out = ["=" + word]
    return out + [word[:n] for n in (4, 5, 6, 7) if len(word) >= n]


def _found(column, wanted: dict[str, int] | None):
    """Distinct units of each text as (row, unit) pairs; with `wanted` only those, as numbers."""
    texts = pc.fill_null(column, "") if column.null_count else column
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = split.flatten().dictionary_encode()
    of_word = [[u for w in _WORD.findall(x) for u in units(w) if wanted is None or u in wanted]
               for x in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
    row = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    word = coded.indices.to_numpy()
    if wanted is None:
        names = sorted({u for us in of_word for u in us})
        number = {u: i for i, u in enumerate(names)}
    else:
        names, number = None, wanted
    size = np.fromiter(map(len, of_word), dtype=np.int64, count=len(of_word))
    flat = np.fromiter((number[u] for us in of_word for u in us), dtype=np.int64, count=int(size.sum()))
    hit = np.flatnonzero(size[word] > 0) if len(size) else np.empty(0, dtype=np.int64)
    row, word = row[hit], word[hit]
    n = size[word] if len(size) else np.empty(0, dtype=np.int64)
    ends = np.cumsum(n)
    start = np.cumsum(size) - size
    unit = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[word] - (ends - n), n)]
    pairs = np.unique(np.repeat(row, n) * max(1, len(number)) + unit)
    return pairs // max(1, len(number)), pairs % max(1, len(number)), names


def _unit_counts(batches):
    """Batches (label, text) to (unit, toxic, clean) counts of texts."""
    for b in batches:
        label = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        row, unit, names = _found(b.column(1), None)
        if names:
            toxic = np.bincount(unit, weights=label[row], minlength=len(names)).astype(np.int64)
            total = np.bincount(unit, minlength=len(names))
            yield pa.RecordBatch.from_pydict({"unit": names, "toxic": toxic, "clean": total - toxic})


def _pattern_votes(column) -> np.ndarray:
    """Votes of the pattern voters that look at the form: 1, -1 or 0 per text."""
    texts = pc.fill_null(column, "")
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    upper = chars - pc.utf8_length(pc.replace_substring_regex(texts, r"\p{Lu}", "")).to_numpy(zero_copy_only=False)
    marks = pc.count_substring_regex(texts, r"[!?]{2,}").to_numpy(zero_copy_only=False)
    shouting = np.where(upper * 10 > chars * 3, 1, np.where(upper * 10 < chars, -1, 0))
    return np.stack((shouting, np.where(marks * 50 > chars, 1, np.where(marks == 0, -1, 0))), axis=1)


def _together(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Largest correlation of each pair of voters within a class: what the class does not explain."""
    out = np.zeros((votes.shape[1],) * 2)
    for y in (post, 1 - post):
        mass = max(y.sum(), 1e-9)
        centred = votes - (y @ votes) / mass
        cov = (centred * y[:, None]).T @ centred / mass
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        out = np.maximum(out, cov / np.outer(spread, spread))
    np.fill_diagonal(out, 0)
    return np.where(out > 0.2, out, 0)


def label_model(votes: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of the toxic class per line of votes (1, -1, 0), and the weight of each voter's evidence.

    The last voter is the annotation. Its reliability is given and anchors the classes; those of the others are
    estimated. Voters are weighed down by how much they go together within the classes, first by the annotation, then
    by the posterior.
    """
    n = len(votes)
    right, wrong = ANNOTATION
    anchor = np.where(votes[:, -1] > 0, np.log(right / wrong), np.log((1 - right) / (1 - wrong)))
    votes = votes[:, :-1]
    states = [(votes == s).astype(float) for s in (-1, 0, 1)]
    post = 1 / (1 + np.exp(-anchor))
    for _ in range(2):
        weight = 1 / (1 + _together(votes, post).sum(axis=1))
        for _ in range(rounds):
            prior = np.clip(post.mean(), 1e-4, 1 - 1e-4)
            odds = anchor + np.full(n, np.log(prior / (1 - prior)))
            total = [sum(((s.T @ y) + 0.5) for s in states) for y in (post, 1 - post)]
            for s in states:
                ratio = np.log(((s.T @ post) + 0.5) / total[0]) - np.log(((s.T @ (1 - post)) + 0.5) / total[1])
                odds += s @ (ratio * weight)
            post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, weight


def logistic(rows: np.ndarray, cols: np.ndarray, target: np.ndarray, size: int, rounds: int = 400,
             ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic model on presence features, by full-batch adaptive gradient steps. Lines of
    the rarer class count as much in sum as a quarter of the others."""
    n = max(1, len(target))
    share = np.clip(target.mean() if len(target) else 0.5, 1e-3, 0.5)
    line = 1 + (max(1.0, 0.25 * (1 - share) / share) - 1) * target
    w, first, second = (np.zeros(size + 1) for _ in range(3))
    w[-1] = -2.0
    for t in range(1, rounds + 1):
        z = w[-1] + np.bincount(rows, weights=w[cols], minlength=n)[:n]
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[:n]) * line / n if len(target) else np.zeros(n)
        grad = np.append(np.bincount(cols, weights=miss[rows], minlength=size) + ridge * w[:-1] * 0.1, miss.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        step = 0.1 if t < rounds // 2 else 0.02
        w -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _votes(lexicon: list[str], features: list[str]):
    number = {u: i for i, u in enumerate(features)}
    voter = np.full(len(features) + 1, -1)
    for j, u in enumerate(lexicon):
        voter[number[u]] = j

    def run(batches):
        for b in batches:
            row, unit, _ = _found(b.column(0), number)
            form = _pattern_votes(b.column(0))
            n = b.num_rows
            edges = np.searchsorted(row, np.arange(n + 1))
            present = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(unit))
            yield pa.RecordBatch.from_arrays([present, pa.array(form[:, 0].astype(np.int64)), pa.array(form[:, 1].astype(np.int64)), b.column(1)],
                                             names=["units", "shouting", "marks", "label"])

    return run, voter


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> tuple[list[str], np.ndarray, float]:
    """Features, weights and constant of the classifier, from the labelled documents among `docs`. Rows without a
    label or an id are not used; no labelled rows, or only one label, give a model that finds nothing toxic."""
    bound_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        id_col, F.col(label_col).cast("long").alias("__llm_label")).dropDuplicates([id_col])
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1_000_000 * TRAIN_ROWS / n))
    sample = docs.select(id_col, F.col(text_col).alias("text")).join(known, id_col).select(F.col("__llm_label").alias("label"), "text")
    sample = written(sample.dropDuplicates(["text"]), "labelled-texts")
    total, toxic = sample.agg(F.count("label"), F.sum("label")).first()
    toxic = toxic or 0
    if not toxic or toxic == total:
        return [], np.zeros(0), -4.0
    counted = sample.mapInArrow(_unit_counts, "unit string, toxic long, clean long").groupBy("unit").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # How much commoner in toxic texts, and the deviation of that from chance.
    odds = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (total - toxic + 1))
    seen = F.col("toxic") + F.col("clean")
    far = F.abs(F.col("toxic") - seen * toxic / total) / F.sqrt(seen * (toxic / total) * (1 - toxic / total) + 1)
    # Two bounded lists: the most telling units come to the driver.
    rated = written(counted.filter(seen >= MIN_TOXIC).select("unit", "toxic", odds.alias("odds"), far.alias("far")), "units")
    best = rated.filter(F.col("far") >= MIN_FAR).orderBy(F.desc("far"), "unit").limit(FEATURES).collect()
    features = sorted(r["unit"] for r in best)
    voters = [r["unit"] for r in best if r["odds"] >= MIN_ODDS and r["toxic"] >= MIN_TOXIC][:LEXICON]
    run, voter = _votes(voters, features)
    votes = sample.select("text", "label").mapInArrow(run, "units array<long>, shouting long, marks long, label long").toPandas()
    size = votes["units"].map(len).to_numpy()
    rows = np.repeat(np.arange(len(votes)), size)
    cols = np.concatenate([*votes["units"], np.empty(0)]).astype(np.int64)
    table = np.zeros((len(votes), len(voters) + len(PATTERNS) + 1))
    spoken = voter[cols] >= 0
    table[rows[spoken], voter[cols[spoken]]] = 1
    table[:, -4], table[:, -3] = votes["shouting"], votes["marks"]
    table[:, -2] = np.where((table[:, : len(voters)] > 0).any(axis=1), 0, -1)
    table[:, -1] = 2 * votes["label"] - 1
    post, _ = label_model(table)
    weights, constant = logistic(rows, cols, post, len(features))
    return features, weights, constant


def _scores(features: list[str], weights, constant: float):
    def run(batches):
        number = {u: i for i, u in enumerate(features)}
        for b in batches:
            row, unit, _ = _found(b.column(b.num_columns - 1), number)
            z = constant + np.bincount(row, weights=weights.value[unit] if len(unit) else None, minlength=b.num_rows)[: b.num_rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    return run


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float], id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """(id column, score) per row, from the text alone; 0 to 1, higher is likelier toxic.

    NULL and empty texts get the score of a text without any feature. Equal texts get equal scores; an empty table
    gives no rows.
    """
    features, weights, constant = model
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # at most FEATURES numbers
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scores(features, sent, constant), f"id {id_type}, score double").withColumnRenamed("id", id_col)


ship(__name__)
