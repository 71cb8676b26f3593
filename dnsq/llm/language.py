"""Languages of a text as a mixture, estimated by expectation-maximisation from n-gram likelihoods.

Training counts the letter trigrams (word borders included) of all labelled texts per language, in 65,536
hashed cells: a Spark aggregation whose result, 256 KB per language, is the model. A text's words are its units: the
likelihood of a word in a language is the product of its trigrams' probabilities. Expectation-maximisation gives
the share of each language in the text. Languages are then taken in the order of their shares, and the set is as
large as the penalised likelihood (half the logarithm of the number of words per further language) allows. The
prediction is the language with the largest share within the chosen set, the score that share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, ship

CELLS = 1 << 16
SMOOTHING = 0.5
UNKNOWN = "und"
SURE_SETS = 4  # sizes of a language set that are tried for every text; larger ones while they fit better
ROUNDS, SET_ROUNDS = 6, 4
CHARS = 1 << 20  # characters handled at a time; a longer text is handled alone
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Is the code point a letter?"""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of the trigram around each letter, places of the words' first letters among them, row of each word."""
    # Row ends are code point 0, which is no letter and is taken out of the texts.
    joined = "\0".join("" if t is None else t.replace("\0", " ") for t in texts).lower() + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    at = np.flatnonzero(_letters()[cp])
    c = np.zeros(len(cp) + 1, dtype=np.uint64)
    c[at] = cp[at]
    before, after = c[at - 1], c[at + 1]
    h = before * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    first = np.flatnonzero(before == 0)
    row = np.searchsorted(np.flatnonzero(cp == 0), at[first])
    return (h >> np.uint64(48)).astype(np.int64), first, row


def _slices(texts: list):
    """Rows of about CHARS characters at a time."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _counts(batches):
    """Batches (lang, text) to (lang, cell, n) of the whole partition."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        langs, texts = np.array(b.column(0).to_pylist(), dtype=object), b.column(1).to_pylist()
        for start, part in _slices(texts):
            cells, first, row = trigrams(part)
            own = langs[start : start + len(part)]
            of = np.repeat(row, np.diff(np.append(first, len(cells))))
            for lang in set(own):
                n = np.bincount(cells[(own == lang)[of]], minlength=CELLS)
                total[lang] = total.get(lang, 0) + n
    for lang, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.repeat(lang, len(some)), "cell": pa.array(some), "n": pa.array(n[some])})


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and the logarithms of their cells' probabilities, from all rows with a label and a text."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    counts = rows.mapInArrow(_counts, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counts.toPandas()  # at most CELLS rows per language
    langs = sorted(found["lang"].unique())
    table = np.zeros((len(langs), CELLS))
    table[np.searchsorted(langs, found["lang"]), found["cell"]] = found["n"]
    used = max(1, int((table.sum(axis=0) > 0).sum()))
    p = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * used)
    return langs, np.log(p).astype(np.float32)


def _mixture(like: np.ndarray, row: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares per row (rows x languages) and log-likelihood per row. `like` has a line per word, scaled to a largest
    value of 1; `row` ascends; languages that are not allowed keep share 0."""
    n = len(allowed)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    words = np.diff(np.append(first, len(row)))[:, None]
    for i in range(rounds + 1):
        part = like * share[row].astype(np.float32)
        total = part.sum(axis=1)
        np.maximum(total, np.float32(1e-30), out=total)
        if i < rounds:
            part /= total[:, None]
            share[row[first]] = np.add.reduceat(part, first, axis=0) / words
    fit = np.zeros(n)
    fit[row[first]] = np.add.reduceat(np.log(total, dtype=np.float64), first)
    return share, fit


def shares(texts: list, logs: np.ndarray) -> np.ndarray:
    """Share of each language in each text, 0 outside the chosen set; all 0 without letters."""
    n_langs = len(logs)
    out = np.zeros((len(texts), n_langs))
    if n_langs == 0:
        return out
    columns = np.ascontiguousarray(logs.T)
    for start, part in _slices(texts):
        cells, first, row = trigrams(part)
        if len(first) == 0:
            continue
        # Sums over the letters of each word, a bounded number of letters at a time.
        like = np.empty((len(first), n_langs), dtype=np.float32)
        step = max(1, (CHARS << 2) // n_langs)
        i = 0
        while i < len(first):
            j = max(i + 1, int(np.searchsorted(first, first[i] + step)))
            end = first[j] if j < len(first) else len(cells)
            like[i:j] = np.add.reduceat(columns[cells[first[i] : end]], first[i:j] - first[i], axis=0)
            i = j
        like -= like.max(axis=1, keepdims=True)
        np.exp(like, out=like)
        n = len(part)
        share, _ = _mixture(like, row, np.ones((n, n_langs)), ROUNDS)
        rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
        words = np.maximum(np.bincount(row, minlength=n), 1)
        best, best_fit = share, np.full(n, -np.inf)
        growing = np.ones(n, dtype=bool)
        for size in range(1, n_langs + 1):
            s, fit = _mixture(like, row, (rank < size).astype(float), SET_ROUNDS if size > 1 else 0)
            fit = fit - 0.5 * np.log(words) * size
            better = growing & (fit > best_fit)
            best = np.where(better[:, None], s, best)
            best_fit = np.where(better, fit, best_fit)
            if size >= SURE_SETS:  # from here on a text's set grows only while that pays
                growing &= better
                if not growing.any():
                    break
        best[np.bincount(row, minlength=n) == 0] = 0
        out[start : start + n] = best
    return out


def _predictions(langs: list[str], logs):
    def run(batches):
        for b in batches:
            share = shares(b.column(b.num_columns - 1).to_pylist(), logs.value)
            top = share.argmax(axis=1) if langs else np.zeros(len(share), dtype=int)
            score = share.max(axis=1) if langs else np.zeros(len(share))
            names = [langs[i] if s > 0 else UNKNOWN for i, s in zip(top, score)]
            mixed = [{langs[j]: float(r[j]) for j in np.flatnonzero(r)} for r in share]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(np.minimum(score, 1.0)),
                 pa.array([list(m.items()) for m in mixed], pa.map_(pa.string(), pa.float64()))],
                names=["id", "lang_pred", "score", "shares"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id column, lang_pred, score, shares) per row, from the text alone.

    lang_pred is `und` with score 0 for NULL, empty and letterless texts, and for all texts if the model knows no
    language. Of languages with equal shares the first by name is taken. Repeated rows get equal results; an empty
    table gives no rows.
    """
    langs, logs = model
    spark = docs.sparkSession
    bound_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    table = spark.sparkContext.broadcast(logs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        _predictions(langs, table), f"id {id_type}, lang_pred string, score double, shares map<string,double>"
    ).withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text",
               min_score: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language (is not `und`), with at least this share if one is named.

    NULL, empty and letterless texts go; repeated rows go or stay together; an empty table stays empty.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    langs, logs = model
    table = spark.sparkContext.broadcast(logs)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            share = shares(texts, table.value)
            top = share.max(axis=1) if langs else np.zeros(len(texts))
            yield b.filter(pa.array((top > 0) & (top >= min_score)))

    return docs.mapInArrow(run, docs.schema)


ship(__name__)
