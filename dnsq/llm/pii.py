"""Personal data and secrets: spans of fixed patterns, and spans that weakly supervised labelers agree on.

Method. Four patterns give the base spans; they always stay. Other runs of letters and digits are candidates for a
further kind, `secret` (keys, tokens, passwords). Labelers by pattern, by gazetteer and by context vote on each
candidate: 1 sensitive, -1 ordinary, 0 no opinion. Votes and features of all candidates of the corpus are counted by
their combination, so expectation-maximisation, which estimates how reliable each labeler is, and the final
logistic classifier over the candidates' features, which is trained on the posterior labels, both work on a
table with one line per combination (at most 3^8 * 2^7 of them, some dozens in practice) on the driver. The classifier
becomes a Spark expression that judges every candidate.

Everything that touches a text is a built-in expression. Positions are found by matching, from the end of the
last match on, the gap before the next match and the match itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, written

KINDS = ("email", "ip", "card", "phone")
EXTRA = "secret"
MIN_CANDIDATE = 6

# Fixed patterns of the base kinds. Repeated groups are possessive (`++`): no shorter repetition could match
# where the longest fails, and Java then neither recurses nor backtracks on very long runs.
_EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_CANDIDATE = r"[A-Za-z0-9_-]*[0-9][A-Za-z0-9_-]*"


def _from_last(pattern: str, run: str | None) -> str:
    """Gap and match from the end of the last match on. A match starts there or, where `run` names the
    characters that its first run is made of, at the start of such a run: if it fails there, it fails further on in
    the run, which need not be tried."""
    gap = r"[\s\S]*?" if run is None else rf"|[\s\S]*?[^{run}]"
    return rf"\G({gap})({pattern})"


_SEARCH = {
    "email": ("@", _from_last(_EMAIL, "A-Za-z0-9._%+-")),
    "ip": (r"[0-9]\.[0-9]", _from_last(_IP, "0-9")),
    "card": (r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", _from_last(_CARD, "0-9")),
    "phone": (r"\+[0-9]", _from_last(_PHONE, None)),
    EXTRA: ("[0-9]", _from_last(_CANDIDATE, "A-Za-z0-9_-")),
}


def _matches(text, kind: str) -> F.Column:
    """All matches: structs (gap, match). Texts without a trace of the kind are not searched."""
    trace, search = _SEARCH[kind]
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(search), F.lit(1)).alias("gap"),
                         F.regexp_extract_all(text, F.lit(search), F.lit(2)).alias("match"))
    none = F.array().cast("array<struct<gap:string,match:string>>")
    return F.when(F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(trace)), found).otherwise(none)


def _placed(matches) -> F.Column:
    """Structs (start, end, match, before): code points from the start of the text, end exclusive, and the 24
    characters before the match (or from the last match on)."""
    empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")

    def step(acc, m):
        start = acc["at"] + F.length(m["gap"])
        end = start + F.length(m["match"])
        one = F.struct(start.alias("start"), end.alias("end"), m["match"].alias("match"),
                       F.right(m["gap"], F.lit(24)).alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans"))

    return F.aggregate(matches, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def _digits(text) -> F.Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits) -> F.Column:
    """Doubled every second digit from the right, the sum of digits is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 1, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int"))
    ).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, match) -> F.Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & _luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


# Gazetteers of words beside a secret, of prefixes of issued keys, and of parts of ordinary names.
CONTEXT_WORDS = ("password", "passwd", "pwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "access key",
                 "auth", "bearer", "credential", "private key")
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "xoxb", "xoxp", "sk_live", "sk_test", "AIza", "glpat")
ORDINARY_PARTS = ("mail", "page", "chapter", "version", "http", "www", "utf", "mp3", "sha256", "covid")


def _votes(match, before) -> dict[str, F.Column]:
    """Opinion of each labeler: 1, -1 or 0."""
    low, size = F.lower(match), F.length(match)
    near = F.lower(before)
    n_digits = F.length(_digits(match))
    letters = size - n_digits

    def says(yes=None, no=None) -> F.Column:
        out = F.lit(0)
        if no is not None:
            out = F.when(no, F.lit(-1)).otherwise(out)
        return F.when(yes, F.lit(1)).otherwise(out) if yes is not None else out

    return {
        "issued_key": says(F.rlike(match, F.lit("^(?:" + "|".join(KEY_PREFIXES) + ")[A-Za-z0-9_-]{12,}$"))),
        "named_before": says(F.rlike(near, F.lit("(?:" + "|".join(CONTEXT_WORDS) + r")[\"' ]*[=:]?[\"' ]*$"))),
        "assigned": says(F.rlike(near, F.lit(r"[a-z_]+ ?[=:] ?[\"']?$")), F.rlike(near, F.lit(r"[.,!?] ?$"))),
        "hexadecimal": says(F.rlike(match, F.lit("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{12,}$"))),
        "mixed": says((size >= 12) & (n_digits >= 3) & (letters >= 3), (letters == 0) | (n_digits == 0)),
        "short": says(None, size < 8),
        "plain_number": says(None, F.rlike(match, F.lit("^[0-9_-]+$"))),
        "ordinary": says(None, F.rlike(low, F.lit("|".join(ORDINARY_PARTS))) | F.rlike(match, F.lit("^[A-Za-z]+-?[0-9]{1,4}$"))),
    }


def _features(match, before) -> dict[str, F.Column]:
    """What the final classifier sees, as 0 or 1."""
    size, n_digits = F.length(match), F.length(_digits(match))
    near = F.lower(before)
    flags = {
        "long": size >= 12, "very_long": size >= 18, "letters_and_digits": (n_digits >= 2) & (size - n_digits >= 2),
        "many_turns": F.size(F.regexp_extract_all(match, F.lit("[0-9]+[A-Za-z]+"), F.lit(0))) >= 2,
        "upper": F.rlike(match, F.lit("^[A-Z0-9_-]*[A-Z][A-Z0-9_-]*$")),
        "after_sign": F.rlike(near, F.lit(r"[=:] ?[\"']?$")),
        "after_word": F.rlike(near, F.lit("(?:" + "|".join(CONTEXT_WORDS) + ")[^a-z]*$")),
    }
    return {k: v.cast("int") for k, v in flags.items()}


VOTERS = ("issued_key", "named_before", "assigned", "hexadecimal", "mixed", "short", "plain_number", "ordinary")
FEATURES = ("long", "very_long", "letters_and_digits", "many_turns", "upper", "after_sign", "after_word")


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with `base` and `candidates` behind its columns: arrays of (kind, start, end) and of (start, end, match,
    before). Candidates do not touch base spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    placed = docs.withColumns({f"__llm_{k}": _placed(_matches(text, k)) for k in (*KINDS, EXTRA)})

    def base(kind: str) -> F.Column:
        valid = F.filter(F.col(f"__llm_{kind}"), lambda s: _valid(kind, s["match"]))
        return F.transform(valid, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    placed = placed.withColumn("base", F.concat(*[base(k) for k in KINDS]))
    free = F.filter(F.col(f"__llm_{EXTRA}"), lambda s: (F.length(s["match"]) >= MIN_CANDIDATE) & ~F.exists(
        "base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return placed.withColumn("candidates", free).drop(*[f"__llm_{k}" for k in (*KINDS, EXTRA)])


def reliabilities(table: list[tuple[tuple[int, ...], float]], rounds: int = 50) -> tuple[float, list, list[float]]:
    """Expectation-maximisation over (votes, count): the share of sensitive candidates, per voter and class the
    probabilities of its votes (-1, 0, 1), and the posterior of each line. It starts from the majority."""
    total = sum(c for _, c in table)
    post = [0.9 if sum(v) > 0 else 0.1 for v, _ in table]
    prior, like = 0.5, []
    for _ in range(rounds if total else 0):
        share = sum(p * c for p, (_, c) in zip(post, table))
        prior = (share + 1) / (total + 2)
        like = []
        for j in range(len(table[0][0])):
            rows = []
            for y in (0, 1):
                n = [0.5, 0.5, 0.5]
                for p, (v, c) in zip(post, table):
                    n[v[j] + 1] += c * (p if y else 1 - p)
                rows.append([x / sum(n) for x in n])
            like.append(rows)
        post = []
        for v, _ in table:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(like[j][1][x + 1] / like[j][0][x + 1]) for j, x in enumerate(v))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return prior, like, post


def classifier(table: list[tuple[tuple[int, ...], float, float]], rounds: int = 400, rate: float = 1.0,
               ridge: float = 1e-3) -> list[float]:
    """Weights (the constant first) of a logistic model over (features, posterior, count)."""
    size = len(FEATURES) + 1
    w, total = [0.0] * size, sum(c for *_, c in table) or 1.0
    for _ in range(rounds):
        grad = [ridge * x for x in w]
        for f, p, c in table:
            x = (1, *f)
            miss = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - p
            for i, value in enumerate(x):
                grad[i] += c / total * miss * value
        w = [a - rate * g for a, g in zip(w, grad)]
    return w


def train(found: DataFrame) -> list[float]:
    """Weights of the span classifier, from all candidates of `spans`."""
    one = found.select(F.explode("candidates").alias("c"))
    votes, features = _votes(F.col("c.match"), F.col("c.before")), _features(F.col("c.match"), F.col("c.before"))
    counted = one.select(*[v.alias(k) for k, v in votes.items()], *[v.alias("f_" + k) for k, v in features.items()])
    rows = counted.groupBy(*counted.columns).count().orderBy(*counted.columns).collect()  # bounded, see above
    voted = [(tuple(r[k] for k in VOTERS), float(r["count"])) for r in rows]
    if not voted:
        return [-1.0] + [0.0] * len(FEATURES)
    _, _, post = reliabilities(voted)
    # A secret must be both long and mixed or named; a class that all candidates fall in has nothing to teach.
    return classifier([(tuple(r["f_" + k] for k in FEATURES), p, float(r["count"])) for r, p in zip(rows, post)])


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with two arrays behind its columns (replacing columns of those names): `base` and `spans`, structs
    (kind, start, end) in code points, end exclusive, ordered by kind (email, ip, card, phone, secret), then start.

    `spans` holds all base spans and the candidates that the classifier accepts. NULL and empty texts have
    none; equal texts have equal spans; without candidates nothing is added; an empty table stays empty.
    """
    own = docs.drop("base", "spans", "candidates")
    found = spans(own, text_col)
    weights = train(written(found.select("candidates").filter(F.size("candidates") > 0), "candidates"))

    def sensitive(c) -> F.Column:
        score = F.lit(weights[0])
        for w, f in zip(weights[1:], _features(c["match"], c["before"]).values()):
            score = score + F.lit(w) * f
        return score > 0

    extra = F.transform(F.filter("candidates", sensitive), lambda c: F.struct(
        F.lit(EXTRA).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return found.withColumn("spans", F.concat("base", extra)).drop("candidates")


def listed(spans_col: str) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


ship(__name__)
