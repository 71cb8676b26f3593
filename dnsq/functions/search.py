"""The names of a list most similar to given names, found by upper bounds with early stop.

Every name of a list gets cheap bounds first: shared characters (each character with its number of occurrences,
one matrix product) and shared 3-grams (an inverted index of grams to the names that hold them). From
these follow an upper bound of the similarity ratio, and of the linear score: edits are at least as many as characters
missing, and a third of the grams missing. Names are then compared exactly in the order of their bounds, a few at a time, until
no bound reaches the worst of the best found. Where a score to reach is known beforehand, all names whose bound reaches it
are compared at once. Comparisons take a letter of all pairs at a time, with the letters of a query in the bits of a word.

Spark does the partitioning (`operators.matching`); these are array operations on one block of names and one slice of a list.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle

from .similarity import _PAIRS, _lengths, _codes, jaro_batch, lcs_batch

STEP = 8  # names compared exactly per query and round, if no more are asked for
FEW = 4 * STEP  # names per query up to which all whose bound reaches the score are compared at once
WORD = 64  # longest query whose letters fit the bits of a word
_EPS = 1e-9  # bounds and scores are sums in different orders
_SLACK = 1e-3  # the same for bounds in single precision


def levenshtein_batch(a, b) -> np.ndarray:
    """Edit distance, one table row of all pairs at a time."""
    la, lb = _lengths(a), _lengths(b)
    wa, wb = max(int(la.max()), 1), max(int(lb.max()), 1)
    x, y = _codes(a, wa), _codes(b, wb)
    at = np.arange(wb + 1)
    row = np.repeat(at[None], len(a), axis=0)
    for i in range(wa):
        best = np.empty_like(row)
        best[:, 0] = i + 1
        best[:, 1:] = np.minimum(row[:, 1:] + 1, row[:, :-1] + (y != x[:, i : i + 1]))
        best = np.minimum.accumulate(best - at, axis=1) + at
        row = np.where((i < la)[:, None], best, row)
    return row[np.arange(len(a)), lb]


def _common_bits(masks, q, letters, _la, _lb, left) -> np.ndarray:
    """Longest common subsequences: a bit of the word is cleared where the length grows. Of step i, only the first left[i] pairs
    have a letter."""
    word = np.full(len(q), ~np.uint64(0))
    for i, n in enumerate(left):
        if n == 0:
            break
        v = word[:n]
        u = v & masks[q[:n], letters[:n, i]]
        word[:n] = (v + u) | (v - u)
    return np.bitwise_count(~word).astype(np.float64)


def _edit_bits(masks, q, letters, la, lb, left) -> np.ndarray:
    """Edit distances: the steps up and down of a column of the table are the bits of two words."""
    one = np.uint64(1)
    last = np.maximum(la - 1, 0).astype(np.uint64)
    up, down = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), dtype=np.uint64)
    far = la.astype(np.int64)
    for i, n in enumerate(left):
        if n == 0:
            break
        p, m, at = up[:n], down[:n], last[:n]
        same = masks[q[:n], letters[:n, i]]
        vertical = same | m
        across = (((same & p) + p) ^ p) | same
        plus, minus = m | ~(across | p), p & across
        far[:n] += ((plus >> at) & one).astype(np.int64) - ((minus >> at) & one).astype(np.int64)
        plus, minus = (plus << one) | one, minus << one
        up[:n], down[:n] = minus | ~(vertical | plus), plus & vertical
    return np.where(la == 0, lb, far).astype(np.float64)


def _gram_sets(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 3-grams of each name as (name, gram) in order; three code points fit one number."""
    lengths = _lengths(names)
    width = max(3, int(lengths.max()) if len(lengths) else 0)
    x = _codes(names, width).astype(np.int64)
    grams = x[:, :-2] << 42 | x[:, 1:-1] << 21 | x[:, 2:]
    row, at = np.nonzero(np.arange(width - 2) < (lengths - 2)[:, None])
    pairs = np.stack((row, grams[row, at]), axis=1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    new = np.ones(len(pairs), dtype=bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return pairs[new, 0], pairs[new, 1]


class List:
    """A slice of a list, prepared for many queries. `compared` counts the pairs that were compared exactly."""

    def __init__(self, names: list[str]) -> None:
        self.names = names
        self.lengths = _lengths(names)
        self.compared = 0
        counts = self._counts(names, None)
        most = counts.max(axis=0, initial=0)
        self.unit_char = np.repeat(np.arange(len(most)), most)
        self.unit_level = np.arange(len(self.unit_char)) - np.repeat(np.cumsum(most) - most, most)
        self.units = self._units(counts)
        row, gram = _gram_sets(names)
        self.n_grams = np.bincount(row, minlength=len(names))
        order = np.argsort(gram, kind="stable")
        self.grams, first = np.unique(gram[order], return_index=True)
        self.holders = row[order]
        self.starts = np.append(first, len(order))
        # Names as numbers of their letters; the number after the last letter fills them up.
        self.width = max(int(self.lengths.max(initial=0)), 1)
        codes = _codes(names, self.width)
        self.numbers = np.searchsorted(self.letters, codes).astype(np.int32)
        self.numbers[np.arange(self.width) >= self.lengths[:, None]] = len(self.letters)

    def _counts(self, names: list[str], letters: np.ndarray | None) -> np.ndarray:
        """Occurrences of each letter of the list in each name."""
        flat = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if letters is None:
            self.letters = letters = np.unique(flat)
        row = np.repeat(np.arange(len(names)), _lengths(names))
        at = np.minimum(np.searchsorted(letters, flat), max(len(letters) - 1, 0))
        known = letters[at] == flat if len(letters) else np.zeros(len(flat), dtype=bool)
        return np.bincount(row[known] * len(letters) + at[known], minlength=len(names) * len(letters)).reshape(
            len(names), len(letters))

    def _units(self, counts: np.ndarray) -> np.ndarray:
        return (counts[:, self.unit_char] > self.unit_level).astype(np.float32)

    def shared_letters(self, queries: list[str]) -> np.ndarray:
        """Letters in common, with repetition, of every query and every name; whole numbers in single precision."""
        return self._units(self._counts(queries, self.letters)) @ self.units.T

    def _masks(self, queries: list[str]) -> np.ndarray:
        """Per query and letter of the list the places of the letter in the query, as bits; queries of at most WORD letters."""
        lengths = _lengths(queries)
        width = max(int(lengths.max(initial=0)), 1)
        codes = _codes(queries, width)
        at = np.minimum(np.searchsorted(self.letters, codes), max(len(self.letters) - 1, 0))
        known = (self.letters[at] == codes if len(self.letters) else np.zeros(codes.shape, dtype=bool)) & (np.arange(width) < lengths[:, None])
        masks = np.zeros((len(queries), len(self.letters) + 1), dtype=np.uint64)
        for i in range(width):
            rows = np.flatnonzero(known[:, i])
            masks[rows, at[rows, i]] |= np.uint64(1 << i)
        return masks

    def _by_bits(self, queries: list[str], q: np.ndarray, t: np.ndarray, bits: Callable, plain: Callable) -> np.ndarray:
        """`bits` over all pairs of short queries, in parts; `plain`, which takes texts, over the others."""
        out = np.empty(len(q), dtype=np.float64)
        lengths = _lengths(queries)
        short = lengths <= WORD
        masks = self._masks([x if s else "" for x, s in zip(queries, short)])
        # Longest names first, so that the pairs with a letter left are always the first ones.
        order = np.argsort(-self.lengths[t], kind="stable")
        for some, in_bits in ((order[short[q[order]]], True), (order[~short[q[order]]], False)):
            for i in range(0, len(some), _PAIRS):
                part = some[i : i + _PAIRS]
                if in_bits:
                    left = len(part) - np.searchsorted(self.lengths[t[part]][::-1], np.arange(self.width), side="right")
                    out[part] = bits(masks, q[part], self.numbers[t[part]], lengths[q[part]], self.lengths[t[part]], left)
                else:
                    out[part] = plain(*self._texts(queries, q[part], t[part]))
        return out

    def common(self, queries: list[str], q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Longest common subsequence of pairs of a query and a name, by number."""
        return self._by_bits(queries, q, t, _common_bits, lcs_batch)

    def edits(self, queries: list[str], q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Edit distance of pairs of a query and a name, by number."""
        return self._by_bits(queries, q, t, _edit_bits, levenshtein_batch)

    def shared_grams(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 3-grams in common, from the index, and the number of those of each query."""
        row, gram = _gram_sets(queries)
        own = np.bincount(row, minlength=len(queries))
        out = np.zeros((len(queries), len(self.names)), dtype=np.int32)
        at = np.searchsorted(self.grams, gram)
        known = np.flatnonzero(at < len(self.grams))
        known = known[self.grams[at[known]] == gram[known]]
        for q, lists in zip(*_by_row(row[known], at[known])):
            held = np.concatenate([self.holders[self.starts[g] : self.starts[g + 1]] for g in lists])
            out[q] = np.bincount(held, minlength=len(self.names))
        return out, own

    def best(self, upper: np.ndarray, exact: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], k: int,
             least: float | np.ndarray = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores (queries, k) of the names with the greatest exact scores; -1 where there are fewer names
        with a score of `least` (one number, or one per query) or more. Of equal scores (to 12 places) the earlier name
        comes first. `exact` gets queries, names and the score that each pair has to reach."""
        queries, n = upper.shape
        place, score = np.full((queries, k), -1), np.full((queries, k), -np.inf)
        least = np.broadcast_to(least, queries)
        worst = least - _EPS
        step = min(n, max(k, STEP))
        left = upper.copy()

        def still(rows: np.ndarray) -> np.ndarray:
            open_to = left[rows].max(axis=1, initial=-np.inf)
            return rows[(open_to > -np.inf) & (open_to >= worst[rows])]

        active = still(np.arange(queries))
        while len(active):
            top = np.argpartition(-left[active], step - 1, axis=1)[:, :step]
            bound = left[active[:, None], top]
            left[active[:, None], top] = -np.inf
            row, at = np.nonzero((bound >= worst[active][:, None]) & (bound > -np.inf))
            found = np.full(top.shape, -np.inf)
            for i in range(0, len(row), _PAIRS):
                r, c = row[i : i + _PAIRS], at[i : i + _PAIRS]
                found[r, c] = exact(active[r], top[r, c], worst[active[r]])
            self.compared += len(row)
            found[found < least[active][:, None] - _EPS] = -np.inf
            places = np.concatenate((place[active], np.where(found > -np.inf, top, -1)), axis=1)
            scores = np.concatenate((score[active], found), axis=1)
            order = np.lexsort((places, -np.round(scores, 12)), axis=1)[:, :k]
            place[active], score[active] = np.take_along_axis(places, order, 1), np.take_along_axis(scores, order, 1)
            worst[active] = np.maximum(least[active], score[active, -1]) - _EPS
            active = still(active)
        return place, score

    def most_alike(self, queries: list[str], k: int, least: float | np.ndarray = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The k names with the greatest similarity ratio."""
        least = np.broadcast_to(least, len(queries))
        la, lb, letters = _lengths(queries), self.lengths, self.shared_letters(queries)

        def exact(q: np.ndarray, t: np.ndarray, _) -> np.ndarray:
            both = la[q] + lb[t]
            return np.where(both == 0, 1.0, 2 * self.common(queries, q, t) / np.maximum(both, 1))

        if np.isfinite(least).all():
            reach = (least / 2).astype(np.float32)[:, None] * (la[:, None] + lb).astype(np.float32)
            q, t = np.nonzero(letters >= reach - np.float32(_SLACK))
            return self._kept(q, t, exact(q, t, least), k, least)
        both = la[:, None] + lb
        upper = np.where(both == 0, 1.0, 2.0 * letters / np.maximum(both, 1))
        return self.best(upper, exact, k, least)

    def best_linear(self, queries: list[str], least: float | np.ndarray = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The name other than the query with the greatest linear score (`operators.matching.linear_scorer`)."""
        least = np.broadcast_to(least, len(queries))
        la, lb = _lengths(queries), self.lengths
        letters = self.shared_letters(queries)
        shared, own = self.shared_grams(queries)

        def bounds(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Upper bounds of the score and of the Jaro similarity, and the Jaccard similarity."""
            longest, common, grams = np.maximum(la[q], lb[t]), letters[q, t].astype(np.float64), shared[q, t]
            union = own[q] + self.n_grams[t] - grams
            jaccard = np.where(union == 0, 0.0, grams / np.maximum(union, 1))
            edits = np.maximum(longest - common, -(-(np.maximum(own[q], self.n_grams[t]) - grams) // 3))
            jaro = np.where(common > 0, (common / np.maximum(la[q], 1) + common / np.maximum(lb[t], 1) + 1) / 3, 0.0)
            return 0.5 * jaro + 0.2 * jaccard + 0.3 * (1 - edits / np.maximum(longest, 1)), jaro, jaccard

        def exact(q: np.ndarray, t: np.ndarray, needed: np.ndarray) -> np.ndarray:
            _, jaro, jaccard = bounds(q, t)
            edits = self.edits(queries, q, t)
            known = 0.2 * jaccard + 0.3 * (1.0 - edits / np.maximum(np.maximum(la[q], lb[t]), 1))
            # The edit distance is known now; the dearer Jaro similarity is for those that can still get there.
            near = np.flatnonzero((edits > 0) & (0.5 * jaro + known >= needed))
            out = np.full(len(q), -np.inf)
            for i in range(0, len(near), _PAIRS):
                some = near[i : i + _PAIRS]
                out[some] = 0.5 * jaro_batch(*self._texts(queries, q[some], t[some])) + known[some]
            return out

        # Letters alone first, as if all 3-grams were in common.
        each = [np.float32(0.5 / 3) / np.maximum(n, 1).astype(np.float32) for n in (la, lb)]
        longest = np.maximum(np.maximum(la[:, None], lb), 1).astype(np.float32)
        loose = letters * (each[0][:, None] + each[1] + np.float32(0.3) / longest) + np.float32(0.2 + 0.5 / 3 + _SLACK)
        q, t = np.nonzero(loose >= least.astype(np.float32)[:, None])
        bound = bounds(q, t)[0]
        able = bound >= least[q] - _EPS
        q, t, bound = q[able], t[able], bound[able]
        if len(q) <= FEW * len(queries):
            return self._kept(q, t, exact(q, t, least[q] - _EPS), 1, least)
        upper = np.full(letters.shape, -np.inf)
        upper[q, t] = bound
        return self.best(upper, exact, 1, least)

    def _kept(self, q: np.ndarray, t: np.ndarray, found: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores as of `best` of pairs that were all compared."""
        self.compared += len(q)
        good = np.flatnonzero((found > -np.inf) & (found >= least[q] - _EPS))
        good = good[np.lexsort((t[good], -np.round(found[good], 12), q[good]))]
        counts = np.bincount(q[good], minlength=len(least))
        nth = np.arange(len(good)) - np.repeat(np.cumsum(counts) - counts, counts)
        good, nth = good[nth < k], nth[nth < k]
        place, score = np.full((len(least), k), -1), np.full((len(least), k), -np.inf)
        place[q[good], nth], score[q[good], nth] = t[good], found[good]
        return place, score

    def _texts(self, queries: list[str], q: np.ndarray, t: np.ndarray) -> tuple[list[str], list[str]]:
        return [self.names[i] for i in t], [queries[i] for i in q]


def _by_row(row: np.ndarray, values: np.ndarray) -> tuple[list[int], list[list[int]]]:
    edges = np.flatnonzero(np.diff(row)) + 1
    return row[np.append(0, edges)].tolist() if len(row) else [], [v.tolist() for v in np.split(values, edges)] if len(row) else []


cloudpickle.register_pickle_by_value(sys.modules[__name__])
