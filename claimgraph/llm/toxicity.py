"""Operator 12: toxicity by a learned lexicon, found in spite of misspellings, and weighed by its context.

The lexicon is learned from labelled texts: whole words and beginnings of words that tell toxic texts from clean ones, chosen one after the
other by what they add. Its trie is intersected with a Levenshtein automaton (with transpositions): the states of the
intersection are made when a token first needs them and kept, so a token costs a look-up per letter and each distinct token of a batch is matched
once. Terms of five letters and more may be off by one edit, of nine and more by two, never in their first letter; beginnings of words
from six letters on by one. Forms that clean texts use as well are learned and left alone.

Each place found is weighed by its term and distance, and by its window of words: quotation marks around it and the
words near it, by how much more often they stand by places in toxic texts than in clean ones (drawn to nothing where there are
few places). A logistic model over a text's best place, their sum, their number of terms and their rate gives the score.

Fitted on a bounded sample: at most ``sample`` labelled rows of either class, by a hash of their ids (100,000 rows at most in all). All
texts are scored whole, each where it is read.

Cases: null and empty texts and texts without words have the score of a text without a term; without toxic labels every score is 0;
labels of null or unknown ids count for nothing, several labels of one id count by the greatest; null labels are no labels; rows with equal
ids are scored apart; a null doc_id is not held out and trains nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage
from .words import text_bytes, word_hashes, word_spans

#: Labelled rows of either class that are fitted on, candidates of the lexicon, terms of it, cues, and words of a window to either side.
SAMPLE, CANDIDATES, TERMS, CUES, WINDOW = 50_000, 600, 200, 256, 6
PREFIXES = (4, 5, 6, 7, 8)
#: What is left of a text's worth for the choice of terms when one more term that it holds has been chosen.
LESS = 0.6
#: The most that a window can add to or take from a place (in natural logarithms of odds).
CONTEXT = 4.0
STEP = 400
_OPEN, _CLOSE = "\"'“”„«»‘’‚‹›`", "\"'“”„«»‘’‚‹›`"
_MARKS = re.compile(r"[\W_]+")


def held_out_by(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def plain(token: str) -> str:
    """Letters and digits of a token, in lower case: marks before, after and inside it don't hide a term."""
    return token.lower() if token.isalnum() else _MARKS.sub("", token).lower()


class Tokens:
    """The tokens of a batch of texts: distinct ones (as they stand, and plain) and which stands where."""

    def __init__(self, column: pa.Array):
        values, offsets = text_bytes(column)
        starts, ends, self.first = word_spans(values, offsets)
        hashes, index, self.which = np.unique(word_hashes(values, starts, ends, lower=False), return_index=True, return_inverse=True)
        data = values.tobytes()
        self.raw = [data[s:e].decode("utf-8", "replace") for s, e in zip(starts[index].tolist(), ends[index].tolist())]
        self.plain = [plain(t) for t in self.raw]
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, distinct token) without repetitions."""
        wide = max(1, len(self.raw))
        both = np.unique(self.row * wide + self.which)
        return both // wide, both % wide


def allowed(term: str) -> int:
    """Edits that a term of the lexicon may be off by; a beginning of words ends in ``*``."""
    if term.endswith("*"):
        return 1 if len(term) > 6 else 0
    return 2 if len(term) >= 9 else 1 if len(term) >= 5 else 0


class Automaton:
    """Trie of the lexicon intersected with the Levenshtein automaton, made deterministic state by state as tokens need it.

    A state is a set of (node, edits, letter still due of a transposition), and the terms whose beginning has been read.
    """

    MOST_STATES = 200_000

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, int] = {}
        self.begins: dict[int, int] = {}
        self.slack = [0]
        for t, term in enumerate(terms):
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.slack.append(0)
                node = self.children[node][c]
                self.slack[node] = max(self.slack[node], allowed(term))
            (self.begins if term.endswith("*") else self.whole)[node] = t
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.next: list[dict[str, int]] = []
        self.result: list[tuple[int, int] | None] = []
        self.sets: list[frozenset] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        read = [at for n, e, due in items if n > 0 and not due for at in self._missing(n, e)]
        found = {(-1 - self.begins[n], e, "") for n, e in read if n in self.begins and e <= allowed(self.terms[self.begins[n]])}
        key = frozenset(items | found)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.result.append(self._best(key))
        return self.ids[key]

    def _missing(self, node: int, edits: int) -> Iterator[tuple[int, int]]:
        """(node, edits) after letters of the term that the token leaves out."""
        yield node, edits
        if node and edits < self.slack[node]:
            for child in self.children[node].values():
                yield from self._missing(child, edits + 1)

    def _best(self, items: frozenset) -> tuple[int, int] | None:
        """The term and edits of a token that ends here: fewest edits, whole words before beginnings."""
        ends = [(e, 1, -1 - n) for n, e, _ in items if n < 0]
        for n, e, due in items:
            if n > 0 and not due:
                ends += [(edits, 0, self.whole[node]) for node, edits in self._missing(n, e) if node in self.whole and edits <= allowed(self.terms[self.whole[node]])]
        return min(ends)[::2][::-1] if ends else None

    def _step(self, items: frozenset, c: str) -> set:
        out = set()
        for n, e, due in items:
            if n < 0:
                out.add((n, e, due))
                continue
            if due:
                if c == due:
                    out.add((n, e, ""))
                continue
            if c in self.children[n]:
                out.add((self.children[n][c], e, ""))
            if not n:
                continue  # the first letter is right
            if e < self.slack[n]:
                out.add((n, e + 1, ""))  # a letter too many
            for d, child in self.children[n].items():
                if e < self.slack[child]:
                    if d != c:
                        out.add((child, e + 1, ""))  # another letter
                        if c in self.children[child]:
                            out.add((self.children[child][c], e + 1, d))  # both letters in the other order
                    for node, edits in self._missing(child, e + 1):  # letters left out before this one
                        if c in self.children[node]:
                            out.add((self.children[node][c], edits, ""))
        return {(n, e, due) for n, e, due in out if n < 0 or e <= self.slack[n]}

    def match(self, token: str) -> tuple[int, int] | None:
        """(term, edits) of a plain token, or nothing."""
        if len(self.sets) > self.MOST_STATES:
            self._restart()  # bounded memory; the same states come again
        at = self.start
        for c in token:
            to = self.next[at].get(c)
            if to is None:
                to = self.next[at][c] = self._state(self._step(self.sets[at], c))
            at = to
            if not self.sets[at]:
                return None
        return self.result[at]


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows of either class outside the held-out ones, staged. The ids (2 * sample at most) are sent."""
    per = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id_")).agg(F.max("toxic").cast("int").alias("toxic"))
    per = per.where(~held_out_by(F.col("id_")))
    some = [per.where(c).orderBy(F.xxhash64("id_"), "id_").limit(sample) for c in ("toxic = 1", "toxic = 0")]
    ids = staged(some[0].union(some[1]), "toxic-ids")
    rows = docs.select(F.col("doc_id").cast("long").alias("id_"), "text").join(F.broadcast(ids), "id_")
    out = staged(rows.select("id_", "text", "toxic"), "toxic-labelled")
    unstage(ids)
    return out


def _forms(token: str) -> list[str]:
    """The word, and its beginnings, as candidates of the lexicon."""
    return [token, *(token[:k] + "*" for k in PREFIXES if len(token) > k)] if len(token) > 3 else [token] if token else []


def _doc_forms(tokens: Tokens, number: dict[str, int], grow: bool) -> tuple[np.ndarray, np.ndarray]:
    """(text, number of a candidate) without repetitions; ``grow`` numbers new candidates."""
    lists = []
    for t in tokens.plain:
        forms = _forms(t)
        lists.append([number.setdefault(f, len(number)) for f in forms] if grow else [number[f] for f in forms if f in number])
    row, which = tokens.pairs()
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.array([x for one in lists for x in one], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    n = sizes[which]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    forms = flat[np.repeat(at[which], n) + within]
    wide = max(1, len(number))
    both = np.unique(np.repeat(row, n) * wide + forms)
    return both // wide, both % wide


def count_forms(train: DataFrame) -> DataFrame:
    """(form, pos, neg): labelled texts of either class that hold a word or a beginning of words, summed in each task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            number: dict[str, int] = {}
            pairs = []
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                row, form = _doc_forms(Tokens(batch.column(0)), number, True)
                pairs.append((form, np.array(batch.column(1).to_pylist())[row] if len(row) else row))
            form, toxic = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            pos, neg = (np.bincount(form[toxic == k], minlength=len(number)).astype(np.int64) for k in (1, 0))
            names = list(number)
            for low in range(0, len(names), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(names[low : low + 20_000], pa.string()), pa.array(pos[low : low + 20_000]), pa.array(neg[low : low + 20_000])], ["form", "pos", "neg"])

    counted = train.select("text", "toxic").mapInArrow(count, "form string, pos long, neg long")
    return counted.groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def candidate_forms(forms: DataFrame, n_pos: int, n_neg: int, most: int = CANDIDATES) -> list[str]:
    """The forms that tell the classes apart best, by their log-likelihood ratio: a top-k. Of a beginning and the next longer one in the
    same texts the longer one stays, and the whole word rather than its beginnings."""
    p, n = F.col("pos"), F.col("neg")
    share = (p + n) / F.lit(float(n_pos + n_neg))
    part = lambda k, total: F.when(k > 0, k * F.log(k / (share * total))).otherwise(0.0)
    ratio = part(p, n_pos) + part(n, n_neg)
    good = forms.where((p >= 3) & (p * n_neg > 4 * n * n_pos))
    top = good.select("form", "pos", "neg", ratio.alias("ratio")).orderBy(F.desc("ratio"), "form").limit(8 * most).collect()
    by = {r.form: (r.pos, r.neg) for r in top}
    covered = set()
    for form, counts in by.items():
        stem = form.rstrip("*")
        for k in range(1, len(stem) + (not form.endswith("*"))):
            if by.get(stem[:k] + "*") == counts:
                covered.add(stem[:k] + "*")
    return [r.form for r in top if r.form not in covered][:most]


def choose_terms(rows: np.ndarray, forms: np.ndarray, toxic: np.ndarray, n_forms: int, most: int = TERMS) -> list[int]:
    """Forms chosen greedily: each time the one with the most toxic texts, less the clean ones (scaled to the classes' sizes); a text
    counts for less with each form chosen that it holds. ``rows``, ``forms``: which text holds which form."""
    n_pos, n_neg = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    cost = min(1.0, n_pos / n_neg) * 4
    worth = np.where(toxic == 1, 1.0, -cost)
    chosen: list[int] = []
    least = max(1.5, 0.002 * n_pos)
    while len(chosen) < most:
        gain = np.bincount(forms, worth[rows], n_forms)
        gain[chosen] = 0
        best = int(gain.argmax()) if n_forms else 0
        if not n_forms or gain[best] < least:
            return chosen
        chosen.append(best)
        worth[rows[forms == best]] *= LESS
    return chosen


def learned_terms(train: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """The lexicon."""
    counted = staged(count_forms(train), "toxic-forms")
    names = candidate_forms(counted, n_pos, n_neg)
    unstage(counted)
    number = {f: k for k, f in enumerate(names)}

    def incidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                row, form = _doc_forms(Tokens(batch.column(0)), dict(number), False)
                cuts = np.searchsorted(row, np.arange(1, batch.num_rows))
                held = [x.astype(np.int16).tobytes() for x in np.split(form, cuts)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(held, pa.binary())], ["toxic", "forms"])

    found = train.select("text", "toxic").mapInArrow(incidence, "toxic int, forms binary").collect()  # a row per text of the sample
    sets = [np.frombuffer(r.forms, np.int16).astype(np.int64) for r in found]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    chosen = choose_terms(rows, np.concatenate([np.zeros(0, np.int64), *sets]), np.array([r.toxic for r in found], np.int64), len(names))
    return [names[k] for k in chosen]


class Lexicon:
    """Terms with what has been learned of them: weights by distance, forms to leave alone, and cues of the context."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.innocent: set[str] = set()
        self.weights: dict[tuple[int, int], float] = {}
        self.cues: dict[str, float] = {}
        self.automaton: Automaton | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}  # its states are made where they are needed

    def places(self, tokens: Tokens) -> tuple[np.ndarray, list[tuple[int, int] | None]]:
        """Places of all tokens that match a term, and the match of each distinct token."""
        if self.automaton is None:
            self.automaton = Automaton(self.terms)
        match = self.automaton.match
        found = [match(t) if t else None for t in tokens.plain]
        found = [None if m and m[1] and tokens.plain[k] in self.innocent else m for k, m in enumerate(found)]
        hit = np.array([m is not None for m in found], bool)
        return (np.flatnonzero(hit[tokens.which]) if len(hit) else np.zeros(0, np.int64)), found


def context(tokens: Tokens, at: int, window: int = WINDOW) -> set[str]:
    """Cues by a place: the plain words of its window, and ``"`` where quotation marks are open before or on it and close on or after it."""
    row = tokens.row[at]
    low, high = max(tokens.first[row], at - window), min(tokens.first[row + 1], at + window + 1)
    near = tokens.which[low:high].tolist()
    here = at - low
    cues = {tokens.plain[t] for k, t in enumerate(near) if k != here and tokens.plain[t]}
    opened = any(tokens.raw[t][0] in _OPEN for t in near[: here + 1])
    closed = any(tokens.raw[t].rstrip(".,;:!?)")[-1:] in _CLOSE and tokens.raw[t].rstrip(".,;:!?)")[-1:] for t in near[here:])
    return cues | {'"'} if opened and closed else cues


def count_places(train: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(kind, term, edits, form, pos, neg): of forms (kind f) the labelled texts that hold them, of cues (kind c) the places by which they stand."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                toxic = batch.column(1).to_pylist()
                tokens = Tokens(batch.column(0))
                at, found = lexicon.places(tokens)
                seen = set()
                for k in at.tolist():
                    t, row = int(tokens.which[k]), int(tokens.row[k])
                    into = both[toxic[row]]
                    if (row, t) not in seen:
                        seen.add((row, t))
                        into["f", *found[t], tokens.plain[t]] += 1
                    for cue in context(tokens, k):
                        into["c", found[t][0], 0, cue] += 1
                    into["n", found[t][0], 0, ""] += 1
            if len(both[0]) + len(both[1]) > 300_000:
                yield _counted(both)
                both = (Counter(), Counter())
        yield _counted(both)

    counted = train.select("text", "toxic").mapInArrow(count, "kind string, term int, edits int, form string, pos long, neg long")
    return counted.groupBy("kind", "term", "edits", "form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _counted(both: tuple[Counter, Counter]) -> pa.RecordBatch:
    keys = list(both[0] | both[1])
    kind, term, edits, form = zip(*keys) if keys else ((),) * 4
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), pa.array(term, pa.int32()), pa.array(edits, pa.int32()), pa.array(form, pa.string()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] for k in keys], pa.int64())],
        ["kind", "term", "edits", "form", "pos", "neg"],
    )


def weigh(lexicon: Lexicon, train: DataFrame, n_pos: int, n_neg: int, most_cues: int = CUES) -> None:
    """Learns the lexicon's weights, innocent forms and cues from the places of the labelled texts."""
    counted = staged(count_places(train, lexicon), "toxic-places")
    odds = lambda p, n: math.log((p + 0.5) / (n_pos + 1)) - math.log((n + 0.5) / (n_neg + 1))
    forms = counted.where("kind = 'f' and edits > 0 and pos + neg >= 2").orderBy(F.desc("neg"), "form").limit(20_000).collect()
    lexicon.innocent = {r.form for r in forms if odds(r.pos, r.neg) < 1}
    kept = counted.where("kind = 'f'")
    sums: dict[tuple[int, int], list[int]] = {}
    for r in kept.groupBy("term", "edits").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect():  # terms by distances
        sums[r.term, r.edits] = [r.pos, r.neg]
    for r in forms:
        if r.form in lexicon.innocent:
            sums[r.term, r.edits][0] -= r.pos
            sums[r.term, r.edits][1] -= r.neg
    for t in range(len(lexicon.terms)):
        exact = odds(*sums.get((t, 0), [0, 0]))
        lexicon.weights[t, 0] = max(0.0, exact)
        for e in range(1, 1 + allowed(lexicon.terms[t])):
            p, n = sums.get((t, e), [0, 0])
            own = (p + n) / (p + n + 10)  # forms never seen take most of the term's own weight
            lexicon.weights[t, e] = max(0.0, own * odds(p, n) + (1 - own) * exact * 0.8**e)
    places = {r.term: (r.pos, r.neg) for r in counted.where("kind = 'n'").collect()}  # a row per term
    if places:
        # a cue is held against what the terms that it stands by let expect
        shares = F.create_map(*(F.lit(x) for t, (pos, neg) in places.items() for x in (t, (pos + 0.5) / (pos + neg + 1))))
        n = F.col("pos") + F.col("neg")
        near = counted.where("kind = 'c'").groupBy("form").agg(F.sum("pos").alias("pos"), F.sum(n).alias("n"), F.sum(n * shares[F.col("term")]).alias("due")).where("n >= 20")
        value = F.log((F.col("pos") + 10) / (F.col("due") + 10)) - F.log((F.col("n") - F.col("pos") + 10) / (F.col("n") - F.col("due") + 10))
        top = near.select("form", value.alias("v")).orderBy(F.desc(F.abs("v")), "form").limit(most_cues).collect()
        lexicon.cues = {r.form: r.v for r in top}
    unstage(counted)


def features(lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """Of each text: best place, sum of places, number of terms, and the sum by 100 words (logarithms of the last three)."""
    tokens = Tokens(column)
    at, found = lexicon.places(tokens)
    n = len(tokens.counts)
    best, total, terms = np.zeros(n), np.zeros(n), [set() for _ in range(n)]
    for k in at.tolist():
        row, m = tokens.row[k], found[tokens.which[k]]
        around = sum(lexicon.cues.get(c, 0.0) for c in context(tokens, k)) if lexicon.cues and lexicon.weights[m] else 0.0
        value = max(0.0, lexicon.weights[m] + min(CONTEXT, max(-CONTEXT, around)))
        if value:
            best[row] = max(best[row], value)
            total[row] += value
            terms[row].add(m[0])
    return np.stack([best, np.log1p(total), np.log1p([len(t) for t in terms]), np.log1p(100 * total / np.maximum(1, tokens.counts))], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of the features (scaled) and, last, of 1: Newton's steps with a ridge."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Lexicon, scales of the features and the logistic weights; ``None`` weights: no toxic text was labelled."""

    def __init__(self, lexicon: Lexicon, scale: np.ndarray | None = None, weights: np.ndarray | None = None):
        self.lexicon, self.scale, self.weights = lexicon, scale, weights

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(column))
        x = features(self.lexicon, column) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns lexicon, weights, cues and the logistic model from the labelled rows that aren't held out."""
    train = labelled_sample(docs, labels, sample)
    n_pos, n_neg = (int(x or 0) for x in train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    if not n_pos or not n_neg:
        unstage(train)
        return Model(Lexicon([]))
    lexicon = Lexicon(learned_terms(train, n_pos, n_neg))
    weigh(lexicon, train, n_pos, n_neg)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                x = features(shared.value, batch.column(0))
                yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, k]) for k in range(4))], ["toxic", "a", "b", "c", "d"])

    rows = train.select("text", "toxic").mapInArrow(run, "toxic int, a double, b double, c double, d double").toArrow()  # a row per text of the sample
    unstage(train)
    x = np.stack([rows[c].to_numpy() for c in "abcd"], 1)
    scale = np.maximum(1e-9, np.sqrt((x**2).mean(0)))
    return Model(lexicon, scale, fit_logistic(x / scale, rows["toxic"].to_numpy().astype(float)))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, STEP):
                batch = whole.slice(low, STEP)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out_by(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op12_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
