"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two words is the sum, over all sequences of three characters that both contain in order, gaps
allowed, of the product of their weights; a weight is ``decay`` to the power of the span, so a few characters put
into a word or between its letters change the kernel little. Spans are cut at ``reach``, where weights vanish.
A word's beginning is a character too, which goes with the first letter and one more, since many insults are stems whose letters stand
in other words as well. The kernel is normalised and squared. A word's features are its kernels with the landmarks, mapped by the inverse root
of the landmarks' own kernel matrix (Nyström). Single letters in a row are one word.

The machine is trained on sentences of labelled documents, at most ``per_label`` of either label and ``bytes_per_label``
of their texts, in the order of a hash of the id. Landmarks are found without regard to language: the sequence of 4 to 8
letters that tells toxic documents best from clean ones, then the one that does so in the words without it, and so
on while one is significant. Of documents so few that none is, the strongest there are have to do, down to those of
one document. An insult that few documents have is found only if hardly any clean one has its letters at that place: measured on 33 labelled
Spanish documents, see README. To these come words around
them, common words of clean documents, and, after a first fit, the clean words nearest to insults. A sentence is as toxic
as the word in it with the highest margin, and for learning a document is as its worst sentence, so in each of a few rounds a toxic
document is stood for by that word of that sentence, a clean one by its ``hardest`` and some others. Labels are taken to
be noisy: from the second round on a toxic document whose worst word is like that of the median clean one does not count.
The telling words with a letter put in or doubled count as toxic too. A document's margin is that of its worst word and a share of
that of the next worst, since a word like an insult that clean documents have by chance they seldom have twice; the share is that which tells the
labelled documents apart best. The margins of a held-back fifth, and of
those variants, are made probabilities (logistic); one half lies where misses and weighted false alarms of that fifth cost least.
Single letters in a row, with or without marks, are one word; an insult in pieces of several letters divided by plain
spaces is not put together, since neighbouring short words of clean texts would be as well.

Sums of kernels are computed once for each different word that a worker meets, as products of the weights of its sequences
with their rows in the landmarks' table.

Defined results: a null or empty text has the score of the lowest margin, that of no word at all; a null id is never
learned from and not held out; an id with both labels is toxic, and of repeated ids the smallest text is learned from; a text larger than
a twentieth of ``bytes_per_label`` is not learned from; if a label is missing the score is the share of label 1, or 0 without labels; words
over ``longest`` characters are scored in overlapping parts, which cover them whole; repeated rows score alike; an empty
table gives an empty result; only the columns named are read, so others may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.language import _logistic, fold

#: Letters, other characters in 38 classes, and the mark of a word's beginning.
SYMBOLS, BEGIN = 65, "^"
#: Tokens whose margins a worker remembers between batches, about 150 MB at most.
REMEMBERED = 800_000
#: Weights of words' sequences in landmarks that are summed up at once.
AT_ONCE = 4_000_000
#: Base of windows' hashes.
PRIME = 0x9E3779B97F4A7C15
#: Ends of sentences.
STOPS = re.compile(r"[.!?]+[\"')]*\s|\n")
#: Characters that look like letters, when between letters (fixed values).
LOOKS_LIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGE = re.compile(r"^[^\w@$]+|^[@$_]{2,}|[\W_]+$")
INNER = re.compile(r"[\W_]+")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray, span: int) -> np.ndarray:
    return left * np.uint64(pow(PRIME, span, 1 << 64)) + right


def window_hashes(points: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` code points, put together from windows of powers of two."""
    part, span, got, done = points.astype(np.uint64) + np.uint64(1), 1, 0, None
    while True:
        if width & span:
            done = part if done is None else _joined(done[: len(part) - got], part[got:], span)
            got += span
        if got == width:
            return _mixed(done)
        if len(part) <= span:
            return np.empty(0, np.uint64)
        part = _joined(part[:-span], part[span:], span)
        span *= 2


@dataclass(frozen=True)
class Training:
    decay: float = 0.7
    reach: int = 9
    longest: int = 12
    telling: int = 48
    least_z: float = 5.0
    least_documents: int = 4
    most_clean_share: float = 0.1
    around: int = 4
    common: int = 30
    nearest: int = 50
    per_label: int = 3000
    bytes_per_label: int = 4_000_000
    hardest: int = 3
    others: int = 4
    rounds: int = 4
    penalty: float = 1e-4
    alarm_weight: float = 10.0
    second: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0, 2.0)
    held_out_of: int = 5


@lru_cache(maxsize=128)
def _triples(n: int, reach: int, begun: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of three characters in order. The mark of a beginning goes with the first letter and one more."""
    got = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n) if k - i < reach and not (begun and i == 0 and j > 1)]
    a = np.array(got, dtype=np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], a[:, 2] - a[:, 0] + 1


def _symbols(words: list[str], n: int) -> np.ndarray:
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n)
    return np.where(points == ord(BEGIN), SYMBOLS - 1, np.where((points >= 97) & (points <= 122), points - 97, 26 + points % 38)).astype(np.int64)


def _cells(words: list[str], n: int, how: Training) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of all triples of words that are all ``n`` long, and all marked at their beginning or none."""
    i, j, k, span = _triples(n, how.reach, words[0].startswith(BEGIN))
    s = _symbols(words, n)
    return (s[:, i] * SYMBOLS + s[:, j]) * SYMBOLS + s[:, k], how.decay**span


def _self_kernel(code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself: squares of the summed weights of equal sequences."""
    order = np.argsort(code, axis=1, kind="stable")
    sorted_code = np.take_along_axis(code, order, 1)
    w = weight[order]
    new = np.ones(code.shape, bool)
    new[:, 1:] = sorted_code[:, 1:] != sorted_code[:, :-1]
    sums = np.add.reduceat(w.ravel(), np.flatnonzero(new.ravel()))
    return np.add.reduceat(sums * sums, np.append(0, np.cumsum(new.sum(axis=1))[:-1]))


@dataclass
class Kernel:
    """Landmarks as one table: for each sequence of three, its summed weight in each landmark, normalised."""

    landmarks: list[str]
    how: Training
    row_of: np.ndarray = field(init=False)
    table: np.ndarray = field(init=False)

    def __post_init__(self):
        cells: dict[int, np.ndarray] = {}
        for m, word in enumerate(self.landmarks):
            code, weight = _cells([word], len(word), self.how)
            norm = np.sqrt(_self_kernel(code, weight)[0])
            for c, w in zip(code[0].tolist(), weight.tolist(), strict=True):
                cells.setdefault(c, np.zeros(len(self.landmarks), np.float32))[m] += w / norm
        self.row_of = np.full(SYMBOLS**3, -1, np.int32)
        # Sequences that no landmark has are in the last row, of zeros.
        self.table = np.zeros((len(cells) + 1, len(self.landmarks)), np.float32)
        for r, (c, v) in enumerate(sorted(cells.items())):
            self.row_of[c], self.table[r] = r, v

    def __call__(self, words: list[str]) -> np.ndarray:
        """Squared normalised kernels of each word with each landmark; words of under three characters have none."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        # Marked words are those of odd numbers.
        lengths = np.fromiter((2 * len(w) + w.startswith(BEGIN) for w in words), np.int64, len(words))
        for m in np.unique(lengths[lengths >= 6]):
            n = int(m) // 2
            for group in np.array_split(np.flatnonzero(lengths == m), 1 + int((lengths == m).sum() * n * n // 400_000)):
                out[group] = self._of([words[i] for i in group], n)
        return out

    def _of(self, words: list[str], n: int) -> np.ndarray:
        code, weight = _cells(words, n, self.how)
        row, w = self.row_of[code], weight.astype(np.float32)
        k = np.empty((len(words), len(self.landmarks)), np.float32)
        step = max(1, AT_ONCE // (len(w) * max(1, len(self.landmarks))))
        for at in range(0, len(words), step):
            k[at : at + step] = np.matmul(w, self.table[row[at : at + step]])
        near = np.flatnonzero(k.any(axis=1))
        if len(near):
            k[near] = k[near] / np.sqrt(_self_kernel(code[near], weight))[:, None].astype(np.float32)
        return k * k


def units(text: str | None) -> list[str]:
    """The tokens of a text in lower case; three or more single letters in a row are joined, whatever marks are around them."""
    if not text:
        return []
    out = text.lower().split()
    short = [i for i, w in enumerate(out) if len(w) < 4 and (len(w) == 1 or not w.isalpha())]
    if not any(b - a == 2 for a, b in zip(short, short[2:], strict=False)):
        return out
    joined: list[str] = []
    run: list[str] = []
    letters: list[str] = []
    for w in [*out, "...."]:
        bare = [c for c in w if c.isalnum()] if len(w) < 4 else []
        if len(w) < 4 and (len(bare) == 1 and bare[0].isalpha() or run and not bare):
            run.append(w)
            letters += bare
            continue
        joined += ["".join(letters)] if len(letters) >= 3 else run
        run, letters = [], []
        joined.append(w)
    return joined[:-1]


def plain(token: str, longest: int) -> list[str]:
    """A token's letters without what surrounds or divides them, in overlapping parts of at most ``longest``."""
    w = token if token.isalpha() else INNER.sub("", EDGE.sub("", token).translate(LOOKS_LIKE) if any(c.isalpha() for c in token) else "")
    step = max(1, longest // 3)
    return [w] if len(w) <= longest else [w[i : i + longest] for i in [*range(0, len(w) - longest, step), len(w) - longest]]


def begun(token: str, longest: int) -> list[str]:
    """The parts of a token (see :func:`plain`), the first with the mark of a word's beginning."""
    first, *rest = plain(token, longest)
    return [BEGIN + first if first else first, *rest]


@dataclass
class Detector:
    kernel: Kernel | None
    alpha: np.ndarray
    bias: float
    slope: float
    offset: float
    how: Training
    constant: float = 0.0
    second: float = 0.0
    known: dict[str, float] = field(default_factory=dict)

    def word_margins(self, tokens: list[str]) -> np.ndarray:
        """The margin of each token: of its parts the highest."""
        parts = [begun(t, self.how.longest) for t in tokens]
        flat = [p for x in parts for p in x]
        code, kinds = pd.factorize(np.array(flat, dtype=object))
        g = (self.kernel(kinds.tolist()) @ self.alpha)[code]
        return np.maximum.reduceat(g, np.append(0, np.cumsum([len(p) for p in parts])[:-1])) + self.bias

    def tops(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The two highest margins of words of each text; that of no word where there are fewer."""
        tokens = [units(t) for t in texts]
        counts = np.array([len(t) for t in tokens], dtype=np.int64)
        first, second = np.full(len(texts), float(self.bias)), np.full(len(texts), float(self.bias))
        flat = [w for t in tokens for w in t]
        if not flat:
            return first, second
        code, kinds = pd.factorize(np.array(flat, dtype=object))
        kinds = kinds.tolist()
        new = [k for k in kinds if k not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, kinds
        if new:
            self.known.update(zip(new, self.word_margins(new).tolist(), strict=True))
        g = np.fromiter(map(self.known.__getitem__, kinds), float, len(kinds))[code]
        some = counts > 0
        starts = np.append(0, np.cumsum(counts[some])[:-1])
        first[some] = np.maximum.reduceat(g, starts)
        # Of each text the first word that reaches its highest margin is left out.
        best = np.flatnonzero(g == np.repeat(first[some], counts[some]))
        g[best[np.searchsorted(best, starts)]] = self.bias
        second[some] = np.maximum.reduceat(g, starts)
        return first, second

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The highest margin of a word of each text, and its share of the next."""
        first, second = self.tops(texts)
        return first + self.second * second

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def _sentences(text: str, longest: int) -> list[list[str]]:
    out = [[p for t in units(x) for p in begun(t, longest) if p] for x in STOPS.split(text)]
    return [s for s in out if s]


#: Lengths of the letter sequences that may tell.
LENGTHS = range(4, 9)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all letter sequences of all words, one word after the other, and where each word's begin."""
    points = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    owner, found = [], []
    for n in LENGTHS:
        times = np.maximum(size - n + 1, 0)
        at = np.arange(times.sum()) + np.repeat(start - (np.cumsum(times) - times), times)
        owner.append(np.repeat(np.arange(len(words), dtype=np.int32), times))
        found.append(window_hashes(points, n)[at] if len(at) else np.empty(0, np.uint64))
    owner = np.concatenate(owner)
    number = np.unique(np.concatenate(found), return_inverse=True)[1].astype(np.int32)
    order = np.argsort(owner, kind="stable")
    return number[order], np.searchsorted(owner[order], np.arange(len(words) + 1))


def _unlike(texts: list[np.ndarray]) -> np.ndarray:
    """The first text of each group of near copies, by two minima of the hashes of its neighbouring words, so that copies don't
    count as evidence. ``texts``: the numbers of all words in order."""
    first: dict[tuple[int, ...], int] = {}
    for i, t in enumerate(texts):
        pairs = window_hashes(t, min(3, len(t)))
        first.setdefault(tuple(int((pairs * np.uint64(m)).min()) for m in (1, 0x9E3779B97F4A7C15)), i)
    return np.array(sorted(first.values()))


def _telling(docs: list[np.ndarray], kinds: list[str], y: np.ndarray, how: Training) -> list[str]:
    """Letter sequences that tell toxic documents from clean ones, each without the words that the ones before are in. ``docs``: the
    numbers of each document's different words."""
    grams, begin = _grams(kinds)
    clean, with_it = np.zeros(int(grams.max(initial=0)) + 1, np.int32), np.zeros(int(grams.max(initial=0)) + 1, np.int32)
    toxic: list[np.ndarray] = []

    def places(words: np.ndarray) -> np.ndarray:
        return np.unique(np.concatenate([grams[begin[w] : begin[w + 1]] for w in words.tolist()])) if len(words) else np.empty(0, np.int32)

    for words, label in zip(docs, y.tolist(), strict=True):
        (with_it if label else clean)[places(words)] += 1
        if label:
            toxic.append(words)
    n_toxic, n_clean = max(1, len(toxic)), max(1, len(docs) - len(toxic))
    share = clean / n_clean
    least, least_z = max(how.least_documents, round(0.005 * n_toxic)), how.least_z
    out: list[str] = []
    while len(out) < how.telling:
        may = np.flatnonzero((with_it >= least) & (share <= how.most_clean_share))
        p, q = with_it[may] / n_toxic, share[may]
        both = (with_it[may] + clean[may]) / (n_toxic + n_clean)
        z = (p - q) / np.sqrt(both * (1 - both) * (1 / n_toxic + 1 / n_clean) + 1e-12)
        if not len(z) or z.max() < least_z:
            # Of few documents nothing may be significant: then the strongest there is has to do.
            if out or least == 1:
                break
            least, least_z = least - 1, min(least_z, 2.0)
            continue
        # Of sequences that tell nearly alike the longest is taken.
        strength = dict(zip(may[z >= 0.98 * z.max()].tolist(), z[z >= 0.98 * z.max()].tolist(), strict=True))
        near = np.array(list(strength))
        names: dict[int, str] = {}
        for i in np.flatnonzero(np.isin(grams, near)).tolist():
            if int(grams[i]) not in names:
                w = int(np.searchsorted(begin, i, "right")) - 1
                names[int(grams[i])] = _gram(kinds[w], i - int(begin[w]))
        best = max(strength, key=lambda g: (len(names[g]), strength[g], names[g]))
        out.append(names[best])
        told = np.zeros(len(kinds), bool)
        told[np.searchsorted(begin, np.flatnonzero(grams == best), "right") - 1] = True
        for i, words in enumerate(toxic):
            gone = told[words]
            if gone.any():
                with_it[places(words)] -= 1
                toxic[i] = words[~gone]
                with_it[places(toxic[i])] += 1
    return out


def _gram(word: str, place: int) -> str:
    for n in LENGTHS:
        if place < max(0, len(word) - n + 1):
            return word[place : place + n]
        place -= max(0, len(word) - n + 1)
    raise IndexError(place)


def _svm(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear support vector machine, squared hinge, classes weighted alike, by Newton's method on the support vectors."""
    sign = np.where(y > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], penalty)
    ridge[-1] = 1e-8
    for _ in range(rounds):
        active = sign * (z @ w) < 1
        za, ca = z[active], cost[active]
        new = np.linalg.solve((za * ca[:, None]).T @ za + np.diag(ridge), (za * ca[:, None]).T @ sign[active]) if active.any() else w
        if np.abs(new - w).max() < 1e-7:
            break
        w = new
    return w[:-1], float(w[-1])


def _cut(margins: np.ndarray, y: np.ndarray, alarm_weight: float) -> tuple[float, float]:
    """The cut between two margins at which the share of label 1 below and ``alarm_weight`` times that of label 0 above add up
    to the least, and what it costs; the middle of the widest gap among equals. Clean documents are many, so a share of them weighs more.
    Toxic texts that are labelled clean cost the same at all cuts below them, so a few of them don't move it."""
    order = np.argsort(margins, kind="stable")
    m, marks = margins[order], y[order]
    below, above = np.cumsum(marks) / max(1, marks.sum()), 1 - np.cumsum(1 - marks) / max(1, (1 - marks).sum())
    cost = np.round((below + alarm_weight * above)[:-1], 9)
    gap = np.diff(m)
    best = np.flatnonzero((gap > 0) & (cost == cost[gap > 0].min())) if (gap > 0).any() else np.zeros(0, int)
    if not len(best):
        return float(m[-1]) + 0.02, float("inf")
    at = best[np.argmax(gap[best])]
    return float(m[at] + m[at + 1]) / 2, float(cost[at])


def _rounds(words: list[list[np.ndarray]], labels: np.ndarray, kernel: Kernel, k: np.ndarray, margin: np.ndarray, variants: list[str], how: Training) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, the root that maps kernels, and the margin of each word, whose kernels are ``k``."""
    own, vectors = np.linalg.eigh(kernel(kernel.landmarks).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(own, 1e-3))) @ vectors.T
    mapped = (k.astype(float) @ root).astype(np.float32)
    bent = list(range(len(mapped), len(mapped) + len(variants)))
    if variants:
        mapped = np.vstack([mapped, (kernel(variants).astype(float) @ root).astype(np.float32)])
    rng = np.random.default_rng(7)
    beta, bias = np.zeros(mapped.shape[1]), 0.0
    for r in range(how.rounds):
        # Of each sentence the word with the highest margin; of each document its sentences from the worst down.
        ranked = []
        for sentences in words:
            tops = np.array([s[np.argmax(margin[s])] for s in sentences])
            ranked.append(tops[np.argsort(-margin[tops], kind="stable")])
        worst = np.array([margin[t[0]] for t in ranked])
        above = np.quantile(worst[labels == 0], 0.5)
        rows, target = [], []
        for t, w, label in zip(ranked, worst, labels, strict=True):
            if label:
                if r == 0 or w > above:
                    rows.append(t[0])
                    target.append(1)
            else:
                chosen = [*t[: how.hardest], *rng.choice(t, min(how.others, len(t)), replace=False)]
                rows += chosen
                target += [0] * len(chosen)
        if not sum(target):
            break
        beta, bias = _svm(mapped[rows + bent].astype(float), np.array(target + [1] * len(bent), dtype=float), how.penalty)
        margin = (mapped @ beta)[: len(k)]
    return beta, bias, root, margin


def fit(texts: list[str], y: np.ndarray, held: np.ndarray, how: Training = Training()) -> Detector:
    """A detector from labelled texts; those ``held`` only calibrate it."""
    if not len(y) or y.min() == y.max():
        return Detector(None, np.zeros(0), 0.0, 0.0, 0.0, how, float(y.mean()) if len(y) else 0.0)
    docs = [_sentences(t, how.longest) for t in texts]
    learn = [i for i in range(len(y)) if not held[i] and docs[i]]
    if len({int(y[i]) for i in learn}) < 2:
        return Detector(None, np.zeros(0), 0.0, 0.0, 0.0, how, float(y.mean()))
    kinds: dict[str, int] = {}
    words = [[np.array([kinds.setdefault(w, len(kinds)) for w in s]) for s in docs[i]] for i in learn]
    names, labels = list(kinds), y[learn]
    different = [np.unique(np.concatenate(s)) for s in words]
    unlike = _unlike([np.concatenate(s) for s in words])
    telling = _telling([different[i] for i in unlike], names, labels[unlike], how)
    if not telling:
        return Detector(None, np.zeros(0), 0.0, 0.0, 0.0, how, float(y.mean()))
    often = [np.bincount(np.concatenate([d for d, label in zip(different, labels, strict=True) if label == k]), minlength=len(names)) for k in (0, 1)]
    around = [w for t in telling for w in sorted((w for w in names if t in w and w != t), key=lambda w: (-often[1][kinds[w]], w))[: how.around]]
    common = [names[i] for i in np.argsort(-often[0], kind="stable") if len(names[i]) > 3][: how.common]
    landmarks = list(dict.fromkeys([*telling, *around, *common]))
    # The telling words with a letter put in or doubled are toxic as well.
    variants = sorted({w[:i] + c + w[i:] for w in telling for i in range(2 if w.startswith(BEGIN) else 1, len(w)) for c in ("x", w[i])} - kinds.keys())
    kernel = Kernel(landmarks, how)
    k = kernel(names)
    margin = k[:, : len(telling)].max(axis=1)
    for last in (False, True):
        beta, bias, root, margin = _rounds(words, labels, kernel, k, margin, variants, how)
        if not last:
            # The clean words nearest to insults become landmarks, and only words near the cut are looked at from here on.
            told = np.array([any(t in w for t in telling) for w in names])
            near = [names[i] for i in np.argsort(-np.where((often[0] > 0) & ~told, margin, -np.inf), kind="stable")[: how.nearest] if len(names[i]) > 3]
            kernel = Kernel(list(dict.fromkeys([*landmarks, *near])), how)
            words = [[s[np.argsort(-margin[s], kind="stable")[:6]] for s in d] for d in words]
            some = np.unique(np.concatenate([s for d in words for s in d]))
            place = np.full(len(names), -1)
            place[some] = np.arange(len(some))
            words = [[place[s] for s in d] for d in words]
            k, margin = kernel([names[i] for i in some]), margin[some]
    out = Detector(kernel, (root @ beta).astype(np.float32), bias, 1.0, 0.0, how)
    # How much the next highest margin counts is what tells all documents apart best; a word that clean ones have by chance they seldom have twice.
    first, second = out.tops(texts)
    out.second = min(how.second, key=lambda w: (_cut(first + w * second, y, how.alarm_weight)[1], w))
    check = np.flatnonzero(held) if held.any() and len(set(y[held].tolist())) == 2 else np.arange(len(y))
    both = first + out.second * second
    x, marks = both[check], y[check].astype(float)
    if variants:
        x, marks = np.append(x, out.word_margins(variants) + out.second * out.bias), np.append(marks, np.ones(len(variants)))
    out.slope, out.offset = _logistic(x, marks)
    # One half lies where misses and false alarms among the held-back documents, each as a share of its label, cost least together.
    out.offset = -out.slope * _cut(both[check], y[check], how.alarm_weight)[0]
    return out


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Detector:
    """A detector from the documents that have a label."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("y")).withColumn("rank", F.xxhash64("key", F.lit(3)))
    # About a quarter more than are wanted, by a bound on the hash, so that no task ranks all rows of a label.
    bound = F.lit(1 << 30)
    for r in marks.groupBy("y").count().collect():
        bound = F.when(F.col("y") == r["y"], F.lit(int(min(1.0, (1.25 * how.per_label + 100) / r["count"]) * (1 << 30)))).otherwise(bound)
    chosen = marks.filter(F.pmod("rank", F.lit(1 << 30)) < bound)
    found = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    sizes = found.groupBy("key", "y", "rank").agg(F.min(F.octet_length("text")).alias("size")).toPandas().sort_values(["rank", "key"], ignore_index=True)
    sizes = sizes[sizes["size"] <= how.bytes_per_label // 20]
    sizes["place"] = sizes.groupby("y").cumcount()
    sizes = sizes[(sizes["place"] < how.per_label) & (sizes.groupby("y")["size"].cumsum() <= how.bytes_per_label)]
    held = sizes.set_index("key")["place"] % how.held_out_of == how.held_out_of - 1
    few = docs.sparkSession.createDataFrame(pd.DataFrame({"key": sizes["key"]}), f"key {docs.schema[key].dataType.simpleString()}")
    got = found.join(F.broadcast(few), "key", "left_semi").groupBy("key", "y").agg(F.min("text").alias("text")).toPandas().sort_values("key", ignore_index=True)
    return fit(got["text"].tolist(), got["y"].to_numpy(np.int64), held.reindex(got["key"]).to_numpy(bool), how)


def _score(model: Detector):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                pdf = whole.iloc[at : at + 1_000]
                s = model.scores(pdf["_text"].tolist())
                yield pd.DataFrame({"_key": pdf["_key"], "_held": pdf["_held"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    return run


def score(docs: DataFrame, model: Detector, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: the key, ``held_out``, ``score`` and ``predicted``."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(fold(key) == 0, F.lit(False)).alias("_held"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInPandas(_score(model), f"_key {kind}, _held boolean, score double, predicted int").withColumnsRenamed({"_key": key, "_held": "held_out"})


def learn_and_score(docs: DataFrame, labels: DataFrame, how: Training = Training(), *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """Learns from labelled rows outside of the held-out fold, then scores every row from its text alone."""
    outside = fold(key) != 0
    return score(docs, train(docs.filter(outside), labels.filter(outside), how, key=key, text=text, label=label), key=key, text=text)
