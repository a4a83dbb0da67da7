"""Language identification by interpolated Kneser-Ney character models, one for each language.

A model gives the probability of each character of a word, marked by a space at either end, after the up to four
characters before it. All models lie in one table an order: the sorted 64-bit hashes of its character strings,
and beside each, for every language, the interpolated log-probability of its last character and the log-weight that
it hands on when it is a context. A string is found by binary search; where a language has not seen it, the
shorter string's probability counts, times the weight of the context if that was seen. Words are scored once
a batch. The language of a text is the one of the lowest cross-entropy a character.

Training takes whole texts of at most ``per_language`` documents of each language, those with the smallest hash of
their id; a fifth of them is held back. On these the margin over the second language is calibrated to a probability
(logistic, by Newton's method), and each language's usual cross-entropy is measured: a text that lies more than
``reject_sigmas`` deviations above it is marked ``rejected``, and its score is halved.

Defined results: a null text or one without a letter is ``und`` with score 0; where nothing can be learned every
text is; a null id is never learned from and not held out; ties go to the first language by name; repeated rows
are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
NO_LETTERS = re.compile(r"[\W\d_]+")
GAP = np.uint64(0x9E3779B97F4A7C15)
#: Held-back texts that the driver measures at once.
MEASURED_AT_ONCE = 50


@dataclass(frozen=True)
class Training:
    order: int = 5
    per_language: int = 2000
    most_languages: int = 200
    discount: float = 0.75
    alphabet: int = 4096
    reject_sigmas: float = 6.0
    held_out_of: int = 5


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    return NO_LETTERS.sub(" ", text.lower()).split() if text else []


def _strings(words: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each length up to ``order`` the hashes of the strings that end at each character of ``" word "`` but the
    first; where the word is too short for the length, the hash of the longest there is. Also which have full length,
    as a matrix, and how many characters each word gives."""
    points = np.frombuffer(" ".join(["", *words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = points == 32
    # Each word's string begins at its leading space and ends at the next one.
    start = np.flatnonzero(space)[:-1]
    length = np.diff(np.flatnonzero(space))
    at = np.arange(1, len(points))
    behind = at - np.repeat(start, length)
    hashes, full = [], []
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        mult = np.uint64(1)
        for n in range(1, order + 1):
            there = behind >= n - 1
            h = h + np.where(there, (points[np.maximum(at - n + 1, 0)] + np.uint64(1)) * mult, np.uint64(0))
            mult = mult * GAP
            hashes.append(_spread(h + np.uint64(n)))
            full.append(there)
    return hashes, np.array(full), length


def _spread(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))


def _count(order: int):
    """Strings of a batch of ``lang, text``: language, length, hash, hash of the context, of the rest, and count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                words = [w for t in texts for w in words_of(t)]
                if not words:
                    continue
                code, kinds = pd.factorize(np.array(words, dtype=object))
                times = np.bincount(code)
                hashes, full, length = _strings(kinds.tolist(), order)
                weight = np.repeat(times, length)
                for n in range(1, order + 1):
                    ok = full[n - 1]
                    h = hashes[n - 1][ok]
                    # The context ends one character earlier; the rest is the string without its first character.
                    before = np.roll(hashes[n - 2], 1)[ok] if n > 1 else np.zeros(len(h), np.uint64)
                    if n > 1:
                        first = np.zeros(len(ok), bool)
                        first[np.append(0, np.cumsum(length)[:-1])] = True
                        lead = _spread(np.uint64(33) + np.array([1], np.uint64))[0] if n == 2 else np.uint64(0)
                        before = np.where(first[ok], lead, before)
                    rest = hashes[n - 2][ok] if n > 1 else np.zeros(len(h), np.uint64)
                    frame = pd.DataFrame({"h": h, "ctx": before, "rest": rest, "c": weight[ok]}).groupby(["h", "ctx", "rest"], as_index=False)["c"].sum()
                    yield pd.DataFrame({"lang": lang, "n": n, "h": frame["h"].to_numpy().view(np.int64), "ctx": frame["ctx"].to_numpy().view(np.int64), "rest": frame["rest"].to_numpy().view(np.int64), "c": frame["c"].astype(np.int64)})

    return run


class Models:
    """All languages' models in sorted hash arrays: ``keys[n]``, ``logp[n]`` and ``weight[n]``, a column a language."""

    def __init__(self, counts: pd.DataFrame, how: Training, langs: list[str] | None = None):
        """``counts``: sorted by language, length and hash; with ``langs``, sorted, a language is its place there."""
        self.langs = sorted(counts["lang"].unique().tolist()) if langs is None else langs
        if langs is None:
            counts = counts.assign(lang=counts["lang"].map({k: i for i, k in enumerate(self.langs)}))
        self.order = how.order
        self.keys: list[np.ndarray] = []
        self.logp: list[np.ndarray] = []
        self.weight: list[np.ndarray] = []
        self.floor = -np.log(how.alphabet)
        # A string's count below the highest order is the number of different characters seen before it.
        each = lambda n: counts[(counts["n"] == n).to_numpy()].drop(columns="n")  # noqa: E731  one length at a time, as the driver's memory is small
        lead = np.int64(_spread(np.array([33 + 1], np.uint64)).view(np.int64)[0])
        for n in range(1, how.order + 1):
            part = each(n)
            part["h"] = part["h"].to_numpy().view(np.uint64)
            if n < how.order:
                lower = each(n + 1).groupby(["lang", "rest"]).size()
                seen = lower.reindex(pd.MultiIndex.from_arrays([part["lang"], part["h"].to_numpy().view(np.int64)])).to_numpy()
                del lower
                # Strings from a word's beginning have nothing before them: their plain counts stand.
                part["c"] = np.where(np.isnan(seen), part["c"], seen)
            part["c"] = part["c"].astype(float)
            total = part.groupby(["lang", "ctx"])["c"].transform("sum").to_numpy()
            kinds = part.groupby(["lang", "ctx"])["c"].transform("size").to_numpy()
            c = part["c"].to_numpy()
            own = np.maximum(c - how.discount, 0) / total
            handed = how.discount * np.minimum(kinds, total / how.discount) / total
            base = np.exp(self.floor) if n == 1 else np.exp(self._of(part["rest"].to_numpy().view(np.uint64), n - 1, part["lang"].to_numpy()))
            keys = np.unique(part["h"].to_numpy().astype(np.uint64))
            logp = np.full((len(keys), len(self.langs)), np.nan, np.float32)
            row, col = np.searchsorted(keys, part["h"].to_numpy().astype(np.uint64)), part["lang"].to_numpy()
            logp[row, col] = np.log(own + handed * base)
            self.keys.append(keys)
            self.logp.append(logp)
            self.weight.append(np.zeros_like(logp))
            if n == 1:
                self.start = np.zeros(len(self.langs), np.float32)
                self.start[col] = np.log(handed)
            else:
                ctx = pd.DataFrame({"x": part["ctx"].to_numpy().view(np.uint64), "col": col, "w": np.log(handed)}).drop_duplicates(["x", "col"])
                if n == 2 and lead.view(np.uint64) not in self.keys[0]:
                    self._insert(0, lead.view(np.uint64))
                x = ctx["x"].to_numpy()
                at = np.searchsorted(self.keys[n - 2], x)
                there = (at < len(self.keys[n - 2])) & (self.keys[n - 2][np.minimum(at, len(self.keys[n - 2]) - 1)] == x)
                self.weight[n - 2][at[there], ctx["col"].to_numpy()[there]] = ctx["w"].to_numpy()[there]

    def _insert(self, i: int, key: np.uint64) -> None:
        at = np.searchsorted(self.keys[i], key)
        self.keys[i] = np.insert(self.keys[i], at, key)
        self.logp[i] = np.insert(self.logp[i], at, np.nan, axis=0)
        self.weight[i] = np.insert(self.weight[i], at, 0, axis=0)

    def _of(self, h: np.ndarray, n: int, col: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys[n - 1], h), len(self.keys[n - 1]) - 1)
        p = np.where(self.keys[n - 1][at] == h, self.logp[n - 1][at, col], np.nan)
        return np.where(np.isnan(p), self.floor, p)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word in every language, and the number of characters with the closing space."""
        hashes, full, length = _strings(words, self.order)
        first = np.append(0, np.cumsum(length)[:-1])
        lead = _spread(np.array([33 + 1], np.uint64))[0]
        score = None
        found_before = None
        for n in range(1, self.order + 1):
            keys, ok = self.keys[n - 1], full[n - 1]
            at = np.minimum(np.searchsorted(keys, hashes[n - 1]), len(keys) - 1)
            hit = (keys[at] == hashes[n - 1]) & ok
            if n == 1:
                p = np.where(hit[:, None], self.logp[0][at], np.nan)
                score = np.where(np.isnan(p), self.start[None, :] + np.float32(self.floor), p)
            else:
                before = np.roll(found_before[0], 1)
                seen = np.roll(found_before[1], 1)
                if n == 2:
                    k = min(int(np.searchsorted(self.keys[0], lead)), len(self.keys[0]) - 1)
                    before[first], seen[first] = k, self.keys[0][k] == lead
                handed = np.where((seen & ok)[:, None], self.weight[n - 2][before], 0)
                p = np.where(hit[:, None], self.logp[n - 1][at], np.nan)
                score = np.where(np.isnan(p), score + handed, p)
            found_before = (at, hit)
        return np.add.reduceat(score, first, axis=0), length

    def measure(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a character (nats) of each text in every language; and which texts have a letter."""
        words = [words_of(t) for t in texts]
        counts = np.array([len(w) for w in words])
        some = counts > 0
        out = np.zeros((len(texts), len(self.langs)))
        flat = [w for x in words for w in x]
        if flat:
            code, kinds = pd.factorize(np.array(flat, dtype=object))
            score, length = self.word_scores(kinds.tolist())
            at = np.append(0, np.cumsum(counts[some])[:-1])
            chars = np.add.reduceat(length[code], at)
            out[some] = -np.stack([np.add.reduceat(score[:, k][code].astype(float), at) for k in range(len(self.langs))], axis=1) / chars[:, None]
        return out, some


@dataclass
class Classifier:
    models: Models
    slope: float
    offset: float
    usual: np.ndarray
    spread: np.ndarray
    how: Training

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        h, some = self.models.measure(texts)
        best = h.argmin(axis=1)
        at = np.arange(len(h))
        second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else h[:, 0] + 1.0
        low = h[at, best]
        score = 1 / (1 + np.exp(-np.clip(self.slope * (second - low) + self.offset, -30, 30)))
        rejected = some & (low > self.usual[best] + self.how.reject_sigmas * self.spread[best])
        score = np.where(some, np.where(rejected, score / 2, score), 0.0)
        return [self.models.langs[b] if s else UNDETERMINED for b, s in zip(best, some, strict=True)], score, low, rejected


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset, with the targets drawn in so that they stay finite."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0, hi, lo)
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * x).sum() + 1e-3 * a, (p - t).sum()])
        hess = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
    return max(float(a), 0.0), float(b)


def fold(key: str) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 5


def _collected(counts: DataFrame) -> tuple[pd.DataFrame, list[str]]:
    """The counts of :func:`_count`, sorted, with each language's place in the languages sorted by name, and these.

    As Arrow columns of which each is let go once it is copied: not as rows of Python objects, which take more memory.
    """
    table = counts.toArrow()
    names = table["lang"].unique().to_pylist()
    langs = sorted(names)
    place = np.array([langs.index(x) for x in names], np.int16)
    code = np.concatenate([np.empty(0, np.int16), *[place[x.indices.to_numpy()] for x in table["lang"].dictionary_encode().unify_dictionaries().chunks]]) if names else np.empty(0, np.int16)
    order = np.lexsort((table["h"].to_numpy(), table["n"].to_numpy(), code))
    columns = {"lang": code[order]}
    for name in ("n", "h", "ctx", "rest", "c"):
        columns[name] = table[name].to_numpy()[order]
        table = table.drop_columns([name])
    return pd.DataFrame(columns, copy=False), langs


def train(labelled: DataFrame, how: Training = Training(), *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Classifier | None:
    """A classifier of the rows of ``labelled``; None if no row has a language and a letter."""
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(1)).alias("rank"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(how.most_languages).select("lang")
    chosen = rows.select("lang", "rank", "row").join(F.broadcast(top), "lang", "left_semi")
    chosen = chosen.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("rank", "row"))).filter(F.col("place") <= how.per_language).select("row", F.col("place").alias("place"))
    sample = rows.join(F.broadcast(chosen), "row").select("lang", "text", (F.col("place") % how.held_out_of == 0).alias("held"))
    counts = sample.filter("not held").select("lang", "text").mapInPandas(_count(how.order), "lang string, n int, h long, ctx long, rest long, c long").groupBy("lang", "n", "h", "ctx", "rest").agg(F.sum("c").alias("c"))
    table, langs = _collected(counts)
    if table.empty:
        return None
    models = Models(table, how, langs)
    del table
    held = sample.filter("held").select("lang", "text").toArrow().to_pandas()
    k = len(models.langs)
    usual, spread = np.full(k, 10.0), np.full(k, 1.0)
    slope, offset = 10.0, 0.0
    if len(held):
        texts = held["text"].tolist()
        parts = [models.measure(texts[i : i + MEASURED_AT_ONCE]) for i in range(0, len(texts), MEASURED_AT_ONCE)]
        h, some = (np.concatenate(x) for x in zip(*parts, strict=True))
        right = h.argmin(axis=1) == held["lang"].map({x: i for i, x in enumerate(models.langs)}).fillna(-1).to_numpy()
        if k > 1 and some.any():
            slope, offset = _logistic((np.partition(h, 1, axis=1)[:, 1] - h.min(axis=1))[some], right[some].astype(float))
        for i, x in enumerate(models.langs):
            own = h[(held["lang"] == x).to_numpy() & some, i]
            if len(own) > 1:
                usual[i], spread[i] = own.mean(), max(own.std(), 0.02)
    return Classifier(models, slope, offset, usual, spread, how)


def _predict(model: Classifier | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1_000):
                pdf = whole.iloc[at : at + 1_000]
                if model is None:
                    lang, score, low, rejected = [UNDETERMINED] * len(pdf), 0.0, 0.0, False
                else:
                    lang, score, low, rejected = model.predict(pdf["_text"].tolist())
                yield pd.DataFrame({"_key": pdf["_key"], "_held": pdf["_held"], "lang_pred": lang, "score": score, "cross_entropy": low, "rejected": rejected})

    return run


def identify(docs: DataFrame, model: Classifier | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: the key, ``held_out``, ``lang_pred``, ``score``, ``cross_entropy`` (nats a character) and ``rejected``."""
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(fold(key) == 0, F.lit(False)).alias("_held"), F.col(text).alias("_text"))
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInPandas(_predict(model), f"_key {kind}, _held boolean, lang_pred string, score double, cross_entropy double, rejected boolean")
    return out.withColumnsRenamed({"_key": key, "_held": "held_out"})


def learn_and_identify(docs: DataFrame, how: Training = Training(), *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the rows outside of the held-out fold, then predicts every row from its text alone."""
    return identify(docs, train(docs.filter(fold(key) != 0), how, key=key, text=text, lang=lang), key=key, text=text)
