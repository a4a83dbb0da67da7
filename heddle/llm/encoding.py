"""SentencePiece encoding and decoding with forward states shared between words of a common prefix.

Marked words (a word with the spaces before it, written as the piece mark) never share a piece, so each
distinct word of a batch is encoded once. The distinct words are sorted, which lays them out as the depth-first
walk of their trie: from one word to the next the forward states of the common prefix stay, those below are
dropped, and only the rest of the word is extended. The state of a prefix tells the piece in which its best
encoding ends and where that piece begins.

* ``unigram`` models: the state is the best sum of scores, as in Viterbi's algorithm.
* ``bpe`` models: the best encoding is the one that the merges give. A split is that encoding exactly if all its
  neighbouring pieces, merged afresh, come out as the two pieces again. So a prefix ends in the piece that passes
  with the end of the prefix before it; there is one. The pieces that end where a prefix ends are read off the
  state of a suffix automaton (goto and failure links over the vocabulary), longest first. Summing a BPE model's scores as Viterbi does would give
  other ids than the model's own, so scores are not summed there.

Words with more than one leading space, whose pieces have equal scores, are merged plainly. Characters outside of
the vocabulary become byte pieces.

Defined results: a null or empty text has no ids; repeated rows are encoded alike; a text that contains the piece
mark itself decodes to a space there, and ``round_trip`` is false; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The public vocabulary used where no other is named.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Distinct words that a worker remembers between batches, about 120 MB at most.
REMEMBERED = 250_000
#: Pairs of pieces that a worker remembers.
MOST_PAIRS = 300_000
#: What an unknown character costs below the least score, fixed by the format.
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A vocabulary read from a serialized model, with the encoder of words and the decoder of ids."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        proto = schema.ModelProto()
        proto.ParseFromString(model)
        if proto.normalizer_spec.precompiled_charsmap or not proto.normalizer_spec.escape_whitespaces or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with the identity normalisation are supported")
        self.kind = {1: "unigram", 2: "bpe"}[proto.trainer_spec.model_type]
        self.prefix = MARK if proto.normalizer_spec.add_dummy_prefix else ""
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.longest = max(map(len, self.id))
        self.text = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else b"" if p.type == CONTROL else p.piece.replace(MARK, " ").encode() for p in proto.pieces]
        self.piece = [p.piece for p in proto.pieces]
        self.least = min(self.score[i] for i in self.id.values()) - UNKNOWN_PENALTY
        breaks = any("\n" in p for p in self.id)
        self.words = re.compile(" *[^ ]+| +" if breaks else " *[^ \n]+| +|\n")
        self.trie: dict = {}
        if self.kind == "bpe":
            self._link_suffixes()
        else:
            for p, k in self.id.items():
                node = self.trie
                for ch in p:
                    node = node.setdefault(ch, {})
                node[""] = k
        self.seen: dict[str, bytes] = {}
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}

    def _link_suffixes(self) -> None:
        """The automaton of the vocabulary: by state its next states, its longest proper suffix, and the pieces (with their
        lengths) that end in it, longest first."""
        self.next: list[dict[str, int]] = [{}]
        own: list[tuple[int, int] | None] = [None]
        for p, k in self.id.items():
            at = 0
            for ch in p:
                to = self.next[at].get(ch)
                if to is None:
                    to = self.next[at][ch] = len(self.next)
                    self.next.append({})
                    own.append(None)
                at = to
            own[at] = (k, len(p))
        self.suffix = [0] * len(self.next)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(self.next)
        level = [0]
        while level:
            below = []
            for at in level:
                for ch, to in self.next[at].items():
                    self.suffix[to] = self._step(self.suffix[at], ch) if at else 0
                    rest = self.ending[self.suffix[to]]
                    self.ending[to] = (own[to], *rest) if own[to] else rest
                    below.append(to)
            level = below

    def _step(self, state: int, ch: str) -> int:
        while True:
            to = self.next[state].get(ch)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.suffix[state]

    def merged(self, word: str) -> list[str]:
        """The merges themselves: the best-scored neighbours become one, the leftmost first, until none can."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        open_pairs: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                k = self.id.get(both)
                if k is not None:
                    heappush(open_pairs, (-self.score[k], i, both))

        for i in range(len(parts) - 1):
            offer(i)
        while open_pairs:
            _, i, both = heappop(open_pairs)
            # A pair that one of its ends has left since is not there any more.
            if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != both:
                continue
            gone = after[i]
            parts[i], parts[gone], after[i] = both, None, after[gone]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def _pair_holds(self, a: int, b: int) -> bool:
        """Whether two pieces side by side stay apart, and the merges make the second at all."""
        at = a * len(self.piece) + b
        got = self.fits.get(at)
        if got is None:
            if len(self.fits) >= MOST_PAIRS:
                self.fits.clear()
            got = self.fits[at] = self._stands(b) and self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return got

    def _stands(self, k: int) -> bool:
        """Whether the merges ever make this piece of its own text."""
        got = self.whole.get(k)
        if got is None:
            got = self.whole[k] = self.merged(self.piece[k]) == [self.piece[k]]
        return got

    def _bytes_of(self, ch: str) -> tuple[int, ...]:
        return tuple(self.byte[b] for b in ch.encode("utf-8", "surrogatepass")) if self.byte else (self.unknown,)

    def _extend_merges(self, word: str, ends: list[int], begins: list[int], states: list[int]) -> None:
        """From the prefix that the lists cover to the whole word: the piece in which each prefix ends, where that begins, and the
        automaton's state."""
        state, width, fits, step, ending = states[-1], len(self.piece), self.fits, self.next, self.ending
        for end in range(len(states), len(word) + 1):
            ch = word[end - 1]
            to = step[state].get(ch)
            state = self._step(self.suffix[state], ch) if to is None else to
            piece, begin = -1, end - 1
            for k, long in ending[state]:
                last = ends[end - long]
                holds = self._stands(k) if last < 0 else fits.get(last * width + k)
                if holds is None:
                    holds = self._pair_holds(last, k)
                if holds:
                    piece, begin = k, end - long
                    break
            ends.append(piece)
            begins.append(begin)
            states.append(state)

    def _extend_scores(self, ch: str, end: int, open_now: list, sums: list[float]) -> tuple[int, int, list, float]:
        more, piece, begin, best = [], -1, end - 1, sums[end - 1] + self.least
        known = False
        for at, node in [*open_now, (end - 1, self.trie)]:
            node = node.get(ch)
            if node is None:
                continue
            more.append((at, node))
            k = node.get("")
            if k is not None and (sums[at] + self.score[k] > best or not known and at == end - 1):
                piece, begin, best, known = k, at, sums[at] + self.score[k], True
        return piece, begin, more, best

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct words, by one walk of their trie."""
        out: dict[str, tuple[int, ...]] = {}
        bpe = self.kind == "bpe"
        # By length of prefix: the piece that it ends in (-1: an unknown character), where that begins, the sum, open matches or state.
        ends, begins, sums, open_at = [-1], [0], [0.0], [0] if bpe else [[]]
        before = ""
        for raw in sorted(words):
            word = raw.replace(" ", MARK)
            if bpe and word.startswith(MARK * 2):
                out[raw] = tuple(chain.from_iterable((self.id[p],) if p in self.id else self._bytes_of(p) for p in self.merged(word)))
                continue
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            del ends[same + 1 :], begins[same + 1 :], sums[same + 1 :], open_at[same + 1 :]
            if bpe:
                self._extend_merges(word, ends, begins, open_at)
            for end in range(len(ends), len(word) + 1):
                piece, begin, more, best = self._extend_scores(word[end - 1], end, open_at[end - 1], sums)
                sums.append(best)
                ends.append(piece)
                begins.append(begin)
                open_at.append(more)
            before = word
            ids, end = [], len(word)
            while end:
                if ends[end] >= 0:
                    ids.append(ends[end])
                else:
                    ids.extend(reversed(self._bytes_of(word[end - 1])))
                end = begins[end]
            ids.reverse()
            out[raw] = tuple(ids)
        return out

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        plain = text.replace(MARK, " ") if MARK in text else text
        return self.words.findall(" " + plain if self.prefix else plain)

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; words are looked up among those remembered. When they grow too many, those of the texts at hand stay."""
        words = [self.split(t or "") for t in texts]
        here = set(chain.from_iterable(words))
        new = here.difference(self.seen)
        if len(self.seen) + len(new) > REMEMBERED:
            self.seen = {w: self.seen[w] for w in here.difference(new)}
        self.seen.update((w, array("i", ids).tobytes()) for w, ids in self.encode_words(list(new)).items())
        get = self.seen.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), np.intc) for w in words]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.text.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[int, Pieces] = {}


def _encoder(model: bytes, columns: list[str], text: str):
    at = hash(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _loaded.get(at) or _loaded.setdefault(at, Pieces(model))
        for whole in batches:
            for first in range(0, whole.num_rows, 1_000):
                batch = whole.slice(first, 1_000)
                texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
                ids = pieces.encode_all(texts)
                same = [pieces.decode(i) == (t or "") for i, t in zip(ids, texts, strict=True)]
                kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                n = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(np.concatenate(ids) if len(ids) else np.empty(0, np.int32), pa.int32()))
                new = [pa.array(n), lists, pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(kept + new, names=[*columns, "n_tokens", "token_ids", "round_trip"])

    return run


def encoded(docs: DataFrame, model_path: str = MODEL, *, text: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The columns in ``keep`` with ``n_tokens``, ``token_ids`` and ``round_trip`` (decoding gives the text again).

    The model is read where the query is planned and sent with the tasks; it is as large as its vocabulary.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    return rows.mapInArrow(_encoder(model, list(keep), "_text"), f"{kinds}, n_tokens bigint, token_ids array<int>, round_trip boolean")
