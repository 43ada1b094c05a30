"""Byte-level BPE by corpus-level merge replay.

A batch of documents is reduced to its distinct pre-tokens ("words").  All words lie in one symbol array; an inverted
index maps each mergeable pair (named by the id of the token that it makes) to the positions where it occurs.  Pairs
are replayed in rank order; a merge touches the two neighbours of the merged pair and nothing else.  Documents are then
written as the concatenation of their words' ids.  Words are independent of each other, so batches can be replayed
anywhere and in any order: there is no shuffle, memory is bounded by a batch plus a cache of fixed size, and a lost
executor repeats its own batches only.

Defined cases: null text counts as empty; an empty text has no tokens; repeated rows give repeated results; an empty
table gives an empty result; only the id column and the text column are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import tidy

_UNSAFE = re.compile(r" (?:\s|\Z)").search
#: Entries of the per-worker cache of words, dropped as a whole when full.
CACHE_WORDS = 200_000
NO_PAIR = np.iinfo(np.int64).max


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 token and rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def _grouped(joined: dict[tuple[int, int], int], side: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each id on that side of a pair, the sorted ids of the other side and the ids of the joined tokens."""
    rows = np.array([(pair[side], pair[1 - side], r) for pair, r in joined.items()])
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.diff(rows[:, 0], prepend=-1)).tolist()
    return {int(rows[a, 0]): (rows[a:b, 1], rows[a:b, 2]) for a, b in pairwise([*first, len(rows)])}


class MergeReplay:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.token = {v: k for k, v in ranks.items()}
        self.text_of = {v: str(v) for v in self.token}
        #: (left id, right id) -> id of the joined token, for every split of every token.
        joined = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte_pair = np.array([[joined.get((a, b), NO_PAIR) for b in self.byte_id.tolist()] for a in self.byte_id.tolist()])
        self.by_left, self.by_right = _grouped(joined, 0), _grouped(joined, 1)
        self.ids: dict[str, tuple[int, ...]] = {}  # word -> ids
        self.spaced: dict[str, tuple[int, ...]] = {}  # text after a space, up to the next -> ids, the space included

    def replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word after all merges, applied across all words in rank order.

        ``sym`` holds the symbols of all words, ``after`` and ``before`` link live neighbours, ``rank`` the rank of the
        pair that starts at a place, and ``index`` the places of each pair that may be live.
        """
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths)
        starts = ends - lengths
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_id[raw]
        size = len(sym)
        after = np.arange(1, size + 1)
        before = np.arange(-1, size - 1)
        after[ends[lengths > 0] - 1] = -1
        before[starts[lengths > 0]] = -1
        rank = np.full(size + 1, NO_PAIR)
        if size > 1:
            inner = np.flatnonzero(after >= 0)
            rank[inner] = self.byte_pair[raw[inner], raw[inner + 1]]
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(places: np.ndarray) -> None:
            """Enter places under their present ranks."""
            found = rank[places]
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            for lo, hi in pairwise([0, *cuts.tolist(), len(found)]):
                if hi > lo and (r := int(found[lo])) != NO_PAIR:
                    if r not in index:
                        index[r] = []
                        heapq.heappush(heap, r)
                    index[r].append(places[lo:hi])

        note(np.flatnonzero(rank[:size] != NO_PAIR))
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            at = np.concatenate(index.pop(r))
            at = np.sort(at[rank[at] == r])
            if not len(at):
                continue
            at = at[np.diff(at, prepend=-1) > 0]
            # Where pairs overlap, as in "aaaa", every other one of the run is merged, from the left.
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            if chained.any():
                head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            gone = after[at]
            then = after[gone]
            sym[at], rank[gone], after[at] = r, NO_PAIR, then
            sym[gone] = -1
            linked = then >= 0
            before[then[linked]] = at[linked]
            rank[at] = np.where(linked, self._with_left(r, sym[then]), NO_PAIR)
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._with_right(r, sym[left])
            touched = np.concatenate([at, left])
            if (early := touched[rank[touched] < r]).size:
                # A merge uncovered a pair of lower rank, which goes before others of this rank in its word.
                for w in np.unique(np.searchsorted(ends, early, side="right")).tolist():
                    odd.add(w)
                    rank[starts[w] : ends[w]] = NO_PAIR
            note(touched)
        live = sym >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        ids, bounds = sym[live].tolist(), counts[np.concatenate([starts, [size]])].tolist()
        out = [tuple(ids[a:b]) for a, b in pairwise(bounds)]
        for w in odd:
            out[w] = self._alone(words[w])
        return out

    def _with_left(self, left: int, right: np.ndarray) -> np.ndarray:
        return self._look_up(self.by_left, left, right)

    def _with_right(self, right: int, left: np.ndarray) -> np.ndarray:
        return self._look_up(self.by_right, right, left)

    @staticmethod
    def _look_up(table: dict[int, tuple[np.ndarray, np.ndarray]], one: int, others: np.ndarray) -> np.ndarray:
        if one not in table:
            return np.full(len(others), NO_PAIR)
        partners, joined = table[one]
        at = np.minimum(np.searchsorted(partners, others), len(partners) - 1)
        return np.where(partners[at] == others, joined[at], NO_PAIR)

    def _alone(self, word: bytes) -> tuple[int, ...]:
        """One word, its lowest pair first each time: for words in which merges uncover lower pairs."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        pair = lambda a, b: int(self._with_left(a, np.array([b]))[0])
        while len(ids) > 1:
            r, i = min((pair(*p), i) for i, p in enumerate(pairwise(ids)))
            if r == NO_PAIR:
                break
            ids[i : i + 2] = [r]
        return tuple(ids)

    def _learn(self, units: Iterable[str]) -> None:
        """Enter texts that begin with a space and hold no other place where texts are cut: most are one word."""
        whole, mixed = [], []
        for u in units:
            (whole if u.isalpha() else mixed).append(u)
        self.spaced.update(zip(whole, self._ids([" " + u for u in whole]), strict=True))
        pieces = [self.split(" " + u) for u in mixed]
        self._learn_words(set(chain.from_iterable(pieces)))
        for u, found in zip(mixed, pieces, strict=True):
            self.spaced[u] = self.ids[found[0]] if len(found) == 1 else tuple(chain.from_iterable(map(self.ids.__getitem__, found)))

    def _learn_words(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        self.ids.update(zip(fresh, self._ids(fresh), strict=True))

    def _ids(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of distinct words; a word that is a token needs no merges."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        known = list(map(self.ranks.get, raw))
        rest = iter(self.replay([b for b, r in zip(raw, known, strict=True) if r is None]))
        return [next(rest) if r is None else (r,) for r in known]

    def forget(self) -> None:
        self.spaced.clear()
        self.ids.clear()

    @staticmethod
    def units(text: str) -> tuple[str, list[str]]:
        """Cut before each space that a character other than white space follows: matches never cross such a cut."""
        first, *rest = text.split(" ")
        if _UNSAFE(text):
            out: list[str] = []
            for x in rest:
                if x and not x[0].isspace():
                    out.append(x)
                elif out:
                    out[-1] += " " + x
                else:
                    first += " " + x
            rest = out
        return first, rest

    def encode_batch(self, texts: list[str | None], cache_words: int = CACHE_WORDS) -> Iterator[list[int]]:
        """Ids of each text, in order; words of earlier calls are forgotten once they are more than ``cache_words``."""
        cut = [self.units(t or "") for t in texts]
        if len(self.spaced) + len(self.ids) > cache_words:
            self.forget()
        self._learn(set().union(*(rest for _, rest in cut)).difference(self.spaced))
        firsts = {first: self.split(first) for first, _ in cut}
        self._learn_words(set(chain.from_iterable(firsts.values())))
        for first, rest in cut:
            ids = list(chain.from_iterable(map(self.ids.__getitem__, firsts[first])))
            ids += chain.from_iterable(map(self.spaced.__getitem__, rest))
            yield ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple, MergeReplay] = {}


def _coder(data: bytes, pattern: str) -> MergeReplay:
    """One coder for each vocabulary and Python worker."""
    key = (hash(data), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = MergeReplay(parse_ranks(data), pattern)
    return _LOADED[key]


#: Bytes of text that are replayed together, about: more is quicker, less takes less memory (some 40 bytes for each).
SLICE_BYTES = 8_000_000


def _slices(texts: pa.Array, slice_bytes: int) -> Iterator[list[str | None]]:
    """Consecutive texts of about ``slice_bytes``; only one slice at a time is turned into Python strings."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        done = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, done + slice_bytes, side="right")))
        yield texts.slice(at, stop - at).to_pylist()
        at = stop


def encode(docs: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",), slice_bytes: int = SLICE_BYTES, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Encode each text; one row for each input row.

    ``outputs`` picks among ``ids`` (array of int), ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas),
    ``decoded`` (binary: the ids decoded again) and ``decoded_sha256``.  ``vocabulary`` is the content of a rank file;
    it is broadcast, and its size does not depend on the data.
    """
    kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.binary(), "decoded_sha256": pa.string()}
    sql = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = narrow.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        gc.disable()  # the caches hold millions of small tuples and no cycles
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1), slice_bytes):
                made: dict[str, list] = {k: [] for k in outputs}
                for ids in coder.encode_batch(part, cache_words):
                    plain = coder.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                    for k, out in made.items():
                        if k == "ids":
                            out.append(ids)
                        elif k == "n_tokens":
                            out.append(len(ids))
                        elif k == "ids_sha256":
                            out.append(hashlib.sha256(",".join(map(coder.text_of.__getitem__, ids)).encode()).hexdigest())
                        elif k == "decoded":
                            out.append(plain)
                        else:
                            out.append(hashlib.sha256(plain).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *(pa.array(made[k], kinds[k]) for k in outputs)], names=["id", *outputs])
                at += len(part)
        coder.forget()

    schema = ", ".join([f"id {id_type}", *(f"{k} {sql[k]}" for k in outputs)])
    return narrow.mapInArrow(tidy(run), schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, vocabulary: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids to ``decoded`` (binary); null arrays give empty bytes."""
    shared = tokens.sparkSession.sparkContext.broadcast(vocabulary)
    narrow = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            plain = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], names=["id", "decoded"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, decoded binary").withColumnRenamed("id", id_col)
