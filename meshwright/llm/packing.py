"""Packing token streams into fixed windows by order-preserving dynamic programming.

Documents are laid end to end in table order, each ended by one id. Windows hold at
most `size` ids and are cut where the total cost is least: one per id of padding,
and a penalty per cut by its place (nothing at a document's end, SENTENCE at a
sentence's end, INSIDE elsewhere). The cost of ending a window at cut j is

    cost(j) = penalty(j) + size - place(j) + min over i of (cost(i) + place(i)),
    place(j) - place(i) <= size,

a sliding-window minimum that a monotone queue keeps. Where two natural cuts lie
more than GRID ids apart, further cuts are offered in between. What remains at the end of a
task's run is cut into powers of two, which need no padding.

Runs are decided block by block (BLOCK ids), so memory is bounded; a text longer
than that spans blocks. Sequence ids are the partition's number times 2^32 plus a
running number. Defined cases: a null or empty text is its end id alone; repeated
rows are packed each; without rows there is no piece.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

SIZE = 4096
END_ID = 2
#: Penalties in ids of padding, and the spacing of cuts inside long sentences.
SENTENCE, INSIDE, GRID = 2, 24, 256
BLOCK = 1 << 20
#: Pieces that are kept with their ids, and pieces that are encoded at once.
CACHE, ENCODED = 200_000, 10_000

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters that the tokenizer's normal form leaves as they are.
_LATIN = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"


#: The byte-level alphabet: printable bytes stand for themselves, others for code points from 256.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Chunks:
    """Ids of what stands between spaces; the tokenizer never joins over these.

    A slice's distinct chunks are looked up once. A chunk of Latin letters with marks behind is
    two pre-tokens, its letters in lower case, one word for the tokenizer's model, and its
    marks. Other new pieces are encoded many at a time, joined by spaces, and told apart by their tokens'
    offsets. Known pieces are places in one pool of ids, of which numpy gathers a slice's.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.place = {"": 0}
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _keep(self, pieces: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        if not pieces:
            return
        first = len(self.start)
        self.place.update(zip(pieces, range(first, first + len(pieces))))
        begins = np.concatenate(([0], ends[:-1]))
        self.start = np.concatenate((self.start, begins + len(self.pool)))
        self.length = np.concatenate((self.length, ends - begins))
        self.pool = np.concatenate((self.pool, ids))

    def _learn(self, words: list[str], others: list[str]) -> None:
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w if w.isascii() else "".join([_LETTER_OF[b] for b in w.encode()]))] for w in words]
        self._keep(words, np.fromiter(chain.from_iterable(found), "<u4"), np.cumsum([len(f) for f in found], dtype=np.int64))
        for at in range(0, len(others), ENCODED):
            some = others[at : at + ENCODED]
            found = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            reach = np.cumsum([len(c) + 1 for c in some])
            self._keep(some, np.array(found.ids, "<u4"), np.searchsorted([b for b, _ in found.offsets], reach))

    def _places(self, words: pa.Array, others: pa.Array) -> None:
        """Learns what isn't known yet."""
        fresh = lambda column: [c for c in _strings(column.unique()) if c not in self.place]
        new, odd = fresh(words), fresh(others)
        if len(self.place) + len(new) + len(odd) > CACHE:
            self.clear()
            new, odd = fresh(words), fresh(others)
        self._learn(new, odd)

    def _find(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode()
        return np.array([self.place[c] for c in _strings(coded.dictionary)], np.int64)[coded.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's end."""
        rows = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = rows.flatten().dictionary_encode()
        chunks = coded.dictionary
        lettered = pc.match_substring_regex(pc.utf8_rtrim(chunks, _MARKS), f"^{_LATIN}$")
        marks = pc.if_else(lettered, pc.replace_substring_regex(chunks, f"^{_LATIN}", ""), "")
        heads = pc.if_else(lettered, pc.utf8_lower(pc.utf8_rtrim(chunks, _MARKS)), chunks)
        self._places(heads.filter(lettered), pa.concat_arrays([heads.filter(pc.invert(lettered)), marks]))
        pieces = np.stack((self._find(heads), self._find(marks)), 1)[coded.indices.to_numpy()].ravel()
        length = self.length[pieces]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[pieces] - ends + length, length) + np.arange(total)
        offsets = rows.offsets.to_numpy()
        bounds = np.concatenate(([0], ends))[2 * (offsets - offsets[0])]
        return self.pool[at], bounds[1:]


_KEPT: dict[str, Chunks] = {}  # a worker serves many tasks


def cut(places: np.ndarray, penalties: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Costs and predecessors of the least-cost windows ending at each place; places[0] begins."""
    at, extra = places.tolist(), penalties.tolist()
    back = [0] * len(at)
    queue = deque([0])
    values = [at[0]] + [0] * (len(at) - 1)  # cost + place
    for j in range(1, len(at)):
        floor = at[j] - size
        while at[queue[0]] < floor:
            queue.popleft()
        i = queue[0]
        back[j] = i
        values[j] = v = values[i] + extra[j] + size
        while queue and values[queue[-1]] >= v:
            queue.pop()
        queue.append(j)
    return (np.array(values) - places).tolist(), back


def powers(length: int) -> list[int]:
    """Powers of two that sum to `length`, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Takes documents' ids in order and gives pieces."""

    def __init__(self, size: int, enders: np.ndarray, first_id: int):
        self.size, self.enders, self.next_id = size, enders, first_id
        self.held: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, start, its length, ids
        self.count = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        for start in range(0, len(ids), BLOCK):
            part = ids[start : start + BLOCK]
            self.held.append((doc_id, start, len(ids), part))
            self.count += len(part)
            if self.count >= BLOCK:
                yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        """Pieces of all full windows; unless `last`, the ids after the final cut stay held."""
        if not self.held:
            return
        ids = np.concatenate([h[3] for h in self.held])
        ends = np.cumsum([len(h[3]) for h in self.held])
        natural = np.flatnonzero(np.isin(ids, self.enders)) + 1
        closing = ends[[h[1] + len(h[3]) == h[2] for h in self.held]]
        places = np.unique(np.concatenate(([0], np.arange(GRID, len(ids), GRID), natural, closing, [len(ids)])))
        penalties = np.full(len(places), INSIDE)
        penalties[np.isin(places, natural)] = SENTENCE
        penalties[np.isin(places, closing)] = 0
        cost, back = cut(places, penalties, self.size)
        j = len(places) - 1
        if len(ids) > self.size:  # the best end among those within a window of the last place
            near = int(np.searchsorted(places, len(ids) - self.size + 1))
            j = min(range(near, len(places)), key=lambda k: (cost[k], -k))
            cuts = [int(places[j])]
            while j:
                j = back[j]
                cuts.append(int(places[j]))
            cuts.reverse()
        else:
            cuts = [0]
        if last:
            for p in powers(len(ids) - cuts[-1]):
                cuts.append(cuts[-1] + p)
        yield from self.pieces(ids, ends, cuts)
        done, rest, begin = cuts[-1], [], 0
        for (doc_id, start, total, part), end in zip(self.held, ends.tolist()):
            if end > done:
                skip = max(0, done - begin)
                rest.append((doc_id, start + skip, total, part[skip:]))
            begin = end
        self.held, self.count = rest, len(ids) - done

    def pieces(self, ids: np.ndarray, ends: np.ndarray, cuts: list[int]) -> Iterator[tuple]:
        begins = np.concatenate(([0], ends[:-1]))
        for low, high in zip(cuts, cuts[1:]):
            k = int(np.searchsorted(ends, low, "right"))
            at = low
            while at < high:
                doc_id, start, total, _ = self.held[k]
                to = min(high, int(ends[k]))
                crc = zlib.crc32(ids[at:to].tobytes())
                yield doc_id, start + at - int(begins[k]), to - at, crc, total, self.next_id, at - low
                at, k = to, k + 1
            self.next_id += 1


def pack(docs: DataFrame, tokenizer_file: str, size: int = SIZE) -> DataFrame:
    """A row per piece of a document in a sequence."""

    def run(batches):
        from tokenizers import Tokenizer

        if tokenizer_file not in _KEPT:
            _KEPT[tokenizer_file] = Chunks(Tokenizer.from_file(tokenizer_file))
        chunks = _KEPT[tokenizer_file]
        tokenizer = chunks.tokenizer
        enders = np.array([tokenizer.token_to_id(t) for t in (".</w>", "!</w>", "?</w>") if tokenizer.token_to_id(t) is not None])
        packer = Packer(size, enders, TaskContext.get().partitionId() << 32)
        end = np.array([END_ID], "<u4")
        names = [c.split()[0] for c in _PIECES.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in tx.slices(batches, "text"):
            rows, begin = [], 0
            ids, bounds = chunks.ids(batch.column(1).cast(pa.string()))
            for doc_id, to in zip(batch.column(0).to_pylist(), bounds.tolist()):
                rows += packer.add(doc_id, np.concatenate((ids[begin:to], end)))
                begin = to
            if rows:
                yield batch_of(rows)
        if rows := list(packer.flush(True)):
            yield batch_of(rows)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of at most 4096 ids."""
    return pack(tx.documents(spark, sf_dir), tokenizer_path())
