"""Packing documents into token sequences of at most `size` ids by order-preserving dynamic programming.

Each task packs the documents of its own partition in their order, so nothing is shuffled; at most one sequence per
partition is left part full. The ids lie end to end; windows are cut at document ends (free), sentence ends or, where
sentences are long, every GRID ids (penalties). The cost of a window is its padding to `size` (none if its length is a
power of two), a fixed cost for each sequence, and the penalty of its cut. The best earlier cut is the head of a
monotone queue over the cuts at most `size` ids back. The programme runs over FLUSH ids at a time and carries over the
ids after its best last cut.

Defined cases: null text is an empty document of the end id alone; a null doc_id is carried; repeated rows are packed
one by one; an empty table gives no pieces; other columns are left out.
"""

from __future__ import annotations

import functools
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import table

SIZE, END_ID = 4096, 2
FLUSH, GRID, LONG_GAP = 64 * 4096, 32, 48
SENTENCE_COST, HARD_COST, SEQUENCE_COST = 2, 8, 8
CACHE_WORDS, BATCH, BATCH_BYTES = 250_000, 2048, 1 << 25
MARKS = frozenset(bytes([c]) for c in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordIds:
    """Ids of texts, with a memory of words: ASCII blanks always end a token, so words can be encoded apart.

    Of a new word, a run of ASCII marks after its last letter is encoded apart as well (the tokenizer splits there), and
    words of letters only are encoded many at a time: each of them ends with a token that ends a word.
    """

    def __init__(self, path: str) -> None:
        import os
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        letter = rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])"
        self.letters = re.compile(letter + rb"+")
        self.marked = re.compile(rb"(.*?" + letter + rb")([!-&(-/:-@\[-`{-~]+)", re.DOTALL)
        self.final = np.zeros(self.tok.get_vocab_size(), bool)
        self.final[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True
        self.ends = [i for i in map(self.tok.token_to_id, (".</w>", "!</w>", "?</w>")) if i is not None]

    @staticmethod
    def delicate(raw: bytes) -> bool:
        """Whether letters' case or the place of marks may matter: special strings, combining marks."""
        return b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw

    def encode(self, words: list[bytes]) -> None:
        """Put words into the memory."""
        plain: list[bytes] = []
        other: list[bytes] = []
        whole = self.letters.fullmatch
        for w in words:
            (plain if whole(w) else other).append(w)
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.tok.encode(b" ".join(part).decode(), add_special_tokens=False).ids, "<u4")
            at = (np.flatnonzero(self.final[ids]) + 1) * 4
            raw, start = ids.tobytes(), 0
            for w, end in zip(part, at.tolist(), strict=True):
                self.known[w] = raw[start:end]
                start = end
        found = self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
        for w, e in zip(other, found, strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def learn(self, words: set[bytes]) -> None:
        known, marked = self.known, self.marked.fullmatch
        split = [(w, *m.groups()) for w in words if w[-1:] in MARKS and (m := marked(w)) and not self.delicate(w)]
        parts = words.difference([x[0] for x in split])
        parts.update([x[1] for x in split], [x[2] for x in split])
        self.encode(list(parts.difference(known)))
        for w, a, b in split:
            known[w] = known[a] + known[b]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, four bytes each. Words are numbered by Arrow, so only distinct ones are looked up."""
        texts = pc.fill_null(texts, "")
        special = pc.match_substring_regex(texts, "<\\||[\u0300-\u037f]")
        words = pc.ascii_split_whitespace(pc.if_else(special, texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        new = set(distinct).difference(self.known)
        self.learn(new)
        ids = list(map(self.known.__getitem__, distinct))
        if len(self.known) > CACHE_WORDS:  # what came first, and so is frequent, stays
            for w in new:
                del self.known[w]
        flat = np.frombuffer(b"".join(ids), "<u4")
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        at = coded.indices.to_numpy()
        own = sizes[at]
        upto = np.concatenate([[0], np.cumsum(own, dtype=np.int32)])
        shift = (np.cumsum(sizes, dtype=np.int32) - sizes)[at] - upto[:-1]
        out = flat[np.arange(upto[-1], dtype=np.int32) + np.repeat(shift, own)]
        ends = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        return [out[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One for all tasks of a Python worker."""
    return WordIds(path)


def cuts(ends: list[int], marks: np.ndarray, total: int) -> tuple[list[int], list[int]]:
    """Places where a window may end and their penalties, in order, from 0 to total."""
    cost = np.full(total + 1, -1, np.int16)
    cost[marks] = SENTENCE_COST
    cost[ends] = 0
    cost[0] = cost[total] = 0
    at = np.flatnonzero(cost >= 0)
    for i in np.flatnonzero(np.diff(at) > LONG_GAP):
        inner = np.arange(at[i] + GRID, at[i + 1], GRID)
        cost[inner] = HARD_COST
    at = np.flatnonzero(cost >= 0)
    return at.tolist(), cost[at].tolist()


def best_windows(at: list[int], cost: list[int], size: int, last: bool) -> list[int]:
    """Ends of the windows of least cost from the first place on.

    last: they end at the last place. Else they end within the last `size` ids, where the cost is least for the ids
    packed, so that no window is filled less for the chunk's end.
    """
    n = len(at)
    f, back = [0.0] * n, [0] * n
    full = full_windows(at, size)
    queue: deque[tuple[float, int, int]] = deque([(0.0, at[0], 0)])
    for j in range(1, n):
        p = at[j]
        while p - queue[0][1] > size:
            queue.popleft()
        value, _, i = queue[0]
        value += size - p
        for q in full.get(j, ()):
            if f[q] < value:
                value, i = f[q], q
        f[j], back[j] = value + cost[j] + SEQUENCE_COST, i
        mine = f[j] + p
        while queue and queue[-1][0] >= mine:
            queue.pop()
        queue.append((mine, p, j))
    out, j = [], n - 1
    if not last:
        per_id = (SEQUENCE_COST + HARD_COST) / size
        j = min((k for k in range(n - 1, 0, -1) if at[-1] - at[k] < size), key=lambda k: f[k] - at[k] * per_id)
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


def full_windows(at: list[int], size: int) -> dict[int, list[int]]:
    """For a place's number, the numbers of the places that lie a power of two below `size` before it."""
    places, found = np.array(at), {}
    for k in range((size - 1).bit_length()):
        wanted = places - 2**k
        i = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
        for j in np.flatnonzero(places[i] == wanted).tolist():
            found.setdefault(j, []).append(int(i[j]))
    return found


class Packer:
    """Takes documents in order; gives rows of SCHEMA."""

    def __init__(self, size: int, first_sequence: int, sentence_ids: list[int]) -> None:
        self.size, self.sequence, self.sentence_ids = size, first_sequence, np.array(sentence_ids, np.uint32)
        self.docs: deque[list] = deque()  # doc_id, ids, ids already packed
        self.held = 0

    def add(self, doc_id: int | None, ids: bytes) -> list[tuple]:
        self.docs.append([doc_id, ids, 0])
        self.held += len(ids) // 4
        return self.flush(False) if self.held >= FLUSH else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        ends, marks, at = [], [], 0
        for _, ids, done in self.docs:
            own = np.frombuffer(ids, "<u4")[done:]
            marks.append(np.flatnonzero(np.isin(own, self.sentence_ids)) + at + 1)
            at += len(own)
            ends.append(at)
        windows = best_windows(*cuts(ends, np.concatenate(marks), at), self.size, last)
        rows, begun = [], 0
        for end in windows:
            rows += self.emit(end - begun)
            begun = end
        return rows

    def emit(self, length: int) -> list[tuple]:
        rows, offset = [], 0
        while offset < length:
            doc_id, ids, done = self.docs[0]
            total = len(ids) // 4
            take = min(length - offset, total - done)
            rows.append((doc_id, done, take, zlib.crc32(memoryview(ids)[4 * done : 4 * (done + take)]), total, self.sequence, offset))
            offset += take
            self.docs[0][2] = done + take
            if done + take == total:
                self.docs.popleft()
        self.sequence += 1
        self.held -= length
        return rows


def batches_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """start and number of rows that hold at most BATCH rows and, single rows aside, BATCH_BYTES bytes."""
    ends, k = np.cumsum(sizes, dtype=np.int64), 0
    while k < len(sizes):
        begun = ends[k] - sizes[k]
        n = max(1, min(BATCH, int(np.searchsorted(ends, begun + BATCH_BYTES, "right")) - k))
        yield k, n
        k += n


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Rows of SCHEMA, one per piece. tokenizer: path of its file, which every executor has."""
    names = [x.split(" ")[0] for x in SCHEMA.split(", ")]
    schema = pa.schema([(x, pa.int64()) for x in names])
    end = np.array([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() << 32, encode.ends)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for k, n in batches_of(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                for doc_id, x in zip(ids[k : k + n], encode(texts.slice(k, n)), strict=True):
                    rows += packer.add(doc_id, x + end)
                yield out()
                rows = []
        rows = packer.flush(True)
        yield out()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(packed, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
