"""Packing by lexical retrieval: each shard of documents has an inverted index with BM25 weights; a window is begun by a seed document
and filled with its best unused neighbours; a document that does not fit is cut, and its rest is the seed of the next window.

The number of documents, their mean length and the document frequencies are counted over all documents; frequencies in SLOTS slots of
word hashes, so that what is broadcast has one size whatever the input. Documents are dealt by their smallest hash of five words, so
that copies and near copies meet; rebalancing splits what a hot hash would gather, and a task cuts its rows into shards of about
shard_bytes, so memory is bounded whatever the input. Neighbours are looked for in the seed's own shard. Each id lies in exactly one
piece. All windows are full but the last of a shard, which is cut into sequences whose lengths are powers of two, so nothing is padded.

Defined results: a null or empty text gives the end id alone; repeated rows are packed one by one; neighbours of equal weight follow in
the order of the shard (smallest hash, doc_id, text); a text longer than a shard is a shard with what came before it; an empty table
gives an empty result; other columns are ignored; a null doc_id stays null.
"""

from __future__ import annotations

import functools
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_classifier import _slices
from .text import Texts, whole_windows, windows

WINDOW = 4096
END = 2
SHARD_BYTES = 8 << 20
#: What a worker remembers of words and their ids, in bytes.
MEMO_BYTES = 40 << 20
#: Slots of word hashes that document frequencies are counted in.
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Stands between words that are encoded at once, so many in a text.
MARK, AT_ONCE = b"\x01", 256
K1, B = 1.2, 0.75
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Tokens:
    """Ids of single words: the vocabulary's rules never join what white space parts.

    New words are encoded a few hundred at a time, with a control character as a word of its own behind each. Its id comes from nothing
    else, so the ids between two of them are those of one word; words that hold the character are encoded singly, and so are all where it
    has no id of its own. What was encoded is remembered by the word's hash, in arrays of MEMO_BYTES at most; what was used last stays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self._encoded([MARK.decode()])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used, self.ids, self.now = np.zeros(0, np.int32), np.zeros(0, "<u4"), 0

    def _encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of words without the mark, in a row, and how many each has; None if they can't be told apart."""
        behind, ids, sizes = b" " + MARK + b" ", [], []
        for i in range(0, len(words), AT_ONCE):
            part = words[i : i + AT_ONCE]
            found = np.array(self._encoded([(behind.join(part) + behind).decode()])[0], "<u4")
            ends = np.flatnonzero(found == self.mark)
            if len(ends) != len(part):
                return None
            ids.append(found[found != self.mark])
            sizes.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._together(words) if self.mark is not None and not any(MARK in w for w in words) else None
        if found is not None:
            return found
        single = [x for i in range(0, len(words), AT_ONCE) for x in self._encoded([w.decode() for w in words[i : i + AT_ONCE]])]
        sizes = np.array([len(x) for x in single], np.int64)
        return np.fromiter((i for x in single for i in x), "<u4", int(sizes.sum())), sizes

    def of(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted distinct hashes of words: all remembered ids, and where each word's begin and how many they are. word: the bytes of
        the word at a place of `hashes`."""
        self.now += 1
        if self.ids.nbytes + 28 * len(self.hashes) > MEMO_BYTES:
            self._forget()
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        todo = np.flatnonzero(~known)
        if len(todo):
            words = [word(i) for i in todo.tolist()]
            own = np.array([MARK in w for w in words])
            parts = [(todo[x], *self._new([words[i] for i in np.flatnonzero(x).tolist()])) for x in (~own, own) if x.any()]
            which, new, sizes = (np.concatenate([p[k] for p in parts]) for k in range(3))
            begins = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, new])
            order = np.argsort(which, kind="stable")
            which, begins, sizes = which[order], begins[order], sizes[order]
            self.begins, self.sizes = np.insert(self.begins, at[which], begins), np.insert(self.sizes, at[which], sizes)
            self.used, self.hashes = np.insert(self.used, at[which], self.now), np.insert(self.hashes, at[which], hashes[which])
            at = np.searchsorted(self.hashes, hashes)
        self.used[at] = self.now
        return self.ids, self.begins[at], self.sizes[at]

    def _forget(self) -> None:
        """Keeps the half that was used last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: len(self.used) // 2])
        keep = keep[np.cumsum(self.sizes[keep]) * 4 <= MEMO_BYTES // 2]
        self.hashes, self.used, sizes = self.hashes[keep], self.used[keep], self.sizes[keep]
        ends = np.cumsum(sizes)
        place = np.repeat(self.begins[keep] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))
        self.ids, self.begins, self.sizes = self.ids[place], ends - sizes, sizes


@functools.cache
def _tokens(path: str) -> _Tokens:
    return _Tokens(path)


class Corpus:
    """What BM25 knows of all documents: the weight of each slot of words, and the mean length."""

    def __init__(self, slots: np.ndarray, counts: np.ndarray, documents: int, words: int):
        df = np.zeros(SLOTS)
        df[slots] = counts
        self.idf = np.log((documents - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = words / max(1, documents)


def frequencies(docs: DataFrame) -> Corpus:
    """Counted over all documents; SLOTS + 2 rows at most come to the driver."""

    def work(batches):
        df, documents, words = np.zeros(SLOTS, np.int64), 0, 0
        for batch in batches:
            for part in _slices(batch):
                t = Texts(part.column("text"))
                key = np.sort((t.doc << SLOT_BITS) | (t.words() >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
                df += np.bincount(key[np.diff(key, prepend=-1) > 0] & (SLOTS - 1), minlength=SLOTS)
                documents, words = documents + t.n, words + len(t.doc)
        slot = np.flatnonzero(df)
        rows = [np.append(slot, [SLOTS, SLOTS + 1]).astype(np.int32), np.append(df[slot], [documents, words])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["slot", "n"])

    found = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(work, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = found.column("slot").to_numpy(), found.column("n").to_numpy()
    own = slot < SLOTS
    return Corpus(slot[own], n[own], int(n[slot == SLOTS].sum()), int(n[slot == SLOTS + 1].sum()))


class Shard:
    """The documents of a shard: their ids in a row, and an inverted index over their words."""

    def __init__(self, texts: pa.Array, path: str, corpus: Corpus):
        t = Texts(texts)
        self.n = t.n
        vocabulary, first, term = np.unique(t.words(), return_index=True, return_inverse=True)
        data, starts, ends = t.data, t.start[first], t.end[first]
        tokens, begins, sizes = _tokens(path).of(vocabulary, lambda i: data[starts[i] : ends[i]].tobytes())
        length = sizes[term]
        ends_at = np.cumsum(length)
        of_doc = np.diff(np.concatenate([[0], ends_at])[t.word_bounds]) if t.n else np.zeros(0, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(of_doc + 1)])
        ids = np.full(int(self.bounds[-1]), END, "<u4")
        keep = np.ones(len(ids), bool)
        keep[self.bounds[1:] - 1] = False
        ids[keep] = tokens[np.repeat(begins[term] - (ends_at - length), length) + np.arange(int(length.sum()))]
        self.ids = ids
        self._index(t, term, corpus.idf[(vocabulary >> np.uint64(64 - SLOT_BITS)).astype(np.int64)], corpus.mean)

    def _index(self, t: Texts, term: np.ndarray, idf: np.ndarray, mean: float) -> None:
        """Postings by term and by document, each with its BM25 weight; words in half of all documents or more weigh nothing, and those
        that one document of the shard holds lead nowhere."""
        terms = len(idf)
        pair = np.sort(t.doc * max(1, terms) + term)
        at = np.flatnonzero(np.diff(pair, prepend=-1) > 0)
        doc, term, count = pair[at] // max(1, terms), pair[at] % max(1, terms), np.diff(np.append(at, len(pair)))
        useful = (idf > 0)[term] & (np.bincount(term, minlength=terms) > 1)[term]
        doc, term, count = doc[useful], term[useful], count[useful]
        norm = K1 * (1 - B + B * np.diff(t.word_bounds) / max(1.0, mean))
        weight = (idf[term] * count * (K1 + 1) / (count + norm[doc])).astype(np.float32)
        self.doc_terms, self.doc_bounds = term.astype(np.int32), np.searchsorted(doc, np.arange(self.n + 1))
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order].astype(np.int32), weight[order]
        self.term_bounds = np.searchsorted(term[order], np.arange(terms + 1))

    def neighbours(self, seed: int, used: np.ndarray):
        """The unused documents that share a word with the seed, best first; ties by place."""
        terms = self.doc_terms[self.doc_bounds[seed] : self.doc_bounds[seed + 1]]
        a, size = self.term_bounds[terms], self.term_bounds[terms + 1] - self.term_bounds[terms]
        at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        score = np.bincount(self.post_doc[at], self.post_weight[at], minlength=self.n)
        score[used] = 0
        found = np.flatnonzero(score > 0)
        while len(found):  # a few at a time: a window seldom takes more
            best = found if len(found) <= 24 else found[np.argpartition(-score[found], 23)[:24]]
            least = score[best].min()
            best = found[score[found] >= least]
            yield from best[np.lexsort((best, -score[best]))].tolist()
            found = found[score[found] < least]

    def sequences(self):
        """Sequences, each a list of pieces (document, start, length)."""
        used, size = np.zeros(self.n, bool), np.diff(self.bounds).tolist()
        window, room, following, rest = [], WINDOW, iter(()), 0
        while True:
            d = next((x for x in following if not used[x]), None)
            if d is None:
                while rest < self.n and used[rest]:
                    rest += 1
                if rest == self.n:
                    break
                d = rest
                following = self.neighbours(d, used)
            used[d] = True
            start, left = 0, size[d]
            while left:
                take = min(left, room)
                window.append((d, start, take))
                start, left, room = start + take, left - take, room - take
                if not room:
                    yield window
                    window, room = [], WINDOW
                    following = self.neighbours(d, used) if left < WINDOW else following
        total = WINDOW - room
        while total:  # powers of two, the largest first
            part, want = [], 1 << (total.bit_length() - 1)
            total -= want
            while want:
                d, start, length = window[0]
                take = min(length, want)
                part.append((d, start, take))
                window[0] = (d, start + take, length - take)
                if take == length:
                    window.pop(0)
                want -= take
            yield part


def _packed(batches: list[pa.RecordBatch], path: str, corpus: Corpus, first: int):
    table = pa.Table.from_batches(batches)
    doc_id = table.column("doc_id").combine_chunks()
    shard = Shard(table.column("text"), path, corpus)
    rows, raw, n = [], memoryview(shard.ids.tobytes()), first
    for sequence in shard.sequences():
        offset = 0
        for d, start, length in sequence:
            a = int(shard.bounds[d]) + start
            rows.append((d, start, length, zlib.crc32(raw[4 * a : 4 * (a + length)]), int(shard.bounds[d + 1] - shard.bounds[d]), n, offset))
            offset += length
        n += 1
    columns = np.array(rows, np.int64).reshape(-1, 7).T
    arrays = [doc_id.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])]
    return pa.RecordBatch.from_arrays(arrays, SCHEMA.replace(" long", "").split(", ")), n


def pack(docs: DataFrame, path: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per piece; path: the vocabulary, on each worker."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    corpus = docs.sparkSession.sparkContext.broadcast(frequencies(docs))

    def sign(batches):
        for batch in batches:
            for part in _slices(batch):
                t = Texts(part.column("text"))
                key = np.zeros(t.n, np.int64)
                hashes = t.words()
                whole = np.flatnonzero(whole_windows(t.doc, 5))
                if len(whole):
                    first = np.searchsorted(t.doc[whole], np.arange(t.n))
                    some = np.searchsorted(t.doc[whole], np.arange(t.n), "right") > first
                    key[some] = (np.minimum.reduceat(windows(hashes, 5)[whole], first[some]) >> np.uint64(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(key)], ["doc_id", "text", "near"])

    dealt = rows.mapInArrow(sign, "doc_id long, text string, near long").hint("rebalance", "near").sortWithinPartitions("near", "doc_id", "text")

    def work(batches):
        n = TaskContext.get().partitionId() << 40
        held, size = [], 0
        for batch in batches:
            batch = batch.select(["doc_id", "text"])
            held.append(batch)
            size += batch.nbytes
            if size >= shard_bytes:
                out, n = _packed(held, path, corpus.value, n)
                yield out
                held, size = [], 0
        if held:
            yield _packed(held, path, corpus.value, n)[0]

    return dealt.mapInArrow(work, SCHEMA)


def op8_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
