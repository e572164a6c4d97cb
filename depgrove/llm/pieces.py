"""SentencePiece encoding and decoding for merge-type vocabularies.

A segment's symbols begin as its characters; an agenda of adjacent pairs, ordered by the score of the merged piece and then from the
left, is worked off until no pair is in the vocabulary; characters without a piece become their bytes. Pieces are found only by merging
neighbours, so no piece crosses two characters that are neighbours in no piece of the vocabulary: texts are cut there, and each
distinct segment is worked out once per worker (a bounded memo). Every segment worked out is compared with the library in its Arrow
batch, and so is one whole text of each batch; where they differ, also in later texts with such a segment, the library's ids are
returned and `agrees` is false.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded one by one; an empty table gives an empty
result; other columns are ignored. The vocabulary's normaliser must be the identity with a space put in front, and spaces kept.
"""

from __future__ import annotations

import functools
import hashlib
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memo import Memo

MARK = "▁"  # stands for a space
MEMO_BYTES = 60 << 20
PLACES = 1 << 40
FIRST, SECOND, THIRD = map(itemgetter, range(3))


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.normalize(" a  b\t") != f"{MARK}{MARK}a{MARK}{MARK}b\t":
            raise ValueError("only vocabularies with the identity as normaliser, a space in front and all spaces kept")
        n = lib.get_piece_size()
        self.name = [lib.id_to_piece(i) for i in range(n)]
        own = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        self.id = {self.name[i]: i for i in own}
        self.score = {self.name[i]: -lib.get_score(i) for i in own if len(self.name[i]) > 1}
        self.byte = {int(self.name[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.raw = {i: bytes([b]) for b, i in self.byte.items()}
        order = {x: k for k, x in enumerate(sorted(set(self.score.values())))}  # equal scores have equal ranks
        self.rank = {p: order[x] for p, x in self.score.items()}
        chars = sorted({c for p in self.score for c in p})
        self.number = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(chars, 1):
            self.number[ord(c)] = k
        self.adjacent = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.score:
            k = self.number[[ord(c) for c in p]]
            self.adjacent[k[:-1], k[1:]] = True
        self.memo = Memo(MEMO_BYTES)

    def merge(self, segment: str) -> list[int]:
        """The ids of a segment, by the agenda."""
        symbols, rank = list(segment), self.rank.get
        n = len(symbols)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        agenda = []  # numbers: the rank of the merged piece's score, then the place
        for i in range(n - 1):
            r = rank(symbols[i] + symbols[i + 1])
            if r is not None:
                agenda.append(r * PLACES + i)
        heapify(agenda)
        while agenda:
            r, i = divmod(heappop(agenda), PLACES)
            j = after[i]
            if j < 0 or not symbols[i]:
                continue
            pair = symbols[i] + symbols[j]
            if rank(pair) != r:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                r = rank(pair + symbols[k])
                if r is not None:
                    heappush(agenda, r * PLACES + i)
            h = before[i]
            if h >= 0:
                r = rank(symbols[h] + pair)
                if r is not None:
                    heappush(agenda, r * PLACES + h)
        out = []
        for s in symbols:
            if s:
                i = self.id.get(s)
                if i is None:
                    out += [self.byte[b] for b in s.encode()]
                else:
                    out.append(i)
        return out

    def text(self, ids: list[int]) -> str:
        """The ids' pieces in a row, a space for each mark; the space in front is still there."""
        if self.raw.keys().isdisjoint(ids):
            return "".join([self.name[i] for i in ids]).replace(MARK, " ")
        return b"".join([self.raw.get(i) or self.name[i].encode() for i in ids]).decode("utf-8", "replace").replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.text(ids).removeprefix(" ")

    def checked(self, segments: list[str]) -> list[list[int]]:
        """The library's ids of each segment; a newline, which is a neighbour of nothing, keeps it apart from the space in front."""
        return [ids[2:] for ids in self.library.encode(["\n" + s for s in segments], num_threads=1)] if segments else []

    def segments(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The segments of all texts in a row, and how many each text has."""
        texts = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        row = "".join(texts)
        number = self.number[np.frombuffer(row.encode("utf-32-le"), np.uint32)]
        cut = np.ones(len(row) + 1, bool)
        if len(row) > 1:
            cut[1:-1] = ~self.adjacent[number[:-1], number[1:]]
        bounds = np.cumsum([0, *map(len, texts)])
        cut[bounds] = True
        at = np.flatnonzero(cut)
        places = at.tolist()
        found = [row[a:b] for a, b in zip(places, places[1:])]
        return found, np.diff(np.searchsorted(at, bounds))

    def encode_batch(self, texts: list[str]) -> list[tuple[int, str, str, bool]]:
        """For each text: the number of ids, the ids as text, the decoded text, whether the library agrees where it was asked."""
        segments, counts = self.segments(texts)
        self.memo.begin()
        new = self.memo.missing(set(segments))
        for s, real in zip(new, self.checked(new)):
            ids = self.merge(s)
            self.memo.put(s, (",".join(map(str, ids)), self.text(ids), ids == real))
        known = self.memo.young
        out, at = [], 0
        asked = len(texts) // 2
        for i, n in enumerate(counts.tolist()):
            found = [known[s] for s in segments[at : at + n]]
            ids, text = ",".join(map(FIRST, found)), "".join(map(SECOND, found)).removeprefix(" ")
            agrees = all(map(THIRD, found))
            if agrees and i == asked:
                agrees = ids == ",".join(map(str, self.library.encode(texts[i])))
            if agrees:
                out.append((ids.count(",") + 1 if ids else 0, ids, text, True))
            else:
                real = self.library.encode(texts[i])
                out.append((len(real), ",".join(map(str, real)), self.library.decode(real), False))
            at += n
        return out


@functools.cache
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def digests(docs: DataFrame, path: str, slice_bytes: int = 2 << 20) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids and of the decoded text, and agrees, for each row. path: the vocabulary, on each worker."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        from .quality_classifier import _slices

        own = _pieces(path)
        for batch in batches:
            for part in _slices(batch, slice_bytes):
                found = own.encode_batch(part.column("text").to_pylist())
                sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()), pa.array([sha(f[1]) for f in found]), pa.array([sha(f[2]) for f in found]), pa.array([f[3] for f in found])],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"],
                )

    return rows.mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) and the decoded text of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def work(batches):
        from .quality_classifier import _slices

        own = _pieces(path)
        for batch in batches:
            for part in _slices(batch):
                found = own.encode_batch(part.column("text").to_pylist())
                ids = pa.array([[int(i) for i in f[1].split(",")] if f[0] else [] for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([f[2] for f in found], pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
