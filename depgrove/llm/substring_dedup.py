"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is every window of 20 words at the place where the corpus has it first: each window once, and where such places follow
each other, one passage. Reference blocks are indexed in two steps. A window has as its anchor the smallest hash among its runs of eight
words, so equal windows have equal anchors; blocks exchange their distinct anchors, and only windows whose anchor occurs again go on.
Those are exchanged by their own hashes (96 bits), in ranges, and each is answered with its place in the reference, in whichever block
that lies. Then each document is parsed: at a word where the reference has an earlier window, the factor is the longest match from there
(there is one at most, as each window is in the reference once), and the parse goes on behind it; at any other word it goes on with the
next one. Factors do not overlap. A repeated window that begins within a factor and ends behind it is looked up at that boundary; what is
found there is kept apart as crossing spans. Each repeated window lies within a factor or crosses the end of one, so the words of both
are the words to remove.

Defined results: a null text has no words; a text of fewer than 20 words keeps all; of equal windows the one in the smallest doc_id,
then at the earliest word, stays; rows with the same doc_id count as one document at the same places, so they do not remove each
other; a null doc_id comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import exchange
from .common import in_blocks
from .text import Texts, whole_windows, windows

WORDS = 20
RUN = 8
BLOCK_BYTES = 4 << 20
NO_ID = -(2**63)


def _smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n successive values."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


class _Block:
    """The windows of a block's documents: which lie in one document, and their anchors."""

    def __init__(self, table: pa.Table, words: int):
        self.t = t = Texts(table.column("text"))
        self.words = words
        self.ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
        self.hashes = t.words()
        self.at = np.flatnonzero(whole_windows(t.doc, words))
        run = min(RUN, words)
        runs = windows(self.hashes, run, 1)
        self.anchors = _smallest(runs, words - run + 1)[self.at]
        self.keys = np.unique(self.anchors)
        inside = np.sort(runs[whole_windows(t.doc, run)])
        self.again = inside[1:][inside[1:] == inside[:-1]]

    def chosen(self, elsewhere: np.ndarray) -> None:
        """Goes on with the windows whose anchor occurs in another block, or again in this one."""
        keep = elsewhere.astype(bool)
        if len(self.again):
            keep = keep | (self.again[np.minimum(np.searchsorted(self.again, self.keys), len(self.again) - 1)] == self.keys)
        at = self.at[keep[np.searchsorted(self.keys, self.anchors)]] if len(self.keys) else self.at
        key, check = windows(self.hashes, self.words, 2)[at], (windows(self.hashes, self.words, 3)[at] >> np.uint64(32)).astype(np.uint32)
        doc = self.ids[self.t.doc[at]]
        place = at - self.t.word_bounds[self.t.doc[at]]
        order = np.lexsort((place, doc, check, key))
        self.at, self.key, self.check, self.doc, self.place = at[order], key[order], check[order], doc[order], place[order]
        first = np.ones(len(order), bool)
        first[1:] = (self.key[1:] != self.key[:-1]) | (self.check[1:] != self.check[:-1])
        self.first, self.group = np.flatnonzero(first), np.cumsum(first) - 1


def _ask_anchors(n: int, words: int):
    def ask(table: pa.Table) -> pa.Table:
        own, block = _Block(table, words), table.column("block")[0].as_py()
        found = [[r, block, own.keys[a:b].tobytes()] for r, a, b in exchange.ranges(own.keys, n)]
        return exchange.rows(found, ["range", "block", "keys"], [pa.int32(), pa.int32(), pa.binary()])

    return ask


def _answer_anchors(table: pa.Table) -> pa.Table:
    keys, sizes = exchange.joined(table.column("keys"), np.uint64)
    found = np.sort(keys)
    again = found[1:][found[1:] == found[:-1]]
    hit = again[np.minimum(np.searchsorted(again, keys), len(again) - 1)] == keys if len(again) else np.zeros(len(keys), bool)
    answers = [x.astype(np.uint8).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("range"), table.column("block"), pa.array(answers, pa.binary())], ["range", "block", "answer"])


def _ask_windows(n: int, words: int):
    def ask(table: pa.Table, answers: pa.Table) -> pa.Table:
        names, types = ["range", "block", "keys", "checks", "docs", "places"], [pa.int32(), pa.int32()] + [pa.binary()] * 4
        if not table.num_rows:
            return exchange.rows([], names, types)
        own, block = _Block(table, words), table.column("block")[0].as_py()
        own.chosen(exchange.in_order(answers, np.uint8))
        f = own.first
        sent = [own.key[f], own.check[f], own.doc[f], own.place[f].astype(np.uint32)]
        return exchange.rows([[r, block, *(x[a:b].tobytes() for x in sent)] for r, a, b in exchange.ranges(sent[0], n)], names, types)

    return ask


def _answer_windows(table: pa.Table) -> pa.Table:
    """For each window: whether another block has an earlier one, and the first one's place."""
    (key, sizes), (check, _), (doc, _), (place, _) = (
        exchange.joined(table.column(c), d) for c, d in (("keys", np.uint64), ("checks", np.uint32), ("docs", np.int64), ("places", np.uint32))
    )
    order = np.lexsort((place, doc, check, key))
    k, c = key[order], check[order]
    first = np.ones(len(order), bool)
    first[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    source = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    of = np.empty(len(order), np.int64)
    of[order] = source
    later = (doc[of] != doc) | (place[of] != place)
    out = np.zeros(len(order), [("later", np.uint8), ("doc", np.int64), ("place", np.uint32)])
    out["later"], out["doc"], out["place"] = later, np.where(later, doc[of], 0), np.where(later, place[of], 0)
    answers = [x.tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
    return pa.table([table.column("range"), table.column("block"), pa.array(answers, pa.binary())], ["range", "block", "answer"])


def _parse(own: _Block, answers: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """The factors and the spans that cross their ends, each as: text, first word in the text, words, source document, source word."""
    f = own.first
    here = answers["later"] == 0
    doc = np.where(here, own.doc[f], answers["doc"])[own.group]
    place = np.where(here, own.place[f], answers["place"].astype(np.int64))[own.group]
    later = (doc != own.doc) | (place != own.place)
    order = np.argsort(own.at[later])
    at, doc, place = own.at[later][order], doc[later][order], place[later][order]
    n, text = len(at), own.t.doc[at]
    goes_on = np.zeros(n + 1, bool)  # a window that follows the one before it in the text and in the reference
    goes_on[1:n] = (text[1:] == text[:-1]) & (np.diff(at) == 1) & (doc[1:] == doc[:-1]) & (np.diff(place) == 1)
    ends = np.flatnonzero(~goes_on[1:])
    last = ends[np.searchsorted(ends, np.arange(n))]
    behind = np.searchsorted(at, at[last] + own.words).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = behind[i]
    starts = np.array(starts, np.int64)
    within = np.zeros(n + 1, np.int64)
    within[starts] += 1
    within[last[starts] + 1] -= 1
    crossing = np.flatnonzero(np.cumsum(within[:-1]) == 0)
    heads = np.ones(len(crossing), bool)
    heads[1:] = (np.diff(crossing) != 1) | ~goes_on[crossing[1:]]
    cut = np.append(np.flatnonzero(heads), len(crossing))

    def spans(first: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, ...]:
        return text[first], at[first] - own.t.word_bounds[text[first]], at[final] - at[first] + own.words, doc[first], place[first]

    return spans(starts, last[starts]), spans(crossing[cut[:-1]], crossing[cut[1:] - 1])


def _listed(spans: tuple[np.ndarray, ...], n: int) -> pa.Array:
    """Each text's spans as an array."""
    text, *values = spans
    cuts = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    of = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in values], ["start", "length", "source_doc", "source_start"])
    return pa.ListArray.from_arrays(pa.array(cuts), of)


def _kept(t: Texts, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    step, data = np.zeros(len(t.data) + 1, np.int8), t.data.copy()
    start, end, doc = t.start[keep], t.end[keep], t.doc[keep]
    if len(start):
        follows = np.append(doc[1:] == doc[:-1], False)  # another kept word of the text: a space in between
        data[end[follows]] = 32
        np.add.at(step, start, 1)
        np.add.at(step, end + follows, -1)
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    bounds = np.concatenate([[0], np.cumsum(t.count(inside))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(t.n, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data[inside].tobytes()))


def _remove(words: int, with_factors: bool, carried: str | None):
    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            table = table.slice(0, 0)
        own = _Block(table, words)
        own.chosen(exchange.in_order(answers.filter(pc.equal(answers.column("step"), 1)), np.uint8))
        found = exchange.in_order(answers.filter(pc.equal(answers.column("step"), 2)), [("later", np.uint8), ("doc", np.int64), ("place", np.uint32)])
        parsed = _parse(own, found)
        step = np.zeros(len(own.t.start) + 1, np.int64)
        for text, start, length, _, _ in parsed:
            first = own.t.word_bounds[text] + start
            np.add.at(step, first, 1)
            np.add.at(step, first + length, -1)
        keep = np.cumsum(step[:-1]) == 0
        n_words = np.diff(own.t.word_bounds)
        n_kept = np.bincount(own.t.doc[keep], minlength=own.t.n)
        columns = [table.column("doc_id"), pa.array(n_words), pa.array(n_words - n_kept), _kept(own.t, keep).cast(pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept"]
        if carried:
            columns.append(table.column(carried))
            names.append(carried)
        if with_factors:
            columns += [_listed(x, own.t.n) for x in parsed]
            names += ["factors", "crossing"]
        return pa.table(columns, names)

    return remove


def dedup(docs: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES, with_factors: bool = False, carried: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the remaining words, joined by one space) of each row; with_factors: also the factors and
    the spans crossing their ends, as (start, length, source_doc, source_start), counted in words; carried: a column that stays beside its row."""
    rows, n = in_blocks(docs, block_bytes, carried)
    of_block = lambda df: df.groupBy("block")
    asked = of_block(rows).applyInArrow(_ask_anchors(n, words), "range int, block int, keys binary")
    again = asked.groupBy("range").applyInArrow(_answer_anchors, "range int, block int, answer binary")
    windows_ = of_block(rows).cogroup(of_block(again)).applyInArrow(
        _ask_windows(n, words), "range int, block int, keys binary, checks binary, docs binary, places binary"
    )
    sources = windows_.groupBy("range").applyInArrow(_answer_windows, "range int, block int, answer binary")
    answers = again.withColumn("step", F.lit(1)).unionByName(sources.withColumn("step", F.lit(2)))
    schema = "doc_id long, n_words long, n_removed long, kept string"
    if with_factors:
        schema += "".join(f", {x} array<struct<start: long, length: long, source_doc: long, source_start: long>>" for x in ("factors", "crossing"))
    fields = StructType.fromDDL(schema).fields
    if carried:
        fields.insert(4, docs.schema[carried])
    return of_block(rows).cogroup(of_block(answers)).applyInArrow(_remove(words, with_factors, carried), StructType(fields))


def remove(docs: DataFrame, words: int = WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents with their remaining words, joined by one space, as text; n_chars, where there is such a column, follows. Other
    columns are kept, whatever their names."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    found = dedup(rows, words, block_bytes, carried="row").select("row.*", F.col("kept").alias("text"))
    if "n_chars" in rest:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
