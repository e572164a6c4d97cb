"""Language-model scoring with context-tree weighting over bytes (see ctw), beside a word-frequency base.

Documents are dealt to blocks. A block counts its contexts and words in training documents and sends them, with those that only its
other documents hold, to the ranges they belong to; a range holds all contexts that end in the same two bytes, so it weighs its part
of every tree down to depth two; depths one and zero (at most 65,535 nodes) are weighed on the driver and sent to the ranges, which
then answer each block with the log probabilities of the contexts it asked for. A range's rows are summed as they are read, FAN blocks
at a time and then those sums, so a task holds the range's distinct contexts and not what all blocks sent; a range that is asked much
is answered by several tasks. Nothing that grows with the corpus is broadcast.

A text is scored as its UTF-8 bytes with A-Z in lower case, then one end byte; depth bytes that no text holds stand before it.

Defined results: a null text counts as empty and has the end alone; repeated rows are scored (and learned from) one by one; without
training rows every bit has probability 1/2 and the base of every token is 1; an empty table gives an empty result; other columns are
ignored. Words are told apart by 64-bit hashes; a context's log probability is sent as a 32-bit float. A text is never split: a block
is as large as its longest text at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ctw, exchange
from .common import fold, in_blocks, written
from .text import Texts

U = np.uint64
DEPTH = 5
TOP = 2
BLOCK_BYTES = 16 << 20
SLICE_BYTES = 2 << 20
BEFORE, END = 0xFE, 0xFF  # bytes that UTF-8 never has
END_WORD = U(0x454E44)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ASKED = "range int, block int, kind int, n int, keys binary, counts binary"
#: Blocks whose rows are summed at once, blocks for each range of words, and contexts that one task answers for a range.
FAN, WORDS_OF, ANSWERED = 64, 4, 20_000_000


def _pack(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(raw: bytes, n: int, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(raw, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def _shuffled(keys: np.ndarray) -> np.ndarray:
    """Another order of the keys: the latest two bytes of the context permuted, so that ranges hold about equally many."""
    return (((keys >> U(32)) * U(40503) & U(0xFFFF)) << U(32)) | (keys & U(0xFFFFFFFF))


def _restored(keys: np.ndarray) -> np.ndarray:
    return (((keys >> U(32)) * U(pow(40503, -1, 65536)) & U(0xFFFF)) << U(32)) | (keys & U(0xFFFFFFFF))


class _Lower(Texts):
    def __init__(self, column):
        super().__init__(column)
        self.data = LOWER[self.data]


def _codes(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end, with its context: the key and the text."""
    size = np.diff(t.bounds)
    row = np.full(len(t.data) + t.n * (DEPTH + 1), BEFORE, np.uint8)
    own = np.arange(len(t.data)) + np.repeat(np.arange(t.n) * (DEPTH + 1) + DEPTH, size)
    ends = t.bounds[1:] + np.arange(t.n) * (DEPTH + 1) + DEPTH
    row[own], row[ends] = t.data, END
    codes = row.astype(U)
    wide = codes.copy()
    for j in range(1, DEPTH + 1):
        codes[j:] |= wide[:-j] << U(8 * (DEPTH - j + 1))
    keep = np.zeros(len(row), bool)
    keep[own], keep[ends] = True, True
    return codes[keep], np.repeat(np.arange(t.n), size + 1)


class _Block:
    """A block's distinct contexts and words, how often training rows hold each, and which of them each row holds."""

    def __init__(self, table: pa.Table):
        held = table.column("held_out").to_numpy()
        self.n, parts = table.num_rows, []
        per_row = max(1, table.column("text").nbytes // max(1, self.n))
        step = max(1, SLICE_BYTES // per_row)
        for i in range(0, self.n, step):
            t = _Lower(table.column("text").slice(i, step))
            learned = ~held[i : i + step]
            for kind, (keys, doc) in enumerate((_codes(t), (np.append(t.words(), np.full(t.n, END_WORD)), np.append(t.doc, np.arange(t.n))))):
                if kind == 0:
                    keys = _shuffled(keys)
                order = np.argsort(keys)
                found = keys[order]
                first = np.ones(len(found), bool)
                first[1:] = found[1:] != found[:-1]
                of = np.cumsum(first) - 1
                inverse = np.empty(len(found), np.int32)
                inverse[order] = of
                counts = np.bincount(of, learned[doc[order]], minlength=int(of[-1]) + 1 if len(of) else 0).astype(np.int64)
                parts.append((kind, found[first], counts, inverse, (doc + i).astype(np.int32)))
        self.parts = parts
        self.keys, self.counts = [], []
        for kind in (0, 1):
            own = [p for p in parts if p[0] == kind]
            keys, counts = ctw.summed(np.concatenate([p[1] for p in own]), np.concatenate([p[2] for p in own])) if own else (np.zeros(0, U), np.zeros(0, np.int64))
            self.keys.append(keys)
            self.counts.append(counts)

    def sums(self, kind: int, values: np.ndarray) -> np.ndarray:
        """For each row the sum of its keys' values."""
        out = np.zeros(self.n)
        for k, keys, _, inverse, doc in self.parts:
            if k == kind:
                out += np.bincount(doc, values[np.searchsorted(self.keys[kind], keys)][inverse], minlength=self.n)
        return out


def _ranges(keys: np.ndarray, kind: int, n: int):
    if kind:
        return exchange.ranges(keys, n)
    of = ((keys >> U(32)) * U(n)) >> U(16)
    at = ctw._runs(of)
    return list(zip(of[at].astype(int).tolist(), at.tolist(), [*at[1:].tolist(), len(keys)])) if len(at) else []


def _ask(n: int):
    def ask(table: pa.Table) -> pa.Table:
        own, block = _Block(table), table.column("block")[0].as_py()
        found = []
        for kind in (0, 1):
            for r, a, b in _ranges(own.keys[kind], kind, -(-n // WORDS_OF) if kind else n):
                keys = own.keys[kind][a:b]
                found.append([r, block, kind, b - a, _pack(np.diff(keys, prepend=U(0))), _pack(own.counts[kind][a:b])])
        types = [pa.int32()] * 4 + [pa.binary()] * 2
        return exchange.rows(found, ["range", "block", "kind", "n", "keys", "counts"], types)

    return ask


def _all(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row's keys and counts."""
    n, keys, counts = (table.column(c).to_pylist() for c in ("n", "keys", "counts"))
    return [np.cumsum(_unpack(k, m, U), dtype=U) for k, m in zip(keys, n)], [_unpack(c, m, np.int64) for c, m in zip(counts, n)]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows as one: the sums of the counts of each context, also of those that no training row holds; asked: how many contexts
    its rows ask for."""
    keys, counts, asked, held, waiting = np.zeros(0, U), np.zeros(0, np.int64), 0, 0, []
    range_ = 0

    def put_together():
        nonlocal keys, counts, held, waiting
        keys, counts = ctw.summed(np.concatenate([keys, *(k for k, _ in waiting)]), np.concatenate([counts, *(c for _, c in waiting)]))
        held, waiting = 0, []

    for batch in batches:
        for r, n, k, c, more in zip(*(batch.column(x).to_pylist() for x in ("range", "n", "keys", "counts", "asked"))):
            range_, asked = r, asked + more
            waiting.append((np.cumsum(_unpack(k, n, U), dtype=U), _unpack(c, n, np.int64)))
            held += n
            if held > max(1 << 20, len(keys)):
                put_together()
    put_together()
    columns = [[range_], [len(keys)], [_pack(np.diff(keys, prepend=U(0)))], [_pack(counts)], [asked]]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()))], ["range", "n", "keys", "counts", "asked"])


MERGED = "range int, n int, keys binary, counts binary, asked long"


def _merged(contexts: DataFrame, blocks: int) -> DataFrame:
    """A row per range."""
    rows = contexts.select("range", "block", "n", "keys", "counts", F.col("n").cast("long").alias("asked"))
    if blocks > FAN:
        rows = rows.withColumn("part", F.pmod("block", F.lit(-(-blocks // FAN)))).drop("block").groupBy("range", "part").applyInArrow(_merge, MERGED)
    return rows.groupBy("range").applyInArrow(_merge, MERGED)


def _tree(keys: np.ndarray, counts: np.ndarray) -> ctw.Tree:
    order = np.argsort(_restored(keys))
    k, c = _restored(keys)[order], counts[order]
    return ctw.Tree(k[c > 0], c[c > 0], DEPTH, TOP)


def _weigh(batches):
    """What a range adds to the nodes of depth one: counts, and its children's weighted logs. node: byte * 256 + place in the heap."""
    for batch in batches:
        for n, k, c in zip(*(batch.column(x).to_pylist() for x in ("n", "keys", "counts"))):
            level = _tree(np.cumsum(_unpack(k, n, U), dtype=U), _unpack(c, n, np.int64)).levels[TOP]
            node, n0, n1, log = [], [], [], []
            for k in range(8):
                parents = level.parents(k)
                at = np.argsort(parents, kind="stable")
                first = ctw._runs(parents[at])
                ids = parents[at][first]
                node.append((ids >> U(k)) * U(256) + U(1 << k) + (ids & U((1 << k) - 1)))
                for out, x in ((n0, level.n0[k]), (n1, level.n1[k]), (log, level.log_weighted[k])):
                    out.append(np.add.reduceat(x[at], first) if len(first) else x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(node).astype(np.int32))] + [pa.array(np.concatenate(x)) for x in (n0, n1, log)], ["node", "n0", "n1", "log"])


def _top(found) -> dict[int, ctw.Level]:
    """The mixed levels of depth zero and one; found: a row per node."""
    found = found.sort_values("node")
    node = found["node"].to_numpy(np.int64)
    byte, place = node >> 8, node & 255
    one = ctw.Level(np.zeros(0, U), np.zeros(0, np.int64))
    below = []
    for k in range(8):
        use = (place >> k) == 1
        one.ids[k] = ((byte[use] << k) | (place[use] - (1 << k))).astype(U)
        one.n0[k], one.n1[k] = found["n0"].to_numpy(float)[use], found["n1"].to_numpy(float)[use]
        one.kt[k] = (one.n1[k] + 0.5) / (one.n0[k] + one.n1[k] + 1)
        below.append(found["log"].to_numpy(float)[use])
    one.weigh(below)
    zero = ctw.Level(np.zeros(0, U), np.zeros(0, np.int64))
    for k in range(8):
        prefix = one.ids[k] & U((1 << k) - 1)
        zero.ids[k] = np.unique(prefix)
        at = np.searchsorted(zero.ids[k], prefix)
        zero.n0[k], zero.n1[k] = (np.bincount(at, x[k], minlength=len(zero.ids[k])) for x in (one.n0, one.n1))
        zero.kt[k] = (zero.n1[k] + 0.5) / (zero.n0[k] + zero.n1[k] + 1)
    zero.weigh([np.bincount(np.searchsorted(zero.ids[k], one.ids[k] & U((1 << k) - 1)), one.log_weighted[k], minlength=len(zero.ids[k])) for k in range(8)])
    zero.mix([np.zeros(len(x)) for x in zero.ids], [np.ones(len(x)) for x in zero.ids])
    at = [np.searchsorted(zero.ids[k], one.ids[k] & U((1 << k) - 1)) for k in range(8)]
    one.mix([m[a] for m, a in zip(zero.mixed, at)], [x[a] for x, a in zip(zero.left, at)])
    return {0: zero, 1: one}


def _answer_contexts(top):
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of a range come first, then what the blocks ask."""
        tree, levels = None, top.value
        for batch in batches:
            range_, block, n, keys, counts = (batch.column(c).to_pylist() for c in ("range", "block", "n", "keys", "counts"))
            found = []
            for r, b, m, k, c in zip(range_, block, n, keys, counts):
                own = np.cumsum(_unpack(k, m, U), dtype=U)
                if b < 0:
                    tree = _tree(own, _unpack(c, m, np.int64))
                    tree.mix(levels[1])
                else:
                    found.append((r, b, tree.log10(_restored(own), levels).astype(np.float32).tobytes()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary()))], ["range", "block", "answer"])

    return answer


def _answers(contexts: DataFrame, merged: DataFrame, top) -> DataFrame:
    """range, block and answer of all that was asked; a range's sums go to as many tasks as its share of the asking needs."""
    tasks = F.ceil(F.col("asked") / ANSWERED).cast("int")
    sums = merged.select("range", F.lit(-1).alias("block"), "n", "keys", "counts", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
    asks = contexts.join(merged.select("range", tasks.alias("tasks")), "range")
    asks = asks.select("range", "block", "n", "keys", "counts", F.pmod(F.xxhash64("block"), "tasks").cast("int").alias("task"))
    rows = sums.unionByName(asks).repartition("range", "task").sortWithinPartitions("range", "task", "block")
    return rows.groupBy("range", "task").applyInArrow(_answer_contexts(top), "range int, block int, answer binary")


def _answer_words(table: pa.Table) -> pa.Table:
    keys, counts = _all(table)
    known, total = ctw.summed(np.concatenate(keys), np.concatenate(counts))
    answers = [_pack(total[np.searchsorted(known, k)].astype(U)) for k in keys]
    once = np.zeros((2, len(keys)), np.int64)
    once[0, 0], once[1, 0] = (total > 0).sum(), total.sum()
    columns = [table.column("range"), table.column("block"), table.column("n"), pa.array(answers, pa.binary()), pa.array(once[0]), pa.array(once[1])]
    return pa.table(columns, ["range", "block", "n", "answer", "distinct", "tokens"])


def _score(table: pa.Table, answers: pa.Table) -> pa.Table:
    names = ["doc_id", "held_out", "n_tokens", "n_known", "log_counts", "score", "n_bytes"]
    if not table.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())], names)
    own = _Block(table)
    answers = answers.sort_by("range")
    kind = answers.column("kind").to_numpy()
    raw, n = answers.column("answer").to_pylist(), answers.column("n").to_pylist()
    logs = np.concatenate([np.frombuffer(x, np.float32) for x, k in zip(raw, kind) if k == 0]).astype(float)
    counts = np.concatenate([_unpack(x, m, U) for x, m, k in zip(raw, n, kind) if k == 1]).astype(float)
    sizes = _sizes(table.column("text"))
    columns = [
        table.column("doc_id"), table.column("held_out"), pa.array(own.sums(1, np.ones(len(counts))).astype(np.int64)),
        pa.array(own.sums(1, (counts > 0).astype(float)).astype(np.int64)), pa.array(own.sums(1, np.log10(counts + 0.5))), pa.array(own.sums(0, logs)), pa.array(sizes),
    ]
    return pa.table(columns, names)


def _sizes(column: pa.ChunkedArray) -> np.ndarray:
    return pc.binary_length(column).to_numpy().astype(np.int64)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row, and the code length in bits per byte."""
    spark = docs.sparkSession
    rows, n = in_blocks(docs, block_bytes)
    rows = rows.withColumn("held_out", fold("doc_id", 5) == 1)
    asked = written(rows.groupBy("block").applyInArrow(_ask(n), ASKED), "lm-asked")
    contexts, words = asked.where("kind = 0"), asked.where("kind = 1")
    merged = written(_merged(contexts, n), "lm-merged")
    nodes = merged.select("n", "keys", "counts").mapInArrow(_weigh, "node int, n0 double, n1 double, log double")
    top = spark.sparkContext.broadcast(_top(nodes.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "log")]).toPandas()))
    log_of = _answers(contexts, merged, top)
    count_of = written(words.groupBy("range").applyInArrow(_answer_words, "range int, block int, n int, answer binary, distinct long, tokens long"), "lm-words")
    v, tokens = count_of.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    answers = log_of.select("range", "block", F.lit(0).alias("kind"), F.lit(0).alias("n"), "answer").unionByName(
        count_of.select("range", "block", F.lit(1).alias("kind"), "n", "answer")
    )
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, n_bytes long"
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score, schema)
    return found.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(tokens) + 0.5 * (v + 1)))).alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.greatest(F.col("n_bytes"), F.lit(1))).alias("bits_per_byte"),
    )


def op2_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
