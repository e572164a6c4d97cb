"""Similarity join of documents by the Jaccard coefficient of their word shingles, by chosen paths.

A document's set holds the hashes of its runs of five words (of fewer words: of all its words at once). Documents with equal sets are
one class. In each run a class chooses, by a hash that all classes share, about CHOSEN / (similarity * size) of its own tokens; classes
that chose the same token are a bucket. Two sets of the wanted similarity share CHOSEN chosen tokens a run on average. Buckets too
large to compare at once are split again, level by level, by a fixed number of places of the classes' minwise sketches that are chosen
under their path and were not used above. The number of runs follows from the target recall and from what such a pair keeps through
all levels. A bucket whose children would cost more than itself (a group of like sets, or one not much too large) is compared as it
is; so is what is left at the last level.

A small bucket is compared in one task. The classes of a larger one are packed into blocks, a row per block; a task holds one block and
reads the others of the bucket one by one, so its memory is that of two blocks, and its result has a row per class of its block,
however large the bucket. Sketches (PLACES minima of 16 bits) are compared first, and only classes that have a partner with LEAST_EQUAL
equal minima or more (a pair of the wanted similarity has fewer with a probability of about 1e-9) send their sets. A pair is counted in
the largest bucket that both sides are in and in no other, so counts need no list of pairs; a bucket whose classes share one larger
bucket is dropped. Sizes of intersections come from matrix products; similarities are exact. What is left of a group of m like but
different sets is m * m comparisons within its tasks: the links themselves are that many.

Defined results: a null text, or one without words, has no set, is its own class and links with nothing; rows with equal sets are
linked with similarity 1; rows with the same doc_id are rows of their own; of the rows of a component the one with the smallest doc_id
(null last), then the smallest hash of its text, is kept, and rows that are equal in both are kept or not together by `join`, while
`keep_one` keeps one of them; a null doc_id is no smallest id; an empty table gives an empty result; other columns are ignored by
`join` and kept by `keep_one`. Sets and rows are told apart by 64-bit and tokens by 52-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import components
from .quality_classifier import _slices
from .text import Texts, mix, whole_windows, windows

U = np.uint64
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.9999
CHOSEN = 2.5
#: Classes, and tokens of all of them, in a bucket that is compared at once; and in a block of a larger one.
BUCKET, TOKENS = 512, 1 << 20
BLOCK = 2048
LEVELS = 10
PLACES, LEAST_EQUAL = 64, 30
#: Places that two sets of the wanted similarity share on average where a bucket is split, at least: well over 1, so that few pairs
#: are lost however many levels follow.
SHARED_BELOW = 1.6
#: What a row of a child costs, in comparisons of two sketches and as a multiple of BUCKET.
ROW = 8
#: Ids of the classes that send their sets are broadcast up to so many, else the texts are joined by a shuffle.
BROADCAST_ROWS = 500_000


def places_for(similarity: float) -> int:
    return math.ceil(SHARED_BELOW / similarity - 1e-9)


def survival(equal: float, places: int, levels: int = LEVELS - 1) -> float:
    """With what probability a pair that shares a bucket still shares one after so many splits; equal: the share of equal places."""
    kept = 1.0
    for _ in range(levels):
        kept = 1 - (1 - equal * kept) ** places
    return kept


def runs_for(recall: float, chosen: float = CHOSEN, similarity: float = SIMILARITY) -> int:
    """Runs after which a pair of just the wanted similarity shares a compared bucket with this probability, even if each bucket of
    the first level is split at all levels. All buckets are split by one sketch, so the mean is taken over its equal places."""
    share = [(math.comb(PLACES, e) * similarity**e * (1 - similarity) ** (PLACES - e), survival(e / PLACES, places_for(similarity))) for e in range(PLACES + 1)]
    runs = 1
    while sum(p * math.exp(-chosen * runs * kept) for p, kept in share) > 1 - recall:
        runs += 1
    return runs


def _sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, token) of the distinct shingles of a slice, in order."""
    hashes = t.words()
    at = np.flatnonzero(whole_windows(t.doc, k))
    key = (t.doc[at].astype(U) << U(52)) | (windows(hashes, k)[at] >> U(12))
    n = np.diff(t.word_bounds)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        a = t.word_bounds[short]
        whole = np.zeros(len(short), U)
        for j in range(k - 1):
            more = n[short] > j
            whole[more] = mix(whole[more] * U(31) + hashes[a[more] + j])
        key = np.append(key, (short.astype(U) << U(52)) | (whole >> U(12)))
    key = np.sort(key)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> U(52)).astype(np.int64), key & U((1 << 52) - 1)


def _small_slices(batch: pa.RecordBatch):
    for part in _slices(batch):
        for i in range(0, part.num_rows, 4096):  # a text's number has 12 bits
            yield part.slice(i, 4096)


def _set_hash(doc: np.ndarray, token: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.searchsorted(doc, np.arange(n + 1))
    run = np.concatenate([np.zeros(1, U), np.cumsum(mix(token + U(77)), dtype=U)])
    size = np.diff(bounds)
    return mix(run[bounds[1:]] - run[bounds[:-1]] + size.astype(U)).view(np.int64), size


def _sketch(doc: np.ndarray, token: np.ndarray, n: int) -> list[bytes | None]:
    """For each text with tokens, 16 bits of the minimum of each of PLACES orders of its tokens."""
    bounds = np.searchsorted(doc, np.arange(n + 1))
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(some), PLACES), np.uint16)
    mixed = mix(token + U(5))
    for k in range(PLACES if len(some) else 0):
        order = mixed * (mix(np.array([k + 11], U)) | U(1))
        out[:, k] = (mix(np.minimum.reduceat(order, bounds[some])) & U(0xFFFF)).astype(np.uint16)
    found: list[bytes | None] = [None] * n
    for i, row in zip(some.tolist(), out):
        found[i] = row.tobytes()
    return found


def _choose(token: np.ndarray, salt, size, similarity: float, chosen: float = CHOSEN) -> np.ndarray:
    """Which tokens are chosen; salt: of the run or path, size: of the token's set."""
    most = np.minimum(chosen / (similarity * np.maximum(size, 1)), 1.0)
    return mix(token * U(2) + U(1) + salt).astype(np.float64) * 2.0**-64 < most


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of id and text) and text; null: empty."""
    id_, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    return docs.select(id_.alias("doc_id"), F.xxhash64(id_, text).alias("row"), text.alias("text"))


def _signed(docs: DataFrame, runs: int, k: int, similarity: float) -> DataFrame:
    """doc_id, row, rep (the set's hash; null without a set), its size, the buckets of the first level and the sketch."""
    rows = _rows(docs)

    def work(batches):
        for batch in batches:
            for part in _small_slices(batch):
                t = Texts(part.column("text"))
                doc, token = _sets(t, k)
                rep, size = _set_hash(doc, token, t.n)
                found = []
                for r in range(runs):
                    salt = mix(np.array([r + 1], U))
                    hit = np.flatnonzero(_choose(token, salt, size[doc], similarity))
                    found.append((doc[hit], mix(token[hit] + salt * U(3)).view(np.int64)))
                of, path = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(t.n + 1)).astype(np.int32)
                paths = pa.ListArray.from_arrays(pa.array(cuts), pa.array(path[order]))
                sketch = pa.array(_sketch(doc, token, t.n), pa.binary())
                columns = [part.column("doc_id"), part.column("row"), pa.array(rep, mask=size == 0), pa.array(size.astype(np.int64)), paths, sketch]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "rep", "size", "paths", "sketch"])

    return rows.mapInArrow(work, "doc_id long, row long, rep long, size long, paths array<long>, sketch binary")


def _with_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, copies, size and tokens, for the classes wanted (row, rep, copies, size)."""
    rows = _rows(docs).drop("doc_id").join(wanted, "row").select("rep", "copies", "size", "text")
    names = ["rep", "copies", "size", "tokens"]

    def work(batches):
        for batch in batches:
            for part in _small_slices(batch):
                t = Texts(part.column("text"))
                doc, token = _sets(t, k)
                bounds = np.searchsorted(doc, np.arange(t.n + 1))
                tokens = [token[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(tokens, pa.binary())], names)

    return rows.mapInArrow(work, "rep long, copies long, size long, tokens binary").dropDuplicates(["rep"])


def _sized(rows: DataFrame) -> DataFrame:
    """Only the buckets of two classes or more, with their sizes."""
    return rows.join(rows.groupBy("path").agg(F.count("*").alias("members")).where("members > 1"), "path")


def _split(large: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The children of buckets; used: a bit for each place that a path has used."""
    count = places_for(similarity)

    def work(batches):
        places = np.arange(PLACES, dtype=U)
        for batch in batches:
            if not batch.num_rows:
                continue
            path, rep, size, members, used = (batch.column(c).to_numpy() for c in ("path", "rep", "size", "members", "used"))
            path, used = path.view(U), used.view(U)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, PLACES)
            order = mix(mix(path)[:, None] + places[None, :]) >> U(1)
            order[(used[:, None] >> places[None, :]) & U(1) > 0] = U((1 << 64) - 1)
            place = np.argpartition(order, count - 1, axis=1)[:, :count].ravel()
            row = np.repeat(np.arange(len(path)), count)
            child = mix(mix(path[row] + places[place] * U(65537)) + sketch[row, place].astype(U)).view(np.int64)
            marked = (used[row] | (U(1) << places[place])).view(np.int64)
            columns = (child, rep[row], size[row], marked, path[row].view(np.int64), members[row])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["path", "rep", "size", "used", "parent", "parent_members"])

    rows = large.select("path", "rep", "members", "used").join(sketches, "rep").select("path", "rep", "size", "members", "used", "sketch")
    return rows.mapInArrow(work, "path long, rep long, size long, used long, parent long, parent_members long")


def _buckets(live: DataFrame, sketches: DataFrame, similarity: float, name: str) -> DataFrame:
    """path, rep, size and members of the buckets that are compared: small ones, groups of like sets, and what is left at the last level."""
    done = live.where(F.col("members") <= BUCKET)
    large = live.where(F.col("members") > BUCKET).withColumn("used", F.lit(0).cast("long"))
    for level in range(2, LEVELS + 1):
        if large.isEmpty():
            return done
        children = written(_sized(written(_split(large, sketches, similarity), name)), name)
        cost = F.sum(F.col("members") + ROW * BUCKET).alias("cost")  # over rows, so of each child its square and its rows
        of_parent = children.groupBy("parent").agg(cost, F.first("parent_members").cast("double").alias("n"))
        dense = of_parent.where("cost >= n * n").select(F.col("parent").alias("path"))
        done = done.unionByName(large.join(dense, "path", "left_semi").drop("used"))
        below = children.join(dense.withColumnRenamed("path", "parent"), "parent", "left_anti").select("path", "rep", "size", "members", "used")
        done = done.unionByName(below.where(F.col("members") <= BUCKET).drop("used"))
        large = below.where(F.col("members") > BUCKET)
    return done.unionByName(large.drop("used"))


class _Incidence:
    """Which rows hold which of some 64-bit keys, by key."""

    def __init__(self, keys: list[np.ndarray]):
        self.n = len(keys)
        key, row = np.concatenate([*keys, np.zeros(0, U)]), np.repeat(np.arange(self.n), [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        key, self.row = key[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.keys, self.bounds = key[first], np.append(first, len(key))

    def entries(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of what lies in the keys at these places, which become columns 0, 1, ..."""
        size = self.bounds[at + 1] - self.bounds[at]
        place = np.repeat(self.bounds[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.row[place], np.repeat(np.arange(len(at)), size)

    def shared(self, other: "_Incidence", step: int = 2048) -> np.ndarray:
        """For each row here and each there, how many keys both hold."""
        out = np.zeros((self.n, other.n), np.float32)
        if not len(self.keys) or not len(other.keys):
            return out
        there = np.minimum(np.searchsorted(other.keys, self.keys), len(other.keys) - 1)
        here = np.flatnonzero(other.keys[there] == self.keys)
        if other is self:
            here = here[np.diff(self.bounds)[here] > 1]
        there = there[here]
        for i in range(0, len(here), step):
            x = np.zeros((self.n, step), np.float32)
            x[self.entries(here[i : i + step])] = 1
            y = x
            if other is not self:
                y = np.zeros((other.n, step), np.float32)
                y[other.entries(there[i : i + step])] = 1
            out += x @ y.T
        return out


class _Classes:
    """Classes of a bucket or a block: their larger buckets, and their sketches or sets."""

    def __init__(self, table: pa.Table):
        self.rep, self.size = table.column("rep").to_numpy(), table.column("size").to_numpy().astype(np.float32)
        self.copies = table.column("copies").to_numpy().astype(float)
        self.greater = _Incidence([np.array(x, np.int64).view(U) for x in table.column("greater").to_pylist()])
        if "sketch" in table.column_names:
            self.sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, PLACES).T.copy()
        else:
            self.tokens = _Incidence([np.frombuffer(x, U) for x in table.column("tokens").to_pylist()])

    def _apart(self, other: "_Classes", linked: np.ndarray) -> np.ndarray:
        if len(self.greater.keys) and len(other.greater.keys) and linked.any():
            linked &= self.greater.shared(other.greater) == 0
        if other is self:
            np.fill_diagonal(linked, False)
        return linked

    def alike(self, other: "_Classes", similarity: float) -> np.ndarray:
        """Which pairs have sketches with enough equal places."""
        equal = np.zeros((len(self.rep), len(other.rep)), np.uint8)
        for a, b in zip(self.sketch, other.sketch):
            equal += a[:, None] == b[None, :]
        return self._apart(other, equal >= LEAST_EQUAL)

    def links(self, other: "_Classes", similarity: float) -> np.ndarray:
        """Which pairs have the wanted similarity and no larger bucket in common."""
        both = self.tokens.shared(other.tokens)
        return self._apart(other, both >= similarity * (self.size[:, None] + other.size[None, :] - both) - 1e-6)


def _met(linked: np.ndarray, root: np.ndarray) -> np.ndarray:
    """root with the rows brought together that share a column, or are brought together already; roots are the smallest rows."""
    root, todo = root.copy(), linked.any(1)
    while todo.any():
        rows, columns = np.zeros(len(root), bool), np.zeros(linked.shape[1], bool)
        new = np.zeros(len(root), bool)
        new[np.argmax(todo)] = True
        while new.any():
            rows |= new
            more = linked[new].any(0) & ~columns
            columns |= more
            new = linked[:, more].any(1) & ~rows
        roots = np.unique(root[rows])
        root[np.isin(root, roots)] = roots[0]
        todo &= ~rows
    return root


def _cover(linked: np.ndarray):
    """(row, column) of some links, so that each row with a link shares the column of one of them."""
    todo = linked.any(1)
    while todo.any():
        column = int(np.argmax(linked[todo].sum(0)))
        hit = todo & linked[:, column]
        yield int(np.argmax(hit)), column
        todo &= ~hit


_LINKS = "path long, rep long, links long, root long"


def _answer(path: int, rep, links, root) -> pa.RecordBatch:
    columns = [np.full(len(rep), path), rep, links.astype(np.int64), root]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["path", "rep", "links", "root"])


def _compare(step: str, similarity: float):
    """For a bucket: a row for each class with links, with their number and a class that it is connected with."""

    def compare(table: pa.Table) -> pa.Table:
        own = _Classes(table)
        linked = getattr(own, step)(own, similarity)
        root, links = np.arange(len(own.rep)), linked @ own.copies
        if step == "links":
            root = _met(linked | (np.eye(len(root), dtype=bool) & linked.any(1)), root)
        hit = np.flatnonzero(links > 0)
        return pa.Table.from_batches([_answer(table.column("path")[0].as_py(), own.rep[hit], links[hit], own.rep[root[hit]])])

    return compare


def _stream(step: str, similarity: float):
    """The same for one block of a bucket against all of them. Classes of the block that share a partner are brought together; of the
    other blocks each task names enough partners that each class here is connected with one of its own there. As each task does so,
    all that links connect is connected."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for path, counted, blob in zip(*(batch.column(c).to_pylist() for c in ("path", "counted", "blob"))):
                other = _Classes(pa.ipc.open_stream(blob).read_all())
                mine = own is None  # the block itself comes first
                if mine:
                    own, links, root = other, np.zeros(len(other.rep)), np.arange(len(other.rep))
                if not counted:
                    continue
                linked = getattr(own, step)(other, similarity)
                if not linked.any():
                    continue
                links += linked @ other.copies
                if step == "links":
                    root = _met(linked | (np.eye(len(root), dtype=bool) & linked.any(1)) if mine else linked, root)
                if step == "links" and not mine:
                    found = np.array(list(_cover(linked)))
                    yield _answer(path, own.rep[found[:, 0]], np.zeros(len(found)), other.rep[found[:, 1]])
        hit = np.flatnonzero(links > 0)
        yield _answer(path, own.rep[hit], links[hit], own.rep[root[hit]])

    return stream


def _packed(table: pa.Table) -> pa.Table:
    """A block as one row."""
    sink = pa.BufferOutputStream()
    own = table.drop_columns(["path", "block", "top"])
    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(own)
    first = [table.column(c).slice(0, 1) for c in ("path", "block", "top")]
    return pa.table([*first, pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["path", "block", "top", "blob"])


def _linked(leaves: DataFrame, payload: DataFrame, step: str, similarity: float, name: str) -> DataFrame:
    """path, rep, links and root of all classes with links; rows without links only connect. payload: rep, copies, and sketch or tokens.
    greater: the larger buckets of a class, top: the largest."""
    order = F.struct("members", "path")
    of_rep = leaves.groupBy("rep").agg(F.max(order).alias("top"), F.collect_list(order).alias("all"))
    rows = leaves.join(of_rep, "rep").withColumn("greater", F.transform(F.filter("all", lambda x: x > F.struct("members", "path")), lambda x: x["path"]))
    rows = rows.select("path", "rep", "size", "members", F.col("top.path").alias("top"), "greater")
    useful = rows.groupBy("path").agg(F.min("top").alias("a"), F.max("top").alias("b"), F.sum("size").alias("tokens")).where("a <> b OR a = path").select("path", "tokens")
    rows = written(rows.join(useful, "path"), name)
    large = (F.col("members") > BUCKET) | (F.col("tokens") > TOKENS)
    small = rows.where(~large).select("path", "rep", "size", "greater").join(payload, "rep")
    found = small.groupBy("path").applyInArrow(_compare(step, similarity), _LINKS)
    big = rows.where(large)
    if big.isEmpty():
        return found
    blocks = big.groupBy("path", "top").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / TOKENS)).alias("blocks"))
    big = big.join(blocks, ["path", "top"]).withColumn("block", F.xxhash64("top", F.pmod(F.xxhash64("rep"), "blocks")))
    big = big.select("path", "block", "top", "rep", "size", "greater").join(payload, "rep").groupBy("path", "block")
    packed = written(big.applyInArrow(_packed, "path long, block long, top long, blob binary"), name)
    a = packed.select("path", F.col("block").alias("p"), F.col("top").alias("top_p"))
    b = packed.select("path", F.col("block").alias("q"), F.col("top").alias("top_q"))
    counted = (F.col("top_p") != F.col("top_q")) | (F.col("top_p") == F.col("path"))
    pairs = a.join(b, "path").select("path", "p", "q", counted.alias("counted")).where("counted OR p = q")
    tasks = pairs.join(packed.withColumnRenamed("block", "q").drop("top"), ["path", "q"]).withColumn("other", F.col("p") != F.col("q"))
    tasks = tasks.repartition("path", "p").sortWithinPartitions("path", "p", "other", "q").groupBy("path", "p")
    return found.unionByName(tasks.applyInArrow(_stream(step, similarity), _LINKS))


def _join(docs: DataFrame, similarity: float, recall: float, shingle: int) -> DataFrame:
    """What `join` gives, and row."""
    signed = written(_signed(docs, runs_for(recall, similarity=similarity), shingle, similarity), "join-signed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first = [F.first(c).alias(c) for c in ("size", "paths", "sketch")]
    classes = signed.where("rep IS NOT NULL").groupBy("rep").agg(F.min("doc_id").alias("class_id"), F.min(place).alias("keeper"), F.count("*").alias("copies"), *first)
    classes = written(classes, "join-classes")
    sketches = classes.select("rep", "size", "sketch")
    live = written(_sized(classes.select(F.explode("paths").alias("path"), "rep", "size")), "join-first")
    leaves = written(_buckets(live, sketches, similarity, "join-level"), "join-leaves")
    alike = _linked(leaves, classes.select("rep", "copies", "sketch"), "alike", similarity, "join-tasks").where("links > 0").select("path", "rep").distinct()
    sizes = classes.select("rep", "size")
    leaves = written(_sized(written(alike, "join-alike").join(sizes, "rep")), "join-leaves")
    wanted = leaves.select("rep").distinct().join(classes.select("rep", F.col("keeper.row").alias("row"), "copies", "size"), "rep")
    wanted = written(wanted, "join-wanted")
    sets = written(_with_sets(docs, F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, shingle), "join-sets")
    links = written(_linked(leaves, sets.drop("size"), "links", similarity, "join-tasks").drop("path"), "join-links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.select("rep", "class_id", "keeper", "copies").join(counted, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    smallest = known.groupBy("root").agg(F.min("class_id").alias("component_id"), F.min("keeper").alias("best"))
    count = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    known = written(known.join(smallest, "root").select("rep", "class_id", count, "component_id", F.col("best.row").alias("best")), "join-known")
    found = signed.select("doc_id", "row", "rep").join(known, "rep", "left")
    return found.select(
        "doc_id", "row", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"), (F.coalesce("best", "row") == F.col("row")).alias("kept"),
    )


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest id with an equal set), n_links (other documents of the wanted similarity or
    more, those with equal sets included), component_id (the smallest id that links reach), kept (it is the one of its component)."""
    return _join(docs, similarity, recall, shingle).drop("row")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One document of each component, with all its columns."""
    found = _join(docs, similarity, recall, SHINGLE)
    names, row = docs.columns, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    rows = docs.select(F.struct("*").alias("document"), row.alias("row_of_join"))
    gone = found.where("NOT kept").select(F.col("row").alias("row_of_join")).distinct()
    rows = rows.join(gone, "row_of_join", "left_anti")
    again = written(found.where("kept").groupBy(F.col("row").alias("row_of_join")).count().where("count > 1").select("row_of_join"), "join-again")
    if not again.isEmpty():  # rows that are the same in id and text
        rows = rows.join(again, "row_of_join", "left_anti").unionByName(rows.join(again, "row_of_join").dropDuplicates(["row_of_join"]))
    return rows.select(*[F.col("document")[c].alias(c) for c in names])


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
