"""Conversations that are damaged, judged and repaired with the cheapest edits.

Rows that are equal after the damage are one row with a number of copies; the first turn of each role and text of a conversation tells
which rows are duplicates. All rows are put in order by ranges of conversation and turn and written as segments of about SEGMENT_BYTES. A
conversation that lies in one segment is repaired there. One that goes on over segments, however many, is repaired in parts: each part gives
the matrix of its costs, these say what lies ahead of each part, that gives each part's map of states, and these the state it begins with;
the parts are then repaired each in a task, and one pass over their rows in order sums the counts, joins the letters and hashes the text as it
streams by. What meets for one conversation are 16 numbers a segment. Its letters are one value, as the result wants them.

Defined results: a null conv_id is a conversation, a null turn comes first and is in no gap, a null role or text is one space; rows of one turn
stand in the order of their roles, then of a hash of role and text; repeated rows are rows of their own (all but the first are duplicates); a
conversation without rows after the damage has zeros, an empty audit and the hash of an empty text; roles count by their first character, lower
case; gaps beyond a long count as the largest one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import turns as T
from .common import written

C = F.col
SEGMENT_BYTES = 8 << 20
#: Of a repaired text, in one row.
PIECE_BYTES = 1 << 18
SPACES = " \t\n\x0b\x0c\r"
NONE, BLANK, DUPLICATE, CUT = range(4)
ORDER = ("conv_id", "known", "turn", "role", "key")
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies: 0 in the place of a dropped row."""
    spaced = lambda c: F.coalesce(C(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text, gone = spaced("text"), C("kind") == 0
    return rows.select("conv_id", "turn", spaced("role").alias("role"), text.alias("text"), kind.alias("kind")).select(
        "conv_id",
        F.when(~gone, C("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(C("kind") == 4, "user").otherwise(C("role")).alias("role"),
        F.when(gone | (C("kind") == 1), "").when(C("kind") == 2, F.translate("text", ".!?", "")).otherwise(C("text")).alias("text"),
        F.when(gone, 0).when(C("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def faulted(rows: DataFrame) -> DataFrame:
    """conv_id, known (the turn is), turn, role, key, text, copies, fault of the first copy and kind, as the repair wants it."""
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    conv = F.coalesce(F.concat(F.lit("="), C("conv_id").cast("string")), F.lit(""))
    key = F.sha2(F.concat_ws(":", F.length(conv), conv, F.length("role"), "role", "text"), 256)
    own = own.withColumn("known", C("turn").isNotNull().cast("int")).withColumn("key", key)
    seen = own.where("copies > 0").groupBy("key").agg(F.min(F.struct("known", "turn")).alias("first"), F.count("*").alias("n"))
    own = own.join(seen.where("n > 1").select("key", "first"), "key", "left")
    bare = F.rtrim("text", F.lit(SPACES))
    later = C("first").isNotNull() & ~C("first").eqNullSafe(F.struct("known", "turn"))
    fault = F.when(bare == "", BLANK).when(later, DUPLICATE).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE)
    initial: Column = F.lit(T.OTHER)
    for letter, code in T.INITIALS.items():
        initial = F.when(F.substring("role", 1, 1) == letter.decode(), code).otherwise(initial)
    state = F.when(C("fault") == CUT, T.CUT).when(C("fault") == NONE, 0).otherwise(T.GONE)
    return own.select("conv_id", "known", "turn", "role", "key", "text", "copies", fault.alias("fault")).withColumn("kind", (initial + state).cast("int"))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([(c, "ascending") for c in ORDER])


def _kinds(table: pa.Table) -> list[int]:
    """Kinds of a part's rows; further copies, which go at once at the same cost from each state, and names without a row are left out."""
    return [kind for kind, copies in zip(table["kind"].to_pylist(), table["copies"].to_pylist()) if copies]


def _one(table: pa.Table, names: list[str]) -> list:
    return [table[c].slice(0, 1) for c in names]


def _matrices(table: pa.Table) -> pa.Table:
    matrix = T.costs(_kinds(_sorted(table)))
    return pa.table([*_one(table, ["conv_id", "seg"]), pa.array([matrix], pa.list_(pa.float64()))], ["conv_id", "seg", "matrix"])


def _afters(table: pa.Table) -> pa.Table:
    """What lies after each part of a conversation, from its end to its beginning."""
    table = table.sort_by([("seg", "descending")])
    after, out = T.END, []
    for matrix in table["matrix"].to_pylist():
        out.append(list(after))
        after = T.through(matrix, after)
    return pa.table([table["conv_id"], table["seg"], pa.array(out, pa.list_(pa.float64()))], ["conv_id", "seg", "after"])


def _maps(table: pa.Table) -> pa.Table:
    after = tuple(table["after"][0].as_py())
    to = T.exits(_kinds(_sorted(table)), after)
    return pa.table([*_one(table, ["conv_id", "seg", "after"]), pa.array([to], pa.list_(pa.int32()))], ["conv_id", "seg", "after", "exits"])


def _entries(table: pa.Table) -> pa.Table:
    """The state that each part of a conversation begins with."""
    table = table.sort_by("seg")
    state, out = 0, []
    for to in table["exits"].to_pylist():
        out.append(state)
        state = to[state]
    last = [False] * (len(out) - 1) + [True]
    return pa.table([table["conv_id"], table["seg"], table["after"], pa.array(out, pa.int32()), pa.array(last)], ["conv_id", "seg", "after", "entry", "last"])


PART = "faults array<long>, out_of_order long, first int, last_initial int, low long, high long, turns long, part_cost long, letters string"


def _repaired(table: pa.Table) -> pa.Table:
    """Of a segment: results of the conversations that lie in it, and pieces of those that go on."""
    table = _sorted(table)
    rows = zip(*(table[c].to_pylist() for c in ("conv_id", "turn", "kind", "fault", "role", "text", "copies", "after", "entry", "last")))
    seg, out = table["seg"][0].as_py(), []
    for conv, group in groupby(rows, lambda r: r[0]):
        group = list(group)
        after, entry, last = group[0][7:]
        if after is None:
            part, whole = T.Part([r[1:7] for r in group]), T.Whole()
            whole.add(part.faults, part.illegal, part.first, part.last, part.low, part.high, part.turns, part.cost, part.audit)
            whole.text(b"\n".join(part.lines))
            out.append((conv, None, None, None, *[None] * 9, *whole.row()))
            continue
        part = T.Part([r[1:7] for r in group], tuple(after), entry, last)
        own = (part.faults, part.illegal, part.first, part.last, part.low, part.high, part.turns, part.cost, part.audit)
        text = b"\n".join(part.lines)
        for i in range(0, max(1, len(text)), PIECE_BYTES):
            out.append((conv, seg, i, text[i : i + PIECE_BYTES], *(own if not i else [None] * 9), *[None] * 8))
    longs, names = pa.int64(), ["conv_id", "seg", "at", "piece", *_names(PART), *_names(RESULT)]
    kinds = [table.schema.field("conv_id").type, pa.int32(), longs, pa.binary(), pa.list_(longs), longs, pa.int32(), pa.int32(), longs, longs, longs, longs, pa.string(), *[longs] * 6, pa.string(), pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of conversation, segment and place, streamed: a result for each conversation."""
    conv, whole, done = None, None, []
    kind = pa.int64()

    def out():
        names = ["conv_id", *_names(RESULT)]
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "at", "piece", *_names(PART))]
        for name, at, piece, *part in zip(*columns):
            if whole is None or name != conv:
                done += [(conv, *whole.row())] if whole else []
                conv, whole = name, T.Whole()
            if not at:
                whole.add(*part)
                whole.text(piece)
            else:
                whole.sha.update(piece)
        if len(done) > 1000:
            yield out()
            done = []
    done += [(conv, *whole.row())] if whole else []
    if done:
        yield out()


def repair(rows: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation. rows: conv_id, turn, role,
    text."""
    kind = dict(rows.dtypes)["conv_id"]
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    ready = written(faulted(damaged(rows)), "turns")
    ranged = ready.repartitionByRange(max(1, -(-total // segment_bytes)), *ORDER).withColumn("seg", F.spark_partition_id())
    ranged = ranged.withColumn("role", C("role").cast("binary")).withColumn("text", C("text").cast("binary"))
    segments = written(ranged, "segments")
    spans = segments.groupBy("conv_id").agg(F.min("seg").alias("from"), F.max("seg").alias("to")).where("`from` < `to`").select(C("conv_id").alias("spanning"))
    light = segments.drop("text")
    parts = written(light.join(spans, C("conv_id").eqNullSafe(C("spanning"))).drop("spanning"), "spans")
    keyed = f"conv_id {kind}, seg int"
    matrices = parts.groupBy("conv_id", "seg").applyInArrow(_matrices, f"{keyed}, matrix array<double>")
    afters = matrices.groupBy("conv_id").applyInArrow(_afters, f"{keyed}, after array<double>")
    beside = lambda left, right: left.join(right.withColumnsRenamed({"conv_id": "c", "seg": "s"}), C("conv_id").eqNullSafe(C("c")) & (C("seg") == C("s")), "left").drop("c", "s")
    maps = beside(parts, afters).groupBy("conv_id", "seg").applyInArrow(_maps, f"{keyed}, after array<double>, exits array<int>")
    entries = written(maps.groupBy("conv_id").applyInArrow(_entries, f"{keyed}, after array<double>, entry int, last boolean"), "entries")
    schema = f"{keyed}, at long, piece binary, {PART}, {RESULT}"
    found = written(beside(segments, entries).groupBy("seg").applyInArrow(_repaired, schema), "repaired")
    result = ["conv_id", *_names(RESULT)]
    pieces = found.where("seg IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "seg", "at")
    joined = pieces.select("conv_id", "at", "piece", *_names(PART)).mapInArrow(_joined, f"conv_id {kind}, {RESULT}")
    return found.where("seg IS NULL").select(*result).unionByName(joined)


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
