"""Packing of training examples into sequences by vector bin packing.

An example asks for three things at once: tokens, one segment, and loss-bearing tokens.
A sequence is filled by the dot-product rule: of all examples that still fit under every
limit, take the one whose demand has the largest dot product with what is left of the
sequence, each dimension weighted by its mean demand; open the next sequence when none fits.

Examples are dealt at random into groups of bounded size and each group is packed by
itself, so at most one part-filled tail per group is lost.  Documents are cut into pieces
of a full sequence and a rest while they are encoded; only counts and checksums travel on.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barloom.llm.common import per_worker, ship, small_batches
from barloom.llm.token_store import WordTable
from barloom.session import materialize

ship(__name__)

# Examples that one task packs together.
ROWS_PER_GROUP = 20_000


class Limits(NamedTuple):
    """What a sequence holds at most."""

    tokens: int = 4096
    segments: int = 128
    loss: int = 4096


def fill(demand: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, place in it) of every row of ``demand``; -1 for rows over a limit on their own.

    Equal demands are interchangeable, so the rule scans distinct demands only.
    """
    top = np.array(limits, dtype=np.int64)
    sequence, place = np.full(len(demand), -1, dtype=np.int64), np.full(len(demand), -1, dtype=np.int64)
    fitting = np.flatnonzero((demand <= top).all(axis=1))
    if not len(fitting):
        return sequence, place
    kinds, kind_of = np.unique(demand[fitting], axis=0, return_inverse=True)
    # Rows by kind: the last one of a kind is taken first.
    rows = fitting[np.argsort(kind_of.reshape(-1), kind="stable")]
    left = np.bincount(kind_of.reshape(-1), minlength=len(kinds))
    ends = np.cumsum(left)
    scaled = kinds / top
    weight = np.average(scaled, axis=0, weights=left)
    rest, room, at, count = len(rows), top.copy(), 0, 0
    while rest:
        open_kinds = (kinds <= room).all(axis=1)
        if not open_kinds.any():
            room, at, count = top.copy(), at + 1, 0
            continue
        score = np.where(open_kinds, scaled @ (weight * room / top), -1.0)
        best = int(score.argmax())
        left[best] -= 1
        row = rows[ends[best] - left[best] - 1]
        sequence[row], place[row] = at, count
        room, count, rest = room - kinds[best], count + 1, rest - 1
        if not left[best]:
            keep = left > 0
            kinds, scaled, left, ends = kinds[keep], scaled[keep], left[keep], ends[keep]
    return sequence, place


def pack(examples: DataFrame, tokens: str, loss: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (tokens before the example in its sequence) to every row.

    ``tokens`` and ``loss`` name long columns (nulls and negative numbers count as 0); without
    ``loss`` every token bears loss.  An example over a limit on its own fits no sequence:
    both columns are null.  Repeated rows are packed each; an empty table stays empty.
    Columns named like the two added ones are replaced.  The dealing follows the file and
    row position of a written copy of ``examples``, so equal rows spread over all groups.
    """
    names = [c for c in examples.columns if c not in ("sequence_id", "offset")]
    kept = examples.select(*names)
    bare = [F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)) for c in (tokens, loss or tokens)]
    written = materialize(kept.select(F.struct(*names).alias("row"), *(c.alias(n) for c, n in zip(bare, "tl"))), "packing")
    groups = max(1, -(-written.count() // ROWS_PER_GROUP))
    place = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    dealt = written.withColumn("g", F.pmod(place, F.lit(groups)))
    schema = StructType([*dealt.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def run(table: pa.Table) -> pa.Table:
        t, lost = (table.column(c).to_numpy() for c in "tl")
        sequence, order = fill(np.stack([t, np.ones_like(t), lost], axis=1), limits)
        along = np.lexsort((order, sequence))
        before = np.cumsum(t[along]) - t[along]
        opens = np.r_[True, np.diff(sequence[along]) != 0]
        offset = np.empty_like(before)
        offset[along] = before - np.maximum.accumulate(np.where(opens, before, 0))
        out = sequence < 0
        ids = pa.array(sequence * groups + table.column("g").to_numpy(), pa.int64(), mask=out)
        return table.append_column("sequence_id", ids).append_column("offset", pa.array(offset, pa.int64(), mask=out))

    return dealt.groupBy("g").applyInArrow(run, schema).select("row.*", "sequence_id", "offset")


def pieces(
    df: DataFrame, tokenizer_file: str, end_id: int, length: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every document of ``df`` as pieces of ``length`` ids and a rest.

    Columns: id_col, start, length, ids_crc32 (of the piece's ids as little-endian unsigned
    32-bit integers), doc_tokens (with the end id that closes each document).  Null texts
    count as empty: only the end id.  Special names inside texts become what the
    vocabulary makes of them.  Repeated rows are repeated; further columns are ignored.
    """
    small_batches(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(f"words {tokenizer_file}", lambda: WordTable(tokenizer_file))
        kind = f"<u{table.width}"
        end = np.array([end_id], dtype=kind).tobytes()
        for batch in batches:
            rows, starts, sizes, sums, totals = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                raw = np.frombuffer(table.payload(text.as_py(), end), dtype=kind).astype("<u4").tobytes()
                for at in range(0, len(raw), 4 * length):
                    part = raw[at : at + 4 * length]
                    rows.append(i)
                    starts.append(at // 4)
                    sizes.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    totals.append(len(raw) // 4)
            own = batch.column(0).take(pa.array(rows, pa.int64()))
            longs = [pa.array(x, pa.int64()) for x in (starts, sizes, sums, totals)]
            yield pa.RecordBatch.from_arrays([own, *longs], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.mapInArrow(run, f"id {id_type}, start long, length long, ids_crc32 long, doc_tokens long")
    return cut.withColumnRenamed("id", id_col)


def pack_documents(
    df: DataFrame,
    tokenizer_file: str,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of all documents with their sequences; every id of a document bears loss."""
    cut = pieces(df, tokenizer_file, end_id, min(limits.tokens, limits.loss), id_col, text_col)
    return pack(cut, "length", limits=limits)


def instruction_examples(
    turns: DataFrame,
    tokenizer_file: str,
    trained: Column | None = None,
    id_col: str = "conv_id",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(id_col, tokens, loss) per conversation, ready for ``pack``: a turn has its ids and an end id.

    Loss-bearing are the ids of turns where ``trained`` holds (default: the role is assistant;
    null does not hold).  Null texts count as empty; turns of a null id are one conversation.
    """
    wanted = F.col(role_col) == "assistant" if trained is None else trained
    rows = turns.select(
        F.struct(F.col(id_col).alias("id"), F.coalesce(wanted, F.lit(False)).alias("on")).alias("__turn"),
        F.col(text_col).alias("__text"),
    )
    counted = pieces(rows, tokenizer_file, 2, 1 << 30, "__turn", "__text")
    return counted.groupBy(F.col("__turn.id").alias(id_col)).agg(
        F.sum("length").alias("tokens"), F.sum(F.when(F.col("__turn.on"), F.col("length")).otherwise(0)).alias("loss")
    )
