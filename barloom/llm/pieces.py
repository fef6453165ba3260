"""SentencePiece encoding and decoding over a table of distinct chunks.

Pieces of the vocabulary never cross the mark that begins a word, so a text is the
sequence of its marked chunks: each task segments a chunk once, keeps it in its chunk
table, and joins ids, counts and decoded text back by position.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Kept, per_worker, ship, small_batches

ship(__name__)

MARK = "▁"

class ChunkTable(Kept):
    """chunk -> (number of ids, ids as decimal text, decoded text)."""

    def __init__(self, model_file: str):
        import sentencepiece

        super().__init__()
        self.vocab = vocab = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [vocab.id_to_piece(i) for i in range(vocab.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces):
            raise ValueError("pieces cross word marks")
        if any("\n" in piece for piece in pieces) or len(vocab.encode("\n")) != 2 or vocab.decode(vocab.encode(" a  b ")) != " a  b ":
            raise ValueError("only models that keep white space and have no piece with a line break")
        # The library marks the start of every text, so a chunk that has no mark of its own is
        # encoded behind a line break: two ids that cannot merge with it.
        self.chunks = re.compile(rf"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")

    def ids(self, chunk: str) -> list[int]:
        if chunk[0] != MARK:
            return self.vocab.encode("\n" + chunk)[2:]
        if chunk[-1] != MARK:
            return self.vocab.encode(chunk[1:].replace(MARK, " "))
        return self.vocab.encode(" " * (len(chunk) - 1) + "\n")[:-1]

    def make(self, chunk: str) -> tuple[int, str, str]:
        ids = self.ids(chunk)
        # The library drops the mark at the start of what it decodes.
        return len(ids), ",".join(map(str, ids)), " " * (chunk[0] == MARK) + self.vocab.decode(ids)

    def rows(self, text: str) -> list[tuple[int, str, str]]:
        """The table's rows of a text's chunks, in order; none for the empty text."""
        return list(map(self.__getitem__, self.chunks.findall(MARK + text.replace(" ", MARK)))) if text else []


def encode_ids(table: ChunkTable, text: str) -> list[int]:
    return [int(i) for row in table.rows(text) for i in row[1].split(",")]


def encoded(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids): the piece ids of every row as array<int>, without begin or end ids.

    Null texts count as empty and have no ids.  Repeated rows are repeated; an empty table gives none.
    """
    small_batches(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(f"chunks {model_file}", lambda: ChunkTable(model_file))
        for batch in batches:
            ids = [encode_ids(table, t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>").withColumnRenamed("id", id_col)


def digests(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row of ``df``.

    The first digest is over the decimal ids joined by commas, the second over the
    decoded text in UTF-8.  Null texts count as empty; begin and end names inside a text are
    ordinary text.  Repeated rows are repeated; an empty table gives none.
    """
    small_batches(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = per_worker(f"chunks {model_file}", lambda: ChunkTable(model_file))
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1):
                rows = table.rows(text.as_py())
                n.append(sum([row[0] for row in rows]))
                ids.append(digest(",".join([row[1] for row in rows])))
                decoded.append(digest("".join([row[2] for row in rows])[1:]))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(
        run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    ).withColumnRenamed("id", id_col)
