"""Token counts by byte-pair merging over a heap and a linked list.

Symbols of a chunk form a linked list; a heap holds the adjacent pairs that the
vocabulary knows, lowest rank first.  Each pop merges two symbols, so the count is the
number of first symbols minus the number of merges; no ids are made.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Kept, per_worker, ship, small_batches

ship(__name__)

MARK = "▁"
# Characters from which the chunks of a text are not listed at once.
LONG_TEXT = 1_000_000


class MergeCounter(Kept):
    """chunk -> number of tokens, for a BPE vocabulary in a sentencepiece model file."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        super().__init__()
        vocab = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as file:
            spec.ParseFromString(file.read())
        rules = spec.normalizer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        if spec.trainer_spec.model_type != spec.trainer_spec.BPE or rules.precompiled_charsmap or not plain:
            raise ValueError("only BPE models without text normalization are counted here")
        self.rank: dict[str, float] = {}
        fallback = False
        for i in range(vocab.get_piece_size()):
            if vocab.is_unused(i) or spec.pieces[i].type == spec.pieces[i].USER_DEFINED:
                raise ValueError("unused and user-defined pieces are not supported")
            fallback = fallback or vocab.is_byte(i)
            if not (vocab.is_control(i) or vocab.is_unknown(i) or vocab.is_byte(i)):
                self.rank[vocab.id_to_piece(i)] = -vocab.get_score(i)
        self.fallback = fallback
        if any(re.search(f"[^{MARK}]{MARK}", piece) for piece in self.rank):
            raise ValueError("pieces cross word marks")
        # A mark starts a chunk; so does a line break if no piece has one.
        stop = "" if any("\n" in piece for piece in self.rank) else "\n"
        self.chunks = re.compile(f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + (f"|{stop}+" if stop else ""))

    def first_cost(self, symbol: str) -> int:
        """Tokens of one unmerged character: its bytes if the vocabulary lacks it."""
        return 1 if symbol in self.rank or not self.fallback else len(symbol.encode())

    def make(self, chunk: str) -> int:
        rank, symbols, size = self.rank, list(chunk), len(chunk)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        cost = list(map(self.first_cost, symbols))
        count = sum(cost)
        heap = []

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            if (at := rank.get(piece)) is not None:
                heapq.heappush(heap, (at, i, piece))

        for i in range(size - 1):
            offer(i, i + 1)
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= size or symbols[i] + symbols[j] != piece:
                continue  # one of the two has since been merged
            count -= cost[i] + cost[j] - 1
            symbols[i], symbols[j], cost[i] = piece, "", 1
            after[i] = after[j]
            if after[j] < size:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if len(marked) > LONG_TEXT:
            return sum(self[m.group()] for m in self.chunks.finditer(marked))
        return sum(map(self.__getitem__, self.chunks.findall(marked)))


def token_counts(
    df: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of ``df``.

    Null texts count as empty: no bytes, no tokens.  Begin, end and other special tokens
    are not added, and their names inside a text are ordinary text.  Repeated rows
    are repeated; an empty table gives none; further columns of ``df`` are ignored.
    """
    small_batches(df.sparkSession)
    id_type = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_worker(f"merges {model_file}", lambda: MergeCounter(model_file))
        for batch in batches:
            n = [counter.count(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    counted = rows.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
