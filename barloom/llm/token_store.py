"""Token ids in raw binary shards with a minimal perfect hash index.

A store is a folder of shards in ascending key order.  For shard n:

``ids-n.bin``
    The ids of its documents one after the other, each closed by the end id, as
    little-endian unsigned integers of 2 bytes (4 for vocabularies above 65 536).
``ids-n.mph``
    A header, the end of every document in the payload, and the index: levels of bit
    arrays that give each of the shard's n keys its own slot 0 to n - 1, and per slot a
    32-bit fingerprint of the key, its first document and its number of documents.
``manifest``
    A Parquet table with one row per shard: first and last key, documents, ids.

A key is found in constant time: shard by key range, slot by the hash levels, check of the
fingerprint, offset.  A key that the store lacks passes the check once in 2**32 cases.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import Kept, partitions, per_worker, ship, small_batches

ship(__name__)

MAGIC = b"IDSTORE1"
HEADER = "<8sIIQQQQ"  # magic, bytes per id, hash levels, docs without key, docs, keys, ids
# Bits of a level for each key that is still without a slot.
SPREAD = 2
# Punctuation that ends a word and is a token sequence of its own behind letters.
TAIL = ".,!?;:#*$%&|<>()-\"/"


# --- minimal perfect hash -------------------------------------------------------------


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit mix of the keys, a different one for each salt."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


FINGERPRINT_SALT = 1_000


@dataclass
class PerfectHash:
    """Levels of bit arrays; the slot of a key is the number of set bits before its own."""

    levels: list[np.ndarray]

    def __post_init__(self):
        bits = np.concatenate([np.unpackbits(x, bitorder="little") for x in self.levels]) if self.levels else []
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        self.starts = np.cumsum([0] + [8 * len(x) for x in self.levels])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct int64 keys.  A key alone at its bit of a level is settled there."""
        levels, left = [], keys
        while len(left):
            size = -(-max(8, SPREAD * len(left)) // 8) * 8
            at = mixed(left, len(levels)) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at.astype(np.int64)]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 if no level has a bit for it, which only foreign keys meet."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, packed in enumerate(self.levels):
            at = (mixed(keys[todo], level) % np.uint64(8 * len(packed))).astype(np.int64)
            hit = (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[todo[hit]] = self.rank[self.starts[level] + at[hit]]
            todo = todo[~hit]
        return out


# --- shards ---------------------------------------------------------------------------


def _id_type(width: int) -> str:
    return f"<u{width}"


class Encoded(Kept):
    """text -> its ids as bytes of the payload, by the library."""

    def __init__(self, vocab, width: int):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.vocab, self.kind = vocab, _id_type(width)
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)

    def make(self, text: str) -> bytes:
        return np.array(self.vocab.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def word(self, word: str) -> bytes:
        """The same for lower-case Latin letters, which nothing before the merges changes or splits."""
        plain = word if word.isascii() else self.as_bytes.pre_tokenize_str(word)[0][0]
        return np.array([token.id for token in self.vocab.model.tokenize(plain)], dtype=self.kind).tobytes()


class Words(Encoded):
    """lower-case Latin word -> its ids."""

    def make(self, text: str) -> bytes:
        return self.word(text)


class WordTable(Kept):
    """white-space free chunk -> its ids as bytes of the payload.

    The vocabulary drops white space and never merges across it, so the ids of a text
    are those of its chunks in order.  It also lower-cases, and splits letters from what is no
    letter, so chunks such as ``Word,`` and ``word.`` share the ids of ``word``.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        vocab = Tokenizer.from_file(tokenizer_file)
        vocab.no_padding()
        vocab.no_truncation()
        one, *rest = (
            [i for part in parts for i in vocab.encode(part, add_special_tokens=False).ids]
            for parts in (["Ab cdé..."], ["ab \t\n cdé..."], ["AB", "cdé..."], ["ab", "CdÉ", "..."])
        )
        if any(other != one for other in rest):
            raise ValueError("only vocabularies that lower-case, drop white space and split letters off are encoded by chunks")
        self.width = 2 if vocab.get_vocab_size(with_added_tokens=True) <= 65_536 else 4
        self.words, self.rest = Words(vocab, self.width), Encoded(vocab, self.width)
        straight = b"".join(map(self.words.word, ("ab", "cdé"))) + self.rest["..."]
        if straight != np.array(one, dtype=_id_type(self.width)).tobytes():
            raise ValueError("only byte-level vocabularies are encoded by words")

    def make(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        word = chunk.rstrip(TAIL)
        # Latin letters: each has one lower-case form, whatever stands beside it.
        if word.isalpha() and (word.isascii() or (max(word) < "\u0370" and "\u0130" not in word)):
            tail = chunk[len(word) :]
            return self.words[word.lower()] + (self.rest[tail] if tail else b"")
        return self.rest.make(chunk)

    def payload(self, text: str, end: bytes) -> bytes:
        chunks = text.replace("\n", " ").replace("\t", " ").split(" ")
        return b"".join([*map(self.__getitem__, chunks), end])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _files(root: str, shard: int) -> tuple[str, str]:
    return f"{root}/ids-{shard:06d}.bin", f"{root}/ids-{shard:06d}.mph"


def index_bytes(width: int, keys: np.ndarray, keyless: int, lengths: np.ndarray) -> bytes:
    """The index file: ``keys`` ascending with one entry per keyed document, after the keyless ones."""
    own, first, count = np.unique(keys, return_index=True, return_counts=True)
    table = PerfectHash.build(own)
    slot = table.slots(own)
    marks, firsts, counts = np.empty(len(own), "<u4"), np.empty(len(own), "<u8"), np.empty(len(own), "<u4")
    marks[slot] = mixed(own, FINGERPRINT_SALT) >> np.uint64(32)
    firsts[slot], counts[slot] = first + keyless, count
    ends = np.cumsum(lengths).astype("<u8")
    head = struct.pack(HEADER, MAGIC, width, len(table.levels), keyless, len(lengths), len(own), int(lengths.sum()))
    sizes = np.array([len(x) for x in table.levels], dtype="<u8")
    parts = [sizes, *table.levels, ends, marks, firsts, counts]
    return head + b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


class ShardIndex:
    """An index file in memory."""

    def __init__(self, raw: bytes):
        magic, self.width, levels, self.keyless, docs, keys, self.ids = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not an index file")
        self.at = struct.calcsize(HEADER)

        def take(n: int, kind: str) -> np.ndarray:
            got = np.frombuffer(raw, dtype=kind, count=n, offset=self.at)
            self.at += got.nbytes
            return got

        self.hash = PerfectHash([take(int(n), "u1") for n in take(levels, "<u8")])
        ends = take(docs, "<u8").astype(np.int64)
        self.bounds = np.concatenate([[0], ends])
        self.marks, self.firsts, self.counts = take(keys, "<u4"), take(keys, "<u8").astype(np.int64), take(keys, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``keys``, first document, documents) of the keys that the shard has."""
        slot = self.hash.slots(keys)
        at = np.nonzero(slot >= 0)[0]
        same = self.marks[slot[at]] == (mixed(keys[at], FINGERPRINT_SALT) >> np.uint64(32)).astype("<u4")
        at = at[same]
        return at, self.firsts[slot[at]], self.counts[slot[at]].astype(np.int64)


def write_store(
    df: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 1,
    shards: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> TokenStore:
    """Encode every whole text of ``df`` and write a store to ``path``, keyed by the integer ``id_col``.

    Documents lie in ascending key order, rows without a key first, rows of one key by a
    hash of their text; a key of very many rows may go on in the next shards.  Null
    texts count as empty: only the end id.  No special tokens are added; their names
    inside a text become what the vocabulary makes of them.  An empty table gives an empty store.
    A repeated task writes the same bytes and replaces a file in one step.
    """
    spark = df.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        where, root = _place(path)
        where.create_dir(root, recursive=True)
        finals = _files(root, shard)
        drafts = [f"{f}.{uuid.uuid4().hex}" for f in finals]
        table = per_worker(f"words {tokenizer_file}", lambda: WordTable(tokenizer_file))
        end = np.array([end_id], dtype=_id_type(table.width)).tobytes()
        keys, lengths, keyless = [], [], 0
        with where.open_output_stream(drafts[0]) as out:
            batch = first
            while batch is not None:
                sizes = []
                for text in batch.column(1):
                    data = table.payload(text.as_py(), end)
                    sizes.append(len(data) // table.width)
                    out.write(data)
                keyless += batch.column(0).null_count
                keys.append(batch.column(0).drop_null().to_numpy())
                lengths.append(np.array(sizes, dtype=np.int64))
                batch = next(batches, None)
        own, sizes = np.concatenate(keys).astype(np.int64), np.concatenate(lengths)
        with where.open_output_stream(drafts[1]) as out:
            out.write(index_bytes(table.width, own, keyless, sizes))
        for draft, final in zip(drafts, finals):
            where.move(draft, final)
        low, high = (None, None) if not len(own) else (int(own[0]), int(own[-1]))
        row = {"shard": [shard], "keyless": [keyless], "low": [low], "high": [high], "docs": [len(sizes)], "ids": [int(sizes.sum())]}
        yield pa.RecordBatch.from_pydict(row, pa.schema([(k, pa.int64()) for k in row]))

    rows = df.select(
        F.col(id_col).cast("long").alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.xxhash64(text_col).alias("tie"),
    )
    order = [F.asc_nulls_first("key"), F.asc("tie")]
    ranged = rows.repartitionByRange(shards or partitions(df), *order).sortWithinPartitions(*order).select("key", "text")
    made = ranged.mapInArrow(run, "shard long, keyless long, low long, high long, docs long, ids long")
    made.write.mode("overwrite").parquet(f"{path.rstrip('/')}/manifest")
    return TokenStore(spark, path)


class TokenStore:
    """Keyed access to a store; the manifest has one row per shard."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        rows = spark.read.parquet(f"{path.rstrip('/')}/manifest").orderBy("shard").collect()
        self.shards = np.array([r["shard"] for r in rows], dtype=np.int64)
        sizes = np.array([r["ids"] for r in rows], dtype=np.int64)
        self.base = {int(s): int(b) for s, b in zip(self.shards, np.cumsum(sizes) - sizes)}
        keyed = [r for r in rows if r["low"] is not None]
        self.keyed = np.array([r["shard"] for r in keyed], dtype=np.int64)
        self.low = np.array([r["low"] for r in keyed], dtype=np.int64)
        self.high = np.array([r["high"] for r in keyed], dtype=np.int64)
        self.keyless = np.array([r["shard"] for r in rows if r["keyless"]], dtype=np.int64)

    def routes(self, key: int | None) -> np.ndarray:
        """The shards that can hold a key; more than one only for keys of very many rows."""
        if key is None:
            return self.keyless
        return self.keyed[np.searchsorted(self.high, key, "left") : np.searchsorted(self.low, key, "right")]

    def lookup(self, keys: DataFrame, key_col: str, ids: bool = False) -> DataFrame:
        """One row for each stored document of each distinct key of ``keys``.

        Columns: key_col, start (ids of all documents before it), n_tokens, ids_crc32 (of
        the ids as little-endian unsigned 32-bit integers) and, if asked for, ids.  Keys that the store lacks give no row.
        """
        routes, base, path = self.routes, self.base, self.path

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = batch.column(0).to_pylist()
                to = [routes(key) for key in wanted]
                n = [len(x) for x in to]
                where = np.concatenate([np.empty(0, np.int64), *to])
                copied = batch.column(0).take(pa.array(np.repeat(np.arange(len(wanted)), n)))
                yield pa.RecordBatch.from_arrays([copied, pa.array(where)], names=["key", "shard"])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            where, root = _place(path)
            shard, index, payload = None, None, None
            for batch in batches:
                at_shard = batch.column(1).to_numpy()
                bounds = np.flatnonzero(np.r_[True, at_shard[1:] != at_shard[:-1], True]) if len(at_shard) else [0]
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    if shard != at_shard[lo]:
                        shard = int(at_shard[lo])
                        files = _files(root, shard)
                        with where.open_input_stream(files[1]) as file:
                            index = ShardIndex(file.read())
                        payload = where.open_input_file(files[0])
                    yield from found(batch.column(0).slice(lo, hi - lo), shard, index, payload)

        def found(wanted: pa.Array, shard: int, index: ShardIndex, payload) -> Iterator[pa.RecordBatch]:
            names, docs = [], []
            if wanted.null_count:
                names += [None] * index.keyless
                docs += range(index.keyless)
            own = wanted.drop_null().to_numpy()
            for at, first, count in zip(*(x.tolist() for x in index.find(own))):
                names += [int(own[at])] * count
                docs += range(first, first + count)
            out = {"key": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for name, doc in zip(names, docs):
                lo, hi = int(index.bounds[doc]), int(index.bounds[doc + 1])
                raw = payload.read_at((hi - lo) * index.width, lo * index.width)
                wide = np.frombuffer(raw, dtype=_id_type(index.width)).astype("<u4")
                out["key"].append(name)
                out["start"].append(base[shard] + lo)
                out["n_tokens"].append(hi - lo)
                out["ids_crc32"].append(zlib.crc32(wide.tobytes()))
                out["ids"].append(wide.astype(np.int64) if ids else None)
                if len(out["key"]) == 1000:
                    yield made(out)
                    out = {k: [] for k in out}
            if out["key"]:
                yield made(out)

        def made(out: dict) -> pa.RecordBatch:
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
            return pa.RecordBatch.from_pydict(out, pa.schema(list(zip(out, kinds))))

        small_batches(keys.sparkSession)
        distinct = keys.select(F.col(key_col).cast("long").alias("key")).distinct()
        routed = distinct.mapInArrow(route, "key long, shard long")
        dealt = routed.repartition(partitions(keys), "shard").sortWithinPartitions("shard", "key")
        got = dealt.mapInArrow(read, "key long, start long, n_tokens long, ids_crc32 long, ids array<long>")
        got = got.withColumnRenamed("key", key_col)
        return got if ids else got.drop("ids")
