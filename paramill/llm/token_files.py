"""Token ids in grammar-compressed binary blocks (Re-Pair).

A block holds the ids of consecutive documents. Pairs of neighbouring symbols that occur often
are replaced by a new symbol, round after round, each round taking the most frequent pairs at
once; rules never reach over the end of a document. A block stores the rules, how many ids each
rule stands for, where every document begins among the symbols and among the ids, and the
remaining symbols in two bytes each, so one document is decoded by reading its own symbols.

Blocks are rows of a Parquet table in the shared folder (shard, block, n_docs, n_ids, blob), in
ascending doc_id order over shards and blocks: any store that Spark writes to can hold them, and
a task that is lost writes its blocks again.

Defined cases: null text counts as empty and has only the end id; a null doc_id sorts first;
rows that share a doc_id follow one another ordered by a hash of their text; an empty table gives
no blocks. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paramill.llm.chunk_ids import chunk_ids
from paramill.llm.common import arrow_map, whole_text, written

MAGIC = b"RPAIRv1\0"
VOCABULARY = 49_408
#: Ids that a block gathers before it is closed; a document is never split over blocks.
BLOCK_IDS = 1 << 20
#: Pairs replaced at a time, and the least occurrences that make a rule (a rule takes eight bytes).
PAIRS, LEAST = 4096, 12
BIN_BITS = 18
BLOCK = "shard int, block int, n_docs long, n_ids long, blob binary"
DOC = "shard int, block int, place long, doc_id long, start_in_block long, n_tokens long, ids_crc32 long"


def _frequent(symbols: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent of the pairs that begin at the places ``live``, ascending; where they occur; which
    of them occurs there; the places whose pair may be frequent in another round.

    A count of hash bins finds what can be frequent; counts are exact for pairs of the fullest. A pair of a
    bin that is not full enough never comes to be frequent, for rounds only make pairs with new symbols.
    """
    codes = symbols[live].astype(np.uint32) << np.uint32(16) | symbols[live + 1]
    bins = (codes * np.uint32(2654435761)) >> np.uint32(32 - BIN_BITS)
    filled = np.bincount(bins, minlength=1 << BIN_BITS)
    fullest = filled[filled >= LEAST]
    least = int(np.partition(fullest, -PAIRS)[-PAIRS]) if len(fullest) > PAIRS else LEAST
    filled = filled.astype(np.int32)[bins]
    full = np.nonzero(filled >= least)[0]
    ordered = codes[full].astype(np.uint64) << np.uint64(32) | full.astype(np.uint64)
    ordered.sort()  # pairs and places in one number: faster than an order of the pairs
    code = (ordered >> np.uint64(32)).astype(np.uint32)
    starts = np.nonzero(np.concatenate([np.ones(min(1, len(code)), dtype=bool), code[1:] != code[:-1]]))[0]
    pairs, n = code[starts], np.diff(np.append(starts, len(code)))
    often = n >= LEAST
    if often.sum() > PAIRS:
        often[np.argsort(-n, kind="stable")[PAIRS:]] = False
    found = np.full(len(live), -1, dtype=np.int32)  # which pair occurs at a place
    found[(ordered & np.uint64(0xFFFFFFFF)).astype(np.int64)] = np.repeat(np.where(often, np.cumsum(often) - 1, -1), n)
    kept = np.nonzero(found >= 0)[0]
    return pairs[often], live[kept], found[kept], live[filled >= LEAST]


def repair(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs, in order of their symbols) and which symbols end a document.

    Goes on until no pair is frequent enough or the symbols of two bytes are used up.
    """
    symbols, rules, next_symbol = ids.astype(np.uint16), [], VOCABULARY
    live = np.nonzero(~ends[:-1])[0]  # places of pairs that may be frequent
    while len(live) and next_symbol < 1 << 16:
        chosen, at, which, live = _frequent(symbols, live)
        if not len(chosen):
            break
        if next_symbol + len(chosen) > 1 << 16:  # the most frequent ones that there are symbols for
            most = np.sort(np.argsort(-np.bincount(which), kind="stable")[: (1 << 16) - next_symbol])
            place = np.full(len(chosen), -1)
            place[most] = np.arange(len(most))
            inside = place[which] >= 0
            chosen, at, which = chosen[most], at[inside], place[which[inside]]
        # of pairs that overlap, the first, third, ... of the run are replaced
        order = np.arange(len(at))
        new_run = np.concatenate([[True], np.diff(at) != 1])
        first = (order - np.maximum.accumulate(np.where(new_run, order, 0))) % 2 == 0
        at, which = at[first], which[first]
        symbols[at] = next_symbol + which
        ends[at] = ends[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        may = np.zeros(len(symbols), dtype=bool)
        may[live] = may[at] = may[np.maximum(at, 1) - 1] = True  # pairs with a new symbol begin or end at one
        symbols, ends, may = symbols[keep], ends[keep], may[keep]
        live = np.nonzero(may[:-1] & ~ends[:-1])[0]
        rules.append(np.stack([chosen >> np.uint32(16), chosen & np.uint32(0xFFFF)], axis=1))
        next_symbol += len(chosen)
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.uint32)
    return symbols.astype("<u2"), pairs.astype("<u2"), ends


def _levels(rules: np.ndarray):
    """Places of rules whose parts are ids or rules of levels before, level by level."""
    sides = rules.astype(np.int64) - VOCABULARY
    known = np.zeros(len(rules) + 1, dtype=bool)
    known[-1] = True  # ids
    sides[sides < 0] = len(rules)
    while not known.all():
        level = np.nonzero(known[sides].all(axis=1) & ~known[:-1])[0]
        if not len(level):
            raise ValueError("a rule stands for itself")
        yield level
        known[level] = True


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """How many ids every rule stands for; a rule's parts come before it."""
    lengths = np.ones(VOCABULARY + len(rules), dtype=np.int64)
    for level in _levels(rules):
        lengths[VOCABULARY + level] = lengths[rules[level].astype(np.int64)].sum(axis=1)
    return lengths[VOCABULARY:]


def expansions(rules: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that every symbol stands for, laid end to end; where each begins; how long each is."""
    lengths = np.concatenate([np.ones(VOCABULARY, dtype=np.int64), rule_lengths(rules)])
    begin = np.cumsum(lengths) - lengths
    flat = np.zeros(int(lengths.sum()), dtype=np.uint32)
    flat[:VOCABULARY] = np.arange(VOCABULARY)
    for level in _levels(rules):
        n = lengths[VOCABULARY + level]
        to = np.repeat(begin[VOCABULARY + level] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        flat[to] = expand(rules[level].ravel(), (flat, begin, lengths))
    return flat, begin, lengths


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, begin, lengths = table
    at = symbols.astype(np.int64)
    n = lengths[at]
    total = int(n.sum())
    shift = np.repeat(begin[at] - (np.cumsum(n) - n), n)
    return flat[np.arange(total, dtype=np.int64) + shift].astype("<u4")


class Block:
    """One block, read back from its bytes."""

    def __init__(self, blob: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("these bytes are not a block")
        self.n_docs, n_rules, n_symbols, self.n_ids = struct.unpack_from("<4Q", blob, 8)
        at = 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        self.doc_ids = take("<i8", self.n_docs)
        self.null_ids = take("u1", self.n_docs)
        self.symbol_starts = take("<u8", self.n_docs + 1)
        self.id_starts = take("<u8", self.n_docs + 1)
        self.rules = take("<u2", 2 * n_rules).reshape(n_rules, 2)
        self.rule_lengths = take("<u4", n_rules)
        self.symbols = take("<u2", n_symbols)
        self._table = None

    def document(self, place: int) -> np.ndarray:
        """The ids of one document; no other document's symbols are read."""
        if self._table is None:
            self._table = expansions(self.rules)
        first, stop = self.symbol_starts[place : place + 2]
        return expand(self.symbols[int(first) : int(stop)], self._table)

    @staticmethod
    def pack(doc_ids: list[int | None], packed: list[bytes]) -> bytes:
        """Bytes of a block from documents' ids in four bytes each."""
        lengths = np.array([len(p) // 4 for p in packed], dtype=np.int64)
        ids = np.frombuffer(b"".join(packed), dtype="<u4")
        ends = np.zeros(len(ids), dtype=bool)
        id_starts = np.concatenate([[0], np.cumsum(lengths)])
        ends[id_starts[1:] - 1] = True  # no document is without its end id
        symbols, rules, ends = repair(ids, ends)
        symbol_starts = np.concatenate([[0], np.nonzero(ends)[0] + 1])
        lengths_of = rule_lengths(rules)
        nulls = np.array([d is None for d in doc_ids], dtype="u1")
        parts = (
            np.array([d or 0 for d in doc_ids], dtype="<i8"), nulls, symbol_starts.astype("<u8"), id_starts.astype("<u8"),
            rules, lengths_of.astype("<u4"), symbols,
        )
        head = MAGIC + struct.pack("<4Q", len(doc_ids), len(rules), len(symbols), len(ids))
        return head + b"".join(p.tobytes() for p in parts)


def write_blocks(docs: DataFrame, end_id: int = 2, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode all documents and write the blocks; the table that is read back from the files."""
    end = struct.pack("<I", end_id)

    def run(batches):
        shard, block = TaskContext.get().partitionId(), 0
        ids, packed, size = [], [], 0

        def closed():
            return pa.RecordBatch.from_pydict(
                {"shard": [shard], "block": [block], "n_docs": [len(ids)], "n_ids": [size // 4], "blob": [Block.pack(ids, packed)]},
                schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]),
            )

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), 256):
                for doc_id, p in zip(doc_ids[first : first + 256], chunk_ids().packed(texts[first : first + 256]), strict=True):
                    ids.append(doc_id)
                    packed.append(p + end)
                    size += len(p) + 4
                    if size >= 4 * block_ids:
                        yield closed()
                        ids, packed, size, block = [], [], 0, block + 1
        if ids:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(arrow_map(ordered, run, BLOCK), "token-blocks")


def block_starts(blocks: DataFrame) -> DataFrame:
    """shard, block, start: ids in all blocks before. Windows see one row per shard, then one per
    block of a shard; the blobs are not read."""
    sizes = blocks.select("shard", "block", "n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return placed.join(shards, "shard").select("shard", "block", (F.col("shard_start") + F.col("inside")).alias("start"))


def read_documents(blocks: DataFrame) -> DataFrame:
    """Decode every document of the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for shard, number, blob in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = Block(blob.as_py())
                ids = expand(block.symbols, expansions(block.rules)).tobytes()
                cuts = (4 * block.id_starts.astype(np.int64)).tolist()
                n = block.n_docs
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard.as_py()] * n, pa.int32()),
                        pa.array([number.as_py()] * n, pa.int32()),
                        pa.array(range(n), pa.int64()),
                        pa.array(block.doc_ids, mask=block.null_ids.astype(bool)),
                        pa.array(block.id_starts[:-1].astype(np.int64)),
                        pa.array(np.diff(block.id_starts.astype(np.int64))),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                    ],
                    names=[x.split()[0] for x in DOC.split(", ")],
                )

    rows = arrow_map(blocks.select("shard", "block", "blob"), run, DOC)
    return rows.join(block_starts(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("start") + F.col("start_in_block")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digest(docs: DataFrame) -> DataFrame:
    return read_documents(write_blocks(docs))
