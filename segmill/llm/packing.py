"""Packing documents into sequences along a space-filling curve.

Each document's tokens give a hashed vector: every token id adds a fixed random
sign to each of a few dimensions.  The vector, scaled by its length, is cut
into a grid of equal chances, and the grid cell's place on the Hilbert curve is
the document's key.  Tokens are written once to the shared folder.  The curve is
cut into ranges of equal bytes, whose ends follow from the exact bytes of its
cells, and each task lays the documents of its range end to end and cuts them at
the sequence length, so neighbours on the curve share sequences.

What is left at the end of a task's range is cut at powers of two, which need
no padding.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

LENGTH = 2048
END_ID = 1
DIMENSIONS = 4
BITS = 10
#: Words whose ids a Python worker remembers, and as many that it remembered before.
CACHE_WORDS = 500_000
#: Of these so many go on to a worker's next task.
KEPT_WORDS = 150_000
#: Marks behind a word of letters that are split off.
TAILS = b".,!*#&%$|;:?"
#: A partition of the packed table gets about so many token bytes.
PARTITION_BYTES = 24 << 20
#: The curve has 2 to the power of this cells, whose bytes are counted.
CELL_BITS = 16


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, two bytes each, through a memory of words.

    The tokenizer drops white space and splits at it, so a text's ids are its
    words' ids in a row.  It also lower-cases, so words differing in A-Z only
    share an entry.  Texts that may hold special tokens go to it whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _learn_plain(self, words: list[bytes]) -> None:
        """Letter-only words go in joined: each is one run of ids up to a word end."""
        for i in range(0, len(words), 1024):
            part = words[i : i + 1024]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode("utf-8")], add_special_tokens=False)[0].ids, "<u2")
            stops = (np.flatnonzero(self.ends[ids]) * 2 + 2).tolist()
            if len(stops) == len(part):
                raw, starts = ids.tobytes(), [0, *stops[:-1]]
                self.known.update({w: raw[a:b] for w, a, b in zip(part, starts, stops, strict=True)})
            else:
                self.known.update({w: self._ids(w.decode("utf-8")) for w in part})

    def _learn(self, words: set[bytes]) -> None:
        """Remember all of these words.  A full memory becomes the old one, from which words in use come back."""
        if len(self.known) > CACHE_WORDS:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        plain, stems = [], []
        missing = list(words.difference(known))
        for w, text in zip(missing, b" ".join(missing).decode("utf-8").split(" "), strict=False):
            if w in old:
                known[w] = old[w]
            elif text.isalpha():
                plain.append(w)
            else:
                stem = w.rstrip(TAILS)
                if stem and len(stem) < len(w) and text[: len(stem) - len(w)].isalpha():
                    stems.append((w, stem, w[len(stem) :]))
                else:
                    known[w] = self._ids(text)
        parts = {x for _, stem, tail in stems for x in (stem, tail) if x not in known}
        known.update({x: old[x] for x in parts if x in old})
        tails = [x for x in parts if x not in old and x[:1] in TAILS]
        known.update({x: self._ids(x.decode("utf-8")) for x in tails})
        self._learn_plain(list({*plain, *(x for x in parts if x not in known)}))
        known.update({w: known[stem] + known[tail] for w, stem, tail in stems})

    def trim(self, keep: int) -> None:
        """Forget all but the words met first, which are the frequent ones."""
        self.known, self.old = dict(islice(self.known.items(), keep)), {}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        found = []
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            split = [None if "<|" in t else t.encode("utf-8").lower().split() for t in part]
            self._learn(set().union(*[w for w in split if w]))
            known = self.known
            found += [self._ids(t) if words is None else b"".join([known[w] for w in words]) for t, words in zip(part, split, strict=True)]
        return found


_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """A Python worker keeps its encoder from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of the grid points cells[n, d], each below 2**bits.

    The usual way by Gray codes: exchanges and inversions from the top bit down,
    Gray decoding over the axes, then the axes' bits are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    for b in range(bits - 1, 0, -1):
        q, below = 1 << b, (1 << b) - 1
        for i in range(d):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[d - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _signs(dimensions: int) -> np.ndarray:
    """int8[65536, dimensions]: +1 or -1 by token id, always the same."""
    return np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (1 << 16, dimensions))


def _cells(sums: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """Grid points: squashed so that typical documents spread over the grid."""
    scaled = sums / np.sqrt(np.maximum(lengths, 1))[:, None] / 4
    return np.clip(((np.tanh(scaled) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (two bytes each, end_id included), n long, curve long of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, signs, end = _encoder(path), _signs(DIMENSIONS), np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = [x + end for x in encoder.encode_all(batch.column("text").to_pylist())]
            lengths = np.array([len(x) // 2 for x in ids])
            sums = np.array([signs[np.frombuffer(x, "<u2")].sum(0, dtype=np.int64) for x in ids]).reshape(len(ids), DIMENSIONS)
            curve = hilbert_keys(_cells(sums, lengths, BITS), BITS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(lengths, pa.int64()), pa.array(curve, pa.int64())], ["doc_id", "ids", "n", "curve"])
        encoder.trim(KEPT_WORDS)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(rows, "doc_id long, ids binary, n long, curve long")


def cut(ids: np.ndarray, fill: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document laid down where a sequence holds fill ids."""
    at, pieces = 0, []
    while at < len(ids):
        take = min(length - fill, len(ids) - at)
        pieces.append((at, take))
        at, fill = at + take, (fill + take) % length
    return pieces


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def _pack(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pd.DataFrame]:
    """Lay the documents of a task end to end.  Only the open sequence's pieces wait for the end."""
    part = TaskContext.get().partitionId() << 40
    sequence, fill = 0, 0
    held: list[tuple] = []  # pieces of the open sequence, with their ids

    def row(doc, start, ids, total, seq, offset):
        return (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, part + seq, offset)

    for batch in batches:
        out = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(raw, "<u2")
            for start, n in cut(ids, fill, length):
                held.append((doc, start, ids[start : start + n], len(ids), fill))
                fill += n
                if fill == length:
                    out += [row(d, s, x, t, sequence, o) for d, s, x, t, o in held]
                    sequence, fill, held = sequence + 1, 0, []
        yield pd.DataFrame(out, columns=PIECE)
    out, ends = [], np.cumsum(powers(fill)).tolist()
    for d, s, x, t, o in held:  # the tail
        while len(x):
            k = next(i for i, e in enumerate(ends) if e > o)
            n = min(len(x), ends[k] - o)
            out.append(row(d, s, x[:n], t, sequence + k, o - (ends[k - 1] if k else 0)))
            s, o, x = s + n, o + n, x[n:]
    yield pd.DataFrame(out, columns=PIECE)


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECE_SCHEMA = ", ".join(f"{c} long" for c in PIECE)


def ranged(tokens: DataFrame, partition_bytes: int) -> DataFrame:
    """tokens, dealt out by ranges of the curve that hold equal bytes, each sorted along the curve.

    A cell that lies across ends of ranges, or holds many ranges as copies do,
    is shared out among them by a hash.  A range is larger than the others by one
    document at most, as far as hashes are even.
    """
    cell = F.shiftright("curve", DIMENSIONS * BITS - CELL_BITS)
    counted = tokens.groupBy(cell.alias("__cell")).agg(F.sum("n").alias("n")).orderBy("__cell").collect()  # a row a cell
    ends = np.cumsum([2 * r["n"] for r in counted], dtype=np.int64).tolist()
    total = ends[-1] if ends else 0
    partitions = max(tokens.sparkSession.sparkContext.defaultParallelism, -(-total // partition_bytes))
    cells = [(r["__cell"], float(end - 2 * r["n"]), float(2 * r["n"])) for r, end in zip(counted, ends, strict=True)]
    cells = tokens.sparkSession.createDataFrame(cells, "__cell long, __from double, __size double")
    spread = F.xxhash64("doc_id", "n")
    inside = F.shiftrightunsigned(spread, 40) / F.lit(float(1 << 24))
    place = F.least(F.lit(partitions - 1), F.floor((F.col("__from") + inside * F.col("__size")) * F.lit(partitions / max(1, total)))).cast("int")
    placed = tokens.withColumn("__cell", cell).join(F.broadcast(cells), "__cell").withColumn("__range", place)
    return placed.repartitionById(partitions, F.col("__range")).sortWithinPartitions("curve", spread).drop("__cell", "__from", "__size", "__range")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row lies in one piece; a null or empty text has its end id
    only.  Sequences hold `length` ids, except those at the end of a range,
    which hold a power of two.  Rows that repeat a doc_id are separate documents
    with their own pieces.  Documents on one place of the curve, such as copies,
    are spread by doc_id and may lie in several ranges.  A long document spans
    sequences and never more than one is held open.  An empty table gives an
    empty one.  Other columns of docs are not looked at.
    """
    tokens = shared_table(tokenized(docs, path or tokenizer_path(), end_id), "pack-tokens")
    laid = ranged(tokens, partition_bytes).select("doc_id", "ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _pack(batches, length):
            yield pa.RecordBatch.from_arrays([pa.array(frame[c], pa.int64(), from_pandas=True) for c in PIECE], PIECE)

    return laid.mapInArrow(rows, PIECE_SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
