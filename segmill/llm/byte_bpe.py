"""Byte-level BPE: encoding by tree concatenation, and decoding.

A text is cut in halves down to leaves of LEAF characters, wherever the cut falls.  Leaves are encoded on
their own, and neighbours are joined pair by pair: what stands around the join is encoded again, in
windows that grow until their first and last tokens are those that the two sides have there.

That settles the rest exactly, because a window ends either where every text is split (a letter before
another kind of character, say), or inside a long run of one kind, which the splitter leaves whole.  In
such a run tokens follow from the merges alone, and a row of tokens is what BPE gives if each two
neighbours are what it gives for the two; at an agreeing end they are a pair that a side has already.

Blocks of a long text are encoded in different tasks, and joined in rounds of a written table each.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm.common import documents, shared_table, text_of

#: Characters of a leaf.
LEAF = 4096
#: Characters of a text that one task encodes; longer texts are dealt out by blocks of so many.
BLOCK = 1 << 16
#: Neighbours that a task joins in one round.
ARITY = 16
#: Tokens of a first window, on each side of a join.
WINDOW = 6
#: Characters of one kind on both sides of a place inside a run.
MARGIN = 3
#: Fixed value: how byte-level BPE splits a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if it prints, else the next from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    """Encodes and decodes as the tokenizer file says."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, split = file["model"], file["pre_tokenizer"]
        if model["type"] != "BPE" or file["normalizer"] or split != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("not a plain byte-level BPE file")
        letters = byte_of()
        self.bytes = {i: bytes(letters[c] for c in token) for token, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(self.bytes) - len(merges)
        if any(model["vocab"][a + b] != first + k for k, (a, b) in enumerate(merges)):
            raise ValueError("ids must rise with the merges")
        self.special = {}
        for token in file["added_tokens"]:
            if any(token[k] for k in ("single_word", "lstrip", "rstrip", "normalized")):
                raise ValueError("only plain special tokens are known")
            self.special[token["content"]] = token["id"]
        self.encoding = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks={b: i for i, b in self.bytes.items()}, special_tokens={})
        self.bytes |= {i: text.encode() for text, i in self.special.items()}
        size = max(self.bytes) + 1
        if size > 1 << 16:
            raise ValueError("ids must fit in two bytes")
        self.pieces = [self.bytes.get(i, b"") for i in range(size)]
        self.names = [str(i) for i in range(size)]
        self.barriers = set(self.special.values())
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.kinds: dict[str, str] = {}

    def kind(self, char: str) -> str:
        """L letter, N number, S space or O other, as the library's splitter takes it."""
        found = self.kinds.get(char)
        if found is None:
            alike = [k for k, x in (("L", "a"), ("N", "1"), ("O", "!")) if len(self.splitter.pre_tokenize_str(x + char)) == 1]
            found = self.kinds[char] = alike[0] if alike else "S"
        return found

    def breaks(self, text: str, at: int) -> bool:
        """Whether a window may end here: where every text is split, or well inside a run of one kind."""
        before, after = self.kind(text[at - 1]), self.kind(text[at])
        if before != after:
            return before in "LN" or before == "O" and after != "L"
        around = text[at - MARGIN : at + MARGIN] if at >= MARGIN else ""
        return len(around) == 2 * MARGIN and text[at] != "'" and all(self.kind(c) == after for c in around)

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), "<u2")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the text that two texts, of these ids, make together."""
        if not len(left) or not len(right) or int(left[-1]) in self.barriers or int(right[0]) in self.barriers:
            return np.concatenate([left, right])
        reach = WINDOW
        while True:
            before, after = left[max(0, len(left) - reach) :].tolist(), right[:reach].tolist()
            for k in range(len(before) - 1, -1, -1):  # a special token is as good as the text's end
                if before[k] in self.barriers:
                    before, whole_left = before[k + 1 :], True
                    break
            else:
                whole_left = reach >= len(left)
            stop = next((k for k, i in enumerate(after) if i in self.barriers), None)
            whole_right = stop is not None or reach >= len(right)
            after = after[:stop] if stop is not None else after
            window = self._window(before, after, whole_left, whole_right)
            if window is not None:
                skip, ids, take = window
                return np.concatenate([left[: len(left) - len(before) + skip], ids, right[take:]])
            reach *= 2

    def _window(self, before: list[int], after: list[int], whole_left: bool, whole_right: bool) -> tuple[int, np.ndarray, int] | None:
        """(tokens of before that stay, ids between, tokens of after that go in), or None where no window of these agrees."""
        parts = [self.pieces[i] for i in before + after]
        raw = b"".join(parts)
        ends = np.cumsum([len(p) for p in parts]).tolist()
        starts = [0, *ends[:-1]]
        lead = next((k for k in range(min(4, len(raw))) if raw[k] & 0xC0 != 0x80), len(raw))
        text = raw[lead:].decode("utf-8", "ignore")  # what is left of a character at the ends goes
        if len(text) == len(raw):
            places = None
        else:
            places = {0 if whole_left else lead: 0}
            for n, k in enumerate(k for k in range(lead, len(raw)) if raw[k] & 0xC0 != 0x80):
                places[k] = n
        at = (lambda k: k) if places is None else places.get

        def allowed(k: int) -> bool:
            n = at(k)
            return n is not None and 0 < n < len(text) and self.breaks(text, n)

        m = len(before)
        first = 0 if whole_left else next((t for t in range(1, m) if allowed(starts[t])), None)
        last = len(parts) if whole_right else next((t for t in range(len(parts) - 1, m, -1) if allowed(starts[t])), None)
        if first is None or last is None:
            return None
        ids = self.leaf(raw[starts[first] : ends[last - 1]].decode("utf-8"))
        same_left = first == 0 and whole_left or int(ids[0]) == before[first]
        same_right = last == len(parts) and whole_right or int(ids[-1]) == after[last - m - 1]
        return (first, ids, last - m) if same_left and same_right else None

    def joined(self, nodes: Sequence[np.ndarray]) -> np.ndarray:
        """Neighbours joined as a tree."""
        while len(nodes) > 1:
            nodes = [self.join(*nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
        return nodes[0] if nodes else np.array([], "<u2")

    def span(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens, by halves."""
        if len(text) <= LEAF:
            return self.leaf(text)
        half = len(text) // 2
        return self.join(self.span(text[:half]), self.span(text[half:]))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: special tokens stand for themselves, what is between them is encoded by halves."""
        for special, i in self.special.items():
            if special in text:
                parts = [self.encode(part) for part in text.split(special)]
                mark = np.array([i], "<u2")
                return np.concatenate([x for k, part in enumerate(parts) for x in ([mark, part] if k else [part])])
        return self.span(text)

    def cuts(self, text: str, size: int) -> list[int]:
        """Ends of blocks of about `size` characters, none inside a special token."""
        found, at, longest = [], 0, max(map(len, self.special), default=0)
        while at + size < len(text):
            end = at + size
            for special in self.special:
                k = text.find(special, max(at, end - longest + 1), end + longest)
                if 0 <= k < end < k + len(special):
                    end = k if k > at else k + len(special)
            found.append(end)
            at = end
        return [*found, len(text)]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids.tolist()])

    def digests(self, ids: np.ndarray) -> tuple[int, str, str]:
        """How many ids, the digest of their decimals with commas, the digest of the decoded text."""
        names, listed = self.names, hashlib.sha256()
        for k in range(0, len(ids), BLOCK):
            listed.update((b"," if k else b"") + ",".join([names[i] for i in ids[k : k + BLOCK].tolist()]).encode())
        return len(ids), listed.hexdigest(), hashlib.sha256(self.decode(ids).encode("utf-8", "surrogatepass")).hexdigest()


_known: dict[str, ByteBpe] = {}


def _bpe(path: str) -> ByteBpe:
    """A Python worker keeps its tables from task to task."""
    if path not in _known:
        _known[path] = ByteBpe(path)
    return _known[path]


#: What an encoder makes of a row's ids: the columns' types, and their values.
Finish = tuple[str, list[pa.DataType], Callable[[ByteBpe, np.ndarray], tuple]]
IDS: Finish = ("ids binary", [pa.binary()], lambda bpe, ids: (ids.tobytes(),))
DIGESTS: Finish = ("n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.string(), pa.string()], lambda bpe, ids: bpe.digests(ids))


def _columns(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def encode(docs: DataFrame, path: str | None = None, finish: Finish = IDS, block: int = BLOCK) -> DataFrame:
    """doc_id and the ids (two bytes each, lowest first) of every row's whole text.

    `finish` may make something else of the ids.  A null text is an empty one and has no
    ids.  Repeated rows stay.  Texts of up to `block` bytes are encoded where they are
    read; blocks of longer ones are dealt out to all tasks and joined in rounds, 16
    neighbours each, so only the last round holds the ids of a whole text in one task.  An
    empty table gives an empty one; other columns are not looked at.
    """
    path, (kinds, types, make) = path or tokenizer_path(), finish
    schema, names = f"doc_id long, {kinds}", ["doc_id", *_columns(kinds)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def finished(bpe: ByteBpe, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        made = [make(bpe, x) for x in ids]
        return pa.RecordBatch.from_arrays([doc_ids.cast(pa.int64()), *(pa.array([m[k] for m in made], kind) for k, kind in enumerate(types))], names)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            yield finished(bpe, batch.column("doc_id"), [bpe.encode(t) for t in batch.column("text").to_pylist()])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, schema = _bpe(path), pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("nodes", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for r in batch.to_pylist():
                ends = bpe.cuts(r["text"], block)
                for node, (start, end) in enumerate(zip([0, *ends], ends, strict=False)):
                    yield pa.RecordBatch.from_pylist([{"row": r["row"], "doc_id": r["doc_id"], "node": node, "nodes": len(ends), "text": r["text"][start:end]}], schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            ids = pa.array([bpe.encode(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "node", "nodes")), ids], ["row", "doc_id", "node", "nodes", "ids"])

    def neighbours(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        ids = _bpe(path).joined([np.frombuffer(x, "<u2") for x in part.column("ids").to_pylist()])
        first = part.slice(0, 1)
        return pa.Table.from_arrays([first.column("row"), first.column("doc_id"), first.column("up"), pa.array([-(-first.column("nodes")[0].as_py() // ARITY)], pa.int64()), pa.array([ids.tobytes()], pa.binary())], ["row", "doc_id", "node", "nodes", "ids"])

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            yield finished(bpe, batch.column("doc_id"), [np.frombuffer(x, "<u2") for x in batch.column("ids").to_pylist()])

    long = F.octet_length("text") > block
    node_schema = "row long, doc_id long, node long, nodes long, ids binary"
    pieces = rows.where(long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row long, doc_id long, node long, nodes long, text string")
    nodes = shared_table(pieces.repartition("row", "node").mapInArrow(blocks, node_schema), "bpe-blocks")
    most = nodes.agg(F.max("nodes")).first()[0] or 1
    while most > 1:
        up = nodes.withColumn("up", F.floor(F.col("node") / F.lit(ARITY)))
        nodes = shared_table(up.groupBy("row", "up").applyInArrow(neighbours, node_schema), "bpe-joined")
        most = -(-most // ARITY)
    return rows.where(~long).mapInArrow(short, schema).unionAll(nodes.mapInArrow(done, schema))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of ids as `encode` gives them; null ids are none.  Bytes that are no UTF-8 become U+FFFD."""
    path = path or tokenizer_path()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(np.frombuffer(x or b"", "<u2")) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(texts, "doc_id long, text string")


def op12_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), finish=DIGESTS)
