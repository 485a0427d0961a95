"""Best-fit packing of tokenised documents into sequences.

Documents become byte-level BPE ids plus an end id; longer ones are cut into full pieces. Pieces are packed by a
bounded-space online best-fit: a fixed number of open bins, found through a bitset keyed by free space; a piece goes to
the bin with the least free space that holds it, and when too many bins are open the fullest closes first.
"""

from __future__ import annotations

import json
import math
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.shared import bounded_batches, stash, table

MAX_TOKENS, END_ID = 2048, 0
#: Bins that a packer holds open, and pieces that one packer takes (so many tasks work at any input size).
OPEN_BINS, SHARD_PIECES = 1024, 65_536
#: Pre-tokens that a worker remembers the ids of.
CACHED = 300_000

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_tokenizers: dict[str, PieceTokenizer] = {}


class PieceTokenizer:
    """Ids of whole texts by a byte-level BPE file of ``tokenizers``.

    The file's pre-tokenizer cuts a text by a fixed rule (a contraction; letters, digits or other signs, each with at
    most one space before; white space). The cuts are found for a whole text at once with numpy; each distinct
    pre-token is then encoded once by the library's BPE model and its ids are remembered.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        pre = rules.get("pre_tokenizer") or {}
        if rules.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE file without normalizer and prefix space")
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        signs = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            self.kinds[[ord(x) for x in regex.findall(pattern, signs)]] = kind
        self.known: dict[str, bytes] = {}
        # byte-level files name a printable byte by its own sign and the other bytes by the signs from 256 on
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.byte_signs = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def cuts(self, text: str) -> list[int]:
        """Start offsets of the pre-tokens of a text that is not empty, and its length."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[points]
        n = len(points)
        starts = np.empty(n + 1, bool)
        starts[0] = starts[n] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:n])
        space = kinds == SPACE
        if n > 1:
            # the last white space before a word stands alone, or with the word if it is a plain space
            last = np.flatnonzero(space[:-1] & ~space[1:])
            starts[last] = True
            starts[last[points[last] == 32] + 1] = False
            marks = np.flatnonzero((points[:-1] == 39) & (kinds[1:] == LETTER))
            for at in marks.tolist():
                if starts[at]:
                    for tail in CONTRACTIONS:
                        if text.startswith(tail, at + 1):
                            starts[at + 1] = False
                            starts[at + 1 + len(tail)] = True
                            break
        return np.flatnonzero(starts).tolist()

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        cuts = self.cuts(text)
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def learn(self, words: Iterable[str]) -> None:
        new = list(words)
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
        model, signs = self.tokenizer.model, self.byte_signs
        for word in new:
            tokens = model.tokenize(word.encode("utf-8", "replace").decode("latin-1").translate(signs))
            self.known[word] = b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.special and self.special.search(text):
            out, at = [], 0
            for found in self.special.finditer(text):
                out += [self.plain(text[at : found.start()]), np.array([self.specials[found[0]]], "<u4").tobytes()]
                at = found.end()
            return b"".join([*out, self.plain(text[at:])])
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        words = self.words(text)
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            distinct = set(words)
            self.learn(distinct if len(known) + len(distinct) > CACHED else distinct.difference(known))
            return b"".join([known[w] for w in words])


def piece_tokenizer(path: str) -> PieceTokenizer:
    """One tokenizer a worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


def pieces_of(ids: bytes, end_id: int = END_ID, limit: int = MAX_TOKENS) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of a document: only one longer than ``limit`` is cut, its first piece may be shorter."""
    ids += int(end_id).to_bytes(4, "little")
    n = len(ids) // 4
    ends = [n - k * limit for k in range((n - 1) // limit + 1)][::-1]
    starts = [0, *ends[:-1]]
    return [(k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(starts, ends, strict=True))]


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; null texts are empty and have the end id only."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = piece_tokenizer(tokenizer_path)
        for pdf in batches:
            rows = [(i, *piece) for i, text in zip(pdf["id"], pdf["text"], strict=True) for piece in pieces_of(tokenizer.encode(text))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": pdf["id"].dtype})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut_rows = rows.mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return cut_rows.withColumn("doc_id", F.col("doc_id").cast(kind))


class BestFit:
    """Bounded-space online best-fit over bins of ``capacity``; closed bins are returned as lists of items in order."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins, self.count = capacity, open_bins, 0
        self.levels: list[list[list]] = [[] for _ in range(capacity + 1)]
        self.bits = 0  # bit f is set if a bin with f free is open

    def take(self, free: int) -> list:
        items = self.levels[free].pop()
        if not self.levels[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return items

    def add(self, item: object, length: int) -> list[list]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            items = self.take(free)
        else:
            free, items = self.capacity, []
        items.append((item, self.capacity - free))
        left = free - length
        if left == 0:
            return [items]
        self.levels[left].append(items)
        self.bits |= 1 << left
        self.count += 1
        if self.count > self.open_bins:
            return [self.take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def close(self) -> Iterator[list]:
        while self.bits:
            yield self.take((self.bits & -self.bits).bit_length() - 1)


def pack_pieces(pieces: DataFrame, limit: int = MAX_TOKENS, open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Add (sequence_id, offset) to rows with ``length`` of at most ``limit``. Rows are dealt evenly to packers, whatever their ids."""
    names = [*pieces.columns, "sequence_id", "offset"]
    at = pieces.columns.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    shards = max(1, math.ceil(pieces.count() / shard_pieces))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        packer, rows = BestFit(limit, open_bins), []

        def put(items: list) -> None:
            nonlocal sequence
            rows.extend((*item, sequence, offset) for item, offset in items)
            sequence += 1

        for pdf in batches:
            for row in zip(*[pdf[c].tolist() for c in pdf.columns], strict=True):
                for items in packer.add(row, int(row[at])):
                    put(items)
            yield pd.DataFrame(rows, columns=names)
            rows.clear()
        for items in packer.close():
            put(items)
        yield pd.DataFrame(rows, columns=names)

    return pieces.repartition(shards).mapInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece with the end id only; repeated rows and null ids are documents of their own; a long text
    gives as many full pieces as it needs. Other columns are not read; an empty table gives no rows.
    """
    pieces = stash(tokenised_pieces(docs, tokenizer_path, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("string")), "pack-pieces")
    packed = pack_pieces(pieces, **options)
    return packed.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
