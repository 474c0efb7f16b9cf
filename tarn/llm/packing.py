"""Packing: concatenate all documents and cut at fixed windows, by two-pass prefix sums over partition totals."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm.common import small_batches, staged, table, text_of

#: Tokens in a sequence; id that ends a document.
LENGTH, END_ID = 1024, 0


class Encoder:
    """Token ids of whole texts, packed, by a byte-level BPE file of `tokenizers`.

    The ids are those of `tokenizers` with add_special_tokens=False: a string of a special token in a text is that token. The same vocabulary is
    encoded by tiktoken, some times faster, which gives the same ids for other texts (tests compare them); a text with such a string, or one that
    tiktoken can't take, goes to `tokenizers`.
    """

    def __init__(self, path: str, pattern: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        # the file writes bytes as characters: those that print as themselves, the others from U+0100 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(added))) or "(?!)")
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items() if token not in added}
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> array:
        try:
            if not self.special.search(text):
                return array(self.kind, self.fast.encode_ordinary(text))
        except BaseException as error:  # a panic in its regular expressions is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        return array(self.kind, self.tokenizer.encode(text, add_special_tokens=False).ids)


_TOKENS = "part int, begin long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _tokenised(path: str, pattern: str):
    def run(batches):
        from pyspark import TaskContext

        encoder, part, begin = Encoder(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, n = [], []
            for text in batch.column(1):
                x = encoder.encode(text.as_py())
                x.append(END_ID)
                n.append(len(x))
                ids.append(x.tobytes())
            n = np.asarray(n, dtype=np.int64)
            at = begin + np.cumsum(n) - n
            begin += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(at), batch.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "begin", "doc_id", "n", "ids"])

    return run


def _cut(base: dict[int, int], length: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for part, begin, doc, n, raw in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                ids = np.frombuffer(raw, dtype="<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = base[part] + begin
                first = (at // length + 1) * length - at
                cuts = [0, *range(first, n, length), n]
                for low, high in zip(cuts, cuts[1:]):
                    for column, x in zip(out, (doc, low, high - low, n, (at + low) // length, (at + low) % length, ids[low:high].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:-1]), pa.array(out[-1], pa.binary())], [x.split()[0] for x in _PIECES.split(", ")])

    return run


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of `length` tokens: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian, 32 bits each); a piece is a boundary record.

    The first pass tokenises and numbers tokens within each partition; totals of the partitions (one number each) are
    summed up on the driver; the second pass adds them and cuts at every `length` tokens of the whole, so only the last sequence
    is short. A very long text is encoded whole, as one row. Null and empty texts have their end id alone; null and repeated ids are documents of their own; an empty
    table gives no pieces; other columns are unread. Ids are kept in the shared folder, so a lost executor costs one partition.
    """
    import public_tokenizers

    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    tokens = staged(base.mapInArrow(_tokenised(tokenizer or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN), _TOKENS), "tokens")
    at, offsets = 0, {}
    for row in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").toLocalIterator():
        offsets[row["part"]] = at
        at += row["n"]
    return tokens.mapInArrow(_cut(offsets, length), _PIECES)


def sequences(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """sequence_id, n_tokens, ids: whole sequences from the pieces of `pack`, padded with END_ID to `length` ids. A sequence has at most `length` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    return out.withColumn("ids", F.rpad("ids", F.lit(4 * length), F.lit(END_ID.to_bytes(4, "little"))))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
