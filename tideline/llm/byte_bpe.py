"""Byte-level BPE encoding and decoding with the ``tokenizers`` library, from a table of ranks.

The ranks become a ``tokenizers`` BPE model: every byte string is written in the byte-to-character alphabet (printable
bytes stand for themselves, the others for characters from 256 on), and the merges are all splits of each token into two
tokens, in rank order, so that any neighbours whose union is a token merge at that token's rank. A match of the pattern
that is itself a token is taken whole. Decoding reverses the byte table; a character whose bytes are split over tokens is
put together again, and ``decode_stream`` holds back its first bytes until the rest has come.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows give equal rows; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The character of every byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def model_from_ranks(ranks: dict[bytes, int], pattern: str) -> str:
    """JSON text of the ``tokenizers`` model for ranks and a pattern."""
    from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

    alphabet = byte_alphabet()
    written = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = [
        (written[token[:cut]], written[token[cut:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for cut in range(1, len(token))
        if token[:cut] in ranks and token[cut:] in ranks
    ]
    model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    tokenizer.decoder = decoders.ByteLevel()
    return tokenizer.to_str()


@functools.lru_cache(maxsize=2)
def byte_table(spec: str) -> list[bytes]:
    """The bytes of every id."""
    back = {c: b for b, c in enumerate(byte_alphabet())}
    vocab = tokens.load_tokenizer(spec).get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token)
    return table


def decode_bytes(ids: Iterable[int], table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in ids])


def decode_stream(parts: Iterable[Iterable[int]], table: list[bytes]) -> Iterator[str]:
    """Text of successive runs of ids; bytes of an unfinished character wait for the next run."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    for ids in parts:
        yield decoder.decode(decode_bytes(ids, table))
    yield decoder.decode(b"", final=True)


def offsets(ids: np.ndarray, text: str, table: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """First byte and first character of every token; a token inside a character belongs to that character."""
    lengths = np.fromiter((len(table[i]) for i in ids.tolist()), dtype=np.int64, count=len(ids))
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1
    return starts, chars[starts] if len(ids) else starts


def encode_documents(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, byte_starts and char_starts (arrays of int) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = tokens.encoder(spec, True).encode, byte_table(spec)
        for batch in tokens.slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = encode(texts)
            at = [offsets(i, t, table) for i, t in zip(ids, texts, strict=True)]
            lists = [pa.array([x.astype(np.int32) for x in column], pa.list_(pa.int32())) for column in (ids, [a for a, _ in at], [c for _, c in at])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *lists], ["doc_id", "ids", "byte_starts", "char_starts"])

    schema = "doc_id long, ids array<int>, byte_starts array<int>, char_starts array<int>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokens.bounded(run, encodes=True), schema)


def decode_documents(encoded: DataFrame, spec: str) -> DataFrame:
    """doc_id and the decoded text of a table with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(spec)
        for batch in tokens.slices(batches):
            text = [decode_bytes(ids or [], table).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(tokens.bounded(run), "doc_id long, text string")


def round_trip(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, table = tokens.encoder(spec, True).encode, byte_table(spec)
        decimal = [b"%d" % i for i in range(len(table))]
        for batch in tokens.slices(batches, size=tokens.ENCODE_BYTES):
            counts, sums, decoded = [], [], []
            for found in encode(batch.column(1).to_pylist()):
                ids = found.tolist()
                counts.append(len(ids))
                sums.append(hashlib.sha256(b" ".join([decimal[i] for i in ids])).hexdigest())
                decoded.append(hashlib.sha256(decode_bytes(ids, table)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tokens.bounded(run, encodes=True), schema)
