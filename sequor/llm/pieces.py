"""Encoding and decoding with SentencePiece vocabularies: unigram Viterbi over a double-array trie."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequor.llm.common import prepare
from sequor.llm.packing import vocabulary

#: Units held in one generation, and two generations at once; about 150 bytes each.
CACHE_UNITS = 500_000
#: Units of more bytes are encoded without being held.
HELD_BYTES = 64
UNITS = re.compile(rb" *[^ \n]+|\n| +")


class DoubleArray:
    """A double-array trie of byte strings: the child of node s by byte c is base[s] + c + 1 where check is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for k, v in keys.items():
            at = tree
            for c in k:
                at = at.setdefault(c, {})
            at[-1] = v
        # the first 257 places stay empty, so that any later place can hold any byte's child
        self.base, self.check, self.value = [0] * 257, [-2] * 257, [-1] * 257
        free = hint = 257  # the first free place; where to look for several places at once
        todo = [(0, tree)]
        while todo:
            s, node = todo.pop()
            self.value[s] = node.get(-1, -1)
            kids = sorted(c for c in node if c >= 0)
            if not kids:
                continue
            while free < len(self.check) and self.check[free] != -1:
                free += 1
            b, tries = (free if len(kids) == 1 else hint) - kids[0] - 1, 0
            while True:
                top = b + kids[-1] + 2
                if top > len(self.check):
                    more = top - len(self.check) + 256
                    self.base += [0] * more
                    self.check += [-1] * more
                    self.value += [-1] * more
                if all(self.check[b + c + 1] == -1 for c in kids):
                    break
                b, tries = b + 1, tries + 1
            if tries > 64 and len(kids) > 1:
                hint = b + kids[0] + 1
            self.base[s] = b
            for c in kids:
                self.check[b + c + 1] = s
            todo += [(b + c + 1, node[c]) for c in kids]
        # a walk may look at most 256 places beyond the last node
        self.base += [0] * 257
        self.check += [-1] * 257
        self.value += [-1] * 257

#: What an id that is none stands for, and the number that such ids get.
NO_PIECE, BEYOND = "\ufffd".encode(), (1 << 32) - 1


class PieceCodec:
    """Ids of text and text of ids.

    White space is marked as in SentencePiece: a space before the text, and each space, is the
    marker. In the trie the marker is the byte 0x20 itself, so that a marker character that stands
    in the text stays apart and decodes to itself. A character no piece covers becomes its bytes.
    Of segmentations with equal scores the first found from the left stands.
    """

    held: dict[str, PieceCodec] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of: list[bytes] = []
        keys: dict[bytes, int] = {}
        self.score: list[float] = []
        self.bytes_at = [-1] * 256
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k).replace("▁", " ").encode()
            self.score.append(sp.get_score(k))
            if sp.is_byte(k):
                code = int(sp.id_to_piece(k)[3:5], 16)
                self.bytes_at[code] = k
                self.text_of.append(bytes([code]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.text_of.append(b"")
            else:
                self.text_of.append(piece)
                keys[piece] = k
                if b" " in piece.lstrip(b" ") or b"\n" in piece or re.search(rb"[A-Za-z][.,]", piece):
                    raise ValueError("such pieces can cross the borders of units")
        self.unknown = min(self.score[k] for k in keys.values() if self.score[k] > -1e8) - 10.0
        self.trie = DoubleArray(keys)
        self.units: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceCodec:
        if path not in cls.held:
            cls.held[path] = cls(path)
        return cls.held[path]

    def viterbi(self, s: bytes) -> tuple[list[int], float]:
        """The best segmentation of s and its score."""
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        n = len(s)
        best = [float("-inf")] * (n + 1)
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            c = s[i]
            width = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            here, node, single = best[i], 0, False
            for j in range(i, n):
                child = base[node] + s[j] + 1
                if check[child] != node:
                    break
                node = child
                v = value[node]
                if v >= 0:
                    if j + 1 == i + width:
                        single = True
                    x = here + score[v]
                    if x > best[j + 1]:
                        best[j + 1] = x
                        back[j + 1] = (i, v)
            if not single and here + self.unknown > best[i + width]:
                best[i + width] = here + self.unknown
                back[i + width] = (i, -1)
            i += width
        out: list[int] = []
        at = n
        while at:
            i, v = back[at]
            out += [v] if v >= 0 else [self.bytes_at[c] for c in reversed(s[i:at])]
            at = i
        return out[::-1], best[n]

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids, unit by unit: no piece crosses a unit's border.

        Units are line ends and runs of spaces with the word after them, without its last full stop
        or comma if a letter A-Z or a-z stands before it.
        """
        if not text:
            return b""
        out = []
        get = self.units.get
        for u in UNITS.findall(b" " + text.encode()):
            ids = get(u)
            if ids is None:
                ids = self.learn(u)
                get = self.units.get
            out.append(ids)
        return b"".join(out)

    def learn(self, u: bytes) -> bytes:
        ids = self.older.get(u)
        if ids is None:
            if len(u) > 2 and u[-1] in b".," and u[-2:-1].isalpha():
                stem = u[:-1]
                ids = (self.units.get(stem) or self.learn(stem)) + np.array(self.viterbi(u[-1:])[0], "<u4").tobytes()
            else:
                ids = np.array(self.viterbi(u)[0], "<u4").tobytes()
        if len(u) <= HELD_BYTES:
            if len(self.units) >= CACHE_UNITS:
                self.units, self.older = {}, self.units
            self.units[u] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of any list of ids. Only the marker of a text's first word is dropped, if the list begins with it;
        an id that is none, and bytes that are no character (of one that is cut), become U+FFFD."""
        at = np.frombuffer(ids, "<u4")
        if len(at) and at.max() >= len(self.text_of):
            raw = b"".join(self.text_of[k] if k < len(self.text_of) else NO_PIECE for k in at.tolist())
        else:
            raw = b"".join(map(self.text_of.__getitem__, at.tolist()))
        return raw.removeprefix(b" ").decode(errors="replace")


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int). Null and empty texts have no ids; nothing else is dropped."""
    path = path or vocabulary("piece_bpe_32k.model")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(path)
        for b in batches:
            ids = [np.frombuffer(codec.encode(t), "<i4") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kinds = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded documents, or of any part of their ids; a null list is an empty text, a null id U+FFFD."""
    path = path or vocabulary("piece_bpe_32k.model")
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(path)
        for b in batches:
            texts = [codec.decode(np.array([BEYOND if k is None or not 0 <= k < BEYOND else k for k in x or []], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kinds = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, kinds)


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode each text in one pass: n_tokens, n_byte_tokens, ids_crc32, decoded_sha256, round_trip."""
    path = path or vocabulary("piece_bpe_32k.model")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec.of(path)
        is_byte = np.zeros(len(codec.text_of), bool)
        is_byte[[k for k in codec.bytes_at if k >= 0]] = True
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t)
                back = codec.decode(ids)
                rows.append((len(ids) // 4, int(is_byte[np.frombuffer(ids, "<u4")].sum()), zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    kinds = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_byte_tokens", "ids_crc32")), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kinds)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
