"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries.

A data set is a folder of Parquet files; each row is a shard, a run of documents in
ascending id order:

    part, shard    place of the shard; shards sorted by both give the whole order
    n_docs         documents in the shard
    n_tokens       ids in the shard
    width          bytes of an id, 2 or 4, little-endian unsigned
    tokens         the ids of all documents, one after the other
    low_bits       low bits of a boundary, l
    low            the l low bits of the n_docs + 1 boundaries, packed, lowest bit first
    high           their high parts in unary: boundary i sets bit (value >> l) + i
    samples        bit positions in ``high`` of every 256th boundary, for ``select``
    doc_ids        the document ids, 8 bytes each, little-endian signed; see ``null_ids``
    null_ids       documents at the start whose id is null

n + 1 boundaries up to u take n * (2 + log2(u / n)) bits and some, instead of 64 n.
Shards are cut at documents once they hold ``SHARD_TOKENS``, so a task holds one shard and
one batch of texts. Spark's committer writes them: a lost task leaves nothing behind.
"""

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHARD_TOKENS = 1 << 22
_SAMPLE = 256
_KNOWN = 1 << 19  # pieces whose ids a worker remembers
# a line feed or none, Latin letters, ASCII marks
_WORD = re.compile(f"(\n?[A-Za-zÀ-ÖØ-öø-ɏ]+)([{re.escape(punctuation)}]*)")
_SLICE = 1 << 20  # characters that are encoded at once, or one text
SHARD = (
    "part int, shard int, n_docs long, n_tokens long, width int, tokens binary, low_bits int,"
    " low binary, high binary, samples binary, doc_ids binary, null_ids long"
)


class EliasFano:
    """A monotone sequence from zero up, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(
            n,
            low_bits,
            np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            at[::_SAMPLE].astype("<u8").tobytes(),
        )

    def decode(self) -> np.ndarray:
        """All values."""
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        values = (np.flatnonzero(bits)[: self.n] - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            low = np.unpackbits(
                np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits
            )
            values |= low.reshape(self.n, self.low_bits).astype(np.int64) @ (
                1 << np.arange(self.low_bits)
            )
        return values

    def select(self, i: int) -> int:
        """Value ``i``, read from its sample on, without decoding the rest."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u8")[i // _SAMPLE])
        left = i % _SAMPLE
        byte = at // 8
        word = self.high[byte] >> (at % 8) << (at % 8)  # drop the bits before the sample
        while left >= word.bit_count():
            left -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        start = i * self.low_bits
        chunk = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8], "little")
        low = (chunk >> (start % 8)) & ((1 << self.low_bits) - 1)
        return ((place - i) << self.low_bits) | low


class Encoder:
    """Ids of whole texts as bytes, by the tokenizers library.

    The vocabulary's pre-tokenizer never joins a non-space with a space or line feed after
    it, so a text is the sum of its pieces cut there, and the ids of a piece are those the
    library gives it alone; so are a word and the marks behind it. Pieces with any other
    white space, and empty ones, make their text go through the library whole. A worker
    remembers the ids of pieces.

    With ``added_tokens`` the vocabulary's added tokens get the ids of their own that a plain
    call gives them, otherwise they are ordinary text. Texts that hold one go through the
    library whole.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = added if added_tokens else []
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.code = "H" if self.width == 2 else "I"
        self.known: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}
        kind = type(self.tokenizer.pre_tokenizer).__name__
        self.by_piece = kind == "ByteLevel" and self.tokenizer.normalizer is None
        self.letters = _ByteLetters()
        self.line = self._ids(["\n"])[0] if self.by_piece else b""

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array(self.code, x.ids).tobytes() for x in found]

    def _words(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of Latin words behind a space, or behind the line feed they begin with.

        To the pre-tokenizer each is one unit, a line feed another one, so that the
        vocabulary's model can be asked at once, in the letters it has for bytes.
        """
        tokenize, letters, code = self.tokenizer.model.tokenize, self.letters, self.code
        space = " ".translate(letters)
        for piece in pieces:
            spaced = piece[0] != "\n"
            word = space + piece if spaced else piece[1:]
            if not piece.isascii():
                word = space + piece.translate(letters) if spaced else word.translate(letters)
            ids = array(code, [t.id for t in tokenize(word)]).tobytes()
            yield ids if spaced else self.line + ids

    def _learn(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of new pieces; None for one that does not stand alone.

        Words are remembered without the marks behind them.
        """
        cut = [*map(_word_and_marks, pieces)]
        words = list({c[0] for c in cut if c}.difference(self.known))
        self.known.update(zip(words, self._words(words), strict=True))
        # letters never share a token with the marks behind them
        tails = list({c[1] for c in cut if c}.difference(self.tails))
        self.tails.update(zip(tails, self._ids(tails), strict=True))
        others = [p for p, c in zip(pieces, cut, strict=True) if not c]
        alone = [p for p in others if _one_word(p.removeprefix("\n"))]
        # a piece with a line feed stood behind it, any other behind a space
        ids = self._ids([p if p[0] == "\n" else " " + p for p in alone])
        self.known.update(zip(alone, ids, strict=True))
        out = [
            self.known[c[0]] + self.tails[c[1]] if c else self.known.get(p)
            for p, c in zip(pieces, cut, strict=True)
        ]
        if len(self.known) > _KNOWN:
            # frequent pieces came first: the older half stays
            self.known = dict(islice(self.known.items(), _KNOWN // 2))
        if len(self.tails) > _KNOWN // 8:
            self.tails = {"": b""}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text.

        Arrow cuts all texts into pieces and numbers the different ones; only those are
        looked up, and their ids are gathered by number into one buffer for all texts.
        """
        if not self.by_piece or not texts:
            return self._ids(texts)
        first = [t.replace("\n", " \n").partition(" ") for t in texts]
        rest = pa.array([tail if space else None for _, space, tail in first], pa.large_string())
        cut = pc.split_pattern(rest, " ")
        places = pc.cumulative_sum(pc.fill_null(pc.list_value_length(cut), 0))
        ends = np.concatenate([[0], places.to_numpy()])
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = [*map(self.known.get, pieces)]
        holes = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(holes, self._learn([pieces[i] for i in holes]), strict=True):
            ids[i] = x
        found = pa.array(ids, pa.large_binary()).take(coded.indices)
        broken = np.concatenate([[0], np.cumsum(found.is_null().to_numpy(zero_copy_only=False))])
        # the values lie one after the other, so that a text's ids are one stretch of them
        found = pc.fill_null(found, b"")
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, np.int64, len(found) + 1)[ends] if len(found) else ends
        out: list[bytes | None] = []
        heads = self._ids([head for head, *_ in first])
        for i, (text, start) in enumerate(zip(texts, heads, strict=True)):
            alone = broken[ends[i]] == broken[ends[i + 1]] and _one_word(first[i][0])
            if alone and not any(x in text for x in self.added):
                out.append(start + (data[at[i] : at[i + 1]].to_pybytes() if data else b""))
            else:
                out.append(None)
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


class _ByteLetters(dict):
    """For ``str.translate``: the letters that byte-level vocabularies have for UTF-8 bytes.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """

    def __init__(self):
        super().__init__()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = (b for b in range(256) if b not in plain)
        self.of_byte = {b: chr(b) for b in plain}
        self.of_byte.update((b, chr(256 + i)) for i, b in enumerate(others))

    def __missing__(self, point: int) -> str:
        found = self[point] = "".join(self.of_byte[b] for b in chr(point).encode())
        return found


def _word_and_marks(piece: str) -> tuple[str, str] | None:
    """The groups of ``_WORD``, or None; ASCII letters are told without it."""
    word = piece.rstrip(punctuation)
    if word.isascii() and word.removeprefix("\n").isalpha():
        return word, piece[len(word) :]
    found = _WORD.fullmatch(piece)
    return found and found.groups()


def _one_word(text: str) -> bool:
    return text.split() == [text]


def _shard(part: int, number: int, width: int, ids: list, tokens: list[bytes]) -> pa.RecordBatch:
    lengths = np.array([len(t) // width for t in tokens], np.int64)
    bounds = EliasFano.encode(np.concatenate([[0], np.cumsum(lengths)]))
    nulls = sum(i is None for i in ids)
    row = {
        "part": pa.array([part], pa.int32()),
        "shard": pa.array([number], pa.int32()),
        "n_docs": [len(ids)],
        "n_tokens": [int(lengths.sum())],
        "width": pa.array([width], pa.int32()),
        "tokens": pa.array([b"".join(tokens)], pa.binary()),
        "low_bits": pa.array([bounds.low_bits], pa.int32()),
        "low": [bounds.low],
        "high": [bounds.high],
        "samples": [bounds.samples],
        "doc_ids": [np.array(ids[nulls:], "<i8").tobytes()],
        "null_ids": [nulls],
    }
    return pa.RecordBatch.from_pydict(row)


_encoders: dict[str, Encoder] = {}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ``_SLICE`` characters, or a row of more."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _written(tokenizer: str, end_id: int, shard_tokens: int):
    def write(batches):
        from pyspark import TaskContext

        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer, added_tokens=True)
        encoder = _encoders[tokenizer]
        end = np.array([end_id], encoder.type).tobytes()
        part = TaskContext.get().partitionId()
        number = held = 0
        ids, tokens = [], []
        for batch in batches:
            for some in _slices(batch):
                found = encoder.encode([t or "" for t in some.column(1).to_pylist()])
                for doc, raw in zip(some.column(0).to_pylist(), found, strict=True):
                    ids.append(doc)
                    tokens.append(raw + end)
                    held += len(tokens[-1]) // encoder.width
                    if held >= shard_tokens:
                        yield _shard(part, number, encoder.width, ids, tokens)
                        number, held, ids, tokens = number + 1, 0, [], []
        if ids:
            yield _shard(part, number, encoder.width, ids, tokens)

    return write


def write(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shard_tokens: int = SHARD_TOKENS
) -> None:
    """Write the ids of whole texts, ``end_id`` after each document, in ascending doc_id order.

    Null texts count as empty, so they hold the end id alone. Null ids come first. Rows with
    one id are all written, in an order that their texts settle; other columns are not read;
    an empty table writes no shard. ``tokenizer`` is a path that every worker can read.
    """
    (
        docs.select("doc_id", "text")
        # the hash lets rows of one id be dealt to several tasks
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .mapInArrow(_written(tokenizer, end_id, shard_tokens), SHARD)
        .write.parquet(folder)
    )


def boundaries(n_docs: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> EliasFano:
    """The document boundaries of a shard's row."""
    return EliasFano(n_docs + 1, low_bits, low, high, samples)


def _read(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            bounds = boundaries(
                row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"]
            ).decode()
            if bounds[-1] != row["n_tokens"]:
                raise ValueError("boundaries and ids of a shard disagree")
            tokens = np.frombuffer(row["tokens"], f"<u{row['width']}")
            ids = np.frombuffer(row["doc_ids"], "<i8").tolist()
            sums = [
                zlib.crc32(tokens[a:b].astype("<u4")) for a, b in zip(bounds, bounds[1:], strict=False)
            ]
            n = row["n_docs"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None] * row["null_ids"] + ids, pa.int64()),
                    pa.array(np.full(n, row["part"], np.int32)),
                    pa.array(np.full(n, row["shard"], np.int32)),
                    pa.array(bounds[:-1]),
                    pa.array(np.diff(bounds)),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "part", "shard", "place", "n_tokens", "ids_crc32"],
            )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, read from the files.

    ``start`` counts the ids of all documents before it, from the sums of parts and shards:
    two small windows, as long as the number of parts and the shards of one part.
    """
    shards = spark.read.schema(SHARD).parquet(folder)
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        sizes.groupBy("part")
        .agg(F.sum("n_tokens").alias("n"))
        .select(
            "part",
            F.coalesce(F.sum("n").over(before.orderBy("part")), F.lit(0)).alias("part_start"),
        )
    )
    in_part = F.sum("n_tokens").over(before.partitionBy("part").orderBy("shard"))
    starts = sizes.select("part", "shard", F.coalesce(in_part, F.lit(0)).alias("shard_start")).join(
        parts, "part"
    )
    docs = shards.mapInArrow(
        _read, "doc_id long, part int, shard int, place long, n_tokens long, ids_crc32 long"
    )
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id",
        (F.col("part_start") + F.col("shard_start") + F.col("place")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )
