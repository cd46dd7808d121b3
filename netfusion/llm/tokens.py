"""Token ids in fixed-width bit packing.

Ids are written into binary files, one for each shard, of the shared folder; a file is its blocks, each of whole documents, and after
them a table of where they are, so a reader maps the file and goes to any document or id. Little-endian:

    blocks
    table        n_blocks x (offset u64, n_docs u64, n_ids u64)
    n_blocks u64 | magic b"NFTS"

A task writes a file under a name of its own and returns its blocks' places once it is closed; a manifest keeps those of the tasks that
succeeded, so a file of an executor that was lost is never read. The bytes of a block:

    magic b"NFT1" | width u8 | 3 zero bytes | n_docs u32 | n_ids u64
    doc ids      n_docs x i64
    null flags   n_docs x u8 (1: the id was null)
    doc offsets  (n_docs + 1) x u64, in ids from the block's start
    payload      n_ids x width bits, least significant bit first, padded to whole bytes

Id i starts at bit i * width, so any range of ids is found without reading what precedes it.
"""

from __future__ import annotations

import gc
import os
import re
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netfusion.llm.common import partitions, shared_dir, written

MAGIC, END_MAGIC = b"NFT1", b"NFTS"
BLOCK_IDS = 1 << 20
MEMO_WORDS = 600_000
MEMO_STEMS = 300_000
MEMO_SPARE = 150_000
MEMO_WORD_BYTES = 64
SIGNS = string.punctuation.encode()
ASCII_LETTERS = frozenset(string.ascii_letters.encode())
BEFORE_OTHERS = re.compile(rb"[A-Z](?=[\x80-\xff])")
#: Words that go to the model at once.
JOINED = 256
_encoders: dict[str, Encoder] = {}


def bit_width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out, step = [], 1 << 16  # a multiple of 8 ids ends on a byte
    for at in range(0, len(ids), step):
        bits = (ids[at : at + step, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & 1
        out.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes | memoryview, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop (exclusive) of a payload, as uint32."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    if width in (8, 16, 32):
        n = width // 8
        return np.frombuffer(payload[start * n : stop * n], f"<u{n}").astype(np.uint32)
    first = start * width
    raw = np.frombuffer(payload[first // 8 : -(-stop * width // 8)], np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[first % 8 :][: (stop - start) * width]
    return bits.reshape(-1, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    head = MAGIC + bytes([width, 0, 0, 0]) + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ids)], "<u8").tobytes()
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype("<u8")
    return b"".join(
        (
            head,
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            offsets.tobytes(),
            pack(ids, width),
        )
    )


class Block:
    """Random access to the ids of a block."""

    def __init__(self, data: bytes | np.ndarray):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token block")
        self.width = int(data[4])
        n = int(np.frombuffer(data, "<u4", 1, 8)[0])
        self.n_ids = int(np.frombuffer(data, "<u8", 1, 12)[0])
        flags = np.frombuffer(data, np.uint8, n, 20 + 8 * n)
        self.doc_ids = [None if f else int(d) for d, f in zip(np.frombuffer(data, "<i8", n, 20), flags, strict=True)]
        self.offsets = np.frombuffer(data, "<u8", n + 1, 20 + 9 * n).astype(np.int64)
        self.payload = memoryview(data)[20 + 9 * n + 8 * (n + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        return unpack(self.payload, self.width, start, stop)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.offsets[k]), int(self.offsets[k + 1]))


class TokenFile:
    """Random access to a token file, which is mapped and not read."""

    def __init__(self, path: str):
        self.raw = np.memmap(path, np.uint8, "r")
        if bytes(self.raw[-4:]) != END_MAGIC:
            raise ValueError("not a token file")
        n = int(self.raw[-12:-4].view("<u8")[0])
        table = self.raw[len(self.raw) - 12 - 24 * n : len(self.raw) - 12].view("<u8").reshape(n, 3).astype(np.int64)
        self.at = table[:, 0]
        self.first_doc, self.first_id = (np.concatenate([[0], np.cumsum(table[:, c])]) for c in (1, 2))

    def block(self, k: int) -> Block:
        return Block(self.raw[self.at[k] :])

    def document(self, k: int) -> np.ndarray:
        """Ids of the file's k-th document."""
        b = int(np.searchsorted(self.first_doc, k, "right")) - 1
        return self.block(b).document(k - int(self.first_doc[b]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file."""
        first, last = (int(np.searchsorted(self.first_id, x, "right")) - 1 for x in (start, max(start, stop - 1)))
        parts = [self.block(b).ids(max(0, start - int(self.first_id[b])), min(stop, int(self.first_id[b + 1])) - int(self.first_id[b])) for b in range(first, min(last + 1, len(self.at)))]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _files(uri: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Memo(dict):
    """A dictionary of bounded size. Words that are frequent come early, so the first ``most`` keys stay; later ones go when there are
    ``spare`` of them, and all go when a batch knows too few of its words."""

    def __init__(self, most: int, spare: int):
        super().__init__()
        self.most, self.spare, self.late = most, spare, []

    def settle(self, new: list[bytes], asked: int) -> None:
        """After a batch that asked for so many words and learned ``new`` ones."""
        for w in new:
            if len(w) > MEMO_WORD_BYTES:
                self.pop(w, None)
        if len(self) <= self.most:
            return
        self.late += new
        if 4 * len(new) > asked > 10_000:
            self.clear()
            self.late = []
        elif len(self.late) > self.spare:
            for w in self.late:
                self.pop(w, None)
            self.late = []


class Encoder:
    """A tokenizer whose words are encoded once.

    Normalising and splitting never join what ASCII white space separates if the tokenizer drops white space, so a text's
    ids are those of its words; nor an ASCII letter and the ASCII signs that end a word after it, if the tokenizer splits there.
    Both are tried out on the tokenizer; one that fails gets whole texts. Words of small letters alone, which normalising and splitting
    leave as they are, go to the same model without these steps.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.words, self.stems = Memo(MEMO_WORDS, MEMO_SPARE), Memo(MEMO_STEMS, MEMO_SPARE)
        self.by_word, self.by_stem, self.by_lower = separable(self.tokenizer)
        self.plain = plain_model(self.tokenizer)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded_plain(self, words: list[str]) -> list[bytes]:
        """Words of small letters, JOINED at a time with spaces between them: each space is a token of its own, at which ids are cut."""
        model, space = self.plain
        out: list[bytes] = []
        for e in model.encode_batch_fast([" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], add_special_tokens=False):
            data = array("I", e.ids).tobytes()
            cuts = (np.flatnonzero(np.frombuffer(data, np.uint32) == space) * 4).tolist()
            out += [data[x:z] for x, z in zip([0, *(k + 4 for k in cuts)], [*cuts, len(data)], strict=True)]
        return out

    def _learn(self, new: set[bytes]) -> None:
        stems, words, signed, ask = self.stems, self.words, [], set()
        for w in new:
            if not self.by_stem or w[-1] in ASCII_LETTERS:
                ask.add(w)
                continue
            stem = w.rstrip(SIGNS)
            if len(stem) == len(w) or not stem or stem[-1] not in ASCII_LETTERS or b"<|" in w:
                ask.add(w)
            else:
                tail = w[len(stem) :]
                signed.append((w, stem, tail))
                ask.add(stem)
                ask.add(tail)
        unknown = [x for x in ask if x not in stems]
        plain, other = [], []
        for x in unknown:
            if self.plain and x.isalpha() and x.islower():  # of bytes: ASCII letters alone
                plain.append((x, x.decode()))
                continue
            text = x.decode()
            (plain if self.plain and not x.isascii() and text.isalpha() and text.islower() and max(text) < "\u0180" else other).append((x, text))
        for some, by in ((plain, self._encoded_plain), (other, self._encoded)):
            stems.update(zip([x for x, _ in some], by([t for _, t in some]) if some else [], strict=True))
        for w, stem, tail in signed:
            words[w] = stems[stem] + stems[tail]
        for w in new:
            if w not in words:
                words[w] = stems[w]
        stems.settle(unknown, 0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian uint32."""
        if not self.by_word:
            return self._encoded(texts)
        collecting = gc.isenabled()
        gc.disable()  # nothing here makes cycles, and the memos are large to walk through
        try:
            return self._by_words(texts)
        finally:
            if collecting:
                gc.enable()

    def _by_words(self, texts: list[str]) -> list[bytes]:
        words, split, found, asked = self.words, [], [], 0
        for text in texts:
            data = text.encode()
            # control strings have letters of one case: such a text stays as it is
            if self.by_lower and b"<|" not in data:
                data = lower(data)
            own = data.split()
            split.append(own)
            found.append(list(map(words.get, own)))
            asked += len(own)
        gaps = [[i for i, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        new = {own[i] for own, gap in zip(split, gaps, strict=True) for i in gap}
        if new:
            self._learn(new)
            for own, ids, gap in zip(split, found, gaps, strict=True):
                for i in gap:
                    ids[i] = words[own[i]]
            words.settle(list(new), asked)
        return [b"".join(ids) for ids in found]


def lower(data: bytes) -> bytes:
    """ASCII capitals as small letters, but for those that something else than ASCII follows: a capital and a combining mark may stay two
    where the small letter and the mark become one."""
    low = data.lower()
    if data.isascii():
        return low
    kept = [m.start() for m in BEFORE_OTHERS.finditer(data)]
    if kept:
        low = bytearray(low)
        for i in kept:
            low[i] = data[i]
        low = bytes(low)
    return low


def plain_model(tokenizer):
    """The tokenizer's model on bytes, without normalising and splitting but at spaces, and the id of a space, if words of small letters
    come out alike; None if not."""
    from tokenizers import Tokenizer, pre_tokenizers

    plain = Tokenizer(tokenizer.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    ids = lambda t, x: t.encode(x, add_special_tokens=False).ids
    some = ("a", "word", "words", "ing", "straße", "él", "être", "zażółć", "naïveté", "übergrößen", "ªº", "ŉa")
    space = ids(plain, " ")
    same = len(space) == 1 and all(ids(plain, w) == ids(tokenizer, w) and ids(plain, f"a {w}") == ids(plain, "a") + space + ids(plain, w) for w in some)
    return (plain, space[0]) if same else None


def separable(tokenizer) -> tuple[bool, bool, bool]:
    """If words are encoded alike alone and among others (where ASCII white space parts them); stems and the signs after them; words with
    ASCII capitals and small letters."""

    def ids(x: str) -> list[int]:
        return tokenizer.encode(x, add_special_tokens=False).ids

    some = ("a", "b.", "'s", "Word", "é", "7")
    by_word = all(ids(f"{s}{s}".join(some)) == sum(map(ids, some), []) for s in " \n\t\r\x0b\x0c") and not ids(" \n\t\r\x0b\x0c ")
    by_stem = all(ids(f"{w}{x}") == ids(w) + ids(x) for w in ("a", "it's", "Word", "é", "x.y") for x in (".", ",", "'", "###", "$$$", ")?", '."', "'..", "&&&", "|"))
    by_lower = all(ids(w) == ids(w.lower()) for w in ("Word", "WORD", "IT'S", "ÀB", "AZ"))
    return by_word, by_stem, by_lower


def encoder(tokenizer_json: str) -> Encoder:
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = Encoder(tokenizer_json)
    return _encoders[tokenizer_json]


BLOCKS = "shard int, block int, n_docs int, n_ids long, file string, offset long, size long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(documents: DataFrame, tokenizer_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode whole texts and write them as token files into the shared folder; the blocks written: shard, block, n_docs, n_ids, file,
    offset, size.

    documents: doc_id, text and what ``order`` names; more columns are ignored. Shards and blocks go by ``order`` ascending (nulls first), equal
    places by text.
    A null text is empty and gives the end id alone; repeated rows are written each. An empty table gives no blocks. A block ends
    after the document that fills it, so no document is cut, whatever its length.
    """
    import pyarrow as pa

    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    from tokenizers import Tokenizer

    width = bit_width(max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True), end_id + 1))
    end = np.array([end_id], "<u4").tobytes()
    folder = f"{shared_dir(documents.sparkSession)}/token-files-{uuid.uuid4().hex}"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_json).encode
        shard = TaskContext.get().partitionId()
        file = f"{folder}/{shard:05d}-{uuid.uuid4().hex}.bin"
        stream, at, rows = None, 0, []
        doc_ids, parts, n = [], [], 0

        def flush() -> None:
            nonlocal stream, at, doc_ids, parts, n
            if stream is None:
                files, path = _files(file)
                files.create_dir(path.rsplit("/", 1)[0], recursive=True)
                stream = files.open_output_stream(path)
            data = pack_block(doc_ids, [len(p) // 4 for p in parts], np.frombuffer(b"".join(parts), "<u4"), width)
            stream.write(data)
            rows.append((shard, len(rows), len(doc_ids), n, file, at, len(data)))
            at, doc_ids, parts, n = at + len(data), [], [], 0

        try:
            for batch in batches:
                for first in range(0, batch.num_rows, 256):
                    some = batch.slice(first, 256)
                    for doc_id, part in zip(some.column(0).to_pylist(), encode([x or "" for x in some.column(1).to_pylist()]), strict=True):
                        doc_ids.append(doc_id)
                        parts.append(part + end)
                        n += len(part) // 4 + 1
                        if n >= block_ids:
                            flush()
            if doc_ids:
                flush()
            if rows:
                stream.write(np.array([(r[5], r[2], r[3]) for r in rows], "<u8").tobytes() + np.array([len(rows)], "<u8").tobytes() + END_MAGIC)
        finally:
            if stream is not None:
                stream.close()
        if rows:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])

    dealt = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *(F.col(c) for c in order if c != "doc_id"))
    dealt = dealt.repartitionByRange(partitions(documents.sparkSession), *order).sortWithinPartitions(*order, "text")
    return written(dealt.select("doc_id", "text").mapInArrow(blocks, BLOCKS), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from the files."""
    import pyarrow as pa

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = _files(row["file"])
                with files.open_input_file(path) as stream:
                    stream.seek(row["offset"])
                    b = Block(stream.read(row["size"]))
                crcs = [zlib.crc32(b.document(i).astype("<u4").tobytes()) for i in range(len(b.doc_ids))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.doc_ids, pa.int64()), pa.array(b.offsets[:-1] + row["base"]), pa.array(np.diff(b.offsets)), pa.array(crcs, pa.int64())],
                    names=[f.split()[0] for f in READ.split(", ")],
                )

    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    before = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    # each block gets its first id's place before it is read, so what is read, far more than the manifest tells of, meets no join
    placed = blocks.select("shard", "file", "offset", "size", before.alias("before")).join(shards, "shard").select("file", "offset", "size", (F.col("before") + F.col("shard_start")).alias("base"))
    return placed.repartition(partitions(blocks.sparkSession), "file", "offset").mapInArrow(documents, READ)
