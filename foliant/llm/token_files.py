"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

Ids are ranked by their count over all documents (rank 0: most frequent), so
most take one byte.  Each row of the files holds one document: ``control`` has
two bits per id (its number of bytes less one, four ids to a byte), ``data`` the
bytes themselves; decoding looks up lengths in a table of 256 control bytes.
Documents are range-partitioned and sorted by id; ``start`` counts the ids of all
documents before.  The rank table lies beside them.

Defined cases: a null text is empty (only the end id); rows with equal doc_id
are all written, one after another; a null doc_id sorts first; an empty table
gives empty files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import arrays
from foliant.plans.lineage import discard, materialize, new_dir

MAX_VOCABULARY = 1 << 20  # bound of the rank table that every task loads
CACHE = 500_000  # words in a generation of a worker's memory
_known: dict[str, Encoder] = {}

# Fixed values of byte-level BPE: how a text falls into pieces, and the character that stands for each byte.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
SIMPLE = regex.compile(r"[\n!-~\u00A1-\u00AC\u00AE-\u024F]+")  # words that this module may split by itself
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SPECIAL = "<|"
BLANK, WIDE = np.zeros(256, bool), np.zeros(256, bool)
BLANK[[*range(9, 14), *range(28, 33)]] = True
WIDE[[0xE1, 0xE2, 0xE3]] = True  # with C2 85 and C2 A0 (below) the first bytes of all other spaces
SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]


def suspects(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts that may have white space next to a space: judged by ASCII bytes and by the first bytes of other spaces."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = data == 32
    blank = BLANK[data]
    hit = np.zeros(len(data), bool)
    hit[:-1] = space[:-1] & blank[1:] | blank[:-1] & space[1:]
    hit |= WIDE[data]
    hit[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    some = offs[:-1] < offs[1:]
    hit[offs[:-1][some]] |= space[offs[:-1][some]]
    hit[offs[1:][some] - 1] |= space[offs[1:][some] - 1]
    return np.unique(np.searchsorted(offs, np.flatnonzero(hit), "right") - 1)


class Words(dict):
    """Ids of the words already seen.  Two generations bound it: what the older one still gives moves on."""

    def __init__(self, compute, size: int = CACHE):
        super().__init__()
        self.compute, self.size, self.older = compute, size, {}

    def __missing__(self, word):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(word)
        if ids is None:
            ids = self.compute(word)
        self[word] = ids
        return ids


class Encoder:
    """Whole texts through the tokenizer, remembering the ids of words already seen.

    Byte-level BPE never joins across a single space between two other
    characters that are not white space: the space opens the next piece.  Texts
    with any other white space around a space go to the tokenizer as they are,
    and so do words with characters beyond Latin letters or with special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.simple = kind["normalizer"] is None and kind["pre_tokenizer"] == plain and kind["model"]["type"] == "BPE"
        self.first, self.later = Words(lambda w: self._whole(w.decode()), 20_000), Words(lambda w: self._word(w.decode()))  # at the start of a text; after a space
        self.pieces = Words(self._piece, CACHE // 2)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalpha():
            mapped = piece.replace(" ", BYTE_CHARS[32])
        else:
            mapped = "".join(map(BYTE_CHARS.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def _word(self, word: str, lead: str = " ") -> bytes:
        """Ids of a word after a space (or after a line break), piece by piece through the tokenizer's model."""
        plain = word.isascii() and word.isprintable() or SIMPLE.fullmatch(word)
        if not self.simple or not plain or SPECIAL in word:
            return self._whole(lead + word)
        if word.isalpha():
            return self.pieces[lead + word]
        head = word.rstrip(MARKS)
        if head.isalpha():  # letters, then one run of marks
            return self.pieces[lead + head] + self.pieces[word[len(head):]]
        before, line, after = word.partition("\n")
        if before and after and after[0] != "\n":  # a line break between other characters is a piece of its own
            return self._word(before, lead) + self.pieces[line] + self._word(after, "")
        return b"".join(map(self.pieces.__getitem__, PIECE.findall(lead + word)))

    def _odd(self, text: str) -> bool:
        """Whether white space stands next to a space (or a space at either end)."""
        return text[:1] == " " or text[-1:] == " " or any(c in text and (c + " " in text or " " + c in text) for c in SPACES)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts end to end, and how many each has.

        Equal words of the texts are told by their hash and looked up once.
        """
        raw = data.tobytes()
        plain = np.ones(len(offs) - 1, bool)
        for d in suspects(data, offs):
            plain[d] = not self._odd(raw[offs[d]: offs[d + 1]].decode())
        s, e, bounds = arrays.tokens(data != 32, offs)
        doc = arrays.doc_of(bounds)
        use = plain[doc]
        s, e, doc = s[use], e[use], doc[use]
        opens = s == offs[doc]
        key = arrays.word_hashes(data, s, e) ^ opens.astype(np.uint64)
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        at, which = order[new], np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        later, first = self.later, self.first
        ids = [(first if o else later)[raw[a:b]] for o, a, b in
               zip(opens[at].tolist(), s[at].tolist(), e[at].tolist(), strict=True)]
        whole = np.flatnonzero(~plain)  # odd texts follow as one item each
        ids += [self._whole(raw[offs[d]: offs[d + 1]].decode()) for d in whole]
        which = np.concatenate([which, len(at) + np.arange(len(whole))])
        order = np.argsort(np.concatenate([doc, whole]), kind="stable")
        which, doc = which[order], np.concatenate([doc, whole])[order]
        size = np.array([len(x) // 4 for x in ids], np.int64)
        start = np.cumsum(size) - size
        n = size[which]
        place = np.repeat(start[which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.frombuffer(b"".join(ids), np.uint32)[place], np.bincount(doc, n, len(offs) - 1).astype(np.int64)


def encoder(path: str) -> Encoder:
    if path not in _known:
        _known.clear()
        _known[path] = Encoder(path)
    return _known[path]


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, part: int = 2 << 20) -> DataFrame:
    """``(doc_id, ids, counts)``: ids of each text and the end id, 16 or 32 bits each, zstd-compressed per document.

    The last row of a task has no document but the task's ``counts`` of all ids.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, end = encoder(tokenizer), zstandard.ZstdCompressor(level=1), np.array([end_id], np.uint32)
        total, id_type = np.zeros(0, np.int64), None
        for batch in batches:
            data, offs = arrays.flat(batch.column("text"))
            id_type = batch.column("doc_id").type
            for i, j in arrays.parts(offs, part):
                ids, n = enc.encode(data[offs[i]: offs[j]], offs[i: j + 1] - offs[i])
                total = added(total, np.append(ids, end), np.append(np.ones(len(ids), np.int64), j - i))
                packed = [pack(np.append(x, end), packer) for x in np.split(ids, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(packed, pa.binary()),
                                                  pa.nulls(j - i, pa.binary())], ["doc_id", "ids", "counts"])
        if id_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())],
                                             ["doc_id", "ids", "counts"])

    return docs.select("doc_id", "text").mapInArrow(arrays.giving_back(run), f"doc_id {kind}, ids binary, counts binary")


def added(total: np.ndarray, ids: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Counts per id, grown to the largest id."""
    n = np.bincount(ids, times).astype(np.int64)
    if len(n) > len(total):
        total = np.pad(total, (0, len(n) - len(total)))
    total[: len(n)] += n
    return total


def pack(ids: np.ndarray, packer) -> bytes:
    narrow = ids.max() < 1 << 16
    return bytes([2 if narrow else 4]) + packer.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack(blob: bytes, unpacker) -> np.ndarray:
    return np.frombuffer(unpacker.decompress(blob[1:]), "<u2" if blob[0] == 2 else "<u4").astype(np.uint32)


def id_counts(encoded: DataFrame) -> DataFrame:
    """``(id, n)`` over all documents; one row per id and task reaches the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                n = np.frombuffer(counts, np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["id", "n"])

    per_task = encoded.select("counts").filter(F.col("counts").isNotNull())
    return per_task.mapInArrow(arrays.giving_back(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# --- the code --------------------------------------------------------------------------

#: Bytes of each of the four ids that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def compress(ranks: np.ndarray, counts: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Control bytes and data bytes of each document; ``ranks`` has them end to end, ``counts`` how many each."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    groups = -(-counts // 4)
    shift = np.cumsum(groups) * 4 - groups * 4 - (np.cumsum(counts) - counts)  # each document starts a new control byte
    codes = np.zeros(int(groups.sum()) * 4, np.uint8)
    codes[np.arange(len(ranks)) + np.repeat(shift, counts)] = size - 1
    codes = codes.reshape(-1, 4)
    control = (codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6).tobytes()
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(groups)]).tolist()
    used = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [control[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], [data[a:b] for a, b in zip(used[:-1], used[1:], strict=True)]


def decompress(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of several documents laid end to end; ``counts`` has the ids of each."""
    groups = -(-counts // 4)
    lengths = LENGTHS[control].reshape(-1)
    real = np.ones(len(lengths), bool)
    ends = np.cumsum(groups) * 4
    pad = groups * 4 - counts
    for k in range(1, 4):  # the last group of a document may be partly empty
        real[ends[pad >= k] - k] = False
    lengths = lengths[real]
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lengths > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass(frozen=True)
class TokenFiles:
    """Where the files lie: ``docs`` in doc_id order, ``ranks`` with the id of each rank."""

    path: str

    @property
    def docs(self) -> str:
        return f"{self.path}/docs"

    @property
    def ranks(self) -> str:
        return f"{self.path}/ranks"


def _ranks(spark: SparkSession, files: TokenFiles) -> np.ndarray:
    """Id of each rank; at most one entry per vocabulary entry."""
    rows = spark.read.parquet(files.ranks).orderBy("rank").limit(MAX_VOCABULARY + 1).toPandas()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"over {MAX_VOCABULARY} different ids")
    return rows["id"].to_numpy(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = 0) -> TokenFiles:
    """Encode, rank and write all documents; returns where the files are."""
    spark = docs.sparkSession
    files = TokenFiles(path or new_dir(spark, "tokens"))
    encoded = materialize(encode_documents(docs, tokenizer, end_id), "token-ids")
    order = Window.orderBy(F.desc("n"), "id")  # one row per vocabulary entry
    (id_counts(encoded).withColumn("rank", F.row_number().over(order) - 1).select("rank", "id", "n")
     .write.parquet(files.ranks))
    ids = _ranks(spark, files)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    shared = spark.sparkContext.broadcast(rank)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _known.clear()  # texts are encoded: the words a worker has seen would stay with it for later jobs
        table, unpacker, start, part = shared.value, zstandard.ZstdDecompressor(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for i in range(0, len(batch), 500):
                some = batch.slice(i, 500)
                runs = [unpack(b, unpacker) for b in some.column("ids").to_pylist()]
                n = np.array([len(r) for r in runs], np.int64)
                control, data = compress(table[np.concatenate(runs)], n)
                starts = start + np.cumsum(n) - n
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array(np.full(len(n), part), pa.int32()), pa.array(starts), pa.array(n),
                     pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                    ["doc_id", "part", "start_in_part", "n_tokens", "control", "data"])

    # Ranges are sampled on the driver: of the order's columns only, so a hash of the ids stands for them.
    order = ["doc_id", F.xxhash64("ids")]
    ordered = encoded.filter(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(arrays.giving_back(run), f"doc_id {kind}, part int, start_in_part long, n_tokens long, control binary, data binary") \
        .write.parquet(files.docs)
    shared.unpersist()
    discard(encoded)
    return files


def read_tokens(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` decoded from the files."""
    shared = spark.sparkContext.broadcast(_ranks(spark, files))
    rows = spark.read.parquet(files.docs)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for batch in batches:
            for i in range(0, len(batch), 1000):
                some = batch.slice(i, 1000)
                n = some.column("n_tokens").to_numpy()
                join = lambda c: np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8)  # noqa: E731, B023
                plain = ids[decompress(join("control"), join("data"), n)].astype("<u4")
                ends = np.cumsum(n)
                crc = [zlib.crc32(plain[e - k: e]) for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(c) for c in ("doc_id", "part", "start_in_part", "n_tokens")), pa.array(crc, pa.int64())],
                    ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])

    decoded = rows.mapInArrow(arrays.giving_back(run), f"doc_id {kind}, part int, start_in_part long, n_tokens long, ids_crc32 long")
    return decoded.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("start_in_part") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32")


