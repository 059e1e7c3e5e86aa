"""Token-ID output: flat unsigned integer files with 64-bit document offsets, for memory mapping.

A data set is a folder of parts in ascending order. Part k has three files: ``.bin`` with the ids of all its documents, one
after the other, as little-endian unsigned integers of 16 bits (vocabularies up to 65,536) or 32; ``.idx`` with its
documents + 1 offsets, signed 64-bit little-endian numbers of ids from the start of the data set; ``.doc`` with the
documents' ids, signed 64-bit little-endian. The part's base is the prefix sum of the ids in earlier parts.

Defined results: documents come in ascending order of doc_id, those of one id in the order of a hash of their text, a null
doc_id last; repeated rows are each written. A null text is empty and is the end id alone. An empty table writes no part.
Other columns are ignored. A part file belongs to the attempt that reported it, so a task that ran twice leaves at most a
file that the list of parts does not name.
"""

from __future__ import annotations

import io
import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import accumulate
from typing import Any
from unicodedata import is_normalized
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixframe.llm.common import once, release, spans_of, texts

END_ID = 2
#: Characters that are cut at a time, and distinct pieces that a worker process remembers.
BLOCK_CHARS = 2_000_000
CACHE_WORDS = 400_000
#: Pieces of one pre-token each that are encoded at a time.
JOINED_WORDS = 1000
PARTS = "part int, path string, rows bigint, nulls bigint, ids bigint, width int"
LISTED = f"{PARTS}, base bigint"


def tokenizer(path: str) -> Any:
    """The tokenizer of a file, loaded once for each worker process."""
    from tokenizers import Tokenizer

    def load() -> Any:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task's core is the only one that is ours
        return Tokenizer.from_file(path)

    return once(f"tokenizer {path}", load)


#: What a tokenizer file must say for its texts to be cut as ``Encoder`` does.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
ADDED_FLAGS = ("single_word", "lstrip", "rstrip", "normalized")
#: Kinds of bytes, and whether a text is cut between a byte of one kind and the next: what is not plain stays with its neighbours.
SPACE, LETTER, MARK, DIGIT, OTHER = range(5)
CUT = np.ones((5, 5), bool)
CUT[[LETTER, MARK], [LETTER, MARK]] = CUT[OTHER, 1:] = CUT[1:, OTHER] = False
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
UPPER = LOWER != np.arange(256)


def _is_letter(c: str) -> bool:
    """Whether a character is a letter that lower-cases and composes to one letter."""
    return c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha() and is_normalized("NFC", c)


#: Whether characters of up to two bytes, among them the Latin, Greek, Cyrillic, Hebrew and Arabic ones, are such letters.
LETTERS = np.array([_is_letter(chr(c)) for c in range(0x800)])


class Known(dict):
    """Numbers of pieces; a piece that has none gets the next and is noted in ``new``."""

    def __init__(self) -> None:
        super().__init__({None: 0})  # the end of a document
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Ids of whole texts, with the ids of every distinct piece looked up once.

    A vocabulary that lower-cases and takes runs of letters, single digits and runs of marks as pre-tokens gives a text the
    ids of its pieces, in order, if it is cut only where pre-tokens end whatever is around: at white space, which it drops,
    and between plain letters, ASCII digits and ASCII marks. Apostrophes (contractions), what occurs in added tokens and
    characters that may compose with others are not cut from their neighbours. A-Z is lower-cased before pieces are told
    apart, but not in an added token, which keeps its case, nor before a character that may compose with it.

    A piece without such characters is one pre-token; many are encoded at a time, told apart by the suffix that ends a word.
    Other pieces are encoded one by one. Of more than ``limit`` pieces the half of the limit that was met most is kept.
    A vocabulary of any other form gets every text whole.
    """

    def __init__(self, path: str, end_id: int, limit: int = CACHE_WORDS) -> None:
        self.tokenizer, self.end_id, self.limit = tokenizer(path), end_id, limit
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.known = Known()
        self.ids = np.array([end_id], f"<u{self.width}")
        self.lengths, self.starts, self.met = np.array([1]), np.array([0]), np.array([0])
        form = json.loads(self.tokenizer.to_str())
        added = [token["content"] for token in form["added_tokens"]]
        self.cuts = (
            form["normalizer"] == NORMALIZER
            and form["pre_tokenizer"] == PRE_TOKENIZER
            and form["model"].get("end_of_word_suffix")
            and not any(form["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix"))
            and not any(token[flag] for token in form["added_tokens"] for flag in ADDED_FLAGS)
            and not any(content.isalpha() or any(map(str.isspace, content)) for content in added)
            and not (form["truncation"] or form["padding"])
        )
        if not self.cuts:
            return
        self.ends = np.zeros(max(form["model"]["vocab"].values(), default=0) + 1 + len(added), bool)
        self.ends[[n for token, n in form["model"]["vocab"].items() if token.endswith(form["model"]["end_of_word_suffix"])]] = True
        self.kinds = np.full(256, OTHER, np.uint8)
        for kind, plain in ((LETTER, string.ascii_letters), (MARK, string.punctuation), (DIGIT, string.digits)):
            apart = "'" + "".join(added) if kind != LETTER else ""
            self.kinds[[ord(c) for c in plain if c not in apart]] = kind
        self.kinds[[ord(c) for c in " \t\n\r"]] = SPACE
        # what comes before an added token's first letter is cheap to look for
        self.heads = {re.match(rb"[^a-z]*", a.encode().lower())[0] for a in added}
        self.added = re.compile(b"|".join(re.escape(a.encode()) for a in added), re.IGNORECASE)

    def _batch(self, some: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, odd: np.ndarray) -> None:
        """Ids of the new pieces, of which some are not known to be one pre-token."""
        new = self.known.new
        found: list[np.ndarray] = []
        sizes = np.zeros(len(new), np.int64)
        plain, others = np.flatnonzero(~odd), [np.flatnonzero(odd)]
        for start in range(0, len(plain), JOINED_WORDS):
            some = plain[start : start + JOINED_WORDS]
            ids = np.array(self._batch([b" ".join([new[i] for i in some.tolist()]).decode()])[0], np.int64)
            ends = np.flatnonzero(self.ends[ids])
            if len(ends) != len(some):
                others.append(some)
                continue
            sizes[some] = np.diff(ends, prepend=-1)
            found.append(ids.astype(self.ids.dtype))
        left = np.concatenate(others)
        done = np.setdiff1d(plain, left, assume_unique=True)
        single = self._batch([new[i].decode() for i in left.tolist()])
        sizes[left] = [len(ids) for ids in single]
        found.extend(np.array(ids, self.ids.dtype) for ids in single)
        order = np.concatenate([done, left])  # in which the ids lie
        starts = np.empty(len(new), np.int64)
        starts[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        self.starts, self.lengths = np.concatenate([self.starts, starts]), np.concatenate([self.lengths, sizes])
        self.met = np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.ids = np.concatenate([self.ids, *found])
        new.clear()

    def _gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after the other, and the number of ids up to the end of each."""
        size = self.lengths[which]
        until = np.cumsum(size)
        return self.ids[np.arange(until[-1]) + np.repeat(self.starts[which] - until + size, size)], until

    def _forget(self) -> None:
        """Keep the pieces that were met most; what they count for halves, so that newer ones can take their place."""
        keep = np.concatenate([[0], 1 + np.sort(np.argsort(-self.met[1:], kind="stable")[: self.limit // 2])])
        pieces = list(self.known)
        self.known = Known()
        self.known.update(zip([pieces[i] for i in keep.tolist()], range(len(keep)), strict=True))
        self.ids, until = self._gather(keep)
        self.lengths, self.met = self.lengths[keep], self.met[keep] // 2
        self.starts = until - self.lengths

    def _cut(self, text: bytes, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of texts that end at ``ends``, whether each has bytes of another kind, and the number of pieces up to each end."""
        raw = np.frombuffer(text, np.uint8)
        kinds = self.kinds[raw]
        two = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))  # first bytes of two
        two = two[LETTERS[(raw[two].astype(np.int64) & 31) << 6 | raw[two + 1] & 63]]
        kinds[two] = kinds[two + 1] = LETTER
        alone = np.ones(len(raw), bool)  # nothing that follows can compose with it
        alone[:-1] = (raw[1:] < 0x80) | (kinds[1:] == LETTER)
        lowered = np.where(alone, LOWER[raw], raw)
        if any(head in text for head in self.heads):
            for match in self.added.finditer(text):
                lowered[match.start() : match.end()] = raw[match.start() : match.end()]
        first = np.ones(len(raw) + 1, bool)
        first[1:-1] = CUT.ravel()[kinds[:-1] * np.uint8(5) + kinds[1:]]
        first[ends] = True
        kept = kinds != SPACE
        first = first[:-1]
        counts = np.searchsorted(np.flatnonzero(first & kept), ends)
        offsets = np.append(np.flatnonzero(first[kept]), np.count_nonzero(kept))
        odd = np.logical_or.reduceat(kinds[kept] == OTHER, offsets[:-1])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(lowered[kept])]
        return pa.Array.from_buffers(pa.large_binary(), len(odd), buffers), odd, counts

    def _whole(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [[*ids, self.end_id] for ids in self._batch(documents)]
        return np.concatenate([np.array(ids, self.ids.dtype) for ids in found]), np.array([len(ids) for ids in found])

    def encode(self, documents: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, each with its end id, and the number of ids of each."""
        if not self.cuts:
            return self._whole(documents)
        if len(self.known) > self.limit:
            self._forget()
        encoded = [document.encode() for document in documents]
        pieces, odd, ends = self._cut(b"".join(encoded), np.cumsum([len(e) for e in encoded]))
        said = pieces.dictionary_encode()
        first_new = len(self.known)
        numbers = np.fromiter(map(self.known.__getitem__, said.dictionary.to_pylist()), np.int64, len(said.dictionary))
        indices = said.indices.to_numpy()
        which = np.insert(numbers[indices], ends, 0)  # the end of each document
        if self.known.new:
            strange = np.zeros(len(numbers), bool)
            strange[indices[odd]] = True
            self._learn(strange[numbers >= first_new])
        self.met += np.bincount(which, minlength=len(self.met))
        ids, until = self._gather(which)
        return ids, np.diff(until[ends + np.arange(len(ends))], prepend=0)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file of numbers: memory-mapped where it is local, read once where it is not."""
    system, name = _open(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(name, dtype, "r") if os.path.getsize(name) else np.empty(0, dtype)
    with system.open_input_file(name) as file:
        return np.frombuffer(file.read(), dtype)


def _writer(folder: str, path: str, end_id: int):  # noqa: ANN202
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        name = f"{folder}/part-{part:06d}-{context.taskAttemptId()}"
        encoder, rows, nulls, total = None, 0, 0, 0
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        out: Any = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = once(f"encoder {path} {end_id}", lambda: Encoder(path, end_id))
                system, local = _open(name)
                system.create_dir(os.path.dirname(local), recursive=True)
                out = io.BufferedWriter(system.open_output_stream(f"{local}.bin"), 1 << 20)
            said = texts(batch.column(1))
            for block in spans_of(np.array([len(t) for t in said]), BLOCK_CHARS):
                found, lengths = encoder.encode(said[block])
                out.write(found.tobytes())
                sizes.append(lengths)
                total += len(found)
            ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            rows, nulls = rows + batch.num_rows, nulls + batch.column(0).null_count
        if encoder is None:
            return
        out.close()
        for ending, values in (("doc", np.concatenate(ids)), ("len", np.concatenate(sizes).astype("<i8"))):
            with system.open_output_stream(f"{local}.{ending}") as file:
                file.write(values.tobytes())
        release()
        row = (part, name, rows, nulls, total, encoder.width)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _types(PARTS), strict=True)], names=_names(PARTS))

    return write


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _types(schema: str) -> list[pa.DataType]:
    return [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[field.split()[1]] for field in schema.split(", ")]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write the offsets of each listed part, now that its base is known."""
    for batch in batches:
        for row in batch.to_pylist():
            lengths = mapped(f"{row['path']}.len", "<i8")
            offsets = np.concatenate([[0], np.cumsum(lengths)]) + row["base"]
            system, name = _open(f"{row['path']}.idx")
            with system.open_output_stream(name) as file:
                file.write(offsets.astype("<i8").tobytes())
        yield batch


def listed(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """A row for each part, one to a task."""
    table = spark.createDataFrame(parts, LISTED)
    return table.repartition(max(1, len(parts)))


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> list[tuple]:
    """Encode ``docs`` (doc_id, text) into ``folder`` with the tokenizer file ``path``; returns the parts with their bases.

    The folder must be one that all executors and the driver share. The driver sees one row for each part.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = sorted(map(tuple, rows.mapInArrow(_writer(folder, path, end_id), PARTS).collect()))
    bases = [0, *accumulate(part[4] for part in found)]
    parts = [(*part, base) for part, base in zip(found, bases, strict=False)]
    if parts:
        listed(docs.sparkSession, parts).mapInArrow(_index, LISTED).write.format("noop").mode("overwrite").save()
    return parts


def read_documents(part: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, start and ids of every document of a listed part, from its files."""
    ids, offsets = mapped(f"{part['path']}.bin", f"<u{part['width']}"), mapped(f"{part['path']}.idx", "<i8")
    names = mapped(f"{part['path']}.doc", "<i8")
    named = part["rows"] - part["nulls"]
    for i in range(part["rows"]):
        start, end = int(offsets[i]), int(offsets[i + 1])
        yield (int(names[i]) if i < named else None), start, ids[start - part["base"] : end - part["base"]]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            rows = [(d, s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, s, ids in read_documents(part)]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_names(DIGESTS))
            release()


DIGESTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def digests(spark: SparkSession, parts: list[tuple]) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and ids_crc32 (of the ids as unsigned 32-bit integers)."""
    if not parts:
        return spark.createDataFrame([], DIGESTS)
    return listed(spark, parts).mapInArrow(_digests, DIGESTS)
