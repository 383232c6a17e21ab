"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over bytes cuts every text into chunks, so that a passage yields the same
chunks wherever it stands.  A first pass over chunk hashes finds which occur more than once and
marks them in a bit map of fixed size.  Texts without a marked chunk share nothing: they are
encoded where they are read, chunk by chunk.  The others go through two shuffles:

1. Marked chunks are dealt by digest; equal ones of a task's batch are one row with a list of
   owners (document, place), so that a passage travels once a batch.  Each different chunk is
   encoded once, whichever documents it stands in, and its ids go to all its owners.  Owners
   of a chunk beyond ``OWNERS`` in one map task form blocks of their own, which are dealt
   apart: a chunk of a third of all documents is no hot key.
2. A document's chunks, shared and own, meet in order.

Words at a cut may be halves, so each join of two chunks is repaired: the last words of the
left chunk and the first of the right one are encoded again as one text, and the window grows
by a word on each side until the new ids begin and end exactly with those that the chunks
themselves had for the outermost words.

The bit map decides only which way a chunk takes: where it is crowded, more texts travel.
Texts and ids are compressed before they travel.  Ids are decoded entry by entry where the vocabulary has no decoder, else by the library.
"""

from __future__ import annotations

import functools
import json
import re
import struct
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import per_text, portions, session, tasks_for, text_bytes
from .tokens import ODD, byte_alphabet

#: Mean and least bytes of a chunk (the mean a power of two) and the bytes its cut depends on.
CHUNK_BYTES, LEAST_BYTES, WINDOW = 2048, 256, 16
#: Words at either end of a chunk whose text is kept for joins.
EDGE = 4
#: Owners of one chunk in a map task that are dealt by its digest alone, and in each further block.
OWNERS, BLOCK = 32, 1024
#: Words that a worker remembers and chunks whose owners a task counts: memory bounds; results do not depend on them.
KEEP_WORDS, KEEP_COUNTS = 200_000, 1_000_000
#: MB of input text for each task of the two shuffles.
TASK_MB = 8.0
#: 64-bit words of the bit map that marks shared chunks: 8 MB, whatever the input.
MARKS = 1 << 20

WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)


@functools.cache
def zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=3, write_checksum=False), zstandard.ZstdDecompressor()


def packed(piece: tuple) -> bytes:
    """An encoded chunk as one compressed value."""
    ids, *rest = piece
    parts = [ids or b"", *rest]
    return zstd()[0].compress(struct.pack("<6i", ids is not None, *map(len, parts)) + b"".join(parts))


def unpacked(value: bytes) -> tuple:
    raw = zstd()[1].decompress(value)
    known, *sizes = struct.unpack_from("<6i", raw)
    parts, at = [], 24
    for n in sizes:
        parts.append(raw[at : at + n])
        at += n
    return (parts[0] if known else None, *parts[1:])


def cuts(raw: np.ndarray) -> np.ndarray:
    """Positions after which a chunk ends, from a gear hash of the last ``WINDOW`` bytes.

    A cut inside a UTF-8 character moves to its end.
    """
    h = _GEAR[raw]
    s = 1
    while s < WINDOW:  # doubling: after each round h covers twice as many bytes
        shifted = h[:-s] << np.uint32(s)
        h = h.copy()
        h[s:] += shifted
        s *= 2
    at = np.flatnonzero((h >> np.uint32(8)) & np.uint32(CHUNK_BYTES - 1) == 0) + 1
    for _ in range(3):
        inside = at < len(raw)
        inside[inside] = raw[at[inside]] & 0xC0 == 0x80
        at = at + inside
    return np.unique(at)


def spaced(ends: list[int], size: int) -> list[int]:
    """The cuts of one text that lie at least ``LEAST_BYTES`` apart, and the text's end."""
    out, last = [], 0
    for e in ends:
        if e - last >= LEAST_BYTES and e < size:
            out.append(e)
            last = e
    return [*out, size]


class Memory(dict):
    """Computes what it does not know.  Of a full memory the later half stays; long keys never do."""

    def __init__(self, fn):
        self.fn, self.old = fn, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.fn(key)
        if len(key) <= 64:
            if len(self) >= KEEP_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class ChunkedBpe:
    """One vocabulary in one worker: chunks to ids, and documents from chunks."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        spec = json.loads(self.tok.to_str())
        vocab = self.tok.get_vocab()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.lowered = [s.lower() for s in self.special]
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.token = np.full(max(vocab.values()) + 1, "", object)
        for t, i in vocab.items():
            self.token[i] = t
        self.spaced = self._drops_space(spec)
        self.joined = spec.get("decoder") is None
        shown = dict(enumerate(byte_alphabet()))
        symbols = lambda p: p if p.isascii() else p.encode().decode("latin-1").translate(shown)
        code = lambda ids: array("H" if self.kind == "<u2" else "I", ids).tobytes()
        #: ids of pre-tokens and of lower-cased words of plain characters, and of all other words as they stand.
        self.pieces = Memory(lambda p: code([t.id for t in self.tok.model.tokenize(symbols(p))]))
        self.words = Memory(lambda w: b"".join([self.pieces[p] for p in WORDS.findall(w)]))
        self.odd = Memory(lambda w: code(self.tok.encode(w, add_special_tokens=False).ids))

    def _drops_space(self, spec: dict) -> bool:
        """Whether words between white space encode alone, the way ``encode_words`` reads them."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        split = bool(steps) and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[0]["pattern"].get("Regex") == SPLIT_PATTERN
        normal = (spec.get("normalizer") or {}).get("normalizers") or [spec.get("normalizer") or {}]
        kinds = [n.get("type") for n in normal]
        lower = kinds.count("Lowercase") == 1 and set(kinds) <= {"NFC", "Replace", "Lowercase"}
        blanks = all(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal if n.get("type") == "Replace")
        return bool(split and lower and blanks and spec["model"].get("end_of_word_suffix") == "</w>" and not any(re.search(r"\s", s) for s in self.special))

    # --- words, chunks, joins ------------------------------------------------------------

    def encode_words(self, raw: bytes) -> list[bytes]:
        """The ids of every word of a chunk or a window, in order."""
        text = raw.decode()
        low = text.lower()
        if ODD.search(text) or any(s in low for s in self.lowered):
            return [self.odd[w.decode()] for w in raw.split()]
        return list(map(self.words.__getitem__, low.split()))

    def chunk(self, raw: bytes) -> tuple:
        """(ids, head, tail, ids of each of the head's words, of the tail's), or (None, raw, ...).

        Head and tail are the first and last ``EDGE`` words with the white space about them.
        A chunk of few words has no middle and is left to its document's joins whole.
        """
        got = self.encode_words(raw)
        if len(got) < 2 * EDGE:
            return None, raw, b"", b"", b""
        size = np.dtype(self.kind).itemsize
        rest, lead = raw.split(None, EDGE)[-1], raw.rsplit(None, EDGE)[0]
        counts = [np.array([len(x) // size for x in part], "<u4").tobytes() for part in (got[:EDGE], got[-EDGE:])]
        return b"".join(got), raw[: len(raw) - len(rest)], raw[len(lead) :], *counts

    def document(self, chunks: Iterator[tuple]) -> bytes:
        """The ids of a whole text from its chunks in order."""
        out: list[bytes] = []
        left: tuple | None = None  # tail, its ids by word
        between = b""
        for ids, head, tail, head_n, tail_n in chunks:
            if ids is None:
                between += head
                continue
            size = np.dtype(self.kind).itemsize
            a = np.cumsum(np.frombuffer(head_n, "<u4").astype(np.int64) * size)
            z = len(ids) - np.cumsum(np.frombuffer(tail_n, "<u4")[::-1].astype(np.int64) * size)
            first = [ids[i:j] for i, j in zip([0, *a.tolist()[:-1]], a.tolist(), strict=True)]
            ends = [len(ids), *z.tolist()]
            last = [ids[ends[k + 1] : ends[k]] for k in range(EDGE)][::-1]
            if left is None and not between:
                out += first
            else:
                out += self.join(left, between, (head, first))
            out.append(ids[a[-1] : z[-1]])
            left, between = (tail, last), b""
        if between:
            out += self.join(left, between, None)
        elif left is not None:
            out += left[1]
        return b"".join(out)

    def join(self, left: tuple | None, between: bytes, right: tuple | None) -> list[bytes]:
        """Ids from the left chunk's tail to the right chunk's head, encoded again until they agree."""
        for k in range(2, EDGE + 1):
            text, start, end = between, None, None
            if left is not None:
                text, start = left[0][len(left[0].rsplit(None, k)[0]) if k < EDGE else 0 :] + text, left[1][-k]
            if right is not None:
                text, end = text + (right[0][: len(right[0]) - len(right[0].split(None, k)[-1])] if k < EDGE else right[0]), right[1][k - 1]
            got = b"".join(self.encode_words(text))
            if (start is None or got.startswith(start)) and (end is None or got.endswith(end)):
                return [*(left[1][:-k] if left is not None else []), got, *(right[1][k:] if right is not None else [])]
        raise ValueError("white space does not part this vocabulary's words")

    def decode(self, ids: np.ndarray) -> str:
        if self.joined:
            return " ".join(self.token[ids].tolist())
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


@functools.cache
def chunked(path: str) -> ChunkedBpe:
    return ChunkedBpe(path)


# --- Spark stages ------------------------------------------------------------------------


def chunks_of(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, bytes, list[bytes]]]:
    """(row, text, chunks) of every text of a batch; an empty text is one empty chunk."""
    at = cuts(raw)
    lo, hi = np.searchsorted(at, offs[:-1] + WINDOW), np.searchsorted(at, offs[1:])
    for d in range(len(offs) - 1):
        text, chunks, start = raw[offs[d] : offs[d + 1]].tobytes(), [], 0
        for end in spaced((at[lo[d] : hi[d]] - offs[d]).tolist(), len(text)):
            chunks.append(text[start:end])
            start = end
        yield d, text, chunks


def chunk_hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk)


def shared_marks(docs: DataFrame) -> np.ndarray:
    """The bit map of all chunks that occur more than once in (text) rows, and of a few others."""

    def run(batches):
        for b in (p for whole in batches for p in portions(whole, 0)):
            found = [chunk_hash(c) for _, _, chunks in chunks_of(*text_bytes(b.column(0))) for c in chunks]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.uint64).astype(np.int64))], ["h"])

    many = docs.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    words = many.select(F.expr(f"shiftrightunsigned(h, 6) % {MARKS}").alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most MARKS rows
    out = np.zeros(MARKS, np.uint64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy().astype(np.uint64)
    return out


def marked(marks: np.ndarray, chunk: bytes) -> bool:
    h = chunk_hash(chunk)
    return bool(int(marks[(h >> 6) % len(marks)]) >> (h & 63) & 1)


def text_name(text: bytes) -> bytes:
    return xxhash.xxh3_64_digest(text)


def chunk_rows(docs: DataFrame, kind: str, marks) -> DataFrame:
    """(digest, salt, chunk, ids, names, places): the marked chunks of (id, text) rows with their owners.

    An owner is a row's id, a hash of its text, which tells rows with the same id apart, and
    the chunk's place in it; the last two are packed, 8 and 4 bytes each.  Equal chunks of a
    batch are one row.
    """

    def run(batches):
        task, sent = TaskContext.get().partitionId(), {}
        for b in (p for whole in batches for p in portions(whole, 1)):
            found: dict[tuple[bytes, int], tuple[bytes, list, list, list]] = {}
            for d, text, chunks in chunks_of(*text_bytes(b.column(1))):
                name = text_name(text)
                for place, chunk in enumerate(chunks):
                    if not marked(marks.value, chunk):
                        continue
                    digest = xxhash.xxh3_128_digest(chunk)
                    n = sent[digest] = sent.get(digest, 0) + 1
                    key = (digest, 0 if n <= OWNERS else (task << 32) + 1 + n // BLOCK)
                    row = found.get(key)
                    if row is None:
                        row = found[key] = (zstd()[0].compress(chunk), [], [], [])
                    row[1].append(d)
                    row[2].append(name)
                    row[3].append(place)
            if len(sent) > KEEP_COUNTS:
                sent.clear()
            rows = list(found.values())
            owners = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(r[1]) for r in rows]), pa.int32()), b.column(0).take(pa.array([d for r in rows for d in r[1]], pa.int32())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in found], pa.binary()),
                    pa.array([k[1] for k in found], pa.int64()),
                    pa.array([r[0] for r in rows], pa.binary()),
                    owners,
                    pa.array([b"".join(r[2]) for r in rows], pa.binary()),
                    pa.array([np.array(r[3], "<u4").tobytes() for r in rows], pa.binary()),
                ],
                ["digest", "salt", "chunk", "ids", "names", "places"],
            )

    return docs.mapInArrow(run, f"digest binary, salt long, chunk binary, ids array<{kind}>, names binary, places binary")


def own_pieces(docs: DataFrame, kind: str, marks, tokenizer: str) -> DataFrame:
    """(id, name, place, piece) of the other chunks of texts that have a marked one."""

    def run(batches):
        bpe = chunked(tokenizer)
        for b in (p for whole in batches for p in portions(whole, 1)):
            rows: list[tuple] = []
            for d, text, chunks in chunks_of(*text_bytes(b.column(1))):
                shared = [marked(marks.value, c) for c in chunks]
                if any(shared):
                    name = int.from_bytes(text_name(text), "little", signed=True)
                    rows += [(d, name, place, packed(bpe.chunk(c))) for place, (c, s) in enumerate(zip(chunks, shared, strict=True)) if not s]
            cols = [b.column(0).take(pa.array([r[0] for r in rows], pa.int32()))]
            cols += [pa.array([r[k] for r in rows], t) for k, t in ((1, pa.int64()), (2, pa.int32()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "name", "place", "piece"])

    return docs.mapInArrow(run, f"id {kind}, name long, place int, piece binary")


def coded(ids: pa.Array, codes: list[np.ndarray], texts: list[str]) -> pa.RecordBatch:
    """(id, ids, decoded) rows."""
    flat = np.concatenate(codes).astype(np.int32) if codes else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, codes)]), pa.int32()), pa.array(flat)), pa.array(texts, pa.string())], ["id", "ids", "decoded"])


def own_texts(docs: DataFrame, kind: str, marks, tokenizer: str) -> DataFrame:
    """(id, ids, decoded) of texts that share no chunk."""

    def run(batches):
        bpe = chunked(tokenizer)
        for b in (p for whole in batches for p in portions(whole, 1)):
            at, codes = [], []
            for d, _, chunks in chunks_of(*text_bytes(b.column(1))):
                if not any(marked(marks.value, c) for c in chunks):
                    at.append(d)
                    codes.append(np.frombuffer(bpe.document(map(bpe.chunk, chunks)), bpe.kind))
            yield coded(b.column(0).take(pa.array(at, pa.int32())), codes, [bpe.decode(c) for c in codes])

    return docs.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def encoded_chunks(chunks: DataFrame, kind: str, tokenizer: str) -> DataFrame:
    """(id, name, place, piece) for every owner; each chunk is encoded once, equal ones following one another."""

    def run(batches):
        bpe, last, piece = chunked(tokenizer), None, None
        for b in (p for whole in batches for p in portions(whole, 2)):
            pieces = []
            for digest, chunk in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if digest != last:
                    last, piece = digest, packed(bpe.chunk(zstd()[1].decompress(chunk)))
                pieces.append(piece)
            places = np.frombuffer(b"".join(b.column(5).to_pylist()), "<u4").astype(np.int32)
            names = np.frombuffer(b"".join(b.column(4).to_pylist()), "<i8")
            whose, ids = np.repeat(np.arange(len(pieces)), [len(x) // 4 for x in b.column(5).to_pylist()]), b.column(3).flatten()
            for i in range(0, len(whose), 1024):  # many owners of one chunk are many rows
                j = min(i + 1024, len(whose))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(names[i:j]), pa.array(places[i:j]), pa.array([pieces[k] for k in whose[i:j].tolist()], pa.binary())], ["id", "name", "place", "piece"])

    return chunks.mapInArrow(run, f"id {kind}, name long, place int, piece binary")


def whole_texts(pieces: DataFrame, kind: str, tokenizer: str) -> DataFrame:
    """(id, ids, decoded) from pieces that follow one another by id, text and place.

    Rows that have id and text in common come together; each gets its row.
    """

    def run(batches):
        bpe = chunked(tokenizer)
        held: list[tuple] = []  # pieces of the document that is being read, one a place
        many, now = 0, None
        done: list[tuple] = []

        def finish():
            nonlocal many, held
            if many:
                ids = np.frombuffer(bpe.document(iter(held)), bpe.kind)
                done.append((now[0], ids, bpe.decode(ids), many))
            held, many = [], 0

        def flush():
            rows = (r for r in done for _ in range(r[3]))
            for part in iter(lambda: list(islice(rows, 1000)), []):
                yield coded(pa.array([r[0] for r in part], own), [r[1] for r in part], [r[2] for r in part])
            done.clear()

        own, size = pa.int64(), 0
        for b in batches:
            own = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or row[:2] != now:
                    finish()
                    now = row[:2]
                if row[2] == 0:
                    many += 1
                if len(held) == row[2]:
                    held.append(unpacked(row[3]))
                    size += len(row[3])
                if size > 1 << 20:
                    size = 0
                    yield from flush()
        finish()
        yield from flush()

    return pieces.mapInArrow(run, f"id {kind}, ids array<int>, decoded string")


def encode_decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and decode it again: id, ids (array<int>) and decoded (string).

    Equal to the library's ``encode(text, add_special_tokens=False)`` and ``decode(ids,
    skip_special_tokens=False)``.  Null texts count as empty: no ids, an empty string.  Rows
    that repeat, and rows with a null id, each get a row; an empty table gives an empty one;
    other columns are not read.  Vocabularies that do not drop white space, or that normalise
    otherwise than by lower case, are encoded text by text by the library.
    """
    session(df)
    if chunked(tokenizer).spaced:
        kind = dict(df.dtypes)[id_col]
        docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        parts, marks = tasks_for(docs, TASK_MB), df.sparkSession.sparkContext.broadcast(shared_marks(docs))
        chunks = chunk_rows(docs, kind, marks).repartition(parts, "digest", "salt").sortWithinPartitions("digest")
        pieces = encoded_chunks(chunks, kind, tokenizer).union(own_pieces(docs, kind, marks, tokenizer))
        pieces = pieces.repartition(parts, "id", "name").sortWithinPartitions("id", "name", "place")
        return own_texts(docs, kind, marks, tokenizer).union(whole_texts(pieces, kind, tokenizer)).withColumnRenamed("id", id_col)

    def run(texts: list) -> list[pa.Array]:
        bpe = chunked(tokenizer)
        ids = [bpe.tok.encode(t or "", add_special_tokens=False).ids for t in texts]
        return [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.tok.decode(i, skip_special_tokens=False) for i in ids], pa.string())]

    return per_text(df, id_col, text_col, run, "ids array<int>, decoded string")
