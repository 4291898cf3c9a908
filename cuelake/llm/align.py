"""Cross-tokenizer alignment: inverted bitmaps of linked id pairs."""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of text and documents of one chunk, whose documents are numbered in 16 bits.
CHUNK_BYTES, CHUNK_DOCS = 8 << 20, 1 << 16
#: Characters that are looked at in one go, and pieces that a task remembers before it begins anew.
STRETCH, REMEMBERED = 1 << 20, 500_000
#: A text may be cut before a space that follows one of these: no token of either kind lies across.
CUT = re.compile(r"(?<=[\w!-~])(?= [\s\S])")
SAFE_END = re.compile(r"[\w!-~]\Z")
#: A word of more characters is read by the library that doesn't slow down on it.
LONG = 512
#: How a byte-level tokenizer parts texts before it merges; a fixed value.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

POSTINGS = "chunk long, pair long, plane int, packed boolean, bits long, docs long, members binary"
SUMMARY = "chunk long, slot int, doc_id {id}, n_a long, n_b long, n_groups long, groups_sha256 string"


def _byte_letters() -> dict[str, int]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1 ones stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers, made in a task from the bytes of their files."""

    def __init__(self, json_file: bytes, model_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_file.decode())
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        spelled = {i: bytes(letters[c] for c in piece) if set(piece) <= letters.keys() else piece.encode() for piece, i in vocab.items()}
        self.a_bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.b = SentencePieceProcessor(model_proto=model_file)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.a_size, self.b_size = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        #: Whether texts may be cut at all: no piece lies across a cut, and spaces are kept as they are.
        self.cuts = not any(re.search("[^▁]▁", p) for p in names) and b"".join(self.b_bytes[i] for i in self.b.encode(" a  b")) == b"  a  b"
        self.quick = self._quick(json.loads(json_file), spelled)

    def _quick(self, spec: dict, spelled: dict[int, bytes]):
        """The faster of two libraries for the same vocabulary, where ids rank the merges as it asks for; else None."""
        special = {t["id"] for t in spec["added_tokens"]}
        split = spec.get("pre_tokenizer") or {}
        merged = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"].get("merges", [])]
        vocab = spec["model"]["vocab"]
        ranked = [vocab.get(x + y, -1) for x, y in merged]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        if not plain or len(merged) + 256 != len(vocab) - len(special & set(vocab.values())) or ranked != list(range(256, 256 + len(ranked))):
            return None
        import tiktoken

        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks={x: i for i, x in spelled.items() if i not in special}, special_tokens={}).encode_ordinary

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and by B of a space and each text."""
        if self.quick is None:
            own = [x.ids for x in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        else:
            # The faster library takes time in the square of a long word.
            own = [self.quick(" " + t) if len(t) <= LONG else self.a.encode(" " + t, add_special_tokens=False).ids for t in texts]
        return own, self.b.encode(texts, num_threads=1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def groups_of(pair: Pair, texts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray]:
    """``(good, n_a, n_b, groups, links, n_links)`` of a space and each text whose bytes come back, at the places ``good``.

    Of each such text the numbers of tokens, the groups as text, and the number of links; the links ``a << 32 | b`` of all
    stand one after the other. All texts are looked at as one row of bytes.
    """
    a_ids, b_ids = pair.ids(texts)
    whole = [b" " + t.encode() for t in texts]
    good = list(range(len(texts)))
    (a, n_a), (b, n_b) = _flat(a_ids), _flat(b_ids)
    every = b"".join(whole)
    if any(b"".join(map(spelled.__getitem__, ids.tolist())) != every for spelled, ids in ((pair.a_bytes, a), (pair.b_bytes, b))):
        good = [i for i in good if all(b"".join(map(spelled.__getitem__, ids)) == whole[i] for spelled, ids in ((pair.a_bytes, a_ids[i]), (pair.b_bytes, b_ids[i])))]
        (a, n_a), (b, n_b) = _flat([a_ids[i] for i in good]), _flat([b_ids[i] for i in good])
    if not good:
        return good, n_a, n_b, [], a, n_a
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    cuts = a_end[np.isin(a_end, b_end, assume_unique=True)]
    links = a[np.searchsorted(a_end, cuts)] << 32 | b[np.searchsorted(b_end, cuts)]
    # Tokens in the order of the groups' text: A's of a group, then B's. The sign after each says what comes next.
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group)
    b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, side="right")
    ids, kind = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    ids[a_place], ids[b_place], kind[a_place], kind[b_place] = a, b, 2 * a_group, 2 * b_group + 1
    sign = np.where(np.r_[kind[1:] == kind[:-1], False], 0, np.where(kind % 2 == 0, 1, 2))
    said = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), pa.array([",", "|", ";"]).take(pa.array(sign)), "")
    at = np.frombuffer(said.buffers()[1], np.int32)[: len(said) + 1]
    letters = said.buffers()[2].to_pybytes()[: at[-1]].decode()
    ends = at[np.cumsum(n_a + n_b)].tolist()
    groups = [letters[x : y - 1] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    text_ends = np.cumsum(np.fromiter((len(whole[i]) for i in good), np.int64, len(good)))
    return good, n_a, n_b, groups, links, np.diff(np.searchsorted(cuts, text_ends, side="right"), prepend=0)


class Pieces:
    """Pieces between cuts, each aligned once and remembered: repeated words cost one look-up. Number 0 stands for all whose bytes don't come back."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.forget()

    def forget(self) -> None:
        self.of: dict[str, int] = {}
        self.said = [""]
        self.size_a, self.size_b, self.links = array("q", [0]), array("q", [0]), array("q")
        self.ends = array("q", [0, 0])

    def _learn(self, keys: list[str], texts: list[str]) -> None:
        if not keys:
            return
        good, n_a, n_b, groups, links, n_links = groups_of(self.pair, texts)
        first = len(self.said)
        if len(good) < len(keys):
            self.of.update(dict.fromkeys(keys, 0))
            keys = [keys[i] for i in good]
        self.of.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.said += groups
        self.ends.frombytes((self.ends[-1] + np.cumsum(n_links)).astype(np.int64).tobytes())
        for own, more in ((self.size_a, n_a), (self.size_b, n_b), (self.links, links)):
            own.frombytes(more.astype(np.int64).tobytes())

    def _stretches(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + STRETCH) if self.pair.cuts and len(text) - at > STRETCH else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def _numbers(self, parts: list[str]) -> list[list[int]]:
        """Numbers of the pieces of each stretch; a stretch begins with a space."""
        out: list[list[int]] = [[-1]] * len(parts)
        if self.pair.cuts:
            words = [p[1:].split(" ") for p in parts]
            new = [w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.of]
            # No cut may follow some words, so stretches that hold one go the other way.
            self.of.update((w, -1) for w in new if not SAFE_END.search(w))
            new = [w for w in new if w not in self.of]
            self._learn(new, new)
            out = [list(map(self.of.__getitem__, w)) for w in words]
        left = [i for i, x in enumerate(out) if -1 in x]
        keys = [CUT.split(parts[i]) if self.pair.cuts else [parts[i]] for i in left]
        new = [k for k in dict.fromkeys(chain.from_iterable(keys)) if k not in self.of]
        self._learn(new, [k[1:] for k in new])
        for i, own in zip(left, keys, strict=True):
            out[i] = list(map(self.of.__getitem__, own))
        return out

    def read(self, texts: list[str | None]) -> list[tuple[np.ndarray, str] | None]:
        """Of each text the numbers of its pieces and the hash of its groups; None for one without tokens."""
        out: list[tuple[np.ndarray, str] | None] = [None] * len(texts)
        short = [i for i, t in enumerate(texts) if t and len(t) < STRETCH]
        for i, numbers in zip(short, self._numbers([" " + texts[i] for i in short]), strict=True):
            if 0 not in numbers:
                out[i] = np.array(numbers, np.int64), hashlib.sha256(";".join(map(self.said.__getitem__, numbers)).encode()).hexdigest()
        for i, t in enumerate(texts):
            if t and len(t) >= STRETCH:
                sha, parts = hashlib.sha256(), []
                for part in self._stretches(" " + t):
                    (numbers,) = self._numbers([part])
                    if 0 in numbers:
                        break
                    sha.update((";" if parts else "").encode() + ";".join(map(self.said.__getitem__, numbers)).encode())
                    parts.append(np.array(numbers, np.int64))
                else:
                    out[i] = np.concatenate(parts), sha.hexdigest()
        return out


_made: dict[bytes, Pieces] = {}


def _pieces(files: tuple[bytes, bytes]) -> Pieces:
    """The pieces of a Python worker, which go on from task to task."""
    key = hashlib.sha256(files[0] + files[1]).digest()
    if key not in _made:
        _made[key] = Pieces(Pair(*files))
    return _made[key]


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers start, start + 1, ... of each stretch."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def postings_of(doc: np.ndarray, pair: np.ndarray, n_docs: int, chunk: int) -> pa.RecordBatch:
    """Rows of POSTINGS of one chunk from its links. Plane k of a pair holds the documents whose number of links has bit k.

    A plane is a sorted list of 16-bit numbers or, if that is shorter, a bitmap. ``docs`` is the size of the union of a pair's
    planes, said once, on the first of them.
    """
    names, at = np.unique(pair, return_inverse=True)
    key, times = np.unique(at.astype(np.int64) * CHUNK_DOCS + doc, return_counts=True)
    top = int(times.max()).bit_length() if len(times) else 0
    plane = np.concatenate([np.full(int(((times >> k) & 1).sum()), k) for k in range(top)] or [np.zeros(0, int)])
    key = np.concatenate([key[(times >> k) & 1 == 1] for k in range(top)] or [np.zeros(0, np.int64)])
    order = np.lexsort((key % CHUNK_DOCS, plane, key // CHUNK_DOCS))
    plane, which, member = plane[order], (key // CHUNK_DOCS)[order], (key % CHUNK_DOCS)[order].astype("<u2")
    first = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (plane[1:] != plane[:-1])]) if len(which) else np.zeros(0, int)
    bits = np.diff(np.r_[first, len(which)])
    union = np.bincount(which, minlength=len(names)) if top == 1 else np.bincount(np.unique(which * CHUNK_DOCS + member) // CHUNK_DOCS, minlength=len(names))
    lead = np.r_[True, which[first][1:] != which[first][:-1]] if len(first) else np.zeros(0, bool)
    width = -(-n_docs // 8)
    packed = 2 * bits > width
    rows = []
    for s, n, p in zip(first.tolist(), bits.tolist(), packed.tolist(), strict=True):
        own = member[s : s + n]
        if p:
            flags = np.zeros(n_docs, np.uint8)
            flags[own] = 1
            rows.append(np.packbits(flags, bitorder="little").tobytes())
        else:
            rows.append(own.tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(first), chunk), pa.int64()), pa.array(names[which[first]], pa.int64()), pa.array(plane[first], pa.int32()), pa.array(packed), pa.array(bits, pa.int64()), pa.array(np.where(lead, union[which[first]], 0), pa.int64()), pa.array(rows, pa.binary())],
        names=["chunk", "pair", "plane", "packed", "bits", "docs", "members"],
    )


def members(packed: list[bool], blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of all planes one after the other, and how many each has."""
    parts = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little")) if p else np.frombuffer(x, "<u2") for p, x in zip(packed, blobs, strict=True)]
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64), np.array([len(x) for x in parts], np.int64)


def _index(files, id_type: pa.DataType):
    """Task that turns ``(doc_id, text)`` into one summary row a document and the postings of each chunk, marked by ``kind``."""
    summary = [("slot", pa.int32()), ("doc_id", id_type), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
    posting = [("pair", pa.int64()), ("plane", pa.int32()), ("packed", pa.bool_()), ("bits", pa.int64()), ("docs", pa.int64()), ("members", pa.binary())]
    schema = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), *summary, *posting])

    def full(kind: str, chunk: int, n: int, cols: dict) -> pa.RecordBatch:
        cols = {"kind": pa.array([kind] * n, pa.string()), "chunk": pa.array(np.full(n, chunk), pa.int64())} | cols
        return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(files.value)
        chunk, seen = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list = []
        read: list = []

        def look() -> None:
            read.extend(pieces.read(texts))
            texts.clear()

        def done() -> Iterator[pa.RecordBatch]:
            look()
            n = len(ids)
            numbers = [x[0] if x else np.zeros(0, np.int64) for x in read]
            every, doc = np.concatenate(numbers), np.repeat(np.arange(n), [len(x) for x in numbers])
            size_a, size_b, ends = (np.array(x, np.int64) for x in (pieces.size_a, pieces.size_b, pieces.ends))
            counts = np.diff(ends)
            totals = []
            for each in (size_a, size_b, counts):
                totals.append(np.zeros(n, np.int64))
                np.add.at(totals[-1], doc, each[every])
            yield full("doc", chunk, n, {"slot": pa.array(np.arange(n), pa.int32()), "doc_id": pa.array(ids, id_type), "n_a": pa.array(totals[0]), "n_b": pa.array(totals[1]), "n_groups": pa.array(totals[2]), "groups_sha256": pa.array([x[1] if x else "" for x in read])})
            if len(every):
                links = np.array(pieces.links, np.int64)[_expand(ends[every], counts[every])]
                rows = postings_of(np.repeat(doc, counts[every]), links, n, chunk)
                for i in range(0, rows.num_rows, 20_000):
                    part = rows.slice(i, 20_000)
                    yield full("pair", chunk, part.num_rows, {k: part.column(k) for k, _ in posting})
            ids.clear()
            read.clear()
            if len(pieces.of) > REMEMBERED:
                pieces.forget()

        unread = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                size = len(text or "")
                if ids and (seen + size > CHUNK_BYTES or len(ids) >= CHUNK_DOCS or len(pieces.of) > 2 * REMEMBERED):
                    yield from done()
                    chunk, seen, unread = chunk + 1, 0, 0
                elif unread + size > STRETCH:
                    look()
                    unread = 0
                ids.append(i)
                texts.append(text)
                seen, unread = seen + size, unread + size
        if ids:
            yield from done()

    return run


def index(docs: DataFrame, json_file: str, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(summary, postings)`` of a corpus, both kept in the shared folder: a row a document, and rows of POSTINGS.

    The files of both tokenizers are read by the driver and sent to the executors.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    files = docs.sparkSession.sparkContext.broadcast((Path(json_file).read_bytes(), Path(model_file).read_bytes()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    both = docs.mapInArrow(_index(files, kind), f"kind string, chunk long, {SUMMARY.format(id=id_type).split(', ', 1)[1]}, {POSTINGS.split(', ', 1)[1]}")
    both = materialize(both, "pair-index")
    return both.where("kind = 'doc'").select("chunk", "slot", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"), both.where("kind = 'pair'").select("chunk", "pair", "plane", "packed", "bits", "docs", "members")


def pair_counts(postings: DataFrame) -> DataFrame:
    """``(pair, links, docs, best)``: links and documents of each id pair, and whether no pair of its B id has more links.

    Chunks hold different documents, so the populations of their planes add up; a plane counts as its power of two.
    """
    counts = postings.groupBy("pair").agg(F.sum(F.expr("shiftleft(bits, plane)")).alias("links"), F.sum("docs").alias("docs"))
    counts = materialize(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))), "pair-counts")
    top = counts.groupBy("b").agg(F.max("links").alias("top"))
    # One row a token of B at most: its vocabulary bounds what is sent.
    return counts.join(F.broadcast(top), "b").select("pair", "links", "docs", (F.col("links") == F.col("top")).alias("best"))


def _return_scores(key: tuple, docs: pa.Table, postings: pa.Table) -> pa.Table:
    """Scores of the links of one chunk's documents, by its planes."""
    n = docs.num_rows
    slot = docs.column("slot").to_numpy()
    place = np.zeros(CHUNK_DOCS, np.int64)
    place[slot] = np.arange(n)
    at, counts = members(postings.column("packed").to_pylist(), postings.column("members").to_pylist())
    at, weight = place[at], np.left_shift(1, postings.column("plane").to_numpy().astype(np.int64))
    sums = []
    for each in (postings.column("best").to_numpy().astype(np.int64), postings.column("links").to_numpy(), postings.column("docs").to_numpy()):
        total = np.zeros(n, np.int64)
        np.add.at(total, at, np.repeat(each * weight, counts))
        sums.append(pa.array(total))
    groups = docs.column("n_groups")
    return pa.table([docs.column("doc_id"), docs.column("n_a"), docs.column("n_b"), groups, groups, *sums, docs.column("groups_sha256")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "doc_count_sum", "groups_sha256"])


def align(docs: DataFrame, json_file: str, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How two tokenizers' tokens of each document end together, and how usual its id pairs are in the whole corpus.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, doc_count_sum, groups_sha256)``. ``json_file`` is a byte-level
    tokenizer (A), ``model_file`` a piece model with byte fallback (B). Byte offsets where tokens of both end cut a text into
    groups, and each such offset links the two tokens that end there. Links of a chunk of documents become, for each id
    pair, bitmaps of documents, one for each binary digit of the number of links; their populations add up to the pair's
    links and documents over all chunks, and the bitmaps carry these counts back to documents: ``count_sum`` over links,
    ``doc_count_sum`` the same with numbers of documents, ``n_best`` the links whose pair is the most linked of its B id.

    Texts are read whole. Cuts before spaces, across which no token of either vocabulary lies, part them into pieces that are
    aligned once for each task. Null and empty texts, and those whose bytes don't come back (a piece model may map
    characters), have no tokens: zeros and ''. Every row gives one row, repeated ids and rows too; null ids stay null. An
    empty table gives an empty result. Other columns are ignored.
    """
    summary, postings = index(docs, json_file, model_file, id_col, text_col)
    scored = postings.drop("docs", "bits").join(pair_counts(postings), "pair").drop("pair").withColumnRenamed("chunk", "of_chunk")
    id_type = summary.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, doc_count_sum long, groups_sha256 string"
    return summary.groupBy("chunk").cogroup(scored.groupBy("of_chunk")).applyInArrow(_return_scores, out)
