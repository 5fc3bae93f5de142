"""Alignment of the tokens of two tokenizers over the same text.

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, which reads a space and the text; B is a sentencepiece
model, which puts that space there itself. Each token covers a range of the bytes of space+text. Where tokens of both
end at one byte, the text is cut into groups; an A and a B token are linked where their ranges overlap.

Ranges come from the spans that the libraries report: character offsets of A, begin and end of the pieces in B's proto.
They are coarse: tokens that share a character have the same offsets, and of the byte tokens of one character only the
last has a span. A token that ends where no character is shared takes the reported end; between two such ends the
lengths of the decoded bytes place the others. The decoded bytes of all tokens must give back space+text.

Neither tokenizer joins what stands before a space to what stands after it, when a visible character comes before the
space: A's pattern lets a space only begin a token, and no piece of B holds a word boundary after a character (checked
when the model is loaded; a pair that does not promise this reads texts whole). So texts are cut there, and in each
block of about ``BLOCK_BYTES`` every distinct stretch is encoded once. Blocks are a table; the counts of id pairs over
the corpus are an aggregate of the blocks' distinct pairs, and come back to the blocks by a join.

Null and empty texts have no tokens, and a text that either tokenizer does not give back byte for byte (one with
U+2581, which B reads as a space) has none either: all numbers 0, an empty digest. Strings of special tokens are
ordinary text. Very long texts are a block of their own. Repeated rows count each time. Ties for the highest count of
a B id are all best. An empty table gives empty results. Other columns of the documents are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexprep.llm import arrow as A
from lexprep.llm.blocks import block_id, dictionary
from lexprep.llm.tables import quoted, written

BLOCK_BYTES = 8 << 20
#: Bytes of distinct stretches that are put together into one text for the tokenizers.
ENCODE_BYTES = 16 << 10
#: Bytes of such texts that are encoded at once, and after how many times freed memory goes back to the system.
WAVE_BYTES, TRIM = 40 << 10, 32
#: A row of the blocks' table is a block of some 12 MB. A row group is one of them: without this a writer holds 100 rows
#: before it looks at their size, and a reader all rows of a group.
ROW_GROUPS = {"parquet.block.row.count.limit": "1", "parquet.page.size.row.check.min": "1"}
SPACE_MARK = "▁"
MARK_BYTES = SPACE_MARK.encode()
#: What follows a token id: another of its side, the other side, or the next group.
MARKS = ",|;"


@dataclass(frozen=True)
class Files:
    """The two vocabulary files. The driver reads them; tasks get their bytes."""

    a: str = "/opt/tokenizers/byte_bpe_50k.json"
    b: str = "/opt/tokenizers/piece_bpe_32k.model"

    def read(self) -> tuple[bytes, bytes]:
        return Path(self.a).read_bytes(), Path(self.b).read_bytes()


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: visible Latin-1 ones for themselves, the others
    as the characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Both tokenizers in a worker, and the bytes of each of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        told = json.loads(a)
        self.a = Tokenizer.from_str(a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in told["model"]["vocab"].items():
            self.a_bytes[i] = bytes(map(byte.__getitem__, token))
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        numbers = [str(i) for i in range(max(len(self.a_bytes), n))]
        self.marked = [x + m for x in numbers for m in MARKS]
        self.digits = np.array([len(x) for x in numbers], np.int32)
        split = told.get("pre_tokenizer") or {}
        self.cuts = (told.get("normalizer") is None and split.get("type") == "ByteLevel" and bool(split.get("use_regex"))
                     and not any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces))

    def tokens(self, texts: list[bytes]) -> list[tuple | None]:
        """(A ids, A ends, B ids, B ends) of each text, which begins with the space; None if bytes are not given back."""
        read = [t.decode() for t in texts]
        out: list[tuple | None] = []
        protos = self.b.encode([t[1:] for t in read], return_type="proto", num_threads=1)
        for text, enc, proto in zip(texts, self.a.encode_batch(read, add_special_tokens=False), protos):
            ia = np.array(enc.ids, np.int64)
            spans = np.array(enc.offsets, np.int64).reshape(-1, 2)
            data = np.frombuffer(text, np.uint8)
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # byte of each character
            clean = np.append(spans[1:, 0] >= spans[:-1, 1], True) if len(ia) else np.zeros(0, bool)
            ea = refined(at[spans[:, 1]], clean, self.a_len[ia])
            got = np.array([(p.id, p.begin, p.end) for p in proto.pieces], np.int64).reshape(-1, 3)
            eb = refined(got[:, 2] + 1, got[:, 2] > got[:, 1], self.b_len[got[:, 0]])
            same = (b"".join(map(self.a_bytes.__getitem__, ia.tolist())) == text
                    and b"".join(map(self.b_bytes.__getitem__, got[:, 0].tolist())) == text)
            out.append((ia, ea, got[:, 0], eb) if same else None)
        return out


def refined(ends: np.ndarray, clean: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends: the reported one where it is clean, else the last clean one and the decoded bytes since."""
    total = np.cumsum(lengths)
    last = np.maximum.accumulate(np.where(clean, np.arange(len(ends)), -1)) if len(ends) else np.zeros(0, np.int64)
    known = last >= 0
    return np.where(known, ends[last] + total - total[last], total) if len(ends) else total


@lru_cache(maxsize=2)
def _pair(a: bytes, b: bytes) -> Pair:
    return Pair(a, b)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): stretches of the texts between the spaces that may be cut out; those of text i are
    bounds[i]..bounds[i+1]. Every stretch stands for a space and its bytes; an empty text has none.

    A space is cut out if another byte of its text follows, and before it comes a visible ASCII character or one of
    two bytes from U+00C0 on, none of which is white space."""
    n = len(data)
    space = data == 32
    ok = np.zeros(n, bool)
    if n > 1:
        before = data[:-1]
        good = (before >= 0x21) & (before <= 0x7E)
        good[1:] |= (before[1:] >= 0x80) & (before[1:] <= 0xBF) & (data[:-2] >= 0xC3) & (data[:-2] <= 0xDF)
        ok[1:] = space[1:] & good
    full = offsets[1:] > offsets[:-1]
    first = offsets[:-1][full]
    ok[first] = False
    ok[offsets[1:][full] - 1] = False
    second = first + 1  # a byte that continues another text's character is no text's second byte
    second = second[second < n]
    ok[second[data[second - 1] >= 0x80]] = False
    at = np.flatnonzero(ok)
    starts, ends = np.sort(np.concatenate([first, at + 1])), np.sort(np.concatenate([offsets[1:][full], at]))
    return starts, ends, np.searchsorted(starts, offsets)


def _distinct(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in rising order, and the place of each value among them."""
    coded = pa.array(links).dictionary_encode()
    values = np.asarray(coded.dictionary)
    order = np.argsort(values)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    return values[order], rank[np.asarray(coded.indices)]


def safe_end(text: bytes) -> bool:
    """Whether a space after these bytes could be cut out."""
    return 0x21 <= text[-1] <= 0x7E or len(text) > 1 and 0x80 <= text[-1] <= 0xBF and 0xC3 <= text[-2] <= 0xDF


@dataclass
class Stretches:
    """What the tokenizers make of some distinct stretches."""

    good: np.ndarray      # both give back the bytes
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray     # A id << 32 | B id, in order of place
    bounds: np.ndarray    # those of stretch i are bounds[i]..bounds[i+1]
    groups: list[str]     # `a1,a2|b1;a3|b2;`
    ends: np.ndarray      # byte ends of the groups within space+stretch
    end_bounds: np.ndarray


def aligned(pair: Pair, stretches: list[bytes]) -> Stretches:
    n = len(stretches)
    zero = lambda: np.zeros(n, np.int64)
    out = Stretches(np.zeros(n, bool), zero(), zero(), zero(), np.zeros(0, np.int64), np.zeros(n + 1, np.int64),
                    [""] * n, np.zeros(0, np.int64), np.zeros(n + 1, np.int64))
    found: list[list] = []
    todo, batch, size = [], [], 0
    for k, s in enumerate(stretches):
        if MARK_BYTES in s:
            continue  # B reads the mark as a space and cannot give it back
        if not safe_end(s):
            todo.append([k])
            continue
        batch.append(k)
        size += len(s) + 1
        if size >= ENCODE_BYTES:
            todo.append(batch)
            batch, size = [], 0
    if batch:
        todo.append(batch)
    while todo:
        wave, todo = todo, []
        for turn, part in enumerate(_waves(wave, stretches), 1):
            if turn % TRIM == 0:
                A.release()
            texts = [b"".join(b" " + stretches[k] for k in ks) for ks in part]
            for ks, text, tokens in zip(part, texts, pair.tokens(texts)):
                stops = np.cumsum([len(stretches[k]) + 1 for k in ks])
                if tokens is not None and np.isin(stops, tokens[1]).all() and np.isin(stops, tokens[3]).all():
                    found.append(_place(pair, out, np.array(ks), stops, *tokens))
                elif len(ks) > 1:  # one of them is not given back
                    todo.extend([k] for k in ks)
    out.links, out.bounds = _by_stretch(found, 0, n, np.int64)
    out.ends, out.end_bounds = _by_stretch(found, 2, n, np.int32)
    return out


def _waves(todo: list[list[int]], stretches: list[bytes]) -> Iterator[list[list[int]]]:
    """Texts of at most ``WAVE_BYTES`` together, or one text."""
    part, size = [], 0
    for ks in todo:
        n = sum(len(stretches[k]) + 1 for k in ks)
        if part and size + n > WAVE_BYTES:
            yield part
            part, size = [], 0
        part.append(ks)
        size += n
    if part:
        yield part


def _by_stretch(found: list[list], k: int, n: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Values and the stretch of each, as values in the order of stretches and the bounds of each stretch. They are
    taken out of ``found``."""
    values, of = (np.concatenate([np.zeros(0, t), *(x[i] for x in found)]) for i, t in ((k, kind), (k + 1, np.int32)))
    for x in found:
        x[k] = x[k + 1] = None
    if (of[1:] < of[:-1]).any():  # some stretches were encoded again
        values = values[np.argsort(of, kind="stable")]
    return values, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))])


def _place(pair: Pair, out: Stretches, ks: np.ndarray, stops: np.ndarray, ia, ea, ib, eb) -> list[np.ndarray]:
    """Fill in the stretches that make up one text; (links, the stretch of each, ends of groups, the stretch of each)."""
    m = len(ks)
    common = np.intersect1d(ea, eb, assume_unique=True)
    every = np.union1d(ea, eb)  # between two neighbours lies the overlap of one A and one B token
    at = np.searchsorted(stops, common)
    out.good[ks] = True
    out.n_a[ks] = np.bincount(np.searchsorted(stops, ea), minlength=m)
    out.n_b[ks] = np.bincount(np.searchsorted(stops, eb), minlength=m)
    out.n_groups[ks] = per = np.bincount(at, minlength=m)
    ids = np.concatenate([ia, ib])
    place = np.concatenate([np.searchsorted(common, ea) * 2, np.searchsorted(common, eb) * 2 + 1])
    order = np.argsort(place, kind="stable")
    ids, place = ids[order], place[order]
    after = np.append(place[1:], -1)
    mark = np.where(after == place, 0, np.where(place & 1, 2, 1))
    line = "".join(map(pair.marked.__getitem__, (ids * len(MARKS) + mark).tolist()))
    chars = np.cumsum(pair.digits[ids] + 1)
    last = np.searchsorted(place, 2 * np.cumsum(per) - 1, "right") - 1  # last token of each stretch
    a = 0
    for k, b in zip(ks.tolist(), chars[last].tolist()):
        out.groups[k] = line[a:b]
        a = b
    links = ia[np.searchsorted(ea, every)] << 32 | ib[np.searchsorted(eb, every)]
    begins = np.concatenate([[0], stops[:-1]])
    of = ks.astype(np.int32)
    return [links, of[np.searchsorted(stops, every)], (common - begins[at]).astype(np.int32), of[at]]


class Block:
    """The texts of one block, cut, encoded and aligned."""

    def __init__(self, pair: Pair, data: np.ndarray, offsets: np.ndarray):
        if pair.cuts:
            starts, ends, self.bounds = cut(data, offsets)
        else:
            full = offsets[1:] > offsets[:-1]
            starts, ends = offsets[:-1][full], offsets[1:][full]
            self.bounds = np.concatenate([[0], np.cumsum(full)])
        self.codes, distinct = dictionary(data, starts, ends)
        self.lengths = (ends - starts + 1).astype(np.int32)
        del starts, ends  # not held while the stretches are encoded
        stretches = distinct.to_pylist()
        del distinct
        self.got = aligned(pair, stretches)
        bad = A.sums((~self.got.good)[self.codes], self.bounds) > 0
        if bad.any():
            keep = np.repeat(~bad, np.diff(self.bounds))
            self.codes, self.lengths = self.codes[keep], self.lengths[keep]
            self.bounds = np.concatenate([[0], np.cumsum(np.where(bad, 0, np.diff(self.bounds)))])

    def total(self, per_stretch: np.ndarray) -> np.ndarray:
        """Sum over the stretches of each text."""
        return A.sums(per_stretch[self.codes], self.bounds)

    def groups(self) -> list[str]:
        return list(self.each_groups())

    def each_groups(self) -> Iterator[str]:
        """The groups of a text at a time."""
        s = self.got.groups
        for i, j in zip(self.bounds[:-1], self.bounds[1:]):
            yield "".join(map(s.__getitem__, self.codes[i:j].tolist()))[:-1]


def _blocks(batch: pa.RecordBatch, column: int):
    """(first row, end row, data, offsets) of the blocks of an Arrow batch."""
    data, offsets = A.text_buffer(batch.column(column))
    for i, j in A.chunks(offsets, BLOCK_BYTES):
        yield i, j, data[int(offsets[i]):int(offsets[j])], offsets[i:j + 1] - offsets[i]


GROUPS = T.StructType([T.StructField("groups", T.StringType()), T.StructField("ends", T.ArrayType(T.LongType()))])


def with_groups(docs: DataFrame, name: str, text_col: str = "text", files: Files = Files()) -> DataFrame:
    """``docs`` and a struct ``name``: ``groups``, the token ids of each group (`a1,a2|b1;a3|b2`), and ``ends``, the
    byte of space+text at which each group ends."""
    held = docs.sparkSession.sparkContext.broadcast(files.read())  # two vocabulary files
    column, out = docs.columns.index(text_col), T.StructType(docs.schema.fields + [T.StructField(name, GROUPS, False)])

    def run(batches):
        pair = _pair(*held.value)
        for batch in batches:
            groups, ends = [], []
            for i, j, data, offsets in _blocks(batch, column):
                block = Block(pair, data, offsets)
                groups += block.groups()
                e, b = block.got.ends, block.got.end_bounds
                for lo, hi in zip(block.bounds[:-1], block.bounds[1:]):
                    at = np.cumsum(np.append(0, block.lengths[lo:hi]))
                    ends.append(np.concatenate([np.zeros(0, np.int64), *(e[b[c]:b[c + 1]] + s for c, s in zip(block.codes[lo:hi], at))]))
            cell = pa.StructArray.from_arrays([pa.array(groups, pa.string()), pa.array(ends, pa.list_(pa.int64()))],
                                              ["groups", "ends"])
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=[f.name for f in out.fields])

    return A.map_arrow(docs, run, out)


def _of(kind):
    return T.ArrayType(kind)


PER_DOC = ("n_a", "n_b", "n_groups", "n_links")


@dataclass(frozen=True)
class Alignment:
    """Blocks of aligned documents, and the id pairs of the corpus."""

    blocks: DataFrame  # a row for each block
    pairs: DataFrame   # (a, b, n, best): id pair, its links in the corpus, whether no pair of that B id has more


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: Files = Files()) -> Alignment:
    """Encode every document once and count the links of each id pair over the corpus."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(files.read())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", _of(kind)),
                           *[T.StructField(x, _of(T.LongType())) for x in PER_DOC], T.StructField("digest", _of(T.StringType())),
                           T.StructField("bounds", T.BinaryType()), T.StructField("codes", T.BinaryType()),
                           T.StructField("link_bounds", T.BinaryType()), T.StructField("link_pair", T.BinaryType()),
                           T.StructField("pairs", _of(T.LongType())), T.StructField("pair_n", _of(T.LongType()))])
    names = [f.name for f in schema.fields]

    def run(batches):
        pair, k = _pair(*held.value), 0
        for batch in batches:
            for i, j, data, offsets in _blocks(batch, 1):
                x = Block(pair, data, offsets)
                got = x.got
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in x.each_groups()]
                got.groups = []
                times = np.bincount(x.codes, minlength=len(got.good))
                per = np.diff(got.bounds)
                distinct, link_pair = _distinct(got.links)
                n = np.bincount(link_pair, np.repeat(times, per).astype(np.float64), len(distinct)).astype(np.int64)
                numbers = [x.total(v) for v in (got.n_a, got.n_b, got.n_groups, per)]
                one = lambda v, t=None: pa.array([v], t)
                raw = lambda v, t: one(v.astype(t).tobytes(), pa.binary())
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), batch.column(0).slice(i, j - i))
                yield pa.RecordBatch.from_arrays(
                    [one(block_id(k), pa.int64()), ids, *[one(v, pa.list_(pa.int64())) for v in numbers],
                     one(digest, pa.list_(pa.string())), raw(x.bounds, np.int64), raw(x.codes, np.int32),
                     raw(got.bounds, np.int64), raw(link_pair, np.int32), one(distinct, pa.list_(pa.int64())),
                     one(n, pa.list_(pa.int64()))], names=names)
                k += 1
                del x, got, times, per, distinct, link_pair, n, digest, numbers
            A.release()

    texts = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    blocks = written(A.map_arrow(texts, run, schema), "blocks", ROW_GROUPS)
    counts = (blocks.select(F.explode(F.arrays_zip("pairs", "pair_n")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
              .agg(F.sum("x.pair_n").alias("n")).where("n > 0"))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    most = Window.partitionBy("b")  # no more rows than A has ids
    pairs = (counts.select("pair", F.shiftright("pair", 32).alias("a"), b.alias("b"), "n")
             .withColumn("best", F.col("n") == F.max("n").over(most)))
    return Alignment(blocks, written(pairs, "pairs"))


SCORED = ("n_best", "count_sum")


def document_counts(found: Alignment) -> DataFrame:
    """Per document: id, tokens of A and B, groups, links, links that are best for their B id, the sum over links of
    their pair's count in the corpus, and the SHA-256 of the groups ('' without tokens)."""
    # a row holds a whole block: as many tasks as blocks, so that a task and an Arrow batch have few of them
    n_blocks = max(1, found.blocks.count())
    at = found.blocks.select("block", F.posexplode("pairs").alias("at", "pair"))
    back = (at.join(found.pairs.select("pair", "n", "best"), "pair").repartition(n_blocks, "block")
            .groupBy("block").agg(F.collect_list(F.struct("at", "n", "best")).alias("known")))
    kind = found.blocks.schema["ids"].dataType.elementType
    out = T.StructType([T.StructField("id", kind), *[T.StructField(x, T.LongType()) for x in PER_DOC + SCORED],
                        T.StructField("digest", T.StringType())])
    rows = found.blocks.drop("pairs", "pair_n").repartition(n_blocks, "block").join(back, "block", "left")
    names = rows.columns

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                cell = {c: batch.column(k)[r] for k, c in enumerate(names)}
                read = lambda c, t: np.frombuffer(cell[c].as_buffer(), t)
                bounds, codes, per = read("bounds", np.int64), read("codes", np.int32), read("link_bounds", np.int64)
                link = read("link_pair", np.int32)
                n, best = np.zeros((2, int(link.max()) + 1 if len(link) else 0), np.int64)
                if cell["known"].is_valid:
                    known = cell["known"].values
                    where = np.asarray(known.field("at"))
                    n[where] = np.asarray(known.field("n"))
                    best[where] = np.asarray(known.field("best").cast(pa.int8()))
                scored = [A.sums(A.sums(v[link], per)[codes], bounds) for v in (best, n)]
                yield pa.RecordBatch.from_arrays(
                    [cell["ids"].values, *[cell[c].values for c in PER_DOC], *map(pa.array, scored), cell["digest"].values],
                    names=[f.name for f in out.fields])

    return A.map_arrow(rows, run, out)
