"""Best-fit packing into sequences, certified by dual-feasible-function lower bounds.

Documents become token ids and an end id; longer ones are cut into full pieces. Pieces are dealt to
partitions of bounded size and each partition runs best-fit decreasing. Dual feasible functions give
a lower bound on the number of sequences, of a partition and of all pieces. While all counts
together are above the bound of all pieces, each partition whose count exceeds its own bound or
whose bound was rounded up gives the pieces of its unfilled sequences to a pool, and the pooled
pieces, dealt anew, are packed again.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import kept, mapped, stored, table

LENGTH, END = 4096, 1
#: Tokens that one partition packs, about; it holds at least so many lengths in memory at a time.
PARTITION_TOKENS = 8_000_000

#: Bytes of words and their ids that a worker keeps, about, with what the tables themselves take for each; texts (or bytes of them; one longer text is a block of its own) and new words that are tokenized in one go.
#: A block takes some twenty times its bytes on its way, and two workers share an executor with a heap that earlier stages have filled.
KNOWN_BYTES, ENTRY_BYTES, BLOCK_TEXTS, BLOCK_BYTES, BLOCK_WORDS = 40_000_000, 180, 4_000, 2_000_000, 200
#: Lower-case letters up to U+00FF, and ASCII marks other than the apostrophe: the splitting rule takes a run of either as one piece, and neither changes when it is normalized.
_LETTERS, _MARKS = "a-zß-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 signs for themselves, the others for the next ones from U+0100 on."""
    out, spare = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


_BYTES = _byte_letters()


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Ids:
    """Token ids of whole texts as little-endian unsigned 32-bit values.

    Words between ASCII white space, in ASCII lower case, are tokenized on their own and kept: the vocabulary ignores case and its splitting rule cuts
    there. Words of plain letters, and marks after them, go straight to the vocabulary's merges; all others through the whole tokenizer.
    Once the table of known words has half of KNOWN_BYTES, it becomes the older one and a new one begins: words still in use move over, the others go in turn.
    """

    def __init__(self, path: str):
        self.tokenizer, self.known, self.older, self.held = _tokenizer(path), {}, {}, 0
        self.merges = self.tokenizer.model.tokenize

    def _encoded(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), BLOCK_WORDS):
            part = words[at : at + BLOCK_WORDS]
            got = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            raw, ends = np.array(got.ids, "<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
            out += map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
        return out

    def _letters(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(_BYTES.__getitem__, word.encode()))
        ids = [t.id for t in self.merges(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: list[str]) -> None:
        """Puts the ids of new words into the table."""
        known, others, marks, cut = self.known, [], set(), []
        for w in words:
            m = _PLAIN.fullmatch(w)
            if m is None:
                others.append(w)
            elif not m[2]:
                known[w] = self._letters(w)
            else:
                cut.append((w, m[1], m[2]))
                if m[2] not in known:
                    marks.add(m[2])
        others += marks.difference(others)
        known.update(zip(others, self._encoded(others), strict=True))
        for w, letters, mark in cut:
            known[w] = (known.get(letters) or self._letters(letters)) + known[mark]
        self.held += sum(map(len, words)) + ENTRY_BYTES * len(words)

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """One value a text; null is empty. The vocabulary's special tokens are found in the text as it stands: such texts are tokenized as they are."""
        special = pc.fill_null(pc.match_substring(texts, "<|"), False)
        words = pc.ascii_split_whitespace(pc.if_else(special, "", pc.ascii_lower(pc.fill_null(texts, ""))))
        coded = words.flatten().dictionary_encode()
        if self.held > KNOWN_BYTES // 2:
            self.older, self.known, self.held = self.known, {}, 0
        distinct, known = coded.dictionary.to_pylist(), self.known
        found = list(map(known.get, distinct))
        holes = [i for i, x in enumerate(found) if x is None]
        new = []
        for w in (distinct[i] for i in holes):
            if (x := self.older.pop(w, None)) is None:
                new.append(w)
            else:
                known[w] = x
                self.held += len(w) + ENTRY_BYTES
        self._learn(new)
        for i in holes:
            found[i] = known[distinct[i]]
        pool = np.frombuffer(b"".join(found), "<u4")
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = coded.indices.to_numpy(zero_copy_only=False)
        each, starts = lengths[at], (np.cumsum(lengths) - lengths)[at]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(starts - (ends - each), each)
        place += np.arange(total)
        ids = pool[place]
        del place, at, each, starts
        bounds = np.concatenate([[0], ends])[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
        out = [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
        for i in np.flatnonzero(special.to_numpy(zero_copy_only=False)).tolist():
            out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return out


def blocks(batches):
    """Batches (of ids and texts) in parts of at most BLOCK_BYTES of text, or of one text."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def pieces(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's pieces; null text is empty and has the end id alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    last = np.array([end], "<u4").tobytes()

    def cut(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        rows: tuple[list, ...] = ([], [], [], [], [])
        for i, raw in enumerate(kept(("ids", tokenizer_path), lambda: Ids(tokenizer_path))(t.column(1).chunk(0) if t.num_rows else pa.array([], pa.string()))):
            raw += last
            for p, start in enumerate(range(0, len(raw), 4 * length)):
                part = raw[start : start + 4 * length]
                for row, v in zip(rows, (i, p, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    row.append(v)
        keys = t.column(0).take(pa.array(rows[0], pa.int64())).combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) and keys.num_chunks else keys if isinstance(keys, pa.Array) else pa.array([], t.schema.field(0).type)
        return pa.RecordBatch.from_arrays([keys, pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in blocks(batches):
            if held and (sum(x.num_rows for x in held) + b.num_rows > BLOCK_TEXTS or sum(x.nbytes for x in held) + b.nbytes > BLOCK_BYTES):
                yield cut(held)
                held = []
            held.append(b)
        if held:
            yield cut(held)

    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long", keeps=True)


def lower_bound(counts: np.ndarray, length: int = LENGTH) -> int:
    """Sequences that any packing of counts[n] pieces of n tokens needs: the best of the total size and of two families of dual feasible functions."""
    sizes = np.arange(len(counts))
    best = -(-int((counts * sizes).sum()) // length)
    above = np.cumsum(counts[::-1])[::-1]  # pieces of at least n tokens
    weight = np.cumsum(counts * sizes)
    for low in range(1, length // 2 + 1):
        # pieces over length - low count as whole, those below low as nothing
        big = int(above[length - low + 1]) if length - low + 1 < len(counts) else 0
        middle = int(weight[length - low] - weight[low - 1])
        best = max(best, big + -(-middle // length))
    for k in range(1, 101):
        # u_k: x -> x if (k + 1) x is whole, else floor((k + 1) x) / k
        x = (k + 1) * sizes
        value = np.where(x % length == 0, sizes * k, (x // length) * length)
        best = max(best, -(-int((counts * value).sum()) // (k * length)))
    return best


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of each piece, and the number of bins. Rooms of open bins are kept in stacks by room."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    stacks: dict[int, list[int]] = {}
    rooms: list[int] = []
    n = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            room, chosen = length, n
            n += 1
        else:
            room = rooms[at]
            chosen = stacks[room].pop()
            if not stacks[room]:
                del stacks[room], rooms[at]
        bins[i], offsets[i] = chosen, length - room
        if left := room - size:
            if left not in stacks:
                stacks[left] = []
                insort(rooms, left)
            stacks[left].append(chosen)
    return bins, offsets, n


def _pack(rows: DataFrame, parts: int, turn: int, length: int) -> DataFrame:
    """Deals rows to parts, packs each. tight: the partition's count is its bound; open_: the sequence is unfilled, and its partition is not tight or its share of tokens was rounded up."""
    key = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = t["length"].to_numpy()
        bins, offsets, n = best_fit(sizes, length)
        tight = n == lower_bound(np.bincount(sizes, minlength=length + 1), length)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        part = int(t["part"][0].as_py())
        t = t.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, v in (("sequence_id", ((turn << 54) | (part << 26)) + bins), ("offset", offsets), ("tight", np.full(len(sizes), tight)), ("open_", (fill[bins] < length) & (not tight or n * length > sizes.sum()))):
            t = t.append_column(name, pa.array(v))
        return t

    kind = rows.schema["doc_id"].dataType.simpleString()
    return key.groupBy("part").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, tight boolean, open_ boolean")


def pack(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Packs pieces (see pieces()); adds sequence_id, offset and certified.

    Rounds go on while all sequences together are more than the bound of all pieces, until the pool of unfilled sequences fits into
    one partition (which is then packed as one) or no longer shrinks. certified: the count of all sequences equals the bound of
    all pieces, or the partition that packed the piece meets its own bound. An empty table gives an empty result; rows that repeat are packed each,
    null ids like others.
    """
    rows = stored(rows, "pieces")
    counts = np.zeros(length + 1, np.int64)
    for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most as many rows as a sequence has tokens
        counts[r.length] = r.n
    bound, tokens = lower_bound(counts, length), int((counts * np.arange(length + 1)).sum())
    done, filled, turn = None, 0, 0
    while True:
        parts = max(1, -(-tokens // PARTITION_TOKENS))
        packed = stored(_pack(rows, parts, turn, length), f"packed{turn}")
        starts = F.col("offset") == 0  # one a sequence
        n_closed, n_open, pool = packed.agg(F.count_if(starts & ~F.col("open_")), F.count_if(starts & F.col("open_")), F.sum(F.when(F.col("open_"), F.col("length")))).first()
        exact = filled + n_closed + n_open <= bound
        final = exact or parts == 1 or not pool or pool >= tokens or turn == 255
        taken = packed if final else packed.where("not open_")
        done = taken if done is None else done.unionByName(taken)
        if final:
            return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", (F.col("tight") | F.lit(exact)).alias("certified"))
        filled, tokens, turn = filled + n_closed, pool, turn + 1
        rows = packed.where("open_").drop("sequence_id", "offset", "tight", "open_")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, packed into sequences of at most LENGTH tokens."""
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary()))
