"""Best-fit packing of token pieces into sequences by exact-complement hashing.

Spark tokenises every text once, into pieces of at most `length` tokens, and counts pieces by length: `length` numbers, however
many pieces there are. The plan is made on those numbers. Lengths are taken from the longest down; the gap that one leaves is
looked up among the available single lengths, then pair sums, then triple sums, and combinations that fill it exactly are used
up as often as the counts allow. What fits nothing exactly goes, longest first, to the open sequence with the smallest gap that
holds it. The plan says, for each length, which ranks go to which sequences; each piece gets its rank and finds its place."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import arrays, common

LENGTH = 4096
END = 1
#: Bytes of the texts that are split at once (a longer text stands alone).
BLOCK = 1 << 23
#: Words that a worker remembers the ids of.
REMEMBERED = 2_000_000
#: What ids that end a word have at their end.
ENDING = "</w>"
COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")


#: Classes of the bytes of a text: white space, letters, digits and the like, anything else; and characters that go through the library.
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
#: What follows an apostrophe in tokens of their own, by the splitting rule of the vocabulary.
SHORT, LONG = b"stmd", (b"re", b"ve", b"ll")


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every character below U+0280, by the library's own tables of letters, numbers and white space."""
    import regex

    out = np.full(0x280, ODD, np.uint8)
    for k in [*range(0x09, 0x0E), *range(0x20, 0x7F), 0x85, *range(0xA0, 0x130), *range(0x131, 0x250)]:
        c = chr(k)
        out[k] = SPACE if regex.match(r"\s", c) else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
    return out


class WordTokenizer:
    """Ids of a tokenizer that lower-cases, drops white space and splits words before merging.

    Whole blocks are split at once, by the classes of their bytes; Arrow numbers the distinct words of a block, and only words not
    met before go through the library. A text goes through it as a whole if it has a character for which the library's and
    Python's case, white space and letter tables may differ, or if it may hold a special token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[k for w, k in vocabulary.items() if w.endswith(ENDING)]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words. Names are sorted; a word is a slice of `flat`, number 0 (white space) an empty one."""
        self.names, self.number, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([""], pa.string())
        self.flat, self.start, self.size = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(little-endian unsigned 32-bit ids of all texts, index of each text's first id, and one more)."""
        low = [t.lower().encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in low], dtype=np.int64)])
        data = np.frombuffer(b"".join(low), np.uint8)
        kinds = self._kinds(data)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(offsets, np.flatnonzero(kinds == ODD), side="right") - 1] = True
        odd |= np.array(["<|" in t for t in texts], bool)
        words, first = self._split(data, offsets, kinds)
        which = self._numbers(words, odd, first)
        counts = self.size[which]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ids = self.flat[np.repeat(self.start[which] - upto[:-1], counts) + np.arange(upto[-1])]
        bounds = upto[first]
        if odd.any():
            whole = iter(self._whole([t for t, o in zip(texts, odd, strict=True) if o]))
            parts = [next(whole) if o else ids[bounds[k] : bounds[k + 1]] for k, o in enumerate(odd)]
            ids, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds

    @staticmethod
    def _kinds(data: np.ndarray) -> np.ndarray:
        """The class of each byte; both bytes of a longer character have that of the character."""
        table = np.full(256, ODD, np.uint8)
        table[:128] = _classes()[:128]
        kinds = table[data]
        lead = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))
        if len(lead):
            of = _classes()[((data[lead].astype(np.int64) & 0x1F) << 6) | (data[lead + 1] & 0x3F)]
            kinds[lead] = kinds[lead + 1] = of
        return kinds

    @staticmethod
    def _split(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(words and runs of white space in order, index of each text's first one, and one more)."""
        n = len(data)
        edge = np.ones(n + 1, bool)
        edge[1:n] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
        edge[1:n] &= (data[1:] & 0xC0) != 0x80
        edge[offsets] = True
        mark = np.flatnonzero(data == 0x27)
        mark = mark[mark + 1 < n]
        mark = mark[edge[mark] & edge[mark + 1] & (kinds[mark + 1] == LETTER) & ~np.isin(mark + 1, offsets)]
        if len(mark):
            after = data[mark + 1]
            short = np.isin(after, np.frombuffer(SHORT, np.uint8))
            next_ = np.where(mark + 2 < n, data[np.minimum(mark + 2, n - 1)], 0)
            long_ = (mark + 2 < n) & ~edge[np.minimum(mark + 2, n)] & np.any([(after == x[0]) & (next_ == x[1]) for x in LONG], axis=0)
            edge[mark[short | long_] + 1] = False
            edge[mark[short] + 2] = True
            edge[mark[long_] + 3] = True
        at = np.flatnonzero(edge)
        if not n:
            return pa.array([], pa.string()), np.zeros(len(offsets), np.int64)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
        return words, np.searchsorted(at, offsets)

    def _numbers(self, words: pa.Array, odd: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The number under which each word is remembered; words of texts that go through the library count as white space."""
        if not len(words):
            return np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        each, at = coded.dictionary, coded.indices.to_numpy()
        used = np.ones(len(each), bool)
        if odd.any():
            skip = np.repeat(odd, np.diff(first))
            used[:] = False
            used[at[~skip]] = True
        data, offsets = common.raw_bytes(each)
        blank = np.isin(data[offsets[:-1]], np.array([*range(0x09, 0x0E), 0x20], np.uint8))
        for k in np.flatnonzero(data[offsets[:-1]] == 0xC2):
            blank[k] = each[int(k)].as_py().isspace()
        wanted = np.flatnonzero(used & ~blank)
        numbers = np.zeros(len(each), np.int64)
        numbers[wanted] = self._remembered(each.take(pa.array(wanted)), common.Fingerprints(data).of(offsets[wanted], offsets[wanted + 1]))
        return np.where(skip, 0, numbers[at]) if odd.any() else numbers[at]

    def _remembered(self, words: pa.Array, names: np.ndarray) -> np.ndarray:
        """The numbers of distinct words, those of new ones included. A word is known by its name, and then by its letters."""
        if len(self.names) + len(names) > REMEMBERED and len(self.names) > REMEMBERED // 2:
            self.clear()
        at = np.minimum(np.searchsorted(self.names, names), max(len(self.names) - 1, 0))
        held = self.names[at] == names if len(self.names) else np.zeros(len(names), bool)
        out = np.zeros(len(names), np.int64)
        out[held] = self.number[at[held]]
        held[held] = pc.equal(self.words.take(pa.array(out[held])), words.filter(pa.array(held))).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(~held)
        if len(new):
            fresh = words.take(pa.array(new))
            ids, size = self._words(fresh.to_pylist())
            out[new] = len(self.size) + np.arange(len(new))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, ids])
            self.words = pa.concat_arrays([self.words, fresh])
            order = np.argsort(names[new])
            where = np.searchsorted(self.names, names[new][order])
            self.names, self.number = np.insert(self.names, where, names[new][order]), np.insert(self.number, where, out[new][order])
        return out

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). Words go through the library many at a time; a word's last id is one that ends words."""
        joined = self._whole([" ".join(words[k : k + 512]) for k in range(0, len(words), 512)])
        ids = np.concatenate(joined)
        ends = np.flatnonzero(self.last[ids])
        if len(ends) == len(words) and ends[-1] == len(ids) - 1:
            return ids, np.diff(ends, prepend=-1)
        each = self._whole(words)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


@lru_cache(1)
def _tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path)


def _pieces(path: str, length: int, end: int):
    def cut(batches):
        arrays.release()
        t = _tokenizer(path)
        for batch in batches:
            docs, texts = batch.column("doc_id"), common.text_column(batch)
            for lo, hi, _, _ in common.byte_blocks(texts, BLOCK):
                block = texts.slice(lo, hi - lo).to_pylist()
                each = {x: k for k, x in enumerate(dict.fromkeys(block))}  # copies that lie together, as a mix leaves them, are tokenised once
                ids, at = t.encode(list(each))
                ids, at = np.insert(ids, at[1:], end), at + np.arange(len(at))
                which = np.array([each[x] for x in block])
                pieces_ = -(-(at[1:] - at[:-1]) // length)  # of each distinct text
                before = np.cumsum(pieces_) - pieces_
                piece = np.arange(pieces_.sum()) - np.repeat(before, pieces_)
                lows = np.repeat(at[:-1], pieces_) + piece * length
                highs = np.minimum(lows + length, np.repeat(at[1:], pieces_))
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = np.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(lows.tolist(), highs.tolist(), strict=True)], np.int64)
                row = np.repeat(np.arange(hi - lo), pieces_[which])
                of = np.repeat(before[which] - np.cumsum(pieces_[which]) + pieces_[which], pieces_[which]) + np.arange(len(row))
                cols = [docs.take(pa.array(row + lo)), pa.array(piece[of], pa.int32()), pa.array(piece[of] * length, pa.int64()), pa.array((highs - lows)[of], pa.int64()), pa.array(crc[of], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, list(COLUMNS))

    return cut


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of docs(doc_id, text); a null or empty text is one piece, the end token alone."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path, length, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) from counts[l], the number of pieces of each length l < len(counts).

    All steps move whole counts, so the work depends on the number of lengths and not on that of pieces."""
    c, size = counts.astype(np.int64).copy(), len(counts) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [lengths, count]

    def use(parts: tuple[int, ...]) -> bool:
        need = np.bincount(parts, minlength=size + 1)
        times = int((c[parts,] // need[parts,]).min())
        if times:
            np.subtract(c, need * times, out=c)
            out.append((parts, times))
        return times > 0

    def pairs(total: int, a: int, b: int = 0) -> tuple[int, int] | None:
        """The available pair x >= y of this sum with the largest x, besides one piece of lengths a and b."""
        x = np.arange((total + 1) // 2, min(total, size))
        have = c.copy()
        have[a] -= 1
        if b:
            have[b] -= 1
        x = x[(have[x] > 0) & (have[total - x] > (x == total - x)) & (total > x)]
        return (int(x[-1]), total - int(x[-1])) if len(x) else None

    for a in range(size, 0, -1):
        while c[a]:
            gap = size - a
            if gap == 0:
                use((a,))
                continue
            if c[gap] > (a == gap) and use((a, gap)):
                continue
            if found := pairs(gap, a):
                use((a, *found))
                continue
            free = np.flatnonzero(c[1:gap]) + 1
            done = False
            for x in free[::-1]:
                if c[x] > (x == a) and (found := pairs(gap - int(x), a, int(x))):
                    done = use((a, int(x), *found))
                    break
            if done:
                continue
            # nothing fills it exactly: best fit among open gaps, or a new sequence
            left = int(c[a])
            c[a] = 0
            for g in sorted(k for k in open_ if k >= a):
                while left and open_[g]:
                    parts, n = open_[g].pop()
                    most = g // a
                    full, rest = divmod(left, most)
                    take = min(n, full) if full else 0
                    if take:
                        open_[g - most * a].append([parts + (a,) * most, take])
                        left -= take * most
                        if n > take:
                            open_[g].append([parts, n - take])
                    else:
                        open_[g - rest * a].append([parts + (a,) * rest, 1])
                        left = 0
                        if n > 1:
                            open_[g].append([parts, n - 1])
                if not open_[g]:
                    del open_[g]
            most = size // a
            full, rest = divmod(left, most)
            if full:
                open_[size - most * a].append([(a,) * most, full])
            if rest:
                open_[size - rest * a].append([(a,) * rest, 1])
    return out + [(tuple(p), n) for ps in open_.values() for p, n in ps]


def slots(made: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where ranks go: for each length, ranks from `first` on fill `width` places in each of consecutive sequences from `sequence` on, the first at `offset`."""
    rows, seen, sequence = [], defaultdict(int), 0
    for parts, times in made:
        at = 0
        for l in sorted(set(parts), reverse=True):
            width = parts.count(l)
            rows.append((l, seen[l], width, sequence, at))
            seen[l] += width * times
            at += width * l
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "width", "sequence", "at"]).sort_values(["length", "first"], kind="stable")


def _place(table: pd.DataFrame):
    key = (table["length"].to_numpy(np.int64) << 44) + table["first"].to_numpy(np.int64)
    first, width, sequence, at = (table[c].to_numpy(np.int64) for c in ("first", "width", "sequence", "at"))

    def placed(batches):
        for batch in batches:
            n, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(key, (n << 44) + rank, side="right") - 1
            past = rank - first[k]
            new = pa.array(sequence[k] + past // width[k]), pa.array(at[k] + past % width[k] * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in COLUMNS), *new], [*COLUMNS, "sequence_id", "offset"])

    return placed


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece of docs(doc_id, text).

    Rows that repeat a document are packed as often as they occur. A null doc_id stays null, a null text is empty. Texts are read whole, however long; other columns are not read, whatever their names.
    An empty table gives no rows."""
    rows = common.checkpointed(pieces(docs, path, length, end))
    by_length = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for r in by_length.collect():  # `length` numbers at most
        counts[r["length"]] = r["n"]
    # the pieces of a length are ranked in groups, whose number and size both grow with the square root of their count
    salts = F.get(F.lit(np.ceil(np.sqrt(counts) / 4).astype(int).tolist()), F.col("length").cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    sums = rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    starts = sums.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("rank", F.row_number().over(order) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*COLUMNS, "rank").mapInArrow(_place(slots(plan(counts))), placed)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
