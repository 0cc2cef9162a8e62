"""Token-ID output in Simple-8b words.

A table of pages, written and read by Spark's Parquet source so that any store
that Spark reaches will do. Pages of a shard hold its documents in ascending id
order: their ids and lengths, and the token ids in blocks of 1024 (the last one
filled up with zeros). Blocks are coded in 64-bit little-endian words: 4 bits of
selector, then a varying count of values of equal width; ``block_words`` has
the words of each block, so blocks can be found and decoded on their own.
Selector 0 is an escape: the value stands alone in the next word.

Defined results: null text is empty and gets the end id alone; documents that
share an id are in order of a hash of their texts, so that many of them make
several shards; null ids come first; ids may be of any type that sorts; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import _BASE, _SECOND_BASE, Scratch, chunks, mix, powers, ship, tidy

END_ID = 0
BLOCK = 1024
PAGE_IDS = 1 << 18
PAGE_CHARS = 1 << 18
#: selector -> (values in a word, bits of each); 0 is the escape
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
_BY_COUNT = {n: (s, w) for s, (n, w) in SELECTORS.items()}
_WINDOWS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (3, 2), 6: (3, 3), 7: (4, 3), 8: (4, 4), 10: (5, 5), 12: (6, 6), 15: (8, 7), 20: (10, 10), 30: (15, 15), 60: (30, 30)}
_BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.int8)
_COUNT = np.array([1] + [SELECTORS[s][0] for s in sorted(SELECTORS)], np.int64)
MAX_SHARDS = 200_000  # shard offsets that are broadcast at most


# --------------------------------------------------------------------------
# Simple-8b


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of unsigned values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    v = np.zeros(blocks * BLOCK, np.uint64)
    v[:n] = values
    # bit lengths; a column of 127 after each block keeps words inside it
    if v.size and v.max() < len(_BITS):
        exponent = _BITS[v]
    else:
        exponent = np.frexp(v.astype(np.float64))[1]
        exponent -= np.uint64(1) << (np.clip(exponent, 1, 64) - 1).astype(np.uint64) > v  # rounded up to a power of two
    grid = np.full((blocks, BLOCK + 60), 127, np.int8)
    grid[:, :BLOCK] = exponent.reshape(blocks, BLOCK)
    flat, peak = grid.ravel(), {1: grid.ravel()}
    # the greatest count whose values all fit: 15 - selector, 0 is the escape
    rank = (flat <= 60).view(np.int8) * np.int8(1)
    for count, (x, y) in _WINDOWS.items():
        peak[count] = np.maximum(peak[x][: len(flat) - count + 1], peak[y][x : x + len(flat) - count + 1])
        if count in _BY_COUNT:
            s, width = _BY_COUNT[count]
            np.maximum(rank[: len(peak[count])], (peak[count] <= width).view(np.int8) * np.int8(15 - s), out=rank[: len(peak[count])])
    choice = np.where(rank == 0, 0, 15 - rank).reshape(blocks, BLOCK + 60)[:, :BLOCK]
    step = _COUNT[choice]
    # walk all blocks at once from their first value
    at, rows, taken = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(rows):
        taken.append(rows * BLOCK + at)
        at = at + step[rows, at]
        live = at < BLOCK
        rows, at = rows[live], at[live]
    first = np.sort(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    sel = choice[first // BLOCK, first % BLOCK]
    size = np.where(sel == 0, 2, 1)
    where = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == 0:
            words[where[mine] + 1] = v[first[mine]]
            continue
        count, width = SELECTORS[int(s)]
        w = np.full(int(mine.sum()), np.uint64(int(s) << 60))
        for i in range(count):
            w |= v[first[mine] + i] << np.uint64(i * width)
        words[where[mine]] = w
    return words, np.bincount(first // BLOCK, weights=size, minlength=blocks).astype(np.int32)


def decode(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The first n values. Escaped words are found from the words themselves:
    an escape's selector word is zero but for its selector, so a scan of each
    candidate settles which words are raw."""
    sel = (words >> np.uint64(60)).astype(np.int8)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(sel == 0):
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    sel = sel[heads]
    count = _COUNT[sel]
    start = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel):
        mine = sel == s
        if s == 0:
            out[start[mine]] = words[heads[mine] + 1]
            continue
        k, width = SELECTORS[int(s)]
        w = words[heads[mine]]
        for i in range(k):
            out[start[mine] + i] = (w >> np.uint64(i * width)) & np.uint64((1 << width) - 1)
    return out[:n]


def decode_block(words: np.ndarray, block_words: np.ndarray, block: int) -> np.ndarray:
    """One block of 1024 values, found by the offsets."""
    ends = np.cumsum(block_words)
    return decode(words[ends[block] - block_words[block] : ends[block]], block_words[block : block + 1], BLOCK)


# --------------------------------------------------------------------------
# tokens

SPACE_BYTE = "Ġ"  # the vocabulary's sign for the byte 0x20
SIMPLE = "ɏ"  # up to here, letter and number classes are spelled out below


class _Table:
    """Ids of known pieces by the hash of the piece: open addressing in arrays.
    Cleared when it holds MOST pieces or half of its slots are taken; at most
    ``step`` pieces are added before it is looked at again, so a quarter of the
    slots is always free."""

    MOST = 700_000
    SLOTS = 1 << 21

    def __init__(self):
        self.keys, self.entry = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int32)
        self.clear()

    @property
    def step(self) -> int:
        return self.SLOTS // 4

    def full(self) -> bool:
        return self.n > min(self.MOST, self.SLOTS // 2)

    def clear(self) -> None:
        self.keys[:] = 0
        self.n, self.used = 0, 0
        self.at, self.size, self.pool = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 16, np.uint32)
        self.check = np.zeros(1 << 14, np.uint64)

    def find(self, h: np.ndarray) -> np.ndarray:
        out, todo, slot = np.full(len(h), -1, np.int64), np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            k = self.keys[slot]
            hit = k == h[todo]
            out[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (k != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def add(self, h: np.ndarray, check: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Distinct new hashes, a second hash of each piece, and, end to end,
        the ids of the pieces."""
        first = self.n
        self.n += len(h)
        if self.n > len(self.at):
            self.at, self.size, self.check = (np.resize(x, self.n * 5 // 4) for x in (self.at, self.size, self.check))
        self.check[first : self.n] = check
        if self.used + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, (self.used + len(ids)) * 5 // 4)
        self.at[first : self.n] = self.used + np.cumsum(size) - size
        self.size[first : self.n] = size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        todo, slot = np.arange(len(h)), (h & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            won = free & (self.keys[slot] == h[todo])
            self.entry[slot[won]] = first + todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (self.SLOTS - 1)

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        at = np.repeat(self.at[entry] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[at], size


class Tokens:
    """Ids of whole texts, as the library gives them.

    Texts of simple characters are cut, all at once, into the pieces that the
    byte-level pre-tokenizer makes; each distinct piece is encoded by the
    library once and known from then on by 128 bits of hash. Other texts
    (characters beyond SIMPLE, apostrophes, special tokens) are encoded as a
    whole, and all texts are where the file names another pre-tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.table = _Table()
        kinds = [unicodedata.category(chr(c))[0] for c in range(ord(SIMPLE) + 1)]
        self.kind = np.array([1 if k == "L" else 2 if k == "N" else 3 for k in kinds], np.uint8)
        self.kind[[*range(9, 14), 0x20, 0x85, 0xA0]] = 0
        self.code, self.second = np.random.default_rng(9).integers(0, 2**64, (2, len(kinds)), dtype=np.uint64)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        split = said.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not said.get("normalizer")
        letters = "".join(f"\\u{c:04x}" for c, k in enumerate(kinds) if k == "L")
        self.spaced = re.compile(f" [{letters}]+").fullmatch
        self.beyond = re.compile(f"[^\\x00-{SIMPLE}]").search
        self.special = ["'", *[t.content for t in self.lib.get_added_tokens_decoder().values()]]
        vocabulary = self.lib.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(SPACE_BYTE)]] = True

    def _whole(self, text: str) -> bool:
        if not self.cuts:
            return True
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.beyond(text):
                return True
        return any(t in text for t in self.special)

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, pieces: list[str], h: np.ndarray, check: np.ndarray) -> None:
        """Pieces of a space and letters are encoded many at a time, end to
        end: the pre-tokenizer parts them again, and a token that begins with a
        space begins a piece."""
        mask = np.fromiter((self.spaced(p) is not None for p in pieces), bool, len(pieces))
        for k in range(0, len(pieces), 1000):
            some = np.flatnonzero(mask[k : k + 1000]) + k
            rest = np.flatnonzero(~mask[k : k + 1000]) + k
            if len(some):
                ids = self._alone(["".join([pieces[i] for i in some])])[0]
                at = np.flatnonzero(self.opens[ids])
                if len(at) == len(some):
                    self.table.add(h[some], check[some], ids, np.diff(at, append=len(ids)))
                else:
                    rest = np.concatenate([rest, some])
            if len(rest):
                ids = self._alone([pieces[i] for i in rest])
                self.table.add(h[rest], check[rest], np.concatenate(ids), np.array([len(x) for x in ids]))

    def _pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """(the texts end to end, their characters, starts of the pieces, piece counts of texts)."""
        data = "".join(texts)
        c = np.frombuffer(data.encode("utf-16-le"), np.uint16)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.zeros(len(c) + 1, bool)
        begin[np.cumsum(size) - size] = True
        begin = begin[:-1]
        kind = self.kind[c]
        start = begin.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # of white space before something else, the last character stands
        # alone, or goes with what follows if it is a blank
        e = np.flatnonzero(start[1:] & ~begin[1:] & (kind[:-1] == 0)) + 1
        start[e - 1] = True
        start[e[c[e - 1] == 32]] = False
        s = np.flatnonzero(start)
        return data, c, s, np.diff(np.searchsorted(s, np.concatenate([[0], np.cumsum(size)])))

    def _known(self, data: str, h: np.ndarray, check: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a run of pieces, end to end; number of ids of each)."""
        if self.table.full():
            self.table.clear()
        entry = self.table.find(h)
        gaps = np.flatnonzero(entry < 0)
        if len(gaps):
            new, at = np.unique(h[gaps], return_index=True)
            self._learn([data[a:b] for a, b in zip(s[gaps[at]].tolist(), e[gaps[at]].tolist())], new, check[gaps[at]])
            entry[gaps] = self.table.find(h[gaps])
        if (self.table.check[entry] != check).any():  # two pieces share 64 bits
            ids = self._alone([data[a:b] for a, b in zip(s.tolist(), e.tolist())])
            return np.concatenate(ids), np.array([len(x) for x in ids], np.int64)
        return self.table.ids(entry)

    @staticmethod
    def _hashes(code: np.ndarray, base: int, c: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(c) + 1, np.uint64)
        np.cumsum(code[c] * powers(base, len(c)), out=sums[1:])
        return mix((sums[e] - sums[s]) * powers(pow(base, -1, 2**64), len(c) + 1)[s] + (e - s).astype(np.uint64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end to end; number of ids of each)."""
        whole = np.fromiter(map(self._whole, texts), bool, len(texts))
        simple = [t for t, w in zip(texts, whole) if not w]
        flat, count = np.zeros(0, np.uint32), np.zeros(len(simple), np.int64)
        if simple:
            data, c, s, pieces = self._pieces(simple)
            e = np.append(s[1:], len(c))
            h, check = (self._hashes(code, base, c, s, e) for code, base in ((self.code, _BASE), (self.second, _SECOND_BASE)))
            h[h == 0] = 1
            # a text may have more distinct pieces than the table has room for
            runs = [self._known(data, *(x[i : i + self.table.step] for x in (h, check, s, e))) for i in range(0, len(h), self.table.step)]
            flat, size = (np.concatenate(x) for x in zip(*runs)) if runs else (flat, np.zeros(0, np.int64))
            upto = np.concatenate([[0], np.cumsum(size)])
            cut = np.concatenate([[0], np.cumsum(pieces)])
            count = upto[cut[1:]] - upto[cut[:-1]]
        if not whole.any():
            return flat, count
        own = iter(np.split(flat, np.cumsum(count)[:-1])) if simple else iter(())
        full = iter(self._alone([t for t, w in zip(texts, whole) if w]))
        out = [next(full) if w else next(own) for w in whole]
        return np.concatenate(out), np.array([len(x) for x in out])


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process and file."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# --------------------------------------------------------------------------
# files

PAGE = "shard int, page int, before long, doc_ids array<{}>, lengths array<int>, n_ids long, block_words array<int>, words binary"


def pages(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """The pages of all documents in ascending id order."""
    ship(docs.sparkSession)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    order = ("doc_id", F.xxhash64("text"))
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def write(batches):
        lib = tokens(tokenizer or default_path())
        held, size, before, page, shard, id_type = [], 0, 0, 0, 0, None

        def flush():
            ids = np.concatenate([x for _, x, _ in held])
            words, block_words = encode(ids)
            doc_ids, lengths = [i for own, _, _ in held for i in own], np.concatenate([n for _, _, n in held])
            return pa.record_batch({
                "shard": pa.array([shard], pa.int32()), "page": pa.array([page], pa.int32()), "before": pa.array([before], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(id_type)), "lengths": pa.array([lengths], pa.list_(pa.int32())),
                "n_ids": pa.array([len(ids)], pa.int64()), "block_words": pa.array([block_words], pa.list_(pa.int32())), "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
            })

        for b in batches:
            if not b.num_rows:
                continue
            shard, id_type = b.column("shard")[0].as_py(), b.column("doc_id").type
            doc_ids, texts = b.column("doc_id").to_pylist(), [t or "" for t in b.column("text").to_pylist()]
            for rows in chunks(list(range(len(texts))), lambda i: len(texts[i]) + 1, PAGE_CHARS):
                ids, n = lib.encode([texts[i] for i in rows])
                ids = np.insert(ids, np.cumsum(n), end_id).astype(np.uint32)
                held.append(([doc_ids[i] for i in rows], ids, n + 1))
                size += len(ids)
                if size >= PAGE_IDS:
                    yield flush()
                    held, before, page, size = [], before + size, page + 1, 0
        if held:
            yield flush()

    return d.mapInArrow(tidy(write), PAGE.format(kind))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, **kw) -> None:
    pages(docs, tokenizer, end_id, **kw).write.parquet(path)


def read(files: DataFrame) -> DataFrame:
    """Pages → one row per document: doc_id, start, n_tokens, ids (binary,
    little-endian unsigned 32-bit), decoded from the files."""
    from pyspark.sql import Window as W

    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("shard", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("shard")) - F.col("n")).alias("offset"))
    if totals.count() <= MAX_SHARDS:
        offsets = F.broadcast(offsets)

    kind = files.schema["doc_ids"].dataType.elementType.simpleString()

    def unpack(batches):
        for b in batches:
            for r in range(b.num_rows):
                n = b.column("n_ids")[r].as_py()
                words = np.frombuffer(b.column("words")[r].as_buffer(), "<u8")
                ids = decode(words, b.column("block_words")[r].values.to_numpy(), n).astype("<u4")
                lengths = b.column("lengths")[r].values.to_numpy().astype(np.int64)
                start = np.cumsum(lengths) - lengths
                data = ids.tobytes()
                yield pa.record_batch({"doc_id": b.column("doc_ids")[r].values, "start": pa.array(start + b.column("offset")[r].as_py() + b.column("before")[r].as_py()), "n_tokens": pa.array(lengths), "ids": pa.array([data[4 * s : 4 * (s + k)] for s, k in zip(start, lengths)], pa.binary())})

    return files.join(offsets, "shard").mapInArrow(tidy(unpack), f"doc_id {kind}, start long, n_tokens long, ids binary")


def digest(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the files' documents."""
    return read(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    return digest(scratch.save(pages(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
