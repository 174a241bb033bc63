"""Lexical retrieval packing: BM25 neighbours of a seed document fill its window (after Staniszewski et al., 2023).

Document frequencies, count and mean length are of all documents. The inverted index is sharded by a lexical key: a
document's shard is the posting list of its leading term, the most frequent one whose list still fits a shard, so that
documents that share rare vocabulary meet whatever the size of the corpus, and copies always do. Within a shard a seed
is matched with all its terms against all postings.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import stored, trimmed

WINDOW = 2048
END_OF_TEXT = 1
#: Documents and tokens of one index shard at most; a longer posting list is salted into lists of SHARD_ROWS.
SHARD_ROWS, SHARD_TOKENS = 1024, 4_000_000
#: Tokens that one partition of the index aims at.
PARTITION_TOKENS = 8_000_000
K1, B = 1.2, 0.75
#: Terms are hashed to so many bits: the table of document frequencies has a fixed size, 16 MB.
TERM_BITS = 22
#: Words that a worker remembers, at some 30 bytes each, and characters that it splits at a time.
KNOWN, STEP_CHARS = 1_500_000, 3_000_000
PUNCTUATION = ".,!?;:|*$%&#"
#: Separators that Arrow takes for white space and the tokenizer's patterns don't.
SEPARATORS = "[\x1c-\x1f]"
WORD = re.compile("[^\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Letters whose lower case is one letter each and that normalisation leaves as they are.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _without_patterns(setup: dict) -> dict:
    """The tokenizer for lower-case Latin words and runs of punctuation between spaces, which its patterns keep whole."""
    steps = (setup["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    if len(steps) == 2 and steps[0].get("pattern") == {"Regex": split} and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"]:
        return setup | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, steps[1]]}}
    return setup


def _bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 of all strings, where they begin and the last one ends)."""
    raw = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)
    return raw, np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings: bytes times a multiplier of their place, summed and mixed."""
    raw, offsets = _bytes(words)
    size = np.diff(offsets)
    raw = raw[offsets[0] : offsets[-1]].astype(np.uint64)
    begin = offsets[:-1] - offsets[0]
    place = (np.arange(len(raw), dtype=np.int32) - np.repeat(begin, size)).astype(np.uint64)
    place = (place + np.uint64(1)) * MIX[0]
    place = (place ^ (place >> np.uint64(31))) * MIX[1]
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw + np.uint64(1)) * (place | np.uint64(1)))])  # wraps; so do differences
    h = (total[begin + size] - total[begin] + size.astype(np.uint64)) * MIX[2]
    return (h ^ (h >> np.uint64(29))) * MIX[1]


class WordPieces:
    """Token ids by word, each learned once; equal to encoding whole texts because no token crosses white space.

    Known words are 64-bit hashes in sorted arrays with their places in one array of ids. Where there are more than
    ``known``, those that no text has used since the last such sweep are forgotten.
    """

    def __init__(self, path: str, known: int = KNOWN):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lean = Tokenizer.from_str(json.dumps(_without_patterns(json.loads(self.tokenizer.to_str()))))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(size, bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.limit = known
        self.hashes, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.used, self.ids = np.zeros(0, bool), np.zeros(0, self.dtype)

    def _encode(self, words: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(words), 10_000):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words[i : i + 10_000], add_special_tokens=False)]
        return out

    def _parts(self, parts: list[str], tokenizer) -> list[bytes]:
        """Ids of runs of letters or of punctuation, many in one call, parted at tokens that end a word."""
        ids = np.array(tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * self.dtype.itemsize).tolist()
        if len(cuts) != len(parts):  # some part is several words to the tokenizer
            return self._encode(parts)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether known) of hashes."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at, order = np.empty(len(h), np.int64), np.argsort(h)  # neighbouring look-ups share cache lines
        at[order] = np.minimum(np.searchsorted(self.hashes, h[order]), len(self.hashes) - 1)
        return at, self.hashes[at] == h

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Encode words or cores: Latin letters and runs of punctuation joined, other letters joined, the rest one by one."""
        kinds: tuple[list[int], ...] = ([], [], [])
        for i, w in enumerate(words):
            kinds[0 if LATIN.fullmatch(w) or not w.strip(PUNCTUATION) and w else 1 if w.isalpha() else 2].append(i)
        ids: list[bytes] = [b""] * len(words)
        for mine, tokenizer in zip(kinds, (self.lean, self.tokenizer, None), strict=True):
            some = [words[i] for i in mine]
            for i, x in zip(mine, (self._parts(some, tokenizer) if tokenizer else self._encode(some)) if some else [], strict=True):
                ids[i] = x
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.dtype.itemsize
        at = (len(self.ids) + np.cumsum(size) - size).astype(np.int32)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), self.dtype)])
        order = np.argsort(hashes)
        into = np.searchsorted(self.hashes, hashes[order])
        for name, values in (("hashes", hashes), ("at", at), ("len", size), ("used", np.ones(len(at), bool))):
            setattr(self, name, np.insert(getattr(self, name), into, values[order]))

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in the remembered ids, number of ids) of distinct strings."""
        h = hashed(words)
        at, known = self._find(h)
        if not known.all():
            missing = np.flatnonzero(~known)
            self._learn(words.take(pa.array(missing)).to_pylist(), h[missing])
            at, _ = self._find(h)
        self.used[at] = True
        return self.at[at], self.len[at]

    def _sweep(self) -> None:
        keep = np.flatnonzero(self.used) if self.used.sum() < self.limit // 2 else np.zeros(0, np.int64)
        n = self.len[keep]
        self.ids = self.ids[np.repeat(self.at[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        self.hashes, self.at, self.len, self.used = self.hashes[keep], (np.cumsum(n) - n).astype(np.int32), n, np.zeros(len(keep), bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids end) of texts without null."""
        if pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py():
            split = [WORD.findall(t) for t in texts.to_pylist()]
            per, words = np.array([len(ws) for ws in split], np.int64), pa.array([w for ws in split for w in ws], pa.string())
        else:
            lists = pc.utf8_split_whitespace(texts)
            per, words = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()
        if not len(words):
            return np.zeros(0, self.dtype), np.zeros(len(per), np.int64)
        if len(self.hashes) > self.limit:
            self._sweep()
        coded = words.dictionary_encode()
        names = coded.dictionary
        # a word of Latin letters is looked up in lower case and without the punctuation behind it, which is a word of its own
        core = pc.utf8_rtrim(names, PUNCTUATION)
        easy = pc.match_substring_regex(core, f"^{LATIN.pattern}$")
        tail = _cut(names, pc.if_else(easy, pc.binary_length(core), pc.binary_length(names)))
        core = pc.if_else(easy, pc.utf8_lower(core), names).dictionary_encode()
        tail = tail.dictionary_encode()
        at, size = [], []
        for part in (core, tail):
            start, n = self._pieces(part.dictionary)
            i = part.indices.to_numpy(zero_copy_only=False)
            at.append(start[i])
            size.append(n[i])
        ids = _gathered(self.ids, np.stack(at, 1).ravel(), np.stack(size, 1).ravel())
        n = size[0] + size[1]
        index = coded.indices.to_numpy(zero_copy_only=False)
        size = n[index]
        upto = np.cumsum(size, dtype=np.int64)
        return _gathered(ids, (np.cumsum(n) - n).astype(np.int32)[index], size), np.concatenate([[0], upto])[np.cumsum(per)]


def _cut(words: pa.Array, begin: pa.Array) -> pa.Array:
    """Each word from a byte place on."""
    raw, offsets = _bytes(words)
    start = offsets[:-1] + begin.to_numpy(zero_copy_only=False)
    size = offsets[1:] - start
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(_gathered(raw, start, size).tobytes()))


def _gathered(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of values that begin at ``start``, one behind the other."""
    upto = np.cumsum(size, dtype=np.int64)
    return values[np.repeat(start - (upto - size).astype(np.int32), size) + np.arange(upto[-1] if len(upto) else 0, dtype=np.int32)]


_PIECES: dict[str, WordPieces] = {}


def terms_of(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed term) of every word of concatenated documents; a word is the ids up to one that ends a word."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = ends[ids]
    last[bounds[np.diff(bounds, prepend=0) > 0] - 1] = True
    stop = np.flatnonzero(last)
    start = np.concatenate([[0], stop[:-1] + 1])
    place = (np.arange(len(ids)) - np.repeat(start, stop - start + 1)).astype(np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * (place * MIX[0] + MIX[1])
    term = (np.add.reduceat(mixed, start) * MIX[2] >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    return np.searchsorted(bounds, stop, "right"), term


def distinct_terms(ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the distinct terms, and the number of words by document."""
    doc, term = terms_of(ids, bounds, ends)
    key = np.sort(doc << TERM_BITS | term)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else key
    return key[first] >> TERM_BITS, key[first] & ((1 << TERM_BITS) - 1), np.diff(np.concatenate([first, [len(key)]])), np.bincount(doc, minlength=len(bounds))


TOKENS = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("words", pa.int64()), ("terms", pa.list_(pa.int32())), ("docs", pa.list_(pa.int64()))])


def _tokenise(path: str):
    """A row (id, ids, words) a document; behind a partition's documents its document frequencies, as rows (terms, docs)."""

    def steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
        texts = batch.column(1)
        upto = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False))
        cuts = [0]
        while cuts[-1] < len(texts):
            begun = upto[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, begun + STEP_CHARS, "right"))))
            yield batch.column(0).slice(cuts[-2], cuts[-1] - cuts[-2]), pc.fill_null(texts.slice(cuts[-2], cuts[-1] - cuts[-2]), "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _PIECES.setdefault(path, None) or WordPieces(path)
        _PIECES[path] = pieces  # a worker keeps its words between tasks
        df = np.zeros(1 << TERM_BITS, np.int32)
        for batch in batches:
            for names, texts in steps(batch):
                ids, bounds = pieces.encode(texts)
                _, term, _, words = distinct_terms(ids, bounds, pieces.ends)
                df += np.bincount(term, minlength=len(df)).astype(np.int32)
                width = pieces.dtype.itemsize
                blob = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((np.concatenate([[0], bounds]) * width).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([names, blob, pa.array(words), pa.nulls(len(names), pa.list_(pa.int32())), pa.nulls(len(names), pa.list_(pa.int64()))], schema=TOKENS)
        seen = np.flatnonzero(df)
        for part in np.array_split(seen, -(-len(seen) // 50_000) or 1):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([part.astype(np.int32)], pa.list_(pa.int32())), pa.array([df[part].astype(np.int64)], pa.list_(pa.int64()))], schema=TOKENS)

    return run


def unpacked(blobs: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, where each document's end) of a binary column."""
    n = pc.binary_length(blobs).to_numpy(zero_copy_only=False).astype(np.int64) // dtype.itemsize
    return np.frombuffer(b"".join(x.as_buffer() for x in blobs), dtype), np.cumsum(n)


def leading(doc: np.ndarray, term: np.ndarray, df: np.ndarray, n: int, limit: int = SHARD_ROWS) -> np.ndarray:
    """Per document (ascending) its leading term, or -1: the most frequent whose documents fit a shard and that another holds.

    Else the rarest of the more frequent ones, else any.
    """
    best = np.full(n, -1, np.int64)
    if len(doc):
        f = df[term].astype(np.float64)
        rank = np.where(f > limit, limit + 2 + np.log2(f), np.where(f > 1, limit + 1 - f, np.inf))
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        low = np.minimum.reduceat(rank, first)
        tied = np.where(rank == np.repeat(low, np.diff(np.append(first, len(doc)))), term, 1 << TERM_BITS)
        best[doc[first]] = np.minimum.reduceat(tied, first)
    return best


def _leads(df: np.ndarray, empty: int, ends: np.ndarray, dtype: np.dtype):
    """Adds the key of its index shard to each document: leading term and, where its list is long, a salt by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            ids, bounds = unpacked(batch.column("ids"), dtype)
            lead = leading(*terms_of(ids, bounds, ends), df, batch.num_rows)
            n = np.where(lead < 0, empty, df[lead]).astype(np.int64)
            salt = ((np.arange(row, row + len(lead)).astype(np.uint64) * MIX[0] >> np.uint64(20)) % np.maximum(-(-n // SHARD_ROWS), 1).astype(np.uint64)).astype(np.int64)
            row += len(lead)
            yield pa.RecordBatch.from_arrays([pa.array(((lead + 1) << 40) | salt), batch.column("id"), batch.column("ids")], names=["key", "id", "ids"])

    return run


class Bm25:
    """Inverted index of one shard under the corpus' document frequencies, count and mean length."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, ends: np.ndarray, df: np.ndarray, total: int, mean: float):
        doc, term, tf, length = distinct_terms(ids, bounds, ends)
        f = df[term].astype(float)
        idf = np.log1p((total - f + 0.5) / (f + 0.5))
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / max(mean, 1e-9)))
        self.n = len(bounds)
        order = np.argsort(term, kind="stable")
        first = np.concatenate([[True], np.diff(term[order]) > 0]) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        self.docs, self.weight = doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.lo, self.hi = at, np.concatenate([at[1:], [len(order)]])
        slot = np.empty(len(order), np.int64)
        slot[order] = np.cumsum(first) - 1
        self.query, self.query_at = slot, np.searchsorted(doc, np.arange(self.n + 1))
        # postings of the terms that many documents of the shard hold, as rows of a matrix
        often = np.flatnonzero(self.hi - self.lo > max(32, self.n // 10))
        self.row = np.full(len(self.lo), -1)
        self.row[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), self.n), np.float32)
        mine = self.row[slot]
        self.dense[mine[mine >= 0], doc[mine >= 0]] = weight[mine >= 0]

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of document i, each once."""
        q = self.query[self.query_at[i] : self.query_at[i + 1]]
        row = self.row[q]
        total = self.dense[row[row >= 0]].sum(0)
        q = q[row < 0]
        lo, n = self.lo[q], self.hi[q] - self.lo[q]
        lo, n = lo[n > 1], n[n > 1]  # terms of document i alone add to no other
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return total + np.bincount(self.docs[at], self.weight[at], minlength=self.n)

    def neighbours(self, i: int, used: np.ndarray, first: int = 32) -> Iterator[np.ndarray]:
        """Unused documents that share a term with i, best first, ties by position: about ``first`` of them, then the rest."""
        score = self.scores(i)
        score[used] = 0
        found = np.flatnonzero(score)
        if len(found) > first:
            least = np.partition(score[found], len(found) - first)[len(found) - first]
            top = found[score[found] >= least]
            yield top[np.argsort(-score[top], kind="stable")]
            found = found[score[found] < least]
        yield found[np.argsort(-score[found], kind="stable")]


def filled(sizes: np.ndarray, index: Bm25, window: int, upto: int = 0) -> list[int]:
    """Order of the documents behind ``upto`` tokens: a window's first document is its seed, unused neighbours follow until it is full.

    A document that crosses the window's end goes on in the next window and is its seed. Where a seed has no unused
    neighbour left, the next unused document follows.
    """
    n, used, order, free = len(sizes), np.zeros(len(sizes), bool), [], 0

    def take(j: int) -> None:
        nonlocal upto
        used[j] = True
        order.append(j)
        upto += int(sizes[j])

    while len(order) < n:
        while used[free]:
            free += 1
        if not order or upto % window == 0:
            take(free)
            continue
        end = (upto // window + 1) * window
        for near in index.neighbours(order[-1], used):
            for j in near[: int(np.searchsorted(np.cumsum(sizes[near]), end - upto)) + 1].tolist():
                take(j)
            if upto >= end:
                break
        while upto < end and len(order) < n:
            while used[free]:
                free += 1
            take(free)
    return order


def _packing(ends: np.ndarray, dtype: np.dtype, df: np.ndarray, total: int, mean: float, window: int, end_id: int, digest: bool):
    """Streams a sorted partition: index shards of bounded size, one after the other, share its windows."""

    def shard(blocks: list[pa.RecordBatch], begun: int, place: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(blocks).combine_chunks()
        names = table.column("id").to_pylist()
        ids, bounds = unpacked(table.column("ids").chunk(0), dtype)
        starts, sizes = np.concatenate([[0], bounds[:-1]]), np.diff(bounds, prepend=0) + 1
        rows = []
        for i in filled(sizes, Bm25(ids, bounds, ends, df, total, mean), window, begun % window):
            whole = np.append(ids[starts[i] : bounds[i]].astype("<u4"), np.uint32(end_id)).astype("<u4").tobytes()
            start, size = 0, int(sizes[i])
            while start < size:
                n = min(size - start, window - begun % window)
                part = whole[4 * start : 4 * (start + n)]
                rows.append((names[i], start, n, zlib.crc32(part) if digest else part, size, place + begun // window, begun % window))
                start, begun = start + n, begun + n
        kinds = [pa.int64()] * 7 if digest else [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"]), begun

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        begun, held, rows, tokens = 0, [], 0, 0
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            more = (pc.sum(pc.binary_length(batch.column("ids"))).as_py() or 0) // dtype.itemsize
            if held and (rows + batch.num_rows > SHARD_ROWS or tokens + more > SHARD_TOKENS):
                out, begun = shard(held, begun, place)
                yield out
                held, rows, tokens = [], 0, 0
            held, rows, tokens = [*held, batch], rows + batch.num_rows, tokens + more
        if held:
            yield shard(held, begun, place)[0]

    return run


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_OF_TEXT, digest: bool = False) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all documents, each followed by ``end_id``.

    ``ids`` holds a piece's token ids as little-endian unsigned 32-bit; with ``digest`` their CRC-32 comes in its place,
    as ids_crc32. Documents are dealt to index shards by their leading term (see the module's docstring); a term of more
    than ``SHARD_ROWS`` documents is salted by row, so neither copies nor rows without terms meet in one task. Sequences
    are full but for the last of each partition. A null text is empty (one token), repeated rows are packed as rows of
    their own, an empty table gives no pieces; other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = df.sparkSession
    pieces = WordPieces(tokenizer)
    ends, dtype = pieces.ends, pieces.dtype
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = stored(base.mapInArrow(trimmed(_tokenise(tokenizer)), "id long, ids binary, words long, terms array<int>, docs array<long>"))
    docs = both.where("ids is not null")
    stats = docs.agg(F.count("*").alias("n"), F.sum("words").alias("words"), F.count(F.when(F.col("words") == 0, 1)).alias("empty"), F.sum(F.octet_length("ids")).alias("size")).first()
    counts = both.where("ids is null").select(F.explode(F.arrays_zip("terms", "docs")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.docs").alias("n"))
    frequency = np.zeros(1 << TERM_BITS, np.float32)  # a fixed size, however large the corpus
    for r in counts.groupBy(F.shiftright("term", 12).alias("block")).agg(F.collect_list("term").alias("t"), F.collect_list("n").alias("n")).toLocalIterator():
        frequency[r["t"]] = r["n"]
    total, mean = stats["n"], (stats["words"] or 0) / max(stats["n"], 1)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(stats["size"] or 0) // dtype.itemsize // PARTITION_TOKENS))
    keyed = docs.select("id", "ids").mapInArrow(trimmed(_leads(frequency, stats["empty"], ends, dtype)), "key long, id long, ids binary")
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "id", "ids")
    schema = f"id long, start long, length long, {'ids_crc32 long' if digest else 'ids binary'}, doc_tokens long, sequence_id long, offset long"
    out = dealt.select("id", "ids").mapInArrow(trimmed(_packing(ends, dtype, frequency, total, mean, window, end_id, digest)), schema)
    return out.withColumnRenamed("id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2,048 tokens."""
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
