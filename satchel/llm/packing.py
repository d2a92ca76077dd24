"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids plus an end id; only documents over the capacity are cut, into pieces of the capacity, the
last of which may be shorter. What is planned is the *histogram* of piece lengths, which has at most `capacity` entries
however many documents there are. The planner takes the longest length left, hashes its gap, and looks in indexes of
single lengths, sums of pairs and sums of triples for a combination that fills the gap exactly under the counts that
are available; a found pattern is used as often as the counts allow. What no exact combination completes is packed best
fit, again a pattern at a time. Pieces then get their place by rank within their length, with no group in one task.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_of, bound_batches, fresh_name, kept, keyed, lots, stored, tidy

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of texts that are tokenised at once (one longer text is a lot of its own), words in one call of the tokenizer, and
#: words whose ids a worker keeps, about 30 MB.
LOT_BYTES, CALL_WORDS, WORDS_KEPT = 4 << 20, 1000, 200_000
#: Pieces of one length that are numbered in one group, about, and groups of one length at most.
RUN, MOST_RUNS = 100, 1 << 16

# How a tokenizer whose words can be looked up one by one prepares its text.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
WORD_END = "</w>"

#: Below this, normalisation is lower-casing alone; chunks with other characters, or those below, go to the tokenizer whole.
LATIN = 0x250
_OTHER = re.compile(f"[\x1c-\x1f\u0130{chr(LATIN)}-\U0010ffff]")


def _latin_pattern() -> re.Pattern:
    """The tokenizer's own splitting pattern, with its Unicode classes written out for characters below LATIN."""
    kinds = {"L": "", "N": "", " ": ""}
    for c in map(chr, range(LATIN)):
        kind = " " if c in "\t\n\v\f\r \x85\xa0" else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += re.escape(c)
    return re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^{kinds[' ']}{kinds['L']}{kinds['N']}]+")


#: Finds words, and the line breaks that part chunks.
_WORDS = _latin_pattern()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0] + 1, ... of all ranges in a row."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class TextEncoder:
    """Token ids of whole texts, as the tokenizer gives them.

    Where the tokenizer drops white space, ends every word of its splitting pattern with a token of its own kind and
    normalises within words alone, the ids of a text are those of its words in a row: then every different word of a lot
    is encoded once, many in one call, and the first WORDS_KEPT words are kept. Any other tokenizer, and texts that hold one
    of its added tokens, go through it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        self.by_word = all(kind[k] == v for k, v in BY_WORD.items()) and kind["model"]["type"] == "BPE" and kind["model"].get("end_of_word_suffix") == WORD_END and not kind["model"].get("dropout")
        self.added = [x["content"] for x in kind["added_tokens"]]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[v for k, v in vocabulary.items() if k.endswith(WORD_END)]] = True
        self.known: dict = {"\n": 0}
        self.ids, self.sizes = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        ids, sizes = [], []
        for lo in range(0, len(words), CALL_WORDS):
            part = words[lo : lo + CALL_WORDS]
            (got,) = self._each([" ".join(part)])
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) == len(part) and stops[-1] == len(got):
                ids.append(got)
                sizes.append(np.diff(stops, prepend=0))
            else:
                each = self._each(part)
                ids += each
                sizes.append(np.array([len(x) for x in each]))
        return (np.concatenate(ids), np.concatenate(sizes)) if words else (np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many each has); a chunk holds no ASCII white space."""
        joined = "".join(pc.binary_join_element_wise(chunks, "", "\n").to_pylist()) if len(chunks) else ""
        if _OTHER.search(joined):
            parts = ([(x,), "\n"] if _OTHER.search(x) else [*_WORDS.findall(x.lower()), "\n"] for x in chunks.to_pylist())
            words = list(chain.from_iterable(parts))
        else:
            words = _WORDS.findall(joined.lower())
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        odd = [w for w in fresh if isinstance(w, tuple)]
        plain = [w for w in fresh if isinstance(w, str)] if odd else fresh
        ids, sizes = self._of_words(plain)
        each = self._each([w[0] for w in odd])
        ids, sizes = np.concatenate([self.ids, ids, *each]), np.r_[self.sizes, sizes, [len(x) for x in each]].astype(np.int64)
        places = zip(chain(plain, odd), range(len(known), len(known) + len(fresh)), strict=True)
        if len(known) + len(fresh) <= WORDS_KEPT:
            known.update(places)
            self.ids, self.sizes = ids, sizes
        else:
            known = known | dict(places)
        used = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        total = np.cumsum(sizes[used])
        pool = ids[_ranges((np.cumsum(sizes) - sizes)[used], sizes[used])]
        return pool, np.diff(total[used == 0], prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text of a string column, in order; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            for text in texts:
                yield from self._each([text.as_py()])
            return
        whole = np.zeros(len(texts), bool)
        for mark in self.added:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        pool, sizes = self._of_chunks(coded.dictionary)
        starts = np.cumsum(sizes) - sizes
        codes = coded.indices.to_numpy()
        stops = np.r_[0, np.cumsum(sizes[codes])]
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        ids = pool[_ranges(starts[codes], sizes[codes])]
        for k in range(len(texts)):
            yield self._each([texts[k].as_py()])[0] if whole[k] else ids[stops[offsets[k]] : stops[offsets[k + 1]]]


def encoder(path: str) -> TextEncoder:
    """One for each worker process, kept from task to task."""
    return kept(("encoder", path), lambda: TextEncoder(path))


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids and end id, cut only where over capacity.

    A null or empty text is the end id alone; a null id stays null. Repeated rows are packed as often as they occur. Other
    columns are not read, whatever their names. An empty table gives no pieces.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    end = np.array([end_id], "<u4").tobytes()
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in lots(texts, lot_bytes):
                rows: list[tuple] = []
                for doc_id, got in zip(ids[lo:hi], encoder(tokenizer_path).encode(texts.slice(lo, hi - lo)), strict=True):
                    for piece, start in enumerate(range(0, len(got) + 1, capacity)):
                        part, last = got[start : start + capacity], len(got) < start + capacity
                        check = zlib.crc32(np.ascontiguousarray(part))
                        row = (doc_id, piece, start, len(part) + last, zlib.crc32(end, check) if last else check)
                        rows.append(row + (part.tolist() + [end_id] * last,) if with_ids else row)
                yield batch_of(names, list(map(list, zip(*rows, strict=True))), types)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return keyed(df, id_col, text_col).mapInArrow(tidy(run, keeps=True), schema)


class _Stock:
    """Lengths still to place, with their counts; sorted, for sums and best fit."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {k: n for k, n in counts.items() if n > 0 and k > 0}
        self.order = sorted(self.count)

    def take(self, pattern: tuple[int, ...]) -> int:
        need = Counter(pattern)
        times = min(self.count[k] // n for k, n in need.items())
        for k, n in need.items():
            self.count[k] -= n * times
            if not self.count[k]:
                del self.count[k]
                self.order.pop(bisect_right(self.order, k) - 1)
        return times

    def has(self, *lengths: int) -> bool:
        return all(self.count.get(k, 0) >= n for k, n in Counter(lengths).items())


class _Sums:
    """Indexes of the sums of one, two and three available lengths. Counts only fall, so entries only go stale."""

    def __init__(self, stock: _Stock, capacity: int) -> None:
        self.stock = stock
        self.single = np.zeros(capacity + 1, bool)
        self.single[stock.order] = True
        spread = np.fft.rfft(self.single, 2 * capacity + 2)
        self.pair = np.fft.irfft(spread * spread, 2 * capacity + 2)[: capacity + 1] > 0.5

    def pairs(self, total: int) -> np.ndarray:
        """The larger halves a of all pairs (a, total - a) of available lengths, longest first."""
        half = (total + 1) // 2
        both = self.single[half : total + 1] & self.single[total - half :: -1][: total + 1 - half]
        return np.flatnonzero(both)[::-1] + half

    def fill(self, first: int, gap: int) -> tuple[int, ...] | None:
        """A single, pair or triple of available lengths that fills the gap exactly beside first."""
        stock = self.stock
        if stock.has(first, gap):
            return (gap,)
        for a in self.pairs(gap).tolist():
            if stock.has(first, a, gap - a):
                return (a, gap - a)
        for c in (np.flatnonzero(self.single[: gap + 1] & self.pair[gap::-1])[::-1]).tolist():
            found = False
            for a in self.pairs(gap - c).tolist():
                found = True
                if stock.has(first, c, a, gap - c - a):
                    return tuple(sorted((c, a, gap - c - a), reverse=True))
            if not found:
                self.pair[gap - c] = False
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(pattern of lengths, how many sequences use it) for all pieces; no sequence is over capacity."""
    if any(k > capacity for k in counts):
        raise ValueError("a piece is longer than the capacity")
    stock, out = _Stock(counts), []
    sums = _Sums(stock, capacity)

    def use(pattern: tuple[int, ...]) -> None:
        out.append((pattern, stock.take(pattern)))
        for k in pattern:
            sums.single[k] = k in stock.count

    rest: dict[int, int] = {}
    while stock.order:
        first = stock.order[-1]
        if first == capacity:
            use((first,))
            continue
        found = sums.fill(first, capacity - first)
        if found:
            use((first, *found))
        else:
            rest[first] = stock.count.pop(first)
            stock.order.pop()
            sums.single[first] = False
    stock = _Stock(rest)
    while stock.order:  # best fit: the longest that still goes in, again and again
        pattern, gap = [stock.order[-1]], capacity - stock.order[-1]
        while gap:
            used = Counter(pattern)
            at = bisect_right(stock.order, gap)
            while at and used[stock.order[at - 1]] >= stock.count[stock.order[at - 1]]:
                at -= 1
            if not at:
                break
            pattern.append(stock.order[at - 1])
            gap -= pattern[-1]
        use(tuple(pattern))
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, copies in a sequence, first sequence, offset) of each run of equal pieces."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, taken[length], taken[length] + times * copies - 1, copies, sequence, offset))
            taken[length] += times * copies
            offset += length * copies
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, runs_of: int = RUN) -> DataFrame:
    """Add sequence_id and offset to stored pieces with a column length; all other columns stay, whatever their names.

    The driver sees one count for each length, at most `capacity` of them; the plan that goes to the tasks has a few rows
    for each length. Pieces of a length, equal ones too, are dealt to runs by their place in the stored table and numbered
    run by run, so no task gets all pieces of a common length. Null lengths are refused, an empty table gives an empty
    table, and which of equal lengths goes where is open.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    if None in counts:
        raise ValueError("a piece has no length")
    at, run, base, rank = (fresh_name(pieces, x) for x in ("at", "run", "base", "rank"))
    slots = np.array(_slots(plan(counts, capacity)), np.int64).reshape(-1, 6)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    runs = spark.createDataFrame([(k, min(MOST_RUNS, max(1, n // runs_of))) for k, n in counts.items()], f"length long, {run} long")
    salted = pieces.withColumn(at, F.monotonically_increasing_id()).join(F.broadcast(runs), "length").withColumn(run, F.pmod(F.xxhash64(at), run))
    sizes = salted.groupBy("length", run).count()
    before = Window.partitionBy("length").orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", run, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(base))
    within = Window.partitionBy("length", run).orderBy(at)
    ranked = salted.withColumn(rank, F.row_number().over(within) - 1).join(bases, ["length", run])
    ranked = ranked.select(*pieces.columns, (F.col(rank) + F.col(base)).alias(rank))
    place = pieces.columns.index("length")

    span = sum(counts.values()) + 1
    firsts = slots[:, 0] * span + slots[:, 1]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            length, number = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (place, n))
            _, first, _, copies, sequence, offset = slots[np.searchsorted(firsts, length * span + number, "right") - 1].T
            step = number - first
            where = [pa.array(sequence + step // copies), pa.array(offset + step % copies * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *where], names=[*batch.schema.names[:n], "sequence_id", "offset"])

    kind = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(tidy(put), kind)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Tokenise, cut and pack whole documents; see token_pieces and pack. Smaller lots take less memory and more time."""
    pieces = stored(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id, lot_bytes=lot_bytes), "pieces")
    return pack(pieces, capacity)
