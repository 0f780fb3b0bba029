"""Token ids of documents, made once and kept as a table with running offsets."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeflow.llm.shared import block_offsets, materialise, small_batches, worker_memory

WORD_BPE = "word_bpe_49k.json"
#: Longer pieces (in bytes) are encoded one by one, as each round of merging passes over all pieces.
LONG_PIECE = 32
#: Pieces that are merged together.
MERGED_PIECES = 16_384
#: Bytes of ids that are cut at once (one document's at least).
SLICE = 1_000_000
#: Bytes of text that are encoded at once (one text at least): the more, the fewer pieces are merged again.
TEXT_SLICE = 2_000_000
#: Text with other characters is encoded whole (composition, case or space could differ from Arrow's there).
_NOT_PLAIN = "[\\x1c-\\x1f\\x{130}]|[^\\x00-\\x{17F}]"

_LETTER, _NUMBER = 1, 2
_NO_RANK, _NO_PAIR, _SLOT_BITS = 1 << 52, 0xFFFFFFFF, 18


def _strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each begins and the last ends."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int32)
    _, at, data = values.buffers()
    at = np.frombuffer(at, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _gather(ids: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``ids[first : first + size]`` in a row, and where each begins and the last ends."""
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int32)]).astype(np.int32)
    return ids[np.repeat(first - ends[:-1], size) + np.arange(ends[-1], dtype=np.int32)], ends


class PairMerges:
    """Byte-pair merges of many pieces at once: in each round every piece merges its pair of lowest rank,
    the leftmost of equals, as the model does piece by piece."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str, byte_signs: dict[int, str]):
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        if len(vocab) > 1 << 16 or len(pairs) > 1 << _SLOT_BITS - 1:
            raise ValueError("ids must fit 16 bits, merges half of the slots")
        if any(left.endswith(suffix) for left, _ in pairs):
            raise ValueError("a merge goes on after the end of a word")
        self.inner, self.last = np.zeros(256, np.uint32), np.zeros(256, np.uint32)
        for byte, sign in byte_signs.items():
            self.inner[byte], self.last[byte] = vocab[sign], vocab[sign + suffix]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        self.keys, self.ranks = np.full(1 << _SLOT_BITS, _NO_PAIR, np.uint32), np.full(1 << _SLOT_BITS, _NO_RANK, np.int64)
        for key, rank in {vocab[a] << 16 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}.items():
            slot = (key * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - _SLOT_BITS
            while self.keys[slot] != _NO_PAIR:
                slot = (slot + 1) % (1 << _SLOT_BITS)
            self.keys[slot], self.ranks[slot] = key, rank << 32

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, times 2**32."""
        key = left << np.uint32(16) | right
        slot = key * np.uint32(0x9E3779B1) >> np.uint32(32 - _SLOT_BITS)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], _NO_RANK)
        open_ = np.flatnonzero((found != key) & (found != _NO_PAIR))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % np.uint32(1 << _SLOT_BITS)
            found = self.keys[slot[open_]]
            same = found == key[open_]
            out[open_[same]] = self.ranks[slot[open_[same]]]
            open_ = open_[~same & (found != _NO_PAIR)]
        return out

    def __call__(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces ``raw[at[k] : at[k + 1]]`` (a byte at least) in a row, and how many each has.

        No pair over a border gets a rank, as a piece's last symbol is one that ends words.
        """
        symbols = self.inner[raw]
        symbols[at[1:] - 1] = self.last[raw[at[1:] - 1]]
        ranks = np.append(self._rank(symbols[:-1], symbols[1:]), _NO_RANK)
        which, size, total = np.arange(len(at) - 1), np.diff(at), np.zeros(len(at) - 1, np.int32)
        ids, order = [], []
        while len(which):
            first = np.cumsum(size) - size
            best = np.minimum.reduceat(ranks | np.arange(len(ranks)), first)
            live = best < _NO_RANK
            keep = np.repeat(live, size)
            ids.append(symbols[~keep].astype(np.uint16))
            order.append(which[~live])
            total[which[~live]] = size[~live]
            best, which, size = best[live], which[live], size[live] - 1
            pair = best & 0xFFFFFFFF
            symbols[pair] = new = self.merged[best >> 32]
            ranks[pair - 1] = self._rank(symbols[pair - 1], new)
            ranks[pair] = self._rank(new, symbols[np.minimum(pair + 2, len(symbols) - 1)])
            keep[pair + 1] = False
            symbols, ranks = symbols[keep], ranks[keep]
        order = np.concatenate(order)
        first = np.empty(len(total), np.int32)
        first[order] = np.cumsum(total[order]) - total[order]
        return _gather(np.concatenate(ids), first, total)[0], total


class WordTokenizer:
    """Ids by a word-level BPE file, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Its model turns a piece (a run of letters, a digit, a run of other signs, one of seven endings such
    as 's) into ids whatever its neighbours are. So the words of many texts are split and numbered
    together by Arrow, the different words are cut into pieces by their signs' kinds (below U+0180), the
    different pieces are merged together, and ids are gathered by number, first to words, then to texts.
    Nothing is remembered. Special tokens' strings in a text are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        below = [chr(c) for c in range(0x180)]
        mapped = {c: to_bytes(c)[0][0] for c in below}
        self.mapped = {ord(c): m for c, m in mapped.items()}
        self.kind = np.array([{"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], 0) for c in below], np.uint8)
        self.model = self.full.model
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        signs = {byte: sign for c, m in mapped.items() for byte, sign in zip(c.encode(), m, strict=True)}
        self.merge = PairMerges(self.full.get_vocab(with_added_tokens=False), merges, self.model.end_of_word_suffix, signs)

    def _cuts(self, raw: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Whether a piece begins at each byte of words that begin at ``words``."""
        n = len(raw)
        padded = np.append(raw, np.zeros(4, np.uint8))
        kind = self.kind[padded]
        lead = np.flatnonzero(raw >= 0xC0)
        kind[lead] = kind[lead + 1] = self.kind[(padded[lead] & np.uint16(31)) << 6 | padded[lead + 1] & 63]
        heads, cuts = np.zeros(n + 4, bool), np.ones(n + 4, bool)
        heads[words] = True
        cuts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        cuts[lead + 1] = False
        cuts |= heads
        quote = np.flatnonzero((raw == ord("'")) & cuts[:n])
        quote = quote[~heads[quote + 1]]
        short = quote[np.isin(padded[quote + 1], np.frombuffer(b"stmd", np.uint8))]
        two = padded[quote + 1] * np.uint16(256) + padded[quote + 2]
        long = quote[np.isin(two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~heads[quote + 2]]
        cuts[short + 1] = cuts[long + 1] = False
        cuts[short + 2] = cuts[long + 3] = True
        return cuts[:n]

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each piece's ids begin, how many it has, and the ids of all."""
        long = pc.greater(pc.binary_length(pieces), LONG_PIECE)
        raw, at = _strings(pieces.filter(pc.invert(long)))
        merged = []
        for a in range(0, len(at) - 1, MERGED_PIECES):
            part = at[a : a + MERGED_PIECES + 1]
            merged.append(self.merge(raw[part[0] : part[-1]], part - part[0]))
        alone = [np.array([t.id for t in self.model.tokenize(p.decode().translate(self.mapped))], np.uint16) for p in pieces.filter(long).to_pylist()]
        ids = np.concatenate([*(x for x, _ in merged), *alone, np.zeros(0, np.uint16)])
        sizes = np.concatenate([*(x for _, x in merged), np.array([len(x) for x in alone], np.int32)])
        # The short ones come first here; back to the order given.
        place = np.argsort(np.argsort(long.to_numpy(zero_copy_only=False), kind="stable"), kind="stable") if alone else slice(None)
        return (np.cumsum(sizes, dtype=np.int32) - sizes)[place], sizes[place], ids

    def _word_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has."""
        raw, at = _strings(words)
        cuts = self._cuts(raw, at)
        borders = np.append(np.flatnonzero(cuts), len(raw)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(raw)]).dictionary_encode()
        first, size, ids = self._piece_ids(coded.dictionary)
        number = coded.indices.to_numpy()
        ids, ends = _gather(ids, first[number], size[number])
        return ids, np.diff(ends[np.concatenate([[0], np.cumsum(cuts)])[at]])

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u2")

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (unsigned 16-bit) of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _NOT_PLAIN)
        words = pc.utf8_split_whitespace(pc.utf8_lower(texts.filter(pc.invert(odd))))
        flat = pc.list_flatten(words)
        coded = flat.dictionary_encode()
        words_ids, size = self._word_ids(coded.dictionary)
        first = np.cumsum(size, dtype=np.int32) - size
        number = coded.indices.to_numpy()
        ids, ends = _gather(words_ids, first[number], size[number])
        borders = ends[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())]).astype(np.int64)]
        plain = iter([ids[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)])
        return [self.encode_whole(texts[i].as_py()) if o else next(plain) for i, o in enumerate(odd.to_pylist())]


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes in ``column``."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(total, np.arange(limit, total[-1], limit), "right"), [batch.num_rows]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def worker_tokenizer(path: str) -> WordTokenizer:
    """This worker's tokenizer, loaded once and kept from one task to the next."""
    kept = worker_memory("tokenizer")
    if path not in kept:
        kept[path] = WordTokenizer(path)
    return kept[path]


def token_table(docs: DataFrame, *, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table (id, ``_part``, ``_local``, ``_n``, ``_ids``): each document's ids and ``end_id``.

    ``_ids`` holds little-endian unsigned 16-bit ids (the vocabulary has under 65,536), ``_local`` the
    ids before it in its partition ``_part``. Null text is empty and has ``end_id`` alone.
    """
    kind = docs.schema[id_col].dataType
    if end_id >= 1 << 16:
        raise ValueError("ids must fit 16 bits")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, local, tok = TaskContext.get().partitionId(), 0, worker_tokenizer(tokenizer_path)
        if tok.full.get_vocab_size() > 1 << 16:
            raise ValueError("ids must fit 16 bits")
        end = end_id.to_bytes(2, "little")
        for whole in batches:
            for batch in by_bytes(whole, 1, TEXT_SLICE):
                packed = [ids.tobytes() + end for ids in tok.encode_many(batch.column(1))]
                counts = np.array([len(p) // 2 for p in packed], np.int64)
                starts = local + np.cumsum(counts) - counts
                local += int(counts.sum())
                columns = [batch.column(0), pa.array(np.full(len(packed), part, np.int64)), pa.array(starts), pa.array(counts), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "_part", "_local", "_n", "_ids"])
                del batch, columns, packed
                pa.default_memory_pool().release_unused()

    schema = f"{id_col} {kind.simpleString()}, _part long, _local long, _n long, _ids binary"
    with small_batches(docs.sparkSession):
        return materialise(docs.select(id_col, text_col).mapInArrow(encode, schema), "tokens", "zstd")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``_start``, the ids before a document in the whole corpus.

    Pass one summed the partitions; here their totals' prefix sums (one row per partition, written so
    that Spark knows their size) are joined back.
    """
    totals = tokens.groupBy("_part").agg(F.sum("_n").alias("_total"))
    before = materialise(block_offsets(totals, "_part", "_total"), "offsets")
    return tokens.join(before, "_part").withColumn("_start", F.col("before") + F.col("_local")).drop("before")


def cut_pieces(tokens: DataFrame, length: int, *, id_col: str = "doc_id") -> DataFrame:
    """Each document's ids cut where a window of ``length`` ids ends in the global order.

    Returns id, ``start`` (ids of the document before the piece), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence) and ``ids`` (little-endian unsigned 32-bit). A
    document over a boundary has a record on either side.
    """
    kind = tokens.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, 3):
                rows, cols = [], [[] for _ in range(6)]
                for i, (at, n, raw) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                    ids, done = np.frombuffer(raw, "<u2").astype("<u4"), 0
                    while done < n:
                        seq, off = divmod(at + done, length)
                        size = min(n - done, length - off)
                        rows.append(i)
                        for col, value in zip(cols, (done, size, n, seq, off, ids[done : done + size].tobytes()), strict=True):
                            col.append(value)
                        done += size
                arrays = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"{id_col} {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return with_offsets(tokens).select(id_col, "_start", "_n", "_ids").mapInArrow(cut, schema)
