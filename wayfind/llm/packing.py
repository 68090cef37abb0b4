"""Best-fit packing of tokenized documents into sequences, by minimum bin slack over the histogram of piece lengths.

A piece is at most `capacity` tokens, so there are at most `capacity` different lengths however many pieces: their counts
are all that the driver needs. For one bin at a time the driver takes the longest length left and finds, by bitset
subset-sum dynamic programming over the lengths left, the fullest combination with it; that pattern then fills as many
bins as the counts allow. Each pattern uses a length up, so there are at most `capacity` patterns of at most 63 different
lengths at capacity 2048. Pieces get their places from their rank within their length, found in salted groups.
"""

from __future__ import annotations

import contextlib
import json
import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfind.llm.common import Scratch, slices, tidy

#: Bytes of text whose words are looked up together.
TOKEN_BYTES = 4 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The shape of a tokenizer whose texts WordTokenizer may take apart, as its file states it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _kind(byte: int) -> int:
    """0 white space, 1 ASCII letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 within a character, 6 first of U+00C0 to U+027F, 7 other non-ASCII."""
    if byte in b" \t\n\r\x0b\x0c":
        return 0
    if byte < 0x80:
        return 1 if chr(byte).isalpha() else 2 if chr(byte).isdigit() else 3 if byte == 39 else 4
    return 5 if byte < 0xC0 else 6 if 0xC3 <= byte < 0xCA else 7


def _parts(before: int, here: int) -> int:
    """Whether a pre-token surely starts at a byte, by its kind and that of the one before: 1 yes, 0 no, 2 if a letter is before.

    No alternative of SPLIT goes on from a letter to anything else, none but the contractions goes on from other ASCII to
    a letter, and a digit is always alone. No character composes with ASCII after it.
    """
    if not here or here > 4:
        return int(here > 0 and not before)
    if not before or here == 2 or before == 2:
        return 1
    if here in (3, 4):
        return 1 if before == 1 else 2 if before == 5 else 0
    return int(before == 4)


class WordTokenizer:
    """Token ids of texts from those of their pre-tokens, which are kept.

    Exact for tokenizers of the shape of NORMALIZER and PRE_TOKENIZER with word ends, as word_bpe_49k is; that is checked
    on loading, and every other tokenizer encodes whole texts, as do texts with the string of a special token. A slice
    of texts is cut at all places where a pre-token surely starts; each distinct piece is looked up once.
    """

    KIND = bytes(_kind(i) for i in range(256))
    PARTS = bytes(_parts(i >> 3, i & 7) if i < 64 else 0 for i in range(256))
    #: In U+00C0 to U+027F but no letters, the last one once in lower case.
    NO_LETTER = np.array([int.from_bytes(x.encode(), "big") for x in "×÷İ"])

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.many = tok.encode_batch_fast
        self.special = [t["content"].lower().encode() for t in spec["added_tokens"]]
        plain = all(t["content"].isascii() and len(t["content"].split()) == 1 and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"])
        same = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["truncation"] is spec["padding"] is None
        self.by_words = plain and same and spec["model"]["type"] == "BPE" and spec["model"]["end_of_word_suffix"] == "</w>" and not spec["model"]["dropout"]
        if self.by_words:
            self.ends = np.zeros(tok.get_vocab_size(), dtype=bool)
            self.ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
            # letters in lower case are one pre-token each, and need no more than to be parted
            letters = Tokenizer.from_file(path)
            letters.normalizer = normalizers.Sequence([])
            letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.letters = letters.encode_batch_fast
            ascii_ = Tokenizer.from_file(path)
            ascii_.normalizer, ascii_.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
            self.ascii = ascii_.encode_batch_fast
        # pieces seen lately, and those before them: common ones stay, rare ones go after a while
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.most = most

    def _words(self, words: list[bytes], text: str, encode) -> list[bytes]:
        """Learn words of letters from one text that has them in order; returns them if their ids can't be told apart."""
        ids = np.asarray(encode([text], add_special_tokens=False)[0].ids, dtype="<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(words) or stops[-1] != len(ids):
            return words
        raw, stops = ids.tobytes(), (4 * stops).tolist()
        self.known.update(zip(words, map(raw.__getitem__, map(slice, [0, *stops], stops))))
        return []

    def _learn(self, pieces: list[bytes]) -> None:
        plain, latin, others = [], [], []
        for w in pieces:
            (plain if w.isalpha() else latin if _latin(w) else others).append(w)
        for at in range(0, len(plain), 5_000):
            part = plain[at : at + 5_000]
            others += self._words(part, b" ".join(part).decode(), self.ascii)
        for at in range(0, len(latin), 5_000):
            part = latin[at : at + 5_000]
            others += self._words(part, b" ".join(part).decode().lower(), self.letters)
        for at in range(0, len(others), 5_000):
            part = others[at : at + 5_000]
            for w, e in zip(part, self.many([w.decode() for w in part], add_special_tokens=False)):
                self.known[w] = np.asarray(e.ids, dtype="<u4").tobytes()

    def _pieces(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct pieces of texts, the place among them of every piece in order, and how many pieces are before the end of each text."""
        blob = b"\n".join([b"", *texts]).lower()  # ASCII letters alone
        kinds = np.frombuffer(blob.translate(self.KIND), np.uint8)
        pairs = np.frombuffer(((kinds[:-1] << 3) | kinds[1:]).tobytes().translate(self.PARTS), np.uint8)
        data = np.frombuffer(blob, np.uint8)[1:]
        unsure = np.flatnonzero(pairs == 2)
        starts = pairs == 1
        if len(unsure):
            two = data[unsure - 2].astype(np.int64) << 8 | data[unsure - 1]
            starts[unsure] = (kinds[unsure - 1] == 6) & ~np.isin(two, self.NO_LETTER)
        held = kinds[1:] != 0
        packed = data[held]
        offsets = np.append(np.flatnonzero(starts[held]), len(packed)).astype(np.int32)
        column = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
        ends = np.cumsum([len(x) + 1 for x in texts]) - 1
        return column.dictionary.to_pylist(), np.asarray(column.indices), np.searchsorted(np.flatnonzero(starts), ends)

    def _whole(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        ids = [[*self.many([x.decode()], add_special_tokens=False)[0].ids, end] for x in texts]
        return np.array([i for x in ids for i in x], dtype="<u4"), np.cumsum([0, *map(len, ids)])

    def ids(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, each followed by `end`, and where each text's start (one more entry at the end)."""
        if not self.by_words:
            return self._whole(texts, end)
        marked = [i for i, x in enumerate(texts) if b"<" in x and any(s in x.lower() for s in self.special)]
        if marked:
            parts, at = [], 0
            for i in [*marked, len(texts)]:
                parts += [self.ids(texts[at:i], end)] if i > at else []
                parts += [self._whole(texts[i : i + 1], end)] if i < len(texts) else []
                at = i + 1
            sizes = [np.diff(o) for _, o in parts]
            return np.concatenate([t for t, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        pieces, places, before = self._pieces(texts)
        if len(self.known) > self.most:
            self.known, self.older = {}, self.known
        known = self.known
        got = list(map(known.get, pieces))
        holes = _places(got)
        if holes:
            new, older = [], self.older
            for i in holes:
                w = pieces[i]
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
            self._learn(new)
            for i in holes:
                got[i] = known[pieces[i]]
        got.append(int(end).to_bytes(4, "little"))
        flat = np.frombuffer(b"".join(got), "<u4")
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        first = np.cumsum(size) - size
        places = np.insert(places, before, len(got) - 1)
        lengths = size[places]
        stops = np.cumsum(lengths)
        tokens = flat[np.repeat(first[places] - stops + lengths, lengths) + np.arange(stops[-1])]
        return tokens, np.concatenate([[0], stops[before + np.arange(len(texts))]])


def _latin(word: bytes) -> bool:
    """Whether a piece is letters of ASCII and U+00C0 to U+027F, which lower-case and compose one by one, alone."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0280" and not any(c in text for c in "İªµº")


def _places(items: list) -> list[int]:
    """Where None is."""
    out, at = [], -1
    with contextlib.suppress(ValueError):
        while True:
            at = items.index(None, at + 1)
            out.append(at)
    return out


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    """One for each Python worker, whose words outlive its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if kept) of every piece of every row: ids of its text, then end_id, cut after each `capacity` tokens."""

    def cut(batches):
        tok = tokenizer_at(tokenizer)
        for part, texts in slices(batches, "text", TOKEN_BYTES):
            tokens, offsets = tok.ids(texts, end_id)
            sizes = np.diff(offsets)
            pieces = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(texts)), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            raw = memoryview(tokens.tobytes())
            at = 4 * (offsets[doc] + start)
            cuts = list(map(slice, at.tolist(), (at + 4 * length).tolist()))
            crc = np.fromiter((zlib.crc32(raw[x]) for x in cuts), np.int64, len(cuts))
            columns = [part.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), *map(pa.array, (start, length, crc))]
            columns += [pa.array([bytes(raw[x]) for x in cuts], pa.binary())] if keep_ids else []
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(cut), schema)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the multisets of lengths within counts, one of the largest sum up to room; prefers long lengths."""
    lengths = sorted(x for x, c in counts.items() if c and x <= room)
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        bits, left, step = reach[-1], min(counts[x], room // x), 1
        while left:
            step = min(step, left)
            bits |= (bits << (x * step)) & mask
            left -= step
            step *= 2
        reach.append(bits)
    sums, out = reach[-1].bit_length() - 1, {}
    for i in range(len(lengths), 0, -1):
        x, most = lengths[i - 1], min(counts[lengths[i - 1]], sums // lengths[i - 1])
        for n in range(most, -1, -1):
            if reach[i - 1] >> (sums - n * x) & 1:
                break
        if n:
            out[x] = n
            sums -= n * x
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, copies of each length in one) until all pieces are placed."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        first = max(counts)
        rest = dict(counts)
        rest[first] -= 1
        bin_ = fullest(rest, capacity - first)
        bin_[first] = bin_.get(first, 0) + 1
        times = min(counts[x] // n for x, n in bin_.items())
        out.append((times, bin_))
        for x, n in bin_.items():
            counts[x] -= times * n
            if not counts[x]:
                del counts[x]
    return out


def slots(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows of (first rank, copies in a bin, first sequence, offset in the bin), by first rank."""
    used: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for times, bin_ in patterns(counts, capacity):
        offset = 0
        for x in sorted(bin_, reverse=True):
            out.setdefault(x, []).append((used.get(x, 0), bin_[x], sequence, offset))
            used[x] = used.get(x, 0) + times * bin_[x]
            offset += x * bin_[x]
        sequence += times
    return {x: np.asarray(v, dtype=np.int64) for x, v in out.items()}


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 250) -> DataFrame:
    """Every row of pieces (written beforehand: they are read three times) with sequence_id and offset.

    The n pieces of one length are ranked in groups of about max(group_rows, sqrt(n)), so that neither a group nor the
    list of a length's groups holds more than that.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    table = spark.sparkContext.broadcast(slots(counts, capacity))  # bounded with the capacity
    salts = [math.ceil(counts.get(x, 0) / max(group_rows, math.isqrt(counts.get(x, 0)))) for x in range(1, capacity + 1)]
    salts = F.element_at(F.lit(salts), F.col("length").cast("int"))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    sizes = salted.groupBy("length", "_salt").count()
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(order)).join(firsts, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_rank") - 1 + F.col("_first")).alias("_rank"))

    def place(batches):
        by = table.value
        for batch in batches:
            length = np.asarray(batch.column(batch.schema.get_field_index("length")))
            rank = np.asarray(batch.column(batch.schema.get_field_index("_rank")))
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, rows = length == x, by[int(x)]
                r = rank[own]
                first, copies, sequence, offset = rows[np.searchsorted(rows[:, 0], r, side="right") - 1].T
                seq[own] = sequence + (r - first) // copies
                off[own] = offset + (r - first) % copies * x
            arrays = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(seq), pa.array(off)], [n for n in batch.schema.names if n != "_rank"] + ["sequence_id", "offset"])

    fields = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return ranked.mapInArrow(tidy(place), f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if kept).

    A null or empty text is the end id alone. Null ids stay null. Rows that repeat are documents of their own. An empty
    table gives no rows. Columns other than doc_id and text are ignored. Pieces of one length are interchangeable, so
    which of them shares a sequence with which depends only on ids and contents.
    """
    scratch = Scratch(docs.sparkSession, "packing", docs)
    return pack(scratch.keep(tokenize_pieces(docs, tokenizer, capacity, end_id, keep_ids), "pieces"), capacity)
