"""Packing tokenised documents into fixed-length sequences by sum of squares.

Tokenising is cached: this vocabulary's pre-tokens never cross white space, so a
text's ids are its pre-tokens' ids in a row.  Pieces are then dealt to
groups of about GROUP pieces by a hash, and every group is
packed on its own, so no task's work grows with the table.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import text_blocks, worker_state
from .runtime import materialize

GROUP = 4096
CACHE_UNITS = 250_000
CACHE_UNIT_CHARS = 40
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Characters whose normal form, case and kind need no tables; a text of these is split here.
PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
#: The vocabulary's pre-tokens over those characters in lower case.
BLANK = re.compile(r"[\t-\r ]")
PRE_TOKEN = re.compile(r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte: itself if printable, else the next after 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


#: Texts on which a vocabulary must give, by pre-tokens, what its whole tokenizer gives; else that is asked for every word.
PROBES = (
    "The QUICK brown fox's tail, they'll say; we've 12345 (and 6.7e-8)!", "don't I'D you're  it'S\t\ttabs\r\nand  lines\x0b\x0c",
        "Über café naïve Ætna ØRE ÿ ß ÞORN", "a_b-c/d\\e==f!!?? ...--- 'tis '' ' s",
    "x" * 300, "0 00 1234567890", " lead and trail ", "mixedÉÈcase1Ñ2ö3", "$#@%^&*()[]{}<>|~`", "")


def segments(text: str, most: int = 1 << 20):
    """The text in parts of about ``most`` characters, cut before white space, which no pre-token crosses."""
    a = 0
    while len(text) - a > 2 * most:
        m = BLANK.search(text, a + most)
        if m is None:
            break
        yield text[a : m.start()]
        a = m.start()
    yield text[a:]


class Encoder:
    """Packed ids (little-endian, 32 bits) of texts, cached by pre-token or by word.

    Texts of PLAIN characters without a special token's mark are split into
    pre-tokens, and the vocabulary's model is asked for new ones alone.  In
    other texts new words go through the whole tokenizer.  A full cache becomes
    the old one; what is used again moves on from there.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.long: list[str] = []
        self.cache, self.old = Units(self), Units(self)
        self.plain = True
        self.plain = all(self.encode([t])[0] == self.whole(t) for t in PROBES)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ask(self, unit: str) -> bytes:
        """A pre-token is a str of its own; a word of another text begins with a blank."""
        if unit[:1] == " ":
            return self.whole(unit[1:])
        shown = unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def units(self, text: str) -> list[str]:
        if self.plain and "<|" not in text and PLAIN.fullmatch(text):
            return PRE_TOKEN.findall(text.lower())
        return [" " + w.decode() for w in text.encode().split()]

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.cache) > CACHE_UNITS:
                self.cache, self.old = Units(self), self.cache
            out.append(b"".join([b"".join(map(self.cache.__getitem__, self.units(part))) for part in segments(text)]))
        for u in self.long:
            self.cache.pop(u, None)
        self.long.clear()
        return out


class Units(dict):
    """Packed ids by unit; a new unit comes from the old cache or is asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, unit: str) -> bytes:
        found = dict.get(self.encoder.old, unit)
        if found is None:
            found = self.encoder.ask(unit)
        self[unit] = found
        if len(unit) > CACHE_UNIT_CHARS:
            self.encoder.long.append(unit)
        return found


def worker_encoder(path: str) -> Encoder:
    state = worker_state()
    if state.get("vocabulary") != path:
        state.update(vocabulary=path, encoder=Encoder(path))
    return state["encoder"]


def token_pieces(documents: DataFrame, sequence: int, end_id: int, vocabulary: str | None) -> DataFrame:
    """PIECES of every row of (doc_id, text): its ids, ``end_id`` last, cut at ``sequence`` ids."""
    last = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = worker_encoder(vocabulary or default_vocabulary())
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for row, buf, offsets in text_blocks(batch.column("text"), 1 << 20):
                data = buf.tobytes()
                out = []
                for i, packed in enumerate(encoder.encode([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]), row):
                    packed += last
                    for k in range(0, len(packed) // 4, sequence):
                        part = packed[4 * k : 4 * (k + sequence)]
                        out.append((ids[i], k // sequence, k, len(part) // 4, zlib.crc32(part)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and offsets of items packed in the given order.

    An item goes where the sum over gaps of (open bins with that gap) squared
    becomes smallest; a full bin counts no more.  Ties go to the smallest gap.
    A bin is opened if that sum says so and the total still asks for more bins,
    or if the item fits nowhere.
    """
    lengths = np.asarray(lengths, np.int64)
    wanted = -(-int(lengths.sum()) // capacity) if len(lengths) else 0
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count, never = 0, np.iinfo(np.int64).max
    for i, a in enumerate(lengths.tolist()):
        here = open_bins[a:capacity]
        change = np.where(here > 0, 2 * (open_bins[: capacity - a] - here) + 2, never)
        if a < capacity and here[0] > 0:
            change[0] = 1 - 2 * here[0]
        k = int(np.argmin(change)) if len(change) else 0
        best = int(change[k]) if len(change) else never
        fresh = 2 * int(open_bins[capacity - a]) + 1 if a < capacity else 0
        if best == never or (fresh < best and count < wanted):
            b, gap, count = count, capacity, count + 1
        else:
            gap = a + k
            b = stacks[gap].pop()
            open_bins[gap] -= 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > a:
            stacks[gap - a].append(b)
            open_bins[gap - a] += 1
    return bins, offsets


def pack_documents(documents: DataFrame, sequence: int = 4096, end_id: int = 1, vocabulary: str | None = None) -> DataFrame:
    """Place of every document's token pieces in sequences of at most ``sequence`` ids.

    Input (doc_id, text), other columns are ignored.  Each row's ids (a null
    text has none) end with ``end_id``; only rows with more than ``sequence``
    ids are cut.  Returns PIECES with sequence_id and offset: the pieces of a
    sequence follow each other from offset 0 without a gap.  Rows that repeat a
    doc_id, or have a null one, are packed one by one like any other.  An empty
    table gives an empty table.  ``vocabulary`` is a tokenizer file of a kind
    whose tokens do not cross white space.
    """
    pieces = materialize(token_pieces(documents, sequence, end_id, vocabulary), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    # the row's number keeps rows that repeat apart; it comes from the written table, so a task done again gives it again
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "length", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = sum_of_squares(table.column("length").to_numpy(), sequence)
        first = table.column("grp")[0].as_py() << 32
        return table.drop_columns(["grp"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("grp").applyInArrow(pack, f"{PIECES}, sequence_id long, offset long")
