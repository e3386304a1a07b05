"""Sum-of-squares online packing of tokenized documents into fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cuts a text where every byte-level pre-tokenizer of this family cuts: before a run of these white space characters.
UNIT = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Letters and marks of long-settled scripts, of which no class changed between Unicode versions. A text with any other
#: character, or with white space that joins such runs, is encoded whole by the tokenizer itself.
UNSETTLED = re.compile(
    r"[^\t\n\r\x20-\x7e\xa1-\u021f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0482\u048a-\u04ff\u05d0-\u05ea\u0621-\u063a\u0641-\u064a"
    r"\u0e01-\u0e2e\u2010-\u2027\u2030-\u205e\u20a0-\u20b1\u3001-\u3003\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\uff01-\uff5e]"
)
SETTLED_ASCII = bytes(c for c in range(128) if not UNSETTLED.search(chr(c)))
#: Fixed value: the pieces within which byte-level vocabularies merge.
PRE_TOKEN = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SCHEMA = "id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class KnownUnits(dict):
    """Ids by unit, learned when a unit is first looked up; at the bound the memory starts anew."""

    def __init__(self, most: int, learned):
        self.most, self.learned = most, learned

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        ids = self[unit] = self.learned(unit)
        return ids


class UnitEncoder:
    """Token ids of texts by a byte-level vocabulary file of `tokenizers`.

    Units repeat, so each is encoded once and kept, up to a bound; then the memory starts anew. Where the file is plain
    byte-level with its merges in the order of their ids, units are merged by tiktoken's core from the same file, which
    gives the same ids sooner; other files, and texts with rarer characters or with literals of added tokens, go to the
    tokenizer itself.
    """

    def __init__(self, tokenizer_path: str | None = None, most: int = 400_000):
        from tokenizers import Tokenizer

        if tokenizer_path is None:
            import public_tokenizers

            tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(str(tokenizer_path))
        self.added = added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # literals of added tokens are cut out of a text before anything else
        self.whole = re.compile("|".join([UNSETTLED.pattern, *(re.escape(x) for x in sorted(added, key=len, reverse=True))]))
        self.most = most
        self.merge = self.merger(str(tokenizer_path))
        self.known = KnownUnits(most, self.merged)

    @staticmethod
    def merger(path: str):
        import tiktoken

        from siltstone.llm.token_counts import byte_alphabet

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before = whole["model"], whole.get("pre_tokenizer") or {}
        if whole.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        alphabet, vocab = byte_alphabet(), model["vocab"]
        merges = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        if [vocab.get(m) for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(alphabet[c] for c in p): k for p, k in vocab.items() if k < 256 + len(merges)}
        return tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def merged(self, unit: str) -> bytes:
        if unit.isalpha() or unit[0] == " " and unit[1:].isalpha():
            ids = self.merge(unit.encode())
        else:
            ids = [i for piece in PRE_TOKEN.findall(unit) for i in self.merge(piece.encode())]
        return array("I", ids).tobytes()

    def learn(self, units: list[str]) -> None:
        """For the tokenizer itself: the units not known yet, many at a time."""
        missing = list({u for u in units if u not in self.known})
        if len(self.known) + len(missing) > self.most:
            self.known.clear()
            missing = list(set(units))
        for at in range(0, len(missing), 4096):
            part = missing[at : at + 4096]
            for u, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.known[u] = array("I", e.ids).tobytes()

    def plain(self, text: str) -> bool:
        """Whether no character is unsettled and no added token is spelled out."""
        if text.isascii():
            return not text.encode().translate(None, SETTLED_ASCII) and not any(x in text for x in self.added)
        return not self.whole.search(text)

    def encode(self, text: str) -> np.ndarray:
        if not self.plain(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        units = UNIT.findall(text)
        if self.merge is None:
            self.learn(units)
        return np.frombuffer(b"".join(map(self.known.__getitem__, units)), np.uint32)


@lru_cache(maxsize=1)
def encoder_of(tokenizer_path: str | None) -> UnitEncoder:
    """One encoder a worker process: its later tasks find the vocabulary read and the common units known."""
    return UnitEncoder(tokenizer_path)


class SumOfSquaresPacker:
    """Places items of 1..size-1 tokens so that the sum over fill levels of (number of open windows there)^2 stays least.

    counts is the level array; an open window keeps its items until it is full. With most_open windows open, an item
    that would open another one is cut instead: its head fills the fullest open window, and its rest is placed by the
    same rule. drain() cuts what is left open at the end into full windows, so at most one window of a packer is not full.
    """

    def __init__(self, size: int, first_window: int = 0, most_open: int = 4096):
        self.size, self.next, self.most_open = size, first_window, most_open
        self.counts = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.n_open = 0

    def whole(self, item) -> tuple:
        self.next += 1
        return self.next - 1, 0, item

    def best_level(self, length: int) -> int:
        """The fill level (0: a new window) at which an item of this length leaves the least sum of squares."""
        levels = np.flatnonzero(self.counts[: self.size - length + 1])
        levels = np.concatenate((levels[levels > 0], [0]))
        to = levels + length
        closes = to == self.size
        change = np.where(levels > 0, 1 - 2 * self.counts[levels], 0) + np.where(closes, 0, 1 + 2 * self.counts[np.where(closes, 0, to)])
        return int(levels[change == change.min()].max())

    def place(self, item, length: int, pick: int) -> list[tuple]:
        if pick:
            window = self.open[pick].pop()
            self.counts[pick] -= 1
        else:
            window = []
            self.n_open += 1
        window.append((item, length))
        level = pick + length
        if level == self.size:
            self.n_open -= 1
            return self.emit(window)
        self.open.setdefault(level, []).append(window)
        self.counts[level] += 1
        return []

    def add(self, item, length: int) -> list[tuple]:
        """Rows (window, offset, item) of the windows that became full."""
        pick = self.best_level(length)
        rows: list[tuple] = []
        while not pick and self.n_open >= self.most_open:
            doc, start, ids, total = item
            fullest = int(np.flatnonzero(self.counts)[-1])
            take = min(self.size - fullest, length)
            rows += self.place((doc, start, ids[:take], total), take, fullest)
            item, length = (doc, start + take, ids[take:], total), length - take
            if not length:
                return rows
            pick = self.best_level(length)
        return rows + self.place(item, length, pick)

    def emit(self, window: list) -> list[tuple]:
        rows, at = [], 0
        for item, length in window:
            rows.append((self.next, at, item))
            at += length
        self.next += 1
        return rows

    def drain(self) -> list[tuple]:
        """Fill up open windows by cutting: the fullest windows first, each completed from the emptiest."""
        left = list(chain.from_iterable(w for level in sorted(self.open, reverse=True) for w in self.open[level]))
        self.open.clear()
        self.counts[:] = 0
        self.n_open = 0
        rows: list[tuple] = []
        window: list = []
        level = 0
        for (doc, start, ids, total), length in left:
            at = 0
            while at < length:
                take = min(length - at, self.size - level)
                window.append(((doc, start + at, ids[at : at + take], total), take))
                at, level = at + take, level + take
                if level == self.size:
                    rows += self.emit(window)
                    window, level = [], 0
        return rows + self.emit(window) if window else rows


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, tokenizer_path: str | None = None
) -> DataFrame:
    """Pieces (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset) covering every token of every document once.

    A null or empty text is its end token alone. Whole windows are cut from a document's start; its rest is placed
    online by the sum-of-squares rule. Each input partition packs its own windows (ids carry the partition's number),
    so there is no shuffle and at most one window a partition is not full. Repeated rows are packed again; an empty
    table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path)
        packer = SumOfSquaresPacker(size, TaskContext.get().partitionId() << 36)
        id_type = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total = zip(*(item for _, _, item in rows), strict=True) if rows else ((), (), (), ())
            columns = [
                start, [len(x) for x in ids], [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids],
                total, [w for w, _, _ in rows], [o for _, o, _ in rows],
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(doc, id_type), *(pa.array(c, pa.int64()) for c in columns)], names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id))
                full = len(ids) // size * size
                for at in range(0, full, size):
                    rows.append(packer.whole((doc, at, ids[at : at + size], len(ids))))
                if full < len(ids):
                    rows += packer.add((doc, full, ids[full:].copy(), len(ids)), len(ids) - full)
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
            yield table(rows)
        if id_type is not None:
            yield table(packer.drain())

    kind = docs.schema[id_col].dataType.simpleString()
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA.format(kind=kind))
    return packed.withColumnRenamed("id", id_col)
