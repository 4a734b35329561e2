"""Sum-of-squares online packing of tokenised documents into fixed windows.

Within a partition documents arrive one by one. A document fills whole windows while it can; its
remainder goes to the partially filled window level that minimises the sum of squared counts of
partially filled windows, which needs only the level array: placing ``n`` tokens at level ``h`` changes
the sum by ``2 * (counts[h + n] - counts[h]) + 2`` (a new window has no ``h`` term, a full one no
``h + n`` term). When a partition ends, its open windows are poured together into full ones, and the
last one is cut into sequences whose lengths are powers of two, which need no padding.

No shuffle: each input partition is packed by itself, so a retried task repeats its own output.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import kept_by_worker, lean, table, trim

WINDOW = 2048
END_OF_DOCUMENT = 1
VOCABULARY = "byte_bpe_50k.json"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Texts encoded together.
TOGETHER = 256
#: The pre-token pattern that the byte-level step of a tokenizer file stands for (a fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space so long that the quick encoder's pattern would exhaust its stack.
_LONG_SPACE = re.compile(r"\s{20000}")


def byte_names() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 characters are themselves, the others follow from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def quick_encoder(spec: dict):
    """A merge-rank encoder with the ids of the tokenizer file ``spec``, or None where that file asks for more.

    It gives the same ids where the model is plain byte-level pair merging: no normaliser, the standard
    pre-tokens, and merges whose results are numbered in the order of the merges.
    """
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    )
    if not plain:
        return None
    special = {t["content"] for t in spec.get("added_tokens", ())}
    vocabulary, names = model["vocab"], byte_names()
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    ranks = {bytes(names[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or len(ranks) != 256 + len(merged):
        return None
    import tiktoken

    return tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """``tokenizers`` ids of whole texts as little-endian uint32 arrays.

    Texts go through ``quick_encoder``; those that hold an added token's string or an immense run of
    white space, and all of a file that the quick encoder does not cover, go through ``tokenizers``
    itself. Nothing that grows with the texts is kept.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.added = path, [t["content"] for t in spec.get("added_tokens", ())]
        self.quick, self.whole = quick_encoder(spec), None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if self.whole is None:
            from tokenizers import Tokenizer

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            self.whole = Tokenizer.from_file(self.path)
        return [np.array(e.ids, "<u4") for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return self.quick is not None and not any(a in text for a in self.added) and (len(text) < 20_000 or not _LONG_SPACE.search(text))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self._plain(t) for t in texts]
        others = iter(self._whole([t for t, p in zip(texts, plain, strict=True) if not p]))
        return [np.array(self.quick.encode_ordinary(t), "<u4") if p else next(others) for t, p in zip(texts, plain, strict=True)]


_encoders: dict[str, Encoder] = {}
kept_by_worker.append(_encoders.clear)


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Packs one partition; ``rows`` collects (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.counts = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: windows as lists of pieces
        self.rows: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total // w * w
        for start in range(0, whole, w):
            self._emit([(doc, start, ids[start : start + w], total)])
        n = total - whole
        if not n:
            return
        piece = (doc, whole, ids[whole:].copy(), total)
        # change[h]: of the sum of squares if the piece joins level h; level 0 opens a window.
        change = 2 * (self.counts[n : w + 1] - self.counts[: w - n + 1]) + 2
        change[0] = 2 * self.counts[n] + 1
        change[w - n] = 1 - 2 * self.counts[w - n] if n < w else 0
        usable = self.counts[: w - n + 1] > 0
        usable[0] = True
        h = int(np.argmin(np.where(usable, change, np.iinfo(np.int64).max)))
        pieces = self.open[h].pop() if h else []
        pieces.append(piece)
        if h:
            self.counts[h] -= 1
        if h + n == w:
            self._emit(pieces)
        else:
            self.counts[h + n] += 1
            self.open[h + n].append(pieces)

    def close(self) -> None:
        """Pour the open windows together; cut the tail at powers of two."""
        tail, size = [], 0
        for level in range(self.window - 1, 0, -1):
            for pieces in self.open[level]:
                for piece in pieces:
                    tail.append(piece)
                    size += len(piece[2])
                while size >= self.window:
                    tail, size = self._cut(tail, self.window), size - self.window
            self.open[level] = []
        while size:
            n = 1 << (size.bit_length() - 1)
            tail, size = self._cut(tail, n), size - n
        self.counts[:] = 0

    def _cut(self, pieces: list, n: int) -> list:
        """Emit the first ``n`` tokens of ``pieces`` as a sequence and return the rest."""
        head, at = [], 0
        for i, (doc, start, ids, total) in enumerate(pieces):
            take = min(n - at, len(ids))
            head.append((doc, start, ids[:take], total))
            at += take
            if at == n:
                rest = [(doc, start + take, ids[take:], total)] if take < len(ids) else []
                self._emit(head)
                return rest + pieces[i + 1 :]
        raise ValueError("fewer tokens than asked for")

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pack(documents: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Return one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Needs doc_id and text. A document is its token ids followed by id 1; null and empty texts are the
    id 1 alone. Each id lies in exactly one piece; pieces fill a sequence gapless from offset 0; a
    sequence has at most ``window`` tokens and fewer only at a power of two, so that nothing is padded.
    Repeated rows are packed each by themselves; a null doc_id stays null; an empty table gives an
    empty result; other columns are ignored. Texts are tokenised whole, however long.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer_path)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        end = np.asarray([END_OF_DOCUMENT], "<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                found = encode([t or "" for t in part.column(1).to_pylist()])
                for doc, ids in zip(part.column(0).to_pylist(), found, strict=True):
                    packer.add(doc, np.concatenate([ids, end]))
                if len(packer.rows) >= 20_000:
                    yield packer.take(schema)
        packer.close()
        yield packer.take(schema)
        trim()

    return lean(documents).select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, SCHEMA)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
