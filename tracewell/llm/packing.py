"""Vector bin packing of tokenised examples into training sequences.

Every example is a vector of three sizes: tokens, segments (one for each piece placed), and loss-bearing tokens (those
after its prompt). A sequence has a limit on each. Sequences are filled one at a time: of the examples waiting, the one
with the largest dot product between its vector and what is left of the sequence (both as shares of the limits) is
placed whole; when none fits whole, a piece is cut off the one that takes up most of what is left. A sequence
that has to be closed short of the token limit is cut back to a power of two and the rest of its tokens go on waiting,
so that nothing is padded at all.

Work is split by the partitions of the input: a task packs what it reads, holding at most ``POOL`` examples or
``POOL_TOKENS`` tokens (or the one example it has just read), so memory follows neither the partition's nor the table's
size. Recovery is Spark's own: the stage has no shuffle before it, and a task that is run again reads and packs the same rows.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import groups, n_words

CAPACITY, MAX_SEGMENTS, MAX_LOSS, END_ID = 4096, 64, 4064, 2
POOL, POOL_TOKENS = 512, 1 << 20
CACHED, CACHED_CHARS, TOGETHER = 400_000, 48, 200
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of whole texts. Runs of letters and runs of other characters are encoded once and kept.

    The vocabulary's pre-tokeniser drops white space and never joins letters with anything else, so the ids of a text
    are those of its runs one after the other; only an apostrophe can tie runs together ("it's"), and what stands between
    white space around one is kept whole. Texts are lower-cased first, as the tokeniser does, unless that would not commute
    with its normalisation.

    Runs are kept in two generations of at most ``CACHED``: when the young one is full it becomes the old one, and what
    is met again moves back to the young one. Memory is bounded, and frequent words stay.
    """

    RUN = re.compile(r"[^\W\d_]+|(?:[\d_]|[^\w \t\n\r])+")
    #: The same for lower-case ASCII, several times as fast.
    ASCII_RUN = re.compile("[a-z]+|[^a-z \t\n\r]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same vocabulary for lower-case, normalised words between spaces, which need no more preparation than that.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.plain.model._resize_cache(0)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def runs(self, text: str) -> list[str]:
        if "<|" in text:  # a special token may be spelt out
            return [text]
        if not is_normalized("NFC", text):  # marks may yet join the letters before them
            return re.split("[ \t\n\r]+", text)
        low = text.lower()
        if "\u03a3" in text or not is_normalized("NFC", low):
            low = text
        split = (self.ASCII_RUN if low.isascii() else self.RUN).findall
        if "'" not in low:
            return split(low)
        found = []
        for piece in re.split("[ \t\n\r]+", low):
            found += [piece] if "'" in piece else split(piece)
        return found

    def _encode(self, new: list[str]) -> dict[str, bytes]:
        words = [w for w in new if w.isalpha() and w == w.lower() and is_normalized("NFC", w)]
        joined = [" ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        ids = np.array([i for e in self.plain.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], dtype="<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        known = {}
        if len(ends) == len(words):
            data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            known = {w: data[a:b] for w, a, b in zip(words, at, at[1:], strict=False)}
        rest = [w for w in new if w not in known]
        codes = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        return known | {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(rest, codes, strict=True)}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what is not known yet is encoded for all of them at once."""
        runs = [self.runs(t) for t in texts]
        found = [list(map(self.young.get, r)) for r in runs]
        missing = dict.fromkeys(r for rs, fs in zip(runs, found, strict=True) if None in fs for r, f in zip(rs, fs, strict=True) if f is None)
        if missing:
            at = {r: c for r in missing if (c := self.old.get(r)) is not None}
            at |= self._encode([r for r in missing if r not in at])
            found = [[at[r] if f is None else f for r, f in zip(rs, fs, strict=True)] if None in fs else fs for rs, fs in zip(runs, found, strict=True)]
            if len(self.young) > CACHED:
                self.old, self.young = self.young, {}
            self.young.update((r, c) for r, c in at.items() if len(r) <= CACHED_CHARS)
        return [np.frombuffer(b"".join(f), dtype="<u4") for f in found]


@cache
def encoder(path: str) -> Encoder:
    """One for each worker process, so that what it keeps outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    return Encoder(path)


class Packer:
    """Places examples into sequences as they come; ``rows`` collects finished pieces."""

    def __init__(self, first_id: int, capacity: int, max_segments: int, max_loss: int):
        self.limits, self.sequence = np.array([capacity, max_segments, max_loss]), first_id
        self.waiting: list[tuple] = []  # doc_id, ids, start, end, prompt tokens of the whole document
        self.size = np.zeros((0, 3))
        self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray, prompt: int) -> None:
        self._wait(doc_id, ids, 0, len(ids), prompt)
        while len(self.waiting) >= POOL or self.tokens >= POOL_TOKENS:
            self._fill()

    def finish(self) -> None:
        while self.waiting:
            self._fill()

    def _vector(self, start: int, end: int, prompt: int) -> tuple[int, int, int]:
        return end - start, 1, end - max(start, min(prompt, end))

    def _wait(self, doc_id, ids, start: int, end: int, prompt: int) -> None:
        k = len(self.waiting)
        if k == len(self.size):
            self.size = np.vstack([self.size, np.zeros((max(64, k), 3))])
        self.waiting.append((doc_id, ids, start, end, prompt))
        self.size[k] = self._vector(start, end, prompt)
        self.tokens += end - start

    def _take(self, k: int) -> tuple:
        """Removes example ``k``; the last one moves into its place."""
        item, last = self.waiting[k], self.waiting.pop()
        if k < len(self.waiting):
            self.waiting[k], self.size[k] = last, self.size[len(self.waiting)]
        self.tokens -= item[3] - item[2]
        return item

    def _fill(self) -> None:
        left, placed = self.limits.copy(), []
        while self.waiting and left[:2].min() > 0:
            size = self.size[: len(self.waiting)]
            fits = (size <= left).all(axis=1)
            if fits.any():
                score = (size / self.limits) @ (left / self.limits)
                doc_id, ids, a, b, prompt = self._take(int(np.where(fits, score, -1).argmax()))
            else:
                # The longest prefix of each with no more tokens and no more loss-bearing tokens than are left; of equal ones, of the longest.
                most = np.minimum(np.minimum(size[:, 0], left[0]), size[:, 0] - size[:, 2] + left[2])
                k = int((most * 2.0**32 + size[:, 0]).argmax())
                if most[k] <= 0:
                    break
                take = int(most[k])
                doc_id, ids, a, b, prompt = self._take(k)
                if a + take < b:
                    self._wait(doc_id, ids, a + take, b, prompt)
                b = a + take
            placed.append((doc_id, ids, a, b, prompt))
            left -= np.array(self._vector(a, b, prompt))
        total = int(self.limits[0] - left[0])
        if total < self.limits[0]:
            over = total - (1 << total.bit_length() - 1)
            while over:
                doc_id, ids, a, b, prompt = placed.pop()
                back = min(over, b - a)
                self._wait(doc_id, ids, b - back, b, prompt)
                if back < b - a:
                    placed.append((doc_id, ids, a, b - back, prompt))
                over -= back
        offset = 0
        for doc_id, ids, a, b, prompt in placed:
            self.rows.append((doc_id, a, b - a, zlib.crc32(ids[a:b].tobytes()), len(ids), self._vector(a, b, prompt)[2], self.sequence, offset))
            offset += b - a
        self.sequence += 1


def pack(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", prompt: Column | None = None,
         capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None) -> DataFrame:
    """Pieces of all examples with their place: ``SCHEMA``, one row per piece.

    ``prompt`` is the number of an example's leading tokens that bear no loss (none unless given). ``max_loss`` is ``capacity`` unless given. A null or empty text has only the end id. Repeated rows and null ids are
    packed like any other row; an empty table gives no rows. ``sequence_id`` is unique over the table, as its upper bits are the
    partition's number.
    """
    path = path or tokenizer_path()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       (F.lit(0) if prompt is None else F.coalesce(prompt, F.lit(0))).cast("long").alias("prompt"))

    def run(batches):
        encode, packer = encoder(path).ids, Packer(TaskContext.get().partitionId() << 40, capacity, max_segments, max_loss or capacity)

        def out():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        end = np.array([END_ID], dtype="<u4")
        for b in batches:
            for group in groups(zip(*(map(lambda x: x.as_py(), c) for c in b.columns), strict=True), length=lambda row: len(row[1] or "")):
                for (doc_id, _, n), ids in zip(group, encode([row[1] or "" for row in group]), strict=True):
                    packer.add(doc_id, np.concatenate([ids, end]), n)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()

    return slim.mapInArrow(run, SCHEMA)


def first_line(text: Column) -> Column:
    """Words of the first of several lines, 0 if there is only one. A word has a token at least, so as many leading tokens lie within that line."""
    return F.when(F.contains(text, F.lit("\n")), n_words(F.substring_index(text, "\n", 1))).otherwise(0)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents in sequences of at most 4096 tokens, 64 pieces and 4064 loss-bearing tokens. Of a document of several lines
    as many leading tokens count as its prompt as the first line has words."""
    return pack(docs, prompt=first_line(F.col("text")), max_loss=MAX_LOSS)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed as ``pack_documents`` says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
