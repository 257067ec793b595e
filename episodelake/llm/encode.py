"""Encoding of a corpus with a public tokenizer (problem 6).

A text is the leaves of a tree: pieces of LEAF characters at most, encoded apart. Two neighbours are joined by encoding
anew only a window about their border. The split pattern reads a text from left to right, and what it makes of a position
depends on nothing before it; so the words (pre-tokens) of the left part that end before its last character stand, and once
the reading from there on, now over both parts, reaches a border that the right part's own reading has as well, all that
follows stands too. The window grows, on either side, until that is so, in the worst case to the whole of both parts; the
tokens outside it are then provably those of the joined text. Joining is associative, so leaves may be encoded on any machine
and joined in any grouping; here halves are joined recursively. Decoding is concatenation of the tokens' bytes.

Texts of one leaf are encoded where they are. Leaves of longer texts are spread over tasks, and come together by
document for the joins; a document's ids are one row of the result in any case.

Defined cases: null and empty texts have an empty list; strings of special tokens are ordinary text; any valid Unicode,
CRLF and NUL included, is encoded as it is; repeated doc_ids give a row each (long texts of one doc_id are kept apart by
a row id); extra columns play no part; an empty table gives no rows."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

TOKENIZERS = "/opt/tokenizers"
#: Characters of a leaf, and of the window's first size on either side of a border.
LEAF, WINDOW = 1 << 16, 256

# The split pattern that the vocabulary byte_bpe_50k goes with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """byte_bpe_50k without special tokens: leaves, joins and decoding."""

    def __init__(self, folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
        import regex
        import tiktoken

        with open(f"{folder}/{name}.tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.library = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN)

    def leaf(self, text: str) -> np.ndarray:
        return self.library.encode_to_numpy(text, disallowed_special=()).astype(np.int32) if text else np.empty(0, np.int32)

    def word(self, text: str) -> list[int]:
        """A word's ids; without the library's own splitting, which has limits on long runs."""
        return self.library._encode_single_piece(text.encode())

    def ends(self, text: str, upto: int) -> list[int]:
        """Where words of `text` end, as far as `upto`, reading from its start."""
        out, at = [0], 0
        while at < min(upto, len(text)):
            at = self.words.match(text, at).end()
            out.append(at)
        return out

    @staticmethod
    def pieces(text: str, ends: list[int]) -> list[str]:
        return [text[x:y] for x, y in zip(ends[:-1], ends[1:])]

    def standing(self, text: str, window: int) -> int:
        """A border of words in `text`, at most about `window` before its end, that stands whatever follows."""
        while True:
            start = self.sure(text, max(0, len(text) - window))
            stands = [start + e for e in self.ends(text[start:], len(text) - start) if start + e < len(text)]
            # The last word may go on, and the one before may be the apostrophe of a contraction.
            if start == 0 or len(stands) >= 3:
                return stands[-2] if len(stands) >= 3 else 0
            window *= 2

    @staticmethod
    def sure(text: str, at: int) -> int:
        """The last position up to `at` at which each reading has a border; 0 if there's none."""
        while True:
            at = text.rfind("\n", 0, at)
            if at < 0:
                return 0
            # "\n" and then no white space: a run of white space ends here, and the next word has no leading "\n".
            if at + 1 < len(text) and not text[at + 1].isspace():
                return at + 1

    def join(self, left: tuple[str, np.ndarray], right: tuple[str, np.ndarray]) -> tuple[str, np.ndarray]:
        """(text, ids) of the two parts in a row."""
        a, b = left[0], right[0]
        if not a or not b:
            return right if not a else left
        whole, begin, window = a + b, self.standing(a, WINDOW), WINDOW
        while True:
            # Both readings see one character beyond the window; a word that ends two before that isn't changed by what follows.
            joined = [begin + e for e in self.ends(whole[begin : len(a) + window + 1], len(a) - begin + window)]
            own = [len(a) + e for e in self.ends(b[: window + 1], window)]
            known = len(whole) + 1 if window >= len(b) else len(a) + window
            met = set(own).intersection(e for e in joined if e < known)
            if met:
                end = min(met)
                break
            window *= 2
        dropped = sum(len(self.word(w)) for w in self.pieces(a, [begin + e for e in self.ends(a[begin:], len(a) - begin)]))
        skipped = sum(len(self.word(w)) for w in self.pieces(whole, [e for e in own if e <= end]))
        fresh = [i for w in self.pieces(whole, [e for e in joined if e <= end]) for i in self.word(w)]
        return whole, np.concatenate([left[1][: len(left[1]) - dropped], np.array(fresh, np.int32), right[1][skipped:]])

    def tree(self, leaves: list[tuple[str, np.ndarray]]) -> tuple[str, np.ndarray]:
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return self.join(self.tree(leaves[:half]), self.tree(leaves[half:]))

    def encode(self, text: str | None, leaf: int = LEAF) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        return self.tree([(t, self.leaf(t)) for t in (text[i : i + leaf] for i in range(0, len(text), leaf))])[1]

    def decode(self, ids) -> str:
        return self.library.decode_bytes(list(map(int, ids))).decode()


def lists(ids: list[np.ndarray]):
    """An Arrow column of lists."""
    import pyarrow as pa

    ends = np.cumsum([0, *map(len, ids)])
    if ends[-1] >= 2**31:
        raise ValueError("a batch of more than 2**31 ids")
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def corpus_ids(documents: DataFrame, folder: str = TOKENIZERS, leaf: int = LEAF, sizes: bool = False) -> DataFrame:
    """doc_id and ids of each row of `documents` (doc_id, text); with `sizes`, doc_id and n_tokens."""
    schema = "doc_id long, n_tokens long" if sizes else "doc_id long, ids array<int>"

    def result(doc_id, ids):
        import pyarrow as pa

        if sizes:
            return pa.RecordBatch.from_arrays([doc_id, pa.array([len(i) for i in ids], pa.int64())], names=["doc_id", "n_tokens"])
        return pa.RecordBatch.from_arrays([doc_id, lists(ids)], names=["doc_id", "ids"])

    def one_leaf(batches: Iterator) -> Iterator:
        e = Encoder(folder)
        for b in batches:
            yield result(b.column("doc_id"), [e.leaf(t) if t else np.empty(0, np.int32) for t in b.column("text").to_pylist()])

    def leaves(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for row, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "text"))):
                parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([row] * n, pa.int64()), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(parts, pa.string())], names=["row", "doc_id", "part", "text"])

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        e = Encoder(folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "doc_id", "part", "text")), lists([e.leaf(t) for t in b.column("text").to_pylist()])], names=["row", "doc_id", "part", "text", "ids"])

    kept: dict[str, Encoder] = {}

    def joined(group):
        import pyarrow as pa

        if "e" not in kept:
            kept["e"] = Encoder(folder)
        group = group.sort_by("part").combine_chunks()
        ids = group.column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
        parts = [(t, flat[a:z]) for t, a, z in zip(group.column("text").to_pylist(), ends[:-1], ends[1:])]
        return pa.Table.from_batches([result(group.column("doc_id").combine_chunks()[:1], [kept["e"].tree(parts)[1]])])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = F.length("text") <= leaf
    small = texts.where(F.col("text").isNull() | short).mapInArrow(one_leaf, schema)
    large = texts.where(~short).withColumn("row", F.monotonically_increasing_id())
    spread = large.mapInArrow(leaves, "row long, doc_id long, part int, text string").repartition("row", "part")
    spread = spread.mapInArrow(encoded, "row long, doc_id long, part int, text string, ids array<int>")
    return small.unionAll(spread.groupBy("row").applyInArrow(joined, schema))


def token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """p6_ids."""
    return corpus_ids(spark.read.parquet(f"{folder}/documents.parquet"))
