"""Edit-aware token counts: a segment tree of pre-tokens for each document, of which an edit re-encodes a neighbourhood alone.

A leaf is a run of whole pre-tokens of about ``LEAF`` characters. Leaves are cut after a letter that no letter follows, or a number that no
number follows: the tokenizer's pre-tokens always end there, whatever comes before, and no merge crosses it, so the count of a text is
the sum of its leaves' counts. Inner nodes hold sums of characters and tokens. An edit descends to the leaves that it touches, takes in a
neighbour where it touches the two characters that make a cut valid, cuts and encodes that stretch again, and updates the sums above it;
the rest of the text is neither read nor copied. A leaf that grows to many times its size has the tree built anew from the leaves,
without encoding.

``indexed`` keeps the trees as two columns beside the texts; ``recounted`` starts from them. An edit log holds (start, end, replacement) in
characters of the text as it is when the edit's turn comes.

Defined cases: a null text counts as empty and has no tokens; edits beyond the text are clamped to it; a text without a place to cut (one
run of letters, say) is one leaf; repeated rows and null doc_ids are counted like any other; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import _text

LEAF, GROWN = 512, 8
CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")
Edit = tuple[int, int, str]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Callable[[str], int]:
    """The number of tokens of a text by byte-level BPE ranks; strings of special tokens are ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def leaves(text: str, leaf: int = LEAF) -> list[str]:
    out, at = [], 0
    while len(text) - at > 2 * leaf:
        found = CUT.search(text, at + leaf)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    if at < len(text) or not out:
        out.append(text[at:])
    return out


class TokenTree:
    """Counts of one text under edits."""

    def __init__(self, text: str, count: Callable[[str], int], leaf: int = LEAF) -> None:
        self.count, self.leaf, self.encoded = count, leaf, len(text)
        parts = leaves(text, leaf)
        self.build(parts, [count(p) for p in parts])

    @classmethod
    def restored(cls, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int], leaf: int = LEAF) -> TokenTree:
        """A tree from the leaves that ``indexed`` kept; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.leaf, tree.encoded = count, leaf, len(text)
        at = [0, *itertools.accumulate(chars)]
        tree.build([text[a:b] for a, b in itertools.pairwise(at)], list(tokens))
        return tree

    @property
    def text(self) -> str:
        return "".join(self.parts)

    def kept(self) -> tuple[list[int], list[int]]:
        """The characters and tokens of the leaves that aren't empty."""
        some = [i for i in range(self.slots, 2 * self.slots) if self.chars[i]] or [self.slots]
        return [self.chars[i] for i in some], [self.tokens[i] for i in some]

    def build(self, parts: list[str], tokens: list[int]) -> None:
        self.slots = 1
        while self.slots < len(parts):
            self.slots *= 2
        pad = self.slots - len(parts)
        self.parts = [*parts, *[""] * pad]
        self.chars, self.tokens = [0] * self.slots + list(map(len, self.parts)), [0] * self.slots + tokens + [0] * pad
        for i in range(self.slots - 1, 0, -1):
            self.pull(i)

    def pull(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def descend(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one with any, for the text's end) and where it starts."""
        at = min(at, max(0, self.chars[1] - 1))
        i, start = 1, 0
        while i < self.slots:
            i *= 2
            if at - start >= self.chars[i]:
                start += self.chars[i]
                i += 1
        return i - self.slots, start

    def edit(self, start: int, end: int, new: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, a = self.descend(start)
        while a > 0 and start < a + 2:  # the cut before this leaf isn't sure any more
            first, a = self.descend(a - 1)
        last, b0 = self.descend(max(end - 1, start))
        b = b0 + self.chars[self.slots + last]
        while b < size and end > b - 1:
            last, b0 = self.descend(b)
            b = b0 + self.chars[self.slots + last]
        stretch = "".join(self.parts[first : last + 1])
        stretch = stretch[: start - a] + new + stretch[end - a :]
        self.encoded += len(stretch)
        parts = leaves(stretch, self.leaf)
        tokens = [self.count(p) for p in parts]
        slots = last - first + 1
        if len(parts) > slots:
            if sum(map(len, parts[slots - 1 :])) > GROWN * self.leaf:
                self.build([*self.parts[:first], *parts, *self.parts[last + 1 :]], [*self.tokens[self.slots : self.slots + first], *tokens, *self.tokens[self.slots + last + 1 :]])
                return
            parts[slots - 1 :], tokens[slots - 1 :] = ["".join(parts[slots - 1 :])], [sum(tokens[slots - 1 :])]
        for k in range(slots):
            i = first + k
            self.parts[i] = parts[k] if k < len(parts) else ""
            self.chars[self.slots + i], self.tokens[self.slots + i] = len(self.parts[i]), tokens[k] if k < len(tokens) else 0
        low, high = (self.slots + first) // 2, (self.slots + last) // 2
        while low:
            for i in range(low, high + 1):
                self.pull(i)
            low, high = low // 2, high // 2


PERSONAL = re.compile(r"(?P<email>[\w.+-]+@[\w-]+\.[\w.-]*\w)|(?P<secret>(?:token|key|secret|password) ?= ?\"[^\"]+\")|(?P<phone>\+\d[\d ()-]{7,}\d)")


def redactions(text: str) -> list[Edit]:
    """An edit log that takes e-mail addresses, secrets and phone numbers out of a text, last first."""
    if "@" not in text and "+" not in text and "=" not in text:
        return []
    return [(m.start(), m.end(), f"<{m.lastgroup}>") for m in PERSONAL.finditer(text)][::-1]


def indexed(docs: DataFrame, ranks: str | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs with their trees in two last columns, for ``recounted`` to start from later.

    They are called leaf_chars and leaf_tokens, with as many underscores before as make the names new.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    _text.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = ["leaf_chars", "leaf_tokens"]
    while {c.lower() for c in docs.columns} & {*names}:
        names = [f"_{c}" for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            trees = [TokenTree(x.as_py() or "", count).kept() for x in batch.column(at)]
            lists = [pa.array([t[k] for t in trees], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], [*batch.schema.names, *names])

    return _text.compacted(docs).mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(c, T.ArrayType(T.LongType())) for c in names)]))


COUNTS = "doc_id long, tokens_before long, n_tokens long, n_chars long, n_edits int, encoded_again long"


def recounted(docs: DataFrame, rule: Callable[[str], list[Edit]] = redactions, edits_col: str | None = None, kept_trees: bool = False, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every row of docs before and after its edits, which come from ``edits_col`` (array of structs start, end, replacement) or from a rule.

    kept_trees: the last two columns of docs are those of ``indexed``, and only what edits touch is encoded.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    _text.bound_batches(docs.sparkSession)
    given = [F.col(edits_col).alias("edits")] if edits_col else []
    logged = bool(given)
    rows = _text.compacted(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *given, *(docs.columns[-2:] if kept_trees else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                log = [(e["start"], e["end"], e["replacement"] or "") for e in batch.column(2)[i].as_py() or []] if logged else rule(text)
                tree = TokenTree.restored(text, batch.column(batch.num_columns - 2)[i].as_py(), batch.column(batch.num_columns - 1)[i].as_py(), count) if kept_trees else TokenTree(text, count)
                before = tree.total
                for edit in log:
                    tree.edit(*edit)
                out.append((before, tree.total, tree.chars[1], len(log), tree.encoded - len(text)))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))], [c.split()[0] for c in COUNTS.split(", ")])

    return rows.mapInArrow(run, COUNTS)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept beside their texts; then edits that take personal data out, counted from the kept trees."""
    scratch = _text.Scratch()
    trees = scratch.write(indexed(_text.table(spark, sf_dir, "documents").select("doc_id", "text")), narrow=False)
    return scratch.result(recounted(trees, kept_trees=True))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
