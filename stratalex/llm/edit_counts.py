"""Edit-aware token counts: a tree of sums over the pre-tokens of each document.

A document is cut into pre-tokens by the tokenizer's pattern; each has its length and its count of byte-pair tokens
(encodings never cross pre-tokens). Blocks of pre-tokens are the leaves of a segment tree whose nodes hold sums of
both. An edit replaces a range of characters: descent by length finds the pre-tokens that it touches, scanning starts
two pre-tokens earlier (a match of the pattern looks one character beyond its end) and goes on until a boundary of
the new text meets one of the old text beyond the edit. Only what was scanned is encoded; sums are updated on the
way to the root.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import accumulate, chain, count
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 32


def _ranges(kind: str, top: int) -> str:
    """A character class of all code points below ``top`` whose category starts with ``kind``."""
    out, a = [], None
    for c in range(top + 1):
        if c < top and unicodedata.category(chr(c))[0] == kind:
            a = c if a is None else a
        elif a is not None:
            out.append(f"\\u{a:04x}-\\u{c - 1:04x}")
            a = None
    return "".join(out)


class Counter:
    """Token counts of pre-tokens, remembered up to a bound."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 1_000_000):
        import regex
        import tiktoken

        top = 0x800
        letter, number, space = _ranges("L", top), _ranges("N", top), r"\x09-\x0d\x20\x85\xa0"
        self.low = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
        self.high = regex.compile(PATTERN)
        self.rare = re.compile("[^\\x00-\\u07ff]")
        self.tokens = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.remember = remember
        self.memo = Remembered(self.tokens)

    def pattern(self, text: str):
        return self.high if self.rare.search(text) else self.low

    def counts(self, parts: list[str]) -> list[int]:
        if len(self.memo) > self.remember:
            self.memo.clear()
        return [*map(self.memo.__getitem__, parts)]


class Remembered(dict):
    """Token counts of pre-tokens, encoded when first asked for."""

    def __init__(self, tokens):
        super().__init__()
        self.tokens = tokens

    def __missing__(self, part: str) -> int:
        try:
            self.tokens.encode_single_token(part)
            n = 1
        except KeyError:
            n = len(self.tokens._encode_single_piece(part))
        self[part] = n
        return n


class Tree:
    """The pre-tokens of one text, in blocks, under a segment tree of (characters, tokens)."""

    def __init__(self, text: str, counter: Counter, parts: list[str] | None = None, counts: list[int] | None = None):
        self.counter, self.text, self.pattern = counter, text, counter.pattern(text)
        parts = self.pattern.findall(text) if parts is None else parts
        self.build([*map(len, parts)], counter.counts(parts) if counts is None else counts)
        self.encoded = 0

    def build(self, lengths: list[int], counts: list[int]) -> None:
        n = max(1, -(-len(lengths) // BLOCK))
        self.size = 1 << (n - 1).bit_length()
        self.lengths = [lengths[i : i + BLOCK] for i in range(0, n * BLOCK, BLOCK)]
        self.counts = [counts[i : i + BLOCK] for i in range(0, n * BLOCK, BLOCK)]
        rest = [0] * (self.size - n)
        self.chars = self._sums([*map(sum, self.lengths), *rest])
        self.sums = self._sums([*map(sum, self.counts), *rest])

    @staticmethod
    def _sums(level: list[int]) -> list[int]:
        levels = [level]
        while len(level) > 1:
            level = [*map(add, level[::2], level[1::2])]
            levels.append(level)
        return [0, *chain.from_iterable(levels[::-1])]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    @property
    def pretokens(self) -> int:
        return sum(map(len, self.lengths))

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at``, and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return min(node - self.size, len(self.lengths) - 1), start

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters [start, end) of the text; positions beyond the text mean its end."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        shift = len(new) - (end - start)
        text = self.text = self.text[:start] + new + self.text[end:]
        if self.pattern is self.counter.low and self.counter.rare.search(new):
            self.pattern = self.counter.high
        b0, at = self.find(max(0, start - 1))
        while True:  # two whole pre-tokens before the edit's, counted from the first of a block
            inner = [*accumulate(self.lengths[b0], initial=at)]
            keep = bisect_left(inner, start) - 3
            if keep >= 0 or b0 == 0:
                break
            b0 -= 1
            at -= self.chars[self.size + b0]
        keep = max(0, keep)
        lengths, b1, bounds, reach, stop, parts = self.lengths, b0, {}, at, None, []
        tail = start + len(new)
        for m in self.pattern.finditer(text, inner[keep]):
            parts.append(m.group())
            pos = m.end()
            if pos >= tail:
                pos -= shift
                while reach <= pos and b1 < len(lengths):
                    if lengths[b1] and reach + self.chars[self.size + b1] >= end:
                        bounds.update(zip(accumulate(lengths[b1], initial=reach), enumerate_from(b1)))
                    reach += self.chars[self.size + b1]
                    b1 += 1
                    bounds[reach] = (b1 - 1, len(lengths[b1 - 1]))
                if pos >= end and (stop := bounds.get(pos)):
                    break
        b2, cut = stop or (len(lengths) - 1, len(lengths[-1]))
        counts = self.counter.counts(parts)
        self.encoded += len(parts)
        sizes = lengths[b0][:keep] + [*map(len, parts)] + lengths[b2][cut:]
        counts = self.counts[b0][:keep] + counts + self.counts[b2][cut:]
        if len(sizes) > 4 * BLOCK + len(parts) // 2:
            self.build(
                [*chain(*lengths[:b0], sizes, *lengths[b2 + 1 :])], [*chain(*self.counts[:b0], counts, *self.counts[b2 + 1 :])]
            )
            return
        for b in range(b0, b2 + 1):
            lengths[b], self.counts[b] = (sizes, counts) if b == b0 else ([], [])
            node = self.size + b
            self.chars[node], self.sums[node] = sum(lengths[b]), sum(self.counts[b])
            while node > 1:
                node //= 2
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]


def enumerate_from(block: int) -> Iterator[tuple[int, int]]:
    return ((block, i) for i in count())


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_COUNTERS: dict[str, Counter] = {}


def _counter(ranks: dict[bytes, int], name: str) -> Counter:
    if name not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[name] = Counter(ranks)
    return _COUNTERS[name]


def scripted(n: int) -> list[tuple[int, int, str]]:
    """Three edits of a text of ``n`` characters: a replacement, a deletion and an insertion, last place first."""
    return [(3 * n // 4, 3 * n // 4, " [inserted note]"), (n // 2, n // 2 + 20, ""), (n // 4, n // 4 + 12, "it's 2 edits")]


def count_tokens(docs: DataFrame, edits: str | None = None, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_tokens_edited, n_reencoded for each row of ``docs``.

    ``edits`` names a column of arrays of structs (start, end, new), applied in order to the text as it then stands;
    without it every text gets ``scripted`` edits. n_tokens_edited counts the edited text, n_reencoded the pre-tokens
    that were scanned again for it. A null text is empty (no tokens before edits); null edits mean none; positions
    beyond the text mean its end. Repeated rows get a row each; other columns are not read."""
    table, name = read_ranks(ranks), ranks
    given = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.col(edits).alias("edits")] if edits else []))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(table, name)
        for p in parts:
            rows, held, size = [], [], 0
            for i, t in enumerate(p["text"]):
                held.append((i, t or ""))
                size += len(held[-1][1])
                if size > 4_000_000 or i + 1 == len(p):
                    rows += measured(counter, [t for _, t in held], [p["edits"].iloc[i] for i, _ in held] if edits else None)
                    held, size = [], 0
            yield pd.DataFrame(rows, columns=["n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"]).assign(doc_id=p.doc_id.to_numpy())

    kind = docs.schema["doc_id"].dataType.simpleString()
    return lean(given).mapInPandas(run, f"n_pretokens long, n_tokens long, n_tokens_edited long, n_reencoded long, doc_id {kind}").select(
        "doc_id", "n_pretokens", "n_tokens", "n_tokens_edited", "n_reencoded"
    )


def measured(counter: Counter, texts: list[str], edits: Sequence | None) -> list[tuple[int, int, int, int]]:
    lists = [counter.pattern(t).findall(t) for t in texts]
    counts = counter.counts([*chain.from_iterable(lists)])
    at, out = 0, []
    for i, (t, parts) in enumerate(zip(texts, lists)):
        tree = Tree(t, counter, parts, counts[at : at + len(parts)])
        at += len(parts)
        before, n = tree.tokens, len(parts)
        script = scripted(len(t)) if edits is None else [] if edits[i] is None else [(e["start"], e["end"], e["new"]) for e in edits[i]]
        for start, end, new in script:
            tree.edit(start, end, new)
        out.append((n, before, tree.tokens, tree.encoded))
    return out
