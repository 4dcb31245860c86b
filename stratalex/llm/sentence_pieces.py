"""SentencePiece encoding and decoding by suffix-array matching, equal to the library's own ids for BPE models.

Per batch of texts: the distinct segments that no piece crosses are concatenated and indexed by a suffix array over
the longest piece's length; every piece is binary-searched for its range of occurrences; the resulting edges are
sorted by the position they end at, and one relaxation over positions finds, for every prefix, the one piece that can
end it. A BPE model merges by rank rather than adding scores, so relaxing an edge means testing that merging would
keep it apart from the piece before it (a prefix's encoding has exactly one last piece, so one edge a position holds).
Encodings of short segments are remembered across batches up to a bound. A long segment is relaxed in overlapping windows:
what ends a prefix depends on the positions of one longest piece before it only, so a window is right from where it
agrees with the one before over that many positions, and pieces are given out as soon as no later one can change them.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters of texts taken at a time, of new segments indexed at a time, of segments that are remembered, of a window
#: of a longer segment and of what it shares with the next one, and windows relaxed at a time.
SLICE, INDEXED, SHORT, WINDOW, OVERLAP, WINDOWS = 1_000_000, 100_000, 256, 1024, 128, 128


class Pieces:
    """The vocabulary of a model file, in a form that can be sent to executors."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes_of = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.unknown = sp.unk_id()


class Numbered(dict):
    """Numbers its keys in the order they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        n = len(self)
        self[key] = n
        return n


class Encoder:
    """Encodes and decodes in one Python process."""

    def __init__(self, vocab: Pieces, remember: int = 200_000):
        self.v, self.remember = vocab, remember
        skip = vocab.special | set(vocab.bytes_of.values())
        self.ids = {p: i for i, p in enumerate(vocab.pieces) if i not in skip}
        n = len(vocab.pieces)
        runs = {p for p, i in self.ids.items() if set(p) == {SPACE} and len(p) > 1}
        # ranks of merges: 0 for single characters, then the order in which merges win
        by = sorted((i for p, i in self.ids.items() if len(p) > 1 and p not in runs), key=lambda i: (-vocab.scores[i], i))
        self.rank = np.zeros(n, np.int64)
        self.rank[by] = np.arange(1, len(by) + 1)
        self.left, self.right = np.arange(n), np.arange(n)
        usable = [i for p, i in self.ids.items() if len(p) == 1]
        for i in by:
            got, last = self.merged(vocab.pieces[i])
            if got == [i]:
                usable.append(i)
                self.left[i], self.right[i] = last
        self.usable = {vocab.pieces[i]: i for i in usable}
        ok = set(usable)
        pairs = {}
        for i in by:
            p = vocab.pieces[i]
            for c in range(1, len(p)):
                a, b = self.ids.get(p[:c], -1), self.ids.get(p[c:], -1)
                if a in ok and b in ok:
                    pairs[a * n + b] = self.rank[i]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.n = n
        names = sorted(p for p in self.ids if self.ids[p] in ok)
        self.names = np.array(names)
        self.name_ids = np.array([self.ids[p] for p in names])
        self.name_len = np.array([len(p) for p in names])
        self.longest = int(self.name_len.max())
        joined = {c for p in self.ids if len(p) > 1 for c in p} - {SPACE}
        inside = "".join(map(re.escape, sorted(joined)))
        self.cut = re.compile(f"{SPACE}+[{inside}]*|[{inside}]+|.", re.S)
        self.chars = np.zeros(n, np.int64)
        self.chars[self.name_ids] = self.name_len
        self.name_ends = np.char.add(self.names, "\U0010ffff")
        self.most_spaces = max([1, *map(len, runs)])
        m = self.most_spaces
        whole = [self.ids.get(SPACE * m)]
        self.spaces_repeat = all(self.merged(SPACE * k)[0] == whole + self.merged(SPACE * (k - m))[0] for k in range(3 * m, 6 * m))
        self.answers: dict[tuple[int, int], bool] = {}
        self.forget()
        self.seen_key = np.full(1 << 20, -1, np.int64)
        self.seen_ok = np.zeros(1 << 20, bool)
        self.raw = [p.replace(SPACE, " ").encode() for p in vocab.pieces]
        for b, i in vocab.bytes_of.items():
            self.raw[i] = bytes([b])
        for i in vocab.special:
            self.raw[i] = " ⁇ ".encode() if i == vocab.unknown else b""

    def merged(self, text: str) -> tuple[list[int], tuple[int, int]]:
        """Merging by rank, pair by pair: the definition of BPE, for pieces, runs of spaces and tests."""
        v, ids = self.v, [self.ids.get(c, -1 - k) for k, c in enumerate(text)]
        strings, nxt, last = list(text), list(range(1, len(text) + 1)), (-1, -1)
        prev, heap = list(range(-1, len(text) - 1)), []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < len(text) and ids[a] >= 0 and ids[b] >= 0 and (i := self.ids.get(strings[a] + strings[b])) is not None:
                heapq.heappush(heap, (-v.scores[i], a, b, strings[a] + strings[b], i))

        for a in range(len(text) - 1):
            offer(a)
        alive = [True] * len(text)
        while heap:
            _, a, b, s, i = heapq.heappop(heap)
            if not (alive[a] and alive[b] and nxt[a] == b and strings[a] + strings[b] == s):
                continue
            last = (ids[a], ids[b])
            strings[a], ids[a], alive[b] = s, i, False
            nxt[a] = nxt[b]
            if nxt[a] < len(text):
                prev[nxt[a]] = a
            if prev[a] >= 0:
                offer(prev[a])
            offer(a)
        out: list[int] = []
        for a in range(len(text)):
            if alive[a]:
                out += [ids[a]] if ids[a] >= 0 else self.fallback(strings[a])
        return out, last

    def fallback(self, char: str) -> list[int]:
        if not self.v.bytes_of:
            return [self.v.unknown]
        return [self.v.bytes_of[b] for b in char.encode()]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging keeps pieces a and b, side by side, as they are. Answers are kept in a direct-mapped table."""
        key = a * self.n + b
        slot = (key * 0x9E3779B1 >> 7) & (len(self.seen_key) - 1)
        out = self.seen_ok[slot]
        new = np.flatnonzero(self.seen_key[slot] != key)
        if len(new):
            out[new] = self._apart(a[new], b[new])
            self.seen_key[slot[new]] = key[new]
            self.seen_ok[slot[new]] = out[new]
            # slots shared by two new keys: the later one is kept, and its answer with it
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 60)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        while len(live):
            x, y = a[live], b[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_ranks[at] < limit[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx > 0) | (ry > 0))
            first = go & (rx > ry)
            second = go & ~first
            limit[live[first]] = rx[first]
            a[live[first]] = self.right[x[first]]
            limit[live[second]] = ry[second] + 1
            b[live[second]] = self.left[y[second]]
            live = live[go]
        return ok

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and piece numbers of every occurrence of every piece, from a suffix array of the code points: ranks
        of as many characters as fit a word, then doubled until they cover the longest piece."""
        n, w = len(text), self.longest
        alphabet = np.unique(text)
        bits = max(1, int(len(alphabet)).bit_length())
        code = np.zeros(n + 64, np.int64)
        code[:n] = np.searchsorted(alphabet, text) + 1
        span = max(1, min(62 // bits, w))
        key = np.zeros(n, np.int64)
        for j in range(span):
            key = key << bits | code[j : n + j]
        while span < w:
            order = np.argsort(key)
            ranked = key[order]
            rank = np.empty(n + w, np.int64)
            rank[n:] = 0
            rank[order] = np.cumsum(np.r_[True, ranked[1:] != ranked[:-1]])
            key = rank[:n] * (n + 2) + rank[min(span, w - span) : n + min(span, w - span)]
            span += min(span, w - span)
        array = np.argsort(key)
        padded = np.zeros(n + w, np.uint32)
        padded[:n] = text
        windows = np.lib.stride_tricks.as_strided(padded, (n, w), (4, 4))
        suffixes = np.ascontiguousarray(windows[array]).view(f"U{w}").ravel()
        lo = np.searchsorted(suffixes, self.names, "left")
        count = np.searchsorted(suffixes, self.name_ends, "left") - lo
        which = np.repeat(np.arange(len(self.names)), count)
        at = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
        return array[at], which

    def prefixes(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The last piece of every prefix of every segment (spaces only in front, one at most; -1 where no piece ends):
        that of the first p characters of segment i lies at starts[i] + p. Then the starts and sizes of the segments."""
        size = np.array([*map(len, segments)])
        text = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le"), np.uint32)
        base = np.r_[0, np.cumsum(size + 1)[:-1]]
        offset = np.arange(len(text)) - np.repeat(base, size + 1)
        start, which = self.edges(text)
        end = start + self.name_len[which]
        inner = offset[end]
        by = np.argsort(inner.astype(np.uint16) if size.max() < 1 << 16 else inner, kind="stable")
        start, piece, end = start[by], self.name_ids[which[by]], end[by]
        cuts = np.r_[0, np.cumsum(np.bincount(inner, minlength=size.max() + 1))]
        last = np.full(len(text) + 1, -1, np.int64)
        for p in range(1, size.max() + 1):
            a, b = cuts[p], cuts[p + 1]
            s, t, e = start[a:b], piece[a:b], end[a:b]
            before = last[s]
            good = offset[s] == 0
            ask = np.flatnonzero(~good & (before >= 0))
            good[ask] = self.apart(before[ask], t[ask])
            last[e[good]] = t[good]
        return last, base, size

    def relax(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, one after another, and how many each has."""
        last, base, size = self.prefixes(segments)
        used = np.zeros(len(last), bool)
        at, floor = base + size, base
        while len(at):
            used[at] = True
            at = at - self.chars[last[at]]
            go = at > floor
            at, floor = at[go], floor[go]
        ends = np.flatnonzero(used)
        return last[ends].astype(np.int32), np.add.reduceat(used, base + 1, dtype=np.int64)

    def windowed(self, s: str) -> np.ndarray:
        """Ids of one long segment. ``last`` holds the last pieces of its prefixes of more than ``done`` characters; what
        lies before ``done`` has been given out."""
        out, done, last, n = [], 0, np.zeros(0, np.int64), len(s)
        tail = last  # the end of what is known
        for a in range(0, n, WINDOW * WINDOWS):
            starts = range(a, min(n, a + WINDOW * WINDOWS), WINDOW)
            found, base, size = self.prefixes([s[b : b + WINDOW + OVERLAP] for b in starts])
            grown = [last]
            for b, x, m in zip(starts, base, size):
                mine = found[x + 1 : x + 1 + m]
                if b:
                    shared = min(OVERLAP, m)
                    same = mine[:shared] == tail[len(tail) - shared :]
                    if m > shared and not self._settles(same):
                        mine = self._extended(s, tail, b + shared, b + m)
                    else:
                        mine = mine[shared:]
                grown.append(mine)
                tail = np.concatenate([tail[-OVERLAP:], mine])[-OVERLAP - WINDOW :]
            last = np.concatenate(grown)
            end = done + len(last)
            cut = end if end == n else self._agreed(last, done)
            at, ids = cut, []
            flat = last[: cut - done].tolist()
            while at > done:
                ids.append(flat[at - done - 1])
                at -= int(self.chars[ids[-1]])
            out.append(np.array(ids[::-1], np.int32))
            last, done = last[cut - done :], cut
        return np.concatenate(out)

    def _settles(self, same: np.ndarray) -> bool:
        """Whether two relaxations agree over as many positions as the longest piece has."""
        runs = np.cumsum(np.r_[0, same])
        return bool((runs[self.longest :] - runs[: -self.longest] == self.longest).any())

    def _extended(self, s: str, tail: np.ndarray, a: int, b: int) -> np.ndarray:
        """The last pieces of the prefixes of ``s`` of a + 1 to b characters, one by one; ``tail`` ends with that of a."""
        last = tail[-self.longest :].tolist()
        off, usable = a - len(last), self.usable
        if len(self.answers) > 1_000_000:
            self.answers.clear()
        for p in range(a + 1, b + 1):
            got = -1
            for q in range(p - 1, max(p - 1 - self.longest, off, 0), -1):
                t, before = usable.get(s[q:p], -1), last[q - off - 1]
                if t >= 0 and before >= 0:
                    ok = self.answers.get((before, t))
                    if ok is None:
                        ok = self.answers[before, t] = bool(self._apart(np.array([before]), np.array([t]))[0])
                    if ok:
                        got = t
                        break
            last.append(got)
        return np.array(last[a - off :], np.int64)

    def _agreed(self, last: np.ndarray, done: int) -> int:
        """The last position that every encoding which goes on beyond the end passes through."""
        end = done + len(last)
        live = {p for p in range(max(done, end - self.longest + 1), end + 1) if p == done or last[p - done - 1] >= 0}
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            live.add(p - int(self.chars[last[p - done - 1]]))
        return live.pop()

    def spaces(self, n: int) -> list[int]:
        """Ids of a run of spaces. Merging takes the leftmost pair first, so a long run is its longest pieces and then what
        the rest merges to, if that was found to hold for the runs that were tried."""
        m = self.most_spaces
        k = max(0, n // m - 4) if self.spaces_repeat else 0
        return [self.ids[SPACE * m]] * k + self.merged(SPACE * (n - k * m))[0] if k else self.merged(SPACE * n)[0]

    def behind_spaces(self, lead: int, tail: list[int]) -> list[int]:
        """Ids of ``lead`` spaces and a body, by those of one space and the body."""
        alone = int(self.ids.get(SPACE) == tail[0])
        return [*self.spaces(lead - 1 + alone), *tail[alone:]]

    def long(self, s: str) -> np.ndarray:
        """Ids of a segment that is too long to be remembered."""
        body = s.lstrip(SPACE)
        lead = len(s) - len(body)
        if lead < 2:
            return self.windowed(s)
        return np.array(self.behind_spaces(lead, self.windowed(SPACE + body).tolist()) if body else self.spaces(lead), np.int32)

    def forget(self) -> None:
        self.memo, self.filled = Numbered(), 0
        self.flat, self.count, self.first = np.zeros(1 << 18, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)

    def learn(self) -> None:
        """Encodes the segments that the memo has numbered since the last call; those in need of a fallback or a run of
        spaces are composed."""
        odd = [s for s in self.memo.fresh if (len(s) == 1 and s not in self.ids) or s[:2] == SPACE + SPACE]
        tails = {s: self.memo[SPACE + b] for s in odd if len(s) > 1 and (b := s.lstrip(SPACE))}
        plain = self.memo.fresh
        if odd:
            skip = set(odd)
            plain = [s for s in plain if s not in skip]
        size = np.cumsum([*map(len, plain)]) // INDEXED if plain else np.zeros(0, int)
        for a, b in zip(*(np.searchsorted(size, np.unique(size), side) for side in ("left", "right"))):
            ids, count = self.relax(plain[a:b])
            self.put(np.fromiter(map(self.memo.__getitem__, plain[a:b]), np.int64, b - a), ids, count)
        for s in odd:
            body = s.lstrip(SPACE)
            lead = len(s) - len(body)
            if not body:
                out = self.spaces(lead)
            elif not lead:
                out = self.fallback(s)
            else:
                i = tails[s]
                out = self.behind_spaces(lead, self.flat[self.first[i] : self.first[i] + self.count[i]].tolist())
            self.put(np.array([self.memo[s]]), np.array(out, np.int32), np.array([len(out)]))
        self.memo.fresh = []

    def put(self, which: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        f, g = self.filled, self.filled + len(ids)
        while g > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros(len(self.flat), np.int32)]
        while len(self.memo) > len(self.count):
            self.count, self.first = np.r_[self.count, self.count * 0], np.r_[self.first, self.first * 0]
        self.flat[f:g] = ids
        self.count[which] = count
        self.first[which] = f + np.cumsum(count) - count
        self.filled = g

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; an empty text has none."""
        out: list[np.ndarray] = []
        held, size = [], 0
        for t in texts:
            if held and size + len(t) > SLICE:
                out += self._encoded(held)
                held, size = [], 0
            t = SPACE + t.replace(" ", SPACE) if t else t
            if len(t) > SLICE:
                out.append(self._very_long(t))
            else:
                held.append(self.cut.findall(t))
                size += len(t)
                if len(t) > SHORT and len(max(held[-1], key=len)) > SHORT:
                    held.pop()
                    out += [*(self._encoded(held) if held else []), self._very_long(t)]
                    held, size = [], 0
        return out + (self._encoded(held) if held else [])

    def _very_long(self, t: str) -> np.ndarray:
        """Ids of a text that is long or has a long segment, a part of its segments at a time."""
        parts, held, size = [], [], 0
        for m in self.cut.finditer(t):
            held.append(m.group())
            size += len(held[-1])
            if size > SLICE or len(held[-1]) > SHORT:
                long = [held.pop()] if len(held[-1]) > SHORT else []
                parts += [*(self._encoded([held]) if held else []), *map(self.long, long)]
                held, size = [], 0
        return np.concatenate(parts + (self._encoded([held]) if held else []))

    def _encoded(self, lists: list[list[str]]) -> list[np.ndarray]:
        words = [*chain.from_iterable(lists)]
        if len(self.memo) > self.remember:
            self.forget()
        which = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        if self.memo.fresh:
            self.learn()
        count = self.count[which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.first[which] - ends + count, count)]
        cuts = np.r_[0, ends][np.cumsum([0, *map(len, lists)])]
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces with their spaces, bytes joined, broken bytes as U+FFFD, the added space gone."""
        s = b"".join(b"".join(map(self.raw.__getitem__, ids[a : a + SLICE].tolist())) for a in range(0, len(ids), SLICE))
        return (s[1:] if s[:1] == b" " else s).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocab: Pieces, name: str) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(vocab)
    return _ENCODERS[name]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` characters."""
    part = np.cumsum(sizes) // SLICE
    cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    yield from zip(cuts[:-1], cuts[1:])


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """``docs`` with ``ids`` array<int> and ``n_tokens`` long added (replacing columns of these names), and with ``verify``
    also ``round_trip``: decoding gave the text back.

    A null or empty text has no ids. Texts holding U+2581 read as if it were a space, as in the library, and so don't
    round-trip. Very long texts, and texts that nothing breaks, take memory for themselves and their ids only. Repeated
    rows get a row each; other columns pass through; rows aren't moved; an empty table gives no rows."""
    return _encoded_rows(docs.drop("ids", "n_tokens", "round_trip").withColumn("__text", F.col(text).cast("string")), model, verify)


def ids_for_texts(docs: DataFrame, text: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """As ``encode``, with the ids in place of the column of texts, which then reaches Python once."""
    kept = docs.drop("ids", "n_tokens", "round_trip")
    return _encoded_rows(kept.withColumn("__text", F.col(text).cast("string")).drop(text), model, verify)


def _encoded_rows(rows: DataFrame, model: str, verify: bool) -> DataFrame:
    vocab, name = Pieces(model), model
    added = "ids array<int>, n_tokens long" + ", round_trip boolean" * verify

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(vocab, name)
        for batch in parts:
            names = batch.schema.names
            given = batch.column(names.index("__text"))
            others = [(n, batch.column(i)) for i, n in enumerate(names) if n != "__text"]
            if not len(batch):
                continue
            sizes = pc.fill_null(pc.binary_length(given), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(sizes.astype(np.int64)):
                texts = [t or "" for t in given.slice(a, b - a).to_pylist()]
                ids = enc.encode(texts)
                count = np.array([len(i) for i in ids], np.int64)
                lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), np.concatenate(ids).astype(np.int32, copy=False))
                more = [("ids", lists), ("n_tokens", pa.array(count))]
                if verify:
                    more.append(("round_trip", pa.array([enc.decode(i) == t for i, t in zip(ids, texts)])))
                del texts, ids
                columns = [(n, c.slice(a, b - a)) for n, c in others] + more
                yield pa.RecordBatch.from_arrays([c for _, c in columns], [n for n, _ in columns])
                del lists, more, columns
            del batch, given, others
        released()

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return lean(rows).mapInArrow(run, f"{fields}, {added}" if fields else added)


def decode(rows: DataFrame, ids: str = "ids", model: str = MODEL, to: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids`` in column ``to``; null ids give null, none the empty text."""
    vocab, name = Pieces(model), model

    @F.pandas_udf("string")
    def texts(col: pd.Series) -> pd.Series:
        enc = _encoder(vocab, name)
        return pd.Series([None if i is None else enc.decode(np.asarray(i, np.int64)) for i in col])

    return lean(rows).withColumn(to, texts(F.col(ids)))
