"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts fall apart at spaces (no piece holds a space mark after another
character) and wherever no piece holds the two characters beside each other, and the
different units that are new are joined into one text. Its suffixes are sorted as far as
the longest piece reaches, every piece is looked up by binary search, and its range of
suffixes gives all its occurrences. The occurrences are edges from start to end; sorted
by position, they are relaxed from left to right, in all units side by side.

For a unigram model an edge relaxes the best score. In a BPE model the pieces' scores
are ranks of merges, not costs, and no sum of them gives its result. There, an edge
(i, j, piece) continues the encoding of the text up to i if merging its last piece
and this one by the model's rule leaves exactly the two: then no merge ever crosses i,
and the encoding up to j is the encoding up to i and the piece. So relaxing gives what
merging gives, which the tests hold against the sentencepiece library. A merge crosses
if some end of the left piece and some beginning of the right one, as they come about
in merging, are together a piece that ranks before what either is merged into next.

Characters without a piece become the pieces of their UTF-8 bytes. Null: no ids, null
text back. Empty: no ids. Very long texts without spaces make one long unit. Repeated
rows are encoded alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, table
from .tokens import public

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
NORMAL, BYTE = 1, 6
#: Units kept by a worker and their longest; pairs of pieces whose joint is known.
CACHE, LONG, PAIRS = 500_000, 48, 1_000_000
#: Code points that are matched at a time, but for a unit that is longer.
CHUNK = 1 << 20
NEVER = np.int64(1) << 40


def suffixes(text: np.ndarray, reach: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first `reach` code points, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    m = 1
    order = np.argsort(rank, kind="stable")
    while m < reach:
        after = np.zeros(n, np.int64)
        after[: max(0, n - m)] = rank[m:]
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        run = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, run[1:] != run[:-1]))
        m *= 2
    return order


class Model:
    """Pieces of a SentencePiece model: BPE, or unigram with `bpe` false."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or not spec.escape_whitespaces or spec.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        self.prefix, self.bpe = spec.add_dummy_prefix, proto.trainer_spec.model_type == 2
        self.names = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.lowest = min(self.score.values(), default=0.0) - 10
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self.reach = max(map(len, self.score), default=1)
        self.sorted = np.array(sorted(self.score), dtype=f"U{self.reach}")
        self.sizes = np.char.str_len(self.sorted)
        self.top = np.array([p + "\U0010ffff" * (self.reach - len(p)) for p in self.sorted], self.sorted.dtype)
        # nodes: the sorted pieces, the other characters that pieces consist of, and one for all characters besides
        self.nodes = self.sorted.tolist()
        self.nodes += sorted({c for p in self.score for c in p}.difference(self.score))
        self.at = {n: i for i, n in enumerate(self.nodes)}
        self.scores = np.array([self.score.get(n, self.lowest) for n in self.nodes] + [self.lowest])
        rank = np.unique(-self.scores, return_inverse=True)[1].astype(np.int64)
        self.chars = np.array([ord(n) for n in self.nodes if len(n) == 1], np.int64)
        self.char_nodes = np.array([i for i, n in enumerate(self.nodes) if len(n) == 1], np.int64)[np.argsort(self.chars)]
        self.chars.sort()
        self.bigrams = np.unique([ord(a) << 21 | ord(b) for p in self.score for a, b in zip(p, p[1:])]).astype(np.int64)
        self.ids = np.array([self.id.get(n, -1) for n in self.nodes] + [-1], np.int64)
        self.bytes_of = [self.names[i].replace(MARK, " ").encode() if k == NORMAL else bytes([int(self.names[i][3:5], 16)]) if k == BYTE else " ⁇ ".encode() if i == self.unknown else b"" for i, k in enumerate(self.kinds)]
        if self.bpe:
            self._spines(rank)
        self.units: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.pair_keys, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)

    def _spines(self, rank: np.ndarray) -> None:
        """How each piece comes about: the nodes at its left and right edge, outer first, the rank of each and of what it is merged into."""
        split: list[tuple[int, int] | None] = [None] * (len(self.nodes) + 1)
        self.whole = np.ones(len(split), bool)
        self.rising = np.ones(len(split), bool)  # parts always come before the whole
        made = np.where([len(n) == 1 for n in self.nodes] + [True], -1, rank)
        for i, n in sorted(enumerate(self.nodes), key=lambda x: len(x[1])):
            if len(n) > 1:
                parts = self.merged(n, 2)
                self.whole[i] = len(parts) == 2 and self.merged(parts[0] + parts[1]) == [n]
                if self.whole[i] and all(x in self.at for x in parts):
                    split[i] = x, y = self.at[parts[0]], self.at[parts[1]]
                    self.rising[i] = self.rising[x] and self.rising[y] and made[x] < made[i] and made[y] < made[i]
        depth = self.reach
        self.left, self.right = np.full((len(split), depth), -1), np.full((len(split), depth), -1)
        self.left_next, self.right_next = np.full((len(split), depth), NEVER), np.full((len(split), depth), NEVER)
        for side, (spine, after) in enumerate(((self.left, self.left_next), (self.right, self.right_next))):
            for i in range(len(split)):
                at, d = i, 0
                spine[i, 0] = i
                while split[at] is not None and d + 1 < depth:
                    part = split[at][side]
                    d += 1
                    spine[i, d], after[i, d] = part, made[at]
                    at = part
        self.made = made
        pairs = {}
        for n in self.score:
            for k in range(1, len(n)):
                if n[:k] in self.at and n[k:] in self.at:
                    pairs[self.at[n[:k]] * len(split) + self.at[n[k:]]] = rank[self.at[n]]
        keys = np.array(sorted(pairs), np.int64)
        self.join_keys, self.join_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)

    def merged(self, text: str, least: int = 1) -> list[str]:
        """Merging by the model's rule, down to `least` parts: best score first, leftmost among equals. For short texts."""
        parts = list(text)
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _joints(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging nodes a and b, side by side, leaves the two."""
        fits, last = np.ones(len(a), bool), max(1, len(self.join_keys)) - 1
        # where equals meet it matters which stands further left: these are merged one by one
        unsure = ~(self.rising[a] & self.rising[b])
        for d in range(self.reach if len(self.join_keys) else 0):
            x = self.right[a, d]
            if (x < 0).all():
                break
            for e in range(self.reach):
                y = self.left[b, e]
                live = np.flatnonzero((x >= 0) & (y >= 0) & fits)
                if not len(live):
                    break
                key = x[live] * len(self.whole) + y[live]
                at = np.minimum(np.searchsorted(self.join_keys, key), last)
                joins = self.join_keys[at] == key
                live, rank = live[joins], self.join_ranks[at[joins]]
                made_x, made_y, next_x, next_y = self.made[x[live]], self.made[y[live]], self.right_next[a[live], d], self.left_next[b[live], e]
                unsure[live[(rank == next_x) | (rank == next_y) | (made_x == next_y) | (made_y == next_x)]] = True
                after = np.minimum(next_x, next_y)
                fits[live[(np.maximum(made_x, made_y) < after) & (rank < after)]] = False
        for i in np.flatnonzero(unsure).tolist():
            left, right = self.nodes[a[i]] if a[i] < len(self.nodes) else "", self.nodes[b[i]] if b[i] < len(self.nodes) else ""
            fits[i] = not left or not right or self.merged(left + right) == [left, right]
        return fits

    def joints(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys, back = np.unique(a * len(self.whole) + b, return_inverse=True)
        at = np.searchsorted(self.pair_keys, keys)
        known = np.append(self.pair_keys, -1)[at] == keys
        fits = np.append(self.pair_fits, False)[at]
        if not known.all():
            new = keys[~known]
            fits[~known] = self._joints(new // len(self.whole), new % len(self.whole))
            if len(self.pair_keys) > PAIRS:
                self.pair_keys, self.pair_fits, at = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(len(keys), np.int64)
            self.pair_keys, self.pair_fits = np.insert(self.pair_keys, at[~known], new), np.insert(self.pair_fits, at[~known], fits[~known])
        return fits[back]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends, lengths and nodes of all occurrences of all pieces, and of all single characters."""
        order = suffixes(codes, self.reach)
        padded = np.append(codes, np.zeros(self.reach, np.uint32))
        # sorted suffixes as fixed-width strings, some at a time
        low, high = np.zeros(len(self.sorted), np.int64), np.zeros(len(self.sorted), np.int64)
        view = np.lib.stride_tricks.sliding_window_view(padded, self.reach)
        for at in range(0, len(order), 1 << 18):
            some = np.ascontiguousarray(view[order[at : at + (1 << 18)]]).view(self.sorted.dtype).ravel()
            low += np.searchsorted(some, self.sorted, "left")
            high += np.searchsorted(some, self.top, "right")
        found = np.flatnonzero((high > low) & (self.sizes > 1))
        count = (high - low)[found]
        size = np.repeat(self.sizes[found], count)
        at = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = np.minimum(np.searchsorted(self.chars, codes), max(0, len(self.chars) - 1))
        single = np.where(self.chars[place] == codes, self.char_nodes[place], len(self.nodes)) if len(self.chars) else np.full(len(codes), len(self.nodes))
        n = len(codes)
        return np.append(order[at] + size, np.arange(1, n + 1)), np.append(size, np.ones(n, np.int64)), np.append(np.repeat(found, count), single)

    def relaxed(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends and nodes of the pieces of all units; bounds: the units' starts in codes, and its end."""
        ends, sizes, nodes = self.edges(codes)
        starts = np.repeat(bounds[:-1], np.diff(bounds))
        own = starts[ends - 1]
        inside = ends - sizes >= own
        ends, sizes, nodes, own = ends[inside], sizes[inside], nodes[inside], own[inside]
        level = ends - own
        by = np.lexsort((-sizes, ends, level))
        ends, sizes, nodes, own, level = ends[by], sizes[by], nodes[by], own[by], level[by]
        last, step = np.full(len(codes) + 1, -1), np.zeros(len(codes) + 1, np.int64)  # node and length of the last piece of the encoding up to here
        total = np.zeros(len(codes) + 1)
        cuts = np.append(np.flatnonzero(np.append(True, level[1:] != level[:-1])), len(level)) if len(level) else np.zeros(1, np.int64)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            j, size, node = ends[low:high], sizes[low:high], nodes[low:high]
            i = j - size
            first = i == own[low:high]
            if self.bpe:
                fits = np.where(first, self.whole[node], last[i] >= 0)
                ask = np.flatnonzero(fits & ~first)
                if len(ask):
                    fits[ask] = self.joints(last[i[ask]], node[ask])
                j, size, node = j[fits], size[fits], node[fits]
            else:
                value = np.where(first, 0.0, total[i]) + self.scores[node]
                order = np.lexsort((-size, -value, j))
                j, size, node, value = j[order], size[order], node[order], value[order]
            best = np.append(True, j[1:] != j[:-1])[: len(j)]
            last[j[best]], step[j[best]] = node[best], size[best]
            if not self.bpe:
                total[j[best]] = value[best]
        at, start, all_ends = bounds[1:].copy(), bounds[:-1], []
        while len(at):
            all_ends.append(at)
            at = at - step[at]
            at, start = at[at > start], start[at > start]
        done = np.sort(np.concatenate(all_ends)) if all_ends else np.zeros(0, np.int64)
        return done, last[done]

    def _learn(self, parts: list[str]) -> None:
        """The ids of units without a cut."""
        at = 0
        while at < len(parts):
            group, size = [], 0
            while at < len(parts) and (not group or size + len(parts[at]) < CHUNK):
                group.append(parts[at])
                size += len(parts[at])
                at += 1
            bounds = np.cumsum([0, *map(len, group)])
            codes = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends, nodes = self.relaxed(codes, bounds)
            ids = self.ids[nodes]
            cuts = np.searchsorted(ends, bounds, "right")
            strange = np.append(0, np.cumsum(ids < 0))[cuts]
            raw, cuts, strange = ids.astype("<u4").tobytes(), cuts.tolist(), strange.tolist()
            for i, unit in enumerate(group):
                if strange[i] == strange[i + 1]:
                    self.parts[unit] = raw[4 * cuts[i] : 4 * cuts[i + 1]]
                    continue
                low, found = int(bounds[i]), []
                for end, x in zip(ends[cuts[i] : cuts[i + 1]].tolist(), ids[cuts[i] : cuts[i + 1]].tolist()):
                    text = unit[low - int(bounds[i]) : end - int(bounds[i])]
                    found += [x] if x >= 0 else [self.bytes[c] for c in text.encode("utf-8", "replace")] if self.bytes else [self.unknown]
                    low = end
                self.parts[unit] = np.array(found, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as unsigned 32-bit little-endian integers."""
        for cache in (self.units, self.parts):
            if len(cache) > CACHE:
                cache.clear()
        split = [UNIT.findall((MARK if self.prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        new = list(set().union(*split).difference(self.units))
        if new:
            # cut where no piece holds both characters
            text = "".join(new)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pair = codes[:-1] << 21 | codes[1:]
            held = np.append(self.bigrams, -1)[np.searchsorted(self.bigrams, pair)] == pair
            ends = np.cumsum([len(u) for u in new])
            cuts = np.union1d(np.flatnonzero(~held) + 1, ends)
            lows = [0, *cuts.tolist()]
            parts = [text[a:b] for a, b in zip(lows, lows[1:])]
            self._learn(list(set(parts).difference(self.parts)))
            raw = [self.parts[p] for p in parts]
            low = 0
            for unit, high in zip(new, np.searchsorted(cuts, ends, "right").tolist()):
                self.units[unit] = raw[low] if high == low + 1 else b"".join(raw[low:high])
                low = high
            for p in parts:
                if len(p) > LONG:
                    self.parts.pop(p, None)
        out = [b"".join(map(self.units.__getitem__, units)) for units in split]
        for u in new:
            if len(u) > LONG:
                del self.units[u]
        return out

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


@lru_cache(2)
def model(path: str) -> Model:
    """One a worker."""
    return Model(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text): their ids, and the text decoded from them."""
    def run(texts: list[str | None]) -> dict[str, list]:
        ids = [np.frombuffer(x, "<u4") for x in model(path).encode(texts)]
        return {"ids": ids, "decoded": [None if t is None else model(path).decode(x) for t, x in zip(texts, ids)]}

    return map_texts(docs, ["doc_id"], run, "ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Of each document: number and CRC-32 of its ids, and the SHA-256 of the text decoded from them."""
    path = tokenizer or public("piece_bpe_32k.model")

    def run(texts: list[str | None]) -> dict[str, list]:
        m = model(path)
        raw = m.encode(texts)
        back = [m.decode(np.frombuffer(x, "<u4")) for x in raw]
        return {
            "n_pieces": [len(x) // 4 for x in raw], "ids_crc32": [zlib.crc32(x) for x in raw],
            "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in back],
            "round_trip": [t == (s or "") for s, t in zip(texts, back)],
        }

    return map_texts(table(spark, sf_dir, "documents"), ["doc_id"], run, "n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
