"""Whole texts to token ids, quickly: a text falls apart where the tokenizer's own pattern
always cuts, and each different piece goes through the tokenizers library once.

Texts with characters that Python's patterns and the library's might class differently
fall apart at safe spaces first: both tokenizers here start a new word at a space between
two characters that are not white space. What holds such a character is encoded undivided.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import files
from .common import saved

#: Pieces kept by a worker, beyond which those that did not occur lately go, and their longest; pieces that are encoded as one text.
PIECES, LONG, JOINED = 400_000, 48, 1000
#: Rows and bytes of texts that are encoded at a time, but for a text that is longer alone.
ROWS, BYTES = 1000, 1 << 23
_ODD = r"\s\x1c-\x1f\x85\u180e\u200b-\u200f\u2028\u2029\ufeff"
SAFE = re.compile(f"(?<=[^{_ODD}]) (?=[^{_ODD}])")
#: A space that isn't safe, as Arrow's expressions have it, whose \\s is white space of ASCII only.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
UNSAFE = rf"(?:\A|[{_WHITE}]) | (?:\z|[{_WHITE}])"
#: The patterns by which the two tokenizers cut, for characters of plain().
SPACED = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
ENDED = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: ENDED, and spaces.
MARKED = re.compile(" |" + ENDED.pattern)

#: How byte-level tokenizers write bytes: those that show nothing, in order, as the characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTES_AS = {b: chr(b) if b in _SHOWN else chr(256 + sum(c not in _SHOWN for c in range(b))) for b in range(256)}


@lru_cache(1)
def plain() -> re.Pattern:
    """Texts of characters that Python and the library class alike, that stay one when lower-cased and never compose."""
    def alike(c: str) -> bool:
        kind = unicodedata.category(c)[0]
        if kind == "L":
            fine = re.match(r"[^\W\d_]", c)
        elif kind == "N":
            fine = re.match(r"\d", c)
        else:
            fine = c in " \t\n\r" or kind in "PS" and re.match(r"[^\s\w]|_", c)
        return bool(fine) and unicodedata.is_normalized("NFC", c) and len(c.lower()) == 1 and c != "\u03a3"

    near = [*range(0x600), *range(0x2010, 0x2028), *range(0x20A0, 0x20C0), *range(0x3041, 0x3100), *range(0x4E00, 0xA000)]
    return re.compile("[" + "".join(re.escape(chr(i)) for i in near if alike(chr(i))) + "]+")


class Encoder:
    """Ids as bytes, each an unsigned 32-bit little-endian integer."""

    def __init__(self, path: str, spaces: bool):
        """spaces: a space belongs to the word after it, a line break stands alone; else texts are lower-cased and a word's last id says that it ends."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.space = Tokenizer.from_file(path), " " if spaces else ""
        self.spaces, self.pattern, self.mark = spaces, SPACED if spaces else ENDED, "\n" if spaces else " "
        self.size = 1 + max(self.tokenizer.get_vocab().values(), default=0)
        self.direct = self._by_bytes()
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.cuts = np.zeros(self.size, bool)
        if spaces:
            self.cuts[self.tokenizer.encode("\n", add_special_tokens=False).ids] = True
        else:
            self.cuts[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        #: Of kept pieces those that occurred lately, and those before.
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _by_bytes(self) -> bool:
        """Whether a piece's ids are those that the model gives for its bytes, each written as a character."""
        from tokenizers.models import BPE

        before, after = self.tokenizer.pre_tokenizer, self.tokenizer.post_processor
        if not isinstance(self.tokenizer.model, BPE) or before is None or after is not None or self.tokenizer.truncation or self.tokenizer.padding:
            return False
        state = json.loads(before.__getstate__())
        last = state.get("pretokenizers", [state])[-1]
        return last["type"] == "ByteLevel" and not last["add_prefix_space"]

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces without white space but a first space: by the library's model alone, if it takes characters for bytes;
        else many make one text, cut again after the ids that say so."""
        out: list[bytes] = []
        if self.direct:
            as_bytes = "\n".join(pieces).encode().decode("latin-1").translate(BYTES_AS)
            ids, ends, tokenize = [], [0], self.tokenizer.model.tokenize
            for x in as_bytes.split(BYTES_AS[10]) if pieces else ():
                ids += [t.id for t in tokenize(x)]
                ends.append(4 * len(ids))
            raw = np.array(ids, "<u4").tobytes()
            return [raw[a:b] for a, b in zip(ends, ends[1:])]
        for at in range(0, len(pieces), JOINED):
            some = pieces[at : at + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(some) + self.mark], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.cuts[ids])
            if len(ends) != len(some):
                out += self._plain(some)
                continue
            raw, starts = ids.tobytes(), np.append(0, ends[:-1] + 1) * 4
            ends = ends * 4 if self.spaces else ends * 4 + 4
            out += [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        return out

    def _cut(self, text: str, undivided: set[str]) -> list[str]:
        """The pieces of a text or part; adds those that aren't to be joined with others."""
        fine = plain().fullmatch
        if fine(text) and not self.special.search(text):
            return self.pattern.findall(text if self.spaces else text.lower())
        out = []
        for i, p in enumerate(SAFE.split(text)):
            part = self.space + p if i else p
            if fine(p) and not self.special.search(p):
                out += self.pattern.findall(part if self.spaces else part.lower())
            else:
                out.append(part)
                undivided.add(part)
        return out

    def _looked_up(self, some: Iterable[str]) -> list[str]:
        """Those that aren't kept; those that are belong to the younger half from now on."""
        out = []
        for x in some:
            if x not in self.pieces:
                if x in self.older:
                    self.pieces[x] = self.older[x]
                else:
                    out.append(x)
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of different parts: those that are no kept pieces are cut, and each different new piece is encoded once."""
        if len(self.pieces) > PIECES // 2:
            self.pieces, self.older = {}, self.pieces
        fresh, fine = self._looked_up(parts), plain().fullmatch
        n = len(self.space)
        together = [p for p in fresh if p.rfind(" ") == n - 1 and len(p) > n and p.strip() == p[n:]]
        text = "".join(together) if n else " ".join(["", *together])
        if together and not (fine(text) and not self.special.search(text)):
            together = [p for p in together if fine(p) and not self.special.search(p)]
            text = "".join(together) if n else " ".join(["", *together])
        # one text of all parts that are cut by the pattern: each begins with the one space in it
        flat = (self.pattern if n else MARKED).findall(text if n else text.lower())
        undivided: set[str] = set()
        whole = set(together)
        others = [p for p in fresh if p not in whole]
        cut = [self._cut(p, undivided) for p in others]
        new = self._looked_up(set(flat).union(*cut))
        alone = [x for x in new if x in undivided or x.isspace()]
        joined = [x for x in new if not (x in undivided or x.isspace())]
        self.pieces.update(zip(alone, self._plain(alone)))
        self.pieces.update(zip(joined, self._apart(joined)))
        made = {p: b"".join(map(self.pieces.__getitem__, c)) for p, c in zip(others, cut)}
        ids = list(map(self.pieces.__getitem__, flat))
        at = np.append(np.append(0, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))[[i for i, x in enumerate(flat) if x[0] == " "]], -1).tolist()
        raw = b"".join(ids)
        at[-1] = len(raw)
        made.update(zip(together, [raw[a:b] for a, b in zip(at, at[1:])]))
        out = [made[p] if p in made else self.pieces[p] for p in parts]
        for x in new:
            if len(x) > LONG:
                del self.pieces[x]
        return out

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's begin and end; null: no ids.

        Texts all of whose spaces are safe fall apart at these in Arrow; others are one part. What part stands where is
        numbers from there on, so Python sees a batch's different parts only."""
        parts = pc.split_pattern(texts.cast(pa.large_string()), " ")
        odd = pc.fill_null(pc.match_substring_regex(texts, UNSAFE), False)
        if pc.any(odd).as_py():
            whole = pc.split_pattern(pc.if_else(odd, texts, None).cast(pa.large_string()), "\0", max_splits=0)
            parts = pc.if_else(odd, whole, parts)
        ends = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(parts), 0).to_numpy()))
        found = parts.flatten().dictionary_encode()
        places = found.indices.to_numpy()
        names = found.dictionary.to_numpy(zero_copy_only=False)
        if self.spaces:  # of each text the first part has no space before it
            starts = ends[:-1][ends[:-1] < ends[1:]]
            first, at = np.unique(places[starts], return_inverse=True)
            places = places.copy()
            places[starts] = len(names) + at
            names = [*map(" ".__add__, names.tolist()), *names[first].tolist()]
        else:
            names = names.tolist()
        ids = self._known(names)
        taken = pa.array(ids, pa.large_binary()).take(pa.array(places))
        _, offsets, data = taken.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(taken) + 1) if len(taken) else np.zeros(1, np.int64)
        return np.frombuffer(data or b"", "<u4"), offsets[ends] // 4

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Null: no ids."""
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())]


#: This worker's encoders.
_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, spaces: bool) -> Encoder:
    """One a worker."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = Encoder(path, spaces)
    return _ENCODERS[path, spaces]


def forget() -> None:
    """Lets the pieces go that this worker keeps; the worker goes on to other work, which needs the memory."""
    for e in _ENCODERS.values():
        e.pieces, e.older = {}, {}


def public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sliced(b: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """A batch in parts of ROWS and BYTES of the column `text` at most."""
    ends = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(), dtype=np.int64))
    low = 0
    while low < b.num_rows:
        high = min(low + ROWS, max(low + 1, int(np.searchsorted(ends, ends[low] + BYTES, "right")) - 1))
        yield b.slice(low, high - low)
        low = high


def stored(docs: DataFrame, path: str, spaces: bool, folder: str) -> DataFrame:
    """Encodes docs (mark int, doc_id, text), as they lie, once: a file of ids for each partition; the manifest (place, file)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, stream, writer = TaskContext.get().partitionId(), None, None
        width = "<u2" if encoder(path, spaces).size <= 1 << 16 else "<u4"
        name = f"{folder}/ids-{place:06d}-{uuid.uuid4().hex}.arrows"  # another try of this task writes another file
        try:
            for b in batches:
                for part in sliced(b, 2):
                    ids, ends = encoder(path, spaces).encoded(part.column(2))
                    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends * np.dtype(width).itemsize), pa.py_buffer(ids.astype(width))])
                    out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), ids], names=["mark", "doc_id", "ids"]).replace_schema_metadata({"width": width})
                    if stream is None:
                        stream = files.create(name)
                        writer = pa.ipc.new_stream(stream, out.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                    writer.write_batch(out)
        finally:
            if stream is not None:
                writer.close()
                stream.close()
        if stream is not None:
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "file": [name]})
        pa.default_memory_pool().release_unused()  # the worker goes on to other work

    return saved(docs.mapInArrow(run, "place long, file string"), "ids")


def loaded(name: str) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Marks, doc_ids and ids of the batches of a file of stored()."""
    with files.reader(name) as f, pa.ipc.open_stream(f) as stream:
        width = stream.schema.metadata[b"width"].decode()
        for b in stream:
            yield b.column(0).to_pylist(), b.column(1).to_pylist(), [np.frombuffer(x, width).astype("<u4") for x in b.column(2).to_pylist()]


def by_file(manifest: DataFrame) -> DataFrame:
    """A task for each file, or nearly."""
    return manifest.repartition(max(1, manifest.count()))
