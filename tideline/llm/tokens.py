"""Token ids of whole texts by the ``tokenizers`` library, over Arrow batches.

A tokenizer is read once on the driver from a path that is a parameter and goes to the tasks as its JSON text. Texts are
cut into pieces at places where every pre-tokenizer in use must cut too, each new piece is encoded by the library, and
its ids are kept in a cache of bounded size; the concatenated ids equal those of the whole text. A Python worker keeps the
cache from task to task of the encoders, and drops it when a task of another operator begins.

Safe cuts, *spaces kept* (byte-level BPE): before a space, and before a line break, that stands alone between two
characters that are no white space. A text with any other white space takes the cuts of a regular expression instead.
Safe cuts, *spaces dropped* (word BPE): at blanks, tabs and line breaks, which that pre-tokenizer discards; it also
lowers the case, so texts of Latin letters are lowered before they are cut. In both, a cut between a Latin letter or an
ASCII digit and trailing punctuation, as their classes differ.

Defined results: null and empty texts have no ids; equal texts have equal ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_PIECES = 400_000
LONG_PIECE = 200
SLICE_BYTES = 4 << 20
ENCODE_BYTES = 8 << 20
PUNCTUATION = ".,;:!?|"
ALONE = re.compile(r"(?<=\S)(?= \S)")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
CLASSED = frozenset(map(chr, [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)]))
REGULAR = re.compile(r"\0?\n?\S(?:.*\S)?", re.DOTALL)


def read_tokenizer(path: str) -> str:
    """The JSON text of a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        return file.read()


@functools.lru_cache(maxsize=2)
def load_tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    return tokenizer


class PieceEncoder:
    """Ids of texts as little-endian 32-bit integers, piece by piece.

    A batch is split and its distinct pieces are found by Arrow; only those meet the cache, and the ids of all pieces
    are then gathered in one step.
    """

    def __init__(self, spec: str, keep_spaces: bool):
        self.tokenizer = load_tokenizer(spec)
        self.keep_spaces = keep_spaces
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what the cache held when it was last full; what is used again goes back

    def _split(self, texts: list[str]) -> pa.ListArray:
        """Keys of the cache; the ids of a text are those of its pieces, end to end."""
        if not self.keep_spaces:
            flat = pa.array([t if BEYOND_LATIN.search(t) else t.lower() for t in texts], pa.large_string())
            for blank in "\n\r\t":
                flat = pc.replace_substring(flat, blank, " ")
            return pc.split_pattern(flat, " ")
        # a piece after a blank is kept without it; the first piece, and those of the regular expression, are marked
        flat = pc.replace_substring(pa.array(["\0" + t for t in texts], pa.large_string()), "\n", " \n")
        return pc.split_pattern(flat, " ")

    def _spelled(self, pieces: list[str]) -> list[str]:
        """The texts that keys stand for."""
        if not self.keep_spaces:
            return pieces
        return [p[1:] if p[0] == "\0" else p if p[0] == "\n" else " " + p for p in pieces]

    def _unknown(self, pieces: Iterable[str]) -> list[str]:
        """Those of distinct pieces that are in neither cache; those of the older one move to the newer one."""
        cache, older = self.cache, self.older
        pieces = [p for p in pieces if p not in cache]
        if not older:
            return pieces
        cache.update((p, older[p]) for p in pieces if p in older)
        return [p for p in pieces if p not in older]

    def _learn(self, new: list[str]) -> list[str]:
        """Put distinct pieces in the cache; the long ones among them."""
        stems = {p: stem for p in new if (stem := p.rstrip(PUNCTUATION)) is not p and stem and stem[-1] in CLASSED}
        mark = "\0" if self.keep_spaces else ""
        tails = {p: mark + p[len(stem) :] for p, stem in stems.items()}
        whole = [p for p in new if p not in stems]
        whole += self._unknown({*stems.values(), *tails.values()}.difference(whole))
        found = self.tokenizer.encode_batch_fast(self._spelled(whole), add_special_tokens=False)
        self.cache.update(zip(whole, [array("I", e.ids).tobytes() for e in found], strict=True))
        self.cache.update((p, self.cache[stem] + self.cache[tails[p]]) for p, stem in stems.items())
        return [p for p in (*whole, *stems) if len(p) > LONG_PIECE]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        cache, texts = self.cache, [t or "" for t in texts]
        lists = self._split(texts)
        codes = lists.flatten().dictionary_encode()
        pieces = codes.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
        at = codes.indices.to_numpy(zero_copy_only=False)
        edges = lists.offsets.to_numpy(zero_copy_only=False)
        edges = edges - edges[0]
        values = list(map(cache.get, pieces))
        missing = [k for k, v in enumerate(values) if v is None]
        new = self._unknown([pieces[k] for k in missing])
        odd = {k for k, t in enumerate(texts) if "\0" in t} if self.keep_spaces else set()
        if self.keep_spaces and new:
            # white space at an end, but for one line break before a character; such pieces are never kept
            bad = {p for p in new if not p.isalpha() and not REGULAR.fullmatch(p)}
            if bad:
                new = [p for p in new if p not in bad]
                marks = np.zeros(len(pieces), dtype=bool)
                marks[[k for k in missing if pieces[k] in bad]] = True
                odd |= set((np.searchsorted(edges, marks[at].nonzero()[0], side="right") - 1).tolist())
        marked = {k: ["\0" + x for x in ALONE.split(texts[k])] if texts[k] else [] for k in odd}
        if marked:
            new += self._unknown({p for x in marked.values() for p in x}.difference(new))
        long = self._learn(new)
        for k in missing:
            values[k] = cache.get(pieces[k], b"")
        sizes = np.fromiter(map(len, values), dtype=np.int32, count=len(values)) // 4
        pool = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.frombuffer(b"".join(values), dtype="<u4"))
        taken = pool.take(codes.indices)
        ids, cuts = taken.flatten().to_numpy(), taken.offsets.to_numpy()[edges].tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for k, chunks in marked.items():
            out[k] = np.frombuffer(b"".join([cache[c] for c in chunks]), dtype="<u4")
        for piece in long:
            cache.pop(piece, None)
        return out


def give_back() -> None:
    """Return freed memory to the system. Python workers live on from task to task, beside those of other operators."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


_KEPT: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(spec: str, keep_spaces: bool) -> PieceEncoder:
    """The encoder that this Python worker keeps; one at a time. For tasks under ``bounded(.., encodes=True)``."""
    if (spec, keep_spaces) not in _KEPT:
        _KEPT.clear()
        _KEPT[spec, keep_spaces] = PieceEncoder(spec, keep_spaces)
    return _KEPT[spec, keep_spaces]


def forget() -> None:
    """Drop the encoder that this Python worker keeps."""
    _KEPT.clear()


def bounded(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, in a Python worker that serves many operators: what earlier ones kept goes before its task,
    and its own memory after it. Only the encoder's cache stays, until a task that does not encode."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            forget()
        yield from run(batches)
        give_back()

    return task


def slices(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows and about ``size`` bytes, so that what is made from long texts stays small."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
