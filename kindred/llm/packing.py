"""Packing documents into windows of a fixed number of tokens by the sum-of-squares rule.

Csirik et al. (2006): with N(h) open windows of fill h, an item goes where the sum of N(h)^2 grows least. The counts
stand in one array over the fill levels; a placement is one vectorised minimum over it.

Each task packs its own rows in one pass, so there is no shuffle and no state beyond the windows still open. What is
left in open windows at a task's end is joined by cutting: the emptiest windows fill the holes of the fullest, and
the last remainder is cut at powers of two, which need no padding. Every window tells what closed it: the rule, a
document that fills it alone, or cutting.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.bytefeatures import EXACT, located_words, parts
from kindred.llm.shared import batch, lean, small_batches, texts

WINDOW = 2048
#: Open windows a task holds at most. With one more, the fullest is closed by cutting; the rule goes on with all others.
MAX_OPEN = 8192
#: Words a worker remembers the ids of (about 25 bytes each); beyond, those go that it has not met since it last made room.
MAX_WORDS = 2_000_000
#: Characters encoded together.
CHARS_AT_ONCE = 1 << 19
FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed_by string"


class WordIds:
    """Token ids of texts, word by word from a bounded memory.

    Holds for tokenizers in which white space separates and then vanishes, as in word-level BPE with word ends. Words are
    told apart by 64-bit hashes; their ids lie end to end in one array, from which whole texts are gathered at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # for lower-case letters nothing is left to normalise and nothing to split: blanks alone part words
        light = json.loads(self.tokenizer.to_str())
        light |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, _byte_level(light)]}}
        self.light = Tokenizer.from_str(json.dumps(light))
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self) -> None:
        """Of word i: where its ids begin and how many they are. runs: sorted hashes and the words they are of."""
        self.ids, self.at, self.n, self.met = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]

    def encode(self, documents: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.at) > MAX_WORDS:
            self._make_room()
        plain = [x if x.isascii() else _WIDE_BLANKS.sub(" ", x) for x in documents]
        x, begin, end, h, starts = located_words(plain, (), EXACT)
        hashes, first, which = np.unique(h[:, 0], return_index=True, return_inverse=True)
        word = self._find(hashes)
        new = np.flatnonzero(word < 0)
        if len(new):
            raw = x.tobytes()
            self._learn([raw[a:b].decode() for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist(), strict=True)], hashes[new])
            word = self._find(hashes)
        self.met[word] = True
        each = word[which]
        n = self.n[each]
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = self.ids[np.repeat(self.at[each] - bounds[:-1], n) + np.arange(bounds[-1])].astype("<u4").tobytes()
        cuts = (4 * bounds[np.searchsorted(begin, starts)]).tolist()
        return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The words of sorted hashes, -1 for those not known."""
        out = np.full(len(hashes), -1)
        for known, words in self.runs:
            if len(known):
                i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[i] == hashes
                out[hit] = words[i[hit]]
        return out

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Words that aren't known, each once: from the ids of their parts, which are looked up or made first."""
        both = list(map(_plain, words))
        parts = list(set(chain.from_iterable(both)) - {""})
        ids: dict[str, bytes] = {"": b""}
        part_hashes = located_words([" ".join(parts)], (), EXACT)[3][:, 0]
        order = np.argsort(part_hashes)
        for i, word in zip(order.tolist(), self._find(part_hashes[order]).tolist(), strict=True):
            if word >= 0:
                ids[parts[i]] = self.ids[self.at[word] : self.at[word] + self.n[word]].tobytes()
        unknown = [x for x in parts if x not in ids]
        letters = [x for x in unknown if x.isalpha() and x.islower() and is_normalized("NFC", x)]
        for i in range(0, len(letters), 8192):
            # letters alone are one run, whose last token ends a word: the ends part the ids of many words
            part = letters[i : i + 8192]
            found = np.array(self.light.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            at = np.concatenate([[0], np.flatnonzero(self.ends[found]) + 1])
            if len(at) == len(part) + 1:
                self._split(ids, part, found, at)
        rest = [x for x in unknown if x not in ids]
        for i in range(0, len(rest), 8192):
            part = rest[i : i + 8192]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            self._split(ids, part, np.array(e.ids, self.kind), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)))
        place = {p: i for i, p in enumerate(parts)}
        added = dict(zip(hashes.tolist(), (ids[x] + ids[end] for x, end in both), strict=True))
        added.update((int(part_hashes[place[x]]), ids[x]) for x in unknown)
        self._add(added)

    def _split(self, into: dict[str, bytes], words: list[str], ids: np.ndarray, at: np.ndarray) -> None:
        raw, at = ids.tobytes(), (at * ids.itemsize).tolist()
        into.update((w, raw[a:b]) for w, a, b in zip(words, at, at[1:], strict=False))

    def _add(self, added: dict[int, bytes]) -> None:
        """Learn the ids of hashes that aren't known."""
        raw = list(added.values())
        n = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind().itemsize
        first = len(self.at)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n.astype(np.int32)])
        self.met = np.concatenate([self.met, np.ones(len(n), bool)])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(raw), self.kind)])
        self._insert(1, np.fromiter(added, np.uint64, len(added)), np.arange(first, len(self.at), dtype=np.int32))
        if len(self.runs[1][0]) > 1 << 16:  # the small run goes into the large one
            self._insert(0, *self.runs[1])
            self.runs[1] = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _insert(self, run: int, hashes: np.ndarray, words: np.ndarray) -> None:
        h, w = (np.concatenate(x) for x in zip(self.runs[run], (hashes, words), strict=True))
        order = np.argsort(h, kind="stable")
        self.runs[run] = h[order], w[order]

    def _make_room(self) -> None:
        """Forget the words not met since this was last done; all, if these are few."""
        hashes, words = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        keep = self.met[words]
        hashes, words = hashes[keep], words[keep]
        ids, at, n = self.ids, self.at[words], self.n[words]
        self._forget()
        if len(words) <= MAX_WORDS // 2:
            bounds = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            self.ids, self.at, self.n, self.met = ids[np.repeat(at - bounds[:-1], n) + np.arange(bounds[-1])], bounds[:-1], n, np.zeros(len(n), bool)
            self._insert(0, hashes, np.arange(len(words), dtype=np.int32))


def _plain(word: str) -> tuple[str, str]:
    """A word and an ending that together have the word's ids: "The,!" has those of "the" and of ",!".

    Signs behind a letter or digit are a token run of their own, but for those that may be part of a contraction or of a
    special token. Letters are lower-cased, one by one: sigma, which isn't, stays as it is, and so does a word whose length
    would change.
    """
    body = word.rstrip(_SIGNS)
    if not body[-1:].isalnum() or body[-1] == "İ":  # in lower case it ends with a mark, which is one run with the signs
        body = word
    end = word[len(body) :]
    if body.isascii():
        return (body.lower() if "<" not in body else body), end
    low = body.lower()
    return (low if body.isalpha() and "Σ" not in body and len(low) == len(body) else body), end


def _byte_level(tokenizer: dict) -> dict:
    """The step of a tokenizer that turns bytes into letters."""
    return next(x for x in tokenizer["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")


_SIGNS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


#: White space beyond ASCII, as Unicode defines it.
_WIDE_BLANKS = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD_IDS: dict[str, WordIds] = {}


class Window(list):
    """The pieces of a window that is done; by: what closed it (RULE, ALONE, CUT)."""

    def __init__(self, pieces: list, by: str):
        super().__init__(pieces)
        self.by = by


RULE, ALONE, CUT = "rule", "alone", "cut"


class SumOfSquares:
    """Online packing of pieces (key, start, ids). Full windows leave at once through take()."""

    def __init__(self, window: int = WINDOW, max_open: int = MAX_OPEN):
        self.window, self.max_open = window, max_open
        self.count = np.zeros(window + 1)  # open windows by fill; level `window` stays at -0.5: a full window costs nothing
        self.count[window] = -0.5
        self.at: list[list[list]] = [[] for _ in range(window)]
        self.open, self.done = 0, []  # the number of open windows, and those that are done

    def add(self, key: tuple, ids: bytes) -> None:
        """Cut off whole windows; place the rest."""
        size, n = self.window, len(ids) // 4
        whole = n - n % size
        for s in range(0, whole, size):
            self.done.append(Window([(key, s, ids[4 * s : 4 * (s + size)])], ALONE))
        if n > whole:
            self._place((key, whole, ids[4 * whole :]), n - whole)

    def _place(self, piece: tuple, s: int) -> None:
        c, top = self.count, self.window - s
        cost = np.where(c[1 : top + 1] > 0, c[s + 1 : top + s + 1] - c[1 : top + 1], np.inf)
        h = 0
        if top > 0:
            h = top - int(np.argmin(cost[::-1]))  # of equal costs, the fullest window
            # moving a window from h to h + s adds 2 (N(h+s) - N(h)) + 2, a new window 2 N(s) + 1
            if not 2 * cost[h - 1] + 2 <= 2 * c[s] + 1:
                h = 0
        if h:
            pieces = self.at[h].pop()
            c[h] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + s == self.window:
            self.done.append(Window(pieces, RULE))
        else:
            self._put(h + s, pieces)
            if self.open > self.max_open:
                self._relieve()

    def _put(self, fill: int, pieces: list) -> None:
        self.at[fill].append(pieces)
        self.count[fill] += 1
        self.open += 1

    def _pull(self, fill: int) -> list:
        self.count[fill] -= 1
        self.open -= 1
        return self.at[fill].pop()

    def _pour(self, source: list, pieces: list, room: int) -> int:
        """Move pieces from the end of source to pieces, the last cut where there is no more room; how many tokens moved."""
        moved = 0
        while source and moved < room:
            key, start, ids = source.pop()
            n = len(ids) // 4
            fits = min(n, room - moved)
            pieces.append((key, start, ids[: 4 * fits]))
            moved += fits
            if fits < n:
                source.append((key, start + fits, ids[4 * fits :]))
        return moved

    def _relieve(self) -> None:
        """Close the fullest open window with what the emptiest hold."""
        fill = int(np.flatnonzero(self.count[1 : self.window] > 0)[-1]) + 1
        pieces = self._pull(fill)
        while fill < self.window and self.open:
            had = int(np.flatnonzero(self.count[1 : self.window] > 0)[0]) + 1
            source = self._pull(had)
            moved = self._pour(source, pieces, self.window - fill)
            fill += moved
            if source:
                self._put(had - moved, source)
        if fill == self.window:
            self.done.append(Window(pieces, CUT))
        else:
            self._put(fill, pieces)

    def _join(self) -> None:
        """Fill the fullest open windows with what the emptiest hold, cutting pieces at the holes."""
        left = [(h, pieces) for h in range(self.window - 1, 0, -1) for pieces in self.at[h]]
        self.at, self.open = [[] for _ in range(self.window)], 0
        self.count[: self.window] = 0
        lo, hi = len(left) - 1, 0
        while hi < lo:
            fill, pieces = left[hi]
            while fill < self.window and hi < lo:
                had, source = left[lo]
                moved = self._pour(source, pieces, self.window - fill)
                fill += moved
                left[lo] = (had - moved, source)
                if not source:
                    lo -= 1
            if fill == self.window:
                self.done.append(Window(pieces, CUT))
                hi += 1
            else:
                left[hi] = (fill, pieces)
        if hi == lo and left:
            self._cut_at_powers(left[hi][1], left[hi][0])

    def _cut_at_powers(self, pieces: list, fill: int) -> None:
        pieces = pieces[::-1]
        for bit in (1 << k for k in reversed(range(fill.bit_length())) if fill >> k & 1):
            out: list = []
            self._pour(pieces, out, bit)
            self.done.append(Window(out, CUT))

    def take(self) -> list[list]:
        out, self.done = self.done, []
        return out

    def finish(self) -> list[list]:
        self._join()
        return self.take()


def pack(docs: DataFrame, key: str, text: str, tokenizer_path: str, end_id: int = 1, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """docs -> one row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, closed_by and, if with_ids, ids.

    A null text is an empty one; every document ends with end_id, so an empty one still has one token. A null key
    stays null; repeated rows are packed each. Documents longer than a window give whole windows and a rest. ids are
    the piece's token ids. closed_by tells what filled the window: rule (the sum of squares), alone (a long document), cut. sequence_id is the task's number times 2^40 plus a count; a task that is run again gives
    the same windows, as it reads the same rows. An empty table gives no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    out = own.mapInArrow(lean(_packer(tokenizer_path, end_id, window, with_ids)), f"key {kind}, {FIELDS}" + ", ids binary" * with_ids)
    return out.withColumnRenamed("key", key)


def _packer(path: str, end_id: int, window: int, with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _WORD_IDS.get(path) or _WORD_IDS.setdefault(path, WordIds(path))
        packer, number, end = SumOfSquares(window), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        kind = None

        def rows(windows: list[list]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for first in range(0, len(windows), 256):
                out: list[tuple] = []
                for pieces in windows[first : first + 256]:
                    at = 0
                    for (key, total), start, ids in pieces:
                        n = len(ids) // 4
                        out.append((key, start, n, zlib.crc32(ids), total, number, at, pieces.by, ids))
                        at += n
                    number += 1
                cols = [list(c) for c in zip(*out, strict=True)]
                names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed_by"] + ["ids"] * with_ids
                yield batch(dict(zip(names, zip(cols, (kind, *[pa.int64()] * 6, pa.string(), pa.binary()), strict=True), strict=False)))

        for b in batches:
            kind = b.schema.field(0).type
            keys, docs = b.column(0).to_pylist(), texts(b.column(1))
            for first, last in parts(docs, CHARS_AT_ONCE):
                for key, ids in zip(keys[first:last], words.encode(docs[first:last]), strict=True):
                    packer.add((key, len(ids) // 4 + 1), ids + end)
                yield from rows(packer.take())
        if kind is not None:
            yield from rows(packer.finish())

    return run
