"""SentencePiece encoding and decoding with seeded merge-dropout (operator 9).

A text is escaped as the library does it (a space becomes U+2581, one more goes in front) and cut into units where no
piece of the vocabulary can reach across: before a space that follows something else, and around characters that no
piece holds. In a unit, an agenda of candidate merges is worked off by score, then position. Each candidate that is still
valid when its turn comes is skipped if its keyed hash says so, at the dropout rate; what was skipped can't come back, so
larger pieces that need it don't form. Characters outside the vocabulary become byte pieces.

The hash is over the seed, doc_id, the unit's place in the text, the candidate's place in the unit and its piece. Equal
inputs therefore give equal segmentations on any cluster and after any retry, while the same word is cut differently from
place to place, each time by draws of its own. A rate of 0 gives the library's own segmentation. Every segmentation decodes
to the text it came from; a U+2581 that the text itself holds becomes byte pieces, so it does too.

A batch of texts is encoded in step. Its different units are worked off once without skips, which tells the candidates that
each of their occurrences would meet; only occurrences of which the hash skips one of these go through an agenda of their
own. Units of like length lie in a matrix, and in each round every unit works off the next candidate of its own agenda.
Long units go through the same agenda one by one.

Nulls: a null text is empty and has no pieces. A null doc_id counts as 0 for the hash. Repeated rows give equal results.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, text_of

RATE = 0.1
SEED = 17
SHORT = 48
SPACE = "▁"
AT_A_TIME = 1 << 20
# Odd multipliers and the steps of a 64-bit mixer.
OF_UNIT, OF_PIECE, OF_PLACE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
STEPS = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1))
MASK = 2**64 - 1
WIDTHS = (6, 8, 10, 12, 16, 24, SHORT)
NONE = np.iinfo(np.int32).max


def mixed(x: int) -> int:
    for shift, factor in STEPS:
        x = (x ^ x >> shift) * factor & MASK
    return x


def mixed_all(x: np.ndarray) -> np.ndarray:
    for shift, factor in STEPS:
        x = x ^ (x >> np.uint64(shift))
        if factor != 1:
            x *= np.uint64(factor)
    return x


class Pairs:
    """Which piece two pieces make, as an open hash table for arrays of pairs."""

    BITS = 20

    def __init__(self, ids: dict[str, int]) -> None:
        made = {(ids[p[:k]], ids[p[k:]]): piece for p, piece in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
        size = 1 << self.BITS
        while size < 4 * len(made):
            size *= 2
        self.mask = size - 1
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        places = self._place(np.array([a << 32 | b for a, b in made], np.int64)).tolist()
        for (a, b), at in zip(made, places):
            while self.keys[at] >= 0:
                at = (at + 1) & self.mask
            self.keys[at], self.values[at] = a << 32 | b, made[a, b]

    def _place(self, key: np.ndarray) -> np.ndarray:
        return ((key ^ (key >> 32) * 40503) * 2654435761 >> 12) & self.mask

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece each pair makes, -1 for none."""
        key = left.astype(np.int64) << 32 | right
        at = self._place(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], -1)
        open_ = np.flatnonzero((seen != key) & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (seen >= 0)]
        return out


class Numbers(dict):
    """Consecutive numbers for what is asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class Codec:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        self.byte_ids, self.ids, self.scores = {}, {}, {}
        for k, piece in enumerate(self.pieces):
            if model.is_byte(k):
                self.byte_ids[int(piece[3:-1], 16)] = k
            elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
                self.ids[piece] = k
                self.scores[piece] = -model.get_score(k)
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids) or len(self.byte_ids) != 256:
            raise ValueError("pieces with a space inside, or no byte pieces")
        bytes_of = {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.shown = [bytes_of.get(k) or piece.replace(SPACE, " ").encode() for k, piece in enumerate(self.pieces)]
        self.pairs = Pairs(self.ids)
        self.letters = np.full(0x110000, -1, np.int32)
        for piece, k in self.ids.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = k
        order = {x: k for k, x in enumerate(sorted(set(self.scores.values())))}
        self.turn = np.full(len(self.pieces) + 1, NONE, np.int32)  # when a piece's turn comes; never for the piece -1
        for piece, k in self.ids.items():
            self.turn[k] = order[self.scores[piece]]
        lone = "\n" if not any("\n" in piece for piece in self.ids) else ""
        self.units = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.seed, self.threshold = seed, min(int(rate * 2**64), MASK)

    def text_key(self, key: int) -> int:
        return xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), self.seed)

    @staticmethod
    def unit_key(text_key: int, number: int) -> int:
        """The key of a text's unit with this number."""
        return mixed((text_key ^ (number + 1) * OF_UNIT) & MASK)

    @staticmethod
    def unit_keys(text_key: int, first: int, n: int) -> np.ndarray:
        return mixed_all(np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(OF_UNIT) ^ np.uint64(text_key))

    def skipped(self, key: int, place: int, piece: int) -> bool:
        """The keyed hash's verdict on a candidate."""
        return mixed((key + piece * OF_PIECE + (place + 1) * OF_PLACE) & MASK) < self.threshold

    def skipped_all(self, keys: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        return mixed_all(keys + candidates) < np.uint64(self.threshold)

    @staticmethod
    def candidates(place: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """What a candidate adds to its unit's key."""
        return piece.astype(np.uint64) * np.uint64(OF_PIECE) + (place + 1).astype(np.uint64) * np.uint64(OF_PLACE)

    def merge(self, unit: str, key: int | None) -> tuple[tuple[int, ...], list[tuple[int, int]]]:
        """(piece ids, merges made as (place, piece)) by an agenda on a heap. key None: nothing is skipped."""
        scores, ids, n = self.scores, self.ids, len(unit)
        symbols: list[str | None] = list(unit)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(scores[pair], k, pair) for k in range(n - 1) if (pair := unit[k : k + 2]) in scores]
        heapq.heapify(agenda)
        made = []
        while agenda:
            _, k, pair = heapq.heappop(agenda)
            left = symbols[k]
            if left is None or (j := after[k]) >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            if key is not None and self.skipped(key, k, ids[pair]):
                continue
            made.append((k, ids[pair]))
            symbols[k], symbols[j] = pair, None
            after[k] = far = after[j]
            if far < n:
                before[far] = k
                if (longer := pair + symbols[far]) in scores:
                    heapq.heappush(agenda, (scores[longer], k, longer))
            if (back := before[k]) >= 0 and (longer := symbols[back] + pair) in scores:
                heapq.heappush(agenda, (scores[longer], back, longer))
        return self._ids([s for s in symbols if s is not None]), made

    def _ids(self, symbols: list[str]) -> tuple[int, ...]:
        try:
            return tuple([self.ids[s] for s in symbols])
        except KeyError:
            return tuple(k for s in symbols for k in ((self.ids[s],) if s in self.ids else (self.byte_ids[b] for b in s.encode())))

    def units_of(self, text: str) -> Iterator[list[str]]:
        """The units of a text, in parts that its own U+2581 divide."""
        for part in (" " + text).split(SPACE) if text else ():
            yield self.units.findall(part.replace(" ", SPACE))

    def encode(self, text: str, key: int = 0) -> list[int]:
        """Piece ids; key: what tells this text from others, such as its doc_id."""
        start, number, out = self.text_key(key), 0, []
        for part, units in enumerate(self.units_of(text)):
            if part:
                out += (self.byte_ids[b] for b in SPACE.encode())
            for unit in units:
                out += self.merge(unit, self.unit_key(start, number))[0]
                number += 1
        return out

    def encode_units(self, units: list[str], which: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units[which], each under its own key, or without skips: (ids one after the other, how many each has, candidates of the merges made, how many each has)."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        widths, n = sizes[which], len(which)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # (of which, ids)
        made: list[tuple[np.ndarray, np.ndarray]] = []  # (of which, candidates)
        for low, width in zip((0, *WIDTHS), WIDTHS):
            pick = np.flatnonzero((widths > low) & (widths <= width))
            if not len(pick):
                continue
            own, place = np.unique(which[pick], return_inverse=True)
            codes = np.array([units[k] for k in own], f"<U{width}").view(np.uint32).reshape(-1, width).astype(np.int64)
            letters = self.letters[codes]
            letters = np.where(np.arange(width) < sizes[own, None], np.where(letters < 0, -2 - codes, letters), -1).astype(np.int32)
            for at in range(0, len(pick), 16384):
                rows = pick[at : at + 16384]
                merged, of, candidates = self._merge_in_step(letters[place[at : at + 16384]], widths[rows], None if keys is None else keys[rows])
                alive = merged != -1
                found.append((np.repeat(rows, alive.sum(1)), merged[alive]))
                made.append((rows[of], candidates))
        for k in np.flatnonzero(widths > WIDTHS[-1]):
            ids, merges = self.merge(units[which[k]], None if keys is None else int(keys[k]))
            found.append((np.full(len(ids), k), np.array(ids, np.int32)))
            if keys is None and merges:
                made.append((np.full(len(merges), k), self.candidates(*np.array(merges, np.int64).T)))
        ids, counts = gathered(found, n, np.int32)
        return *self._with_bytes(ids, counts), *gathered(made, n, np.uint64)

    def _with_bytes(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary, as -2 - code point among the ids, become byte pieces."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, counts
        different, inverse = np.unique(ids[odd], return_inverse=True)
        pieces = [[self.byte_ids[b] for b in chr(-2 - c).encode()] for c in different.tolist()]
        sizes = np.array(list(map(len, pieces)))
        many = np.ones(len(ids), np.int64)
        many[odd] = sizes[inverse]
        values = np.r_[ids, np.concatenate(pieces).astype(np.int32)]
        starts = np.arange(len(ids))
        starts[odd] = len(ids) + (np.cumsum(sizes) - sizes)[inverse]
        owner = np.repeat(np.arange(len(counts)), counts)
        return spread(values, starts, many, np.arange(len(ids))), np.bincount(owner, many, len(counts)).astype(np.int64)

    def _merge_in_step(self, symbols: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pieces at the places of their first characters, -1 elsewhere, one row for each unit; rows and candidates of the merges made, if none is skipped)."""
        n, width = symbols.shape
        none = np.empty(0, np.int64), np.empty(0, np.uint64)
        if width == 1:
            return symbols, *none
        symbols = np.c_[symbols, np.full(n, -1, np.int32)]  # a place that stands for what isn't there
        makes = self.pairs(symbols[:, : width - 1].ravel(), symbols[:, 1:width].ravel()).reshape(n, width - 1)
        makes = np.c_[makes, np.full(n, -1, np.int32)]
        turn = self.turn[makes]
        after = np.minimum(np.arange(1, width + 1)[None, :], sizes[:, None])
        after[after == sizes[:, None]] = width
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        rows = np.arange(n)
        made: list[tuple[np.ndarray, np.ndarray]] = []
        while len(rows):
            place = turn[rows].argmin(1)
            going = turn[rows, place] < NONE
            rows, place = rows[going], place[going]
            r, k = rows, place
            piece = makes[r, k]
            candidates = self.candidates(k, piece)
            if keys is None:
                made.append((r, candidates))
            else:
                skip = self.skipped_all(keys[r], candidates)
                turn[r[skip], k[skip]] = NONE
                r, k, piece = r[~skip], k[~skip], piece[~skip]
            gone = after[r, k]
            far = after[r, gone]
            symbols[r, k], symbols[r, gone] = piece, -1
            turn[r, gone] = NONE
            after[r, k] = far
            inner = far < width
            before[r[inner], far[inner]] = k[inner]
            longer = np.full(len(r), -1, np.int32)
            longer[inner] = self.pairs(piece[inner], symbols[r[inner], far[inner]])
            makes[r, k], turn[r, k] = longer, self.turn[longer]
            back = before[r, k]
            inner = back >= 0
            r, back = r[inner], back[inner]
            longer = self.pairs(symbols[r, back], piece[inner])
            makes[r, back], turn[r, back] = longer, self.turn[longer]
        return symbols[:, :width], *(np.concatenate(x) for x in zip(none, *made))

    def encode_batch(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin, and the end)."""
        known = Numbers({"": 0})  # the unit 0 stands for the text's own U+2581
        numbers, own_keys, ends = [], [], [0]
        for text, key in zip(texts, keys):
            start, first = self.text_key(key), 0
            for part, units in enumerate(self.units_of(text)):
                if part:
                    numbers.append(np.zeros(1, np.int64))
                    own_keys.append(np.zeros(1, np.uint64))
                numbers.append(np.fromiter(map(known.__getitem__, units), np.int64, len(units)))
                own_keys.append(self.unit_keys(start, first, len(units)))
                first += len(units)
            ends.append(len(numbers))
        if not numbers:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        lengths = np.r_[0, np.cumsum([len(x) for x in numbers])]
        number, key = np.concatenate(numbers), np.concatenate(own_keys)
        names = list(known)
        ids, counts, candidates, many = self.encode_units(names, np.arange(len(names)), None)
        mark = np.array([self.byte_ids[b] for b in SPACE.encode()], np.int32)
        ids, counts = np.r_[mark, ids], np.r_[len(mark), counts[1:]]
        hit = self._hit(number, key, candidates, many)
        again, again_counts, _, _ = self.encode_units(names, number[hit], key[hit])
        ids, counts = np.r_[ids, again], np.r_[counts, again_counts]
        number[hit] = len(names) + np.arange(len(hit))
        flat = spread(ids, np.cumsum(counts) - counts, counts, number)
        sums = np.r_[0, np.cumsum(counts[number])]
        return flat, sums[lengths[ends]]

    def _hit(self, number: np.ndarray, keys: np.ndarray, candidates: np.ndarray, many: np.ndarray) -> np.ndarray:
        """The occurrences (unit's number, key) of which a candidate is skipped; some at a time."""
        found, starts, all_ends = [], np.cumsum(many) - many, np.cumsum(many[number])
        at = 0
        while at < len(number):
            stop = max(at + 1, int(np.searchsorted(all_ends, (all_ends[at - 1] if at else 0) + AT_A_TIME, "right")))
            some, n = number[at:stop], many[number[at:stop]]
            verdict = self.skipped_all(np.repeat(keys[at:stop], n), spread(candidates, starts, many, some))
            found.append(at + np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(verdict), "right")))
            at = stop
        return np.concatenate(found) if found else np.empty(0, np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text, without the space in front."""
        return b"".join(map(self.shown.__getitem__, ids)).decode()[1:]


def gathered(parts: list[tuple[np.ndarray, np.ndarray]], n: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values one after the other by owner, how many each of n owners has) from parts (owner, values)."""
    owner, values = (np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, kind), zip(*parts) if parts else ((), ())))
    return values[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


def spread(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs values[start : start + count] one after the other, in the given order."""
    many = counts[order]
    ends = np.cumsum(many)
    return values[np.repeat(starts[order] - ends + many, many) + np.arange(ends[-1] if len(ends) else 0)]


@lru_cache(4)
def codec(path: str, rate: float, seed: int) -> Codec:
    return Codec(path, rate, seed)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoded(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the piece ids of each row."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, rate, seed)
        for batch in batches:
            ids, ends = use.encode_batch(batch.column(1).to_pylist(), [doc or 0 for doc in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t")), run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) from piece ids; null ids give an empty text."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, 0.0, SEED)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use.decode(k or []) for k in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return map_batches(rows.select(F.col(key).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")), run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None, rate: float = RATE, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, lossless): ids as little-endian 32-bit numbers; lossless: decoding gave the text back."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(path, rate, seed)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            flat, ends = use.encode_batch(texts, [doc or 0 for doc in batch.column(0).to_pylist()])
            digests, same = [], []
            for t, a, b in zip(texts, ends, ends[1:]):
                ids = flat[a:b]
                digests.append(hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())
                same.append(use.decode(ids.tolist()) == t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "lossless"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t")), run, "doc_id long, n_pieces long, ids_sha256 string, lossless boolean")
