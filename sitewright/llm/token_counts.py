"""Token counts by a finite-state tokenizer (operator 2).

A byte-level BPE vocabulary is compiled, state by state as texts need them, into a deterministic transducer over code
points. Each transition carries the change of the token count of the text read so far, so a count is one walk and one
running sum. A state is the scanner's place in the pre-tokenizer's pattern and the part of the pretoken that can still
change: the bytes from which a vocabulary entry may yet grow, with the last token and relative count at each of them.
The last token after a byte is the one whose junction with the token before it is stable, meaning that no merge across
the junction comes before the merges on its sides; there is exactly one. That keeps the automaton finite. The table of
states is bounded: at `max_states` it is dropped and grows again.

Where white space follows something else, or letters and numbers meet other signs (but for an apostrophe before a letter),
every state does the same. A text is cut there into spans, which are the letters of a coarser transducer with one state:
the count of a span that comes again is one look-up, and only a span that is new is walked letter by letter.

Long texts are cut into chunks. A chunk becomes a map of states: the head, whose reading depends on the state before
it, and after the first place where any state does the same, a constant state and count. A head is a range of the text,
never a copy, and neighbouring heads make one range, so a map takes the same room for every text. Maps compose
associatively and are combined pair by pair, in the rounds of a parallel prefix scan's up-sweep; its last prefix is the
whole count, so the others aren't made. Memory stays with the text, one chunk's spans and the bounded tables.

A null text is empty: 0 bytes, 0 tokens. Special strings inside texts are single tokens, as the library has it by
default. Repeated rows give repeated results; an empty table an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.common import map_batches, text_of

LIMIT = 1024
CHUNK = 65536
MAX_STATES = 160_000
MAX_SPANS, LONG_SPAN = 300_000, 64
# Fixed values of the pre-tokenizer's pattern: what may follow an apostrophe that begins a token.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PAIR = 32
START, LETTERS, NUMBERS, OTHERS, SPACES, APOSTROPHE = range(6)
EMPTY = (b"", (None,), (0,))
_WHITE = "".join(map(re.escape, sorted(WHITE)))
# White space and then a run of letters and numbers or a run of other signs; an apostrophe keeps what it may contract.
SPANS = re.compile(f"[{_WHITE}]*(?:[^\\W_]+|(?:(?![{_WHITE}])[\\W_])+(?:(?<=')[^\\W_]+)?)|[{_WHITE}]+")
BOUNDARY = re.compile(f"(?<![{_WHITE}])[{_WHITE}]")


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(spare)}


class State(dict):
    """Transitions by code point: (next state, change of the count)."""

    __slots__ = ("machine", "what")

    def __missing__(self, letter: str) -> tuple[State, int]:
        what, change = self.machine.step(self.what, letter)
        self[letter] = found = (self.machine.state(what), change)
        return found


class Spans(dict):
    """Counts of spans, each read from the start. Long ones aren't kept; a full table becomes `older`, from which what comes again is taken back."""

    __slots__ = ("machine", "older")

    def __missing__(self, span: str) -> int:
        count = self.older.get(span)
        if count is None:
            count = self.machine.run(self.machine.start, span)[1]
            if len(span) > LONG_SPAN:
                return count
        if len(self) >= MAX_SPANS:
            self.older = dict(self)
            self.clear()
        self[span] = count
        return count


class ChunkMap(NamedTuple):
    """What a chunk does: text[at:head] is read from the state before it; what follows, if anything does, adds `change` and ends in `end`."""

    at: int
    head: int
    change: int = 0
    end: State | None = None


class Transducer:
    def __init__(self, vocabulary: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: list[str], max_states: int = MAX_STATES) -> None:
        self.vocabulary, self.specials, self.max_states = vocabulary, specials, max_states
        self.rank = {vocabulary[a] << PAIR | vocabulary[b]: r for r, (a, b) in enumerate(merges)}
        self.made = {vocabulary[a + b]: (r, vocabulary[a], vocabulary[b]) for r, (a, b) in enumerate(merges)}
        self.growing = {t[:k] for t in vocabulary for k in range(1, len(t))}
        self.spines: tuple[dict, dict] = ({}, {})
        self.stable: dict[int, bool] = {}
        self.states: dict[tuple, State] = {}
        self.letters: dict[str, tuple[tuple, int]] = {}
        self.start = self.state((START, EMPTY))
        self.spans = Spans()
        self.spans.machine, self.spans.older = self, {}

    def state(self, what: tuple) -> State:
        found = self.states.get(what)
        if found is None:
            if len(self.states) >= self.max_states:
                for s in self.states.values():
                    s.clear()
                self.states.clear()
                self.stable.clear()
                self.letters.clear()
            found = self.states[what] = State()
            found.machine, found.what = self, what
        return found

    # --- byte-pair merges

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """What stands at the right (0) or left (1) edge of a token in the course of its merges, with the rank that ends it. On the right edge, as the left half of a pair."""
        found = self.spines[side].get(token)
        if found is None:
            shift = 0 if side else PAIR
            found, end, at = [(token << shift, float("inf"))], None, token
            while at in self.made:
                end, left, right = self.made[at]
                at = left if side else right
                found.append((at << shift, end))
            self.spines[side][token] = found
        return found

    def joins(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart: no merge across their junction comes in time."""
        pair = left << PAIR | right
        found = self.stable.get(pair)
        if found is None:
            found = self.stable[pair] = self._apart(left, right)
        return found

    def _apart(self, left: int, right: int) -> bool:
        rank, edges = self.rank.get, self.spines[1].get(right) or self.spine(right, 1)
        for a, a_end in self.spines[0].get(left) or self.spine(left, 0):
            for b, b_end in edges:
                q = rank(a | b)
                if q is not None and q < a_end and q <= b_end:
                    return False
        return True

    def advance(self, key: tuple, more: bytes) -> tuple[tuple, int]:
        """The part of a pretoken that can still change, after more bytes, and the change of its count."""
        window, last, counts = key
        vocabulary, growing, joins = self.vocabulary.get, self.growing, self.joins
        total = 0
        for k in range(len(more)):
            window += more[k : k + 1]
            at = 0
            for before in last:
                token = vocabulary(window[at:] if at else window)
                if token is not None and (before is None or joins(before, token)):
                    break
                at += 1
            else:
                raise ValueError("the vocabulary lacks a byte")
            change = counts[at] + 1
            cut, size = 0, len(window)
            while cut < size and window[cut:] not in growing:
                cut += 1
            if cut:
                window = window[cut:]
            last = (*last[cut:], token)
            counts = (*[c - change for c in counts[cut:]], 0)
            total += change
        return (window, last, counts), total

    # --- the scanner

    @staticmethod
    @lru_cache(4096)
    def kind(letter: str) -> int:
        if letter in WHITE:
            return SPACES
        category = unicodedata.category(letter)[0]
        return LETTERS if category == "L" else NUMBERS if category == "N" else OTHERS

    def fresh(self, text: str, kind: int) -> tuple[tuple, int]:
        """A pretoken that begins here."""
        found = self.letters.get(text)
        if found is None:
            key, count = self.advance(EMPTY, text.encode())
            what = (SPACES, key, EMPTY, text, count, True) if kind == SPACES else (APOSTROPHE if text == "'" else kind, key)
            found = self.letters[text] = (what, count)
        return found

    def step(self, what: tuple, letter: str) -> tuple[tuple, int]:
        kind, new = what[0], self.kind(letter)
        if kind == SPACES:
            _, key, before, last, last_count, single = what
            if new == SPACES:
                longer, change = self.advance(key, letter.encode())
                return (SPACES, longer, key, letter, change, False), change
            if last == " ":  # the last space goes with what follows
                joined, count = self.advance(EMPTY, (last + letter).encode())
                return (new, joined), count - last_count
            following, count = self.fresh(letter, new)
            return following, count if single else count - last_count + self.fresh(last, SPACES)[1]
        if kind == APOSTROPHE:
            if letter in CONTRACTIONS:
                return (START, EMPTY), self.fresh("'" + letter, OTHERS)[1] - self.fresh("'", OTHERS)[1]
            if any(c[0] == letter for c in CONTRACTIONS):
                (_, key), count = self.fresh(letter, new)
                return (LETTERS, key, letter), count
            if new == OTHERS:
                key, change = self.advance(what[1], letter.encode())
                return (OTHERS, key), change
            return self.fresh(letter, new)
        if kind == LETTERS and len(what) > 2 and what[2] + letter in CONTRACTIONS:
            return (START, EMPTY), self.fresh("'" + what[2] + letter, OTHERS)[1] - self.fresh("'", OTHERS)[1] - self.fresh(what[2], LETTERS)[1]
        if kind == new:
            key, change = self.advance(what[1], letter.encode())
            return (kind, key), change
        return self.fresh(letter, new)

    # --- texts

    def run(self, state: State, text: str) -> tuple[State, int]:
        count = 0
        for letter in text:
            state, change = state[letter]
            count += change
        return state, count

    def chunk_map(self, text: str, at: int, stop: int) -> ChunkMap:
        """The map of text[at:stop]. The first chunk is read from the start and has no head."""
        first = BOUNDARY.search(text, at, stop) if at else None
        if at and first is None:
            return ChunkMap(at, stop)
        begin = first.start() if first else at
        *closed, last = SPANS.findall(text, begin, stop)  # the last span may go on in the next chunk
        end, change = self.run(self.start, last)
        return ChunkMap(at, begin, sum(map(self.spans.__getitem__, closed)) + change, end)

    def compose(self, text: str, first: ChunkMap, second: ChunkMap) -> ChunkMap:
        if first.end is None:
            return ChunkMap(first.at, second.head, second.change, second.end)
        end, change = first.end, 0
        for at in range(second.at, second.head, CHUNK):
            end, more = self.run(end, text[at : min(at + CHUNK, second.head)])
            change += more
        return ChunkMap(first.at, first.head, first.change + change + second.change, second.end or end)

    def combined(self, text: str, maps: list[ChunkMap]) -> ChunkMap:
        """All maps as one: in each round neighbours become one map."""
        while len(maps) > 1:
            pairs = [self.compose(text, *maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        parts = [text]
        for special in self.specials:
            parts = [piece for part in parts for piece in part.split(special)] if special in text else parts
        total = len(parts) - 1
        for part in parts:
            if len(part) <= chunk:
                total += sum(map(self.spans.__getitem__, SPANS.findall(part)))
            else:
                total += self.combined(part, [self.chunk_map(part, at, min(at + chunk, len(part))) for at in range(0, len(part), chunk)]).change
        return total


@lru_cache(2)
def compiled(path: str) -> Transducer:
    """The transducer of a tokenizers file with a byte-level BPE model."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or spec["normalizer"]:
        raise ValueError("a plain byte-level BPE tokenizer is asked for")
    letters = byte_letters()
    to_bytes = lambda token: bytes(letters[c] for c in token)
    specials = [t["content"] for t in spec["added_tokens"]]
    vocabulary = {to_bytes(t): i for t, i in model["vocab"].items() if t not in specials}
    merges = [tuple(map(to_bytes, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return Transducer(vocabulary, merges, sorted(specials, key=len, reverse=True))


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row. path: the tokenizer's file, on every executor."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            counts = pa.array([machine.count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("t"))
    return map_batches(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
