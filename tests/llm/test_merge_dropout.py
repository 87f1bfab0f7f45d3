import hashlib
import random

import numpy as np
import pytest
import sentencepiece
import xxhash

from sitewright.llm import merge_dropout as MD
from tests.llm.fixtures import docs, texts

PARTS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "日", "😀", "\x00", "the", "ing", " the", "...", "123", "\r\n", "　", "aaaaaaaaaa", "x" * 60]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MD.model_path())


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_without_dropout_as_the_library(library):
    codec = MD.Codec(MD.model_path(), rate=0.0)
    cases = [x for x in [*strings(2000, 1), *filter(None, texts())] if "▁" not in x]
    assert all(codec.encode(x) == library.encode(x) for x in cases)
    flat, ends = codec.encode_batch(cases, [0] * len(cases))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == [library.encode(x) for x in cases]


def test_lossless_varied_and_repeatable():
    codec, again = MD.Codec(MD.model_path()), MD.Codec(MD.model_path())
    cases = [*strings(2000, 2), *(t or "" for t in texts())]
    encoded = [codec.encode(x, k) for k, x in enumerate(cases)]
    assert [codec.decode(x) for x in encoded] == cases
    flat, ends = again.encode_batch(cases, list(range(len(cases))))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == encoded
    word = "the internationalisation of things " * 40
    cuts = {tuple(codec.encode(word, k)) for k in range(10)}
    assert len(cuts) == 10 and codec.encode(word, 3) == again.encode(word, 3)
    assert codec.encode(word, 3) != MD.Codec(MD.model_path(), seed=99).encode(word, 3)


def test_rates():
    text = "the quick brown foxes were jumping over lazy dogs " * 50
    sizes = [len(MD.Codec(MD.model_path(), rate=r).encode(text, 1)) for r in (0.0, 0.1, 0.5, 1.0)]
    assert sizes == sorted(sizes) and sizes[0] < sizes[1] and sizes[-1] == len(text) + 1


def mixer(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plainly(codec, text, key, rate, seed):
    """Merge-dropout from its definition: look at all pairs each time, take the best, ask the hash."""
    start, out, number = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed), [], 0
    for part, piece_of_text in enumerate((" " + text).split("▁") if text else ()):
        out += [codec.byte_ids[b] for b in "▁".encode()] if part else []
        for unit in codec.units.findall(piece_of_text.replace(" ", "▁")):
            unit_key = mixer((start ^ (number + 1) * 0x9E3779B97F4A7C15) % 2**64)
            number += 1
            symbols, skipped = [(k, c) for k, c in enumerate(unit)], set()
            while True:
                pairs = [(codec.scores[x + y], k, n) for n, ((k, x), (_, y)) in enumerate(zip(symbols, symbols[1:])) if x + y in codec.scores and (k, x + y) not in skipped]
                if not pairs:
                    break
                _, k, n = min(pairs)
                pair = symbols[n][1] + symbols[n + 1][1]
                if mixer((unit_key + codec.ids[pair] * 0xD6E8FEB86659FD93 + (k + 1) * 0xA0761D6478BD642F) % 2**64) < rate * 2**64:
                    skipped.add((k, pair))
                else:
                    symbols[n : n + 2] = [(k, pair)]
            for _, x in symbols:
                out += [codec.ids[x]] if x in codec.ids else [codec.byte_ids[b] for b in x.encode()]
    return out


@pytest.mark.parametrize("rate", (0.1, 0.5))
def test_against_the_definition(rate):
    codec = MD.Codec(MD.model_path(), rate=rate)
    cases = [x for x in [*strings(300, 4), *(t or "" for t in texts())] if len(x) < 2000]
    expected = [plainly(codec, x, k, rate, MD.SEED) for k, x in enumerate(cases)]
    assert [codec.encode(x, k) for k, x in enumerate(cases)] == expected
    flat, ends = codec.encode_batch(cases, list(range(len(cases))))
    assert [flat[a:b].tolist() for a, b in zip(ends, ends[1:])] == expected


def test_a_word_keeps_its_variety():
    """Draws are independent: no merge of the plain run is skipped as often as chance has it, and a long word has many cuts."""
    codec = MD.Codec(MD.model_path())
    unit = "▁internationalisation"
    plain, made = codec.merge(unit, None)
    keys = [codec.unit_key(codec.text_key(k), 0) for k in range(4000)]
    untouched = [not any(codec.skipped(key, *m) for m in made) for key in keys]
    assert abs(sum(untouched) / 4000 - 0.9 ** len(made)) < 0.03
    cuts = [codec.merge(unit, key)[0] for key in keys]
    assert all(cut == plain for cut, same in zip(cuts, untouched) if same) and len(set(cuts)) > 60
    assert all(abs(sum(codec.skipped(key, *m) for key in keys) / 4000 - 0.1) < 0.02 for m in made)


def test_table(spark, library):
    frame = docs(spark, clash=True)
    rows = MD.round_trips(frame).collect()
    codec = MD.Codec(MD.model_path())
    expected = sorted(((d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True) for d in docs(spark).collect() for ids in [codec.encode(d.text or "", d.doc_id or 0)]), key=repr)
    assert sorted(((r.doc_id, r.n_pieces, r.ids_sha256, r.lossless) for r in rows), key=repr) == expected
    back = MD.decoded(MD.encoded(frame)).collect()
    assert sorted((repr(r.doc_id), r.text) for r in back) == sorted((repr(r.doc_id), r.text or "") for r in docs(spark).collect())
    assert MD.round_trips(frame.where("false")).count() == 0 and MD.encoded(frame.where("false")).count() == 0
