import random

import pytest
from tokenizers import Tokenizer

from sitewright.llm import token_counts
from tests.llm.fixtures import docs, texts

PARTS = ["a", "b", "s", "t", "re", "'", "''", "'s", "'ll", "'ve", "'r", " ", "  ", "\n", "\t", " ", "　", "1", "23", "é", "ß", "日本", "語", "!", "...", "<|endoftext|>", "<|endof", "e", "r", "the ", "ing", "don't", "😀", "́", "²", "Ⅷ", "-----", "aaaa", "\x1c", "\x85", "​", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.vocabulary_path())


@pytest.fixture(scope="module")
def machine():
    return token_counts.compiled(token_counts.vocabulary_path())


def test_counts_equal_the_library(machine, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        expected = len(library.encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == expected, text
        assert machine.count(text, chunk=rng.choice((1, 2, 3, 5, 8))) == expected, text


def test_chunk_maps_compose_in_any_order(machine):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(PARTS[:-12]) for _ in range(rng.randint(3, 30)))
        i, j = sorted(rng.sample(range(1, len(text)), 2))
        a, b, c = machine.chunk_map(text, 0, i), machine.chunk_map(text, i, j), machine.chunk_map(text, j, len(text))
        whole = machine.compose(text, machine.compose(text, a, b), c)
        assert whole == machine.compose(text, a, machine.compose(text, b, c))
        assert whole.change == machine.run(machine.start, text)[1]


def test_a_long_text_without_spaces_holds_no_copies(machine, library):
    rng = random.Random(3)
    text = "".join(rng.choice(("日", "本", "語", "文", "章", "計", "算")) for _ in range(100_000))
    maps = [machine.chunk_map(text, at, at + 1000) for at in range(0, len(text), 1000)]
    assert [(m.at, m.head, m.end) for m in maps[1:]] == [(at, at + 1000, None) for at in range(1000, len(text), 1000)]
    assert machine.count(text) == machine.combined(text, maps).change == len(library.encode(text, add_special_tokens=False).ids)


def test_dropped_spans_change_nothing(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_SPANS", 3)
    for text in [t for t in texts() if t][:12]:
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_dropped_table_of_states_changes_nothing(library):
    small = token_counts.compiled.__wrapped__(token_counts.vocabulary_path())
    small.max_states = 50
    for text in [t for t in texts() if t]:
        assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_table(spark, library):
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs(spark, clash=True)).collect()}
    rows = {(r.doc_id, r.text or "") for r in docs(spark).collect()}
    assert found == {(d, len(t.encode()), n, n > 1024) for d, t in rows for n in [len(library.encode(t, add_special_tokens=False).ids)]}
    assert token_counts.token_counts(docs(spark).where("false")).count() == 0
