"""Skip edges of the field between notations of several words."""

import numpy as np
import pytest

from tradeweave.llm import personal

FILLER = " and then some words " * 40


@pytest.fixture(scope="module")
def field():
    """Fitted on texts in which numbers are mentioned twice, others stand alone."""
    cards, phones = ["4111 1111 1111 1111", "5500005555555559"], ["+44 20 7946 0958", "+1 (234) 567-8901"]
    seen = [f"pay {c} now or {k} later, {c} call {p} or {p} in {k} {k + 1} days" for c in cards for p in phones for k in range(100)]
    return personal.fit(seen)


def added(field, text):
    (base, spans), *_ = personal.find(field, [text])
    return [(kind, text[s:e]) for kind, s, e in spans if (kind, s, e) not in base]


@pytest.mark.parametrize(
    "first, again",
    [
        ("4111 1111 1111 1111", "4111.1111.1111.1111"),
        ("4111111111111111", "4111. 1111. 1111. 1111"),
        ("4111 1111 1111 1111", "4111/1111/1111/1111"),
        ("+44 20 7946 0958", "020 7946 0958"),
        ("+44 20 7946 0958", "20 7946 0958"),
        ("+44 20 7946 0958", "(020) 7946.0958"),
        ("10.0.0.1", "10-0-0-1"),
    ],
)
def test_edges_between_notations(first, again):
    for text in (f"{first}{FILLER}{again} end", f"{again}{FILLER}{first} end"):
        words = personal.Words.none()
        personal.add_words(words, 0, text, personal.base_spans(text))
        later = [n for n, back in enumerate(words.back) if back >= 0]
        assert later and all(words.label[n] == 0 or words.label[words.back[n]] == 0 for n in later), text
        assert all(any(words.back[m] == n for m in later) or n in later for n, y in enumerate(words.label) if y == 0) or len(words.label) > 2


def test_grouped_card_reaches_another_notation(field):
    text = f"card 4111 1111 1111 1111{FILLER}4111.1111.1111.1111 end"
    assert added(field, text) == [("card", "4111.1111.1111.1111")]


def test_grouped_phone_without_its_prefix(field):
    text = f"call +44 20 7946 0958{FILLER}020 7946 0958 end"
    assert added(field, text) == [("phone", "020 7946 0958")]


def test_other_numbers_have_no_edge():
    words = personal.Words.none()
    text = f"call +44 20 7946 0958 or 10.0.0.1{FILLER}020 7946 0959 and 10001 and 1-0-0-10 and 7946 end"
    personal.add_words(words, 0, text, personal.base_spans(text))
    assert set(words.back) == {-1}


def test_a_known_number_reaches_far_mentions(field):
    """Each mention is one edge from the known one, whether that is first, last or between; the first
    word may stay out where many of its copies look like other numbers."""
    again = [f"{FILLER}020 7946 0958 end"] * 60
    for at in (0, 30, 60):
        text = "".join([*again[:at], f"{FILLER}+44 20 7946 0958 end", *again[at:]])
        found = added(field, text)
        assert len(found) == 60 and all(k == "phone" and t.endswith("7946 0958") for k, t in found), at


def test_messages_cross_a_long_chain():
    """Messages need as many rounds as the chain has words; there is no other edge."""
    chain = np.zeros((personal.LABELS, personal.LABELS))
    np.fill_diagonal(chain, 8.0)
    field = personal.Field(np.zeros((len(personal.FEATURES), personal.LABELS)), chain, 0.0)
    words = personal.Words.none()
    personal.add_words(words, 0, " ".join(f"a{k}" for k in range(100)), [("phone", 0, 2)])
    lone = np.zeros((personal.LABELS, personal.LABELS))
    lone[:] = chain
    lone[0, 0] = 0  # so that the end has no O beside it
    got, unsettled = personal.settled_beliefs(personal.Field(field.own, lone, 0.0), words)
    assert not unsettled and got[-1].argmax() == 4


def test_a_document_does_not_depend_on_its_neighbours(field):
    own = f"call +44 20 7946 0958{FILLER}020 7946 0958 end or 12 13 14 15 4111 1111"
    far = " ".join(f"{k} a{k} 4111 1111 1111 1111 b{k} 4111.1111.1111.1111" for k in range(100))
    def chances(*texts):
        words = personal.Words.none()
        for n, text in enumerate(texts):
            personal.add_words(words, n, text, personal.base_spans(text))
        return personal.beliefs(field, words)[[d == 0 for d in words.document]]
    assert np.allclose(chances(own), chances(own, far), atol=1e-9, rtol=0)


def test_what_does_not_settle_is_marked(field, monkeypatch):
    monkeypatch.setattr(personal, "TURNS", 2)
    (_, _, plain), (_, _, open_one) = personal.find_settled(field, ["none", f"+44 20 7946 0958{FILLER}020 7946 0958"])
    assert plain and not open_one
