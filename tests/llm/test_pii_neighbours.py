"""Personal data next to spans of the strict patterns."""

import pytest

from semilat.llm import pii


@pytest.mark.parametrize("text", ["212-555-0134 10.0.0.1", "10.0.0.1 212-555-0134", "4111 1111 1111 1111 (212) 555-0134", "call 212-555-0134 10.0.0.1 (212) 555-0188 10.0.0.2"])
def test_phones_next_to_strict_spans(text):
    base = pii.strict_spans(text)
    assert base
    added = pii.added_spans(text, base, pii.trained())
    rest = text
    for _, s, e in base:
        rest = rest[:s] + "#" * (e - s) + rest[e:]
    assert {text[s:e] for k, s, e in added if pii.KINDS[k] == "phone"} == {p for p in ("212-555-0134", "(212) 555-0134", "(212) 555-0188") if p in rest}
    assert all(e <= s2 or e2 <= s for _, s, e in added for _, s2, e2 in base)
