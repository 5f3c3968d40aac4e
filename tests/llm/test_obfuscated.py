"""Every match of the e-mail generator is proposed, whatever else the text holds."""

import pytest

from quern.llm import pii


@pytest.mark.parametrize("address", ["jane.doe ( at ) example.com", "x [ at ] site [dot] org", "jane at example.com", "a(at)b.cd", "a at b dot cd", "a@b.cd"])
def test_generator_is_reached(address):
    text = f"write to {address} today"
    expected = [("email", m.start(), m.end()) for m in pii._MORE[-1][1].finditer(text)]
    assert expected and pii.candidates(text, []) == expected


def test_plain_prose_has_no_candidate():
    assert pii.candidates("look at that. meet me at noon, Mr. Dot", []) == []
