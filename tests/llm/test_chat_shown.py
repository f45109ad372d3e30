"""The shown text of a conversation can be read back without its ids."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from colferry.llm import chat_format as chat

PIECES = st.text(st.sampled_from("\\\\#<|/turn> Asitan:[]\n"), max_size=25)
ROLE = st.one_of(st.sampled_from(["user", "assistant", "critic", "a\\", "\\\\", "### [", "x]:\n", "</turn>\\"]), PIECES)
MARK = re.compile(r"(?<!\\)(?:### (System|User|Assistant|Tool):\n|### \[)")


def read_shown(text):
    """Turns of a shown text: marks are control strings without a backslash before them."""
    out, at = [], 0
    while at < len(text):
        m = MARK.match(text, at)
        if m[1]:
            role, at = m[1].lower(), m.end()
        else:
            end = re.compile(r"(?<!\\)\]:\n").search(text, m.end())
            role, at = chat.unescape(text[m.end() : end.start() - 1]), end.end()
        end = re.compile(r"(?<!\\)</turn>").search(text, at)
        out.append((role, chat.unescape(text[at : end.start() - 1])))
        at = end.end() + 1
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(ROLE, PIECES), max_size=4))
def test_shown_text_reads_back(turns):
    shown = "".join(chat.show(chat.encode_turn(r, t)[0]) for r, t in turns)
    assert read_shown(shown) == turns
