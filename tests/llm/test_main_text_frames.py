"""Pages that mention or hold article elements without their text being in one."""

import pytest

from cellmorph.llm.html_text import main_text

BODY = "".join(f"<p>Paragraph {i} of the body has a good many words.</p>" for i in range(6))
WANT = "\n\n".join(f"Paragraph {i} of the body has a good many words." for i in range(6))


@pytest.mark.parametrize("other", ["<!-- <article> -->", "<script>var x = '<main>';</script>", "<article></article>"])
def test_articles_without_text_hide_nothing(other):
    assert main_text(f"<body>{other}<div>{BODY}</div></body>") == WANT


def test_teaser_cards_do_not_hide_the_body():
    text = main_text(f"<body><div>{BODY}</div><article><h3>Next</h3></article><article><h3>More</h3></article></body>")
    assert text.startswith(WANT)
