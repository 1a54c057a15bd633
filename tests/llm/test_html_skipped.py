from __future__ import annotations

import pytest

from threadlake.llm.html_blocks import leaf_blocks
from threadlake.llm.html_text import Extractor, trained


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><svg class="i"/><p>Body</p><p>More</p></article>', ["Body", "More"]),
        ("<p>a <math/>b</p><p>c</p>", ["a b", "c"]),
        ("<article><object data=x><p>Body</p></article><p>After</p>", ["Body", "After"]),
        ("<article><video src=x><p>Body</p></article><p>After</p><video>no</video>", ["Body", "After"]),
        ("<video-js>a</video-js><title-card>b</title-card><template-x>c</template-x><p>d</p>", ["abc", "d"]),
        ("<svg-icon>a</svg-icon><p>b</p>", ["a", "b"]),
        ("<svg><title/><style/><g><text>no</text></g></svg><p>a</p>", ["a"]),
        ("<p>a <svg><text>no</text></svg>b <object><p>no</p><div>no</object>c</p><p>d</p>", ["a b c", "d"]),
        ("<ul><li>a<template><li>no</template> b<li>c</ul>", ["a b", "c"]),
        ("<object><video>no<object>no</object></object><p>a</p>", ["a"]),
        ("<p>a <button>no</button>b</p><textarea>no <p>no</textarea><p>c</p>", ["a b", "c"]),
        ("<label>no <input></label><select><option>no<option>no</select><p>a</p>", ["a"]),
        ("<datalist><option>no</datalist><article><button><p>a</p></article><p>b</p>", ["a", "b"]),
        ("<script>x</script-y></p></SCRIPT ><p>a</p><style>rest <p>b</p>", ["a"]),
    ],
)
def test_skipped_elements(page, want):
    assert [b.text for b in leaf_blocks(page)] == want


def test_links_in_skipped_elements():
    (block,) = leaf_blocks("<p>a <video><a href=x>no</a></video>b</p>")
    assert (block.links, block.link_chars, [e.tag for e in block.path]) == (0, 0, ["p"])


def test_main_text_keeps_the_rest_of_the_article():
    story = "<h1>Big story</h1>{}<p>First paragraph of it.</p><p>One more paragraph of it.</p>"
    page = "<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article>{}</article><footer><p>Foo.</p></footer></body></html>"
    want = "Big story\nFirst paragraph of it.\nOne more paragraph of it."
    extract = Extractor(trained()).text
    for inner in ('<svg class="i"/>', "<object data=x>", "<video src=x>", "<svg><text>no</text></svg>", "<textarea>hidden</textarea>"):
        assert extract(page.format(story.format(inner))) == want
