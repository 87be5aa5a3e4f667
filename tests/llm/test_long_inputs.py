"""Very long texts and pages: defined results in bounded time and memory; foreign pages labelled by hand."""

import random
import re
import resource
import subprocess
import sys
import time

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import html_crf, packing, quality_cnn

# ------------------------------------------------------------------ op2


def test_pieces_score_as_the_whole(monkeypatch):
    rng = np.random.default_rng(1)
    p = quality_cnn.init_params()
    for size in (0, 1, 127, 128, 129, 700, 5000, 128 * 40):
        data = rng.integers(0, 256, size).astype(np.uint8)
        whole = quality_cnn.forward(p, *quality_cnn.blocks_of(data, np.array([0, size])))[0]
        for piece in (1, 3, 7):
            monkeypatch.setattr(quality_cnn, "PIECE", piece)
            assert quality_cnn.long_logit(p, data) == pytest.approx(float(whole), abs=1e-5)


def test_a_64_mb_text_is_scored_in_bounded_memory():
    code = (
        "import resource, pyarrow as pa\nfrom folioscope.llm import quality_cnn as q\n"
        "column = pa.array(['some words of prose. ' * (64 * 1024 * 1024 // 21)])\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\n"
        "score = q.score_rows(q.init_params(), column)\n"
        "assert 0 <= score[0] <= 1\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(done.stdout) < 500


# ------------------------------------------------------------------ op6


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "word " * 5 + "\t" * 1_500_000 + "end"], ids=["spaces", "newlines", "letters", "tabs"])
def test_long_runs_are_encoded_whole(text):
    encode = packing.encoder(packing.tokenizer_path())
    want = encode.whole.encode(text, add_special_tokens=False).ids
    assert encode.ids(text).tolist() == want


# ------------------------------------------------------------------ op10

#: The same tags by one backtracking pattern, which is quadratic on bad pages.
_SLOW = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>""",
    re.S,
)


def test_tags_are_those_of_the_plain_pattern():
    rng = random.Random(0)
    bits = ["<div>", "</div>", "<a href='x'>", "<a ", '"', "'", ">", "<", "<!--", "-->", "<!x", "</", "text ", " a=b ", "<br/>", "<ul class=\"nav\">", "=", "/"]
    for _ in range(20_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        want = [(m.start(), m.end(), m[1] or m[4] or "", (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in _SLOW.finditer(page)]
        assert list(html_crf.tokens(page)) == want, page


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, "<div>x" * 180_000, '<a "' * 260_000, "<!" * 500_000, "<div>x</b>" * 110_000, "<script>" + "</script" * 120_000, "<div>" * 50_000 + "<p>x<div></div>" * 50_000, "<b>" * 300_000 + "<li>x", "<article><p>" + "A sentence, of words. " * 50_000],
    ids=["open tags", "nested", "quotes", "declarations", "stray ends", "script", "paragraphs", "inline", "long block"],
)
def test_a_page_of_a_megabyte_takes_seconds(page):
    model = html_crf.default_model()
    begin = time.process_time()
    html_crf.main_text(page, model)
    assert time.process_time() - begin < 15


#: Pages in the manner of common publishing systems, none drawn from the training grammar, with the text that a reader would call the article.
FOREIGN = [
    (
        '<!DOCTYPE html><html lang="en"><head><title>Tides</title><meta charset=utf-8></head><body class="single"><div id="masthead"><a href="/">The Daily</a></div>'
        '<nav class="main-navigation"><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Weather</a></li></ul></nav>'
        '<main id="content"><article><h1>How tides work</h1><p>The sea rises twice a day, and it falls twice a day. Sailors have known this for a very long time.</p>'
        "<p>The moon pulls at the water; the sun does so too, with less force.</p></article></main>"
        '<aside class="sidebar widget-area"><h3>Most read</h3><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></aside>'
        '<footer class="site-footer"><p>&copy; 2020 The Daily. All rights reserved.</p></footer></body></html>',
        "How tides work The sea rises twice a day, and it falls twice a day. Sailors have known this for a very long time. The moon pulls at the water; the sun does so too, with less force.",
    ),
    (
        '<html><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><header><h2>Bread Blog</h2></header>'
        '<div class="post"><h1>A plain loaf</h1><p>Mix flour, water, salt and yeast. Leave the dough to rise for an hour.</p><ul><li>Flour: 500 g</li><li>Water: 300 g</li></ul>'
        "<p>Bake it for forty minutes, until the crust is brown.</p></div>"
        '<div id="comments"><h3>2 comments</h3><div class="comment"><p>Great recipe, thank you!</p></div><div class="comment"><p>Mine burned.</p></div></div>'
        '<form class="newsletter"><label>Email</label><input type="text"><button>Join</button></form><footer>Contact | Imprint</footer></body></html>',
        "A plain loaf Mix flour, water, salt and yeast. Leave the dough to rise for an hour. Flour: 500 g Water: 300 g Bake it for forty minutes, until the crust is brown.",
    ),
    (
        "<body><ul class=menu><li><a href=/>Start</a><li><a href=/x>Archiv</a></ul><article><header><h1>Der alte Turm</h1></header><section><p>Der Turm steht seit vielen Jahren am Fluss, und niemand weiß, wer ihn gebaut hat.</p>"
        "<blockquote><p>Er war schon immer da, sagte die Frau.</p></blockquote><p>Im Sommer kommen Gäste.</p></section></article><div class='ad'>Jetzt kaufen!</div><footer>Impressum</footer>",
        "Der alte Turm Der Turm steht seit vielen Jahren am Fluss, und niemand weiß, wer ihn gebaut hat. Er war schon immer da, sagte die Frau. Im Sommer kommen Gäste.",
    ),
]


def words(text):
    return re.findall(r"\w+", text)


def test_foreign_pages_are_read_almost_wholly():
    model, right, found, total = html_crf.default_model(), 0, 0, 0
    for page, want in FOREIGN:
        got = words(html_crf.main_text(page, model))
        both = sum(w in words(want) for w in got)
        right, found, total = right + both, found + len(got), total + len(words(want))
    assert right / total > 0.9 and right / found > 0.9
