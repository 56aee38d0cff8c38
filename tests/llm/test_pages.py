import hashlib
import random
import re
import zlib

import pytest

from quillspan.llm.extraction import BAD, GOOD, INSIDE, NEAR, NOWHERE, OPEN, OUTSIDE, extract, first_label, labelled_blocks, main_text, second_labels
from quillspan.llm import media
from quillspan.llm.media import from_image, media_report, parsed_sequences, resolved, stored_media, to_image

ARTICLE = "this is the text of an article that we have written for you and it is long enough to be found by the rules of the method. " * 3


@pytest.mark.parametrize(
    "html, want",
    [
        (None, ""),
        ("", ""),
        ("<p>unclosed <b>bold<br><p>second&nbsp;&amp;  third", ""),
        ("<nav><p>menu</p></nav><article><h1>T</h1><p>a\n b</p><aside>side</aside><p>c &copy; d<p>e</article><footer>f</footer>", "T\na b\nc © d\ne"),
        ("<main><div class='comments'><p>reader</p></div><p>kept</p><form><p>no</p></form><script>var x='<p>';</script></main>", "kept"),
        (f"<div class=ad>buy</div><h2>Title</h2><p>{ARTICLE}</p><p>short one</p><p>{ARTICLE}</p><p><a href=x>only a link here</a></p>", f"Title\n{ARTICLE.strip()}\nshort one\n{ARTICLE.strip()}"),
    ],
)
def test_main_text(html, want):
    assert main_text(html) == want


DULL = "Zorvex plimtok grandel vistrum okkarel brentigal sorvamix trellgon varnick dolbrast omfurt kelvish " * 2
LINKS = "<ul><li><a href=a>First link of a list</a></li><li><a href=b>Second link of a list</a></li></ul>"
G, D = ARTICLE.strip(), DULL.strip()

SHAPES = [
    # Length and density decide where no element helps.
    (f"<p>{G}</p>", G),
    (f"<p>{D}</p>", ""),
    ("<p>Too short.</p>", ""),
    (f"<p>{G}</p><p>{D}</p>", G),
    (f"<div>{G}</div><div>{G}</div>", f"{G}\n{G}"),
    # Links make boilerplate.
    (f"<p>{G}</p>{LINKS}", G),
    (f"<p>{G}</p><p><a href=x>{G}</a></p>", G),
    (f"{LINKS}<p>{G}</p>{LINKS}", G),
    # Open blocks take their neighbours' labels.
    (f"<p>{G}</p><p>Short.</p><p>{G}</p>", f"{G}\nShort.\n{G}"),
    (f"{LINKS}<p>Short.</p>{LINKS}<p>{G}</p>", G),
    (f"{LINKS}<h2>Head</h2><p>{G}</p>", f"Head\n{G}"),
    (f"<p>{G}</p><h2>More to see</h2>{LINKS}", G),
    (f"{LINKS}<p>Not a head.</p><p>{G}</p>", G),
    # Inside an article the same passes decide, with the element as evidence.
    (f"<article><p>{G}</p><p>{D}</p><p>{G}</p></article>", f"{G}\n{D}\n{G}"),
    (f"<article><h1>Head</h1><p>Short.</p></article>", "Head\nShort."),
    (f"<article><p>{G}</p>{LINKS}<p>See also</p>{LINKS}<p>{G}</p></article>", f"{G}\n{G}"),
    (f"<article><p>{G}</p>{LINKS}</article>", G),
    (f"<article><p>Short.</p>{LINKS}<p>{G}</p></article>", f"Short.\n{G}"),
    (f"<article><p>{G} <a href=x>as we said</a> before.</p></article>", f"{G} as we said before."),
    # Outside of it nothing is content by itself.
    (f"<article><p>{G}</p></article><p>{G}</p>", G),
    (f"<p>Before.</p><article><p>{G}</p></article><div>{D}</div>", G),
    (f"<article><p>{G}</p></article><p>Between.</p><article><p>{G}</p></article>", f"{G}\nBetween.\n{G}"),
    # Teasers inside main, parts of main that are no teasers.
    (f"<main><p>{G}</p><p>{G}</p><article><h3>Else</h3><p>Short text. <a href=x>Read more</a></p></article></main>", f"{G}\n{G}"),
    (f"<main><article><p>{G}</p></article><article><p>{G} <a href=x>link</a></p></article></main>", f"{G}\n{G} link"),
    (f"<article><p>{G}</p><article class=x><p>Reply <a href=x>by a reader</a></p></article></article>", G),
    # Set apart.
    (f"<article><p>{G}</p><aside><p>{G}</p></aside></article>", G),
    (f"<div class='user-comments'><p>{G}</p></div><p>{G}</p>", G),
    (f"<header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>{G}</p></article>", f"Head\n{G}"),
    (f"<p hidden>{G}</p><div style='display: none'><p>{G}</p></div><p>{G}</p>", G),
    # Silent elements end as HTML ends them.
    ("<article><datalist><option value=a><option value=b></datalist><p>after</p></article>", "after"),
    ("<article><select><option>one<option>two</select>after</article>", "after"),
    ("<article><button>push<p>after</p></article>", "after"),
    ("<article><div><button>push</div>after</article>", "after"),
    ("<article><p>a</p><svg><g><text>b</text></g></svg><p>c</p></article>", "a\nc"),
    ("<article><div><object><p>b</div><p>c</p></article>", "c"),
    ("<article><noscript><p>b</div></noscript><p>c</p><textarea></article></textarea><p>d</article>", "c\nd"),
]


@pytest.mark.parametrize("html, want", SHAPES)
def test_shapes(html, want):
    assert main_text(html) == want


def plain_second(labels, tags, places):
    """The second pass by looking at every other block, for each block."""
    out = []
    for i, label in enumerate(labels):
        where, region = places[i]
        sides = []
        for step in (-1, 1):
            j, got = i + step, None
            while got is None:
                if where == INSIDE and (not 0 <= j < len(labels) or places[j] != (INSIDE, region)):
                    got = GOOD
                elif not 0 <= j < len(labels):
                    got = BAD
                elif labels[j] in (BAD, GOOD):
                    got = labels[j]
                j += step
            sides.append(got)
        if label not in (BAD, GOOD):
            if sides[0] == sides[1]:
                label = sides[0]
            elif where == INSIDE:
                label = GOOD
            elif where == OUTSIDE:
                label = BAD
            elif tags[i] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                label = sides[1]
            else:
                label = GOOD if label == NEAR else BAD
        out.append(label == GOOD)
    return out


def plain_first(text, link, apart, where):
    words = [w for w in re.split(r"\W+", text.lower()) if w]
    from quillspan.llm import extraction as e

    share, stop = link / len(text), len([w for w in words if w in e.STOP_WORDS]) / (len(words) or 1)
    if apart:
        return BAD
    if where == INSIDE:
        if share > 0.8:
            return BAD
        return GOOD if len(text) >= 70 and stop >= 0.15 and share <= 0.33 else OPEN
    if share > 0.33 or (link and len(text) < 70):
        return BAD
    if len(text) < 70:
        return OPEN
    if stop < 0.30:
        return BAD
    return GOOD if where == NOWHERE and stop >= 0.32 and len(text) > 200 else NEAR


def test_passes_match_a_plain_form():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randrange(1, 14)
        kind, region, places = rng.choice([NOWHERE, OUTSIDE]), 1, []
        for _ in range(n):
            region += rng.random() < 0.2
            places.append((INSIDE, region) if kind == OUTSIDE and rng.random() < 0.7 else (kind, 0))
        labels = [rng.choice([BAD, OPEN, NEAR, GOOD]) for _ in range(n)]
        tags = [rng.choice(["p", "h2", "li"]) for _ in range(n)]
        assert second_labels(labels, tags, places) == plain_second(labels, tags, places)
        text = " ".join(rng.choice(["the", "of", "brantic", "sorvel", "and"]) for _ in range(rng.randrange(1, 80)))
        link, apart = rng.choice([0, 0, len(text) // 4, len(text) // 2, len(text)]), rng.random() < 0.1
        for where in (INSIDE, OUTSIDE, NOWHERE):
            assert first_label(text, link, apart, where) == plain_first(text, link, apart, where)


def test_both_passes_decide_in_articles():
    html = f"<nav><p>menu</p></nav><article><h1>Head</h1><p>{G}</p>{LINKS}<p>See also</p>{LINKS}</article>"
    got = [(text, label, keep) for text, _, label, keep in labelled_blocks(html)]
    links = [("First link of a list", BAD, False), ("Second link of a list", BAD, False)]
    assert got == [("menu", BAD, False), ("Head", OPEN, True), (G, GOOD, True), *links, ("See also", OPEN, False), *links]


def test_extract(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "<article>é &#128512;</article>", "x"), (2, "u", "<article>é &#128512;</article>", "x"), (3, "u", "<article>" + "w " * 100000, "x")], "page_id long, url string, html string, text string")
    got = extract(rows).collect()
    assert [(r["page_id"], r["n_chars"]) for r in sorted(got, key=lambda r: r["page_id"])] == [(1, 0), (2, 3), (2, 3), (3, 199999)]
    assert extract(rows.limit(0)).count() == 0


def test_images_are_lossless():
    for raw in (b"", b"x", bytes(range(256)), b"y" * 64, b"\0" * 65):
        n, samples = from_image(to_image(raw))
        assert n == len(raw) and samples[:n] == raw and not any(samples[n:]) and len(samples) % 64 == 0 and samples
    whole = to_image(b"abc")
    for broken in (whole[:-1], whole[:-12], whole[:60] + b"?" + whole[61:], b"x" + whole[1:], b""):
        with pytest.raises(ValueError):
            from_image(broken)


def test_media_report_matches_a_plain_form(edges, docs_of, monkeypatch):
    rows = [(i, f"copy {i % 3 if i % 2 else i}" * (i % 7)) for i in range(300)]
    for spread in (4096, 8):
        monkeypatch.setattr(media, "SPREAD", spread)
        got = {r["doc_id"]: r for r in media_report(docs_of(rows)).collect()}
        assert len(got) == 300
        for i, text in rows:
            raw = text.encode()
            whole = raw + bytes(-len(raw) % 64) if raw else bytes(64)
            part = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
            head = len(whole).to_bytes(4, "big") + bytes([0, 0, 0, 1, 8, 0, 0, 0, 0])
            parts = [(b"IHDR", head), (b"tEXt", b"bytes\0" + str(len(raw)).encode()), (b"IDAT", zlib.compress(b"\0" + whole, 6)), (b"IEND", b"")]
            stored = b"\x89PNG\r\n\x1a\n" + b"".join(part(*p) for p in parts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            want = (len(raw), len(whole), sha(whole), zlib.crc32(whole[-64:]), len(stored), sha(stored))
            assert tuple(got[i][c] for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")) == want
            assert got[i]["caption"] == f"text of document {i}" and got[i]["position"] == 1


def test_media_report_edges(edges, docs_of):
    got = media_report(edges).collect()
    assert len(got) == 9 and all(r["caption"] and r["position"] == 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[6]["n_bytes"] == len(edges.where("doc_id = 6").first()["text"].encode())
    assert by[6]["feature"] == by[7]["feature"] and by[1]["payload_bytes"] == 64
    assert media_report(docs_of([])).count() == 0


def test_sequences_stay_aligned(spark, docs_of):
    stored = stored_media(docs_of([(1, "one"), (2, "two"), (3, "two")]).select("doc_id", "text"))
    refs = {r["doc_id"]: r["digest"] for r in stored.collect()}
    html = f"<p>a</p><figure><img src='sha256:{refs[2]}'><figcaption>cap two</figcaption></figure><p>b<img src='sha256:{refs[1]}' alt='in line'>c</p><img src='sha256:feed'>"
    pages = spark.createDataFrame([("p", html), ("q", None), ("r", "")], "key string, html string")
    out = {r["key"]: r["items"] for r in resolved(parsed_sequences(pages), stored, "key").collect()}
    assert [(x["kind"], x["text"], x["caption"]) for x in out["p"]] == [("text", "a", None), ("media", None, "cap two"), ("text", "b", None), ("media", None, "in line"), ("text", "c", None), ("media", None, None)]
    assert [from_image(bytes(x["object"]["media"]))[1].rstrip(b"\0") for x in out["p"] if x["object"]] == [b"two", b"one"]
    assert out["p"][5]["object"] is None and out["q"] == [] and out["r"] == []
