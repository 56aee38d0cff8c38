"""Main text of web pages by two passes of block rules.

First pass: length, link density and stop-word density of each block. Links make boilerplate, long blocks with many stop
words are content, long ones with few are boilerplate; short and doubtful ones stay open. An article or main element is
evidence, not a verdict: inside one fewer stop words and a shorter length are enough for content, and few stop words
leave a block open instead of making it boilerplate; outside of it, on a page that has one, no block is content by itself.
Second pass: open blocks take the label of their nearest decided neighbours. Inside an article the element's edges count
as content, at the ends of the page as boilerplate. Where the two neighbours differ, an open block stays in an article,
and goes outside of it; on pages without such an element headings go with what follows, and other blocks are content only
if nearly content already.

What is set apart by its element or by words in class, id or role (menus, forms, adverts, comments, hidden parts) is
boilerplate whatever it reads like, as readers' comments read like articles. An article inside another one or inside main
is a teaser, set apart too, if it holds a link and has less than a third of the text of what is around it.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.html_events import Walker
from quillspan.llm.shared import extended

# Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be because been but by can could did do for from had has have he her him his how i if in into is it its
    just like me more my no not of on one or other our out over she so some than that the their them then there these they this to up was we were what when
    which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch du durch ein eine einem einen einer er es für hat haben hier ich ihr im in ist ja
    kann man mehr mein mich mir mit nach nicht noch nur oder schon sein sich sie sind so über um und uns vom von vor war was wenn wer wie wir wird zu zum zur
    au aux avec ce ces cette comme d dans de des dont du elle en est et être ils il je l la le les leur lui mais même ne nous on ont ou par pas plus pour qu que
    qui sa sans se ses si son sont sur tout très un une vous y
    al algo como con cuando de del desde donde el ella ellos en entre era es esta está este esto fue ha hay la las le les lo los más me mi muy nada ni no nos
    para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una uno y ya yo""".split()
)
SHORT, LONG = 70, 200  # characters
LINKED, LOW, HIGH = 0.33, 0.30, 0.32
MOST_LINKED, ENOUGH = 0.8, 0.15  # inside an article: link share of boilerplate, stop-word density of content
TEASER = 3  # a nested article is a teaser below the 1/TEASER of the text around it
BAD, OPEN, NEAR, GOOD = range(4)
OUTSIDE, INSIDE, NOWHERE = range(3)  # of a page's articles; a page without any


def first_label(text: str, link: int, apart: bool, where: int) -> int:
    """The label of a block by itself; link counts the characters inside links."""
    linked = link / len(text)
    if apart or linked > (MOST_LINKED if where == INSIDE else LINKED):
        return BAD
    if len(text) < SHORT:
        return BAD if linked and where != INSIDE else OPEN
    words = re.findall(r"\w+", text.lower())
    dense = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if where == INSIDE:
        return OPEN if dense < ENOUGH or linked > LINKED else GOOD
    if dense < LOW:
        return BAD
    return GOOD if where == NOWHERE and dense >= HIGH and len(text) > LONG else NEAR


def second_labels(labels: list[int], tags: list[str], places: list[tuple[int, int]]) -> list[bool]:
    """Whether each block is content; places are (where, region) of each block, neighbours are sought inside one region."""

    def nearest(order) -> list[int]:
        out, page, inside, region = [BAD] * len(labels), BAD, GOOD, None
        for i in order:
            where, r = places[i]
            if where != INSIDE or r != region:
                inside = GOOD
            region = r if where == INSIDE else None
            out[i] = inside if where == INSIDE else page
            if labels[i] in (BAD, GOOD):
                page = inside = labels[i]
        return out

    before, after = nearest(range(len(labels))), nearest(reversed(range(len(labels))))
    keep = []
    for i, label in enumerate(labels):
        where = places[i][0]
        if label in (BAD, GOOD):
            keep.append(label == GOOD)
        elif before[i] == after[i]:
            keep.append(before[i] == GOOD)
        elif where != NOWHERE:
            keep.append(where == INSIDE)
        elif re.fullmatch("h[1-6]", tags[i]):
            keep.append(after[i] == GOOD)
        else:
            keep.append(label == NEAR)
    return keep


class _Blocks(Walker):
    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str, int, bool, int]] = []

    def on_block(self, text, tag, link, apart, region):
        self.found.append((text, tag, link, apart, region))

    def teasers(self) -> set[int]:
        """Nested regions that hold a link and little text beside their enclosing region, or beside its largest part."""
        own, linked = [0] * len(self.above), set()
        for text, _, link, apart, region in self.found:
            if not apart:
                own[region] += len(text)
                linked |= {region} if link else set()
        largest = own.copy()
        for r, up in enumerate(self.above):
            largest[up] = max(largest[up], own[r])
        out: set[int] = set()
        for r, up in enumerate(self.above):
            if up and (up in out or (r in linked and TEASER * own[r] < largest[up])):
                out.add(r)
        return out


def labelled_blocks(html: str | None) -> list[tuple[str, str, int, bool]]:
    """(text, element, label of the first pass, content after the second) of a page's blocks."""
    page = _Blocks().walk(html or "")
    teasers = page.teasers()
    blocks = [(text, tag, link, apart or region in teasers, region) for text, tag, link, apart, region in page.found]
    has_region = any(b[4] and not b[3] for b in blocks)
    places = [(INSIDE if b[4] and not b[3] else OUTSIDE if has_region else NOWHERE, b[4]) for b in blocks]
    labels = [first_label(text, link, apart, where) for (text, _, link, apart, _), (where, _) in zip(blocks, places)]
    kept = second_labels(labels, [b[1] for b in blocks], places)
    return [(b[0], b[1], label, keep) for b, label, keep in zip(blocks, labels, kept)]


def main_text(html: str | None) -> str:
    """The content blocks of a page, a line each."""
    return "\n".join(text for text, _, _, keep in labelled_blocks(html) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with text_col, the main text, and n_chars, its code points.

    Null and empty html give an empty text, and so does a page of boilerplate alone. Repeated rows are extracted alike; columns named as the new ones are replaced; an empty table stays empty.
    """
    rest = [c for c in pages.columns if c not in (text_col, "n_chars")]
    base = pages.select(*rest)
    place = rest.index(html_col)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h) for h in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, text_col, "n_chars"])

    return base.mapInArrow(run, extended(base, f"{text_col} string, n_chars long"))
