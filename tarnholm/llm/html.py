"""HTML extraction by text-to-tag ratio.

The standard library's streaming parser gives events; text and tags are counted per line, where
a line ends at a line break or at the tag of a block. The ratios of text characters to tags are
smoothed with a Gaussian kernel, lines are clustered by a threshold at a share of their standard
deviation, and the lines above it are the content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, prepare
from .text import slices

SKIPPED = frozenset("script style noscript template svg iframe".split())
IN_HEAD = frozenset("html head title meta link base basefont bgsound noframes script style noscript template".split())
BLOCKS = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
SCHEMA = "page_id long, url string, content string, lines int, content_lines int"


class LineParser(HTMLParser):
    """Text, and number of tags, of each line.

    A head ends at its end tag, at a tag that can't stand in it, or at text outside its title.
    ``unclosed`` has the numbers of the skipped elements whose text counts, for they have no end tag.
    """

    def __init__(self, unclosed: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.texts: list[list[str]] = [[]]
        self.tags = [0]
        self.skipping: str | None = None
        self.unclosed, self.number = unclosed, 0
        self.open: list[int] = []  # numbers of the elements being skipped, one in another
        self.endless: list[int] = []
        self.head = self.title = False

    def set_cdata_mode(self, elem: str, **how: bool) -> None:
        if elem != "iframe":  # skipped by its tags, as one without an end tag would take all that follows
            super().set_cdata_mode(elem, **how)

    def close(self) -> None:
        super().close()
        self._give_up()

    def _give_up(self) -> None:
        if self.skipping not in ("script", "style"):
            self.endless += self.open
        self.skipping, self.open = None, []

    def _line(self) -> None:
        if self.texts[-1] or self.tags[-1]:
            self.texts.append([])
            self.tags.append(0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.number += tag in SKIPPED
        if self.skipping:
            if tag == self.skipping and self.number not in self.unclosed:
                self.open.append(self.number)
            return
        self.head = self.head and tag in IN_HEAD or tag == "head"
        if tag in SKIPPED:
            if self.number not in self.unclosed:
                self.skipping, self.open = tag, [self.number]
            return
        if self.head:
            self.title = tag == "title"
            return
        if tag in BLOCKS:
            self._line()
        self.tags[-1] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if self.skipping:
            return
        self.head = self.head and tag in IN_HEAD
        if not self.head and tag not in SKIPPED and tag != "head":
            if tag in BLOCKS:
                self._line()
            self.tags[-1] += 1

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag == self.skipping:
                self.open.pop()
                self.skipping = tag if self.open else None
            elif tag in ("html", "body"):
                self._give_up()
            return
        if self.head:
            self.head, self.title = tag not in ("head", "html", "body"), False
            return
        self.tags[-1] += 1
        if tag in BLOCKS:
            self._line()

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.head and (self.title or not data.strip()):
            return
        self.head = False
        first, *rest = data.split("\n")
        self.texts[-1].append(first)
        for x in rest:
            self._line()
            self.texts[-1].append(x)

    def lines(self) -> tuple[list[str], np.ndarray]:
        text = [" ".join("".join(x).split()) for x in self.texts]
        keep = [i for i, (x, n) in enumerate(zip(text, self.tags)) if x or n]
        return [text[i] for i in keep], np.array([self.tags[i] for i in keep], float)


def extract(html: str | None, sigma: float = 1.0, share: float = 0.5) -> tuple[str, int, int]:
    """Content, number of lines, number of content lines."""
    if not html:
        return "", 0, 0
    unclosed: frozenset[int] = frozenset()
    while True:  # again if elements turn out to have no end tag
        parser = LineParser(unclosed)
        parser.feed(html)
        parser.close()
        if not parser.endless:
            break
        unclosed |= frozenset(parser.endless)
    text, tags = parser.lines()
    if not text:
        return "", 0, 0
    ratio = np.array([len(x) for x in text]) / np.maximum(tags, 1)
    radius = int(np.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[radius : radius + len(ratio)]
    smooth = np.convolve(ratio, kernel)[radius : radius + len(ratio)] / weight
    chosen = [x for x, r in zip(text, smooth >= share * smooth.std()) if r and x]
    return "\n".join(chosen), len(text), len(chosen)


def _extract(batches: Iterator[pa.RecordBatch], sigma: float, share: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html", 4 << 20):
        found = [extract(x, sigma, share) for x in batch.column("html").to_pylist()]
        content, lines, chosen = zip(*found)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(content, pa.string()), pa.array(lines, pa.int32()), pa.array(chosen, pa.int32())],
            names=["page_id", "url", "content", "lines", "content_lines"],
        )


def extract_pages(pages: DataFrame, sigma: float = 1.0, share: float = 0.5) -> DataFrame:
    """One row a page: page_id, url, content, lines, content_lines.

    Null or empty html gives empty content and 0 lines; so does html without text. Unclosed and
    broken tags are read as the standard parser reads them. With lines of one ratio, all are
    content. Repeated pages are extracted each, null ids and urls kept, other columns ignored.
    """
    prepare(pages.sparkSession)
    pages = columns(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    return pages.mapInArrow(partial(_extract, sigma=sigma, share=share), SCHEMA)
