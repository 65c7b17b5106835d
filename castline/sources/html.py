"""HTML pages as rows of text blocks."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql.functions import udtf


class _Blocks(HTMLParser):
    """Text of block elements, quotes, scripts and styles left out."""

    BLOCKS = ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "title")
    SKIPPED = ("blockquote", "script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.text: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIPPED:
            self.skip += 1
        elif tag in self.BLOCKS:
            self.close_block()
            self.open.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCKS and self.open:
            self.close_block()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open and not self.skip:
            self.text.append(data)

    def close_block(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.open:
            self.found.append((self.open[-1], text))
        self.text = []


@udtf(returnType="kind string, ordinal int, body string")
class HtmlBlocks:
    """Rows of a page's block elements in order."""

    def eval(self, html: str):  # noqa: ANN201
        if html:
            parser = _Blocks()
            parser.feed(html)
            parser.close()
            for i, (kind, text) in enumerate(parser.found):
                yield kind, i + 1, text
