"""HTML as markdown: headings, lists, tables, code, quotes, links and images."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "del": "~~", "s": "~~"}
SKIPPED = {"script", "style", "head", "template", "noscript"}
BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "ul", "ol", "blockquote", "pre", "table", "hr", *(f"h{k}" for k in range(1, 7))}


class _Reader(HTMLParser):
    """Blocks of lines; each open list, quote, cell or link collects its own text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.text: list[str] = []
        self.lists: list = []
        self.stack: list = []
        self.skip = self.pre = self.quote = 0
        self.rows: list | None = None
        self.open = False  # a table cell
        self.listed = 0  # the blocks there were when the last one was an item

    def cell(self) -> None:
        """The cell that is open ends; its end tag may be left out."""
        if self.open and self.rows:
            self.rows[-1].append(" ".join("".join(self.text).split()).replace("|", "\\|"))
        self.text, self.open = [], False

    def flush(self, before: str = "") -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.pre else re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\v\u00a0]+", " ", text)).strip()
        self.text = []
        if text:
            block = before + text
            self.out.append("\n".join("> " * self.quote + x for x in block.split("\n")) if self.quote else block)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        if self.skip:
            return
        if tag in BLOCKS and self.rows is None:
            self.item() if self.lists else self.flush()
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            self.item()
            if self.lists:
                self.lists[-1][1] += 1
                self.stack.append(len(self.lists))
        elif tag == "blockquote":
            self.quote += 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "hr":
            self.out.append("---")
        elif tag == "br":
            self.text.append("\n" if self.rows is None else " ")
        elif tag == "table":
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows:
            self.cell()
            self.open = True
        elif tag == "img" and (a.get("src") or a.get("alt")):
            self.text.append(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag == "a":
            self.stack.append(("a", a.get("href"), len(self.text)))
        elif tag in MARKS and not self.pre:
            self.text.append(MARKS[tag])

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.flush("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.item()
        elif tag in ("ul", "ol"):
            self.item()
            if self.lists:
                self.lists.pop()
        elif tag == "pre":
            body = "".join(self.text).strip("\n")
            self.text = []
            self.pre = max(0, self.pre - 1)
            if body:
                self.out.append(f"```\n{body}\n```")
        elif tag == "blockquote":
            self.flush()
            self.quote = max(0, self.quote - 1)
        elif tag in ("td", "th", "tr") and self.rows:
            self.cell()
        elif tag == "table" and self.rows is not None:
            self.cell()
            rows, self.rows = [r for r in self.rows if r], None
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                self.out.append("\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]))
        elif tag == "a":
            opened = next((x for x in reversed(self.stack) if isinstance(x, tuple)), None)
            if opened:
                self.stack.remove(opened)
                label = " ".join("".join(self.text[opened[2] :]).split())
                del self.text[opened[2] :]
                self.text.append(f"[{label}]({opened[1]})" if opened[1] and label else label)
        elif tag in MARKS and not self.pre:
            self.text.append(MARKS[tag])
        elif tag in BLOCKS and self.rows is None:
            self.item() if self.lists else self.flush()

    def item(self) -> None:
        if not self.lists:
            self.flush()
            return
        kind, n = self.lists[-1]
        had = len(self.out)
        self.flush("  " * (len(self.lists) - 1) + ("- " if kind == "ul" else f"{max(1, n)}. "))
        if len(self.out) > had > 0 and self.listed == had:
            self.out[had - 1] += "\n" + self.out.pop()
            self.listed = had
        elif len(self.out) > had:
            self.listed = len(self.out)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data if self.pre else re.sub(r"\s+", " ", data))


def markdown_of(page: str | None) -> str:
    """Items of one list stand on lines of one block; blocks are parted by an empty line."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    r.item() if r.lists else r.flush()
    return "\n\n".join(r.out)


def html_to_markdown(page: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(markdown_of)

    return run(page)
