"""HTML pages as rows: table functions over a parser, which stream what they find in a page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag: fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
LINK = "place int, href string, label string"
CARD = "place int, product_id string, name string, url string, image string, brand string, price long, price_normal long, total int"


def digits_of(text: str | None) -> int | None:
    """Whole pesos of a price: $12.990 or 12990.0000."""
    whole = (text or "").split(",")[0]
    if whole.count(".") == 1 and len(whole.rsplit(".", 1)[1]) != 3:
        whole = whole.split(".")[0]
    number = "".join(c for c in whole if c.isdigit())
    return int(number) if number else None


class _Links(HTMLParser):
    """Anchors with an address and the text inside them, whatever is nested there."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []
        self.href: str | None = None
        self.text: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.finish()
            self.href, self.text = dict(attrs).get("href"), []

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.finish()

    def handle_data(self, data: str) -> None:
        if self.href is not None:
            self.text.append(data)

    def finish(self) -> None:
        if self.href is not None:
            self.found.append((self.href, "".join(self.text)))
        self.href = None

    def taken(self) -> list[tuple[str, str]]:
        out, self.found = self.found, []
        return out


class _Cards(HTMLParser):
    """Product cards: elements with a product's id, and what stands inside them.

    A card ends with its element, or where the next one begins. Prices are told by an
    amount in an attribute, or by the text of an element of class price; one inside an
    element of an old price is the list price.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.done: list[dict] = []
        self.card: dict | None = None
        self.open: list[tuple[str, str | None]] = []  # tags inside the card, and what their text is

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k: v or "" for k, v in attrs}
        classes = given.get("class", "").split()
        ident = given.get("data-product-id") or given.get("data-id")
        if ident:
            if self.card is not None:
                self.done.append(self.card)
            self.card, self.open = {"product_id": ident, "name": None, "alt": None, "url": None, "image": None, "brand": None, "price": None, "price_normal": None}, []
        if self.card is None:
            return
        reads = None
        if tag == "a" and given.get("href") and self.card["url"] is None:
            self.card["url"], reads = given["href"], "name"
        elif tag == "img":
            self.card["image"] = self.card["image"] or given.get("src") or None
            self.card["alt"] = self.card["alt"] or given.get("alt") or None
        elif any("brand" in c for c in classes):
            reads = "brand"
        old = any("old-price" in c for c in classes) or any(r == "old" for _, r in self.open)
        if given.get("data-price-amount"):
            key = "price_normal" if old else "price"
            self.card[key] = self.card[key] or digits_of(given["data-price-amount"])
        elif any(c == "price" for c in classes):
            reads = "price_normal" if old else "price"
        elif old:
            reads = "old"
        if tag not in VOID:
            self.open.append((tag, reads))

    def handle_endtag(self, tag: str) -> None:
        if self.card is None or tag in VOID or all(t != tag for t, _ in self.open):
            return
        while self.open:
            if self.open.pop()[0] == tag:
                break
        if not self.open:
            self.done.append(self.card)
            self.card = None

    def handle_data(self, data: str) -> None:
        reads = next((r for _, r in reversed(self.open) if r), None)
        if self.card is None or not data.strip():
            return
        if reads in ("price", "price_normal"):
            self.card[reads] = self.card[reads] or digits_of(data)
        elif reads in ("name", "brand"):
            self.card[reads] = f"{self.card[reads] or ''}{data}"

    def rest(self) -> list[dict]:
        if self.card is not None:
            self.done.append(self.card)
        self.card = None
        return self.done


#: Characters of a page that the parser is given at once.
_STEP = 1 << 16


@F.udtf(returnType=LINK)
class PageLinks:
    """Links of a page in order, as the parser comes to them."""

    def eval(self, html: str) -> Iterator[tuple]:
        if not html:
            return
        parser, place = _Links(), 0
        for a in range(0, len(html), _STEP):
            parser.feed(html[a : a + _STEP])
            for href, label in parser.taken():
                yield place, href, label
                place += 1
        parser.close()
        parser.finish()
        for href, label in parser.taken():
            yield place, href, label
            place += 1


@F.udtf(returnType=CARD)
class PageCards:
    """Product cards of a page in order, the first of an address only, with their total; cards without a name or price are left out."""

    def eval(self, html: str) -> Iterator[tuple]:
        if not html:
            return
        parser = _Cards()
        for a in range(0, len(html), _STEP):
            parser.feed(html[a : a + _STEP])
        parser.close()
        seen, kept = set(), []
        for c in parser.rest():
            name, brand = (c["name"] or "").strip() or (c["alt"] or "").strip(), (c["brand"] or "").strip()
            if name and c["price"] is not None and not (c["url"] and c["url"] in seen):
                seen.add(c["url"])
                kept.append((c["product_id"], " ".join(name.split()), c["url"], c["image"], brand or None, c["price"], c["price_normal"]))
        for place, row in enumerate(kept):
            yield (place, *row, len(kept))


def page_links(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, place, href, label of every link of the pages (html)."""
    return pages.select(*by, "html").lateralJoin(PageLinks(F.col("html").outer())).select(*by, "place", "href", "label")


def page_cards(pages: DataFrame, by: list[str]) -> DataFrame:
    """by and the product cards of the pages (html)."""
    names = [c.split()[0] for c in CARD.split(", ")]
    return pages.select(*by, "html").lateralJoin(PageCards(F.col("html").outer())).select(*by, *names)
