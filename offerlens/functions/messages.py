"""How alerts are worded, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Hosts that offer smaller pictures, and how their links ask for one: the pattern of a link, and what it becomes.
SMALLER = (
    ("cdn.shopify.com", r"^([^?]*)$", "$1?width={width}"),
    ("cdn.shopify.com", r"^([^?]*\?.*)$", "$1&width={width}"),
    ("cdn.grofers.com", r"^(.*?\.com/)(.+)$", "$1cdn-cgi/image/f=auto,w={width},q=60/$2"),
    ("cdn.fcglcdn.com", r"/products/[0-9]+x[0-9]+/", "/products/219x265/"),
)

#: Characters that a caption and a message may have.
CAPTION, MESSAGE = 1024, 4096

HEADINGS = {"back": "Back in stock", "drop": "Price drop", "new": "New"}


def thumbnail(url: Column, width: int = 320, rules=SMALLER) -> Column:
    """A smaller picture where the host offers one; null for an empty url. rules: (host, pattern, replacement); the first that fits is used."""
    smaller = [F.when(url.contains(host) & url.rlike(pattern), F.regexp_replace(url, pattern, to.format(width=width))) for host, pattern, to in rules]
    return F.when(url != "", F.coalesce(*smaller, url))


def _at_shop(price: Column, shop: Column) -> Column:
    return F.concat(text.money(price), F.lit(" at "), text.html_escape(shop))


def _was(kind: Column, was: Column) -> Column:
    return F.when((kind == "drop") & (F.coalesce(was, F.lit(0.0)) != 0), F.concat(F.lit(" (was "), text.money(was), F.lit(")"))).otherwise("")


def alert_line(title: Column, price: Column, shop: Column, kind: Column, was: Column, target: Column, url: Column) -> Column:
    """An alert in a digest: title, price and shop, for a drop what it was and the target, and the link."""
    aim = F.when((kind == "drop") & (target != 0) & price.isNotNull(), F.concat(F.lit("target "), text.money(target)))
    title = F.concat(F.lit("<b>"), text.html_escape(F.coalesce(title, F.lit(""))), F.lit("</b>"))
    return F.concat_ws("\n", title, F.concat(_at_shop(price, shop), _was(kind, was)), aim, F.nullif(url, F.lit("")))


def caption(title: Column, price: Column, shop: Column, kind: Column, was: Column, url: Column) -> Column:
    """The caption of one picture, cut to what a caption may have."""
    heading = F.coalesce(*[F.when(kind == k, v) for k, v in HEADINGS.items()], kind)
    title = F.concat(F.lit("<b>"), text.html_escape(F.coalesce(title, F.lit(""))), F.lit("</b>"))
    return F.substring(F.concat_ws("\n", title, F.concat(_at_shop(price, shop), F.lit(" · "), heading, _was(kind, was)), text.html_escape(F.nullif(url, F.lit("")))), 1, CAPTION)
