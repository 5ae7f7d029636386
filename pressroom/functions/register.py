"""The Python functions under the same names for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .html import _outline
from .jsonld import jsonld_article
from .urls import idna_ascii

_ELEMENT_ROW = "ordinal int, parent int, depth int, tag string, attrs map<string,string>, text string"


class _HtmlElements:
    def eval(self, html: str) -> Iterator[tuple]:
        if html is None:
            return
        text, _, _, elements = _outline(html, False)
        for e in elements:
            yield e["ordinal"], e["parent"], e["depth"], e["tag"], e["attrs"], text[e["lo"] : e["hi"]].strip()


def register(spark: SparkSession) -> None:
    """``idna_ascii(host)``, ``jsonld_article(scripts)`` and the table function ``html_elements(html)``."""
    spark.udf.register("idna_ascii", idna_ascii)
    spark.udf.register("jsonld_article", jsonld_article)
    spark.udtf.register("html_elements", udtf(_HtmlElements, returnType=_ELEMENT_ROW))
