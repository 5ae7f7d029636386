"""JSON-LD: a small Python helper picks the article object, its fields are read natively from a VARIANT."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import col, let, let_sql, trim_sql

# The types that describe a news article.
ARTICLE_TYPES = frozenset(("NewsArticle", "Article", "ReportageNewsArticle"))


def _refuse(token: str):
    raise ValueError(token)


def _is_article(obj: dict) -> bool:
    kinds = obj.get("@type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    return any(isinstance(kind, str) and kind.strip() in ARTICLE_TYPES for kind in kinds)


def _entries(value: list) -> list:
    """The entries of a list and of the lists inside it, in order."""
    found, pending = [], [value]
    while pending:
        item = pending.pop()
        if isinstance(item, list):
            pending.extend(reversed(item))
        else:
            found.append(item)
    return found


def _flat(article: dict) -> dict:
    """The article with lists inside lists of authors and images flattened, so that the native readers need no depth.

    Names of nested lists are joined like those of one list, and the first image of a first list is the first image.
    """
    authors, image = article.get("author"), article.get("image")
    if isinstance(authors, list) and any(isinstance(a, list) for a in authors):
        article = {**article, "author": _entries(authors)}
    if isinstance(image, list) and image and isinstance(image[0], list):
        while isinstance(image, list):
            image = image[0] if image else None
        article = {**article, "image": image}
    return article


def pick_article(scripts: Iterable[str | None]) -> str | None:
    """JSON text of the first article object in document order, however deep; scripts with invalid JSON are skipped."""
    for script in scripts:
        try:
            pending = [json.loads((script or "").strip(), parse_constant=_refuse)]
        except (ValueError, RecursionError):
            continue
        while pending:
            value = pending.pop()
            if isinstance(value, dict):
                if _is_article(value):
                    text = json.dumps(_flat(value), ensure_ascii=False)
                    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
                pending.extend(reversed(value.values()))
            elif isinstance(value, list):
                pending.extend(reversed(value))
    return None


@F.arrow_udf(StringType())
def jsonld_article(scripts: pa.Array) -> pa.Array:
    """The article object among a page's JSON-LD scripts (ARRAY<STRING>), as JSON text."""
    return pa.array([pick_article(texts or ()) for texts in scripts.to_pylist()], type=pa.string())


# Fields are written as SQL text, since the readers nest: a Column expression would cost one JVM call per operator.


def _get(value: str, key: str) -> str:
    return f"try_variant_get({value}, \"$['{key}']\", 'variant')"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _is(value: str, *kinds: str) -> str:
    return f"coalesce(schema_of_variant({value}) rlike '^({'|'.join(kinds)})', false)"


def _items(value: str) -> str:
    return f"try_variant_get({value}, '$', 'array<variant>')"


def _joined(names: str) -> str:
    return f"array_join(filter({names}, n -> n != ''), ', ')"


def _plain_number(value: str) -> str:
    """Shortest decimal form: plain for exponents from -4 to 5, otherwise ``d.ddde+XX``."""
    mantissa = "substring_index(cast(abs(x) as string), 'E', 1)"
    digits = rf"regexp_replace(replace({mantissa}, '.', ''), '0+$', '')"
    power = (
        "if(contains(cast(x as string), 'E'), cast(substring_index(cast(x as string), 'E', -1) as int), "
        f"length(substring_index({mantissa}, '.', 1)) - 1)"
    )
    scientific = (
        f"concat(regexp_replace({digits}, '^(.)(.+)', '$1.$2'), if({power} < 0, 'e-', 'e+'), "
        f"regexp_replace(cast(abs({power}) as string), '^(.)$', '0$1'))"
    )
    plain = r"regexp_replace(cast(try_cast(abs(x) as decimal(38,24)) as string), '[.]?0+$', '')"
    shown = f"concat(if(x < 0, '-', ''), if(abs(x) >= 1e-4D and abs(x) < 1e6D, {plain}, {scientific}))"
    return _let(value, "x", f"if(x = 0, '0', {shown})")


def _string(value: str) -> str:
    text, number = f"try_variant_get({value}, '$', 'string')", f"try_variant_get({value}, '$', 'double')"
    return (
        f"case when {_is(value, 'STRING')} then {trim_sql(text)} "
        f"when {_is(value, 'BIGINT', 'DOUBLE', 'FLOAT', 'DECIMAL')} then {_plain_number(number)} else '' end"
    )


def _name(value: str) -> str:
    """An object's name, or the value itself, as a string."""
    return _let(f"if({_is(value, 'OBJECT')}, {_get(value, 'name')}, {value})", "m", _string("m"))


def _author(value: str, depth: int) -> str:
    if depth == 0:
        return _name(value)
    names = f"transform({_items(value)}, a{depth} -> {_author(f'a{depth}', depth - 1)})"
    return f"if({_is(value, 'ARRAY')}, {_joined(names)}, {_name(value)})"


def _image(value: str, depth: int) -> str:
    links = f"transform(array({_get(value, 'url')}, {_get(value, 'contentUrl')}), m -> {_string('m')})"
    text = trim_sql(f"try_variant_get({value}, '$', 'string')")
    single = (
        f"case when {_is(value, 'OBJECT')} then coalesce(get(filter({links}, x -> x != ''), 0), '') "
        f"when {_is(value, 'STRING')} then {text} else '' end"
    )
    if depth == 0:
        return single
    first = _let(f"try_variant_get({value}, '$[0]', 'variant')", f"i{depth}", _image(f"i{depth}", depth - 1))
    return f"if({_is(value, 'ARRAY')}, coalesce({first}, ''), {single})"


def _section(value: str) -> str:
    entries = f"if({_is(value, 'ARRAY')}, {_items(value)}, array({value}))"
    return _joined(f"transform({entries}, e -> {_string('e')})")


def as_string(value: Column) -> Column:
    """A string, trimmed; a number, printed; '' for anything else.

    The type is checked first, since casting a VARIANT object to STRING gives its JSON text.
    """
    return let_sql(value, "v", _string("v"))


def author_name(value: Column, depth: int = 3) -> Column:
    """An object's name, a list of authors joined with ', ', or a string.

    :func:`pick_article` has flattened lists within lists; for JSON from elsewhere they are read up to ``depth``.
    """
    return let_sql(value, "v", _author("v", depth))


def publisher_name(value: Column) -> Column:
    """An object's name; a plain string is not a publisher."""
    return let_sql(value, "v", f"if({_is('v', 'OBJECT')}, {_name('v')}, '')")


def image_value(value: Column, depth: int = 2) -> Column:
    """A string, an object's url or contentUrl, or the first entry of a list."""
    return let_sql(value, "v", _image("v", depth))


def section_name(value: Column) -> Column:
    """A string, or a list joined with ', '."""
    return let_sql(value, "v", _section("v"))


def main_entity(value: Column) -> Column:
    """An object's @id, or a string."""
    return as_string(let_sql(value, "v", f"if({_is('v', 'OBJECT')}, {_get('v', '@id')}, v)"))


# field -> the key that it is read from; the first group are plain strings
_PLAIN = {
    name: f"$['{name}']" for name in ("headline", "url", "description", "articleBody", "datePublished", "dateModified")
}
_OTHERS = {"publisher": "$.publisher.name", "entity_id": "$.mainEntityOfPage['@id']", "entity": "$.mainEntityOfPage"}


def jsonld_fields(article_json: Column | str) -> Column:
    """STRUCT of the article fields; every field is '' when it is missing."""
    text = col(article_json)
    names = [*_PLAIN, "author", "publisher", "image", "section", "main_entity"]

    def read(doc: Column) -> Column:
        def value(path: str) -> Column:
            return F.try_variant_get(doc, path, "variant")

        # one copy of the string reader serves all fields that are plain strings
        paths = {**_PLAIN, **_OTHERS}
        strings = F.call_function(
            "transform", F.array(*[value(path) for path in paths.values()]), F.expr(f"v -> coalesce({_string('v')}, '')")
        )

        def build(found: Column) -> Column:
            at = {name: F.get(found, F.lit(i)) for i, name in enumerate(paths)}
            return F.struct(
                *[at[name].alias(name) for name in _PLAIN],
                F.coalesce(author_name(value("$.author")), F.lit("")).alias("author"),
                at["publisher"].alias("publisher"),
                F.coalesce(image_value(value("$.image")), F.lit("")).alias("image"),
                F.coalesce(section_name(value("$.articleSection")), F.lit("")).alias("section"),
                F.when(at["entity_id"] != "", at["entity_id"]).otherwise(at["entity"]).alias("main_entity"),
            )

        return let(strings, build)

    # pages without an article object, which are most, skip the readers
    empty = F.struct(*[F.lit("").alias(name) for name in names])
    return F.when(text.isNull(), empty).otherwise(let(F.try_parse_json(text), read))
