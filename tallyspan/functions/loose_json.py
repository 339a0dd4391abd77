"""JSON whose members vary in shape, parsed level by level inside the JVM.

A member may hold a list, a single object or the same thing written as a JSON
string; reading every level as text first and parsing that text keeps all of
these, where one fixed nested schema would turn the odd ones into nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def elements(text: Column) -> Column:
    """The elements of a list, or the one object, as an array of JSON texts.

    Null, scalars and malformed text give an empty array.
    """
    body = F.ltrim(text)
    as_list = F.when(body.startswith("{"), F.concat(F.lit("["), body, F.lit("]"))).when(body.startswith("["), body)
    return F.coalesce(F.from_json(as_list, "array<string>"), F.array().cast("array<string>"))


def objects(text: Column, members: str) -> Column:
    """The objects of a list, or the one object, parsed with the members named.

    Elements that are no objects are left out.
    """
    found = F.filter(elements(text), lambda x: F.ltrim(x).startswith("{"))
    return F.filter(F.transform(found, lambda x: F.from_json(x, members)), lambda x: x.isNotNull())


def texts(text: Column) -> Column:
    """A list of texts, or the one text, as an array; null members stay null."""
    body = F.ltrim(text)
    one = F.array(text)
    return (
        F.when(text.isNull(), F.array().cast("array<string>"))
        .when(body.startswith("["), F.coalesce(F.from_json(body, "array<string>"), one))
        .otherwise(one)
    )
