"""One copy of a rule for rows and for arrays: rules are steps that set fields from fields.

A step maps field names to functions of a ``Field``, which gives the column of a field by its name: ``F.col`` for
the columns of a row, ``x.getField`` for an element of an array of structs. Batch plans run the steps over rows;
row-local plans (streams) run the same steps over the array beside a document's text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Field = Callable[[str], Column]
Step = dict[str, Callable[[Field], Column]]
CHUNK = 64  # elements of a chunk of a scan


def on_rows(df: DataFrame, steps: list[Step], temporary: list[str] = ()) -> DataFrame:
    for step in steps:
        df = df.withColumns({name: make(F.col) for name, make in step.items()})
    return df.drop(*temporary)


def _set_fields(step: Step) -> Callable[[Column], Column]:
    def set_fields(x: Column) -> Column:
        made = {name: make(x.getField) for name, make in step.items()}
        for name, value in made.items():
            x = x.withField(name, value)
        return x

    return set_fields


def on_array(elements: Column, steps: list[Step]) -> Column:
    """``elements`` (array of structs) with the fields that the steps set; temporary ones stay."""
    for step in steps:
        elements = F.transform(elements, _set_fields(step))
    return elements


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(elements: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str) -> Column:
    """A running state over an array: ``step(state, element)`` gives the next state and the element's result (of
    ``out_type``). The value is a struct of ``outs`` (a result per element) and ``last`` (the final state).

    ``aggregate`` copies what it has gathered at every step, so one over all elements would cost the square of their
    number. A first pass over chunks keeps the state at the start of each, a second one fills each chunk's
    results; states and results should be small."""

    def chunks_of(el: Column) -> Column:
        count = F.greatest(F.floor((F.size(el) - 1) / CHUNK), F.lit(0))
        return F.transform(F.sequence(F.lit(0), count.cast("int")), lambda k: F.slice(el, k * CHUNK + 1, F.lit(CHUNK)))

    def pair(a: Column, b: Column) -> Column:
        return F.struct(a.alias("outs"), b.alias("state"))

    def results(chunks: Column) -> Column:
        starts = F.aggregate(chunks, pair(F.array(state), state), lambda acc, chunk: bind(
            F.aggregate(chunk, acc["state"], lambda s, e: step(s, e)[0]), lambda s: pair(F.concat(acc["outs"], F.array(s)), s)))
        none = F.array().cast(f"array<{out_type}>")

        def fill(chunk: Column, start: Column) -> Column:
            return F.aggregate(chunk, pair(none, start), lambda acc, e: pair(F.concat(acc["outs"], F.array(step(acc["state"], e)[1])), step(acc["state"], e)[0]),
                               lambda acc: acc["outs"])

        return bind(starts, lambda st: F.struct(
            F.flatten(F.zip_with(chunks, F.slice(st["outs"], F.lit(1), F.size(chunks)), fill)).alias("outs"), st["state"].alias("last")))

    return bind(elements, lambda el: bind(chunks_of(el), results))
