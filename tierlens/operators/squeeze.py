"""Small columns that stand for a table's, and the table made from them again.

A column of which queries use date parts or typed paths of a variant alone is
held as these.  For a query it is put together from them: not as it was, but
such that all that the query asks gives the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..plans.lineage import UNITS, Annotation

Forms = dict[str, Annotation | None]
_PATH = re.compile(r"\$((?:\.[A-Za-z_]\w*)+):(\w+(?:\(\d+,\d+\))?)")


def _paths(detail: str) -> list[tuple[tuple[str, ...], str]] | None:
    """(names, type) of the paths of a variant; None if one is no chain of names or begins another."""
    found = [_PATH.fullmatch(p) for p in re.split(r",(?=\$)", detail)]
    if not all(found):
        return None
    paths = [(tuple(m[1][1:].split(".")), m[2]) for m in found]
    if any(a != b and b[: len(a)] == a for a, _ in paths for b, _ in paths) or len({tuple(x.lower() for x in p) for p, _ in paths}) < len(paths):
        return None
    return paths


def squeezable(form: Annotation | None) -> bool:
    """Whether small columns can stand for the column; a weekday can't be kept together with other parts."""
    if form is None:
        return False
    if form.kind == "date":
        return "DOW" not in form.detail or form.detail == "DOW"
    return form.kind == "variant" and _paths(form.detail) is not None


def covers(held: Annotation | None, asked: Annotation | None) -> bool:
    """Whether what is held of a column answers what is asked of it."""
    if not squeezable(held):
        return True
    return asked is not None and asked.kind == held.kind and set(asked.detail.split(",")) <= set(held.detail.split(","))


def merged(a: Annotation | None, b: Annotation | None) -> Annotation | None:
    """The form that answers both; None (the whole column) if there is none."""
    if a is None or b is None or a.kind != b.kind:
        return None
    parts = set(a.detail.split(",")) | set(b.detail.split(","))
    kept = [u for u in UNITS if u in parts] if a.kind == "date" else sorted(parts)
    return Annotation(a.table, a.column, a.kind, ",".join(kept))


def squeeze(base: DataFrame, forms: Forms) -> DataFrame:
    """*base*'s columns, those with a form that can be squeezed as small columns."""
    out = []
    for name in base.columns:
        form, value = forms.get(name), F.col(f"`{name}`")
        if not squeezable(form):
            out.append(value)
        elif form.kind == "date":
            out += [dates.part(u, value).cast("smallint").alias(f"{name}_{u.lower()}") for u in form.detail.split(",")]
        else:
            out += [F.try_variant_get(value, "$." + ".".join(p), kind).alias("_".join([name, *p])) for p, kind in _paths(form.detail)]
    return base.select(*out)


def restore(held: DataFrame, base: DataFrame, forms: Forms) -> DataFrame:
    """The columns of *base* from :func:`squeeze`, equal in all that their forms tell of them."""
    out = []
    for f in base.schema.fields:
        form = forms.get(f.name)
        if not squeezable(form):
            out.append(F.col(f"`{f.name}`"))
        elif form.kind == "date":
            parts = {u: F.col(f"`{f.name}_{u.lower()}`").cast("int") for u in form.detail.split(",")}
            whole = dates.expand("DOW", parts["DOW"]) if "DOW" in parts else F.make_date(parts.get("YEAR", F.lit(1972)), parts.get("MONTH", F.lit(1)), parts.get("DAY", F.lit(1)))
            out.append(whole.cast(f.dataType).alias(f.name))
        else:
            out.append(F.to_variant_object(_nested({p: F.col("`" + "_".join([f.name, *p]) + "`") for p, _ in _paths(form.detail)})).alias(f.name))
    return held.select(*out)


def _nested(values: dict[tuple[str, ...], Column]) -> Column:
    heads = dict.fromkeys(p[0] for p in values)
    return F.struct(*[(values[(h,)] if (h,) in values else _nested({p[1:]: v for p, v in values.items() if p[0] == h})).alias(h) for h in heads])
