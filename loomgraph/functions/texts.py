"""Scalar text functions: what a symbol is for, the language of an error, paths, segments of names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts of a label suggest, in the order in which they are tried.
INTENTS = (("test", "checks"), ("parse", "reads"), ("handle", "handles requests of"), ("config", "configures"), ("error", "reports failures of"), ("auth", "guards access to"))
#: What an error text has by language, in the order in which they are tried.
ERROR_MARKS = (
    ("python", ("traceback (most recent call last)", 'file "')), ("rust", ("panicked at", "src/main.rs", ".rs:")), ("go", ("goroutine ", ".go:")), ("java", ("exception in thread", ".java:")),
    ("typescript", (".ts:", ".tsx:")), ("javascript", (".js:", "at object.")),
)


def segments(label: Column) -> Column:
    """Lower-case parts of a name of at least three characters."""
    return F.filter(F.array_distinct(F.split(F.lower(label), r"[\s_#./:\-]+")), lambda x: F.length(x) >= 3)


def intent_summary(label: Column, kind: Column, tags: Column) -> Column:
    """A sentence on what a symbol is for: its kind, the verb its label suggests, and its first tag."""
    low = F.lower(label)
    verb = reduce(lambda w, kv: w.when(low.contains(kv[0]), kv[1]), INTENTS[1:], F.when(low.contains(INTENTS[0][0]), INTENTS[0][1])).otherwise("is part of")
    about = F.coalesce(F.get(tags, F.lit(0)), F.lit("the system"))
    return F.concat_ws(" ", kind, label, verb, about)


def error_language(text: Column, hint: Column | None = None) -> Column:
    """The language whose marks an error text has first, else the hint, else ``unknown``."""
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for language, marks in ERROR_MARKS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), language)
    return out.otherwise(F.coalesce(hint, F.lit("unknown")) if hint is not None else F.lit("unknown"))


def normalised_path(path: Column) -> Column:
    """Forward slashes, no drive, no leading ``./`` or ``/``, no doubled slashes."""
    p = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[A-Za-z]:", "")
    return F.regexp_replace(F.regexp_replace(p, r"/{2,}", "/"), r"^(?:\.?/)+", "")
