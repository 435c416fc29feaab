"""Type labels and type standardisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import FRACTIONAL, INTEGRAL, col, dtype_of, is_numeric, is_string, string_names
from ..functions.values import BOOLEAN_WORDS, DATE_SEPARATOR_PATTERN, ISO_DATE_PATTERN, number
from ..session import agg_row, local_table
from ..sources.io import normalize

DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# Date layouts tried on text, most usual first, each with the shape that text must have.
DATE_LAYOUTS = {
    "yyyy-MM-dd": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}:\d{2}$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d{1,2}-\d{1,2}T\d{2}:\d{2}:\d{2}$",
    "yyyy/MM/dd": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy.MM.dd": r"^\d{4}\.\d{1,2}\.\d{1,2}$",
    "MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "MM-dd-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "MM.dd.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "dd/MM/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "dd-MM-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "dd.MM.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    "yyyy-MM-dd HH:mm": r"^\d{4}-\d{1,2}-\d{1,2} \d{2}:\d{2}$",
    "yyyy/MM/dd HH:mm:ss": r"^\d{4}/\d{1,2}/\d{1,2} \d{2}:\d{2}:\d{2}$",
    "MM/dd/yyyy HH:mm": r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$",
    "MM/dd/yyyy HH:mm:ss": r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$",
    "MM/dd/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "dd/MM/yy": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "dd-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "MMM-dd-yyyy": r"^[A-Za-z]{3}-\d{1,2}-\d{4}$",
    "dd-MMM-yy": r"^\d{1,2}-[A-Za-z]{3}-\d{2}$",
}

# Fixed value: ISO instants with fractions or a zone, which a cast reads; zones are turned to the session's.
ISO = "iso"
DATE_LAYOUTS[ISO] = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)? ?(Z|[+-]\d{2}:\d{2})?$"

# A text column becomes numeric below this share of new NULLs, a date above this share.
MAX_NEW_NULLS = 0.10
MIN_DATES = 0.80


def parse_date(text, layout: str):
    """Timestamp of a text in a layout, NULL otherwise. Two-digit years lie in 1969 to 2068."""
    trimmed = F.trim(text)
    if layout == ISO:
        return F.when(trimmed.rlike(DATE_LAYOUTS[ISO]), trimmed.try_cast("timestamp"))
    shown, single = trimmed, layout.replace("dd", "d")
    if "MMM" in layout:  # month names are read with a capital, which needs spaces between the parts
        shown, single = F.initcap(F.replace(trimmed, F.lit("-"), F.lit(" "))), single.replace("-", " ")
    else:
        single = single.replace("MM", "M")
    found = F.try_to_timestamp(shown, F.lit(single))
    if single.count("y") == 2:
        found = F.when(F.year(found) > 2068, found - F.make_ym_interval(F.lit(100))).otherwise(found)
    return F.when(trimmed.rlike(DATE_LAYOUTS[layout]), found)


def rich_label_dict(df: DataFrame) -> dict:
    """``{column: Integer | Float | Datetime | Boolean | Categorical/String | type name}``."""
    texts = string_names(df)
    tests = {"*": F.count(F.lit(1))}
    for c in texts:
        known = F.lower(col(c)).isin(BOOLEAN_WORDS)
        tests[c, "n"] = F.count(col(c))
        tests[c, "dates"] = F.count_if(col(c).rlike(ISO_DATE_PATTERN))
        tests[c, "words"] = F.count_if(known)
        # A set of spellings of ten short words cannot grow with the data.
        tests[c, "spellings"] = F.size(F.collect_set(F.when(known, col(c))))
    seen = agg_row(df, tests) if texts else {}
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, INTEGRAL):
            label = "Integer"
        elif isinstance(f.dataType, FRACTIONAL):
            label = "Float"
        elif isinstance(f.dataType, DATES):
            label = "Datetime"
        elif f.name in texts:
            c = f.name
            if seen["*"] and seen[c, "dates"] == seen["*"]:
                label = "Datetime"
            elif seen[c, "words"] == seen[c, "n"] and seen[c, "spellings"] <= 2:
                label = "Boolean"
            else:
                label = "Categorical/String"
        else:
            label = "bool" if isinstance(f.dataType, T.BooleanType) else f.dataType.simpleString()
        out[f.name] = label
    return out


def rich_labels(df: DataFrame) -> DataFrame:
    """Rows (ordinal, column, label, n_values)."""
    df = normalize(df)
    labels = rich_label_dict(df)
    counts = agg_row(df, {c: F.count(col(c)) for c in df.columns})
    return local_table(df.sparkSession, [(i, c, labels[c], counts[c]) for i, c in enumerate(df.columns)],
                       "ordinal int, column string, label string, n_values bigint")


def binary_label_dict(df: DataFrame) -> dict:
    return {f.name: "Numeric" if is_numeric(f.dataType) else "Categorical" for f in df.schema.fields}


def binary_labels(df: DataFrame) -> DataFrame:
    """Rows (ordinal, column, label, n_values) with Numeric or Categorical."""
    df = normalize(df)
    counts = agg_row(df, {c: F.count(col(c)) for c in df.columns})
    labels = binary_label_dict(df)
    return local_table(df.sparkSession, [(i, c, labels[c], counts[c]) for i, c in enumerate(df.columns)],
                       "ordinal int, column string, label string, n_values bigint")


def standardize(df: DataFrame) -> DataFrame:
    """Text that is nearly all numbers becomes double, text that is mostly dates becomes a timestamp.

    A first scan counts numbers and, by pattern alone, the shapes of dates; a second one parses only those columns and
    layouts that can still pass. Each date column takes the layout that parses most values.
    """
    df = normalize(df)
    texts = string_names(df)
    flags = [f.name for f in df.schema.fields if isinstance(f.dataType, T.BooleanType)]
    if not texts and not flags:
        return df
    tests = {"*": F.count(F.lit(1))}
    for c in texts + flags:
        tests[c, "n"] = F.count(col(c))
    for c in texts:
        tests[c, "number"] = F.count(number(col(c)))
        tests[c, "separator"] = F.count_if(col(c).rlike(DATE_SEPARATOR_PATTERN))
        short = F.when(F.length(col(c)) <= 40, F.trim(col(c)))
        for shape in dict.fromkeys(DATE_LAYOUTS.values()):
            tests[c, shape] = F.count_if(short.rlike(shape))
    seen = agg_row(df, tests)
    n = seen["*"]
    numeric = {c for c in texts if n and seen[c, "number"] > 0 and (seen[c, "n"] - seen[c, "number"]) / n < MAX_NEW_NULLS}
    worth = [(c, k) for c in texts for k, shape in DATE_LAYOUTS.items()
             if n and c not in numeric and seen[c, "separator"] and seen[c, shape] / n > MIN_DATES]
    parsed = agg_row(df, {p: F.count(parse_date(col(p[0]), p[1])) for p in worth}) if worth else {}
    out = []
    for f in df.schema.fields:
        c, expr = f.name, col(f.name)
        if n and c in texts:
            best = max(DATE_LAYOUTS, key=lambda k: parsed.get((c, k), 0))
            if c in numeric:
                expr = number(expr)
            elif parsed.get((c, best), 0) / n > MIN_DATES:
                expr = parse_date(expr, best).cast("timestamp_ntz")
        elif n and c in flags and 0 < seen[c, "n"] < n:
            expr = expr.cast("double")
        out.append(expr.alias(c))
    return df.select(*out)


def clean_numeric_names(df: DataFrame, columns) -> list:
    """The text columns among ``columns`` whose every value is a number."""
    texts = [c for c in columns if is_string(dtype_of(df, c))]
    if not texts:
        return []
    seen = agg_row(df, {
        key: value for c in texts for key, value in (
            ((c, "n"), F.count(col(c))), ((c, "ok"), F.count(number(col(c)))))
    })
    return [c for c in texts if seen[c, "n"] == seen[c, "ok"]]


def numeric_if_clean(df: DataFrame, columns=None) -> DataFrame:
    """All-or-nothing: a text column becomes double only when that loses no value."""
    ok = set(clean_numeric_names(df, df.columns if columns is None else columns))
    return df.select(*[number(col(c)).alias(c) if c in ok else col(c) for c in df.columns])
