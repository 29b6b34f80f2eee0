"""Style sheets to rules: class and tag selectors only, declarations by property."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SIMPLE = re.compile(r"^(?:([a-z][a-z0-9]*)|\.([A-Za-z_][\w-]*)|([a-z][a-z0-9]*)\.([A-Za-z_][\w-]*))$")


def rules_of(css: str) -> list[tuple[str, str, str]]:
    """(selector, property, value) in order; comments, at-rules' heads and !important go,
    selectors that are more than a tag, a class or both are left out."""
    out = []
    for heads, body in RULE.findall(re.sub(r"/\*.*?\*/", "", css, flags=re.S)):
        for head in heads.split(","):
            if SIMPLE.match(head := head.strip()):
                for declaration in body.split(";"):
                    name, colon, value = declaration.partition(":")
                    value = re.sub(r"\s*!important\s*$", "", value.strip(), flags=re.I)
                    if colon and name.strip() and value:
                        out.append((head, name.strip().lower(), value))
    return out


def style_rules(sheets: DataFrame, id_col: str, css_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(key, n, *rule) for key, css in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]) for n, rule in enumerate(rules_of(css), 1)]
            yield pd.DataFrame(rows, columns=[id_col, "n", "selector", "property", "value"])

    kind = sheets.schema[id_col].dataType.simpleString()
    return sheets.select(id_col, F.coalesce(css_col, F.lit("")).alias("css")).mapInPandas(run, f"{id_col} {kind}, n int, selector string, property string, value string")
