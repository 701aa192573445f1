"""The unified tables and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

TABLES = {
    "articles": "article_id string, title string, abstract string, body string, category string, subcategory string, entities array<string>, published_time timestamp_ntz",
    "impressions": "impression_id bigint, source_impression_id bigint, user_id string, timestamp timestamp_ntz, inview_ids array<string>, clicked_ids array<string>, source_split string",
    "history": "user_id string, article_id string, timestamp timestamp_ntz, position int, snapshot string",
    "article_features": "article_id string, title string, abstract string, category string, published_time timestamp_ntz, tokens array<string>, n_tokens int, train_clicks bigint, popularity_rank bigint, is_head boolean",
    "user_profiles": "user_id string, split string, clicked_ids array<string>, n_clicks int, last_click_time timestamp_ntz, is_cold boolean, is_low_history boolean",
    "vectors": "article_id string, vec array<float>",
}


def schema_of(name: str) -> T.StructType:
    if name not in TABLES:
        raise KeyError(f"unknown table {name!r}; known: {sorted(TABLES)}")
    return T.StructType.fromDDL(TABLES[name])


def validate(df: DataFrame, name: str, types: bool = True) -> DataFrame:
    """``df`` with its columns in the table's order; ValueError names what does not fit."""
    want = {f.name: f.dataType for f in schema_of(name)}
    missing, extra = sorted(set(want) - set(df.columns)), sorted(set(df.columns) - set(want))
    wrong = sorted(c for c in want if types and c in df.columns and df.schema[c].dataType.simpleString() != want[c].simpleString())
    if missing or extra or wrong:
        raise ValueError(f"table {name!r}: missing {missing}, extra {extra}, other type {wrong}")
    return df.select(*want)
