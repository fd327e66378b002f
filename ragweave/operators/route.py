"""Routing of queries by complexity, and their decomposition into sub-queries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragweave.functions import text as T
from ragweave.operators.embed import model_udf
from ragweave.plans.config import BRIDGES, CONCEPTS, THINKERS, Settings
from ragweave.providers import ChatModel

SCHEMA = {"type": "object", "properties": {"queries": {"type": "array", "items": {"type": "string"}}}, "required": ["queries"]}
PROMPT = "Break the question into at most three searches that can be made independently of each other. Keep names and technical terms. Reply with JSON that has one list of strings, queries."


def complexity(query: Column, thinkers: tuple[str, ...] = THINKERS, concepts: tuple[str, ...] = CONCEPTS, bridges: tuple[str, ...] = BRIDGES) -> Column:
    """struct of the four parts and their sum."""
    named, stems = T.stem_hits(query, thinkers), T.stem_hits(query, concepts)
    bridge = F.when(T.stem_hits(query, bridges) > 0, 2).otherwise(0)
    quoted = F.when(T.has_quoted_span(query), 1).otherwise(0)
    total = named + stems + bridge + quoted
    return F.struct(named.alias("thinker_count"), stems.alias("concept_count"), bridge.alias("bridge_score"), quoted.alias("artifact_score"), total.alias("total_score"))


def parse_decomposition(reply: Column, query: Column, most: int = 3) -> Column:
    """The first sub-queries of a reply; the query itself if the reply is not JSON or lacks the list; an empty list stays."""
    return F.coalesce(F.slice(F.from_json(reply, "struct<queries:array<string>>")["queries"], 1, most), F.array(query))


def sub_queries(queries: DataFrame, make: Callable[[], ChatModel], settings: Settings = Settings()) -> DataFrame:
    """Add sub_queries; only complex queries are put to the model, whose failures fall back to the query."""

    def run(parts):
        model = make()
        for part in parts:
            replies = []
            for q in part:
                try:
                    replies.append(None if q is None else model.chat(PROMPT, f"Question: {q}", SCHEMA))
                except Exception:
                    replies.append(None)
            yield pd.Series(replies, dtype=object)

    query = F.col("query")
    asked = F.when(complexity(query)["total_score"] >= settings.complex_from, query)
    replied = queries.withColumn("_reply", model_udf(run, "string")(asked))
    return replied.withColumn("sub_queries", F.when(asked.isNull(), F.array(query)).otherwise(parse_decomposition(F.col("_reply"), query, settings.sub_queries))).drop("_reply")
