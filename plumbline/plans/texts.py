"""Text queries (§2.8 text, J9, G11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as T
from .registry import Tables, query


@query("""WITH h AS (SELECT doc_id, text, regexp_extract_all(text, '[0-9]{3,}') AS hits, regexp_split_to_array(text, '[0-9]{3,}') AS gaps FROM documents WHERE regexp_matches(text, '[0-9]{3,}')),
 e AS (SELECT doc_id, text, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM h),
 p AS (SELECT doc_id, text, i, len(hits[i]) AS n, list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: len(x))), 0) AS start FROM e),
 j AS (SELECT doc_id, i, start, start + n AS stop, regexp_matches(substring(text, greatest(start - 120, 0)::BIGINT + 1, (start + n + 120 - greatest(start - 120, 0))::BIGINT), 'licen[sc]e|copyright', 'i') AS explained FROM p)
 SELECT doc_id, count(*) AS n, coalesce(string_agg(start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE NOT explained), '') AS unexplained FROM j GROUP BY 1""")
def retraction_window(t: Tables) -> DataFrame:
    """The figures of each text that no explanation stands near."""
    found = T.unexplained("[0-9]{3,}", "licen[sc]e|copyright", 120)(F.col("text"))
    hits = F.size(F.regexp_extract_all("text", F.lit("[0-9]{3,}"), 0)).cast("long")
    shown = F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return t.documents.filter(F.col("text").rlike("[0-9]{3,}")).select("doc_id", hits.alias("n"), shown.alias("unexplained"))


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, round(avg(n_chars), 4) AS mean FROM documents GROUP BY ALL""")
def document_profile(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 4).alias("mean"))
