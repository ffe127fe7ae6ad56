"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.bpe import op7_bpe
from tidewell.llm.embedding_dedup import OP8_SQL, op8_embedding_dedup
from tidewell.llm.jaccard_join import OP3_SQL, op3_jaccard_join
from tidewell.llm.langid import op4_langid
from tidewell.llm.media import op5_media
from tidewell.llm.packing import op2_packing
from tidewell.llm.pii import op1_pii
from tidewell.llm.substring_dedup import op6_substring_dedup
from tidewell.llm.toxicity import op10_toxicity
from tidewell.llm.url_filter import OP9_SQL, op9_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_packing, op3_jaccard_join, op4_langid, op5_media, op6_substring_dedup, op7_bpe, op8_embedding_dedup, op9_url_filter, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op8_embedding_dedup": OP8_SQL, "op9_url_filter": OP9_SQL}
