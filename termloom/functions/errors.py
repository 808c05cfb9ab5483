"""Failed rows: which stage an error came from, and its chain of causes as one text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Error types and the stage that each stands for, and how messages of the pipeline itself begin.
LOCAL, PLANNER, RERANKER, PIPELINE, UNKNOWN = "local_retrieval", "query_planner", "reranker", "pipeline", "unknown"
TYPES = {
    "QueryPlanningError": PLANNER, "LLMRerankerError": RERANKER, "CandidateMergeError": PIPELINE, "CandidateNormalizationError": PIPELINE,
    "MappingResultBuilderError": PIPELINE, "DisabledMappingError": PIPELINE, "PublicRetrievalError": PIPELINE,
}
MESSAGES = {"QueryPlanner failed": PLANNER, "LLMReranker failed": RERANKER}
LOCAL_TYPE, OWN_TYPE, MOST = "LocalRetrievalError", "PlannedPipelineError", 8


def error_stage(chain: Column) -> Column:
    """chain: an array of structs type and message, the outermost first. A failed local retrieval anywhere decides, then the first error of a known
    type, then how the pipeline's own message begins."""
    top = F.slice(chain, 1, MOST)
    local = F.exists(top, lambda e: e.type == LOCAL_TYPE)
    of_type = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    typed = F.get(F.filter(F.transform(top, lambda e: F.try_element_at(of_type, e.type)), lambda x: x.isNotNull()), F.lit(0))
    own = F.get(F.filter(top, lambda e: e.type == OWN_TYPE), F.lit(0))
    said = F.lit(PIPELINE)
    for start, stage in MESSAGES.items():
        said = F.when(F.startswith(own.message, F.lit(start)), stage).otherwise(said)
    has = F.size(F.coalesce(top, F.array().cast("array<struct<type: string, message: string>>"))) > 0
    return F.when(~has, UNKNOWN).when(local, LOCAL).when(F.exists(top, lambda e: e.type.isin(*TYPES)), typed).when(F.exists(top, lambda e: e.type == OWN_TYPE), said).otherwise(UNKNOWN)


def chain_text(chain: Column, most: int = 1_000) -> Column:
    """The errors of a chain as `Type: message`, joined by arrows, cut to most characters with dots."""
    each = F.transform(F.slice(chain, 1, MOST), lambda e: F.concat_ws(": ", e.type, F.nullif(F.trim(e.message), F.lit(""))))
    text = F.array_join(each, " <- ")
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))).otherwise(text)
