"""Declared schemas of the product tables; nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


S, I, D, TS = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

#: An answer slot: the unit of the visibility denominator and the key of the answers table.
SLOT = ["run_id", "prompt_id", "provider"]

LLM_RESPONSES = _struct(run_id=S, prompt_id=S, prompt_text=S, provider=S, model=S, response_text=S,
                        latency_ms=I, error=S, created_at=TS)
BRAND_MENTIONS = _struct(run_id=S, prompt_id=S, provider=S, brand=S, position=I, sentiment=S,
                         snippet=S, created_at=TS)
CITATION_SOURCES = _struct(run_id=S, prompt_id=S, provider=S, url=S, domain=S, domain_type=S,
                           created_at=TS)
#: ``target_brands`` stays JSON text at rest; ``sources.tables.list_prompts`` decodes it.
PROMPTS = _struct(prompt_id=S, prompt_text=S, category=S, target_brands=S, created_at=TS)
FANOUT = _struct(id=S, category=S, original=S, target_brands=T.ArrayType(S),
                 fanout_queries=T.ArrayType(S), n_queries=I, response_text=S, error=S)

TABLES = {
    "llm_responses": LLM_RESPONSES,
    "brand_mentions": BRAND_MENTIONS,
    "citation_sources": CITATION_SOURCES,
    "prompts": PROMPTS,
}
