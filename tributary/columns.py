"""Column names of the pipeline's tables, which are its public schema."""

ENTITY_UID = "entity_uid"
SOURCE_NAME = "source_name"
SOURCE_UPDATED_AT = "source_updated_at"
PIPELINE_LOADED_AT = "pipeline_loaded_at"
LEFT, RIGHT = "left_entity_uid", "right_entity_uid"
CLUSTER_ID = "cluster_id"
SCORE = "match_total_score"
CONFIDENCE = "match_confidence"
TIER_NAME, TIER_PRIORITY = "match_tier_name", "match_tier_priority"
BAND, DETAIL, AUTO = "match_band", "match_detail", "is_auto_match"


def score_column(comparison: str) -> str:
    return f"match_score_{comparison}"


def weight_column(comparison: str) -> str:
    return f"match_log_weight_{comparison}"
