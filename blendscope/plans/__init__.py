from .flows import (analyze_table, fuse_tables, metadata, profile_row, profile_table, recommend_all, recommend_pair,
                    study_fusion)
from .stored import is_current, refresh, source_manifest, stored_column_profile, stored_duplicates, stored_quality

__all__ = ["analyze_table", "fuse_tables", "is_current", "metadata", "profile_row", "profile_table", "recommend_all",
           "recommend_pair", "refresh", "source_manifest", "stored_column_profile", "stored_duplicates", "stored_quality", "study_fusion"]
