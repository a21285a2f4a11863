"""Schemas of the catalog, portal and work tables."""

COLUMN_PROFILE = "struct<name:string,structural_type:string,semantic_types:array<string>,unclean_values_ratio:double,num_distinct_values:bigint,mean:double,stddev:double,coverage:array<struct<range:struct<gte:double,lte:double>>>,plot:struct<type:string,data:array<struct<count:bigint,bin_start:double,bin_end:double,bin:string>>>>"
PORTAL_DDL = "domain string, provider string, display_label string, dataset_count bigint, last_indexed_at timestamp"
CATALOG_DDL = (
    "id string, title string, description string, source string, domain string, provider string, download_url string, types array<string>, "
    "temporal_coverage struct<start:string,end:string>, spatial_coverage struct<label:string,bbox:struct<type:string,coordinates:array<array<double>>>>, "
    "source_updated_at string, last_update_date string, "
    f"profiler_metadata struct<nb_rows:bigint,nb_profiled_rows:bigint,nb_columns:bigint,nb_spatial_columns:int,nb_temporal_columns:int,nb_categorical_columns:int,nb_numerical_columns:int,types:array<string>,attribute_keywords:array<string>,sample:string,columns:array<{COLUMN_PROFILE}>>"
)
REGISTRY_DDL = "url string, dataset_count bigint"
